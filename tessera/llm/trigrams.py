"""Boolean trigram queries derived from regular expressions: what any text with a match must hold."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as op
from re import _parser

#: A query: a trigram, or ("and" | "or", queries).  ALL holds for every text.
Query = str | tuple
ALL: Query = ("and", ())

#: Characters of a set that are tried one by one, and strings that are held of what an expression may match, at most; beyond, it counts as any text.
SET, STRINGS = 10, 48


def _any(*parts: Query) -> Query:
    """One of the queries, in as few as say it."""
    flat = [q for p in parts for q in (p[1] if p[0] == "or" and not isinstance(p, str) else (p,))]
    if not flat or ALL in flat:
        return ALL
    terms = [frozenset(q[1]) if not isinstance(q, str) and q[0] == "and" else frozenset([q]) for q in flat]
    least = [t for t in dict.fromkeys(terms) if not any(o < t for o in terms)]  # what asks for more than another adds nothing
    kept = [_all(*t) for t in least]
    return kept[0] if len(kept) == 1 else ("or", tuple(sorted(kept, key=repr)))


def _all(*parts: Query) -> Query:
    """Each of the queries."""
    flat = sorted({q for p in parts for q in ((p,) if isinstance(p, str) or p[0] == "or" else p[1])}, key=repr)
    return flat[0] if len(flat) == 1 else ("and", tuple(flat))


def literal_query(text: str) -> Query:
    return _all(*[text[i : i + 3] for i in range(len(text) - 2)])


def _strings_query(strings: frozenset[str]) -> Query:
    return _any(*[literal_query(s) for s in strings])


@dataclass(frozen=True)
class Held:
    """What an expression matches: exactly these strings, or (None) texts that begin and end with one of those sets and meet the query."""

    exact: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    query: Query

    @classmethod
    def of(cls, strings) -> Held:
        own = frozenset(strings)
        return cls(own, own, own, ALL) if len(own) <= STRINGS else ANYTHING

    def full_query(self) -> Query:
        return self.query if self.exact is None else _strings_query(self.exact)

    def loose(self) -> Held:
        """The same without its exact strings; two characters at each end go on to neighbours."""
        if self.exact is None:
            return self
        return Held(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), self.full_query())


NOTHING, ANYTHING = frozenset([""]), Held(None, frozenset([""]), frozenset([""]), ALL)
EMPTY = Held(NOTHING, NOTHING, NOTHING, ALL)


def _then(a: Held, b: Held) -> Held:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return Held.of(x + y for x in a.exact for y in b.exact)
    begin = {x + y for x in a.exact for y in b.begin} if a.exact is not None else a.begin
    end = {x + y for x in a.end for y in b.exact} if b.exact is not None else b.end
    across = _strings_query(frozenset(x + y for x in a.end for y in b.begin)) if len(a.end) * len(b.begin) <= 4 * STRINGS else ALL
    short = lambda strings, cut: frozenset(map(cut, strings)) if len(strings) <= STRINGS else NOTHING
    return Held(None, short(begin, lambda s: s[:2]), short(end, lambda s: s[-2:]), _all(a.full_query(), b.full_query(), across))


def _either(parts: list[Held]) -> Held:
    if all(p.exact is not None for p in parts):
        together = frozenset().union(*[p.exact for p in parts])
        if len(together) <= STRINGS:
            return Held.of(together)
    parts = [p.loose() for p in parts]
    return Held(None, frozenset().union(*[p.begin for p in parts]), frozenset().union(*[p.end for p in parts]), _any(*[p.query for p in parts]))


def _character(code: int) -> Held:
    # the index is of texts in lower case; beyond ASCII the case of a character can depend on its neighbours, so those are left open
    return Held.of([chr(code).lower()]) if code < 128 else ANYTHING


def _set(items) -> Held:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 2 * SET:
            codes |= set(range(value[0], value[1] + 1))
        else:
            return ANYTHING
    if len(codes) > 2 * SET or max(codes, default=128) > 127:
        return ANYTHING
    lower = {chr(c).lower() for c in codes}
    return Held.of(lower) if len(lower) <= SET else ANYTHING


def _repeated(least: int, most, inner: Held) -> Held:
    if not least:
        return _either([EMPTY, inner]) if most == 1 else ANYTHING
    some = reduce(_then, [inner] * min(least, 3))
    return some if least == most and least <= 3 else some.loose()


def _held(tree) -> Held:
    out = EMPTY
    for kind, value in tree:
        if kind is op.LITERAL:
            one = _character(value)
        elif kind is op.IN:
            one = _set(value)
        elif kind is op.BRANCH:
            one = _either([_held(b) for b in value[1]])
        elif kind is op.SUBPATTERN:
            one = _held(value[3])
        elif kind is op.ATOMIC_GROUP:
            one = _held(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            one = _repeated(value[0], value[1], _held(value[2]))
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            one = EMPTY
        else:
            one = ANYTHING
        out = _then(out, one)
    return out


def _own_sets(pattern: str) -> bool:
    """Whether the pattern's sets have sets or intersections inside, which the parser does not know."""
    inside, i = False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside and (c == "[" or pattern.startswith("&&", i)):
            return True
        elif c == "[" and not inside:
            inside = True
            i += pattern.startswith("^", i + 1)
            i += pattern.startswith("]", i + 1)
        elif c == "]":
            inside = False
        i += 1
    return False


@lru_cache(maxsize=1024)
def query_of(pattern: str) -> Query:
    """The query that holds for the lower case of every text in which the pattern matches; ALL where nothing of three characters is mandatory, or the
    pattern is beyond the parser."""
    if _own_sets(pattern):
        return ALL
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error", FutureWarning)
            tree = _parser.parse(pattern)
    except (re.error, FutureWarning, OverflowError, RecursionError):
        return ALL
    return _held(tree).full_query()


def trigrams_of(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _commonness(trigrams: set[str]) -> tuple:
    """How often texts may have one of the trigrams, as a rank: by how many there are and the letters in them."""
    return len(trigrams), sum(2 if c in " etaoinshr" else c.isalpha() for t in trigrams for c in t), sorted(trigrams)


def heads(query: Query) -> set[str]:
    """Few trigrams of which any text that meets the query has one."""
    if isinstance(query, str):
        return {query}
    each = [heads(q) for q in query[1]]
    return set().union(*each) if query[0] == "or" else min(each, key=_commonness, default=set())


def meets(query: Query, has) -> bool:
    """Whether a text with these trigrams meets the query."""
    if isinstance(query, str):
        return query in has
    return (any if query[0] == "or" else all)(meets(q, has) for q in query[1])
