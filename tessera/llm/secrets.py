"""Secret scans by a trigram inverted index, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import materialize
from tessera.llm.trigrams import ALL, Query, heads, query_of, trigrams_of

# The rules' patterns, kinds and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """kind, pattern, the group whose length counts (0: the match) and its least length.

    `faster` is a pattern with the same long matches that the engine skips short ones by.  The trigrams that a match must hold are derived from the pattern.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    faster: str = ""

    @property
    def query(self) -> Query:
        return query_of(self.pattern)


BASE = (
    Rule("assign", ASSIGN, 12, 1),
    Rule("access", ACCESS, 18, 0, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", HEX, 16, 0, r"[0-9a-f]{16,}+"),
)
#: Further public credential shapes.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
)

#: Documents in a block of the index: the longest posting list.
BLOCK_DOCS = 4096

_OPEN, _CLOSE, _PLAIN = "\x01", "\x02", "\x03"


def _holds(text: Column, trigrams: set[str]) -> Column:
    """Whether a text in lower case has one of the trigrams."""
    return reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in sorted(trigrams)])


def first_look(text: Column, rules: tuple[Rule, ...]) -> Column:
    """False where a text has none of the few trigrams without which no rule's query is met."""
    wanted = set().union(*[heads(r.query) for r in rules if r.query != ALL])
    # by way of a list of one, so that the text is put in lower case once and not for each trigram
    return F.exists(F.array(F.lower(text)), lambda low: _holds(low, wanted)) if wanted else F.lit(False)


def candidates(docs: DataFrame, rules: tuple[Rule, ...], n_docs: int) -> DataFrame:
    """key and the kinds whose trigram query the document meets, from an inverted index of the rules' trigrams.

    The index holds, per trigram and block of documents, the sorted keys of documents that have it: blocks bound the posting lists,
    so no trigram, however common, is gathered in one place.  A query is answered block by block: "and" intersects postings, "or" unites them.
    """
    queried = {r.kind: r.query for r in rules if r.query != ALL}
    terms = sorted(set().union(*map(trigrams_of, queried.values())))
    if not terms:
        return docs.select("key", F.lit(None).cast("array<string>").alias("kinds")).limit(0)
    blocks = max(1, -(-n_docs // BLOCK_DOCS))
    has = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
    entries = docs.where(first_look(F.col("text"), rules)).select("key", F.lower("text").alias("low")).select("key", F.explode(has).alias("trigram"))
    index = entries.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "trigram").agg(F.sort_array(F.collect_set("key")).alias("postings"))
    lists = index.groupBy("block").pivot("trigram", terms).agg(F.first("postings"))
    none = F.array().cast("array<string>")

    def postings(q: Query) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.col(f"`{q}`"), none)
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, [postings(x) for x in q[1]])

    def answer(kind: str, q: Query) -> Column:
        return F.transform(postings(q), lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))

    found = [answer(kind, q) for kind, q in queried.items()]
    hits = lists.select(F.explode(F.concat(*found)).alias("hit"))
    return hits.groupBy("hit.key").agg(F.collect_set("hit.kind").alias("kinds"))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("rank", T.IntegerType())]))


def wrapped(text: Column, rule: Rule) -> Column:
    """The text with each match, and after it the group whose length counts, between control characters."""
    marks = f"{_OPEN}$1{_CLOSE}" + (f"${rule.group + 1}{_CLOSE}" if rule.group else "")
    return F.regexp_replace(text, F.lit(f"({rule.faster or rule.pattern})"), F.lit(marks))


#: Matches of a text that are added to one list at a time.
CHUNK = 256


def spans_of(parts: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, leftmost and without overlaps, in code points; parts is the wrapped text, cut at the openings, or null.

    Lengths of the pieces add up to places.  The control characters that the text itself had were replaced by one that no rule matches.
    Pieces are taken CHUNK at a time, so that the list of a text with very many matches is not copied for each of them.
    """
    start = T.StructType([T.StructField("at", T.LongType()), T.StructField("out", SPAN)])
    lists = T.StructType([T.StructField("at", T.LongType()), T.StructField("out", T.ArrayType(SPAN))])

    def step(state: Column, piece: Column) -> Column:
        cut = F.split(piece, _CLOSE)
        length = F.length(cut[0]).cast("long")
        counted = F.length(cut[1]) if rule.group else length
        span = F.struct(state["at"].alias("start"), (state["at"] + length).alias("end"), F.lit(rank).alias("rank"))
        out = F.when(counted >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct((state["at"] + length + F.length(cut[2 if rule.group else 1])).alias("at"), out.alias("out")).cast(start)

    def chunk(state: Column, number: Column) -> Column:
        zero = F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("out")).cast(start)
        some = F.aggregate(F.slice(parts, number * CHUNK + 2, F.lit(CHUNK)), zero, step)
        return F.transform(F.array(some), lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")).cast(lists))[0]

    zero = F.struct(F.length(parts[0]).cast("long").alias("at"), F.array().cast(T.ArrayType(SPAN)).alias("out")).cast(lists)
    found = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / CHUNK).cast("int")), zero, chunk, lambda s: F.flatten(s["out"]))
    return F.coalesce(F.when(F.size(parts) > 1, found), F.array().cast(SPAN))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> DataFrame:
    """Every document with the spans of all rules: `row` (struct of the input's columns other than the text), `text`, `spans` (array of start, end, rank: the rule's place in rules), by start, then rule.

    Rules with a trigram query are run on the documents that the index finds for them, the others on all.  Texts without any of a few trigrams
    that all queries need (first_look) are in no posting list, so they are not joined with what the index found, and not shuffled.

    Null and empty texts have no spans; very long ones are searched whole; of matches that start together the rule listed first comes first; rows with equal text share
    an index entry (a hash of 128 bits of the text); an empty table gives an empty one.
    """
    row = F.struct(*[docs[c] for c in docs.columns if c != text_col]) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("string").alias("none"))
    src = docs.select(row.alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    keyed = src.withColumn("key", F.md5(F.col("text").cast("binary")))
    hits = materialize(candidates(keyed.select("key", "text"), rules, docs.count()), "postings")
    look = first_look(F.col("text"), rules)
    joined = keyed.where(look).join(hits, "key", "left").select("row", "text", "kinds").unionByName(src.where(~look).select("row", "text", F.lit(None).cast("array<string>").alias("kinds")))
    # one projection after another, so that each regex runs once on a text
    marked = joined.withColumn("plain", F.translate("text", _OPEN + _CLOSE, _PLAIN * 2))
    marked = marked.select("row", "text", *[(F.when(F.array_contains("kinds", r.kind), wrapped(F.col("plain"), r)) if r.query != ALL else wrapped(F.col("plain"), r)).alias(f"marked{i}") for i, r in enumerate(rules)])
    cut = marked.select("row", "text", *[F.when(F.contains(f"marked{i}", F.lit(_OPEN)), F.split(f"marked{i}", _OPEN)).alias(f"parts{i}") for i in range(len(rules))])
    found = F.concat(*[spans_of(F.col(f"parts{i}"), r, i) for i, r in enumerate(rules)])
    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["rank"] - b["rank"])
    return cut.select("row", "text", F.array_sort(found, by_start).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = BASE + MORE) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, rank: int) -> Column:
    """How many of the spans are of the rule with this rank."""
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redact(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """`row` and `text` with each span, or run of overlapping spans, replaced by mask."""
    state = "struct<at:bigint,out:string>"

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], F.col("text").substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out")).cast(state)

    def end(s: Column) -> Column:
        return F.concat(s["out"], F.col("text").substr((s["at"] + 1).cast("int"), F.length("text")))

    masked = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")).cast(state), step, end)
    return scanned.select("row", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")).alias("text"), "spans")
