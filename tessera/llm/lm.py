"""Cross-entropy difference: how much better a target language model predicts a document than a background model does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import drop, materialize
from tessera.llm.words import U64, _trim, link, mix, pieces, split

#: What the counts of a history have to say about the next word; the rest is left to the history shorter by a word.
WEIGHT = 0.7
#: Added to the count of each word of the shared vocabulary, and of the one event that stands for all other words.
ADDED = 0.5
#: Bytes of text in a block: documents of a task whose words and n-grams are counted, asked for and scored together.
BLOCK_BYTES = 8 << 20
#: A text's begin and end among the words' hashes.
EDGE = U64(0x5DEECE66D1CE4E5B)
#: Bits of an n-gram's key: of 10 ** 12 n-grams about one in 70,000 then shares its count with another.  Each bit is written four times.
KEY_BITS = 56
_KEY = U64((1 << KEY_BITS) - 1)
#: What a block's texts count for: the target, the background, or neither, where they are only scored.
TARGET, BACKGROUND, NEITHER = 0, 1, 2
#: Kinds of rows: texts, a block's keys and counts, the sums over all blocks.
TEXT, ASKED, ANSWERED = 0, 1, 2
_ANSWER = "block long, part int, sums binary, words long"


def _planes(x: np.ndarray) -> bytes:
    """Integers by bytes of the same weight, most of which are zero, compressed."""
    data = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _integers(data: bytes, kind=np.int64) -> np.ndarray:
    plain = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values as they come, and which of them each one is; by hashing, not sorting."""
    found = pa.array(x).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


class Block:
    """The n-grams of a block's texts, of one word up to `order`.

    A token is a word or a text's end; `tokens` has the number of each text.  `keys` are the n-grams in order, `counts` how often each occurs.  at[k] says for each token
    which key the n-gram of k + 1 words that it ends is, -1 where the text has not begun so many words ago.
    """

    def __init__(self, texts: list[pa.Array], order: int):
        hashes, counts = [], []
        for text in texts:
            for _, part in pieces(text):
                w = split(part)
                hashes.append(w.hashes())
                counts.append(w.counts())
        n = np.concatenate(counts)
        self.tokens = n + 1
        ends = np.append(0, np.cumsum(n + 1))
        seq = np.full(int(ends[-1]) + 1, EDGE, U64)
        inside = np.ones(seq.size, bool)
        inside[ends] = False
        seq[inside] = np.concatenate(hashes)
        del hashes, inside
        self.text = np.repeat(np.arange(n.size), self.tokens)
        since = np.arange(seq.size - 1) - ends[self.text] + 1  # tokens of the text up to this one
        # the lowest bit tells words from longer n-grams
        grams, run, valid = [(seq & _KEY | U64(1))[1:]], seq, [np.ones(seq.size - 1, bool)]
        for k in range(1, order):
            run = link(run[:-1], seq[k:])  # the n-gram of k + 1 that begins at each place
            ended = np.concatenate([np.zeros(k - 1, U64), run])
            grams.append(mix(ended + U64(k)) & (_KEY - U64(1)))
            valid.append(since >= k)
        found, which = _distinct(np.concatenate([g[v] for g, v in zip(grams, valid)]))
        del grams, run, seq
        by = np.argsort(found)
        self.keys, rank = found[by], np.empty(by.size, np.int64)
        rank[by] = np.arange(by.size)
        which = rank[which]
        self.counts = np.bincount(which, minlength=by.size)
        self.at, lo = [], 0
        for v in valid:
            own = np.full(v.size, -1, np.int64)
            m = int(v.sum())
            own[v] = which[lo : lo + m]
            self.at.append(own)
            lo += m
        self.first = since == 1
        self.edge = int(np.searchsorted(self.keys, EDGE & _KEY | U64(1)))

    def before(self, k: int, of: np.ndarray, begin: int, none: int) -> np.ndarray:
        """For each token what `of` says of the n-gram of k + 1 words before it: begin at a text's first token, where that is its begin alone, and none for longer ones."""
        out = np.append(none, of[:-1])
        out[self.first] = none if k else begin
        return out

    def own(self, which: np.ndarray) -> np.ndarray:
        """How often the n-gram of each token occurs in the token's text; 0 where there is none."""
        _, place = _distinct(self.text * (self.keys.size + 1) + which + 1)
        return np.where(which >= 0, np.bincount(place)[place], 0)

    def losses(self, sums: np.ndarray, totals: np.ndarray, words: int, left_out: int | None) -> np.ndarray:
        """The loss of each token under each model (a row); sums has the models' counts of the keys, totals their tokens, words the vocabulary's size.

        left_out names the model whose corpus the texts are part of: a text's own counts are taken from it.
        """
        out = []
        for m in range(2):
            counts, tokens, begins = [np.where(at >= 0, sums[m][at], 0) for at in self.at], totals[m], sums[m][self.edge]
            if m == left_out:
                counts = [c - self.own(at) for c, at in zip(counts, self.at)]
                tokens, begins = tokens - np.repeat(self.tokens, self.tokens), begins - 1
            p = (counts[0] + ADDED) / (tokens + ADDED * (words + 1))
            for k, here in enumerate(counts[1:]):
                # the history before a text's first word is its begin, as often as there are ends
                seen = self.before(k, counts[k], begins, 0)
                p = np.where(seen > 0, WEIGHT * here / np.maximum(seen, 1) + (1 - WEIGHT) * p, p)
            out.append(-np.log(p))
        return np.stack(out)


def _give_back() -> None:
    """Hand memory that large arrays have left back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _runs(batches, column: str):
    """(value, batches) for each run of equal values in a sorted column."""
    held, current = [], None
    for batch in batches:
        values = batch.column(column).to_numpy()
        cut = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        for lo, hi in zip(cut, np.append(cut[1:], len(values))):
            if held and values[lo] != current:
                yield current, held
                held = []
                _give_back()
            current = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, held


def _deal(corpus: int, order: int, bits: int, most: int, keep: bool):
    """Deal a task's texts into blocks of about so many bytes; pass on the texts if keep, and after each block's what it asks for: its keys and counts, by ranges of keys."""

    def rows(block: int, n: int, row_type: pa.DataType, **columns) -> pa.RecordBatch:
        types = {"kind": pa.int32(), "block": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "tokens": pa.int64(), "row": row_type, "text": pa.string()}
        columns |= {"block": pa.array(np.full(n, block)), "kind": pa.array(np.full(n, columns["kind"], np.int32))}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))

    def ask(block: int, texts: list[pa.Array], row_type: pa.DataType) -> pa.RecordBatch:
        own = Block(texts, order)
        cut = np.append(np.searchsorted(own.keys, np.arange(1 << bits, dtype=U64) << U64(KEY_BITS - bits)), own.keys.size)
        parts = np.flatnonzero(np.diff(cut))
        keys = [_planes(np.diff(own.keys[cut[p] : cut[p + 1]], prepend=U64(0))) for p in parts]
        counts = [_planes(own.counts[cut[p] : cut[p + 1]]) for p in parts]
        tokens = np.zeros(parts.size, np.int64)
        tokens[0] = own.tokens.sum()
        return rows(block, parts.size, row_type, kind=ASKED, part=pa.array(parts, pa.int32()), keys=pa.array(keys, pa.binary()), counts=pa.array(counts, pa.binary()), tokens=pa.array(tokens))

    def deal(batches):
        block, held, size = (corpus << 60) + (TaskContext.get().partitionId() << 30), [], 0
        for batch in batches:
            row_type = batch.column("row").type
            for lo, part in pieces(batch.column("text")):
                if keep:
                    yield rows(block, len(part), row_type, kind=TEXT, row=batch.column("row").slice(lo, len(part)), text=part)
                held.append(part)
                size += part.nbytes
                if size >= most:
                    yield ask(block, held, row_type)
                    _give_back()
                    block, held, size = block + 1, [], 0
        if held:
            yield ask(block, held, row_type)

    return deal


def _answer(wanted: int):
    """Add up each key's counts over all blocks, and give the blocks of the wanted corpus the two corpora's sums of their keys, in their order; and how many words there are."""

    def answer(batches):
        for part, held in _runs(batches, "part"):
            blocks = np.concatenate([b.column("block").to_numpy() for b in held])
            keys = [np.cumsum(_integers(k.as_py(), U64), dtype=U64) for b in held for k in b.column("keys")]
            sizes = np.array([k.size for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")  # merges what is in order already
            new = np.append(True, np.diff(keys[order]) != 0)
            which = np.empty(keys.size, np.int64)
            which[order] = np.cumsum(new) - 1
            is_word = (keys[order[new]] & U64(1)) == 1
            del keys, order
            total = np.zeros((2, is_word.size), np.int64)
            ends = np.cumsum(sizes)
            counts = (c for b in held for c in b.column("counts"))
            for block, c, lo, hi in zip(blocks >> 60, counts, ends - sizes, ends):
                if block != NEITHER:
                    total[block, which[lo:hi]] += _integers(c.as_py())  # a block has each key once
            words = int((is_word & (total.sum(0) > 0)).sum())
            for block, lo, hi in zip(blocks, ends - sizes, ends):
                if block >> 60 == wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int32()), pa.array([_planes(total[:, which[lo:hi]].reshape(-1))], pa.binary()), pa.array([0])], names=["block", "part", "sums", "words"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([part], pa.int32()), pa.array([b""], pa.binary()), pa.array([words])], names=["block", "part", "sums", "words"])

    return answer


def _rate(order: int, totals: np.ndarray, words: int, left_out: int | None):
    """Score a block's texts by the sums of its keys."""

    def rate(batches):
        for _, held in _runs(batches, "block"):
            texts = [b.filter(pc.equal(b.column("kind"), TEXT)) for b in held]
            texts = [b for b in texts if len(b)]
            own = Block([b.column("text") for b in texts], order)
            sums = [_integers(s.as_py()).reshape(2, -1) for b in held for s in b.column("sums") if s.is_valid]
            losses = own.losses(np.concatenate(sums, 1), totals, words, left_out)
            mean = np.add.reduceat(losses, np.cumsum(own.tokens) - own.tokens, axis=1) / own.tokens
            lo = 0
            for b in texts:
                n, m = own.tokens[lo : lo + len(b)], mean[:, lo : lo + len(b)]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n), pa.array(m[0]), pa.array(m[1]), pa.array(m[0] - m[1])], names=["row", "n_tokens", "target_loss", "background_loss", "score"])
                lo += len(b)

    return rate


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, order: int = 2, text_col: str = "text", target_text: str = "text", block_bytes: int = BLOCK_BYTES, part_bits: int | None = None) -> DataFrame:
    """Score every document: `row` (struct of its columns other than the text), `n_tokens` (words and the text's end), the mean loss a token under each model, in
    nats, and `score`, target loss less background loss: the lower, the more like the target.

    Both models are n-grams of `order` words over one vocabulary, all words of both corpora, smoothed alike: what a history's counts say of the next word, by WEIGHT,
    and what the history shorter by a word says; a word's own probability is (count + ADDED) / (tokens + ADDED * (words + 1)), that of any word outside the vocabulary
    that of a word without a count.  Weights are the same for both and go by relative counts, so corpora of different sizes are matched.  The background is `docs` itself
    unless given; then a document's own counts are left out of the model that scores it, so that each is scored by the others.

    Every word and n-gram counts, however rare, and no task or driver holds the models, which grow with the corpora.  Texts are dealt into blocks of block_bytes.  Each block
    asks for the sums of its own n-grams, 2 ** part_bits ranges of keys add them up, and each block is answered; a hot key comes once from a block.  The driver sees three sums.  A row
    holds what a block asks of a range, so at hundreds of TB larger blocks (and executors) keep those rows few.

    Null or empty texts have one token, their end; very long texts are a block each and whole; repeated rows score alike, each as the others' copy; an empty target has no counts, so
    it predicts all words alike; an empty table gives an empty one.
    """

    def dealt(kind: int, df: DataFrame, text: str, row, keep: bool) -> DataFrame:
        src = df.select(row.alias("row"), df[text].cast("string").alias("text"))
        return src.mapInArrow(_deal(kind, order, bits, block_bytes, keep), f"kind int, block long, part int, keys binary, counts binary, tokens long, row {src.schema['row'].dataType.simpleString()}, text string")

    corpora = [(BACKGROUND if background is None else NEITHER, docs, text_col), (TARGET, target, target_text)] + ([] if background is None else [(BACKGROUND, background, text_col)])
    if part_bits is None:
        size = sum(df.agg(F.coalesce(F.sum(F.octet_length(df[text])), F.lit(0))).first()[0] for _, df, text in corpora)
        part_bits = (size // block_bytes // 2).bit_length()
    bits = max(4, part_bits)
    row = F.struct(*[docs[c] for c in docs.columns if c != text_col])
    corpus = corpora[0][0]
    own = materialize(dealt(corpus, docs, text_col, row, True), "blocks")
    columns = ["block", "part", "keys", "counts", "tokens"]
    asked = own.where(F.col("kind") == ASKED).select(*columns)
    others = [materialize(dealt(kind, df, text, F.lit(0), False).select(*columns), "asked") for kind, df, text in corpora[1:]]
    for other in others:
        asked = asked.unionByName(other)
    got = {r[0]: r[1] for r in asked.groupBy(F.shiftright("block", 60)).agg(F.sum("tokens")).collect()}
    totals = np.array([got.get(TARGET, 0), got.get(BACKGROUND, 0)])
    answers = materialize(asked.drop("tokens").repartition("part").sortWithinPartitions("part", "block").mapInArrow(_answer(corpus), _ANSWER), "answers")
    drop(*others)
    words = answers.where("block = -1").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    texts = own.where(F.col("kind") == TEXT).select("block", "kind", "part", "row", "text")
    both = texts.unionByName(answers.where("block >= 0").select("block", F.lit(ANSWERED).alias("kind"), "part", "sums"), allowMissingColumns=True)
    both = both.repartition("block").sortWithinPartitions("block", "kind", "part")
    kind = own.schema["row"].dataType.simpleString()
    return both.mapInArrow(_rate(order, totals, words, BACKGROUND if background is None else None), f"row {kind}, n_tokens long, target_loss double, background_loss double, score double")
