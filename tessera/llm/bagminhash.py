"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, banding and exact verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.store import materialize
from tessera.llm.words import U64, Runs, mix, pieces, signed, split

#: Ids at and above this stand in for null ids.
STAND_IN = 1 << 62


@dataclass
class Bags:
    """Distinct shingles of each text with their multiplicity; those of text i are first[i]:first[i + 1], by hash."""

    shingle: np.ndarray
    weight: np.ndarray
    text: np.ndarray
    first: np.ndarray


def bags(texts: pa.Array, k: int = 5) -> Bags:
    """Shingles of k words; a text of fewer words is one shingle, a text without words has none."""
    w = split(texts)
    h, n = w.hashes(), w.counts()
    runs = Runs(h)
    doc = w.texts()
    at = np.flatnonzero(doc[: -(k - 1)] == doc[k - 1 :]) if k > 1 and h.size >= k else np.arange(h.size if k == 1 else 0)
    short = np.flatnonzero((n > 0) & (n < k))
    shingle = np.concatenate([runs.all(k)[at], runs.some(w.first[short], n[short])])
    text = np.concatenate([doc[at], short]) if at.size else short
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1]))) if shingle.size else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, shingle.size))
    text = text[new]
    return Bags(shingle[new], weight, text, np.searchsorted(text, np.arange(len(texts) + 1)))


def signatures(b: Bags, size: int, seed: int = 1) -> np.ndarray:
    """BagMinHash signature of each bag, a row of `size` times; infinite where a bag is empty.

    Each shingle has Poisson processes of points (time, weight level, component).  The levels form a hierarchy of intervals [0, 1), [1, 2), [2, 4), [4, 8) ..., each a process of
    its own with a rate equal to its width, so a bag only starts those that its weight reaches, and the points above its weight (in the last one) do not count.  A component
    of the signature is the time of its first point.  Two bags agree in a component with the probability of their weighted Jaccard similarity,
    sum of minima over sum of maxima.  Points after a bag's horizon, by when all components have one, change nothing, so they are not made:
    about size * log(size) points a bag, whatever its length.
    """
    docs = b.first.size - 1
    sig = np.full((docs, size), np.inf)
    if not b.shingle.size:
        return sig
    levels = 1 + np.ceil(np.log2(b.weight)).astype(np.int64)
    own = np.repeat(np.arange(b.shingle.size), levels)
    level = np.arange(own.size) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    rate = np.where(level == 0, 1.0, np.exp2(level - 1.0))
    text, weight = b.text[own], b.weight[own].astype(float)
    state = mix(b.shingle[own] ^ mix(level.astype(U64) + U64(seed << 8)))
    total = np.bincount(b.text, weights=b.weight, minlength=docs)
    horizon = size * (np.log(size) + 4) / np.maximum(total, 1)
    time, step = np.zeros(own.size), np.zeros(own.size, U64)

    def advance(i: np.ndarray) -> None:
        step[i] += U64(1)
        r = mix(state[i] + step[i] * U64(0x9E3779B97F4A7C15))
        time[i] -= np.log(((r >> U64(11)).astype(float) + 0.5) * 2.0**-53) / rate[i]

    advance(np.arange(own.size))
    flat = sig.reshape(-1)
    waiting = np.arange(own.size)
    while waiting.size:
        live = waiting[time[waiting] <= horizon[text[waiting]]]
        while live.size:
            r = mix(state[live] ^ (step[live] * U64(0xD1342543DE82EF95)))
            component = ((r >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
            y = low[live] + rate[live] * ((r & U64(0xFFFFFFFF)).astype(float) * 2.0**-32)
            counts = y < weight[live]
            np.minimum.at(flat, (text[live] * size + component)[counts], time[live][counts])
            advance(live)
            live = live[time[live] <= horizon[text[live]]]
        unfilled = np.isinf(sig).any(1)
        horizon[unfilled] *= 2
        waiting = np.flatnonzero(unfilled[text])
    return sig


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash per band, of its number and components."""
    bits = mix(np.ascontiguousarray(sig).view(U64)).reshape(sig.shape[0], bands, -1)
    out = np.tile(np.arange(1, bands + 1, dtype=U64), (sig.shape[0], 1))
    for j in range(bits.shape[2]):
        out = mix(out * U64(0x9E3779B97F4A7C15) ^ bits[:, :, j])
    return out


def similarity(a: Bags, i: int, b: Bags, j: int) -> float:
    """Weighted Jaccard similarity of two bags."""
    x, y = slice(a.first[i], a.first[i + 1]), slice(b.first[j], b.first[j + 1])
    at = np.searchsorted(b.shingle[y], a.shingle[x])
    at[at == y.stop - y.start] = 0
    both = b.shingle[y][at] == a.shingle[x] if y.stop > y.start else np.zeros(0, bool)
    least = np.minimum(a.weight[x][both], b.weight[y][at[both]]).sum() if both.any() else 0
    return float(least / max(a.weight[x].sum() + b.weight[y].sum() - least, 1))


def _emit_bands(k: int, size: int, bands: int):
    def emit(batches):
        for batch in batches:
            for lo, part in pieces(batch.column("text")):
                b = bags(part, k)
                sig = signatures(b, size)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * bands, pa.int32()), pa.array(signed(band_hashes(sig, bands).reshape(-1))))
                keys = [batch.column(c).slice(lo, len(part)) for c in ("did", "id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*keys, lists, pa.array(np.diff(b.first) == 0)], names=["did", "id", "k1", "k2", "bands", "blank"])

    return emit


def _emit_sketches(k: int, size: int):
    """A second, longer signature, of which 16 bits a component are kept: what estimates need."""

    def emit(batches):
        for batch in batches:
            for lo, part in pieces(batch.column("text")):
                short = (mix(signatures(bags(part, k), size, seed=2).view(U64)) >> U64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, len(part)), pa.array([row.tobytes() for row in short], pa.binary())], names=["node", "sketch"])

    return emit


def _emit_finer(size: int):
    """Keys of runs of FINER components of a node's sketch: nodes that are alike have some in common, nodes that merely share a passage hardly any."""

    def emit(batches):
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                own = batch.slice(lo, 4096)
                sketch = np.frombuffer(b"".join(own.column("sketch").to_pylist()), np.uint16).reshape(len(own), size)[:, : FINER_KEYS * FINER].reshape(len(own), FINER_KEYS, FINER).astype(U64)
                out = np.tile(np.arange(1, FINER_KEYS + 1, dtype=U64), (len(own), 1))
                for j in range(FINER):
                    out = mix(out * U64(0x9E3779B97F4A7C15) ^ sketch[:, :, j])
                n = out.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(signed(out.reshape(-1))), *(own.column(c).take(pa.array(np.repeat(np.arange(len(own)), n))) for c in ("node", "component"))], names=["band", "node", "component"])

    return emit


def _estimate(least: float, size: int, sure: float):
    """Of each group (band, block, turn), whose strays come first, the pairs of strays and members of other components that may be similar enough."""
    # a pair at `least` shows fewer equal components as rarely as a normal variable is `sure` deviations off; without a limit every pair is enough
    enough = int(np.floor(size * least - sure * np.sqrt(size * least * (1 - least)))) if np.isfinite(sure) else 0
    key_columns = ("band", "block", "turn")

    def pairs_of(strays: list, node: np.ndarray, component: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch | None:
        own, own_component, own_sketch = (np.concatenate(x) for x in zip(*strays))
        found = []
        for i in range(own.size):
            equal = (sketch == own_sketch[i]).sum(1)
            at = np.flatnonzero((equal >= enough) & (component != own_component[i]))
            if at.size:
                found.append((np.minimum(node[at], own[i]), np.maximum(node[at], own[i])))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    def estimate(batches):
        current, strays = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key_columns, "member")])
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.zeros(0, np.int64)
            for lo, hi in zip(cut, np.append(cut[1:], len(keys))):
                if current != tuple(keys[lo, :3]):
                    current, strays = tuple(keys[lo, :3]), []
                part = batch.slice(lo, hi - lo)
                node, component = (part.column(c).to_numpy() for c in ("node", "component"))
                sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, size)
                if not keys[lo, 3]:
                    strays.append((node, component, sketch))
                elif strays and (out := pairs_of(strays, node, component, sketch)) is not None:
                    yield out

    return estimate


def _verify(k: int, least: float):
    def verify(batches):
        for batch in batches:
            for lo, right in pieces(batch.column("text_b"), 1 << 20):
                a, b = (batch.column(c).slice(lo, len(right)).to_numpy() for c in ("a", "b"))
                left = batch.column("text_a").slice(lo, len(right))
                new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))  # a pivot's rows mostly come together
                which = np.repeat(np.arange(new.size), np.diff(np.append(new, a.size)))
                x, y = bags(left.take(pa.array(new)), k), bags(right, k)
                close = np.array([similarity(x, which[i], y, i) >= least for i in range(a.size)])
                yield pa.RecordBatch.from_arrays([pa.array(a[close]), pa.array(b[close])], names=["a", "b"])

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough."""
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, least), "a long, b long")


def _mapped(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


#: Strays and members of a bucket that are compared at a time, and components of the signatures by which they are; finer keys, and components of each.
BLOCK, SKETCH, FINER_KEYS, FINER = 1024, 2048, 128, 8


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """did, id, k1, k2 (the text's hash) and `text` of each row: did is the id, for null ids a stand-in from the text."""
    text = docs[text_col].cast("string")
    k1, k2, real = F.xxhash64(text), F.xxhash64(F.lit(1), text), docs[id_col].cast("long")
    return docs.select(F.coalesce(real, F.lit(STAND_IN) + k1.bitwiseAND(STAND_IN - 1)).alias("did"), real.alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"), *more)


def _shared_ids(rows: DataFrame) -> DataFrame | None:
    """Ids of several texts, with the least text's hash; None if there is none."""
    one = F.struct("k1", "k2")
    several = materialize(rows.groupBy("did").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low <> high").select("did", "low"), "ids")
    return None if several.isEmpty() else several


def _told_apart(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """Rows whose did names one text: of several texts with one id all but one get a stand-in."""
    if several is None:
        return rows
    other = F.col("low").isNotNull() & (F.struct("k1", "k2") != F.col("low"))
    named = F.when(other, F.lit(STAND_IN) + F.xxhash64("did", "k1", "k2").bitwiseAND(STAND_IN - 1)).otherwise(F.col("did"))
    return rows.join(several, "did", "left").withColumn("did", named).drop("low")


def _compared(us: DataFrame, them: DataFrame, sketches: DataFrame, least: float, sure: float) -> DataFrame:
    """Pairs (a, b) of strays (us) and members (them) of one group that may be similar enough."""
    groups = us.withColumn("member", F.lit(0)).unionByName(them.withColumn("member", F.lit(1))).join(sketches, "node")
    groups = groups.repartition("band", "block", "turn").sortWithinPartitions("band", "block", "turn", "member")
    return groups.select("band", "block", "turn", "member", "node", "component", "sketch").mapInArrow(_estimate(least, SKETCH, sure), "a long, b long")


def _dealt(members: DataFrame, strays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strays and members (band, node, component, size, n_strays) in groups that hold each stray against each member of its band: blocks of members, turns of strays."""
    blocks, turns = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("n_strays") / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), n).cast("int")
    us = strays.select("band", every(blocks).alias("block"), own(turns, 2).alias("turn"), "node", "component")
    return us, members.select("band", own(blocks, 1).alias("block"), every(turns).alias("turn"), "node", "component")


def near_nodes(docs: DataFrame, least: float = 0.8, k: int = 5, size: int = 192, bands: int = 32, sure: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of each document: (`did`, `id`, `class`), documents linked, directly or through others, by a weighted Jaccard similarity of k-word shingles of `least` or more.

    1. Equal texts are one node, named by its least id.  2. Nodes that share a band of their signatures (`bands` of size / bands components) meet in a
    bucket.  A pair at 0.8 is missed by all 32 bands of 6 with a probability of 6e-5.  3. In each bucket one node, the pivot, is compared with the others: one pair
    per member, not all pairs.  The pivot is the node that meets most others in all its buckets, so the common origin of many copies, where there is one.
    4. Members outside the pivot's component are strays.  Where a bucket has more than BLOCK, another pivot is taken among them, as long as that links an eighth of them.
    5. Strays are held against all members of other components by signatures of SKETCH components; those that may be similar enough then by text.  A link at exactly 0.8 is
    passed over if its signature is `sure` deviations off (5: 3e-7; math.inf compares all texts).  Buckets that still have more than BLOCK strays are mostly of unlike
    documents that share a passage: their members meet anew by the finer keys of their sketches (128 of 8 components: a pair at 0.8 is missed with 6e-11), so rows
    grow with the members; what even then comes together by thousands is alike, and compared in blocks.  6. Components name the classes by their least id.

    A document is an id with a text: rows that repeat both are one; different texts with one id are different documents.  Null or wordless texts are classes of their own; so is a text
    without a neighbour.  Texts of fewer than k words are one shingle; very long ones are whole.  Null ids have a hash of the text in their place
    (STAND_IN or more), as have all but one of several texts with one id; an empty table gives an empty one.
    """
    src = _rows(docs, id_col, text_col)
    signed_docs = materialize(src.mapInArrow(_emit_bands(k, size, bands), "did long, id long, k1 long, k2 long, bands array<long>, blank boolean"), "bands")
    several = _shared_ids(signed_docs)
    signed_docs, src = _told_apart(signed_docs, several), _told_apart(src, several)
    full = signed_docs.where("not blank")
    copies = materialize(full.groupBy("k1", "k2").agg(F.min("did").alias("node")), "copies")
    owners = materialize(signed_docs.drop("bands").join(copies, ["k1", "k2"], "left").select("did", "id", F.coalesce("node", "did").alias("node")).distinct(), "owners")
    names = copies.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "node")
    own = full.join(names, (F.col("did") == F.col("node")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    rows = materialize(own.select("node", F.explode("bands").alias("band")).distinct(), "buckets")
    shared = materialize(rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low < high").select("band", "size"), "shared")
    members = materialize(rows.join(shared, "band"), "members")
    meets = materialize(members.groupBy("node").agg(F.sum("size").alias("meets")), "meets")
    best = F.max(F.struct("meets", (-F.col("node")).alias("node")))
    pivots = materialize(members.join(meets, "node").groupBy("band").agg(best.alias("best")).select("band", (-F.col("best.node")).alias("pivot")), "pivots")
    texts = materialize(src.select("did", "text").join(meets.select(F.col("node").alias("did")), "did", "left_semi").select(F.col("did").alias("node"), "text").distinct(), "texts")

    pairs = members.join(pivots, "band").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = materialize(_verified(pairs, texts, k, least), "links")
    before = None
    while True:
        comps = materialize(components(links), "components")
        homes = _mapped(pivots.select("band", F.col("pivot").alias("node")), comps).select("band", F.col("component").alias("home"))
        held = materialize(_mapped(members, comps).join(homes, "band"), "held")
        strays = materialize(held.where("component <> home").select("band", "node", "component"), "strays")
        counts = materialize(strays.groupBy("band").agg(F.count("*").alias("n_strays")), "counts")
        wide = counts.where(F.col("n_strays") > BLOCK)
        now = wide.agg(F.coalesce(F.sum("n_strays"), F.lit(0))).first()[0]
        if not now or (before is not None and now > before * 7 / 8):
            break
        # among many strays another pivot, which is held against all that are not in its component
        before = now
        again = strays.join(wide, "band").join(meets, "node").groupBy("band").agg(best.alias("best")).select("band", (-F.col("best.node")).alias("pivot"))
        again = materialize(_mapped(again.withColumnRenamed("pivot", "node"), comps).select("band", F.col("node").alias("pivot"), F.col("component").alias("its")), "again")
        pairs = held.join(again, "band").where("component <> its").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        links = links.unionByName(materialize(_verified(pairs, texts, k, least), "links"))
    if not counts.isEmpty():
        wanted = held.join(counts, "band", "left_semi").select("node").distinct()
        sketches = materialize(texts.join(wanted, "node", "left_semi").mapInArrow(_emit_sketches(k, SKETCH), "node long, sketch binary"), "sketches")
        narrow = shared.join(counts.where(F.col("n_strays") <= BLOCK), "band")
        close = _compared(*_dealt(held.drop("size").join(narrow, "band"), strays.join(narrow, "band")), sketches, least, sure)
        if now:
            nodes = held.join(wide, "band", "left_semi").select("node", "component").distinct()
            finer = materialize(nodes.join(sketches, "node").mapInArrow(_emit_finer(SKETCH), "band long, node long, component long"), "finer")
            met = finer.groupBy("band").agg(F.min("component").alias("home"), F.max("component").alias("high"), F.count("*").alias("size"))
            met = finer.join(met.where("home < high").drop("high"), "band")
            met = materialize(met, "met")
            n_strays = materialize(met.where("component <> home").groupBy("band").agg(F.count("*").alias("n_strays")), "counts")
            met = met.join(n_strays, "band")
            close = close.unionByName(_compared(*_dealt(met, met.where("component <> home")), sketches, least, sure))
        links = links.unionByName(materialize(_verified(materialize(close.distinct(), "close"), texts, k, least), "links"))
        comps = materialize(components(links), "components")
    return owners.join(comps, "node", "left").groupBy("did", "id").agg(F.min(F.coalesce("component", "node")).alias("class"))


def near_classes(docs: DataFrame, **how) -> DataFrame:
    """near_nodes(...) as (`doc_id`, `class_id`), a row per document; class_id is the least id that
    names a document of the class alone (of several texts with one id, one has it), else the least id of the class, null where none of its documents has one."""
    named = near_nodes(docs, **how)
    plain = F.col("class") < STAND_IN
    least = named.where(~plain).groupBy(F.col("class").alias("of")).agg(F.min("id").alias("class_id"))
    rest = named.where(~plain).join(least, F.col("class") == F.col("of")).select(F.col("id").alias("doc_id"), "class_id")
    return named.where(plain).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id")).unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input's rows and columns, one document of each class: the one that names it, with the least id.

    Of rows that repeat id and text (null ids count as one id) one stays; of a class in which some have ids and some have none, one with an id.  Different texts with one
    id are different documents.  Wordless texts are classes of their own, so they stay.
    """
    named = near_nodes(docs, id_col=id_col, text_col=text_col, **how).where("did = class").select(F.col("did").alias("own"))
    rows = _rows(docs, id_col, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = _told_apart(rows.drop("text"), _shared_ids(rows.select("did", "k1", "k2")))
    kept = rows.join(named, F.col("did") == F.col("own"), "left_semi")
    first = Window.partitionBy("did").orderBy(F.xxhash64("row"))
    return kept.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("row.*")
