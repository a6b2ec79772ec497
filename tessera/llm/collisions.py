"""Nearest neighbours by collision counting: query-aware hashing with one random projection per function."""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.samples import first_bins
from tessera.llm.store import materialize

#: Vectors of a block, each of which has its part of the sorted projections; the blocks there are at most, so that their bounds (1 KB each) fit everywhere: beyond, blocks grow.
BLOCK, MOST_BLOCKS = 8192, 1 << 15
#: Vectors from which the quantiles are taken that cells are cut by, those of least hash, at most; every vector is indexed.
SAMPLE = 4096
#: Functions that the order of vectors goes by, and levels of each, in bits.
CELL_FUNCTIONS, CELL_BITS = 10, 6

#: A vector that more than one in so many queries have is joined by broadcast: there are no more than that.
HOT = 1000

RESULT = "query_id long, vec_id long, score double, verified long"


@dataclass(frozen=True)
class Family:
    """The functions of an index: `functions` random directions, the largest norm of all vectors, and how wide windows and how many collisions are asked for.

    Inner products become distances by one more coordinate, sqrt(most ** 2 - |x| ** 2): the nearest to (q, 0) scaled to `most` has the largest inner product with q.
    A vector at distance d is in a window of half-width h around the query's projection with probability P(|N(0, 1)| <= h / d).
    """

    most: float
    functions: int = 128
    reach: float = 1.28
    slack: float = 1.9
    grow: float = 1.6
    seed: int = 5

    @property
    def threshold(self) -> int:
        p = erf(self.reach / sqrt(2))
        return max(1, int(np.ceil(self.functions * p - self.slack * sqrt(self.functions * p * (1 - p)))))

    def directions(self, dim: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim]).normal(size=(dim + 1, self.functions))

    def shadows(self, x: np.ndarray) -> np.ndarray:
        """Projections of vectors, a row each."""
        d = self.directions(x.shape[1])
        return x @ d[:-1] + np.sqrt(np.maximum(self.most**2 - np.einsum("ij,ij->i", x, x), 0))[:, None] * d[-1]

    def query_shadows(self, q: np.ndarray) -> np.ndarray:
        return (q @ self.directions(q.shape[1])[:-1]) * (self.most / np.sqrt(np.einsum("ij,ij->i", q, q)))[:, None]

    def far(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of a vector with this inner product from each query; infinite where there is none (-inf)."""
        with np.errstate(invalid="ignore"):
            out = np.sqrt(np.maximum(2 * self.most**2 - 2 * self.most * score / np.sqrt(np.einsum("ij,ij->i", q, q)), 0))
        return np.where(np.isfinite(score), out, np.inf)


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, family: Family):
        order = np.argsort(ids, kind="stable")
        self.family, self.ids, self.x = family, ids[order], np.ascontiguousarray(x[order], dtype=np.float64)
        shadow = family.shadows(self.x)
        by = np.argsort(shadow, axis=0, kind="stable")
        self.sorted = np.take_along_axis(shadow, by, 0).T.copy()
        rank = np.empty_like(by)
        np.put_along_axis(rank, by, np.arange(len(ids))[:, None], 0)
        self.rank = rank.T.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32).copy()  # a vector is in a window if its rank is

    def bounds(self) -> np.ndarray:
        """The least and the largest projection by each function: a vector of the block is in no window beyond them."""
        return np.concatenate([self.sorted[:, 0], self.sorted[:, -1]])

    def counts(self, shadow: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Collisions of each query (its projections, a row) with each vector in windows of its half-width."""
        kind = self.rank.dtype
        out = np.zeros((shadow.shape[0], self.ids.size), np.uint8 if shadow.shape[1] < 256 else np.uint16)
        place, inside = np.empty(out.shape, kind), np.empty(out.shape, bool)
        for j in range(shadow.shape[1]):
            lo = np.searchsorted(self.sorted[j], shadow[:, j] - half, side="left")
            hi = np.searchsorted(self.sorted[j], shadow[:, j] + half, side="right")
            np.subtract(self.rank[j][None, :], lo.astype(kind)[:, None], out=place)  # below the window wraps to beyond it
            np.less(place, (hi - lo).astype(kind)[:, None], out=inside)
            np.add(out, inside, out=out, casting="unsafe")
        return out

    def search(self, q: np.ndarray, k: int, bound: np.ndarray | None = None, at_a_time: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vector id, inner product) of the k nearest found for each query, nearest first, ties to the smaller id; and how many vectors each query was verified against.

        Virtual rehashing: windows start narrow and widen, per query, until they are `reach` times as wide as the distance of the k-th nearest so far (here, or
        elsewhere with the inner product `bound`), or hold everything.  Vectors whose collisions reach the threshold are verified by their inner product, each once.
        """
        found: list[tuple] = []
        verified_of = np.zeros(len(q), np.int64)
        f, q = self.family, np.ascontiguousarray(q, dtype=np.float64)
        bound = np.full(len(q), -np.inf) if bound is None else bound
        for lo in range(0, len(q), at_a_time):
            own = slice(lo, lo + at_a_time)
            shadow, worst = f.query_shadows(q[own]), bound[own].copy()
            n = shadow.shape[0]
            verified = np.zeros((n, self.ids.size), bool)
            best_at, best = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
            limit = f.reach * f.far(q[own], worst)
            half, todo = np.minimum(f.most * 0.6, np.maximum(limit, 1e-12)), np.arange(n)
            while todo.size:
                counts = self.counts(shadow[todo], half[todo])
                for i, c in zip(todo, counts):
                    new = np.flatnonzero((c >= f.threshold) & ~verified[i])
                    if new.size:
                        verified[i, new] = True
                        score = np.einsum("ij,j->i", self.x[new], q[lo + i])
                        close = score >= worst[i]
                        at, score = np.append(best_at[i], new[close]), np.append(best[i], score[close])
                        if at.size > k:  # ids are sorted, so places break ties as ids do
                            kept = np.lexsort((at, -score))[:k]
                            at, score = at[kept], score[kept]
                        best_at[i], best[i] = at, score
                        if at.size >= k:
                            worst[i] = max(worst[i], score.min())
                limit = f.reach * f.far(q[own], worst)
                # no two points are farther than 2 most apart, and windows for 3 of 4 sigma hold all that count
                go = (half[todo] < limit[todo]) & (half[todo] <= 4 * f.most)
                todo = todo[go]
                half[todo] = np.minimum(half[todo] * f.grow, np.maximum(limit[todo], half[todo]))
            for i in range(n):
                if not np.isfinite(worst[i]) and best[i].size < min(k, self.ids.size):  # fewer than k in sight: all of a small block
                    rest = np.flatnonzero(~verified[i])
                    verified[i, rest] = True
                    best_at[i], best[i] = np.append(best_at[i], rest), np.append(best[i], np.einsum("ij,j->i", self.x[rest], q[lo + i]))
                kept = np.lexsort((best_at[i], -best[i]))[:k]
                found.append((np.full(kept.size, lo + i), self.ids[best_at[i][kept]], best[i][kept]))
                verified_of[lo + i] = verified[i].sum()
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), verified_of
        return *(np.concatenate(x) for x in zip(*found)), verified_of


def _vectors(batch) -> np.ndarray:
    lists = batch.column("vec")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _cells(x: np.ndarray, family: Family, cuts: np.ndarray) -> np.ndarray:
    """Numbers that are near for vectors near each other: levels of the first projections, bits of equal weight together."""
    shadow, out = family.shadows(x)[:, :CELL_FUNCTIONS], np.zeros(len(x), np.int64)
    levels = np.column_stack([np.searchsorted(cuts[j], shadow[:, j]) for j in range(shadow.shape[1])])
    for bit in reversed(range(CELL_BITS)):
        for j in range(levels.shape[1]):
            out = out << 1 | (levels[:, j] >> bit & 1)
    return out


def _by_dim(batch) -> list[tuple[int, pa.RecordBatch]]:
    dim = batch.column("dim").to_numpy()
    return [(int(d), batch.filter(pa.array(dim == d))) for d in np.unique(dim)]


def _place(family: Family, cuts: dict[int, np.ndarray]):
    def place(batches):
        for batch in batches:
            for dim, own in _by_dim(batch):
                cell = _cells(_vectors(own), family, cuts[dim])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell)], names=[*own.schema.names, "cell"])

    return place


def _assign(bounds: dict[int, np.ndarray]):
    """The block of each vector: how many cuts its cell is at or beyond."""

    def assign(batches):
        for batch in batches:
            for dim, own in _by_dim(batch):
                block = np.searchsorted(bounds[dim], own.column("cell").to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("id", "vec", "q", "dim")), pa.array(block.astype(np.int64))], names=["id", "vec", "q", "dim", "block"])

    return assign


#: What the first look at each block gives: its vectors, its bounds, and its own queries with their nearest here.
VECTOR, BOUNDS, QUERY, FOUND = 0, 1, 2, 3
LOOK = "kind int, block long, dim int, id long, vec array<double>, bound double, verified long, other long, score double"


def _rows(n: int, **columns) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "block": pa.int64(), "dim": pa.int32(), "id": pa.int64(), "vec": pa.list_(pa.float64()), "bound": pa.float64(), "verified": pa.int64(), "other": pa.int64(), "score": pa.float64()}
    return pa.RecordBatch.from_arrays([(pa.array(np.broadcast_to(columns[c], n), t) if not isinstance(columns[c], pa.Array) else columns[c]) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _look(k: int, family: Family):
    """Of a range of cells make blocks; each block's own queries are searched in it."""

    def look(batches):
        base, made, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def blocks(parts):
            nonlocal made
            together = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            for dim, own in _by_dim(together):
                block, ids, x, q = base + made, own.column("id").to_numpy(), _vectors(own), own.column("q").to_numpy(zero_copy_only=False)
                made += 1
                index = Index(ids, x, family)
                yield _rows(len(ids), kind=VECTOR, block=block, dim=dim, id=ids, vec=_listed(x))
                yield _rows(1, kind=BOUNDS, block=block, dim=dim, vec=_listed(index.bounds()[None]))
                if q.any():
                    asked, vec = ids[q], x[q]
                    of, other, score, verified = index.search(vec, k)
                    bound = np.full(asked.size, -np.inf)
                    full = np.flatnonzero(np.bincount(of, minlength=asked.size) >= k)
                    worst = np.full(asked.size, np.inf)
                    np.minimum.at(worst, of, score)
                    bound[full] = worst[full]
                    yield _rows(asked.size, kind=QUERY, block=block, dim=dim, id=asked, vec=_listed(vec), bound=bound, verified=verified)
                    yield _rows(of.size, kind=FOUND, block=block, dim=dim, id=asked[of], other=other, score=score)

        current = None
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "block")])
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else np.zeros(0, np.int64)
            for lo, hi in zip(cut, np.append(cut[1:], len(key))):
                if held and (tuple(key[lo]) != current or size >= 2 * BLOCK):  # more in a block, of cells that are the same, are blocks of their own
                    yield from blocks(held)
                    held, size = [], 0
                current = tuple(key[lo])
                held.append(batch.slice(lo, hi - lo))
                size += hi - lo
        if size:
            yield from blocks(held)

    return look


def _visits(family: Family, bounds: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Which other blocks a query goes to: those with as many functions in whose window some vector of theirs can lie as collisions are asked for."""

    def visits(batches):
        for batch in batches:
            for dim, own in _by_dim(batch):
                blocks, ends = bounds[dim]
                low, high = ends[:, : family.functions], ends[:, family.functions :]
                x, home, bound = _vectors(own), own.column("block").to_numpy(), own.column("bound").to_numpy()
                shadow, half = family.query_shadows(x), np.minimum(family.reach * family.far(x, bound), 8 * family.most)
                for i in range(len(x)):
                    met = ((low <= shadow[i] + half[i]) & (high >= shadow[i] - half[i])).sum(1) >= family.threshold
                    # without k neighbours at home every block is one to go to
                    to = blocks[(met | ~np.isfinite(bound[i])) & (blocks != home[i])]
                    if to.size:
                        yield _rows(to.size, kind=QUERY, block=to, dim=dim, id=own.column("id")[i].as_py(), vec=_listed(np.repeat(x[i : i + 1], to.size, 0)), bound=bound[i])

    return visits


def _meet(k: int, family: Family):
    """Queries that come to a block, one batch after another, are searched in its index."""

    def meet(batches):
        current, parts, index = None, [], None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]))) if len(block) else np.zeros(0, np.int64)
            for lo, hi in zip(cut, np.append(cut[1:], len(block))):
                own = batch.slice(lo, hi - lo)
                if block[lo] != current:
                    current, parts, index = block[lo], [], None
                if kind[lo] == VECTOR:
                    parts.append((own.column("id").to_numpy(), _vectors(own)))
                    continue
                index = index or Index(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), family)
                parts = []
                ids = own.column("id").to_numpy()
                of, other, score, verified = index.search(_vectors(own), k, own.column("bound").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(other), pa.array(score), pa.array(np.zeros(of.size, np.int64))], names=["query_id", "vec_id", "score", "verified"])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(ids.size, pa.int64()), pa.nulls(ids.size, pa.float64()), pa.array(verified)], names=["query_id", "vec_id", "score", "verified"])

    return meet


def usable(vec: Column) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, **options) -> DataFrame:
    """The k nearest by inner product of each query, a row of `vectors` for which is_query holds, among all other rows: query_id, rank, vec_id, score, and verified, the
    number of vectors that the query was compared with.

    All vectors are projected by the same functions.  1. They are cut, in the order of cells of their first projections, into blocks of about
    `block` near each other; each block has its part of the sorted arrays, and its least and largest projection by each function.  2. A query is searched in its own
    block, which says how far its k-th nearest is at most.  3. From there its windows are known in all functions, and it goes to those blocks alone of which some vector
    can collide often enough.  Vectors are never copied: queries stream through the blocks that they go to.  Vectors with structure are in few cells, so most blocks
    are passed by; where there is none, every query goes to every block, which is the work of comparing collisions throughout.

    Vectors null, empty, zero or holding null or non-finite components take no part, nor do rows without an id; vectors only meet those of their own length;
    of several rows with one id the least vector counts; ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives an empty one.
    """
    all_rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    all_rows = materialize(all_rows.groupBy("id").agg(F.min("vec").alias("vec"), F.max("q").alias("q")), "vectors")
    # vectors that are the same are one, named by the least of their ids, of which no answer needs more than the k + 1 least
    turn = F.row_number().over(Window.partitionBy("vec", "q").orderBy("id"))
    few = all_rows.withColumn("turn", turn).where(F.col("turn") <= k + 1)
    rows = few.groupBy("vec").agg(F.min("id").alias("id"), F.max("q").alias("q"), F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).withColumn("dim", F.size("vec"))
    rows = materialize(rows, "distinct")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, most = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(1.0))).first()
    family = Family(float(most), **options)
    before, last, _ = first_bins(rows.select("dim", "vec", "id", F.xxhash64("id").alias("order")), "order", SAMPLE)
    few = before.unionByName(last).orderBy("order", "id").limit(SAMPLE).toPandas()
    levels = np.arange(1, 1 << CELL_BITS) / (1 << CELL_BITS)
    cuts = {int(d): np.quantile(family.shadows(np.stack(own.vec.to_list()))[:, :CELL_FUNCTIONS], levels, axis=0).T for d, own in few.groupby("dim")}
    # lengths that the sample does not have are few; they share one cell each
    for (d,) in rows.select("dim").distinct().where(~F.col("dim").isin(list(cuts) or [-1])).collect():
        cuts[d] = np.full((min(CELL_FUNCTIONS, family.functions), levels.size), np.inf)
    placed = rows.select("id", "vec", "q", "dim").mapInArrow(_place(family, cuts), "id long, vec array<double>, q boolean, dim int, cell long")
    placed = materialize(placed, "placed")
    blocks = max(1, min(MOST_BLOCKS, -(-n // block)))
    share = F.array(*[F.lit(i / blocks) for i in range(1, blocks)]) if blocks > 1 else None
    if share is not None:
        cuts = {r[0]: np.unique(r[1]) for r in placed.groupBy("dim").agg(F.percentile_approx("cell", share, 10 * blocks)).collect()}
    else:
        cuts = dict.fromkeys(cuts, np.zeros(0, np.int64))
    in_blocks = placed.mapInArrow(_assign(cuts), "id long, vec array<double>, q boolean, dim int, block long").repartition("dim", "block").sortWithinPartitions("dim", "block")
    looked = materialize(in_blocks.mapInArrow(_look(k + 1, family), LOOK), "blocks", "kind")
    ends = looked.where(F.col("kind") == BOUNDS).select("dim", "block", "vec").toPandas()
    bounds = {int(d): (own.block.to_numpy(), np.stack(own.vec.to_list())) for d, own in ends.groupby("dim")}
    asked = looked.where(F.col("kind") == QUERY)
    found = looked.where(F.col("kind") == FOUND).select(F.col("id").alias("query_id"), F.col("other").alias("vec_id"), "score", F.lit(0).cast("long").alias("verified"))
    found = found.unionByName(asked.select(F.col("id").alias("query_id"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score"), "verified"))
    if len(ends) > 1:
        columns = ["kind", "block", "id", "vec", "bound"]
        visits = asked.select("dim", "block", "id", "vec", "bound").mapInArrow(_visits(family, bounds), LOOK)
        both = looked.where(F.col("kind") == VECTOR).select(*columns).unionByName(visits.select(*columns))
        both = both.repartition("block").sortWithinPartitions("block", "kind")
        found = found.unionByName(both.mapInArrow(_meet(k + 1, family), RESULT))
    of_query = Window.partitionBy("query_id")
    ranked = found.withColumn("verified", F.sum("verified").over(of_query)).where("vec_id is not null").withColumn("turn", F.row_number().over(of_query.orderBy(F.col("score").desc(), "vec_id"))).where(F.col("turn") <= k + 1)
    each = ranked.join(rows.select(F.col("id").alias("vec_id"), "ids"), "vec_id").select("query_id", "verified", "score", F.explode("ids").alias("of"))
    lists = each.groupBy("query_id").agg(F.max("verified").alias("verified"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "of", "score"))), 1, k + 1).alias("near"))
    lists = materialize(lists.join(rows.select(F.col("id").alias("query_id"), "vec"), "query_id").drop("query_id"), "lists")
    queries = all_rows.where("q").select("id", "vec")
    hot = materialize(queries.groupBy("vec").agg(F.count("*").alias("n")).where(F.col("n") * HOT > queries.count()).select("vec"), "hot")
    answered = queries.join(F.broadcast(lists.join(F.broadcast(hot), "vec", "left_semi")), "vec").unionByName(queries.join(F.broadcast(hot), "vec", "left_anti").join(lists, "vec"))
    answered = answered.select(F.col("id").alias("query_id"), "verified", F.slice(F.filter("near", lambda x: x["of"] != F.col("id")), 1, k).alias("near"))
    answered = answered.select("query_id", "verified", F.posexplode("near").alias("place", "x"))
    return answered.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.of").alias("vec_id"), F.col("x.score").alias("score"), "verified")
