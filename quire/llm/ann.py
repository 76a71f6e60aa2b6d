"""Nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed in several tables, each by rounded Gaussian projections. A query probes its own bucket
and perturbed ones in the order of their estimated success: the template of perturbations is made once from expected distances
to the cell borders, and every query applies it to its own order of borders. The candidates of all tables are merged
and ranked by the exact cosine in double precision.

Vectors cross the network once: they are dealt to blocks by a hash of theirs, and each block keeps the tables of its own vectors, as sorted
keys and places. The stated queries are read by every block, one run after the other, probe its tables there, and give their
nearest of the block. So no bucket, however many vectors it holds, is gathered in one task; no candidate leaves its block; and
a task holds a block of at most ``BLOCK_BYTES`` of vectors, not the queries. Equal vectors are one entry with their smallest ids, as many as a result can
need, already before they are sent, so a vector that many rows hold is sent, hashed and compared a few times.

How many projections and probes: for a bounded sample of the queries one exact pass finds the true neighbours. Of
all numbers that reach ``REACH`` of these with 95 % confidence, those are taken that cost the fewest comparisons and probes, as measured on the
sample; so the recall is alike at every size. With too few queries to tell, nearly everything is compared. Queries that
find fewer than k others are searched exactly, block by block.

Rows whose vector is null, zero or holds a null, NaN or infinity take no part, nor do rows without an
id. Of rows with the same id and vector each counts once; an id with several vectors has the nearest of them. Vectors must be of one length (the commonest), others
take no part. Ties go to the smaller id, also between proportional vectors. An empty table, or one without queries, gives no rows; with fewer
than k others a query has them all. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import cut, mix64, quoted, small_batches

#: ``PROBES``: the most of each table.
TABLES, PROBES, WIDTH, SEED = 24, 1200, 2.0, 20240521
#: Vectors to a block in a small table; beyond ``BLOCKS`` of them the blocks grow, up to their most bytes.
SLAB_ROWS, BLOCKS, BLOCK_BYTES = 16_384, 64, 96 << 20
#: The share of a sample's true neighbours that the probes must reach; the queries of that sample, and of those the ones that,
#: with so many vectors, tell what the probes cost.
REACH, SAMPLE, SHARE_QUERIES, SHARE_ROWS = 0.95, 200, 50, 4000


def perturbations(m: int, most: int) -> np.ndarray:
    """Which of the 2m borders, nearest first, a probe crosses: sets in order of their expected squared distance, the empty one first."""
    j = np.arange(1, 2 * m + 1)
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))).tolist()
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        # The two borders of one projection are places j and 2m + 1 - j; a set can't cross both.
        if len({min(i, 2 * m - 1 - i) for i in chosen}) == len(chosen):
            out.append(chosen)
        if (last := chosen[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    made = np.zeros((len(out), 2 * m))
    for row, chosen in zip(made, out):
        row[list(chosen)] = 1
    return made


class Hashes:
    """The tables' projections, the same wherever they are made."""

    def __init__(self, dim: int, m: int, tables: int, probes: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.m, self.tables, self.width = m, tables, width
        self.a = rng.standard_normal((tables, dim, m))
        self.b = rng.random((tables, m)) * width
        # A bucket's key is a sum over its cells, so a probe's differs by what it crosses.
        self.parts = rng.integers(0, 1 << 63, (tables, m), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.start = rng.integers(0, 1 << 63, tables, dtype=np.uint64)
        template = perturbations(m, probes)
        most = int(template.sum(axis=1).max())
        # Of each probe the places it crosses, filled up with a place that adds nothing.
        self.crossed = np.full((len(template), max(most, 1)), 2 * m)
        for row, chosen in zip(self.crossed, template):
            row[: int(chosen.sum())] = np.flatnonzero(chosen)

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.a[table] + self.b[table]) / self.width

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        return (cells.astype(np.int64).view(np.uint64) * self.parts[table]).sum(axis=-1, dtype=np.uint64) + self.start[table]

    def probes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The keys of each vector's probes, likeliest first."""
        at = self.places(unit, table)
        cell = np.floor(at)
        order = np.argsort(np.concatenate([at - cell, cell + 1 - at], axis=1), axis=1, kind="stable")
        step = np.concatenate([np.uint64(0) - self.parts[table], self.parts[table]])
        steps = np.concatenate([step[order], np.zeros((len(unit), 1), dtype=np.uint64)], axis=1)
        return self.keys(cell, table)[:, None] + steps[:, self.crossed].sum(axis=2, dtype=np.uint64)


def _ranks(h: Hashes, q: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each vector of ``q`` and each of its rows of ``near`` the first probe of any table that reaches it, or infinity."""
    best = np.full(near.shape[:2], np.inf)
    for t in range(h.tables):
        keys = h.keys(np.floor(h.places(near, t)), t)
        for lo in range(0, len(q), 32):
            met = h.probes(q[lo : lo + 32], t)[:, None, :] == keys[lo : lo + 32, :, None]
            best[lo : lo + 32] = np.minimum(best[lo : lo + 32], np.where(met.any(axis=2), met.argmax(axis=2), np.inf))
    return best


def _share(h: Hashes, q: np.ndarray, some: np.ndarray) -> float:
    """The share of the rows ``some`` that the probes of a vector of ``q`` reach."""
    met = np.zeros((len(q), len(some)), dtype=bool)
    for t in range(h.tables):
        keys, back = np.unique(h.keys(np.floor(h.places(some, t)), t), return_inverse=True)
        probes = h.probes(q, t)
        at = np.minimum(np.searchsorted(keys, probes.ravel()), len(keys) - 1).reshape(probes.shape)
        bucket = np.zeros((len(q), len(keys)), dtype=bool)
        i, j = np.nonzero(keys[at] == probes)
        bucket[i, at[i, j]] = True
        met |= bucket[:, back]
    return float(met.mean())


def _stacked(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs by how many neighbours they have, each as (vectors, their neighbours)."""
    by: dict[int, list] = {}
    for q, near in pairs:
        by.setdefault(len(near), []).append((q, near))
    return [(np.stack([q for q, _ in some]), np.stack([n for _, n in some])) for some in by.values()]


def _all_ranks(h: Hashes, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0), *[_ranks(h, q, near).ravel() for q, near in _stacked(pairs)]]))


def reached(h: Hashes, pairs: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The share of (query, its neighbours as rows), all of them unit vectors, that some table's probes reach."""
    return float(np.isfinite(_all_ranks(h, pairs)).mean()) if pairs else 1.0


def projections(dim: int, count: int, pairs: list[tuple[np.ndarray, np.ndarray]], tables: int, probes: int, width: float, seed: int) -> int:
    """As many as the logarithm of the number of vectors gives, or the most below that with which the probes reach enough of ``pairs``."""
    m = min(40, max(1, round(math.log2(max(count, 2)))))
    while m > 1 and reached(Hashes(dim, m, tables, probes, width, seed), pairs) < REACH:
        m -= 1
    return m


def hits_needed(n: int) -> int:
    """Of n pairs so many must be reached that the share is ``REACH`` with 95 % confidence (Wilson's lower bound); more than n if n is too few."""
    z = 1.645
    for hit in range(n + 1):
        p = hit / max(n, 1)
        if (p + z * z / (2 * max(n, 1)) - z * math.sqrt(p * (1 - p) / max(n, 1) + z * z / (4 * max(n, 1) ** 2))) / (1 + z * z / max(n, 1)) >= REACH:
            return hit
    return n + 1


def tuned(dim: int, count: int, blocks: int, pairs: list[tuple[np.ndarray, np.ndarray]], some: np.ndarray, tables: int, probes: int, width: float, seed: int) -> tuple[int, int, float]:
    """(projections, probes of each table, share of ``some`` vectors that these reach): of those that reach enough of ``pairs`` the cheapest, a probe
    counted like a comparison. Without enough pairs to tell, one projection and all probes, which reach nearly everything."""
    need = hits_needed(sum(len(near) for _, near in pairs))
    best = (math.inf, 1, probes, 1.0)
    if not pairs or need > sum(len(near) for _, near in pairs):
        return best[1:]
    few = np.stack([q for q, _ in pairs[:SHARE_QUERIES]])
    for m in range(projections(dim, count, pairs, tables, probes, width, seed), 0, -1):
        ranks = _all_ranks(Hashes(dim, m, tables, probes, width, seed), pairs)
        last = ranks[need - 1] if need else 0.0
        if np.isfinite(last):
            asked = int(last) + 1
            share = _share(Hashes(dim, m, tables, asked, width, seed), few, some)
            cost = share * count + tables * asked * blocks
            if cost < best[0]:
                best = cost, m, asked, share
            elif cost > 1.2 * best[0]:
                break  # ever fewer projections only make larger buckets
    return best[1:]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row with ``q``, summed in the same order wherever it is computed."""
    return (x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((q * q).sum())


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim) + flat.type.to_pandas_dtype()(0)  # no negative zeros


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _hashes(x: np.ndarray) -> np.ndarray:
    """Equal vectors have equal hashes."""
    bits = np.ascontiguousarray(x).view(np.uint32 if x.dtype == np.float32 else np.uint64).astype(np.uint64)
    out = np.zeros(len(x), dtype=np.uint64)
    for i in range(x.shape[1]):
        out = mix64(out ^ bits[:, i])
    return out


def _combined(x: np.ndarray, ids: pa.Array, most: int) -> tuple[np.ndarray, list[list], np.ndarray]:
    """Each distinct vector once, its smallest distinct ids, and its hash; ``ids`` are lists."""
    h = _hashes(x)
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(x), dtype=bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (x[order][1:] == x[order][:-1]).all(axis=1)
    first = np.flatnonzero(~same)
    lists = ids.take(pa.array(order)).to_pylist()
    ends = [*first[1:].tolist(), len(x)]
    merged = [sorted({i for given in lists[a:b] for i in given})[:most] if b - a > 1 else lists[a] for a, b in zip(first.tolist(), ends)]
    return x[order][first], merged, h[order][first]


class Block:
    """The vectors of one block and their tables: all keys in order, and whose they are."""

    def __init__(self, x: np.ndarray, ids: pa.Array, k: int, hashes: Hashes) -> None:
        self.x, lists, _ = _combined(x, ids, k + 1)
        self.ids, self.k, self.hashes = lists, k, hashes
        self.scale = np.empty(len(self.x), dtype=np.float32)
        keys = np.empty((hashes.tables, len(self.x)), dtype=np.uint64)
        for at in range(0, len(self.x), 1 << 14):
            part = self.x[at : at + (1 << 14)].astype(np.float64)
            unit = _unit(part)
            self.scale[at : at + len(part)] = (unit / np.where(part == 0, 1, part)).max(axis=1)
            for t in range(hashes.tables):
                keys[t, at : at + len(part)] = hashes.keys(np.floor(hashes.places(unit, t)), t)
        self.owner = np.empty(keys.size, dtype=np.int32)
        self.tables = []  # of each its distinct keys, and where their owners begin and end
        for t, key in enumerate(keys):
            order = np.argsort(key, kind="stable")
            self.owner[t * len(key) : (t + 1) * len(key)] = order
            new = np.append(True, key[order][1:] != key[order][:-1])
            self.tables.append((key[order][new], np.append(np.flatnonzero(new), len(key)) + t * len(key)))
        self.mark = np.zeros(len(self.x), dtype=bool)

    def probed(self, unit: np.ndarray) -> list[np.ndarray]:
        """The places that the probes of each vector reach, each once."""
        of, lo, n = [], [], []
        for t, (keys, start) in enumerate(self.tables):
            probes = self.hashes.probes(unit, t)
            at = np.minimum(np.searchsorted(keys, probes.ravel()), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == probes.ravel())
            of.append(hit // probes.shape[1])
            lo.append(start[at[hit]])
            n.append(start[at[hit] + 1] - lo[-1])
        of, lo, n = np.concatenate(of), np.concatenate(lo), np.concatenate(n)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(unit) + 1))
        out = []
        for a, b in zip(cuts, cuts[1:]):
            begin, size = lo[order[a:b]], n[order[a:b]]
            run = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            self.mark[self.owner[run]] = True
            out.append(np.flatnonzero(self.mark))
            self.mark[out[-1]] = False
        return out

    def nearest(self, q, vector: np.ndarray, unit: np.ndarray, at: np.ndarray | None) -> list[tuple[float, object]]:
        """(-score, id) of the nearest others to the query of that id, among the given places or all."""
        x, scale = (self.x, self.scale) if at is None else (self.x[at], self.scale[at])
        rough = (x @ unit.astype(x.dtype)) * scale
        if len(rough) > self.k + 1:  # all that may be among the first, by a measure that may differ in the last digits
            among = np.flatnonzero(rough >= np.partition(rough, len(rough) - self.k - 1)[len(rough) - self.k - 1] - 2e-5)
        else:
            among = np.arange(len(rough))
        score = cosines(x[among].astype(np.float64), vector).tolist()
        places = (among if at is None else at[among]).tolist()
        best: dict = {}
        for s, a in zip(score, places):
            for i in self.ids[a]:
                if i != q and s > best.get(i, -math.inf):
                    best[i] = s
        return sorted((-s, i) for i, s in best.items())[: self.k]


def nearest(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found of each row for which ``is_query(id column)`` holds."""
    spark = rows.sparkSession
    small_batches(spark)
    id_type = rows.schema[id_col].dataType
    narrow = rows.schema[vector_col].dataType == T.ArrayType(T.FloatType()) or rows.schema[vector_col].dataType == T.ArrayType(T.FloatType(), False)
    vector = F.col(quoted(vector_col)).cast(f"array<{'float' if narrow else 'double'}>")
    usable = rows.select(F.col(quoted(id_col)).alias("id"), vector.alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    )
    dims = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()
    if dims is None:
        return spark.createDataFrame([], f"query_id {id_type.simpleString()}, rank int, {quoted(id_col)} {id_type.simpleString()}, score double")
    dim, count = dims["dim"], dims["count"]
    usable = usable.where(F.size("v") == dim)
    # Each block holds what fits, or a share of a smaller table.
    most_rows = max(1, BLOCK_BYTES // (dim * (4 if narrow else 8)))
    blocks = max(1, math.ceil(count / min(most_rows, max(SLAB_ROWS, math.ceil(count / BLOCKS)))))
    queries = cut(usable.where(is_query(F.col("id"))).distinct())

    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    unit_sample = _unit(np.array([r["v"] for r in sample]).reshape(-1, dim)) if sample else np.zeros((0, dim))
    pairs = _true_pairs(usable, unit_sample, k, dim) if len(sample) else []
    some = np.array([r["v"] for r in usable.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SHARE_ROWS).select("v").collect()]).reshape(-1, dim)
    m, asked, _ = tuned(dim, count, blocks, pairs, np.unique(_unit(some), axis=0), tables, probes, width, seed)

    entry = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("kind", T.ByteType()), T.StructField("q", id_type), T.StructField("v", usable.schema["v"].dataType), T.StructField("ids", T.ArrayType(id_type))])
    arrow_id = to_arrow_schema(T.StructType([T.StructField("q", id_type)])).field(0).type

    def deal(batches):
        """Each distinct vector of a batch once, with its smallest ids."""
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch.column(0)
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(given) + 1, dtype=np.int32)), given)
            x, ids, h = _combined(_matrix(batch.column(1), dim), one, k + 1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(blocks)).astype(np.int32)), pa.array(np.zeros(len(x), dtype=np.int8)), pa.nulls(len(x), arrow_id), flat, pa.array(ids, pa.list_(arrow_id))], names=entry.names)

    def search(batches):
        """The vectors of each block are gathered, then the queries pass by."""
        hashes = Hashes(dim, m, tables, asked, width, seed)
        block = now = None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at, kind = (batch.column(i).to_numpy() for i in (0, 1))
            state = at.astype(np.int64) * 4 + kind
            edges = [0, *(np.flatnonzero(state[1:] != state[:-1]) + 1).tolist(), len(state)]
            for lo, hi in zip(edges, edges[1:]):
                part, of = batch.slice(lo, hi - lo), int(at[lo])
                if of != now:
                    block, now, held = None, of, []
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if block is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held)
                    block, held = Block(_matrix(table.column("v"), dim), table.column("ids").combine_chunks(), k, hashes), []
                yield from _found(block, part, dim, arrow_id, kind[lo] == 2)

    found_type = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def searched(asking: DataFrame, kind: int) -> DataFrame:
        entries = usable.mapInArrow(deal, entry)
        everywhere = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(kind).cast("byte").alias("kind"), F.col("id").alias("q"), "v", F.lit(None).cast(entry["ids"].dataType).alias("ids"))
        return entries.unionByName(everywhere).repartitionById(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(search, found_type)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def first(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    result = cut(first(searched(queries, 1)))
    short = queries.join(result.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if not (short := cut(short)).isEmpty():
        result = first(result.drop("rank").unionByName(searched(short, 2)))
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _found(block: Block, asked: pa.RecordBatch, dim: int, id_type: pa.DataType, whole: bool):
    """The nearest of the block to each query, which ``whole`` compares with all of it."""
    vectors = _matrix(asked.column(3), dim)
    q, unit = asked.column(2).to_pylist(), _unit(vectors)
    for lo in range(0, len(q), 64):
        some = slice(lo, lo + 64)
        places = [None] * len(q[some]) if whole else block.probed(unit[some])
        rows = [(i, j, -s) for i, v, u, at in zip(q[some], vectors[some], unit[some], places) if at is None or len(at) for s, j in block.nearest(i, v.astype(np.float64), u, at)]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], id_type), pa.array(cols[2], pa.float64())], names=["query_id", "id", "score"])


def _true_pairs(usable: DataFrame, sample: np.ndarray, k: int, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(unit vector of the sample, its k nearest of all that don't point where it does, as unit rows)."""

    def closest(batches):
        """Of each task the nearest to each vector of the sample."""
        score, near = np.full((len(sample), 0), -2.0), np.zeros((len(sample), 0, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(0), dim))
            rough = sample @ x.T
            rough[rough > 1 - 1e-9] = -2
            most = min(k, len(x))
            at = np.argpartition(-rough, most - 1, axis=1)[:, :most]
            score, near = np.concatenate([score, np.take_along_axis(rough, at, 1)], 1), np.concatenate([near, x[at]], 1)
            at = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, near = np.take_along_axis(score, at, 1), np.take_along_axis(near, at[:, :, None], 1)
        if (n := score.shape[1]):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sample) * n + 1, dtype=np.int32) * dim), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sample), dtype=np.int32), n)), pa.array(score.ravel()), flat], names=["i", "score", "u"])

    nearest_k = Window.partitionBy("i").orderBy(F.desc("score"))
    near = usable.select("v").mapInArrow(closest, "i int, score double, u array<double>").where("score > -2").withColumn("n", F.row_number().over(nearest_k)).where(F.col("n") <= k)
    true: dict[int, list] = {}
    for r in near.collect():  # k rows for each of the sample
        true.setdefault(r["i"], []).append(r["u"])
    return [(sample[i], np.array(u)) for i, u in sorted(true.items())]
