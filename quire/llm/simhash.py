"""SimHash near-duplicates: fingerprints that differ in few bits, found with one Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, over the whole table, and cut into chunks. Neighbours in that order share bits; a tree
over the chunks, and below it one over the fingerprints of each, keeps at every node the bits on which all below it agree.
Two trees are walked together from their tops: a pair of nodes carries the differences counted so far, adds those in
the bits that only now are known on both sides, and is dropped, with all below it, when they exceed the limit. The tree of chunks,
three numbers for each, is sent to all tasks; a fingerprint is copied to each later chunk that it doesn't exclude.

A chunk holds its own fingerprints, and those copied to it pass by in runs. It gives links that join what all its pairs within the
limit would join, as stars: fewer than it was given fingerprints, and two for each pair of a copied one and a group. There is
no other search, however few fingerprints there are. Components come from alternating star contractions of the links, which only pass on minima.

Null texts count as empty; empty texts, with fingerprint zero, link like any other. Rows with a null id get a
component if a row with an id is within reach, else null. Rows that share an id are linked by their texts
only. Very long texts are hashed shingle by shingle with a few bytes for each; repeated rows are one fingerprint. An empty table has no
rows in the result. Other columns are ignored, whatever their names. All rows get a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, flat, forget, map_text, quoted

#: Fingerprints to a chunk, unless there would be more than ``MANY`` chunks.
CHUNK, MANY = 1 << 17, 4096
#: Fingerprints to a leaf; pairs of nodes, and of leaves, at a time.
LEAF, PAIRS, LEAF_PAIRS = 16, 1 << 18, 1024
#: A fingerprint that more than this share of all rows has is labelled by broadcast.
HOT_SHARE = 1000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LIMIT = 2


def fingerprint(text: str) -> int:
    """Of the 3-word shingles, repeats included; signed, as Spark's 64-bit integers are."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < 4:
        h = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, ends, at = b" ".join(words), [], 0
        starts = []
        for w in words:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[s:e], 42) for s, e in zip(starts, ends[2:])]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.array(h[i : i + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h))
    return int(bits.view(">i8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Tree:
    """A binary hierarchy over leaves in Gray order. Level 0 are the leaves; of every node are known the bits on which all below it agree, and their pattern."""

    def __init__(self, known: np.ndarray, bits: np.ndarray) -> None:
        self.known, self.bits = [known], [bits & known]
        while len(known) > 1:
            if len(known) % 2:
                known, bits = np.append(known, known[-1]), np.append(bits, bits[-1])
            known, bits = known[::2] & known[1::2] & ~(bits[::2] ^ bits[1::2]), bits[::2]
            self.known.append(known)
            self.bits.append(bits & known)

    @property
    def top(self) -> int:
        return len(self.known) - 1


class GrayIndex(Tree):
    """The tree over distinct fingerprints, ``LEAF`` of them to a leaf; the last one fills up the last leaf."""

    def __init__(self, prints: np.ndarray) -> None:
        prints = prints[np.argsort(gray_rank(prints), kind="stable")]
        self.count = len(prints)
        self.leaves = np.append(prints, np.full(-len(prints) % LEAF, prints[-1])).reshape(-1, LEAF)
        self.prints = self.leaves.ravel()
        every = np.bitwise_and.reduce(self.leaves, axis=1)
        super().__init__(~(every ^ np.bitwise_or.reduce(self.leaves, axis=1)), every)


def meetings(x: Tree, y: Tree, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves whose known bits differ in at most ``limit``, in runs; of a tree with itself each pair once, the lower leaf first."""
    zero = np.zeros(1, dtype=np.int64)
    todo = [(x.top, y.top, zero, zero, np.zeros(1, dtype=np.uint8), np.zeros(1, dtype=np.uint64))]
    while todo:
        i, j, a, b, differ, seen = todo.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            todo += [(i, j, a[:half], b[:half], differ[:half], seen[:half]), (i, j, a[half:], b[half:], differ[half:], seen[half:])]
            continue
        both = x.known[i][a] & y.known[j][b]
        differ = differ + np.bitwise_count((x.bits[i][a] ^ y.bits[j][b]) & both & ~seen)
        stay = np.flatnonzero(differ <= limit)
        a, b, differ, seen = a[stay], b[stay], differ[stay], both[stay]
        if not len(a):
            continue
        if i == 0 == j:
            yield a, b
            continue
        down = (i >= j, j >= i)  # the higher tree goes down, or both
        c = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]) if all(down) else np.concatenate([2 * a, 2 * a + 1]) if down[0] else np.tile(a, 2)
        d = np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1]) if all(down) else np.tile(b, 2) if down[0] else np.concatenate([2 * b, 2 * b + 1])
        i, j = i - down[0], j - down[1]
        there = (c < len(x.known[i])) & (d < len(y.known[j]))
        if x is y:
            there &= c <= d
        there = np.flatnonzero(there)
        again = there % len(a)
        todo.append((i, j, c[there], d[there], differ[again], seen[again]))


def near_pairs(x: GrayIndex, y: GrayIndex, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints within the limit of each other, in runs; within one index the lower place first."""
    for a, b in meetings(x, y, limit):
        for at in range(0, len(a), LEAF_PAIRS):
            k, m = a[at : at + LEAF_PAIRS], b[at : at + LEAF_PAIRS]
            hit = np.flatnonzero(np.bitwise_count(x.leaves[k][:, :, None] ^ y.leaves[m][:, None, :]) <= limit)
            pair, hit = np.divmod(hit, LEAF * LEAF)
            u, v = k[pair] * LEAF + hit // LEAF, m[pair] * LEAF + hit % LEAF
            good = (u < x.count) & (v < y.count)
            if x is y:
                good &= u < v
            if good.any():
                yield u[good], v[good]


class Classes:
    """Which of n places are joined; a class goes by its lowest place."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def of(self, places: np.ndarray) -> np.ndarray:
        now = self.up[places]
        while (now != (higher := self.up[now])).any():
            now = higher
        return now

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        a, b = self.of(u), self.of(v)
        apart = np.unique((np.minimum(a, b) * len(self.up) + np.maximum(a, b))[a != b])
        if not len(apart):
            return
        for a, b in zip((apart // len(self.up)).tolist(), (apart % len(self.up)).tolist()):
            while a != self.up[a]:
                a = self.up[a]
            while b != self.up[b]:
                b = self.up[b]
            self.up[max(a, b)] = min(a, b)
        self.up = self.up[self.up]


def _rank(column: str):
    """The Gray rank as a signed number in the order of the unsigned one."""
    x = F.col(column)
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _ranks(prints: np.ndarray) -> np.ndarray:
    return (gray_rank(prints) ^ np.uint64(1 << 63)).view(np.int64)


def link_prints(prints: DataFrame, limit: int = LIMIT, hot: int = CHUNK) -> DataFrame:
    """(u, v) with u < v: links that join all of the distinct fingerprints ``prints(fp)`` that reach each other within
    ``limit`` bits. ``hot``: fingerprints to a chunk."""
    count = prints.count()
    chunks = max(1, -(-count // max(hot, -(-count // MANY))))
    bounds = np.zeros(0, dtype=np.int64)
    if chunks > 1:
        shares = [i / chunks for i in range(1, chunks)]
        bounds = np.unique(np.array(prints.agg(F.percentile_approx(_rank("fp"), shares, 20 * chunks)).first()[0], dtype=np.int64))

    def chunk_of(fp: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, _ranks(fp), side="right")

    def bits(batches):
        """Of each chunk what all, and what any, of a batch have."""
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            at = chunk_of(fp)
            order = np.argsort(at, kind="stable")
            which, first = np.unique(at[order], return_index=True)
            if len(which):
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *(pa.array(f.reduceat(fp[order], first).view(np.int64)) for f in (np.bitwise_and, np.bitwise_or))], names=["chunk", "every", "any"])

    # One row for each chunk, of which there are at most MANY and one.
    summary = prints.select("fp").mapInArrow(bits, "chunk int, every long, any long").groupBy("chunk").agg(F.bit_and("every").alias("every"), F.bit_or("any").alias("any"))
    rows = sorted(summary.collect())
    at = np.array([r[0] for r in rows], dtype=np.int64)
    every, any_ = (np.array([r[i] for r in rows], dtype=np.int64).view(np.uint64) for i in (1, 2))
    upper = Tree(~(every ^ any_), every) if len(rows) else None

    def deal(batches):
        """Every fingerprint to its own chunk, and to each later one that it may be near."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own = GrayIndex(batch.column(0).to_numpy().view(np.uint64))
            fp = own.prints[: own.count]
            home = chunk_of(fp)
            out = [(home, np.zeros(len(fp), dtype=np.int8), fp)]
            for leaf, chunk in meetings(own, upper, limit):
                place = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
                chunk = np.repeat(chunk, LEAF)
                there = place < own.count
                place, chunk = place[there], chunk[there]
                go = (at[chunk] > home[place]) & (np.bitwise_count((fp[place] ^ upper.bits[0][chunk]) & upper.known[0][chunk]) <= limit)
                out.append((at[chunk[go]], np.ones(int(go.sum()), dtype=np.int8), fp[place[go]]))
            to, kind, fp = (np.concatenate([o[i] for o in out]) for i in range(3))
            for i in range(0, len(fp), PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + PAIRS].astype(np.int32)), pa.array(kind[i : i + PAIRS]), pa.array(fp[i : i + PAIRS].view(np.int64))], names=["chunk", "copied", "fp"])

    def join(batches):
        """One chunk after the other: its own fingerprints are gathered, then those copied to it pass by."""
        index = classes = now = None
        held: list[np.ndarray] = []
        size = 0

        def meet():
            """What has been gathered becomes the index, or is held against it."""
            nonlocal index, classes, held, size
            fp, held, size = np.concatenate(held), [], 0
            if index is None:
                index = GrayIndex(fp)
                classes = Classes(index.count)
                for u, v in near_pairs(index, index, limit):
                    classes.join(u, v)
                return
            other = GrayIndex(fp)
            for u, v in near_pairs(other, index, limit):
                pairs = np.unique(u * index.count + classes.of(v))
                yield other.prints[pairs // index.count], index.prints[pairs % index.count]

        def stars():
            root = classes.of(np.arange(index.count))
            away = np.flatnonzero(root != np.arange(index.count))
            yield index.prints[root[away]], index.prints[away]

        def found(edges):
            for u, v in edges:
                u, v = u.view(np.int64), v.view(np.int64)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        for batch in batches:
            chunk, copied, fp = (c.to_numpy() for c in batch.columns)
            state = chunk.astype(np.int64) * 2 + copied
            edges = [0, *(np.flatnonzero(state[1:] != state[:-1]) + 1).tolist(), len(state)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if now is not None and state[lo] != now:
                    if held:
                        yield from found(meet())
                    if state[lo] // 2 != now // 2:
                        yield from found(stars())
                        index = None
                now = state[lo]
                held.append(fp[lo:hi].view(np.uint64))
                size += hi - lo
                if now % 2 and size >= 1 << 16:
                    yield from found(meet())
        if held:
            yield from found(meet())
        if index is not None:
            yield from found(stars())

    dealt = prints.select("fp").mapInArrow(deal, "chunk int, copied byte, fp long")
    return dealt.repartitionById(len(bounds) + 1, "chunk").sortWithinPartitions("chunk", "copied").mapInArrow(join, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(u, v)``, root the smallest of its component and itself included."""
    now = cut(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: what is greater than a node hangs on the least near it.
        now = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: what is less than a node, and itself, hang on the least of them.
        least = now.groupBy("v").agg(F.min("u").alias("m"))
        lower = now.join(least, "v")
        now = cut(lower.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).union(least.select(F.col("m").alias("u"), "v")).distinct())
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _text_hash(id_col: str, text_col: str):
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)), F.lit("")))


def _labelled(docs: DataFrame, id_col: str, text_col: str, more: dict | None = None) -> DataFrame:
    """(id, fp, root, component_id) and the columns ``more`` for every row; a component's root is its own, the smallest id in reach need not be."""
    out = T.StructType([T.StructField("fp", T.LongType())])

    def make():
        forget()
        return lambda t: (fingerprint(t),)

    view = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), *[c.alias(n) for n, c in (more or {}).items()])
    prints = cut(flat(map_text(view, "text", out, make, ["id", *(more or {})])))
    firsts = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    named = components(link_prints(firsts))
    reach = firsts.join(named, firsts["fp"] == named["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    best = reach.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(reach.join(best, "root").select("fp", "root", "component_id", "n"))
    # A fingerprint that many rows share doesn't go through a shuffle on it; there are at most HOT_SHARE of them.
    hot = labels.where(F.col("n") > max(1, prints.count() // HOT_SHARE)).select("fp", F.struct("root", "component_id").alias("hot"))
    marked = prints.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("hot is null").drop("hot").join(labels.drop("n"), "fp")
    return marked.where("hot is not null").select(*prints.columns, "hot.*").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row; the component's id is the smallest id in reach."""
    return _labelled(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, of several that share it the one with the smallest hash of its text.

    Rows that share an id but lie in different groups stay, one of each. A row without an id stays only if no row of its group
    has one. All columns of the row come along, whatever their names and types.
    """
    groups = _labelled(docs, id_col, text_col, {"_hash": _text_hash(id_col, text_col)})
    stay = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "_hash")).alias("s")).select(F.col("s.id").alias("_id"), F.col("s._hash").alias("_hash"))
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), _text_hash(id_col, text_col).alias("_hash"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    # Repeated rows go before the join, by partial aggregation, so that many of them don't meet in one task.
    first = rows.groupBy("_id", "_hash").agg(F.first("row").alias("row"))
    return first.join(stay, first["_id"].eqNullSafe(stay["_id"]) & (first["_hash"] == stay["_hash"]), "left_semi").select("row.*")
