"""Packing by best-fit decreasing into windows of fixed length.

Documents longer than a window are first cut into full windows. The rest goes, longest first, each into the
open window with the least room that holds it, found in a segment tree over remaining capacities. What is left
open at the end is closed with little padding: wide gaps are filled from the emptiest windows, and the last
window is cut at powers of two, which need no padding.

Each task packs what it reads, in groups of bounded size, so nothing is shuffled and no task grows with the
corpus. Null and empty texts have the end id only. Rows that share an id are packed each for itself.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BATCH_BYTES, kept, quoted, slices, small_batches, staged
from .vocab import Encoder, public_path

WINDOW = 2048
#: Tokens that one task packs at a time.
GROUP_TOKENS = 5_000_000
#: A gap of at most so many tokens is padded.
GAP = 32


class Capacities:
    """Open windows by remaining capacity; a segment tree counts them, so that the tightest fit is a walk down."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.size
        while i:
            self.counts[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Takes a window out whose room is the smallest that is at least ``least``: (room, window)."""
        i = least + self.size
        if not self.counts[i]:
            # Up to the first subtree to the right that isn't empty, then down its left side.
            while i > 1 and (i & 1 or not self.counts[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                i += not self.counts[i]
        room = i - self.size
        while i:
            self.counts[i] -= 1
            i >>= 1
        return room, self.windows[room].pop()


def pack(lengths: list[int], window: int = WINDOW, gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); each of a document's tokens is in exactly one piece."""
    full: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        whole = n // window * window
        full += [[(d, s, window)] for s in range(0, whole, window)]
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda r: (-r[0], r[1]))
    open_: list[list[tuple[int, int, int]]] = []
    rooms = Capacities(window)
    for n, d, s in rest:
        found = rooms.take(n)
        if found is None:
            found = window, len(open_)
            open_.append([])
        room, w = found
        open_[w].append((d, s, n))
        rooms.put(room - n, w)
    return full + _closed(open_, window, gap)


def _closed(open_: list[list[tuple[int, int, int]]], window: int, gap: int) -> list[list[tuple[int, int, int]]]:
    fill = lambda w: sum(p[2] for p in w)
    order = sorted(open_, key=fill, reverse=True)
    lo, hi = 0, len(order) - 1
    while lo < hi:
        room = window - fill(order[lo])
        if room <= gap:
            lo += 1
            continue
        d, s, n = order[hi].pop()  # of the emptiest window, the last piece or its end
        moved = min(n, room)
        if moved < n:
            order[hi].append((d, s, n - moved))
        order[lo].append((d, s + n - moved, moved))
        if not order[hi]:
            order.pop()
            hi -= 1
    if not order or window - fill(order[-1]) <= gap:
        return order
    last, out, size = order.pop(), [], window
    while last:
        while size > sum(p[2] for p in last):
            size //= 2
        part, room = [], size
        while room:
            d, s, n = last.pop(0)
            if n > room:
                last.insert(0, (d, s + room, n - room))
                n = room
            part.append((d, s, n))
            room -= n
        out.append(part)
    return order + out


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType())]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids unless they aren't wanted."""
    path = vocabulary or public_path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    view = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    fields = [view.schema["id"], *(T.StructField(*f) for f in _PIECE), T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("offset", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        encoder, part = kept(Encoder, path, True), TaskContext.get().partitionId()
        names: list = []
        held: list[np.ndarray] = []
        tokens = made = 0
        end = np.array([end_id], dtype="<u2")

        def give():
            nonlocal made
            rows = []
            for seq in pack([len(x) for x in held], window):
                offset = 0
                for d, s, n in seq:
                    ids = held[d][s : s + n]
                    row = (names[d], s, n, crc_of_ids(ids), len(held[d]), part, made, offset)
                    rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                    offset += n
                made += 1
                if len(rows) >= 4096:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

        for big in batches:
            for batch in slices(big, 1, 2 * BATCH_BYTES):
                names += batch.column(0).to_pylist()
                for data in encoder(batch.column(1).to_pylist()):
                    held.append(np.concatenate([np.frombuffer(data, dtype="<u2"), end]))
                    tokens += len(held[-1])
                if tokens >= GROUP_TOKENS:
                    yield from give()
                    names, held, tokens = [], [], 0
        yield from give()

    pieces = staged(view.mapInArrow(run, schema))
    # As many rows as tasks: what each task numbered from 0 is numbered on from the tasks before it.
    sizes = sorted((r["part"], r["n"]) for r in pieces.groupBy("part").agg((F.max("local") + 1).alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    first = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part int, before long")
    ids = [F.col("ids")] if with_ids else []
    return pieces.join(F.broadcast(first), "part").select(
        F.col("id").alias(id_col), *[f[0] for f in _PIECE], (F.col("before") + F.col("local")).alias("sequence_id"), "offset", *ids
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
