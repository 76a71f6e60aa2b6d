"""Token ids in binary files, coded by an adaptive context-mixing range coder.

A file is a Parquet part whose rows are frames, in ascending order of document ids. A frame holds whole
documents, or a piece of one that is longer than a frame: a header, the ids and lengths of its documents, and its tokens in blocks. Each block starts with fresh
models, has a checksum, and can be decoded alone; all blocks of a frame are coded side by side, one
token of each at a time, so that numpy does the work of the loop over tokens.

Within a block an id goes by its rank, by how many others came first. A token is one of four things: what followed the last two tokens before (order 2), what
followed the last one (order 1), another id that was in the block (order 0), or a new one. Three answers tell which, coded at once, with mixed predictions: the stretched probabilities of counters, which know
how long each order has been right, whether the orders agree, how often the guess was there and how many ids are distinct so far (order 0), are weighted by what proved right, and squashed. An id that was
there is coded by its rank, a new one by how many bits it has, with adaptive frequencies, and by the bits. All arithmetic is on integers, so any machine
decodes what another coded. Spark jobs code and decode by ``TokenCoder.java``, bit for bit the same, in the JVM; the numpy coder here is its reference and reads the files without Spark.

Null and empty texts have the end id only; an empty table has no files. Rows that share an id follow each other by the first characters of their texts, those that
share these too by a hash; repeated rows are documents of their own. Ids of documents must be integers; a null id comes first. A very long text is encoded
as a whole, with some bytes for each token, but coded frame by frame. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import token_jvm
from .common import forget, kept, quoted, slices, small_batches, staged
from .vocab import Encoder, public_path

#: Tokens to a block, and to a frame about.
BLOCK, FRAME = 2048, 6_000_000
#: Bytes of text that one task encodes.
SHARD_BYTES = 24 << 20
#: Of a frame whose tokens are coded, and of one whose tokens are plain 16-bit integers, on its way to or from the JVM.
MAGIC, PLAIN = b"QTF2", b"QTFR"

_ONE, _HALF, _FULL = 4096, 2048, 65536  # predictions have 12 bits, shares 16
_MASK = np.uint64((1 << 48) - 1)
_SQUASH = np.array([round(_ONE / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], dtype=np.int32).clip(32, _ONE - 32)
_STRETCH = np.array([round(256 * math.log(p / (_ONE - p))) if p else -2047 for p in range(_ONE)], dtype=np.int32).clip(-2047, 2047)
# How many bits an id has, 1 for ids 0 and 1; the least id of so many bits.
_BITS = np.array([max(1, i.bit_length()) for i in range(_FULL)], dtype=np.int64)
_LEAST = np.array([0, 0, *(1 << b for b in range(1, 16))], dtype=np.int64)


class _Coder:
    """Carry-less range coders side by side: 48 bits of state, 16 bits out at a time.

    ``given``: the words to decode, by block; without them it codes.
    """

    def __init__(self, n: int, most: int, given: np.ndarray | None = None) -> None:
        self.low = np.zeros(n, dtype=np.uint64)
        self.range = np.full(n, _MASK, dtype=np.uint64)
        self.given = given
        self.words = (np.zeros((n, most), dtype=np.uint16) if given is None else given).ravel()
        self.begin = np.arange(n, dtype=np.int64) * (most if given is None else given.shape[1])
        self.at = self.begin.copy()
        if given is not None:
            self.code = np.zeros(n, dtype=np.uint64)
            for _ in range(3):
                self.code = (self.code << np.uint64(16)) | self.words[self.at]
                self.at += 1

    def place(self, k: slice | np.ndarray, step: np.ndarray) -> np.ndarray:
        """Decoding: how many steps into its range each code points."""
        return (((self.code[k] - self.low[k]) & _MASK) // step).astype(np.int64)

    def narrow(self, k: slice | np.ndarray, start: np.ndarray, size: np.ndarray, step: np.ndarray) -> None:
        """Blocks ``k`` go on to ``size`` from ``start`` in steps of their ranges, of at most 2^16 to a range."""
        low = (self.low[k] + step * start.astype(np.uint64)) & _MASK
        span = step * size.astype(np.uint64)
        self.low[k], self.range[k] = low, span
        out = None
        while True:
            near = (low ^ (low + span - np.uint64(1))) < np.uint64(1 << 32)
            full = np.flatnonzero(near | (span < np.uint64(1 << 16)))
            if not len(full):
                return
            out = full if out is None and isinstance(k, slice) else (k if out is None else out)[full]
            low, span, near = low[full], span[full], near[full]
            if not near.all():  # a narrow range across a border of the top bits is given up beyond the border
                span = np.where(near, span, np.uint64(1 << 16) - (low & np.uint64(0xFFFF)))
            at = self.at[out]
            if self.given is None:
                self.words[at] = (low >> np.uint64(32)).astype(np.uint16)
            else:
                self.code[out] = ((self.code[out] << np.uint64(16)) & _MASK) | self.words[at]
            self.at[out] = at + 1
            low = (low << np.uint64(16)) & _MASK
            span = span << np.uint64(16)
            self.low[out], self.range[out] = low, span

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self.words[self.at] = (self.low >> np.uint64(32)).astype(np.uint16)
            self.low = (self.low << np.uint64(16)) & _MASK
            self.at += 1
        return [self.words[a:b].astype("<u2").tobytes() for a, b in zip(self.begin.tolist(), self.at.tolist())]


class _Decisions:
    """Three binary answers, each by mixing four predictions, whose counters are chosen by states under 128."""

    def __init__(self, n: int) -> None:
        self.p = np.full(n * 12 * 128, _HALF, dtype=np.int16)
        self.w = np.full((3, 4, n), 20000, dtype=np.int32)
        self.base = (np.arange(n) * 12 + np.arange(12).reshape(3, 4, 1)) * 128

    def predict(self, m: int, states: np.ndarray) -> np.ndarray:
        self.at = states + self.base[:, :, :m]
        self.was = self.p.take(self.at)
        self.s = _STRETCH.take(self.was)
        self.mixed = _SQUASH.take(((self.s * self.w[:, :, :m]).sum(axis=1, dtype=np.int32) >> 16).clip(-2047, 2047) + 2047)
        return self.mixed

    def learn(self, m: int, asked: np.ndarray, yes: np.ndarray) -> None:
        """From the answers ``yes`` to those that were ``asked``."""
        target = yes * np.int32(_ONE - 1)
        w = self.w[:, :, :m]
        w += (self.s * ((target - self.mixed) * asked)[:, None]) >> 11
        np.clip(w, -(1 << 17), 1 << 17, out=w)  # so that sums fit in 32 bits
        step = ((target[:, None] - self.was) >> 4) * asked[:, None]
        self.p[self.at] = (self.was + step).clip(32, _ONE - 32)


class _Sizes:
    """Adaptive frequencies of how many bits an id has, 1 to 16, as running sums."""

    def __init__(self, n: int) -> None:
        self.sums = np.tile(np.arange(17, dtype=np.int16), (n, 1))
        self.steps = np.arange(17)[None, :]

    def code(self, coder: _Coder, k: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
        sums = self.sums[k]
        step = coder.range[k] // sums[:, 16].astype(np.uint64)
        if bits is None:
            bits = (sums[:, :16] <= coder.place(k, step)[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        start = sums[rows, bits - 1]
        coder.narrow(k, start, sums[rows, bits] - start, step)
        sums += (self.steps >= bits[:, None]) * np.int16(24)
        if (full := sums[:, 16] > 6000).any():
            sums[full, 1:] = np.cumsum((np.diff(sums[full], axis=1) + 1) >> 1, axis=1)
        self.sums[k] = sums
        return bits


def _ranked(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each place of each row how many distinct ids came before that id's first place, the distinct ids of the row in that order)."""
    ranks, distinct = np.empty(grid.shape, dtype=np.int16), np.zeros(grid.shape, dtype=np.uint16)
    for a in range(0, len(grid), 256):
        ranks[a : a + 256], distinct[a : a + 256] = _ranked_rows(grid[a : a + 256])
    return ranks, distinct


def _ranked_rows(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.arange(len(grid))[:, None]
    order = np.argsort(grid, axis=1, kind="stable")
    ids = np.take_along_axis(grid, order, 1)
    new = np.ones(grid.shape, dtype=bool)
    new[:, 1:] = ids[:, 1:] != ids[:, :-1]
    first = np.zeros(grid.shape, dtype=bool)
    first[rows, order] = new
    number = np.cumsum(first, axis=1, dtype=np.int16) - np.int16(1)
    starts = np.maximum.accumulate(np.where(new, np.arange(grid.shape[1], dtype=np.int16), np.int16(0)), axis=1)
    ranks = np.empty(grid.shape, dtype=np.int16)
    ranks[rows, order] = np.take_along_axis(np.take_along_axis(number, order, 1), starts, 1)
    distinct = np.zeros(grid.shape, dtype=np.uint16)
    at = np.nonzero(first)
    distinct[at[0], number[at]] = grid[at]
    return ranks, distinct


def _run(coder: _Coder, lengths: np.ndarray, tokens: np.ndarray | None) -> np.ndarray:
    """Codes the tokens of all blocks (rows, longest first), or decodes them. Within a block an id goes by its rank: how many others came first."""
    n, steps = len(lengths), int(lengths.max())
    coding = tokens is not None
    base = np.arange(n) * BLOCK
    if coding:
        ranks, ids = _ranked(tokens[:, :steps])
        out = np.ascontiguousarray(ranks.T)
        ids = np.pad(ids, ((0, 0), (0, BLOCK - steps))).ravel()
    else:
        out, ids = np.zeros((steps, n), dtype=np.int16), np.zeros(n * BLOCK, dtype=np.uint16)
    # What followed a context last, times 8, and how often in a row, up to 7; how often a rank was there, up to 15.
    two, one, count = np.zeros(n * BLOCK, dtype=np.int16), np.zeros(n * BLOCK, dtype=np.int16), np.zeros(n * BLOCK, dtype=np.int8)
    number = np.zeros(n, dtype=np.int64)  # of distinct ids so far
    model, sizes = _Decisions(n), _Sizes(n)
    all_states, none = np.empty((3, 4, n), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for t in range(steps):
        m = int(np.searchsorted(-lengths, -t, side="left"))  # blocks with a token left
        k, here = slice(0, m), base[:m]
        last, before = ((out[t - i, :m] if t >= i else none[:m]).astype(np.int64) for i in (1, 2))
        at1, at2 = here + last, here + ((before * 797 + last * 1181 + (before >> 3)) & (BLOCK - 1))
        held1, held2 = one.take(at1), two.take(at2)
        guess1, run1, guess2, run2 = held1 >> 3, held1 & 7, held2 >> 3, held2 & 7
        distinct = number[:m]
        can2 = run2 > 0
        same = (guess1 == guess2) & can2
        can1 = (run1 > 0) & ~same
        states = all_states[:, :, :m]
        states[:, 0], states[:, 1] = run2, run1 + 8 * same
        states[:, 2] = states[0, 0] * 8 + states[0, 1] + 56 * same
        states[0, 3] = count.take(here + guess2) * np.int16(8) + run1
        states[1, 3] = count.take(here + guess1) * np.int16(8) + run2
        states[2, 3] = distinct * 127 // (t + 1)
        p2, p1, p0 = model.predict(m, states)
        # Shares of 2^16: the guess of order 2, that of order 1, another id that was there, a new one.
        size2 = (p2 << 4) * can2
        size1 = ((_FULL - size2) * p1.astype(np.int64) >> 12) * can1
        left = _FULL - size2 - size1
        size0 = 1 + ((left - 2) * p0 >> 12)
        start0, start9 = size2 + size1, size2 + size1 + size0
        step = coder.range[k] >> np.uint64(16)
        if coding:
            rank = out[t, :m].astype(np.int64)
            hit2 = (rank == guess2) & can2
            hit1 = (rank == guess1) & can1 & ~hit2
            old = rank < distinct
        else:
            place = np.minimum(coder.place(k, step), _FULL - 1)
            hit2, hit1, old = place < size2, (place >= size2) & (place < start0), place < start9
            rank = np.where(hit2, guess2, np.where(hit1, guess1, distinct))
        miss = ~(hit2 | hit1)
        start = np.where(hit2, 0, np.where(hit1, size2, np.where(old, start0, start9)))
        size = np.where(hit2, size2, np.where(hit1, size1, np.where(old, size0, _FULL - start9)))
        coder.narrow(k, start, size, step)
        model.learn(m, np.stack((can2, can1 & ~hit2, miss)), np.stack((hit2, hit1, old)))
        rest = np.flatnonzero(miss)
        if len(rest):
            fresh = ~old[rest]
            new = rest[fresh]
            total = distinct[rest]
            if len(new):
                at = base[new] + distinct[new]
                bits = sizes.code(coder, new, _BITS[ids[at]] if coding else None)
                total[fresh] = 1 << np.maximum(bits - 1, 1)
            step = coder.range[rest] // total.astype(np.uint64)
            if coding:
                place = rank[rest]
                if len(new):
                    place[fresh] = ids[at] - _LEAST[bits]
            else:
                place = np.minimum(coder.place(rest, step), total - 1)
                rank[rest[~fresh]] = place[~fresh]
                if len(new):
                    ids[at] = place[fresh] + _LEAST[bits]
            coder.narrow(rest, place, np.ones_like(place), step)
            if len(new):
                number[new] += 1
        if not coding:
            out[t, :m] = rank
        one[at1] = (rank << 3) + np.where((rank == guess1) & (run1 > 0), np.minimum(run1 + 1, 7), 1)
        two[at2] = (rank << 3) + np.where((rank == guess2) & can2, np.minimum(run2 + 1, 7), 1)
        at = here + rank
        count[at] = np.minimum(count.take(at) + 1, 15)
    return tokens if coding else np.take_along_axis(ids.reshape(n, BLOCK), out.T.astype(np.int64), 1).astype(np.int64)


def _lengths(n: int) -> np.ndarray:
    return np.array([BLOCK] * (n // BLOCK) + ([n % BLOCK] if n % BLOCK else []), dtype=np.int64)


def encode_tokens(tokens: np.ndarray) -> bytes:
    """Blocks of ids under 65,536: their number, sizes in bytes and checksums, then their bytes."""
    lengths = _lengths(len(tokens))
    if not len(lengths):
        return struct.pack("<I", 0)
    grid = np.zeros((len(lengths), BLOCK), dtype=np.uint16)
    grid.ravel()[: len(tokens)] = tokens
    coder = _Coder(len(lengths), 6 * BLOCK + 16)
    _run(coder, lengths, grid)
    blocks = coder.finish()
    sums = [zlib.crc32(b) for b in blocks]
    return struct.pack("<I", len(blocks)) + np.array([[len(b), c] for b, c in zip(blocks, sums)], dtype="<u4").tobytes() + b"".join(blocks)


def decode_tokens(data: bytes, n: int, only: list[int] | None = None) -> np.ndarray:
    """The ids, or those of some blocks only."""
    count = struct.unpack_from("<I", data)[0]
    table = np.frombuffer(data, dtype="<u4", count=2 * count, offset=4).reshape(-1, 2)
    ends = 4 + 8 * count + np.cumsum(table[:, 0], dtype=np.int64)
    lengths, take = _lengths(n), list(range(count)) if only is None else only
    if not take:
        return np.zeros(0, dtype=np.int64)
    given = np.zeros((len(take), int(table[take, 0].max()) // 2 + 1), dtype=np.uint16)
    for row, b in enumerate(take):
        block = data[int(ends[b] - table[b, 0]) : int(ends[b])]
        if zlib.crc32(block) != table[b, 1]:
            raise ValueError(f"block {b} is damaged")
        given[row, : len(block) // 2] = np.frombuffer(block, dtype="<u2")
    grid = _run(_Coder(len(take), 0, given), lengths[take], None)
    return np.concatenate([row[:m] for row, m in zip(grid, lengths[take].tolist())])


def encode_frame(ids: list, docs: list[np.ndarray], plain: bool = False) -> bytes:
    sizes = np.array([len(d) for d in docs], dtype="<u8")
    nulls = np.array([i is None for i in ids], dtype=np.uint8)
    index = zlib.compress(np.array([i or 0 for i in ids], dtype="<i8").tobytes() + nulls.tobytes() + sizes.tobytes(), 1)
    tokens = np.concatenate(docs)
    head = struct.pack("<III", len(ids), len(index), zlib.crc32(index)) + index
    return b"".join((PLAIN, head, tokens.astype("<u2", copy=False).data)) if plain else MAGIC + head + encode_tokens(tokens)


def decode_frame(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, its token ids) in order, of a coded frame or a plain one."""
    n, size, crc = struct.unpack_from("<III", data, 4)
    if (magic := data[:4]) not in (MAGIC, PLAIN) or zlib.crc32(index := data[16 : 16 + size]) != crc:
        raise ValueError("not a frame, or a damaged one")
    raw = zlib.decompress(index)
    ids, nulls = np.frombuffer(raw, "<i8", n).tolist(), raw[8 * n : 9 * n]
    sizes = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
    tokens = decode_tokens(data[16 + size :], int(sizes.sum())) if magic == MAGIC else np.frombuffer(data, "<u2", int(sizes.sum()), 16 + size)
    for i, null, doc in zip(ids, nulls, np.split(tokens, np.cumsum(sizes)[:-1])):
        yield None if null else i, doc


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, most: int = FRAME) -> DataFrame:
    """The files, as rows (part, frame, before: tokens of the part's frames before, n_tokens, of: 0, or how many tokens the document has of which
    this is a piece, lead: its tokens before the piece, payload), already written to the shared folder. ``most``: tokens of a frame about."""
    path = vocabulary or public_path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    view = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text.alias("text"))
    size = view.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["id", F.substring("text", 1, 64), F.xxhash64("text")]  # the same across parts as in each
    ordered = view.repartitionByRange(max(1, math.ceil(size / SHARD_BYTES)), *order).sortWithinPartitions(*order, "text")

    def run(batches):
        encoder, part = kept(Encoder, path, False), TaskContext.get().partitionId()
        ids: list = []
        held: list[np.ndarray] = []
        tokens = before = frame = 0
        end = np.array([end_id], dtype="<u2")

        def give(ids, held, of=0, lead=0):
            nonlocal before, frame
            n = sum(map(len, held))
            row = [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), *(pa.array([x], pa.int64()) for x in (before, n, of, lead)), pa.array([encode_frame(ids, held, True)], pa.binary())]
            before, frame = before + n, frame + 1
            return pa.RecordBatch.from_arrays(row, names=["part", "frame", "before", "n_tokens", "of", "lead", "payload"])

        for big in batches:
            for batch in slices(big, 1):
                for i, data in zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist())):
                    doc = np.concatenate([np.frombuffer(data, dtype="<u2"), end])
                    if held and tokens + len(doc) > most:
                        yield give(ids, held)
                        ids, held, tokens = [], [], 0
                    if len(doc) > most:
                        for lead in range(0, len(doc), most):
                            yield give([i], [doc[lead : lead + most]], len(doc), lead)
                    else:
                        ids.append(i)
                        held.append(doc)
                        tokens += len(doc)
        if held:
            yield give(ids, held)
        forget()  # a worker that waits for a task shall hold nothing

    plain = ordered.mapInArrow(run, "part int, frame int, before long, n_tokens long, of long, lead long, payload binary")
    return staged(plain.withColumn("payload", token_jvm.encoded(docs.sparkSession, F.col("payload"), (_SQUASH, _STRETCH))))


def read_token_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if wanted, ids) of every document in the files."""
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row for each file
    before = [0, *accumulate(n for _, n in parts)]
    first = files.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(parts, before)], "part int, earlier long")
    framed = files.join(F.broadcast(first), "part").select((F.col("earlier") + F.col("before")).alias("start"), "n_tokens", "payload", "lead", "of")
    plain = token_jvm.decoded(files.sparkSession, F.col("payload"), F.col("n_tokens"), (_SQUASH, _STRETCH)).alias("payload")
    names = [id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names[:4]] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def row(i, start, ids, crc):
        return i, start, len(ids), crc, *([ids] if with_ids else [])

    def whole(batches):
        forget()  # encoders of tasks before
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for i, ids in decode_frame(payload.as_py()):
                    rows.append(row(i, start, ids, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def joined(batches):
        """Documents from their pieces, which follow each other; one piece is held at a time."""
        forget()
        at, doc, n, crc, parts = None, None, 0, 0, []

        def made():
            columns = doc, at, n, crc, *([np.concatenate(parts)] if with_ids else [])
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                ((i, ids),) = decode_frame(payload.as_py())
                if begin != at:
                    if at is not None:
                        yield made()
                    at, doc, n, crc, parts = begin, i, 0, 0, []
                crc, n = zlib.crc32(ids.astype("<u4").tobytes(), crc), n + len(ids)
                if with_ids:
                    parts.append(ids)
        if at is not None:
            yield made()

    pieces = framed.where("of > 0").withColumn("begin", F.col("start") - F.col("lead")).repartition("begin").sortWithinPartitions("begin", "lead")
    return framed.where("of = 0").select("start", plain).mapInArrow(whole, schema).unionByName(pieces.select("begin", plain).mapInArrow(joined, schema))


def token_digest(docs: DataFrame) -> DataFrame:
    return read_token_files(write_token_files(docs), with_ids=False)
