"""Exact substring dedup by fixed-block anchors.

A window is ``window`` consecutive words of one document. Every document is an index of its blocks of
``block`` words that start at multiples of ``block``; a window of at least ``2 * block - 1`` words holds a whole one of them. Every
rolling run of ``block`` words probes the index of all documents. If two windows are equal, each holds a
run that hits a block of the other, so only windows around a hit can repeat. In a second round these are compared, which
extends hits to the maximal repeats: the unions of consecutive repeated windows.

Documents are dealt to packs of some megabytes. A pack sends, for each range of hash values, its sorted distinct
hashes, as differences and with two bits for each (is it a block of the index; is it there twice). Whoever has the range answers
with one bit for each hash. So a probe costs two to four bytes, a passage that many documents share costs no
more than one entry for each pack, and no task gets more than its range or its pack.

The first round's hashes only have to select, and are as long as the corpus needs for that: what they take for equal by mistake
costs time. In the second round a window goes by its words: 128 bits of their BLAKE2b digest, which nobody is known to be able to make collide.

Null texts have no words and stay null; empty ones and an empty table are no special case. Rows that share an id, or have none, are documents of
their own; the same row twice is a repeat like any other, though rows that are equal in all columns share a pack. A text is never cut: a very long one is a pack of its
own, with some 60 bytes of memory for each of its words. Other columns come along, whatever their names and types. Every row gets a result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import forget, mix64, quoted, shuffle_partitions

WINDOW, BLOCK = 35, 18
#: Bytes of text to a pack, and words to a range of hash values, in a small corpus. Every pack asks every range, so
#: beyond ``MANY`` of them packs and ranges grow, up to 32 times these sizes, rather than their number.
PACK_BYTES, RANGE_WORDS, MANY = 4 << 20, 1 << 20, 4096

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2^64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, np.array([base], dtype=np.uint64)  # arrays wrap without a warning
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
        step = step * step
    return out


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95
_BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64))


class Words:
    """The words of a pack of texts: where they are, in which text, and their hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts)
        data = np.frombuffer(self.data, dtype=np.uint8)
        space = np.ones(len(data) + 2, dtype=bool)
        space[1:-1] = _SPACE[data]
        change = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = change[::2], change[1::2]
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(self.starts, limits), prepend=0) if texts else np.zeros(0, dtype=np.int64)
        hashes = np.empty(len(self.starts), dtype=np.uint64)
        size = 1 << 18  # words at a time
        for i in range(0, len(hashes), size):
            s, e = self.starts[i : i + size], self.ends[i : i + size]
            lo, hi = int(s[0]), int(e[-1])
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[data[lo:hi]] * _powers(_BYTE_BASE, hi - lo), out=sums[1:])
            at = s - lo
            shift = _powers(_inverse(_BYTE_BASE), hi - lo)[at]
            hashes[i : i + size] = mix64((sums[e - lo] - sums[at]) * shift + (e - s).astype(np.uint64))
        self.hashes = hashes
        self.left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(hashes))  # words from here to the text's end
        self.place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def runs(self, n: int) -> np.ndarray:
        """For each word the hash of the n words that start there; it only counts where the text goes on that far."""
        w = len(self.hashes)
        sums = np.zeros(w + 1, dtype=np.uint64)
        np.cumsum(self.hashes * _powers(_WORD_BASE, w), out=sums[1:])
        ends = np.minimum(np.arange(w) + n, w)
        return mix64((sums[ends] - sums[:-1]) * _powers(_inverse(_WORD_BASE), w))

    def digests(self, at: np.ndarray, n: int) -> np.ndarray:
        """Two 64-bit numbers for the n words from each of the places ``at``: the BLAKE2b digest of these words joined by spaces."""
        joined = b" ".join(self.data.split())
        starts = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        digest = hashlib.blake2b
        found = [digest(joined[s:e], digest_size=16).digest() for s, e in zip(starts[at].tolist(), (starts[at + n] - 1).tolist())]
        return np.frombuffer(b"".join(found), dtype="<u8").astype(np.uint64).reshape(-1, 2)


def _packed(deltas: np.ndarray) -> bytes:
    """Non-negative 64-bit numbers by their low bytes, as many as the largest needs."""
    width = max(1, (int(deltas.max()).bit_length() + 7) // 8) if len(deltas) else 1
    return bytes([width]) + deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def _distinct(key: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether any of a key has the flag, whether it is there twice, and each row's place among them."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    at = np.empty(len(s), dtype=np.int64)
    at[order] = group
    n = int(group[-1]) + 1 if len(s) else 0
    return s[new], np.bincount(group, flag[order], minlength=n) > 0, np.bincount(group, minlength=n) > 1, at


class Round:
    """What one round asks of a pack's words. ``bits``: length of its keys; ``ranges``: how many ranges of them."""

    def __init__(self, bits: int, ranges: int, block: int, window: int) -> None:
        self.bits, self.ranges, self.block, self.window = bits, ranges, block, window

    def first(self, words: Words) -> tuple[np.ndarray, ...]:
        """Runs of ``block`` words: their places, keys, and which are blocks of the index; no second key."""
        at = np.flatnonzero(words.left >= self.block)
        key = words.runs(self.block)[at] >> np.uint64(64 - self.bits)
        return at, key, words.place[at] % self.block == 0, None

    def second(self, words: Words, hits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that hold a hit: their places and both keys. ``hits``: by word, whether the run that starts there hits."""
        sums = np.concatenate([[0], np.cumsum(hits)])
        last = np.minimum(np.arange(len(hits)) + self.window - self.block + 1, len(hits))
        at = np.flatnonzero((words.left >= self.window) & (sums[last] > sums[:-1]))
        digests = words.digests(at, self.window)
        return at, digests[:, 0], np.ones(len(at), dtype=bool), digests[:, 1]

    def cuts(self, keys: np.ndarray) -> list[int]:
        """Where each range of the sorted keys begins, and their end."""
        step = ((1 << self.bits) + self.ranges - 1) // self.ranges
        return [*np.searchsorted(keys, np.array([step * r for r in range(self.ranges)], dtype=np.uint64)).tolist(), len(keys)]

    def ask(self, keys: np.ndarray, flag: np.ndarray, twice: np.ndarray, check: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
        cuts = self.cuts(keys)
        for r, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo < hi:
                body = _packed(np.diff(keys[lo:hi], prepend=keys[lo]))
                parts = [int(keys[lo]).to_bytes(8, "little"), (hi - lo).to_bytes(4, "little"), _bits(flag[lo:hi]), _bits(twice[lo:hi]), check[lo:hi].astype("<u8").tobytes() if check is not None else b"", body]
                yield r, b"".join(parts)


def _asked(data: bytes, checked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, n = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:12], "little")
    at = 12 + (k := (n + 7) // 8)
    flag, twice = _unbits(data[12:at], n), _unbits(data[at : at + k], n)
    at += k
    check = np.frombuffer(data, dtype="<u8", count=n, offset=at).astype(np.uint64) if checked else np.zeros(n, dtype=np.uint64)
    return np.cumsum(_unpacked(data[at + 8 * n * checked :])) + np.uint64(first), flag, twice, check


def _answer(asked: list[bytes], checked: bool) -> list[bytes]:
    """For each pack's hashes of one range the bits of those that are a block of the index somewhere, and are there twice in all."""
    parts = [_asked(x, checked) for x in asked]
    key, flag, twice, check = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((check, key)) if checked else np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    group = np.empty(len(key), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    n = int(group.max()) + 1
    hit = ((np.bincount(group, 1 + twice, minlength=n) > 1) & (np.bincount(group, flag, minlength=n) > 0))[group]
    ends = np.cumsum([len(p[0]) for p in parts])
    return [_bits(x) for x in np.split(hit, ends[:-1])]


def _both(key: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of key and check, and for each row its place among the distinct pairs."""
    order = np.lexsort((check, key))
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    at = np.empty(len(key), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("text").cast(pa.binary()).to_pylist()


def _replied(answers: pa.Table, cuts: list[int], n: int) -> np.ndarray:
    hit = np.zeros(n, dtype=bool)
    for r, bits in zip(answers.column("range").to_pylist(), answers.column("bits").to_pylist()):
        hit[cuts[r] : cuts[r + 1]] = _unbits(bits, cuts[r + 1] - cuts[r])
    return hit


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash values of that type: there are no maps in it."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def repeated(docs: DataFrame, text_col: str, carry: list[str], out: T.StructType, give, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(carry, out) for every row, where ``give(text, removed)`` makes a row's ``out`` from its text, or None, and which of its words lie in repeated windows."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    parts = shuffle_partitions(spark)
    total = size[0] or 0
    words_about = total / 6
    packs = max(parts, math.ceil(total / min(32 * PACK_BYTES, max(PACK_BYTES, total / MANY))))
    ranges = math.ceil(words_about / min(32 * RANGE_WORDS, max(RANGE_WORDS, words_about / MANY)))
    ranges = max(1, ranges, min(parts, math.ceil(words_about / (RANGE_WORDS / 4))))
    bits = min(64, max(40, total.bit_length() + 12))
    # The pack follows from the row, so that a row that is read again meets the same others.
    told_apart = [F.col(quoted(c)) for c in carry if _hashable(docs.schema[c].dataType)]
    view = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in carry]).alias("carry"), text.alias("text"), F.col(quoted(text_col)).isNull().alias("none"),
        F.pmod(F.xxhash64(text, *told_apart), F.lit(packs)).cast("int").alias("pack"),
    )
    rounds = Round(bits, ranges, block, window), Round(64, ranges, block, window)
    blob, bit_rows = "pack int, range int, asked binary", "pack int, range int, bits binary"

    def rows(pack: int, pairs) -> pa.Table:
        pairs = list(pairs)
        return pa.table({"pack": pa.array([pack] * len(pairs), pa.int32()), "range": pa.array([p[0] for p in pairs], pa.int32()), "asked": pa.array([p[1] for p in pairs], pa.binary())})

    def probe(table: pa.Table) -> pa.Table:
        forget()
        words = Words(_texts(table))
        _, key, flag, _ = rounds[0].first(words)
        keys, flags, twice, _ = _distinct(key, flag)
        return rows(table.column("pack")[0].as_py(), rounds[0].ask(keys, flags, twice, None))

    def answer(checked: bool):
        def run(table: pa.Table) -> pa.Table:
            if table.column("range")[0].as_py() < 0:
                return table.rename_columns(["pack", "range", "bits"])
            bits = _answer(table.column("asked").to_pylist(), checked)
            return pa.table({"pack": table.column("pack"), "range": table.column("range"), "bits": pa.array(bits, pa.binary())})

        return run

    def hits(words: Words, answers: pa.Table) -> np.ndarray:
        at, key, flag, _ = rounds[0].first(words)
        keys, _, _, back = _distinct(key, flag)
        hit = np.zeros(len(words.hashes), dtype=bool)
        hit[at] = _replied(answers, rounds[0].cuts(keys), len(keys))[back]
        return hit

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows(0, [])
        words = Words(_texts(table))
        _, key, _, check = rounds[1].second(words, hits(words, answers))
        order, back = _both(key, check)
        twice = np.bincount(back, minlength=len(order)) > 1
        first = rounds[1].ask(key[order], np.ones(len(order), dtype=bool), twice, check[order])
        # The first round's answers go along, as the second needs the same windows again.
        along = ((-1 - r, b) for r, b in zip(answers.column("range").to_pylist(), answers.column("bits").to_pylist()))
        return rows(table.column("pack")[0].as_py(), [*first, *along])

    arrow = to_arrow_schema(out)
    schema = T.StructType([view.schema["carry"], T.StructField("out", out)])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"carry": table.column("carry"), "out": pa.array([], pa.struct(list(arrow)))})
        texts = _texts(table)
        words = Words(texts)
        early = pa.compute.less(answers.column("range"), 0)
        one, two = answers.filter(early), answers.filter(pa.compute.invert(early))
        one = one.set_column(one.schema.get_field_index("range"), "range", pa.compute.subtract(-1, one.column("range")))
        at, key, _, check = rounds[1].second(words, hits(words, one))
        order, back = _both(key, check)
        hit = _replied(two, rounds[1].cuts(key[order]), len(order))[back]
        edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        made, lo = [], 0
        for data, none, n in zip(texts, table.column("none").to_pylist(), words.counts.tolist()):
            made.append(give(None if none else data, gone[lo : lo + n]))
            lo += n
        cols = [pa.array(c, f.type) for c, f in zip(zip(*made), arrow)]
        return pa.table({"carry": table.column("carry").combine_chunks(), "out": pa.StructArray.from_arrays(cols, fields=list(arrow))})

    def settle(asked: DataFrame, checked: bool) -> DataFrame:
        return asked.groupBy("range").applyInArrow(answer(checked), bit_rows)

    # One plan, in which the texts are shuffled once.
    found = settle(view.groupBy("pack").applyInArrow(probe, blob), False)
    asked = view.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(extend, blob)
    return view.groupBy("pack").cogroup(settle(asked, True).groupBy("pack")).applyInArrow(remove, schema)


def substring_digest(docs: DataFrame) -> DataFrame:
    out = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def give(text: bytes | None, gone: np.ndarray) -> tuple:
        words = (text or b"").split()
        kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return repeated(docs, "text", ["doc_id"], out, give).select("carry.doc_id", "out.*")


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the words of repeated windows removed. A text that loses words is the others joined by
    spaces; every other text stays as it is, null texts too."""
    out = T.StructType([T.StructField("kept", T.StringType())])

    def give(text: bytes | None, gone: np.ndarray) -> tuple:
        return ((b" ".join(w for w, g in zip(text.split(), gone.tolist()) if not g) if gone.any() else text).decode() if text is not None else None,)

    made = repeated(docs, text_col, [c for c in docs.columns if c != text_col], out, give)
    return made.select(*[F.col("out.kept" if c == text_col else f"carry.{quoted(c)}").alias(c) for c in docs.columns])
