"""Sampled segmentation over a sentence-piece vocabulary: forward filtering, backward sampling.

A text is cut where no piece can cross: before single spaces and around line ends. All ways to
cover such a chunk with pieces form a lattice. A piece's weight falls with its rank in the vocabulary, and
``alpha`` flattens or sharpens the weights. The forward pass sums the weights of all ways up to each place; the
backward pass draws the pieces from the end, each with its exact probability given those behind it. Characters that the
vocabulary lacks are spelled in bytes, and so is the vocabulary's own sign for a space, so decoding gives back every text.

Draws come from a counter hashed with the row's key, so they depend on neither partitioning nor batches. A null
key counts as 0, rows with the same key and text get the same pieces; null texts count as empty and have no pieces.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, flat, kept, map_text, mix64, quoted
from .vocab import public_path

ALPHA = 0.3
_CHUNK = re.compile(r" ?[^ \n]+|\n+| +(?=[ \n]|$)")
_BLANK = "▁"
#: Edges that one worker remembers, and bytes of text that it samples at a time.
ROOM, BATCH = 3_000_000, 2 << 20


class Lattices:
    """The lattices of the chunks met so far, as rows of edges: row ``first + i`` of a chunk holds the edges that end behind
    its character i, longest first, with their running probabilities."""

    def __init__(self, path: str, alpha: float) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.weight = np.zeros(n)
        self.text: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        states: dict[tuple[int, int], int] = {}  # (state, character) -> state of the trie of all pieces
        ends = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            # Scores fall with the rank in the vocabulary; a byte counts as the last of it.
            self.weight[i] = -alpha * math.log(2 + n if model.is_byte(i) else 2 - min(0.0, model.get_score(i)))
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if _BLANK in piece.lstrip(_BLANK) or "\n" in piece:
                    raise ValueError(f"a piece crosses a cut: {piece!r}")
                self.text[i] = piece.replace(_BLANK, " ").encode()
                at = 0
                for c in piece:
                    at = states.setdefault((at, ord(c)), len(states) + 1)
                ends[at] = i
        keys = np.array([s << 21 | c for s, c in states], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(states.values()), dtype=np.int64)[order]
        self.piece = np.full(len(states) + 1, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.first, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.rows = np.zeros(1, dtype=np.int64)
        self.cum, self.back, self.ids = np.zeros(0), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _add(self, chunks: list[str]) -> None:
        joined = "".join(chunks)
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        raw = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        # A space stands for the vocabulary's sign; that sign itself, in a text, matches nothing.
        code = np.where(raw == 32, ord(_BLANK), np.where(raw == ord(_BLANK), 0x10FFFF + 1, raw))
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(code)) - np.repeat(begin, sizes)
        left = np.repeat(sizes, sizes) - place
        # All pieces that start at each place, by one step down the trie for all places at a time.
        alive, state, depth = np.arange(len(code)), np.zeros(len(code), dtype=np.int64), 0
        starts, lengths, ids = [], [], []
        while len(alive):
            key = state << 21 | code[alive + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            alive, state = alive[on], self.to[at[on]]
            depth += 1
            found = self.piece[state]
            some = found >= 0
            starts.append(alive[some])
            lengths.append(np.full(int(some.sum()), depth, dtype=np.int32))
            ids.append(found[some])
            more = left[alive] > depth
            alive, state = alive[more], state[more]
        # A character that is no piece is spelled: its edge holds the character's code, below zero.
        single = np.zeros(len(code), dtype=bool)
        single[starts[0]] = True
        spelled = np.flatnonzero(~single)
        if len(spelled):
            starts.append(spelled)
            lengths.append(np.ones(len(spelled), dtype=np.int32))
            ids.append((-1 - raw[spelled]).astype(np.int32))
        start, length, ids = np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)
        end = start + length - 1  # the row: the character behind which the edge ends
        order = np.lexsort((-length, end))
        start, length, ids, end = start[order], length[order], ids[order], end[order]
        c = -1 - ids[ids < 0]
        w = np.empty(len(ids))
        w[ids >= 0] = self.weight[ids[ids >= 0]]
        w[ids < 0] = (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) * self.weight[self.byte_id[0]]
        rows = np.concatenate([np.searchsorted(end, np.arange(len(code))), [len(end)]])
        # Forward, all chunks at a time: the sum over all ways up to each place.
        total = np.zeros(len(code) + 1)  # by row
        cum = np.empty(len(ids))
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(int(sizes.max()) + 1)).tolist()
        inner = place[start] > 0
        before = np.where(inner, start - 1, len(code))  # total stays 0 there
        for lo, hi in zip(cuts, cuts[1:]):
            r = np.sort(by_place[lo:hi])
            n = rows[r + 1] - rows[r]
            group = np.cumsum(n) - n
            e = np.arange(int(n.sum())) + np.repeat(rows[r] - group, n)
            logs = total[before[e]] + w[e]
            top = np.maximum.reduceat(logs, group)
            share = np.exp(logs - np.repeat(top, n))
            whole = np.add.reduceat(share, group)
            total[r] = top + np.log(whole)
            running = np.cumsum(share / np.repeat(whole, n))
            cum[e] = running - np.repeat(np.concatenate([[0.0], running])[group], n)
        cum[rows[1:] - 1] = 2.0  # the last edge takes what is left
        for i, c in enumerate(chunks, len(self.first)):
            self.number[c] = i
        self.first = np.concatenate([self.first, begin + len(self.rows) - 1])
        self.size = np.concatenate([self.size, sizes])
        self.rows = np.concatenate([self.rows, rows[1:] + len(self.cum)])
        self.cum, self.back, self.ids = np.concatenate([self.cum, cum]), np.concatenate([self.back, length]), np.concatenate([self.ids, ids])

    def find(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.cum) > ROOM:
            self._clear()
        if new := list(set(chunks).difference(self.number)):
            self._add(new)
        at = np.array(list(map(self.number.__getitem__, chunks)), dtype=np.int64)
        return self.first[at], self.size[at]

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The ids of one drawn segmentation of each text."""
        cut = [_CHUNK.findall(t) for t in texts]
        counts = np.array([len(c) for c in cut], dtype=np.int64)
        first, left = self.find([c for part in cut for c in part])
        seed = np.repeat(mix64(np.array(keys, dtype=np.int64).view(np.uint64)), counts)
        place = np.arange(len(left), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
        state = mix64(seed ^ mix64(place))
        taken = np.zeros(len(left), dtype=np.int64)
        drawn = []
        open_ = np.arange(len(left))
        while len(open_):
            state = mix64(state + GOLDEN)
            u = (state >> np.uint64(11)) * 2.0**-53
            edge = self.rows[first + left - 1]
            late = np.flatnonzero(self.cum[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.cum[edge[late]] <= u[late]]
            drawn.append((open_, edge))
            taken[open_] += 1
            left = left - self.back[edge]
            go = left > 0
            open_, left, first, state = open_[go], left[go], first[go], state[go]
        ends = np.cumsum(taken)
        edges = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        for step, (at, edge) in enumerate(drawn):
            edges[ends[at] - 1 - step] = edge
        ids, upto = self._spelled(self.ids[edges], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
        return [ids[lo:hi] for lo, hi in zip(upto, upto[1:])]

    def _spelled(self, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids with the bytes of each character that is held below zero, and where what ended at ``upto`` ends now."""
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return ids, upto.tolist()
        c = -1 - ids[at]
        more = np.zeros(len(ids) + 1, dtype=np.int64)  # bytes but one of the characters before each place
        more[at + 1] = 0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        size = more[at + 1] + 1
        more = np.cumsum(more)
        out = np.empty(len(ids) + int(more[-1]), dtype=np.int32)
        out[np.arange(len(ids)) + more[:-1]] = ids
        spelled = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        begin = np.cumsum(size) - size
        out[np.repeat(at + more[at] - begin, size) + np.arange(len(spelled))] = self.byte_id[spelled]
        return out, (upto + more[upto]).tolist()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode()


def _key(column: str):
    return F.coalesce(F.col(quoted(column)).cast("long"), F.lit(0))


def _sampled(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, alpha: float, out: T.StructType, give) -> DataFrame:
    path = vocabulary or public_path("piece_bpe_32k.model")
    view = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).alias("text"), _key(id_col).alias("key"))

    def make():
        lattices = kept(Lattices, path, alpha)
        return lambda texts, keys: [give(lattices, t, ids) for t, ids in zip(texts, lattices.sample(texts, keys))]

    return flat(map_text(view, "text", out, make, [id_col], ["key"], whole=True, limit=BATCH))


def sample_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """(id, pieces: array of ids) for every row; the id is the key of the draws."""
    out = T.StructType([T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return _sampled(docs, id_col, text_col, vocabulary, alpha, out, lambda lattices, text, ids: (ids,))


def decode_pieces(rows: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", vocabulary: str | None = None) -> DataFrame:
    """(id, text) of every row of ids."""
    path = vocabulary or public_path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def text(pieces):
        lattices = kept(Lattices, path, ALPHA)
        return pieces.map(lattices.decode)

    return rows.select(id_col, text(F.col(quoted(pieces_col))).alias("text"))


def piece_digest(docs: DataFrame) -> DataFrame:
    """How many pieces each document got, their checksum, and whether decoding them gave its text."""
    out = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())])
    return _sampled(docs, "doc_id", "text", None, ALPHA, out, lambda lattices, text, ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), lattices.decode(ids) == text))
