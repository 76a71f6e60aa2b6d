"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions go through low-rank factors and are summed by half the square of the sum less the sum of the
squares, in time linear in the features. It is fitted on the driver, on a sample of labelled rows of bounded
size, chosen by a hash of the id; all rows are scored. Neither labels nor language, source or id are features.

Null and empty texts have the features of no words and get a score. Without labelled rows all scores are 0.5. A row without an id
is never held out nor learnt from; of several labels of an id the largest counts. Repeated rows score alike.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, map_text, quoted

#: Labelled rows that are learnt from at most; words' hash buckets; rank of the factors; passes over the sample.
SAMPLE, BUCKETS, RANK, PASSES, SEED = 6000, 1 << 14, 8, 6, 7
THRESHOLD = 0.7
_STATS = 64  # buckets to a statistic
_KINDS = {
    "symbols": b"#*$%&|<>~^=_{}[]\\", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "marks": b"!?;:", "stops": b".,", "breaks": b"\n",
}
FEATURES = BUCKETS + _STATS * (len(_KINDS) + 5)


def _level(share: float) -> int:
    """A share from 0 to 1 in steps that are finer near 0."""
    return min(_STATS - 1, int((share**0.5) * (_STATS - 1) + 0.5))


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: distinct words share a unit of length, each statistic's bucket is one."""
    data = text.encode()
    words = data.split()
    distinct = set(words)
    hashed = np.unique(np.fromiter((zlib.crc32(w) % BUCKETS for w in distinct), dtype=np.int64, count=len(distinct)))
    size = max(1, len(data))
    levels = [_level((len(data) - len(data.translate(None, kind))) / size) for kind in _KINDS.values()]
    lines = data.split(b"\n")
    levels.append(_level(len(distinct) / max(1, len(words))))
    levels.append(min(_STATS - 1, size // max(1, len(words))))
    levels.append(min(_STATS - 1, 2 * len(words).bit_length()))
    levels.append(_level(len(set(lines)) / len(lines)))
    levels.append(0 if n_chars is None else 1 + min(_STATS - 2, max(0, int(n_chars)).bit_length()))  # metadata
    stats = BUCKETS + _STATS * np.arange(len(levels)) + np.array(levels)
    values = np.concatenate([np.full(len(hashed), 1 / max(1, len(hashed)) ** 0.5), np.ones(len(stats))])
    return np.concatenate([hashed, stats]), values


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        total = vx.sum(axis=0)
        return self.bias + float(self.weights[at] @ x) + 0.5 * float((total * total).sum() - (vx * vx).sum())

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = PASSES, rate: float = 0.1, decay: float = 1e-5, batch: int = 64) -> Machine:
    """By AdaGrad on the logistic loss."""
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK))
    gw, gv = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6)
    if not len(labels):
        return Machine(0.0, w, np.zeros_like(v))
    share = min(max(labels.mean(), 0.01), 0.99)
    bias = float(np.log(share / (1 - share)))
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at = np.concatenate([rows[r][0] for r in some])
            x = np.concatenate([rows[r][1] for r in some])
            starts = np.concatenate([[0], np.cumsum([len(rows[r][0]) for r in some])])[:-1]
            owner = np.repeat(np.arange(len(some)), [len(rows[r][0]) for r in some])
            vx = v[at] * x[:, None]
            total = np.add.reduceat(vx, starts)
            raw = bias + np.add.reduceat(w[at] * x, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            e = err[owner]
            bias -= rate * float(err.sum())
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, e * x, minlength=len(used)) + decay * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            part = (e * x)[:, None] * (total[owner] - vx)
            dv = np.stack([np.bincount(back, part[:, f], minlength=len(used)) for f in range(RANK)], 1) + decay * v[used]
            gv[used] += dv * dv
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return Machine(bias, w, v)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled rows that aren't held out."""
    known = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    text = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), _chars(docs, chars_col))
    chosen = text.join(F.broadcast(known), "id")  # at most ``sample`` ids and labels
    out = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())])

    def make():
        def pack(t: str, n: int | None) -> tuple:
            at, x = features(t, n)
            return at.astype("<u2").tobytes() if FEATURES <= 65536 else at.astype("<u4").tobytes(), x.astype("<f4").tobytes()

        return pack

    made = flat(map_text(chosen, "text", out, make, ["id", "label"], ["n_chars"]))
    # Rows that share an id would go beyond the bound; of them the same one counts however tasks are run.
    rows = made.groupBy("id").agg(F.min(F.struct("label", "at", "x")).alias("r")).select("id", "r.*").orderBy("id").collect()
    kind = "<u2" if FEATURES <= 65536 else "<u4"
    pairs = [(np.frombuffer(r["at"], kind).astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in rows]
    return fit(pairs, np.array([r["label"] for r in rows], dtype=np.float64))


def _chars(docs: DataFrame, chars_col: str | None):
    return (F.col(quoted(chars_col)).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    out = T.StructType([T.StructField("score", T.DoubleType())])
    weights, factors, bias = machine.weights.astype(np.float32), machine.factors.astype(np.float32), machine.bias
    view = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), _chars(docs, chars_col))
    sent = docs.sparkSession.sparkContext.broadcast((bias, weights, factors))  # FEATURES * (RANK + 1) numbers

    def make():
        model = Machine(*sent.value)
        return lambda t, n: (model.score(*features(t, n)),)

    scored = flat(map_text(view, "text", out, make, ["id"], ["n_chars"]))
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
