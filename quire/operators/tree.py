"""Trees as flat rows: parents, depths, subtrees, thinning and exports by windows and joins over pre-order numbers."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quire.profiles import one_task_an_executor

KEY = "document_id"


def with_parents(rows: DataFrame, by: list[str], idx: str = "idx", level: str = "level", levels: range | None = range(0, 6)) -> DataFrame:
    """``rows`` with parent_idx, the last row before with a smaller level (null: the root), and depth, from 0 at the top.

    For each level the last row of it is a running maximum; the parent is the greatest of those of smaller levels,
    and an ancestor of level k is one that none of a smaller level follows. A level outside ``levels`` is an error, as its rows would get wrong
    parents; with None the levels are those of the data.
    """
    if levels is None:
        first, last_ = rows.agg(F.min(level), F.max(level)).first()
        levels = range(first or 0, (last_ or 0) + 1)
    wrong = F.raise_error(F.concat(F.lit(f"level outside {levels.start} to {levels.stop - 1}: "), F.col(level).cast("string")))
    kind = rows.schema[level].dataType
    rows = rows.withColumn(level, F.when(F.col(level).isNull() | F.col(level).between(levels.start, levels.stop - 1), F.col(level)).otherwise(wrong.cast(kind)))
    past = W.partitionBy(*by).orderBy(idx).rowsBetween(W.unboundedPreceding, -1)
    last = {k: f"_last{k}" for k in levels}
    out = rows.withColumns({c: F.max(F.when(F.col(level) == k, F.col(idx))).over(past) for k, c in last.items()})
    seen = {k: F.when(F.lit(k) < F.col(level), F.coalesce(F.col(c), F.lit(-1))).otherwise(F.lit(-1)) for k, c in last.items()}
    parent = F.greatest(F.lit(-1), F.lit(-1), *seen.values())
    depth = F.lit(0)
    for k in levels:
        above = [F.coalesce(F.col(last[m]), F.lit(-1)) for m in levels if m < k]
        alive = (F.lit(k) < F.col(level)) & F.col(last[k]).isNotNull()
        depth = depth + F.when(alive & (F.col(last[k]) > F.greatest(F.lit(-1), F.lit(-1), *above)), 1).otherwise(0)
    return out.withColumn("parent_idx", F.when(parent >= 0, parent)).withColumn("depth", depth).drop(*last.values())


def with_ends(rows: DataFrame, by: list[str], idx: str = "idx", level: str = "level", levels: range = range(0, 7)) -> DataFrame:
    """``rows`` with end_idx: the first row after that isn't below (exclusive end of the subtree)."""
    ahead = W.partitionBy(*by).orderBy(idx).rowsBetween(1, W.unboundedFollowing)
    total = F.count("*").over(W.partitionBy(*by))
    nxt = {k: F.min(F.when(F.col(level) == k, F.col(idx))).over(ahead) for k in levels}
    stop = None
    for k in levels:
        here = F.when(F.lit(k) <= F.col(level), F.col(f"_next{k}"))
        stop = [here] if stop is None else [*stop, here]
    out = rows.withColumns({f"_next{k}": v for k, v in nxt.items()}).withColumn("_n", total)
    return out.withColumn("end_idx", F.coalesce(F.least(*stop), F.col("_n"))).drop("_n", *[f"_next{k}" for k in levels])


def subtree_tokens(rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """``rows(idx, end_idx)`` with tokens of own and all lower texts, joined by line ends, empty ones left out.

    Numbers run from 0 without gaps, as ``with_ends`` wants them: a subtree is the difference of two running sums.
    """
    length = F.coalesce(F.length(F.col(text)), F.lit(0))
    so_far = F.sum("_size").over(W.partitionBy(*by).orderBy("idx"))
    summed = rows.withColumn("_size", (length + F.when(length > 0, 1).otherwise(0)).cast("long")).withColumn("_upto", so_far)
    last = summed.select(*by, (F.col("idx") + 1).alias("end_idx"), F.col("_upto").alias("_through"))
    joined = F.greatest(F.col("_through") - F.col("_upto") + F.col("_size") - 1, F.lit(0))
    return summed.join(last, [*by, "end_idx"], "left").withColumn("token_count", F.floor(joined / 4).cast("int")).select(*rows.columns, "token_count")


def thin(rows: DataFrame, by: list[str], threshold: int, text: str = "text") -> DataFrame:
    """Small subtrees merged into their top: rows below a small one go, and a small one that stays takes their texts.

    Subtrees are nested or apart, so a row is below a small one if the furthest end of those before it lies behind it,
    and the small one that it goes to is the last that stays.
    """
    order = W.partitionBy(*by).orderBy("idx")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    small = F.coalesce(F.col("token_count") < threshold, F.lit(False))
    marked = rows.withColumn("_stays", F.coalesce(F.max(F.when(small, F.col("end_idx"))).over(before) <= F.col("idx"), F.lit(True)))
    top = F.last(F.when(F.col("_stays") & small, F.struct("idx", "end_idx")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    owned = marked.withColumn("_top", top).where(F.col("_top.end_idx") > F.col("idx"))
    texts = (
        owned.groupBy(*by, F.col("_top.idx").alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("d_idx"), F.col(text).alias("d_text")))).alias("t"))
        .withColumn("joined", F.array_join(F.transform(F.filter("t", lambda x: F.trim(x["d_text"]) != ""), lambda x: x["d_text"]), "\n\n"))
    )
    out = marked.where("_stays").drop("_stays").join(texts.select(*by, "idx", "joined"), [*by, "idx"], "left")
    tokens = F.when(F.col("joined").isNotNull(), F.floor(F.length("joined") / 4).cast("int")).otherwise(F.col("token_count"))
    return out.withColumn("token_count", tokens).withColumn(text, F.coalesce("joined", text)).drop("joined")


def without_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Nodes without some of their fields; names that they don't have are passed over."""
    return rows.drop(*fields)


def in_order(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Nodes with these of their fields only, in this order, after their keys."""
    have = set(rows.columns)
    return rows.select(*by, *[f for f in fields if f in have and f not in by])


def leaves(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(rows.where("parent_idx is not null").select(*by, F.col("parent_idx").alias("idx")).distinct(), [*by, "idx"], "left_anti")


def depth_and_count(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.max("depth") + 1).cast("int").alias("tree_depth"), F.count("*").alias("node_count"))


def node_id(number: Column) -> Column:
    """Four digits, more where they don't suffice."""
    return F.format_string("%04d", number)


def with_node_ids(rows: DataFrame, by: list[str], idx: str = "idx", first: int = 0) -> DataFrame:
    return rows.withColumn("node_id", node_id(F.row_number().over(W.partitionBy(*by).orderBy(idx)) - 1 + first))


def _outline_line(title: str) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col(title))


def _markdown_part(title: str, text: str | None) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6))), F.lit(" "), F.col(title), *([F.lit("\n\n"), F.col(text)] if text else []))


def outline(rows: DataFrame, by: list[str], title: str = "title") -> DataFrame:
    """Indented titles, as one text for each tree."""
    line = F.struct("idx", _outline_line(title).alias("l"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("ls")).select(*by, F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("outline"))


def as_markdown(rows: DataFrame, by: list[str], title: str = "title", text: str | None = None) -> DataFrame:
    body = _markdown_part(title, text)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", body.alias("l")))).alias("ls")).select(*by, F.array_join(F.transform("ls", lambda x: x["l"]), "\n\n").alias("markdown"))


class _Text:
    """A text that grows piece by piece: in memory while it is short, else in a file without a name, which takes no memory of the process."""

    SHORT = 4 << 20

    def __init__(self):
        self.recent, self.file, self.size = bytearray(), None, 0

    def add(self, piece: memoryview) -> None:
        self.recent += piece
        self.size += len(piece)
        if len(self.recent) > self.SHORT:
            self.file = self.file or tempfile.TemporaryFile(buffering=0)
            self._put()

    def _put(self) -> None:
        rest = memoryview(self.recent)
        while rest:
            rest = rest[self.file.write(rest) :]
        self.recent = bytearray()

    def buffer(self) -> pa.Buffer:
        if self.file is None:
            return pa.py_buffer(self.recent)
        self._put()
        return pa.py_buffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ))


def _run_together(n_keys: int, ends: list[int]) -> Callable:
    """Batches of keys and pieces in the order of the trees to one row a tree: its keys, and its pieces of each kind one after another without the last
    ``ends`` bytes. A batch has the pieces of a tree side by side, so that they are taken in one go."""

    def run(batches):
        keys, texts = None, []

        def tree():
            sizes = [max(0, t.size - end) for t, end in zip(texts, ends)]
            if max(sizes) >= 2**31:
                raise ValueError(f"a tree's text of {max(sizes)} bytes doesn't fit in one value")
            made = [pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, size], np.int32)), t.buffer()) for t, size in zip(texts, sizes)]
            return pa.RecordBatch.from_arrays([*keys.columns, *made], names=[str(i) for i in range(n_keys + len(ends))])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:n_keys]]
            starts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1), batch.num_rows]
            columns = [c.cast(pa.large_string()) for c in batch.columns[n_keys:]]
            offsets = [np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] for c in columns]
            for a, b in zip(starts, starts[1:]):
                # Copied, as a slice keeps all of its batch.
                here = batch.select(range(n_keys)).take(pa.array([a]))
                if keys is None or not keys.equals(here):
                    if keys is not None:
                        yield tree()
                    keys, texts = here, [_Text() for _ in ends]
                for t, c, at in zip(texts, columns, offsets):
                    if at[a] < at[b]:
                        t.add(memoryview(c.buffers()[2])[at[a] : at[b]])
        if keys is not None:
            yield tree()

    return run


def apart(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` dealt by ranges of their trees, so that a task has one large tree or some small ones: hashing puts large ones together."""
    # The number is given, as Spark would else put ranges together again.
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def outline_and_markdown(rows: DataFrame, by: list[str], title: str = "title", text: str | None = None, dealt: bool = False) -> DataFrame:
    """What ``outline`` and ``as_markdown`` give, side by side, without a join of whole texts or a list of a tree's lines.

    Nodes pass by in order and a tree's texts grow outside the JVM, long ones in files, and it gets each of them once, as the value of a row. That row must still fit
    with all that Spark and a writer of Parquet copy of it until the task ends: under a heap of 1800 MB texts of 100 and 200 MB were written, 150 and 300 weren't.
    An executor has one such task at a time. ``dealt``: no tree is in two partitions, as after ``apart`` and windows over trees, and ``rows`` aren't dealt again.
    """
    pieces = {"outline": (_outline_line(title), "\n"), "markdown": (_markdown_part(title, text), "\n\n")}
    schema = T.StructType([*rows.select(*by).schema.fields, *[T.StructField(n, T.StringType()) for n in pieces]])
    needed = rows.select(*dict.fromkeys([*by, "idx", "depth", title, *([text] if text else [])]))
    ordered = (needed if dealt else apart(needed, by)).sortWithinPartitions(*by, "idx")
    ready = ordered.select(*by, *[F.coalesce(F.concat(c, F.lit(sep)), F.lit("")).alias(n) for n, (c, sep) in pieces.items()])
    return ready.mapInArrow(_run_together(len(by), [len(sep) for _, sep in pieces.values()]), schema, profile=one_task_an_executor(rows.sparkSession))


def summary_lines(rows: DataFrame, by: list[str], limit: int = 20) -> DataFrame:
    line = F.struct("idx", F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("summary")).alias("l"))
    return rows.where("summary is not null").groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(line)), 1, limit).alias("ls")).select(*by, F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("lines"))


def nested_json(rows: DataFrame, by: list[str], fields: list[str], depths: int | None = None) -> DataFrame:
    """Each tree as nested JSON text, built from the lowest depth of the data up, or from the last of ``depths``; null fields and empty lists of children are left out."""
    empty = F.array().cast("array<string>")
    now = rows.select(*by, "idx", "parent_idx", "depth", *fields)
    if depths is None:
        depths = max(0, now.agg(F.max("depth")).first()[0] or 0) + 1
    done = None
    for d in range(depths - 1, -1, -1):
        here = now.where(F.col("depth") == d)
        if done is None:
            here = here.withColumn("kids", empty)
        else:
            kids = done.groupBy(*by, F.col("parent_idx").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "json"))), lambda x: x["json"]).alias("kids"))
            here = here.join(kids, [*by, "idx"], "left").withColumn("kids", F.coalesce("kids", empty))
        flat = F.to_json(F.struct(*fields))
        with_kids = F.concat(F.expr("left(j, length(j) - 1)"), F.when(F.length("j") > 2, F.lit(",")).otherwise(F.lit("")), F.lit('"children":['), F.array_join("kids", ","), F.lit("]}"))
        done = here.withColumn("j", flat).withColumn("json", F.when(F.size("kids") > 0, with_kids).otherwise(F.col("j"))).select(*by, "idx", "parent_idx", "json")
    return done.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "json"))), lambda x: x["json"]), ",").alias("j")).select(*by, F.concat(F.lit("["), F.col("j"), F.lit("]")).alias("tree"))


def nested_json_in_order(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """What ``nested_json`` gives, for trees whose rows come depth first by ``idx``, as ``with_parents`` makes them: each node's text opens it and
    closes what ends with it, so that any number of depths takes one window and one aggregation."""
    w = W.partitionBy(*by).orderBy("idx")
    before, after, j = F.lag("depth").over(w), F.lead("depth").over(w), F.to_json(F.struct(*fields))
    comma = F.when(before >= F.col("depth"), F.lit(",")).otherwise(F.lit(""))
    opened = F.concat(F.expr("left(j, length(j) - 1)"), F.when(F.length("j") > 2, F.lit(",")).otherwise(F.lit("")), F.lit('"children":['))
    closed = F.concat("j", F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("after", F.lit(0))))
    texts = rows.select(*by, "idx", "depth", comma.alias("comma"), after.alias("after"), j.alias("j")).select(
        *by, "idx", F.concat("comma", F.when(F.col("after") > F.col("depth"), opened).otherwise(closed)).alias("text")
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "")
    return texts.groupBy(*by).agg(F.concat(F.lit("["), whole, F.lit("]")).alias("tree"))
