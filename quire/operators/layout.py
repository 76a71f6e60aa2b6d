"""Columns, lines, blocks and captions of a page: interval merging and gaps-and-islands over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import geometry as geo

from .filters import DOC

PAGE = [DOC, "page_number"]


def medians(elements: DataFrame, by: list[str], default: float = 20.0) -> DataFrame:
    """The exact median of positive heights."""
    return elements.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))), F.lit(default)).alias("median_height"))


def x_histogram(elements: DataFrame, bin_size: int = 5) -> DataFrame:
    """How many boxes cover each bin of a page's width."""
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("x1") / bin_size)), F.floor(F.col("x2") / bin_size)
    return elements.where("x2 >= x1 and x2 >= 0").select(*PAGE, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("bin")).groupBy(*PAGE, "bin").agg(F.count("*").alias("n_boxes"))


def columns_of(elements: DataFrame, gap: float = 0.05, bin_size: int = 5, least: float = 0.15) -> DataFrame:
    """(document, page, column_index, left, right): cut at the middle of runs of bins that no box covers.

    A run at the left margin counts, one at the right doesn't. Columns under ``least`` of the width are left out, and the rest numbered;
    a page without any has one from side to side.
    """
    dims = elements.groupBy(*PAGE).agg(F.max("x2").alias("far")).withColumn("width", F.greatest(F.col("far"), F.lit(1)))
    need = F.floor(F.floor(F.col("width") * gap) / bin_size)
    order = W.partitionBy(*PAGE).orderBy("bin")
    runs = (
        x_histogram(elements, bin_size).withColumn("start", F.coalesce(F.lag("bin").over(order), F.lit(-1)) + 1).withColumn("end", F.col("bin") - 1)
        .where("end >= start").join(dims, PAGE).where((F.col("end") - F.col("start") + 1) >= F.greatest(need, F.lit(1)))
        .select(*PAGE, "width", (F.floor((F.col("start") + F.col("end") + 1) / 2) * bin_size).alias("cut"))
    )
    edges = runs.select(*PAGE, "width", "cut").union(dims.select(*PAGE, "width", F.col("width").alias("cut")))
    order = W.partitionBy(*PAGE).orderBy("cut")
    spans = edges.withColumn("left", F.coalesce(F.lag("cut").over(order), F.lit(0))).withColumnRenamed("cut", "right").where(F.col("right") - F.col("left") >= F.col("width") * least)
    out = spans.withColumn("column_index", F.row_number().over(W.partitionBy(*PAGE).orderBy("left")) - 1)
    empty = dims.join(spans.select(*PAGE).distinct(), PAGE, "left_anti").select(*PAGE, F.lit(0).alias("column_index"), F.lit(0).cast("long").alias("left"), F.col("width").cast("long").alias("right"))
    return out.select(*PAGE, "column_index", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right")).unionByName(empty)


def with_column(elements: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """``elements`` with column_index: the first column that holds the middle of the box, or 0."""
    columns = columns_of(elements) if columns is None else columns
    listed = columns.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("column_index", "left", "right"))).alias("cols"))
    middle = (F.col("x1") + F.col("x2")) / 2
    inside = F.filter("cols", lambda c: (c["left"] <= middle) & (middle <= c["right"]))
    return elements.join(listed, PAGE, "left").withColumn("column_index", F.coalesce(F.try_element_at(inside, F.lit(1))["column_index"], F.lit(0))).drop("cols")


def with_lines(elements: DataFrame, by: list[str] | None = None, tolerance: float = 0.3) -> DataFrame:
    """``elements`` with line_id, from 0 on each page or column: a box that starts below all before it, by a tolerance, starts a line."""
    by = by or PAGE
    joined = elements.join(medians(elements, by), by)
    order = W.partitionBy(*by).orderBy("y1", "seq")
    far = F.max("y2").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("y1") > far + F.col("median_height") * tolerance, 1).otherwise(0)
    return joined.withColumn("new", new).withColumn("line_id", F.sum("new").over(order).cast("int")).drop("new")


def lines(with_ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or PAGE
    return with_ids.groupBy(*by, "line_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n_elements"), F.first("median_height").alias("median_height"), F.array_sort(F.collect_list(F.struct("x1", "seq", "label", "text_content"))).alias("parts"))


def blocks(with_ids: DataFrame, by: list[str] | None = None, gap: float = 1.5) -> DataFrame:
    """Lines joined while the gap to the one before is at most ``gap`` median heights."""
    by = by or PAGE
    order = W.partitionBy(*by).orderBy("line_id")
    each = lines(with_ids, by)
    new = F.when(F.col("y1") - F.lag("y2").over(order) > F.col("median_height") * gap, 1).otherwise(0)
    numbered = each.withColumn("new", new).withColumn("block_id", F.sum("new").over(order).cast("int"))
    labels = F.flatten(F.collect_list("parts.label"))
    made = numbered.groupBy(*by, "block_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n_lines"), F.sum("n_elements").alias("n_elements"), labels.alias("labels"))
    has = lambda *words: F.exists("labels", lambda x: F.lower(x).rlike("|".join(words)))
    kind = F.when(has("figure", "image"), "figure").when(has("table"), "table").when(has("title", "heading"), "heading").otherwise("text")
    return made.withColumn("block_type", kind).drop("labels")


def linked_captions(zoned: DataFrame) -> DataFrame:
    """(caption row, linked_to: seq of the figure or table, linked_zone): the nearest above or below within reach, the first of equals."""
    figures = zoned.where("zone in ('figure', 'table')").select(*PAGE, F.col("seq").alias("f_seq"), F.col("zone").alias("f_zone"), *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")])
    captions = zoned.where("zone = 'caption'")
    c, f = geo.box(), geo.box("f_")
    distance = F.when(c.y1 >= f.y1, c.y1 - f.y2).otherwise(f.y1 - c.y2)
    near = (distance >= 0) & (distance <= geo.height(f) * 0.15) & (F.abs(geo.centre(c)[0] - geo.centre(f)[0]) <= geo.width(f) * 0.5)
    pairs = captions.join(figures, PAGE).where(near).groupBy(*PAGE, "seq").agg(F.min(F.struct(distance.alias("d"), "f_seq", "f_zone")).alias("best"))
    return captions.join(pairs, [*PAGE, "seq"], "left").select(*captions.columns, F.col("best.f_seq").alias("linked_to"), F.col("best.f_zone").alias("linked_zone"))


def clusters(elements: DataFrame, threshold: float = 100.0, least: float = 0.3) -> DataFrame:
    """``elements`` with cluster_id: a new one where the start is too far from that of the element before."""
    order = W.partitionBy(DOC).orderBy("page_number", "y1", "seq")
    near = geo.proximity(F.lag("y1").over(order), F.col("y1"), threshold)
    return elements.withColumn("new", F.when(near <= least, 1).otherwise(0)).withColumn("cluster_id", F.sum("new").over(order).cast("int")).drop("new")


def by_page_and_column(elements: DataFrame) -> DataFrame:
    return with_column(elements).groupBy(*PAGE, "column_index").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("y1", "seq"))).alias("elements"))
