"""Paragraphs: neighbouring text elements merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import geometry as geo

from .filters import DOC
from .layout import PAGE, medians


def dynamic_gaps(elements: DataFrame, at: float = 0.7, factor: float = 1.5) -> DataFrame:
    """(document, gap): of the gaps between text elements down each page, all pages together, that at rank ``at``; else 1.5 medians."""
    rows = elements.where(F.lower("label") == "text")
    order = W.partitionBy(*PAGE).orderBy("y1", "seq")
    gaps = rows.withColumn("g", F.col("y1") - F.lag("y2").over(order)).where("g >= 0")
    rank = gaps.withColumn("r", F.row_number().over(W.partitionBy(DOC).orderBy("g", "page_number", "seq")) - 1).withColumn("n", F.count("*").over(W.partitionBy(DOC)))
    chosen = rank.where(F.col("r") == F.least((F.col("n") * at).cast("int"), F.col("n") - 1)).select(DOC, F.col("g").cast("double").alias("g"))
    return medians(elements, [DOC], 40.0).join(chosen, DOC, "left").select(DOC, F.coalesce("g", F.col("median_height") * factor).alias("gap"))


def with_groups(elements: DataFrame, gaps: DataFrame | None = None, multiplier: float | None = None) -> DataFrame:
    """``elements`` with group_id within each page: a text joins the text before it if it is close below and lies under it or starts where it does."""
    if gaps is None:
        gaps = dynamic_gaps(elements) if multiplier is None else medians(elements, [DOC], 40.0).select(DOC, (F.col("median_height") * multiplier).alias("gap"))
    order = W.partitionBy(*PAGE).orderBy("seq")
    prev = {c: F.lag(c).over(order) for c in ("label", "x1", "y1", "x2", "y2")}
    out = elements.join(gaps, DOC).withColumns({f"p_{c}": v for c, v in prev.items()})
    gap = F.col("y1") - F.col("p_y2")
    aligned = (geo.horizontal_overlap(geo.box("p_"), geo.box()) >= 0.5) | (F.abs(F.col("x1") - F.col("p_x1")) <= 10)
    joins = (F.lower("label") == "text") & (F.lower("p_label") == "text") & (gap >= 0) & (gap <= F.col("gap")) & aligned & (F.col("x1") - F.col("p_x1") < 30)
    new = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return out.withColumn("new", new).withColumn("group_id", F.sum("new").over(order).cast("int")).select(*elements.columns, "group_id")


def merged(grouped: DataFrame) -> DataFrame:
    """One row for each group, a paragraph where several elements were merged: box, joined text, their number and labels."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "label", F.coalesce("text_content", F.lit("")).alias("text_content"))))
    out = grouped.groupBy(*PAGE, "group_id").agg(rows.alias("rows"), *[f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    texts = F.filter(F.transform("rows", lambda r: r["text_content"]), lambda t: F.trim(t) != "")
    return out.select(
        *PAGE, F.col("rows")[0]["seq"].alias("seq"), F.when(F.size("rows") > 1, "paragraph").otherwise(F.col("rows")[0]["label"]).alias("label"),
        F.array_join(texts, " ").alias("text_content"), "x1", "y1", "x2", "y2", F.size("rows").alias("merged_from"), F.transform("rows", lambda r: r["label"]).alias("original_labels"),
    )


def thinned(elements: DataFrame, multiplier: float | None = None) -> DataFrame:
    return merged(with_groups(elements, multiplier=multiplier))


def thinned_top(nodes: DataFrame, multiplier: float | None = None) -> DataFrame:
    """The nodes at the top of each tree, merged among themselves; lower ones are left to their own pass."""
    return thinned(nodes.where("parent_idx is null"), multiplier)


def stats(before: DataFrame, after: DataFrame) -> DataFrame:
    count = lambda df, n: df.groupBy(DOC).agg(F.count("*").alias(n))
    out = count(before, "n_before").join(count(after, "n_after"), DOC)
    return out.withColumn("reduction_pct", F.bround((1 - F.col("n_after") / F.col("n_before")) * 100, 1))
