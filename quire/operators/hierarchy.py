"""Heading levels by scores of label, whitespace, size, height on the page and indentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import geometry as geo
from quire.functions import text as txt

from .filters import DOC, page_dims
from .layout import medians

#: The four weights of a score without neighbours.
FOUR = {"label": 0.4, "size": 0.3, "vertical": 0.2, "indent": 0.1}


def classified(elements: DataFrame, factor: float = 1.1) -> DataFrame:
    """``elements`` with the parts of the score, spatial_score and spatial_level, without regard to neighbours: their whitespace is 0.65."""
    b, w, h = geo.box(), F.col("width"), F.col("height")
    out = elements.join(page_dims(elements, factor), DOC)
    score = F.lit(0.0)
    parts = {"label": geo.label_weight(F.col("label")), "size": geo.size_score(b, w, h), "vertical": geo.vertical_score(b, h), "indent": geo.indent_score(b, w)}
    for name, weight in FOUR.items():
        score = score + parts[name] * F.lit(weight)
    level = geo.level_of(geo.hierarchy_score(F.col("label"), b, w, h, F.lit(0.65)))
    return out.select(*elements.columns, F.struct(*[p.alias(n) for n, p in parts.items()]).alias("components"), score.alias("spatial_score"), level.alias("spatial_level"))


def levels(ordered: DataFrame, factor: float = 1.1, thresholds: dict | None = None) -> DataFrame:
    """``ordered(page_number, read_idx)`` with whitespace, spatial_score and spatial_level, by neighbours in reading order."""
    order = W.partitionBy(DOC).orderBy("page_number", "read_idx")
    b, w, h = geo.box(), F.col("width"), F.col("height")
    out = ordered.join(page_dims(ordered, factor), DOC).join(medians(ordered, [DOC]), DOC)
    out = out.withColumn("whitespace", geo.whitespace_score(b, F.lag("y2").over(order), F.lead("y1").over(order), F.col("median_height")))
    out = out.withColumn("spatial_score", geo.hierarchy_score(F.col("label"), b, w, h, F.col("whitespace")))
    return out.select(*ordered.columns, "whitespace", "spatial_score").withColumn("spatial_level", geo.level_of(F.col("spatial_score"), thresholds))


def adaptive_thresholds(scored: DataFrame) -> DataFrame:
    """(document, t0..t4): the 95th, 80th, 60th, 40th and 20th percentiles of the scores, interpolated."""
    at = F.percentile("spatial_score", F.array(*[F.lit(p) for p in (0.95, 0.8, 0.6, 0.4, 0.2)]))
    return scored.groupBy(DOC).agg(at.alias("p")).select(DOC, *[F.col("p")[i].alias(f"t{i}") for i in range(5)])


def adaptive_levels(scored: DataFrame) -> DataFrame:
    out = scored.join(adaptive_thresholds(scored), DOC)
    return out.withColumn("spatial_level", geo.level_of(F.col("spatial_score"), {i: F.col(f"t{i}") for i in range(5)})).drop(*[f"t{i}" for i in range(5)])


def with_markdown(leveled: DataFrame) -> DataFrame:
    """``leveled`` with markdown_level, final_level and level_source: where both speak and are over 1 apart, their mean, truncated."""
    md, sp = F.col("markdown_level"), F.col("spatial_level")
    out = leveled.withColumn("markdown_level", txt.markdown_level(F.col("text_content")))
    apart = F.abs(md - sp) > 1
    return out.withColumn("final_level", F.when(apart, (md * 0.5 + sp * 0.5).cast("int")).otherwise(sp)).withColumn(
        "level_source", F.when(md.isNull(), "spatial_only").when(apart, "blended").otherwise("spatial_validated")
    )
