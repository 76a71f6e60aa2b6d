"""Zones of a page: by label, position, text and geometry, and all of these by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import geometry as geo
from quire.functions import text as txt

from .filters import DOC, page_dims, repeated_forms

#: Fixed values.
LABEL_ZONES = {
    "title": "title_block", "sub_title": "section_heading", "subtitle": "section_heading", "heading": "section_heading", "header": "header", "figure": "figure", "table": "table",
    "caption": "caption", "footnote": "footnote", "footer": "footer", "page_number": "page_number", "equation": "equation", "formula": "equation",
}
ZONE_PRIORITY = {
    "title_block": 0, "author_block": 1, "abstract": 2, "section_heading": 3, "main_text": 4, "figure": 5, "table": 5, "caption": 6,
    "equation": 4, "footnote": 8, "header": 9, "footer": 10, "page_number": 10, "sidebar": 7, "unknown": 5,
}


def _found(zone: str | Column, confidence: float, method: str) -> Column:
    return F.struct((F.lit(zone) if isinstance(zone, str) else zone).alias("zone"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def by_label(label: Column = None) -> Column:
    zone = F.try_element_at(F.create_map(*[F.lit(x) for p in LABEL_ZONES.items() for x in p]), F.lower(F.trim(F.col("label") if label is None else label)))
    return F.when(zone.isNotNull(), _found(zone, 0.8, "label"))


def by_position(width: Column, height: Column) -> Column:
    b = geo.box()
    part = lambda v, side: F.when(side > 0, v / side).otherwise(F.lit(0.0))
    top, bottom, tall = part(b.y1, height), part(b.y2, height), part(geo.height(b), height)
    middle = (part(b.x1, width) + part(b.x2, width)) / 2
    return (
        F.when((top > 0.92) & (tall < 0.03) & (middle > 0.4) & (middle < 0.6), _found("page_number", 0.85, "position"))
        .when((top > 0.9) & (tall < 0.08), _found("footer", 0.7, "position"))
        .when((bottom < 0.1) & (tall < 0.08), _found("header", 0.7, "position"))
        .when((top > 0.85) & (tall < 0.12), _found("footnote", 0.6, "position"))
    )


def by_text(text: Column = None) -> Column:
    raw = txt.stripped(F.coalesce(F.col("text_content") if text is None else text, F.lit("")))
    plain = txt.without_html(raw)
    return (
        F.when(txt.any_of(raw, txt.CAPTIONS) | txt.any_of(plain, txt.CAPTIONS), _found("caption", 0.9, "pattern"))
        .when(txt.any_of(plain, txt.PAGE_NUMBERS), _found("page_number", 0.85, "pattern"))
        .when(txt.any_of(plain, txt.SECTIONS) & (F.length(plain) < 200), _found("section_heading", 0.8, "pattern"))
        .when(F.lower(plain).startswith("abstract"), _found("abstract", 0.85, "pattern"))
    )


def by_geometry(width: Column, height: Column) -> Column:
    b, label = geo.box(), F.lower(F.col("label"))
    w, h = geo.width(b), geo.height(b)
    some = (w > 0) & (h > 0) & (width > 0) & (height > 0)
    flat = (w / F.when(h > 0, h) > 0.7) & (h / height < 0.1) & (w / width > 0.3)
    return F.when(some & (label == "figure"), _found("figure", 0.9, "geometry")).when(some & flat & label.isin("equation", "formula"), _found("equation", 0.8, "geometry"))


def classified(elements: DataFrame, repeated: DataFrame | None = None, factor: float = 1.1) -> DataFrame:
    """``elements`` with zone, zone_confidence, zone_method and zone_priority.

    A repeated header or footer is one; else the first sure enough of label, text, position and geometry counts, else the first of label, text,
    position and geometry that says anything, else it is main text.
    """
    columns = elements.columns
    keyed = repeated_forms(elements) if repeated is None else repeated.select(DOC, txt.digest(F.col("form")).alias("key"), "zone")
    keyed = keyed.where("zone in ('header', 'footer')").select(DOC, F.col("key").alias("_form"), F.col("zone").alias("_rep_zone"))
    w, h = F.col("width"), F.col("height")
    form = txt.digest(txt.matching_form(F.col("text_content")))
    out = elements.join(page_dims(elements, factor), DOC).select(*columns, form.alias("_form"), by_label().alias("l"), by_text().alias("t"), by_position(w, h).alias("p"), by_geometry(w, h).alias("g"))
    sure = lambda c, least: F.when(F.col(f"{c}.confidence") >= least, F.col(c))
    found = F.coalesce(F.col("l"), sure("t", 0.8), sure("p", 0.7), sure("g", 0.7), F.col("t"), F.col("p"), F.col("g"), _found("main_text", 0.5, "fallback"))
    # All that the text says is said before rows are sent to meet its repetitions.
    out = out.select(*columns, "_form", found.alias("z")).join(keyed, [DOC, "_form"], "left")
    out = out.select(*columns, F.coalesce(F.when(F.col("_rep_zone").isNotNull(), _found(F.col("_rep_zone"), 0.95, "repetition")), F.col("z")).alias("z"))
    return out.select(*columns, "z.zone", F.col("z.confidence").alias("zone_confidence"), F.col("z.method").alias("zone_method")).withColumn("zone_priority", geo.lookup(ZONE_PRIORITY, F.col("zone"), 5))


def by_zone(zoned: DataFrame) -> DataFrame:
    """(document, zone, n, first): how many elements of a document a zone has, and the page and number of the first.

    The elements themselves are the rows of ``in_zones``: as one list they would have to fit in one row.
    """
    return zoned.groupBy(DOC, "zone").agg(F.count("*").alias("n"), F.min(F.struct("page_number", "seq")).alias("first"))


def in_zones(zoned: DataFrame) -> DataFrame:
    """Elements with their place, from 1, among those of the same zone of their document."""
    return zoned.withColumn("zone_place", F.row_number().over(W.partitionBy(DOC, "zone").orderBy("page_number", "seq")))
