"""Page dimensions, repeated headers and footers, noise and margin filters. All take elements and keep their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import text as txt

DOC = "document_id"


def page_dims(elements: DataFrame, factor: float = 1.05, by: str = DOC) -> DataFrame:
    """(document, width, height): the furthest corner times ``factor``, truncated; 800 by 1000 where that is nothing."""
    side = lambda c, default: F.coalesce(F.when(F.max(c) > 0, (F.max(c) * F.lit(factor)).cast("int")), F.lit(default))
    return elements.groupBy(by).agg(side("x2", 800).alias("width"), side("y2", 1000).alias("height"))


def repetitions(elements: DataFrame, min_pages: int = 3, page_height: float = 1000.0) -> DataFrame:
    """Texts found on several pages of a document, by their matching form: on which, where on average, and the zone that makes."""
    form = txt.matching_form(F.col("text_content"))
    shown = elements.where(F.length(txt.stripped(F.coalesce(F.col("text_content"), F.lit("")))) >= 3).withColumn("form", form).where("form <> ''")
    at = F.struct("page_number", "seq")
    found = shown.groupBy(DOC, "form").agg(
        F.countDistinct("page_number").alias("n_pages"),
        F.count("*").alias("n_elements"),
        F.avg("x1").alias("avg_x"),
        F.avg("y1").alias("avg_y"),
        F.min_by("text_content", at).alias("first_text"),
    )
    return found.where(F.col("n_pages") >= min_pages).withColumn("zone", _zone(page_height))


def _zone(page_height: float) -> Column:
    share = F.col("avg_y") / F.lit(page_height)
    return F.when(share < 0.15, "header").when(share > 0.85, "footer").otherwise("unknown")


def repeated_forms(elements: DataFrame, min_pages: int = 3, page_height: float = 1000.0) -> DataFrame:
    """(document, key, zone) of what ``repetitions`` finds, with the digest of the form in place of texts: none is sent, and each page of a form is counted once."""
    form = F.filter(F.array(txt.matching_form(F.col("text_content"))), lambda f: f != "")  # an array, so that it is computed once and not again to filter rows
    shown = elements.where(F.length(txt.stripped(F.coalesce(F.col("text_content"), F.lit("")))) >= 3).select(DOC, "page_number", "y1", F.explode(form).alias("form"))
    pages = shown.groupBy(DOC, txt.digest(F.col("form")).alias("key"), "page_number").agg(F.sum(F.col("y1").cast("double")).alias("y"), F.count("y1").alias("n"))
    found = pages.groupBy(DOC, "key").agg(F.count("page_number").alias("n_pages"), (F.sum("y") / F.sum("n")).alias("avg_y"))
    return found.where(F.col("n_pages") >= min_pages).select(DOC, "key", _zone(page_height).alias("zone"))


def repeated_pages(elements: DataFrame, repeated: DataFrame) -> DataFrame:
    """The sorted distinct pages of each repeated text."""
    shown = elements.withColumn("form", txt.matching_form(F.col("text_content")))
    return shown.join(repeated.select(DOC, "form"), [DOC, "form"], "left_semi").groupBy(DOC, "form").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))


def without_repeated(elements: DataFrame, repeated: DataFrame | None = None, zones: tuple[str, ...] = ("header", "footer"), min_pages: int = 3) -> DataFrame:
    repeated = repetitions(elements, min_pages) if repeated is None else repeated
    gone = repeated.where(F.col("zone").isin(*zones)).select(DOC, "form")
    return elements.withColumn("form", txt.matching_form(F.col("text_content"))).join(gone, [DOC, "form"], "left_anti").select(elements.columns)


def noise_reason(width, height, least: float = 0.001, most: float = 0.5):
    share = F.abs(geo.area(geo.box())) / (width * height)
    return F.when(share < least, "too_small").when(share > most, "too_large")


def margin_reason(width, height, margin: float = 0.05):
    """Small boxes wholly within the left or right margin; top and bottom don't count."""
    b = geo.box()
    outside = (b.x2 < width * margin) | (b.x1 > width * (1 - margin))
    return F.when(outside & (geo.width(b) < width * 0.15) & (geo.height(b) < height * 0.1), "margin")


def flagged(elements: DataFrame, repeated: DataFrame | None = None, use_repeated: bool = True, use_noise: bool = True, use_margin: bool = False, min_pages: int = 3) -> DataFrame:
    """``elements`` with filter_reason: repeated, too_small, too_large or margin, in this order; null for what stays.

    Each filter sees what those before it left; the page's dimensions for noise and margins are those of what isn't repeated.
    """
    columns = elements.columns
    out = elements.withColumn("form", txt.matching_form(F.col("text_content")))
    if use_repeated:
        repeated = repetitions(elements, min_pages) if repeated is None else repeated
        gone = repeated.where("zone in ('header', 'footer')").select(DOC, "form", F.lit("repeated").alias("r1"))
        out = out.join(gone, [DOC, "form"], "left")
    else:
        out = out.withColumn("r1", F.lit(None).cast("string"))
    out = out.join(page_dims(out.where("r1 is null")), DOC, "left")
    w, h = F.col("width"), F.col("height")
    out = out.withColumn("r2", noise_reason(w, h) if use_noise else F.lit(None).cast("string"))
    out = out.withColumn("r3", margin_reason(w, h) if use_margin else F.lit(None).cast("string"))
    return out.select(*columns, F.coalesce("r1", "r2", "r3").alias("filter_reason"))


def kept(elements: DataFrame, **options) -> DataFrame:
    return flagged(elements, **options).where("filter_reason is null").drop("filter_reason")


def filter_stats(flags: DataFrame) -> DataFrame:
    return flags.groupBy(DOC, F.coalesce("filter_reason", F.lit("kept")).alias("filter_reason")).agg(F.count("*").alias("n"))
