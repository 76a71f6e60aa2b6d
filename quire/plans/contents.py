"""From the texts of a document's pages to its table of contents and tree: detection, extraction, mapping to pages, verification, repair.

Every step has a rule that needs no model; a model's answer can take its place through ``Steps``. Documents are independent, titles meet
lines by equality, and of the lines that say a title only the pages are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.checkpoints import cut
from quire.functions import text as txt
from quire.operators import match, toc

_CODE = r"^\s*(\d+(?:\.\d+)*)\.?\s+"
#: A title, what leads to the page, the page; after dots have become colons.
_WITH_PAGE = r"^\s*(.*?\S)\s*(?::|\.{2,}|\s{2,})\s*(\d+)\s*$"


def _lines(text: Column) -> Column:
    return F.filter(F.split(txt.dots_to_colon(F.coalesce(text, F.lit(""))), "\r?\n"), lambda x: F.trim(x) != "")


def looks_like_contents(text: Column) -> Column:
    """Three lines or more, and half of all, end in a page number that dots, a colon or a gap lead to."""
    lines = _lines(text)
    entries = F.size(F.filter(lines, lambda x: x.rlike(_WITH_PAGE)))
    return (entries >= 3) & (2 * entries >= F.size(lines))


def title_key(text: Column) -> Column:
    """What is compared of a title or a line: lower case, without a leading number and white space."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, _CODE, "")), r"\s+", "")


def listed_entries(contents: DataFrame, by: list[str]) -> DataFrame:
    """(idx, structure, title, page): lines of the pages of contents that begin with a number or end in a page, in order; page as text, null where none is given."""
    rows = contents.select(*by, "page_number", F.posexplode(_lines(F.col("text"))).alias("line_number", "line"))
    paged = F.col("line").rlike(_WITH_PAGE)
    body = F.when(paged, F.regexp_extract("line", _WITH_PAGE, 1)).otherwise(F.trim("line"))
    code = F.regexp_extract(body, _CODE, 1)
    kept = rows.where(paged | F.col("line").rlike(_CODE)).select(
        *by, "page_number", "line_number", F.when(code != "", code).alias("structure"), F.trim(F.regexp_replace(body, _CODE, "")).alias("title"),
        F.when(paged, F.regexp_extract("line", _WITH_PAGE, 2)).alias("page"),
    )
    order = W.partitionBy(*by).orderBy("page_number", "line_number")
    return kept.where("title <> ''").withColumn("idx", F.row_number().over(order) - 1).drop("page_number", "line_number")


def title_pages(entries: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """(idx, physical_index): the pages with a line that says an entry's title, each once."""
    lines = pages.select(*by, F.col("page_number").alias("physical_index"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), title_key))).alias("key"))
    asked = entries.select(*by, "idx", title_key(F.col("title")).alias("key")).where("key <> ''")
    return asked.join(lines, [*by, "key"]).select(*by, "idx", "physical_index")


@dataclass(frozen=True)
class Steps:
    """The rules of the steps; ``check_pages``: where contents must have begun, ``least``: the share of titles above which wrong pages are repaired."""

    is_contents: Callable[[Column], Column] = looks_like_contents
    entries: Callable[[DataFrame, list[str]], DataFrame] = listed_entries
    pages: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = title_pages
    check_pages: int = 20
    least: float = 0.6


def verified(rows: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """``rows(title, physical_index)`` with correct, whether the page says the title, and appear_start, "yes" if it starts with it."""
    said = pages.select(*by, F.col("page_number").alias("physical_index"), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", "").alias("_said"), title_key(F.coalesce("text", F.lit(""))).alias("_start"))
    key = title_key(F.col("title"))
    out = rows.join(said, [*by, "physical_index"], "left")
    return out.withColumn("correct", F.coalesce(F.contains("_said", key), F.lit(False))).withColumn("appear_start", F.when(F.startswith("_start", key), "yes").otherwise("no")).drop("_said", "_start")


def repaired(rows: DataFrame, found: DataFrame, by: list[str], last_page: Column) -> DataFrame:
    """Wrong rows on the first page that says their title between the nearest right rows; the others, and those without such a page, as they are."""
    between = toc.correct_neighbours(rows, by)
    wrong = between.where("not correct").select(*by, "idx", F.coalesce("prev_index", F.lit(0)).alias("lo"), F.coalesce(F.col("next_index"), last_page).alias("hi"))
    better = wrong.join(found, [*by, "idx"]).where(F.col("physical_index").between(F.col("lo"), F.col("hi"))).groupBy(*by, "idx").agg(F.min("physical_index").alias("_better"))
    return rows.join(better, [*by, "idx"], "left").withColumn("physical_index", F.coalesce("_better", "physical_index")).drop("_better")


def contents_tree(pages: DataFrame, by: list[str], steps: Steps = Steps()) -> tuple[DataFrame, DataFrame]:
    """(nodes, outcome) from ``pages(page_number, text)``.

    A document's contents are the first run of pages that look like them. Where entries give pages, the commonest distance to the pages that say their titles is added;
    where that leaves too few titles right, or none is given, an entry is on the first page that says its title. Outcome has a row for each
    document: mode ("page_numbers", "titles", or null where there are no contents or neither mode is right for over ``least``, and
    so no nodes) and accuracy. Null texts count as empty, extra columns are ignored.
    """
    pages = cut(pages.select(*by, "page_number", "text").withColumn("is_toc", steps.is_contents(F.coalesce("text", F.lit("")))))
    counts = pages.groupBy(*by).agg(F.max("page_number").alias("last_page"))
    run = toc.first_run(pages, by)
    begun = run.groupBy(*by).agg(F.min("page_number").alias("b")).where(F.col("b") <= steps.check_pages).drop("b")
    run = run.join(begun, by, "left_semi")
    entries = cut(steps.entries(run, by))
    rest = pages.join(run.select(*by, "page_number"), [*by, "page_number"], "left_anti")
    found = cut(steps.pages(entries, rest, by))
    first = found.groupBy(*by, "idx").agg(F.min("physical_index").alias("physical_index"))
    titled = entries.join(first, [*by, "idx"])
    tried = {"page_numbers": toc.with_offset(entries, toc.page_offset(titled.where("page is not null"), by), by), "titles": titled}
    both = None
    for place, (mode, rows) in enumerate(tried.items()):
        rows = rows.select(*by, "idx", "structure", "title", "physical_index").join(counts, by)
        rows = verified(toc.valid_indices(rows, F.lit(1), F.col("last_page")), pages, by).withColumn("mode", F.lit(mode)).withColumn("place", F.lit(place))
        both = rows if both is None else both.unionByName(rows)
    both = cut(both)
    scores = toc.accuracy(both, [*by, "mode", "place"], F.col("last_page"))
    chosen = scores.where(F.col("accuracy") > steps.least).groupBy(*by).agg(F.min(F.struct("place", "mode", "accuracy")).alias("c")).select(*by, "c.mode", "c.accuracy")
    outcome = counts.select(*by).join(chosen, by, "left")
    rows = both.join(chosen.select(*by, "mode"), [*by, "mode"], "left_semi").drop("mode", "place")
    rows = verified(repaired(rows, found, by, F.col("last_page")).drop("correct", "appear_start"), pages, by)
    whole = toc.with_preface(rows.drop("last_page"), by).join(counts, by)
    return match.parents_by_code(toc.page_ranges(whole, by, F.col("last_page"), "appear_start"), by), outcome
