"""The deterministic parts of a table of contents: page offsets, runs, neighbours, ranges, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_run(pages: DataFrame, by: list[str], flag: str = "is_toc") -> DataFrame:
    """The first unbroken run of pages that are flagged."""
    order = W.partitionBy(*by).orderBy("page_number")
    runs = pages.withColumn("start", (F.col(flag) & ~F.coalesce(F.lag(flag).over(order), F.lit(False))).cast("int")).withColumn("run", F.sum("start").over(order))
    return runs.where(F.col(flag) & (F.col("run") == 1)).select(pages.columns)


def title_matches(logical: DataFrame, physical: DataFrame, by: list[str], start: Column) -> DataFrame:
    """Pairs of equal titles whose physical page isn't before the start; equal titles multiply."""
    p = physical.select(*by, "title", F.col("physical_index"))
    return logical.join(p, [*by, "title"]).where(F.col("physical_index") >= start)


def page_offset(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(document, page_offset): the commonest difference of physical and printed page, of equally common ones that met first."""
    numbers = pairs.withColumn("d", F.col("physical_index") - F.col("page").try_cast("int")).where("d is not null")
    counted = numbers.groupBy(*by, "d").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "d")).alias("b")).select(*by, F.col("b.d").alias("page_offset"))


def with_offset(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(offsets, by, "left").withColumn("physical_index", F.col("page").try_cast("int") + F.col("page_offset")).drop("page_offset")


def with_preface(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row ("0", "Preface", 1) before the first where that starts after page 1."""
    first = rows.groupBy(*by).agg(F.min_by("physical_index", "idx").alias("p")).where("p > 1")
    extra = first.select(*by, F.lit(-1).alias("idx"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))
    return rows.unionByName(extra, allowMissingColumns=True)


def page_ranges(rows: DataFrame, by: list[str], last_page: Column, appear_start: str | None = None) -> DataFrame:
    """``rows`` with start_index and end_index: up to the next row's page, or the one before it if the next starts its page."""
    order = W.partitionBy(*by).orderBy("idx")
    nxt = F.lead("physical_index").over(order)
    if appear_start:
        nxt = F.when(F.lead(appear_start).over(order) == "yes", nxt - 1).otherwise(nxt)
    return rows.withColumn("start_index", F.col("physical_index")).withColumn("end_index", F.coalesce(nxt, last_page))


def valid_indices(rows: DataFrame, start: Column, last_page: Column) -> DataFrame:
    return rows.where(F.col("physical_index").between(start, last_page))


def correct_neighbours(rows: DataFrame, by: list[str], flag: str = "correct") -> DataFrame:
    """``rows`` with prev_index and next_index: the pages of the nearest correct rows on either side."""
    right = F.when(F.col(flag), F.col("physical_index"))
    order = W.partitionBy(*by).orderBy("idx")
    return rows.withColumn("prev_index", F.last(right, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("next_index", F.first(right, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))


def accuracy(rows: DataFrame, by: list[str], pages: Column, flag: str = "correct") -> DataFrame:
    """The share of correct rows, 0 where the last row's page is in the first half."""
    out = rows.groupBy(*by).agg(F.avg(F.col(flag).cast("double")).alias("a"), F.max("physical_index").alias("last"), F.max(pages).alias("n"))
    return out.select(*by, F.when(F.col("last") < F.col("n") / 2, F.lit(0.0)).otherwise(F.col("a")).alias("accuracy"))


def sampled(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows by a hash of their key and the seed, the same however the rows are spread over tasks."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)
