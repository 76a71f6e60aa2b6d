"""Markdown documents: headers, fences, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import text as txt


def numbered_lines(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    return texts.select(*by, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "md_line")).select(*by, (F.col("pos") + 1).alias("line_num"), "md_line")


def headers(lines: DataFrame, by: list[str]) -> DataFrame:
    """``lines(line_num, md_line)`` with is_header, level and title: headers count outside code fences; an indented one starts no section."""
    plain = txt.stripped(F.col("md_line"))
    order = W.partitionBy(*by).orderBy("line_num")
    fenced = lines.withColumn("fence", plain.startswith("```").cast("int")).withColumn("inside", F.sum("fence").over(order) % 2 == 1)
    found = (F.col("fence") == 0) & ~F.col("inside") & plain.rlike(r"^#{1,6}\s+.+$") & F.col("md_line").rlike("^#{1,6}")
    out = fenced.withColumn("is_header", found)
    return out.withColumn("level", F.when(found, F.length(F.regexp_extract("md_line", "^(#{1,6})", 1)))).withColumn(
        "title", F.when(found, txt.stripped(F.regexp_extract(plain, r"^#{1,6}\s+(.+)$", 1)))
    ).drop("fence", "inside")


def sections(lines: DataFrame, by: list[str]) -> DataFrame:
    """(idx, level, title, line_num, text): each header with the lines up to the next; what comes before the first is left out."""
    order = W.partitionBy(*by).orderBy("line_num")
    owned = headers(lines, by).withColumn("idx", F.sum(F.col("is_header").cast("int")).over(order) - 1).where("idx >= 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "md_line"))), lambda x: x["md_line"]), "\n")
    return owned.groupBy(*by, F.col("idx").cast("int").alias("idx")).agg(F.max("level").alias("level"), F.max("title").alias("title"), F.min("line_num").alias("line_num"), txt.stripped(body).alias("text"))


def header_offsets(lines: DataFrame, by: list[str]) -> DataFrame:
    """Any line that starts with signs, fences or not: (line_num, char offset, level from 0, title)."""
    past = W.partitionBy(*by).orderBy("line_num").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("md_line") + 1).over(past), F.lit(0))
    out = lines.withColumn("char_offset", at)
    signs = F.regexp_extract("md_line", r"^(#+)\s+\S", 1)
    return out.where(signs != "").select(*by, "line_num", "char_offset", (F.length(signs) - 1).alias("level"), txt.stripped(F.regexp_replace("md_line", r"^#+\s+", "")).alias("title"))


def joined_pages(pages: DataFrame, by: str = "document_id", text: str = "markdown_content") -> DataFrame:
    """All pages of a document as one text with a header for each."""
    one = F.concat(F.lit("# Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce(text, F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("page_number", one.alias("t"))))
    return pages.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n---\n\n").alias("markdown"))
