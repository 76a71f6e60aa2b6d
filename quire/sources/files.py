"""Files as rows: Markdown natively, images and documents through a pluggable decoder."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def decoded(image: Column) -> Column:
    """Binary from base64 text, with or without a data prefix."""
    return F.unbase64(F.regexp_replace(image, r"^data:[^,]*,", ""))


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


@F.pandas_udf(_SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height of PNG, GIF or JPEG bytes, from their headers."""
    return pd.DataFrame([_size(bytes(c)) if c is not None else (None, None) for c in content], columns=["width", "height"])


def _size(data: bytes) -> tuple[int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None, None


def recognised(files: DataFrame, recognise: Callable[[str, bytes], list[tuple[int, str, int, int]]]) -> DataFrame:
    """(path, page_number, tagged, width, height): ``recognise`` turns a file into pages of tagged text; it runs on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *page) for p, c in zip(batch["path"], batch["content"]) for page in recognise(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "page_number", "tagged", "width", "height"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, tagged string, width int, height int")
