"""Page files as a stream: parsed page by page as they come, documents indexed in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from quire.operators import zones
from quire.plans import pipelines
from quire.sources import grounding

PAGES = "document_id string, page_number int, tagged string, width int, height int"


def arriving_pages(spark: SparkSession, path: str, schema: str = PAGES, files_at_a_time: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(path)


def parsed(pages: DataFrame) -> DataFrame:
    """Elements with a zone by label and by text: what needs no more than the page, so it keeps no state."""
    rows = grounding.parse(pages, "tagged", "width", "height")
    return rows.withColumn("zone", zones.by_label()["zone"]).withColumn("text_zone", zones.by_text()["zone"])


def index_documents(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's documents become trees, in a folder of the batch's number under ``out``.

    A batch's pages are kept beside the trees, in ``out`` with ``-pages`` added. A document whose pages come in several batches is indexed again with all
    of them; ``indexed`` reads its last tree. A batch that runs again after a failure replaces what it wrote before, so nothing is there twice.
    """
    store = f"{out.rstrip('/')}-pages"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        now = spark.read.schema(rows.schema).parquet(f"{store}/batch={number}")
        so_far = spark.read.parquet(store).where(F.col("batch") <= number)
        whole = so_far.select(*rows.columns, "batch").join(now.select("document_id").distinct(), "document_id", "left_semi")
        # Of a page that came twice the last one counts.
        last = W.partitionBy("document_id", "page_number").orderBy(F.desc("batch"), "tagged")
        found = grounding.parse(whole.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(rows.columns), "tagged", "width", "height")
        elements = found.withColumn("seq", F.row_number().over(W.partitionBy("document_id", "page_number").orderBy("tag", "box")))
        pipelines.spatial_tree(elements).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(spark: SparkSession, out: str) -> DataFrame:
    """The last tree of each document."""
    trees = spark.read.parquet(out)
    last = trees.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return trees.join(last, ["document_id", "batch"], "left_semi").drop("batch")
