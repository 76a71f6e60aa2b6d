"""The stored tables as Parquet folders: writes, reads and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire import schema

TABLES = {"documents": schema.DOCUMENTS, "pages": schema.PAGES, "layout_elements": schema.ELEMENTS, "tree_indices": schema.TREES, "tree_nodes": schema.NODES}


def stored_id(*parts: Column) -> Column:
    """An id that follows from what it names."""
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 32)


def documents(files: DataFrame, now: Column) -> DataFrame:
    """Rows of ``files(filename, total_pages)`` as documents."""
    kind = F.when(F.lower("filename").endswith(".pdf"), "pdf").otherwise("image")
    return files.select(stored_id(F.col("filename")).alias("id"), "filename", kind.alias("file_type"), F.col("total_pages").cast("int"), now.alias("created_at"), now.alias("updated_at"))


def element_rows(elements: DataFrame, width: Column, height: Column) -> DataFrame:
    """Elements as they are stored: numbered in order, with boxes from 0 to 999 that aren't truncated and null without dimensions."""
    norm = lambda v, side: F.when(side > 0, F.col(v) / side * F.lit(999.0))
    order = W.partitionBy("document_id", "page_number").orderBy("seq")
    return elements.withColumns({"norm_x1": norm("x1", width), "norm_y1": norm("y1", height), "norm_x2": norm("x2", width), "norm_y2": norm("y2", height)}).withColumn("sequence_order", F.row_number().over(order) - 1)


class Store:
    """A folder with one Parquet table for each name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def create(self) -> None:
        for name, columns in TABLES.items():
            self.spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        """Takes the tables away, with all that is in them."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in TABLES:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(conf).delete(folder, True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        want = self.spark.createDataFrame([], TABLES[name]).schema
        have = set(rows.columns)
        rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]).write.mode("append").parquet(f"{self.path}/{name}")

    def delete_documents(self, ids: DataFrame, into: str) -> Store:
        """A store without these documents and all that hangs on them; anti-joins into a new folder, as files aren't changed in place."""
        out = Store(self.spark, into)
        keep = cascade({name: self.read(name) for name in TABLES}, ids)
        for name, rows in keep.items():
            out.append(name, rows)
        return out

    def document(self, document_id: str) -> DataFrame:
        return by_id(self.read("documents"), document_id)

    def list_documents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return listed(self.read("documents"), limit, offset)

    def elements(self, document_id: str, label: str | None = None) -> DataFrame:
        rows = self.read("layout_elements").join(self.read("pages").where(F.col("document_id") == document_id).select(F.col("id").alias("page_id"), "page_number"), "page_id")
        return (rows if label is None else rows.where(F.col("label") == label)).orderBy("page_number", "sequence_order")

    def latest_tree(self, document_id: str) -> DataFrame:
        return latest(self.read("tree_indices").where(F.col("document_id") == document_id), ["document_id"])

    def nodes(self, tree_index_id: str, node_type: str | None = None) -> DataFrame:
        rows = self.read("tree_nodes").where(F.col("tree_index_id") == tree_index_id)
        return rows if node_type is None else of_type(rows, node_type)


def of_type(rows: DataFrame, node_type: str, column: str = "node_type") -> DataFrame:
    return rows.where(F.col(column) == node_type)


def by_id(rows: DataFrame, value, column: str = "id") -> DataFrame:
    """The row with this id, or none."""
    return rows.where(F.col(column) == F.lit(value)).limit(1)


def in_page_order(rows: DataFrame, by: str = "document_id") -> DataFrame:
    """Elements with their places by page and number, and by page and height."""
    place = lambda *order: F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("stored_place", place("page_number", "seq")).withColumn("height_place", place("page_number", "y1", "seq"))


def responses(rows: DataFrame) -> DataFrame:
    """Elements as they are answered with: box as a struct, the 0 to 999 box null if any side of it is, a flag for crops."""
    norm = ["norm_x1", "norm_y1", "norm_x2", "norm_y2"]
    whole = F.col(norm[0]).isNotNull() & F.col(norm[1]).isNotNull() & F.col(norm[2]).isNotNull() & F.col(norm[3]).isNotNull()
    crop = F.col("crop_image").isNotNull() if "crop_image" in rows.columns else F.lit(False)
    out = rows.withColumn("bbox", F.struct("x1", "y1", "x2", "y2")).withColumn("bbox_norm", F.when(whole, F.struct(*[F.col(c).alias(c[5:]) for c in norm])))
    return out.withColumn("has_crop_image", crop).drop("x1", "y1", "x2", "y2", *norm, "crop_image")


def cascade(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without these documents and all that hangs on them."""
    gone = ids.select(F.col("id").alias("document_id")).distinct()
    lost_pages = tables["pages"].join(gone, "document_id", "left_semi").select(F.col("id").alias("page_id"))
    lost_trees = tables["tree_indices"].join(gone, "document_id", "left_semi").select(F.col("id").alias("tree_index_id"))
    return {
        "documents": tables["documents"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"),
        "pages": tables["pages"].join(gone, "document_id", "left_anti"),
        "layout_elements": tables["layout_elements"].join(lost_pages, "page_id", "left_anti"),
        "tree_indices": tables["tree_indices"].join(gone, "document_id", "left_anti"),
        "tree_nodes": tables["tree_nodes"].join(lost_trees, "tree_index_id", "left_anti"),
    }


def listed(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The latest rows; ``limit`` from 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be from 1 to 100, offset not negative")
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def latest(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("created_at"), "id"))).where("n = 1").drop("n")
