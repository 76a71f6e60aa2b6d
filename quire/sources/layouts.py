"""Layouts derived from a table of texts: a source is a document, a row a page, a line an element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINES = r"""WITH pg AS (SELECT source AS document_id, text,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM {documents}),
ln AS (SELECT document_id, page_number, line, pos + 1 AS seq
  FROM pg LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line)"""

_ELEMENTS = """SELECT document_id, page_number, seq, line AS text_content,
  CASE WHEN seq = 1 THEN 'title' WHEN length(line) < 30 THEN 'sub_title'
       WHEN seq % 11 = 0 THEN 'table' WHEN seq % 13 = 0 THEN 'image' ELSE 'text' END AS label,
  CAST(50 + (CASE WHEN page_number % 2 = 0 AND seq % 2 = 0 THEN 400 ELSE 0 END) AS BIGINT) AS x1,
  CAST(40 + 22 * seq AS BIGINT) AS y1,
  CAST(50 + (CASE WHEN page_number % 2 = 0 AND seq % 2 = 0 THEN 400 ELSE 0 END) + least(330, 60 + length(line)) AS BIGINT) AS x2,
  CAST(40 + 22 * seq + 12 + 4 * (length(line) % 5) AS BIGINT) AS y2
FROM ln WHERE length(trim(line)) > 0"""

_MARKDOWN = """SELECT document_id, page_number, seq,
  CASE WHEN seq % 11 IN (3, 5) THEN '```' WHEN seq = 1 THEN concat('# ', line)
       WHEN length(line) < 30 THEN concat('## ', line) WHEN seq % 7 = 0 THEN concat('### ', line) ELSE line END AS md_line
FROM ln"""

_TAGGED = """SELECT document_id, page_number, array_join(transform(array_sort(collect_list(struct(seq, concat('<|ref|>', label, '<|/ref|><|det|>[[', x1, ',', y1, ',', x2, ',', y2, ']]<|/det|>', chr(10), text_content) AS part))), s -> s.part), chr(10)) AS tagged
FROM el GROUP BY document_id, page_number"""


def _sql(spark: SparkSession, sf_dir: str, tail: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return spark.sql(_LINES + tail, documents=documents)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "\n" + _ELEMENTS)


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "\n" + _MARKDOWN)


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f", el AS ({_ELEMENTS})\n" + _TAGGED)
