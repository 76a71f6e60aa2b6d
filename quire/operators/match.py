"""Headers and elements put together: by place, by title, by code, by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import geometry as geo
from quire.functions import text as txt

from .filters import DOC

HEADING = ("title", "heading", "sub_title", "subtitle")


#: Blocks by which a title is found inside another: their sizes, and how long a title must be to hold a whole one wherever it starts. Sides of the cells in which boxes meet.
BLOCKS, CELL = ((8, 15), (3, 5), (1, 1)), 256


def _asked(text: str) -> Column:
    """The runs of a title one of which is a block of any text that holds it: as many as the block is long, from its start on."""
    runs = [(least, f"transform(sequence(1, {size}), i -> substring(t, i, {size}))") for size, least in BLOCKS]
    return _once(text, "array_distinct(CASE " + " ".join(f"WHEN length(t) >= {least} THEN {run}" for least, run in runs) + " END)")


def _held(text: str) -> Column:
    """A text's blocks, each once, of the sizes that are asked for (``has_8`` and so on)."""
    cut = [f"CASE WHEN has_{size} THEN regexp_extract_all(t, '(?s).{{{size}}}', 0) ELSE array() END" for size, _ in BLOCKS]
    return _once(text, f"array_distinct(concat({', '.join(cut)}))")


def _start(text: str) -> Column:
    """The first characters of a text, as many as the largest block that fits."""
    return F.expr("CASE " + " ".join(f"WHEN length({text}) >= {size} THEN substring({text}, 1, {size})" for size, _ in BLOCKS) + " END")


def _runs(text: str) -> Column:
    """All runs of a text that ``_start`` may give, each once."""
    runs = [f"CASE WHEN length(t) >= {size} THEN transform(sequence(1, length(t) - {size - 1}), i -> substring(t, i, {size})) ELSE array() END" for size, _ in BLOCKS]
    return _once(text, f"array_distinct(concat({', '.join(runs)}))")


def _once(text: str, made: str) -> Column:
    """The array that ``made`` says of ``t``, where the text behind it is computed once and not for each of its blocks."""
    return F.expr(f"flatten(transform(array({text}), t -> {made}))")


def _cells(prefix: str) -> Column:
    """The cells that a box touches, as numbers."""
    at = lambda c: F.floor(F.col(f"{prefix}{c}") / CELL).cast("int")
    along = lambda a, b: F.sequence(F.least(at(a), at(b)), F.greatest(at(a), at(b)))
    return F.flatten(F.transform(along("x1", "x2"), lambda x: F.transform(along("y1", "y2"), lambda y: x.cast("long") * 1000003 + y)))


def _within(titles: DataFrame, headings: DataFrame) -> DataFrame:
    """(document, ht, at): for each of ``titles(ht)`` the first of the headings that hold it or that it holds.

    A title that a heading holds shares a block with it, and one that holds a heading shares that heading's start. Equal texts are one row, and
    documents in which no title is asked for give none.
    """
    size = F.length("ht")
    edges = zip((None, *[least for _, least in BLOCKS]), BLOCKS)
    kinds = [F.max((size >= least) & (F.lit(True) if top is None else size < top)).alias(f"has_{n}") for top, (n, least) in edges]
    asked = titles.groupBy(DOC).agg(*kinds, F.min(size).alias("least"), F.max(size).alias("most"))
    texts = headings.join(asked, DOC).groupBy(DOC, "et", *[f"has_{n}" for n, _ in BLOCKS], "least", "most").agg(F.min(F.struct("page_number", "seq")).alias("at"))
    larger = texts.where(F.length("et") >= F.col("least")).select(DOC, "et", "at", F.explode(_held("et")).alias("block"))
    smaller = texts.where(F.length("et") <= F.col("most")).select(DOC, "et", "at", _start("et").alias("block"))
    inside = titles.withColumn("block", F.explode(_asked("ht"))).join(larger, [DOC, "block"]).where(F.contains("et", "ht"))
    around = titles.withColumn("block", F.explode(_runs("ht"))).join(smaller, [DOC, "block"]).where(F.contains("ht", "et"))
    return inside.select(DOC, "ht", "at").unionByName(around.select(DOC, "ht", "at")).groupBy(DOC, "ht").agg(F.min("at").alias("at"))


def best_matches(headers: DataFrame, elements: DataFrame, least: float = 0.2) -> DataFrame:
    """(document, h_idx, seq, match_score): of a document's elements the one that fits a header best, the first of equals.

    Equal titles fit by 0.9, a title inside the other by 0.6 if the label is a heading's, overlapping boxes (where a header has one) by their overlap over 0.3.

    Only the first element of each text and of each box can win, so those are what headers meet: by digests of the whole texts, then, if no text
    is equal, by blocks of the headings', and by cells of the page. Pairs of copies are never made, and no text is sent that isn't a heading's or a header's.
    """
    low = lambda c: F.lower(txt.stripped(F.coalesce(F.col(c), F.lit(""))))
    first = F.min(F.struct("page_number", "seq")).alias("at")
    corners = [c for c in ("x1", "y1", "x2", "y2") if c in headers.columns]
    heads = headers.select(DOC, F.col("idx").alias("h_idx"), low("title").alias("ht"), *[F.col(c).alias(f"h_{c}") for c in corners])
    rows = elements.select(DOC, "page_number", "seq", "label", low("text_content").alias("et"), "x1", "y1", "x2", "y2")
    titled, named = heads.where("ht <> ''"), rows.where("et <> ''")
    equal = titled.select(DOC, "h_idx", "ht", txt.digest(F.col("ht")).alias("key")).join(named.groupBy(DOC, txt.digest(F.col("et")).alias("key")).agg(first), [DOC, "key"], "left")
    apart = equal.where("at is null").select(DOC, "h_idx", "ht")
    within = _within(apart.select(DOC, "ht").distinct(), named.where(F.lower("label").isin(*HEADING)))
    scored = lambda df, score: df.select(DOC, "h_idx", score.alias("match_score"), "at")
    met = [scored(equal.where("at is not null"), F.lit(0.9)), scored(apart.join(within, [DOC, "ht"]), F.lit(0.6))]
    if len(corners) == 4:
        boxes = rows.groupBy(DOC, "x1", "y1", "x2", "y2").agg(first)
        near = heads.withColumn("cell", F.explode(_cells("h_"))).join(boxes.withColumn("cell", F.explode(_cells(""))), [DOC, "cell"])
        over = geo.iou(geo.box("h_"), geo.box())
        met.append(scored(near.where(over > 0.3), over))
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    best = F.min(F.struct((-F.col("match_score")).alias("s"), "at")).alias("b")
    return found.where(F.col("match_score") > least).groupBy(DOC, "h_idx").agg(best).select(
        DOC, "h_idx", F.col("b.at.page_number").alias("page_number"), F.col("b.at.seq").alias("seq"), (-F.col("b.s")).alias("match_score")
    )


def blended_level(md: Column, sp: Column, label: Column) -> Column:
    """Where the two are over 1 apart, 60 to 40 in favour of Markdown for a heading's label, else 40 to 60; truncated."""
    strong = F.lower(label).isin(*HEADING)
    mixed = F.when(strong, md * 0.6 + sp * 0.4).otherwise(md * 0.4 + sp * 0.6)
    return F.when(sp.isNull(), md).when(F.abs(md - sp) > 1, mixed.cast("int")).otherwise(md)


def fused(headers: DataFrame, best: DataFrame, spatial: DataFrame) -> DataFrame:
    """``headers(idx, level)`` with the element that fits each best, where there is one, and the level that both make."""
    found = best.withColumnRenamed("h_idx", "idx").join(spatial, [DOC, "page_number", "seq"], "left")
    joined = headers.join(found, [DOC, "idx"], "left")
    return joined.withColumn("level", blended_level(F.col("level"), F.col("spatial_level"), F.coalesce("label", F.lit("")))).withColumn("origin", F.when(F.col("match_score").isNull(), "markdown").otherwise("matched"))


def implicit_sections(elements: DataFrame, headers: DataFrame) -> DataFrame:
    """Elements with a heading's label whose text is no header's title."""
    known = headers.select(DOC, txt.digest(F.lower(txt.stripped(F.col("title")))).alias("_t")).distinct()
    text = F.lower(txt.stripped(F.coalesce("text_content", F.lit(""))))
    rows = elements.where(F.lower("label").isin(*HEADING) & (text != "")).withColumn("_t", txt.digest(text))
    return rows.join(known, [DOC, "_t"], "left_anti").select(elements.columns)


def parents_by_code(rows: DataFrame, by: list[str], code: str = "structure") -> DataFrame:
    """``rows(idx)`` with parent_idx: the last earlier row whose code is this one's without its last part (``1.2`` of ``1.2.3``), null if there is none."""
    up = F.regexp_extract(code, r"^(.*)\.[^.]*$", 1)
    asked = rows.select(*by, "idx", F.when(up != "", up).alias("key"), F.lit(0).alias("own"))
    offered = rows.select(*by, "idx", F.col(code).alias("key"), F.lit(1).alias("own"))
    # Rows that offer a code and rows that ask for it, in order: a parent is the last offer before.
    before = W.partitionBy(*by, "key").orderBy("idx").rangeBetween(W.unboundedPreceding, -1)
    found = asked.where("key is not null").unionByName(offered).withColumn("parent_idx", F.max(F.when(F.col("own") == 1, F.col("idx"))).over(before))
    return rows.join(found.where("own = 0 and parent_idx is not null").select(*by, "idx", "parent_idx"), [*by, "idx"], "left")


def range_texts(nodes: DataFrame, pages: DataFrame, by: list[str], labelled: bool = False) -> DataFrame:
    """``nodes(start_index, end_index)`` with the texts of their pages joined, with page labels if wanted."""
    text = txt.page_label(F.col("text"), F.col("page_number")) if labelled else F.col("text")
    p = pages.select(*by, "page_number", text.alias("page_text"))
    last = pages.groupBy(*by).agg(F.min("page_number").alias("_first"), F.max("page_number").alias("_last"))
    start, stop = F.greatest("start_index", "_first"), F.least("end_index", "_last")
    # Each range is spelt out as its pages, so that pages are found by equality; what lies outside the document isn't.
    wanted = nodes.select(*by, "idx", "start_index", "end_index").join(last, by).where(start <= stop).select(*by, "idx", F.explode(F.sequence(start, stop)).alias("page_number"))
    found = wanted.join(p, [*by, "page_number"]).groupBy(*by, "idx").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))).alias("t"))
    return nodes.join(found, [*by, "idx"], "left").withColumn("text", F.array_join(F.transform(F.coalesce("t", F.array()), lambda x: x["page_text"]), "")).drop("t")


def within_tokens(nodes: DataFrame, limit: int = 110000, text: str = "text") -> DataFrame:
    return nodes.withColumn("tokens", txt.count_tokens(F.col(text))).withColumn("over_limit", F.col("tokens") > limit)


def sorted_sections(*parts: DataFrame) -> DataFrame:
    """All rows, in order of page, place and part, with their number."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("idx", F.row_number().over(W.partitionBy(DOC).orderBy("page_number", F.coalesce("y1", F.lit(0)), "part", "seq")) - 1)
