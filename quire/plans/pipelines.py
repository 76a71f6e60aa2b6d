"""Composite plans: layout to tree, a page's layout, Markdown to tree, table of contents to tree. Phases that several later steps read are checkpointed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.checkpoints import cut
from quire.config import Settings
from quire.operators import enrich, filters, hierarchy, layout, markdown, match, order, thinning, toc, tree, zones
from quire.schema import CANONICAL, normalise

DOC = filters.DOC


def spatial_tree(elements: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Elements filtered, zoned, put in reading order, scored, checked against Markdown, merged if wanted, and made a tree."""
    s = settings
    elements = normalise(elements).select(*CANONICAL)
    repeated = cut(filters.repetitions(elements, s.min_pages))
    stay = cut(filters.kept(elements, repeated=repeated, use_repeated=s.use_repeated, use_noise=s.use_noise, use_margin=s.use_margin))
    placed = cut(order.reading_order(zones.classified(stay, repeated), s.order))
    leveled = hierarchy.levels(placed)
    if s.adaptive:
        leveled = hierarchy.adaptive_levels(leveled)
    if s.use_markdown:
        leveled = hierarchy.with_markdown(leveled)
    else:
        leveled = leveled.withColumn("final_level", F.col("spatial_level")).withColumn("level_source", F.lit("spatial_only"))
    number = W.partitionBy(DOC).orderBy("page_number", "read_idx")
    if s.use_thinning:
        text = thinning.thinned(leveled)
        kept = leveled.select(DOC, "page_number", "seq", "read_idx", "final_level", "level_source", "zone")
        rows = text.join(kept, [DOC, "page_number", "seq"]).withColumn("final_level", F.when(F.col("merged_from") > 1, 3).otherwise(F.col("final_level")))
    else:
        rows = leveled
    rows = rows.withColumn("idx", F.row_number().over(number) - 1).withColumnRenamed("final_level", "level")
    return tree.with_node_ids(tree.with_parents(rows, [DOC]), [DOC]).select(
        DOC, "idx", "node_id", "page_number", "seq", "label", "text_content", "zone", "level", "level_source", "parent_idx", "depth"
    )


def page_layout(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements with their columns and lines, blocks by column, captions with what they belong to)."""
    placed = layout.with_column(elements)
    by = [*layout.PAGE, "column_index"]
    lined = layout.with_lines(placed, by)
    return lined, layout.blocks(lined, by), layout.linked_captions(zones.classified(elements))


def markdown_tree(lines: DataFrame, by: list[str], settings: Settings = Settings(), client=enrich.Offline) -> DataFrame:
    """Sections with tokens, thinned if a threshold is set, with parents, ids and if wanted summaries."""
    rows = tree.subtree_tokens(tree.with_ends(markdown.sections(lines, by), by, levels=range(1, 7)), by)
    if settings.thin_threshold is not None:
        rows = tree.thin(rows, by, settings.thin_threshold)
    rows = tree.with_node_ids(tree.with_parents(rows, by, levels=range(1, 7)), by, first=1)
    return enrich.summaries(rows, make=client) if settings.summaries else rows


def matched_tree(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """Markdown headers joined to the elements that fit them, headings that Markdown lacks added, as one tree."""
    heads = markdown.header_offsets(lines, [DOC]).withColumn("idx", F.row_number().over(W.partitionBy(DOC).orderBy("line_num")) - 1)
    placed = hierarchy.classified(elements)
    spatial = placed.select(DOC, "page_number", "seq", "label", "y1", "spatial_level")
    best = match.best_matches(heads, elements)
    explicit = match.fused(heads, best, spatial).select(DOC, F.coalesce("page_number", F.lit(1)).alias("page_number"), F.col("idx").alias("seq"), "y1", "title", "level", "origin")
    # What the layout says of an element goes along with it, so that its text isn't sent again to meet it.
    implicit = match.implicit_sections(placed, heads).select(
        DOC, "page_number", "seq", "y1", F.col("text_content").alias("title"), F.col("spatial_level").alias("level"), F.lit("layout").alias("origin")
    )
    rows = match.sorted_sections(explicit, implicit)
    # A level made of two lies between them, and a layout's is 5 at most: the headers tell how deep levels go.
    deepest = heads.agg(F.max("level")).first()[0] or 0
    return tree.with_node_ids(tree.with_parents(rows, [DOC], levels=range(0, max(5, deepest) + 1)), [DOC])


def toc_tree(rows: DataFrame, physical: DataFrame, by: list[str], last_page: Column) -> DataFrame:
    """``rows(idx, structure, title, page)`` with physical pages by the commonest offset, a preface, ranges and parents."""
    pairs = toc.title_matches(rows, physical, by, F.lit(1))
    placed = toc.valid_indices(toc.with_offset(rows, toc.page_offset(pairs, by), by), F.lit(1), last_page)
    return match.parents_by_code(toc.page_ranges(toc.with_preface(placed, by), by, last_page), by)


def tree_summary(rows: DataFrame) -> DataFrame:
    return tree.depth_and_count(rows, [DOC])
