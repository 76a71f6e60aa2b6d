"""All queries of the engine by name, with the SQL that says the same.

A name starts with the operators it shows. Layouts come from the texts by a fixed rule (``sources.layouts``); the SQL
derives them the same way.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import geometry as geo
from quire.functions import text as txt
from quire.operators import filters, hierarchy, layout, markdown, match, order, store, thinning, toc, tree, zones
from quire.plans import contents, pipelines
from quire.sources import grounding, layouts

DOC, PAGE = "document_id", ["document_id", "page_number"]

_PG = """WITH pg AS (SELECT source AS document_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents),
ln AS (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM pg),
el AS (SELECT document_id, page_number, seq, line AS text_content,
  CASE WHEN seq = 1 THEN 'title' WHEN length(line) < 30 THEN 'sub_title' WHEN seq % 11 = 0 THEN 'table' WHEN seq % 13 = 0 THEN 'image' ELSE 'text' END AS label,
  CAST(50 + (CASE WHEN page_number % 2 = 0 AND seq % 2 = 0 THEN 400 ELSE 0 END) AS BIGINT) AS x1, CAST(40 + 22 * seq AS BIGINT) AS y1,
  CAST(50 + (CASE WHEN page_number % 2 = 0 AND seq % 2 = 0 THEN 400 ELSE 0 END) + LEAST(330, 60 + length(line)) AS BIGINT) AS x2,
  CAST(40 + 22 * seq + 12 + 4 * (length(line) % 5) AS BIGINT) AS y2 FROM ln WHERE length(trim(line)) > 0),
md AS (SELECT document_id, page_number, seq, CASE WHEN seq % 11 IN (3, 5) THEN '```' WHEN seq = 1 THEN concat('# ', line) WHEN length(line) < 30 THEN concat('## ', line) WHEN seq % 7 = 0 THEN concat('### ', line) ELSE line END AS md_line FROM ln)"""
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_FORM = _STRIP.format(r"regexp_replace(regexp_replace(lower(" + _STRIP.format("text_content") + r"), '\b(page\s*)?\d+\b', '', 'g'), '\s+', ' ', 'g')")
_REP = f""", fm AS (SELECT *, {_FORM} AS form FROM el),
rep AS (SELECT *, CASE WHEN avg_y / 1000.0 < 0.15 THEN 'header' WHEN avg_y / 1000.0 > 0.85 THEN 'footer' ELSE 'unknown' END AS zone FROM (
  SELECT document_id, form, count(DISTINCT page_number) AS n_pages, count(*) AS n_elements, avg(x1) AS avg_x, avg(y1) AS avg_y, arg_min(text_content, page_number * 1000000 + seq) AS first_text
  FROM fm WHERE form <> '' AND length({_STRIP.format('text_content')}) >= 3 GROUP BY 1, 2) WHERE n_pages >= 3)"""
_KEPT = _REP + """, unrep AS (SELECT fm.* FROM fm WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.document_id = fm.document_id AND rep.form = fm.form AND zone IN ('header', 'footer'))),
dims AS (SELECT document_id, CAST(trunc(max(x2) * 1.05::DOUBLE) AS INT) AS w, CAST(trunc(max(y2) * 1.05::DOUBLE) AS INT) AS h FROM unrep GROUP BY 1),
flags AS (SELECT f.*, CASE WHEN r.form IS NOT NULL THEN 'repeated'
  WHEN abs((x2 - x1) * (y2 - y1)) / (w * h)::DOUBLE < 0.001 THEN 'too_small' WHEN abs((x2 - x1) * (y2 - y1)) / (w * h)::DOUBLE > 0.5 THEN 'too_large' END AS filter_reason
  FROM fm f LEFT JOIN rep r ON r.document_id = f.document_id AND r.form = f.form AND r.zone IN ('header', 'footer') LEFT JOIN dims d ON d.document_id = f.document_id)"""
_TREE = """, nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, seq) - 1 AS INT) AS idx,
  CASE label WHEN 'title' THEN 0 WHEN 'sub_title' THEN 2 WHEN 'table' THEN 4 WHEN 'image' THEN 3 ELSE 5 END AS level FROM el),
par AS (SELECT n.*, (SELECT max(p.idx) FROM nodes p WHERE p.document_id = n.document_id AND p.idx < n.idx AND p.level < n.level) AS parent_idx FROM nodes n)"""
_SECTIONS = r""", fenced AS (SELECT document_id, page_number, seq, md_line, starts_with(regexp_replace(md_line, '^\s+|\s+$', '', 'g'), '```') AS fence,
  sum(CASE WHEN starts_with(regexp_replace(md_line, '^\s+|\s+$', '', 'g'), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY seq) % 2 AS inside FROM md),
hd AS (SELECT *, NOT fence AND inside = 0 AND regexp_matches(md_line, '^#{1,6}\s+.*\S') AS is_header FROM fenced),
own AS (SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY seq) - 1 AS idx FROM hd),
sec AS (SELECT document_id, page_number, CAST(idx AS INT) AS idx, max(CASE WHEN is_header THEN length(regexp_extract(md_line, '^(#{1,6})', 1)) END) AS level,
  max(CASE WHEN is_header THEN regexp_replace(regexp_extract(md_line, '^#{1,6}\s+(.+)$', 1), '^\s+|\s+$', '', 'g') END) AS title, CAST(min(seq) AS INT) AS line_num,
  regexp_replace(string_agg(md_line, chr(10) ORDER BY seq), '^\s+|\s+$', '', 'g') AS text FROM own WHERE idx >= 0 GROUP BY 1, 2, 3)"""
_TOK = """, ends AS (SELECT s.*, CAST(coalesce((SELECT min(e.idx) FROM sec e WHERE e.document_id = s.document_id AND e.page_number = s.page_number AND e.idx > s.idx AND e.level <= s.level),
  (SELECT count(*) FROM sec e WHERE e.document_id = s.document_id AND e.page_number = s.page_number)) AS INT) AS end_idx FROM sec s),
tok AS (SELECT a.document_id, a.page_number, a.idx, a.level, a.title, a.text, a.end_idx, CAST(floor((sum(length(d.text)) + count(*) - 1) / 4) AS INT) AS token_count
  FROM ends a JOIN ends d ON d.document_id = a.document_id AND d.page_number = a.page_number AND d.idx >= a.idx AND d.idx < a.end_idx AND length(d.text) > 0 GROUP BY ALL)"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.spatial_tree(layouts.elements(spark, sf_dir))


def _r(c, name: str):
    return F.round(c, 6).alias(name)


# Filters


@_query(_PG + _REP + " SELECT document_id, form, n_pages, n_elements, round(avg_x, 6) AS avg_x, round(avg_y, 6) AS avg_y, first_text, zone FROM rep")
def a1_cross_page_repetition(spark, sf_dir):
    rep = filters.repetitions(layouts.elements(spark, sf_dir))
    return rep.select(DOC, "form", "n_pages", "n_elements", _r(F.col("avg_x"), "avg_x"), _r(F.col("avg_y"), "avg_y"), "first_text", "zone")


@_query(_PG + _REP + " SELECT fm.document_id, fm.form, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages FROM fm JOIN rep USING (document_id, form) GROUP BY 1, 2")
def a1_repeated_pages(spark, sf_dir):
    el = layouts.elements(spark, sf_dir)
    return filters.repeated_pages(el, filters.repetitions(el)).select(DOC, "form", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@_query(_PG + _KEPT + " SELECT document_id, page_number, seq, label, text_content FROM unrep")
def p23_j7_without_repeated(spark, sf_dir):
    return filters.without_repeated(layouts.elements(spark, sf_dir)).select(*PAGE, "seq", "label", "text_content")


@_query(_PG + _KEPT + " SELECT document_id, page_number, seq, filter_reason FROM flags")
def p21_p24_filter_flags(spark, sf_dir):
    return filters.flagged(layouts.elements(spark, sf_dir)).select(*PAGE, "seq", "filter_reason")


@_query(_PG + _KEPT + " SELECT document_id, coalesce(filter_reason, 'kept') AS filter_reason, count(*) AS n FROM flags GROUP BY 1, 2")
def a11_filter_stats(spark, sf_dir):
    return filters.filter_stats(filters.flagged(layouts.elements(spark, sf_dir)))


@_query(_PG + """, d AS (SELECT document_id, CAST(trunc(max(x2) * 1.05::DOUBLE) AS INT) AS w, CAST(trunc(max(y2) * 1.05::DOUBLE) AS INT) AS h FROM el GROUP BY 1)
SELECT document_id, page_number, seq FROM el JOIN d USING (document_id) WHERE (x2 < w * 0.3::DOUBLE OR x1 > w * (1 - 0.3::DOUBLE)) AND x2 - x1 < w * 0.15::DOUBLE AND y2 - y1 < h * 0.1::DOUBLE""")
def p22_margin_elements(spark, sf_dir):
    el = layouts.elements(spark, sf_dir)
    return el.join(filters.page_dims(el), DOC).where(filters.margin_reason(F.col("width"), F.col("height"), 0.3).isNotNull()).select(*PAGE, "seq")


@_query(_PG + " SELECT document_id, CAST(trunc(max(x2) * 1.05::DOUBLE) AS INT) AS width, CAST(trunc(max(y2) * 1.05::DOUBLE) AS INT) AS height, CAST(trunc(max(x2) * 1.1::DOUBLE) AS INT) AS tree_width, CAST(trunc(max(y2) * 1.1::DOUBLE) AS INT) AS tree_height FROM el GROUP BY 1")
def a2_page_dims(spark, sf_dir):
    el = layouts.elements(spark, sf_dir)
    return filters.page_dims(el).join(filters.page_dims(el, 1.1).select(DOC, F.col("width").alias("tree_width"), F.col("height").alias("tree_height")), DOC)


# Geometry


@_query(_PG + """ SELECT document_id, page_number, seq, CAST(trunc(x1 / 1200::DOUBLE * 999) AS INT) AS nx1, CAST(trunc(y2 / 5000::DOUBLE * 999) AS INT) AS ny2, CAST(trunc(x1 / 999.0::DOUBLE * 1200) AS INT) AS dx1, CAST(trunc(y2 / 999.0::DOUBLE * 5000) AS INT) AS dy2,
x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM el""")
def p1_p2_p3_boxes(spark, sf_dir):
    b, w, h = geo.box(), F.lit(1200.0), F.lit(5000.0)
    n, d = geo.normalised(b, w, h), geo.denormalised(b, w, h)
    cx, cy = geo.centre(b)
    return layouts.elements(spark, sf_dir).select(
        *PAGE, "seq", n[0].alias("nx1"), n[3].alias("ny2"), d[0].alias("dx1"), d[3].alias("dy2"), geo.width(b).alias("width"), geo.height(b).alias("height"), geo.area(b).alias("area"), cx.alias("cx"), cy.alias("cy")
    )


@_query(_PG + """, p AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM el WINDOW w AS (PARTITION BY document_id, page_number ORDER BY seq)),
q AS (SELECT *, LEAST(x2, px2) - GREATEST(x1, px1) AS ow, LEAST(y2, py2) - GREATEST(y1, py1) AS oh FROM p WHERE px1 IS NOT NULL)
SELECT document_id, page_number, seq, round(CASE WHEN ow > 0 THEN ow / LEAST(x2 - x1, px2 - px1)::DOUBLE ELSE 0 END, 6) AS h_overlap, round(CASE WHEN oh > 0 THEN oh / LEAST(y2 - y1, py2 - py1)::DOUBLE ELSE 0 END, 6) AS v_overlap,
round(CASE WHEN ow > 0 AND oh > 0 THEN ow * oh / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - ow * oh)::DOUBLE ELSE 0 END, 6) AS iou, y1 - py2 AS gap, round(CASE WHEN abs(y1 - py1) > 100 THEN 0 ELSE 1 - abs(y1 - py1) / 100.0::DOUBLE END, 6) AS proximity FROM q""")
def p4_p5_p6_p11_neighbours(spark, sf_dir):
    w = W.partitionBy(*PAGE).orderBy("seq")
    rows = layouts.elements(spark, sf_dir).withColumns({f"p_{c}": F.lag(c).over(w) for c in ("x1", "y1", "x2", "y2")}).where("p_x1 is not null")
    a, b = geo.box("p_"), geo.box()
    return rows.select(
        *PAGE, "seq", _r(geo.horizontal_overlap(a, b), "h_overlap"), _r(geo.vertical_overlap(a, b), "v_overlap"), _r(geo.iou(a, b), "iou"), (b.y1 - a.y2).alias("gap"), _r(geo.proximity(a.y1, b.y1), "proximity")
    )


_SCORES = """, dm AS (SELECT document_id, CAST(trunc(max(x2) * 1.1::DOUBLE) AS INT) AS w, CAST(trunc(max(y2) * 1.1::DOUBLE) AS INT) AS h, median((y2 - y1)::DOUBLE) FILTER (y2 > y1) AS m FROM el GROUP BY 1),
sc AS (SELECT el.*, w, h, m, CASE label WHEN 'title' THEN 1.0::DOUBLE WHEN 'sub_title' THEN 0.8 WHEN 'table' THEN 0.4 WHEN 'image' THEN 0.4 ELSE 0.3 END AS lw,
  LEAST(1.0::DOUBLE, (0.7::DOUBLE * ((x2 - x1) / w::DOUBLE) + 0.3::DOUBLE * ((y2 - y1) / h::DOUBLE)) * 2) AS ss, 1 - y1 / h::DOUBLE AS vs, CASE WHEN x1 >= w * 0.3::DOUBLE THEN 0 ELSE 1 - x1 / (w * 0.3::DOUBLE) END AS ins FROM el JOIN dm USING (document_id))"""
_LEVEL = "CASE WHEN {0} > 0.8 THEN 0 WHEN {0} > 0.6 THEN 1 WHEN {0} > 0.4 THEN 2 WHEN {0} > 0.25 THEN 3 WHEN {0} > 0.15 THEN 4 ELSE 5 END"
_PLACED = _SCORES + """, wh AS (SELECT *, LEAST(1.0::DOUBLE, (0.6::DOUBLE * coalesce((CASE WHEN y1 - lag(y2) OVER o < 0 THEN 0 ELSE y1 - lag(y2) OVER o END) / m, 1.5) + 0.4::DOUBLE * coalesce((CASE WHEN lead(y1) OVER o - y2 < 0 THEN 0 ELSE lead(y1) OVER o - y2 END) / m, 1.0)) / 2) AS ws FROM sc WINDOW o AS (PARTITION BY document_id ORDER BY page_number, seq)),
lv AS (SELECT *, 0.4::DOUBLE * lw + 0.25::DOUBLE * ws + 0.15::DOUBLE * ss + 0.1::DOUBLE * vs + 0.1::DOUBLE * ins AS score FROM wh)"""


def _placed(spark, sf_dir):
    return layouts.elements(spark, sf_dir).withColumn("read_idx", F.col("seq"))


@_query(_PG + _SCORES + " SELECT document_id, page_number, seq, lw AS label_weight, round(ss, 6) AS size_score, round(vs, 6) AS vertical_score, round(ins, 6) AS indent_score, round(0.4::DOUBLE * lw + 0.3::DOUBLE * ss + 0.2::DOUBLE * vs + 0.1::DOUBLE * ins, 6) AS spatial_score FROM sc")
def p7_p8_p9_p10_p14_scores(spark, sf_dir):
    rows = hierarchy.classified(layouts.elements(spark, sf_dir))
    c = lambda n: F.col(f"components.{n}")
    return rows.select(*PAGE, "seq", c("label").alias("label_weight"), _r(c("size"), "size_score"), _r(c("vertical"), "vertical_score"), _r(c("indent"), "indent_score"), _r(F.col("spatial_score"), "spatial_score"))


@_query(_PG + _PLACED + f" SELECT document_id, page_number, seq, round(ws, 6) AS whitespace, round(score, 6) AS spatial_score, {_LEVEL.format('round(score, 9)')} AS spatial_level FROM lv")
def p12_p13_p15_w8_levels(spark, sf_dir):
    rows = hierarchy.levels(_placed(spark, sf_dir))
    return rows.select(*PAGE, "seq", _r(F.col("whitespace"), "whitespace"), _r(F.col("spatial_score"), "spatial_score"), geo.level_of(F.round("spatial_score", 9)).alias("spatial_level"))


@_query(_PG + _PLACED + " SELECT document_id, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS t{i}" for i, q in enumerate((0.95, 0.8, 0.6, 0.4, 0.2))) + " FROM lv GROUP BY 1")
def a4_adaptive_thresholds(spark, sf_dir):
    rows = hierarchy.adaptive_thresholds(hierarchy.levels(_placed(spark, sf_dir)))
    return rows.select(DOC, *[_r(F.col(f"t{i}"), f"t{i}") for i in range(5)])


@_query(_PG + r""", l AS (SELECT document_id, page_number, seq, seq % 6 AS sp, CASE WHEN regexp_matches(md_line, '^#') THEN length(regexp_extract(md_line, '^(#+)', 1)) - 1 END AS mdl FROM md)
SELECT document_id, page_number, seq, mdl AS markdown_level, CASE WHEN abs(mdl - sp) > 1 THEN CAST(trunc(mdl * 0.5::DOUBLE + sp * 0.5::DOUBLE) AS INT) ELSE CAST(sp AS INT) END AS final_level, CASE WHEN mdl IS NULL THEN 'spatial_only' WHEN abs(mdl - sp) > 1 THEN 'blended' ELSE 'spatial_validated' END AS level_source FROM l""")
def p16_p17_markdown_levels(spark, sf_dir):
    rows = layouts.markdown_lines(spark, sf_dir).withColumn("text_content", F.col("md_line")).withColumn("spatial_level", (F.col("seq") % 6).cast("int"))
    return hierarchy.with_markdown(rows).select(*PAGE, "seq", "markdown_level", "final_level", "level_source")


# Zones

_BYPOS = """CASE WHEN y1 / h::DOUBLE > 0.92 AND (y2 - y1) / h::DOUBLE < 0.03 AND (x1 / w::DOUBLE + x2 / w::DOUBLE) / 2 > 0.4 AND (x1 / w::DOUBLE + x2 / w::DOUBLE) / 2 < 0.6 THEN 'page_number'
WHEN y1 / h::DOUBLE > 0.9 AND (y2 - y1) / h::DOUBLE < 0.08 THEN 'footer' WHEN y2 / h::DOUBLE < 0.1 AND (y2 - y1) / h::DOUBLE < 0.08 THEN 'header' WHEN y1 / h::DOUBLE > 0.85 AND (y2 - y1) / h::DOUBLE < 0.12 THEN 'footnote' END"""
_BYTEXT = r"""CASE WHEN regexp_matches(t, '(?i)^((Figure|Fig\.?)\s*\d+|(Table|Tab\.?)\s*\d+|(Hình)\s*\d+|(Bảng)\s*\d+|(Image|Img\.?)\s*\d+|(Chart|Graph)\s*\d+|\[\d+\])') THEN 'caption'
WHEN regexp_matches(t, '(?i)^(\d{1,4}$|-\s*\d+\s*-$|page\s*\d+|trang\s*\d+)') THEN 'page_number'
WHEN regexp_matches(t, '(?i)^(\d+\.(\d+\.)*\s+\S|[A-Z]+\.(\d+\.)*\s+\S|(Chapter|Section|Part)\s+\d+|(Chương|Phần|Mục)\s+\d+)') AND length(t) < 200 THEN 'section_heading' WHEN starts_with(lower(t), 'abstract') THEN 'abstract' END"""
_ZONED = _REP + _SCORES.replace("WITH", ",") + f""", tx AS (SELECT sc.*, {_STRIP.format("regexp_replace(text_content, '<[^>]+>', '', 'g')")} AS t, {_FORM} AS form FROM sc),
zs AS (SELECT tx.*, {_BYPOS} AS pos, {_BYTEXT} AS pat, CASE label WHEN 'title' THEN 'title_block' WHEN 'sub_title' THEN 'section_heading' WHEN 'table' THEN 'table' END AS lab FROM tx),
zn AS (SELECT zs.document_id, page_number, seq, CASE WHEN rep.zone IS NOT NULL THEN rep.zone WHEN lab IS NOT NULL THEN lab WHEN pat IS NOT NULL THEN pat WHEN pos IN ('page_number', 'footer', 'header') THEN pos WHEN pos IS NOT NULL THEN pos ELSE 'main_text' END AS zone,
  CASE WHEN rep.zone IS NOT NULL THEN 'repetition' WHEN lab IS NOT NULL THEN 'label' WHEN pat IS NOT NULL THEN 'pattern' WHEN pos IS NOT NULL THEN 'position' ELSE 'fallback' END AS zone_method
  FROM zs LEFT JOIN rep ON rep.document_id = zs.document_id AND rep.form = zs.form AND rep.zone IN ('header', 'footer'))"""


@_query(_PG + _ZONED + " SELECT document_id, page_number, seq, pos AS by_position, pat AS by_text, lab AS by_label FROM zs")
def p18_zone_rules(spark, sf_dir):
    el = layouts.elements(spark, sf_dir)
    w, h = F.col("width"), F.col("height")
    return el.join(filters.page_dims(el, 1.1), DOC).select(*PAGE, "seq", zones.by_position(w, h)["zone"].alias("by_position"), zones.by_text()["zone"].alias("by_text"), zones.by_label()["zone"].alias("by_label"))


@_query(_PG + _ZONED + " SELECT document_id, page_number, seq, zone, zone_method, CAST(CASE zone WHEN 'title_block' THEN 0 WHEN 'abstract' THEN 2 WHEN 'section_heading' THEN 3 WHEN 'main_text' THEN 4 WHEN 'table' THEN 5 WHEN 'caption' THEN 6 WHEN 'footnote' THEN 8 WHEN 'header' THEN 9 WHEN 'footer' THEN 10 WHEN 'page_number' THEN 10 ELSE 5 END AS INT) AS zone_priority FROM zn")
def p19_p20_zones(spark, sf_dir):
    return zones.classified(layouts.elements(spark, sf_dir)).select(*PAGE, "seq", "zone", "zone_method", "zone_priority")


@_query(_PG + _ZONED + " SELECT document_id, zone, count(*) AS n, min(page_number * 1000000 + seq) AS first FROM zn GROUP BY 1, 2")
def a13_elements_by_zone(spark, sf_dir):
    rows = zones.by_zone(zones.classified(layouts.elements(spark, sf_dir)))
    return rows.select(DOC, "zone", "n", (F.col("first.page_number").cast("long") * 1000000 + F.col("first.seq")).alias("first"))


# Layout of a page

_LINES = """, md2 AS (SELECT document_id, page_number, median((y2 - y1)::DOUBLE) FILTER (y2 > y1) AS m FROM el GROUP BY 1, 2),
li AS (SELECT *, sum(CASE WHEN y1 > far + m * 0.3::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY y1, seq) AS line_id FROM (
  SELECT el.*, m, max(y2) OVER (PARTITION BY document_id, page_number ORDER BY y1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM el JOIN md2 USING (document_id, page_number))),
lb AS (SELECT document_id, page_number, line_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n, any_value(m) AS m, list(label) AS labels FROM li GROUP BY 1, 2, 3),
bk AS (SELECT *, sum(CASE WHEN y1 - prev > m * 1.5::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY line_id) AS block_id FROM (SELECT *, lag(y2) OVER (PARTITION BY document_id, page_number ORDER BY line_id) AS prev FROM lb))"""


@_query(_PG + _LINES + " SELECT document_id, page_number, seq, CAST(line_id AS INT) AS line_id, m AS median_height FROM li")
def a3_w1_lines(spark, sf_dir):
    return layout.with_lines(layouts.elements(spark, sf_dir)).select(*PAGE, "seq", "line_id", "median_height")


@_query(_PG + _LINES + """ SELECT document_id, page_number, CAST(block_id AS INT) AS block_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_elements,
CASE WHEN bool_or(list_contains(labels, 'image')) THEN 'figure' WHEN bool_or(list_contains(labels, 'table')) THEN 'table' WHEN bool_or(list_contains(labels, 'title') OR list_contains(labels, 'sub_title')) THEN 'heading' ELSE 'text' END AS block_type FROM bk GROUP BY 1, 2, block_id""")
def a6_w2_blocks(spark, sf_dir):
    return layout.blocks(layout.with_lines(layouts.elements(spark, sf_dir)))


@_query(_PG + """, b AS (SELECT document_id, page_number, unnest(generate_series(x1 // 5, x2 // 5)) AS bin FROM el) SELECT document_id, page_number, CAST(bin AS INT) AS bin, count(*) AS n_boxes FROM b GROUP BY 1, 2, 3""")
def a14_x_histogram(spark, sf_dir):
    return layout.x_histogram(layouts.elements(spark, sf_dir))


_COLUMNS = """, b AS (SELECT DISTINCT document_id, page_number, unnest(generate_series(x1 // 5, x2 // 5)) AS bin FROM el), pw AS (SELECT document_id, page_number, max(x2) AS w FROM el GROUP BY 1, 2),
runs AS (SELECT document_id, page_number, coalesce(lag(bin) OVER (PARTITION BY document_id, page_number ORDER BY bin), -1) + 1 AS s, bin - 1 AS e FROM b),
cuts AS (SELECT document_id, page_number, w, (s + e + 1) // 2 * 5 AS cut FROM runs JOIN pw USING (document_id, page_number) WHERE e >= s AND e - s + 1 >= GREATEST(floor(floor(w * 0.05::DOUBLE) / 5), 1) UNION ALL SELECT document_id, page_number, w, w FROM pw),
spans AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY document_id, page_number ORDER BY cut), 0) AS l FROM cuts),
cols AS (SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY l) - 1 AS INT) AS column_index, CAST(l AS BIGINT) AS "left", CAST(cut AS BIGINT) AS "right" FROM spans WHERE cut - l >= w * 0.15::DOUBLE)"""


@_query(_PG + _COLUMNS + ' SELECT document_id, page_number, column_index, "left", "right" FROM cols')
def w4_columns(spark, sf_dir):
    return layout.columns_of(layouts.elements(spark, sf_dir))


_INCOL = _COLUMNS + ', ic AS (SELECT el.*, coalesce((SELECT min(column_index) FROM cols c WHERE c.document_id = el.document_id AND c.page_number = el.page_number AND (el.x1 + el.x2) / 2.0::DOUBLE BETWEEN c."left" AND c."right"), 0) AS column_index FROM el)'


@_query(_PG + _INCOL + " SELECT document_id, page_number, seq, column_index FROM ic")
def j6_column_of_element(spark, sf_dir):
    return layout.with_column(layouts.elements(spark, sf_dir)).select(*PAGE, "seq", "column_index")


@_query(_PG + _INCOL + " SELECT document_id, page_number, column_index, count(*) AS n FROM ic GROUP BY 1, 2, 3")
def a13_by_page_and_column(spark, sf_dir):
    return layout.by_page_and_column(layouts.elements(spark, sf_dir)).drop("elements")


_FIGS = ", zd AS (SELECT *, CASE WHEN seq % 4 = 1 THEN 'figure' WHEN seq % 4 = 2 THEN 'caption' WHEN seq % 4 = 3 THEN 'table' ELSE 'main_text' END AS zone FROM el)"


@_query(_PG + _FIGS + """, pr AS (SELECT c.document_id, c.page_number, c.seq, f.seq AS f_seq, f.zone AS f_zone, CASE WHEN c.y1 >= f.y1 THEN c.y1 - f.y2 ELSE f.y1 - c.y2 END AS d FROM zd c JOIN zd f ON f.document_id = c.document_id AND f.page_number = c.page_number AND c.zone = 'caption' AND f.zone IN ('figure', 'table')
WHERE (CASE WHEN c.y1 >= f.y1 THEN c.y1 - f.y2 ELSE f.y1 - c.y2 END) BETWEEN 0 AND (f.y2 - f.y1) * 0.15::DOUBLE AND abs((c.x1 + c.x2) / 2.0 - (f.x1 + f.x2) / 2.0) <= (f.x2 - f.x1) * 0.5::DOUBLE),
best AS (SELECT document_id, page_number, seq, arg_min(f_seq, d * 1000000 + f_seq) AS f_seq, arg_min(f_zone, d * 1000000 + f_seq) AS f_zone FROM pr GROUP BY 1, 2, 3)
SELECT c.document_id, c.page_number, c.seq, CAST(f_seq AS INT) AS linked_to, f_zone AS linked_zone FROM zd c LEFT JOIN best USING (document_id, page_number, seq) WHERE c.zone = 'caption'""")
def j5_captions(spark, sf_dir):
    zone = F.expr("CASE WHEN seq % 4 = 1 THEN 'figure' WHEN seq % 4 = 2 THEN 'caption' WHEN seq % 4 = 3 THEN 'table' ELSE 'main_text' END")
    return layout.linked_captions(layouts.elements(spark, sf_dir).withColumn("zone", zone)).select(*PAGE, "seq", F.col("linked_to").cast("int").alias("linked_to"), "linked_zone")


@_query(_PG + """, c AS (SELECT *, lag(y1) OVER (PARTITION BY document_id ORDER BY page_number, y1, seq) AS py FROM el)
SELECT document_id, page_number, seq, CAST(sum(CASE WHEN (CASE WHEN abs(y1 - py) > 100 THEN 0 ELSE 1 - abs(y1 - py) / 100.0::DOUBLE END) <= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_number, y1, seq) AS INT) AS cluster_id FROM c""")
def w3_clusters(spark, sf_dir):
    return layout.clusters(layouts.elements(spark, sf_dir)).select(*PAGE, "seq", "cluster_id")


# Paragraphs

_GAP = """, g AS (SELECT * FROM (SELECT document_id, page_number, seq, y1 - lag(y2) OVER (PARTITION BY document_id, page_number ORDER BY y1, seq) AS g FROM el WHERE label = 'text') WHERE g >= 0),
gr AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY g, page_number, seq) - 1 AS r, count(*) OVER (PARTITION BY document_id) AS n FROM g),
gp AS (SELECT e.document_id, coalesce(max(gr.g)::DOUBLE, any_value(e.m) * 1.5) AS gap FROM (SELECT document_id, median((y2 - y1)::DOUBLE) FILTER (y2 > y1) AS m FROM el GROUP BY 1) e LEFT JOIN gr ON gr.document_id = e.document_id AND r = LEAST(trunc(n * 0.7::DOUBLE), n - 1) GROUP BY 1),
pv AS (SELECT el.*, gap, lag(label) OVER w AS pl, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM el JOIN gp USING (document_id) WINDOW w AS (PARTITION BY document_id, page_number ORDER BY seq)),
gg AS (SELECT *, CAST(sum(CASE WHEN label = 'text' AND pl = 'text' AND y1 - py2 >= 0 AND y1 - py2 <= gap AND ((CASE WHEN LEAST(x2, px2) > GREATEST(x1, px1) THEN (LEAST(x2, px2) - GREATEST(x1, px1)) / LEAST(x2 - x1, px2 - px1)::DOUBLE ELSE 0 END) >= 0.5 OR abs(x1 - px1) <= 10) AND x1 - px1 < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, page_number ORDER BY seq) AS INT) AS group_id FROM pv)"""


@_query(_PG + _GAP + " SELECT document_id, gap FROM gp")
def a5_dynamic_gap(spark, sf_dir):
    return thinning.dynamic_gaps(layouts.elements(spark, sf_dir))


@_query(_PG + _GAP + """ SELECT document_id, page_number, CAST(min(seq) AS INT) AS seq, CASE WHEN count(*) > 1 THEN 'paragraph' ELSE min(label) END AS label, string_agg(text_content, ' ' ORDER BY seq) AS text_content, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(count(*) AS INT) AS merged_from FROM gg GROUP BY document_id, page_number, group_id""")
def a7_w5_w6_paragraphs(spark, sf_dir):
    rows = thinning.thinned(layouts.elements(spark, sf_dir)).drop("original_labels")
    return rows.withColumn("seq", F.col("seq").cast("int")).withColumn("merged_from", F.col("merged_from").cast("int"))


# Reading order

_EDGES = """, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY seq) - 1 AS idx FROM el),
pr AS (SELECT a.document_id, a.page_number, a.idx AS ai, b.idx AS bi, CASE
  WHEN (CASE WHEN LEAST(a.x2, b.x2) > GREATEST(a.x1, b.x1) THEN (LEAST(a.x2, b.x2) - GREATEST(a.x1, b.x1)) / LEAST(a.x2 - a.x1, b.x2 - b.x1)::DOUBLE ELSE 0 END) > 0.3 AND abs((a.y1 + a.y2) / 2.0 - (b.y1 + b.y2) / 2.0) > 5 THEN a.y1 + a.y2 < b.y1 + b.y2
  WHEN (CASE WHEN LEAST(a.y2, b.y2) > GREATEST(a.y1, b.y1) THEN (LEAST(a.y2, b.y2) - GREATEST(a.y1, b.y1)) / LEAST(a.y2 - a.y1, b.y2 - b.y1)::DOUBLE ELSE 0 END) > 0.3 AND abs((a.x1 + a.x2) / 2.0 - (b.x1 + b.x2) / 2.0) > 5 THEN a.x1 + a.x2 < b.x1 + b.x2
  WHEN a.y2 < b.y1 THEN true WHEN abs(a.y1 - b.y1) < (a.y2 - a.y1) * 0.5 THEN a.x1 + a.x2 < b.x1 + b.x2 ELSE a.y1 + a.y2 < b.y1 + b.y2 END AS ahead
  FROM r a JOIN r b ON a.document_id = b.document_id AND a.page_number = b.page_number AND a.idx < b.idx),
deg AS (SELECT r.document_id, r.page_number, r.seq, CAST(count(p.ai) AS INT) AS in_degree FROM r LEFT JOIN pr p ON p.document_id = r.document_id AND p.page_number = r.page_number AND ((p.bi = r.idx AND p.ahead) OR (p.ai = r.idx AND NOT p.ahead)) GROUP BY 1, 2, 3),
cy AS (SELECT document_id, page_number, count(DISTINCT in_degree) < count(*) AS cyclic FROM deg GROUP BY 1, 2)"""


@_query(_PG + _EDGES + " SELECT document_id, page_number, CAST(CASE WHEN ahead THEN ai ELSE bi END AS INT) AS src, CAST(CASE WHEN ahead THEN bi ELSE ai END AS INT) AS dst FROM pr")
def g1_g2_j4_edges(spark, sf_dir):
    return order.edges(layouts.elements(spark, sf_dir))


@_query(_PG + _EDGES + " SELECT document_id, page_number, cyclic FROM cy")
def g3_cycles(spark, sf_dir):
    return order.has_cycles(layouts.elements(spark, sf_dir))


@_query(_PG + _EDGES + " SELECT document_id, page_number, seq, in_degree AS read_idx FROM deg JOIN cy USING (document_id, page_number) WHERE NOT cyclic")
def g5_acyclic_order(spark, sf_dir):
    rows = order.in_degrees(layouts.elements(spark, sf_dir)).where(~F.col("cyclic"))
    return rows.select(*PAGE, "seq", F.col("in_degree").alias("read_idx"))


@_query()
def g4_g6_reading_order(spark, sf_dir):
    el = layouts.elements(spark, sf_dir)
    return order.document_order(order.reading_order(zones.classified(el))).select(*PAGE, "seq", "read_idx", "doc_idx")


# Trees


def _nodes(spark, sf_dir, deal=lambda el: el):
    level = F.expr("CASE label WHEN 'title' THEN 0 WHEN 'sub_title' THEN 2 WHEN 'table' THEN 4 WHEN 'image' THEN 3 ELSE 5 END")
    el = deal(layouts.elements(spark, sf_dir)).withColumn("idx", (F.row_number().over(W.partitionBy(DOC).orderBy("page_number", "seq")) - 1).cast("int")).withColumn("level", level)
    return tree.with_parents(el, [DOC]).withColumn("title", F.col("text_content"))


def _cut_title(rows):
    """The title as the SQL of outlines and summary lines has it: its first 20 characters."""
    return rows.withColumn("title", F.left(F.col("title"), F.lit(20)))


_DEPTHS = _TREE + ", dp AS (SELECT document_id, idx, parent_idx, 0 AS depth FROM par WHERE parent_idx IS NULL UNION ALL SELECT p.document_id, p.idx, p.parent_idx, d.depth + 1 FROM par p JOIN dp d ON d.document_id = p.document_id AND d.idx = p.parent_idx)"
_RPG = _PG.replace("WITH pg", "WITH RECURSIVE pg", 1)


@_query(_RPG + _DEPTHS + " SELECT document_id, idx, parent_idx, depth FROM dp")
def w9_parents(spark, sf_dir):
    return _nodes(spark, sf_dir).select(DOC, "idx", "parent_idx", "depth")


@_query(_RPG + _DEPTHS + " SELECT document_id, CAST(max(depth) + 1 AS INT) AS tree_depth, count(*) AS node_count FROM dp GROUP BY 1")
def a10_depth_and_count(spark, sf_dir):
    return tree.depth_and_count(_nodes(spark, sf_dir), [DOC])


@_query(_PG + _TREE + " SELECT document_id, idx FROM par p WHERE NOT EXISTS (SELECT 1 FROM par c WHERE c.document_id = p.document_id AND c.parent_idx = p.idx)")
def r3_leaves(spark, sf_dir):
    return tree.leaves(_nodes(spark, sf_dir), [DOC]).select(DOC, "idx")


@_query(_PG + _TREE + " SELECT document_id, idx, printf('%04d', idx) AS node_id FROM par")
def r2_w19_node_ids(spark, sf_dir):
    return tree.with_node_ids(_nodes(spark, sf_dir), [DOC]).select(DOC, "idx", "node_id")


@_query(_RPG + _DEPTHS + ", o AS (SELECT d.document_id, d.idx, d.depth, n.text_content[1:20] AS title FROM dp d JOIN nodes n USING (document_id, idx)) SELECT document_id, string_agg(repeat('  ', depth) || title, chr(10) ORDER BY idx) AS outline, string_agg(repeat('#', LEAST(depth + 1, 6)) || ' ' || title, chr(10) || chr(10) ORDER BY idx) AS markdown FROM o GROUP BY 1")
def r5_r6_outline_and_markdown(spark, sf_dir):
    rows = _cut_title(_nodes(spark, sf_dir))
    return tree.outline(rows, [DOC]).join(tree.as_markdown(rows, [DOC]), DOC)


@_query(_PG + _TREE + " SELECT document_id, string_agg('- ' || text_content[1:20] || ': ' || text_content[1:40], chr(10) ORDER BY idx) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS n FROM par) WHERE n <= 20 GROUP BY 1")
def o7_r7_summary_lines(spark, sf_dir):
    return tree.summary_lines(_cut_title(_nodes(spark, sf_dir)).withColumn("summary", F.left(F.col("text_content"), F.lit(40))), [DOC])


#: In pre-order a node opens its children or closes itself and all that end with it.
_NESTED = _RPG + _DEPTHS + """, o AS (SELECT d.document_id, d.idx, d.depth, n.text_content AS title, lead(d.depth) OVER (PARTITION BY d.document_id ORDER BY d.idx) AS nd, lag(d.depth) OVER (PARTITION BY d.document_id ORDER BY d.idx) AS pd FROM dp d JOIN nodes n USING (document_id, idx))
SELECT document_id, '[' || string_agg(CASE WHEN pd >= depth THEN ',' ELSE '' END || '{"node_id":"' || printf('%04d', idx) || '","title":' || CAST(to_json(title) AS VARCHAR) || CASE WHEN nd > depth THEN ',"children":[' ELSE '}' || repeat(']}', CAST(depth - coalesce(nd, 0) AS INT)) END, '' ORDER BY idx) || ']' AS tree FROM o GROUP BY 1"""


@_query(_RPG + _DEPTHS + ", o AS (SELECT d.document_id, d.idx, d.depth, n.text_content AS title FROM dp d JOIN nodes n USING (document_id, idx)) SELECT document_id, string_agg(repeat('  ', depth) || title, chr(10) ORDER BY idx) AS outline, string_agg(repeat('#', LEAST(depth + 1, 6)) || ' ' || title || chr(10) || chr(10) || title, chr(10) || chr(10) ORDER BY idx) AS markdown FROM o GROUP BY 1")
def r5_r6_whole_outline_and_markdown(spark, sf_dir):
    """Whole lines as titles, and as the texts below the headings."""
    # The SQL meets the nodes by their document, so one without a name has no row.
    rows = _nodes(spark, sf_dir, lambda el: tree.apart(el.where(F.col(DOC).isNotNull()), [DOC]))
    return tree.outline_and_markdown(rows, [DOC], title="text_content", text="text_content", dealt=True)


@_query(_PG + _TREE + " SELECT document_id, string_agg('- ' || text_content || ': ' || text_content, chr(10) ORDER BY idx) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS n FROM par) WHERE n <= 20 GROUP BY 1")
def o7_r7_whole_summary_lines(spark, sf_dir):
    return tree.summary_lines(_nodes(spark, sf_dir).withColumn("summary", F.col("text_content")), [DOC])


@_query(_NESTED)
def r1_r4_r9_nested_json(spark, sf_dir):
    return tree.nested_json_in_order(tree.with_node_ids(_nodes(spark, sf_dir), [DOC]), [DOC], ["node_id", "title"])


# Markdown


def _lines(spark, sf_dir):
    return layouts.markdown_lines(spark, sf_dir).withColumn("line_num", F.col("seq").cast("int"))


@_query(_PG + _SECTIONS + " SELECT document_id, page_number, idx, level, title, line_num, text FROM sec")
def w11_w12_sections(spark, sf_dir):
    return markdown.sections(_lines(spark, sf_dir), PAGE)


@_query(_PG + r""", o AS (SELECT *, coalesce(sum(length(md_line) + 1) OVER (PARTITION BY document_id, page_number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM md)
SELECT document_id, page_number, CAST(seq AS INT) AS line_num, CAST(off AS BIGINT) AS char_offset, length(regexp_extract(md_line, '^(#+)', 1)) - 1 AS level, regexp_replace(regexp_replace(md_line, '^#+\s+', ''), '^\s+|\s+$', '', 'g') AS title FROM o WHERE regexp_matches(md_line, '^#+\s+\S')""")
def w15_header_offsets(spark, sf_dir):
    return markdown.header_offsets(_lines(spark, sf_dir), PAGE)


def _tokens(spark, sf_dir):
    return tree.subtree_tokens(tree.with_ends(markdown.sections(_lines(spark, sf_dir), PAGE), PAGE, levels=range(1, 7)), PAGE)


@_query(_PG + _SECTIONS + _TOK + " SELECT document_id, page_number, idx, end_idx, token_count FROM tok")
def w13_t9_subtree_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select(*PAGE, "idx", F.col("end_idx").cast("int").alias("end_idx"), "token_count")


@_query(_PG + _SECTIONS + _TOK + """, stay AS (SELECT * FROM tok t WHERE NOT EXISTS (SELECT 1 FROM tok s WHERE s.document_id = t.document_id AND s.page_number = t.page_number AND s.token_count < 200 AND t.idx > s.idx AND t.idx < s.end_idx)),
j AS (SELECT s.document_id, s.page_number, s.idx, string_agg(d.text, chr(10) || chr(10) ORDER BY d.idx) AS text FROM stay s JOIN tok d ON d.document_id = s.document_id AND d.page_number = s.page_number AND d.idx >= s.idx AND d.idx < s.end_idx WHERE s.token_count < 200 GROUP BY 1, 2, 3)
SELECT s.document_id, s.page_number, s.idx, coalesce(j.text, s.text) AS text, CASE WHEN j.text IS NULL THEN s.token_count ELSE CAST(floor(length(j.text) / 4) AS INT) END AS token_count FROM stay s LEFT JOIN j USING (document_id, page_number, idx)""")
def w14_thin_tree(spark, sf_dir):
    return tree.thin(_tokens(spark, sf_dir), PAGE, 200).select(*PAGE, "idx", "text", "token_count")


@_query(_PG + " SELECT document_id, string_agg('# Page ' || page_number || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number) AS markdown FROM pg GROUP BY 1")
def a8_s12_joined_pages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = docs.select(F.col("source").alias(DOC), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("page_number"), F.col("text").alias("markdown_content"))
    return markdown.joined_pages(pages)


# Tagged text


@_query(_PG + " SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY seq) - 1 AS INT) AS tag, label, CAST(trunc(x1 / 999.0::DOUBLE * 1200) AS INT) AS x1, CAST(trunc(y1 / 999.0::DOUBLE * 999) AS INT) AS y1, CAST(trunc(x2 / 999.0::DOUBLE * 1200) AS INT) AS x2, CAST(trunc(y2 / 999.0::DOUBLE * 999) AS INT) AS y2, " + _STRIP.format("text_content") + " AS text_content FROM el")
def s7_parse_tags(spark, sf_dir):
    pages = layouts.tagged_pages(spark, sf_dir).withColumn("w", F.lit(1200)).withColumn("h", F.lit(999))
    return grounding.parse(pages, "tagged", "w", "h").select(*PAGE, "tag", "label", "x1", "y1", "x2", "y2", "text_content")


@_query(_PG + " SELECT document_id, page_number, count(*) AS n_tags, " + _STRIP.format("string_agg(chr(10) || text_content, chr(10) ORDER BY seq)") + " AS plain FROM el GROUP BY 1, 2")
def t1_t4_tags(spark, sf_dir):
    text = F.col("tagged")
    return layouts.tagged_pages(spark, sf_dir).select(*PAGE, F.size(grounding.references(text)).cast("long").alias("n_tags"), grounding.without_tags(text).alias("plain"))


@_query(_PG + """, im AS (SELECT *, sum(CASE WHEN label = 'image' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY seq) AS i FROM el),
cl AS (SELECT document_id, page_number, string_agg(CASE WHEN label = 'image' THEN chr(10) ELSE '' END || text_content, chr(10) ORDER BY seq) AS a, string_agg(CASE WHEN label = 'image' THEN chr(10) || chr(10) || '**[Figure ' || i || ']**' || chr(10) || chr(10) || chr(10) ELSE '' END || text_content, chr(10) ORDER BY seq) AS b FROM im GROUP BY 1, 2)
SELECT document_id, page_number, """ + _STRIP.format("a") + " AS cleaned, " + _STRIP.format("b") + " AS with_figures FROM cl")
def t3_cleaned(spark, sf_dir):
    text = F.col("tagged")
    return layouts.tagged_pages(spark, sf_dir).select(*PAGE, grounding.cleaned(text).alias("cleaned"), grounding.cleaned(text, True).alias("with_figures"))


# Text


@_query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM pages""")
def t6_without_html(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", txt.without_html(F.col("html")).alias("plain"))


@_query(_PG + r""" SELECT document_id, page_number, seq, CASE WHEN t = '' THEN 'text' ELSE t END AS header, regexp_replace(md_line, '^#+\s+', '') AS unsigned, CAST(floor(length(md_line) / 4) AS INT) AS n_tokens, CASE WHEN length(md_line) > 40 THEN md_line[1:40] || '...' ELSE md_line END AS short, CASE WHEN length(md_line) < 50 THEN md_line ELSE md_line[1:200] || '...' END AS summary,
regexp_replace(regexp_replace(md_line || ' .......... 12', '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS colons FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(md_line, '^\s+|\s+$', '', 'g'), '^#{1,6}\s+', ''), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM md)""")
def t2_t9_t13_t17_lines(spark, sf_dir):
    line = F.col("md_line")
    return layouts.markdown_lines(spark, sf_dir).select(
        *PAGE, "seq", txt.header_text(line, F.lit("text")).alias("header"), txt.without_header_signs(line).alias("unsigned"), txt.count_tokens(line).alias("n_tokens"), txt.shortened(line, 40).alias("short"), txt.summary_fallback(line).alias("summary"),
        txt.dots_to_colon(F.concat(line, F.lit(" .......... 12"))).alias("colons"),
    )


@_query("""SELECT doc_id, CAST(unnest(generate_series(0, CAST(ceil(length(text) / 2000.0) AS INT) - 1)) AS INT) AS piece, length(text[unnest(generate_series(0, CAST(ceil(length(text) / 2000.0) AS INT) - 1)) * 2000 + 1 : unnest(generate_series(0, CAST(ceil(length(text) / 2000.0) AS INT) - 1)) * 2000 + 2000]) AS n_chars FROM documents""")
def t16_pieces(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(txt.pieces(F.col("text"))).alias("piece", "part")).select("doc_id", "piece", F.length("part").cast("long").alias("n_chars"))


@_query("""WITH p AS (SELECT doc_id, text, CAST(unnest(generate_series(0, CAST(ceil(length(text) / 2000.0) AS INT) - 1)) AS INT) AS piece FROM documents) SELECT doc_id, piece, text[piece * 2000 + 1 : piece * 2000 + 2000] AS part FROM p""")
def t16_piece_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(txt.pieces(F.col("text"))).alias("piece", "part"))


@_query()
def t8_chunks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(txt.chunks(F.col("text"), 200, 20)).alias("chunk", "chunk_text"))


@_query("SELECT doc_id, '<physical_index_' || doc_id || '>' || chr(10) || text || chr(10) || '<physical_index_' || doc_id || '>' || chr(10) || chr(10) AS labelled, CAST(doc_id AS INT) AS physical_index, CAST(doc_id AS INT) AS first_page, CAST(doc_id + 1 AS INT) AS last_page, 'a-' || source || '.md' AS file_name, source AS document_name, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'image' END AS file_type FROM documents")
def t11_t12_t14_t15_t18_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled, i = txt.page_label(F.col("text"), F.col("doc_id")), F.col("doc_id").cast("string")
    pages = F.concat(F.lit("<start_index_"), i, F.lit("> x <start_index_"), (F.col("doc_id") + 1).cast("string"), F.lit(">"))
    path = F.concat(F.lit("a/"), F.col("source"), F.lit(".md"))
    kind = F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".png"))
    return docs.select("doc_id", labelled.alias("labelled"), txt.physical_index(labelled).alias("physical_index"), txt.first_start_page(pages).alias("first_page"), txt.last_start_page(pages).alias("last_page"), txt.file_name(path).alias("file_name"), txt.document_name(path).alias("document_name"), txt.file_type(kind).alias("file_type"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def t10_found_json(spark, sf_dir):
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\n"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_variant_get(txt.found_json(answer), "$.k", "string").alias("k"))


# Joins by title, code and range

_HEADS = r""", hs AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, seq) - 1 AS INT) AS idx, regexp_replace(line, '^\s+|\s+$', '', 'g') AS title FROM ln WHERE seq = 1 AND page_number % 3 = 0 AND length(trim(line)) > 0)"""


def _heads(spark, sf_dir):
    el = layouts.elements(spark, sf_dir)
    heads = el.where("seq = 1 and page_number % 3 = 0").withColumn("title", txt.stripped(F.col("text_content")))
    return el, heads.withColumn("idx", (F.row_number().over(W.partitionBy(DOC).orderBy("page_number", "seq")) - 1).cast("int")).select(DOC, "idx", "title")


@_query(_PG + _HEADS + " SELECT document_id, page_number, seq FROM el WHERE label IN ('title', 'sub_title') AND lower(" + _STRIP.format("text_content") + ") NOT IN (SELECT lower(title) FROM hs WHERE hs.document_id = el.document_id)")
def j8_implicit_sections(spark, sf_dir):
    el, heads = _heads(spark, sf_dir)
    return match.implicit_sections(el, heads).select(*PAGE, "seq")


@_query(_PG + _HEADS + """, ms AS (SELECT h.document_id, h.idx, e.page_number, e.seq, CASE WHEN lower(title) = t THEN 0.9 WHEN (contains(t, lower(title)) OR contains(lower(title), t)) AND label IN ('title', 'sub_title') THEN 0.6 ELSE 0 END AS s
FROM hs h JOIN (SELECT *, lower(""" + _STRIP.format("text_content") + """) AS t FROM el) e ON e.document_id = h.document_id WHERE title <> '' AND t <> ''), tp AS (SELECT *, row_number() OVER (PARTITION BY document_id, idx ORDER BY s DESC, page_number, seq) AS n FROM ms WHERE s > 0.2)
SELECT document_id, idx AS h_idx, page_number, seq, s::DOUBLE AS match_score FROM tp WHERE n = 1""")
def j10_best_matches(spark, sf_dir):
    el, heads = _heads(spark, sf_dir)
    return match.best_matches(heads, el)


_CODES = """, cd AS (SELECT document_id, page_number AS idx, CASE page_number % 3 WHEN 1 THEN CAST(page_number % 4 AS VARCHAR) WHEN 2 THEN (page_number - 1) % 4 || '.' || page_number % 2 ELSE (page_number - 2) % 4 || '.' || (page_number - 1) % 2 || '.1' END AS structure FROM pg)"""


@_query(_PG + _CODES + " SELECT document_id, CAST(idx AS INT) AS idx, structure, (SELECT CAST(max(p.idx) AS INT) FROM cd p WHERE p.document_id = cd.document_id AND p.idx < cd.idx AND p.structure = regexp_extract(cd.structure, '^(.*)\\.[^.]*$', 1) AND p.structure <> '') AS parent_idx FROM cd")
def j12_parents_by_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias(DOC), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("idx"))
    code = F.expr("CASE idx % 3 WHEN 1 THEN CAST(idx % 4 AS STRING) WHEN 2 THEN concat((idx - 1) % 4, '.', idx % 2) ELSE concat((idx - 2) % 4, '.', (idx - 1) % 2, '.1') END")
    return match.parents_by_code(docs.withColumn("structure", code), [DOC]).select(DOC, "idx", "structure", "parent_idx")


@_query(_PG + ", nd AS (SELECT document_id, CAST(page_number AS INT) AS idx, page_number AS s, page_number + page_number % 3 AS e FROM pg WHERE page_number % 5 = 1) SELECT nd.document_id, idx, string_agg(pg.text, '' ORDER BY pg.page_number) AS text, CAST(floor(sum(length(pg.text)) / 4) AS INT) AS tokens, floor(sum(length(pg.text)) / 4) > 2000 AS over_limit FROM nd JOIN pg ON pg.document_id = nd.document_id AND pg.page_number BETWEEN s AND e GROUP BY 1, 2")
def j13_r8_range_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = docs.select(F.col("source").alias(DOC), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("page_number"), "text")
    nodes = pages.where("page_number % 5 = 1").select(DOC, F.col("page_number").alias("idx"), F.col("page_number").alias("start_index"), (F.col("page_number") + F.col("page_number") % 3).alias("end_index"))
    return match.within_tokens(match.range_texts(nodes, pages, [DOC]), 2000).select(DOC, "idx", "text", "tokens", "over_limit")


# Tables of contents: the orders of a customer stand for its rows


_TOC = """WITH t AS (SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS idx, CAST(o_orderkey % 50 AS INT) AS page, CAST(o_orderkey % 50 + (CASE WHEN o_orderkey % 7 < 5 THEN 3 ELSE o_orderkey % 4 END) AS INT) AS physical_index, o_orderstatus = 'F' AS correct FROM orders)"""


def _toc(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_custkey").alias("k"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("idx"), (F.col("o_orderkey") % 50).cast("int").alias("page"),
        (F.col("o_orderkey") % 50 + F.when(F.col("o_orderkey") % 7 < 5, 3).otherwise(F.col("o_orderkey") % 4)).cast("int").alias("physical_index"), (F.col("o_orderstatus") == "F").alias("correct"),
    )


@_query(_TOC + ", d AS (SELECT k, physical_index - page AS d, count(*) AS n, min(idx) AS f FROM t GROUP BY 1, 2) SELECT k, CAST(arg_min(d, f - n * 1000000) AS INT) AS page_offset FROM d GROUP BY 1")
def a9_page_offset(spark, sf_dir):
    return toc.page_offset(_toc(spark, sf_dir).withColumn("page", F.col("page").cast("string")), ["k"])


@_query(_TOC + ", d AS (SELECT k, physical_index - page AS d, count(*) AS n, min(idx) AS f FROM t GROUP BY 1, 2), o AS (SELECT k, arg_min(d, f - n * 1000000) AS o FROM d GROUP BY 1) SELECT k, idx, CAST(page + o AS INT) AS physical_index FROM t JOIN o USING (k) WHERE page + o BETWEEN 5 AND 40")
def p27_w18_placed_rows(spark, sf_dir):
    rows = _toc(spark, sf_dir)
    return toc.valid_indices(toc.with_offset(rows, toc.page_offset(rows, ["k"]), ["k"]), F.lit(5), F.lit(40)).select("k", "idx", "physical_index")


@_query(_TOC + ", g AS (SELECT *, idx - row_number() OVER (PARTITION BY k ORDER BY idx) AS run FROM t WHERE correct) SELECT k, idx FROM g WHERE run = (SELECT min(run) FROM g h WHERE h.k = g.k)")
def w16_first_run(spark, sf_dir):
    return toc.first_run(_toc(spark, sf_dir).withColumn("page_number", F.col("idx")), ["k"], "correct").select("k", "idx")


@_query(_TOC + ", f AS (SELECT k, arg_min(physical_index, idx) AS p FROM t GROUP BY 1), a AS (SELECT k, idx, 'row' AS title, physical_index FROM t UNION ALL SELECT k, -1, 'Preface', 1 FROM f WHERE p > 1) SELECT k, idx, title, physical_index AS start_index, coalesce(lead(physical_index) OVER (PARTITION BY k ORDER BY idx), 60) AS end_index FROM a")
def w10_w17_ranges(spark, sf_dir):
    rows = _toc(spark, sf_dir).withColumn("title", F.lit("row")).withColumn("structure", F.col("idx").cast("string"))
    return toc.page_ranges(toc.with_preface(rows, ["k"]), ["k"], F.lit(60)).select("k", "idx", "title", "start_index", "end_index")


@_query(_TOC + " SELECT k, idx, last_value(CASE WHEN correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_index, first_value(CASE WHEN correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_index FROM t")
def j14_correct_neighbours(spark, sf_dir):
    return toc.correct_neighbours(_toc(spark, sf_dir), ["k"]).select("k", "idx", "prev_index", "next_index")


@_query(_TOC + " SELECT k, CASE WHEN max(physical_index) < 50 / 2.0 THEN 0 ELSE round(avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END), 6) END AS accuracy FROM t GROUP BY 1")
def a12_accuracy(spark, sf_dir):
    return toc.accuracy(_toc(spark, sf_dir), ["k"], F.lit(50)).select("k", _r(F.col("accuracy"), "accuracy"))


@_query(_TOC + " SELECT a.k, a.idx, b.physical_index FROM t a JOIN t b ON a.k = b.k AND a.page % 10 = b.page % 10 AND b.physical_index >= 4")
def j9_title_matches(spark, sf_dir):
    rows = _toc(spark, sf_dir).withColumn("title", F.col("page") % 10)
    return toc.title_matches(rows.select("k", "idx", "title"), rows, ["k"], F.lit(4)).select("k", "idx", "physical_index")


# The stored tables


@_query(_PG + " SELECT document_id, page_number, seq, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY seq) - 1 AS INT) AS sequence_order, round(x1 / 1200::DOUBLE * 999.0, 6) AS norm_x1, round(y2 / 5000::DOUBLE * 999.0, 6) AS norm_y2 FROM el")
def s9_stored_elements(spark, sf_dir):
    rows = store.element_rows(layouts.elements(spark, sf_dir), F.lit(1200), F.lit(5000))
    return rows.select(*PAGE, "seq", "sequence_order", _r(F.col("norm_x1"), "norm_x1"), _r(F.col("norm_y2"), "norm_y2"))


@_query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def o1_listed(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return store.listed(rows, 50, 20).select("id")


@_query("SELECT k, id FROM (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def o2_latest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return store.latest(rows, ["k"]).select("k", "id")


@_query(_PG + " SELECT document_id, page_number, seq, el.label, length(pg.text) AS page_chars FROM el JOIN pg USING (document_id, page_number) WHERE el.label = 'table'")
def j1_j2_j3_p25_elements_of_pages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = docs.select(F.col("source").alias(DOC), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("page_number"), F.length("text").cast("long").alias("page_chars"))
    return layouts.elements(spark, sf_dir).where("label = 'table'").join(pages, PAGE).select(*PAGE, "seq", "label", "page_chars")


# Composite plans


@_query()
def c1_spatial_tree(spark, sf_dir):
    return flagship(spark, sf_dir)


@_query(_PG + _INCOL + """, m AS (SELECT document_id, page_number, column_index, median((y2 - y1)::DOUBLE) FILTER (y2 > y1) AS m FROM ic GROUP BY 1, 2, 3),
l AS (SELECT *, sum(CASE WHEN y1 > far + m * 0.3::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number, column_index ORDER BY y1, seq) AS line_id FROM (SELECT ic.*, m, max(y2) OVER (PARTITION BY document_id, page_number, column_index ORDER BY y1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ic JOIN m USING (document_id, page_number, column_index)))
SELECT document_id, page_number, column_index, seq, CAST(line_id AS INT) AS line_id FROM l""")
def c2_page_layout(spark, sf_dir):
    return pipelines.page_layout(layouts.elements(spark, sf_dir))[0].select(*PAGE, "column_index", "seq", "line_id")


@_query()
def c3_matched_tree(spark, sf_dir):
    # Numbers that rise through a document, and need no line but the headers to be sorted.
    lines = _lines(spark, sf_dir).withColumn("line_num", F.col("page_number") * F.lit(1 << 32) + F.col("seq"))
    return pipelines.matched_tree(layouts.elements(spark, sf_dir), lines).select(DOC, "idx", "node_id", "title", "level", "origin", "parent_idx", "depth")


@_query(_PG + _SECTIONS + _TOK + """ SELECT document_id, page_number, idx, printf('%04d', row_number() OVER (PARTITION BY document_id, page_number ORDER BY idx)) AS node_id, title, token_count, (SELECT max(p.idx) FROM tok p WHERE p.document_id = t.document_id AND p.page_number = t.page_number AND p.idx < t.idx AND p.level < t.level) AS parent_idx FROM tok t""")
def c4_markdown_tree(spark, sf_dir):
    return pipelines.markdown_tree(_lines(spark, sf_dir), PAGE).select(*PAGE, "idx", "node_id", "title", "token_count", "parent_idx")


@_query(_PG + _SECTIONS + _TOK + """ SELECT document_id, page_number, idx, CASE WHEN length(text) < 50 THEN text WHEN length(body) < 50 THEN body ELSE body[1:200] || '...' END AS summary FROM (SELECT *, string_split(text, chr(10) || chr(10))[-1] AS body FROM tok)""")
def x3_x4_summaries(spark, sf_dir):
    from quire.operators import enrich

    return enrich.summaries(_tokens(spark, sf_dir)).select(*PAGE, "idx", "summary")


# Rows chosen, ordered and put together


@_query(_PG + f" SELECT document_id, page_number, seq, {_FORM} AS form FROM el")
def t5_matching_forms(spark, sf_dir):
    return layouts.elements(spark, sf_dir).select(*PAGE, "seq", txt.matching_form(F.col("text_content")).alias("form"))


@_query(_PG + f""", tx AS (SELECT *, {_STRIP.format("text_content")} AS t FROM el) SELECT document_id, page_number, seq, regexp_matches(t, '(?i)^((Figure|Fig\\.?)\\s*\\d+|(Table|Tab\\.?)\\s*\\d+|(Hình)\\s*\\d+|(Bảng)\\s*\\d+|(Image|Img\\.?)\\s*\\d+|(Chart|Graph)\\s*\\d+|\\[\\d+\\])') AS caption, regexp_matches(t, '(?i)^(\\d{{1,4}}$|-\\s*\\d+\\s*-$|page\\s*\\d+|trang\\s*\\d+)') AS page_no FROM tx""")
def t7_patterns(spark, sf_dir):
    t = txt.stripped(F.col("text_content"))
    return layouts.elements(spark, sf_dir).select(*PAGE, "seq", txt.any_of(t, txt.CAPTIONS).alias("caption"), txt.any_of(t, txt.PAGE_NUMBERS).alias("page_no"))


@_query("SELECT doc_id, substring(sha256(source || '/' || doc_id), 1, 32) AS id FROM documents")
def t19_stored_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", store.stored_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@_query(_PG + " SELECT document_id, page_number, seq FROM el WHERE label = 'sub_title'")
def p26_nodes_of_type(spark, sf_dir):
    return store.of_type(layouts.elements(spark, sf_dir), "sub_title", "label").select(*PAGE, "seq")


@_query(_PG + _SECTIONS + _TOK + " SELECT document_id, page_number, title, printf('%04d', row_number() OVER (PARTITION BY document_id, page_number ORDER BY idx)) AS node_id, level FROM tok")
def p28_clean_structure(spark, sf_dir):
    rows = tree.without_fields(pipelines.markdown_tree(_lines(spark, sf_dir), PAGE), ["text", "token_count"])
    return tree.in_order(rows, PAGE, ["title", "node_id", "text", "summary", "level"])


@_query(_PG + """ SELECT document_id, page_number, seq, CAST(to_json({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) AS VARCHAR) AS bbox, page_number % 2 = 1 AS has_norm, false AS has_crop_image FROM el""")
def p29_responses(spark, sf_dir):
    rows = store.element_rows(layouts.elements(spark, sf_dir), F.when(F.col("page_number") % 2 == 1, 1200), F.lit(5000))
    return store.responses(rows).select(*PAGE, "seq", F.to_json("bbox").alias("bbox"), F.col("bbox_norm").isNotNull().alias("has_norm"), "has_crop_image")


@_query(_PG + _PLACED + _HEADS + """, ms AS (SELECT h.document_id, h.idx, e.page_number, e.seq, CASE WHEN lower(title) = t THEN 0.9 WHEN (contains(t, lower(title)) OR contains(lower(title), t)) AND label IN ('title', 'sub_title') THEN 0.6 ELSE 0 END AS s
FROM hs h JOIN (SELECT *, lower(""" + _STRIP.format("text_content") + """) AS t FROM el) e ON e.document_id = h.document_id WHERE title <> '' AND t <> ''), tp AS (SELECT *, row_number() OVER (PARTITION BY document_id, idx ORDER BY s DESC, page_number, seq) AS n FROM ms WHERE s > 0.2),
fs AS (SELECT h.document_id, h.idx, h.idx % 5 AS m, """ + _LEVEL.format("round(score, 9)") + """ AS sp, coalesce(label, '') AS label, tp.s FROM hs h LEFT JOIN tp ON tp.document_id = h.document_id AND tp.idx = h.idx AND n = 1 LEFT JOIN lv ON lv.document_id = tp.document_id AND lv.page_number = tp.page_number AND lv.seq = tp.seq)
SELECT document_id, idx, CASE WHEN s IS NULL THEN m WHEN abs(m - sp) > 1 THEN CAST(trunc(CASE WHEN label IN ('title', 'sub_title') THEN m * 0.6::DOUBLE + sp * 0.4::DOUBLE ELSE m * 0.4::DOUBLE + sp * 0.6::DOUBLE END) AS INT) ELSE m END AS level, CASE WHEN s IS NULL THEN 'markdown' ELSE 'matched' END AS origin FROM fs""")
def j11_fused_headers(spark, sf_dir):
    el, heads = _heads(spark, sf_dir)
    spatial = hierarchy.levels(_placed(spark, sf_dir)).select(*PAGE, "seq", "label", geo.level_of(F.round("spatial_score", 9)).alias("spatial_level"))
    return match.fused(heads.withColumn("level", F.col("idx") % 5), match.best_matches(heads, el), spatial).select(DOC, "idx", "level", "origin")


@_query(_PG + _TREE + ", tops AS (SELECT * FROM par WHERE parent_idx IS NULL)" + re.sub(r"\bel\b", "tops", _GAP) + " SELECT document_id, page_number, CAST(min(seq) AS INT) AS seq, CAST(count(*) AS INT) AS merged_from FROM gg GROUP BY document_id, page_number, group_id")
def w7_thinned_top(spark, sf_dir):
    return thinning.thinned_top(_nodes(spark, sf_dir)).select(*PAGE, F.col("seq").cast("int").alias("seq"), F.col("merged_from").cast("int").alias("merged_from"))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def o3_by_id(spark, sf_dir):
    return store.by_id(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), 7, "c_custkey")


@_query(_PG + " SELECT document_id, page_number, seq, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, seq) AS INT) AS stored_place, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, y1, seq) AS INT) AS height_place FROM el")
def o4_o6_places(spark, sf_dir):
    return store.in_page_order(layouts.elements(spark, sf_dir)).select(*PAGE, "seq", "stored_place", "height_place")


@_query(_PG + """, parts AS (SELECT document_id, page_number, seq, NULL AS y1, 0 AS part FROM el WHERE label = 'title' UNION ALL SELECT document_id, page_number, seq, y1, 1 AS part FROM el WHERE label <> 'title')
SELECT document_id, page_number, seq, part, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, coalesce(y1, 0), part, seq) - 1 AS INT) AS idx FROM parts""")
def o5_u1_sorted_sections(spark, sf_dir):
    el = layouts.elements(spark, sf_dir)
    rows = match.sorted_sections(el.where("label = 'title'").select(*PAGE, "seq"), el.where("label <> 'title'").select(*PAGE, "seq", "y1"))
    return rows.select(*PAGE, "seq", "part", "idx")


@_query("SELECT o_orderkey FROM orders ORDER BY md5('3/' || o_orderkey), o_orderkey LIMIT 40")
def o8_sampled(spark, sf_dir):
    return toc.sampled(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), 40, "o_orderkey", 3)


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def u2_difference(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").join(orders, "c_custkey", "left_anti")


@_query("""WITH p AS (SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT min(source) FROM documents))
SELECT 'documents' AS name, count(DISTINCT source) AS n FROM p UNION ALL SELECT 'pages', count(*) FROM p UNION ALL SELECT 'layout_elements', count(*) FROM p UNION ALL SELECT 'tree_indices', count(DISTINCT source) FROM p UNION ALL SELECT 'tree_nodes', count(DISTINCT source) FROM p""")
def s10_cascade(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    sources = docs.select(F.col("source").alias("id")).distinct()
    tables = {
        "documents": sources, "pages": docs.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id")), "layout_elements": docs.select(F.col("doc_id").alias("page_id")),
        "tree_indices": sources.select(F.concat(F.lit("t"), "id").alias("id"), F.col("id").alias("document_id")), "tree_nodes": sources.select(F.concat(F.lit("t"), "id").alias("tree_index_id")),
    }
    counts = None
    for name, rows in store.cascade(tables, sources.agg(F.min("id").alias("id"))).items():
        n = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return counts


_TITLED = """, x AS (SELECT k, idx, page, physical_index, page % 10 AS title, CASE idx % 3 WHEN 1 THEN CAST(idx % 4 AS VARCHAR) WHEN 2 THEN (idx - 1) % 4 || '.' || idx % 2 ELSE (idx - 2) % 4 || '.' || (idx - 1) % 2 || '.1' END AS structure FROM t),
d AS (SELECT a.k, b.physical_index - a.page AS d, count(*) AS n, min(a.idx) AS f FROM x a JOIN x b ON a.k = b.k AND a.title = b.title AND b.physical_index >= 1 GROUP BY 1, 2),
o AS (SELECT k, d AS off FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, f, d) AS r FROM d) WHERE r = 1),
v AS (SELECT x.k, idx, structure, CAST(title AS VARCHAR) AS title, CAST(page + off AS INT) AS p FROM x JOIN o USING (k) WHERE page + off BETWEEN 1 AND 45),
w AS (SELECT * FROM v UNION ALL SELECT k, -1, '0', 'Preface', 1 FROM (SELECT k, arg_min(p, idx) AS p FROM v GROUP BY 1) WHERE p > 1)"""


@_query(_TOC + _TITLED + r""" SELECT k, idx, title, p AS start_index, coalesce(lead(p) OVER (PARTITION BY k ORDER BY idx), 45) AS end_index,
(SELECT CAST(max(u.idx) AS INT) FROM w u WHERE u.k = w.k AND u.idx < w.idx AND u.structure <> '' AND u.structure = regexp_extract(w.structure, '^(.*)\.[^.]*$', 1)) AS parent_idx FROM w""")
def c5_toc_tree(spark, sf_dir):
    code = F.expr("CASE idx % 3 WHEN 1 THEN CAST(idx % 4 AS STRING) WHEN 2 THEN concat((idx - 1) % 4, '.', idx % 2) ELSE concat((idx - 2) % 4, '.', (idx - 1) % 2, '.1') END")
    rows = _toc(spark, sf_dir).withColumn("title", (F.col("page") % 10).cast("string")).withColumn("structure", code)
    logical = rows.select("k", "idx", "structure", "title", "page")
    return pipelines.toc_tree(logical, rows.select("k", "title", "physical_index"), ["k"], F.lit(45)).select("k", "idx", "title", "start_index", "end_index", "parent_idx")


def _books(spark, sf_dir):
    """Fifty documents to a book, each a page that starts with its title; page 1 lists them, with some wrong pages and in every fourth book only such."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(DOC, F.expr("doc_id div 50"))
    docs = docs.withColumn("p", F.row_number().over(W.partitionBy(DOC).orderBy("doc_id"))).withColumn("title", F.concat(F.lit("Item "), "doc_id"))
    printed = F.when(F.col(DOC) % 4 == 3, F.col("p") * 37 % 50).when(F.col("doc_id") % 7 == 0, F.col("p") + 2).otherwise(F.col("p"))
    code = F.concat(F.expr("(p - 1) div 5 + 1"), F.when(F.col("p") % 5 == 1, "").otherwise(F.concat(F.lit("."), F.expr("(p - 1) % 5"))))
    line = F.concat(code, F.lit(" "), "title", F.lit(" ........ "), printed)
    listed = docs.groupBy(DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return listed.select(DOC, F.lit(1).alias("page_number"), "text").unionByName(docs.select(DOC, (F.col("p") + 1).alias("page_number"), F.concat("title", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")))


_BOOKS = r"""WITH d AS (SELECT doc_id // 50 AS document_id, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS p FROM documents),
pg AS (SELECT document_id, 1 AS page_number, string_agg(((p - 1) // 5 + 1) || CASE WHEN p % 5 = 1 THEN '' ELSE '.' || ((p - 1) % 5) END || ' Item ' || doc_id || ' ........ ' || CASE WHEN document_id % 4 = 3 THEN p * 37 % 50 WHEN doc_id % 7 = 0 THEN p + 2 ELSE p END, chr(10) ORDER BY p) AS text FROM d GROUP BY 1
UNION ALL SELECT document_id, p + 1, 'Item ' || doc_id || chr(10) || text FROM d),
sp AS (SELECT document_id, page_number, string_split_regex(regexp_replace(regexp_replace(text, '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g'), '\r?\n') AS ls FROM pg),
li AS (SELECT document_id, page_number, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM sp),
ln AS (SELECT *, regexp_matches(line, '^\s*(.*?\S)\s*(?::|\.{2,}|\s{2,})\s*(\d+)\s*$') AS paged FROM li WHERE trim(line, ' ') <> ''),
lk AS (SELECT DISTINCT document_id, page_number, regexp_replace(lower(regexp_replace(line, '^\s*(\d+(?:\.\d+)*)\.?\s+', '')), '[\x09-\x0d ]+', '', 'g') AS key FROM ln),
fl AS (SELECT document_id, page_number, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS run FROM (SELECT document_id, page_number FROM ln GROUP BY 1, 2 HAVING count(*) FILTER (paged) >= 3 AND 2 * count(*) FILTER (paged) >= count(*))),
ru AS (SELECT document_id, page_number FROM fl JOIN (SELECT document_id, min(run) AS run, min(page_number) AS b FROM fl GROUP BY 1) USING (document_id, run) WHERE b <= 20),
eb AS (SELECT document_id, page_number, no, line, paged, CASE WHEN paged THEN regexp_extract(line, '^\s*(.*?\S)\s*(?::|\.{2,}|\s{2,})\s*(\d+)\s*$', 1) ELSE trim(line, ' ') END AS body FROM ln JOIN ru USING (document_id, page_number) WHERE paged OR regexp_matches(line, '^\s*(\d+(?:\.\d+)*)\.?\s+')),
ec AS (SELECT *, nullif(regexp_extract(body, '^\s*(\d+(?:\.\d+)*)\.?\s+', 1), '') AS structure, trim(regexp_replace(body, '^\s*(\d+(?:\.\d+)*)\.?\s+', ''), ' ') AS title, CASE WHEN paged THEN TRY_CAST(regexp_extract(line, '(\d+)\s*$', 1) AS INT) END AS page FROM eb),
en AS (SELECT document_id, structure, title, page, regexp_replace(lower(regexp_replace(title, '^\s*(\d+(?:\.\d+)*)\.?\s+', '')), '[\x09-\x0d ]+', '', 'g') AS key, row_number() OVER (PARTITION BY document_id ORDER BY page_number, no) - 1 AS idx FROM ec WHERE title <> ''),
fo AS (SELECT en.document_id, idx, page_number AS pi FROM en JOIN lk USING (document_id, key) WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM ru WHERE ru.document_id = lk.document_id AND ru.page_number = lk.page_number)),
fi AS (SELECT document_id, idx, min(pi) AS pi FROM fo GROUP BY 1, 2),
df AS (SELECT document_id, pi - page AS off, count(*) AS n, min(idx) AS f FROM en JOIN fi USING (document_id, idx) WHERE page IS NOT NULL GROUP BY 1, 2),
og AS (SELECT document_id, off FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f, off) AS r FROM df) WHERE r = 1),
lp AS (SELECT document_id, max(page_number) AS last FROM pg GROUP BY 1),
tr AS (SELECT document_id, idx, structure, title, key, page + off AS pi, 0 AS place FROM en JOIN og USING (document_id) UNION ALL SELECT document_id, idx, structure, title, key, pi, 1 FROM en JOIN fi USING (document_id, idx)),
sa AS (SELECT document_id, page_number AS pi, regexp_replace(lower(text), '[\x09-\x0d ]+', '', 'g') AS said, regexp_replace(lower(regexp_replace(text, '^\s*(\d+(?:\.\d+)*)\.?\s+', '')), '[\x09-\x0d ]+', '', 'g') AS start FROM pg),
vr AS (SELECT tr.*, last, coalesce(contains(said, key), false) AS correct FROM tr JOIN lp USING (document_id) LEFT JOIN sa USING (document_id, pi) WHERE tr.pi BETWEEN 1 AND last),
ch AS (SELECT document_id, min(place) AS place FROM (SELECT document_id, place, CASE WHEN max(pi) < max(last) / 2 THEN 0 ELSE avg(correct::INT) END AS a FROM vr GROUP BY 1, 2) WHERE a > 0.6 GROUP BY 1),
nb AS (SELECT vr.*, coalesce(last_value(CASE WHEN correct THEN pi END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
coalesce(first_value(CASE WHEN correct THEN pi END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), last) AS hi FROM vr JOIN ch USING (document_id, place)),
rp AS (SELECT document_id, idx, structure, title, key, coalesce(CASE WHEN NOT correct THEN (SELECT min(fo.pi) FROM fo WHERE fo.document_id = nb.document_id AND fo.idx = nb.idx AND fo.pi BETWEEN lo AND hi) END, pi) AS pi FROM nb),
st AS (SELECT rp.*, coalesce(starts_with(start, key), false) AS starts FROM rp LEFT JOIN sa USING (document_id, pi)),
w AS (SELECT document_id, idx, structure, title, pi, starts FROM st UNION ALL SELECT document_id, -1, '0', 'Preface', 1, false FROM (SELECT document_id, arg_min(pi, idx) AS p FROM st GROUP BY 1) WHERE p > 1)
"""


@_query(_BOOKS + r"""SELECT document_id, CAST(idx AS INT) AS idx, structure, title, CAST(pi AS INT) AS start_index, CAST(coalesce(lead(CASE WHEN starts THEN pi - 1 ELSE pi END) OVER (PARTITION BY document_id ORDER BY idx), last) AS INT) AS end_index,
(SELECT CAST(max(u.idx) AS INT) FROM w u WHERE u.document_id = w.document_id AND u.idx < w.idx AND u.structure = nullif(regexp_extract(w.structure, '^(.*)\.[^.]*$', 1), '')) AS parent_idx FROM w JOIN lp USING (document_id)""")
def x6_w10_contents_tree(spark, sf_dir):
    nodes, _ = contents.contents_tree(_books(spark, sf_dir), [DOC])
    return nodes.select(DOC, "idx", "structure", "title", "start_index", "end_index", "parent_idx")


@_query()
def c6_index_summary(spark, sf_dir):
    return pipelines.tree_summary(flagship(spark, sf_dir))
