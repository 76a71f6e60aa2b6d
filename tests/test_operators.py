"""Small cases with hand-computed results."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire import schema
from quire.config import Settings
from quire.functions import geometry as geo
from quire.functions import text as txt
from quire.operators import enrich, filters, layout, markdown, order, store, thinning, tree, zones
from quire.plans import pipelines
from quire.sources import files, grounding
from quire.streaming import pages as streaming

COLUMNS = "document_id string, page_number int, seq int, label string, text_content string, x1 long, y1 long, x2 long, y2 long"


def elements(spark, rows):
    """Rows of (page, label, text, x1, y1, x2, y2)."""
    return spark.createDataFrame([("d", p, i, label, text, *box) for i, (p, label, text, *box) in enumerate(rows)], COLUMNS)


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    "rows, count",
    [
        ([(1, "text", "a", 50, 100, 500, 120), (1, "equation", "e", 50, 125, 500, 145), (1, "text", "b", 50, 150, 500, 170)], 3),
        ([(1, "text", "a", 50, 100, 500, 120), (1, "text", "b", 50, 125, 500, 145), (1, "text", "c", 50, 150, 500, 170)], 1),
        ([(1, "text", "a", 50, 900, 500, 920), (2, "text", "b", 50, 50, 500, 70)], 2),
        ([(1, "title", "t", 50, 50, 500, 70), (1, "text", "a", 50, 100, 500, 120), (1, "text", "b", 50, 125, 500, 145), (1, "equation", "e", 50, 150, 500, 170), (1, "text", "c", 50, 175, 500, 195), (1, "text", "d", 50, 200, 500, 220)], 4),
    ],
)
def test_thinning(spark, rows, count):
    out = thinning.thinned(elements(spark, rows), 5.0).collect()
    assert len(out) == count
    assert all(r["label"] == "paragraph" for r in out if r["merged_from"] > 1)


def test_tags(spark):
    text = "<|ref|>title<|/ref|><|det|>[[0,0,999,999]]<|/det|>\nA\n<|ref|>text<|/ref|><|det|>[[10,10,20,20],[30,30,40,40]]<|/det|> B <|ref|>x<|/ref|><|det|>oops<|/det|>C"
    twice = "<|ref|>t<|/ref|><|det|>[[1,1,2,2]]<|/det|>one<|ref|>t<|/ref|><|det|>[[1,1,2,2]]<|/det|>two"
    rows = spark.createDataFrame([(1, text, 1000, 800), (2, twice, 999, 999), (3, None, 1, 1), (4, "plain", 1, 1)], "page_number int, tagged string, w int, h int")
    out = grounding.parse(rows, "tagged", "w", "h").orderBy("page_number", "tag", "box").collect()
    assert [(r["page_number"], r["label"], r["x2"], r["y2"], r["text_content"]) for r in out] == [(1, "title", 1000, 800, "A"), (1, "text", 20, 16, "B"), (1, "text", 40, 32, "B"), (2, "t", 2, 2, "one"), (2, "t", 2, 2, "two")]
    image = "x\n<|ref|>image<|/ref|><|det|>[[1,1,2,2]]<|/det|>\n<|ref|>text<|/ref|><|det|>[[1,1,2,2]]<|/det|> gone\nstays <|ref|>image<|/ref|><|det|>[[1,1,2,2]]<|/det|>"
    assert one(spark, grounding.cleaned(F.lit(image))) == "x\n\nstays"
    assert one(spark, grounding.cleaned(F.lit(image), True)) == "x\n\n\n**[Figure 1]**\n\n\nstays \n\n**[Figure 2]**"
    assert one(spark, grounding.cleaned(F.lit(None).cast("string"))) == ""


def test_boxes(spark):
    rows = spark.createDataFrame([(0, 0, 1000, 800), (0, 0, 500, 400), (13, 27, 401, 799), (5, 5, 5, 5)], "x1 int, y1 int, x2 int, y2 int")
    w, h = F.lit(1000), F.lit(800)
    for r in rows.select("*", F.array(*geo.normalised(geo.box(), w, h)).alias("n")).withColumn("b", F.array(*geo.denormalised(geo.Box(*[F.col("n")[i] for i in range(4)]), w, h))).collect():
        assert all(abs(a - b) <= 3 for a, b in zip(r["b"], (r["x1"], r["y1"], r["x2"], r["y2"])))
    assert rows.select(geo.area(geo.box()).alias("a")).collect()[3]["a"] == 0


@pytest.mark.parametrize(
    "text, zone",
    [("Figure 3. A", "caption"), ("Bảng 2", "caption"), ("- 5 -", "page_number"), ("Page 7", "page_number"), ("1. Intro", "section_heading"), ("1.2 Methods", None), ("Abstract of it", "abstract"), ("<center>Table 1</center>", "caption"), ("Word. x", "section_heading"), ("", None), (None, None)],
)
def test_zone_by_text(spark, text, zone):
    found = one(spark, zones.by_text(F.lit(text).cast("string")))
    assert (found["zone"] if found else None) == zone


def test_reading_order_of_cyclic_pages(spark):
    rng = random.Random(3)
    rows = [(p, "text", "t", *(x := rng.randint(0, 800), y := rng.randint(0, 800), x + rng.randint(20, 400), y + rng.randint(20, 400))) for p in range(1, 13) for _ in range(25)]
    el = elements(spark, rows)
    assert order.has_cycles(el).where("cyclic").count() > 0
    out = order.reading_order(el).toPandas()
    assert len(out) == len(rows)
    for _, page in out.groupby("page_number"):
        assert sorted(page["read_idx"]) == list(range(len(page)))
    whole = order.reading_order(el, "document").toPandas()
    assert sorted(whole["read_idx"]) == list(range(len(rows)))


def _by_rule(boxes, edges):
    """Of the first cycle that a search in order of numbers meets the edge from the lowest to the highest upper side goes, and so on; then what waits for nothing, the uppermost and leftmost first."""
    after = {i: sorted(d for s, d in edges if s == i) for i in range(len(boxes))}

    def first_cycle():
        done = set()

        def down(i, path):
            for d in after[i]:
                if d in path:
                    return path[path.index(d) :]
                if d not in done and (met := down(d, [*path, d])):
                    return met
            done.add(i)

        return next((met for i in after if i not in done and (met := down(i, [i]))), None)

    while cycle := first_cycle():
        links = list(zip(cycle, cycle[1:] + cycle[:1]))
        steepest = max(boxes[s][1] - boxes[d][1] for s, d in links)
        s, d = next(e for e in links if boxes[e[0]][1] - boxes[e[1]][1] == steepest)
        after[s].remove(d)
    free, out = [i for i in after if not any(i in to for to in after.values())], []
    while free:
        free.sort(key=lambda i: (boxes[i][1], boxes[i][0]))
        i = free.pop(0)
        out.append(i)
        free += [d for d in after[i] if all(d not in to for s, to in after.items() if s not in out)]
    return out


def test_cycles_are_untangled_by_the_rule(spark):
    rng = random.Random(11)
    rows = [(p, "text", "t", *(x := rng.randint(0, 40) * 20, y := rng.randint(0, 40) * 20, x + rng.randint(20, 400), y + rng.randint(20, 400))) for p in range(1, 17) for _ in range(24)]
    el = elements(spark, rows)
    number = {}
    for i, r in enumerate(rows):
        number.setdefault(r[0], []).append(i)
    edges = {}
    for r in order.edges(el).collect():
        edges.setdefault(r["page_number"], []).append((r["src"], r["dst"]))
    cyclic = {r["page_number"] for r in order.has_cycles(el).where("cyclic").collect()}
    assert len(cyclic) > 8
    found = {}
    for r in order.reading_order(el).orderBy("read_idx").collect():
        found.setdefault(r["page_number"], []).append(r["seq"])
    for p, own in number.items():
        assert found[p] == [own[i] for i in _by_rule([rows[i][3:] for i in own], edges[p])], p


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [(1, "text", f"{c}{i}", 50 + 500 * c, 100 + 40 * i, 450 + 500 * c, 130 + 40 * i) for i in range(3) for c in (0, 1)]
    placed = layout.with_column(elements(spark, rows)).collect()
    assert {r["column_index"] for r in placed if r["x1"] > 500} == {1}
    assert {r["column_index"] for r in placed if r["x1"] < 500} == {0}


def test_filters_bear_nulls_and_empty_tables(spark):
    rows = [(p, "text", None if p == 2 else "Head 12", 10, 10, 60, 30) for p in range(1, 6)] + [(1, "text", "big", 0, 0, 900, 900)]
    out = {(r["page_number"], r["seq"]): r["filter_reason"] for r in filters.flagged(elements(spark, rows)).collect()}
    assert out[1, 0] == "repeated" and out[2, 1] is None and out[1, 5] == "too_large"
    empty = spark.createDataFrame([], COLUMNS)
    assert filters.flagged(empty).count() == 0 and pipelines.spatial_tree(empty).count() == 0


def test_parents_against_a_stack(spark):
    rng = random.Random(1)
    levels = [rng.randint(0, 5) for _ in range(200)]
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate(levels)], "document_id string, idx int, level int")
    stack, want = [], []
    for i, v in enumerate(levels):
        while stack and stack[-1][1] >= v:
            stack.pop()
        want.append((stack[-1][0] if stack else None, len(stack)))
        stack.append((i, v))
    out = tree.with_parents(rows, ["document_id"]).orderBy("idx").collect()
    assert [(r["parent_idx"], r["depth"]) for r in out] == want


def test_nested_json(spark):
    import json

    rows = spark.createDataFrame([("d", 0, 0, "a"), ("d", 1, 1, 'b"'), ("d", 2, 2, "c"), ("d", 3, 0, None)], "document_id string, idx int, level int, title string")
    made = tree.nested_json(tree.with_parents(rows, ["document_id"]), ["document_id"], ["title"]).first()["tree"]
    assert json.loads(made) == [{"title": "a", "children": [{"title": 'b"', "children": [{"title": "c"}]}]}, {}]


def test_nested_json_of_deep_trees(spark):
    import json

    rows = spark.createDataFrame([("d", i, i - 1 if i else None, i, f"t{i}") for i in range(10)], "document_id string, idx int, parent_idx int, depth int, title string")
    now, seen = json.loads(tree.nested_json(rows, ["document_id"], ["title"]).first()["tree"]), []
    while now:
        seen.append(now[0]["title"])
        now = now[0].get("children")
    assert seen == [f"t{i}" for i in range(10)]
    assert tree.nested_json(rows.where("false"), ["document_id"], ["title"]).count() == 0


def test_nested_json_in_order_is_the_same(spark):
    import json

    rng = random.Random(5)
    rows = [(f"d{d}", i, rng.randint(0, 5), rng.choice([None, "", 'a "b"', "c\n", "d"]), None if rng.random() < 0.2 else i) for d in range(30) for i in range(rng.randint(1, 25))]
    made = tree.with_parents(spark.createDataFrame(rows, "document_id string, idx int, level int, title string, page int"), ["document_id"])
    got, want = (sorted(map(tuple, f(made, ["document_id"], ["title", "page"]).collect())) for f in (tree.nested_json_in_order, tree.nested_json))
    assert got == want and len(got) == 30
    assert all(json.loads(t) for _, t in got)
    assert tree.nested_json_in_order(made.where("false"), ["document_id"], ["title"]).count() == 0


def test_nested_json_has_whole_titles(spark):
    import json

    from quire import registry
    from quire.sources import layouts

    def titles(nodes):
        return [t for n in nodes for t in (n["title"], *titles(n.get("children", [])))]

    data = "/root/testdata/sf0.001"
    made = [t for r in registry.queries()["r1_r4_r9_nested_json"](spark, data).collect() for t in titles(json.loads(r["tree"]))]
    assert sorted(made) == sorted(r["text_content"] for r in layouts.elements(spark, data).select("text_content").collect())


def test_markdown_sections(spark):
    text = "before\n# A\nx\n```\n# no\n```\n  ## indented\n## B\ny\n\n"
    lines = markdown.numbered_lines(spark.createDataFrame([("d", text)], "document_id string, text string"), ["document_id"])
    out = markdown.sections(lines, ["document_id"]).orderBy("idx").collect()
    assert [(r["level"], r["title"], r["text"]) for r in out] == [(1, "A", "# A\nx\n```\n# no\n```\n  ## indented"), (2, "B", "## B\ny")]


def test_chunks(spark):
    def by_hand(text, limit, overlap):
        done, now, n = [], [], 0
        for s in text.split(". "):
            k = len(s) // 4
            if n + k > limit and now:
                done.append(". ".join(now) + ".")
                now, n = ([now[-1], s], 2 * k) if overlap else ([s], k)
            else:
                now.append(s)
                n += k
        return done + [". ".join(now)]

    text = ". ".join("word " * k for k in (3, 9, 14, 2, 30, 1, 1, 8))
    for limit, overlap in ((5, 0), (12, 3), (1000, 1)):
        assert one(spark, txt.chunks(F.lit(text), limit, overlap)) == by_hand(text, limit, overlap)


def test_json(spark):
    for text, want in (('{"a":1}', '{"a":1}'), ('x ```json\n{"a":1}\n``` y', '{"a":1}'), ('so {"a":1} it is', '{"a":1}'), ("list [1,2]", "[1,2]"), ("none", None)):
        found = one(spark, F.to_json(txt.found_json(F.lit(text))))
        assert found == want
    assert one(spark, F.to_json(txt.lenient_json(F.lit('{"a": None,}')))) == '{"a":null}'
    assert one(spark, F.to_json(txt.lenient_json(F.lit("nothing")))) == "{}"


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.create()
    now = F.lit("2024-01-01").cast("timestamp")
    docs = store.documents(spark.createDataFrame([("a.PDF", 2), ("b.png", 1)], "filename string, total_pages int"), now)
    s.append("documents", docs)
    ids = {r["filename"]: r["id"] for r in docs.collect()}
    s.append("pages", spark.createDataFrame([("p1", ids["a.PDF"], 1), ("p2", ids["b.png"], 1)], "id string, document_id string, page_number int"))
    s.append("layout_elements", spark.createDataFrame([("e1", "p1", "text", 1), ("e0", "p1", "title", 0), ("e2", "p2", "text", 0)], "id string, page_id string, label string, sequence_order int"))
    assert [r["id"] for r in s.elements(ids["a.PDF"]).collect()] == ["e0", "e1"]
    assert s.elements(ids["a.PDF"], "title").count() == 1
    assert s.document(ids["a.PDF"]).first()["file_type"] == "pdf" and s.list_documents().count() == 2
    left = s.delete_documents(docs.where("filename = 'a.PDF'"), str(tmp_path / "t"))
    assert [left.read(n).count() for n in ("documents", "pages", "layout_elements")] == [1, 1, 1]
    with pytest.raises(ValueError):
        s.list_documents(101)


def test_pluggable_steps(spark):
    rows = spark.createDataFrame([("short",), ("x" * 300,), (None,)], "text string")
    assert [r["summary"] for r in enrich.summaries(rows).collect()] == ["short", "x" * 200 + "...", None]
    assert enrich.client("offline").count_tokens("12345678") == 2
    with pytest.raises(ValueError):
        Settings().having(nonsense=1)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nb")
    assert files.markdown_files(spark, str(tmp_path / "*.md")).first()["text"] == "# A\nb"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (800).to_bytes(4, "big") + (600).to_bytes(4, "big")
    (tmp_path / "a.png").write_bytes(png)
    assert files.binary_files(spark, str(tmp_path / "*.png")).select(files.image_size("content").alias("s")).first()["s"] == (800, 600)
    pages = files.recognised(files.binary_files(spark, str(tmp_path / "*.png")), lambda path, data: [(1, "<|ref|>text<|/ref|><|det|>[[0,0,9,9]]<|/det|>hi", 800, 600)])
    assert grounding.parse(pages, "tagged", "width", "height").first()["text_content"] == "hi"


def test_loose_rows_become_canonical(spark):
    rows = spark.createDataFrame([(3, "t", 1)], "page int, text string, bbox_x1 int")
    out = schema.normalise(rows).first()
    assert (out["page_number"], out["text_content"], out["x1"], out["y2"], out["label"]) == (3, "t", 1, 0, "text")


def test_stream(spark, tmp_path):
    tag = "<|ref|>title<|/ref|><|det|>[[10,10,900,60]]<|/det|>\nA\n<|ref|>text<|/ref|><|det|>[[10,800,900,900]]<|/det|>\nbody"
    spark.createDataFrame([("d", 1, tag, 1000, 1000)], streaming.PAGES).write.parquet(str(tmp_path / "in"))
    query = streaming.index_documents(streaming.arriving_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_settings_of_the_tree(spark):
    rows = [(1, "title", "# T", 50, 50, 700, 90)] + [(p, "text", f"line {p} {i} of it", 50, 120 + 30 * i, 700, 140 + 30 * i) for p in (1, 2) for i in range(6)]
    el = elements(spark, rows)
    assert pipelines.spatial_tree(el).count() == len(rows)
    thin = pipelines.spatial_tree(el, Settings(use_thinning=True, adaptive=True, order="document"))
    assert 0 < thin.count() < len(rows)
    assert isinstance(thin.toPandas(), pd.DataFrame)


def test_sample_does_not_depend_on_tasks(spark):
    from quire.operators import toc

    rows = spark.range(200)
    one = {r.id for r in toc.sampled(rows.repartition(1), 20, "id", 5).collect()}
    assert len(one) == 20 and one == {r.id for r in toc.sampled(rows.repartition(7), 20, "id", 5).collect()}
    assert one != {r.id for r in toc.sampled(rows, 20, "id", 6).collect()}


def test_ranges_beyond_the_document(spark):
    from quire.operators import match

    pages = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 4, "c")], "k string, page_number int, text string")
    nodes = spark.createDataFrame([("d", 0, 1, 1_000_000_000), ("d", 1, 2, 3), ("d", 2, 9, 12), ("d", 3, 3, 1), ("e", 4, 1, 2)], "k string, idx int, start_index int, end_index int")
    got = {r.idx: r.text for r in match.range_texts(nodes, pages, ["k"]).collect()}
    assert got == {0: "abc", 1: "b", 2: "", 3: "", 4: ""}


def test_thinning_nested_small_subtrees(spark):
    from quire.operators import tree

    rows = spark.createDataFrame(
        [("d", 0, 5, 900, "top"), ("d", 1, 4, 40, "one"), ("d", 2, 4, 20, None), ("d", 3, 4, 10, "three"), ("d", 4, 5, 500, "four")],
        "k string, idx int, end_idx int, token_count int, text string",
    )
    got = {r.idx: (r.text, r.token_count) for r in tree.thin(rows, ["k"], 100).collect()}
    assert got == {0: ("top", 900), 1: ("one\n\nthree", 2), 4: ("four", 500)}


def test_parents_by_code_are_the_last_before(spark):
    from quire.operators import match

    rows = spark.createDataFrame([("d", 1, "1"), ("d", 2, "1.1"), ("d", 3, "1"), ("d", 4, "1.2"), ("d", 5, "2.1"), ("d", 6, "")], "k string, idx int, structure string")
    assert {r.idx: r.parent_idx for r in match.parents_by_code(rows, ["k"]).collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None}
