"""What must not be lost or doubled: deep levels, wide tags, split and replayed batches, matches that no join may miss."""

import random
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quire import checkpoints, profiles, registry
from quire.operators import match, tree, zones
from quire.plans import pipelines
from quire.streaming import pages as streaming



def test_levels_out_of_range_are_refused_or_taken_from_the_data(spark):
    rows = [("d", i, level) for i, level in enumerate([1, 3, 9, 12, 12, 2, 30])]
    df = spark.createDataFrame(rows, "document_id string, idx int, level int")
    with pytest.raises(Exception, match="level outside"):
        tree.with_parents(df, ["document_id"]).collect()
    got = tree.with_parents(df, ["document_id"], levels=None).orderBy("idx").collect()
    assert [(r["parent_idx"], r["depth"]) for r in got] == [(None, 0), (0, 1), (1, 2), (2, 3), (2, 3), (0, 1), (5, 2)]
    assert tree.with_parents(df.where("false"), ["document_id"], levels=None).count() == 0


def brute_matches(heads, rows, least=0.2):
    """Every header with every element of its document."""
    out = {}
    for d, i, title, box in heads:
        best = None
        for e, page, seq, label, text, *b in rows:
            if d != e:
                continue
            h, t = title.strip().lower(), (text or "").strip().lower()
            score = 0.9 if h and h == t else 0.6 if h and t and (h in t or t in h) and label.lower() in match.HEADING else 0.0
            if box:
                w, k = max(0, min(box[2], b[2]) - max(box[0], b[0])), max(0, min(box[3], b[3]) - max(box[1], b[1]))
                union = (box[2] - box[0]) * (box[3] - box[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * k
                if union and w * k / union > 0.3:
                    score = max(score, w * k / union)
            if score > least and (best is None or (-score, page, seq) < best):
                best = (-score, page, seq)
        if best:
            out[d, i] = (best[1], best[2], round(-best[0], 9))
    return out


@pytest.mark.parametrize("boxes", [False, True])
def test_matches_against_all_pairs(spark, boxes):
    rng = random.Random(4)
    words = ["a", "ab", "intro", "introduction", "method", "methods of it", "", " Results ", "results", "x y z", "the introduction to methods"]
    box = lambda: (x := rng.randint(0, 900), y := rng.randint(0, 900), x + rng.randint(5, 600), y + rng.randint(5, 600))
    rows = [(f"d{rng.randint(0, 2)}", rng.randint(1, 3), s, rng.choice(["title", "text", "Sub_Title"]), rng.choice([*words, None]), *box()) for s in range(150)]
    heads = [(f"d{i % 3}", i, rng.choice(words), rng.choice([None, box()])) for i in range(40)]
    el = spark.createDataFrame(rows, "document_id string, page_number int, seq int, label string, text_content string, x1 int, y1 int, x2 int, y2 int")
    hd = spark.createDataFrame([(d, i, t, *(b or (None,) * 4)) for d, i, t, b in heads], "document_id string, idx int, title string, x1 int, y1 int, x2 int, y2 int")
    if not boxes:
        hd, heads = hd.drop("x1", "y1", "x2", "y2"), [(d, i, t, None) for d, i, t, _ in heads]
    got = {(r["document_id"], r["h_idx"]): (r["page_number"], r["seq"], round(r["match_score"], 9)) for r in match.best_matches(hd, el).collect()}
    assert got == brute_matches(heads, rows)


def most_rows(df):
    """The most rows that any step of a frame's plan gave when it was collected."""
    def walk(node):
        names = {"AdaptiveSparkPlanExec": "finalPhysicalPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ReusedExchangeExec": "child"}
        kind = node.getClass().getSimpleName()
        if kind in names:
            return walk(getattr(node, names[kind])())
        here = node.metrics().get("numOutputRows")
        kids = node.children()
        return max([here.get().value() if here.isDefined() else 0, *[walk(kids.apply(i)) for i in range(kids.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("title", ["the introduction to methods", "introduction", "about the introduction to methods, and of what follows from them"])
def test_matches_of_copies_are_not_all_pairs(spark, title):
    rows = [("d", 1 + i // 50, i, "title", "the introduction to methods", 0, 0, 9, 9) for i in range(300)]
    el = spark.createDataFrame(rows, "document_id string, page_number int, seq int, label string, text_content string, x1 int, y1 int, x2 int, y2 int")
    heads = [("d", i, title, None) for i in range(300)]
    best = match.best_matches(spark.createDataFrame([h[:3] for h in heads], "document_id string, idx int, title string"), el)
    got = {(r["document_id"], r["h_idx"]): (r["page_number"], r["seq"], r["match_score"]) for r in best.collect()}
    assert got == brute_matches(heads, rows)
    assert most_rows(best) < 5000


def test_zones_of_documents_of_many_pages(spark, tmp_path):
    """Places beyond page 2147 need more than 32 bits, and no row holds a zone's texts."""
    text = lambda i: "\n".join([f"the title of page {'abcdefghij'[i % 10]}{i}x", "a line that is long enough to be text " + "z" * (i % 7), *([f"late {i}x"] if i > 2300 else [])])
    docs = spark.createDataFrame([(i, text(i), "one") for i in range(1, 2401)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["zone"]: (r["n"], r["first"]) for r in registry.queries()["a13_elements_by_zone"](spark, str(tmp_path)).collect()}
    assert got["section_heading"] == (100, 2301 * 1000000 + 3)
    assert sum(n for n, _ in got.values()) == 2400 * 2 + 100
    el = spark.createDataFrame([("d", 2, 1, "text"), ("d", 1, 2, "text"), ("d", 1, 1, "title")], "document_id string, page_number int, seq int, zone string")
    assert "array" not in {kind.split("<")[0] for _, kind in zones.by_zone(el).dtypes}
    assert sorted(map(tuple, zones.in_zones(el).collect())) == [("d", 1, 1, "title", 1), ("d", 1, 2, "text", 1), ("d", 2, 1, "text", 2)]


def test_fused_headers_of_copies(spark):
    rows = [("d", 1 + i // 50, i, "title", "the introduction", 0, 0, 9, 9) for i in range(300)]
    el = spark.createDataFrame(rows, "document_id string, page_number int, seq int, label string, text_content string, x1 int, y1 int, x2 int, y2 int")
    heads = spark.createDataFrame([("d", i, "The introduction" if i else "alone", 4) for i in range(300)], "document_id string, idx int, title string, level int")
    fused = match.fused(heads, match.best_matches(heads, el), el.select("document_id", "page_number", "seq", "label", F.lit(1).alias("spatial_level")))
    got = {r["idx"]: (r["page_number"], r["seq"], r["level"], r["origin"]) for r in fused.collect()}
    assert got == {0: (None, None, 4, "markdown")} | {i: (1, 0, 2, "matched") for i in range(1, 300)}
    assert most_rows(fused) < 5000


def test_matched_tree_is_not_written_in_between(spark, monkeypatch):
    """Levels deeper than a layout's, without a checkpoint of all rows to find them."""
    monkeypatch.setattr(pipelines, "cut", lambda df: pytest.fail("written"))
    el = spark.createDataFrame([("d", 1, 1, "title", "Top", 0, 0, 90, 20), ("d", 1, 2, "sub_title", "Only here", 0, 30, 90, 50)], "document_id string, page_number int, seq int, label string, text_content string, x1 int, y1 int, x2 int, y2 int")
    lines = spark.createDataFrame([("d", 1, "# Top"), ("d", 2, "######### Deep")], "document_id string, line_num int, md_line string")
    got = {r["title"]: (r["level"], r["origin"]) for r in pipelines.matched_tree(el, lines).collect()}
    assert set(got) == {"Top", "Only here", "Deep"} and got["Deep"] == (8, "markdown") and got["Only here"][1] == "layout"


def test_whole_outline_and_markdown_make_no_list_of_nodes(spark, tmp_path):
    """A tree's texts come from nodes that pass by: neither a list of them nor a join of whole texts."""
    texts = [(1, "a", "Top\nbelow it comes a line that is long enough\nsub\n\nand again a line that is long enough"), (2, "a", "Next"), (3, "b", "\u00e4\u00f6"), (4, None, "lost")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["r5_r6_whole_outline_and_markdown"](spark, str(tmp_path))
    got = {r["document_id"]: (r["outline"], r["markdown"]) for r in df.collect()}
    long, again = "below it comes a line that is long enough", "and again a line that is long enough"
    assert got["a"] == (f"Top\n  {long}\n  sub\n    {again}\nNext", f"# Top\n\nTop\n\n## {long}\n\n{long}\n\n## sub\n\nsub\n\n### {again}\n\n{again}\n\n# Next\n\nNext")
    assert got["b"] == ("\u00e4\u00f6", "# \u00e4\u00f6\n\n\u00e4\u00f6") and len(got) == 2
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("batch,short", [(1, 3), (7, 4 << 20), (10000, 40)])
def test_texts_of_trees_over_batches(spark, monkeypatch, batch, short):
    monkeypatch.setattr(tree._Text, "SHORT", short)
    rng = random.Random(6)
    rows = [(d, e, i, i % 9, rng.choice(["", f"t{i}", "\u4e2d\u6587", None]), rng.choice([f"x{i}", "", None])) for d, e in [("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", None)] for i in range(23)]
    rows += [("none", 1, i, 0, None, None) for i in range(3)] + [("empty", 1, 0, 0, "", ""), ("one", 1, 5, 1, "t", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d string, e int, idx int, depth int, title string, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for text in ("text", None):
            got = {(r["d"], r["e"]): (r["outline"], r["markdown"]) for r in tree.outline_and_markdown(df, ["d", "e"], text=text).collect()}
            assert set(got) == {r[:2] for r in rows}
            for key, both in got.items():
                mine = sorted((r[2:] for r in rows if r[:2] == key), key=lambda r: r[0])
                outline = "\n".join("  " * d + t for _, d, t, _ in mine if t is not None)
                parts = ["#" * min(d + 1, 6) + f" {t}" + (f"\n\n{x}" if text else "") for _, d, t, x in mine if t is not None and (x is not None or not text)]
                assert both == (outline, "\n\n".join(parts))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_trees_have_tasks_of_their_own(spark):
    """Neither does hashing put two into one task, nor does Spark put tasks together; and an executor has one of these tasks at a time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        df = spark.createDataFrame([(d, i, 0, f"t{i}") for d in "abcdefgh" for i in range(50)], "d string, idx int, depth int, title string")
        got = tree.outline_and_markdown(df, ["d"]).select("d", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({r["task"] for r in got}) == len(got) == 8
    session = lambda master, **said: SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId=f"{master} {said}", getConf=lambda: {k.replace("_", "."): v for k, v in said.items()}))
    assert profiles.one_task_an_executor(spark) is None
    assert profiles.one_task_an_executor(session("yarn")) is None
    assert profiles.one_task_an_executor(session("yarn", spark_executor_cores="4", spark_task_cpus="4")) is None
    for cluster, cores in ((session("local-cluster[3,2,3000]"), 2), (session("yarn", spark_executor_cores="4"), 4)):
        made = profiles.one_task_an_executor(cluster)
        assert made.taskResources["cpus"].amount == cores and not made.executorResources
        assert profiles.one_task_an_executor(cluster) is made


def tag(text, *boxes):
    return f"<|ref|>text<|/ref|><|det|>[{','.join('[%d,%d,%d,%d]' % b for b in boxes)}]<|/det|>\n{text}"


def test_documents_split_over_batches_and_batches_that_run_again(spark, tmp_path):
    into, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    page = lambda d, n: (d, n, "<|ref|>title<|/ref|><|det|>[[10,10,900,60]]<|/det|>\nT\n" + tag(f"body {n}", (10, 200, 900, 400)), 1000, 1000)
    spark.createDataFrame([page("d", 1), page("e", 1)], streaming.PAGES).coalesce(1).write.parquet(into)
    arriving = lambda: streaming.arriving_pages(spark, into, files_at_a_time=1)
    streaming.index_documents(arriving(), out, checkpoint).awaitTermination(120)
    spark.createDataFrame([page("d", 2)], streaming.PAGES).coalesce(1).write.mode("append").parquet(into)
    streaming.index_documents(arriving(), out, checkpoint).awaitTermination(120)
    first = sorted((r["document_id"], r["idx"], r["page_number"], r["text_content"]) for r in streaming.indexed(spark, out).collect())
    assert [(d, p) for d, _, p, _ in first] == [("d", 1), ("d", 1), ("d", 2), ("d", 2), ("e", 1), ("e", 1)]
    # The last batch runs again, as after a failure between its write and its commit.
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "ckpt" / name).unlink(missing_ok=True)
    streaming.index_documents(arriving(), out, checkpoint).awaitTermination(120)
    again = sorted((r["document_id"], r["idx"], r["page_number"], r["text_content"]) for r in streaming.indexed(spark, out).collect())
    assert again == first and spark.read.parquet(out).count() == 4 + 4


def test_tags_of_more_than_a_thousand_boxes(spark, tmp_path):
    boxes = [(10, 2 + i // 2, 30 + i % 7, 12 + i // 2) for i in range(1200)]
    tagged = tag("many", *boxes) + "\n" + tag("more", (600, 900, 900, 990))
    spark.createDataFrame([("d", 1, tagged, 1000, 1000)], streaming.PAGES).write.parquet(str(tmp_path / "in"))
    from quire.sources import grounding

    found = grounding.parse(spark.read.parquet(str(tmp_path / "in")), "tagged", "width", "height")
    assert found.count() == 1201 and found.select((F.col("tag") * 1000 + F.col("box"))).distinct().count() <= 1201
    seqs = found.withColumn("seq", F.row_number().over(streaming.W.partitionBy("document_id", "page_number").orderBy("tag", "box")))
    assert seqs.select("seq").distinct().count() == 1201


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", setCheckpointDir=lambda x: None)
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)))
    with pytest.raises(RuntimeError):
        checkpoints.cut(frame)


@pytest.mark.parametrize("hidden", ["ahocorasick", "xxhash", "quire.llm", "corpus_pipeline"])
def test_other_queries_stay_without_the_subpackage_or_what_it_needs(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'c1_spatial_tree' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parent.parent), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_cyclic_pages_drop_the_edge_that_goes_most_upwards(spark):
    """Three boxes of which each is read before the next: of the cycle the edge whose end lies highest above its start goes."""
    import pandas as pd

    from quire.operators import order

    rows = pd.DataFrame({"idx": [0, 1, 2], "x1": [0, 0, 0], "y1": [0, 100, 300], "x2": [10, 10, 10], "y2": [10, 110, 310], "below": [[1], [2], [0]]})
    got = order._untangled(rows)
    assert got.sort_values("idx")["read_idx"].tolist() == [0, 1, 2]
    back = pd.DataFrame({"idx": [0, 1, 2], "x1": [0] * 3, "y1": [300, 0, 100], "x2": [10] * 3, "y2": [310, 10, 110], "below": [[1], [2], [0]]})
    assert order._untangled(back).sort_values("idx")["read_idx"].tolist() == [2, 0, 1]
