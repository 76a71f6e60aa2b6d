"""Edge cases of the operators and of the pipeline: shared and missing ids, repeated rows, odd columns, methods that must not be bypassed."""

import hashlib
import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quire.llm import ann, common, piece_sampling, pii, quality_model, quality_rules, simhash, substring, token_files
from quire.llm import queries as llm
from quire.llm.vocab import Encoder, Pieces, public_path

from . import helpers as H

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=90):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(['house', 'river', 'stone', 'cloud', 'garden', 'winter'])}{rng.randint(0, 10**6)}" for _ in range(n))


# Shared folder


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077", setCheckpointDir=lambda x: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError):
        common.shared_dir(session)
    session.conf = SimpleNamespace(get=lambda key, default: "/shared")
    assert common.shared_dir(session) == "/shared"


# SimHash


def test_op5_links_come_from_the_index(spark, monkeypatch):
    """Three fingerprints, of which two are near: without the walk over the tree there is no link, however few they are."""
    rows = spark.createDataFrame([(1,), (3,), (15 << 40,)], "fp long")
    assert [(r["u"], r["v"]) for r in simhash.link_prints(rows).collect()] == [(1, 3)]
    index = simhash.GrayIndex(np.array([1, 3, 15 << 40], dtype=np.uint64))
    monkeypatch.setattr(simhash, "meetings", lambda x, y, limit: iter(()))
    assert not list(simhash.near_pairs(index, index, 2))


@pytest.mark.parametrize("limit", [0, 2, 5])
def test_op5_index_finds_all_pairs_and_prunes(limit):
    rng = np.random.default_rng(limit)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    x = np.unique(np.concatenate([x, x[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)), np.arange(300, dtype=np.uint64)]))
    index = simhash.GrayIndex(x)
    got = {(int(min(a, b)), int(max(a, b))) for u, v in simhash.near_pairs(index, index, limit) for a, b in zip(index.prints[u], index.prints[v])}
    u, v = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= limit, 1))
    assert got == {(int(min(a, b)), int(max(a, b))) for a, b in zip(x[u], x[v])}
    pairs = sum(len(a) for a, _ in simhash.meetings(index, index, limit))
    assert limit == 5 or pairs < len(index.leaves) ** 2 / 2 * 0.35  # too few fingerprints here to tell five bits apart
    other = simhash.GrayIndex(x[::7])
    across = sum(len(u) for u, _ in simhash.near_pairs(other, index, limit))
    assert across == int((np.bitwise_count(x[::7][:, None] ^ x[None]) <= limit).sum())


def test_op5_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = llm.op5_simhash(spark, "/root/testdata/sf0.01").collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert all(simhash.fingerprint(t) & (1 << 64) - 1 == prints[i] for i, t in docs)
    x = np.array([prints[i] for i, _ in docs], dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    label = np.array([i for i, _ in docs])
    while True:
        least = np.where(near, label[None], label.max() + 1).min(axis=1)
        if (least == label).all():
            break
        label = least
    named = {r["doc_id"]: r["component_id"] for r in rows}
    assert all(named[i] == c for (i, _), c in zip(docs, label.tolist()))


def test_op5_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 4)
    docs = [(i, "") for i in range(40)] + [(i, prose(i)) for i in range(40, 60)] + [(None, ""), (70, prose(41))]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(40)} | {(i, i) for i in range(40, 60)} | {(None, 0), (70, 41)}


# Substrings


def test_op2_words_that_collide_in_the_first_hash(spark):
    """The Thue-Morse word and its complement agree in any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rest = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join([*rest[:20], w, *rest[20:30]])) for i, w in ((1, one), (2, two))]
    docs = [(i, t + " " + " ".join(f"{i}x{k}" for k in range(20))) for i, t in docs]
    words = substring.Words([t.encode() for _, t in docs])
    assert words.hashes[20] == words.hashes[20 + int(words.counts[0])]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.substring_digest(spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS)).collect())
    assert got == H.substring(docs) and all(r[2] == 0 for r in got)


def test_op2_any_columns(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, {"a": [1]}, (1, {"k": "v"}), f"x {passage}  y"), (2, None, None, f"{passage}\tz"), (None, {}, (2, None), None), (None, {}, (2, None), "as  it is")]
    df = spark.createDataFrame(rows, "doc_id long, carry map<string,array<int>>, pack struct<out:int,m:map<string,string>>, text string")
    kept = substring.remove_repeats(df)
    assert kept.schema == df.schema or kept.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "x y"), ("2", "z"), ("None", "None"), ("None", "as  it is")]
    assert {str(r["carry"]) for r in kept.collect()} == {"{'a': [1]}", "None", "{}"}


def test_op2_the_same_row_twice(spark):
    docs = [(1, prose(1)), (1, prose(1)), (2, prose(2, 34)), (2, prose(2, 34)), (None, prose(3)), (None, prose(3))]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring.substring_digest(spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS)).collect())
    assert got == [("1", 90), ("1", 90), ("2", 0), ("2", 0), ("None", 90), ("None", 90)]


# Personal data


@pytest.mark.parametrize("text,want", [
    ("account no: 12345678 was closed by the bank", [("account", "12345678")]),
    ("IBAN: DE89 3704 0044 0532 0130 00 BIC COBADEFF", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("iban DE89370400440532013000", [("iban", "DE89370400440532013000")]),
    ("IBAN NO9386011117947 and more", [("iban", "NO9386011117947")]),
    ("IBAN: DE89 3704 0044 0532 0130 01", [("account", "DE89 3704 0044 0532 0130 01")]),
    ("passport: C01X00T478 issued", [("account", "C01X00T478")]),
    ("ssn: 123-45-6789.", [("account", "123-45-6789")]),
    ("account: ABC", []),
    ("account of 12345678", []),
    ("konto=12 34 56 78 EUR 5", [("account", "12 34 56 78")]),
])
def test_op6_where_numbers_end(text, want):
    assert [(k, text[s:e]) for k, s, e in pii.Finder().spans(text) if k in pii.ADDED] == want


# Classifier


def test_op3_scores_are_the_sum_over_pairs(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    machine = quality_model.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_model.score(docs, machine).collect()}
    weights, factors = machine.weights.astype(np.float32), machine.factors.astype(np.float32).astype(float)
    for r in docs.orderBy("doc_id").limit(12).collect():
        at, x = quality_model.features(r["text"] or "", r["n_chars"])
        v = factors[at] * x[:, None]
        pairs = sum(float(v[i] @ v[i + 1 :].sum(axis=0)) for i in range(len(at) - 1))
        raw = machine.bias + float(weights[at].astype(float) @ x) + pairs
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-4
    assert quality_model.quality_scores(docs.where("false"), labels.where("false")).count() == 0
    # Of rows that share an id the same one is learnt from, in whatever order they come.
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    one, two = quality_model.train(twice.repartition(2, "text"), labels), quality_model.train(twice.repartition(3, "n_chars"), labels)
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.factors == two.factors).all()


# Token files


def test_op4_documents_longer_than_a_frame(spark):
    docs = [(i, prose(i, n)) for i, n in ((1, 5), (2, 400), (3, 3), (4, 4), (5, 300))] + [(5, "b"), (5, "a"), (5, "a"), (None, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    files = token_files.write_token_files(frame, most=300)
    assert files.where("of > 0").count() > 3 and files.agg(F.max("n_tokens")).first()[0] <= 300
    whole = token_files.write_token_files(frame)
    rows = lambda f, ids: sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], *([r["ids"]] if ids else [])) for r in token_files.read_token_files(f, with_ids=ids).collect())
    assert rows(files, True) == rows(whole, True) and rows(files, False) == rows(whole, False)
    for _, _, n, crc, ids in rows(files, True):
        assert len(ids) == n and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == crc


def test_op4_shared_ids_are_in_order_across_parts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 200)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    docs = [(7, f"{i:03d} {prose(i, 4)}") for i in range(60)] + [(8, "x"), (6, "y")]
    random.Random(1).shuffle(docs)
    got = [(r["doc_id"], r["ids_crc32"]) for r in token_files.token_digest(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("start").collect()]
    assert got == [(i, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4").tobytes())) for i, x in sorted(docs)]


# Pieces


def test_op7_digest(spark):
    docs = [(i, prose(i, 20) + " é中👍") for i in range(30)] + [(3, "the same id"), (None, "none"), (31, None), (32, "")]
    lattices = piece_sampling.Lattices(public_path("piece_bpe_32k.model"), piece_sampling.ALPHA)
    want = []
    for i, t in docs:
        (ids,) = lattices.sample([t or ""], [i or 0])
        assert lattices.decode(ids) == (t or "")
        want.append((str(i), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    got = piece_sampling.piece_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_pieces"], r["ids_crc32"]) for r in got) == sorted(want)


# Quality rules


BASE_SQL = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from docs),
x as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
t as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from x),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from t where n > 1) group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
select doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(w) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed
from w left join r using (doc_id) left join l using (doc_id)
"""


def test_op9_base_in_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view docs as select * from '{data}/documents.parquet'")
    want = sorted(con.sql(BASE_SQL).fetchall())
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[c] for c in columns) for r in llm.op9_rules(spark, data).collect()) == want


def test_op9_measures_and_verdict(spark):
    """The three measures by the plainest way, and the verdict that follows."""
    docs = [(i, prose(i) + x, lang) for i, (x, lang) in enumerate([("", "en"), (" ß" * 30, "de"), (" слово" * 3, None), (" 漢字" * 9, "zh"), ("", "xx")])]
    docs += [(9, " ".join(["漢字語文"] * 3 + [chr(0x4E00 + 7 * i) for i in range(200)]), None), (10, "short", "en"), (11, None, None), (12, " ".join(str(i) for i in range(300)), "en")]
    pieces = Pieces(public_path("piece_bpe_32k.model"))
    model = pieces.model
    for r in quality_rules.quality_digest(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect():
        _, text, lang = next(d for d in docs if d[0] == r["doc_id"])
        ids = [i for w in (text or "").split() for i in model.encode(w)]
        letters = sum(c.isalpha() if c.isascii() else True for c in text or "")
        if not ids:
            assert not r["kept"] and r["base_failed"]
            continue
        p = np.array([ids.count(i) for i in set(ids)]) / len(ids)
        per, share, entropy = letters / len(ids), sum(model.is_byte(i) for i in ids) / len(ids), float(-(p * np.log2(p)).sum())
        assert np.allclose([r["letters_per_token"], r["byte_share"], r["token_entropy"]], [per, share, entropy])
        band = quality_rules.BANDS.get(lang) or quality_rules.BANDS[quality_rules.script_of(text)]
        assert r["kept"] == (not r["base_failed"] and band.holds(per, share, entropy, len(ids)))
    assert quality_rules.script_of("Das ist schön") == "latin" and quality_rules.script_of("Это не latin, а кириллица") == "cyrillic"
    assert quality_rules.script_of("漢字かな混じり文漢字漢字漢字") == "han" and quality_rules.script_of("ไทย ไทย") == "other" and quality_rules.script_of("") == "latin"


def test_op9_bands_on_documents_they_were_not_fitted_on(spark):
    data = "/root/testdata/sf0.1"
    held = quality_model.held_out("doc_id")
    judged = llm.op9_rules(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where(held).where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99 and n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.6


# Neighbours


def exact(rows, is_query, k=5):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for q in {i for i, _ in ok if is_query(i)}:
        best = {}
        for i, v in ok:
            if i != q:
                for j, u in ok:
                    if j == q:
                        s = float(ann.cosines(v[None], u)[0])
                        best[i] = max(best.get(i, -2), s)
        out[q] = [i for _, i in sorted((-s, i) for i, s in best.items())[:k]]
    return out


def found(df, is_query):
    out = defaultdict(list)
    for r in ann.nearest(df, is_query).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["vec_id"])
    return dict(out)


def test_op10_shared_ids_copies_and_odd_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(50, rows[3][1]), (7, rows[8][1]), (9, rows[9][1])] + [(100 + i, [1.0, 0.0, -0.0, 0.0, 0.0, 2.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, {"a": 1}, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, ids map<string,int>, block int, v string")
    assert found(df, lambda i: i % 50 == 0) == exact(rows, lambda i: i % 50 == 0)


def test_op10_empty_parquet_and_types(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = llm.op10_neighbours(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]
    for kind in ("float", "double", "decimal(9,3)", "int"):
        df = spark.createDataFrame([(i, [1.0 + i, 2.0, 0.5 * i]) for i in range(8)], "vec_id int, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        got = ann.nearest(df, lambda i: i == 0)
        assert got.count() == 5 and got.schema["vec_id"].dataType == T.IntegerType()


@pytest.mark.parametrize("n", [3000, 20000])
def test_op10_recall_with_few_comparisons(spark, n):
    """Vectors in loose clusters, which hashing can tell apart; a query in the order of a fiftieth of them."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n // 20, 48))[rng.integers(0, n // 20, n)] + 0.35 * rng.normal(size=(n, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    seen = {}
    real = ann.tuned

    def tuned(*args):
        seen["m"], seen["asked"], seen["share"] = real(*args)
        return seen["m"], seen["asked"], seen["share"]

    ann.tuned = tuned
    try:
        got = found(df, lambda i: i % 50 == 0)
    finally:
        ann.tuned = real
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = sum(len(set(got[q]) & set(np.argsort(-np.where(np.arange(n) == q, -2, unit @ unit[q]))[:5].tolist())) for q in got)
    assert len(got) == len(range(0, n, 50)) and hit / (5 * len(got)) >= 0.9
    assert seen["share"] < 0.25


def test_op10_probes_reach_their_buckets_only():
    """A block's candidates are just the vectors that share a probed bucket with the query in some table."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x, h = rng.normal(size=(500, 8)), ann.Hashes(8, 5, 3, 20, 2.0, 1)
    block = ann.Block(x, pa.array([[i] for i in range(500)]), 5, h)
    unit = ann._unit(block.x)
    for q, at in zip(unit[:20], block.probed(unit[:20])):
        want = set()
        for t in range(3):
            want |= set(np.flatnonzero(np.isin(h.keys(np.floor(h.places(unit, t)), t), h.probes(q[None], t)[0])).tolist())
        assert set(at.tolist()) == want and 0 < len(want) < 500


# Pipeline


def test_pipeline_rows_that_share_ids_or_have_none(spark, tmp_path):
    """Every stage's input has shared, missing and repeated ids, null and empty texts, a very long text, and columns whose names the operators use."""
    good = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars between 1500 and 3000").orderBy("doc_id").collect()]
    good = [t for t in good if quality_rules.Rules(public_path("piece_bpe_32k.model"), quality_rules.BANDS)(t, "en")[6] and not pii.Finder().spans(t)]
    repeats = {i for i, _, gone, _ in H.substring(list(enumerate(good))) if gone}
    good = [t for i, t in enumerate(good) if i not in repeats][:45]
    long_text = "\n".join(good[5:])
    rows = [(1, good[1]), (1, good[2]), (1, good[2]), (2, good[1]), (None, good[3]), (None, good[3]), (None, good[1]), (4, None), (5, ""), (6, long_text), (7, good[4] + " a@b.co"), (None, None)]
    extra = [(i, t, "en", "s", 0, {"k": str(i)}, n, "carry") for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(extra, DOCS + ", text_hash map<string,string>, row int, fp string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "packing" or out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after[name] = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str) if name != "packing" else now.collect()
    assert after["quality_rules"] == sorted([(i, t) for i, t in rows if t], key=str)
    assert after["simhash_near_dedup"] == sorted([(1, good[1]), (1, good[2]), (None, good[3]), (6, long_text), (7, good[4] + " a@b.co")], key=str)
    assert after["substring_dedup"] == after["simhash_near_dedup"]
    assert after["pii"] == sorted([(i, t.replace("a@b.co", "<email>")) for i, t in after["substring_dedup"]], key=str)
    assert sum(r["length"] for r in after["packing"]) == sum(n for n in {(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in after["packing"]}.values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(1, None, "en", "s", None)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).count() == (0 if name == "quality_rules" else 1)


def test_digests_ignore_other_columns(spark):
    """Names that the operators use inside, of types that can't be hashed or compared."""
    plain = [(i, prose(i)) for i in range(4)] + [(9, prose(1)), (None, None)]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    more = df.select("*", *[F.create_map(F.lit("a"), F.lit(1)).alias(c) for c in ("id", "out", "carry", "pack", "fp", "key", "row", "none", "kept")])
    for digest in (substring.substring_digest, simhash.near_duplicates, pii.pii_digest, piece_sampling.piece_digest, token_files.token_digest, quality_rules.quality_digest):
        assert sorted(map(str, digest(df).collect())) == sorted(map(str, digest(more).collect()))


def test_hashes_are_what_they_say():
    assert simhash.fingerprint("a b c") == simhash.fingerprint("A  B\nC") and simhash.fingerprint("") == 0
    words = substring.Words([b"a b  c d", b"b c d e"])
    d = words.digests(np.array([1, 4]), 3)
    assert (d[0] == d[1]).all() and d[0].tobytes() == hashlib.blake2b(b"b c d", digest_size=16).digest()


def test_words_go_straight_to_the_merges(monkeypatch):
    rng = random.Random(5)
    parts = ["onion", "Étage", "ß", "ŒUVRE", "naïve", "ÿ", "Ÿ", "µ", "ªb", "a­b", "x.", "y,", "Да", "İz", "ŉ", "ſ", "中", "don't", "Ź", "\x00", "1a", "é́"]
    texts = ["".join(rng.choice(["", " ", " ", "\n", "  ", "\t"]) + rng.choice(parts) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", "\n"]) for _ in range(3000)]
    prose = "Onion étage naïve\nor words, and more."
    for name, folds in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        encoder = Encoder(public_path(name), folds)
        assert encoder(texts) == [encoder._whole(t) for t in texts]
        # Of prose only marks and line ends take the way through the patterns.
        encoder, slow = Encoder(public_path(name), folds), []
        every = encoder.memo.encode_all
        monkeypatch.setattr(encoder.memo, "encode_all", lambda chunks: slow.extend(chunks) or every(chunks))
        assert encoder([prose]) == [encoder._whole(prose)] and set(slow) <= {"\n", ",", "."}


def test_op7_spells_all_texts_at_once():
    lattices = piece_sampling.Lattices(public_path("piece_bpe_32k.model"), piece_sampling.ALPHA)
    held = [[5, -1 - ord("é"), -1 - 0x10FFFF, 7], [], [-1 - ord("a")], [9], [-1, -1 - ord("中")]]
    want = [[i for x in ids for i in ([x] if x >= 0 else [lattices.byte_id[b] for b in chr(-1 - x).encode()])] for ids in held]
    ids, upto = lattices._spelled(np.array(sum(held, []), dtype=np.int32), np.cumsum([0, *map(len, held)]))
    assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:])] == want
    texts = ["\U000e0001x", "", "\x00 \x00", "plain", "▁ é\U0010fffd"]
    assert [lattices.decode(i) for i in lattices.sample(texts, list(range(len(texts))))] == texts
    assert [i.tolist() for i in lattices.sample(texts, [4] * 5)] == [lattices.sample([t], [4])[0].tolist() for t in texts]
