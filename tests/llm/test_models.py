"""Language model, language identification, licenses, neighbours, mixing, chats, URLs and the pipeline."""

import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from brute import katz, plain, spaced
from pyspark.sql import functions as F

from runloom.llm import chat_format, katz as katz_module, language_id, license_scan, mixing, neighbours, url_filter
from runloom.llm.query_model import op9_language_id


def test_katz_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(katz_module, "DENSE", 4)
    monkeypatch.setattr(katz_module, "LISTED", 12)
    rng = np.random.default_rng(1)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(59, int(x))] for x in rng.exponential(12, rng.integers(0, 60))), i % 7 == 2) for i in range(120)] + [(900, None, False), (901, "", True), (902, "never seen", True)]
    got = {r.doc_id: tuple(r)[2:] for r in katz_module.katz_scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    want, p, uni = katz(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8)
    for v in ["<s>", "w1", "w30", "nowhere"]:
        assert sum(p(w, v) for w in [*uni, "unknown"]) == pytest.approx(1)


def test_katz_in_small_pieces(spark, monkeypatch):
    """Buckets by bytes, parts, pieces and batches of a few rows each give the scores of a plain version."""
    for name, x in {"DENSE": 4, "LISTED": 12, "FLUSH": 100, "BUCKET_BYTES": 400, "PIECE": 9, "BATCH": 5, "COUNTS": 3, "PART_ROWS": 7}.items():
        monkeypatch.setattr(katz_module, name, x)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.exponential(15, rng.integers(0, 80))), i % 7 == 2) for i in range(90)] + [(901, "", True), (902, "never seen seen seen", True), (903, "w1 w90 " * 20000, False)]
    got = {r.doc_id: tuple(r)[2:] for r in katz_module.katz_scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(2)).collect()}
    want, _, _ = katz(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-8, abs=1e-8)


def test_katz_memory_of_a_large_bucket(monkeypatch):
    """What a task holds of a bucket of 3 million entries is little more than the entries as they were dealt."""
    monkeypatch.setattr(katz_module, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(map(str, rng.integers(0, 100_000, 10_000))) for _ in range(300)])
    words, counts = np.unique(katz_module.sequences(texts)[1], return_counts=True)
    shared = SimpleNamespace(value=katz_module.Vocabulary(words[:100], counts[:100], {}, int(counts.sum()), len(words)))
    batch = pa.record_batch([pa.array(range(300)), texts, pa.array([i % 7 == 2 for i in range(300)])], names=["doc_id", "text", "held"])
    dealt = [x.slice(i, 1) for x in katz_module._deal(shared, 1)(iter([batch])) for i in range(x.num_rows) if x.column("bucket")[i].as_py() == 0]
    size = sum(len(x.column("v")[0]) for x in dealt)
    assert size > 2_900_000
    tracemalloc.start()
    try:
        most = max(x.nbytes for x in katz_module._score(shared)(iter(dealt)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * size and most < 16e6


def test_katz_of_empty_tables(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert katz_module.katz_scores(spark.createDataFrame([], schema)).count() == 0
    only = katz_module.katz_scores(spark.createDataFrame([(1, "a b", True), (None, "a", True)], schema)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in only) == [(2, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_language_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    held = op9_language_id(spark, data).where("held_out").join(docs, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_document_frequencies_of_all_texts(spark):
    """The weights count every text that teaches, not the sample."""
    rows = [(i, "the same words" if i % 10 else f"rare w{'abcdefghij'[i // 10 % 10]}", "en" if i < 390 else "de") for i in range(400)] + [(900, None, "en"), (901, "12 34", "en"), (902, "not labelled", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, sample=20)
    present = np.zeros(4096, int)
    for _, text, _ in rows[:400]:
        present += language_id.gram_counts(pa.array([text]), 4096)[0] > 0
    want = np.where(present > 0, np.log(401 / (1 + present)) + 1e-3, np.log1p(400))
    assert np.allclose(model.idf, want, atol=1e-5)


def test_language_of_odd_texts(spark, data):
    model = language_id.fit(spark.read.parquet(f"{data}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "a"), (5, "漢字漢字漢字" * 50), (None, "the and of that " * 20)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang_pred string")
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(out[i].lang_rejected for i in (1, 2, 3, 5))
    assert out[None].lang_pred == "en" and not out[None].lang_rejected
    nothing = language_id.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_license_scan(spark):
    apache = license_scan.TEMPLATES[2].text
    rows = [(1, "x. Released under the MIT License."), (2, None), (3, "gnu general public license " * 3), (4, "pre " * 30 + apache.replace("compliance", "COMPLIANCE") + " post"), (5, "you may use this file"), (6, "GNU General Public\nLicense, CC-BY")]
    out = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = plain(text)
        at = sorted(x for _, p in license_scan.PHRASES for x in range(len(w)) if w[x : x + len(p.split())] == p.split())
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].last_word) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
    assert out[1].labels == ["mit"] and out[4].labels == ["apache", "apache-2.0"] and out[5].labels == [] and out[6].labels == ["cc-by", "gpl"]
    assert any(m.share == 1 and m.word == 30 for m in out[4].matches)


def test_neighbours_recall(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    hit = total = 0
    for r in neighbours.nearest(table).groupBy("query_id").agg(F.collect_list(F.struct("rank", "vec_id", "score")).alias("x")).collect():
        q = vectors[r.query_id]
        best = sorted((-float(v @ q), i) for i, v in vectors.items() if i != r.query_id)[:20]
        found = {x.vec_id for x in r.x}
        hit, total = hit + len(found & {i for _, i in best}), total + 20
        assert len(found) == 20 and all(math.isclose(x.score, float(vectors[x.vec_id] @ q), abs_tol=1e-12) for x in r.x)
    assert hit / total >= 0.9


@pytest.mark.parametrize("kind", ["few long", "mixed"])
def test_neighbours_of_mixed_lengths(spark, data, monkeypatch, kind):
    """Long vectors of middling directions are found; queries in several blocks."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(4)
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    lengths = np.where(rng.random(len(rows)) < 0.05, 5.0, 1.0) if kind == "few long" else rng.lognormal(0, 0.8, len(rows))
    vectors = {r.vec_id: np.array(r.embedding, float) * x for r, x in zip(rows, lengths, strict=True)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").coalesce(1)
    hit = total = 0
    for r in neighbours.nearest(table).groupBy("query_id").agg(F.collect_set("vec_id").alias("x")).collect():
        best = sorted((-float(v @ vectors[r.query_id]), i) for i, v in vectors.items() if i != r.query_id)[:20]
        hit, total = hit + len(set(r.x) & {i for _, i in best}), total + 20
    assert total == 20 * sum(i % 20 == 0 for i in vectors)
    assert hit / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [2.0, None]), (5, [0.5, 0.5]), (6, [3.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [1.0, 0.0])]
    out = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(out) == [(0, 1, 20, 1.0), (0, 2, 5, 0.5), (0, 3, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 5, 0.5), (20, 3, 7, 0.5)]


def test_mixing(spark):
    rows = [(i, ["b", "a", None, "c"][i % 4], 1 + i % 50, 1.0 + i % 3) for i in range(4000)] + [(1, "a", 5, None), (1, "a", 5, None), (None, "z", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    sums, targets = {}, {}
    for r in out:
        sums[r.source] = sums.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert all(abs(sums[s] - targets[s]) <= 25 for s in sums)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r[2] for r in rows))
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "if(id < 2000, 'a', 'b') source", "10L size", "if(id % 2 = 0, 4.0, 1.0) weight")
    share = mixing.mix_sources(docs, cycle=(1.0,), share=0.5).groupBy((F.col("doc_id") % 2).alias("k")).agg(F.avg(F.col("epochs").cast("double")).alias("a"))
    share = {r.k: r.a for r in share.collect()}
    assert share[0] > 0.65 > 0.35 > share[1]


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, None), (None, 0, "user", "hi"), (5, 1, "User ", "b"), (5, None, "system", "a"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]
    out = {r.conv_id: r for r in chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2, 4, 5, 6}
    assert out[2].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n" and out[4].rendered == "<|unknown|>\n\n<|end|>\n"
    assert out[5].rendered.startswith("<|system|>\na") and out[6].n_turns == 2


def test_url_rules(spark):
    rules = [url_filter.Rule("block", "com/en/"), url_filter.Rule("allow", "example.com/en/7")]
    urls = ["http://a.example.com/en/71?x", "https://EXAMPLE.com/en/7", "http://notexample.com/en/7", "http://com/en/", "http://a.org/en/7", None, "example.com/en/7", "http://x.com/fr", "://a.com/en/q#f", "http://x.com?y=/en/"]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules).collect()}
    assert [out[i].rule for i in range(10)] == ["example.com/en/7", "example.com/en/7", "com/en/", "com/en/", None, None, None, None, "com/en/", None]
    assert [out[i].verdict for i in (0, 1, 2, 3, 8)] == ["allow", "allow", "block", "block", "block"]
    assert (out[0].host, out[0].path) == ("a.example.com", "/en/71") and (out[5].host, out[6].path) == ("", "") and out[9].path == ""
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string"), rules).count() == 0


def test_trees_learn(spark):
    rows = [(f"http://{'cheap-pills' if i % 2 else 'news'}{i}.example.org/{'9' * (i % 5)}x/{i}", i % 2 == 1) for i in range(400)]
    df = spark.createDataFrame(rows, "url string, blocked boolean").withColumn("host", url_filter.host_of()).withColumn("path", url_filter.path_of())
    scored = url_filter.fit(df.where("hash(url) % 4 != 0")).blocked(df.where("hash(url) % 4 = 0"))
    assert scored.where("(block_score > 0.5) = blocked").count() / scored.count() > 0.95


def test_all_suffixes_count(spark):
    """Suffixes beyond the 64 most frequent, and rows outside the sample, count towards the share of blocked URLs."""
    rows = [(f"http://h{j}.s{i:03d}.net/{j}/x", i % 2 == 1) for i in range(120) for j in range(6 if i < 80 else 3)]
    rows += [("http://host/x", True)]
    df = spark.createDataFrame(rows, "url string, blocked boolean").withColumn("host", url_filter.host_of()).withColumn("path", url_filter.path_of())
    model = url_filter.fit(df, sample=200)
    counts = {r.suffix: r for r in model.suffixes.collect()}
    assert {s: (r.n, r.b) for s, r in counts.items()} == {f"s{i:03d}.net": (n, n * (i % 2)) for i in range(120) for n in [6 if i < 80 else 3]}
    assert all(sum(r.ns) == r.n and sum(r.bs) == r.b for r in counts.values())
    asked = spark.createDataFrame([(f"http://new.s{i:03d}.net/0/x",) for i in range(120)], "url string").withColumn("host", url_filter.host_of()).withColumn("path", url_filter.path_of())
    scores = {int(r.host[5:8]): r.block_score for r in model.blocked(asked).collect()}
    assert sum((scores[i] > 0.5) == (i % 2 == 1) for i in range(80, 120)) >= 36


def test_pipeline(spark, data):
    """Each stage against a plain version on its own input."""
    import corpus_pipeline as cp
    from test_repeats import brute_hits, components

    docs = cp.stored(cp.identified(spark, spark.read.parquet(f"{data}/documents.parquet"), data))
    told = op9_language_id(spark, data).where("not rejected")
    assert docs.columns == cp.COLUMNS and sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(r.doc_id for r in told.select("doc_id").collect())
    rows = sorted(docs.collect())
    seen, texts = set(), {}
    for r in rows:  # ids are in order, so what was seen is earlier
        lines = r.text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            gone |= {i, i + 1, i + 2} if key in seen else set()
            seen.add(key)
        if len(gone) < len(lines):
            texts[r.doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    docs = cp.stored(cp.without_repeated_lines(spark, docs, data))
    assert {r.doc_id: r.text for r in docs.collect()} == texts
    docs = cp.stored(cp.one_of_each_group(spark, docs, data))
    kept = {i for i, (n, c) in components(sorted(texts.items())).items() if c == i}
    assert {r.doc_id for r in docs.collect()} == kept
    docs = cp.stored(cp.without_benchmark(spark, docs, data))
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i in kept if not brute_hits(texts[i], items, 10)[1]}
    assert {r.doc_id for r in docs.collect()} == clean
    mixed = {r.doc_id: r for r in cp.mixed(spark, docs, data).collect()}
    assert set(mixed) == clean and all(mixed[i].size == len(spaced(texts[i])) for i in clean)


