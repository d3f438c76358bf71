"""Similarity join, line deduplication and decontamination."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from brute import plain, spaced

from runloom.llm import decontamination, ngram_jaccard
from runloom.llm.line_dedup import line_dedup


def sets_of(text, k=5):
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows):
    sets = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, count, words, share):
    """A text, its copies with a share of the words changed, unrelated texts with one passage in common, and short ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    text = [word() for _ in range(words)]
    passage = [word() for _ in range(60)]
    rows = [" ".join(text)]
    for _ in range(count):
        changed = list(text)
        for at in rng.sample(range(words), max(1, int(words * share * rng.random()))):
            changed[at] = word()
        rows.append(" ".join(changed))
    rows += [" ".join([*passage, *(word() for _ in range(rng.randrange(10, 120)))]) for _ in range(count)]
    rows += ["", None, "one two", "one two", "ONE two", "a b c d e", "a b c d e f", "x " * 50, "x " * 60]
    return list(enumerate(rows))


@pytest.mark.parametrize(("small", "share"), [(12, 0.03), (2, 0.05), (1, 0.08)])
def test_components_are_exact(spark, monkeypatch, small, share):
    """Large groups have a path of their own; it is taken by lowering the size at which it begins."""
    monkeypatch.setattr(ngram_jaccard, "SMALL_GROUP", small)
    rows = near_copies(small, 40, 150, share)
    _, members = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == components(rows)


@pytest.mark.parametrize(("small", "share"), [(12, 0.03), (2, 0.05), (1, 0.08)])
def test_links_are_whole(spark, monkeypatch, small, share):
    """All linked pairs, also within large groups; components are the same without them."""
    monkeypatch.setattr(ngram_jaccard, "SMALL_GROUP", small)
    rows = near_copies(small, 40, 150, share)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links, members = ngram_jaccard.ngram_jaccard_join(docs)
    members = members.cache()
    sets = {i: sets_of(t) for i, t in rows}
    want = {i: sum(1 for j in sets if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    assert {r.doc_id: r.n_links for r in ngram_jaccard.link_counts(links, members).collect()} == want
    prints = {r.doc_id: r.print for r in members.collect()}
    pairs = {tuple(sorted((prints[i], prints[j]))) for i in sets for j in sets if prints[i] != prints[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    _, quick = ngram_jaccard.ngram_jaccard_join(docs, every_link=False)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in quick.collect()} == components(rows)


def test_copies_are_dealt_once(monkeypatch):
    """Copies of a text hand on their keys once in a flush, and no bucket holds all of them."""
    text = " ".join(f"w{i}" for i in range(60))
    monkeypatch.setattr(ngram_jaccard.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))

    def dealt(texts):
        batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        return [r for b in ngram_jaccard._deal(8, 5, 80)(iter([batch])) for r in b.to_pylist()]

    keys = lambda rows: sorted(k for r in rows for k in r["keys"])
    many = dealt([text] * 1000 + [""] * 1000)
    assert keys(many) == keys(dealt([text]))
    held = [len(r["docs"]) for r in many if r["bucket"] < 0]
    assert sum(held) == 2000 and len(held) == 8 and max(held) < 400


def test_large_groups_of_a_flush_go_by_row(monkeypatch):
    """A fragment that many sets of a flush have is told to its bucket once; its members are spread over the buckets."""
    monkeypatch.setattr(ngram_jaccard.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    common = " ".join(f"w{i}" for i in range(400))
    texts = [f"{common} x{i} y{i}" for i in range(500)]
    batch = pa.record_batch([pa.array(range(500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in ngram_jaccard._deal(8, 5, 80)(iter([batch])) for r in b.to_pylist()]
    hot = [len(r["hot"]) for r in rows if r["hot"]]
    assert sum(hot) > 50 * 500 and len(hot) == 8 and max(hot) < 2 * min(hot)
    assert max(len(r["keys"]) for r in rows) < 5000


@pytest.mark.parametrize("flush", [200, 1 << 20])
def test_copies_in_many_flushes(spark, monkeypatch, flush):
    """Exact copies, near copies and empty texts in large numbers, with many flushes and with one."""
    monkeypatch.setattr(ngram_jaccard, "FLUSH", flush)
    rng = random.Random(8)
    text = [f"w{rng.randrange(900)}" for _ in range(90)]
    texts = [" ".join(text)] * 300 + [""] * 300 + [" ".join([*text[:i], "new", *text[i + 1 :]]) for i in range(90)]
    texts += [" ".join([*text[:12], *(f"v{rng.randrange(900)}" for _ in range(60))]) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    _, members = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every_link=False)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == components(rows)


def test_similarity_join_of_odd_tables(spark):
    schema = "doc_id long, text string, print string, component string"
    empty = spark.createDataFrame([], schema)
    assert ngram_jaccard.ngram_jaccard_join(empty)[1].count() == 0
    text = "some words that stand in a row here"
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (None, text, None, None), (7, text.upper(), "", ""), (3, None, "", "")]
    links, members = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, schema))
    assert links.count() == 0
    assert sorted(((r.doc_id, r.component_id) for r in members.collect()), key=str) == sorted([(1, 1), (1, 1), (None, 1), (7, 1), (3, 3)], key=str)


def test_line_dedup(spark):
    schema = "doc_id long, text string, n_lines string"
    rows = [(1, "a\nb\nc\nd", ""), (2, "x\na\nb\nc\ny", ""), (3, "a\na\na\na", ""), (4, None, ""), (5, "", ""), (6, "a\nb", ""), (None, "a\nb\nc", ""), (7, "a\nb\nc", "")]
    out = line_dedup(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == {
        1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: ("a", 4, 3), 4: (None, 0, 0), 5: ("", 1, 0), 6: ("a\nb", 2, 0), None: ("a\nb\nc", 3, 0), 7: ("", 3, 3),
    }
    assert line_dedup(spark.createDataFrame([], schema)).count() == 0


def brute_hits(text, items, window):
    w, hit, found = plain(text), set(), set()
    for item, body in items:
        b = plain(body)
        n = min(window, len(b))
        own = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in own:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(12)] + [(50, None), (51, "?!")]
    docs = [(i, some(rng.randrange(40)).upper(), "extra") for i in range(60)] + [(100, None, ""), (101, "", ""), (102, "Ünïcode w1-w2", ""), (None, "w1 w2 w3", "")]
    out = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string"), window=4)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        r = got[i]
        assert (r.n_words, r.n_hit, r.items) == brute_hits(text, [x for x in items if x[1]], 4)
        words = plain(text)
        for m in r.matches:
            body = plain(dict(items)[m.item])
            assert words[m.start : m.start + m.length] == body[m.item_start : m.item_start + m.length]


def test_decontamination_without_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out = decontamination.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert (out.n_words, out.n_hit, out.items, out.longest) == (2, 0, [], 0)


def test_word_classes():
    text = "A\x0bb\x1cc d e\tÉF-9"
    assert spaced(text) == ["a", "b\x1cc", "d e", "Éf-9"]
    assert plain(text) == ["a", "b", "c", "d e", "Éf", "9"]
