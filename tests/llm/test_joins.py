"""Jaccard join, decontamination, neighbours and url rules against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("tabpredict.llm")

from pyspark.sql import functions as F  # noqa: E402

from tabpredict.llm import components as C  # noqa: E402
from tabpredict.llm import jaccard_join as J  # noqa: E402
from tabpredict.llm.decontaminate import decontaminate  # noqa: E402
from tabpredict.llm.neighbours import Partition, nearest  # noqa: E402
from tabpredict.llm.queries import ORACLE  # noqa: E402,F401
from tabpredict.llm.url_filter import filter_urls, mine_rules  # noqa: E402


def rows_of(texts):
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 150 + k) for k in range(30)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(25)]
    got = dict((r.node, r.label) for r in C.components(spark.createDataFrame(links, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent) if any(x in e and e[0] != e[1] for e in links)}
    assert got == want


def brute_join(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(texts)
    links = [{j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(n)]
    out = []
    for i in range(n):
        reach, new = {i}, {i}
        while new:
            new = set().union(*(links[x] for x in new)) - reach
            reach |= new
        out.append((min(reach), len(links[i]), sum(1 for s in sets if s and s == sets[i]) or 1, len(sets[i])))
    return out


def family(rng, n, words=80):
    """Near copies of one text, each with a few words changed."""
    base = [f"w{rng.randrange(1000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(words)] = f"v{rng.randrange(1000)}"
        out.append(" ".join(own))
    return out


def test_jaccard_join(spark, make_docs, texts):
    rng = random.Random(8)
    every = texts + family(rng, 40) + family(rng, 15, 30)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies, r.n_shingles) for r in J.jaccard_join(make_docs(rows_of(every))).collect()}
    assert got == dict(enumerate(brute_join(every)))


def test_jaccard_join_large_nodes_and_blocks(spark, make_docs, monkeypatch):
    """Groups beyond the small node and the block size take the other branches."""
    monkeypatch.setattr(J, "SMALL_NODE", 8)
    monkeypatch.setattr(J, "BLOCK_SETS", 16)
    every = family(random.Random(9), 60)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies, r.n_shingles) for r in J.jaccard_join(make_docs(rows_of(every))).collect()}
    assert got == dict(enumerate(brute_join(every)))


def test_jaccard_join_edges(spark, make_docs):
    rows = [(None, "a b c d e f", "", "", 1), (2, "a b c d e f", "", "", 1), (2, "a b c d e f", "", "", 1), (3, None, "", "", 0), (4, "", "", "", 0)]
    got = sorted((r.doc_id is None, r.doc_id, r.class_id, r.n_links, r.stands) for r in J.jaccard_join(make_docs(rows)).collect())
    assert got == [(False, 2, None, 2, False), (False, 2, None, 2, False), (False, 3, 3, 0, True), (False, 4, 4, 0, True), (True, None, None, 2, True)]
    assert J.jaccard_join(make_docs([])).count() == 0


def test_runs_reach_the_recall():
    assert (1 - J.survival(J.DEPTH)) ** J.runs_needed(0.999, J.DEPTH) <= 0.001


def brute_hits(texts, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    windows = []
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        windows += [(k, n, tuple(w[i:i + n])) for i in range(len(w) - n + 1)] if n else []
    for t in texts:
        w, hit, own = words(t), set(), set()
        for k, n, x in windows:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == x:
                    hit.update(range(i, i + n))
                    own.add(str(k))
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontaminate(spark, make_docs, texts):
    items = [(10, texts[35]), (9, " ".join((texts[33] or "").split()[:14])), (11, "ONE two, three"), (12, None), (13, ""), (14, "one"), (10, texts[35]), (15, texts[6])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.h, r.contaminated)
           for r in decontaminate(make_docs(rows_of(texts)), bench).withColumn("h", F.sha2(F.concat_ws(",", "items"), 256)).collect()}
    assert got == dict(enumerate(brute_hits(texts, items)))
    none = decontaminate(make_docs(rows_of(texts[:5])), bench.limit(0)).collect()
    assert len(none) == 5 and not any(r.contaminated or r.n_hit for r in none)
    assert decontaminate(make_docs([]), bench).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).round(3)
    x[100:140] = x[7]                                      # ties
    x[200] = 2 * x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 8, 1), (1050, [float("nan")] * 8, 1),
                                                            (1100, [float("inf")] + [1.0] * 7, 1), (1150, [1.0, None] + [1.0] * 6, 1), (1200, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 50))
    for q, found in got.items():
        score = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:5]
        assert [f[1] for f in sorted(found)] == order
        assert np.allclose([f[2] for f in sorted(found)], score[order], rtol=0, atol=1e-12)
    assert nearest(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_of_one_id_are_candidates(spark):
    rows = [(50, [1.0, 0.0])] + [(7, [1.0, 0.1]), (7, [0.0, 1.0])] + [(3, [1.0, 1.0])] * 3 + [(100, [2.0, 2.0])] * 2 + [(100, [-1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault((r.query_id, r.rank), []).append((r.vec_id, round(r.score, 6)))
    near = [(i, np.array(v)) for i, v in rows if i is not None]
    want = {}
    for k, (q, x) in enumerate(near):
        if q % 50 == 0:
            found = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), i) for j, (i, y) in enumerate(near) if j != k)[:5]
            for n, (score, i) in enumerate(found):
                want.setdefault((q, n + 1), []).append((i, -score))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert got[50, 1] == [(7, 0.995037)] and sorted(len(v) for v in got.values()) == [1] * 5 + [3] * 5


def test_clustered_rows_probe_few_parts(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(300, 16))
    x = (middle[rng.integers(0, 300, 40_000)] + 0.25 * rng.normal(size=(40_000, 16))).astype(np.float32).astype(float)
    learned = Partition(x[:16_384], 64, 5, 0.97)
    assert 2 * learned.probes < 64 and learned.measured >= 0.97
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()})).repartition(8)
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 50 == 0, part_rows=625).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += sum((q, int(i)) in got for i in np.argsort(-score)[:5])
    assert len(got) == 5 * 800 and hits >= 0.9 * len(got)


def test_nearest_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 50 == 0).collect()}
    pdf = df.toPandas().sort_values("vec_id")
    x = np.stack(pdf.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, found, asked = pdf.vec_id.to_numpy(), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[q] = -2
        found += sum((ids[q], ids[j]) in got for j in np.argsort(-near)[:5])
        asked += 5
    assert found / asked >= 0.9


URLS = [("http://a.net/x", "a.net", "/x", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"), ("HTTP://Sub.Example.NET/en/1?q#f", "sub.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("https://x.example.com/de/9", "x.example.com", "/de/9", "example.com/de/", "block"),
        ("https://notexample.com/de/9", "notexample.com", "/de/9", None, "allow"), ("ftp://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"), ("nourl", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("", "", "", None, "allow"), ("://net/", "net", "/", "net/", "block"), ("http://h?x://y", "h", "", None, "allow")]


def test_fixed_url_rules(spark):
    pages = spark.createDataFrame([(k, u[0], 3) for k, u in enumerate(URLS)] + [(0, URLS[0][0], 3)], "page_id long, url string, rid int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, None).collect())
    assert got == sorted([(k, *u[1:]) for k, u in enumerate(URLS)] + [(0, *URLS[0][1:])])
    assert filter_urls(pages.limit(0), None).count() == 0


def test_mined_url_rules(spark):
    bad = [(f"http://s{k % 7}.example.com/casino/{k}?win=1", True) for k in range(60)]
    good = [(f"http://s{k % 7}.example.com/news/{k}?win=1", False) for k in range(80)] + [(f"http://s{k % 7}.example.com/casino/{k}", False) for k in range(70)]
    labels = spark.createDataFrame([*bad, *good, (None, True), ("http://x.example.com/", None)], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "https://zz.example.com/casino/9?win=3"), (2, "https://zz.example.com/news/9?win=3"), (3, "https://zz.example.com/casino/9")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.tokens) for r in filter_urls(pages, labels, min_confidence=0.8).collect()}
    assert got[1][0] == "block" and set(got[1][1]) >= {"path=casino", "key=win"}
    assert got[2][0] == "allow" and got[3][0] == "allow"
    assert mine_rules(spark.createDataFrame([], "tokens array<string>, bad boolean")).count() == 0
