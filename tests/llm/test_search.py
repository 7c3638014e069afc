"""Ranked lexical search against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tabpredict.llm")

from pyspark.sql import functions as F  # noqa: E402

from tabpredict.llm import lexical_search as L  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_all, l_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_all) // l_all if l_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture
def found(spark, make_docs):
    def run(docs, items, block_bytes=4000, **options):
        index = L.index_terms(make_docs([(d, t, "en", "s", 0) for d, t in docs]), block_bytes=block_bytes)
        asked = spark.createDataFrame(items, "item_id long, text string")
        for c in ("query", "block", "rank", "id", "doc_id"):
            asked = asked.withColumn(c, F.lit(7))
        return sorted((tuple(r) for r in L.search(index, asked, **options).collect()), key=str)
    return run


def cases(seed=11, n=300):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(400)] + ["the", "of", "and", "Ünï", "É"] * 40
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(n)]
    docs += [(1000 + k, docs[3][1]) for k in range(40)] + [(2000, None), (2001, ""), (2002, "-- ,, !"), (None, "w1 w2 w3"), (None, "w5 " * 9), (2003, "w9 w9 w9")]
    docs += [(5, docs[5][1]), (3000, " ".join(rng.choice(words) for _ in range(9000))), (3001, "The OF and, w7-w8_w9/É!")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(25)]
    items += [(100, "w7 w7 w7 THE of w8"), (101, None), (102, ""), (103, "nowhere at all"), (None, "w1 w2"), (104, docs[3][1]), (104, docs[3][1]), (105, "w9")]
    return docs, items


def test_search_is_brute_force(found):
    docs, items = cases()
    want = brute(docs, items)
    assert found(docs, items) == want
    assert found(docs, items, block_bytes=300, batch_bytes=500) == want
    assert found(docs, items, top=3) == brute(docs, items, 3)


def test_frequent_terms_and_copies(found):
    """A third of the documents are copies, one pair of words is in nearly all."""
    rng = random.Random(2)
    docs = [(k, "common pair same copy") for k in range(200)] + [(500 + k, "common pair " + " ".join("x%d" % rng.randrange(90) for _ in range(12))) for k in range(400)]
    items = [(0, "common pair"), (1, "same copy"), (2, "x1 x2 x3 x4 common"), (3, "pair x5 x5 x5")]
    assert found(docs, items) == brute(docs, items)


def test_empty_tables(found):
    assert found([], [(1, "w1")]) == []
    assert found([(1, None), (2, "...")], [(1, "w1")]) == []
    assert found([(1, "w1")], []) == []


def blocks_of(found_lists, q):
    for batch in found_lists.toArrow().to_batches():
        for k in range(batch.num_rows):
            yield L.Block(batch, k, q)


def test_bounds_hold_and_tighten(make_docs):
    """No bound is below a score; bounds of pairs are below those of single terms, and skip documents."""
    docs, items = cases(5)
    index = L.index_terms(make_docs([(d, t, "en", "s", 0) for d, t in docs]), block_bytes=2000)
    n_all, l_all = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    q = L.Batch.of([L.plain_words(*L.text_bytes(pa.array([t])))[0] for _, t in items])
    q.weigh(L.frequencies(index, q.codes), n_all)
    pair_sum = single_sum = 0
    for block in blocks_of(L.impact_lists(index, q, n_all, l_all), q):
        for at in range(len(items)):
            place, times, bound = block.parts(q, at)
            score = np.zeros(len(block.ids), np.int64)
            for p, n in zip(place.tolist(), times.tolist()):
                doc, impact = block.list(p)
                score[doc] += impact * n
            single = int(sum(block.most[p] * n for p, n in zip(place.tolist(), times.tolist()) if p >= 0))
            assert score.max(initial=0) <= bound.sum() <= single
            pair_sum, single_sum = pair_sum + int(bound.sum()), single_sum + single
            for least in {1, int(np.median(score)) + 1, int(score.max(initial=0)), int(score.max(initial=0)) + 1} - {0}:
                got, reached = block.search(q, at, least, 10 ** 6)
                assert got.tolist() == np.flatnonzero(score >= least).tolist() and reached.tolist() == score[got].tolist()
    assert pair_sum < 0.9 * single_sum
