"""Difference-cover operators against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

pytest.importorskip("tabpredict.llm")

from tabpredict.llm import repeats as R  # noqa: E402
from tabpredict.llm.common import ALNUM, U64, window_hash, word_bounds  # noqa: E402
from tabpredict.llm.substring_dedup import substring_dedup  # noqa: E402
from tabpredict.llm.suffix_dedup import suffix_dedup  # noqa: E402


def rows_of(texts):
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


def test_covers_take_every_difference():
    for period, cover in R.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_window_hash_depends_on_content_only():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 500).astype(U64)
    for k in (1, 2, 3, 13, 44, 100):
        got, seen = window_hash(x, k), {}
        for p in range(len(x) - k + 1):
            assert seen.setdefault(x[p:p + k].tobytes(), got[p]) == got[p]
        assert len(set(seen.values())) == len(seen)
        assert (window_hash(x, k, np.array([0, 7, 50])) == got[[0, 7, 50]]).all()


def test_packed_names_round_trip():
    x = np.unique(np.random.default_rng(2).integers(0, 2 ** 63, 1000).astype(U64))
    assert (R.unpacked(R.packed(x)) == x).all()


def test_word_bounds_stop_at_text_borders():
    buf, off = np.frombuffer(b"abcdef  g", np.uint8), np.array([0, 3, 3, 7, 9])
    starts, ends, woff = word_bounds(buf, off, ALNUM)
    assert starts.tolist() == [0, 3, 8] and ends.tolist() == [3, 6, 9] and woff.tolist() == [0, 1, 1, 2, 3]


def brute_words(texts, n):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = collections.Counter(tuple(w[k:k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k:k + n])] > 1:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_substring_dedup(spark, make_docs, texts, block):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup(make_docs(rows_of(texts)), block_bytes=block).collect()}
    assert got == dict(enumerate(brute_words(texts, 35)))


def brute_bytes(texts, n):
    seen, out = set(), []
    for t in texts:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - n + 1):
            if b[k:k + n] in seen:
                gone.update(range(k, k + n))
            seen.add(b[k:k + n])
        spans = sum(1 for k in gone if k - 1 not in gone)
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out.append((len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_suffix_dedup(spark, make_docs, texts, block):
    got = suffix_dedup(make_docs(rows_of(texts)).repartition(5), block_bytes=block).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(brute_bytes(texts, 100)))
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed and len(r.kept_bytes) == r.n_bytes - r.n_removed


def test_suffix_dedup_repeated_and_null_ids(spark, make_docs):
    text = "abcdefghij" * 5 + "klmnopqrst" * 8
    got = sorted(tuple(r) for r in suffix_dedup(make_docs([(None, text, "", "", 1), (4, text, "", "", 1), (4, text, "", "", 1)]))
                 .selectExpr("coalesce(doc_id, -1)", "n_bytes - n_removed as left").collect())
    own = brute_bytes([text], 100)[0]
    assert got == [(-1, own[0] - own[1]), (4, 0), (4, 0)]


def test_carried_columns_and_half_characters(spark, make_docs):
    docs = make_docs([(1, "é" * 60, "fr", "a", 60), (2, "aé" + "é" * 60 + "z", "fr", "b", 62)])
    got = {r.doc_id: r for r in suffix_dedup(docs, carry=True).collect()}
    assert got[2].rest.source == "b" and got[2].rest.label == 7 and got[2].kept_text == got[2].kept_bytes.decode("utf-8", "ignore")


def test_empty_tables(spark, make_docs):
    docs = make_docs([])
    assert substring_dedup(docs).count() == 0 and suffix_dedup(docs).count() == 0 and suffix_dedup(docs, carry=True).count() == 0
