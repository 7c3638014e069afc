"""The conversation trie against brute force."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("tabpredict.llm")

from pyspark.sql import functions as F  # noqa: E402

from tabpredict.llm import conversation_trie as C  # noqa: E402

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def content(role, text):
    r = (role or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + (text or "").encode()).hexdigest()[:30]


def brute(rows, family=5, heads=9):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, content(role, text), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    nodes, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        seq = tuple(convs.get(c - int(c % family), [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    out, below = [], {}
    for key in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below[key] = (sum(below[k][0] for k in kids.get(key, [])) or 1, saved + sum(below[k][1] for k in kids.get(key, [])))
        out.append((min(nodes[key]), len(key), min(nodes[key[:-1]]) if key else None, len(nodes[key]), len(kids.get(key, [])), *below[key],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def trie(spark):
    def make(rows, **options):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        for c in ("conv", "depth", "owner", "part", "at", "base", "h", "m", "f1", "v1"):
            df = df.withColumn(c, F.lit(7))
        return sorted((tuple(r) for r in C.prefix_trie(df, **options).select(COLUMNS).collect()), key=str)
    return make


def conversations(rng, n, longest=10):
    said = ["hello", "é è ü", "", None, "a longer turn " * 9, "yes", "no"]
    return [(c, t, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(said) if t else "hello") for c in range(n) for t in range(rng.randint(1, longest))]


def test_trie_is_brute_force(trie):
    rng = random.Random(3)
    rows = conversations(rng, 120)
    rows = [r for r in rows if r[0] not in (5, 40)]                          # families without a base
    rows += [(1000 + k, t, "user", "copy %d" % t) for k in range(0, 60) for t in range(9)]         # equal conversations
    rows += [(2000, t, "user", "long %d" % (t % 3)) for t in range(700)] + [(2001, t, "user", "long %d" % (t % 3)) for t in range(650)]
    rows += [(None, 0, "user", "of no conversation"), (3000, None, "user", "null turn"), (3000, 0, "user", "then"), (3000, 0, "user", "tie"), (3000, 0, "user", "tie")]
    rows += [(7 * 10 ** 12 + k, 0, "user", "hello") for k in range(9)]
    rng.shuffle(rows)
    assert trie(rows) == brute(rows)
    assert trie(rows, family=3, heads=4) == brute(rows, 3, 4)


def test_long_conversations_span_ranges(trie, monkeypatch):
    monkeypatch.setattr(C, "RANGE_ROWS", 40)
    monkeypatch.setattr(C, "STRETCH", 16)
    rng = random.Random(4)
    rows = conversations(rng, 20) + [(500 + c, t, "user", rng.choice("ab")) for c in range(3) for t in range(300)]
    rows += [(600 + c, t, "user", "the same") for c in range(5) for t in range(150 + c // 3)]
    rng.shuffle(rows)
    assert trie(rows) == brute(rows)


def test_roles_and_texts_do_not_run_together(trie):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "", "abc"), (15, 0, None, "abc"), (20, 0, "abc", None)]
    assert trie(rows, heads=1) == brute(rows, 5, 1)


def test_equal_fingerprints_are_found_and_built_anew(trie, monkeypatch):
    """Bases of zero make all prefixes of equal first turns clash: seen, and answered by other bases."""
    true = C.bases
    monkeypatch.setattr(C, "bases", lambda attempt: [1] * 4 if attempt == 0 else true(attempt))
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (5, 0, "u", "b"), (5, 1, "u", "a")]
    assert trie(rows, heads=1) == brute(rows, 5, 1)
    monkeypatch.setattr(C, "bases", lambda attempt: [1] * 4)
    with pytest.raises(RuntimeError):
        trie(rows, heads=1)


def test_empty_table(trie):
    assert trie([]) == []
    assert trie([(None, 1, "user", "x")]) == []
