"""Line dedup against brute force."""

import random

import pytest

pytest.importorskip("tabpredict.llm")

from pyspark.sql import functions as F  # noqa: E402

from tabpredict.llm import line_dedup as L  # noqa: E402

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=20, min_docs=3):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(BLANKS))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(k := lower(x.strip(BLANKS)), ())) < min_docs or max(holders[k]) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def judged(make_docs, rows, **options):
    docs = make_docs([(d, t, "en", "s", 0) for d, t in rows])
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in L.line_dedup(docs, **options).collect()), key=str)


def cases():
    rng = random.Random(7)
    pool = ["shared line number %d of the pool é" % k for k in range(12)] + ["short", "", "   ", "\tShared Line Number 3 OF the pool é \r", "\u00a0shared line number 3 of the pool é",
            "ÀÉ these capitals are not lowered", "àé these capitals are not lowered", "exactly twenty chars", "exactly nineteen ch"]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.7 else "own line %d of document %d" % (j, k) for j in range(rng.randint(1, 12)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n\n"), (None, "a line of the row without an id\n" + pool[2]), (None, pool[2])]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (4, "another text of document four\n" + pool[1])]       # repeated rows, another text of one id
    rows += [(300 + k, pool[5]) for k in range(5)] + [(7, rows[7][1] + "\n")]
    rows += [(400, "\n".join(pool[k % 21] if k % 3 else "line %d in the long text, alone" % k for k in range(5000)))]
    rows += [(500, "twice in one document only\n" * 9), (501, "twice in one document only"), (502, "three lines that all go away"), (503, "three lines that all go away"), (504, "three lines that all go away")]
    return rows


def test_line_dedup_is_brute_force(make_docs):
    assert judged(make_docs, cases()) == brute(cases())
    assert judged(make_docs, cases(), min_chars=5, min_docs=2) == brute(cases(), 5, 2)


def test_frequent_keys_are_judged_alike(make_docs, monkeypatch):
    """A key in most lines is judged where it lies, all others by ranges: with and without it, the same."""
    rows = [(k, "the same line in each document\nanother line of document %d" % (k // 4)) for k in range(400)] + [(None, "the same line in each document")]
    assert judged(make_docs, rows) == brute(rows)
    monkeypatch.setattr(L, "HOT_KEYS", 1)
    monkeypatch.setattr(L, "RANGE_ROWS", 50)
    assert judged(make_docs, rows) == brute(rows)


def test_bitmap_round_trip(make_docs):
    rows = [(1, "\n".join("a shared line, number %d" % (k % 70) for k in range(300)))] + [(k, "\n".join("a shared line, number %d" % k for k in range(70))) for k in (2, 3)]
    docs = make_docs([(d, t, "en", "s", 0) for d, t in rows])
    got = {r.doc: (r.n_dropped, r.at) for r in L.line_bitmaps(docs).select("doc", "n_dropped", L.dropped_at(F.col("words")).alias("at")).collect()}
    assert got == {1: (300, list(range(300))), 2: (70, list(range(70)))}


def test_empty_table(make_docs):
    assert judged(make_docs, []) == []


def test_no_python_on_the_main_path(make_docs):
    plan = L.line_dedup(make_docs([(1, "x", "en", "s", 0)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


