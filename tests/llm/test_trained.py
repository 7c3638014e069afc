"""Packing, extraction, quality, licenses and the pipeline."""

import collections
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tabpredict.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tabpredict.llm import html_extract as H  # noqa: E402
from tabpredict.llm import packing as P  # noqa: E402
from tabpredict.llm import quality as Q  # noqa: E402
from tabpredict.llm.license_scan import scan_licenses  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", " a  b ", "a<|endoftext|>b", "can't.'s ,'s '.s 's, a,'s dog's!? x.y,z 12a3,4", "x́ q e\u0301 E\u0301", "\x85 a\x85b a\x1c b\x1cc \xa0z",
       "z İ Σας ΟΔΟΣ", "Éa É, naïve,Straße x—,y “q”, ≠≠ ≮a K Å", None, "<|ENDOFTEXT|> <|startoftext|>X", "a\x0bb\tc\r\nd"]


def rows_of(texts):
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


def reference_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_ids_equal_the_tokenizers(texts):
    every = ODD + texts
    ids, off = P.WordIds(PATH).encode(pa.array(every))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == reference_ids(every)


def test_ids_equal_on_documents():
    import pyarrow.parquet as pq
    own = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").combine_chunks()
    words = P.WordIds(PATH)
    for part in (own.slice(0, 90), own.slice(90)):
        ids, off = words.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == reference_ids(part.to_pylist())


@pytest.mark.parametrize("seed", range(4))
def test_fillings_hold_all_pieces(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) if seed % 2 else rng.randint(20, 55) for _ in range(rng.randint(1, 400))]
    plan, bound, _ = P.bin_completion(dict(collections.Counter(sizes)), 100, 100_000)
    got = collections.Counter()
    for fill, bins in plan:
        assert sum(k * c for k, c in fill.items()) <= 100
        for k, c in fill.items():
            got[k] += c * bins
    assert got == collections.Counter(sizes)
    fit = sum(m for _, m in P.best_fit_decreasing(dict(collections.Counter(sizes)), 100))
    assert -(-sum(sizes) // 100) <= bound <= sum(m for _, m in plan) <= fit


def test_completion_beats_best_fit():
    sizes = collections.Counter({60: 2, 50: 2, 40: 1, 30: 2, 20: 4})         # total 400
    assert sum(m for _, m in P.bin_completion(dict(sizes), 100)[0]) == 4
    plan, bound, sure = P.bin_completion({k: 1 for k in (30, 32, 38, 49, 16, 21, 25, 29, 34, 26)}, 100)
    assert (sum(m for _, m in plan), bound, sure) == (3, 3, True)


def fewest_bins(sizes, room):
    """Exact, over all subsets: the fewest bins, then the least used of the last one."""
    best = [(0, room)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for own, (bins, used) in enumerate(best):
        bins, used = best[own]
        for i, x in enumerate(sizes):
            if not own >> i & 1:
                best[own | 1 << i] = min(best[own | 1 << i], (bins, used + x) if used + x <= room else (bins + 1, x))
    return best[-1][0]


def test_completion_is_exact_on_small_mixes():
    rng, worse = random.Random(11), 0
    for _ in range(3000):
        room = rng.choice([20, 50, 100])
        sizes = [rng.randint(rng.choice([1, room // 6]), rng.choice([room // 2, room])) for _ in range(rng.randint(1, 10))]
        counts = dict(collections.Counter(sizes))
        plan, bound, sure = P.bin_completion(counts, room)
        want = fewest_bins(sizes, room)
        assert sure and bound <= want == sum(m for _, m in plan), sizes
        assert collections.Counter({k: sum(f.get(k, 0) * m for f, m in plan) for k in counts}) == collections.Counter(sizes)
        worse += sum(m for _, m in P.best_fit_decreasing(counts, room)) > want
    assert worse > 20                      # best fit alone would fail


def test_fillings_are_the_undominated_ones():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        room, counts = rng.randint(10, 40), collections.Counter(sizes)
        every = {tuple(sorted(x for i, x in enumerate(sizes) if own >> i & 1)) for own in range(1 << len(sizes))}
        every = [collections.Counter(f) for f in every if sum(f) <= room]
        want = [b for b in every if not any(a != b and P.covers(a, b) for a in every)]
        got = list(P.fillings(sorted(counts), dict(counts), room, room, [10 ** 6]))
        assert all(w == room - sum(k * c for k, c in f.items()) for w, f in got) and [w for w, _ in got] == sorted(w for w, _ in got)
        assert sorted(map(sorted, (collections.Counter(f).elements() for _, f in got))) == sorted(sorted(f.elements()) for f in want)


def test_search_ends_with_its_steps():
    rng = random.Random(2)
    counts = dict(collections.Counter(rng.randint(200, 1400) for _ in range(300)))
    plan, bound, sure = P.bin_completion(counts, 2048, 5000)
    assert not sure and bound < sum(m for _, m in plan) == sum(m for _, m in P.best_fit_decreasing(counts, 2048))


def test_pack(spark, make_docs, texts):
    every = texts + [texts[49 - 2]] * 3
    docs = make_docs(rows_of(every) + [(None, "x y", "", "", 1)]).repartition(4)
    size = 256
    got = P.pack(docs, PATH, size=size).toPandas()
    ids = dict(enumerate(reference_ids(every)))
    assert len(got) == sum(-(-len(i) // size) for i in ids.values()) + 1
    for r in got[got.doc_id.notna()].itertuples():
        own = np.array(ids[int(r.doc_id)], np.uint32)
        assert r.start == r.piece * size and r.length == min(size, len(own) - r.start)
        assert zlib.crc32(own[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= size
    assert P.pack(make_docs([]), PATH).count() == 0


# ------------------------------------------------------------ extraction

PAGES = [
    ("<p>One &amp two<br>three<p>Four  \n five", "One & two three\n\nFour five"),
    ("<div>a<p>b</div>c", "a\n\nb\n\nc"), ("<script>var x='<p>no</p>'</script><!-- no <p>no</p> --><p>yes</p><style>p{}</style>", "yes"),
    ("<b>x</b><i>y</i> z", "xy z"), ("", ""), ("<p", ""), ("<p title='a>b'>q</p><textarea>no</textarea>", "q"), ("a < b &lt;c&gt;", "a < b <c>"),
    ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1\n\n2\n\n3\n\n4"), ("<head><title>t</title></head><body>x</body>", "x")]


def test_parser_keeps_blocks():
    for source, want in PAGES:
        page = H.Page(source)
        assert page.text(np.ones(len(page.tag))) == want, source


def test_parser_keeps_what_follows_open_elements():
    for inside, want in [("<svg viewBox='0 0 1 1'/>", ""), ("<math/>", ""), ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"), ("<svg><path d='M0'/><title/></svg>", ""),
                         ("<svg><text>label</text></svg>", "label"), ("<svg><g>", ""), ("<math><mi>y</mi>", "y"), ("<object data=a>", ""), ("<object>other</object>", "other"),
                         ("<select><option>A<option>B</select>", "A\n\nB"), ("<select><option>A", "A"), ("<select>", ""), ("<template>", ""),
                         ("<template><p>no</p></template>", ""), ("<iframe>no</iframe><noscript>no</noscript>", "")]:
        page = H.Page(f"<article><p>one</p>{inside}<p>two</p></article><p>three</p>")
        assert page.text(np.ones(len(page.tag))) == "\n\n".join(filter(None, ["one", want, "two", "three"])), inside
        at = next(n for n, t in page.pieces if t == "two")
        while at > 0:
            at = page.parent[at]
            assert page.tag[at] not in ("svg", "math", "select", "option"), inside


def test_no_kept_node_in_a_dropped_one():
    page = H.Page("<div><section><p>a</p></section></div><p>b</p>")
    assert page.text(np.array([1, -4, -4, 1.5, 1])) == "b"
    assert page.text(np.array([1, -1, -1, 4, 1])) == "a\n\nb"


def test_extract(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    train, held = pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")
    trees = H.train_extractor(train)
    right = words = found = wrong = 0
    for k, row in enumerate(held.limit(60).collect()):
        for seed in (0, 500 + k):
            page = H.Page(H.variant(row.html, seed))
            want = page.text(np.array([4.0 if y is None or y > 0.5 else -9.0 for y in page.labels()]))
            got = page.text(trees.odds(page.features()))
            right += got == want
            a, b = collections.Counter(want.split()), collections.Counter(got.split())
            words, found, wrong = words + sum(a.values()), found + sum((a & b).values()), wrong + sum((b - a).values())
    assert right >= 110 and found / words > 0.99 and wrong / words < 0.01
    odd = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, None, "", 1), (3, "u", "<article><p>Some words of an article, long enough.</p></article>", 1)],
                                "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract(odd, trees).collect())
    assert got[:3] == [(1, "", 0), (2, "", 0), (2, "", 0)]
    assert H.extract(odd.limit(0), trees).count() == 0 and H.train_extractor(odd.limit(2)) is None
    assert H.extract(odd, None).where("page_id = 3").first().n_chars > 0


# --------------------------------------------------------------- quality

def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(10)) < 3
    model = Q.train_quality(docs, labels.where(~apart), Q.META_COLS, Q.good_label(), rounds=1)
    got = Q.judge_quality(docs, model, Q.META_COLS)
    pdf = labels.where(apart).join(got, "doc_id").toPandas()
    junk, clean = pdf[pdf.quality == 0], pdf[(pdf.quality == 1) & (pdf.toxic == 0)]
    toxic = pdf[pdf.toxic == 1]
    print("held out: junk", (~junk.keep).mean(), "clean", clean.keep.mean(), "toxic", len(toxic), (~toxic.keep).mean())
    assert (~junk.keep).mean() > 0.95 and clean.keep.mean() > 0.97 and (~toxic.keep).mean() > 0.8
    kept = Q.accepted(docs, model, Q.META_COLS)
    assert kept.schema == docs.schema and kept.count() == got.where("keep").count()


def test_quality_edges(spark, make_docs):
    docs = make_docs([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "x", "en", "s", 1)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (3, 1, None), (9, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        got = Q.quality(docs, labels).collect()
        assert len(got) == 5 and all(r.keep and r.score is None for r in got)
    both = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality(docs, both).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert Q.quality(make_docs([]), both).count() == 0


def test_quality_pseudo_labels_have_no_cap():
    got = Q.sure(np.tile([-1.0, 0.0, 1.0], 3000), (10.0, 0.0))
    assert [int((got == k).sum()) for k in (0, -1, 1)] == [3000, 3000, 3000]


def test_quality_fit_is_the_regressions_optimum(spark):
    """Loss of the fit in the cluster against that of MLlib's regression on the same rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumnRenamed("doc_id", "id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"), "toxic")
    blocks = Q.viewed(docs.join(labels, "id", "left").select("id", "good", "toxic", "text", F.col("lang").alias("meta_0")), ["lang"])
    rows = []
    for batch in blocks.toArrow().to_batches():
        for k in range(batch.num_rows):
            part = Q.Part(batch, k)
            cols, off, dense = part.views["words"]
            for i in np.flatnonzero(part.good >= 0):
                rows.append((float(part.good[i]), SparseVector(Q.WIDTH["words"], {**{int(c): 1.0 for c in cols[off[i]:off[i + 1]]},
                                                                                 **{(1 << Q.WORD_BITS) + j: float(x) for j, x in enumerate(dense[i])}})))
    lr = LogisticRegression(labelCol="y", featuresCol="x", regParam=1e-3, standardization=False, maxIter=100).fit(spark.createDataFrame(rows, ["y", "x"]))
    task = Q.Task("words", "good", 0)

    def loss(w):
        total, n, _ = Q.gradients(blocks, [task], [w], [None])[0]
        return total / n + 0.5e-3 * float(w[:-1] @ w[:-1])

    ours, theirs = loss(Q.fitted(blocks, [task], [(1e-3, 100)], [None], [None])[0]), loss(np.append(lr.coefficients.toArray(), lr.intercept))
    assert ours <= theirs * 1.001


def test_quality_blocks_are_small(spark, make_docs, monkeypatch):
    """No cell of the tables that a fit reads is large, however many rows a task has; settings are given back."""
    rng = random.Random(4)
    docs = make_docs(rows_of([" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(300)) for _ in range(2500)])).coalesce(1)
    rows = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).cast("int").alias("good"), F.lit(0).alias("toxic"), "text", F.col("lang").alias("meta_0"))
    sizes, evaluated = [], Q.evaluated

    def look(rows, weights):
        sizes.append(max(rows.select(*[F.max(F.octet_length(c)) for c in rows.columns[1:]]).first()))
        return evaluated(rows, weights)

    monkeypatch.setattr(Q, "evaluated", look)
    before = [spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]
    blocks = Q.viewed(rows, ["lang"])
    w, = Q.fitted(blocks, [Q.Task("words", "good", 0)], [(1e-3, 3)], [None], [None])
    most = max(blocks.select(*[F.max(F.octet_length(c)) for c in blocks.columns[1:]]).first())
    assert most < 1 << 19 and max(sizes) < 1 << 19 and np.isfinite(w).all(), (most, sizes)
    assert before == [spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]


def test_quality_look_is_one_job_of_small_results(spark):
    """A look at the loss is one job, whose tasks each send the driver a small share of the sums; settings are given back."""
    n = Q.WIDTH["words"] + 1
    cells = [np.arange(3, dtype=np.int32), np.array([2, 1], np.int32), np.zeros(2 * Q.N_STYLE), np.array([True, False]), np.ones(2)]
    rows = spark.createDataFrame([(k, *(bytearray(c.tobytes()) for c in cells)) for k in (0, 1)], Q.TAKEN)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.adaptive.enabled")
    sc.setJobGroup("look", "look")
    try:
        got = Q.evaluated(rows, {0: np.zeros(n), 1: np.zeros(n)})
    finally:
        sc._jsc.clearJobGroup()
    jobs = sc.statusTracker().getJobIdsForGroup("look")
    stages = [k for j in jobs for k in sc.statusTracker().getJobInfo(j).stageIds]
    tasks = sc.statusTracker().getStageInfo(max(stages)).numTasks
    assert len(jobs) == 1 and tasks * (1 << 19) > 2 * n * 8, (jobs, tasks)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    for loss, weight, grad in got.values():
        assert weight == 2 and abs(loss - 2 * np.log(2)) < 1e-12 and len(grad) == n
        assert grad[:4].tolist() == [-0.5, -0.5, 0.5, 0] and grad[-1] == 0 and not grad[3:].any()


def test_quality_steps_hold_few_vectors():
    """The driver holds a few vectors of a regression, not the 20 of the steps' memory; the descent finds the least all the same."""
    rng = np.random.default_rng(2)
    n = 200_000
    steep, best = np.exp(3 * rng.random(n)), rng.normal(size=n)

    def look(w):
        return float(0.5 * (steep * (w - best)) @ (w - best)), 1.0, steep * (w - best)

    tracemalloc.start()
    way, looks = Q.descent(0.0, 40, np.zeros(n), np.ones(n)), 0
    at = next(way)
    try:
        while True:
            at, looks = way.send(look(at)), looks + 1
    except StopIteration as end:
        w = end.value
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert looks > Q.MEMORY + 2 and most < 14 * 8 * n, (looks, most / (8 * n))
    assert look(w)[0] < 1e-2 * look(np.zeros(n))[0]


def test_quality_fits_toxic_texts_apart(spark, make_docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" vile" if k % 20 == 0 else "") for k in range(600)]
    docs = make_docs(rows_of(texts))
    labels = spark.createDataFrame([(k, int(k % 7 > 0), int(k % 20 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    model = Q.train_quality(docs, labels, ["lang"], Q.good_label(), rounds=0)
    assert set(model.weights) == {"words", "meta", "toxic"}
    got = Q.judge_quality(docs, model, ["lang"]).where("doc_id >= 400 and doc_id % 20 = 0").collect()
    assert len(got) == 10 and not any(r.keep for r in got)


# -------------------------------------------------------------- licenses

def test_license_scan(spark, make_docs):
    rows = [(1, "some words\nLicensed under the Apache License, Version 2.0.\nmore", "", "", 1), (2, "all RIGHTS reserved", "", "", 1), (3, "nothing of the kind here", "", "", 1),
            (4, None, "", "", 1), (5, "", "", "", 1), (6, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n", "", "", 1), (6, "Released under the MIT License.", "", "", 1),
            (7, "This work is licensed under the terms of the GNU General Public License, version 3.", "", "", 1), (8, "the word licensed alone", "", "", 1),
            (9, "Copyright 2020 by X. All rights reserved.", "", "", 1)]
    got = {}
    for r in scan_licenses(make_docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].licenses == ["Apache-2.0"] and got[1][0].found[0].line == 1 and got[1][0].found[0].exact and got[1][0].n_lines == 3
    assert got[2][0].licenses == ["all-rights-reserved"] and got[9][0].licenses == ["all-rights-reserved"]
    assert sorted(len(r.licenses) for r in got[6]) == [1, 2]
    assert got[7][0].licenses == ["GPL-3.0"] and got[7][0].found[0].added == ["terms", "of", "the"] or got[7][0].found[0].added == ["the", "terms", "of"]
    assert not got[7][0].found[0].exact
    for k in (3, 4, 5, 8):
        assert got[k][0].licenses == [] and not got[k][0].found
    assert scan_licenses(make_docs([])).count() == 0


def test_license_notices_across_lines(spark, make_docs):
    from tabpredict.llm.license_scan import TEMPLATES

    def wrapped(text, n=9, lead=" * "):
        words = text.split()
        return "\n".join(lead + " ".join(words[k:k + n]) for k in range(0, len(words), n))

    mit, gpl, bsd = TEMPLATES["MIT"][2], TEMPLATES["GPL-3.0"][1], TEMPLATES["BSD-3-Clause"][0]
    texts = ["x y\n" + wrapped(mit) + "\nz", wrapped(gpl), wrapped(bsd, 5, "# "), wrapped(mit.replace("sublicense, ", "")),
             "words Released under the MIT License. more of the words here Licensed under CC BY-NC 4.0. end",
             "This work is licensed under the GNU Affero General Public License, version 3.",
             "This work is licensed under the GNU Lesser General Public License, version 3.",
             wrapped(gpl.replace("GNU General", "GNU Lesser General")), "Licensed under the Apache License, Version 1.1.",
             "All rights reserved. All rights\nreserved."]
    got = {r.doc_id: r for r in scan_licenses(make_docs(rows_of(texts))).collect()}
    assert [got[k].licenses for k in range(10)] == [["MIT"], ["GPL-3.0"], ["BSD-3-Clause"], ["MIT"], ["CC-BY-NC-4.0", "MIT"], [], [], [], [], ["all-rights-reserved"]]
    assert [(f.line, f.exact) for f in got[0].found] == [(1, True)]
    assert [(f.exact, f.missing, f.added) for f in got[3].found] == [(False, ["sublicense"], [])]
    assert [f.license for f in got[4].found] == ["MIT", "CC-BY-NC-4.0"] and [f.line for f in got[9].found] == [0, 0]


def test_license_ranking_is_by_size_reduction(spark, make_docs):
    from tabpredict.llm import license_scan as L

    rng, every = random.Random(4), [(n, t) for n, lines in L.TEMPLATES.items() for t in lines]
    dealt = [[rng.choice(every) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    fill = ["", "", "alpha beta gamma", "one two three four five six seven eight nine"]
    texts = [" ".join(f"{rng.choice(fill)}\n{t if rng.random() < 0.5 else t.upper()}" for _, t in own) for own in dealt]
    got = {r.doc_id: r.found for r in scan_licenses(make_docs(rows_of(texts))).collect()}
    for k, own in enumerate(dealt):
        assert [(f.license, f.exact) for f in got[k]] == [(n, True) for n, _ in own], texts[k]
    scanner = L.Scanner(every)
    for _, text in every:                        # all templates tried on the text: none confirmed saves more
        gains = scanner.savings(text)
        sure = [gains[k] for k, (_, t) in enumerate(every) for m, a, _, _ in [L.wording(L.spoken(t), L.spoken(text))]
                if len(m) + len(a) <= L.DIFFERENT * len(L.spoken(t)) and not any(w in L.TELLING or w.isdigit() for w in m + a)]
        best = scanner.confirmed(text)
        assert best[0] == max(sure) == gains[best[1]] and best[0] > 0


def test_licenses_in_a_long_text(spark, make_docs):
    from tabpredict.llm import license_scan as L

    rng = random.Random(8)
    words = "license licensed under the rights reserved software of and copy alpha beta".split()
    text = " ".join(rng.choice(words) for _ in range(100_000)) + " " + L.TEMPLATES["MPL-2.0"][0] + " x" * 1000
    row, = scan_licenses(make_docs([(1, text, "", "", 0)])).collect()
    assert ("MPL-2.0", True) in [(f.license, f.exact) for f in row.found] and row.n_lines == 1


# -------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, make_docs, texts, tmp_path):
    import corpus_pipeline as C

    assert [f.__name__ for _, f in C.STAGES] == ["judge", "drop_near_copies", "cut_repeats", "drop_contaminated", "fill_sequences"]
    docs = make_docs(rows_of(texts) + [(7, texts[7], "en", "s", 1), (None, texts[8] + " z", "en", "s", 1)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, texts[9])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = C.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and 3 in ids and 30 not in ids and 31 not in ids and 43 not in ids and {38, 39, 40} <= set(ids)
    cut = C.cut_repeats(spark, kept, str(tmp_path))
    assert cut.columns == docs.columns and dict(cut.dtypes) == dict(docs.dtypes)
    for r in cut.where("n_chars > 0 and text is not null").collect():
        assert r.label == 7
    clean = C.drop_contaminated(spark, docs, str(tmp_path))
    assert 9 not in [r.doc_id for r in clean.collect()] and clean.count() == docs.count() - 1
    assert C.run(spark, str(tmp_path)).count() > 0


def test_quality_moves_no_text_to_the_labels(spark, make_docs):
    """The shuffle of the views' join has no text; labels reach repeated and null ids as before."""
    docs = make_docs([(1, "a b", "en", "s", 3), (1, "c", "en", "s", 1), (None, "d", "en", "s", 1), (4, "e", "de", "s", 1), (5, None, "de", "s", 0)])
    known = spark.createDataFrame([(1, 1, 0), (4, 0, None)], "id long, good int, toxic int")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("meta_0"))
    joined = Q.viewed(rows.join(known, "id", "left").select("id", "good", "toxic", "text", "meta_0"), ["lang"])
    apart = Q.viewed(rows, ["lang"], known)

    def told(blocks):
        out = []
        for batch in blocks.toArrow().to_batches():
            for k in range(batch.num_rows):
                part = Q.Part(batch, k)
                cells = []
                for name in ("words", "meta"):
                    cols, off, dense = part.views[name]
                    cells.append([(cols[a:b].tolist(), None if dense is None else dense[i].tolist()) for i, (a, b) in enumerate(zip(off, off[1:]))])
                out += zip(part.draw.tolist(), part.good.tolist(), part.toxic.tolist(), *cells)
        return sorted(out, key=str)

    assert len(told(apart)) == 5 and told(apart) == told(joined)
    assert sorted(r[1:3] for r in told(apart)) == [(-1, -1), (-1, -1), (0, -1), (1, 0), (1, 0)]


def test_search_holds_few_levels(monkeypatch):
    """A deep search gives the same plan whether it holds all its levels or looks for early ones anew, in little memory."""
    import tracemalloc
    rng = random.Random(7)
    counts = {k: 2 for k in rng.sample(range(20, 1900), 1000)}

    def run(held, size=2048, steps=30_000):
        monkeypatch.setattr(P, "HELD_LEVELS", held)
        tracemalloc.start()
        found = P.bin_completion(dict(counts), size, steps)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, most

    (few, small), (every, large) = run(4), run(10 ** 9)
    assert few == every and small < 0.7 * large, (small, large)
    for seed in range(20):
        rng = random.Random(seed)
        counts = dict(collections.Counter(rng.randint(5, 60) for _ in range(rng.randint(5, 30))))
        assert run(1, 100, 2000)[0] == run(10 ** 9, 100, 2000)[0]
