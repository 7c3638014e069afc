"""The registered opN_<name> queries: thin projections of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_trie import prefix_trie
from .decontaminate import decontaminate
from .html_extract import extract, train_extractor
from .jaccard_join import jaccard_join
from .lexical_search import index_terms, search
from .license_scan import scan_licenses
from .line_dedup import line_dedup
from .neighbours import nearest
from .packing import pack
from .quality import quality
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .url_filter import filter_urls, labelled_urls

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_substring_dedup", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, string_agg(p.w[p.p], ' ' ORDER BY p.p) AS t, count(*) AS n
      FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
s AS (SELECT doc_id, unnest(range(0, CAST(length(b) / 2 AS BIGINT) - 99)) AS i, b FROM d WHERE length(b) >= 200),
h AS (SELECT doc_id, i, md5_number(substr(b, 2 * i + 1, 200)) AS k FROM s),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
e AS (SELECT doc_id, i AS p, 1 AS v FROM r UNION ALL SELECT doc_id, i + 100, -1 FROM r),
g AS (SELECT doc_id, p, sum(v) AS v FROM e GROUP BY doc_id, p),
o AS (SELECT doc_id, p, sum(v) OVER (PARTITION BY doc_id ORDER BY p) AS depth FROM g),
x AS (SELECT doc_id, p, depth, lag(depth, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM o),
m AS (SELECT doc_id, p AS lo, before, depth, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS hi FROM x
      WHERE (depth > 0) <> (before > 0)),
spans AS (SELECT doc_id, lo, hi FROM m WHERE depth > 0),
kept AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS lo, lo AS hi FROM spans
         UNION ALL SELECT doc_id, max(hi), 1000000000 FROM spans GROUP BY doc_id),
t AS (SELECT kept.doc_id, string_agg(substr(b, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)), '' ORDER BY lo) AS b
      FROM kept JOIN d USING (doc_id) GROUP BY kept.doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.b) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.b, d.b))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_benchmark_decontamination", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS k FROM bi),
dl AS (SELECT doc_id, w, l FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l),
di AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dl),
hw AS (SELECT doc_id, i, di.l, item_id FROM di JOIN bw ON bw.l = di.l AND bw.k = array_to_string(w[i:i + di.l - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hw) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hw) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_ngram_jaccard_join", """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
z AS (SELECT a, min(b) AS b FROM r GROUP BY a),
m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
h AS (SELECT doc_id, md5(string_agg(k, chr(10) ORDER BY k)) AS h FROM s GROUP BY doc_id),
e AS (SELECT doc_id, count(*) OVER (PARTITION BY h) AS n_copies FROM h)
SELECT d.doc_id, least(d.doc_id, coalesce(z.b, d.doc_id)) AS class_id, coalesce(m.n_links, 0) AS n_links,
       coalesce(e.n_copies, 1) AS n_copies, coalesce(n.n, 0) AS n_shingles
FROM d LEFT JOIN z ON z.a = d.doc_id LEFT JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN e ON e.doc_id = d.doc_id""")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train_extractor(pages))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op13_line_dedup", """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
g AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT doc_id, i, line, g.k IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op12_conversation_prefix_trie", """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
                  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(x ORDER BY i) AS own,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                     lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 9 AS h FROM t GROUP BY c),
q AS (SELECT o.c, list_concat(coalesce(b.own, [])[1:o.h], o.own[o.h + 1:]) AS q FROM o LEFT JOIN o b ON b.c = o.c - o.c % 5),
r AS (SELECT c, d, len(q) = d AS e, octet_length(encode(q[d].t)) AS nb, md5(to_json(q[1:d])) AS k FROM (SELECT *, unnest(range(0, len(q) + 1)) AS d FROM q)),
n AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(nb), 0) AS nb,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (e), '')) AS ends_sha256 FROM r GROUP BY k),
p AS (SELECT DISTINCT r.k, a.k AS pk FROM r JOIN r a ON a.c = r.c AND a.d = r.d - 1),
f AS (SELECT pk AS k, count(*) AS n_children FROM p GROUP BY pk),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (k)),
s AS (SELECT r.k, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.nb) AS BIGINT) AS saved_tokens
      FROM v JOIN r ON r.c = v.conv_id AND r.d <= v.depth GROUP BY r.k)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (k) LEFT JOIN p USING (k) LEFT JOIN n a ON a.k = p.pk""")
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query("op11_ranked_lexical_search", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
i AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))) AS impact FROM p JOIN w USING (t), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20""")
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index_terms(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
