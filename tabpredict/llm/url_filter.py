"""URL filter by association rules, on DataFrame functions alone.

Fixed rules (host and path) decide where one fits. Else the url's tokens decide:
FP-growth over the labelled urls finds token combinations that go with bad pages;
rules pruned by support, confidence and lift are indexed under their rarest token,
and a url meets only rules whose index token it holds.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host, path, verdict); the longest fitting rule wins.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Share of the labelled urls, and their number, that a combination must occur in at least; share of those that must be bad.
MIN_SUPPORT, MIN_URLS, MIN_CONFIDENCE = 0.001, 25, 0.5
#: Share of bad among urls with a rule's tokens, against their share among all.
MIN_LIFT = 1.2
BAD, GOOD = "class=bad", "class=good"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Scheme, labels of the host, words of the path (numbers as one) and query keys."""
    scheme = F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1)))
    labels = F.transform(F.split(host, "[.]"), lambda x: F.concat(F.lit("label="), x))
    words = F.transform(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "^[0-9]+$", "0")))
    query = F.regexp_extract(url, "[?]([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    every = F.concat(F.array(scheme), labels, words, keys)
    bare = ["label=", "path=", "key="]
    return F.when(host != "", F.array_distinct(F.array_except(every, F.array(*map(F.lit, bare))))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (tokens, confidence, lift, support) for bad urls from rows (tokens, bad).

    A rule goes if a part of its tokens alone is at least as sure."""
    items = labelled.where("bad is not null and size(tokens) > 0").select(
        F.concat("tokens", F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
    n = items.count()
    if not n:
        return items.select("items", *[F.lit(0.0).alias(c) for c in ("confidence", "lift", "support")]).toDF("tokens", "confidence", "lift", "support")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_URLS / n)), minConfidence=min_confidence).fit(items)
    rules = (model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
             .where(~F.array_contains("antecedent", GOOD))
             .select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support"))
    parts = rules.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    wider = (rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(parts, "token")
             .where((F.size("part") < F.size("tokens")) & (F.col("part_confidence") >= F.col("confidence"))
                    & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct())
    return rules.join(wider, "tokens", "left_anti")


def rule_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rules under their rarest token among the labelled urls."""
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return (rules.withColumn("token", F.explode("tokens")).join(often, "token")
            .groupBy(F.col("tokens").alias("rule_tokens"))
            .agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("confidence").alias("confidence"),
                 F.first("support").alias("support")))


def filter_urls(pages: DataFrame, labels: DataFrame | None, id_col: str = "page_id", url_col: str = "url", *,
                rules: list[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Judge every url. ``labels``: (url, bad), any url may be labelled; None or empty: no mined rules.

    Returns one row per input row: page_id, host, path, rule (the fixed rule, or null),
    verdict (the fixed rule's; else block if a mined rule fits, or allow), confidence and
    tokens of the surest mined rule (null: none fits). A null url, or one without ``://``,
    has an empty host and path, no tokens, and is allowed. Repeated rows are judged alike.
    Ties between mined rules go to the larger support, then to the tokens' order. An empty
    table gives no rows. Other columns are not read."""
    url = F.col("url")
    host, path = url_parts(url)
    rule, says = fixed_rule(F.col("host"), F.col("path"), rules)
    tokens = url_tokens(url, F.col("host"), F.col("path"))

    def tokenised(df):
        return df.withColumn("host", host).withColumn("path", path).withColumn("tokens", tokens)

    rows = tokenised(pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    if labels is None:
        index = rows.limit(0).select(F.col("tokens").alias("rule_tokens"), F.lit("").alias("token"),
                                     F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    else:
        known = tokenised(labels.select(F.col("url"), F.col("bad").cast("boolean").alias("bad")))
        index = rule_index(mine_rules(known, min_support=min_support, min_confidence=min_confidence, min_lift=min_lift),
                           known.where("bad is not null"))
    met = (rows.withColumn("token", F.explode_outer("tokens")).join(index, "token", "left")
           .withColumn("fits", F.when(F.size(F.array_except("rule_tokens", "tokens")) == 0,
                                      F.struct("confidence", "support", "rule_tokens"))))
    best = met.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max("fits").alias("best"))
    return best.select("page_id", "host", "path", rule.alias("rule"),
                       F.coalesce(says, F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                       F.col("best.confidence").alias("confidence"), F.col("best.rule_tokens").alias("tokens"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose document, the number that ends the url's path, has labels:
    bad is one of low quality or toxic."""
    path = url_parts(F.col("url"))[1]
    doc = F.regexp_extract(path, "/([0-9]{1,18})(?:[.][a-z]+)?/?$", 1)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return (pages.select("url", F.when(doc != "", doc).cast("long").alias("doc_id")).join(known, "doc_id").select("url", "bad"))
