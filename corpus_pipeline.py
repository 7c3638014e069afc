"""Corpus pipeline over ``documents``: quality, near copies, repeated passages, test items, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which ``run`` writes as parquet and reads again. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabpredict.llm.common import written
from tabpredict.llm.decontaminate import decontaminate
from tabpredict.llm.jaccard_join import jaccard_join
from tabpredict.llm.packing import pack
from tabpredict.llm.quality import META_COLS, accepted, good_label, train_quality
from tabpredict.llm.suffix_dedup import suffix_dedup

#: A trained classifier, byte cuts and a packing search have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _same(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join documents by id and text, a null id like any other. ``keys``: doc_id, text_key."""
    keys = keys.toDF("key_id", "key_text")
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["key_id"]) & (F.xxhash64(docs["text"]) == keys["key_text"]), how)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    labels = _table(spark, sf_dir, "labels")
    return accepted(docs, train_quality(docs, labels, META_COLS, good_label()), META_COLS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays; of rows repeated with
    their id, one. Texts without words stay."""
    found = jaccard_join(docs)
    gone = found.where("not stands").select("doc_id", "text_key").distinct()
    again = found.where("stands").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    again = written(again, "repeated")
    kept = _same(docs, written(gone.union(again), "gone"), "left_anti")
    if again.isEmpty():
        return kept
    once = _same(docs, again, "left_semi").withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"])
    return kept.union(once.select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 100 bytes that occur earlier out of the texts; a text of which nothing
    is left goes. A character cut in half goes too; n_chars follows the text. A text that
    was empty before stays, as null."""
    found = suffix_dedup(docs, carry=True).where("n_removed = 0 or n_removed < n_bytes")
    def column(name):
        if name == "doc_id":
            return F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(name)
        if name == "text":
            return F.when(F.col("n_bytes") > 0, F.col("kept_text")).alias(name)
        if name == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars")).cast(docs.schema[name].dataType).alias(name)
        return F.col(f"rest.`{name}`").alias(name)

    return found.select(*[column(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which test items make up a twentieth."""
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("contaminated")
    return _same(docs, written(found.select("doc_id", "text_key").distinct(), "contaminated"), "left_anti")


def fill_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", judge), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", fill_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
