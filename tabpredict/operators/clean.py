"""Cleaning and encoding: flags, sentinels, text slices, ordinal codes,
null fill, casts, column drops and moves. All are projections except the
ordinal encoder, which numbers the distinct values and joins their codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import flag, str_prefix, str_suffix
from ..session import materialize


def encode_flags(df: DataFrame, positives: Mapping[str, str]) -> DataFrame:
    """{column: positive word} -> 1 where equal, else 0 (null included).
    All flags go into one projection."""
    return df.withColumns({c: flag(c, pos) for c, pos in positives.items()})


def replace_sentinel(df: DataFrame, col: str, sentinel: str = "Unknown",
                     value: str = "0") -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == F.lit(sentinel), F.lit(value))
                         .otherwise(F.col(col)))


def add_suffix(df: DataFrame, src: str, out: str, n: int = 3) -> DataFrame:
    return df.withColumn(out, str_suffix(src, n))


def keep_prefix(df: DataFrame, col: str, n: int = 1) -> DataFrame:
    return df.withColumn(col, str_prefix(col, n))


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): codes 0..k-1 of the column's distinct values in ascending text
    order. The distinct values are dealt out by ranges, written once (ranges come from a
    sample and must not change between uses) and numbered within their range, after the
    sizes of the ranges before it; nothing goes to the driver."""
    values = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    dealt = materialize(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "codes")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))    # a row a range
    nth = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return dealt.join(offsets, "part").select("value", (F.col("before") + nth - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str], codes: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Columns replaced by their codes: those of ``df`` itself, or of given code
    tables (a fitted encoding). A null or a value without a code raises."""
    for c in cols:
        table = (codes or {}).get(c)
        table = (label_codes(df, c) if table is None else table).toDF("__value", "__code")
        unknown = F.raise_error(F.concat(F.lit(f"no code in {c} for "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        df = (df.join(table, df[c] == F.col("__value"), "left")
              .withColumn(c, F.coalesce("__code", unknown.cast("int"))).select(*df.columns))
    return df


def fill_nulls(df: DataFrame, number=0, text: str = "0") -> DataFrame:
    """Nulls -> ``number`` in numeric columns and ``text`` in string columns
    (``fillna(0)`` alone leaves strings null)."""
    return df.fillna(number).fillna(text)


def cast_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> bigint; with ANSI mode on, bad text fails the job."""
    return df.withColumns({c: F.col(c).cast(T.LongType()) for c in cols})


def drop_by_ordinal(df: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    return df.drop(*[df.columns[i] for i in ordinals])


def move_to_end(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, *cols)


# Positive words of the raw flag columns.
RAW_FLAGS = {"churn": "Yes", "has_credit_card": "Yes", "homeownership": "Known"}
RAW_CODED = ["occupation"]


def clean_raw(df: DataFrame) -> DataFrame:
    """The whole cleaning chain on ``raw_obs``: flags, area code from the
    last three characters of the service area, sentinel -> 0, first digit
    of the rating, ordinal codes, null fill, casts, then drop the id and the
    service area by position."""
    d = encode_flags(df, RAW_FLAGS)
    d = add_suffix(d, "service_area", "area_code", 3)
    d = replace_sentinel(d, "handset_price")
    d = keep_prefix(d, "credit_rating", 1)
    d = label_encode(d, RAW_CODED)
    d = fill_nulls(d)
    d = cast_int(d, ["handset_price", "credit_rating", "area_code"])
    return drop_by_ordinal(d, [0, d.columns.index("service_area")])
