"""CSV and Parquet tables, frozen splits, score files and JSON artefacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType)

from lendframe.functions.hashing import seeded_hash
from lendframe.functions.nulls import null_clean

WHOLE = (ByteType, ShortType, IntegerType, LongType)
# The eight input tables and their CSV files
CSV_FILES = {
    "application_train": "application_train.csv",
    "application_test": "application_test.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "previous_application": "previous_application.csv",
    "pos_cash_balance": "POS_CASH_balance.csv",
    "installments_payments": "installments_payments.csv",
    "credit_card_balance": "credit_card_balance.csv",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Works for any file system Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a schema the file is read once; without one Spark infers it in an extra pass."""
    reader = spark.read.option("header", True)
    return null_clean(reader.schema(schema).csv(path) if schema else
                      reader.option("inferSchema", True).csv(path))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def narrowest(low, high) -> str:
    """Smallest whole-number type that holds both ends; an empty column stays a byte."""
    for bits, name in ((8, "tinyint"), (16, "smallint"), (32, "int")):
        if low is None or (-(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1)):
            return name
    return "bigint"


def narrow_types(df: DataFrame) -> dict[str, str]:
    """{column: type}: whole numbers get the narrowest type, doubles become float, text stays."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, WHOLE)]
    ends = df.agg(*[x for c in whole for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first() if whole else {}
    out = {c: narrowest(ends[f"lo_{c}"], ends[f"hi_{c}"]) for c in whole}
    out.update({f.name: "float" for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))})
    return out


def shrink(df: DataFrame) -> DataFrame:
    """One min/max pass, then casts."""
    types = narrow_types(df)
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def convert_all(spark: SparkSession, raw_dir: str, out_dir: str, files: dict[str, str] | None = None,
                schemas: dict | None = None, force: bool = False) -> list[str]:
    """CSV -> narrow Parquet, table by table; tables that exist are skipped unless forced."""
    written = []
    for name, csv in (files or CSV_FILES).items():
        target = f"{out_dir}/{name}"
        if exists(spark, target) and not force:
            continue
        shrink(read_csv(spark, f"{raw_dir}/{csv}", (schemas or {}).get(name))).write.mode("overwrite").parquet(target)
        written.append(name)
    return written


def cast_like(df: DataFrame, stored: StructType) -> DataFrame:
    """Columns in the stored types; a column with missing values in a whole-number type is kept as NULL."""
    types = {f.name: f.dataType for f in stored.fields}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def write_frozen(df: DataFrame, path: str, force: bool = False) -> bool:
    """Writes once; an existing table stays as it is unless forced. True when written."""
    if exists(df.sparkSession, path) and not force:
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_scores(df: DataFrame, path: str, model: str) -> None:
    """Out-of-fold scores, one partition per model."""
    target = f"{path}/model={model}"
    df.drop("model").write.mode("overwrite").parquet(target)


def load_scores(spark: SparkSession, path: str, model: str, ids: DataFrame | None = None,
                key: str = "id") -> DataFrame:
    """Stored scores, by id order when a table of ids is given; ids without a score are an error."""
    scores = spark.read.parquet(f"{path}/model={model}")
    if ids is None:
        return scores
    joined = ids.select(key).join(scores, on=key, how="left")
    if joined.where("p IS NULL").limit(1).count():
        raise ValueError(f"stored scores of {model} do not cover the ids")
    return joined.orderBy(key)


def run_or_load(spark: SparkSession, path: str, model: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Stored scores when present, else computed and stored."""
    if not exists(spark, f"{path}/model={model}"):
        write_scores(make(), path, model)
    return load_scores(spark, path, model)


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, values: dict, path: str, sort: bool = True) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=sort),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def demo_bundle(features: DataFrame, raw: DataFrame, n: int = 1000, seed=42, key: str = "SK_ID_CURR") -> DataFrame:
    """n unlabelled applicants with features and raw columns (prefix RAW__), by id.

    n is the size of the bundle itself; the ids are the first n in hash order.
    """
    chosen = (features.where("is_test = 1").select(key)
              .orderBy(seeded_hash(F.col(key), seed), key).limit(n))
    named = raw.join(chosen, on=key, how="left_semi").withColumnsRenamed(
        {c: f"RAW__{c}" for c in raw.columns if c != key})
    return named.join(features.join(chosen, on=key, how="left_semi"), on=key).orderBy(key)
