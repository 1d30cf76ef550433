"""What the operators share: document rows under fixed names, tables that cut lineage, batches for kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.session import fresh_folder

#: A document row is told apart by its id and the hash of its text, so that ids may repeat or be null.
KEY = ["doc_id", "th"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the session's shared folder and read again: later steps survive lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, text only; a null text is an empty one. Other columns can't clash with inner names."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """The documents as they are, and the hash that `keyed` gives to a row."""
    return docs, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))


def text_blocks(batches: Iterator[pa.RecordBatch], kind, column: str = "text"
                ) -> Iterator[tuple[pa.RecordBatch, W.Words]]:
    """Slices of the batches with the words of their texts, a few MB at a time."""
    for batch in batches:
        for a, b, data, bounds in W.blocks(batch.column(column)):
            yield batch.slice(a, b - a), W.find(data, bounds, kind)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def mapped(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(kernel, schema)
