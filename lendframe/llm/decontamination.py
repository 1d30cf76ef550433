"""Benchmark decontamination by winnowing.

Every window of `window` words is represented by its smallest k-gram hash. Documents and benchmark
items that share a window share that fingerprint, so one join on fingerprints finds every document
that may hold one; only these documents are read again, and their windows around the fingerprints
are compared on 128 bits. Items shorter than a window are looked up whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import KEY, batch_of, keyed, mapped, same_row, signed, text_blocks, written

WINDOW, GRAM = 10, 5


def _anchors(w: W.Words, window: int, gram: int) -> np.ndarray:
    """Word positions of the winnowed k-grams."""
    starts, g = w.starts_of(window), w.grams(gram)
    if not len(starts):
        return starts
    return np.unique(W.sliding_argmin(g, window - gram + 1)[starts])


def _fingerprints(window: int, gram: int, short: list[int]):
    def run(batches):
        for rows, w in text_blocks(batches, W.alphanumeric()):
            g, at = w.grams(gram), _anchors(w, window, gram)
            found = [(at, g[at], 0)]
            for n in short:
                whole = w.starts_of(n)
                found.append((whole, w.grams(n)[whole], n))
            place = np.concatenate([x[0] for x in found])
            owner = np.searchsorted(w.first, place, "right") - 1
            n = rows.num_rows
            take = pa.array(np.concatenate([owner, np.arange(n)]))
            doc, th = rows.column("doc_id").take(take), rows.column("th").take(take)
            spread = W.mix(rows.column("th").to_numpy().view(np.uint64))
            yield batch_of(
                doc_id=doc, th=th,
                hash=signed(np.concatenate([*(x[1] for x in found), spread])),
                pos=signed(np.concatenate([place - w.first[owner], np.full(n, -1)])),
                size=signed(np.concatenate([*(np.full(len(x[0]), x[2]) for x in found), w.counts])))
    return run


def _item_prints(window: int, gram: int):
    """Each item's windows with the fingerprint of each; an item of fewer words is one window."""
    def run(batches):
        for rows, w in text_blocks(batches, W.alphanumeric()):
            starts = w.starts_of(window)
            long = (starts, np.full(len(starts), window), w.grams(window)[starts] if len(starts) else starts,
                    w.grams(window, True)[starts] if len(starts) else starts,
                    w.grams(gram)[W.sliding_argmin(w.grams(gram), window - gram + 1)[starts]] if len(starts) else starts)
            parts = [long]
            for n in range(1, window):
                at = w.first[:-1][w.counts == n]
                if len(at):
                    parts.append((at, np.full(len(at), n), w.grams(n)[at], w.grams(n, True)[at], w.grams(n)[at]))
            place = np.concatenate([p[0] for p in parts])
            owner = pa.array(np.searchsorted(w.first, place, "right") - 1)
            size, h1, h2, fp = (np.concatenate([p[i].astype(np.uint64) for p in parts]) for i in (1, 2, 3, 4))
            yield batch_of(item=rows.column("item").take(owner), size=signed(size), h1=signed(h1), h2=signed(h2),
                           hash=signed(fp))
    return run


def _windows(window: int, gram: int):
    """The windows of a document that hold one of its matched fingerprints."""
    def run(batches):
        for rows, w in text_blocks(batches, W.alphanumeric()):
            marks = rows.column("marks")
            flat = marks.flatten()
            pos, size = (flat.field(n).to_numpy() for n in ("pos", "size"))
            owner = np.repeat(np.arange(rows.num_rows), marks.value_lengths().to_numpy())
            near = np.flatnonzero(size == 0)
            reach = np.arange(window - gram + 1)
            begin = (pos[near, None] - reach).ravel()
            of = np.repeat(owner[near], len(reach))
            fits = (begin >= 0) & (begin + window <= w.counts[of])
            pairs = np.unique(np.stack([of[fits], begin[fits]]), axis=1)
            found = [(pairs[0], pairs[1], window)]
            found += [(owner[size == n], pos[size == n], n) for n in np.unique(size[size > 0])]
            for of, begin, n in found:
                at = w.first[of] + begin
                if len(at):
                    take = pa.array(of)
                    yield batch_of(doc_id=rows.column("doc_id").take(take), th=rows.column("th").take(take),
                                   start=signed(begin), size=signed(np.full(len(at), n)),
                                   h1=signed(w.grams(int(n))[at]), h2=signed(w.grams(int(n), True)[at]))
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  gram: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, th, n_words, n_hit, items (sorted text ids), spans.

    `spans` are the (start, size) word windows that occur in an item. Words are lower-cased runs of
    digits, letters and non-ASCII characters of the whole text. A null or empty text has no words and
    no hits; items without words or without id never match; repeated rows get the same answer; an
    empty benchmark marks nothing. Every shared span of `window` words is found.
    """
    k = window - gram + 1
    if k < 1:
        raise ValueError("a window must hold a gram")
    rows = keyed(docs, id_col, text_col)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"),
                             benchmark[item_text_col].cast("string").alias("text")).where("item IS NOT NULL")
    prints = written(mapped(items, _item_prints(window, gram), "item string, size long, h1 long, h2 long, hash long"),
                     "bench-prints")
    short = [r[0] for r in prints.where(F.col("size") < window).select("size").distinct().collect()]  # under `window`
    wanted = prints.select("hash").distinct().withColumn("found", F.lit(True))
    marks = mapped(rows, _fingerprints(window, gram, short), "doc_id long, th long, hash long, pos long, size long")
    marks = written(marks.join(wanted, "hash", "left").where("found OR pos < 0")
                    .select("doc_id", "th", "pos", "size"), "doc-prints")

    near = marks.where("pos >= 0").groupBy(*KEY).agg(F.collect_set(F.struct("pos", "size")).alias("marks"))
    near = near.withColumnsRenamed({"doc_id": "n_doc", "th": "n_th"})
    once = rows.join(near, rows["doc_id"].eqNullSafe(near["n_doc"]) & (rows["th"] == near["n_th"]))
    windows = mapped(once.select("doc_id", "th", "text", "marks"), _windows(window, gram),
                     "doc_id long, th long, start long, size long, h1 long, h2 long")
    of_window = prints.groupBy("h1", "h2", "size").agg(F.collect_set("item").alias("of"))
    hits = windows.join(of_window, ["h1", "h2", "size"])
    merged = hits.groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, s):
        end = s["start"] + s["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"),
                        F.greatest(acc["end"], end).alias("end"))

    merged = merged.withColumn("n_hit", F.aggregate("spans", zero, add, lambda a: a["n"]))
    all_rows = marks.where("pos < 0").select("doc_id", "th", F.col("size").alias("n_words"))
    m = merged.withColumnsRenamed({"doc_id": "n_doc", "th": "n_th"})
    return all_rows.join(m, all_rows["doc_id"].eqNullSafe(m["n_doc"]) & (all_rows["th"] == m["n_th"]), "left").select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,size:bigint>>")).alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The document rows without a benchmark window; all their columns stay as they were."""
    bad = contamination(docs, benchmark, id_col, text_col).where("n_hit > 0").select(
        F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_th")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_bad_id"])
                     & (F.xxhash64(text) == bad["_bad_th"]), "left_anti")
