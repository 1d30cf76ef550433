"""Exact removal of repeated passages: seeds by winnowing, extended both ways.

The smallest k-gram hash of every window of `window` words is its seed. Neighbouring windows with
the same seed form a segment: the widest extension of that seed to both sides that the windows
allow. Equal windows have equal seeds at equal places, so

* of the occurrences of one segment all but the first are repeats as a whole;
* first occurrences of different segments on one seed may share some windows; only these are
  extended window by window.

A task first settles equal segments among its own documents and passes on one row for each, so a
passage that a third of the documents hold is a few rows per task when it is shuffled. No pairs are
made: the longest matches come out as unions of windows that start earlier elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import batch_of, keyed, mapped, signed, text_blocks, written

WINDOW, GRAM = 20, 5
_SEGMENT = "seed long, content long, doc_id long, th long, start long, size int, settled boolean"
_FOUND = "doc_id long, th long, start long, size int, settled boolean"


def _segments(window: int, gram: int):
    def run(batches):
        for rows, w in text_blocks(batches, W.spaced()):
            starts, grams = w.starts_of(window), w.grams(gram)
            if not len(starts):
                continue
            seed = W.sliding_argmin(grams, window - gram + 1)[starts]
            owner = np.searchsorted(w.first, starts, "right") - 1
            new = np.ones(len(starts), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            begin = starts[at]
            size = np.diff(np.append(at, len(starts))) + window - 1
            content = W.mix(W._spans(w.hash, begin, begin + size, W._BASE) + size.astype(np.uint64))
            seeds = grams[seed[at]]
            owner = owner[at]
            ids = rows.column("doc_id").take(pa.array(owner))
            order_id = ids.fill_null(-(1 << 63)).to_numpy()
            th = rows.column("th").to_numpy()[owner]
            place = begin - w.first[owner]
            order = np.lexsort((place, th, order_id, content, seeds))
            same = np.zeros(len(order), bool)
            same[1:] = _as_before(order, seeds, content)
            again = np.zeros(len(order), bool)
            again[1:] = same[1:] & _as_before(order, order_id, th, place)  # a repeated row, no copy
            settled = np.zeros(len(order), bool)
            settled[order] = same
            once = np.ones(len(order), bool)
            once[order] = ~again
            at = np.flatnonzero(once)
            seeds, content, settled, begin, place = seeds[at], content[at], settled[at], begin[at], place[at]
            ids, th, size = ids.take(pa.array(at)), th[at], size[at]
            # a settled row only travels; it is spread evenly
            seeds = np.where(settled, W.mix(content + begin.astype(np.uint64)), seeds)
            yield batch_of(seed=signed(seeds), content=signed(content), doc_id=ids, th=pa.array(th, pa.int64()),
                           start=signed(place), size=pa.array(size.astype(np.int32)), settled=pa.array(settled))
    return run


def _as_before(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(order) - 1, bool)
    for c in columns:
        c = c[order]
        out &= c[1:] == c[:-1]
    return out


def _settle(batches):
    """Rows sorted by seed, content and place: repeats of a segment, and first ones that share a seed."""
    last = None  # seed, content and place of the row before
    pending = None  # the first row of its seed, if that is still alone
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keep = np.zeros(n, bool)
        done = batch.column("settled").to_numpy(zero_copy_only=False).copy()
        seed, content = batch.column("seed").to_numpy(), batch.column("content").to_numpy()
        places = (batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(), batch.column("th").to_numpy(),
                  batch.column("start").to_numpy())
        keep |= done
        live = np.flatnonzero(~done)
        if len(live):
            s, c = seed[live], content[live]
            new_seed, new_content = np.ones(len(live), bool), np.ones(len(live), bool)
            new_seed[1:] = s[1:] != s[:-1]
            new_content[1:] = new_seed[1:] | (c[1:] != c[:-1])
            if last is not None and last[0] == s[0]:
                new_seed[0] = False
                new_content[0] = last[1] != c[0]
            again = np.zeros(len(live), bool)
            again[1:] = ~new_content[1:] & _as_before(live, *places)
            again[0] = not new_content[0] and last is not None and last[2:] == tuple(p[live[0]] for p in places)
            repeat = ~new_content & ~again
            done[live[repeat]] = True
            keep[live[repeat]] = True
            group = np.cumsum(new_seed)
            other = new_content & ~new_seed  # a further segment on a seed
            keep[live[other]] = True
            shared = np.zeros(group[-1] + 1, bool)
            shared[group[other]] = True
            keep[live[new_seed & shared[group]]] = True
            if pending is not None and (shared[0] or not (group == 0).all()):
                if shared[0]:
                    yield pending
                pending = None
            if new_seed.any():
                g = group[-1]
                if not shared[g]:
                    k = live[np.flatnonzero(new_seed)[-1]]
                    pending = _narrow(batch.slice(k, 1), done[k : k + 1])
            last = (s[-1], c[-1], *(p[live[-1]] for p in places))
        at = np.flatnonzero(keep)
        if len(at):
            yield _narrow(batch.take(pa.array(at)), done[at])


def _narrow(rows: pa.RecordBatch, settled: np.ndarray) -> pa.RecordBatch:
    return batch_of(doc_id=rows.column("doc_id"), th=rows.column("th"), start=rows.column("start"),
                    size=rows.column("size"), settled=pa.array(settled))


def _windows(window: int):
    def run(batches):
        for rows, w in text_blocks(batches, W.spaced()):
            marks = rows.column("marks")
            flat = marks.flatten()
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            owner = np.repeat(np.arange(rows.num_rows), marks.value_lengths().to_numpy())
            many = size - window + 1
            owner, begin = np.repeat(owner, many), np.repeat(start, many)
            begin = begin + np.arange(len(begin)) - np.repeat(np.cumsum(many) - many, many)
            at = w.first[owner] + begin
            take = pa.array(owner)
            yield batch_of(h1=signed(w.grams(window)[at]), h2=signed(w.grams(window, True)[at]),
                           doc_id=rows.column("doc_id").take(take), th=rows.column("th").take(take),
                           start=signed(begin))
    return run


def _cut(batches):
    for rows, w in text_blocks(batches, W.spaced()):
        marks = rows.column("marks")
        flat, many = marks.flatten(), marks.value_lengths().fill_null(0).to_numpy()
        owner = np.repeat(np.arange(rows.num_rows), many)
        begin = w.first[owner] + flat.field("start").to_numpy()
        change = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + flat.field("size").to_numpy(), -1)
        gone = np.cumsum(change[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        kept = np.flatnonzero(~gone)
        of = np.searchsorted(w.first, kept, "right") - 1
        lead = np.zeros(len(kept), bool)
        lead[1:] = of[1:] == of[:-1]  # one blank before every kept word but a text's first
        edge = np.zeros(len(w.data) + 1, np.int8)
        edge[w.start[kept] - lead] += 1
        np.add.at(edge, w.end[kept], -1)
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        content = w.data.copy()
        content[w.start[kept[lead]] - 1] = 0x20
        content = content[inside]
        width = np.bincount(of, (w.end - w.start)[kept] + lead, rows.num_rows).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(rows.num_rows, pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int64)),
                                                 pa.py_buffer(content)).cast(pa.string())
        new = gone.copy()
        new[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), w.first)
        stop = gone.copy()
        stop[:-1] &= ~gone[1:] | np.isin(np.arange(1, len(gone)), w.first)
        a, b = np.flatnonzero(new), np.flatnonzero(stop) + 1
        doc = np.searchsorted(w.first, a, "right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows.num_rows))]).astype(np.int32)),
            pa.StructArray.from_arrays([signed(a - w.first[doc]), signed(b - a)], names=["start", "size"]))
        yield batch_of(doc_id=rows.column("doc_id"), n_words=signed(w.counts),
                       n_removed=signed(sums[w.first[1:]] - sums[w.first[:-1]]), text=texts, spans=spans)


def _beside(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    m = marks.withColumnsRenamed({"doc_id": "m_doc", "th": "m_th"})
    return docs.join(m, docs["doc_id"].eqNullSafe(m["m_doc"]) & (docs["th"] == m["m_th"]), how).select(
        "doc_id", "th", "text", "marks")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, text (kept words), spans (removed runs).

    A word goes when it lies in `window` consecutive words that also start earlier: in a document
    with a smaller id, or earlier in the same one. Documents with one id are ordered by a hash of
    their text; a null id is the smallest; rows repeated with id and text are one document and get
    one answer. A null or empty text has no words and stays empty.
    """
    rows = keyed(docs, id_col, text_col)
    segments = mapped(rows, _segments(window, gram), _SEGMENT)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = segments.repartition(parts, "seed").sortWithinPartitions("seed", "content", "doc_id", "th", "start")
    found = written(mapped(lined, _settle, _FOUND), "segments")

    open_ = found.where("NOT settled").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "size")).alias("marks"))
    windows = mapped(_beside(rows, open_, "inner"), _windows(window), "h1 long, h2 long, doc_id long, th long, start long")
    windows = written(windows, "windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "start")).alias("first"),
                                            F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(
        ~F.struct("doc_id", "th", "start").eqNullSafe(F.col("first"))).select(
        "doc_id", "th", "start", F.lit(window).alias("size"))
    gone = found.where("settled").drop("settled").unionByName(later)
    marks = gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "size")).alias("marks"))
    return mapped(_beside(rows, marks, "left"), _cut,
                  "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:long,size:long>>")
