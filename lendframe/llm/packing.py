"""Packing documents into token sequences along a Hilbert curve.

Texts are tokenised once. The mean of fixed random vectors of a document's tokens places it in a
few dimensions; a range sort by its place on the Hilbert curve brings similar documents together.
Tokens are numbered along the curve - within a sorted part by a running sum, between parts by the
sums of the parts - and cut every `size` tokens, so all sequences but the last are full.
"""

from __future__ import annotations

import math
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import batch_of, keyed, mapped, signed, written

SIZE, END_ID = 4096, 2
DIMENSIONS, BITS = 3, 10
#: Bytes of ids in a part of the curve.
PART = 64 << 20
#: Units whose ids a worker process remembers; only speed depends on it.
REMEMBERED = 600_000
_SPACE = " \t\n\r\f\v"
# A word of Latin letters before punctuation (no apostrophe) that ends at white space, else all up to white space.
# Pre-tokens end at white space and between such a word and such punctuation, so ids never join two units.
_UNIT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-&(-/:-@\[-`{-~]*(?:[%s]|\Z))|[^%s]+" % (_SPACE, _SPACE))
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BLANK = np.isin(np.arange(256), np.frombuffer(_SPACE.encode(), np.uint8))
_CODERS: dict[str, "Coder"] = {}


class Coder:
    """Token ids of texts, unit by unit; a worker process keeps one for all its tasks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        out = {}
        plain = [u for u in units if _PLAIN.fullmatch(u)]
        for a in range(0, len(plain), 50):
            some = plain[a : a + 50]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint16)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):  # one end of word a unit
                blob, begin = ids.tobytes(), 0
                for u, stop in zip(some, (2 * stops).tolist()):
                    out[u] = blob[begin:stop]
                    begin = stop
        rest = [u for u in units if u not in out]
        for u, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            out[u] = np.array(e.ids, np.uint16).tobytes()
        return out

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts that lie one after another in data, each with the end id, and the number of each.

        Words, with the white space behind them, are numbered by Arrow's exact dictionary; only words
        that were not met before are tokenised.
        """
        blank = _BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = blank[:-1] & ~blank[1:]
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        different, known = [c.decode().strip(_SPACE) for c in coded.dictionary.to_pylist()], self.known
        new = set(different).difference(known)
        if new:
            parts = {chunk: _UNIT.findall(chunk) for chunk in new}
            learned = self._learn(list(set(chain.from_iterable(parts.values())).difference(known)))
            for chunk, units in parts.items():
                if chunk not in learned:
                    learned[chunk] = b"".join([learned[u] if u in learned else known[u] for u in units])
            if len(known) < REMEMBERED:
                known.update(learned)
            else:
                self.known = known = {c: learned[c] if c in learned else known[c] for c in different}
        blobs = [known[c] for c in different]
        table = np.frombuffer(b"".join(blobs), np.uint16)
        many = np.array([len(b) // 2 for b in blobs], np.int64)
        code = coded.indices.to_numpy()
        many, begin = many[code], (np.cumsum(many) - many)[code]
        after = np.concatenate([[0], np.cumsum(many)])
        flat = table[np.arange(after[-1]) + np.repeat(begin - after[:-1], many)]
        ends = after[np.searchsorted(starts, bounds)]
        return np.insert(flat, ends[1:], END_ID), np.diff(ends) + 1


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (n x dimensions, each below 2**bits).

    Gray-code form: axes are flipped and swapped from the top bit down, then their bits interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            high = (x[d] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def _tokenised(path: str, dimensions: int, bits: int):
    def run(batches):
        if path not in _CODERS:
            _CODERS[path] = Coder(path)
        coder = _CODERS[path]
        table = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (1 << 16, dimensions))
        for batch in batches:
            for a, b, data, bounds in W.blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                flat, n = coder.ids(data, bounds)
                begin = np.cumsum(n) - n
                mean = np.stack([np.add.reduceat(table[flat, d], begin) for d in range(dimensions)], 1) / np.sqrt(n)[:, None]
                cells = np.clip((mean / 16 + 0.5) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [
                    None, pa.py_buffer(2 * np.append(begin, len(flat))), pa.py_buffer(flat)]).cast(pa.binary())
                yield batch_of(doc_id=part.column("doc_id"), th=part.column("th"), place=signed(hilbert_key(cells, bits)),
                               n=signed(n), ids=ids)
    return run


def _numbered(batches):
    """Rows of one sorted part: how many tokens come before a row."""
    total = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        before = np.cumsum(n) - n + total
        total += int(n.sum())
        yield batch_of(doc_id=batch.column("doc_id"), part=batch.column("part"), n=batch.column("n"),
                       before=signed(before), ids=batch.column("ids"))


def _cut(size: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                n, at = part.column("n").to_numpy(), part.column("at").to_numpy()
                first, last = at // size, (at + n - 1) // size
                many = last - first + 1
                row = np.repeat(np.arange(len(n)), many)
                seq = np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = np.maximum(seq * size - at[row], 0)
                length = np.minimum((seq + 1) * size - at[row], n[row]) - start
                blobs = [np.frombuffer(x.as_py(), np.uint16).astype("<u4") for x in part.column("ids")]
                yield batch_of(doc_id=part.column("doc_id").take(pa.array(row)), start=signed(start),
                               length=signed(length), doc_tokens=signed(n[row]), sequence_id=signed(seq),
                               offset=signed(at[row] + start - seq * size),
                               ids=pa.array([blobs[r][s : s + k].tobytes() for r, s, k in zip(row, start, length)], pa.binary()))
    return run


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32 bits).

    tokenizer: path of a `tokenizers` file with at most 65,536 ids, present on every machine. Each
    document row ends with id 2, so a null or empty text is that id alone. Repeated rows are packed
    as often as they come; rows at one place of the curve are ordered by hashes. No documents: no rows.
    """
    rows = keyed(docs, id_col, text_col)
    # written, as a range sort reads its input twice: once for the borders of the ranges
    ids = written(mapped(rows, _tokenised(tokenizer, DIMENSIONS, BITS), "doc_id long, th long, place long, n long, ids binary"), "ids")
    # as many parts as the ids need, so that a part stays small however many documents there are
    tokens = ids.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * tokens / PART))
    tie = F.xxhash64("doc_id", "th")
    lined = (ids.withColumn("tie", tie).repartitionByRange(parts, "place", "tie").sortWithinPartitions("place", "tie", "doc_id")
             .select("doc_id", F.spark_partition_id().alias("part"), "n", "ids"))
    lined = written(mapped(lined, _numbered, "doc_id long, part int, n long, before long, ids binary"), "curve")
    # one row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = lined.groupBy("part").agg(F.sum("n").alias("sum")).select(
        "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    placed = lined.join(F.broadcast(base), "part").select("doc_id", "n", (F.col("base") + F.col("before")).alias("at"), "ids")
    return mapped(placed, _cut(size), "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
                                      "offset long, ids binary")
