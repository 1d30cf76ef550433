"""Fill-in-the-middle documents, cut on a byte array with a sparse index of its multibyte characters.

A unit is a run of the letters A-Z and a-z or one other character. Of every block of texts only the
places of multibyte characters and their excess bytes are recorded: a byte place becomes a character
place, or the other way round, by one binary search, and between two exceptions by plain arithmetic.
The n-th unit is found from counts per stretch of bytes, so no list of all units is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import batch_of, mapped

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in per cent: documents left as they are, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = "1:"
_STRETCH = 1 << 12


@dataclass
class Exceptions:
    """The multibyte characters of a byte array: first byte and number of bytes beyond one, summed up to it."""

    place: np.ndarray
    excess: np.ndarray  # one more than places: bytes in excess before each of them, and in all

    @staticmethod
    def of(data: np.ndarray) -> "Exceptions":
        place = np.flatnonzero(data >= 0xC0)
        lead = data[place]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        return Exceptions(place, np.concatenate([[0], np.cumsum(more)]))

    def characters(self, byte: np.ndarray) -> np.ndarray:
        """Characters before a byte place that is a border between characters."""
        return byte - self.excess[np.searchsorted(self.place, byte)]

    def bytes(self, character: np.ndarray) -> np.ndarray:
        """The byte place of a character place."""
        return character + self.excess[np.searchsorted(self.place - self.excess[:-1], character)]


class Units:
    """Numbers the units of texts that lie one after another, and finds where one begins."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        lower = data | 0x20
        letter = (lower >= 0x61) & (lower <= 0x7A)
        self.starts = (data & 0xC0) != 0x80
        self.starts[1:] &= ~(letter[1:] & letter[:-1])
        self.starts[bounds[:-1][np.diff(bounds) > 0]] = True
        self.size = len(data)
        heads = np.arange(0, max(len(data), 1), _STRETCH)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(self.starts, heads, dtype=np.int64))]) if len(data) else np.zeros(1, np.int64)

    def number(self, byte: int) -> int:
        """Units that begin before a byte place."""
        s = byte // _STRETCH
        return int(self.before[min(s, len(self.before) - 1)] + np.count_nonzero(self.starts[s * _STRETCH : byte]))

    def begin(self, n: int) -> int:
        """Where unit n begins; behind the last one, the end."""
        if n >= self.before[-1]:
            return self.size
        s = int(np.searchsorted(self.before, n, "right")) - 1
        return s * _STRETCH + int(np.flatnonzero(self.starts[s * _STRETCH : (s + 1) * _STRETCH])[n - self.before[s]])


def _ordered(text: bytes, one: int, two: int, form: str, markers: tuple[bytes, bytes, bytes]) -> bytes:
    """The output for a text that is cut at two byte places."""
    p, s, m = markers
    if form == "plain":
        return text
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    return b"".join([s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle])


def _arranged(markers: tuple[str, str, str], plain: int, suffix_first: int):
    signs = tuple(x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in W.blocks(batch.column("text")):
                units, odd = Units(data, bounds), Exceptions.of(data)
                h = [batch.column(f"h{k}").slice(a, b - a).to_numpy() for k in (1, 2, 3, 4)]
                first = np.array([units.number(x) for x in bounds.tolist()])
                n = np.diff(first)
                cuts = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
                one, two = (np.array([units.begin(x) for x in (first[:-1] + c).tolist()]) for c in cuts)
                at = odd.characters(np.stack([bounds[:-1], one, two]))
                forms, outputs = [], []
                for i, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    text = data[begin:end].tobytes()
                    whole = not text or h[2][i] % 100 >= 100 - plain or any(x in text for x in signs)
                    forms.append("plain" if whole else "spm" if h[3][i] % 100 < suffix_first else "psm")
                    outputs.append(_ordered(text, one[i] - begin, two[i] - begin, forms[-1], signs))
                whole = np.array([f == "plain" for f in forms], bool)
                yield batch_of(doc_id=batch.column("doc_id").slice(a, b - a), n=pa.array(n, pa.int64()), form=pa.array(forms, pa.string()),
                               prefix_chars=pa.array(at[1] - at[0], pa.int64(), mask=whole),
                               middle_chars=pa.array(at[2] - at[1], pa.int64(), mask=whole),
                               output=pa.array(outputs, pa.binary()).cast(pa.string()))
    return run


def _from_cuts(markers: tuple[str, str, str]):
    signs = tuple(x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in W.blocks(batch.column("text")):
                part, odd = batch.slice(a, b - a), Exceptions.of(data)
                forms = part.column("form").to_pylist()
                counts = [part.column(c).fill_null(0).to_numpy() for c in ("prefix_chars", "middle_chars")]
                start = odd.characters(bounds[:-1])
                one, two = odd.bytes(start + counts[0]), odd.bytes(start + counts[0] + counts[1])
                outputs = [_ordered(data[x:y].tobytes(), i - x, j - x, f, signs)
                           for x, y, i, j, f in zip(bounds[:-1].tolist(), bounds[1:].tolist(), one.tolist(), two.tolist(), forms)]
                yield batch_of(doc_id=part.column("doc_id"), output=pa.array(outputs, pa.binary()).cast(pa.string()))
    return run


def from_cuts(cuts: DataFrame, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id and output for rows of doc_id, text, form, prefix_chars, middle_chars: what `arranged` gave,
    for a table that stores the cuts but not the outputs. Null texts are empty, null forms are plain."""
    rows = cuts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("form", F.lit("plain")).alias("form"),
                       "prefix_chars", "middle_chars")
    return mapped(rows, _from_cuts(markers), "doc_id long, output string")


def arranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
             markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output: one row per row of `docs`.

    Cuts and form follow from the hash of seed and id, so repeated rows and runs give the same. Forms:
    plain (the text; both counts null), psm, spm. Empty texts and texts that hold a marker are plain. A
    null text is an empty one; a null id hashes like an empty one. Other columns are not read. No rows
    give no rows. A very long text is one block: a few bytes of memory for each of its bytes.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(docs[id_col].cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    groups = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *groups)
    return mapped(rows, _arranged(markers, plain, suffix_first),
                  "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text of an output: a marker is found at its first occurrence, as no part holds one and
    none overlaps a marker."""
    p, s, m = (F.lit(x) for x in markers)

    def parts(one: Column, two: Column) -> tuple[Column, Column, Column]:
        """What stands behind the first, the second and the third marker."""
        at, end = F.instr(output, two), F.instr(output, m)
        return (F.substring(output, F.length(one) + 1, at - F.length(one) - 1),
                F.substring(output, at + F.length(two), end - at - F.length(two)),
                F.substring(output, end + F.length(m), F.length(output)))

    prefix, suffix, middle = parts(p, s)
    later, earlier, last = parts(s, p)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(earlier, last, later)).otherwise(output))
