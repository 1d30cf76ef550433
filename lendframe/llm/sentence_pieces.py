"""Encoding with a sentencepiece BPE model through a table of last tokens, and decoding.

The encoding of a text ends with one token only, and what stands before that token is encoded as if
it stood alone. So one token a prefix, its last, says all. An automaton gives the tokens that end at
a place; of these, the last token is the one that may follow the last token of the prefix before it.
Two tokens may follow each other when no merge across their border comes before the merges that
build them. The ids are then read off the table from its end.

A text falls into units between which no token reaches: bytes that are neighbours in no token. Units
are numbered by Arrow's exact dictionary and the table is made once for each different one.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import batch_of, mapped

MARK = "▁"  # stands for a space in the model's pieces
#: Units and token pairs that a worker process remembers; only speed depends on them.
REMEMBERED = 200_000
#: Ids that are turned into bytes together.
IDS_BLOCK = 1 << 20
_MODELS: dict[tuple[str, bool], "Pieces"] = {}


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    """Every byte that is no part of a character becomes a replacement character of its own."""
    return "�", error.start + 1


codecs.register_error("one-by-one", _one_by_one)


class Pieces:
    """A BPE model with byte fallback, read from its file; spaces stand for the model's space marks.

    coding: whether it encodes, too; what only that needs takes most of the memory.
    """

    def __init__(self, path: str, coding: bool = True):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  ﬁＡé\t"  # marks spaces, puts one in front and changes nothing else
        normal = sentencepiece.SentencePieceNormalizer(model_file=path).normalize(probe)
        if normal != (" " + probe).replace(" ", MARK):
            raise ValueError("only models that leave characters as they are and put a space in front")
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.of_byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.of_byte) < 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id = {names[i].replace(MARK, " "): i for i in plain}
        if coding:
            self._learn({p: model.get_score(i) for p, i in self.id.items()})
        # for decoding
        shown = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else names[i].replace(MARK, " ").encode()
                 for i in range(size)]
        for byte, i in self.of_byte.items():
            shown[i] = bytes([byte])
        self.length = np.array([len(s) for s in shown], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.spaced = np.zeros(size, bool)
        self.spaced[[i for p, i in self.id.items() if p.startswith(" ")]] = True

    def _learn(self, score: dict[str, float]) -> None:
        """What encoding needs of the pieces and their scores."""
        import ahocorasick
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in score.items()}
        self._grow_trees()
        self.automaton = ahocorasick.Automaton()
        for p in self.left:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        # neighbours[a, b]: some token of two or more characters has byte b behind byte a
        self.neighbours = np.zeros((256, 256), bool)
        for p in self.id:
            raw = np.frombuffer(p.encode(), np.uint8)
            if len(p) > 1:
                self.neighbours[raw[:-1], raw[1:]] = True
        self.known: dict[bytes, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """The symbols after all merges, best score first and leftmost of equals, and what was merged into what."""
        made = {}
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank),
                       default=None)
            if best is None:
                return symbols, made
            k = best[1]
            made[symbols[k] + symbols[k + 1]] = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def _grow_trees(self) -> None:
        """For each token that a text can have: the tokens along its left and its right edge, with ranks, from itself down.

        Tokens in `uneven` have a merge of the same score as another token's, or a part that is merged
        after the whole; for them the order of merges isn't that of the ranks.
        """
        shared: dict[int, int] = {}
        for r in self.rank.values():
            shared[r] = shared.get(r, 0) + 1
        self.left, self.right, self.uneven = {}, {}, set()
        for p in self.id:
            symbols, made = self.merged(list(p))
            if len(symbols) > 1:
                continue  # never the result of its own merges
            for edge, side in ((self.left, 0), (self.right, 1)):
                x, chain = p, []
                while x in made:
                    chain.append((x, self.rank[x]))
                    x = made[x][side]
                edge[p] = [*chain, (x, -1)]
            if any(shared[self.rank[x]] > 1 or max((self.rank[y] for y in parts if y in made), default=-1) >= self.rank[x]
                   for x, parts in made.items()):
                self.uneven.add(p)

    def may_follow(self, a: str, b: str) -> bool:
        """Are a and b the tokens of a + b? Their last merges are undone one by one, newest first; a merge
        across the border that comes before the last one undone would have joined them."""
        if a in self.uneven or b in self.uneven:
            return self.merged(list(a + b))[0] == [a, b]
        xs, ys, i, j, before = self.right[a], self.left[b], 0, 0, len(self.rank) + 1
        while True:
            (x, when_x), (y, when_y) = xs[i], ys[j]
            if self.rank.get(x + y, before) < before:
                return False
            if when_x < 0 and when_y < 0:
                return True
            if when_x > when_y:
                before, i = when_x, i + 1
            else:  # of equal merges the left one is first: one across the border comes before y's
                before, j = when_y + 1, j + 1

    def unit_ids(self, unit: str) -> list[int]:
        last: list[str | None] = [None] * (len(unit) + 1)  # None behind a character that is no token: bytes, a free border
        pairs = self.pairs
        for at, token in self.automaton.iter(unit):
            if last[at + 1] is not None:
                continue
            before = last[at + 1 - len(token)]
            if before is not None:
                fits = pairs.get((before, token))
                if fits is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    fits = pairs[before, token] = self.may_follow(before, token)
                if not fits:
                    continue
            last[at + 1] = token
        out, at = [], len(unit)
        while at:
            token = last[at]
            if token is None:
                out.extend(self.of_byte[b] for b in reversed(unit[at - 1].encode()))
                at -= 1
            else:
                out.append(self.id[token])
                at -= len(token)
        return out[::-1]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie one after another in data, and their borders; spaces are marks already."""
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.neighbours[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.known) + len(different) > REMEMBERED:
            self.known = {u: self.known[u] for u in different if u in self.known}
        for u in different:
            if u not in self.known:
                self.known[u] = np.array(self.unit_ids(u.decode()), np.int32).tobytes()
        blobs = [self.known[u] for u in different]
        table = np.frombuffer(b"".join(blobs), np.int32)
        many = np.array([len(b) // 4 for b in blobs], np.int64)
        code = coded.indices.to_numpy()
        ids = _spread(table, (np.cumsum(many) - many)[code], many[code])
        ends = np.concatenate([[0], np.cumsum(many[code])])
        return ids, ends[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        raw = b"".join(_spread(self.shown, self.begin[part], self.length[part]).tobytes()
                       for part in (ids[a : a + IDS_BLOCK] for a in range(0, len(ids), IDS_BLOCK)))
        first = ids[np.argmax(self.length[ids] > 0)]
        raw = raw[1:] if self.spaced[first] else raw  # the space that was put in front
        return raw.decode("utf-8", "one-by-one")


def _spread(table: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """table[begin : begin + many] of all places, one after another."""
    ends = np.cumsum(many)
    return table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + many, many)]


def _model(path: str, coding: bool = True) -> Pieces:
    if (path, coding) not in _MODELS:
        _MODELS[path, coding] = Pieces(path, coding)
    return _MODELS[path, coding]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for a, b, data, bounds in W.blocks(batch.column("text")):
                ids, ends = model.encode(data, bounds)
                yield batch_of(doc_id=batch.column("doc_id").slice(a, b - a),
                               ids=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, coding=False)  # in a worker of its own
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            a = 0
            while a < batch.num_rows:  # a few MB of text at a time, or one longer text
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + IDS_BLOCK, "right")) - 1)
                texts = [model.decode(ids[i:j]) for i, j in zip(ends[a:b], ends[a + 1 : b + 1])]
                yield batch_of(doc_id=batch.column("doc_id").slice(a, b - a), ids=lists.slice(a, b - a), text=pa.array(texts, pa.string()))
                a = b
    return run


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each row's whole text, without begin or end ids.

    model: path of a sentencepiece BPE model with byte fallback, present on every machine. A null or
    empty text has no ids. Rows, repeated ones included, stay one for one; other columns are not read,
    so their names can't clash; no rows give no rows. A very long text is one block of its own: its
    memory grows with its length, its time in proportion to it.
    """
    text = docs[text_col].cast("string")
    marked = F.when(text != "", F.concat(F.lit(" "), F.replace(text, F.lit(MARK), F.lit(" ")))).otherwise("")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), marked.alias("text"))
    return mapped(rows, _encoded(model), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text of the ids, as the library decodes them; null ids are no ids.

    Bytes that make no character become one replacement character each. Ids must be ids of the model.
    """
    rows = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return mapped(rows, _decoded(model), "doc_id long, ids array<int>, text string")
