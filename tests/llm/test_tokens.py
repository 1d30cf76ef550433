"""Sentence pieces against the library, fill-in-the-middle against a plain version, both on odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from lendframe.llm import fill_in_middle as M
from lendframe.llm.queries import pieces_path
from lendframe.llm.sentence_pieces import Pieces, decoded, encoded

RNG = random.Random(5)
TEXTS = [None, "", " ", "   a  b ", "\n\n", "naïve — don’t\t日本𒀀", "▁ mark ▁▁", "x" * 3000, "a" + " " * 300 + "b", "<s> <0x41> <unk>",
         "<P>", "a<S>b", "p < q<M", "a\x00b", "é", "Ünïts 12,3", "AbcD e", "word " * 900_000, "日本語" * 200_000]
TEXTS += ["".join(RNG.choice(["the", " ", "  ", "é", "\n", "12", "Zq", "<", "ß", "x.y"]) for _ in range(RNG.randint(1, 90))) for _ in range(60)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, "another"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in ROWS], "doc_id long, text string, h1 int, ids int, Form string")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces_path())


def test_pieces_are_the_librarys(docs, library):
    got = decoded(encoded(docs, pieces_path()), pieces_path()).collect()
    want = [(i, library.encode(t or "")) for i, t in ROWS]
    key = str
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in got), key=key) == sorted(((i, ids, library.decode(ids)) for i, ids in want), key=key)


def test_pairs_and_bytes_of_any_kind(library):
    model = Pieces(pieces_path())
    names = list(model.id)
    texts = ["".join(RNG.choice(names) for _ in range(8)) for _ in range(4000)] + [" " * n for n in range(80)]
    parts = [(" " + t).encode() for t in texts]
    ids, ends = model.encode(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == (library.encode(t) if t else [model.id[" "]])
    for _ in range(3000):  # bytes that make no character, control and unknown ids
        some = [RNG.choice([RNG.randrange(32000), RNG.randrange(259), model.id[" "]]) for _ in range(7)]
        assert model.decode(np.array(some)) == library.decode(some)


def test_a_pair_that_would_merge_is_no_pair():
    model = Pieces(pieces_path())
    pairs = [(a, b) for a in (" t", "th", "he", "e", "in", " ", "  ") for b in ("h", "he", "e", "g", "ing", "t", " ", " t")]
    verdicts = [model.may_follow(a, b) for a, b in pairs]
    assert verdicts == [model.merged(list(a + b))[0] == [a, b] for a, b in pairs]
    assert True in verdicts and False in verdicts


def plain_version(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_the_plain_version_and_comes_back(docs):
    rows = M.arranged(docs)
    got = rows.withColumn("text", M.restored(rows["output"], rows["form"])).collect()
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted((plain_version(i, t) for i, t in ROWS), key=str)
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t in ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_outputs_from_stored_cuts(spark, docs):
    one_each = docs.dropDuplicates(["doc_id"])
    made = M.arranged(one_each)
    again = M.from_cuts(one_each.select("doc_id", "text").join(made.drop("output", "n"), "doc_id"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made.where("doc_id is not null").select("doc_id", "output").collect()))


def test_places_of_characters_and_bytes():
    text = "aé日𒀀 b" * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    odd = M.Exceptions.of(raw)
    borders = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert odd.characters(borders).tolist() == list(range(len(text) + 1))
    assert odd.bytes(np.arange(len(text) + 1)).tolist() == borders.tolist()
    assert len(odd.place) == 150


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decoded(encoded(none, pieces_path()), pieces_path()).count() == 0
    assert M.arranged(none).count() == 0
