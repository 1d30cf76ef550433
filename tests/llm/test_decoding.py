"""Decoding holds what it needs only, and a few texts at a time."""
import pyarrow as pa


def test_texts_are_decoded_a_few_at_a_time(monkeypatch):
    from lendframe.llm import sentence_pieces as S
    from lendframe.llm.queries import pieces_path
    texts = ["", "one two", "three  four\tfive", "é中", "", "six " * 50, ""]
    marked = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(7), pa.int64()), "text": [" " + t if t else "" for t in texts]})
    coded = list(S._encoded(pieces_path())([marked]))
    monkeypatch.setattr(S, "IDS_BLOCK", 8)
    got = list(S._decoded(pieces_path())(coded))
    assert len(got) > 2
    table, ids = pa.Table.from_batches(got), pa.Table.from_batches(coded)["ids"].to_pylist()
    assert table["text"].to_pylist() == texts and table["ids"].to_pylist() == ids
    assert table["doc_id"].to_pylist() == list(range(7))
    assert not hasattr(S._model(pieces_path(), coding=False), "automaton")
