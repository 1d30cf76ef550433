"""The text operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_queries import compare, duck
from lendframe.llm import queries as Q
from lendframe.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, sep=" "):
    return sep.join(RNG.choice(VOCAB) for _ in range(n))


PASSAGE, LONG = prose(60), prose(3000)
TEXTS = [prose(120), prose(30) + " " + PASSAGE + " " + prose(40), PASSAGE, None, "", "   ", "one", LONG,
         prose(10) + "\n" + PASSAGE + "\n" + prose(30) + "\nlast line", "same line a\nsame line b\n" + prose(20),
         "x y\nsame line a\nsame line b\n\n" + prose(25), LONG[:-8] + " changed", "ÄÖ é日本 naïve — don't"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(20, TEXTS[0]), (20, TEXTS[0]), (None, TEXTS[2]), (1, TEXTS[1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in ROWS], "doc_id long, text string, th int, marks int, runs int")


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, Q.QUERIES[name], Q.ORACLES[name]) is None


def test_word_hashes_follow_the_regex():
    texts = ["Ab c-d", "", "x" * 50, "ÄÖ 12_3", " a  b\n"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = W.find(np.frombuffer(data, np.uint8), bounds, W.alphanumeric())
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    assert w.counts.tolist() == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) for t in lower]
    assert w.hash[0] != w.hash[1] and w.hash[w.first[4]] not in w.hash[: w.first[3]]


def test_top_k_with_odd_vectors(spark):
    from lendframe.llm.top_k import nearest
    rows = [(i, [RNG.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (300, rows[5][1]), (None, [1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in ok:
        if q % 50 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in ok if i != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_secrets_base_and_random(spark):
    from lendframe.llm.secrets import KINDS, found_secrets
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(120))
    texts = ['é password = "hunter22" token: abc secret=token: abcdef', "AKIA" + "Z9" * 8 + " AKIAX", "ab" * 12 + " " + "a" * 23,
             None, "", f"see {key} here", "a" * 60, "thandthethingthatwentthereandthen", 'API_KEY="Zq9-x.y=/+"' * 3]
    got = {r.doc_id: r.spans for r in found_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in got[i] if s.kind < 3] == sorted(want)
    assert [(KINDS[s.kind], s.end - s.start) for s in got[5]] == [("random", 120)]
    assert not [s for i in (6, 7) for s in got[i] if s.kind == 3]


def test_random_keys_are_found_at_small_shares(spark):
    from lendframe.llm.secrets import found_secrets
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "the payment service reads every customer record from remote storage and writes monthly report index pages again".split()

    def ordinary(n):
        glue, out = rng.choice("/-_"), ""
        while len(out) < n:
            word = rng.choice(words)
            out += word.title() if glue == "-" else word + glue * (glue == "_" or rng.random() < 0.7)
        return (out + str(rng.randrange(2030)) * (rng.random() < 0.2))[: n + 8]

    rows = [(-k - 1, ordinary(rng.choice([20, 26, 34, 44, 66]))) for k in range(20000)]
    lengths = [20, 32, 40, 64]
    rows += [(k, "see " + "".join(rng.choice(letters) for _ in range(lengths[k % 4])) + " here") for k in range(20)]
    got = {r.doc_id: r.spans for r in found_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = [k for k in range(20) if [tuple(s) for s in got[k]] == [(4, 3, 4 + lengths[k % 4])]]
    # a test of three deviations leaves out a few random strings in a hundred
    assert len(right) >= 18 and {k % 4 for k in right} == {0, 1, 2, 3}
    assert sum(len(s) for k, s in got.items() if k < 0) <= 1


def test_html(spark):
    from lendframe.llm.html_extraction import extracted
    nav = "<div><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></div>"
    page = "<html><body>%s<p>A &amp; b<br>c <b>d</b></p><p>own %d<div class='comments'><p>no</p></div><script>x<p></script>%s"
    rows = [(i, "http://h.org/x", page % (nav, i, "<footer>f</footer>")) for i in range(6)]
    rows += [(7, "http://other.org", page % (nav, 7, "")), (8, None, None), (9, "::", ""), (10, "http://h.org", "<article><h1>T</h1><p>x  y</article> z"),
             (11, "http://h.org", "<a href='" * 2000)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "own 3"  # outside an article a paragraph on every page is template
    assert got[7] == "Home\nB\nA & b c d\nown 7" and got[8] == got[9] == "" and got[10] == "T\nx y" and len(got) == len(rows)


def test_html_counts_different_pages(spark):
    from lendframe.llm.html_extraction import extracted
    page = "<html><body>%s<p>some %s text</p><p>more %s text</p></body></html>"
    nav = "<ul><li><a href=/>Home</a></ul>"
    rows = [(1, "http://a.org/x", page % (nav, "plain", "plain"))] * 6  # one row repeated
    rows += [(10 + i, f"http://b.org/{i}", page % (f"<script>{i}</script>", "copied", "copied")) for i in range(6)]  # mirrors
    rows += [(100 + i, "http://c.org", page % (nav, i, "quoted" if i < 5 else -i)) for i in range(60)]
    notice = "<p>we moved to a new address</p>"
    rows += [(200 + i, "http://d.org", f"<article><p>piece {i}</p>{notice if i < 8 else ''}{'<p>quoted</p>' if i < 5 else ''}</article>") for i in range(11)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Home\nsome plain text\nmore plain text"
    assert all(got[10 + i] == "some copied text\nmore copied text" for i in range(6))
    assert got[100] == "some 0 text\nmore quoted text" and got[150] == "some 50 text\nmore -50 text"
    assert got[200] == "piece 0\nquoted" and got[210] == "piece 10"


def test_html_class_names():
    from lendframe.llm.html_extraction import _boilerplate, main_text, parse
    assert all(map(_boilerplate, ["nav", "site-nav", "share-buttons", "cookie_notice", "related-posts", "ad-slot-3"]))
    assert not any(map(_boilerplate, ["no-sidebar", "has-comments", "share-price", "ad-hoc", "notice-period-law", "post", "-"]))
    root = parse("<article class='entry no-sidebar'><p class='share-price'>up</p><p class='promo'>buy</p></article>")
    kinds = {}
    todo = [root]
    while todo:
        node = todo.pop()
        kinds[id(node)] = 2
        todo.extend(x for x in node.parts if not isinstance(x, str))
    assert main_text(root, [], kinds, {}) == "up"


def test_toxicity_learns_and_keeps_columns(spark):
    from lendframe.llm.toxicity import accepted, fit, scored
    rows = [(i, prose(30) + (" zorkig" if i % 4 == 0 else "") + " end", 1) for i in range(400)] + [(400, None, 1), (None, "zorkig", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = scored(docs, model, out_col="s").collect()
    assert all((r.s >= 0.5) == ("zorkig" in (r.text or "")) for r in got)
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 301
    none = fit(docs, labels.limit(0))
    assert scored(docs.limit(0), none, out_col="s").count() == 0


def test_near_duplicates_equal_brute_force(spark, docs):
    from lendframe.llm.near_duplicates import one_of_each, similar
    base = [RNG.choice(VOCAB) for _ in range(150)]
    rows = list(ROWS)
    for i in range(40):
        words = list(base)
        for _ in range(i % 6):
            words[RNG.randrange(150)] = "new" + str(RNG.random())
        rows.append((100 + i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {shingles(t) for _, t in rows} - {frozenset()}
    linked = {s: [u for u in sets if u != s and len(s & u) >= 0.8 * len(s | u)] for s in sets}
    got = similar(table).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    for r in got:
        s = shingles(text[r.doc_id])
        assert r.n_links == len(linked.get(s, [])) and (s or r.class_id == r.doc_id)
    of = {shingles(text[r.doc_id]): r.class_id for r in got}
    assert all(of[u] == of[s] for s in linked for u in linked[s])
    ids = {s: min(i if i is not None else -1 for i, t in rows if shingles(t) == s) for s in sets}
    for s in sets:  # the class id is the least id that links lead to
        seen, todo = {s}, [s]
        while todo:
            new = [u for u in linked[todo.pop()] if u not in seen]
            seen.update(new)
            todo += new
        assert of[s] == (min(ids[u] for u in seen) if min(ids[u] for u in seen) >= 0 else None)
    assert len({(r.doc_id, r.th) for r in got if r.first}) == one_of_each(table).count()
    assert similar(table.limit(0)).count() == 0


def test_texts_without_words_stay(spark):
    import corpus_pipeline
    from lendframe.llm.near_duplicates import one_of_each, similar
    rows = [(1, None), (2, ""), (3, "  "), (4, "?! --"), (4, "?! --"), (None, ""), (5, "a b c d e f"), (6, "a b c d e f")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, rows[:-1]))
    assert sorted(str((r.doc_id, r.text)) for r in one_of_each(table).collect()) == want
    assert sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()) == want
    assert sum(r.first for r in similar(table).collect()) == 7


def test_substrings_lines_and_contamination(spark, docs):
    from lendframe.llm.decontamination import contamination
    from lendframe.llm.line_dedup import cleaned, later_runs, without_repeated_lines
    from lendframe.llm.substring_dedup import without_repeats
    order = sorted({(i, t) for i, t in ROWS}, key=lambda r: (-1 if r[0] is None else r[0]))
    seen, want = set(), {}
    for i, t in order:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = without_repeats(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == want

    lines = {r.doc_id: r for r in without_repeated_lines(docs).collect()}
    assert lines[10].n_removed == 2 and lines[10].text.startswith("x y\n\nw") and lines[3].text == ""
    same = cleaned(docs)
    assert same.columns == docs.columns and same.count() == len(ROWS)
    long = spark.createDataFrame([(d, 0, k, x) for d, s in ((1, "abcdeabcde"), (2, "zabcdy")) for k, x in enumerate(map(ord, s))],
                                 "doc_id long, th long, seq int, line long")
    assert sorted((r.doc_id, r.seq) for r in later_runs(long, 4).collect()) == [(1, 5), (1, 6), (2, 1)]
    assert sorted((r.doc_id, r.seq) for r in later_runs(long, 3).collect()) == [(1, 5), (1, 6), (1, 7), (2, 1), (2, 2)]

    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:20])), (2, "one"), (3, None), (None, "w1 w2"), (4, prose(12))],
                                  "item_id long, text string")
    hits = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert hits[1].n_hit == 15 and hits[1].items == ["1"] and hits[6].n_hit == 1 and hits[6].items == ["2"]
    assert hits[3].n_words == 0 and hits[0].n_hit == 0 and contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_a_long_line_is_a_run(spark):
    import corpus_pipeline
    from lendframe.llm.line_dedup import without_repeated_lines
    short = " ".join(PASSAGE.split()[:49])
    rows = [(1, f"one\n  {PASSAGE}\n\ntwo"), (2, f"three\n{PASSAGE} \nfour\n{short}\na b"), (3, f"{short}\n{PASSAGE}\n{PASSAGE}\nfive"),
            (4, f"x\n{PASSAGE}\none\n{PASSAGE}\n\ntwo"), (5, None)]
    table = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, table, "").collect()}
    want = {1: rows[0][1], 2: f"three\nfour\n{short}\na b", 3: f"{short}\nfive", 4: "x\n", 5: None}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}
    assert {r.doc_id: r.n_removed for r in without_repeated_lines(table).collect()} == {1: 0, 2: 0, 3: 0, 4: 3, 5: 0}


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer
    from lendframe.llm.packing import hilbert_key, packed
    path = Q.tokenizer_path()
    coder = Tokenizer.from_file(path)
    got = packed(docs, path, size=256).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.offset + r.length <= 256
    for i, t in ROWS:
        if [x for x, _ in ROWS].count(i) == 1:
            ids = b"".join(bytes(r.ids) for r in sorted(pieces[i], key=lambda r: r.start))
            assert np.frombuffer(ids, "<u4").tolist() == coder.encode(t or "", add_special_tokens=False).ids + [2]
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    walk = cells[np.argsort(hilbert_key(cells, 3))]
    assert sorted(hilbert_key(cells, 3).tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_language_model_base_counts(spark, docs):
    from lendframe.llm.language_model import scored
    got = scored(docs).collect()
    count, total = {}, 0
    for i, t in ROWS:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for w in [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]:
                count[w] = count.get(w, 0) + 1
                total += 1
    by = {i: t for i, t in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        w = [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), by[r.doc_id] or "")), ""]
        base = sum(math.log10((count.get(x, 0) + 0.1) / (total + 0.1 * (len(count) + 1))) for x in w)
        assert abs(base - r.base_score) < 1e-6 * abs(base) and r.n_tokens == len(w) and r.train_tokens == total
        assert r.n_known == sum(x in count for x in w) and r.score < 0 and math.isfinite(r.score)


def test_language_model_probabilities_sum_to_one(spark):
    from lendframe.llm import language_model as L
    texts = [f"a b c{i % 3} a b" for i in range(40)] + ["", "b a b"]
    words, pairs, totals = L.seated(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    rows = words.collect()
    parent = {r.hash: L._parent(r.c, r.t, totals) for r in rows}
    unseen = L._parent(0, 0, totals)
    assert abs(sum(parent.values()) + unseen - 1) < 1e-9
    seats = {}
    for r in pairs.collect():
        assert 1 <= r.t <= r.n
        seats.setdefault(r.u, {})[r.w] = r.n - L.DISCOUNT * r.t
    for r in rows:
        rest = L.STRENGTH + L.DISCOUNT * r.x
        assert abs(sum(seats[r.hash].values()) + rest - (L.STRENGTH + r.n)) < 1e-9


def test_language_model_beats_its_base_on_held_out_texts(spark):
    from lendframe.llm.language_model import scored
    got = scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(
        F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert got.score > 0.9 * got.base


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, sf_dir)
    pieces = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(1 for r in pieces if r.n != 4096) <= 1
    assert hashlib and len(corpus_pipeline.STAGES) == 5
