"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.decontamination import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLES["op6_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
       FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS u(j) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM hit GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.substring_dedup import without_repeats
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS t
        FROM d, unnest(generate_series(1, len(w) - 19)) AS u(i) WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM later, unnest(generate_series(i, i + 19)) AS u(j)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY j) AS l
         FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) AS words
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.j = words.j) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(l, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.near_duplicates import similar
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.line_dedup import without_repeated_lines
    return without_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l WHERE trim(x) <> ''),
p AS (SELECT doc_id, seq, trim(x) AS a, trim(lead(x) OVER (PARTITION BY doc_id ORDER BY seq)) AS b FROM f),
later AS (SELECT doc_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, seq) AS r
                                   FROM p WHERE b IS NOT NULL) WHERE r > 1),
gone AS (SELECT doc_id, seq FROM later UNION SELECT doc_id, seq + 1 FROM later),
bad AS (SELECT f.doc_id, f.pos FROM f JOIN gone USING (doc_id, seq))
SELECT d.doc_id, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM bad WHERE bad.doc_id = d.doc_id) AS n_removed,
       sha256(coalesce((SELECT string_agg(x, chr(10) ORDER BY pos) FROM l WHERE l.doc_id = d.doc_id
              AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = l.doc_id AND bad.pos = l.pos)), '')) AS kept_sha256
FROM documents d"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.toxicity import fit, scored
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, out_col="score").select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.packing import packed
    return packed(table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.html_extraction import extracted
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.top_k import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLES["op1_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.secrets import as_text, found_secrets
    found = found_secrets(table(spark, sf_dir, "documents"))

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    base = as_text(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.language_model import scored
    return scored(table(spark, sf_dir, "documents"))


def pieces_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.sentence_pieces import decoded, encoded
    both = decoded(encoded(table(spark, sf_dir, "documents"), pieces_path()), pieces_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.fill_in_middle import arranged, restored
    return arranged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix
      FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendframe.llm.hard_negatives import hard_negatives
    x = table(spark, sf_dir, "embeddings")
    x = x.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(x, F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLES["op13_hard_negatives"] = """
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM x a JOIN x r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
