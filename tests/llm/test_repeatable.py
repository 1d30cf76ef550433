"""Results that must not hang on hash bits or on how rows are dealt out."""

import numpy as np
from pyspark.sql import functions as F

from lendframe.llm import words as W


def test_texts_of_one_id_with_equal_low_hash_bits_stay_apart(spark):
    from lendframe.llm.substring_dedup import without_repeats
    copied, alone = ("83772 " + " ".join(f"p{i}" for i in range(30))), ("69227 " + " ".join(f"q{i}" for i in range(30)))
    docs = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(30))), (5, copied), (5, alone)], "doc_id long, text string")
    low = docs.where("doc_id = 5").select(F.expr("xxhash64(text) & 2147483647").alias("h")).distinct()
    assert low.count() == 1
    got = {r.text: r.n_removed for r in without_repeats(docs).collect()}
    assert got[alone] == 0 and got["83772"] == 30


def test_language_model_scores_do_not_hang_on_partitions(spark, sf_dir):
    from lendframe.llm.language_model import scored
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, three = ({(r.doc_id, r.score) for r in scored(d).collect()} for d in (docs, docs.repartition(3)))
    assert one == three


def test_tables_follow_the_seating_rule():
    from lendframe.llm.language_model import _seat
    count, weight = np.array([2, 5, 60, 400, 20]), np.array([0.1, 1.0, 8.0, 0.02, 300.0])
    draws = np.array([_seat(count, weight, 0.75, W.mix(np.arange(5, dtype=np.uint64) + np.uint64(100 * s))) for s in range(600)])
    rng = np.random.default_rng(1)

    def one_by_one(n, w):
        tables = 1
        for seated in range(1, n):
            tables += rng.random() < w / (w + seated - 0.75 * tables)
        return tables

    for k, (n, w) in enumerate(zip(count, weight)):
        plain = np.array([one_by_one(n, w) for _ in range(600)])
        spread = np.sqrt((plain.var() + draws[:, k].var()) / 600)
        assert abs(plain.mean() - draws[:, k].mean()) < 5 * spread + 1e-9
    assert draws.min() >= 1 and (draws.max(0) <= count).all()


def test_pipeline_stages_with_clashing_column_names(spark):
    from lendframe.llm import line_dedup, toxicity
    run = "\n".join(f"line {k} of a run" for k in range(4))
    docs = spark.createDataFrame([(1, run, "a", 0.5), (2, "head\n" + run, "b", 0.1), (3, None, "c", 0.2)],
                                 "doc_id long, text string, _line_text string, Toxicity double")
    got = {r.doc_id: r for r in line_dedup.cleaned(docs).collect()}
    assert got[2].text == "head" and got[2]["_line_text"] == "b" and got[3].text is None
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 3
