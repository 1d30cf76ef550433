"""Operators that were rebuilt for large tables give what the plain ones give, without moving all rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.models import joint_cv, runner
from lendframe.operators import clusters, conformal, metrics, neighbours
from lendframe.plans import adapters
from lendframe.queries import encoding, features, modelling
from lendframe.queries.registry import QUERIES, load_all
from lendframe.sources import tables
from lendframe.operators.stats_tests import five_by_two


def test_half_splits_shuffle_sums_only(spark, monkeypatch):
    rows = spark.range(400).select(
        "id", F.when(F.col("id") % 9 != 0, (F.col("id") % 3 == 0).cast("int")).alias("y"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 37 / 37.0).alias("p"))
    repeats = spark.createDataFrame([(1,), (2,), (3,)], "repeat int")
    splits = rows.crossJoin(repeats).withColumn("fit", (F.xxhash64("id", "repeat") % 2 == 0).cast("int"))
    rare = spark.createDataFrame([(1000, 1, 0.5, 4, 1), (1001, 0, 0.2, 4, 0)], "id long, y int, p double, repeat int, fit int")
    splits = splits.unionByName(rare)  # a repeat with one class and too few rows for a cut-off
    fit, held, want = splits.where("fit = 1"), splits.where("fit = 0"), []
    for method, make in (("one per class", conformal.class_cutoffs), ("one for everyone", conformal.one_cutoff)):
        table = make(fit, "y", "p", [0.1], by=["repeat"]).drop("alpha")
        want += conformal.outcome_rates(held.join(table, "repeat"), "y", "p", by=["repeat"]).withColumn("method", F.lit(method)).collect()

    def no_order(*_, **__):
        raise AssertionError("all copies of the rows are put in order")
    monkeypatch.setattr(conformal, "running_totals", no_order)
    got = conformal.half_split_stability(splits, "y", "p", 0.1).collect()
    assert len(got) == 8
    for a, b in zip(sorted(got, key=lambda r: (r.method, r.repeat)), sorted(want, key=lambda r: (r.method, r.repeat))):
        assert a.asDict() == pytest.approx(b.asDict(), nan_ok=True)


class _Column:
    """A learner whose score is a column."""

    def __init__(self, name):
        self.name = name

    def fit(self, df, label, weight=None):
        return self

    def transform(self, df):
        return df.withColumn("p", F.col(self.name))


def test_five_by_two_ranks_all_scores_together(spark, monkeypatch):
    halves = spark.range(120).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "repeat", ((F.col("id") * 7 + F.col("repeat")) % 2).cast("int").alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        (F.col("id") * 31 % 41 / 41.0).alias("a"), (F.xxhash64("id", "repeat") % 17 / 40.0 + 0.5).alias("b"))
    want = []
    for i in range(5):
        part = [halves.where((F.col("repeat") == i) & (F.col("fold") == k)) for k in (0, 1)]
        want.append([metrics.rank_metrics(q, "y", "a").first()["roc_auc"] - metrics.rank_metrics(q, "y", "b").first()["roc_auc"] for q in part])
    calls, ranked = [], metrics.rank_metrics
    monkeypatch.setattr(metrics, "rank_metrics", lambda *a, **k: calls.append(1) or ranked(*a, **k))
    got = runner.five_by_two_cv(lambda: _Column("a"), lambda: _Column("b"), halves, "y")
    assert got == pytest.approx(five_by_two(want)) and len(calls) == 1


def test_tiles_are_few_and_give_the_nearest(spark, monkeypatch):
    # copies of a point and of a query hardly grow with the tables
    assert [sum(neighbours._tiles(n, n, 5)) for n in (2_000, 92_000, 553_000)] == [3, 15, 22]
    p, q = neighbours._tiles(630_000, 157_000, 200)
    assert p == 5 and q <= 20 and p * q >= 48  # 200 answers a query and tile of points
    assert neighbours._tiles(0, 0, 5) == (1, 1)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 4)), 1)
    v[200:240] = v[:40]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): int(j) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), d[i]))[:5])}
    for points, queries in ((1 << 17, 1 << 15), (90, 70)):  # one tile; many tiles
        for name, value in (("POINTS", points), ("QUERIES", queries)):
            monkeypatch.setattr(neighbours, name, value)
        found = neighbours.nearest(rows, rows, 5, same=True).collect()
        assert {(r.qid, r["rank"]): r.id for r in found} == want


def test_a_small_file_is_dealt_out(spark, sf_dir, monkeypatch):
    load_all()
    parts, shrink = [], tables.shrink
    monkeypatch.setattr(tables, "shrink", lambda df: parts.append(df.rdd.getNumPartitions()) or shrink(df))
    assert QUERIES["src_5_feature_sink"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def _order_lines(spark, path, orders):
    stamp = F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00"))
    spark.range(orders).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), stamp.alias("o_orderdate")
                               ).write.parquet(f"{path}/orders.parquet")
    key = F.when(F.col("id") % 50 != 0, F.col("id") % (orders + 5)).alias("l_orderkey")  # some without an order or key
    spark.range(4 * orders).coalesce(1).select(
        key, F.lit(1).cast("bigint").alias("l_partkey"), F.lit(2).cast("bigint").alias("l_suppkey"),
        (F.col("id") % 5).cast("int").alias("l_linenumber"), F.lit(3.0).alias("l_quantity"), F.lit(9.0).alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), stamp.alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")


def test_tasks_hold_a_bounded_number_of_order_lines(spark, tmp_path, monkeypatch):
    orders = 500
    _order_lines(spark, tmp_path, orders)
    want = sorted((k, n) for n in range(4 * orders) if n % 50 and (k := n % (orders + 5)) < orders)
    monkeypatch.setattr(adapters, "LINES_A_TASK", 100)
    rows = adapters.view(spark, str(tmp_path), "installments_payments")
    assert sorted(r[0] for r in rows.select("SK_ID_PREV").collect()) == [k for k, _ in want]
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 20 and max(sizes) < 200  # 2,000 lines
    assert rows.groupBy("SK_ID_PREV").count().rdd.getNumPartitions() == 20  # summed up where they are


def test_fits_read_applicants_dealt_out_and_written_once(spark, sf_dir, monkeypatch):
    load_all()
    plain = encoding.model_rows(spark, sf_dir)
    assert encoding.rows_to_fit(spark, sf_dir).sameSemantics(encoding.model_rows(spark, sf_dir))  # few rows: one task
    monkeypatch.setattr(encoding, "APPLICANTS_A_TASK", 30)
    rows = encoding.rows_to_fit(spark, sf_dir)
    assert plain.rdd.getNumPartitions() == 1 < rows.rdd.getNumPartitions()
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    train, held = modelling.halves(spark, sf_dir)
    assert train.rdd.getNumPartitions() > 1 and held.count() == plain.where("fold = 1").count()


def test_the_fill_report_joins_the_feature_table_once(spark, sf_dir, monkeypatch):
    load_all()
    seen, report = [], modelling.fill.fill_report
    monkeypatch.setattr(modelling.fill, "fill_report", lambda rows, *a: seen.append(rows) or report(rows, *a))
    assert QUERIES["md_17_ridge"](spark, sf_dir).count() == 2 + len(modelling.fill.PENALTIES)
    assert len(seen[0].inputFiles()) and all("fill-rows" in f for f in seen[0].inputFiles())
    target = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal >= 0").count()
    assert seen[0].count() == target


def _rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_summaries_are_joined_in_tasks_of_a_bounded_number_of_applicants(spark, sf_dir, monkeypatch):
    load_all()
    names = "agg_2_bureau", "ex_14_decision_changes"
    want = [_rounded(QUERIES[n](spark, sf_dir)) for n in names]
    monkeypatch.setattr(features, "JOINED_A_TASK", 10)
    monkeypatch.setattr(adapters, "LINES_A_TASK", 300)
    few = spark.read.parquet(f"{sf_dir}/customer.parquet").count(), spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    applicants, lines = -(-few[0] // 10), -(-few[1] // 300)
    plan = features.features(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert sum("hashpartitioning(SK_ID_CURR" in line and f", {applicants})" in line for line in dealt) == 6
    assert sum("hashpartitioning(SK_ID_BUREAU" in line and f", {lines})" in line for line in dealt) == 2
    assert [_rounded(QUERIES[n](spark, sf_dir)) for n in names] == want


def test_a_task_merges_the_sketches_of_a_few_columns(spark, monkeypatch):
    columns = [f"x{j}" for j in range(7)]
    rows = spark.range(400).select((F.col("id") % 3 + 1).cast("int").alias("fold"), *[
        F.when(F.col("id") % (j + 2) != 0, F.xxhash64("id", F.lit(j)) % 1000 / 10.0).alias(c) for j, c in enumerate(columns)],
        F.lit(None).cast("double").alias("none"))
    columns.append("none")
    want = rows.agg(*[F.percentile_approx(F.when(F.col("fold") != k, F.col(c)), list(joint_cv.CAPS), joint_cv.ACCURACY).alias(f"{c}_{k}")
                      for c in columns for k in (1, 2, 3)]).first()
    held, agg = [], type(rows).agg

    def counted(df, *found):
        held.append(str(found).count("percentile_approx"))
        return agg(df, *found)
    monkeypatch.setattr(type(rows), "agg", counted)
    monkeypatch.setattr(joint_cv, "SKETCHES", 6)
    caps = joint_cv.caps_without_a_fold(rows, "fold", [1, 2, 3], columns)
    assert held == [6, 6, 6, 6]
    assert caps.tolist() == [[[(want[f"{c}_{k}"] or [0.0] * 3)[q] for c in columns] for q in range(3)] for k in (1, 2, 3)]


def _broadcast_keys(df):
    df.collect()
    return re.findall(r"Broadcast\w*Join \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_personas_send_no_rows_by_applicant_over_the_driver(spark, tmp_path):
    spark.range(300).select(
        F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        (F.col("id") * 7919 % 1000 * 11.0 - 999).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    ).write.parquet(f"{tmp_path}/customer.parquet")
    load_all()
    answer = QUERIES["un_9_personas"](spark, str(tmp_path))
    assert set(_broadcast_keys(answer)) <= {"cluster"} and answer.count() == 3

    # ids that come twice, miss on one side or are null
    impacts = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 2.0), (2, "a", 2.0), (2, "b", 1.0), (3, "a", 5.0), (None, "a", 9.0)],
                                    "id long, feature string, impact double")
    labelled = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 1), (3, 1, None), (4, 1, 1), (None, 1, 0)], "id long, cluster int, y int")
    found = clusters.personas(impacts, labelled, "y", top=1)
    assert set(_broadcast_keys(found)) <= {"cluster"}
    got = {r["cluster"]: (r["n"], r["rate"], r["reasons"]) for r in found.collect()}
    assert got[0][:2] == (3, pytest.approx(2 / 3)) and got[0][2].endswith("(+2.33)")  # b: 3, 3 and 1
    assert got[1][:2] == (3, 0.5) and got[1][2].endswith("(+5.00)")


def test_a_vote_shuffles_no_lists_of_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(700, 5)) * [3, 2, 1, 1, 1], 1)
    v[500:560] = v[:60]  # ties
    v[690] = 1e6
    ids = np.arange(700)
    ids[600:620] = ids[:20]  # ids that come twice, at other places
    points = [(int(i), x.tolist()) for i, x in zip(ids, v)]
    labels = [(int(i), None if i % 11 == 0 else float(i % 3 == 0)) for i in ids if i % 7]  # some without a row or a label
    asked = [*points[:90], *points[500:505], *points[600:610]]
    df = lambda rows, second: spark.createDataFrame(rows, f"id long, {second}")

    def no_lists(*_, **__):
        raise AssertionError("k neighbours of every query and tile are shuffled")
    monkeypatch.setattr(neighbours, "nearest", no_lists)
    of = {}
    for i, y in labels:
        of.setdefault(i, []).append(y)
    for k, same, few in ((3, False, True), (12, True, True), (200, False, False), (900, True, False)):
        if few:  # many tiles, blocks and parts
            monkeypatch.setattr(neighbours, "VOTERS", 40)
            monkeypatch.setattr(neighbours._Held, "BLOCK", 8)
            monkeypatch.setattr(neighbours._Held, "LEAF", 16)
        else:
            monkeypatch.undo()
            monkeypatch.setattr(neighbours, "nearest", no_lists)
        near = {}
        for i, q in asked:
            d = np.sqrt(((v - np.array(q)) ** 2).sum(1))
            near.setdefault(i, []).extend((d[j], int(ids[j])) for j in range(700) if not (same and ids[j] == i))
        want = {}
        for i, found in near.items():
            ys = [y for _, j in sorted(found)[:k] for y in of.get(j, [])]
            if ys:
                some = [y for y in ys if y is not None]
                want[i] = sum(some) / len(some) if some else None
        got = neighbours.vote(df(points, "v array<double>"), df(labels, "y double"), df(asked, "v array<double>"), k, same).collect()
        assert len(got) == len(want) and {r.id: r.p for r in got} == pytest.approx(want)
    assert neighbours.vote(df([], "v array<double>"), df(labels, "y double"), df(asked, "v array<double>")).count() == 0
    odd = df([*points[1:40], (900, [float("nan")] * 5)], "v array<double>")  # near nothing, and in nobody's way
    assert neighbours.vote(odd, df([(i, 1.0) for i in range(1000)], "y double"), odd, 3).count() == 39


def test_a_loose_first_bound_lets_few_pairs_through(monkeypatch):
    # the k-th of hardly more than k points says next to nothing about the k-th of all
    rng = np.random.default_rng(6)
    x, q, k = rng.normal(size=(5_022, 6)), rng.normal(size=(300, 6)), 20
    ids, labels, pairs, keep = np.arange(len(x)), (x[:, 0] > 0).astype(float), [], neighbours._Held.keep
    monkeypatch.setattr(neighbours._Held, "keep", lambda self, found: (pairs.extend(len(f[0]) for f in found), keep(self, found)))
    held = neighbours._Held(np.arange(300), q, k, False)
    for a, b in ((0, 22), (22, 5_022)):
        held.meet(ids[a:b], x[a:b], labels[a:b], np.ones(b - a, np.int32))
    assert sum(pairs) < 300 * 20 * k  # of 300 x 5,022
    got = held.votes().to_pydict()
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    assert dict(zip(got["id"], got["p"])) == pytest.approx({i: labels[np.lexsort((ids, d[i]))[:k]].mean() for i in range(300)})
