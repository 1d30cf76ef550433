"""Joins, latest rows, set operations, top-k and the table sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lendframe.operators import joins
from lendframe.operators.latest import latest_rows
from lendframe.operators.metrics import rank_metrics
from lendframe.operators.quantiles import exact_quantiles
from lendframe.operators.splits import make_splits, sample_rows
from lendframe.plans import application, bureau, previous
from lendframe.plans.adapters import raw, view
from lendframe.queries.registry import add
from lendframe.queries.sampling import SPLIT_SQL, hash_sql
from lendframe.operators.joins import beside

APP = ["application"]


def app(s, d):
    return view(s, d, "application")


add("jn_2_loan_months", "i:SK_ID_BUREAU,BB_MONTHS",
    lambda s, d: view(s, d, "bureau").select("SK_ID_BUREAU").join(
        bureau.monthly_status(view(s, d, "bureau_balance")), on="SK_ID_BUREAU", how="left"),
    """SELECT SK_ID_BUREAU, n AS BB_MONTHS FROM bureau LEFT JOIN (SELECT SK_ID_BUREAU, count(*) AS n
       FROM bureau_balance GROUP BY 1) USING (SK_ID_BUREAU)""", ["bureau", "bureau_balance"])
add("jn_3_lookup", "i:c_custkey s:n_name",
    lambda s, d: joins.lookup(raw(s, d, "customer"), raw(s, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"),
                              "c_nationkey", ["n_name"]),
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")


def _xy(s, d):
    splits = make_splits(app(s, d).where("TARGET IS NOT NULL"))
    feats = application.application_features(app(s, d))
    return joins.keys_of(splits, feats, "train", application.SENSITIVE)


add("jn_4_model_rows", "i:SK_ID_CURR,fold,TARGET d:APP_AMT_CREDIT,APP_AGE_YEARS", _xy,
    """SELECT SK_ID_CURR, fold, TARGET, AMT_CREDIT AS APP_AMT_CREDIT, -DAYS_BIRTH / 365.25e0 AS APP_AGE_YEARS
       FROM splits JOIN (SELECT SK_ID_CURR, AMT_CREDIT, DAYS_BIRTH FROM application) USING (SK_ID_CURR) WHERE split = 'train'""",
    APP, SPLIT_SQL)
add("jn_5_inner_join", "i:SK_ID_CURR,n",
    lambda s, d: app(s, d).select("SK_ID_CURR").join(
        view(s, d, "credit_card_balance").groupBy("SK_ID_CURR").agg(F.count("*").alias("n")), on="SK_ID_CURR"),
    """SELECT SK_ID_CURR, n FROM application JOIN (SELECT SK_ID_CURR, count(*) AS n FROM credit_card_balance GROUP BY 1)
       USING (SK_ID_CURR)""", ["application", "credit_card_balance"])
add("jn_6_semi_join", "i:SK_ID_CURR",
    lambda s, d: app(s, d).join(view(s, d, "pos_cash_balance"), on="SK_ID_CURR", how="left_semi").select("SK_ID_CURR"),
    "SELECT SK_ID_CURR FROM application WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM pos_cash_balance)",
    ["application", "pos_cash_balance"])
add("jn_7_anti_join", "i:ids,absent d6:absent_share",
    lambda s, d: joins.share_absent(view(s, d, "previous_application"), view(s, d, "pos_cash_balance"), "SK_ID_CURR"),
    """SELECT count(*) AS ids, count(*) FILTER (NOT hit) AS absent, count(*) FILTER (NOT hit) / CAST(count(*) AS DOUBLE) AS absent_share
       FROM (SELECT DISTINCT SK_ID_CURR, SK_ID_CURR IN (SELECT SK_ID_CURR FROM pos_cash_balance) AS hit FROM previous_application)""",
    ["previous_application", "pos_cash_balance"])
add("win_1_latest_row", "i:SK_ID_CURR,SK_ID_PREV,DAYS_DECISION s:NAME_CONTRACT_STATUS",
    lambda s, d: latest_rows(view(s, d, "previous_application"), ["SK_ID_CURR"], ["DAYS_DECISION", "SK_ID_PREV"],
                             ["SK_ID_PREV", "DAYS_DECISION", "NAME_CONTRACT_STATUS"]),
    """SELECT SK_ID_CURR, SK_ID_PREV, DAYS_DECISION, NAME_CONTRACT_STATUS FROM (SELECT *, row_number() OVER (
       PARTITION BY SK_ID_CURR ORDER BY DAYS_DECISION DESC, SK_ID_PREV DESC) AS rn FROM previous_application) WHERE rn = 1""",
    ["previous_application"])
add("win_2_group_statistics", "i:id,size d6:rate",
    lambda s, d: view(s, d, "scores").select("id", "grp").join(
        view(s, d, "scores").groupBy("grp").agg(F.count("*").alias("size"), F.avg("y").alias("rate")), on="grp"),
    """SELECT id, count(*) OVER (PARTITION BY grp) AS size, avg(y) OVER (PARTITION BY grp) AS rate FROM scores""", ["scores"])


def _ranks(s, d):
    """Rank of each group under three measures; one row per group."""
    g = view(s, d, "scores").groupBy("grp").agg(
        F.stddev_samp("p").alias("spread"), F.avg("p").alias("level"), F.max("p").alias("peak"))
    w = Window.partitionBy(F.lit(0))
    return g.select("grp", *[F.rank().over(w.orderBy(F.desc(n))).alias(n) for n in ("spread", "level", "peak")])


add("win_6_ranks", "s:grp i:spread,level,peak", _ranks,
    """SELECT grp, rank() OVER (ORDER BY stddev_samp(p) DESC) AS spread, rank() OVER (ORDER BY avg(p) DESC) AS level,
       rank() OVER (ORDER BY max(p) DESC) AS peak FROM scores GROUP BY 1""", ["scores"])
add("top_1_sorted", "s:grp i:n d6:rate",
    lambda s, d: view(s, d, "scores").groupBy("grp").agg(F.count("*").alias("n"), F.avg("y").alias("rate")).orderBy(F.desc("rate")),
    "SELECT grp, count(*) AS n, avg(y) AS rate FROM scores GROUP BY 1", ["scores"])
add("top_3_top_n", "i:o_orderkey d2:o_totalprice",
    lambda s, d: raw(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("top_5_best_trial", "s:method i:trial d6:auc", lambda s, d: _best(s, d),
    """SELECT method, trial, v AS auc FROM (SELECT method, rep AS trial, v, row_number() OVER (ORDER BY v DESC, method, rep) AS r FROM (
       """ + " UNION ALL ".join(f"""SELECT '{m}' AS method, * FROM (SELECT rep, CAST(sum(pos * (nn - fp + neg / 2e0)) AS DOUBLE) / (max(np) * CAST(max(nn) AS DOUBLE)) AS v
       FROM (SELECT *, sum(neg) OVER (PARTITION BY rep ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER (PARTITION BY rep) AS np,
       sum(neg) OVER (PARTITION BY rep) AS nn FROM (SELECT cust % 20 AS rep, {m} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY 1, 2)) GROUP BY 1)"""
                               for m in ("p", "p2")) + ")) WHERE r = 1", ["scores"])


def _best(s, d):
    out = None
    for method in ("p", "p2"):
        t = rank_metrics(view(s, d, "scores").withColumn("trial", F.col("cust") % 20), "y", method, by=["trial"]).select(
            F.lit(method).alias("method"), "trial", F.col("roc_auc").alias("auc"))
        out = t if out is None else out.unionByName(t)
    return out.orderBy(F.desc("auc"), "method", "trial").limit(1)


add("top_6_first_ids", "i:SK_ID_CURR", lambda s, d: app(s, d).select("SK_ID_CURR").orderBy("SK_ID_CURR").limit(20),
    "SELECT SK_ID_CURR FROM application ORDER BY 1 LIMIT 20", APP)


def _median_row(s, d):
    rows = view(s, d, "scores").select("grp", "id", "p")
    mid = exact_quantiles(rows, ["p"], [0.5], by=["grp"]).select("grp", F.col("q")[0].alias("median"))
    near = rows.join(mid, on="grp").withColumn("gap", F.abs(F.col("p") - F.col("median")))
    return near.groupBy("grp").agg(F.min_by("id", F.struct("gap", "id")).alias("id"), F.max("median").alias("median"))


add("top_7_median_row", "s:grp i:id d6:median", _median_row,
    """SELECT grp, id, median FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(p - median), id) AS r
       FROM scores JOIN (SELECT grp, quantile_cont(p, 0.5e0) AS median FROM scores GROUP BY 1) USING (grp)) WHERE r = 1""", ["scores"])
add("set_1_union_parts", "s:part i:rows",
    lambda s, d: make_splits(app(s, d).where("TARGET IS NOT NULL")).select(F.col("split").alias("part")).unionByName(
        app(s, d).where("TARGET IS NULL").select(F.lit("unlabelled").alias("part"))).groupBy("part").agg(F.count("*").alias("rows")),
    """SELECT part, count(*) AS rows FROM (SELECT split AS part FROM splits UNION ALL SELECT 'unlabelled' FROM application
       WHERE TARGET IS NULL) GROUP BY 1""", APP, SPLIT_SQL)


def _jaccard(s, d):
    rows = view(s, d, "scores")
    tops = [rows.orderBy(F.desc(c), "id").limit(200).agg(F.collect_list("id").alias(c)) for c in ("p", "p2")]
    both = tops[0].transform(beside, tops[1])
    shared, joined = F.size(F.array_intersect("p", "p2")), F.size(F.array_union("p", "p2"))
    return both.select(shared.alias("shared"), (shared / joined).alias("jaccard"))


_TOP = "(SELECT id FROM scores ORDER BY {} DESC, id LIMIT 200)"
add("set_4_jaccard", "i:shared d6:jaccard", _jaccard,
    f"""SELECT n AS shared, n / (400e0 - n) AS jaccard FROM (SELECT count(*) AS n FROM {_TOP.format('p')}
        JOIN {_TOP.format('p2')} USING (id))""", ["scores"])
