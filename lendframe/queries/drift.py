"""Drift between earlier and later rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators import drift
from lendframe.plans.adapters import raw, view
from lendframe.queries.profiles import NUMBERS as APP_NUMBERS, TEXTS as APP_TEXTS
from lendframe.queries.registry import add

NUMERIC = ["o_totalprice", "gap", "score"]
TEXT = ["o_orderpriority", "kind"]
_COLS = {
    "gap": "CASE WHEN o_orderkey % 9 <> 0 THEN CAST((o_orderkey * 13) % 400 AS DOUBLE) + CASE WHEN late = 1 THEN 4e1 ELSE 0e0 END END",
    "score": "o_totalprice / 5e5 * CASE WHEN late = 1 THEN 9e-1 ELSE 1e0 END",
    "kind": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN late = 1 AND o_orderkey % 5 = 0 THEN 'new kind' ELSE o_orderstatus END",
}


def sides(s, d):
    """Orders before 1999 as reference, later ones as new rows."""
    rows = raw(s, d, "orders").selectExpr(
        "*", "CASE WHEN o_orderdate >= TIMESTAMP_NTZ'1999-01-01' THEN 1 ELSE 0 END AS late")
    rows = rows.selectExpr("o_orderkey", "o_totalprice", "o_orderpriority", "late",
                           *[f"{e} AS {n}" for n, e in _COLS.items()])
    return rows.where("late = 0"), rows.where("late = 1")


_PROBS = ", ".join(f"{i / 10}e0" for i in range(1, 10))
BASE = """
dated AS (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END AS late FROM orders),
sides AS (SELECT o_orderkey, o_totalprice, o_orderpriority, late, """ + ", ".join(
    f"{e} AS {n}" for n, e in _COLS.items()) + " FROM dated)"


def numeric_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", sum((q - p) * ln(q / p)) AS psi FROM (
      SELECT greatest(sum(1 - late) / sum(sum(1 - late)) OVER (), 1e-4) AS p,
        greatest(sum(late) / sum(sum(late)) OVER (), 1e-4) AS q FROM (
        SELECT late, CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter(list_distinct(e), lambda x: x <= {c})) END AS bin
        FROM sides, (SELECT quantile_cont({c}, [{_PROBS}]) AS e FROM sides WHERE late = 0)) GROUP BY bin)"""


def text_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", sum((q - p) * ln(q / p)) AS psi FROM (
      SELECT greatest(sum(1 - late) / sum(sum(1 - late)) OVER (), 1e-4) AS p,
        greatest(sum(late) / sum(sum(late)) OVER (), 1e-4) AS q FROM (
        SELECT late, CASE WHEN {c} IS NULL THEN '(missing)' WHEN {c} NOT IN (SELECT {c} FROM sides WHERE late = 0 AND {c} IS NOT NULL)
          THEN '(unseen)' ELSE '=' || {c} END AS bin FROM sides) GROUP BY bin)"""


STATUS = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'watch' ELSE 'shift' END AS status"
add("mon_1_psi_numeric", "s:column d6:psi", lambda s, d: drift.psi_table(*sides(s, d), numeric=NUMERIC),
    " UNION ALL ".join(numeric_sql(c) for c in NUMERIC), ctes=BASE)
add("mon_1_psi_text", "s:column d6:psi", lambda s, d: drift.psi_table(*sides(s, d), text=TEXT),
    " UNION ALL ".join(text_sql(c) for c in TEXT), ctes=BASE)
add("mon_2_psi_table", "s:column,status d6:psi",
    lambda s, d: drift.psi_table(*sides(s, d), NUMERIC, TEXT).orderBy(F.desc("psi")),
    f"SELECT *, {STATUS} FROM ({' UNION ALL '.join([numeric_sql(c) for c in NUMERIC] + [text_sql(c) for c in TEXT])})",
    ctes=BASE)


def _pivot(s, d):
    long = drift.psi_table(*sides(s, d), NUMERIC, TEXT)
    return (long.withColumn("kind", F.when(F.col("column").isin(*TEXT), "text").otherwise("number"))
            .groupBy("kind").pivot("status", ["stable", "watch", "shift"]).agg(F.count(F.lit(1))).fillna(0))


add("agg_13_pivot", "s:kind i:stable,watch,shift", _pivot,
    f"""SELECT CASE WHEN "column" IN ('{"', '".join(TEXT)}') THEN 'text' ELSE 'number' END AS kind,
        count(*) FILTER (status = 'stable') AS stable, count(*) FILTER (status = 'watch') AS watch,
        count(*) FILTER (status = 'shift') AS shift
        FROM (SELECT *, {STATUS} FROM ({' UNION ALL '.join([numeric_sql(c) for c in NUMERIC] + [text_sql(c) for c in TEXT])}))
        GROUP BY 1""", ctes=BASE)


def _application(s, d):
    """Labelled applicants as reference, the others as new rows."""
    rows = view(s, d, "application")
    return rows.where("is_test = 0"), rows.where("is_test = 1")


add("mon_2_application_psi", "s:column,status d6:psi",
    lambda s, d: drift.psi_table(*_application(s, d), APP_NUMBERS, APP_TEXTS),
    f"SELECT *, {STATUS} FROM ({' UNION ALL '.join([numeric_sql(c) for c in APP_NUMBERS] + [text_sql(c) for c in APP_TEXTS])})",
    ["application"], "sides AS (SELECT *, is_test AS late FROM application)")
