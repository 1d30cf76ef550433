"""Sources and sinks: every query writes and reads back through a fresh folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators.splits import make_splits
from lendframe.plans import application
from lendframe.plans.adapters import raw, view
from lendframe.queries.registry import add
from lendframe.queries.sampling import SPLIT_SQL, hash_sql
from lendframe.session import fresh_folder
from lendframe.sources import tables

APP = ["application"]


def folder(spark) -> str:
    return fresh_folder(spark, "tables")


def _csv(s, d):
    path = f"{folder(s)}/orders"
    orders = raw(s, d, "orders")
    orders.write.option("header", True).csv(path)
    return tables.read_csv(s, path, orders.schema)


add("src_1_csv_scan", "i:o_orderkey,o_custkey d2:o_totalprice s:o_orderstatus", _csv,
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")


def _converted(s, d):
    base = folder(s)
    raw(s, d, "customer").write.option("header", True).csv(f"{base}/raw/customer.csv")
    first = tables.convert_all(s, f"{base}/raw", f"{base}/out", {"customer": "customer.csv"})
    second = tables.convert_all(s, f"{base}/raw", f"{base}/out", {"customer": "customer.csv"})
    return tables.read_parquet(s, f"{base}/out/customer").agg(F.count("*").alias("rows")).withColumns(
        {"first": F.lit(len(first)), "second": F.lit(len(second))})


add("src_2_convert_all", "i:rows,first,second", _converted,
    "SELECT count(*) AS rows, 1 AS first, 0 AS second FROM customer")


def _types(s, d):
    types = tables.narrow_types(raw(s, d, "lineitem"))
    rows = raw(s, d, "lineitem").agg(F.count("*").alias("rows"))
    return rows.select("rows", F.explode(F.create_map(*[F.lit(x) for kv in types.items() for x in kv])).alias("column", "type"))


def _type_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768
      THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS type, count(*) AS rows FROM lineitem"""


add("src_3_narrow_types", "i:rows s:column,type", _types,
    " UNION ALL ".join([_type_sql(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
                       + [f"SELECT '{c}', 'float', count(*) FROM lineitem" for c in
                          ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
add("src_4_column_scan", "i:l_orderkey d:l_quantity",
    lambda s, d: tables.read_parquet(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"]),
    "SELECT l_orderkey, l_quantity FROM lineitem")


def _feature_sink(s, d):
    path = f"{folder(s)}/features"
    tables.shrink(application.application_features(view(s, d, "application", spread=True))).write.parquet(path)
    return tables.read_parquet(s, path, ["SK_ID_CURR", "APP_DOC_COUNT", "APP_AGE_YEARS"])


add("src_5_feature_sink", "i:SK_ID_CURR,APP_DOC_COUNT d2:APP_AGE_YEARS", _feature_sink,
    "SELECT SK_ID_CURR, " + " + ".join(application.DOCUMENTS) + """ AS APP_DOC_COUNT,
     CAST(CAST(-DAYS_BIRTH / 365.25e0 AS FLOAT) AS DOUBLE) AS APP_AGE_YEARS FROM application""", APP)


def _frozen(s, d):
    path = f"{folder(s)}/splits"
    rows = view(s, d, "application").where("TARGET IS NOT NULL")
    tables.write_frozen(make_splits(rows), path)
    tables.write_frozen(make_splits(rows, seed=1), path)  # refused: the split stays frozen
    return tables.read_parquet(s, path)


add("src_6_frozen_splits", "i:SK_ID_CURR,TARGET,fold s:split", _frozen, "SELECT * FROM splits", APP, SPLIT_SQL)


def _scores_sink(s, d):
    path = f"{folder(s)}/scores"
    rows = view(s, d, "scores").select("id", "y", "p")
    tables.run_or_load(s, path, "first", lambda: rows)
    return tables.load_scores(s, path, "first", rows.select("id"))


add("src_7_score_store", "i:id,y d6:p", _scores_sink, "SELECT id, y, p FROM scores", ["scores"])


def _report(s, d):
    path = f"{folder(s)}/report"
    tables.write_report(view(s, d, "scores").groupBy("grp").agg(F.count("*").alias("n"), F.avg("y").alias("rate")), path)
    return tables.read_csv(s, path, "grp string, n long, rate double")


add("src_8_csv_report", "s:grp i:n d6:rate", _report, "SELECT grp, count(*) AS n, avg(y) AS rate FROM scores GROUP BY 1",
    ["scores"])


def _artefact(s, d):
    path = f"{folder(s)}/decision"
    rate = view(s, d, "scores").agg(F.avg("y")).first()[0]
    tables.write_json(s, {"margin": 0.1, "lgd": 0.5, "threshold": 0.1 / 0.6, "rate": rate}, path)
    back = tables.read_json(s, path)
    return s.createDataFrame([(back["margin"], back["lgd"], back["threshold"], back["rate"])],
                             "margin double, lgd double, threshold double, rate double")


add("src_9_json_artefact", "d:margin,lgd,threshold,rate", _artefact,
    "SELECT 0.1e0 AS margin, 0.5e0 AS lgd, 0.1e0 / 0.6e0 AS threshold, avg(y) AS rate FROM scores", ["scores"])


def _bundle(s, d):
    rows = view(s, d, "application")
    return tables.demo_bundle(application.application_features(rows), rows.drop("TARGET", "is_test"), n=50)


add("src_11_demo_bundle", "i:SK_ID_CURR d:APP_AMT_CREDIT,RAW__AMT_INCOME_TOTAL", _bundle,
    f"""SELECT SK_ID_CURR, AMT_CREDIT AS APP_AMT_CREDIT, AMT_INCOME_TOTAL AS RAW__AMT_INCOME_TOTAL FROM application
        WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM application WHERE is_test = 1 ORDER BY {hash_sql('SK_ID_CURR', 42)}, SK_ID_CURR LIMIT 50)""",
    APP)


def _stored_types(s, d):
    stored = raw(s, d, "lineitem").selectExpr("CAST(l_quantity AS SMALLINT) AS l_quantity", "l_tax").schema
    return tables.cast_like(raw(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax"), stored)


add("prj_20_stored_types", "i:l_orderkey,l_quantity d:l_tax", _stored_types,
    "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
