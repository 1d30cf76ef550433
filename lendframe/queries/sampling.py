"""Splits, samples and rank windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators import splits
from lendframe.operators.ranking import hash_rank
from lendframe.plans.adapters import view
from lendframe.queries.registry import add


def hash_sql(key: str, seed) -> str:
    return f"md5(concat(CAST({key} AS VARCHAR), ':{seed}'))"


def hex_sql(text: str, start: int = 1, digits: int = 8) -> str:
    return f"CAST('0x' || substr({text}, {start}, {digits}) AS BIGINT)"


def _labelled(s, d):
    return view(s, d, "application").where("TARGET IS NOT NULL")


_CUM = [0.20, 0.20 + 0.10, 0.20 + 0.10 + 0.10]
SPLIT_SQL = f"""
ranked AS (SELECT SK_ID_CURR, TARGET, CODE_GENDER,
    row_number() OVER (PARTITION BY TARGET ORDER BY {hash_sql('SK_ID_CURR', 42)}, SK_ID_CURR) AS r,
    count(*) OVER (PARTITION BY TARGET) AS n
  FROM application WHERE TARGET IS NOT NULL AND CODE_GENDER <> 'XNA'),
cut AS (SELECT *, {', '.join(f'floor(n * {c!r}e0 + 0.5e0) AS c{i}' for i, c in enumerate(_CUM))} FROM ranked),
splits AS (SELECT SK_ID_CURR, TARGET, CODE_GENDER,
    CASE WHEN r <= c0 THEN 'test' WHEN r <= c1 THEN 'conformal' WHEN r <= c2 THEN 'valid' ELSE 'train' END AS split,
    CASE WHEN r > c2 THEN CAST(r - c2 - 1 AS BIGINT) % 5 + 1 ELSE -1 END AS fold FROM cut)"""

add("spl_1_make_splits", "i:SK_ID_CURR,TARGET,fold s:split",
    lambda s, d: splits.make_splits(_labelled(s, d)), "SELECT * FROM splits",
    views=["application"], ctes=SPLIT_SQL)


def _split_summary(by):
    def run(s, d):
        made = splits.make_splits(_labelled(s, d))
        gender = view(s, d, "application").select("SK_ID_CURR", "CODE_GENDER")
        return splits.summarize(made.join(gender, on="SK_ID_CURR"), by=by,
                                women=(F.col("CODE_GENDER") == "F").cast("double"))
    return run


def _summary_sql(by):
    return f"""SELECT {by}, count(*) AS rows, 100e0 * count(*) / (SELECT count(*) FROM splits) AS share_pct,
      100e0 * avg(TARGET) AS default_rate_pct,
      100e0 * avg(CASE WHEN CODE_GENDER = 'F' THEN 1e0 ELSE 0e0 END) AS women_pct
      FROM splits GROUP BY 1"""


add("agg_9_split_summary", "s:split i:rows d1:share_pct,women_pct d2:default_rate_pct",
    _split_summary("split"), _summary_sql("split"), views=["application"], ctes=SPLIT_SQL)
add("agg_9_fold_summary", "i:fold,rows d1:share_pct,women_pct d2:default_rate_pct",
    _split_summary("fold"), _summary_sql("fold"), views=["application"], ctes=SPLIT_SQL)

add("spl_2_sample_rows", "i:id,y d:p",
    lambda s, d: splits.sample_rows(view(s, d, "scores"), "id", share=0.1, seed=7),
    f"""SELECT id, y, p FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('id', 7)}, id) AS r,
        count(*) OVER () AS n FROM scores) WHERE r <= floor(n * 0.1e0 + 0.5e0)""", views=["scores"])
_SHARES = [0.02, 0.05, 0.1, 0.25, 0.5, 1.0]
add("spl_2_nested_shares", "i:id d2:first_share",
    lambda s, d: splits.nested_shares(view(s, d, "scores").select("id"), "id", _SHARES, seed=7),
    f"""SELECT id, CASE {' '.join(f'WHEN r <= floor(n * {x}e0 + 0.5e0) THEN {x}e0' for x in _SHARES)} END AS first_share
        FROM (SELECT id, row_number() OVER (ORDER BY {hash_sql('id', 7)}, id) AS r,
        count(*) OVER () AS n FROM scores)""", views=["scores"])
add("spl_3_undersample", "i:id,y d:p",
    lambda s, d: splits.undersample(view(s, d, "scores"), "id", "y", ratio=0.8, seed=3),
    f"""SELECT id, y, p FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql('id', 3)}, id) AS r
        FROM scores) WHERE y = 1 OR r <= (SELECT floor(sum(y) / 0.8e0) FROM scores)""", views=["scores"])
add("spl_5_half_splits", "i:repeat,n,fit_rows,fit_bad",
    lambda s, d: splits.half_splits(view(s, d, "scores").select("id", "y"), "id", 100).groupBy("repeat").agg(
        F.count("*").alias("n"), F.sum("fit").alias("fit_rows"),
        F.sum(F.col("fit") * F.col("y")).alias("fit_bad")),
    f"""SELECT repeat, count(*) AS n, sum(fit) AS fit_rows, sum(fit * y) AS fit_bad FROM (
        SELECT y, repeat, CASE WHEN substr({' || '.join(hash_sql('id', f'42:{b}') for b in range(4))}, CAST(repeat AS INT), 1) < '8'
          THEN 1 ELSE 0 END AS fit FROM scores, range(1, 101) t(repeat)) GROUP BY 1""", views=["scores"])
add("spl_7_two_fold_five_times", "i:repeat,id,fold",
    lambda s, d: _two_fold(s, d),
    " UNION ALL ".join(f"""SELECT {i} AS repeat, id, (row_number() OVER (PARTITION BY y ORDER BY
        {hash_sql('id', 42 + i)}, id) - 1) % 2 AS fold FROM scores""" for i in range(5)), views=["scores"])


def _two_fold(s, d):
    rows = view(s, d, "scores").select("id", "y")
    out = None
    for i in range(5):
        part = hash_rank(rows, "id", by=["y"], seed=42 + i).select(
            F.lit(i).alias("repeat"), "id", ((F.col("hash_rank") - 1) % 2).alias("fold"))
        out = part if out is None else out.unionByName(part)
    return out


add("win_9_rank_in_stratum", "s:grp i:id,hash_rank,group_rows",
    lambda s, d: hash_rank(view(s, d, "scores").select("grp", "id"), "id", by=["grp"], seed=1),
    f"""SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY {hash_sql('id', 1)}, id) AS hash_rank,
        count(*) OVER (PARTITION BY grp) AS group_rows FROM scores""", views=["scores"])
