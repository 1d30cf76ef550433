"""Money rule and conformal decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators import conformal, decisions, splits
from lendframe.plans.adapters import view
from lendframe.queries.registry import add
from lendframe.queries.sampling import hash_sql
from lendframe.operators.joins import beside

MARGIN, LGD = 0.10, 0.50
BREAK_EVEN = decisions.break_even_threshold(MARGIN, LGD)
GRID = [round(0.02 + 0.005 * i, 3) for i in range(117)]
GAIN = f"CASE WHEN y = 1 THEN amount * -{LGD}e0 ELSE amount * {MARGIN}e0 END"


def scores(s, d):
    return view(s, d, "scores")


def values(xs, name: str) -> str:
    return f"(SELECT unnest([{', '.join(f'{x!r}e0' for x in xs)}]) AS {name})"


add("dec_1_break_even", "i:n d6:threshold,approval_rate",
    lambda s, d: scores(s, d).agg(F.count("*").alias("n"), F.lit(BREAK_EVEN).alias("threshold"),
                                  F.avg((F.col("p") < BREAK_EVEN).cast("double")).alias("approval_rate")),
    f"""SELECT count(*) AS n, {MARGIN}e0 / ({MARGIN}e0 + {LGD}e0) AS threshold,
        avg(CASE WHEN p < {BREAK_EVEN!r}e0 THEN 1e0 ELSE 0e0 END) AS approval_rate FROM scores""", ["scores"])
add("dec_2_realised_profit", "s:grp d2:profit",
    lambda s, d: decisions.realised_profit(scores(s, d), "y", "amount", F.col("p") < BREAK_EVEN, MARGIN, LGD,
                                           by=["grp"]),
    f"SELECT grp, sum(CASE WHEN p < {BREAK_EVEN!r}e0 THEN {GAIN} ELSE 0 END) AS profit FROM scores GROUP BY 1",
    ["scores"])


def _curve(s, d):
    return decisions.profit_curve(scores(s, d), "y", "p", "amount", GRID, MARGIN, LGD)


_SWEEP = f"""sweep AS (SELECT threshold, sum(CASE WHEN p < threshold THEN {GAIN} ELSE 0 END) AS profit,
  avg(CASE WHEN p < threshold THEN 1e0 ELSE 0e0 END) AS approval_rate
  FROM scores, {values(GRID, 'threshold')} GROUP BY 1)"""
add("dec_3_profit_sweep", "d3:threshold d2:profit d6:approval_rate", _curve, "SELECT * FROM sweep",
    ["scores"], _SWEEP)
add("jn_8_grid_join", "d3:threshold i:n,bad",
    lambda s, d: scores(s, d).join(F.broadcast(s.createDataFrame([(t,) for t in GRID[::8]], "threshold double")),
                                   F.col("p") < F.col("threshold")).groupBy("threshold").agg(
        F.count("*").alias("n"), F.sum("y").alias("bad")),
    f"""SELECT threshold, count(*) AS n, sum(y) AS bad FROM scores JOIN {values(GRID[::8], 'threshold')}
        ON p < threshold GROUP BY 1""", ["scores"])


def _rules(s, d):
    """Break-even, best on the data, approve everyone."""
    best = decisions.best_threshold(_curve(s, d)).select(
        F.lit("best").alias("rule"), F.col("best_threshold").alias("threshold"), F.col("best_profit").alias("profit"))
    out = best
    for name, t in (("break-even", BREAK_EVEN), ("approve everyone", 1.0)):
        row = decisions.realised_profit(scores(s, d), "y", "amount",
                                        (F.col("p") < t) | F.lit(name == "approve everyone"), MARGIN, LGD)
        out = out.unionByName(row.select(F.lit(name).alias("rule"), F.lit(t).alias("threshold"), "profit"))
    return out


add("dec_3_rules", "s:rule d:threshold d2:profit", _rules,
    f"""(SELECT 'best' AS rule, threshold, profit FROM sweep ORDER BY profit DESC, threshold LIMIT 1)
        UNION ALL SELECT 'break-even', {BREAK_EVEN!r}e0, sum(CASE WHEN p < {BREAK_EVEN!r}e0 THEN {GAIN} ELSE 0 END) FROM scores
        UNION ALL SELECT 'approve everyone', 1e0, sum({GAIN}) FROM scores""", ["scores"], _SWEEP)
MARGINS = [round(0.02 + 0.01 * i, 2) for i in range(29)]
LGDS = [0.3, 0.5, 0.7, 0.9]
add("dec_4_sensitivity", "d2:margin,lgd d6:threshold,approval_rate",
    lambda s, d: decisions.sensitivity(scores(s, d), "p", MARGINS, LGDS),
    f"""SELECT margin, lgd, margin / (margin + lgd) AS threshold,
        avg(CASE WHEN p < margin / (margin + lgd) THEN 1e0 ELSE 0e0 END) AS approval_rate
        FROM scores, {values(MARGINS, 'margin')}, {values(LGDS, 'lgd')} GROUP BY 1, 2, 3""", ["scores"])

# ---------------------------------------------------------------- conformal
ALPHA = 0.10
ALPHAS = [round(0.02 * i, 2) for i in range(1, 16)]


def _part(s, d, part):
    return scores(s, d).where(F.col("part") == part)


def quantile_sql(score: str, table: str, alpha: str, by: str = "1") -> str:
    """Order statistic per group; alpha is an expression for 1 - alpha."""
    return f"""(SELECT g, a, coalesce(min(CASE WHEN r >= ceil((n + 1) * a) THEN s END), 1e0) AS q FROM (
      SELECT g, s, a, row_number() OVER (PARTITION BY g, a ORDER BY s) AS r, count(*) OVER (PARTITION BY g, a) AS n
      FROM (SELECT {by} AS g, {score} AS s, {alpha} AS a FROM {table})) GROUP BY 1, 2)"""


TRUE_SCORE = "CASE WHEN y = 1 THEN 1 - p ELSE p END"
CONF = "(SELECT * FROM scores WHERE part = 'conformal')"
add("top_2_order_statistic", "d6:alpha,q",
    lambda s, d: conformal.cutoffs(_part(s, d, "conformal"), F.col("p"), ALPHAS),
    " UNION ALL ".join(f"SELECT {a}e0 AS alpha, q FROM {quantile_sql('p', CONF, f'{1 - a!r}e0')}" for a in ALPHAS),
    ["scores"])


def cut_sql(alpha: float) -> str:
    both = quantile_sql(TRUE_SCORE, CONF, f"{1 - alpha!r}e0", "y")
    return f"""SELECT {alpha}e0 AS alpha, max(CASE WHEN g = 0 THEN q END) AS q_repay,
      max(CASE WHEN g = 1 THEN q END) AS q_default FROM {both}"""


CUTS = f"cuts AS ({cut_sql(ALPHA)})"
ALL_CUTS = "cuts AS (" + " UNION ALL ".join(cut_sql(a) for a in ALPHAS) + ")"
DECIDE = """CASE WHEN p <= q_repay AND NOT 1 - p <= q_default THEN 'approve'
  WHEN 1 - p <= q_default AND NOT p <= q_repay THEN 'decline' ELSE 'refer' END"""


def rates_sql() -> str:
    def r(cond, inside):
        return f"avg(CASE WHEN {inside} THEN CASE WHEN {cond} THEN 1e0 ELSE 0e0 END END)"
    return f"""{r('p <= q_repay', 'y = 0')} AS coverage_repay, {r('1 - p <= q_default', 'y = 1')} AS coverage_default,
      {r("d = 'approve'", 'y = 1')} AS defaulters_approved, {r("d = 'decline'", 'y = 0')} AS good_declined,
      {', '.join(f"{r(f'''d = '{k}' ''', 'true')} AS share_{k}" for k in ('approve', 'refer', 'decline'))}"""


RATES = "d6:coverage_repay,coverage_default,defaulters_approved,good_declined,share_approve,share_refer,share_decline"


def with_cuts(s, d):
    cuts = conformal.class_cutoffs(_part(s, d, "conformal"), "y", "p", [ALPHA])
    return _part(s, d, "valid").transform(beside, cuts)


add("dec_5_class_cutoffs", "d6:alpha,q_repay,q_default",
    lambda s, d: conformal.class_cutoffs(_part(s, d, "conformal"), "y", "p", ALPHAS),
    "SELECT * FROM cuts", ["scores"], ALL_CUTS)
add("dec_6_decide", "i:id s:decision",
    lambda s, d: with_cuts(s, d).select("id", conformal.decide(
        F.col("p"), F.col("q_repay"), F.col("q_default")).alias("decision")),
    f"SELECT id, {DECIDE} AS decision FROM scores, cuts WHERE part = 'valid'", ["scores"], CUTS)
add("dec_7_coverage", RATES, lambda s, d: conformal.outcome_rates(with_cuts(s, d), "y", "p"),
    f"SELECT {rates_sql()} FROM (SELECT *, {DECIDE} AS d FROM scores, cuts WHERE part = 'valid')",
    ["scores"], CUTS)


def _one_cut(s, d):
    cut = conformal.one_cutoff(_part(s, d, "conformal"), "y", "p", [ALPHA])
    return conformal.outcome_rates(_part(s, d, "valid").transform(beside, cut), "y", "p",
                                   by=["q_repay"])


add("dec_8_one_cutoff", "d6:q_repay " + RATES, _one_cut,
    f"""SELECT q_repay, {rates_sql()} FROM (SELECT *, {DECIDE} AS d FROM scores,
        (SELECT q AS q_repay, q AS q_default FROM {quantile_sql(TRUE_SCORE, CONF, f'{1 - ALPHA!r}e0')})
        WHERE part = 'valid') GROUP BY 1""", ["scores"])
add("dec_9_alpha_sweep", "d2:alpha d6:q_repay,q_default " + RATES,
    lambda s, d: conformal.alpha_sweep(_part(s, d, "conformal"), _part(s, d, "valid"), "y", "p", ALPHAS),
    f"""SELECT alpha, q_repay, q_default, {rates_sql()} FROM (SELECT *, {DECIDE} AS d FROM scores, cuts
        WHERE part = 'valid') GROUP BY 1, 2, 3""", ["scores"], ALL_CUTS)
add("dec_10_money_cross", "s:conformal,money_rule i:n d6:share,default_rate",
    lambda s, d: conformal.cross_with_money_rule(with_cuts(s, d), "y", "p", BREAK_EVEN),
    f"""SELECT conformal, money_rule, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scores
        WHERE part = 'valid') AS share, avg(y) AS default_rate FROM (SELECT y, {DECIDE} AS conformal,
        CASE WHEN p < {BREAK_EVEN!r}e0 THEN 'approve' ELSE 'decline' END AS money_rule
        FROM scores, cuts WHERE part = 'valid') GROUP BY 1, 2""", ["scores"], CUTS)
add("spl_5_coverage_stability", "s:method i:repeat " + RATES,
    lambda s, d: conformal.half_split_stability(
        splits.half_splits(_part(s, d, "conformal").select("id", "y", "p"), "id", 100), "y", "p", ALPHA),
    f"""SELECT method, repeat, {rates_sql()} FROM (SELECT *, {DECIDE} AS d FROM halves JOIN (
          SELECT 'one per class' AS method, repeat, max(CASE WHEN g % 2 = 0 THEN q END) AS q_repay,
            max(CASE WHEN g % 2 = 1 THEN q END) AS q_default
          FROM (SELECT *, g // 2 AS repeat FROM {quantile_sql(TRUE_SCORE, '(SELECT * FROM halves WHERE fit = 1)', f'{1 - ALPHA!r}e0', 'repeat * 2 + y')}) GROUP BY 2
          UNION ALL SELECT 'one for everyone', g, q, q
          FROM {quantile_sql(TRUE_SCORE, '(SELECT * FROM halves WHERE fit = 1)', f'{1 - ALPHA!r}e0', 'repeat')}) USING (repeat)
        WHERE fit = 0) GROUP BY 1, 2""", ["scores"],
    f"""halves AS (SELECT id, y, p, repeat, CASE WHEN substr({' || '.join(hash_sql('id', f'42:{b}') for b in range(4))}, CAST(repeat AS INT), 1) < '8'
        THEN 1 ELSE 0 END AS fit FROM scores, range(1, 101) t(repeat) WHERE part = 'conformal')""")
