"""Secrets in text: three fixed patterns, and a randomness test battery, in DataFrame operations only.

A run of 20 or more key characters is a candidate. Its encoding is the smallest alphabet that holds
it. Three tests ask whether its symbols look drawn at random from that alphabet: chi-squared of the
symbol counts, runs above and below the middle of the alphabet, and the correlation of neighbours.
What passes is set against ordinary text: a fixed chain over letter pairs and changes between
letters, digits and signs gives the likelihood of the candidate as text, and its ratio to the uniform
likelihood bounds the tail probability. (Digits alone have no such chain; for them it is the tail of
the chi-squared statistic at the concentration of text.) The probabilities go through a
Benjamini-Hochberg cut for each encoding and length class, read off a table of logarithmic bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm.tables import keyed, written

# The base patterns. The first is matched with letters in either case.
_WORDS = "password passwd secret token api_?key".split()
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: Highest share of false finds among the added spans, and the deviations a random string may show.
FALSE_SHARE, DEVIATIONS = 0.05, 3.0
#: Sum of squared symbol shares in ordinary text (English letters).
TEXT_CONCENTRATION = 0.065
_BINS = 50.0  # a factor of e

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [("^[0-9]+$", _DIGITS), ("^[0-9a-f]+$", _DIGITS + "abcdef"), ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
             ("^[a-z]+$", _LOWER), ("^[A-Z]+$", _LOWER.upper()), ("^[A-Z2-7]+$", _LOWER.upper() + "234567"),
             ("^[a-z0-9]+$", _DIGITS + _LOWER), ("^[A-Z0-9]+$", _DIGITS + _LOWER.upper()),
             ("^[A-Za-z0-9]+$", _DIGITS + _LOWER.upper() + _LOWER),
             (".", _LOWER.upper() + _LOWER + _DIGITS + "+/-_")]

#: Lengths from which the classes of the cut begin.
LENGTHS = [24, 32, 40, 64]

# English letters, and letters after a letter (a to z), as quarters of -ln p ("a" is 0).
_LETTERS = "lqnnjoqolvtmollovllkosrtqv"
_PAIRS = " ".join([
    "qomnosptmztjliqozikiqsuurz kuprhtttklxjtqlrzmmojxxxkx kvqshsvkmznlsqgtznpjowwyuz ktrnesuthyxptqktznnonuvxsz",
    "mtmlmnstpzwkojqpuijktstnsz lvrqlmuuhzyntqgszjokmxuyrz nvqsgtsjkzynqknozkjomuwyvw ivssetvtjzxrtqjtzoqkrxwyvz",
    "oplpmlouqzwmnhkqzojjtqxuwt lvpsdtvtnwsrtqiqzqppjxvyvz lvqpesrskzwmtmnqyokopvmyuy kusohjtuhzxltqlszqlmmvwypz",
    "hosrftvukzxqoqjjzqmooxwyuz kvljiqktnztqtpjszqkipswyqz qpololstpztonhpmzhmkmqqwvz ivrqhsvrmzwktqjmzioknuvylz",
    "qussotvuqzyquppqynppcwwywz kupqgrotjzsrolkrzmllptuypz nvpsfssokzvqsqlozpkhnwvyqz kvrrisvhizyqsqkrzkmnmxqyoy",
    "onopjqsunzxkmjpmzijitxxwwz gvssdtvtjzyssqotzqqptxvxwz hvsqjsvkgzypunktzknptxqxwz lthrkqvslzyprqpjzqpftxwrsx",
    "ptrrlsttmzyppnjhzijjsvqyux lvssdsvqjzyoqpmtzqppsxvytr"]).split()
# Shares of the next class (upper, lower, digit, sign) after each class, and at the start.
_FOLLOW = [[.58, .34, .03, .05], [.04, .89, .02, .05], [.05, .05, .80, .10], [.15, .70, .10, .05], [.25, .60, .10, .05]]
_SYMBOLS = ALPHABETS[-1][1]


def _text_table() -> list[float]:
    """ln p of each symbol of _SYMBOLS after the start and after each symbol: rows of 66."""
    def shares(codes: str) -> list[float]:
        p = [math.exp((ord("a") - ord(c)) / 4) for c in codes]
        return [x / sum(p) for x in p]

    first, after = shares(_LETTERS), [shares(r) for r in _PAIRS]
    kind = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4
    out = []
    for before in range(-1, 66):
        old = 4 if before < 0 else kind[before]
        for k, new in enumerate(kind):
            letter = after[before % 26] if old < 2 else first
            out.append(math.log(_FOLLOW[old][new] * (letter[k % 26] if new < 2 else 0.1 if new == 2 else 0.25)))
    return out


def _matches(text: Column, pattern: str, extra: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), value being group `extra`.

    The text between matches comes from a split at the pattern; lengths add up to places.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(extra)).alias("value"))
    none = "array<struct<start:int,end:int,value:string>>"

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        new = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(new))).alias("out"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("out")), add, lambda a: a["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(none))


def _kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def _normal_tail(z: Column) -> Column:
    """P(Z < z), by the logistic approximation."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _battery(rows: DataFrame) -> DataFrame:
    """rows with candidates c (start, end, value): tests of each as (start, end, random, stratum, p)."""
    alphabet = "CASE " + " ".join(f"WHEN c.value RLIKE '{p}' THEN '{s}'" for p, s in ALPHABETS) + " END"
    table = "CAST(split('" + " ".join(f"{x:.5f}" for x in _text_table()) + "', ' ') AS array<double>)"
    stratum = ("CASE " + " ".join(f"WHEN c.value RLIKE '{p}' THEN {k}" for k, (p, _) in enumerate(ALPHABETS)) + f" END * {len(LENGTHS) + 1}"
               + "".join(f" + IF(length(c.value) >= {n}, 1, 0)" for n in LENGTHS))
    one = f"""transform(candidates, c -> named_struct('start', c.start, 'end', c.end, 'token', c.value,
        'n', CAST(length(c.value) AS DOUBLE), 'alphabet', {alphabet}, 'stratum', {stratum}))"""
    values = f"""transform(items, c -> named_struct('start', c.start, 'end', c.end, 'stratum', c.stratum,
        'text', aggregate(filter(split(c.token, ''), x -> x <> ''), named_struct('last', 0, 'sum', 0D), (s, x) -> named_struct(
            'last', locate(x, '{_SYMBOLS}'), 'sum', s.sum + element_at({table}, s.last * 66 + locate(x, '{_SYMBOLS}'))), s -> s.sum),
        'n', c.n, 'a', CAST(length(c.alphabet) AS DOUBLE),
        'square', aggregate(array_distinct(split(c.token, '')), 0D, (s, x) ->
            s + CASE WHEN x = '' THEN 0D ELSE power(c.n - length(replace(c.token, x, '')), 2) END),
        'v', transform(filter(split(c.token, ''), x -> x <> ''), x -> CAST(locate(x, c.alphabet) AS DOUBLE))))"""
    sums = """transform(items, c -> named_struct('start', c.start, 'end', c.end, 'stratum', c.stratum, 'text', c.text, 'n', c.n, 'a', c.a,
        'chi', c.a * c.square / c.n - c.n,
        'high', CAST(size(filter(c.v, x -> x * 2 > c.a)) AS DOUBLE),
        'runs', aggregate(c.v, named_struct('last', -1, 'runs', 0D), (s, x) -> named_struct(
            'last', IF(x * 2 > c.a, 1, 0), 'runs', s.runs + IF(s.last = IF(x * 2 > c.a, 1, 0), 0, 1)), s -> s.runs),
        'm', aggregate(c.v, 0D, (s, x) -> s + x) / c.n, 'v', c.v))"""
    serial = """transform(items, c -> named_struct('start', c.start, 'end', c.end, 'stratum', c.stratum, 'text', c.text, 'n', c.n, 'a', c.a, 'chi', c.chi,
        'high', c.high, 'runs', c.runs,
        'spread', aggregate(c.v, 0D, (s, x) -> s + (x - c.m) * (x - c.m)),
        'along', aggregate(c.v, named_struct('last', CAST(NULL AS DOUBLE), 'sum', 0D), (s, x) -> named_struct(
            'last', x, 'sum', s.sum + coalesce((s.last - c.m) * (x - c.m), 0D)), s -> s.sum)))"""
    mean_runs = "(2 * c.high * (c.n - c.high) / c.n + 1)"
    share = f"greatest({TEXT_CONCENTRATION}D, 2 / c.a)"
    # one of the alphabets was picked, so the bound takes their number as a factor
    z = f"""transform(items, c -> named_struct('start', c.start, 'end', c.end, 'stratum', c.stratum,
        'ratio', c.text + c.n * ln(c.a) + ln({len(ALPHABETS)}),
        'z_chi', (c.chi - (c.a - 1)) / sqrt(2 * (c.a - 1) * (c.n - 1) / c.n),
        'z_runs', coalesce((c.runs - {mean_runs}) / nullif(sqrt(greatest(({mean_runs} - 1) * ({mean_runs} - 2) / (c.n - 1), 0D)), 0D), 99D),
        'z_serial', coalesce(c.along / nullif(c.spread, 0D) * sqrt(c.n), 99D),
        'z_text', (c.chi - (c.a * (1 + (c.n - 1) * {share}) - c.n))
                  / (c.a / c.n * sqrt(2 * power(c.n, 3) * power({share}, 2) + 2 * power(c.n, 2) * {share}))))"""
    for step in (one, values, sums, serial, z):
        rows = rows.withColumn("items", F.expr(step))
    return rows.withColumn("items", F.transform("items", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"),
        ((F.abs(c["z_chi"]) < DEVIATIONS) & (F.abs(c["z_runs"]) < DEVIATIONS) & (F.abs(c["z_serial"]) < DEVIATIONS)).alias("random"),
        c["stratum"].alias("stratum"),
        F.when(c["stratum"] <= len(LENGTHS), _normal_tail(c["z_text"])).otherwise(F.exp(F.least(c["ratio"], F.lit(0.0)))).alias("p"))))


def found_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per document row: doc_id and spans, an array of (start, kind, end) by start.

    Places are code points, ends exclusive; kinds are numbered as KINDS. A null text is empty. Base
    spans always stay; a random span that overlaps one is left out. Repeated rows get the same answer,
    but each counts in the false-discovery cut. No documents: no rows.
    """
    rows = keyed(docs, id_col, text_col)
    assign = F.filter(_matches(F.col("text"), ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    rows = rows.select("doc_id", F.array_sort(F.concat(_kind(assign, 0), _kind(_matches(F.col("text"), ACCESS), 1),
                                                       _kind(_matches(F.col("text"), HEX), 2))).alias("base"),
                       _matches(F.col("text"), CANDIDATE).alias("candidates"))
    tested = written(_battery(rows).select("doc_id", "base", F.filter("items", lambda c: ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))).alias("items")), "tested")

    step = F.floor(F.log(F.greatest("x.p", F.lit(1e-15))) * _BINS).cast("int")
    bins = tested.select(F.explode("items").alias("x")).groupBy("x.stratum", step.alias("bin")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("x.random"), 1)).alias("r"))
    # at most 35 * _BINS rows a stratum
    upto = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select("stratum", "bin", F.sum("r").over(upto).alias("rank"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    cuts = ranked.where(F.exp((F.col("bin") + 1) / _BINS) <= false_share * F.col("rank") / F.col("all")).groupBy("stratum").agg(
        F.max("bin").alias("cut"))
    # at most as many entries as there are alphabets times length classes
    cuts = cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("cuts"))
    added = F.filter("items", lambda c: c["random"] & (
        F.floor(F.log(F.greatest(c["p"], F.lit(1e-15))) * _BINS) <= F.try_element_at("cuts", c["stratum"])))
    return tested.crossJoin(F.broadcast(cuts)).select(  # one row
        "doc_id", F.array_sort(F.concat("base", _kind(F.coalesce(added, F.array().cast(tested.schema["items"].dataType)), 3))).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
