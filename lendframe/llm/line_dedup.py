"""Repeated runs of lines, found with a suffix array over line ids, in DataFrame operations only.

Suffixes of the documents' line sequences are ordered by prefix doubling: the rank of 2h lines is
the rank of the pair (rank of h lines here, rank of h lines further on). Ranks are group starts in
the suffix array, numbered by a range sort whose parts add up their sizes. A suffix whose first h
lines occur once has no partner and leaves; doubling goes on until no group is left. The groups of
a level of h lines are the intervals of the array in which the longest common prefix is at least h.
In every interval the first place stays. A later place is read off the deepest interval in which it
is one, as a run of as many lines; runs that touch unite to the maximal repeated runs. A line of many
words can be a run by itself: these lines are compared by their ids alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm.tables import keyed, written

MIN_LINES = 2
#: A single line of so many words is a run in `cleaned`; op8's SQL twin counts lines only.
MIN_WORDS = 50
_PLACE = ["doc_id", "th", "seq"]


def _numbered(groups: DataFrame, name: str) -> DataFrame:
    """groups (a, b, n, first) with rank: how many suffixes are smaller than those of the group."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = written(groups.repartitionByRange(parts, "a", "b").withColumn("part", F.spark_partition_id()), name)
    # one row a part; their number is that of the shuffle partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lined.groupBy("part").agg(F.sum("n").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    return lined.join(starts, "part").select(
        "a", "b", "first", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("rank"))


def _paired(ranks: DataFrame, step: int) -> DataFrame:
    """Each suffix with the rank of the one `step` lines on; a run that leaves the document has no partner."""
    on = Window.partitionBy("doc_id", "th").orderBy("seq").rangeBetween(step, step)
    return ranks.select(*_PLACE, F.col("rank").alias("a"), F.max("rank").over(on).alias("b")).where("b IS NOT NULL")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups of more than one row, with the first place of each."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1")


def _not_first() -> Column:
    return ~F.struct(*_PLACE).eqNullSafe(F.col("first"))


def later_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, th, seq, line): the (doc_id, th, seq) of lines that also come earlier."""
    return lines.join(_repeated(lines, "line"), "line").where(_not_first()).select(*_PLACE)


def later_runs(lines: DataFrame, min_lines: int) -> DataFrame:
    """lines (doc_id, th, seq, line): the (doc_id, th, seq) where min_lines lines start that also start earlier, with size.

    size: how many lines of the run are known to start earlier, by the deepest level at which they do: min_lines
    times a power of two.
    """
    # ids of lines that occur once are never part of a repeat
    ranks = written(lines.join(_repeated(lines, "line"), "line").select(
        *_PLACE, F.col("line").alias("rank"), _not_first().alias("later")), "line-ids")
    depth, levels = 1, []
    while True:
        if depth >= min_lines:
            levels.append(ranks.where("later").select(*_PLACE, F.lit(depth).alias("size")))
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        pairs = written(_paired(ranks, step), "pairs")
        order = _numbered(_repeated(pairs, "a", "b"), "order")
        ranks = written(pairs.join(order, ["a", "b"]).select(*_PLACE, "rank", _not_first().alias("later")), "ranks")
        depth += step
        if ranks.isEmpty():  # no group is left: the order is that of whole suffixes
            break
    if not levels:
        return lines.select(*_PLACE, F.lit(min_lines).alias("size")).limit(0)
    return reduce(DataFrame.unionByName, levels).groupBy(*_PLACE).agg(F.max("size").alias("size"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """One row per document row: doc_id, th, n_lines, n_removed, text (what is left).

    Lines end at line feeds; lines are equal when they are so without blanks around them. Blank lines
    take no part: they stay and don't break a run. A run of `min_lines` or more lines that also starts
    earlier (smaller doc_id, or earlier in the document) is removed; with `min_words`, so is a single
    line of that many words (parts between white space). Documents with one id are ordered
    by a hash of their text, a null id is the smallest, rows repeated with id and text are one document.
    A null or empty text has one blank line and stays empty.
    """
    if min_lines < 1 or min_words is not None and min_words < 1:
        raise ValueError("min_lines and min_words must be positive")
    rows = keyed(docs, id_col, text_col)
    trimmed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("pos")))
    full = F.filter(trimmed, lambda x: x["t"] != "")
    ids = F.transform(full, lambda x, i: F.struct(F.xxhash64(x["t"], F.length(x["t"])).alias("line"), x["pos"].alias("pos"),
                                                  i.alias("seq")))
    places = rows.select("doc_id", "th", F.explode(ids).alias("x")).select("doc_id", "th", "x.*")
    later = later_runs(places.select("doc_id", "th", "seq", "line"), min_lines)
    if min_words is not None and min_lines > 1:
        # the first place of a line is in no later run, so one copy of each stays
        long = F.filter(F.transform(full, lambda x, i: F.struct(x["t"].alias("t"), i.alias("seq"))),
                        lambda x: F.size(F.filter(F.split(x["t"], r"[\x20\x09-\x0D]+"), lambda w: w != "")) >= min_words)
        wordy = rows.select("doc_id", "th", F.explode(long).alias("x")).select(
            "doc_id", "th", "x.seq", F.xxhash64("x.t", F.length("x.t")).alias("line"))
        later = later.unionByName(later_lines(wordy).withColumn("size", F.lit(1)))
    # places of removed runs, joined where they touch
    spans = F.array_sort(F.collect_set(F.struct(F.col("seq").alias("a"), (F.col("seq") + F.col("size")).alias("b"))))
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        touch = (F.size(acc) > 0) & (last["b"] >= s["a"])
        grown = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when(touch, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
                      ).otherwise(F.concat(acc, F.array(s)))

    runs = later.groupBy("doc_id", "th").agg(spans.alias("spans")).select(
        F.col("doc_id").alias("r_doc"), F.col("th").alias("r_th"), F.aggregate("spans", empty, add).alias("runs"))
    both = rows.join(runs, rows["doc_id"].eqNullSafe(runs["r_doc"]) & (rows["th"] == runs["r_th"]), "left")
    parts = F.split("text", "\n")
    # a line goes by its place among the lines that are not blank
    numbered = F.aggregate(
        parts, F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.struct(
            (acc["k"] + F.when(F.trim(x) != "", 1).otherwise(0)).alias("k"),
            F.when((F.trim(x) != "") & F.exists("runs", lambda r: (r["a"] <= acc["k"]) & (acc["k"] < r["b"])), acc["kept"])
            .otherwise(F.concat(acc["kept"], F.array(x))).alias("kept")),
        lambda acc: acc["kept"])
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(numbered, "\n"))
    lost = F.aggregate("runs", F.lit(0), lambda n, r: n + r["b"] - r["a"])
    return both.select("doc_id", "th", F.size(full).cast("long").alias("n_lines"),
                       F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"), kept.alias("text"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
            min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """All document rows in their own columns, the text without repeated runs and `chars_col` (if there) its length.

    Rows that lose nothing stay as they are, a null text too. Rows repeated with id and text get the same
    answer; no rows give no rows. Column names of the documents can't clash with inner ones.
    """
    found = without_repeated_lines(docs, id_col, text_col, min_lines, min_words).where("n_removed > 0").select(
        F.col("doc_id").alias("_line_id"), F.col("th").alias("_line_th"), F.col("text").alias("_line_text")
    ).dropDuplicates(["_line_id", "_line_th"])
    found = written(found, "cleaned-lines")
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    both = docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_line_id"]) & (th == found["_line_th"]), "left")
    new = found["_line_text"]
    changed = new.isNotNull()
    out = [F.when(changed, new).otherwise(docs[c]).alias(c) if c == text_col
           else F.when(changed, F.length(new).cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c)
           if c == chars_col else docs[c] for c in docs.columns]
    return both.select(*out)
