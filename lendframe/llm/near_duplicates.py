"""N-gram Jaccard self join with Bayesian pruning of candidates.

Documents with the same set of word n-grams are one class; classes are compared, not copies. Classes
that agree on one of the MinHash bands are candidates. A bucket of a band is dealt out in tiles of
two blocks, so that a bucket that holds a third of the classes is many tasks. Inside a tile the
MinHash values of a pair are compared a few at a time; a pair is dropped when the posterior
probability that its similarity reaches the threshold falls below a tolerance, and the pairs left
are verified on their n-gram sets. A pair that agrees on several bands is handled in the first.
Tiles return counts of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import batch_of, keyed, mapped, same_row, signed, text_blocks, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4  # a pair at 0.8 misses all bands once in 40,000 times
TOLERANCE, STEP = 1e-6, 16
TILE = 512
#: Bits of the filter in front of the join that fetches n-gram sets: 4 MB.
FILTER_BITS = 1 << 25
_SIGNATURE = "doc_id long, th long, rid long, n_shingles long, sig array<int>"


def least_matches(threshold: float, tolerance: float, hashes: int, step: int) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): below, P(similarity >= threshold | matches) < tolerance.

    The prior of a similarity is uniform, so m matches of n give a Beta(m + 1, n - m + 1) posterior,
    whose upper tail is a binomial sum.
    """
    out = []
    for n in range(step, hashes + 1, step):
        def tail(m: int) -> float:
            return sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        out.append((n, next(m for m in range(n + 1) if tail(m) >= tolerance)))
    return out


def _shingles(w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and how many; fewer than n words are one n-gram."""
    starts = w.starts_of(n)
    owner = np.searchsorted(w.first, starts, "right") - 1
    grams = w.grams(n)[starts] if len(starts) else np.zeros(0, np.uint64)
    for k in range(1, n):
        few = np.flatnonzero(w.counts == k)
        if len(few):
            grams, owner = np.concatenate([grams, w.grams(k)[w.first[few]]]), np.concatenate([owner, few])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(w.counts))


def _signatures(shingle: int, hashes: int):
    rng = np.random.default_rng(97)
    factor = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def run(batches):
        for rows, w in text_blocks(batches, W.alphanumeric()):
            grams, many = _shingles(w, shingle)
            full = np.flatnonzero(many)
            if not len(full):
                continue
            begin = (np.cumsum(many) - many)[full]
            sig = np.empty((len(full), hashes), np.int32)
            for j in range(hashes):
                value = ((grams * factor[j] + shift[j]) >> np.uint64(32)).astype(np.uint32)
                sig[:, j] = np.minimum.reduceat(value, begin).view(np.int32)
            rid = W.mix(np.add.reduceat(W.mix(grams), begin) + many[full].astype(np.uint64))
            take = pa.array(full)
            yield batch_of(doc_id=rows.column("doc_id").take(take), th=rows.column("th").take(take), rid=signed(rid),
                           n_shingles=signed(many[full]),
                           sig=pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, hashes).astype(np.int32)),
                                                        pa.array(sig.ravel())))
    return run


def _places(rows: pa.RecordBatch) -> list[np.ndarray]:
    """Two places of each row's key in a bit table of FILTER_BITS."""
    ids = rows.column("doc_id").fill_null(-1).to_numpy().view(np.uint64)
    h = W.mix(W.mix(ids) ^ rows.column("th").to_numpy().view(np.uint64))
    return [h & np.uint64(FILTER_BITS - 1), h >> np.uint64(64 - FILTER_BITS.bit_length() + 1)]


def _marked(batches):
    """The 64-bit words of the bit table that a batch of keys sets bits in."""
    for batch in batches:
        at = np.concatenate(_places(batch))
        word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
        order = np.argsort(word)
        word, bit = word[order], bit[order]
        first = np.flatnonzero(np.diff(word, prepend=np.uint64(1 << 63)))
        if len(first):
            yield batch_of(word=signed(word[first]), bits=signed(np.bitwise_or.reduceat(bit, first)))


def bit_table(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the keys: at most FILTER_BITS / 64 rows come to the driver.

    With very many keys it lets more rows through; the join behind it is exact.
    """
    rows = mapped(keys.select("doc_id", "th"), _marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _sets(shingle: int, bits: np.ndarray):
    """N-gram sets of the rows whose key may be wanted, so that no other text is shuffled."""
    def run(batches):
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for at in _places(batch):
                hit &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            for rows, w in text_blocks([batch.filter(pa.array(hit))], W.alphanumeric()):
                grams, many = _shingles(w, shingle)
                ends = np.cumsum(many) * 8
                blob = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), rows.num_rows,
                    [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(grams)])
                yield batch_of(g_doc=rows.column("doc_id"), g_th=rows.column("th"), grams=blob.cast(pa.binary()))
    return run


def _tile(threshold: float, bands: int, rows: int, plan: list[tuple[int, int]], verify: bool):
    """verify: count the links of a tile; else only say which of its classes have a pair left."""
    def run(key, table):
        band = key[0].as_py()
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        own = key[2].as_py() == key[3].as_py()
        rid = table.column("rid").to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")] if verify else []
        left = np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        links, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
        cut = sig.reshape(len(rid), bands, rows)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in left:
            others = right[right > i] if own else right
            others = others[rid[others] != rid[i]]
            if band and len(others):  # a pair belongs to its first common band
                others = others[~(cut[others, :band] == cut[i, :band]).all(2).any(1)]
            same, done = np.zeros(len(others), int), 0
            for n, least in plan:
                same = same + (sig[others, done:n] == sig[i, done:n]).sum(1)
                stay = same >= least
                others, same, done = others[stay], same[stay], n
            if not len(others):
                continue
            if not verify:
                links[i] += 1
                links[others] += 1
                continue
            size = np.array([len(sets[j]) for j in others])
            flat = np.concatenate([sets[j] for j in others])
            spot = np.searchsorted(sets[i], flat)
            spot[spot == len(sets[i])] = 0
            common = np.add.reduceat((sets[i][spot] == flat).astype(np.int64), np.cumsum(size) - size)
            linked = others[common >= threshold * (len(sets[i]) + size - common) - 1e-9]
            links[i] += len(linked)
            links[linked] += 1
            for j in linked:
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        got = np.flatnonzero(links)
        if not verify:
            return table.select(["band", "key", "i", "j", "side", "rid"]).take(pa.array(got))
        return pa.table({"rid": pa.array(rid[got]), "to": pa.array(np.array([rid[top(x)] for x in got], np.int64)),
                         "links": pa.array(links[got])})
    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of `edges` (a, b): each round joins a node to its least neighbour.

    A round writes the contracted graph and the step of every node; both shrink from round to round.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "step")
        steps.append(step)
        left = edges.join(step, "a").select("b", F.col("to").alias("a2"))
        edges = left.join(step.withColumnRenamed("a", "b"), "b").select(F.col("a2").alias("a"), F.col("to").alias("b"))
        edges = written(edges.where("a <> b").distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # every step points to a smaller node; steps of later rounds are taken first
    root = steps[-1].withColumnRenamed("to", "root")
    for step in reversed(steps[:-1]):
        step = step.withColumnRenamed("to", "root")
        later = root.select(F.col("a").alias("x"), F.col("root").alias("y"))
        root = written(step.join(later, step["root"] == later["x"], "left")
                       .select("a", F.coalesce("y", "root").alias("root")), "root")
    return root.select(F.col("a").alias("node"), "root")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
            tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document row: doc_id, th, class_id, n_links, n_copies, first (the kept row of its class).

    n_links counts the different n-gram sets that reach the threshold with this one; n_copies the rows
    with the same set. class_id is the least doc_id of the documents joined by links and copies. Texts
    without words (null and empty ones too) are alone, with their own id. A null id ranks before all
    others; a class that has only null ids has a null class_id. Of rows repeated with id and text each
    gets the same answer.
    """
    hashes = bands * rows
    docs_k = keyed(docs, id_col, text_col)
    sigs = written(mapped(docs_k, _signatures(shingle, hashes), _SIGNATURE), "signatures")
    reps = sigs.groupBy("rid").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("n_copies"))
    # the signature is the same for all rows of a class
    keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.col("sig")[b * rows + j] for j in range(rows)]).alias("key"))
            for b in range(bands)]
    one = sigs.select("rid", F.explode(F.array(*keys)).alias("k")).select("rid", "k.*").distinct()
    buckets = one.groupBy("band", "key").count().where("count > 1")
    members = written(one.join(buckets, ["band", "key"]), "members")

    wanted = members.select("rid").distinct()
    source = written(reps.join(wanted, "rid").select("rid", "rep.*"), "candidates")
    sig = written(sigs.join(source.select(F.col("rid").alias("r2"), F.col("doc_id").alias("d2"), F.col("th").alias("t2")),
                            (sigs["rid"] == F.col("r2")) & sigs["doc_id"].eqNullSafe(F.col("d2")) & (sigs["th"] == F.col("t2")))
                  .select("rid", "sig").dropDuplicates(["rid"]), "bucket-signatures")

    n = F.ceil(F.col("count") / TILE).cast("int")
    block = F.pmod(F.xxhash64("rid"), n).cast("int")
    spread = (members.withColumn("n", n).withColumn("block", block)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      (F.col("block") > F.col("other")).cast("int").alias("side"), "rid"))
    plan, tile = least_matches(threshold, tolerance, hashes, STEP), ["band", "key", "i", "j"]
    # first on signatures alone: most tiles of later bands have no pair left, and n-gram sets are large
    alive = written(spread.join(sig, "rid").groupBy(*tile).applyInArrow(
        _tile(threshold, bands, rows, plan, False), "band int, key long, i int, j int, side int, rid long"), "alive")
    # n-gram sets are made only now, for the classes with a pair left
    needed = written(source.join(alive.select("rid").distinct(), "rid"), "needed")
    sets = mapped(docs_k, _sets(shingle, bit_table(needed)), "g_doc long, g_th long, grams binary")
    sets = sets.join(needed, sets["g_doc"].eqNullSafe(needed["doc_id"]) & (sets["g_th"] == needed["th"])).select(
        "rid", "grams").dropDuplicates(["rid"]).join(sig, "rid")
    found = alive.join(sets, "rid").groupBy(*tile).applyInArrow(
        _tile(threshold, bands, rows, plan, True), "rid long, to long, links long")
    found = written(found, "links")
    linked = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    root = components(found.select(F.col("rid").alias("a"), F.col("to").alias("b")))

    info = (reps.join(linked, "rid", "left").join(root.withColumnRenamed("node", "rid"), "rid", "left")
            .select("rid", "rep", "n_copies", "n_links", F.coalesce("root", "rid").alias("root")))
    info = written(info, "classes")
    least = info.groupBy("root").agg(F.min("rep").alias("first_row"))
    info = info.join(least, "root").select("rid", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_row")
    known = sigs.select("doc_id", "th", "rid").distinct().join(info, "rid")
    known = known.withColumnsRenamed({"doc_id": "k_doc", "th": "k_th"})
    base = docs_k.select("doc_id", "th")
    return base.join(known, base["doc_id"].eqNullSafe(known["k_doc"]) & (base["th"] == known["k_th"]), "left").select(
        "doc_id", "th",
        F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("first_row.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        # <=> with a null struct is false, not null: texts without words have no class row
        (F.col("rid").isNull() | F.struct("doc_id", "th").eqNullSafe(F.col("first_row"))).alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document rows with one left of every class; texts without words all stay, other columns as they are."""
    found = written(similar(docs, id_col, text_col).withColumnsRenamed({"doc_id": "_row_id", "th": "_row_th"}), "similar")
    drop = found.where("NOT first").select("_row_id", "_row_th").distinct()
    again = written(found.where("first AND n_copies > 1").groupBy("_row_id", "_row_th").count().where("count > 1"), "again")
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))

    def is_in(rows: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(rows["_row_id"]) & (th == rows["_row_th"])

    left = docs.join(drop, is_in(drop), "left_anti")
    if again.isEmpty():
        return left
    # rows repeated with id and text: one of each stays
    return docs.join(drop.unionByName(again.drop("count")).alias("gone"),
                     docs[id_col].cast("long").eqNullSafe(F.col("gone._row_id")) & (th == F.col("gone._row_th")),
                     "left_anti").unionByName(docs.join(again, is_in(again), "left_semi").dropDuplicates([id_col, text_col]))
