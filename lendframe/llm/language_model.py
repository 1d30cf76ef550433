"""Hierarchical Pitman-Yor language model, learned from all training documents.

Every word is a context restaurant for the word after it; these restaurants share one parent, the
restaurant of words without context, whose own parent is uniform over the words of the training
texts and one more type, which stands for every word never seen (as in the base score). The tables
of a context restaurant are the customers of the parent. Gibbs sweeps seat all customers anew, pairs
and words, given the seating of the other restaurants; a pair seen once sits alone, so only pairs seen
again are visited. Several chains run side by side, each with tables of its own in all restaurants, and
draws depend on the pair, the seed, the sweep and the chain alone. A chain's last seating gives a
predictive probability of every token; the score is that of their mean over the chains.

Counts and seatings are exact tables in Spark and grow with the corpus. Texts are scored in blocks: a
block asks once for each of its distinct words and pairs, bucket by bucket of the keys, and gets their
counts and tables back in the same order, so neither the keys nor a row a key come back.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import batch_of, keyed, mapped, signed, written
from lendframe.session import width

#: Of a context restaurant, and of the one without context.
DISCOUNT, STRENGTH = 0.75, 1.0
WORD_DISCOUNT, WORD_STRENGTH = 0.6, 2.0
SWEEPS, CHAINS = 2, 4
BLOCK = 6 << 20
#: Words or pairs that a bucket of keys holds.
KEYS = 1 << 20
#: Rows that are seated together.
SEATED = 1 << 18
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, from 8 steps further on."""
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(low)


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number between 0 and 1 that depends on the key and the step alone, so not on how rows are dealt out."""
    return ((W.mix(key + np.full(1, step, np.uint64) * _STEP) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _seat(count: np.ndarray, open_weight: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables after `count` customers of a dish come in turn.

    open_weight: (strength + discount * tables of the restaurant) * parent probability. A customer
    opens a table with probability open_weight / (open_weight + customers - discount * tables). The
    chance that nobody up to a customer opens one is a quotient of gamma functions; the next one to
    open a table is found in it by Newton's steps, so the work grows with the tables, not with the customers.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    two = np.flatnonzero(count == 2)  # most dishes: the same draw without the gamma functions
    if len(two):
        tables[two] += (1 - discount) / (np.maximum(open_weight[two], 1e-300) + 1 - discount) <= _uniform(key[two], 0)
    seated, live, step = np.ones(len(count)), np.flatnonzero(count > 2), 0
    while len(live):
        w, start = np.maximum(open_weight[live], 1e-300), seated[live]
        taken = discount * tables[live]
        at_start = _log_gamma(start - taken) - _log_gamma(w + start - taken)
        limit = np.log(_uniform(key[live], step))
        step += 1

        def nobody(customers: np.ndarray) -> np.ndarray:
            return _log_gamma(customers - taken) - _log_gamma(w + customers - taken) - at_start

        opens = nobody(count[live].astype(float)) <= limit
        live, w, taken, at_start, limit = live[opens], w[opens], taken[opens], at_start[opens], limit[opens]
        first, last = start[opens] + 1, count[live].astype(float)
        half = (w - 1) / 2  # gamma(x) / gamma(x + w) is nearly (x + half) ** -w
        x = np.clip((first - 1 - taken + half) * np.exp(np.minimum(-limit / w, 700)) - half + taken, first, last)
        for _ in range(5):
            slope = np.log((x - taken - 0.5).clip(1e-3) / (x - taken + w - 0.5).clip(2e-3))
            x = np.clip(x - (nobody(x) - limit) / np.minimum(slope, -1e-12), first, last)
        high = np.ceil(x - 1e-6)
        tables[live] += 1
        seated[live] = high
        live = live[high < count[live]]
    return tables


def _tokens(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, token before and text of every token; the end of a text is 0, and so is what precedes its first word."""
    owner = np.repeat(np.arange(len(w.counts)), w.counts + 1)
    token = np.zeros(len(owner), np.uint64)
    token[np.arange(len(w.hash)) + w.owner()] = w.hash
    return token, np.concatenate([np.zeros(min(1, len(token)), np.uint64), token[:-1]]), owner


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(before + np.uint64(1)) * _STEP + token)


def _pair_counts(batches):
    """(before, token, count) of a block."""
    for batch in batches:
        for _, _, data, bounds in W.blocks(batch.column("text"), BLOCK):
            token, before, _ = _tokens(W.find(data, bounds, W.spaced()))
            _, at, n = np.unique(_pair(before, token), return_index=True, return_counts=True)
            yield batch_of(u=signed(before[at]), w=signed(token[at]), n=signed(n))


def _together(batches):
    """Batches joined to SEATED rows: tables of all their dishes are opened in the same steps."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SEATED:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _by_chain(tables: np.ndarray, chains: int) -> dict[str, pa.Array]:
    return {f"t{i}": signed(t) for i, t in enumerate(tables.reshape(chains, -1))}


def _seat_words(seed: int, weights: list[float]):
    """Tables of the words in every chain; weights: of a new table, by chain."""
    def run(batches):
        for batch in _together(batches):
            word, chains = batch.column("hash").to_numpy().view(np.uint64), len(weights)
            c = np.concatenate([batch.column(f"c{i}").to_numpy() for i in range(chains)])
            keys = np.concatenate([W.mix(word + np.uint64(64 * seed + i)) for i in range(chains)])
            t = _by_chain(_seat(c, np.repeat(weights, len(word)), WORD_DISCOUNT, keys), chains)
            yield batch_of(**{k: batch.column(k) for k in batch.schema.names}, **t)
    return run


def _seat_pairs(seed: int, chains: int):
    """Tables of the pairs in every chain, given its parent's probability p of the token and its tables x of the context."""
    def run(batches):
        for batch in _together(batches):
            n = batch.column("n").to_numpy()
            pair = _pair(*(batch.column(k).to_numpy().view(np.uint64) for k in ("u", "w")))
            weight = np.concatenate([(STRENGTH + DISCOUNT * batch.column(f"x{i}").to_numpy()) * batch.column(f"p{i}").to_numpy()
                                     for i in range(chains)])
            keys = np.concatenate([W.mix(pair + np.uint64(64 * seed + i)) for i in range(chains)])
            t = _by_chain(_seat(np.tile(n, chains), weight, DISCOUNT, keys), chains)
            yield batch_of(u=batch.column("u"), w=batch.column("w"), n=batch.column("n"), **t)
    return run


def _spread(totals: dict) -> float:
    """Weight of a new table of any one word."""
    return (WORD_STRENGTH + WORD_DISCOUNT * totals["t"]) / (totals["v"] + 1)


def _parent(c, t, totals: dict):
    """Probability of a word without context; c and t may be columns or arrays."""
    return (c - WORD_DISCOUNT * t + _spread(totals)) / (WORD_STRENGTH + totals["c"])


def _word_tables(words: DataFrame, again: DataFrame, seed: int, totals: list[dict]) -> tuple[DataFrame, list[dict]]:
    """hash, n and for every chain i customers ci, tables ti, and tables xi of the restaurant that a word is the context
    of; and their sums by chain. totals: the sums of the seating before."""
    each = range(len(totals))
    dish = again.groupBy(F.col("w").alias("hash")).agg(*[F.sum(f"t{i}").alias(f"d{i}") for i in each])
    context = again.groupBy(F.col("u").alias("hash")).agg(*[F.sum(f"t{i}").alias(f"e{i}") for i in each])
    state = words.join(dish, "hash", "left").join(context, "hash", "left").select(
        "hash", "n", *[(F.col("c1") + F.coalesce(f"d{i}", F.lit(0))).alias(f"c{i}") for i in each],
        *[(F.col("x1") + F.coalesce(f"e{i}", F.lit(0))).alias(f"x{i}") for i in each])
    weights = [_spread(x) for x in totals]
    names = [f"{k}{i}" for k in "cxt" for i in each]
    state = written(mapped(state, _seat_words(seed, weights), "hash long, n long, " + ", ".join(f"{k} long" for k in names)), "words")
    sums = state.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ["n", *names]], F.count("*").alias("v")).first()
    return state, [{"n": sums["n"], "v": sums["v"], "c": sums[f"c{i}"], "t": sums[f"t{i}"]} for i in each]


def seatings(train: DataFrame, seed: int, chains: int) -> tuple[DataFrame, DataFrame, DataFrame, list[dict]]:
    """(words, pairs seen once, pairs seen again, totals) of the column text: what `_word_tables` gives, u, w and n of
    every pair, and of pairs seen again their tables ti in every chain."""
    pairs = written(mapped(train, _pair_counts, "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n")), "pairs")
    once = F.count_if(F.col("n") == 1)
    before = pairs.groupBy(F.col("u").alias("hash")).agg(once.alias("x1"))
    # every context is a word too: what comes before a first word has the key of the end
    words = written(pairs.groupBy(F.col("w").alias("hash")).agg(F.sum("n").alias("n"), once.alias("c1")).join(before, "hash", "left")
                    .select("hash", "n", "c1", F.coalesce("x1", F.lit(0)).alias("x1")), "word-counts")
    v = words.count()
    again = pairs.where("n > 1").withColumns({f"t{i}": F.lit(1) for i in range(chains)})
    state, totals = _word_tables(words, again, seed, [{"v": v, "t": v}] * chains)
    for sweep in range(1, SWEEPS + 1):
        tokens = state.select(F.col("hash").alias("w"), *[
            _parent(F.col(f"c{i}"), F.col(f"t{i}"), x).alias(f"p{i}") for i, x in enumerate(totals)])
        contexts = state.select(F.col("hash").alias("u"), *[f"x{i}" for i in range(chains)])
        ready = again.select("u", "w", "n").join(tokens, "w").join(contexts, "u")
        again = written(mapped(ready, _seat_pairs(seed + sweep, chains),
                               "u long, w long, n long, " + ", ".join(f"t{i} long" for i in range(chains))), "seats")
        state, totals = _word_tables(words, again, seed + sweep, totals)
    return state, pairs.where("n = 1"), again, totals


def seated(train: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, dict]:
    """(words, pairs, totals) of one chain: hash, n, c, x, t of every word, and u, w, n, t of every pair."""
    words, once, again, totals = seatings(train, seed, 1)
    pairs = once.withColumn("t", F.lit(1)).unionByName(again.withColumnRenamed("t0", "t"))
    return words.withColumnsRenamed({"c0": "c", "x0": "x", "t0": "t"}), pairs, totals[0]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(x.max()) if x.size else 0)
    return kind.char.encode() + x.astype(kind).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, x[:1].decode(), offset=1)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket and key, the buckets they have, and the borders of these in the order."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    have, first = np.unique(bucket[order], return_index=True)
    return order, have.astype(np.int64), np.append(first, len(keys))


def _known(buckets: int, pairs: bool, values: list[str]):
    """Keys with their counts and values, one row a bucket: odd buckets hold pairs, even ones words."""
    def run(batches):
        for batch in _together(batches):
            keys = (_pair(*(batch.column(k).to_numpy().view(np.uint64) for k in ("u", "w"))) if pairs
                    else batch.column("hash").to_numpy().view(np.uint64))
            numbers = np.stack([batch.column(k).to_numpy() for k in ["n", *values]])
            order, have, border = _dealt(keys, buckets)
            at = [order[a:b] for a, b in zip(border, border[1:])]
            yield batch_of(bucket=signed(2 * have + pairs), keys=pa.array([keys[o].tobytes() for o in at], pa.binary()),
                           v=pa.array([_packed(numbers[:, o]) for o in at], pa.binary()))
    return run


def _blocks(batches):
    """(number, rows) of every block; the number is a hash of its rows, so blocks with one number have the same keys."""
    for batch in batches:
        for a, b, data, bounds in W.blocks(batch.column("text"), BLOCK):
            rows = batch.slice(a, b - a)
            ids = np.nan_to_num(rows.column("doc_id").to_numpy(zero_copy_only=False)).astype(np.int64)
            digest = hashlib.blake2b(ids.tobytes() + rows.column("th").to_numpy().tobytes(), digest_size=8).digest()
            yield int.from_bytes(digest, "little", signed=True), rows, data, bounds


def _blocked(batches):
    for number, rows, _, _ in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, number)), *rows.columns], names=["block", *rows.schema.names])


def _requests(buckets: int):
    def run(batches):
        for number, _, data, bounds in _blocks(batches):
            token, before, _ = _tokens(W.find(data, bounds, W.spaced()))
            for pairs, keys in enumerate((np.unique(token), np.unique(_pair(before, token)))):
                order, have, border = _dealt(keys, buckets)
                yield batch_of(block=pa.array(np.full(len(have), number)), bucket=signed(2 * have + pairs), keys=pa.array(
                    [keys[order[a:b]].tobytes() for a, b in zip(border, border[1:])], pa.binary()))
    return run


def _answers(chains: int):
    """Counts and tables (words: customers and tables of the context, too) of the keys that blocks ask a bucket for."""
    def run(key, asked, known):
        wide = 1 + chains * (1 if key[0].as_py() % 2 else 3)
        keys = np.frombuffer(b"".join(known.column("keys").to_pylist()), np.uint64)
        order = np.argsort(keys)
        keys = np.append(keys[order], np.iinfo(np.uint64).max)
        values = [_unpacked(v) for v in known.column("v").to_pylist()]
        sizes = [len(k) // 8 for k in known.column("keys").to_pylist()]
        # pairs seen once come without tables: there is one in every chain
        rows = [np.broadcast_to(v, (wide, n)) if len(v) == n else v.reshape(wide, n) for v, n in zip(values, sizes)]
        table = np.concatenate([*rows, np.zeros((wide, 0), np.int64)], axis=1)[:, order]
        table = np.concatenate([table, np.zeros((wide, 1), table.dtype)], axis=1)  # never seen
        out = []
        for k in asked.column("keys").to_pylist():
            wanted = np.frombuffer(k, np.uint64)
            at = np.searchsorted(keys, wanted)
            out.append(_packed(table[:, np.where(keys[at] == wanted, at, len(keys) - 1)]))
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "v": pa.array(out, pa.binary())})
    return run


def _score_block(totals: list[dict], buckets: int):
    chains = len(totals)

    def run(key, docs, found):
        pieces = list(W.blocks(docs.column("text"), BLOCK))  # one, but for blocks that come again with all their rows
        tokens = [_tokens(W.find(data, bounds, W.spaced())) for _, _, data, bounds in pieces]
        answer = dict(zip(found.column("bucket").to_pylist(), found.column("v").to_pylist()))

        def collected(pairs: int, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """The distinct keys and what is known of them, a row a key."""
            keys = np.unique(np.concatenate(keys))
            order, have, border = _dealt(keys, buckets)
            wide = 1 + chains * (1 if pairs else 3)
            table = np.zeros((wide, len(keys)), np.int64)
            for bucket, a, b in zip((2 * have + pairs).tolist(), border, border[1:]):
                got = _unpacked(answer[bucket]) if bucket in answer else ()
                if len(got) != wide * (b - a):
                    raise RuntimeError("a block got no answer: the documents came in another order when they were read again")
                table[:, order[a:b]] = got.reshape(wide, b - a)
            return keys, table

        words, known = collected(0, [t for t, _, _ in tokens])
        both, seen = collected(1, [_pair(b, t) for t, b, _ in tokens])
        c, x, t = (known[1 + k * chains : 1 + (k + 1) * chains] for k in range(3))
        parents = [_parent(c[i], t[i], totals[i]) for i in range(chains)]
        out = []
        for (a, b, _, _), (token, before, owner) in zip(pieces, tokens):
            w, u, pair = np.searchsorted(words, token), np.searchsorted(words, before), np.searchsorted(both, _pair(before, token))
            n = known[0, w]
            p = np.zeros(len(w))
            for i in range(chains):
                inside = np.maximum(seen[0, pair] - DISCOUNT * seen[1 + i, pair], 0)
                # all occurrences of a context have a token after them
                p += (inside + (STRENGTH + DISCOUNT * x[i, u]) * parents[i][w]) / (STRENGTH + known[0, u])
            base = np.log10((n + 0.1) / (totals[0]["n"] + 0.1 * (totals[0]["v"] + 1)))
            out.append([np.bincount(owner, x, b - a).astype(float) for x in (np.ones(len(w)), n > 0, base, np.log10(p / chains))])
        size, known_words, base, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": docs.column("doc_id"), "th": docs.column("th"), "n": signed(size), "known": signed(known_words),
                         "base": pa.array(base), "score": pa.array(score)})
    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_in: int = 10, seed: int = 5) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learned from the rows whose crc32(id as text) mod `held_out_in` is not 0; a null id is not learned
    from and counts as held out. A-Z are lower-cased; tokens are runs without ASCII white space, then
    one end. A null or empty text is its end alone. Repeated rows are learned from as often as they
    come. With nothing to learn from, every token is the one unseen type, of probability 1.
    """
    rows = keyed(docs, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_in == 0, F.lit(True))
    rows = rows.select("doc_id", "th", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    words, once, again, totals = seatings(rows.where(~held).select("text"), seed, CHAINS)
    buckets = max(width(docs.sparkSession), math.ceil((once.count() + again.count()) / KEYS))
    shape, each = "bucket long, keys binary, v binary", range(CHAINS)
    known = (mapped(words, _known(buckets, False, [f"{k}{i}" for k in "cxt" for i in each]), shape)
             .unionByName(mapped(once, _known(buckets, True, []), shape))
             .unionByName(mapped(again, _known(buckets, True, [f"t{i}" for i in each]), shape)))
    asked = mapped(rows, _requests(buckets), "block long, bucket long, keys binary")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answers(CHAINS), "block long, bucket long, v binary")
    texts = mapped(rows, _blocked, "block long, doc_id long, th long, text string")
    got = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score_block(totals, buckets), "doc_id long, th long, n long, known long, base double, score double")
    return got.select("doc_id", held.alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
                      F.lit(totals[0]["n"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
