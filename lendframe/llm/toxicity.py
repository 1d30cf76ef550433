"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are words and word beginnings: a few insults known beforehand, and those that a bounded
sample of labelled training rows shows to go with the label beyond chance, plus patterns of case and
punctuation. The label model is a two-class mixture over the votes, fitted by EM with the given
labels as one more, fallible voter; votes that are correlated within a class share their weight. A
logistic regression is trained on its posterior labels. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import words as W
from lendframe.llm.tables import batch_of, mapped, signed, text_blocks, written

#: Labelled rows that are learned from, at most; those with the smallest id hash.
LABELLED_ROWS = 20_000
VOTERS = 96
PREFIXES = (4, 5, 6)
#: Insults that vote without being learned.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "clown", "pathetic",
           "worthless", "disgusting", "imbecile", "dumb", "jerk")
#: How often the label voter is right, and the odds that a mined voter must beat by chance.
LABEL_ACCURACY, CHANCE = 0.98, 0.05


def _tokens(w: W.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word position, hash) of whole words and of word beginnings of fixed byte lengths."""
    out = [(np.arange(len(w.hash)), w.hash)]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        if len(long):
            start = w.start[long]
            out.append((long, W.mix(W._spans(W._VALUES[w.data], start, start + n, W._BASE) + np.uint64(n))))
    return out


def _known() -> np.ndarray:
    data = " ".join(INSULTS).encode()
    return W.find(np.frombuffer(data, np.uint8), np.array([0, len(data)]), W.alphanumeric()).hash


def _mine(batches):
    """(token, rows with label 1, rows with label 0) of a batch; a token counts once a text."""
    for rows, w in text_blocks(batches, W.alphanumeric()):
        toxic = rows.column("toxic").to_numpy().astype(np.int64)
        tokens, owners = [], []
        for at, value in _tokens(w):
            tokens.append(value)
            owners.append(np.searchsorted(w.first, at, "right") - 1)
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, label = token[new], toxic[owner[new]]
        if len(token):
            at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            yield batch_of(token=signed(token[at]), bad=signed(np.add.reduceat(label, at)),
                           good=signed(np.add.reduceat(1 - label, at)))


def votes(w: W.Words, lexicon: np.ndarray) -> np.ndarray:
    """0/1 votes, texts x (lexicon + patterns)."""
    n, v = len(w.first) - 1, len(lexicon)
    out = np.zeros((n, v + 2))
    order = np.argsort(lexicon)
    ranked = lexicon[order]
    for at, value in _tokens(w):
        if v and len(value):
            spot = np.searchsorted(ranked, value)
            spot[spot == v] = 0
            hit = np.flatnonzero(ranked[spot] == value)
            out[np.searchsorted(w.first, at[hit], "right") - 1, order[spot[hit]]] = 1
    return out


def _patterns(data: np.ndarray, bounds: np.ndarray, out: np.ndarray) -> None:
    """The last two votes: mostly capitals, and many exclamation marks for the length."""
    def count(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    big, small = count((data >= 0x41) & (data <= 0x5A)), count((data >= 0x61) & (data <= 0x7A))
    out[:, -2] = big > np.maximum(small, 8)
    out[:, -1] = count(data == 0x21) * 20 > np.maximum(np.diff(bounds), 60)


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # 2 x voters: P(vote | class)
    share: np.ndarray  # weight of a vote, less when others say the same

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        hit = np.log(self.fires[1] / self.fires[0])
        miss = np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        return math.log(self.prior / (1 - self.prior)) + (v * hit + (1 - v) * miss) @ self.share


def fit_label_model(v: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[LabelModel, np.ndarray]:
    """Votes and given labels (fallible) of the sample; the model and the posterior of class 1."""
    known = math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * (2 * label - 1)
    p = np.where(label == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    share = np.ones(v.shape[1])
    model = None
    for step in range(rounds):
        mass = np.array([(1 - p).sum(), p.sum()]) + 1
        fires = np.stack([((1 - p) @ v + 0.05) / (mass[0] + 0.1), (p @ v + 0.05) / (mass[1] + 0.1)])
        if step % 10 == 0:  # correlation of two voters within the classes
            rest = v - np.outer(1 - p, fires[0]) - np.outer(p, fires[1])
            cov = rest.T @ rest / len(v)
            sd = np.sqrt(np.diag(cov)) + 1e-9
            share = 1 / np.maximum(1, (np.clip(cov / np.outer(sd, sd), 0, 1) ** 2).sum(1))
        model = LabelModel(float(np.clip(mass[1] / mass.sum(), 1e-3, 1 - 1e-3)), fires, share)
        new = 1 / (1 + np.exp(-np.clip(model.log_odds(v) + known, -30, 30)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return model, p


def fit_linear(v: np.ndarray, p: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the intercept comes last."""
    x = np.column_stack([v, np.ones(len(v))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (q - p) + penalty * w
        bend = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    lexicon: np.ndarray
    weights: np.ndarray

    def score(self, w: W.Words, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        v = votes(w, self.lexicon)
        _patterns(data, bounds, v)
        return 1 / (1 + np.exp(-np.clip(v @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _vote_rows(lexicon: np.ndarray):
    def run(batches):
        for batch in batches:
            for a, b, data, bounds in W.blocks(batch.column("text")):
                w = W.find(data, bounds, W.alphanumeric())
                v = votes(w, lexicon)
                _patterns(data, bounds, v)
                packed = np.packbits(v.astype(bool), axis=1)
                yield batch_of(toxic=batch.column("toxic").slice(a, b - a),
                               votes=pa.array([r.tobytes() for r in packed], pa.binary()))
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows: int = LABELLED_ROWS, held_out_in: int = 5) -> Classifier:
    """Learn from at most `rows` labelled documents whose crc32(id as text) mod `held_out_in` is not 0."""
    spark = docs.sparkSession
    given = (labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic"))
             .where("toxic IS NOT NULL").where(F.crc32(F.col("id").cast("string")) % held_out_in != 0)
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    sample = given.orderBy(F.xxhash64("id"), "id").limit(rows).collect()  # two numbers a row, `rows` at most
    sample = spark.createDataFrame(sample, "id long, toxic int")
    text = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    labelled = text.join(F.broadcast(sample), "id").select("toxic", "text")  # bounded by `rows`

    counts = mapped(labelled, _mine, "token long, bad long, good long").groupBy("token").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    known = _known()
    if not sums["n"]:
        weights = np.concatenate([np.full(len(known), 4.0), [0, 0, -3.0]])
        return Classifier(known, weights)
    base = min(max(sums["bad"] / sums["n"], 1e-6), 1 - 1e-6)
    share = (F.col("bad") + 1e-9) / (F.col("bad") + F.col("good"))
    # log likelihood ratio against the base rate; it must beat the chance of that many tokens
    gain = F.col("bad") * F.log(share / base) + F.col("good") * F.when(
        F.col("good") > 0, F.log((1 - share + 1e-9) / (1 - base))).otherwise(0.0)
    counts = written(counts.where("bad > 2"), "tokens")
    limit = math.log(max(counts.count(), 1) / CHANCE)
    best = (counts.withColumn("gain", gain).where((share / (1 - share + 1e-6) > 5 * base / (1 - base)) & (F.col("gain") > limit))
            .orderBy(F.desc("gain"), "token").limit(VOTERS).collect())
    lexicon = np.unique(np.concatenate([known, np.array([r["token"] for r in best], np.int64).view(np.uint64)]))
    got = mapped(labelled, _vote_rows(lexicon), "toxic int, votes binary").collect()  # a few bytes a row, `rows` at most
    got.sort(key=lambda r: (r["toxic"], bytes(r["votes"])))
    bits = np.frombuffer(b"".join(bytes(r["votes"]) for r in got), np.uint8).reshape(len(got), -1)
    v = np.unpackbits(bits, axis=1)[:, : len(lexicon) + 2].astype(float)
    _, p = fit_label_model(v, np.array([r["toxic"] for r in got]))
    return Classifier(lexicon, fit_linear(v, p))


def scored(docs: DataFrame, model: Classifier, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """The documents with all their columns and the score, 0 to 1; a null text is scored as an empty one."""
    if out_col in docs.columns:
        raise ValueError(f"the documents have a column {out_col}; choose another out_col")
    from pyspark.sql.types import DoubleType, StructType
    schema = StructType([*docs.schema.fields]).add(out_col, DoubleType())

    def run(batches):
        for batch in batches:
            for a, b, data, bounds in W.blocks(batch.column(text_col)):
                score = model.score(W.find(data, bounds, W.alphanumeric()), data, bounds)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*batch.schema.names, out_col])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The document rows with a score under the limit; their columns, of whatever names, stay as they were.

    Null and empty texts are scored as empty ones; repeated rows stay or go together; no rows give no rows.
    """
    name = "toxicity"
    while name in map(str.lower, docs.columns):
        name += "_"
    return scored(docs, fit(docs, labels), out_col=name).where(F.col(name) < limit).drop(name)
