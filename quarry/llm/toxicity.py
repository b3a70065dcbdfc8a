"""Toxicity by a counterfactual-regularised linear classifier.

Features are what a text holds, not how often: hashes of its words (runs of bytes that aren't ASCII punctuation, space or
control; A-Z as a-z) and of their first 4, 5 and 6 bytes. Labels are learned from SAMPLE labelled rows at most, chosen by a
hash of their ids (bounded, so the fit costs the same at any size). One aggregate over the sample counts in how many toxic
and other texts each feature occurs; the FEATURES of the strongest association (signed log-likelihood ratio) enter a
logistic regression. For each sample text that names an identity, counterfactuals are made by swapping its identity terms
for others (and for none), and the squared change of the score's logit is penalised with PENALTY: a group's mere mention
then moves no score. The terms are a parameter, IDENTITY by default. Fitting is deterministic full-batch descent on the driver, over a matrix of bounded size.

Scoring is one pass over all documents: whole texts, no shuffle; the model is a few kilobytes.

Defined results: null and empty texts have no features and get the score of the intercept; a row without an id is scored;
labels that are null, or that repeat for an id, count once with their greatest value; without labelled rows of both kinds the
score is the share of label 1 (0.0 if there are no labels); other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import byte_values, cut, fresh, mix, opened, powers, released, share, slices, table, utf8, word_hashes

SAMPLE, FEATURES, PENALTY, RIDGE, STEPS = 6000, 2048, 1.0, 2e-4, 300
#: Terms that name groups of people; each row is a set whose members may stand for each other.
IDENTITY = [
    ["women", "men", "girls", "boys"], ["woman", "man", "girl", "boy"], ["female", "male", "transgender", "nonbinary"],
    ["gay", "lesbian", "straight", "bisexual", "queer", "trans", "homosexual", "heterosexual"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
    ["black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indian", "chinese", "mexican"], ["immigrant", "refugee", "foreigner", "migrant"], ["immigrants", "refugees", "foreigners", "migrants"],
    ["old", "young", "elderly"], ["disabled", "deaf", "blind", "autistic"],
    ["frauen", "männer"], ["schwul", "lesbisch", "hetero"], ["muslime", "christen", "juden", "hindus"], ["ausländer", "flüchtlinge", "migranten"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs", "hindous"], ["étrangers", "réfugiés", "immigrés"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["inmigrantes", "refugiados", "extranjeros"],
]
_VALUES = byte_values(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)
_PREFIXES = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts: the features they hold and the text of each, as often as they occur."""
    hashes, starts, ends, first = word_hashes(data, offsets, _VALUES)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[data].astype(np.uint64) * up[: len(data)], out=total[1:])
    out, of = [hashes], [text]
    for n in _PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        s = starts[long]
        out.append(mix((total[s + n] - total[s]) * down[s] + np.uint64(n * 0x10001 + 7)))
        of.append(text[long])
    return np.concatenate(out), np.concatenate(of)


def _of(words: list[str]) -> list[np.ndarray]:
    data, offsets = utf8(pa.array(words, pa.large_string()))
    h, of = features(data, offsets)
    return [np.unique(h[of == i]) for i in range(len(words))]


class Model:
    """Sorted feature hashes, their weights and the intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.hashes >> np.uint64(48)] = True

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        out = [np.zeros(0)]
        for i, j in slices(offsets):
            logit = np.full(j - i, self.bias)
            h, of = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            can = self.bits[h >> np.uint64(48)]
            h, of = h[can], of[can]
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            if len(self.hashes):
                hit = self.hashes[at] == h
                held = np.unique(of[hit] * len(self.hashes) + at[hit])
                np.add.at(logit, held // len(self.hashes), self.weights[held % len(self.hashes)])
            out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
        return np.concatenate(out)


def _sample(docs: DataFrame, labels: DataFrame, row: str, text: str, label: str, held_out, most: int) -> DataFrame:
    """Distinct features of the sampled labelled texts: row, toxic, features; texts stay on the executors."""
    own = labels.select(F.col(row).cast("long").alias("row"), F.col(label).cast("int").alias("toxic")).where("row is not null and toxic is not null")
    if held_out is not None:
        own = own.where(~held_out("row"))
    # at most `most` rows, whatever the size of the labels: a proven bound for the broadcast
    chosen = own.groupBy("row").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("row"), "row").limit(most)
    # repeated documents count once
    texts = docs.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text")).join(F.broadcast(chosen), "row")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            held = []
            for i, j in slices(offsets):
                h, of = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(1, j - i))
                held += [np.unique(x).view(np.int64) for x in np.split(h[order], cuts)]
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *held])))], names=["row", "toxic", "features"])

    return texts.select("row", "text", "toxic").mapInArrow(lambda batches: released(run(batches)), "row long, toxic int, features array<long>").dropDuplicates(["row"])


def _ratio(a, b, n, m):
    """Signed log-likelihood ratio of a of n against b of m, as a Column."""
    a, b = a.cast("double"), b.cast("double")
    p, k = (a + b) / (n + m), lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return F.signum(a / n - b / m) * (k(a, n * p) + k(b, m * p) + k(n - a, n * (1 - p)) + k(m - b, m * (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, *, row: str = "doc_id", text: str = "text", label: str = "toxic", held_out=None, sample: int = SAMPLE, n_features: int = FEATURES, penalty: float = PENALTY, identity: list[list[str]] = IDENTITY) -> Model:
    """Learn from the documents' labels. held_out(name): a condition for rows that labels mustn't be learned from."""
    held = cut(_sample(docs, labels, row, text, label, held_out, sample))
    counts = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    n, m = counts.get(1, 0), counts.get(0, 0)
    if not n or not m:
        share_ = (n + 1e-9) / (n + m) if n + m else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.clip(np.log(max(share_, 1e-300) / max(1 - share_, 1e-9)), -500, 500)))
    each = held.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a + b > 1")
    best = each.select("f", F.abs(_ratio(F.col("a"), F.col("b"), float(n), float(m))).alias("w")).orderBy(F.desc("w"), "f").limit(n_features)
    names = [w for group in identity for w in group]
    own = dict(zip(names, _of(names), strict=True))
    chosen = np.unique(np.concatenate([np.array([r[0] for r in best.collect()], np.int64).view(np.uint64), *own.values()]))
    key = share(docs.sparkSession, chosen)

    def narrow(batches):
        kept = opened(key)
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(kept, values), len(kept) - 1)
            hit = np.flatnonzero(kept[at] == values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, ends).astype(np.int32)), pa.array(at[hit].astype(np.int32)))], names=["row", "toxic", "at"])

    rows = sorted(tuple(r) for r in held.mapInArrow(narrow, "row long, toxic int, at array<int>").collect())  # at most `sample`, of n_features places
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (_, _, at) in enumerate(rows):
        x[i, at] = 1
    y = np.array([r[1] for r in rows], np.float32)
    places = {w: np.searchsorted(chosen, f) for w, f in own.items()}
    swaps = counterfactuals(x, places, identity)
    weights, bias = _descend(x, y, swaps, penalty)
    used = weights != 0
    return Model(chosen[used], weights[used], bias)


def counterfactuals(x: np.ndarray, places: dict[str, np.ndarray], identity: list[list[str]] = IDENTITY) -> np.ndarray:
    """Changes of the feature rows when one identity term is swapped for another of its set, or for none. Each distinct
    change counts once for every text it applies to, through its weight; terms of no sample text are swapped in a bare one."""
    out = []
    for group in identity:
        for k, term in enumerate(group):
            mine = places[term]
            n = int((x[:, mine].min(axis=1) > 0).sum()) if len(mine) else 0
            for other in (group[(k + 1) % len(group)], None):
                change = np.zeros(x.shape[1], np.float32)
                change[mine] -= 1
                if other:
                    change[places[other]] += 1
                out.append(change * np.float32(np.sqrt(max(n, 1))))
    return np.array(out, np.float32).reshape(-1, x.shape[1])


def _descend(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Balanced logistic loss + ridge + penalty on the logit's change under swaps; accelerated gradient steps."""
    n = len(y)
    balance = np.where(y > 0, min(8.0, max(1.0, (n - y.sum()) / max(1.0, y.sum()) / 2)), 1.0).astype(np.float32)
    balance /= balance.sum()
    x = np.column_stack([x, np.ones(n, np.float32)])  # the last weight is the intercept
    swaps = np.column_stack([swaps, np.zeros(len(swaps), np.float32)]) * np.float32(np.sqrt(penalty / n))
    ridge = np.full(x.shape[1], RIDGE, np.float32)
    ridge[-1] = 0
    # steps by each feature's own curvature, shortened by the largest eigenvalue of what couples them
    diagonal = 0.25 * (balance @ (x * x)) + ridge + (swaps**2).sum(axis=0) + 1e-6
    v, top = np.ones(x.shape[1], np.float32), 1.0
    for _ in range(40):
        u = v / np.sqrt(diagonal)
        u = (0.25 * (balance * (x @ u)) @ x + ridge * u + (swaps @ u) @ swaps) / np.sqrt(diagonal)
        top = float(np.linalg.norm(u))
        v = u / top
    scale = 1.2 * top * diagonal
    at = last = np.zeros(x.shape[1], np.float32)
    for t in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = at - ((balance * (p - y)) @ x + ridge * at + (swaps @ at) @ swaps) / scale
        at, last = step + np.float32(t / (t + 3)) * (step - last), step
    return last[:-1].astype(np.float64), float(last[-1])


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with the model's score between 0 and 1 in a new column."""
    schema = StructType([*docs.schema.fields, StructField(fresh(docs, name), DoubleType())])
    shared, names = share(docs.sparkSession, model), schema.names

    def run(batches):
        model = opened(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(batch.schema.names.index(text))))], names=names)

    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


def held_out(row: str) -> F.Column:
    """Rows that labels aren't learned from: crc32 of the id as text divisible by five."""
    return F.coalesce(F.crc32(F.col(row).cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
