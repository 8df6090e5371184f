"""Toxicity categories by a classifier chain.

Categories are predicted one after another by logistic regressions over n-grams of words. Each model
also gets the probabilities of the categories before it. For training these come from models that
haven't seen the row (out of fold), so that later models learn how far earlier ones can be trusted;
for scoring they come from the models fitted on all training rows.

Training uses at most about `SAMPLE` toxic labelled rows and twice as many others, drawn by hash; all documents are
scored, over their whole texts. What a model keeps is bounded by `FEATURES`, so that it can be sent
to every task.

Defined results: a null or empty text has the features of no words and its probabilities are those
of the intercepts; rows of labels with a null id or class are left out; repeated rows are rows of
their own; without labels of both classes all probabilities are 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash
from .perplexity import ngrams

#: Words by which toxic rows are told apart into categories.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
CATEGORIES = ("insult", "veiled", "severe", "toxic")
SAMPLE, FEATURES, BUCKETS, FOLDS, ORDER = 1500, 4096, 1 << 20, 5, 5
#: Least number of positive rows that hold a feature.
LEAST = 3
#: How many times more often toxic rows must hold a feature for it to be looked at in training.
SCREEN = 1.25
#: The probability of the last category from which on a document is called toxic.
CUT = 0.5


def categories(toxic: Column, text: Column) -> dict[str, Column]:
    """Categories of a labelled row: insult names one of INSULTS, severe three or more; veiled is
    toxic without any."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[.,!?]", "")
    held = F.size(F.array_intersect(F.split(words, r"[\x20\x09-\x0D]+"), F.array(*map(F.lit, INSULTS))))
    return {"insult": toxic & (held > 0), "veiled": toxic & (held == 0), "severe": toxic & (held > 2), "toxic": toxic}


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of words: which word each belongs to, and its bucket."""
    which, bucket, done = [], [], 0
    for keys, *_, end in ngrams(pa.array(words, pa.large_string()), "", ORDER):
        # a word's n-grams end one after another; a gap lies before the next word
        word = np.cumsum(np.diff(end, prepend=end[0]) > 1) + done
        which.append(word)
        bucket.append((keys & np.uint64(BUCKETS - 1)).astype(np.int64))
        done = int(word[-1]) + 1
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(bucket)


def text_features(texts: list[str | None], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; features are buckets or, if given, places in chosen."""
    bags = [set((t or "").lower().encode().split()) for t in texts]
    known = {w: k for k, w in enumerate(dict.fromkeys(w for bag in bags for w in bag))}
    which, bucket = word_features(list(known))
    if chosen is not None:
        at = np.minimum(np.searchsorted(chosen, bucket), max(len(chosen) - 1, 0))
        hit = chosen[at] == bucket if len(chosen) else np.zeros(len(bucket), bool)
        which, bucket = which[hit], at[hit]
    first = np.searchsorted(which, np.arange(len(known) + 1))
    word = np.fromiter((known[w] for bag in bags for w in bag), np.int64)
    text = np.repeat(np.arange(len(texts)), [len(b) for b in bags])
    n = first[word + 1] - first[word]
    places = np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs = np.unique(np.repeat(text, n) * BUCKETS + bucket[places])
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Linear:
    """A logistic regression: chosen buckets and their weights, weights of earlier categories."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probability(self, rows: int, text: np.ndarray, bucket: np.ndarray, before: np.ndarray) -> np.ndarray:
        if len(self.chosen):
            at = np.minimum(np.searchsorted(self.chosen, bucket), len(self.chosen) - 1)
            hit = self.chosen[at] == bucket
            score = np.bincount(text[hit], weights=self.weights[at[hit]], minlength=rows)
        else:
            score = np.zeros(rows)
        return 1 / (1 + np.exp(-np.clip(score + before @ self.earlier + self.intercept, -30, 30)))


def fit_one(text: np.ndarray, bucket: np.ndarray, y: np.ndarray, before: np.ndarray, rounds: int = 120, ridge: float = 1.0) -> Linear:
    """Fits by gradient steps with adapted lengths, on the features that tell the classes apart best."""
    rows = len(y)
    positive = np.bincount(bucket[y[text] > 0], minlength=BUCKETS)
    everywhere = np.bincount(bucket, minlength=BUCKETS)
    odds = np.log((positive + 0.5) / (y.sum() + 1)) - np.log((everywhere - positive + 0.5) / (rows - y.sum() + 1))
    gain = np.where(positive >= LEAST, odds * np.sqrt(positive), 0.0)
    order = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = np.sort(order[gain[order] > 0])
    model = Linear(chosen, np.zeros(len(chosen)), np.zeros(before.shape[1]), float(np.log((y.sum() + 0.5) / (rows - y.sum() + 0.5))))
    if not len(chosen):
        return model
    at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
    hit = chosen[at] == bucket
    text, at = text[hit], at[hit]
    w = np.zeros(len(chosen) + before.shape[1] + 1)
    w[-1] = model.intercept
    squares = np.full(len(w), 1e-8)
    m = len(chosen)
    for _ in range(rounds):
        score = np.bincount(text, weights=w[at], minlength=rows) + before @ w[m:-1] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        slope = np.concatenate([np.bincount(at, weights=error[text], minlength=m) + ridge * w[:m], before.T @ error + ridge * w[m:-1], [error.sum()]])
        squares += slope**2
        w -= 0.5 * slope / np.sqrt(squares)
    return Linear(chosen, w[:m], w[m:-1], float(w[-1]))


def fit_chain(text: np.ndarray, bucket: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> tuple[list[Linear], np.ndarray]:
    """The chain fitted on all rows, and the out-of-fold probabilities of each category."""
    rows, kinds = labels.shape
    # every fold gets its share of every combination of categories
    fold = np.empty(rows, dtype=np.int64)
    fold[np.lexsort(labels.T)] = np.arange(rows) % folds
    aside = np.zeros((rows, kinds))
    models = []
    for k in range(kinds):
        y = labels[:, k].astype(float)
        before = aside[:, :k]
        for f in range(folds):
            train = fold != f
            place = np.cumsum(train) - 1
            seen = train[text]
            model = fit_one(place[text[seen]], bucket[seen], y[train], before[train])
            test = ~train
            place = np.cumsum(test) - 1
            aside[test, k] = model.probability(int(test.sum()), place[text[~seen]], bucket[~seen], before[test])
        models.append(fit_one(text, bucket, y, before))
    return models, aside


def screened(sets: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of the features that positive rows hold more often than others."""
    held = np.zeros((2, BUCKETS), dtype=np.int32)
    for own, y in zip(sets, positive.tolist()):
        held[int(y), own] += 1
    rows = positive.sum(), len(sets) - positive.sum()
    useful = (held[1] >= LEAST) & ((held[1] + 0.5) / (rows[0] + 1) > SCREEN * (held[0] + 0.5) / (rows[1] + 1))
    sets = [own[useful[own]] for own in sets]
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return text, np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): a bounded number of labelled documents, drawn by hash."""
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("boolean").alias("toxic"))
    of_class = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = F.when(F.col("toxic"), sample / max(of_class.get(True, 0), 1)).otherwise(2 * sample / max(of_class.get(False, 0), 1))
    drawn = known.filter(unit_hash(F.lit("train"), F.col("doc_id")) < share)
    # bounded by the size of the sample
    return documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear]:
    """The chain, fitted on a bounded sample of the labelled rows."""
    rows = training_rows(documents, labels, sample)
    wanted = categories(F.col("toxic"), F.col("text"))
    rows = rows.select("doc_id", "text", *[c.cast("int").alias(k) for k, c in wanted.items()])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                text, bucket = text_features(part.column("text").to_pylist())
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                packed = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
                kinds = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in CATEGORIES], axis=1)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "features": pa.array(packed, pa.binary()), "kinds": pa.array(kinds.tolist(), pa.list_(pa.int32()))})

    featured = rows.mapInArrow(features, "doc_id long, features binary, kinds array<int>")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        labels = np.array(group["kinds"].tolist())
        text, bucket = screened([np.frombuffer(f, np.int32) for f in group["features"]], labels[:, -1] > 0)
        models, _ = fit_chain(text, bucket, labels)
        return pd.DataFrame({"place": range(len(models)), "chosen": [m.chosen for m in models], "weights": [m.weights for m in models], "earlier": [m.earlier for m in models], "intercept": [m.intercept for m in models]})

    schema = "place int, chosen array<long>, weights array<double>, earlier array<double>, intercept double"
    trained = featured.groupBy().applyInPandas(train, schema).orderBy("place").collect()  # bounded by FEATURES
    return [Linear(np.array(r["chosen"], np.int64), np.array(r["weights"]), np.array(r["earlier"]), r["intercept"]) for r in trained]


def score(documents: DataFrame, models: list[Linear], cut: float = CUT) -> DataFrame:
    """doc_id, p_<category> for every category, toxic: whether the last one reaches the cut."""
    id_type = dict(documents.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {id_type}", *(f"p_{c} double" for c in CATEGORIES), "toxic boolean"])
    chosen = np.unique(np.concatenate([m.chosen for m in models])) if models else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("text").nbytes / max(batch.num_rows, 1)
            step = max(1, int((2 << 20) / max(size, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                text, place = text_features(part.column("text").to_pylist(), chosen)
                done = np.zeros((n, len(CATEGORIES)))
                for k, model in enumerate(models):
                    done[:, k] = model.probability(n, text, chosen[place] if len(chosen) else place, done[:, :k])
                columns = [part.column("doc_id"), *[pa.array(done[:, k]) for k in range(len(CATEGORIES))], pa.array(done[:, -1] >= cut)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
