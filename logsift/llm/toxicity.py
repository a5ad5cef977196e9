"""Toxicity of whole texts by weak supervision (operator 10).

Many voters look at a text: terms (words, and beginnings of words of four to six bytes) whose presence speaks for a
toxic label by a likelihood-ratio test on the learning rows, and patterns of writing. A generative label model estimates by
expectation maximisation how often each voter fires on toxic and on other texts, and from the residual correlations
between voters how many independent witnesses they are. A logistic regression on the votes is trained on its posterior labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shapes import head_per_group
from ..session import materialize
from .bytestext import LOWER, U, distinct_sorted, groups, joined, part_hashes, utf8, word_limits

# At most this many learning rows of each label, chosen by a hash of the id.
ROWS_PER_LABEL = 4000
BEGINNINGS = (4, 5, 6)
# Terms need this much evidence (twice the log likelihood ratio) and at least so many toxic rows.
EVIDENCE = 40.0
LEAST_ROWS = 4
# The strongest terms make up the model, no more than that.
MOST_TERMS = 2000
PATTERNS = ("many capitals", "many exclamation marks", "many question marks", "many digits", "very few distinct words")


@dataclass
class ToxicityModel:
    """``terms`` sorted; ``weights`` has the terms first, then the patterns."""

    terms: np.ndarray
    weights: np.ndarray
    bias: float


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes of a group of texts in order, where each text's begin (end as last), and the patterns of each text."""
    raw, at = joined(texts)
    buf = LOWER[raw]
    # Sentence marks do not belong to words here.
    plain = np.where((buf >= 0x21) & (buf <= 0x2F) | (buf >= 0x3A) & (buf <= 0x40) | (buf >= 0x5B) & (buf <= 0x60) | (buf >= 0x7B) & (buf <= 0x7E), np.uint8(0x20), buf)
    starts, ends = word_limits(plain)
    every, place = [part_hashes(plain, starts, ends)], [starts]
    for n in BEGINNINGS:
        longer = ends - starts > n
        every.append(part_hashes(plain, starts[longer], starts[longer] + n) ^ U(n))
        place.append(starts[longer])
    place_ = np.concatenate(place)
    order = np.argsort(place_, kind="stable")
    terms = np.concatenate(every)[order]
    words = np.searchsorted(starts, at)
    n_words = np.maximum(np.diff(words), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    capitals = share((raw >= 65) & (raw <= 90))
    small = share((raw >= 97) & (raw <= 122))
    distinct = np.array([len(distinct_sorted(every[0][a:b])) for a, b in zip(words[:-1], words[1:])])
    patterns = np.stack([
        capitals > small, share(raw == 0x21) * 5 > n_words, share(raw == 0x3F) * 5 > n_words, share((raw >= 48) & (raw <= 57)) > 2 * n_words,
        (distinct * 10 < n_words) & (n_words >= 50),
    ], axis=1)
    return terms, np.searchsorted(place_[order], at), patterns


def _choose_terms(learning: DataFrame, most: int = MOST_TERMS) -> np.ndarray:
    """Terms that speak for the label: G statistic on presence, toxic side only. Counted on the cluster; at most ``most`` reach the driver."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.frombuffer(t, np.int64) for t in batch["terms"]]
            sizes = [len(s) for s in sets]
            yield pd.DataFrame({"term": np.concatenate(sets) if sets else np.zeros(0, np.int64), "toxic": np.repeat(batch["toxic"].to_numpy(), sizes)})

    n1, n0 = learning.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n1 or not n0:
        return np.zeros(0, U)
    counts = learning.select("terms", "toxic").mapInPandas(explode, "term long, toxic int").groupBy("term").agg(
        F.count_if(F.col("toxic") == 1).cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b"))

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    rate = (a + b) / (n1 + n0)
    g = 2 * (part(a, n1 * rate) + part(n1 - a, n1 * (1 - rate)) + part(b, n0 * rate) + part(n0 - b, n0 * (1 - rate)))
    good = counts.where(a >= LEAST_ROWS).withColumn("g", g).where((F.col("g") >= EVIDENCE) & (a / n1 > 4 * b / n0))
    found = good.orderBy(F.col("g").desc(), "term").limit(most).select("term").collect()
    return np.sort(np.array([r["term"] for r in found], np.int64).view(U))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the label from votes (rows by voters; a voter fires or abstains), starting from ``start``.

    Given the label, voters fire independently but for groups whose residuals correlate; a voter counts by one over the
    sum of its squared correlations, so that copies of one witness weigh as one.
    """
    v = votes.astype(np.float32)
    posterior = np.clip(start, 0.02, 0.98)
    for _ in range(rounds):
        on, off = posterior.sum(), (1 - posterior).sum()
        p1, p0 = (posterior @ v + 0.1) / (on + 0.2), ((1 - posterior) @ v + 0.1) / (off + 0.2)
        expected = posterior[:, None] * p1 + (1 - posterior)[:, None] * p0
        residual = (v - expected) / np.sqrt(np.maximum(expected.mean(axis=0) * (1 - expected.mean(axis=0)), 1e-6))
        correlation = residual.T.astype(np.float32) @ residual.astype(np.float32) / len(v)
        weight = 1.0 / np.maximum(1.0, (np.where(np.abs(correlation) > 0.2, correlation, 0) ** 2).sum(axis=1))
        gain = v @ (weight * np.log(p1 / p0))
        new = 1 / (1 + np.exp(-np.clip(np.log(max(on, 1e-3) / max(off, 1e-3)) + gain, -30, 30)))
        if np.abs(new - posterior).max() < 1e-4:
            return new
        posterior = new
    return posterior


def fit(terms: np.ndarray, fired: list[np.ndarray], patterns: np.ndarray, toxic: np.ndarray, prior: float) -> ToxicityModel:
    """Posterior labels from the votes, weights from the posterior labels; ``fired`` holds the places of each row's terms."""
    odds = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    none = ToxicityModel(terms, np.zeros(len(terms) + len(PATTERNS)), odds)
    if not len(terms) or toxic.all():
        return none
    votes = np.zeros((len(fired), len(terms) + len(PATTERNS)), np.float32)
    for i, places in enumerate(fired):
        votes[i, places] = 1
    votes[:, len(terms):] = patterns
    # Two more kinds of voters for the label model only: "no term fires", and the given labels, whose accuracy is estimated like any other's.
    witnesses = np.column_stack([votes, votes[:, : len(terms)].max(axis=1) == 0, toxic, ~toxic])
    soft = label_model(witnesses, toxic.astype(float))
    # Logistic regression by full-batch gradient descent with momentum; terms only add evidence for toxic texts.
    w, speed, bias, bias_speed = np.zeros(votes.shape[1]), np.zeros(votes.shape[1]), odds, 0.0
    balance = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    for _ in range(400):
        z = 1 / (1 + np.exp(-np.clip(votes @ w + bias, -30, 30)))
        miss = (z - soft) * balance
        speed = 0.9 * speed - 2.0 * (votes.T @ miss + 1e-5 * w)
        bias_speed = 0.9 * bias_speed - 2.0 * miss.sum()
        w, bias = w + speed, bias + bias_speed
        w[: len(terms)] = np.maximum(w[: len(terms)], 0)
    return ToxicityModel(terms, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows_per_label: int = ROWS_PER_LABEL, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most ``rows_per_label`` labelled rows of each label where ``usable`` (on the labels) holds; the share of toxic rows comes from all of them.

    Of rows that share an id no more than fit the bound are used. The terms are counted on the cluster; the driver gets
    their votes, at most MOST_TERMS per row. Null texts have no terms; labels other than 0 and 1 and null ids are left out; an empty table, or
    labels of one kind only, gives a model that knows the share alone. Other columns are not read.
    """
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    chosen = head_per_group(known.withColumn("at", F.xxhash64("id", F.lit(5))), ["toxic"], [F.col("at"), F.col("id")], rows_per_label).select("id", "toxic").distinct()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for part in groups(utf8(batch["text"].tolist())):
                terms, at, patterns = terms_of(part)
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    data.append((distinct_sorted(terms[a:b]).tobytes(), patterns[i].astype(np.uint8).tobytes()))
            yield pd.DataFrame({"toxic": batch["toxic"], "id": batch["id"], "terms": [d[0] for d in data], "patterns": [d[1] for d in data]})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    looked = texts.select("text", "toxic", F.col("id").cast("string")).mapInPandas(look, "toxic int, id string, terms binary, patterns binary")
    learning = materialize(head_per_group(looked.withColumn("mark", F.xxhash64("terms")), ["toxic"], [F.col("id"), F.col("mark")], rows_per_label).select("toxic", "terms", "patterns"), "learning")
    terms = _choose_terms(learning)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fired = [np.flatnonzero(np.isin(terms, np.frombuffer(t, U))).astype("<i4").tobytes() for t in batch["terms"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "fired": fired, "patterns": batch["patterns"]})

    # At most twice rows_per_label rows of at most MOST_TERMS votes.
    rows = learning.mapInPandas(vote, "toxic int, fired binary, patterns binary").toPandas()
    rows = rows.sort_values(["toxic", "fired", "patterns"]).reset_index(drop=True)
    fired = [np.frombuffer(t, "<i4") for t in rows["fired"]]
    patterns = np.array([np.frombuffer(p, np.uint8) for p in rows["patterns"]]).reshape(len(rows), len(PATTERNS))
    return fit(terms, fired, patterns, rows["toxic"].to_numpy() == 1, 0.0 if share is None else float(share))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Add ``__toxicity``, the probability (0 to 1), to every row; a column of that name is an error.

    Texts are read whole; null counts as an empty text, repeated rows score alike, and an empty table gives an empty result.
    """
    if "__toxicity" in docs.columns:
        raise ValueError("rename the column __toxicity first")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        # A small table of bits keeps most terms away from the search.
        bits = np.zeros(1 << 20, bool)
        bits[(model.terms >> U(44)).astype(np.int64)] = True
        for texts in batches:
            out = []
            for part in groups(utf8(texts.tolist())):
                terms, at, patterns = terms_of(part)
                near = np.flatnonzero(bits[(terms >> U(44)).astype(np.int64)])
                which = np.searchsorted(model.terms, terms[near])
                which[which == len(model.terms)] = 0
                hit = model.terms[which] == terms[near] if len(model.terms) else np.zeros(0, bool)
                text = np.searchsorted(at, near[hit], side="right") - 1
                pairs = np.unique(text * (len(model.terms) + 1) + which[hit])
                sums = np.bincount(pairs // (len(model.terms) + 1), weights=model.weights[pairs % (len(model.terms) + 1)], minlength=len(part)) if len(pairs) else np.zeros(len(part))
                z = sums + patterns @ model.weights[len(model.terms):] + model.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("__toxicity", F.pandas_udf(run, "double")(F.col(text_col)))
