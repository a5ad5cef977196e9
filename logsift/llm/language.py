"""Language of whole texts (operator 3): averaged hashed subword embeddings and a linear softmax.

A text's features are its words and the three-byte pieces inside its words, word limits included; the model is the
mean of their embeddings, a linear layer and a softmax. It is trained by stochastic gradient descent in numpy on a bounded number of
rows per language; a temperature and a threshold for rejection come from rows kept out of the training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shapes import head_per_group
from .bytestext import IS_SPACE, LOWER, U, groups, joined, part_hashes, utf8, word_limits

BUCKETS = 1 << 14
WIDTH = 16
# At most this many rows of each language are used for fitting.
ROWS_PER_LANGUAGE = 1200
EPOCHS = 12
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """``table``: logits of each feature (embedding times weights), so that a text's logits are a mean."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a group of texts, and where each text's begin (end as last)."""
    buf, at = joined(texts)
    buf = LOWER[buf]
    buf = np.where(IS_SPACE[buf], np.uint8(0x20), buf)
    starts, ends = word_limits(buf)
    words = part_hashes(buf, starts, ends) % U(BUCKETS)
    wide = np.concatenate([np.full(1, 0x20, np.uint32), buf.astype(np.uint32), np.full(1, 0x20, np.uint32)])
    piece = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    inside = np.flatnonzero(buf != 0x20)
    pieces = ((piece[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int32) % BUCKETS
    # Words and pieces text by text: sort positions are known, so a stable merge by start is enough.
    place = np.concatenate([starts, inside])
    order = np.argsort(place, kind="stable")
    return np.concatenate([words.astype(np.int32), pieces])[order], np.searchsorted(place[order], at)


def logits(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """Mean logits per text; a text without features has the bias alone."""
    index, at = features(texts)
    count = np.diff(at)
    sums = np.zeros((len(texts), len(model.languages)))
    filled = np.flatnonzero(count)
    for j in range(len(model.languages)):
        if len(filled):
            sums[filled, j] = np.add.reduceat(model.table[:, j][index], at[:-1][filled])
    return sums / np.maximum(count, 1)[:, None] + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], seed: int = 11, epochs: int = EPOCHS) -> LanguageModel:
    """``rows``: (buckets, counts, index of the language). A fifth of the rows calibrates."""
    n_lang = len(languages)
    if n_lang < 2 or len(rows) < 10:
        prior = np.bincount([y for *_, y in rows], minlength=n_lang) + 1.0 if n_lang else np.ones(0)
        return LanguageModel(languages, np.zeros((BUCKETS, n_lang)), np.log(prior / prior.sum()) if n_lang else prior, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]

    def dense(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(chosen), BUCKETS), np.float32)
        for i, j in enumerate(chosen):
            buckets, counts, _ = rows[j]
            if len(buckets):
                x[i, buckets] = counts / counts.sum()
        return x, np.array([rows[j][2] for j in chosen])

    embed = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    weight, bias = (rng.standard_normal((WIDTH, n_lang)) / WIDTH).astype(np.float32), np.zeros(n_lang, np.float32)
    size = 32
    steps = epochs * -(-len(used) // size)
    step = 0
    share = np.bincount([rows[j][2] for j in used], minlength=n_lang)
    balance = (len(used) / np.maximum(share, 1) / n_lang).astype(np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), -(-len(used) // size)):
            rate = 20.0 * (1 - step / steps)
            step += 1
            x, y = dense(part)
            hidden = x @ embed
            grad = softmax(hidden @ weight + bias)
            grad[np.arange(len(y)), y] -= 1
            grad = (grad * (balance[y] / len(y))[:, None]).astype(np.float32)
            back = grad @ weight.T
            weight -= np.float32(rate * 0.05) * (hidden.T @ grad)
            bias -= np.float32(rate * 0.005) * grad.sum(axis=0)
            embed -= np.float32(rate) * (x.T @ back)
    table = (embed @ weight).astype(np.float32)
    model = LanguageModel(languages, table, bias.astype(np.float64), 1.0, 0.0)
    scores, truth = [], []
    for part in np.array_split(held, max(1, len(held) // 256)):
        x, y = dense(part)
        scores.append(x @ table + bias)
        truth.append(y)
    z, y = np.concatenate(scores).astype(np.float64), np.concatenate(truth)
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 60))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(z / model.temperature)
    right = sure.max(axis=1)[sure.argmax(axis=1) == y]
    # A text is rejected if it is less certain than all but a thousandth of the right calibration rows, and less certain than a coin.
    model.threshold = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def train(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``rows_per_language`` rows of each language where ``usable`` holds, chosen by a hash of the id.

    The ids are chosen first, so only the chosen texts are read; they reach the driver as feature counts. Of rows that share an
    id no more than fit the bound are used, chosen by their features. An empty table, or one without a usable row, gives a model that
    knows no language; null texts have no features; other columns are not read.
    """
    ids = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.lit(3)).alias("at"))
    chosen = head_per_group(ids, ["lang"], [F.col("at"), F.col("id")], rows_per_language).select("id", "lang").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for part in groups(utf8(batch["text"].tolist())):
                index, at = features(part)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    buckets, counts = np.unique(index[a:b], return_counts=True)
                    data.append((buckets.astype("<i4").tobytes(), counts.astype("<f4").tobytes()))
            yield pd.DataFrame({"lang": batch["lang"], "id": batch["id"], "buckets": [d[0] for d in data], "counts": [d[1] for d in data]})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = texts.join(F.broadcast(chosen), ["id", "lang"]).select("text", "lang", F.col("id").cast("string")).mapInPandas(
        count, "lang string, id string, buckets binary, counts binary")
    # Bounded by rows_per_language times the number of languages, also where many rows share an id.
    rows = head_per_group(counted, ["lang"], [F.col("id"), F.col("buckets"), F.col("counts")], rows_per_language).select("lang", "buckets", "counts").toPandas()
    rows = rows.sort_values(["lang", "buckets", "counts"]).reset_index(drop=True)
    languages = sorted(rows["lang"].unique().tolist())
    place = {x: i for i, x in enumerate(languages)}
    return fit([(np.frombuffer(b, "<i4"), np.frombuffer(c, "<f4"), place[x]) for x, b, c in zip(rows["lang"], rows["buckets"], rows["counts"])], languages)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add a struct ``__lang`` (lang, score, rejected) to every row; a column of that name is an error.

    A null text and one without letters are ``und`` with score 0, and rejected; so is every text if no language was learned.
    Texts are read whole, repeated rows score alike, and an empty table gives an empty result.
    """
    if "__lang" in docs.columns:
        raise ValueError("rename the column __lang first")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            values = texts.tolist()
            known = np.array([has_letter(t) for t in values]) if values else np.zeros(0, bool)
            lang, score = np.full(len(values), UNKNOWN, object), np.zeros(len(values))
            at = 0
            if model.languages:
                for part in groups(utf8(values)):
                    p = softmax(logits(model, part) / model.temperature)
                    lang[at : at + len(part)] = np.array(model.languages, object)[p.argmax(axis=1)]
                    score[at : at + len(part)] = p.max(axis=1)
                    at += len(part)
            lang[~known], score[~known] = UNKNOWN, 0.0
            yield pd.DataFrame({"lang": lang, "score": np.clip(score, 0.0, 1.0), "rejected": (lang == UNKNOWN) | (score < model.threshold)})

    return docs.withColumn("__lang", F.pandas_udf(run, "lang string, score double, rejected boolean")(F.col(text_col)))
