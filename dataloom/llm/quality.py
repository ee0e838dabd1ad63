"""A quality classifier trained by co-training on two views of a document.

One view sees only the content (byte frequencies, repetition, shape of words and lines
of the whole text), the other only the metadata beside it. Each round, each view labels
the documents of an unlabelled pool that it is most sure of, and the other view learns
from them. Both are then calibrated on labelled documents that neither has learnt from,
and a small logistic model combines the two calibrated views to score every document.

Only a bounded, documented sample is fitted on (``labelled``, ``pool``); all documents are
scored where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dataloom.llm.common import by_place, hash_share, picked, place, text_or_empty

# Rows of the labelled sample and of the pool; rounds; share of the pool taken a round.
LABELLED = 8_000
POOL = 8_000
ROUNDS = 3
TAKEN = 0.05
SURE = 0.95
# Slots that the values of one metadata column are hashed to.
_SLOTS = 64


def content_view(text: str) -> np.ndarray:
    """Features of the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    total = max(1.0, counts.sum())
    words = raw.split()
    lines = raw.split(b"\n")
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, high, space = counts[48:58].sum(), counts[128:].sum(), counts[[9, 10, 11, 12, 13, 32]].sum()
    return np.concatenate([np.sqrt(counts[:128] / total), [
        len(set(words)) / n, len(set(lines)) / max(1, len(lines)), again,
        np.log1p(total) / 10, len(raw) / n / 20, n / max(1, len(lines)) / 50,
        upper / max(1.0, upper + lower), digits / total, high / total, space / total,
        (total - upper - lower - digits - high - space) / total,
    ]])


def metadata_view(values: tuple, length: float) -> np.ndarray:
    """Hashed values of the metadata columns and the length's order of magnitude."""
    slots = np.zeros(_SLOTS * len(values) + 8)
    for i, value in enumerate(values):
        key = int(pd.util.hash_array(np.array([str(value)], dtype=object))[0])
        slots[i * _SLOTS + key % _SLOTS] = 1.0
    slots[-8 + min(7, int(np.log10(max(1.0, length))))] = 1.0
    return slots


@dataclass
class Logistic:
    """Logistic regression with a ridge, fitted by Newton steps on standardised features."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> "Logistic":
        self.centre, self.spread = x.mean(axis=0), x.std(axis=0)
        self.spread[self.spread < 1e-9] = 1.0
        z = np.column_stack([(x - self.centre) / self.spread, np.ones(len(x))])
        w, hold = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        hold[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(
                (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(hold), z.T @ (p - y) + hold * w
            )
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of a good document."""
        return np.clip(((x - self.centre) / self.spread) @ self.weights[:-1] + self.weights[-1], -30, 30)


def chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


@dataclass
class Model:
    """Two views, their calibrations and the model that joins them; without two classes
    of labels there is nothing to learn, every score is ``prior`` and every document is kept."""

    views: list[Logistic]
    calibrations: list[Logistic]
    joined: Logistic | None
    prior: float

    def kept(self, score: Column, threshold: float = 0.5) -> Column:
        return F.lit(True) if self.joined is None else score >= threshold

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.joined is None:
            flat = np.full(len(content), self.prior)
            return flat, flat, flat
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (content, metadata))]
        return chance(odds[0]), chance(odds[1]), chance(self.joined.odds(np.column_stack(odds)))


def co_train(
    content: np.ndarray, metadata: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, taken: float = TAKEN,
    sure: float = SURE,
) -> Model:
    """Rows with a NaN label are the pool; every third labelled row of each label is kept
    for calibration. Without two rows of either label there is no model."""
    marked = np.flatnonzero(~np.isnan(label))
    pool = np.flatnonzero(np.isnan(label))
    held = np.sort(np.concatenate([marked[label[marked] == c][::3] for c in (0, 1)]))
    own = np.setdiff1d(marked, held)
    prior = float(label[marked].mean()) if len(marked) else 1.0
    if len(own) < 2 or len(set(label[own])) < 2 or len(set(label[held])) < 2:
        return Model([], [], None, prior)
    x = (content, metadata)
    rows = [own, own]
    answers = [label[own], label[own]]
    free = pool
    for _ in range(rounds):
        views = [Logistic().fit(x[i][rows[i]], answers[i]) for i in (0, 1)]
        most = int(np.ceil(taken * len(pool)))
        used = []
        for i, view in enumerate(views):
            if not len(free):
                break
            p = chance(view.odds(x[i][free]))
            share = float(np.mean(answers[i]))
            good = np.argsort(-p, kind="stable")[: int(round(most * share))]
            bad = np.argsort(p, kind="stable")[: int(round(most * (1 - share)))]
            good, bad = good[p[good] >= sure], bad[p[bad] <= 1 - sure]
            other = 1 - i
            rows[other] = np.concatenate([rows[other], free[good], free[bad]])
            answers[other] = np.concatenate([answers[other], np.ones(len(good)), np.zeros(len(bad))])
            used += [free[good], free[bad]]
        free = np.setdiff1d(free, np.concatenate(used)) if used else free
    views = [Logistic().fit(x[i][rows[i]], answers[i]) for i in (0, 1)]
    odds = [v.odds(x[i][held]) for i, v in enumerate(views)]
    calibrations = [Logistic().fit(o[:, None], label[held]) for o in odds]
    both = np.column_stack([c.odds(o[:, None]) for c, o in zip(calibrations, odds)])
    return Model(views, calibrations, Logistic().fit(both, label[held]), prior)


def _views(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    values = rows[[c for c in rows.columns if c.startswith("m_")]]
    content = np.array([content_view(t) for t in rows["text"]], float)
    metadata = np.array([
        metadata_view(v, len(t)) for v, t in zip(values.itertuples(index=False, name=None), rows["text"])
    ], float)
    return content, metadata


def _inputs(docs: DataFrame, id_col: str, text_col: str, metadata: list[str]) -> DataFrame:
    named = {f"m_{i}": c for i, c in enumerate(metadata)}
    rows = picked(docs, id=id_col, text=text_col, **named)
    return rows.select("id", text_or_empty().alias("text"), *[F.col(m).cast("string").alias(m) for m in named])


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    metadata: tuple[str, ...] = ("source", "lang"), labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS,
) -> Model:
    """Co-train on about ``labelled`` labelled documents and ``pool`` others at most, chosen
    by a hash of the id. Several labels of one id count as good if their mean is above one
    half; NULL ids and labels are left out. Of rows that repeat an id the one with the
    smallest text is taken."""
    rows = _inputs(docs, id_col, text_col, list(metadata))
    marks = picked(labels, id=id_col, label=label_col).dropna().groupBy("id").agg(
        (F.avg("label") > 0.5).cast("double").alias("label")
    )
    n_marked, n_all = labels.count(), docs.count()
    some = marks.where(hash_share(F.col("id"), labelled, n_marked))
    in_pool = hash_share(F.col("id"), pool, max(pool, n_all - n_marked))
    ids = rows.select("id").where(F.col("id").isNotNull() & in_pool).distinct()
    rest = ids.join(marks.where(in_pool), "id", "left_anti").withColumn("label", F.lit(None).cast("double"))
    schema = T.StructType([
        T.StructField("at", T.LongType()), T.StructField("label", T.DoubleType()),
        T.StructField("content", T.ArrayType(T.FloatType())), T.StructField("metadata", T.ArrayType(T.FloatType())),
    ])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = _views(batch)
                yield pd.DataFrame({
                    "at": batch["at"], "label": batch["label"], "content": list(a.astype(np.float32)),
                    "metadata": list(b.astype(np.float32)),
                })

    # Both samples are bounded by their parameters, so they are broadcast.
    wanted = F.broadcast(some.unionAll(rest))
    own = [c for c in rows.columns if c != "id"]
    one = rows.join(wanted, "id").groupBy("id").agg(F.min(F.struct(*own, "label")).alias("row"))
    sample = one.select("id", "row.*").withColumn("at", F.xxhash64("id", "text")).drop("id")
    found = sample.mapInPandas(features, schema).toPandas().sort_values("at", kind="stable")
    if not len(found):
        return Model([], [], None, 1.0)
    return co_train(
        np.array(found["content"].tolist(), float), np.array(found["metadata"].tolist(), float),
        found["label"].to_numpy(float), rounds,
    )


def _scored(model: Model, docs: DataFrame, text: Column, metadata: list[Column]) -> Column:
    """Column of ``struct(content, metadata, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("content double, metadata double, score double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, *values in batches:
            parts = []
            for at in range(0, len(text), 256):
                frame = pd.DataFrame({"text": text[at:at + 256]} | {f"m_{i}": v[at:at + 256] for i, v in enumerate(values)})
                parts.append(pd.DataFrame(dict(zip(("content", "metadata", "score"), shared.value.scores(*_views(frame))))))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["content", "metadata", "score"], dtype=float)

    return score(text_or_empty(text), *[c.cast("string") for c in metadata])


def scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
    metadata: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """``id, content, metadata, score`` of every row of ``docs``: both calibrated views and
    their combination, as chances of a good document.

    NULL text counts as empty; NULL metadata is a value of its own; repeated rows and NULL
    ids keep their rows; an empty table gives none.
    """
    rows = by_place(docs)
    at = lambda name: F.col(place(docs, name))
    found = _scored(model, docs, at(text_col), [at(m) for m in metadata])
    return rows.select(at(id_col).alias("id"), found.alias("found")).select("id", "found.*")


def keep_good(
    docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text",
    metadata: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all columns; all
    rows where no model could be learnt."""
    if model.joined is None:
        return docs
    rows = by_place(docs)
    at = lambda name: F.col(place(docs, name))
    found = _scored(model, docs, at(text_col), [at(m) for m in metadata])
    return rows.where(found["score"] >= threshold).toDF(*docs.columns)
