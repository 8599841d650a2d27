"""Quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

Statistics of a document are Spark expressions over its whole text. Cosines of random
projections of the standardised statistics approximate a Gaussian kernel. Each partition of
the training rows sums its part of the normal equations, the driver adds the parts up and
solves them, and pool-adjacent-violators on rows left out of the fit turns margins into
frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, cut, let, shared_dir, words
from .quality import STOP_WORDS


@dataclass(frozen=True)
class Settings:
    """``max_labels`` bounds, within sampling error, the labelled rows that are read for the fit: a share of ids by hash."""

    features: int = 256
    gamma: float = 0.06
    ridge: float = 3.0
    seed: int = 20240
    max_labels: int = 200_000
    partitions: int = 16


STATISTICS = (
    "log_words mean_word distinct_words repeat_share symbol_share digit_share upper_share punct_share bang_share "
    "stop_share line_share dup_line_share longest_word space_share pipe_share accent_share"
).split()


def with_statistics(documents: DataFrame) -> DataFrame:
    """(``doc_id``, ``stats``): an array of doubles in the order of STATISTICS; zeros for an empty text."""
    text = F.coalesce("text", F.lit(""))
    df = documents.select("doc_id", text.alias("__t"), words(text).alias("__w"), F.split(text, "\n", -1).alias("__l"))
    chars, n, lines = F.greatest(F.length("__t"), F.lit(1)), F.greatest(F.size("__w"), F.lit(1)), F.greatest(F.size("__l"), F.lit(1))
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern))
    w = F.col("__w")
    following = let(w, lambda a: F.size(F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1) == x, F.lit(False)))))
    values = [
        F.log1p(F.size(w)),
        F.length(F.array_join(w, "")) / n,
        F.size(F.array_distinct(w)) / n,
        following / n,
        count(r"[#*$%&|<>]") / n,
        count("[0-9]") / chars,
        count(r"\p{Lu}") / chars,
        count(r"[.,;:?!]") / n,
        count("!") / n,
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))) / n,
        F.size("__l") / n,
        F.lit(1.0) - F.size(F.array_distinct("__l")) / lines,
        F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)) / F.lit(10.0),
        count(WS_CLASS) / chars,
        count(r"\|") / n,
        count(r"[^\x00-\x7F]") / chars,
    ]
    return df.select("doc_id", F.array(*[v.cast("double") for v in values]).alias("stats"))


class Model:
    """Standardisation, random features, ridge weights and an isotonic table."""

    def __init__(self, settings: Settings) -> None:
        rng = np.random.default_rng(settings.seed)
        d = len(STATISTICS)
        self.turn = rng.normal(0, np.sqrt(2 * settings.gamma), (d, settings.features))
        self.phase = rng.uniform(0, 2 * np.pi, settings.features)
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.weights = np.zeros(settings.features + d + 1)
        self.steps, self.levels = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turn + self.phase)
        return np.concatenate([wave, z / 10, np.ones((len(z), 1))], axis=1)

    def margins(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.margins(stats), self.steps, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their means, which rise."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.asarray([c / n for _, n, c in blocks]), np.asarray([s / n for s, n, _ in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(STATISTICS))


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``labelled`` (``doc_id``, ``stats``, ``label`` 0 or 1, ``part``).

    Rows of ``part`` 1 calibrate, the others are fitted. Without rows, or with one class
    only, the score is constant. Ids serve to choose the rows of the bounded sample only. The
    sample is persisted for three passes; blocks of a lost executor are computed again.
    """
    model = Model(settings)
    rows = labelled.filter("label IN (0, 1)")
    share = min(1.0, settings.max_labels / max(rows.count(), 1))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    rows = rows.select("stats", F.col("label").cast("double").alias("label"), "part").repartition(settings.partitions)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(STATISTICS)
        total = np.zeros(2 * d + 1)
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    rows = rows.persist()
    try:
        sums = np.sum([r["part"] for r in rows.select("stats").mapInArrow(moments, "part array<double>").collect()], axis=0)
        d, n = len(STATISTICS), sums[-1]
        if n < 2:
            return model
        model.mean = sums[:d] / n
        model.scale = np.sqrt(np.maximum(sums[d : 2 * d] / n - model.mean**2, 1e-12)) + 1e-9

        def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(model.weights)
            total = np.zeros((k, k + 1))
            for batch in batches:
                f = model.features(_matrix(batch.column(0)))
                total += f.T @ np.concatenate([f, batch.column(1).to_numpy()[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part"])

        parts = rows.filter("part <> 1").select("stats", "label").mapInArrow(equations, "part array<double>").collect()
        k = len(model.weights)
        total = np.sum([np.asarray(r["part"]) for r in parts], axis=0).reshape(k, k + 1)
        penalty = settings.ridge * np.eye(k)
        penalty[-1, -1] = 1e-6
        model.weights = np.linalg.solve(total[:, :k] + penalty, total[:, k])

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.margins(_matrix(batch.column(0)))), batch.column(1)], ["margin", "label"])

        held = rows.filter("part = 1").select("stats", "label").mapInArrow(margins, "margin double, label double").toPandas()
    finally:
        rows.unpersist()
    if len(held):
        model.steps, model.levels = isotonic(held["margin"].to_numpy(), held["label"].to_numpy())
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(``doc_id``, ``score``) for rows of (``doc_id``, ``stats``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.clip(model.scores(_matrix(batch.column(1))), 0, 1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "score"])

    return stats.select(F.col("doc_id").cast("bigint"), "stats").mapInArrow(work, "doc_id bigint, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, fold: Column, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``documents``: ``doc_id`` and ``score``.

    ``fold`` is a number made from the doc_id: rows of fold 0 are held out and their labels
    are not read, fold 1 calibrates, the rest is fitted. Labels that are null, doubled or
    without a document change nothing else; null texts count as empty and have a score, very
    long texts are read whole, repeated rows are scored alike, an empty table gives an empty
    result, and other columns are not carried, so their names cannot clash.
    """
    known = labels.filter("doc_id IS NOT NULL").select(F.col("doc_id"), F.col("quality").alias("label"), fold.alias("part")).filter("part <> 0").dropDuplicates(["doc_id"])
    folder = shared_dir(documents.sparkSession)
    stats = cut(with_statistics(documents), folder, "statistics")
    fitted = fit(stats.join(known, "doc_id"), settings)
    return score(stats, fitted)
