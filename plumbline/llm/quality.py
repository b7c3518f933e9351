"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

A text becomes the document statistics of STATS (lengths, shares of character classes, repetition), standardised by
the training rows. FEATURES cosines with Gaussian frequencies approximate a Gaussian kernel over them; every partition
sums its share of the normal equations, the sums meet in two levels, and the ridge system of FEATURES + 1 unknowns is
solved on the driver. Folds are crc32(doc_id as text) mod 5: fold 0 is never learnt from, folds 1 to 3 fit the ridge,
fold 4 calibrates. Calibration pools adjacent violators over BINS bins of the raw score (counted over all rows of the
fold, so bounded) and interpolates between the pools; a hundredth of the score follows the raw one, so that scores
within a pool keep their order.

Labels, lang, source and doc_id are never inputs of a score. All labelled rows are used, there is no sample.

Defined cases: a null text counts as empty, and empty texts get the score of the empty statistics; repeated labels of a
document are averaged and null labels dropped; repeated documents each get a row (and count as often as they occur);
a null doc_id has no label and is not held out; with no labels at all every score is 0.5; an empty table gives no
rows; extra columns are ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, cut, keys, longs, place_of, unique_names

FOLDS, CALIBRATION_FOLD = 5, 4
FEATURES, RIDGE, BINS, CUT = 192, 1e-2, 1024, 0.3
STATS = ("bytes", "words", "word_length", "word_spread", "longest_word", "upper", "digits", "marks", "bars", "shouts", "stops", "other_signs", "non_ascii", "distinct_words", "repeats", "distinct_lines", "line_length")
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*@^~=+", b"|\\/<>[]{}", b"!", b".,;:?", b"\"'()-_`", (32, 9, 10, 11, 12, 13)), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 10


def statistics(text: str | None) -> list[float]:
    """The numbers of STATS for a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    _, upper, lower, digit, mark, bar, shout, stop, sign, _, high = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11).tolist()
    words = raw.split()
    k = max(1, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(size.mean()), math.log1p(size.std()), math.log1p(size.max()),
        upper / max(1, upper + lower), digit / n, mark / n, bar / n, shout / n, stop / n, sign / n, high / n,
        math.log1p(len(set(words))) / math.log1p(k), sum(map(operator.eq, words, islice(words, 1, None))) / k,
        len(set(lines)) / max(1, len(lines)), math.log1p(len(raw) / max(1, len(lines))),
    ]


class Model:
    """Standardisation, frequencies, weights and calibration; small, and independent of the corpus size."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(80_800)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.freq = rng.normal(0, 1 / math.sqrt(len(mean)), (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.freq + self.phase) * math.sqrt(2 / FEATURES)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        fit = np.interp(raw, self.x, self.y)
        return np.clip(0.99 * fit + 0.01 * (0.5 if len(self.x) == 1 else np.clip(raw / 3 + 1 / 3, 0, 1)), 0, 1)


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on sorted x with weights w: centre and level of each pool of adjacent violators."""
    out: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        out.append([a * c, b * c, c])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1] = [p + q for p, q in zip(out[-1], last, strict=True)]
    s = np.array(out)
    return s[:, 0] / s[:, 2], s[:, 1] / s[:, 2]


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": longs(b["doc_id"]), "x": [statistics(t) for t in b["text"]]})

    docs = keys(clashing(docs, ["doc_id", "text"]), "doc_id")
    return docs.mapInPandas(run, "doc_id long, x array<double>")


def _summed(rows: DataFrame, model: Model) -> np.ndarray:
    """[Z'Z | Z'y] over all rows(x, y): a sum for each partition, then for each of 16 groups of partitions."""
    d = FEATURES + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d + 1))
        for b in batches:
            if len(b):
                z = model.features(np.vstack(b["x"]))
                total += z.T @ np.hstack([z, b["y"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"s": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * (d + 1))
        for b in batches:
            for s in b["s"]:
                total += np.frombuffer(s)
        yield pd.DataFrame({"s": [total.tobytes()]})

    sums = rows.select("x", "y").mapInPandas(part, "s binary").repartition(16).mapInPandas(add, "s binary").collect()
    return sum((np.frombuffer(r["s"]) for r in sums), np.zeros(d * (d + 1))).reshape(d, d + 1)


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """The model for measured(doc_id, x) and labels(doc_id, quality)."""
    labels = clashing(labels, ["doc_id", "quality"]).where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    rows = cut(measured.join(labels.where(fold("doc_id") != 0), "doc_id").withColumn("fold", fold("doc_id")), "labelled")
    moments = rows.agg(F.count("*"), *[f(F.col("x")[i]) for i in range(len(STATS)) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    model = Model(np.array(moments[1::2], float), np.array(moments[2::2], float))
    sums = _summed(rows.where(F.col("fold") != CALIBRATION_FOLD), model)
    n = max(1.0, sums[0, 0])
    penalty = np.diag([0.0] + [RIDGE] * FEATURES) * n / FEATURES + 1e-9 * np.eye(FEATURES + 1)
    model.weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = model.raw(np.vstack(b["x"])) if len(b) else np.zeros(0)
            yield pd.DataFrame({"bin": np.clip(np.floor((r + 1) / 3 * BINS), 0, BINS - 1).astype(int), "y": b["y"]})

    held = rows.where(F.col("fold") == CALIBRATION_FOLD)
    bins = held.select("x", "y").mapInPandas(raw, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        at = np.array([[r["bin"], r["y"], r["n"]] for r in bins], float)
        model.x, model.y = pool((at[:, 0] + 0.5) / BINS * 3 - 1, at[:, 1], at[:, 2])
    else:
        model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text)."""
    measured = cut(measure(docs), "statistics")
    model = fit(measured, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(np.vstack(b["x"])) if len(b) else np.zeros(0)
            yield pd.DataFrame({"doc_id": longs(b["doc_id"]), "score": s, "predicted": (s >= CUT).astype(int)})

    scored = keys(measured, "doc_id").mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs predicted 1. The texts are read twice and never shuffled; only texts go through Python, so all
    columns are unchanged."""
    model = fit(measure(docs), labels)
    plain, text = unique_names(docs), f"_{place_of(docs, 'text')}"

    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATS))) >= CUT, dtype=bool)

    return plain.where(F.pandas_udf(good, "boolean")(F.col(text))).toDF(*docs.columns)
