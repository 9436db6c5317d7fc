"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Every labelled row counts towards the ratios; the classifier on the scaled presence of n-grams is
fitted (FTRL, elastic net) on a bounded sample of labelled rows. Scores are probabilities.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, lean, map_rows, slices
from .linear import Ftrl, hashed_grams

SIZES, BITS = (4, 5), 18
#: Ratios nearer to 0 than this, in log units, tell nothing and are left out.
LEAST_RATIO = 0.5
#: The bound on the sample that fits the classifier.
SAMPLE = 8000
#: Labels are broadcast up to this many rows and joined by a shuffle beyond.
MOST_BROADCAST = 2_000_000
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    weights: object  # float64 by feature: ratio times weight
    intercept: float

    @functools.cached_property
    def telling(self):
        return self.weights != 0

    def score(self, text: str | None) -> float:
        import math

        import numpy as np

        seen = [np.unique(part[self.telling[part]]) for part in hashed_grams(text or "", SIZES, BITS)]
        total = self.intercept + float(self.weights[np.unique(np.concatenate(seen))].sum() if seen else 0.0)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def _present(text: str | None):
    import numpy as np

    parts = [np.unique(p) for p in hashed_grams(text or "", SIZES, BITS)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def _ratios(rows: DataFrame):
    """Smoothed log ratio of each feature's frequency in label 1 to that in label 0, and the counts."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[label, _present(text)] += 1
                n[label] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], n[0])), pa.array(np.append(total[1, at], n[1]))], names=["feature", "n0", "n1"])

    # one row a feature reaches the driver: at most 2**BITS + 1, as columns
    table = rows.select("text", "label").mapInArrow(run, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts, n = np.zeros((2, 1 << BITS)), (0, 0)
    at, n0, n1 = (np.asarray(table[c]) for c in ("feature", "n0", "n1"))
    real = at >= 0
    counts[0, at[real]], counts[1, at[real]] = n0[real], n1[real]
    if (~real).any():
        n = int(n0[~real][0]), int(n1[~real][0])
    return np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2)), n


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, ftrl: Ftrl = Ftrl(alpha=0.5, l1=2.0, l2=0.01, epochs=8)) -> Model:
    """A model from the rows of ``docs`` whose id ``labels`` marks 0 or 1.

    Null ids and labels do not count; an id with several labels is toxic if any is 1. Rows that repeat
    an id all count towards the ratios; the classifier sees one of them. With rows of one label only,
    or none, every score is the smoothed share of label 1.
    """
    import math

    import numpy as np

    marks = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    small = marks.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(marks) if small else marks, "id")
    ratios, n = _ratios(rows)
    if not all(n):
        return Model(np.zeros(1 << BITS), math.log((n[1] + 1) / (n[0] + 1)))
    telling = np.abs(ratios) >= LEAST_RATIO
    # the sample's ids: at most ``sample``, so the broadcast is bounded
    ids = texts.select("id").join(F.broadcast(marks) if small else marks, "id").select("id").distinct()
    chosen = ids.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample)
    # one text an id, so that many rows of one id stay out of the sample
    fitted = rows.join(F.broadcast(chosen), "id", "left_semi").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features():
        def work(values):
            made = [_present(t) for t in values]
            return [[f[telling[f]].astype(np.int32).tolist() for f in made]]

        return work

    table = map_rows(fitted, ["text"], [T.StructField("at", T.ArrayType(T.IntegerType()))], features).select("id", "label", "at").toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (_mix(table["id"][i].as_py()), i))
    data = [(at, ratios[at]) for at in (np.asarray(table["at"][i].values, dtype=np.int64) for i in order)]
    w = ftrl.fit(data, [table["label"][i].as_py() for i in order], 2, 1 << BITS)
    w = w[:, 1] - w[:, 0]
    return Model(np.where(telling, w[:-1] * ratios, 0.0), float(w[-1]))


def _mix(value) -> int:
    import zlib

    return zlib.crc32(f"order/{value}".encode())


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 if the score is ``threshold`` or more).

    Null texts score as empty ones. All rows and other columns are kept; columns named score or
    predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(texts):
            scores = [shared.value.score(t) for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return map_rows(docs, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)


def standard_holdout(id_col: str = "doc_id"):
    return crc_mod(F.col(id_col), 3) == 1


def classify(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted of every row, learned from labels of rows not held out."""
    rows = docs.select(F.col(id_col), F.col(text), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(rows.where("not held_out"), labels, id_col, text, label)
    return score(rows, model, text).drop(text)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score as toxic; all columns kept, whatever their names."""
    model = train(docs, labels, id_col, text)
    shared, schema, place = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in slices(batches):
            yield b.filter(pa.array([shared.value.score(t) < threshold for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
