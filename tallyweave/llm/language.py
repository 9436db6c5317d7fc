"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every labelled row, the regression (FTRL, elastic net) from a
bounded sample of them with as many rows of each language as there are, up to a cap; a fifth of
the sample is kept from the fit and sets the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_rows, slices
from .linear import Ftrl, counts, softmax, temperature

SIZES, BITS = (1, 2, 3), 15
#: The bound on the sample that fits the regression: rows a language, in expectation.
SAMPLE = 1000
UNKNOWN = "und"
#: More distinct labels than this are no languages.
MOST_LANGUAGES = 1000


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: object  # float32 by feature
    weights: object  # float32 (features + 1, languages)
    temperature: float

    def vector(self, text: str | None):
        import numpy as np

        at, n = counts(text, SIZES, BITS)
        x = (1.0 + np.log(n)) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def scores(self, text: str | None):
        at, x = self.vector(text)
        return x @ self.weights[at] + self.weights[-1]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _frequencies(rows: DataFrame, text: str):
    """Document frequency of each feature over all rows, and their number."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in slices(batches):
            for value in b.column(0).to_pylist():
                total[counts(value, SIZES, BITS)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "n"])

    out, n = np.zeros(1 << BITS), 0
    # one row a feature: at most 2**BITS + 1
    for feature, times in rows.select(text).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        if feature < 0:
            n = times
        else:
            out[feature] = times
    return out, n


def train(rows: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, ftrl: Ftrl = Ftrl(alpha=0.5, l1=0.002, l2=0.0005, epochs=4)) -> Model | None:
    """A model from the labelled rows; None if there are none with a letter in their text.

    All rows count towards document frequencies; of rows that repeat an id and label the regression
    sees one. More than MOST_LANGUAGES distinct labels are an error.
    """
    import numpy as np

    known = rows.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    df, n = _frequencies(known, "text")
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    unit = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11).cast("double") / float(2**53)
    # one text an id and language, so that many rows of one id stay out of the sample
    chosen = known.where(unit < share[F.col("lang")]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    blank = Model(languages, idf, None, 1.0)

    def vectors():
        def work(texts):
            made = [blank.vector(t) for t in texts]
            return [[a.astype(np.int32).tolist() for a, _ in made], [x.tolist() for _, x in made]]

        return work

    fields = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))]
    table = map_rows(chosen, ["text"], fields, vectors).drop("text").toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (_mix(table["id"][i].as_py()), i))
    data = [(np.asarray(table["at"][i].values), np.asarray(table["x"][i].values, dtype=np.float64)) for i in order]
    labels = [languages.index(table["lang"][i].as_py()) for i in order]
    cut = len(data) - len(data) // 5
    w = ftrl.fit(data[:cut], labels[:cut], len(languages), 1 << BITS)
    held = np.array([x @ w[at] + w[-1] for at, x in data[cut:]]) if cut < len(data) else np.empty((0, len(languages)))
    return Model(languages, idf, w.astype(np.float32), temperature(held, np.array(labels[cut:], dtype=np.int64)))


def _mix(value) -> int:
    import zlib

    return zlib.crc32(f"order/{value}".encode())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the calibrated probability.

    Texts that are null or have no letter, and all texts if there is no model, get ``und`` and 0.
    Ties go to the first language in alphabetical order. All rows and other columns are kept; columns
    named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def one(m: Model | None, value):
            if m is None or not _has_letter(value):
                return UNKNOWN, 0.0
            p = softmax(m.scores(value), m.temperature)
            best = int(p.argmax())
            return m.languages[best], float(p[best])

        def work(texts):
            made = [one(shared.value, t) for t in texts]
            return [[a for a, _ in made], [b for _, b in made]]

        return work

    return map_rows(docs, [text], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start)


def identify(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    rows = docs.select(F.col(id_col), F.col(text), F.col(lang), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(rows.where("not held_out"), id_col, text, lang)
    return predict(rows.drop(lang), model, text).drop(text)


def standard_holdout(id_col: str = "doc_id"):
    return crc_mod(F.col(id_col), 4) == 2
