"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame and SQL functions only.

The n-grams are all words of a text and all pairs of neighbouring words, hashed into buckets. Two
multinomials over the buckets, one of trusted documents and one of the whole corpus, give each
bucket a log ratio of smoothed probabilities; a document's score is the mean over its n-grams, so
length does not matter, and it passes if the score is not below a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SMOOTHING = 1 << 16, 1.0
#: A text is rejected whose n-grams are on average a tenth less likely in trusted texts than anywhere.
THRESHOLD = -0.1
#: Trusted ids are broadcast up to this many rows (16 MB of ids) and joined by a shuffle beyond.
MOST_BROADCAST = 2_000_000
WHITE = " \t\n\x0b\x0c\r"

_WORDS = r"split(_trimmed, r'[\x20\x09-\x0D]+')"
#: Buckets of the words w of a text, then of its word pairs.
_GRAMS = f"""concat(
  transform(w, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int)),
  CASE WHEN size(w) < 2 THEN array() ELSE transform(sequence(1, size(w) - 1), i -> cast(pmod(xxhash64(w[i - 1], w[i]), {BUCKETS}) as int)) END)"""


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("_text", whole).withColumn("_trimmed", F.btrim(whole, F.lit(WHITE)))


def bucket_counts(docs: DataFrame, text: str = "text", trusted: str = "trusted") -> dict[int, tuple[int, int]]:
    """bucket -> (occurrences in the corpus, occurrences in trusted rows): at most BUCKETS entries."""
    words = _with_words(docs.select(F.col(text).alias("_source"), F.col(trusted).alias("_trusted")), "_source").where("_trimmed <> ''")
    grams = words.selectExpr("_trusted", f"explode(get(transform(array({_WORDS}), w -> {_GRAMS}), 0)) AS bucket")
    # each task's n-grams meet in partial counts, a row a bucket, before anything moves
    return {r[0]: (r[1], r[2]) for r in grams.groupBy("bucket").agg(F.count("*"), F.count_if("_trusted")).collect()}


def weights(counts: dict[int, tuple[int, int]], smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of trusted to corpus probability for each bucket; all 0 without trusted n-grams."""
    corpus, trusted = sum(n for n, _ in counts.values()), sum(m for _, m in counts.values())
    if not trusted:
        return [0.0] * BUCKETS
    get = lambda b: counts.get(b, (0, 0))
    ratio = lambda b: math.log((get(b)[1] + smoothing) / (trusted + smoothing * BUCKETS)) - math.log((get(b)[0] + smoothing) / (corpus + smoothing * BUCKETS))
    return [round(ratio(b), 4) for b in range(BUCKETS)]


def _literal(values: list[float]) -> str:
    """An array of doubles that Catalyst folds into one literal."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<double>)"


# Words in three-word windows that occur twice or more. Windows are hashed to 64 bits; only if some
# hash repeats are they sorted, each packed into one long of its high hash bits and its position.
# Should packing join two hashes (their distinct counts differ), whole (hash, position) pairs are
# sorted instead.
_REPEATED = """
  CASE WHEN size(w) < 4 THEN 0 ELSE
    get(transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), g ->
      get(transform(array(size(array_distinct(g))), d -> CASE WHEN d = size(g) THEN 0 ELSE
        get(transform(array(cast(ceil(log2(size(g) + 1)) as int)), bits ->
          get(transform(array(sort_array(transform(g, (x, i) -> shiftleft(shiftrightunsigned(x, bits), bits) | i))), s ->
            aggregate(
              sort_array(CASE WHEN size(array_distinct(transform(s, x -> shiftrightunsigned(x, bits)))) = d THEN
                transform(
                  filter(sequence(0, size(s) - 1), i ->
                    (i > 0 AND shiftrightunsigned(s[greatest(i - 1, 0)], bits) = shiftrightunsigned(s[i], bits))
                    OR (i < size(s) - 1 AND shiftrightunsigned(s[least(i + 1, size(s) - 1)], bits) = shiftrightunsigned(s[i], bits))),
                  i -> s[i] & (shiftleft(1L, bits) - 1))
              ELSE
                get(transform(array(sort_array(transform(g, (x, i) -> struct(x AS x, cast(i as bigint) AS i)))), z ->
                  transform(
                    filter(sequence(0, size(z) - 1), i ->
                      (i > 0 AND z[greatest(i - 1, 0)].x = z[i].x)
                      OR (i < size(z) - 1 AND z[least(i + 1, size(z) - 1)].x = z[i].x)),
                    i -> z[i].i)), 0)
              END),
              struct(-3L AS last, 0L AS total),
              (a, p) -> struct(p AS last, a.total + least(3L, p - a.last) AS total),
              a -> a.total)
          ), 0)), 0)
      END), 0)), 0)
  END"""


def measure(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The base measures, the score and the verdict of every row of ``docs``.

    A null text has no words: all counts 0, score 0, base_failed. Repeated rows are judged alike.
    Columns other than the two named are ignored.
    """
    rows = _with_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_source")), "_source")
    score = f"aggregate({_GRAMS}, 0D, (a, x) -> a + {_literal(ratios)}[x], a -> a / greatest(1, 2 * size(w) - 1))"
    lines = r"filter(split(_text, '\n'), l -> btrim(l, _white) <> '')"
    by_words = rows.withColumn("_white", F.lit(WHITE)).select(
        "doc_id",
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.expr(f"get(transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) as bigint)), 0)").alias("n_dup_lines"),
        F.expr(f"inline(transform(array(CASE WHEN _trimmed = '' THEN array() ELSE {_WORDS} END), w -> struct(cast(size(w) as bigint) AS n_words, cast({_REPEATED} as bigint) AS n_repeat_words, {score} AS score)))"),
    )
    failed: Column = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return by_words.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), F.round("score", 6).alias("score"))


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` judged against those whose id is in ``trusted_ids`` (one column)."""
    ids = trusted_ids.toDF("_id").where("_id is not null").distinct()
    small = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    marked = docs.select(F.col(id_col).alias("_key"), F.col(text).alias("text"))
    ids = ids.withColumn("trusted", F.lit(True))
    marked = marked.join(F.broadcast(ids) if small else ids, F.col("_key") == F.col("_id"), "left")
    return measure(docs, weights(bucket_counts(marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")))), id_col, text, threshold)
