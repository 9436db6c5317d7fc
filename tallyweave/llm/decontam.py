"""Benchmark decontamination by template windows, in DataFrame and SQL functions only.

Words become canonical tokens: numbers, names (words with a capital inside a sentence, and at its
start unless they are words that sentences often open with) and units after a number turn into typed
placeholders, the rest is lower-cased without punctuation. In scripts that put no spaces between
words every character is a token. Windows
of tokens of benchmark items and documents are joined by hash. The windows that a document shares
with an item along one alignment must fill the item's slots consistently, one value of the document
for one of the item and the reverse: then the passage is the item's, if with other parameters.
Windows that are mostly slots say too little as templates; they are matched by their very words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, SHARE, RUN = 8, 0.5, 13
#: Items with fewer tokens are compared with whole texts only.
SHORTEST = 4
#: Up to so many benchmark windows are broadcast (some 40 MB); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

#: Unit words that become a placeholder directly after a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh km/h hz khz mhz ghz w kw kwh v a n j kj cal kcal pa kpa k c f percent % dollar dollars cent cents euro euros usd eur gbp kb mb gb tb"
).split()

#: Words that open sentences, so that a capital there does not make them names.
OPENERS = (
    "a about above according across add after again all also although among an and another any are as at based be because before below between both but by "
    "calculate can choose compare complete compute consider convert could count define describe despite determine did do does draw due during each either estimate "
    "evaluate even every evaluates explain few fill find first five following for four from given give had has have he her here his how however i identify if imagine "
    "in inside instead is it its just later let like list look make many match may might more most much multiply must my name near next no not note now of on once one "
    "only or order other our out over per pick place please put read round second select several she should show simplify since sixty solve some sort state subtract "
    "such suppose take tell that the their them then there these they this those though three through to two under until up use using was we were what when where "
    "whether which while who whom whose why will with without would write yes yet you your"
).split()

#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, and Chinese characters.
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]"
_PUNCTUATION = r'.,;:!?()[]{}"“”«»…'
_IS_NUMBER = r"rlike(w[i], r'^[(\[\"$€£+-]*[0-9][0-9.,:/]*[%)\].,;:!?\"]*$')"
_AFTER_NUMBER = "i > 0 AND right(w[greatest(i - 1, 0)], 1) BETWEEN '0' AND '9'"
_IS_NAME = f"""lower(left(w[i], 1)) <> left(w[i], 1) AND upper(w[i]) <> w[i]
          AND (i > 0 AND right(w[greatest(i - 1, 0)], 1) NOT IN ('.', '!', '?', ':', '"') OR c NOT IN ({", ".join(f"'{x}'" for x in OPENERS)}))"""


def _canonical(rows: DataFrame, text: str) -> DataFrame:
    """Adds h, slots and words of the words in ``text``.

    h has a hash for each token, for slots the code of their type's letter (n number, u unit, m
    name) instead; slots has at, kind and value of each slot; words has the tokens as they are, in
    texts with slots. Line ends count as sentence ends. A word of punctuation alone is no token.
    """
    units = ", ".join(f"'{u}'" for u in UNITS)
    clean = f"lower(translate(x, '{_PUNCTUATION}', ''))"
    # most words begin with a small letter and are no unit: they skip the other tests
    code = f"""CASE
      WHEN c = '' THEN NULL
      WHEN w[i] >= 'a' AND w[i] < '{{' AND c NOT IN ({units}) THEN xxhash64(c)
      WHEN w[i] < 'A' AND {_IS_NUMBER} THEN cast(ascii('n') as bigint)
      WHEN c IN ({units}) AND {_AFTER_NUMBER} THEN cast(ascii('u') as bigint)
      WHEN {_IS_NAME} THEN cast(ascii('m') as bigint)
      ELSE xxhash64(c) END"""
    whole = f"CASE WHEN rlike({text}, r'{_UNSPACED}') THEN regexp_replace({text}, r'({_UNSPACED})', ' $1 ') ELSE coalesce({text}, '') END"
    words = rf"split(btrim(replace({whole}, '\n', '. '), ' \t\u000B\u000C\r'), r'[\x20\x09-\x0D]+')"
    is_slot = "x BETWEEN 0 AND 127"
    slots = f"filter(transform(q.h, (x, i) -> CASE WHEN {is_slot} THEN struct(i AS at, char(x) AS kind, q.c[i] AS value) END), x -> x IS NOT NULL)"
    bound = f"""
      inline(transform(array({words}), w ->
        get(transform(array(transform(w, x -> {clean})), cores ->
          get(transform(array(transform(cores, (c, i) -> {code})), g ->
            get(transform(array(struct(filter(g, x -> x IS NOT NULL) AS h, filter(cores, c -> c <> '') AS c)), q ->
              CASE WHEN exists(q.h, x -> {is_slot}) THEN struct(q.h AS h, {slots} AS slots, q.c AS words) ELSE struct(q.h AS h, array() AS slots, array() AS words) END
          ), 0)), 0)), 0)))"""
    return rows.select(*[c for c in rows.columns if c != text], F.expr(bound))


def _windows(rows: DataFrame, sizes: list[int], whole: bool = False) -> DataFrame:
    """Adds size, at and key for each window of one of ``sizes`` tokens; ``whole`` leaves those of a row's own size.

    The key is of the template where at least half of the tokens are literal, else of the words. Windows
    below SHORTEST tokens are whole texts, by their words.
    """

    def key(width: int) -> str:
        one = f"xxhash64({', '.join(f'h[at + {j}]' for j in range(width))})"
        words = f"xxhash64('words', {', '.join(f'words[at + {j}]' for j in range(width))})"
        literal = " + ".join(f"int(h[at + {j}] NOT BETWEEN 0 AND 127)" for j in range(width))
        by_words = f"2 * ({literal}) < {width}" if width >= SHORTEST else "true"
        return f"CASE WHEN size(slots) > 0 AND {by_words} THEN {words} ELSE {one} END"

    kept = [c for c in rows.columns if c not in ("h", "words", "slots")]
    # the arrays are made before the windows are; keys of windows are then compiled code over them
    sized = rows.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    sized = sized.where(F.col("size") == F.least(F.size("h"), F.lit(max(sizes)))) if whole else sized
    starts = F.expr(f"CASE WHEN size(h) >= size AND (size >= {SHORTEST} OR size(h) = size) THEN sequence(0, size(h) - size) ELSE array() END")
    placed = sized.select("*", F.explode(starts).alias("at"))
    return placed.select(*kept, "slots", "size", "at", F.expr(f"CASE {' '.join(f'WHEN size = {n} THEN {key(n)}' for n in sizes)} END").alias("key"))


# Whether a window at ``at`` is matched by its words: it has more slots than literal tokens, or is short.
_BY_WORDS = f"2 * size(filter(slots, x -> x.at BETWEEN at AND at + size - 1)) > size OR size < {SHORTEST} AND size(slots) > 0"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, share: float = SHARE, run: int = RUN) -> DataFrame:
    """doc_id, mark (hash of the text), item_id, n_windows, covered, reworded: leaked items by document.

    An item leaks into a text that shares ``share`` of the item's windows, or ``run`` of them, over
    consistent alignments; the same share of its template windows alone is enough, as windows matched
    by their words are lost where slots have other values. Items with fewer than ``width`` tokens are one
    window of their own size; those with fewer than four leak only into texts that are the same words and
    nothing else, empty ones never. reworded: some slot has another value than in the item. Null texts
    leak nothing; rows that repeat an id and a text, or an item, count once. Other columns are ignored.
    """
    mark = F.xxhash64(text).alias("mark")
    d = _canonical(docs.select(F.col(id_col).alias("doc_id"), mark, F.col(text).cast("string").alias("_text")), "_text")
    b = _canonical(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("_text")).where("_text is not null").distinct(), "_text").where("size(h) > 0")
    sizes = sorted(r[0] for r in b.select(F.least(F.size("h"), F.lit(width))).distinct().collect()) or [width]  # at most ``width``
    windows = _windows(b, sizes if width in sizes else [*sizes, width], whole=True)
    items = windows.select("item_id", "size", F.col("at").alias("item_at"), "key", F.expr(_BY_WORDS).alias("exact"), F.col("slots").alias("item_slots"))
    few = items.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    # documents are read and their words made canonical once, whatever the sizes of the items
    found = _windows(d, sizes).join(F.broadcast(items) if few else items, ["size", "key"])
    inside = lambda s, at: F.expr(f"transform(filter({s}, x -> x.at BETWEEN {at} AND {at} + size - 1), x -> struct(x.at - {at} AS at, x.kind AS kind, x.value AS value))")
    found = found.select("doc_id", "mark", "item_id", "size", "exact", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), inside("slots", "at").alias("ds"), inside("item_slots", "item_at").alias("bs"))
    # windows matched by their words have the item's values, so they take no part in the check
    pairs = F.expr("filter(transform(ds, (x, i) -> struct(x.kind AS kind, bs[i].value AS ours, x.value AS theirs)), p -> NOT exact)")
    # an alignment has one window for each of the item's positions at most, so its group is small
    aligned = found.select("doc_id", "mark", "item_id", "size", "exact", "shift", "item_at", pairs.alias("pairs")).distinct()
    aligned = aligned.groupBy("doc_id", "mark", "item_id", "size", "exact", "shift").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    one_to_one = F.expr("size(pairs) = size(array_distinct(transform(pairs, p -> struct(p.kind, p.ours)))) AND size(pairs) = size(array_distinct(transform(pairs, p -> struct(p.kind, p.theirs))))")
    places = lambda kept: F.size(F.array_distinct(F.flatten(F.collect_list(kept))))
    covered = aligned.where(one_to_one).groupBy("doc_id", "mark", "item_id", "size").agg(
        places(F.col("places")).alias("covered"), places(F.when(~F.col("exact"), F.col("places"))).alias("by_template"), F.bool_or(F.expr("exists(pairs, p -> p.ours <> p.theirs)")).alias("reworded")
    )
    totals = items.select("item_id", "size", "item_at", "exact").distinct().groupBy("item_id", "size").agg(F.count("*").cast("int").alias("n_windows"), F.count_if(~F.col("exact")).cast("int").alias("n_templates"))
    reached = lambda got, of: F.col(got) >= F.least(F.lit(run), F.ceil(F.col(of) * share))
    enough = reached("covered", "n_windows") | (F.col("n_templates") > 0) & reached("by_template", "n_templates")
    return covered.join(totals, ["item_id", "size"]).where(enough).select("doc_id", "mark", "item_id", "n_windows", "covered", "reworded")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows into whose text a benchmark item leaks; all columns kept."""
    found = leaks(docs, benchmark, id_col, text).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(docs[text]) == found["_mark"]), "left_anti")
