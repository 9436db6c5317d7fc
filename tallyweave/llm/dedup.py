"""Near-duplicate groups by bottom-k sketches from one hash function.

Every text becomes the set of its hashed word shingles; equal sets are one node. A node's sketch is
the k least hash values of its set. Inverted lists hold the nodes that retain the same three values
in a row: in the sketch of a union at least as similar as the threshold, shared values are so dense
that three of them stand side by side. With whole sets in the sketch that is certain (for the
smallest sets two suffice and are listed too), with truncated ones it fails in one case in 10**12. Similar sets of some size
share several lists, so nodes in fewer lists drop out.
Texts that merely have phrases or a passage in common rarely meet in a list. A list is not expanded
into pairs: its members are first compared with a few leaders. Nodes that still share several lists with
other components meet once more, by full sets: with shingles ordered from rare
to frequent, similar sets share one among their first, rarest few, at places that leave room for
the overlap they need (the prefix and position filters of Xiao et al., 2008). Passages and phrases
that many texts share are not among these, so few pairs remain. Each compared pair passes the
estimate from the sketch of the union before the exact similarity of the full sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, lean, release, slices, stored

SKETCH, MISS = 80, 1e-12
#: Retained values in a row that make a list's key, and sets so small that two make one as well.
RUN, SMALL = 3, 5
#: Sets of so many shingles or more share so many lists with a similar set. For whole sets in the
#: sketch that is certain, for truncated ones it fails in 5 cases in 10**10 at the threshold itself.
LISTS, FROM_SIZE = 4, 15
LEADERS = 3
#: Values of the union's sketch from which a pair's similarity is estimated.
ESTIMATE = 256
#: Tables of nodes are broadcast up to this many rows (some 40 bytes each) and shuffled beyond.
MOST_BROADCAST = 500_000


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """The most c for which Binomial(k, percent/100) is below c with probability ``miss`` at most."""
    p, below, c = percent / 100, 0.0, 0
    while c < k:
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > miss:
            break
        c += 1
    return max(1, c)


def shingles(text: str | None, width: int):
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z in lower case.

    With fewer words than ``width`` the whole sequence is the one shingle; without words there is none.
    """
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # ASCII case and white space only
    if not words:
        return np.empty(0, np.int64)
    if len(words) < width:
        return np.array([xxh3_64_intdigest(b"\0" + b" ".join(words))], np.uint64).view(np.int64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(width):
        mixed = (mixed ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _lists(arrays: list) -> pa.Array:
    import numpy as np

    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def run_keys(sketch):
    """One hash for each run of retained values; each value is a hash already."""
    import numpy as np

    out, v = [], sketch.view(np.uint64)
    for run in (RUN, RUN - 1) if len(v) <= SMALL else (RUN,):
        if len(v) >= run:
            h = np.full(len(v) - run + 1, run, np.uint64)
            for j in range(run):
                h = (h ^ v[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            out.append(h.view(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """id, mark (a hash of the text), n (size of the set), node (128-bit digest of the set), keys."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        lean()
        for b in slices(batches):
            sets = [shingles(t, width) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), _lists([run_keys(s[:k]) for s in sets])],
                names=["id", "mark", "n", "node", "keys"],
            )

    return rows.mapInArrow(run, T.StructType([kind, T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def inverted(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """value, nid, n: the inverted lists that hold two different nodes or more.

    Postings carry 64 bits of the node; where these meet by chance, both nodes join the list.
    """
    postings = rows.where("node is not null").select(F.xxhash64("node").alias("tag"), F.explode("keys").alias("value"))
    several = postings.groupBy("value").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low <> high").select("value")
    return postings.join(several, "value").distinct().join(nodes.select("tag", "nid", "n"), "tag").select("value", "nid", "n")


def _in_enough(lists: DataFrame) -> DataFrame:
    """nid of the nodes in as many lists as they would share with a similar node."""
    enough = F.when(F.col("n") >= FROM_SIZE, LISTS).otherwise(1)
    return lists.groupBy("nid", "n").agg(F.count("*").alias("m")).where(F.col("m") >= enough).select("nid")


def rare_lists(sets: DataFrame, percent: int) -> DataFrame:
    """value, nid, n, at, short: the rarest shingles of each set, with their place from rare to frequent.

    Two similar sets share one that is ``short`` in the smaller set (or in either, if equal).
    """
    postings = sets.select("nid", F.explode("set").alias("value"))
    often = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # gathered by text: a group is the shingles of one text
    shared = postings.join(often, "value").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    sized = shared.join(sets.select("nid", F.size("set").alias("n")), "nid")
    alone = F.col("n") - F.size("values")
    extra = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    rare = sized.where(extra > 0).select("nid", "n", alone.alias("alone"), F.posexplode(F.slice("values", F.lit(1), extra)).alias("i", "x"))
    at = (F.col("alone") + F.col("i")).cast("int")
    return rare.select(F.col("x.value").alias("value"), "nid", "n", at.alias("at"), (at <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))).alias("short"))


def _sets_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that ``pairs`` need, without shuffling the others if the pairs are few."""
    ids = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    few = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return sets.join(F.broadcast(ids) if few else ids, "nid", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, k: int = ESTIMATE) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact similarity reaches the threshold."""
    sketch = _sets_of(pairs, sets).select("nid", F.slice("set", 1, k).alias("sketch"))
    both = (
        pairs.join(sketch.toDF("a", "sa"), "a")
        .join(sketch.toDF("b", "sb"), "b")
        .withColumn("union", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k))
        .withColumn("common", F.size(F.array_intersect("union", F.array_intersect("sa", "sb"))))
    )
    # With k values in the union's sketch the estimate may err by what MISS allows; with fewer it is exact.
    bar = F.when(F.size("union") >= k, F.lit(least_shared(k, percent))).otherwise(F.floor((F.size("union") * percent + 99) / 100).cast("int"))
    likely = stored(both.where(F.col("common") >= bar).select("a", "b"), "likely")
    own = _sets_of(likely, sets)
    full = likely.join(own.toDF("a", "set_a"), "a").join(own.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return full.where(common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent).select("a", "b")


def _components(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """nid, root for every node that is not the least of its component in ``links`` (a, b).

    ``roots`` are the components of earlier links, which the new ones join. Rounds of large-star and
    small-star steps (Kiveris et al., 2014): only partial minima are grouped, so a hub's links are
    never gathered in one task.
    """
    pairs = links.toDF("u", "v")
    if roots is not None:
        up = lambda c: roots.toDF(c, f"r{c}")
        pairs = pairs.join(up("u"), "u", "left").join(up("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    edges = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = state(edges)
    while before[0]:
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of u, and u, point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        turned = stored(small.where("u <> v").distinct(), "edges")
        drop_stored(edges)
        edges, after = turned, state(turned)
        if after == before:
            break
        before = after
    new = edges.toDF("nid", "root")
    if roots is None:
        return new
    moved = roots.join(edges.toDF("root", "top"), "root", "left").select("nid", F.coalesce("top", "root").alias("root"))
    return stored(moved.unionByName(new), "roots")


def _with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    return lists.join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))


def _open(members: DataFrame) -> DataFrame:
    """The lists whose members are in more than one component."""
    several = members.groupBy("value").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("value")
    return stored(members.join(several, "value"), "open")


def _near(percent: int) -> Column:
    n, n2 = F.col("n") * 100, F.col("n2") * 100
    return (n >= F.col("n2") * percent) & (n2 >= F.col("n") * percent)


def _ordered() -> list[Column]:
    return [F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b")]


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """Two tables: id, mark, n, node of every row of ``docs``; node, root of every node.

    Texts that are null, empty or without words have n = 0 and a null node, and link with nothing.
    Repeated rows and equal sets share a node. Null ids are ids like any other.
    """
    if percent < 80:
        raise ValueError("the lists are proven for similarities of 0.8 or more")
    spark = docs.sparkSession
    sketched = stored(sketches(docs, id_col, text_col, width, k), "sketches")
    picked = sketched.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("id", "mark")).alias("pick"))
    nodes = stored(picked.select(F.monotonically_increasing_id().alias("nid"), "node", F.xxhash64("node").alias("tag"), "n", F.col("pick.id").alias("id"), F.col("pick.mark").alias("mark")), "nodes")
    every = stored(inverted(sketched, nodes), "every")
    rows = stored(sketched.select("id", "mark", "n", "node"), "rows")
    drop_stored(sketched)
    release(spark)
    lists = stored(every.join(_in_enough(every), "nid", "left_semi"), "lists")
    drop_stored(every)
    wanted = stored(nodes.join(lists.select("nid").distinct(), "nid", "left_semi").select("id", "mark", "nid"), "wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    hits = texts.join(F.broadcast(wanted) if few else wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["mark"] == wanted["mark"])).select("nid", "text").dropDuplicates(["nid"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t, width) for t in b.column(1).to_pylist()])], names=["nid", "set"])

    sets = stored(hits.mapInArrow(full, "nid long, set array<long>"), "sets")
    release(spark)

    # Each member with up to LEADERS nodes that lead its lists: those in the most and longest lists,
    # as an original is among its edited copies. A list has one leader of either hash parity.
    longest = lists.join(lists.groupBy("value").agg(F.count("*").alias("m")), "value").groupBy("nid").agg(F.sum("m").alias("score"))
    scored = lists.join(longest, "nid")
    of = lambda parity: F.max(F.when(F.pmod(F.xxhash64("nid"), F.lit(2)) == parity, F.struct("score", "nid", "n")))
    lead = scored.groupBy("value").agg(of(0).alias("l0"), of(1).alias("l1")).select("value", F.explode(F.array("l0", "l1")).alias("l"))
    lead = lead.where("l is not null").select("value", F.col("l.score").alias("score"), F.col("l.nid").alias("nid2"), F.col("l.n").alias("n2"))
    # a node has at most 2 * SKETCH of these
    led = lists.join(lead, "value").where((F.col("nid") != F.col("nid2")) & _near(percent)).groupBy("nid").agg(F.collect_set(F.struct("score", "nid2")).alias("leaders"))
    first = led.select("nid", F.explode(F.slice(F.sort_array("leaders", False), 1, LEADERS)).alias("l")).select("nid", F.col("l.nid2").alias("nid2"))
    pairs = stored(first.select(*_ordered()).distinct(), "pairs")
    roots = _components(stored(_similar(pairs, sets, percent), "links"))
    release(spark)

    # what is still apart, by the rarest shingles
    still = _open(_with_roots(lists, roots))
    left = stored(_in_enough(still), "left")
    members = _open(_with_roots(rare_lists(sets.join(left, "nid", "left_semi"), percent), roots))
    other = members.where("short").select("value", F.col("nid").alias("nid2"), F.col("n").alias("n2"), F.col("root").alias("root2"), F.col("at").alias("at2"))
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    more = members.join(other, "value").where((F.col("root") != F.col("root2")) & (F.col("n2") <= F.col("n")) & _near(percent) & room)
    more = stored(more.select(*_ordered()).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    roots = _components(stored(_similar(more, sets, percent), "links"), roots)
    for done in (still, members, sets, lists):
        drop_stored(done)
    release(spark)
    return rows, nodes.join(roots, "nid", "left").select("node", F.coalesce("root", "nid").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """id, mark, n_shingles, component_id (the least id in the component) for every row.

    Nulls aside, a row is kept if its id is its component's. Rows without words are components of
    their own. If all ids of a component are null, so is component_id.
    """
    rows, roots = link(docs, id_col, text_col, width, percent, k)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least")).join(roots, "node")
    whole = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(whole, "root").select("node", "component_id")
    out = rows.join(named, "node", "left")
    return out.select("id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one of the least id, all columns kept.

    Rows without words all stay. Of rows that repeat both id and text one stays. If every id of a
    component is null, one of its rows stays.
    """
    rows, roots = link(docs, id_col, text_col, width, percent)
    best = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "mark")).alias("best")).join(roots, "node")
    chosen = best.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias("_id"), F.col("best.mark").alias("_mark"))
    times = rows.where("node is not null").groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count("*").alias("_times"))
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_mark"] == b["_mark"])
    chosen = chosen.join(times, same(chosen, times)).select(chosen["_id"], chosen["_mark"], "_times")
    # whole rows travel as one struct, so no name of theirs can clash
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    tagged = docs.select(whole.alias("_row"), docs[id_col].alias("_own"), F.xxhash64(docs[text_col]).alias("_own_mark"), (~F.coalesce(docs[text_col].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).alias("_blank"))
    found = tagged.join(chosen, tagged["_own"].eqNullSafe(chosen["_id"]) & (tagged["_own_mark"] == chosen["_mark"]) & ~tagged["_blank"], "left").where("_blank or _times is not null")
    once = found.where("_blank or _times = 1").select("_row.*")
    repeated = found.where("not _blank and _times > 1").dropDuplicates(["_own", "_own_mark"]).select("_row.*")
    return once.unionByName(repeated)
