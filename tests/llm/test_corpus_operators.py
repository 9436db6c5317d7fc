"""Language, toxicity, near-duplicates, sharding and WARC: brute force, laws and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import dedup, language, sharding, toxicity, warc
from tallyweave.llm.linear import hashed_grams

ODD = [None, "", " \n", "a", "1 2 3", "a a a a a a a"]


def brute_components(texts, width, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def similar_texts(seed):
    r = random.Random(seed)
    say = lambda n: [r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("rstlnm") for _ in range(n)]
    texts, passage = list(ODD), say(40)
    for n in (1, 2, 3, 4, 5, 6, 8, 12, 30, 60, 150, 400):
        base = say(n)
        for edits in (0, 0, 1, 1, 2, n // 40, n // 20, n // 12, n // 10, n // 9, n // 8):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = "zz" + r.choice("qxy")
            texts.append(" ".join(w))
            texts.append("\n".join(x.upper() for x in w))
    texts += [" ".join(say(25) + passage + say(25)) for _ in range(25)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5)])
def test_components_equal_brute_force(spark, seed, width):
    texts = similar_texts(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.id: (r.n_shingles, r.component_id) for r in dedup.groups(df, width=width).collect()}
    assert got == brute_components(texts, width)


def test_keep_one(spark):
    texts = similar_texts(3)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _mark string")
    again = df.where("doc_id in (3, 5)")
    got = dedup.keep_one(df.unionByName(again), width=5)
    want = [i for i, (n, c) in brute_components(texts, 5).items() if n == 0 or c == i]
    blank = [i for i in (3, 5) if not (texts[i] or "").split()]
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(want + blank)


def test_keep_one_with_null_and_clashing_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(None, a), (None, a), (7, a), (7, b), (9, b), (None, None), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in dedup.keep_one(df).collect())
    assert got == Counter({(7, a): 1, (7, b): 1, (None, None): 2, (4, ""): 1})


def test_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.groups(empty).count() == 0 and dedup.keep_one(empty).count() == 0
    with pytest.raises(ValueError):
        dedup.link(empty, percent=50)


def test_runs_of_small_sets_always_meet():
    # any two whole sets at the threshold share a key, whatever the places where they differ
    import numpy as np

    r = random.Random(4)
    for _ in range(3000):
        n = r.randint(4, 60)
        union = np.array(sorted(r.sample(range(10**9), n)), np.int64)
        gone = r.sample(range(n), n // 5)
        cut = r.randint(0, len(gone))
        a, b = np.delete(union, gone[:cut]), np.delete(union, gone[cut:])
        shared = len(set(dedup.run_keys(a)) & set(dedup.run_keys(b)))
        assert shared >= (dedup.LISTS if min(len(a), len(b)) >= dedup.FROM_SIZE else 1)


def test_sharding_law(spark):
    texts = [*ODD, *("t" * (i % 50) for i in range(3000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "n", "x"), (3, "a", "x")], "doc_id long, text string, shard string")
    got = sharding.assign(df).collect()
    assert len(got) == len(texts) + 2
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key" and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i, t in enumerate(texts):
        if i != 3:
            data = (t or "").encode()
            assert (by_id[i].size, by_id[i].text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert sharding.assign(df.limit(0)).count() == 0


def places(spark, tree, n=4000):
    return {r.id: r.s for r in spark.range(n).select("id", sharding.descend("id", tree).alias("s")).collect()}


def test_growth_takes_keys_only_into_a_new_region(spark):
    for n in (4, 16):
        before, after = places(spark, sharding.topology(n)), places(spark, sharding.topology(n + 1))
        assert all(after[i] in (before[i], n) for i in before) and abs(sum(s == n for s in after.values()) / 4000 - 1 / (n + 1)) < 0.02
    sizes = Counter(places(spark, sharding.topology(16)).values())
    assert len(sizes) == 16 and min(sizes.values()) > 180 and max(sizes.values()) < 320


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    shards = sharding.topology(12).shards  # regions 0-3, 4-7, 8-11; racks of two
    region, rack = {s.number: s.region for s in shards}, {s.number: s.rack for s in shards}
    before = places(spark, sharding.Tree(shards))
    # a rack's own weight among its siblings: keys enter that rack, from its own region alone
    after = places(spark, sharding.Tree(shards, regions=((0, 4.0), (1, 4.0), (2, 4.0)), racks=(((1, 3), 6.0),)))
    moved = [i for i in before if before[i] != after[i]]
    assert moved and all(rack[after[i]] == 3 and region[before[i]] == 1 for i in moved)
    # a shard's weight, summed up the tree: into its region, in the region into its rack, in the rack into it
    after = places(spark, sharding.Tree(tuple(sharding.Shard(s.number, s.region, s.rack, 4.0 if s.number == 5 else 1.0) for s in shards)))
    moved = [i for i in before if before[i] != after[i]]
    assert moved and all(region[after[i]] == 1 for i in moved)
    assert all(rack[after[i]] == 2 for i in moved if region[before[i]] == 1) and all(after[i] == 5 for i in moved if rack[before[i]] == 2)
    # a shard that goes inside a region of fixed weight moves keys inside that region alone
    after = places(spark, sharding.Tree(tuple(s for s in shards if s.number != 9), regions=((2, 4.0),)))
    assert all(region[before[i]] == region[after[i]] == 2 for i in before if before[i] != after[i]) and 9 not in after.values()


def test_the_tree_decides_placement(spark):
    flat = sharding.Tree(tuple(sharding.Shard(s, 0, 0) for s in range(8)))
    named = sharding.Tree(tuple(sharding.Shard(s, 7 - s // 4, s // 2) for s in range(8)))
    a, b, c = (places(spark, t, 1000) for t in (sharding.topology(8), flat, named))
    assert sum(a[i] != b[i] for i in a) > 500 and sum(a[i] != c[i] for i in a) > 200
    with pytest.raises(ValueError):
        sharding.descend("id", sharding.Tree((sharding.Shard(0, 0, 0, 0.0),)))


def test_descent_equals_plain_draws(spark):
    r = random.Random(11)
    tree = sharding.Tree(tuple(sharding.Shard(s, r.randrange(3), r.randrange(3), r.choice([0.0, 0.5, 1.0, 3.0])) for s in range(14)), regions=((1, 2.5),))
    names = [n for part in (lambda x: (x[0], *x[1], *x[2]))(tree.children()) for n, _, _ in part]
    hashed = spark.range(300).select("id", *(F.xxhash64("id", F.lit(n)).alias(n.replace("/", "_")) for n in names)).collect()
    got = places(spark, tree, 300)
    regions = {s.region for s in tree.shards}

    def weight(part):
        if len(part) == 1 and part[0] == 1:
            return 2.5
        return sum(s.weight for s in tree.shards if (s.region, s.rack, s.number)[: len(part)] == part)

    for row in hashed:

        def draw(part):
            bits = (row["_".join(map(str, part))] % 2**64) >> 12
            return -math.log((bits + 0.5) / 2**52) / weight(part)

        at = ()
        for level in range(3):
            options = {(s.region, s.rack, s.number)[: level + 1] for s in tree.shards if (s.region, s.rack, s.number)[:level] == at and s.weight > 0}
            at = min(options, key=draw)
        assert at[2] == got[row.id] and at[0] in regions


def test_slots_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 10)
    df = spark.createDataFrame([(5, "same")] * 95 + [(5, "other")] * 3 + [(None, None)] * 21 + [(i, "x") for i in range(50)], "doc_id long, text string")
    got = sharding.assign(df).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 169 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size) for r in got)[(5, 5)] == 95
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign(df.repartition(3)).collect()))


PAGES = "page_id long, url string, html string, member string"


def pages():
    r = random.Random(5)
    shared = "<p>" + "same " * 60
    out = [(i, f"http://x/{i}", r.choice([shared, "short", None, "", "<b>é</b>" * r.randint(20, 400)]), "m") for i in range(300)]
    return out + [(10**15, "http://x/é\r\nX: y", shared, "m"), (-(10**15), None, shared + "!", "m"), (None, "http://n", shared, "m")]


def expected(rows):
    firsts = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            firsts[b] = min(firsts.get(b, i), i)
    out = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = firsts.get(b)
        again = len(b) >= 100 and first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_READERS", 8)
    rows = pages()
    df = spark.createDataFrame(rows, PAGES)
    layout = warc.Layout(shard_bytes=20_000, least_shards=3, roll_bytes=2_000)
    digests = []
    for k in range(2):
        root = f"file://{tmp_path}/w{k}"
        manifest = warc.write(df.repartition(1 + 4 * k).orderBy(F.rand()) if k else df, root, layout)
        got = warc.read(spark, manifest).collect()
        assert all(r.intact for r in got)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
        assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id is not None}.items() <= {i: h or "" for i, _, h, _ in rows}.items()
        files = sorted((tmp_path / f"w{k}").glob("*.warc.gz"))
        assert len(files) > 3 and not (tmp_path / f"w{k}/_temporary").exists() and max(f.stat().st_size for f in files) < 6_000
        digests.append([(f.name, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files])
    assert digests[0] == digests[1]


def test_warc_of_nothing(spark, tmp_path):
    manifest = warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")
    assert warc.read(spark, manifest).count() == 0


def test_cuts_split_skewed_ids(spark):
    ids = [*range(1000), *range(10**17, 10**17 + 1000), -(2**62), 2**62, warc.NULL_KEY]
    df = spark.createDataFrame([(i, s, 1) for i in ids for s in ([7] if i != 5 else range(500))], "key long, salt long, size long")
    begins = warc.cuts(df, 100)
    places = warc.Places(begins)
    rows = [(r.key, r.salt) for r in df.collect()]
    want = Counter(sorted(rows).index(r) // 100 for r in set(rows))
    assert Counter(places.of(*r) for r in rows) == want and begins == sorted(begins) and len(begins) == 25
    assert begins == warc.cuts(df.repartition(3), 100) and warc.cuts(df.limit(0), 100) == []


def test_cuts_into_a_hundred_thousand_shards(spark):
    df = spark.range(200_000).selectExpr("id * 977 AS key", "0L AS salt", "10L AS size")
    begins = warc.cuts(df, 20)
    assert len(begins) == 99_999 and begins[0] == (2 * 977, 0)


def test_warc_of_thousands_of_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_READERS", 8)
    df = spark.range(2600).selectExpr("id AS page_id", "'http://x' AS url", "repeat(cast(id % 2000 AS string), 40) AS html")
    manifest = warc.write(df, f"file://{tmp_path}/m", warc.Layout(shard_bytes=230, least_shards=1, most_tasks=5))
    got = warc.read(spark, manifest).collect()
    assert len(list((tmp_path / "m").glob("*.warc.gz"))) > 2000
    assert all(r.intact for r in got) and sorted(r.page_id for r in got) == list(range(2600))
    assert {r.page_id: r.refers_to for r in got} == {i: i - 2000 if i >= 2000 and len(str(i - 2000)) * 40 >= 100 else None for i in range(2600)}


def test_warc_repeats_of_one_id(spark, tmp_path):
    shared = "z" * 150
    rows = [(1, "u", shared, "m"), (1, "u", shared, "m"), (1, "v", shared, "m"), (2, "u", shared, "m"), (2, "u", shared, "m"), (None, "u", shared, "m"), *((3, "w", "a" * k, "m") for k in range(120, 160))]
    df = spark.createDataFrame(rows, PAGES)
    got = warc.read(spark, warc.write(df, f"file://{tmp_path}/r", warc.Layout(shard_bytes=500, least_shards=1))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert len(list((tmp_path / "r").glob("*.warc.gz"))) > 10


def test_rows_known_to_revisit():
    seen = warc.Seen(most=2)
    assert [seen.certain_revisit(d, i) for d, i in ((b"a", 5), (b"a", 5), (b"a", 7), (b"a", None), (b"a", 3), (b"a", 5), (b"b", None), (b"b", 1), (b"c", 2), (b"a", 9))] == [False, False, True, True, False, True, False, False, False, False]


SPOKEN = {"en": "the of and to in is that it was for on are with as his they at be this from", "fr": "le la les des et une dans que pour qui sur pas plus par avec tout mais nous", "de": "der die und das nicht ein eine mit auf von ist sich auch dem für werden"}


def spoken(n, seed):
    r = random.Random(seed)
    langs = sorted(SPOKEN)
    return [(i, " ".join(r.choice(SPOKEN[langs[i % 3]].split()) for _ in range(r.randint(4, 60))), langs[i % 3]) for i in range(n)]


def test_language_on_held_out_texts(spark):
    rows = spoken(300, 7) + [(1000, None, "en"), (1001, "12 34!", "fr"), (1002, "the of and", None), (1003, "", "de")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(df, language.standard_holdout()).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:300] if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and got[1002].lang_pred == "en"
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1003)] == [("und", 0.0)] * 3
    bare = language.identify(df.limit(0), language.standard_holdout())
    assert bare.count() == 0
    unlabelled = language.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(8)
    calm = SPOKEN["en"].split()
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [r.choice(calm) for _ in range(r.randint(5, 80))]
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["blockhead", "nitwit"]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "you nitwit", "x")], "doc_id long, text string, predicted string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(df, marks, toxicity.standard_holdout()).collect()}
    assert len(got) == 603 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.98
    assert got[900].score == got[901].score and got[900].predicted == 0
    kept = toxicity.clean(df, marks)
    assert kept.columns == df.columns
    assert sum(labels[x.doc_id][1] for x in kept.collect() if x.doc_id is not None and x.doc_id < 600) <= 2 and kept.where("doc_id >= 900").count() == 2


def test_toxicity_without_two_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.score for x in toxicity.classify(df, none, F.lit(False)).collect()} == {0.5}
    assert toxicity.clean(df.limit(0), none).count() == 0


def plain_buckets(text, sizes, bits):
    t, out = f" {(text or '').lower()} ", []
    for n in sizes:
        for k in range(len(t) - n + 1):
            h = n
            for ch in t[k : k + n]:
                h = (h ^ ord(ch)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 32
            out.append(h >> (64 - bits))
    return out


class PlainFtrl:
    """FTRL-proximal by dictionaries, a feature and class at a time."""

    def __init__(self, alpha, l1, l2, classes):
        self.alpha, self.l1, self.l2, self.classes, self.z, self.n = alpha, l1, l2, classes, defaultdict(float), defaultdict(float)

    def weight(self, f, k):
        l1, l2 = (0.0, 0.0) if f == "bias" else (self.l1, self.l2)
        z = self.z[f, k]
        return 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((1.0 + math.sqrt(self.n[f, k])) / self.alpha + l2)

    def scores(self, row):
        return [sum(x * self.weight(f, k) for f, x in row.items()) for k in range(self.classes)]

    def learn(self, row, label):
        w = {(f, k): self.weight(f, k) for f in row for k in range(self.classes)}
        s = [sum(x * w[f, k] for f, x in row.items()) for k in range(self.classes)]
        e = [math.exp(x - max(s)) for x in s]
        for f, x in row.items():
            for k in range(self.classes):
                g = x * (e[k] / sum(e) - (k == label))
                n = self.n[f, k]
                self.z[f, k] += g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w[f, k]
                self.n[f, k] = n + g * g


def in_order(rows):
    return sorted(rows, key=lambda r: zlib.crc32(f"order/{r[0]}".encode()))


def test_language_equals_a_plain_version(spark):
    rows = spoken(90, 21)
    df = spark.createDataFrame([*rows, (5, rows[5][1], rows[5][2]), (300, "1 2", "en"), (301, "la", None)], "doc_id long, text string, lang string")
    m = language.train(df)
    bags = {i: Counter(plain_buckets(t, language.SIZES, language.BITS)) for i, t, _ in rows}
    df_counts = Counter(f for i, b in bags.items() for f in b for _ in range(2 if i == 5 else 1))
    idf = lambda f: math.log(92 / (1 + df_counts[f])) + 1

    def vector(bag):
        x = {f: (1 + math.log(c)) * idf(f) for f, c in bag.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {**{f: v / norm for f, v in x.items()}, "bias": 1.0}

    langs = sorted(SPOKEN)
    data = [(vector(bags[i]), langs.index(lang)) for i, _, lang in in_order(rows)]
    cut = len(data) - len(data) // 5
    plain = PlainFtrl(0.5, 0.002, 0.0005, 3)
    for _ in range(4):
        for x, y in data[:cut]:
            plain.learn(x, y)
    for i in range(0, 90, 9):
        assert [abs(a - b) < 2e-4 for a, b in zip(m.scores(rows[i][1]), plain.scores(vector(bags[i])), strict=True)] == [True] * 3
    zeros = sum(abs(m.weights[f, k]) < 1e-12 for f in df_counts for k in range(3))
    assert zeros == sum(plain.weight(f, k) == 0 for f in df_counts for k in range(3)) > 0

    def loss(t):
        out = 0.0
        for x, y in data[cut:]:
            s = [v / t for v in plain.scores(x)]
            out -= math.log(math.exp(s[y] - max(s)) / sum(math.exp(v - max(s)) for v in s) + 1e-12)
        return out

    assert loss(m.temperature) <= min(loss(math.exp(k / 20)) for k in range(-60, 61)) + 1e-4


def test_language_ties_repeats_and_long_texts(spark):
    import numpy as np

    flat = language.Model(("de", "en"), np.ones(1 << language.BITS, np.float32), np.zeros(((1 << language.BITS) + 1, 2), np.float32), 1.0)
    df = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "z"), (2, "the of and " * 200_000, "z")], "doc_id long, text string, lang_pred string")
    got = language.predict(df, flat).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("de", 0.5)] * 3
    hot = spark.createDataFrame([(7, "the of and", "en")] * 500 + [(i, t, lang) for i, t, lang in spoken(60, 3)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(hot, F.lit(False)).where("doc_id = 7").collect()} == {"en"}
    with pytest.raises(ValueError):
        language.train(spark.range(1500).selectExpr("id AS doc_id", "'word' AS text", "cast(id AS string) AS lang"))


def test_toxicity_equals_a_plain_version(spark):
    r = random.Random(31)
    calm = SPOKEN["en"].split()
    rows = [(i, " ".join(r.choice(calm) for _ in range(r.randint(5, 20))) + (" you nitwit" if i % 4 == 0 else "")) for i in range(80)]
    df = spark.createDataFrame(rows + [rows[8], (500, None), (501, "x" * 600_000 + " nitwit")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    m = toxicity.train(df, labels)
    bags = {i: set(plain_buckets(t, toxicity.SIZES, toxicity.BITS)) for i, t in rows}
    seen, n = [Counter(), Counter()], [0, 0]
    for i in [*bags, 8]:
        seen[i % 4 == 0].update(bags[i])
        n[i % 4 == 0] += 1
    ratio = {f: math.log((seen[1][f] + 1) / (n[1] + 2)) - math.log((seen[0][f] + 1) / (n[0] + 2)) for f in seen[0] | seen[1]}
    vector = lambda bag: {**{f: ratio[f] for f in bag if abs(ratio.get(f, 0)) >= toxicity.LEAST_RATIO}, "bias": 1.0}
    plain = PlainFtrl(0.5, 2.0, 0.01, 2)
    for _ in range(8):
        for i, _ in in_order(rows):
            plain.learn(vector(bags[i]), int(i % 4 == 0))
    got = {x.doc_id: x.score for x in toxicity.score(df, m).collect()}
    for i, t in [*rows, (500, None), (501, "x" * 20 + " nitwit")]:
        a, b = plain.scores(vector(set(plain_buckets(t, toxicity.SIZES, toxicity.BITS))))
        assert abs(got[i] - 1 / (1 + math.exp(a - b))) < 1e-9, i
    assert min(got[i] for i in range(0, 80, 4)) > max(got[i] for i in range(80) if i % 4)


def test_chunks_hold_each_gram_once(monkeypatch):
    from tallyweave.llm import linear

    text = "".join(random.Random(9).choice("abcdé ") for _ in range(500))
    whole = Counter(int(x) for part in hashed_grams(text, (1, 3, 5), 20) for x in part)
    monkeypatch.setattr(linear, "CHUNK", 37)
    assert Counter(int(x) for part in hashed_grams(text, (1, 3, 5), 20) for x in part) == whole
