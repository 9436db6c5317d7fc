"""Byte BPE, quality rules, license scan, decontamination and personal data: small cases and brute force."""

import hashlib
import math
import os
import random
import re
import textwrap
from collections import Counter

import pytest
import xxhash

from tallyweave.llm import bpe, decontam, licenses, pii, quality

TEXTS = "doc_id long, text string"
ODD = [None, "", " \n\t ", "a", "a a a a a a", "é​z 日本語 😀", "x" * 5000, "one two three\none two three\n\n", "0 1 2 3"]


def rows(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    return df.selectExpr("*", "'x' AS n_tokens", "1 AS score", "cast(null as string) AS _text") if more.get("clash") else df


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as p

    return bpe.codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_ids():
    import public_tokenizers as p
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return enc.encode_ordinary


def test_encoding_equals_tiktoken(codec, tiktoken_ids):
    r = random.Random(1)
    chars = "abcdefghijklmnopqrstuvwxyzABCDE 0123\n\t.,;-éüßñ日😀'"
    texts = ["", "  a  b\n\n\n\t x", "a" * 700, " " * 1000, "'s 're don't I'LL", "0123456789" * 30]
    texts += ["".join(r.choice(chars) for _ in range(r.randint(1, 200))) for _ in range(400)]
    for t in texts:
        ids = list(bpe.unpack(codec.encode(t)))
        assert ids == tiktoken_ids(t)
        assert "".join(codec.decode(ids)) == t


def test_full_caches_do_not_change_ids(tiktoken_ids, monkeypatch):
    import public_tokenizers as p

    monkeypatch.setattr(bpe, "MOST_STATES", 30)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 20)
    monkeypatch.setattr(bpe, "MOST_WORDS", 10)
    monkeypatch.setattr(bpe, "LONG", 50)
    c = bpe.Codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    t = "The transducer forgets, and learns again; forgetting is harmless. " * 5
    assert list(bpe.unpack(c.encode(t))) == tiktoken_ids(t)
    # the bound on states holds inside a pretoken, too
    long = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    assert list(bpe.unpack(c.encode(long))) == tiktoken_ids(long) and len(c.transducer.sets) <= 31
    assert max(len(c.words), len(c.words.old), len(c.transducer.pairs) // 2) <= 10


def test_new_words_are_encoded_without_merging_bytes(tiktoken_ids, monkeypatch):
    import public_tokenizers as p

    c, merges = bpe.Codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN), []
    monkeypatch.setattr(c.transducer, "merged", lambda *a: merges.append(a))
    r = random.Random(5)
    t = " ".join("".join(r.choice(["heit", "tion", "é", "ou", "ü", "th", "en", "q", "日"]) for _ in range(r.randint(2, 6))) for _ in range(2000))
    assert list(bpe.unpack(c.encode(t))) == tiktoken_ids(t) and not merges


def test_long_pretokens_leave_early(tiktoken_ids, monkeypatch):
    import public_tokenizers as p

    monkeypatch.setattr(bpe, "SETTLE_STEP", 7)
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    c, r = bpe.Codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN), random.Random(6)
    for t in ("a" * 3000, " " * 3000, "international" * 200, *("".join(r.choice("aeinrstu") for _ in range(r.randint(1, 400))) for _ in range(50))):
        assert list(bpe.unpack(c.encode(t))) == tiktoken_ids(t)


@pytest.mark.parametrize("seed", range(20))
def test_merges_across_a_joint_equal_merging_the_bytes(seed):
    r, pool = random.Random(seed), [b"a", b"b", b"c"]
    for _ in range(12):
        new = r.choice(pool) + r.choice(pool)
        if new not in pool and len(new) < 9:
            pool.append(new)
    made = pool[3:]
    if seed % 2:  # merges of lower rank than those they need; unreachable tokens
        r.shuffle(made)
    ranks = {token: i for i, token in enumerate([*(bytes([b]) for b in range(256)), *made])}
    t = bpe.Transducer(ranks)
    for a in pool:
        assert t.reachable(ranks[a]) == (t.merged(a) == [a])
        for b in pool:
            if t.reachable(ranks[a]) and t.reachable(ranks[b]):
                assert t.apart(ranks[a], ranks[b]) == (t.merged(a + b, len(a)) is not None), (a, b, made)


def test_vocabularies_without_all_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0, b"ab": 1})


def test_utf8_machine_equals_a_whole_decode():
    r = random.Random(2)
    for _ in range(2000):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xF4, 0x90]) for _ in range(r.randint(0, 12)))
        m, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            n = r.randint(1, 4)
            out += m.feed(data[at : at + n])
            at += n
        assert out + m.close() == data.decode("utf-8", "replace")


def test_round_trip_query_shape(spark, codec):
    import public_tokenizers as p

    got = bpe.round_trip(rows(spark, [*ODD, "a"], clash=True), p.path("byte_bpe_50k.tiktoken"), p.PATTERN).collect()
    assert [r.doc_id for r in sorted(got)] == list(range(len(ODD) + 1))
    for r in got:
        ids = codec.encode(r.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.exact) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), True)
    assert bpe.round_trip(rows(spark, []), p.path("byte_bpe_50k.tiktoken"), p.PATTERN).count() == 0


def test_columns_of_ids(spark):
    import public_tokenizers as p

    args = p.path("byte_bpe_50k.tiktoken"), p.PATTERN
    back = bpe.decode_column(bpe.encode_column(rows(spark, ODD), *args), *args).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def base_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def quality_texts():
    r = random.Random(3)
    words = ["aa", "bb", "cc", "Dd", "e#", "f|g", "日本"]
    made = ["".join(r.choice(words) + r.choice([" ", "\n", "\t ", "  "]) for _ in range(r.choice([3, 60, 400]))) for _ in range(30)]
    clean = [" ".join(r.choice(["the", "of", "and", "letter", "river", "stone", "walks", "gently"]) + str(i % 97) for i in range(80)) for _ in range(10)]
    return ODD + made + clean + clean[:2]


def gram_buckets(t):
    """Buckets by XXH64 as Spark computes it: seed 42, the hash of one value seeds the next."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    one = lambda x, seed=42: xxhash.xxh64_intdigest(x.encode(), seed)
    return [one(x) % quality.BUCKETS for x in w] + [one(y, one(x)) % quality.BUCKETS for x, y in zip(w, w[1:])]


def brute_scores(texts, trusted):
    corpus, good = Counter(), Counter()
    for i, t in enumerate(texts):
        corpus.update(gram_buckets(t))
        good.update(gram_buckets(t) if i in trusted else ())
    share = lambda c, b: math.log((c[b] + 1) / (c.total() + quality.BUCKETS))
    ratio = lambda b: round(share(good, b) - share(corpus, b), 4) if good else 0.0
    return [sum(map(ratio, g)) / len(g) if (g := gram_buckets(t)) else 0.0 for t in texts]


def test_quality_equals_brute_force(spark):
    texts = quality_texts()
    trusted = spark.createDataFrame([(i,) for i in range(39, 51)] + [(None,), (40,)], "doc_id long")
    df = rows(spark, texts, clash=True)
    got = {r.doc_id: r for r in quality.judge(df, trusted).collect()}
    assert len(got) == len(texts)
    scores = brute_scores(texts, set(range(39, 51)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(t)
        assert abs(r.score - scores[i]) < 2e-6 and r.kept == (not r.base_failed and scores[i] >= quality.THRESHOLD)
    assert all(got[i].kept for i in range(39, 51)) and got[len(texts) - 1].score == got[40].score
    assert any(not r.kept and not r.base_failed for r in got.values())


def test_quality_sees_inside_words_and_their_order(spark):
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(120)]
    good = [" ".join(words[(7 * i + j) % 120] for j in range(100)) for i in range(20)]
    garbled = " ".join(w[:3] + w[3:6][::-1] + w[6:] for w in good[0].split())
    shuffled = " ".join(sorted(good[0].split(), key=lambda w: w[::-1]))
    texts = [*good, *[garbled, shuffled] * 8]
    got = {x.doc_id: x for x in quality.judge(rows(spark, texts), spark.range(20).toDF("doc_id")).collect()}
    assert min(got[i].score for i in range(20)) > max(got[20].score, got[21].score) and got[20].score < got[21].score


def test_quality_counts_equal_brute_force(spark):
    texts = ["aa bb aa", "bb", None, "", "aa bb\ncc\tdd " * 30, "aa bb aa"]
    df = rows(spark, texts).selectExpr("text", "doc_id in (0, 4) AS trusted")
    want = {b: (n, sum(gram_buckets(t).count(b) for t in (texts[0], texts[4]))) for b, n in Counter(g for t in texts for g in gram_buckets(t)).items()}
    assert quality.bucket_counts(df) == want
    assert quality.weights({}) == [0.0] * quality.BUCKETS


def test_quality_of_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(300_000))
    df = spark.createDataFrame([(1, "plain words here " * 30), (1, "plain words here " * 30), (1, "others " * 60), (2, long), (None, "x y")], TEXTS)
    got = sorted((str(r.doc_id), r.n_words, r.n_repeat_words, r.kept) for r in quality.judge(df, df.where("doc_id = 2").select("doc_id")).collect())
    assert [g[1:3] for g in got] == [(60, 60), (90, 90), (90, 90), (300_000, 0), (2, 0)] and got[3][3]


def test_quality_without_trusted_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.judge(rows(spark, ["w " * 60, "u v " * 3]), none).collect()
    assert {r.score for r in got} == {0.0}
    assert quality.judge(rows(spark, []), none).count() == 0


def dice(unit, template):
    a, b = set(licenses.bigrams(unit)), set(licenses.bigrams(template))
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0.0


def test_licenses_equal_brute_force(spark):
    r = random.Random(4)
    texts = list(ODD)
    for _, t in licenses.TEMPLATES:
        words = t.split()
        texts += [t, "before\n" + t.upper() + "\nafter", " ".join(words[: max(1, len(words) * 3 // 4)]), " ".join(w for w in words if r.random() > 0.1), "some words " * 40 + t]
    texts.append(licenses.TEMPLATES[1][1].replace("; ", ";\n") + "\n\nnext paragraph")
    texts.append("MIT\n" * 3 + licenses.TEMPLATES[12][1] + "\n" + licenses.TEMPLATES[12][1])
    got = {(x.doc_id, x.license): (x.dice, x.n_units) for x in licenses.scan(rows(spark, texts)).collect()}
    want = {}
    for i, t in enumerate(texts):
        s = re.sub(r"[^a-z0-9\n]+", " ", (t or "").lower())
        units = s.split("\n") + [p for p in re.split(r"\n *(?:\n *)+", s) if "\n" in p] + ([s] if re.search(r"\n *\n", s) else [])
        for u in units:
            best = {}
            for name, template in licenses.TEMPLATES:
                best[name] = max(best.get(name, 0), dice(u, template))
            for name, d in best.items():
                if d >= licenses.DICE - 1e-9:
                    old = want.get((i, name), (0, 0))
                    want[i, name] = (max(old[0], round(d, 6)), old[1] + 1)
    assert got == want and licenses.scan(rows(spark, [])).count() == 0


def test_complete_license_texts(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join(licenses._MIT)
    isc = "ISC License\n\nCopyright (c) 2020 A. Person <a@b.org>\n\n" + "\n\n".join(licenses._ISC)
    bsd = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + "\n\n".join(licenses._BSD)
    wrapped = ["\n\n".join(textwrap.fill(p, 80) for p in t.split("\n\n")) for t in (mit, isc, bsd)]
    texts = [mit, isc, bsd, *wrapped, *("prose before\n\n" + t + "\n\n" + "other prose " * 300 for t in wrapped), "left\nAll rights reserved.\nright"]
    got = {}
    for x in licenses.scan(rows(spark, texts)).collect():
        got.setdefault(x.doc_id, {})[x.license] = x.dice
    for i, name in enumerate(("MIT", "ISC", "BSD-3-Clause") * 3):
        assert got[i][name] == max(got[i].values()) >= licenses.DICE, (i, got[i])
    assert got[9] == {"All-Rights-Reserved": 1.0}


def test_licenses_inside_lines_and_paragraphs(spark):
    prose = " ".join(f"word{i} of prose{i}" for i in range(100))
    texts = [
        "The text of this site is by many hands. Released under the MIT License. See the site for more.",
        prose + "\nand it is Released under\nthe MIT License. See " + prose + "\n" + prose,
        prose + " " + " ".join(licenses._MIT) + " " + prose + "\n\n" + prose,
        prose + " Copyright 2020 A. Person. All rights reserved. " + prose,
        "Released under no such license as MIT. All the rights are not reserved.",
        "Released under the MIT License.",
    ]
    got = {(x.doc_id, x.license): (x.dice, x.n_units) for x in licenses.scan(rows(spark, texts), inside=True).collect()}
    assert got == {(0, "MIT"): (1.0, 0), (1, "MIT"): (1.0, 0), (2, "MIT"): (1.0, 0), (3, "All-Rights-Reserved"): (1.0, 0), (5, "MIT"): (1.0, 1)}


def test_license_windows_equal_brute_force(spark):
    r = random.Random(16)
    templates = licenses.TEMPLATES[:16] + (("MIT", licenses._MIT[1]),)
    texts = [*ODD]
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            words += [r.choice(["stone", "river", "the", "license", "see"]) for _ in range(r.randint(0, 25))]
            words += [w for w in r.choice(templates)[1].split() if r.random() > 0.06]
        texts.append("".join(w + r.choice([" ", " ", " ", " ", "\n", ", "]) for w in words))
    texts += texts[-3:]
    got = {(x.doc_id, x.license): x.dice for x in licenses.scan(rows(spark, texts, clash=True), templates=templates, inside=True).collect()}
    want = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", (t or "").lower())
        units = [re.findall(r"[a-z0-9]+", u.lower()) for u in [*(t or "").split("\n"), *re.split(r"\n\W*\n", t or "")]]
        for name, template in templates:
            n = len(re.findall(r"[a-z0-9]+", template.lower()))
            for inner, parts in ((0, units), (1, [words[k : k + n] for k in range(len(words) - n + 1)])):
                best = max((dice(" ".join(p), template) for p in parts), default=0)
                if best >= licenses.DICE - 1e-9:
                    want.setdefault((i, name), {}).setdefault(inner, []).append(best)
    want = {k: round(max(v[min(v)]), 6) for k, v in want.items()}
    assert got == want and len(want) > 40


def test_licenses_in_long_texts_and_repeated_rows(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long + "\nReleased under the MIT License.\n" + long), (2, "All rights reserved."), (2, "All rights reserved."), (None, "All rights reserved.")], TEXTS)
    got = {(x.doc_id, x.license): (x.dice, x.n_units) for x in licenses.scan(df, inside=True).collect()}
    assert got == {(1, "MIT"): (1.0, 1), (2, "All-Rights-Reserved"): (1.0, 2), (None, "All-Rights-Reserved"): (1.0, 1)}


def test_whole_licenses_of_the_system(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    there = [n for n in names if os.path.isfile(f"{folder}/{n}")]
    if not there:
        pytest.skip("no license texts on this system")
    texts = [open(f"{folder}/{n}", encoding="utf-8").read() for n in there]
    got = {(x.doc_id, x.license): x.dice for x in licenses.scan(rows(spark, texts), inside=True).collect()}
    assert all(got[i, names[n]] >= 0.95 for i, n in enumerate(there))


ITEM = "A train leaves Paris with 30 cars and reaches Berlin after 12 hours. How many of the 30 cars were still there when it had arrived in Berlin?"
CHANGED = "hello there. A train leaves Madrid with 45 cars and reaches Lisbon after 9 hours. How many of the 45 cars were still there when it had arrived in Lisbon? ok"


def leaks(spark, docs, items):
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.leaks(rows(spark, docs, clash=True), b).collect()}


def test_leaks(spark):
    wrong = CHANGED.replace("of the 45", "of the 77").replace("in Lisbon?", "in Rome?")
    prose = " ".join(f"word{i % 50} and" for i in range(100))
    docs = [ITEM, CHANGED, wrong, None, "", "nothing to see", prose, prose + "\n" + ITEM + "\n" + prose, "and one two three four five too"]
    got = leaks(spark, docs, [ITEM, "", None, "one two three four five", "two words"])
    assert set(got) == {(0, 0), (1, 0), (7, 0), (8, 3)}
    assert got[1, 0].reworded and not got[0, 0].reworded and got[0, 0].covered == got[0, 0].n_windows
    assert leaks(spark, [], [ITEM]) == {} and leaks(spark, [ITEM], []) == {}


def test_leaks_of_items_full_of_slots(spark):
    items = ["Sort these numbers: 17, 4, 23, 8, 15, 42, 16, 99, 3, 71", "Who Wrote The Famous Novel About The Great White Whale", "Compute 12 15 18 21 24 27 30", "Add 5 6 7"]
    docs = [*items, *("Some words come before it.\n" + t + "\nand some come after" for t in items), "Sort these numbers: 18, 5, 24, 9, 16, 43, 17, 98, 4, 72", "Compute 13 16 19 22 25 28 31 and add 8 9 10"]
    got = leaks(spark, docs, items)
    assert set(got) == {(i + 4 * k, i) for i in range(4) for k in (0, 1)} and all(r.covered == r.n_windows and not r.reworded for r in got.values())
    mixed = "A box holds 5 red and 7 blue balls of one size. Its lots are 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"
    other = mixed.replace("5 red and 7", "6 red and 9").replace("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", "none at all")
    assert leaks(spark, [other], [mixed])[0, 0].reworded


def test_leaks_equal_brute_force_on_prose(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [say(r.randint(9, 40)) for _ in range(12)]
    docs = [say(60) for _ in range(20)] + [say(30) + " " + i + " " + say(20) for i in items] + [say(30) + " " + " ".join(i.split()[: len(i.split()) // 3]) for i in items]
    grams = lambda t: [tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)]
    want = set()
    for d, t in enumerate(docs):
        have = set(grams(t))
        for i, item in enumerate(items):
            g = grams(item)
            if sum(x in have for x in g) >= min(13, -(-len(g) // 2)):
                want.add((d, i))
    assert set(leaks(spark, docs, items)) == want


def plain_tokens(t):
    """(kind or None, core) of each token, by the rules of the operator, word by word."""
    t = re.sub(r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF])", r" \1 ", t or "")
    w, out = [x for x in re.split(r"[\x20\x09-\x0D]+", t.replace("\n", ". ")) if x], []
    for i, x in enumerate(w):
        c, before = "".join(ch for ch in x if ch not in decontam._PUNCTUATION).lower(), w[i - 1] if i else ""
        unit = c in decontam.UNITS
        if not c:
            continue
        if "a" <= x[0] <= "z" and not unit:
            out.append((None, c))
        elif x < "A" and re.fullmatch(r"[(\[\"$€£+-]*[0-9][0-9.,:/]*[%)\].,;:!?\"]*", x):
            out.append(("n", c))
        elif unit and before[-1:].isdigit():
            out.append(("u", c))
        elif x[0].lower() != x[0] and x.upper() != x and (before and before[-1] not in '.!?:"' or c not in decontam.OPENERS):
            out.append(("m", c))
        else:
            out.append((None, c))
    return out


def plain_leak(doc, item):
    """(n_windows, covered, reworded) of a leak, else None."""
    size = min(8, len(item))
    if size < 4:
        same = [c for _, c in doc] == [c for _, c in item] and size and any(k for k, _ in doc) == any(k for k, _ in item)
        return (1, 1, False) if same else None
    windows = lambda ts: [ts[i : i + size] for i in range(len(ts) - size + 1)]
    by_words = lambda x: 2 * sum(k is not None for k, _ in x) > size
    key = lambda x: (by_words(x), tuple(c if by_words(x) or k is None else k for k, c in x), size)
    groups = {}
    for at, x in enumerate(windows(doc)):
        for place, y in enumerate(windows(item)):
            if key(x) == key(y):
                places, pairs = groups.setdefault((by_words(y), at - place), (set(), set()))
                places.add(place)
                pairs.update(() if by_words(y) else ((k, o, c) for (k, c), (_, o) in zip(x, y) if k))
    good = {g: v for g, v in groups.items() if len(v[1]) == len({(k, o) for k, o, _ in v[1]}) == len({(k, c) for k, _, c in v[1]})}
    covered = set().union(*(p for p, _ in good.values()))
    templates = set().union(*(p for (exact, _), (p, _) in good.items() if not exact))
    n, n_templates = len(windows(item)), sum(not by_words(x) for x in windows(item))
    if len(covered) >= min(13, -(-n // 2)) > 0 or n_templates and len(templates) >= min(13, -(-n_templates // 2)):
        return n, len(covered), any(o != c for _, pairs in good.values() for _, o, c in pairs)
    return None


def test_leaks_equal_brute_force_with_slots(spark):
    r = random.Random(15)
    names, nouns = ["Tom", "Ben", "Ana", "Zoe", "Kim"], "apples pears boxes coins cards".split()
    frames = [
        "{a} has {x} {n}. {a} buys {y} {n}. {a} eats {z} {n}. {a} has many left.",
        "A train leaves {a} with {x} cars and reaches {b} after {y} hours. How far is it from {a} to {b} if it goes {z} km an hour?",
        "{a} and {b} share {x} {n}. If {b} takes {y} kg more than {a}, who has {z} kg?",
        "Sort these: {x}, {y}, {z}, {x}, 5, 6, 7, 8, {y}, 12",
        "{a} runs {x} km",
        "Compute {x} plus {y} minus {z} now",
    ]
    fill = lambda f: f.format(a=r.choice(names), b=r.choice(names), n=r.choice(nouns), x=r.randint(2, 60), y=r.randint(2, 60), z=r.randint(2, 60))
    items = [fill(f) for f in frames for _ in range(2)] + ["日本の首都はどこですか", "日本", "Two words", "ok", "..."]
    docs = [r.choice(["", "Some words stand before it. ", "and so "]) + fill(r.choice(frames)) + r.choice(["", " And more after it.", "\nthe end"]) for _ in range(150)]
    docs += [i.replace("Tom", "Pia") for i in items] + ["質問: 日本の首都はどこですか。東京です", "Two words", "two words!", "Two words more", *ODD, items[0]]
    got = {k: (x.n_windows, x.covered, x.reworded) for k, x in leaks(spark, docs, items).items()}
    doc_tokens, item_tokens = [plain_tokens(t) for t in docs], [plain_tokens(t) for t in items]
    want = {(i, j): found for i, d in enumerate(doc_tokens) for j, t in enumerate(item_tokens) if (found := plain_leak(d, t))}
    assert got == want and sum(x[2] for x in want.values()) > 30


def test_names_that_open_sentences_are_slots(spark):
    item = "Tom has 3 apples. Tom buys 7 apples. Tom eats 4 apples. Tom has n left."
    docs = ["Ben has 12 apples. Ben buys 5 apples. Ben eats 9 apples. Ben has n left.", "Ben has 12 apples. Ann buys 5 apples. Joe eats 9 apples. Sue has n left."]
    assert [(k, x.reworded) for k, x in leaks(spark, docs, [item]).items()] == [((0, 0), True)]


def test_leaks_in_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, long + "\n" + ITEM + "\n" + long), (2, ITEM), (2, ITEM), (2, "other"), (None, ITEM)], TEXTS)
    b = spark.createDataFrame([(0, ITEM), (0, ITEM), (1, None)], "item_id long, text string")
    got = decontam.leaks(df, b).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"] and len({r.n_windows for r in got}) == 1


def test_without_leaks_keeps_columns_and_other_rows(spark):
    docs = rows(spark, [ITEM, "fine", None, CHANGED]).selectExpr("doc_id", "text", "'y' AS mark", "3 AS h")
    same_id = docs.where("doc_id = 1").selectExpr("cast(0 as bigint) AS doc_id", "text", "mark", "h")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontam.without_leaks(docs.unionByName(same_id), b)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(0, "fine"), (1, "fine")] and got.count() == 3


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_brute_force():
    r = random.Random(6)
    parts = ["1.2.3.4", "@", "a", "b.c", "+1", "4111 1111 1111 1111", ".", "-", " ", "255", "99", "_", "007.1", "é", "\n", "(", ")"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t)


def test_long_runs_take_linear_time():
    for t in ("9" * 300_000, "a" * 300_000 + "@", "+1" * 50_000, "a@" * 50_000, "1." * 100_000):
        pii.base_spans(t)


def test_added_spans_and_redaction(spark):
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and mail me@x.org.'
    clean = "The 3 houses of 1999 cost 250000 in total; see page 44."
    got = {r.doc_id: r for r in pii.detect(rows(spark, [secret, clean, *ODD], clash=True)).collect()}
    assert got[0].spans == "email:60:68,secret:9:49" or got[0].spans.endswith("secret:9:49")
    assert got[0].n_email == 1 and got[0].base_sha256 == hashlib.sha256(got[0].spans.split(",secret")[0].encode()).hexdigest()
    assert got[1].spans == "" and got[2].spans == "" and len(got) == len(ODD) + 2
    out = {r.doc_id: r for r in pii.redact(rows(spark, [secret, None, "a@b.c 1.2.3.4"]).selectExpr("doc_id", "text", "cast(length(text) as bigint) AS n_chars"), "text", "n_chars").collect()}
    assert out[0].text == 'token = "[SECRET]" and mail [EMAIL].' and out[0].n_chars == len(out[0].text)
    assert out[1].text is None and out[2].text == "[EMAIL] [IP]"


def test_precision_and_recall_by_kind():
    m = pii.model()
    for kind, (precision, recall, n) in pii.quality(m).items():
        assert n > 200 and precision > 0.96 and recall > 0.85, kind
    # calibration sets them: they differ, and each is reached by the examples it was set on
    assert len(set(m.thresholds.values())) == len(pii.ADDED) and all(0 < x < 1 for x in m.thresholds.values())


def test_thresholds_equal_a_plain_search():
    import numpy as np

    r = random.Random(21)
    for _ in range(300):
        n = r.randint(1, 40)
        p = np.array([r.choice([0.1, 0.2, 0.5, 0.7, 0.9, r.random()]) for _ in range(n)])
        truth = np.array([float(r.random() < x) for x in p])
        want = 2.0
        for at in sorted(set(p.tolist()), reverse=True):
            right, wrong = truth[p >= at].sum(), (1 - truth[p >= at]).sum()
            if right >= 0.8 * (right + 2 * wrong):
                want = at
        assert pii.threshold(p, truth, 0.8, 2) == want


def test_probabilities_equal_plain_trees():
    import numpy as np

    m = pii.model()
    x, y, _ = pii.examples(150, 5)

    def plain(row):
        total = m.trees.start
        for tree in m.trees.forest:
            node = 1
            while tree[node][0] is not None:
                node = 2 * node + (row[tree[node][0]] > tree[node][1])
            total += tree[node][1]
        return 1 / (1 + math.exp(-(m.slope * total + m.offset)))

    p = m.probability(x)
    assert np.allclose(p, [plain(r) for r in x], atol=1e-12)
    # calibrated: what is said to be likely is as often true
    x, y, _ = pii.examples(4000, 6)
    p = m.probability(x)
    for low, high in ((0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):
        part = (p >= low) & (p < high)
        assert abs(y[part].mean() - p[part].mean()) < max(0.03, 4 * math.sqrt(0.25 / part.sum()))


def test_selection_equals_brute_force():
    m, r = pii.model(), random.Random(22)
    parts = ["1.2.3.4%", "ssn ", "123-45-6789", "%x@a.bc", " ", "token=", "a9X" * 8, ".", "fe80::1", ":", "born 1/2/1990", "-", "4111 1111 1111 1111", "+1 555 123 4567", "passport C01X00T47", "\n", "call (201) 555-0123"]
    texts = ["1.2.3.4%" * 9 + "ssn%123-45-6789%x@a.bc", *("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(400))]
    cross = lambda a, b: a[1] < b[2] and b[1] < a[2]
    n = 0
    for text, judged, (base, added) in zip(texts, m.judged(texts), pii.find(texts, m), strict=True):
        chosen = []
        for c, p in sorted(judged, key=lambda x: (-round(x[1], 2), x[0][1] - x[0][2], x[0][1], x[0][0])):
            if p >= m.thresholds[c[0]] and not any(cross(c, o) for o in base + chosen):
                chosen.append(c)
        assert sorted(chosen) == sorted(s for s, _ in added), text
        n += len(chosen)
    assert n > 300


def test_detect_of_nothing_and_repeats(spark):
    assert pii.detect(rows(spark, [])).count() == 0 and pii.redact(rows(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (1, "1.2.3.4"), (None, None)], TEXTS)
    assert sorted((str(r.doc_id), r.spans) for r in pii.detect(twice).collect()) == [("1", "email:0:6"), ("1", "email:0:6"), ("1", "ip:0:7"), ("None", "")]


def test_candidates_without_caps():
    r = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    secrets = ["".join(r.choice(letters + "0123456789") for _ in range(n)) for n in (128, 129, 164, 400)]
    secrets.append("".join(r.choice(letters) for _ in range(36)))
    values = [("secret", f'api key = "{s}" it is', s) for s in secrets]
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    values += [("secret", f"send auth {jwt} with it", jwt), ("secret", 'password = "kqWzXvBnMpLsDfGhJkRt"', "kqWzXvBnMpLsDfGhJkRt"), ("identity", "my passport C01X00T47 is lost", "C01X00T47")]
    values += [("secret", 'db_password: "s3cr3t!x"', "s3cr3t!x"), ("birth", "she was born 12/03/1984 there", "12/03/1984")]
    values += [("address6", f"the host {a} was down", a) for a in ("fe80::1", "::1", "fe80::1ff:fe23:4567:890a", "2001:db8::ff00:42:8329")]
    for kind, text, value in values:
        span = (kind, text.index(value), text.index(value) + len(value))
        assert span in pii.candidates(text), text
        assert [span] == [s for s, _ in pii.model().added([text], [[]])[0]], text
    for text in ("std::vector<a::b> x", "-" * 40 + "\nand " + "_" * 300, "a" * 300_000, "the well-known-but-long-hyphenated-word of it"):
        assert pii.find([text], pii.model())[0] == ([], []), text[:50]
    pii.features("9" * 300_000, ("secret", 0, 300_000)), pii.features("ab12" + "9" * 9000, ("secret", 0, 9004))


def test_workers_keep_neither_caches_nor_freed_memory(codec, monkeypatch):
    import pyarrow as pa

    from tallyweave.llm import common

    p = pytest.importorskip("public_tokenizers")
    bpe.codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    common.lean()
    assert bpe.codec.cache_info().currsize == 0
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"x": list(range(600))})
    assert [b.num_rows for b in common.slices(iter([batch, batch]))] == [256, 256, 88] * 2 and given == [1]
