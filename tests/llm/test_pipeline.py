"""The pipeline against a plain version of each stage, and its entry without the subpackage."""

import hashlib
import os
import random
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from tallyweave.llm import pii, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORDS = "river stone walks gently over the old bridge while rain falls on quiet fields and nobody sings today about winter".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))
    items = [say(r.randint(12, 30)) for _ in range(5)]
    docs, labels = [], []
    for i in range(400):
        text = say(r.randint(20, 120))
        if i % 6 == 0:
            text += " you utter nitwit"
        if i % 9 == 1:
            text += " " + items[i % 5] + " " + say(5)
        if i % 7 == 2:
            text += " write to me@x.org or call +1 (555) 123-4567"
        if i % 8 == 3 and docs:
            text = docs[r.randrange(len(docs))][1] + (" indeed" if i % 16 == 3 else "")
        docs.append((i, text, r.choice(["en", None]), "s", len(text)))
        if i % 2 == 0 or i < 100:
            labels.append((i, 1, int("nitwit" in text)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "short", "en", "s", 5)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_run_equals_the_plain_version(spark, tables):
    import public_tokenizers as p
    import tiktoken

    from tallyweave.llm import bpe
    from tests.llm.test_corpus_operators import brute_components

    path, docs, items = tables
    frame = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{path}/labels.parquet"))
    left = [d for d in docs if model.score(d[1]) < toxicity.THRESHOLD]
    assert not any("nitwit" in (d[1] or "") for d in left) and len(left) > 300
    groups = brute_components([d[1] for d in left], 5)
    left = [d for i, d in enumerate(left) if groups[i][0] == 0 or groups[i][1] == i]
    grams = lambda t: {tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)}
    leaked = lambda t: any(len(grams(i) & grams(t)) >= min(13, -(-len(grams(i)) // 2)) for i in items)
    left = [d for d in left if not leaked(d[1] or "")]
    found = pii.find([d[1] for d in left], pii.model())
    left = [(d[0], None if d[1] is None else pii.redact_text(d[1], b + [s for s, _ in a])) for d, (b, a) in zip(left, found, strict=True)]
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in left:
        ids = enc.encode_ordinary(t or "")
        want[i] = (t, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), None if t is None else len(t))
    got = {r.doc_id: (r.text, r.n_tokens, r.ids_sha256, r.n_chars) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want and 100 < len(got) < 350 and {900, 901, 902} <= set(got)


def test_stages_return_the_columns_of_documents(spark, tables):
    path, _, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    for few in (docs.limit(0), docs.where("doc_id > 890")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, few, path)
            assert out.columns == docs.columns and out.count() == few.count(), name


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("tallyweave", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tallyweave/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'match_greedy' in q and not any(k.startswith('op') for k in q); assert 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=60)
