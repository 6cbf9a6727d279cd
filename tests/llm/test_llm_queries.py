"""The registered llm queries against their SQL, and the pipeline against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
import corpus_pipeline
from lureline.llm import toxicity
from lureline.llm.common import table
from lureline.llm.oracles import oracle_sql
from lureline.llm.queries import queries
from lureline.plans.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, SF, queries()[name], oracle_sql()[name])
    assert r["columns_match"] and r["spark_rows"] == r["oracle_rows"] and r["hash_match"], r


def test_every_operator_has_one_query():
    names = sorted(int(n[2:].split("_")[0]) for n in queries())
    assert names == list(range(1, 14))
    assert set(queries()) | {"pipeline"} <= set(entry_mod.queries())


def _words(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def _near_kept(rows):
    """Stage 2 by brute force: rows that no smaller row of their component stands for."""
    sets = []
    for r in rows:
        w = _words(r["text"])
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if root[i] == i]


def _without_repeats(rows, window=200):
    """Stage 3 by brute force: bytes of strings that start elsewhere go."""
    count = Counter()
    raws = [(r["text"] or "").encode() for r in rows]
    for raw in raws:
        count.update(raw[i:i + window] for i in range(len(raw) - window + 1))
    out = []
    for r, raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if count[raw[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        if any(gone):
            text = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
            r = {**r, "text": text, "n_chars": len(text)}
        out.append(r)
    return out


def _clean(rows, items, window=10):
    """Stage 4 by brute force: no document word run equals a benchmark window."""
    word = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    split = lambda t: word.findall((t or "").encode().translate(lower))
    wanted = {}
    for _, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(len(w[i:i + window]), set()).add(tuple(w[i:i + window]))
    return [r for r in rows if not any(
        tuple(w[i:i + n]) in ps for w in [split(r["text"])] for n, ps in wanted.items() for i in range(len(w) - n + 1))]


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    docs = docs.withColumns({"score": F.lit("clash"), "component_id": F.col("doc_id")})
    columns = docs.columns
    order = lambda df: [r.asDict() for r in df.orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_dedup", "suffix_dedup", "decontaminate", "mixing"]

    def step(name, docs):
        stages[name](spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    one = step("toxicity", docs)
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    machine = toxicity.build(model.lexicon, model.exceptions)
    fine = []
    for r in order(docs):
        words, found = toxicity.hits(r["text"], machine)
        z = sum(w * m for w, m in zip(model.weights, toxicity.measures(len(words), found))) + model.bias
        if z < 0:
            fine.append(r)
    assert one.columns == columns and order(one) == fine
    two = step("minhash_dedup", one)
    assert two.columns == columns and order(two) == _near_kept(order(one))
    three = step("suffix_dedup", two)
    assert three.columns == columns and order(three) == _without_repeats(order(two))
    four = step("decontaminate", three)
    assert four.columns == columns and order(four) == _clean(order(three), items)
    mixed = order(step("mixing", four))
    by = {}
    for r in mixed:
        assert r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] == r["copies"] * len((r["text"]).split())
        by.setdefault(r["source"], []).append(r)
    assert by and all(abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs) for rs in by.values())
    assert len(order(two)) < len(order(one))


def test_pipeline_drops_toxic_documents(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(20)) + (" zzzork" * (i % 4 == 0)))
            for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(200) if i % 4]


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
