"""S9, M2 and C2 after their mends, against plain Python."""

import html
import os
import random

import pytest
from pyspark.sql import functions as F

from lureline.functions.expressions import COMMON_REFERENCES, decode_entities, keyed_uniform
from lureline.operators import models
from lureline.sources import files
from lureline.streaming.attribution import run_folder


def local(folder):
    return folder.removeprefix("file://").removeprefix("file:")


def test_a_dataset_is_found_by_its_option(spark):
    base = run_folder(spark, "test-exports")
    assert files.load_dataset(spark, "combined", base).count() == 0  # no folder at all
    os.makedirs(local(base))

    def put(name, campaign, extra=""):
        with open(f"{local(base)}/{name}", "w") as f:
            f.write(f"campaign_id,gender{',source' if extra else ''}\n{campaign},N/A{extra}\n")

    put("analytic_dataset_synthetic.csv", 1)
    put("analytic_dataset_observed_20240101_000000.csv", 2)
    put("analytic_dataset_observed_20250101_000000.csv", 3)
    put("analytic_dataset_observed_20260101_000000.txt", 9)
    put("analytic_dataset.csv", 4)
    put("analytic_dataset_combined_20240101_000000.csv", 5, ",given")
    get = lambda option, **k: files.load_dataset(spark, option, base, **k)
    one = get("observed-export").first()
    assert (one.campaign_id, one.source, one.gender) == (3, "observed", None)
    assert (get("synthetic").first().campaign_id, get("synthetic").first().source) == (1, "synthetic")
    assert get("combined").first().source == "given"
    assert get("nonsense").count() == 0 and get("nonsense").schema == files.FACT_SCHEMA
    assert get("observed-live").count() == 0
    live = spark.createDataFrame([(7,)], "campaign_id long")
    assert get("observed-live", live=lambda: live).first().campaign_id == 7
    os.remove(f"{local(base)}/analytic_dataset_observed_20240101_000000.csv")
    os.remove(f"{local(base)}/analytic_dataset_observed_20250101_000000.csv")
    assert get("observed-export").first().campaign_id == 4  # the legacy file


@pytest.mark.parametrize("n", [3, 10, 2001])
def test_exact_split_equals_a_sort(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([0, 0, 0, 1, None]), rng.choice(["a", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "target_id long, y int, source string").repartition(3)
    got = {r.target_id: r.split for r in models.stratified_split(df, "y", 0.3, keys=("source", "target_id")).collect()}
    hashed = {r.target_id: r.h for r in df.select("target_id", keyed_uniform(42, "source", "target_id").alias("h")).collect()}
    for label in (0, 1, None):
        own = sorted((i for i, y, _ in rows if y == label), key=lambda i: hashed[i])
        quota = int(round(0.3 * len(own)))
        assert {i for i in own if got[i] == "test"} == set(own[:quota])
    assert len(got) == n


def test_equal_hashes_are_parted_by_the_keys(spark, monkeypatch):
    monkeypatch.setattr(models, "keyed_uniform", lambda *a: F.lit(0.5))
    df = spark.range(10).select(F.col("id").alias("target_id"), F.lit(1).alias("y"))
    got = {r.target_id: r.split for r in models.stratified_split(df, "y", 0.3, keys=("target_id",)).collect()}
    assert [i for i in range(10) if got[i] == "test"] == [0, 1, 2]


def test_a_split_sorts_and_writes_nothing(spark):
    df = spark.range(100).select(F.col("id").alias("target_id"), (F.col("id") % 2).alias("y"), F.lit("wide").alias("text"))
    plan = models.stratified_split(df, "y", keys=("target_id",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "LogicalRDD" not in plan and "Join" not in plan


def test_references_decode_as_html_defines(spark):
    texts = [None, "", "a & b", "&amp;lt;", "&lt;&gt;&quot;&apos;&#39;&nbsp;&copy;x", "&amp;amp;", "&amp", "&ampx", "&notit; &eacute;&amp;",
             "&#233;&#xE9;&lt;", "&&lt;", "&unknown;&lt;", "&lt &lt;", "&AMP;&LT;", "&euro;&hellip;", "&#128512;", "AT&T", "&amp;#39;", "&;&#;"]
    texts += [r for r, _ in COMMON_REFERENCES]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", decode_entities(F.col("t")).alias("d")).collect()}
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_training_table_holds_both_sources(spark):
    """The training rows had lost the synthetic population (stratified_split and what follows it, mixed_cells)."""
    from lureline.plans import registry_models as rm
    from lureline.plans import registry
    seen = {}
    keep = rm.q_combined_dataset
    rm.q_combined_dataset = lambda s, sf: seen.setdefault(
        sf, s.createDataFrame([("observed", 1, "N/A"), ("synthetic", 2, "F")], "source string, campaign_id long, gender string"))
    try:
        got = sorted(tuple(r) for r in rm._combined(spark, "rows").collect())
    finally:
        rm.q_combined_dataset = keep
    assert keep is registry.q_combined_dataset
    assert got == [("observed", 1, None), ("synthetic", 2, "F")]
