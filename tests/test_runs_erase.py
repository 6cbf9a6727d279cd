"""E8-E10 from stored runs, S7 names, Q6 for every parent."""

import os

import pytest
from pyspark.sql import functions as F

from lureline.operators import quality, runs
from lureline.sources import files
from lureline.sources.commits import CommitLog
from lureline.streaming.attribution import run_folder


def local(folder):
    return folder.removeprefix("file://").removeprefix("file:")


def put(base, model, run_id, text):
    folder = f"{local(base)}/{model}/run_id={run_id}"
    os.makedirs(folder)
    with open(f"{folder}/metrics.json", "w") as f:
        f.write(text)


def test_runs_of_any_shape_stand_side_by_side(spark):
    base = run_folder(spark, "test-runs")
    assert runs.scan_runs(spark, base).count() == 0
    put(base, "a", "20240101_000000", '{"accuracy": 0.9, "n_rows": 1}')
    put(base, "a", "20240102_000000", '{\n "accuracy": 0.5, "f1": "n/a", "n_rows": 100,\n "train_rows": 70, "test_rows": 30, "extra": [1, {"x": 2}]}')
    put(base, "b", "20230101_000000", '{"metrics": {"accuracy": 0.5, "brier_score": 0.2, "f1": 1}, "n_rows": 100, "train_rows": 70}')
    put(base, "c", "20240105_000000", "no json at all")
    newest = runs.newest_runs(runs.scan_runs(spark, base))
    table = runs.run_table(newest)
    got = {r.model: r.asDict() for r in table.collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["run_id"] == "20240102_000000" and got["a"]["accuracy"] == 0.5 and got["a"]["f1"] is None
    assert got["a"]["test_rows"] == 30 and got["a"]["brier_score"] is None
    assert got["b"]["accuracy"] == 0.5 and got["b"]["brier_score"] == 0.2 and got["b"]["f1"] == 1.0 and got["b"]["test_rows"] is None
    assert [got["c"][m] for m in ("accuracy", "n_rows", "mode")] == [None] * 3
    win = {r.metric: r for r in runs.run_winners(table, "a", "b").collect()}
    assert win["accuracy"].winner == "tie" and win["f1"].winner is None and win["brier_score"].winner is None
    assert (win["f1"].same_n_rows, win["f1"].same_train_rows, win["f1"].same_test_rows, win["f1"].comparable) == (True, True, False, False)
    alone = runs.run_winners(table, "a", "missing").collect()
    assert len(alone) == 6 and all(r.winner is None and not r.comparable for r in alone)


def test_lower_brier_wins_and_equal_sizes_compare(spark):
    base = run_folder(spark, "test-runs")
    for model, brier, acc in (("a", 0.1, 0.6), ("b", 0.2, 0.7)):
        doc = spark.createDataFrame([(brier, acc, 10, 7, 3)], "brier_score double, accuracy double, n_rows long, train_rows long, test_rows long")
        runs.store_run(doc, base, model, "1")
    with pytest.raises(Exception):
        runs.store_run(doc, base, "b", "1")  # a run never overwrites
    win = {r.metric: r for r in runs.run_winners(runs.run_table(runs.scan_runs(spark, base)), "a", "b").collect()}
    assert win["brier_score"].winner == "a" and win["accuracy"].winner == "b" and win["f1"].comparable


def test_one_rule_for_names(spark):
    from lureline.functions.expressions import sanitize_name
    names = [" Mi Modelo / v2 ", "a", "--x--", "Año 2024"]
    want = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
            .orderBy("i").select(sanitize_name("n")).collect()]
    assert [files.safe_folder(spark, n) for n in names] == want


TABLES = ("segments", "templates", "targets", "campaigns", "event_log")


def world(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "segments": frame([(1,), (2,)], "id long"),
        "templates": frame([(1,), (2,)], "id long"),
        "targets": frame([(1, 1), (2, 1), (3, 2), (4, None), (5, 77)], "id long, segment_id long"),
        "campaigns": frame([(1, 1, 1), (2, 2, 1), (3, 2, 2), (4, None, None)], "id long, template_id long, segment_id long"),
        "event_log": frame([(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 2), (4, 4, 4, None), (5, 99, 98, 97), (6, 3, 1, 2), (7, None, None, 1)],
                           "id long, campaign_id long, target_id long, template_id long")}


def ids(left):
    return {n: sorted(r.id for r in left[n].collect()) for n in TABLES}


def test_every_parent_can_be_erased(spark):
    t = world(spark)
    some = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    assert ids(quality.erase(t, {"segments": some(1)})) == {
        "segments": [2], "templates": [1, 2], "targets": [3, 4, 5], "campaigns": [3, 4], "event_log": [3, 4, 5, 7]}
    assert ids(quality.erase(t, {"templates": some(2)})) == {
        "segments": [1, 2], "templates": [1], "targets": [1, 2, 3, 4, 5], "campaigns": [1, 4], "event_log": [1, 4, 5, 7]}
    assert ids(quality.erase(t, {"campaigns": some(3, 3, None)}))["event_log"] == [1, 2, 4, 5, 7]
    assert ids(quality.erase(t, {"targets": some(1)}))["event_log"] == [2, 3, 4, 5, 7]
    both = ids(quality.erase(t, {"targets": some(3), "segments": some(1), "event_log": some(5)}))
    assert both["targets"] == [4, 5] and both["event_log"] == [4, 7]
    assert ids(quality.erase(t, {"segments": some()})) == ids(t)
    with pytest.raises(ValueError):
        quality.erase(t, {"users": some(1)})
    with pytest.raises(ValueError):
        quality.parents_first(["a", "b"], (("a", "x", "b"), ("b", "y", "a")))


def test_untouched_tables_are_not_rewritten_and_snapshots_appear_together(spark):
    t = world(spark)
    some = spark.createDataFrame([(3,)], "id long")
    left = quality.erase(t, {"campaigns": some})
    assert all(left[n] is t[n] for n in ("segments", "templates", "targets"))
    log = CommitLog(spark, run_folder(spark, "test-erase"))
    broken = {**t, "event_log": t["event_log"].withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("x"))).otherwise(F.col("id")))}
    with pytest.raises(Exception):
        quality.erase_and_publish(log, 1, broken, {"campaigns": some})
    assert log.latest("campaigns", t["campaigns"].schema).count() == 0  # nothing of a failed erasure shows
    assert quality.erase_and_publish(log, 1, t, {"campaigns": some}) and not quality.erase_and_publish(log, 1, t, {"campaigns": some})
    assert sorted(r.id for r in log.latest("event_log", t["event_log"].schema).collect()) == [1, 2, 4, 5, 7]
