"""Stored model runs side by side (E8), their winners (E9) and comparability.

A run is one JSON document under ``<base>/<model>/run_id=<run id>``. Documents differ: fields may be
missing, stand at the top or under ``metrics``, or hold something that is no number. The scan reads
every document into a VARIANT, so no schema has to fit all of them; what a comparison needs is taken
out by path, and what is not there, or not a number, is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.operators.evaluation import METRIC_DIRECTIONS
from lureline.sources import files

#: What a comparison reports besides the metrics.
SIZES = ("n_rows", "train_rows", "test_rows", "positive_cases_total")
LABELS = ("dataset_path", "mode")
_NO_RUNS = "model string, run_id string, run variant"


def store_run(document: DataFrame, base: str, model: str, run_id: str) -> str:
    """Write one run (a DataFrame of one row; structs and arrays are nested fields) as a document."""
    fields = F.to_json(F.struct(*document.columns))
    return files.write_versioned(document.select(fields.alias("value")).coalesce(1), base, model, run_id, fmt="text")


def scan_runs(spark: SparkSession, base: str) -> DataFrame:
    """``model, run_id, run`` (VARIANT) of every stored document; a document that is no JSON has a null run."""
    if not files.is_folder(spark, base):
        return spark.createDataFrame([], _NO_RUNS)
    raw = spark.read.text(base, wholetext=True, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, "([^/]+)/run_id=[^/]+/[^/]*$", 1).alias("model"),
        F.regexp_extract(path, "/run_id=([^/]+)/[^/]*$", 1).alias("run_id"),
        F.try_parse_json(F.col("value")).alias("run")).where("run_id <> '' and length(trim(value)) > 0")


def newest_runs(runs: DataFrame) -> DataFrame:
    """The run of greatest id per model (run ids sort as time)."""
    newest = runs.groupBy("model").agg(F.max("run_id").alias("run_id"))
    return runs.join(newest, ["model", "run_id"], "left_semi")


def field(name: str, kind: str) -> F.Column:
    """A field of a run, from the top of the document or from ``metrics``."""
    return F.coalesce(F.try_variant_get("run", f"$.{name}", kind), F.try_variant_get("run", f"$.metrics.{name}", kind))


def run_table(runs: DataFrame) -> DataFrame:
    """One row per run; metrics as doubles, sizes as longs, absent ones null."""
    return runs.select("model", "run_id", *[field(m, "double").alias(m) for m in METRIC_DIRECTIONS],
                       *[field(s, "bigint").alias(s) for s in SIZES], *[field(x, "string").alias(x) for x in LABELS])


def run_winners(table: DataFrame, a: str, b: str) -> DataFrame:
    """E9 + E10 for two models of :func:`run_table`: per metric both values and the better model
    ('tie' if equal, null if a value is missing), and whether rows, train and test sizes are equal.
    A size that a run does not report is not equal to anything; ``comparable`` needs all three."""
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    rows = []
    for metric, higher in METRIC_DIRECTIONS.items():
        va, vb = of(a, metric), of(b, metric)
        first, second = (va > vb, vb > va) if higher else (va < vb, vb < va)
        rows.append(F.struct(
            F.lit(metric).alias("metric"), va.alias("value_a"), vb.alias("value_b"),
            F.when(va.isNull() | vb.isNull(), F.lit(None).cast("string")).when(first, F.lit(a)).when(second, F.lit(b))
            .otherwise(F.lit("tie")).alias("winner")))
    same = {f"same_{s}": F.coalesce(of(a, s) == of(b, s), F.lit(False)) for s in SIZES[:3]}
    agg = table.where(F.col("model").isin(a, b)).agg(F.array(*rows).alias("r"), *[c.alias(n) for n, c in same.items()])
    every = F.lit(True)
    for name in same:
        every = every & F.col(name)
    return agg.select(F.explode("r").alias("x"), *same, every.alias("comparable")).select("x.*", *same, "comparable")
