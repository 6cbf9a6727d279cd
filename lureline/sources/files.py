"""File sources and sinks.

* CSV datasets are read as strings (no schema inference at scale), NA tokens become null the way
  ``pandas.read_csv`` reads them, then each column is ``try_cast`` to the declared schema.
* Versioned artifacts live under ``<base>/<name>/run_id=<yyyyMMdd_HHmmss>/`` and are written with
  ``errorifexists``, so one run never overwrites another; the latest run is read by filtering the
  partition column (partition pruning), with a fallback to an unversioned path.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.constants import SOURCE_COMBINED, SOURCE_OBSERVED, SOURCE_SYNTHETIC
from lureline.functions.expressions import na_to_null, sanitize_name

FACT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("campaign_id", T.LongType()),
    T.StructField("campaign_status", T.StringType()),
    T.StructField("campaign_channel", T.StringType()),
    T.StructField("campaign_launched_at", T.TimestampNTZType()),
    T.StructField("template_id", T.LongType()),
    T.StructField("template_name", T.StringType()),
    T.StructField("template_subject", T.StringType()),
    T.StructField("template_description", T.StringType()),
    T.StructField("signal_urgency", T.IntegerType()),
    T.StructField("signal_authority", T.IntegerType()),
    T.StructField("signal_reward", T.IntegerType()),
    T.StructField("signal_personalization", T.IntegerType()),
    T.StructField("segment_id", T.LongType()),
    T.StructField("age_bracket", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("education", T.StringType()),
    T.StructField("target_id", T.LongType()),
    T.StructField("target_recipient", T.StringType()),
    T.StructField("target_uid", T.StringType()),
    T.StructField("delivered", T.LongType()),
    T.StructField("opened", T.LongType()),
    T.StructField("clicked", T.LongType()),
    T.StructField("reported", T.LongType()),
    T.StructField("opened_flag", T.IntegerType()),
    T.StructField("clicked_flag", T.IntegerType()),
    T.StructField("reported_flag", T.IntegerType()),
])

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def source_from_path(path_col: F.Column) -> F.Column:
    """S2 default: 'synthetic' / 'combined' when the file name says so, else 'observed'."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    return (F.when(name.contains("synthetic"), F.lit(SOURCE_SYNTHETIC))
            .when(name.contains("combined"), F.lit(SOURCE_COMBINED))
            .otherwise(F.lit(SOURCE_OBSERVED)))


def _typed(text: F.Column, kind: T.DataType) -> F.Column:
    """Text to its type; a whole number may be written as a decimal (``1.0``)."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType):
        wide = text.try_cast("double")
        return F.coalesce(text.try_cast(kind), F.when(wide == F.floor(wide), wide.cast("string").try_cast("decimal(38,0)").try_cast(kind)))
    return text.try_cast(kind)


def read_dataset_csv(spark: SparkSession, path: str, schema: T.StructType = FACT_SCHEMA,
                     multi_line: bool = False) -> DataFrame:
    """S2 + S3: header CSV -> NA tokens as null -> typed columns; ``source`` from the file name
    when the file has no such column (decided per file via the scanned file's path).

    ``multi_line`` is for files whose quoted fields hold line ends; it makes each file one task.
    """
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", multi_line).option("nullValue", None).option("emptyValue", "")
           .csv(path))
    present = set(raw.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            c = na_to_null(F.col(f"`{f.name}`"))
            cols.append(_typed(c, f.dataType).alias(f.name))
        elif f.name == "source":
            # a folder written by Spark is one dataset named by the folder; a file by its name
            name = F.lit(path.rstrip("/")) if is_folder(spark, path) else F.col("_metadata.file_path")
            cols.append(source_from_path(name).alias("source"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in {f.name for f in schema.fields}]
    return raw.select(*cols, *extra)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 CSV with header, no index column; timestamps as ``yyyy-MM-dd HH:mm:ss``."""
    (df.write.mode(mode).option("header", True).option("encoding", "UTF-8")
       .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=()) -> None:
    """Parquet next to the CSV (optionally partitioned, e.g. by campaign_id)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def run_timestamp() -> str:
    """Run id ``yyyyMMdd_HHmmss`` from the driver's clock."""
    return datetime.now().strftime("%Y%m%d_%H%M%S")


def safe_folder(spark: SparkSession, name: str) -> str:
    """A folder name made of any name, by the one rule for names (C1); a constant, so no job runs."""
    return spark.sql("SELECT 1").select(sanitize_name(F.lit(name))).first()[0]


def write_versioned(df: DataFrame, base: str, name: str, run_id: str, fmt: str = "parquet") -> str:
    """Write one run under ``<base>/<name>/run_id=<run_id>``; an existing run is an error."""
    path = f"{base.rstrip('/')}/{safe_folder(df.sparkSession, name)}/run_id={run_id}"
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "text":
        writer.text(path)
    else:
        writer.parquet(path)
    return path


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def newest_run(spark: SparkSession, base: str, name: str) -> str | None:
    """Folder of the newest run (largest ``run_id``), from one listing of the run folders."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{safe_folder(spark, name)}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    runs = [s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith("run_id=")]
    return max(runs, key=lambda p: p.rsplit("run_id=", 1)[1], default=None)


def read_latest(spark: SparkSession, base: str, name: str, legacy: str | None = None,
                fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame | None:
    """The newest run (largest ``run_id``, which sorts as time) or the legacy path; None if
    neither. Only the newest run's files are listed and read."""
    newest = newest_run(spark, base, name)
    path = newest or (legacy if legacy and _exists(spark, legacy) else None)
    if path is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.format(fmt).load(path)
    return df.withColumn("run_id", F.lit(path.rsplit("run_id=", 1)[1])) if newest else df


def write_metrics(df: DataFrame, base: str, name: str, run_id: str) -> str:
    """S6 sink: metrics rows as JSON under the run's folder."""
    return write_versioned(df, base, name, run_id, fmt="json")


def read_metrics(spark: SparkSession, base: str, name: str, schema: T.StructType) -> DataFrame:
    """S6 scan with a fixed schema; a missing artifact is an empty table (not an error)."""
    df = read_latest(spark, base, name, fmt="json", schema=schema)
    return df if df is not None else spark.createDataFrame([], schema)


DATASET_OPTIONS = ("observed-live", "observed-export", "synthetic", "combined")
#: Names of exported datasets; a versioned export is ``<name>_<source>_<run id>.csv``.
EXPORT_NAME = "analytic_dataset"
EXPORTS = {"observed-export": (SOURCE_OBSERVED, f"{EXPORT_NAME}.csv"),
           "synthetic": (SOURCE_SYNTHETIC, f"{EXPORT_NAME}_{SOURCE_SYNTHETIC}.csv"),
           "combined": (SOURCE_COMBINED, f"{EXPORT_NAME}_{SOURCE_COMBINED}.csv")}


def newest_export(spark: SparkSession, base: str, option: str) -> str | None:
    """Path of the newest versioned export of an option (run ids sort as time), else the legacy
    file, else None; one listing of the export folder."""
    source, legacy = EXPORTS[option]
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    prefix = f"{EXPORT_NAME}_{source}_"
    versions = [n for n in names if n.startswith(prefix) and n.endswith(".csv")]
    chosen = max(versions, default=legacy if legacy in names else None)
    return None if chosen is None else f"{base.rstrip('/')}/{chosen}"


def load_dataset(spark: SparkSession, option: str, exports: str, live=None, multi_line: bool = False) -> DataFrame:
    """The dataset of an option, found by itself: ``observed-live`` calls ``live`` (the fact over
    the operational tables), any other reads its newest export under ``exports`` with its types and
    source. An unknown option or a missing export is an empty fact."""
    if option == "observed-live":
        found = live() if live is not None else None
    else:
        path = newest_export(spark, exports, option) if option in EXPORTS else None
        found = None if path is None else read_dataset_csv(spark, path, multi_line=multi_line)
    return found if found is not None else spark.createDataFrame([], FACT_SCHEMA)


def choose_dataset(spark: SparkSession, option: str, loaders: dict) -> DataFrame:
    """One of the four datasets by option; unknown option or missing data -> empty fact."""
    fn = loaders.get(option)
    df = fn() if fn is not None else None
    return df if df is not None else spark.createDataFrame([], FACT_SCHEMA)
