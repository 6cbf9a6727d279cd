"""Shared helpers of the llm operators: inputs, row keys, scratch tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fresh scan of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor costs no more than the running stage). The files go when
    the session's folder is removed, or earlier with :func:`drop_scratch`.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`scratch` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def lower_az(col):
    """A-Z to lower case, nothing else (``lower`` would also fold other scripts)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rest: bool = False, cast: str | None = "string") -> DataFrame:
    """``_rid, <id>, <text>``: a unique long per row whose order follows the id (nulls first).

    Unique ids serve as they are. Where ids repeat or are null (one narrow aggregate tells),
    rows get their position in the order (id, text) instead, from a distributed sort; so every
    row of a repeated id is a document of its own. ``ids_serve`` on the result tells which.
    ``rest`` adds the other columns as the struct ``_rest`` (no name can clash).
    """
    other = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    packed = [F.struct(*other).alias("_rest")] if rest and other else []
    value = F.col(text_col).cast(cast) if cast else F.col(text_col)
    rows = docs.select(F.col(id_col).alias(id_col), value.alias(text_col), *packed)
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType))
    odd = rows.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull())
    if whole and odd.isEmpty():
        out = rows.withColumn("_rid", F.col(id_col).cast("long"))
        out.ids_serve = True
        return out
    from lureline.operators.ranking import with_global_rank
    ranked = with_global_rank(rows, [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()],
                              rank_col="_rid")
    out = scratch(ranked.select(*rows.columns, "_rid"), "rows")
    out.ids_serve = False
    return out


def _jump(parents: DataFrame) -> DataFrame:
    """``(id, up)`` of a forest (``up < id``) -> the root of every id, by pointer doubling.

    Each round is one self-join: a root that most ids point to is a hot key on its left side only,
    which AQE splits. The number of rounds is the logarithm of the longest path.
    """
    current = scratch(parents, "forest")
    while True:
        seen = Observation()
        above = current.select(F.col("id").alias("up"), F.col("up").alias("_top"))
        after = current.join(above, "up", "left").observe(seen, F.count("_top").alias("moved")) \
            .select("id", F.coalesce("_top", "up").alias("up"))
        after = scratch(after, "forest")
        drop_scratch(current)
        current = after
        if not seen.get["moved"]:
            return current


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(src, dst)``: one row ``(id, component)`` per node with an edge;
    the component is its smallest node.

    Rounds of hooking and contraction: every node hooks onto its smallest smaller neighbour (an
    aggregate, combined map-side), the trees that arise are collapsed by pointer doubling, and the
    edges between different trees are kept between their roots for the next round. Nothing is
    collected per node, so a hub that holds a third of all edges is never one group.
    """
    left = scratch(edges.filter("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    labels = None
    while True:
        roots = _jump(left.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("up")))
        if labels is None:
            labels = roots
        else:  # labels found before now point to the new roots; the roots themselves join them
            moved = roots.select(F.col("id").alias("up"), F.col("up").alias("_top"))
            labels = scratch(labels.join(moved, "up", "left").select("id", F.coalesce("_top", "up").alias("up"))
                             .unionByName(roots), "labels")
        root = lambda side: roots.select(F.col("id").alias(side), F.col("up").alias(f"_{side}"))
        between = left.join(root("src"), "src").join(root("dst"), "dst", "left") \
            .select(F.col("_src").alias("a"), F.coalesce("_dst", "dst").alias("b")).filter("a <> b")
        after = scratch(between.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
                        .distinct(), "edges")
        drop_scratch(left)
        left = after
        if left.isEmpty():
            break
    found = labels.select("id", F.col("up").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def then(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels(id, component)`` followed by ``more`` (components of the components)."""
    onto = more.select(F.col("id").alias("component"), F.col("component").alias("_next"))
    return labels.join(onto, "component", "left").select("id", F.coalesce("_next", "component").alias("component"))


def add_columns(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """``df`` plus columns computed per Arrow batch; ``make(batch)`` returns the new arrays.

    Input columns that clash with a new name are replaced.
    """
    import pyarrow as pa
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    kept_names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            arrays = [batch.column(c) for c in kept_names] + list(make(batch))
            yield pa.RecordBatch.from_arrays(arrays, names=kept_names + names)

    return df.mapInArrow(run, T.StructType(kept + fields))
