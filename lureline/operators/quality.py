"""Data-quality checks as DataFrames (Q1-Q6, J7). Each returns the violations, not a boolean,
so a check over billions of rows stays a distributed job and its result can be written out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.constants import RECOMMENDED_PLACEHOLDERS, REQUIRED_PLACEHOLDERS
from lureline.functions.expressions import _WS_CLASS

# fixed values: validation messages
MSG_BODY = "html_body is required"
MSG_SUBJECT = "subject is required"
MSG_MISSING = "missing placeholder: "
MSG_RECOMMENDED = "recommended placeholder not found: "


def _blank(c: F.Column) -> F.Column:
    """Python's ``not s or not s.strip()`` for a nullable string."""
    return c.isNull() | (F.length(F.regexp_replace(c, _WS_CLASS, "")) == 0)


def template_validation(templates: DataFrame) -> DataFrame:
    """Q1: errors / warnings per template, joined with '; ' in the fixed order; valid = no error."""
    body = F.coalesce(F.col("html_body"), F.lit(""))
    errors = [F.when(_blank(F.col("html_body")), F.lit(MSG_BODY)),
              F.when(_blank(F.col("subject")), F.lit(MSG_SUBJECT))]
    errors += [F.when(~body.contains(p), F.lit(MSG_MISSING + p)) for p in REQUIRED_PLACEHOLDERS]
    warnings = [F.when(~body.contains(p), F.lit(MSG_RECOMMENDED + p)) for p in RECOMMENDED_PLACEHOLDERS]
    err = F.array_compact(F.array(*errors))
    warn = F.array_compact(F.array(*warnings))
    return templates.select(
        F.col("id").alias("template_id"),
        (F.size(err) == 0).alias("valid"),
        F.size(err).cast("int").alias("n_errors"),
        F.array_join(err, "; ").alias("errors"),
        F.array_join(warn, "; ").alias("warnings"),
    )


def unique_violations(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Q2: values that occur more than once per (table, column); nulls are not compared."""
    parts = [
        df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("occurrences"))
        .where(F.col("occurrences") > 1)
        .select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"), "value", "occurrences")
        for table, df, col in checks
    ]
    return reduce(DataFrame.unionByName, parts)


def null_violations(checks: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Q4: count of nulls per NOT NULL column, one aggregate per table, long form."""
    parts = []
    for table, df, cols in checks:
        agg = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
        entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cols]
        parts.append(agg.select(F.explode(F.array(*entries)).alias("r")).select(
            F.lit(table).alias("table_name"), "r.column_name", "r.null_count"))
    return reduce(DataFrame.unionByName, parts)


def fk_violations(checks: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Child rows whose foreign key names no parent.

    Each check: (relation, child, child_id_col, fk_col, parent, parent_key_col). Checks on the
    same child are answered in one pass over it: each parent's distinct keys are left-joined as
    an existence flag (distinct, so no child row is duplicated; its hash partitioning is reused
    by the join), then one row per violated key is exploded. A large child such as the event log
    is scanned once, not once per foreign key.
    """
    groups: dict[tuple[int, str], list] = {}
    for check in checks:
        groups.setdefault((id(check[1]), check[2]), []).append(check)
    parts = []
    for (_, id_col), group in groups.items():
        child = group[0][1]
        rows = child.select(F.col(id_col).cast("bigint").alias("_child_id"),
                            *[F.col(fk).alias(f"_fk{i}") for i, (_, _, _, fk, _, _) in enumerate(group)])
        violations = []
        for i, (rel, _, _, _, parent, pk) in enumerate(group):
            keys = parent.select(F.col(pk).alias(f"_pk{i}")).distinct().withColumn(f"_ok{i}", F.lit(True))
            rows = rows.join(keys, F.col(f"_fk{i}") == F.col(f"_pk{i}"), "left")
            violations.append(F.when(F.col(f"_fk{i}").isNotNull() & F.col(f"_ok{i}").isNull(),
                                     F.struct(F.lit(rel).alias("relation"),
                                              F.col("_child_id").alias("child_id"),
                                              F.col(f"_fk{i}").cast("bigint").alias("missing_key"))))
        any_bad = reduce(lambda x, y: x | y, [F.col(f"_fk{i}").isNotNull() & F.col(f"_ok{i}").isNull()
                                              for i in range(len(group))])
        parts.append(rows.where(any_bad)
                     .select(F.explode(F.array_compact(F.array(*violations))).alias("_v"))
                     .select("_v.*"))
    return reduce(DataFrame.unionByName, parts)


def cascade_delete(segments: DataFrame, targets: DataFrame, campaigns: DataFrame,
                   event_log: DataFrame, erase_segments: DataFrame) -> dict[str, DataFrame]:
    """Q6: erase segments and everything that hangs from them (targets, campaigns, events).

    ``left_anti`` joins on the erased keys give the surviving snapshot of each table: an event
    goes only if its campaign or target is erased, so orphans that hang from nothing erased stay.
    """
    gone_seg = erase_segments.select(F.col("id").alias("_sid")).distinct()
    seg_left = segments.join(gone_seg, segments.id == gone_seg._sid, "left_anti")
    tgt_left = targets.join(gone_seg, targets.segment_id == gone_seg._sid, "left_anti")
    camp_left = campaigns.join(gone_seg, campaigns.segment_id == gone_seg._sid, "left_anti")
    erased = lambda table, key: table.join(
        gone_seg, table.segment_id == gone_seg._sid, "left_semi").select(F.col("id").alias(key))
    ev_left = (event_log.join(erased(campaigns, "campaign_id"), "campaign_id", "left_anti")
               .join(erased(targets, "target_id"), "target_id", "left_anti"))
    return {"segments": seg_left, "targets": tgt_left, "campaigns": camp_left, "event_log": ev_left}


#: The declared foreign keys of the operational tables: child, its column, parent (by ``id``).
FOREIGN_KEYS = (
    ("targets", "segment_id", "segments"), ("campaigns", "template_id", "templates"),
    ("campaigns", "segment_id", "segments"), ("event_log", "campaign_id", "campaigns"),
    ("event_log", "target_id", "targets"), ("event_log", "template_id", "templates"),
)


def parents_first(tables, foreign_keys=FOREIGN_KEYS) -> list[str]:
    """The tables so that every parent stands before its children; a cycle is an error."""
    left, order = list(tables), []
    while left:
        free = [t for t in left if not any(c == t and p in left and p != t for c, _, p in foreign_keys)]
        if not free:
            raise ValueError(f"foreign keys of {left} form a cycle")
        order += free
        left = [t for t in left if t not in free]
    return order


def erase(tables: dict[str, DataFrame], erased: dict[str, DataFrame], foreign_keys=FOREIGN_KEYS) -> dict[str, DataFrame]:
    """Q6 for any parent: the surviving rows of every table after the rows named in ``erased``
    (table -> DataFrame with ``id``) and all that hangs from them are gone.

    One walk over the foreign-key graph, parents first. A table that loses nothing is returned as it
    is; any other is rewritten once, by one anti-join per foreign key whose parent lost rows. The ids
    that a table loses are collected by semi-joins only if it has children of its own. Null keys and
    keys that name no erased parent (orphans) stay.
    """
    unknown = set(erased) - set(tables)
    if unknown:
        raise ValueError(f"no such table: {sorted(unknown)}")
    gone: dict[str, DataFrame] = {}
    out = {}
    for name in parents_first(tables, foreign_keys):
        table, lost = tables[name], []
        if name in erased:
            lost.append(("id", erased[name].select(F.col("id").alias("_gone")).where("_gone is not null").distinct()))
        lost += [(fk, gone[p]) for c, fk, p in foreign_keys if c == name and p in gone and p != name]
        left = table
        for column, keys in lost:
            left = left.join(keys, F.col(column) == F.col("_gone"), "left_anti")
        out[name] = left
        if lost and any(p == name for _, _, p in foreign_keys):
            ids = [table.join(keys, F.col(column) == F.col("_gone"), "left_semi").select(F.col("id").alias("_gone"))
                   for column, keys in lost]
            gone[name] = reduce(DataFrame.unionByName, ids).where("_gone is not null").distinct()
    return out


def erase_and_publish(log, batch_id: int, tables: dict[str, DataFrame], erased: dict[str, DataFrame],
                      foreign_keys=FOREIGN_KEYS) -> bool:
    """Write the surviving snapshots and publish all of them together (``CommitLog``), so no reader
    sees a child whose parent is gone; False where the batch had been published before."""
    if log.has(batch_id):
        return False
    left = erase(tables, erased, foreign_keys)
    return log.publish(batch_id, {name: log.stage(df, name) for name, df in left.items()})
