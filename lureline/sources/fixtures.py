"""Operational tables derived from the driver's parquet (the mapping of FIXTURES.md, part B).

``segments`` <- nation, ``targets`` <- customer, ``campaigns`` <- segments x templates 1..8,
``event_log`` <- events joined to customer, ``hits`` <- events of type view/click/error as URLs,
``users`` <- supplier. Only ``templates`` is a literal (a 10-row dimension).

Every function reads only the columns it needs so the parquet scan prunes, and returns a lazy
DataFrame. ``FIXTURE_SQL`` holds the same mapping as DuckDB SQL for the oracles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.constants import AGE_BRACKETS, EDUCATIONS

TEMPLATE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("subject", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("html_body", T.StringType(), False),
    T.StructField("signals", T.StringType(), True),
    T.StructField("version", T.IntegerType(), False),
])

_FULL = ("<html><body><p>{text}</p><p><a href=\"{{{{ landing_url }}}}\">Open</a></p>"
         "{{{{ tracking_dot }}}}<p><a href=\"{{{{ report_url }}}}\">Report</a></p></body></html>")
_NO_REPORT = ("<html><body><p>{text}</p><p><a href=\"{{{{ landing_url }}}}\">Open</a></p>"
              "{{{{ tracking_dot }}}}</body></html>")

# Our own neutral template texts. Signal patterns: 1 urgency, 2 authority, 3 reward,
# 4 personalization, 5 urgency+authority, 6 authority+personalization,
# 7 reward+personalization, 8 none. Signals use mixed JSON encodings on purpose.
TEMPLATE_ROWS = (
    (1, "email", "Deadline reminder", "Action needed today", "Urgency cue",
     _FULL.format(text="Your request closes today &amp; needs a reply."),
     '{"urgencia": 1, "autoridad": 0, "recompensa": 0, "personalizacion": 0}', 1),
    (2, "email", "Office memo", "Notice from the office", "Authority cue",
     _FULL.format(text="The office asks all staff to read this memo."),
     '{"urgencia": false, "autoridad": true, "recompensa": 0, "personalizacion": null}', 1),
    (3, "email", "Voucher", "A voucher is waiting", "Reward cue",
     _FULL.format(text="A voucher is available <b>this week</b>."),
     '{"urgencia": "0", "autoridad": "no", "recompensa": "1"}', 1),
    (4, "email", "Account update", "An update for you", "Personal cue",
     _FULL.format(text="We prepared an update for your account."),
     '{"urgencia": 0, "autoridad": 0, "recompensa": 0, "personalizacion": "true"}', 2),
    (5, "email", "Urgent memo", "Urgent notice from the office", "Combined cues",
     _FULL.format(text="The office needs your reply before noon."),
     '{"urgencia": "True", "autoridad": 1.0, "recompensa": 0, "personalizacion": 0}', 1),
    (6, "email", "Personal memo", "Important notice for you", "Combined cues",
     _FULL.format(text="A note from the office, prepared for you."),
     '{"urgencia": 0, "autoridad": "true", "recompensa": "yes", "personalizacion": 1}', 1),
    (7, "email", "Personal voucher", "A voucher for you", "Combined cues",
     _NO_REPORT.format(text="A voucher picked for you."),
     '{"recompensa": true, "personalizacion": "1"}', 1),
    (8, "email", "Neutral notice", "General information", None,
     _FULL.format(text="General information &copy; the office &middot; 2024."),
     None, 1),
    (9, "email", "Broken draft", "", "Invalid on purpose",
     "<p>No links here.</p>", '{"urgencia": "1.0"}', 1),
    (10, "sms", "Short message", "Text", "Other channel",
     "Reply {{ landing_url }}", '{"urgencia": 1}', 1),
)


def literal_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small literal table built JVM-side (``inline`` of an array of structs on a one-row
    range), so jobs that read it need no Python worker."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
               for row in rows]
    return spark.range(0, 1, 1, numPartitions=1).select(F.inline(F.array(*structs)))


def templates(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TEMPLATE_ROWS, TEMPLATE_SCHEMA)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one input table (listed anew each time, so later files are seen)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = read_table(spark, sf_dir, name)
    return df.select(*cols) if cols else df


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    age = F.element_at(F.array(*[F.lit(a) for a in AGE_BRACKETS]), F.col("n_regionkey") + 1)
    edu = F.element_at(F.array(*[F.lit(e) for e in EDUCATIONS]), F.col("n_nationkey") % 4 + 1)
    gender = (F.when(F.col("n_nationkey") == 12, F.lit("N/A"))
              .when(F.col("n_nationkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")))
    return n.select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("id"),
        age.alias("age_bracket"), gender.alias("gender"), edu.alias("education"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    uid = F.when(F.col("c_custkey") % 50 == 0, F.lit(None).cast("string")).otherwise(
        F.md5(F.concat(F.lit("uid|"), F.col("c_custkey").cast("string"))))
    return c.select(
        F.col("c_custkey").cast("bigint").alias("id"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("segment_id"),
        F.col("c_name").alias("recipient"),
        uid.alias("uid"),
        F.lit(None).cast("string").alias("meta"),
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign per (segment, template 1..8): a generator per segment row, no cross join."""
    seg = segments(spark, sf_dir).select(F.col("id").alias("segment_id"))
    c = seg.select("segment_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("t"))
    draft = (F.col("t") == 8) & (F.col("segment_id") % 5 == 0)
    return c.select(
        ((F.col("segment_id") - 1) * 8 + F.col("t")).cast("bigint").alias("id"),
        F.lit("email").alias("channel"),
        F.when(draft, F.lit(None).cast("timestamp_ntz")).otherwise(
            F.expr("timestampadd(DAY, t, TIMESTAMP_NTZ'2024-01-01 00:00:00')")).alias("launched_at"),
        F.when(draft, F.lit("draft")).otherwise(F.lit("launched")).alias("status"),
        F.col("t").cast("bigint").alias("template_id"),
        F.col("segment_id").cast("bigint").alias("segment_id"),
    )


EVENT_TYPE_MAP = {"signup": "delivered", "view": "opened", "click": "clicked", "error": "reported"}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    cu = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    k = F.get_json_object("props", "$.k").cast("int")
    etype = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPE_MAP.items() for x in kv]),
                     F.col("event_type")),
        F.lit("other"))
    joined = ev.join(cu, ev.user_id == cu.c_custkey, "inner")
    template_id = (k % 8 + 1).cast("bigint")
    return joined.select(
        F.col("event_id").alias("id"),
        (F.col("c_nationkey") * 8 + template_id).cast("bigint").alias("campaign_id"),
        F.col("user_id").cast("bigint").alias("target_id"),
        template_id.alias("template_id"),
        etype.alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.lit(None).cast("string").alias("meta"),
    )


def raw_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log before its keys are checked: some events name a target, a campaign or a template
    that does not exist, some name none."""
    bad = lambda n, value, col: F.when(F.col("id") % n == 0, value).otherwise(F.col(col)).alias(col)
    return event_log(spark, sf_dir).select(
        "id", bad(103, F.lit(-1).cast("bigint"), "campaign_id"), bad(101, -F.col("id"), "target_id"),
        bad(107, F.lit(99).cast("bigint"), "template_id"),
        bad(109, F.lit(None).cast("string"), "event_type"), "occurred_at", "meta")


HIT_PATH = {"view": "open.gif", "click": "r", "error": "report"}


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker hits as raw URLs (what a web log would hold): one per view/click/error event."""
    ev = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    ev = ev.where(F.col("event_type").isin(*HIT_PATH))
    path = F.element_at(F.create_map(*[F.lit(x) for kv in HIT_PATH.items() for x in kv]),
                        F.col("event_type"))
    uid = F.when(F.col("event_id") % 97 == 0,
                 F.concat(F.lit("unknown-"), F.col("event_id").cast("string"))).otherwise(
        F.md5(F.concat(F.lit("uid|"), F.col("user_id").cast("string"))))
    return ev.select(
        F.col("event_id").alias("hit_id"),
        F.concat(F.lit("http://t.example/"), path, F.lit("?uid="), uid).alias("url"),
        F.col("ts").alias("ts"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented accounts from ``supplier``; emails repeat for pairs so uniqueness checks bite."""
    s = _read(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return s.select(
        F.col("s_suppkey").cast("bigint").alias("id"),
        F.lower(F.regexp_replace("s_name", "#", "_")).alias("username"),
        F.concat(F.lit("user"), (F.col("s_suppkey") / 2).cast("bigint").cast("string"),
                 F.lit("@example.org")).alias("email"),
        F.lit("analyst").alias("role"),
        F.lit(True).alias("is_active"),
    )


@dataclass
class Fixtures:
    segments: DataFrame
    templates: DataFrame
    targets: DataFrame
    campaigns: DataFrame
    event_log: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Fixtures:
    """The operational tables of one input folder."""
    return Fixtures(
        segments=segments(spark, sf_dir),
        templates=templates(spark),
        targets=targets(spark, sf_dir),
        campaigns=campaigns(spark, sf_dir),
        event_log=event_log(spark, sf_dir),
    )


# ----------------------------------------------------------------------------------------------
# The same mapping as DuckDB SQL (oracle side).
# ----------------------------------------------------------------------------------------------

def _sql_str(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _templates_values() -> str:
    rows = ",\n    ".join(
        "(" + ", ".join([f"CAST({r[0]} AS BIGINT)"] + [_sql_str(x) for x in r[1:7]]
                        + [f"CAST({r[7]} AS INTEGER)"]) + ")"
        for r in TEMPLATE_ROWS)
    return (f"SELECT * FROM (VALUES\n    {rows}\n) AS t(id, channel, name, subject, description, "
            f"html_body, signals, version)")


_AGES = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGE_BRACKETS))
_EDUS = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EDUCATIONS))

FIXTURE_SQL = {
    "segments": f"""SELECT CAST(n_nationkey + 1 AS BIGINT) AS id,
    CASE n_regionkey {_AGES} END AS age_bracket,
    CASE WHEN n_nationkey = 12 THEN 'N/A' WHEN n_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CASE n_nationkey % 4 {_EDUS} END AS education
  FROM nation""",
    "templates": _templates_values(),
    "targets": """SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey + 1 AS BIGINT) AS segment_id,
    c_name AS recipient,
    CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE md5('uid|' || CAST(c_custkey AS VARCHAR)) END AS uid,
    CAST(NULL AS VARCHAR) AS meta
  FROM customer""",
    "campaigns": """SELECT CAST((s.id - 1) * 8 + r.t AS BIGINT) AS id, 'email' AS channel,
    CASE WHEN r.t = 8 AND s.id % 5 = 0 THEN NULL
         ELSE TIMESTAMP '2024-01-01 00:00:00' + r.t * INTERVAL 1 DAY END AS launched_at,
    CASE WHEN r.t = 8 AND s.id % 5 = 0 THEN 'draft' ELSE 'launched' END AS status,
    CAST(r.t AS BIGINT) AS template_id, CAST(s.id AS BIGINT) AS segment_id
  FROM segments s, (SELECT range AS t FROM range(1, 9)) r""",
    "event_log": """SELECT e.event_id AS id,
    CAST(c.c_nationkey * 8 + CAST(e.props->>'$.k' AS INTEGER) % 8 + 1 AS BIGINT) AS campaign_id,
    CAST(e.user_id AS BIGINT) AS target_id,
    CAST(CAST(e.props->>'$.k' AS INTEGER) % 8 + 1 AS BIGINT) AS template_id,
    CASE e.event_type WHEN 'signup' THEN 'delivered' WHEN 'view' THEN 'opened'
         WHEN 'click' THEN 'clicked' WHEN 'error' THEN 'reported' ELSE 'other' END AS event_type,
    e.ts AS occurred_at, CAST(NULL AS VARCHAR) AS meta
  FROM events e JOIN customer c ON e.user_id = c.c_custkey""",
    "raw_event_log": """SELECT id, CASE WHEN id % 103 = 0 THEN -1 ELSE campaign_id END AS campaign_id,
    CASE WHEN id % 101 = 0 THEN -id ELSE target_id END AS target_id,
    CASE WHEN id % 107 = 0 THEN 99 ELSE template_id END AS template_id,
    CASE WHEN id % 109 = 0 THEN NULL ELSE event_type END AS event_type, occurred_at, meta
  FROM event_log""",
    "hits": """SELECT event_id AS hit_id,
    'http://t.example/' || CASE event_type WHEN 'view' THEN 'open.gif' WHEN 'click' THEN 'r' ELSE 'report' END
      || '?uid=' || CASE WHEN event_id % 97 = 0 THEN 'unknown-' || CAST(event_id AS VARCHAR)
                         ELSE md5('uid|' || CAST(user_id AS VARCHAR)) END AS url,
    ts
  FROM events WHERE event_type IN ('view', 'click', 'error')""",
    "users": """SELECT CAST(s_suppkey AS BIGINT) AS id, lower(replace(s_name, '#', '_')) AS username,
    'user' || CAST(CAST(trunc(s_suppkey / 2) AS BIGINT) AS VARCHAR) || '@example.org' AS email,
    'analyst' AS role, true AS is_active
  FROM supplier""",
}


def sql_with(*names: str) -> str:
    """``WITH`` prelude defining the named fixture views (dependencies included, in order)."""
    order = ["segments", "templates", "targets", "campaigns", "event_log", "raw_event_log", "hits", "users"]
    need = set(names)
    if "campaigns" in need:
        need.add("segments")
    if "raw_event_log" in need:
        need.add("event_log")
    chosen = [n for n in order if n in need]
    return "WITH " + ",\n".join(f"{n} AS (\n  {FIXTURE_SQL[n]}\n)" for n in chosen)

