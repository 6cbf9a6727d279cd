"""DuckDB SQL for every query with an exact oracle.

The views ``nation customer events ...`` are the driver's parquet tables. The fixture mapping is
spelled once (``lureline.sources.fixtures.FIXTURE_SQL``) and composed into ``WITH`` preludes here.
Each SQL returns the same column names and types as its Spark query.
"""

from __future__ import annotations

from lureline.constants import (
    DEMOGRAPHIC_COLUMNS,
    EVENT_TYPES,
    GENERAL_INDICATORS,
    GLOBAL_INDICATORS,
    SIGNAL_COLUMNS,
    SIGNAL_KEYS,
    SIGNAL_LABELS,
    TRUTHY_STRINGS,
)
from lureline.sources.fixtures import FIXTURE_SQL

NUMERIC_JSON = "('UBIGINT', 'BIGINT', 'DOUBLE', 'INTEGER', 'UINTEGER', 'HUGEINT')"


def signal_sql(json_col: str, key: str) -> str:
    truthy = ", ".join(f"'{t}'" for t in TRUTHY_STRINGS)
    v = f"({json_col}->>'$.{key}')"
    return (f"CAST(coalesce(CASE json_type({json_col}, '$.{key}') "
            f"WHEN 'VARCHAR' THEN {v} IN ({truthy}) "
            f"WHEN 'BOOLEAN' THEN {v} = 'true' "
            f"WHEN 'NULL' THEN false "
            f"ELSE (json_type({json_col}, '$.{key}') IN {NUMERIC_JSON} AND TRY_CAST({v} AS DOUBLE) = 1.0) "
            f"END, false) AS INTEGER)")


def rate_sql(num: str, den: str) -> str:
    return (f"CAST(CASE WHEN ({den}) IS NULL OR ({den}) = 0 THEN 0.0 "
            f"ELSE round_even(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0, 2) END AS DOUBLE)")


def _counts_sql() -> str:
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    cols = ", ".join(f"CAST(count_if(event_type = '{t}') AS BIGINT) AS {t}" for t in EVENT_TYPES)
    return (f"SELECT campaign_id, target_id, {cols} FROM event_log "
            f"WHERE event_type IN ({types}) GROUP BY campaign_id, target_id")


def _tpl_dim_sql() -> str:
    sig = ", ".join(f"{signal_sql('signals', k)} AS {c}" for c, k in SIGNAL_KEYS.items())
    return (f"SELECT id AS template_id, name AS template_name, subject AS template_subject, "
            f"description AS template_description, {sig} FROM templates")


def _fact_sql(source: str = "observed") -> str:
    z = {t: f"CAST(coalesce(k.{t}, 0) AS BIGINT)" for t in EVENT_TYPES}
    sig = ", ".join(f"CAST(coalesce(t.{c}, 0) AS INTEGER) AS {c}" for c in SIGNAL_COLUMNS)
    return f"""SELECT '{source}' AS source, c.id AS campaign_id, c.status AS campaign_status,
    c.channel AS campaign_channel, c.launched_at AS campaign_launched_at,
    t.template_id, t.template_name, t.template_subject, t.template_description, {sig},
    s.id AS segment_id, s.age_bracket, s.gender, s.education,
    g.id AS target_id, g.recipient AS target_recipient, g.uid AS target_uid,
    {z['delivered']} AS delivered, {z['opened']} AS opened, {z['clicked']} AS clicked,
    {z['reported']} AS reported,
    CAST({z['opened']} > 0 AS INTEGER) AS opened_flag, CAST({z['clicked']} > 0 AS INTEGER) AS clicked_flag,
    CAST({z['reported']} > 0 AS INTEGER) AS reported_flag
  FROM campaigns c
  LEFT JOIN tpl_dim t ON c.template_id = t.template_id
  LEFT JOIN segments s ON c.segment_id = s.id
  JOIN targets g ON g.segment_id = c.segment_id
  LEFT JOIN pair_counts k ON k.campaign_id = c.id AND k.target_id = g.id"""


def with_views(*names: str) -> str:
    """``WITH`` prelude with fixture views plus derived ones (pair_counts, tpl_dim, fact)."""
    derived = {
        "pair_counts": (_counts_sql(), ("event_log",)),
        "tpl_dim": (_tpl_dim_sql(), ("templates",)),
        "fact": (_fact_sql(), ("campaigns", "segments", "targets", "pair_counts", "tpl_dim")),
    }
    order = ["segments", "templates", "targets", "campaigns", "event_log", "raw_event_log", "hits", "users",
             "pair_counts", "tpl_dim", "fact"]
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        need.add(n)
        if n in derived:
            for d in derived[n][1]:
                add(d)
        if n == "campaigns":
            add("segments")
        if n == "raw_event_log":
            add("event_log")

    for n in names:
        add(n)
    parts = []
    for n in order:
        if n in need:
            body = derived[n][0] if n in derived else FIXTURE_SQL[n]
            parts.append(f"{n} AS (\n  {body}\n)")
    return "WITH " + ",\n".join(parts)


def _measures(rep: str = "reported_flag") -> str:
    return (f"CAST(coalesce(sum(delivered), 0) AS BIGINT) AS delivered, "
            f"CAST(coalesce(sum(opened_flag), 0) AS BIGINT) AS opened, "
            f"CAST(coalesce(sum(clicked_flag), 0) AS BIGINT) AS clicked, "
            f"CAST(coalesce(sum({rep}), 0) AS BIGINT) AS reported")


_RATES = (f"{rate_sql('opened', 'delivered')} AS tasa_apertura_pct, "
          f"{rate_sql('clicked', 'delivered')} AS tasa_clic_pct, "
          f"{rate_sql('reported', 'delivered')} AS tasa_reporte_pct")


def _long(names, label: str, value: str, exprs) -> str:
    sel = " UNION ALL ".join(
        f"SELECT '{n.replace(chr(39), chr(39) * 2)}' AS {label}, CAST({e} AS DOUBLE) AS {value} FROM agg"
        for n, e in zip(names, exprs))
    return sel


def _signal_table_sql() -> str:
    blocks = []
    for s in SIGNAL_COLUMNS:
        cols = [f"'{SIGNAL_LABELS[s]}' AS senal"]
        for side, val in (("con", 1), ("sin", 0)):
            cond = f"{s} = {val}"
            cols += [
                f"CAST(count_if({cond}) AS BIGINT) AS observaciones_{side}_senal",
                f"CAST(coalesce(sum(CASE WHEN {cond} THEN delivered END), 0) AS BIGINT) AS delivered_{side}_senal",
                f"CAST(coalesce(sum(CASE WHEN {cond} THEN opened_flag END), 0) AS BIGINT) AS opened_{side}_senal",
                f"CAST(coalesce(sum(CASE WHEN {cond} THEN clicked_flag END), 0) AS BIGINT) AS clicked_{side}_senal",
                f"CAST(coalesce(sum(CASE WHEN {cond} THEN reported_flag END), 0) AS BIGINT) AS reported_{side}_senal",
            ]
        blocks.append("SELECT " + ", ".join(cols) + " FROM fact")
    inner = " UNION ALL ".join(blocks)
    rates = []
    for side in ("con", "sin"):
        rates += [
            f"{rate_sql(f'opened_{side}_senal', f'delivered_{side}_senal')} AS tasa_apertura_{side}_senal_pct",
            f"{rate_sql(f'clicked_{side}_senal', f'delivered_{side}_senal')} AS tasa_clic_{side}_senal_pct",
            f"{rate_sql(f'reported_{side}_senal', f'delivered_{side}_senal')} AS tasa_reporte_{side}_senal_pct",
        ]
    return f"SELECT *, {', '.join(rates)} FROM ({inner}) x"


def _campaign_summary_sql() -> str:
    return (f"SELECT *, {_RATES} FROM (SELECT campaign_id, campaign_status, campaign_channel, "
            f"segment_id, template_id, CAST(count(target_id) AS BIGINT) AS observaciones, {_measures()} "
            f"FROM fact GROUP BY ALL) x")


def _segment_summary_sql() -> str:
    return (f"SELECT *, {_RATES} FROM (SELECT segment_id, age_bracket, gender, education, "
            f"CAST(count(DISTINCT target_id) AS BIGINT) AS targets, {_measures()} FROM fact GROUP BY ALL) x")


def _template_summary_sql() -> str:
    keys = ", ".join(["template_id", "template_name", "template_subject", "template_description",
                      *SIGNAL_COLUMNS])
    return f"SELECT *, {_RATES} FROM (SELECT {keys}, {_measures()} FROM fact GROUP BY ALL) x"


def _global_summary_sql() -> str:
    agg = ("agg AS (SELECT count(*) AS v0, count(DISTINCT campaign_id) AS v1, count(DISTINCT target_id) AS v2, "
           "count(DISTINCT segment_id) AS v3, count(DISTINCT template_id) AS v4, "
           "coalesce(sum(delivered), 0) AS v5, coalesce(sum(opened_flag), 0) AS v6, "
           "coalesce(sum(clicked_flag), 0) AS v7 FROM fact)")
    exprs = ["v0", "v1", "v2", "v3", "v4", "v5", "v6", "v7", rate_sql("v6", "v5"), rate_sql("v7", "v5")]
    return f"{with_views('fact')}, {agg} {_long(GLOBAL_INDICATORS, 'indicator', 'value', exprs)}"


def _general_table_sql() -> str:
    agg = ("agg AS (SELECT count(*) AS v0, count(DISTINCT campaign_id) AS v1, count(DISTINCT target_id) AS v2, "
           "count(DISTINCT segment_id) AS v3, count(DISTINCT template_id) AS v4, "
           "coalesce(sum(delivered), 0) AS v5, coalesce(sum(opened_flag), 0) AS v6, "
           "coalesce(sum(clicked_flag), 0) AS v7, coalesce(sum(reported_flag), 0) AS v8 FROM fact)")
    exprs = ["v0", "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8",
             rate_sql("v6", "v5"), rate_sql("v7", "v5"), rate_sql("v8", "v5")]
    return f"{with_views('fact')}, {agg} {_long(GENERAL_INDICATORS, 'indicador', 'valor', exprs)}"


def _operational_totals_sql() -> str:
    cnt = ", ".join(f"(SELECT CAST(count(*) AS BIGINT) FROM {t}) AS {t}"
                    for t in ("campaigns", "targets", "templates", "segments"))
    ev = ", ".join(f"CAST(count_if(event_type = '{e}') AS BIGINT) AS {e}" for e in EVENT_TYPES)
    return (f"{with_views('campaigns', 'targets', 'templates', 'segments', 'event_log')} "
            f"SELECT {cnt}, CAST(count(*) AS BIGINT) AS events, {ev}, "
            f"{rate_sql(f'count_if(event_type = {chr(39)}opened{chr(39)})', f'count_if(event_type = {chr(39)}delivered{chr(39)})')} AS open_rate, "
            f"{rate_sql(f'count_if(event_type = {chr(39)}clicked{chr(39)})', f'count_if(event_type = {chr(39)}delivered{chr(39)})')} AS click_rate, "
            f"{rate_sql(f'count_if(event_type = {chr(39)}reported{chr(39)})', f'count_if(event_type = {chr(39)}delivered{chr(39)})')} AS report_rate "
            f"FROM event_log")


def _top_findings_sql() -> str:
    gen = ("g AS (SELECT coalesce(sum(delivered), 0) AS d, coalesce(sum(opened_flag), 0) AS o, "
           "coalesce(sum(clicked_flag), 0) AS c, coalesce(sum(reported_flag), 0) AS r FROM fact)")
    cs = f"cs AS ({_campaign_summary_sql()})"
    ss = f"ss AS ({_segment_summary_sql()})"
    order = " ".join(f"WHEN '{SIGNAL_LABELS[s]}' THEN {i + 1}" for i, s in enumerate(SIGNAL_COLUMNS))
    st = f"st AS (SELECT *, CASE senal {order} END AS ord FROM ({_signal_table_sql()}) y)"
    return f"""{with_views('fact')}, {gen}, {cs}, {ss}, {st}
SELECT 'global' AS finding, CAST(NULL AS VARCHAR) AS item, {rate_sql('o', 'd')} AS open_rate_pct,
       {rate_sql('c', 'd')} AS click_rate_pct, {rate_sql('r', 'd')} AS report_rate_pct FROM g
UNION ALL
SELECT * FROM (SELECT 'campaign', CAST(campaign_id AS VARCHAR), tasa_apertura_pct, tasa_clic_pct, tasa_reporte_pct
  FROM cs ORDER BY tasa_clic_pct DESC, campaign_id ASC LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'segment', CAST(segment_id AS VARCHAR), tasa_apertura_pct, tasa_clic_pct, tasa_reporte_pct
  FROM ss ORDER BY tasa_clic_pct DESC, segment_id ASC LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'signal', senal, tasa_apertura_con_senal_pct, tasa_clic_con_senal_pct,
  tasa_reporte_con_senal_pct FROM st ORDER BY tasa_clic_con_senal_pct DESC, ord ASC LIMIT 1)"""


def _base_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["event_counts"] = f"{with_views('pair_counts')} SELECT * FROM pair_counts"
    q["interaction_fact"] = f"{with_views('fact')} SELECT * FROM fact"
    q["campaign_summary"] = f"{with_views('fact')} {_campaign_summary_sql()}"
    q["campaign_summary_fact"] = q["campaign_summary"]
    sig = ", ".join(f"CAST(coalesce(t.{c}, 0) AS INTEGER) AS {c}" for c in SIGNAL_COLUMNS)
    q["signal_flags"] = (f"{with_views('campaigns', 'tpl_dim')} SELECT c.id AS campaign_id, t.template_id, "
                         f"{sig} FROM campaigns c LEFT JOIN tpl_dim t ON c.template_id = t.template_id")
    q["segment_summary"] = f"{with_views('fact')} {_segment_summary_sql()}"
    q["template_summary"] = f"{with_views('fact')} {_template_summary_sql()}"
    q["signal_summary"] = f"{with_views('fact')} {_signal_table_sql()}"
    q["global_summary"] = _global_summary_sql()
    q["general_table"] = _general_table_sql()
    q["global_summary_fact"] = q["global_summary_bitmap"] = q["global_summary"]
    q["segment_summary_fact"] = q["segment_summary"]
    q["template_summary_fact"] = q["template_summary"]
    q["signal_summary_fact"] = q["signal_summary"]
    q["general_table_fact"] = q["general_table_bitmap"] = q["general_table"]
    q["operational_totals"] = _operational_totals_sql()
    q["label_distribution"] = (f"{with_views('fact')} SELECT clicked_flag, CAST(count(*) AS BIGINT) AS count "
                               f"FROM fact GROUP BY clicked_flag")
    q["targets_per_segment"] = (f"{with_views('targets')} SELECT segment_id, CAST(count(*) AS BIGINT) AS targets "
                                f"FROM targets GROUP BY segment_id")
    q["campaign_context"] = (
        f"{with_views('fact')} SELECT CASE WHEN n = 0 THEN 'no-campaigns' "
        f"WHEN n = 1 THEN 'campaign-' || CAST(lo AS VARCHAR) "
        f"ELSE 'campaigns-' || CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) || '-n' || CAST(n AS VARCHAR) END "
        f"AS campaign_context, CAST(n AS BIGINT) AS campaigns FROM (SELECT min(campaign_id) AS lo, "
        f"max(campaign_id) AS hi, count(DISTINCT campaign_id) AS n FROM fact) x")
    q["top_findings"] = _top_findings_sql()
    q["top_findings_fact"] = q["top_findings"]
    return q


# ---- attribution, quality, text -----------------------------------------------------------
from lureline.functions.expressions import _WS_CLASS, html_to_text_sql, strip_ws_sql  # noqa: E402
from lureline.operators.attribution import attribute_hits_sql  # noqa: E402
from lureline.operators.quality import (  # noqa: E402
    MSG_BODY, MSG_MISSING, MSG_RECOMMENDED, MSG_SUBJECT,
)
from lureline.constants import RECOMMENDED_PLACEHOLDERS, REQUIRED_PLACEHOLDERS  # noqa: E402

PARSED_HITS_SQL = """SELECT hit_id, regexp_extract(url, '[?&]uid=([^&#]*)', 1) AS uid,
    CASE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)
      WHEN '/open.gif' THEN 'opened' WHEN '/r' THEN 'clicked' WHEN '/report' THEN 'reported' END AS event_type,
    ts FROM hits"""


def _blank_sql(c: str) -> str:
    return f"({c} IS NULL OR length(regexp_replace({c}, '{_WS_CLASS}', '', 'g')) = 0)"


def _validation_sql() -> str:
    body = "coalesce(html_body, '')"
    errs = [f"CASE WHEN {_blank_sql('html_body')} THEN '{MSG_BODY}' END",
            f"CASE WHEN {_blank_sql('subject')} THEN '{MSG_SUBJECT}' END"]
    errs += [f"CASE WHEN NOT contains({body}, '{p}') THEN '{MSG_MISSING}{p}' END" for p in REQUIRED_PLACEHOLDERS]
    warns = [f"CASE WHEN NOT contains({body}, '{p}') THEN '{MSG_RECOMMENDED}{p}' END" for p in RECOMMENDED_PLACEHOLDERS]
    n = " + ".join(f"CAST(({e}) IS NOT NULL AS INTEGER)" for e in errs)
    return (f"SELECT id AS template_id, ({n}) = 0 AS valid, CAST({n} AS INTEGER) AS n_errors, "
            f"concat_ws('; ', {', '.join(errs)}) AS errors, concat_ws('; ', {', '.join(warns)}) AS warnings "
            f"FROM (SELECT page_id AS id, html || CASE page_id % 3 WHEN 0 THEN '{' '.join(REQUIRED_PLACEHOLDERS + RECOMMENDED_PLACEHOLDERS)}' "
            f"WHEN 1 THEN '{' '.join(REQUIRED_PLACEHOLDERS)}' ELSE '' END AS html_body, "
            f"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS subject FROM pages) p")


def _extra_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["parse_hits"] = f"{with_views('hits')} {PARSED_HITS_SQL}"
    q["unknown_uid_hits"] = (f"{with_views('hits', 'targets')}, parsed AS ({PARSED_HITS_SQL}) "
                             f"SELECT * FROM parsed p WHERE NOT EXISTS "
                             f"(SELECT 1 FROM targets t WHERE t.uid IS NOT NULL AND t.uid = p.uid)")
    q["attribute_hits"] = (
        f"{with_views('hits', 'targets', 'event_log')}, parsed AS ({PARSED_HITS_SQL}), "
        f"resolved AS (SELECT p.uid, p.hit_id, p.event_type, p.ts, t.id AS target_id FROM parsed p "
        f"JOIN targets t ON t.uid = p.uid WHERE p.event_type IS NOT NULL) "
        f"{attribute_hits_sql('resolved', 'event_log')}")
    q["template_validation"] = _validation_sql()
    q["unique_violations"] = f"""{with_views('users', 'targets')}
SELECT 'users' AS table_name, 'username' AS column_name, CAST(username AS VARCHAR) AS value,
       CAST(count(*) AS BIGINT) AS occurrences FROM users WHERE username IS NOT NULL GROUP BY username HAVING count(*) > 1
UNION ALL
SELECT 'users', 'email', CAST(email AS VARCHAR), CAST(count(*) AS BIGINT) FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
UNION ALL
SELECT 'targets', 'uid', CAST(uid AS VARCHAR), CAST(count(*) AS BIGINT) FROM targets WHERE uid IS NOT NULL GROUP BY uid HAVING count(*) > 1"""
    checks = [("targets", ["segment_id", "recipient", "uid"]),
              ("campaigns", ["channel", "status", "template_id", "segment_id", "launched_at"]),
              ("event_log", ["campaign_id", "target_id", "template_id", "event_type", "occurred_at"])]
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM {t.replace('event_log', 'raw_event_log')}"
             for t, cols in checks for c in cols]
    q["null_violations"] = f"{with_views('targets', 'campaigns', 'raw_event_log')} " + " UNION ALL ".join(parts)
    fks = [("campaigns.template_id", "campaigns", "id", "template_id", "templates", "id"),
           ("campaigns.segment_id", "campaigns", "id", "segment_id", "segments", "id"),
           ("targets.segment_id", "targets", "id", "segment_id", "segments", "id"),
           ("event_log.campaign_id", "event_log", "id", "campaign_id", "campaigns", "id"),
           ("event_log.target_id", "event_log", "id", "target_id", "targets", "id"),
           ("event_log.template_id", "event_log", "id", "template_id", "templates", "id")]
    parts = [f"SELECT '{r}' AS relation, CAST(c.{i} AS BIGINT) AS child_id, CAST(c.{fk} AS BIGINT) AS missing_key "
             f"FROM {'raw_event_log' if ch == 'event_log' else ch} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pa} p WHERE p.{pk} = c.{fk})"
             for r, ch, i, fk, pa, pk in fks]
    q["fk_violations"] = (f"{with_views('campaigns', 'templates', 'segments', 'targets', 'raw_event_log')} "
                          + " UNION ALL ".join(parts))
    q["cascade_delete"] = f"""{with_views('segments', 'targets', 'campaigns', 'raw_event_log')},
gone AS (SELECT id FROM segments WHERE gender = 'N/A')
SELECT id, campaign_id, target_id, event_type FROM raw_event_log
WHERE campaign_id NOT IN (SELECT id FROM campaigns WHERE segment_id IN (SELECT id FROM gone))
  AND target_id NOT IN (SELECT id FROM targets WHERE segment_id IN (SELECT id FROM gone))"""
    q["sanitize_name"] = ("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(CAST(p_name AS VARCHAR))), "
                          "'[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe_name FROM part")
    q["html_to_text"] = f"SELECT page_id, {html_to_text_sql('html')} AS text FROM pages"
    html = html_to_text_sql("t.html_body")
    q["text_fact"] = f"""{with_views('campaigns', 'templates', 'segments', 'targets', 'pair_counts')}
SELECT c.id AS campaign_id, s.id AS segment_id, g.id AS target_id, t.id AS template_id,
  CASE WHEN t.id IS NULL THEN '' ELSE t.subject END AS template_subject,
  CASE WHEN t.id IS NULL THEN '' ELSE t.description END AS template_description,
  CASE WHEN t.id IS NULL THEN '' ELSE {html} END AS template_html_text,
  {strip_ws_sql("concat_ws(' [SEP] ', coalesce(t.subject, ''), coalesce(t.description, ''), CASE WHEN t.id IS NULL THEN '' ELSE " + html + " END)")} AS text_input,
  CAST(coalesce(k.clicked, 0) > 0 AS INTEGER) AS clicked_flag
FROM campaigns c LEFT JOIN templates t ON c.template_id = t.id LEFT JOIN segments s ON c.segment_id = s.id
JOIN targets g ON g.segment_id = c.segment_id
LEFT JOIN pair_counts k ON k.campaign_id = c.id AND k.target_id = g.id"""
    return q


# ---- synthetic cohorts, contrasts, design ---------------------------------------------------
from lureline import constants as K  # noqa: E402
from lureline.functions.expressions import keyed_uniform_sql  # noqa: E402


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _lookup_sql(col: str, table: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {_d(v)}" for k, v in table.items())
    return f"(CASE {whens} ELSE {_d(0.0)} END)"


def _sig(c: str) -> str:
    return f"CAST(coalesce({c}, 0) AS DOUBLE)"


def _open_score_sql() -> str:
    s = (f"(({_d(K.OPEN_INTERCEPT)} + {_lookup_sql('age_bracket', K.AGE_EFFECT)}) + "
         f"{_lookup_sql('education', K.EDUCATION_EFFECT)} * {_d(K.OPEN_EDUCATION_SCALE)})")
    s = f"({s} + {_lookup_sql('gender', K.GENDER_EFFECT)})"
    for c, w in K.OPEN_SIGNAL_WEIGHTS.items():
        s = f"({s} + {_d(w)} * {_sig(c)})"
    return s


def _click_score_sql() -> str:
    s = (f"(({_d(K.CLICK_INTERCEPT)} + {_lookup_sql('age_bracket', K.AGE_EFFECT)} * {_d(K.CLICK_AGE_SCALE)}) + "
         f"{_lookup_sql('education', K.EDUCATION_EFFECT)})")
    s = f"({s} + {_lookup_sql('gender', K.GENDER_EFFECT)})"
    for c, w in K.CLICK_SIGNAL_WEIGHTS.items():
        s = f"({s} + {_d(w)} * {_sig(c)})"
    bonus = (f"CASE WHEN signal_urgency = 1 AND signal_authority = 1 "
             f"THEN {_d(K.CLICK_URGENCY_AUTHORITY_BONUS)} ELSE {_d(0.0)} END")
    return f"({s} + {bonus})"


def _prob_sql(score: str, lo: float, hi: float) -> str:
    sig = f"({_d(1.0)} / ({_d(1.0)} + exp(-({score}))))"
    return f"round_even(least(greatest({sig}, {_d(lo)}), {_d(hi)}), 10)"


PROBS_SQL = (f"{_prob_sql(_open_score_sql(), *K.OPEN_CLAMP)} AS open_probability, "
             f"{_prob_sql(_click_score_sql(), *K.CLICK_CLAMP)} AS click_probability")


def _scenario_p_sql() -> tuple[str, str]:
    e = "coalesce(segment_id = 1, false)"
    p = "coalesce(signal_personalization = 1, false)"
    po = (f"CASE scenario WHEN 'control' THEN {_d(K.CONTROL_P[0])} "
          f"WHEN 'personalization' THEN CASE WHEN {p} THEN {_d(K.PERSONALIZATION_P_OPEN['personalized'])} "
          f"ELSE {_d(K.PERSONALIZATION_P_OPEN['other'])} END "
          f"WHEN 'segment' THEN {_d(K.SEGMENT_P_OPEN)} "
          f"WHEN 'interaction' THEN CASE WHEN {e} AND {p} THEN {_d(K.INTERACTION_P_OPEN['experimental_personalized'])} "
          f"WHEN {p} THEN {_d(K.INTERACTION_P_OPEN['personalized'])} WHEN {e} THEN {_d(K.INTERACTION_P_OPEN['experimental'])} "
          f"ELSE {_d(K.INTERACTION_P_OPEN['other'])} END END")
    pc = (f"CASE scenario WHEN 'control' THEN {_d(K.CONTROL_P[1])} "
          f"WHEN 'personalization' THEN {_d(K.PERSONALIZATION_P_CLICK)} "
          f"WHEN 'segment' THEN CASE WHEN {e} THEN {_d(K.SEGMENT_P_CLICK['experimental'])} "
          f"ELSE {_d(K.SEGMENT_P_CLICK['other'])} END "
          f"WHEN 'interaction' THEN {_d(K.INTERACTION_P_CLICK)} END")
    return po, pc


def _cohort_sql(seed: int = 42) -> str:
    po, pc = _scenario_p_sql()
    scen = ", ".join(f"('{s}')" for s in K.SCENARIOS)
    uo = keyed_uniform_sql(seed, "scenario", "campaign_id", "target_id", "'open'")
    uc = keyed_uniform_sql(seed, "scenario", "campaign_id", "target_id", "'click'")
    return f"""cohort AS (
  SELECT *, CAST(u_open < p_open AS INTEGER) AS opened_flag,
         CAST(CASE WHEN u_open < p_open THEN u_click < p_click ELSE false END AS INTEGER) AS clicked_flag
  FROM (SELECT f.* EXCLUDE (delivered, opened, clicked, reported, opened_flag, clicked_flag, reported_flag), sc.scenario, {po} AS p_open, {pc} AS p_click, {uo} AS u_open, {uc} AS u_click,
               CAST(coalesce(f.segment_id = 1, false) AS INTEGER) AS experimental_target_segment
        FROM fact f, (VALUES {scen}) sc(scenario)) x)"""


def _validation_rows_sql() -> str:
    def rate(cond: str, flag: str) -> str:
        return (f"CASE WHEN count_if({cond}) = 0 THEN {_d(0.0)} ELSE "
                f"CAST(coalesce(sum(CASE WHEN {cond} THEN {flag} END), 0) AS DOUBLE) / "
                f"CAST(count_if({cond}) AS DOUBLE) * 100.0 END")
    pers, nop = "signal_personalization = 1", "signal_personalization = 0"
    ex, ot = "experimental_target_segment = 1", "experimental_target_segment = 0"
    agg = (f"agg AS (SELECT scenario, {rate(pers, 'opened_flag')} AS ow, {rate(nop, 'opened_flag')} AS onw, "
           f"{rate(ex, 'clicked_flag')} AS ce, {rate(ot, 'clicked_flag')} AS co, "
           f"{rate(f'{ex} AND {pers}', 'opened_flag')} AS tp, {rate(f'{ex} AND {nop}', 'opened_flag')} AS tn, "
           f"{rate(f'{ot} AND {pers}', 'opened_flag')} AS op, {rate(f'{ot} AND {nop}', 'opened_flag')} AS onn "
           f"FROM cohort GROUP BY scenario)")
    a = "CASE WHEN scenario IN ('control', 'personalization') THEN ow WHEN scenario = 'segment' THEN ce ELSE tp - tn END"
    b = "CASE WHEN scenario IN ('control', 'personalization') THEN onw WHEN scenario = 'segment' THEN co ELSE op - onn END"

    def label(i: int) -> str:
        return "CASE scenario " + " ".join(f"WHEN '{s}' THEN '{row[i]}'" for s, row in K.SCENARIO_ROWS.items()) + " END"
    return (f"{agg} SELECT {label(0)} AS scenario, {label(1)} AS comparison, {label(2)} AS group_a, "
            f"round_even({a}, 2) AS group_a_rate_pct, {label(3)} AS group_b, round_even({b}, 2) AS group_b_rate_pct, "
            f"round_even(({a}) - ({b}), 2) AS difference_pp, {label(4)} AS expected_pattern FROM agg")


EMAIL_TPL = "SELECT * FROM tpl_dim WHERE template_id IN (SELECT id FROM templates WHERE channel = 'email')"


def _population_sql(cpt: int = 10, seed: int = 42) -> str:
    useg = keyed_uniform_sql(seed, "'segment'", "t.template_id", "r.range")
    uo = keyed_uniform_sql(seed, "campaign_id", "target_id", "'open'")
    uc = keyed_uniform_sql(seed, "campaign_id", "target_id", "'click'")
    sig = ", ".join(K.SIGNAL_COLUMNS)
    return f"""seg_rank AS (SELECT row_number() OVER (ORDER BY id) AS rnk, id AS segment_id, age_bracket, gender, education FROM segments),
camp AS (SELECT t.*, r.range AS repetition, CAST((t.template_id - 1) * {cpt} + r.range AS BIGINT) AS campaign_id,
                CAST(floor({useg} * (SELECT count(*) FROM segments)) + 1 AS INTEGER) AS rnk
         FROM ({EMAIL_TPL}) t, range(1, {cpt + 1}) r),
pop_rows AS (SELECT g.id AS target_id, g.recipient AS target_recipient, g.uid AS target_uid, c.*, s.segment_id, s.age_bracket, s.gender, s.education
         FROM targets g JOIN (camp c JOIN seg_rank s ON c.rnk = s.rnk) ON g.segment_id = s.segment_id),
pop_p AS (SELECT *, {PROBS_SQL} FROM pop_rows),
pop_d AS (SELECT *, CAST({uo} < open_probability AS INTEGER) AS o,
          CAST(CASE WHEN {uo} < open_probability THEN {uc} < click_probability ELSE false END AS INTEGER) AS c FROM pop_p),
population AS (SELECT 'synthetic' AS source, campaign_id, 'launched' AS campaign_status, 'email' AS campaign_channel,
    CAST(NULL AS TIMESTAMP) AS campaign_launched_at, template_id, template_name, template_subject, template_description,
    {sig}, segment_id, age_bracket, gender, education, target_id, target_recipient, target_uid,
    CAST(1 AS BIGINT) AS delivered, CAST(o AS BIGINT) AS opened, CAST(c AS BIGINT) AS clicked, CAST(0 AS BIGINT) AS reported,
    o AS opened_flag, c AS clicked_flag, 0 AS reported_flag FROM pop_d)"""


def _plan_sql(cpt: int = 2, seed: int = 42) -> str:
    return f"""cnt AS (SELECT segment_id AS id, CAST(count(*) AS BIGINT) AS segment_target_count FROM targets GROUP BY segment_id),
eligible AS (SELECT s.*, c.segment_target_count FROM segments s JOIN cnt c ON s.id = c.id),
slots AS (SELECT t.*, CAST(r.range AS INTEGER) AS repetition,
                 row_number() OVER (ORDER BY t.template_id, r.range) - 1 AS slot
          FROM ({EMAIL_TPL}) t, range(1, {cpt + 1}) r),
slots2 AS (SELECT *, CAST(floor(slot / (SELECT count(*) FROM eligible)) AS INTEGER) AS blk,
                  CAST(slot % (SELECT count(*) FROM eligible) AS INTEGER) AS pos FROM slots),
blocks AS (SELECT DISTINCT blk FROM slots2),
perm AS (SELECT e.*, b.blk, CAST(row_number() OVER (PARTITION BY b.blk ORDER BY
             md5('{seed}|' || CAST(b.blk AS VARCHAR) || '|' || CAST(e.id AS VARCHAR)), e.id) - 1 AS INTEGER) AS pos
         FROM eligible e, blocks b),
plan0 AS (SELECT CAST(s.slot + 1 AS BIGINT) AS assignment_id, s.template_id, s.template_name, s.template_subject,
            s.signal_urgency, s.signal_authority, s.signal_reward, s.signal_personalization,
            p.id AS segment_id, p.age_bracket, p.gender, p.education, p.segment_target_count,
            'email' AS campaign_channel, s.repetition, {seed} AS random_seed, 'planned' AS status
          FROM slots2 s JOIN perm p ON s.blk = p.blk AND s.pos = p.pos),
plan AS (SELECT *, CAST(row_number() OVER (ORDER BY md5('{seed}|' || CAST(assignment_id AS VARCHAR)), assignment_id) AS BIGINT)
           AS execution_order FROM plan0)"""


def _valid_templates_sql() -> str:
    body = "coalesce(html_body, '')"
    conds = [f"NOT {_blank_sql('html_body')}", f"NOT {_blank_sql('subject')}"]
    conds += [f"contains({body}, '{p}')" for p in REQUIRED_PLACEHOLDERS]
    return f"SELECT id FROM templates WHERE {' AND '.join(conds)}"


def _contrast_sql() -> dict[str, str]:
    inside = "coalesce(segment_id = 1, false)"

    def rate(cond: str, flag: str) -> str:
        return (f"(SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(sum({flag}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 END "
                f"FROM fact WHERE {cond})")

    def row(kind: str, item: str, a: str, b: str) -> str:
        return (f"SELECT '{kind}' AS contrast, '{item}' AS item, round_even({a}, 2) AS group_a_rate_pct, "
                f"round_even({b}, 2) AS group_b_rate_pct, round_even(({a}) - ({b}), 2) AS difference_pp")

    pre = with_views("fact")
    signal, did = [], []
    for s in K.SIGNAL_COLUMNS:
        signal.append(row("signal", s, rate(f"{s} = 1", "opened_flag"), rate(f"{s} = 0", "opened_flag")))
        parts = [f"{rate(f'{side} AND {s} = 1', 'opened_flag')} - {rate(f'{side} AND {s} = 0', 'opened_flag')}"
                 for side in (inside, f"NOT {inside}")]
        did.append(row("interaction", s, *parts))
    segment = row("segment", "segment", rate(inside, "clicked_flag"), rate(f"NOT {inside}", "clicked_flag"))
    every = " UNION ALL ".join([segment, *signal, *did])
    return {"observed_validation": f"""{pre} SELECT *,
  CASE contrast WHEN 'signal' THEN 'higher with the signal' WHEN 'interaction' THEN 'none' END AS expected_pattern,
  CASE contrast WHEN 'signal' THEN difference_pp > 0 WHEN 'interaction' THEN abs(difference_pp) < 5.0 END AS as_expected
  FROM ({every}) x""",
            "contrast_signal": f"{pre} " + " UNION ALL ".join(signal),
            "contrast_segment": f"{pre} " + row("segment", "segment", rate(inside, "clicked_flag"),
                                                rate(f"NOT {inside}", "clicked_flag")),
            "did_interaction": f"{pre} " + " UNION ALL ".join(did)}


def _synthetic_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    cols = ", ".join(["campaign_id", "target_id", "age_bracket", "gender", "education", *K.SIGNAL_COLUMNS])
    q["score_probabilities"] = f"{with_views('fact')} SELECT {cols}, {PROBS_SQL} FROM fact"
    q["scenario_cohort"] = (
        f"{with_views('fact')}, {_cohort_sql()} SELECT 'synthetic_scenario' AS source, scenario, 42 AS scenario_seed, "
        f"campaign_id, target_id, template_id, segment_id, signal_personalization, experimental_target_segment, "
        f"CAST(1 AS BIGINT) AS delivered, opened_flag, clicked_flag, 0 AS reported_flag, "
        f"p_open AS expected_open_probability, p_click AS expected_click_given_open_probability FROM cohort")
    val = f"{with_views('fact')}, {_cohort_sql()}, v AS ({_validation_rows_sql().replace('agg AS', 'WITH agg AS', 1)})"
    q["scenario_validation"] = f"{val} SELECT * FROM v"
    q |= _contrast_sql()
    pop = f"{with_views('fact', 'templates')}, {_population_sql()}"
    q["synthetic_population"] = f"{pop} SELECT * FROM population"
    q["source_distribution"] = (f"{pop} SELECT source, CAST(count(*) AS BIGINT) AS count FROM "
                                f"(SELECT source FROM fact UNION ALL SELECT source FROM population) x GROUP BY source")
    q["combined_dataset"] = f"{pop} SELECT * FROM fact UNION ALL SELECT * FROM population"
    plan = f"{with_views('segments', 'targets', 'tpl_dim', 'templates', 'campaigns')}, {_plan_sql()}"
    q["sampling_plan"] = f"{plan} SELECT * FROM plan"
    q["plan_balance"] = (f"{plan} SELECT segment_id, assignments, (max(assignments) OVER () - min(assignments) OVER ()) <= 1 "
                         f"AS balanced FROM (SELECT segment_id, CAST(count(*) AS BIGINT) AS assignments FROM plan GROUP BY segment_id) x")
    q["materialize_plan"] = (
        f"{plan}, firstn AS (SELECT * FROM plan ORDER BY execution_order LIMIT 12), "
        f"kept AS (SELECT * FROM firstn WHERE template_id IN (SELECT id FROM templates) AND segment_id IN (SELECT id FROM segments)) "
        f"SELECT assignment_id, CAST((SELECT coalesce(max(id), 0) FROM campaigns) + row_number() OVER (ORDER BY execution_order) AS BIGINT) "
        f"AS campaign_id, CAST(template_id AS BIGINT) AS template_id, CAST(segment_id AS BIGINT) AS segment_id, "
        f"execution_order, 'created' AS status FROM kept")
    q["draft_campaigns"] = (
        f"SELECT campaign_id AS id, 'email' AS channel, CAST(NULL AS TIMESTAMP) AS launched_at, 'draft' AS status, "
        f"template_id, segment_id FROM ({q['materialize_plan']}) m")
    q["assigned_uids"] = (
        f"{with_views('targets')} SELECT id, segment_id, CASE WHEN id % 7 = 0 OR uid IS NULL THEN "
        f"md5('uid|' || CAST(id AS VARCHAR)) ELSE uid END AS uid FROM targets")
    odds = " UNION ALL ".join(
        f"SELECT '{s}' AS term, round_even(ln((count_if({s} = 1 AND clicked_flag = 1) + 0.5) * (count_if({s} = 0 AND clicked_flag = 0) + 0.5) "
        f"/ ((count_if({s} = 1 AND clicked_flag = 0) + 0.5) * (count_if({s} = 0 AND clicked_flag = 1) + 0.5))), 8) AS log_odds FROM fact"
        for s in K.SIGNAL_COLUMNS)
    terms = (f"{with_views('fact')}, odds AS (SELECT term, log_odds, abs(log_odds) AS abs_log_odds, "
             f"round_even(exp(log_odds), 8) AS odds_ratio FROM ({odds}) x)")
    q["signal_odds"] = f"{terms} SELECT * FROM odds"
    q["top_terms"] = f"{terms} SELECT * FROM odds ORDER BY abs_log_odds DESC, term LIMIT 2"
    named = "term, log_odds AS posterior_mean, abs_log_odds, odds_ratio"
    q["extreme_terms"] = (
        f"{terms} SELECT * FROM (SELECT {named}, 'positive' AS direction FROM odds WHERE log_odds > 0 ORDER BY log_odds DESC, term LIMIT 1) a "
        f"UNION ALL SELECT * FROM (SELECT {named}, 'negative' AS direction FROM odds WHERE log_odds < 0 ORDER BY log_odds, term LIMIT 1) b")
    feats = ", ".join(["source", "campaign_id", "target_id", *K.FEATURE_COLUMNS, K.TARGET_COLUMN])
    q["feature_matrix"] = f"{with_views('fact')} SELECT {feats} FROM fact"
    both = " UNION ALL ".join(
        f"SELECT '{m}' AS model, source, campaign_id, target_id, CAST(clicked_flag AS INTEGER) AS y, {c} AS p FROM scored"
        for m, c in (("x8_click", "click_probability"), ("x8_open", "open_probability")))
    q["stacked_predictions"] = f"{with_views('fact')}, scored AS (SELECT *, {PROBS_SQL} FROM fact) {both}"
    q["expand_deliveries"] = (
        f"{with_views('campaigns', 'templates', 'targets')} SELECT c.id AS campaign_id, g.id AS target_id, "
        f"CAST(c.template_id AS BIGINT) AS template_id, 'delivered' AS event_type, "
        f"coalesce(g.uid, md5('uid|' || CAST(g.id AS VARCHAR))) AS uid "
        f"FROM campaigns c JOIN targets g ON g.segment_id = c.segment_id "
        f"WHERE c.status <> 'launched' AND c.template_id IN ({_valid_templates_sql()})")
    return q


# ---- evaluation ---------------------------------------------------------------------------------
def _ev_sql(prob: str = "click_probability") -> str:
    return (f"scored AS (SELECT *, {PROBS_SQL} FROM fact), "
            f"ev AS (SELECT source, campaign_id, target_id, CAST(clicked_flag AS INTEGER) AS y, "
            f"CAST({prob} AS DOUBLE) AS p FROM scored)")


def _metrics_select(ev: str = "ev") -> str:
    def div(a: str, b: str) -> str:
        return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"
    cm = (f"(SELECT CAST(count_if(y <> 1 AND p < 0.2) AS BIGINT) AS tn, CAST(count_if(y <> 1 AND p >= 0.2) AS BIGINT) AS fp, "
          f"CAST(count_if(y = 1 AND p < 0.2) AS BIGINT) AS fn, CAST(count_if(y = 1 AND p >= 0.2) AS BIGINT) AS tp FROM {ev})")
    return (f"SELECT tn + fp + fn + tp AS n_rows, fn + tp AS positives, {div('tp + tn', 'tn + fp + fn + tp')} AS accuracy, "
            f"{div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall, "
            f"{div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM {cm} cm")


def _auc_select(ev: str = "ev") -> str:
    return (f"SELECT CASE WHEN P > 0 AND N > 0 THEN round_even(s / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE)), 12) END AS roc_auc "
            f"FROM (SELECT sum(CAST(pos AS DOUBLE) * CAST(cneg - neg AS DOUBLE) + 0.5 * CAST(pos AS DOUBLE) * CAST(neg AS DOUBLE)) AS s, "
            f"sum(pos) AS P, sum(neg) AS N FROM (SELECT *, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg "
            f"FROM (SELECT p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM {ev} GROUP BY p) a) b) c")


def _brier_select(ev: str = "ev") -> str:
    return f"SELECT round_even(avg(power(p - y, 2)), 10) AS brier_score FROM {ev}"


def _evaluation_sql() -> dict[str, str]:
    pre = f"{with_views('fact')}, {_ev_sql()}"
    q: dict[str, str] = {}
    q["confusion_matrix"] = (f"{pre} SELECT CAST(count_if(y <> 1 AND p < 0.2) AS BIGINT) AS tn, "
                             f"CAST(count_if(y <> 1 AND p >= 0.2) AS BIGINT) AS fp, "
                             f"CAST(count_if(y = 1 AND p < 0.2) AS BIGINT) AS fn, "
                             f"CAST(count_if(y = 1 AND p >= 0.2) AS BIGINT) AS tp FROM ev")
    q["classification_metrics"] = f"{pre} {_metrics_select()}"
    q["roc_auc"] = f"{pre} {_auc_select()}"
    q["brier_score"] = f"{pre} {_brier_select()}"
    qs = ", ".join(repr(k / 10) for k in range(11))
    q["calibration_curve"] = f"""{pre}, edges AS (SELECT quantile_cont(p, [{qs}]) AS e FROM ev),
binned AS (SELECT ev.*, len(list_filter(edges.e[2:10], lambda x: x < ev.p)) AS b FROM ev, edges)
SELECT CAST(row_number() OVER (ORDER BY b) AS INTEGER) AS bin,
       round_even(sum(p) / count(*), 10) AS predicted_probability_mean,
       CAST(sum(y) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS observed_positive_rate
FROM binned GROUP BY b"""
    q["lift_table"] = f"""{pre}, tot AS (SELECT count(*) AS n, sum(y) AS pos FROM ev),
ranked AS (SELECT ev.*, row_number() OVER (ORDER BY p DESC, source, campaign_id, target_id) AS r FROM ev),
bucketed AS (SELECT ranked.*, CAST(CASE WHEN tot.n = 1 THEN 1 ELSE greatest(1, ((r - 1) * least(10, tot.n) + tot.n - 2) // (tot.n - 1)) END AS INTEGER) AS bucket
             FROM ranked, tot),
per AS (SELECT bucket, CAST(count(*) AS BIGINT) AS rows, CAST(sum(y) AS BIGINT) AS positives, min(p) AS min_score,
               max(p) AS max_score, round_even(avg(p), 10) AS avg_score FROM bucketed GROUP BY bucket)
SELECT bucket, rows, positives, min_score, max_score, avg_score,
       CAST(positives AS DOUBLE) / CAST(rows AS DOUBLE) AS positive_rate,
       CASE WHEN tot.pos > 0 THEN (CAST(positives AS DOUBLE) / CAST(rows AS DOUBLE)) / (CAST(tot.pos AS DOUBLE) / CAST(tot.n AS DOUBLE))
            ELSE CAST('NaN' AS DOUBLE) END AS lift,
       CAST(sum(rows) OVER (ORDER BY bucket) AS BIGINT) AS cumulative_rows,
       CAST(sum(positives) OVER (ORDER BY bucket) AS BIGINT) AS cumulative_positives,
       CASE WHEN tot.pos > 0 THEN CAST(sum(positives) OVER (ORDER BY bucket) AS DOUBLE) / CAST(tot.pos AS DOUBLE) ELSE 0.0 END
         AS cumulative_positive_capture_rate
FROM per, tot"""
    runs = []
    for name, prob in (("x8_click", "click_probability"), ("x8_open", "open_probability")):
        ev = f"ev_{name}"
        runs.append((name, ev, f"{ev} AS (SELECT CAST(clicked_flag AS INTEGER) AS y, CAST({prob} AS DOUBLE) AS p "
                               f"FROM scored)"))
    comp_pre = (f"{with_views('fact')}, scored AS (SELECT *, {PROBS_SQL} FROM fact), "
                + ", ".join(r[2] for r in runs))
    comp = " UNION ALL ".join(
        f"SELECT '{name}' AS model, m.*, a.roc_auc, b.brier_score FROM ({_metrics_select(ev)}) m, "
        f"({_auc_select(ev)}) a, ({_brier_select(ev)}) b" for name, ev, _ in runs)
    q["model_comparison"] = f"{comp_pre} {comp}"
    win = []
    for metric, higher in (("accuracy", True), ("precision", True), ("recall", True), ("f1", True),
                           ("roc_auc", True), ("brier_score", False)):
        a = f"max(CASE WHEN model = 'x8_click' THEN {metric} END)"
        b = f"max(CASE WHEN model = 'x8_open' THEN {metric} END)"
        op = ">" if higher else "<"
        win.append(f"SELECT '{metric}' AS metric, CAST({a} AS DOUBLE) AS value_a, CAST({b} AS DOUBLE) AS value_b, "
                   f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} {op} {b} THEN 'x8_click' "
                   f"WHEN {b} {op} {a} THEN 'x8_open' ELSE 'tie' END AS winner, "
                   f"(max(CASE WHEN model = 'x8_click' THEN n_rows END) = max(CASE WHEN model = 'x8_open' THEN n_rows END)) AND "
                   f"(max(CASE WHEN model = 'x8_click' THEN positives END) = max(CASE WHEN model = 'x8_open' THEN positives END)) "
                   f"AS comparable FROM comp")
    q["metric_winners"] = f"{comp_pre}, comp AS ({comp}) " + " UNION ALL ".join(win)
    return q


# ---- dataset preparation ------------------------------------------------------------------------
from lureline.constants import NA_TOKENS  # noqa: E402


def _na_sql(c: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END"


def _prep_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["list_newest"] = f"{with_views('targets')} SELECT id, segment_id, recipient, uid FROM targets ORDER BY id DESC"
    q["lookup_uid"] = (f"{with_views('targets', 'hits')}, parsed AS ({PARSED_HITS_SQL}) "
                       f"SELECT id, uid, segment_id FROM targets WHERE uid IN (SELECT uid FROM parsed)")
    lab = ("CASE lower(trim(CAST(quality AS VARCHAR))) WHEN 'true' THEN 1 WHEN 'false' THEN 0 WHEN 'yes' THEN 1 "
           "WHEN 'no' THEN 0 WHEN 'sí' THEN 1 WHEN 'si' THEN 1 WHEN '1' THEN 1 WHEN '0' THEN 0 END")
    q["label_normalize"] = (f"SELECT * FROM (SELECT doc_id, CAST({lab} AS INTEGER) AS quality, "
                            f"CAST(TRY_CAST(CAST(toxic AS VARCHAR) AS DOUBLE) AS INTEGER) AS toxic FROM labels) x "
                            f"WHERE quality IS NOT NULL AND toxic IS NOT NULL")
    cols = ("age_bracket", "gender", "education", "template_subject", "template_description", "target_uid")
    na = ", ".join(f"{_na_sql(c)} AS {c}" for c in cols)
    q["na_tokens"] = f"{with_views('fact')} SELECT campaign_id, target_id, {na} FROM fact"
    clean = ", ".join(f"coalesce({_na_sql(c)}, 'unknown') AS {c}" if c in ("age_bracket", "gender", "education", "template_subject")
                      else f"{_na_sql(c)} AS {c}" for c in cols)
    q["clean_dataset"] = f"{with_views('fact')} SELECT campaign_id, target_id, {clean} FROM fact"
    sig = ", ".join(f"coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0) AS {c}" for c in SIGNAL_COLUMNS)
    dem = ", ".join(f"trim(coalesce({_na_sql(c)}, 'unknown')) AS {c}" for c in ("age_bracket", "gender", "education"))
    q["clean_strict"] = f"{with_views('fact')} SELECT campaign_id, target_id, {sig}, {dem} FROM fact"
    return q


def oracle_sql() -> dict[str, str]:
    q = _base_sql()
    q.update(_extra_sql())
    q.update(_synthetic_sql())
    q.update(_evaluation_sql())
    q.update(_prep_sql())
    return q


# ---- model preparation --------------------------------------------------------------------------
OBSERVED_SOURCES = ("SELECT * REPLACE (CASE WHEN campaign_id % 2 = 0 THEN 'observed_a' ELSE 'observed_b' END AS source) "
                    "FROM fact")


COMBINED = "SELECT * FROM fact UNION ALL SELECT * FROM population"


def _comb_sql(rows: str) -> str:
    return f"comb AS (SELECT * EXCLUDE (gender), {_na_sql('gender')} AS gender FROM ({rows}) z)"


def _split_sql(rows: str, test_size: float = 0.3, seed: int = 42) -> str:
    u = keyed_uniform_sql(seed, "source", "campaign_id", "target_id")
    return f"""{_comb_sql(rows)},
hashed AS (SELECT *, {u} AS h FROM comb),
split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY clicked_flag ORDER BY h, source, campaign_id, target_id)
                 <= round_even(CAST({test_size!r} AS DOUBLE) * count(*) OVER (PARTITION BY clicked_flag), 0)
                 THEN 'test' ELSE 'train' END AS split FROM hashed)"""


def _boost_sql(pre: str) -> dict[str, str]:
    """The first tree's root: sampled rows, a bin per signal and per level, sums at margin 0."""
    tr = f"""tr AS (SELECT {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in SIGNAL_COLUMNS)},
  {', '.join(f"coalesce({_na_sql(c)}, 'unknown') AS {c}" for c in DEMOGRAPHIC_COLUMNS)}, clicked_flag,
  {keyed_uniform_sql('42-rows-0', 'source', 'campaign_id', 'target_id')} < 0.8 AS chosen
  FROM split WHERE split = 'train'),
spw AS (SELECT CAST(count_if(clicked_flag = 0) AS DOUBLE) / CAST(count_if(clicked_flag = 1) AS DOUBLE) AS w FROM tr)"""
    parts = [f"SELECT '{c}' AS feature, {c} AS bin, clicked_flag AS y FROM tr WHERE chosen" for c in SIGNAL_COLUMNS]
    parts += [f"SELECT '{c}=' || l.v AS feature, CAST(tr.{c} = l.v AS INTEGER) AS bin, clicked_flag AS y "
              f"FROM tr, (SELECT DISTINCT {c} AS v FROM tr) l WHERE chosen" for c in DEMOGRAPHIC_COLUMNS]
    hist = f"""hist AS (SELECT feature, bin, CAST(count(*) AS BIGINT) AS n,
  round(sum(CASE WHEN y = 1 THEN -0.5 * w ELSE 0.5 END), 6) AS gradient,
  round(sum(CASE WHEN y = 1 THEN 0.25 * w ELSE 0.25 END), 6) AS hessian
  FROM ({' UNION ALL '.join(parts)}) z, spw GROUP BY feature, bin)"""
    power = lambda g, h: f"(power(greatest(abs({g}) - 0.5, 0.0), 2) / ({h} + 2.0))"
    splits = f"""sums AS (SELECT feature, bin, sum(gradient) OVER (PARTITION BY feature ORDER BY bin) AS gl,
  sum(hessian) OVER (PARTITION BY feature ORDER BY bin) AS hl, sum(gradient) OVER (PARTITION BY feature) AS g,
  sum(hessian) OVER (PARTITION BY feature) AS h FROM hist)
SELECT feature, bin, round({power('gl', 'hl')} + {power('(g - gl)', '(h - hl)')} - {power('g', 'h')}, 4) AS gain
FROM sums WHERE hl >= 2.0 AND h - hl >= 2.0"""
    return {"boost_histogram": f"{pre}, {tr}, {hist} SELECT * FROM hist",
            "boost_root_splits": f"{pre}, {tr}, {hist}, {splits}"}


def _model_prep_sql() -> dict[str, str]:
    pre = f"{with_views('fact', 'templates')}, {_population_sql()}, {_split_sql(COMBINED)}"
    q: dict[str, str] = {}
    q["combined_observed"] = f"{with_views('fact')} {OBSERVED_SOURCES}"
    q["observed_source_distribution"] = (f"{with_views('fact')} SELECT source, CAST(count(*) AS BIGINT) AS count "
                                         f"FROM ({OBSERVED_SOURCES}) x GROUP BY source")
    q.update(_boost_sql(f"{with_views('fact', 'templates')}, {_split_sql(OBSERVED_SOURCES)}"))
    q["test_rows_by_source"] = (f"{pre} SELECT source, CAST(count(*) AS BIGINT) AS count FROM split "
                                f"WHERE split = 'test' GROUP BY source")
    q["scored_keys"] = (f"{pre} SELECT source, campaign_id, target_id, CAST(clicked_flag AS INTEGER) AS y "
                        f"FROM split WHERE split = 'test'")
    q["stratified_split"] = f"{pre} SELECT source, campaign_id, target_id, clicked_flag, split FROM split"
    q["class_weights"] = (f"{pre}, tr AS (SELECT * FROM split WHERE split = 'train'), "
                          f"t AS (SELECT count(*) AS n, count_if(clicked_flag = 1) AS pos, count_if(clicked_flag = 0) AS neg FROM tr) "
                          f"SELECT CAST(clicked_flag AS INTEGER) AS clicked_flag, CAST(count(*) AS BIGINT) AS n_class, "
                          f"CAST(any_value(t.n) AS DOUBLE) / (2.0 * CAST(count(*) AS DOUBLE)) AS weight, "
                          f"CASE WHEN any_value(t.pos) > 0 THEN CAST(any_value(t.neg) AS DOUBLE) / CAST(any_value(t.pos) AS DOUBLE) ELSE 1.0 END AS scale_pos_weight "
                          f"FROM tr, t GROUP BY clicked_flag")
    modes = []
    for c in ("age_bracket", "gender", "education"):
        modes.append(f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM split WHERE split = 'train' AND {c} IS NOT NULL "
                     f"GROUP BY {c}) ORDER BY n DESC, {c} ASC LIMIT 1)")
    q["impute_mode"] = (f"{pre} SELECT source, campaign_id, target_id, "
                        f"coalesce(age_bracket, {modes[0]}) AS age_bracket, coalesce(gender, {modes[1]}) AS gender, "
                        f"coalesce(education, {modes[2]}) AS education FROM split")
    return q


_ORACLE_BASE = oracle_sql


def oracle_sql() -> dict[str, str]:  # noqa: F811
    q = _ORACLE_BASE()
    q.update(_model_prep_sql())
    return q


def _stream_sql() -> dict[str, str]:
    q = {"stream_attribution": _extra_sql()["attribute_hits"], "stream_raw_hits": _extra_sql()["attribute_hits"],
         "stream_quarantine": _extra_sql()["unknown_uid_hits"]}
    q["stream_totals"] = (f"{with_views('event_log')} SELECT event_type, CAST(count(*) AS BIGINT) AS events "
                          f"FROM event_log GROUP BY event_type")
    return q


_ORACLE_BASE2 = oracle_sql


def oracle_sql() -> dict[str, str]:  # noqa: F811
    q = _ORACLE_BASE2()
    q.update(_stream_sql())
    return q


def _mixed_sql() -> dict[str, str]:
    pre = with_views('fact', 'templates')
    sig = ", ".join(f"CAST(coalesce({c}, 0) AS INTEGER) AS {c}" for c in SIGNAL_COLUMNS)
    dem = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'unknown') AS {c}" for c in ("age_bracket", "gender", "education"))
    keys = ", ".join([*SIGNAL_COLUMNS, "age_bracket", "gender", "education", "grp"])
    levels = " UNION ALL ".join(
        f"SELECT 'C({c})[T.' || v || ']' FROM (SELECT DISTINCT {c} AS v FROM cl) l WHERE v <> (SELECT min({c}) FROM cl)"
        for c in ("age_bracket", "gender", "education"))
    fixed = " UNION ALL ".join(f"SELECT '{t}' AS term" for t in ("Intercept", *SIGNAL_COLUMNS))
    return {"mixed_map_gradient": (
        f"{pre}, {_comb_sql(OBSERVED_SOURCES)}, cl AS (SELECT {sig}, {dem}, CAST(segment_id AS VARCHAR) AS grp FROM comb WHERE segment_id IS NOT NULL) "
        f"SELECT term, CAST(0 AS DOUBLE) AS gradient FROM ({fixed} UNION ALL {levels}) t"),
        "mixed_cells": (
        f"{pre}, {_population_sql()}, {_comb_sql(COMBINED)}, cl AS (SELECT {sig}, {dem}, CAST(segment_id AS VARCHAR) AS grp, "
        f"CAST(coalesce(clicked_flag, 0) AS INTEGER) AS clicked_flag FROM comb WHERE segment_id IS NOT NULL) "
        f"SELECT {keys}, CAST(count(*) AS BIGINT) AS n, CAST(sum(clicked_flag) AS BIGINT) AS k FROM cl GROUP BY {keys}")}


_ORACLE_BASE3 = oracle_sql


def oracle_sql() -> dict[str, str]:  # noqa: F811
    q = _ORACLE_BASE3()
    q.update(_mixed_sql())
    return q


def _runs_sql(comparison: str) -> dict[str, str]:
    size = lambda k: f"n_rows, n_rows - n_rows % {k} AS train_rows, n_rows % {k} AS test_rows"
    none = "CAST(NULL AS VARCHAR) AS dataset_path"
    table = f"""SELECT model, '20240103_000000' AS run_id, accuracy, precision, recall, f1, roc_auc, brier_score, {size(7)},
  positives AS positive_cases_total, {none}, CAST(NULL AS VARCHAR) AS mode FROM ({comparison}) x WHERE model = 'x8_click'
UNION ALL
SELECT model, '20240102_000000', accuracy, precision, recall, f1, roc_auc, CAST(NULL AS DOUBLE), {size(11)},
  CAST(NULL AS BIGINT), {none}, 'held-out' FROM ({comparison}) y WHERE model = 'x8_open'"""
    win = []
    for metric, op in (*[(m, ">") for m in ("accuracy", "precision", "recall", "f1", "roc_auc")], ("brier_score", "<")):
        win.append(f"SELECT '{metric}' AS metric, a.{metric} AS value_a, b.{metric} AS value_b, "
                   f"CASE WHEN a.{metric} {op} b.{metric} THEN 'x8_click' WHEN b.{metric} {op} a.{metric} THEN 'x8_open' "
                   f"WHEN a.{metric} = b.{metric} THEN 'tie' END AS winner, "
                   f"a.n_rows = b.n_rows AS same_n_rows, a.train_rows = b.train_rows AS same_train_rows, "
                   f"a.test_rows = b.test_rows AS same_test_rows, a.n_rows = b.n_rows AND a.train_rows = b.train_rows "
                   f"AND a.test_rows = b.test_rows AS comparable FROM t a, t b WHERE a.model = 'x8_click' AND b.model = 'x8_open'")
    return {"stored_run_table": table, "stored_run_winners": f"WITH t AS ({table}) " + " UNION ALL ".join(win)}


def _erase_sql() -> dict[str, str]:
    """The closure by hand: what goes from each table when rows of one parent go."""
    pre = with_views('segments', 'templates', 'targets', 'campaigns', 'raw_event_log')
    q = {}
    for name, table, condition in (("erase_segment", "segments", "gender = 'N/A'"), ("erase_template", "templates", "id = 3"),
                                   ("erase_campaign", "campaigns", "id % 5 = 0"), ("erase_target", "targets", "id % 4 = 1")):
        own = lambda t: condition if t == table else "false"
        gone = f"""gs AS (SELECT id FROM segments WHERE {own('segments')}), gp AS (SELECT id FROM templates WHERE {own('templates')}),
gt AS (SELECT id FROM targets WHERE {own('targets')} OR segment_id IN (SELECT id FROM gs)),
gc AS (SELECT id FROM campaigns WHERE {own('campaigns')} OR segment_id IN (SELECT id FROM gs) OR template_id IN (SELECT id FROM gp)),
ge AS (SELECT id FROM raw_event_log WHERE campaign_id IN (SELECT id FROM gc) OR target_id IN (SELECT id FROM gt)
       OR template_id IN (SELECT id FROM gp))"""
        parts = [f"SELECT '{t}' AS table_name, CAST(id AS BIGINT) AS id FROM {view} WHERE id NOT IN (SELECT id FROM {g})"
                 for t, view, g in (("segments", "segments", "gs"), ("templates", "templates", "gp"), ("targets", "targets", "gt"),
                                    ("campaigns", "campaigns", "gc"), ("event_log", "raw_event_log", "ge"))]
        q[name] = f"{pre}, {gone} " + " UNION ALL ".join(parts)
    return q


def _files_sql() -> dict[str, str]:
    from lureline.sources.files import FACT_SCHEMA
    cols = []
    for f in FACT_SCHEMA.fields:
        if f.name == "source":
            cols.append("'observed' AS source")
        elif f.dataType.typeName() == "string":
            cols.append(f"{_na_sql(f.name)} AS {f.name}")
        else:
            cols.append(f.name)
    every = oracle_base()
    per = every["targets_per_segment"]
    appended = (f"SELECT event_type FROM (SELECT event_type FROM event_log UNION ALL "
                f"SELECT event_type FROM ({every['expand_deliveries']}) d) x")
    return {"dataset_choice": f"{with_views('fact')} SELECT {', '.join(cols)} FROM fact",
            "source_default": f"{with_views('fact')} SELECT {', '.join(cols)} FROM fact",
            "parquet_round_trip": every["event_counts"],
            "latest_run": f"SELECT segment_id, targets, '20240102_000000' AS run_id FROM ({per}) x",
            "metrics_json": f"SELECT *, '20240101_000000' AS run_id FROM ({every['classification_metrics']}) m",
            **_runs_sql(every["model_comparison"]), **_erase_sql(),
            "append_once": f"{with_views('event_log')} SELECT event_type, CAST(count(*) AS BIGINT) AS events "
                           f"FROM ({appended}) y GROUP BY event_type",
            "append_deliveries": f"{with_views('event_log')} SELECT event_type, CAST(count(*) AS BIGINT) AS events "
                                 f"FROM ({appended}) y GROUP BY event_type"}


_ORACLE_BASE4 = oracle_base = oracle_sql


def oracle_sql() -> dict[str, str]:  # noqa: F811
    q = _ORACLE_BASE4()
    q.update(_files_sql())
    return q
