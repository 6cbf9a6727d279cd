"""Summaries of the interaction fact and of the operational tables.

Output column names are the platform's own (Spanish where it used Spanish), so exported tables
read the same. Counts are BIGINT and rates DOUBLE on every path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.constants import (
    EVENT_TYPES,
    GENERAL_INDICATORS,
    GLOBAL_INDICATORS,
    OPEN_SIGNAL_WEIGHTS,
    SIGNAL_COLUMNS,
    SIGNAL_LABELS,
)
from lureline.functions.expressions import safe_rate

RATE_NAMES = ("tasa_apertura_pct", "tasa_clic_pct", "tasa_reporte_pct")


def _lsum(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def in_report_order(summary: DataFrame) -> DataFrame:
    """K1: a summary table sorted by its leading key, as reports show it (few rows)."""
    key = next(c for c in ("campaign_id", "segment_id", "template_id") if c in summary.columns)
    return summary.orderBy(F.col(key).asc_nulls_last())


def _with_rates(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        safe_rate("opened", "delivered").alias("tasa_apertura_pct"),
        safe_rate("clicked", "delivered").alias("tasa_clic_pct"),
        safe_rate("reported", "delivered").alias("tasa_reporte_pct"),
    )


def _fact_measures(fact: DataFrame):
    reported = F.col("reported_flag") if "reported_flag" in fact.columns else F.lit(0)
    return [
        _lsum("delivered").alias("delivered"),
        _lsum("opened_flag").alias("opened"),
        _lsum("clicked_flag").alias("clicked"),
        _lsum(reported).alias("reported"),
    ]


CAMPAIGN_KEYS = ("campaign_id", "campaign_status", "campaign_channel", "segment_id", "template_id")
# campaign attributes the rollup carries for the segment / template / signal summaries
ROLLUP_ATTRIBUTES = ("template_name", "template_subject", "template_description", *SIGNAL_COLUMNS,
                     "age_bracket", "gender", "education")


def campaign_summary(fact: DataFrame) -> DataFrame:
    """A6 over any fact (CSV export, synthetic, combined): one row per campaign key.

    Null keys form their own group (Spark's ``groupBy`` keeps them, like ``dropna=False``).
    """
    g = fact.groupBy(*CAMPAIGN_KEYS).agg(
        F.count("target_id").cast("bigint").alias("observaciones"), *_fact_measures(fact))
    return _with_rates(g)


def campaign_rollup(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                    targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """Per campaign of the fact: its keys, ``_seg_key``, targets in the segment and the four
    fact sums, computed without materialising the fact.

    The fact has one row per (campaign, target of its segment); its campaign sums only need
    (a) the number of targets per segment and (b) the pair counts of targets that belong to the
    campaign's segment. So: targets -> count per segment (partial aggregate, tiny shuffle);
    pair counts (A2) joined to the target's segment on ``target_id`` (one shuffle of narrow
    rows, no fan-out) and kept where it equals the campaign's segment; then summed per campaign.
    The fan-out (targets x campaigns per segment) is never built, so the cost grows with
    targets + events, not with targets x campaigns. One row per campaign that has targets.
    """
    from lureline.operators.facts import campaign_dimension, event_counts

    dim = campaign_dimension(campaigns, templates, segments)
    per_segment = targets.groupBy(F.col("segment_id").alias("_seg_key")).agg(
        F.count(F.lit(1)).cast("bigint").alias("observaciones"))
    pair = event_counts(event_log)
    tseg = targets.select(F.col("id").alias("target_id"), F.col("segment_id").alias("_t_seg"))
    camp_seg = dim.select(F.col("campaign_id").alias("_c_id"), F.col("_seg_key").alias("_c_seg"))
    in_segment = (pair.join(tseg, "target_id", "inner")
                  .join(camp_seg, pair.campaign_id == camp_seg._c_id, "inner")
                  .where(F.col("_t_seg") == F.col("_c_seg")))
    sums = in_segment.groupBy("campaign_id").agg(
        _lsum("delivered").alias("delivered"),
        F.count_if(F.col("opened") > 0).cast("bigint").alias("opened"),
        F.count_if(F.col("clicked") > 0).cast("bigint").alias("clicked"),
        F.count_if(F.col("reported") > 0).cast("bigint").alias("reported"),
    )
    base = dim.join(per_segment, "_seg_key", "inner")
    return base.join(sums, "campaign_id", "left").select(
        *CAMPAIGN_KEYS, *ROLLUP_ATTRIBUTES, "_seg_key", "observaciones",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in EVENT_TYPES])


def campaign_summary_from_log(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                              targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """A6 straight from the operational tables (see :func:`campaign_rollup`); equal to
    ``campaign_summary(interaction_fact(...))``."""
    rollup = campaign_rollup(campaigns, templates, segments, targets, event_log)
    return _with_rates(rollup.select(*CAMPAIGN_KEYS, "observaciones", *EVENT_TYPES))


def _rollup_totals(rollup: DataFrame, with_reported: bool) -> DataFrame:
    """The one-row totals of A4/A5 from the per-campaign rollup (bounded by the campaign
    dimension, so its window and global aggregate are small).

    fact rows = sum of targets per campaign; distinct targets = targets of each distinct
    segment key (each target has one segment, campaigns of one key share the count).
    """
    r = rollup.withColumn("_key_first", _first_of_key(rollup))
    aggs = [
        _lsum("observaciones").alias("_v0"),
        F.countDistinct("campaign_id").alias("_v1"),
        _lsum(F.when(F.col("_key_first"), F.col("observaciones"))).alias("_v2"),
        F.countDistinct("segment_id").alias("_v3"),
        F.countDistinct("template_id").alias("_v4"),
        _lsum("delivered").alias("_v5"),
        _lsum("opened").alias("_v6"),
        _lsum("clicked").alias("_v7"),
    ]
    if with_reported:
        aggs.append(_lsum("reported").alias("_v8"))
    return r.agg(*aggs)


ID_COLUMNS = ("campaign_id", "target_id", "segment_id", "template_id")


def exact_distinct(fact: DataFrame, columns=ID_COLUMNS, sums=()) -> DataFrame:
    """One row: the exact number of distinct values of several whole-number columns, and sums, in one
    pass without an expanded distinct per column.

    Every value is one bit of the bitmap of its bucket (32,768 values); bitmaps are combined map-side,
    so what is shuffled grows with the range of the ids, not with the rows, and a hot value is one
    bit. The sums travel with the first column's entries.
    """
    columns = list(columns)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("long").alias("v")) for i, c in enumerate(columns)]))
    rows = fact.select(*[F.col(c).cast("bigint").alias(f"_s{i}") for i, c in enumerate(sums)], each.alias("_e"))
    first = F.col("_e.c") == 0
    per = rows.groupBy(F.col("_e.c").alias("c"), F.bitmap_bucket_number("_e.v").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_e.v")).alias("bits"),
        F.sum(F.when(first, 1)).alias("_n"), *[F.sum(F.when(first, F.col(f"_s{i}"))).alias(f"_s{i}") for i in range(len(sums))])
    known = F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))
    return per.agg(_lsum("_n").alias("rows"),
                   *[F.coalesce(F.sum(F.when(F.col("c") == i, known)), F.lit(0)).cast("bigint").alias(c) for i, c in enumerate(columns)],
                   *[_lsum(f"_s{i}").alias(c) for i, c in enumerate(sums)])


def bitmap_global_summary(fact: DataFrame) -> DataFrame:
    """A4 over any dataset by :func:`exact_distinct`; equal to ``global_summary``."""
    sums = ("delivered", "opened_flag", "clicked_flag")
    return _long_form(_numbered(exact_distinct(fact, sums=sums), ("rows", *ID_COLUMNS, *sums)).select(
        "*", safe_rate("_v6", "_v5").alias("_v8"), safe_rate("_v7", "_v5").alias("_v9")),
        GLOBAL_INDICATORS, "indicator", "value")


def bitmap_general_table(fact: DataFrame) -> DataFrame:
    """A5 over any dataset by :func:`exact_distinct`; equal to ``general_table``."""
    data = fact if "reported_flag" in fact.columns else fact.withColumn("reported_flag", F.lit(0))
    sums = ("delivered", "opened_flag", "clicked_flag", "reported_flag")
    return _long_form(_numbered(exact_distinct(data, sums=sums), ("rows", *ID_COLUMNS, *sums)).select(
        "*", safe_rate("_v6", "_v5").alias("_v9"), safe_rate("_v7", "_v5").alias("_v10"), safe_rate("_v8", "_v5").alias("_v11")),
        GENERAL_INDICATORS, "indicador", "valor")


def _numbered(row: DataFrame, columns) -> DataFrame:
    return row.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])


def global_summary_from_log(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                            targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """A4 of the observed fact without building it; equal to ``global_summary(fact)``."""
    rollup = campaign_rollup(campaigns, templates, segments, targets, event_log)
    row = _rollup_totals(rollup, with_reported=False).select(
        "*", safe_rate("_v6", "_v5").alias("_v8"), safe_rate("_v7", "_v5").alias("_v9"))
    return _long_form(row, GLOBAL_INDICATORS, "indicator", "value")


def general_table_from_log(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                           targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """A5 of the observed fact without building it; equal to ``general_table(fact)``."""
    rollup = campaign_rollup(campaigns, templates, segments, targets, event_log)
    row = _rollup_totals(rollup, with_reported=True).select(
        "*", safe_rate("_v6", "_v5").alias("_v9"), safe_rate("_v7", "_v5").alias("_v10"),
        safe_rate("_v8", "_v5").alias("_v11"))
    return _long_form(row, GENERAL_INDICATORS, "indicador", "valor")


SEGMENT_KEYS = ("segment_id", "age_bracket", "gender", "education")


def segment_summary(fact: DataFrame) -> DataFrame:
    """Per segment and its demographics; distinct targets, sums, rates."""
    g = fact.groupBy(*SEGMENT_KEYS).agg(
        F.countDistinct("target_id").cast("bigint").alias("targets"), *_fact_measures(fact))
    return _with_rates(g)


def _first_of_key(rollup: DataFrame) -> F.Column:
    """True on one campaign per segment key (the rollup is bounded by the campaign dimension)."""
    return F.row_number().over(Window.partitionBy("_seg_key").orderBy("campaign_id")) == 1


def segment_summary_from_log(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                             targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """A7 of the observed fact from the per-campaign rollup; equal to ``segment_summary(fact)``.

    Each target has one segment key and each key one segment group, so the distinct targets of a
    group are the target counts of its distinct keys; the other measures add up per campaign.
    """
    rollup = campaign_rollup(campaigns, templates, segments, targets, event_log)
    r = rollup.withColumn("_key_first", _first_of_key(rollup))
    g = r.groupBy(*SEGMENT_KEYS).agg(
        _lsum(F.when(F.col("_key_first"), F.col("observaciones"))).alias("targets"),
        *[_lsum(c).alias(c) for c in EVENT_TYPES])
    return _with_rates(g)


TEMPLATE_KEYS = ("template_id", "template_name", "template_subject", "template_description",
                 *SIGNAL_COLUMNS)


def template_summary_from_log(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                              targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """A8 of the observed fact from the per-campaign rollup; equal to ``template_summary(fact)``."""
    rollup = campaign_rollup(campaigns, templates, segments, targets, event_log)
    return _with_rates(rollup.groupBy(*TEMPLATE_KEYS).agg(*[_lsum(c).alias(c) for c in EVENT_TYPES]))


def signal_summary_from_log(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                            targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """A9 of the observed fact from the per-campaign rollup; equal to ``signal_summary(fact)``
    (signals are campaign attributes, so every measure adds up per campaign)."""
    rollup = campaign_rollup(campaigns, templates, segments, targets, event_log)
    return _signal_table(rollup, "observaciones", {
        "delivered": "delivered", "opened": "opened", "clicked": "clicked", "reported": "reported"})


def template_summary(fact: DataFrame) -> DataFrame:
    """Per template with its text and signals."""
    return _with_rates(fact.groupBy(*TEMPLATE_KEYS).agg(*_fact_measures(fact)))


def signal_summary(fact: DataFrame) -> DataFrame:
    """For each signal, measures where it is 1 and where it is 0 (other values: neither).

    One scan and one global aggregate with 40 conditional sums, then ``stack`` to four rows;
    the original ran eight filtered passes.
    """
    reported = "reported_flag" if "reported_flag" in fact.columns else None
    return _signal_table(fact, None, {
        "delivered": "delivered", "opened": "opened_flag", "clicked": "clicked_flag",
        "reported": reported})


def _signal_table(df: DataFrame, rows_col: str | None, sources: dict) -> DataFrame:
    """A9 core: ``rows_col`` None counts rows (fact), else sums that column (rollup)."""
    measures = {"observaciones": rows_col, **sources}
    aggs = []
    for s in SIGNAL_COLUMNS:
        for side, val in (("con", 1), ("sin", 0)):
            cond = F.col(s) == val
            for m, src in measures.items():
                if m == "observaciones" and rows_col is None:
                    e = F.count_if(cond)
                elif src is None:
                    e = F.lit(0)
                else:
                    e = F.sum(F.when(cond, F.col(src)))
                aggs.append(F.coalesce(e, F.lit(0)).cast("bigint").alias(f"{s}__{m}_{side}"))
    wide = df.agg(*aggs)
    rows = []
    for i, s in enumerate(SIGNAL_COLUMNS):
        cols = [F.lit(i).alias("_order"), F.lit(SIGNAL_LABELS[s]).alias("senal")]
        for side in ("con", "sin"):
            cols += [F.col(f"{s}__{m}_{side}").alias(f"{m}_{side}_senal") for m in measures]
        rows.append(F.struct(*cols))
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    out = [F.col("senal")]
    for side in ("con", "sin"):
        out += [F.col(f"{m}_{side}_senal") for m in measures]
        out += [
            safe_rate(f"opened_{side}_senal", f"delivered_{side}_senal").alias(f"tasa_apertura_{side}_senal_pct"),
            safe_rate(f"clicked_{side}_senal", f"delivered_{side}_senal").alias(f"tasa_clic_{side}_senal_pct"),
            safe_rate(f"reported_{side}_senal", f"delivered_{side}_senal").alias(f"tasa_reporte_{side}_senal_pct"),
        ]
    return long.select(*out)


def _long_form(one_row: DataFrame, names, label_col: str, value_col: str) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("_order"), F.lit(n).alias(label_col),
                        F.col(f"_v{i}").cast("double").alias(value_col))
               for i, n in enumerate(names)]
    return one_row.select(F.explode(F.array(*entries)).alias("r")).select(
        f"r.{label_col}", f"r.{value_col}")


def global_summary(fact: DataFrame) -> DataFrame:
    """A4: (indicator, value) with ten rows from one aggregate."""
    row = fact.agg(
        F.count(F.lit(1)).alias("_v0"),
        F.countDistinct("campaign_id").alias("_v1"),
        F.countDistinct("target_id").alias("_v2"),
        F.countDistinct("segment_id").alias("_v3"),
        F.countDistinct("template_id").alias("_v4"),
        _lsum("delivered").alias("_v5"),
        _lsum("opened_flag").alias("_v6"),
        _lsum("clicked_flag").alias("_v7"),
    ).select("*", safe_rate("_v6", "_v5").alias("_v8"), safe_rate("_v7", "_v5").alias("_v9"))
    return _long_form(row, GLOBAL_INDICATORS, "indicator", "value")


def general_table(fact: DataFrame) -> DataFrame:
    """A5: (indicador, valor), twelve rows; reported = 0 when the column is absent."""
    reported = F.col("reported_flag") if "reported_flag" in fact.columns else F.lit(0)
    row = fact.agg(
        F.count(F.lit(1)).alias("_v0"),
        F.countDistinct("campaign_id").alias("_v1"),
        F.countDistinct("target_id").alias("_v2"),
        F.countDistinct("segment_id").alias("_v3"),
        F.countDistinct("template_id").alias("_v4"),
        _lsum("delivered").alias("_v5"),
        _lsum("opened_flag").alias("_v6"),
        _lsum("clicked_flag").alias("_v7"),
        _lsum(reported).alias("_v8"),
    ).select("*", safe_rate("_v6", "_v5").alias("_v9"), safe_rate("_v7", "_v5").alias("_v10"),
             safe_rate("_v8", "_v5").alias("_v11"))
    return _long_form(row, GENERAL_INDICATORS, "indicador", "valor")


def operational_totals(campaigns: DataFrame, targets: DataFrame, templates: DataFrame,
                       segments: DataFrame, event_log: DataFrame) -> DataFrame:
    """A3: row counts of five tables, counts of the four event types, three event-count rates.

    The tables are tagged and unioned so one global aggregate counts them all (one job, each
    table scanned once with only a literal projected).
    """
    tagged = reduce(DataFrame.unionByName, [
        campaigns.select(F.lit("campaigns").alias("_t"), F.lit(None).cast("string").alias("_e")),
        targets.select(F.lit("targets").alias("_t"), F.lit(None).cast("string").alias("_e")),
        templates.select(F.lit("templates").alias("_t"), F.lit(None).cast("string").alias("_e")),
        segments.select(F.lit("segments").alias("_t"), F.lit(None).cast("string").alias("_e")),
        event_log.select(F.lit("events").alias("_t"), F.col("event_type").alias("_e")),
    ])
    counts = [F.count_if(F.col("_t") == t).cast("bigint").alias(t)
              for t in ("campaigns", "targets", "templates", "segments", "events")]
    counts += [F.count_if((F.col("_t") == "events") & (F.col("_e") == e)).cast("bigint").alias(e)
               for e in EVENT_TYPES]
    return tagged.agg(*counts).select(
        "*",
        safe_rate("opened", "delivered").alias("open_rate"),
        safe_rate("clicked", "delivered").alias("click_rate"),
        safe_rate("reported", "delivered").alias("report_rate"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null counted as its own value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def targets_per_segment(targets: DataFrame) -> DataFrame:
    """A12."""
    return targets.groupBy("segment_id").agg(F.count(F.lit(1)).cast("bigint").alias("targets"))


def campaign_context(df: DataFrame) -> DataFrame:
    """None -> 'no-campaigns'; one -> 'campaign-<id>'; many -> 'campaigns-<min>-<max>-n<count>'."""
    a = df.agg(F.min("campaign_id").alias("lo"), F.max("campaign_id").alias("hi"),
               F.countDistinct("campaign_id").alias("n"))
    label = (F.when(F.col("n") == 0, F.lit("no-campaigns"))
             .when(F.col("n") == 1, F.concat(F.lit("campaign-"), F.col("lo").cast("bigint").cast("string")))
             .otherwise(F.concat(F.lit("campaigns-"), F.col("lo").cast("bigint").cast("string"), F.lit("-"),
                                 F.col("hi").cast("bigint").cast("string"), F.lit("-n"),
                                 F.col("n").cast("string"))))
    return a.select(label.alias("campaign_context"), F.col("n").cast("bigint").alias("campaigns"))


def top_findings(fact: DataFrame) -> DataFrame:
    """Global rates and the campaign / segment / signal with the highest click rate.

    Ties go to the lowest id (signals: the first in the fixed order); the original's sort was
    not stable, so any tie-break is a choice and this one is stated.
    """
    return _findings(general_table(fact), campaign_summary(fact), segment_summary(fact),
                     signal_summary(fact))


def top_findings_from_log(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                          targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """A17 of the observed fact from the rollup-based summaries; equal to ``top_findings(fact)``."""
    rollup = campaign_rollup(campaigns, templates, segments, targets, event_log)
    name = lambda finding, item, order: F.struct(
        F.lit(finding).alias("finding"), item.cast("string").alias("item"), order.cast("bigint").alias("order"))
    groups = [name("global", F.lit(None), F.lit(0)), name("campaign", F.col("campaign_id"), F.col("campaign_id")),
              name("segment", F.col("segment_id"), F.col("segment_id")),
              *[F.when(F.col(s) == 1, name("signal", F.lit(SIGNAL_LABELS[s]), F.lit(i)))
                for i, s in enumerate(SIGNAL_COLUMNS)]]
    sums = rollup.select(F.explode(F.array_compact(F.array(*groups))).alias("g"), *EVENT_TYPES) \
        .groupBy("g").agg(*[_lsum(c).alias(c) for c in EVENT_TYPES])
    rates = sums.select("g.*", *[safe_rate(c, "delivered").alias(n) for c, n in zip(
        ("opened", "clicked", "reported"), ("open_rate_pct", "click_rate_pct", "report_rate_pct"))])
    pick = F.max_by(F.struct("item", "open_rate_pct", "click_rate_pct", "report_rate_pct"),
                    F.struct(F.col("click_rate_pct"), -F.col("order"))).alias("b")
    return rates.groupBy("finding").agg(pick).select("finding", "b.*")


def observed_contrasts(fact: DataFrame, segment: int = 1) -> DataFrame:
    """A14-A16 on given rows, by one aggregate: per signal the open rate with and without it, the
    click rate in and outside ``segment``, and per signal the difference in differences of the
    open rate. Rates in percent of the group's rows (0.0 for an empty one), unrounded until the
    difference is taken."""
    def rate(cond, flag):
        n = F.count_if(cond)
        hit = F.coalesce(F.sum(F.when(cond, F.col(flag))), F.lit(0)).cast("double")
        return F.when(n == 0, F.lit(0.0)).otherwise(hit / n.cast("double") * 100.0)

    inside = F.coalesce(F.col("segment_id") == segment, F.lit(False))
    rows = [("segment", "segment", rate(inside, "clicked_flag"), rate(~inside, "clicked_flag"))]
    for s in SIGNAL_COLUMNS:
        on, off = F.col(s) == 1, F.col(s) == 0
        rows.append(("signal", s, rate(on, "opened_flag"), rate(off, "opened_flag")))
        rows.append(("interaction", s,
                     rate(inside & on, "opened_flag") - rate(inside & off, "opened_flag"),
                     rate(~inside & on, "opened_flag") - rate(~inside & off, "opened_flag")))
    structs = [F.struct(F.lit(kind).alias("contrast"), F.lit(item).alias("item"),
                        F.bround(a, 2).alias("group_a_rate_pct"), F.bround(b, 2).alias("group_b_rate_pct"),
                        F.bround(a - b, 2).alias("difference_pp")) for kind, item, a, b in rows]
    return fact.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def observed_validation(fact: DataFrame, segment: int = 1) -> DataFrame:
    """A16 on given rows: every observed contrast with the pattern that the effect sizes let expect
    and whether the rows show it. A signal that raises the open score should raise the open rate; a
    signal's effect is the same in and outside a segment, so an interaction should be none (less than
    ``NO_EFFECT_PP`` points); for a segment no pattern is given (null)."""
    expected = lookup_text("item", {s: "higher with the signal" if w > 0 else "lower with the signal"
                                    for s, w in OPEN_SIGNAL_WEIGHTS.items()})
    d = F.col("difference_pp")
    pattern = F.when(F.col("contrast") == "signal", expected).when(F.col("contrast") == "interaction", F.lit("none"))
    shown = F.when(F.col("contrast") == "signal", F.when(expected == "higher with the signal", d > 0).otherwise(d < 0)) \
        .when(F.col("contrast") == "interaction", F.abs(d) < NO_EFFECT_PP)
    return observed_contrasts(fact, segment).select("*", pattern.alias("expected_pattern"), shown.alias("as_expected"))


#: Percentage points below which a difference in differences counts as none.
NO_EFFECT_PP = 5.0


def lookup_text(column: str, table: dict[str, str]) -> F.Column:
    out = F.lit(None).cast("string")
    for key, text in table.items():
        out = F.when(F.col(column) == key, F.lit(text)).otherwise(out)
    return out


def _findings(general: DataFrame, by_campaign: DataFrame, by_segment: DataFrame,
              by_signal: DataFrame) -> DataFrame:
    """A17 picks from the four summary tables (each small: one row per campaign at most)."""
    g = general.groupBy().pivot("indicador", list(GENERAL_INDICATORS[-3:])).agg(F.first("valor"))
    glob = g.select(F.lit("global").alias("finding"), F.lit(None).cast("string").alias("item"),
                    F.col(GENERAL_INDICATORS[-3]).alias("open_rate_pct"),
                    F.col(GENERAL_INDICATORS[-2]).alias("click_rate_pct"),
                    F.col(GENERAL_INDICATORS[-1]).alias("report_rate_pct"))

    def best(df: DataFrame, finding: str, item: F.Column, order_key: F.Column, rates) -> DataFrame:
        payload = F.struct(item.cast("string").alias("item"),
                           *[F.col(r).alias(n) for r, n in zip(rates, ("o", "c", "r"))])
        pick = df.agg(F.max_by(payload, F.struct(F.col(rates[1]), -order_key)).alias("b"))
        return pick.select(F.lit(finding).alias("finding"), F.col("b.item").alias("item"),
                           F.col("b.o").alias("open_rate_pct"), F.col("b.c").alias("click_rate_pct"),
                           F.col("b.r").alias("report_rate_pct"))

    camp = best(by_campaign, "campaign", F.col("campaign_id"), F.col("campaign_id"), RATE_NAMES)
    seg = best(by_segment, "segment", F.col("segment_id"), F.col("segment_id"), RATE_NAMES)
    sig = by_signal.withColumn(
        "_ord", F.array_position(F.array(*[F.lit(SIGNAL_LABELS[s]) for s in SIGNAL_COLUMNS]), F.col("senal")))
    sig_best = best(sig, "signal", F.col("senal"), F.col("_ord"),
                    ("tasa_apertura_con_senal_pct", "tasa_clic_con_senal_pct", "tasa_reporte_con_senal_pct"))
    return reduce(DataFrame.unionByName, [glob, camp, seg, sig_best])


def signal_odds(fact: DataFrame, label: str = "clicked_flag") -> DataFrame:
    """Per signal the log odds ratio of the label with and without it (half a row added to
    each of the four counts), its absolute value and the odds ratio; one aggregate."""
    rows = []
    for s in SIGNAL_COLUMNS:
        count = lambda v, y: (F.count_if((F.col(s) == v) & (F.col(label) == y)) + 0.5)  # noqa: E731, B023
        odds = F.log(count(1, 1) * count(0, 0) / (count(1, 0) * count(0, 1)))
        rows.append(F.struct(F.lit(s).alias("term"), F.bround(odds, 8).alias("log_odds")))
    out = fact.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out.select("term", "log_odds", F.abs("log_odds").alias("abs_log_odds"),
                      F.bround(F.exp("log_odds"), 8).alias("odds_ratio"))


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """K5: the first ``n`` rows of a result table in a stated order (the rows a report shows).

    ``orderBy(...).limit(n)`` plans as a top-k (``TakeOrderedAndProject``): each partition keeps
    its own n best rows and only those are merged, so no task sorts the whole table. Add a unique
    tie-breaker to ``order`` for a deterministic head.
    """
    return df.orderBy(*order).limit(n)
