"""Exact order statistics without a global sort.

The value at a given rank is found by bracketing: a mergeable quantile sketch proposes pivots just
below, at and just above the rank, one counting pass says how many rows lie below and at each pivot,
and only what lies strictly between the two pivots that enclose the rank is looked at again. That is
about 4/10,000 of the rows; if these are still many, they are bracketed in turn, else their distinct
values are counted. Nothing is sorted, nothing but the rows of a bracket is read again after the
counting pass, and a value that a third of all rows share is one pivot.

Several ranks, also of several groups of rows, are answered by the same passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY = 10_000
INTERIOR = 20_000  # rows between two pivots whose distinct values the driver may hold


def order_statistics(df: DataFrame, column: str, ranks: dict[int, dict[int, int]], group: str | None = None) -> dict:
    """``{(group, rank): (value, rows below it, rows equal to it)}`` for 1-based ranks.

    ``ranks`` gives per group its number of rows and the ranks wanted: ``{group: {"n": .., "ranks": [..]}}``;
    ``group`` names an integer column (None: one group, 0). Null values are left out.
    """
    ranks = {g: w for g, w in ranks.items() if w["ranks"]}
    if not ranks:
        return {}
    number = F.lit(0) if group is None else F.col(group)
    rows = df.select(number.alias("_g"), F.col(column).alias("_v")).where(F.col("_g").isin(list(ranks)) & F.col("_v").isNotNull())
    shares = {}
    for g, wanted in ranks.items():
        n, slack = wanted["n"], 2 * wanted["n"] / ACCURACY + 1
        shares[g] = {min(1.0, max(0.0, (r + d) / n)) for r in wanted["ranks"] for d in (-slack, 0, slack)}
    every = sorted(set().union(*shares.values()))
    pivots = {}
    for r in rows.groupBy("_g").agg(F.percentile_approx("_v", every, ACCURACY).alias("q"), F.min("_v").alias("low"),
                                    F.max("_v").alias("high")).collect():  # one row per group
        pivots[r["_g"]] = sorted({v for v, share in zip(r["q"], every) if share in shares[r["_g"]]} | {r["low"], r["high"]})
    below, order = _counts(rows, pivots), list(ranks)
    value, own = F.col("_v"), {g: F.col("_g") == g for g in order}
    out, inside = {}, {}
    for g in order:
        for r in ranks[g]["ranks"]:
            lo = max(v for v in pivots[g] if below[g, v][0] < r)
            hi = min(v for v in pivots[g] if below[g, v][1] >= r)
            if lo == hi:
                out[g, r] = (lo, below[g, lo][0], below[g, lo][1] - below[g, lo][0])
            else:  # strictly between two pivots
                inside.setdefault((g, lo, hi), []).append(r)
    if inside:
        out |= _between(rows, value, own, below, inside)
    return out


def _counts(rows: DataFrame, pivots: dict) -> dict:
    """``(group, pivot) -> (rows below, rows up to)``, one exact pass: every row goes to its place
    among its group's pivots, and the places are counted."""
    lists = [(g, F.array(*[F.lit(v) for v in own])) for g, own in pivots.items()]
    if not lists:
        return {}
    own = reduce(lambda acc, kv: acc.when(F.col("_g") == kv[0], kv[1]), lists[1:], F.when(F.col("_g") == lists[0][0], lists[0][1]))
    place = F.size(F.filter(own, lambda v: v < F.col("_v")))
    counted = rows.select("_g", place.alias("place"), F.coalesce(F.get(own, place) == F.col("_v"), F.lit(False)).alias("at")) \
        .groupBy("_g", "place", "at").count()
    seen = {(r["_g"], r["place"], r["at"]): r["count"] for r in counted.collect()}  # two rows per pivot at most
    out = {}
    for g, values in pivots.items():
        upto = 0
        for i, v in enumerate(values):
            less = upto + seen.get((g, i, False), 0)
            upto = less + seen.get((g, i, True), 0)
            out[g, v] = (less, upto)
    return out


def _between(df: DataFrame, value: Column, own: dict, below: dict, inside: dict) -> dict:
    """Ranks whose value lies strictly between two neighbouring pivots."""
    brackets = list(inside)
    number = reduce(lambda acc, kv: acc.when(own[kv[1][0]] & (value > F.lit(kv[1][1])) & (value < F.lit(kv[1][2])), kv[0]),
                    list(enumerate(brackets))[1:],
                    F.when(own[brackets[0][0]] & (value > F.lit(brackets[0][1])) & (value < F.lit(brackets[0][2])), 0))
    rows = df.select(value.alias("_x"), number.alias("_bracket")).where("_bracket is not null")
    size = {b: below[g, hi][0] - below[g, lo][1] for b, (g, lo, hi) in enumerate(brackets)}
    few = [b for b in size if size[b] <= INTERIOR]
    found = {}
    if few:
        seen: dict[int, list] = {b: [] for b in few}
        for r in rows.where(F.col("_bracket").isin(few)).groupBy("_bracket", "_x").count().collect():
            seen[r["_bracket"]].append((r["_x"], r["count"]))
        for b in few:
            g, lo, _ = brackets[b]
            upto = below[g, lo][1]
            for v, n in sorted(seen[b]):
                found |= {(g, r): (v, upto, n) for r in inside[brackets[b]] if upto < r <= upto + n}
                upto += n
    many = {b: {"n": size[b], "ranks": [r - below[brackets[b][0], brackets[b][1]][1] for r in inside[brackets[b]]]}
            for b in size if size[b] > INTERIOR}
    for (b, local), (v, less, equal) in order_statistics(rows, "_x", many, "_bracket").items():
        g, lo, _ = brackets[b]
        before = below[g, lo][1]
        found[g, local + before] = (v, less + before, equal)
    return found


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType)


def rows_at_ranks(df: DataFrame, order: list[str], ranks: list[int], n: int) -> dict[int, tuple[tuple, int, int]]:
    """For each rank of the ascending order by several columns the leading values of the row there:
    as many as tell the rows up to the rank from those after it (see :func:`after`), the number of
    rows before the first row with these values, and the number of rows that have them.

    Ties in the first column are resolved inside the rows that share it, by the next column, and so
    on; a rank that ends a group of ties needs no further column. Columns that are no numbers are
    ordered over their distinct values. Only where rows equal in all columns straddle a rank, the
    values do not part them: then ``before + equal`` is greater than the rank. Columns hold no nulls.
    """
    open_groups = {(): {r: r for r in ranks}}
    sizes, out = {(): n}, {}
    for depth, name in enumerate(order):
        prefixes = list(open_groups)
        if not prefixes:
            break
        match = [reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(order, p)], F.lit(True)) for p in prefixes]
        number = reduce(lambda acc, im: acc.when(im[1], im[0]), list(enumerate(match))[1:], F.when(match[0], 0))
        rows = df.select(F.col(name), number.alias("_g")).where("_g is not null")
        wanted = {g: {"n": sizes[p], "ranks": sorted(set(open_groups[p].values()))} for g, p in enumerate(prefixes)}
        if _is_number(df.schema[name].dataType):
            found = order_statistics(rows, name, wanted, "_g")
        else:
            found = _distinct_statistics(rows, name, wanted)
        following: dict[tuple, dict[int, int]] = {}
        for g, p in enumerate(prefixes):
            for r, local in open_groups[p].items():
                v, less, equal = found[g, local]
                if local == less + equal or depth == len(order) - 1:
                    out[r] = ((*p, v), r - local + less, equal)
                else:
                    following.setdefault((*p, v), {})[r] = local - less
                    sizes[(*p, v)] = equal
        open_groups = following
    return out


def _distinct_statistics(rows: DataFrame, name: str, wanted: dict) -> dict:
    from pyspark.sql import Window
    upto = Window.partitionBy("_g").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    per = rows.groupBy("_g", name).count().withColumn("_upto", F.sum("count").over(upto))
    hit = reduce(lambda a, b: a | b, [(F.col("_g") == g) & (F.col("_upto") >= r) & (F.col("_upto") - F.col("count") < r)
                                      for g, w in wanted.items() for r in w["ranks"]])
    out = {}
    for x in per.where(hit).collect():  # one row per rank at most
        out |= {(x["_g"], r): (x[name], x["_upto"] - x["count"], x["count"])
                for r in wanted[x["_g"]]["ranks"] if x["_upto"] - x["count"] < r <= x["_upto"]}
    return out


def after(order: list, values: tuple) -> Column:
    """Whether a row stands after the row that :func:`rows_at_ranks` describes (``order``: the same
    columns, by name or as expressions)."""
    cond, equal = F.lit(False), F.lit(True)
    for column, v in zip(order, values):
        c = F.col(column) if isinstance(column, str) else column
        cond = cond | (equal & (c > F.lit(v)))
        equal = equal & (c == F.lit(v))
    return cond


def key_order(name: str, kind: T.DataType) -> Column:
    """A key column with nulls as the least value of its type, so that keys compare."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.coalesce(F.col(name).cast("long"), F.lit(-2 ** 63))
    if isinstance(kind, T.FractionalType):
        return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
