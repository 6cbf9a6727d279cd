"""URL filter: given rules first, else boosted trees on lexical features (operator 10).

Only DataFrame functions and Spark ML (JVM) run here. The trees are gradient-boosted
(``GBTClassifier``) on length, depth, digit ratio, character entropy, parameter counts and suffix
statistics of the url; they learn from labelled urls.

Suffix statistics: for the last label of the host and for the whole host, the share of blocked
urls among the labelled ones, pulled towards the overall share by :data:`PRIOR_WEIGHT`
pseudo-urls. A labelled url is left out of its own statistic. They are aggregated over all
labelled urls (combined map-side) and joined back without a hint, so AQE broadcasts them when
they are small and splits a hot host when they are not.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
by its (empty) features; without labelled urls of both kinds the trees are not fitted and the only
label seen (or ``allow``) is the verdict; repeated rows give repeated results; extra columns go
through unless they clash with a result column, which wins; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.llm.common import lower_az, scratch

#: Pseudo-urls of the overall share in a suffix statistic.
PRIOR_WEIGHT = 10.0
LEXICAL = ("f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits",
           "f_path_digits", "f_entropy", "f_host_entropy", "f_params", "f_hyphens", "f_fragment",
           "f_extension")
SUFFIX = ("tld", "host")

Rules = Sequence[tuple[str, str, str]]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lower_az(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def rule_match(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest fitting rule (host and path joined) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy (bits per character) of a text; 0 for an empty one."""
    size = F.length(text)
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (size - F.length(F.replace(text, c))) / size
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def lexical_features(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host, path, tld`` and the :data:`LEXICAL` columns."""
    host, path = split_url(F.col(url_col))
    text = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    many = lambda col, pattern: F.regexp_count(col, F.lit(pattern)).cast("double")
    ratio = lambda col: F.when(F.length(col) > 0, many(col, "[0-9]") / F.length(col)).otherwise(0.0)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    out = urls.withColumns({"host": host, "path": path})
    return out.withColumns({
        "tld": F.substring_index("host", ".", -1),
        "f_length": F.length(text).cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_labels": many(F.col("host"), r"\."),
        "f_depth": many(F.col("path"), "/[^/]"),
        "f_digits": ratio(text), "f_path_digits": ratio(F.col("path")),
        "f_entropy": entropy(text), "f_host_entropy": entropy(F.col("host")),
        "f_params": many(query, "[^&]+"),
        "f_hyphens": many(text, "-"),
        "f_fragment": F.contains(text, F.lit("#")).cast("double"),
        "f_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    })


def suffix_statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """Labelled and blocked urls per suffix: ``<suffix>, n_<suffix>, b_<suffix>``."""
    return labelled.groupBy(suffix).agg(F.count("block").alias(f"n_{suffix}"),
                                        F.sum("block").alias(f"b_{suffix}"))


def judge_urls(pages: DataFrame, rules: Rules, labelled: DataFrame | None = None,
               url_col: str = "url", max_training_rows: int = 200_000,
               rounds: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict, block_probability``.

    ``labelled``: urls with a ``block`` column of 0/1 to learn from; by default the given urls
    that a rule decides, with the rule's verdict as label. The trees are fitted on at most about
    ``max_training_rows`` of them, drawn by a hash of the url; the suffix statistics use them all.
    """
    taken = {"host", "path", "rule", "verdict", "block_probability", "tld", "block", *LEXICAL}
    kept = [c for c in pages.columns if c not in taken or c == url_col]
    rows = lexical_features(pages.select(*kept), url_col)
    rule, says = rule_match(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_says": says})
    if labelled is None:
        known = rows.filter("rule is not null").withColumn("block", (F.col("_says") == "block").cast("int"))
    else:
        known = lexical_features(labelled.select(url_col, F.col("block").cast("int").alias("block")),
                                 url_col).filter("block is not null")
    known = scratch(known.select(url_col, "tld", "host", "block", *LEXICAL), "urls")
    total, blocked = known.agg(F.count("block"), F.coalesce(F.sum("block"), F.lit(0))).first()
    if blocked in (0, total):
        verdict = "block" if total and blocked == total else "allow"
        return rows.select(*kept, "host", "path", "rule",
                           F.coalesce("_says", F.lit(verdict)).alias("verdict"),
                           F.lit(1.0 if verdict == "block" else 0.0).alias("block_probability"))

    prior = blocked / total
    statistics = {s: suffix_statistics(known, s) for s in SUFFIX}

    def assembled(df: DataFrame, own: Column) -> DataFrame:
        """``own``: the row's own label where it is part of the statistics, else null."""
        for s in SUFFIX:
            df = df.join(statistics[s], s, "left")
            n = F.coalesce(F.col(f"n_{s}"), F.lit(0)) - own.isNotNull().cast("int")
            b = F.coalesce(F.col(f"b_{s}"), F.lit(0)) - F.coalesce(own, F.lit(0))
            df = df.withColumn(f"f_{s}_rate", (b + PRIOR_WEIGHT * prior) / (n + PRIOR_WEIGHT)) \
                .withColumn(f"f_{s}_seen", F.log1p(F.greatest(n, F.lit(0)).cast("double")))
        names = [*LEXICAL, *[f"f_{s}_{k}" for s in SUFFIX for k in ("rate", "seen")]]
        return VectorAssembler(inputCols=names, outputCol="features").transform(df)

    share = min(1.0, max_training_rows / total)
    drawn = known.filter(F.pmod(F.xxhash64(url_col, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = scratch(assembled(drawn, F.col("block")).select(
        "features", F.col("block").cast("double").alias("label")), "url-train")
    if train.select("label").distinct().count() < 2:
        train = scratch(assembled(known, F.col("block")).select(
            "features", F.col("block").cast("double").alias("label")), "url-train")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.2,
                          maxMemoryInMB=64, cacheNodeIds=False).fit(train)
    own = F.lit(None).cast("int") if labelled is not None else \
        F.when(F.col("rule").isNotNull(), (F.col("_says") == "block").cast("int"))
    judged = model.transform(assembled(rows, own))
    return judged.select(
        *kept, "host", "path", "rule",
        F.coalesce("_says", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).alias("verdict"),
        vector_to_array("probability")[1].alias("block_probability"))
