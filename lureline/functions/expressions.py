"""Column expressions: built-in Spark expressions (JVM side), but for HTML character references,
which are decoded by one Arrow-batched function."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.constants import LABEL_TEXT_MAP, NA_TOKENS, TRUTHY_STRINGS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_rate(numerator: str | Column, denominator: str | Column) -> Column:
    """Percent with two decimals, half-even; 0.0 when the denominator is zero or null.

    The guard comes first so ANSI mode never sees a division by zero. The order of operations
    (divide, then times 100, then round) is kept because it decides the last decimal.
    """
    num = _col(numerator).cast("double")
    den = _col(denominator).cast("double")
    return (
        F.when(den.isNull() | (den == 0), F.lit(0.0))
        .otherwise(F.bround(num / den * 100.0, 2))
        .cast("double")
    )


def signal_flag(signals_json: str | Column, key: str) -> Column:
    """1 when the JSON member is a number equal to 1, JSON ``true``, or one of the truthy strings.

    The value's JSON type decides (via ``variant``): the string ``"1.0"`` is not truthy while the
    number ``1.0`` is. Missing key, JSON null, null or unparsable document -> 0.
    """
    value = F.try_variant_get(F.try_parse_json(_col(signals_json)), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    as_string = F.try_variant_get(value, "$", "string")
    as_double = F.try_variant_get(value, "$", "double")
    truthy = (
        F.when(kind == "STRING", as_string.isin(*TRUTHY_STRINGS))
        .when(kind == "BOOLEAN", as_string == "true")
        .when(kind.isin("VOID", "NULL"), F.lit(False))
        .otherwise(as_double == 1.0)
    )
    return F.coalesce(truthy, F.lit(False)).cast("int")


def normalize_label(c: str | Column, numeric: bool = False) -> Column:
    """Label normalisation to 0/1 (nullable INT).

    ``numeric=True`` for numeric columns: the value is cast as is (bad -> null).
    Text: lower-cased, stripped of white space (tabs and line ends too), then mapped; else null.
    """
    column = _col(c)
    if numeric:
        return column.cast("string").try_cast("double").cast("int")
    norm = F.lower(strip_ws(column.cast("string")))
    expr = None
    for text, value in LABEL_TEXT_MAP.items():
        expr = (F.when(norm == text, F.lit(value)) if expr is None
                else expr.when(norm == text, F.lit(value)))
    return expr.otherwise(F.lit(None)).cast("int")


def na_to_null(c: str | Column) -> Column:
    """Strings that ``pandas.read_csv`` would read as missing become null."""
    column = _col(c)
    return F.when(column.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(column)


def sanitize_name(c: str | Column) -> Column:
    """Safe file-name component: trim, lower, runs of other characters -> '-', strip '-'."""
    replaced = F.regexp_replace(F.lower(F.trim(_col(c).cast("string"))), r"[^a-zA-Z0-9_-]+", "-")
    return F.regexp_replace(replaced, r"^-+|-+$", "")


# Whitespace as Python's unicode ``\s`` sees it (written out, so Java and RE2 agree).
_WS_CLASS = "[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# One pass: at each '<' the alternatives are tried in order -- comment, script block, style block,
# declaration, tag -- so comments and script/style bodies go before any tag inside them is seen. A
# quoted attribute value may hold '>'.
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_MARKUP = (r"(?is)<!--.*?-->|<script\b%s>.*?</script\s*>|<style\b%s>.*?</style\s*>|<![^>]*>|</?[a-z]%s>"
           % (_ATTRIBUTES, _ATTRIBUTES, _ATTRIBUTES))
# the same for Java, with possessive repeats (no backtracking, no deep stack on long tags)
_MARKUP_JAVA = _MARKUP.replace(_ATTRIBUTES, r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t else t)


#: Character references that are replaced by built-in functions (``&amp;`` last: its result is text).
COMMON_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\xa0"),
                     ("&copy;", "\xa9"), ("&reg;", "\xae"), ("&middot;", "\xb7"), ("&laquo;", "\xab"), ("&raquo;", "\xbb"),
                     ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&lsquo;", "\u2018"),
                     ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&bull;", "\u2022"),
                     ("&euro;", "\u20ac"), ("&amp;", "&"))
_OTHER_REFERENCE = "&(?!(?:%s))[#A-Za-z]" % "|".join(name[1:] for name, _ in COMMON_REFERENCES)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, as HTML defines them.

    A text whose references are all common ones is decoded in the JVM; only texts with any other
    reference travel to Python (whole, so nothing is decoded twice).
    """
    plain = text
    for reference, char in COMMON_REFERENCES:
        plain = F.replace(plain, F.lit(reference), F.lit(char))
    other = text.rlike(_OTHER_REFERENCE)
    return F.coalesce(_unescape(F.when(other, text)), plain)


def html_to_text(c: str | Column) -> Column:
    """HTML -> visible text: comments, script/style blocks and tags out (tags become a space), all
    character references decoded, white space collapsed, trimmed; null -> ''."""
    text = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), _MARKUP_JAVA, " ")
    return strip_ws(F.regexp_replace(decode_entities(text), _WS_CLASS, " "))


#: Character references that the given pages use, for the SQL below (DuckDB cannot decode all).
SQL_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"),
                ("&middot;", "·"), ("&amp;", "&"))


def html_to_text_sql(column_sql: str) -> str:
    """The same cleanup as :func:`html_to_text`, as DuckDB SQL text (for oracles)."""
    expr = f"coalesce(CAST({column_sql} AS VARCHAR), '')"
    pattern = _MARKUP.replace("'", "''")
    expr = f"regexp_replace({expr}, '{pattern}', ' ', 'g')"
    for entity, char in SQL_ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char}')"
    expr = f"regexp_replace({expr}, '{_WS_CLASS}', ' ', 'g')"
    return strip_ws_sql(expr)


def join_text(*cols: str | Column, sep: str = " [SEP] ") -> Column:
    """``subject [SEP] description [SEP] body`` with nulls as '', trimmed."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return strip_ws(F.concat_ws(sep, *parts))


def strip_ws(c: Column) -> Column:
    """Python's ``str.strip()``: leading and trailing whitespace of any kind removed."""
    return F.regexp_replace(c, f"^{_WS_CLASS}|{_WS_CLASS}$", "")


def strip_ws_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS_CLASS}|{_WS_CLASS}$', '', 'g')"


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lookup(c: str | Column, table: dict, default: float = 0.0) -> Column:
    """Small literal mapping as a CASE expression; unknown -> default."""
    column = _col(c)
    expr = reduce(lambda acc, kv: acc.when(column == kv[0], F.lit(kv[1])),
                  list(table.items())[1:],
                  F.when(column == list(table)[0], F.lit(list(table.values())[0])))
    return expr.otherwise(F.lit(default)).cast("double")


def keyed_uniform(seed: int | str, *keys: str | Column) -> Column:
    """Deterministic U[0,1) from md5(seed|key...): first 32 bits / 2^32.

    Unlike ``rand(seed)`` it does not depend on partitioning or task order, so the same rows get
    the same draws at any scale and in DuckDB (``keyed_uniform_sql``).
    """
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed_bernoulli(p: Column, seed: int | str, *keys: str | Column) -> Column:
    return (keyed_uniform(seed, *keys) < p).cast("int")


def keyed_uniform_sql(seed: int | str, *key_sql: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(CAST(CAST(('0x' || substr(md5({parts}), 1, 8)) AS UBIGINT) AS DOUBLE) / 4294967296.0)"
