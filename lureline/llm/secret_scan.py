"""Secret scans by rules and character Markov models (operator 13).

Three rules find what has a known form (``RULES``). The method finds the others: runs of token
characters that look drawn at random. Two character models are compared by the ratio of their
likelihoods:

* *ordinary*: what identifiers and words are made of. The probability of a character after the two
  before it, backed off to one, to none (a count that grows with the corpus: every distinct run of 4
  to 19 characters outside the rules' matches is a sample labelled ordinary);
* *random*: one model per kind of alphabet (which of lower case, upper case, digits and symbols a
  string uses), since a random string is uniform over some alphabet. The probability of a character
  after the one before it is half learned from the samples labelled secret (the distinct values
  that the rules match) and half uniform over the alphabet, so unseen kinds have a model as well.

A run of at least ``min_length`` characters and ``min_distinct`` different ones is a secret where

    log P(run | random) - log P(run | ordinary) >= min_ratio

(natural logarithm; 14 is prior odds of about one in a million). Both models are tables of counts
over the 68 token characters, so their size does not depend on the corpus. Samples may be given
(``fit``), or are labelled by the rules (``label_samples``).

Cases: null and empty texts have no spans; rows that repeat an id are scanned each; without samples
of a label that model is its uniform part; an empty table gives no rows; input columns that clash
with a result column are replaced; a very long text is scanned whole. Offsets are code points, the
end exclusive; an ``assign`` span is the whole match, its value the second group.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import add_columns, scratch

#: The rules' patterns and the least number of characters of what they match.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
KINDS = (*(r[0] for r in RULES), "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-.="
SIZE = len(ALPHABET) + 1  # and the edge of a run, number 0
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)
_KIND = np.zeros(SIZE, np.int64)
for _k, _c in enumerate(ALPHABET, 1):
    _KIND[_k] = 1 if _c.islower() else 2 if _c.isupper() else 4 if _c.isdigit() else 8

_RUN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_-]*[A-Za-z0-9])?={0,2}")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # the same matches as the rule's, without the short ones

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("ratio", T.DoubleType())])
FIELDS = [T.StructField("spans", T.ArrayType(SPAN))]


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """``(start, kind number, end, value's start, value's end)`` of the rules' matches, in order."""
    out = []
    for k, (name, pattern, group, least) in enumerate(RULES):
        for m in (_LONG_HEX if name == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end(), m.start(group), m.end(group)))
    return sorted(out)


def runs_outside(text: str, taken) -> list[tuple[int, int]]:
    """Runs of token characters that no match of a rule touches."""
    spans = sorted((s[0], s[2]) for s in taken)
    out, at = [], 0
    for m in _RUN.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            out.append(m.span())
    return out


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers of the strings, each between edges (0), and where each begins."""
    joined = "\0\0" + "\0\0".join(strings) + "\0"
    ends = np.cumsum([len(s) + 2 for s in strings]) if strings else np.empty(0, np.int64)
    return _CODE[np.frombuffer(joined.encode("ascii", "replace"), np.uint8)], np.concatenate([[0], ends[:-1]]).astype(np.int64) + 2 \
        if len(ends) else ends


def label_samples(docs: DataFrame, text_col: str = "text", longest: int = 19) -> DataFrame:
    """``sample, secret``: distinct values of the rules' matches, and distinct ordinary runs."""
    def run(batches):
        seen: set = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                taken = base_spans(text)
                seen.update((text[a:b], True) for _, _, _, a, b in taken)
                cut, at = [], 0
                for s in taken:  # what lies between the matches, without a copy per character
                    if s[0] > at:
                        cut.append(text[at:s[0]])
                    at = max(at, s[2])
                cut.append(text[at:])
                for part in cut:
                    seen.update((w, False) for w in set(_RUN.findall(part)) if 4 <= len(w) <= longest)
                if len(seen) > 200_000:
                    yield flush(seen)
                    seen.clear()
        yield flush(seen)

    def flush(seen):
        return pa.RecordBatch.from_pydict({"sample": pa.array([s for s, _ in seen], pa.string()),
                                           "secret": pa.array([s for _, s in seen], pa.bool_())})

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "sample string, secret boolean").distinct()


def count_grams(samples: DataFrame, sample_col: str = "sample", label_col: str = "secret") -> DataFrame:
    """``secret, kind, gram, n``: trigrams per label and kind of alphabet (bounded by the alphabet)."""
    def run(batches):
        total: dict = {}
        for batch in batches:
            strings, labels = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for secret in (False, True):
                own = [s for s, l in zip(strings, labels) if s and bool(l) == secret]
                if not own:
                    continue
                code, first = codes(own)
                at = np.flatnonzero(code > 0)
                gram = (code[at - 2] * SIZE + code[at - 1]) * SIZE + code[at]
                kind = np.bitwise_or.reduceat(_KIND[code], first)[np.searchsorted(first, at, side="right") - 1]
                values, n = np.unique(kind * SIZE ** 3 + gram, return_counts=True)
                held = total.setdefault(secret, {})
                for v, c in zip(values.tolist(), n.tolist()):
                    held[v] = held.get(v, 0) + c
        for secret, held in total.items():
            v = np.array(list(held), np.int64)
            yield pa.RecordBatch.from_pydict({
                "secret": pa.array([secret] * len(v)), "kind": pa.array(v // SIZE ** 3),
                "gram": pa.array(v % SIZE ** 3), "n": pa.array(list(held.values()), pa.int64())})

    chosen = samples.filter(F.col(sample_col).isNotNull() & F.col(label_col).isNotNull()) \
        .select(F.col(sample_col).cast("string"), F.col(label_col).cast("boolean"))
    return chosen.mapInArrow(run, "secret boolean, kind long, gram long, n long") \
        .groupBy("secret", "kind", "gram").agg(F.sum("n").alias("n"))


def _ordinary(three: np.ndarray, strength: float) -> np.ndarray:
    """log P(character | two before it), each order backed off to the shorter one."""
    one = three.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = three.sum(axis=0)
    two = (two + strength * one) / (two.sum(axis=1, keepdims=True) + strength)
    return np.log((three + strength * two[None]) / (three.sum(axis=2, keepdims=True) + strength))


def _random(pairs: np.ndarray, learned: float) -> np.ndarray:
    """log P(character | the one before it) per kind of alphabet."""
    out = np.empty((16, SIZE, SIZE))
    for kind in range(16):
        of = np.array([bool(k & kind) for k in _KIND])
        uniform = np.where(of, 1.0 / max(1, of.sum()), 1.0 / SIZE)
        seen = pairs[kind] * of
        total = seen.sum(axis=1, keepdims=True)
        out[kind] = np.log(np.where(total > 0, learned * seen / np.maximum(total, 1) + (1 - learned) * uniform, uniform))
    return out


class SecretModel:
    """Both character models and the thresholds; small enough to travel with the task."""

    def __init__(self, ordinary: np.ndarray, random: np.ndarray, min_length: int, min_distinct: int, min_ratio: float):
        self.ordinary, self.random = ordinary.astype(np.float32), random.astype(np.float32)
        self.min_length, self.min_distinct, self.min_ratio = min_length, min_distinct, min_ratio

    def ratios(self, strings: list[str]) -> np.ndarray:
        """log P(string | random) - log P(string | ordinary) of every (non-empty) string."""
        if not strings:
            return np.empty(0)
        code, first = codes(strings)
        at = np.flatnonzero(code > 0)
        of = np.searchsorted(first, at, side="right") - 1
        kind = np.bitwise_or.reduceat(_KIND[code], first)[of]
        ratio = self.random[kind, code[at - 1], code[at]] - self.ordinary[code[at - 2], code[at - 1], code[at]]
        return np.bincount(of, ratio, minlength=len(strings))

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """Spans of every text, by start, then kind."""
        found, where, strings = [], [], []
        for i, text in enumerate(texts):
            taken = base_spans(text) if text else []
            found.append([(s[0], s[1], s[2], None) for s in taken])
            if not text or max(map(len, text.split()), default=0) < self.min_length:
                continue  # a run holds no white space
            for a, b in runs_outside(text, taken):
                if b - a >= self.min_length and len(set(text[a:b])) >= self.min_distinct:
                    where.append((i, a, b))
                    strings.append(text[a:b])
        for (i, a, b), ratio in zip(where, self.ratios(strings).tolist()):
            if ratio >= self.min_ratio:
                found[i].append((a, len(RULES), b, ratio))
        return [[{"kind": KINDS[k], "start": a, "end": b, "ratio": r} for a, k, b, r in sorted(own, key=lambda s: s[:3])]
                for own in found]

    def find(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` plus ``spans`` (kind, start, end, ratio; the ratio is null for a rule's match)."""
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                    ("ratio", pa.float64())]))
        typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
        return add_columns(typed, FIELDS, lambda batch: [pa.array(self.scan(batch.column(text_col).to_pylist()), kinds)])


def fit(samples: DataFrame, sample_col: str = "sample", label_col: str = "secret", min_length: int = 20,
        min_distinct: int = 8, min_ratio: float = 14.0, strength: float = 4.0, learned: float = 0.5) -> SecretModel:
    """Learn both models from labelled samples (``label_col`` true: a secret)."""
    ordinary, random = np.zeros((SIZE, SIZE, SIZE)), np.zeros((16, SIZE, SIZE))
    grams = count_grams(samples, sample_col, label_col)
    last = F.col("gram") % (SIZE * SIZE)
    for r in grams.filter("not secret").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 69**3 rows
        ordinary[r.gram // SIZE ** 2, r.gram // SIZE % SIZE, r.gram % SIZE] = r.n
    for r in grams.filter("secret").groupBy("kind", last.alias("pair")).agg(F.sum("n").alias("n")).collect():
        random[r.kind, r.pair // SIZE, r.pair % SIZE] = r.n
    return SecretModel(_ordinary(ordinary, strength), _random(random, learned), min_length, min_distinct, min_ratio)


def fit_by_rules(docs: DataFrame, text_col: str = "text", **settings) -> SecretModel:
    """Learn from the documents themselves, with the rules as the source of labels."""
    return fit(scratch(label_samples(docs, text_col), "samples"), **settings)


def said(spans="spans", base: bool = False):
    """``kind:start:end`` of all spans (or of the rules' ones), comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"] != KINDS[-1]) if base else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(found: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``found`` (with ``spans``) with every maximal stretch of spans replaced by ``mask``."""
    edges = F.aggregate("spans", F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
                        lambda acc, s: F.struct(
                            F.greatest(acc["at"], s["end"] + 1).alias("at"),
                            F.when((F.size(acc["parts"]) == 0) | (s["start"] + 1 > acc["at"]), F.concat(acc["parts"], F.array(
                                F.substring(F.col(text_col), acc["at"], s["start"] + 1 - acc["at"]))))
                            .otherwise(acc["parts"]).alias("parts")))
    kept = found.withColumn("_cut", edges)
    tail = F.substring(F.col(text_col), F.col("_cut.at"), F.length(text_col))
    return kept.withColumn(text_col, F.when(F.size("spans") > 0, F.concat(
        F.array_join("_cut.parts", mask), F.lit(mask), tail)).otherwise(F.col(text_col))).drop("_cut")
