"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding (operator 4).

Folding maps accents, look-alike letters of other scripts, digits and symbols used as letters to
one plain letter (``l`` and ``1`` both become ``i``), drops zero-width and combining characters,
and turns everything else into a blank. It is applied alike when the lexicon is learned and when
texts are scored.

Learning (labelled rows only, a bounded sample of them):

1. per folded word and per word prefix, the toxic and clean documents that hold it are counted (a
   Spark aggregate); entries with enough support and a log-odds weight (less one standard error)
   above ``min_weight`` make the lexicon, a longer prefix only where it says more than a shorter;
2. two-word phrases around lexicon hits that stand mostly in clean documents are exception
   phrases (a caller's own list is added);
3. a logistic regression turns the length-normalised weight into a probability.

For 2 and 3 a lexicon learned from one half of the sample is applied to the other half, so both see
texts that the lexicon has not seen; the final lexicon comes from the whole sample.

Scoring scans each whole text once. The lexicon and the phrases are bounded by
``max_lexicon``, so broadcasting them is; documents are never shuffled. Labels of held-out rows,
language, source and id never enter a score.

Cases: null and empty texts get the score of a text without hits; a document without a label is
only scored; null labels are not learned from; repeated rows get equal scores; without labels of
both kinds the score is the smoothed share of toxic labels; clashing input columns are replaced.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import add_columns, scratch

#: Digits and symbols written for letters, and letters of other scripts that look
#: like Latin ones (lower case).
SUBSTITUTED = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
               "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i", "ł": "i", "ı": "i"}
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i",
              "ї": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "н": "h", "о": "o", "р": "p",
              "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "з": "e",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
              "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ɑ": "a", "ɡ": "g",
              "ո": "n", "օ": "o", "ս": "u", "ց": "g"}
PREFIXES = (4, 5, 6, 7)
_table: dict[int, str] = {}
_machines: dict = {}


def _fold_char(ch: str) -> str:
    out = []
    for c in unicodedata.normalize("NFKD", ch.casefold()):
        kind = unicodedata.category(c)
        c = LOOKALIKES.get(c, c)
        c = SUBSTITUTED.get(c, c)
        if kind in ("Mn", "Me", "Cf"):
            continue
        out.append(c if c.isalnum() else " ")
    return "".join(out)


def fold(text: str) -> str:
    """Plain lower-case letters and blanks; code points from 0x3000 on stay as they are."""
    if not _table:
        _table.update({i: _fold_char(chr(i)) for i in range(0x3000)})
        for i in range(0xFF01, 0xFF5F):  # full-width forms
            _table[i] = _fold_char(chr(i))
    return text.translate(_table)


def _features(words) -> set[str]:
    """Folded words (``w `` with a closing blank) and their prefixes."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w + " ")
            out.update(w[:n] for n in PREFIXES if len(w) > n)
    return out


def build(lexicon: dict[str, float], exceptions: set[str]):
    """Automaton over `` entry`` (weight) and `` phrase `` (exempt)."""
    import ahocorasick
    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        machine.add_word(" " + entry, (weight, entry.endswith(" "), 1))
    for phrase in exceptions:
        machine.add_word(" " + phrase + " ", (None, True, phrase.count(" ") + 1))
    if len(machine):
        machine.make_automaton()
    return machine


def _machine(key, shared):
    if key not in _machines:
        _machines.clear()
        _machines[key] = build(*shared.value)
    return _machines[key]


def hits(text: str | None, machine) -> tuple[list[str], dict[int, float]]:
    """Folded words and the weight of each word that the lexicon hits outside exceptions."""
    words = fold(text or "").split()
    if not words or not len(machine):
        return words, {}
    line = " " + " ".join(words) + " "
    found: dict[int, float] = {}
    exempt: set[int] = set()
    at, word = 0, -1
    for end, (weight, closed, size) in machine.iter(line):
        word += line.count(" ", at, end + 1)  # blanks up to here; the word that stands at ``end``
        at = end + 1
        last = word - 1 if closed else word
        if weight is None:
            exempt.update(range(last - size + 1, last + 1))
        elif weight > found.get(last, 0.0):
            found[last] = weight
    return words, {i: w for i, w in found.items() if i not in exempt}


def measures(n_words: int, found: dict[int, float]) -> tuple[float, float, float]:
    """Strongest hit, total weight, and total weight normalised by length."""
    total = sum(found.values())
    return max(found.values(), default=0.0), total ** 0.5, total / (n_words + 20.0) ** 0.5


def _outside(words: list[str], phrases: set[str]) -> list[str]:
    """The words that stand in none of the phrases."""
    if not phrases:
        return words
    sizes = {p.count(" ") + 1 for p in phrases}
    inside = {k for n in sizes for i in range(len(words) - n + 1)
              if " ".join(words[i:i + n]) in phrases for k in range(i, i + n)}
    return [w for i, w in enumerate(words) if i not in inside]


def learn_lexicon(sample: DataFrame, exceptions: frozenset = frozenset(), min_support: int = 4,
                  min_weight: float = 2.0, max_lexicon: int = 5000) -> dict[str, float]:
    """``sample(text, toxic)`` -> entry -> weight (log-odds of a document being toxic); words inside
    the given exception phrases do not count."""
    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("toxic")):
                seen[y.as_py()].update(_features(_outside(
                        fold(text.as_py() or "").split(), exceptions)))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield from flush(seen)
        yield from flush(seen)

    def flush(seen):
        for y, counter in seen.items():
            if counter:
                yield pa.RecordBatch.from_pydict({
                    "entry": pa.array(list(counter), pa.string()),
                    "toxic": pa.array([n * y for n in counter.values()], pa.int64()),
                    "clean": pa.array([n * (1 - y) for n in counter.values()], pa.int64())})
            counter.clear()

    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
        return {}
    counts = sample.mapInArrow(count, "entry string, toxic long, clean long") \
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0)) \
        - F.sqrt(1.0 / (F.col("toxic") + 0.5) + 1.0 / (F.col("clean") + 0.5))
    kept = counts.filter(F.col("toxic") >= min_support).withColumn("weight", weight) \
        .filter(F.col("weight") >= min_weight) \
        .orderBy((F.col("weight") * F.sqrt("toxic")).desc(), "entry").limit(max_lexicon).collect()
    lexicon: dict[str, float] = {}
    for row in sorted(kept, key=lambda r: len(r.entry.rstrip())):
        stem = row.entry.rstrip()
        shorter = max((lexicon[stem[:n]] for n in range(1, len(stem)) if stem[:n] in lexicon), default=None)
        if shorter is None or row.weight > shorter + 0.5:
            lexicon[row.entry] = float(row.weight)
    return lexicon


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], min_support: int = 3,
                     max_phrases: int = 5000) -> set[str]:
    """Two-word phrases around hits that stand at least four times as often in clean documents."""
    if not lexicon:
        return set()
    machine_key = uuid.uuid4().hex
    shared = sample.sparkSession.sparkContext.broadcast((lexicon, set()))

    def phrases(batches):
        machine = _machine(machine_key, shared)
        for batch in batches:
            out, label = [], []
            for text, y in zip(batch.column("text"), batch.column("toxic")):
                words, found = hits(text.as_py(), machine)
                near = {f"{words[i - 1]} {words[i]}" for i in found if i} | \
                       {f"{words[i]} {words[i + 1]}" for i in found if i + 1 < len(words)}
                out += near
                label += [y.as_py()] * len(near)
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(out, pa.string()),
                                              "toxic": pa.array(label, pa.int32())})

    rows = sample.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("clean"))
    rows = rows.filter((F.col("clean") >= min_support) & (F.col("clean") >= 4 * F.col("bad")))
    return {r.phrase for r in rows.orderBy(F.col("clean").desc(), "phrase").limit(max_phrases).collect()}


class Model:
    """Lexicon, exception phrases and the calibration; ``score`` adds columns to documents."""

    def __init__(self, lexicon, exceptions, weights, bias):
        self.lexicon, self.exceptions, self.weights, self.bias = lexicon, exceptions, weights, bias

    def measure(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` plus ``lexicon_hits, max_weight, total_weight, length_weight``."""
        shared = docs.sparkSession.sparkContext.broadcast((self.lexicon, self.exceptions))
        key = uuid.uuid4().hex

        def make(batch):
            machine = _machine(key, shared)
            n, rows = [], []
            for value in batch.column(text_col):
                words, found = hits(value.as_py(), machine)
                n.append(len(found))
                rows.append(measures(len(words), found))
            return [pa.array(n, pa.int64())] + [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]

        typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
        return add_columns(typed, [T.StructField("lexicon_hits", T.LongType()),
                                   T.StructField("max_weight", T.DoubleType()),
                                   T.StructField("total_weight", T.DoubleType()),
                                   T.StructField("length_weight", T.DoubleType())], make)

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` plus ``lexicon_hits, score, predicted``."""
        kept = [c for c in docs.columns if c not in ("lexicon_hits", "score", "predicted")]
        a, b, c = self.weights
        z = F.lit(a) * F.col("max_weight") + F.lit(b) * F.col("total_weight") + \
            F.lit(c) * F.col("length_weight") + F.lit(self.bias)
        names = {"max_weight", "total_weight", "length_weight"}
        out = self.measure(docs.select(*[x for x in kept if x not in names]), text_col)
        out = out.withColumn("score", 1.0 / (1.0 + F.exp(-z)))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")) \
            .drop("max_weight", "total_weight", "length_weight")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_training_rows: int = 20_000, exceptions=(),
        seed: int = 4, **lexicon_options) -> Model:
    """Learn from at most ``max_training_rows`` labelled rows (the least of a keyed hash)."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")) \
        .filter("toxic in (0, 1) and _id is not null") \
        .orderBy(F.xxhash64(F.col("_id"), F.lit(seed)), "_id", "toxic").limit(max_training_rows)
    sample = scratch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
                     .join(F.broadcast(chosen), "_id")
                     .select("text", "toxic", (F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(2)) == 0)
                             .alias("first")), "toxic")
    learn, fit_on = sample.filter("first"), sample.filter("not first")
    given = frozenset(" ".join(fold(p).split()) for p in exceptions) - {""}
    lexicon = learn_lexicon(learn, given, **lexicon_options)
    phrases = learn_exceptions(fit_on, lexicon) | given
    total, bad = fit_on.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = Model(lexicon, phrases, (0.0, 0.0, 0.0), 0.0)
    share = (bad + 0.5) / (total + 1.0)
    if not lexicon or bad in (0, total):
        model.bias = math.log(share / (1 - share))
        return model
    train = VectorAssembler(inputCols=["max_weight", "total_weight", "length_weight"],
                            outputCol="features").transform(
        model.measure(fit_on, "text").withColumn("label", F.col("toxic").cast("double")))
    fitted = LogisticRegression(regParam=1e-3, maxIter=50).fit(train)
    model.weights, model.bias = tuple(map(float, fitted.coefficients)), float(fitted.intercept)
    model.lexicon = learn_lexicon(sample, given, **lexicon_options)
    return model

