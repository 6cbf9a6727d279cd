"""Brown class-based bigram model with exchange clustering (operator 1).

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end mark per text, which is also
what precedes the first word. The model's probability of a token after its predecessor is

    P(class of the token | class of the predecessor) * P(token | class)

1. Words of all training texts are counted (combined per task, then by Spark); the table grows
   with the corpus and stays in the shared folder.
2. Every word belongs to an *item*: the ``own_items`` most frequent words (and the end mark) are
   items of their own, all others share one of ``group_items`` items by their last characters. So
   rare and unseen words have an item as well. Every training text is written once as the numbers
   of its tokens (a word that step 4 places, or an item); this and all later counts read these.
   Bigrams of items over the whole training text are counted; this table is bounded by the number
   of items, not by the corpus.
3. Exchange clustering moves items between ``classes`` classes, each to where the likelihood of
   the class bigrams grows most, until few move.
4. Then the vocabulary, which grows with the corpus, is placed: every other word seen at least
   ``own_count`` times (among the ``head_words`` most frequent) goes from its group's class to the one
   where its own counts of preceding and following classes raise the same likelihood most. These
   counts are one Spark aggregate, the words are placed in parallel, and the class bigrams are
   counted again. Only rarer and unseen words keep the class of their last characters.
5. Transitions are smoothed with the class frequencies; emissions by absolute discounting, whose
   freed mass is the probability of an unseen word of that class. Both sum to one.
6. Scoring reads every text once. Words above a count threshold (at most ``head_words``) are
   looked up in a broadcast table; the counts of all other words come from a join with the whole
   vocabulary, summed per text. The frequent words, which would make hot keys, never enter the join.

Cases: null and empty texts consist of the end mark; a null id is treated as an empty text by the
held-out rule; repeated rows are scored each; without training texts the score is that of a model
that has seen nothing (finite); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import crc_mod5, drop_scratch, scratch

END = b"\n"  # cannot be a word
_cached: dict = {}


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 (without the end mark)."""
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def _strings(words) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _shared(key: str, make):
    if key not in _cached:
        _cached.clear()
        _cached[key] = make()
    return _cached[key]


class Items:
    """Word -> item number: own items first, then groups by the last characters."""

    def __init__(self, own: list[bytes], groups: int):
        self.own, self.groups = own, groups
        self.known = {w: i for i, w in enumerate(own)}
        self.count = len(own) + groups

    def __call__(self, word: bytes) -> int:
        item = self.known.get(word)
        if item is None:
            if len(self.known) > 400_000:  # a cache; own items stay
                self.known = {w: i for i, w in enumerate(self.own)}
            item = len(self.own) + zlib.crc32(word[-3:]) % self.groups
            self.known[word] = item
        return item


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` over all texts, the end mark included."""
    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                words.append(END)
                seen.update(words)
                if len(seen) > 300_000:
                    yield flush(seen)
                    seen.clear()
        if seen:
            yield flush(seen)

    def flush(seen):
        return pa.RecordBatch.from_pydict({"word": _strings(list(seen)),
                                           "c": pa.array(list(seen.values()), pa.int64())})

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Codes(dict):
    """Word -> ``items.count`` + its place in ``words``, or the number of its item."""

    def __init__(self, items: Items, words: list[bytes]):
        super().__init__(zip(words, range(items.count, items.count + len(words))))
        self.update(zip(items.own, range(len(items.own))))
        self.base, self.groups = len(items.own), items.groups

    def __missing__(self, word: bytes) -> int:
        return self.base + zlib.crc32(word[-3:]) % self.groups


def encode_texts(texts: DataFrame, items: Items, words: list[bytes]) -> DataFrame:
    """``codes``: the tokens of each text as numbers by :class:`Codes`; the last one is the end mark's.

    The one reading of the texts that looks words up; what is counted afterwards is counted from it.
    """
    shared, key = texts.sparkSession.sparkContext.broadcast((items.own, items.groups, words)), uuid.uuid4().hex

    def load():
        own, groups, listed = shared.value
        return Codes(Items(own, groups), listed)

    def flush(stream, ends):
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.array(stream, np.int32)))], names=["codes"])

    def run(batches):
        codes = _shared(key, load)
        code, end = codes.__getitem__, codes[END]
        for batch in batches:
            stream, ends = [], [0]
            for text in batch.column(0).to_pylist():
                stream.extend(map(code, tokens(text)))
                stream.append(end)
                ends.append(len(stream))
                if len(stream) > 1 << 20:
                    yield flush(stream, ends)
                    stream, ends = [], [0]
            if stream:
                yield flush(stream, ends)

    return texts.mapInArrow(run, "codes array<int>")


def _encoded(texts: DataFrame, items: Items, words: list[bytes]) -> DataFrame:
    """Texts that are encoded already are taken as they are."""
    return texts if texts.columns == ["codes"] and isinstance(texts.schema["codes"].dataType, T.ArrayType) \
        else encode_texts(texts, items, words)


def _places(items: Items, words: list[bytes]) -> np.ndarray:
    """Item of every code."""
    return np.concatenate([np.arange(items.count), np.array([items(w) for w in words], np.int64)])


def _streams(batches, size: int = 1 << 20):
    """Codes of at most ``size`` tokens at a time, each time with the one before them in front."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy()
        line = np.concatenate([flat[-1:], flat])  # the last code is an end mark
        for lo in range(0, len(flat), size):
            yield line[lo:lo + size + 1]


def count_bigrams(codes: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Bigram counts of ``of[code]``, which is below ``size``; predecessor by row."""
    shared = codes.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        table, number = np.zeros(size * size, np.int64), shared.value
        for line in _streams(batches):
            at = number[line]
            table += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        hit = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(hit), "n": pa.array(table[hit])})

    rows = codes.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size ** 2)
    table[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return table.reshape(size, size)


def count_contexts(texts: DataFrame, items: Items, label: np.ndarray, words: list[bytes], classes: int) -> DataFrame:
    """``word`` (place in ``words``), ``side`` (class that follows, or ``classes`` + class before), ``n``.

    ``texts``: texts, or their codes by :func:`encode_texts` with the same ``words``."""
    shared = texts.sparkSession.sparkContext.broadcast(label[_places(items, words)])
    first, width = items.count, 2 * classes

    def run(batches):
        seed = shared.value
        for line in _streams(batches):
            cls, word = seed[line], line.astype(np.int64) - first
            here = np.flatnonzero(word >= 0)
            after, before = here[here < len(line) - 1], here[here > 0]
            pair, n = np.unique(np.concatenate([word[after] * width + cls[after + 1],
                                                word[before] * width + classes + cls[before - 1]]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(n.astype(np.int64))})

    return _encoded(texts, items, words).mapInArrow(run, "pair long, n long") \
        .groupBy("pair").agg(F.sum("n").alias("n")).select(
        F.floor(F.col("pair") / width).alias("word"), (F.col("pair") % width).alias("side"), "n")


def best_classes(joint: np.ndarray, old: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Per word the class with the greatest likelihood of the class bigrams ``joint``, from which the
    word's own (by its ``old`` class) are taken out; ``right``, ``left``: its counts by class."""
    rest, k = np.repeat(joint[None], len(old), axis=0), np.arange(len(old))
    rest[k, old, :] -= right
    rest[k, :, old] -= left
    rest = np.maximum(rest, 0.0)
    turned = rest.transpose(0, 2, 1)
    base = _xlogx(rest)
    gain = (_xlogx(rest + right[:, None, :]) - base).sum(axis=2)
    gain += (_xlogx(turned + left[:, None, :]) - base.transpose(0, 2, 1)).sum(axis=2)
    diag = rest[:, np.arange(len(joint)), np.arange(len(joint))]
    gain += _xlogx(diag + right + left) - _xlogx(diag + right) - _xlogx(diag + left) + _xlogx(diag)
    rows, cols = rest.sum(axis=2) + left, rest.sum(axis=1) + right
    out, into = right.sum(axis=1, keepdims=True), left.sum(axis=1, keepdims=True)
    gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(cols + into) - _xlogx(cols)
    new = gain.argmax(axis=1)
    return np.where(gain[k, new] > gain[k, old] + 1e-9, new, old)


def place_words(texts: DataFrame, items: Items, label: np.ndarray, joint: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Class of every word of ``words`` by its own neighbours (at most ``len(words)`` rows come back).

    ``texts``: texts, or their codes by :func:`encode_texts` with the same ``words``."""
    classes = len(joint)
    old = np.array([label[items(w)] for w in words], np.int64)
    contexts = count_contexts(texts, items, label, words, classes).groupBy("word").agg(
        F.collect_list("side").alias("sides"), F.collect_list("n").alias("ns"))  # at most 2 x classes each
    shared = texts.sparkSession.sparkContext.broadcast((joint, old))

    def run(batches):
        table, before = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):  # 128 words x classes squared at a time
                part = batch.slice(lo, 128)
                at = part.column("word").to_numpy()
                sides, ns = part.column("sides"), part.column("ns")
                row = np.repeat(np.arange(len(at)), np.diff(sides.offsets.to_numpy()))
                seen = np.zeros((len(at), 2 * classes))
                seen[row, sides.flatten().to_numpy()] = ns.flatten().to_numpy()
                new = best_classes(table, before[at], seen[:, :classes], seen[:, classes:])
                yield pa.RecordBatch.from_pydict({"word": pa.array(at), "cls": pa.array(new)})

    rows = contexts.mapInArrow(run, "word long, cls long").toArrow()
    cls = old.copy()
    cls[rows.column("word").to_numpy()] = rows.column("cls").to_numpy()
    return cls


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of every item; each item moves to the class that raises the likelihood most."""
    size = len(bigrams)
    freq = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-freq, kind="stable")
    label = np.empty(size, np.int64)
    label[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), label] = 1.0
    right, left = bigrams @ member, bigrams.T @ member  # item -> class, class -> item
    joint = member.T @ right
    for _ in range(rounds):
        moved = 0
        for i in order:
            if not freq[i]:
                continue
            old, own = label[i], bigrams[i, i]
            r, l = right[i].copy(), left[i].copy()
            r[old] -= own
            l[old] -= own
            # take the item out
            joint[old, :] -= r
            joint[:, old] -= l
            joint[old, old] -= own
            rows, cols = joint.sum(axis=1) + l, joint.sum(axis=0) + r
            base = _xlogx(joint)
            gain = (_xlogx(joint + r) - base).sum(axis=1) + (_xlogx(joint.T + l) - base.T).sum(axis=1)
            diag = np.diagonal(joint)
            gain += _xlogx(diag + r + l + own) - _xlogx(diag + r) - _xlogx(diag + l) + _xlogx(diag)
            out, into = r.sum() + own, l.sum() + own
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(cols + into) - _xlogx(cols)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            joint[new, :] += r
            joint[:, new] += l
            joint[new, new] += own
            if new != old:
                moved += 1
                label[i] = new
                right[:, old] -= bigrams[:, i]
                right[:, new] += bigrams[:, i]
                left[:, old] -= bigrams[i, :]
                left[:, new] += bigrams[i, :]
        if moved <= size // 200:
            break
    return label


class BrownModel:
    """A fitted model; ``score`` gives one row per text."""

    def __init__(self, vocabulary, items, label, joint, threshold, placed):
        """``joint``: bigrams of classes; ``placed``: words of classes of their own, and these."""
        self.items, self.label, self.classes, self.threshold = items, label, len(joint), threshold
        classes = self.classes
        self.class_tokens = joint.sum(axis=0)
        share = (self.class_tokens + 0.5) / (self.class_tokens.sum() + 0.5 * classes)
        weight = 5.0
        self.transition = np.log10((joint + weight * share) / (joint.sum(axis=1, keepdims=True) + weight))
        spark = vocabulary.sparkSession
        shared, key = spark.sparkContext.broadcast((items.own, items.groups, label, *placed)), uuid.uuid4().hex

        def classify(batches):
            own, groups, labels, words, cls = shared.value
            codes = _shared(key, lambda: Codes(Items(own, groups), words))
            of = np.concatenate([labels, cls]).astype(np.int32)
            for batch in batches:
                code = map(codes.__getitem__, batch.column("word").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word"), batch.column("c"), pa.array(of[np.fromiter(code, np.int64, batch.num_rows)])],
                    names=["word", "c", "cls"])

        self.vocabulary = scratch(vocabulary.mapInArrow(classify, "word string, c long, cls int"), "vocabulary")
        per_class = self.vocabulary.groupBy("cls").agg(
            F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"),
            F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()
        self.tokens, self.words = sum(r.n for r in per_class), sum(r.v for r in per_class)
        once, twice = sum(r.once for r in per_class), sum(r.twice for r in per_class)
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        unseen = np.ones(classes)
        for r in per_class:
            unseen[r.cls] = self.discount * r.v / r.n
        self.unseen = np.log10(unseen)
        self.total = np.log10(np.maximum(self.class_tokens, 1.0))
        head = self.vocabulary.filter(F.col("c") >= (self.threshold or 1 << 62)).toArrow()
        self.head = (head.column("word").cast(pa.binary()).to_pylist(), head.column("c").to_numpy(), head.column("cls").to_numpy())

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``<id>, n_tokens, n_known, train_tokens, base_score, score`` per row."""
        spark = docs.sparkSession
        base_total = np.log10(self.tokens + 0.5 * (self.words + 1))
        state = (self.head, self.items.own, self.items.groups, self.label, self.transition, self.total,
                 self.discount, base_total)
        shared, key = spark.sparkContext.broadcast(state), uuid.uuid4().hex

        def load():
            (words, counts, cls), own, groups, label, transition, total, discount, denominator = shared.value
            counts = np.asarray(counts, float)
            cls = np.asarray(cls, np.int64)
            return ({w: i for i, w in enumerate(words)}, cls, np.log10(counts + 0.5) - denominator,
                    np.log10(np.maximum(counts - discount, 1e-12)) - total[cls], Items(own, groups),
                    label.tolist(), transition)

        def run(batches):
            head, cls, base, emit, item, label, transition = _shared(key, load)
            end_class, place = int(label[item(END)]), head.get
            for batch in batches:
                out_rid, out_word, out_cls, out_n = [], [], [], []
                summary = {k: [] for k in ("id", "tokens", "known", "base", "score")}
                rids = batch.column("_rid").to_pylist()
                for rid, doc_id, text in zip(rids, batch.column("_id").to_pylist(), batch.column("text").to_pylist()):
                    words = tokens(text)
                    words.append(END)
                    at = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                    seen = at >= 0
                    of = np.empty(len(words) + 1, np.int64)
                    of[0] = end_class
                    of[1:][seen] = cls[at[seen]]
                    rare = [words[i] for i in np.flatnonzero(~seen).tolist()]
                    rare_cls = [label[item(w)] for w in rare]
                    of[1:][~seen] = rare_cls
                    known = at[seen]
                    summary["id"].append(doc_id)
                    summary["tokens"].append(len(words))
                    summary["known"].append(len(known))
                    summary["base"].append(float(base[known].sum()))
                    summary["score"].append(float(transition[of[:-1], of[1:]].sum() + emit[known].sum()))
                    times = Counter(rare)
                    out_rid.extend(repeat(rid, len(times)))
                    out_word.extend(times)
                    out_cls.extend(dict(zip(rare, rare_cls)).values())  # in the same order
                    out_n.extend(times.values())
                k = len(rids)
                doc = pa.StructArray.from_arrays(
                    [pa.array(summary["id"], batch.schema.field("_id").type), pa.array(summary["tokens"], pa.int64()),
                     pa.array(summary["known"], pa.int64()), pa.array(summary["base"], pa.float64()),
                     pa.array(summary["score"], pa.float64())], names=["id", "tokens", "known", "base", "score"])
                # the text's own row joins no word: its key holds a blank and spreads the rows
                yield pa.RecordBatch.from_pydict({
                    "_rid": pa.array(rids, pa.int64()), "word": pa.array([f" {r}" for r in rids], pa.string()),
                    "cls": pa.nulls(k, pa.int32()), "n": pa.array([0] * k, pa.int64()), "doc": doc})
                if out_rid:
                    yield pa.RecordBatch.from_pydict({
                        "_rid": pa.array(out_rid, pa.int64()), "word": _strings(out_word),
                        "cls": pa.array(out_cls, pa.int32()), "n": pa.array(out_n, pa.int64()),
                        "doc": pa.nulls(len(out_rid), doc.type)})

        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")) \
            .withColumn("_rid", F.monotonically_increasing_id())
        kind = docs.schema[id_col].dataType.simpleString()
        parts = rows.mapInArrow(run, "_rid long, word string, cls int, n long, "
                                     f"doc struct<id:{kind},tokens:bigint,known:bigint,base:double,score:double>")
        rare = self.vocabulary.filter(F.col("c") < (self.threshold or 1 << 62)).select("word", "c")
        joined = parts.join(rare, "word", "left")
        pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("cls") + 1)
        known = F.col("c").isNotNull()
        base = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - float(base_total)
        emit = F.when(known, F.log10(F.col("c") - float(self.discount)) - pick(self.total)).otherwise(pick(self.unseen))
        tail = F.col("doc").isNull()
        summed = joined.groupBy("_rid").agg(
            F.max("doc.id").alias(id_col), F.sum("doc.tokens").alias("n_tokens"),
            F.sum(F.when(tail, F.when(known, F.col("n")).otherwise(0)).otherwise(F.col("doc.known"))).alias("n_known"),
            F.sum(F.when(tail, F.col("n") * base).otherwise(F.col("doc.base"))).alias("base_score"),
            F.sum(F.when(tail, F.col("n") * emit).otherwise(F.col("doc.score"))).alias("score"))
        return summed.select(id_col, "n_tokens", "n_known", F.lit(int(self.tokens)).cast("long").alias("train_tokens"),
                             "base_score", "score")


def head_threshold(vocabulary: DataFrame, head_words: int) -> int | None:
    """The count from which at most ``head_words`` words remain, from the table of counts."""
    by_count = vocabulary.groupBy("c").agg(F.count(F.lit(1)).alias("v")).orderBy(F.col("c").desc())
    threshold, held = None, 0
    for r in by_count.toLocalIterator():
        if held + r.v > head_words:
            break
        threshold, held = r.c, held + r.v
    return threshold


def fit(texts: DataFrame, text_col: str = "text", classes: int = 64, own_items: int = 640,
        group_items: int = 384, head_words: int = 300_000, own_count: int | None = 5) -> BrownModel:
    """Learn from all given texts; without ``own_count`` no word beyond the items is placed by itself."""
    column = texts.select(F.col(text_col).cast("string").alias("text"))
    vocabulary = scratch(count_words(column), "words")
    top = vocabulary.filter(F.col("word") != END.decode()).orderBy(F.col("c").desc(), "word").limit(own_items - 1).collect()
    items = Items([END, *[r.word.encode("utf-8") for r in top]], group_items)
    threshold, words, cls = head_threshold(vocabulary, head_words), [], np.empty(0, np.int64)
    if own_count and threshold:
        head = vocabulary.filter(F.col("c") >= max(threshold, own_count)).select("word").toArrow()
        own = set(items.own)
        words = [w for w in head.column("word").cast(pa.binary()).to_pylist() if w not in own]
    codes = scratch(encode_texts(column, items, words), "codes")
    bigrams = count_bigrams(codes, _places(items, words), items.count)
    label = exchange(bigrams, classes)
    member = np.zeros((items.count, classes))
    member[np.arange(items.count), label] = 1.0
    joint = member.T @ bigrams @ member
    if words:
        cls = place_words(codes, items, label, joint, words)
        joint = count_bigrams(codes, np.concatenate([label, cls]), classes)
    drop_scratch(codes)
    return BrownModel(vocabulary, items, label, joint, threshold, (words, cls))


def held_out(id_col: str = "doc_id"):
    """The contract's held-out rule."""
    return crc_mod5(id_col) == 1
