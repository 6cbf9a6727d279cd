"""Benchmark decontamination with one Aho-Corasick automaton (operator 3).

Benchmark texts and documents are normalised alike: A-Z lower-cased, words are runs of digits,
a-z and non-ASCII characters. A window is ``window`` consecutive words of an item (a shorter item
is one window). The words of the benchmark are numbered; the windows, as sequences of word numbers,
are the patterns of one automaton; each document's words are scanned once and every occurrence marks
its words. Matched words are mapped back to code point offsets of the original text.

Every Python worker holds the automaton. Its nodes are at most the words of all windows, counted by
an aggregate before anything is collected; beyond ``max_nodes`` (a node takes about 60 bytes), or
texts of ``max_benchmark_bytes``, the operator raises. Only then is the benchmark broadcast, as word numbers. Documents are never shuffled.

Cases: null and empty texts have no words; an item without words has no window; rows that share
an item id count as one item, an item with a null id marks words but is not listed; repeated
documents give repeated results; an empty benchmark leaves every document clean; input columns
that clash with a result column are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import add_columns

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("item_ids", T.ArrayType(T.StringType())),
          T.StructField("spans", T.ArrayType(SPAN)),
          T.StructField("contaminated", T.BooleanType())]

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the words of normalise()
_automata: dict = {}


def normalise(text: str | None) -> bytes:
    """Same length as the UTF-8 text: word bytes lower-cased, everything else a blank."""
    return (text or "").encode("utf-8", "replace").translate(_NORMAL)


class Machine:
    """The automaton over the windows of ``items`` (pairs of item id and array of word numbers)."""

    def __init__(self, words: list[bytes], items, window: int):
        import ahocorasick
        self.number = {w: i for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.sizes: list[int] = []
        self.owners: list[tuple] = []
        for item_id, codes in items:
            codes = tuple(codes.tolist())
            for i in range(max(1, len(codes) - window + 1) if codes else 0):
                part = codes[i:i + window]
                at = self.automaton.get(part, None)
                if at is None:
                    at = len(self.sizes)
                    self.automaton.add_word(part, at)
                    self.sizes.append(len(part))
                    self.owners.append(())
                if item_id is not None and item_id not in self.owners[at]:
                    self.owners[at] += (item_id,)
        if self.sizes:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, state):
        return cls(*state)


def numbered(items, window: int):
    """``(item id, text)`` rows -> the state of a :class:`Machine`; texts that repeat stay once per id."""
    number: dict[bytes, int] = {}
    coded = [(item_id, np.array([number.setdefault(w, len(number)) for w in normalise(text).split()], np.int32))
             for item_id, text in items]
    return list(number), coded, window


def _machine(key: str, shared) -> Machine:
    """Built once per Python worker from the broadcast word numbers."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Machine.of(shared.value)
    return _automata[key]


def scan(text: str | None, machine: Machine) -> tuple[int, np.ndarray | None, set]:
    """Number of words, mask of the words inside occurrences (None: no occurrence), item ids."""
    words = normalise(text).split()
    if not words or not machine.sizes:
        return len(words), None, set()
    other = len(machine.number)  # a number that no window holds
    line = tuple([machine.number.get(w, other) for w in words])
    mask, ids = None, set()
    for last, at in machine.automaton.iter(line):
        if mask is None:
            mask = np.zeros(len(words) + 1, np.int64)
        mask[last - machine.sizes[at] + 1] += 1
        mask[last + 1] -= 1
        ids.update(machine.owners[at])
    return len(words), None if mask is None else np.cumsum(mask[:-1]) > 0, ids


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code point offsets of the maximal runs of hit words in the original text."""
    flat = np.frombuffer(normalise(text), np.uint8)
    body = np.concatenate([[False], flat != 32, [False]])
    starts = np.flatnonzero(body[1:-1] & ~body[:-2])
    ends = np.flatnonzero(body[1:-1] & ~body[2:]) + 1
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    point = np.concatenate([[0], np.cumsum((np.frombuffer(
        text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(point[starts[a]]), "end": int(point[ends[b - 1]])}
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  max_benchmark_bytes: int = 64 << 20, max_nodes: int = 4_000_000) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, item_ids (sorted), spans, contaminated``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"),
                             F.col(item_text_col).cast("string").alias("t")).distinct()
    n = F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("long")
    size, nodes = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.sum(
        F.greatest(n - window + 1, F.lit(1)) * F.least(n, F.lit(window))), F.lit(0))).first()
    if size > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {size} bytes; max_benchmark_bytes is {max_benchmark_bytes}")
    if nodes > max_nodes:
        raise ValueError(f"the windows of the benchmark hold {nodes} words; max_nodes is {max_nodes}")
    state = numbered(((r.i, r.t) for r in items.collect()), window)
    shared, key = docs.sparkSession.sparkContext.broadcast(state), uuid.uuid4().hex

    def make(batch):
        machine = _machine(key, shared)
        n_words, n_hit, ids, spans = [], [], [], []
        for value in batch.column(text_col):
            text = value.as_py()
            count, hit, found = scan(text, machine)
            n_words.append(count)
            n_hit.append(0 if hit is None else int(hit.sum()))
            ids.append(sorted(found))
            spans.append([] if hit is None else original_spans(text, hit))
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array(ids, pa.list_(pa.string())), pa.array(spans, kinds),
                pa.array([n > 0 for n in n_hit], pa.bool_())]

    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return add_columns(typed, FIELDS, make)
