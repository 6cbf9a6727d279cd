"""Substring dedup by suffix automata and matching statistics (operator 6).

A word is removed if a window of ``window`` consecutive words covers it whose word sequence also
starts earlier (in a smaller document, or earlier in the same one); everything is judged on the
input. The reference that a document is matched against is all text before it, so no broadcast of
its automata has a size bound. :mod:`lureline.llm.repeats` therefore deals reference and documents
out together: equal windows meet in the same bounded shard, each shard has one suffix automaton,
and its distinct segments stream through it in document order. Extending the automaton by a word
yields the matching statistic at that word, the longest match ending there that also ends earlier
(the length of the new state's suffix link); where it reaches ``window``, that window repeats.

Every occurrence of a segment but the first repeats it whole.

Cases: null and empty texts have no words; rows that repeat an id are documents of their own, in
the order of their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm import repeats
from lureline.llm.common import add_columns, keyed_rows


class SuffixAutomaton:
    """Suffix automaton of several word sequences, grown one word at a time."""

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _clone(self, source: int, old: int, word) -> int:
        """Split the state ``old`` at the length that ``source`` reaches with ``word``."""
        copy = self._state(self.length[source] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        moves = self.next
        while source >= 0 and moves[source].get(word) == old:
            moves[source][word] = copy
            source = self.link[source]
        return copy

    def add(self, words) -> list[int]:
        """Append a sequence; per word, the longest match ending there that also ends earlier."""
        length, link, moves = self.length, self.link, self.next
        last, matched = 0, []
        for word in words:
            old = moves[last].get(word)
            if old is not None:  # the whole sequence so far ends earlier too
                grown = length[last] + 1
                last = old if length[old] == grown else self._clone(last, old, word)
                matched.append(grown)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0:
                old = moves[p].get(word)
                if old is not None:
                    link[new] = old if length[old] == length[p] + 1 else self._clone(p, old, word)
                    break
                moves[p][word] = new
                p = link[p]
            matched.append(length[link[new]])
            last = new
        return matched


def earlier_windows(contents: list[bytes], window: int) -> list[np.ndarray]:
    """Per content (in order), one flag per window start: does it start earlier as well?"""
    machine = SuffixAutomaton()
    flags = []
    for content in contents:
        words = content.split(b" ")
        matched = np.array(machine.add(words), np.int64)
        flags.append(matched[window - 1:] >= window)
    return flags


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
          T.StructField("spans", SPANS), T.StructField("kept_sha256", T.StringType()),
          T.StructField("kept_text", T.StringType())]


def _remove(with_text: bool):
    def make(batch):
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for text, own in zip(batch.column("text"), batch.column("_spans")):
            words = (text.as_py() or "").encode("utf-8", "replace").split()
            runs = repeats.merge_spans((x["start"], x["end"]) for x in own.as_py() or ())
            edges = [0, *[e for run in runs for e in run], len(words)]
            left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]] if runs else words
            joined = b" ".join(left)
            sizes.append(len(words))
            removed.append(len(words) - len(left))
            spans.append([{"start": a, "end": b} for a, b in runs])
            digests.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode("utf-8") if with_text else None)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds),
                pa.array(digests, pa.string()), pa.array(kept, pa.string())]

    return make


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   gram: int = 8, shard_words: int = 50_000, heavy: int = 8000,
                   with_text: bool = True) -> DataFrame:
    """One row per document: ``<id>, text, n_words, n_removed, spans (of words), kept_sha256,
    kept_text``."""
    rows = keyed_rows(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    decide = lambda contents, counts: earlier_windows(contents, window)
    seen, distinct, runs = repeats.repeated_runs(rows, "word", window, gram, decide, True, shard_words, heavy)
    at, size = F.shiftright("pos", repeats.SIZE_BITS), F.col("pos").bitwiseAND(F.lit((1 << repeats.SIZE_BITS) - 1))
    first = distinct.filter("n > 1").select("key", "seg", F.col("_rid").alias("_r"), F.col("pos").alias("_p"))
    later = seen.join(first, ["key", "seg"]).filter("_rid <> _r or pos <> _p").select(
        "_rid", at.alias("start"), (at + size).alias("end"))
    spans = repeats.unit_spans(runs).unionByName(later)
    return add_columns(repeats.with_spans(rows, spans), FIELDS, _remove(with_text)).drop("_spans", "_rid")
