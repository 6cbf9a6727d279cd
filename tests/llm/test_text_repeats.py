"""Operators 6 and 8: against brute force, with heavy keys, odd rows and repeated ids."""

import hashlib
import random
import re
from collections import Counter

import pytest

from lureline.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.conftest import frame

SPACE = re.compile(rb"[^\x20\x09-\x0d]+")


def words_of(text):
    return SPACE.findall((text or "").encode())


def expect_words(rows, window):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        words, gone = words_of(text), set()
        for i in range(len(words) - window + 1):
            part = tuple(words[i:i + window])
            if part in seen:
                gone.update(range(i, i + window))
            seen.add(part)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def expect_bytes(rows, window):
    count = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        count.update(raw[i:i + window] for i in range(len(raw) - window + 1))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if count[raw[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("heavy", [2000, 3])
def test_words_equal_brute_force(spark, corpus, heavy):
    got = substring_dedup.remove_earlier(frame(spark, corpus), window=6, gram=3, shard_words=500, heavy=heavy)
    rows = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
    assert rows == expect_words(corpus, 6)


@pytest.mark.parametrize("heavy", [4000, 2])
def test_bytes_equal_brute_force(spark, corpus, heavy):
    got = suffix_dedup.remove_repeats(frame(spark, corpus), window=24, gram=8, shard_bytes=4000, heavy=heavy)
    rows = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.collect())
    assert rows == expect_bytes(corpus, 24)


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (None, text), (2, None), (None, "z y x")]
    got = substring_dedup.remove_earlier(frame(spark, rows), window=4, gram=2)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == expect_words(rows, 4)
    got = suffix_dedup.remove_repeats(frame(spark, rows), window=10, gram=4)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                   for r in got.collect()) == expect_bytes(rows, 10)


def test_empty_table_and_clashing_columns(spark):
    none = frame(spark, [])
    assert substring_dedup.remove_earlier(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    odd = spark.createDataFrame([(1, "a b c", "k", 5), (2, "a b c", None, 6)],
                                "doc_id long, text string, key string, n_removed int")
    out = suffix_dedup.remove_repeats(odd, window=3, gram=2, rest=True).orderBy("doc_id").collect()
    assert [r.n_removed for r in out] == [5, 5] and [r._rest.n_removed for r in out] == [5, 6]


def test_matching_statistics():
    machine = substring_dedup.SuffixAutomaton()
    assert machine.add("a b c".split()) == [0, 0, 0]
    assert machine.add("b c a b c".split()) == [1, 2, 1, 2, 3]
    assert machine.add("c c".split()) == [1, 1]


def test_suffix_ranks_order_the_suffixes():
    import numpy as np
    rng = random.Random(1)
    for _ in range(50):
        text = np.array([rng.choice([1, 2, 3]) for _ in range(40)] + [0], np.int16)
        rank = suffix_dedup.suffix_ranks(text, 64)
        order = sorted(range(41), key=lambda i: list(text[i:]))
        assert [int(rank[i]) for i in order] == list(range(41))


def test_merge_spans():
    assert repeats.merge_spans([(5, 9), (0, 2), (2, 3), (6, 7)]) == [(0, 3), (5, 9)]
