"""Operators 1 to 5, 7, 9 and 10 against brute force, round trips and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureline.llm import (
    brown_lm, chat_format, decontaminate, embed_dedup, minhash_dedup, mixing, toxicity, url_filter,
)
from lureline.llm.common import components
from tests.llm.conftest import frame


# ---- operator 1 ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def two_tongues():
    rng = random.Random(5)
    a = [f"{w}{s}" for w in ("ba", "be", "bi", "bo", "bu") for s in ("la", "le", "li", "lo")]
    b = [f"{w}{s}" for w in ("ta", "te", "ti", "to", "tu") for s in ("ra", "re", "ri", "ro")]
    return [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(rng.randint(5, 40)))) for i in range(200)]


def test_brown_model_beats_the_unigram_and_counts_exactly(spark, two_tongues):
    train, held = two_tongues[:150], two_tongues[150:] + [(900, None), (901, ""), (902, "unseen wordz"), (902, "unseen wordz")]
    for head_words in (300_000, 5):  # with and without words that need the join
        model = brown_lm.fit(frame(spark, train), classes=4, own_items=12, group_items=8, head_words=head_words)
        rows = model.score(frame(spark, held)).collect()
        count = Counter(w for _, t in train for w in brown_lm.tokens(t) + [brown_lm.END])
        total, size = sum(count.values()), len(count)
        want = Counter()
        for i, t in held:
            words = brown_lm.tokens(t) + [brown_lm.END]
            base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (size + 1))) for w in words)
            want[(i, len(words), sum(count[w] > 0 for w in words), total, round(base, 6))] += 1
        got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
        assert got == want
        known = [r for r in rows if r.doc_id < 900]
        assert sum(r.score for r in known) > sum(r.base_score for r in known) + 5
        assert all(math.isfinite(r.score) for r in rows)


def test_brown_probabilities_sum_to_one(spark, two_tongues):
    model = brown_lm.fit(frame(spark, two_tongues), classes=4, own_items=12, group_items=8)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1.0)
    mass = {c: 10 ** model.unseen[c] for c in range(4)}
    for r in model.vocabulary.collect():
        mass[r.cls] += (r.c - model.discount) / model.class_tokens[r.cls]
    assert all(abs(m - 1) < 1e-9 for c, m in mass.items() if model.class_tokens[c])


def test_brown_places_words_by_their_neighbours(spark, two_tongues):
    """Words beyond the items: contexts counted over all texts, class of greatest likelihood."""
    texts = frame(spark, two_tongues).select("text")
    items, label = brown_lm.Items([brown_lm.END], 2), np.array([0, 1, 2])
    words = sorted({w for _, t in two_tongues for w in brown_lm.tokens(t)})
    of = lambda w: int(label[items(w)])
    seen, joint = Counter(), np.zeros((3, 3))
    for _, t in two_tongues:
        line = [brown_lm.END, *brown_lm.tokens(t), brown_lm.END]
        for a, b in zip(line, line[1:]):
            joint[of(a), of(b)] += 1
            if a != brown_lm.END:
                seen[(words.index(a), of(b))] += 1
            if b != brown_lm.END:
                seen[(words.index(b), 3 + of(a))] += 1
    rows = brown_lm.count_contexts(texts, items, label, words, 3).collect()
    assert {(r.word, r.side): r.n for r in rows} == dict(seen)

    def likelihood(t):
        part = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v > 0)
        return part(t) - part(t.sum(axis=0)) - part(t.sum(axis=1))

    placed = brown_lm.place_words(texts, items, label, joint, words)
    for i, w in enumerate(words):
        right, left = (np.array([seen[(i, k + c)] for c in range(3)], float) for k in (0, 3))
        scores = []
        for c in range(3):
            t = joint.copy()
            t[of(w), :] -= right
            t[:, of(w)] -= left
            t = np.maximum(t, 0)
            t[c, :] += right
            t[:, c] += left
            scores.append(likelihood(t))
        assert scores[placed[i]] >= max(scores) - 0.02 * abs(max(scores))


def test_brown_placed_words_raise_the_held_out_score(spark, two_tongues):
    train, held = frame(spark, two_tongues[:150]), frame(spark, two_tongues[150:])
    total = {n: sum(r.score for r in brown_lm.fit(train, classes=4, own_items=12, group_items=3, own_count=n)
                    .score(held).collect()) for n in (None, 5)}
    assert total[5] > total[None]


def test_brown_very_long_empty_and_clashing(spark):
    rows = [(i, "a b c d " * 20_000 if i == 3 else "a b", "x") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("word", F.lit("w"))
    model = brown_lm.fit(docs, classes=2, own_items=3, group_items=2, own_count=2)
    got = {r.doc_id: r for r in model.score(docs).collect()}
    assert len(got) == 6 and got[3].n_tokens == 80_001 and all(math.isfinite(r.score) for r in got.values())
    assert model.score(docs.limit(0)).count() == 0


def test_brown_without_training_text(spark):
    model = brown_lm.fit(frame(spark, []), classes=4, own_items=12, group_items=8)
    row = model.score(frame(spark, [(1, "a b"), (None, None)])).collect()
    assert sorted(r.n_tokens for r in row) == [1, 3] and all(math.isfinite(r.score) for r in row)


def test_brown_fit_reads_every_text_twice(spark, two_tongues):
    """Once to count the words, once to encode them; items, contexts and classes are counted from the codes."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = frame(spark, two_tongues)
    model = brown_lm.fit(docs.mapInArrow(counted, docs.schema), classes=4, own_items=12, group_items=3)
    assert model.words == 41 and seen.value == 2 * len(two_tongues)


def test_brown_codes_are_items_and_listed_words(spark):
    texts = [None, "", "b a B zz", "a", "a zz " * 300_000]
    items, words = brown_lm.Items([brown_lm.END, b"a"], 3), [b"b"]
    rows = brown_lm.encode_texts(frame(spark, [(t,) for t in texts], "text string").coalesce(1), items, words).collect()
    number = lambda w: items.count if w == b"b" else items(w)
    assert [r.codes for r in rows] == [[*map(number, brown_lm.tokens(t)), 0] for t in texts]


def test_exchange_separates_contexts():
    table = np.zeros((6, 6))
    for i in range(6):
        for j in range(6):
            table[i, j] = 50 if (i < 3) != (j < 3) else 1  # two groups that follow each other
    label = brown_lm.exchange(table, 2)
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[5]


# ---- operator 2 ---------------------------------------------------------------------------------

def brute_links(rows, threshold=0.93):
    links = {i: set() for i in range(len(rows))}
    ok = [lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
          and any(v) for _, v, lab in rows]
    for i in range(len(rows)):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    return links


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)  # windows must widen over the near group
    rng = np.random.default_rng(1)
    rows = []
    near = rng.standard_normal(8)
    for i in range(260):
        v = rng.standard_normal(8) if i % 3 else near + 0.1 * rng.standard_normal(8)
        rows.append([i, [float(np.float32(x)) for x in v], int(i % 2) if i % 3 else 7])
    rows[10][1] = rows[16][1]
    rows[10][2] = rows[16][2]
    rows += [[300, None, 1], [301, [0.0] * 8, 1], [302, [1.0] * 8, None], [303, [float("nan")] * 8, 1],
             [304, [None] + [1.0] * 7, 1], [305, [], 1], [306, [1.0, 2.0], 1], [307, [2.0, 4.0], 1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    links = brute_links(rows)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        stack = [i]
        seen = {i}
        while stack:
            for k in links[stack.pop()]:
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        root[i] = min(rows[k][0] for k in seen)
    for i, (vec_id, _, _) in enumerate(rows):
        r = got[vec_id]
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), root[i], root[i] == vec_id)


@pytest.mark.parametrize("shared", [0.87])  # mean cosine of the label
def test_vectors_that_share_a_direction_lose_no_pair(spark, monkeypatch, shared):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v)
    mean = unit(rng.standard_normal(64))

    def around(own):  # the shared direction and a part of its own at a right angle
        own = unit(own - (own @ mean) * mean)
        return math.sqrt(shared) * mean + math.sqrt(1 - shared) * own

    rows = [(i, around(rng.standard_normal(64)).tolist(), 1) for i in range(900)]
    for k in range(60):  # lone partners at a cosine of 0.935
        a = np.array(rows[8 * k][1])
        other = rng.standard_normal(64)
        other -= (other @ mean) * mean
        own = unit(a - (a @ mean) * mean)
        other = unit(other - (other @ own) * own)
        near = 1 - 0.065 / (1 - shared)
        rows.append((900 + k, (math.sqrt(shared) * mean + math.sqrt(1 - shared) * (
            near * own + math.sqrt(1 - near * near) * other)).tolist(), 1))
    links = brute_links(rows)
    assert all(900 + k in links[8 * k] for k in range(60))
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"),
                                   miss=0.01)
    assert {r.vec_id: r.n_links for r in got.collect()} == {i: len(x) for i, x in links.items()}


def test_vectors_repeated_ids_and_empty(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 0, -1), (1, 1, 1), (1, 1, 1)]
    assert embed_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + hub + [(7, 7)], "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60))


# ---- operator 3 ---------------------------------------------------------------------------------

def test_decontamination_spans_and_odd_items(spark):
    items = [(1, "One two THREE four"), (2, "héllo"), (3, None), (None, "zz"), (4, "-- !"), (1, "five six")]
    docs = [(1, "x One, two; three FOUR y"), (2, "say Héllo héLLO"), (3, None), (4, ""), (5, "zz five-six"),
            (6, "one two three"), (6, "one two three")]
    out = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string"), window=3)
    rows = {r.doc_id: r for r in out.collect()}
    assert [(rows[1].n_words, rows[1].n_hit, rows[1].item_ids)] == [(6, 4, ["1"])]
    text = docs[0][1]
    assert [text[s.start:s.end] for s in rows[1].spans] == ["One, two; three FOUR"]
    assert rows[2].n_hit == 2 and rows[2].spans[0].start == 4
    assert (rows[3].n_words, rows[4].n_words) == (0, 0)
    assert rows[5].n_hit == 3 and rows[5].item_ids == ["1"]
    assert rows[6].contaminated and out.count() == 7
    none = decontaminate.decontaminate(frame(spark, docs), frame(spark, [], "item_id long, text string"))
    assert none.filter("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string"),
                                    max_benchmark_bytes=5)


def test_decontamination_bound_is_the_automatons_size(spark):
    items = frame(spark, [("i", "a b c d e"), ("i", "a b c d e"), ("j", "b c d"), ("k", None)], "item_id string, text string")
    docs = frame(spark, [(1, "z a b c d e z"), (2, "b c d " * 30_000), (3, "a b x c d e"), (3, None)])
    with pytest.raises(ValueError, match="hold 12 words"):
        decontaminate.decontaminate(docs, items, window=3, max_nodes=11)
    clash = docs.withColumn("n_hit", F.lit("x")).withColumn("item_id", F.lit("y"))
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(clash, items, window=3, max_nodes=12).collect()}
    assert (got[1, 7].n_hit, got[1, 7].item_ids) == (5, ["i", "j"])
    assert (got[2, 90_000].n_hit, got[2, 90_000].item_ids) == (90_000, ["i", "j"])
    assert got[3, 6].n_hit == 3 and got[3, 0].n_hit == 0 and got[1, 7].item_id == "y"
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0



# ---- operator 4 ---------------------------------------------------------------------------------

def test_folding():
    assert toxicity.fold("1D10T").split() == toxicity.fold("idiot").split()
    assert toxicity.fold("ѕсum") == toxicity.fold("scum") and toxicity.fold("sc\u200bum") == "scum"
    assert toxicity.fold("ÉTÉ, o.k.") == "ete  o k "


def test_toxicity_held_out_accuracy_and_exceptions(spark):
    rng = random.Random(2)
    bad = ["wretchy", "wretcho", "wretchund", "gloopen", "snarf"]
    docs, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 60))]
        toxic = i % 5 == 0
        if toxic:
            w = rng.choice(bad)
            w = w.replace("o", "0") if rng.random() < 0.3 else w.upper() if rng.random() < 0.3 else w
            words.insert(rng.randrange(len(words)), w)
        elif i % 44 == 1:
            words += ["garden", "snarf"]  # clean: the phrase is an exception
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    held = [(i, t) for i, t in docs if i % 4 == 3] + [(5000, None), (5001, "")]
    train = spark.createDataFrame([x for x in labels if x[0] % 4 != 3] + [(5002, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, docs), train, exceptions=["garden snarf"])
    got = {r.doc_id: r for r in model.score(frame(spark, held)).collect()}
    truth = dict(labels)
    right = sum(got[i].predicted == truth[i] for i, _ in held if i in truth)
    assert right >= 0.97 * (len(held) - 2)
    assert got[5000].score == got[5001].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    flat = toxicity.fit(frame(spark, docs), spark.createDataFrame([], "doc_id long, toxic int"))
    assert flat.score(frame(spark, held)).count() == len(held)


# ---- operator 5 ---------------------------------------------------------------------------------

def test_mix_meets_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)  # groups of equal sizes are split
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 3, 3, 17, 40]))),
             rng.choice(["a", "b", "b", "b", "c", None])) for i in range(900)]
    rows += [(600, None, "a"), (601, "", None), (602, "x y", "a"), (602, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    target, left, open_ = {}, 1.5 * total, dict(weight)
    while open_:  # the excess is reshared until none is above
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if w * level > 2 * by[s][0].source_size]
        for s in over or list(open_):
            target[s] = 2.0 * by[s][0].source_size if over else open_[s] * level
            left -= target[s]
            del open_[s]
    for s, docs in by.items():
        assert abs(docs[0].target - target[s]) < 1e-6
        assert abs(sum(r.taken for r in docs) - target[s]) <= 1
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda rs: Counter((r.doc_id, r.taken) for r in rs)
    assert key(again) == key(got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_fit_counts_is_the_nearest_subset_sum():
    rng = random.Random(6)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 3) for _ in sizes])
        budget = rng.uniform(0, float((sizes * counts).sum()))
        start = np.floor(counts * (budget / int((sizes * counts).sum()))).astype(int)
        sums = {0}
        for s, c in zip(sizes, counts - start):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        best = min(abs(x + (start * sizes).sum() - budget) for x in sums)
        take = mixing.fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(abs((take * sizes).sum() - budget) - best) < 1e-9


# ---- operator 7 ---------------------------------------------------------------------------------

def test_escape_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\</s>\\\\", "<<SYS>><s><|im_end|>\n", "<\\/s>", "", "\\", "<<|im_end|>"]
    df = spark.createDataFrame([(x,) for x in odd], "t string").withColumn("e", chat_format.escape(F.col("t")))
    for r in df.withColumn("u", chat_format.unescape(F.col("e"))).collect():
        assert r.t == r.u and not any(w in r.e for w in chat_format.CONTROL)


def test_prefix_target_expansion(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u<s>"), (1, 2, "assistant", "r1"), (1, 3, "user", None),
            (1, 4, "assistant", "r2</s>"), (1, 5, "user", "tail"), (2, 0, "user", "only"),
            (3, None, "we\nird<[%", "x"), (None, 0, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat_format.format_conversations(df)
    one = sorted([r for r in ex.collect() if r.conv_id == 1], key=lambda r: r.example)
    assert len(one) == 3 and [chat_format.END in r.formatted for r in one] == [True] * 3
    assert [r.formatted[r.loss_start:r.loss_end] for r in one] == ["r1", "r2<\\/s>", ""]
    assert one[1].formatted.startswith(one[0].formatted)
    read = {r.conv_id: r.turns for r in ex.filter("complete").select(
        "conv_id", chat_format.parse_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in read[1]] == [(r[2], r[3] or "") for r in rows[:6]]
    assert [(t.role, t.text) for t in read[3]] == [("we\nird<[%", "x")]
    assert [(t.role, t.text) for t in read[None]] == [("", "n")]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# ---- operator 9 ---------------------------------------------------------------------------------

def brute_components(rows, words=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def test_forest_equals_brute_force(spark, corpus):
    got = minhash_dedup.near_duplicates(frame(spark, corpus)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("own", [24, 30])  # pairwise Jaccard about 0.70 and 0.62, below the threshold
def test_forest_finds_pairs_among_documents_that_share_a_template(spark, own):
    rng = random.Random(own)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    template = [word() for _ in range(120)]
    rows = [(i, " ".join([word() for _ in range(own)] + template)) for i in range(400)]
    for k in range(20):  # copies that change a few of the own words
        words = rows[7 * k][1].split()
        words[:own // 3] = [word() for _ in range(own // 3)]
        rows.append((1000 + k, " ".join(words)))
    want = brute_components(rows)
    assert sum(i != c for i, (_, c) in want.items()) == 20
    got = minhash_dedup.near_duplicates(frame(spark, rows), trees=4, depth=2, neighbours=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_links_of_a_group_equal_brute_force():
    rng = np.random.default_rng(4)
    for count, spread in ((2, 8), (60, 40), (400, 60)):
        base = np.arange(100, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[:100 - k], rng.integers(1000, 5000, k).astype(np.uint64)]))
                for k in rng.integers(0, spread, count)]
        known, side = rng.integers(0, max(2, count // 2), count), rng.integers(0, 2, count)
        for sides in (np.zeros(count, np.int64), side):
            want = set()
            for b in range(count):
                for a in range(b):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if (100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and known[a] != known[b]
                            and (len(set(sides)) == 1 or sides[a] != sides[b])):
                        want.add((a, b))
            got = [(int(x), int(y)) for a, b in minhash_dedup.linked_rows(sets, known, sides, 75) for x, y in zip(a, b)]
            assert len(got) == len(set(got)) and set(got) == want


def test_prefix_links_in_blocks_equal_brute_force(spark):
    """Sets around the threshold, ties at exactly 75 % and groups dealt out in many blocks."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(74)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else word() for w in base)) for i in range(150)]
    tail = [word() for _ in range(11)]
    rows += [(500, " ".join(tail)), (501, " ".join(tail[:-1] + [word()]))]  # 6 of 8 shingles: exactly 75 %
    docs = frame(spark, rows)
    dense = docs.select(F.col("doc_id").alias("_rid"), F.col("doc_id").alias("known"),
                        (F.size(F.split("text", " ")) - 4).cast("long").alias("n"))
    texts = docs.select(F.col("doc_id").alias("_rid"), "text")
    grams = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {(a, b) for a in grams for b in grams if a < b
            and 100 * len(grams[a] & grams[b]) >= 75 * len(grams[a] | grams[b])}
    assert (500, 501) in want and len(want) > 100
    for block in (1 << 20, 1500):
        got = minhash_dedup.prefix_links(dense, texts, 5, 75, block=block).collect()
        assert {(r.src, r.dst) for r in got} == want


def test_forest_repeated_ids_and_filter(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d E f"), (None, "q"), (3, None), (3, "")]
    kept = minhash_dedup.deduplicate(spark.createDataFrame([r + ("x",) for r in rows],
                                                           "doc_id long, text string, sig string"))
    assert Counter((r.doc_id, r.text, r.sig) for r in kept.collect()) == Counter(
        [(1, "a b c d e f", "x"), (None, "q", "x"), (3, None, "x"), (3, "", "x")])
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


# ---- operator 10 --------------------------------------------------------------------------------

def test_url_rules_and_held_out_accuracy(spark):
    rng = random.Random(8)
    pages = []
    for i in range(600):
        bad = i % 3 == 0
        host = rng.choice(["shop", "blog", "www"]) + (".free-win.biz" if bad else ".example.edu")
        path = "/" + "/".join("".join(rng.choice("ab01" if bad else "abcd") for _ in range(rng.randint(3, 9)))
                              for _ in range(rng.randint(1, 5 if bad else 3)))
        pages.append((i, f"http://{host}{path}" + ("?a=1&b=2" if bad else ""), int(bad)))
    df = spark.createDataFrame(pages, "page_id long, url string, block int")
    rules = [("org", "/", "allow"), ("example.org", "/en/1", "block")]
    extra = spark.createDataFrame([(1000, None), (1001, "nothing"), (1002, "x://A.Example.ORG/en/12?q#f"),
                                   (1003, "x://org"), (1004, "x://myorg/"), (1005, "x://org/")], "page_id long, url string")
    test = df.filter("page_id % 4 = 1").select("page_id", "url").unionByName(extra)
    got = {r.page_id: r for r in url_filter.judge_urls(
        test, rules, labelled=df.filter("page_id % 4 <> 1"), rounds=5, depth=3).collect()}
    right = [got[i].verdict == ("block" if b else "allow") for i, _, b in pages if i % 4 == 1]
    assert sum(right) >= 0.95 * len(right)
    assert (got[1000].host, got[1000].path, got[1000].rule, got[1001].host) == ("", "", None, "")
    assert (got[1002].host, got[1002].path, got[1002].rule, got[1002].verdict) == \
        ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[1003].rule is None and got[1004].rule is None and got[1005].rule == "org/"
    none = url_filter.judge_urls(extra, [], rounds=2)
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_filter.judge_urls(extra.limit(0), rules).count() == 0
