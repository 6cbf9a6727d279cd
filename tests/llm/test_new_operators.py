"""Operators 11 to 13 against brute force."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureline.llm import perfect_hash, periodic_runs, secret_scan, token_alignment
from lureline.llm.common import table
from lureline.llm.queries import queries
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- operator 11 --------------------------------------------------------------------------------

@functools.lru_cache(None)
def runs_of(text):
    return brute_runs(split(text))


def brute_runs(words, least=12):
    """All runs by comparing every word with the one q words on, for every q."""
    out, n = [], len(words)
    number = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if n else np.empty(0)
    for q in range(1, n // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (number[q:] == number[:-q]).astype(int), [0]])))
        for a, i in edge.reshape(-1, 2).tolist():
            length = i - a + q
            root = words[a:a + q]
            if length >= max(least, 2 * q) and not any(
                    q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(7)
    texts = [None, "", " \n ", "a", "a " * 11, "a " * 12, "la lo " * 6, "la lo " * 5 + "la", "a b c " * 50 + "a"]
    for k in range(60):
        words = []
        for _ in range(rng.randint(1, 6)):
            root = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40, 90]))]
            words += (root * rng.randint(1, 9))[:rng.randint(1, 400)]
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))]
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(words))
    texts += [" ".join(rng.choice("ab") for _ in range(500)) for _ in range(10)]
    fib, tm = ["a", "b"], "a"
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    for _ in range(11):
        tm += tm.translate(str.maketrans("ab", "ba"))
    return texts + [" ".join(fib[-1]), " ".join(tm), " ".join(tm[:1024] * 2)]


def test_runs_equal_brute_force(spark):
    texts = periodic_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "y"), (None, texts[8], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    for with_text in (True, False):
        got = periodic_runs.collapse_runs(docs, with_text=with_text)
        want = Counter()
        for i, t, _ in rows:
            w, runs = split(t), runs_of(t)
            want[(i, len(w), tuple(runs), sha(collapsed(w, runs)))] += 1
        assert Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed_sha256)
                       for r in got.collect()) == want
        if with_text:
            assert all(sha(r.collapsed_text) == r.collapsed_sha256 for r in got.collect())


def test_runs_of_very_long_texts(spark):
    rng = random.Random(2)
    root = [str(rng.randrange(10 ** 6)) for _ in range(70_000)]
    rows = [(1, " ".join(["x"] * 5 + root + root + root[:9] + ["y"])), (2, "la lo li " * 150_000), (3, "x" * 3_000_000)]
    got = {r.doc_id: [(x.start, x.length, x.period) for x in r.runs]
           for r in periodic_runs.collapse_runs(frame(spark, rows), with_text=False).collect()}
    assert got == {1: [(5, 140_009, 70_000)], 2: [(0, 450_000, 3)], 3: []}


def test_runs_of_nothing(spark):
    assert periodic_runs.collapse_runs(frame(spark, [])).count() == 0


def test_tiles_are_solved_alike_whatever_their_cut(spark):
    words = np.array([0, 1, 2, 0, 1] * 60 + [3] + [4, 5] * 40, np.int32)
    for octave in (2, 4):
        found = periodic_runs.solve_tile(words, octave, 12)
        brute = [(q, a, a + n - q) for a, n, q in brute_runs(words.tolist()) if octave <= q < 2 * octave]
        assert sorted(found) == sorted(brute)


def test_query_of_runs_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries()["op11_periodic_runs"](spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = split(d.text)
        h = zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 3000 else None
        r = got[d.doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{l},{q}\n" for a, l, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
    assert planted > 5


# ---- operator 12 --------------------------------------------------------------------------------

def test_perfect_hash_is_minimal_and_verified(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000))
    index = perfect_hash.build_shards(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key", 3)
    held = perfect_hash.PerfectHash([r.asDict() for r in index.collect()], 3)
    assert sorted(held(keys).tolist()) == list(range(len(keys)))
    assert (held(np.setdiff1d(rng.integers(0, 1 << 40, 1000), keys)) == -1).all()
    assert perfect_hash.PerfectHash([], 1)(keys[:3]).tolist() == [-1] * 3


@pytest.fixture(scope="module")
def tools():
    base = token_alignment.TOKENIZERS
    return token_alignment.Tokenizers(f"{base}/{token_alignment.A_FILE}", f"{base}/{token_alignment.B_FILE}")


def brute_alignment(rows, tools):
    """Whole texts encoded at once, links from byte ranges."""
    out, count = [], Counter()
    for key, text in rows:
        a = tools.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tools.b.encode(text) if text else []
        ta, tb = [tools.a_bytes[t] for t in a], [tools.b_bytes[t] for t in b]
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            out.append((key, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(t) for t in ta]), np.cumsum([len(t) for t in tb])
        links = []
        for i in range(len(a)):
            for j in range(np.searchsorted(eb, ea[i] - len(ta[i]), side="right"), len(b)):
                if eb[j] - len(tb[j]) >= ea[i]:
                    break
                links.append((a[i], b[j]))
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            i2, j2 = np.searchsorted(ea, e) + 1, np.searchsorted(eb, e) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        count.update(links)
        out.append((key, a, b, links, groups))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter((k, len(a), len(b), len(g), len(li), sum(count[x] == best[x[1]] for x in li),
                    sum(count[x] for x in li), sha(";".join(g)) if a else "") for k, a, b, li, g in out)


def odd_texts():
    return [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb \n c", "x\ty\r\nz", "tab\t\tend ", "<s> x</s>",
            "<|endoftext|> and <|endoftext|>", "sp▁ce", "naïve café ½ ﬁ 漢字 😀  nbsp　wide", "a\x00b \x1f c",
            "don't we'll  I'm", "x" * 3000, "é a b", " \n leading", "trailing \n ", "1234 5678,90", "🏳️‍🌈 flag", "<0x41> <unk>",
            "$\r\n  return;\r\n"]


def test_alignment_equals_brute_force(spark, corpus, tools):
    rows = [(i, t) for i, t in corpus if i != 65] + [(100 + i, t) for i, t in enumerate(odd_texts())] + [(3, "again"), (None, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_a long")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = brute_alignment(rows, tools)
    for slice_pairs in (1 << 21, 1):
        got = token_alignment.align_documents(docs, slice_pairs=slice_pairs, with_groups=True).collect()
        assert Counter(tuple(r[c] for c in names) for r in got) == want
        assert all(sha(r.groups) == r.groups_sha256 for r in got if r.n_a)


def test_both_ways_to_encode_agree(tools, corpus):
    cuts = sorted({c for _, t in [*corpus[:60], *enumerate(odd_texts())] if t for c in tools.cut(t)})
    fast = tools.encode_a(cuts)
    tools.fast, held = None, tools.fast
    assert held is not None and all(map(np.array_equal, fast, tools.encode_a(cuts)))
    tools.fast = held


def test_alignment_in_several_slices(spark, corpus, tools, monkeypatch):
    monkeypatch.setattr(perfect_hash, "SHARD_KEYS", 50)
    rows = [(i, t) for i, t in corpus if i < 60]
    got = token_alignment.align_documents(frame(spark, rows), slice_pairs=200).collect()
    assert Counter(tuple(r) for r in got) == brute_alignment(rows, tools)


def test_pairs_and_whole_query(spark, tools):
    got = queries()["op12_token_alignment"](spark, SF).collect()
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in got) == brute_alignment(rows, tools)


def test_alignment_of_a_very_long_text_and_of_nothing(spark, tools):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    row = token_alignment.align_documents(frame(spark, [(1, text)])).collect()
    assert Counter(tuple(r) for r in row) == brute_alignment([(1, text)], tools)
    assert token_alignment.align_documents(frame(spark, [])).count() == 0
    assert [r.n_a for r in token_alignment.align_documents(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# ---- operator 13 --------------------------------------------------------------------------------

def brute_base(text):
    found = []
    for name, pattern, group, least in (
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(group)) >= least:
                found.append((m.start(), ("assign", "access", "hex").index(name), f"{name}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def identifiers(n, seed=1):
    rng = random.Random(seed)
    part = ["get", "set", "user", "account", "name", "total", "count", "index", "file", "path", "report", "value", "date",
            "order", "customer", "window", "string", "buffer", "message", "handler"]
    return ["".join(rng.choice(part).title() for _ in range(rng.randint(1, 4))) if rng.random() < 0.5 else
            "_".join(rng.choice(part) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def random_string(rng, kind=None):
    alphabet = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
                "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    return "".join(rng.choice(alphabet[kind or rng.choice(sorted(alphabet))]) for _ in range(rng.randint(24, 48)))


def test_base_spans_equal_the_rules(spark):
    texts = [None, "", "token = \"abcdefgh\"", "tokentoken:12345678", "TOKEN='1234567'", "apikey:=x", "api_Key\" : abcd.efg=",
             "ſecret=12345678 toKen=12345678", "é password=é12345678 passwd: \n12345678 😀 secret=aaaaaaaaaa",
             "AKIA AKIAABCDEFGHIJKL AKIAAKIAABCDEFGH AKIAshort", "0" * 31 + " " + "0" * 32 + "g" + "f" * 40,
             "token=" + "a1" * 40, "secret:" + " " * 5000 + "x", "token = token = 12345678"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[2], 1)],
                                 "doc_id long, text string, spans int")
    model = secret_scan.fit_by_rules(docs)
    got = model.find(docs).select("doc_id", "text", secret_scan.said(base=True).alias("said")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.said == ",".join(brute_base(r.text)), r.text


def test_held_out_strings_are_told_apart(spark):
    rng = random.Random(4)
    samples = [(s, False) for s in identifiers(3000)] + [(random_string(rng), True) for _ in range(300)] + [(None, True), ("x", None)]
    model = secret_scan.fit(spark.createDataFrame(samples, "sample string, secret boolean"))
    fresh = [s for s in identifiers(3000, seed=9) if len(s) >= 20]
    secret = [random_string(rng) for _ in range(1000)]
    assert (model.ratios(fresh) >= model.min_ratio).mean() < 0.002
    assert (model.ratios(secret) >= model.min_ratio).mean() > 0.98
    # without any sample of base32 and base64, the uniform part still finds them
    only_hex = [(s, False) for s in identifiers(3000)] + [(random_string(rng, "hex"), True) for _ in range(300)]
    model = secret_scan.fit(spark.createDataFrame(only_hex, "sample string, secret boolean"))
    assert (model.ratios(secret) >= model.min_ratio).mean() > 0.95


def test_model_equals_brute_force(spark):
    rng = random.Random(8)
    samples = [(s, False) for s in identifiers(200)] + [(random_string(rng), True) for _ in range(40)]
    model = secret_scan.fit(spark.createDataFrame(samples, "sample string, secret boolean"))
    three, two, one, pair, after = Counter(), Counter(), Counter(), Counter(), Counter()
    kind_of = lambda s: frozenset("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in s)
    for s, is_secret in samples:
        line = "\0\0" + s
        for i in range(2, len(line)):
            if is_secret:
                pair[(kind_of(s), line[i - 1], line[i])] += 1
                after[(kind_of(s), line[i - 1])] += 1
            else:
                three[line[i - 2:i + 1]] += 1
                two[line[i - 1:i + 1]] += 1
                one[line[i]] += 1
    total = sum(one.values()) + secret_scan.SIZE
    context3, context2 = Counter(), Counter()
    for g, n in three.items():
        context3[g[:2]] += n
    for g, n in two.items():
        context2[g[:1]] += n
    k = 4.0

    def ordinary(x, y, z):
        p1 = (one[z] + 1) / total
        p2 = (two[y + z] + k * p1) / (context2[y] + k)
        return (three[x + y + z] + k * p2) / (context3[x + y] + k)

    def drawn(kind, y, z):
        size = sum(n for c, n in (("a", 26), ("A", 26), ("0", 10), ("+", 6)) if c in kind)
        seen = after[(kind, y)]
        return 0.5 * pair[(kind, y, z)] / seen + 0.5 / size if seen else 1 / size

    for s in identifiers(20, seed=3) + [random_string(rng) for _ in range(20)]:
        line = "\0\0" + s
        want = sum(math.log(drawn(kind_of(s), line[i - 1], line[i])) - math.log(ordinary(*line[i - 2:i + 1]))
                   for i in range(2, len(line)))
        assert math.isclose(model.ratios([s])[0], want, rel_tol=1e-4, abs_tol=1e-3)


def test_planted_strings_are_found_and_masked(spark):
    rng = random.Random(6)
    names = identifiers(2000)
    rows = []
    for i in range(200):
        words = [rng.choice(names) for _ in range(60)]
        if i % 4 == 0:
            words.insert(30, "token=" + random_string(rng, "hex"))
        if i % 5 == 0:
            words.insert(10, random_string(rng, "base64"))
        rows.append((i, " ".join(words)))
    rows += [(500, "x" * 100_000), (501, "-" * 3000), (502, "a " * 50_000 + random_string(rng, "base64"))]
    docs = frame(spark, rows)
    found = secret_scan.fit_by_rules(docs).find(docs)
    got = {r.doc_id: r.spans for r in found.collect()}
    drawn = {i: sum(s.kind == "random" for s in spans) for i, spans in got.items()}
    assert sum(drawn[i] >= 1 for i in range(0, 200, 5)) >= 39 and drawn[502] == 1
    assert sum(drawn[i] for i in range(200) if i % 5) == 0 and drawn[500] == drawn[501] == 0
    for r in secret_scan.redact(found).collect():
        text, want, at = dict(rows)[r.doc_id], "", 0
        edge = -1
        for s in got[r.doc_id]:
            if s.start > edge:
                want += text[at:s.start] + "[secret]"
            edge = at = max(edge, s.end)
        assert r.text == want + text[at:]


def test_secrets_of_nothing(spark):
    docs = frame(spark, [])
    assert secret_scan.fit_by_rules(docs).find(docs).count() == 0


def test_query_of_secrets_keeps_the_base(spark):
    got = {r.doc_id: r for r in queries()["op13_secret_scan"](spark, SF).collect()}
    for d in table(spark, SF, "documents").collect():
        base, r = brute_base(d.text), got[d.doc_id]
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(filter(None, r.spans.split(",")))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
