"""Cross-tokenizer alignment with counts behind a minimal perfect hash (operator 12).

Both tokenizers encode blank + text (the second one puts that blank itself). Byte offsets where
tokens of both end cut the text into groups; two token occurrences are *linked* where their byte
ranges overlap. The count of a pair of ids is the number of links that hold it, over all documents.

1. The first pass aligns every document. Each task sums its pairs; the sums are written once.
2. The distinct pairs get a minimal perfect hash (``perfect_hash``), built per shard of pairs, with
   the pairs stored by their numbers so that look-ups are verified.
3. Each task adds its sums into dense vectors indexed by that hash, one per shard; the vectors are
   summed as a tree: first within groups of tasks, then over the groups.
4. The second pass aligns the documents again and looks up the counts.

The hash, the pairs and the counts are broadcast at most ``slice_pairs`` pairs at a time; a corpus
with more distinct pairs takes one pass over the documents per slice, whose sums add up. The highest
count per id of the second tokenizer is one number per id of its vocabulary.

Where a blank or line feed stands alone between two other characters, no token of either vocabulary
runs across its front (checked when the second vocabulary is loaded). So texts are cut there, and a
task aligns equal cuts once; the result is that of encoding whole texts.

Cases: null and empty texts, and texts that either tokenizer does not give back byte for byte, have
no tokens (zeros) and add no links; special tokens' strings are plain text; rows that repeat an id
count each; an empty table gives no rows; other columns are ignored. A very long text is held whole
by one task; its tokens are taken cut by cut.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.llm import perfect_hash as H
from lureline.llm.common import drop_scratch, keyed_rows, scratch

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_CUT = re.compile(r"(?:\A\s*|[ \n])\S+(?:(?:\s{2,}|[^\S \n])\S+)*(?:\s+\Z)?|\s+")
_tools: dict = {}


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Fixed value: the pattern that splits text before byte-level merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(a_path: str, tokens: list[bytes]):
    """The byte-level vocabulary as ranks, where its merges stand in the order of their ids (several
    times faster); None where they do not."""
    import tiktoken
    with open(a_path, encoding="utf-8") as file:
        given = json.load(file)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    model, before = given["model"], given["pre_tokenizer"] or {}
    special = {t["id"] for t in given["added_tokens"]}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    in_order = [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))
    if model["type"] != "BPE" or given["normalizer"] or not in_order or \
            any(before.get(k) != v for k, v in plain.items()):
        return None
    return tiktoken.Encoding("given", pat_str=_SPLIT, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in special})


class Tokenizers:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_size, self.b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [bytes(alphabet.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(self.a_size)]
        pieces = self.b.id_to_piece(list(range(self.b_size)))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_lengths = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_lengths = np.array(list(map(len, self.b_bytes)), np.int64)
        self.digits = pa.array([str(i) for i in range(max(self.a_size, self.b_size))], pa.string())
        self.blank = self.b.piece_to_id("▁")
        self.fast = ranked(a_path, self.a_bytes)
        # no piece holds a blank behind another character, or a line feed: texts may be cut there
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces)

    def cut(self, text: str) -> list[str]:
        """Cuts of blank + text; a cut that does not begin with white space has a blank before it."""
        if not self.cuts:
            return [" " + text]
        pairs = ("  ", " \n", "\n ", "\n\n")
        if not (any(p in text for p in pairs) or text[0].isspace() or text[-1].isspace()
                or any(c in text for c in _OTHER_SPACE)):  # nothing but single blanks and line feeds
            return text.replace("\n", " \n").split(" ")
        whole = " " + text
        cuts = _CUT.findall(whole)
        if sum(map(len, cuts)) != len(whole):
            return [whole]
        return [c[1:] if c[0] == " " and not c[1:2].isspace() and len(c) > 1 else c for c in cuts]

    def encode_a(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts one after the other, and how many each cut has."""
        whole = [c if c[0].isspace() else " " + c for c in cuts]
        if self.fast is None:
            ids = [e.ids for e in self.a.encode_batch(whole, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.int64), np.array(list(map(len, ids)), np.int64)
        # cuts that begin with one white space and end in another character may follow each other
        plain = [len(c) > 1 and not c[1].isspace() and not c[-1].isspace() for c in whole]
        line = "".join([c for c, p in zip(whole, plain) if p])
        joined = np.array(self.fast.encode_ordinary(line), np.int64)
        ends = np.cumsum([len(c.encode("utf-8", "replace")) for c, p in zip(whole, plain) if p]).astype(np.int64)
        upto = np.searchsorted(np.cumsum(self.a_lengths[joined]), ends, side="right")
        if all(plain):
            return joined, np.diff(upto, prepend=0)
        own = iter(np.split(joined, upto[:-1]))
        ids = [next(own) if p else self.fast.encode_ordinary(c) for c, p in zip(whole, plain)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array(list(map(len, ids)), np.int64)

    def encode_b(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for B, which puts the leading blank itself (in front of a line feed it goes again)."""
        ids = self.b.encode([c[1:] if c[0] == " " else c for c in cuts], num_threads=1)
        for i, c in enumerate(cuts):
            if c[0] == "\n":
                ids[i] = ids[i][1:] if ids[i][:1] == [self.blank] else []
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array(list(map(len, ids)), np.int64)


def _same_bytes(raw: list[bytes], ids: np.ndarray, counts: np.ndarray, table: list[bytes]) -> np.ndarray:
    """Whether the tokens of every cut give back its bytes."""
    parts = list(map(table.__getitem__, ids.tolist()))
    ends = np.cumsum(counts)
    sizes = np.concatenate([[0], np.cumsum(list(map(len, parts)))])
    if np.array_equal(sizes[ends], np.cumsum(list(map(len, raw)))) and b"".join(parts) == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([b"".join(parts[e - n:e]) == r for r, n, e in zip(raw, counts.tolist(), ends.tolist())], bool)


class Cuts:
    """Alignments of the distinct cuts that a task has met."""

    def __init__(self, tools: Tokenizers, look_up=None, with_said: bool = False):
        self.tools, self.look_up, self.with_said = tools, look_up, with_said
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.said: list[str] = []
        self.size = 0
        self.pairs, self.starts = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.sums = np.empty((0, 7), np.int64)  # n_a, n_b, n_groups, n_links, bad, n_best, count_sum

    def add(self, cuts: list[str]) -> None:
        """Align cuts, all of them at once: the ends of all tokens as byte offsets of one line."""
        tools = self.tools
        a, n_a = tools.encode_a(cuts)
        b, n_b = tools.encode_b(cuts)
        raw = [(c if c[0].isspace() else " " + c).encode("utf-8", "replace") for c in cuts]
        ok = _same_bytes(raw, a, n_a, tools.a_bytes) & _same_bytes(raw, b, n_b, tools.b_bytes)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        end_a, end_b = np.cumsum(tools.a_lengths[a]), np.cumsum(tools.b_lengths[b])
        sizes = np.array(list(map(len, raw)), np.int64)
        end = np.cumsum(np.where(ok, sizes, 0))
        # between two neighbouring ends lies one overlap of one token of A and one of B: a link
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        both = ends[1:] == ends[:-1]
        groups, links = ends[1:][both], ends[np.concatenate([[True], ~both])] if len(ends) else ends
        new = a[np.searchsorted(end_a, links)] * tools.b_size + b[np.searchsorted(end_b, links)]
        upto = np.searchsorted(links, end, side="right")
        table = np.zeros((len(cuts), 7), np.int64)
        table[:, 0], table[:, 1] = n_a, n_b
        table[:, 2] = np.diff(np.searchsorted(groups, end, side="right"), prepend=0)
        table[:, 3] = np.diff(upto, prepend=0)
        table[:, 4] = ~ok
        if self.look_up is not None and len(new):
            for k, values in zip((5, 6), self.look_up(new)):
                total = np.concatenate([[0], np.cumsum(values)])
                table[:, k] = np.diff(total[upto], prepend=0)
        if self.with_said:
            self.said.extend(self._said(a, b, end_a, end_b, groups, end))
        self.index.update(zip(cuts, range(len(self.index), len(self.index) + len(cuts))))
        self.size += int(sizes.sum())
        self.starts = np.concatenate([self.starts, len(self.pairs) + upto])
        self.pairs = np.concatenate([self.pairs, new])
        self.sums = np.concatenate([self.sums, table])

    def _said(self, a, b, end_a, end_b, groups, end) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every cut: tokens by group, then side, each with what follows it."""
        place = np.concatenate([2 * np.searchsorted(groups, end_a), 2 * np.searchsorted(groups, end_b) + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        last = np.ones(len(place), bool)
        last[:-1] = place[1:] != place[:-1]
        closes = last & (place % 2 == 1)
        closed = groups[place[closes] // 2]
        mark = np.where(last, 1, 0)
        mark[closes] = np.where(np.isin(closed, end), 3, 2)
        tokens = pc.binary_join_element_wise(self.tools.digits.take(pa.array(np.concatenate([a, b])[order])),
                                             pa.array([",", "|", ";", ""]).take(pa.array(mark)), "")
        behind = np.concatenate([[0], np.flatnonzero(closes) + 1])[np.searchsorted(groups, end, side="right")]
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], behind]), pa.int64()), tokens)
        return pc.binary_join(lists, "").to_pylist()

    def numbers(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The numbers of every text's cuts (null and empty: none)."""
        cuts = [self.tools.cut(t) if t else [] for t in texts]
        known = [np.fromiter(map(self.index.get, c, repeat(-1)), np.int64, len(c)) for c in cuts]
        gaps = [np.flatnonzero(k < 0).tolist() for k in known]
        unknown = {c[i] for c, gap in zip(cuts, gaps) for i in gap}
        if unknown:
            self.add(sorted(unknown))
        for c, own, gap in zip(cuts, known, gaps):
            if gap:
                own[gap] = [self.index[c[i]] for i in gap]
        return [own if len(own) else None for own in known]

    @property
    def full(self) -> bool:
        return len(self.index) > 400_000 or self.size > 1 << 25


def _loaded(key, make):
    if key not in _tools:
        for old in [k for k in _tools if k[0] == key[0]]:
            del _tools[old]
        _tools[key] = make()
    return _tools[key]


def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    return _loaded(("tokenizers", paths), lambda: Tokenizers(*paths))


def _blocks(batch: pa.RecordBatch, limit: int = 1 << 22):
    """Consecutive row ranges of a batch of about ``limit`` characters, as ``(first row, texts)``."""
    texts, first, size = [], 0, 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        texts.append(text)
        size += len(text or "")
        if size >= limit:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def count_pairs(rows: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """First pass: ``pair, n`` per task (a pair is ``a * size of B + b``)."""
    def run(batches):
        cuts, seen = Cuts(_tokenizers(paths)), np.empty(0, np.int64)

        def flush():
            pairs, at = np.unique(cuts.pairs, return_inverse=True)
            weights = np.repeat(seen, np.diff(cuts.starts))
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, weights)
            return pa.RecordBatch.from_pydict({"pair": pa.array(pairs[n > 0]), "n": pa.array(n[n > 0])})

        for batch in batches:
            for _, texts in _blocks(batch):
                own = [o for o in cuts.numbers(texts) if o is not None and not cuts.sums[o, 4].any()]
                seen = np.pad(seen, (0, len(cuts.index) - len(seen)))
                seen += np.bincount(np.concatenate([*own, np.empty(0, np.int64)]), minlength=len(seen))
                if cuts.full:
                    yield flush()
                    cuts.clear()
                    seen = np.empty(0, np.int64)
        yield flush()

    return rows.select("text").mapInArrow(run, "pair long, n long")


def slices(index: DataFrame, slice_pairs: int) -> list[list[int]]:
    """Shards in runs of at most ``slice_pairs`` pairs (one number per shard reaches the driver)."""
    out, held = [[]], 0
    for r in index.select("shard", "n").orderBy("shard").collect():
        if out[-1] and held + r.n > slice_pairs:
            out.append([])
            held = 0
        out[-1].append(r.shard)
        held += r.n
    return out


def _rows(index: DataFrame, shards: list[int]) -> list[dict]:
    return [r.asDict() for r in index.filter(F.col("shard").between(shards[0], shards[-1])).collect()] if shards else []


def tree_sum(vectors: DataFrame, fan_in: int = 16) -> DataFrame:
    """``shard, node, counts`` -> ``shard, counts``: dense vectors added per group of tasks, then in all."""
    def add(table: pa.Table) -> pa.Table:
        total = None
        for value in table.column("counts"):
            own = np.frombuffer(value.as_buffer(), "<i8")
            total = own.copy() if total is None else total + own
        return table.slice(0, 1).select(["shard", "node"]).append_column("counts", pa.array([total.tobytes()], pa.binary()))

    kind = "shard int, node int, counts binary"
    lower = vectors.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
    upper = lower.groupBy("shard", "node").applyInArrow(add, kind).withColumn("node", F.lit(0))
    return upper.groupBy("shard").applyInArrow(add, kind).select("shard", "counts")


def dense_counts(partial: DataFrame, index: DataFrame, shards: int, parts: list[list[int]]) -> DataFrame:
    """``shard, counts``: the corpus-wide counts of a shard's pairs, in the order of their numbers."""
    out = None
    for part in parts:
        key, shared = uuid.uuid4().hex, partial.sparkSession.sparkContext.broadcast(_rows(index, part))

        def run(batches, key=key, shared=shared, wanted=part):
            from pyspark import TaskContext
            held = _loaded(("hash", key), lambda: H.PerfectHash(shared.value, shards))
            vector = np.zeros(held.count, np.int64)
            for batch in batches:
                pairs = batch.column("pair").to_numpy()
                at = held(pairs)
                mine = at >= 0
                if int((~mine & np.isin(H.shard_of(pairs, shards), wanted)).sum()):
                    raise ValueError("a counted pair is not among the hashed pairs")
                np.add.at(vector, at[mine], batch.column("n").to_numpy()[mine])
            edges = [*held.first[np.array(held.ids, np.int64)].tolist(), held.count]
            used = [(s, vector[a:b]) for s, a, b in zip(held.ids, edges, edges[1:]) if vector[a:b].any()]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([s for s, _ in used], pa.int32()),
                "node": pa.array([TaskContext.get().partitionId()] * len(used), pa.int32()),
                "counts": pa.array([v.astype("<i8").tobytes() for _, v in used], pa.binary())})

        sums = tree_sum(partial.mapInArrow(run, "shard int, node int, counts binary"))
        out = sums if out is None else out.unionByName(sums)
    return out


def pair_counts(table: DataFrame, b_size: int) -> DataFrame:
    """``a, b, n`` of every distinct pair from the index with its counts."""
    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                pairs = np.frombuffer(keys.as_buffer(), "<i8")
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(pairs // b_size), "b": pa.array(pairs % b_size),
                    "n": pa.array(np.frombuffer(counts.as_buffer(), "<i8"))})

    return table.select("keys", "counts").mapInArrow(run, "a long, b long, n long")


class Alignment:
    """Counted pairs of a corpus: ``table`` (index and counts per shard) and what ``annotate`` needs."""

    def __init__(self, table: DataFrame, shards: int, parts: list[list[int]], paths: tuple[str, str], b_size: int):
        self.table, self.shards, self.parts, self.paths, self.b_size = table, shards, parts, paths, b_size

    def pairs(self) -> DataFrame:
        """``a, b, n``: every pair of ids that is linked anywhere, with its count."""
        return pair_counts(self.table, self.b_size)

    def annotate(self, rows: DataFrame, id_col: str, with_groups: bool = False) -> DataFrame:
        """Second pass over rows ``_rid, <id>, text``."""
        best = np.zeros(self.b_size, np.int64)
        for r in self.pairs().groupBy("b").agg(F.max("n").alias("n")).collect():  # one row per id of B
            best[r.b] = r.n
        kind = rows.schema[id_col].dataType.simpleString()
        said = ", groups string" if with_groups else ""
        schema = (f"_rid long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                  f"count_sum long, groups_sha256 string{said}")
        out = None
        for k, part in enumerate(self.parts):
            key = uuid.uuid4().hex
            shared = rows.sparkSession.sparkContext.broadcast((_rows(self.table, part), best))
            one = rows.select("_rid", F.col(id_col).alias("_id"), "text").mapInArrow(
                self._second_pass(key, shared, k == 0, with_groups and k == 0), schema.replace(said, said if k == 0 else ""))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if len(self.parts) > 1:
            names = [c for c in out.columns if c not in ("_rid", "_id", "groups_sha256", "groups")]
            text = [c for c in ("groups_sha256", "groups") if c in out.columns]
            out = out.groupBy("_rid").agg(F.max("_id").alias("_id"), *[F.sum(c).alias(c) for c in names],
                                          *[F.max(c).alias(c) for c in text])
        return out.select(F.col("_id").alias(id_col), *[c for c in out.columns if c not in ("_rid", "_id")])

    def _second_pass(self, key, shared, first: bool, with_groups: bool):
        paths, shards, b_size = self.paths, self.shards, self.b_size

        def load():
            rows, best = shared.value
            held = H.PerfectHash(rows, shards)
            counts = np.concatenate([*[np.frombuffer(r["counts"], "<i8") for r in sorted(rows, key=lambda r: r["shard"])],
                                     np.empty(0, np.int64)])

            def look_up(pairs):
                at = held(pairs)  # -1: a pair of another slice
                n = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
                return (at >= 0) & (n == best[pairs % b_size]), n
            return look_up

        def run(batches):
            cuts = Cuts(_tokenizers(paths), _loaded(("counts", key), load), with_said=first)
            for batch in batches:
                for lo, texts in _blocks(batch):
                    sums, shas, said = np.zeros((len(texts), 7), np.int64), [], []
                    for i, own in enumerate(cuts.numbers(texts)):
                        ok = own is not None and not cuts.sums[own, 4].any()
                        groups = ";".join([cuts.said[k] for k in own.tolist()]) if ok and first else ""
                        if ok:
                            sums[i] = cuts.sums[own].sum(axis=0) if first else cuts.sums[own].sum(axis=0) * [0, 0, 0, 0, 0, 1, 1]
                        shas.append(hashlib.sha256(groups.encode()).hexdigest() if ok and first else "")
                        said.append(groups)
                    ids = batch.slice(lo, len(texts))
                    columns = {"_rid": ids.column("_rid"), "_id": ids.column("_id")}
                    names = ("n_a", "n_b", "n_groups", "n_links", None, "n_best", "count_sum")
                    columns |= {name: pa.array(sums[:, k]) for k, name in enumerate(names) if name}
                    columns["groups_sha256"] = pa.array(shas, pa.string())
                    if with_groups:
                        columns["groups"] = pa.array(said, pa.string())
                    yield pa.RecordBatch.from_pydict(columns)
                    if cuts.full:
                        cuts.clear()

        return run


def fit(rows: DataFrame, a_path: str, b_path: str, slice_pairs: int = 1 << 21) -> Alignment:
    """First pass over rows with ``text``: hash and counts of all pairs."""
    paths = (a_path, b_path)
    partial = scratch(count_pairs(rows, paths), "pairs")
    distinct = scratch(partial.select("pair").distinct(), "distinct")
    shards = max(1, -(-distinct.count() // H.SHARD_KEYS))
    index = scratch(H.build_shards(distinct, "pair", shards), "hash")
    parts = slices(index, slice_pairs)
    counts = dense_counts(partial, index, shards, parts)
    table = scratch(index.join(counts, "shard"), "counts")
    drop_scratch(partial, distinct, index)
    return Alignment(table, shards, parts, paths, Tokenizers(*paths).b_size)


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}",
                    slice_pairs: int = 1 << 21, with_groups: bool = False) -> DataFrame:
    """``<id>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]`` per row.

    ``n_best`` counts the links whose pair has the highest count of its id of B, ``count_sum`` adds
    the counts of all links; ``groups`` is ``a1,a2|b1;a3|b2,b3`` (ids in order).
    """
    rows = keyed_rows(docs.select(id_col, text_col), id_col, text_col).withColumnRenamed(text_col, "text")
    return fit(rows, a_path, b_path, slice_pairs).annotate(rows, id_col, with_groups)
