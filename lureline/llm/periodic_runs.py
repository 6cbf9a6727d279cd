"""Periodic runs of words, found in tiles per octave of periods and stitched (operator 11).

A *run* is a stretch of consecutive words with smallest period q (words q apart are identical) and
at least ``max(min_length, 2 * q)`` words, which no neighbouring word extends with that period. In
terms of matches: the positions i with word i = word i+q that make up the run are a maximal stretch
``[a, b)`` of at least ``max(q, min_length - q)`` positions; the run is ``[a, b + q)``.

1. *Tiles.* For every octave ``P <= q < 2P`` a document is cut into tiles of ``4P`` words that read
   ``4P + 16`` words beyond their end. A stretch that is long enough for a run holds a whole block
   of B words that begins at a multiple of B (B about P/2), so a tile can hold part of a run only
   if one of its blocks returns q words later. That is seen with one vectorised comparison of block
   hashes; all other tiles are dropped where they are cut. The rest are rows of their own
   (document, octave, first word, words as small numbers), dealt out evenly: a very long document is
   solved by many tasks.
2. *Solving.* A tile is solved on its own: at the boundary before each returning block, the
   Z-function of the words to the right and that of the reversed words to the left give, for all
   periods of the octave, how far the match reaches both ways. Stretches whose root is a power have
   a smaller period and go (the same Z-function tells). Equality is that of the words' numbers; the
   hashes only choose where to look.
3. *Stitching.* Fragments are shuffled by document and period; those that overlap or touch are one
   stretch, since two stretches of a period are separated by a mismatch. This is a window inside
   one document and period.

Words are told apart by 64-bit hashes. Cases: null and empty texts have no words and no run; rows
that repeat an id are documents of their own; an empty table gives no rows; other columns are
ignored. A document's list of runs is shorter than the document; a task must hold one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm import kernels as K
from lureline.llm.common import keyed_rows, scratch

CHUNK = 1 << 19


def needed(period: int, min_length: int) -> int:
    """Matches that a stretch of this period needs to be a run."""
    return max(period, min_length - period)


def block_size(octave: int, min_length: int) -> int:
    """Any stretch that is long enough in the octave holds an aligned block of this size."""
    return (min(needed(q, min_length) for q in range(octave, min(2 * octave, octave + min_length + 1))) + 1) // 2


def tile_sizes(octave: int, min_length: int) -> tuple[int, int]:
    """Words of a tile, and words it reads beyond: enough to see that a run begins in it."""
    return max(4 * octave, 64), 2 * octave + max(2 * octave, min_length) + 4


def returning_blocks(values: np.ndarray, rows: np.ndarray, octave: int, size: int, min_length: int):
    """Beginnings of aligned blocks that return ``octave`` to ``2 * octave - 1`` words later.

    ``values`` are word hashes salted by document, ``rows`` the documents' first words; blocks are
    aligned to their document.
    """
    lengths = np.diff(rows)
    count = np.where(lengths >= max(min_length, 2 * octave), (lengths - size) // size + 1, 0)
    if not count.any():
        return np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    at = rows[doc] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * size
    grams = K.gram_hash(K.prefix_hash(values), size)
    at = at[at < len(grams)]
    later = np.lib.stride_tricks.sliding_window_view(np.pad(grams, (0, 2 * octave)), octave)
    found = []
    step = max(1, (1 << 21) // octave)
    for lo in range(0, len(at), step):
        part = at[lo:lo + step]
        found.append(part[(later[part + octave] == grams[part, None]).any(axis=1)])
    return np.concatenate([*found, np.empty(0, np.int64)])


def cut_tiles(values: np.ndarray, rows: np.ndarray, min_length: int):
    """``(document, octave, first word, end)`` of every tile that a returning block concerns."""
    lengths = np.diff(rows)
    salt = K.mix(np.arange(len(lengths), dtype=np.uint64) + np.uint64(1))
    salted = values + np.repeat(salt, lengths)
    out, octave = [], 1
    while len(lengths) and 2 * octave <= lengths.max():
        size = block_size(octave, min_length)
        at = returning_blocks(salted, rows, octave, size, min_length)
        if len(at):
            own, beyond = tile_sizes(octave, min_length)
            doc = np.searchsorted(rows, at, side="right") - 1
            inside = at - rows[doc]
            # a stretch that begins in a tile, or crosses its front, has a block in the tile or at its end
            early = (inside % own < size) & (inside >= own)
            tiles = np.unique(np.concatenate([
                np.stack([doc, inside // own], axis=1),
                np.stack([doc[early], inside[early] // own - 1], axis=1)]), axis=0)
            first = tiles[:, 1] * own
            last = np.minimum(first + own + beyond, lengths[tiles[:, 0]])
            out.extend(zip(tiles[:, 0].tolist(), [octave] * len(tiles), first.tolist(), last.tolist()))
        octave *= 2
    return out


def z_function(s: list) -> list[int]:
    """z[i]: length of the longest common prefix of s and s[i:]."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def solve_tile(words: np.ndarray, octave: int, min_length: int) -> list[tuple[int, int, int]]:
    """Fragments ``(period, a, b)`` of the stretches of matches seen in one tile."""
    n, size = len(words), block_size(octave, min_length)
    values = K.mix(words.astype(np.uint64) + np.uint64(1))
    grams = K.gram_hash(K.prefix_hash(values), size)
    at = np.arange(0, len(grams), size)
    later = np.lib.stride_tricks.sliding_window_view(np.pad(grams, (0, 2 * octave)), octave)
    line, found, reach = words.tolist(), {}, np.zeros(2 * octave, np.int64)
    step = max(1, (1 << 21) // octave)
    out = []
    for lo in range(0, len(at), step):
        part = at[lo:lo + step]
        hits = later[np.minimum(part + octave, len(later) - 1)] == grams[part, None]
        for c, row in zip(part[hits.any(axis=1)].tolist(), hits[hits.any(axis=1)]):
            periods = np.flatnonzero(row) + octave
            if (reach[periods] > c).all():
                continue  # all of these matches belong to fragments that are already known
            ahead = z_function(line[c:])
            back = line[max(0, c - size):c][::-1]
            behind = z_function([*back, -1, *line[max(0, c - size):c + 2 * octave - 1][::-1]])
            q = np.arange(octave, min(2 * octave, n - c))
            right = np.array(ahead[octave:octave + len(q)], np.int64)
            left = np.array(behind, np.int64)[len(back) + 1 + min(2 * octave - 1, n - c) - q]
            long = np.flatnonzero(left + right >= np.maximum(q, min_length - q))
            for q, a, b in zip(q[long].tolist(), (c - left[long]).tolist(), (c + right[long]).tolist()):
                reach[q] = max(reach[q], b)
                if any(ahead[q // r] >= q - q // r for r in prime_factors(q)):
                    continue
                known = found.get(q)
                if known is not None and a <= known[1]:
                    known[0], known[1] = min(a, known[0]), max(b, known[1])
                    continue
                if known is not None:
                    out.append((q, *known))
                found[q] = [a, b]
    return out + [(q, *known) for q, known in found.items()]


_CUT = ("kind int, _rid long, _id {id}, n_words long, body string, sha string, "
        "octave int, first long, words binary")


def _cut(min_length: int, with_text: bool):
    def run(batches):
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            ids, rids = batch.column("_id"), batch.column("_rid")
            for i, j in K.doc_chunks(offsets, CHUNK):
                part = data[offsets[i]:offsets[j]]
                values, rows = K.word_hashes(part, offsets[i:j + 1] - offsets[i])
                tiles = cut_tiles(values, rows, min_length)
                periodic = {d for d, *_ in tiles}
                sizes, bodies, shas = [], [], []
                for d in range(j - i):
                    body = b" ".join(data[offsets[i + d]:offsets[i + d + 1]].tobytes().split())  # ASCII white space
                    keep = with_text or d in periodic
                    sizes.append(int(rows[d + 1] - rows[d]))
                    bodies.append(body.decode() if keep else None)
                    shas.append(None if d in periodic else hashlib.sha256(body).hexdigest())
                k = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * k, pa.int32()), rids.slice(i, k), ids.slice(i, k), pa.array(sizes, pa.int64()),
                     pa.array(bodies, pa.string()), pa.array(shas, pa.string()), pa.nulls(k, pa.int32()),
                     pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=_NAMES)
                numbers = {d: np.unique(values[rows[d]:rows[d + 1]], return_inverse=True)[1].astype("<i4")
                           for d in periodic}
                for lo in range(0, len(tiles), 256):
                    some = tiles[lo:lo + 256]
                    own = [numbers[d][a:b].tobytes() for d, _, a, b in some]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([1] * k, pa.int32()), rids.take(pa.array([i + t[0] for t in some])),
                         pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()),
                         pa.nulls(k, pa.string()), pa.array([t[1] for t in some], pa.int32()),
                         pa.array([t[2] for t in some], pa.int64()), pa.array(own, pa.binary())], names=_NAMES)

    return run


_NAMES = ["kind", "_rid", "_id", "n_words", "body", "sha", "octave", "first", "words"]


def _solve(min_length: int):
    def run(batches):
        for batch in batches:
            rid, period, start, end = [], [], [], []
            for r, octave, first, words in zip(*[batch.column(c).to_pylist() for c in ("_rid", "octave", "first", "words")]):
                for q, a, b in solve_tile(np.frombuffer(words, "<i4"), octave, min_length):
                    rid.append(r)
                    period.append(q)
                    start.append(first + a)
                    end.append(first + b)
            yield pa.RecordBatch.from_pydict({
                "_rid": pa.array(rid, pa.int64()), "period": pa.array(period, pa.int64()),
                "a": pa.array(start, pa.int64()), "b": pa.array(end, pa.int64())})

    return run


def stitch(fragments: DataFrame) -> DataFrame:
    """``_rid, start, length, period`` from fragments ``_rid, period, a, b``."""
    before = Window.partitionBy("_rid", "period").orderBy("a", "b")
    reach = F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("stretch", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_rid", "period", "stretch").agg(F.min("a").alias("start"), F.max("b").alias("b")) \
        .select("_rid", "start", (F.col("b") - F.col("start") + F.col("period")).alias("length"), "period")


def _collapse(with_text: bool):
    """Drop the words that a run holds behind its first period."""
    def run(batches):
        for batch in batches:
            shas, texts = [], []
            for body, runs, sha in zip(*[batch.column(c).to_pylist() for c in ("body", "runs", "sha")]):
                if runs:
                    words = body.split(" ")
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        edge[r["start"] + r["period"]] += 1
                        edge[r["start"] + r["length"]] -= 1
                    body = " ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])
                if runs or sha is None:
                    sha = hashlib.sha256(body.encode()).hexdigest()
                shas.append(sha)
                texts.append(body)
            columns = {c: batch.column(c) for c in ("_id", "n_words", "runs")} | {"collapsed_sha256": pa.array(shas)}
            if with_text:
                columns["collapsed_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema(
                [(k, v.type) for k, v in columns.items()]))

    return run


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12,
                  with_text: bool = True) -> DataFrame:
    """``<id>, n_words, runs (array of start, length, period by start, then period),
    collapsed_sha256[, collapsed_text]``: all runs, and the text without what they repeat."""
    rows = keyed_rows(docs.select(id_col, text_col), id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    cut = scratch(rows.select("_rid", F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
                  .mapInArrow(_cut(min_length, with_text), _CUT.format(id=kind)), "tiles")
    tiles = cut.filter("kind = 1").select("_rid", "octave", "first", "words").repartition("_rid", "octave", "first")
    runs = stitch(tiles.mapInArrow(_solve(min_length), "_rid long, period long, a long, b long"))
    lists = runs.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found")) \
        .select("_rid", F.transform("found", lambda r: F.struct(
            r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    own = cut.filter("kind = 0").select("_rid", "_id", "n_words", "body", "sha")
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    plain = own.filter("sha is not null").select("_id", "n_words", "body", "sha", none.alias("runs"))
    periodic = own.filter("sha is null").join(lists, "_rid", "left") \
        .select("_id", "n_words", "body", "sha", F.coalesce("runs", none).alias("runs"))
    schema = (f"_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
              f"collapsed_sha256 string" + (", collapsed_text string" if with_text else ""))
    return plain.unionByName(periodic).mapInArrow(_collapse(with_text), schema).withColumnRenamed("_id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """The runs of each row as counts, the greatest one, and the hash of all their lines."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    order = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best = found.withColumn("_best", order)
    return best.select(
        "*", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"), F.col("_best.p").alias("period"),
        F.expr("(-1000 * _best.l) div _best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256")).drop("_best")


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the contract's planted runs: for a tenth of the ids (by crc32) the words from
    position a on repeat the p words that begin there."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) div 10")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = docs.withColumn("_g", (g % 8).cast("int")).withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w")) \
        .withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")).cast("int")) \
        .withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g)").cast("int"))
    rest = F.col("_n") - F.col("_a")
    times = F.ceil(rest / F.col("_p")).cast("int")
    tail = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(F.flatten(F.array_repeat(
        F.slice("_w", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), rest))
    text = F.when(F.col("_n") > 0, F.array_join(tail, " ")).otherwise(F.col(text_col))
    return planted.withColumn(text_col, text).select(*docs.columns)
