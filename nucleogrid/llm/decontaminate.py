"""Benchmark decontamination by greedy string tiling.

Seeds: all runs of ``seed`` words of a benchmark item, joined by hash with those of each
document.  For each document and item that share one, running Karp-Rabin greedy string tiling
(Wise, 1993) marks the longest matches that don't overlap, again and again, down to the length
of a seed.  The share of an item's words that are marked is its coverage; order doesn't matter,
so reordered passages are found.

Of the documents' runs only those go into the join that a Bloom filter of all seeds lets pass.
The filter has BITS bits whatever the benchmark's size; it alone is broadcast, and what it lets
pass wrongly finds no partner.  Only a stretch of words that seeds cover can be in a tile, so the
tiling sees these alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as T
from .store import on_workers, release, remove, written

#: Logarithm of the bits of the filter of seeds: 8 MB.
BITS = 26
#: Most documents (40 bytes each) whose removal is broadcast; beyond that both sides are shuffled.
MOST_IDS = 1_000_000
_FIRST_SEARCH, _MULTIPLIER, _MODULUS = 20, 1_000_003, (1 << 61) - 1


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in pattern, start in text, length) of at least ``least`` words.

    Negative words match nothing.  Of equally long matches, that which starts first is marked.
    What a tile leaves free of a match waits for its turn as a shorter match.
    """
    free_p, free_t = [True] * len(pattern), [w >= 0 for w in text]
    found: list[tuple[int, int, int]] = []

    def runs(words: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
        """(hash, start) of each s free words in a row; the hash rolls."""
        top, value, held = pow(_MULTIPLIER, s - 1, _MODULUS), 0, 0
        for i, w in enumerate(words):
            if not free[i]:
                value = held = 0
                continue
            if held == s:
                value, held = (value - words[i - s] * top) % _MODULUS, held - 1
            value, held = (value * _MULTIPLIER + w) % _MODULUS, held + 1
            if held == s:
                yield value, i - s + 1

    def scan(s: int) -> tuple[int, list[tuple[int, int, int]]]:
        table: dict[int, list[int]] = defaultdict(list)
        for h, i in runs(text, free_t, s):
            table[h].append(i)
        longest, matches = 0, []
        for h, p in runs(pattern, free_p, s):
            for t in table.get(h, ()):
                if p and t and pattern[p - 1] == text[t - 1] and free_p[p - 1] and free_t[t - 1]:
                    continue  # the end of a match that starts before
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and free_p[p + k] and free_t[t + k]:
                    k += 1
                if k > 2 * s:
                    return k, []
                if k >= s:
                    matches.append((-k, p, t))
                    longest = max(longest, k)
        return longest, matches

    s = max(least, min(_FIRST_SEARCH, len(pattern)))
    while True:
        longest, matches = scan(s)
        if longest > 2 * s:
            s = longest
            continue
        heapq.heapify(matches)
        while matches:
            k, p, t = heapq.heappop(matches)
            taken = [i for i in range(-k) if not (free_p[p + i] and free_t[t + i])]
            if not taken:
                free_p[p : p - k] = free_t[t : t - k] = [False] * -k
                found.append((p, t, -k))
                continue
            for a, b in zip([-1, *taken], [*taken, -k], strict=True):
                if b - a - 1 >= s:
                    heapq.heappush(matches, (a + 1 - b, p + a + 1, t + a + 1))
        if s <= least:
            return sorted(found)
        s = max(least, s // 2)


def _items(seed: int):
    """(item, item_id, size, words, seeds) of each benchmark row with a word: hashes of its words and of its distinct seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(2)):
                data = T.LOWER[data]
                start, end, at = T.words(data, offsets, T.ALNUM_WORDS)
                hashes = T.word_hashes(data, start, end)
                words = [hashes[at[i] : at[i + 1]] for i in range(b - a)]
                seeds = [np.unique(T.grams(w, min(seed, len(w)))).view(np.int64) if len(w) else [] for w in words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([min(seed, len(w)) for w in words], pa.int32()), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
                    names=["item", "item_id", "size", "words", "seeds"],
                )
        release()

    return run


def _filter(spark: SparkSession, seeds: DataFrame):
    """A broadcast Bloom filter of the seeds: two bits each, put together where the seeds are."""
    mask = (1 << BITS) - 1
    bits = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("seed", BITS).bitwiseAND(F.lit(mask)))).alias("bit"))
    whole = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("held")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[whole["at"].to_numpy(np.int64)] = whole["held"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(out.view(np.uint64))


def _hits(held, sizes: list[int]):
    """(row, doc_id, sha, seeds, at, size, word_at, words) of each text with a run that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, count, task = held.value, 0, TaskContext.get().partitionId() << 40
        mask = np.uint64((1 << BITS) - 1)
        isin = lambda k: (bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) > 0
        for batch in batches:
            for a, _, data, offsets in T.chunks(batch.column(1)):
                lower = T.LOWER[data]
                start, end, at = T.words(lower, offsets, T.ALNUM_WORDS)
                hashes = T.word_hashes(lower, start, end)
                found = []
                for size in sizes:
                    own = T.grams(hashes, size)
                    pos = np.flatnonzero(isin(own & mask))
                    pos = pos[isin((own[pos] >> np.uint64(BITS)) & mask)]
                    row = np.searchsorted(at, pos, side="right") - 1
                    fits = pos + size <= at[row + 1]
                    found.append((row[fits], pos[fits], np.full(int(fits.sum()), size, np.int32), own[pos[fits]].view(np.int64)))
                row, pos, size, seed = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((pos, row))
                row, pos, size, seed = row[order], pos[order], size[order], seed[order]
                out = []
                for r in np.unique(row):
                    x, y = np.searchsorted(row, [r, r + 1])
                    word = np.unique(np.concatenate([pos[x:y] + k for k in range(int(size[x:y].max()))]))
                    word = word[word < at[r + 1]]
                    sha = hashlib.sha256(data[offsets[r] : offsets[r + 1]].tobytes()).hexdigest()
                    out.append((task | count, batch.column(0)[a + int(r)].as_py(), sha, seed[x:y], (pos[x:y] - at[r]).astype(np.int32), size[x:y], (word - at[r]).astype(np.int32).tobytes(), hashes[word].tobytes()))
                    count += 1
                if out:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["row", "doc_id", "sha", "seeds", "at", "size", "word_at", "words"])
        release()

    return run


def _tilings(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, sha, item, size, seeds, word_at, words, pattern in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = dict(zip(np.frombuffer(word_at, np.int32).tolist(), np.frombuffer(words, np.uint64).tolist(), strict=True))
                known: dict[int, int] = {}
                numbers = [known.setdefault(w, len(known)) for w in np.frombuffer(pattern, np.uint64).tolist()]
                covered, last = [], -1
                for p in sorted(seeds):
                    if p > last + 1 or last < 0:
                        covered.append(-1)
                    covered += range(max(p, last + 1), p + size)
                    last = max(last, p + size - 1)
                found = tiles(numbers, [-1 if p < 0 else known.get(own[p], -1) for p in covered], size)
                marked = sum(x[2] for x in found)
                if found and marked >= share * len(numbers):
                    out.append((doc, sha, item, len(found), marked, len(numbers), max(x[2] for x in found)))
            if out:
                types = (pa.int64(), pa.string(), *(pa.int64() for _ in range(5)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "sha", "item_id", "n_tiles", "covered_words", "item_words", "longest_tile"])
        release()

    return run


def _found(docs: DataFrame, benchmark: DataFrame, seed: int, share: float) -> DataFrame:
    spark = docs.sparkSession
    on_workers(spark)
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    items = written(rows.mapInArrow(_items(seed), "item long, item_id long, size int, words binary, seeds array<long>"), "items").filter("size > 0")
    own = items.select("item", "size", F.explode("seeds").alias("seed"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # ``seed`` of them at most
    out = "doc_id long, sha string, item_id long, n_tiles long, covered_words long, item_words long, longest_tile long"
    if not sizes:
        return spark.createDataFrame([], out)
    held = _filter(spark, own.select("seed"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = written(texts.mapInArrow(_hits(held, sizes), "row long, doc_id long, sha string, seeds array<long>, at array<int>, size array<int>, word_at binary, words binary"), "hits")
    held.destroy()
    # the join of seeds, and what a pair of a document and an item shares
    one = hits.select("row", F.explode(F.arrays_zip("seeds", "at", "size")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.at").alias("at"), F.col("s.size").alias("size"))
    met = one.join(own, ["seed", "size"]).groupBy("row", "item").agg(F.collect_list("at").alias("at"))
    both = met.join(hits.select("row", "doc_id", "sha", "word_at", F.col("words").alias("held")), "row").join(items.drop("seeds"), "item")
    tiled = written(both.select("doc_id", "sha", "item_id", "size", "at", "word_at", "held", "words").mapInArrow(_tilings(share), out), "tilings")
    for table in (hits, items):
        remove(table)
    return tiled


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = 5, share: float = 0.6) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, longest_tile, coverage) where a document holds ``share`` of an item's words or more.

    Words are runs of letters, digits and everything beyond ASCII, A-Z lower-cased.  An item of
    fewer words than a seed must stand whole.  Null and empty texts and items match nothing, nor
    do empty tables; repeated rows and items are reported each, as are rows without a doc_id.
    Texts of any length are read whole.  Of equally long matches the first in the item, then in
    the text, is marked.  Other columns, whatever their names, are not read.
    """
    return _found(docs, benchmark, seed, share).drop("sha").withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, share: float = 0.6) -> DataFrame:
    """The rows of docs, with all their columns, that hold less than ``share`` of every item.

    Repeated rows go or stay together.  Null and empty texts stay, and all rows if the benchmark is empty.
    """
    bad = _found(docs, benchmark, seed, share).select("doc_id", "sha").distinct()
    names = ["bad_id", "bad_sha"]
    while {c.lower() for c in docs.columns} & set(names):
        names = [n + "_" for n in names]
    bad = bad.toDF(*names)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.sha2(F.col("text").cast("string").cast("binary"), 256) == F.col(names[1]))
    return docs.join(F.broadcast(bad) if bad.count() <= MOST_IDS else bad, same, "left_anti")
