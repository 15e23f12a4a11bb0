"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams, that of their 64-bit hashes, is cut into F fragments.

1. *Recurring n-grams.*  Each batch of rows sends every fragment the distinct n-grams that it
   has there, with how many of its rows hold each; one task a fragment adds these up and gives
   each batch the frequency of its own.  An n-gram found once overlaps with nothing, so the
   recurring ones of a set, summed over the fragments, bound its overlap with any other set:
   most sets end here.
2. *Candidates.*  A set with fewer than ``need`` n-grams in common with another shares one of
   its ``size - need + 1`` rarest with it, by the global order (frequency, hash).  Sets meet in a
   join on those only, and on where they stand in that order.
3. *Overlaps.*  The overlap of each candidate pair is counted exactly, separately in each of
   PARTS fragments, and summed.

Equal sets are one node throughout.  Pairs inside a group are not all made: each node is first
checked against the node of its buckets whose n-grams recur most (of a group of edited copies,
that is the original), and afterwards only pairs of different components are, so components
are exact.  What a task holds is a fragment (F grows with the text) or a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import text as T
from .components import components
from .store import on_workers, release, remove, written

#: Bytes of text of a batch, and of the text whose n-grams a fragment has.
BATCH, FRAGMENT = 2 << 20, 8 << 20
#: Ranges of hashes whose overlaps are counted separately.
PARTS = 4
#: Bytes of the parity bitmap of a set; two bitmaps never differ more than their sets do.
WIDE = 256
#: Most nodes (24 bytes each) that are sent to every executor; beyond that both sides of a join are shuffled.
MOST_IDS = 1_000_000

_DEALT = "key long, batch long, fragment int, low binary, many binary, refs binary, opens binary, doc_id array<long>, size binary, digest binary"
_RATED = "batch long, fragment int, low binary, rate binary, refs binary, opens binary, doc_id array<long>, size binary, digest binary"
_MARKED = "doc_id long, n_shingles long, digest binary, gram long, pos int, rate int"


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    data = T.LOWER[data]
    start, end, at = T.words(data, offsets, T.BLANK_WORDS)
    hashes = T.word_hashes(data, start, end)
    all_grams = T.grams(hashes, n)
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        yield np.unique(all_grams[a : b - n + 1]) if b - a >= n else T.grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> bytes | None:
    """128 bits for a set; None for an empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as zstd of their bytes, all first bytes together, then all second ones, and so on."""
    return pa.compress(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _dealt(n: int, fragments: int):
    """Of each batch of rows (doc_id, text): its distinct n-grams by fragment, and one row with who holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for rows in batches:
            for a, b, data, offsets in T.chunks(rows.column(1), BATCH):
                found = list(sets(data, offsets, n))
                digest = b"".join(_digest(s) or bytes(16) for s in found)
                size = np.array([len(s) for s in found], np.int64)
                grams = np.concatenate(found)
                gram = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32) << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF))
                order = np.argsort(gram)
                gram = gram[order]
                opens = np.concatenate((np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]))
                first = np.flatnonzero(opens)
                times = np.diff(np.append(first, len(gram)))
                gram = gram[first]
                refs = np.repeat(np.arange(b - a, dtype=np.uint32), size)[order]
                batch = int.from_bytes(hashlib.blake2b(digest + task.to_bytes(8) + count.to_bytes(8), digest_size=8).digest(), signed=True)
                count += 1
                part, at = np.unique((gram >> np.uint64(32)).astype(np.int32), return_index=True)
                low, many = (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32), []
                for x, y in zip(at, np.append(at[1:], len(gram))):
                    repeated = np.flatnonzero(times[x:y] > 1)
                    many.append(np.stack((repeated, times[x:y][repeated])).astype(np.uint32).tobytes())
                k = len(part)
                blank = [None] * k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*part.tolist(), batch % fragments], pa.int64()), pa.array([batch] * (k + 1), pa.int64()), pa.array([*part.tolist(), -1 - k], pa.int32()),
                        pa.array([*(_packed(np.diff(low[x:y], prepend=np.uint32(0))) for x, y in zip(at, np.append(at[1:], len(gram)))), None], pa.binary()), pa.array([*many, None], pa.binary()),
                        pa.array([*blank, _packed(refs)], pa.binary()), pa.array([*blank, np.packbits(opens).tobytes()], pa.binary()),
                        pa.array([*blank, rows.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())), pa.array([*blank, size.tobytes()], pa.binary()), pa.array([*blank, digest], pa.binary()),
                    ],
                    names=[c.split()[0] for c in _DEALT.split(", ")],
                )
        release()

    return run


def _rates(times: np.ndarray) -> np.ndarray:
    """A byte that never falls with the frequency: 0 for 1, eighths of its logarithm beyond."""
    return np.minimum(255, 8 * np.log2(times)).astype(np.uint8)


def _rated(rows: pa.Table) -> pa.Table:
    """Of a fragment's rows: the rate of each n-gram of each batch, and the n-grams that recur; rows without a fragment go on as they are."""
    names = [c.split()[0] for c in _RATED.split(", ")]
    rows = rows.combine_chunks()
    own = rows.filter(pc.greater_equal(rows["fragment"], 0))
    rest = rows.filter(pc.less(rows["fragment"], 0)).drop_columns(["key", "many"])
    rest = rest.add_column(3, "rate", pa.nulls(len(rest), pa.binary())).select(names)
    if not len(own):
        return rest
    held = [np.cumsum(_unpacked(x, np.uint32), dtype=np.uint32) for x in own["low"].to_pylist()]
    edge = np.cumsum([0, *map(len, held)])
    low = np.concatenate(held)
    weight = np.ones(len(low), np.int64)
    for at, many in zip(edge, own["many"].to_pylist()):
        where, times = np.frombuffer(many, np.uint32).reshape(2, -1)
        weight[at + where] = times
    packed = np.sort((low.astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64))
    place = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    packed >>= np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    total = np.add.reduceat(weight[place], first)
    rate = np.empty(len(low), np.uint8)
    rate[place] = np.repeat(_rates(total), np.diff(np.append(first, len(low))))
    again, rates = [], []
    for x, y in zip(edge[:-1], edge[1:]):
        mine = rate[x:y]
        again.append(low[x:y][mine > 0].tobytes())
        rates.append(pa.compress(mine.tobytes(), codec="zstd", asbytes=True))
    blank = pa.nulls(len(own), pa.binary())
    out = pa.table([own["batch"], own["fragment"], pa.array(again, pa.binary()), pa.array(rates, pa.binary()), blank, blank, pa.nulls(len(own), pa.list_(pa.int64())), blank, blank], names=names)
    return pa.concat_tables([out, rest.cast(out.schema)])


def _marked(num: int, den: int):
    """Of a batch's rows: each document, and the rarest recurring n-grams of the sets that may link."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("fragment").combine_chunks()
        head = rows.slice(0, 1).to_pylist()[0]
        if head["refs"] is None or len(rows) != -head["fragment"]:
            raise RuntimeError("the rows of a batch were dealt differently on two reads")
        size = np.frombuffer(head["size"], np.int64)
        digests = [head["digest"][16 * i : 16 * i + 16] if k else None for i, k in enumerate(size)]
        total = int(size.sum())
        refs = _unpacked(head["refs"], np.uint32).astype(np.int64)
        of = np.cumsum(np.unpackbits(np.frombuffer(head["opens"], np.uint8), count=total), dtype=np.int64) - 1
        parts, unpack = rows.slice(1), zstandard.ZstdDecompressor().decompress
        rate = np.frombuffer(b"".join(map(unpack, parts["rate"].to_pylist())), np.uint8)
        gram = np.zeros(len(rate), np.int64)
        gram[rate > 0] = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(low, np.uint32).astype(np.int64) | (f << 32) for f, low in zip(parts["fragment"].to_pylist(), parts["low"].to_pylist()))])
        rate, gram = rate[of], gram[of]
        recurs = np.flatnonzero(rate)
        common = np.bincount(refs[recurs], minlength=len(size))
        weight = np.bincount(refs[recurs], weights=rate[recurs], minlength=len(size))
        need = -(-num * size // den)
        recurs = recurs[(common >= need)[refs[recurs]]]
        node = refs[recurs]
        recurs = recurs[np.lexsort((gram[recurs], rate[recurs], node))]
        node = refs[recurs]
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(node)), bool), node[1:] != node[:-1])))
        rank = np.arange(len(node)) - np.repeat(begin, np.diff(np.append(begin, len(node))))
        pos = size[node] - common[node] + rank
        early = pos <= size[node] - need[node]
        node, pos, recurs = node[early], pos[early], recurs[early]
        k, m = len(size), len(node)
        mean = (100 * weight / np.maximum(1, size)).astype(np.int64)
        return pa.table(
            [
                pa.array([*head["doc_id"], *[None] * m], pa.int64()), pa.array(np.concatenate((size, size[node])), pa.int64()), pa.array([*digests, *(digests[i] for i in node)], pa.binary()),
                pa.array([*[None] * k, *gram[recurs].tolist()], pa.int64()), pa.array([*[None] * k, *pos.tolist()], pa.int32()), pa.array([*[None] * k, *mean[node].tolist()], pa.int32()),
            ],
            names=[c.split()[0] for c in _MARKED.split(", ")],
        )

    return run


def _digests(n: int):
    """Adds the digest of each row's set of the text in the last column, in place of that text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(s) for _, _, data, offsets in T.chunks(batch.column(batch.num_columns - 1)) for s in sets(data, offsets, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=batch.schema.names)
        release()

    return run


def _parts(n: int):
    """Of each set, the sorted hashes in each range, and with the first its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for a, _, data, offsets in T.chunks(batch.column(1)):
                node, part, held, wide = [], [], [], []
                for i, s in enumerate(sets(data, offsets, n)):
                    if _digest(s) != nodes[a + i]:
                        continue  # another text of the same doc_id
                    edge = np.searchsorted(s, np.arange(PARTS, dtype=np.uint64) << np.uint64(62)).tolist() + [len(s)]
                    for p in range(PARTS):
                        node.append(nodes[a + i])
                        part.append(p)
                        held.append(s[edge[p] : edge[p + 1]].tobytes())
                        wide.append(None if p else np.packbits((np.bincount(((s >> np.uint64(20)) & np.uint64(8 * WIDE - 1)).astype(np.int64), minlength=8 * WIDE) & 1).astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(part, pa.int32()), pa.array(held, pa.binary()), pa.array(wide, pa.binary())], names=["node", "part", "held", "wide"])
        release()

    return run


def _near(num: int, den: int):
    """Of pairs (x, y, size, common, wx, wy), those whose bitmaps differ in no more bits than linked sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, WIDE // 8) for i in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.filter(pa.array((den + num) * differ <= (den - num) * batch.column(2).to_numpy())).select([0, 1, 2, 3])
        release()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], names=["x", "y", "size", "shared"])
    release()


def _verified(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (x, y, size: of both together), those that link: overlaps counted per range of hashes, then summed."""
    ends = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    # few nodes are in a pair: the sets of the others are not shuffled
    held = held.join(F.broadcast(ends) if ends.count() <= MOST_IDS else ends, "node", "left_semi")
    left = pairs.select("x", "y", "size").join(held.select(F.col("node").alias("x"), "part", F.col("held").alias("hx")), "x")
    both = left.join(held.select(F.col("node").alias("y"), "part", F.col("held").alias("hy")), ["y", "part"])
    total = both.select("x", "y", "size", "hx", "hy").mapInArrow(_shared, "x binary, y binary, size long, shared long").groupBy("x", "y", "size").agg(F.sum("shared").alias("o"))
    return total.filter(F.expr(f"{den} * o >= {num} * (size - o)")).select("x", "y")


def _texts(source: DataFrame, prints: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, text): of each digest of nodes, the text of a row that has it (or of more rows)."""
    first = written(prints.join(nodes, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "first")
    texts = source.join(F.broadcast(first) if first.count() <= MOST_IDS else first, "doc_id").select(F.col("digest").alias("node"), "text")
    unknown = first.filter("doc_id IS NULL").select(F.col("digest").alias("node"))
    if unknown.isEmpty():
        return texts
    # no row of these has a doc_id: their texts are found by their digests
    nameless = source.filter("doc_id IS NULL").select("text", F.col("text").alias("node")).mapInArrow(_digests(n), "text string, node binary")
    return texts.union(nameless.join(unknown, "node").groupBy("node").agg(F.first("text").alias("text")))


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row of docs (doc_id, text, ...).

    Words are what stands between ASCII blanks, A-Z lower-cased; a set has the distinct n-word
    shingles, of a shorter text the whole sequence.  Sets link when
    ``den * |intersection| >= num * |union|``.  A null or empty text, or one of blanks only, has
    the size 0, no class and links with nothing.  Repeated rows are copies of each other.  A row
    without a doc_id takes part like any other; ids are the smallest that are known, and null
    where none is.  Texts of any length are read whole; an empty table gives none.  Columns besides
    doc_id and text, whatever their names, are not read.
    """
    return _labelled(docs, n, num, den).select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of docs (doc_id, text, ...), with all their columns, of which one of each component stays.

    That with the smallest doc_id stays, rows without one last, then that of the smallest digest;
    of rows alike in both, any one.  Rows without a word all stay.
    """
    alike = _labelled(docs, n, num, den).filter("digest IS NOT NULL").groupBy("doc_id", "digest", "root").agg(F.count("*").alias("rows"))
    alike = written(alike, "alike")
    # only components of more than one row need an entry: few, so no large one meets in one task
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("best")
    first = written(alike.groupBy("root").agg(best, F.sum("rows").alias("size")).filter("size > 1").select("root", "best"), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    groups = alike.join(F.broadcast(first) if first.count() <= MOST_IDS else first, "root")
    judged = written(groups.select("doc_id", "digest", stays.alias("stays"), "rows").filter("NOT stays OR rows > 1"), "judged")
    digest, stay, held_id, held_digest = free = ["digest", "stays", "held_id", "held_digest"]
    while {c.lower() for c in docs.columns} & set(free):
        digest, stay, held_id, held_digest = free = [c + "_" for c in free]
    on_workers(docs.sparkSession)
    known = docs.select("*", F.col("text").cast("string").alias(digest))
    tagged = known.mapInArrow(_digests(n), known.schema[:-1].add(digest, "binary"))
    side = judged.select(F.col("doc_id").alias(held_id), F.col("digest").alias(held_digest), F.col("stays").alias(stay))
    # few rows go or are repeated: the texts of the others are not shuffled
    joined = tagged.join(F.broadcast(side) if judged.count() <= MOST_IDS else side, F.col("doc_id").cast("long").eqNullSafe(F.col(held_id)) & (F.col(digest) == F.col(held_digest)), "left")
    out = joined.filter(F.col(stay).isNull()).select(*docs.columns)
    if judged.filter("stays").isEmpty():
        return out
    once = joined.filter(F.col(stay)).groupBy(held_id, held_digest).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(once.select("row.*"))


def _labelled(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, digest, root, class_id, component_id) of each row; the root is the digest of a set of the component."""
    spark = docs.sparkSession
    on_workers(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bytes_ = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // FRAGMENT))
    rated = source.mapInArrow(_dealt(n, fragments), _DEALT).groupBy("key").applyInArrow(_rated, _RATED)
    marked = written(rated.groupBy("batch").applyInArrow(_marked(num, den), _MARKED), "marked")
    prints = marked.filter("gram IS NULL").select("doc_id", "n_shingles", "digest")
    sets_of = prints.filter("digest IS NOT NULL")

    # sets that share one of their rarest n-grams, each with that whose n-grams recur most
    heads = marked.filter("gram IS NOT NULL").select("gram", "digest", F.col("n_shingles").alias("n"), "pos", "rate").distinct()
    top = F.max(F.struct("rate", "digest", "n", "pos")).alias("top")
    buckets = heads.groupBy("gram").agg(top, F.count("*").alias("sets")).filter("sets > 1")
    members = written(heads.drop("rate").join(buckets, "gram").select("gram", "digest", "n", "pos", F.col("top.digest").alias("pivot"), F.col("top.n").alias("top_n"), F.col("top.pos").alias("top_pos")), "members")
    held = written(_texts(source, sets_of, members.select("digest").distinct(), n).mapInArrow(_parts(n), "node binary, part int, held binary, wide binary").dropDuplicates(["node", "part"]), "parts")

    def fits(n1: str, p1: str, n2: str, p2: str) -> str:
        """Whether sets of these sizes whose first n-gram in common stands at these places may link."""
        return f"{den} * least({n1}, {n2}) >= {num} * greatest({n1}, {n2}) AND {den + num} * least({n1} - {p1}, {n2} - {p2}) >= {num} * ({n1} + {n2})"

    likely = members.filter("digest <> pivot AND " + fits("n", "pos", "top_n", "top_pos")).groupBy("digest", "pivot").agg(F.count("*").alias("common"), F.first(F.col("n") + F.col("top_n")).alias("size"))
    best = likely.groupBy("digest").agg(F.max(F.struct("common", "pivot", "size")).alias("best"))
    tried = written(best.select(F.least("digest", "best.pivot").alias("x"), F.greatest("digest", "best.pivot").alias("y"), "best.size").distinct(), "pairs")
    links = written(_verified(tried, held, num, den), "links")
    root = written(components(links, "x", "y"), "roots")

    # pairs in a bucket whose ends are not connected yet: one end at least is not connected with the bucket's pivot
    rooted = root.withColumnRenamed("node", "digest")
    known = members.join(rooted, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    known = written(known.join(rooted.toDF("pivot", "pivot_root"), "pivot", "left").select("gram", "digest", "n", "pos", "root", (F.col("root") != F.coalesce("pivot_root", "pivot")).alias("apart")), "known")
    x = known.filter("apart").select("gram", *(F.col(c).alias(f"x_{c}") for c in ("digest", "root", "n", "pos")))
    y = known.select("gram", *(F.col(c).alias(f"y_{c}") for c in ("digest", "root", "n", "pos", "apart")))
    unlike = "x_root <> y_root AND (x_digest < y_digest OR NOT y_apart) AND " + fits("x_n", "x_pos", "y_n", "y_pos")
    ends = [f("x_digest", "y_digest").alias(c) for f, c in ((F.least, "x"), (F.greatest, "y"))]
    counted = x.join(y, "gram").filter(unlike).select(*ends, (F.col("x_n") + F.col("y_n")).alias("size")).groupBy("x", "y", "size").agg(F.count("*").alias("common"))
    wide = held.filter("part = 0").select("node", "wide")
    either = counted.join(tried, ["x", "y"], "left_anti").join(wide.toDF("x", "wx"), "x").join(wide.toDF("y", "wy"), "y")
    rest = written(either.select("x", "y", "size", "common", "wx", "wy").mapInArrow(_near(num, den), "x binary, y binary, size long, common long"), "open")
    # each component's likeliest pairs first, as they leave few others open; then all that are
    for most in (4, None):
        ends = root.select("node", "root")
        live = rest.join(ends.toDF("x", "rx"), "x", "left").join(ends.toDF("y", "ry"), "y", "left").select("x", "y", "size", "common", F.coalesce("rx", "x").alias("rx"), F.coalesce("ry", "y").alias("ry")).filter("rx <> ry")
        live = written(live, "live")
        if live.isEmpty():
            break
        picked = live.select("x", "y", "size")
        if most:
            either = live.select(F.col("rx").alias("root"), "x", "y", "size", "common").union(live.select("ry", "x", "y", "size", "common"))
            by = Window.partitionBy("root").orderBy(F.desc("common"), "x", "y")
            picked = written(either.withColumn("rank", F.row_number().over(by)).filter(f"rank <= {most}").select("x", "y", "size").distinct(), "pairs")
            rest = live.join(picked, ["x", "y"], "left_anti").select("x", "y", "size", "common")
        links = written(links.union(_verified(picked, held, num, den)), "links")
        root = written(components(links, "x", "y"), "roots")
    for table in (members, known, held):
        remove(table)

    # every node's smallest document, every component's smallest node
    classes = sets_of.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    rooted = classes.join(root.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    lowest = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    labels = rooted.join(lowest, "root").select("digest", "root", "class_id", "component_id")
    return prints.join(labels, "digest", "left")
