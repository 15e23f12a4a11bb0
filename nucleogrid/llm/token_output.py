"""Token ids in Arrow IPC files: fixed-size-list batches of equal-length sequences and masks.

Documents stand in ascending doc_id order, each ended by an id of its own, packed one after the
other into rows of ``length`` ids.  Every batch of a file but the last has as many rows, and the
id and mask columns are plain fixed-size lists, so row ``i`` is found by arithmetic and read
from the mapped file without a copy.  A file's last row is padded and its mask says where.

Beside each file of sequences lies one with an index (doc_id, start in the file, n_tokens).
Files get a fresh name per attempt; the manifest, written last, names those that count.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from .store import new_path, on_workers, release, written

#: Words kept with their ids in a worker; beyond, the cache starts anew.
CACHE_WORDS = 600_000
#: Rows of a batch in a file.
BATCH_ROWS = 64


#: A blank put between an ASCII letter and ASCII that is no letter, apostrophe, bracket or bar parts what the tokenizer parts anyway.
_BARE = r"([A-Za-z])([!-&(-;=?@\[-`{}~])"

#: Texts on which a tokenizer must give the ids of its words, else it is given whole texts.
_PROBES = ("Hello, World! (a)b... x1y2", "don't it's 'tis O'Neil's", "\u00c9T\u00c9 na\u00efve Ab.Cd, \u65e5\u672c abc\u65e5.", "<|endoftext|> a|b <c> <UNK> [UNK] [MASK]x", "A-b_c d/e\n\nf\tg  h", "no.9 v2.0 3rd A1 10,000.50%", "ab\u00e9.cd \u0130x. \u00df,")

_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    """Encodes whole texts, remembering each word's ids.

    For a tokenizer that drops white space, lower-cases ASCII and parts letters from punctuation, a
    text's ids are those of its words.  Whether it is one is tried when it is loaded; any other
    one, and added tokens that a cut would change, have whole texts encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probes = [*_PROBES, *(f"x {t} y{t}z" for t in added)]
        split = [self.cut(pa.array([p], pa.large_string()))[0].as_py() for p in probes]
        self.by_word = all([t] == self.cut(pa.array([t], pa.large_string()))[0].as_py() for t in added) and all(b"".join(self.ids(w)) == self.ids([p])[0] for w, p in zip(split, probes, strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.type.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def cut(texts: pa.Array) -> pa.Array:
        """The words of each text, ASCII lower-cased."""
        return pc.ascii_split_whitespace(pc.ascii_lower(pc.replace_substring_regex(texts, _BARE, r"\1 \2")))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and each ended by ``end_id``, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.by_word:
            parts = self.cut(texts)
            offsets, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        else:
            offsets, coded = np.arange(len(texts) + 1), texts.dictionary_encode()
        if len(self.known) > CACHE_WORDS or not self.by_word:
            self.known = {}
        known, words = self.known, coded.dictionary.to_pylist()
        ask = [w for w in words if w not in known]
        for at in range(0, len(ask), 20_000):
            some = ask[at : at + 20_000]
            known.update(zip(some, self.ids(some), strict=True))
        # each word once, then copied to all its places
        own = [known[w] for w in words]
        pool = np.frombuffer(b"".join(own), self.type)
        size = np.fromiter(map(len, own), np.int64, len(own)) // self.type.itemsize
        begin = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        through = np.concatenate(([0], np.cumsum(size[at])))
        ids = pool[np.repeat(begin[at] - through[:-1], size[at]) + np.arange(through[-1])]
        ends = through[offsets]
        return np.insert(ids, ends[1:], end_id), np.diff(ends) + 1


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class SequenceWriter:
    """One file of sequences and its index."""

    def __init__(self, path: str, length: int, kind: np.dtype):
        fs, at = filesystem(path)
        fs.create_dir(os.path.dirname(at), recursive=True)
        self.length, self.kind = length, kind
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("input_ids", pa.list_(value, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.files = [fs.open_output_stream(at), fs.open_output_stream(at + ".index")]
        self.ids = pa.ipc.new_file(self.files[0], self.schema)
        self.index = pa.ipc.new_file(self.files[1], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.held, self.size, self.total = [], 0, 0

    def add(self, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([docs, pa.array(starts), pa.array(counts)], schema=self.index_schema()))
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.length * BATCH_ROWS:
            self.flush(self.length * BATCH_ROWS)

    @staticmethod
    def index_schema() -> pa.Schema:
        return pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def flush(self, step: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        whole = len(flat) // step * step
        for a in range(0, whole, step):
            self.batch(flat[a : a + step], step)
        self.held, self.size = [flat[whole:].copy()], len(flat) - whole

    def batch(self, flat: np.ndarray, used: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, np.arange(len(flat)) < used)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self.flush(self.length * BATCH_ROWS)
        if self.size:
            rest = self.held[0]
            self.batch(np.concatenate((rest, np.zeros(-len(rest) % self.length, self.kind))), len(rest))
        for f in (self.ids, self.index, *self.files):
            f.close()


class SequenceReader:
    """Random access to a file of sequences; a local file is mapped, and its rows are views of the map."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.ids = pa.ipc.open_file(pa.memory_map(at) if local else fs.open_input_file(at))
        self.index = pa.ipc.open_file(pa.memory_map(at + ".index") if local else fs.open_input_file(at + ".index"))
        self.length = self.ids.schema.field("input_ids").type.list_size
        self.last = (-1, np.zeros(0, np.uint16))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence."""
        batch = self.ids.get_batch(i // BATCH_ROWS)
        r = i % BATCH_ROWS
        return batch.column(0).slice(r, 1).flatten().to_numpy(), batch.column(1).slice(r, 1).flatten().to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file; a view if one batch holds them."""
        step, out = self.length * BATCH_ROWS, []
        while n > 0:
            if self.last[0] != start // step:
                self.last = start // step, self.ids.get_batch(start // step).column(0).flatten().to_numpy()
            flat = self.last[1]
            out.append(flat[start % step : start % step + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def _writer(folder: str, tokenizer: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = encoder_of(tokenizer), None
        part, docs = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2500):
                rows = batch.slice(a, 2500)
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
                    writer = SequenceWriter(name, length, encoder.type)
                writer.add(rows.column(0), *encoder.encode(rows.column(1), end_id))
                docs += rows.num_rows
        release()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "file": [name], "docs": pa.array([docs]), "tokens": pa.array([writer.total])})

    return run


def write_sequences(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Writes the texts of docs (doc_id, text, ...) as token sequences; (part, file, docs, tokens, base) of each file.

    ``base`` is the number of ids in the files before it.  A null text is empty and has its end
    id alone; a null doc_id comes first; rows of the same doc_id stand by their text.  An empty
    table has no file.  Texts of any length are encoded whole.  Other columns, whatever their names,
    are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    folder = new_path(spark, "sequences")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(dealt.mapInArrow(_writer(folder, tokenizer, length, end_id), "part long, file string, docs long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = SequenceReader(file)
            for i in range(reader.index.num_record_batches):
                index = reader.index.get_batch(i)
                start, n = index.column(1).to_numpy(), index.column(2).to_numpy()
                sums = [zlib.crc32(reader.tokens(int(s), int(k)).astype("<u4").tobytes()) for s, k in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([index.column(0), pa.array(start + base), index.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of ``write_sequences``."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "base").repartition(n, "file").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
