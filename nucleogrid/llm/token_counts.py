"""Exact token counts of every prefix of a text, by dynamic programming.

Byte-pair encodings have this property: the encoding of a piece is the only sequence of tokens
in which each neighbouring pair encodes to itself.  So the last token of a prefix's encoding is
the one that fits behind the last token of the prefix before it, and

    count(k) = count(k - length(last(k))) + 1.

The tokenizer splits a text into pieces before it merges; a prefix cuts one piece at most, so a
prefix's count is that of the pieces before plus that of the piece's own prefix.  Counts are
kept as one signed byte of difference per byte of text: a text's table is as long as the text,
and truncation and budget questions are sums of it.  Tables of short stretches between blanks
are remembered, as texts repeat them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import on_workers, release

#: Entries of a worker's caches; beyond, a cache starts anew.
CACHE = 1_500_000
#: Where a token always ends, whatever comes before or after: before a lone blank between other
#: characters, after it if it is a line's end, and between an ASCII letter and ASCII punctuation.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])")

#: A stretch that is one piece for sure: letters of a Latin script, with a blank before them at most.
_PLAIN = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")

#: Stands where a text is cut; a text that has it itself is cut another way.
MARK = "\x01"

#: Two kinds of white space side by side: there a blank isn't a cut.
_WIDE = re.compile(r"\s\s")

#: One blank or more, as the tokenizer's pattern has them.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class PrefixCounter:
    """Prefix tables of a byte-level BPE tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=lambda t: (-len(t), t)))) + ")") if added else None
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(letters) if chr(b) != c})
        self.blanks = {letters[b] for b in (9, 10, 11, 12, 13, 32)}
        model = self.tokenizer.model
        self.encode = lambda s: [t.value for t in model.tokenize(s)]
        self.vocabulary = {t for t in self.tokenizer.get_vocab(with_added_tokens=False)}
        self.longest = max(map(len, self.vocabulary))
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.stretches: dict[str, bytes] = {"": b""}

    def piece(self, p: str) -> list[int]:
        """Token counts of the first 1, 2, ... bytes of a piece, one letter for each byte."""
        known = self.pieces.get(p)
        if known is not None:
            return known
        count = self.count(p)
        if len(p) <= 64:
            self.pieces[p] = count
        return count

    def count(self, p: str) -> list[int]:
        return next(self.counts([p]))[1:]

    def counts(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        """Token counts of the first 0, 1, 2, ... bytes of each piece; what a piece shares with the one before is not computed again."""
        last, count, before = [""], [0], ""
        vocabulary, whole, fits, longest = self.vocabulary, self.whole, self.fits, self.longest
        for p in pieces:
            n, same = len(p), 0
            for x, y in zip(p, before, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for k in range(same + 1, n + 1):
                for a in range(k - longest if k > longest else 0, k):
                    t = p[a:k]
                    if t not in vocabulary:
                        continue
                    if a:
                        pair = (last[a], t)
                        ok = fits.get(pair)
                        if ok is None:
                            ok = fits[pair] = self.encode(pair[0] + t) == [pair[0], t]
                    else:
                        ok = whole.get(t)
                        if ok is None:
                            ok = whole[t] = self.encode(t) == [t]
                    if ok:
                        last.append(t)
                        count.append(count[a] + 1)
                        break
            before = p
            yield count

    def ordinary(self, text: str) -> list[int]:
        """Counts of each prefix of a text without special strings, byte by byte."""
        out: list[int] = []
        before, base, run = 0, 0, ""
        for p, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            own = self.piece(p)
            if p in ("'re", "'ve", "'ll"):  # two letters in, it is an apostrophe and a letter
                own = [own[0], self.piece("'")[0] + self.piece(p[1])[0], own[2]]
            out += [before + c for c in own]
            if run and _BLANK.match(text[a]):
                # up to its first character, the blanks before are not cut off from this one yet
                n = len(text[a].encode())
                out[-len(own) : len(out) - len(own) + n] = [base + c for c in self.piece(run + p[:n])[len(run) :]]
            run = p if _BLANK.fullmatch(text[a:b]) else ""
            base, before = before, before + own[-1]
        return out

    def stretch(self, text: str) -> bytes:
        """Differences of the counts of a stretch of text without special strings."""
        if _PLAIN.fullmatch(text):
            counts = self.count(text.encode().decode("latin-1").translate(self.letters))
        else:
            counts = self.ordinary(text)
        return differences([0, *counts])

    def easy(self, text: str | None) -> bool:
        """Whether all blanks of a text are lone, so that it can be cut at fixed characters."""
        return bool(text) and not (self.special and self.special.search(text) or _WIDE.search(text) or MARK in text or text[0].isspace() or text[-1].isspace())

    def learn(self, stretches: Iterable[str]) -> None:
        """Tables of stretches.  New words are taken in order, so that each shares the work on its first letters with the next."""
        for held, most in ((self.stretches, CACHE), (self.pieces, CACHE // 4), (self.fits, CACHE // 2)):
            if len(held) > most:
                held.clear()
        self.stretches[""] = b""
        known, plain = self.stretches, {}
        for p in stretches:
            if p not in known:
                if _PLAIN.fullmatch(p):
                    plain[p if p.isascii() and p[0] != " " else p.encode().decode("latin-1").translate(self.letters)] = p
                else:
                    known[p] = self.stretch(p)
        order = sorted(plain)
        for p, count in zip(order, self.counts(order), strict=True):
            known[plain[p]] = differences(count)

    def totals(self, texts: pa.Array) -> np.ndarray:
        """The last entry of each text's table: those of its stretches added up, each distinct one looked up once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        easy = np.array([self.easy(t) for t in texts.to_pylist()], bool)
        cut = pc.replace_substring(texts.filter(pa.array(easy)), " ", MARK + " ")
        cut = pc.replace_substring(cut, "\n", MARK + "\n" + MARK)
        cut = pc.replace_substring_regex(cut, r"([A-Za-z])([!-/:-@\[-`{-~])", rf"\1{MARK}\2")
        parts = pc.split_pattern(cut, MARK)
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        through = np.concatenate(([0], np.cumsum(_sums([self.stretches[p] for p in distinct])[coded.indices.to_numpy()])))
        out = np.zeros(len(texts), np.int64)
        out[easy] = np.diff(through[parts.offsets.to_numpy()])
        out[~easy] = _sums(self.tables(texts.filter(pa.array(~easy)).to_pylist()))
        return out

    def tables(self, texts: list[str | None]) -> list[bytes]:
        """The tables of many texts."""
        split = [_CUT.split(t) if t and not (self.special and self.special.search(t)) else None for t in texts]
        self.learn({p for parts in split if parts for p in parts})
        return [b"".join([self.stretches[p] for p in parts]) if parts else self.table(t) for t, parts in zip(texts, split, strict=True)]

    def any(self, text: str) -> bytes:
        """The table of a text without special strings."""
        parts = _CUT.split(text)
        for p in parts:
            if p not in self.stretches:
                self.stretches[p] = self.stretch(p)
        return b"".join([self.stretches[p] for p in parts])

    def table(self, text: str | None) -> bytes:
        """One signed byte for each byte of a text: by how much it changes the count."""
        if not text:
            return b""
        if self.special and self.special.search(text):
            out, tail = b"", ""
            for part in self.special.split(text):
                if self.special.fullmatch(part):
                    # not special before it is whole: until then it may go on from what stands before
                    counts = [0, *self.ordinary(tail + part)][len(tail.encode()) : -1]
                    out += differences([*counts, counts[0] + 1])
                    tail = ""
                elif part:
                    out += self.table(part)
                    tail = _CUT.split(part)[-1]
            return out
        return self.any(text)


def differences(counts: list[int]) -> bytes:
    return bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])


def _sums(tables: list[bytes]) -> np.ndarray:
    """The last entry of each table."""
    ends = np.concatenate(([0], np.cumsum([len(t) for t in tables], dtype=np.int64)))
    through = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(tables), np.int8), dtype=np.int64)))
    return through[ends[1:]] - through[ends[:-1]]


def prefix_counts(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... bytes; exact where a character ends."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)))


def longest_prefix(table: bytes, text: str, budget: int) -> int:
    """Bytes of the longest prefix of whole characters with ``budget`` tokens at most."""
    ends = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text], dtype=np.int64)))
    fits = np.flatnonzero(prefix_counts(table)[ends] <= budget)
    return int(ends[fits[-1]])


_counters: dict[str, PrefixCounter] = {}


def _tables(tokenizer: str, limit: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:  # a worker serves many tasks
            _counters[tokenizer] = PrefixCounter(tokenizer)
        counter = _counters[tokenizer]
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tables = counter.tables(texts.to_pylist()) if keep else []
            n = _sums(tables) if keep else counter.totals(texts)
            out = [batch.column(0), size, pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(tables, pa.binary())] * keep, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_table"][: 4 + keep])
        release()

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, tables: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text, ...), and its ``prefix_table`` if asked for.

    The last entry of the prefix table is the count of the whole text: what the library gives
    without added special tokens.  Null and empty texts have none.  Repeated rows are counted each,
    texts of any length whole; an empty table gives none.  Other columns, whatever their names, are
    not read.
    """
    on_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tables(tokenizer, limit, tables), "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_table binary" * tables)
