"""Language identification by prediction by partial matching (PPM).

For each language a context tree over folded bytes counts which symbol follows which context of
0 to ORDER symbols.  A symbol's probability in its longest context is escape method C: a symbol
seen d different ways in n is n_s / (n + d); the rest, d / (n + d), goes to the next shorter
context, where the symbols seen are excluded.  The counts are frozen, so each code length follows from
tables, and a text's code length in a language is the exact sum of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .store import on_workers, release, written

#: Longest context, and symbols: whole bytes, folded.
ORDER, SYMBOLS = 3, 256
#: Expected number of training documents of a language that are read, chosen by a hash of their id.
MAX_TRAINING_DOCS = 4000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def folded() -> np.ndarray:
    """Bytes without case, digits without value, ASCII punctuation and blanks without kind."""
    out = T.LOWER.copy()
    out[48:58] = ord("0")
    out[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = ord(".")
    out[:33] = out[127] = 32
    return out


class _Places:
    """Where a number stands among distinct numbers, by open addressing."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.bits = numbers, max(4, (4 * len(numbers)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(numbers), dtype=np.int32), self._first(numbers)
        while len(left):
            put = left[self.slots[at[left]] < 0]
            self.slots[at[put]] = put
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _first(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        if not len(self.numbers):
            return np.full(len(asked), -1, np.int32)
        at = self._first(asked)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.numbers[out] != asked))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.numbers[out[wrong]] != asked[wrong])]
        return out


class ContextTrees:
    """Code lengths in bits, by language, of symbols after ORDER symbols.

    Of each order only the grams and contexts that a language has are held.  A gram that none has
    costs the escape from its context, if that is held, and its length one order below.
    """

    def __init__(self, langs: list[str], symbol: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.symbol = langs, symbol
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            own = []
            for key, n in counts:
                gram, at = np.unique(np.asarray(key, np.int64) % SYMBOLS ** (order + 1), return_inverse=True)
                own.append((gram, np.bincount(at, np.asarray(n, np.float64), len(gram))))
            gram = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in own)]))
            context = np.unique(gram // SYMBOLS)
            below = self.cost(gram % SYMBOLS**order, order - 1)
            cost, escape = np.empty((len(gram), len(langs))), np.zeros((len(context), len(langs)))
            for i, (seen, n) in enumerate(own):
                at, here = np.searchsorted(gram, seen), np.searchsorted(context, seen // SYMBOLS)
                total, kinds = np.bincount(here, n, len(context)), np.bincount(here, minlength=len(context))
                rest = 1 - np.bincount(here, np.exp2(-below[at, i]), len(context))
                # where every symbol was seen there is nothing to escape to
                open_ = (kinds > 0) & (kinds < SYMBOLS)
                escape[open_, i] = np.log2(np.maximum(rest[open_], 1e-30) * (total + kinds)[open_] / kinds[open_])
                cost[:, i] = below[:, i] + escape[np.searchsorted(context, gram // SYMBOLS), i]
                cost[at, i] = -np.log2(n / (total + np.where(open_, kinds, 0))[here])
            self.grams.append(_Places(gram))
            self.costs.append(cost)
            self.contexts.append(_Places(context))
            self.escapes.append(escape)

    def cost(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits, in each language, of the last symbol of each gram after the ``order`` symbols before it."""
        if order < 0:
            return np.full((len(gram), len(self.langs)), np.log2(SYMBOLS))
        at = self.grams[order].of(gram)
        new = np.flatnonzero(at < 0)
        out = self.costs[order][at] if len(self.costs[order]) else np.empty((len(gram), len(self.langs)))
        if len(new):
            out[new] = self.cost(gram[new] % SYMBOLS**order, order - 1)
            context = self.contexts[order].of(gram[new] // SYMBOLS)
            out[new[context >= 0]] += self.escapes[order][context[context >= 0]]
        return out

    @property
    def bits(self) -> np.ndarray:
        """The code lengths of every symbol after each context of ORDER symbols that is held."""
        return self.cost((self.contexts[ORDER].numbers[:, None] * SYMBOLS + np.arange(SYMBOLS)).ravel())

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row in each language; a row begins after blanks."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if len(data):
            cost = self.cost(keys(self.symbol, data, offsets))
            full = np.flatnonzero(np.diff(offsets))
            out[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        return out


def keys(symbol: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each byte with the ORDER bytes before it."""
    s = symbol[data].astype(np.int64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    blank, out = int(symbol[32]), s.copy()
    for back in range(1, ORDER + 1):
        before = np.full(len(s), blank, np.int64)
        before[back:] = s[:-back]
        for k in range(back):
            at = starts + k
            before[at[at < len(s)]] = blank
        out += before * SYMBOLS**back
    return out


def _gram_counts(symbol: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                rows = batch.column(0).filter(pa.array(langs == lang))
                for _, _, data, offsets in T.chunks(rows, 8 << 20):
                    key, n = np.unique(keys(symbol, data, offsets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "key", "n"])
        release()

    return run


def train(docs: DataFrame, learn: Column, max_docs: int = MAX_TRAINING_DOCS) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Languages, symbols and counts, from rows of docs (text, lang, doc_id) where ``learn`` holds and lang isn't null.

    Of each language a share of the rows is read so that about ``max_docs`` are; what reaches the
    driver is a count for each distinct run of ORDER + 1 bytes in them.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return [], np.zeros(256, np.uint8), []
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, max_docs / n))) for k, n in sorted(per_lang.items())))
    some = written(known.filter((F.pmod(F.xxhash64(F.lit(20240501), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))).select("text", "lang"), "lang-sample")
    symbol = folded()
    found = some.mapInArrow(_gram_counts(symbol), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(per_lang)
    return langs, symbol, [(g["key"].to_numpy(), g["n"].to_numpy()) for g in (found[found["lang"] == k] for k in langs)]


_trees: dict[str, ContextTrees] = {}


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, *parts = model.value
        if key not in _trees:  # a worker serves many tasks
            _trees.clear()
            _trees[key] = ContextTrees(*parts)
        trees = _trees[key]
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1), 1 << 20):
                bits = trees.lengths(data, offsets)
                has = np.concatenate(([0], np.cumsum(_LETTER[data])))
                letter = has[offsets[1:]] > has[offsets[:-1]]
                for i in np.flatnonzero(~letter & (np.diff(offsets) > 0)):
                    letter[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                if trees.langs:
                    best = bits.argmin(axis=1)
                    score = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                    lang = np.where(letter, np.array(trees.langs, object)[best], "und")
                else:
                    score, lang = np.zeros(len(bits)), np.full(len(bits), "und", object)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(np.where(lang == "und", 0.0, score))], names=["doc_id", "lang_pred", "score"])
        release()

    return run


def identify(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text, ...).

    The language whose trees give the whole text the shortest code; ties go to the first by
    name.  The score is its share of the probability that all languages give the text.  Null
    texts and texts without a letter are ``und`` with the score 0, as is all without a model.
    Repeated rows are predicted each, texts of any length whole; an empty table gives none, and
    columns besides doc_id and text are not read.  A worker holds 8 bytes a language for each run
    of up to ORDER + 1 bytes in the sample: about 60 MB for 200 languages and 40,000 runs.
    """
    on_workers(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(held), "doc_id long, lang_pred string, score double")
