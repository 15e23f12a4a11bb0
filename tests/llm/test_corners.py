"""Operators against plain Python on whole small tables, and their corners."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nucleogrid.llm import decontaminate, langid, licenses, mixing, near_dup_vectors, ngram_join, quality, queries, text as T, token_counts, token_output

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "re", "tu", "sha", "ven") for b in ("n", "ra", "st", "bo", "li", "dor", "x", "pe")]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in texts], DOC)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(name))


def test_counts_of_all_documents_equal_the_library(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()}
    got = queries.op5_token_counts(spark, folder).collect()
    want = dict(zip(texts, (len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.n_bytes) == (want[r.doc_id], len(texts[r.doc_id].encode())) for r in got)


def test_marks_and_wide_blanks_in_texts_are_counted(spark):
    texts = ["a\x01b c", "a  b", " a", "a\n\nb", "a\nb.c", "é.é ß,", "x<|endoftext|>y z", "a \n b", " a b", "a\x00b"]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, [*enumerate(texts), (90, None), (91, "")]), queries.tokenizer_path("byte_bpe_50k.json")).collect()}
    lib = library("byte_bpe_50k.json")
    assert got == {**{i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}, 90: 0, 91: 0}


def test_ids_of_all_documents_equal_the_library(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in queries.table(spark, folder, "documents").collect())
    got = {r.doc_id: r for r in queries.op1_token_output(spark, folder).collect()}
    start, lib = 0, library("word_bpe_49k.json")
    for i, t in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_a_tokenizer_that_keeps_blanks_has_whole_texts():
    encoder, lib = token_output.WordEncoder(queries.tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    texts = ["a b  c", "", "Hello, World. x"]
    ids, n = encoder.encode(pa.array(texts), 7)
    assert not encoder.by_word
    assert ids.tolist() == [x for t in texts for x in [*lib.encode(t, add_special_tokens=False).ids, 7]] and n.sum() == len(ids)


def plain_tilings(docs, items, seed, share):
    out = []
    of = lambda t: T.word_hashes(T.LOWER[d := np.frombuffer((t or "").encode(), np.uint8)], *T.words(T.LOWER[d], np.array([0, len(d)]), T.ALNUM_WORDS)[:2]).tolist() if t else []
    for i, t in docs:
        for k, b in items:
            pattern, words = of(b), of(t)
            known = {w: n for n, w in enumerate(dict.fromkeys(pattern))}
            if pattern and words:
                found = decontaminate.tiles([known[w] for w in pattern], [known.get(w, -1) for w in words], min(seed, len(pattern)))
                if found and sum(x[2] for x in found) >= share * len(pattern):
                    out.append((i, k, len(found), sum(x[2] for x in found), len(pattern), max(x[2] for x in found)))
    return sorted(out, key=str)


def test_seed_join_and_tilings_match_plain_tiling(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice(WORDS[:30]) for _ in range(rng.randint(1, 40)))) for k in range(25)] + [(3, "ka lo"), (None, "mi re tu sha ven x"), (50, None), (51, ""), (52, "...")]
    texts = [None, "", "?!", "long " * 30_000]
    for _ in range(60):
        words = " ".join(rng.choice([b for _, b in items if b]) for _ in range(2)).split()
        cut = rng.randrange(len(words))
        texts.append(" ".join(words[cut:] + [rng.choice(WORDS)] * rng.randint(0, 3) + words[:cut]))
    docs = [*enumerate(texts), (None, texts[10]), (5, texts[5]), (5, texts[6])]
    d = documents(spark, docs).withColumn("item_id", F.lit(1)).withColumn("sha", F.lit(1)).withColumn("bad_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_tiles, r.covered_words, r.item_words, r.longest_tile) for r in decontaminate.contamination(d, bench).collect()), key=str)
    want = plain_tilings(docs, items, 5, 0.6)
    assert len(want) > 20 and got == want
    clean = decontaminate.decontaminated(d, bench)
    bad = {(i, t) for i, t in docs if plain_tilings([(i, t)], items, 5, 0.6)}
    assert clean.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in docs if x not in bad)
    assert decontaminate.contamination(d, bench.limit(0)).count() == decontaminate.contamination(d.limit(0), bench).count() == 0
    assert decontaminate.decontaminated(d, bench.limit(0)).count() == len(docs)


def test_code_lengths_match_plain_ppm():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))).encode() for _ in range(12)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    symbol = np.arange(256, dtype=np.uint8)
    key, n = np.unique(langid.keys(symbol, data, offsets), return_counts=True)
    seen = defaultdict(Counter)
    for t in texts:
        padded = b" " * langid.ORDER + t
        for i in range(len(t)):
            for k in range(langid.ORDER + 1):
                at = i + langid.ORDER
                seen[padded[at - k : at]][padded[at]] += 1

    def share(context, s):
        below = (lambda x: share(context[1:], x)) if context else (lambda x: 1 / langid.SYMBOLS)
        own = seen.get(context)
        if not own:
            return below(s)
        total = sum(own.values()) + len(own)
        return own[s] / total if s in own else len(own) / total * below(s) / (1 - sum(map(below, own)))

    trees = langid.ContextTrees(["a"], symbol, [(key, n)])
    new = [b"abcab", b"zza b", b"c", b"aa aa bb\xff"]
    flat, ends = np.frombuffer(b"".join(new), np.uint8), np.cumsum([0, *map(len, new)])
    want = [-sum(np.log2(share((b" " * langid.ORDER + t)[i : i + langid.ORDER], t[i])) for i in range(len(t))) for t in new]
    assert trees.lengths(flat, ends)[:, 0] == pytest.approx(want, rel=1e-9)


def test_votes_match_a_plain_loop():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) + rng.choice(["", "!!", ".", "\n#"]) for _ in range(90)]
    data = "".join(texts).encode()
    x = quality.terms(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    labels = np.array([rng.randrange(2) for _ in range(60)], float)
    model = quality.fit(x[:60], labels)
    got, z = model.scores(x[60:]), model.project(x[60:]).astype(np.float64)
    for i, own in enumerate(z):
        cosine = sorted(((float(np.float32(own.astype(np.float32) @ v)), y) for v, y in zip(model.vectors, labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(c, y) for c, y in cosine if c > 0]
        assert got[i] == pytest.approx(sum(c * y for c, y in votes) / sum(c for c, _ in votes), abs=1e-3)


def test_empty_tables_give_empty_results(spark):
    none = documents(spark, []).withColumn("root", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    tok = queries.tokenizer_path("byte_bpe_50k.json")
    assert token_counts.token_counts(none, tok).count() == 0
    assert langid.identify(none, langid.train(none, F.lit(True))).count() == 0
    assert mixing.mixed(none).count() == mixing.sample(none).count() == 0
    assert quality.score(none, quality.train(none, labels, F.lit(True))).count() == 0
    assert licenses.scan(none).count() == 0
    assert ngram_join.deduplicated(none).count() == 0
    assert near_dup_vectors.vector_components(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_many_copies_of_one_row_and_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60_000))
    rows = [(i, "one and the same text of ten words or so here") for i in range(300)] + [(900, long), (901, long + " end"), (902, None)]
    d = documents(spark, rows).withColumn("digest", F.lit("mine")).withColumn("gram", F.lit(1))
    got = Counter(r.component_id for r in ngram_join.jaccard_components(d, 4, 85, 100).collect())
    assert got == {0: 300, 900: 2, 902: 1}
    assert sorted(r.doc_id for r in ngram_join.deduplicated(d, 5, 80, 100).collect()) == [0, 900, 902]


def test_pipeline_drops_what_was_planted(spark, tmp_path):
    rng = random.Random(6)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice("aeiou") for _ in range(n)).capitalize() + ". "
    good = [sentence(12) + sentence(9) + sentence(14) for _ in range(120)]
    junk = ["$$$ WIN!!! #### " * 12 for _ in range(1)] + [("BUY " + "!" * k + " ") * 25 for k in range(2, 40)]
    item = " ".join(rng.choice(WORDS) + "q" for _ in range(30))
    rows = [*enumerate(good), *((200 + i, t) for i, t in enumerate(junk)), (300, good[7]), (301, good[8] + "x"), (302, good[9] + item), (7, good[7])]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert not kept & {300, 301, 302, *range(200, 200 + len(junk))}
    assert len(kept) >= 90 and max(Counter(r.doc_id for r in got).values()) <= 2
    lib = library("word_bpe_49k.json")
    for r in got:
        ids = [*lib.encode(good[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
