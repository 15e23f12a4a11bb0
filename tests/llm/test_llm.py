"""Small tables against brute force, exact round trips and held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nucleogrid.llm import components, decontaminate, langid, licenses, mixing, near_dup_vectors, ngram_join, quality, queries, token_counts, token_output, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "re", "tu", "sha", "ven") for b in ("n", "ra", "st", "bo", "li", "dor", "x", "pe")]


def docs(spark, texts, **more):
    """Documents with a clashing extra column."""
    rows = [(i, t, None, "src1", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit("mine")).withColumn("root", F.lit(1))


def union_find(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def changed(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = rng.choice(WORDS)
    return " ".join(out)


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(4)
    out = [None, "", "  \n", "One", "one", "a b c", "A b  c", "a b d"]
    for size in (9, 30, 80, 300):
        base = [rng.choice(WORDS) for _ in range(size)]
        for k in (0, 0, 1, 1, 2, 3, 4, 6, 8):
            out.append(changed(rng, base, min(k, size // 4)))
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    out += [passage + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 90))) for _ in range(25)]
    return out + [" ".join(rng.choice(WORDS) for _ in range(20_000))]


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_jaccard_components_are_exact(spark, near_copies, n, num):
    sets = [shingles(t, n) for t in near_copies]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = union_find(len(sets), links)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs(spark, near_copies), n, num, 100).collect()}
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(sets))] == want


def test_texts_of_one_doc_id_are_told_apart(spark):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(i) for i in range(200)]
    near = " ".join([*base[:-1], "other"])
    rows = [(1, " ".join(base)), (1, "an unlike text that stands under the same id"), (2, near), (2, near), (3, "an unlike text that stands alone")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == {(1, 197, 1), (1, 6, 1), (2, 197, 1), (3, 3, 3)}


def test_jaccard_of_an_empty_table(spark):
    assert ngram_join.jaccard_components(docs(spark, []), 4, 85, 100).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = union_find(60, links)
    assert got == {i: want[i] for i in {x for e in links if e[0] != e[1] for x in e}}


def test_token_files_hold_what_the_library_gives(spark):
    texts = [None, "", "Hello, world!", "the CAT's 12 mats\n\nnaïve ÉTÉ 日本 <|endoftext|> x", "w " * 5000, "Hello, world!"]
    tok = queries.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(tok), 0
    files = token_output.write_sequences(docs(spark, texts), tok, length=128)
    got = {r.doc_id: r for r in token_output.read_digests(files).collect()}
    stream = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    seen = []
    for f in sorted(files.collect(), key=lambda r: r.base):
        reader = token_output.SequenceReader(f.file)
        for i in range(-(-f.tokens // 128)):
            ids, mask = reader.row(i)
            assert len(ids) == len(mask) == 128
            seen += ids[mask].tolist()
    assert seen == stream
    assert token_output.write_sequences(docs(spark, []), tok).count() == 0


def test_tiles_are_long_first_and_do_not_overlap():
    pattern, text = list(range(10)), [5, 6, 7, 8, 9, -1, 0, 1, 2, 3, 4, -1, 3, 4, 5]
    assert decontaminate.tiles(pattern, text, 3) == [(0, 6, 5), (5, 0, 5)]


def test_reordered_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(7)
    items = [" ".join(rng.choice(WORDS) + str(i) for _ in range(30)) for i in range(3)] + ["too short", None, ""]
    words = items[0].split()
    texts = [items[1], "x y " + " ".join(words[15:] + ["and"] + words[:15]).upper() + " z", " ".join(words[:12]), "say it is too SHORT, yes", None, "", "short too"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert got == {(0, 1): 1.0, (1, 0): 1.0, (3, 3): 1.0}
    kept = decontaminate.decontaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]


def test_code_lengths_sum_to_one_in_every_context():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, langid.SYMBOLS ** (langid.ORDER + 1), 4000)
    key, n = np.unique(keys, return_counts=True)
    trees = langid.ContextTrees(["a"], np.zeros(256, np.uint8), [(key, n)])
    assert np.exp2(-trees.bits.reshape(-1, langid.SYMBOLS)).sum(axis=1) == pytest.approx(1, abs=1e-3)


def test_language_is_told_on_texts_not_learned_from(spark):
    vocab = {"aa": ["the", "and", "with", "this", "that"], "bb": ["der", "und", "mit", "dies", "dass"]}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(12)), k, "s", 0) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa", "s", 0), (101, "12 !!", "bb", "s", 0), (102, "", None, "s", 0), (103, "日本", None, "s", 0)]
    d = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in langid.identify(d, langid.train(d, F.col("doc_id") % 3 != 1)).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred in ("aa", "bb")
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.identify(d, langid.train(d, F.lit(False)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_every_prefix_count_is_exact(spark):
    counter = token_counts.PrefixCounter(queries.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "é", "日", "😀", "12", "!", "<|endoftext|>", "<|endof", "the", " and", "\x85", "\xa0", "Hello"]
    for _ in range(150):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        counts = token_counts.prefix_counts(counter.table(s))
        for k in range(len(s) + 1):
            assert counts[len(s[:k].encode())] == len(counter.tokenizer.encode(s[:k], add_special_tokens=False).ids), (s, k)
    text = "the quick brown fox jumps over the lazy dog"
    cut = token_counts.longest_prefix(counter.table(text), text, 4)
    assert text.encode()[:cut].decode() == "the quick brown fox"
    got = token_counts.token_counts(docs(spark, [None, "", "a b", "x" * 5000]), queries.tokenizer_path("byte_bpe_50k.json"), limit=2).collect()
    assert [(r.n_bytes, r.over_limit) for r in sorted(got, key=lambda r: r.doc_id)] == [(0, False), (0, False), (3, False), (5000, True)]


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    equal = {k: leaves.select(*mixing.LEVELS[: i + 1], F.lit(1.0).alias("weight")).distinct() for i, k in enumerate(mixing.LEVELS)}
    got = {r.source: r.budget for r in mixing.budgets(leaves, 0.5, 1, 1.0, equal).collect()}
    assert got == pytest.approx({"a": 10, "b": 502.5 - 10, "c": 502.5})


def test_mixing_matches_a_plain_running_sum(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["en", None]), rng.choice(["src1", "src2", None]), 0) for i in range(200)]
    d = spark.createDataFrame(rows, DOC).withColumn("whole", F.lit("mine"))
    got = {r.doc_id: r.copies for r in mixing.mixed(d, 0.6, 2, 0.5).collect()}
    cuts = {(r.lang, r.source): r for r in mixing.plan(d.select("doc_id", mixing.domain_of("source" and F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), mixing.count_words(F.col("text")).alias("tokens")), 0.6, 2, 0.5).collect()}
    leaves = defaultdict(list)
    import hashlib

    for i, t, lang, source, _ in rows:
        leaves[lang or "", source or ""].append((i, len(t.split())))
    for leaf, own in leaves.items():
        c = cuts[leaf]
        key = lambda i, w=c.whole: int(hashlib.md5(f"7:{w}:{i}".encode()).hexdigest()[:15], 16)
        left = int(c.budget - c.whole * c.tokens + 1e-6)
        for i, n in sorted((x for x in own if x[1]), key=lambda x: key(x[0])):
            left -= n
            want = c.whole + (left >= 0 and c.whole < 2)
            assert got.get(i, 0) == want
    sampled = mixing.sample(d, 0.6, 2, 0.5)
    assert sampled.columns == d.columns
    assert sampled.count() == sum(got.values())


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 24))
    near = base[rng.integers(0, 6, 60)] + 0.12 * rng.standard_normal((60, 24))
    x = np.concatenate((base, near, base[:3]))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 24, 0), (202, [1.0, None], 0), (203, [float("nan")] * 24, 0), (204, base[0].tolist(), None), (205, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    ok = (u @ u.T >= 0.98 - 1e-15) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(ok, False)
    want = union_find(len(x), [(int(i), int(j)) for i, j in zip(*np.nonzero(ok), strict=True)])
    got = {r.vec_id: r for r in near_dup_vectors.vector_components(df, 0.98).collect()}
    assert [got[i].n_links for i in range(len(x))] == ok.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == want
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(200, 206))


def test_quality_is_learned(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) + "." for _ in range(60)]
    bad = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(60)) for _ in range(30)] + [(rng.choice(WORDS) + " ") * 60 for _ in range(30)]
    d = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5, None), (999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(d, quality.train(d, labels, F.col("doc_id") % 4 != 0)).collect()}
    assert all((got[i] >= 0.3) == (i < 60) for i in range(120))
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 122
    assert {r.score for r in quality.score(d, quality.train(d, labels.limit(0), F.lit(True))).collect()} == {0.5}


def test_archive_gives_back_every_record(spark):
    big = "<p>é</p>" * 20
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "")]
    archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in warc.read(archive).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), **{i: ("response", None) for i in (4, 5, 6, 7)}}
    assert archive.payloads.count() == 3
    for r in warc.records(archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size:] == b"\r\n\r\n" and b"\nX: y" not in head
        if b"response\r\n" in head.split(b"WARC-Type: ")[1][:10]:
            assert rest[:size].partition(b"\r\n\r\n")[2].decode() == next(h or "" for i, _, h in rows if i == r.page_id)


def test_licence_places_match_brute_force(spark):
    texts = [None, "", "CC-BY 4.0, cc by and CC  BY", "GNU General Public License; general, public license", "All rights reserved. éall rights reserved", "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files", "ccby general public"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(a, label) for p, label in licenses.PHRASES for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[5].labels == "mit" and 0.8 <= got[5].score <= 1
