"""Stages of the pipeline, and corners of their operators, on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nucleogrid.llm import decontaminate, langid, ngram_join

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_stage_reaches_the_target_weights(spark):
    size = {"src0": 1200, "src4": 400, "src8": 300, "src12": 100}  # of one domain
    rows = [(1000 * i + j, "word " * 5, "en", k, 0) for i, (k, n) in enumerate(size.items()) for j in range(n)]
    got = Counter(r.source for r in corpus_pipeline.source_mixing(spark, spark.createDataFrame(rows, DOC), "").collect())
    weight = {k: n**0.8 for k, n in size.items()}
    assert {k: got[k] / sum(got.values()) for k in size} == pytest.approx({k: w / sum(weight.values()) for k, w in weight.items()}, abs=0.005)


def test_the_free_rest_of_a_covered_match_is_marked():
    assert decontaminate.tiles(list(range(20)), [*range(9, 18), -1, *range(4, 12)], 5) == [(4, 10, 5), (9, 0, 9)]


def test_tiles_match_plain_greedy_tiling():
    rng = random.Random(11)
    for case in range(300):
        pattern, text = ([rng.randrange(low, 2 + case % 9) for _ in range(rng.randrange(1, 50))] for low in (0, -1))
        free_p, free_t, want = [True] * len(pattern), [w >= 0 for w in text], []
        while True:
            best = (0, 0, 0)
            for p in range(len(pattern)):
                for t in range(len(text)):
                    k = 0
                    while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and free_p[p + k] and free_t[t + k]:
                        k += 1
                    best = min(best, (-k, p, t))
            k, p, t = -best[0], *best[1:]
            if k < 3:
                break
            free_p[p : p + k] = free_t[t : t + k] = [False] * k
            want.append((p, t, k))
        assert decontaminate.tiles(pattern, text, 3) == sorted(want)


def test_one_row_of_each_group_stays(spark):
    base, other = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    near = lambda words, k: " ".join([*words[:-1], f"x{k}"])
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, near(base, 1)), (2, "a clean text that has the id of a copy"), (None, near(base, 2)), (None, " ".join(other)), (None, near(other, 3)), (None, near(other, 3)), (3, None), (3, ""), (None, ""), (4, "stands alone")]
    d = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOC)
    stage = corpus_pipeline.ngram_jaccard(spark, d, "")
    assert stage.columns == d.columns
    got = Counter((r.doc_id, (r.text or "")[:2]) for r in stage.collect())
    assert got == {(1, "a0"): 1, (2, "a "): 1, (None, "b0"): 1, (3, ""): 2, (None, ""): 1, (4, "st"): 1}


def test_sets_without_a_doc_id_link_and_bridge(spark):
    words = [f"w{i}" for i in range(100)]
    bridge = " ".join(["y", *words[1:]])
    rows = [(1, " ".join(words[:-1] + ["z"])), (None, " ".join(words)), (None, bridge), (2, " ".join(["y", "yy", *words[2:]]))]
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 95, 100).collect()}
    assert got == {(1, 1), (None, 1), (2, 1)}


def test_languages_of_a_rare_script_are_told_apart(spark):
    rng = random.Random(2)
    latin = ["the quick brown fox jumps over lazy dog vexed", "àáâãäåæçèéêëìíîï 1."]
    vocab = {"la": latin, "xa": ["дом", "лип", "воз", "кан"], "xb": ["мод", "пил", "зов", "нак"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(40 if k == "la" else 10)), k, "s", 0) for i in range(240) for k in [("la", "xa", "la", "xb")[i % 4]]]
    d = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, langid.train(d, F.col("doc_id") % 3 != 1)).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_rows_of_one_vec_id_keep_their_own_links(spark):
    from nucleogrid.llm import near_dup_vectors

    v, w, far = [1.0, 0.0, 0.05], [1.0, 0.05, 0.0], [0.0, 1.0, 0.0]
    run = lambda rows: sorted((r.vec_id, r.n_links, r.component_id) for r in near_dup_vectors.vector_components(spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("mine")).withColumn("copy", F.lit(1)), 0.98).collect())
    assert run([(1, v), (1, far), (2, w)]) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
    assert run([(1, v), (1, w), (2, w)]) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert run([]) == []


def test_records_are_parsed_from_their_bytes(spark):
    from nucleogrid.llm import warc

    long = "long <p>é</p> " * 400_000
    rows = [(5, "http://x/?WARC-Type: revisit", "hello world", 1), (5, "http://x/?WARC-Type: revisit", "hello world", 1), (9, "u", long, 1), (2, "v", long, 1), (None, "v", long, 1), (None, None, None, 1)]
    archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, header long"))
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(archive).collect()), key=str) == sorted([(5, 11, "response", None), (5, 11, "response", None), (9, len(long.encode()), "revisit", 2), (2, len(long.encode()), "response", None), (None, len(long.encode()), "response", None), (None, 0, "response", None)], key=str)
    assert all(bytes(r.record).endswith(b"hello world\r\n\r\n") for r in warc.records(archive).collect() if r.page_id == 5)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(empty)).count() == 0
    broken = warc.Archive(archive.headers, archive.packed.limit(0))
    with pytest.raises(Exception, match="missing|not intact"):
        warc.read(broken).collect()
