"""Licence scans by diagonal voting, in DataFrame operations only.

Every run of k words of a document is hashed and joined with the places of the same run in the
templates.  A place in the document less one in the template is a diagonal: a passage that
follows a template votes for one diagonal again and again.  Votes are aggregated by diagonal,
diagonals that lie next to each other are merged (a word more or less moves to the next one),
and a merged span is accepted when the template's words that its verified runs cover are a large
enough share.  A vote is verified by comparing the words themselves.

Short phrases are templates of one run: each of their votes is a place of the phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .store import written

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wordings of well-known licence notices, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("either version 3 of the license or at your option any later version", "gpl-3.0"),
    ("either version 2 of the license or at your option any later version", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: Words of a run of a notice; a phrase is one run of its own length.
RUN = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, base, size, start, run, hash) of each run of each template."""
    rows = []
    for t, (text, label) in enumerate((*phrases, *notices)):
        w, base = text.split(" "), t < len(phrases)
        k = len(w) if base else RUN
        rows += [(t, label, base, len(w), i, w[i : i + k]) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, start int, run array<string>").withColumn("hash", F.xxhash64("run"))


def scan(docs: DataFrame, share: float = 0.8, reach: int = 2, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Of each row of docs (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start (words from 0; null without one).  ``labels`` has the phrases'
    and those of accepted notices, distinct, sorted and joined by commas ('' without any);
    ``spans`` those notices' (label, first word, last word, share covered).  ``score`` is 1 where
    a phrase stands, else the largest share of a notice that is covered (0 to 1, 0 for none).
    Null and empty texts have no words.  Repeated rows are scanned each, texts of any length whole; an
    empty table gives none.  Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    runs = templates(spark, phrases, notices)
    sizes = sorted({len(r.run) for r in runs.select("run").collect()})
    hashes = {k: [r.hash for r in runs.filter(F.size("run") == k).select("hash").distinct().collect()] for k in sizes}

    # every run of every document is hashed where it stands; those of no template's hash go before they become rows
    def voting(w: Column, k: int) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        run = lambda i: F.slice(w, i + 1, k)
        hits = F.filter(F.transform(at, lambda i: F.struct(i.alias("place"), F.xxhash64(run(i)).alias("hash"))), lambda s: s["hash"].isin(hashes[k]))
        return F.transform(hits, lambda s: F.struct(s["place"].alias("place"), s["hash"].alias("hash"), run(s["place"]).alias("run")))

    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    held = written(split.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*(voting(F.col("w"), k) for k in sizes)).alias("votes")), "votes")

    vote = held.filter(F.size("votes") > 0).select("row", F.explode("votes").alias("v")).select("row", "v.place", "v.hash", "v.run")
    met = vote.join(runs.withColumnRenamed("run", "own"), "hash").filter("run = own").withColumn("diagonal", F.col("place") - F.col("start"))
    places = met.filter("base").groupBy("row").agg(F.count("*").alias("n_base"), F.min("place").cast("long").alias("first_word"), F.max("place").cast("long").alias("last_word"), F.collect_set("label").alias("base"))

    diagonals = met.filter("NOT base").groupBy("row", "template", "label", "size", "diagonal").agg(F.collect_set("start").alias("starts"), F.min("place").alias("a"), F.max("place").alias("z"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    stepped = diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > reach).cast("int"), F.lit(1)))
    merged = stepped.withColumn("span", F.sum("new").over(order)).groupBy("row", "template", "label", "size", "span").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.min("a").alias("a"), F.max("z").alias("z"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + RUN - 1)))))
    spans = merged.select("row", "label", F.col("a").cast("long").alias("first"), (F.col("z") + RUN - 1).cast("long").alias("last"), (covered / F.col("size")).alias("share"))
    best = spans.groupBy("row").agg(F.max("share").alias("share"), F.array_sort(F.collect_set(F.when(F.col("share") >= share, F.struct("label", "first", "last", "share")))).alias("spans"))

    joined = held.select("row", "doc_id", "n_words").join(places, "row", "left").join(best, "row", "left")
    none = F.array().cast("array<string>")
    base, own = F.coalesce("base", none), F.coalesce(F.transform("spans", lambda s: s["label"]), none)
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,first:bigint,last:bigint,share:double>>")).alias("spans"),
    )
