"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, lang, source).  A node's capacity is the tokens below it times the epochs
allowed.  Budgets go down the tree: children get their parent's budget in proportion to their
weights, none more than its capacity, and what a child can't use goes to its siblings.  As no
parent gets more than its children can use, a shortage moves to a node's siblings first and
reaches the ancestors' siblings only when these are used up.

With caps c and weights w the fill level of siblings with budget b is
``max over i of (b - sum of c before i) / (sum of w from i on)`` in the order of c / w, which
running sums give; a child then gets ``least(c, level * w)``.

A leaf's budget is so many whole epochs and a prefix of one more, in an order of its own: that
of an md5 of seed, epoch and doc_id.  Where the prefix ends is found from sums over ranges of
that order, then inside one range, so no leaf is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

LEVELS = ("domain", "lang", "source")


def count_words(text: Column) -> Column:
    """The tokens that budgets are in: words between blanks."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of the md5 of seed, epoch and doc_id."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds x, each child's part of its parent's budget b, from its capacity c and weight w."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.expr("c / w"), *LEVELS[: len(parent) + 1])
    before = F.coalesce(F.sum("c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    back = siblings.orderBy(F.expr("c / w").desc(), *(F.desc(k) for k in LEVELS[: len(parent) + 1]))
    behind = F.sum("w").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = children.withColumn("level", (F.col("b") - before) / behind)
    return level.withColumn("x", F.least(F.col("c"), F.max("level").over(siblings) * F.col("w"))).drop("level")


def budgets(leaves: DataFrame, share: float, epochs: int, temperature: float, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the budget of each, in tokens.

    The total is ``share`` of all tokens, or the whole capacity if that is less.  ``weights`` may
    give, for a level, a table (the columns of LEVELS up to it, weight); else a node's weight is
    its tokens to the power ``temperature``.
    """
    nodes = leaves.filter("tokens > 0").withColumn("c", F.col("tokens") * float(epochs))
    above, parent = None, []
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        own = nodes.groupBy(*keys).agg(F.sum("c").alias("c"), F.sum("tokens").alias("tokens"))
        if weights and level in weights:
            own = own.join(weights[level].select(*keys, F.col("weight").cast("double").alias("w")), keys, "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(1e-12)))
        else:
            own = own.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(temperature)))
        if above is None:
            own = own.withColumn("b", F.least(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(share), F.sum("c").over(Window.partitionBy(F.lit(0)))))
        else:
            own = own.join(above, parent)
        above = _fill(own, parent).select(*keys, "tokens", F.col("x").alias("b"))
        if level != LEVELS[-1]:
            above = above.drop("tokens")
        parent = keys
    return above.withColumnRenamed("b", "budget")


def domain_of(source: Column) -> Column:
    """Documents have no domain of their own: sources are dealt to four by the number in their name, those without one to a fifth."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(F.substring(number, -6, 6).cast("int"), F.lit(4)).cast("string")))


def plan(docs: DataFrame, share: float = 0.9, epochs: int = 2, temperature: float = 0.8, seed: int = 7, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """Of each leaf: domain, lang, source, tokens, budget, whole (epochs) and upto (order key at which the next ends, exclusive).

    docs has doc_id, domain, lang, source and tokens, and is read three times.
    """
    leaves = docs.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    own = written(
        budgets(leaves, share, epochs, temperature, weights).select(*LEVELS, "tokens", "budget", F.floor(F.col("budget") / F.col("tokens") + 1e-9).cast("long").alias("whole")).withColumn("rest", F.floor(F.col("budget") - F.col("whole") * F.col("tokens") + 1e-6).cast("long")), "budgets"
    )
    keyed = docs.join(own.select(*LEVELS, "whole", "rest"), list(LEVELS)).filter("tokens > 0").withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id")))
    ranged = keyed.select(*LEVELS, "rest", "tokens", "key", F.shiftright("key", 48).alias("range"))
    sums = ranged.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    running = sums.withColumn("through", F.sum("t").over(upto))
    edge = running.filter("through > rest AND through - t <= rest").select(*LEVELS, "range", (F.col("rest") - F.col("through") + F.col("t")).alias("left"))
    inside = ranged.join(edge, [*LEVELS, "range"]).withColumn("through", F.sum("tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("key")))
    cut = inside.filter("through > left").groupBy(*LEVELS).agg(F.min("key").alias("upto"))
    return written(own.join(cut, list(LEVELS), "left").drop("rest"), "cuts")


def mixed(docs: DataFrame, share: float = 0.9, epochs: int = 2, temperature: float = 0.8, seed: int = 7, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies) of each row of docs (doc_id, text, lang, source, ...) that is selected.

    ``copies`` is the number of epochs that a document is in.  A null lang or source is a leaf of
    its own, named ''.  Texts without a word cost nothing and are not selected.  Rows of the same
    doc_id stand or fall together.  At most a leaf's budget is used: the document that would pass
    it is left out.  An empty table gives none; texts of any length are read whole.  Other columns,
    whatever their names, are not read.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), count_words(F.col("text")).alias("tokens"))
    small = written(counted.withColumn("domain", domain_of(F.col("source"))), "counted")
    cuts = plan(small, share, epochs, temperature, seed, weights)
    kept = small.join(cuts.select(*LEVELS, "whole", "upto"), list(LEVELS)).filter("tokens > 0")
    inside = (F.col("upto").isNull() | (order_key(seed, F.col("whole"), F.col("doc_id")) < F.col("upto"))) & (F.col("whole") < epochs)
    # without an edge the whole next epoch fits; that of a leaf at its capacity has no next epoch
    return kept.withColumn("copies", (F.col("whole") + inside.cast("int")).cast("int")).filter("copies > 0").select("doc_id", "domain", "lang", "source", "tokens", "copies")


def sample(docs: DataFrame, share: float = 0.9, epochs: int = 2, temperature: float = 0.8, seed: int = 7, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of docs that ``mixed`` selects, with all their columns, once for each epoch."""
    names = ["domain", "lang", "source", "whole", "upto"]
    free = {n: f"mix_{i}_{n}" for i, n in enumerate(names)}
    while set(free.values()) & set(docs.columns):
        free = {n: v + "_" for n, v in free.items()}
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), count_words(F.col("text")).alias("tokens"))
    cuts = plan(written(counted.withColumn("domain", domain_of(F.col("source"))), "counted"), share, epochs, temperature, seed, weights)
    side = cuts.select(*(F.col(n).alias(free[n]) for n in names))
    lang, source = F.coalesce(docs["lang"], F.lit("")), F.coalesce(docs["source"], F.lit(""))
    joined = docs.join(side, (domain_of(source) == F.col(free["domain"])) & (lang == F.col(free["lang"])) & (source == F.col(free["source"])))
    inside = (F.col(free["upto"]).isNull() | (order_key(seed, F.col(free["whole"]), docs["doc_id"]) < F.col(free["upto"]))) & (F.col(free["whole"]) < epochs)
    copies = F.when(count_words(docs["text"]) > 0, F.col(free["whole"]) + inside.cast("int")).otherwise(F.lit(0)).cast("int")
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(1), copies)).alias(free["whole"] + "_e")).drop(free["whole"] + "_e")
