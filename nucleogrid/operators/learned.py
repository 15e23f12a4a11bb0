"""Fitted classes: mixtures of normal distributions and linear classifiers, on aggregates or Spark's own learners."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F


def _shares(x: Column, k: int) -> list[Column]:
    """The share of each component in a value, from columns w0, m0, v0 and so on."""
    logs = [F.ln(F.col(f"w{i}")) - F.ln(F.col(f"v{i}")) / 2 - (x - F.col(f"m{i}")) ** 2 / (2 * F.col(f"v{i}")) for i in range(k)]
    size = [F.exp(v - F.greatest(*logs)) for v in logs]
    whole = sum(size[1:], size[0])
    return [s / whole for s in size]


def mixture(df: DataFrame, by: str, value: str, k: int = 2, limit: float = 4.0, steps: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """Rows with ``p``, the posteriors of k normal components fitted in each group, those with smaller means first.

    Values are scaled to mean 0 and deviation 1 in their group and clipped at ``limit``.  A step is
    one aggregation over all rows: only k triples a group come to the driver, so groups of any size
    are spread.  The start is fixed (means from -1 to 1), variances stay above 1e-6, and it ends when
    no mean moves more than ``tolerance``.  Null values, and groups without spread, have null posteriors.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[by]
    ends = df.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")).filter("_s > 0")
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    scaled = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-float(limit))), F.lit(float(limit))))
    x = df.select(by, value).join(ends, by).select(by, scaled.alias("_x")).filter("_x IS NOT NULL").persist(StorageLevel.DISK_ONLY)
    start = [(1 / k, 2 * i / (k - 1) - 1 if k > 1 else 0.0, 1.0) for i in range(k)]
    now = {r[0]: start for r in ends.select(by).collect() if r[0] is not None}
    names = [f"{c}{i}" for i in range(k) for c in "wmv"]
    schema = ", ".join([f"{by} {kind}", *(f"{n} double" for n in names)])
    table = lambda p: spark.createDataFrame([(g, *(v for c in sorted(cs, key=lambda c: c[1]) for v in c)) for g, cs in p.items()], schema)
    for _ in range(steps if now else 0):
        shares = _shares(F.col("_x"), k)
        sums = [f(r).alias(f"{n}{i}") for i, r in enumerate(shares) for n, f in (("n", F.sum), ("a", lambda r: F.sum(r * F.col("_x"))), ("b", lambda r: F.sum(r * F.col("_x") ** 2)))]
        moved = 0.0
        for r in x.join(table(now), by).groupBy(by).agg(F.count("*").alias("all"), *sums).collect():
            new = []
            for i in range(k):
                n = max(r[f"n{i}"], 1e-12)
                mean = r[f"a{i}"] / n
                new.append((n / r["all"], mean, max(r[f"b{i}"] / n - mean * mean, 1e-6)))
            new.sort(key=lambda c: c[1])
            moved = max(moved, *(abs(a[1] - b[1]) for a, b in zip(new, sorted(now[r[by]], key=lambda c: c[1]))))
            now[r[by]] = new
        if moved <= tolerance:
            break
    x.unpersist()
    fitted = ends.join(table(now), by)
    return df.join(fitted, by, "left").withColumn("p", F.when(scaled.isNotNull(), F.array(*_shares(scaled, k)))).drop("_m", "_s", *names)


def positive(p: Column, confidence: float, off_target: Column) -> Column:
    """Whether the posterior of the highest component is sure enough; in layers off target it has to be 0.4 surer."""
    return F.element_at(p, -1) > F.lit(confidence) + F.when(off_target, 0.4).otherwise(0.0)


def one_vs_all(df: DataFrame, key: str, features: str, label: str, folds: int = 5, seed: int = 1, steps: int = 30) -> DataFrame:
    """(key, label, predicted) by linear support vectors on standardised features, each row predicted by a model that hasn't seen it.

    Folds go by a hash of the key.  Rows without features or label take no part.  A label that only
    one fold has can't be predicted there.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
    from pyspark.ml.functions import array_to_vector

    usable = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull())
    usable = usable.select(key, F.col(label).cast("string").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("_raw"), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).alias("_fold"))
    classes = StringIndexer(inputCol="label", outputCol="_class", stringOrderType="alphabetAsc").fit(usable)
    indexed, out = classes.transform(usable).persist(StorageLevel.DISK_ONLY), None
    svm = OneVsRest(classifier=LinearSVC(maxIter=steps, regParam=0.01), featuresCol="_features", labelCol="_class", predictionCol="_number", parallelism=4)
    for f in range(folds):
        model = Pipeline(stages=[StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), svm, IndexToString(inputCol="_number", outputCol="predicted", labels=classes.labels)]).fit(indexed.filter(F.col("_fold") != f))
        part = model.transform(indexed.filter(F.col("_fold") == f)).select(key, "label", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def confusion(predicted: DataFrame) -> DataFrame:
    """(label, predicted, n, share): how often each label was taken for which, and the share among the label's rows."""
    n = predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("label").agg(F.sum("n").alias("_all")), "label").select("label", "predicted", "n", (F.col("n") / F.col("_all")).alias("share"))
