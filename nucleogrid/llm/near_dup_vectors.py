"""Near duplicates of vectors: the subspace pigeonhole join.

For unit vectors cos >= c is squared distance <= 2 - 2c.  Vectors are turned by a fixed random
rotation, which keeps distances, and cut into BLOCKS blocks of dimensions; the squared distance
is the sum of the blocks', so in some block it is no more than the block's proportional share
of the budget.  Each block is a range join: by label and a grid over the block's first
dimensions a vector is stored in its cell and asks all cells that its ball reaches.  In a cell
the block's distances are exact products; what passes is verified by the cosine in double
precision.  A pair counts only in the first block that lets it pass, so it is found once.

Cells are dealt out in tiles of stored by asking vectors, so a hot cell is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .store import on_workers, release, written

BLOCKS, GRID = 4, 2
#: Stored and asking vectors of a tile.
TILE = 2048


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240607).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _cells(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True)
            for i, size, label, v in rows:
                x = np.array(v.values.to_numpy())
                x /= np.abs(x).max()  # no overflow
                x /= np.linalg.norm(x)
                if len(x) not in turns:
                    turns[len(x)] = rotation(len(x))
                blocks = np.array_split(turns[len(x)] @ x, min(BLOCKS, len(x)))
                out = []
                for b, own in enumerate(blocks):
                    reach = np.sqrt((2 - 2 * cosine) * len(own) / len(x)) + 1e-9
                    head = own[:GRID]
                    home = np.floor(head / (2 * reach)).astype(int)
                    low, high = np.floor((head - reach) / (2 * reach)).astype(int), np.floor((head + reach) / (2 * reach)).astype(int)
                    name = lambda c, b=b, d=len(x): f"{d}:{b}:" + ",".join(map(str, c))
                    out.append((name(home), True))
                    for step in np.ndindex(*(high - low + 1)):
                        out.append((name(low + step), False))
                yield pa.RecordBatch.from_pydict({"vec_id": [i] * len(out), "size": [size] * len(out), "label": [label] * len(out), "vector": pa.array([x.tobytes()] * len(out)), "cell": [c for c, _ in out], "stored": [s for _, s in out]})
        release()

    return run


def _links(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = int(key[1].split(":")[1])
        x = np.stack([np.frombuffer(v) for v in rows["vector"]])
        ids, sizes, stored = rows["vec_id"].to_numpy(), rows["size"].to_numpy(), rows["stored"].to_numpy()
        dim = x.shape[1]
        turned = x @ rotation(dim).T
        edges = np.cumsum([0, *map(len, np.array_split(np.arange(dim), min(BLOCKS, dim)))])
        a, s = np.flatnonzero(~stored), np.flatnonzero(stored)
        n = np.zeros(len(ids), np.int64)
        root = {int(i): int(i) for i in ids}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            ok = ids[part][:, None] < ids[s][None, :]
            for b in range(block + 1):
                p, q = turned[part, edges[b] : edges[b + 1]], turned[s, edges[b] : edges[b + 1]]
                far = (p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None, :] - 2 * p @ q.T > (2 - 2 * cosine) * (edges[b + 1] - edges[b]) / dim + 1e-9
                ok &= ~far if b == block else far
            i, j = np.nonzero(ok)
            i, j = part[i], s[j]
            for k in range(0, len(i), 1 << 16):
                u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                close = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[close], v[close]
                np.add.at(n, u, sizes[v])
                np.add.at(n, v, sizes[u])
                for p, q in zip(ids[u].tolist(), ids[v].tolist(), strict=True):
                    p, q = find(p), find(q)
                    root[max(p, q)] = min(p, q)
        met = n > 0
        return pd.DataFrame({"vec_id": ids[met], "n": n[met], "near": [find(k) for k in ids[met].tolist()]}).astype("int64")

    return run


def vector_components(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine is ``cosine`` or more.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing,
    nor do rows without a vec_id or of different lengths.  Equal vectors are collapsed, so each
    link of a copy counts though copies aren't paired; rows of one vec_id count as different, each
    with the links of its own vector.  An empty table gives none.  Other columns are not read.
    """
    on_workers(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    keyed = written(rows.withColumn("copy", F.when(usable, F.sha2(F.concat_ws(" ", "label", F.to_json("embedding")), 256))), "vectors")
    # one node per distinct vector of a label, numbered as the table is written; its size counts its copies
    nodes = keyed.filter("copy IS NOT NULL").groupBy("copy").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    return _linked(keyed, nodes, cosine)


def _linked(keyed: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    cells = nodes.select(F.col("node").alias("vec_id"), "size", "label", "embedding").mapInArrow(_cells(cosine), "vec_id long, size long, label string, vector binary, cell string, stored boolean")
    dense = cells.groupBy("label", "cell").agg(F.count_if("stored").alias("s"), F.count_if(~F.col("stored")).alias("a")).filter(f"greatest(s, a) > {TILE}")
    dense = written(dense.select("label", "cell", F.ceil(F.col("s") / TILE).alias("s"), F.ceil(F.col("a") / TILE).alias("a")), "dense")
    split = cells.join(dense, ["label", "cell"], "left").withColumns({"s": F.greatest(F.coalesce("s", F.lit(1)), F.lit(1)), "a": F.greatest(F.coalesce("a", F.lit(1)), F.lit(1))})
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dealt = split.withColumn("ts", F.explode(F.when(F.col("stored"), F.array(own("s"))).otherwise(every("s")))).withColumn("ta", F.explode(F.when(F.col("stored"), every("a")).otherwise(F.array(own("a")))))
    met = dealt.groupBy("label", "cell", "ts", "ta").applyInPandas(_links(cosine), "vec_id long, n long, near long")
    found = written(met, "links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "node")
    roots = components(found, "vec_id", "near")
    per_node = nodes.select("copy", "node", "first", "size").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = per_node.groupBy("root").agg(F.min("first").alias("lowest"))
    known = per_node.join(lowest, "root").select("copy", "size", "n", "lowest")
    linked = keyed.select("vec_id", "copy").join(known, "copy", "left")
    component = F.coalesce("lowest", "vec_id")
    return linked.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
