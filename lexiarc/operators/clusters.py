"""Similar vectors within a scope: pairs, and greedy clusters in row order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import cut_lineage

#: Rows of a scope that one task compares with as many others.
BLOCK = 10_000


def similar_pairs(rows: DataFrame, record: str, scope: str, vector: str, threshold: float) -> DataFrame:
    """``scope``, ``id_a`` < ``id_b`` and ``similarity`` of all pairs of a scope that reach the threshold.

    A scope is divided into blocks of bounded size, and each pair of blocks is
    one group, so a scope with a large share of all rows is spread over many
    tasks.  Zero and NULL vectors take no part; vectors of different lengths
    aren't compared.
    """
    kept = rows.select(F.col(scope).alias("scope"), F.col(record).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.size(vector).alias("dim")).where("v is not null and dim > 0 and id is not null").where(~F.exists("v", lambda x: x.isNull()))
    sizes = kept.groupBy("scope", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    kept = kept.join(sizes, ["scope", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row meets every block once: as the first of the pair up to its own block, as the second from there
    spread = kept.select("scope", "dim", "id", "v", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("scope", "dim", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "v")

    def compare(table: pa.Table) -> pa.Table:
        dim, a, b = (table[c][0].as_py() for c in ("dim", "a", "b"))
        ids, own = table["id"].to_numpy(), table["own"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("float64")
        norm = np.sqrt((x**2).sum(1))
        good = norm > 0
        ids, own, x = ids[good], own[good], x[good] / norm[good, None]
        left, right = own == a, own == b
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        li, lx, ri, rx = ids[left], x[left], ids[right], x[right]
        for s in range(0, len(li), 512):
            c = lx[s : s + 512] @ rx.T
            i, j = np.nonzero(c >= threshold - 1e-12)
            p, q, v = li[s + i], ri[j], c[i, j]
            keep = p < q if a == b else p != q
            found.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], v[keep]))
        p, q, v = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        key = table["scope"].combine_chunks().take(pa.array(np.zeros(len(p), "int64")))
        return pa.Table.from_arrays([key, pa.array(p), pa.array(q), pa.array(v)], ["scope", "id_a", "id_b", "similarity"])

    kind = kept.schema["scope"].dataType.simpleString()
    pairs = spread.groupBy("scope", "dim", "a", "b").applyInArrow(compare, f"scope {kind}, id_a long, id_b long, similarity double")
    return pairs.groupBy("scope", "id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def greedy_clusters(rows: DataFrame, record: str, scope: str, vector: str, threshold: float = 0.8) -> DataFrame:
    """``scope``, ``id`` and the ``seed`` of its cluster.

    In id order a record that no earlier seed has absorbed is a seed, and absorbs
    every later record that reaches the threshold with it.  Rows are decided in
    rounds: a row is a seed once all earlier neighbours are absorbed, and
    absorbed once one of them is a seed.  Each round is written out and decides at
    least the first open row of every scope, so the rounds end; their number is that of the links of the longest
    chain of neighbours.
    """
    pairs = cut_lineage(similar_pairs(rows, record, scope, vector, threshold).select("scope", "id_a", "id_b"))
    members = pairs.select("scope", F.col("id_a").alias("id")).union(pairs.select("scope", F.col("id_b").alias("id"))).distinct()
    state = cut_lineage(members.withColumn("seed", F.lit(None).cast("long")))
    while not state.where("seed is null").isEmpty():
        earlier = pairs.join(state.select("scope", F.col("id").alias("id_a"), F.col("seed").alias("seed_a")), ["scope", "id_a"])
        by_row = earlier.groupBy("scope", F.col("id_b").alias("id")).agg(F.min(F.when(F.col("seed_a") == F.col("id_a"), F.col("id_a"))).alias("by"), F.count_if(F.col("seed_a").isNull()).alias("open"), F.min(F.when(F.col("seed_a").isNull(), F.col("id_a"))).alias("first_open"))
        joined = state.join(by_row, ["scope", "id"], "left")
        # the first seed absorbs; an open neighbour before it could still become one
        absorbed = F.when(F.col("by").isNotNull() & (F.col("first_open").isNull() | (F.col("first_open") > F.col("by"))), F.col("by"))
        seeds = F.when(F.col("by").isNull() & (F.coalesce("open", F.lit(0)) == 0), F.col("id"))
        state = cut_lineage(joined.select("scope", "id", F.coalesce("seed", absorbed, seeds).alias("seed")))
    all_rows = rows.select(F.col(scope).alias("scope"), F.col(record).cast("long").alias("id")).where(F.col(vector).isNotNull() & F.col(record).isNotNull()).distinct()
    return all_rows.join(state, ["scope", "id"], "left").select("scope", "id", F.coalesce("seed", "id").alias("seed"))


def by_size(clusters: DataFrame) -> DataFrame:
    """``scope``, ``seed``, ``size`` and the ``rank`` of each cluster of several records in its scope, the largest first; ties by seed."""
    sizes = clusters.groupBy("scope", "seed").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("size"), "seed")))
