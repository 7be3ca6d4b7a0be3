"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree splits the unit sphere recursively: a node projects on the direction between two random sample vectors,
cuts near the middle, and sends vectors within `spill` of the cut down both branches. Vectors are compared inside
leaves only, across many trees, by exact cosine in double precision; verified links are counted and united.

The trees' directions and cuts are fitted on a bounded sample (`sample` vectors with the smallest hash of their id);
every vector is indexed. Depth follows the number of vectors, so leaves keep their size as the input grows, while
the forest that every task gets keeps the size that the sample gives it. Equal
vectors are one class before anything is compared, with their number as weight. A leaf with more than `leaf_cap`
classes is split into pairs of blocks, so no task ever holds an unbounded leaf. A leaf emits one row per linked
vector (its links there and the smallest linked id), never its pairs; a pair that meets in several leaves counts in
the first of them alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, discard, map_arrow, materialize


#: Sample vectors that a node has when it is fitted on them.
FITTED = 16


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, matrix) of a batch of vectors, zero padded to the longest and of unit length; length 0 if unusable."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r), default=0)
    out, sizes = np.zeros((len(rows), width)), np.zeros(len(rows), np.int64)
    for k, r in enumerate(rows):
        if r and all(v is not None for v in r):
            v = np.asarray(r, np.float64)
            norm = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
            if 0 < norm < math.inf:
                out[k, : len(v)], sizes[k] = v / norm, len(v)
            elif np.isfinite(v).all() and v.any():
                v = v / np.abs(v).max()
                out[k, : len(v)], sizes[k] = v / math.sqrt(float(v @ v)), len(v)
    return sizes, out


def _profile(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        sizes, _ = unit_rows(b.column(1))
        keys = [xxhash.xxh3_128_digest(np.asarray(v, np.float64).tobytes() + bytes([len(v) % 251])) if s else None for s, v in zip(sizes, b.column(1).to_pylist())]
        yield pa.record_batch([b.column(0), pa.array(keys, pa.binary())], ["id", "key"])


class Forest:
    """Random-projection trees as arrays: node k of a tree has the children 2k + 1 and 2k + 2.

    The first levels are fitted on the sample, as far as a node has FITTED of its vectors. Below, all nodes of a tree's
    level share one random direction, and each cuts at the mean of the sample's vectors in its fitted ancestor, so the
    forest has a size that the sample bounds whatever the depth.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, spill: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        fitted = max(0, min(depth, int(math.log2(max(1, len(sample) / FITTED)))))
        nodes = 2**fitted - 1
        dim = sample.shape[1]
        self.trees, self.depth, self.fitted, self.spill, self.dim = trees, depth, fitted, spill, dim
        self.directions = np.zeros((trees, nodes, dim), np.float32)
        self.cuts = np.zeros((trees, nodes), np.float32)
        self.below = rng.standard_normal((trees, depth - fitted, dim)).astype(np.float32)
        self.below /= np.maximum(np.linalg.norm(self.below, axis=2, keepdims=True), 1e-30)
        self.middles = np.zeros((trees, depth - fitted, 2**fitted), np.float32)
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for k in range(nodes):
                own = held.pop(k, np.empty(0, np.int64))
                d = rng.standard_normal(dim)
                if len(own) > 1:
                    i, j = rng.choice(own, 2, replace=False)
                    d = 0.5 * d / np.linalg.norm(d) + (sample[i] - sample[j])
                d = d / np.linalg.norm(d)
                p = sample[own] @ d
                cut = float(np.quantile(p, rng.uniform(0.4, 0.6))) if len(own) else 0.0
                self.directions[t, k], self.cuts[t, k] = d, cut
                held[2 * k + 1], held[2 * k + 2] = own[p <= cut], own[p > cut]
            for k, own in held.items():
                if len(own):
                    self.middles[t, :, k - nodes] = self.below[t] @ sample[own].mean(0)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): every leaf that each row of x reaches, cells ascending within a row."""
        rows, cells = [], []
        for t in range(self.trees):
            at, node, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                if level < self.fitted:
                    p = np.einsum("ij,ij->i", x[at], self.directions[t, node]) - self.cuts[t, node]
                else:
                    k = level - self.fitted
                    home = node - (2**self.fitted - 1) if not k else home
                    p = (x @ self.below[t, k])[at] - self.middles[t, k, home]
                low, high = p <= self.spill, p > -self.spill
                at, home, node = np.concatenate([at[low], at[high]]), np.concatenate([home[low], home[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
            rows.append(at)
            cells.append(node - (2**self.depth - 1) + t * 2**self.depth)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.lexsort((cells, rows))
        return rows[order], cells[order]


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        forest = shared.value
        for b in batches:
            sizes, x = unit_rows(b.column(2))
            wide = np.zeros((len(x), forest.dim), np.float32)
            wide[:, : min(forest.dim, x.shape[1])] = x[:, : forest.dim]
            rows, cells = forest.leaves(wide)
            ends = np.searchsorted(rows, np.arange(len(x) + 1))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells, pa.int64()))], ["id", "weight", "vector", "cells"])

    return run


def _compare(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        ids, weight, side = table["id"].to_numpy(), table["weight"].to_numpy(), table["side"].to_numpy()
        sizes, x = unit_rows(table["vector"].combine_chunks())
        left, right = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
        diagonal = bool((side == 2).any())
        found = []
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            ok = (x[part] @ x[right].T >= threshold) & (sizes[part][:, None] == sizes[right][None, :])
            if diagonal:
                ok &= part[:, None] != right[None, :]
            i, j = np.nonzero(ok)
            if len(i):
                found.append((part[i], right[j]))
        if not found:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        i, j = (np.concatenate(c) for c in zip(*found))
        # the pair counts here only if it does not meet in an earlier leaf
        used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = where[: len(i)], where[len(i) :]
        cells = table["cells"].combine_chunks().take(pa.array(used))
        owner, flat = np.repeat(np.arange(len(used)), np.diff(cells.offsets.to_numpy())), cells.values.to_numpy()[cells.offsets[0].as_py() :]
        early = flat < cell
        owner, flat = owner[early], flat[early]
        met = np.zeros(len(i), bool)
        codes, code = np.unique(flat, return_inverse=True)
        for at in range(0, len(codes), 4096):
            own = (code >= at) & (code < at + 4096)
            hit = np.zeros((len(used), min(4096, len(codes) - at)), bool)
            hit[owner[own], code[own] - at] = True
            packed = np.packbits(hit, axis=1)
            for lo in range(0, len(i), 65536):
                met[lo : lo + 65536] |= (packed[a[lo : lo + 65536]] & packed[b[lo : lo + 65536]]).any(axis=1)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i[~met], weight[j[~met]])
        if not diagonal:
            np.add.at(links, j[~met], weight[i[~met]])
        root = ids.copy()
        while True:
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            if (root == before).all():
                break
        rows = np.unique(np.concatenate([i, j]))
        return pa.table({"id": ids[rows], "links": links[rows], "root": root[rows]})

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, trees: int = 12, leaf: int = 256, spill: float = 0.02, sample: int = 10_000, leaf_cap: int = 4096, seed: int = 0) -> DataFrame:
    """Return (id_col, n_links, component_id, kept), one row per distinct id.

    Links are pairs with cosine >= threshold in double precision. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing, and vectors of different lengths do not link. n_links counts the
    other vectors linked directly, equal ones included; component_id is the smallest id reachable, kept tells
    whether it is the row's own. Rows that repeat an id give one row and count once. Rows with a null id link with
    nothing and give one row with a null component. An empty table gives an empty result; other columns, whatever
    their names, are ignored. Links between different vectors are found with the forest's recall, which the tests
    hold against brute force; links between equal vectors always are.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keyed = materialize(map_arrow(x, _profile, "id long, key binary"), "keys")
    rows = keyed.groupBy("id").agg(F.min("key").alias("key"))
    classes = rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    members = materialize(rows.join(classes, "key", "left").select("id", "rep", "weight"), "members")
    reps = members.where("id = rep").select("id", "weight")
    base = materialize(x.join(reps, "id").dropDuplicates(["id"]).select("id", "weight", "vector"), "classes")
    n = base.count()
    if n < 2:
        found = spark.createDataFrame([], "id long, links long, root long")
    else:
        drawn = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vector")
        fit = map_arrow(drawn, _sample_rows, "id long, vector array<double>").toPandas().sort_values("id")
        width = max(len(v) for v in fit["vector"])
        matrix = np.zeros((len(fit), width))
        for k, v in enumerate(fit["vector"]):
            matrix[k, : len(v)] = v
        depth = max(0, math.ceil(math.log2(n / leaf)))
        shared = spark.sparkContext.broadcast(Forest(matrix, trees, depth, spill, seed))
        indexed = materialize(map_arrow(base.select("id", "weight", "vector"), _index(shared), "id long, weight long, vector array<double>, cells array<long>"), "indexed")
        spread = indexed.withColumn("cell", F.explode("cells"))
        crowded = indexed.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > leaf_cap).select("cell", F.ceil(F.col("count") / (leaf_cap // 2)).cast("int").alias("nb"))
        crowded = materialize(crowded, "crowded")
        many = crowded.count()
        if many:
            spread = spread.join(F.broadcast(crowded) if many <= 50_000 else crowded, "cell", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
            spread = spread.withColumn("own", F.expr("cast(pmod(xxhash64(id), nb) as int)")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        else:
            spread = spread.withColumn("own", F.lit(0)).withColumn("o", F.lit(0))
        spread = spread.select("cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "id", "weight", "vector", "cells", F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1).alias("side"))
        found = materialize(spread.groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "id long, links long, root long"), "found")
        for t in (indexed, crowded):
            discard(t)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    discard(base)
    discard(keyed)
    out = members.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "rep", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "rep", "id"), F.lit(True)).alias("kept"),
    )


def _sample_rows(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        sizes, x = unit_rows(b.column(1))
        yield pa.record_batch([b.column(0), pa.array([r[:s].tolist() for r, s in zip(x, sizes)], pa.list_(pa.float64()))], ["id", "vector"])
