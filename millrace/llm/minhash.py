"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document keeps the k smallest hashes of its distinct word shingles. The inverted lists of these retained
values generate overlaps, the estimate over the union's own bottom-k sketch filters, and exact Jaccard similarity
of the full shingle sets decides.

How candidates stay few without losing links. In a pair with Jaccard similarity of 0.75 each of the 64 smallest
values of the union is shared with probability 0.75, so fewer than 30 shared ones have a probability below 1e-6.
Hence both documents share 30 retained values, and the first of them in any common order is among the first
(shared values - 29) of either. The order is by rarity: a passage that very many documents hold ranks last and makes
no list, unless nearly half of a document consists of such passages. Lists are first joined to their smallest
document alone (linear); documents that this leaves in different components meet in pairs if their list is short and
in blocks of sketches if it is long, so groups of copies of any size are never expanded into all pairs. This second
step looks at the documents of such lists alone and with sketches of 1,024 values, 690 of them shared: a passage
now has to be two thirds of a document before it can bring candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, discard, free_shuffles, map_arrow, materialize, text_bytes, window_hashes, word_hashes

SKETCH = 64
MIN_SHARED = 30
#: The larger sketch of documents that short ones leave undecided.
LARGE = 1024
LARGE_SHARED = 690
SHORT_LIST = 32
BLOCK = 512


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; the whole sequence is one if it has fewer words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))))


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            sizes, keys, sketches = [], [], []
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                s = shingle_set(t, width)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) and i is not None else None)
                sketches.append(s[:SKETCH])
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["id", "n", "key", "sketch"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]):
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.int64))
        for b in batches:
            good = []
            for x, y in zip(text_bytes(b.column(2)), text_bytes(b.column(3))):
                if x != last[0]:
                    last = (x, shingle_set(x, width))
                s, t = last[1], shingle_set(y, width)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def estimate_shared(a, b):
    """Column: how many of the union's bottom-k values both sketches hold."""
    return F.size(F.array_intersect(F.array_intersect(a, b), F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)))


def _needed(n, least: int = MIN_SHARED):
    return F.least(F.lit(least), F.ceil(n * F.lit(0.75))).cast("int")


def _large_sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            sets = [shingle_set(t, width) for t in text_bytes(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:LARGE] for s in sets], pa.list_(pa.int64()))], ["id", "n", "sketch"])

    return run


def _prefixes(sketches: DataFrame, least: int) -> DataFrame:
    """(v, id): of each sketch's values that others hold too, the rarest that a pair with enough shared ones must meet in."""
    values = sketches.select("id", _needed(F.col("n"), least).alias("need"), F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(counts, "v").groupBy("id", "need").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    return shared.where("size(vs) >= need").select("id", F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.col("need") + 1)).alias("x")).select("id", F.col("x.v").alias("v"))


def spanning_edges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of edges (a, b) that join all that the edges join, one fewer than each component has nodes."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root.setdefault(up, up)
        return k

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(k)
    return np.array(out, np.int64)


def _blocks(percent: int):
    """Cross-component pairs of one list's block pair that pass the sketch estimate."""

    def run(table: pa.Table) -> pa.Table:
        ids, comps = table["id"].to_numpy(), table["comp"].to_numpy()
        side, n = table["side"].to_numpy(), table["n"].to_numpy()
        sk = table["sketch"].to_pylist()
        left, right = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
        flat, rows = np.concatenate([np.asarray(s, np.int64) for s in sk]), np.repeat(np.arange(len(sk)), [len(s) for s in sk])
        values, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = times[code] > 1
        rows, code = rows[keep], (np.cumsum(times > 1) - 1)[code[keep]]
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [at, at + 4096])
            hit = np.zeros((len(sk), 4096), np.float32)
            hit[rows[lo:hi], code[lo:hi] - at] = 1
            shared += hit[left] @ hit[right].T
        need = np.minimum(LARGE_SHARED, np.ceil(n * 0.75))
        ok = 100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :])
        ok &= (shared >= np.maximum(need[left][:, None], need[right][None, :])) & (comps[left][:, None] != comps[right][None, :])
        if (side == 2).any():
            ok &= ids[left][:, None] < ids[right][None, :]
        # sketches of smaller documents are their whole sets: there the comparison is exact and a spanning forest enough
        whole = (n[left] < LARGE)[:, None] & (n[right] < LARGE)[None, :]
        union = n[left][:, None] + n[right][None, :] - shared
        exact = ok & whole & (100 * shared >= percent * union)
        i, j = np.nonzero(ok & ~whole)
        x, y = [ids[left[i]]], [ids[right[j]]]
        i, j = np.nonzero(exact)
        forest = spanning_edges(left[i], right[j])
        x.append(ids[left[i[forest]]])
        y.append(ids[right[j[forest]]])
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Return (id_col, n_shingles, component_id, kept), one row per input row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
    shingles of `width` words, the whole sequence if it has fewer. Documents are linked if the intersection has at
    least `percent` hundredths of the union's size; component_id is the smallest id reachable, kept tells whether it
    is the row's own. Null or empty texts and texts without words have an empty set and link with nothing. Rows with
    a null id link with nothing, have a null component and are kept. Rows that repeat an id share its result; an
    empty table gives an empty result; other columns, whatever their names, are ignored.
    `percent` below 75 would need a larger sketch and is refused.
    """
    if percent < 75:
        raise ValueError("sketches of this size find similarities from 0.75 up")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prof = materialize(map_arrow(texts, _profile(width), "id long, n long, key binary, sketch array<long>"), "sketches")
    # equal sets are one class, which its smallest id stands for
    classes = prof.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"))
    members = materialize(prof.select("id", "n", "key").join(classes, "key", "left").select("id", "n", "rep"), "members")
    reps = members.where("id = rep").select("id").distinct()
    sk = prof.where("key is not null").join(reps, "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "sketch")
    keys = materialize(_prefixes(sk, MIN_SHARED), "keys")
    live = materialize(sk.join(keys.select("id").distinct(), "id", "left_semi"), "live")
    discard(prof)
    free_shuffles(spark)

    def links(pairs: DataFrame) -> DataFrame:
        x = pairs.join(live.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a").join(live.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
        x = x.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate_shared(F.col("sa"), F.col("sb")) >= F.greatest(_needed(F.col("na")), _needed(F.col("nb"))))).select("a", "b")
        few = materialize(x, "pairs")
        ends = few.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        some = materialize(texts.join(ends, "id", "left_semi").dropDuplicates(["id"]), "texts")
        x = few.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        out = materialize(map_arrow(x, _confirm(width, percent), "a long, b long"), "links")
        discard(few)
        discard(some)
        free_shuffles(spark)
        return out

    lists = keys.groupBy("v").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = links(keys.join(lists, "v").select("a", F.col("id").alias("b")).where("a <> b").distinct())
    comps = materialize(connected_components(star), "components")
    # what the stars left apart: documents of lists that still hold several components, now with larger sketches
    tagged = keys.join(comps, "id", "left").select("v", "id", F.coalesce("component_id", "id").alias("comp"))
    open_lists = tagged.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("size > 2 and lo <> hi").select("v")
    undecided = tagged.join(open_lists, "v", "left_semi").select("id", "comp").distinct()
    held = texts.join(undecided, "id", "left_semi").dropDuplicates(["id"])
    large = materialize(map_arrow(held, _large_sketch(width), "id long, n long, sketch array<long>").join(undecided, "id"), "large")
    del tagged, open_lists, undecided, held
    free_shuffles(spark)
    tagged = materialize(_prefixes(large, LARGE_SHARED).join(large.select("id", "comp"), "id"), "tagged")
    open_lists = tagged.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("size > 1 and lo <> hi").select("v", "size")
    rest = materialize(tagged.join(open_lists, "v"), "rest")
    x = rest.where(F.col("size") <= SHORT_LIST)
    pairs = x.select("v", F.col("id").alias("a"), F.col("comp").alias("ca")).join(x.select("v", F.col("id").alias("b"), F.col("comp").alias("cb")), "v").where("a < b and ca <> cb").select("a", "b").distinct()
    long = rest.where(F.col("size") > SHORT_LIST).withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(id), nb) as int)"))
    long = long.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("v", "id", "comp", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1).alias("side"))
    blocks = long.join(large.select("id", "n", "sketch"), "id").groupBy("v", "i", "j").applyInArrow(_blocks(percent), "a long, b long")
    more = links(pairs.unionByName(blocks).distinct())
    final = connected_components(star.unionByName(more)) if not more.isEmpty() else comps
    out = members.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component_id", "rep", "id").alias("component_id"))
    for t in (keys, live, large, tagged, rest):
        discard(t)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose document is not its component's smallest id; columns unchanged.

    Edge cases as in near_duplicates(); a document whose id repeats keeps all its rows.
    """
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone_id"))
    return docs.join(gone, F.col(id_col) == F.col("_gone_id"), "left_anti")
