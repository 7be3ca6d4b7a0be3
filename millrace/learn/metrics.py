"""Metrics with parameters: aggregates over a DataFrame's columns.

Curves have one row per distinct score; the running counts come from range partitions with offsets, so no window ever
holds all rows in one task. Everything that counts classes works on the table of (true, predicted) counts, whose size
is the classes' alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.learn.base import bounded_matrix, rows_of, total, vector
from millrace.learn.cluster import first_k, sq_distances


def counts(df: DataFrame, y: str, p: str, weight: str | None = None, limit: int = 4_000_000) -> tuple[list, list, np.ndarray]:
    """(true labels, predicted labels, matrix of weights)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.sum(w).alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many pairs of classes")
    ys, ps = sorted({r["y"] for r in rows}), sorted({r["p"] for r in rows})
    m = np.zeros((len(ys), len(ps)))
    for r in rows:
        m[ys.index(r["y"]), ps.index(r["p"])] = r["n"]
    return ys, ps, m


def confusion_matrix(df, y, p, weight=None, normalize=None) -> tuple[list, np.ndarray]:
    """(labels, matrix); normalize is None, "true", "pred" or "all"."""
    ys, ps, m = counts(df, y, p, weight)
    labels = sorted({*ys, *ps})
    full = np.zeros((len(labels), len(labels)))
    full[np.ix_([labels.index(v) for v in ys], [labels.index(v) for v in ps])] = m
    if normalize:
        s = full.sum(1, keepdims=True) if normalize == "true" else full.sum(0, keepdims=True) if normalize == "pred" else full.sum()
        full = np.divide(full, s, out=np.zeros_like(full), where=s != 0)
    return labels, full


def precision_recall_fscore_support(df, y, p, beta: float = 1.0, average: str | None = None, weight=None):
    """Per class arrays (labels, precision, recall, f, support), or their micro, macro or weighted average; 0 for 0/0."""
    labels, m = confusion_matrix(df, y, p, weight)
    tp, true, pred = np.diag(m), m.sum(1), m.sum(0)
    if average == "micro":
        tp, true, pred = np.array([tp.sum()]), np.array([true.sum()]), np.array([pred.sum()])
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    pr, rc = ratio(tp, pred), ratio(tp, true)
    f = ratio((1 + beta**2) * tp, beta**2 * true + pred)
    if average is None:
        return labels, pr, rc, f, true
    w = true if average == "weighted" else np.ones(len(tp))
    mean = lambda v: float((v * w).sum() / w.sum())
    return mean(pr), mean(rc), mean(f), float(true.sum())


def fbeta_score(df, y, p, beta=1.0, average="macro", weight=None) -> float:
    return precision_recall_fscore_support(df, y, p, beta, average, weight)[2]


def jaccard_score(df, y, p, average: str | None = "macro", weight=None):
    labels, m = confusion_matrix(df, y, p, weight)
    tp, union = np.diag(m), m.sum(1) + m.sum(0) - np.diag(m)
    if average == "micro":
        return float(tp.sum() / union.sum())
    j = np.divide(tp, union, out=np.zeros_like(tp), where=union != 0)
    if average is None:
        return labels, j
    w = m.sum(1) if average == "weighted" else np.ones(len(j))
    return float((j * w).sum() / w.sum())


def matthews_corrcoef(df, y, p, weight=None) -> float:
    """Of any number of classes; 0 where a side has one class only."""
    _, m = confusion_matrix(df, y, p, weight)
    n, c, t, q = m.sum(), np.trace(m), m.sum(1), m.sum(0)
    den = math.sqrt(n * n - q @ q) * math.sqrt(n * n - t @ t)
    return float((c * n - t @ q) / den) if den else 0.0


def cohen_kappa_score(df, y, p, weights: str | None = None, weight=None) -> float:
    labels, m = confusion_matrix(df, y, p, weight)
    k = np.arange(len(labels))
    far = {None: (k[:, None] != k).astype(float), "linear": np.abs(k[:, None] - k).astype(float), "quadratic": (k[:, None] - k).astype(float) ** 2}[weights]
    expected = np.outer(m.sum(1), m.sum(0)) / m.sum()
    return float(1 - (far * m).sum() / (far * expected).sum())


def multilabel_confusion_matrix(df, y, p, weight=None) -> tuple[list, np.ndarray]:
    """(labels, 2 x 2 matrices [[tn, fp], [fn, tp]])."""
    labels, m = confusion_matrix(df, y, p, weight)
    tp, fn, fp = np.diag(m), m.sum(1) - np.diag(m), m.sum(0) - np.diag(m)
    return labels, np.stack([np.stack([m.sum() - tp - fn - fp, fp], 1), np.stack([fn, tp], 1)], 1)


def classification_report(df: DataFrame, y, p, digits: int = 2) -> str:
    """Precision, recall, f1 and support of each class, accuracy and the macro and weighted averages, as text."""
    labels, pr, rc, f, s = precision_recall_fscore_support(df, y, p)
    wide = max(12, *(len(str(v)) for v in labels))
    line = lambda n, *v: f"{n:>{wide}}" + "".join(f"{x:>10.{digits}f}" if x is not None else " " * 10 for x in v[:3]) + f"{int(v[3]):>10}"
    out = [" " * wide + "".join(f"{h:>10}" for h in ("precision", "recall", "f1-score", "support")), ""]
    out += [line(str(n), *v) for n, *v in zip(labels, pr, rc, f, s)]
    acc = float((rc * s).sum() / s.sum())
    out += ["", line("accuracy", None, None, acc, s.sum()), line("macro avg", pr.mean(), rc.mean(), f.mean(), s.sum())]
    out.append(line("weighted avg", *(float((v * s).sum() / s.sum()) for v in (pr, rc, f)), s.sum()))
    return "\n".join(out)


def pair_confusion_matrix(df, a, b) -> np.ndarray:
    """Ordered pairs of rows by whether each labelling puts them together: [[neither, b], [a, both]]."""
    _, _, m = counts(df, a, b)
    n, s = m.sum(), (m * m).sum()
    ra, rb = (m.sum(1) ** 2).sum(), (m.sum(0) ** 2).sum()
    return np.array([[n * n - ra - rb + s, rb - s], [ra - s, s - n]])


# --- curves ----------------------------------------------------------------------------------------------------------


def cumulative(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """df (one row per value of `order`) with running sums of columns in falling order, range partition by partition."""
    from millrace.learn.graph import checkpoint

    part = df.repartitionByRange(F.desc(order)).withColumn("_mr_p", F.spark_partition_id())
    w = Window.partitionBy("_mr_p").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    part = checkpoint(part.withColumns({f"cum_{c}": F.sum(c).over(w) for c in sums}))
    tops = sorted((r["_mr_p"], [r[f"t{k}"] for k in range(len(sums))]) for r in part.groupBy("_mr_p").agg(*[F.sum(c).alias(f"t{k}") for k, c in enumerate(sums)]).collect())
    base, held = {}, [0.0] * len(sums)
    for p, t in tops:
        base[p] = list(held)
        held = [a + b for a, b in zip(held, t)]
    if not base:
        return part.drop("_mr_p")
    off = [F.element_at(F.create_map(*[F.lit(v) for p in base for v in (p, base[p][k])]), F.col("_mr_p")) for k in range(len(sums))]
    return part.withColumns({f"cum_{c}": F.col(f"cum_{c}") + o for c, o in zip(sums, off)}).drop("_mr_p")


def thresholds(df: DataFrame, y: str, score: str, weight: str | None = None) -> tuple[DataFrame, float, float]:
    """((threshold, tps, fps) per distinct score, positives, negatives)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = df.select(F.col(score).cast("double").alias("threshold"), (F.col(y).cast("double") * w).alias("pos"), ((1 - F.col(y).cast("double")) * w).alias("neg"))
    x = x.groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = cumulative(x, "threshold", ["pos", "neg"])
    t = c.agg(F.max("cum_pos").alias("p"), F.max("cum_neg").alias("n")).first()
    return c.select("threshold", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"), "pos", "neg"), t["p"] or 0.0, t["n"] or 0.0


def roc_curve(df, y, score, weight=None) -> DataFrame:
    """(threshold, fpr, tpr), with the point (0, 0) at an infinite threshold."""
    c, p, n = thresholds(df, y, score, weight)
    out = c.select("threshold", (F.col("fps") / F.lit(n or 1.0)).alias("fpr"), (F.col("tps") / F.lit(p or 1.0)).alias("tpr"))
    return df.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)], "threshold double, fpr double, tpr double").unionByName(out)


def precision_recall_curve(df, y, score, weight=None) -> DataFrame:
    """(threshold, precision, recall), with the point (1, 0) at an infinite threshold."""
    c, p, _ = thresholds(df, y, score, weight)
    out = c.select("threshold", (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"), (F.col("tps") / F.lit(p or 1.0)).alias("recall"))
    return df.sparkSession.createDataFrame([(math.inf, 1.0, 0.0)], "threshold double, precision double, recall double").unionByName(out)


def det_curve(df, y, score, weight=None) -> DataFrame:
    """(threshold, fpr, fnr)"""
    c, p, n = thresholds(df, y, score, weight)
    return c.select("threshold", (F.col("fps") / F.lit(n or 1.0)).alias("fpr"), (1 - F.col("tps") / F.lit(p or 1.0)).alias("fnr"))


def average_precision_score(df, y, score, weight=None) -> float:
    """Sum of precision times the recall gained, over distinct scores."""
    c, p, _ = thresholds(df, y, score, weight)
    return (c.agg(F.sum(F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps")))).first()[0] or 0.0) / p if p else 0.0


def roc_auc_score(df, y, score, weight=None, max_fpr: float | None = None) -> float:
    """Area under the ROC curve by trapezoids; with max_fpr the standardised partial area."""
    c, p, n = thresholds(df, y, score, weight)
    if not p or not n:
        return math.nan
    if max_fpr is None:
        return (c.agg(F.sum(F.col("neg") * (F.col("tps") - F.col("pos") / 2))).first()[0]) / (p * n)
    lo, hi = (F.col("fps") - F.col("neg")) / n, F.col("fps") / n
    m = F.lit(float(max_fpr))
    left, right = (F.col("tps") - F.col("pos")) / p, F.col("tps") / p
    end = F.least(hi, m)
    height = F.when(hi > lo, left + (right - left) * (end - lo) / (hi - lo)).otherwise(right)
    area = c.where(lo < m).agg(F.sum((end - lo) * (left + height) / 2)).first()[0] or 0.0
    low = max_fpr**2 / 2
    return 0.5 * (1 + (area - low) / (max_fpr - low))


def roc_auc_multiclass(df: DataFrame, y: str, proba: str, classes: list, multi_class: str = "ovr", average: str = "macro") -> float:
    """One against the rest, or the mean over pairs of classes, of arrays of class probabilities."""
    n = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    out, w = [], []
    if multi_class == "ovr":
        for k, c in enumerate(classes):
            out.append(roc_auc_score(df.select((F.col(y) == F.lit(c)).cast("int").alias("t"), F.col(proba)[k].alias("s")), "t", "s"))
            w.append(n.get(c, 0))
    else:
        for a in range(len(classes)):
            for b in range(a + 1, len(classes)):
                own = df.where(F.col(y).isin([classes[a], classes[b]]))
                each = [roc_auc_score(own.select((F.col(y) == F.lit(classes[k])).cast("int").alias("t"), F.col(proba)[k].alias("s")), "t", "s") for k in (a, b)]
                out.append(sum(each) / 2)
                w.append(n.get(classes[a], 0) + n.get(classes[b], 0))
    return float(np.average(out, weights=w if average == "weighted" else None))


def auc(df: DataFrame, x: str, y: str) -> float:
    """Area under (x, y) by trapezoids in the order of x: each range partition's own, and the steps between them."""
    from millrace.learn.graph import checkpoint

    part = checkpoint(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).repartitionByRange("x").withColumn("p", F.spark_partition_id()))
    w = Window.partitionBy("p").orderBy("x", "y")
    step = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    r = part.withColumn("a", step).groupBy("p").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.min(F.struct("x", "y")).alias("lo"), F.max(F.struct("x", "y")).alias("hi")).orderBy("p").collect()
    return sum(v["a"] for v in r) + sum((b["lo"]["x"] - a["hi"]["x"]) * (b["lo"]["y"] + a["hi"]["y"]) / 2 for a, b in zip(r, r[1:]))


def top_k_accuracy_score(df: DataFrame, y: str, scores: str, classes: list, k: int = 2) -> float:
    """Share of rows whose label is among the k highest scores; of equal scores the later class ranks higher."""
    s = F.col(scores).cast("array<double>")
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)).cast("int") - 1
    own = s[at]
    above = F.size(F.filter(s, lambda v, i: (v > own) | ((v == own) & (i > at))))
    return df.agg(F.avg((above < k).cast("double"))).first()[0]


# --- rankings in rows ------------------------------------------------------------------------------------------------


def _rank(v, s):
    """How many labels score at least as high."""
    return F.size(F.filter(s, lambda u: u >= v))


def coverage_error(df: DataFrame, truth: str, scores: str) -> float:
    """How far down the ranking all true labels go, on average; 0 for a row without any."""
    t, s = F.col(truth).cast("array<int>"), F.col(scores).cast("array<double>")
    low = F.array_min(F.filter(F.zip_with(t, s, lambda a, b: F.when(a == 1, b)), lambda v: v.isNotNull()))
    return df.agg(F.avg(F.when(low.isNull(), 0).otherwise(_rank(low, s)).cast("double"))).first()[0]


def label_ranking_average_precision_score(df: DataFrame, truth: str, scores: str) -> float:
    """Mean share of true labels among those ranked at least as high as each true label; 1 for rows without contrast."""
    t, s = F.col(truth).cast("array<int>"), F.col(scores).cast("array<double>")
    own = F.filter(F.zip_with(t, s, lambda a, b: F.when(a == 1, b)), lambda v: v.isNotNull())
    each = F.transform(own, lambda v: F.size(F.filter(own, lambda u: u >= v)) / _rank(v, s))
    n = F.size(own)
    return df.agg(F.avg(F.when((n == 0) | (n == F.size(t)), 1.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / n))).first()[0]


def label_ranking_loss(df: DataFrame, truth: str, scores: str) -> float:
    """Mean share of (true, false) label pairs in the wrong order, ties included; 0 for rows without contrast."""
    t, s = F.col(truth).cast("array<int>"), F.col(scores).cast("array<double>")
    yes = F.filter(F.zip_with(t, s, lambda a, b: F.when(a == 1, b)), lambda v: v.isNotNull())
    no = F.filter(F.zip_with(t, s, lambda a, b: F.when(a != 1, b)), lambda v: v.isNotNull())
    bad = F.aggregate(yes, F.lit(0), lambda a, v: a + F.size(F.filter(no, lambda u: u >= v)))
    pairs = F.size(yes) * F.size(no)
    return df.agg(F.avg(F.when(pairs == 0, 0.0).otherwise(bad / pairs))).first()[0]


def dcg_column(gains: str, scores: str, k: int | None = None, ties: str = "average"):
    """Discounted gain of a row's array; tied scores share the mean of their discounts, or rank by position."""
    def run(g: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(g.to_pylist(), s.to_pylist()):
            a, b = np.asarray(a or [], float), np.asarray(b or [], float)
            d = 1 / np.log2(np.arange(len(a)) + 2)
            if k is not None:
                d[k:] = 0
            if ties == "average":
                _, inv = np.unique(-b, return_inverse=True)
                size = np.bincount(inv)
                c = np.append(0, np.cumsum(d))
                ends = np.cumsum(size)
                share = (c[ends] - c[ends - size]) / size
                out.append(float((a * share[inv]).sum()))
            else:
                out.append(float((a[np.argsort(-b, kind="stable")] * d).sum()))
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(F.col(gains).cast("array<double>"), F.col(scores).cast("array<double>"))


def ndcg_column(gains: str, scores: str, k: int | None = None, ties: str = "average"):
    best = dcg_column(gains, gains, k, "ignore")
    return F.when(best > 0, dcg_column(gains, scores, k, ties) / best).otherwise(0.0)


# --- clusterings ------------------------------------------------------------------------------------------------------


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mean mutual information of two labellings with these class sizes, over random pairings."""
    n = int(a.sum())
    lg = np.array([math.lgamma(k + 1) for k in range(n + 1)]) if n <= 2_000_000 else None
    if lg is None:
        raise ValueError("more than 2,000,000 rows")
    out = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            if len(k):
                p = np.exp(lg[x] + lg[y] + lg[n - x] + lg[n - y] - lg[n] - lg[k] - lg[x - k] - lg[y - k] - lg[n - x - y + k])
                out += float((k / n * np.log(n * k / (x * y)) * p).sum())
    return out


def _entropy(s: np.ndarray) -> float:
    p = s[s > 0] / s.sum()
    return float(-(p * np.log(p)).sum())


def mutual_info(m: np.ndarray) -> float:
    n = m.sum()
    i, j = np.nonzero(m)
    v = m[i, j]
    return float((v / n * (np.log(v) + math.log(n) - np.log(m.sum(1)[i]) - np.log(m.sum(0)[j]))).sum())


def adjusted_mutual_info_score(df: DataFrame, a: str, b: str, average: str = "arithmetic") -> float:
    _, _, m = counts(df, a, b)
    ra, rb = m.sum(1), m.sum(0)
    if len(ra) == len(rb) == 1 or (len(ra) == len(rb) == int(m.sum())):
        return 1.0
    h = [_entropy(ra), _entropy(rb)]
    mean = {"arithmetic": sum(h) / 2, "geometric": math.sqrt(h[0] * h[1]), "min": min(h), "max": max(h)}[average]
    mi, emi = mutual_info(m), expected_mutual_information(ra, rb)
    eps, den = np.finfo(float).eps, mean - emi
    den = min(den, -eps) if den < 0 else max(den, eps)
    return float((mi - emi) / den)


def silhouette_samples(df: DataFrame, features, label: str, id_col: str, block: int = 2_000) -> DataFrame:
    """(id, silhouette): mean distances to all clusters, for blocks of rows against all rows; 0 in clusters of one."""
    from millrace.learn.base import matrix
    from millrace.learn.base import classes_of, coded

    classes = classes_of(df, label)
    k = len(classes)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector(features).alias("x"), coded(label, classes).alias("c"))
    n = total(rows.select("x", "c"), lambda x, c: {"n": np.bincount(c.astype(int), minlength=k).astype(float)})["n"]
    blocks, out = max(1, -(-rows.count() // block)), None
    for b in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not held.num_rows:
            continue
        z, own = matrix(held["x"]), held["c"].to_numpy().astype(int)

        def fn(x, c, z=z):
            d = np.sqrt(sq_distances(z, x))
            hot = np.zeros((len(x), k))
            hot[np.arange(len(x)), c.astype(int)] = 1
            return {"s": d @ hot}

        s = total(rows.select("x", "c"), fn)["s"]
        at = np.arange(len(z))
        inside = s[at, own] / np.maximum(n[own] - 1, 1)
        mean = s / n
        mean[at, own] = np.inf
        other = mean.min(1)
        v = np.where(n[own] > 1, (other - inside) / np.maximum(np.maximum(other, inside), 1e-300), 0.0)
        part = df.sparkSession.createDataFrame([(int(i), float(q)) for i, q in zip(held["id"].to_pylist(), v)], "id long, silhouette double")
        out = part if out is None else out.unionByName(part)
    return out


def silhouette_score(df, features, label, id_col) -> float:
    return silhouette_samples(df, features, label, id_col).agg(F.avg("silhouette")).first()[0]


def davies_bouldin_score(df: DataFrame, features, label: str) -> float:
    """Mean over clusters of the worst ratio of spreads to the distance of centres; two passes."""
    from millrace.learn.base import classes_of, coded

    classes = classes_of(df, label)
    k = len(classes)
    rows = rows_of(df, features, None, None, c=coded(label, classes))

    def hot(c, n):
        h = np.zeros((n, k))
        h[np.arange(n), c.astype(int)] = 1
        return h

    s = total(rows, lambda x, c: {"n": hot(c, len(x)).sum(0), "s": hot(c, len(x)).T @ x})
    m = s["s"] / s["n"][:, None]
    spread = total(rows, lambda x, c: {"d": hot(c, len(x)).T @ np.sqrt(((x - m[c.astype(int)]) ** 2).sum(1))})["d"] / s["n"]
    d = np.sqrt(sq_distances(m, m))
    np.fill_diagonal(d, np.inf)
    r = (spread[:, None] + spread) / np.where(d == 0, np.inf, d)
    return float(r.max(1).mean())


def calinski_harabasz_score(df: DataFrame, features, label: str) -> float:
    from millrace.learn.base import classes_of, coded

    classes = classes_of(df, label)
    k = len(classes)

    def fn(x, c):
        h = np.zeros((len(x), k))
        h[np.arange(len(x)), c.astype(int)] = 1
        return {"n": h.sum(0), "s": h.T @ x, "q": np.array((x * x).sum())}

    s = total(rows_of(df, features, None, None, c=coded(label, classes)), fn)
    n, mean = s["n"].sum(), s["s"].sum(0) / s["n"].sum()
    m = s["s"] / s["n"][:, None]
    between = float((s["n"][:, None] * (m - mean) ** 2).sum())
    within = float(s["q"]) - float((s["n"][:, None] * m * m).sum())
    return between * (n - k) / (within * (k - 1)) if within > 0 else 1.0


def trustworthiness(df: DataFrame, features, embedding, id_col: str, n_neighbors: int = 5, limit: int | None = None) -> float:
    """How far neighbours in the embedding are neighbours in the features, by ranks. Every task gets all rows and
    compares blocks of 256 with them; more than `limit`, if given, are refused."""
    x, ids = bounded_matrix(df, features, id_col, limit=limit, order=id_col)
    y, _ = bounded_matrix(df, embedding, id_col, limit=limit, order=id_col)
    n, k, block = len(x), n_neighbors, 256
    if k >= n / 2:
        raise ValueError("n_neighbors must be below half the rows")
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((x, y))

    def beyond(batches):
        """By how many ranks the embedding's neighbours of a block's rows are too far in the features."""
        x, y = held.value
        for b in batches:
            for at in b.column(0).to_pylist():
                own = np.arange(at, min(n, at + block))
                dx, dy = np.round(sq_distances(x[own], x), 12), np.round(sq_distances(y[own], y), 12)
                dx[np.arange(len(own)), own] = dy[np.arange(len(own)), own] = np.inf
                t = 0
                for near in first_k(dy, k).T:
                    d = dx[np.arange(len(own)), near][:, None]
                    rank = 1 + (dx < d).sum(1) + ((dx == d) & (np.arange(n) < near[:, None])).sum(1)
                    t += int(np.maximum(rank - k, 0).sum())
                yield pa.record_batch([pa.array([t], pa.int64())], ["t"])

    blocks = spark.range(0, n, block, max(1, min(256, -(-n // block))))
    t = blocks.mapInArrow(beyond, "t long").agg(F.sum("t")).first()[0]
    held.destroy()
    return float(1 - t * 2 / (n * k * (2 * n - 3 * k - 1)))


def histogram(df: DataFrame, column: str, bins: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, low, high, n) of equal bins over the range, the last one closed; bins without rows are there with 0."""
    x = F.col(column).cast("double")
    if low is None or high is None:
        r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
        low, high = r["a"] if low is None else low, r["b"] if high is None else high
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = np.linspace(low, high, bins + 1).tolist()
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + (x >= F.lit(e)).cast("int")
    got = df.where((x >= F.lit(low)) & (x <= F.lit(high))).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(bins)], "bin int, low double, high double")
    return every.join(F.broadcast(got), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def group_sums(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts and sums by a composite key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(v).cast("double")).alias(f"sum_{v}") for v in values])
