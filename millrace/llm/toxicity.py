"""Toxicity scores of texts after noisy-channel deobfuscation.

Every token that looks tampered with (symbols or digits among letters, letters drawn out, letters spelled one by
one) becomes a lattice of possible letters; Viterbi decoding under a character trigram model of the whole corpus,
with costs for each substitution, deletion and repetition, restores the likeliest word. The score is then a
noisy-or over the restored text's words and word beginnings, whose probabilities of toxicity come from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_arrow, text_bytes

CLASSES = 28  # 0: no letter, 1 to 26: a to z, 27: any other letter
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27

#: Letters that a sign can stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
DROPPED = ".,-_~^'`\"*:;/\\#%&=<>[]{})?"
SIGN_COST, DROP_COST, SIGN_DROP_COST, WILD_COST, HALVE_COST = 0.7, 0.4, 12.0, 1.5, 6.0
EDGES = ".,;:!?\"'`()[]{}<>*&%#=/\\~^_-…«»“”‘’¿"
DOUBLED = re.compile(r"([^\W\d_])\1")
#: What a word break costs within a spelled run, beyond what the letter model says of word ends and beginnings.
BREAK_COST = 1.0
SPELLED = re.compile(r"(?<!\S)(?:[^\W_] ){3,}[^\W_](?!\w)|(?<!\S)(?:[^\W_][.\-_*]){3,}[^\W_](?!\w)")


class CharModel:
    """Log probabilities of a letter class after two others, interpolated from trigram counts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + CLASSES)
        p2 = (c2 + 20 * p1) / (c2.sum(-1, keepdims=True) + 20)
        p3 = (c3 + 10 * p2[None]) / (c3.sum(-1, keepdims=True) + 10)
        self.logp = np.log(p3).tolist()


def trigram_counts(data: bytes) -> np.ndarray:
    c = np.concatenate([[0, 0], _CLASS[np.frombuffer(data, np.uint8)], [0]])
    before = np.where(c[1:-1] == 0, 0, c[:-2])
    return np.bincount((before * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


def _code(letter: str) -> int:
    k = ord(letter) - 96
    return k if 1 <= k <= 26 else 27


def restore(token: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest word behind a token, by Viterbi decoding of its lattice; the state is the last two letters.

    With `breaks` it may be several words, joined by spaces. Paths share their beginnings, so a token of any length
    takes time and memory in proportion to it.
    """
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token)]
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for sign, times in runs:
        if sign.isalpha() and sign not in SIGNS:
            options = [(sign, 0.0)] if times == 1 else [(sign * 2, 0.0), (sign, HALVE_COST)] if times == 2 else [(sign, 0.0), (sign * 2, 0.5)]
        else:
            options = [(x * n, SIGN_COST * min(times, 2)) for x in SIGNS.get(sign, "") for n in {1, min(times, 2)}]
            options.append(("", SIGN_DROP_COST if options or sign == "*" else DROP_COST))
            if sign == "*":
                options += [(chr(97 + k), WILD_COST) for k in range(26)]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (u, v), (score, out) in paths.items():
            for letters, cost in options:
                a, b, s = u, v, score - cost
                for x in letters:
                    k = _code(x)
                    s += model.logp[a][b][k]
                    a, b = b, k
                if (a, b) not in new or s > new[a, b][0]:
                    new[a, b] = (s, (out, letters) if letters else out)
        if breaks:
            s, out = max(((s + model.logp[a][b][0] - BREAK_COST, out) for (a, b), (s, out) in new.items() if b), default=(0.0, None), key=lambda p: p[0])
            if out and ((0, 0) not in new or s > new[0, 0][0]):
                new[0, 0] = (s, (out, " "))
        paths = new
    out, found = max(((s + (model.logp[a][b][0] if b or not breaks else 0.0), out) for (a, b), (s, out) in paths.items()), default=(0.0, None), key=lambda p: p[0])[1], []
    while out:
        out, letters = out
        found.append(letters)
    return "".join(reversed(found)).strip(" ")


class Restorer:
    """Words of a text: plain ones as they are, tampered ones restored (both forms count)."""

    def __init__(self, counts: np.ndarray, remembered: int = 40):
        self.model, self.remembered, self.known = CharModel(counts), remembered, {}

    def word(self, token: str) -> str:
        if len(token) > self.remembered:
            return restore(token, self.model)
        if token not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[token] = restore(token, self.model)
        return self.known[token]

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out = set()
        for t in set(low.split()):
            s = t.strip(EDGES)
            if s.isalpha():
                out.add(s)
                if DOUBLED.search(s):
                    out.add(self.word(s))
            elif s:
                out.update(re.findall(r"[^\W\d_]{2,}", s))
                if any(c.isalpha() for c in t):
                    out.add(self.word(s))
                    if s != t and (t[0] in SIGNS or t[-1] in SIGNS):
                        out.add(self.word(t.strip(".,;:?\"'")))
        for m in SPELLED.finditer(low):
            run = re.sub(r"[ .\-_*]", "", m[0])
            out.add(self.word(run))
            out.update(restore(run, self.model, breaks=True).split())
        return out

    def features(self, text: str) -> set[str]:
        words = self.words(text)
        return words | {w[:4] + "~" for w in words if len(w) > 4} | {w[:5] + "~" for w in words if len(w) > 5}


def _counts(batches: Iterator[pa.RecordBatch]):
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        total += trigram_counts(b"\n".join(t for t in text_bytes(b.column(0)) if t))
    at = np.nonzero(total)[0]
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["cell", "times"])


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Letter trigram counts of all texts: 28**3 cells, whatever the input's size."""
    rows = map_arrow(docs.select(F.col(text_col).cast("string")), _counts, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).collect()
    out = np.zeros(CLASSES**3, np.int64)
    for r in rows:
        out[r["cell"]] = r["times"]
    return out


def _feature_rows(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        restorer, one, zero = Restorer(counts), Counter(), Counter()
        for b in batches:
            for t, y in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
                (one if y else zero).update(restorer.features(t.decode("utf-8", "replace") if t else ""))
        names = sorted(one.keys() | zero.keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([one[n] for n in names], pa.int64()), pa.array([zero[n] for n in names], pa.int64())], ["feature", "toxic", "clean"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, features: int = 20_000, least: int = 3, sure: float = 0.85) -> dict:
    """A model from labelled documents.

    The letter trigrams cover all texts. The labelled rows are the `sample` ones with the smallest hash of their id
    (documented bound of the classifier's training set); at most `features` features are kept, those that occur in
    `least` toxic ones and whose smoothed share of toxic ones is `sure` or more. labels may hold nulls (ignored) and repeated ids (toxic if any row is).
    """
    counts = char_counts(docs, text_col)
    known = labels.select(F.col(id_col).alias("_mr_id"), F.col(label_col).cast("int").alias("_mr_y")).where("_mr_id is not null and _mr_y is not null").groupBy("_mr_id").agg(F.max("_mr_y").alias("_mr_y"))
    drawn = known.orderBy(F.xxhash64("_mr_id"), "_mr_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_mr_doc"), F.col(text_col).cast("string").alias("_mr_text")).join(F.broadcast(drawn), F.col("_mr_doc") == F.col("_mr_id")).select("_mr_text", "_mr_y")
    held = map_arrow(rows, _feature_rows(counts), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = drawn.agg(F.count(F.lit(1)).alias("n"), F.sum("_mr_y").alias("y")).first()
    prior = ((totals["y"] or 0) + 1) / (totals["n"] + 10)
    # pseudo-documents in proportion to the toxic ones, so that evidence weighs alike at every size
    weight = 1 + 0.004 * (totals["y"] or 0)
    held = held.where(F.col("toxic") >= least).withColumn("p", (F.col("toxic") + weight * prior) / (F.col("toxic") + F.col("clean") + weight)).where(F.col("p") >= sure)
    best = held.orderBy(F.desc(F.col("toxic") * F.col("p") * F.col("p")), "feature").limit(features).select("feature", "p").collect()
    return {"counts": counts, "prior": prior, "p": {r["feature"]: r["p"] for r in best}}


def score_text(text: str, restorer: Restorer, p: dict[str, float], prior: float) -> float:
    """Noisy-or of the five strongest features, from 0 to 1; a text without any gets a quarter of the prior."""
    hits = sorted((p[f] for f in restorer.features(text) & p.keys()), reverse=True)[:5]
    return 1 - (1 - prior / 4) * math.prod(1 - x for x in hits)


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]):
        restorer = Restorer(model["counts"])
        for b in batches:
            scores = [score_text(t.decode("utf-8", "replace") if t else "", restorer, model["p"], model["prior"]) for t in text_bytes(b.column(0))]
            yield pa.record_batch([*b.columns[1:], pa.array(scores, pa.float64())], [*b.schema.names[1:], "_mr_score"])

    return run


def score_documents(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with two more columns, score (double from 0 to 1) and predicted (1 from 0.5 up, else 0).

    Null and empty texts have the score of a text without signs of toxicity. All rows and columns stay; columns
    named score or predicted are replaced. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    x = docs.select(F.col(text_col).cast("string").alias("_mr_text"), *keep)
    out = map_arrow(x, _score(model), T.StructType([*x.schema.fields[1:], T.StructField("_mr_score", T.DoubleType())]))
    return out.withColumnRenamed("_mr_score", "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that the model fitted on docs and labels rejects; columns unchanged."""
    names = docs.columns
    safe = docs.toDF(*[f"c{k}" for k in range(len(names))])
    out = score_documents(safe, fit(docs, labels, id_col, text_col), f"c{names.index(text_col)}").where("predicted = 0")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
