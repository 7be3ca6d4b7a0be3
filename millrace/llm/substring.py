"""Removal of word passages that a document with a smaller id holds too, by difference-cover anchors.

The cover {0, 1, 3, 8, 12, 18} modulo 31 has the property that any two residues can be shifted by one common amount
below 31 into it. Every document hashes short windows at cover positions alone (6 of 31); a passage of 50 words that
two documents share, wherever it starts in either, then contains an anchor of 20 words that both hash. Anchors that
two or more documents hold extend to all windows of 50 words around them, and these full windows decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, free_shuffles, id_filter, map_arrow, materialize, passes, passing, text_bytes, window_hashes, word_hashes

#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
COVER = (0, 1, 3, 8, 12, 18)
PERIOD = 31


def _anchor_width(window: int) -> int:
    width = window - PERIOD + 1
    if width < 8:
        raise ValueError(f"windows of at least {PERIOD + 7} words are needed")
    return width


def _anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    a = window_hashes(h, width)
    at = np.nonzero(np.isin(np.arange(len(a)) % PERIOD, COVER))[0]
    return at, a[at]


def _anchor_rows(window: int):
    width = _anchor_width(window)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, hashes = [], []
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                words = t.split() if t and i is not None else []
                if len(words) >= window:
                    a = np.unique(_anchors(word_hashes(words), width)[1])
                    hashes.append(a)
                    ids.append(np.full(len(a), i, np.int64))
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ids))], ["h", "id"])

    return run


def _windows(h: np.ndarray, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that contain an anchor at one of the positions `at`, and two hashes of each."""
    n = len(h) - window + 1
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(at - (PERIOD - 1), 0), 1)
    np.add.at(mark, np.minimum(at, n - 1) + 1, -1)
    starts = np.nonzero(np.cumsum(mark)[:n] > 0)[0]
    # hash only stretches of candidate windows
    first, second = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    cuts = np.nonzero(np.diff(starts) > 1)[0] + 1
    done = 0
    for run in np.split(starts, cuts):
        if len(run):
            part = h[run[0] : run[-1] + window]
            first[done : done + len(run)] = window_hashes(part, window)
            second[done : done + len(run)] = window_hashes(part, window, other=True)
            done += len(run)
    return starts, first, second & 0x7FFFFFFF


def _window_rows(window: int):
    width = _anchor_width(window)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i, t, shared in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2)):
                h = word_hashes(t.split())
                at, a = _anchors(h, width)
                at = at[np.isin(a, shared.values.to_numpy(zero_copy_only=False))]
                _, first, second = _windows(h, window, at)
                first, keep = np.unique(first, return_index=True)
                yield pa.record_batch([pa.array(first), pa.array(second[keep].astype(np.int32)), pa.array(np.full(len(first), i, np.int64))], ["h", "c", "id"])

    return run


def _kept(window: int, with_text: bool, shared=None):
    """Rows (text, windows to remove, others); with a filter, rows (text, id, others) whose id does not pass it lose nothing and the rest is left out."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if shared is not None:
                b = b.filter(pa.array(~passes(b.column(1), shared)))
                b = b.set_column(1, "gone", pa.nulls(b.num_rows, pa.list_(pa.int64())))
            n_words, n_removed, digests, texts = [], [], [], []
            for t, gone in zip(text_bytes(b.column(0)), b.column(1)):
                words = t.split() if t else []
                removed = 0
                out = t
                if gone.is_valid and len(gone) and len(words) >= window:
                    starts = np.nonzero(np.isin(window_hashes(word_hashes(words), window), gone.values.to_numpy(zero_copy_only=False)))[0]
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + window, -1)
                    keep = np.cumsum(mark)[: len(words)] == 0
                    removed = int(len(words) - keep.sum())
                    words = [w for w, k in zip(words, keep) if k]
                    out = b" ".join(words)
                n_words.append(len(words) + removed)
                n_removed.append(removed)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                texts.append(out)
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                made.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.record_batch([*b.columns[2:], *made], [*b.schema.names[2:], "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, gone): for every document that repeats one with a smaller id, the hashes of its repeated windows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    anchors = map_arrow(texts, _anchor_rows(window), "h long, id long")
    several = anchors.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    shared = materialize(anchors.join(several, "h").groupBy("id").agg(F.collect_set("h").alias("shared")), "anchors")
    del anchors, several
    free_shuffles(spark)
    # only texts that may hold shared anchors are shuffled
    rows = passing(texts.where("id is not null"), "id", id_filter(shared.select("id"))).join(shared, "id").select("id", "text", "shared")
    windows = materialize(map_arrow(rows, _window_rows(window), "h long, c int, id long"), "windows")
    del rows
    discard(shared)
    free_shuffles(spark)
    first = windows.groupBy("h", "c").agg(F.min("id").alias("lo"))
    out = materialize(windows.join(first, ["h", "c"]).where("id > lo").groupBy("id").agg(F.collect_set("h").alias("gone")), "gone")
    discard(windows)
    del first
    free_shuffles(spark)
    return out


def _apply(rows: DataFrame, gone: DataFrame, window: int, with_text: bool, schema) -> DataFrame:
    """_kept() over rows (_mr_text, _mr_key, others): only those that may lose words are shuffled, to meet their windows."""
    shared = id_filter(gone.select("id"))
    others = rows.columns[2:]
    some = passing(rows, "_mr_key", shared).join(gone, F.col("_mr_key") == F.col("id"), "left").select("_mr_text", "gone", *others)
    rest = rows.select("_mr_text", "_mr_key", *others)
    return map_arrow(some, _kept(window, with_text), schema).unionByName(map_arrow(rest, _kept(window, with_text, shared), schema))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """Return (id_col, n_words, n_removed, kept_sha256[, kept_text]), one row per input row.

    Words are runs of bytes other than ASCII white space, unchanged. Every word covered by a window of `window`
    consecutive words whose sequence also starts in a document with a smaller id is removed; windows are judged on
    the input. The digest is that of the kept words joined by one space (UTF-8). kept_text is the text itself where
    nothing was removed, otherwise those joined words. Null texts and texts without words have no words and stay as
    they are; documents shorter than a window lose nothing. Rows with a null id neither lose words nor make others
    lose any. Rows that repeat an id are one document: they do not remove each other. An empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    gone = repeated_windows(docs, id_col, text_col, window)
    x = docs.select(F.col(text_col).cast("string").alias("_mr_text"), F.col(id_col).cast("long").alias("_mr_key"), F.col(id_col).alias("_doc"))
    schema = f"_doc {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return _apply(x, gone, window, with_text, schema).withColumnRenamed("_doc", id_col)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, drop_used_up: bool = False) -> DataFrame:
    """docs with repeated passages cut out of text_col; all rows, columns and their order stay. Edge cases as in remove_repeats().

    With `drop_used_up`, rows that lost words and have none left go.
    """
    gone = repeated_windows(docs, id_col, text_col, window)
    names = docs.columns
    safe = docs.toDF(*[f"c{k}" for k in range(len(names))])
    doc, text = (safe[f"c{names.index(c)}"] for c in (id_col, text_col))
    x = safe.select(text.cast("string").alias("_mr_text"), doc.cast("long").alias("_mr_key"), *safe.columns)
    schema = T.StructType([*safe.schema.fields, *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept_text string").fields])
    out = _apply(x, gone, window, True, schema)
    if drop_used_up:
        out = out.where("not (n_words > 0 and n_removed = n_words)")
    return out.select(*[(F.col("kept_text") if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)])
