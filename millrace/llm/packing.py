"""Order-preserving packing of token streams into windows of bounded length.

The documents of a partition, in their order, form one stream of tokens. Dynamic programming chooses where windows
end: at documents' ends for nothing, at sentence ends for a small penalty, anywhere else (where no such end is near)
for a larger one. The cost of a window is its padding plus its end's penalty; the cheapest predecessor within the
window length comes from a monotone queue, so the work is linear. Windows whose length is a power of two need no
padding, but a shorter window has a penalty too. The stream is handled in stretches of bounded size; the last window of a stretch begins the next one.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, text_bytes

WINDOW = 2048
DOCUMENT_END, SENTENCE_END, CUT, SHORT = 0, 4, 24, 24
#: Shorter windows that may be chosen for their lack of padding, beside the last ones of a partition.
POWERS = (256, 512, 1024)
STRETCH = 1 << 19


@lru_cache(2)
def tokenizer(path: str, ranks: str | None):
    """(encode, ends): texts to id arrays, and which ids end a sentence.

    A rank file of the same vocabulary is a faster way to the same ids; texts that may hold a special token's string
    take the tokenizer file itself.
    """
    from tokenizers import Tokenizer

    if ranks is None:
        exact = Tokenizer.from_file(path)
        ends = np.zeros(exact.get_vocab_size(), bool)
        for piece, k in exact.get_vocab().items():
            ends[k] = piece[-1:] in ".!?" or "Ċ" in piece
        return lambda text: np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32), ends
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ends = np.zeros(max([*table.values(), *special.values()]) + 1, bool)
    for piece, k in table.items():
        ends[k] = piece[-1:] in b".!?" or b"\n" in piece
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    whole: list[Tokenizer] = []  # loaded for the first text that needs it

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            if not whole:
                whole.append(Tokenizer.from_file(path))
            return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_ordinary(text), np.uint32)

    return encode, ends


def _is_power(n: int) -> bool:
    return n & (n - 1) == 0


def choose_cuts(n: int, places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the cheapest windows over n tokens, the last being n. places: where windows may end for less than CUT, ascending, with their penalties; hard cuts fill gaps."""
    at = [0]
    cost_of = [0]
    for p, c in zip(places.tolist(), penalties.tolist()):
        while p - at[-1] > window:
            at.append(at[-1] + window)
            cost_of.append(CUT)
        if p > at[-1] and p < n:
            at.append(p)
            cost_of.append(c)
    while n - at[-1] > window:
        at.append(at[-1] + window)
        cost_of.append(CUT)
    at.append(n)
    cost_of.append(0)
    where = {p: k for k, p in enumerate(at)}
    powers = [w for w in POWERS if w < window]
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # indices with ascending best[i] + at[i]
    for j in range(1, len(at)):
        p = at[j]
        while p - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        cost, source = best[i] + window - (p - at[i]), i
        for w in powers:
            k = where.get(p - w)
            if k is not None and best[k] + SHORT < cost:
                cost, source = best[k] + SHORT, k
        best[j], came[j] = cost + cost_of[j], source
        key = best[j] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = came[j]
    return out[::-1]


class Packer:
    """Turns a stream of documents into pieces; pieces() hands out what is settled."""

    def __init__(self, ends: np.ndarray, window: int, first_sequence: int):
        self.ends, self.window, self.sequence = ends, window, first_sequence
        self.parts: list[tuple[object, int, np.ndarray, int]] = []  # id, start, ids, all tokens of the document
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        for at in range(0, len(ids), STRETCH):
            part = ids[at : at + STRETCH]
            self.parts.append((doc_id, at, part, len(ids)))
            self.held += len(part)
            if self.held >= STRETCH:
                self._settle(last=False)

    def finish(self) -> None:
        if self.held:
            self._settle(last=True)

    def _settle(self, last: bool) -> None:
        sizes = np.array([len(p[2]) for p in self.parts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        stream = np.concatenate([p[2] for p in self.parts])
        places = np.nonzero(self.ends[stream])[0] + 1
        penalties = np.full(len(places), SENTENCE_END)
        whole = np.array([p[1] + len(p[2]) == p[3] for p in self.parts])
        doc_ends = bounds[1:][whole]
        places, first = np.unique(np.concatenate([doc_ends, places]), return_index=True)
        penalties = np.concatenate([np.full(len(doc_ends), DOCUMENT_END), penalties])[first]
        cuts = choose_cuts(len(stream), places, penalties, self.window)
        if not last:
            cuts = cuts[:-1]
        begin = 0
        if last and cuts:  # the rest of the partition in powers of two: no padding
            end = cuts.pop()
            start = cuts[-1] if cuts else 0
            rest = end - start
            if not _is_power(rest) and self.window - rest > CUT * rest.bit_count():
                for k in reversed(range(rest.bit_length())):
                    if rest >> k & 1:
                        start += 1 << k
                        cuts.append(start)
            else:
                cuts.append(end)
        for end in cuts:
            k = int(np.searchsorted(bounds, begin, "right")) - 1
            at = begin
            while at < end:
                stop = min(end, int(bounds[k + 1]))
                doc_id, start, ids, total = self.parts[k]
                lo = at - int(bounds[k])
                piece = ids[lo : lo + stop - at]
                self._piece(doc_id, start + lo, piece, total, at - begin)
                at, k = stop, k + 1
            self.sequence += 1
            begin = end
        left = []
        for k, (doc_id, start, ids, total) in enumerate(self.parts):
            if bounds[k + 1] > begin:
                skip = max(0, begin - int(bounds[k]))
                left.append((doc_id, start + skip, ids[skip:], total))
        self.parts, self.held = left, len(stream) - begin

    def _piece(self, doc_id, start: int, piece: np.ndarray, total: int, offset: int) -> None:
        if self.rows and offset and self.rows[-1][5] == self.sequence and self.rows[-1][0] == doc_id and self.rows[-1][1] + self.rows[-1][2] == start and start:
            d, s, n, crc, t, q, o = self.rows.pop()
            self.rows.append((d, s, n + len(piece), zlib.crc32(piece.astype("<u4").tobytes(), crc), t, q, o))
        else:
            self.rows.append((doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset))

    def pieces(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(path: str, ranks: str | None, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        encode, ends = tokenizer(path, ranks)
        packer = Packer(ends, window, TaskContext.get().partitionId() << 36)

        def batch(rows: list[tuple], kind: pa.DataType):
            return pa.record_batch([pa.array([r[0] for r in rows], kind), *(pa.array([r[k + 1] for r in rows], pa.int64()) for k in range(6))], ["_mr_id", *NAMES])

        kind = None
        for b in batches:
            kind = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                packer.add(i, np.append(encode(t.decode("utf-8", "replace")) if t else np.empty(0, np.uint32), np.uint32(end_id)))
            if rows := packer.pieces():
                yield batch(rows, kind)
        packer.finish()
        if rows := packer.pieces():
            yield batch(rows, kind)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pack every document's ids, followed by end_id, into windows; one row per piece of a document in a window.

    Columns: id_col, start (ids of the document before the piece), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers), doc_tokens (with the end), sequence_id, offset (in the window, gapless from 0). Each
    partition of docs is one stream in its stored order, so nothing is shuffled and the order of a mixed input stays;
    a lost task repeats the same rows. Sequence ids are unique, those of partition p begin at p * 2**36. Null texts
    are empty: a document of one token, its end. Ids may be null or repeat (each row is a document of its own). Texts
    of any length are cut into stretches. An empty table gives an empty result; other columns are ignored.
    Without a path the public byte-level vocabulary of 50k tokens is used.
    """
    if path is None:
        import public_tokenizers

        path, ranks = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    x = docs.select(F.col(id_col).alias("_mr_id"), F.col(text_col).cast("string").alias("_mr_text"))
    schema = f"_mr_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES)
    return map_arrow(x, _pack(path, ranks, window, end_id), schema).withColumnRenamed("_mr_id", id_col)
