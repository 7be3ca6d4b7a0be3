"""Byte-level pair encoding with a given vocabulary, vocabulary digests and hashes of category combinations.

Vocabularies are read, never trained.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of public byte-level vocabularies.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """A printable letter for every byte: printable Latin-1 as itself, the others from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return out


class BpeTokenizer:
    """encode() merges the pair of the lowest rank until no pair has one; a whole pre-token in the vocabulary is taken
    as it is."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str = PIECES, specials: dict[str, int] | None = None):
        self.ranks, self.pattern, self.specials = vocabulary, pattern, specials or {}
        self.pieces = regex.compile(pattern)
        self.back = {v: k for k, v in vocabulary.items()}

    @classmethod
    def load(cls, path: str, pattern: str | None = None) -> "BpeTokenizer":
        """From a tokenizer.json with byte-level letters, whose merges' order gives the ranks."""
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda t: bytes(back[c] for c in t)
        model = held["model"]
        out = cls({raw(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}, pattern or PIECES)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        out.merges = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        out.specials = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        return out

    merges: dict[tuple[bytes, bytes], int] | None = None

    def _rank(self, a: bytes, b: bytes):
        return self.merges.get((a, b)) if self.merges is not None else self.ranks.get(a + b)

    def piece(self, data: bytes) -> list[int]:
        if self.merges is None and data in self.ranks:
            return [self.ranks[data]]
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            ranked = [(r, k) for k in range(len(parts) - 1) if (r := self._rank(parts[k], parts[k + 1])) is not None]
            if not ranked:
                break
            low = min(ranked)[0]
            a, b = next((parts[k], parts[k + 1]) for r, k in ranked if r == low)
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def encode(self, text: str, memory: dict | None = None) -> list[int]:
        memory = {} if memory is None else memory
        out: list[int] = []
        for m in self.pieces.finditer(text):
            p = m[0].encode()
            ids = memory.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(memory) < 200_000 and len(p) < 64:
                    memory[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.back[i] for i in ids).decode("utf-8", "replace")

    def encode_column(self, text: str) -> Column:
        """Ids of whole texts; null for null."""
        tok = self

        def run(x: pa.Array) -> pa.Array:
            memory: dict = {}
            return pa.array([None if t is None else tok.encode(t, memory) for t in x.to_pylist()], pa.list_(pa.int32()))

        return F.arrow_udf(run, "array<int>")(F.col(text))

    def decode_column(self, ids: str) -> Column:
        tok = self
        return F.arrow_udf(lambda x: pa.array([None if v is None else tok.decode(v) for v in x.to_pylist()], pa.string()), "string")(F.col(ids))

    def fingerprint(self) -> str:
        """Digest of the vocabulary in the order of ids, the merges and the pattern."""
        h = hashlib.sha256()
        for t, i in sorted(self.ranks.items(), key=lambda p: p[1]):
            h.update(i.to_bytes(4, "little") + len(t).to_bytes(4, "little") + t)
        for (a, b), r in sorted((self.merges or {}).items(), key=lambda p: p[1]):
            h.update(len(a).to_bytes(4, "little") + a + len(b).to_bytes(4, "little") + b)
        h.update(self.pattern.encode())
        return h.hexdigest()

    def manifest(self) -> dict:
        return {"tokens": len(self.ranks), "merges": len(self.merges or {}), "specials": len(self.specials), "pattern": self.pattern, "sha256": self.fingerprint()}


def pre_token_counts(df: DataFrame, text: str, pattern: str = PIECES) -> DataFrame:
    """(piece, n) over all texts."""
    expr = regex.compile(pattern)

    def run(batches):
        counts: dict[str, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for m in expr.finditer(t or ""):
                    counts[m[0]] = counts.get(m[0], 0) + 1
            if len(counts) > 500_000:
                yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])
                counts = {}
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def combination_hash(parts: list[str], seed: int = 0) -> Column:
    """One 64-bit key of several category columns, folded left to right in wrapping arithmetic."""
    arrow = F.arrow_udf(_fold(seed), "long")
    return arrow(*[F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in parts])


def _fold(seed: int):
    def run(*cols: pa.Array) -> pa.Array:
        h = np.full(len(cols[0]), np.uint64(seed & (2**64 - 1)), np.uint64)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (v * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        return pa.array(h.view(np.int64))

    return run
