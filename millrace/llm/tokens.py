"""Token counts that survive edits: a segment tree of pre-token runs per document.

A text is cut where a single space stands between two other characters that are no white space: there a pre-token
of the byte-level BPE always begins, so counts of the parts add up. Runs of such parts are the leaves; inner nodes
hold sums of tokens and of characters. An edit replaces a span: only the leaves it touches, and the neighbour whose
boundary it may have changed, are encoded again, and sums are updated along their paths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, text_bytes

LEAF_CHARS = 128


@lru_cache(4)
def encoder(path: str):
    """The tokenizer of a .tiktoken rank file; a worker loads it once."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_file(path: str | None = None) -> str:
    """The given path, or that of the public byte-level vocabulary of 50k tokens."""
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def is_cut(text: str, at: int) -> bool:
    """Whether a pre-token surely begins at this position: a lone space between two characters that are no white space."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """text in parts of about `size` characters that begin at sure boundaries; a stretch without one stays whole."""
    out, begin = [], 0
    while len(text) - begin > size:
        at = begin + size
        while (at := text.find(" ", at)) >= 0 and not is_cut(text, at):
            at += 1
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    out.append(text[begin:])
    return out


class TokenTree:
    """Sums of characters and tokens over a text's leaves, as a Fenwick-like binary tree over a leaf list.

    Leaves keep their slots: an edit rewrites the text of the leaves it touches in the first of their slots and
    empties the others, so only their ancestors change. The tree is rebuilt once a leaf outgrows 16 times its size.
    """

    def __init__(self, text: str, count, size: int = LEAF_CHARS):
        self.count, self.size, self.encoded = count, size, 0
        self._build(leaves(text, size))

    @classmethod
    def restore(cls, parts: list[str], tokens: list[int], count, size: int = LEAF_CHARS) -> "TokenTree":
        """The tree of leaves whose counts are known: nothing is encoded."""
        out = object.__new__(cls)
        out.count, out.size, out.encoded = count, size, 0
        out._build(parts or [""], tokens or [0])
        return out

    def leaf_tokens(self) -> list[int]:
        return self.tokens[self.width : self.width + len(self.parts)]

    def _build(self, parts: list[str], known: list[int] | None = None) -> None:
        self.parts = parts
        self.width = 1 << max(0, (len(parts) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, n in enumerate(self._encode(parts) if known is None else known):
            self.chars[self.width + k], self.tokens[self.width + k] = len(parts[k]), n
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _encode(self, parts: list[str]) -> list[int]:
        self.encoded += sum(map(len, parts))
        return [self.count(p) if p else 0 for p in parts]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def _find(self, position: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character position; the end belongs to the last leaf that has characters."""
        k = 1
        while k < self.width:
            left = self.chars[2 * k]
            if position < left or not self.chars[2 * k + 1]:
                k = 2 * k
            else:
                position -= left
                k = 2 * k + 1
        return k - self.width, position

    def _put(self, leaf: int, part: str) -> None:
        self.parts[leaf] = part
        k = self.width + leaf
        self.chars[k], self.tokens[k] = len(part), self._encode([part])[0]
        while k := k // 2:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, begin: int, length: int, insert: str) -> int:
        """Replace `length` characters from `begin` (both held to the text's ends) by `insert`; the new token total."""
        n = self.chars[1]
        begin = max(0, min(begin, n))
        length = max(0, min(length, n - begin))
        first, at = self._find(begin)
        last, end = self._find(begin + length)
        merged = self.parts[first][:at] + insert + self.parts[last][end:]
        # boundary context: what stands before and after must still be cut at sure boundaries
        while first and not self._sound(first, merged, last):
            first -= 1
            merged = self.parts[first] + merged
        nxt = self._after(last)
        while nxt is not None and not (self.parts[nxt][:1] == " " and is_cut("".join((merged[-1:], self.parts[nxt][:2])), 1)):
            merged, last = merged + self.parts[nxt], nxt
            nxt = self._after(last)
        for k in range(first + 1, last + 1):
            if self.parts[k]:
                self._put(k, "")
        self._put(first, merged)
        if len(merged) > 16 * self.size:
            self._build(leaves(self.text, self.size))
        return self.total

    def _after(self, leaf: int) -> int | None:
        return next((k for k in range(leaf + 1, len(self.parts)) if self.parts[k]), None)

    def _sound(self, first: int, merged: str, last: int) -> bool:
        """Whether the leaf before `first` still ends at a sure boundary now that `merged` follows it."""
        before = next((self.parts[k] for k in range(first - 1, -1, -1) if self.parts[k]), "")
        nxt = self._after(last)
        follows = merged if len(merged) > 1 or nxt is None else merged + self.parts[nxt][:2]
        return not before or is_cut(before[-1:] + follows[:2], 1)


def _tree_rows(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        count = lambda part: len(enc.encode_ordinary(part))
        for b in batches:
            rows = []
            for t, edits in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
                tree = TokenTree(t.decode("utf-8", "replace") if t else "", count, size)
                before, chars, leaves_, first = tree.total, tree.chars[1], len(tree.parts), tree.encoded
                for e in edits or ():
                    if e is not None and e["begin"] is not None:
                        tree.edit(e["begin"], e["length"] or 0, e["insert"] or "")
                rows.append((chars, leaves_, before, tree.total, tree.chars[1], tree.encoded - first))
            names = ["n_chars", "n_leaves", "n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded"]
            yield pa.record_batch([*b.columns[2:], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(6))], [*b.schema.names[2:], *names])

    return run


def count_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Token counts before and after each document's edits, (id_col, n_chars, n_leaves, n_tokens, n_tokens_after, n_chars_after, n_chars_encoded).

    edits_col is an array of structs (begin, length, insert), positions in characters, applied in order; positions
    beyond the text's ends are held to them. Null texts are empty, null edits do nothing. n_chars_encoded is what
    the edits had to encode again. One row per input row, ids may be null or repeat; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    x = docs.select(F.col(text_col).cast("string").alias("_mr_text"), F.col(edits_col).cast("array<struct<begin:bigint,length:bigint,insert:string>>").alias("_mr_edits"), F.col(id_col).alias("_mr_id"))
    schema = f"_mr_id {docs.schema[id_col].dataType.simpleString()}, n_chars long, n_leaves long, n_tokens long, n_tokens_after long, n_chars_after long, n_chars_encoded long"
    return map_arrow(x, _tree_rows(rank_file(path), leaf_chars), schema).withColumnRenamed("_mr_id", id_col)


TREE = "parts array<string>, leaf_tokens array<long>, n_tokens long, n_chars_encoded long"


def _tree_row(tree: TokenTree) -> tuple:
    kept = [k for k, part in enumerate(tree.parts) if part]  # slots that edits emptied go
    tokens = tree.leaf_tokens()
    return [tree.parts[k] for k in kept], [tokens[k] for k in kept], tree.total, tree.encoded


def _tree_batch(b: pa.RecordBatch, first: int, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64())
    return pa.record_batch([*b.columns[first:], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*b.schema.names[first:], "parts", "leaf_tokens", "n_tokens", "n_chars_encoded"])


def keep_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id_col, parts, leaf_tokens, n_tokens, n_chars_encoded): each document's tree as its leaves and their counts.

    A table of these is what edit_trees() continues from. Null texts are empty trees; ids may be null or repeat; an
    empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    file = rank_file(path)

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(file)
        for b in batches:
            yield _tree_batch(b, 1, [_tree_row(TokenTree(t.decode("utf-8", "replace") if t else "", lambda part: len(enc.encode_ordinary(part)), leaf_chars)) for t in text_bytes(b.column(0))])

    x = docs.select(F.col(text_col).cast("string").alias("_mr_text"), F.col(id_col).alias("_mr_id"))
    return map_arrow(x, run, f"_mr_id {docs.schema[id_col].dataType.simpleString()}, {TREE}").withColumnRenamed("_mr_id", id_col)


def edit_trees(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """trees after the edits of their ids: kept counts are read, only touched leaves and their context are encoded.

    Documents without edits stay as they are, with n_chars_encoded 0; edits of unknown ids do nothing. Ids are unique
    in trees; several rows of edits of an id are not merged, give them as one array. Edits as in count_edited().
    """
    file, kind = rank_file(path), "array<struct<begin:bigint,length:bigint,insert:string>>"

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(file)
        for b in batches:
            rows = []
            for parts, tokens, own in zip(*(c.to_pylist() for c in b.columns[:3])):
                tree = TokenTree.restore(parts, tokens, lambda part: len(enc.encode_ordinary(part)), leaf_chars)
                for e in own or ():
                    if e is not None and e["begin"] is not None:
                        tree.edit(e["begin"], e["length"] or 0, e["insert"] or "")
                rows.append(_tree_row(tree))
            yield _tree_batch(b, 3, rows)

    own = edits.select(F.col(id_col).alias("_mr_e"), F.col(edits_col).cast(kind).alias("_mr_edits"))
    x = trees.join(own, F.col(id_col) == F.col("_mr_e"), "left").select("parts", "leaf_tokens", "_mr_edits", F.col(id_col).alias("_mr_id"))
    return map_arrow(x, run, f"_mr_id {trees.schema[id_col].dataType.simpleString()}, {TREE}").withColumnRenamed("_mr_id", id_col)


def sample_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids and texts with three edits each, derived from the text's own checksum: a deletion, a replacement, an insertion."""
    crc, n = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("bigint")
    at = lambda k: F.pmod(F.shiftright(crc, k), n + 1)
    edit = lambda begin, length, insert: F.struct(begin.alias("begin"), F.lit(length).cast("bigint").alias("length"), F.lit(insert).alias("insert"))
    return docs.select(id_col, text_col, F.array(edit(at(0), 17, ""), edit(at(5), 5, "edited text"), edit(at(9), 0, " inserted  words\n")).alias("edits"))
