"""Log probabilities of texts by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words joined by single spaces, with one end. A frequent token is a path in a Huffman tree;
any other one is the tree's escape, followed by its share among the rarer tokens or, if training never held it, by
the Good-Turing probability of such tokens and its spelling, each byte a path in a fixed tree, up to a space. So a text is a sequence of binary decisions. For each decision three predictors look up what followed their own context
in the training documents. On a token's path: nothing, the last very frequent token, and the token before, the
latter two hashed with the node into tables of fixed size. When spelling: the last two bytes, the last three, and
the word so far. Their logits are added up with weights from a set that a gate selects by how much the longer
contexts have seen. The weights start from fixed values and take a gradient step after every small block of
decisions, so they adapt to the text; nothing is learned from a part of the training texts. The probabilities of
all decisions multiply to that of the text.

Context tables and token counts cover all training documents. Token counts are kept exactly: the most frequent
tokens are broadcast (a fixed number), the rest is joined.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_shuffles, map_arrow, materialize, merged, salt, text_bytes

#: The bytes with symbols of their own, from frequent to rare; any other is an escape and 8 plain bits.
ALPHABET = b" etaonirshdlucmpfgvbwyzjkqx.,\xc3\n-'\xa9\xa8\xaa\xa4\xb3\xb1\xbc\xb6\xad\xa7\xa0\xa1\xae\xaf\xba\x9f\xa2\xab\xb4%&$*!?:;\"0#"
ESCAPE = len(ALPHABET)
SYMBOLS = 64
assert ESCAPE < SYMBOLS

SYMBOL = np.full(256, ESCAPE, np.uint8)
SYMBOL[np.frombuffer(ALPHABET, np.uint8)] = np.arange(ESCAPE)
SPACE = int(SYMBOL[32])
ESCAPE_BITS = math.log2(256 - ESCAPE)


def _tree() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree for weights 1 / (rank + 3): (first, length) of each symbol's path in the flat (nodes, bits)."""
    heap = [(1 / (k + 3), k, k) for k in range(SYMBOLS)]
    heapq.heapify(heap)
    paths: dict[int, list[tuple[int, int]]] = {k: [] for k in range(SYMBOLS)}
    members = {k: [k] for k in range(SYMBOLS)}
    node, names = SYMBOLS - 2, SYMBOLS
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, x in ((0, a[2]), (1, b[2])):
            for s in members[x]:
                paths[s].append((node, bit))
        members[names] = members.pop(a[2]) + members.pop(b[2])
        heapq.heappush(heap, (a[0] + b[0], names, names))
        node, names = node - 1, names + 1
    flat = [p for k in range(SYMBOLS) for p in reversed(paths[k])]
    lengths = np.array([len(paths[k]) for k in range(SYMBOLS)])
    return np.cumsum(lengths) - lengths, lengths, np.array([p[0] for p in flat]), np.array([p[1] for p in flat])


FIRST, LENGTH, NODES, BITS = _tree()
#: UNDER[bit][symbol, node]: whether the symbol's path takes this bit at the node.
UNDER = np.zeros((2, SYMBOLS, SYMBOLS), np.float32)
for _s in range(SYMBOLS):
    for _p in range(FIRST[_s], FIRST[_s] + LENGTH[_s]):
        UNDER[BITS[_p], _s, NODES[_p]] = 1

ROW_BITS = 16
SPELL_ROWS = (SYMBOLS**2, 1 << ROW_BITS, 1 << ROW_BITS)
SPELL_STARTS = (0, SPELL_ROWS[0], SPELL_ROWS[0] + SPELL_ROWS[1])
SPELL_CELLS = sum(SPELL_ROWS) * SYMBOLS
#: Cells of each token context table; a cell has a count for either bit.
PATH_BITS = 21
FREQUENT = 256
BLOCK_CELLS = 1 << 16
ALL_CELLS = SPELL_CELLS + 2 * (2 << PATH_BITS)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_MULT, 1 << 18), _powers(_INVERSE, 1 << 18)


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, index of the word, rows of the three contexts [3, n]) of words, each ended by a space."""
    sym = SYMBOL[np.frombuffer(b" ".join(words) + b" ", np.uint8)]
    n = len(sym)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    s = np.concatenate([np.full(3, SPACE, np.uint8), sym]).astype(np.uint64)
    inside = np.arange(n) - begin
    p1, p2, p3 = (np.where(inside >= k, s[3 - k : n + 3 - k], np.uint64(SPACE)) for k in (1, 2, 3))
    two = p1 * np.uint64(SYMBOLS) + p2
    shift = np.uint64(64 - ROW_BITS)
    three = (two * np.uint64(SYMBOLS) + p3 + np.uint64(1)) * _MULT >> shift
    total = np.concatenate([[np.uint64(0)], np.cumsum((sym.astype(np.uint64) + np.uint64(1)) * _UP[:n], dtype=np.uint64)])
    so_far = (total[:-1] - total[begin]) * _DOWN[begin]
    so_far = (so_far ^ so_far >> np.uint64(31)) * _MULT >> shift
    return sym, owner, np.stack([two.astype(np.int64), three.astype(np.int64) + SPELL_STARTS[1], so_far.astype(np.int64) + SPELL_STARTS[2]])


class Vocabulary:
    """The frequent tokens' hashes and counts, and the Huffman tree over them and the escape.

    The escape weighs the occurrences of all other tokens and, for tokens that training never held, as many as there
    are tokens that it held once.
    """

    def __init__(self, pairs, total: int, once: int):
        h, c = np.array(pairs, np.int64).reshape(-1, 2).T
        ranked = np.lexsort((h, -c))
        h, c = h[ranked], c[ranked]
        self.escape = len(h)
        order = np.argsort(h, kind="stable")
        self.hashes, self.ids = h[order], order.astype(np.int64)
        self.counts = np.append(c, 0).astype(np.float64)
        self.end = int(end[0]) if len(end := np.nonzero(h == END_HASH)[0]) else self.escape
        self.rest = total - int(c.sum()) + once + 1
        weights = np.append(c, self.rest)
        n = len(weights)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
        # leaves in ascending order and joined nodes, which come up in that order: the least is first in either
        leaves, joined = np.argsort(weights, kind="stable"), np.empty(n, np.int64)
        low, i, j, at = weights[leaves], 0, 0, n
        while at < 2 * n - 1:
            w = 0
            for bit in (0, 1):
                if i < n and (j == at - n or low[i] <= joined[j]):
                    x, w, i = leaves[i], w + low[i], i + 1
                else:
                    x, w, j = n + j, w + joined[j], j + 1
                parent[x], side[x] = at, bit
            joined[at - n] = w
            at += 1
        root = at - 1
        up, turn = parent, side
        steps, x = [], np.arange(n)
        while (live := x != root).any():
            steps.append((np.nonzero(live)[0], up[x[live]] - n, turn[x[live]]))
            x = np.where(live, up[x], root)
        self.length = np.zeros(n, np.int64)
        for k, _, _ in steps:
            self.length[k] += 1
        self.first = np.cumsum(self.length) - self.length
        self.nodes, self.bits = np.empty(int(self.length.sum()), np.int32), np.empty(int(self.length.sum()), np.int8)
        share = np.array(weights, np.float64)
        one, all_ = np.zeros(max(1, n - 1)), np.zeros(max(1, n - 1))
        for depth, (k, node, bit) in enumerate(steps):
            at_ = self.first[k] + self.length[k] - 1 - depth
            self.nodes[at_], self.bits[at_] = node, bit
            all_ += np.bincount(node, share[k], len(all_))
            one += np.bincount(node, share[k] * bit, len(one))
        p = (one + 0.5) / (all_ + 1)
        self.logit = np.log(p / (1 - p)).astype(np.float32)

    def contexts(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last very frequent token, token before) of each token of a sequence; texts begin at `begins`."""
        n = len(ids)
        first = np.zeros(n, bool)
        first[begins] = True
        before = np.concatenate([[self.end], ids[:-1]])
        before[first] = self.end
        mark = np.where((before < FREQUENT) | first, np.arange(n), 0)
        return before[np.maximum.accumulate(mark)], before

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the tokens' decisions in the flat paths, decisions of each token, their running total)."""
        times = self.length[ids]
        ends = np.cumsum(times)
        return np.repeat(self.first[ids] - (ends - times), times) + np.arange(int(ends[-1]) if len(ids) else 0), times, ends

    @staticmethod
    def _hashed(k: int, context: np.ndarray, times: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Cells of context k of each decision, whose node hashes to `mixed`."""
        c = np.repeat((context.astype(np.uint32) + np.uint32(1)) * np.uint32((0x9E3779B1, 0xC2B2AE35)[k]), times)
        c += mixed
        c ^= c >> np.uint32(15)
        c *= np.uint32(0x2C1B3C6D)
        c >>= np.uint32(32 - PATH_BITS)
        return c

    def cells(self, k: int, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells of table k with their bit, decisions of each token) of tokens after contexts."""
        at, times, _ = self._places(ids)
        c = self._hashed(k, context, times, self.nodes[at].astype(np.uint32) * np.uint32(0x85EBCA6B))
        return (c << np.uint32(1) | self.bits[at].astype(np.uint32)).view(np.int32), times

    def paths(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, bits, cells of the two hashed contexts, ends of each token's decisions) of a token sequence; texts begin at `begins`."""
        at, times, ends = self._places(ids)
        nodes = self.nodes[at]
        mixed = nodes.astype(np.uint32) * np.uint32(0x85EBCA6B)
        frequent, before = (self._hashed(k, c, times, mixed) for k, c in enumerate(self.contexts(ids, begins)))
        return nodes, self.bits[at], frequent, before, ends


END_HASH = int(np.array([xxhash.xxh3_64_intdigest(b"")], np.uint64).view(np.int64)[0])


def token_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words)).view(np.int64)


class TokenIds(dict):
    """Token to id, that of no frequent token being the escape; remembers frequent tokens, so it is as large as the vocabulary at most."""

    def __init__(self, voc: Vocabulary):
        super().__init__()
        self.voc = voc

    def of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, hashes of the tokens that are no frequent ones, in their order)."""
        voc = self.voc
        ids = np.fromiter(map(self.get, tokens, repeat(-1)), np.int64, len(tokens))
        new = np.nonzero(ids < 0)[0]
        h = token_hashes([tokens[k] for k in new])
        if voc.escape:
            at = np.minimum(np.searchsorted(voc.hashes, h), voc.escape - 1)
            ids[new] = np.where(voc.hashes[at] == h, voc.ids[at], voc.escape)
        else:
            ids[new] = voc.escape
        frequent = ids[new] != voc.escape
        for k in new[frequent].tolist():
            self[tokens[k]] = int(ids[k])
        return ids, h[~frequent]


def batches_of(texts: list[bytes | None], size: int = 1 << 16) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first text, tokens of each) for runs of texts of about `size` tokens together."""
    at, held, n = 0, [], 0
    for k, t in enumerate(texts):
        words = t.lower().split() if t else []
        words.append(b"")
        held.append(words)
        n += len(words)
        if n >= size:
            yield at, held
            at, held, n = k + 1, [], 0
    if held:
        yield at, held


def _table_rows(shared):
    """Counts of a partition's training texts in all context tables, in blocks of compressed 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]):
        voc: Vocabulary = shared.value
        find, number = TokenIds(voc), salt()
        table = np.zeros(ALL_CELLS, np.int32)
        pairs: tuple[list[np.ndarray], ...] = ([], [])
        letters: list[np.ndarray] = []

        def settle(most: int):
            """Count what waits: equal (context, token) pairs go through their path once."""
            for k, own in enumerate(pairs):
                if sum(map(len, own)) > most:
                    key, times = np.unique(np.concatenate(own), return_counts=True)
                    own.clear()
                    for at in range(0, len(key), 1 << 17):
                        context, token = np.divmod(key[at : at + (1 << 17)], len(voc.length))
                        cells, steps = voc.cells(k, context, token)
                        lo = SPELL_CELLS + k * (2 << PATH_BITS)
                        table[lo : lo + (2 << PATH_BITS)] += np.bincount(cells, np.repeat(times[at : at + (1 << 17)], steps), 2 << PATH_BITS).astype(np.int32)
            if sum(map(len, letters)) > most:
                key, times = np.unique(np.concatenate(letters), return_counts=True)
                letters.clear()
                table[key] += times.astype(np.int32)

        for b in batches:
            for _, texts in batches_of(text_bytes(b.column(0))):
                words = [w for t in texts for w in t]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                ids, _ = find.of(words)
                for own, context in zip(pairs, voc.contexts(ids, np.cumsum(sizes) - sizes)):
                    own.append(context * len(voc.length) + ids)
                rare = np.nonzero(ids == voc.escape)[0]
                for sym, _, rows in spelled_parts([words[k] for k in rare]):
                    letters.extend((r * SYMBOLS + sym).astype(np.int32) for r in rows)
                settle(1_000_000)
        settle(0)
        for at in range(0, ALL_CELLS, BLOCK_CELLS):
            part = table[at : at + BLOCK_CELLS]
            if part.any():
                yield pa.record_batch([pa.array([at // BLOCK_CELLS], pa.int32()), pa.array([number], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "salt", "counts"])

    return run


def spelled_parts(words: list[bytes], size: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """spelling() of runs of words of bounded length; owners count on. A word longer than `size` is spelled in parts."""
    run, at, n = [], 0, 0
    for k, w in enumerate(words):
        if n and n + len(w) > size:
            sym, owner, rows = spelling(run)
            yield sym, owner + at, rows
            run, at, n = [], k, 0
        if len(w) > size:
            for lo in range(0, len(w), size):
                sym, owner, rows = spelling([w[lo : lo + size]])
                more = lo + size < len(w)
                yield (sym[:-1], owner[:-1] + k, rows[:, :-1]) if more else (sym, owner + k, rows)
            at = k + 1
            continue
        run.append(w)
        n += len(w) + 1
    if run:
        sym, owner, rows = spelling(run)
        yield sym, owner + at, rows


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK_CELLS, np.int64)
    for x in table["counts"]:
        part = np.frombuffer(pa.decompress(x.as_buffer(), BLOCK_CELLS * 4, "zstd"), np.int32) if len(x.as_buffer()) else np.zeros(0, np.int32)
        total[: len(part)] += part
    return pa.table({"block": table["block"][:1], "counts": pa.array([pa.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), "zstd", asbytes=True)], pa.binary())})


SEEN = [0.5, 3.5, 30.5]
#: Decisions of a text between two steps of its weights, at most; short texts have far shorter blocks.
LARGEST_BLOCK = 4096


def pack(logit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logits in 14 bits and how much was seen (0, 1 to 3, 4 to 30, more) in 2, as one 16-bit code."""
    code = np.rint((np.clip(logit, -12, 12) + 12) * (16383 / 24)).astype(np.uint16)
    return code << np.uint16(2) | np.digitize(n, SEEN).astype(np.uint16)


def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits and what was seen. Logits of at most 12 with weights of at most 1.5 stay far within a float's range."""
    logit = (code >> np.uint16(2)).astype(np.float32)
    logit *= np.float32(24 / 16383)
    logit -= np.float32(12)
    return logit, (code & np.uint16(3)).astype(np.int64)


class Mixer:
    """Tables of logits and of what they have seen, and the mixing itself."""

    GATES = 32

    def __init__(self, counts: np.ndarray, voc: Vocabulary, texts: list[bytes] = ()):
        self.voc = voc
        spell = counts[:SPELL_CELLS].reshape(-1, SYMBOLS)
        base = spell[: SPELL_ROWS[0]].sum(0, dtype=np.float64)
        self.spell_prior = prior = (base @ UNDER[1] + 0.5) / (base @ (UNDER[0] + UNDER[1]) + 1)
        self.spell = np.zeros(spell.shape, np.uint16)
        for at in range(0, len(spell), 4096):
            c = spell[at : at + 4096].astype(np.float32)
            one, zero = c @ UNDER[1], c @ UNDER[0]
            p = np.clip((one + 0.4 * prior) / (one + zero + 0.4), 1e-5, 1 - 1e-5)
            self.spell[at : at + len(c)] = pack(np.log(p / (1 - p)), one + zero)
        self.path = []
        for k in range(2):
            c = counts[SPELL_CELLS + k * (2 << PATH_BITS) :][: 2 << PATH_BITS].reshape(-1, 2)
            codes = np.empty(len(c), np.uint16)
            for at in range(0, len(c), 1 << 17):  # the driver makes these: its temporary arrays stay small
                part = c[at : at + (1 << 17)]
                n = part.sum(1, dtype=np.int64)
                p = (part[:, 1] + 0.3) / (n + 0.6)
                codes[at : at + len(part)] = pack(np.log(p / (1 - p)), n)
            self.path.append(codes)
        self.start = self.first_weights()
        self.learn(counts, texts)

    @classmethod
    def first_weights(cls) -> np.ndarray:
        """Weights before any learning: trust the longest context that has seen something. Gates: 16 if spelling, 4 * (longest seen), middle seen."""
        w = np.zeros((cls.GATES, 3), np.float32)
        for far in range(4):
            for mid in range(4):
                a, b = (0.0, 0.1, 0.12, 0.35)[far], (0.0, 0.15, 0.4, 0.68)[mid]
                w[4 * far + mid] = (max(0.08, 1 - 0.8 * a - b), b, a)
                a, b = (0.0, 0.15, 0.3, 0.42)[far], (0.0, 0.3, 0.6, 0.68)[mid]
                w[16 + 4 * far + mid] = (0.15 if mid > 1 else 0.6 - 0.3 * mid, b, a)
        return w

    def _mix(self, x: tuple[np.ndarray, ...], gate: np.ndarray, bit: np.ndarray, sizes: np.ndarray, owners: np.ndarray, weights: np.ndarray, rate: float) -> np.ndarray:
        """Bits of each decision of several texts in a row, of `sizes` decisions each.

        weights [texts, 3, gates] of the owners adapt in place after each block of a text. Blocks are of 32 decisions at
        first and a quarter of what the text has had later, up to LARGEST_BLOCK; all texts go through theirs at a time.
        """
        out = np.empty(len(bit), np.float32)
        order = np.argsort(-sizes, kind="stable")
        size, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
        own = np.ascontiguousarray(weights[owners[order]].transpose(1, 0, 2)).reshape(3, -1)
        lo = 0
        while live := int(np.searchsorted(-size, -lo)):
            hi = lo + min(LARGEST_BLOCK, max(32, lo // 4))
            n = np.minimum(size[:live], hi) - lo
            if live == 1:
                at = slice(start[0] + lo, start[0] + lo + n[0])
                g = gate[at]
            else:
                ends = np.cumsum(n)
                shift = np.empty((2, live), np.int64)
                shift[0], shift[1] = start[:live] + lo - (ends - n), np.arange(0, live * self.GATES, self.GATES)
                shift = np.repeat(shift, n, 1)
                at = shift[0]
                at += np.arange(ends[-1])
                g = shift[1]
                g += gate.take(at)
            right, xs = bit[at], [c[at] for c in x]
            z = own[0].take(g)
            z *= xs[0]
            for c in (1, 2):
                w = own[c].take(g)
                w *= xs[c]
                z += w
            np.negative(z, out=z, where=right)
            np.exp(z, out=z)
            one = z + np.float32(1)
            out[at] = np.log(one)
            if hi < size[0]:  # else nothing follows that new weights could serve
                z /= one
                np.negative(z, out=z, where=~right)
                cells = live * self.GATES
                seen = np.bincount(g, minlength=cells) + 64.0
                for c in range(3):
                    xs[c] *= z
                    own[c, :cells] += rate * np.bincount(g, xs[c], cells) / seen
                np.clip(own[:, :cells], -0.5, 1.5, out=own[:, :cells])
            lo = hi
        weights[owners[order]] = own.reshape(3, -1, self.GATES).transpose(1, 0, 2)
        out *= np.float32(1 / math.log(2))
        return out

    def learn(self, counts: np.ndarray, texts: list[bytes], rounds: int = 8, prior: float = 50.0) -> None:
        """Fit the start weights on given training texts by Newton steps, each gate a logistic regression drawn to first_weights().

        score() does without, as it would have to give this all training texts. The tables hold these texts
        themselves, so every decision is left out of the counts that predict it.
        """
        find, gram = TokenIds(self.voc), []
        spell = counts[:SPELL_CELLS].reshape(-1, SYMBOLS)
        for _, own in batches_of(texts):
            words, sizes = [w for t in own for w in t], np.fromiter(map(len, own), np.int64, len(own))
            ids, _ = find.of(words)
            nodes, bit, frequent, before, _ = self.voc.paths(ids, np.cumsum(sizes) - sizes)
            logits, seen = [self.voc.logit[nodes]], []
            for k, cells in enumerate((frequent, before)):
                c = counts[SPELL_CELLS + k * (2 << PATH_BITS) :][: 2 << PATH_BITS].reshape(-1, 2)[cells]
                one, zero = np.maximum(c[:, 1] - bit, 0), np.maximum(c[:, 0] - (1 - bit), 0)
                logits.append(np.clip(np.log((one + 0.3) / (zero + 0.3)), -12, 12).astype(np.float32))
                seen.append(np.digitize(one + zero, SEEN).astype(np.int8))
            gram.append((np.stack(logits), seen[1] * np.int8(4) + seen[0], bit > 0))
            for sym, _, rows in spelled_parts([words[k] for k in np.nonzero(ids == self.voc.escape)[0]]):
                times = LENGTH[sym]
                who = np.repeat(np.arange(len(sym)), times)
                at = FIRST[sym][who] + np.arange(len(who)) - (np.cumsum(times) - times)[who]
                logits, seen = [], []
                for r in rows:
                    c = spell[r].astype(np.float32)
                    c[np.arange(len(sym)), sym] = np.maximum(c[np.arange(len(sym)), sym] - 1, 0)
                    one, zero = ((c @ UNDER[b])[who, NODES[at]] for b in (1, 0))
                    p = np.clip((one + 0.4 * self.spell_prior[NODES[at]]) / (one + zero + 0.4), 1e-5, 1 - 1e-5)
                    logits.append(np.log(p / (1 - p)).astype(np.float32))
                    seen.append(np.digitize(one + zero, SEEN).astype(np.int8))
                gram.append((np.stack(logits), np.int8(16) + seen[2] * np.int8(4) + seen[1], BITS[at] > 0))
        if not gram:
            return
        x, gate, bit = np.concatenate([a for a, _, _ in gram], 1), np.concatenate([g for _, g, _ in gram]), np.concatenate([b for _, _, b in gram])
        gram.clear()  # the driver keeps one copy
        first = self.start.astype(np.float64)
        for g in range(self.GATES):
            mine = np.nonzero(gate == g)[0]
            if len(mine):
                z, y, w = x[:, mine].astype(np.float64), bit[mine], first[g].copy()
                cost = lambda w: np.logaddexp(0, np.where(y, -1, 1) * (w @ z)).sum() + prior / 2 * ((w - first[g]) ** 2).sum()  # noqa: B023, E731
                now = cost(w)
                for _ in range(rounds):
                    p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
                    step = np.linalg.solve((z * (p * (1 - p))) @ z.T + prior * np.eye(3), z @ (y - p) - prior * (w - first[g]))
                    for half in (1.0, 0.5, 0.25, 0.125, 0.03):
                        new = np.clip(w + half * step, -0.5, 1.5)
                        if (then := cost(new)) < now:
                            w, now = new, then
                            break
                    else:
                        break
                self.start[g] = w

    def bits(self, texts: list[list[bytes]], ids: np.ndarray, spell: np.ndarray, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits of each text's paths, text of each spelled token, its bits), given the tokens (ends included) and the ids of all in a row.

        Tokens that are not frequent are spelled in the texts that `spell` marks.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        nodes, bit, frequent, before, ends = self.voc.paths(ids, begins)
        mid, mid_seen = unpack(self.path[0][frequent])
        far, gate = unpack(self.path[1][before])
        gate *= 4
        gate += mid_seen
        near, bit = self.voc.logit[nodes], bit > 0
        weights = np.repeat(self.start.T[None], len(texts), 0)
        steps = np.diff(ends[begins + sizes - 1], prepend=0)
        every = np.arange(len(texts))
        out = np.bincount(np.repeat(every, steps), self._mix((near, mid, far), gate, bit, steps, every, weights, rate), len(texts))
        owner_of = np.repeat(np.arange(len(texts)), sizes)
        rare = np.nonzero((ids == self.voc.escape) & spell[owner_of])[0]
        text_of, spelled = owner_of[rare], np.zeros(len(rare))
        if len(rare):
            words = [w for t in texts for w in t]
            table = self.spell.reshape(-1)
            for sym, owner, rows in spelled_parts([words[k] for k in rare]):
                times = LENGTH[sym]
                ends = np.cumsum(times)
                at_ = np.repeat(FIRST[sym] - (ends - times), times) + np.arange(ends[-1])
                near, mid, far = (unpack(table[np.repeat(r * SYMBOLS, times) + NODES[at_]]) for r in rows)
                x, gate = (near[0], mid[0], far[0]), 16 + far[1] * 4 + mid[1]
                bit = BITS[at_] > 0
                own = text_of[owner]
                of, first = np.unique(own, return_index=True)
                steps = np.diff(np.append(ends[first] - times[first], ends[-1]))
                cost = self._mix(x, gate, bit, steps, of, weights, rate)
                spelled += np.bincount(np.repeat(owner, times), cost, len(rare)) + np.bincount(owner, (sym == ESCAPE) * ESCAPE_BITS, len(rare))
        return out, text_of, spelled


def _token_rows(batches: Iterator[pa.RecordBatch]):
    """Token counts of a partition; the end counts as the token of no bytes."""
    held, n, ends = [], 0, 0

    def rows():
        counts = pc.value_counts(pa.chunked_array(held, pa.binary()))
        words, times = counts.field("values").to_pylist(), counts.field("counts").to_numpy()
        # the split leaves an empty word before and after outer white space
        some = np.array([len(w) > 0 for w in words], bool)
        return pa.record_batch([pa.array(token_hashes([*(w for w in words if w), b""])), pa.array(np.append(times[some], ends).astype(np.int64))], ["h", "c"])

    for b in batches:
        words = pc.ascii_split_whitespace(pc.ascii_lower(b.column(0).cast(pa.string()))).flatten()
        held.append(words.cast(pa.binary()))
        n, ends = n + len(words), ends + b.num_rows
        if n > 2_000_000:
            yield rows()
            held, n, ends = [], 0, 0
    if ends:
        yield rows()


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        mixer: Mixer = shared.value
        voc = mixer.voc
        find = TokenIds(voc)
        for b in batches:
            n_tokens, sums, head_known, rest, spelled, n_bytes, bits = [], [], [], [], [], [], []
            held_out = b.column(2).to_numpy(zero_copy_only=False)
            for first, texts in batches_of(text_bytes(b.column(1))):
                words = [w for t in texts for w in t]
                ids, tail = find.of(words)
                # only held-out texts can hold tokens that training never saw, and only such tokens are spelled
                path_bits, text_of, spell_bits = mixer.bits(texts, ids, held_out[first : first + len(texts)])
                bits.extend(path_bits.tolist())
                hit = ids != voc.escape
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                owner = np.repeat(np.arange(len(texts)), sizes)
                sums.extend(np.bincount(owner, np.where(hit, np.log10(voc.counts[ids] + 1.0), 0.0), len(texts)).tolist())
                head_known.extend(np.bincount(owner, hit, len(texts)).astype(np.int64).tolist())
                owner = owner[~hit]
                rest.extend(np.split(tail, np.searchsorted(owner, np.arange(1, len(texts)))))
                spelled.extend(np.split(spell_bits.astype(np.float32), np.searchsorted(text_of, np.arange(1, len(texts)))))
                n_tokens.extend(sizes.tolist())
                n_bytes.extend(max(1, sum(map(len, t)) + len(t) - 1) for t in texts)
            yield pa.record_batch(
                [b.column(0), *b.columns[2:], pa.array(n_tokens, pa.int64()), pa.array(sums, pa.float64()), pa.array(head_known, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(spelled, pa.list_(pa.float32())), pa.array(n_bytes, pa.int64()), pa.array(bits, pa.float64())],
                ["id", *b.schema.names[2:], "n_tokens", "part", "known", "rest", "spelled", "n_bytes", "bits"],
            )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, head: int = 200_000) -> DataFrame:
    """Return (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one row per input row.

    Documents whose crc32(id as text) mod `folds` is `held_fold` are held out; all others train. base_score is the
    add-one unigram log10 probability, score that of the mixed predictors. In both a token that training never held is
    one symbol; bits_per_byte also counts the bits of spelling it, for the lower-cased words joined by spaces. Null texts are empty: one token, the end. Rows with a null id train nothing and count as held out; rows
    that repeat an id are scored each. An empty table gives an empty result; other columns, whatever their names,
    are ignored. The `head` most frequent tokens of those that training holds twice or more are broadcast with their
    counts; all others are joined. Tokens held once are never among them: they show where new tokens come up.
    """
    spark = docs.sparkSession
    x = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(True)).alias("held_out"))
    train = x.where("not held_out").select("text")
    counts = materialize(map_arrow(train, _token_rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    free_shuffles(spark)
    total, distinct, once = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long"))).first()
    total, once = total or 0, once or 0
    # collect() would bring `head` rows of every task to the driver, which picks among them; here one task does
    top = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(head).toArrow()
    voc = Vocabulary(np.stack([top["h"].to_numpy(), top["c"].to_numpy()], 1), total, once)
    del top
    shared = spark.sparkContext.broadcast(voc)
    table = np.zeros(ALL_CELLS, np.int32)
    for r in merged(map_arrow(train, _table_rows(shared), "block int, salt int, counts binary"), _sum_blocks, "block int, counts binary").toLocalIterator():
        part = np.frombuffer(pa.decompress(bytes(r["counts"]), BLOCK_CELLS * 4, "zstd"), np.int32)
        at = r["block"] * BLOCK_CELLS
        table[at : at + BLOCK_CELLS] = part[: ALL_CELLS - at]
    free_shuffles(spark)
    mixer = Mixer(table, voc)
    del table  # before the broadcast writes the model
    model = spark.sparkContext.broadcast(mixer)
    del mixer
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = map_arrow(x.select("id", "text", "held_out"), _score_rows(model), f"id {id_type}, held_out boolean, n_tokens long, part double, known long, rest array<bigint>, spelled array<float>, n_bytes long, bits double")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "spelled")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.spelled").alias("s"))
    known_cost, new_cost = math.log2(voc.rest) - F.log2("c"), math.log2(voc.rest / (once + 1))
    rare = rare.join(counts, "h", "left").groupBy("row").agg(F.sum((F.col("c").isNotNull()).cast("long")).alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("plus"), F.sum(F.coalesce(known_cost, F.lit(new_cost))).alias("spent"), F.sum(F.when(F.col("c").isNull(), F.col("s")).otherwise(0.0)).alias("letters"))
    out = scored.drop("rest", "spelled").join(rare, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("spent", F.lit(0.0)))
    floor = math.log10(total + distinct + 1)
    n_known = (F.col("known") + F.coalesce("more", F.lit(0))).cast("long")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("plus", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (-F.col("bits") * F.lit(math.log10(2))).alias("score"), "n_bytes", ((F.col("bits") + F.coalesce("letters", F.lit(0.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
