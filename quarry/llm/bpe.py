"""Byte-level BPE encoding and decoding.

Every match of the split pattern is a piece. A piece that is a token is that token; else its
bytes are merged. Per piece a segment tree over byte positions stores the leftmost minimum rank
of the pair that starts at each live position. A merge takes the root, drops the right part,
links its neighbours and updates the two live positions whose pairs changed, each in as many
steps as the tree has levels. Trees of many pieces of one size are worked on together in numpy.
Finished pieces are kept in a bounded memory of each worker, two generations of it; it decides
speed, never results.

Ranks come from a file of base64 tokens and ranks, whose path is a parameter; they are sent to
the executors by broadcast (a vocabulary is a fixed file of about a megabyte). Special tokens
are ordinary text.

Defined cases: null text encodes to no ids and decodes to no bytes; ids outside the vocabulary
raise an error on decoding, null ids decode to no bytes; repeated rows are coded each; an empty table
gives no rows. A text and a piece are whole in one task: a run of one letter is a single piece, whose
merges take about 110 microseconds a byte.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.llm import tokens

NONE = 1 << 30
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class PairTable:
    """Token of every pair of tokens whose bytes together are a token: open addressing in numpy."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, both = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), both.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, rest, values = self._slot(keys), np.arange(len(keys)), np.array(both, np.int64)
        while len(rest):
            free = self.keys[slot[rest]] == -1
            self.keys[slot[rest[free]]] = keys[rest[free]]
            done = self.keys[slot[rest]] == keys[rest]
            self.values[slot[rest[done]]] = values[rest[done]]
            rest = rest[~done]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            found = self.keys[slot[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.values[slot[rest[same]]]
            rest = rest[~same & (found != -1)]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces of at least two bytes; the trees of all pieces
        have as many leaves as the longest needs."""
        n, longest = len(pieces), max(map(len, pieces))
        width = 1 << max(1, (longest - 1).bit_length())
        levels = width.bit_length() - 1
        length = np.fromiter(map(len, pieces), np.int64, n)
        filled = np.arange(width) < length[:, None]
        part = np.full((n, width + 2), -1, np.int64)  # the token that starts at a live position; -1 elsewhere
        part[:, :width][filled] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 3), (n, width + 2)).copy()  # the next live position
        before = np.broadcast_to(np.arange(-1, width + 1), (n, width + 2)).copy()
        # A leaf is rank << 32 | position, so that the smallest is the leftmost of the smallest rank.
        tree = np.full((n, 2 * width), NONE << 32, np.int64)
        tree[:, width:] = NONE << 32 | np.arange(width)
        pair = filled[:, 1:]
        at = np.nonzero(pair)
        tree[at[0], width + at[1]] = self.pairs.get(part[at[0], at[1]], part[at[0], at[1] + 1]) << 32 | at[1]
        for level in range(levels - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
        live = np.flatnonzero(tree[:, 1] >> 32 < NONE)
        while len(live):
            best = tree[live, 1]
            here = best & 0xFFFFFFFF
            gone = after[live, here]
            far = after[live, gone]
            part[live, here] = best >> 32
            part[live, gone] = -1
            after[live, here] = far
            inside = far < width
            before[live[inside], far[inside]] = here[inside]
            self._update(tree, levels, live, gone, np.full(len(live), NONE, np.int64))
            right = np.where(inside & (part[live, far] >= 0), part[live, far], -1)
            self._update(tree, levels, live, here, self._rank(part[live, here], right))
            prior = before[live, here]
            has = prior >= 0
            rows = live[has]
            self._update(tree, levels, rows, prior[has], self._rank(part[rows, prior[has]], part[rows, here[has]]))
            live = live[tree[live, 1] >> 32 < NONE]
        ids = part[:, :width]
        kept = ids >= 0
        packed, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return [packed[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), NONE, np.int64)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        out[both] = self.pairs.get(left[both], right[both])
        return out

    @staticmethod
    def _update(tree: np.ndarray, levels: int, rows: np.ndarray, position: np.ndarray, rank: np.ndarray) -> None:
        """Put a new rank at one position of each row's tree and restore the path to the root."""
        flat = tree.reshape(-1)
        row, node = rows * tree.shape[1], position + (1 << levels)
        least = rank << 32 | position
        flat[row + node] = least
        for _ in range(levels):
            least = np.minimum(least, flat[row + (node ^ 1)])
            node = node >> 1
            flat[row + node] = least

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, each piece once: whole tokens by lookup, the others merged by size."""
        out, by_size = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little")
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, group in by_size.items():
            step = max(1, (1 << 14) >> size)
            for k in range(0, len(group), step):
                names, raws = zip(*group[k : k + step], strict=True)
                out.update(zip(names, self.merge(list(raws)), strict=True))
        return out

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts that are already split to pieces."""
        known, new = self.known, set()
        for pieces in texts:
            new.update(pieces)
        new.difference_update(known)
        if len(known) + len(new) > REMEMBERED:  # a new generation; what is still in use moves over from the old one
            self.older, self.known = known, {}
            known = self.known
            new = {p for pieces in texts for p in pieces}
        older = self.older
        unknown = {p for p in new if p not in older}
        known.update((p, older[p]) for p in new - unknown)
        known.update(self.learn(unknown))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        if len(known) > 2 * REMEMBERED:  # one very long text
            self.known, self.older = {}, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Shared:
    """The encoder of this worker process, built once from the broadcast ranks."""

    def __init__(self, ranks) -> None:
        self.ranks = ranks

    def encoder(self) -> Encoder:
        import sys

        held = sys.modules.setdefault("_quarry_bpe", type(sys)("_quarry_bpe"))
        key = f"encoder_{self.ranks.id if hasattr(self.ranks, 'id') else id(self.ranks)}"
        if not hasattr(held, key):
            held.__dict__.clear()
            setattr(held, key, Encoder(self.ranks.value))
        return getattr(held, key)


def _by_size(column: pa.Array, limit: int = 1 << 20):
    """Runs of a column's texts of about ``limit`` characters; null is empty."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= limit:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


class Bpe:
    """``path``: the vocabulary; ``pattern``: what a piece is. ``coded`` gives a text's ids (binary,
    little-endian 32-bit) and the bytes that they decode to, ``decode`` turns ids into bytes."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        tokens.small_batches(spark)
        shared = _Shared(spark.sparkContext.broadcast(read_ranks(path)))

        @F.arrow_udf("ids binary, decoded binary")
        def coded(column: pa.Array) -> pa.Array:
            split, encoder, ids, back = regex.compile(pattern).findall, shared.encoder(), [], []
            for texts in _by_size(column):
                some = encoder.encode([split(t) for t in texts])
                ids += some
                back += map(encoder.decode, some)
            tokens.release()
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["ids", "decoded"])

        @F.arrow_udf("binary")
        def decode(column: pa.Array) -> pa.Array:
            encoder = shared.encoder()
            return pa.array([encoder.decode(ids.as_py() or b"") for ids in column], pa.binary())

        # Not said to be deterministic, so that the optimizer never evaluates it twice.
        self._coded, self._decode = coded.asNondeterministic(), decode

    def coded(self, text: Column) -> Column:
        return self._coded(text.cast("string"))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
