"""Exact token counts at every prefix of a text, for BPE vocabularies whose words carry an end mark.

The vocabulary file (``tokenizers`` JSON, its path is a parameter) says how a text is normalised and
split to words; white space separates words and is in none. A word's bytes are merged pair by pair, the
lowest rank first, and its last byte bears the end mark. Which tokens come out is found here without a
merge, by dynamic programming over prefixes: of all tokens that end at place i exactly one can be the last
token of the encoding of the first i bytes, namely the one that is itself stable and stands stably behind the
last token of the prefix before it; the count at i is the count there plus one. Two neighbours stand
stably if no pair merges across their border while both of its parts exist: the parts along the left
one's right edge and the right one's left edge, each between the rank that makes it and the rank
that takes it up. A table of counts without end mark serves all prefixes, a look at the tokens with it
closes each.

As white space separates words, a text is the list of its chunks between ASCII white space, and its
count the sum of theirs. Each worker keeps the counts of the chunks that it met, in two bounded
generations; that decides speed, never results. Special tokens' strings inside a text are one token
each, as the library has it by default, and are found before anything is normalised.

``counted`` counts whole texts. ``prefix_counts`` gives the counts at every code point of a text in its
composed form (NFC), which for nearly all texts is the text; ``truncated`` is the longest prefix that has
at most a given number of tokens, found in these counts without encoding again. Counts may fall from
one prefix to the next.

Defined cases: null and empty texts have no tokens, and so has white space alone; null stays null in
``truncated``; repeated rows are counted each; an empty table gives no rows. A text is whole in one task and
read in slices; a chunk without white space is whole in memory, and its work is linear in its length.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.llm import tokens

REMEMBERED = 200_000
SLICE = 1 << 22
WHITE = re.compile(rb"[\t-\r ]")
_FOREVER = 1 << 60
#: Words up to so many bytes, so many of them at least and at most at once; pairs that are remembered.
TOGETHER, FEW, AT_ONCE, PAIRS = 32, 256, 50_000, 1 << 20
NO_KEYS = np.full(1, -1, np.int64)
#: The characters that stand for bytes in vocabulary files: printable ones for themselves, the others from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {256 + k: b for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Words of old letters, whose case and composed form no version of Unicode changes; none of them is white space.
LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


class Vocabulary:
    """Tokens, how each is made, and which may stand side by side."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        mark = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not mark or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary with an end mark of words is needed")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in pairs}
        if len(self.parts) != len(pairs):
            raise ValueError("a token that two pairs make")
        if any(len(vocab) <= t for t in vocab.values()) or not all(chr(c) in vocab and chr(c) + mark in vocab for c in [*PRINTED, *BYTES]):
            raise ValueError("a byte without a token")
        self.made = {vocab[a + b]: k for k, (a, b) in enumerate(pairs)}  # single symbols are there from the start
        self.met: dict[int, dict[int, bool]] = {}
        stable: dict[int, bool] = {}
        for token, (a, b) in self.parts.items():  # in the order of ranks, so parts come before wholes
            stable[token] = stable.get(a, True) and stable.get(b, True) and not self._crosses(a, b, self.made[token])
        self.open, self.closed = {}, {}  # stable tokens by their bytes, without and with end mark
        for text, token in vocab.items():
            if stable.get(token, True):
                ended = text.endswith(mark) and text != mark
                (self.closed if ended else self.open)[(text[: -len(mark)] if ended else text).translate(BYTES)] = token
        self.longest, self.longest_closed = max(map(len, self.open)), max(map(len, self.closed))
        self.forward, self.backward = Tree(self.open), Tree({t[::-1]: k for t, k in self.closed.items()})
        self.keys, self.valid = NO_KEYS, np.zeros(1, bool)

    def _edge(self, token: int, side: int, until: int) -> Iterator[tuple[int, int, int]]:
        """The parts along one edge of a token, outermost last: (part, rank that makes it, rank that takes it up)."""
        while True:
            made = self.made.get(token, -1)
            yield token, made, until
            if token not in self.parts:
                return
            token, until = self.parts[token][side], made

    def _crosses(self, a: int, b: int, before: int) -> bool:
        """Whether a pair across the border of ``a`` and ``b`` merges at a rank below ``before``."""
        left = list(self._edge(b, 0, before))
        for x, x_made, x_until in self._edge(a, 1, before):
            for y, y_made, y_until in left:
                k = self.rank.get((x, y), _FOREVER)
                # The leftmost of equal pairs goes first: inside the left token before, inside the right one after.
                if max(x_made, y_made) < k < before and k < x_until and k <= y_until:
                    return True
        return False

    def stands(self, a: int, b: int) -> bool:
        """Whether token b stands stably behind token a."""
        behind = self.met.get(a)
        if behind is None:
            behind = self.met[a] = {}
        known = behind.get(b)
        if known is None:
            if len(self.met) * len(behind) > PAIRS:
                self.met = {a: behind}
            known = behind[b] = not self._crosses(a, b, _FOREVER)
        return known

    def prefixes(self, word: str) -> tuple[list[int], list[int]]:
        """Of a word (a character a byte), without end mark: the last token and the count at every place."""
        tokens, stands, longest = self.open.get, self.stands, self.longest
        last, count = [-1], [0]
        for i in range(1, len(word) + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = tokens(word[j:i])
                if token is not None and (not j or stands(last[j], token)):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        return last, count

    def closing(self, word: str, i: int, table: tuple[list[int], list[int]]) -> int:
        """The count of the first ``i`` bytes of a word as a word of their own."""
        (last, count), tokens = table, self.closed.get
        for j in range(max(0, i - self.longest_closed), i):
            token = tokens(word[j:i])
            if token is not None and (not j or self.stands(last[j], token)):
                return count[j] + 1
        return 0

    def counts(self, words: list[str]) -> list[int]:
        """Counts of words: those of up to ``TOGETHER`` bytes by one pass over all of them, byte by byte."""
        if len(words) < FEW:
            return [self.closing(w, len(w), self.prefixes(w[:-1])) for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for low, high in ((0, 8), (8, 16), (16, TOGETHER)):
            rows = np.flatnonzero((low < sizes) & (sizes <= high))
            for k in range(0, len(rows), AT_ONCE):
                some = rows[k : k + AT_ONCE]
                out[some] = self._together([words[r] for r in some.tolist()], sizes[some], high)
        for r in np.flatnonzero(sizes > TOGETHER).tolist():
            out[r] = self.closing(words[r], len(words[r]), self.prefixes(words[r][:-1]))
        return out.tolist()

    def _together(self, words: list[str], size: np.ndarray, width: int) -> np.ndarray:
        """``prefixes`` and ``closing`` of many words at once."""
        n = len(words)
        raw = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("latin-1"), np.uint8).reshape(n, width).astype(np.int64)
        last, count = np.full((n, width + 1), -1, np.int64), np.zeros((n, width + 1), np.int64)
        for j in range(width - 1):
            rows = np.flatnonzero(size > j + 1)
            state = np.zeros(len(rows), np.int64)
            for i in range(j, width - 1):
                state = self.forward.step(state, raw[rows, i])
                on = (state >= 0) & (size[rows] > i + 1)
                rows, state = rows[on], state[on]
                if not len(rows):
                    break
                token = self.forward.token[state]
                met = np.flatnonzero((token >= 0) & (last[rows, i + 1] < 0))
                if j:
                    met = met[self._stand(last[rows[met], j], token[met])]
                last[rows[met], i + 1] = token[met]
                count[rows[met], i + 1] = count[rows[met], j] + 1
        rows, out = np.arange(n), np.zeros(n, np.int64)
        state, at = np.zeros(n, np.int64), size.copy()
        while len(rows):
            at = at - 1
            state = self.backward.step(state, raw[rows, at])
            on = state >= 0
            rows, state, at = rows[on], state[on], at[on]
            token = self.backward.token[state]
            met = np.flatnonzero(token >= 0)
            inner = at[met] > 0
            met = np.r_[met[~inner], met[inner][self._stand(last[rows[met[inner]], at[met[inner]]], token[met[inner]])]]
            out[rows[met]] = count[rows[met], at[met]] + 1
            on = (out[rows] == 0) & (at > 0)
            rows, state, at = rows[on], state[on], at[on]
        return out

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stands`` of many pairs."""
        keys = a << 32 | b
        at = np.searchsorted(self.keys, keys)
        new = np.unique(keys[self.keys[np.minimum(at, len(self.keys) - 1)] != keys])
        if len(new):
            held = len(self.keys) + len(new) <= PAIRS
            old, valid = (self.keys, self.valid) if held else (NO_KEYS, NO_KEYS == 1)
            wanted = new if held else np.unique(keys)
            said = np.array([self.stands(*divmod(k, 1 << 32)) for k in wanted.tolist()], bool)
            order = np.argsort(np.r_[old, wanted], kind="stable")
            self.keys, self.valid = np.r_[old, wanted][order], np.r_[valid, said][order]
            at = np.searchsorted(self.keys, keys)
        return self.valid[at]


class Tree:
    """Byte strings as a tree: its edges stand in one table, found by (node, byte)."""

    def __init__(self, tokens: dict[str, int]) -> None:
        edges: dict[int, int] = {}
        ends = [-1]
        for text, token in tokens.items():
            node = 0
            for ch in text:
                key = node << 8 | ord(ch)
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = token
        self.token = np.array(ends, np.int64)
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys, rest = np.fromiter(edges, np.int64, len(edges)), np.arange(len(edges))
        to, slot = np.fromiter(edges.values(), np.int64, len(edges)), self._slot(keys)
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot[rest]] == keys[rest]
            self.to[slot[rest[mine]]] = to[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(tokens.BASE)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the edges lead; -1 where there is none."""
        keys = node << 8 | byte
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[rest]]
            mine = there == keys[rest]
            out[rest[mine]] = self.to[slot[rest[mine]]]
            rest = rest[~mine & (there >= 0)]
        return out


class Counter:
    """Counts tokens of texts by one vocabulary file's content."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(content)
        library = Tokenizer.from_str(content)
        self.normalize = library.normalizer.normalize_str if library.normalizer is not None else lambda s: s
        self.split = library.pre_tokenizer.pre_tokenize_str
        if any(" " in w for w, _ in self.split(self.normalize("a  b\tc"))) or len(self.split(self.normalize("a  b\tc"))) != 3:
            raise ValueError("a vocabulary in which white space only separates words is needed")
        self.vocabulary = Vocabulary(spec)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = set(special)
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.latin = self._latin(spec)
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.words: dict[str, int] = {}
        self.older_words: dict[str, int] = {}

    def _segments(self, chunk: str) -> list[str]:
        return [s for s in self.specials.split(chunk) if s] if self.specials and self.specials.search(chunk) else [chunk]

    @staticmethod
    def _latin(spec: dict):
        """How Latin text in lower case is split, if the file only composes, lowers and splits by a pattern."""
        steps, own = spec["normalizer"] or {}, spec["pre_tokenizer"]
        plain = [n["type"] for n in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        parts = own.get("pretokenizers", [])
        if not plain or [p["type"] for p in parts] != ["Split", "ByteLevel"] or not parts[0]["invert"] or parts[0]["behavior"] != "Removed" or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return None
        return regex.compile(parts[0]["pattern"]["Regex"] + "|\n").findall

    def _words(self, s: str) -> list[str]:
        """The words of a segment, a character a byte."""
        return [w.translate(BYTES) for w, _ in self.split(self.normalize(s))]

    def _learn(self, chunks: list[bytes]) -> None:
        """The counts of chunks without ASCII white space, by the words in them."""
        parts: list = [None] * len(chunks)
        texts = b"\n".join(chunks).decode("utf-8", "replace").split("\n") if chunks else []
        plain = [k for k, s in enumerate(texts) if LATIN.fullmatch(s)] if self.latin is not None else []
        if self.specials is not None:
            plain = [k for k in plain if self.specials.search(texts[k]) is None]
        if plain:  # all of them in one go, a line each
            words, at = [], iter(plain)
            for w in self.latin("\n".join(texts[k] for k in plain).lower() + "\n"):
                if w == "\n":
                    parts[next(at)] = (0, words)
                    words = []
                else:
                    words.append(w if w.isascii() else w.encode("utf-8").decode("latin-1"))
        for k, part in enumerate(parts):
            if part is None:
                segments = self._segments(texts[k])
                special = sum(s in self.special for s in segments)
                parts[k] = (special, [w for s in segments if s not in self.special for w in self._words(s)])
        new = {w for _, words in parts for w in words}
        known, older = self.words, self.older_words
        new.difference_update(known)
        if older:
            known.update((w, older[w]) for w in new if w in older)
            new.difference_update(older)
        ordered = list(new)
        known.update(zip(ordered, self.vocabulary.counts(ordered), strict=True))
        self.known.update((c, special + sum(map(known.__getitem__, words))) for c, (special, words) in zip(chunks, parts, strict=True))
        if len(known) > REMEMBERED:
            self.older_words, self.words = ({}, {}) if len(known) > 3 * REMEMBERED else (known, {})

    def chunk(self, chunk: str) -> int:
        """The count of a chunk without ASCII white space."""
        return self._sums([[chunk.encode("utf-8", "replace")]])[0]

    def _sums(self, texts: list[list[bytes]]) -> list[int]:
        """The counts of texts, each a list of chunks."""
        known, older = self.known, self.older
        new = {c for chunks in texts for c in chunks}
        new.difference_update(known)
        if older:
            known.update((c, older[c]) for c in new if c in older)
            new.difference_update(older)
        self._learn(list(new))
        out = [sum(map(known.__getitem__, chunks)) for chunks in texts]
        if len(known) > REMEMBERED:
            self.older, self.known = ({}, {}) if len(known) > 3 * REMEMBERED else (known, {})
        return out

    def counts(self, texts: Iterable[bytes]) -> list[int]:
        """The counts of texts in UTF-8, worked on in slices."""
        out, group, size = [], [], 0
        for n, text in enumerate(texts):
            out.append(0)
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > SLICE and (cut := WHITE.search(text, at + SLICE)):
                    end = cut.start()
                group.append((n, text[at:end].split()))
                size += end - at
                at = end
                if size >= SLICE:
                    self._add(out, group)
                    group, size = [], 0
        self._add(out, group)
        return out

    def _add(self, out: list[int], group: list[tuple[int, list[bytes]]]) -> None:
        for (n, _), count in zip(group, self._sums([chunks for _, chunks in group]), strict=True):
            out[n] += count

    def count(self, text: bytes) -> int:
        return self.counts([text])[0]

    def prefixes(self, text: str) -> tuple[str, np.ndarray]:
        """The composed text and the counts of all its prefixes, from the empty one."""
        out, counts, total = [], [0], 0
        for chunk in re.split(r"([\t-\r ]+)", text):
            if chunk and chunk[0] in "\t\n\x0b\x0c\r ":
                out.append(chunk)
                counts += [total] * len(chunk)
            elif chunk:
                whole, own = self._chunk_prefixes(chunk)
                out.append(whole)
                counts += [total + c for c in own]
                total = counts[-1]
        return "".join(out), np.array(counts, np.int64)

    def _chunk_prefixes(self, chunk: str) -> tuple[str, list[int]]:
        """The composed chunk and the counts of its prefixes from the first code point on."""
        done, counts, total = "", [], 0
        for s in self._segments(chunk):
            if s in self.special:  # begun, it is ordinary text that goes on from what stands before it
                counts += [self.chunk(done + s[:k]) for k in range(1, len(s))]
                total += 1
                counts.append(total)
            else:
                s = unicodedata.normalize("NFC", s)
                own = self._plain_prefixes(s)
                counts += [total + c for c in own]
                total = counts[-1]
            done += s
        return done, counts

    def _plain_prefixes(self, s: str) -> list[int]:
        lower = [self.normalize(ch) for ch in s]
        whole = self.normalize(s)
        if "".join(lower) != whole:  # a library of other Unicode tables: each prefix by itself
            return [self.chunk(s[:k]) for k in range(1, len(s) + 1)]
        at = np.cumsum([len(x) for x in lower]).tolist()
        by_place, total, behind = {}, 0, 0
        for word, (a, b) in self.split(whole):
            by_place.update((k, total) for k in range(behind, a + 1))
            ends = np.cumsum([len(ch.encode("utf-8", "surrogatepass")) for ch in whole[a:b]]).tolist()
            word = word.translate(BYTES)
            table = self.vocabulary.prefixes(word)
            for k, end in enumerate(ends, 1):
                if b - a <= 4 and k < b - a:  # a contraction that isn't whole is split elsewhere
                    n = sum(self.vocabulary.counts([w.translate(BYTES) for w, _ in self.split(whole[a : a + k])]))
                else:
                    n = self.vocabulary.closing(word, end, table)
                by_place[a + k] = total + n
            total, behind = by_place[b], b
        by_place.update((k, total) for k in range(behind, len(whole) + 1))
        return [by_place[k] for k in at]

    def truncated(self, text: str, limit: int) -> str:
        whole, counts = self.prefixes(text)
        return whole[: int(np.flatnonzero(counts <= limit)[-1])] if limit >= 0 else ""


class _Shared:
    """The counter of this worker process, built once from the broadcast file."""

    def __init__(self, content) -> None:
        self.content = content

    def counter(self) -> Counter:
        held = sys.modules.setdefault("_quarry_counts", type(sys)("_quarry_counts"))
        key = f"counter_{self.content.id if hasattr(self.content, 'id') else id(self.content)}"
        if not hasattr(held, key):
            held.__dict__.clear()
            setattr(held, key, Counter(self.content.value))
        return getattr(held, key)


class TokenCounts:
    """Columns of token counts by the vocabulary file at ``path``, which is sent by broadcast."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        tokens.small_batches(spark)
        with open(path, encoding="utf-8") as file:
            shared = _Shared(spark.sparkContext.broadcast(file.read()))

        @F.arrow_udf("long")
        def counted(column: pa.Array) -> pa.Array:
            counter = shared.counter()
            out = pa.array(counter.counts(t.as_py() or b"" for t in column), pa.int64())
            tokens.release()
            return out

        @F.arrow_udf("array<long>")
        def prefix_counts(column: pa.Array) -> pa.Array:
            counter = shared.counter()
            return pa.array([counter.prefixes(t or "")[1].tolist() for t in column.to_pylist()], pa.list_(pa.int64()))

        @F.arrow_udf("string")
        def truncated(column: pa.Array, limit: pa.Array) -> pa.Array:
            counter = shared.counter()
            return pa.array([None if t is None else counter.truncated(t, n) for t, n in zip(column.to_pylist(), limit.to_pylist(), strict=True)], pa.string())

        self._counted, self._prefix_counts, self._truncated = counted.asNondeterministic(), prefix_counts, truncated

    def counted(self, text: Column) -> Column:
        return self._counted(text.cast("binary"))

    def prefix_counts(self, text: Column) -> Column:
        return self._prefix_counts(text.cast("string"))

    def truncated(self, text: Column, limit: int) -> Column:
        """The longest prefix of the composed text with at most ``limit`` tokens."""
        return self._truncated(text.cast("string"), F.lit(limit))

    def within(self, text: Column, limit: int) -> Column:
        return self.counted(text) <= limit
