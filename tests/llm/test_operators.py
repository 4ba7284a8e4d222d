"""Each operator against a brute-force version, and its defined cases, on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, chat_format, html_text, language_id, lz_fingerprint, mixing, ngram_join, substring_dedup, toxicity, vector_search

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, token string"


def table(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t or ""), 1, "x") for k, t in enumerate(texts)], DOCS)


def prose(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "  \n\t ", "one", "two words", "  é日本🙂", "x" * 3000]


def test_substring_dedup(spark):
    a, b = prose(60, 1), prose(50, 2)
    texts = [*ODD, a, b + " " + a, a, f"{b}\n{b}", "z " * 50]
    docs = table(spark, texts).repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, 20).collect()}
    seen = set()
    for k, t in enumerate(texts):
        words, gone = WORDS.findall(t or ""), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        assert (got[k]["n_words"], got[k]["n_removed"]) == (len(words), len(gone))
        assert got[k]["kept_text"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert sum(s["behind"] - s["first"] for s in got[k]["removed"]) == len(gone)


def thue_morse(n, a, b):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_long_words_that_cancel_modulo_powers_of_two(spark):
    one, other = thue_morse(1024, "a", "b")
    tail = prose(19, 1)
    docs = table(spark, [f"{one} {tail}", f"{other} {tail}"])
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(docs, 20).collect()] == [0, 0]
    docs = table(spark, [f"{one} x", f"{other} x"])
    assert sorted(r["component_id"] for r in ngram_join.join_components(docs).collect()) == [0, 1]


def test_substring_dedup_in_two_steps(spark, monkeypatch):
    texts = [prose(60, k % 17) + " " + prose(40, k) for k in range(60)] * 2 + ["z " * 90]
    docs = table(spark, texts).repartition(4)
    plain = lambda: sorted(map(str, substring_dedup.substring_dedup(docs, 20).collect()))
    want = plain()
    monkeypatch.setattr(substring_dedup, "COARSE", 2)
    monkeypatch.setattr(substring_dedup, "FINE", 4)
    monkeypatch.setattr(substring_dedup, "FLUSH", 700)
    assert plain() == want


def test_substring_dedup_of_shared_ids(spark):
    x, y = prose(60, 1), prose(60, 2)
    rows = [(1, x), (5, x), (5, y), (None, y), (None, x), (9, f"{x} {y}"), (9, f"{x} {y}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 20, untouched=True).collect()
    # Null ids come first; the two rows of null differ from each other, so each is the first of its text.
    left = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got)
    assert left == [(0, 60, 0), (0, 60, 0), (1, 60, 60), (5, 60, 60), (5, 60, 60), (9, 120, 120), (9, 120, 120)]
    alone = spark.createDataFrame([(1, x), (5, x), (5, y)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(alone, 20).collect()) == [(1, 0), (5, 0), (5, 60)]
    assert substring_dedup.substring_dedup(alone.limit(0), 20).count() == 0
    tied = spark.createDataFrame([(3, "a\t b"), (4, "c")], "doc_id long, text string")
    assert sorted(r["kept_text"] for r in substring_dedup.substring_dedup(tied, 20, untouched=True).collect()) == ["a\t b", "c"]


def test_ngram_join(spark):
    base = prose(120, 3).split()
    near = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (5, 50, 100)]
    texts = [*ODD, " ".join(base), *near, "  ".join(base).upper(), prose(100, 4), "one"] + [" ".join(base[:k] + [f"q{k}"] + base[k + 1 :]) for k in range(8, 90)] * 3
    docs = table(spark, texts)
    for width, percent in ((3, 90), (5, 80)):
        sets = []
        for t in texts:
            w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))})
        root = list(range(len(texts)))
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs, width, percent).collect()}
        assert got == {k: (len(s), root[k]) for k, s in enumerate(sets)}


def test_ngram_join_without_ids(spark):
    base = prose(120, 3).split()
    texts = [" ".join(base), " ".join([*base, "new"]), prose(90, 5), None]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, " ".join(["old", *base]))], "doc_id long, text string")
    got = sorted((r["n_shingles"], r["component_id"] or 0) for r in ngram_join.join_components(docs).collect())
    assert got == [(0, 0), (88, 0), (118, 7), (119, 7), (119, 7)]


def test_bitmaps_bound_the_difference():
    draw = np.random.default_rng(2)
    for sizes in ((300, 40, 10), (250, 200, 300), (5, 1, 0)):
        both, one, two = (draw.integers(0, 1 << 63, k).astype(np.uint64) for k in sizes)
        a, b = np.r_[both, one], np.r_[both, two]
        (x, m), (y, n) = ((int.from_bytes(ngram_join.bitmap(s), "little"), 8 * len(ngram_join.bitmap(s))) for s in (a, b))
        to = min(m, n)
        assert (ngram_join.fold(x, m, to) ^ ngram_join.fold(y, n, to)).bit_count() <= len(one) + len(two)


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(5, 4), (4, 2), (9, 9), (None, 3), (8, None), (5, 4), (11, 10), (12, 11), (13, 12)], "a long, b long")
    assert {r["node"]: r["root"] for r in ngram_join.components(edges).collect()} == {2: 2, 4: 2, 5: 2, 9: 9, 10: 10, 11: 10, 12: 10, 13: 10}
    assert ngram_join.components(edges.limit(0)).count() == 0


def test_overlaps_and_forest():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 40, 20).astype(np.uint64)) for _ in range(12)]
    both = ngram_join.overlaps(sets, 5)
    assert all(both[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(5) for j in range(12) if i != j)


def legal_turns(roles):
    """Every repair of raw roles by the book: (cost, [(role, source turns)])."""
    names = ("system", "user", "assistant")
    follows = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    ways = [(0, ())]
    for raw in roles:
        more = []
        for cost, turns in ways:
            last = turns[-1][0] if turns else None
            for role in names:
                own = cost + (0 if role == raw else 2)
                if role == last:
                    more.append((own + 1, (*turns[:-1], (role, turns[-1][1] + 1))))
                if role in follows[last]:
                    more.append((own, (*turns, (role, 1))))
                for empty in follows[last]:
                    if role in follows[empty]:
                        more.append((own + 3, (*turns, (empty, 0), (role, 1))))
        ways = more
    return ways


def test_chat_repair_is_cheapest():
    draw = random.Random(5)
    for _ in range(80):
        roles = [draw.choice(["user", "assistant", "system", None, "tool"]) for _ in range(draw.randrange(1, 6))]
        (entry, leave, begun), = chat_format.through([chat_format.transfer(roles)])
        repaired = chat_format.repair([(r, "t") for r in roles], entry, leave)
        cost = sum(x[2] for x in repaired)
        found = (cost, tuple((r, len(t)) for r, t, _, _ in repaired))
        ways = legal_turns([r if r in chat_format.ROLES else None for r in roles])
        assert begun == 0 and cost == min(w[0] for w in ways) and found in ways
        for k in range(1, len(roles)):  # cut anywhere, the same turns
            borders = chat_format.through([chat_format.transfer(roles[:k]), chat_format.transfer(roles[k:])])
            one, two = (chat_format.repair([(r, "t") for r in part], *b[:2]) for part, b in zip((roles[:k], roles[k:]), borders, strict=True))
            assert borders[1][2] == len(one)
            if two[0][3]:
                one[-1] = (one[-1][0], one[-1][1] + two[0][1], one[-1][2] + two[0][2], False)
                two = two[1:]
            assert one + two == repaired


def test_chat_format(spark):
    draw = random.Random(7)
    turns = [("user", "a"), ("user", "b"), (None, "c"), ("tool", "d"), ("assistant", None), ("system", "e"), ("user", "")]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, "assistant", "x" * 100_000)] + [(None, None, "user", "n")] + [(3, k // 2, "user" if k % 3 else "assistant", str(k)) for k in range(40)]
    rows += [(4, k, "user", f"m{k}") for k in range(6)] + [(5, k, draw.choice(["user", "assistant"]), f"t{k}") for k in range(300)] + [(6, None, "user", f"u{k}") for k in range(20)]
    rows += [(7, 1, "user", "same")] * 3 + [(None, 3, "assistant", "y")]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, rendered string").repartition(3)
    shown = lambda segment: sorted(map(tuple, chat_format.format_chats(docs, segment).collect()), key=lambda r: (r[0] or 0, r[1]))
    got = shown(256)
    assert got == shown(2) == shown(7)
    for chat in (1, 2, 3, 4, 5, 6, 7, None):
        mine = [r for r in got if r[0] == chat]
        raw = sorted((r for r in rows if r[0] == chat), key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or "", r[3] is None, r[3] or ""))
        assert [r[1] for r in mine] == list(range(len(mine)))
        state = chat_format.START
        for r in mine:
            now = chat_format.ROLES.index(r[2]) + 1
            assert now in chat_format.LEGAL[state] and r[4] == f"<|{r[2]}|>\n{r[3]}\n"
            state = now
        assert sum(r[5] for r in mine) == len(raw)
        if chat != 6:
            assert [t for r in mine if r[5] for t in (r[3].split("\n") if r[5] > 1 else [r[3]])] == [r[3] or "" for r in raw]
        if len(raw) <= 7:
            best = legal_turns([r[2] if r[2] in chat_format.ROLES else None for r in raw])
            assert sum(r[6] for r in mine) == min(w[0] for w in best)
    assert [r[3] for r in got if r[0] == 4] == ["\n".join(f"m{k}" for k in range(6))]
    assert chat_format.format_chats(docs.limit(0)).collect() == []


def test_vector_search(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 8))
    x[200:260] = x[0]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 8), (1100, [math.nan] + [1.0] * 7), (1150, [1.0, None] + [1.0] * 6), (1200, [])]
    got = {}
    for r in vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), centroids=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 300, 50):
        want = sorted((-round(float(unit[q] @ unit[k]), 9), k) for k in range(300) if k != q)[:5]
        assert got[q] == [k for _, k in want]
    assert vector_search.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vector_search_of_odd_vectors(spark):
    kinds = "vec_id long, embedding array<double>, rank int"
    rows = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (50, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [0.0, 5.0])]
    rows += [(4, [1.0, 1.1]), (4, [1.0, 1.2]), (4, [1.0, 1.2]), (50, [3.0, 1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.5]), (None, [1.0, 1.0]), (200, [2.0] * 4000), (5, [2.0] * 3999 + [1.0])]
    got = {}
    for r in vector_search.search(spark.createDataFrame([(*r, 0) for r in rows], kinds), centroids=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    cosine = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)
    assert got[0] == [(50, 1.0), (4, cosine([1, 1], [1, 1.1])), (4, cosine([1, 1], [1, 1.2])), (1, cosine([1, 1], [1, 2])), (2, cosine([1, 1], [1, 0]))]
    assert [v for v, _ in got[50]] == [0, 4, 4, 1, 2] and got[100] == [(7, cosine([1, 2, 3], [1, 2, 3.5])), (50, cosine([1, 2, 3], [3, 1, 2]))]
    assert [v for v, _ in got[200]] == [5] and set(got) == {0, 50, 100, 200}


def test_vector_search_recall(spark):
    x = np.random.default_rng(4).normal(size=(10_000, 64))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 10_000, 50):
        score = unit @ unit[q]
        score[q] = -2
        assert got[q] == np.argsort(-score, kind="stable")[:5].tolist()


def test_bpe(spark):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, prose(200, 6), "<|endoftext|> aaaaaaaaab!!!! ??\n\n  x", "ŝŭĉ " * 9, "abz" * 7000, "!?" * 3000]
    coder = bpe.Bpe(spark, path, P.PATTERN)
    docs = table(spark, texts).union(table(spark, texts[:3]))
    rows = docs.select("doc_id", coder.coded(F.col("text")).alias("c")).select("doc_id", "c.*", F.sha2("c.ids", 256))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"coded\(", plan.split("ArrowEvalPython")[1].split("]")[0])) == 1 and plan.count("ArrowEvalPython") == 1
    got = rows.withColumn("back", coder.decode(F.col("ids"))).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == known.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["back"]) == bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    assert docs.limit(0).select(coder.coded(F.col("text")).alias("c")).collect() == []


def test_bpe_memory_of_pieces(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    small, fresh = bpe.Encoder(ranks), bpe.Encoder(ranks)
    for k in range(30):
        pieces = [[" " + w for w in prose(30, k).split()], ["x" * (k + 1)]]
        assert small.encode(pieces) == [b"".join(fresh.learn({p})[p] for p in ps) for ps in pieces]
        assert len(small.known) <= 80 and len(small.older) <= 80


def test_mixing(spark):
    draw = random.Random(3)
    rows = [(k, None if k == 7 else prose(draw.randrange(0, 90), k), "en", ["a", "b", "c", "d", None, "tiny"][min(draw.randrange(9), 5) if k else 5], 0, 1, "x") for k in range(300)]
    rows.append(rows[20])
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs, block=64).collect()
    size = {s: sum(len(WORDS.findall(r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if 3 * size[s] < level * weight[s]]
        target |= {s: 3.0 * size[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(3 * size[s] for s in full)
        free = free - set(full) if full else set()
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] and 0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 3 * mixing.block_of(round(target[s]), 64)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5), block=64).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_language_id(spark):
    rows = [(k, (("der und die nicht ist " if k % 2 else "the and of with that ") * 8) + prose(5, k), "de" if k % 2 else "en", "s", 0, 1, "x") for k in range(200)]
    rows += [(900 + k, t, None, "s", 0, 1, "x") for k, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    held = [k for k in range(200) if got[k]["held_out"]]
    assert held and np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) >= 0.95
    assert [got[900 + k]["lang_pred"] == "und" for k in range(5)] == [True, True, True, False, False]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(table(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def phrases(text):
    """The phrases of an LZ78 parse, by the book."""
    seen, at = set(), ""
    for c in text:
        at += c
        if at not in seen:
            seen.add(at)
            at = ""
    return seen


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(spark, rows, order):
    """``order``: the rows as their documents follow each other."""
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, extra string")
    got = lz_fingerprint.with_neighbours(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    left = sorted(((r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r) for r in got), key=lambda x: x[:3])
    want = []
    for k, (doc, t) in enumerate(order):
        t, then = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + then[:q]
        want.append((doc or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, then))
    for (*a, r), (*b, t, edited, then) in zip(left, sorted(want), strict=True):
        assert a == b
        assert r["fingerprint"] == lz_fingerprint.as_text(lz_fingerprint.signature(t))
        assert r["edited_fingerprint"] == lz_fingerprint.as_text(lz_fingerprint.signature(edited))
        own = phrases(t)
        assert abs(r["near_edited"] - jaccard(own, phrases(edited))) <= 0.18
        assert abs(r["near_next"] - jaccard(own, phrases(then))) <= 0.18


def test_lz_fingerprint(spark):
    texts = [*ODD, prose(300, 8), prose(300, 9), prose(300, 8), "日本語の文" * 90, "ab" * 40_000, prose(40, 3), prose(40, 3).replace(" ", "\t")]
    texts += [prose(60 + k, 50 + k % 7) for k in range(40)]
    rows = list(enumerate(texts))
    check_fingerprints(spark, rows, rows)
    check_fingerprints(spark, [(None, prose(90, 1))], [(None, prose(90, 1))])
    check_fingerprints(spark, [(4, None)], [(4, None)])
    shared = [(7, prose(50, 1)), (7, prose(50, 2)), (None, prose(70, 3)), (None, prose(60, 4)), (9, "end"), (9, "end"), (1, "")]
    hashes = {t: h for t, h in spark.createDataFrame(shared, "d long, t string").select("t", F.xxhash64(F.col("t"))).collect()}
    check_fingerprints(spark, shared, sorted(shared, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]])))
    assert lz_fingerprint.with_neighbours(table(spark, texts).limit(0)).count() == 0


def test_lz_likeness_is_that_of_the_phrase_sets():
    draw = random.Random(4)
    for size in (5, 60, 900, 9000):
        one = "".join(draw.choice("abcdefgh ") for _ in range(size))
        for other in (one, "x" + one, one[: size // 2] + one[: size // 2][::-1], one.replace(" ", "\n")):
            got = lz_fingerprint.likeness(lz_fingerprint.signature(one), lz_fingerprint.signature(other))
            assert abs(got - jaccard(phrases(one), phrases(other))) <= 0.16
    empty = lz_fingerprint.signature("")
    assert lz_fingerprint.likeness(empty, empty) == 1 and lz_fingerprint.likeness(empty, lz_fingerprint.signature("a")) == 0
    parse = lz_fingerprint.Parse()
    parse.read("aababb")
    assert len(parse.hashes) == 4  # a, ab, abb


def test_lz_likeness_of_long_texts():
    draw = np.random.default_rng(12)
    text = lambda letters, n: "".join(np.array(list(letters))[draw.integers(0, len(letters), n)])
    for n in (50_000, 200_000, 1_000_000):
        one, other = text("abcdefgh", n), text("ijklmnop", n)
        assert not phrases(one) & phrases(other)
        assert lz_fingerprint.likeness(lz_fingerprint.signature(one), lz_fingerprint.signature(other)) == 0
    for n in (50_000, 1_000_000):
        one = text("abcdefgh", n)
        for other in (one[: n // 2] + text("ijklmnop", n // 2), text("abcdefgh", n)):
            want = jaccard(phrases(one), phrases(other))
            got = lz_fingerprint.likeness(lz_fingerprint.signature(one), lz_fingerprint.signature(other))
            assert abs(got - want) <= 3 * math.sqrt(want * (1 - want) / lz_fingerprint.MINIMA)


def test_language_gradients():
    draw = np.random.default_rng(3)
    net = language_id.Network(["a", "b", "c"])
    net.weights = {k: v.astype("f8") for k, v in net.weights.items()}
    windows, left = draw.integers(1, 200, (5, language_id.WINDOW)).astype(np.uint8), np.array([64, 30, 1, 64, 7])
    truth = np.array([0, 1, 2, 1, 0])

    def loss():
        x = np.ascontiguousarray(windows.T)
        f, b = net.states(x, "f")[0].astype("f8"), net.states(x, "b")[0].astype("f8")
        total = sum(-(np.log(net.label(x, np.concatenate([f[t], b[t]]))[truth, np.arange(5)]) * (left > t)).sum() for t in range(language_id.WINDOW))
        return total / left.sum()

    grads = net.gradients(windows, left, truth)
    for name, w in net.weights.items():
        for _ in range(6):
            at = tuple(draw.integers(0, n) for n in w.shape)
            if name.startswith("bytes"):
                at = (at[0], int(windows[0, 3]))
            keep = w[at]
            w[at] = keep + 1e-2
            up = loss()
            w[at] = keep - 1e-2
            down = loss()
            w[at] = keep
            assert abs((up - down) / 2e-2 - grads[name][at]) < 3e-3 * max(1, abs(grads[name][at]))


def test_language_sample(spark):
    rows = [(k, f"text {k}", "rare" if k % 100 == 0 else "often") for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    some = language_id.training_sample(docs, 400, 100)
    n = sum(lang == "rare" for lang, _ in some)
    assert 300 <= len(some) <= 400 and 0.25 * len(some) <= n and some == language_id.training_sample(docs.repartition(3), 400, 100)
    assert language_id.training_sample(docs.limit(0), 400, 100) == []


def test_language_id_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = language_id.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    right, n = said.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 100 and right >= 0.97 * n


def test_language_id_of_repeated_and_odd_rows(spark):
    rows = [(5, "the and of with that", "en"), (5, "the and of with that", "en"), (None, "der und die", "de"), (6, None, None), (7, "123 !", "en"), (8, "der und die " * 9000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()))
    assert len(got) == 6 and got[1] == got[2] and [g[1] for g in got[3:5]] == ["und", "und"]
    assert language_id.identify(docs.limit(0)).collect() == []


def test_html_text():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use</div><div><h1>Head &amp; shoulders</h1><p>" + "word " * 40 + "<p>short<br>line</p><script>var a='</p>'</script></div><div id='comments'><p>" + "nice " * 60 + "</p></div><footer>c</footer>"
    assert html_text.main_text(page) == "Head & shoulders\n\n" + " ".join(["word"] * 40) + "\n\nshort line"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""


def test_html_text_keeps_lists_and_short_paragraphs():
    long, item = "<p>" + "word " * 80 + "</p>", "<li>an item of the list</li>"
    inner = long * 5 + "<ul>" + item * 8 + "</ul>" + long * 6
    kept = html_text.main_text(f"<body><nav><a href=x>Home</a></nav><div>{inner}</div><footer>c</footer></body>").split("\n\n")
    assert kept == [" ".join(["word"] * 80)] * 5 + ["an item of the list"] * 8 + [" ".join(["word"] * 80)] * 6
    short = [f"Paragraph {k} is of an ordinary, short length." for k in range(12)]
    paragraphs = [*short[:6], "x " * 20_000, *short[6:]]
    kept = html_text.main_text("<body><div>" + "".join(f"<p>{t}</p>" for t in paragraphs) + "</div></body>").split("\n\n")
    assert kept == [t.strip() for t in paragraphs]


def test_html_text_keeps_short_ends_of_a_mark():
    ends = "<p>Hi.</p><p>Go on.</p>", "<p>So.</p><p>The end.</p>"
    page = "<body><p>Outside</p><article>" + ends[0] + "<p>" + "word " * 80 + "</p>" + ends[1] + "</article></body>"
    assert html_text.main_text(page).split("\n\n") == ["Hi.", "Go on.", " ".join(["word"] * 80), "So.", "The end."]


LONG = "A sentence of the article stands here, and goes on for a while. " * 4


def test_html_text_loses_no_part_of_an_article():
    said = LONG.strip()
    inside = [
        ('<h2 id="related-work">Related work</h2>', "Related work"), ('<section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section>', "Discussion\n\nWe discuss."), ('<p id="navigation-systems">On ships.</p>', "On ships."),
        ('<div class="social-history"><p>Of towns.</p></div>', "Of towns."), ('<div class="commentary"><p>Verse by verse.</p></div>', "Verse by verse."), ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>", "Let x=2 hold."),
        ("<p><label>Figure 1</label></p>", "Figure 1"), ('<p><a href="/x">See the whole report</a></p>', "See the whole report"), ('<div style="display: none"><p>Unseen.</p></div>', ""), ('<div class="share"><p>Share this</p></div>', ""), ('<div class="comments"><p>First!</p></div>', ""),
    ]
    for part, want in inside:
        page = f"<body><nav><a href=/>Home</a></nav><article><p>{LONG}</p>{part}<p>{LONG}</p></article><footer>c</footer></body>"
        assert html_text.main_text(page).split("\n\n") == [said, *(want.split("\n\n") if want else []), said], part


def test_html_text_of_unmarked_pages_and_teasers():
    said = LONG.strip()
    ends = ["short one", "short two", "short three", "bye"]
    page = "<body><nav><a href=/>Home</a></nav><div>" + f"<p>{LONG}</p>" * 3 + "".join(f"<p>{t}</p>" for t in ends) + "</div><footer>c</footer></body>"
    assert html_text.main_text(page).split("\n\n") == [said] * 3 + ends
    page = f"<body><article><p>{LONG}</p></article><div>" + f"<p>{LONG}</p>" * 3 + "</div></body>"
    assert html_text.main_text(page).split("\n\n") == [said] * 4
    section = '<section id="discussion"><h2>Discussion</h2>' + f"<p>{LONG}</p></section>"
    assert html_text.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p>{section}</div></body>").split("\n\n") == [said, said, "Discussion", said]
    replies = '<section id="discussion">' + "".join(f'<div class="reply"><time>today</time><p>{LONG}</p></div>' for _ in range(3)) + "</section>"
    assert html_text.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{replies}</body>").split("\n\n") == [said, said]


def plain_lines(weight, share, window):
    """First and last line whose window reaches the threshold, by the book."""
    sums = [sum(min(w, html_text.LINE) for w in weight[max(0, k - window // 2) : k + window // 2 + 1]) for k in range(len(weight))]
    some = [k for k, w in enumerate(weight) if w and sums[k] >= max(1, share * max(sums))]
    return some[0], some[-1]


def test_html_text_is_between_surge_and_dive():
    draw = random.Random(21)
    for _ in range(60):
        sizes = [draw.choice([3, 8, 60, 200]) for _ in range(draw.randrange(3, 30))]
        texts = [f"{'x' * n} {k}" for k, n in enumerate(sizes)]
        page = "<body>" + "".join(f"<div><p>{t}</p></div>" for t in texts) + "</body>"  # a block each, so that nothing is next to the dive
        first, last = plain_lines([len(t) for t in texts], html_text.SHARE, html_text.WINDOW)
        assert html_text.main_text(page).split("\n\n") == texts[first : last + 1]


def test_html_text_through_spark(spark):
    def page(body):
        return "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>" + body + "<footer>Imprint</footer></body></html>"

    long = ["Sentence number %d of paragraph %d stands here. " % (j, k) * 3 for k in range(4) for j in range(2)]
    inner = "".join(f"<p>{t}</p>" for t in long)
    want = "\n\n".join(" ".join(t.split()) for t in long)
    cases = [
        (page(f"<div title='the hidden valley'>{inner}</div>"), want), (page(f"<div class='post social-history'><article>{inner}</article></div>"), want),
        (page(f"<article><p>Teaser.</p></article><div>{inner}</div>"), None), (page(f"<div>{inner}</div><div hidden><p>{'secret ' * 80}</p></div>"), want),
        (page(f"<main>{inner}</main><section id=comments><article><p>{'I agree. ' * 300}</p></article></section>"), want), (page(f"<div>{inner}</div><a <a <a "), None),
        (page(f"<div><p>x &lt; y &amp; a &#233; b</p>{inner}</div>"), "x < y & a é b\n\n" + want), (page(f"<div>{inner}</div><script>if (a<b) document.write('<p>{'no ' * 90}</p>')</script>"), want),
        (None, ""), ("", ""), ("<nav>x</nav>", ""), ("<p>" + "long " * 300_000, " ".join(["long"] * 300_000)),
    ]
    rows = [(k, f"u{k}", html, "clash", 3) for k, (html, _) in enumerate(cases)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(docs).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    for r in got:
        expected = cases[r["page_id"]][1]
        assert r["text"] == expected if expected is not None else want in r["text"], r["page_id"]
    assert html_text.extract(docs.limit(0)).collect() == []


@pytest.mark.parametrize("piece", ["<a ", '<p x="', "<![CDATA[", '<a "', "<b></i>", "<!--", "</", "<div class=side>", "&#"])
def test_html_text_of_broken_markup_takes_linear_time(piece):
    import time

    began = time.process_time()
    html_text.main_text("<body><p>text</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


def plain_schedule(per, block):
    """(source_no, rank) to the slot's place in the mix, by a loop over the slots of each size of blocks."""
    plan = {}
    for size in {mixing.block_of(r["words"], block) for r in per if r["words"]}:
        mine = sorted((r["source_no"], r["target"]) for r in per if r["words"] and mixing.block_of(r["words"], block) == size)
        total, counts = sum(t for _, t in mine), collections.Counter()
        slots = -(-sum(r["words"] for r in per if r["source_no"] in dict(mine)) // size)
        for slot in range(slots):
            at, below = slot * mixing.GOLDEN % 1 * total, 0.0
            for number, target in mine:
                below += target
                if at < below:
                    break
            plan[number, counts[number]] = slot / slots
            counts[number] += 1
    return plan


def test_mixing_takes_the_words_of_the_schedule(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(k, prose(draw.randrange(0, 70), k), "en", ["a", "b", "c", None][min(draw.randrange(7), 3)], 0, 1, "x") for k in range(200)] + [(500, "w " * 9000, "en", "b", 0, 1, "x"), (501, "tiny source", "en", "d", 0, 1, "x")]
    docs, block = spark.createDataFrame(rows, DOCS), 32
    parts = max(16, mixing.groups_for(docs.select("text"), 64))
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit("mix")).alias("h")).collect()}
    per = mixing.targets(docs.select("source", mixing.word_count(F.col("text")).alias("size"))).collect()
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs, block=block).collect()}
    plan = plain_schedule(per, block)
    blocks = collections.Counter(number for number, _ in plan)
    for source in per:
        number, size, own = source["source_no"], source["source_size"], mixing.block_of(source["words"], block)
        words = min(blocks[number] * own, 3 * size)
        assert abs(words - source["target"]) <= 3 * own
        mine, at = sorted((k for k, r in got.items() if r["source"] == source["source"]), key=lambda k: ((hashes[k] >> 20) % parts, hashes[k])), 0
        for k in mine:
            n = got[k]["size"]
            spans = [(at + turn * size, min(at + n + turn * size, words)) for turn in range(3) if at + turn * size < words and n]
            assert got[k]["taken"] == sum(b - a for a, b in spans)
            met = sorted(plan[number, rank] for a, b in spans for rank in range(a // own, (b - 1) // own + 1))
            assert (got[k]["n_slots"], got[k]["first_slot"]) == (len(met), met[0] if met else None)
            at += n
    monkeypatch.setattr(mixing, "GOLDEN", 0.25)  # another schedule is another mix
    other = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, block=block).collect()}
    assert other != {k: r["taken"] for k, r in got.items()}


def test_ordinal_gradient():
    draw = np.random.default_rng(6)
    x, grade, case = draw.normal(size=(30, 5)), draw.integers(0, 3, 30), draw.random(30)
    w, cut = draw.normal(size=5), np.array([0.3, -0.4])
    gradient = toxicity.objective(x, grade, case, w, cut)[1]
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-5
        up, down = (toxicity.objective(x, grade, case, w + s * step[:5], cut + s * step[5:])[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - gradient[k]) < 1e-5


def test_toxicity_of_odd_rows(spark):
    rows = [(k, prose(40, k) + (" idiot moron" if k % 5 == 0 else "")) for k in range(100)] + [(7, "you idiot moron idiot"), (None, "moron"), (900, ""), (901, "clean " * 200_000), (902, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, grade int, toxic string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(100)] + [(3, 1), (3, 0), (3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.grade(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["severity"] <= 2 and r["grade"] in (0, 1, 2) for r in got)
    assert [r["toxic"] for r in got if r["doc_id"] == 901] == [False]
    one = toxicity.grade(docs, labels.where("toxic = 1")).collect()
    assert len(one) == len(rows) and toxicity.grade(docs.limit(0), labels).count() == 0


def test_toxicity_sample_is_bounded_by_texts(spark):
    rows = [(5, prose(20, k % 700)) for k in range(3000)] + [(6, prose(20, 9000)), (6, prose(20, 9000)), (7, "z " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 0)], "doc_id long, toxic int")
    bags, _ = toxicity.labelled_bags(docs, labels, 8)
    assert sorted(b["toxic"] for b in bags) == [0, 0, 1, 1, 1, 1]


def test_toxicity(spark):
    rows = [(k, prose(60, k) + (" idiot moron" if k % 8 == 0 else ""), "en", "s", 0, 1, "x") for k in range(400)] + [(999, None, "en", "s", 0, 1, "x")]
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(200)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.grade(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert all(got[k]["toxic"] == (k % 8 == 0) for k in range(200, 400)) and not got[999]["toxic"]
    assert toxicity.grade(spark.createDataFrame(rows, DOCS), labels.limit(0)).where("toxic").count() == 0


def test_ngram_join_of_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 4)
    base = prose(120, 3).split()
    texts = [" ".join(base[:k] + [f"q{k}"] + base[k + 1 :]) for k in range(8, 110)] + [prose(60, k) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root))
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = spark.createDataFrame([(1, "x " * 200_000), (2, "x " * 200_000 + "y"), (3, "word " + "z" * 300_000)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(long).collect()} == {1: (1, 1), 2: (2, 2), 3: (1, 3)}
