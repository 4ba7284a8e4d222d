"""Stages of the pipeline on documents with null and repeated ids."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, language_id, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(400)}" for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], DOCS)


def found(rows):
    return sorted((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in rows.collect())


def test_near_duplicates_of_repeated_ids(spark):
    a, b, clean = prose(120, 1), prose(120, 2), prose(120, 3)
    crossed = [(7, a, "s"), (9, a + " new", "s"), (7, b, "s"), (3, b + " new", "s")]
    alone = [(1, clean, "s"), (1, prose(120, 4), "s"), (None, a, "s"), (None, a, "s"), (20, None, "s"), (20, "", "s")]
    copies = [(30, prose(90, 5), "s")] * 3
    got = found(corpus_pipeline.drop_near_duplicates(spark, documents(spark, crossed + alone + copies), ""))
    assert got == sorted((k or 0, t or "", s) for k, t, s in [crossed[0], crossed[3], *alone, copies[0]])


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None if k % 3 else k // 9, prose(20 + k, k), "ab"[k % 2]) for k in range(60)]
    docs = documents(spark, rows)
    got = found(corpus_pipeline.mix(spark, docs.repartition(3), ""))
    assert any(k == 0 for k, _, _ in got) and {r[2] for r in got} == {"a", "b"}
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    target = {s: sum(words.values()) * w / 3 for s, w in (("a", 1), ("b", 2))}
    for s in "ab":  # times are rounded for each row, by at most half its size
        assert abs(sum(len(t.split()) for _, t, x in got if x == s) - target[s]) <= words[s] / 2
    keyed = mixing.mix_sources(docs.withColumn("row", F.monotonically_increasing_id()), key="row").collect()
    want = sum(round(r["taken"] / r["size"] + 1e-9) for r in keyed)
    assert len(keyed) == len(rows) and len(got) == want
    assert {t for _, t, _ in got} <= {t for _, t, _ in rows} and len({t for _, t, _ in got}) > len(rows) / 2


WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCES = {"en": "the cat sat on the mat and looked at that with the dog of the house", "de": "der hund und die katze sind nicht in dem haus mit den anderen tieren"}


def small_corpus():
    draw = random.Random(11)
    rows = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        words = [draw.choice(SENTENCES[lang].split()) if draw.random() < 0.6 else f"{lang}{draw.randrange(300)}" for _ in range(draw.randrange(30, 90))]
        rows.append((k, " ".join(words), lang, ("web", "book", None)[k % 3]))
    passage = " ".join(f"passage{k}" for k in range(60))
    rows += [(200 + k, f"{rows[k][1]} {passage} end{k}", rows[k][2], "web") for k in range(4)]
    rows += [(300 + k, rows[k][1], rows[k][2], "book") for k in range(10)] + [(400 + k, rows[k][1] + " tail", rows[k][2], "web") for k in range(20, 26)]
    rows += [(500, None, None, "web"), (501, "", "en", "web"), (502, "12 34 !!", "en", "web"), (None, rows[30][1], "en", "web"), (7, rows[40][1] + " other text of the id", "en", "web")]
    return [(k, t, lang, s, len(t or "")) for k, t, lang, s in rows]


def near_by_hand(rows):
    """Rows (doc_id, text, ...) without all but the first of each group that links reach."""
    sets = []
    for row in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
            root = [root[i] if r == root[j] else r for r in root]
    first = {}
    for k, row in enumerate(rows):
        if row[0] is not None and sets[k]:
            first[root[k]] = min(first.get(root[k], (row[0], k)), (row[0], k))
    return [row for k, row in enumerate(rows) if row[0] is None or not sets[k] or first[root[k]][1] == k]


def passages_by_hand(rows):
    """Rows, ordered by (doc_id or less than any), without words of 20-word windows that begin earlier."""
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = WORD.findall(row[1] or ""), set()
        windows = [tuple(w[i : i + 20]) for i in range(len(w) - 19)]
        for i, window in enumerate(windows):
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        if gone and len(gone) == len(w):
            continue
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else row[1] or ""
        out.append((row[0], text, row[2], row[3], len(text) if gone else row[4]))
    return out


def plain(rows):
    return sorted(map(repr, rows))


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_stages_against_plain_versions(spark):
    rows = small_corpus()
    docs = frame(spark, rows).repartition(3)
    clash = docs.selectExpr("*", "0 as row", "'x' as key", "1 as part", "'y' as nth", "0.5 as lang_score", "'z' as carry_text", "7 as time")
    net = language_id.train(language_id.training_sample(docs, 2400, 1024), 4)
    said = language_id.predict(net, (r[1] or "" for r in rows), len(rows))
    kept = [(r[0], r[1], lang, r[3], r[4]) for r, lang, score in zip(rows, *said, strict=True) if r[1] and re.search(r"[^\W\d_]", r[1]) and score >= corpus_pipeline.LEAST_SCORE]
    assert 130 <= len(kept) == len(rows) - 3
    for given in (docs, clash):
        assert plain(map(tuple, corpus_pipeline.identify_language(spark, given, "").collect())) == plain(kept)
        assert plain(map(tuple, corpus_pipeline.drop_near_duplicates(spark, given, "").collect())) == plain(near_by_hand(rows))
        assert plain(map(tuple, corpus_pipeline.drop_repeated_passages(spark, given, "").collect())) == plain(passages_by_hand(rows))
        mixed = collections.Counter(map(tuple, corpus_pipeline.mix(spark, given, "").collect()))
        assert set(mixed) <= set(rows) and sum(mixed.values()) > 60
        tokens = corpus_pipeline.tokenize(spark, given, "").collect()
        assert len(tokens) == len(rows) and all(r["round_trip"] for r in tokens)
    twice = docs.unionByName(docs)
    assert len(corpus_pipeline.drop_repeated_passages(spark, twice, "").collect()) == 2 * len(passages_by_hand(rows))
    assert plain(map(tuple, corpus_pipeline.drop_near_duplicates(spark, twice.where("doc_id is not null and text is not null and text <> ''"), "").collect())) == plain(near_by_hand([r for r in rows if r[0] is not None and r[1]]))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run_against_plain_stages(spark, tmp_path):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    rows = small_corpus()
    docs = frame(spark, rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    net = language_id.train(language_id.training_sample(docs, 2400, 1024), 4)
    said = language_id.predict(net, (r[1] or "" for r in rows), len(rows))
    kept = [(r[0], r[1], lang, r[3], r[4]) for r, lang, score in zip(rows, *said, strict=True) if r[1] and re.search(r"[^\W\d_]", r[1]) and score >= corpus_pipeline.LEAST_SCORE]
    left = passages_by_hand(near_by_hand(kept))
    mixed = corpus_pipeline.mix(spark, frame(spark, left), "").collect()
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = [(r["doc_id"], r["lang"], r["source"], known.encode_ordinary(r["text"])) for r in mixed]
    got = [(r["doc_id"], r["lang"], r["source"], np.frombuffer(r["ids"], "<u4").tolist()) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert plain(got) == plain(want) and len(got) > 60
