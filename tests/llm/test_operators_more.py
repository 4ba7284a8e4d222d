"""Operators 11 to 13 against plain versions, and their defined cases."""

import random

import numpy as np
import pytest

from quarry.llm import hard_negatives, token_counts, vectors, whitening

VECTORS = "vec_id long, label int, embedding array<double>, packed int, slot string"
ODD = [(None, None, [1.0, 2.0, 3.0]), (7, 1, None), (8, 1, [1.0, None, 2.0]), (9, 1, [1.0, float("nan"), 2.0]), (10, 1, [float("inf"), 0.0, 0.0])]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)


def fits(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def test_vectors_are_packed_and_unpacked():
    import pyarrow as pa

    some = [[0.5, -0.001], [1e6, 3.0], None, [1e18, -1e300], [], [None, 1.0], [200.0] * 3]
    fit, packed = vectors.pack(pa.array(some, pa.list_(pa.float64())))
    assert fit.tolist() == [True, True, False, True, True, False, True]
    got = {k: sorted(map(tuple, x.tolist())) for k, (_, x) in vectors.unpack(packed.to_pylist()).items()}
    most = int(vectors.MOST)
    assert got == {2: sorted([(128, -1), (256_000_000, 768), (most, -most)]), 0: [()], 3: [(51200,) * 3]}


def plain_whitening(rows, most=4):
    kept = [(i, np.floor(256 * np.array(v))) for i, _, v in rows if fits(v)]
    out = []
    for length in {len(x) for _, x in kept if len(x)}:
        own = [(i, x) for i, x in kept if len(x) == length]
        listed = np.array(sorted({tuple(x) for _, x in own}))
        n, s = len(listed), listed.sum(0)
        centred = listed - s / n
        values, v = np.linalg.eigh(centred.T @ centred / n)
        values, v = values[::-1], v[:, ::-1]
        for i, x in own:
            deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
            for k in range(min(most, length)):
                real = values[k] > 1e-12 * values[0]
                out.append((i if i is not None else -1, k + 1, n, deviation, abs((x - s / n) @ v[:, k]) / np.sqrt(values[k]) if real else 0.0, values[k] / values.sum() if real else 0.0))
    return sorted(out)


def test_whitening(spark):
    draw = np.random.default_rng(4)
    basis = draw.normal(size=(6, 6)) * [9, 5, 3, 2, 1, 1e-2]
    rows = [*ODD, *((k, 0, (basis @ draw.normal(size=6)).tolist()) for k in range(200)), *((500 + k, 0, [1.0, 2.0, 3.0]) for k in range(4)), (900, 0, [4.0, 2.0]), (901, 0, [1.0, 2.5]), (902, 0, [0.0])]
    rows += [(k, 0, rows[5 + k][2]) for k in range(3)] + [(3, 0, rows[20][2])]
    got = whitening.whiten(rows_of(spark, rows)).collect()
    mine = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got)
    want = plain_whitening(rows)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert np.allclose([m[4:] for m in mine], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9
    assert len({r["identity_error"] for r in got if r["n"] == 200}) == 1
    assert whitening.whiten(rows_of(spark, rows).limit(0)).count() == 0


def test_one_sign_for_all_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(k, 0, v) for k, v in enumerate((draw.normal(size=(60, 4)) * [8, 4, 2, 1]).tolist())]
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(rows_of(spark, rows)).collect()}
    want = plain_whitening(rows)
    x = np.floor(256 * np.array([v for *_, v in rows]))
    _, v = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
    for k in range(4):
        along, mine = (x - x.mean(0)) @ v[:, 3 - k], np.array([got[i, k + 1] for i in range(60)])
        assert abs(abs(np.corrcoef(along, mine)[0, 1]) - 1) < 1e-9
    assert len(want) == len(got)


def test_jacobi_keeps_small_eigenvalues():
    scale = 10.0 ** -np.arange(0, 12, 2)
    draw = np.random.default_rng(6).normal(size=(6, 6))
    graded = (draw @ draw.T + 6 * np.eye(6)) * scale[:, None] * scale[None, :]
    values, v = whitening.jacobi(graded)
    import fractions

    exact = [[fractions.Fraction(a) for a in row] for row in graded.tolist()]
    product = fractions.Fraction(1)  # the determinant, exactly
    for k in range(6):
        product *= exact[k][k]
        for r in range(k + 1, 6):
            f = exact[r][k] / exact[k][k]
            exact[r] = [a - f * b for a, b in zip(exact[r], exact[k], strict=True)]
    assert abs(float(np.prod(values)) / float(product) - 1) < 1e-11
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-13 and (np.diff(values) <= 0).all()


def test_deviation_beyond_a_long_is_null():
    fit = whitening.Fit(10**9, [5], np.array([1.0]), np.eye(1))
    assert fit.deviation(np.array([[3], [10**6]])) == [(3 * 10**9 - 5) ** 2 if (3 * 10**9 - 5) ** 2 < 1 << 63 else None, None]


def plain_negatives(rows, every=100, k=5):
    kept = sorted({(i, label, tuple(int(np.floor(256 * c)) for c in v)) for i, label, v in rows if i is not None and label is not None and v and fits(v)})
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in kept if r is not a and len(r[2]) == len(a[2]))
        for p, i, _ in [s for s in scores if s[2] == a[1]][:k]:
            hard = [s for s in scores if s[2] != a[1] and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(a[0], i, n, s[1], -p, -s[0]) for n, s in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(4, 5))
    rows = [(k, int(k % 4), (centres[k % 4] + centres[(k // 4) % 4] + draw.normal(size=5)).round(1).tolist()) for k in range(0, 1500, 3)]
    rows += [(5000 + k, 1, rows[0][2]) for k in range(40)] + [(6000 + k, 2, rows[0][2]) for k in range(40)] + rows[:5]
    rows += [*ODD, (200, None, [1.0] * 5), (None, 1, [1.0] * 5), (300, 2, [1.0] * 3), (301, 2, [1.0] * 3), (302, 1, [0.9] * 3), (300, 3, [2.0] * 5), (400, 1, [])]
    found = lambda: sorted(map(tuple, hard_negatives.mine(rows_of(spark, rows)).collect()))
    want = plain_negatives(rows)
    assert len(want) > 30 and found() == want
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "SLOT", 2)
    assert found() == want
    assert hard_negatives.mine(rows_of(spark, rows).limit(0)).count() == 0


def test_inner_products_are_exact():
    x, a = np.array([[3, -(1 << 31)], [1 << 40, 7]]), np.array([[1 << 33, 5], [-(1 << 62), 1]])
    assert hard_negatives.inner(x, a).tolist() == [[sum(p * q for p, q in zip(r, s, strict=True)) for r in x.tolist()] for s in a.tolist()]


@pytest.fixture(scope="module")
def counter_and_library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    return token_counts.Counter(open(path, encoding="utf-8").read()), lambda s: len(library.encode(s, add_special_tokens=False).ids), path


BITS = ["<|endoftext|>", "<|startoftext|>", "'ll", "'ve", "the", "ing", "aaaa", "<|ENDOFTEXT|>", "thethe", " \n"]


def odd_texts(n, seed):
    draw = random.Random(seed)
    letters = "abcdeshtingou'’ \n\t12٣é日本🙂İΣςǅ-!?<|≯̸́ 　\x1c\x00ﬁÅK"
    return ["".join(draw.choice(letters) if draw.random() < 0.85 else draw.choice(BITS) for _ in range(draw.randrange(40))) for _ in range(n)]


def test_token_counts_are_the_librarys(counter_and_library):
    counter, count, _ = counter_and_library
    draw = random.Random(3)
    texts = odd_texts(400, 1) + ["a" * 3000, "ab" * 900, "thethe" * 500, "!" * 2000, "日本" * 700, " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(1, 40))) for _ in range(3000))]
    assert counter.counts(t.encode() for t in texts) == list(map(count, texts))


def test_every_prefix_is_counted(counter_and_library):
    counter, count, _ = counter_and_library
    for text in odd_texts(60, 2) + ["it'll don've 'l're", "x" * 200]:
        whole, counts = counter.prefixes(text)
        assert counts.tolist() == [count(whole[:k]) for k in range(len(whole) + 1)]
        for limit in (0, 3, 7):
            fit = [k for k in range(len(whole) + 1) if counts[k] <= limit]
            assert counter.truncated(text, limit) == whole[: fit[-1]]


def test_token_counts_survive_small_memories(counter_and_library, monkeypatch):
    _, count, path = counter_and_library
    monkeypatch.setattr(token_counts, "REMEMBERED", 40)
    monkeypatch.setattr(token_counts, "SLICE", 50)
    monkeypatch.setattr(token_counts, "FEW", 1)
    monkeypatch.setattr(token_counts, "PAIRS", 30)
    counter = token_counts.Counter(open(path, encoding="utf-8").read())
    texts = odd_texts(300, 5) + ["one two three " * 40]
    assert counter.counts(t.encode() for t in texts) == list(map(count, texts))


def test_token_counts_through_spark(spark, counter_and_library):
    _, count, path = counter_and_library
    texts = [None, "", " \n\t", "one", "áb <|endoftext|>", "same", "same", "y" * 5000]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    own = token_counts.TokenCounts(spark, path)
    got = {r["doc_id"]: r for r in rows.select("doc_id", own.counted(rows.text).alias("n"), own.prefix_counts(rows.text).alias("p"), own.truncated(rows.text, 2).alias("t"), own.within(rows.text, 2).alias("w")).collect()}
    for k, t in enumerate(texts):
        assert got[k]["n"] == count(t or "") and got[k]["p"][-1] == got[k]["n"] and got[k]["w"] == (got[k]["n"] <= 2)
        assert (got[k]["t"] is None) == (t is None) and count(got[k]["t"] or "") <= 2
    assert rows.limit(0).select(own.counted(rows.text)).count() == 0


def test_other_vocabularies_are_refused():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        token_counts.Counter(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
