"""Spelling variants and embedding whitening against the plain versions."""
import random

import numpy as np
import pytest

import brute
from logsight.llm import spelling, whitening
from logsight.session import read_table
from test_operators import LONG, ROWS, SMOKE, listed, plain, table

SPELLING = ("word", "form", "root", "n", "n_near", "form_n")


def same_spelling(docs, **options):
    want = brute.spelling(plain(docs), **{k: v for k, v in options.items() if k != "bucket_size"})
    got = spelling.spelling_variants(docs, **options)
    assert got.columns == list(SPELLING)
    assert listed(got, *SPELLING) == sorted(want, key=repr)
    return want


def test_spelling_awkward(spark):
    rows = [(i, LONG[:20_000] if t == LONG else t) for i, t in ROWS]
    same_spelling(table(spark, rows))


def test_spelling_small_table(spark):
    docs = read_table(spark, SMOKE, "documents").filter("doc_id < 60")
    want = same_spelling(docs, min_length=5)
    assert sum(w[4] for w in want) > 50


@pytest.mark.parametrize("bucket_size", [2, 1024])
def test_spelling_hot_bucket(spark, bucket_size):
    """Nearly all words share most of their letters; buckets split down to one position."""
    r = random.Random(3)
    words = ["straße" + "é" * k for k in range(2, 9)] + ["abcabcabc"]
    for _ in range(400):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k:k + r.randint(0, 1)] = r.choice(["a", "b", "c", "é", ""])
        words.append("".join(w))
    rows = [(k, " ".join(r.choices(words[:8], k=30) + [w, w, w.upper()])) for k, w in enumerate(words)]
    want = same_spelling(table(spark, rows), bucket_size=bucket_size)
    assert any(w[2] not in (w[0], w[1]) for w in want) or any(w[1] for w in want)


def test_spelling_chain_of_forms(spark):
    rows = [(k, " ".join(["abcdefgh"] * n + ["abcdefgx"] * m + ["abcdefyx"] * p)) for k, (n, m, p) in enumerate([(500, 40, 2), (500, 10, 1)])]
    got = {w: (form, root) for w, form, root, *_ in same_spelling(table(spark, rows), every=0) if form}
    assert got == {"abcdefgx": ("abcdefgh", "abcdefgh"), "abcdefyx": ("abcdefgx", "abcdefgh")}


def test_spelling_long_words_and_nothing(spark):
    long = "ab" * 3_000
    same_spelling(table(spark, [(1, f"{long} {long} x{long} x{long}"), (2, f"{long[:-1]}é " * 2)]), every=0)
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(None, None), (1, "")])).count() == 0


def whitened(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, x int, component int, id int")
    return whitening.whiten(df.repartition(3), **options)


def same_whitening(df, rows, most=32):
    facts, white, shares = brute.whitening(rows, most)
    got = df.collect()
    k = white.shape[1]
    assert len(got) == len(facts) * k and {r.n for r in got} <= {len(facts)}
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=repr) == sorted(set(facts), key=repr)
    assert np.allclose([r.explained for r in got], [shares[r.component - 1] for r in got], rtol=1e-6, atol=1e-12)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-4 for r in got)
    # either sign: components as sorted columns of sizes, and whole rows where ids tell them apart
    for c in range(k):
        assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == c + 1), sorted(np.abs(white[:, c])), atol=1e-7)


def test_whitening_small_table(spark):
    rows = read_table(spark, SMOKE, "embeddings")
    same_whitening(whitening.whiten(rows), [(r.vec_id, r.embedding) for r in rows.collect()])


def test_whitening_awkward(spark):
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=5).astype("float32").tolist()) for k in range(40)]
    rows += [(k, v) for k, v in rows[:10]] + [(None, rows[0][1]), (None, rows[1][1])]
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [float("inf")] + [0.0] * 4), (95, [1.0, 2.0])]
    same_whitening(whitened(spark, rows + bad), rows)
    same_whitening(whitened(spark, rows + bad, most=2), rows, 2)


def test_whitening_without_variance(spark):
    assert whitened(spark, []).count() == 0 and whitened(spark, [(1, None)]).count() == 0
    got = whitened(spark, [(1, [0.5, 0.25])] * 3).collect()
    assert len(got) == 6 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in got} == {(0.0, 0.0, 0, 0.0)}
    # one of two dimensions is constant
    rows = [(k, [float(k), 1.0]) for k in range(5)]
    same_whitening(whitened(spark, rows, "double"), rows)
    assert whitened(spark, rows).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
