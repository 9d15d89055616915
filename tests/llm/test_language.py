"""Language identification: forward-backward against a plain version, held-out accuracy, code-switched text."""
import zlib

import numpy as np
import pytest

from logsight.llm import language
from logsight.session import read_table
from test_operators import CLASHES, LONG, ROWS, table

MEDIUM = "/root/testdata/sf0.01"


def model(k, seed=1):
    r = np.random.default_rng(seed)
    return language.Tagger([f"l{i}" for i in range(k)], r.normal(size=(language.FEATURES, k)).astype("float32"), np.zeros(0, np.uint64), np.zeros(0, np.int64), r.normal(size=(k + 1, k)), r.normal(size=k), 2 * r.normal(size=(k, k)), r.normal(size=k))


def log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def plain_posteriors(tagger, s):
    ahead, back = np.zeros_like(s), np.zeros_like(s)
    ahead[0] = tagger.start + s[0]
    for i in range(1, len(s)):
        ahead[i] = log_sum(ahead[i - 1][:, None] + tagger.switch, 0) + s[i]
    for i in range(len(s) - 2, -1, -1):
        back[i] = log_sum(tagger.switch + (s[i + 1] + back[i + 1])[None], 1)
    both = ahead + back
    return np.exp(both - log_sum(both, 1)[:, None])


@pytest.mark.parametrize("k", [1, 2, 5])
def test_forward_backward_is_exact(k):
    r, tagger = np.random.default_rng(2), model(k)
    texts = [" ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(1, 7))) for _ in range(n)) for n in (1, 2, 31, 32, 33, 64, 65, 200, 5, 1000)]
    words = np.array([t.count(" ") + 1 for t in texts])
    scores = tagger.scores(language._joined([t.encode() for t in texts]))
    got, at = tagger.posteriors(scores, words), 0
    for n in words:
        assert np.abs(plain_posteriors(tagger, scores[at:at + n]) - got[at:at + n]).max() < 1e-9
        at += n


def test_scores_do_not_depend_on_neighbours():
    tagger = model(3)
    words = "the der él garçon a übermorgen the in i".split()
    together = tagger.scores(language._joined([" ".join(words).encode()]))
    for w, row in zip(words, together):
        assert np.allclose(tagger.scores(language._joined([w.encode()]))[0], row)


def test_gradient_is_that_of_the_likelihood():
    tagger, passage = model(2), ("das ist the end of it".split(), [0, 0, 1, 1, 1, 1])
    tagger.grams = tagger.grams.astype(float)

    def likelihood():
        s, y = tagger.scores(language._joined([" ".join(passage[0]).encode()])), passage[1]
        whole = tagger.start + s[0]
        for row in s[1:]:
            whole = log_sum(whole[:, None] + tagger.switch, 0) + row
        return tagger.start[y[0]] + s[np.arange(len(y)), y].sum() + sum(tagger.switch[a, b] for a, b in zip(y, y[1:])) - log_sum(whole, 0)

    grads = language._gradients(tagger, [passage])
    for w, g in zip([tagger.grams, tagger.lists_weight, tagger.bias, tagger.switch, tagger.start], grads):
        for at in list(zip(*np.nonzero(g)))[:4]:
            before, old = likelihood(), w[at]
            w[at] += 1e-5
            assert abs((likelihood() - before) / 1e-5 - g[at]) < 1e-3
            w[at] = old


def test_held_out_accuracy_and_switched_text(spark):
    docs = read_table(spark, MEDIUM, "documents")
    tagger = language.train(docs.filter(~language.held_out("doc_id")))
    got = language.predict(docs, tagger).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # two held-out texts in one: each word goes to its own language
    rows = {lang: docs.filter(language.held_out("doc_id") & (docs.lang == lang) & (docs.n_chars > 1500)).first().text.split()[:200] for lang in ("de", "es")}
    mixed = spark.createDataFrame([(1, " ".join(rows["de"] + rows["es"] + rows["de"][:100]))], "doc_id long, text string")
    row = language.predict(mixed, tagger).first()
    assert row.lang_pred == "de" and 0.5 < row.score < 0.7 and 0.3 < row.words["es"] / sum(row.words.values()) < 0.5


def test_awkward_rows(spark):
    rows = [(i, LONG[:50_000] if t == LONG else t) for i, t in ROWS] + [(70, "123 — 4,5 §"), (71, "—"), (72, "漢字"), (73, "́ a")]
    docs = table(spark, rows)
    got = language.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "words"] and got.count() == len(rows)
    by_text = {(r.doc_id, r.lang_pred) for r in got.collect()}
    assert {(i, "und") for i in (1, 2, 3, 70, 71)} <= by_text and {(72, "en"), (73, "en")} <= by_text
    twice = [r for r in got.collect() if r.doc_id == 17]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert all(r.score == 0 for r in got.collect() if r.lang_pred == "und")


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(docs).collect()} == {("und", 0.0)}
    assert language.identify(table(spark, [])).count() == 0
    assert set(CLASHES) & set(table(spark, []).columns)
