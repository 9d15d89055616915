"""Language identification by a linear-chain conditional random field.

Every word of a text gets a language: its affixes, character n-grams and its place
in the languages' lexicons score the languages, learned transitions tie it
to its neighbours, and forward-backward gives its probabilities. A text's language is the one
with the largest expected number of words, so code-switched text is judged by its words.

The lexicons hold the words that tell languages apart by their counts over all labelled
texts. The weights are fitted to a bounded sample of passages, some of them spliced
from two languages, so that the transitions see switches.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsight.llm import arrays as A
from logsight.session import stage

UNKNOWN = "und"
#: Hashed feature rows of the n-grams.
FEATURES = 1 << 16
#: Words that one chain runs through at a time; the pieces of a text are joined exactly.
PIECE = 32
_U = np.uint64


def cleaned(text_col: str):
    """Lower-case words of letters and marks, one space before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.col(text_col).cast("string")), F.lit(" ")), r"[^\p{L}\p{M}]+", " ")


def _grams(data: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words in ``data`` (words between single spaces, a space at either
    end) and the features: (feature row, word) for each kind, by rising word."""
    space = data == 32
    word = np.cumsum(space) - 1
    starts = np.flatnonzero(space)[:-1]
    n_words = len(starts)
    wide = data.astype(_U)
    out = []

    def add(kind: int, value: np.ndarray, of: np.ndarray) -> None:
        h = (value + _U(kind << 56)) * _U(0x9E3779B97F4A7C15)
        out.append((((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(48)).astype(np.int64), of))

    two = wide[:-1] | wide[1:] << _U(8)
    add(1, two, word[:-1])
    three = two[:-1] | wide[2:] << _U(16)
    inside = ~space[1:-1]
    add(2, three[inside], word[:-2][inside])
    # longer affixes: up to five bytes at either end
    ends = np.append(starts[1:], len(data) - 1)
    for size in (4, 5, 6):
        for kind, first in ((size, starts), (size + 8, np.maximum(ends - size + 1, starts))):
            value, at = np.zeros(n_words, _U), first
            for k in range(size):
                value |= np.where(first + k <= ends, wide[np.minimum(first + k, ends)], _U(0)) << _U(8 * k)
            add(kind, value, np.arange(n_words))
    return n_words, out


@dataclass
class Tagger:
    """A fitted model: languages, weights of n-grams, of lexicons, of transitions and of starts."""
    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    lists: np.ndarray
    lists_weight: np.ndarray
    bias: np.ndarray
    switch: np.ndarray
    start: np.ndarray

    def scores(self, data: np.ndarray) -> np.ndarray:
        """(words, languages): what each word's own features say. A word that occurs often is looked at once."""
        edge = np.flatnonzero(data == 32)
        size = np.diff(edge)
        names, first, back = np.unique(A.hash_runs(data, edge[:-1] + 1, edge[1:]), return_index=True, return_inverse=True)
        size = size[first]
        apart = data[np.repeat(edge[first] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        n, features = _grams(np.append(apart, np.uint8(32)))
        out = np.repeat(self.bias[None], n, axis=0)
        for rows, of in features:
            w = self.grams[rows]
            at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            out[of[at]] += np.add.reduceat(w, at, axis=0) if len(at) < len(of) else w
        return (out + self.lists_weight[self.listed(names)])[back]

    def listed(self, names: np.ndarray) -> np.ndarray:
        """The lexicon of each word (by hash), the number of languages if none."""
        at = np.minimum(np.searchsorted(self.lexicon, names), max(len(self.lexicon) - 1, 0))
        found = self.lexicon[at] == names if len(self.lexicon) else np.zeros(len(names), bool)
        return np.where(found, self.lists[at] if len(self.lists) else 0, len(self.languages))

    def posteriors(self, scores: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Forward-backward over texts of ``words`` words each (none empty).

        Texts are cut into pieces that run side by side. A piece is first taken as
        one matrix (which language it turns into which), the matrices carry the
        messages from piece to piece, then all pieces run forward and backward from their own ends.
        """
        k = len(self.languages)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        pieces = -(-words // PIECE)
        text = np.repeat(np.arange(len(words)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(words) - words)[text] + nth * PIECE
        size = np.minimum(words[text] - nth * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")  # pieces that go on stand in front
        begin, size = begin[order], size[order]
        alive = [int(np.searchsorted(-size, -s, "left")) for s in range(PIECE)]  # pieces longer than s
        switch, n = np.exp(self.switch), len(begin)
        # what leads to a piece's first word: at the start of a text, the start weights from anywhere
        entry = np.where((nth[order] == 0)[:, None, None], np.exp(self.start)[None, None, :], switch[None])

        def even(x: np.ndarray) -> np.ndarray:
            return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

        whole = even(entry * e[begin][:, None, :])
        for s in range(1, PIECE):
            if m := alive[s]:
                whole[:m] = even((whole[:m] @ switch) * e[begin[:m] + s][:, None, :])
        # from piece to piece, all texts at once
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        first = np.cumsum(pieces) - pieces
        into, back = np.empty((n, k)), np.empty((n, k))
        longest = np.argsort(-pieces, kind="stable")
        going = np.searchsorted(-pieces[longest], -np.arange(1, int(pieces.max()) + 1), "right")
        state = np.full((len(words), k), 1 / k)
        for p, m in enumerate(going):
            texts = longest[:m]
            at = place[first[texts] + p]
            into[at] = state[texts]
            state[texts] = even(np.einsum("ti,tij->tj", state[texts], whole[at]))
        state = np.ones((len(words), k))
        for p in range(len(going) - 1, -1, -1):
            texts = longest[:going[p]]
            at = place[first[texts] + p]
            back[at] = state[texts]
            state[texts] = even(np.einsum("tij,tj->ti", whole[at], state[texts]))
        ahead, out = np.empty((n, PIECE, k)), np.empty_like(e)
        state = into
        for s in range(PIECE):
            if m := alive[s]:
                state = even((state[:m] @ switch if s else np.einsum("ni,nij->nj", state, entry)) * e[begin[:m] + s])
                ahead[:m, s] = state
        state = back
        for s in range(PIECE - 1, -1, -1):
            if m := alive[s]:
                out[begin[:m] + s] = even(ahead[:m, s] * state[:m])
                state[:m] = even((e[begin[:m] + s] * state[:m]) @ switch.T)
        return out


def _joined(texts: list[bytes]) -> np.ndarray:
    """Cleaned texts one after the other, with one space between words."""
    return np.frombuffer(b" " + b" ".join(t.strip(b" ") for t in texts) + b" ", np.uint8)


def fit(passages: list[tuple[list[str], list[int]]], languages: list[str], lexicon: dict[str, int], *, epochs: int = 6, rate: float = 0.05, decay: float = 1e-5, batch: int = 256, seed: int = 7) -> Tagger:
    """Weights by gradient ascent (Adam) on the likelihood of labelled word sequences."""
    k = len(languages)
    names = [w.encode() for w in lexicon]
    buffer, size = np.frombuffer(b"".join(names), np.uint8), np.array([len(w) for w in names], np.int64)
    hashes = A.hash_runs(buffer, np.cumsum(size) - size, np.cumsum(size)) if names else np.zeros(0, _U)
    by = np.argsort(hashes)
    tagger = Tagger(languages, np.zeros((FEATURES, k)), hashes[by], np.array(list(lexicon.values()), np.int64)[by], np.zeros((k + 1, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k))
    weights = [tagger.grams, tagger.lists_weight, tagger.bias, tagger.switch, tagger.start]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    random, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = random.permutation(len(passages))
        for lo in range(0, len(order), batch):
            chosen = [passages[i] for i in order[lo:lo + batch]]
            grads = _gradients(tagger, chosen)
            step += 1
            for w, g, (m, v) in zip(weights, grads, moments):
                g = g / len(chosen) - decay * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    tagger.grams = tagger.grams.astype(np.float32)
    return tagger


def _gradients(tagger: Tagger, chosen: list[tuple[list[str], list[int]]]) -> list[np.ndarray]:
    """Observed minus expected counts of every feature over some passages."""
    k = len(tagger.languages)
    words = np.array([len(w) for w, _ in chosen])
    data = _joined([" ".join(w).encode() for w, _ in chosen])
    labels = np.concatenate([np.array(y) for _, y in chosen])
    scores = tagger.scores(data)
    n = len(scores)
    # these sequences are short: one pass over the steps, side by side
    begin, steps = np.cumsum(words) - words, int(words.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    switch = np.exp(tagger.switch)
    ahead, behind = np.zeros((n, k)), np.ones((n, k))
    state = np.exp(tagger.start)[None] * e[begin]
    ahead[begin] = state / state.sum(axis=1, keepdims=True)
    for s in range(1, steps):
        at = begin[words > s] + s
        state = (ahead[at - 1] @ switch) * e[at]
        ahead[at] = state / state.sum(axis=1, keepdims=True)
    for s in range(steps - 1, 0, -1):
        at = begin[words > s] + s
        state = (e[at] * behind[at]) @ switch.T
        behind[at - 1] = state / state.sum(axis=1, keepdims=True)
    gamma = ahead * behind
    gamma /= gamma.sum(axis=1, keepdims=True)
    second = np.setdiff1d(np.arange(n), begin)
    pairs = ahead[second - 1][:, :, None] * switch[None] * (e[second] * behind[second])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[second - 1], labels[second]), 1)
    rest = np.eye(k)[labels] - gamma
    grams = np.zeros_like(tagger.grams)
    _, features = _grams(data)
    rows, of = np.concatenate([r for r, _ in features]), np.concatenate([o for _, o in features])
    for c in range(k):
        grams[:, c] = np.bincount(rows, weights=rest[of, c], minlength=FEATURES)
    lists, edge = np.zeros_like(tagger.lists_weight), np.flatnonzero(data == 32)
    np.add.at(lists, tagger.listed(A.hash_runs(data, edge[:-1] + 1, edge[1:])), rest)
    return [grams, lists, rest.sum(axis=0), seen - pairs.sum(axis=0), rest[begin].sum(axis=0)]


def lexicons(labelled: DataFrame, languages: list[str], size: int, purity: float) -> dict[str, int]:
    """Up to ``size`` words of each language: the most frequent of those that it
    has by at least ``purity`` of all, by counts over all labelled texts."""
    words = labelled.select("lang", F.explode(F.split(F.trim("words"), " ")).alias("word")).filter("word != ''")
    counts = stage(words.groupBy("word", "lang").agg(F.count("*").alias("n")), "language-words")
    total = counts.groupBy("word").agg(F.sum("n").alias("all"), F.max(F.struct("n", "lang")).alias("top"))
    own = total.filter((F.col("all") >= 5) & (F.col("top.n") >= purity * F.col("all"))).select("word", F.col("top.lang").alias("lang"), F.col("top.n").alias("n"))
    ranked = own.withColumn("nth", F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)")).filter(F.col("nth") <= size)
    return {r.word: languages.index(r.lang) for r in ranked.select("word", "lang").collect()}  # size a language


def sample(labelled: DataFrame, languages: list[str], texts: int) -> dict[str, list[list[str]]]:
    """Words of at most ``texts`` distinct texts of each language, by the hash of the text."""
    hashed = labelled.withColumn("h", F.xxhash64("words"))
    kept = hashed.select("lang", "h").distinct().withColumn("nth", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h)")).filter(F.col("nth") <= texts)
    last = {r.lang: r.h for r in kept.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    below = F.lit(False)
    for lang, h in last.items():
        below = below | ((F.col("lang") == lang) & (F.col("h") <= h))
    rows = hashed.filter(below).dropDuplicates(["lang", "h"]).select("lang", "h", "words").collect()
    found: dict[str, list[list[str]]] = {x: [] for x in languages}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        found[r.lang].append(r.words.split())
    return found


def passages(texts: dict[str, list[list[str]]], languages: list[str], length: int, each: int, spliced: float, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Labelled word sequences of up to ``length`` words: ``each`` from a text at
    random places, and some that switch once between two languages."""
    random = np.random.default_rng(seed)
    out, cuts = [], []
    for y, lang in enumerate(languages):
        for words in texts[lang]:
            for _ in range(min(each, -(-len(words) // length))):
                at = int(random.integers(0, max(1, len(words) - length + 1)))
                cuts.append((words[at:at + length], y))
    for words, y in cuts:
        other, z = cuts[int(random.integers(0, len(cuts)))]
        if random.random() < spliced and z != y:
            a, b = int(random.integers(1, len(words) + 1)), int(random.integers(0, len(other)))
            out.append((words[:a] + other[b:][:length - a], [y] * a + [z] * len(other[b:][:length - a])))
        else:
            out.append((words, [y] * len(words)))
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, lexicon_size: int = 1000, purity: float = 0.8, texts: int = 300, length: int = 24, each: int = 6, spliced: float = 0.5) -> Tagger | None:
    """A tagger fitted to labelled texts (null labels and texts without letters aside), None if there are none.

    The lexicons count all texts. The weights see at most ``texts`` texts of a
    language, of each at most ``each`` passages of ``length`` words: the documented bound of the fit.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), cleaned(text_col).alias("words")).filter("lang IS NOT NULL AND words RLIKE '[^ ]'")
    languages = [r.lang for r in labelled.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    found = sample(labelled, languages, texts)
    return fit(passages(found, languages, length, each, spliced), languages, lexicons(labelled, languages, lexicon_size, purity))


def held_out(id_col: str):
    """Whether a row is kept out of the fit: crc32 of its id as text, modulo 3, is 1. A null id is an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def predict(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, words): every row's language and its share
    of the text's words; ``words`` has the expected number of words of each language."""
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(cleaned(text_col), F.lit(" ")).alias("words"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in A.texts(batch, "words"):
                whole = data.tobytes()
                texts = [whole[a:b].strip(b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                share = np.zeros((hi - lo, len(tagger.languages) if tagger else 1))
                rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
                if tagger and len(rows):
                    joined = _joined([texts[i] for i in rows])
                    words = np.array([texts[i].count(b" ") + 1 for i in rows])
                    found = tagger.posteriors(tagger.scores(joined), words)
                    share[rows] = np.add.reduceat(found, np.cumsum(words) - words, axis=0)
                total = share.sum(axis=1)
                best = share.argmax(axis=1)
                score = np.divide(share[np.arange(hi - lo), best], total, out=np.zeros(hi - lo), where=total > 0)
                names = [tagger.languages[b] if t > 0 else UNKNOWN for b, t in zip(best.tolist(), total.tolist())] if tagger else [UNKNOWN] * (hi - lo)
                counts = [list(zip(tagger.languages, row)) if t > 0 else [] for row, t in zip(share.tolist(), total.tolist())] if tagger else [[]] * (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(counts, pa.map_(pa.string(), pa.float64()))],
                    ["id", "held_out", "lang_pred", "score", "words"])

    out = source.mapInArrow(work, f"id {kind}, held_out boolean, lang_pred string, score double, words map<string,double>")
    return out.withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Every row's language by a tagger fitted to the rows that are not held out.

    A row is held out if crc32 of its id as text modulo 3 is 1. Predictions see the text alone.
    Null and empty texts and texts without letters are ``und`` with score 0, as are all
    rows if no row has a label; a null label only keeps a row out of the fit; rows that repeat an id stay
    rows of their own; a tie goes to the first language in code-point order; an
    empty table gives an empty result; other columns are not read. Texts are read whole.
    """
    return predict(docs, train(docs.filter(~held_out(id_col)), text_col, lang_col, **options), id_col, text_col)
