"""Personal data: base patterns, and candidate spans judged by boosted trees.

Loose generators propose overlapping spans for each kind. A gradient-boosted
model sees the format of a span and its context; it is fitted on a bounded
sample of documents with a share for each kind, calibrated on held-out ones,
and adds the candidates over a calibrated threshold to the spans that the base
patterns found.
"""
from __future__ import annotations

import hashlib
import heapq
import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logsight.llm.boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
#: Most spans of a kind, and most other candidates, that one sampled document adds to the fit.
SPANS_PER_DOC, OTHERS_PER_DOC = 4, 40
#: Labelled rows under which a kind (or the fit) has too few positives.
LEAST = 5

# fixed values: the base patterns
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Generators: wider than the base patterns, overlapping on purpose.
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:@|[\[(]\s?at\s?[\])])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{1,63}){1,6}", re.I | re.A),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,5}(?:[.,][0-9]{1,5}){2,5}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.\-/]?[0-9]){11,20}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,16}(?![0-9])"),
}
#: Words before a span that speak for a kind.
CUES = {
    "email": ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt", "write"),
    "ip": ("ip", "host", "server", "address", "addr", "adresse", "client"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "credit", "pan"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, domain with a dot; linear in the text."""
    out, floor = [], 0
    for m in _TAIL.finditer(text):
        at = a = m.start()
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        if a < at:
            out.append((a, m.end()))
            floor = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    kinds = ([] if not ("@" in text or "at" in text and ("(" in text or "[" in text)) else ["email"]) + (["ip", "card", "phone"] if _DIGIT.search(text) else [])
    return [(k, *m.span()) for k in kinds for m in _LOOSE[k].finditer(text)]


def _kind_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and its context, as numbers."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", s)
    before = text[max(0, a - 40):a]
    words = re.findall(r"[^\W\d_][\w-]*", before.lower())[-4:]
    size = [len(g) for g in groups] or [0]
    return [
        *(float(kind == k) for k in KINDS), b - a, len(digits), len(groups), max(size), min(size), size[0],
        sum(not c.isalnum() for c in s), s.count("."), s.count("-"), s.count(" "), s.count(","), s.count("/"),
        float(s.startswith("+")), float(s.startswith("(")), float(s.startswith("00")), float("@" in s),
        float(bool(re.search(r"[\[(]\s?(?:at|dot)", s, re.I))), len(set(digits)),
        max((int(g[:9]) for g in groups), default=0) if len(groups) > 2 else -1,
        float(luhn(digits)) if digits else -1.0, int(digits[0]) if digits else -1,
        _kind_of(text[a - 1:a]), _kind_of(text[b:b + 1]),
        float(any(w.rstrip(":") in CUES[kind] for w in words)), float(":" in before[-3:]), sum(c.isdigit() for c in before),
    ]


def _variants(kind: str, s: str) -> list[tuple[str, int]]:
    """Rewritten spans with their label: forms that the base patterns miss, and broken ones."""
    if kind == "email":
        local, _, domain = s.partition("@")
        return [(f"{local} (at) {domain.replace('.', ' (dot) ')}", 1), (f"{local}[at]{domain}", 1), (f"{local} @ {domain}", 1), (f"{local} (at) 5.30", 0)]
    digits = [c for c in s if c.isdigit()]
    if kind == "card":
        broken = digits[:-1] + [str((int(digits[-1]) + 1) % 10)]
        return [(".".join("".join(digits[i:i + 4]) for i in range(0, len(digits), 4)), 1), ("".join(broken), 0), ("".join(digits[:13]), 0)]
    if kind == "phone":
        return [("00" + "".join(digits), 1), (f"({''.join(digits[1:4])}) {''.join(digits[4:7])}-{''.join(digits[7:])}", 1), ("".join(digits[:8]), 0), (f"20{''.join(digits[:2])}-0{digits[1]}-1{digits[2]}", 0)]
    parts = re.findall("[0-9]+", s)
    return [(".".join([*parts[:2], str(300 + int(parts[2])), parts[3]]), 0), (".".join(parts[:3]), 0), (",".join(parts), 0)]


def _spaced(items: list, most: int) -> list:
    """At most ``most`` of the items, evenly spaced."""
    return items if len(items) <= most else [items[k * len(items) // most] for k in range(most)]


def _labelled(text: str) -> tuple[list[list[float]], list[float]]:
    """Features and labels of candidates in a sampled text and in rewritten copies of its spans."""
    x, y = [], []
    base = base_spans(text)
    known = set(base)
    loose = candidates(text)
    ends, starts = sorted(b for _, _, b in base), sorted(a for _, a, _ in base)
    # a piece of a known span, or one around it, says nothing about the kind
    others = [c for c in loose if c not in known and bisect_right(ends, c[1]) >= bisect_left(starts, c[2])]
    of_kind = [s for k in KINDS for s in _spaced([s for s in base if s[0] == k], SPANS_PER_DOC)]
    proposed = set(loose)
    for c in [s for s in of_kind if s in proposed] + _spaced(others, OTHERS_PER_DOC):
        x.append(features(text, *c)); y.append(float(c in known))
    for k, a, b in of_kind:
        for new, label in _variants(k, text[a:b]):
            near = text[max(0, a - 60):a] + new + text[b:b + 20]
            lo = min(a, 60)
            for kind, p, q in candidates(near):
                if p < lo + len(new) and lo < q:
                    hit = label and kind == k and p <= lo and q >= lo + len(new)
                    x.append(features(near, kind, p, q)); y.append(float(bool(hit)))
    return x, y


class Judge:
    """A fitted model and its threshold; ``None`` model adds nothing."""

    def __init__(self, model: BoostedTrees | None = None, threshold: float = 1.0, held_out: dict | None = None):
        self.model, self.threshold, self.held_out = model, threshold, held_out or {}

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates over the threshold that touch no base span; of overlapping ones the likeliest."""
        if self.model is None:
            return []
        free = [c for c in candidates(text) if not any(c[1] < b and a < c[2] for _, a, b in base)]
        if not free:
            return []
        p = self.model.probability(np.array([features(text, *c) for c in free], float))
        out: list[tuple[str, int, int]] = []
        for i in sorted(np.flatnonzero(p >= self.threshold), key=lambda i: (-p[i], free[i])):
            if not any(free[i][1] < b and a < free[i][2] for _, a, b in out):
                out.append(free[i])
        return out

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans), by kind as listed, then start."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _sampled(source: DataFrame, sample_docs: int) -> dict[int, tuple[str, int]]:
    """Keys of the sampled texts, each with its share and its rank there. Half
    of ``sample_docs`` are texts with base spans, the same number for each
    kind; the others have candidates, but no base span. Every text is looked
    at; those with the least hashes are taken, copies once."""
    quota = {k: max(1, sample_docs // (2 * len(KINDS))) for k in KINDS} | {"": max(1, sample_docs // 2)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list[int]] = {k: [] for k in quota}  # heaps of negated keys
        held: dict[str, set[int]] = {k: set() for k in quota}

        def wanted(share: str, key: int) -> bool:
            return key not in held[share] and (len(least[share]) < quota[share] or -least[share][0] > key)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not any(wanted(k, key) for k in quota):
                    continue
                text = value.as_py()
                shares = {k for k, _, _ in base_spans(text)} or ({""} if wanted("", key) and candidates(text) else ())
                for k in shares:
                    if wanted(k, key):
                        heapq.heappush(least[k], -key)
                        held[k].add(key)
                        if len(least[k]) > quota[k]:
                            held[k].discard(-heapq.heappop(least[k]))
        rows = [(k, -key) for k, keys in least.items() for key in keys]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["share", "key"])

    found = source.mapInArrow(work, "share string, key long").distinct()
    rank = F.row_number().over(Window.partitionBy("share").orderBy("key"))
    bound = F.when(F.col("share") == "", quota[""]).otherwise(quota[KINDS[0]])
    rows = found.withColumn("rank", rank).filter(F.col("rank") <= max(quota.values())).filter(F.col("rank") <= bound).collect()
    out: dict[int, tuple[str, int]] = {}
    for r in sorted(rows, key=lambda r: (r.share, r["rank"])):
        out.setdefault(r.key, (r.share, r["rank"]))
    return out


def _sample_rows(source: DataFrame, keys: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features and labels by key; the texts stay where they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key not in seen:
                    seen.add(key)
                    x, y = _labelled(value.as_py())
                    out.append((key, np.array(x, float).tobytes(), np.array(y, float).tobytes()))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["key", "x", "y"])

    rows = source.filter(F.col("key").isin(keys)).mapInArrow(work, "key long, x binary, y binary").dropDuplicates(["key"]).collect()
    width = len(features("", KINDS[0], 0, 0))
    return {r.key: (np.frombuffer(r.x).reshape(-1, width), np.frombuffer(r.y)) for r in rows}


def fit_judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 600, least_precision: float = 0.98) -> Judge:
    """Fits on at most ``sample_docs`` texts: an eighth of them for each kind
    that the base patterns find, half with candidates only. A text adds at
    most ``SPANS_PER_DOC`` spans of a kind with their variants and
    ``OTHERS_PER_DOC`` other candidates; only their features and labels reach
    the driver. Labels come from the base patterns and from rewritten or
    broken copies of their spans. Two thirds of the documents fit the trees;
    the rest calibrate the probability and set the least threshold with
    ``least_precision`` from there on.

    Warns if a kind has fewer than ``LEAST`` positives to fit or to hold out,
    or if there are too few rows for a model; ``held_out["positives"]`` has the counts."""
    source = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike("@|[0-9]|(?i:[\\[(]\\s?at\\s?[\\])])"))
    source = source.select(F.xxhash64("text").alias("key"), "text")
    keys = _sampled(source, sample_docs)
    if not keys:
        return Judge()
    got = _sample_rows(source, sorted(keys))
    order = sorted(got, key=lambda k: keys[k])
    x, y = np.concatenate([got[k][0] for k in order]), np.concatenate([got[k][1] for k in order])
    fold = np.concatenate([np.full(len(got[k][1]), keys[k][1] % 3) for k in order])
    fit, held = fold != 2, fold == 2
    positives = {k: (int(y[fit & (x[:, i] == 1)].sum()), int(y[held & (x[:, i] == 1)].sum())) for i, k in enumerate(KINDS)}
    few = [f"{k} {a} and {b}" for k, (a, b) in positives.items() if min(a, b) < LEAST]
    if few:
        warnings.warn(f"personal data: too few positives of a kind to fit and to hold out ({', '.join(few)}); its hidden forms are judged by the other kinds, if at all", stacklevel=2)
    if not held.any() or min(y[fit].sum(), (1 - y[fit]).sum(), y[held].sum(), (1 - y[held]).sum()) < LEAST:
        warnings.warn("personal data: too few labelled rows for a model; only the base patterns count", stacklevel=2)
        return Judge(held_out={"positives": positives})
    model = BoostedTrees().fit(x[fit], y[fit]).calibrate(x[held], y[held])
    p, truth = model.probability(x[held]), y[held]
    order = np.argsort(-p, kind="stable")
    precision = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= least_precision)
    threshold = max(0.9, float(p[order[good[-1]]])) if len(good) else 2.0
    taken = p >= threshold
    stats = {"rows": int(held.sum()), "precision": float(truth[taken].mean()) if taken.any() else None, "recall": float(truth[taken].sum() / max(truth.sum(), 1)), "positives": positives}
    return Judge(model, threshold, stats)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", judge: Judge | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of the base spans, their digest, and
    all spans as ``kind:start:end`` (code points, end exclusive).

    Null and empty texts have no spans; repeated rows are treated alike; an
    empty table gives an empty result; other columns are not read. One narrow
    pass, besides the two that draw the sample.
    """
    judge = judge or fit_judge(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, spans = judge.spans(value.as_py() or "")
                kinds = [s[0] for s in base]
                rows.append([*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)])
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return source.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, judge: Judge | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans of
    several kinds become one mark, named after the first. Columns and rows
    stay as they are, null texts null; ``length_col`` is set to the new length
    where the text changed."""
    judge = judge or fit_judge(docs, id_col, text_col)
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col else -1

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for kind, a, b in sorted(judge.spans(text)[1], key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if size >= 0:
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)
