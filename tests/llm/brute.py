"""Plain versions of the operators, for small tables: loops over rows and dicts."""
import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring(rows, width=35):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + width]) for _, w in docs for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix(rows, width=400):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + width] for _, b in docs for k in range(len(b) - width + 1))
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def fingerprint(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + width]).encode(), 42) for k in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, bits=2):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    repeat = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def words_of(text):
    return tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or ""))


def line_rule(rows, min_words=20, max_repeat_percent=30, max_line_documents=10, max_line_percent=1.0, min_kept_percent=30, min_kept_words=10):
    """From (id, host, text), ids unique: the lines over the limit by host, and
    per row id, words removed, kept, text without those lines."""
    seen, size = {}, {}
    for _, host, text in rows:
        size.setdefault(host or "", set()).add(words_of(text))
        for line in (text or "").split("\n"):
            if words_of(line):
                seen.setdefault((host or "", words_of(line)), set()).add(words_of(text))
    gone = {k for k, d in seen.items() if len(d) > max_line_documents and len(d) > len(size[k[0]]) * max_line_percent / 100}
    out = []
    for i, host, text in rows:
        lines = (text or "").split("\n")
        lost = [x for x in lines if (host or "", words_of(x)) in gone]
        n, repeated, removed = measures(text)[0], measures(text)[4], sum(len(words_of(x)) for x in lost)
        failed = n < min_words or 100 * repeated > max_repeat_percent * n
        depleted = n - removed < min_kept_words or 100 * (n - removed) < min_kept_percent * n
        out.append((i, removed, not failed and not depleted, "\n".join(x for x in lines if (host or "", words_of(x)) not in gone)))
    return {k: len(seen[k]) for k in gone}, out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = terms(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = terms(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for k, d in enumerate(int(c) for c in reversed(digits)):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text = text or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, *s) for k, spans in (("email", email), ("ip", ip), ("card", card), ("phone", phone)) for s in spans]


def hidden(text):
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" if c == "_" else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
    found = [("assign", *m.span()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def spans(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def chat(rows):
    """From (conv, turn, role, text): n_turns, turns, loss text, formatted length."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        shown = 0
        for _, role, text in turns:
            shown += len("<|im_start|>\n<|im_end|>\n") + sum(len(x) + x.count("\\") + x.count("<|") for x in (role, text)) + role.count("\n")
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), shown))
    return out


def archive(pages):
    """From (page, html): bytes, digest, type, target."""
    bodies = [(p, (h or "").encode()) for p, h in pages]
    top = {}
    for p, b in bodies:
        if p is not None:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, b in bodies:
        again = len(b) >= 1000 and p is not None and p != top[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return out


def token_pieces(tokenizer, rows, capacity=2048):
    import zlib

    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k:k + capacity], "<u4")
            out.append((i, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return out


def first_fit_decreasing(lengths, capacity=2048):
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(capacity - n)
        else:
            gaps[k] -= n
    return len(gaps)


def spelling(rows, every=31, min_length=7, min_count=2, factor=10):
    import zlib

    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    around = {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= factor * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), words[form[w]] if w in form else None))
    return out


def whitening(rows, most=32):
    """(id, deviation) of the usable rows, and their whitened matrix and shares."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in rows), default=0)
    rows = [(i, v) for i, v in rows if len(v) == dims]
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for _, v in rows], object)
    apart = len(x) * x - x.sum(axis=0)
    centred = apart.astype(float) / len(x)
    cov = centred.T @ centred / len(x)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    live = values > values[0] * 1e-12
    white = np.where(live, centred @ vectors / np.sqrt(np.where(live, values, 1)), 0)
    return [(i, int(d)) for (i, _), d in zip(rows, (apart * apart).sum(axis=1))], white, np.where(live, values, 0) / np.trace(cov)
