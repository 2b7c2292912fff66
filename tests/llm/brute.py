"""Plain versions of the operators, in the words of their contracts."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import xxhash

WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def records(pages, min_bytes=0):
    """(page_id, bytes, digest, type, refers_to) of each page, sorted."""
    rows = [(p, (h or "").encode()) for p, h in pages]
    out = []
    for page, body in rows:
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids = [p for p, b in rows if b == body and p is not None]
        first = min(ids, default=None)
        revisit = len(body) >= min_bytes and first is not None and page != first
        kind = "revisit" if revisit else "response"
        out.append((page, len(body), digest, kind, first if revisit else None))
    return sorted(out, key=repr)


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def fingerprint(text):
    w = re.findall(WORD, lower_ascii(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def simhash(rows, distance=2):
    """(doc_id, fingerprint, component) of (doc_id, text) rows, sorted."""
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if group[i] != group[j] and (fps[i] ^ fps[j]).bit_count() <= distance:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
                    changed = True
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for g, (d, _) in zip(group, rows) if g == group[i] and d is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def overlaps(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, sha, contaminated) of each document, sorted."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for item, phrase in items:
            p = split(phrase)
            size = min(window, len(p))
            for a in range(len(p) - size + 1 if p else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == p[a : a + size]:
                        hit |= set(range(at, at + size))
                        names.add("null" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=repr)


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = re.findall(WORD, text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    over = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(WORD, x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 10 or 100 * len(over) > 20 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, len(over), failed


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """(start, rank, end, kind) of the base spans, sorted."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
