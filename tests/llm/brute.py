"""Plain single-machine versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

UPPER = {c: c + 32 for c in range(65, 91)}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def decontaminate(docs, items, size=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(UPPER))
    windows = {}
    for item, text in items:
        ws = words(text)
        if item is None or not ws:
            continue
        k = min(size, len(ws))
        for i in range(len(ws) - k + 1):
            windows.setdefault(tuple(ws[i : i + k]), set()).add(str(item))
    lengths = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        ws, hit, own = words(text), set(), set()
        for k in lengths:
            for i in range(len(ws) - k + 1):
                if found := windows.get(tuple(ws[i : i + k])):
                    hit.update(range(i, i + k))
                    own |= found
        out.append((doc, len(ws), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    return out


def near(docs, k=5):
    """doc_id, n_shingles, component_id, kept."""
    sets = {}
    for doc, text in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets[doc] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, pairs = {}, {}
    for d, s in sets.items():
        for x in s:
            for e in index.setdefault(x, []):
                pairs[e, d] = pairs.get((e, d), 0) + 1
            index[x].append(d)
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(d, len(s), root(d), root(d) == d) for d, s in sets.items()]


def pieces(docs, path, capacity=2048):
    from tokenizers import Tokenizer

    coder, out = Tokenizer.from_file(path), []
    for doc, text in docs:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            out.append((doc, i // capacity, i, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return out


def chats(rows):
    """rows: conv_id, turn, role, text. n_turns, turns_sha256, loss_chars, loss_sha256 by conv_id."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _spans(kinds, text):
    found = {k: [m.span() for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in kinds.items()}
    order = sorted((s, i, e, k) for i, k in enumerate(kinds) for s, e in found[k])
    return tuple(len(found[k]) for k in kinds), ",".join(f"{k}:{s}:{e}" for s, i, e, k in order)


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return _spans(
        {
            "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
            "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
        },
        text or "",
    )


def secrets(text):
    return _spans(
        {
            "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
            "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
            "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
        },
        text or "",
    )


def repeats(docs, size=13):
    """doc_id, n_words, n_removed, kept_sha256."""
    first, words = {}, []
    for doc, text in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words.append((doc, ws))
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, ws in words:
        gone = {j for i in range(len(ws) - size + 1) if first[tuple(ws[i : i + size])] < doc for j in range(i, i + size)}
        out.append((doc, len(ws), len(gone), sha(" ".join(w for j, w in enumerate(ws) if j not in gone))))
    return out


def nearest(vectors, queries, k=20):
    """vectors: id -> float array. The k ids with the largest inner product, for each query id."""
    import numpy as np

    ids = sorted(vectors)
    table = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        scores = table @ np.asarray(vectors[q], np.float64)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out[q] = [(ids[j], float(scores[j])) for j in order]
    return out
