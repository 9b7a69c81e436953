"""Plain single-machine versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def simhash(rows):
    """rows: (doc_id, text). doc_id -> (fingerprint, component), by comparing all pairs."""
    import xxhash

    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                root[a] = b
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {(d, f"{prints[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(rows)}


def repeated_bytes(rows, n=400):
    count: dict[bytes, int] = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - n + 1):
            count[b[i : i + n]] += 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def without_passages(rows, n, least_words):
    """Texts without repeated spans (covered by n bytes that start twice) of enough whole words."""
    import re

    count: dict[bytes, int] = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - n + 1):
            count[b[i : i + n]] += 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        words_at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        left = b""
        for m in re.finditer(rb"\x00+|\x01+", bytes(gone)):
            s, e = m.span()
            if m[0][:1] == b"\x00" or sum(s <= x and y <= e for x, y in words_at) < least_words:
                left += b[s:e]
        out.append((d, left.decode("utf-8", "ignore")))
    return out


def repeated_windows(rows, n=13):
    least: dict[tuple, int] = {}
    split = [(d, words(t)) for d, t in rows]
    big = 1 << 63
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, big), big - 1 if d is None else d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < (big - 1 if d is None else d):
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def base_rules(text: str | None) -> dict:
    """Base measures and verdict of the quality rules, and the verdict of all rules."""
    import re

    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    shingles = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count: dict[tuple, int] = defaultdict(int)
    for s in shingles:
        count[s] += 1
    inside = {i + k for i, s in enumerate(shingles) if count[s] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}
    m["base_failed"] = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    upper = sum(__import__("unicodedata").category(c) == "Lu" for c in t)
    more = (
        100 * m["n_symbols"] > 15 * len(w)
        or (100 * upper > 30 * m["word_chars"] and 100 * t.count("!") > 10 * len(w))
        or 100 * m["n_dup_lines"] > 50 * len(lines)
        or not 2 * len(w) <= m["word_chars"] <= 25 * len(w)
    )
    m["kept"] = not (m["base_failed"] or more)
    return m


def plain_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def smith_waterman(a, b) -> int:
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, max(row)), row
    return best


def leaks(rows, items, least=0.5):
    """(doc_id, item_id) -> score, over whole documents, where two 3-word grams are shared;
    items of 3 to 7 words where they stand whole."""
    out: dict = {}
    split = [(i, plain_words(t)) for i, t in items]
    for d, t in rows:
        w = plain_words(t)
        grams = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for i, q in split:
            if 3 <= len(q) < 8 and any(w[k : k + len(q)] == q for k in range(len(w))):
                out[d, i] = 1
            if len(q) >= 8 and len(grams & {tuple(q[k : k + 3]) for k in range(len(q) - 2)}) >= 2:
                s = smith_waterman(q, w) / (2 * len(q))
                if s >= least:
                    out[d, i] = max(s, out.get((d, i), 0))
    return out


def warc(rows):
    """rows: (page_id, html)."""
    import base64

    data = [(p, (h or "").encode()) for p, h in rows]
    big = 1 << 63
    least: dict[bytes, int] = {}
    for p, b in data:
        least[b] = min(least.get(b, big), big if p is None else p)
    out = []
    for p, b in data:
        own = least[b] >= (big if p is None else p)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else least[b]))
    return out


def tokens(rows):
    """doc_id, number of ids and the two digests, by the tiktoken library."""
    import struct

    import tiktoken

    from tablescope.llm.byte_bpe import load_ranks, public_vocabulary

    path, pattern = public_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    out = []
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        out.append((d, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    return out


def hard_negatives(rows):
    """rows: (vec_id, vector, label). Counter of the rows of the fixed mining query."""
    import math
    from collections import Counter

    big = 1 << 63
    usable = []
    for at, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((at, i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    rank = lambda r: (-r[0], big if r[1] is None else r[1], r[2])
    out = Counter()
    for at, i, v, label in usable:
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, b, other == label) for b, j, w, other in usable if b != at]
        for ps, p, _, _ in sorted((r for r in scored if r[3]), key=rank)[:5]:
            inside = sorted((r for r in scored if not r[3] and 80 * ps <= 100 * r[0] <= 100 * ps), key=rank)[:5]
            for k, (ns, n, _, _) in enumerate(inside):
                out[i, p, k + 1, n, ps, ns] += 1
    return out


def periodic_runs(words, least=12):
    """(start, length, period) by start and period, by comparing words q apart for every q."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(rows):
    import zlib

    out = []
    for d, t in rows:
        w = words(t)
        h = zlib.crc32(str(d).encode())
        if d is not None and w and h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = periodic_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode())
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((d, len(found), *longest, digest, sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def exact_copies(rows):
    import re

    big = 1 << 63
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for at, ((d, _), t) in enumerate(zip(rows, norm)):
        groups[t].append((big if d is None else d, at))
    out = []
    for at, ((d, _), t) in enumerate(zip(rows, norm)):
        least, _ = min(groups[t])
        out.append((d, None if least == big else least, len(groups[t]), sha(t.encode())))
    return out
