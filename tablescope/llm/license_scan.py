"""License scan: winnowed template fingerprints pick candidates, banded alignment measures.

Each template's 3-word grams are winnowed (the smallest hash of every WINNOW neighbours) into
an inverted index of hash to (template, place). Templates are a parameter, so the index is
bounded by them and goes to every task; all grams of a document are looked up in it. Hits of
a template on neighbouring diagonals make a candidate, which is aligned with the template
inside a band around them; what lies left and right of a match is aligned again while it has
hits enough, so copies that follow each other closely are all found. Matches report the covered share of the template and the matched
word spans of the document.

Defined results: null and empty texts have no matches; repeated rows are each scanned; a
license that stands twice in a text is reported twice; of matches that overlap by half or
more the one with more matched words is kept, then the better covered, then the first name.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, column, expand, pieces, tidy
from .decontaminate import GRAM, gram_hashes, word_edges
from .license_texts import TEMPLATES

WINNOW = 3
MIN_COVERAGE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
PIECE = 1 << 20


@dataclass(frozen=True)
class Index:
    """Sorted fingerprints with the template and place of each, and the templates' words."""

    hash: np.ndarray
    template: np.ndarray
    place: np.ndarray
    names: list[str]
    words: list[list[bytes]]
    prints: np.ndarray


def build_index(templates: dict[str, str] = TEMPLATES) -> Index:
    rows, words, prints = [], [], []
    for t, text in enumerate(templates.values()):
        buf = np.frombuffer(text.lower().encode(), np.uint8)
        start, end = word_edges(buf, np.array([0, len(buf)]))
        raw = buf.tobytes()
        words.append([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])
        g = gram_hashes(buf, start, end)
        w = min(WINNOW, len(g))
        chosen = sorted({i + int(np.argmin(g[i : i + w])) for i in range(len(g) - w + 1)}) if w else []
        rows += [(int(g[i]), t, i) for i in chosen]
        prints.append(len(chosen))
    rows.sort()
    h, t, p = zip(*rows) if rows else ((), (), ())
    return Index(np.array(h, U64), np.array(t, np.int64), np.array(p, np.int64), list(templates), words, np.array(prints, np.int64))


def banded(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, list[int]]:
    """Local alignment of word numbers within ``band`` of text place = template place +
    ``diagonal``: its score and the places of the text's matched words."""
    m, n, width = len(template), len(text), 2 * band + 1
    h = np.zeros((m + 1, width + 1), np.int32)  # one more column, always 0, at the right
    slope = np.arange(width, dtype=np.int32) * -GAP
    j = np.arange(width) + diagonal - band  # text place of each cell in template row 0
    for i in range(1, m + 1):
        at = j + i - 1
        inside = (at >= 0) & (at < n)
        same = inside & (text[np.clip(at, 0, n - 1)] == template[i - 1])
        row = np.maximum(np.maximum(h[i - 1, :-1] + np.where(same, MATCH, MISMATCH), h[i - 1, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope) - slope
        h[i, :-1] = np.where(inside, row, 0)
    i, b = np.unravel_index(int(h.argmax()), h.shape)
    if width > 8 * m + 64:  # many copies may tie: the one nearest the middle halves the rest
        ties = np.flatnonzero(h[i] == h[i, b])
        b = ties[len(ties) // 2]
    score, matched = int(h[i, b]), []
    while i > 0 and 0 <= b < width and h[i, b] > 0:
        at = int(j[b]) + i - 1
        same = 0 <= at < n and text[at] == template[i - 1]
        if h[i, b] == h[i - 1, b] + (MATCH if same else MISMATCH):
            if same:
                matched.append(at)
            i -= 1
        elif h[i, b] == h[i - 1, b + 1] + GAP:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return score, matched[::-1]


def _matches(index: Index, words: list[bytes], template: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> list[dict]:
    """Matches of a document from its hits (template, place and diagonal of each)."""
    order = np.lexsort((diagonal, template))
    template, place, diagonal = template[order], place[order], diagonal[order]
    size = np.array([len(w) for w in index.words])
    band = 8 + size // 10
    cut = np.concatenate([[True], (np.diff(template) != 0) | (np.diff(diagonal) > band[template[1:]])])
    edge = np.concatenate([np.flatnonzero(cut), [len(template)]]).tolist()
    found = []
    for a, b in zip(edge[:-1], edge[1:]):
        t = int(template[a])
        w = int(band[t])
        number: dict[bytes, int] = {}
        want = np.array([number.setdefault(v, len(number)) for v in index.words[t]])
        first = max(0, int(diagonal[a]) - w)
        have = np.array([number.get(v, -1) for v in words[first : int(diagonal[b - 1]) + int(size[t]) + w]])
        todo = [(place[a:b], diagonal[a:b], 0, len(words))]
        while todo:  # hits and the words between which they stand
            at, diagonals, left, right = todo.pop()
            if len(at) < min(2, index.prints[t] // 4 + 1):
                continue
            low, high = int(diagonals[0]), int(diagonals[-1])
            reach = (high - low + 1) // 2 + w
            x, y = max(left, low - w), min(right, high + int(size[t]) + w)
            _, got = banded(want, have[max(0, x - first) : max(0, y - first)], (low + high) // 2 - x, reach)
            coverage = len(got) / len(want)
            if coverage < MIN_COVERAGE:
                continue
            places = np.array(got) + x
            s = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            ends = np.concatenate([places[s[1:] - 1], places[-1:]]) + 1
            start, end = int(places[0]), int(places[-1]) + 1
            found.append({"license": index.names[t], "coverage": coverage, "n_matched": len(got), "start": start, "end": end, "spans": [{"start": p, "end": q} for p, q in zip(places[s].tolist(), ends.tolist())]})
            before, after = at + GRAM <= start, at >= end
            todo += [(at[before], diagonals[before], left, start), (at[after], diagonals[after], end, right)]
    found.sort(key=lambda f: (-f["n_matched"], -f["coverage"], f["license"], f["start"]))
    kept: list[dict] = []
    spans: list[tuple[int, int]] = []  # of the kept, by start
    longest = max((f["end"] - f["start"] for f in found), default=0)
    for f in found:
        near = spans[bisect_left(spans, (f["start"] - longest,)) : bisect_left(spans, (f["end"],))]
        if all(2 * (min(f["end"], e) - max(f["start"], s)) < min(f["end"] - f["start"], e - s) for s, e in near):
            kept.append(f)
            insort(spans, (f["start"], f["end"]))
    return sorted(kept, key=lambda f: f["start"])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, coverage 0 to 1, n_matched, start, end, spans): one row a match, with
    places in words of the document."""
    index = build_index(templates)
    kinds = {"doc_id": pa.int64(), "license": pa.string(), "coverage": pa.float64(), "n_matched": pa.int64(), "start": pa.int64(), "end": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}

    def run(batches):
        for batch in batches:
            data, at_all = column(batch.column("low"))
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j in pieces(at_all, PIECE):
                buf, at = data[at_all[i] : at_all[j]], at_all[i : j + 1] - at_all[i]
                start, end = word_edges(buf, at)
                g = gram_hashes(buf, start, end)
                a, b = np.searchsorted(index.hash, g, "left"), np.searchsorted(index.hash, g, "right")
                hit = np.flatnonzero(b > a)
                doc = np.searchsorted(at, start[hit], "right") - 1
                whole = start[hit + GRAM - 1] < at[doc + 1]
                hit, doc = hit[whole], doc[whole]
                n = (b - a)[hit]
                entry = expand(a[hit], n)
                place, of = np.repeat(hit, n), np.repeat(doc, n)
                word0 = np.searchsorted(start, at)
                edge = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else np.zeros(0, np.int64)
                rows = []
                for p, q in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    d = int(of[p])
                    x, y = int(word0[d]), int(word0[d + 1])
                    raw, s, e = buf[start[x] : end[y - 1]].tobytes(), (start[x:y] - start[x]).tolist(), (end[x:y] - start[x]).tolist()
                    words = [raw[k:m] for k, m in zip(s, e)]
                    for f in _matches(index, words, index.template[entry[p:q]], place[p:q] - x, place[p:q] - x - index.place[entry[p:q]]):
                        rows.append({"doc_id": ids[i + d].as_py(), **f})
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    schema = "doc_id long, license string, coverage double, n_matched long, start long, end long, spans array<struct<start:long,end:long>>"
    return docs.select("doc_id", F.lower("text").alias("low")).mapInArrow(tidy(run), schema)
