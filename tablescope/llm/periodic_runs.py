"""Periodic runs of words: a suffix automaton whose link tree is kept as a link-cut forest.

Words are appended one by one. The automaton's state of a prefix stands for its suffixes;
the path from there to the root, over suffix links, stands for all of them. Each node's
colour is the last place where its words ended. A preferred path of the link-cut forest has
one colour, so accessing the new state walks over few segments: the segment with colour j
and longest word count L says that the last L words also ended at j. With d = i - j <= L
that is a square: words d apart are equal from i - L - d + 1 to i, no further left, and d is
the smallest period. The access recolours the whole path with i. Squares with one start and
one period are one run, up to the last i at which they are found.

Only words that a long run can contain are appended: a run of ``least`` words or more with
period at most half of it repeats windows of ceil(least / 2) words, and these cover it. So a
text is first cut down, again and again, to stretches covered by windows that occur twice in
their stretch; what is cut cannot be in a run, and no run crosses a cut.

Defined results: a null text has no words and is not changed by ``planted``; a null doc_id
makes no change either and is returned. Repeated rows give a row each, an empty table none;
further columns are ignored. A text is the unit of work: memory of a task grows with the longest
covered stretch of one text (about 1 kB a word), not with the number of texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, tidy

#: A run has at least so many words.
LEAST = 12


class Squares:
    """The automaton of the words appended so far and its forest of suffix links."""

    def __init__(self) -> None:
        # by state: longest word count, suffix link (-1: root), words that lead on
        self.size, self.link, self.next = [0], [-1], [{}]
        # by state, the splay tree of its preferred path, ordered by depth: children, the
        # parent (at the top of a tree: the state above the path) and, at the top, the colour
        self.up, self.left, self.right, self.seen = [-1], [-1], [-1], [-1]
        self.state, self.n = 0, 0

    def _new(self, size: int, link: int, way: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(way)
        self.up.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.seen.append(-1)
        return len(self.size) - 1

    def _splay(self, x: int) -> None:
        """Make ``x`` the top of its tree."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if p < 0 or (left[p] != x and right[p] != x):
            return
        top = p
        while True:
            g = up[top]
            if g < 0 or (left[g] != top and right[g] != top):
                break
            top = g
        self.seen[x] = self.seen[top]
        while True:
            p = up[x]
            if p < 0:
                return
            own = left[p] == x
            if not own and right[p] != x:
                return
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if own == (left[g] == p) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def append(self, word: int) -> Iterator[tuple[int, int]]:
        """Add a word; the (start, period) of all squares that end with it."""
        size, link, ways = self.size, self.link, self.next
        i, p = self.n, self.state
        self.n += 1
        cur = self._new(size[p] + 1, -1, {})
        while p >= 0 and word not in ways[p]:
            ways[p][word] = cur
            p = link[p]
        if p < 0:
            to = 0
        else:
            to = ways[p][word]
            if size[to] != size[p] + 1:
                to = self._split(p, to, word)
        link[cur] = self.up[cur] = to
        self.state = cur
        return self._access(cur, i)

    def _split(self, p: int, old: int, word: int) -> int:
        """A state for the suffixes of ``old`` of up to size[p] + 1 words, right above it in
        its path, with its colour."""
        size, link, ways = self.size, self.link, self.next
        new = self._new(size[p] + 1, link[old], ways[old].copy())
        link[old] = new
        while p >= 0 and ways[p].get(word) == old:
            ways[p][word] = new
            p = link[p]
        self._splay(old)
        above = self.left[old]
        self.left[new] = above
        if above >= 0:
            self.up[above] = new
        self.left[old], self.up[new] = new, old
        return new

    def _access(self, x: int, i: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from state ``x`` to the root with ``i``."""
        found, below = [], -1
        up, right, seen = self.up, self.right, self.seen
        while x >= 0:
            self._splay(x)
            length, j = self.size[x], seen[x]
            if j >= 0 and 0 < i - j <= length:
                found.append((j - length + 1, i - j))
            deeper = right[x]
            if deeper >= 0:
                seen[deeper] = j
            right[x] = below
            below, x = x, up[x]
        if below >= 0:
            seen[below] = i
        return found


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers, by start and
    period."""
    last: dict[tuple[int, int], int] = {}
    out = []
    for a, b in stretches(words, least):
        last.clear()
        squares = Squares()
        for i, w in enumerate(words[a:b].tolist()):
            for square in squares.append(w):
                last[square] = i
        for (start, period), end in last.items():
            length = end - start + 1
            if length >= max(least, 2 * period):
                out.append((a + start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The parts of a sequence that runs can lie in, as (start, end). Windows are compared by
    a hash: two that look alike only keep more."""
    w = (least + 1) // 2
    n = len(words)
    if n < least:
        return []
    mixed = mix(words.astype(np.uint64))
    grams = mixed[: n - w + 1].copy()
    for k in range(1, w):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += mixed[k : n - w + 1 + k]
    at = np.arange(n - w + 1)  # the starts of the windows that are left
    part = np.zeros(len(at), np.int64)  # their stretches
    while len(at):
        key = mix(grams[at] + np.uint64(0xBF58476D1CE4E5B9) * part.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        left = at[twice]
        if len(left) == len(at):
            break
        at = left
        # windows whose words touch or overlap share a stretch, as long as both were in one
        cut = np.concatenate([[0], np.cumsum((np.diff(at) > w) | (np.diff(part[twice]) != 0))]) if len(at) else at
        part = cut.astype(np.int64)
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
    end = np.concatenate([first[1:], [len(at)]]) - 1
    return [(a, b) for a, b in zip(at[first].tolist(), (at[end] + w).tolist()) if b - a >= least]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The fixed change of one document in ten: from a word on, its words repeat."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def with_runs(docs: DataFrame, least: int = LEAST, change=None) -> DataFrame:
    """For every row: doc_id, its words without the repetitions of runs as ``collapsed``
    (joined by one space), their number n_words, and ``runs`` (start, length, period) by
    start and period. A word goes if a run contains it after that run's first period.
    ``change(words, doc_id)`` may replace the words first."""
    change = change or (lambda words, doc_id: words)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def out(ids, texts, counts, runs):
        arrays = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(runs, run_type)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "collapsed", "runs"])

    def run(batches):
        for batch in batches:
            ids, texts, counts, all_runs, held = [], [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = change((text.as_buffer().to_pybytes() if text.is_valid else b"").split(), doc_id)
                number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                runs = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least)
                if runs:
                    step = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in runs:
                        step[start + period] += 1
                        step[start + length] -= 1
                    words, n = [x for x, c in zip(words, np.cumsum(step[:-1]).tolist()) if not c], len(words)
                else:
                    n = len(words)
                ids.append(doc_id)
                counts.append(n)
                texts.append(b" ".join(words).decode("utf-8", "replace"))
                all_runs.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                held += len(texts[-1]) + 24 * len(runs)
                if held > 8 << 20:
                    yield out(ids, texts, counts, all_runs)
                    ids, texts, counts, all_runs, held = [], [], [], [], 0
            yield out(ids, texts, counts, all_runs)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, collapsed string, runs array<struct<start: long, length: long, period: long>>")


def runs_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length (ties: smallest start, then period) with
    its exponent in thousandths, the digest of all runs and that of the words left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = with_runs(docs, change=planted).select("*", best.alias("best"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div (-best.period)").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
