"""Substring dedup by super-k-mers: windows of 13 words that an earlier document also has.

Consecutive windows that share a minimiser (the smallest hash of a 3-word gram in them)
travel as one packed string to the minimiser's bucket. There windows are sorted, equal ones
(byte for byte) meet, and each whose smallest document id is not its own is marked. A text
loses every word that a marked window covers; windows are judged on the input.

Defined results: null text counts as empty and has no words; a null id counts as the largest
id; rows with one id do not remove each other's words, whether their texts are equal or not
(an equal id is not smaller); texts under 13 words lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Spans, anchors, column, eights, equal_spans, expand, stretches
from .shards import Cut, Runs, is_heavy, without_marked

WINDOW, GRAM = 13, 3
#: Words of one part of a text that is longer than a piece.
PART = 200_000


def _split(text: bytes) -> Iterator[tuple[bytes, int]]:
    words = text.split()
    for k in range(0, max(1, len(words) - WINDOW + 1), PART):
        yield b" ".join(words[k : k + PART + WINDOW - 1]), k


def _runs(data, at, did, rk, base, heavy) -> tuple[Runs, Spans]:
    raw = data.tobytes()
    texts = [b" ".join(raw[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    some = np.flatnonzero([len(t) > 0 for t in texts])
    buf = np.frombuffer(b"\n".join([texts[i] for i in some.tolist()]), np.uint8)
    gaps = np.flatnonzero((buf == 32) | (buf == 10))
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
    doc = np.concatenate([[0], np.cumsum(buf[gaps] == 10)])
    spans = Spans(buf)
    s = np.flatnonzero(doc[: max(0, len(doc) - WINDOW + 1)] == doc[WINDOW - 1 :]) if len(buf) else np.zeros(0, np.int64)
    if not len(s):
        none = np.zeros(0, np.int64)
        return Runs(buf, none, none, none.astype(np.uint64), none, none, none, none), spans
    gram = spans.hash(start[: len(start) - GRAM + 1], end[GRAM - 1 :])
    anchor = anchors(gram, WINDOW - GRAM + 1)[s]
    route = gram[anchor]
    hot = is_heavy(route, heavy)
    if hot.any():  # each window by its own hash
        route[hot] = spans.hash(start[s[hot]], end[s[hot] + WINDOW - 1])
    new = np.ones(len(s), bool)
    new[1:] = (np.diff(s) != 1) | (np.diff(doc[s]) != 0) | (np.diff(anchor) != 0) | hot[1:] | hot[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(s)]]))
    owner = some[doc[s[first]]]
    word0 = np.searchsorted(doc, doc[s[first]])
    return Runs(buf, did[owner], rk[owner], route[first], base[owner] + s[first] - word0, count, start[s[first]], end[s[first + count - 1] + WINDOW - 1]), spans


def _judge(f, text, start):
    """Windows of a bucket whose words an owner with a smaller id also has."""
    none = np.zeros(0, np.int64)
    _, place, times = np.unique(f["route"], return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[place] > 1)  # a window alone under its minimiser has no equal
    if not len(some):
        return none, none, none
    flag = np.zeros(len(text) + 1, bool)
    flag[start] = True
    flag[1:][text == 32] = True
    word = np.flatnonzero(flag[:-1])
    word0, count, stop = np.searchsorted(word, start[some]), f["windows"][some], (start + f["size"])[some]
    run = np.repeat(np.arange(len(some)), count)
    w = expand(word0, count)
    a, last = word[w], w + WINDOW - 1
    final = last == (word0 + count + WINDOW - 2)[run]
    b = np.where(final, stop[run], word[np.minimum(last + 1, len(word) - 1)] - 1)
    did = f["did"][some][run]
    h = Spans(text).hash(a, b)
    order = np.lexsort((did, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.flatnonzero(did[order] > did[first])
    x, y = order[later], first[later]
    same = (b[x] - a[x] == b[y] - a[y]) & equal_spans(eights(text), a[x], a[y], np.minimum(b[x] - a[x], b[y] - a[y]))
    marked = np.zeros(len(w), bool)
    marked[x[same]] = True
    if not same.all():  # two texts under one hash: compare the bytes of those windows themselves
        least: dict[bytes, int] = {}
        clash = np.flatnonzero(np.isin(h, h[x[~same]])).tolist()
        strings = {i: text[a[i] : b[i]].tobytes() for i in clash}
        for i in clash:
            least[strings[i]] = min(least.get(strings[i], did[i]), did[i])
        for i in clash:
            marked[i] = did[i] > least[strings[i]]
    head = np.concatenate([[True], run[1:] != run[:-1]])
    s, e = stretches(marked, head)
    return some[run[s]], w[s] - word0[run[s]], e - s


CUT = Cut(_runs, _split)
SCHEMA = "n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def _removed(batch: pa.RecordBatch, marks) -> pa.RecordBatch:
    data, at = column(batch.column("text"))
    raw = data[at[0] : at[-1]].tobytes()
    at = (at - at[0]).tolist()
    n_words, n_removed, kept, spans = [], [], [], []
    for i, m in enumerate(marks):
        words = raw[at[i] : at[i + 1]].split()
        n_words.append(len(words))
        out = []
        if m:
            gone = np.zeros(len(words), bool)
            gone[expand(m[0], m[1] + WINDOW - 1)] = True
            s, e = stretches(gone, np.zeros(len(gone), bool))
            out = [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())]
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words))
        spans.append(out)
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
        ["row", "n_words", "n_removed", "kept_text", "removed"],
    )


def remove_repeated_windows(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its other columns as ``row``, n_words, n_removed, the kept words
    joined by spaces and the removed word ranges."""
    return without_marked(docs, CUT, _judge, True, _removed, SCHEMA)


def window_report(docs: DataFrame) -> DataFrame:
    done = remove_repeated_windows(docs)
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
