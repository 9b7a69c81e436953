"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman scores them.

Texts are lower-cased and read as words (runs of ASCII letters and digits and of all other
characters beyond ASCII). The rare 3-word grams of the test items are the seeds: those that
stand in at most RARE items of different texts, and of every item the rarer half at least.
Rarity is judged among the items, never among the documents, so a stock phrase that many items
share ("which of the following") joins nothing, while a copied item is found however often it
is copied; each seed pairs a passage with RARE items at most, but where items are variants of
each other. A bitmap of fixed size with the seeds' hashes lets the scan of the documents drop
nearly all grams at once; what passes is clustered into passages, padded by the longest item,
and joined with the seeds. A passage and an item that share MIN_SEEDS seeds (an item under
MIN_WORDS words: all of its seeds) are aligned whole, unless too few words of the item stand
in the passage for any alignment to reach MIN_SCORE, and reported if the alignment reaches
MIN_SCORE of the item's full score. Items under MIN_WORDS words are reported as whole copies
only: a part of so few words says nothing.

Defined results: null and empty texts hold no words; items of one or two words have no seed
and are not looked for. Every row of the documents counts for itself, also where ids are
null or repeated; repeated items (one id and text) count once, items of one id and different
texts each. Of several alignments of a document with an item the best is reported (the
leftmost of ties). No documents or no items give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64, Spans, column, mix, pieces, stretches, tidy
from .common import stored

GRAM, MIN_WORDS, MIN_SEEDS = 3, 8, 2
#: A gram of more items (of different texts) is a stock phrase.
RARE = 64
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the seeds' bitmap: 2 MB whatever the number of items. A full bitmap costs time only.
BITS = 24
PIECE = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_edges(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words of the texts that ``at`` parts."""
    head = np.zeros(len(buf) + 1, bool)
    head[at] = True
    return stretches(_IS_WORD[buf], head[:-1])


def gram_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every GRAM neighbouring words, whatever stands between them."""
    if len(start) < GRAM:
        return np.zeros(0, U64)
    w = Spans(buf).hash(start, end)
    n = len(w) - GRAM + 1
    out = np.zeros(n, U64)
    for k in range(GRAM):
        out = mix(out * U64(0x9E3779B97F4A7C15) + w[k : k + n])
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("item_text")).dropDuplicates().withColumn("item", F.xxhash64("item_id", "item_text"))


def grams(items: DataFrame) -> DataFrame:
    """(item, text_key, gram, n_words), one row a distinct gram of an item."""

    def run(batches):
        for batch in batches:
            raw, at = column(batch.column("item_text"))
            out = [], [], [], []
            for i, (key, same) in enumerate(zip(batch.column("item").to_pylist(), batch.column("text_key").to_pylist())):
                buf = raw[at[i] : at[i + 1]]
                start, end = word_edges(buf, np.array([0, len(buf)]))
                if len(start) >= GRAM:
                    g = np.unique(gram_hashes(buf, start, end)).view(np.int64)
                    for o, v in zip(out, (key, same, g, len(start))):
                        o.append(np.broadcast_to(np.int64(v), len(g)))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *o])) for o in out], ["item", "text_key", "gram", "n_words"])

    return items.select("item", F.xxhash64("item_text").alias("text_key"), "item_text").mapInArrow(tidy(run), "item long, text_key long, gram long, n_words long")


def seeds(found: DataFrame) -> DataFrame:
    """(item, gram, n_words, need): the rare of an item's grams; ``need`` of them make a passage
    a candidate. The windows are over one item, whose grams its length bounds."""
    texts = found.groupBy("gram").agg(F.count_distinct("text_key").alias("n_texts"))
    item = Window.partitionBy("item")
    place = F.row_number().over(item.orderBy("n_texts", "gram"))
    rarer = 2 * F.col("place") <= F.col("n") + 1
    kept = found.join(texts, "gram").select("*", place.alias("place"), F.count(F.lit(1)).over(item).alias("n")).where(rarer | (F.col("n_texts") <= RARE))
    need = F.when(F.col("n_words") >= MIN_WORDS, MIN_SEEDS).otherwise(F.count(F.lit(1)).over(item))
    return kept.select("item", "gram", "n_words", need.cast("long").alias("need"))


def bitmap(found: DataFrame) -> np.ndarray:
    """One bit for the upper BITS bits of each gram, built by the executors in parts of 4 KB."""
    slot = F.shiftrightunsigned("gram", 64 - BITS)
    parts = found.select(F.shiftright(slot, 15).alias("part"), slot.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def passages(docs: DataFrame, bits: np.ndarray, pad: int, need: int = MIN_SEEDS) -> DataFrame:
    """(passage, row, doc_id, start, passage_text, grams): stretches of a document around
    ``need`` or more grams of the bitmap that stand at most ``pad`` words apart. ``row`` tells
    the rows of the documents apart, ``start`` is in words."""
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        from pyspark import TaskContext

        row0 = serial = TaskContext.get().partitionId() << 40
        bits = table.value
        for batch in batches:
            data, at_all = column(batch.column("low"))
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j in pieces(at_all, PIECE):
                buf, at = data[at_all[i] : at_all[j]], at_all[i : j + 1] - at_all[i]
                start, end = word_edges(buf, at)
                g = gram_hashes(buf, start, end)
                slot = g >> U64(64 - BITS)
                hit = np.flatnonzero((bits[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1)
                doc = np.searchsorted(at, start[hit], "right") - 1
                hit = hit[start[hit + GRAM - 1] < at[doc + 1]]
                if not len(hit):
                    continue
                doc = np.searchsorted(at, start[hit], "right") - 1
                new = np.concatenate([[True], (np.diff(hit) > pad) | (np.diff(doc) != 0)])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(hit)]])
                out = [], [], [], [], [], []
                word0 = np.searchsorted(start, at)  # first word of each text
                for a, b in zip(first.tolist(), last.tolist()):
                    grams = np.unique(g[hit[a:b]])
                    if len(grams) < need:
                        continue
                    d = int(doc[a])
                    x = max(int(word0[d]), int(hit[a]) - pad)
                    y = min(int(word0[d + 1]) - 1, int(hit[b - 1]) + GRAM - 1 + pad)
                    for o, v in zip(out, (serial, row0 + i + d, ids[i + d].as_py(), x - int(word0[d]), buf[start[x] : end[y]].tobytes(), grams.view(np.int64))):
                        o.append(v)
                    serial += 1
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.binary()).cast(pa.string()), pa.array(out[5], pa.list_(pa.int64()))],
                    ["passage", "row", "doc_id", "start", "passage_text", "grams"],
                )
            row0 += batch.num_rows

    return docs.select("doc_id", F.lower("text").alias("low")).mapInArrow(tidy(run), "passage long, row long, doc_id long, start long, passage_text string, grams array<long>")


def candidates(found: DataFrame, own: DataFrame) -> DataFrame:
    """(passage, item): the pairs that share enough seeds."""
    hits = found.select("passage", F.explode("grams").alias("gram"))
    shared = hits.join(own.select("item", "gram", "need"), "gram").groupBy("passage", "item").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return shared.where("n >= need").select("passage", "item")


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Smith-Waterman over word numbers: score, matched words, and the aligned words' first
    and end in the text and in the item. Rows of the matrix are computed as arrays: a gap
    along the row is a running maximum."""
    m, n = len(item), len(text)
    h = np.zeros((m + 1, n + 1), np.int32)
    slope = np.arange(n + 1, dtype=np.int32) * -GAP
    for i in range(1, m + 1):
        row = np.maximum(h[i - 1] + GAP, 0)
        np.maximum(row[1:], h[i - 1, :-1] + np.where(text == item[i - 1], MATCH, MISMATCH), out=row[1:])
        h[i] = np.maximum.accumulate(row + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, i1, j1, matched = int(h[i, j]), int(i), int(j), 0
    while i > 0 and j > 0 and h[i, j] > 0:
        same = text[j - 1] == item[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, int(j), j1, int(i), i1


def split_words(text: str) -> list[bytes]:
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end = word_edges(buf, np.array([0, len(buf)]))
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


def _score(batches):
    names = ["row", "item", "doc_id", "item_id", "score", "n_matched", "start", "end", "item_start", "item_end"]
    for batch in batches:
        rows = []
        known: dict[str, list[bytes]] = {}
        read: dict[str, list[bytes]] = {}
        for *key, begin, text, want in zip(*(batch.column(k).to_pylist() for k in (*names[:4], "start", "passage_text", "item_text"))):
            a = known.get(want) or known.setdefault(want, split_words(want))
            number: dict[bytes, int] = {}
            x = np.array([number.setdefault(w, len(number)) for w in a], np.int32)
            there = read.get(text) or read.setdefault(text, split_words(text))
            y = np.array([number.get(w, -1) for w in there], np.int32)
            common = np.minimum(np.bincount(x), np.bincount(y[y >= 0], minlength=len(number))).sum()
            least = MIN_SCORE if len(a) >= MIN_WORDS else 1
            if common < least * len(a):  # an alignment matches no more words than this
                continue
            score, matched, s, e, s1, e1 = align(x, y)
            score /= MATCH * len(a)
            if score >= least:
                rows.append((*key, score, matched, begin + s, begin + e, s1, e1))
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == "score" else pa.int64()) for k, c in zip(names, cols)], names)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score 0 to 1, n_matched, start, end, item_start, item_end): the best
    alignment of every document and test item that reaches MIN_SCORE. Places in words."""
    items = stored(_items(benchmark), "items")
    own = stored(seeds(grams(items)), "seeds")
    longest, need = own.agg(F.max("n_words"), F.min("need")).first()
    spark = docs.sparkSession
    out = "doc_id long, item_id long, score double, n_matched long, start long, end long, item_start long, item_end long"
    if longest is None:
        return spark.createDataFrame([], out)
    found = stored(passages(docs, bitmap(own), longest, need), "passages")
    ready = candidates(found, own).join(found.drop("grams"), "passage").join(items, "item").select("row", "item", "doc_id", F.col("item_id").cast("long").alias("item_id"), "start", "passage_text", "item_text")
    best = F.max_by(F.struct("doc_id", "item_id", "score", "n_matched", "start", "end", "item_start", "item_end"), F.struct("score", -F.col("start"))).alias("b")
    return ready.mapInArrow(tidy(_score), f"row long, item long, {out}").groupBy("row", "item").agg(best).select("b.*")
