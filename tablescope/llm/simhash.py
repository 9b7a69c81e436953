"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their four 16-bit
quarters. Two fingerprints that differ in d bits have counts that differ by d or less in
sum, so a pair of tiles whose counts differ by more than the radius is skipped; the others
are compared whole, with exclusive-or and bit counts on numpy arrays. Large cells are split
into tiles of bounded size by a hash. From a pair of tiles only a spanning forest of its
links goes on, so a group of copies never becomes all its pairs.

Defined results: null and empty texts have no words and fingerprint zero, which links like
any other; fewer words than a shingle make one shingle of all; repeated rows each give a
row; rows with a null doc_id take part, and count as the largest id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import column, tidy
from .common import MAX_ID, stored
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile, on average at most.
TILE = 2048
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16


def bit_majority(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For the hashes of each text (edge[i] to edge[i + 1]): the bits set in over half."""
    texts = len(edge) - 1
    counts = np.zeros((texts, 64), np.int64)
    for a in range(0, len(hashes), BLOCK):
        part = hashes[a : a + BLOCK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        i, j = np.searchsorted(edge, a, "right") - 1, np.searchsorted(edge, a + len(part), "left")
        at = np.maximum(edge[i:j], a) - a
        some = edge[i + 1 : j + 1] > edge[i:j]  # texts without hashes take no part
        counts[i:j][some] += np.add.reduceat(bits, at[some], axis=0, dtype=np.int64)
    return np.packbits(2 * counts > np.diff(edge)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, a hash ``th`` of its text and its 64-bit fingerprint ``fp`` as a signed long."""
    digest = xxhash.xxh64_intdigest

    def run(batches):
        for batch in batches:
            data, at = column(batch.column("text"))
            raw, at = data[at[0] : at[-1]].tobytes().lower(), (at - at[0]).tolist()  # lower() of bytes: A-Z only
            hashes, edge = [], [0]
            done: list[np.ndarray] = []

            def settle():
                done.append(bit_majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(edge)))
                hashes.clear()
                edge[:] = [0]

            for a, b in zip(at[:-1], at[1:]):
                w = raw[a:b].split()
                if len(w) >= shingle:
                    got = [digest(x, seed) for x in map(b" ".join, zip(*(w[k:] for k in range(shingle))))]
                else:
                    got = [digest(b" ".join(w), seed)] if w else []
                hashes.append(np.array(got, np.uint64))
                edge.append(edge[-1] + len(got))
                if edge[-1] > 1 << 20:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.concatenate(done).view(np.int64))], ["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text").mapInArrow(tidy(run), "doc_id long, th long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between the tiles ``a`` and ``b`` (which may be one), as edges
    to the smallest fingerprint of each connected part of the pair of tiles."""
    every = np.unique(np.concatenate([a, b]))
    x, y = [], []
    for i in range(0, len(a), 256):
        p, q = np.nonzero(np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius)
        p += i
        apart = a[p] != b[q]
        if apart.any():
            x.append(np.searchsorted(every, a[p[apart]]).astype(np.int32))
            y.append(np.searchsorted(every, b[q[apart]]).astype(np.int32))
    if not x:
        return every[:0], every[:0]
    x, y = np.concatenate(x), np.concatenate(y)
    root = np.arange(len(every))
    while True:  # smallest label over links, then over labels of labels
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, root)[root]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(every)))
    return every[child], every[root[child]]


def counts_within(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of four counts that sum to ``radius`` at most, of each pair one sign."""
    steps = range(-radius, radius + 1)
    return [d for d in itertools.product(steps, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` within ``radius``."""
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    cell = sum((quarter(k).cast("int") * 32**k for k in range(1, 4)), quarter(0).cast("int"))
    cells = fps.select("fp", cell.alias("cell"))
    # one row a cell, 17^4 at most whatever the input
    parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    tiles = (
        cells.join(F.broadcast(parts), "cell")
        .select("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp")
        .groupBy("cell", "part").agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stored(tiles, "tiles")
    near = [sum(d * 32**k for k, d in enumerate(reversed(diff))) for diff in counts_within(radius)]
    left = tiles.select("cell", F.col("part").alias("p"), F.col("fps").alias("x"), F.explode(F.array(*map(F.lit, near))).alias("step"))
    left = left.select("p", "x", "cell", (F.col("cell") + F.col("step")).alias("to"))
    right = tiles.select(F.col("cell").alias("to"), F.col("part").alias("q"), F.col("fps").alias("y"))
    pairs = left.join(right, "to").where((F.col("cell") != F.col("to")) | (F.col("p") <= F.col("q"))).select("x", "y")

    def compare(batches):
        for batch in batches:
            out = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            x, y = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                found = forest(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64), radius)
                out[0].append(found[0])
                out[1].append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).view(np.int64)) for o in out], ["a", "b"])

    return pairs.mapInArrow(tidy(compare), "a long, b long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _classes(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows; the component of each distinct fingerprint; and of each
    component the smallest (doc id, text hash), which stands for it."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(MAX_ID)).alias("did"), "th")).alias("least"))
    group = components(links(least.select("fp"), radius)).select(F.col("id").alias("fp"), F.col("component"))
    named = stored(least.join(group, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "classes")
    return marked, named, named.groupBy("component").agg(F.min("least").alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint ``fp`` and ``component_id``: the smallest doc_id linked to it by
    fingerprints at most ``radius`` bits apart, itself included."""
    marked, named, first = _classes(docs, shingle, radius)
    of_print = named.join(first, "component").select("fp", F.col("first.did").alias("component_id"))
    return marked.join(of_print, "fp").select("doc_id", "fp", F.when(F.col("component_id") != MAX_ID, F.col("component_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (of rows that
    share it, the one with the smallest text hash; of equal rows any)."""
    _, _, first = _classes(docs, shingle, radius)
    keys = {"_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)), "_th": text_hash()}
    chosen = first.select(F.col("first.did").alias("_did"), F.col("first.th").alias("_th"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    return docs.select(*[v.alias(k) for k, v in keys.items()], row).join(chosen, ["_did", "_th"], "left_semi").dropDuplicates(["_did", "_th"]).select("_row.*")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
