"""Minimiser shards: consecutive windows that share a minimiser travel as one packed string
to the bucket of that minimiser, so equal windows of any two documents always meet.

A run is (owner, place, number of windows, string). Equal strings of one task are collapsed
before the shuffle. A minimiser that holds more than a bucket's share (found on a sample;
that steers routing only) sends its windows on by a finer key instead, so no bucket grows
with the number of copies of one passage. Owners are (doc id, 64-bit hash of text), where
the hash is 0 for ids that stand in one row only, so it costs bytes only where the id does
not decide. A null id counts as the largest, repeated rows share an owner and get one result
each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import U64, Spans, column, equal_spans, expand, eights, mix, pieces, tidy, tidy_group, tidy_groups
from .common import MAX_ID, partitions

#: Bytes of text hashed at once, of packed strings held before they are sent, of strings in a bucket.
PIECE, HELD, BUCKET = 1 << 20, 32 << 20, 6 << 20
#: Bits of the bitmap of ids that stand in several rows: 2 MB. A full one costs bytes only.
ID_BITS = 24
#: Level of zstd for all that is shuffled.
LEVEL = 6
#: One owner in so many is looked at for heavy minimisers; there are at most HEAVY_KEYS of them.
SAMPLE_EVERY, HEAVY_KEYS = 50, 1_000_000
#: What travels with a run's string. Half of a route is enough to tell minimisers of a bucket
#: apart: two that look alike only share work.
FIELDS = (("did", "<i8"), ("rk", "<i8"), ("route", "<u4"), ("place", "<i4"), ("windows", "<i2"), ("size", "<i4"), ("weight", "<i1"))


@dataclass
class Runs:
    """Parallel arrays of runs whose strings are spans of ``buf``."""

    buf: np.ndarray
    did: np.ndarray
    rk: np.ndarray
    route: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def collapsed(self, spans: Spans, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each run, and whether it is decided here: its string is equal to that of
        another run of this piece that speaks for it. ``ordered``: only one of a smaller did
        does; else any does, and its weight says that there are two or more."""
        n = len(self.start)
        weight, done = np.ones(n, np.int64), np.zeros(n, bool)
        if n < 2:
            return weight, done
        h = spans.hash(self.start, self.end)
        order = np.lexsort((self.place, self.did, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        first = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        size = self.end - self.start
        test = np.flatnonzero(~new)
        a, b = order[test], first[test]
        same = (size[a] == size[b]) & equal_spans(eights(self.buf), self.start[a], self.start[b], np.minimum(size[a], size[b]))
        if ordered:
            same &= self.did[a] > self.did[b]
        done[a[same]] = True
        weight[b[same]] = 2
        return weight, done


@dataclass(frozen=True)
class Cut:
    """How texts become runs. ``runs(bytes, offsets, did, rk, base, heavy)`` cuts a piece;
    ``split(bytes)`` cuts one text that is longer than a piece into overlapping parts, each
    with its place, so that every window lies whole in one part."""

    runs: Callable[..., tuple[Runs, Spans]]
    split: Callable[[bytes], Iterator[tuple[bytes, int]]]


def owners(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns _did and _rk, which is kept for shared ids only."""
    return docs.withColumn("_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID))).withColumn("_rk", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def _slot(did: np.ndarray) -> np.ndarray:
    return mix(did.astype(np.int64).view(U64)) >> U64(64 - ID_BITS)


def shared_ids(own: DataFrame) -> np.ndarray:
    """A bitmap with the hashes of all ids that stand in two rows or more, built by the
    executors in parts of 4 KB. Other ids may hit it too: they keep their hash as well."""

    def slots(batches):
        for batch in batches:
            slot = np.unique(_slot(batch.column("_did").to_numpy())).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 15), pa.array(slot & 32767)], ["part", "bit"])

    twice = own.groupBy("_did").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("_did")
    parts = twice.mapInArrow(tidy(slots), "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (ID_BITS - 3), np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def owner_keys(batch: pa.RecordBatch, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and hash of each row's owner; the hash is 0 where the id stands in one row only."""
    did, rk = (batch.column(c).to_numpy() for c in ("_did", "_rk"))
    slot = _slot(did)
    kept = (shared[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1
    return did, np.where(kept == 1, rk, 0)


def owner_bucket(did: np.ndarray, rk: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in which rows and marks of an owner meet."""
    return (mix(mix(did.astype(np.int64).view(U64)) + rk.astype(np.int64).view(U64)) % U64(buckets)).astype(np.int32)


def _pieces(batches: Iterator[pa.RecordBatch], cut: Cut, heavy: np.ndarray, shared: np.ndarray) -> Iterator[tuple[Runs, Spans]]:
    for batch in batches:
        data, at = column(batch.column("text"))
        did, rk = owner_keys(batch, shared)
        for i, j in pieces(at, PIECE):
            if at[j] - at[i] <= PIECE:
                yield cut.runs(data[at[i] : at[j]], at[i : j + 1] - at[i], did[i:j], rk[i:j], np.zeros(j - i, np.int64), heavy)
                continue
            for part, place in cut.split(data[at[i] : at[j]].tobytes()):
                yield cut.runs(np.frombuffer(part, np.uint8), np.array([0, len(part)]), did[i:j], rk[i:j], np.array([place]), heavy)


def heavy_minimisers(own: DataFrame, cut: Cut, total: int) -> np.ndarray:
    """Minimisers whose strings hold over half a bucket, estimated on one owner in
    SAMPLE_EVERY; at most HEAVY_KEYS by the threshold's second term."""
    limit = max(BUCKET // 2, total // HEAVY_KEYS)

    def weigh(batches):
        for runs, _ in _pieces(batches, cut, np.zeros(0, U64), np.zeros(1 << (ID_BITS - 3), np.uint8)):
            key, place = np.unique(runs.route, return_inverse=True)
            size = np.bincount(place, runs.end - runs.start, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(size)], ["route", "size"])

    some = own.where(F.pmod(F.hash("_did", "_rk"), F.lit(SAMPLE_EVERY)) == 0)
    found = some.mapInArrow(tidy(weigh), "route long, size long").groupBy("route").agg(F.sum("size").alias("size")).where(F.col("size") > limit // SAMPLE_EVERY)
    return np.sort(np.array([r["route"] for r in found.collect()], np.int64).view(U64))


def is_heavy(route: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(route), bool)
    return heavy[np.minimum(np.searchsorted(heavy, route), len(heavy) - 1)] == route


def pack(fields: dict[str, np.ndarray], data: bytes) -> bytes:
    head = np.array([len(fields["did"])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(fields[k].astype(t).tobytes() for k, t in FIELDS) + data)


def unpack(blobs) -> tuple[dict[str, np.ndarray], np.ndarray]:
    parts, texts = {k: [] for k, _ in FIELDS}, []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
        for k, t in FIELDS:
            parts[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
        texts.append(np.frombuffer(raw, np.uint8, len(raw) - at, at))
    return {k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}, np.concatenate(texts)


def sent(cut: Cut, heavy: np.ndarray, shared, buckets: int, ordered: bool):
    """The map side: packed runs by bucket. A decided run is sent without its string."""

    def flush(held: dict) -> pa.RecordBatch:
        keys = sorted(held)
        blobs = [pack({k: np.concatenate([x[0][k] for x in held[b]]) for k, _ in FIELDS}, b"".join(x[1] for x in held[b])) for b in keys]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches):
        held, size = {}, 0
        for r, spans in _pieces(batches, cut, heavy, shared.value):
            if not len(r.start):
                continue
            weight, done = r.collapsed(spans, ordered)
            length = np.where(done, 0, r.end - r.start)
            bucket = (r.route % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            fields = {"did": r.did, "rk": r.rk, "route": r.route >> U64(32), "place": r.place, "windows": r.windows, "size": length, "weight": weight}
            fields = {k: v[order] for k, v in fields.items()}
            data, start, end = r.buf.tobytes(), r.start[order], r.start[order] + length[order]
            edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                text = b"".join([data[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist()) if e > s])
                held.setdefault(int(bucket[order[a]]), []).append(({k: v[a:b] for k, v in fields.items()}, text))
            size += int(length.sum()) + 56 * len(length)
            if size > HELD:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    return run


def marks(own: DataFrame, total: int, cut: Cut, judge, ordered: bool, shared, meet: int) -> DataFrame:
    """(_did, _rk, place, n, bucket of ``meet``): stretches of n marked windows of an owner. ``judge(fields,
    text, start)`` gets a bucket's undecided runs and returns the index of each marked
    stretch's run, its offset in windows and its length."""
    heavy = heavy_minimisers(own, cut, total)
    buckets = max(partitions(own.sparkSession), 4 * total // BUCKET)  # strings overlap: they hold 3 to 4 times the text

    def in_bucket(group: pa.Table) -> pa.Table:
        f, text = unpack(group.column("blob").to_pylist())
        start = np.cumsum(f["size"]) - f["size"]
        live = f["size"] > 0
        i, offset, n = judge({k: v[live] for k, v in f.items()}, text, start[live])
        i, done = np.flatnonzero(live)[i], np.flatnonzero(~live)
        which, place, n = np.concatenate([i, done]), np.concatenate([f["place"][i] + offset, f["place"][done]]), np.concatenate([n, f["windows"][done]])
        did, rk = f["did"][which], f["rk"][which]
        return pa.table({"_did": did, "_rk": rk, "place": place, "n": n.astype(np.int64), "bucket": owner_bucket(did, rk, meet)})

    return own.mapInArrow(tidy(sent(cut, heavy, shared, buckets, ordered)), "bucket int, blob binary").groupBy("bucket").applyInArrow(tidy_group(in_bucket), "_did long, _rk long, place long, n long, bucket int")


def _packed_rows(buckets: int, shared):
    """mapInArrow: whole rows, compressed, by the bucket of their owner."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        bucket = rows.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
        rows, blobs = rows.drop_columns("bucket"), []
        for a, b in zip(edge[:-1], edge[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                out.write_table(rows.take(order[a:b]).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[order[edge[:-1]]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                did, rk = owner_keys(batch, shared.value)
                batch = batch.set_column(batch.schema.get_field_index("_rk"), "_rk", pa.array(rk, pa.int64()))
                batch = batch.append_column("bucket", pa.array(owner_bucket(did, rk, buckets)))
                held.append(batch)
                size += batch.nbytes
            if size > HELD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def without_marked(docs: DataFrame, cut: Cut, judge, ordered: bool, remove, schema: str) -> DataFrame:
    """Each row of ``docs`` with its owner's marks, through ``remove(rows, marks)``, where
    ``marks`` has for each row None or the arrays of places and numbers. It returns the
    other columns of the row as ``row`` and adds those of ``schema``. Rows and marks meet by
    a hash of the owner, rows packed on the way."""
    row = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")
    own = owners(docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id"))).select("row", "text", "_did", "_rk")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(shared_ids(own))
    buckets = max(partitions(docs.sparkSession), total // BUCKET)
    found = marks(own.select("_did", "_rk", "text"), total, cut, judge, ordered, shared, buckets)
    rows = own.mapInArrow(tidy(_packed_rows(buckets, shared)), "bucket int, blob binary")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        did, rk, place, n = (right.column(c).to_numpy() for c in ("_did", "_rk", "place", "n"))
        order = np.lexsort((place, rk, did))
        did, rk, place, n = did[order], rk[order], place[order], n[order]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(did) != 0) | (np.diff(rk) != 0), [True]])) if len(did) else np.zeros(1, np.int64)
        of = {(int(did[a]), int(rk[a])): (place[a:b], n[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())}
        out = []
        for blob in left.column("blob").to_pylist():
            for batch in pa.ipc.open_stream(blob):
                keys = zip(batch.column("_did").to_pylist(), batch.column("_rk").to_pylist())
                out.append(remove(batch, [of.get(k) for k in keys]))
        return pa.Table.from_batches(out) if out else whole_arrow.empty_table()

    whole = T.StructType([own.schema["row"], *T.StructType.fromDDL(schema).fields])
    whole_arrow = to_arrow_schema(whole)
    return rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(tidy_groups(joined), whole)


def distinct_strings(f: dict[str, np.ndarray], text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each run's distinct string, the first run of each string, and each string's
    weight over all its runs. Equal means equal bytes, not equal hashes."""
    n = len(start)
    h = Spans(text).hash(start, start + f["size"])
    order = np.lexsort((h, f["route"]))
    e = eights(text)
    new = np.ones(n, bool)
    a, b = order[1:], order[:-1]
    near = np.flatnonzero((h[a] == h[b]) & (f["route"][a] == f["route"][b]) & (f["size"][a] == f["size"][b]))
    new[1 + near[equal_spans(e, start[a[near]], start[b[near]], f["size"][a[near]])]] = False
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new], np.bincount(number, f["weight"], int(new.sum())).astype(np.int64)


def of_runs(number: np.ndarray, stretch_of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For stretches sorted by string: pairs (run, stretch) for every run of the string."""
    per = np.bincount(stretch_of, minlength=count)
    first = np.cumsum(per) - per
    return np.repeat(np.arange(len(number)), per[number]), expand(first[number], per[number])
