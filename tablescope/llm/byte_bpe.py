"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split into pre-tokens block by block (a block is a bounded number of bytes of
whole texts). A block keeps its pre-tokens, in place, as numbers of its own word list; the
words of the list go, packed, to buckets by hash, where each distinct word is encoded once.
The ids come back by block and number and are put together in place. Decoding joins the
ids with the token-byte table, which is bounded by the vocabulary and sent to every task.

Defined results: null text counts as empty and has no ids; repeated rows each give a row;
the bytes of the ids are always those of the text.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import column, expand, pieces, tidy, tidy_group
from .common import partitions, stored

#: Characters of text of a block; one longer text is a block of its own.
BLOCK = 32 << 20
#: Pre-tokens put together at once.
SLICE = 1 << 20
LEVEL = 6
#: Beyond so many bytes a word is merged with a heap, which stays near-linear.
SHORT = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token in base 64 and its rank on every line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    rank = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        found = [r for r in rank if r is not None]
        if not found:
            return [ranks[p] for p in parts]
        i = rank.index(min(found))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i])
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, lowest rank first and leftmost of ties, by a heap over linked parts."""
    n = len(word)
    end = list(range(1, n + 1))  # a part is word[i:end[i]]; 0: merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return (_merge_short if len(word) <= SHORT else _merge_long)(word, ranks)


def _packed(*arrays: np.ndarray, data: bytes = b"") -> bytes:
    """Arrays and bytes, compressed; the arrays byte plane by byte plane, which packs well."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<i8").tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(planes) + data)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 16 * k, []
    for n, width in np.frombuffer(raw, "<i8", 2 * k, 8).reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<i{width}").ravel() if n else np.zeros(0, f"<i{width}"))
        at += n * width
    return out, raw[at:]


#: Numbers below FEW take one byte, others one byte and two more.
FEW, MANY = 224, 224 + (32 << 16)


def _short(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers in fewer bytes: (first bytes, the other two where there are any); beyond
    MANY plain 4-byte numbers and an empty second array."""
    if len(numbers) and numbers.max() >= MANY:
        return numbers.astype("<i4"), np.zeros(0, "<i2")
    more = numbers - FEW
    return np.where(more < 0, numbers, FEW + (more >> 16)).astype("i1"), (more[more >= 0] & 0xFFFF).astype("<u2").view("<i2")


def _long(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    if first.itemsize == 4:
        return first.astype(np.int32)
    out = first.view(np.uint8).astype(np.int32)
    big = out >= FEW
    out[big] = FEW + ((out[big] - FEW) << 16) + rest.view("<u2")
    return out


def _blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Rows (block, bucket, blob): bucket -1 holds a block's ids, offsets and word numbers in
    place, the others the words of its list that belong to a bucket. The words of bucket b,
    most frequent first, have the numbers b, b + buckets, b + 2 buckets, ..., so neither they
    nor their ids need to carry a number, and frequent words have small ones."""

    def run(batches):
        import regex
        from pyspark import TaskContext

        split = regex.compile(pattern).findall
        task, serial = TaskContext.get().partitionId(), 0
        held = {"size": 0}

        def begin():
            held.update(size=0, words={}, ids=[], null=[], at=[], numbers=[], n=0)

        def flush():
            nonlocal serial
            block = task << 32 | serial
            serial += 1
            words = held["words"]
            numbers = np.concatenate([*held["numbers"], np.zeros(0, np.int32)])
            listed = [w.encode() for w in words]
            bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in listed], np.int64)
            by = np.lexsort((-np.bincount(numbers, minlength=len(words)), bucket))
            edge = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1)) if len(by) else np.zeros(1, np.int64)
            place = np.empty(len(words), np.int64)
            rows = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                some = [listed[i] for i in by[a:b].tolist()]
                own = int(bucket[by[a]])
                place[by[a:b]] = own + buckets * np.arange(b - a)
                rows.append((own, _packed(np.array([len(w) for w in some], "<i4"), data=b"".join(some))))
            rows.append((-1, _packed(np.array(held["ids"], "<i8"), np.array(held["null"], "i1"), np.array(held["at"], "<i4"), *_short(place[numbers]))))
            begin()
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "blob"])

        begin()
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text")
            for i, doc in enumerate(ids):
                text = texts[i].as_py() or ""
                if held["ids"] and held["size"] + len(text) > BLOCK:
                    yield flush()
                number = held["words"].setdefault
                words = held["words"]
                got = np.array([number(w, len(words)) for w in split(text)], np.int32)
                held["ids"].append(doc or 0)
                held["null"].append(doc is None)
                held["at"].append(len(got))
                held["numbers"].append(got)
                held["size"] += len(text)
        if held["ids"]:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "block long, bucket int, blob binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens and ``ids``, little-endian unsigned 32-bit."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    buckets = buckets or partitions(spark)
    rows = stored(_blocks(docs, pattern, buckets), "bpe")

    def of_bucket(group: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        out, ranks = [], table.value
        for blob in group.column("blob").to_pylist():
            (size,), data = _unpacked(blob)
            count, ids, at = [], [], 0
            for n in size.tolist():
                word = data[at : at + n]
                at += n
                got = known.get(word)
                if got is None:
                    got = known[word] = encode_word(word, ranks)
                count.append(len(got))
                ids += got
            out.append(_packed(np.array(count, "<i4"), np.array(ids, "<i4")))
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "blob": pa.array(out, pa.binary())})

    found = rows.where("bucket >= 0").groupBy("bucket").applyInArrow(tidy_group(of_bucket), "block long, bucket int, blob binary")

    def of_block(group: pa.Table) -> pa.Table:
        parts = {b: _unpacked(blob)[0] for b, blob in zip(group.column("bucket").to_pylist(), group.column("blob").to_pylist())}
        doc, null, tokens, *short = parts.pop(-1)
        slots = max((b + buckets * len(count) for b, (count, _) in parts.items()), default=0)
        first, per, base = np.zeros(slots, np.int64), np.zeros(slots, np.int32), 0
        for b, (count, ids) in parts.items():
            at = slice(b, b + buckets * (len(count) - 1) + 1, buckets)
            first[at], per[at] = base + np.cumsum(count) - count, count
            base += len(ids)
        ids = np.concatenate([*(i for _, i in parts.values()), np.zeros(0, "<i4")])
        words, flat, length = _long(*short), [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for a in range(0, len(words), SLICE):
            w = words[a : a + SLICE]
            length.append(per[w])
            flat.append(ids[expand(first[w], per[w].astype(np.int64))].astype("<u4"))
        edge = np.concatenate([[0], np.cumsum(np.concatenate(length), dtype=np.int64)])[np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])]
        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * edge), pa.py_buffer(np.concatenate(flat))])
        return pa.table({"doc_id": pa.array(doc, mask=null.astype(bool)), "n_tokens": pa.array(np.diff(edge)), "ids": blob.cast(pa.binary())})

    return rows.where("bucket < 0").unionByName(found).groupBy("block").applyInArrow(tidy_group(of_block), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids, joined with the token-byte table."""
    size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    tokens = sorted((rank, token) for token, rank in ranks.items())
    size[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
    table = encoded.sparkSession.sparkContext.broadcast((size, np.cumsum(size) - size, np.frombuffer(b"".join(t for _, t in tokens), np.uint8)))

    def run(batches):
        size, first, data = table.value
        for batch in batches:
            raw, at = column(batch.column("ids"))
            for i, j in pieces(at, 1 << 20):
                ids = np.frombuffer(raw[at[i] : at[j]].tobytes(), "<u4").astype(np.int64)
                n = size[ids]
                edge = np.concatenate([[0], np.cumsum(n)])[(at[i : j + 1] - at[i]) // 4]
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(edge), pa.py_buffer(data[expand(first[ids], n)])])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def bpe_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    ranks = load_ranks(path)
    done = decode(encode(docs, ranks, pattern), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encoded_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return bpe_report(docs, *public_vocabulary())
