"""Exact duplicates by a tree-merge of sorted digest runs.

Every task turns its documents into one sorted run: an entry a distinct text, with the
text's SHA-256, its length, the smallest identifier and the number of rows. Runs then move
in binomial rounds over nodes numbered in base ``2**BITS``. In round k the nodes that agree
in all digits but the k-th exchange: each cuts its run by the k-th digit of the digests and
sends every piece to the node with that digit, which merges the runs it gets. Equal texts
meet at the latest in the last round and are one entry from there on, so a text that fills a
third of all rows is never more than ``2**BITS`` entries at a node. A round is one shuffle; the
number of nodes follows the number of leaf tasks and the bytes of all entries, so a node holds
about ``NODE_BYTES`` however large the input is.

A merge verifies what it joins: entries are one text only if all 256 bits of the digest and
the length in bytes agree (the sort compares the first 64 bits, ties are settled by the
rest). The answers return to the rows by (block, digest): a block is a task of the first job
and holds a bounded number of rows, so the way back has no hot key either.

Defined results: a null text is empty; empty texts equal each other and are no special case.
Rows with a null doc_id take part; null counts as larger than any id, and a group of null ids
only has a null keep_id. Of repeated rows (one id, equal texts) one stays, the first by place
in the input. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import release, tidy, tidy_group
from .common import SEPARATORS, stored

#: Runs merged at once are 2**BITS; bytes of entries at a node, on average; entries in a blob.
BITS, NODE_BYTES, BLOB = 3, 32 << 20, 1 << 17
#: Entries a leaf task holds before it sends them on.
HELD = 1 << 19

ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("d", "<u8"), ("size", "<i8"), ("none", "<i1"), ("id", "<i8"), ("row", "<i8"), ("count", "<i8")])
#: What makes two entries one text, and the order of the rows of one text.
SAME, RANK = ("a", "b", "c", "d", "size"), ("none", "id", "row")


def merged(runs: np.ndarray) -> np.ndarray:
    """Sorted runs, one after the other, as one sorted run with one entry a text. The stable
    sort finds the runs and merges them."""
    x = runs[np.argsort(runs["a"], kind="stable")]
    tie = x["a"][1:] == x["a"][:-1]
    if not tie.any():
        return x
    near = np.zeros(len(x), bool)
    near[1:] |= tie
    near[:-1] |= tie
    y = x[near]
    y = y[np.lexsort([y[f] for f in (*SAME, *RANK)][::-1])]
    first = np.ones(len(y), bool)
    first[1:] = np.logical_or.reduce([y[f][1:] != y[f][:-1] for f in SAME])
    at = np.flatnonzero(first)
    count = np.add.reduceat(y["count"], at)
    y = y[at]
    y["count"] = count
    out = np.concatenate([x[~near], y])
    return out[np.argsort(out["a"], kind="stable")]


def dealt(run: np.ndarray, node: int, level: int, bits: int, most: int = BLOB) -> pa.RecordBatch:
    """A sorted run cut by a digit of its digests, each piece for the node with that digit."""
    base = 1 << bits
    digit = (run["a"] >> np.uint64(64 - bits * (level + 1))) & np.uint64(base - 1)
    edge = np.searchsorted(digit, np.arange(base + 1, dtype=np.uint64))
    low = node % base**level
    high = node // base ** (level + 1)
    to, blob = [], []
    for v in range(base):
        for k in range(edge[v], edge[v + 1], most):
            to.append((high * base + v) * base**level + low)
            blob.append(run[k : min(k + most, edge[v + 1])].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blob, pa.binary())], ["node", "run"])


def entries(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, ENTRY)
    sha = b"".join(batch.column("sha").to_pylist())
    for name, part in zip("abcd", np.frombuffer(sha, ">u8").reshape(-1, 4).T):
        out[name] = part
    ids = batch.column("doc_id")
    out["none"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out["size"], out["row"] = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("size", "_row"))
    out["count"] = 1
    return out


def joined(group: pa.Table) -> np.ndarray:
    return merged(np.concatenate([np.frombuffer(x, ENTRY) for x in group.column("run").to_pylist()]))


def tree_merge(digests: DataFrame, bits: int = BITS, node_bytes: int = NODE_BYTES, blob: int = BLOB, most: int = HELD) -> DataFrame:
    """One row a distinct text: sha, size, keep_id, keep_row, group_size. ``digests`` has
    (_row, doc_id, sha, size) and is read from a written table."""
    leaves = max(1, digests.rdd.getNumPartitions(), math.ceil(digests.count() * ENTRY.itemsize / node_bytes))
    rounds = max(1, math.ceil(math.log(leaves, 1 << bits) - 1e-9))
    nodes = 1 << bits * rounds

    def leaf(batches):
        node, held = TaskContext.get().partitionId() % nodes, [np.zeros(0, ENTRY)]
        for batch in batches:
            held.append(entries(batch))
            if sum(map(len, held)) >= most:
                held = [merged(np.concatenate(held))]
                if len(held[0]) >= most:
                    yield dealt(held.pop(), node, 0, bits, blob)
                    held = [np.zeros(0, ENTRY)]
        yield dealt(merged(np.concatenate(held)), node, 0, bits, blob)

    def between(level):
        def run(key, group):
            try:
                return pa.Table.from_batches([dealt(joined(group), key[0].as_py(), level, bits, blob)])
            finally:
                release()

        return run

    def last(group):
        x = joined(group)
        sha = np.stack([x[f] for f in "abcd"], axis=1).astype(">u8").tobytes()
        return pa.table({
            "sha": pa.array([sha[i : i + 32] for i in range(0, len(sha), 32)], pa.binary()), "size": x["size"],
            "keep_id": pa.array(x["id"], mask=x["none"].astype(bool)), "keep_row": x["row"], "group_size": x["count"],
        })

    now = digests.mapInArrow(tidy(leaf), "node long, run binary")
    for level in range(1, rounds):
        now = now.groupBy("node").applyInArrow(between(level), "node long, run binary")
    return now.groupBy("node").applyInArrow(tidy_group(last), "sha binary, size long, keep_id long, keep_row long, group_size long")


def _judged(rows: DataFrame) -> DataFrame:
    """(_row, doc_id, sha, keep_id, group_size, kept) of rows (_row, doc_id, text)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SEPARATORS + "+", " ")
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    digests = stored(rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"), F.octet_length(text).cast("long").alias("size")), "digests")
    block = F.shiftright("_row", 33).alias("block")  # the task of the first job
    groups = tree_merge(digests)
    back = digests.select(block, "sha", "size").distinct().join(groups, ["sha", "size"])
    out = digests.select("*", block).join(back, ["block", "sha", "size"])
    return out.select("_row", "doc_id", "sha", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"))


def exact_report(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: doc_id, keep_id (the smallest id of the rows with an equal
    text), group_size, kept and the SHA-256 of the normalised text."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return _judged(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one a distinct text, with all their columns."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("row")), "rows")
    kept = _judged(rows.select("_row", "row.doc_id", "row.text")).where("kept").select("_row")
    return rows.join(kept, "_row").select("row.*")


#: DuckDB SQL for ``exact_report`` over ``documents``.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
