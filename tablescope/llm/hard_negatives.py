"""Hard-negative mining by Fagin's threshold algorithm.

Rows are dealt to blocks of ``BLOCK`` candidates by a hash of their place, anchors to groups
of ``GROUP``; every (block, group) pair is one task's work on bounded data, so anchors are a
query set against all rows, in blocks. A block keeps one list of its candidates a dimension,
sorted by the component. For an anchor the lists are read from the top where its component
is positive and from the bottom where it is negative (sorted access), in steps that double;
rows met for the first time are scored whole with integers (random access). What has not been
met scores at most the threshold: the sum of the anchor's components times those at the depth
reached. A window is done once the threshold is strictly below its k-th best score in the
block, or, while it has fewer rows, strictly below the least score it admits.

Two passes: the first finds each anchor's positives (its k best rows of the same label), the
second has one window for each of them, [least share of the positive's score, that score],
open to rows of other labels. The best k of all blocks are the best k of the blocks' best.

Defined results: rows with a null label, a null vector, or a null or non-finite component
(also once scaled) take no part. Vectors of fewer components than the longest count as
zeros there. Rows with a null vec_id are candidates, as the largest id, never anchors; of
repeated rows each takes part, and each repeated anchor gives its own results. Ties go to the
smaller vec_id, then to the earlier row. Scores beyond 64 bits are exact inside a block, have
at most 38 digits between blocks and are returned as the nearest long. An empty table, an anchor without positives and a
window without rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import tidy_groups
from .common import stored

#: Components scale to whole numbers by SCALE; candidates in a block, anchors in a group.
SCALE, BLOCK, GROUP = 256, 8192, 512
#: Bytes of vectors in a block at most.
BLOCK_BYTES = 16 << 20
#: Positives of an anchor, negatives of a window, least score of a negative in per cent of the positive's.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Depth of the first step of sorted access.
DEPTH = 32
MAX_LONG = (1 << 63) - 1


@dataclass
class Block:
    """Candidates: whole-number components as doubles (rows by dimensions), their labels,
    and their order by (id, row) for ties."""

    x: np.ndarray
    label: np.ndarray
    ids: list
    row: np.ndarray

    def __post_init__(self):
        n = len(self.x)
        order = np.argsort(self.x, axis=0, kind="stable")
        self.lists = np.ascontiguousarray(order.T)  # by dimension, smallest first
        self.values = np.ascontiguousarray(np.take_along_axis(self.x, order, 0).T)
        key = [MAX_LONG if i is None else i for i in self.ids]
        null = [i is None for i in self.ids]
        self.place = np.empty(n, np.int64)
        self.place[np.lexsort([self.row, key, null])] = np.arange(n)
        self.most = float(np.abs(self.x).max()) if self.x.size else 0.0


def kind_of(most: float, dims: int):
    """The narrowest kind of number in which scores are exact."""
    bound = float(most) ** 2 * max(dims, 1) * 100
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def whole(x: np.ndarray, kind):
    """Whole numbers held as doubles, as another kind of number."""
    return x if kind is np.float64 else x.astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)


class Top:
    """The k best rows of a window so far."""

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high = k, low, high
        self.score, self.at = None, None

    def add(self, score: np.ndarray, at: np.ndarray, place: np.ndarray) -> None:
        if self.low is not None:
            inside = (100 * score >= self.low) & (score <= self.high)
            score, at = score[inside], at[inside]
        if self.score is not None:
            score, at = np.concatenate([self.score, score]), np.concatenate([self.at, at])
        if len(score) > self.k:
            if score.dtype != object:
                worst = np.partition(score, len(score) - self.k)[len(score) - self.k]
                near = score >= worst
                score, at = score[near], at[near]
            best = sorted(range(len(score)), key=lambda i: (-score[i], place[at[i]]))[: self.k]
            score, at = score[best], at[best]
        self.score, self.at = score, at

    def done(self, threshold) -> bool:
        """Whether no row that has not been met can enter."""
        if self.score is not None and len(self.score) >= self.k:
            return threshold < min(self.score)
        return self.low is not None and 100 * threshold < self.low


def search(block: Block, exact: np.ndarray, anchor: np.ndarray, mine, windows: list[Top], depth: int = DEPTH) -> None:
    """Fill ``windows`` with the best rows of the block for which ``mine`` holds. ``exact``
    is the block in the kind of number of the anchor."""
    n = len(block.x)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    met = np.zeros(n, bool)
    at, step = 0, depth
    while at < n:
        to = min(n, at + step)
        flag = np.zeros(n, bool)
        flag[block.lists[up, n - to : n - at].ravel()] = True
        flag[block.lists[down, at:to].ravel()] = True
        if to == n:  # with the lists at their ends all rows are met, also if the anchor is zero
            flag[:] = True
        new = np.flatnonzero(flag & ~met & mine)
        met |= flag
        if len(new):
            score = exact[new] @ anchor
            for w in windows:
                w.add(score, new, block.place)
        at_depth = np.concatenate([block.values[up, n - to], block.values[down, to - 1]])
        parts = np.concatenate([anchor[up], anchor[down]])
        threshold = (whole(at_depth[None, :], exact.dtype.type if exact.dtype != object else object)[0] * parts).sum() if len(parts) else 0
        at, step = to, 2 * step
        if all(w.done(threshold) for w in windows):
            return


def _block(group: pa.Table, dims: int) -> Block:
    x, n = group.column("x").combine_chunks(), group.num_rows
    out = np.zeros((n, dims))
    size = np.diff(x.offsets.to_numpy())
    out[np.arange(dims) < size[:, None]] = x.flatten().to_numpy()
    return Block(out, group.column("label").to_numpy(), group.column("vec_id").to_pylist(), group.column("_row").to_numpy())


def _text(score) -> str:
    """A score of any size as a whole number of at most 38 digits."""
    return str(max(1 - 10**38, min(10**38 - 1, int(score))))


FOUND = "anchor_row long, positive int, score string, vec_id long, _row long"


def _mine(pairs_left, pairs_right, dims: int, k: int, least: int, depth: int) -> DataFrame:
    """Cogroup candidates and anchors by (block, group): the best rows of every window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in ("anchor_row", "positive", "score", "vec_id", "_row")}
        if left.num_rows and right.num_rows:
            block, anchors = _block(left, dims), _block(right, dims)
            kind = kind_of(max(block.most, anchors.most), dims)
            exact, vectors = whole(block.x, kind), whole(anchors.x, kind)
            bounds = right.column("bounds").to_pylist() if "bounds" in right.column_names else None
            for i, row in enumerate(anchors.row.tolist()):
                same = block.label == anchors.label[i]
                if bounds is None:
                    windows, mine = [Top(k)], same & (block.row != row)
                else:
                    scores = [int(b) for b in bounds[i]]
                    windows, mine = [Top(k, least * s, s) for s in scores], ~same
                search(block, exact, vectors[i], mine, windows, depth)
                for p, w in enumerate(windows):
                    if w.score is not None:
                        for s, at in zip(w.score.tolist(), w.at.tolist()):
                            for name, v in zip(out, (row, p, _text(s), block.ids[at], int(block.row[at]))):
                                out[name].append(v)
        return pa.table({n: pa.array(v, {"positive": pa.int32(), "score": pa.string()}.get(n, pa.int64())) for n, v in out.items()})

    keys = ["block", "group"]
    # both sides come from one table: columns of their own, or the right ones would be lost
    pairs_right = pairs_right.select(*[F.col(c).alias(c) for c in pairs_right.columns])
    return pairs_left.groupBy(*keys).cogroup(pairs_right.groupBy(*keys)).applyInArrow(tidy_groups(run), FOUND)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each window over all blocks, with their rank from 1. Scores are whole
    numbers of any length as text; 38 digits order them."""
    score = F.col("score").cast("decimal(38,0)")
    order = [score.desc(), F.col("vec_id").asc_nulls_last(), F.col("_row")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def usable(vectors: DataFrame, relabel: Column | None = None) -> DataFrame:
    """(_row, vec_id, label, x) of the rows that take part; x has whole numbers as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    limit = F.lit(float("inf"))
    good = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < limit))
    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & good)
    # floor of a double would become a long and stop at its range
    return rows.select("_row", "vec_id", (F.col("label") if relabel is None else relabel).alias("label"), F.transform("x", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)).alias("x"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, block: int = BLOCK, group: int = GROUP, depth: int = DEPTH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vectors``
    has (vec_id, embedding, label); ``is_anchor`` is a condition on vec_id, ``relabel`` an
    expression of vec_id and label."""
    rows = stored(usable(vectors, relabel), "vectors")
    anchor = is_anchor & F.col("vec_id").isNotNull()
    n, dims, queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), F.count_if(anchor)).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(dims, 1))))
    blocks, groups = max(1, math.ceil(n / block)), max(1, math.ceil(queries / group))
    dealt = lambda many: F.pmod(F.xxhash64("_row"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    candidates = rows.select(dealt(blocks).alias("block"), every(groups).alias("group"), "_row", "vec_id", "label", "x")
    anchors = rows.where(anchor).select(every(blocks).alias("block"), dealt(groups).alias("group"), "_row", "vec_id", "label", "x")
    first = _ranked(_mine(candidates, anchors, dims, positives, least, depth), ["anchor_row"], positives)
    chosen = stored(first.select("anchor_row", F.col("rank").alias("at"), F.col("score"), F.col("vec_id").alias("positive_id")), "positives")
    per = chosen.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("at", "score"))).alias("found"))
    bounds = per.select(F.col("anchor_row").alias("_row"), F.col("found.score").alias("bounds"))
    found = _mine(candidates, anchors.join(bounds, "_row"), dims, negatives, least, depth)
    best = _ranked(found, ["anchor_row", "positive"], negatives)
    names = rows.where(anchor).select(F.col("_row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    pos = chosen.select("anchor_row", (F.col("at") - 1).alias("positive"), "positive_id", F.col("score").alias("positive_score"))
    long = lambda c: F.greatest(F.least(F.col(c).cast("decimal(38,0)"), F.lit(MAX_LONG).cast("decimal(38,0)")), F.lit(-MAX_LONG - 1).cast("decimal(38,0)")).cast("long").alias(c)
    return best.withColumnsRenamed({"score": "negative_score", "vec_id": "negative_id"}).join(pos, ["anchor_row", "positive"]).join(names, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", long("positive_score"), long("negative_score"))


def mining_report(vectors: DataFrame) -> DataFrame:
    """The fixed query: every hundredth id is an anchor; labels of every seventh id move on."""
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, relabel)


#: DuckDB SQL for ``mining_report`` over ``embeddings``.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
