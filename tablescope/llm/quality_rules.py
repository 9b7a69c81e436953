"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a predicate that rejects a document. On a small sample each rule's cost
(seconds a row) and selectivity (share rejected) are measured; rules then run in order of
rejections per cost inside one CASE, whose later branches are not evaluated once an earlier
one has rejected. The verdict does not depend on the order, only the work does.

Defined results: null text counts as empty; an empty text has no words and fails the length
rule; repeated rows are judged each for itself; other columns are kept as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize

from .common import SEPARATORS, let, removed, words

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"

#: Rows of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 2000


#: A sorted key holds a 3-word window's hash in its upper bits and its start in these lower ones.
START_BITS = 28
START_MASK = (1 << START_BITS) - 1


def window_keys(w: Column) -> Column:
    """Sorted keys of the 3-word windows of the words ``w``."""
    key = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~START_MASK)).bitwiseOR(i.cast("long"))
    return F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))).otherwise(F.array().cast("array<bigint>"))


def neighbours(windows: Column, alike: Callable[[Column, Column], Column]) -> Column:
    """Places of the sorted ``windows`` that are alike with the one before or after."""
    same = lambda k, j: F.coalesce(alike(k, j), F.lit(False))
    return F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda k: same(k, k - 1) | same(k, k + 1))


def sorted_by_words(w: Column) -> Column:
    """Starts of the windows found twice or more, from the windows sorted by their words."""
    window = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("start"))

    def starts(windows: Column) -> Column:
        at = lambda k, name: F.get(windows, k)[name]
        alike = lambda k, j: (at(k, "a") == at(j, "a")) & (at(k, "b") == at(j, "b")) & (at(k, "c") == at(j, "c"))
        return F.sort_array(F.transform(neighbours(windows, alike), lambda k: at(k, "start")))

    return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)), starts)


def repeated_starts(w: Column, keys: Column) -> Column:
    """Sorted starts of the windows found twice or more: neighbours among the keys with one
    hash, whose words are then compared. If neighbours with one hash differ in words, another
    window may stand between two equal ones, and the text's windows are sorted by words."""
    start = lambda k: F.get(keys, k).bitwiseAND(F.lit(START_MASK)).cast("int")
    word = lambda k, d: F.get(w, start(k) + d)
    near = lambda k, j: F.shiftright(F.get(keys, k), START_BITS) == F.shiftright(F.get(keys, j), START_BITS)
    alike = lambda k, j: (word(k, 0) == word(j, 0)) & (word(k, 1) == word(j, 1)) & (word(k, 2) == word(j, 2))

    clash = F.exists(F.sequence(F.lit(0), F.size(keys) - 2), lambda k: near(k, k + 1) & ~alike(k, k + 1))
    hits = neighbours(keys, lambda k, j: near(k, j) & alike(k, j))
    return F.when(F.size(keys) <= 1, F.array().cast("array<int>")).when(clash, sorted_by_words(w)).otherwise(F.sort_array(F.transform(hits, start)))


def covered(p: Column) -> Column:
    """Words that 3-word windows at the sorted starts ``p`` cover."""
    each = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, j: n + F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))))
    return F.when(F.size(p) > 0, each).otherwise(0).cast("long")


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows found twice or more, as one expression."""
    return let(let(window_keys(w), lambda keys: repeated_starts(w, keys)), covered)


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))


def metrics(text: Column) -> dict[str, Column]:
    """The measures of a text that rules use; each is an expression over the text alone."""
    t = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(words(t)).cast("long"),
        "word_chars": F.length(removed(t, SEPARATORS)).cast("long"),
        "n_symbols": (F.length(t) - F.length(removed(t, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words(t), repeated_words).cast("long"),
        "n_marks": (F.length(t) - F.length(removed(t, "!"))).cast("long"),
        "n_upper": (F.length(t) - F.length(removed(t, r"\p{Lu}"))).cast("long"),
        "n_lines": F.size(lines(t)).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds the predicate from the measures."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: The base rules of the contract.
BASE = (
    Rule("too_short", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
#: Rules of our own; 100 * part > limit * whole, all in whole numbers.
EXTRA = (
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 15 * m["n_words"]),
    Rule("shouting", lambda m: (100 * m["n_upper"] > 30 * m["word_chars"]) & (100 * m["n_marks"] > 10 * m["n_words"])),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def measure(docs: DataFrame, rules, given: Callable[[Column], dict[str, Column]] = metrics, sample_rows: int = SAMPLE_ROWS,
            fraction: float | None = None, prepared: Callable[[DataFrame], DataFrame] | None = None) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of about ``sample_rows`` rows, drawn at a
    share that follows from the row count (or at ``fraction``). Only sampled rows are shuffled,
    over as many tasks as run at once. ``given`` are the expressions the cascade evaluates over
    the frame ``prepared`` makes of the texts: the sample is written in that form, so what the
    cascade reads as a finished column is one here too. The sample steers the order of the rules
    only, never a verdict."""
    share = min(1.0, sample_rows / max(1, docs.count())) if fraction is None else fraction
    sample = docs.select("text").sample(fraction=float(share), seed=7).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    sample = materialize(prepared(sample) if prepared else sample)

    def run(hit: Column) -> tuple[float, int, int]:
        job = sample.agg(F.sum(F.when(hit, 1).otherwise(0)).alias("n"), F.count(F.lit(1)).alias("all"))
        best, row = float("inf"), None
        for _ in range(2):  # the first run also compiles
            t = time.perf_counter()
            row = job.first()
            best = min(best, time.perf_counter() - t)
        return best, row["n"] or 0, row["all"]

    idle, _, n = run(F.col("text").isNull())
    found = []
    for r in rules:
        took, hits, _ = run(r.rejects(given(F.col("text"))))
        found.append(Measured(r, max(took - idle, 0.001) / max(n, 1), hits / max(n, 1)))
    return found


def ordered(found: list[Measured]) -> list[Rule]:
    """Most rejections per second of cost first."""
    return [m.rule for m in sorted(found, key=lambda m: (-m.gain, m.seconds))]


def failed_rule(rules, measures: dict[str, Column]) -> Column:
    """Name of the first rule, in the order given, that rejects; null if none does."""
    out = None
    for r in rules:
        out = F.when(r.rejects(measures), r.name) if out is None else out.when(r.rejects(measures), r.name)
    return out


def quality_rules(docs: DataFrame, rules=(*BASE, *EXTRA), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule`` (null: kept), by the measured cascade."""
    order = ordered(measure(docs, rules, sample_rows=sample_rows))
    return docs.withColumn("failed_rule", failed_rule(order, metrics(F.col("text"))))


def quality_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id with the five base measures, ``base_failed`` and ``kept``. The measures are
    asked for in full here, so the cascade reads them as columns and only its own further
    measures are evaluated lazily."""
    have = metrics(F.col("text")) | {k: F.col(k) for k in SHOWN}
    order = ordered(measure(docs, (*BASE, *EXTRA), lambda _: have, sample_rows, prepared=lambda s: _with_shown(s, [])))
    failed = BASE[0].rejects(have) | BASE[1].rejects(have)
    return _with_shown(docs, ["doc_id"]).select("doc_id", *SHOWN, failed.alias("base_failed"), failed_rule(order, have).isNull().alias("kept"))


SHOWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _with_shown(docs: DataFrame, beside: list[str]) -> DataFrame:
    """``beside``, the text and the five base measures. One projection a step: what later steps
    read more than once is not computed anew."""
    m = metrics(F.col("text"))
    return (
        docs.select(*beside, "text", words(F.col("text")).alias("_w"), *[m[k].alias(k) for k in SHOWN[1:4]])
        .withColumn("_k", window_keys(F.col("_w")))
        .withColumn("_p", repeated_starts(F.col("_w"), F.col("_k")))
        .select(*beside, "text", F.size("_w").cast("long").alias("n_words"), *SHOWN[1:4], covered(F.col("_p")).alias("n_repeat_words"))
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
s AS (SELECT *, CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END AS sh FROM w),
p AS (SELECT doc_id, row_number() OVER () AS rid, text, ws, ls, sh FROM s),
e AS (SELECT rid, unnest(sh) AS g, unnest(range(1, len(sh) + 1)) AS i FROM p),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM e) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(text) - length(regexp_replace(text, '!', '', 'g')) AS n_marks,
             length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper
      FROM p LEFT JOIN c ON p.rid = c.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 15 * n_words OR (100 * n_upper > 30 * word_chars AND 100 * n_marks > 10 * n_words)
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
