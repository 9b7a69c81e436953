"""The pipeline against its stages done by plain Python."""

from collections import Counter

import corpus_pipeline
from tablescope.llm import byte_bpe

from . import brute


def plain(rows, items):
    rows = [(d, t) for d, t in rows if brute.base_rules(t)["kept"]]
    keep = {c for _, _, c in brute.simhash(rows)}
    seen, left = set(), []
    for d, t in rows:
        if d in keep and d not in seen:
            seen.add(d)
            left.append((d, t))
    cut = brute.without_passages(left, corpus_pipeline.PASSAGE_WINDOW, corpus_pipeline.PASSAGE_WORDS)
    bad = {d for d, _ in brute.leaks(cut, items)}
    return brute.tokens([(d, t) for d, t in cut if d not in bad])


def test_pipeline_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(rows, items))


def test_pipeline_on_edge_cases(spark, docs, corpus, tmp_path):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    items = [(1, " ".join((corpus[-1][1] or "").split()[5:40])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf)
    want = plain(corpus, items)
    assert len(want) > 10 and Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_stages_on_nothing_and_more_columns(spark, docs, no_docs):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    for start in (no_docs, docs.withColumns({n: F.lit(1) for n in ("_row", "_key", "failed_rule", "kept", "marks", "fp")})):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == start.columns and now.dtypes == start.dtypes, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).columns == byte_bpe.bpe_report(start, *byte_bpe.public_vocabulary()).columns
