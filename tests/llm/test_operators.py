"""Every operator on Spark: edge cases, empty tables, extra columns, against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.llm import byte_bpe, components, decontaminate, html_text, license_scan, quality_classifier, quality_rules, queries, shards, simhash, suffix_dedup, warc, window_dedup

from . import brute
from .conftest import prose
from .test_units import PAGES

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def clashing(docs):
    """``docs`` with more columns, named as the operators name theirs."""
    names = ["_did", "_rk", "_th", "_key", "_row", "row", "marks", "bucket", "blob", "fp", "th", "route", "failed_rule", "n_words", "_w", "_k", "_p", "ids", "x", "low", "kept", "removed", "component_id"]
    return docs.withColumns({n: F.lit(1) for n in names})


REPORTS = {
    "rules": quality_rules.quality_report,
    "licenses": license_scan.scan,
    "bpe": lambda d: byte_bpe.bpe_report(d, *byte_bpe.public_vocabulary()),
    "simhash": simhash.simhash_report,
    "suffix": suffix_dedup.suffix_report,
    "window": window_dedup.window_report,
}


@pytest.mark.parametrize("name", REPORTS)
def test_empty_tables_and_clashing_columns(name, docs, no_docs):
    assert REPORTS[name](no_docs).collect() == []
    few = docs.limit(12)
    few = docs.sparkSession.createDataFrame(few.collect(), docs.schema)
    assert rows(REPORTS[name](clashing(few))) == rows(REPORTS[name](few))


def test_quality_rules(docs, corpus):
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = Counter((d, *(brute.base_rules(t)[k] for k in shown)) for d, t in corpus)
    assert rows(quality_rules.quality_report(docs).select("doc_id", *shown)) == want
    kept = quality_rules.quality_rules(docs).where("failed_rule is null")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, t in corpus if brute.base_rules(t)["kept"])


def test_repeated_words_when_hashes_clash(docs, corpus, monkeypatch):
    monkeypatch.setattr(quality_rules, "START_BITS", 58)  # 6 bits of hash are left
    monkeypatch.setattr(quality_rules, "START_MASK", (1 << 58) - 1)
    got = quality_rules.quality_report(docs).select("doc_id", "n_repeat_words", "kept")
    assert rows(got) == Counter((d, brute.base_rules(t)["n_repeat_words"], brute.base_rules(t)["kept"]) for d, t in corpus)


def test_rules_are_ordered_by_rejections_per_cost(docs):
    rules = [*quality_rules.BASE, *quality_rules.EXTRA]
    found = quality_rules.measure(docs, rules, fraction=1)
    assert [m.rule for m in found] == rules and all(m.seconds > 0 and 0 <= m.rejected <= 1 for m in found)
    gains = {m.rule.name: m.gain for m in found}
    order = [gains[r.name] for r in quality_rules.ordered(found)]
    assert order == sorted(order, reverse=True)


def test_quality_rules_oracle(spark):
    from tests.oracle import compare

    ok, why = compare(spark, "op1", queries.op1_quality_rules, quality_rules.ORACLE, SF)
    assert ok, why


def test_bpe(docs, corpus):
    assert rows(REPORTS["bpe"](docs)) == Counter(brute.tokens(corpus))


def test_bpe_blocks_and_decoding(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 500)
    path, pattern = byte_bpe.public_vocabulary()
    ranks = byte_bpe.load_ranks(path)
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern, buckets=3), ranks)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in done.collect()) == Counter((d, (t or "").encode()) for d, t in corpus)


def test_simhash(docs, corpus):
    assert rows(simhash.simhash_report(docs)) == Counter({r: sum(d == r[0] for d, _ in corpus) for r in brute.simhash(corpus)})


def test_simhash_small_tiles(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(9)} | {0, 1, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["id"]: r["component"] for r in components.components(simhash.links(fps, tile=2)).collect()}
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    parts = {}
    for i, s in enumerate(signed):
        parts.setdefault(top(i), []).append(s)
    for members in parts.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (299, 300)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(50)}, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays(docs, corpus):
    want = Counter(c for _, _, c in {r[2]: r for r in brute.simhash(corpus)}.values())
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == want
    again = docs.unionByName(docs)
    assert rows(simhash.without_near_duplicates(again)) == rows(left)


@pytest.mark.parametrize("limit", [None, 2000])
def test_suffix_dedup(docs, corpus, monkeypatch, limit):
    if limit:  # small buckets: many heavy minimisers, pieces cut within texts
        for name in ("BUCKET", "PIECE", "HELD"):
            monkeypatch.setattr(shards, name, limit)
        monkeypatch.setattr(shards, "SAMPLE_EVERY", 1)
        monkeypatch.setattr(suffix_dedup, "PIECE", limit)
    assert rows(suffix_dedup.suffix_report(docs)) == Counter(brute.repeated_bytes(corpus))


@pytest.mark.parametrize("limit", [None, 2000])
def test_window_dedup(docs, corpus, monkeypatch, limit):
    if limit:
        for name in ("BUCKET", "PIECE", "HELD"):
            monkeypatch.setattr(shards, name, limit)
        monkeypatch.setattr(shards, "SAMPLE_EVERY", 1)
        monkeypatch.setattr(window_dedup, "PART", 60)
    assert rows(window_dedup.window_report(docs)) == Counter(brute.repeated_windows(corpus))


def test_dedup_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    a, b = prose(rng, 120), prose(rng, 120)
    data = [(1, a), (1, a), (None, b), (None, b), (2, f"{b} {a}"), (2, "short")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(window_dedup.window_report(docs)) == Counter(brute.repeated_windows(data))
    assert rows(suffix_dedup.suffix_report(docs)) == Counter(brute.repeated_bytes(data))


def test_dedup_of_shared_ids_whose_texts_have_one_32_bit_hash(spark):
    a, b = (" ".join(hashlib.md5(f"{i}.{k}".encode()).hexdigest() for k in range(30)) for i in (971, 114894))
    assert len({r[0] for r in spark.createDataFrame([(a,), (b,)], "text string").select(F.hash("text")).collect()}) == 1
    for shared in (None, 7):
        data = [(shared, a), (shared, b), (1, a), (2, "short")]
        docs = spark.createDataFrame(data, "doc_id long, text string")
        assert rows(window_dedup.window_report(docs)) == Counter(brute.repeated_windows(data))
        assert rows(suffix_dedup.suffix_report(docs)) == Counter(brute.repeated_bytes(data))


@pytest.mark.parametrize("window,least_words", [(200, 51), (60, 5), (20, 3)])
def test_passages_of_so_many_words(docs, corpus, window, least_words):
    got = Counter((r["row"]["doc_id"], r["text"]) for r in suffix_dedup.unrepeated_text(docs, window, least_words).collect())
    assert got == Counter(brute.without_passages(corpus, window, least_words))


def test_passages_under_a_window_of_the_report(spark):
    """51 words of fewer than 400 bytes: op9 leaves them, the pipeline's stage cuts them."""
    rng = random.Random(8)
    passage = " ".join(prose(rng, 1)[:5] for _ in range(51))
    short = " ".join(passage.split()[:40])
    assert len(passage) < 400
    data = [(1, f"{prose(rng, 60)}\n{passage}\n{prose(rng, 60)}"), (2, f"{passage} {prose(rng, 80)}"), (3, f"{prose(rng, 70)} {short}")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["n_removed"] for r in suffix_dedup.suffix_report(docs).collect()} == {0}
    left = {r["row"]["doc_id"]: r["text"] for r in suffix_dedup.unrepeated_text(docs, 200, 51).collect()}
    assert passage not in left[1] and passage not in left[2] and left[3] == data[2][1]


def test_kept_bytes_as_text(spark):
    text = "日本" * 300
    docs = spark.createDataFrame([(1, "x" + text), (2, text + "yz"), (3, "z" * 10)], "doc_id long, text string")
    left = {r["row"]["doc_id"]: r["text"] for r in suffix_dedup.unrepeated_text(docs).collect()}
    assert left == {1: "x", 2: "yz", 3: "z" * 10}


def edited(rng, text, share):
    return " ".join("edited" + str(i) if rng.random() < share else w for i, w in enumerate(text.split()))


@pytest.fixture(scope="module")
def leaky(spark, corpus):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randint(9, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (3, prose(rng, 30)), (60, "naïve Übung " * 6)]
    items.append(items[0])
    texts = []
    for k, (_, t) in enumerate(items[:12]):
        texts += [f"{prose(rng, 200)} {t} {prose(rng, 50)}", f"{t.upper()}, {prose(rng, 30)}", edited(rng, t, 0.15), edited(rng, t, 0.9), f"{' '.join(t.split()[: len(t.split()) // 3])} {prose(rng, 40)}"]
    texts += [f"{items[0][1]} {prose(rng, 99)} {items[0][1]} {items[1][1]}", None, "", "NAÏVE übung " * 6] + [items[2][1]] * 20
    data = [(i, t) for i, t in enumerate(texts)] + [(1000 + d, t) for d, t in corpus]
    return data, items, spark.createDataFrame(data, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(leaky):
    data, items, docs, benchmark = leaky
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, benchmark).collect()}
    want = brute.leaks(data, items)
    assert set(got) == set(want) and all(got[k]["score"] == pytest.approx(want[k]) for k in want)
    text = dict(data)
    exact = got[0, 0]
    assert exact["score"] == 1 and brute.plain_words(text[0])[exact["start"] : exact["end"]] == brute.plain_words(items[0][1])


def test_decontamination_of_repeated_partial_copies(spark):
    rng = random.Random(21)
    items = [(k, prose(rng, n)) for k, n in enumerate((16, 38, 59, 20))]
    data = []
    for (_, t), times in zip(items, (16, 17, 300, 17)):
        w = t.split()
        part = " ".join(w[: len(w) // 2 + 1]) if len(w) == 20 else " ".join("changed" if k % 5 == 4 else x for k, x in enumerate(w))
        data += [f"{prose(rng, 20)} {part} {prose(rng, 20)}" for _ in range(times)]
    data = list(enumerate(data))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) == 350 and got == pytest.approx(brute.leaks(data, items))


def test_decontamination_of_short_items_and_repeated_ids(spark):
    rng = random.Random(31)
    items = [(n, prose(rng, n)) for n in range(1, 10)] + [(20, "no no no no"), (21, prose(rng, 30)), (21, prose(rng, 30)), (None, prose(rng, 12))]
    texts = [f"{prose(rng, 30)} {t} {prose(rng, 30)}" for _, t in items] + [" ".join(t.split()[1:]) for _, t in items[2:9]] + ["no no no", "No, no! no? NO."]
    data = list(enumerate(texts))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.leaks(data, items)
    assert {i for _, i in want} == {*range(3, 10), 20, 21, None} and got == pytest.approx(want)
    same = [(None, texts[11]), (None, texts[11]), (7, texts[11]), (7, f"{texts[11]} {texts[10]}")]
    found = decontaminate.contaminated(spark.createDataFrame(same, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r["doc_id"], r["item_id"]) for r in found.collect()) == Counter({(None, 21): 2, (7, 21): 3})


def test_decontamination_with_a_phrase_in_every_item_and_text(spark):
    rng = random.Random(41)
    phrase = "which of the following statements is true"
    items = [(k, f"{phrase} {prose(rng, rng.randint(18, 26))}") for k in range(90)]
    items += [(200 + k, f"{prose(rng, 9)} {x}") for k, x in enumerate(("alpha", "beta"))] + [(300 + k, items[5][1]) for k in range(80)]
    data = [f"{prose(rng, 20)} {phrase} {prose(rng, 20)}" for _ in range(90)]
    data += [f"{prose(rng, 20)} {t} {prose(rng, 20)}" for _, t in items[:4]] + [edited(rng, t, 0.15) for _, t in items[4:8]]
    data = list(enumerate(data))
    docs, benchmark = spark.createDataFrame(data, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    distinct = items[:92]
    want = brute.leaks(data, distinct)
    want |= {(d, 300 + k): s for (d, i), s in want.items() if i == 5 for k in range(80)}
    assert got == pytest.approx(want) and {i for d, i in want if i < 8} == set(range(8))

    own = decontaminate.seeds(decontaminate.grams(decontaminate._items(benchmark.where("item_id < 300"))))
    found = decontaminate.passages(docs, decontaminate.bitmap(own), 20)
    assert decontaminate.candidates(found, own).count() < 40  # of 98 x 92 that share the phrase


def test_decontamination_of_nothing(spark, leaky):
    _, _, docs, benchmark = leaky
    assert decontaminate.contaminated(docs.limit(0), benchmark).collect() == []
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []
    assert decontaminate.contaminated(docs, benchmark.where("item_id in (50, 51, 52)")).collect() == []
    few = docs.where("doc_id < 3")
    assert rows(decontaminate.contaminated(clashing(few), benchmark.withColumn("item", F.lit(1)))) == rows(decontaminate.contaminated(few, benchmark))


def test_licenses(spark):
    rng = random.Random(12)
    t = license_scan.TEMPLATES
    mit = t["MIT"].split()
    cases = {
        1: (f"{prose(rng, 60)}\n{t['CC-BY-NC-4.0-notice']}", {"CC-BY-NC-4.0-notice"}),
        2: (f"{t['MIT'].upper()} {prose(rng, 50)}", {"MIT"}),
        3: (" ".join(w if i % 9 else "changed" for i, w in enumerate(mit)), {"MIT"}),
        4: (" ".join(mit[: len(mit) // 2]), set()),
        5: (f"{t['GPL-3.0-notice']} {prose(rng, 30)} {t['all-rights-reserved']} {prose(rng, 9)} {t['GPL-3.0-notice']}", {"GPL-3.0-notice", "all-rights-reserved"}),
        6: (None, set()), 7: ("", set()), 8: (prose(rng, 300), set()), 9: ("no license and no rights here", set()),
    }
    docs = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    found = license_scan.scan(docs).collect()
    for k, (text, want) in cases.items():
        assert {r["license"] for r in found if r["doc_id"] == k} == want, k
    for r in found:
        have, want = brute.plain_words(cases[r["doc_id"]][0]), brute.plain_words(t[r["license"]])
        assert r["n_matched"] == sum(s["end"] - s["start"] for s in r["spans"]) and r["coverage"] == pytest.approx(r["n_matched"] / len(want))
        assert all(w in want for s in r["spans"] for w in have[s["start"] : s["end"]])
    assert sum(r["doc_id"] == 5 and r["license"] == "GPL-3.0-notice" for r in found) == 2


def test_licenses_that_follow_each_other(spark):
    t = license_scan.TEMPLATES
    short = [n for n, x in t.items() if len(brute.plain_words(x)) <= 8]
    assert "all-rights-reserved" in short
    cases = [(name, times, gap) for name in short for times in (1, 2, 3, 1000) for gap in ("\n", " Photo A. ")]
    docs = spark.createDataFrame([(k, gap.join([t[name]] * times)) for k, (name, times, gap) in enumerate(cases)], "doc_id long, text string")
    found = Counter((r["doc_id"], r["license"]) for r in license_scan.scan(docs).where("coverage = 1").collect())
    for k, (name, times, _) in enumerate(cases):
        assert found[k, name] == times, cases[k]


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality_classifier.quality_scores(docs, labels)
    assert got.count() == docs.count()
    test = got.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert len(test) > 50 and sum(r["predicted"] == r["quality"] for r in test) / len(test) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in test)
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality_classifier.quality_scores(docs, flipped)) == rows(got)  # held-out labels are never read


def test_classifier_edges(spark, docs, no_docs, corpus):
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, _) in enumerate(corpus)] + [(None, 1, 0), (3, None, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(clashing(docs), labels.withColumn("x", F.lit(1))).collect()
    assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.quality_scores(no_docs, labels).collect() == []
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert len(set(quality_classifier.quality_scores(docs, none).select("score").collect())) == 1
    null_id = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    assert quality_classifier.quality_scores(null_id, labels).first()["held_out"] is False


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(13)
    html = [p for p, _ in PAGES] + [f"<p>{prose(rng, 80)}</p>" for _ in range(30)]
    html += [html[1]] * 12 + ["<p>" + "z" * 200_000, "<p>ü</p>", None, "a\r\n\r\nb"]
    data = [((11 * i) % 97, f"http://h/{i}" if i % 5 else None, h) for i, h in enumerate(html)]
    return data, spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)


def test_warc(spark, pages, monkeypatch):
    data, frame = pages
    monkeypatch.setattr(warc, "ROLL", 3000)
    want = Counter(brute.warc([(p, h) for p, _, h in data]))
    assert rows(warc.warc_report(frame)) == want
    assert rows(warc.warc_report(frame.withColumns({n: F.lit(1) for n in ("file", "offset", "key", "size", "payload", "first")}))) == want
    some = warc.write_archives(frame).where("page_id % 3 = 0")
    urls = {p: u for p, u, _ in data}
    payload = {p: (h or "").encode() for p, _, h in data}
    read = warc.read_records(some).collect()
    assert {r["page_id"] for r in read} == {p for p in urls if p % 3 == 0}
    for r in read:
        assert r["url"] == urls[r["page_id"]]
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == payload[r["page_id"]]


def test_warc_limits_and_repeats(spark):
    twice = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (None, None, "same"), (None, None, "alone"), (3, "w", ""), (4, "w", None)]
    frame = spark.createDataFrame(twice, "page_id long, url string, html string")
    assert rows(warc.warc_report(frame)) == Counter(brute.warc([(p, h) for p, _, h in twice]))
    assert {r["record_type"] for r in warc.warc_report(frame, min_bytes=5).collect()} == {"response"}
    assert warc.warc_report(frame.limit(0)).collect() == []


def test_html(spark, pages):
    data, frame = pages
    want = Counter((p, u, html_text.main_text(h), len(html_text.main_text(h))) for p, u, h in data)
    assert rows(html_text.extract_text(frame)) == want
    assert rows(html_text.extract_text(frame.withColumns({"text": F.lit("x"), "n_chars": F.lit(0)}))) == want
    assert html_text.extract_text(frame.limit(0)).collect() == []


def test_queries_run_on_the_tables(spark):
    for name, query in queries.queries().items():
        assert query(spark, SF).count() >= 0, name
