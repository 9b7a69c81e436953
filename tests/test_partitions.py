"""Upserts that rewrite touched partitions only; serialisable rows; facts of keys in one scan a side."""

import datetime as dt
import hashlib
import json
from decimal import Decimal
from pathlib import Path

import pytest

from tablescope.operators import keys
from tablescope.operators.constraints import ForeignKey
from tablescope.sources.payload import serialisable
from tablescope.sources.upsert import _touched, upsert, upsert_partitions

SCHEMA = "region string, k int, v string, n int"
BASE = [("01", 1, "a", 1), ("01", 2, "b", 2), ("1", 1, "c", 3), ("x y", 5, "d", 4), (None, 7, "e", 5), (None, None, "f", 6)]


def digests(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    where = str(tmp_path / "t"), str(tmp_path / "s")
    upsert_partitions(spark, where[0], spark.createDataFrame(BASE, SCHEMA), ["region", "k"], {"region": "region"}, where[1], "0")
    return where


def stored(spark, path):
    return spark.read.schema(SCHEMA).parquet(path).select("region", "k", "v", "n")


@pytest.mark.parametrize("mode", ["replace", "ignore", "update", "append"])
def test_same_as_upsert_and_other_files_keep_their_bytes(spark, table, mode):
    path, stage = table
    updates = spark.createDataFrame([("01", 2, "B", 20), ("01", 3, "C", 30), (None, None, "F", 60), ("new", 9, "N", 90)], SCHEMA)
    before = digests(path)
    want = rows(upsert(spark.createDataFrame(BASE, SCHEMA), updates, ["region", "k"], mode, ["n"]))
    for _ in range(2):  # a repeated run of one version changes nothing more
        touched = upsert_partitions(spark, path, updates, ["region", "k"], {"region": "region"}, stage, "1", mode, ["n"])
        assert {r[0] for r in touched.collect()} == {"01", None, "new"}
        assert rows(stored(spark, path)) == want
    after = digests(path)
    kept = {k for k in before if k.startswith(("region=1/", "region=x"))}
    assert len(kept) >= 2 and all(after[k] == before[k] for k in kept)
    assert not any(k in after for k in before if k.startswith("region=01/"))


def test_a_lost_run_is_put_right_from_its_staged_result(spark, table):
    path, stage = table
    updates = spark.createDataFrame([("01", 2, "B", 20), ("1", 4, "Z", 40)], SCHEMA)
    upsert_partitions(spark, path, updates, ["region", "k"], {"region": "region"}, stage, "1", "append")
    want = rows(stored(spark, path))
    for p in Path(path, "region=01").glob("*"):  # as if lost between removing the old files and placing the new
        p.unlink()
    assert rows(stored(spark, path)) != want
    upsert_partitions(spark, path, updates, ["region", "k"], {"region": "region"}, stage, "1", "append")
    assert rows(stored(spark, path)) == want
    Path(stage, "version=2").mkdir()  # an unfinished stage does not count
    upsert_partitions(spark, path, spark.createDataFrame([("1", 4, "Y", 41)], SCHEMA), ["region", "k"], {"region": "region"}, stage, "2")
    assert ("1", 4, "Y", 41) in rows(stored(spark, path)) and ("01", 2, "B", 20) in rows(stored(spark, path))


def test_partitions_by_an_expression_of_two_columns(spark, tmp_path):
    path, stage = str(tmp_path / "t"), str(tmp_path / "s")
    schema = "day date, k int, v int"
    by = {"month": "date_format(day, 'yyyy-MM')", "part": "pmod(k, 2)"}
    base = [(dt.date(2024, m, d), k, 10 * m + d) for m in (1, 2, 3) for d in (1, 20) for k in range(4)]
    new = [(dt.date(2024, 1, 1), 0, -1), (dt.date(2024, 3, 5), 1, -2)]
    upsert_partitions(spark, path, spark.createDataFrame(base, schema), ["day", "k"], by, stage, "0")
    before = digests(path)
    touched = upsert_partitions(spark, path, spark.createDataFrame(new, schema), ["day", "k"], by, stage, "1")
    assert {tuple(r) for r in touched.collect()} == {("2024-01", 0), ("2024-03", 1)}  # not the mixtures of both
    changed = {str(Path(k).parent) for k in set(before) ^ set(digests(path))}
    assert changed == {"month=2024-01/part=0", "month=2024-03/part=1"}
    want = {(d, k): v for d, k, v in base} | {(d, k): v for d, k, v in new}
    assert rows(spark.read.parquet(path).select("day", "k", "v")) == sorted(((d, k, v) for (d, k), v in want.items()), key=str)


def test_empty_updates_empty_text_and_refusals(spark, table):
    path, stage = table
    before = digests(path)
    none = spark.createDataFrame([], SCHEMA)
    assert upsert_partitions(spark, path, none, ["region", "k"], {"region": "region"}, stage, "1").collect() == []
    assert digests(path) == before
    upsert_partitions(spark, path, spark.createDataFrame([("", 7, "E", 50)], SCHEMA), ["region", "k"], {"region": "region"}, stage, "2")
    assert [r for r in rows(stored(spark, path)) if r[0] is None] == [(None, 7, "E", 50), (None, None, "f", 6)]
    one = spark.createDataFrame([("1", 1, "a", 1)], SCHEMA)
    with pytest.raises(Exception, match="n"):  # the partition must follow from the key
        upsert_partitions(spark, path, one, ["region", "k"], {"p": "n % 2"}, stage, "3")
    with pytest.raises(ValueError, match="name of their own"):
        upsert_partitions(spark, path, one, ["region", "k"], {"v": "region"}, stage, "3")
    with pytest.raises(ValueError, match="lack columns"):
        upsert_partitions(spark, path, one.drop("v"), ["region", "k"], {"region": "region"}, stage, "3")
    with pytest.raises(Exception, match="more than one row of a key"):
        upsert_partitions(spark, path, one.unionByName(one), ["region", "k"], {"region": "region"}, stage, "3")
    assert upsert_partitions(spark, path + "2", none, ["region", "k"], {"region": "region"}, stage + "2", "0").collect() == []
    upsert_partitions(spark, path + "2", one, ["region", "k"], {"region": "region"}, stage + "2", "1")
    assert rows(stored(spark, path + "2")) == [("1", 1, "a", 1)]


def test_only_touched_partitions_are_read(spark, table):
    updates = spark.createDataFrame([("01", 2, "B", 20), ("x y", 2, "B", 20)], SCHEMA)
    old = _touched(spark, table[0], updates, ["region"])
    assert "PartitionFilters: [region" in old._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in rows(old)} == {"01", "x y"}


def test_serialisable(spark):
    t = dt.datetime(2024, 5, 1, 10, 0, 0)
    data = [(1, 1.5, True, "x", dt.date(2024, 5, 1), t, t.replace(microsecond=1500), Decimal("1.20"), [t, None], (dt.date(1, 1, 1), None), {dt.date(2024, 1, 2): Decimal("3.00")}),
            (None,) * 11, (2, float("nan"), False, "", None, None, None, None, [], (None, 2), {})]
    schema = "i int, d double, b boolean, s string, da date, ts timestamp_ntz, us timestamp_ntz, de decimal(5,2), a array<timestamp_ntz>, st struct<x: date, y: int>, m map<date, decimal(5,2)>"
    got = [r.asDict(recursive=True) for r in serialisable(spark.createDataFrame(data, schema)).collect()]
    assert got[0] == {"i": 1, "d": 1.5, "b": True, "s": "x", "da": "2024-05-01", "ts": t.isoformat(), "us": t.replace(microsecond=1500).isoformat(), "de": "1.20",
                      "a": [t.isoformat(), None], "st": {"x": "0001-01-01", "y": None}, "m": {"2024-01-02": "3.00"}}
    assert set(got[1].values()) == {None}
    assert got[2]["d"] is None and got[2]["a"] == [] and got[2]["st"] == {"x": None, "y": 2} and got[2]["m"] == {}
    json.dumps(got, allow_nan=False)


def test_parent_rows_come_from_the_integrity_scan(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    fk = ForeignKey("f", "c", ("fk",), "p", ("id",))
    for t, want in (({"c": child, "p": parent}, (4, 1, 1, 1, 4)), ({"c": child, "p": parent.limit(0)}, (4, 1, 3, 2, 0)), ({"c": child.limit(0), "p": parent}, (0, 0, 0, 0, 4))):
        r = keys.referential_integrity(t, [fk], count_parents=True).first()
        assert (r.child_rows, r.null_fk_rows, r.orphan_rows, r.orphan_keys, r.parent_rows) == want
        assert r[:-1] == keys.referential_integrity(t, [fk]).first()
