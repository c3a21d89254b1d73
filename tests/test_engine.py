"""Operators, functions, sources and plans of the engine on literal tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import types as bt
from brindle.functions.aggregates import Agg, PartialAggregate
from brindle.functions.scalar import REGISTRY
from brindle.operators.aggregate import aggregate, custom_aggregate, exact_percentile, salted_aggregate
from brindle.operators.basic import distinct, distinct_stats, filter_, needed_columns, project
from brindle.operators.exchange import exchange, shuffle_id
from brindle.operators.joins import broadcast_if_small, join, join_on, salted_join
from brindle.operators.metrics import fingerprint, measured, regressions, running, suggested_partitions
from brindle.operators.ordering import Key, limit, sort, top_n
from brindle.operators.runs import bitmap, bitmap_keep, bitmap_not, bitmap_size, run_aggregate, run_segments
from brindle.operators.sets import set_op
from brindle.operators.windows import Frame, FrameFunction, WinFn, WinSpec, column_over, fold_frames, order, register_window, window
from brindle.plans.expressions import Aggregate, Call, Case, Cast, Col, In, IsNull, Like, Lit, columns, contains_aggregate, depth, infer, to_column, transform
from brindle.plans.stage import Node, StagePlan
from brindle.session import settings_from_yaml
from brindle.sources import arrow_ipc, avro, iceberg
from brindle.sources.lake import LakeReader, ScanSpec, scan
from brindle.sources.predicates import Predicate
from brindle.sources.sinks import SinkSpec, sink


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr, schema="x int", row=(1,)):
    df = spark.createDataFrame([row], schema)
    return df.select(to_column(expr, df)).first()[0]


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame([(1,), (None,), (3,)], "y int")


@pytest.mark.parametrize("how,safe,sql", [("inner", 3, 2), ("left", 4, 4), ("right", 4, 4), ("full", 5, 6), ("semi", 3, 2), ("anti", 1, 2)])
def test_join_null_keys(a, b, how, safe, sql):
    assert join(a, b, ["x"], ["y"], how, null_safe=True).count() == safe
    assert join(a, b, ["x"], ["y"], how).count() == sql


def test_join_on_and_salted(spark, a, b):
    assert join_on(a, b, "x < y").count() == 3
    left, right = spark.range(100).selectExpr("id % 3 AS k", "id"), spark.range(3).selectExpr("id AS k", "id * 10 AS v")
    assert salted_join(left, right, "k", 4).count() == 100
    assert salted_join(left, right.where("k < 2"), "k", 4, "left").where("v IS NULL").count() == 33


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_copies_are_not_broadcast(spark, how):
    left = spark.range(3000).selectExpr("nullif(if(id % 3 > 0, 7, id % 50), 49) AS k", "id").repartition(5)
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, None), (None, "c"), (90, "d")], "k long, v string")
    salted, plain = salted_join(left, right, "k", 4, how), left.join(right, "k", how)
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert salted.columns == plain.columns and sorted(values(salted), key=str) == sorted(values(plain), key=str)


def test_set_modes(a, b):
    counts = {("intersect", "sql"): 2, ("intersect", "bag_left"): 3, ("except", "sql"): 1, ("except", "bag_left"): 1, ("except_all", "sql"): 2, ("union_all", "sql"): 7, ("union", "sql"): 4}
    for (kind, mode), n in counts.items():
        assert set_op(a, b, kind, mode).count() == n, (kind, mode)
    with pytest.raises(ValueError):
        set_op(a, b, "minus")


def test_division_and_modulo(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, 0), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(to_column(Col("a") / Col("b"), df)).collect()] == [3, -3, None, None]
    assert infer(Col("a") / Col("b"), df) == T.IntegerType()
    assert [r[0] for r in df.select(to_column(Col("a") % Col("b"), df)).collect()] == [1, -1, None, None]
    df = spark.createDataFrame([(7.0, 2.0), (7.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(to_column(Col("a") / Col("b"), df)).collect()] == [3.5, None]


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        one(spark, Col("x") + Lit(1), row=(2**31 - 1,))


def test_logarithms_at_the_edge(spark):
    assert one(spark, Call("ln", (Col("x"),)), "x double", (0.0,)) == -math.inf
    assert math.isnan(one(spark, Call("ln", (Col("x"),)), "x double", (-1.0,)))
    assert math.isnan(one(spark, Call("sqrt", (Col("x"),)), "x double", (-1.0,)))


@pytest.mark.parametrize("fn,args,want", [
    ("length", (), 6), ("upper", (), "HÉLLO"), ("substring", (Lit(0), Lit(2)), "hé"), ("substring", (Lit(9), Lit(2)), ""), ("replace", (Lit("l"), Lit("L")), "héLLo"),
    ("regex_match", (Lit("l+o$"),), True), ("regex_match", (Lit("["),), False), ("concat", (Lit("!"),), "héllo!"),
])
def test_strings(spark, fn, args, want):
    assert one(spark, Call(fn, (Col("x"), *args)), "x string", ("héllo",)) == want
    assert one(spark, Call(fn, (Col("x"), *args)), "x string", (None,)) is None


def test_trim_takes_all_white_space(spark):
    assert one(spark, Call("trim", (Col("x"),)), "x string", ("\t  a b\n",)) == "a b"


@pytest.mark.parametrize("day,dow,doy", [("1970-01-01", 4, 1), ("2000-02-29", 2, 60), ("2024-01-07", 0, 7), ("2024-12-31", 2, 366)])
def test_dates(spark, day, dow, doy):
    d = dt.date.fromisoformat(day)
    got = lambda e: one(spark, e, "x date", (d,))
    assert got(Call("extract", ("dow", Col("x")))) == dow and got(Call("extract", ("doy", Col("x")))) == doy
    assert got(Call("date_diff", (Lit("1970-01-01", "date32"), Col("x")))) == (d - dt.date(1970, 1, 1)).days
    assert got(Call("format_date", ("MM/DD/YYYY", Col("x")))) == d.strftime("%m/%d/%Y") and got(Call("format_date", ("?", Col("x")))) == day
    assert one(spark, Call("date_add", (Col("x"), 1)), "x date", (None,)) is None
    with pytest.raises(ValueError):
        got(Call("extract", ("week", Col("x"))))


def test_kleene_case_and_cast(spark):
    null = Lit(None, "boolean")
    assert one(spark, Lit(False) & null) is False and one(spark, Lit(True) | null) is True and one(spark, Lit(True) & null) is None
    assert one(spark, Case(((null, Lit("a")),), Lit("b"))) == "b"
    assert one(spark, Cast(Lit("x"), "int64")) is None and one(spark, Cast(Lit("12"), "int32")) == 12
    assert one(spark, In(Lit(None, "int32"), (1, 2))) is None and one(spark, IsNull(Lit(None, "int32"))) is True and one(spark, Like(Lit("abc"), "a_%")) is True


def test_expression_visitors(spark):
    e = (Col("a") + Col("b") * 2) > Aggregate("sum", Col("a"))
    assert columns(e) == ["a", "b"] and depth(e) == 4 and contains_aggregate(e) and needed_columns([e, Col("c")]) == ["a", "b", "c"]
    assert columns(transform(e, lambda x: Col("z") if x == Col("a") else x)) == ["z", "b"]
    with pytest.raises(AnalysisException):
        infer(Col("nope"), spark.range(1))
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1))], "s string, d date")
    with pytest.raises(TypeError):
        to_column(Col("s").eq(Col("d")), df)
    with pytest.raises(TypeError):
        to_column(Aggregate("sum", Col("s")), df)


def test_function_registry():
    with pytest.raises(KeyError):
        REGISTRY.get("nothing")
    with pytest.raises(TypeError):
        REGISTRY.call("abs", [F.lit(1), F.lit(2)], [])
    assert len(REGISTRY.names()) >= 37


def test_types():
    assert bt.spark_type("uint64") == T.DecimalType(20, 0) and bt.spark_type("list<int32>") == T.ArrayType(T.IntegerType())
    assert bt.spark_type("struct<a:utf8,b:map<utf8,int64>>")["b"].dataType == T.MapType(T.StringType(), T.LongType())
    assert bt.promoted(T.LongType(), T.FloatType()) == T.DoubleType() and bt.promoted(T.ShortType(), T.LongType()) == T.LongType()
    assert bt.comparable(T.DateType(), T.TimestampType()) and not bt.comparable(T.StringType(), T.LongType()) and not bt.aggregatable(T.StringType())


def test_variance_guard_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 1.0), ("c", 3.0)], "k string, v double")
    got = {r[0]: tuple(r)[1:] for r in aggregate(df, ["k"], [Agg("variance", "v", "v2"), Agg("stddev", "v", "sd"), Agg("count", "v", "n"), Agg("count", "v", "rows", include_nulls=True)]).collect()}
    assert got == {"a": (None, None, 0, 1), "b": (None, None, 1, 1), "c": (1.0, 1.0, 2, 2)}
    assert values(aggregate(df.where("false"), (), [Agg("count", None, "n"), Agg("sum", "v", "s")])) == [(0, None)]
    assert aggregate(df.where("false"), ["k"], [Agg("sum", "v", "s")]).count() == 0


def test_ordered_aggregates(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (4, None)], "i int, s string")
    got = aggregate(df, (), [Agg("concat", "s", "c", order_by="i", arg="-"), Agg("array_agg", "s", "l", order_by="i"), Agg("first", "s", "f", order_by="i"), Agg("mode", "s", "m"), Agg("percentile", "i", "p", arg=0.25)]).first()
    assert (got.c, got.l, got.f, got.m, got.p) == ("a-b-c", ["a", "b", "c"], "a", "a", 1.75)


def test_salted_aggregate_is_the_plain_one(spark):
    df = spark.range(500).selectExpr("id % 2 AS k", "id AS v")
    aggs = [Agg("sum", "v", "s"), Agg("count", None, "n"), Agg("avg", "v", "m"), Agg("min", "v", "lo")]
    assert sorted(values(salted_aggregate(df, ["k"], aggs))) == sorted(values(aggregate(df, ["k"], aggs)))
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], [Agg("median", "v", "x")])


def test_sort_top_limit(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "i int, v int")
    assert [r.i for r in sort(df, [Key("v", asc=False, nulls_first=True)]).collect()] == [1, 2, 3]
    assert [r.i for r in sort(df, [Key("v")]).collect()] == [3, 2, 1]
    assert "TakeOrderedAndProject" in top_n(df, [Key("i")], 1)._jdf.queryExecution().executedPlan().toString()
    assert [r.i for r in limit(sort(df, ["i"]), 1, 1).collect()] == [2] and limit(df, 0).count() == 0


def test_groups_frame(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "x int")
    got = window(df, [WinFn("sum", ("x",), "s", WinSpec((), order("x"), Frame("groups", -1, 0)))])
    assert sorted(r.s for r in got.collect()) == [1, 5, 5, 8]


@pytest.mark.parametrize(("by", "batch"), [((), 3), (("k",), 1), (("k",), 10_000)])
def test_functions_of_frames_are_the_plain_ones(spark, by, batch):
    def total(x, starts, ends):
        return [float(sum(v for v in x[a:b] if v == v)) if any(v == v for v in x[a:b]) else None for a, b in zip(starts, ends, strict=True)]

    register_window("own_sum", FrameFunction(total))
    df = spark.range(60).selectExpr("id % 7 % 4 AS k", "id AS u", "id % 11 AS x", "nullif(id % 5, 2) AS v", "'t' AS own").repartition(3)
    frames = [("u", None), (None, None)] + [("u", Frame("rows", a, b)) for a, b in ((-2, 0), (0, 3), (None, -1), (2, None), (-4, -2), (3, 5), (None, None), (-1, None))]
    frames += [("x", Frame(kind, a, b)) for kind in ("range", "groups") for a, b in ((-2, 1), (None, 0), (0, None), (1, None), (2, 3), (-3, -2), (None, None))] + [("x", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for key, frame in frames:
            spec = WinSpec(by, order(key) if key else (), frame)
            got = window(df, [WinFn("own_sum", ("v",), "own", spec), WinFn("sum", ("v",), "s", spec)]).select("u", "own", "s").collect()
            assert len(got) == 60 and [(r.u, r.own) for r in got if r.own != r.s] == [], (key, frame)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        column_over(df, WinFn("own_sum", ("v",), "s", spec))


def test_functions_of_frames_get_many_rows_at_once(spark, small):
    from brindle.catalogue.storage import win_custom

    register_window("calls", FrameFunction(lambda x, starts, ends: [len(starts)] * len(starts), "int"))
    df = spark.range(2000).selectExpr("id % 500 AS k", "id")
    got = window(df, [WinFn("calls", ("id",), "n", WinSpec(("k",), order("id"), Frame("rows", -2, 0)))])
    assert got.where("n < 100").count() == 0 and got.count() == 2000
    assert "InPandas" not in (plan := win_custom(spark, small)._jdf.queryExecution().executedPlan().toString()) and "WindowPython" not in plan
    ends = fold_frames(np.fmax, np.array([3.0, float("nan"), 1.0]), np.array([0, 1, 1, 3]), np.array([2, 2, 3, 3]))
    assert [None if x != x else x for x in ends] == [3.0, None, 1.0, None]


def test_distinct(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (None, 3), (None, 3)], "k int, v int")
    assert sorted(values(distinct(df, ["k"], [Key("v")])), key=str) == [(1, 1), (None, 3)]
    assert values(distinct_stats(df, ["k"])) == [(4, 2, 2)] and distinct(df).count() == 3


def test_exchange_and_shuffle_ids(spark):
    df = spark.range(100)
    for strategy, n in (("hash", 6), ("range", 6), ("round_robin", 6), ("single", 1)):
        out = exchange(df, strategy, ["id"], 6)
        assert out.count() == 100 and out.rdd.getNumPartitions() == n
    assert {r[0] for r in df.select(shuffle_id(["id"], 5)).collect()} == set(range(5))


def test_broadcast_checks_the_size(spark, small):
    big = spark.read.parquet(f"{small}/lineitem.parquet")
    assert "ResolvedHint" in broadcast_if_small(big)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(big, 10)._jdf.queryExecution().analyzed().toString()


def test_runs(spark):
    df = spark.createDataFrame(list(enumerate([1, 1, 2, 2, 2, 1, None, None])), "i int, v int")
    segments = run_segments(df, "v", ["i"])
    assert sorted((r.start, r.v, r.length) for r in segments.collect()) == [(0, 1, 2), (2, 2, 3), (5, 1, 1), (6, None, 2)]
    assert values(run_aggregate(segments, "v")) == [(9, 6, 1, 2, 1.5)]


def test_runs_are_found_with_one_sort_and_no_groups(spark):
    rows = [(g, i, [1, 1, None, None, 2, None, 1][(i * i + g) % 7 if g else 0]) for g in range(4) for i in range(50)]
    df = spark.createDataFrame([*rows, (None, 5, None), (None, 3, None), (None, None, 4)], "g int, i int, v int").repartition(3)
    want = []
    for g in {r.g for r in df.collect()}:
        runs = []
        for at, r in enumerate(sorted((r for r in df.collect() if r.g == g), key=lambda r: -1000 if r.i is None else -r.i)):
            if not runs or runs[-1][2] != r.v:
                runs.append([g, len(runs) + 1, r.v, at, 0])
            runs[-1][4] += 1
        want += map(tuple, runs)
    got = run_segments(df, "v", [Key("i", asc=False, nulls_first=True)], ["g"])
    plan = got._jdf.queryExecution().executedPlan().toString()  # before it runs
    assert dict(got.dtypes) == {"g": "int", "segment": "bigint", "v": "int", "start": "bigint", "length": "bigint"}
    assert sorted(values(got), key=str) == sorted(want, key=str)
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan and run_segments(df.where("g > 9"), "v", ["i"]).count() == 0


def test_metrics(spark):
    m = measured(spark.range(10), lambda d: d.where("id < 4"))
    m.result.collect()
    assert m.figures() == {"rows_in": 10, "rows_out": 4, "selectivity": 0.4}
    assert fingerprint(spark.range(5).where("id > 1")) == fingerprint(spark.range(5).where("id > 1")) != fingerprint(spark.range(5).where("id > 2"))
    assert running(spark) == [] and suggested_partitions(spark.range(10)) == spark.sparkContext.defaultParallelism
    assert regressions({"a": 1.0, "b": 1.0}, {"a": 1.05, "b": 1.5}) == {"b": 0.5}


def test_predicates_reach_the_files(spark, small):
    df = LakeReader(spark, f"{small}/orders.parquet").where(Predicate("o_totalprice", "gt", ("1000",)), Predicate("o_orderstatus", "in", ("O", "F"))).select("o_orderkey").read()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "In(o_orderstatus" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="snapshots"):
        LakeReader(spark, f"{small}/orders.parquet").at(snapshot_id=1).read()
    stats = LakeReader(spark, f"{small}/nation.parquet").statistics("n_nationkey")
    assert stats["rows"] == 25 and stats["n_nationkey.max"] == 24 and stats["n_nationkey.nulls"] == 0


def test_connectors_say_what_is_missing(spark, tmp_path):
    for fmt in ("paimon", "hudi"):
        with pytest.raises(RuntimeError, match="connector"):
            scan(spark, ScanSpec(str(tmp_path), fmt))


def test_files_and_sinks(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 2 AS p")
    assert sink(df, SinkSpec("file", f"{tmp_path}/o", "orc", partition_by=("p",))) == {"rows": 20}
    assert scan(spark, ScanSpec.from_uri(f"orc://{tmp_path}/o", partitions=(("p", 1),))).count() == 10
    assert sink(df, SinkSpec("arrow", f"file://{tmp_path}/a"))["rows"] == 20
    back = arrow_ipc.read(spark, f"{tmp_path}/a")
    assert sorted(values(back)) == sorted(values(df)) and scan(spark, ScanSpec.from_uri(f"arrow://{tmp_path}/a")).count() == 20
    sink(df, SinkSpec("memory", table="kept"))
    assert spark.table("kept").count() == 20
    with pytest.raises(ValueError):
        sink(df, SinkSpec("nowhere"))


def _iceberg(spark, root):
    """A table of two snapshots: ids 0-9, then 10-19 with a position delete of id 3."""
    for n, low in ((1, 0), (2, 10)):
        spark.range(low, low + 10).selectExpr("id", "concat('n', id) AS name").coalesce(1).write.parquet(f"{root}/data/{n}")
    import glob

    files = [glob.glob(f"{root}/data/{n}/*.parquet")[0] for n in (1, 2)]
    spark.createDataFrame([(files[0], 3)], "file_path string, pos long").coalesce(1).write.parquet(f"{root}/data/d")
    files.append(glob.glob(f"{root}/data/d/*.parquet")[0])
    pair = lambda t: {"type": "array", "items": {"type": "record", "name": "e", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": t}]}}
    data = {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "value_counts", "type": ["null", pair("long")]}, {"name": "null_value_counts", "type": ["null", pair("long")]}, {"name": "lower_bounds", "type": ["null", pair("bytes")]}, {"name": "upper_bounds", "type": ["null", pair("bytes")]}]}
    entry = {"type": "record", "name": "m", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "data_file", "type": data}]}
    eight = lambda n: n.to_bytes(8, "little", signed=True)

    def made(n, status, snapshot, content=0):
        low = (n - 1) * 10
        return {"status": status, "snapshot_id": snapshot, "data_file": {"content": content, "file_path": files[n - 1], "file_format": "PARQUET", "record_count": 10, "value_counts": [{"key": 1, "value": 10}], "null_value_counts": [{"key": 1, "value": 0}], "lower_bounds": [{"key": 1, "value": eight(low)}], "upper_bounds": [{"key": 1, "value": eight(low + 9)}]}}

    import json
    import os

    os.makedirs(f"{root}/metadata")
    lists = {"type": "record", "name": "l", "fields": [{"name": "manifest_path", "type": "string"}]}
    for snapshot, entries in ((100, [made(1, 1, 100)]), (200, [made(1, 0, 100), made(2, 1, 200), made(3, 1, 200, 1), made(1, 2, 50)])):
        open(f"{root}/metadata/m{snapshot}.avro", "wb").write(avro.write(entry, entries))
        open(f"{root}/metadata/l{snapshot}.avro", "wb").write(avro.write(lists, [{"manifest_path": f"{root}/metadata/m{snapshot}.avro"}], codec="null"))
    schema = {"schema-id": 0, "type": "struct", "fields": [{"id": 1, "name": "id", "type": "long", "required": True}, {"id": 2, "name": "name", "type": "string", "required": False}]}
    snapshots = [{"snapshot-id": s, "timestamp-ms": t, "parent-snapshot-id": p, "manifest-list": f"{root}/metadata/l{s}.avro", "summary": {"operation": "append"}} for s, t, p in ((100, 1_000_000, None), (200, 2_000_000, 100))]
    meta = {"format-version": 2, "schemas": [schema], "current-schema-id": 0, "current-snapshot-id": 200, "snapshots": snapshots, "refs": {"old": {"snapshot-id": 100, "type": "tag"}}, "properties": {"a": "b"}, "partition-specs": [{"spec-id": 0, "fields": []}]}
    json.dump(meta, open(f"{root}/metadata/v2.metadata.json", "w"))


def test_iceberg(spark, tmp_path):
    root = str(tmp_path / "t")
    _iceberg(spark, root)
    t = LakeReader(spark, root, "iceberg")
    assert sorted(r.id for r in t.read().collect()) == [i for i in range(20) if i != 3]
    assert t.at(snapshot_id=100).read().count() == 10 and t.at(tag="old").read().count() == 10 and t.at(as_of="1970-01-01T00:20:00").read().count() == 10
    assert sorted(r.id for r in t.between(100, 200).read().collect()) == list(range(10, 20))
    late = t.where(Predicate("id", "gt", ("12",)))
    assert late.read().count() == 7 and len([f for f in iceberg.planned_files(spark, root, late.spec.predicates)[1] if f["content"] == 0]) == 1
    assert t.metadata()["snapshots"][1]["parent"] == 100 and t.schema().names == ["id", "name"]
    for which in ({"snapshot_id": 7}, {"branch": "x"}, {"as_of": "1960-01-01"}):
        with pytest.raises(ValueError):
            t.at(**which).read()


def test_plans_are_checked(spark):
    df = spark.range(5)
    with pytest.raises(ValueError, match="cycle"):
        StagePlan([Node("a", "distinct", {}, ("b",)), Node("b", "distinct", {}, ("a",))]).order()
    with pytest.raises(ValueError, match="isn't there"):
        StagePlan([Node("a", "distinct", {}, ("z",))]).order()
    with pytest.raises(ValueError, match="no operator"):
        StagePlan([Node("a", "fly", {}, ())]).order()
    with pytest.raises(ValueError, match="one result"):
        StagePlan([Node("a", "table", {"df": df}), Node("b", "table", {"df": df})]).build(spark)
    plan = StagePlan([Node("u", "set_op", {"kind": "union_all"}, ("t", "f")), Node("t", "table", {"df": df}), Node("f", "filter", {"predicate": Col("id") > 2}, ("t",))])
    assert plan.build(spark).count() == 7 and plan.entries() == ["t"] and plan.exits() == ["u"]


def test_filter_and_project(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "i int, v int")
    assert values(project(filter_(df, Col("v") > 1), [Col("i"), Col("v") * 2], ["i", "w"])) == [(2, 10)]


def test_streaming_windows(spark, small, tmp_path):
    from brindle.streaming.windows import read_stream, run_available, sessions, windowed

    events = spark.read.parquet(f"{small}/events.parquet")
    batch = windowed(events, "ts", "1 day", [F.count("*").alias("n")], ["event_type"])
    assert batch.agg(F.sum("n")).first()[0] == events.count()
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = windowed(read_stream(spark, folder, events, 1), "ts", "1 day", [F.count("*").alias("n")], ["event_type"])
    run_available(stream, "daily", str(tmp_path / "cp"), "complete")
    assert sorted(values(spark.table("daily"))) == sorted(values(batch))
    assert sessions(events, "ts", "1 hour", [F.count("*").alias("n")], ["user_id"]).agg(F.sum("n")).first()[0] == events.count()


def test_yaml_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("# x\nspark:\n  sql:\n    a: 1 # one\n  b: 'two'\nother: 3\n")
    assert settings_from_yaml(p) == {"spark.sql.a": "1", "spark.b": "two", "other": "3"}


def test_pipelines(spark):
    from brindle.plans.pipeline import SKIPPED, Pipeline, Task

    tasks = [
        Task("count", lambda df: df.count(), ("made",), "high"),
        Task("made", lambda: spark.range(10)),
        Task("large", lambda n: "large", ("count",), when=lambda n: n > 100),
        Task("small", lambda n: "small", ("count",), when=lambda n: n <= 100),
        Task("after", lambda x: x, ("large",)),
    ]
    got = Pipeline(tasks).run(spark)
    assert got["count"] == 10 and got["small"] == "small" and got["large"] is SKIPPED and got["after"] is SKIPPED
    assert Pipeline(tasks).order()[:2] == ["made", "count"]
    with pytest.raises(ValueError, match="cycle"):
        Pipeline([Task("a", int, ("b",)), Task("b", int, ("a",))])
    with pytest.raises(ZeroDivisionError):
        Pipeline([Task("a", lambda: 1 / 0)]).run(spark)


def test_salted_aggregates_of_distinct_values_and_odd_columns(spark):
    df = spark.range(200).selectExpr("id % 2 AS k", "id % 5 AS v", "map('a', id) AS m", "7 AS _salt").repartition(6)
    got = values(salted_aggregate(df, ["k"], [Agg("count", "v", "n", distinct=True), Agg("sum", "v", "s", distinct=True), Agg("avg", "v", "a", distinct=True), Agg("count", None, "rows"), Agg("max", "_salt", "hi")]).orderBy("k"))
    assert got == [(0, 5, 10, 2.0, 100, 7), (1, 5, 10, 2.0, 100, 7)]
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], [Agg("count", "v", "n", distinct=True), Agg("count", "_salt", "o", distinct=True)])


def test_exact_percentile_in_two_steps(spark):
    df = spark.range(30_000).selectExpr("id % 3 AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 7919) % 30011 / 3.0 END AS v").union(spark.createDataFrame([(9, 1.0), (9, 4.0), (8, None)], "k long, v double"))
    for share in (0.0, 0.013, 0.5, 0.9, 1.0):
        want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.lit(share)).alias("p")).collect() if r.p is not None}
        got = {r.k: r.p for r in exact_percentile(df, ["k"], "v", share, "p", 1000).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_custom_aggregate_merges_states(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", None), ("a", 5.0), (None, 1.0), ("b", None)], "k string, v double").repartition(4)
    spread = PartialAggregate(lambda x: (x.min(), x.max()), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda t: t[1] - t[0])
    assert {r.k: r.s for r in custom_aggregate(df, ["k"], "v", spread, "s").collect()} == {"a": 2.0, None: 0.0, "b": None}
    assert custom_aggregate(df.limit(0), ["k"], "v", spread, "s").collect() == []


def test_iceberg_append(spark, tmp_path):
    root, t = str(tmp_path / "t"), LakeReader(spark, str(tmp_path / "t"), "iceberg")
    first = iceberg.append(spark.range(10).selectExpr("id", "concat('n', id) AS name"), root, tag="old", at_ms=1000)
    second = iceberg.append(spark.range(10, 30).selectExpr("id", "CAST(NULL AS string) AS name"), root)
    assert t.read().count() == 30 and t.at(snapshot_id=first).read().count() == 10 and t.at(tag="old").read().count() == 10
    assert sorted(r.id for r in t.between(first, second).read().collect()) == list(range(10, 30))
    late = (Predicate("id", "gt", ("15",)),)
    assert len(iceberg.planned_files(spark, root, (Predicate("name", "is_not_null", ()),))[1]) < len(iceberg.planned_files(spark, root)[1]) and scan(spark, ScanSpec(root, "iceberg", predicates=late)).count() == 14
    with pytest.raises(ValueError):
        iceberg.append(spark.range(3), root)


def test_network_sink_counts_and_bitmaps_have_complements(spark):
    got = spark.sparkContext.accumulator(0)

    def send(rows):
        for r in rows:
            got.add(r.id)

    assert sink(spark.range(50), SinkSpec("network", send=send)) == {"rows": 50} and got.value == 1225
    df = spark.range(1, 70_000).withColumnRenamed("id", "at")
    odd = bitmap(df, "at", F.col("at") % 2 == 1)
    even = bitmap_not(odd, bitmap(df, "at", F.lit(True)))
    assert bitmap_size(even).first()[0] == 34_999 and bitmap_keep(df, "at", even).where("at % 2 = 1").count() == 0 and bitmap_keep(df, "at", even).count() == 34_999


def test_streams_take_files_in_order_of_time_whichever_was_written_first(spark, tmp_path):
    import os

    from brindle.catalogue.storage import _timed_by_name
    from brindle.streaming.windows import read_stream, run_to_files, windowed

    like = spark.sql("SELECT timestamp '2024-01-01' + make_interval(0, 0, 0, id) AS ts FROM range(9)")
    like.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    for i, f in enumerate(sorted((tmp_path / "in").glob("part-*"), reverse=True)):
        os.utime(f, (1.7e9 + i, 1.7e9 + i))
    _timed_by_name(spark, f"{tmp_path}/in")
    stream = windowed(read_stream(spark, f"{tmp_path}/in", like, 1), "ts", "1 day", [F.count("*").alias("n")], late="0 seconds")
    run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
