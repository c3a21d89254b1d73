"""Queries over sources, sinks, streams, plans and custom functions: each writes or builds what it needs, and the same in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, PartialAggregate
from ..functions.scalar import REGISTRY
from ..operators.aggregate import aggregate, custom_aggregate, exact_percentile, salted_aggregate
from ..operators.exchange import HASHES, exchange, shuffle_id
from ..operators.joins import join
from ..operators.metrics import fingerprint, measured, regressions, running, suggested_partitions
from ..operators.runs import bitmap, bitmap_keep, bitmap_not
from ..operators.windows import Frame, FrameFunction, WinFn, WinSpec, fold_frames, order, register_window, window
from ..plans.expressions import Aggregate, Call, Case, Cast, Col, Lit, columns, contains_aggregate, depth, infer, transform
from ..plans.pipeline import SKIPPED, Pipeline, Task
from ..plans.stage import Node, StagePlan
from ..session import settings_from_yaml
from ..sources import iceberg
from ..sources.lake import LakeReader, ScanSpec, scan
from ..sources.predicates import Predicate
from ..sources.shared import scratch
from ..sources.sinks import SinkSpec, sink
from ..streaming.windows import read_stream, run_to_files, sessions, windowed
from .relational import query, table

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _orders(s, d):
    return table(s, d, "orders", *_ORDERS)


# files


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")
def orc_round_trip(s, d):
    """Written as ORC and read with a predicate that reaches the files."""
    at = scratch(s, "orc")
    sink(_orders(s, d), SinkSpec("file", at, format="orc"))
    return scan(s, ScanSpec.from_uri(f"orc://{at}", columns=_ORDERS, predicates=(Predicate("o_totalprice", "gt", ("100000",)),)))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def arrow_round_trip(s, d):
    at = scratch(s, "arrow")
    sink(_orders(s, d), SinkSpec("arrow", at if "://" in at else f"file://{at}"))
    return scan(s, ScanSpec(at, "arrow")).select(*_ORDERS)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sink_partitioned_file(s, d):
    at = scratch(s, "partitioned")
    sink(_orders(s, d), SinkSpec("file", at, partition_by=("o_orderstatus",)))
    return aggregate(LakeReader(s, at).partition("o_orderstatus", "F").read(), ["o_orderstatus"], [Agg("count", None, "n")])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def sink_memory(s, d):
    sink(table(s, d, "nation"), SinkSpec("memory", table="kept_nations"))
    return s.table("kept_nations").where("n_regionkey = 2").select("n_nationkey", "n_name")


@query("SELECT count(*) AS rows, 1 AS again FROM customer")
def sink_counts(s, d):
    """The sink's own count of rows, and whether the file holds as many."""
    at = scratch(s, "counted")
    said = sink(table(s, d, "customer"), SinkSpec("file", at))["rows"]
    return s.read.parquet(at).agg(F.count("*").alias("rows")).withColumn("again", (F.col("rows") == said).cast("int"))


@query("SELECT count(*) AS sent, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation")
def sink_network(s, d):
    """Each partition sends its rows; the receivers' accumulators hold what arrived."""
    sent, keys = s.sparkContext.accumulator(0), s.sparkContext.accumulator(0)

    def send(rows):
        for r in rows:
            sent.add(1)
            keys.add(r.n_nationkey)

    sink(table(s, d, "nation"), SinkSpec("network", send=send))
    return s.createDataFrame([(sent.value, keys.value)], "sent long, keys long")


@query("SELECT count(*) AS rows, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) - count(o_custkey) AS nulls FROM orders")
def source_statistics(s, d):
    got = LakeReader(s, f"{d}/orders.parquet").statistics("o_totalprice", "o_custkey")
    return s.createDataFrame([(got["rows"], got["o_totalprice.min"], got["o_totalprice.max"], got["o_custkey.nulls"])], "rows long, low double, high double, nulls long")


@query("SELECT * FROM (VALUES ('r_name', 'string'), ('r_regionkey', 'int')) t(name, kind)")
def source_schema(s, d):
    return s.createDataFrame([(f.name, f.dataType.simpleString()) for f in LakeReader(s, f"{d}/region.parquet").metadata()["schema"]], "name string, kind string")


@query("SELECT n_nationkey FROM nation")
def incremental_files(s, d):
    """Files by their time of change: all since long ago, none before it."""
    at = scratch(s, "changed")
    table(s, d, "nation", "n_nationkey").write.parquet(at)
    since = LakeReader(s, at).between("2000-01-01T00:00:00").read()
    until = s.read.schema(since.schema).option("modifiedBefore", "2000-01-01T00:00:00").parquet(at)
    return since.union(until)


# Iceberg: two snapshots, early and late orders


def _lake(s, d) -> tuple[LakeReader, int, int]:
    at, rows = scratch(s, "iceberg"), _orders(s, d)
    first = iceberg.append(rows.where("o_orderkey % 3 = 0"), at, tag="early", at_ms=1_000_000)
    second = iceberg.append(rows.where("o_orderkey % 3 = 1"), at, at_ms=2_000_000)
    return LakeReader(s, at, "iceberg"), first, second


_THIRD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 ="


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 < 2 AND o_totalprice > 150000")
def iceberg_scan(s, d):
    return _lake(s, d)[0].where(Predicate("o_totalprice", "gt", ("150000",))).select("o_orderkey", "o_totalprice").read()


@query(f"{_THIRD} 0")
def iceberg_snapshot(s, d):
    lake, first, _ = _lake(s, d)
    return lake.at(snapshot_id=first).read()


@query(f"{_THIRD} 0")
def iceberg_as_of(s, d):
    return _lake(s, d)[0].at(as_of="1970-01-01T00:20:00").read()


@query(f"{_THIRD} 0")
def iceberg_tag(s, d):
    return _lake(s, d)[0].at(tag="early").read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 < 2")
def iceberg_branch(s, d):
    return _lake(s, d)[0].at(branch="main").read()


@query(f"{_THIRD} 1")
def iceberg_increment(s, d):
    lake, first, second = _lake(s, d)
    return lake.between(first, second).read()


@query("SELECT * FROM (VALUES (0, 'append', 1000000::BIGINT, FALSE), (1, 'append', 2000000::BIGINT, TRUE)) t(number, operation, ms, follows)")
def iceberg_metadata(s, d):
    lake, first, _ = _lake(s, d)
    found = lake.metadata()["snapshots"]
    return s.createDataFrame([(i, x["operation"], x["timestamp_ms"], x["parent"] == first) for i, x in enumerate(found)], "number int, operation string, ms long, follows boolean")


# custom functions


@query("SELECT l_returnflag, round(sqrt(sum(l_quantity * l_quantity) / count(*)), 6) AS level FROM lineitem GROUP BY 1")
def agg_custom_states(s, d):
    """A caller's aggregate by states: the root of the mean square."""
    level = PartialAggregate(lambda x: (float((x * x).sum()), len(x)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda t: (t[0] / t[1]) ** 0.5)
    return custom_aggregate(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", level, "level").withColumn("level", F.round("level", 6))


@query("SELECT o_orderkey, round(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 6) AS span FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def win_custom(s, d):
    """A caller's window function, of the frames of many rows at once."""

    def span(x, starts, ends):
        return fold_frames(np.fmax, x, starts, ends) - fold_frames(np.fmin, x, starts, ends)

    register_window("span_of_values", FrameFunction(span))
    spec = WinSpec(("o_custkey",), order("o_orderkey"), Frame("rows", -2, 0))
    return window(_orders(s, d), [WinFn("span_of_values", ("o_totalprice",), "span", spec)]).select("o_orderkey", F.round("span", 6).alias("span"))


@query("SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS p FROM orders GROUP BY 1")
def agg_percentile_in_two_steps(s, d):
    return exact_percentile(_orders(s, d), ["o_orderstatus"], "o_totalprice", 0.9, "p").withColumn("p", F.round("p", 4))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_suppkey) AS BIGINT) AS keys, round(avg(DISTINCT l_suppkey), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1")
def skew_salted_distinct(s, d):
    aggs = [Agg("count", "l_suppkey", "suppliers", distinct=True), Agg("sum", "l_suppkey", "keys", distinct=True), Agg("avg", "l_suppkey", "mean", distinct=True), Agg("count", None, "n")]
    return salted_aggregate(table(s, d, "lineitem"), ["l_returnflag"], aggs).withColumn("mean", F.round("mean", 6))


@query("SELECT 1 AS near")
def fn_current_time(s, d):
    """The time of day against the current timestamp's."""
    now = REGISTRY.call("current_time", [], [])
    seconds = F.unix_timestamp(F.concat(F.lit("1970-01-01 "), F.substring(now.cast("string"), 1, 8)))
    gap = F.abs(seconds - F.pmod(F.unix_timestamp(F.current_timestamp()), F.lit(86400)))
    return s.range(1).select((F.least(gap, 86400 - gap) < 5).cast("int").alias("near"))


# exchange


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def exchange_broadcast_join(s, d):
    """The broadcast side reaches every partition of the other, which isn't shuffled."""
    return join(table(s, d, "customer"), exchange(table(s, d, "nation"), "broadcast"), ["c_nationkey"], ["n_nationkey"]).select("c_custkey", "n_name")


@query("SELECT h AS hash, count(DISTINCT o_custkey) AS keys, 0 AS split, 0 AS outside FROM orders, (VALUES ('simple'), ('murmur3'), ('city'), ('xx')) t(h) GROUP BY 1")
def shuffle_hashes(s, d):
    """For each hash function: keys, keys in several partitions, ids that aren't partitions."""
    rows = _orders(s, d)
    dealt = [rows.select(F.lit(h).alias("hash"), "o_custkey", shuffle_id(["o_custkey"], 16, h).alias("p")) for h in HASHES]
    every = dealt[0].union(dealt[1]).union(dealt[2]).union(dealt[3])
    keys = every.groupBy("hash", "o_custkey").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    return keys.groupBy("hash").agg(F.count("*").alias("keys"), F.count_if(F.expr("a <> b")).cast("int").alias("split"), F.count_if(F.expr("a < 0 or b > 15")).cast("int").alias("outside"))


@query("SELECT count(*) AS n, 1 AS even FROM orders")
def shuffle_round(s, d):
    """Without keys rows go round the partitions."""
    counts = _orders(s, d).repartition(1).select(shuffle_id([], 4).alias("p")).groupBy("p").count()
    return counts.agg(F.sum("count").alias("n"), (F.max("count") - F.min("count") <= 1).cast("int").alias("even"))


@query("SELECT 6 AS parts, count(*) AS n, 0 AS split FROM orders")
def repart_hash_parts(s, d):
    """The partitions that a hash exchange makes: none but 6, and no key in two."""
    rows = exchange(_orders(s, d), "hash", ["o_custkey"], 6).withColumn("p", F.spark_partition_id())
    keys = rows.groupBy("o_custkey").agg(F.count("*").alias("c"), F.min("p").alias("a"), F.max("p").alias("b"))
    return keys.agg((F.max("b") + 1).alias("parts"), F.sum("c").alias("n"), F.count_if(F.expr("a <> b")).cast("int").alias("split"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_totalprice > 100000)")
def bitmap_not_and_keep(s, d):
    df = _orders(s, d).withColumn("at", F.col("o_orderkey") + 1)
    cheap = bitmap_not(bitmap(df, "at", F.col("o_totalprice") > 100000), bitmap(df, "at", F.lit(True)))
    return bitmap_keep(df, "at", cheap).select("o_orderkey", "o_orderstatus")


# expressions


@query("SELECT * FROM (VALUES ('sum', 'double'), ('case', 'string'), ('cast', 'int'), ('call', 'string'), ('compare', 'boolean'), ('quotient', 'bigint')) t(expr, kind)")
def expr_types(s, d):
    df = _orders(s, d)
    made = {
        "sum": Col("o_totalprice") + Lit(1), "case": Case(((Col("o_orderkey") > 3, Lit("a")),), Lit("b")), "cast": Cast(Col("o_totalprice"), "int"),
        "call": Call("upper", (Col("o_orderstatus"),)), "compare": Col("o_custkey") > 2, "quotient": Col("o_orderkey") / Col("o_custkey"),
    }
    return s.createDataFrame([(k, infer(e, df).simpleString()) for k, e in made.items()], "expr string, kind string")


@query("SELECT 'o_custkey,o_totalprice' AS reads, 4 AS depth, TRUE AS aggregate, (SELECT round(sum(o_totalprice * 2 + o_custkey), 2) FROM orders) AS total")
def expr_visitors(s, d):
    """What visitors say of an expression, and its value after a rewriting of its literals."""
    e = Aggregate("sum", (Col("o_totalprice") * Lit(1)) + Col("o_custkey"))
    doubled = transform(e, lambda x: Lit(x.value * 2) if isinstance(x, Lit) else x)
    got = aggregate(_orders(s, d), (), [Agg("sum", doubled.value, "total")])
    return got.select(F.lit(",".join(sorted(columns(e)))).alias("reads"), F.lit(depth(e)).alias("depth"), F.lit(contains_aggregate(e)).alias("aggregate"), F.round("total", 2).alias("total"))


# plans, pipelines, metrics


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > n_regionkey * 2000")
def stage_join_condition(s, d):
    return StagePlan([
        Node("suppliers", "scan", {"path": f"{d}/supplier.parquet"}),
        Node("nations", "scan", {"path": f"{d}/nation.parquet"}),
        Node("join", "join_on", {"condition": "s_nationkey < n_nationkey AND s_acctbal > n_regionkey * 2000"}, ("suppliers", "nations")),
        Node("columns", "project", {"exprs": [Col("s_suppkey"), Col("n_nationkey")]}, ("join",)),
    ]).build(s)


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey % 2 = 1 GROUP BY 1")
def stage_custom_task(s, d):
    return StagePlan([
        Node("nations", "scan", {"path": f"{d}/nation.parquet"}),
        Node("odd", "custom", {"run": lambda df: df.where("n_nationkey % 2 = 1")}, ("nations",)),
        Node("group", "aggregate", {"keys": ["n_regionkey"], "aggs": [Agg("count", None, "n")]}, ("odd",)),
    ]).build(s)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def stage_sink(s, d):
    at = scratch(s, "stage")
    StagePlan([
        Node("orders", "scan", {"path": f"{d}/orders.parquet"}),
        Node("dear", "filter", {"predicate": Col("o_totalprice") > 150000.0}, ("orders",)),
        Node("out", "sink", {"kind": "file", "path": at}, ("dear",)),
    ]).build(s)
    return aggregate(s.read.parquet(at), ["o_orderstatus"], [Agg("count", None, "n")])


@query("SELECT n_name, customers FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey")
def pipeline_of_tasks(s, d):
    """Two tasks side by side, one that needs both, and one whose condition doesn't hold."""
    done = Pipeline([
        Task("nations", lambda: table(s, d, "nation", "n_nationkey", "n_name"), priority="high"),
        Task("counts", lambda: aggregate(table(s, d, "customer"), ["c_nationkey"], [Agg("count", None, "customers")])),
        Task("joined", lambda n, c: join(c, n, ["c_nationkey"], ["n_nationkey"]), ("nations", "counts"), "critical"),
        Task("never", lambda df: df, ("joined",), when=lambda df: "absent" in df.columns),
    ]).run(s)
    if done["never"] is not SKIPPED:
        raise AssertionError("the conditional task ran")
    return done["joined"].select("n_name", "customers")


@query("SELECT count(*) AS rows_in, count(*) FILTER (WHERE o_totalprice > 150000) AS rows_out, round(count(*) FILTER (WHERE o_totalprice > 150000) / count(*), 6) AS selectivity FROM orders")
def operator_metrics(s, d):
    seen = measured(_orders(s, d), lambda df: df.where("o_totalprice > 150000"))
    seen.result.write.format("noop").mode("overwrite").save()
    got = seen.figures()
    return s.createDataFrame([(got["rows_in"], got["rows_out"], round(got["selectivity"], 6))], "rows_in long, rows_out long, selectivity double")


@query("SELECT TRUE AS same, FALSE AS other, 'slow' AS slower, 0 AS running, TRUE AS parts")
def plan_fingerprints(s, d):
    """Equal plans have equal fingerprints, timings are held against earlier ones, nothing runs now, and a size suggests partitions."""
    one, two = _orders(s, d).where("o_custkey > 3"), _orders(s, d).where("o_custkey > 3")
    slower = ",".join(regressions({"fast": 1.0, "slow": 1.0}, {"fast": 1.05, "slow": 1.5}))
    row = (fingerprint(one) == fingerprint(two), fingerprint(one) == fingerprint(two.where("o_custkey > 4")), slower, len(running(s)), suggested_partitions(one, 1 << 30) >= 1)
    return s.createDataFrame([row], "same boolean, other boolean, slower string, running int, parts boolean")


@query("SELECT * FROM (VALUES ('engine.threads', '4'), ('spark.sql.shuffle.partitions', '64')) t(name, value)")
def yaml_settings(s, d):
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:  # read on the driver alone
        path = Path(folder) / "settings.yaml"
        path.write_text("spark:\n  sql:\n    shuffle:\n      partitions: 64 # more\nengine:\n  threads: '4'\n", encoding="utf-8")
        return s.createDataFrame(sorted(settings_from_yaml(path).items()), "name string, value string")


# streams


def _timed_by_name(s, folder):
    """Gives a folder's files times in order of their names, as a stream takes the oldest file first and tasks end in any order."""
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    first = min((f.getModificationTime() for f in files), default=0)
    for i, f in enumerate(files):
        fs.setTimes(f.getPath(), first - 1000 * (len(files) - i), -1)


def _streamed(s, d, build):
    """A stream over the events' files in order of time, run to its end into files, and read back."""
    at, like = scratch(s, "stream"), table(s, d, "events")
    like.repartitionByRange(3, "ts").write.parquet(f"{at}/in")
    _timed_by_name(s, f"{at}/in")
    run_to_files(build(read_stream(s, f"{at}/in", like, 1)), f"{at}/out", f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out")


@query("SELECT event_id, value * 2 AS twice FROM events WHERE event_type = 'purchase'")
def stream_available_now(s, d):
    """All files that are there, in batches, to the end of the stream."""
    return _streamed(s, d, lambda e: e.where("event_type = 'purchase'").select("event_id", (F.col("value") * 2).alias("twice")))


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL '1 day', max(ts)) FROM events) GROUP BY 1, 2")
def stream_windows(s, d):
    """Daily counts with a watermark of nothing: every window but the last is closed."""
    got = _streamed(s, d, lambda e: windowed(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", [F.count("*").alias("n")], ["event_type"], late="0 seconds"))
    return got.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


_SESSIONS = """SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g"""


@query(_SESSIONS)
def session_windows(s, d):
    return sessions(table(s, d, "events"), "ts", "6 hours", [F.count("*").alias("n")], ["user_id"]).select("user_id", "window_start", "n")
