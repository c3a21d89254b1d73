"""A query for each operator and function, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, register_aggregate
from ..functions.scalar import REGISTRY
from ..operators.aggregate import aggregate, salted_aggregate
from ..operators.basic import distinct, distinct_stats, filter_, project
from ..operators.exchange import exchange, shuffle_id
from ..operators.joins import join, join_on, salted_join
from ..operators.ordering import Key, limit, sort, top_n
from ..operators.runs import bitmap, bitmap_and, bitmap_or, bitmap_size, run_aggregate, run_segments
from ..operators.sets import set_op
from ..operators.skew import heavy_keys
from ..operators.windows import Frame, WinFn, WinSpec, order, window
from ..plans.expressions import Aggregate, Arith, Array, Call, Case, Cast, Col, Compare, In, IsNull, Like, Lit, Not, Over, Struct, Subquery, to_column
from ..plans.stage import Node, StagePlan
from ..sources.lake import LakeReader, ScanSpec, scan
from ..sources.predicates import Predicate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str, *columns: str, where: tuple = ()) -> DataFrame:
    return scan(spark, ScanSpec(f"{d}/{name}.parquet", columns=columns, predicates=where))


def _named(df: DataFrame, exprs: dict) -> DataFrame:
    return project(df, list(exprs.values()), list(exprs))


def _gap(column: str, every: int):
    """The column with nulls put in, as no table has any."""
    return f"nullif({column} % {every}, 0)"


# scans and pushed predicates


@query("SELECT * FROM nation")
def scan_parquet(s, d):
    return table(s, d, "nation")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def scan_project_pushdown(s, d):
    return LakeReader(s, f"{d}/orders.parquet").where(Predicate("o_totalprice", "gt", ("250000",))).select("o_orderkey", "o_totalprice").read()


def _pushed(name: str, column: str, kind: str, values: tuple, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, "part", "p_partkey", column, where=(Predicate(column, kind, values),))

    QUERIES[name] = run
    SQL[name] = f"SELECT p_partkey, {column} FROM part WHERE {sql}"


_pushed("pred_eq", "p_size", "eq", ("7",), "p_size = 7")
_pushed("pred_gt", "p_retailprice", "gt", ("1500",), "p_retailprice > 1500")
_pushed("pred_lt", "p_size", "lt", ("9",), "p_size < 9")
_pushed("pred_ge", "p_size", "ge", ("49",), "p_size >= 49")
_pushed("pred_le", "p_size", "le", ("2",), "p_size <= 2")
_pushed("pred_between", "p_size", "between", ("10", "12"), "p_size BETWEEN 10 AND 12")
_pushed("pred_in", "p_size", "in", ("3", "5", "8"), "p_size IN (3, 5, 8)")
_pushed("pred_isnull", "p_name", "is_null", (), "p_name IS NULL")
_pushed("pred_isnotnull", "p_name", "is_not_null", (), "p_name IS NOT NULL")
_pushed("pred_like", "p_brand", "like", ("%1_",), "p_brand LIKE '%1_'")


# expressions


@query("SELECT c_custkey, c_acctbal + 1.5 AS plus, c_acctbal - 2.0 AS minus, c_acctbal * 3.0 AS times, c_acctbal / 4.0 AS over, c_custkey % 7 AS rest FROM customer")
def arith_all(s, d):
    df = table(s, d, "customer")
    b = Col("c_acctbal")
    return _named(df, {"c_custkey": Col("c_custkey"), "plus": b + 1.5, "minus": b - 2.0, "times": b * 3.0, "over": b / 4.0, "rest": Col("c_custkey") % 7})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey // (o_orderkey % 5) END AS ints, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / (o_orderkey % 5) END AS floats FROM orders")
def div_null_on_zero(s, d):
    by = Col("o_orderkey") % 5
    return _named(table(s, d, "orders"), {"o_orderkey": Col("o_orderkey"), "ints": Col("o_custkey") / by, "floats": Col("o_totalprice") / by})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN (-o_custkey) % (o_orderkey % 4) END AS rest FROM orders")
def mod_null_on_zero(s, d):
    return _named(table(s, d, "orders"), {"o_orderkey": Col("o_orderkey"), "rest": (Lit(0) - Col("o_custkey")) % (Col("o_orderkey") % 4)})


@query("SELECT p_partkey, round(power(p_size, 1.5), 6) AS p FROM part")
def power(s, d):
    return _named(table(s, d, "part"), {"p_partkey": Col("p_partkey"), "p": F.round(to_column(Col("p_size") ** 1.5, table(s, d, "part")), 6)})


@query("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def cmp_all(s, d):
    v = Col("p_size")
    return _named(table(s, d, "part"), {"p_partkey": Col("p_partkey"), "eq": v.eq(10), "ne": v.ne(10), "lt": v < 10, "le": v <= 10, "gt": v > 10, "ge": v >= 10})


@query("SELECT o_orderkey, (a > 2 AND b > 1) AS both, (a > 2 OR b > 1) AS either, NOT (a > 2) AS no FROM (SELECT o_orderkey, nullif(o_orderkey % 5, 0) AS a, nullif(o_orderkey % 3, 0) AS b FROM orders)")
def logical_and_or_not(s, d):
    df = table(s, d, "orders").selectExpr("o_orderkey", f"{_gap('o_orderkey', 5)} AS a", f"{_gap('o_orderkey', 3)} AS b")
    a, b = Col("a") > 2, Col("b") > 1
    return _named(df, {"o_orderkey": Col("o_orderkey"), "both": a & b, "either": a | b, "no": ~a})


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A%'")
def not_like(s, d):
    return filter_(table(s, d, "part", "p_partkey", "p_type"), Like(Col("p_type"), "%A%", True))


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 2, 3)")
def not_in(s, d):
    return filter_(table(s, d, "part", "p_partkey", "p_size"), In(Col("p_size"), (1, 2, 3), True))


@query("SELECT p_partkey FROM part WHERE p_brand LIKE '%2%' AND p_size IN (4, 5, 6) AND nullif(p_partkey % 4, 0) IS NOT NULL")
def like_in_notnull(s, d):
    df = table(s, d, "part").withColumn("g", F.expr(_gap("p_partkey", 4)))
    return filter_(df, Like(Col("p_brand"), "%2%") & In(Col("p_size"), (4, 5, 6)) & IsNull(Col("g"), True)).select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN g > 3 THEN 'high' WHEN g > 1 THEN 'mid' ELSE 'other' END AS band FROM (SELECT o_orderkey, nullif(o_orderkey % 6, 0) AS g FROM orders)")
def case_when(s, d):
    df = table(s, d, "orders").selectExpr("o_orderkey", f"{_gap('o_orderkey', 6)} AS g")
    return _named(df, {"o_orderkey": Col("o_orderkey"), "band": Case(((Col("g") > 3, Lit("high")), (Col("g") > 1, Lit("mid"))), Lit("other"))})


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE o_orderkey::VARCHAR END AS BIGINT) AS n FROM orders")
def cast_try(s, d):
    text = Case(((Arith("%", Col("o_orderkey"), Lit(2)).eq(0), Lit("x")),), Cast(Col("o_orderkey"), "utf8"))
    return _named(table(s, d, "orders"), {"o_orderkey": Col("o_orderkey"), "n": Cast(text, "int64")})


@query("SELECT n_nationkey, [n_nationkey, n_regionkey] AS pair FROM nation")
def array_ctor(s, d):
    return _named(table(s, d, "nation"), {"n_nationkey": Col("n_nationkey"), "pair": Array((Col("n_nationkey"), Col("n_regionkey")))})


@query("SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, {'a': n_regionkey, 'b': n_name} AS s FROM nation)")
def struct_ctor(s, d):
    df = _named(table(s, d, "nation"), {"n_nationkey": Col("n_nationkey"), "s": Struct((("a", Col("n_regionkey")), ("b", Col("n_name"))))})
    return df.select("n_nationkey", "s.a", "s.b")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_subquery(s, d):
    mean = aggregate(table(s, d, "customer"), (), [Agg("avg", "c_acctbal", "m")])
    return filter_(table(s, d, "customer", "c_custkey", "c_acctbal"), Compare(">", Col("c_acctbal"), Subquery(mean)))


@query("SELECT n_regionkey, count(*) AS n, max(n_nationkey) AS top FROM nation GROUP BY 1")
def expr_aggregate(s, d):
    df = table(s, d, "nation")
    return df.groupBy("n_regionkey").agg(to_column(Aggregate("count"), df).alias("n"), to_column(Aggregate("max", Col("n_nationkey")), df).alias("top"))


@query("SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS rn FROM nation")
def expr_window(s, d):
    over = Over("row_number", (), WinSpec(("n_regionkey",), order("n_name")))
    return _named(table(s, d, "nation"), {"n_nationkey": Col("n_nationkey"), "rn": Cast(over, "int64")})


# scalar functions


@query("""SELECT c_custkey, abs(c_acctbal) AS f_abs, round(sqrt(abs(c_acctbal)), 6) AS f_sqrt, round(sin(c_acctbal), 6) AS f_sin, round(cos(c_acctbal), 6) AS f_cos,
round(exp(c_acctbal / 10000), 6) AS f_exp, round(ln(abs(c_acctbal) + 1), 6) AS f_ln FROM customer""")
def fn_math(s, d):
    df = table(s, d, "customer")
    b = Col("c_acctbal")
    far = lambda e: F.round(to_column(e, df), 6)
    return _named(df, {"c_custkey": Col("c_custkey"), "f_abs": Call("abs", (b,)), "f_sqrt": far(Call("sqrt", (Call("abs", (b,)),))), "f_sin": far(Call("sin", (b,))), "f_cos": far(Call("cos", (b,))), "f_exp": far(Call("exp", (b / 10000,))), "f_ln": far(Call("ln", (Call("abs", (b,)) + 1.0,)))})


@query("""SELECT c_custkey, c_name || '-' || c_mktsegment AS f_concat, substring(c_name, 2, 4) AS f_sub, CAST(strlen(c_name) AS BIGINT) AS f_len, upper(c_name) AS f_upper,
lower(c_mktsegment) AS f_lower, trim('  ' || c_name || ' ') AS f_trim, replace(c_name, '0', 'o') AS f_replace, regexp_matches(c_name, '1[0-9]$') AS f_match FROM customer""")
def fn_string(s, d):
    n = Col("c_name")
    call = lambda f, *a: Call(f, a)
    return _named(table(s, d, "customer"), {
        "c_custkey": Col("c_custkey"), "f_concat": call("concat", n, "-", Col("c_mktsegment")), "f_sub": call("substring", n, 2, 4), "f_len": Cast(call("length", n), "int64"), "f_upper": call("upper", n),
        "f_lower": call("lower", Col("c_mktsegment")), "f_trim": call("trim", call("concat", "  ", n, " ")), "f_replace": call("replace", n, "0", "o"), "f_match": call("regex_match", n, "1[0-9]$"),
    })


@query("""SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS VARCHAR) AS f_add, CAST(CAST(CAST(o_orderdate AS DATE) - 3 AS DATE) AS VARCHAR) AS f_sub, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS f_diff,
CAST(year(o_orderdate) AS BIGINT) AS f_year, CAST(month(o_orderdate) AS BIGINT) AS f_month, CAST(day(o_orderdate) AS BIGINT) AS f_day, CAST(extract(dow FROM o_orderdate) AS BIGINT) AS f_dow, CAST(extract(doy FROM o_orderdate) AS BIGINT) AS f_doy,
strftime(o_orderdate, '%Y-%m-%d') AS f_iso, strftime(o_orderdate, '%m/%d/%Y') AS f_us, strftime(o_orderdate, '%d-%m-%Y') AS f_eu FROM orders""")
def fn_date(s, d):
    df = table(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    day = Col("day")
    part = lambda p: Cast(Call("extract", (p, day)), "int64")
    return _named(df, {
        "o_orderkey": Col("o_orderkey"), "f_add": Cast(Call("date_add", (day, 10)), "utf8"), "f_sub": Cast(Call("date_sub", (day, 3)), "utf8"), "f_diff": Cast(Call("date_diff", (Lit("1995-01-01", "date32"), day)), "int64"),
        "f_year": part("year"), "f_month": part("month"), "f_day": part("day"), "f_dow": part("dow"), "f_doy": part("doy"),
        "f_iso": Call("format_date", ("YYYY-MM-DD", day)), "f_us": Call("format_date", ("MM/DD/YYYY", day)), "f_eu": Call("format_date", ("DD-MM-YYYY", day)),
    })


@query("SELECT 1 AS one, true AS today, true AS now")
def fn_current(s, d):
    df = s.range(1)
    fresh = F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds(to_column(Call("current_timestamp"), df).cast("timestamp"))) < 5
    return df.select(F.lit(1).alias("one"), (to_column(Call("current_date"), df) == F.to_date(F.current_timestamp())).alias("today"), fresh.alias("now"))


@query("SELECT p_partkey, (p_size + 1) AS f_add, (p_size - 1) AS f_subtract, (p_size * 2) AS f_multiply, p_size = 3 AS f_equal, p_size <= 3 AS f_le, (p_size > 3 AND p_partkey > 9) AS f_and, NOT (p_size > 3) AS f_not FROM part")
def fn_registry(s, d):
    v = Col("p_size")
    call = lambda f, *a: Call(f, a)
    return _named(table(s, d, "part"), {
        "p_partkey": Col("p_partkey"), "f_add": call("add", v, 1), "f_subtract": call("subtract", v, 1), "f_multiply": call("multiply", v, 2), "f_equal": call("equal", v, 3), "f_le": call("less_than_or_equal", v, 3),
        "f_and": call("and", call("greater_than", v, 3), call("greater_than", Col("p_partkey"), 9)), "f_not": call("not", call("greater_than", v, 3)),
    })


@query("SELECT p_partkey, p_size * 2.0 + 1.0 AS y FROM part")
def fn_custom_udf(s, d):
    @F.pandas_udf("double")
    def line(x: pd.Series) -> pd.Series:
        return x * 2.0 + 1.0

    REGISTRY.register("line", lambda a, _: line(a[0]), 1)
    return _named(table(s, d, "part"), {"p_partkey": Col("p_partkey"), "y": Call("line", (Col("p_size"),))})


# aggregates

_ITEMS = "lineitem"


@query("SELECT l_returnflag, CAST(count(l_quantity) AS BIGINT) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def agg_sum_count_avg_min_max(s, d):
    got = aggregate(table(s, d, _ITEMS), ["l_returnflag"], [Agg("count", "l_quantity", "n"), Agg("sum", "l_quantity", "s"), Agg("avg", "l_quantity", "a"), Agg("min", "l_quantity", "lo"), Agg("max", "l_quantity", "hi")])
    return got.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


@query("SELECT k, count(*) AS n_rows, count(g) AS n_values, avg(g) AS a, min(g) AS lo FROM (SELECT o_orderkey % 3 AS k, nullif(o_orderkey % 7, 0) AS g FROM orders) GROUP BY 1")
def agg_nulls(s, d):
    df = table(s, d, "orders").selectExpr("o_orderkey % 3 AS k", f"{_gap('o_orderkey', 7)} AS g")
    return aggregate(df, ["k"], [Agg("count", "g", "n_rows", include_nulls=True), Agg("count", "g", "n_values"), Agg("avg", "g", "a"), Agg("min", "g", "lo")])


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def agg_count_distinct(s, d):
    return aggregate(table(s, d, _ITEMS), ["l_returnflag"], [Agg("count_distinct", "l_suppkey", "n")])


@query("SELECT o_custkey, round(CASE WHEN count(o_totalprice) > 1 THEN var_pop(o_totalprice) END / 1e6, 2) AS v, round(CASE WHEN count(o_totalprice) > 1 THEN stddev_pop(o_totalprice) END, 4) AS sd FROM orders GROUP BY 1")
def agg_var_std_pop(s, d):
    got = aggregate(table(s, d, "orders"), ["o_custkey"], [Agg("variance", "o_totalprice", "v"), Agg("stddev", "o_totalprice", "sd")])
    return got.withColumns({"v": F.round(F.col("v") / 1e6, 2), "sd": F.round("sd", 4)})


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS f, arg_max(o_orderstatus, o_orderkey) AS l FROM orders GROUP BY 1")
def agg_first_last(s, d):
    return aggregate(table(s, d, "orders"), ["o_custkey"], [Agg("first", "o_orderstatus", "f", order_by="o_orderkey"), Agg("last", "o_orderstatus", "l", order_by="o_orderkey")])


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_concat(s, d):
    return aggregate(table(s, d, "nation"), ["n_regionkey"], [Agg("concat", "n_name", "names", order_by="n_name")])


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def agg_array(s, d):
    return aggregate(table(s, d, "nation"), ["n_regionkey"], [Agg("array_agg", "n_nationkey", "keys", order_by="n_nationkey")])


@query("SELECT o_orderstatus, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x FROM orders GROUP BY 1")
def agg_bitwise(s, d):
    return aggregate(table(s, d, "orders"), ["o_orderstatus"], [Agg("bit_and", "o_orderkey", "a"), Agg("bit_or", "o_orderkey", "o"), Agg("bit_xor", "o_orderkey", "x")])


@query("SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 2) AS g, round(count(o_totalprice) / sum(1 / o_totalprice), 2) AS h FROM orders GROUP BY 1")
def agg_geo_harm_mean(s, d):
    got = aggregate(table(s, d, "orders"), ["o_orderstatus"], [Agg("geometric_mean", "o_totalprice", "g"), Agg("harmonic_mean", "o_totalprice", "h")])
    return got.withColumns({"g": F.round("g", 2), "h": F.round("h", 2)})


@query("SELECT o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY 1")
def agg_median(s, d):
    return aggregate(table(s, d, "orders"), ["o_orderstatus"], [Agg("median", "o_totalprice", "m")])


@query("SELECT p_brand, p_size AS m FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1")
def agg_mode(s, d):
    return aggregate(table(s, d, "part"), ["p_brand"], [Agg("mode", "p_size", "m")])


@query("SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS p FROM orders GROUP BY 1")
def agg_percentile(s, d):
    return aggregate(table(s, d, "orders"), ["o_orderstatus"], [Agg("percentile", "o_totalprice", "p", arg=0.9)]).withColumn("p", F.round("p", 4))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_orderkey) AS hi FROM lineitem")
def agg_global(s, d):
    return aggregate(table(s, d, _ITEMS), (), [Agg("count", None, "n"), Agg("sum", "l_linenumber", "s"), Agg("max", "l_orderkey", "hi")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem GROUP BY 1, 2")
def agg_multi_key(s, d):
    revenue = Col("l_extendedprice") * (Lit(1) - Col("l_discount"))
    return aggregate(table(s, d, _ITEMS), ["l_returnflag", "l_linestatus"], [Agg("count", None, "n"), Agg("sum", revenue, "revenue")]).withColumn("revenue", F.round("revenue", 0))


@query("SELECT l_returnflag, round(max(l_quantity) - min(l_quantity), 4) AS spread FROM lineitem GROUP BY 1")
def agg_custom_udaf(s, d):
    register_aggregate("spread", lambda x: F.max(x) - F.min(x))
    return aggregate(table(s, d, _ITEMS), ["l_returnflag"], [Agg("spread", "l_quantity", "spread")])


@query("SELECT n_regionkey, list(DISTINCT n_nationkey % 3 ORDER BY n_nationkey % 3) AS kinds FROM nation GROUP BY 1")
def agg_collect_set(s, d):
    return aggregate(table(s, d, "nation"), ["n_regionkey"], [Agg("collect_set", Col("n_nationkey") % 3, "kinds")])


# joins

_FEW = "(SELECT * FROM customer WHERE c_acctbal > 5000) c"


def _few(s, d):
    return table(s, d, "customer", "c_custkey", "c_nationkey", where=(Predicate("c_acctbal", "gt", ("5000",)),))


def _some(s, d):
    return table(s, d, "orders", "o_orderkey", "o_custkey", where=(Predicate("o_totalprice", "gt", ("200000",)),))


_SOME = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) o"


def _joined(name: str, how: str, sql_how: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return join(_few(s, d), _some(s, d), ["c_custkey"], ["o_custkey"], how).select("c_custkey", "c_nationkey", "o_orderkey")

    QUERIES[name] = run
    SQL[name] = f"SELECT c_custkey, c_nationkey, o_orderkey FROM {_FEW} {sql_how} JOIN {_SOME} ON c_custkey = o_custkey"


_joined("join_inner", "inner", "INNER")
_joined("join_left", "left", "LEFT")
_joined("join_right", "right", "RIGHT")
_joined("join_full", "full", "FULL")


@query(f"SELECT c_custkey, c_nationkey FROM {_FEW} WHERE EXISTS (SELECT 1 FROM {_SOME} WHERE o_custkey = c_custkey)")
def join_semi(s, d):
    return join(_few(s, d), _some(s, d), ["c_custkey"], ["o_custkey"], "semi")


@query(f"SELECT c_custkey, c_nationkey FROM {_FEW} WHERE NOT EXISTS (SELECT 1 FROM {_SOME} WHERE o_custkey = c_custkey)")
def join_anti(s, d):
    return join(_few(s, d), _some(s, d), ["c_custkey"], ["o_custkey"], "anti")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_orderkey AS k, l_suppkey AS p FROM lineitem WHERE l_quantity > 45) x ON l_orderkey = k AND l_suppkey = p GROUP BY 1, 2")
def join_multikey(s, d):
    right = table(s, d, _ITEMS, "l_orderkey", "l_suppkey", where=(Predicate("l_quantity", "gt", ("45",)),)).distinct().toDF("k", "p")
    return aggregate(join(table(s, d, _ITEMS), right, ["l_orderkey", "l_suppkey"], ["k", "p"]), ["l_orderkey", "l_suppkey"], [Agg("count", None, "n")])


@query("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM (SELECT n_nationkey, nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 0) AS j FROM region) b ON k IS NOT DISTINCT FROM j")
def join_nullsafe(s, d):
    left = table(s, d, "nation").selectExpr("n_nationkey AS x", "nullif(n_regionkey, 0) AS k")
    right = table(s, d, "region").selectExpr("r_regionkey AS y", "nullif(r_regionkey, 0) AS j")
    return join(left, right, ["k"], ["j"], null_safe=True).select("x", "y")


@query("SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a JOIN supplier b ON b.s_nationkey < a.n_nationkey AND b.s_acctbal > a.n_regionkey * 2000")
def join_theta_nl(s, d):
    left, right = table(s, d, "nation"), table(s, d, "supplier")
    return join_on(left, right, "s_nationkey < n_nationkey AND s_acctbal > n_regionkey * 2000").select(F.col("n_nationkey").alias("x"), F.col("s_suppkey").alias("y"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(s, d):
    return join(table(s, d, "customer"), table(s, d, "nation"), ["c_nationkey"], ["n_nationkey"], strategy="broadcast").select("c_custkey", "n_name")


@query("SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_shuffle_hash(s, d):
    return aggregate(join(table(s, d, "orders"), table(s, d, "customer"), ["o_custkey"], ["c_custkey"], strategy="shuffle_hash"), ["o_orderstatus"], [Agg("count", None, "n")])


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_salted(s, d):
    left = table(s, d, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_custkey", "k")
    right = table(s, d, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "k")
    return aggregate(salted_join(left, right, "k"), ["c_mktsegment"], [Agg("count", None, "n")])


# order


@query("SELECT o_orderkey, g FROM (SELECT o_orderkey, nullif(o_orderkey % 4, 0) AS g FROM orders) ORDER BY g DESC NULLS FIRST, o_orderkey ASC NULLS LAST")
def sort_multi_nulls(s, d):
    df = table(s, d, "orders").selectExpr("o_orderkey", f"{_gap('o_orderkey', 4)} AS g")
    return sort(df, [Key("g", asc=False, nulls_first=True), Key("o_orderkey")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topn(s, d):
    return top_n(table(s, d, "orders", "o_orderkey", "o_totalprice"), [Key("o_totalprice", asc=False), Key("o_orderkey")], 25)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 40")
def limit_offset(s, d):
    return limit(sort(table(s, d, "orders", "o_orderkey", "o_custkey"), [Key("o_orderkey")]), 30, 40)


# windows

_BY = "PARTITION BY o_custkey ORDER BY o_orderkey"


def _orders_over(s, d, *functions: WinFn) -> DataFrame:
    df = window(table(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), functions)
    return df.select("o_orderkey", *[f.alias for f in functions])


def _by(frame: Frame | None = None, keys=("o_orderkey",)) -> WinSpec:
    return WinSpec(("o_custkey",), order(*keys), frame)


@query(f"SELECT o_orderkey, CAST(row_number() OVER ({_BY}) AS BIGINT) AS rn FROM orders")
def win_row_number(s, d):
    return _orders_over(s, d, WinFn("row_number", (), "rn", _by())).withColumn("rn", F.col("rn").cast("long"))


@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr FROM orders")
def win_rank_dense(s, d):
    spec = _by(keys=("o_orderstatus",))
    got = _orders_over(s, d, WinFn("rank", (), "r", spec), WinFn("dense_rank", (), "dr", spec))
    return got.withColumns({"r": F.col("r").cast("long"), "dr": F.col("dr").cast("long")})


@query(f"SELECT o_orderkey, percent_rank() OVER ({_BY}) AS pr, cume_dist() OVER ({_BY}) AS cd FROM orders")
def win_percent_cume(s, d):
    return _orders_over(s, d, WinFn("percent_rank", (), "pr", _by()), WinFn("cume_dist", (), "cd", _by()))


@query(f"SELECT o_orderkey, lead(o_totalprice, 2, -1.0) OVER ({_BY}) AS ahead, lag(o_totalprice, 1) OVER ({_BY}) AS back FROM orders")
def win_lead_lag(s, d):
    return _orders_over(s, d, WinFn("lead", ("o_totalprice", Lit(2), Lit(-1.0)), "ahead", _by()), WinFn("lag", ("o_totalprice", Lit(1)), "back", _by()))


@query("""SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS n2 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last_nth(s, d):
    spec = _by(Frame("rows", None, None))
    return _orders_over(s, d, WinFn("first_value", ("o_totalprice",), "f", spec), WinFn("last_value", ("o_totalprice",), "l", spec), WinFn("nth_value", ("o_totalprice", Lit(2)), "n2", spec))


def _frame(name: str, frame: Frame, sql: str, key: str = "o_orderkey") -> None:
    functions = ("sum", "avg", "min", "max", "count")

    def run(s: SparkSession, d: str) -> DataFrame:
        got = _orders_over(s, d, *[WinFn(f, ("o_totalprice",), f"w_{f}", _by(frame, (key,))) for f in functions])
        return got.withColumns({"w_sum": F.round("w_sum", 6), "w_avg": F.round("w_avg", 6)})

    over = f"OVER (PARTITION BY o_custkey ORDER BY {key} {sql})"
    rounded = {"sum", "avg"}
    QUERIES[name] = run
    SQL[name] = "SELECT o_orderkey, " + ", ".join(f"round({f}(o_totalprice) {over}, 6) AS w_{f}" if f in rounded else f"{f}(o_totalprice) {over} AS w_{f}" for f in functions) + " FROM orders"


_frame("win_agg_rows", Frame("rows", -2, 1), "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING")
_frame("win_agg_range", Frame("range", -500, 500), "RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING")
_frame("win_agg_groups", Frame("groups", -1, 0), "GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW", "o_orderstatus")
_frame("win_agg_running", Frame("rows", None, 0), "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


# sets

_LOW, _HIGH = "SELECT o_custkey % 50 AS k FROM orders WHERE o_orderkey % 3 = 0", "SELECT o_custkey % 70 + 20 AS k FROM orders WHERE o_orderkey % 5 = 0"


def _set(name: str, kind: str, sql: str, mode: str = "sql") -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        o = table(s, d, "orders")
        return set_op(o.where("o_orderkey % 3 = 0").selectExpr("o_custkey % 50 AS k"), o.where("o_orderkey % 5 = 0").selectExpr("o_custkey % 70 + 20 AS k"), kind, mode)

    QUERIES[name] = run
    SQL[name] = sql


_set("union_all", "union_all", f"{_LOW} UNION ALL {_HIGH}")
_set("union_distinct", "union", f"{_LOW} UNION {_HIGH}")
_set("intersect", "intersect", f"{_LOW} INTERSECT {_HIGH}")
_set("except", "except", f"{_LOW} EXCEPT {_HIGH}")
_set("intersect_all", "intersect_all", f"{_LOW} INTERSECT ALL {_HIGH}")
_set("except_all", "except_all", f"{_LOW} EXCEPT ALL {_HIGH}")
_set("intersect_bag_left", "intersect", f"SELECT a.k FROM ({_LOW}) a WHERE EXISTS (SELECT 1 FROM ({_HIGH}) b WHERE b.k IS NOT DISTINCT FROM a.k)", "bag_left")
_set("except_bag_left", "except", f"SELECT a.k FROM ({_LOW}) a WHERE NOT EXISTS (SELECT 1 FROM ({_HIGH}) b WHERE b.k IS NOT DISTINCT FROM a.k)", "bag_left")


# distinct


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_all(s, d):
    return distinct(table(s, d, _ITEMS, "l_returnflag", "l_linestatus"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_on_cols(s, d):
    return distinct(table(s, d, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], [Key("o_orderkey")])


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, count(*) - count(DISTINCT o_custkey) AS n_duplicates FROM orders")
def distinct_stats_(s, d):
    return distinct_stats(table(s, d, "orders"), ["o_custkey"])


# exchange: the rows stay the same


def _dealt(name: str, strategy: str, keys: tuple = ()) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return exchange(table(s, d, "orders", "o_orderkey", "o_custkey"), strategy, keys, None if strategy == "single" else 6)

    QUERIES[name] = run
    SQL[name] = "SELECT o_orderkey, o_custkey FROM orders"


_dealt("repart_hash", "hash", ("o_custkey",))
_dealt("repart_range", "range", ("o_orderkey",))
_dealt("repart_rr", "round_robin")
_dealt("coalesce_single", "single")
_dealt("exchange_broadcast", "broadcast")


@query("SELECT 7 AS highest, 0 AS lowest, count(*) AS n FROM orders")
def shuffle_hash_id(s, d):
    df = table(s, d, "orders").select(shuffle_id(["o_custkey"], 8).alias("p"))
    return df.agg(F.max("p").alias("highest"), F.min("p").alias("lowest"), F.count("*").alias("n"))


# helpers


@query("SELECT l_linenumber, n, n / t AS share FROM (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1), (SELECT count(*) AS t FROM lineitem) WHERE n > 0.1 * t")
def skew_heavy_keys(s, d):
    return heavy_keys(table(s, d, _ITEMS), ["l_linenumber"], 0.1)


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_orderkey) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY 1")
def skew_salted_agg(s, d):
    got = salted_aggregate(table(s, d, _ITEMS), ["l_returnflag"], [Agg("count", None, "n"), Agg("sum", "l_linenumber", "s"), Agg("max", "l_orderkey", "hi"), Agg("avg", "l_quantity", "a")])
    return got.withColumn("a", F.round("a", 6))


_RUNS = """SELECT user_id, segment, event_type, start, count(*) AS length FROM (SELECT *, min(pos) OVER (PARTITION BY user_id, segment) AS start FROM
(SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS segment FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS fresh FROM events))) GROUP BY 1, 2, 3, 4"""


@query(_RUNS)
def rle_segments(s, d):
    return run_segments(table(s, d, "events", "event_id", "user_id", "event_type"), "event_type", [Key("event_id")], ["user_id"])


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum, count(*) AS count, min(l_linenumber) AS min, max(l_linenumber) AS max, round(avg(l_linenumber), 6) AS avg FROM lineitem")
def rle_aggregate(s, d):
    runs = run_segments(table(s, d, _ITEMS, "l_orderkey", "l_suppkey", "l_linenumber"), "l_linenumber", [Key("l_suppkey")], ["l_orderkey"])
    return run_aggregate(runs, "l_linenumber").withColumn("avg", F.round("avg", 6))


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O') AS n_and, (SELECT count(*) FROM orders WHERE o_totalprice > 100000 OR o_orderstatus = 'O') AS n_or")
def bitmap_filter(s, d):
    df = table(s, d, "orders").withColumn("at", F.col("o_orderkey") + 1)
    dear, open_ = bitmap(df, "at", F.col("o_totalprice") > 100000), bitmap(df, "at", F.col("o_orderstatus") == "O")
    both, either = bitmap_size(bitmap_and(dear, open_)).withColumnRenamed("n", "n_and"), bitmap_size(bitmap_or(dear, open_)).withColumnRenamed("n", "n_or")
    return both.join(either)


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'")
def date_range_filter(s, d):
    return filter_(table(s, d, "orders"), F.col("o_orderdate").cast("date").between("1995-03-01", "1995-06-30")).select("o_orderkey")


# stage plans


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey")
def stage_simple(s, d):
    return StagePlan([
        Node("scan", "scan", {"path": f"parquet://{d}/customer.parquet"}),
        Node("filter", "filter", {"predicate": Col("c_acctbal") > 0.0}, ("scan",)),
        Node("project", "project", {"exprs": [Col("c_custkey"), Col("c_name"), Col("c_acctbal")]}, ("filter",)),
        Node("sort", "sort", {"keys": [Key("c_acctbal", asc=False), Key("c_custkey")]}, ("project",)),
    ]).build(s)


@query("SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 6) AS mean, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY total DESC")
def stage_join_agg_sort(s, d):
    aggs = [Agg("count", None, "customers"), Agg("avg", "c_acctbal", "mean"), Agg("sum", "c_acctbal", "total")]
    near = lambda c, n: F.round(c, n)
    return StagePlan([
        Node("customers", "scan", {"path": f"{d}/customer.parquet"}),
        Node("nations", "scan", {"path": f"{d}/nation.parquet"}),
        Node("join", "join", {"left_keys": ["c_nationkey"], "right_keys": ["n_nationkey"], "strategy": "broadcast"}, ("customers", "nations")),
        Node("group", "aggregate", {"keys": ["n_name"], "aggs": aggs}, ("join",)),
        Node("round", "project", {"exprs": [Col("n_name"), Col("customers"), near("mean", 6), near("total", 2)], "names": ["n_name", "customers", "mean", "total"]}, ("group",)),
        Node("sort", "sort", {"keys": [Key("total", asc=False)]}, ("round",)),
    ]).build(s)


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def events_by_type(s, d):
    return aggregate(table(s, d, "events"), ["event_type"], [Agg("count", None, "events"), Agg("count_distinct", "user_id", "users")])


@query("SELECT count(DISTINCT l_orderkey) AS orders, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 0) AS revenue, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def sales_totals(s, d):
    df = filter_(table(s, d, _ITEMS), F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    got = aggregate(df, (), [Agg("count_distinct", "l_orderkey", "orders"), Agg("sum", "l_quantity", "quantity"), Agg("sum", "l_extendedprice", "revenue"), Agg("avg", "l_extendedprice", "mean")])
    return got.withColumns({"quantity": F.round("quantity", 2), "revenue": F.round("revenue", 0), "mean": F.round("mean", 4)})


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_hourly(s, d):
    from ..streaming.windows import windowed

    got = windowed(table(s, d, "events"), "ts", "1 hour", [F.count("*").alias("n")], ["event_type"])
    return got.select("window_start", "event_type", "n")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT (c_acctbal < 0) GROUP BY 1")
def filter_not(s, d):
    return aggregate(filter_(table(s, d, "customer"), Not(Col("c_acctbal") < 0.0)), ["c_mktsegment"], [Agg("count", None, "n")])
