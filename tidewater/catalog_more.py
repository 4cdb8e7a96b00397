"""More operators as queries: shape of tables, arrays, values and numbers, and sorting with the place of each row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.catalog import LINE_ORDER, query, trades
from tidewater.functions import aggregates as A
from tidewater.functions import lists as L
from tidewater.functions import market as K
from tidewater.functions import math as M
from tidewater.functions import strings as S
from tidewater.functions import temporal as T
from tidewater.functions import windows as W
from tidewater.operators import grouping as G
from tidewater.operators import tables as B
from tidewater.sources.files import table

VALUES = "x AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)"


def arrays(spark, d):
    return G.xgroup("user_id", table(spark, d, "events").select("user_id", "value", "event_id"), "event_id").select("user_id", F.col("value").alias("v"))


# ---- shape of tables ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def insert_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return B.insert(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_by_name(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return B.append_by_name(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))


@query("SELECT c_name AS a, c_custkey AS b, c_nationkey AS c FROM customer")
def rename_columns(spark, d):
    return B.xcolall(["a", "b", "c"], B.xcols("c_name", table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")))


@query("SELECT c_custkey, NULL::VARCHAR AS missing FROM customer")
def take_missing_column(spark, d):
    return B.take_columns(["c_custkey", "missing"], table(spark, d, "customer")).withColumn("missing", F.col("missing").cast("string"))


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint', NULL::VARCHAR), ('o_totalprice', 'double', 's')) t(c, t, a)")
def table_meta(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return B.meta(B.sortcol("o_totalprice", o))


@query("SELECT true AS same, false AS other")
def match_tables(spark, d):
    n = table(spark, d, "nation")
    same, other = B.match(n, n.orderBy(F.desc("n_nationkey"))), B.match(n, n.where("n_nationkey > 0"))
    return spark.range(1).select(F.lit(same).alias("same"), F.lit(other).alias("other"))


@query("SELECT true AS sorted, false AS unsorted")
def presorted(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return B.is_sorted(o, ["o_orderkey"], ["o_orderkey"]).crossJoin(B.is_sorted(o, ["o_totalprice"], ["o_orderkey"]).withColumnRenamed("sorted", "unsorted"))


@query("SELECT event_id, user_id, value FROM events WHERE user_id = 7")
def rows_of_symbol(spark, d):
    return G.symrows(G.bysym(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id"), "user_id", 7)


@query("SELECT n_nationkey, n_name FROM nation")
def rows_and_back(spark, d):
    return B.rows(table(spark, d, "nation").select("n_nationkey", "n_name")).select("row.*")


# ---- sorting, with the place of each row ----------------------------------------------------------------------------------


def placed(df, order, down=()):
    return B.numbered(df, order, "place", down).withColumn("place", F.col("place") + 1)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS place FROM orders")
def sort_places(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return placed(o, ["o_orderpriority", "o_totalprice", "o_orderkey"]).select("o_orderkey", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_places_down(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return placed(o, ["o_orderkey"], down=["o_orderpriority", "o_totalprice"]).select("o_orderkey", "place")


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_shipdate, {', '.join(LINE_ORDER)}, l_orderkey) AS place FROM lineitem")
def sort_places_lines(spark, d):
    li = table(spark, d, "lineitem")
    return placed(li, ["l_returnflag", "l_linestatus", "l_shipdate", *LINE_ORDER, "l_orderkey"]).select("l_orderkey", "l_linenumber", "place")


# ---- aggregates -----------------------------------------------------------------------------------------------------------


@query(
    "SELECT user_id, (arg_max(event_id, (value, -event_id)))::BIGINT AS highest, arg_max(event_id, (event_type, -event_id)) AS last_type, arg_max(event_id, (ts, -event_id)) AS latest FROM events GROUP BY user_id"
)
def argmax_places(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        A.argmax("value", "event_id").alias("highest"), A.argmax("event_type", "event_id").alias("last_type"), A.argmax("ts", "event_id").alias("latest")
    )


@query("SELECT c_custkey, least(c_acctbal, s) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def scatter_min(spark, d):
    return G.scatter(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_totalprice", "c_acctbal", how="min")


@query("SELECT c_custkey, greatest(c_acctbal, s) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def scatter_max(spark, d):
    return G.scatter(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_totalprice", "c_acctbal", how="max")


@query("SELECT event_id, round(value - lag(value) OVER w, 9) AS step, round(exp(sum(ln(1 + value / 100)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), 4) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def each_prior_and_products(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("f", 1 + F.col("value") / 100)
    return e.select("event_id", F.round(W.each_prior(lambda x, p: x - p, "value", w), 9).alias("step"), F.round(W.mprd(3, "f", w), 4).alias("p"))


# ---- arrays ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {VALUES} SELECT user_id, list_filter(range(len(v)), lambda i: v[i + 1] > 50)::INTEGER[] AS at FROM x")
def array_where(spark, d):
    return arrays(spark, d).select("user_id", L.where(F.transform("v", lambda a: a > 50)).alias("at"))


@query(f"WITH {VALUES} SELECT user_id, (list_position(v, v[3]) - 1)::BIGINT AS found, len(list_filter(list_sort(v), lambda a: a <= 50))::INTEGER - 1 AS bin FROM x WHERE len(v) >= 3")
def array_find_bin(spark, d):
    x = arrays(spark, d).where(F.size("v") >= 3)
    return x.select("user_id", L.find("v", L.at("v", 2)).cast("long").alias("found"), L.bin_(L.asc("v"), 50.0).alias("bin"))


@query(f"WITH {VALUES} SELECT user_id, [-1.0::DOUBLE] || v[2:] AS amended, v[1:1] || [0.5::DOUBLE, 0.25] || v[4:] AS spliced FROM x WHERE len(v) >= 3")
def array_amend_splice(spark, d):
    x = arrays(spark, d).where(F.size("v") >= 3)
    two = F.array(F.lit(0.5), F.lit(0.25))
    return x.select("user_id", L.amend("v", 0, lambda v: F.lit(-1.0)).alias("amended"), L.splice("v", 1, 3, two).alias("spliced"))


@query(f"WITH {VALUES} SELECT user_id, [v[1:2], v[3:]] AS pieces, [[v[1], v[2]], [v[3], v[4]]] AS shaped, v[1:2] || v[3:] AS razed FROM x WHERE len(v) >= 4")
def array_cut_reshape_raze(spark, d):
    x = arrays(spark, d).where(F.size("v") >= 4)
    pieces = L.cut([0, 2], "v")
    return x.select("user_id", pieces.alias("pieces"), L.reshape(2, 2, "v").alias("shaped"), L.raze(pieces).alias("razed"))


@query(f"WITH {VALUES} SELECT user_id, round(list_sum(v), 6) AS total, round(list_max(list_transform(range(1, len(v) + 1), lambda i: list_sum(v[1:i]))), 6) AS top, round(list_sum(list_transform(v, lambda a: a * 2)), 6) AS twice FROM x")
def array_fold_scan_each(spark, d):
    add = lambda a, b: a + b
    sums = L.scan(add, 0.0, "v", "double")
    return arrays(spark, d).select(
        "user_id", F.round(L.fold(add, F.lit(0.0), "v"), 6).alias("total"), F.round(F.array_max(sums), 6).alias("top"),
        F.round(L.fold(add, F.lit(0.0), L.each(lambda a: a * 2, "v")), 6).alias("twice"),
    )


@query(f"WITH {VALUES} SELECT user_id, list_filter(v, lambda a: a <= 50) AS low, list_filter(v, lambda a: a > 50) AS high, list_reverse(list_sort(v)) AS down FROM x")
def array_keep_weed(spark, d):
    return arrays(spark, d).select("user_id", L.weed(lambda a: a > 50, "v").alias("low"), L.keep(lambda a: a > 50, "v").alias("high"), L.desc("v").alias("down"))


@query("SELECT p_partkey, list_filter(range(p_size), lambda i: true)::BIGINT[] AS til, [p_size // 25, p_size // 5 % 5, p_size % 5]::BIGINT[] AS digits, p_size::BIGINT AS back FROM part")
def array_til_digits(spark, d):
    digits = S.encode_base(5, "p_size", 3)
    return table(spark, d, "part").select("p_partkey", L.til("p_size").alias("til"), digits.alias("digits"), S.decode_base(5, digits).cast("long").alias("back"))


# ---- values ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS filled, nullif(event_type, 'click') IS NULL AS was_null, nullif(event_type, 'click') IS NOT DISTINCT FROM event_type AS same FROM events")
def fill_null_match(spark, d):
    x = F.when(F.col("event_type") != "click", F.col("event_type"))
    return table(spark, d, "events").select("event_id", M.fill(F.lit("none"), x).alias("filled"), M.null(x).alias("was_null"), M.match(x, F.col("event_type")).alias("same"))


@query("SELECT event_id, floor(value)::BIGINT AS low, ceil(value)::BIGINT AS high, CASE WHEN value <> 0 THEN round(1 / value, 9) END AS recip FROM events")
def floor_ceiling_reciprocal(spark, d):
    return table(spark, d, "events").select("event_id", M.floor(F.col("value")).alias("low"), M.ceiling(F.col("value")).alias("high"), F.round(M.reciprocal(F.col("value")), 9).alias("recip"))


_K = "1 / (1 + 0.2316419 * abs(x))"
_UPPER = f"1 - 0.39894228 * exp(-x * x / 2) * (({_K}) * (0.319381530 + ({_K}) * (-0.356563782 + ({_K}) * (1.781477937 + ({_K}) * (-1.821255978 + ({_K}) * 1.330274429)))))"


@query(f"WITH v AS (SELECT event_id, (value - 50) / 20 AS x FROM events) SELECT event_id, round(0.39894228 * exp(-x * x / 2), 9) AS density, round(CASE WHEN x >= 0 THEN {_UPPER} ELSE 1 - ({_UPPER}) END, 9) AS share FROM v")
def normal_distribution(spark, d):
    x = (F.col("value") - 50) / 20
    return table(spark, d, "events").select("event_id", F.round(M.npdf(x), 9).alias("density"), F.round(M.ncdf(x), 9).alias("share"))


@query("SELECT o_orderkey, date_diff('day', DATE '2000-01-01', o_orderdate::DATE)::INTEGER AS days, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day, true AS parsed FROM orders")
def days_and_parts(spark, d):
    o = table(spark, d, "orders")
    at = F.col("o_orderdate").cast("date")
    days = T.ymd2d(F.year(at), F.month(at), F.day(at))
    back = T.d2ymd(days)
    return o.select("o_orderkey", days.alias("days"), *(back[c].alias(c) for c in ("year", "month", "day")), (T.pdate(T.dstr(days)) == days).alias("parsed"))


@query("SELECT c_custkey, lower(hex(c_name)) AS hex, c_name AS back, lpad((c_custkey % 7)::VARCHAR, 2, '0') AS z2, lpad((c_custkey % 7)::VARCHAR, 3, '0') AS z3, c_name || '.' || c_custkey AS dotted FROM customer")
def text_formats(spark, d):
    k = F.col("c_custkey") % 7
    return table(spark, d, "customer").select(
        "c_custkey", S.hex_("c_name").alias("hex"), S.unhex(S.hex_("c_name")).alias("back"), S.z2(k).alias("z2"), S.z3(k).alias("z3"), S.dotted("c_name", F.col("c_custkey").cast("string")).alias("dotted")
    )


@query("SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_]', '', 'g') AS id, format('{:,}', (c_custkey * 1000)::BIGINT) AS comma FROM customer")
def identifiers_and_commas(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.identifier("c_name").alias("id"), S.comma(F.col("c_custkey") * 1000).alias("comma"))


@query("SELECT event_id, typeof(value) = 'DOUBLE' AS number, typeof(event_type) = 'VARCHAR' AS text FROM events")
def type_names(spark, d):
    return table(spark, d, "events").select("event_id", (M.typename(F.col("value")) == "double").alias("number"), (M.typename(F.col("event_type")) == "string").alias("text"))


@query("SELECT user_id, map_keys(map_from_entries(list((event_type, n) ORDER BY event_type))) AS kinds, list(n + 1 ORDER BY event_type) AS more FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def map_arithmetic(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", L.keys("m").alias("kinds"), F.transform(L.values("m"), lambda v: v + 1).alias("more"))


_QUOTES = "q AS (SELECT event_id, value AS bid, value * 1.001 AS ask FROM events WHERE event_type = 'view')"


@query(f"WITH {_QUOTES} SELECT event_id, CASE WHEN bid + ask <> 0 THEN floor(0.5 + 100 * (10000 * (ask - bid) / ((bid + ask) / 2))) / 100 END AS bps FROM q")
def spread_points(spark, d):
    q = table(spark, d, "events").where("event_type = 'view'").select("event_id", F.col("value").alias("bid"), (F.col("value") * 1.001).alias("ask"))
    return q.select("event_id", K.spreadbps().alias("bps"))


@query()
def option_values(spark, d):
    """Value and sensitivities of an option on every trade; tested against the closed form in Python."""
    t = trades(spark, d).where("px > 0")
    made = M.black_scholes(F.col("px"), F.lit(50.0), F.lit(0.5), F.lit(0.3), F.col("sz") > 4)
    return t.select("id", "px", "sz", *(c.alias(n) for n, c in made.items()))
