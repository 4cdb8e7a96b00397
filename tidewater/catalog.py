"""The engine's operators as queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import aggregates as A
from tidewater.functions import lists as L
from tidewater.functions import market as K
from tidewater.functions import math as M
from tidewater.functions import strings as S
from tidewater.functions import temporal as T
from tidewater.functions import windows as W
from tidewater.operators import grouping as G
from tidewater.operators import joins as J
from tidewater.operators import tables as B
from tidewater.plans.lower import Session, qexec
from tidewater.sources import files as X
from tidewater.sources import generators
from tidewater.sources.files import table
from tidewater.streaming import pubsub as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TRADES = "trades AS (SELECT user_id AS sym, ts AS time, value AS px, 1 + event_id % 9 AS sz, event_id AS id FROM events WHERE event_type = 'purchase')"
QUOTES = (
    "quotes AS (SELECT user_id AS sym, ts AS time, value AS bid, value * 1.001 AS ask, 1 + event_id % 9 AS bsz, 1 + event_id % 7 AS asz, event_id AS qid "
    "FROM events WHERE event_type = 'view')"
)
FIRST_LINE = (
    "lines AS (SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, "
    "l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS r FROM lineitem), firsts AS (SELECT * FROM lines WHERE r = 1)"
)
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def trades(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("sym"), F.col("ts").alias("time"), F.col("value").alias("px"), (1 + F.col("event_id") % 9).alias("sz"), F.col("event_id").alias("id"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select(
        F.col("user_id").alias("sym"), F.col("ts").alias("time"), F.col("value").alias("bid"), (F.col("value") * 1.001).alias("ask"),
        (1 + F.col("event_id") % 9).alias("bsz"), (1 + F.col("event_id") % 7).alias("asz"), F.col("event_id").alias("qid"),
    )


def session(spark: SparkSession, d: str) -> Session:
    s = Session()
    s.define("events", table(spark, d, "events"), ["event_id"])
    return s


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- template queries -----------------------------------------------------------------------------------------------------


@query("SELECT * FROM events WHERE value > 50 AND user_id < 40")
def filter_and(spark, d):
    return session(spark, d).q("select from events where value>50, user_id<40")


@query("SELECT event_id, value * 2 AS twice, user_id % 7 AS bucket, floor(value / 10)::BIGINT * 10 AS band FROM events")
def project_expr(spark, d):
    return session(spark, d).q("select event_id, twice:value*2, bucket:mod[user_id;7], band:xbar[10;value] from events")


@query("SELECT round(sum(value), 4) AS total, count(*) AS n, max(value) AS hi, min(value) AS lo FROM events WHERE user_id < 50")
def select_agg(spark, d):
    return rounded(session(spark, d).q("select total:sum value, n:count value, hi:max value, lo:min value from events where user_id<50"), 4, "total")


@query("SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def select_by(spark, d):
    return rounded(rounded(session(spark, d).q("select total:sum value, mean:avg value, n:count value by event_type from events").df, 4, "total"), 6, "mean")


@query("SELECT event_type, user_id, max(value) AS hi, count(*) AS n FROM events GROUP BY event_type, user_id")
def select_by_two_keys(spark, d):
    return session(spark, d).q("select hi:max value, n:count value by event_type, user_id from events").df


@query("SELECT user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def select_by_last(spark, d):
    return session(spark, d).q("select by user_id from events").df


@query("SELECT value AS value FROM events WHERE event_type = 'click' AND value > 90")
def exec_vector(spark, d):
    return session(spark, d).q("exec value from events where event_type=`click, value>90")


@query("SELECT round(avg(value), 6) AS value FROM events")
def exec_atom(spark, d):
    return rounded(session(spark, d).q("exec avg value from events"), 6, "value")


@query("SELECT *, value * 2 + user_id AS score FROM events")
def update_new_col(spark, d):
    return session(spark, d).q("update score:(value*2)+user_id from events")


@query("SELECT * REPLACE (CASE WHEN value > 80 THEN 80.0::DOUBLE ELSE value END AS value) FROM events")
def update_where(spark, d):
    return session(spark, d).q("update value:80.0 from events where value>80")


@query("SELECT *, max(value) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def update_by(spark, d):
    return session(spark, d).q("update top:max value, n:count value by user_id from events")


@query("SELECT *, CASE WHEN event_type = 'click' THEN (SELECT max(value) FROM events WHERE event_type = 'click') END AS top FROM events")
def update_where_aggregate(spark, d):
    return session(spark, d).q("update top:max value from events where event_type=`click")


@query("SELECT * FROM events WHERE NOT (value < 20)")
def delete_rows(spark, d):
    return session(spark, d).q("delete from events where value<20")


@query("SELECT event_id, ts, user_id, event_type FROM events")
def delete_cols(spark, d):
    return session(spark, d).q("delete value, props from events")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band FROM events WHERE event_type IN ('click', 'view')")
def select_condition(spark, d):
    return session(spark, d).q('select event_id, band:$[value>50;"high";"low"] from events where in[event_type;`click`view]')


@query("SELECT event_id, value FROM events WHERE value > (SELECT avg(value) FROM events)")
def where_above_average(spark, d):
    return session(spark, d).q("select event_id, value from events where value>avg value")


@query("SELECT user_id, list(value ORDER BY event_id) AS value FROM events GROUP BY user_id")
def select_nested_by(spark, d):
    return session(spark, d).q("select value by user_id from events").df


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def functional_form(spark, d):
    kt = qexec(table(spark, d, "lineitem"), F.col("l_quantity") > 10, ["l_returnflag"], {"total": F.sum("l_extendedprice")})
    return rounded(kt.df, 2, "total")


# ---- aggregates -----------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_basic(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        A.sum_("l_quantity").alias("qty"), A.min_("l_extendedprice").alias("lo"), A.max_("l_extendedprice").alias("hi"), F.round(A.avg("l_discount"), 6).alias("disc"), A.count().alias("n")
    )


@query(
    "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS dev, round(var_samp(l_quantity), 6) AS svar, round(stddev_samp(l_quantity), 6) AS sdev, "
    "round(covar_pop(l_quantity, l_discount), 8) AS cov, round(covar_samp(l_quantity, l_discount), 8) AS scov, round(corr(l_quantity, l_discount), 8) AS cor FROM lineitem GROUP BY l_returnflag"
)
def agg_var_cov_cor(spark, d):
    x, y = "l_quantity", "l_discount"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(A.var(x), 6).alias("var"), F.round(A.dev(x), 6).alias("dev"), F.round(A.svar(x), 6).alias("svar"), F.round(A.sdev(x), 6).alias("sdev"),
        F.round(A.cov(x, y), 8).alias("cov"), F.round(A.scov(x, y), 8).alias("scov"), F.round(A.cor(x, y), 8).alias("cor"),
    )


@query("SELECT user_id, median(value) AS med FROM events GROUP BY user_id")
def agg_median(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(A.med("value").alias("med"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice), 0) AS wsum, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS wavg FROM lineitem GROUP BY l_returnflag")
def agg_wavg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(A.wsum("l_quantity", "l_extendedprice"), 0).alias("wsum"), F.round(A.wavg("l_quantity", "l_extendedprice"), 6).alias("wavg"))


@query("SELECT o_orderkey % 500 AS g, product(1 + l_discount)::DECIMAL(30, 8)::DOUBLE AS prd FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_prd(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    made = li.join(o, li.l_orderkey == o.o_orderkey).groupBy((F.col("o_orderkey") % 500).alias("g")).agg(A.prd(1 + F.col("l_discount")).alias("prd"))
    # rounded as far as the decimal reaches; a double beyond it has no fraction to round
    return made.withColumn("prd", F.coalesce(F.col("prd").try_cast("decimal(30,8)").cast("double"), "prd"))


@query("SELECT user_id, bool_and(value > 1) AS every, bool_or(value > 99) AS some FROM events GROUP BY user_id")
def agg_bool(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(A.all_(F.col("value") > 1).alias("every"), A.any_(F.col("value") > 99).alias("some"))


@query("SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, arg_min(event_id, value) AS lowest FROM events GROUP BY user_id")
def agg_first_last(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        A.first("value", "event_id").alias("first"), A.last("value", "event_id").alias("last"), A.argmin("value", "event_id").alias("lowest")
    )


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(A.count_distinct("user_id").alias("users"))


# ---- grouping -------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, list(event_id ORDER BY event_id) AS places FROM events GROUP BY event_type")
def group_positions(spark, d):
    return G.group(table(spark, d, "events"), "event_type", "event_id")


@query("SELECT user_id, list(event_type ORDER BY event_id) AS event_type, list(value ORDER BY event_id) AS value, list(event_id ORDER BY event_id) AS event_id FROM events GROUP BY user_id")
def xgroup_list(spark, d):
    return G.xgroup("user_id", table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), "event_id")


@query("SELECT user_id, event_type, value, event_id FROM events")
def ungroup_roundtrip(spark, d):
    return G.ungroup(G.xgroup("user_id", table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), "event_id"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id) AS top FROM events")
def fby_max(spark, d):
    return table(spark, d, "events").select("event_id", G.fby(A.max_, "value", "user_id").alias("top"))


@query("SELECT c_custkey, c_acctbal + coalesce(s, 0) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def scatter_add(spark, d):
    orders = table(spark, d, "orders").withColumn("one", F.lit(1))
    return G.scatter(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", orders, "o_custkey", "one", "c_acctbal")


@query(
    "WITH m AS (SELECT vec_id AS i, unnest(range(64))::BIGINT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) "
    "SELECT a.j AS i, b.j, round(sum(a.v * b.v), 5) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2"
)
def matrix_product(spark, d):
    """Of the 64 columns, as rows, with themselves: X'X."""
    m = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    m = m.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return rounded(G.matrix_multiply(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), m), 5, "v")


# ---- ordered functions ----------------------------------------------------------------------------------------------------

_OVER = "OVER (PARTITION BY user_id ORDER BY event_id)"


def _u():
    return W.spec(["user_id"], ["event_id"])


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events")


@query(f"SELECT event_id, CASE WHEN lag(event_id) {_OVER} IS NULL THEN value ELSE value - lag(value) {_OVER} END AS x FROM events")
def deltas(spark, d):
    return _events(spark, d).select("event_id", W.deltas("value", _u()).alias("x"))


@query(f"SELECT event_id, round(CASE WHEN lag(event_id) {_OVER} IS NULL THEN value WHEN lag(value) {_OVER} <> 0 THEN value / lag(value) {_OVER} END, 8) AS x FROM events")
def ratios(spark, d):
    return _events(spark, d).select("event_id", F.round(W.ratios("value", _u()), 8).alias("x"))


@query(f"SELECT event_id, coalesce(event_type <> lag(event_type) {_OVER}, true) AS x FROM events")
def differ(spark, d):
    return _events(spark, d).select("event_id", W.differ("event_type", _u()).alias("x"))


@query(f"SELECT event_id, lag(value) {_OVER} AS p, lead(value) {_OVER} AS n FROM events")
def prev_next(spark, d):
    return _events(spark, d).select("event_id", W.prev("value", _u()).alias("p"), W.next_("value", _u()).alias("n"))


@query(f"SELECT event_id, lag(value, 3) {_OVER} AS back, lead(value, 2) {_OVER} AS ahead FROM events")
def xprev(spark, d):
    return _events(spark, d).select("event_id", W.xprev(3, "value", _u()).alias("back"), W.xprev(-2, "value", _u()).alias("ahead"))


@query(
    f"SELECT event_id, round(sum(value) {_OVER}, 4) AS s, round(exp(sum(ln(1 + value / 1000)) {_OVER}), 6) AS p, min(value) {_OVER} AS lo, max(value) {_OVER} AS hi FROM events"
)
def sums_prds_mins_maxs(spark, d):
    return _events(spark, d).select(
        "event_id", F.round(W.sums("value", _u()), 4).alias("s"), F.round(W.prds(1 + F.col("value") / 1000, _u()), 6).alias("p"), W.mins("value", _u()).alias("lo"), W.maxs("value", _u()).alias("hi")
    )


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS r FROM events")
def rank0(spark, d):
    return _events(spark, d).select("event_id", W.rank(W.spec(["user_id"], ["value", "event_id"])).alias("r"))


@query("SELECT event_id, floor(4 * (row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1) / count(*) OVER (PARTITION BY user_id))::BIGINT AS r FROM events")
def xrank(spark, d):
    return _events(spark, d).select("event_id", W.xrank(4, W.spec(["user_id"], ["value", "event_id"]), ["user_id"]).alias("r"))


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    f"SELECT event_id, count(*) {_frame(5)} AS n, round(sum(value) {_frame(5)}, 4) AS s, round(avg(value) {_frame(5)}, 6) AS a, "
    f"round(var_pop(value) {_frame(5)} + 1e-7, 4) AS v, round(stddev_pop(value) {_frame(5)} + 1e-7, 4) AS sd FROM events"
)
def mcount_msum_mavg_mvar_mdev(spark, d):
    return _events(spark, d).select(
        "event_id", W.mcount(5, _u()).alias("n"), F.round(W.msum(5, "value", _u()), 4).alias("s"), F.round(W.mavg(5, "value", _u()), 6).alias("a"),
        F.round(W.mvar(5, "value", _u()) + 1e-7, 4).alias("v"), F.round(W.mdev(5, "value", _u()) + 1e-7, 4).alias("sd"),
    )


@query(f"SELECT event_id, min(value) {_frame(7)} AS lo, max(value) {_frame(7)} AS hi FROM events")
def mmin_mmax(spark, d):
    return _events(spark, d).select("event_id", W.mmin(7, "value", _u()).alias("lo"), W.mmax(7, "value", _u()).alias("hi"))


@query(f"SELECT event_id, user_id, value, max(value) {_frame(50)} AS hi FROM events")
def moving_max_wide(spark, d):
    return W.moving(_events(spark, d).select("event_id", "user_id", "value"), 50, "value", "hi", "max", ["user_id"], ["event_id"])


@query(f"SELECT event_id, user_id, value, round(avg(value) {_frame(50)}, 9) AS a FROM events")
def moving_avg_wide(spark, d):
    return rounded(W.moving(_events(spark, d).select("event_id", "user_id", "value"), 50, "value", "a", "avg", ["user_id"], ["event_id"]), 9, "a")


@query(
    f"SELECT event_id, CASE WHEN row_number() {_OVER} >= 4 THEN round(avg(value) {_frame(4)}, 6) END AS a, CASE WHEN row_number() {_OVER} >= 4 THEN round(sum(value) {_frame(4)}, 4) END AS s, "
    f"CASE WHEN row_number() {_OVER} >= 4 THEN max(value) {_frame(4)} END AS hi, CASE WHEN row_number() {_OVER} >= 4 THEN min(value) {_frame(4)} END AS lo FROM events"
)
def movavg_padded(spark, d):
    return _events(spark, d).select(
        "event_id", F.round(W.movavg(4, "value", _u()), 6).alias("a"), F.round(W.movsum(4, "value", _u()), 4).alias("s"), W.movmax(4, "value", _u()).alias("hi"), W.movmin(4, "value", _u()).alias("lo")
    )


@query(f"SELECT event_id, CASE WHEN row_number() {_OVER} >= 6 THEN round(stddev_pop(value) {_frame(6)}, 4) END AS sd FROM events")
def rollstd(spark, d):
    return _events(spark, d).select("event_id", F.round(W.rollstd(6, "value", _u()), 4).alias("sd"))


@query(f"SELECT event_id, CASE WHEN lag(value) {_OVER} <> 0 THEN round(value / lag(value) {_OVER} - 1, 8) END AS r, round(ln(value) - ln(lag(value) {_OVER}), 8) AS lr FROM events WHERE value > 0")
def returns(spark, d):
    return _events(spark, d).where("value > 0").select("event_id", F.round(W.ret("value", _u()), 8).alias("r"), F.round(W.logret("value", _u()), 8).alias("lr"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), "
    "z AS (SELECT user_id, event_id, k, value AS z FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, 0.1 * e.value + 0.9 * z.z FROM z JOIN e ON e.user_id = z.user_id AND e.k = z.k + 1) "
    "SELECT event_id, round(z + 0.0000123456, 4) AS z FROM z"
)
def ema(spark, d):
    """Moved a little off the decimals, where halves would be rounded either way."""
    made = W.ema(_events(spark, d).select("event_id", "user_id", "value"), 0.1, "value", "z", ["user_id"], ["event_id"])
    return made.select("event_id", F.round(F.col("z") + 0.0000123456, 4).alias("z"))


@query(
    "WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) "
    "SELECT a.event_id, a.user_id, a.value, b.value AS x FROM e a JOIN e b ON a.user_id = b.user_id AND b.k = (a.k + 2) % a.n"
)
def rotate(spark, d):
    return W.rotate(_events(spark, d).select("event_id", "user_id", "value"), 2, "value", "x", ["user_id"], ["event_id"])


@query(f"WITH r AS (SELECT user_id, ln(value) - ln(lag(value) {_OVER}) AS r FROM events WHERE value > 0) SELECT user_id, round(sqrt(coalesce(sum(r * r), 0)), 6) AS rvol FROM r GROUP BY user_id")
def rvol(spark, d):
    return rounded(W.rvol(_events(spark, d).where("value > 0"), "value", ["user_id"], ["event_id"]), 6, "rvol")


@query(f"SELECT event_id, CASE WHEN row_number() {_OVER} >= 3 THEN list(value) {_frame(3)} END AS x FROM events")
def sliding_slices(spark, d):
    return _events(spark, d).select("event_id", W.slices(3, "value", _u()).alias("x"))


# ---- joins ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {FIRST_LINE} SELECT o_orderkey, o_totalprice, l_partkey, l_quantity FROM orders LEFT JOIN firsts ON l_orderkey = o_orderkey")
def lj(spark, d):
    kt = B.xkey("o_orderkey", table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", *LINE_ORDER))
    return J.lj(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), kt, LINE_ORDER).select("o_orderkey", "o_totalprice", "l_partkey", "l_quantity")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3")
def ij(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.ij(table(spark, d, "customer"), B.xkey("c_nationkey", n)).select("c_custkey", "c_name", "n_name")


@query(f"WITH {FIRST_LINE} SELECT o_orderkey, o_custkey, l_extendedprice FROM orders JOIN firsts ON l_orderkey = o_orderkey")
def ej_first_match(spark, d):
    y = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", *LINE_ORDER)
    return J.ej("o_orderkey", table(spark, d, "orders"), y, LINE_ORDER).select("o_orderkey", "o_custkey", "l_extendedprice")


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, NULL::VARCHAR AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def uj(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return J.uj(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, c_nationkey + coalesce(n, 0) AS n FROM customer LEFT JOIN s ON o_custkey = c_custkey")
def pj(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"))
    return J.pj(c, B.xkey("c_custkey", n))


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return B.inter(table(spark, d, "customer"), o, ["c_custkey"])


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, d):
    return B.except_(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross(spark, d):
    return J.cross(table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name"))


@query(f"WITH {TRADES}, {QUOTES} SELECT t.id, t.sym, t.time, t.px, t.sz, q.bid, q.ask, q.qid FROM trades t ASOF LEFT JOIN quotes q ON t.sym = q.sym AND t.time >= q.time")
def aj(spark, d):
    return J.aj(["sym", "time"], trades(spark, d), quotes(spark, d).select("sym", "time", "bid", "ask", "qid"), ["qid"])


@query(f"WITH {TRADES}, {QUOTES} SELECT t.id, t.sym, q.time, t.px, t.sz, q.bid, q.qid FROM trades t ASOF LEFT JOIN quotes q ON t.sym = q.sym AND t.time >= q.time")
def aj0(spark, d):
    return J.aj0(["sym", "time"], trades(spark, d), quotes(spark, d).select("sym", "time", "bid", "qid"), ["qid"])


@query(
    f"WITH {TRADES}, {QUOTES}, q AS (SELECT time, max(qid) AS qid FROM quotes GROUP BY time) SELECT t.id, t.time, q.qid FROM trades t ASOF LEFT JOIN q ON t.time >= q.time"
)
def aj_no_key(spark, d):
    """Without a key, cut into slices of a day so that the carrying is spread over tasks."""
    return J.aj(["time"], trades(spark, d).select("id", "time"), quotes(spark, d).select("time", "qid"), ["qid"], slice_width=86400)


@query(f"WITH {TRADES}, {QUOTES} SELECT t.id, t.sym, t.time, q.bid, q.qid FROM trades t ASOF LEFT JOIN quotes q ON t.sym = q.sym AND t.time >= q.time")
def aj_sliced(spark, d):
    return J.aj(["sym", "time"], trades(spark, d).select("id", "sym", "time"), quotes(spark, d).select("sym", "time", "bid", "qid"), ["qid"], slice_width=6 * 3600)


@query(f"WITH {QUOTES} SELECT bid, ask, bsz, asz, qid FROM quotes WHERE sym = 7 AND time <= (SELECT max(ts) FROM events WHERE event_id <= 500) ORDER BY time DESC, qid DESC LIMIT 1")
def asof_row(spark, d):
    at = table(spark, d, "events").where("event_id <= 500").agg(F.max("ts").alias("at")).scalar()
    return J.asof(quotes(spark, d), {"sym": 7, "time": at}, "time", ["qid"])


_WJ = "FROM trades t LEFT JOIN quotes q ON q.sym = t.sym AND q.time BETWEEN t.time - INTERVAL 12 HOUR AND t.time GROUP BY t.id"


@query(f"WITH {TRADES}, {QUOTES} SELECT t.id, count(q.qid) AS n, max(q.bid) AS hi {_WJ}")
def wj_lookback(spark, d):
    t = trades(spark, d)
    start = F.col("time") - F.expr("INTERVAL 12 HOUR")
    return J.wj(start, F.col("time"), ["sym", "time"], t, quotes(spark, d), {"n": ("count", None), "hi": ("max", "bid")}, ["id"], 12 * 3600).select("id", "n", "hi")


@query(f"WITH {TRADES}, {QUOTES} SELECT t.id, round(coalesce(sum(q.bid), 0), 4) AS s, round(avg(q.ask), 6) AS a, min(q.bid) AS lo, arg_min(q.bid, q.time) AS first, arg_max(q.bid, q.time) AS last {_WJ}")
def wj_multi_agg(spark, d):
    start = F.col("time") - F.expr("INTERVAL 12 HOUR")
    many = {"s": ("sum", "bid"), "a": ("avg", "ask"), "lo": ("min", "bid"), "first": ("first", "bid"), "last": ("last", "bid")}
    made = J.wj(start, F.col("time"), ["sym", "time"], trades(spark, d), quotes(spark, d), many, ["id"], 12 * 3600)
    return rounded(rounded(made.select("id", *many), 4, "s"), 6, "a")


@query(f"WITH {TRADES}, {QUOTES} SELECT t.id, t.sym, t.time, t.px, t.sz, coalesce(list(q.bid ORDER BY q.time) FILTER (q.qid IS NOT NULL), []) AS bids "
       "FROM trades t LEFT JOIN quotes q ON q.sym = t.sym AND q.time BETWEEN t.time - INTERVAL 6 HOUR AND t.time GROUP BY ALL")
def wj_any_function(spark, d):
    start = F.col("time") - F.expr("INTERVAL 6 HOUR")
    return J.wj_any(start, F.col("time"), ["sym", "time"], trades(spark, d), quotes(spark, d), "bid", "bids", lambda x: x, ["id"], 6 * 3600)


@query(f"WITH {TRADES}, {QUOTES} SELECT t.id, t.sym, t.time, t.px, t.sz, q.bid, q.ask FROM trades t ASOF LEFT JOIN quotes q ON t.sym = q.sym AND t.time >= q.time")
def taq(spark, d):
    return J.taq(trades(spark, d), quotes(spark, d).select("sym", "time", "bid", "ask"))


# ---- sorting and sets -----------------------------------------------------------------------------------------------------


@query(f"SELECT * FROM lineitem ORDER BY l_returnflag, l_linestatus, l_shipdate, {', '.join(LINE_ORDER)}")
def sort_multi(spark, d):
    return B.xasc(["l_returnflag", "l_linestatus", "l_shipdate"], table(spark, d, "lineitem"), LINE_ORDER)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, d):
    return B.topk(20, "o_totalprice", table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 15)")
def last_rows(spark, d):
    return B.sublist(-15, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("SELECT n_nationkey, n_name FROM (SELECT *, unnest(range(CASE WHEN n_nationkey < 10 THEN 3 ELSE 2 END)) FROM nation)")
def take_cycling(spark, d):
    return B.take(60, table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT * FROM region ORDER BY r_regionkey OFFSET 2")
def drop_first(spark, d):
    return B.drop_rows(2, table(spark, d, "region"), ["r_regionkey"])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, d):
    return B.distinct(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, d):
    return B.union(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def inter_keeps_repeats(spark, d):
    return B.inter(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS found FROM customer")
def membership(spark, d):
    return B.in_(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey")).select("c_custkey", "found")


@query("WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT i, o_orderkey, o_totalprice FROM (VALUES (3::BIGINT), (0), (7), (999999999)) v(i) LEFT JOIN o ON k = i")
def gather_rows(spark, d):
    places = spark.createDataFrame([(3,), (0,), (7,), (999999999,)], "i long")
    return B.atr(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), places, ["o_orderkey"])


@query("SELECT * FROM (VALUES ('n_nationkey', 'int', NULL), ('n_name', 'string', NULL), ('n_regionkey', 'int', NULL)) v(c, t, a)")
def meta(spark, d):
    return B.meta(table(spark, d, "nation"))


# ---- scalars --------------------------------------------------------------------------------------------------------------


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_partkey % 7 AS m, floor(l_extendedprice / l_quantity)::BIGINT AS d, floor(l_extendedprice / 1000) * 1000 AS b, "
    "floor(0.5 + l_discount * 10) / 10 AS r, round(ln(l_extendedprice) / ln(10), 8) AS x, round(sqrt(l_quantity), 8) AS q, CASE WHEN l_quantity > 25 THEN 1 WHEN l_quantity < 25 THEN -1 ELSE 0 END AS s FROM lineitem"
)
def num_functions(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", M.mod(F.col("l_partkey"), 7).alias("m"), M.div(F.col("l_extendedprice"), F.col("l_quantity")).alias("d"),
        M.xbar(F.lit(1000.0), F.col("l_extendedprice")).alias("b"), M.round_half_up(1, F.col("l_discount")).alias("r"), F.round(M.xlog(10, F.col("l_extendedprice")), 8).alias("x"),
        F.round(M.sqrt(F.col("l_quantity")), 8).alias("q"), M.signum(F.col("l_quantity") - 25).alias("s"),
    )


@query(
    "SELECT conv_id, turn, trim(text, ' ') AS t, upper(role) AS u, lower(text) AS l, replace(text, 'the', 'THE') AS r, len(string_split(text, ' ')) AS n, text SIMILAR TO '(?s)T.*' AS k, "
    "rpad(left(role, 4), 4, ' ') AS p, array_to_string(string_split(role, 's'), '-') AS j FROM conversations"
)
def str_functions(spark, d):
    c = table(spark, d, "conversations")
    return c.select(
        "conv_id", "turn", S.trim("text").alias("t"), S.upper("role").alias("u"), S.lower("text").alias("l"), S.ssr("text", "the", "THE").alias("r"), F.size(S.vs(" ", "text")).cast("long").alias("n"),
        S.like("text", "T*").alias("k"), S.pad(4, "role").alias("p"), S.sv("-", S.vs("s", "role")).alias("j"),
    )


@query("SELECT conv_id, turn, list_filter(range(greatest(length(text) - 1, 0)::BIGINT), lambda i: substr(text, i + 1, 2) = 'th')::INTEGER[] AS places FROM conversations")
def str_search(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.ss("text", "th").alias("places"))


@query(
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS dd, strftime(o_orderdate, '%a') AS w, "
    "date_diff('day', DATE '2000-01-01', o_orderdate::DATE)::INTEGER AS n, strftime(o_orderdate, '%Y.%m.%d') AS s, (o_orderdate::DATE + 30)::DATE AS later FROM orders"
)
def dt_functions(spark, d):
    o = table(spark, d, "orders")
    n = T.days_of("o_orderdate")
    return o.select("o_orderkey", T.year("o_orderdate").alias("y"), T.month("o_orderdate").alias("m"), T.day("o_orderdate").alias("dd"), T.dow("o_orderdate").alias("w"), n.alias("n"), T.dstr(n).alias("s"), T.dadd(F.col("o_orderdate").cast("date"), F.lit(30)).alias("later"))


@query(
    "WITH e AS (SELECT event_id, ts, (epoch_us(ts) // 1000) % 86400000 AS ms FROM events) SELECT event_id, ms, ms // 3600000 AS h, ms // 60000 % 60 AS m, ms // 1000 % 60 AS s, "
    "ms // 300000 * 300000 AS bar, strftime(ts, '%H:%M:%S.%g') AS text FROM e"
)
def time_functions(spark, d):
    ms = T.tsms("ts")
    return table(spark, d, "events").select("event_id", ms.alias("ms"), T.hh(ms).alias("h"), T.mm(ms).alias("m"), T.sec(ms).alias("s"), T.minbar(F.lit(5), ms).alias("bar"), T.stime(ms).alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", L.json_value("props", "$.k", "bigint").alias("k"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, len(embedding)::INTEGER AS n FROM embeddings")
def array_functions(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(L.dot("embedding", "embedding"), 6).alias("norm"), L.first("embedding").cast("double").alias("first"), L.last("embedding").cast("double").alias("last"), L.count("embedding").alias("n")
    )


@query("WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, list(k ORDER BY value, k) AS g FROM e GROUP BY user_id")
def array_grade(spark, d):
    e = G.xgroup("user_id", table(spark, d, "events").select("user_id", "value", "event_id"), "event_id")
    return e.select("user_id", F.transform(L.iasc("value"), lambda i: (i + 1).cast("long")).alias("g"))


# ---- market ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {TRADES} SELECT sym, round(sum(px * sz) / sum(sz), 6) AS vwap, round(avg(px), 6) AS twap FROM trades GROUP BY sym")
def vwap_twap(spark, d):
    return trades(spark, d).groupBy("sym").agg(F.round(K.vwap(), 6).alias("vwap"), F.round(K.twap(), 6).alias("twap"))


BARS_SQL = (
    f"WITH {TRADES} SELECT sym, time_bucket(INTERVAL 60 MINUTE, time, TIMESTAMP '2000-01-01') AS time, arg_min(px, id) AS o, max(px) AS h, min(px) AS l, arg_max(px, id) AS c, sum(sz)::BIGINT AS v FROM trades GROUP BY 1, 2"
)


@query(BARS_SQL)
def ohlc_bars(spark, d):
    return K.bars(trades(spark, d), 60, "id", unit="timestamp")


@query(f"WITH {TRADES} SELECT sym, count(*) AS n, floor(0.5 + sum(px * sz) / sum(sz) * 10000) / 10000 AS vwap, max(px) AS hi, min(px) AS lo, sum(sz)::BIGINT AS vol FROM trades GROUP BY sym")
def symstats(spark, d):
    return K.symstats(trades(spark, d))


@query(
    f"WITH {QUOTES} SELECT qid, round((bid + ask) / 2, 8) AS mid, round(ask - bid, 8) AS spread, round((bid * asz + ask * bsz) / (bsz + asz), 8) AS micro, "
    "floor(0.5 + (bsz - asz) / (bsz + asz) * 10000) / 10000 AS imbal FROM quotes"
)
def mid_spread_micro(spark, d):
    return quotes(spark, d).select("qid", F.round(K.mid(), 8).alias("mid"), F.round(K.spread(), 8).alias("spread"), F.round(K.micro(), 8).alias("micro"), K.imbal().alias("imbal"))


@query(
    f"WITH {TRADES}, {QUOTES}, j AS (SELECT t.*, q.bid, q.ask FROM trades t ASOF LEFT JOIN quotes q ON t.sym = q.sym AND t.time >= q.time) "
    "SELECT id, sign(px - (bid + ask) / 2)::INTEGER AS side, round(2 * abs(px - (bid + ask) / 2), 6) AS eff, round(px * sz, 6) AS notional, sign(px - (bid + ask) / 2)::INTEGER * sz AS signed FROM j"
)
def tsign_effspread(spark, d):
    j = J.taq(trades(spark, d), quotes(spark, d).select("sym", "time", "bid", "ask"))
    return j.select("id", K.tsign().alias("side"), F.round(K.effspread(), 6).alias("eff"), F.round(K.notional(), 6).alias("notional"), K.signedvol().alias("signed"))


# ---- streams --------------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_bars(spark, d):
    made = P.tumbling(P.follow_file(spark, d, "events.parquet"), "ts", "60 minutes", ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return rounded(P.drain(made), 4, "total")


@query(
    f"WITH g AS (SELECT *, CASE WHEN ts - lag(ts) {_OVER} < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) {_OVER} AS k FROM g) "
    "SELECT min(ts) AS start, user_id, count(*) AS n, round(max(value), 6) AS hi FROM s GROUP BY user_id, k"
)
def stream_sessions(spark, d):
    made = P.sessions(P.follow_file(spark, d, "events.parquet"), "ts", "30 minutes", ["user_id"], {"n": F.count(F.lit(1)), "hi": F.round(F.max("value"), 6)})
    return P.drain(made)


@query("SELECT ts AS time, user_id, event_type, value, event_id FROM events")
def stream_pubsub(spark, d):
    """Publish two batches and read the stream's table back."""
    hub = P.Hub(spark, scratch(spark, "hub"))
    e = table(spark, d, "events").select(F.col("ts").alias("time"), "user_id", "event_type", "value", "event_id")
    hub.define("ticks", e.limit(0))
    for half in (0, 1):
        hub.publish("ticks", e.where(F.col("event_id") % 2 == half))
    return hub.get("ticks")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts + o * INTERVAL 30 MINUTE, TIMESTAMP '2000-01-01') - INTERVAL 30 MINUTE AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(o) GROUP BY 1, 2")
def stream_sliding(spark, d):
    made = P.sliding(P.follow_file(spark, d, "events.parquet"), "ts", "60 minutes", "30 minutes", ["event_type"], {"n": F.count(F.lit(1))})
    return P.drain(made)


# ---- files ----------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def partition_roundtrip(spark, d):
    """Write by partition and read two partitions back; the others are not opened."""
    path = scratch(spark, "parts")
    X.partsave(path, table(spark, d, "events"), "event_type")
    some = X.partload(spark, path, F.col("event_type").isin("click", "view"))
    return some.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("SELECT DISTINCT event_type FROM events")
def partition_list(spark, d):
    path = scratch(spark, "parts")
    X.partsave(path, table(spark, d, "events"), "event_type")
    return X.parts(spark, path, "event_type")


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, d):
    """Types are found again from the text."""
    path = scratch(spark, "csv")
    X.write_csv(table(spark, d, "customer"), path)
    return X.read_csv(spark, path)


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def json_roundtrip(spark, d):
    path = scratch(spark, "json")
    X.write_json(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return X.read_json(spark, path, "p_partkey long, p_name string, p_size long, p_retailprice double")


@query("SELECT * FROM orders")
def splay_roundtrip(spark, d):
    path = scratch(spark, "splay")
    X.splay(path, table(spark, d, "orders"))
    return X.dload(spark, path)


@query("SELECT * FROM nation")
def arrow_roundtrip(spark, d):
    return X.arrow_import(spark, X.arrow_export(table(spark, d, "nation")))


@query("SELECT n_nationkey AS k, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def json_encode(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("k"), L.to_json(F.struct("n_nationkey", "n_name")).alias("value"))


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY 1")
def lines_roundtrip(spark, d):
    path = scratch(spark, "lines")
    X.write_lines(table(spark, d, "conversations").select(F.explode(F.split("text", "\n")).alias("value")), path)
    return X.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query()
def generated_quotes(spark, d):
    return generators.quotes(spark, 5000)


@query()
def generated_trades(spark, d):
    return generators.trades(spark, 5000)


@query()
def generated_options(spark, d):
    return generators.options(spark, 1000)


# ---- more values ----------------------------------------------------------------------------------------------------------


@query(
    "SELECT user_id, map_from_entries(list((event_type, n) ORDER BY event_type)) ->> 'click' AS clicks, len(list(event_type))::INTEGER AS kinds "
    "FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"
)
def map_lookup(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.try_element_at("m", F.lit("click")).cast("string").alias("clicks"), F.size(L.keys("m")).alias("kinds"))


@query(
    "WITH x AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, v[1:3] AS head, v[-2:] AS tail, list_reverse(v)[1] AS last, "
    "list_sort(v)[1] AS low, list_filter(v, lambda a: a > 99) AS high, len(v)::INTEGER AS n FROM x WHERE len(v) > 3"
)
def array_shape(spark, d):
    x = G.xgroup("user_id", table(spark, d, "events").select("user_id", "value", "event_id"), "event_id").where(F.size("value") > 3)
    v = F.col("value")
    return x.select(
        "user_id", L.sublist(3, v).alias("head"), L.sublist(-2, v).alias("tail"), L.first(L.reverse(v)).alias("last"), L.first(L.asc(v)).alias("low"), L.keep(lambda a: a > 99, v).alias("high"), L.count(v).alias("n")
    )


@query("SELECT o_orderkey, TRY_CAST(o_orderpriority[1] AS BIGINT) AS p, trunc(o_totalprice)::BIGINT AS whole, o_totalprice > 0 AS some, o_orderkey::VARCHAR AS text FROM orders")
def casts(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", M.cast("long", F.substring("o_orderpriority", 1, 1)).alias("p"), M.cast("long", F.col("o_totalprice")).alias("whole"), M.cast("bool", F.col("o_totalprice")).alias("some"), S.string("o_orderkey").alias("text"))


@query("SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN value / (user_id % 3) END AS q, least(value, 50) AS lo, greatest(value, 50) AS hi, value = 0 AS zero FROM events")
def num_division(spark, d):
    e = table(spark, d, "events")
    v = F.col("value")
    return e.select("event_id", M.fdiv(v, F.col("user_id") % 3).alias("q"), M.smaller(v, 50.0).alias("lo"), M.larger(v, 50.0).alias("hi"), M.not_(v).alias("zero"))


@query("SELECT p_partkey, p_size + 1.0::DOUBLE AS spot, 50.0::DOUBLE AS half FROM part WHERE p_size > 10")
def template_literals(spark, d):
    s = Session(part=table(spark, d, "part"))
    return s.q("select p_partkey, spot:p_size+1.0, half:round[2;100*0.5] from part where p_size>10")


@query("SELECT user_id, round(avg(value), 9) AS mean, round(sum(value * event_id) / sum(event_id), 6) AS w, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def template_by_mixed(spark, d):
    return rounded(session(spark, d).q("select mean:avg value, w:wavg[event_id;value], kinds:#?event_type by user_id from events").df.withColumn("mean", F.round("mean", 9)), 6, "w")


@query(f"SELECT event_id, ts, user_id, event_type, value, props, round(avg(value) {_frame(3)}, 6) AS m, value - lag(value) {_OVER} AS step FROM events")
def template_moving_by(spark, d):
    return rounded(session(spark, d).q("update m:mavg[3;value], step:value-prev value by user_id from events"), 6, "m")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share; it goes when the application ends."""
    path = f"{X.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    X.delete_at_exit(spark, path)
    return path


from tidewater import catalog_more  # noqa: E402, F401  adds to the catalogue


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of each symbol with their volume-weighted price, of the trades with a quote in force."""
    j = J.taq(trades(spark, d), quotes(spark, d).select("sym", "time", "bid", "ask")).where("bid is not null")
    hour = T.minbar_of(60, "time").alias("hour")
    return j.groupBy("sym", hour).agg(
        A.first("px", "id").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), A.last("px", "id").alias("c"), F.sum("sz").alias("v"), F.round(K.vwap(), 6).alias("vwap"),
        F.round(F.avg(K.effspread()), 6).alias("spread"),
    )


