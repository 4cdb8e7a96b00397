import pytest

from tidewater.operators.tables import KeyedTable
from tidewater.plans.lexer import LengthError, QueryError, QuerySyntaxError, QueryTypeError, UnknownName, tokenize
from tidewater.plans.lower import Session
from tidewater.plans.parser import parse


@pytest.fixture(scope="module")
def s(spark):
    out = Session()
    rows = [(0, "a", 10.0, 1), (1, "b", 20.0, 2), (2, "a", 30.0, 3), (3, "b", 40.0, 4), (4, "c", 50.0, 5), (5, "a", 60.0, 6)]
    t = spark.createDataFrame(rows, "i long, sym string, px double, sz long")
    out.define("trades", t, ["i"])
    out.define("none", t.limit(0), ["i"])
    out.define("one", t.limit(1), ["i"])
    out.define("mt", spark.createDataFrame([("x", 1, 10, 0), ("x", 2, 20, 1), ("y", 1, 30, 2), ("y", 2, 40, 3), ("x", 1, 50, 4)], "a string, b long, v long, i long"), ["i"])
    return out


def rows(result, *columns):
    df = result.df if isinstance(result, KeyedTable) else result
    df = df.orderBy("i") if "i" in df.columns else df
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    "text, columns, want",
    [
        ("select from trades where px>25", ["i"], [2, 3, 4, 5]), ("select from trades where px>15, sz<5", ["i"], [1, 2, 3]), ("select tot:sum px from trades", ["tot"], [210.0]),
        ("select a:sum px, b:max sz from trades", ["a", "b"], [(210.0, 6)]), ("select v:sum px*sz from trades", ["v"], [910.0]), ("update px:0.0 from trades where px>35", ["px"], [10, 20, 30, 0, 0, 0]),
        ("update t:sum px by sym from trades", ["t"], [100, 60, 100, 60, 50, 100]), ("delete from trades where px>35", ["i"], [0, 1, 2]), ("select i,x:px*2+1 from trades where sym=`a", ["x"], [30, 90, 180]),
        ("select i,x:(px*2)+1 from trades where sym=`a", ["x"], [21, 61, 121]), ("select sum px from none", ["x0"], [0.0]), ("select n:count px from none", ["n"], [0]), ("select from trades where ~px>30", ["i"], [0, 1, 2]),
        ("select i,m:mavg[2;px] from trades", ["m"], [10, 15, 25, 35, 45, 55]), ("update d:deltas px by sym from trades", ["d"], [10, 20, 20, 20, 50, 30]), ("select i, d:px-avg px from trades", ["d"], [-25, -15, -5, 5, 15, 25]),
        ("update m:max px from trades where sym=`a", ["m"], [60, None, 60, None, None, 60]), ("select i,c:$[px>30;1;px>10;2;0] from trades", ["c"], [0, 2, 2, 1, 1, 1]), ("select from trades where in[sym;`a`c]", ["i"], [0, 2, 4, 5]),
        ('select from trades where like[sym;"[ab]"]', ["i"], []), ('select from trades where sym="b"', ["i"], [1, 3]), ("select i,x:px%0 from one", ["x"], [None]), ("select i,x:5!sz from trades where sz>4", ["x"], [0, 1]),
        ("select i,x:-2!sz from trades where sz>4", ["x"], [2, 3]), ("select i,x:px&25.0 from trades", ["x"], [10, 20, 25, 25, 25, 25]), ("select i,r:rank px from trades", ["r"], [0, 1, 2, 3, 4, 5]),
        ("select n:#?sym from trades", ["n"], [3]), ("select f:first px, l:last px from trades", ["f", "l"], [(10.0, 60.0)]), ("select from trades where px>avg px", ["i"], [3, 4, 5]), ("select i,p:prev px from trades where sym=`a", ["p"], [None, 10, 30]),
        ("update px:px*2, sz:0 from trades where i<2", ["px", "sz"], [(20.0, 0), (40.0, 0), (30.0, 3), (40.0, 4), (50.0, 5), (60.0, 6)]), ("select i,x:_px%7 from trades where i=1", ["x"], [2]),
        ("select i,x:fby[max[px];sym] from trades", ["x"], [60, 40, 60, 40, 50, 60]), ("select i,t:-5 from one", ["t"], [-5]), ("select i,x:px-5 from one", ["x"], [5.0]), ("select i,x:px -5 from one", ["x"], [5.0]),
    ],
)
def test_results(s, text, columns, want):
    assert rows(s.q(text), *columns) == want


def test_by(s):
    kt = s.q("select tot:sum px by sym from trades")
    assert isinstance(kt, KeyedTable) and kt.key == ("sym",)
    assert dict((r["sym"], r["tot"]) for r in kt.df.collect()) == {"a": 100, "b": 60, "c": 50}
    assert {r["sym"]: (r["px"], r["sz"]) for r in s.q("select by sym from trades").df.collect()} == {"a": (60, 6), "b": (40, 4), "c": (50, 5)}
    assert {(r["a"], r["b"]): r["t"] for r in s.q("select t:sum v by a,b from mt").df.collect()} == {("x", 1): 60, ("x", 2): 20, ("y", 1): 30, ("y", 2): 40}
    assert {r["sym"]: r["px"] for r in s.q("select px by sym from trades").df.collect()} == {"a": [10, 30, 60], "b": [20, 40], "c": [50]}
    assert {r["sym"]: r["s"] for r in s.q("select s:sums px by sym from trades").df.collect()} == {"a": [10, 40, 100], "b": [20, 60], "c": [50]}


def test_exec(s):
    assert s.value("exec px from trades where px>35") == [40, 50, 60]
    assert s.value("exec sum px from trades") == 210


def test_columns(s):
    assert s.q("delete sz from trades").columns == ["i", "sym", "px"]
    assert s.q("delete px,sz from trades").columns == ["i", "sym"]
    assert s.q("select sym, px from trades").columns == ["sym", "px"]
    assert s.q("select px*2, sz from trades").columns == ["x0", "sz"]
    assert s.q("select * from trades").columns == ["i", "sym", "px", "sz"]


def test_script(s):
    out = s.script('big: select from trades where px>35\nnote: "select nothing from nowhere"\nselect n:count px from big')
    assert out.first()["n"] == 3


@pytest.mark.parametrize(
    "text, error",
    [
        ("", QuerySyntaxError), ("   ", QuerySyntaxError), ("px from trades", QuerySyntaxError), ("select", QuerySyntaxError), ("select px", QuerySyntaxError), ("select px from", QuerySyntaxError), ("select px by sym", QuerySyntaxError),
        ("select from nope", UnknownName), ("select zz from trades", UnknownName), ("select px by zz from trades", UnknownName), ("select nofunction px from trades", UnknownName), ("select from trades where", QuerySyntaxError),
        ("select px, from trades", QuerySyntaxError), ("select ,px from trades", QuerySyntaxError), ("select sum[px from trades", QuerySyntaxError), ("select px) from trades", QuerySyntaxError), ("select (px from trades", QuerySyntaxError),
        ("exec px", QuerySyntaxError), ("exec px,sz from trades", QuerySyntaxError), ("update a:1", QuerySyntaxError), ("update from trades", QuerySyntaxError), ("delete px", QuerySyntaxError), ("delete px from trades where px>1", QuerySyntaxError),
        ("select sum sym from trades", QueryTypeError), ("select px, sum px from trades", LengthError), ("select from trades where px>`a", QueryTypeError), ('select "abc from trades', QuerySyntaxError), ("select px§ from trades", QuerySyntaxError),
        ("select px[1] from trades", QueryTypeError), ("select mavg[px;px] from trades", QueryTypeError), ("select wavg[px] from trades", QueryTypeError), ("select zz:. px from trades", QueryError), ("delete zz from trades", UnknownName),
    ],
)
def test_errors(s, text, error):
    with pytest.raises(error):
        s.q(text)


def test_order_is_needed(spark):
    s = Session(t=spark.range(3))
    with pytest.raises(QueryError):
        s.q("select first id from t")
    with pytest.raises(QueryError):
        s.q("select sums id from t")


def test_tokens():
    kinds = [(t.kind, t.value) for t in tokenize("a-1 -2 3 `x`y 101b 0n \"q\\\"r\" 10:00:05.250")]
    assert kinds[:2] == [("name", "a"), ("verb", "-")]
    assert ("literal", ["x", "y"]) in kinds and ("literal", [True, False, True]) in kinds and ("literal", 'q"r') in kinds and ("literal", 36005250) in kinds
    assert parse("select a from t where b=1").where[0].verb == "="
