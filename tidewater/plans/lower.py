"""From syntax trees to DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.functions import aggregates as A
from tidewater.functions import math as M
from tidewater.functions import strings as S
from tidewater.functions import temporal as T
from tidewater.functions import windows as W
from tidewater.operators.grouping import last_by
from tidewater.operators.tables import KeyedTable, unkey
from tidewater.plans.lexer import LengthError, QueryError, QueryTypeError, UnknownName
from tidewater.plans.parser import KINDS, Call, Condition, Dyad, Literal, Monad, Name, Statement, parse

SCALARS = {
    "neg": M.neg, "abs": M.absolute, "signum": M.signum, "floor": M.floor, "ceiling": M.ceiling, "sqrt": M.sqrt, "exp": M.exp, "log": M.log,
    "sin": M.sin, "cos": M.cos, "reciprocal": M.reciprocal, "not": M.not_, "null": M.null, "string": S.string, "lower": S.lower, "upper": S.upper,
    "ltrim": S.ltrim, "rtrim": S.rtrim, "trim": S.trim, "year": T.year, "month": T.month, "day": T.day, "dow": T.dow, "hh": T.hh, "mm": T.mm, "sec": T.sec,
    "milli": T.milli, "minute": T.minute, "second": T.second, "stime": T.stime,
    "long": lambda x: M.cast("long", x), "int": lambda x: M.cast("int", x), "float": lambda x: M.cast("float", x), "sym": lambda x: M.cast("sym", x),
    "bool": lambda x: M.cast("bool", x), "char": lambda x: M.cast("char", x),
}
DYADS = {"mod": M.mod, "div": M.div, "xbar": M.xbar, "xlog": M.xlog, "dadd": T.dadd, "ddiff": T.ddiff, "minbar": T.minbar}
AGGREGATES = {
    "sum": A.sum_, "prd": A.prd, "min": A.min_, "max": A.max_, "avg": A.avg, "var": A.var, "dev": A.dev, "svar": A.svar, "sdev": A.sdev, "med": A.med,
    "all": A.all_, "any": A.any_,
}
AGGREGATES2 = {"wsum": A.wsum, "wavg": A.wavg, "cov": A.cov, "scov": A.scov, "cor": A.cor}
RUNNING = {
    "sums": W.sums, "prds": W.prds, "mins": W.mins, "maxs": W.maxs, "deltas": W.deltas, "ratios": W.ratios, "differ": W.differ, "prev": W.prev,
    "next": W.next_, "ret": W.ret, "logret": W.logret,
}
MOVING = {
    "msum": W.msum, "mavg": W.mavg, "mvar": W.mvar, "mdev": W.mdev, "mmin": W.mmin, "mmax": W.mmax, "mprd": W.mprd, "xprev": W.xprev, "movavg": W.movavg,
    "movsum": W.movsum, "movmax": W.movmax, "movmin": W.movmin, "rollstd": W.rollstd,
}
NUMERIC = {"sum", "prd", "avg", "var", "dev", "svar", "sdev", "med", "wsum", "wavg", "cov", "scov", "cor"}


@dataclass
class Table:
    """A registered table: its rows are ordered by ``order``, which running functions and first and last need."""

    df: DataFrame
    order: tuple[str, ...] = ()


@dataclass
class Scope:
    """Where expressions are lowered: the columns, the groups, and a mask of the rows that take part (update with where)."""

    df: DataFrame
    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    mask: Column | None = None
    spread: bool = False  # aggregates stand beside rows
    shared: list[tuple[str, Column]] = field(default_factory=list)
    kinds: dict[str, Any] = field(default_factory=dict)  # types of the shared columns

    def type_of(self, c: Column) -> str:
        rows = self.df.select("*", *(F.lit(None).cast(kind).alias(n) for n, kind in self.kinds.items()))
        return rows.select(c.alias("c")).schema["c"].dataType.typeName()

    def window(self):
        if not self.order:
            raise QueryError("the table has no order, which this function needs")
        extra = [] if self.mask is None else [self.mask]
        return W.spec([*self.by, *extra], self.order)

    def inside(self, c: Column) -> Column:
        return c if self.mask is None else F.when(self.mask, c)

    def aggregate(self, made: Callable[[WindowSpec | None], Column]) -> Column:
        """An aggregate as it is, or its value beside every row: by window within groups, else by one row that is computed once."""
        if not self.spread:
            return made(None)
        if self.by:
            return made(Window.partitionBy(*self.by))
        name = f"_shared{len(self.kinds)}"
        self.shared.append((name, made(None)))
        self.kinds[name] = self.df.agg(made(None).alias("c")).schema["c"].dataType
        return F.col(name)


@dataclass(frozen=True)
class Value:
    column: Column
    shape: str  # atom, aggregate or vector
    literal: Any = None


def _shape(*values: Value) -> str:
    shapes = {v.shape for v in values}
    if "vector" in shapes:
        return "vector"
    return "aggregate" if "aggregate" in shapes else "atom"


def has_vector(node, columns: Sequence[str]) -> bool:
    """Whether the expression has a column that no aggregate takes up."""
    if isinstance(node, Name):
        return node.name in columns
    if isinstance(node, Literal):
        return False
    if isinstance(node, Call):
        if node.function in AGGREGATES or node.function in AGGREGATES2 or node.function in ("count", "first", "last"):
            return False
        return any(has_vector(a, columns) for a in node.arguments)
    if isinstance(node, Monad):
        return False if node.verb in "#*" else has_vector(node.argument, columns)
    if isinstance(node, Dyad):
        return has_vector(node.left, columns) or has_vector(node.right, columns)
    return any(has_vector(b, columns) for b in node.branches)


class Lowering:
    def __init__(self, scope: Scope):
        self.scope = scope

    def value(self, node) -> Value:
        if isinstance(node, Literal):
            return self.literal(node.value)
        if isinstance(node, Name):
            if node.name not in self.scope.df.columns:
                raise UnknownName(f"unknown column {node.name}")
            return Value(F.col(node.name), "vector")
        if isinstance(node, Condition):
            return self.condition(node)
        if isinstance(node, Call):
            return self.call(node)
        if isinstance(node, Monad):
            return self.monad(node)
        return self.dyad(node)

    def literal(self, value) -> Value:
        if isinstance(value, list):
            return Value(F.array(*map(F.lit, value)), "atom", value)
        return Value(F.lit(value), "atom", value)

    def condition(self, node: Condition) -> Value:
        values = [self.value(b) for b in node.branches]
        out: Column | None = None
        for c, v in zip(values[:-1:2], values[1::2]):
            test = self.truth(c.column)
            out = F.when(test, v.column) if out is None else out.when(test, v.column)
        return Value(out.otherwise(values[-1].column), _shape(*values))

    def truth(self, c: Column) -> Column:
        return c if self.scope.type_of(c) == "boolean" else c != 0

    def number(self, function: str, v: Value) -> Column:
        kind = self.scope.type_of(v.column)
        if kind in ("string", "date", "timestamp", "timestamp_ntz", "array"):
            raise QueryTypeError(f"{function} of type {kind}")
        return v.column.cast("int") if kind == "boolean" else v.column

    def aggregated(self, node, function: str) -> tuple[Value, Column]:
        """Argument of an aggregate, rows outside the mask left out. Within it, nested aggregates stand beside rows."""
        was, self.scope.spread = self.scope.spread, True
        try:
            v = self.value(node)
        finally:
            self.scope.spread = was
        c = self.number(function, v) if function in NUMERIC else v.column
        return v, self.scope.inside(c)

    def call(self, node: Call) -> Value:
        f, args = node.function, node.arguments
        if f in self.scope.df.columns:
            raise QueryTypeError(f"{f} is a column, not a function")
        n = len(args)

        def need(k: int) -> None:
            if n != k:
                raise QueryTypeError(f"{f} takes {k} arguments")

        if f in AGGREGATES:
            need(1)
            _, c = self.aggregated(args[0], f)
            return Value(self.scope.aggregate(lambda over: AGGREGATES[f](c, over=over)), "vector" if self.scope.spread else "aggregate")
        if f in AGGREGATES2:
            need(2)
            c = [self.aggregated(a, f)[1] for a in args]
            return Value(self.scope.aggregate(lambda over: AGGREGATES2[f](*c, over=over)), "vector" if self.scope.spread else "aggregate")
        if f == "count":
            need(1)
            return self.count(args[0])
        if f in ("first", "last"):
            need(1)
            return self.edge(args[0], f)
        if f in SCALARS:
            need(1)
            v = self.value(args[0])
            return Value(SCALARS[f](v.column), v.shape)
        if f in DYADS:
            need(2)
            a, b = (self.value(x) for x in args)
            return Value(DYADS[f](a.column, b.column), _shape(a, b))
        if f in RUNNING:
            need(1)
            return Value(RUNNING[f](self.column(args[0]), self.scope.window()), "vector")
        if f in MOVING:
            need(2)
            return Value(MOVING[f](self.whole(args[0], f), self.column(args[1]), self.scope.window()), "vector")
        if f == "mcount":
            need(2)
            return Value(W.mcount(self.whole(args[0], f), self.scope.window()), "vector")
        if f in ("rank", "xrank"):
            need(1 if f == "rank" else 2)
            by = self.column(args[-1])
            extra = [] if self.scope.mask is None else [self.scope.mask]
            w = W.spec([*self.scope.by, *extra], [by, *self.scope.order])
            return Value(W.rank(w) if f == "rank" else W.xrank(self.whole(args[0], f), w, [*self.scope.by, *extra]), "vector")
        if f == "round":
            need(2)
            v = self.value(args[1])
            return Value(M.round_half_up(self.whole(args[0], f), v.column), v.shape)
        if f == "like":
            need(2)
            v, p = self.value(args[0]), self.value(args[1])
            if not isinstance(p.literal, str):
                raise QueryTypeError("like takes a text as pattern")
            return Value(S.like(v.column, p.literal), v.shape)
        if f == "in":
            need(2)
            v, many = self.value(args[0]), self.value(args[1]).literal
            if many is None:
                raise QueryTypeError("in takes a list")
            return Value(v.column.isin(*(many if isinstance(many, list) else [many])), v.shape)
        if f == "cast":
            need(2)
            kind, v = self.value(args[0]).literal, self.value(args[1])
            return Value(M.cast(str(kind), v.column), v.shape)
        if f == "fby":
            need(2)
            inner, by = args
            if not isinstance(inner, Call) or inner.function not in AGGREGATES:
                raise QueryTypeError("fby takes an aggregate and a group")
            c = self.scope.inside(self.column(inner.arguments[0]))
            return Value(AGGREGATES[inner.function](c, over=Window.partitionBy(self.column(by))), "vector")
        raise UnknownName(f"unknown function {f}")

    def column(self, node) -> Column:
        was, self.scope.spread = self.scope.spread, True
        try:
            return self.value(node).column
        finally:
            self.scope.spread = was

    def whole(self, node, f: str) -> int:
        n = self.value(node).literal
        if not isinstance(n, int) or isinstance(n, bool):
            raise QueryTypeError(f"{f} takes a whole number")
        return n

    def count(self, node) -> Value:
        shape = "vector" if self.scope.spread else "aggregate"
        if isinstance(node, Monad) and node.verb == "?":
            c = self.scope.inside(self.column(node.argument))
            # a set, since a window takes no distinct aggregate
            return Value(self.scope.aggregate(lambda over: F.count_distinct(c) if over is None else F.size(F.collect_set(c).over(over)).cast("long")), shape)
        self.aggregated(node, "count")
        rows = F.count(self.scope.inside(F.lit(1)))
        return Value(self.scope.aggregate(lambda over: rows if over is None else rows.over(over)), shape)

    def edge(self, node, f: str) -> Value:
        _, c = self.aggregated(node, f)
        if not self.scope.order:
            raise QueryError("the table has no order, which first and last need")
        # one column as it is, so that values of fixed width are aggregated by hash
        place = F.col(self.scope.order[0]) if len(self.scope.order) == 1 else F.struct(*self.scope.order)
        place = place if self.scope.mask is None else F.when(self.scope.mask, place)
        made = (F.min_by if f == "first" else F.max_by)(c, place)
        return Value(self.scope.aggregate(lambda over: made if over is None else made.over(over)), "vector" if self.scope.spread else "aggregate")

    def monad(self, node: Monad) -> Value:
        verb = node.verb
        if verb == "#":
            return self.count(node.argument)
        if verb == "*":
            return self.edge(node.argument, "first")
        v = self.value(node.argument)
        kind = self.scope.type_of(v.column)
        if verb == "-":
            return Value(-self.number("-", v), v.shape)
        if verb == "~":
            return Value(~v.column if kind == "boolean" else M.not_(v.column), v.shape)
        if verb == "%":
            return Value(M.sqrt(self.number("%", v)), v.shape)
        if verb == "_":
            return Value(F.lower(v.column) if kind == "string" else F.floor(v.column), v.shape)
        if verb == "^":
            return Value(v.column.isNull(), v.shape)
        if verb == "$":
            return Value(v.column.cast("string"), v.shape)
        if verb == "@":
            return Value(F.typeof(v.column), v.shape)
        raise QueryError(f"{verb} of one argument has no place in a query")

    def dyad(self, node: Dyad) -> Value:
        verb = node.verb
        a, b = self.value(node.left), self.value(node.right)
        shape = _shape(a, b)
        if verb in "<>=~":
            x, y = a.column, b.column
            if verb == "~":
                return Value(x.eqNullSafe(y), shape)
            if isinstance(b.literal, list) or isinstance(a.literal, list):
                raise LengthError("a column and a list differ in length")
            if (self.scope.type_of(x) == "string") != (self.scope.type_of(y) == "string") and None not in (a.literal or 0, b.literal or 0):
                raise QueryTypeError("a text is compared with a number")
            return Value(x < y if verb == "<" else x > y if verb == ">" else x.eqNullSafe(y), shape)
        if verb == "^":
            return Value(F.coalesce(b.column, a.column), shape)
        if verb == "$":
            if isinstance(a.literal, int):
                return Value(S.pad(a.literal, b.column), b.shape)
            return Value(M.cast({"I": "long", "F": "float", "i": "long", "f": "float", "s": "sym", "c": "char", "D": "date", "P": "timestamp"}.get(str(a.literal), str(a.literal)), b.column), b.shape)
        if verb == "," and self.scope.type_of(a.column) == "string":
            return Value(F.concat(a.column, b.column), shape)
        if verb in "&|" and self.scope.type_of(a.column) == self.scope.type_of(b.column) == "boolean":
            return Value(a.column & b.column if verb == "&" else a.column | b.column, shape)
        x, y = self.number(verb, a), self.number(verb, b)
        made = {
            "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: M.fdiv(x, y), "!": lambda: self.turned(a, x, y),
            "&": lambda: M.smaller(x, y), "|": lambda: M.larger(x, y),
        }
        if verb not in made:
            raise QueryError(f"{verb} has no place in a query")
        return Value(made[verb](), shape)

    def turned(self, a: Value, x: Column, y: Column) -> Column:
        """n!x is x mod n; a negative n divides by -n."""
        if isinstance(a.literal, int) and a.literal < 0:
            return F.floor(y / -a.literal).cast("long")
        return M.mod(y, x)


class Session:
    """Tables by name, and queries on them."""

    def __init__(self, **tables: DataFrame | KeyedTable | Table):
        self.tables: dict[str, Table] = {}
        for name, t in tables.items():
            self.define(name, t)

    def define(self, name: str, t: DataFrame | KeyedTable | Table, order: Sequence[str] = ()) -> None:
        self.tables[name] = t if isinstance(t, Table) else Table(unkey(t), tuple(order))

    def q(self, text: str) -> DataFrame | KeyedTable:
        """Run a query: select gives a table, with by a keyed one; exec a table of one column ``value``; update and delete the whole table."""
        return self.run(parse(text))

    def run(self, s: Statement) -> DataFrame | KeyedTable:
        if s.source not in self.tables:
            raise UnknownName(f"unknown table {s.source}")
        t = self.tables[s.source]
        for c in (*s.by, *s.columns):
            if c not in t.df.columns:
                raise UnknownName(f"unknown column {c}")
        return {"select": self._select, "exec": self._exec, "update": self._update, "delete": self._delete}[s.kind](s, t)

    def value(self, text: str):
        """An exec's result as a Python value: a list, or what one aggregate gives."""
        s = parse(text)
        out = [r["value"] for r in self._exec(s, self.tables[s.source], ordered=True).collect()] if s.source in self.tables else self.run(s)
        return out if has_vector(s.items[0].expression, self.tables[s.source].df.columns) else out[0]

    def script(self, text: str) -> DataFrame | KeyedTable | None:
        """Lines of queries, each on its own or as ``name: query``; the last result. Text that is no query, also inside strings, is left alone."""
        out = None
        for line in text.splitlines():
            m = re.match(r"\s*(?:([A-Za-z]\w*)\s*:\s*)?((?:%s)\b.*\bfrom\b.*)" % "|".join(KINDS), line)
            if m:
                out = self.q(m[2])
                if m[1]:
                    self.define(m[1], out)
        return out

    @staticmethod
    def _mask(s: Statement, scope: Scope) -> Column | None:
        """All predicates; NULL counts as false. Each sees the whole table."""
        mask: Column | None = None
        lower = Lowering(scope)
        scope.spread = True
        for p in s.where:
            c = F.coalesce(lower.truth(lower.value(p).column), F.lit(False))
            mask = c if mask is None else mask & c
        scope.spread = False
        return mask

    @staticmethod
    def _shared(df: DataFrame, scope: Scope) -> DataFrame:
        """One row of aggregates, computed once, beside every row."""
        if not scope.shared:
            return df
        row = df.agg(*(c.alias(n) for n, c in scope.shared))
        scope.shared = []
        return df.join(F.broadcast(row))

    def _filtered(self, s: Statement, t: Table) -> DataFrame:
        scope = Scope(t.df, t.order)
        mask = self._mask(s, scope)
        if mask is None:
            return t.df
        inner = any(True for _ in scope.shared)
        df = self._shared(t.df, scope)
        windowed = re.search(r"\b(over|window)\b", str(mask).lower()) is not None
        if windowed:  # a condition with a running function is a column before it is a filter
            df = df.withColumn("_mask", mask).where("_mask")
        else:
            df = df.where(mask)
        return df.select(*t.df.columns) if inner or windowed else df

    @staticmethod
    def _named(s: Statement) -> list[tuple[str, Any]]:
        out = []
        for i, item in enumerate(s.items):
            out.append((item.name or (item.expression.name if isinstance(item.expression, Name) else f"x{i}"), item.expression))
        return out

    def _select(self, s: Statement, t: Table) -> DataFrame | KeyedTable:
        df = self._filtered(s, t)
        items = self._named(s)
        if s.by:
            if not items:
                return last_by(df, s.by, t.order or self._no_order())
            plain, nested, scope = [], [], Scope(df, t.order, s.by)
            for name, e in items:
                if has_vector(e, df.columns):
                    scope.spread = True
                    nested.append((name, Lowering(scope).value(e).column))
                    scope.spread = False
                else:
                    plain.append(Lowering(scope).value(e).column.alias(name))
            for i, (name, c) in enumerate(nested):
                df = df.withColumn(f"_list{i}", c)
                if not t.order:
                    self._no_order()
                rows = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{j}") for j, o in enumerate(t.order)), F.col(f"_list{i}").alias("v"))))
                plain.append(F.transform(rows, lambda r: r["v"]).alias(name))
            made = df.groupBy(*s.by).agg(*plain)
            return KeyedTable(made.select(*s.by, *(n for n, _ in items if n not in s.by)), s.by)
        if not items:
            return df
        shapes = [has_vector(e, df.columns) for _, e in items]
        atoms = [Lowering(Scope(df, t.order)).value(e).shape == "atom" if not v else False for v, (_, e) in zip(shapes, items)]
        if any(shapes):
            if not all(v or a for v, a in zip(shapes, atoms)):
                raise LengthError("aggregates and columns differ in length")
            scope = Scope(df, t.order, spread=True)
            made = [Lowering(scope).value(e).column.alias(n) for n, e in items]
            return self._shared(df, scope).select(*made)
        return df.agg(*(Lowering(Scope(df, t.order)).value(e).column.alias(n) for n, e in items))

    @staticmethod
    def _no_order():
        raise QueryError("the table has no order, which this query needs")

    def _exec(self, s: Statement, t: Table, ordered: bool = False) -> DataFrame:
        df = self._filtered(s, t)
        e = s.items[0].expression
        if not has_vector(e, df.columns):
            return df.agg(Lowering(Scope(df, t.order)).value(e).column.alias("value"))
        scope = Scope(df, t.order, spread=True)
        made = Lowering(scope).value(e).column.alias("value")
        df = self._shared(df, scope)
        return df.withColumn("_value", made).orderBy(*t.order).select(F.col("_value").alias("value")) if ordered and t.order else df.select(made)

    def _update(self, s: Statement, t: Table) -> DataFrame:
        scope = Scope(t.df, t.order)
        mask = self._mask(s, scope)
        df = self._shared(t.df, scope)
        if mask is not None:
            df = df.withColumn("_mask", mask)
            mask = F.col("_mask")
        scope = Scope(df, t.order, s.by, mask, spread=True)
        made = {}
        for name, e in self._named(s):
            c = Lowering(scope).value(e).column
            made[name] = c
        out = self._shared(df, scope)
        for name, c in made.items():
            if mask is not None:
                c = F.when(mask, c).otherwise(F.col(name) if name in t.df.columns else F.lit(None))
            out = out.withColumn(f"_new_{name}", c)
        columns = [F.col(f"_new_{c}").alias(c) if c in made else F.col(c) for c in t.df.columns]
        return out.select(*columns, *(F.col(f"_new_{n}").alias(n) for n in made if n not in t.df.columns))

    def _delete(self, s: Statement, t: Table) -> DataFrame:
        if s.columns:
            return t.df.drop(*s.columns)
        scope = Scope(t.df, t.order)
        mask = self._mask(s, scope)
        if mask is None:
            return t.df.limit(0)
        return self._shared(t.df, scope).where(~mask).select(*t.df.columns)


def qexec(df: DataFrame, mask: Column | None, by: Sequence[str] | None, items: Mapping[str, Column]) -> DataFrame | KeyedTable:
    """The functional form: condition, groups and named columns, of which None leaves out a clause."""
    df = df if mask is None else df.where(mask)
    if by:
        return KeyedTable(df.groupBy(*by).agg(*(c.alias(n) for n, c in items.items())), tuple(by))
    return df.select(*(c.alias(n) for n, c in items.items()))
