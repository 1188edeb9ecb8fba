"""A small expression language over date x asset panels, compiled to Spark plans and to SQL.

Nodes are values (equal expressions are one node). Compiling gives every windowed node one column in the stage after its
children's, so sub-expressions that several signals share are computed once, and all frames over (asset, date) share one
exchange and one sort. Missing values are nulls, never NaN; a rolling operator gives a value only where its window is
full of values; division by zero gives null. Comparisons and cross-sectional ranks look at nine decimals, so that the mean of
equal values equals them whatever the order of summation. Everything runs in the JVM.

Semantics of the operators follow pandas where it has them: rolling(n) with min_periods=n, sample deviations, average
ties in ranks, bias-corrected skewness, ewm(adjust=True, ignore_na=False). Exponential weights are cut off where they
fall below 1e-13, which makes every operator but ffill, bfill and the full-history ones look back a known number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Trading days of the named windows.
WEEK, WEEK_2, WEEK_3, MONTH, MONTH_2, MONTH_4, MONTH_7, MONTH_9, QUARTER, HALF, YEAR, MONTHS_60, MONTHS_69 = 5, 10, 15, 21, 42, 84, 147, 189, 63, 126, 252, 1260, 1449

_TINY = 1e-13
_COMPARE = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}
_ROLLING = {"mean", "sum", "std", "min", "max", "skew", "rank", "decay", "ewm", "ewm_std", "ewsum", "corr", "cov", "any_mean"}
_LAGGED = {"delay", "delta", "pct"}
_CROSS = {"xrank", "xmean", "xscale", "xothers", "xmax", "xmin"}
_FULL = {"ffill", "ffill_n", "bfill", "full_mean", "full_std", "full_quantile", "cumprod", "cummax", "cumsum"}


@dataclass(frozen=True)
class Node:
    """An operator with its operands (nodes) and parameters (numbers, names)."""

    op: str
    args: tuple[Node, ...] = ()
    params: tuple = field(default=())

    def __add__(self, o): return Node("add", (self, lift(o)))
    def __radd__(self, o): return Node("add", (lift(o), self))
    def __sub__(self, o): return Node("sub", (self, lift(o)))
    def __rsub__(self, o): return Node("sub", (lift(o), self))
    def __mul__(self, o): return Node("mul", (self, lift(o)))
    def __rmul__(self, o): return Node("mul", (lift(o), self))
    def __truediv__(self, o): return Node("div", (self, lift(o)))
    def __rtruediv__(self, o): return Node("div", (lift(o), self))
    def __neg__(self): return Node("neg", (self,))
    def __gt__(self, o): return Node("gt", (self, lift(o)))
    def __ge__(self, o): return Node("ge", (self, lift(o)))
    def __lt__(self, o): return Node("lt", (self, lift(o)))
    def __le__(self, o): return Node("le", (self, lift(o)))
    def __and__(self, o): return Node("and", (self, lift(o)))
    def __or__(self, o): return Node("or", (self, lift(o)))
    def __invert__(self): return Node("not", (self,))

    @cached_property
    def windowed(self) -> bool:
        return self.op in _ROLLING or self.op in _LAGGED or self.op in _CROSS or self.op in _FULL or self.op == "row"

    @cached_property
    def look_back(self) -> float:
        """Rows before the current one that the value depends on; infinite for full-history operators."""
        below = max((a.look_back for a in self.args), default=0)
        if self.op in _FULL:
            return below + self.params[0] if self.op == "ffill_n" else math.inf
        if self.op in _ROLLING:
            return below + self.params[0] - 1
        return below + (self.params[0] if self.op in _LAGGED else 0)


def lift(x) -> Node:  # noqa: ANN001 - number, boolean or node
    return x if isinstance(x, Node) else Node("const", (), (x,))


def stream(name: str) -> Node: return Node("stream", (), (name,))
def eq(x: Node, y) -> Node: return Node("eq", (x, lift(y)))
def ne(x: Node, y) -> Node: return Node("ne", (x, lift(y)))
def ts_mean(x: Node, n: int = MONTH) -> Node: return Node("mean", (x,), (n,))
def ts_any_mean(x: Node, n: int) -> Node: return Node("any_mean", (x,), (n,))  # min_periods=1
def ts_sum(x: Node, n: int = MONTH) -> Node: return Node("sum", (x,), (n,))
def ts_stddev(x: Node, n: int) -> Node: return Node("std", (x,), (n,))
def ts_min(x: Node, n: int) -> Node: return Node("min", (x,), (n,))
def ts_max(x: Node, n: int) -> Node: return Node("max", (x,), (n,))
def ts_skew(x: Node, n: int) -> Node: return Node("skew", (x,), (n,))
def ts_rank(x: Node, n: int) -> Node: return Node("rank", (x,), (n,))
def ts_decay_exp_window(x: Node, n: int, factor: float) -> Node: return Node("decay", (x,), (n, factor))
def correlation(x: Node, y: Node, n: int = MONTH) -> Node: return Node("corr", (x, y), (n,))
def covariance(x: Node, y: Node, n: int = MONTH) -> Node: return Node("cov", (x, y), (n,))
def ts_delay(x: Node, n: int = 1) -> Node: return x if n == 0 else Node("delay", (x,), (n,))
def delta(x: Node, n: int = 1) -> Node: return Node("delta", (x,), (n,))
def ts_pct_change(x: Node, n: int = 1) -> Node: return Node("pct", (x,), (n,))
def ts_ffill(x: Node, limit: int | None = None) -> Node: return Node("ffill_n", (x,), (limit,)) if limit else Node("ffill", (x,))
def ts_bfill(x: Node) -> Node: return Node("bfill", (x,))
def cum_prod(x: Node) -> Node: return Node("cumprod", (x,))
def cum_max(x: Node) -> Node: return Node("cummax", (x,))
def cum_sum(x: Node) -> Node: return Node("cumsum", (x,))
def full_mean(x: Node) -> Node: return Node("full_mean", (x,))
def full_std(x: Node) -> Node: return Node("full_std", (x,))
def full_quantile(x: Node, q: float) -> Node: return Node("full_quantile", (x,), (q,))
def rank(x: Node) -> Node: return Node("xrank", (x,))
def cross_mean(x: Node) -> Node: return Node("xmean", (x,))
def cross_max(x: Node) -> Node: return Node("xmax", (x,))
def cross_min(x: Node) -> Node: return Node("xmin", (x,))
def others_mean(x: Node) -> Node: return Node("xothers", (x,))
def scale(x: Node) -> Node: return Node("xscale", (x,))
def neutralise(x: Node) -> Node: return x - cross_mean(x)
def keep_extremes(x: Node) -> Node: return ts_where(x, eq(x, cross_max(x)) | eq(x, cross_min(x)), 0.0)
def safe_div(x: Node, y) -> Node: return x / y
def ts_where(x, cond: Node, other) -> Node: return Node("where", (lift(x), cond, lift(other)))
def indicator(cond: Node) -> Node: return ts_where(1.0, cond, 0.0)
def fill(x: Node, value: float) -> Node: return Node("coalesce", (x, lift(value)))
def is_null(x: Node) -> Node: return Node("isnull", (x,))
def ts_clip(x: Node, lo: float | None = None, hi: float | None = None) -> Node: return Node("clip", (x,), (lo, hi))
def ts_log10(x: Node) -> Node: return Node("log", (x,), (10.0,))
def log(x: Node, base: float = 10.0) -> Node: return Node("log", (x,), (base,))
def ln(x: Node) -> Node: return Node("log", (x,), (math.e,))
def ts_pow(x: Node, k: float) -> Node: return Node("pow", (x,), (k,))
def exp(x: Node) -> Node: return Node("exp", (x,))
def sign(x: Node) -> Node: return Node("sign", (x,))
def absolute(x: Node) -> Node: return Node("abs", (x,))


def zscore(x: Node, n: int | None = None, eps: float = 0.0) -> Node:
    """Rolling z-score; without a window over the asset's full history."""
    m, s = (ts_mean(x, n), ts_stddev(x, n)) if n else (full_mean(x), full_std(x))
    return (x - m) / (s + eps if eps else s)


def ts_rsi(x: Node, n: int = 14) -> Node:
    """Relative strength of simple means; a first difference counts as 0; no losses: 100, nothing at all: null."""
    d = delta(x)
    gain, loss = ts_mean(ts_where(d, d > 0, 0.0), n), ts_mean(ts_where(-d, d < 0, 0.0), n)
    return ts_where(ts_where(100.0, gain > 0, None), eq(loss, 0.0), 100.0 - 100.0 / (1.0 + gain / loss))


def _span_rows(alpha: float) -> int:
    return 1 + math.ceil(math.log(_TINY) / math.log(1 - alpha))


def _exponential(op: str, x: Node, a: float) -> Node:
    """Formed at values only; rows without a value keep the last result for as long as weights count."""
    n = _span_rows(a)
    return ts_ffill(ts_where(Node(op, (x,), (n, a)), ~is_null(x), None), n)


def ts_ewm(x: Node, span: float) -> Node:
    return _exponential("ewm", x, 2 / (span + 1))


def smooth_data(x: Node, halflife: float) -> Node:
    return _exponential("ewm", x, 1 - 0.5 ** (1 / halflife))


def ewm_std(x: Node, halflife: float) -> Node:
    """Unbiased, as pandas' ewm().std()."""
    return _exponential("ewm_std", x, 1 - 0.5 ** (1 / halflife))


def compute_z_score(x: Node, mean_halflife: float, volatility_halflife: float, subtract_mean: bool = True, cap: float = 3.0) -> Node:
    top = x - smooth_data(x, mean_halflife) if subtract_mean else x
    return ts_clip(top / ewm_std(x, volatility_halflife), -cap, cap)


def winsorize(x: Node, p: float) -> Node:
    """Clipped to the asset's quantiles p and 1 - p over its history."""
    return Node("least", (Node("greatest", (x, full_quantile(x, p))), full_quantile(x, 1 - p)))


def moving_average_crossover(x: Node, short: int, long: int) -> Node:
    return ts_mean(x, short) - ts_mean(x, long)


def volatility_regime(returns: Node, vol_window: int, avg_window: int, threshold: float, replacement: float) -> Node:
    """1 where the z-score of the averaged volatility lies below the threshold, else the replacement."""
    z = zscore(ts_mean(ts_stddev(returns, vol_window), avg_window), QUARTER)
    return ts_where(1.0, z < threshold, replacement)


ROW = Node("row")


def _weighted_sum(x: Node, keep: float, rows: int) -> Node:
    """Sum of keep**k times the value k rows ago."""
    return Node("ewsum", (x, ROW), (rows, keep))


def lower(node: Node) -> Node:
    """Exponential means and deviations in terms of weighted sums; other nodes as they are."""
    args = tuple(lower(a) for a in node.args)
    if node.op not in ("ewm", "ewm_std"):
        return Node(node.op, args, node.params)
    rows, keep = node.params[0], 1 - node.params[1]
    x = args[0]
    v, here = fill(x, 0.0), ts_where(0.0, is_null(x), 1.0)
    n, d = _weighted_sum(v, keep, rows), _weighted_sum(here, keep, rows)
    if node.op == "ewm":
        return n / d
    mean, square, weights = n / d, _weighted_sum(v * v, keep, rows) / d, _weighted_sum(here, keep * keep, rows)
    spread = square - mean * mean
    spread = ts_where(spread, spread > square * 1e-12, 0.0)
    room = d * d - weights  # 0 for a single value, but for rounding
    return ts_pow(spread * d * d / ts_where(room, room > d * d * 1e-9, None), 0.5)


# ---------------------------------------------------------------- Spark


def _frame(n: int, part: list[str]):  # noqa: ANN202
    return Window.partitionBy(*part).orderBy("date").rowsBetween(-(n - 1), 0)


def _full_of(n: int, value: Column, *xs: Column, part: list[str]) -> Column:
    whole = xs[0].isNotNull()
    for x in xs[1:]:
        whole = whole & x.isNotNull()
    return F.when(F.count_if(whole).over(_frame(n, part)) == n, value)


def _spark_window(node: Node, xs: list[Column], part: list[str]) -> Column:
    x, p = xs[0] if xs else None, node.params
    order = Window.partitionBy(*part).orderBy("date")
    op = node.op
    if op in ("mean", "sum", "min", "max", "std"):
        agg = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}[op]
        return _full_of(p[0], agg(x).over(_frame(p[0], part)), x, part=part)
    if op == "any_mean":
        return F.avg(x).over(_frame(p[0], part))
    if op == "skew":
        n, w = p[0], _frame(p[0], part)
        flat = F.max(x).over(w) == F.min(x).over(w)
        m2, m3 = F.var_pop(x).over(w), F.avg(x * x * x).over(w) - 3 * F.avg(x).over(w) * F.avg(x * x).over(w) + 2 * F.pow(F.avg(x).over(w), F.lit(3.0))
        g1 = F.try_divide(m3, F.pow(m2, F.lit(1.5)))
        return _full_of(n, F.when(~flat, g1 * (math.sqrt(n * (n - 1)) / (n - 2))), x, part=part)
    if op == "rank":
        c = F.collect_list(x).over(_frame(p[0], part))
        return _full_of(p[0], (F.size(F.filter(c, lambda e: e < F.element_at(c, -1))) + (F.size(F.filter(c, lambda e: e == F.element_at(c, -1))) + 1) / F.lit(2.0)) / F.lit(float(p[0])), x, part=part)
    if op == "decay":
        n, f = p
        c = F.collect_list(x).over(_frame(n, part))
        total = sum(f**k for k in range(n))
        return _full_of(n, F.aggregate(c, F.lit(0.0), lambda acc, e: acc * f + e) / F.lit(total), x, part=part)
    if op == "row":
        return F.row_number().over(order)
    if op == "ewsum":
        # blocks of rows, over which the weights change by 1e9 at most: a running sum inside the block, the totals of the two blocks before it
        keep, size = p[1], max(2, int(-math.log(1e9) / math.log(p[1])))
        at, block = F.pmod(xs[1], F.lit(size)), F.floor(xs[1] / size)
        k = F.lit(keep)
        inside = F.sum(x * F.pow(k, -at)).over(Window.partitionBy(*part, block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
        total = x * F.pow(k, size - 1 - at)
        before = [F.coalesce(F.sum(total).over(Window.partitionBy(*part).orderBy(block).rangeBetween(-n, -n)), F.lit(0.0)) for n in (1, 2)]
        return F.pow(k, at) * inside + F.pow(k, at + 1) * (before[0] + before[1] * keep**size)
    if op in ("corr", "cov"):
        n, y = p[0], xs[1]
        w = _frame(n, part)
        cov = F.covar_samp(x, y).over(w)
        if op == "cov":
            return _full_of(n, cov, x, y, part=part)
        flat = (F.max(x).over(w) == F.min(x).over(w)) | (F.max(y).over(w) == F.min(y).over(w))
        return _full_of(n, F.when(~flat, F.try_divide(cov, F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))), x, y, part=part)
    if op in _LAGGED:
        before = F.lag(x, p[0]).over(order)
        return before if op == "delay" else x - before if op == "delta" else F.try_divide(x, before) - 1
    if op == "ffill":
        return F.last(x, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if op == "ffill_n":
        return F.last(x, True).over(order.rowsBetween(-p[0], 0))
    if op == "bfill":
        return F.first(x, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    if op in ("full_mean", "full_std", "full_quantile"):
        w = Window.partitionBy(*part)
        return F.avg(x).over(w) if op == "full_mean" else F.stddev_samp(x).over(w) if op == "full_std" else F.percentile(x, F.lit(p[0])).over(w)
    if op in ("cumprod", "cummax", "cumsum"):
        return {"cumprod": F.product, "cummax": F.max, "cumsum": F.sum}[op](x).over(order.rowsBetween(Window.unboundedPreceding, 0))
    day = Window.partitionBy("date")
    if op == "xrank":
        x = F.round(x, 9)
        by = Window.partitionBy("date").orderBy(x.asc_nulls_last())
        ties = Window.partitionBy("date", x)
        return F.when(x.isNotNull(), (F.rank().over(by) + (F.count("*").over(ties) - 1) / F.lit(2.0)) / F.count(x).over(day))
    if op == "xscale":
        return F.try_divide(x, F.sum(F.abs(x)).over(day))
    if op == "xothers":
        return F.try_divide(F.sum(x).over(day) - x, F.count(x).over(day) - 1)
    return {"xmean": F.avg, "xmax": F.max, "xmin": F.min}[op](x).over(day)


def _spark_scalar(node: Node, xs: list[Column]) -> Column:
    op, p = node.op, node.params
    if op == "const":
        return F.lit(p[0]) if p[0] is not None else F.lit(None).cast("double")
    if op in ("add", "sub", "mul"):
        return {"add": lambda: xs[0] + xs[1], "sub": lambda: xs[0] - xs[1], "mul": lambda: xs[0] * xs[1]}[op]()
    if op == "div":
        return F.try_divide(xs[0], xs[1])
    if op in _COMPARE:
        gap = F.round((xs[0] - xs[1]).cast("double"), 9)
        return {"gt": gap > 0, "ge": gap >= 0, "lt": gap < 0, "le": gap <= 0, "eq": gap == 0, "ne": gap != 0}[op]
    if op in ("and", "or"):
        a, b = (F.coalesce(x, F.lit(False)) for x in xs)
        return a & b if op == "and" else a | b
    x = xs[0]
    if op == "where":
        return F.when(xs[1], x).otherwise(xs[2])
    if op == "clip":
        out = x
        if p[0] is not None:
            out = F.greatest(out, F.lit(p[0]))
        if p[1] is not None:
            out = F.least(out, F.lit(p[1]))
        return F.when(x.isNotNull(), out)
    if op in ("least", "greatest"):
        return F.when(x.isNotNull() & xs[1].isNotNull(), F.least(*xs) if op == "least" else F.greatest(*xs))
    if op == "log":
        return F.when(x > 0, F.ln(x) / F.lit(math.log(p[0])))
    if op == "pow":
        return F.pow(x, F.lit(p[0]))
    if op == "not":
        return ~F.coalesce(x, F.lit(False))
    if op == "coalesce":
        return F.coalesce(*xs)
    if op == "isnull":
        return x.isNull()
    return {"neg": lambda: -x, "abs": lambda: F.abs(x), "sign": lambda: F.signum(x), "exp": lambda: F.exp(x)}[op]()


class Program:
    """Named expressions, in stages: every windowed node and every operand of one is a column of its stage."""

    def __init__(self, outputs: dict[str, Node]) -> None:
        self.outputs = outputs
        self.names: dict[Node, str] = {}
        self.level: dict[Node, int] = {}
        seen: set[Node] = set()
        for node in outputs.values():
            self._name(node, seen)
        for node in seen:
            self._level(node)
        self.stages: list[list[Node]] = [[] for _ in range(1 + max(self.level.values(), default=0))]
        for node in self.names:
            self.stages[self.level[node]].append(node)
        self.look_back = max((n.look_back for n in outputs.values()), default=0)

    def _name(self, node: Node, seen: set[Node]) -> None:
        """Windowed nodes and what they stand on become columns."""
        if node in seen:
            return
        seen.add(node)
        for a in node.args:
            self._name(a, seen)
            if node.windowed and a.op not in ("stream", "const"):
                self.names.setdefault(a, f"v{len(self.names)}")
        if node.windowed:
            self.names.setdefault(node, f"v{len(self.names)}")

    def _level(self, node: Node) -> int:
        """The stage that makes a node's column, or after which it can be written out."""
        if node not in self.level:
            self.level[node] = max((self._level(a) for a in node.args), default=0) + (node in self.names)
        return self.level[node]

    def column_of(self, node: Node, part: list[str], define: bool = False) -> Column:
        if node.op == "stream":
            return F.col(node.params[0])
        if node in self.names and not define:
            return F.col(self.names[node])
        xs = [self.column_of(a, part) for a in node.args]
        return _spark_window(node, xs, part) if node.windowed else _spark_scalar(node, xs)

    def run(self, panel: DataFrame, digits: int | None = 5, chunk_rows: int | None = None) -> DataFrame:
        """panel: date, asset, streams (double). Gives date, asset and the outputs.

        chunk_rows: split each asset's history into chunks of so many days, each led by as many days as the program looks
        back, so a long history of few assets still spreads over many tasks. Only without full-history operators; the
        panel must have one row per day.
        """
        lowered = {k: lower(n) for k, n in self.outputs.items()}
        if lowered != self.outputs:
            return Program(lowered).run(panel, digits, chunk_rows)
        part = ["asset"]
        if chunk_rows is not None:
            if math.isinf(self.look_back):
                raise ValueError("full-history operators need the whole history in one partition")
            day = F.datediff("date", F.lit("1970-01-01").cast("date"))
            own = F.floor(day / chunk_rows)
            last = F.floor((day + int(self.look_back)) / chunk_rows)
            panel = panel.withColumn("chunk", F.explode(F.sequence(own, last))).withColumn("lead", own != F.col("chunk"))
            part = ["asset", "chunk"]
        out = panel
        for stage in self.stages:
            if stage:
                out = out.withColumns({self.names[n]: self.column_of(n, part, define=True) for n in stage})
        if chunk_rows is not None:
            out = out.where(~F.col("lead"))
        cols = []
        for name, node in self.outputs.items():
            c = self.column_of(node, part).cast("double")
            cols.append((F.round(c, digits) + F.lit(0.0) if digits is not None else c).alias(name))
        return out.select("date", "asset", *cols)

    # ------------------------------------------------------------ SQL

    def _sql(self, node: Node, define: bool = False) -> str:
        if node.op == "stream":
            return node.params[0]
        if node in self.names and not define:
            return self.names[node]
        return _sql_of(node, [self._sql(a) for a in node.args])

    def sql(self, panel_sql: str, digits: int = 5) -> str:
        """The same program as a query over the query panel_sql, in common SQL as DuckDB understands it."""
        parts, last = [f"s0 AS ({panel_sql})"], "s0"
        for k, stage in enumerate(self.stages, 1):
            if stage:
                cols = ", ".join(f"{self._sql(n, define=True)} AS {self.names[n]}" for n in stage)
                parts.append(f"s{k} AS (SELECT *, {cols} FROM {last})")
                last = f"s{k}"
        outs = ", ".join(f"round(CAST({self._sql(n)} AS DOUBLE), {digits}) + 0.0 AS {name}" for name, n in self.outputs.items())
        return "WITH " + ",\n".join(parts) + f"\nSELECT date, asset, {outs} FROM {last}"


def _sql_of(node: Node, xs: list[str]) -> str:  # noqa: PLR0911, PLR0912
    op, p = node.op, node.params
    x = xs[0] if xs else ""
    a = "PARTITION BY asset ORDER BY date"

    def over(n: int) -> str:
        return f"OVER ({a} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def whole(n: int, value: str, *cols: str) -> str:
        test = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        return f"CASE WHEN count(CASE WHEN {test} THEN 1 END) {over(n)} = {n} THEN {value} END"

    if op == "const":
        return "CAST(NULL AS DOUBLE)" if p[0] is None else f"CAST({p[0]!r} AS DOUBLE)" if isinstance(p[0], float) else str(p[0])
    if op in ("mean", "sum", "min", "max", "std"):
        f = {"mean": "avg", "std": "stddev_samp"}.get(op, op)
        return whole(p[0], f"{f}({x}) {over(p[0])}", x)
    if op == "any_mean":
        return f"avg({x}) {over(p[0])}"
    if op == "skew":
        return whole(p[0], f"CASE WHEN max({x}) {over(p[0])} > min({x}) {over(p[0])} THEN skewness({x}) {over(p[0])} END", x)
    if op == "rank":
        c = f"list({x}) {over(p[0])}"
        return whole(p[0], f"(len(list_filter({c}, lambda e: e < {x})) + (len(list_filter({c}, lambda e: e = {x})) + 1) / 2.0) / {p[0]}.0", x)
    if op == "decay":
        n, f = p
        total = sum(f**k for k in range(n))
        return whole(n, f"list_sum(list_transform(list({x}) {over(n)}, lambda e, i: e * pow({f!r}, {n} - i))) / {total!r}", x)
    if op in ("ewm", "ewm_std"):
        c, keep = f"list({x}) {over(p[0])}", repr(1 - p[1])
        w = f"pow({keep}, len({c}) - i)"
        d = f"list_sum(list_transform({c}, lambda e, i: CASE WHEN e IS NULL THEN 0 ELSE {w} END))"
        m = f"list_sum(list_transform({c}, lambda e, i: coalesce(e, 0) * {w})) / nullif({d}, 0)"
        if op == "ewm":
            return f"({m})"
        q = f"list_sum(list_transform({c}, lambda e, i: coalesce(e * e, 0) * {w})) / nullif({d}, 0)"
        s = f"list_sum(list_transform({c}, lambda e, i: CASE WHEN e IS NULL THEN 0 ELSE {w} * {w} END))"
        spread = f"CASE WHEN ({q}) - ({m}) * ({m}) > 1e-12 * ({q}) THEN ({q}) - ({m}) * ({m}) ELSE 0 END"
        return f"sqrt({spread} * {d} * {d} / CASE WHEN {d} * {d} - {s} > 1e-9 * {d} * {d} THEN {d} * {d} - {s} END)"
    if op in ("corr", "cov"):
        n, y = p[0], xs[1]
        cov = f"covar_samp({x}, {y}) {over(n)}"
        if op == "cov":
            return whole(n, cov, x, y)
        flat = f"max({x}) {over(n)} = min({x}) {over(n)} OR max({y}) {over(n)} = min({y}) {over(n)}"
        return whole(n, f"CASE WHEN {flat} THEN NULL ELSE {cov} / nullif(stddev_samp({x}) {over(n)} * stddev_samp({y}) {over(n)}, 0) END", x, y)
    if op in _LAGGED:
        lag = f"lag({x}, {p[0]}) OVER ({a})"
        return lag if op == "delay" else f"({x} - {lag})" if op == "delta" else f"({x} / nullif({lag}, 0) - 1)"
    if op == "ffill":
        return f"last_value({x} IGNORE NULLS) OVER ({a} ROWS UNBOUNDED PRECEDING)"
    if op == "ffill_n":
        return f"last_value({x} IGNORE NULLS) {over(p[0] + 1)}"
    if op == "bfill":
        return f"first_value({x} IGNORE NULLS) OVER ({a} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    if op in ("full_mean", "full_std", "full_quantile"):
        f = {"full_mean": f"avg({x})", "full_std": f"stddev_samp({x})", "full_quantile": f"quantile_cont({x}, {p[0] if p else 0})"}[op]
        return f"{f} OVER (PARTITION BY asset)"
    if op in ("cumprod", "cummax", "cumsum"):
        return f"{ {'cumprod': 'product', 'cummax': 'max', 'cumsum': 'sum'}[op] }({x}) OVER ({a} ROWS UNBOUNDED PRECEDING)"
    if op == "xrank":
        x = f"round({x}, 9)"
        return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
    if op == "xscale":
        return f"({x} / nullif(sum(abs({x})) OVER (PARTITION BY date), 0))"
    if op == "xothers":
        return f"((sum({x}) OVER (PARTITION BY date) - {x}) / nullif(count({x}) OVER (PARTITION BY date) - 1, 0))"
    if op in ("xmean", "xmax", "xmin"):
        return f"{ {'xmean': 'avg', 'xmax': 'max', 'xmin': 'min'}[op] }({x}) OVER (PARTITION BY date)"
    if op in ("add", "sub", "mul"):
        return f"({x} { {'add': '+', 'sub': '-', 'mul': '*'}[op] } {xs[1]})"
    if op == "div":
        return f"({x} / nullif({xs[1]}, 0))"
    if op in _COMPARE:
        return f"(round(CAST({x} - {xs[1]} AS DOUBLE), 9) {_COMPARE[op]} 0)"
    if op in ("and", "or"):
        return f"(coalesce({x}, false) {op.upper()} coalesce({xs[1]}, false))"
    if op == "not":
        return f"(NOT coalesce({x}, false))"
    if op == "where":
        return f"(CASE WHEN {xs[1]} THEN {x} ELSE {xs[2]} END)"
    if op == "clip":
        out = x
        if p[0] is not None:
            out = f"greatest({out}, {p[0]})"
        if p[1] is not None:
            out = f"least({out}, {p[1]})"
        return f"(CASE WHEN {x} IS NOT NULL THEN {out} END)"
    if op in ("least", "greatest"):
        return f"(CASE WHEN {x} IS NOT NULL AND {xs[1]} IS NOT NULL THEN {op}({x}, {xs[1]}) END)"
    if op == "log":
        return f"(CASE WHEN {x} > 0 THEN ln({x}) / {math.log(p[0])!r} END)"
    if op == "pow":
        return f"pow({x}, {p[0]})"
    if op == "coalesce":
        return f"coalesce({', '.join(xs)})"
    if op == "isnull":
        return f"({x} IS NULL)"
    return {"neg": f"(-{x})", "abs": f"abs({x})", "sign": f"CAST(sign({x}) AS DOUBLE)", "exp": f"exp({x})"}[op]
