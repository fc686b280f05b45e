"""Models of short series as column expressions: one row per series, its values in arrays.

Regressions are solved by sweeping columns out one after another and recursions are folds
over the array. Weights are found by damped Gauss-Newton steps from the best of a few
starts: one fold returns the errors' squares and their derivatives together. Likelihoods
are conditional (the first values are taken as given) and stated for the whole series'
number of values, so that models that skip different numbers of them compare.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starts of the search for weights: autoregressive and moving-average; level, trend and season.
ARMA_STARTS = (-0.8, -0.4, 0.0, 0.4, 0.8)
LEVEL_STARTS, TREND_STARTS, SEASON_STARTS = (0.1, 0.3, 0.6, 0.9), (0.0, 0.1), (0.0, 0.2)
# Steps of the search, the first damping, the bound of ARMA weights and the decimals that weights are given with.
STEPS, DAMPING, BOUND, DECIMALS = 12, 0.001, 0.99, 4
# Short lags of the long autoregression whose residuals stand in for shocks.
LONG_LAGS = 3


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def differences(y: Column, lag: Column | int = 1) -> Column:
    lag = F.lit(lag) if isinstance(lag, int) else lag
    rest = F.greatest(F.size(y) - lag, F.lit(0))
    return F.zip_with(F.slice(y, lag + 1, rest), F.slice(y, 1, rest), lambda a, b: a - b)


def running(a: Column) -> Column:
    """Sums up to each place."""
    state = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums"))
    step = lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["sums"], F.array(s["sum"] + v)).alias("sums"))
    return F.aggregate(a, state, step)["sums"]


def criteria(sse: Column, m: Column, k: Column | int, n: Column | None = None) -> tuple[Column, Column]:
    """AIC and BIC of k parameters; the error variance of m rows, stated for n (m unless given)."""
    k = F.lit(k) if isinstance(k, int) else k
    n = m if n is None else n
    level = n * (F.log(2 * math.pi * F.greatest(sse / m, F.lit(1e-300))) + 1)
    return level + 2 * k, level + k * F.log(n.cast("double"))


def swept(columns: Column, steps: Column) -> Column:
    """The columns left when the first ``steps`` have been regressed out, one by one.

    A struct: ``left`` (arrays, the last one is the target) and ``sse``, the target's sum
    of squares after each step. A column without anything of its own explains nothing.
    """

    def without(rest: Column, pivot: Column) -> Column:
        shares = let(dot(pivot, pivot), lambda size: F.transform(
            rest, lambda c: F.struct(c.alias("c"), F.when(size > 1e-12, dot(c, pivot) / size).otherwise(0.0).alias("k"))
        ))
        return F.transform(shares, lambda s: F.zip_with(s["c"], pivot, lambda a, b: a - b * s["k"]))

    def step(state: Column, _: Column) -> Column:
        rest = F.slice(state["left"], 2, F.size(state["left"]) - 1)
        return let(
            without(rest, state["left"][0]),
            lambda left: F.struct(
                left.alias("left"), F.concat(state["sse"], F.array(let(F.element_at(left, -1), lambda t: dot(t, t)))).alias("sse")
            ),
        )

    start = F.struct(columns.alias("left"), F.array().cast("array<double>").alias("sse"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step)


def largest_lag(n: Column, max_lag: int | None) -> Column:
    most = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2)).cast("int")
    return most if max_lag is None else F.least(most, F.lit(max_lag))


def _lagged(dy: Column, lag: Column, rows: Column, count: Column) -> Column:
    """``count`` columns: differences 1 … count steps before the last ``rows`` ones."""
    back = F.filter(F.sequence(F.lit(0), count), lambda j: j > 0)
    return F.transform(back, lambda j: F.slice(dy, lag + 1 - j, rows))


def unit_root_lag(y: Column, most: Column) -> Column:
    """Lagged differences, up to ``most``, with the lowest AIC on a common sample."""
    dy = differences(y)
    rows = F.size(dy) - most
    columns = F.concat(
        F.array(F.array_repeat(F.lit(1.0), rows), F.slice(y, most + 1, rows)), _lagged(dy, most, rows, most), F.array(F.slice(dy, most + 1, rows))
    )
    sse = F.slice(swept(columns, most + 2)["sse"], 2, most + 1)
    aic = F.transform(sse, lambda s, p: criteria(s, rows, p + 2)[0])
    return let(aic, lambda a: F.array_position(a, F.array_min(a)).cast("int") - 1)


def unit_root_t(y: Column, lag: Column) -> Column:
    """t statistic of the last value in the regression of the next difference."""
    dy = differences(y)
    rows = F.size(dy) - lag
    columns = F.concat(
        F.array(F.array_repeat(F.lit(1.0), rows)), _lagged(dy, lag, rows, lag), F.array(F.slice(y, lag + 1, rows), F.slice(dy, lag + 1, rows))
    )
    free = rows - lag - 2
    own = let(swept(columns, lag + 1)["left"], lambda left: _last_step(left[0], left[1]))
    return let(own, lambda s: F.when((free > 0) & (s["size"] > 1e-12) & (s["sse"] > 0), s["beta"] / F.sqrt(s["sse"] / free / s["size"])))


def _last_step(x: Column, target: Column) -> Column:
    """Coefficient of the one column left, its own sum of squares and that of the rest."""

    def rest(s: Column) -> Column:
        sse = total(F.zip_with(target, x, lambda t, v: (t - s["beta"] * v) * (t - s["beta"] * v)))
        return F.struct(s["beta"].alias("beta"), s["size"].alias("size"), sse.alias("sse"))

    share = let(dot(x, x), lambda size: F.struct(F.when(size > 1e-12, dot(x, target) / size).otherwise(0.0).alias("beta"), size.alias("size")))
    return let(share, rest)


# The searches are written as SQL text: one text is parsed at once, where thousands of calls would build it.


def _once(value: str, name: str, use: str) -> str:
    """``use`` with ``value``, worked out once, under a name."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _fields(**values: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def _starts(rows: Sequence[Sequence[float]]) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{float(v)}D" for v in row) + ")" for row in rows) + ")"


def _searched(starts: Sequence[Sequence[float]], loss: str, run: str, move: str) -> Column:
    """Weights after the damped steps from the best start, ties to the smaller weights.

    ``loss`` gives the sum of squares at weights ``k``, ``run`` that and the sums for a step;
    ``move`` gives the next weights from the state ``g`` (at, run, damping). A step that does
    not lower the loss is taken back and damped more.
    """
    first = f"array_min(transform({_starts(starts)}, k -> {_fields(sse=loss, w='k')})).w"
    begun = _once(first, "k", _fields(at="k", run=run, damping=f"{DAMPING}D"))
    better = _fields(at="t.at", run="t.run", damping="g.damping * 0.1D")
    worse = _fields(at="g.at", run="g.run", damping="g.damping * 10D")
    tried = _once(move, "k", _fields(at="k", run=run))
    step = _once(tried, "t", f"CASE WHEN t.run.sse < g.run.sse THEN {better} ELSE {worse} END")
    return F.expr(f"transform(aggregate(sequence(1, {STEPS}), {begun}, (g, i) -> {step}).at, k -> round(k, {DECIMALS}))")


def arma_errors(w: Column, weights: Column) -> Column:
    """Last error and sum of squares of an ARMA(1,1) run through ``w``."""

    def step(s: Column, v: Column) -> Column:
        now = v - weights[0] * s["before"] - weights[1] * s["e"]
        return let(now, lambda e: F.struct(v.alias("before"), e.alias("e"), (s["sse"] + e * e).alias("sse")))

    start = F.struct(w[0].alias("before"), F.lit(0.0).alias("e"), F.lit(0.0).alias("sse"))
    return F.aggregate(F.slice(w, 2, F.size(w) - 1), start, step)


def arma_weights(w: str, given: Sequence[float] | None) -> Column:
    """Autoregressive and moving-average weight of the lowest sum of squares of the column ``w``, or those given."""
    if given is not None:
        return F.array(*[F.lit(float(v)) for v in given])
    error = "v - k[0] * s.before - k[1] * s.e"
    values = f"slice({w}, 2, size({w}) - 1)"
    more = _once(error, "e", _fields(before="v", e="e", sse="s.sse + e * e"))
    loss = f"aggregate({values}, {_fields(before=f'{w}[0]', e='0D', sse='0D')}, (s, v) -> {more}).sse"
    # p and q are the error's derivatives by the two weights.
    now = _fields(e=error, p="-s.before - k[1] * s.p", q="-s.e - k[1] * s.q")
    sums = {"sse": "n.e * n.e", "pp": "n.p * n.p", "pq": "n.p * n.q", "qq": "n.q * n.q", "pe": "n.p * n.e", "qe": "n.q * n.e"}
    step = _once(now, "n", _fields(before="v", e="n.e", p="n.p", q="n.q", **{c: f"s.{c} + {x}" for c, x in sums.items()}))
    zero = _fields(before=f"{w}[0]", **dict.fromkeys(["e", "p", "q", *sums], "0D"))
    size = "(g.run.pp * (1 + g.damping) * g.run.qq * (1 + g.damping) - g.run.pq * g.run.pq)"
    ways = ("g.run.qe * g.run.pq - g.run.pe * g.run.qq * (1 + g.damping)", "g.run.pe * g.run.pq - g.run.qe * g.run.pp * (1 + g.damping)")
    at = [f"CASE WHEN {size} > 1e-300D THEN least({BOUND}D, greatest(-{BOUND}D, g.at[{i}] + ({way}) / {size})) ELSE g.at[{i}] END" for i, way in enumerate(ways)]
    starts = [(a, b) for a in ARMA_STARTS for b in ARMA_STARTS]
    return _searched(starts, loss, f"aggregate({values}, {zero}, (s, v) -> {step})", f"array({', '.join(at)})")


def arma_forecast(y: Column, w: Column, centre: Column, d: Column, weights: Column, periods: int) -> Column:
    """(mean, half, aic, bic) of ARIMA(1,d,1), d zero or one; a constant only without differencing."""
    return let(arma_errors(w, weights), lambda end: _arma_ahead(y, w, centre, d, weights, periods, end))


def _arma_ahead(y: Column, w: Column, centre: Column, d: Column, weights: Column, periods: int, end: Column) -> Column:
    m = F.size(w) - 1
    phi, theta = weights[0], weights[1]
    first = phi * F.element_at(w, -1) + theta * end["e"]
    steps = F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda h: first * F.pow(phi, h.cast("double")))
    psi = F.transform(
        F.sequence(F.lit(0), F.lit(periods - 1)), lambda h: F.when(h == 0, 1.0).otherwise((phi + theta) * F.pow(phi, (h - 1).cast("double")))
    )
    level = F.transform(running(steps), lambda v: F.element_at(y, -1) + v)
    ahead = F.when(d == 1, level).otherwise(F.transform(steps, lambda v: centre + v))
    aic, bic = criteria(end["sse"], m, F.when(d == 1, 3).otherwise(4), F.size(y))
    return F.struct(ahead.alias("mean"), _band(F.when(d == 1, running(psi)).otherwise(psi), end["sse"] / m).alias("half"), aic.alias("aic"), bic.alias("bic"))


def _band(psi: Column, variance: Column) -> Column:
    """Half widths at 95 % from the responses to one shock."""
    return F.transform(running(F.transform(psi, lambda p: p * p)), lambda s: 1.96 * F.sqrt(variance * s))


def _seasonal_start(y: Column, season: int) -> Column:
    """Level, trend and a queue of seasons around the line through the first two seasons' middles."""
    halves = F.array(mean(F.slice(y, 1, season)), mean(F.slice(y, season + 1, season)))

    def begun(a: Column) -> Column:
        slope = (a[1] - a[0]) / season
        seasons = F.transform(F.slice(y, 1, season), lambda v, k: v - (a[0] + slope * (k - (season - 1) / 2)))
        level = a[0] - slope * (season + 1) / 2
        return F.struct(level.alias("level"), slope.alias("trend"), seasons.alias("seasons"), F.lit(0.0).alias("sse"))

    return let(halves, begun)


def seasonal_run(y: Column, season: int, weights: Column) -> Column:
    """Level, trend, seasons (that of the next value first) and sum of squares of additive smoothing.

    ``weights`` are the shares of an error that go to level, trend and season.
    """

    def step(s: Column, v: Column) -> Column:
        return let(v - s["level"] - s["trend"] - s["seasons"][0], lambda e: F.struct(
            (s["level"] + s["trend"] + weights[0] * e).alias("level"), (s["trend"] + weights[1] * e).alias("trend"),
            F.concat(F.slice(s["seasons"], 2, season - 1), F.array(s["seasons"][0] + weights[2] * e)).alias("seasons"),
            (s["sse"] + e * e).alias("sse"),
        ))

    return F.aggregate(y, _seasonal_start(y, season), step)


def shares(level: float, trend: float, season: float) -> tuple[float, float, float]:
    """What share of an error goes to level, trend and season, for the usual smoothing weights."""
    return level, level * trend, season * (1 - level)


def seasonal_weights(y: str, season: int, given: Sequence[float] | None) -> Column:
    """Shares of the error for level, trend and season of the lowest sum of squares of the column ``y``, or those of the weights given."""
    if given is not None:
        return F.array(*[F.lit(float(v)) for v in shares(*given)])
    ways, pairs = ("a", "b", "c"), ("aa", "ab", "ac", "bb", "bc", "cc")  # by the shares of level, trend and season

    def start(own: str, **more: str) -> str:
        sums = [f"aggregate(slice({y}, {1 + k * season}, {season}), 0D, (s, v) -> s + v) / {season}" for k in range(2)]
        seasons = f"transform(slice({y}, 1, {season}), (v, j) -> {own})"
        line = _fields(level=f"h[0] - b * {season + 1} / 2", trend="b", seasons=seasons, sse="0D", **more)
        return _once(f"array({', '.join(sums)})", "h", _once(f"(h[1] - h[0]) / {season}", "b", line))

    value = f"v - (h[0] + b * (j - {(season - 1) / 2}D))"
    queue = lambda last: f"concat(slice(s.seasons, 2, {season - 1}), array({last}))"
    moved = {"level": "s.level + s.trend + k[0] * e", "trend": "s.trend + k[1] * e"}
    step = _once("v - s.level - s.trend - s.seasons[0]", "e", _fields(**moved, seasons=queue("s.seasons[0] + k[2] * e"), sse="s.sse + e * e"))
    loss = f"aggregate({y}, {start(value)}, (s, v) -> {step}).sse"

    # The same with the derivatives of error, level, trend and season by each share.
    errors = _fields(e="v - s.level - s.trend - s.seasons[0].s", **{x: f"-(s.level_{x} + s.trend_{x} + s.seasons[0].{x})" for x in ways})
    part = lambda i, x: f"{'d.e + ' if ways[i] == x else ''}k[{i}] * d.{x}"
    season_now = _fields(s="s.seasons[0].s + k[2] * d.e", **{x: f"s.seasons[0].{x} + ({part(2, x)})" for x in ways})
    sums = {x + "e": f"d.{x} * d.e" for x in ways} | {p: f"d.{p[0]} * d.{p[1]}" for p in pairs}
    slopes = _once(errors, "d", _fields(
        level="s.level + s.trend + k[0] * d.e", trend="s.trend + k[1] * d.e", seasons=queue(season_now), sse="s.sse + d.e * d.e",
        **{f"level_{x}": f"s.level_{x} + s.trend_{x} + ({part(0, x)})" for x in ways},
        **{f"trend_{x}": f"s.trend_{x} + ({part(1, x)})" for x in ways}, **{c: f"s.{c} + {x}" for c, x in sums.items()},
    ))
    zeros = dict.fromkeys([*[f"level_{x}" for x in ways], *[f"trend_{x}" for x in ways], *sums], "0D")
    begun = start(_fields(s=value, a="0D", b="0D", c="0D"), **zeros)
    run = _once(f"aggregate({y}, {begun}, (s, v) -> {slopes})", "s", _fields(sse="s.sse", **{c: f"s.{c}" for c in sums}))

    damped = _fields(**{p: f"g.run.{p}" + (" * (1 + g.damping)" if p[0] == p[1] else "") for p in pairs}, **{x + "e": f"g.run.{x}e" for x in ways})
    size = "r.aa * (r.bb * r.cc - r.bc * r.bc) - r.ab * (r.ab * r.cc - r.bc * r.ac) + r.ac * (r.ab * r.bc - r.bb * r.ac)"
    turns = (
        "r.ae * (r.bb * r.cc - r.bc * r.bc) - r.ab * (r.be * r.cc - r.bc * r.ce) + r.ac * (r.be * r.bc - r.bb * r.ce)",
        "r.aa * (r.be * r.cc - r.bc * r.ce) - r.ae * (r.ab * r.cc - r.bc * r.ac) + r.ac * (r.ab * r.ce - r.be * r.ac)",
        "r.aa * (r.bb * r.ce - r.be * r.bc) - r.ab * (r.ab * r.ce - r.be * r.ac) + r.ae * (r.ab * r.bc - r.bb * r.ac)",
    )
    at = [f"g.at[{i}] - CASE WHEN z > 1e-300D THEN ({turn}) / z ELSE 0D END" for i, turn in enumerate(turns)]
    # Level and season share what there is: what both together have too much is taken from both.
    raw = _fields(l=f"least({BOUND}D, greatest({1 - BOUND}D, {at[0]}))", c=f"least(1D, greatest(0D, {at[2]}))")
    level = _once("greatest(0D, q.l + q.c - 1) / 2", "x", _fields(l=f"greatest({1 - BOUND}D, q.l - x)", c="greatest(0D, q.c - x)"))
    bound = _once(level, "p", f"array(p.l, least(p.l, greatest(0D, {at[1]})), least(1 - p.l, p.c))")
    move = _once(damped, "r", _once(size, "z", _once(raw, "q", bound)))
    starts = [shares(a, b, c) for a in LEVEL_STARTS for b in TREND_STARTS for c in SEASON_STARTS]
    return _searched(starts, loss, run, move)


def seasonal_forecast(y: Column, season: int, weights: Column, periods: int) -> Column:
    """(mean, half, aic, bic) of additive level, trend and season."""
    return let(seasonal_run(y, season, weights), lambda end: _seasonal_ahead(y, season, weights, periods, end))


def _seasonal_ahead(y: Column, season: int, weights: Column, periods: int, end: Column) -> Column:
    n = F.size(y)
    steps = F.sequence(F.lit(0), F.lit(periods - 1))
    ahead = F.transform(steps, lambda h: end["level"] + end["trend"] * (h + 1) + end["seasons"][h % season])
    shock = F.transform(
        steps, lambda h: F.when(h == 0, 1.0).otherwise(weights[0] + weights[1] * h + F.when(h % season == 0, weights[2]).otherwise(0.0))
    )
    aic, bic = criteria(end["sse"], n, 5 + season)
    return F.struct(ahead.alias("mean"), _band(shock, end["sse"] / n).alias("half"), aic.alias("aic"), bic.alias("bic"))


def least_squares(columns: Sequence[Column], target: Column) -> tuple[list[Column], Column]:
    """Coefficients, each from sweeping all other columns out first, and the sum of squares."""
    out, sse = [], None
    for i, own in enumerate(columns):
        others = [c for j, c in enumerate(columns) if j != i]
        state = swept(F.array(*others, own, target), F.lit(len(others))) if others else F.struct(F.array(own, target).alias("left"))
        last = let(state["left"], lambda left: _last_step(left[0], left[1]))
        out.append(last["beta"])
        sse = last["sse"]
    return out, sse
