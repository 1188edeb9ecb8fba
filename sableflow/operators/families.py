"""Families of signals over the panel's streams: templates with grids of parameters.

A family is a dict of named expressions; ids end in the parameters. The registry holds all of them; programs of a
family share sub-expressions, so a whole family costs little more than its most demanding member.
"""

from __future__ import annotations

from itertools import product

from sableflow.functions import signal as s
from sableflow.functions.signal import Node, stream

close, high, low, open_, volume, interest = (s.ts_ffill(stream(x)) for x in ("close_price", "high_price", "low_price", "open_price", "volume", "open_interest"))
stock_in, stock_out, warrant, cancelled, closing = (s.ts_ffill(stream(x)) for x in ("stock_in", "stock_out", "on_warrant", "cancelled_stock", "closing_stock"))
gdp, gdp2, pmi, vix, fx = (s.ts_ffill(stream(x)) for x in ("us_gdp", "cn_gdp", "us_pmi", "us_vix", "fx_cny"))
WINDOWS = (5, 10, 15, 21)
PAIRS = ((5, 21), (10, 21), (10, 42), (21, 63))


def ma_vs_ma() -> dict[str, Node]:
    out = {}
    for (name, x), (a, b) in product((("close", close), ("volume", volume), ("vix", vix)), PAIRS):
        gap = s.ts_mean(x, a) - s.ts_mean(x, b)
        out[f"{name}_{a}_{b}"] = gap
        out[f"{name}_{a}_{b}_rel"] = s.safe_div(gap, x)
    return out


def delta_of_rank() -> dict[str, Node]:
    return {f"r{a}_{b}": s.delta(s.ts_rank(cancelled, a), a) - s.delta(s.ts_rank(stock_out, b), b) for a, b in ((5, 10), (10, 5), (10, 21))} | {
        f"f{a}_{b}": s.delta(gdp, a) - s.delta(close, b) for a, b in PAIRS
    }


def corr_minus_corr() -> dict[str, Node]:
    return {f"minus_{a}_{b}": s.correlation(close, volume, a) - s.correlation(close, vix, b) for a, b in PAIRS} | {
        f"over_{a}_{b}": s.ts_clip(s.safe_div(s.correlation(close, interest, a), s.correlation(close, fx, b)), -50.0, 50.0) for a, b in PAIRS
    }


def rsi_gated_corr() -> dict[str, Node]:
    out = {}
    for n, lo, hi, sign in product((10, 21), (30.0, 45.0), (55.0, 70.0), (1.0, -1.0)):
        r, c = s.ts_rsi(close, 14), s.correlation(stock_in, fx, n)
        out[f"n{n}_{lo:.0f}_{hi:.0f}_{'p' if sign > 0 else 'm'}"] = (c + c * (s.indicator(r < lo) - s.indicator(r > hi))) * sign
    return out


def sma_gated_volume() -> dict[str, Node]:
    return {f"{k}_{n}": (s.indicator(x <= s.ts_mean(x, n)) - s.indicator(x > s.ts_mean(x, n))) * volume for (k, x), n in product((("close", close), ("stock", stock_in), ("closing", closing)), WINDOWS)}


def sma_gated_corr() -> dict[str, Node]:
    gate = {n: s.indicator(close <= s.ts_mean(close, n)) - s.indicator(close > s.ts_mean(close, n)) for n in WINDOWS}
    return {f"g{n}_c{m}": gate[n] * s.correlation(close, interest, m) * volume for n, m in product(WINDOWS, (10, 21))}


def rsi_sma_gated() -> dict[str, Node]:
    out = {}
    for n, m, (lo, hi) in product((10, 14), (10, 21), ((30.0, 70.0), (40.0, 60.0))):
        r, mean = s.ts_rsi(close, n), s.ts_mean(close, m)
        out[f"r{n}_m{m}_{lo:.0f}_{hi:.0f}"] = (s.indicator((r <= lo) & (close <= mean)) - s.indicator((r >= hi) & (close >= mean))) * volume
    return out


def macro_momentum() -> dict[str, Node]:
    out = {}
    for (k, x), n in product((("gdp", gdp), ("pmi", pmi), ("gdp2", gdp2)), (21, 63)):
        m = s.ts_mean(x, n)
        out[f"{k}_{n}"] = s.zscore(m - s.ts_delay(m, 63), 126)
        out[f"{k}_{n}_rel"] = s.zscore(s.safe_div(m, s.ts_delay(m, 63)), 126)
    return out


def ratio_spread() -> dict[str, Node]:
    pairs = (("close_gdp", close, gdp), ("stock_flow", stock_in, stock_out), ("high_low", high, low), ("int_vol", interest, volume))
    return {f"{k}_{n}": s.zscore(s.safe_div(s.ts_mean(x, n), s.ts_mean(y, n)), 42) for (k, x, y), n in product(pairs, (5, 21))} | {
        f"{k}_spread_{n}": s.zscore(s.ts_pct_change(x, n) - s.ts_pct_change(y, n), 42) for (k, x, y), n in product(pairs, (5, 21))
    }


def std_minus_std() -> dict[str, Node]:
    return {f"{k}_{a}_{b}": s.ts_stddev(x, a) - s.ts_stddev(y, b) for (k, x, y), (a, b) in product((("close_vix", close, vix), ("in_out", stock_in, stock_out)), PAIRS)}


def cross_market_corr() -> dict[str, Node]:
    out = {}
    for (k, x, y), n, sign in product((("gdp_vix", s.delta(gdp, 21), vix), ("pmi_fx", pmi, fx), ("close_fx", s.ts_pct_change(close), s.ts_pct_change(fx))), (21, 42, 63), (1.0, -1.0)):
        out[f"{k}_{n}_{'p' if sign > 0 else 'm'}"] = s.correlation(x, y, n) * sign
    return out


def divergence() -> dict[str, Node]:
    return {f"rev_{k}_{n}": -(x - s.ts_mean(x, n)) for (k, x), n in product((("close", close), ("warrant", warrant)), WINDOWS)} | {
        f"pct_{n}": s.ts_pct_change(close, n) - s.ts_pct_change(vix, n) for n in WINDOWS
    }


def macd() -> dict[str, Node]:
    out = {}
    for a, b, c in ((12, 26, 9), (5, 21, 5)):
        line = s.ts_ewm(close, a) - s.ts_ewm(close, b)
        signal = s.ts_ewm(line, c)
        out |= {f"line_{a}_{b}": line, f"signal_{a}_{b}_{c}": signal, f"hist_{a}_{b}_{c}": s.ts_where(line - signal, volume > s.ts_mean(volume, 21), 0.0)}
    return out


def price_value() -> dict[str, Node]:
    return {f"v{n}": s.rank(s.safe_div(s.ts_delay(close, n), close)) for n in (63, 252, 1260)} | {f"log{n}": s.rank(s.ts_log10(s.safe_div(s.ts_delay(close, n), close))) for n in (63, 252)} | {"stock": s.rank(s.correlation(close, closing, 21))}


def skewness() -> dict[str, Node]:
    r = s.ts_pct_change(close)
    out = {f"k{n}": -s.ts_skew(r, n) for n in (21, 42, 63)}
    for n in (21, 42):
        mu, sd = s.ts_mean(r, n), s.ts_stddev(r, n)
        third = s.safe_div(s.ts_sum(s.ts_pow(r - mu, 3.0), n), s.ts_pow(sd, 3.0) * float(n))
        out |= {f"hand{n}": -third, f"extreme{n}": s.keep_extremes(-third)}
    return out


def ewm_z_score() -> dict[str, Node]:
    return {f"{k}_{a}_{b}": s.compute_z_score(s.ts_pct_change(x, 5), a, b) for (k, x), (a, b) in product((("close", close), ("fx", fx)), ((5, 10), (10, 21)))} | {
        f"smooth_{a}": s.smooth_data(s.ts_pct_change(volume), a) for a in (5, 10)
    }


def regimes() -> dict[str, Node]:
    z = s.zscore(warrant, 42)
    state = s.ts_where(-5.0, z > 2.0, s.ts_where(1.0, z > 1.0, s.ts_where(-1.0, z < -1.0, 0.0)))
    r = s.ts_pct_change(close)
    calm = vix < s.ts_mean(vix, 252)
    return {"states": state, "contrarian": s.ts_where(2.0, s.ts_rsi(close, 14) < 30.0, s.ts_where(-2.0, s.ts_rsi(close, 14) > 70.0, 0.0)), "calm": s.ts_where(s.ts_mean(r, 21), calm, 0.0), "log_calm": s.ts_where(s.ln(s.ts_mean(r, 21)), calm, 0.0)} | {
        f"vol_{n}": s.volatility_regime(r, n, 10, 1.0, 0.5) * s.ts_mean(r, 5) for n in (10, 21)
    }


def chains() -> dict[str, Node]:
    out = {}
    for n, f in product((10, 21), (0.5, 0.9)):
        x = s.zscore(s.safe_div(close, high), 42)
        for _ in range(3):
            x = s.ts_decay_exp_window(x, n, f)
        out[f"clip_{n}_{f * 10:.0f}"] = s.ts_clip(x, -1.0, 1.0)
    return out | {f"wins_{p * 100:.0f}": s.winsorize(s.safe_div(stock_in, closing), p) for p in (0.01, 0.05)}


def flow_conditions() -> dict[str, Node]:
    return {f"n{n}_m{m}": s.ts_where(s.ts_pct_change(close, m), s.ts_mean(stock_out, n) > s.ts_mean(stock_in, n), -s.ts_pct_change(close, m)) for n, m in product(WINDOWS, (5, 21))} | {
        f"double_{a}_{b}": (s.indicator((s.ts_mean(close, a) > s.ts_mean(close, b)) & (stock_out > stock_in)) - s.indicator((s.ts_mean(close, a) < s.ts_mean(close, b)) & (stock_out < stock_in))) * volume for a, b in PAIRS
    }


def multi_horizon() -> dict[str, Node]:
    out = {}
    for k, x in (("close", close), ("fx", fx)):
        total = s.lift(0.0)
        for n in (5, 10, 21, 42):
            total = total + s.sign(s.ts_pct_change(x, n))
        out[f"signs_{k}"] = total
        delayed = s.lift(0.0)
        for d in (0, 5, 10):
            delayed = delayed + s.correlation(x, s.ts_delay(stock_out, d), 21)
        out[f"delays_{k}"] = delayed
    return {k: v for x in (out, {f"{k}_neutral": s.neutralise(v) for k, v in out.items()}) for k, v in x.items()}


FAMILIES = {
    f.__name__: f()
    for f in (
        ma_vs_ma, delta_of_rank, corr_minus_corr, rsi_gated_corr, sma_gated_volume, sma_gated_corr, rsi_sma_gated, macro_momentum, ratio_spread, std_minus_std,
        cross_market_corr, divergence, macd, price_value, skewness, ewm_z_score, regimes, chains, flow_conditions, multi_horizon,
    )
}


def registry() -> dict[str, Node]:
    """All signals by "family.name"."""
    return {f"{f}.{k}": node for f, members in FAMILIES.items() for k, node in members.items()}
