"""Sequential queries; their oracles are recursive."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import mean as roll_mean
from candela.functions.frames import rounded
from candela.operators import features as f
from candela.operators import sequences as q
from candela.plans.feature_queries import _all, _of
from candela.plans.sql import SO_FAR, change, flag, lag, mean, query, r, std
from candela.sources import bars as s


def _overlay(spark, sf_dir):
    return q.roc_overlay(s.bars(spark, sf_dir), s.vix(spark, sf_dir), q.tier_table(spark))


def _wanted(spark, sf_dir):
    rows = s.bars(spark, sf_dir)
    return rows.select("symbol", "date", "close", F.coalesce((F.col("close") > roll_mean("close", 20)).cast("int"), F.lit(0)).alias("position"))


QUERIES = {
    "macd_ema": _of(q.macd, s.bars),
    "macd_tool_sma_seed": _of(q.macd_seeded, s.bars),
    "kalman_price": _of(q.kalman, s.bars),
    "vix_roc_hysteresis": lambda spark, sf: rounded(_overlay(spark, sf).drop("close")),
    "vix_roc_backtest": lambda spark, sf: rounded(q.overlay_backtest(_overlay(spark, sf))),
    "vix_spike_overlay": _of(q.spike_overlay, s.vix),
    "hybrid_vix": _of(q.hybrid_overlay, s.vix),
    "final_vix": _of(q.final_overlay, s.vix),
    "enhanced_vix": _of(q.enhanced_overlay, s.vix),
    "leading_indicators": _of(lambda v: q.leading(v).drop("symbol"), s.vix),
    "tunable_override": _of(q.tunable_overlay, s.vix),
    "bocpd_runlength": _of(lambda b: q.bocpd(b).select("symbol", "date", "map_run_length", "expected_run_length", "map_drop"), s.bars),
    "bocpd_cp_identity": _of(lambda b: q.bocpd(b).select("symbol", "date", "cp_prob"), s.bars),
    "smoothed_labels": _of(lambda b: q.min_duration(f.regime_labels(b).select("symbol", "date", "regime")), s.bars),
    "ledger_replay": _of(q.ledger, _wanted),
    "feature_engine_online": _of(q.online_features, s.bars),
}

NUM = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars"
INDEX = {
    "v0": "SELECT 'vix' AS symbol, date, vix, row_number() OVER (ORDER BY date) AS i FROM vix",
    "v": f"SELECT *, coalesce((vix - {lag('vix', 5)}) / greatest({lag('vix', 5)}, 1), 0) AS roc FROM v0",
}
ODDS = {"w": f"SELECT *, coalesce((vix - {mean('vix', 60)}) / nullif({std('vix', 60)}, 0), 0) AS z FROM v", "p": "SELECT *, 1 / (1 + exp(1 + z)) AS spike, 1 / (1 + exp(1 - z)) AS calm FROM w"}


def _walk(source: str, first: str, then: str, done: str) -> str:
    """A recursive walk over source (symbol, i): first gives the state at i = 1, then from e (before) and n (now)."""
    return f"SELECT {first} FROM {source} n WHERE i = 1 UNION ALL SELECT {then} FROM e JOIN {source} n ON n.symbol = e.symbol AND n.i = e.i + 1{done}"


def _ema(span: int) -> str:
    return f"{2 / (span + 1)!r}"


_a12, _a26, _a50, _a9 = (_ema(k) for k in (12, 26, 50, 9))
_m = f"(({_a12} * n.close + (1 - {_a12}) * e.e12) - ({_a26} * n.close + (1 - {_a26}) * e.e26))"
LADDER = "least(1.0, (CASE WHEN n.vix < 30 THEN 1.0 WHEN n.vix < 40 THEN 0.8 WHEN n.vix < 50 THEN 0.6 WHEN n.vix < 60 THEN 0.45 ELSE 0.3 END)"
OVERLAY = {
    "t": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', {p.back}, {p.leave}, {p.enter}, {p.days})" for k, t in q.TIER_OF.items() for p in [q.TIERS[t]]) + ") AS t(symbol, tier, back, leave, enter, days)",
    "j": "SELECT bars.symbol, bars.date, bars.close, vix.vix, t.tier, t.back, CAST(t.leave AS DOUBLE) AS leave, CAST(t.enter AS DOUBLE) AS enter, t.days, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.date) AS i FROM bars JOIN vix ON bars.date = vix.date JOIN t ON t.symbol = bars.symbol",
    "n": f"SELECT *, coalesce(CASE WHEN {'CASE ' + ' '.join(f'WHEN back = {k} THEN ' + lag('vix', k) for k in (2, 5, 10)) + ' END'} > 0 THEN (vix - {'CASE ' + ' '.join(f'WHEN back = {k} THEN ' + lag('vix', k) for k in (2, 5, 10)) + ' END'}) / {'CASE ' + ' '.join(f'WHEN back = {k} THEN ' + lag('vix', k) for k in (2, 5, 10)) + ' END'} END, 0) AS roc FROM j",
    "e": _walk(
        "n", "symbol, date, i, true AS inside, CAST(0 AS BIGINT) AS out_days, 1 AS position, 0 AS move",
        """n.symbol, n.date, n.i, CASE WHEN n.i <= n.back THEN true WHEN e.inside THEN n.roc <= n.leave ELSE e.out_days + 1 >= n.days AND n.roc < n.enter END,
        CASE WHEN n.i <= n.back OR e.inside THEN 0 ELSE e.out_days + 1 END,
        CASE WHEN n.i <= n.back THEN 1 WHEN e.inside THEN CASE WHEN n.roc > n.leave THEN 0 ELSE 1 END WHEN e.out_days + 1 >= n.days AND n.roc < n.enter THEN 1 ELSE 0 END,
        CASE WHEN n.i <= n.back THEN 0 WHEN e.inside THEN CASE WHEN n.roc > n.leave THEN -1 ELSE 0 END WHEN e.out_days + 1 >= n.days AND n.roc < n.enter THEN 1 ELSE 0 END""", "",
    ),
}
LEDGER = {
    "n": f"SELECT *, CASE WHEN close > {mean('close', 20)} THEN 1 ELSE 0 END AS want, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars",
    "e": _walk(
        "n", "symbol, date, i, close, 'hold' AS action, CAST(100000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS paid, CAST(0 AS DOUBLE) AS pnl",
        """n.symbol, n.date, n.i, n.close, CASE WHEN e.shares > 0 AND (n.want = 0 OR n.close < e.paid * 0.9) THEN 'sell' WHEN e.shares = 0 AND n.want = 1 AND e.cash * 0.2 + 1 <= e.cash THEN 'buy' ELSE 'hold' END,
        CASE WHEN e.shares > 0 AND (n.want = 0 OR n.close < e.paid * 0.9) THEN e.cash + e.shares * (n.close * 0.9995) - 1 WHEN e.shares = 0 AND n.want = 1 AND e.cash * 0.2 + 1 <= e.cash THEN e.cash - e.cash * 0.2 - 1 ELSE e.cash END,
        CASE WHEN e.shares > 0 AND (n.want = 0 OR n.close < e.paid * 0.9) THEN 0 WHEN e.shares = 0 AND n.want = 1 AND e.cash * 0.2 + 1 <= e.cash THEN e.cash * 0.2 / (n.close * 1.0005) ELSE e.shares END,
        CASE WHEN e.shares > 0 AND (n.want = 0 OR n.close < e.paid * 0.9) THEN 0 WHEN e.shares = 0 AND n.want = 1 AND e.cash * 0.2 + 1 <= e.cash THEN n.close * 1.0005 ELSE e.paid END,
        CASE WHEN e.shares > 0 AND (n.want = 0 OR n.close < e.paid * 0.9) THEN e.shares * (n.close * 0.9995 - e.paid) - 1 ELSE 0 END""", "",
    ),
}
ORACLE = {
    "macd_ema": query(
        f"SELECT symbol, date, {r('e12', 'ema_12')}, {r('e26', 'ema_26')}, {r('e50', 'ema_50')}, {r('e12 - e26', 'macd')}, {r('sg', 'macd_signal')}, {r('e12 - e26 - sg', 'macd_histogram')} FROM e",
        "bars", recursive=True,
        steps={"n": NUM, "e": _walk("n", "symbol, date, i, close AS e12, close AS e26, close AS e50, CAST(0 AS DOUBLE) AS sg", f"n.symbol, n.date, n.i, {_a12} * n.close + (1 - {_a12}) * e.e12, {_a26} * n.close + (1 - {_a26}) * e.e26, {_a50} * n.close + (1 - {_a50}) * e.e50, {_a9} * {_m} + (1 - {_a9}) * e.sg", "")},
    ),
    "macd_tool_sma_seed": query(
        f"SELECT symbol, date, {r('CASE WHEN i >= 26 THEN f - sl END', 'macd')}, {r('CASE WHEN i >= 34 THEN sg END', 'signal')}, {r('CASE WHEN i >= 34 THEN f - sl - sg END', 'histogram')} FROM e2",
        "bars", recursive=True,
        steps={
            "n": f"SELECT *, {lag('close', 0)} AS c0, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m12, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS m26, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars",
            "e": _walk("n", "symbol, date, i, close AS f, close AS sl", f"n.symbol, n.date, n.i, CASE WHEN n.i <= 12 THEN n.m12 ELSE (n.close - e.f) * {_a12} + e.f END, CASE WHEN n.i <= 26 THEN n.m26 ELSE (n.close - e.sl) * {_a26} + e.sl END", ""),
            "n2": "SELECT *, avg(CASE WHEN i >= 26 THEN f - sl END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS m9 FROM e",
            "e2": f"SELECT symbol, date, i, f, sl, CAST(0 AS DOUBLE) AS sg FROM n2 WHERE i = 1 UNION ALL SELECT n2.symbol, n2.date, n2.i, n2.f, n2.sl, CASE WHEN n2.i <= 34 THEN coalesce(n2.m9, 0) ELSE (n2.f - n2.sl - e2.sg) * {_a9} + e2.sg END FROM e2 JOIN n2 ON n2.symbol = e2.symbol AND n2.i = e2.i + 1",
        },
    ),
    "kalman_price": query(
        f"SELECT symbol, date, {r('m', 'kalman_price')}, {r('mr', 'kalman_returns')}, {r('close - m', 'price_kalman_residual')}, {r('close / m', 'kalman_price_ratio')}, {r(f'm - {lag('m', 5)}', 'kalman_momentum')}, {flag(f'm > {mean('m', 20, 1)}')} AS kalman_trend FROM e",
        "bars", recursive=True,
        steps={
            "n": f"SELECT *, coalesce({change('close')}, 0) AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars",
            "e": _walk("n", "symbol, date, i, close, close AS m, CAST(0.5 AS DOUBLE) AS p, CAST(0.5 * ret AS DOUBLE) AS mr, CAST(0.5 AS DOUBLE) AS pr", "n.symbol, n.date, n.i, n.close, e.m + (e.p + 0.01) / (e.p + 0.01 + 1) * (n.close - e.m), (1 - (e.p + 0.01) / (e.p + 0.01 + 1)) * (e.p + 0.01), e.mr + (e.pr + 0.001) / (e.pr + 0.001 + 1) * (n.ret - e.mr), (1 - (e.pr + 0.001) / (e.pr + 0.001 + 1)) * (e.pr + 0.001)", ""),
        },
    ),
    "vix_roc_hysteresis": query(f"SELECT n.symbol, n.date, {r('n.vix', 'vix')}, n.tier, {r('n.roc', 'vix_roc')}, CAST(e.position AS INTEGER) AS position, CAST(e.move AS INTEGER) AS move FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i", "bars", "vix", steps=OVERLAY, recursive=True),
    "vix_roc_backtest": query(
        f"SELECT symbol, tier, {r('ln(b)', 'bh_log_return')}, {r('ln(a)', 'strategy_log_return')}, {r('ln(a / b)', 'excess_log_return')}, {r('dr', 'bh_max_dd')}, {r('ds', 'strategy_max_dd')}, {r('ds - dr', 'dd_improvement')}, num_trades, {flag('a > b')} AS win, days FROM g",
        "bars", "vix", recursive=True,
        steps={
            **OVERLAY,
            "x": "SELECT n.symbol, n.tier, n.date, e.move, n.close / lag(n.close) OVER w - 1 AS ret, lag(e.position) OVER w * (n.close / lag(n.close) OVER w - 1) AS st FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i WINDOW w AS (PARTITION BY n.symbol ORDER BY n.date)",
            "y": f"SELECT *, product(1 + ret) {SO_FAR} AS cr, product(1 + st) {SO_FAR} AS cs FROM x WHERE ret IS NOT NULL",
            "z": f"SELECT *, cr / max(cr) {SO_FAR} - 1 AS fr, cs / max(cs) {SO_FAR} - 1 AS fs FROM y",
            "g": "SELECT symbol, tier, arg_max(cr, date) AS b, arg_max(cs, date) AS a, min(fr) AS dr, min(fs) AS ds, CAST(count(*) FILTER (move = -1) AS BIGINT) AS num_trades, count(*) AS days FROM z GROUP BY symbol, tier",
        },
    ),
    "vix_spike_overlay": query(f"SELECT date, {r('vix', 'vix')}, {r('roc', 'vix_roc')}, {r('CASE WHEN vix > 20 AND roc > 0.3 THEN 0.5 ELSE 1.0 END', 'position')}, CASE WHEN vix > 20 AND roc > 0.3 THEN 'SPIKE' ELSE 'NORMAL' END AS reason FROM v", "vix", steps=INDEX),
    "hybrid_vix": query(
        f"SELECT date, {r('position', 'position')}, CAST(days AS INTEGER) AS protected_days FROM e",
        "vix", recursive=True,
        steps={
            **INDEX,
            "e": "SELECT symbol, date, i, vix > 20 AND roc > 0.3 AS inside, CASE WHEN vix > 20 AND roc > 0.3 THEN 1 ELSE 0 END AS days, CAST(1.0 AS DOUBLE) AS position FROM v WHERE i = 1 UNION ALL SELECT symbol, date, i, inside AND NOT done, CASE WHEN inside AND NOT done THEN d ELSE 0 END, CAST(CASE WHEN NOT inside OR done THEN 1.0 WHEN vix > 30 THEN greatest(0.2, 0.5 - (vix - 30) * 0.01) ELSE 0.5 END AS DOUBLE) FROM (SELECT *, inside AND d >= 5 AND vix < 25 AS done FROM (SELECT n.symbol, n.date, n.i, n.vix, e.inside OR (n.vix > 20 AND n.roc > 0.3) AS inside, CASE WHEN e.inside THEN e.days + 1 ELSE 1 END AS d FROM e JOIN v n ON n.symbol = e.symbol AND n.i = e.i + 1))",
        },
    ),
    "final_vix": query(
        f"SELECT date, {r('position', 'position')}, CAST(inside AS INTEGER) AS protected FROM e",
        "vix", recursive=True,
        steps={
            **INDEX, **ODDS,
            "e": f"""SELECT symbol, date, i, false AS inside, 0 AS days, CAST(0 AS DOUBLE) AS peak, CAST(1 AS DOUBLE) AS position FROM p WHERE i = 1 UNION ALL SELECT symbol, date, i, now AND NOT done, d, CASE WHEN now AND NOT done THEN top ELSE 0 END, CAST(CASE WHEN NOT now OR done THEN 1.0 ELSE place END AS DOUBLE) FROM (SELECT *, was AND d >= 2 AND (top - vix) / top > 0.15 AND place >= 0.95 AS done FROM (
              SELECT n.symbol, n.date, n.i, n.vix, e.inside AS was, e.inside OR (n.roc > 0.25 AND n.vix > 18) AS now, CASE WHEN e.inside THEN e.days + 1 ELSE 0 END AS d, greatest(e.peak, n.vix) AS top, {LADDER} + CASE WHEN e.inside AND n.calm > 0.3 THEN 0.1 ELSE 0.0 END) AS place FROM e JOIN p n ON n.symbol = e.symbol AND n.i = e.i + 1))""",
        },
    ),
    "enhanced_vix": query(
        f"SELECT date, {r('position', 'position')}, CAST(inside AS INTEGER) AS protected FROM e",
        "vix", recursive=True,
        steps={
            **INDEX, **ODDS,
            "e": """SELECT symbol, date, i, vix, false AS inside, 0 AS falling, CAST(CASE WHEN spike > 0.55 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS position FROM p WHERE i = 1 UNION ALL SELECT symbol, date, i, vix, CASE WHEN was THEN NOT (fell >= 2 AND (vix < 35 OR calm > 0.3) OR fell < 2 AND calm > 0.3 AND vix < 30) ELSE hit END, CASE WHEN NOT was AND hit THEN 0 ELSE fell END,
              CAST(CASE WHEN NOT was THEN CASE WHEN hit THEN 0.45 WHEN spike > 0.55 THEN 0.8 ELSE 1.0 END WHEN fell >= 2 THEN CASE WHEN vix < 35 OR calm > 0.3 THEN 1.0 ELSE 0.7 END WHEN calm > 0.3 AND vix < 30 THEN 1.0 ELSE 0.45 END AS DOUBLE)
              FROM (SELECT n.*, e.inside AS was, n.roc > 0.25 AND n.vix > 18 AS hit, CASE WHEN n.vix < e.vix THEN e.falling + 1 ELSE 0 END AS fell FROM e JOIN p n ON n.symbol = e.symbol AND n.i = e.i + 1)""",
        },
    ),
    "leading_indicators": query(
        f"""SELECT date, {r('vix', 'vix')}, CASE WHEN vix < 15 THEN 'low' WHEN vix < 20 THEN 'normal' WHEN vix < 35 THEN 'elevated' WHEN vix < 50 THEN 'high' ELSE 'extreme' END AS vix_regime, {r('roc', 'vix_roc')}, {r(f"CASE WHEN count(vix) {SO_FAR} >= 20 THEN (vix - avg(vix) {SO_FAR}) / greatest(stddev_pop(vix) {SO_FAR}, 1e-4) ELSE 0 END", 'vix_zscore')}, {r('lv', 'risk_vix_level')}, {r('pc', 'risk_vix_roc')}, {r('0.25 * lv + 0.35 * pc', 'leading_risk')} FROM l""",
        "vix",
        steps={**INDEX, "l": "SELECT *, CASE WHEN vix < 15 THEN 0 WHEN vix < 35 THEN 0.5 * (vix - 15) / 20 WHEN vix < 50 THEN 0.5 + 0.3 * (vix - 35) / 15 ELSE 0.8 + 0.2 * (1 - exp(-(vix - 50) / 20)) END AS lv, CASE WHEN roc < 0 THEN 0 WHEN roc < 0.2 THEN 0.3 * roc / 0.2 WHEN roc < 0.4 THEN 0.3 + 0.4 * (roc - 0.2) / 0.2 ELSE 0.7 + 0.3 * (1 - exp(-(roc - 0.4) / 0.3)) END AS pc FROM v"},
    ),
    "tunable_override": query(
        f"SELECT date, {r('position', 'position')}, reason FROM e WHERE i > 0",
        "vix", recursive=True,
        steps={
            **INDEX,
            "l": "SELECT *, 0.25 * (CASE WHEN vix < 15 THEN 0 WHEN vix < 35 THEN 0.5 * (vix - 15) / 20 WHEN vix < 50 THEN 0.5 + 0.3 * (vix - 35) / 15 ELSE 0.8 + 0.2 * (1 - exp(-(vix - 50) / 20)) END) + 0.35 * (CASE WHEN roc < 0 THEN 0 WHEN roc < 0.2 THEN 0.3 * roc / 0.2 WHEN roc < 0.4 THEN 0.3 + 0.4 * (roc - 0.2) / 0.2 ELSE 0.7 + 0.3 * (1 - exp(-(roc - 0.4) / 0.3)) END) AS risk FROM v",
            "e": """SELECT '' AS symbol, CAST(NULL AS DATE) AS date, CAST(0 AS BIGINT) AS i, false AS inside, 0 AS calm, CAST(1 AS DOUBLE) AS position, '' AS reason UNION ALL
              SELECT symbol, date, i, CASE WHEN vix > 40 OR risk > 0.3 THEN true ELSE was AND c < 3 END, CASE WHEN vix > 40 OR risk > 0.3 OR NOT was OR c >= 3 THEN 0 ELSE c END,
              CAST(CASE WHEN vix > 40 THEN 0.35 WHEN risk > 0.3 THEN 0.6 WHEN was THEN CASE WHEN c >= 3 THEN 1.0 ELSE 0.6 + CAST(c AS DOUBLE) / 3 * 0.4 END WHEN risk > 0.2 THEN 0.9 ELSE 1.0 END AS DOUBLE),
              CASE WHEN vix > 40 THEN 'VIX_EMERGENCY' WHEN risk > 0.3 THEN 'LEADING_OVERRIDE' WHEN was THEN CASE WHEN c >= 3 THEN 'RECOVERED' WHEN c > 0 THEN 'RECOVERING' ELSE 'PROTECTED' END WHEN risk > 0.2 THEN 'ELEVATED' ELSE 'NORMAL' END
              FROM (SELECT n.*, e.inside AS was, CASE WHEN n.vix < 25 AND n.roc < -0.1 AND n.risk < 0.3 THEN e.calm + 1 ELSE 0 END AS c FROM e JOIN l n ON n.i = e.i + 1)""",
        },
    ),
    "bocpd_cp_identity": query(f"SELECT symbol, date, {r('0.01', 'cp_prob')} FROM bars", "bars"),
    "smoothed_labels": query(
        "SELECT w.symbol, w.date, w.regime, w.run, CAST(CASE WHEN g.n < 5 THEN coalesce(g.prev, g.next, g.label) ELSE g.label END AS INTEGER) AS regime_smooth FROM w JOIN g ON w.symbol = g.symbol AND w.run = g.run",
        "bars",
        steps={
            "x": f"SELECT *, {change('close')} AS ret FROM bars", "y": f"SELECT *, {std('ret', 20)} AS sd FROM x", "k": "SELECT symbol, quantile_cont(sd, 0.33) AS a, quantile_cont(sd, 0.67) AS b FROM y GROUP BY symbol",
            "z": "SELECT y.symbol, y.date, CAST(CASE WHEN sd < a THEN 0 WHEN sd > b THEN 2 ELSE 1 END AS INTEGER) AS regime FROM y JOIN k ON y.symbol = k.symbol",
            "u": f"SELECT *, CASE WHEN regime IS DISTINCT FROM {lag('regime')} THEN 1 ELSE 0 END AS starts FROM z", "w": f"SELECT *, CAST(sum(starts) {SO_FAR} AS BIGINT) AS run FROM u",
            "g0": "SELECT symbol, run, min(regime) AS label, count(*) AS n FROM w GROUP BY 1, 2", "g": "SELECT *, lag(label) OVER (PARTITION BY symbol ORDER BY run) AS prev, lead(label) OVER (PARTITION BY symbol ORDER BY run) AS next FROM g0",
        },
    ),
    "ledger_replay": query(
        f"SELECT symbol, date, action, {_all('cash shares equity pnl')} FROM (SELECT *, cash + shares * close AS equity FROM e)",
        "bars", recursive=True, steps=LEDGER,
    ),
    "feature_engine_online": query(
        f"SELECT symbol, date, {_all('ret_z sigma clv gap_z')} FROM e",
        "bars", recursive=True,
        steps={
            "n": f"SELECT *, ln(close / {lag('close')}) AS lr, ln(open / {lag('close')}) AS gp, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars",
            "e": _walk("n", "symbol, date, i, CAST(0.0001 AS DOUBLE) AS var, CAST(0 AS DOUBLE) AS ret_z, CAST(0.01 AS DOUBLE) AS sigma, CAST(0 AS DOUBLE) AS clv, CAST(0 AS DOUBLE) AS gap_z", "n.symbol, n.date, n.i, 0.06 * n.lr * n.lr + 0.94 * e.var, n.lr / sqrt(greatest(e.var, 1e-12)), sqrt(greatest(e.var, 1e-12)), CASE WHEN n.high > n.low THEN (2 * n.close - n.high - n.low) / (n.high - n.low) ELSE 0 END, n.gp / sqrt(greatest(e.var, 1e-12))", ""),
        },
    ),
}
