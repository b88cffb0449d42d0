"""Feature queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import rounded
from candela.operators import features as f
from candela.plans.sql import ORDER, SO_FAR, change, corr, flag, frame, lag, mean, query, r, roll, std
from candela.sources import bars as s

A = "sqrt(252.0)"
MACRO = {"usd": "1-URGENT", "oil": "2-HIGH", "gold": "3-MEDIUM"}


def _of(operator, *sources):
    """The query that applies operator to these sources."""
    return lambda spark, sf_dir: rounded(operator(*[x(spark, sf_dir) for x in sources]))


def _sentiment(spark, sf_dir):
    """Scores by the symbols' dates: the mean tax of a day's lines, moved to lie about zero, and their number."""
    lines = s.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg((F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 10)) / 10 - F.avg("l_tax") * 10).alias("sentiment_score"), F.count("*").alias("sentiment_count")).filter(F.dayofmonth("date") % 3 != 0)


def _quarters(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def _positions(spark, sf_dir):
    """Long above the average of 20 bars, half below."""
    rows = s.bars(spark, sf_dir)
    return rows.select("symbol", "date", "close", F.when(F.col("close") > f.mean("close", 20), 1.0).otherwise(0.5).alias("position"))


def _explode_raw(spark, sf_dir):
    """Provider results (one array of bars a symbol and year, dates in epoch milliseconds) taken apart into bars."""
    rows = s.bars(spark, sf_dir)
    bar = F.struct(F.unix_millis(F.col("date").cast("timestamp")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"), F.col("transactions").alias("n"))
    raw = rows.groupBy("symbol", F.year("date").alias("year")).agg(F.collect_list(bar).alias("results"))
    b = raw.select("symbol", F.explode("results").alias("b"))
    return rounded(b.select("symbol", F.timestamp_millis("b.t").cast("date").alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.vw").alias("vwap"), F.col("b.n").alias("transactions")))


QUERIES = {
    "bars_daily": _of(lambda b: b, s.bars),
    "bars_brand_monthly": _of(lambda b: b, s.brand_bars),
    "explode_raw_bars": _explode_raw,
    "vix_series": _of(lambda v: v, s.vix),
    "series_panel": _of(lambda v: v, s.series_panel),
    "returns_gaps": _of(f.returns, s.bars),
    "sma_cross": _of(f.moving_averages, s.bars),
    "rsi_sma": _of(f.rsi, s.bars),
    "bollinger_samp": _of(f.bollinger, s.bars),
    "bollinger_pop": _of(lambda b: f.bollinger(b, population=True), s.bars),
    "atr_sma": _of(f.atr, s.bars),
    "volume_features": _of(f.volume, s.bars),
    "obv": _of(f.on_balance_volume, s.bars),
    "vol_price_corr": _of(f.volume_price_corr, s.bars),
    "realized_vol": _of(f.realized_vol, s.bars),
    "parkinson": _of(f.parkinson, s.bars),
    "vol_regime_equal_width": _of(f.vol_regime, s.bars),
    "roc_streaks": _of(f.streaks, s.bars),
    "drawdown_duration": _of(f.drawdowns, s.bars),
    "market_relative": _of(f.market_relative, s.bars, s.market),
    "seasonality": _of(f.seasonality, s.bars),
    "forward_targets": _of(f.forward_targets, s.bars),
    "vix_features": _of(f.volatility_index, s.bars, s.vix),
    "macro_corr": _of(lambda b, p: f.macro_correlation(b, p, MACRO), s.bars, s.series_panel),
    "breadth": _of(f.breadth, s.series_panel),
    "options_proxy_rank": _of(f.options_proxy, s.bars),
    "market_risk_features": _of(f.market_risk, s.market, s.vix),
    "market_risk_targets": _of(f.market_risk_targets, s.market),
    "quarterly_growth": _of(f.quarterly_growth, _quarters),
    "vol_predictor_features": _of(f.vol_predictor, s.bars, s.vix),
    "vol_regime_targets": _of(f.vol_regime_targets, s.bars),
    "rolling_beta": _of(f.rolling_beta, s.bars, s.market),
    "relative_strength": _of(f.relative_strength, s.bars, s.market),
    "hmm_features": _of(f.hmm_features, s.bars),
    "wasserstein_features": _of(f.wasserstein_features, s.bars),
    "regime_quantile_labels": _of(f.regime_labels, s.bars),
    "sentiment_join_features": _of(f.sentiment, s.bars, _sentiment),
    "equity_curve": _of(f.equity_curve, s.bars),
    "position_costs": _of(f.position_returns, _positions),
}

def _all(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names.split())


BAR = f"symbol, date, {_all('open high low close volume vwap')}, transactions"
RET = {"x": f"SELECT *, {change('close')} AS ret, ln(close / nullif({lag('close')}, 0)) AS lr FROM bars"}
ASOF_VIX = {"a": "SELECT bars.symbol, bars.date, bars.close, vix.vix FROM bars ASOF LEFT JOIN vix ON bars.date >= vix.date"}


def _macro() -> str:
    steps = {}
    joins = "SELECT b.*" + "".join(f", {p}.rr AS {p}_r, {p}.mm AS {p}_m" for p in MACRO) + " FROM b"
    for p, n in MACRO.items():
        steps[p] = f"SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS rr, close / nullif(lag(close, 20) OVER (ORDER BY date), 0) - 1 AS mm FROM panel WHERE name = '{n}'"
        joins += f" ASOF LEFT JOIN {p} ON b.date >= {p}.date"
    steps["b"] = f"SELECT symbol, date, {change('close')} AS ret, {change('close', 20)} AS m20 FROM bars"
    steps["j"] = joins
    columns = ", ".join(f"{corr('ret', f'{p}_r', k)} AS {p}_corr_{k}d" for p in MACRO for k in (10, 20, 50)) + "".join(f", m20 - {p}_m AS {p}_momentum_divergence" for p in MACRO)
    steps["c"] = f"SELECT symbol, date, {columns} FROM j"
    shown = ", ".join(r(f"{p}_corr_{k}d", f"{p}_corr_{k}d") for p in MACRO for k in (10, 20, 50)) + "".join(", " + r(f"{p}_momentum_divergence", f"{p}_momentum_divergence") for p in MACRO)
    return query(f"SELECT symbol, date, {shown}, {flag('gold_corr_20d > 0.3 AND oil_corr_20d < -0.2')} AS macro_risk_off, {flag('oil_corr_20d > 0.3 AND gold_corr_20d < -0.2')} AS macro_risk_on FROM c", "bars", "panel", steps=steps)


def _predictor() -> str:
    steps = {
        "a": f"SELECT bars.symbol, bars.date, bars.close, last_value(vix.vix IGNORE NULLS) OVER (PARTITION BY bars.symbol ORDER BY bars.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM bars LEFT JOIN vix ON bars.date = vix.date",
        "b": f"SELECT *, {change('close')} AS ret, v - {lag('v', 5)} AS velocity FROM a",
        "c": f"SELECT *, abs(ret) AS ar, {', '.join(f'{std('ret', k)} * {A} AS rv{k}' for k in (5, 10, 20, 60))} FROM b",
        "d": f"SELECT *, CASE WHEN ar > {roll('quantile_cont(ar, 0.95)', 'ar', 60)} THEN 1 ELSE 0 END AS extreme, {roll('min(rv20)', 'rv20', 60)} AS low60, velocity - {lag('velocity', 5)} AS acc FROM c",
        "e": f"""SELECT symbol, date, v AS vix, (v - {mean('v', 60)}) / ({std('v', 60)} + 1e-10) AS vix_zscore, {change('v', 5)} AS vix_mom_5, {change('v', 10)} AS vix_mom_10, v / nullif({mean('v', 10)}, 0) - 1 AS vix_vs_sma, acc AS vix_acceleration,
          rv5 AS rvol_5, rv10 AS rvol_10, rv20 AS rvol_20, rv60 AS rvol_60, rv20 / nullif(rv60, 0) - 1 AS vol_mom, rv20 / (low60 + 1e-10) - 1 AS vol_compression, close / {mean('close', 50)} - 1 AS sma_deviation, close / {roll('max(close)', 'close', 60)} - 1 AS drawdown, {change('close', 5)} AS return_5d, {change('close', 20)} AS return_20d, CAST({roll('sum(extreme)', 'extreme', 5)} AS DOUBLE) AS extreme_days_5 FROM d""",
    }
    names = "vix vix_zscore vix_mom_5 vix_mom_10 vix_vs_sma vix_acceleration rvol_5 rvol_10 rvol_20 rvol_60 vol_mom vol_compression sma_deviation drawdown return_5d return_20d extreme_days_5".split()
    return query("SELECT symbol, date, " + ", ".join(r(lag(n), n) for n in names) + " FROM e", "bars", "vix", steps=steps)


ORACLE = {
    "bars_daily": query(f"SELECT {BAR} FROM bars", "bars"),
    "bars_brand_monthly": query(f"SELECT {BAR} FROM brands", "brands"),
    "explode_raw_bars": query(f"SELECT {BAR} FROM bars", "bars"),
    "vix_series": query(f"SELECT date, {r('vix', 'vix')} FROM vix", "vix"),
    "series_panel": query(f"SELECT name, date, {r('close', 'close')} FROM panel", "panel"),
    "returns_gaps": query(
        "SELECT symbol, date, " + ", ".join(r(change("close", k), f"return_{k}d") for k in (1, 5, 10, 20)) + f", {r(f'ln(close / {lag('close')})', 'log_return_1d')}, " + ", ".join(r(change("close", k), f"momentum_{k}d") for k in (5, 10, 20))
        + f", {r('g', 'gap')}, {r('g / p', 'gap_pct')}, {flag('g > 0')} AS gap_up, {flag('g < 0')} AS gap_down FROM x",
        "bars", steps={"x": f"SELECT *, open - {lag('close')} AS g, {lag('close')} AS p FROM bars"},
    ),
    "sma_cross": query(
        f"SELECT symbol, date, {_all('sma_20 sma_50 sma_200')}, " + ", ".join(r(f"close / sma_{k} - 1", f"price_to_sma{k}") for k in (20, 50, 200)) + f", {flag('sma_20 > sma_50')} AS sma20_cross_sma50, {flag('sma_50 > sma_200')} AS sma50_cross_sma200 FROM x",
        "bars", steps={"x": "SELECT *, " + ", ".join(f"{mean('close', k)} AS sma_{k}" for k in (20, 50, 200)) + " FROM bars"},
    ),
    "rsi_sma": query(
        f"SELECT symbol, date, {r('rsi', 'rsi')}, {r('(rsi - 50) / 50', 'rsi_normalized')}, {r('shift - rsi', 'rsi_divergence')}, {r('(shift - rsi) / 100', 'rsi_divergence_normalized')} FROM z",
        "bars",
        steps={
            "x": f"SELECT *, close - {lag('close')} AS d, {change('close', 20)} * 100 AS shift FROM bars",
            "y": "SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss FROM x",
            "z": f"SELECT *, CASE WHEN count(gain) {frame(14)} >= 14 THEN CASE WHEN max(loss) {frame(14)} > 0 THEN 100 - 100 / (1 + avg(gain) {frame(14)} / avg(loss) {frame(14)}) WHEN max(gain) {frame(14)} > 0 THEN 100.0 END END AS rsi FROM y",
        },
    ),
    **{
        f"bollinger_{n}": query(
            f"SELECT symbol, date, {r('m + 2 * s', 'bb_upper')}, {r('m - 2 * s', 'bb_lower')}, {r('m', 'bb_middle')}, {r('(4 * s) / nullif(m, 0)', 'bb_width')}, {r('(close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0)', 'bb_position')} FROM x",
            "bars", steps={"x": f"SELECT *, {mean('close', 20)} AS m, {roll(f'stddev_{n}(close)', 'close', 20)} AS s FROM bars"},
        )
        for n in ("samp", "pop")
    },
    "atr_sma": query(
        f"SELECT symbol, date, {r('tr', 'true_range')}, {r(mean('tr', 14), 'atr')}, {r(mean('tr', 14) + ' / close', 'atr_normalized')} FROM x",
        "bars", steps={"x": f"SELECT *, greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0)) AS tr FROM bars"},
    ),
    "volume_features": query(f"SELECT symbol, date, {r(mean('volume', 20), 'volume_sma')}, {r(f'volume / {mean('volume', 20)}', 'volume_ratio')}, {r(change('volume', 5), 'volume_momentum_5d')}, {r(change('volume', 10), 'volume_momentum_10d')} FROM bars", "bars"),
    "obv": query(
        f"SELECT symbol, date, {r('obv', 'obv')}, {r(f'obv / nullif({mean('obv', 50)}, 0)', 'obv_normalized')} FROM y",
        "bars", steps={"x": f"SELECT *, coalesce(sign(close - {lag('close')}) * volume, 0) AS mv FROM bars", "y": f"SELECT *, sum(mv) {SO_FAR} AS obv FROM x"},
    ),
    "vol_price_corr": query(f"SELECT symbol, date, {r(corr('close', 'volume', 10), 'volume_price_corr_10d')} FROM bars", "bars"),
    "realized_vol": query("SELECT symbol, date, " + ", ".join(r(f"{std('lr', k)} * {A}", f"realized_vol_{k}d") for k in (5, 10, 20, 30, 60)) + " FROM x", "bars", steps=RET),
    "parkinson": query(f"SELECT symbol, date, {r('p', 'parkinson_vol')}, {r(mean('p', 20) + ' * ' + A, 'parkinson_vol_20d')} FROM x", "bars", steps={"x": "SELECT *, sqrt(power(ln(high / low), 2) / (4 * ln(2))) AS p FROM bars"}),
    "vol_regime_equal_width": query(
        f"SELECT symbol, date, {r('v', 'realized_vol_20d')}, bin, {flag('bin = 1')} AS vol_regime_low, {flag('bin = 2')} AS vol_regime_medium, {flag('bin = 3')} AS vol_regime_high FROM z",
        "bars", steps={**RET, "y": f"SELECT *, {std('lr', 20)} * {A} AS v FROM x", "w": "SELECT *, min(v) OVER (PARTITION BY symbol) AS lo, max(v) OVER (PARTITION BY symbol) AS hi FROM y", "z": "SELECT *, CASE WHEN v IS NOT NULL AND hi > lo THEN CAST(greatest(1, least(3, ceil((v - lo) * 3 / (hi - lo)))) AS INTEGER) END AS bin FROM w"},
    ),
    "roc_streaks": query(
        "SELECT symbol, date, " + ", ".join(r(change("close", k), f"roc_{k}d") for k in (5, 10, 20, 50)) + ", up_days, CAST(CASE WHEN up_days = 1 THEN n ELSE 0 END AS INTEGER) AS consecutive_ups, CAST(CASE WHEN up_days = 0 THEN n ELSE 0 END AS INTEGER) AS consecutive_downs FROM z",
        "bars",
        steps={"x": f"SELECT *, {flag('close > ' + lag('close'))} AS up_days FROM bars", "y": f"SELECT *, up_days IS DISTINCT FROM {lag('up_days')} AS starts FROM x", "w": f"SELECT *, sum(CAST(starts AS INTEGER)) {SO_FAR} AS run FROM y", "z": "SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY date) AS n FROM w"},
    ),
    "drawdown_duration": query(
        f"SELECT symbol, date, {r('(close - top) / top', 'drawdown')}, CAST(sum(CASE WHEN close < top THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run ORDER BY date) AS BIGINT) AS drawdown_duration FROM y",
        "bars", steps={"x": f"SELECT *, max(close) {frame(252)} AS top FROM bars", "y": f"SELECT *, sum(CASE WHEN close >= top THEN 1 ELSE 0 END) {SO_FAR} AS run FROM x"},
    ),
    "market_relative": query(
        f"SELECT symbol, date, {r('cov / nullif(mv, 0)', 'beta_20d')}, {r('a5', 'alpha_5d')}, {r('a10', 'alpha_10d')}, {r('rs', 'relative_strength')}, {r(change('rs', 20), 'relative_strength_change')} FROM z",
        "bars", "market",
        steps={
            "m": f"SELECT *, {change('close')} AS mr FROM market",
            "n": f"SELECT date, close AS mc, mr, {roll('sum(mr)', 'mr', 5)} AS m5, {roll('sum(mr)', 'mr', 10)} AS m10, {roll('var_samp(mr)', 'mr', 20)} AS mv FROM m",
            "x": f"SELECT bars.symbol, bars.date, bars.close, n.mc, n.mr, n.m5, n.m10, n.mv, bars.close / n.mc AS rs FROM bars LEFT JOIN n ON bars.date = n.date",
            "y": f"SELECT *, {change('close')} AS ret FROM x",
            "z": f"SELECT *, {roll('covar_samp(ret, mr)', 'ret', 20, None, 'mr')} AS cov, {change('close', 5)} - m5 AS a5, {change('close', 10)} - m10 AS a10 FROM y",
        },
    ),
    "seasonality": query(f"SELECT symbol, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, {flag('isodow(date) = 1')} AS is_monday, {flag('isodow(date) = 5')} AS is_friday, CAST(month(date) AS INTEGER) AS month, {flag('month(date) = 1')} AS is_january, {flag('month(date) = 12')} AS is_december, CAST(quarter(date) AS INTEGER) AS quarter FROM bars", "bars"),
    "forward_targets": query(
        "SELECT symbol, date, " + ", ".join(f"{r(f't{h}', f'target_return_{h}d')}, {flag(f't{h} > 0')} AS target_direction_{h}d, CAST(CASE WHEN t{h} IS NULL THEN -1 WHEN t{h} <= -0.02 THEN 0 WHEN t{h} <= -0.005 THEN 1 WHEN t{h} <= 0.005 THEN 2 WHEN t{h} <= 0.02 THEN 3 ELSE 4 END AS DOUBLE) AS target_class_{h}d" for h in (3, 5, 10)) + " FROM x",
        "bars", steps={"x": "SELECT *, " + ", ".join(f"{lag('close', -h)} / close - 1 AS t{h}" for h in (3, 5, 10)) + " FROM bars"},
    ),
    "vix_features": query(
        f"""SELECT symbol, date, {r('coalesce(vix, 0)', 'vix_level')}, {r(f"coalesce(vix - {lag('vix')}, 0)", 'vix_change')}, {r('coalesce(pct, 0)', 'vix_pct_change')}, {r(f"coalesce({mean('vix', 20, 1)}, 0)", 'vix_ma_20')}, {r(f"coalesce({mean('vix', 50, 1)}, 0)", 'vix_ma_50')}, {r(f"coalesce({std('vix', 20, 1)}, 0)", 'vix_std_20')},
        {flag(f"vix > {mean('vix', 60, 20)} + 2 * {std('vix', 60, 20)}")} AS vix_spike, CAST(CASE WHEN vix < 15 THEN 0 WHEN vix > 25 THEN 2 ELSE 1 END AS INTEGER) AS vix_regime, {flag(f"vix > {mean('vix', 20, 1)}")} AS vix_trend, {r(f"coalesce({corr('ret', 'pct', 20, 10)}, 0)", 'stock_vix_correlation')} FROM x""",
        "bars", "vix", steps={**ASOF_VIX, "x": f"SELECT *, {change('vix')} AS pct, {change('close')} AS ret FROM a"},
    ),
    "macro_corr": _macro(),
    "breadth": query(
        f"""SELECT date, advancing, declining, unchanged, {r('ad_line', 'ad_line')}, {r('ad_ratio', 'ad_ratio')}, {r(mean('ad_line', 20), 'ad_line_ma20')}, {r(mean('ad_ratio', 20), 'ad_ratio_ma20')}, {r(f"ad_line - {lag('ad_line', 10)}", 'breadth_momentum_10d')},
        {r(f"(close - {mean('close', 50)}) / nullif({std('close', 50)}, 0) - (ad_line - {mean('ad_line', 50)}) / nullif({std('ad_line', 50)}, 0)", 'breadth_divergence')}, {flag('ad_ratio > 1.5')} AS breadth_strong, {flag('ad_ratio < 0.67')} AS breadth_weak FROM z""",
        "panel",
        steps={
            "x": "SELECT *, close / nullif(lag(close) OVER (PARTITION BY name ORDER BY date), 0) - 1 AS ret FROM panel",
            "y": "SELECT 'market' AS symbol, date, CAST(count(*) FILTER (ret > 0) AS BIGINT) AS advancing, CAST(count(*) FILTER (ret < 0) AS BIGINT) AS declining, CAST(count(*) FILTER (ret = 0) AS BIGINT) AS unchanged, avg(close) AS close FROM x GROUP BY date",
            "z": f"SELECT *, CAST(sum(advancing - declining) {SO_FAR} AS DOUBLE) AS ad_line, advancing / (declining + 1) AS ad_ratio FROM y",
        },
    ),
    "options_proxy_rank": query(
        f"""SELECT symbol, date, {r('p', 'vol_percentile')}, {flag('p > 75')} AS vol_regime_high, {flag('p < 25')} AS vol_regime_low, {flag('v10 > v30')} AS vol_expansion, {flag('v10 < v30')} AS vol_contraction, {r('v10 / (v60 + 1e-6)', 'vol_term_structure')}, {flag('v30 > 2 * med')} AS vol_spike, {r(f'ret / (v30 / {A} + 1e-6)', 'vol_adjusted_return')}, {flag('p > 75 AND ret < 0')} AS vol_fear, {flag('p < 25 AND ret > 0')} AS vol_complacency FROM w""",
        "bars",
        steps={
            **RET,
            "y": f"SELECT symbol, date, ret, {', '.join(f'{std('ret', k)} * {A} AS v{k}' for k in (10, 30, 60))} FROM x",
            "z": f"SELECT *, count(v30) {frame(252)} AS n, list(v30) {frame(252)} AS seen, quantile_cont(v30, 0.5) {frame(252)} AS m FROM y",
            "w": "SELECT *, CASE WHEN n >= 60 AND v30 IS NOT NULL THEN len(list_filter(seen, lambda q: q < v30)) / n * 100 END AS p, CASE WHEN n >= 60 THEN m END AS med FROM z",
        },
    ),
    "market_risk_features": query(
        f"""SELECT date, {r('vix', 'vix_level')}, {r(f"(vix - {mean('vix', 60)}) / nullif({std('vix', 60)}, 0)", 'vix_zscore_60d')}, {r(change('vix', 5), 'vix_roc_5d')}, {r(change('vix', 20), 'vix_roc_20d')}, {r(f"CASE WHEN count(vix) {frame(252)} >= 252 THEN len(list_filter(seen, lambda q: q < vix)) / 251 END", 'vix_percentile_252d')}, {r(std('vr', 20), 'vol_of_vix_20d')}, {r('rv5', 'rv_5d')}, {r('rv20', 'rv_20d')}, {r('rv5 / nullif(rv20, 0)', 'vol_ratio_5_20')}, {r('vix / 100 / nullif(rv20, 0)', 'vrp')}, {r(change('close', 5), 'spy_ret_5d')}, {r('(close - top10) / top10', 'trailing_dd_10d')} FROM y""",
        "market", "vix",
        steps={
            "a": "SELECT market.symbol, market.date, market.close, vix.vix FROM market ASOF LEFT JOIN vix ON market.date >= vix.date",
            "x": f"SELECT *, {change('close')} AS ret, {change('vix')} AS vr, list(vix) {frame(252)} AS seen FROM a",
            "y": f"SELECT *, {std('ret', 5)} * {A} AS rv5, {std('ret', 20)} * {A} AS rv20, {roll('max(close)', 'close', 10)} AS top10 FROM x",
        },
    ),
    "market_risk_targets": query(
        f"SELECT date, {r('dd', 'fwd_max_dd')}, CAST(CASE WHEN dd > 0.03 THEN 1 ELSE 0 END AS DOUBLE) AS drawdown_flag, {r('fv', 'fwd_realized_vol')} FROM y",
        "market",
        steps={"x": f"SELECT *, {change('close')} AS ret FROM market", "y": f"SELECT *, CASE WHEN count(close) w >= 10 THEN 1 - min(close) w / close END AS dd, CASE WHEN count(close) w >= 10 THEN stddev_pop(ret) w * {A} END AS fv FROM x".replace(" w ", " OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) ")},
    ),
    "quarterly_growth": query(
        f"SELECT symbol, quarter, {r('value', 'value')}, {r('(value - a) / nullif(abs(a), 0)', 'qoq')}, {r('(value - b) / nullif(abs(b), 0)', 'yoy')} FROM y",
        steps={"x": "SELECT o_orderpriority AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2", "y": "SELECT *, lag(value) OVER (PARTITION BY symbol ORDER BY quarter) AS a, lag(value, 4) OVER (PARTITION BY symbol ORDER BY quarter) AS b FROM x"},
    ),
    "vol_predictor_features": _predictor(),
    "vol_regime_targets": query(
        f"SELECT symbol, date, {flag('cv <= med')} AS current_low, {flag('cv > med')} AS current_high, {flag('cv <= med AND fut > med')} AS spike_target, {flag('cv > med AND fut <= med')} AS calm_target, {r('cv', 'current_vol')}, {r('med', 'vol_median')} FROM w",
        "bars",
        steps={
            "x": f"SELECT *, {change('close')} AS ret FROM bars",
            "y": f"SELECT *, {std('ret', 20)} * {A} AS rv FROM x",
            "z": f"SELECT *, {lag('rv')} AS cv, CASE WHEN count(ret) w >= 5 THEN stddev_samp(ret) w * {A} END AS fut FROM y".replace(" w ", " OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) "),
            "w": f"SELECT *, {roll('quantile_cont(cv, 0.5)', 'cv', 60)} AS med FROM z",
        },
    ),
    "rolling_beta": query(
        f"""SELECT symbol, {_all('current_beta current_r2 full_beta full_r2 beta_mean beta_std')}, {r('CASE WHEN abs(beta_mean) > 0.01 THEN abs(beta_std / beta_mean) END', 'beta_cv')}, {_all('beta_min beta_max')},
        CASE WHEN nb < 20 THEN 'unknown' WHEN recent > (CASE WHEN nb >= 40 THEN older ELSE beta_mean END) + 0.05 THEN 'rising' WHEN recent < (CASE WHEN nb >= 40 THEN older ELSE beta_mean END) - 0.05 THEN 'falling' ELSE 'stable' END AS beta_trend,
        CASE WHEN current_beta >= 1.5 THEN 'very high' WHEN current_beta >= 1.2 THEN 'high' WHEN current_beta >= 0.8 THEN 'market' WHEN current_beta >= 0.5 THEN 'low' WHEN current_beta >= 0 THEN 'very low' ELSE 'negative' END AS beta_label FROM g""",
        "bars", "market",
        steps={
            "j": "SELECT bars.symbol, bars.date, bars.close, market.close AS mc FROM bars JOIN market ON bars.date = market.date",
            "x": f"SELECT * FROM (SELECT *, {change('close')} AS ret, {change('mc')} AS mr FROM j) WHERE ret IS NOT NULL AND mr IS NOT NULL",
            "y": f"SELECT *, {roll('covar_samp(ret, mr)', 'ret', 60)} / {roll('var_samp(mr)', 'mr', 60)} AS beta, power({roll('covar_samp(ret, mr)', 'ret', 60)}, 2) / ({roll('var_samp(mr)', 'mr', 60)} * {roll('var_samp(ret)', 'ret', 60)}) AS r2, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM x",
            "g": "SELECT symbol, max(CASE WHEN back = 1 THEN beta END) AS current_beta, max(CASE WHEN back = 1 THEN r2 END) AS current_r2, covar_samp(ret, mr) / var_samp(mr) AS full_beta, power(corr(ret, mr), 2) AS full_r2, avg(beta) AS beta_mean, stddev_samp(beta) AS beta_std, min(beta) AS beta_min, max(beta) AS beta_max, count(beta) AS nb, avg(CASE WHEN back <= 20 THEN beta END) AS recent, avg(CASE WHEN back BETWEEN 21 AND 40 THEN beta END) AS older FROM y GROUP BY symbol",
        },
    ),
    "relative_strength": query(
        f"SELECT symbol, {', '.join(r(f'rs_{k}d', f'rs_{k}d') for k in f.SPANS)}, {r('composite', 'composite')}, CASE WHEN composite > 0.05 THEN 'leader' WHEN composite < -0.05 THEN 'laggard' ELSE 'in line' END AS label FROM z",
        "bars", "market",
        steps={
            "j": "SELECT bars.symbol, bars.close, market.close AS mc, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.date DESC) AS back FROM bars JOIN market ON bars.date = market.date",
            "y": "SELECT symbol, " + ", ".join(f"max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = {k} THEN close END) - max(CASE WHEN back = 1 THEN mc END) / max(CASE WHEN back = {k} THEN mc END) AS rs_{k}d" for k in f.SPANS) + " FROM j GROUP BY symbol",
            "z": "SELECT *, (" + " + ".join(f"coalesce(rs_{k}d, 0) * {w}" for k, w in f.SPANS.items()) + ") / nullif(" + " + ".join(f"CASE WHEN rs_{k}d IS NULL THEN 0 ELSE {w} END" for k, w in f.SPANS.items()) + ", 0) AS composite FROM y",
        },
    ),
    "hmm_features": query(
        f"SELECT symbol, date, {_all('close log_return realized_vol vol_norm_return trend_strength volume_ratio')}, {r('ln(volume_ratio)', 'log_volume_ratio')} FROM z WHERE log_return IS NOT NULL AND realized_vol IS NOT NULL AND vol_norm_return IS NOT NULL AND trend_strength IS NOT NULL AND volume_ratio IS NOT NULL",
        "bars",
        steps={**RET, "y": f"SELECT *, lr AS log_return, {std('lr', 20)} * {A} AS realized_vol, {mean('close', 50)} AS ma, volume / nullif({mean('volume', 20)}, 0) AS volume_ratio FROM x", "z": f"SELECT *, log_return / nullif(realized_vol / {A}, 0) AS vol_norm_return, (close - ma) / ma AS trend_strength FROM y"},
    ),
    "wasserstein_features": query(
        f"SELECT symbol, date, {_all('returns log_returns realized_vol trend_strength volume_ma volume_momentum momentum_10d momentum_20d hl_range vol_adj_returns')} FROM z WHERE returns IS NOT NULL AND realized_vol IS NOT NULL AND volume_ma IS NOT NULL AND momentum_20d IS NOT NULL",
        "bars",
        steps={**RET, "y": f"SELECT symbol, date, ret AS returns, lr AS log_returns, {std('ret', 20)} AS realized_vol, abs({mean('ret', 20)}) AS trend_strength, volume, {mean('volume', 20)} AS volume_ma, {change('close', 10)} AS momentum_10d, {change('close', 20)} AS momentum_20d, (high - low) / close AS hl_range FROM x", "z": "SELECT *, (volume - volume_ma) / (volume_ma + 1e-10) AS volume_momentum, returns / (realized_vol + 1e-10) AS vol_adj_returns FROM y"},
    ),
    "regime_quantile_labels": query(
        f"SELECT symbol, date, regime, {flag('regime = 2')} AS regime_trend_bull, {flag('regime = 0')} AS regime_trend_bear, CAST(coalesce(first_value(moved IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS DOUBLE) AS regime_change FROM u",
        "bars",
        steps={
            **RET, "y": f"SELECT *, {std('ret', 20)} AS v FROM x", "q": "SELECT symbol, quantile_cont(v, 0.33) AS a, quantile_cont(v, 0.67) AS b FROM y GROUP BY symbol",
            "z": "SELECT y.symbol, y.date, CAST(CASE WHEN v < a THEN 0 WHEN v > b THEN 2 ELSE 1 END AS INTEGER) AS regime FROM y JOIN q ON y.symbol = q.symbol", "u": f"SELECT *, abs(regime - {lag('regime')}) AS moved FROM z",
        },
    ),
    "sentiment_join_features": query(
        f"SELECT symbol, date, {r('s', 'sentiment_score')}, CAST(n AS BIGINT) AS sentiment_count, {r(f'coalesce(s - {lag('s', 3)}, 0)', 'sentiment_momentum_3d')}, {r(f'coalesce(s - {lag('s', 7)}, 0)', 'sentiment_momentum_7d')}, {r(f'coalesce({std('s', 14)}, 0)', 'sentiment_volatility')}, {flag('s > 0')} AS sentiment_positive, {flag('abs(s) > 0.5')} AS sentiment_extreme, {r('abs(s) * ln(1 + n)', 'sentiment_strength')} FROM x",
        "bars",
        steps={
            "sc": "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, sum(CASE WHEN l_discount > 0.05 THEN l_discount * 10 END) / 10 - avg(l_tax) * 10 AS sentiment_score, count(*) AS sentiment_count FROM lineitem WHERE day(l_shipdate) % 3 <> 0 GROUP BY 1, 2",
            "x": "SELECT bars.symbol, bars.date, coalesce(sentiment_score, 0) AS s, coalesce(sentiment_count, 0) AS n FROM bars LEFT JOIN sc ON bars.symbol = sc.symbol AND bars.date = sc.date",
        },
    ),
    "equity_curve": query(
        f"SELECT symbol, date, {r('equity', 'equity')}, {r('peak', 'peak')}, {r('equity / peak - 1', 'drawdown')}, {r(f'min(equity / peak - 1) {SO_FAR}', 'max_drawdown')} FROM z",
        "bars", steps={**RET, "y": f"SELECT *, product(1 + coalesce(ret, 0)) {SO_FAR} AS equity FROM x", "z": f"SELECT *, max(equity) {SO_FAR} AS peak FROM y"},
    ),
    "position_costs": query(
        f"SELECT symbol, date, {r('position', 'position')}, {r('traded', 'traded')}, {r(f'coalesce({lag('position')} * ret, 0) - traded * 0.001', 'net_return')} FROM y",
        "bars", steps={"x": f"SELECT *, {change('close')} AS ret, CAST(CASE WHEN close > {mean('close', 20)} THEN 1.0 ELSE 0.5 END AS DOUBLE) AS position FROM bars", "y": f"SELECT *, coalesce(abs(position - {lag('position')}), 0) AS traded FROM x"},
    ),
}
