"""Regimes told by Bayesian change points on scaled trends, under a hazard that follows volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.frames import mean, std
from candela.operators.labels import regimes, trend_features
from candela.operators.sequences import RunLength, RunLengths, min_duration, scan

# The detector's settings.
HAZARD, HAZARD_LOW, HAZARD_HIGH = 1 / 126, 1 / 252, 1 / 42
KAPPA, ALPHA, BETA = 0.1, 2.0, 2.0
SCALE_WINDOW, HAZARD_WINDOW, HAZARD_HISTORY = 21, 21, 126
RUN_FLOOR, RUN_STABLE = 3.0, 30.0
RUN_SHARE, VOL_SHARE, CALM_VOL, WILD_VOL = 0.7, 0.3, 0.12, 0.25
SHORTEST = 4
# The gate and the overlay.
GATE_SPAN, CP_LOW, CP_HIGH, CP_SPIKE, CP_HOLD, VOL_SPIKE, VOL_SEVERE = 5, 0.02, 0.10, 0.10, 0.03, 0.05, 0.10
RUN_ENTER, RUN_LEAST, RUN_EXIT, RUN_SEVERE, CALM_RISK, CALM_DAYS = 20.0, 5.0, 40.0, 10.0, 0.15, 5
NORMAL, IN_TRANSITION, SEVERE = 1.0, 0.75, 0.25
# Channels, their weights in the noisy-or, and the model of each.
CHANNELS = {"z_ret": 0.6, "z_gap": 0.5, "intraday": 0.5, "log_sigma": 1.2, "range_vol": 1.5}
CHANNEL_HAZARD, CHANNEL_BETA, SPACING = 1 / 200, 1.0, 15


def within(x: Column, low: float, high: float) -> Column:
    """x mapped from [low, high] to [0, 1], held there; null where x is."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low))))


def scaled_trends(bars: DataFrame) -> DataFrame:
    """symbol, date, x, hazard: the 21-bar trend over its own deviation, and the chance of a change that its volatility's
    z-score gives by a logistic curve; the default chance until there is enough history."""
    x = trend_features(bars).filter("trend_21 is not null").select("symbol", "date", "trend_21")
    x = x.select("symbol", "date", (F.col("trend_21") / F.greatest(std("trend_21", SCALE_WINDOW), F.lit(1e-6))).alias("x")).filter("x is not null")
    x = x.withColumn("vol", std("x", HAZARD_WINDOW))
    z = F.try_divide(F.col("vol") - mean("vol", HAZARD_HISTORY), std("vol", HAZARD_HISTORY))
    z = F.when(z.isNotNull(), F.least(F.lit(3.0), F.greatest(F.lit(-3.0), z)))
    return x.select("symbol", "date", "x", F.coalesce(HAZARD_LOW + (HAZARD_HIGH - HAZARD_LOW) / (1 + F.exp(-z)), F.lit(HAZARD)).alias("hazard"))


def change_points(rows: DataFrame) -> DataFrame:
    """symbol, date, x, hazard -> the chance that a run starts there, the likeliest and the expected run length."""

    def start():
        model = RunLength(HAZARD, KAPPA, ALPHA, BETA, first=False)

        def step(x: float, hazard: float) -> tuple:
            model.h = hazard
            return model.update(x)

        return step

    return scan(rows, ["x", "hazard"], "cp_prob double, map_run_length int, erl double", start)


def risk_scores(bars: DataFrame) -> DataFrame:
    """symbol, date, risk, trend_21, trend_63, volatility: risk is high where runs are short and volatility is high; null
    until the detector has something to go by."""
    t = trend_features(bars)
    found = change_points(scaled_trends(bars)).select("symbol", "date", "erl")
    risk = RUN_SHARE * (1 - within(F.greatest("erl", F.lit(RUN_FLOOR)), RUN_FLOOR, RUN_STABLE)) + VOL_SHARE * within(F.col("volatility"), CALM_VOL, WILD_VOL)
    out = t.join(found, ["symbol", "date"], "left")
    return out.select("symbol", "date", F.when(F.col("erl").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk))).alias("risk"), "trend_21", "trend_63", "volatility")


def bocpd_regimes(bars: DataFrame) -> DataFrame:
    """symbol, date, regime, run, regime_smooth: the rules' labels from the detector's risk, and those without short runs."""
    return min_duration(regimes(risk_scores(bars)), SHORTEST)


def gate_start():
    """A gate that opens at once and closes slowly, and the position that follows from it.

    It opens on a high chance of a change, a short expected run or a spike of the volatility channel. It closes after
    CALM_DAYS calm rows on which neither the smoothed chance nor a run still short holds it open. The position is smoothed.
    """
    state = {"open": False, "smooth": 0.0, "calm": 0, "position": None}
    a = 2 / (GATE_SPAN + 1)

    def step(cp: float, run: float, vol_cp: float) -> tuple:
        state["smooth"] = a * cp + (1 - a) * state["smooth"]
        by_cp = min(1.0, max(0.0, (cp - CP_LOW) / (CP_HIGH - CP_LOW)))
        by_run = min(1.0, max(0.0, (RUN_ENTER - run) / (RUN_ENTER - RUN_LEAST)))
        risk = max(by_cp, by_run)
        if not state["open"]:
            if cp > CP_SPIKE or run < RUN_ENTER or vol_cp > VOL_SPIKE:
                state.update(open=True, calm=0)
        else:
            held = state["smooth"] > CP_HOLD or run < RUN_EXIT
            state["calm"] = 0 if held or risk >= CALM_RISK else state["calm"] + 1
            if state["calm"] >= CALM_DAYS:
                state.update(open=False, calm=0)
        severe = vol_cp > VOL_SEVERE or run < RUN_SEVERE or by_run > 0.9 and vol_cp > VOL_SPIKE
        raw = SEVERE if severe else 1 - risk * (1 - IN_TRANSITION) if state["open"] else NORMAL
        state["position"] = raw if state["position"] is None else a * raw + (1 - a) * state["position"]
        return int(state["open"]), by_cp, by_run, state["position"]

    return step


def gated(rows: DataFrame) -> DataFrame:
    """symbol, date, cp, run, vol_cp -> whether the gate is open, risk by chance and by run, and the position for the day
    after."""
    return scan(rows, ["cp", "run", "vol_cp"], "in_transition int, risk_cp double, risk_rl double, position double", gate_start)


def alpha_detector(bars: DataFrame, warmup: int = 20) -> DataFrame:
    """Five channels (return, gap, place in the range, log deviation, range), each with its own run lengths; their weighted
    noisy-or, the gate, the position for the day after, and regimes numbered by confirmed changes.

    The channels come from labels and sequences: what each bar tells against those before it. The first `warmup` bars of a
    symbol only feed them.
    """
    from candela.operators.labels import tail_rates
    from candela.operators.sequences import online_features

    f = online_features(bars).select("symbol", "date", F.col("ret_z").alias("z_ret"), F.col("gap_z").alias("z_gap"), F.col("clv").alias("intraday"), F.log("sigma").alias("log_sigma"))
    rows = f.join(tail_rates(bars).select("symbol", "date", F.col("range_vol_z").alias("range_vol")), ["symbol", "date"])

    def start():
        models = {k: RunLength(CHANNEL_HAZARD, KAPPA, ALPHA, CHANNEL_BETA) for k in CHANNELS}
        gate, state = gate_start(), [0, 0, 0]  # rows, the row of the last change, changes

        def step(*xs: float) -> tuple:
            quiet, told = 1.0, {}
            for (k, model), x in zip(models.items(), xs):
                told[k] = model.update(x)
                quiet *= 1 - min(1.0, max(0.0, CHANNELS[k] * told[k][0]))
            state[0] += 1
            if state[0] <= warmup:
                return None, None, None, None, None, 0
            vol = max(told["log_sigma"][0], told["range_vol"][0])
            opened, by_cp, by_run, position = gate(1 - quiet, told["z_ret"][2], vol)
            if opened and state[0] - state[1] >= SPACING and max(by_cp, by_run) > 0.5:
                state[1:] = [state[0], state[2] + 1]
            return 1 - quiet, told["z_ret"][2], vol, opened, position, state[2]

        return step

    return scan(rows, list(CHANNELS), "change_prob double, expected_run_length double, vol_change_prob double, in_transition int, position double, regime_id int", start)


def joint_changes(bars: DataFrame) -> DataFrame:
    """Run lengths of return, gap and place in the range taken together."""
    from candela.operators.sequences import online_features

    rows = online_features(bars).select("symbol", "date", F.col("ret_z").alias("a"), F.col("gap_z").alias("b"), F.col("clv").alias("c"))

    def start():
        model = RunLengths(CHANNEL_HAZARD, 3, CHANNEL_BETA)
        return lambda *xs: model.update(xs)

    return scan(rows, ["a", "b", "c"], "change_prob double, map_run_length int, expected_run_length double", start)


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 0.70, "HIGH").when(risk >= 0.45, "ELEVATED").when(risk >= 0.25, "MODERATE").when(risk.isNotNull(), "LOW")


def current(bars: DataFrame) -> DataFrame:
    """By symbol, the state at the last bar that the detector knows: regime, risk and its level, trends, volatility."""
    from pyspark.sql import Window as W

    rows = risk_scores(bars).filter("risk is not null").join(bocpd_regimes(bars).select("symbol", "date", "regime_smooth"), ["symbol", "date"])
    last = rows.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).filter("k = 1")
    return last.select("symbol", "date", F.col("regime_smooth").alias("regime"), "risk", risk_level(F.col("risk")).alias("risk_level"), "trend_21", "trend_63", "volatility")
