"""Tools by name: a description, a JSON schema of the arguments, and a function (spark, sf_dir, arguments) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators import features, metrics, sequences
from candela.sources import bars as s


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[[SparkSession, str, dict], DataFrame]
    parameters: dict = field(default_factory=dict)


_tools: dict[str, Tool] = {}


def register(tool: Tool) -> None:
    if tool.name in _tools:
        raise ValueError(f"{tool.name} is registered already")
    _tools[tool.name] = tool


def names() -> list[str]:
    return sorted(_tools)


def schemas() -> list[dict]:
    """What a planner is told of each tool."""
    return [{"name": t.name, "description": t.description, "parameters": {"type": "object", "properties": t.parameters, "required": [k for k, v in t.parameters.items() if "default" not in v]}} for _, t in sorted(_tools.items())]


def call(spark: SparkSession, sf_dir: str, name: str, arguments: dict | None = None) -> DataFrame:
    """Run a tool; arguments are checked against its schema and completed by its defaults."""
    if name not in _tools:
        raise KeyError(f"no tool {name}; there are {', '.join(names())}")
    tool, given = _tools[name], dict(arguments or {})
    if extra := set(given) - set(tool.parameters):
        raise ValueError(f"{name} takes no {', '.join(sorted(extra))}")
    for k, spec in tool.parameters.items():
        if k not in given:
            if "default" not in spec:
                raise ValueError(f"{name} needs {k}")
            given[k] = spec["default"]
    return tool.run(spark, sf_dir, given)


SYMBOL = {"symbol": {"type": "string"}}


def _of(frame: DataFrame, a: dict) -> DataFrame:
    return frame.filter(F.col("symbol") == a["symbol"])


for _tool in (
    Tool("price_data", "The latest bars of a symbol", lambda sp, sf, a: _of(s.bars(sp, sf), a).orderBy(F.desc("date")).limit(a["bars"]), SYMBOL | {"bars": {"type": "integer", "default": 30}}),
    Tool("rsi", "Relative strength index", lambda sp, sf, a: features.rsi(_of(s.bars(sp, sf), a), a["period"]), SYMBOL | {"period": {"type": "integer", "default": 14}}),
    Tool("macd", "Convergence of averages seeded by a mean", lambda sp, sf, a: sequences.macd_seeded(_of(s.bars(sp, sf), a)), SYMBOL),
    Tool("atr", "Average true range", lambda sp, sf, a: features.atr(_of(s.bars(sp, sf), a), a["period"]), SYMBOL | {"period": {"type": "integer", "default": 14}}),
    Tool("bollinger_bands", "Bands of population deviations", lambda sp, sf, a: features.bollinger(_of(s.bars(sp, sf), a), population=True), SYMBOL),
    Tool("volume_analysis", "Volume against its mean and spikes", lambda sp, sf, a: _of(metrics.volume_spikes(s.bars(sp, sf)), a), SYMBOL),
    Tool("stock_beta", "Rolling beta against the market", lambda sp, sf, a: _of(features.rolling_beta(s.bars(sp, sf), s.market(sp, sf)), a), SYMBOL),
    Tool("relative_strength", "Strength against the market over several spans", lambda sp, sf, a: _of(features.relative_strength(s.bars(sp, sf), s.market(sp, sf)), a), SYMBOL),
    Tool("bocpd_regime", "Change points of the market, whatever the symbol", lambda sp, sf, a: sequences.bocpd(s.market(sp, sf).withColumn("symbol", F.lit("market"))), {"symbol": {"type": "string", "default": "market"}}),
    Tool("market_risk", "The market's risk features", lambda sp, sf, a: features.market_risk(s.market(sp, sf), s.vix(sp, sf))),
    Tool("vol_prediction", "What the volatility predictor sees", lambda sp, sf, a: _of(features.vol_predictor(s.bars(sp, sf), s.vix(sp, sf)), a), SYMBOL),
    Tool("trade_memory", "Statistics of closed trades", lambda sp, sf, a: metrics.trade_stats(s.trades(sp, sf))),
):
    register(_tool)
