"""More tools for the registry, and the query that lists them all."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import change
from candela.operators import detectors as d
from candela.operators import features as f
from candela.operators import labels as b
from candela.operators import metrics as m
from candela.operators import reports as p
from candela.operators import sequences as q
from candela.operators import text as t
from candela.plans import label_queries, learner_queries, report_queries
from candela.plans.registry import SYMBOL, Tool, _of, names, register, schemas
from candela.sources import bars as s

TICKER = {"ticker": {"type": "string"}}


def _bars(sp, sf, a):
    return _of(s.bars(sp, sf), a)


def _ticker(frame, a):
    return frame.filter(F.col("ticker") == a["ticker"])


for _tool in (
    Tool("moving_averages", "Simple averages and their crossings", lambda sp, sf, a: f.moving_averages(_bars(sp, sf, a)), SYMBOL),
    Tool("ema", "Exponential averages and their convergence", lambda sp, sf, a: q.macd(_bars(sp, sf, a)), SYMBOL),
    Tool("ticker_details", "An asset's tier and what told it", lambda sp, sf, a: label_queries._assets(sp, sf).filter(F.col("name") == a["name"]), {"name": {"type": "string"}}),
    Tool("previous_close", "Last close, the one before, latest splits", lambda sp, sf, a: b.previous_close(_bars(sp, sf, a)), SYMBOL),
    Tool("earnings", "Growth by quarter", lambda sp, sf, a: label_queries._growth(sp, sf).filter(F.col("symbol") == a["symbol"]), SYMBOL),
    Tool("earnings_proximity", "Days to the next event and the risk they stand for", lambda sp, sf, a: p.event_proximity(_bars(sp, sf, a).select("symbol", "date"), report_queries._events(sp, sf)), SYMBOL),
    Tool("fundamentals", "Scores of quality, value and health", lambda sp, sf, a: _of(p.fundamentals(report_queries._fundamentals(sp, sf)), a), SYMBOL),
    Tool("economic_series", "Latest observation of each series", lambda sp, sf, a: b.latest_observations(label_queries._observed(sp, sf))),
    Tool("news_sentiment", "Sentiment of a ticker's articles by words", lambda sp, sf, a: t.lexicon(_ticker(s.articles(sp, sf), a)).select("article_id", "sentiment", "uncertainty"), TICKER),
    Tool("topic_sentiment", "A ticker's composite of topics", lambda sp, sf, a: t.topic_aggregate(_ticker(s.articles(sp, sf), a)), TICKER),
    Tool("earnings_sentiment", "Direction from a ticker's articles on earnings", lambda sp, sf, a: t.earnings_signal(_ticker(s.articles(sp, sf), a)), TICKER),
    Tool("latest_articles", "A ticker's newest articles", lambda sp, sf, a: t.latest(s.articles(sp, sf), a["ticker"], 0, a["count"]), TICKER | {"count": {"type": "integer", "default": 20}}),
    Tool("options_summary", "Puts against calls by day", lambda sp, sf, a: m.put_call(s.table(sp, sf, "events"))),
    Tool("regime_detector", "Gate, position and regimes told by five channels", lambda sp, sf, a: d.alpha_detector(_bars(sp, sf, a)), SYMBOL),
    Tool("regime_now", "The current regime, its risk and trends", lambda sp, sf, a: d.current(_of(label_queries._tamed(sp, sf), a)), SYMBOL),
    Tool("regime_consensus", "Whether two models tell the same risk", lambda sp, sf, a: _of(label_queries._agreement(sp, sf), a), SYMBOL),
    Tool("recent_regimes", "The last changes of regime", lambda sp, sf, a: _of(b.recent_changes(report_queries._labels(sp, sf)), a), SYMBOL),
    Tool("ml_prediction", "Odds of a rise by four models, and how they did", lambda sp, sf, a: learner_queries.l.by_part(learner_queries.l.fit_predict(_of(learner_queries._rows(sp, sf), a), learner_queries.NAMES)), SYMBOL),
    Tool("capture_ratios", "Part taken in the market's rises and falls", lambda sp, sf, a: m.capture(_bars(sp, sf, a), s.market(sp, sf)), SYMBOL),
    Tool("returns", "Last returns of a symbol", lambda sp, sf, a: _bars(sp, sf, a).select("symbol", "date", change("close").alias("r")).orderBy(F.desc("date")).limit(a["bars"]), SYMBOL | {"bars": {"type": "integer", "default": 30}}),
):
    register(_tool)


def _catalogue(spark, sf_dir):
    """Every tool with its arguments, those without a default being needed."""
    rows = [(x["name"], x["description"], sorted(x["parameters"]["properties"]), sorted(x["parameters"]["required"])) for x in schemas()]
    out = spark.createDataFrame(rows, "tool string, description string, arguments array<string>, needed array<string>")
    return out.select("tool", "description", F.array_join("arguments", ",").alias("arguments"), F.array_join("needed", ",").alias("needed"))


QUERIES = {"tool_catalogue": _catalogue}
ORACLE: dict[str, str] = {}
assert len(names()) >= 32
