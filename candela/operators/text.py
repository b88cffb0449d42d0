"""Text: topics, lexicon sentiment, articles, extraction, chunks, nearest vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Topics with their words, how much harder bad news hits, and their bias.
TOPICS = {
    "litigation": (("lawsuit", "court", "settle", "fraud", "fine", "the"), 1.5, -0.02),
    "earnings": (("earnings", "revenue", "profit", "guidance", "eps", "tion"), 1.2, 0.0),
    "mna": (("merger", "acqui", "takeover", "deal", "ein"), 1.0, 0.0),
    "management": (("ceo", "resign", "appoint", "director", "que"), 1.3, -0.005),
    "product": (("launch", "product", "recall", "eau"), 1.1, 0.0),
}
POSITIVE = ("good", "gain", "best", "strong", "and", "les", "und", "los")
NEGATIVE = ("bad", "loss", "weak", "worst", "of", "idiot", "scum", "loser", "de")
UNCERTAIN = ("may", "might", "could", "risk", "or", "ou", "oder")
HIGH_SIGNAL = ("litigation", "earnings", "management")


def pattern(words: tuple[str, ...]) -> str:
    """Any of the words, longer ones first."""
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def topics(articles: DataFrame) -> DataFrame:
    """article_id, ticker, body -> with scores (a struct a topic), primary and secondary topics. A topic scores one for each
    of its words found and half for each repeat; words count within other words; ties go to the topic listed first."""
    low = F.lower("body")
    scores = []
    for name, (words, _, _) in TOPICS.items():
        found = F.regexp_extract_all(low, F.lit(f"({pattern(words)})"), F.lit(1))
        scores.append(F.struct(F.lit(name).alias("topic"), F.transform(F.array(found), lambda x: F.size(F.array_distinct(x)) * 0.5 + F.size(x) * 0.5)[0].alias("score")))
    out = articles.withColumn("scores", F.filter(F.array(*scores), lambda s: s["score"] > 0))
    best = F.array_max(F.transform("scores", lambda s: s["score"]))
    out = out.withColumn("primary", F.coalesce(F.get(F.filter("scores", lambda s: s["score"] == best), F.lit(0))["topic"], F.lit("general")))
    second = F.transform(F.filter("scores", lambda s: (s["score"] >= 1) & (s["topic"] != F.col("primary"))), lambda s: s["topic"])
    return out.withColumn("secondary", F.array_sort(second))


def _count(words: Column, of: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*of)))


def lexicon(articles: DataFrame) -> DataFrame:
    """Positive, negative and uncertain words, and (positive - negative) / root of words, within [-1, 1]."""
    words = F.transform(F.filter(F.split(F.lower("body"), r"[ \n\t\r]+"), lambda w: w != ""), lambda w: F.btrim(w, F.lit(".,!?;:")))
    out = articles.withColumn("words", words).withColumn("n", F.size("words"))
    out = out.select(*articles.columns, "n", _count(F.col("words"), POSITIVE).alias("pos"), _count(F.col("words"), NEGATIVE).alias("neg"), _count(F.col("words"), UNCERTAIN).alias("unc"))
    root = F.sqrt("n")
    out = out.withColumn("sentiment", F.when(F.col("n") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("pos") - F.col("neg")) / root))).otherwise(0.0))
    return out.withColumn("uncertainty", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("unc") / root)).otherwise(0.0))


def signals(articles: DataFrame) -> DataFrame:
    """Sentiment adjusted by the primary topic: bad news hits harder and good news less where the topic says so."""
    out = lexicon(topics(articles))
    multiplier = F.coalesce(*[F.when(F.col("primary") == t, F.lit(m)) for t, (_, m, _) in TOPICS.items()], F.lit(1.0))
    bias = F.coalesce(*[F.when(F.col("primary") == t, F.lit(b)) for t, (_, _, b) in TOPICS.items()], F.lit(0.0))
    s = F.col("sentiment")
    adjusted = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(s < 0, s * multiplier).otherwise(s * (2 - multiplier)) + bias))
    out = out.withColumn("adjusted", adjusted)
    signal = F.when(F.col("adjusted") > 0.15, "bullish").when(F.col("adjusted") < -0.15, "bearish").otherwise("neutral")
    return out.withColumn("signal", signal).withColumn("expected_return", F.col("adjusted") * 0.02)


def topic_aggregate(articles: DataFrame) -> DataFrame:
    """By ticker: the composite of its topics' mean sentiments, each weighing the root of its articles, and alerts."""
    s = signals(articles)
    # one pass: the primary topic and, at half weight, the secondary ones. The outer form keeps the optimizer from
    # filtering on the array first, which would find all topics twice
    named = F.concat(F.array(F.struct(F.col("primary").alias("topic"), F.lit(1.0).alias("share"))), F.transform("secondary", lambda x: F.struct(x.alias("topic"), F.lit(0.5).alias("share"))))
    t = s.select("ticker", "adjusted", F.explode_outer(named).alias("t")).select("ticker", "t.topic", (F.col("adjusted") * F.col("t.share")).alias("v"))
    t = t.groupBy("ticker", "topic").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    weight = F.sqrt("n") * F.when(F.col("topic").isin(*HIGH_SIGNAL), 1.5).otherwise(1.0)
    of = lambda name, c: F.coalesce(F.max(F.when(F.col("topic") == name, F.col(c))), F.lit(0.0))
    g = t.groupBy("ticker").agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("composite_score"), F.count("*").alias("topics"), F.sum("n").alias("mentions"), of("litigation", "v").alias("lv"), of("litigation", "n").alias("ln"), of("earnings", "v").alias("ev"))
    composite = F.when(F.col("composite_score") > 0.1, "bullish").when(F.col("composite_score") < -0.1, "bearish").otherwise("neutral")
    return g.select("ticker", "composite_score", composite.alias("composite_signal"), "topics", "mentions", ((F.col("ln") >= 2) & (F.col("lv") < -0.2)).alias("litigation_alert"), (F.abs("ev") > 0.3).alias("earnings_surprise"))


def earnings_signal(articles: DataFrame) -> DataFrame:
    """By ticker, from the articles whose primary topic is earnings: mean sentiment, agreement with the raw one, direction."""
    s = signals(articles)
    mine = F.col("primary") == "earnings"
    g = s.groupBy("ticker").agg(F.count("*").alias("total_articles"), F.count_if(mine).alias("earnings_articles"), F.avg(F.when(mine, F.col("adjusted"))).alias("topic_sentiment"), F.avg(F.when(mine, F.col("sentiment"))).alias("raw_sentiment"))
    v = F.coalesce("topic_sentiment", F.lit(0.0))
    direction = F.when(v > 0.1, "bullish").when(v < -0.1, "bearish").otherwise("neutral")
    agree = F.col("topic_sentiment") * F.col("raw_sentiment") > 0
    boost = F.when(F.coalesce(agree, F.lit(False)), 1.3).otherwise(1.0)
    return g.select("ticker", "total_articles", "earnings_articles", v.alias("topic_sentiment"), agree.alias("models_agree"), direction.alias("direction"), F.least(F.lit(1.0), F.least(F.col("earnings_articles") / 5, F.lit(1.0)) * boost).alias("confidence"), (F.col("earnings_articles") >= 3).alias("is_tradeable"))


def latest(articles: DataFrame, ticker: str, since: int, k: int = 200) -> DataFrame:
    """The k newest articles of a ticker in any case, newest first by id."""
    return articles.filter((F.upper("ticker") == ticker.upper()) & (F.col("article_id") >= since)).orderBy(F.desc("article_id")).limit(k)


def links(pages: DataFrame) -> DataFrame:
    """Each link of a page with its place, target and text."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(0))
    out = pages.select("page_id", F.posexplode(found).alias("place", "a"))
    return out.select("page_id", "place", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("target"), F.regexp_extract("a", r">([^<]*)</a>", 1).alias("text"))


def verdicts(conversations: DataFrame) -> DataFrame:
    """From each turn: the first number, how it leans by words, and its length."""
    number = F.expr("try_cast(nullif(regexp_extract(text, '(-?[0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE)")
    lean = F.when(F.lower("text").rlike("buy|bullish|tion"), "buy").when(F.lower("text").rlike("sell|bearish|ung"), "sell").otherwise("hold")
    return conversations.select("conv_id", "turn", F.upper("role").alias("role"), number.alias("number"), lean.alias("verdict"), F.length("text").cast("long").alias("n_chars"))


def event_props(events: DataFrame) -> DataFrame:
    """The JSON column read by a schema, and its sums by type."""
    k = F.from_json("props", "k INT")["k"]
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("sum_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"), F.count_if(k.isNull()).alias("missing"))


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Whole texts in pieces of `size` characters, each overlapping the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    out = docs.filter("text is not null").select("doc_id", "text", F.posexplode(starts).alias("chunk", "start"))
    return out.select("doc_id", "chunk", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("body")).select("doc_id", "chunk", "start", F.length("body").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 6, block: int = 512, limit: int = 100_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k vectors of largest cosine, itself left out, ties to the smaller id.

    Queries (id, x) are a bounded set, checked against `limit`; they are broadcast in double precision and each task scores
    its vectors block by block, passing on k a query; the rest is a top-k by query.
    """
    asked = queries.limit(limit + 1).toArrow()
    if asked.num_rows > limit:
        raise ValueError(f"more than {limit} queries")
    if not asked.num_rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids = asked["query_id"].to_numpy()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rows = lambda c: np.array(c.to_pylist(), np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, unit(rows(asked["x"]))))

    def run(batches):
        qid, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vid, x = np.array(batch.column(0).to_pylist()), unit(rows(batch.column(1)))
            by = np.argsort(vid, kind="stable")
            vid, x = vid[by], x[by]
            for i in range(0, len(qid), block):
                s = q[i : i + block] @ x.T
                s[qid[i : i + block, None] == vid[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                a = np.repeat(np.arange(len(s)), top.shape[1])
                b = top.ravel()
                ok = np.isfinite(s[a, b])
                yield pa.RecordBatch.from_arrays([pa.array(qid[i + a[ok]]), pa.array(vid[b[ok]]), pa.array(s[a[ok], b[ok]])], names=["query_id", "vec_id", "score"])

    found = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
