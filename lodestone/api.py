"""Entry points by name: thin compositions of the operators over DataFrames that the caller passes.

Each returns a lazy DataFrame. Tables carry the columns of the blueprint (decisions, incidents,
drivers, guidelines, messages, events); filters that are None do not apply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numbers import expected_value
from lodestone.functions.text import snippet, tokens
from lodestone.operators import features, relational, retrieval, rulings, stats, temporal
from lodestone.streaming import live

# ---------------------------------------------------------------- documents and search


def list_documents(documents: DataFrame, season: int | None = None, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of documents, newest first; ``q`` asks for all of its terms in the text."""
    rows = relational.where_given(documents, season=season)
    if q:
        rows = rows.where(retrieval.all_terms(F.col("raw_text"), tokens(F.lit(q))))
    return relational.page(rows.drop("raw_text"), [F.desc_nulls_last("published_at"), F.col("doc_id")], limit, offset)


def get_document(documents: DataFrame, doc_id: str) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id)


def bm25_search(documents: DataFrame, q: str, k: int = 20, title_weight: float = 2.0) -> DataFrame:
    """(doc_id, score, rank, title, snippet): best documents for a text, words of titles counting more."""
    asked = documents.sparkSession.createDataFrame([(0, q)], "query int, q string")
    hits = retrieval.bm25(documents, asked, "doc_id", {"title": title_weight, "raw_text": 1.0}, "query", "q", k)
    cards = documents.select("doc_id", "title", snippet(F.col("raw_text"), tokens(F.lit(q))).alias("snippet"))
    return relational.ordered_fetch(cards, hits.select("doc_id", "score", "rank"), "doc_id").join(hits.select("doc_id", "score"), "doc_id")


def hybrid_search(documents: DataFrame, q: str, vectors: DataFrame | None = None, asked: Sequence[float] | None = None, k: int = 20, depth: int = 100) -> DataFrame:
    """(doc_id, rrf_score, rank, title): lexical and vector hits fused; lexical alone without vectors or a query vector.

    vectors: doc_id, vector. ``asked`` is the vector of the query, from the same model.
    """
    spark = documents.sparkSession
    query = spark.createDataFrame([(-1, q)], "query bigint, q string")
    lexical = retrieval.bm25(documents, query, "doc_id", "raw_text", "query", "q", depth).select("query", "doc_id", "rank")
    near = None
    if vectors is not None and asked is not None:
        one = spark.createDataFrame([(-1, [float(x) for x in asked])], "doc_id bigint, vector array<double>")
        hits = retrieval.vector_top_k(vectors.select("doc_id", "vector"), one, "doc_id", "vector", depth)
        near = hits.select("query", F.col("key").alias("doc_id"), "rank")
    fused = retrieval.fuse([lexical, near], ["query"], "doc_id", k)
    return fused.join(documents.select("doc_id", "title"), "doc_id").select("doc_id", "rrf_score", "rank", "title")


def neighbours(edges: DataFrame, cards: DataFrame, item: int, n: int = 5) -> DataFrame:
    """The first n stored neighbours of an item, joined to their cards. edges: src, dst, score, rank; cards: dst, …"""
    return edges.where((F.col("src") == item) & (F.col("rank") <= n)).join(cards, "dst")


# ---------------------------------------------------------------- incidents and statistics


def list_incidents(incidents: DataFrame, driver: str | None = None, limit: int = 50, offset: int = 0, **equal: object) -> DataFrame:
    """A page of incidents by equality filters and a driver's code, newest season first."""
    rows = relational.where_given(incidents, **equal)
    if driver:
        rows = rows.where(relational.has_element(F.col("drivers"), "code", driver))
    return relational.page(rows, [F.desc("season"), F.col("incident_id")], limit, offset)


def incident_detail(incidents: DataFrame, documents: DataFrame, messages: DataFrame, bridge: DataFrame, incident_id: int) -> DataFrame:
    """One incident with its document and the messages linked to it (array in order of time)."""
    one = incidents.where(F.col("incident_id") == incident_id)
    linked = relational.through_bridge(one.select("incident_id"), bridge, messages, "incident_id", "message_id")
    lists = linked.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("message_time", "message_id", "message"))).alias("messages"))
    return one.join(documents.drop("season"), "doc_id", "left").join(lists, "incident_id", "left")


def consistency_heatmap(incidents: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    """Shares of outcomes by category and season."""
    return stats.shares(incidents, ["category", "season"], "penalty", outcomes)


def category_variance(incidents: DataFrame) -> DataFrame:
    counts = stats.outcome_counts(incidents, ["category"], "penalty")
    return stats.variance(counts, ["category"], "penalty", stats.severity(F.col("penalty")))


def category_trend(incidents: DataFrame, seasons: int = 5) -> DataFrame:
    """Whether the mean severity of each category rises or falls over the last seasons."""
    recent = relational.last_seasons(incidents, "season", seasons)
    yearly = recent.groupBy("category", "season").agg(F.avg(stats.severity(F.col("penalty"))).alias("v"))
    return stats.trend(yearly, "category", "season", "v")


def panel_chi_squared(incidents: DataFrame) -> DataFrame:
    return stats.chi_squared(stats.outcome_counts(incidents, ["panel"], "penalty"), "panel", "penalty")


def entity_cockpit(incidents: DataFrame, code: str) -> DataFrame:
    """One row for a driver: rulings, points in all and in the newest season, histogram of penalties, risk and ban score."""
    own = incidents.where(relational.has_element(F.col("drivers"), "code", code)).withColumn("entity", F.lit(code))
    newest = own.agg(F.max("season").alias("latest"))
    sums = own.crossJoin(F.broadcast(newest)).groupBy("entity", "latest").agg(
        F.count(F.lit(1)).alias("rulings"), F.sum("points").alias("points"), F.sum(F.when(F.col("season") == F.col("latest"), F.col("points"))).alias("recent_points")
    )
    recent = F.coalesce("recent_points", F.lit(0))
    sums = sums.withColumn("risk", stats.risk_band(recent)).withColumn("ban_score", F.round(F.least(recent / 12.0, F.lit(1.0)), 4))
    return sums.join(relational.penalty_histogram(own, ["entity"], "penalty"), "entity", "left")


def extract_fields(documents: DataFrame, text: str = "raw_text") -> DataFrame:
    return rulings.extract_fields(documents, text)


# ---------------------------------------------------------------- guidelines, telemetry, annotations


def list_guidelines(guidelines: DataFrame, document: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Guidelines in the natural order of their article numbers."""
    from lodestone.functions.text import natural_key

    rows = relational.where_given(guidelines, document_name=document)
    return relational.page(rows, [natural_key(F.col("article_number")), F.col("article_id")], limit, offset)


def linked_documents(guidelines: DataFrame, incidents: DataFrame, article_id: str) -> DataFrame:
    """Incidents that cite a guideline's article."""
    cited = incidents.withColumn("article_number", F.explode("article_cited"))
    return cited.join(guidelines.where(F.col("article_id") == article_id).select("article_number"), "article_number", "left_semi").drop("article_number").distinct()


def slice_window(laps: DataFrame, driver: int, lap: int, width: int = 2) -> DataFrame:
    """Laps of a driver around one lap."""
    return laps.where((F.col("driver") == driver) & F.col("lap").between(max(1, lap - width), lap + width))


def compare(telemetry: DataFrame, drivers: Sequence[int], lap: int, channels: Sequence[str]) -> DataFrame:
    """The channels of two to four drivers on one lap, null for a driver without data."""
    return relational.compare_rows(telemetry, "driver", drivers, ["ts"], channels, F.col("lap") == lap)


def annotation_stats(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def export_triplets(annotations: DataFrame) -> DataFrame:
    """(anchor, positive, negative) of annotations that name both."""
    pairs = lambda c: annotations.where(F.col(c).isNotNull()).select(F.col("doc_id").alias("anchor"), F.col(c).alias("other")).distinct()
    return retrieval.triplets(pairs("positive_doc_id"), pairs("negative_doc_id"))


# ---------------------------------------------------------------- prediction, live, review


def predict_distribution(model, incidents: DataFrame, present: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Classes with probabilities (softmax of a fitted model's scores), the best with its confidence, and expected points."""
    from pyspark.ml.functions import vector_to_array

    from lodestone.functions.numbers import softmax

    scored = model.transform(incidents).withColumn("_p", softmax(vector_to_array("rawPrediction")))
    out = scored.withColumn("distribution", features.expand_labels(F.col("_p"), present))
    best, confidence = features.best_class(F.col("distribution"))
    expected = expected_value(F.col("distribution"), F.array(*[F.lit(float(p)) for p in points]))
    return out.select(*incidents.columns, "distribution", best.alias("predicted"), confidence.alias("confidence"), F.round(expected, 4).alias("expected_points"))


def explain(distribution: Column, predicted: Column, precedents: Column) -> Column:
    """A sentence for a prediction, by template: no language model is called."""
    return F.format_string("Predicted %s; probabilities %s; precedents: %s", predicted, F.array_join(F.transform(distribution, lambda p: F.format_number(p, 2)), ", "), F.array_join(precedents, ", "))


def live_alerts(stream: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Messages of a stream that are about incidents, joined to static cards."""
    return live.alerts(stream, live.incident_message(F.col("category"), F.col("flag"), F.col("message")), cards, key)


def lenient_precedents(incidents: DataFrame, current: dict[str, str], same: Sequence[str], k: int = 5) -> DataFrame:
    """Incidents like the current one with a lower penalty, newest first."""
    ladder = {code: int(10 * v) for code, v in stats.LADDER.items()}
    return retrieval.more_lenient(incidents, current, "penalty", ladder, same, [F.desc("season"), F.col("incident_id")], k)


def rolling_percentiles(requests: DataFrame, keep: int = 1000) -> DataFrame:
    """Percentiles of the newest requests of every path."""
    return stats.rolling_percentiles(requests, "path", [F.desc("ts"), F.desc("request_id")], "ms", keep)


def link_messages(incidents: DataFrame, messages: DataFrame) -> DataFrame:
    return temporal.link_messages(incidents, messages)


def register_functions(spark) -> list[str]:
    """SQL functions for what Column expressions cannot be called by name for: returns their names.

    They are SQL UDFs: their bodies are expressions that the optimizer inlines, not Python.
    """
    bodies = {
        "lodestone_tokens(t STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(lower(coalesce(t, '')), '([a-z0-9]+)', 1)",
        "lodestone_slug(t STRING) RETURNS STRING": "left(regexp_replace(regexp_replace(t, '[^A-Za-z0-9 _-]', '_'), '\\\\s+', '_'), 80)",
        "lodestone_risk(points DOUBLE) RETURNS STRING": "CASE WHEN points >= 10 THEN 'high' WHEN points >= 7 THEN 'medium' WHEN points >= 4 THEN 'low' ELSE 'none' END",
        "lodestone_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
