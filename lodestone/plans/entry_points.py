"""The named entry points over tables that stand for documents and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import api
from lodestone.plans.registry import query
from lodestone.plans.search import knn_edges
from lodestone.sources import load
from lodestone.sources.tables import keep
from lodestone.streaming.run import event_stream, run_to_end

#: Orders stand for incidents, documents for decisions.
_INCIDENTS = """
i AS (SELECT o_orderkey AS incident_id, o_orderkey AS doc_id, year(o_orderdate)::INTEGER AS season, o_orderpriority AS category, (['NFA', 'REP', '5s', '10s', 'DT'])[o_orderkey % 5 + 1] AS penalty,
    o_orderkey % 5 AS points, 'P' || (o_custkey % 7) AS panel, o_custkey % 40 AS driver FROM orders)
"""


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        k.alias("incident_id"), k.alias("doc_id"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("category"),
        F.get(F.array(*[F.lit(c) for c in ("NFA", "REP", "5s", "10s", "DT")]), (k % 5).cast("int")).alias("penalty"), (k % 5).alias("points"),
        F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string")).alias("panel"), F.array(F.struct((F.col("o_custkey") % 40).cast("string").alias("code"))).alias("drivers"),
        F.array((k % 9).cast("string")).alias("article_cited"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("raw_text"), F.substring_index("text", "\n", 1).alias("title"), (F.col("doc_id") % 4 + 2020).cast("int").alias("season"), (F.col("doc_id") % 90).alias("published_at"))


@query("api_list_documents", """
SELECT doc_id, (doc_id % 4 + 2020)::INTEGER AS season, doc_id % 90 AS published_at FROM documents WHERE doc_id % 4 = 1 AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the')
ORDER BY published_at DESC, doc_id LIMIT 20 OFFSET 5
""")  # fmt: skip
def api_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.list_documents(_documents(spark, sf_dir), season=2021, q="The", limit=20, offset=5).select("doc_id", "season", "published_at")


@query("api_list_incidents", f"WITH {_INCIDENTS} SELECT incident_id, season, penalty FROM i WHERE penalty = 'REP' AND driver = 7 ORDER BY season DESC, incident_id LIMIT 10")
def api_list_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.list_incidents(_incidents(spark, sf_dir), driver="7", penalty="rep", category=None, limit=10).select("incident_id", "season", "penalty")


@query("api_incident_detail", """
SELECT o_orderkey AS incident_id, substr(d.text, 1, 40) AS head, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS messages FROM orders LEFT JOIN documents d ON d.doc_id = o_orderkey WHERE o_orderkey = 5
""")  # fmt: skip
def api_incident_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"), F.col("l_shipdate").alias("message_time"), F.col("l_returnflag").alias("message"))
    one = api.incident_detail(_incidents(spark, sf_dir), _documents(spark, sf_dir), lines.drop("incident_id"), lines.select("incident_id", "message_id"), 5)
    return one.select("incident_id", F.substring("raw_text", 1, 40).alias("head"), F.size("messages").cast("bigint").alias("messages"))


@query("api_entity_cockpit", f"""
WITH {_INCIDENTS}, m AS (SELECT *, max(season) OVER () AS latest FROM i WHERE driver = 3), h AS (SELECT string_agg(penalty || '=' || n, ',' ORDER BY penalty) AS histogram FROM (SELECT penalty, count(*) AS n FROM m GROUP BY 1)),
s AS (SELECT count(*) AS rulings, sum(points)::BIGINT AS points, sum(points) FILTER (season = latest)::BIGINT AS recent_points, max(latest) AS latest FROM m)
SELECT '3' AS entity, rulings, points, recent_points, latest, CASE WHEN recent_points >= 10 THEN 'high' WHEN recent_points >= 7 THEN 'medium' WHEN recent_points >= 4 THEN 'low' ELSE 'none' END AS risk, round(least(recent_points / 12.0::DOUBLE, 1.0::DOUBLE), 4) AS ban_score, histogram FROM s, h WHERE rulings > 0
""")  # fmt: skip
def api_entity_cockpit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.entity_cockpit(_incidents(spark, sf_dir), "3")
    return out.withColumn("histogram", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("api_lenient_precedents", f"WITH {_INCIDENTS} SELECT incident_id, season, penalty FROM i WHERE category = '1-URGENT' AND penalty IN ('NFA', 'REP') ORDER BY season DESC, incident_id LIMIT 5")
def api_lenient_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = {"category": "1-URGENT", "penalty": "DT"}
    return api.lenient_precedents(_incidents(spark, sf_dir), current, ["category"]).select("incident_id", "season", "penalty")


@query("api_linked_documents", f"WITH {_INCIDENTS} SELECT incident_id, season FROM i WHERE incident_id % 9 = 4")
def api_linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    guidelines = spark.createDataFrame([(str(n), f"G{n}") for n in range(9)], "article_number string, article_id string")
    return api.linked_documents(guidelines, _incidents(spark, sf_dir), "G4").select("incident_id", "season")


@query("api_list_guidelines", """
SELECT '12.' || p_partkey AS article_number, 'G' || p_partkey AS article_id FROM part WHERE p_partkey % 2 = 0 ORDER BY p_partkey LIMIT 15 OFFSET 3
""")  # fmt: skip
def api_list_guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("12."), F.col("p_partkey").cast("string")).alias("article_number"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("article_id"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("document_name"))
    return api.list_guidelines(p, "a", 15, 3).select("article_number", "article_id")


@query("api_consistency", f"""
WITH {_INCIDENTS} SELECT category, season, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (penalty = 'NFA') / count(*), 1) AS free, round(100.0::DOUBLE * count(*) FILTER (penalty = 'DT') / count(*), 1) AS through FROM i GROUP BY ALL
""")  # fmt: skip
def api_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.consistency_heatmap(_incidents(spark, sf_dir), {"NFA": "free", "DT": "through"})


@query("api_slice_window", "SELECT l_suppkey AS driver, l_orderkey AS lap, l_linenumber FROM lineitem WHERE l_suppkey = 3 AND l_orderkey BETWEEN 1 AND 40")
def api_slice_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("driver"), F.col("l_orderkey").alias("lap"), "l_linenumber")
    return api.slice_window(laps, 3, 20, 20)


@query("api_annotations", """
SELECT 'U' || (user_id % 6) AS annotator, count(*) AS n, count(DISTINCT event_type) AS documents FROM events GROUP BY 1
""")  # fmt: skip
def api_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.annotation_stats(load(spark, sf_dir, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 6).cast("string")).alias("annotator"), F.col("event_type").alias("doc_id")))


@query("sql_functions", """
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INTEGER AS n, left(regexp_replace(regexp_replace(left(text, 100), '[^A-Za-z0-9 _-]', '_', 'g'), '\\s+', '_', 'g'), 80) AS slug, CASE WHEN doc_id % 12 >= 10 THEN 'high' WHEN doc_id % 12 >= 7 THEN 'medium' WHEN doc_id % 12 >= 4 THEN 'low' ELSE 'none' END AS risk FROM documents
""")  # fmt: skip
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions registered for SQL users: inlined expressions, no Python."""
    api.register_functions(spark)
    load(spark, sf_dir, "documents").createOrReplaceTempView("lodestone_documents")
    return spark.sql("SELECT doc_id, size(lodestone_tokens(text)) AS n, lodestone_slug(left(text, 100)) AS slug, lodestone_risk(doc_id % 12) AS risk FROM lodestone_documents")


@query("api_get_document", "SELECT doc_id, (doc_id % 4 + 2020)::INTEGER AS season, length(text)::INTEGER AS chars FROM documents WHERE doc_id = 7")
def api_get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.get_document(_documents(spark, sf_dir), "7").select("doc_id", "season", F.length("raw_text").alias("chars"))


#: BM25 of one query over texts whose first lines count again, twice.
_ONE_QUERY = """
q AS (SELECT DISTINCT unnest(['the', 'with', 'than', 'erst', 'zzz']) AS term),
t AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+') AS h, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
l AS (SELECT doc_id, {weight} * len(h)::DOUBLE + len(w) AS dl FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT doc_id, term, sum(weight) AS tf FROM (SELECT doc_id, unnest(h) AS term, {weight}::DOUBLE AS weight FROM t UNION ALL SELECT doc_id, unnest(w), 1.0::DOUBLE FROM t) WHERE weight > 0 AND term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, ln((s.n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM p, s GROUP BY term, s.n),
b AS (SELECT doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 4) AS score FROM p JOIN i USING (term) JOIN l USING (doc_id), s GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b WHERE score > 0)
"""


@query("api_bm25_search", f"WITH {_ONE_QUERY.format(weight=2)} SELECT doc_id, score, rank, title FROM r JOIN t USING (doc_id) WHERE rank <= 20")
def api_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.bm25_search(_documents(spark, sf_dir), "The with than; erst zzz").select("doc_id", "score", "rank", "title")


@query("api_hybrid_search", f"""
WITH {_ONE_QUERY.format(weight=0)}, v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT b.doc_id, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS score FROM v a JOIN v b ON a.doc_id = 3),
vr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c),
u AS (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM r WHERE rank <= 100 UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank) FROM vr WHERE rank <= 100),
f AS (SELECT doc_id, round(sum(part), 6) AS rrf_score FROM u GROUP BY 1), z AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, doc_id)::INTEGER AS rank FROM f)
SELECT doc_id, rrf_score, rank, title FROM z JOIN t USING (doc_id) WHERE rank <= 20
""")  # fmt: skip
def api_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text and its vector: that of vector 3, as vectors and documents share ids here."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = v.where("doc_id = 3").first().vector
    return api.hybrid_search(_documents(spark, sf_dir), "The with than; erst zzz", v, asked)


@query("api_neighbours", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS score FROM v a JOIN v b ON a.vec_id = 4 AND b.vec_id <> 4),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, dst)::INTEGER AS rank FROM c) SELECT dst, score, rank, lang, source FROM r JOIN documents ON doc_id = dst WHERE rank <= 3
""")  # fmt: skip
def api_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored edges of one item, joined to cards."""
    edges = keep(knn_edges(spark, sf_dir), "edges")
    cards = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("dst"), "lang", "source")
    return api.neighbours(edges, cards, 4, 3).select("dst", "score", "rank", "lang", "source")


_SEVERE = "CASE penalty WHEN 'NFA' THEN 0.0 WHEN 'REP' THEN 2.0 WHEN '5s' THEN 4.0 WHEN '10s' THEN 5.0 ELSE 6.0 END::DOUBLE"


@query("api_category_variance", f"""
WITH {_INCIDENTS}, c AS (SELECT category, penalty, {_SEVERE} AS w, count(*) AS n FROM i GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY category) AS p FROM c),
g AS (SELECT category, sum(n)::BIGINT AS total, count(*) AS outcomes, round(-sum(p * log2(p)), 3) + 0.0 AS entropy, first(penalty ORDER BY n DESC, penalty) AS modal, round(sum(w * n) / sum(n), 2) AS mean_severity FROM t GROUP BY category)
SELECT category, total, outcomes, modal, mean_severity, entropy, CASE WHEN outcomes > 1 THEN round(entropy / log2(outcomes), 3) ELSE 0.0 END AS inconsistency FROM g
""")  # fmt: skip
def api_category_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.category_variance(_incidents(spark, sf_dir))


@query("api_category_trend", f"""
WITH {_INCIDENTS}, y AS (SELECT category, season, avg({_SEVERE}) AS v FROM i WHERE season >= (SELECT max(season) - 4 FROM i) GROUP BY ALL),
s AS (SELECT category, count(*) AS seasons, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(coalesce(regr_slope(v, season), 0.0), 4) + 0.0 END AS slope FROM y GROUP BY 1)
SELECT category, seasons, CASE WHEN slope = 0 THEN 0.0 ELSE slope END AS slope, CASE WHEN slope > 0.05 THEN 'stricter' WHEN slope < -0.05 THEN 'lenient' ELSE 'consistent' END AS trend FROM s
""")  # fmt: skip
def api_category_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.category_trend(_incidents(spark, sf_dir))


@query("api_panel_chi_squared", f"""
WITH {_INCIDENTS}, c AS (SELECT panel, penalty, count(*) AS n FROM i GROUP BY ALL), s AS (SELECT penalty, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY 1), g AS (SELECT panel, sum(n)::BIGINT AS n FROM c GROUP BY 1)
SELECT g.panel, any_value(g.n) AS n, CASE WHEN any_value(g.n) < 5 THEN 0.0 ELSE round(sum(power(c.n - g.n * share, 2) / (g.n * share)), 3) END AS chi2, (SELECT greatest(count(*) - 1, 1) FROM s)::BIGINT AS df
FROM g JOIN c ON g.panel = c.panel JOIN s ON s.penalty = c.penalty GROUP BY 1
""")  # fmt: skip
def api_panel_chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.panel_chi_squared(_incidents(spark, sf_dir)).select("panel", "n", "chi2", "df")


@query("api_compare", """
WITH w AS (SELECT unnest([1, 2, 99999]) AS driver) SELECT driver, count(l_orderkey) AS samples, round(coalesce(sum(l_quantity), 0), 2)::DOUBLE AS total FROM w LEFT JOIN lineitem ON l_suppkey = driver AND l_linenumber = 2 GROUP BY 1
""")  # fmt: skip
def api_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("driver"), F.col("l_linenumber").alias("lap"), F.col("l_orderkey").alias("ts"), F.col("l_quantity").cast("double").alias("speed"))
    out = api.compare(t, [1, 2, 99999], 2, ["speed"])
    total = F.aggregate(F.transform("samples", lambda s: s["speed"]), F.lit(0.0), lambda a, x: a + x)
    return out.select("driver", F.when(F.col("samples").isNull(), F.lit(0)).otherwise(F.size("samples")).cast("bigint").alias("samples"), F.round(F.coalesce(total, F.lit(0.0)), 2).alias("total"))


@query("api_export_triplets", """
WITH a AS (SELECT user_id AS doc_id, event_id AS other, event_type FROM events),
p AS (SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY other) - 1 AS i FROM (SELECT DISTINCT doc_id, other FROM a WHERE event_type = 'purchase')),
n AS (SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY other) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS c FROM (SELECT DISTINCT doc_id, other FROM a WHERE event_type = 'error'))
SELECT p.doc_id AS anchor, p.other AS positive, n.other AS negative FROM p JOIN n ON n.doc_id = p.doc_id AND n.j = p.i % n.c
""")  # fmt: skip
def api_export_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations: purchases of a session are similar to it, errors are not."""
    e = load(spark, sf_dir, "events")
    named = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id"))
    return api.export_triplets(e.select(F.col("user_id").alias("doc_id"), named("purchase").alias("positive_doc_id"), named("error").alias("negative_doc_id")))


@query("api_predict", """
WITH s AS (SELECT o_orderkey, [(o_orderkey % 7)::DOUBLE, (o_orderkey % 5)::DOUBLE, (o_orderkey % 3)::DOUBLE] AS v FROM orders), e AS (SELECT o_orderkey, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM s),
p AS (SELECT o_orderkey, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT o_orderkey, (['NFA', '5s', 'DSQ'])[list_position(p, list_max(p))] AS predicted, round(list_max(p), 4) AS confidence, round(p[2] * 2.0::DOUBLE + p[3] * 12.0::DOUBLE, 4) AS expected_points,
    'Predicted ' || (['NFA', '5s', 'DSQ'])[list_position(p, list_max(p))] || '; classes 7; precedents: R1, R2' AS explained FROM p
""")  # fmt: skip
def api_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's scores of three present classes to a distribution over seven, expected points and a sentence."""
    from pyspark.ml.feature import VectorAssembler

    k = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders").select("o_orderkey", *[(k % m).cast("double").alias(f"s{m}") for m in (7, 5, 3)])
    out = api.predict_distribution(VectorAssembler(inputCols=["s7", "s5", "s3"], outputCol="rawPrediction"), o, ["NFA", "5s", "DSQ"], [0, 0, 2, 3, 3, 3, 12])
    told = api.explain(F.col("distribution"), F.col("predicted"), F.array(F.lit("R1"), F.lit("R2")))
    # the numbers between the marks are the seven probabilities; their sum is one whatever their last digits
    counted = F.concat(F.substring_index(told, ";", 1), F.lit("; classes "), F.size(F.split(F.regexp_extract(told, "probabilities ([^;]*);", 1), ", ")).cast("string"), F.lit("; "), F.element_at(F.split(told, "; "), -1))
    return out.select("o_orderkey", "predicted", "confidence", "expected_points", counted.alias("explained"))


@query("api_live_alerts", "SELECT event_id, user_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 6 IN (0, 1, 3)")
def api_live_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a stream that are about incidents, with the cards of their sessions."""
    k = F.col("event_id") % 6
    stream = event_stream(spark, sf_dir).select("event_id", "user_id", F.when(k == 0, "flag").when(k == 1, "Incident").when(k == 2, "Flag").alias("category"), F.when(k == 0, "BLACK").when(k == 2, "yellow").alias("flag"), F.when(k == 3, "Car 4 noted - alleged breach").otherwise(F.lit(None)).alias("message"))
    cards = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return run_to_end(api.live_alerts(stream, cards, "user_id").select("event_id", "user_id", "c_name"), name="live-alerts")


@query("api_rolling_percentiles", """
WITH k AS (SELECT event_type AS path, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500),
a AS (SELECT path, count(*) AS n, list_sort(list(value)) AS v FROM k GROUP BY 1 HAVING count(*) >= 10)
SELECT path, n, v[greatest(floor(n * 50 / 100)::BIGINT - 1, 0) + 1] AS p50, v[greatest(floor(n * 95 / 100)::BIGINT - 1, 0) + 1] AS p95, v[greatest(floor(n * 99 / 100)::BIGINT - 1, 0) + 1] AS p99 FROM a
""")  # fmt: skip
def api_rolling_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "events").select(F.col("event_type").alias("path"), "ts", F.col("event_id").alias("request_id"), F.col("value").alias("ms"))
    return api.rolling_percentiles(requests, 500).select("path", "n", "p50", "p95", "p99")


@query("api_link_messages", """
WITH o AS (SELECT event_id AS incident_id, user_id % 10 AS session, user_id % 19 + 2 AS car, ts AS t FROM events WHERE event_type = 'signup'), m AS (SELECT event_id AS message_id, user_id % 10 AS session, user_id % 19 + 2 AS car, ts AS t FROM events WHERE event_type = 'view')
SELECT incident_id, message_id FROM o JOIN m ON o.session = m.session AND o.car = m.car AND m.t >= o.t - INTERVAL 2 MINUTES AND m.t <= o.t + INTERVAL 15 MINUTES
""")  # fmt: skip
def api_link_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that name an incident's car within its window, over all events."""
    e = load(spark, sf_dir, "events").withColumns({"session_key": (F.col("user_id") % 10).cast("string"), "car": (F.col("user_id") % 19 + 2).cast("int"), "at": F.col("ts").cast("timestamp")})
    incidents = e.where("event_type = 'signup'").select("session_key", F.col("event_id").alias("incident_id"), F.array("car").alias("cars"), F.col("at").alias("incident_time"), F.lit(None).cast("string").alias("corner"), F.lit("other").alias("category"))
    told = F.concat(F.lit("CAR "), F.col("car").cast("string"), F.lit(" UNDER INVESTIGATION"))
    messages = e.where("event_type = 'view'").select("session_key", F.col("event_id").alias("message_id"), told.alias("message"), F.col("at").alias("message_time"), F.lit(None).cast("int").alias("number"))
    return api.link_messages(incidents, messages).select("incident_id", "message_id")
