"""Files written and read back, links of pages, comparisons, and small relational and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import numbers as num
from lodestone.functions import text as tx
from lodestone.operators import relational as rel
from lodestone.operators import rulings, temporal
from lodestone.plans.registry import query
from lodestone.sources import jsonl, load
from lodestone.sources.tables import scratch

CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType()), T.StructField("season", T.IntegerType())])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 4 + 2020).cast("int").alias("season"))


@query("jsonl_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT -1, 'bad lines', 2.0")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written line by line, two lines that do not parse among them, and read back: good rows, and the number of bad lines."""
    at = scratch(spark, "lines")
    jsonl.append_jsonl(_customers(spark, sf_dir), at)
    spark.createDataFrame([('{"c_custkey": 1, "c_name": ',), ("not json",), ("",)], "value string").coalesce(1).write.mode("append").text(at)
    good = jsonl.read_jsonl(spark, at, CUSTOMER).select("c_custkey", "c_name", "c_acctbal")
    bad = jsonl.corrupt_lines(spark, at, CUSTOMER).agg(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit("bad lines").alias("c_name"), F.count(F.lit(1)).cast("double").alias("c_acctbal"))
    return good.unionByName(bad)


@query("jsonl_seasons", "SELECT c_custkey, c_name, (c_custkey % 4 + 2020)::INTEGER AS season FROM customer WHERE c_custkey % 4 IN (1, 3)")
def jsonl_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a folder a season: the filter reads two of four folders."""
    at = scratch(spark, "seasons")
    jsonl.write_seasons(_customers(spark, sf_dir), at)
    return jsonl.read_seasons(spark, at, CUSTOMER, [2021, 2023]).select("c_custkey", "c_name", "season")


@query("jsonl_rewrite", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 0.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0
""")  # fmt: skip
def jsonl_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete some keys, change others where a new value is given, append nothing twice."""
    stored = _customers(spark, sf_dir)
    left = jsonl.rewrite_without(stored, stored.where("c_custkey % 5 = 0"), "c_custkey")
    new = stored.where("c_custkey % 7 = 0").select("c_custkey", F.lit(0.5).alias("c_acctbal"), F.lit(None).cast("string").alias("c_name"))
    return jsonl.rewrite_matching(left, new, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("usable_documents", """
WITH d AS (SELECT doc_id, length(text) AS n, doc_id % 3 = 0 AS scanned FROM documents) SELECT doc_id FROM d WHERE n >= CASE WHEN scanned THEN 600 ELSE 280 END
""")  # fmt: skip
def usable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 3 == 0, True).alias("needs_ocr"))
    return jsonl.usable(d).select("doc_id")


_LISTING = (
    "<ul><li>published 01.0{m}.24 10:15 <a href='x'>no</a><a class=\"b\" href=\"/docs/{k}-decision%2.pdf\"><b>Decision</b>  -\n Car {k}</a></li>"
    "<li>02.03.24 11:00</li><li><a href=\"/docs/{k}-summons.PDF\">Summons {k} published 05.06.24 12:30</a></li>"
    "<li><a href=\"/docs/{k}.pdf\">Timing sheet</a></li><li><a href=\"/docs/{k}.html\">Decision</a></li></ul>"
    '<select><option value="0">none</option><option value="/s/202{m}-9"> Season 202{m} </option></select>'
)


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    html = F.replace(F.replace(F.lit(_LISTING), F.lit("{k}"), k.cast("string")), F.lit("{m}"), (k % 9 + 1).cast("string"))
    return load(spark, sf_dir, "supplier").select(k.alias("page_id"), html.alias("html"))


@query("document_links", """
SELECT s_suppkey AS page_id, '/docs/' || s_suppkey || '-decision%252.pdf' AS href, 'Decision - Car ' || s_suppkey AS title, '01.0' || (s_suppkey % 9 + 1) || '.24 10:15' AS published FROM supplier
UNION ALL SELECT s_suppkey, '/docs/' || s_suppkey || '-summons.PDF', 'Summons ' || s_suppkey || ' published 05.06.24 12:30', '05.06.24 12:30' FROM supplier
""")  # fmt: skip
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jsonl.document_links(_listings(spark, sf_dir))
    return out.select("page_id", tx.escape_percent(F.col("href")).alias("href"), "title", "published")


@query("season_options", "SELECT s_suppkey AS page_id, 'Season 202' || (s_suppkey % 9 + 1) AS name, 2021 + s_suppkey % 9 AS season FROM supplier")
def season_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jsonl.select_options(_listings(spark, sf_dir))
    return out.select("page_id", "name", jsonl.season_of_url(F.col("value")).cast("bigint").alias("season"))


# ---------------------------------------------------------------- comparisons and relations


@query("lap_compare", """
WITH w AS (SELECT * FROM (VALUES (1), (2), (-5)) t(user_id)), e AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'view')
SELECT w.user_id, count(event_id) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids, round(coalesce(sum(value), 0), 2) AS total FROM w LEFT JOIN e ON e.user_id = w.user_id GROUP BY 1
""")  # fmt: skip
def lap_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of three entities side by side, one of them unknown."""
    e = load(spark, sf_dir, "events")
    out = rel.compare_rows(e, "user_id", [1, 2, -5], ["ts", "event_id"], ["value"], F.col("event_type") == "view")
    ids = F.transform("samples", lambda s: s["event_id"].cast("string"))
    total = F.aggregate(F.transform("samples", lambda s: s["value"]), F.lit(0.0), lambda a, x: a + x)
    return out.select("user_id", F.coalesce(F.size("samples"), F.lit(0)).cast("bigint").alias("n"), F.when(F.size("samples") > 0, F.array_join(ids, ",")).alias("ids"), F.round(F.coalesce(total, F.lit(0.0)), 2).alias("total")).withColumn("n", F.greatest("n", F.lit(0)).cast("bigint"))


@query("plausible_years", "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1994 + o_orderkey % 4 AND 1995 + o_orderkey % 4 THEN o_orderdate END AS dated FROM orders")
def plausible_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", rel.plausible_year(F.col("o_orderdate"), F.col("o_orderkey") % 4 + 1994).alias("dated"))


@query("array_containment", """
SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(upper(l_returnflag || l_linestatus) = 'RF')
""")  # fmt: skip
def array_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose array of line objects has one with a given code."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.lower(F.concat("l_returnflag", "l_linestatus")).alias("code"))).alias("drivers"))
    return lines.where(rel.has_element(F.col("drivers"), "code", "rf")).select("l_orderkey")


@query("penalty_histograms", """
WITH c AS (SELECT o_custkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'NFA') AS code, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(code || '=' || n, ',' ORDER BY code) AS histogram FROM c GROUP BY 1
""")  # fmt: skip
def penalty_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("code", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    h = rel.penalty_histogram(o, ["o_custkey"], "code")
    return h.select("o_custkey", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("histogram"))


@query("bridge_join", """
SELECT DISTINCT o_orderkey, s_suppkey, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT'
""")  # fmt: skip
def bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    bridge = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    return rel.through_bridge(o, bridge, load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "o_orderkey", "s_suppkey")


@query("first_labels", """
WITH f AS (SELECT user_id, event_type AS label, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT f.user_id, label, coalesce(c_acctbal, value) AS value, c_mktsegment FROM f LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer) ON c_custkey = user_id
""")  # fmt: skip
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label of every key; context wins where it says something."""
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), "value", "ts", "event_id")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("value"), "c_mktsegment")
    return rel.first_with_context(e, c, "user_id", "label", ["ts", "event_id"]).select("user_id", "label", "value", "c_mktsegment")


@query("presence_labels", """
WITH p AS (SELECT conv_id, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, bool_or(role NOT IN ('user', 'assistant')) AS o FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN o THEN 'mixed' WHEN u AND a THEN 'both' WHEN u THEN 'driver' WHEN a THEN 'engineer' ELSE 'mixed' END AS label FROM p
""")  # fmt: skip
def presence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {frozenset(("user", "assistant")): "both", frozenset(("user",)): "driver", frozenset(("assistant",)): "engineer"}
    return rel.presence_label(load(spark, sf_dir, "conversations"), "conv_id", "role", names, "mixed")


@query("unordered_first_source", """
WITH p AS (SELECT event_id % 50 AS a, (event_id * 7) % 50 AS b, CASE WHEN event_id % 2 = 0 THEN 'hand' ELSE 'rule' END AS tag, event_id FROM events),
u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, tag, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY tag, event_id) AS nth FROM p WHERE a <> b)
SELECT a, b, tag FROM u WHERE nth = 1
""")  # fmt: skip
def unordered_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pairs from two sources: the first source wins for every unordered pair."""
    e = load(spark, sf_dir, "events")
    a, b = F.col("event_id") % 50, (F.col("event_id") * 7) % 50
    pairs = e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(F.col("event_id") % 2 == 0, "hand").otherwise("rule").alias("tag"), "event_id").where("a <> b")
    return rel.first_per_key(pairs, ["a", "b"], [F.col("tag"), F.col("event_id")]).select("a", "b", "tag")


@query("nulls_last_order", """
SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 > 0 THEN value END DESC NULLS LAST, event_id) AS place FROM events ORDER BY place LIMIT 100
""")  # fmt: skip
def nulls_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred by a value that may be missing, unknown ones last (a top-k report)."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    best = e.orderBy(F.desc_nulls_last("v"), "event_id").limit(100)
    return best.select("event_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("v"), "event_id")).cast("bigint").alias("place"))


@query("midpoint_overlap", """
WITH e AS (SELECT event_id, user_id, epoch(ts) AS s, epoch(ts) + 1800 AS t FROM events WHERE event_type = 'view'),
r AS (SELECT event_id AS other, user_id, epoch(ts) AS rs, epoch(ts) + 3600 AS rt FROM events WHERE event_type <> 'view'),
p AS (SELECT event_id, other, least((s + t) / 2 + 600, rt) - greatest((s + t) / 2 - 600, rs) AS overlap FROM e JOIN r USING (user_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, other) AS nth FROM p WHERE overlap > 0)
SELECT event_id, other FROM b WHERE nth = 1
""")  # fmt: skip
def midpoint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval that overlaps ten minutes on either side of the middle of another most."""
    e = load(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    left = e.where("event_type = 'view'").select("event_id", "user_id", "s", (F.col("s") + 1800).alias("t"))
    right = e.where("event_type <> 'view'").select(F.col("event_id").alias("other"), "user_id", F.col("s").alias("rs"), (F.col("s") + 3600).alias("rt"))
    return temporal.midpoint_overlap(left, right, ["user_id"], "event_id", ("s", "t", "rs", "rt"), 7200.0, [F.col("other")], 600.0).select("event_id", "other")


@query("ordered_lookups", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS kind, least(greatest(o_totalprice, 1000.0), 50000.0) AS clipped FROM orders")
def ordered_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rel.ordered_case({"closed": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 100000}, "small")
    return load(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), num.clip(F.col("o_totalprice"), 1000.0, 50000.0).alias("clipped"))


# ---------------------------------------------------------------- text functions


@query("text_normalisers", """
WITH k AS (SELECT p_partkey, (p_partkey % 6)::INTEGER AS m FROM part)
SELECT p_partkey, 'Car ' || p_partkey || ' - Decision' AS title, (['33.4', '12.2.1', 'Appendix L', NULL, '48.1', '2'])[m + 1] AS article,
    (['33.4', '12.2|12.3', 'Appendix L, Chapter IV|12.4.1e|B1.6.2b', '', '48.1|48.2(a)', ''])[m + 1] AS cited,
    (['2024-03-09', '2024-03-09', '2024-03-09', '2024-03-09', '2024-03-09', NULL])[m + 1]::DATE AS dated, CASE m WHEN 5 THEN NULL ELSE TIMESTAMP '2024-03-09 10:00:00' END AS instant FROM k
""")  # fmt: skip
def text_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, articles, citations and dates in the forms in which they are written."""
    k = F.col("p_partkey")
    deal = lambda *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values)).cast("int"))
    p = load(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("- Car "), k.cast("string"), F.lit(" - Decision Published on 3 March 2024")).alias("title"),
        deal("Article 33.4", "Art. 12.2.1", "Appendix L", "Article nothing", "Articles 48.1", " art 2 ").alias("article"),
        deal("Breach of Article 33.4 by Martin.", "Articles 12.2, 12.3 apply", "Appendix l Chapter IV, Article 12.4.1.e, APPENDIX L,  Chapter IV, Art 12.4.1e and Article B1.6.2b.", "Artin took part", "Art. 48.1 and 48.2 (a) of it", "nothing").alias("text"),
        deal("2024-03-09", "09/03/2024", "09.03.2024", "9 March 2024", "March 9, 2024", "soon").alias("date"),
        deal("2024-03-09T10:00:00Z", "2024-03-09T12:00:00+02:00", "2024-03-09T10:00:00", "2024-03-09T10:00:00.000Z", "2024-03-09 10:00:00", "never").alias("iso"),
    )
    return p.select(
        "p_partkey", tx.normalise_title(F.col("title")).alias("title"), tx.normalise_article(F.col("article")).alias("article"), F.array_join(tx.citations(F.col("text")), "|").alias("cited"),
        tx.any_date(F.col("date")).alias("dated"), tx.iso_timestamp(F.col("iso")).cast("timestamp_ntz").alias("instant"),
    )


@query("panel_boxes", "SELECT s_suppkey AS doc_id, name FROM supplier, (VALUES ('Ann Lee'), ('Bo de Ray')) v(name)")
def panel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a panel from words with coordinates: lines by baseline, cells by wide gaps, titles left out."""
    words = [("Ann", 0.0, 20.0, 10.0), ("Lee", 25.0, 40.0, 11.0), ("Bo", 200.0, 215.0, 10.5), ("de", 218.0, 230.0, 10.5), ("Ray", 235.0, 250.0, 10.0), ("Stewards", 0.0, 60.0, 30.0), ("signed", 0.0, 40.0, 50.0), ("today", 45.0, 60.0, 50.0)]
    boxes = F.array(*[F.struct(F.lit(w).alias("text"), F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.lit(c).alias("top")) for w, a, b, c in words])
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.inline(boxes))
    return rulings.panel_from_boxes(rows).select("doc_id", "name")


@query("linked_messages", """
SELECT s_suppkey AS incident_id, s_suppkey * 10 + m AS message_id FROM supplier, range(0, 9) t(m) WHERE m IN (0, 1, 6)
""")  # fmt: skip
def linked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident a session and nine messages around it, three of which are about it."""
    k = F.col("s_suppkey")
    car = (k % 19 + 2).cast("int")
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + k * 1_000_000_000)
    incidents = load(spark, sf_dir, "supplier").select(k.cast("string").alias("session_key"), k.alias("incident_id"), F.array(car).alias("cars"), at.alias("incident_time"), F.lit("4").alias("corner"), F.lit("collision").alias("category"))
    texts = (
        ("INCIDENT INVOLVING CARS {c} AND 1 (XXX) NOTED - CAUSING A COLLISION", 60), ("CAR {c} UNDER INVESTIGATION", 300), ("CAR {o} UNDER INVESTIGATION", 60), ("TURN 9 INCIDENT INVOLVING CAR {c} NOTED", 60),
        ("CAR {c} TIME 1:30.123 DELETED - TRACK LIMITS AT TURN 4 LAP 3", 60), ("CAR {c} UNDER INVESTIGATION", 1500), ("5 SECOND TIME PENALTY FOR CAR {c} - CAUSING A COLLISION AT TURN 4", 1500), ("CAR {c} UNDER INVESTIGATION", -600), ("GREEN LIGHT - PIT EXIT OPEN", 10),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(t).alias("t"), F.lit(d).alias("d")) for i, (t, d) in enumerate(texts)])
    messages = load(spark, sf_dir, "supplier").select("s_suppkey", car.alias("car"), at.alias("at"), F.inline(rows))
    message = F.replace(F.replace("t", F.lit("{c}"), F.col("car").cast("string")), F.lit("{o}"), (F.col("car") + 30).cast("string"))
    messages = messages.select(k.cast("string").alias("session_key"), (k * 10 + F.col("m")).alias("message_id"), message.alias("message"), F.timestamp_micros(F.unix_micros("at") + F.col("d") * 1_000_000).alias("message_time"), F.lit(None).cast("int").alias("number"))
    return temporal.link_messages(incidents, messages)


_FIRST = ("Nish", "Loïc", "Vitantonio", "Zheng", "Ann", "Bo", "Mazen", "Eve")
_LAST = ("Shetty", "Liuzzi", "O'Hara", "van der Berg", "Lee", "Al Hilli", "Pirro", "Dean-Fox", "de Ray")


@query("signed_panels", f"""
WITH n AS (SELECT s_suppkey AS k, s_suppkey % 6 + 2 AS m, s_suppkey % 2 + 2 AS c, unnest(range(0, (s_suppkey % 6 + 2)::BIGINT)) AS i FROM supplier),
t AS (SELECT k, m, c, i, ({list(_FIRST)!r})[(k + i) % 8 + 1] || ' ' || ({[x.replace("'", "''") for x in _LAST]})[(3 * k + i) % 9 + 1] AS name FROM n)
SELECT k AS doc_id, string_agg(name, '|' ORDER BY i % c, i // c) AS members, first(name ORDER BY i) AS chair FROM t WHERE m BETWEEN 3 AND 6 GROUP BY k
""".replace('"', "'"))  # fmt: skip
def signed_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two to seven names in two or three columns, one page a supplier, with names and paragraphs above and below."""
    from lodestone.operators import panels

    k = F.col("s_suppkey")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), (at % len(names)).cast("int"))
    n = load(spark, sf_dir, "supplier").select(k.alias("doc_id"), (k % 6 + 2).alias("m"), (k % 2 + 2).alias("c"))
    rows = F.ceil(F.col("m") / F.col("c"))
    names = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    i, c, d = F.col("i"), F.col("c"), F.col("doc_id")
    named = names.select("doc_id", (600 + 30 * F.expr("i div c") + (d + i) % 3).cast("double").alias("top"), (46 + 250 * (i % c)).cast("double").alias("x"), F.concat_ws(" ", pick(_FIRST, d + i), pick(_LAST, 3 * d + i)).alias("line"))
    fixed = F.array(*[F.struct(F.lit(t).alias("line"), top.cast("double").alias("top")) for t, top in (
        ("Jo Bauer", F.lit(520)), ("Competitors are reminded of their right to Appeal", F.lit(560)), ("The Stewards", 600 + 30 * rows), ("Ann Late", 640 + 30 * rows),
    )])
    other = n.select("doc_id", F.inline(fixed)).select("doc_id", "top", F.lit(46.0).alias("x"), "line")
    words = named.unionByName(other).withColumn("w", F.split("line", " ")).select("doc_id", "top", "x", "w", F.posexplode("w").alias("j", "text"))
    before = F.aggregate(F.slice("w", 1, F.col("j")), F.lit(0.0), lambda s, t: s + 7.5 * F.length(t) + 6.0)
    boxes = words.select("doc_id", "text", "top", (F.col("x") + before).alias("x0"), (F.col("x") + before + 7.5 * F.length("text")).alias("x1"))
    return panels.panels(boxes).select("doc_id", F.array_join("members", "|").alias("members"), "chair")
