"""Listings, predicates, deduplication, sinks and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import natural_key
from lodestone.operators import relational as rel
from lodestone.plans.registry import query
from lodestone.sources import load


@query("list_filtered_page", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders
WHERE lower(o_orderstatus) = 'o' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100
""")  # fmt: skip
def list_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rel.where_given(load(spark, sf_dir, "orders"), o_orderstatus="o", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None)
    return rel.page(o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 100)


@query("semi_exists", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(returned, "o_orderkey", "left_semi")


@query("anti_missing", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name").join(buyers, "c_custkey", "left_anti")


@query("tri_state_filter", """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.quality = 1) IS NOT FALSE AND (d.lang = 'en' OR l.toxic IS NOT NULL)
""")  # fmt: skip
def tri_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(rel.not_false(F.col("quality") == 1) & ((F.col("lang") == "en") | F.col("toxic").isNotNull())).select("doc_id", "lang", "quality")


@query("json_contains", """
SELECT event_id, (props->>'$.k')::INTEGER AS k, event_type FROM events WHERE (props->>'$.k')::INTEGER BETWEEN 10 AND 20 AND event_type ILIKE '%UR%'
""")  # fmt: skip
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return e.where(F.col("k").between(10, 20) & F.col("event_type").ilike("%UR%")).select("event_id", "k", "event_type")


@query("array_members", """
WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS seen FROM orders GROUP BY 1)
SELECT o_custkey, len(seen)::INTEGER AS n_seen, array_to_string(seen, '|') AS seen FROM g WHERE list_contains(seen, '1-URGENT') AND NOT list_contains(seen, '5-LOW')
""")  # fmt: skip
def array_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("seen"))
    g = g.where(F.array_contains("seen", "1-URGENT") & ~F.array_contains("seen", "5-LOW"))
    return g.select("o_custkey", F.size("seen").alias("n_seen"), F.array_join("seen", "|").alias("seen"))


@query("regex_predicate", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3][0-9]?$')")
def regex_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(F.col("p_brand").rlike("^Brand#[1-3][0-9]?$")).select("p_partkey", "p_brand")


@query("latest_first_match", """
SELECT user_id, event_type, ts::DATE AS day, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) = 1
""")  # fmt: skip
def latest_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "ts", "event_id", "value")
    return rel.first_per_key(e, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("insert_ignore", """
WITH e AS (SELECT event_id, user_id, ts::DATE AS day, event_type FROM events),
stored AS (SELECT * FROM e WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) = 1),
new AS (SELECT * FROM e WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) = 1)
SELECT * FROM stored UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = n.user_id AND s.day = n.day)
""")  # fmt: skip
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    key, order = ["user_id", "day"], [F.col("event_id")]
    stored = rel.first_per_key(e.where("event_type = 'view'"), key, order)
    return rel.insert_ignore(stored, e.where("event_type <> 'view'"), key, order)


@query("upsert_latest", """
WITH u AS (SELECT user_id, ts::DATE AS day, event_id AS version, value, (event_type = 'purchase')::INTEGER AS is_new FROM events)
SELECT user_id, day, version, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY version DESC, is_new DESC) = 1
""")  # fmt: skip
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("version"), "value", "event_type")
    stored, new = (e.where(c).drop("event_type") for c in ("event_type <> 'purchase'", "event_type = 'purchase'"))
    return rel.upsert(stored, new, ["user_id", "day"], "version")


@query("keyed_update", """
WITH v AS (SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_acctbal < 0)
SELECT s.s_suppkey, s.s_name, coalesce(v.s_acctbal, s.s_acctbal) AS s_acctbal FROM supplier s LEFT JOIN v USING (s_suppkey)
""")  # fmt: skip
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return rel.keyed_update(s, s.where("s_acctbal < 0").select("s_suppkey", (F.col("s_acctbal") * 2).alias("s_acctbal")), "s_suppkey", ["s_acctbal"])


@query("replace_keys", """
SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 2) UNION ALL SELECT n_regionkey, n_nationkey + 100, upper(n_name) FROM nation WHERE n_regionkey IN (1, 2)
""")  # fmt: skip
def replace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    new = n.where("n_regionkey IN (1, 2)").select("n_regionkey", (F.col("n_nationkey") + 100).alias("n_nationkey"), F.upper("n_name").alias("n_name"))
    return rel.replace_keys(n, new, "n_regionkey")


@query("newest_keys", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 DESC LIMIT 20)
""")  # fmt: skip
def newest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.newest_keys(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 20)


@query("ordered_fetch", """
WITH w AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer QUALIFY rank <= 25)
SELECT w.c_custkey, w.rank, c.c_name, n.n_name FROM w JOIN customer c USING (c_custkey) JOIN nation n ON n_nationkey = c_nationkey
""")  # fmt: skip
def ordered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    top = c.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
    rank = F.row_number().over(rel.Window.orderBy(F.desc("c_acctbal"), "c_custkey"))
    wanted = top.withColumn("rank", rank)
    out = rel.ordered_fetch(c.select("c_custkey", "c_name", "c_nationkey"), wanted, "c_custkey")
    return out.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "rank", "c_name", "n_name")


@query("name_resolution", """
WITH q AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN upper(left(n_name, 3)) WHEN 1 THEN lower(n_name) ELSE '?' END AS asked FROM supplier JOIN nation ON n_nationkey = s_nationkey),
codes AS (SELECT upper(left(n_name, 3)) AS code, min(n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(*) = 1)
SELECT s_suppkey, asked, coalesce(c.id, n.n_nationkey, k.n_nationkey) AS id FROM q LEFT JOIN codes c ON c.code = asked LEFT JOIN nation n ON lower(n.n_name) = asked LEFT JOIN nation k ON k.n_nationkey = q.s_nationkey
""")  # fmt: skip
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    asked = F.when(F.col("s_suppkey") % 3 == 0, F.upper(F.left("n_name", F.lit(3)))).when(F.col("s_suppkey") % 3 == 1, F.lower("n_name")).otherwise("?")
    q = load(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", asked.alias("asked"))
    codes = n.groupBy(F.upper(F.left("n_name", F.lit(3))).alias("code")).agg(F.min("n_nationkey").alias("id"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    names = n.select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    numbers = n.select(F.col("n_nationkey").alias("number"), F.col("n_nationkey").alias("id"))
    return rel.resolve(q, [(F.col("asked"), codes, "code"), (F.col("asked"), names, "name"), (F.col("s_nationkey"), numbers, "number")], "id").select("s_suppkey", "asked", "id")


@query("enrich_multi", """
WITH l AS (SELECT l_orderkey, max(l_extendedprice) AS top_price, bool_or(l_returnflag = 'R') AS any_returned, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, first(l_linestatus ORDER BY n DESC, l_linestatus) AS modal_status FROM (SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT o_orderkey, top_price, any_returned, modal_status, round(coalesce(d, 0.0), 6) AS avg_discount, coalesce(n, 0) AS n_lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey
""")  # fmt: skip
def enrich_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    agg = lines.groupBy("l_orderkey").agg(
        F.max("l_extendedprice").alias("top_price"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
        F.expr("mode() WITHIN GROUP (ORDER BY l_linestatus)").alias("modal_status"), F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("n"),
    )
    out = load(spark, sf_dir, "orders").select("o_orderkey").join(agg, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "top_price", "any_returned", "modal_status", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("avg_discount"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines"))


@query("earliest_linked", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)) AS happened FROM orders
""")  # fmt: skip
def earliest_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    o = load(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.col("first")).alias("happened"))


@query("carry_forward", """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text END AS heading FROM conversations)
SELECT conv_id, turn, role, last_value(heading IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM c
""")  # fmt: skip
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("text")).alias("heading"))
    return rel.carry_forward(c, "heading", ["conv_id"], ["turn"])


@query("capped_per_group", """
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('26:' || doc_id), doc_id) <= 12
""")  # fmt: skip
def capped_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    return rel.capped(d, ["source"], [rel.seeded_order(F.col("doc_id"), 26), F.col("doc_id")], 12)


@query("fold_dimension", """
WITH f AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS season, max(o_orderkey) AS number, bool_or(o_orderstatus = 'O') AS active FROM orders GROUP BY ALL)
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(season))), ',') AS seasons, max_by(number, season) AS number, bool_or(active) AS active,
    string_agg(season || ':' || number, ',' ORDER BY season) AS numbers FROM f GROUP BY 1
""")  # fmt: skip
def fold_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.max("o_orderkey").alias("number"), F.bool_or(F.col("o_orderstatus") == "O").alias("active"))
    numbers = F.transform(F.map_entries("numbers"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return rel.fold_dimension(o, "o_custkey", "season", "number", "active").withColumn("seasons", F.array_join("seasons", ",")).withColumn("numbers", F.array_join(numbers, ","))


@query("array_set_algebra", """
WITH p AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (year(o_orderdate) <= 1997))) AS a, list_sort(list_distinct(list(o_orderpriority) FILTER (year(o_orderdate) > 1997))) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), '|') AS gained, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), '|') AS lost FROM p
""")  # fmt: skip
def array_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.year("o_orderdate") <= 1997
    p = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(early, F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(~early, F.col("o_orderpriority"))).alias("b"))
    return p.select("o_custkey", F.array_join(F.array_sort(F.array_except("b", "a")), "|").alias("gained"), F.array_join(F.array_sort(F.array_except("a", "b")), "|").alias("lost"))


@query("merge_label_sources", """
WITH u AS (SELECT doc_id, quality AS label, 'hand' AS origin, 0 AS prio FROM labels UNION ALL SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END, 'rule', 1 FROM documents)
SELECT doc_id, label, origin FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY prio) = 1
""")  # fmt: skip
def merge_label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    hand = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.lit("hand").alias("origin"), F.lit(0).alias("prio"))
    rule = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("label"), F.lit("rule").alias("origin"), F.lit(1).alias("prio"))
    return rel.first_per_key(hand.unionByName(rule), ["doc_id"], [F.col("prio")]).drop("prio")


@query("keys_still_to_do", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keys_still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").distinct().join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("linked_or_recent", """
SELECT DISTINCT p_partkey FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS seen_at FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
WHERE seen_at IS NULL OR seen_at > TIMESTAMP '2001-06-01' ORDER BY 1 LIMIT 2000
""")  # fmt: skip
def linked_or_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("at"))
    p = load(spark, sf_dir, "part").select("p_partkey").join(last, F.col("p_partkey") == F.col("l_partkey"), "left")
    recent = F.col("at") > F.lit("2001-06-01").cast("timestamp_ntz")
    return p.where(F.col("at").isNull() | recent).select("p_partkey").distinct().orderBy("p_partkey").limit(2000)


@query("natural_sort", r"""
SELECT p_partkey, p_brand, array_to_string(list_transform(regexp_extract_all(p_brand, '(\d+)', 1), lambda x: lpad(x, 6, '0')), '.') AS sort_key FROM part ORDER BY sort_key, p_partkey
""")  # fmt: skip
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside names ordered as numbers."""
    parts = F.transform(natural_key(F.col("p_brand")), lambda x: F.lpad(x.cast("string"), 6, "0"))
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array_join(parts, ".").alias("sort_key")).orderBy("sort_key", "p_partkey")
