"""Text: cleaning, rules, sections, citations, links, scores, names and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import relational as rel
from lodestone.operators import rulings
from lodestone.plans.registry import query
from lodestone.sources import load


@query("doc_profile", """
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT source) AS sources FROM documents WHERE n_chars >= 280 GROUP BY 1
""")  # fmt: skip
def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").where("n_chars >= 280")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.count_distinct("source").alias("sources"))


@query("field_coverage", """
WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT field, filled, round(filled / n, 4) AS share FROM (SELECT count(*) AS n, count(lang) AS lang, count(quality) AS quality, count(toxic) AS toxic FROM j) UNPIVOT (filled FOR field IN (lang, quality, toxic))
""")  # fmt: skip
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rel.coverage(j, ["lang", "quality", "toxic"])


RULES = (("license", "(?i)licensed? under|MIT License"), ("contact", r"[\w.]+@[\w.]+\.\w+"), ("phone", r"\+?\d[\d ()-]{7,}\d"), ("shout", "!!"), ("symbols", r"[$%&*#]{3}"), ("table", r" \| "))


@query("title_rule_classifier", r"""
WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title FROM documents)
SELECT doc_id, coalesce(
    CASE WHEN regexp_matches(title, '(?i)licensed? under|MIT License') THEN 'license' WHEN regexp_matches(title, '[\w.]+@[\w.]+\.\w+') THEN 'contact' WHEN regexp_matches(title, '\+?\d[\d ()-]{7,}\d') THEN 'phone' WHEN regexp_matches(title, '!!') THEN 'shout' WHEN regexp_matches(title, '[$%&*#]{3}') THEN 'symbols' WHEN regexp_matches(title, ' \| ') THEN 'table' END,
    CASE WHEN regexp_matches(text, '(?i)licensed? under|MIT License') THEN 'license' WHEN regexp_matches(text, '[\w.]+@[\w.]+\.\w+') THEN 'contact' WHEN regexp_matches(text, '\+?\d[\d ()-]{7,}\d') THEN 'phone' WHEN regexp_matches(text, '!!') THEN 'shout' WHEN regexp_matches(text, '[$%&*#]{3}') THEN 'symbols' WHEN regexp_matches(text, ' \| ') THEN 'table' END,
    'prose') AS kind FROM d
""")  # fmt: skip
def title_rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"))
    return d.select("doc_id", F.coalesce(tx.first_rule(F.col("title"), RULES), tx.first_rule(F.col("text"), RULES), F.lit("prose")).alias("kind"))


_SUBSTITUTE = "text"
for _old, _new in tx.SUBSTITUTES:
    _SUBSTITUTE = f"replace({_SUBSTITUTE}, '{_old.replace(chr(39), chr(39) * 2)}', '{_new.replace(chr(39), chr(39) * 2)}')"


@query("clean_text", rf"""
WITH a AS (SELECT doc_id, regexp_replace({_SUBSTITUTE}, '(\p{{L}})-\n(\p{{Ll}})', '\1\2', 'g') AS t FROM documents),
m AS (SELECT doc_id, regexp_replace(t, '(?i)FIA\s+F1\s+Document\s+\d+/\d{{4}}|Fédération\s+Internationale\s+de\s+l''Automobile[^\n]*(?:\n|\z)|THE\s+STEWARDS\s+OF\s+THE\s+MEETING\s*\n?', '', 'g') AS t FROM a),
b AS (SELECT doc_id, regexp_replace(t, '(?im)^[ \t]*(?:page[ \t]+\d+(?:[ \t]+of[ \t]+\d+)?|[-_=*]{{3,}}|\d{{1,3}})[ \t]*$\n?', '', 'g') AS t FROM m),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM b)
SELECT doc_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS digest FROM c
""")  # fmt: skip
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("digest"))


@query("html_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS label FROM pages)
SELECT page_id, href, label, count(*) AS n FROM a WHERE regexp_matches(lower(label), 'th|ou') GROUP BY ALL
""")  # fmt: skip
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.lit(r'<a href="([^"]*)"[^>]*>([^<]*)</a>')
    p = load(spark, sf_dir, "pages").select("page_id", F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label")).alias("links"))
    rows = p.select("page_id", F.inline("links")).where(F.lower("label").rlike("th|ou"))
    return rows.groupBy("page_id", "href", "label").agg(F.count(F.lit(1)).alias("n"))


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS host, nullif(regexp_extract(url, '/(\d+)(?:\?|$)', 1), '') AS number, nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS page FROM pages
""")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, r"^(\w+)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/]+)", 1).alias("host"), tx.extract(u, r"/(\d+)(?:\?|$)").alias("number"), tx.extract(u, r"[?&]page=(\d+)").alias("page")
    )


HIGH, LOW, NEGATIVE = ("ther", "enth", "ation", "wh"), ("the", "of"), ("er", "thing")


@query("radio_scores", r"""
WITH c AS (SELECT conv_id, turn, text, string_split_regex(lower(text), '[^\p{L}\p{N}_]+') AS w, string_split_regex(text, '[^\p{L}\p{N}_]+') AS raw FROM conversations),
h AS (SELECT conv_id, turn, len(list_filter(w, lambda x: x IN ('ther', 'enth', 'ation', 'wh'))) AS hi, len(list_filter(w, lambda x: x IN ('the', 'of'))) AS lo, len(list_filter(w, lambda x: x IN ('er', 'thing'))) AS neg,
    len(regexp_extract_all(text, '!')) AS ex, len(list_filter(raw, lambda x: regexp_full_match(x, '[A-Z]{3,}'))) AS caps FROM c)
SELECT conv_id, turn, round(least(greatest(0.25::DOUBLE * hi - 0.1::DOUBLE * lo, 0.0), 1.0), 3) AS urgency,
    round(least(greatest(-0.3::DOUBLE * neg + CASE WHEN lo > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, -1.0), 1.0), 3) AS sentiment,
    round(least((hi + 0.5::DOUBLE * ex + 0.3::DOUBLE * caps) / 4.0::DOUBLE, 1.0), 3) AS loudness FROM h
""")  # fmt: skip
def radio_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.urgency(t, HIGH, LOW).alias("urgency"), tx.sentiment(t, NEGATIVE, LOW).alias("sentiment"), tx.loudness(t, HIGH).alias("loudness"))


@query("speaker_roles", """
WITH s AS (SELECT conv_id, role, sum(length(text))::BIGINT AS talk FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY talk, role)::INTEGER AS place FROM s),
p AS (SELECT conv_id, bool_or(role = 'user') AND bool_or(role = 'assistant') AS both_sides FROM s GROUP BY 1)
SELECT conv_id, role, talk, CASE place WHEN 1 THEN 'driver' WHEN 2 THEN 'engineer' ELSE 'other' END AS part, both_sides FROM r JOIN p USING (conv_id)
""")  # fmt: skip
def speaker_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("talk"))
    by = rel.Window.partitionBy("conv_id")
    place = F.row_number().over(by.orderBy("talk", "role"))
    both = F.bool_or(F.col("role") == "user").over(by) & F.bool_or(F.col("role") == "assistant").over(by)
    return s.withColumn("both_sides", both).withColumn("_p", place).select("conv_id", "role", "talk", F.when(F.col("_p") == 1, "driver").when(F.col("_p") == 2, "engineer").otherwise("other").alias("part"), "both_sides")


@query("content_keys", r"""
SELECT doc_id, left(sha256(text), 16) AS key, left(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 _-]', '_', 'g'), '\s+', '_', 'g'), 80) || '-' || left(sha256(text), 16) AS name FROM documents
""")  # fmt: skip
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2(t, 256), F.lit(16)).alias("key"), tx.content_name(t, t).alias("name"))


@query("accent_keys", "SELECT doc_id, regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžœ', 'aaaaaaceeeeiiiinoooooouuuuyyszo'), '[^a-z0-9]', '', 'g') AS key FROM documents")
def accent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.fold_accents(F.col("text")).alias("key"))


@query("line_sections", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT doc_id, n, line, CASE WHEN length(line) < 40 THEN line END AS head FROM l)
SELECT doc_id, n::INTEGER AS n, length(line)::INTEGER AS chars, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM h
""")  # fmt: skip
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.select("doc_id", (F.col("n") + 1).alias("n"), F.length("line").alias("chars"), F.when(F.length("line") < 40, F.col("line")).alias("section"))
    return rel.carry_forward(lines, "section", ["doc_id"], ["n"])


@query("embedding_text", """
SELECT o_orderkey, coalesce(nullif(concat_ws(' | ', o_orderstatus, o_orderpriority, left(CASE WHEN o_totalprice > 100000 THEN 'large' END, 512)), ''), 'none') AS text FROM orders
""")  # fmt: skip
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" | ", "o_orderstatus", "o_orderpriority", F.left(F.when(F.col("o_totalprice") > 100000, "large"), F.lit(512)))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.nullif(text, F.lit("")), F.lit("none")).alias("text"))


@query("local_dates", r"""
SELECT event_id, (strptime(strftime(ts, '%d.%m.%y %H:%M'), '%d.%m.%y %H:%M') AT TIME ZONE 'Europe/Paris') AT TIME ZONE 'UTC' AS utc, (epoch(date_trunc('day', ts) + INTERVAL 1 DAY) - floor(epoch(ts)))::BIGINT AS to_midnight FROM events
""")  # fmt: skip
def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing dates in local time to UTC, and seconds to the next UTC midnight."""
    ts = F.col("ts").cast("timestamp")
    listed = F.concat(F.lit("published "), F.date_format(ts, "dd.MM.yy HH:mm"))
    left = 86400 - F.pmod(F.floor(F.unix_micros(ts) / 1000000), F.lit(86400))
    return load(spark, sf_dir, "events").select("event_id", tx.local_to_utc(listed).cast("timestamp_ntz").alias("utc"), left.cast("bigint").alias("to_midnight"))


RULING = (
    "2024 BELGIAN GRAND PRIX\nFrom The Stewards\nNo / Driver {n} - Ada Example\nTime 14:{m}\nSession Race\nFact Car {n} and car 16 made contact in turn {t} on lap 12.\n"
    "Infringement Causing a collision. Breach of Article 33.4 and 2 d).\nDecision {s} second time penalty and 2 penalty points.\nReason The Stewards reviewed video evidence and telemetry. Car {n} was predominantly to blame.\n"
)


@query("ruling_fields", r"""
SELECT s_suppkey AS doc_id, (s_suppkey % 99 + 1)::INTEGER AS car, 'Ada Example' AS driver, 'race' AS session, (5 * (s_suppkey % 3 + 1))::VARCHAR || 's' AS code, 'causing a collision' AS offence, (s_suppkey % 20 + 1)::INTEGER AS turn, true AS contact,
    '14:' || lpad((s_suppkey % 60)::VARCHAR, 2, '0') AS time, 2 AS points, 'video|telemetry' AS evidence FROM supplier
""")  # fmt: skip
def ruling_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field extraction over rulings written from a template, so that SQL knows the truth."""
    k = F.col("s_suppkey")
    text = F.lit(RULING)
    for name, value in (("n", k % 99 + 1), ("t", k % 20 + 1), ("s", 5 * (k % 3 + 1))):
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    text = F.replace(text, F.lit("{m}"), F.lpad((k % 60).cast("string"), 2, "0"))
    docs = load(spark, sf_dir, "supplier").select(k.alias("doc_id"), text.alias("raw_text"))
    out = rulings.extract_fields(docs)
    return out.select("doc_id", "car", "driver", "session", "code", "offence", "turn", "contact", "time", "points", F.array_join("evidence", "|").alias("evidence"))
