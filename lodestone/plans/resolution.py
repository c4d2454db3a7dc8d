"""Names, numbers and articles resolved, over tables whose truth SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import resolvers
from lodestone.plans.registry import query
from lodestone.sources import load

#: Nations stand for drivers (code, full name with a region as surname), suppliers for raw mentions.
_DRIVERS = """
drivers AS (SELECT n_nationkey AS place, upper(left(n_name, 2)) || chr((65 + n_nationkey)::INTEGER) AS code, n_name || ' ' || replace(r_name, ' ', '') AS full_name,
    replace(lower(r_name), ' ', '') AS surname, 2018 + n_nationkey % 5 AS first_season, (n_nationkey % 9 + 2)::INTEGER AS number, (n_nationkey % 4 + 20)::INTEGER AS early_number
    FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def _drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each is active in two seasons, with another number in the first of them."""
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    first = (k % 5 + 2018).cast("int")
    return n.select(
        k.alias("place"),
        F.concat(F.upper(F.left("n_name", F.lit(2))), F.chr(k + 65)).alias("code"),
        F.concat_ws(" ", "n_name", F.replace("r_name", F.lit(" "), F.lit(""))).alias("full_name"),
        F.array(first, first + 1).alias("seasons"),
        (k % 9 + 2).cast("int").alias("number"),
        F.create_map(first, (k % 4 + 20).cast("int"), first + 1, (k % 9 + 2).cast("int")).alias("numbers"),
    )


@query("resolve_driver_names", f"""
WITH {_DRIVERS},
m AS (SELECT s_suppkey, s_suppkey % 7 AS kind, d.*, CASE WHEN s_suppkey % 3 = 0 THEN 2018 + s_suppkey % 7 END AS season FROM supplier JOIN drivers d ON s_nationkey = d.place),
c AS (SELECT a.s_suppkey, b.code, b.place, m2.n, m2.season, b.first_season FROM m a JOIN drivers b ON a.surname = b.surname JOIN (SELECT s_suppkey, season, (SELECT count(*) FROM drivers x WHERE x.surname = m.surname) AS n FROM m) m2 ON m2.s_suppkey = a.s_suppkey),
f AS (SELECT s_suppkey, arg_min(code, place) AS first, arg_min(code, place) FILTER (season IN (first_season, first_season + 1)) AS then FROM c GROUP BY 1)
SELECT m.s_suppkey, CASE kind WHEN 0 THEN m.code WHEN 1 THEN m.code WHEN 2 THEN m.code
    WHEN 3 THEN CASE WHEN season IS NOT NULL THEN coalesce(f.then, f.first) END WHEN 4 THEN coalesce(CASE WHEN season IS NOT NULL THEN f.then END, f.first) END AS code
FROM m LEFT JOIN f USING (s_suppkey)
""")  # fmt: skip
def resolve_driver_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in any case, full names with accents and spaces, bare surnames, initials, unknown and empty names."""
    d = _drivers(spark, sf_dir)
    k = F.col("s_suppkey")
    s = load(spark, sf_dir, "supplier").join(d.select(F.col("place").alias("s_nationkey"), "code", "full_name"), "s_nationkey")
    raw = (
        F.when(k % 7 == 0, F.lower("code")).when(k % 7 == 1, F.concat(F.lit("  "), "full_name", F.lit(" "))).when(k % 7 == 2, F.translate("full_name", "AEIOU", "ÀÉÎÖÜ"))
        .when(k % 7 == 3, resolvers.last_word(F.col("full_name"))).when(k % 7 == 4, F.concat(F.lit("M. "), resolvers.last_word(F.col("full_name")))).when(k % 7 == 5, "Nobody Known")
    )
    mentions = s.select("s_suppkey", raw.alias("raw"), F.when(k % 3 == 0, (k % 7 + 2018).cast("int")).alias("season"))
    return resolvers.resolve_name(mentions, F.col("raw"), F.col("season"), d).select("s_suppkey", "code")


@query("resolve_car_numbers", f"""
WITH {_DRIVERS},
m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 1 WHEN s_suppkey % 4 = 1 THEN 20 + s_suppkey % 5 ELSE s_suppkey % 12 + 1 END AS num, CASE WHEN s_suppkey % 3 > 0 THEN 2018 + s_suppkey % 9 END AS season FROM supplier),
champion AS (SELECT first_season AS season, arg_min(code, place) AS code FROM drivers WHERE first_season IN (2019, 2021) GROUP BY 1),
ever AS (SELECT code, place, number AS num FROM drivers UNION SELECT code, place, early_number FROM drivers),
e AS (SELECT s_suppkey, count(*) AS n, arg_min(code, place) AS first FROM m JOIN ever USING (num) GROUP BY 1),
x AS (SELECT s_suppkey, arg_min(code, place) AS code FROM m JOIN drivers d ON (season = first_season AND num = early_number) OR (season = first_season + 1 AND num = number) GROUP BY 1),
t AS (SELECT s_suppkey, arg_min(v.code, v.place) AS code FROM m JOIN ever v USING (num) JOIN drivers d ON d.place = v.place AND season IN (first_season, first_season + 1) GROUP BY 1),
w AS (SELECT s_suppkey, arg_min(code, place) AS code FROM m JOIN drivers ON num = number GROUP BY 1)
SELECT m.s_suppkey, coalesce(CASE WHEN num = 1 THEN champion.code END, CASE WHEN e.n = 1 THEN e.first END, x.code, t.code, w.code, e.first) AS code
FROM m LEFT JOIN champion ON champion.season = m.season LEFT JOIN e USING (s_suppkey) LEFT JOIN x USING (s_suppkey) LEFT JOIN t USING (s_suppkey) LEFT JOIN w USING (s_suppkey)
""")  # fmt: skip
def resolve_car_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _drivers(spark, sf_dir)
    k = F.col("s_suppkey")
    number = F.when(k % 11 == 0, 1).when(k % 4 == 1, k % 5 + 20).otherwise(k % 12 + 1).cast("int")
    m = load(spark, sf_dir, "supplier").select("s_suppkey", number.alias("num"), F.when(k % 3 > 0, (k % 9 + 2018).cast("int")).alias("season"))
    champions = d.select(F.get("seasons", F.lit(0)).alias("season"), "code", "place").where("season IN (2019, 2021)").groupBy("season").agg(F.min_by("code", "place").alias("code"))
    return resolvers.resolve_number(m, F.col("num"), F.col("season"), d, champions).select("s_suppkey", "code")


_CITED = ("38.1", "48.1", "12.2", "7.4")


@query("cited_articles", """
WITH k AS (SELECT o_orderkey AS doc_id, (o_orderkey % 4)::INTEGER AS a, (o_orderkey % 7)::INTEGER AS h, (o_orderkey % 3)::INTEGER AS far, (o_orderkey % 5)::INTEGER AS app FROM orders),
g AS (SELECT doc_id, (['38.1', '48.1', '12.2', '7.4'])[a + 1] AS article_number,
    CASE WHEN far < 2 AND h < 6 THEN (['F1 Sporting Regulations', 'F1 Technical Regulations', 'F1 Financial Regulations', 'ISC', 'FIA Penalty Guidelines', 'Driving Standards Guidelines'])[h + 1]
        ELSE (['FIA Penalty Guidelines', 'F1 Sporting Regulations', 'ISC', 'F1 Sporting Regulations'])[a + 1] END AS document_name,
    CASE WHEN doc_id % 2 = 0 THEN 'Art. ' ELSE 'Article ' END || (['38.1', '48.1', '12.2', '7.4'])[a + 1] AS raw_text FROM k
  UNION ALL SELECT doc_id, CASE app WHEN 0 THEN 'Appendix L Ch.4' ELSE 'Appendix H' END, 'F1 Sporting Regulations', CASE app WHEN 0 THEN 'Appendix l Chapter 4' ELSE 'APPENDIX H' END FROM k WHERE app < 2)
SELECT doc_id, article_number, document_name, raw_text, CASE article_number WHEN '38.1' THEN 'G2' WHEN '48.1' THEN 'G3' WHEN 'Appendix H' THEN 'G4' END AS article_id FROM g
""")  # fmt: skip
def cited_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, the documents named within and beyond their reach, and their guideline rows (the last of equal numbers)."""
    k = F.col("o_orderkey")
    hints = F.array(*[F.lit(x) for x in ("Sporting Regulations", "technical regulations", "Financial Regulation", "International Sporting Code", "penalty guidelines", "Driving Standards", "rules")])
    cited = F.concat(F.when(k % 2 == 0, "Art. ").otherwise("Article "), F.get(F.array(*[F.lit(x) for x in _CITED]), (k % 4).cast("int")))
    gap = F.when(k % 3 == 2, F.repeat(F.lit("and so on "), F.lit(13))).otherwise(F.lit("of the "))
    appendix = F.when(k % 5 == 0, " See Appendix l Chapter 4.").when(k % 5 == 1, " See APPENDIX H.").otherwise("")
    pad = F.repeat(F.lit("party time. "), F.lit(12))
    text = F.concat(F.lit("The Steward Martin took part. "), cited, F.lit(" "), gap, F.get(hints, (k % 7).cast("int")), F.lit(". "), pad, cited, F.lit(". "), pad, appendix)
    docs = load(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))
    guidelines = spark.createDataFrame([("38.1", "G1", 1), ("38.1", "G2", 2), ("48.1", "G3", 3), ("Appendix H", "G4", 4), ("99.9", "G5", 5)], "article_number string, article_id string, place int")
    found = resolvers.guideline_ids(resolvers.cited_articles(docs, "text", "doc_id"), guidelines)
    return found.select("doc_id", "article_number", "document_name", "raw_text", "article_id")
