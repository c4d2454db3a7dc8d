"""Names, numbers and cited articles resolved against dimension tables, as equality joins.

Every rule of a cascade is one lookup table with one row a key, left-joined; the first rule that
finds something wins. Spark broadcasts those lookups that its size check admits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import fold_accents

#: Which code carried the number 1 in a season, where the feed only knows own numbers.
CHAMPIONS = {2018: "HAM", 2019: "HAM", 2020: "HAM", 2021: "HAM", 2022: "VER", 2023: "VER", 2024: "VER", 2025: "VER", 2026: "NOR"}


def _first(dimension: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    return dimension.groupBy(*keys).agg(F.min_by(value, place).alias("_found"), F.count(F.lit(1)).alias("_n"))


def _lookup(df: DataFrame, table: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """``df`` with ``name`` (and ``name``_n) of the lookup row whose keys equal the given columns."""
    right = table.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("_found").alias(name), F.col("_n").alias(f"{name}_n"))
    return df.join(right, [value == F.col(f"_{name}_{k}") for k, value in keys.items()], "left").drop(*[f"_{name}_{k}" for k in keys])


def last_word(name: Column) -> Column:
    return F.element_at(F.split(F.btrim(name), r"\s+"), -1)


def resolve_name(df: DataFrame, name: Column, season: Column, drivers: DataFrame, out: str = "code") -> DataFrame:
    """``df`` with the code of the driver that a raw name means, null if none.

    drivers: code, full_name, seasons (array), place (order among equals). In this order: the code
    itself; the full name without accents; a surname that one driver has; of several, the one active
    in the season; the first of them if a season or an initial is given.
    """
    raw = F.nullif(F.btrim(name), F.lit(""))
    d = drivers.select("code", fold_accents(F.col("full_name")).alias("full"), fold_accents(last_word(F.col("full_name"))).alias("surname"), "seasons", "place")
    active = d.select("code", "surname", "place", F.explode("seasons").alias("season"))
    df = df.withColumn("_raw", raw).withColumn("_season", season)
    short = F.when(F.length("_raw") == 3, F.upper("_raw"))
    df = _lookup(df, _first(d, ["code"], "code", "place"), {"code": short}, "_a")
    df = _lookup(df, _first(d, ["full"], "code", "place"), {"full": fold_accents(F.col("_raw"))}, "_b")
    surname = fold_accents(last_word(F.col("_raw")))
    df = _lookup(df, _first(d, ["surname"], "code", "place"), {"surname": surname}, "_c")
    df = _lookup(df, _first(active, ["surname", "season"], "code", "place"), {"surname": surname, "season": F.col("_season")}, "_d")
    several = F.when(F.col("_c_n") == 1, F.col("_c")).when(F.col("_season").isNotNull(), F.coalesce("_d", "_c")).when(F.size(F.split("_raw", r"\s+")) > 1, F.col("_c"))
    return df.withColumn(out, F.coalesce("_a", "_b", several)).drop("_raw", "_season", *[f"_{x}{s}" for x in "abcd" for s in ("", "_n")])


def resolve_number(df: DataFrame, number: Column, season: Column, drivers: DataFrame, champions: DataFrame, out: str = "code") -> DataFrame:
    """``df`` with the code of the driver that a car number means in a season (null: any), null if none.

    drivers: code, number (now), numbers (map of season to number), seasons, place; champions:
    season, code. In this order: number 1 is the champion's; a number that one driver ever had; who
    had it in that season; who was active then; who has it now; the first. Without a season the two
    rules on seasons do not apply.
    """
    own = drivers.select("code", "place", F.col("number").cast("int").alias("number"))
    ever = own.unionByName(drivers.select("code", "place", F.explode(F.map_values("numbers")).alias("number"))).where("number IS NOT NULL").distinct()
    by_season = drivers.select("code", "place", F.explode("numbers").alias("season", "number"))
    active = ever.join(drivers.select("code", F.explode("seasons").alias("season")), "code")
    df = df.withColumn("_number", number).withColumn("_season", season)
    codes = champions.join(drivers.select("code"), "code", "left_semi").withColumn("place", F.lit(0))
    df = _lookup(df, _first(codes, ["season"], "code", "place"), {"season": F.when(F.col("_number") == 1, F.col("_season"))}, "_a")
    df = _lookup(df, _first(ever, ["number"], "code", "place"), {"number": F.col("_number")}, "_b")
    at = {"number": F.col("_number"), "season": F.col("_season")}
    df = _lookup(df, _first(by_season, ["number", "season"], "code", "place"), at, "_c")
    df = _lookup(df, _first(active, ["number", "season"], "code", "place"), at, "_d")
    df = _lookup(df, _first(own.where("number IS NOT NULL"), ["number"], "code", "place"), {"number": F.col("_number")}, "_e")
    one = F.when(F.col("_b_n") == 1, F.col("_b"))
    return df.withColumn(out, F.coalesce("_a", one, "_c", "_d", "_e", "_b")).drop("_number", "_season", *[f"_{x}{s}" for x in "abcde" for s in ("", "_n")])


# ---------------------------------------------------------------- cited articles

#: Documents named near a citation, in order, and the document of well-known articles.
DOCUMENT_HINTS = (
    ("(?i)sporting\\s+regulation", "F1 Sporting Regulations"),
    ("(?i)technical\\s+regulation", "F1 Technical Regulations"),
    ("(?i)financial\\s+regulation", "F1 Financial Regulations"),
    ("(?i)international\\s+sporting", "ISC"),
    ("(?i)penalty\\s+guideline", "FIA Penalty Guidelines"),
    ("(?i)driving\\s+standard", "Driving Standards Guidelines"),
)
KNOWN_ARTICLES = {
    "FIA Penalty Guidelines": ("38.1", "38.2"),
    "F1 Sporting Regulations": ("33.3", "34.7", "34.12", "20.5", "48.1", "55.13", "55.14"),
    "ISC": ("2.1", "12.1", "12.2"),
}
DEFAULT_DOCUMENT = "F1 Sporting Regulations"
ARTICLE = r"(?i)\bart(?:icle)?\.?\s*\d{1,3}(?:\.\d{1,3})*"
APPENDIX = r"(?i)\bappendix\s+[A-Z](?:\s+ch(?:apter)?\.?\s*\d+)?"
#: Characters on either side of a citation in which a document may be named.
NEAR = 100


def _found(text: Column, pattern: str) -> Column:
    """Array of (raw, at) of every match, at counted from 0: pieces between the matches give the places."""
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.transform(raw, lambda r, i: F.struct(r.alias("raw"), F.get(gaps, i).alias("gap")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<raw:string,at:int>>").alias("out"))
    step = lambda a, x: F.struct((a["end"] + x["gap"] + F.length(x["raw"])).alias("end"), F.array_append(a["out"], F.struct(x["raw"].alias("raw"), (a["end"] + x["gap"]).alias("at"))).alias("out"))
    return F.aggregate(both, start, step, lambda a: a["out"])


def cited_articles(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, article_number, document_name, raw_text): each cited article once, at its first place.

    The document is the first hint within ``NEAR`` characters, else that of a well-known article, else
    the sporting regulations. Appendices carry their letter and chapter.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(key, t.alias("_t"))
    articles = rows.select(key, "_t", F.inline(_found(F.col("_t"), ARTICLE)))
    window = F.substring(F.col("_t"), F.greatest(F.col("at") - NEAR, F.lit(0)) + 1, F.least(F.col("at"), F.lit(NEAR)) + NEAR)
    hint = F.lit(None).cast("string")
    for pattern, name in reversed(DOCUMENT_HINTS):
        hint = F.when(F.col("_near").rlike(pattern), F.lit(name)).otherwise(hint)
    number = F.regexp_extract("raw", r"(\d{1,3}(?:\.\d{1,3})*)", 1)
    known = F.lit(DEFAULT_DOCUMENT)
    for name, numbers in KNOWN_ARTICLES.items():
        known = F.when(F.col("article_number").isin(list(numbers)), F.lit(name)).otherwise(known)
    articles = articles.withColumn("_near", window).withColumn("article_number", number).withColumn("document_name", F.coalesce(hint, known))
    appendices = rows.select(key, F.inline(_found(F.col("_t"), APPENDIX)))
    chapter = F.nullif(F.regexp_extract("raw", r"(?i)ch(?:apter)?\.?\s*(\d+)$", 1), F.lit(""))
    letter = F.upper(F.regexp_extract("raw", r"(?i)^appendix\s+([A-Z])", 1))
    appendices = appendices.withColumn("article_number", F.concat(F.lit("Appendix "), letter, F.coalesce(F.concat(F.lit(" Ch."), chapter), F.lit("")))).withColumn("document_name", F.lit(DEFAULT_DOCUMENT))
    both = articles.select(key, "article_number", "document_name", "raw", "at").unionByName(appendices.select(key, "article_number", "document_name", "raw", "at"))
    first = both.groupBy(key, "article_number").agg(F.min_by(F.struct("document_name", "raw"), "at").alias("_f"))
    return first.select(key, "article_number", F.col("_f.document_name").alias("document_name"), F.col("_f.raw").alias("raw_text"))


def guideline_ids(citations: DataFrame, guidelines: DataFrame) -> DataFrame:
    """``citations`` with the article_id of their number, null if unknown; of equal numbers the last (by place) wins."""
    last = guidelines.groupBy("article_number").agg(F.max_by("article_id", "place").alias("article_id"))
    return citations.join(last, "article_number", "left")
