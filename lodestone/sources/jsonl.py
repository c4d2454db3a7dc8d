"""Line-delimited JSON, append and rewrite sinks, and page links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One published document as it is scraped.
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("pdf_url", T.StringType()),
    T.StructField("sha256_hash", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("season", T.IntegerType()),
    T.StructField("published_at", T.StringType()), T.StructField("char_count", T.IntegerType()), T.StructField("needs_ocr", T.BooleanType()),
])
ANNOTATION = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "annotator", "infraction_type", "outcome", "penalty_class", "article_cited", "notes", "positive_doc_id", "negative_doc_id")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = True) -> DataFrame:
    """Rows of a line-delimited file; blank lines are skipped, and malformed ones too if ``tolerant`` (else they raise)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def corrupt_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that do not parse, for a report: each line is parsed as it is read, nothing is cached."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).where(F.btrim("value") != "").select(parsed["_corrupt"].alias("_corrupt")).where(F.col("_corrupt").isNotNull())


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def usable(docs: DataFrame, least: int = 280, least_scanned: int = 600) -> DataFrame:
    """Documents with enough text; scanned ones need more."""
    n = F.length(F.coalesce("raw_text", F.lit("")))
    return docs.where((n >= least) & (~F.coalesce("needs_ocr", F.lit(False)) | (n >= least_scanned)))


def write_seasons(df: DataFrame, path: str, season: str = "season") -> None:
    """JSON lines in a folder a season, so that a filter on the season reads only its folders."""
    df.repartition(season).write.mode("overwrite").partitionBy(season).json(path)


def read_seasons(spark: SparkSession, path: str, schema: T.StructType, seasons: Sequence[int] | None = None, season: str = "season") -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if seasons is None else rows.where(F.col(season).isin(list(seasons)))


def rewrite_matching(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows whose key is in ``new`` replaced by those of ``new``, column by column where it has a value."""
    fresh = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    out = stored.join(fresh, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns and c != key else F.col(c) for c in stored.columns])


def rewrite_without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """All rows but those of the keys in ``gone``; write to a new folder and swap."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


#: Words in the titles of links that lead to documents.
LINK_WORDS = ("decision", "offence", "infringement", "summons", "document", "penalty", "stewards", "investigation")


def document_links(pages: DataFrame, html: str = "html", suffix: str = ".pdf", words: Sequence[str] = LINK_WORDS) -> DataFrame:
    """(all columns, href, title, published) of links to documents whose title has any of the words.

    ``published`` is the date of the nearest element around the link that states one: the last date
    between the start of the block (list item, row, section or paragraph) and the link, or in the title.
    """
    pattern = r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    before = F.split(F.col(html), pattern, -1)
    links = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("title"),
        F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))).alias("_before"),
    )
    rows = pages.select("*", F.inline(links))
    title = F.btrim(F.regexp_replace(F.regexp_replace("title", "<[^>]*>", " "), r"\s+", " "))
    rows = rows.withColumn("title", title).where(F.lower("href").endswith(suffix) & F.lower("title").rlike("|".join(words)))
    block = F.element_at(F.split("_before", r"(?i)<(?:li|tr|section|article|div|p|ul)\b"), -1)
    dates = F.regexp_extract_all(F.concat_ws(" ", block, "title"), F.lit(r"(\d{2}\.\d{2}\.\d{2} \d{2}:\d{2})"), F.lit(1))
    return rows.withColumn("published", F.get(F.reverse(dates), F.lit(0))).drop("_before")


def select_options(pages: DataFrame, html: str = "html") -> DataFrame:
    """(all columns, value, name) of the options of selects; the value 0 is the empty choice."""
    pattern = F.lit(r'(?is)<option\b[^>]*value="([^"]*)"[^>]*>([^<]*)')
    rows = pages.select("*", F.inline(F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("value"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("name"))))
    return rows.where("value <> '0'").withColumn("name", F.btrim("name"))


def season_of_url(url: Column) -> Column:
    """A year from 2015 to 2030 after a slash, or null."""
    year = F.try_to_number(F.nullif(F.regexp_extract(url, r"/(20\d{2})[_/-]", 1), F.lit("")), F.lit("9999")).cast("int")
    return F.when(year.between(2015, 2030), year)
