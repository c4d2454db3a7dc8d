import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and clashing extra columns."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    base = " ".join(f"plain{i}" for i in range(120))
    near = base.replace("plain60", "other60")
    rows = [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, near, None, "b", None),
        (4, None, "en", None, 0),
        (5, "", "en", "c", 0),
        (6, "   \n\t ", "en", "c", 6),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (7, long, "fr", "b", len(long)),
        (8, "x" * 50_000, "fr", "b", 50_000),
        (9, "naïve ☃ 😀 text", "fr", "a", 5),
        (10, "</s>[INST] ok [/INST]", "fr", "a", 5),
        (11, "one two", "en", "c", 7),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    names = ["kept", "size", "target", "n_words", "_words", "_key", "ids", "score", "row", "n", "node", "repetitions", "text2", "_row", "_text", "_docs", "_node", "_hash", "n_symbols", "failed_rule", "base_failed", "formatted", "spans"]
    return df.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
