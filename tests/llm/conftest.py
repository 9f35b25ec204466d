import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing extra column."""
    long = " ".join(f"word{k % 700}x" for k in range(60_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "a row without an id", "en", "a", 19),
        (3, long, "en", "a", len(long)),
        (4, "the same row twice, the same row twice", "en", "b", 38),
        (4, "the same row twice, the same row twice", "en", "b", 38),
        (5, " \n\t \n", "de", "b", 5),
        (6, "Ünïcödé ☃ 梦 \x00 text\r\nwith   gaps ", None, "c", 30),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOC_SCHEMA).withColumn("score", F.lit("kept")).withColumn("n_words", F.lit(-1))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
