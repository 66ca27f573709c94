import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from keelstone.session import prepare

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return prepare(s)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


#: Texts that every operator has to take: null, empty, blank, long, tied, repeated, beyond ASCII.
EDGE = [
    (1, None, "en", "s", None, "x"),
    (2, "", "en", "s", 0, "x"),
    (3, " \n\t ", None, None, 4, None),
    (4, "word " * 30_000, "en", "s", 150_000, "x"),
    (5, "the same short text", "en", "s", 19, "x"),
    (5, "the same short text", "en", "s", 19, "x"),
    (6, "the same short text", "xx", "s", 19, "x"),
    (None, "a text without an id, naïve ÉTÉ 漢字 🙂   end", "fr", "s", 40, "x"),
    (7, "x" * 200_000, "en", "s", 200_000, "x"),
]
#: `found`, `h`, `label` and `fp` clash with names that operators use.
EDGE_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string"


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, EDGE_SCHEMA).withColumns({c: F.lit("clash") for c in ("h", "label", "fp", "n_words", "kept", "rep")})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
