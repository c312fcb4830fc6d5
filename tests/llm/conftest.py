import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="atelier-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Texts that every operator must bear: null, empty, white space, repeats, other scripts.
ODD = [None, "", "   \n\t ", "a", "a\n\na\nA a", "the cat sat on the mat " * 40, "Ünïcödé 漢字 \U0001f600 ok", "x" * 3000, "1 2 3\n" * 30]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(len(ODD), "a", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
