"""A session and small document frames for the text operators."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def frame(spark):
    """Make documents of (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame(
            [(i, x, None, None, None if x is None else len(x)) for i, x in rows], DOCUMENTS
        )

    return make
