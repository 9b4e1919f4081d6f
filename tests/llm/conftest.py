from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) or texts alone."""
    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "s") for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, x, "en", s, None if x is None else len(x)) for i, x, s in rows], DOCS)
    return make
