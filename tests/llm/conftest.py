import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """Builds a documents table from texts, or from (id, text), or whole rows."""

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            if not isinstance(row, tuple):
                row = (i, row)
            if len(row) == 2:
                row = (*row, "en", "src0", None if row[1] is None else len(row[1]))
            full.append(row)
        return spark.createDataFrame(full, DOCUMENTS)

    return build
