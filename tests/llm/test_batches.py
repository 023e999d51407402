"""How much text a worker holds at once."""

import pyarrow as pa
import pytest

from loadlens import session
from loadlens.llm import batches, bloom_lm, decontaminate, near_dup

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def operators(spark, docs):
    yield lambda: bloom_lm.train(docs)
    yield lambda: decontaminate.find_passages(docs, spark.createDataFrame([], "item_id string, text string"), ["doc_id"])
    yield lambda: near_dup.near_duplicates(docs)


@pytest.mark.parametrize("number", range(3))
def test_operators_take_long_texts_in_small_batches(spark, documents, number):
    def sizes(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = documents(["word " * 20000] * 300).coalesce(1)
    spark.conf.unset(KEY)
    list(operators(spark, documents(["a b c", None])))[number]()
    told = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(told) > 300 * 100000 and max(told) <= session.ARROW_BYTES + 200000


def test_blocks_bound_what_is_worked_on_at_once():
    texts = pa.array(["word " * 2000] * 500)
    found = list(batches.blocks(texts))
    assert max(len(data) for _, _, data, _ in found) <= 512 << 10
    assert [(a, b) for a, b, _, _ in found][-1][1] == 500
    assert sum(len(data) for _, _, data, _ in found) == 500 * 10000
