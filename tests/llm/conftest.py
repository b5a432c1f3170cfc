import pytest

#: A column that every operator has to ignore or keep, with names that its own steps use.
CLASHING = "text string, doc_id long, part int, mark string, key int, ids string, n int, root int"


@pytest.fixture(scope="session")
def llm_spark(spark):
    from llm.common import prepare

    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def make_docs(llm_spark):
    def make(rows, clashing=True):
        """rows: (doc_id, text)."""
        if not clashing:
            return llm_spark.createDataFrame(rows, "doc_id long, text string")
        full = [(t, i, 7, "x", 3, "y", 1, 0) for i, t in rows]
        return llm_spark.createDataFrame(full, CLASHING)

    return make
