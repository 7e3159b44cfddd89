import os

import pytest
from sqlcheck import FOLDER, compare

from repeatloom.llm import queries, tokens
from repeatloom.sources.tables import table

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"p7_ids"}))
def test_query_runs(spark, name):
    queries.QUERIES[name](spark, FOLDER).collect()


def test_ids_of_the_corpus(spark):
    tokenizer = tokens._tokenizer(tokens.VOCABULARY)
    got = {r["doc_id"]: r["ids"] for r in queries.QUERIES["p7_ids"](spark, FOLDER).collect()}
    assert got == {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in table(spark, FOLDER, "documents").collect()}
