"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import SF, same_rows

from corpusloom.oracles import ORACLES
from corpusloom.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_all_but_one_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"parse_corpus"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_parse_corpus_covers_all_code_files(spark):
    from corpusloom.operators.chunking import PROSE
    from corpusloom.queries import fi

    code = fi(spark, SF).filter("file_type <> 'mmd'").filter(~__import__("pyspark.sql.functions", fromlist=["col"]).col("file_type").isin(*PROSE)).filter("trim(content) <> ''")
    assert QUERIES["parse_corpus"](spark, SF).count() == code.count()


def test_hashed_vectors_have_unit_length(spark):
    import math

    squares = {}
    for row in QUERIES["embed_documents"](spark, SF).collect():
        squares.setdefault(row["chunk_id"], []).append(row["value"] ** 2)
    assert all(len(x) == 64 and (abs(math.sqrt(sum(x)) - 1) < 1e-4 or sum(x) == 0) for x in squares.values())
