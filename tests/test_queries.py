"""Every query with a SQL twin gives the twin's rows; the others run."""

import duckdb
import pytest

from palimpsest import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rounded(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(rounded(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(rounded(dict(zip(names, r))[c]) for c in sorted(names)) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def sql_rows(name, path, table):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    found = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted((dict(zip(names, r)) for r in found.fetchall()), key=repr)


def spark_rows(name, spark, path):
    return [r.asDict() for r in registry.queries()[name](spark, str(path)).collect()]


def test_keyword_profile_of_empty_texts_and_halves(spark, tmp_path):
    texts = ["", None, "the", "a then the", "x" * 40 + "the" + "x" * 597, "x" * 322 + "the" + "x" * 315]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sql_rows("keyword_profile", tmp_path, "documents")
    assert sorted(spark_rows("keyword_profile", spark, tmp_path), key=repr) == want and [r["at"] for r in want[:2]] == [0.0, 0.0]
