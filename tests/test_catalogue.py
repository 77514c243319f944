import duckdb
import pytest

import __spark_entry__ as entry_point
from itemforge.plans import catalogue, catalogue_texts
from itemforge.sources import bank

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["ord", "chapter", "n_chars"]
    assert catalogue_texts.markup_documents.__name__ in catalogue.QUERIES
    assert set(catalogue.QUERIES) <= set(entry_point.queries())


def test_folder_files_with_tables_of_several_files(spark, tmp_path):
    for name in ("a.parquet", "d.parquet", "x.csv"):
        (tmp_path / name).write_bytes(b"x")
    for name in ("c.parquet/part-0.parquet", "c.parquet/part-1.parquet", "b.parquet/year=1/part-0.parquet", "b.parquet/part-2", "y/z.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = catalogue.QUERIES["folder_files"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(k, f"{x}.parquet") for k, x in enumerate("abcd")]
    assert [r["path"] for r in bank.chapter_files(spark, str(tmp_path), "{c,x}.*").collect()] == [f"file:{tmp_path}/c.parquet", f"file:{tmp_path}/x.csv"]
    assert bank.chapter_files(spark, str(tmp_path)).collect() == []


def test_pages_need_no_grams(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, f"License {k}") for k in range(700)], "ord long, question string").withColumn("chapter", catalogue.F.lit("en"))
    monkeypatch.setattr(catalogue.stored, "grams", None)
    shelf = catalogue.stored.StoredItems.build(df, str(tmp_path), searched=False)
    assert [r["ord"] for r in shelf.after(254, 5).collect()] == [255, 256, 257, 258, 259]
    assert [r["ord"] for r in shelf.chapter_page("en", text="license 69").collect()] == [69, *range(690, 700)]
