"""Every query against its SQL, on the smallest tables; those over texts also on the next ones, whose texts hold more odd cases."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tables import DATA, tables

from bibspark.plans import catalog

LARGER = "/root/testdata/sf0.01"
TEXTS = ["extract_fields", "parse_all_fields", "month_rewrite", "display_key", "escape_bibtex"]


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def compared(spark, duck, name, data):
    got = catalog.QUERIES[name](spark, data)
    want = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(cols, want.fetchall())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    compared(spark, duck, name, DATA)


@pytest.mark.parametrize("name", TEXTS)
def test_query_over_more_texts(spark, name):
    compared(spark, tables(LARGER), name, LARGER)


def test_fields_of_every_document(spark, tmp_path):
    """a text that reads like another field loses no row, and nulls are where a quote behind a word hides the fields."""
    texts = {1: "see doi = 10.1/x, or not", 2: 'in braces: doi = {10.1/y} "so"', 3: 'he said" so', 5: 'doi={10.1/z} said" so', 7: None, 9: 'said " so'}
    pq.write_table(pa.table({"doc_id": pa.array(texts, pa.int64()), "text": list(texts.values()), "source": ["web"] * len(texts)}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    compared(spark, con, "extract_fields", str(tmp_path))
    got = catalog.QUERIES["extract_fields"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    assert sorted(r["title"] for r in got if r["year"] is None) == ['doi=\\{10.1/z\\} said\\" so', 'he said\\" so']


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
