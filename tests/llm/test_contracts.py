"""The registered queries on the small tables: columns, laws, and SQL where there is some."""

import glob
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest

from figmill.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(name, spark, sf_dir, duck, tmp_path):
    df = QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    df.write.parquet(f"{tmp_path}/out")
    got = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    if name not in ("op9_topk", "op5_packing", "op2_url_filter"):
        assert sorted(r[0] for r in duck.sql("SELECT doc_id FROM got").fetchall()) == sorted(r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        pick = ", ".join(f'"{c}"' for c in sorted(want.columns))
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda r: sorted(duck.sql(f"SELECT {pick} FROM r").fetchall(), key=repr)
        assert rows(got) == rows(want)


def test_mixing_and_sharding_agree_on_reruns(spark, sf_dir):
    for name in ("op8_mixing", "op1_sharding"):
        first, second = (Counter(map(tuple, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
        assert first == second


def test_held_out_rows_are_by_crc(spark, sf_dir):
    rows = QUERIES["op7_toxicity"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
