"""Registered queries against their SQL on the smallest tables.

By default a core of each family runs; FLAREFRAME_ALL=1 runs every query.
"""

import datetime
import math
import os

import duckdb
import pytest

from flareframe.queries import all_queries, all_sql

DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
CORE = ("d15 d16 j09_missing d08_null j02_null o02_top_movers e4 a01 a07_missing a08 a12_vector "
        "a13_fit_robust a15_class_weights_inverse_v2 a17_sample a19 d03_keep d08 d10 d12 "
        "d14_group_split_cumulative d18 e1_flux e2_augmented f05 f07 j02 j03 j04 j06 j10 m09_multi m10 "
        "m15 m16 m20 m24 m26_roc_auc m27_average m29 m30_consensus_threshold m35 p02 p08 q01 q02 s01 s05 "
        "s07 s08 s09_mixed s10_mixed s12 s14_flat s17 t02_history_skip t06_apply_robust t08 t11 t12 u03 w01 w03 w04 w05 w07 "
        "w09 w11 x03 x05 x08 x09").split()
NAMES = sorted(n for n in all_sql() if os.environ.get("FLAREFRAME_ALL") or any(n.startswith(c) for c in CORE))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return None if v is None else str(v)


def table(rows, names):
    cols = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in cols) for r in rows]
    return [names[i] for i in cols], sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = all_queries()[name](spark, DIR)
    got = table(df.collect(), df.columns)
    cur = con.execute(all_sql()[name])
    want = table(cur.fetchall(), [d[0] for d in cur.description])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_columns_of_plain_types(spark):
    for name in ("j02_label_ahead", "e2_clip_dataset"):
        df = all_queries()[name](spark, DIR)
        assert all(not t.startswith(("array", "map", "struct")) for _, t in df.dtypes)


def test_entry(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
