"""Registered queries against their SQL, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from photolake.plans import catalog_queries, flow_queries, pixel_queries  # noqa: F401
from photolake.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def comparable(rows, digits=6):
    plain = lambda v: round(float(v), digits) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


#: A part of the queries, to keep the suite short; the driver compares all of them.
CHOSEN = ["date_histogram_dense", "classify_import", "expand_requests", "enqueue", "forget_queue", "effective_params", "resolve_lens", "white_level", "hist_heights", "smoothed", "film_curve", "stream_date_histogram", "stream_import", "stream_histogram_changes", "hist_float_turned", "hist_raw_colour", "hist_raw_mono", "raw_normalised", "merge_chain", "merge_exposures", "exposure_ratio", "hash_suffix", "labels", "count_uses", "queue_view", "dequeue", "queue_move", "queue_reset_order", "queue_position", "levelled", "downscaled", "thumb_states", "camera_wb_upsert", "upgrade_params", "effective_estimates", "queue_moved_keyed", "organize_stored", "discover_raws", "stream_live_histogram"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    order = [[c[0] for c in cursor.description].index(n) for n in names]
    assert comparable([r[n] for n in names] for r in df.collect()) == comparable([r[i] for i in order] for r in cursor.fetchall())


def test_round_trip_equals_sql_beyond_six_digits(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    ids = "(7), (999999), (1000000), (5544461), (5544462), (12345678901), (NULL)"
    con.execute(f"CREATE TABLE events AS SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01 00:00:00.5' AS ts, coalesce(i % 2, 2)::BIGINT AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value FROM (VALUES {ids}) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES["catalog_round_trip"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['catalog_round_trip']})").fetchall()
    assert "IMG_554446.CR2" in {r[2] for r in want} and comparable(df.collect()) == comparable(want)


def test_entry_imports_without_a_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
def test_each_file_has_an_estimate(spark, duck):
    """The query has no twin in SQL."""
    got = QUERIES["estimate_wb_by_camera"](spark, SMALL).collect()
    assert sorted(r.photo_id for r in got) == [k for (k,) in duck.execute("SELECT c_custkey FROM customer ORDER BY 1").fetchall()]
    assert all(2000 < r.temperature < 20000 and 0.3 < r.tint < 1.5 for r in got)
