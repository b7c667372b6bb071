"""Registry shape, and every query against its SQL on the smallest tables. COURTLOOM_QUICK=1 compares a sample."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["prj04_homography", "jn06_nearest_event", "jn14_greedy_match", "agg06_decayed_vote", "agg20_event_scorecard", "win01_rle_segments", "win02_hysteresis_holder",
          "evt00_ball_story_segments", "evt05_shot_detection", "evt16_turnovers_steals", "etl08_capped_identity_sample", "trk09_identity_claims"]
NAMES = SAMPLE if os.environ.get("COURTLOOM_QUICK") else sorted(entry.oracle_sql())

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    res = duck.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=str)


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["game", "start_frame", "end_frame", "value", "parts"]


def test_registry_stands_without_the_text_operators():
    """The subpackage and the pipeline may be left out; everything else is still registered."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['courtloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout.split()
    assert int(said[0]) > 200 and said[1] == "False" and int(said[2]) > 200
