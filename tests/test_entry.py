"""The driver contract: names line up, the flagship runs, and a sample of queries equals its SQL."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pathlib import Path

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(oracle_sql()) <= set(queries())
    # Drawn start points: what must hold of the result is in settled_clusters.
    own = {name for name in queries() if name != "pipeline" and not name.startswith("op")}
    assert not own - set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["library_id", "chapter_id", "photo_count", "hero_photo_id", "date", "lat", "lng"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["gap_clusters", "exact_duplicates", "near_duplicates", "chapter_quotas_full", "card_layouts",
                                  "photos_by_event", "funnel_by_day", "accepted_events"])
def test_sample(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel = con.execute(oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    got = sorted(repr(tuple(r)) for r in queries()[name](spark, SF).select(*cols).collect())
    assert got == want and got
