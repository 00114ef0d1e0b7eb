"""What is known and decided at every camera frame, against SQL that says it by as-of joins and, for the matching, by a search over all sets."""

import duckdb
import pytest

from wayline.plans.oracle import SQL
from wayline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_sql(name, columns):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]}) q").fetchall()


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x) if isinstance(x, str) else x or 0) for x in r))


@pytest.mark.parametrize("name", ["candidate_gate", "pair_scores", "optimal_assign", "frame_match", "frame_locks", "local_track_join", "hold_interval_join", "hold_spans", "recent_match", "calibration_at"])
def test_equals_sql(spark, name):
    found = QUERIES[name](spark, SF)
    got, want = in_order(found.collect()), in_order(by_sql(name, found.columns))
    assert len(got) == len(want) > 3
    floats = [i for i, (_, kind) in enumerate(found.dtypes) if kind == "double"]
    for a, b in zip(got, want, strict=True):
        assert [x for i, x in enumerate(a) if i not in floats] == [x for i, x in enumerate(b) if i not in floats]
        assert [a[i] for i in floats] == pytest.approx([b[i] for i in floats], abs=2e-6)


def test_decision_query_is_the_assigners(spark):
    assigned = {r["det_id"]: (r["gid"], r["source"]) for r in QUERIES["assign_identities"](spark, SF).collect()}
    decided = {r["det_id"]: (r["gid"], r["source"]) for r in QUERIES["frame_decision"](spark, SF).collect()}
    assert decided == {d: (None if s == "new" else g, s) for d, (g, s) in assigned.items()}
