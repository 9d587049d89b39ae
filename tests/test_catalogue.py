import pytest

from cairn.operators import solvers as S
from cairn.plans import views as W
from cairn.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, data, same_as_sql):
    same_as_sql(QUERIES[name](spark, data), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_farthest_points_see_every_point(spark, data):
    """fps against the whole frames of the table."""
    points = W.points(spark, data).toPandas().sort_values("pt_id")
    frames = {f: (p["pt_id"].to_numpy(), S.xyz(p)) for f, p in points.groupby("frame_id")}
    far = {(r.frame_id, r.slot): r.pt_id for r in QUERIES["fps"](spark, data).collect()}
    assert far == {(f, i): ids[k] for f, (ids, p) in frames.items() for i, k in enumerate(S.farthest(p, min(6, len(p))))}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
