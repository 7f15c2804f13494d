import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import one, rows
from siltmark.config import HAZARD_WEIGHTS
from siltmark.functions.columns import bonferroni_z
from siltmark.operators import votes, zones


def table(spark, counts):
    data = [(z, c) for (z, c), n in counts.items() for _ in range(n)]
    return {r["zone"]: r for r in zones.zone_table(spark.createDataFrame(data, "zone string, class string")).collect()}


def test_one_cigarette_weighs_three_bottles(spark):
    r = table(spark, {("Zone A", "cigarette"): 1, ("Zone A", "bottle"): 3})["Zone A"]
    assert (r["psi"], r["band"], r["total"], r["dirty"], r["clean"], r["cleanliness"]) == (500, "Hazardous", 4, 1, 3, 75.0)


def test_bottles_can_dominate(spark):
    r = table(spark, {("Zone A", "cigarette"): 2, ("Zone A", "bottle"): 10})["Zone A"]
    assert r["psi"] == 500 and r["cigarette"] == 2 and r["bottle"] == 10


def test_one_bottle_lower_bound(spark):
    r = table(spark, {("Zone A", "bottle"): 1})["Zone A"]
    z = bonferroni_z(6)
    assert r["psi_lo"] == math.floor(500 / (1 + z * z))
    assert r["psi_hi"] == 500 and r["psi_ci"] == f"[{r['psi_lo']}-500]"


def test_scale_comes_from_the_worst_zone(spark):
    got = table(spark, {("Zone A", "can"): 100, ("Zone B", "can"): 20, ("Zone B", "lid"): 2})
    assert got["Zone A"]["psi"] == 500 and got["Zone B"]["psi"] == 100 and got["Zone B"]["band"] == "Moderate"


def test_empty_keeps_columns(spark):
    df = zones.zone_table(spark.createDataFrame([], "zone string, class string"))
    assert df.count() == 0 and df.columns[:3] == ["zone", "total", "clean"] and df.columns[-6:] == list(HAZARD_WEIGHTS)
    city = one(zones.kpis(df))
    assert city["total_items"] == 0 and city["worst_zone"] is None and city["cleanliness"] is None


def test_unknown_class_is_refused(spark):
    with pytest.raises(Exception, match="unsupported class: shoe"):
        table(spark, {("Zone A", "shoe"): 1})
    df = spark.createDataFrame([("Zone A", "shoe"), ("Zone A", "can")], "zone string, class string")
    assert rows(zones.unsupported_classes(df)) == [("shoe", 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.tuples(st.sampled_from("ABC"), st.sampled_from(sorted(HAZARD_WEIGHTS))), st.integers(1, 40), min_size=1))
def test_bounds_hold_the_index(spark, counts):
    for r in table(spark, counts).values():
        assert 0 <= r["psi_lo"] <= r["psi"] <= r["psi_hi"] <= 500
        assert r["dirty_rate_lo"] <= r["dirty"] / r["total"] + 0.001 and r["dirty"] / r["total"] <= r["dirty_rate_hi"] + 0.001
        assert r["total"] == r["clean"] + r["dirty"]


def test_city_figures(spark):
    zt = spark.createDataFrame(
        [("Zone B", 10, 5, 400, "Hazardous", 0.8), ("Zone A", 30, 30, 400, "Hazardous", None)],
        "zone string, total bigint, clean bigint, psi bigint, band string, vote_agreement double",
    )
    assert tuple(one(zones.kpis(zt))) == (87.5, "Zone A", 400, "Hazardous", 40, 2)
    assert one(zones.weighted_agreement(zt))[0] == pytest.approx(0.8)


VOTES = "item_id string, y_pred string, votes bigint"


def test_agreement(spark):
    df = spark.createDataFrame([("a", "can", 25), ("b", "can", 13), ("b", "cup", 12)], VOTES)
    assert one(votes.vote_agreement(df))[0] == pytest.approx(0.76)
    assert one(votes.vote_agreement(spark.createDataFrame([], VOTES)))[0] == 0.0
    assert one(votes.vote_agreement(spark.createDataFrame([("a", "can", 0)], VOTES)))[0] == 0.0
    with pytest.raises(Exception, match="vote counts"):
        votes.vote_agreement(spark.createDataFrame([("a", "can", -1)], VOTES)).collect()


def test_majority_tie_goes_to_the_earliest(spark):
    pred = spark.createDataFrame(
        [(0, "a", "cup"), (1, "a", "can"), (2, "a", "can"), (3, "a", "cup"), (4, "b", "lid")], "rep int, item_id string, y_pred string"
    )
    got = {r["item_id"]: (r["class"], r["agreement"]) for r in votes.majority_vote(votes.count_votes(pred)).collect()}
    assert got == {"a": ("cup", 0.5), "b": ("lid", 1.0)}
    assert {r["item_id"]: r["votes"] for r in votes.vote_map(votes.count_votes(pred)).collect()}["a"] == {"can": 2, "cup": 2}


def test_composition_of_an_empty_zone(spark):
    zt = spark.createDataFrame([("Zone A", 0, 0), ("Zone B", 3, 1)], "zone string, total bigint, can bigint")
    assert rows(zones.composition(zt, ["can"])) == [("Zone A", "can", 0, 0.0), ("Zone B", "can", 1, 33.3)]
