import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import one, rows
from siltmark.functions import columns as fx

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_group_key(spark):
    cases = {
        "crops/can/batch_3_000123_ann45.jpg": "batch_3_000123",
        "a\\b\\x_ann1_ann2.jpg": "x_ann1",
        "plain.jpg": "plain.jpg",
        "_ann7.jpg": "",
    }
    got = frame(spark, cases).select("x", fx.group_key("x")).collect()
    assert {r[0]: r[1] for r in got} == cases


@few
@given(st.lists(st.text(alphabet="ab_/n\\0é\n", max_size=12), min_size=1, max_size=20))
def test_group_key_any_text(spark, values):
    got = [r[0] for r in frame(spark, values).select(fx.group_key("x")).collect()]
    want = [v.replace("\\", "/").split("/")[-1].rsplit("_ann", 1)[0] for v in values]
    assert got == want


def test_zones(spark):
    cases = {
        "batch_1_x.jpg": "Zone A", "batch_6_x.jpg": "Zone F", "batch_7_x.jpg": "Zone A", "batch_11_000_ann1.jpg": "Zone E",
        "batch_0_x.jpg": "Zone F", "batch_x_1.jpg": "Unassigned", "other.jpg": "Unassigned", "batch_12": "Zone F", "batch_3.jpg": "Unassigned", "": "Unassigned",
    }
    got = frame(spark, cases).select("x", fx.zone_from_batch("x")).collect()
    assert {r[0]: r[1] for r in got} == cases
    assert one(frame(spark, ["data/Zone Pier/can/a.jpg"]).select(fx.zone_from_folder("x")))[0] == "Zone Pier"
    assert one(frame(spark, ["data/Pier/can/a.jpg"]).select(fx.zone_from_folder("x")))[0] == "Unassigned"
    assert one(frame(spark, ["a.jpg"]).select(fx.zone_from_folder("x")))[0] == "Unassigned"


@few
@given(st.lists(st.integers(min_value=0, max_value=10**45), min_size=1, max_size=20))
def test_zone_of_numbers_of_any_length(spark, numbers):
    names = [f"batch_{n}_a.jpg" for n in numbers]
    got = [r[0] for r in frame(spark, names).select(fx.zone_from_batch("x")).collect()]
    assert got == [f"Zone {'ABCDEF'[(n - 1) % 6]}" for n in numbers]


def _wilson(s, n, z):
    if n == 0:
        return 0.0, 1.0
    p, d = s / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return max(0.0, (mid - half) / d), min(1.0, (mid + half) / d)


@few
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 500)), min_size=1, max_size=30))
def test_wilson(spark, pairs):
    pairs = [(min(p), max(p)) for p in pairs] + [(8, 10), (0, 5), (5, 5), (0, 0)]
    low, high = fx.wilson("s", "n")
    got = spark.createDataFrame(pairs, "s bigint, n bigint").select(low.alias("l"), high.alias("h")).collect()
    for (s, n), r in zip(pairs, got):
        assert all(abs(a - b) < 1e-12 for a, b in zip(r, _wilson(s, n, 1.96)))
        assert 0 <= r[0] <= r[1] <= 1


def test_wilson_refuses_impossible_counts(spark):
    import pytest

    low, _ = fx.wilson("s", "n")
    with pytest.raises(Exception, match="successes"):
        spark.createDataFrame([(3, 0)], "s bigint, n bigint").select(low).collect()
    with pytest.raises(ValueError):
        fx.wilson("s", "n", 0.0)


def test_paths(spark):
    unsafe = ["", "/abs", "\\abs", "C:\\x", "c:x", "../x", "a/../b", "a\\..\\b"]
    safe = ["a.jpg", "batch_1/a.jpg", "..a/b", "a.b/c"]
    got = frame(spark, unsafe + safe).select(fx.is_unsafe_path("x")).collect()
    assert [r[0] for r in got] == [True] * len(unsafe) + [False] * len(safe)
    bad = ["", "a//b", "a/./b", "a/b.", "a /b", "a\x01b", "a?b", "CON", "x/nul.txt", "lpt1", "a:b"]
    good = ["a/b.jpg", "console", "com10/a", "a\\b"]
    got = frame(spark, bad + good).select(fx.is_nonportable_path("x")).collect()
    assert [r[0] for r in got] == [True] * len(bad) + [False] * len(good)


def test_urls(spark):
    cases = {
        "": "empty", "no-scheme/x": None, "http://staticflickr.com/x": "scheme", "https://u@staticflickr.com/x": "userinfo",
        "https://evil.com\\@staticflickr.com/x": "userinfo", "https://staticflickr.com\\x": "backslash",
        "https://farm1.staticflickr.com/x": None, "https://staticflickr.com": None, "https://notstaticflickr.com/": "host",
        "HTTPS://FARM.STATICFLICKR.COM:443/x": None,
    }
    got = frame(spark, cases).select("x", fx.url_problem("x", ("staticflickr.com",))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_identifiers_collide_across_types(spark):
    df = spark.createDataFrame([(0, 0.0, "0", 1.5)], "i bigint, f double, s string, g double")
    assert tuple(one(df.select(*[fx.canonical_id(c) for c in "ifsg"]))) == ("0", "0", "0", "1.5")


def test_names_and_text(spark):
    df = spark.createDataFrame([("batch_1\\sub/a.jpg.jpg", 7)], "f string, i bigint")
    assert one(df.select(fx.crop_name("f", "i")))[0] == "batch_1_sub_a_ann7.jpg"
    labels = frame(spark, ["D_qubo", "Z_full"]).select(fx.arm_label("x", 50, 12), fx.arm_label("x", 50))
    assert rows(labels) == [("Full-50", "Full-50"), ("QUBO-12", "QUBO")]
    sizes = frame(spark, [2048, 3 * 1024 * 1024], "bigint").select(fx.size_text("x"))
    assert rows(sizes) == [("2.0 kB",), ("3.0 MB",)]
    back = spark.createDataFrame([([3, 1],)], "a array<int>").select(fx.split_indices(fx.join_indices("a")))
    assert one(back)[0] == [3, 1]


def test_bands_tolerance_and_time(spark):
    got = frame(spark, [0, 50, 51, 100, 200, 300, 301, 500], "bigint").select(fx.band_of("x")).collect()
    assert [r[0] for r in got] == ["Good", "Good", "Moderate", "Moderate", "Unhealthy", "Very Unhealthy", "Hazardous", "Hazardous"]
    got = frame(spark, [0.02, 0.0, None], "double").select(fx.tolerance("x", 1.5)).collect()
    assert [round(r[0], 9) for r in got] == [0.03, 0.015, 0.0]
    got = frame(spark, ["2024-01-01T00:00:00", "2024-01-01T02:00:00+02:00", "later", None]).select(F.unix_seconds(fx.iso_timestamp("x"))).collect()
    assert [r[0] for r in got] == [1704067200, 1704067200, None, None]
    assert round(fx.bonferroni_z(6), 6) == 2.638257


def test_finite(spark):
    got = frame(spark, [1.0, float("nan"), float("inf"), None], "double").select(fx.is_finite("x")).collect()
    assert [r[0] for r in got] == [True, False, False, False]
