"""What a study takes in, and what schemes are made of: hand-worked answers."""

import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import curves
from tramline.operators import costs, rail, scenario, scope


def box(x, y, w=1.0, h=1.0):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def test_zones_need_a_centroid(spark):
    z = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 0.5), (3, 1.0, 1.0)], "zone long, lon double, lat double")
    assert sorted(r.zone for r in scope.zones_inside(z, (0.0, 0.0, 1.0, 1.0)).collect()) == [1, 3]
    with pytest.raises(Exception, match="centroid"):
        scope.zones_inside(z.union(spark.createDataFrame([(4, None, 0.5)], z.schema)), (0.0, 0.0, 1.0, 1.0)).collect()


def test_centres_are_dense_zones_together(spark):
    rows = [(1, box(0, 0), 900, 1.0, True), (2, box(1, 0.5), 800, 1.0, True), (3, box(2, 1.5), 700, 1.0, True), (4, box(3, 1.5), 10, 1.0, True), (5, box(9, 9), 999, 1.0, True), (6, box(0.2, 0.2, 0.1, 0.1), 50, 0.01, True), (7, box(1, 1), 5000, 1.0, False), (8, box(0, 1), None, 1.0, True)]
    z = spark.createDataFrame(rows, "zone long, ring array<struct<lon:double,lat:double>>, jobs long, km2 double, urban boolean")
    assert sorted(map(tuple, scope.central_zones(z, 500, 3).collect())) == [(1, 1), (2, 1), (3, 1), (6, 1)]
    assert scope.central_zones(z, 500, 5).count() == 0


def test_built_up_areas_reach_over_others(spark):
    areas = spark.createDataFrame([(10, box(0, 0)), (11, box(1, 0)), (12, box(2, 0.5)), (13, box(6, 0))], "id long, ring array<struct<lon:double,lat:double>>")
    zones = [(1, "core", "urban", 9.0, 9.0), (2, "core", "rural", 0.5, 0.5), (3, "near", "urban", 2.5, 0.9), (4, "near", "centre", 6.5, 0.5), (5, "near", "rural", 0.5, 0.5), (6, "far", "urban", 0.5, 0.5)]
    z = spark.createDataFrame(zones, "zone long, district string, area_type string, lon double, lat double")
    assert {r.zone: r.in_scope for r in scope.built_up_scope(areas, z, 10, "core", ["near"]).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    with pytest.raises(Exception, match="seed"):
        scope.built_up_scope(areas, z, 99, "core", ["near"]).collect()


def test_sites_on_main_carriageways(spark):
    rows = [
        ("1", "M5/8291A", "MIDAS site at M5/8291A priority 1 on link 1; GPS Ref: 1;2; Northbound", "Active", -2.6), ("2", "5261/1", "TMU Site 5261/1 on M5 J21 northbound exit; GPS Ref: 1;2; Northbound", "Active", -2.6), ("3", "5284/2", "TMU Site 5284/2 on link A38(M) eastbound between J22 and J21; GPS Ref: 1;2; Eastbound", "Active", -2.6),
        ("4", "x", "TMU Site x on M4; Carriageway Connector", "Active", -2.6), ("5", "M4/1", "MIDAS site; Westbound", "Inactive", -2.6), ("6", "M4/1", "MIDAS site; Westbound", "Active", 9.0), ("7", "y", None, "Active", -2.6), ("8", "z", "TMU on the M4 between a and b; Southbound", "Active", -2.6),
    ]
    s = spark.createDataFrame(rows, "site string, name string, description string, status string, lon double").withColumn("lat", F.lit(51.5))
    got = scope.sensor_sites(s, (-3.0, 51.0, -2.0, 52.0)).collect()
    assert sorted((r.site, r.road, r.kind, r.bearing) for r in got) == [("1", "M5", "midas", 0), ("3", "A38(M)", "tmu", 90)]


def test_delays_fall_back_by_period_and_area(spark):
    seg = spark.createDataFrame([(1, 10, "centre"), (2, 10, "buffer"), (3, 11, "centre"), (4, 10, "urban")], "id int, v long, area_type string")
    late = spark.createDataFrame([("IP", "centre", 20.0), ("IP", "urban", 9.0), ("AM", "rural", 4.0)], "period string, area string, delay_s double")
    got = {(r.id, r.period): r.delay_s for r in scope.signal_delays(seg, spark.createDataFrame([(10,)], "node long"), late, ["AM", "IP", "PM"]).collect()}
    assert got == {(1, "AM"): 0.0, (2, "AM"): 4.0, (4, "AM"): 0.0, (1, "IP"): 20.0, (2, "IP"): 9.0, (4, "IP"): 9.0, (1, "PM"): 20.0, (2, "PM"): 9.0, (4, "PM"): 9.0, (3, "AM"): 0.0, (3, "IP"): 0.0, (3, "PM"): 0.0}


def test_price_years_need_an_index(spark):
    index = spark.createDataFrame([(2015, 1.0), (2020, 1.2), (2023, 1.5)], "year int, value double")
    deflator = spark.createDataFrame([(2013, 100.0), (2015, 110.0)], "year int, value double")
    lines = spark.createDataFrame([("a", 2020), ("b", 2013), ("c", None)], "item string, year int")
    got = {r.item: r.factor for r in costs.rebased(lines, index, deflator, 2023, 0.02).collect()}
    assert got["a"] == pytest.approx(1.25) and got["b"] == pytest.approx(1.1 * 1.02**2 * 1.5) and got["c"] is None
    for year, to in ((2011, 2023), (2020, 2022)):
        with pytest.raises(Exception, match="no index"):
            costs.rebased(spark.createDataFrame([("a", year)], "item string, year int"), index, deflator, to).collect()


def test_copies_that_can_not_be_raise(spark):
    points = spark.createDataFrame([("j", i, p, 3000.0 + 60 * i) for i, p in enumerate("abcb")], "rid string, seq int, tpl string, dep_s double")
    use = lambda *rows: {(r["from"], r.to, r.hour): r.trains for r in costs.copied_use(points, spark.createDataFrame(rows, "journey string, shift_s int, trim_at string, keep string"), "rid", "seq", "tpl", "dep_s").collect()}
    assert use(("j", 3600, None, None), ("j", 0, "b", "before"), ("j", 0, "b", "after")) == {("a", "b", 1): 1, ("b", "c", 1): 1, ("c", "b", 1): 1, ("a", "b", 0): 1, ("b", "c", 0): 1, ("c", "b", 0): 1}
    for row, why in ((("k", 0, None, None), "not there"), (("j", 0, "z", "before"), "does not pass")):
        with pytest.raises(Exception, match=why):
            use(row)


def test_works_of_no_known_kind_raise(spark):
    w = "works string, kind string, complexity string, was int, tracks int, length_km double, n int"
    rows = [("w", "electrify", "simple", None, 2, 6.0, None), ("w", "track", None, 1, 2, 2.5, None), ("w", "loops", None, None, None, None, None), ("w", "platforms", None, None, None, None, 2), ("w", "loops", None, None, None, None, None)]
    got = {r["item"]: r.qty for r in rail.works_lines(spark.createDataFrame(rows, w)).collect()}
    assert got == {"electrification_simple": 12, "track_doubling": 2.5, "passing_loop": 2, "bay_platform": 2}
    with pytest.raises(Exception, match="no such kind"):
        rail.works_lines(spark.createDataFrame([("w", "paint", None, None, None, None, None)], w)).collect()


def test_lines_run_both_ways(spark):
    stops = spark.createDataFrame([("n", 0, "a", 4.0, 30.0), ("n", 1, "b", 6.0, 30.0), ("n", 2, "c", None, 30.0)], "line string, seq int, stop string, run_min double, dwell_s double")
    got = {(r.dir, r.seq): (r.stop, r.a, r.b) for r in scenario.stop_offsets(stops).collect()}
    assert got == {(0, 1): ("a", 0.0, 0.0), (0, 2): ("b", 4.0, 4.5), (0, 3): ("c", 10.5, 10.5), (1, 1): ("c", 0.0, 0.0), (1, 2): ("b", 6.0, 6.5), (1, 3): ("a", 10.5, 10.5)}
    slots = spark.createDataFrame([("n", 0, 420.0, 450.0, 15.0, 5.0), ("n", 0, 450.0, 480.0, 30.0, 0.0), ("n", 1, 420.0, 421.0, 60.0, 10.0)], "line string, dir int, lo double, hi double, headway double, phase double")
    assert sorted((r.dir, r.n, r.start) for r in scenario.departures(slots).collect()) == [(0, 0, 425.0), (0, 1, 440.0), (0, 2, 450.0)]
    assert scenario.timetable_of(stops, slots).filter("trip = 'n:0:1' and stop = 'b'").first().arr == 444.0


def test_curves_between_modes(spark):
    rows = [("bus", float(x)) for x in range(100, 700, 7)] + [("rail", float(x)) for x in range(200, 1500, 9)] + [("bus", None)]
    c = {r["mode"]: r for r in curves.decay_curves(spark.createDataFrame(rows, "mode string, metres double"), {"tram": 0.25}).collect()}
    assert set(c) == {"bus", "rail", "tram", "metro", "ferry"} and tuple(c["ferry"])[1:] == tuple(c["bus"])[1:] and tuple(c["metro"])[1:] == tuple(c["rail"])[1:]
    assert c["tram"].mean_m == pytest.approx(0.75 * c["bus"].mean_m + 0.25 * c["rail"].mean_m)
    for m in c.values():
        a, b = m.a_m, m.b_m
        assert (1 + math.exp(-a / b)) * b * math.log1p(math.exp(a / b)) == pytest.approx(m.mean_m, rel=1e-6)
        assert (1 + math.exp(-a / b)) / (1 + math.exp((m.p85_m - a) / b)) == pytest.approx(0.15, rel=1e-6)
    with pytest.raises(ValueError, match="rail"):
        curves.decay_curves(spark.createDataFrame([("bus", 1.0)], "mode string, metres double"), {"tram": 0.5})


def test_whole_minutes_overstate_what_is_near(spark):
    """On a field of origins spread evenly around a stop, cut times weigh more than exact ones; rounded ones are close."""
    got = {r.minutes: r for r in curves.whole_minutes(curves.ring_field(spark), 600.0, 150.0, 4.8, 400.0).collect()}
    assert got["truncated"].weight > got["exact"].weight and got["truncated"].weight_pct > 5 > abs(got["rounded"].weight_pct)
    assert got["exact"].weight_pct == 0.0 and got["truncated"].within >= got["exact"].within
