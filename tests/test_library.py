"""Operators outside the llm subpackage: hand-worked answers, invariants, and their queries against SQL."""

import pytest
from pyspark.sql import functions as F

from tramline import plans
from tramline.functions import clock, curves, geo
from tramline.operators import congestion, roads, scenario, spatial, timetable
from tramline.operators.components import components
from tramline.sources import documents, feeds, registry
from tramline.streaming.vehicles import Governor, newer_stream, run_to_folder, snapshot_stream


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_queries_equal_their_sql(name, same):
    same(plans.QUERIES[name], plans.SQL[name])


def test_every_query_is_named_once_and_most_have_sql():
    assert set(plans.SQL) == set(plans.QUERIES) and len(plans.SQL) > 150


def test_service_levels_by_hand(spark):
    # East every 10 minutes, west every 20, over 07:00-10:00.
    rows = [("M", 2, 420.0 + 10 * i) for i in range(18)] + [("M", 6, 425.0 + 20 * i) for i in range(9)]
    dep = spark.createDataFrame(rows, "stop string, direction int, minute double")
    got = {r.direction: r for r in timetable.service_levels(dep, ["stop", "direction"], periods={"AM": (420.0, 600.0)}).collect()}
    assert got[2].departures_per_hour == 6 and got[6].departures_per_hour == 3 and got[6].max_headway_min == 20
    c = timetable.cluster_service(dep, ["stop"], "direction", periods={"AM": (420.0, 600.0)}).first()
    assert c.sides == 2 and c.dph_one_way == 4.5
    h = timetable.headline(timetable.cluster_service(dep, ["stop"], "direction"), ["stop"], ["AM", "IP"]).first()
    assert h.dph_one_way == 0  # the middle of the day has none


def test_midnight_rolls_once_a_drop(spark):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate([1430.0, 1438.0, 5.0, 20.0])], "t string, i int, v double")
    assert [r.r for r in timetable.roll_midnight(df, ["t"], "i", "v", "r").orderBy("i").collect()] == [1430, 1438, 1445, 1460]


def test_clock_and_curves(spark):
    one = spark.range(1)
    t = one.select(clock.minutes(F.lit("25:01:30")).alias("m"), clock.hhmmss(F.lit(1501.5)).alias("h"), curves.interpolate(F.lit(30.0), [(0, 0), (10, 10), (20, 15)]).alias("i"), curves.road_speed_kmh(F.lit("30 mph;60")).alias("v")).first()
    assert t.m == 1501.5 and t.h == "25:01:30" and t.i == 20 and t.v == pytest.approx(48.28032)
    assert clock.departures([("AM", 420, 450)], {"AM": 10}, 0.5) == [425.0, 435.0, 445.0]
    w = clock.period_windows({"AM": (420, 600)}, (1380, 1860 + 600))
    assert w[0] == ("OP", 1380, 1860) and w[1][0] == "AM"
    a, b = curves.fit_logistic(400.0, 700.0)
    import numpy as np

    x = np.linspace(0, 6000, 600_001)
    s = (1 + np.exp(-a / b)) / (1 + np.exp((x - a) / b))
    assert np.trapezoid(s, x) == pytest.approx(400, rel=1e-3) and np.interp(700, x, s) == pytest.approx(0.15, rel=1e-3)


def test_places(spark):
    one = spark.range(1)
    e, n = geo.british_grid(F.lit(-0.1278), F.lit(51.5074))
    r = one.select(e.alias("e"), n.alias("n"), geo.octant(geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("o"), geo.grid_square(F.lit(530_000.0), F.lit(180_000.0)).alias("g")).first()
    assert abs(r.e - 530_034) < 15 and abs(r.n - 180_381) < 15 and r.o == 2 and r.g == "TQ38"


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(200)} == {1000} and got[5000] == 5000


def test_access_classes_by_hand(spark):
    cat = spatial.stop_category
    r = spark.range(1).select(cat(F.lit(4.0)).alias("a"), cat(F.lit(61.0)).alias("b"), spatial.access_class(F.lit(2), F.lit(240.0)).alias("c"), spatial.access_class(F.lit(2), F.lit(400.0)).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (1, None, "A", "B")


def test_legal_copies_admit_every_legal_journey_and_no_other(spark):
    import itertools

    kinds = [(True, True), (True, False), (False, True)]
    rows, may = [], {}
    for n, flags in enumerate(itertools.product(kinds, repeat=5)):
        may[str(n)] = {i + 1: f for i, f in enumerate(flags)}
        rows += [(str(n), str(i + 1), None if on else "1", "0" if off else "1") for i, (on, off) in enumerate(flags)]
    calls = spark.createDataFrame(rows, "trip_id string, stop_sequence string, pickup_type string, drop_off_type string")
    for r in feeds.legal_copies(calls).collect():
        ok = may[r.trip_id]
        ridden = {(x, y) for c in r.copies for i, x in enumerate(c) for y in c[i + 1 :]}
        usable = {x for x in ok if (ok[x][0] if x == 1 else ok[x][1] if x == 5 else any(ok[x]))}
        assert ridden == {(x, y) for x in usable for y in usable if x < y and ok[x][0] and ok[y][1]} and r.left_out == 0
    many = [("t", str(i), "0" if i <= 7 or i == 20 else "1", "1" if 1 < i <= 7 else "0") for i in (*range(1, 8), *range(8, 15), 20)]
    out, left = feeds.split_restricted(spark.createDataFrame(many + [("p", "1", None, None), ("p", "2", None, None)], calls.schema))
    assert [tuple(r) for r in left.collect()] == [("t", 42)]
    names = {r.trip_id for r in out.collect()}
    assert "p" in names and len(names) == 1 + 1 + 6 + 7 and {r.source_trip for r in out.collect()} == {"p", "t"}


FEED = {
    "stops": [("a", "A", "51.0", "-2.0"), ("b", "B", "51.01", "-2.0"), ("z", "Z", "0", "0")], "routes": [("r", "x", "3"), ("q", "x", "3")], "trips": [("r", "s", "t1"), ("q", "s2", "t2")],
    "stop_times": [("t1", "07:00:00", "a", "1", None), ("t1", "07:10:00", "b", "2", "1")], "agency": [("x", "Co")],
}
HEAD = {"stops": "stop_id stop_name stop_lat stop_lon", "routes": "route_id agency_id route_type", "trips": "route_id service_id trip_id", "stop_times": "trip_id departure_time stop_id stop_sequence pickup_type", "agency": "agency_id agency_name"}


def test_feeds_go_out_and_come_back(spark, tmp_path):
    made = feeds.Feed({k: spark.createDataFrame(v, ", ".join(f"{c} string" for c in HEAD[k].split())) for k, v in FEED.items()})
    for n in ("x.zip", "y.zip"):
        feeds.write_feed(made, str(tmp_path / n))
    assert (tmp_path / "x.zip").read_bytes() == (tmp_path / "y.zip").read_bytes()
    back = feeds.read_feed(spark, str(tmp_path / "x.zip"))
    assert back["calendar"].count() == 0 and feeds.same_feed(made, feeds.Feed({k: back[k] for k in FEED}))
    day = feeds.single_day(back, back["trips"].filter("trip_id = 't1'"), back["stop_times"], "20240612")
    assert [r.stop_id for r in day["stops"].orderBy("stop_id").collect()] == ["a", "b"] and day["routes"].count() == 1
    with pytest.raises(ValueError):
        feeds.trips_on_date({"f": back}, "20240612")


SNAPSHOT = """<S xmlns="urn:x"><ResponseTimestamp>2024-01-01T10:0{m}:00+00:00</ResponseTimestamp>{body}</S>"""
ACTIVITY = """<VehicleActivity><RecordedAtTime>2024-01-01T{t}+00:00</RecordedAtTime><MonitoredVehicleJourney><OperatorRef>o</OperatorRef><VehicleRef>{v}</VehicleRef><VehicleLocation><Longitude>-2.0</Longitude><Latitude>51.0</Latitude></VehicleLocation></MonitoredVehicleJourney></VehicleActivity>"""


def test_vehicle_stream_keeps_newer_rows_across_restarts(spark, tmp_path):
    land, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    land.mkdir()

    def put(m, *acts):
        (land / f"{m}.xml").write_text(SNAPSHOT.format(m=m, body="".join(ACTIVITY.format(t=t, v=v) for t, v in acts)))

    def run():
        q = run_to_folder(newer_stream(snapshot_stream(spark, str(land))), str(out), str(ck))
        q.awaitTermination(120)

    put(1, ("10:00:30", "v1"), ("10:00:40", "v2"))
    run()
    put(2, ("10:00:30", "v1"), ("10:00:50", "v2"))  # v1 is repeated; v2 is newer, but recorded before the last response
    run()
    got = sorted((r.vehicle_ref, str(r.recorded_at)[11:], r.stale) for r in spark.read.parquet(str(out)).collect())
    # The first snapshot was sent at 10:01 and held to follow one of 10:00:50, so what it has is stale; the second follows 10:01.
    assert got == [("v1", "10:00:30", True), ("v2", "10:00:40", True), ("v2", "10:00:50", True)]
    put(4, ("10:03:30", "v3"), ("10:01:59", "v2"))  # no vehicle of it was in the second, sent at 10:02
    run()
    late = {(r.vehicle_ref, str(r.recorded_at)[11:], r.stale) for r in spark.read.parquet(str(out)).filter("recorded_at > '2024-01-01 10:01:00'").collect()}
    assert late == {("v3", "10:03:30", False), ("v2", "10:01:59", True)}


def test_timetable_points_and_calls(spark, tmp_path):
    xml = """<P><Journey rid="1" ssd="2024-01-01" toc="X"><OR tpl="A" wtd="23:50" ptd="23:50"/><PP tpl="J" wtp="23:58:30"/><IP tpl="B" wta="00:05" wtd="00:06" pta="00:05" ptd="00:06"/><DT tpl="C" wta="00:20" pta="00:20"/></Journey>
    <Journey rid="2" can="true"><OR tpl="A" wtd="10:00" ptd="10:00"/><DT tpl="B" wta="10:10" pta="10:10"/></Journey></P>"""
    (tmp_path / "t.xml").write_text(xml)
    pts = documents.read_timing_points(spark, str(tmp_path / "t.xml"))
    got = {(r.rid, r.tpl): r for r in pts.collect()}
    assert got["1", "B"].arr_s == 86_400 + 300 and got["1", "C"].pta_min == 1460 and got["2", "A"].exclusion == "cancelled_journey" and got["1", "J"].dep_s == 23 * 3600 + 58 * 60 + 30
    places = spark.createDataFrame([("A", "AAA", 0.0, 0.0), ("B", "BBB", 0.1, 0.1), ("C", "CCC", 9.0, 9.0)], "tpl string, crs string, lon double, lat double")
    calls, why = documents.passenger_calls(pts, places, (-1, -1, 1, 1))
    assert {r.tpl for r in calls.collect()} == {"A", "B"} and {r.reason: r.journeys for r in why.collect()} == {"kept": 1, "cancelled_journey": 1}


def test_registry(spark):
    reg = spark.createDataFrame([("a", "20240101", "20240201", "h1"), ("b", "20240101", "20241231", "h2")], "feed string, valid_from string, valid_to string, sha256 string")
    new = registry.upsert(reg, reg.filter("feed = 'a'").withColumn("sha256", F.lit("h9")), "feed")
    assert new.count() == 2 and [r.feed for r in registry.uncovered(new, "20240601").collect()] == ["a"] and [r.feed for r in registry.drifted(new, reg, "feed").collect()] == ["a"]
    assert registry.network_version("bus", ["b", "a"]) == registry.network_version("bus", ["a", "b"])


def test_governor_halts_and_slows():
    g = Governor(batch=3, in_a_row=4)
    for i, ms in enumerate([1, 1, 1, 3, 3, 3]):
        g.tell(float(i), False, float(ms))
    assert g.interval == 2.0 and not g.halted
    for i in range(4):
        g.tell(10.0 + i, True)
    assert g.halted == "failures in a row" and g.wait(3, retry_after=30) == 30


CAT = scenario.Catalogue.of({"R": ["a", "b", "c"]}, {"a": (0.0, 51.0), "b": (0.01, 51.0), "c": (0.02, 51.0)}, {("P", "Q")})
LINE = {"route_id": "N", "name": "n", "mode": "tram", "alignment": [{"type": "at_grade_street", "line": [[0.0, 51.0], [0.02, 51.0]]}], "stops": [{"stop_id": "a", "lon": 0.0, "lat": 51.0, "existing": True}, {"stop_id": "n", "lon": 0.01, "lat": 51.0001}], "headways_min": {"AM": 15}, "span": "07:00-10:00", "speed_profile": {"max_kmh": 50, "accel_ms2": 1.0, "dwell_s": 20}}


@pytest.mark.parametrize("rule, op", [
    ("op", {"fly": {}}), ("op", {"works": 3}), ("mode", {"add_line": LINE | {"mode": "ferry"}}), ("fare", {"fare_change": {"modes": ["bus"], "type": "per_km", "gbp": 1}}), ("alignment-type", {"add_line": LINE | {"alignment": [{"type": "street", "line": [[0.0, 51.0], [0.02, 51.0]]}]}}), ("truncate", {"modify_route": {"route_id": "R", "truncate_at": {"stop": "a", "tiploc": "Z", "keep": "before"}}}), ("required-field", {"modify_route": {"route_id": "R", "truncate_at": {"stop": "a", "keep": "before"}}}), ("route-ids", {"modify_route": {"route_ids": ["R"], "fill_span": "07:00-09:00"}}), ("works-complexity", {"works": {"name": "w", "electrify": [{"sections": ["P-Q"], "tracks": 1, "length_km": 1, "complexity": "medium"}]}}), ("existing-rail-section", {"add_line": LINE | {"alignment": [{"type": "existing_rail", "line": [[0.0, 51.0], [0.02, 51.0]]}]}}), ("unknown-route", {"remove_route": {"route_id": "X"}}), ("empty-op", {"modify_route": {"route_id": "R"}}), ("headway", {"modify_route": {"route_id": "R", "headways_min": {"AM": True}}}),
    ("headway", {"modify_route": {"route_id": "R", "headways_min": {"XX": 5}}}), ("span", {"modify_route": {"route_id": "R", "fill_span": "25:00-26:00"}}), ("stop-not-on-route", {"modify_route": {"route_id": "R", "truncate_at": {"stop": "q", "tiploc": "P", "keep": "before"}}}),
    ("duplicate-route", {"add_line": LINE | {"route_id": "R"}}), ("mode", {"add_line": LINE | {"mode": "zeppelin"}}), ("required-field", {"add_line": {k: v for k, v in LINE.items() if k != "speed_profile"}}), ("unknown-key", {"add_line": LINE | {"colour": 1}}),
    ("stop-off-alignment", {"add_line": LINE | {"stops": [LINE["stops"][0], {"stop_id": "n", "lon": 0.01, "lat": 51.01}]}}), ("stop-id", {"add_line": LINE | {"stops": [LINE["stops"][0] | {"existing": False}, LINE["stops"][1]]}}),
    ("works-section", {"works": {"name": "w", "track": [{"sections": ["P-X"], "was": 1, "tracks": 2, "length_km": 1}]}}), ("works-tracks", {"works": {"name": "w", "track": [{"sections": ["P-Q"], "was": 2, "tracks": 2, "length_km": 1}]}}), ("fare", {"fare_change": {"modes": ["bus"], "type": "flat", "gbp": -1}}),
])
def test_rules_reject(rule, op):
    with pytest.raises(scenario.ScenarioError) as e:
        scenario.load({"id": "S1", "parent": "B0", "description": "d", "ops": [op]}, CAT)
    assert e.value.rule == rule


def test_scenarios_chain_and_apply(spark):
    docs = {"B0": {"id": "B0", "parent": None, "description": "d"}, "A1": {"id": "A1", "parent": "B0", "description": "d", "ops": [{"add_line": LINE}]}, "B1": {"id": "B1", "parent": "A1", "description": "d", "ops": [{"remove_route": {"route_id": "N"}}]}, "L1": {"id": "L1", "parent": "L2", "description": "d", "ops": []}, "L2": {"id": "L2", "parent": "L1", "description": "d", "ops": []}}
    chain = scenario.load_chain(docs, "B1", CAT)
    assert [s.id for s in chain] == ["B0", "A1", "B1"]
    with pytest.raises(scenario.ScenarioError) as e:
        scenario.load_chain(docs, "L1", CAT)
    assert e.value.rule == "parent-loop"
    rows = [("R", f"t{d}{i}", f"t{d}{i}", s + 1, x, 420.0 + 15 * i + 5 * s, 420.0 + 15 * i + 5 * s) for d in (0, 1) for i in range(12) for s, x in enumerate("abc" if d == 0 else "cba")]
    net = scenario.Network(spark.createDataFrame(rows, "route string, trip string, journey string, seq int, stop string, arr double, dep double"), {"AM": (420.0, 600.0), "IP": (600.0, 960.0)})
    times = lambda n: sorted((r.stop, r.dep) for r in n.calls.filter("route = 'R'").collect())
    same, _ = scenario.apply(net, [("modify_route", {"route_id": "R", "headways_min": {"AM": 15}})])
    assert times(same) == times(net)  # the same headway changes nothing
    half, _ = scenario.apply(net, [("modify_route", {"route_id": "R", "headways_min": {"AM": 30}})])
    assert half.calls.select("trip").distinct().count() == 12
    added, report = scenario.apply(net, chain[1].ops + chain[2].ops)
    assert times(added) == times(net) and added.calls.count() == net.calls.count() and [r["op"] for r in report] == ["add_line", "remove_route"]
    cut, _ = scenario.apply(net, [("modify_route", {"route_id": "R", "truncate_at": {"stop": "b", "tiploc": "P", "keep": "before"}, "extend_to": {"from_stop": "b", "alignment": [], "stops": [{"stop_id": "b", "lon": 0.01, "lat": 51.0}, {"stop_id": "n", "lon": 0.01, "lat": 51.01}], "speed_profile": {"max_kmh": 60, "accel_ms2": 1.0, "dwell_s": 20}}})])
    assert {r.stop for r in cut.calls.collect()} >= {"n"}


def test_a_replacement_keeps_the_phase_that_its_headway_divides(spark):
    """Old: every 30 minutes from a at :07, nothing from the other end. New: every 15."""
    rows = [("Q", f"q{i}", f"q{i}", s + 1, x, 427.0 + 30 * i + 9 * s, 427.0 + 30 * i + 9 * s) for i in range(6) for s, x in enumerate("an")]
    net = scenario.Network(spark.createDataFrame(rows, "route string, trip string, journey string, seq int, stop string, arr double, dep double"), {"AM": (420.0, 600.0), "IP": (600.0, 960.0)})
    op = {k: v for k, v in LINE.items() if k != "name"} | {"route_id": "Q", "new_route_id": "Q2", "headways_min": {"AM": 15}}
    for offset in (0.0, 1 / 3):
        out, _ = scenario.apply(net, [("replace_route", op)], offset)
        first = out.calls.filter("seq = 1").orderBy("dep").collect()
        assert [r.dep for r in first if r.stop == "a"] == [427.0 + 15 * i for i in range(12)]
        assert [r.dep for r in first if r.stop == "n"][0] == pytest.approx(420 + offset * 15)
    out, _ = scenario.apply(net, [("replace_route", op | {"headways_min": {"AM": 20}})], 0.25)
    assert [r.dep for r in out.calls.filter("seq = 1 and stop = 'a'").orderBy("dep").collect()][0] == 425.0  # 20 does not divide 30


def test_one_op_over_several_routes_is_one_each():
    cat = scenario.Catalogue.of({"R": ["a", "b"], "S": ["a", "b"]}, {k: p.at for k, p in CAT.places.items()})
    s, _ = scenario.load({"id": "S1", "parent": "B0", "description": "d", "ops": [{"modify_route": {"route_ids": ["R", "S"], "headways_min": {"AM": 10}}}]}, cat)
    assert [(k, b["route_id"]) for k, b in s.ops] == [("modify_route", "R"), ("modify_route", "S")]
    for doc, rule in (({"id": "S1", "description": "d"}, "required-field"), ({"id": "S1", "parent": None, "description": "d", "ops": [{"works": {}}]}, "parent"), ({"id": "s", "parent": None, "description": "d"}, "id")):
        with pytest.raises(scenario.ScenarioError) as e:
            scenario.load(doc, cat)
        assert e.value.rule == rule


def test_track_paths_take_the_shortest_choice_of_nodes():
    from tramline.operators.paths import track_path

    # Two parallel tracks a few metres apart; only the second goes through to the end.
    nodes = {1: (0.0, 51.0), 2: (0.01, 51.0), 3: (0.0, 51.0001), 4: (0.01, 51.0001), 5: (0.02, 51.0001)}
    tracks = [{"u": 1, "v": 2, "m": 700.0, "kind": "rail", "kmh": 60}, {"u": 3, "v": 4, "m": 710.0, "kind": "rail", "kmh": 100}, {"u": 4, "v": 5, "m": 690.0, "kind": "disused", "kmh": None}]
    got = track_path(nodes, tracks, [(0.0, 51.0), (0.01, 51.0), (0.02, 51.0)], 100.0)
    assert got["nodes"] == [3, 4, 5] and got["length_m"] == 1400 and got["kinds_m"] == {"rail": 710.0, "disused": 690.0}
    assert got["maxspeed_tagged_m"] == 710 and got["maxspeed_kmh"] == pytest.approx(100) and all(5 < x < 15 for x in got["snap_m"])
    with pytest.raises(ValueError):
        track_path(nodes, tracks, [(1.0, 51.0), (0.0, 51.0)], 100.0)


def test_tables_as_files(spark, tmp_path):
    from tramline.sources import tables

    (tmp_path / "c.csv").write_text('"Area of residence","All, of them"\nE1,3\nE2,4\n')
    got = tables.read_csv(spark, str(tmp_path / "c.csv"))
    assert got.columns == ["Area of residence", "All, of them"] and dict(got.dtypes)["All, of them"] == "int" and got.count() == 2
    (tmp_path / "p.csv").write_text("ATCOCode,CommonName,Longitude,Latitude,Status\n9100ABC,Abc,-2.5,51.4,Active\n0100X,Bus,-2.5,51.4,active\n9100DEF,Def,,51.4,active\n")
    assert [tuple(r) for r in tables.read_places(spark, str(tmp_path / "p.csv")).collect()] == [("ABC", -2.5, 51.4, "Abc", "active")]
    spark.range(3).write.parquet(str(tmp_path / "their.parquet"))
    theirs = tables.Attached(spark, str(tmp_path), {"adjusted"})
    assert theirs.table("their").count() == 3
    for bad in (lambda: theirs.table("adjusted"), theirs.write):
        with pytest.raises(PermissionError):
            bad()
    tables.write_report(spark.range(2), str(tmp_path / "r"), header=False)
    assert sorted(next((tmp_path / "r").glob("*.csv")).read_text().split()) == ["0", "1"]


def test_run_records_and_the_command_line(tmp_path, capsys):
    import json

    from tramline import record
    from tramline.__main__ import main

    made = record.finish(record.begin("q", {"folder": "x"}), ["out"], str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == made and made["run_id"].startswith("q-")
    with pytest.raises(ValueError):
        record.check({"query": "q"})
    assert main(["queries"]) == 0 and "stop_service" in capsys.readouterr().out
    assert main(["sql", "mode_class"]) == 0 and "select" in capsys.readouterr().out
    cat = {"routes": {"R": ["a"]}, "stops": {"a": [0.0, 51.0]}, "sections": [["P", "Q"]]}
    (tmp_path / "c.json").write_text(json.dumps(cat))
    for op, code in (({"remove_route": {"route_id": "R"}}, 0), ({"remove_route": {"route_id": "X"}}, 1)):
        (tmp_path / "s.json").write_text(json.dumps({"id": "S1", "parent": "B0", "description": "d", "ops": [op]}))
        assert main(["validate", str(tmp_path / "s.json"), str(tmp_path / "c.json")]) == code


def test_what_must_not_be_raises(spark):
    from tramline.operators import calibration, demand, rail, relational, skims

    one = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="repeats"):
        relational.join_one_to_one(one, one.groupBy("k").agg(F.max("v").alias("w")), ["k"]).collect()
    with pytest.raises(Exception, match="take tracks away"):
        rail.works_on_track(spark.createDataFrame([("a", "b", 2)], "from string, to string, tracks int"), spark.createDataFrame([(1, "b", "a", 1)], "number int, from string, to string, tracks int")).collect()
    with pytest.raises(Exception, match="no mode class"):
        spark.range(1).select(timetable.mode_class(F.lit("6000"), F.lit(False))).collect()
    flows, known = spark.createDataFrame([("a", 90.0), ("b", 10.0)], "station string, j double"), spark.createDataFrame([("a",)], "station string")
    assert demand.unlocated_share(flows, known, 0.2).first().share == 0.1
    with pytest.raises(Exception, match="too many journeys"):
        demand.unlocated_share(flows, known).collect()
    with pytest.raises(ValueError):
        calibration.plate_observations(flows, stamp="middle")
    assert skims.offset_pairs([1, 2], [3]) == [(3, 1), (3, 2)] and skims.offset_pairs([1, 2], [3, 4]) == [(3, 1), (4, 2)]
    with pytest.raises(ValueError):
        skims.offset_pairs([1, 2, 3], [4, 5])


def test_parameters(spark, tmp_path):
    from tramline.params import Params

    (tmp_path / "p.json").write_text('{"a": {"b": {"value": 3, "tag": "sourced", "unit": "min"}, "c": {"value": null, "tag": "placeholder"}}}')
    p = Params(str(tmp_path / "p.json"))
    assert p["a.b"] == 3 and p.placeholders() == ["a.c"] and [tuple(r) for r in p.table(spark).collect()] == [("a.b", "3", "sourced", "min"), ("a.c", "null", "placeholder", None)]
    (tmp_path / "q.json").write_text('{"a": 3}')
    with pytest.raises(ValueError):
        Params(str(tmp_path / "q.json"))


def test_unnamed_roads_have_no_class(spark):
    edges = spark.createDataFrame([("A1", 1, 2, 10.0), ("A1", 2, 3, 5.0), (None, 7, 8, 1.0)], "ref string, u long, v long, length_m double")
    seeds = spark.createDataFrame([("A1", 1, "x"), ("A1", 3, "y"), (None, 7, "z")], "ref string, node long, cls string")
    got = {(r.ref, r.node): (r.dist_m, r.cls) for r in roads.propagate_class(edges, seeds).collect()}
    assert got == {("A1", 1): (0.0, "x"), ("A1", 2): (5.0, "y"), ("A1", 3): (0.0, "y"), (None, 7): (None, None), (None, 8): (None, None)}
