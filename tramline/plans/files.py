"""Queries through files: the tables go out as timetables, snapshots, features and feeds, and come back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import geo
from tramline.plans.registry import query
from tramline.plans.tidy import tidy
from tramline.session import shared_dir
from tramline.sources import documents, feeds

D = "cast({} as double)".format
_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _put(rows: DataFrame, name: str) -> str:
    """Lines of text as files in the shared folder."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


def _hms(seconds):
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))


#: Journeys of the timetable: times move by 20 hours, so that they roll over midnight; public times in minutes.
_RUN = """run as (select trip || ':' || cast(day as varchar) as rid, trip, seq - 1 as seq, stop as tpl, cast(floor(minute * 60) + 72000 as bigint) % 86400 as s from calls),
  roll as (select *, s + 86400 * sum(fell) over (partition by rid order by seq) as dep_s, s // 60 + 1440 * sum(down) over (partition by rid order by seq) as ptd_min from (select *, case when s < lag(s) over (partition by rid order by seq) - 43200 then 1 else 0 end as fell, case when s // 60 < lag(s // 60) over (partition by rid order by seq) then 1 else 0 end as down from run)),
  why as (select *, case when trip % 13 = 1 then 'charter' when trip % 11 = 0 then 'cancelled_journey' when trip % 7 = 0 then 'road_BR' when trip % 5 = 0 then 'water' end as exclusion from roll)"""


def _timetable(t) -> str:
    rid = F.concat_ws(":", F.col("trip").cast("string"), F.col("day").cast("string"))
    s = (F.floor(F.col("minute") * 60) + 72_000) % 86_400
    call = F.concat(F.lit('<IP tpl="'), "stop", F.lit('" wtd="'), _hms(s), F.lit('" ptd="'), F.substring(_hms(s), 1, 5), F.lit('"/>'))
    c = t.calls.select(rid.alias("rid"), "trip", "seq", call.alias("x"))
    g = c.groupBy("rid", "trip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda r: r["x"]), "\n").alias("x"))
    k = F.col("trip")
    more = F.concat(F.when(k % 11 == 0, ' can="true"').otherwise(""), F.when(k % 7 == 0, ' trainCat="BR"').otherwise(""), F.when(k % 5 == 0, ' status="S"').otherwise(""), F.when(k % 13 == 1, ' isCharter="true"').otherwise(""))
    return _put(g.select(F.concat(F.lit('<Journey rid="'), "rid", F.lit('"'), more, F.lit(">"), "x", F.lit("</Journey>"))), "timetable")


@query("timing_points", f"with {_RUN} select rid, seq, tpl, 'IP' as kind, dep_s::double as dep_s, ptd_min::double as ptd_min, trip % 11 = 0 as journey_cancelled, exclusion from why", "calls")
def timing_points(t):
    pts = documents.read_timing_points(t.spark, _timetable(t))
    return tidy(pts.select("rid", "seq", "tpl", "kind", "dep_s", "ptd_min", "journey_cancelled", "exclusion"))


_PLACES = "pl as (select unnest(['view', 'click', 'signup', 'purchase', 'error']) as tpl, unnest([0, 1, 2, 9, 3]) as x, unnest(['VIE', 'CLI', null, 'PUR', 'ERR']) as crs)"


@query("passenger_calls", f"""
with {_RUN}, {_PLACES}, c as (select why.*, x <= 5 as inside from why join pl using (tpl) where exclusion is null and crs is not null), n as (select rid, count(*) as n, count(*) filter (inside) as k from c group by 1), e as (select rid, max(exclusion) as why from why group by 1)
select case when e.why is not null then e.why when coalesce(n, 0) < 2 then 'fewer_than_2_public_calls' when k = 0 then 'outside_box' when k = 1 then 'one_call_in_box' else 'kept' end as reason, count(*) as journeys, coalesce(sum(case when e.why is null and n >= 2 and k >= 2 then k end), 0)::bigint as calls from e left join n using (rid) group by 1
""", "calls")
def passenger_calls(t):
    places = t.spark.createDataFrame([("view", "VIE", 0.0, 0.0), ("click", "CLI", 1.0, 0.0), ("signup", None, 2.0, 0.0), ("purchase", "PUR", 9.0, 0.0), ("error", "ERR", 3.0, 0.0)], "tpl string, crs string, lon double, lat double")
    kept, why = documents.passenger_calls(documents.read_timing_points(t.spark, _timetable(t)), places, (-1.0, -1.0, 5.0, 1.0))
    return tidy(why.join(kept.agg(F.count("*").alias("n")).withColumn("reason", F.lit("kept")), "reason", "left").select("reason", "journeys", F.coalesce("n", F.lit(0)).alias("calls")))


@query("vehicle_snapshots", """
select event_id, user_id as vehicle, time_bucket(interval 1 hour, ts) + interval 1 hour as response_ts, case when event_id % 10 > 0 then date_trunc('second', ts) end as recorded_at, case when event_id % 7 > 0 then round(value / 10, 4) end as lon, event_id % 10 = 0 or event_id % 7 = 0 as invalid from events
""")
def vehicle_snapshots(t):
    """A file an hour, an activity an event; some without place, some with times that have no offset."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600 + 3600)
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 10 > 0, "+00:00").otherwise("")
    lon = F.when(F.col("event_id") % 7 > 0, F.format_string("%.4f", F.round(F.col("value") / 10, 4))).otherwise("")
    act = F.concat(F.lit("<VehicleActivity><RecordedAtTime>"), when("ts"), zone, F.lit("</RecordedAtTime><MonitoredVehicleJourney><LineRef>"), F.col("event_id").cast("string"), F.lit("</LineRef><OperatorRef>o</OperatorRef><VehicleLocation><Longitude>"), lon, F.lit("</Longitude><Latitude>51.0</Latitude></VehicleLocation><VehicleRef>"), F.col("user_id").cast("string"), F.lit("</VehicleRef></MonitoredVehicleJourney></VehicleActivity>"))
    g = e.select(hour.alias("hour"), act.alias("x")).groupBy("hour").agg(F.array_join(F.collect_list("x"), "\n").alias("x"))
    text = F.concat(F.lit('<Siri><ServiceDelivery><ResponseTimestamp>'), when("hour"), F.lit("+00:00</ResponseTimestamp>"), "x", F.lit("</ServiceDelivery></Siri>"))
    path = f"{shared_dir(t.spark)}/snapshots-{uuid.uuid4().hex}"
    g.select("hour", text.alias("value")).repartition("hour").write.partitionBy("hour").text(path)
    rows = documents.read_snapshots(t.spark, f"{path}/*/*.txt")
    return rows.select(F.col("line_ref").cast("long").alias("event_id"), F.col("vehicle_ref").cast("long").alias("vehicle"), F.col("response_ts").cast("timestamp_ntz").alias("response_ts"), F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), "lon", "invalid")


_FEED = """cal as (select n_nationkey as k, case when n_nationkey % 5 > 0 then 1 else 0 end as wed, '202401' || case when n_nationkey % 4 = 0 then '20' else '01' end as first from nation), ex as (select n_nationkey as k, case when n_regionkey = 1 then 2 else 1 end as kind from nation where n_regionkey in (1, 2) and n_nationkey % 3 = 0),
  on_ as (select k from cal where wed = 1 and first <= '20240117' and k not in (select k from ex where kind = 2) union select k from ex where kind = 1)"""


def _feed(t) -> feeds.Feed:
    """A feed of the tables: suppliers are stops, nations services and routes, orders trips, lines calls."""
    text = lambda c: F.col(c).cast("string")
    n = F.col("n_nationkey")
    cal = t.nation.select(text("n_nationkey").alias("service_id"), *[F.when(n % 5 > 0, "1").otherwise("0").alias(d) for d in _DAYS], F.when(n % 4 == 0, "20240120").otherwise("20240101").alias("start_date"), F.lit("20240131").alias("end_date"))
    ex = t.nation.filter("n_regionkey in (1, 2) and n_nationkey % 3 = 0").select(text("n_nationkey").alias("service_id"), F.lit("20240117").alias("date"), F.when(F.col("n_regionkey") == 1, "2").otherwise("1").alias("exception_type"))
    nation = (F.col("o_custkey") % 25).cast("string")
    trips = t.orders.select(nation.alias("route_id"), nation.alias("service_id"), text("o_orderkey").alias("trip_id"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    st = t.lineitem.select(text("l_orderkey").alias("trip_id"), F.lit("07:00:00").alias("departure_time"), text("l_suppkey").alias("stop_id"), (F.row_number().over(w) * 10).cast("string").alias("stop_sequence"))
    return feeds.Feed({"calendar": cal, "calendar_dates": ex, "trips": trips, "stop_times": st, "routes": t.nation.select(text("n_nationkey").alias("route_id"), F.lit("3").alias("route_type")), "stops": t.supplier.select(text("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"))})


@query("trips_on_date", f"with {_FEED} select 'x' as feed, 'x:' || o_orderkey as trip_id, 'x:' || o_custkey % 25 as route_id, 'x:' || o_custkey % 25 as service_id from orders where o_custkey % 25 in (select k from on_)")
def trips_on_date(t):
    return feeds.trips_on_date({"x": _feed(t)}, "20240117").select("feed", "trip_id", "route_id", "service_id")


@query("single_day", f"""
with {_FEED}, tr as (select o_orderkey as trip, o_custkey % 25 as route from orders where o_custkey % 25 in (select k from on_)), st as (select l_orderkey as trip, l_suppkey as stop, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as seq from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 25 in (select k from on_) and l_suppkey % 4 > 0),
  k as (select trip, row_number() over (partition by trip order by seq) as seq, stop from st)
select 'stop_times' as "table", count(*) as n, sum(seq)::bigint as total from k union all select 'trips', count(*), 0 from tr where trip in (select trip from k) union all select 'routes', count(distinct route), 0 from tr where trip in (select trip from k)
  union all select 'stops', count(distinct stop), 0 from k union all select 'calendar', 1, 0
""")
def single_day(t):
    """What a feed keeps of a day: rows by table, and the sum of the new sequence numbers."""
    feed = _feed(t)
    from tramline.operators.timetable import active_services

    on = active_services(feed["calendar"], feed["calendar_dates"], "20240117")
    trips = feed["trips"].join(on, "service_id", "left_semi")
    calls = feed["stop_times"].join(trips.select("trip_id"), "trip_id", "left_semi").filter(F.col("stop_id").cast("int") % 4 > 0)
    day = feeds.single_day(feed, trips, calls, "20240117")
    count = lambda n: day[n].agg(F.lit(n).alias("table"), F.count("*").alias("n"), (F.sum(F.col("stop_sequence").cast("long")) if n == "stop_times" else F.lit(0).cast("long")).alias("total"))
    out = count("stop_times")
    for n in ("trips", "routes", "stops", "calendar"):
        out = out.union(count(n))
    return tidy(out)


@query("feature_points", "select s_suppkey as id, s_name as name, round(s_acctbal / 100, 4) as lon, round(s_suppkey % 90 / cast(1 as double), 4) as lat from supplier")
def feature_points(t):
    """Suppliers as GeoJSON features, a collection a nation, read as points."""
    s = t.supplier
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col("s_acctbal") / 100, 4), (F.col("s_suppkey") % 90).cast("double")).alias("coordinates")).alias("geometry"), F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")).alias("properties")))
    g = s.groupBy("s_nationkey").agg(F.array_join(F.collect_list(feature), ",").alias("x"))
    path = f"{shared_dir(t.spark)}/features-{uuid.uuid4().hex}"
    g.select("s_nationkey", F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "x", F.lit("]}")).alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    p = documents.geojson_points(documents.read_geojson(t.spark, f"{path}/*/*.txt"))
    return tidy(p.select(F.col("properties")["id"].cast("long").alias("id"), F.col("properties")["name"].alias("name"), "lon", "lat"), 4)


@query("text_csv", "select c_custkey::varchar as id, c_mktsegment || ', \"' || c_name || '\"' as note from customer")
def text_csv(t):
    """A CSV of text columns with quotes and separators in its values."""
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.col("c_mktsegment"), F.lit(', "'), F.col("c_name"), F.lit('"')).alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return documents.read_text_csv(t.spark, path, ["id", "note"])


@query("grid_squares", f"""
with g as (select s_suppkey as id, s_suppkey * 6007 % 700000 as e, s_suppkey * 9001 % 1200000 as n from supplier), k as (select *, e // 100000 as a, n // 100000 as b from g), i as (select *, (19 - b) - (19 - b) % 5 + (a + 10) // 5 as f, (19 - b) * 5 % 25 + a % 5 as s from k)
select id, substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', f::int + 1, 1) || substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', s::int + 1, 1) || (e % 100000 // 10000) || (n % 100000 // 10000) as square from i
""")
def grid_squares(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), geo.grid_square((k * 6007 % 700_000).cast("double"), (k * 9001 % 1_200_000).cast("double")).alias("square"))
