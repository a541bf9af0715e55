"""Rail operators: directed sections, station presence, cancellations, run-time rules, works on track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sections_from_points(points: DataFrame) -> DataFrame:
    """Directed sections (from, to, trains) that journeys run over near the box: from one timing point before a journey's first station inside to one after its last.

    points: rid, seq, tpl, exclusion (null or a reason), inside (a station within the box). Road and water journeys use no
    track; a point twice running is no section; journeys without a station inside give nothing.
    """
    track = points.filter(F.coalesce(~F.col("exclusion").startswith("road") & ~F.col("exclusion").startswith("water"), F.lit(True)))
    way, all_ = Window.partitionBy("rid").orderBy("seq"), Window.partitionBy("rid")
    n = track.withColumn("_n", F.row_number().over(way))
    at = F.when(F.col("inside"), F.col("_n"))
    n = n.withColumns({"_lo": F.min(at).over(all_) - 1, "_hi": F.max(at).over(all_) + 1, "_next": F.lead("tpl").over(way)})
    legs = n.filter((F.col("_n") >= F.col("_lo")) & (F.col("_n") < F.col("_hi")) & (F.col("_next") != F.col("tpl")))
    return legs.groupBy(F.col("tpl").alias("from"), F.col("_next").alias("to")).agg(F.count("*").alias("trains"))


def presence(active: DataFrame, served: DataFrame, not_open: DataFrame) -> DataFrame:
    """place, finding: active places that nothing serves (unless not open), served ones that are not open, and served ones that are not active. Each has one column, place."""
    a, s, n = (df.select("place").distinct() for df in (active, served, not_open))
    miss = a.join(s, "place", "left_anti").join(n, "place", "left_anti").withColumn("finding", F.lit("unserved_expected"))
    early = n.join(s, "place", "left_semi").withColumn("finding", F.lit("served_but_not_open"))
    odd = s.join(a, "place", "left_anti").withColumn("finding", F.lit("served_not_active"))
    return miss.unionByName(early).unionByName(odd)


def cancellations(calls: DataFrame) -> DataFrame:
    """One row: journeys_cancelled, calls_on_cancelled_journeys, calls_cancelled_on_running_journeys, calls_cancelled.

    calls: rid, whole (the journey is cancelled), cancelled (the call is), public, inside. Only public calls within the box count.
    """
    c = calls.filter(F.col("public") & F.col("inside"))
    out = c.agg(
        F.countDistinct(F.when(F.col("whole"), F.col("rid"))).alias("journeys_cancelled"), F.count(F.when(F.col("whole"), 1)).alias("calls_on_cancelled_journeys"),
        F.count(F.when(~F.col("whole") & F.col("cancelled"), 1)).alias("calls_cancelled_on_running_journeys"),
    )
    return out.withColumn("calls_cancelled", F.col("calls_on_cancelled_journeys") + F.col("calls_cancelled_on_running_journeys"))


def leg_times(existing: Column, trains: Column, median_s: Column, profile_s: Column, junctions: Column, pct: float, per_junction_s: float, least: int = 5) -> tuple[Column, Column]:
    """(seconds, rule) of a leg: the working times' median where it is existing track with `least` trains or more, else the speed profile with its allowance; null where there is neither."""
    timed = F.coalesce(existing & (trains >= least) & median_s.isNotNull(), F.lit(False))
    allowed = profile_s * F.lit(1 + pct) + junctions * F.lit(per_junction_s)
    return F.when(timed, median_s).otherwise(allowed), F.when(timed, "working times").when(allowed.isNotNull(), "speed profile")


def works_on_track(sections: DataFrame, works: DataFrame) -> DataFrame:
    """Sections (from, to, tracks) with the tracks that works (number, from, to, tracks) leave, in either direction; works that take track away raise.

    Works go in order of their number: each may only raise what the ones before left.
    """
    both = works.select("number", "from", "to", "tracks").union(works.select("number", F.col("to").alias("from"), F.col("from").alias("to"), "tracks"))
    had = sections.select(F.lit(0).alias("number"), "from", "to", "tracks")
    steps = had.unionByName(both.join(sections.select("from", "to"), ["from", "to"], "left_semi").select("number", "from", "to", "tracks"))
    before = F.max("tracks").over(Window.partitionBy("from", "to").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    fine = F.col("tracks") >= F.coalesce(before, F.col("tracks"))
    kept = F.when(fine, F.col("tracks")).otherwise(F.raise_error(F.lit("works may not take tracks away")).cast("int"))
    return steps.withColumn("tracks", kept).groupBy("from", "to").agg(F.max("tracks").alias("tracks"))


def single_track_blocks(points: DataFrame, sections: DataFrame, loops: DataFrame) -> DataFrame:
    """What works leave of single-track blocks: block, part, points (in order), for each stretch that is still single.

    points: block, seq, point; sections: from, to, tracks (after works); loops: point. A section with two tracks or more
    leaves its block and splits it; a loop within a block splits it at its point, which ends one part and begins the next.
    """
    w = Window.partitionBy("block").orderBy("seq")
    step = points.select("block", "seq", F.col("point").alias("from"), F.lead("point").over(w).alias("to"))
    step = step.filter(F.col("to").isNotNull()).join(sections.groupBy("from", "to").agg(F.max("tracks").alias("tracks")), ["from", "to"], "left")
    single = F.coalesce(F.col("tracks"), F.lit(1)) < 2
    step = step.join(loops.select(F.col("point").alias("from")).distinct().withColumn("_loop", F.lit(True)), "from", "left").withColumn("_single", single)
    cut = ~F.coalesce(F.lag("_single").over(w), F.lit(False)) | F.coalesce(F.col("_loop"), F.lit(False))
    runs = step.withColumn("_new", (F.col("_single") & cut).cast("int")).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_single")
    legs = runs.groupBy("block", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "from", "to"))).alias("_l"))
    names = F.concat(F.transform("_l", lambda x: x["from"]), F.array(F.element_at("_l", -1)["to"]))
    return legs.select("block", F.col("part").cast("int").alias("part"), names.alias("points"))


def works_lines(works: DataFrame) -> DataFrame:
    """works, item, qty that works are priced by: electrification by single-track km at its complexity, added track by km, loops, junctions and platforms each.

    works: works, kind (electrify, track, loops, junctions, platforms), complexity, was, tracks, length_km, n; a row a piece of
    work, of which those of one item are summed. Another kind raises when rows are read.
    """
    kind = F.col("kind")
    item = (
        F.when(kind == "electrify", F.concat(F.lit("electrification_"), "complexity")).when(kind == "track", "track_doubling").when(kind == "loops", "passing_loop")
        .when(kind == "junctions", "grade_separated_junction").when(kind == "platforms", "bay_platform").otherwise(F.raise_error(F.lit("no such kind of work")))
    )
    km = F.col("length_km")
    qty = F.when(kind == "electrify", F.col("tracks") * km).when(kind == "track", (F.col("tracks") - F.col("was")) * km).when(kind == "platforms", F.col("n")).otherwise(F.lit(1))
    return works.select("works", item.alias("item"), qty.cast("double").alias("qty")).groupBy("works", "item").agg(F.sum("qty").alias("qty"))


def service_quantities(legs: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, type, km; line, stop, underground) that services build. legs: line, from, to, types_m (map of type to metres); stops: line, stop, existing.

    A leg that is tunnel for more than half of its length has its new stops underground.
    """
    km = legs.select("line", F.explode("types_m").alias("type", "m")).groupBy("line", "type").agg((F.sum("m") / 1000).alias("km"))
    whole = F.aggregate(F.map_values("types_m"), F.lit(0.0), lambda a, m: a + m)
    deep = legs.filter(F.coalesce(F.try_element_at("types_m", F.lit("tunnel")), F.lit(0.0)) > 0.5 * whole)
    deep = deep.select("line", F.explode(F.array("from", "to")).alias("stop")).distinct().withColumn("_deep", F.lit(True))
    new = stops.filter(~F.coalesce(F.col("existing"), F.lit(False))).join(deep, ["line", "stop"], "left")
    return km, new.select("line", "stop", F.coalesce(F.col("_deep"), F.lit(False)).alias("underground"))
