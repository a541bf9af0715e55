"""The rules of scenario documents, as tables, and the one interpreter that holds a document against them.

RECORDS says which keys a mapping may and must have; VALUES what a key's value must be; RELATIONS what must hold between a
mapping's keys and the network; EFFECTS what an op leaves of the network for the ops behind it. A broken rule raises
`ScenarioError` with the rule's name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from tramline.functions.clock import parse_span

# What documents may hold.
MODES = {"light_rail", "tram", "brt", "metro", "bus", "heavy_rail"}
ALIGNMENT_TYPES = {"at_grade_street", "at_grade_segregated", "elevated", "tunnel", "existing_rail"}
FARE_TYPES = {"flat"}
COMPLEXITY = {"simple", "complex"}
JUNCTION_TYPES = {"grade_separated"}
PLATFORM_KINDS = {"bay"}
KEEP = {"before", "after"}
ID = r"[A-Z][A-Za-z0-9]*(-[a-z0-9]+)*"
SPAN = r"([01]\d|2[0-3]):([0-5]\d)-(\d\d):([0-5]\d)"


class ScenarioError(ValueError):
    """A document broke a rule: its arguments are the rule's name and what is wrong."""

    @property
    def rule(self) -> str:
        return self.args[0]

    def __str__(self) -> str:
        return "{0}: {1}".format(*self.args)


def need(ok: Any, rule: str, message: str) -> None:
    if not ok:
        raise ScenarioError(rule, message)


@dataclass(frozen=True)
class Place:
    """A stop: where it is, and the routes that call there."""

    at: tuple[float, float]
    routes: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Bounds:
    """What a project allows: the names of its periods, its extent, the accelerations with a fitted allowance (none: any), and how far a stop may lie off its line."""

    periods: frozenset[str] = frozenset({"AM", "IP", "PM", "OP"})
    extent: tuple[float, float, float, float] | None = None
    accelerations: tuple[float, ...] = ()
    off_m: float = 50.0


class Catalogue:
    """What a document may refer to, the network its parent leaves: places by stop, names of routes, and pairs of timing points that rail runs between.

    Ops leave a catalogue for the ops behind them by `put` and `drop`; a `branch` changes on its own.
    """

    def __init__(self, places: dict[str, Place], routes: set[str], rail: frozenset[frozenset[str]] = frozenset(), bounds: Bounds = Bounds()):
        self.places, self.names, self.rail, self.bounds = places, routes, rail, bounds

    @classmethod
    def of(cls, routes: dict[str, list[str]], stops: dict[str, tuple[float, float]], sections: Any = (), bounds: Bounds = Bounds()) -> Catalogue:
        """From stops by route and places by stop."""
        made = cls({k: Place(tuple(at)) for k, at in stops.items()}, set(), frozenset(map(frozenset, sections)), bounds)
        for route, called in routes.items():
            made.put(route, called)
        return made

    def branch(self) -> Catalogue:
        return Catalogue(dict(self.places), set(self.names), self.rail, self.bounds)

    def knows(self, stop: Any) -> bool:
        """Whether the stop is there, and it is known where."""
        return stop in self.places and not math.isnan(self.places[stop].at[0])

    def calls(self, route: str, stop: str) -> bool:
        return stop in self.places and route in self.places[stop].routes

    def put(self, route: str, stops: Any, where: dict[str, tuple[float, float]] | None = None) -> None:
        """The route calls at the stops as well; `where` says where new ones are."""
        self.names.add(route)
        for stop in stops:
            old = self.places.get(stop)
            at = (where or {}).get(stop) or (old.at if old else (math.nan, math.nan))
            self.places[stop] = Place(at, (old.routes if old else frozenset()) | {route})

    def drop(self, route: str, stops: Any = None) -> None:
        """The route no longer calls at the stops; without stops, it goes."""
        for stop in list(self.places) if stops is None else stops:
            if stop in self.places:
                self.places[stop] = replace(self.places[stop], routes=self.places[stop].routes - {route})
        if stops is None:
            self.names.discard(route)

    def section(self, a: str, b: str) -> bool:
        return frozenset((a, b)) in self.rail

    def timing_point(self, p: Any) -> bool:
        return any(p in pair for pair in self.rail)

    def covers(self, points: list) -> bool:
        box = self.bounds.extent
        return box is None or all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in points)


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    k = math.cos(math.radians((a[1] + b[1]) / 2))
    return 111_320 * math.hypot((a[0] - b[0]) * k, a[1] - b[1])


def off_line(p: tuple[float, float], line: list[tuple[float, float]]) -> float:
    """Metres from a point to a line, on the flat around the point."""
    k = math.cos(math.radians(p[1]))
    flat = [((x - p[0]) * k * 111_320, (y - p[1]) * 111_320) for x, y in line]
    best = math.inf
    for (ax, ay), (bx, by) in zip(flat, flat[1:], strict=False):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if n == 0 else max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / n))
        best = min(best, math.hypot(ax + t * (bx - ax), ay + t * (by - ay)))
    return best


def number(v: Any, low: float = -math.inf, above: float = -math.inf, whole: bool = False) -> bool:
    """A finite number (no boolean) of at least `low` and over `above`."""
    return type(v) in (int, float) and math.isfinite(v) and v >= low and v > above and not (whole and v % 1)


positive = lambda v, c: number(v, above=0)
count = lambda v, c: number(v, above=0, whole=True)
not_negative = lambda v, c: number(v, low=0)
some = lambda v, c: isinstance(v, list) and bool(v)


def among(values: set) -> Callable:
    return lambda v, c: isinstance(v, str) and v in values


def all_among(values: set) -> Callable:
    return lambda v, c: bool(v) and set(v) <= values


def span(v: Any, c: Catalogue) -> bool:
    return isinstance(v, str) and re.fullmatch(SPAN, v) is not None and (lambda t: t[1] - t[0] <= 1440)(parse_span(v))


def headways(v: Any, c: Catalogue) -> bool:
    return isinstance(v, dict) and bool(v) and set(v) <= c.bounds.periods and all(number(m, above=0) for m in v.values())


def pairs(v: Any, c: Catalogue) -> bool:
    return some(v, c) and all(c.section(*(str(s).split("-") + ["", ""])[:2]) for s in v)


def distinct_pairs(v: Any, c: Catalogue) -> bool:
    return len({frozenset(str(s).split("-")) for s in v}) == len(v)


def timing_points(v: Any, c: Catalogue) -> bool:
    return isinstance(v, list) and len(v) >= 2 and all(c.section(a, b) for a, b in zip(v, v[1:], strict=False))


SERVICE = "mode! alignment! stops! headways_min! span! speed_profile vehicle fare traction operator name"
#: Keys of each mapping; `!`: must be there and not null.
RECORDS: dict[str, str] = {
    "add_line": f"route_id! name! {SERVICE.removesuffix(' name')}",
    "replace_route": f"route_id route_ids new_route_id! periods {SERVICE}",
    "modify_route": "route_id! fill_span truncate_at stopping_pattern extend_to headways_min",
    "remove_route": "route_id!",
    "add_stop": "route_id! after_stop! stop!",
    "reroute": "route_id! from_stop! to_stop! alignment! stops speed_profile",
    "road_speed_factor": "links! applies_to! factor!",
    "fare_change": "modes! type! gbp!",
    "landuse_delta": "file!",
    "works": "name! track electrify loops junctions platforms",
    "feature": "type! line! timing_points speed_profile",
    "stops": "stop_id! lon! lat! name existing underground",
    "stop": "stop_id! name! lon! lat!",
    "speed_profile": "max_kmh! accel_ms2! dwell_s! junctions",
    "vehicle": "capacity name",
    "fare": "type! gbp! modes",
    "truncate_at": "stop! tiploc! keep!",
    "stopping_pattern": "add remove",
    "extend_to": "from_stop! alignment! stops! speed_profile stand_at_from_stop_s",
    "track": "sections! was! tracks! length_km! note",
    "electrify": "sections! tracks! length_km! complexity! note",
    "loops": "at! note",
    "junctions": "at! type! note",
    "platforms": "at! kind! count! note",
}
#: The record that a key (of a record) holds one of, or (`*`) a list of.
HOLDS: dict[str, str] = {
    "alignment": "*feature", "stops": "*stops", "add_stop.stop": "stop", "speed_profile": "speed_profile", "vehicle": "vehicle", "fare": "fare", "truncate_at": "truncate_at", "stopping_pattern": "stopping_pattern",
    "extend_to": "extend_to", "track": "*track", "electrify": "*electrify", "loops": "*loops", "junctions": "*junctions", "platforms": "*platforms",
}
#: By record and key, or by key alone: (rule, test of value and catalogue), in order.
VALUES: dict[str, list[tuple[str, Callable]]] = {
    "mode": [("mode", among(MODES))],
    "headways_min": [("headway", headways)],
    "span": [("span", span)],
    "fill_span": [("span", span)],
    "periods": [("headway", lambda v, c: isinstance(v, list) and set(v) <= c.bounds.periods)],
    "alignment": [("geometry", some)],
    "stops": [("stop-id", lambda v, c: isinstance(v, list) and len({s.get("stop_id") for s in v if isinstance(s, dict)}) == len(v))],
    "feature.line": [("geometry", lambda v, c: isinstance(v, list) and len(v) >= 2), ("outside-extent", lambda v, c: c.covers(v))],
    "feature.type": [("alignment-type", among(ALIGNMENT_TYPES))],
    "feature.timing_points": [("existing-rail-section", timing_points)],
    "speed_profile.max_kmh": [("speed-profile", positive)],
    "speed_profile.accel_ms2": [("speed-profile", positive), ("acceleration", lambda v, c: not c.bounds.accelerations or any(math.isclose(v, a, abs_tol=1e-9) for a in c.bounds.accelerations))],
    "speed_profile.dwell_s": [("speed-profile", positive)],
    "vehicle.capacity": [("vehicle", lambda v, c: v is None or count(v, c))],
    "fare.type": [("fare", among(FARE_TYPES))],
    "fare.gbp": [("fare", not_negative)],
    "fare_change.type": [("fare", among(FARE_TYPES))],
    "gbp": [("fare", not_negative)],
    "modes": [("mode", all_among(MODES))],
    "applies_to": [("mode", all_among(MODES))],
    "factor": [("factor", positive)],
    "truncate_at.keep": [("truncate", among(KEEP))],
    "truncate_at.tiploc": [("truncate", lambda v, c: c.timing_point(v))],
    "stand_at_from_stop_s": [("speed-profile", lambda v, c: v is None or not_negative(v, c))],
    "sections": [("works-section", pairs), ("works-section", distinct_pairs)],
    "was": [("works-tracks", count)],
    "tracks": [("works-tracks", count)],
    "length_km": [("works-length", positive)],
    "complexity": [("works-complexity", among(COMPLEXITY))],
    "loops.at": [("works-point", lambda v, c: c.timing_point(v))],
    "junctions.at": [("works-point", lambda v, c: c.timing_point(v))],
    "junctions.type": [("works-kind", among(JUNCTION_TYPES))],
    "platforms.at": [("works-point", lambda v, c: c.timing_point(v) or c.knows(v))],
    "platforms.kind": [("works-kind", among(PLATFORM_KINDS))],
    "platforms.count": [("works-kind", count)],
}


def replaced(b: dict) -> list[str]:
    return b["route_ids"] if "route_ids" in b else [b["route_id"]]


def built(b: dict) -> bool:
    """Whether any feature is not on existing rail, so run times come from a speed profile."""
    return any(f["type"] != "existing_rail" for f in b["alignment"])


def near(b: dict, c: Catalogue) -> bool:
    return all(min(off_line((s["lon"], s["lat"]), f["line"]) for f in b["alignment"]) <= c.bounds.off_m for s in b["stops"])


def ends_at(b: dict, c: Catalogue) -> bool:
    ends = [tuple(b["alignment"][0]["line"][0]), tuple(b["alignment"][-1]["line"][-1])]
    return all(min(metres(c.places[b[k]].at, e) for e in ends) <= c.bounds.off_m for k in ("from_stop", "to_stop"))


def joined(b: dict, c: Catalogue) -> bool:
    return all(metres(tuple(x["line"][-1]), tuple(y["line"][0])) <= c.bounds.off_m for x, y in zip(b["alignment"], b["alignment"][1:], strict=False))


on_route = lambda key, route="route_id": ("stop-not-on-route", lambda b, c: c.calls(b[route], b[key]))
known_route = ("unknown-route", lambda b, c: b["route_id"] in c.names)
new_stretch = [
    ("stop-id", lambda b, c: len(b["stops"]) >= 2),
    ("stop-id", lambda b, c: all(bool(s.get("existing")) == c.knows(s["stop_id"]) for s in b["stops"])),
    ("existing-rail-section", lambda b, c: all(f.get("timing_points") for f in b["alignment"] if f["type"] == "existing_rail")),
    ("stop-off-alignment", near),
    ("required-field", lambda b, c: b.get("speed_profile") is not None or not built(b)),
]
changes = lambda *keys: ("empty-op", lambda b, c: any(k in b for k in keys))
#: By record, after its values: (rule, test of mapping and catalogue). A dotted name is a part of an op, whose mapping also has the op's route_id.
RELATIONS: dict[str, list[tuple[str, Callable]]] = {
    "add_line": [("duplicate-route", lambda b, c: b["route_id"] not in c.names), *new_stretch],
    "replace_route": [
        ("route-ids", lambda b, c: ("route_id" in b) != ("route_ids" in b)),
        ("route-ids", lambda b, c: isinstance(replaced(b), list) and len(set(replaced(b))) == len(replaced(b)) > 0),
        ("unknown-route", lambda b, c: set(replaced(b)) <= c.names),
        ("duplicate-route", lambda b, c: b["new_route_id"] not in c.names),
        *new_stretch,
    ],
    "modify_route": [known_route, changes("fill_span", "truncate_at", "stopping_pattern", "extend_to", "headways_min")],
    "truncate_at": [on_route("stop")],
    "stopping_pattern": [
        ("stop-not-on-route", lambda b, c: all(c.calls(b["route_id"], s) for s in b.get("remove", []))),
        ("stop-id", lambda b, c: all(c.knows(s) and not c.calls(b["route_id"], s) for s in b.get("add", []))),
    ],
    "extend_to": [on_route("from_stop"), *new_stretch, ("stop-off-alignment", lambda b, c: b["from_stop"] in {s["stop_id"] for s in b["stops"]})],
    "remove_route": [known_route],
    "add_stop": [
        known_route, on_route("after_stop"), ("stop-id", lambda b, c: not c.knows(b["stop"]["stop_id"])),
        ("outside-extent", lambda b, c: c.covers([(b["stop"]["lon"], b["stop"]["lat"])])),
    ],
    "reroute": [
        known_route, on_route("from_stop"), on_route("to_stop"), ("geometry", joined), ("reroute-ends", ends_at),
        ("required-field", lambda b, c: b.get("speed_profile") is not None or not built(b)),
    ],
    "works": [changes("track", "electrify", "loops", "junctions", "platforms")],
    "track": [("works-tracks", lambda b, c: b["tracks"] > b["was"])],
}


def _add(c: Catalogue, route: str, stops: list[dict]) -> None:
    c.put(route, [s["stop_id"] for s in stops], {s["stop_id"]: (s["lon"], s["lat"]) for s in stops})


def _replace(b: dict, c: Catalogue) -> None:
    for r in [] if b.get("periods") else replaced(b):
        c.drop(r)
    _add(c, b["new_route_id"], b["stops"])


def _pattern(b: dict, c: Catalogue) -> None:
    c.drop(b["route_id"], b.get("remove", []))
    c.put(b["route_id"], b.get("add", []))


def _extend(b: dict, c: Catalogue) -> None:
    c.put(b["route_id"], [s["stop_id"] for s in b["stops"]], {s["stop_id"]: (s["lon"], s["lat"]) for s in b["stops"]})


def _stop(b: dict, c: Catalogue) -> None:
    stop = b["stop"]
    c.put(b["route_id"], [stop["stop_id"]], {stop["stop_id"]: (stop["lon"], stop["lat"])})


#: What a record does to the catalogue once it holds.
EFFECTS: dict[str, Callable[[dict, Catalogue], None]] = {
    "add_line": lambda b, c: _add(c, b["route_id"], b["stops"]), "replace_route": _replace, "stopping_pattern": _pattern, "extend_to": _extend, "add_stop": _stop,
    "remove_route": lambda b, c: c.drop(b["route_id"]),
}
OPS = {"add_line", "modify_route", "replace_route", "reroute", "remove_route", "add_stop", "road_speed_factor", "fare_change", "landuse_delta", "works"}
#: Parts of an op whose relations need its route.
OF_ROUTE = {"truncate_at", "stopping_pattern", "extend_to"}


def hold(record: str, body: Any, cat: Catalogue, at: str, route: str | None = None) -> None:
    """Hold a mapping against its record: keys, values (parts of it among them, in the record's order), relations; then its effect."""
    need(isinstance(body, dict), "op" if record in OPS else {"truncate_at": "truncate"}.get(record, "mapping"), f"{at} must be a mapping")
    known = {k.rstrip("!"): k.endswith("!") for k in RECORDS[record].split()}
    need(not set(body) - set(known), "unknown-key", f"{at}: unexpected {sorted(set(body) - set(known))}")
    for k, must in known.items():
        need(not must or body.get(k) is not None, "required-field", f"{at}: `{k}` is required")
    late = []
    for k in known:
        if k not in body or (body[k] is None and not known[k]):
            continue
        for rule, test in VALUES.get(f"{record}.{k}") or VALUES.get(k, []):
            need(test(body[k], cat), rule, f"{at}.{k}: {body[k]!r}")
        held = HOLDS.get(f"{record}.{k}") or HOLDS.get(k)
        if k in OF_ROUTE:
            late.append(k)
        elif held:
            for i, part in enumerate(body[k] if held[0] == "*" else [body[k]]):
                hold(held.lstrip("*"), part, cat, f"{at}.{k}[{i}]" if held[0] == "*" else f"{at}.{k}")
    seen = body if route is None else body | {"route_id": route}
    for rule, test in RELATIONS.get(record, []):
        need(test(seen, cat), rule, f"{at}: breaks `{rule}`")
    for k in late:
        hold(k, body[k], cat, f"{at}.{k}", body["route_id"])
    if record in EFFECTS:
        EFFECTS[record](seen, cat)


def spread(kind: str, body: Any, at: str) -> list[dict]:
    """The op itself, or, for one modify_route over `route_ids`, one for each route."""
    if kind != "modify_route" or not isinstance(body, dict) or "route_ids" not in body:
        return [body]
    ids = body["route_ids"]
    need("route_id" not in body and isinstance(ids, list) and len(set(ids)) == len(ids) > 0, "route-ids", f"{at}: route_ids are different routes, without route_id")
    need(not {"extend_to", "fill_span", "truncate_at"} & set(body), "route-ids", f"{at}: what differs by route goes with one route_id")
    rest = {k: v for k, v in body.items() if k != "route_ids"}
    return [rest | {"route_id": r} for r in ids]
