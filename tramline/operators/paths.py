"""The shortest track path through waypoints: a graph of one scheme's surroundings, on the driver."""

from __future__ import annotations

import heapq

from tramline.operators.scenario_rules import metres


def _reached(edges: dict, starts: dict[int, float], ends: set[int]) -> tuple[dict[int, float], dict[int, int]]:
    """Distances from starts (with what they cost so far) until all ends are settled, and each node's predecessor."""
    done: dict[int, float] = {}
    before: dict[int, int] = {}
    heap = [(d, n, n) for n, d in starts.items()]
    heapq.heapify(heap)
    open_ends = set(ends)
    while heap and open_ends:
        d, n, came = heapq.heappop(heap)
        if n in done:
            continue
        done[n], before[n] = d, came
        open_ends.discard(n)
        for m, length in edges.get(n, {}).items():
            if m not in done:
                heapq.heappush(heap, (d + length, m, n))
    return done, before


def track_path(nodes: dict[int, tuple[float, float]], tracks: list[dict], waypoints: list[tuple[float, float]], max_snap_m: float, choice_m: float = 60.0) -> dict:
    """nodes, length_m, snap_m, kinds_m, maxspeed_tagged_m, maxspeed_kmh of the shortest path through the waypoints.

    nodes: id -> (lon, lat); tracks: u, v, m, kind, kmh (or None), both ways. A waypoint may be met at any node within
    choice_m, or at its nearest, which must be within max_snap_m. Each leg is one search from all nodes where the last
    could end, with what they cost so far. The speed is that which covers the tagged metres in the same time.
    """
    edges: dict[int, dict[int, float]] = {}
    info: dict[tuple[int, int], dict] = {}
    for t in tracks:
        for a, b in ((t["u"], t["v"]), (t["v"], t["u"])):
            if t["m"] < edges.setdefault(a, {}).get(b, float("inf")):
                edges[a][b], info[a, b] = t["m"], t
    choices = []
    for w in waypoints:
        far = sorted((metres(w, p), n) for n, p in nodes.items() if n in edges)
        if not far or far[0][0] > max_snap_m:
            raise ValueError(f"waypoint {w} is not within {max_snap_m:g} m of track")
        choices.append({n: d for d, n in far if d <= choice_m} or {far[0][1]: far[0][0]})
    cost, legs = dict.fromkeys(choices[0], 0.0), []
    for there in choices[1:]:
        done, before = _reached(edges, cost, set(there))
        cost = {n: done[n] for n in there if n in done}
        if not cost:
            raise ValueError("no track between two of the waypoints")
        legs.append(before)
    at = min(cost, key=lambda n: (cost[n], n))
    length, way = cost[at], [at]
    for before in reversed(legs):
        while before[way[-1]] != way[-1]:
            way.append(before[way[-1]])
    way.reverse()
    steps = [info[a, b] for a, b in zip(way, way[1:], strict=False)]
    kinds: dict[str, float] = {}
    for s in steps:
        kinds[s["kind"]] = kinds.get(s["kind"], 0.0) + s["m"]
    tagged = [s for s in steps if s.get("kmh")]
    m = sum(s["m"] for s in tagged)
    snaps = [min(c[n] for n in way if n in c) for c in choices]
    return {"nodes": way, "length_m": length, "snap_m": snaps, "kinds_m": kinds, "maxspeed_tagged_m": m, "maxspeed_kmh": m / sum(s["m"] / s["kmh"] for s in tagged) if tagged else None}
