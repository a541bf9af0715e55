"""Times of day as minutes since the service day's midnight, which may pass 24:00."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.config import PERIODS


def minutes(hhmmss: Column) -> Column:
    """`HH:MM:SS` to minutes; hours may exceed 23; null where it is no time."""
    p = F.split(F.trim(hhmmss), ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return part(0) * 60 + part(1) + F.coalesce(part(2), F.lit(0.0)) / 60


def hhmmss(mins: Column) -> Column:
    """Minutes to `HH:MM:SS`, to the nearest second (halves to even)."""
    s = F.bround(mins * 60, 0).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.pmod(F.floor(s / 60), F.lit(60)).cast("int"), F.pmod(s, F.lit(60)).cast("int"))


def period(mins: Column, periods: dict[str, tuple[float, float]] = PERIODS, other: str | None = "OP") -> Column:
    """The first period lo <= t < hi that holds the time."""
    out = None
    for name, (lo, hi) in periods.items():
        hit = (mins >= lo) & (mins < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(other)) if other is not None else out


def parse_span(text: str) -> tuple[float, float]:
    """`HH:MM-HH:MM` in minutes; a span that ends at or before its start wraps midnight."""
    a, b = (int(x[:2]) * 60 + int(x[3:5]) for x in text.split("-"))
    return float(a), float(b if b > a else b + 1440)


def parse_periods(spans: dict[str, str]) -> dict[str, tuple[float, float]]:
    return {k: tuple(float(int(x[:2]) * 60 + int(x[3:5])) for x in v.split("-")) for k, v in spans.items()}


def period_windows(periods: dict[str, tuple[float, float]], span: tuple[float, float]) -> list[tuple[str, float, float]]:
    """Pieces of a service span by period, in order of time; what no period covers is OP. The span may run past midnight."""
    lo, hi = span
    cuts = {lo, hi}
    for day in (0.0, 1440.0):
        for a, b in periods.values():
            cuts |= {x + day for x in (a, b) if lo < x + day < hi}
    out: list[tuple[str, float, float]] = []
    edge = sorted(cuts)
    for a, b in zip(edge, edge[1:], strict=False):
        t = a % 1440
        name = next((k for k, (x, y) in periods.items() if x <= t < y), "OP")
        if out and out[-1][0] == name and out[-1][2] == a:
            out[-1] = (name, out[-1][1], b)
        else:
            out.append((name, a, b))
    return out


def departures(windows: list[tuple[str, float, float]], headways: dict[str, float], offset: float = 0.0, anchor: float = 0.0) -> list[float]:
    """Departure minutes: in each window the slots congruent to anchor + offset x headway, one headway apart."""
    from math import ceil

    out = []
    for name, lo, hi in windows:
        hw = headways.get(name)
        if not hw:
            continue
        phase = anchor + offset * hw
        t = phase + ceil((lo - phase) / hw - 1e-9) * hw
        while t < hi - 1e-9:
            out.append(round(t, 6))
            t += hw
    return out
