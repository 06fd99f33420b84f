"""Opening hours and conditions of tags: small recursive texts, parsed in Arrow batches."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
SEASONS = ("spring", "summer", "autumn", "winter")
ROAD_STATES = ("wet", "snow", "ice")
PROPERTIES = ("weight", "height", "width", "length", "axleload", "axles", "wheels", "seats", "trailers")
USAGES = ("destination", "delivery", "emergency", "residents", "customers", "doctor", "disabled", "employees", "loading", "charging", "permit")

RULES = "array<struct<days array<int>, is_range boolean, times array<struct<start int, stop int>>, closed boolean>>"
CONDITION = "struct<kind string, field string, op string, number double, text string, parts string>"


def _minutes(text: str) -> int | None:
    m = re.fullmatch(r"\s*(\d{1,2}):(\d{2})\s*", text)
    return int(m[1]) * 60 + int(m[2]) if m and int(m[1]) <= 24 and int(m[2]) < 60 else None


def _days(text: str) -> tuple[list[int], bool] | None:
    out, ranged = [], False
    for part in text.split(","):
        ends = part.strip().split("-")
        if any(e not in DAYS for e in ends) or len(ends) > 2:
            return None
        if len(ends) == 2:
            a, b, ranged = DAYS.index(ends[0]), DAYS.index(ends[1]), True
            out += [(a + k) % 7 for k in range((b - a) % 7 + 1)]
        else:
            out.append(DAYS.index(ends[0]))
    return out, ranged


def parse_hours(text: str | None) -> list[dict] | None:
    """Rules parted by semicolons: weekdays, then times parted by commas, or closed; a time alone lasts an hour.  None if it doesn't parse."""
    if text is None or not text.strip():
        return None
    if text.strip() == "24/7":
        return [{"days": [], "is_range": False, "times": [{"start": 0, "stop": 1440}], "closed": False}]
    rules = []
    for rule in filter(None, (r.strip() for r in text.split(";"))):
        head, _, rest = rule.partition(" ")
        days = _days(head)
        body = rest if days else rule
        body = body.strip()
        if body in ("closed", "off"):
            rules.append({"days": days[0] if days else [], "is_range": bool(days and days[1]), "times": [], "closed": True})
            continue
        times = []
        for span in body.split(",") if body else []:
            ends = span.split("-")
            start = _minutes(ends[0])
            stop = _minutes(ends[1]) if len(ends) == 2 else None if start is None else start + 60
            if start is None or stop is None or len(ends) > 2:
                return None
            times.append({"start": start, "stop": stop})
        if not times and not days:
            return None
        rules.append({"days": days[0] if days else [], "is_range": bool(days and days[1]), "times": times or [{"start": 0, "stop": 1440}], "closed": False})
    return rules


def parse_condition(text: str | None, depth: int = 2) -> dict | None:
    """kind, field, op, number and text of a condition; AND and OR carry their parts as JSON, two levels deep."""
    if text is None:
        return None
    t = text.strip()
    while t.startswith("(") and t.endswith(")"):
        t = t[1:-1].strip()
    out = dict.fromkeys(("kind", "field", "op", "number", "text", "parts"))
    for word, kind in (("OR", "or"), ("AND", "and")):
        parts = re.split(rf"\s+{word}\s+", t, flags=re.I)
        if len(parts) > 1 and depth:
            return out | {"kind": kind, "text": t, "parts": json.dumps([parse_condition(p, depth - 1) for p in parts])}
    if m := re.fullmatch(r"(\w+)\s*(<=|>=|<|>|=)\s*(\d+(?:\.\d+)?)\s*\w*", t):
        if m[1].lower() in PROPERTIES:
            return out | {"kind": "property", "field": m[1].lower(), "op": m[2], "number": float(m[3]), "text": t}
    if t.lower() in SEASONS:
        return out | {"kind": "season", "text": t.lower()}
    if t.lower() in ROAD_STATES:
        return out | {"kind": "road", "text": t.lower()}
    if t.lower() in USAGES:
        return out | {"kind": "usage", "text": t.lower()}
    if parse_hours(t) is not None:
        return out | {"kind": "time", "text": t}
    return out | {"kind": "other", "text": t}


def opening_rules(text: Column) -> Column:
    return F.udf(parse_hours, RULES, useArrow=True)(text)


def condition(text: Column) -> Column:
    return F.udf(parse_condition, CONDITION, useArrow=True)(text)


def open_at(rules: Column, weekday: Column, minute: Column, strict_reference: bool = True) -> Column:
    """Whether a rule holds at a weekday (Monday 0) and minute, ends included, over midnight too; with strict_reference a range of days holds every day."""

    def on_day(r: Column) -> Column:
        any_day = (F.size(r["days"]) == 0) | (r["is_range"] if strict_reference else F.lit(False))
        return any_day | F.array_contains(r["days"], weekday)

    def in_time(t: Column) -> Column:
        return F.when(t["start"] <= t["stop"], (minute >= t["start"]) & (minute <= t["stop"])).otherwise((minute >= t["start"]) | (minute <= t["stop"]))

    return F.exists(rules, lambda r: ~r["closed"] & on_day(r) & F.exists(r["times"], in_time))
