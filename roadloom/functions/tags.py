"""Road tags: classes, access rules, speed limits and lanes, as expressions over a map<string,string> of tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Road classes and their weights.
ROAD_WEIGHTS = {
    "motorway": 1, "motorway_link": 2, "trunk": 3, "trunk_link": 4, "primary": 5, "primary_link": 6, "secondary": 7, "secondary_link": 8, "tertiary": 9,
    "tertiary_link": 10, "unclassified": 10, "residential": 10, "living_street": 50, "service": 50, "pedestrian": 100, "track": 100, "raceway": 100,
    "bus_guideway": 10, "busway": 10, "escape": 100, "road": 50,
}

# Road tags that a narrower list accepts; ingest doesn't use it.
ROAD_TAGS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "unclassified", "residential", "living_street", "service", "busway", "road",
)

# Access values in order; of equally specific rules, the later value wins.
ACCESS_VALUES = (
    "yes", "no", "private", "permissive", "designated", "discouraged", "customers", "destination", "agricultural", "forestry", "delivery", "military",
    "use_sidepath", "dismount", "permit", "unknown", "variable",
)

# Each mode's parent; a rule for a mode holds for all below it.
MODE_PARENTS = {
    "access": None, "foot": "access", "dog": "access", "ski": "access", "ski:nordic": "ski", "ski:alpine": "ski", "ski:telemark": "ski",
    "inline_skates": "access", "horse": "access", "portage": "access", "vehicle": "access", "bicycle": "vehicle", "electric_bicycle": "bicycle",
    "mtb": "bicycle", "cargo_bike": "bicycle", "kick_scooter": "vehicle", "carriage": "vehicle", "cycle_rickshaw": "vehicle", "hand_cart": "vehicle",
    "trailer": "vehicle", "caravan": "vehicle", "motor_vehicle": "vehicle", "motorcycle": "motor_vehicle", "moped": "motor_vehicle",
    "speed_pedelec": "motor_vehicle", "mofa": "motor_vehicle", "small_electric_vehicle": "motor_vehicle", "motorcar": "motor_vehicle",
    "motorhome": "motor_vehicle", "tourist_bus": "motor_vehicle", "coach": "motor_vehicle", "goods": "motor_vehicle", "hgv": "goods",
    "hgv_articulated": "hgv", "bdouble": "hgv", "agricultural": "motor_vehicle", "auto_rickshaw": "motor_vehicle", "nev": "motor_vehicle",
    "golf_cart": "motor_vehicle", "microcar": "motor_vehicle", "atv": "motor_vehicle", "ohv": "motor_vehicle", "snowmobile": "motor_vehicle",
    "psv": "motor_vehicle", "bus": "psv", "taxi": "motor_vehicle", "minibus": "bus", "share_taxi": "taxi", "hov": "motor_vehicle", "carpool": "hov",
    "car_sharing": "motor_vehicle", "emergency": "motor_vehicle", "hazmat": "motor_vehicle", "hazmat:water": "hazmat", "school_bus": "bus",
    "disabled": "motor_vehicle", "water_access": None, "swimming": "water_access", "ice_skates": "water_access", "boat": "water_access",
    "motorboat": "boat", "sailboat": "boat", "canoe": "boat", "fishing_vessel": "boat", "ship": "boat", "passenger": "ship", "cargo": "ship",
    "bulk": "cargo", "tanker": "cargo", "tanker:gas": "tanker", "tanker:oil": "tanker", "tanker:chemical": "tanker", "tanker:singlehull": "tanker",
    "container": "cargo", "imdg": "ship", "isps": "ship", "rail_access": None, "train": "rail_access", "tram": "rail_access", "metro": "rail_access",
}
DIRECTIONS = ("forward", "backward", "both", "left", "right")


def mode_chain(mode: str) -> list[str]:
    """A mode with all modes above it, the widest first."""
    out = [mode]
    while (up := MODE_PARENTS[out[0]]) is not None:
        out.insert(0, up)
    return out


def mode_closure(spark: SparkSession) -> DataFrame:
    """(mode, ancestor, depth): every mode with each mode that restricts it; depth 1 is the widest."""
    return spark.createDataFrame([(m, a, k + 1) for m in MODE_PARENTS for k, a in enumerate(mode_chain(m))], "mode string, ancestor string, depth int")


def road_weight(highway: Column) -> Column:
    """The class's weight; null for what isn't a road."""
    table = F.create_map(*(F.lit(x) for kv in ROAD_WEIGHTS.items() for x in kv))
    return F.try_element_at(table, highway)


def one_way(oneway: Column, junction: Column, strict_reference: bool = True) -> Column:
    values = ["yes", "-1"] if strict_reference else ["yes", "-1", "1", "true"]
    return F.coalesce(oneway.isin(values), F.lit(False)) | F.coalesce(junction.isin("roundabout", "circular"), F.lit(False))


def access_rules(tags: Column) -> Column:
    """array<struct<mode, direction, access>> of a way's tags: keys are a mode and maybe a direction, joined by colons."""

    def rule(e: Column) -> Column:
        parts = F.split(e["key"], ":")
        mode = F.when(e["key"].isin(list(MODE_PARENTS)), e["key"]).otherwise(F.get(F.filter(parts, lambda p: p.isin(list(MODE_PARENTS))), 0))
        return F.struct(mode.alias("mode"), F.get(F.filter(parts, lambda p: p.isin(list(DIRECTIONS))), 0).alias("direction"), e["value"].alias("access"))

    able = F.filter(F.map_entries(tags), lambda e: e["value"].isin(list(ACCESS_VALUES)) & F.exists(F.split(e["key"], ":"), lambda p: p.isin(list(MODE_PARENTS))))
    return F.transform(able, rule)


def accessible(rules: Column, mode: str, direction: Column | None = None, allow_private: bool = False) -> Column:
    """Whether a mode may use a way: the most specific rule decides, of several the one with the later value; without rules, yes."""
    chain = mode_chain(mode)
    place = F.create_map(*(x for k, m in enumerate(chain) for x in (F.lit(m), F.lit(k + 1))))
    order = F.create_map(*(x for k, v in enumerate(ACCESS_VALUES) for x in (F.lit(v), F.lit(k))))
    fits = F.filter(rules, lambda r: r["mode"].isin(chain) & (r["direction"].isNull() | (r["direction"] == "both") | (F.lit(True) if direction is None else r["direction"] == direction)))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.try_element_at(place, r["mode"]).alias("depth"), F.try_element_at(order, r["access"]).alias("o"), r["access"].alias("access"))))
    allowed = (best["access"] == "yes") | (F.lit(allow_private) & (best["access"] == "private"))
    return F.coalesce(allowed, F.lit(True))


def speed_kmh(value: Column) -> Column:
    """The whole number of a speed in km/h, cut off; null without a number or for 0."""
    number = F.regexp_extract(value, r"^\s*(\d+)(?:\s*([^\s(]+))?", 1).try_cast("bigint")
    unit = F.regexp_extract(value, r"^\s*(\d+)(?:\s*([^\s(]+))?", 2)
    speed = F.when(unit == "mph", F.floor(number * F.lit(1.609344))).when(unit == "knots", F.floor(number * F.lit(1.852))).otherwise(number)
    return F.when(unit.isin("variable", "inherited", "none", "walk"), None).when((speed > 0) & (number <= 65535), speed.cast("int"))


def lanes(value: Column) -> Column:
    """A value for each lane; an empty one is null, and an end after the last bar is none."""
    parts = F.split(value, "\\|")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda p: F.when(F.trim(p) != "", F.trim(p)))


def speed_limits(tags: Column) -> Column:
    """array<struct<key, mode, direction, conditional, lanes array<int>>>: every tag that begins with maxspeed, in order of its key."""

    def limit(e: Column) -> Column:
        parts = F.split(e["key"], ":")
        values = F.when(F.array_contains(parts, "lanes"), lanes(e["value"])).otherwise(F.array(e["value"]))
        return F.struct(
            e["key"].alias("key"), F.get(F.filter(parts, lambda p: p.isin(list(MODE_PARENTS))), 0).alias("mode"),
            F.get(F.filter(parts, lambda p: p.isin(list(DIRECTIONS))), 0).alias("direction"), F.array_contains(parts, "conditional").alias("conditional"),
            F.array_contains(parts, "lanes").alias("per_lane"), F.transform(values, lambda v: speed_kmh(v)).alias("speeds"),
            F.transform(values, lambda v: F.when(F.regexp_extract(v, r"@\s*(.*)$", 1) != "", F.regexp_extract(v, r"@\s*(.*)$", 1))).alias("conditions"),
        )

    return F.array_sort(F.transform(F.map_entries(F.map_filter(tags, lambda k, v: k.startswith("maxspeed"))), limit))


def relevant_speed(limits: Column, mode: str | None = None, direction: str | None = None, lane: int = 0) -> Column:
    """Speeds that hold for a mode, a direction and a lane (counted from 0): equal, or not stated."""
    fits = F.filter(limits, lambda x: (x["mode"].isNull() | (x["mode"] == F.lit(mode))) & (x["direction"].isNull() | (x["direction"] == F.lit(direction))))
    return F.array_compact(F.transform(fits, lambda x: F.when(x["per_lane"], F.get(x["speeds"], F.lit(lane))).otherwise(F.get(x["speeds"], F.lit(0)))))


def mode_is(mode: str, kinds: Sequence[str]) -> bool:
    return any(m in kinds for m in mode_chain(mode))


def is_directional(direction: Column) -> Column:
    """Whether a direction is along the way, not a side of it."""
    return F.coalesce(direction.isin("forward", "backward", "both_ways"), F.lit(False))


def is_positional(direction: Column) -> Column:
    """Whether a direction is a side of the way."""
    return F.coalesce(direction.isin("left", "right", "both"), F.lit(False))


def opposite(direction: Column) -> Column:
    """The other direction or side; null where there is none."""
    pairs = (("forward", "backward"), ("backward", "forward"), ("left", "right"), ("right", "left"))
    out = F.lit(None).cast("string")
    for own, other in pairs:
        out = F.when(direction == own, F.lit(other)).otherwise(out)
    return out


def runtime(vehicle: Column) -> Column:
    """struct<mode, properties> of a trip's vehicle, struct<kind, height, width, weight, axle_load, length>: the mode whose rules hold, and what conditions
    are held against; properties are null without any measure."""
    mode = F.when(vehicle["kind"] == "bus", F.lit("bus")).when(vehicle["kind"] == "truck", F.lit("hgv")).otherwise(F.lit("motor_vehicle"))
    names = [("height", "height"), ("width", "width"), ("weight", "weight"), ("axleload", "axle_load"), ("length", "length")]
    given = F.map_from_entries(F.array_compact(F.array(*(F.when(vehicle[f].isNotNull(), F.struct(F.lit(n).alias("key"), vehicle[f].cast("double").alias("value"))) for n, f in names))))
    return F.struct(mode.alias("mode"), F.when(F.size(given) > 0, given).alias("properties"))
