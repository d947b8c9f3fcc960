"""Scalar rules of the routing domain as column expressions; parameters carry the numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The time of an unreachable leg, walking speed, kilometres of a mile, risk tiers from low to high,
#: school stages and their walk radius in metres, road classes that are dangerous on foot, old names of modes.
UNREACHABLE_MIN = 9999.0
WALK_M_PER_MIN = 80.0
KM_PER_MILE = 1.60934
TIERS = ("none", "tertiary", "secondary", "primary_plus", "unknown")
STAGES = ("KG", "ELEMENTARY", "MIDDLE", "HIGH")
STAGE_RADIUS = {"KG": 0.0, "ELEMENTARY": 0.0, "MIDDLE": 100.0, "HIGH": 200.0}
DANGEROUS = ("motorway", "trunk", "primary", "secondary")
OLD_MODES = {"constrained": "strictly_constrained", "unconstrained": "weakly_constrained"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def look_up(column, mapping: Mapping[str, object], default=None) -> Column:
    """Value of a small fixed mapping; text that isn't a key (or null) gives `default`."""
    out = F.lit(default)
    for key, value in mapping.items():
        out = F.when(_c(column) == key, F.lit(value)).otherwise(out)
    return out


def finite(x) -> Column:
    """The double if it is a finite number, else null: text, NaN and infinities are none."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def stage(text) -> Column:
    """School stage, upper-cased; unknown or missing text is ELEMENTARY."""
    s = F.upper(F.trim(_c(text)))
    return F.when(s.isin(*STAGES), s).otherwise("ELEMENTARY")


def speed_kph(text, fallback: float = 30.0) -> Column:
    """First number of a speed text, miles converted; the fallback if there is none."""
    number = F.regexp_extract(_c(text), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(F.when(F.lower(_c(text)).contains("mph"), number * KM_PER_MILE).otherwise(number), F.lit(fallback))


def travel_minutes(length_m, kph) -> Column:
    return F.try_divide(_c(length_m), _c(kph) * 1000.0 / 60.0)


def walk_limit(radius, ceiling: float = 500.0, factor: float = 3.0) -> Column:
    """Farthest acceptable walk: the ceiling for radius 0, else `factor` radii up to the ceiling."""
    return F.when(_c(radius) <= 0, F.lit(ceiling)).otherwise(F.least(_c(radius) * factor, F.lit(ceiling)))


def walk_penalty(distance, radius, slope: float = 2.0, base_m: float = 50.0) -> Column:
    """0 within the radius, infinite beyond the walk limit, else `slope` minutes per radius (or base) of excess."""
    d, r = _c(distance), _c(radius)
    per = F.when(r > 0, r).otherwise(F.lit(base_m))
    return F.when(d <= r, 0.0).when(d > walk_limit(r), float("inf")).otherwise((d - r) / per * slope)


def turn_penalty(bearing_in, bearing_out, sharp: float = 45.0, u_turn: float = 140.0, minutes: float = 0.2) -> Column:
    """Minutes for a turn; a U-turn is unreachable; an unknown bearing costs nothing."""
    from darb.functions.geo import angle_difference

    d = angle_difference(bearing_in, bearing_out)
    return F.coalesce(F.when(d > u_turn, UNREACHABLE_MIN).when(d > sharp, minutes).otherwise(0.0), F.lit(0.0))


def ride_cap(direct, base, offset) -> Column:
    """max(base, direct + offset); a direct time of 0 or less, or none, counts as base, an infinite one lifts the cap."""
    d = _c(direct)
    return F.when(d <= 0, _c(base)).otherwise(F.greatest(_c(base), d + _c(offset)))


def stretched_cap(direct, factor, floor, ceiling) -> Column:
    """The older cap: max(floor, min(factor * direct, direct + ceiling))."""
    d = _c(direct)
    return F.greatest(_c(floor), F.least(d * _c(factor), d + _c(ceiling)))


def road_class(highway) -> Column:
    """Highway class in lower case without a '_link' suffix; null stays null."""
    return F.regexp_replace(F.lower(F.trim(_c(highway))), "_link$", "")


def road_name(name) -> Column:
    """Road name for comparison: trimmed, lower case, '-', '_' and '/' as spaces, runs of spaces as one."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(_c(name))), "-_/", "   "), " +", " "))


def road_tier(highway) -> Column:
    """Risk tier of a road: tertiary, secondary, primary_plus or unknown."""
    c = road_class(highway)
    return F.when(c == "tertiary", "tertiary").when(c == "secondary", "secondary").when(c.isin("primary", "trunk", "motorway"), "primary_plus").otherwise("unknown")


def tier_rank(tier) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), _c(tier)), F.lit(0)) - 1, F.lit(len(TIERS) - 1))


def mode_key(key, aliases: Mapping[str, str] | None = None) -> Column:
    """Trimmed lower-case key with old names replaced; empty or null is 'unknown'."""
    k = F.lower(F.trim(_c(key)))
    for old, new in (aliases or OLD_MODES).items():
        k = F.when(k == old, new).otherwise(k)
    return F.coalesce(F.nullif(k, F.lit("")), F.lit("unknown"))


def relative_change(old, new, least: float = 1e-12) -> Column:
    """(new - old) / |old| in percent; null where old is missing or as good as 0."""
    a = _c(old)
    return F.when(F.abs(a) >= least, (_c(new) - a) / F.abs(a) * 100.0)


def clamped_percent(part, whole) -> Column:
    """100 * part / whole with part held between 0 and whole; null where whole isn't positive or part is missing."""
    w = _c(whole)
    return F.when((w > 0) & _c(part).isNotNull(), F.greatest(F.lit(0), F.least(_c(part), w)) * 100.0 / w)


def run_timestamp(text) -> Column:
    """'dd/MM/yy hh:mm am' as a timestamp; text in another form is null."""
    return F.try_to_timestamp(F.upper(F.trim(_c(text))), F.lit("dd/MM/yy hh:mm a"))


def short_hash(*columns) -> Column:
    """First 8 hex digits of the md5 of the columns' JSON, as a cache or run key."""
    return F.substring(F.md5(F.to_json(F.struct(*[_c(c) for c in columns]))), 1, 8)


def safe_file_name(text) -> Column:
    return F.regexp_replace(_c(text), r"[^A-Za-z0-9._-]+", "_")


def bin_start(value, edges: list[float]) -> Column:
    """Left edge of the half-open bin that holds the value; the last bin is closed, outside is null."""
    v = _c(value)
    out = F.lit(None).cast("double")
    for low, high in zip(edges[:-1], edges[1:]):
        inside = (v >= low) & ((v < high) | ((v == high) if high == edges[-1] else F.lit(False)))
        out = F.when(inside, float(low)).otherwise(out)
    return out


def base_cap(mrt_enabled, mrt, floor) -> Column:
    """The maximum ride time where it is on and positive, else the floor."""
    return F.when(F.coalesce(_c(mrt_enabled), F.lit(False)) & (_c(mrt) > 0), _c(mrt)).otherwise(_c(floor))


def policy_label(caps_on, mrt_enabled, bidirectional, mrt=None) -> Column:
    """Name of a ride-time policy: No MRT, MRT <minutes>, DMRT Lenient or DMRT Strict."""
    fixed = F.lit("MRT") if mrt is None else F.concat(F.lit("MRT "), _c(mrt).cast("int").cast("string"))
    return F.when(~F.coalesce(_c(caps_on), F.lit(True)), "No MRT").when(F.coalesce(_c(mrt_enabled), F.lit(False)), fixed).when(F.coalesce(_c(bidirectional), F.lit(True)), "DMRT Lenient").otherwise("DMRT Strict")


def dangerous_road(highway) -> Column:
    """Whether a road of this class is dangerous to cross on foot; no class is not."""
    return F.coalesce(road_class(highway).isin(*DANGEROUS), F.lit(False))


def candidate_points(degree, out_rank, wanted_rank: int) -> Column:
    """A point for a junction of three or more edges, and one for an edge of at least the wanted class that leaves."""
    return F.coalesce((_c(degree) >= 3).cast("int"), F.lit(0)) + F.coalesce((_c(out_rank) >= wanted_rank).cast("int"), F.lit(0))


def dwell_minutes(pickups, seconds: float = 30.0) -> Column:
    return _c(pickups) * seconds / 60.0


def in_box(lat, lon, south, west, north, east) -> Column:
    """Whether a point lies in a box, its edges included; unknown coordinates don't."""
    return F.coalesce(_c(lat).between(_c(south), _c(north)) & _c(lon).between(_c(west), _c(east)), F.lit(False))


def long_hash(*columns) -> Column:
    """sha1 of the columns' text, nulls as empty, joined by '|': a cache key."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]))


def fleet_at_least(students, capacity) -> Column:
    return F.ceil(_c(students) / _c(capacity))


def temperature(step, start: float = 1000.0, cooling: float = 0.98) -> Column:
    """The search's temperature after `step` steps."""
    return F.lit(start) * F.pow(F.lit(cooling), _c(step))


def number_text(value, decimals: int = 0) -> Column:
    """A number with ',' between thousands; '-' for none."""
    return F.coalesce(F.format_number(_c(value).cast("double"), decimals), F.lit("-"))


def signed_percent(value, decimals: int = 1) -> Column:
    """A percentage with its sign, as '+4.2%', halves to even; '-' for none."""
    return F.when(_c(value).isNull(), "-").otherwise(F.format_string(f"%+.{decimals}f%%", F.bround(_c(value).cast("double"), decimals)))


def stage_radius(stage_text, limits: Mapping[str, float] | None = None) -> Column:
    """Walk radius of a school stage; `limits` replace the radius of the stages that they name."""
    return look_up(stage(stage_text), {**STAGE_RADIUS, **(limits or {})}, 0.0)


def benchmark_seconds(minutes_in_motion, pickups, served, a: float = 15.0, b: float = 5.0) -> Column:
    """Seconds of a benchmark's route: travel, `a` seconds a stop and `b` a pupil."""
    return _c(minutes_in_motion) * 60.0 + _c(pickups) * a + _c(served) * b
