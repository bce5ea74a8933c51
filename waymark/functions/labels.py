"""Classes, states and texts of single rows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geodesy import half_up, normalised_degrees

# Names of the eight winds, and the 60 km/h beyond which an uncorroborated fix is spoofed.
WINDS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
SPOOF_KMH, EXCESSIVE_INNOVATION_M = 60.0, 100.0
# Fixed values of the adaptive matching model: log weight of a broken route, and the floor of log weights.
BROKEN_LOG, LEAST_LOG = -60.0, -100.0


def cardinal(heading: Column) -> Column:
    at = (F.pmod(F.floor(normalised_degrees(heading) / 45 + 0.5), F.lit(8)) + 1).cast("int")
    return F.element_at(F.array(*map(F.lit, WINDS)), at)


def distance_text(km: Column, miles: bool = False) -> Column:
    """`850 m` below one kilometre and `1.5 km` from there; with `miles`, `2.3 mi`."""
    if miles:
        return F.format_string("%.1f mi", km * 1000 / 1609.344)
    return F.when(km < 1, F.format_string("%d m", F.floor(km * 1000 + 0.5))).otherwise(F.format_string("%.1f km", km))


def duration_text(seconds: Column, hours: bool = False) -> Column:
    whole = F.floor(seconds)
    if hours:
        return F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60))
    return F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)


def vehicle_instruction(kind: Column, modifier: Column, street: Column, vehicle: Column) -> Column:
    """The first wording of a route step, by vehicle (walking, bike or any other); a step without a street is on a path."""

    def given(c: Column) -> Column:
        return F.when(c != "", c)

    # Fixed texts.
    on = F.coalesce(given(street), F.lit("path"))
    ahead = F.coalesce(F.regexp_replace(given(modifier), "^([^-]*)-", "$1 "), F.lit("ahead"))
    begin = F.when(vehicle == "walking", "Start walking on ").when(vehicle == "bike", "Head out cycling on ").otherwise("Head on ")
    onto = F.concat(F.lit(" onto "), on)
    return (
        F.when(kind == "depart", F.concat(begin, on))
        .when(kind == "arrive", F.concat(F.lit("Arrive at destination ("), on, F.lit(")")))
        .when(kind.isin("turn", "end of road"), F.concat(F.lit("Turn "), ahead, onto))
        .when(kind == "fork", F.concat(F.lit("Take the "), F.coalesce(given(modifier), F.lit("slight")), F.lit(" fork"), onto))
        .when(kind.isin("roundabout", "rotary"), F.concat(F.lit("Enter roundabout and take exit"), onto))
        .when(kind == "continue", F.concat(F.lit("Continue on "), on))
        .otherwise(F.concat(F.coalesce(given(kind), F.lit("Proceed")), onto))
    )


def gnss_state(accuracy: Column, satellites: Column, hdop: Column) -> Column:
    """GOOD, DEGRADED or WEAK_LOST of a single fix; unknown satellites and hdop do not count against it."""
    lost = accuracy.isNull() | (accuracy > 150) | F.coalesce(satellites < 4, F.lit(False)) | F.coalesce(hdop > 5, F.lit(False))
    poor = (accuracy >= 10) | F.coalesce(hdop > 2, F.lit(False)) | F.coalesce(satellites < 6, F.lit(False))
    return F.when(lost, "WEAK_LOST").when(poor, "DEGRADED").otherwise("GOOD")


def noise_scale(accuracy: Column, satellites: Column, hdop: Column) -> Column:
    """Factor on the measurement noise of a fix."""
    over = (accuracy - 50) / 10
    base = F.when(accuracy < 10, 1.0).when(accuracy <= 50, accuracy / 10).when(accuracy <= 150, 5 + 2 * over * over).otherwise(500.0)
    spread = F.when(hdop > 1.5, F.least(hdop / 1.5, F.lit(5.0))).otherwise(1.0)
    few = F.when(satellites <= 3, 3.0).when(satellites < 6, 1.5).otherwise(1.0)
    return F.when(accuracy.isNull(), 1000.0).otherwise(base * spread * few)


def simple_gnss_state(accuracy: Column) -> Column:
    """The prototype's states: limits of 10 and 25 m."""
    return F.when(accuracy.isNull() | (accuracy > 25), "WEAK_LOST").when(accuracy > 10, "DEGRADED").otherwise("GOOD")


def simple_noise_scale(accuracy: Column) -> Column:
    return (accuracy / 5) * (accuracy / 5)


def source_badge(source: Column, rejected: Column, state: Column) -> Column:
    return F.when(source == "IDR", "DEAD RECKONING").when(rejected, "GNSS REJECTED").when(state == "DEGRADED", "GNSS DEGRADED").when(state == "WEAK_LOST", "GNSS LOST").otherwise("GNSS")


def motion_class(speed_kmh: Column, var_a: Column, var_g: Column, accel: Column) -> Column:
    """(activity, confidence) by a ladder of rules over speed, variances and filtered acceleration."""

    def rule(name: str, confidence: Column) -> Column:
        return F.struct(F.lit(name).alias("activity"), confidence.alias("confidence"))

    def lit(x: float) -> Column:
        return F.lit(x)

    return (
        F.when((speed_kmh < 0.8) & (var_a < 0.035) & (var_g < 0.02) & (accel < 0.06), rule("STATIONARY", lit(0.95)))
        .when((speed_kmh <= 9) & var_a.between(0.035, 0.8) & var_g.between(0.01, 0.5), rule("PEDESTRIAN", F.when(speed_kmh <= 6, 0.90).otherwise(0.75)))
        .when((speed_kmh > 8) & (speed_kmh <= 35) & (var_g > 0.04) & (var_a < 0.3), rule("CYCLING", lit(0.70)))
        .when((speed_kmh > 10) | (var_a.between(0.15, 0.65) & (var_g <= 0.08)), rule("AUTOMOTIVE", F.when(speed_kmh > 20, 0.95).otherwise(0.80)))
        .when(speed_kmh > 15, rule("AUTOMOTIVE", lit(0.60)))
        .when(speed_kmh > 0.8, rule("PEDESTRIAN", lit(0.60)))
        .otherwise(rule("STATIONARY", lit(0.80)))
    )


def gnss_anomaly(displacement: Column, dt: Column, corroborated: Column, innovation: Column) -> Column:
    """(spoofed, excessive, severity) of a fix."""
    kmh = F.when(dt > 0.05, F.try_divide(displacement, dt)).otherwise(0.0) * 3.6
    spoofed, excessive = (kmh > SPOOF_KMH) & ~corroborated, innovation > EXCESSIVE_INNOVATION_M
    return F.struct(spoofed.alias("spoofed"), excessive.alias("excessive"), F.when(spoofed, "CRITICAL").when(excessive, "HIGH").otherwise("NONE").alias("severity"))


def connectivity(gnss: Column, network: Column) -> Column:
    """Scenario 1 (both), 2 (position only), 3 (network only) or 4 (neither)."""
    return F.when(gnss & network, 1).when(gnss, 2).when(network, 3).otherwise(4)


def emission(distance: Column, accuracy: Column, default: float = 4.07) -> Column:
    """Log density of a candidate at `distance`; the deviation follows an accuracy above 1 m, within [2, 30]."""
    sigma = F.when(accuracy > 1, F.greatest(F.lit(2.0), F.least(accuracy, F.lit(30.0)))).otherwise(default)
    return -F.log(F.sqrt(2 * F.pi()) * sigma) - 0.5 * (distance / sigma) * (distance / sigma)


def adaptive_sigma(accuracy: Column, is_dr: Column, step: Column, default: float = 4.07) -> Column:
    """Deviation of an observation: by accuracy for fixes, growing with the steps since the anchor in dead reckoning.

    An accuracy that is null or not positive counts as 10 m in dead reckoning; a fix needs more than 1 m.
    """
    grown = F.greatest(F.when(accuracy > 0, accuracy).otherwise(10.0), 8 + F.least(F.lit(8.0), 0.4 * step))
    fix = F.when(accuracy > 1, F.greatest(F.lit(2.0), F.least(accuracy, F.lit(8.0)))).otherwise(default)
    return F.when(is_dr, F.greatest(F.lit(6.0), F.least(F.lit(20.0), grown))).otherwise(fix)


def adaptive_emission(distance: Column, sigma: Column) -> Column:
    """Log density of a candidate under `sigma`, not below the floor."""
    return F.greatest(F.lit(LEAST_LOG), -F.log(F.sqrt(2 * F.pi()) * sigma) - 0.5 * (distance / sigma) * (distance / sigma))


def dynamic_beta(speed: Column, dt: Column, is_dr: Column) -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(25.0), 5 + 0.25 * speed * dt + F.when(is_dr, 4.0).otherwise(0.0)))


def dynamic_transition(route: Column, straight: Column, beta: Column) -> Column:
    """Log weight of a move by its route and straight lengths, not below the floor; a null or infinite route is broken."""
    whole = route.isNotNull() & (route < float("inf"))
    return F.when(whole, F.greatest(F.lit(LEAST_LOG), -F.log(beta) - F.abs(route - straight) / beta)).otherwise(BROKEN_LOG)


def step_instruction(kind: Column, modifier: Column, street: Column) -> Column:
    """The second wording of a route step, with the street where it has a name."""
    # Fixed texts.
    named, kind = F.coalesce(street, F.lit("")) != "", F.coalesce(kind, F.lit("turn"))
    onto = F.when(named, F.concat(F.lit("onto "), street)).otherwise("")
    turn = F.when(F.coalesce(modifier, F.lit("")) != "", F.concat(F.lit(" "), modifier)).otherwise("")

    def say(before: str, after: str = " ") -> Column:
        return F.trim(F.concat(F.lit(before), F.lit(after), onto))

    def turned(before: str | Column, after: str = " ") -> Column:
        return F.trim(F.concat(F.lit(before) if isinstance(before, str) else before, turn, F.lit(after), onto))

    return (
        F.when((kind == "depart") & named, F.concat(F.lit("Depart on "), street))
        .when(kind == "depart", "Head out towards destination")
        .when(kind == "arrive", "Arrive at destination")
        .when(kind == "turn", turned("Turn"))
        .when(kind == "new name", say("Continue"))
        .when(kind == "continue", say("Continue straight"))
        .when(kind == "merge", turned("Merge"))
        .when(kind == "fork", turned("Keep", " at fork "))
        .when(kind.isin("roundabout", "rotary"), say("Enter roundabout and take exit"))
        .when(kind == "on ramp", say("Take ramp"))
        .when(kind == "off ramp", say("Take exit"))
        .otherwise(turned(kind))
    )


def one_decimal(x: Column) -> Column:
    return half_up(x, 1)
