"""State machines and filters that depend on their own output: one fold a session.

Each has a method `step(row) -> values` over plain state, so the batch driver (`fold`) and the
streaming driver run the same code. A fold holds the state and one batch of rows, and a session's
rows are sorted by Spark before they reach it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from math import asin, atan2, cos, degrees, hypot, isnan, pi, radians, sin, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geodesy import GRAVITY_STANDARD, RADIUS_EQUATOR
from waymark.operators.trips import KEY, ORDER


def fold(rows: DataFrame, make: Callable[[], object], inputs: list[str], outputs: str, keep: tuple[str, ...] = (ORDER,)) -> DataFrame:
    """Run an estimator over each session's rows in order: session key, kept columns, and its outputs.

    Sessions are dealt by one shuffle and sorted within partitions, so rows stream through in Arrow
    batches and a session of any length needs no more memory than its estimator's state.
    """
    narrow = rows.select(*dict.fromkeys((KEY, *keep, *inputs))).repartition(KEY).sortWithinPartitions(KEY, ORDER)
    names = [part.split()[0] for part in outputs.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, estimator = None, None
        for batch in batches:
            found = []
            keys = batch[KEY].tolist()
            for key, row in zip(keys, batch[inputs].itertuples(index=False, name=None), strict=True):
                if estimator is None or key != session:
                    session, estimator = key, make()
                found.append(estimator.step(*row))
            made = pd.DataFrame(found, columns=names)
            yield pd.concat([batch[[KEY, *keep]].reset_index(drop=True), made], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name in (KEY, *keep))
    return narrow.mapInPandas(run, f"{kinds}, {outputs}")


#: Sessions in one block of `fold_together`, about.
TOGETHER = 512


def sessions_of(rows: DataFrame) -> int:
    """About how many sessions there are."""
    return rows.agg(F.approx_count_distinct(KEY)).first()[0]


def fold_together(rows: DataFrame, make: Callable[[int], object], inputs: list[str], outputs: str, keep: tuple[str, ...] = (ORDER,), sessions: int | None = None) -> DataFrame:
    """`fold` for estimators whose `steps(who, *columns)` takes a row each of many sessions at once.

    Sessions are dealt to blocks of about TOGETHER by a hash; within a block the first rows of all
    sessions come first, then the second ones, if ORDER counts rows. Memory is the states of one block
    and a batch of rows. A session is still one task. The number of `sessions`, about, is counted if not given.
    """
    sessions = sessions_of(rows) if sessions is None else sessions
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-sessions // TOGETHER), min(sessions, tasks))
    narrow = rows.select(F.pmod(F.xxhash64(KEY), F.lit(blocks)).alias("_block"), *dict.fromkeys((KEY, *keep, *inputs)))
    placed = narrow.repartition("_block").sortWithinPartitions("_block", ORDER, KEY)
    names = [part.split()[0] for part in outputs.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, estimator, slots = None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, order = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_block", ORDER))
            keys, columns = batch.column(KEY).to_pylist(), [batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]
            # a row begins a new step if its place is another, or if its session has a row in this step already
            again = np.array([a == b for a, b in zip(keys, keys[1:], strict=False)], bool)
            begins = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (order[1:] != order[:-1]) | again)))
            found = []
            for low, high in zip(begins, [*begins[1:], len(keys)], strict=True):
                if estimator is None or blocks[low] != block:
                    block, estimator, slots = blocks[low], make(0), {}
                who = np.array([slots.setdefault(key, len(slots)) for key in keys[low:high]])
                estimator.hold(len(slots))
                found.append(estimator.steps(who, *(c[low:high] for c in columns)))
            made = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + names)

    kept = [f.name for f in placed.schema.fields if f.name in (KEY, *keep)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in kept)
    return placed.mapInArrow(run, f"{kinds}, {outputs}")


def missing(x: float | None) -> bool:
    return x is None or (isinstance(x, float) and isnan(x))


class QualityMachine:
    """Four modes with counters against flutter; scores fixes by accuracy and satellites."""

    OUTPUTS = "mode string, score double, trust double, ai_active boolean, skip_gnss boolean"
    # Accuracy limits in metres, satellites, and rows until a change counts.
    GOOD_M, POOR_M, BLIND_M, SATELLITES = 10.0, 25.0, 50.0, 6
    RECOVER, DEGRADE, LOSE = 20, 5, 10

    def __init__(self) -> None:
        self.mode, self.poor, self.bad, self.fine = "GOOD", 0, 0, 0

    def score(self, available: bool, accuracy: float | None, satellites: float | None) -> float:
        if not available or missing(accuracy) or accuracy >= self.BLIND_M:
            value = 0.0
        elif accuracy <= self.GOOD_M:
            value = 1 - 0.2 * accuracy / self.GOOD_M
        elif accuracy <= self.POOR_M:
            value = 0.8 - 0.6 * (accuracy - self.GOOD_M) / (self.POOR_M - self.GOOD_M)
        else:
            value = max(0.0, 0.2 * (1 - (accuracy - self.POOR_M) / 25))
        return value * 0.7 if not missing(satellites) and satellites < self.SATELLITES else value

    def step(self, available: bool, accuracy: float | None, satellites: float | None = None) -> tuple:
        score = self.score(available, accuracy, satellites)
        if score >= 0.7:
            self.poor = self.bad = 0
            self.fine = 0 if self.mode == "GOOD" else self.fine + 1
            if self.mode != "GOOD":
                self.mode = "GOOD" if self.fine >= self.RECOVER else "RECOVERING"
                self.fine = 0 if self.mode == "GOOD" else self.fine
        elif score >= 0.2:
            self.fine, self.bad, self.poor = 0, 0, self.poor + 1
            self.mode = "DEGRADED" if self.poor >= self.DEGRADE else self.mode
        else:
            self.fine, self.poor, self.bad = 0, 0, self.bad + 1
            self.mode = "LOST" if self.bad >= self.LOSE else self.mode
        trust = {"GOOD": 1.0, "LOST": 0.0, "DEGRADED": max(0.1, score), "RECOVERING": 0.2 + 0.8 * min(1.0, max(0.1, self.fine / self.RECOVER))}[self.mode]
        return self.mode, score, trust, self.mode != "GOOD", self.mode == "LOST"


def distance_and_bearing(lat1: float, lng1: float, lat2: float, lng2: float) -> tuple[float, float]:
    a, b, d = radians(lat1), radians(lat2), radians(lng2 - lng1)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(d / 2) ** 2
    return 2 * RADIUS_EQUATOR * atan2(sqrt(h), sqrt(1 - h)), atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d))


def moved(lat: float, lng: float, metres: float, bearing: float) -> tuple[float, float]:
    d, a = metres / RADIUS_EQUATOR, radians(lat)
    to = asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(bearing))
    return degrees(to), lng + degrees(atan2(sin(bearing) * sin(d) * cos(a), cos(d) - sin(a) * sin(to)))


def at_origin(lat: float, lng: float) -> bool:
    return abs(lat) < 1e-4 and abs(lng) < 1e-4


class RateLimiter:
    """Holds positions to a largest speed and acceleration, measured against its own output."""

    OUTPUTS = "out_lat double, out_lng double, clamped boolean"

    def __init__(self, most_speed: float = 33.3, most_accel: float = 9.8) -> None:
        self.most_speed, self.most_accel = most_speed, most_accel
        self.last: tuple[float, float, float] | None = None
        self.speed = 0.0

    def step(self, t_ms: float, lat: float, lng: float) -> tuple:
        before, self.last = self.last, (t_ms, lat, lng)
        dt = (t_ms - before[0]) / 1000 if before else 0.0
        if before is None or at_origin(*before[1:]) or at_origin(lat, lng) or dt <= 0 or dt > 10:
            self.speed = 0.0
            return lat, lng, False
        metres, bearing = distance_and_bearing(before[1], before[2], lat, lng)
        speed = metres / dt
        change = speed - self.speed
        if speed > self.most_speed:
            allowed = self.most_speed
        elif dt >= 0.08 and metres > 1 and abs(change) / dt > self.most_accel:
            allowed = min(max(0.0, self.speed + (self.most_accel if change > 0 else -self.most_accel) * dt), self.most_speed)
        else:
            self.speed = speed
            return lat, lng, False
        self.speed = allowed
        to = moved(before[1], before[2], allowed * dt, bearing)
        self.last = (t_ms, *to)
        return *to, True


class Smoother:
    """Constant-velocity Kalman filter of latitude and longitude.

    Both axes have the same noise, so they share one covariance of position and velocity.
    """

    OUTPUTS = "out_lat double, out_lng double, smoothed boolean"

    def __init__(self, q_position: float = 1e-9, q_velocity: float = 1e-5) -> None:
        self.q_position, self.q_velocity = q_position, q_velocity
        self.t: float | None = None
        self.position, self.velocity = [0.0, 0.0], [0.0, 0.0]
        self.pp = self.pv = self.vv = 0.0

    def step(self, t_ms: float, lat: float, lng: float, state: str) -> tuple:
        if at_origin(lat, lng):
            return lat, lng, False
        if self.t is None or abs(t_ms - self.t) > 10_000:
            self.t, self.position, self.velocity = t_ms, [lat, lng], [0.0, 0.0]
            self.pp, self.pv, self.vv = 1e-9, 0.0, 1e-9
            return lat, lng, False
        dt = (t_ms - self.t) / 1000
        if dt <= 0:
            return *self.position, True
        self.t = t_ms
        self.pp += 2 * dt * self.pv + dt * dt * self.vv + self.q_position * dt
        self.pv += dt * self.vv
        self.vv += self.q_velocity * dt
        total = self.pp + (1e-8 if state in ("DEGRADED", "WEAK_LOST") else 1e-10)
        gain_p, gain_v = self.pp / total, self.pv / total
        for axis, seen in enumerate((lat, lng)):
            self.position[axis] += dt * self.velocity[axis]
            surprise = seen - self.position[axis]
            self.position[axis] += gain_p * surprise
            self.velocity[axis] += gain_v * surprise
        self.vv -= gain_v * self.pv
        self.pv -= gain_p * self.pv
        self.pp -= gain_p * self.pp
        return *self.position, True


class Stabiliser:
    """Rate limiter, then smoother; both start anew where a lost signal turns good."""

    OUTPUTS = "out_lat double, out_lng double, clamped boolean, smoothed boolean"

    def __init__(self) -> None:
        self.limiter, self.smoother, self.state = RateLimiter(), Smoother(), None

    def step(self, t_ms: float, lat: float, lng: float, state: str) -> tuple:
        if self.state == "WEAK_LOST" and state == "GOOD":
            self.limiter, self.smoother = RateLimiter(), Smoother()
        self.state = state
        lat, lng, clamped = self.limiter.step(t_ms, lat, lng)
        lat, lng, smoothed = self.smoother.step(t_ms, lat, lng, state)
        return lat, lng, clamped, smoothed


def toward(old: float, new: float, share: float) -> float:
    """A share of the shorter way from one heading to another."""
    turn = (new - old) % 360
    return (old + share * (turn - 360 if turn > 180 else turn)) % 360


class HeadingFusion:
    """Heading from compass, track, trajectory and turn rate, by speed and signal; then a step of 0.2 toward it."""

    OUTPUTS = "fused_heading double"

    def __init__(self, first: float = 0.0) -> None:
        self.heading = first

    def target(self, gnss: bool, kmh: float, compass: float | None, track: float | None, trajectory: float | None, rate: float | None, dt: float) -> float:
        def first(*options: float | None) -> float:
            return next((x for x in options if not missing(x)), self.heading)

        if not gnss:
            if not missing(rate) and abs(rate) > 0.1:
                turned = self.heading + rate * dt
                return turned % 360 if missing(trajectory) else toward(turned, trajectory, 0.15)
            return first(trajectory, compass)
        if kmh > 5:
            if missing(track):
                return first(trajectory, compass)
            return track if missing(trajectory) else toward(track, trajectory, 0.3)
        if kmh > 2:
            base = first(compass)
            return toward(base, next((x for x in (trajectory, track) if not missing(x)), base), 0.5)
        return first(compass, trajectory)

    def step(self, gnss: bool, kmh: float, compass: float | None, track: float | None, trajectory: float | None, rate: float | None, dt: float) -> tuple:
        self.heading = toward(self.heading, self.target(gnss, kmh, compass, track, trajectory, rate, dt), 0.2)
        return (self.heading,)


class Ins:
    """Inertial positions of a session: trapezoid velocity with damping at rest and a clamp, trapezoid position.

    Inputs are accelerations without bias in the navigation frame, and the magnitudes that tell rest.
    """

    OUTPUTS = "vel_x double, vel_y double, pos_x double, pos_y double, damped boolean"

    def __init__(self) -> None:
        self.last: tuple[float, float, float] | None = None
        self.v, self.p = [0.0, 0.0], [0.0, 0.0]

    def step(self, t: float, ax: float, ay: float, gyro: float, accel: float) -> tuple:
        damped = False
        if self.last is not None:
            dt = max(t - self.last[0], 1e-6)
            damped = gyro < 0.08 and abs(accel - GRAVITY_STANDARD) < 0.35
            for axis, (now, before) in enumerate(zip((ax, ay), self.last[1:], strict=True)):
                old = self.v[axis]
                new = old + 0.5 * (now + before) * dt
                self.v[axis] = min(45.0, max(-45.0, new * 0.85 if damped else new))
                self.p[axis] += 0.5 * (self.v[axis] + old) * dt
        self.last = (t, ax, ay)
        return *self.v, *self.p, damped


class InsTracker:
    """The live variant: zeros while the bias is measured on the first 100 samples, rectangular positions, no damping or clamp."""

    OUTPUTS = "vel_x double, vel_y double, pos_x double, pos_y double"

    def __init__(self, samples: int = 100) -> None:
        self.samples, self.count, self.bias = samples, 0, [0.0, 0.0]
        self.before, self.v, self.p = [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]

    def step(self, dt: float, ax: float, ay: float, yaw: float) -> tuple:
        if self.count < self.samples:
            self.count += 1
            self.bias = [b + (a - b) / self.count for a, b in zip((ax, ay), self.bias, strict=True)]
            if self.count < self.samples:
                return 0.0, 0.0, 0.0, 0.0
        x, y, turn = ax - self.bias[0], ay - self.bias[1], radians(yaw)
        for axis, now in enumerate((y * sin(turn) + x * cos(turn), y * cos(turn) - x * sin(turn))):
            if dt > 0:
                self.v[axis] += 0.5 * (now + self.before[axis]) * dt
                self.p[axis] += self.v[axis] * dt
            self.before[axis] = now
        return *self.v, *self.p


def matrix(*rows: tuple) -> np.ndarray:
    """A matrix, or one for each session, from its elements."""
    shape = np.broadcast_shapes(*(np.shape(x) for row in rows for x in row))
    return np.stack([np.stack([np.broadcast_to(x, shape) for x in row], -1) for row in rows], -2)


def inverses(S: np.ndarray) -> np.ndarray:
    """Inverses; not a number where there is none."""
    try:
        return np.linalg.inv(S)
    except np.linalg.LinAlgError:
        return np.full_like(S, np.nan) if S.ndim == 2 else np.stack([inverses(one) for one in S])


class Ekf:
    """Kalman filter over position, velocity, attitude, accelerometer bias and gyroscope bias, three axes each.

    Of one session, or of as many as `lead` says, which then is the first axis of all arrays.
    """

    # First variances of the five blocks, process variances per second, and gates.
    FIRST = (0.1, 0.1, 1e-3, 1e-4, 1e-5)
    NOISE = (0.25, 1.0, 1e-6, 1e-6, 1e-7)
    GATE_POSITION, GATE_SIX, GATE_VELOCITY, FASTEST = 9.21, 25.0, 50.0, 60.0
    STATE = ("levelled", "attitude", "position", "velocity", "bias", "P", "cooling")

    def __init__(self, *lead: int) -> None:
        self.lead = lead
        self.levelled = np.zeros(lead, bool)
        self.attitude = np.zeros((*lead, 3))
        self.reset(0.0, 0.0)

    def reset(self, x: float | np.ndarray, y: float | np.ndarray) -> None:
        self.position, self.velocity = np.stack(np.broadcast_arrays(x, y, np.zeros(self.lead)), -1), np.zeros((*self.lead, 3))
        self.bias = np.zeros((*self.lead, 6))
        self.P = np.broadcast_to(np.diag(np.repeat(self.FIRST, 3)), (*self.lead, 15, 15)).copy()
        self.cooling = np.zeros(self.lead, int)

    def of(self, who: np.ndarray) -> Ekf:
        """The filter of some sessions, to be put back."""
        some = Ekf.__new__(Ekf)
        for name in self.STATE:
            setattr(some, name, getattr(self, name)[who])
        some.lead = some.levelled.shape
        return some

    def put(self, who: np.ndarray, some: Ekf) -> None:
        for name in self.STATE:
            getattr(self, name)[who] = getattr(some, name)

    def more(self, sessions: int) -> None:
        new = Ekf(sessions)
        for name in self.STATE:
            setattr(self, name, np.concatenate((getattr(self, name), getattr(new, name))))
        self.lead = self.levelled.shape

    def level(self, accel: np.ndarray) -> None:
        """Roll and pitch from gravity, once."""
        x, y, z = np.moveaxis(accel, -1, 0)
        level = np.stack([np.arctan2(-x, np.hypot(y, z)), np.arctan2(y, z), np.zeros_like(x)], -1)
        self.attitude = np.where(self.levelled[..., None], self.attitude, level)
        self.levelled = np.ones(self.lead, bool)

    def rotation(self) -> np.ndarray:
        (cr, cp, cy), (sr, sp, sy) = np.moveaxis(np.cos(self.attitude), -1, 0), np.moveaxis(np.sin(self.attitude), -1, 0)
        turn_z = matrix((cy, -sy, 0), (sy, cy, 0), (0, 0, 1))
        turn_y = matrix((cp, 0, sp), (0, 1, 0), (-sp, 0, cp))
        turn_x = matrix((1, 0, 0), (0, cr, -sr), (0, sr, cr))
        return turn_z @ turn_y @ turn_x

    def predict(self, dt: float | np.ndarray, accel: np.ndarray | None = None, gyro: np.ndarray | None = None, velocity: np.ndarray | None = None) -> None:
        """Propagate; a given horizontal velocity replaces the filter's own."""
        dt = np.broadcast_to(np.where(np.greater(dt, 1e-3), dt, 1e-3), self.lead)
        gravity = np.array([0.0, 0.0, GRAVITY_STANDARD])
        accel, gyro = gravity if accel is None else accel, np.zeros(3) if gyro is None else gyro
        if not self.levelled.all():
            self.level(accel)
        each, wide = dt[..., None], dt[..., None, None]
        self.attitude = self.attitude + (gyro - self.bias[..., 3:]) * each
        turn = self.rotation()
        force = (turn @ (accel - self.bias[..., :3])[..., None])[..., 0] - gravity
        if velocity is None:
            self.velocity = self.velocity + force * each
        else:
            self.velocity = np.concatenate([velocity, self.velocity[..., velocity.shape[-1] :]], -1)
        self.position = self.position + self.velocity * each
        x, y, z = np.moveaxis(force, -1, 0)
        F = np.broadcast_to(np.eye(15), (*self.lead, 15, 15)).copy()
        F[..., 0:3, 3:6] = np.eye(3) * wide
        F[..., 3:6, 6:9] = matrix((0, z, -y), (-z, 0, x), (y, -x, 0)) * wide
        F[..., 3:6, 9:12] = F[..., 6:9, 12:15] = -turn * wide
        noise = np.repeat(self.NOISE, 3) * each
        cooling = self.cooling > 0
        noise[..., 3:6] = np.where(cooling[..., None], 2 * each, noise[..., 3:6])
        self.cooling = self.cooling - cooling
        self.P = F @ self.P @ F.swapaxes(-1, -2)
        self.P[..., range(15), range(15)] += noise

    def update(self, H: np.ndarray, surprise: np.ndarray, R: np.ndarray, gate: float = float("inf"), rows: np.ndarray | bool = True) -> np.ndarray:
        """Take a measurement (of `rows`) unless its squared Mahalanobis distance is beyond the gate; Joseph form. Says whether it was taken."""
        across = H.swapaxes(-1, -2)
        inverse = inverses(H @ self.P @ across + R)
        far = ((surprise[..., None, :] @ inverse) @ surprise[..., None])[..., 0, 0]
        taken = rows & ~np.isnan(inverse[..., 0, 0]) & ~(far > gate)
        K = self.P @ across @ inverse
        d = (K @ surprise[..., None])[..., 0]
        one, two = taken[..., None], taken[..., None, None]
        self.position, self.attitude = np.where(one, self.position + d[..., 0:3], self.position), np.where(one, self.attitude + d[..., 6:9], self.attitude)
        self.bias = np.where(one, self.bias + d[..., 9:15], self.bias)
        self.velocity = np.where(one, np.clip(self.velocity + d[..., 3:6], -self.FASTEST, self.FASTEST), self.velocity)
        rest = np.eye(15) - K @ H
        self.P = np.where(two, rest @ self.P @ rest.swapaxes(-1, -2) + K @ R @ K.swapaxes(-1, -2), self.P)
        return taken

    def update_gnss(self, position: np.ndarray, accuracy: float | np.ndarray | None = None, velocity: np.ndarray | None = None) -> np.ndarray:
        known = np.asarray(0.0 if accuracy is None else accuracy, float)
        spread = np.broadcast_to(np.maximum(0.1, np.where(known > 0, known, 5.0) ** 2), self.lead)[..., None, None]
        seen = np.zeros((*self.lead, 3))
        seen[..., : position.shape[-1]] = position
        if velocity is None:
            return self.update(np.eye(3, 15), seen - self.position, np.eye(3) * spread, self.GATE_POSITION)
        speed = np.zeros((*self.lead, 3))
        speed[..., : velocity.shape[-1]] = velocity
        R = np.diag([1.0] * 3 + [0.0] * 3) * spread + np.diag([0.0] * 3 + [0.5] * 3)
        return self.update(np.eye(6, 15), np.concatenate([seen - self.position, speed - self.velocity], -1), R, self.GATE_SIX)

    def update_velocity(self, velocity: np.ndarray, deviation: float = 0.5) -> np.ndarray:
        return self.update(np.eye(15)[3:5], velocity - self.velocity[..., :2], np.eye(2) * deviation**2, self.GATE_VELOCITY)

    def update_rest(self) -> None:
        self.update(np.eye(15)[3:6], -self.velocity, np.eye(3) * 1e-3)
        self.velocity = np.zeros((*self.lead, 3))

    def update_no_side_slip(self, deviation: float = 0.2) -> np.ndarray:
        x, y = self.velocity[..., 0], self.velocity[..., 1]
        heading = np.arctan2(y, x)
        H = np.zeros((*self.lead, 1, 15))
        H[..., 0, 3], H[..., 0, 4] = -np.sin(heading), np.cos(heading)
        return self.update(H, -(H[..., 3:6] @ self.velocity[..., None])[..., 0], np.array([[deviation**2]]), self.GATE_VELOCITY, ~(np.hypot(x, y) < 0.1))


class FusionDriver:
    """Sessions through the filter, each: predict, judge the signal, correct by the model, then by the fix.

    Five fixes rejected in a row put the filter on the fix.
    """

    OUTPUTS = "pos_x double, pos_y double, vel_x double, vel_y double, pos_sigma double, vel_sigma double, mode string, ai_active boolean"

    def __init__(self, sessions: int = 1) -> None:
        self.ekf, self.machines, self.t, self.rejected = Ekf(0), [], np.empty(0), np.empty(0, int)
        self.begun = np.empty(0, bool)
        self.hold(sessions)

    def hold(self, sessions: int) -> None:
        """Make room for sessions that begin."""
        new = sessions - len(self.machines)
        if new > 0:
            self.ekf.more(new)
            self.machines += [QualityMachine() for _ in range(new)]
            self.t, self.rejected = np.append(self.t, np.full(new, np.nan)), np.append(self.rejected, np.zeros(new, int))
            self.begun = np.append(self.begun, np.zeros(new, bool))

    def step(self, *row: float | bool | None) -> tuple:
        """The row of the only session."""
        return tuple(c.tolist()[0] for c in self.steps(np.zeros(1, int), *(np.array([np.nan if missing(x) else x]) for x in row)))

    def steps(self, who: np.ndarray, t: np.ndarray, ins_x: np.ndarray, ins_y: np.ndarray, fix_x: np.ndarray, fix_y: np.ndarray, available: np.ndarray, accuracy: np.ndarray, satellites: np.ndarray, ai_x: np.ndarray, ai_y: np.ndarray) -> tuple:
        """A row each of the sessions `who`; what is missing is not a number."""
        t, ins_x, ins_y, fix_x, fix_y, accuracy, satellites, ai_x, ai_y = (np.asarray(c, float) for c in (t, ins_x, ins_y, fix_x, fix_y, accuracy, satellites, ai_x, ai_y))
        ekf = self.ekf.of(who)

        def on(rows: np.ndarray, act: Callable) -> np.ndarray | None:
            if not rows.any():
                return np.zeros(0, bool)
            if rows.all():
                return act(ekf, rows)
            some = ekf.of(rows)
            said = act(some, rows)
            ekf.put(rows, some)
            return said

        ins, fix, ai = np.stack([ins_x, ins_y], -1), np.stack([fix_x, fix_y], -1), np.stack([ins_x + ai_x, ins_y + ai_y], -1)
        has_fix, first, before = ~np.isnan(fix).any(-1), ~self.begun[who], self.t[who]
        on(first & has_fix, lambda e, rows: e.reset(fix_x[rows], fix_y[rows]))
        on(~first, lambda e, rows: e.predict((t - before)[rows], velocity=ins[rows]))
        self.t[who], self.begun[who] = t, True
        judged = [self.machines[w].step(a is True or a == 1, acc, sats) for w, a, acc, sats in zip(who.tolist(), available.tolist(), accuracy.tolist(), satellites.tolist(), strict=True)]
        mode, _, trust, active, skip = (np.array(c) for c in zip(*judged, strict=True))
        by_model = active & ~np.isnan(ai_x)
        on(by_model, lambda e, rows: e.update_velocity(ai[rows]))
        on(by_model & ((mode == "DEGRADED") | (mode == "LOST")), lambda e, rows: e.update_no_side_slip())
        by_fix = ~skip & has_fix
        spread = np.where(accuracy > 0, accuracy, 5.0) / np.maximum(0.05, trust)
        taken = on(by_fix, lambda e, rows: e.update_gnss(fix[rows], spread[rows]))
        rejected = self.rejected[who]
        rejected[by_fix] = np.where(taken, 0, rejected[by_fix] + 1)
        on(by_fix & (rejected >= 5), lambda e, rows: e.reset(fix_x[rows], fix_y[rows]))
        rejected[rejected >= 5] = 0
        self.rejected[who] = rejected
        self.ekf.put(who, ekf)
        P = ekf.P
        return *ekf.position[:, :2].T, *ekf.velocity[:, :2].T, np.sqrt(P[:, 0, 0] + P[:, 1, 1]), np.sqrt(P[:, 3, 3] + P[:, 4, 4]), mode, active


class Thinning:
    """Lets a row through when `interval_ms` have passed since the last one let through."""

    OUTPUTS = "emitted boolean"

    def __init__(self, interval_ms: float = 950.0) -> None:
        self.interval, self.last = interval_ms, None

    def step(self, t_ms: float) -> tuple:
        if self.last is not None and t_ms - self.last < self.interval:
            return (False,)
        self.last = t_ms
        return (True,)


class PrefetchTrigger:
    """Fires after 500 m, or after 30 s and 30 m while moving, since it last fired."""

    OUTPUTS = "prefetch boolean"

    def __init__(self) -> None:
        self.last: tuple[float, float, float] | None = None

    def step(self, t_ms: float, lat: float, lng: float, speed_mps: float) -> tuple:
        if self.last is not None:
            metres, _ = distance_and_bearing(self.last[1], self.last[2], lat, lng)
            timed = t_ms - self.last[0] >= 30_000 and speed_mps > 0.5 and metres >= 30
            if metres < 500 and not timed:
                return (False,)
        self.last = (t_ms, lat, lng)
        return (True,)


class RollingScorer:
    """Keeps the last `size` feature rows and scores them once it has that many; zeros before."""

    OUTPUTS = "score_x double, score_y double"

    def __init__(self, score: Callable[[np.ndarray], np.ndarray], size: int = 20) -> None:
        self.score, self.rows = score, deque(maxlen=size)

    def step(self, *features: float) -> tuple:
        self.rows.append([0.0 if missing(f) or abs(f) == float("inf") else f for f in features])
        if len(self.rows) < self.rows.maxlen:
            return 0.0, 0.0
        found = self.score(np.array([self.rows], dtype=np.float32))[0]
        return float(found[0]), float(found[1])


def wrapped(angle: float) -> float:
    return (angle + pi) % (2 * pi) - pi
