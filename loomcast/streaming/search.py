"""Where to look and how to steer while no animal is in view, and the whole guidance of a vehicle.

The parts know nothing of each other: what is known of depths (`Bands`), which water was visited
(`Wake`), how far down one can go (`Reach`), what to do across (`Course`); `Search` asks them in turn.
All are machines of one row at a time, as in `machines`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..functions.seeds import derive_seed
from ..operators.planner import CORRIDOR, DAWN, DUSK, NIGHT_DEPTH, PRIOR_PER_MIN, PRIOR_S, SUNRISE, SUNSET
from .machines import Curiosity, Flash, Guide, Held, Lamp, Novelty


def turn(degrees: float) -> float:
    """The same turn, the shorter way."""
    return (degrees + 180.0) % 360.0 - 180.0


def within(x: float, most: float, least: float | None = None) -> float:
    return max(-most if least is None else least, min(most, x))


def after(hour: float, mark: float) -> float:
    return (hour - mark + 12.0) % 24.0 - 12.0


def crossing(hour: float) -> bool:
    """Whether animals cross the corridor at this hour."""
    return DUSK[0] <= after(hour, SUNSET) <= DUSK[1] or DAWN[0] <= after(hour, SUNRISE) <= DAWN[1]


@dataclass
class Bands:
    """Seconds searched and animals met in bands of depth, both halved every `half_life`, and a draw of
    the band with the most to expect (Gamma-Poisson, with a prior that depends on the hour)."""

    least: float = 20.0
    most: float = 200.0
    width: float = 10.0
    half_life: float = 1200.0
    seed: int = 0
    draws: int = 0
    searched: list[float] = field(default_factory=list)
    met: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        n = max(1, round((self.most - self.least) / self.width))
        self.searched, self.met = self.searched or [0.0] * n, self.met or [0.0] * n

    def middle(self, i: int) -> float:
        return self.least + (i + 0.5) * self.width

    def of(self, depth: float) -> int:
        return int(within((depth - self.least) // self.width, len(self.met) - 1, 0))

    def pass_time(self, dt: float) -> None:
        left = 0.5 ** (dt / self.half_life) if self.half_life > 0 else 1.0
        self.searched, self.met = ([x * left for x in xs] for xs in (self.searched, self.met))

    def add(self, depth: float, seconds: float, found: bool) -> None:
        i = self.of(depth)
        self.searched[i] += seconds
        self.met[i] += found

    def prior(self, i: int, hour: float) -> float:
        if crossing(hour):
            return 3.0 if CORRIDOR[0] <= self.middle(i) <= CORRIDOR[1] else 1.0
        if SUNRISE <= hour < SUNSET:
            return 1.0
        return 0.5 + 2.0 * math.exp(-0.5 * ((self.middle(i) - NIGHT_DEPTH) / 40.0) ** 2)

    def rates(self) -> list[float]:
        """Animals a minute, with the prior."""
        return [60.0 * (m + PRIOR_PER_MIN / 60.0 * PRIOR_S) / (s + PRIOR_S) for m, s in zip(self.met, self.searched)]

    def choose(self, hour: float, low: float, high: float) -> int:
        self.draws += 1
        rng = np.random.default_rng(derive_seed(self.seed, "bands", str(self.draws)))
        half, every = self.width / 2, range(len(self.met))
        open_ = [i for i in every if low - half <= self.middle(i) <= high + half] or list(every)
        draw = {i: rng.gamma(max(self.met[i] + PRIOR_PER_MIN / 60.0 * PRIOR_S * self.prior(i, hour), 1e-3)) / (self.searched[i] + PRIOR_S) for i in open_}
        return max(draw, key=draw.get)


@dataclass
class Reach:
    """The depths that can be gone to: first one sweep down and up, in which a way without progress for
    `stall_s` ends where it is; and a floor from the altimeter, kept for a while when that is silent."""

    least: float = 20.0
    most: float = 200.0
    near: float = 5.0
    stall_s: float = 60.0
    altitude: float = 5.0
    floor_s: float = 300.0
    sweep: list[str] = field(default_factory=lambda: ["down", "up"])
    low: float = 20.0
    high: float = 200.0
    best: tuple[float, float] = (math.inf, 0.0)  # how near the goal it came, and when
    steered: float = -math.inf
    floor: tuple[float, float] | None = None

    def sound(self, t: float, depth: float, altitude: float | None) -> None:
        if altitude is not None:
            self.floor = depth + altitude - self.altitude, t
        elif self.floor is not None and t - self.floor[1] > self.floor_s:
            self.floor = None

    def goal(self, t: float, depth: float) -> float | None:
        """The end of the sweep that is under way, None once it is done."""
        if t - self.steered > 2.0:  # others steered meanwhile
            self.best = math.inf, t
        self.steered = t
        while self.sweep:
            down = self.sweep[0] == "down"
            goal = self.most if down else self.least
            off = abs(depth - goal)
            if off < self.best[0] - 1.0:
                self.best = off, t
            stalled = off >= self.near and t - self.best[1] > self.stall_s
            if stalled and down:
                self.high = max(depth, self.least)
            elif stalled:
                self.low = min(depth, self.most)
            if off >= self.near and not stalled:
                return goal
            self.sweep, self.best = self.sweep[1:], (math.inf, t)
            if down:
                return None if not self.sweep else self.least
        return None

    def hold(self, depth: float) -> float:
        return depth if self.floor is None else min(depth, self.floor[0])


@dataclass
class Wake:
    """Where the vehicle is in the water, by its heading and speed, and when it was in which cell."""

    cell: float = 20.0
    half_life: float = 900.0
    x: float = 0.0
    y: float = 0.0
    seen: dict[tuple[int, int], float] = field(default_factory=dict)

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return int(x // self.cell), int(y // self.cell)

    def move(self, t: float, heading: float, metres: float) -> None:
        a = math.radians(heading)
        self.x, self.y = self.x + metres * math.sin(a), self.y + metres * math.cos(a)
        self.seen[self._cell(self.x, self.y)] = t

    def visited(self, t: float, heading: float, metres: float, steps: int = 6) -> float:
        """How much of a way ahead was visited, lately counting most."""
        a = math.radians(heading)
        far = np.linspace(self.cell, max(self.cell, metres), steps)
        when = [self.seen.get(self._cell(self.x + d * math.sin(a), self.y + d * math.cos(a))) for d in far.tolist()]
        return sum(0.5 ** ((t - w) / self.half_life) for w in when if w is not None)


#: Seconds of each phase of a pattern and whether it moves, in their order.
PATTERNS = {"cruise": (("transect", 600.0, True), ("drift", 240.0, False)), "hover": (("hover", 420.0, False), ("relocate", 150.0, True))}


@dataclass
class Course:
    """The heading and speed across. By itself a pattern: legs and drifts, or in the crossings hovering
    and short ways out of the own disturbance. After an animal, for a while, loops about the place or
    a straight way off."""

    surge: float = 0.35
    loop_surge: float = 0.2
    speed: float = 0.6
    turn_deg: float = 120.0
    headings: int = 12
    radius: float = 5.0
    spacing: float = 5.0
    away_m: float = 40.0
    seed: int = 0
    draws: int = 0
    phase: str | None = None
    until: float = 0.0
    heading: float | None = None
    special: dict[str, Any] | None = None

    def _rng(self) -> np.random.Generator:
        self.draws += 1
        return np.random.default_rng(derive_seed(self.seed, "course", str(self.draws)))

    def loops(self, t: float, seconds: float, wake: Wake) -> None:
        self.special = {"mode": "loops", "from": t, "to": t + seconds, "x": wake.x, "y": wake.y, "side": 1.0 if self._rng().random() < 0.5 else -1.0}

    def move_on(self, t: float) -> None:
        self.special = {"mode": "move_on", "to": t + 3.0 * self.away_m / max(1e-3, self.surge * self.speed), "heading": None}

    def _new_leg(self, t: float, heading: float, seconds: float, wake: Wake) -> float:
        """A turn of at least 45 degrees to the water that was visited least."""
        rng = self._rng()
        ways = [d for d in np.linspace(-180, 180, self.headings, endpoint=False).tolist() if abs(turn(d)) >= 45] + [self.turn_deg, -self.turn_deg]
        cost = [wake.visited(t, heading + d, self.surge * self.speed * seconds) + 0.05 * rng.random() for d in ways]
        return (heading + ways[int(np.argmin(cost))]) % 360.0

    def _pattern(self, t: float, heading: float, hover: bool, wake: Wake) -> float:
        phases = PATTERNS["hover" if hover else "cruise"]
        names = [p[0] for p in phases]
        if self.phase not in names or t >= self.until:
            name, seconds, moves = phases[(names.index(self.phase) + 1) % 2 if self.phase in names else 0]
            seconds *= 0.8 + 0.4 * self._rng().random() if name == "transect" else 1.0
            self.phase, self.until = name, t + seconds
            self.heading = self._new_leg(t, heading, seconds, wake) if moves else heading
        return self.surge if dict((p[0], p[2]) for p in phases)[self.phase] else 0.0

    def step(self, t: float, heading: float, hover: bool, wake: Wake) -> float:
        """The surge to go with; `heading` is set to where to."""
        s = self.special
        if s is not None and (t >= s["to"] or s["mode"] == "move_on" and s["heading"] is not None and math.hypot(wake.x - s["x"], wake.y - s["y"]) >= self.away_m):
            self.special = s = None
            self.phase, self.until = self.phase, t
        if s is None:
            return self._pattern(t, heading, hover, wake)
        if s["mode"] == "move_on":
            if s["heading"] is None:
                s |= {"heading": heading, "x": wake.x, "y": wake.y}
            self.heading = s["heading"]
            return self.surge
        dx, dy = wake.x - s["x"], wake.y - s["y"]
        off = math.hypot(dx, dy)
        wanted = math.sqrt(self.radius**2 + self.spacing * max(1e-3, self.loop_surge * self.speed) * (t - s["from"]) / math.pi)
        inward = within(8.0 * (off - wanted), 60.0)
        self.heading = heading if off < 0.5 else (math.degrees(math.atan2(dx, dy)) + s["side"] * (90.0 + inward)) % 360.0
        return self.loop_surge


@dataclass
class Search:
    """The planner. A row has t, hour, searching, detected, depth, heading and altitude (null: unknown),
    surge (as commanded) and ended, how an animal that was just left behaved, or null. `strategy` is
    adaptive, or for comparison depth (bands, turning in place), legs (no bands) or scan.

    Answers the setpoints heading and depth with the rates that steer to them, and the mode.
    """

    strategy: str = "adaptive"
    onset_s: float = 3.0
    dwell_s: float = 180.0
    layer_s: float = 600.0
    loop_s: float = 180.0
    giveup_s: float = 90.0
    scan_s: float = 20.0
    hop_s: float = 30.0
    scan_yaw: float = 0.15
    bands: Bands = field(default_factory=Bands)
    reach: Reach = field(default_factory=Reach)
    wake: Wake = field(default_factory=Wake)
    course: Course = field(default_factory=Course)
    t: float | None = None
    seen: float = -math.inf
    band: tuple[int, float] | None = None
    layer: tuple[float, float] | None = None

    def _observe(self, row: dict[str, Any]) -> None:
        t, depth = row["t"], row["depth"]
        dt, self.t = max(0.0, t - (t if self.t is None else self.t)), t
        self.bands.pass_time(dt)
        new = bool(row["detected"]) and t - self.seen > self.onset_s
        self.seen = t if row["detected"] else self.seen
        if depth is not None:
            self.reach.sound(t, depth, row["altitude"])
            if row["searching"]:
                self.bands.add(depth, dt, new)
        if row["heading"] is not None:
            self.wake.move(t, row["heading"], row["surge"] * self.course.speed * dt)
        if new and row["searching"]:
            self.course.loops(t, self.giveup_s, self.wake)
        match row["ended"]:
            case "swarm":
                self.course.loops(t, self.loop_s, self.wake)
            case "mobile":
                self.course.move_on(t)
            case "drifter":
                self.course.special = None
                self.layer = (depth, t + self.layer_s) if depth is not None else self.layer

    def _depth(self, t: float, depth: float, hour: float) -> float:
        goal = self.reach.goal(t, depth)
        if goal is None and self.layer is not None and t < self.layer[1]:
            goal = within(self.layer[0], self.reach.high, self.reach.low)
        if goal is None:
            if self.band is None or t >= self.band[1]:
                self.band = self.bands.choose(hour, self.reach.low, self.reach.high), t + self.dwell_s
            goal = self.bands.middle(self.band[0])
        return self.reach.hold(goal)

    def step(self, row: dict[str, Any]) -> dict[str, Any]:
        self._observe(row)
        t, depth, heading = row["t"], row["depth"], row["heading"]
        out = {"yaw": 0.0, "heave": 0.0, "surge": 0.0, "heading": None, "depth": None, "mode": self.strategy}
        swinging = -1.0 if t // self.scan_s % 2 else 1.0
        if self.strategy in ("scan", "depth"):
            out["yaw"] = swinging * self.scan_yaw
        elif heading is None:  # look around, then go on a little
            hopping = t % (self.scan_s + self.hop_s) >= self.scan_s
            out |= {"surge": self.course.surge, "mode": "hop"} if hopping else {"yaw": self.scan_yaw, "mode": "look"}
        else:
            surge = self.course.step(t, heading, crossing(row["hour"]), self.wake)
            off = turn(self.course.heading - heading)
            out |= {"yaw": within(0.02 * off, 0.6), "surge": surge if abs(off) < 45 else 0.0, "heading": self.course.heading, "mode": self.course.special["mode"] if self.course.special else self.course.phase}
        if depth is not None and self.strategy in ("adaptive", "depth"):
            out["depth"] = self._depth(t, depth, row["hour"])
            out["heave"] = within(-0.15 * (out["depth"] - depth), 0.6)
            out["mode"] = "profile" if self.reach.sweep else out["mode"]
        return out


@dataclass
class Steer:
    """Rates of turn, rise and thrust, none of which may jump.

    A row has t, mode and what the mode needs: track (yaw, pitch, yaw_rate, size, approach), lost (yaw,
    where it was last), release (elapsed, away, heading, goal: the heading to leave on), search (yaw,
    heave, surge, as planned); other modes stop. Fixed values: the gains and limits.
    """

    per_s: float = 2.0
    dead_deg: float = 2.0
    size: float = 0.22
    standoff: float = 0.40
    ahead: float = 0.5
    t: float | None = None
    last: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def _off(self, degrees: float) -> float:
        """What of an error is outside the dead band."""
        return math.copysign(max(0.0, abs(degrees) - self.dead_deg), degrees)

    def _track(self, row: dict[str, Any]) -> tuple[float, float, float]:
        yaw = within(0.035 * self._off(row["yaw"]) + 0.004 * (row.get("yaw_rate") or 0.0), 0.8)
        heave = within(0.03 * self._off(row["pitch"]), 0.6)
        if row["size"] > self.standoff:
            return yaw, heave, -0.3  # too near, wherever it is
        ahead = max(abs(row["yaw"]), abs(row["pitch"])) < 15.0 and row.get("approach", True)
        return yaw, heave, within(3.0 * (self.size - row["size"]), self.ahead, -0.3) if ahead else 0.0

    def _release(self, row: dict[str, Any]) -> tuple[float, float, float]:
        if row["elapsed"] < 1.5:
            return 0.0, 0.0, -0.2
        if row.get("heading") is not None and row.get("goal") is not None:
            off = turn(row["goal"] - row["heading"])
            return within(0.02 * off, 0.6), 0.0, 0.3 if abs(off) < 20.0 else 0.0
        return (math.copysign(0.6, row["away"]), 0.0, 0.0) if row["elapsed"] < 5.5 else (0.0, 0.0, 0.3)

    def step(self, row: dict[str, Any]) -> dict[str, Any]:
        match row["mode"]:
            case "track":
                want = self._track(row)
            case "lost":
                want = math.copysign(0.3, row["yaw"] or 1.0), 0.0, 0.0
            case "release":
                want = self._release(row)
            case "search":
                want = row["yaw"], row["heave"], row["surge"]
            case _:
                want = 0.0, 0.0, 0.0
        most = self.per_s * (0.1 if self.t is None else max(1e-3, row["t"] - self.t))
        self.t = row["t"]
        self.last = tuple(old + within(new - old, most) for new, old in zip(want, self.last))
        return dict(zip(("yaw", "heave", "surge"), self.last))


@dataclass
class Pilot:
    """The whole guidance of a vehicle in its fixed order: track and phases and encounters, novelty,
    flashes and cues, the planner, the rates and the lamp.

    A row is Guide's with hour, depth, heading, altitude, luma, grid (of brightness, or null) and weak
    (the place of a weak detection, or null). The answer is Guide's with novelty, look, search, command
    and lamp.
    """

    guide: Guide = field(default_factory=Guide)
    search: Search = field(default_factory=Search)
    steer: Steer = field(default_factory=Steer)
    lamp: Lamp = field(default_factory=Lamp)
    flash: Flash = field(default_factory=Flash)
    curiosity: Curiosity = field(default_factory=Curiosity)
    novelty: Novelty = field(default_factory=Novelty)
    leaving: Held = field(default_factory=Held)
    near: float = 0.08
    surge: float = 0.0
    away: tuple[float, float | None] = (1.0, None)

    def step(self, row: dict[str, Any]) -> dict[str, Any]:
        t = row["t"]
        told = self.guide.step(row)
        track, state = told["track"], told["state"]
        searching, engaged = state in ("SEARCH", "ACQUIRE"), state in ("TRACK", "FILM", "LOST")
        novelty = self.novelty.step({"vector": row["vector"], "hold": engaged})["novelty"] if row["vector"] else 0.0
        lit = self.flash.step({"t": t, "grid": row["grid"]}) if row["grid"] is not None else self.flash.NOTHING
        place = None if lit["cx"] is None else (lit["cx"], lit["cy"])
        look = self.curiosity.step({"t": t, "searching": searching, "flash": place, "weak": row["weak"], "pause": self.guide.phases.release_s if "state:RELEASE" in told["events"] else 0.0})
        ended = told["encounter"]["behaviour"] if told["encounter"] else None
        plan = self.search.step({"t": t, "hour": row["hour"], "searching": searching, "detected": "state:ACQUIRE" in told["events"], "depth": row["depth"], "heading": row["heading"], "altitude": row["altitude"], "surge": self.surge, "ended": ended})
        elapsed = self.leaving.seconds(t, state == "RELEASE")
        if elapsed == 0.0:
            side = -1.0 if track["yaw"] > 0 else 1.0
            self.away = side, None if row["heading"] is None else (row["heading"] + side * 120.0) % 360.0
        if state in ("TRACK", "FILM"):
            asked = {"mode": "track", "yaw": track["yaw"], "pitch": track["pitch"], "size": track["size"]}
        elif state == "LOST":
            asked = {"mode": "lost", "yaw": track["yaw"]}
        elif state == "RELEASE":
            asked = {"mode": "release", "elapsed": elapsed, "away": self.away[0], "heading": row["heading"], "goal": self.away[1]}
        elif look["looking"]:
            dx, dy = look["place"][0] - 0.5, look["place"][1] - 0.5
            asked = {"mode": "search", "yaw": within(0.03 * 102.0 * dx, 0.6), "heave": within(-0.03 * 67.0 * dy, 0.6), "surge": 0.15 if max(abs(dx), abs(dy)) < 0.15 else 0.0}
        else:
            asked = {"mode": "search"} | {k: plan[k] for k in ("yaw", "heave", "surge")}
        command = self.steer.step({"t": t} | asked)
        self.surge = command["surge"]
        lamp = self.lamp.step({"t": t, "luma": row["luma"], "engaged": engaged, "close": engaged and track["size"] >= self.near})
        return told | {"novelty": novelty, "look": look, "search": plan, "command": command, "lamp": lamp}


def safe_row(t: float, state: str, frame_prob: float, peak: float) -> dict[str, Any]:
    """The telemetry of a vehicle that runs no mission: what the model sees, no thrust and no light; it has
    no target and no track."""
    return {"t": round(t, 3), "state": state, "frame_prob": round(frame_prob, 4), "peak": round(peak, 4), "cmd": {"yaw": 0.0, "heave": 0.0, "surge": 0.0, "light": 0.0}, "events": []}
