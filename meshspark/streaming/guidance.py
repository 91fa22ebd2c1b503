"""Guidance of a scan run: physical sweep progress and the outbound / return / outbound regimen.

The state of a run is a handful of numbers: how many waypoints of each sweep are reached (always a prefix of its
sequence), the sweep axis and the position of the last reached waypoint.
"""

from __future__ import annotations

import math

from meshspark.functions.labels import LEFT_SWEEP, RIGHT_SWEEP, universal_of
from meshspark.functions.vectors import COMPASS

RETURN_SWEEP = LEFT_SWEEP[::-1]


def _sub(a, b):
    return tuple(p - q for p, q in zip(a, b))


def _len(v):
    return math.sqrt(sum(c * c for c in v))


def new_sweep() -> dict:
    return {"done": 0, "axis": None, "last": None}


def sweep_target(sequence, state):
    return sequence[state["done"]] if state["done"] < len(sequence) else None


def advance(sequence, state: dict, confirmed, centroids: dict, here, near_mm: float = 8.0, min_move_mm: float = 4.0):
    """Move at most one waypoint forward; returns the target afterwards (None when the sweep is complete)."""
    target = sweep_target(sequence, state)
    goal = centroids.get(target)
    if target is None or here is None or goal is None or target not in confirmed \
            or not all(map(math.isfinite, (*here, *goal))):
        return target
    if state["axis"] is None:
        legs = (_sub(centroids[b], centroids[a]) for a, b in zip(sequence, sequence[1:]) if a in centroids and b in centroids)
        leg = next((v for v in legs if _len(v) > 1e-6), None)
        state["axis"] = None if leg is None else tuple(c / _len(leg) for c in leg)
    offset = _sub(here, goal)
    arrived = _len(offset) <= near_mm or (
        state["axis"] is not None and sum(p * q for p, q in zip(offset, state["axis"])) >= 0.0)
    moved = state["last"] is None or _len(_sub(here, state["last"])) >= min_move_mm
    if arrived and moved:
        state.update(done=state["done"] + 1, last=tuple(here))
    return sweep_target(sequence, state)


def new_run() -> dict:
    return {"streak": {}, "confirmed": [], "seen_at": {}, "left": new_sweep(), "right": new_sweep(), "back": 0, "turned": False}


def confirm(run: dict, counts: dict, min_faces: int, cycles: int) -> list[int]:
    """Count consecutive sightings per label; returns labels confirmed in this cycle."""
    fresh = []
    for label in range(1, 17):
        s = run["streak"].get(label, 0) + 1 if counts.get(label, 0) >= min_faces else 0
        run["streak"][label] = s
        if s >= cycles and label not in run["confirmed"]:
            run["confirmed"].append(label)
            fresh.append(label)
    return fresh


def _expected_position(target: int, seen: dict):
    seq = LEFT_SWEEP if target in LEFT_SWEEP else RIGHT_SWEEP
    anchors = [seen[l] for l in seq[:seq.index(target)] if l in seen]
    if not anchors and seq is RIGHT_SWEEP:
        anchors = [seen[l] for l in (7, 8) if l in seen]
    if len(anchors) >= 2:
        return tuple(2 * q - p for p, q in zip(anchors[-2], anchors[-1]))
    return anchors[0] if anchors else None


def cycle_step(run: dict, counts: dict, centroids: dict, here, min_faces: int = 30, cycles: int = 8, near_mm: float = 8.0,
               min_move_mm: float = 4.0, return_mm: float = 5.0, arch: str | None = None,
               plane=((1.0, 0.0, 0.0), (0.0, 1.0, 0.0))) -> dict:
    """One inference cycle: counts and centroids per label, newest scanner position. Mutates ``run``."""
    confirm(run, counts, min_faces, cycles)
    for label in run["confirmed"]:
        if counts.get(label, 0) >= min_faces:
            run["seen_at"][label] = centroids[label]
    seen, known = run["seen_at"], set(run["confirmed"])
    phase, target = "left_outbound", advance(LEFT_SWEEP, run["left"], known, seen, here, near_mm, min_move_mm)
    if target is None:
        away = {i: _len(_sub(here, seen[l])) for i, l in enumerate(RETURN_SWEEP) if l in seen}
        if not run["turned"] and away:
            run["turned"] = True
            run["back"] = max(run["back"], min(away, key=lambda i: (away[i], i)) + 1)
        run["back"] = max([run["back"], *[i + 1 for i, d in away.items() if d <= return_mm]])
        if run["back"] < len(RETURN_SWEEP):
            phase, target = "left_return", RETURN_SWEEP[run["back"]]
        else:
            phase, target = "right_outbound", advance(RIGHT_SWEEP, run["right"], known, seen, here, near_mm, min_move_mm)
    out = {"phase": phase if target is not None else "done", "target": target or 0, "universal": 0, "distance_mm": None,
           "angle_deg": None, "compass": None, "left_done": run["left"]["done"], "back_done": run["back"],
           "right_done": run["right"]["done"], "n_confirmed": len(run["confirmed"])}
    if target is None:
        return out
    goal = seen.get(target) or _expected_position(target, seen)
    if goal is None:
        return {**out, "phase": "none", "target": 0}
    vec = _sub(goal, here)
    u, v = (sum(p * q for p, q in zip(vec, axis)) for axis in plane)
    angle = math.degrees(math.atan2(v, u))
    out.update(distance_mm=_len(vec), angle_deg=angle, compass=COMPASS[int(((angle + 22.5) % 360.0) // 45.0)],
               universal=universal_of(target, arch) if arch else 0)
    return out


GUIDANCE_SCHEMA = ("run_id bigint, cycle bigint, phase string, target bigint, universal bigint, distance_mm double, "
                   "angle_deg double, compass string, left_done bigint, back_done bigint, right_done bigint, n_confirmed bigint")
