"""Target tracking: choose one person per frame among the candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.fold import chunked_fold
from cadenza.core.layout import CHUNK
from cadenza.core.num import clamp
from cadenza.functions import geometry as g

CANDIDATE = "struct<no:int,base:double,x1:double,y1:double,x2:double,y2:double>"
FRAME_OUT = (
    "struct<frame_index:bigint,selected:int,candidates:int,rejected:boolean,switched:boolean,lock_confidence:double,score:double>"
)


def base_score(lm: Column, family: str, box: Column, roi: Column | None = None) -> Column:
    """How much a candidate looks like the person to analyse."""
    quality = g.family_quality(lm, F.lit(family))
    _, cy = g.box_center(box)
    area, low = clamp(g.box_area(box) * 8.0), clamp((cy - 0.28) / 0.45)
    bonus = g.roi_bonus(box, roi) if roi is not None else F.lit(0.0)
    if family == "press":
        return 0.40 * quality + 0.30 * g.torso_horizontal(lm) + 0.15 * low + 0.15 * area + bonus
    return 0.70 * quality + 0.15 * area + 0.15 * low + bonus


def _area(c) -> float:
    return max(0.0, c["x2"] - c["x1"]) * max(0.0, c["y2"] - c["y1"])


def _center(c) -> tuple[float, float]:
    return (c["x1"] + c["x2"]) / 2.0, (c["y1"] + c["y2"]) / 2.0


def _iou(a, b) -> float:
    w = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]))
    h = max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
    union = _area(a) + _area(b) - w * h
    return w * h / union if union > 1e-6 else 0.0


def _limit(v: float) -> float:
    return max(0.0, min(1.0, v))


def choose(candidates: list, held: dict | None, has_roi: bool = False) -> tuple[dict, dict | None]:
    """One tracking step: the verdict for a frame and the box held afterwards.

    Continuity (distance or overlap to the held box) adds 28 %; a candidate three
    times larger and clearly better overrides; a far smaller one is rejected and
    leaves the held box as it is.
    """
    hx, hy = _center(held) if held else (0.0, 0.0)
    scored = []
    for c in candidates:
        x, y = _center(c)
        gap = ((x - hx) ** 2 + (y - hy) ** 2) ** 0.5
        follow = max(_limit(1.0 - gap / 0.32), _iou(c, held)) if held else 0.0
        total = 0.72 * c["base"] + 0.28 * follow if held else c["base"]
        scored.append((total, c, follow, gap))
    total, best, follow, gap = max(scored, key=lambda s: s[0])
    if not has_roi and len(scored) > 1:
        rival = max(scored, key=lambda s: s[1]["base"])
        if _area(rival[1]) >= max(0.025, 3.0 * _area(best)) and rival[1]["base"] >= best["base"] + 0.14:
            total, best, follow, gap = rival
    out = {"selected": int(best["no"]), "candidates": len(scored), "rejected": False, "switched": False, "lock_confidence": 0.0, "score": total}
    if held and not has_roi and _area(held) > 1e-8 and gap > 0.30 and _area(best) < 0.45 * _area(held) and best["base"] < 0.82:
        return out | {"selected": -1, "rejected": True, "score": None}, held
    second = max((s[0] for s in scored if s[1] is not best), default=0.0)
    out["switched"] = bool(held) and gap > 0.28 and len(scored) > 1
    out["lock_confidence"] = _limit(0.42 + total - second + 0.18 * follow + 0.12 * best["base"])
    return out, {k: float(best[k]) for k in ("x1", "y1", "x2", "y2")}


def candidate_rows(frames: DataFrame, keys: Sequence[str], people: Column, family: str, slots: Sequence[int],
                   roi: Column | None = None) -> DataFrame:
    """Frames with an array of scored candidates from an array of skeletons."""

    def one(lm: Column, no: Column) -> Column:
        b = g.bbox(lm, slots)
        return F.struct(no.alias("no"), base_score(lm, family, b, roi).alias("base"), *[b[k].alias(k) for k in ("x1", "y1", "x2", "y2")])

    return frames.select(*keys, "pose_idx", "n", "frame_index", F.transform(people, one).alias("people"))


def track_target(rows: DataFrame, keys: Sequence[str], has_roi: bool = False, size: int = CHUNK) -> DataFrame:
    """One verdict per frame that has candidates, in frame order per video."""

    fields = ("no", "base", "x1", "y1", "x2", "y2")
    flat = F.flatten(F.transform("people", lambda p: F.array(*[p[f].cast("double") for f in fields])))

    def step(arrays, first, lo, hi, n, params, state):
        held = dict(zip(fields[2:], state)) if state else None
        ends = np.cumsum(arrays["p_len"])
        events = []
        for i in range(lo - first, hi - first):
            people = np.asarray(arrays["p"][ends[i] - arrays["p_len"][i] : ends[i]]).reshape(-1, len(fields))
            if len(people):
                verdict, held = choose([dict(zip(fields, map(float, p))) for p in people], held, has_roi)
                events.append(verdict | {"frame_index": int(arrays["frame_index"][i])})
        return events, list(held.values()) if held else []

    rows = rows.select(*keys, "pose_idx", "n", "frame_index", flat.alias("p"))
    return chunked_fold(rows, keys, ["frame_index", "p"], step, FRAME_OUT, size=size, ragged=["p"])
