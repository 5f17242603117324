"""Checked options: training parameters, trials, and overrides by path."""

from __future__ import annotations

import copy
import math
from typing import Any

LARGE = 2**31 - 1
# name: (default, least, greatest, whole, least is excluded); no default: must be given
TRAINING: dict[str, tuple[float | None, float, float, bool, bool]] = {
    "rounds": (None, 1, LARGE, True, False),
    "max_depth": (None, 1, LARGE, True, False),
    "max_bin": (256, 2, LARGE, True, False),
    "seed": (0, 0, LARGE, True, False),
    "eta": (0.3, 0, 1, False, True),
    "lambda": (1.0, 0, math.inf, False, False),
    "alpha": (0.0, 0, math.inf, False, False),
    "gamma": (0.0, 0, math.inf, False, False),
    "min_child_weight": (1.0, 0, math.inf, False, False),
}
SAMPLING = ("subsample", "colsample_bytree", "colsample_bylevel", "colsample_bynode")


def training_parameters(given: dict[str, Any], classes: int) -> dict[str, Any]:
    """All training parameters, defaults filled in; unknown names and bad ranges are refused.

    Sampling parameters are kept only if given, so that older plans keep their identity.
    """
    unknown = set(given) - set(TRAINING) - set(SAMPLING)
    if unknown:
        raise ValueError(f"unknown training parameters: {sorted(unknown)}")
    table = TRAINING | {k: (None, 0, 1, False, True) for k in SAMPLING if k in given}
    out: dict[str, Any] = {}
    for name, (default, least, most, whole, open_end) in table.items():
        value = given.get(name, default)
        if value is None or isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
            raise ValueError(f"{name} must be {'a whole' if whole else 'a'} number")
        if not math.isfinite(value) or value > most or value < least or (open_end and value == least):
            raise ValueError(f"{name} is out of range")
        out[name] = value if whole else float(value)
    for name in SAMPLING[1:]:
        if out.get(name, 1.0) != 1.0:
            raise ValueError(f"{name}: training does not sample columns")
    if out["rounds"] > LARGE // max(1, classes):
        raise ValueError("rounds times classes is out of range")
    return out


def trials(base: dict[str, Any], overlays: list[dict[str, Any]], classes: int) -> list[dict[str, Any]]:
    """Each overlay on the base parameters; two trials that come out equal are refused."""
    out = [training_parameters(base | o, classes) for o in overlays]
    for i, a in enumerate(out):
        if a in out[:i]:
            raise ValueError(f"trial {i} repeats an earlier one")
    return out


def override(plan: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy of ``plan`` with the member at a JSON pointer set."""
    if not path.startswith("/"):
        raise ValueError("a path begins with /")
    out = copy.deepcopy(plan)
    *above, last = [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]
    at: Any = out
    for name in above:
        at = at[int(name)] if isinstance(at, list) else at.setdefault(name, {})
    if isinstance(at, list):
        at[int(last)] = value
    else:
        at[last] = value
    return out
