"""Resize rules: a rule is plain data on the driver and compiles to column expressions of the source size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Resize:
    """kind: none, fit (width and height, each may be None), exact, percent or longest."""

    kind: str = "none"
    width: float | None = None
    height: float | None = None
    amount: float | None = None

    def active(self) -> bool:
        """Whether the rule can change anything, so that a run makes sense."""
        if self.kind == "fit":
            return any(x is not None and x > 0 for x in (self.width, self.height))
        if self.kind == "exact":
            return (self.width or 0) > 0 and (self.height or 0) > 0
        if self.kind == "percent":
            return (self.amount or 0) > 0 and self.amount != 100
        return self.kind == "longest" and (self.amount or 0) > 0


def target_size(rule: Resize, width: Column, height: Column, allow_upscale: bool = False) -> Column:
    """struct<width, height> in whole pixels, or null where nothing changes.

    Null and non-positive source sizes give null. `exact` and `percent` go past the source size whatever
    allow_upscale says. Sides round half away from zero and are 1 at least.
    """
    w, h = width.cast("double"), height.cast("double")
    most = [] if allow_upscale else [F.lit(1.0)]
    if rule.kind == "fit" and not (rule.width is None and rule.height is None):
        sides = [F.lit(float(limit)) / side for limit, side in ((rule.width, w), (rule.height, h)) if limit is not None]
        scale = F.least(*sides, *most) if len(sides) + len(most) > 1 else sides[0]
        x, y = w * scale, h * scale
    elif rule.kind == "exact" and rule.active():
        x, y = F.lit(float(rule.width)), F.lit(float(rule.height))
    elif rule.kind == "percent" and (rule.amount or 0) > 0:
        x, y = w * F.lit(rule.amount / 100), h * F.lit(rule.amount / 100)
    elif rule.kind == "longest" and (rule.amount or 0) > 0:
        scale = F.lit(float(rule.amount)) / F.greatest(w, h)
        scale = F.least(scale, *most) if most else scale
        x, y = w * scale, h * scale
    else:
        return F.lit(None).cast("struct<width:double,height:double>")
    x, y = F.greatest(F.round(x), F.lit(1.0)), F.greatest(F.round(y), F.lit(1.0))
    made = F.struct(x.alias("width"), y.alias("height"))
    return F.when((w > 0) & (h > 0) & ~((x == w) & (y == h)), made)
