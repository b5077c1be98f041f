"""Easing curves and other arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = Callable[[Column], Column]


def _power(n: int) -> dict[str, Curve]:
    name = {2: "quad", 3: "cubic"}[n]
    half = float(2 ** (n - 1))
    return {
        f"ease_in_{name}": lambda t: F.pow(t, n),
        f"ease_out_{name}": lambda t: 1 - F.pow(1 - t, n),
        f"ease_in_out_{name}": lambda t: F.when(t < 0.5, half * F.pow(t, n)).otherwise(1 - F.pow(2 - 2 * t, n) / 2),
    }


def bounce_out(t: Column) -> Column:
    """Four parabolas that touch 1: a ball falling on the end value."""
    n, d = 7.5625, 2.75
    arc = lambda off, up: n * (t - off / d) * (t - off / d) + up
    return F.when(t < 1 / d, arc(0.0, 0.0)).when(t < 2 / d, arc(1.5, 0.75)).when(t < 2.5 / d, arc(2.25, 0.9375)).otherwise(arc(2.625, 0.984375))


def elastic(t: Column, way: str) -> Column:
    """A spring: in, out or in_out. Two and a half swings on the way; the ends are exact."""
    swing = lambda x, lag: F.pow(F.lit(2.0), 10 * x) * F.sin((x + lag) * (5 * math.pi))
    fall = lambda x: F.pow(F.lit(2.0), -10 * x) * F.sin((x - 0.1) * (5 * math.pi))
    ends = lambda inner: F.when((t == 0) | (t == 1), t.cast("double")).otherwise(inner)
    if way == "in":
        return ends(-swing(t - 1, -0.1))
    if way == "out":
        return ends(fall(t) + 1)
    both = 2 * t - 1
    return ends(F.when(both < 0, -swing(both, -0.1) / 2).otherwise(fall(both) / 2 + 1))


_BACK = 1.70158

CURVES: dict[str, Curve] = {
    "linear": lambda t: t,
    **_power(2),
    **_power(3),
    "bounce_in": lambda t: 1 - bounce_out(1 - t),
    "bounce_out": bounce_out,
    "bounce_in_out": lambda t: F.when(t < 0.5, (1 - bounce_out(1 - 2 * t)) / 2).otherwise((1 + bounce_out(2 * t - 1)) / 2),
    "elastic_in": lambda t: elastic(t, "in"),
    "elastic_out": lambda t: elastic(t, "out"),
    "elastic_in_out": lambda t: elastic(t, "in_out"),
    "back_in": lambda t: (_BACK + 1) * t * t * t - _BACK * t * t,
    "back_out": lambda t: 1 + (_BACK + 1) * F.pow(t - 1, 3) + _BACK * F.pow(t - 1, 2),
    "back_in_out": lambda t: F.when(t < 0.5, F.pow(2 * t, 2) * ((_BACK * 1.525 + 1) * 2 * t - _BACK * 1.525) / 2).otherwise((F.pow(2 * t - 2, 2) * ((_BACK * 1.525 + 1) * (2 * t - 2) + _BACK * 1.525) + 2) / 2),
}

# Short names of curves.
CURVES |= {short: CURVES[long] for short, long in (("ease_in", "ease_in_quad"), ("ease_out", "ease_out_quad"), ("ease_in_out", "ease_in_out_quad"), ("bounce", "bounce_in_out"), ("elastic", "elastic_in_out"))}


def ease(name: str, t: Column) -> Column:
    """A curve by name; an unknown name is linear."""
    return CURVES.get(name, CURVES["linear"])(t)


def interpolate(start: Column, end: Column, t: Column, name: str = "linear") -> Column:
    return start + (end - start) * ease(name, t)


def arc_point(x0: Column, y0: Column, x1: Column, y1: Column, height: float, t: Column) -> Column:
    """A point of a parabola from one place to another that rises by `height` in its middle."""
    return F.struct((x0 + (x1 - x0) * t).alias("x"), (y0 + (y1 - y0) * t - 4 * height * t * (1 - t)).alias("y"))


def squash(t: Column, direction: str, strength: float) -> Column:
    """(wide, high) scales; volume shifts from one side to the other."""
    a, b = 1 + strength * t, 1 - strength * t
    wide, high = {"horizontal": (a, b), "vertical": (b, a)}.get(direction, (F.lit(1.0), F.lit(1.0)))
    return F.struct(wide.alias("wide"), high.alias("high"))


def largest_move(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def likeness(a: Column, b: Column, scale: float = 1.0) -> Column:
    """1 - the mean absolute difference over `scale`."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a) / scale


def map_range(x: Column, a0: float, a1: float, b0: float, b1: float) -> Column:
    return (x - a0) / (a1 - a0) * (b1 - b0) + b0


def wrap(x: Column, low: float, high: float) -> Column:
    return F.pmod(x - low, F.lit(high - low)) + low


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def gradient(first: Column, last: Column, n: Column) -> Column:
    """n values from first towards last, one for each row: last itself is not reached."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(first + (last - first) * i / n))
