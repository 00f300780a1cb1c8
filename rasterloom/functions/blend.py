"""The thirteen combine modes as expressions over a joined pair of pixels.

A source pixel has colours and an alpha; a destination has the same colours and perhaps an alpha. With 8-bit samples every
quotient truncates, in the order in which it stands; with doubles (top 1.0) nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.samples import hsv_to_rgb8, hsv_to_rgbf, quotient, rgb_to_hsv8, rgb_to_hsvf

Pixel = tuple[list[Column], Column | None]  # colours, alpha


class Arithmetic:
    def __init__(self, top: float):
        self.top, self.exact = top, isinstance(top, float)
        # HSV figures that already stand in columns, of the source and the destination
        self.source_hsv: tuple[Column, ...] | None = None
        self.target_hsv: tuple[Column, ...] | None = None
        # and the colours that the chosen figures make
        self.made: list[Column] | None = None
        self.zero = F.lit(0.0 if self.exact else 0)

    def over(self, a: Column, b: Column | float) -> Column:
        if not self.exact:
            return quotient(a, b)
        b = b if isinstance(b, Column) else F.lit(b)
        return F.when(b != 0, a / b)

    def wide(self, c: Column) -> Column:
        return c if self.exact else c.cast("long")

    def done(self, c: Column) -> Column:
        return c if self.exact else c.cast("int")

    def to_hsv(self, c: list[Column]) -> tuple[Column, ...]:
        return (rgb_to_hsvf if self.exact else rgb_to_hsv8)(*c)

    def to_rgb(self, *hsv: Column) -> list[Column]:
        return list((hsv_to_rgbf if self.exact else hsv_to_rgb8)(*hsv))


def _mix(per_colour: Callable, alpha: Callable):
    """A mode from per_colour(math, s, sa, d, da) (premultiplied by whoever needs it) and the new alpha."""

    def mode(m: Arithmetic, src: Pixel, dst: Pixel) -> Pixel:
        (sc, sa), (dc, da) = src, dst
        sa = m.wide(sa)
        full = F.lit(m.top) if m.exact else F.lit(int(m.top)).cast("long")
        orig = full if da is None else m.wide(da)
        new = alpha(m, sa, orig)
        out = [m.done(F.when(sa == 0, m.wide(d)).otherwise(per_colour(m, m.wide(s), sa, m.wide(d), orig, new, da is not None))) for s, d in zip(sc, dc, strict=True)]
        return out, None if da is None else m.done(F.when(sa == 0, orig).otherwise(new))

    return mode


def _union(m, sa, da):
    return sa + da - m.over(sa * da, m.top)


def _capped(m, sa, da):
    return F.least(sa + da, F.lit(m.top))


def _normal(m, s, sa, d, da, new, alpha):
    rest = m.top - sa
    if alpha:
        return F.when(sa == m.top, s).otherwise(m.over(sa * s + m.over(rest * d * da, m.top), new))
    return F.when(sa == m.top, s).otherwise(m.over(s * sa + d * rest, m.top))


def _over_alpha(m, sa, da):
    return F.when(sa == m.top, sa).otherwise(sa + m.over((m.top - sa) * da, m.top))


def _multiply(m, s, sa, d, da, new, alpha):
    if alpha:
        return m.over(m.over(m.over(s * sa * d, m.top) * da + s * sa * (m.top - da) + d * da * (m.top - sa), m.top), new)
    return m.over(m.over(sa * s * d, m.top) + d * (m.top - sa), m.top)


def _add(m, s, sa, d, da, new, alpha):
    return F.least(m.over(d * da + s * sa, new) if alpha else d + m.over(s * sa, m.top), F.lit(m.top))


def _subtract(m, s, sa, d, da, new, alpha):
    return F.greatest(m.over(d * da - s * sa, new) if alpha else d - m.over(s * sa, m.top), m.zero)


def _difference(m, s, sa, d, da, new, alpha):
    sca, dca = s * sa, d * da
    low = F.least(sca * da, dca * sa)
    return m.over(sca + dca - m.over(low * 2, m.top), new if alpha else m.top)


def _pick(best):
    def colour(m, s, sa, d, da, new, alpha):
        sca, dca = s * sa, d * da
        chosen = best(sca * da, dca * sa) + (sca + dca) * m.top - sca * da - dca * sa
        return m.over(chosen, new * m.top if alpha else F.lit(m.top * m.top))

    return colour


def _keep_alpha(m: Arithmetic, src: Pixel, dst: Pixel) -> Pixel:
    """Normal mode that leaves the destination's alpha (but an opaque source replaces it)."""
    (colours, alpha), (_, da) = _mix(_normal, _over_alpha)(m, src, dst), dst
    return colours, None if alpha is None else F.when(src[1] == m.top, src[1]).otherwise(da)


def chosen(mode: str, source: tuple[Column, ...], target: tuple[Column, ...]) -> tuple[Column, ...]:
    """Of the HSV figures of both sides those that a mode makes colours from."""
    taken = {"hue": (True, False, False), "saturation": (False, True, False), "value": (False, False, True), "color": (True, True, False)}[mode]
    return tuple(p if take else q for p, q, take in zip(source, target, taken, strict=True))


def _hue(m: Arithmetic, src: Pixel, dst: Pixel) -> Pixel | None:
    (sc, sa), (dc, da) = src, dst
    if len(sc) < 3:
        return None
    sh, ss, sv = m.source_hsv or m.to_hsv(sc)
    dh, ds, dv = m.target_hsv or m.to_hsv(dc)
    lively = (ss != 0) & (ds != 0) if da is None else (ss != 0) & (ds != 0) & (da != 0)
    # over or from a grey nothing is mixed, whatever the colours
    return m.made or m.to_rgb(*chosen("hue", (sh, ss, sv), (dh, ds, dv))), F.when(lively, sa).otherwise(m.zero)


def _parts(mode: str):
    def made(m: Arithmetic, src: Pixel, dst: Pixel) -> Pixel | None:
        (sc, sa), (dc, _) = src, dst
        if len(sc) < 3:
            return src if mode == "value" else None
        return m.made or m.to_rgb(*chosen(mode, m.source_hsv or m.to_hsv(sc), m.target_hsv or m.to_hsv(dc))), sa

    return made


#: Modes that work on HSV figures: what their source becomes before it is mixed (None: the destination stays). A caller does
#: well to put the figures, and then the new source, into columns first, as each is used many times.
IN_HSV: dict[str, Callable] = {"hue": _hue, **{name: _parts(name) for name in ("saturation", "value", "color")}}


def _mixed(made: Callable):
    def mode(m: Arithmetic, src: Pixel, dst: Pixel) -> Pixel:
        new = made(m, src, dst)
        return dst if new is None else _keep_alpha(m, new, dst)

    return mode


def _none(m: Arithmetic, src: Pixel, dst: Pixel) -> Pixel:
    return src[0], None if dst[1] is None else src[1]


def _dissolve(seed: int):
    def mode(m: Arithmetic, src: Pixel, dst: Pixel) -> Pixel:
        take = src[1] > F.rand(seed) * m.top
        return [F.when(take, s).otherwise(d) for s, d in zip(src[0], dst[0], strict=True)], None if dst[1] is None else F.when(take, F.lit(m.top)).otherwise(dst[1])

    return mode


MODES: dict[str, Callable] = {
    "none": _none, "normal": _mix(_normal, _over_alpha), "multiply": _mix(_multiply, _union), "dissolve": _dissolve(1), "add": _mix(_add, _capped), "subtract": _mix(_subtract, _capped),
    "diff": _mix(_difference, _union), "lighten": _mix(_pick(F.greatest), _union), "darken": _mix(_pick(F.least), _union), **{name: _mixed(made) for name, made in IN_HSV.items()},
}


def prepared(mode: str, top: float, src: Pixel, dst: Pixel, source_hsv: tuple[Column, ...], target_hsv: tuple[Column, ...], made: list[Column]) -> Pixel:
    """The source that a mode in IN_HSV mixes, from HSV figures of both sides and the colours that the chosen ones make; mix
    it by prepared_over."""
    math = Arithmetic(top)
    math.source_hsv, math.target_hsv, math.made = source_hsv, target_hsv, made
    return IN_HSV[mode](math, src, dst)


def prepared_over(top: float, src: Pixel, dst: Pixel) -> Pixel:
    return _keep_alpha(Arithmetic(top), src, dst)


def combine(mode: str, top: float, src: Pixel, dst: Pixel) -> Pixel:
    if mode not in MODES:
        raise ValueError(f"unknown combine mode {mode}; known: {', '.join(MODES)}")
    return MODES[mode](Arithmetic(top), src, dst)
