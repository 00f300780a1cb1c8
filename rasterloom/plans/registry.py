"""Filters by name: what each needs, its usual values and names for numbers; own filters can be added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from rasterloom.model import Raster
from rasterloom.operators import aggregates, fills, joins, point, procedural, stencil


@dataclass(frozen=True)
class Filter:
    run: Callable[..., Raster]
    needs: tuple[str, ...] = ()
    usual: dict = field(default_factory=dict)
    names: dict[str, dict[str, int]] = field(default_factory=dict)


_DISTANCES = {"euclid": 0, "euclid_squared": 1, "manhattan": 2}
FILTERS: dict[str, Filter] = {
    "contrast": Filter(point.contrast, ("intensity",)), "hardinvert": Filter(point.hardinvert), "hardinvertall": Filter(lambda r: point.hardinvert(r, True)), "noise": Filter(point.noise, ("amount",), {"amount": 3.0, "per_sample": False}), "postlevels": Filter(point.postlevels, (), {"levels": 10}),
    "autolevels": Filter(aggregates.autolevels, (), {"lsat": 0.1, "usat": 0.1}), "autolevels_skew": Filter(aggregates.autolevels_skew, (), {"lsat": 0.1, "usat": 0.1}), "turbnoise": Filter(procedural.turbnoise, (), {"xo": 0.0, "yo": 0.0, "scale": 10.0}), "radnoise": Filter(procedural.radnoise, (), {"xo": 100, "yo": 100, "rscale": 17.0, "ascale": 0.02}),
    "conv": Filter(stencil.conv, ("coefficients",)), "gaussian": Filter(stencil.gaussian, ("sigma",)), "gaussian2": Filter(stencil.gaussian2, ("sigma_x", "sigma_y")), "unsharpmask": Filter(stencil.unsharp_mask, (), {"sigma": 2.0, "scale": 1.0}), "mosaic": Filter(stencil.mosaic, (), {"size": 20}),
    "bumpmap": Filter(stencil.bumpmap, ("bump",), {"channel": 0, "light_x": 0, "light_y": 0, "reach": 2}), "bumpmap_complex": Filter(stencil.bumpmap_complex, ("bump",), {"channel": 0, "light": (-1.0, -1.0, -1.0), "ambient": 0.5, "diffuse": 0.5, "specular": 0.5, "exponent": 40.0}), "watermark": Filter(joins.watermark, ("mark",), {"left": 0, "top": 0, "pixdiff": 10}),
    "gradgen": Filter(fills.gradgen, ("points", "colours"), {"measure": 0}, {"measure": _DISTANCES}), "nearest_color": Filter(fills.nearest_colour, ("points",), {"measure": 0}, {"measure": _DISTANCES}), "fountain": Filter(fills.fountain, ("xa", "ya", "xb", "yb"), {"kind": "linear", "repeat": "none"}),
    "mandelbrot": Filter(procedural.mandelbrot, (), {"minx": -2.5, "miny": -2.0, "maxx": 1.5, "maxy": 2.0}), "flines": Filter(point.flines), "lin_stretch": Filter(point.lin_stretch, ("a", "b")),
}


def register_filter(name: str, run: Callable[..., Raster], needs: tuple[str, ...] = (), usual: dict | None = None, names: dict | None = None) -> None:
    if name in FILTERS:
        raise ValueError(f"filter {name} is already registered")
    FILTERS[name] = Filter(run, needs, usual or {}, names or {})


def apply(r: Raster, name: str, **options) -> Raster:
    """A registered filter: usual values first, then the given ones; words stand for their numbers."""
    if name not in FILTERS:
        raise ValueError(f"no such filter: {name}")
    f = FILTERS[name]
    given = f.usual | {k: f.names.get(k, {}).get(v, v) if isinstance(v, str) else v for k, v in options.items()}
    if missing := [k for k in f.needs if k not in given]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return f.run(r, **given)
