"""Assembled pixel programs, the only ones with loops: parsed once, then run over whole batches of pixels. Pixels that have
come to different instructions are run in groups by instruction; a program that hasn't ended after a number of steps is an error."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np

from rasterloom.model import Raster
from rasterloom.operators.procedural import by_place
from rasterloom.plans.expression import ExpressionError

Value = np.ndarray


def _hsv(h: Value, s: Value, v: Value) -> list[Value]:
    h = np.where(h >= 360, h - 360, np.where(h < 0, h + 360, h)) / 60
    i = np.clip(np.trunc(h), 0, 5).astype(int)
    f, v, s1 = h - i, np.clip(v, 0, 1) * 255, np.minimum(s, 1)
    m, n, k = v * (1 - s1), v * (1 - s1 * f), v * (1 - s1 * (1 - f))
    pick = lambda *c: np.where(s <= 0, v, np.choose(i, c))
    return [np.trunc(c) for c in (pick(v, n, m, m, k, v), pick(k, v, v, n, m, m), pick(m, m, k, v, v, n))]


_cut = lambda *c: [np.clip(np.trunc(x), 0, 255) for x in c]
NUMBERS: dict[str, Callable] = {
    "add": np.add, "subtract": np.subtract, "mult": np.multiply, "div": lambda a, b: np.where(np.abs(b) < 1e-10, 1e10, a / np.where(b == 0, 1, b)), "mod": lambda a, b: np.where(np.abs(b) > 1e-10, np.fmod(a, np.where(b == 0, 1, b)), 0), "pow": np.power, "uminus": np.negative,
    "sin": np.sin, "cos": np.cos, "atan2": np.arctan2, "sqrt": np.sqrt, "distance": lambda a, b, c, d: np.hypot(a - c, b - d), "int": np.trunc, "abs": np.abs, "exp": np.exp, "log": lambda a: np.log(np.where(a > 0, a, np.finfo(float).max)), "det": lambda a, b, c, d: a * d - b * c,
    "le": lambda a, b: a <= b + (abs(a) + abs(b)) * 0.001, "lt": np.less, "ge": lambda a, b: a >= b - (abs(a) + abs(b)) * 0.001, "gt": np.greater, "eq": lambda a, b: abs(a - b) <= (abs(a) + abs(b)) * 0.001, "ne": lambda a, b: abs(a - b) > (abs(a) + abs(b)) * 0.001,
    "and": lambda a, b: (a != 0) & (b != 0), "or": lambda a, b: (a != 0) | (b != 0), "not": lambda a: a == 0, "if": lambda a, b, c: np.where(a != 0, b, c), "set": lambda a: a,
}
PIXELS: dict[str, Callable] = {"rgb": _cut, "rgba": lambda r, g, b, a: _cut(r, g, b), "hsv": _hsv, "hsva": lambda h, s, v, a: _hsv(h, s, v)}


class Program:
    def __init__(self, text: str, constants: dict[str, float] | None = None, variables: tuple[str, ...] = ("x", "y")):
        self.constants = {"pi": math.pi} | (constants or {})
        self.kinds: dict[str, str] = dict.fromkeys(variables, "n")
        self.code: list[tuple] = []
        labels: dict[str, int] = {}
        for n, line in enumerate(text.split("\n"), 1):
            for part in re.sub(r"#.*", "", line).split(";"):
                part = part.strip()
                if m := re.fullmatch(r"var\s+(\w+):(num|n|pixel|p|c)", part):
                    if m[1] in self.kinds:
                        raise ExpressionError(f"{n}: duplicate variable {m[1]}")
                    self.kinds[m[1]] = "n" if m[2][0] == "n" else "p"
                    continue
                if m := re.match(r"(\w+):\s*", part):
                    if m[1] in labels:
                        raise ExpressionError(f"{n}: duplicate label {m[1]}")
                    labels[m[1]] = len(self.code)
                    part = part[m.end() :]
                if not part:
                    continue
                if m := re.fullmatch(r"(\w+)\s*=\s*(.+)", part):
                    words = m[2].split()
                    op, args = (words[0], words[1:]) if words[0] in NUMBERS | PIXELS else ("set", words)
                    if m[1] not in self.kinds:
                        raise ExpressionError(f"{n}: unknown variable {m[1]}")
                    self.code.append((n, op, args, m[1]))
                else:
                    op, *args = part.split()
                    if op not in ("jump", "jumpz", "jumpnz", "ret"):
                        raise ExpressionError(f"{n}: unknown operator {op}")
                    self.code.append((n, op, args, None))
        for k, (n, op, args, to) in enumerate(self.code):
            if op.startswith("jump"):
                if args[-1] not in labels:
                    raise ExpressionError(f"{n}: unknown label {args[-1]}")
                self.code[k] = (n, op, [*args[:-1], labels[args[-1]]], to)
            for a in args[: -1 if op.startswith("jump") else None]:
                if a not in self.kinds and a not in self.constants and not re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", a):
                    raise ExpressionError(f"{n}: unknown name {a}")

    def run(self, steps: int = 100_000, **places: Value) -> list[Value]:
        size = len(next(iter(places.values())))
        store = {k: np.zeros(size) if kind == "n" else np.zeros((3, size)) for k, kind in self.kinds.items()}
        for k, v in places.items():
            store[k] = v.astype(float)
        at, out = np.zeros(size, np.int64), np.zeros((3, size))
        end = len(self.code)

        def get(word: str, rows: Value) -> Value:
            if word in store:
                return store[word][..., rows]
            return np.full(len(rows), self.constants[word] if word in self.constants else float(word))

        with np.errstate(all="ignore"):
            for _ in range(steps):
                here = int(at.min(initial=end))
                if here >= end:
                    break
                rows = np.flatnonzero(at == here)
                _, op, args, to = self.code[here]
                if op == "ret":
                    out[:, rows] = get(args[0], rows)
                    at[rows] = end
                    continue
                if op.startswith("jump"):
                    go = np.ones(len(rows), bool) if op == "jump" else (get(args[0], rows) == 0) == (op == "jumpz")
                    at[rows] = np.where(go, args[-1], here + 1)
                    continue
                store[to][..., rows] = np.array((NUMBERS | PIXELS)[op](*(get(a, rows) for a in args)), float)
                at[rows] += 1
            else:
                if at.min(initial=end) < end:
                    raise ExpressionError(f"a pixel hasn't returned after {steps} steps")
        return list(out)


def assembled(r: Raster, text: str, constants: dict[str, float] | None = None, steps: int = 100_000) -> Raster:
    program = Program(text, {"w": r.width, "h": r.height, "cx": r.width / 2, "cy": r.height / 2} | (constants or {}))
    n = r.channels
    return by_place(r, lambda x, y: (program.run(steps, x=x, y=y) + [np.full(len(x), 255.0)])[:n])


#: The escape-time pictures: z -> z^2 + c, with c the place (mandel) or given (julia).
ESCAPE = """
var zx:n ; var zy:n ; var cx_:n ; var cy_:n ; var t:n ; var u:n ; var n:n ; var p:p
t = subtract maxx minx ; zx = mult x t ; zx = div zx w ; zx = add zx minx
t = subtract maxy miny ; zy = mult y t ; zy = div zy h ; zy = add zy miny
{c}
step: n = add n 1
t = mult zx zx ; u = mult zy zy ; t = subtract t u ; t = add t cx_
zy = mult zx zy ; zy = mult zy 2 ; zy = add zy cy_ ; zx = t
t = distance zx zy 0 0 ; t = gt t 2 ; jumpnz t paint
t = lt n maxcount ; jumpnz t step
p = rgb 0 0 0 ; ret p
paint: n = mult n 360 ; n = div n maxcount ; p = hsv n 1 1 ; ret p
"""
WINDOW = {"minx": -2.5, "maxx": 1.5, "miny": -1.5, "maxy": 1.5, "maxcount": 64}


def mandel(r: Raster, **window: float) -> Raster:
    return assembled(r, ESCAPE.format(c="cx_ = zx ; cy_ = zy ; zx = 0 ; zy = 0"), WINDOW | window)


def julia(r: Raster, zx: float = 0.7, zy: float = 0.2, **window: float) -> Raster:
    return assembled(r, ESCAPE.format(c="cx_ = set real ; cy_ = set imaginary"), WINDOW | window | {"real": zx, "imaginary": zy})
