"""Column expressions for plane homographies with ``h22 = 1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CALIBRATION

H_COLUMNS = ("h00", "h01", "h02", "h10", "h11", "h12", "h20", "h21")


def matrix(alias: str | None = None) -> dict[str, Column]:
    prefix = f"{alias}." if alias else ""
    return {c: F.col(f"{prefix}{c}") for c in H_COLUMNS}


def matrix_of(struct: Column) -> dict[str, Column]:
    return {c: struct[c] for c in H_COLUMNS}


def project(h: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Image of ``(x, y)``; both coordinates are null where the point maps to infinity."""
    w = h["h20"] * x + h["h21"] * y + F.lit(1.0)
    w = F.when(w != 0, w)
    return (
        (h["h00"] * x + h["h01"] * y + h["h02"]) / w,
        (h["h10"] * x + h["h11"] * y + h["h12"]) / w,
    )


def determinant(h: dict[str, Column]) -> Column:
    return (
        h["h00"] * (h["h11"] - h["h12"] * h["h21"])
        - h["h01"] * (h["h10"] - h["h12"] * h["h20"])
        + h["h02"] * (h["h10"] * h["h21"] - h["h11"] * h["h20"])
    )


def adjugate(h: dict[str, Column]) -> list[tuple[Column, Column, Column]]:
    """Rows of the adjugate matrix, which maps back up to a factor."""
    return [
        (h["h11"] - h["h12"] * h["h21"], h["h02"] * h["h21"] - h["h01"], h["h01"] * h["h12"] - h["h02"] * h["h11"]),
        (h["h12"] * h["h20"] - h["h10"], h["h00"] - h["h02"] * h["h20"], h["h02"] * h["h10"] - h["h00"] * h["h12"]),
        (h["h10"] * h["h21"] - h["h11"] * h["h20"], h["h01"] * h["h20"] - h["h00"] * h["h21"], h["h00"] * h["h11"] - h["h01"] * h["h10"]),
    ]


def project_back(h: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Point that maps to ``(x, y)``: the adjugate matrix applied to it."""
    px, py, w = (a * x + b * y + c for a, b, c in adjugate(h))
    w = F.when(w != 0, w)
    return px / w, py / w


def covered_share(h: dict[str, Column], frame: tuple[int, int], canvas: tuple[int, int]) -> Column:
    """Exact share of the canvas whose points map back into the frame; 0 for a matrix with nulls.

    Before the division by its third coordinate a point maps back linearly, so each border of the
    frame is a half-plane of the canvas: those of one sign of that coordinate bound one convex part,
    and those of the other sign a second one, which is empty unless the horizon crosses the canvas.
    """
    px, py, w = adjugate(h)
    borders = [
        px, tuple(F.lit(float(frame[0])) * c - p for p, c in zip(px, w)),
        py, tuple(F.lit(float(frame[1])) * c - p for p, c in zip(py, w)),
    ]
    width, height = float(canvas[0]), float(canvas[1])
    corners = [(0.0, 0.0), (width, 0.0), (width, height), (0.0, height)]
    whole = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    total = F.lit(0.0)
    for sign in (1.0, -1.0):
        planes = F.array(*[
            F.struct(*[(F.lit(sign) * v).alias(n) for v, n in zip(border, "abc")]) for border in borders
        ])
        total = total + F.aggregate(planes, whole, _clip, _area)
    return total / F.lit(width * height)


def _after(shape: Column, i: Column) -> Column:
    return F.get(shape, (i + 1) % F.size(shape))


def _clip(shape: Column, plane: Column) -> Column:
    """The part of a convex polygon inside a half-plane."""
    def depth(p):
        return plane["a"] * p["x"] + plane["b"] * p["y"] + plane["c"]

    def kept(p, i):
        q = _after(shape, i)
        here, there = depth(p), depth(q)
        t = F.try_divide(here, here - there)
        border = F.struct(*[(p[c] + t * (q[c] - p[c])).alias(c) for c in ("x", "y")])
        own = F.when(here >= 0, F.array(p)).otherwise(F.slice(shape, 1, 0))
        return F.when((here >= 0) != (there >= 0), F.concat(own, F.array(border))).otherwise(own)

    return F.flatten(F.transform(shape, kept))


def _area(shape: Column) -> Column:
    def turn(p, i):
        q = _after(shape, i)
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.abs(F.aggregate(F.transform(shape, turn), F.lit(0.0), lambda a, b: a + b)) / 2


def within(x: Column, y: Column, width, height) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def canvas(
    width: Column,
    height: Column,
    buffer_factor: float = CALIBRATION.buffer_factor,
    aspect_ratio: float = CALIBRATION.aspect_ratio,
) -> tuple[Column, Column]:
    """Output canvas of a frame: area times the buffer, height:width = ``aspect_ratio``."""
    target = F.floor(width * height * F.lit(float(buffer_factor)))
    ratio = F.lit(float(aspect_ratio))
    if aspect_ratio >= 1:
        out_w = F.floor(F.sqrt(target / ratio))
        return out_w, F.floor(out_w * ratio)
    out_h = F.floor(F.sqrt(target * ratio))
    return F.floor(out_h / ratio), out_h


def canvas_of(width: int, height: int) -> tuple[int, int]:
    """The same for one known frame size, as plain numbers."""
    target = int(width * height * CALIBRATION.buffer_factor)
    out_w = int((target / CALIBRATION.aspect_ratio) ** 0.5)
    return out_w, int(out_w * CALIBRATION.aspect_ratio)
