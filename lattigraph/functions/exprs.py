"""Column expressions of names, distances, plane geometry and keyed randomness; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def supernode_name(component: Column, level: Column, ident: Column) -> Column:
    """The name of a supernode, such as c0_l2_17."""
    return F.concat(F.lit("c"), component.cast("string"), F.lit("_l"), level.cast("string"), F.lit("_"), ident.cast("string"))


def parse_supernode(name: Column) -> tuple[Column, Column, Column]:
    """(component, level, id) of a supernode's name; nulls if it is none."""
    part = lambda i, kind: F.nullif(F.regexp_extract(name, r"^c(\d+)_l(\d+)_(\d+)$", i), F.lit("")).cast(kind)
    return part(1, "int"), part(2, "int"), part(3, "long")


def uniform(seed: int, *keys: Column) -> Column:
    """A uniform number in (0, 1) that depends on the seed and the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def pdist(proximity: Column, n: Column, clamp: bool = True) -> Column:
    """1 - log2(proximity); no proximity is 2 log2 n away. ``clamp``: into 2 .. 2 log2 n."""
    far = 2 * F.log2(n)
    d = F.when(proximity > 0, 1 - F.log2(proximity)).otherwise(far)
    return F.greatest(F.lit(2.0), F.least(d, far)) if clamp else d


def pdist_natural(proximity: Column) -> Column:
    """1 - ln(proximity)."""
    return 1 - F.ln(proximity)


def orientation(px, py, qx, qy, rx, ry) -> Column:
    """0: collinear, 1: clockwise, 2: counter-clockwise."""
    turn = (qy - py) * (rx - qx) - (qx - px) * (ry - qy)
    return F.when(turn > 0, 1).when(turn < 0, 2).otherwise(0)


def on_segment(px, py, qx, qy, rx, ry) -> Column:
    """Whether q, collinear with p and r, lies between them."""
    return (qx <= F.greatest(px, rx)) & (qx >= F.least(px, rx)) & (qy <= F.greatest(py, ry)) & (qy >= F.least(py, ry))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the segments ab and cd share a point."""
    o1, o2 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    o3, o4 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    touching = ((o1 == 0) & on_segment(ax, ay, cx, cy, bx, by)) | ((o2 == 0) & on_segment(ax, ay, dx, dy, bx, by))
    touching |= ((o3 == 0) & on_segment(cx, cy, ax, ay, dx, dy)) | ((o4 == 0) & on_segment(cx, cy, bx, by, dx, dy))
    return ((o1 != o2) & (o3 != o4)) | touching


def angle_degrees(ux, uy, vx, vy) -> Column:
    """The angle between two vectors; 0 for a zero vector or equal directions."""
    lu, lv = F.hypot(ux, uy), F.hypot(vx, vy)
    cosine = (ux / lu) * (vx / lv) + (uy / lu) * (vy / lv)
    return F.when((lu == 0) | (lv == 0), 0.0).when(cosine >= 1, 0.0).otherwise(F.degrees(F.acos(F.greatest(cosine, F.lit(-1.0)))))
