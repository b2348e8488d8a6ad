"""Planar geometry in degrees, with longitudes scaled by the cosine of the latitude."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.scalars import cone_radius
from stormframe.functions.text import bind


def offset_point(lat: Column, lon: Column, bearing: Column, nm: Column) -> Column:
    """The point so many nautical miles along a bearing."""
    up, across = nm * F.cos(F.radians(bearing)) / 60, nm * F.sin(F.radians(bearing)) / (60 * F.cos(F.radians(lat)))
    return F.struct((lat + up).alias("lat"), (lon + across).alias("lon"))


def project_day(lat: Column, lon: Column, bearing: Column, knots: Column) -> Column:
    """Where a motion leads in 24 hours; null without a bearing."""
    return F.when(bearing.isNotNull(), offset_point(lat, lon, bearing, knots * 24))


def heading(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    across = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(across, lat2 - lat1)) + 360, F.lit(360.0))


def mean_heading(a: Column, b: Column) -> Column:
    s, c = F.sin(F.radians(a)) + F.sin(F.radians(b)), F.cos(F.radians(a)) + F.cos(F.radians(b))
    return F.pmod(F.degrees(F.atan2(s, c)) + 360, F.lit(360.0))


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def segment_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from a point to a segment, longitudes scaled at the point."""
    k = F.cos(F.radians(lat))
    dx, dy = (lon2 - lon1) * k, lat2 - lat1
    px, py = (lon - lon1) * k, lat - lat1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2))


def quadrant_ring(lat: Column, lon: Column, radii: list[Column]) -> Column:
    """Four arcs of 16 points, at each quadrant's own radius (north-east, south-east, south-west, north-west)."""
    arcs = F.transform(
        F.array(*radii),
        lambda r, q: F.transform(F.sequence(F.lit(0), F.lit(90), F.lit(6)), lambda d: offset_point(lat, lon, (q * 90 + d).cast("double"), r)),
    )
    return F.flatten(arcs)


def forecast_cone(points: Column, basin: Column, steps: int = 8) -> Column:
    """The ring around an array of ``lat, lon, hours``: one side outwards, a cap, the other side back, a cap.

    Each point is set off square to its heading, which is the mean of those to
    its neighbours; null with fewer than two points. The points, and the points
    with their headings, are worked out once each.
    """
    return bind(points, lambda p: F.when(F.size(p) >= 2, bind(_headed(p, basin), lambda h: _cone(h, steps))))


def _headed(points: Column, basin: Column) -> Column:
    n = F.size(points)
    at = lambda i: F.get(points, i)
    course = lambda i: heading(at(i)["lat"], at(i)["lon"], at(i + 1)["lat"], at(i + 1)["lon"])
    return F.transform(
        points,
        lambda p, i: F.struct(
            p["lat"].alias("lat"),
            p["lon"].alias("lon"),
            F.when(i == 0, course(i)).when(i == n - 1, course(i - 1)).otherwise(mean_heading(course(i - 1), course(i))).alias("course"),
            cone_radius(F.coalesce(p["hours"], F.lit(0)), basin).alias("nm"),
        ),
    )


def _cone(headed: Column, steps: int) -> Column:
    side = lambda turn: F.transform(headed, lambda p: offset_point(p["lat"], p["lon"], p["course"] + turn, p["nm"]))

    def cap(p: Column, turn: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda k: offset_point(p["lat"], p["lon"], p["course"] + turn + k * (180.0 / steps), p["nm"]))

    return F.concat(side(-90), cap(F.element_at(headed, -1), -90), F.reverse(side(90)), cap(F.element_at(headed, 1), 90))


def ring_area(ring: Column) -> Column:
    """Shoelace area in square degrees, in one pass that carries the point before."""

    def area(points: Column) -> Column:
        start = F.struct(F.element_at(points, -1)["lon"].alias("x"), F.element_at(points, -1)["lat"].alias("y"), F.lit(0.0).alias("sum"))
        step = lambda a, p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"), (a["sum"] + a["x"] * p["lat"] - p["lon"] * a["y"]).alias("sum"))
        return F.abs(F.aggregate(points, start, step, lambda a: a["sum"])) / 2

    return bind(ring, lambda points: F.when(F.size(points) > 0, area(points)))


def wind_field(center: Column, radii: Column) -> Column:
    """``kt, ring`` of each threshold of a map of quadrant radii, ascending; null without radii."""

    def band(kt: Column) -> Column:
        q = F.element_at(radii, kt)
        return F.struct(kt.alias("kt"), quadrant_ring(center["lat"], center["lon"], [q[k] for k in ("ne", "se", "sw", "nw")]).alias("ring"))

    return F.when(F.size(radii) > 0, F.transform(F.array_sort(F.map_keys(radii)), band))


def day_band(lat: Column, lon: Column, motion: Column) -> Column:
    """``slow, fast, band``: where the slow and the fast end of a stated motion lead in a day; null without a bearing."""

    def ahead(m: Column) -> Column:
        slow, fast = (project_day(lat, lon, m["bearing"], m[k]) for k in ("slow_kt", "fast_kt"))
        told = F.struct(slow.alias("slow"), fast.alias("fast"), (m["slow_kt"] != m["fast_kt"]).alias("band"))
        return F.when(m["bearing"].isNotNull() & lat.isNotNull(), told)

    return bind(motion, ahead)


def collapse_repeats(line: Column) -> Column:
    """A line without points that equal the one before."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def _clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Half-plane by half-plane: west, south, east, north."""
    w, s, e, n = box
    for axis, bound, keep_above in ((0, w, True), (1, s, True), (0, e, False), (1, n, False)):
        if not len(ring):
            break
        inside = ring[:, axis] >= bound if keep_above else ring[:, axis] <= bound
        out = []
        for k in range(len(ring)):
            a, b = ring[k - 1], ring[k]
            if inside[k - 1] != inside[k]:
                out.append(a + (b - a) * ((bound - a[axis]) / (b[axis] - a[axis])))
            if inside[k]:
                out.append(b)
        ring = np.array(out).reshape(-1, 2)
    return ring


def _simplify(line: np.ndarray, eps: float) -> np.ndarray:
    """Keep the points that lie farther than eps from the chord of their stretch."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, inner = line[b] - line[a], line[a + 1 : b] - line[a]
        length = float(np.hypot(*chord))
        far = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(np.argmax(far))
        if far[k] > eps:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[sorted(keep)]


RING = "array<struct<lon:double,lat:double>>"


def _on_points(df: DataFrame, column: str, work) -> DataFrame:
    def each(batches):
        for batch in batches:
            done = []
            for ring in batch[column]:
                points = np.array([[p["lon"], p["lat"]] for p in ring] if ring is not None else []).reshape(-1, 2)
                done.append([{"lon": x, "lat": y} for x, y in (work(points) if len(points) else points).tolist()])
            batch[column] = pd.Series(done, index=batch.index, dtype=object)
            yield batch

    return df.mapInPandas(each, df.schema)


def clip_rings(df: DataFrame, column: str, box: tuple[float, float, float, float] = (-145, -5, 5, 45)) -> DataFrame:
    """Clip a column of rings to (west, south, east, north)."""
    return _on_points(df, column, lambda r: _clip_ring(r, box))


def clip_lines(df: DataFrame, column: str, box: tuple[float, float, float, float] = (-145, -5, 5, 45)) -> DataFrame:
    """A row for each stretch of a line inside (west, south, east, north), with the point before it and the one after it.

    Stretches are numbered by the points outside before them; all as expressions, without Python.
    """
    w, s, e, n = box
    inside = lambda p: p["lon"].between(w, e) & p["lat"].between(s, n)
    count = F.size(column)
    # A stretch begins at an inner point that no inner point stands before.
    begins = F.filter(F.sequence(F.lit(0), count - 1), lambda k: inside(F.get(column, k)) & ~F.coalesce(inside(F.get(column, k - 1)), F.lit(False)))
    cut = df.filter(count > 0).withColumn("_begin", F.explode(begins))
    outside = F.filter(F.sequence(F.col("_begin"), count - 1), lambda k: ~inside(F.get(column, k)))
    end = F.coalesce(F.get(outside, F.lit(0)), count - 1)
    start = F.greatest(F.col("_begin") - 1, F.lit(0))
    return cut.withColumn(column, F.slice(column, start + 1, end - start + 1)).drop("_begin").filter(F.size(column) >= 2)


def large_rings(df: DataFrame, column: str, least: float = 0.0005) -> DataFrame:
    """Rings with an area of at least so many square degrees."""
    return df.filter(F.coalesce(ring_area(F.col(column)) >= least, F.lit(False)))


def swap_inset(coarse: DataFrame, fine: DataFrame, column: str, box: tuple[float, float, float, float] = (-65.7, 9.8, -59.0, 19.0)) -> DataFrame:
    """Features that lie wholly in (west, south, east, north) from the fine layer, all others from the coarse one."""
    w, s, e, n = box
    within = F.forall(column, lambda p: p["lon"].between(w, e) & p["lat"].between(s, n))
    return coarse.filter(~within).unionByName(fine.filter(within))


def simplify_lines(df: DataFrame, column: str, eps: float = 0.03) -> DataFrame:
    return _on_points(df, column, lambda r: _simplify(r, eps))
