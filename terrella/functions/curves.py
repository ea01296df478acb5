"""Space-filling curves and grid cells as native column expressions, unrolled over the bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.functions.geometry import Value, col, let


def cell(value: Value, width: Value, origin: Value = 0.0) -> Column:
    """Number of the grid cell that a coordinate lies in."""
    return F.floor((col(value) - col(origin)) / col(width)).cast("long")


def morton(x: Value, y: Value, bits: int = 16) -> Column:
    """Z-order index of two cells of ``bits`` bits: x takes the odd places, y the even ones."""
    parts = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 2 * b + k) for b in range(bits) for k, c in ((1, col(x)), (0, col(y)))]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def morton_decode(z: Value, bits: int = 16) -> tuple[Column, Column]:
    one = F.lit(1).cast("long")
    pick = lambda k: sum((F.shiftleft(F.shiftright(col(z), 2 * b + k).bitwiseAND(one), b) for b in range(1, bits)), F.shiftright(col(z), k).bitwiseAND(one))
    return pick(1), pick(0)


def _step(state: Column, size: int) -> Column:
    """One level of the curve's descent: the quadrant's share of the index, then the turned coordinates."""
    half = size // 2
    x, y, d = state["x"], state["y"], state["d"]
    rx, ry = (F.floor(x / half) % 2).cast("long"), (F.floor(y / half) % 2).cast("long")
    share = d + half * half * ((3 * rx).bitwiseXOR(ry))
    mx, my = x % half, y % half
    fx, fy = F.when(rx == 1, half - 1 - mx).otherwise(mx), F.when(rx == 1, half - 1 - my).otherwise(my)
    return F.struct(F.when(ry == 0, fy).otherwise(mx).alias("x"), F.when(ry == 0, fx).otherwise(my).alias("y"), share.alias("d"))


def hilbert(x: Value, y: Value, n: int = 256) -> Column:
    """Hilbert index of a cell in an n by n grid, n a power of two; -1 outside the grid."""
    if n < 1 or n & (n - 1):
        raise ValueError("n must be a power of two")
    state = F.struct(col(x).cast("long").alias("x"), col(y).cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    size = n
    while size > 1:
        state = _bound(state, size)
        size //= 2
    outside = (col(x) < 0) | (col(y) < 0) | (col(x) >= n) | (col(y) >= n)
    return F.when(outside, F.lit(-1).cast("long")).otherwise(state["d"])


def _bound(state: Column, size: int) -> Column:
    return let(state, lambda s: _step(s, size))


def hilbert_decode(d: Value, n: int = 256) -> tuple[Column, Column]:
    """Cell of a Hilbert index."""
    state = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), col(d).cast("long").alias("t"))
    size = 1

    def grow(s: Column, size: int) -> Column:
        rx = (F.floor(s["t"] / 2) % 2).cast("long")
        ry = (s["t"] % 2).bitwiseXOR(rx)
        fx, fy = F.when(rx == 1, size - 1 - s["x"]).otherwise(s["x"]), F.when(rx == 1, size - 1 - s["y"]).otherwise(s["y"])
        x, y = F.when(ry == 0, fy).otherwise(s["x"]), F.when(ry == 0, fx).otherwise(s["y"])
        return F.struct((x + size * rx).alias("x"), (y + size * ry).alias("y"), F.floor(s["t"] / 4).cast("long").alias("t"))

    while size < n:
        state = _grown(state, size, grow)
        size *= 2
    return state["x"], state["y"]


def _grown(state: Column, size: int, grow) -> Column:  # noqa: ANN001
    return let(state, lambda s: grow(s, size))


def hilbert_neighbours(d: Value, n: int = 256) -> Column:
    """Indexes of the up to eight cells around a cell, in order."""
    x, y = hilbert_decode(d, n)
    around = lambda c: F.array(*[hilbert(c["x"] + dx, c["y"] + dy, n) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    return F.array_sort(F.filter(let(F.struct(x.alias("x"), y.alias("y")), around), lambda v: v >= 0))


def lonlat_cell(value: Value, low: float, high: float, n: int) -> Column:
    """Cell of a longitude or latitude in a grid of n cells between the bounds; the upper bound falls in the last cell."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((col(value) - low) / (high - low) * n))).cast("long")


def lonlat_hilbert(lon: Value, lat: Value, n: int = 1024) -> Column:
    return hilbert(lonlat_cell(lon, -180.0, 180.0, n), lonlat_cell(lat, -90.0, 90.0, n), n)


def hilbert_lonlat(d: Value, n: int = 1024) -> tuple[Column, Column]:
    """Middle of an index's cell in degrees: the inverse of ``lonlat_hilbert`` up to a cell."""
    x, y = hilbert_decode(d, n)
    return (x + 0.5) / n * 360.0 - 180.0, (y + 0.5) / n * 180.0 - 90.0


def hilbert_index(x: int, y: int, n: int) -> int:
    """Hilbert index of one cell, for the driver."""
    d, s = 0, n // 2
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        x, y = x & (s - 1), y & (s - 1)
        if ry == 0:
            x, y = ((s - 1 - y, s - 1 - x) if rx else (y, x))
        s //= 2
    return d


def box_ranges(xmin: float, ymin: float, xmax: float, ymax: float, n: int = 64) -> list[tuple[int, int]]:
    """Ranges of Hilbert indexes, ends included, that cover a box of degrees."""
    at = lambda v, low, high: max(0, min(n - 1, int((v - low) / (high - low) * n)))
    cells = sorted(hilbert_index(x, y, n) for x in range(at(xmin, -180, 180), at(xmax, -180, 180) + 1) for y in range(at(ymin, -90, 90), at(ymax, -90, 90) + 1))
    out: list[tuple[int, int]] = []
    for c in cells:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out
