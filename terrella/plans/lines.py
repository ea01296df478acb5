"""Nearest lines of places: tiles of places meet parts of the lines, and each pair is searched through bands and a tree of the places."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrella.functions.curves import morton
from terrella.functions.geometry import coords_box, finite
from terrella.plans.grid import cuts_below
from terrella.plans.written import written

#: Places of a tile and coordinates of a part of the lines, about: what a task holds.
TILE, PART = 500_000, 3_000_000
#: Segments that go down the tree at once, at most, and pairs that are worked out at once.
STEP, PAIRS = 1 << 15, 1 << 18

_BOUNDS = ("bx1", "by1", "bx2", "by2")


def nearest_lines(lines: DataFrame, places: DataFrame, k: int, error_range: float, max_distance: float | None, tile: int = TILE, part: int = PART) -> DataFrame:
    """``places`` (distinct px, py) with their k nearest lines (payload, coords) of those whose bounds, grown by ``error_range``, hold the place: px, py, l_payload, d2.

    Places are cut into tiles in Z order, lines into parts by payload; a line goes to the tiles that its grown bounds meet, however long its segments are. No cell of a line is written anywhere.
    """
    spark, bits = lines.sparkSession, 20
    box = dict(zip(_BOUNDS, coords_box(F.col("coords"), error_range), strict=True))
    own = lines.select(F.col("payload").alias("l_payload"), F.col("coords.x").alias("xs"), F.col("coords.y").alias("ys"), *[c.alias(n) for n, c in box.items()])
    own, places = written(own.where(finite(*_BOUNDS)), "lines", freed=True), written(places.select("px", "py").where(finite("px", "py")).distinct(), "places", freed=True)
    e = places.agg(F.count("*"), F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    coordinates = own.agg(F.sum(F.size("xs"))).first()[0] or 0
    schema = f"px double, py double, l_payload {dict(own.dtypes)['l_payload']}, d2 double"
    if not e[0] or not coordinates:
        return spark.createDataFrame([], schema)
    tiles = -(-e[0] // tile)
    parts = max(-(-coordinates // part), -(-spark.sparkContext.defaultParallelism // tiles))
    size = max(e[2] - e[1], e[4] - e[3]) or 1.0
    number = lambda c, o: F.floor((F.col(c) - o) / size * ((1 << bits) - 1))
    z = places.withColumn("z", morton(number("px", e[1]), number("py", e[3]), bits))
    cuts = (z.select(F.percentile_approx("z", [i / tiles for i in range(1, tiles)], 10_000)).first()[0] or []) if tiles > 1 else []
    z = z.withColumn("tile", cuts_below(F.col("z"), sorted(set(cuts)))).drop("z")
    bounds = z.groupBy("tile").agg(F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"))
    bounds = spark.createDataFrame(bounds.collect(), bounds.schema)  # one row for each TILE places
    meet = (F.col("bx1") <= F.col("x2")) & (F.col("x1") <= F.col("bx2")) & (F.col("by1") <= F.col("y2")) & (F.col("y1") <= F.col("by2"))
    tasks = _spread(spark, tiles * parts)
    task = lambda p: F.element_at(F.array(*map(F.lit, tasks)), (F.col("tile") * parts + p + 1).cast("int")).cast("long").alias("task") if tasks else (F.col("tile") * parts + p).cast("long").alias("task")
    dealt = own.join(F.broadcast(bounds), meet).select(task(F.pmod(F.xxhash64("l_payload"), F.lit(parts))), *own.columns)
    asked = z.withColumn("p__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select(task(F.col("p__")), "px", "py")
    limit = np.inf if max_distance is None else max_distance * max_distance
    found = asked.groupBy("task").cogroup(dealt.groupBy("task")).applyInArrow(_search(k, limit), schema)
    order = Window.partitionBy("px", "py").orderBy("d2", "l_payload")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _spread(spark: SparkSession, tasks: int) -> list[int]:
    """Keys that an exchange deals to one partition after the other, so that few large tasks do not meet in one; none where there are many."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if tasks > min(4 * partitions, 1_000):
        return []
    keys: dict[int, list[int]] = {}
    for row in spark.range(16 * partitions + 64 * tasks).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("at")).collect():
        keys.setdefault(row.at, []).append(row.id)
    lots = [keys[at] for at in sorted(keys, key=lambda at: (at * max(1, tasks) % partitions, at))]
    return [lot[turn] for turn in range(max(map(len, lots))) for lot in lots if turn < len(lot)][:tasks]


def _search(k: int, limit: float) -> Callable:
    """For the places of a tile and a part of the lines: the k nearest lines of each place."""

    def run(places, lines):  # noqa: ANN001, ANN202
        import pyarrow as pa
        import pyarrow.compute as pc

        x, y = (places[c].to_numpy() for c in ("px", "py"))
        name = lines["l_payload"].combine_chunks()
        rank = pc.rank(name, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        named = np.zeros(len(name) + 1, np.int64)
        named[rank] = np.arange(len(name))
        place, code, d2 = np.array([], np.int64), np.array([], np.int64), np.array([])
        if len(x) and len(name):
            best = _Places(x, y, k, limit)
            best.take(*_segments(lines), rank, *[lines[c].to_numpy() for c in _BOUNDS])
            place, slot = np.nonzero(np.isfinite(best.d2))
            code, d2 = best.code[place, slot], best.d2[place, slot]
        return pa.table([pa.array(x[place]), pa.array(y[place]), name.take(pa.array(named[code])), pa.array(d2)], names=["px", "py", "l_payload", "d2"])

    return run


def _segments(lines) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    """Ends (x1, y1, x2, y2) and line numbers of the segments, as ``edges_of`` has them: none over a break, one without length of a single coordinate. The lines come in a random order, which keeps the search even."""
    from pyarrow import types

    lists = [lines[c].combine_chunks() for c in ("xs", "ys")]
    assert all(types.is_list(v.type) or types.is_large_list(v.type) for v in lists)
    xs, ys = (v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in lists)
    count = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(count) - count
    order = np.random.default_rng(1).permutation(len(count))
    edges = np.maximum(count - 1, np.minimum(count, 1))[order]
    line = np.repeat(order, edges)
    first = np.repeat(begin[order] - (np.cumsum(edges) - edges), edges) + np.arange(edges.sum())
    last = first + (count[line] > 1)
    there = ~(np.isnan(xs[first]) | np.isnan(xs[last]))
    first, last, line = first[there], last[there], line[there]
    return xs[first], ys[first], xs[last], ys[last], line


class _Places:
    """The k best lines of each place, and what finds more: bands for the places whose distances are bounded about alike, a tree for the others."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, limit: float) -> None:
        self.x, self.y, self.k, self.limit = x, y, k, limit
        self.d2, self.code = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.worst = np.full(len(x), float(limit))

    def take(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, line: np.ndarray, rank: np.ndarray, *bounds: np.ndarray) -> None:
        """Segments are searched in growing steps: the first ones bound the distances for the others. What searches is made anew when twice as many have passed."""
        most = max(np.abs(v[np.isfinite(v)]).max(initial=0.0) for v in (x1, y1, x2, y2, self.x, self.y))
        slack, at, step, renew = 1e-14 * most, 0, self.k + 1, 0
        while at < len(line):
            if at >= renew:
                searches, renew = self._searches(slack), 2 * at
            part = slice(at, at + step)
            segments = _Segments(x1[part], y1[part], x2[part], y2[part], *[b[line[part]] for b in bounds])
            for search in searches:
                for s, place, d2 in search.met(segments, self.worst, slack):
                    self._merge(place, rank[line[part][s]], d2)
            at += step
            step = min(STEP, at)

    def _searches(self, slack: float) -> list:
        """Bands for places of like distances, each class up to eight times as far as the one below; a tree for those without a bound and for classes of few."""
        reach = np.sqrt(self.worst)
        middle = float(np.median(reach)) or float(reach.max())
        if not 0 < middle < np.inf:
            return [_Tree(self.x, self.y, np.arange(len(reach)))]
        with np.errstate(divide="ignore"):
            kind = np.ceil((np.log2(reach) - np.log2(4 * middle)) / 3)
        rest, out = np.ones(len(reach), bool), []
        for c in np.unique(kind[np.isfinite(kind)]):
            own = rest & (kind <= c)
            if np.count_nonzero(own) >= max(64, len(reach) // 32):
                out.append(_Bands(self.x, self.y, np.flatnonzero(own), float(reach[own].max()) * (1 + 1e-9) + slack))
                rest &= ~own
        return [*out, *([_Tree(self.x, self.y, np.flatnonzero(rest))] if rest.any() else [])]

    def _merge(self, place: np.ndarray, code: np.ndarray, d2: np.ndarray) -> None:
        """The k best of what places had and what they met; a line counts once."""
        met = np.zeros(len(self.x), bool)
        met[place] = True
        at = np.flatnonzero(met)
        number = np.empty(len(self.x), np.int64)
        number[at] = np.arange(len(at))
        own, slot = np.nonzero(np.isfinite(self.d2[at]))
        place = np.concatenate([own, number[place]])
        code, d2 = np.concatenate([self.code[at[own], slot], code]), np.concatenate([self.d2[at[own], slot], d2])
        order = _sorted(place, d2, code)
        place, code, d2 = place[order], code[order], d2[order]
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end = np.concatenate([begin[1:], [len(place)]])
        best, name = np.full((len(at), self.k), np.inf), np.full((len(at), self.k), np.iinfo(np.int64).max)
        row, i, taken = np.arange(len(at)), begin, np.zeros(len(at), np.int64)
        while len(row):
            new = (name[row] != code[i, None]).all(axis=1)
            r, j = row[new], i[new]
            best[r, taken[r]], name[r, taken[r]] = d2[j], code[j]
            taken[r] += 1
            i = i + 1
            left = (i < end[row]) & (taken[row] < self.k)
            row, i = row[left], i[left]
        self.d2[at], self.code[at] = best, name
        self.worst[at] = np.minimum(best[:, -1], self.limit)


def _sorted(place: np.ndarray, d2: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Order by place, distance and code: passes over 16 bits of the place, and a full sort only for places with ties of distances."""
    order = np.argsort(d2)
    for shift in range(0, max(1, int(place.max()).bit_length()), 16):
        order = order[np.argsort((place[order] >> shift).astype(np.uint16), kind="stable")]
    p, d, c = place[order], d2[order], code[order]
    wrong = (p[1:] == p[:-1]) & (d[1:] == d[:-1]) & (c[1:] < c[:-1])
    if wrong.any():
        mixed = np.zeros(int(place.max()) + 1, bool)
        mixed[p[1:][wrong]] = True
        some = np.flatnonzero(mixed[p])
        order[some] = order[some][np.lexsort((c[some], d[some], p[some]))]
    return order


class _Segments:
    """Segments with the bounds of their lines and what the searches derive from them."""

    def __init__(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, *bounds: np.ndarray) -> None:
        self.x1, self.y1, self.x2, self.y2, self.bounds = x1, y1, x2, y2, bounds
        self.dx, self.dy = x2 - x1, y2 - y1
        self.long = self.dx * self.dx + self.dy * self.dy
        length = np.sqrt(self.long)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.nx, self.ny = (np.where(length > 0, v / length, 0.0) for v in (-self.dy, self.dx))
        self.off = self.nx * x1 + self.ny * y1

    def meet(self, s: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of pairs of segments and places those that may count, with squared distances; the line's bounds must hold the place."""
        fx, fy = x[place], y[place]
        px, py, ex, ey, of = fx - self.x1[s], fy - self.y1[s], self.dx[s], self.dy[s], self.long[s]
        t = np.where(of == 0, 0.0, np.maximum(0.0, np.minimum(1.0, (px * ex + py * ey) / np.where(of == 0, 1.0, of))))
        px, py = px - t * ex, py - t * ey
        d2 = px * px + py * py
        hit = d2 <= worst[place]
        s, place, d2, fx, fy = s[hit], place[hit], d2[hit], fx[hit], fy[hit]
        bx1, by1, bx2, by2 = self.bounds
        held = (bx1[s] <= fx) & (fx <= bx2[s]) & (by1[s] <= fy) & (fy <= by2[s])
        return s[held], place[held], d2[held]


class _Bands:
    """Places in bands of y, in each by x: a segment meets those that lie along its piece in a band, at most ``reach`` away. A band has about as many places as there are bands, or one y."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, reach: float) -> None:
        rows = rows[np.argsort(y[rows], kind="stable")]
        high = y[rows]
        size = max(1, int(len(rows) ** 0.5))
        new = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        begin = new[np.flatnonzero(np.concatenate([[True], new[1:] // size != new[:-1] // size]))]
        band = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(rows)]])))
        self.low, self.high = high[begin], high[np.concatenate([begin[1:], [len(rows)]]) - 1]
        self.x0, self.x1 = x[rows].min(), x[rows].max()
        self.wide = self.x1 - self.x0 or 1.0
        key = self.key(band, x[rows])
        order = np.argsort(key, kind="stable")
        self.keys, self.rows, self.reach = key[order], rows[order], reach
        self.x, self.y = x, y

    def key(self, band: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Band and place in it, in whole numbers that never fall as x grows."""
        return (band << 32) + ((np.clip(x, self.x0, self.x1) - self.x0) / self.wide * ((1 << 32) - 2)).astype(np.int64)

    def met(self, g: _Segments, worst: np.ndarray, slack: float) -> Iterator[tuple[np.ndarray, ...]]:
        reach, own = self.reach + slack, np.sqrt(worst) * (1 + 1e-9) + slack
        first = np.searchsorted(self.high, np.minimum(g.y1, g.y2) - reach, "left")
        bands = np.maximum(0, np.searchsorted(self.low, np.maximum(g.y1, g.y2) + reach, "right") - first)
        for s, band in _runs(np.arange(len(first)), first, bands):
            x, y, dx, dy = g.x1[s], g.y1[s], g.dx[s], g.dy[s]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                a, b = (self.low[band] - reach - y) / dy, (self.high[band] + reach - y) / dy
                a, b = (np.clip(v, 0.0, 1.0) for v in (np.minimum(a, b), np.maximum(a, b)))
            flat = dy == 0
            a[flat], b[flat] = 0.0, 1.0
            a, b = x + a * dx, x + b * dx
            left, right = np.minimum(a, b) - reach, np.maximum(a, b) + reach
            there = (left <= self.x1) & (right >= self.x0)
            s, band, left, right = s[there], band[there], left[there], right[there]
            begin, last = np.searchsorted(self.keys, self.key(band, left), "left"), self.key(band, right)
            there = self.keys[np.minimum(begin, len(self.keys) - 1)] <= last  # else nothing lies between
            s, begin, last = s[there], begin[there], last[there]
            for t, i in _runs(s, begin, np.searchsorted(self.keys, last, "right") - begin):
                place = self.rows[i]
                near = np.abs(g.nx[t] * self.x[place] + g.ny[t] * self.y[place] - g.off[t]) <= own[place]
                t, place, d2 = g.meet(t[near], place[near], self.x, self.y, worst)
                if len(t):
                    yield t, place, d2


def _runs(of: np.ndarray, begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``of`` with its ``count`` numbers from ``begin``, about ``PAIRS`` at once."""
    some = np.flatnonzero(count > 0)
    of, begin, count = of[some], begin[some], count[some]
    total = np.cumsum(count)
    at = 0
    while at < len(of):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = count[at:to]
        yield np.repeat(of[at:to], n), np.arange(total[to - 1] - done) + np.repeat(begin[at:to] - (total[at:to] - n - done), n)
        at = to


class _Tree:
    """A balanced tree over places, each node with its bounds and the greatest distance that may still count in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> None:
        self.depth = max(0, (len(rows) // 4).bit_length() - 1)
        self.all, self.rows = (x, y), rows
        x, y = x[rows], y[rows]
        for level in range(self.depth):
            cut = self.ends(level, len(x))
            node = np.repeat(np.arange(1 << level), np.diff(cut))
            wide = np.subtract(*[f.reduceat(x, cut[:-1]) for f in (np.maximum, np.minimum)]) >= np.subtract(*[f.reduceat(y, cut[:-1]) for f in (np.maximum, np.minimum)])
            order = np.lexsort((np.where(wide[node], x, y), node))
            x, y, self.rows = x[order], y[order], self.rows[order]
        self.cut = self.ends(self.depth, len(x))
        self.boxes = [[f.reduceat(v, self.cut[:-1]) for v, f in ((x, np.minimum), (y, np.minimum), (x, np.maximum), (y, np.maximum))]]
        for _ in range(self.depth):
            self.boxes.append([f(v[::2], v[1::2]) for v, f in zip(self.boxes[-1], (np.minimum, np.minimum, np.maximum, np.maximum), strict=True)])
        self.boxes = [((a + c) / 2, (b + d) / 2, (c - a) / 2, (d - b) / 2) for a, b, c, d in reversed(self.boxes)]

    @staticmethod
    def ends(level: int, n: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * n) >> level

    def bound(self, worst: np.ndarray) -> None:
        """Distances beyond which no line counts, of all nodes."""
        self.reach = [np.sqrt(np.maximum.reduceat(worst[self.rows], self.cut[:-1]))]
        for _ in range(self.depth):
            self.reach.append(np.maximum(self.reach[-1][::2], self.reach[-1][1::2]))
        self.reach.reverse()

    def met(self, g: _Segments, worst: np.ndarray, slack: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Segments, places and squared distances that may count. A node is left out if the segment's bounds or its straight line are too far away: both distances are at most the real one."""
        self.bound(worst)
        bx1, by1, bx2, by2 = g.bounds
        mx, my, hx, hy = (g.x1 + g.x2) / 2, (g.y1 + g.y2) / 2, np.abs(g.dx) / 2, np.abs(g.dy) / 2
        ax, ay, cx, cy, gx, gy = np.abs(g.nx), np.abs(g.ny), (bx1 + bx2) / 2, (by1 + by2) / 2, (bx2 - bx1) / 2, (by2 - by1) / 2
        over = 1e-14 * np.maximum(np.maximum(np.abs(bx1), np.abs(bx2)), np.maximum(np.abs(by1), np.abs(by2))) + slack
        todo = [(0, np.arange(len(g.x1)), np.zeros(len(g.x1), np.int64))]
        while todo:
            level, s, node = todo.pop()
            x, y, w, h = (v[node] for v in self.boxes[level])
            reach = self.reach[level][node] * (1 + 1e-9) + slack
            near = (np.abs(x - mx[s]) - w - hx[s] <= reach) & (np.abs(y - my[s]) - h - hy[s] <= reach)
            near &= (np.abs(x - cx[s]) - w - gx[s] <= over[s]) & (np.abs(y - cy[s]) - h - gy[s] <= over[s])
            near &= np.abs(g.nx[s] * x + g.ny[s] * y - g.off[s]) - w * ax[s] - h * ay[s] <= reach
            s, node = s[near], node[near]
            if level < self.depth:
                for i in range(0, len(s), PAIRS // 2):
                    a, b = np.repeat(s[i : i + PAIRS // 2], 2), np.repeat(2 * node[i : i + PAIRS // 2], 2)
                    b[1::2] += 1
                    todo.append((level + 1, a, b))
                continue
            for a, i in _runs(s, self.cut[node], self.cut[node + 1] - self.cut[node]):
                a, place, d2 = g.meet(a, self.rows[i], *self.all, worst)
                if len(a):
                    yield a, place, d2
