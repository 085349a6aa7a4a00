"""Clipping by convex polygons, for all pairs of an Arrow batch at once.

A single ring is cut by one half-plane of the window after the other, on
padded arrays.  That is exact as long as each half-plane leaves one chain of
the ring, so rows whose ring crosses a half-plane's line more than twice are
handed back to ``clip_outlines``, which takes polygons of any number of rings:
where a half-plane cuts an outline, the crossings along its line are joined two
by two in their order.  Rings are taken as valid (the overlay repairs before it
clips).
"""

from __future__ import annotations

import struct

import numpy as np

from . import wkb
from .geometry import REL_TOL, _assemble

#: Padded vertices handled at once.
CELLS = 1 << 18


class Rings:
    """The closed single-ring polygons of a batch: vertices without the closing one, orientation, convexity."""

    def __init__(self, n: int, cand: np.ndarray, npts: np.ndarray, xy: np.ndarray):
        self.xy = xy
        self.simple, self.convex, self.ccw = (np.zeros(n, bool) for _ in range(3))
        self.count, self.start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(cand):
            return
        start, m = np.cumsum(npts) - npts, npts - 1
        self.count[cand], self.start[cand] = m, start
        brk = np.cumsum(m) - m
        of = np.repeat(np.arange(len(m)), m)
        j = np.arange(len(of)) - brk[of]
        p, q, origin = xy[start[of] + j], xy[start[of] + j + 1], xy[start[of]]
        edge = q - p
        after = edge[np.where(j + 1 < m[of], np.arange(len(of)) + 1, brk[of])]
        area2 = np.add.reduceat(_cross(p - origin, q - origin), brk)
        turn = _cross(edge, after) * np.sign(area2)[of]
        whole = np.add.reduceat(np.arctan2(turn, (edge * after).sum(axis=1)), brk)
        closed = (xy[start] == xy[start + m]).all(axis=1) & np.isfinite(area2) & (area2 != 0)
        proper = np.logical_and.reduceat((edge != 0).any(axis=1), brk)
        self.simple[cand] = closed
        self.ccw[cand] = area2 > 0
        # every turn to one side, and once around
        self.convex[cand] = closed & proper & (np.minimum.reduceat(turn, brk) >= 0) & (np.abs(whole - 2 * np.pi) < 1e-3)

    def padded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counter-clockwise vertices of some rows as (rows, vertices, 2), and their counts."""
        n = self.count[rows]
        j = np.arange(int(n.max())) % n[:, None]
        j = np.where(self.ccw[rows][:, None], j, n[:, None] - 1 - j)
        return self.xy[self.start[rows][:, None] + j], n


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _packed(points: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept points of every row moved to its front, and their counts."""
    n = keep.sum(axis=1)
    front = np.argsort(~keep, axis=1, kind="stable")[:, : max(1, int(n.max(initial=0)))]
    return np.take_along_axis(points, front[:, :, None], axis=1), n


def _next(p: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    return (np.arange(p.shape[1]) + step) % np.maximum(n, 1)[:, None]


def _cut(p: np.ndarray, n: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings cut by convex windows: points, counts (0: no shared area), rows for which that is exact."""
    tol = REL_TOL * np.maximum(1.0, np.maximum(np.abs(p).max(axis=(1, 2)), np.abs(window).max(axis=(1, 2))))[:, None]
    exact = np.ones(len(p), bool)
    for k in range(window.shape[1]):
        a = window[:, k]
        e = window[:, (k + 1) % window.shape[1]] - a
        e = e / np.hypot(e[:, 0], e[:, 1])[:, None]
        d = _cross(e[:, None], p - a[:, None])  # distance to the line, inside above 0
        used = np.arange(p.shape[1]) < n[:, None]
        inside = (d > tol) & used
        to = _next(p, n, 1)
        crosses = used & (inside != np.take_along_axis(inside, to, axis=1))
        exact &= crosses.sum(axis=1) <= 2
        n = np.where(inside.any(axis=1) & exact, n, 0)
        if not crosses.any():
            continue
        q, dq = np.take_along_axis(p, to[:, :, None], axis=1), np.take_along_axis(d, to, axis=1)
        share = np.divide(d, d - dq, out=np.zeros_like(d), where=crosses)
        at = p + share[:, :, None] * (q - p)
        outer = np.where(inside[:, :, None], q, p)
        on = np.abs(np.where(inside, dq, d)) <= tol
        at = np.where(on[:, :, None], outer, at)
        emit = np.stack([inside, crosses], axis=2).reshape(len(p), -1) & (n > 0)[:, None]
        p, n = _packed(np.stack([p, at], axis=2).reshape(len(p), -1, 2), emit)
    before = np.take_along_axis(p, _next(p, n, -1)[:, :, None], axis=1)
    p, n = _packed(p, (np.arange(p.shape[1]) < n[:, None]) & (p != before).any(axis=2))
    return p, np.where(n >= 3, n, 0), exact


def clip(subject: Rings, window: Rings, rows: np.ndarray):
    """Cut ``subject`` by the convex ``window`` in the given rows; yields (rows, WKB or None, exact) part by part."""
    bits = np.frexp(subject.count[rows].astype(float))[1]  # rows of like size are padded together
    group = window.count[rows] * 64 + bits
    for g in np.unique(group):
        own = rows[group == g]
        step = max(1, CELLS >> int(g % 64))
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            p, n, exact = _cut(*subject.padded(part), window.padded(part)[0])
            p = np.concatenate([p, p[:, :1]], axis=1)
            p[np.arange(len(p)), n] = p[:, 0]
            yield part, [struct.pack("<BIII", 1, 3, 1, k + 1) + p[i, : k + 1].tobytes() if k else None
                         for i, k in enumerate(n.tolist())], exact


class Outlines:
    """All rings of the polygons and multipolygons of a batch: vertices without the closing ones and without repeats,
    interior on the left.  ``known``: rows of which every ring is closed and has area."""

    def __init__(self, n: int, row: np.ndarray, shell: np.ndarray, npts: np.ndarray, xy: np.ndarray, parsed: np.ndarray):
        self.known = parsed.copy()
        end = np.cumsum(npts)
        start = end - npts
        whole = npts >= 4
        closed = np.zeros(len(row), bool)
        closed[whole] = (xy[start[whole]] == xy[end[whole] - 1]).all(axis=1)
        self.known[row[~closed]] = False
        use = closed & self.known[row]
        row, shell, start, m = row[use], shell[use], start[use], npts[use] - 1
        of, at = _spread(m)
        step = (xy[start[of] + at] != xy[start[of] + at + 1]).any(axis=1)
        of, at = of[step], at[step]
        area2 = ring_areas2(xy, start, m + 1)
        m = np.bincount(of, minlength=len(m))
        self.known[row[(m < 3) | ~np.isfinite(area2) | (area2 == 0)]] = False
        points = xy[start[of] + at]
        brk = np.cumsum(m) - m
        place = np.arange(len(of)) - brk[of]
        place = np.where(((area2 < 0) == shell)[of], m[of] - 1 - place, place)
        self.xy = points[brk[of] + place]
        self.row = row[of]
        self.next = brk[of] + (np.arange(len(of)) - brk[of] + 1) % np.maximum(m, 1)[of]


def _spread(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``m`` members: each member's group and place in it."""
    of = np.repeat(np.arange(len(m)), m)
    return of, np.arange(len(of)) - (np.cumsum(m) - m)[of]


def ring_areas2(xy: np.ndarray, start: np.ndarray, npts: np.ndarray) -> np.ndarray:
    """Twice the signed areas of closed rings, reckoned from their first points; rings of less than four have none."""
    of, at = _spread(np.where(npts >= 4, npts - 1, 0))
    p = xy[start[of] + at] - xy[start[of]]
    q = xy[start[of] + at + 1] - xy[start[of]]
    return np.bincount(of, _cross(p, q), minlength=len(start))


def _cut_outlines(xy, row, to, a, e, tol):
    """Outlines cut by a half-plane for each row (left of ``e`` through ``a``); also the rows for which the order of
    the crossings does not tell how to go on."""
    d = _cross(e[row], xy - a[row])
    inside = d > tol[row]
    cross = np.flatnonzero(inside != inside[to])
    far = np.where(inside[cross], to[cross], cross)
    near = np.where(inside[cross], cross, to[cross])
    at = xy[near] + (d[near] / (d[near] - d[far]))[:, None] * (xy[far] - xy[near])
    at = np.where((np.abs(d[far]) <= tol[row[cross]])[:, None], xy[far], at)
    along = ((at - a[row[cross]]) * e[row[cross]]).sum(axis=1)
    order = np.lexsort((along, row[cross]))
    cross, at, along = cross[order], at[order], along[order]
    leaves = inside[cross]
    tie = (np.diff(along) <= 4 * tol[row[cross[1:]]]) & (row[cross[1:]] == row[cross[:-1]])
    bad = np.unique(np.concatenate([row[cross[1:]][tie], row[cross[0::2]][~leaves[0::2]], row[cross[1::2]][leaves[1::2]]]))
    ok = ~np.isin(row[cross], bad)
    cross, at = cross[ok], at[ok]
    inside &= ~np.isin(row, bad)
    # a boundary that leaves goes on along the line to where the next one along it enters
    n, exits, entries = len(xy), cross[0::2], cross[1::2]
    new = n + np.arange(len(cross))
    entered = to[entries]
    to = np.concatenate([to, np.zeros(len(cross), np.int64)])
    to[exits], to[new[0::2]], to[new[1::2]] = new[0::2], new[1::2], entered
    keep = np.concatenate([inside, np.ones(len(cross), bool)])
    name = np.cumsum(keep) - 1
    return np.concatenate([xy, at])[keep], np.concatenate([row, row[cross]])[keep], name[to[keep]], bad


def _in_order(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices ring by ring, each from its first one on, and the rings they belong to (the first vertex's number)."""
    ring, jump = np.arange(len(to)), to
    while True:
        lower = np.minimum(ring, ring[jump])
        if (lower == ring).all():
            break
        ring, jump = lower, jump[jump]
    last = to == ring
    left, jump = np.where(last, 0, 1), np.where(last, np.arange(len(to)), to)
    while left[jump].any():
        left, jump = left + left[jump], jump[jump]
    order = np.lexsort((-left, ring))
    return order, ring[order]


def clip_outlines(subject: Outlines, window: Rings, rows: np.ndarray):
    """Cut polygons of any number of rings by the convex windows of ``rows``, one each: WKB or None, and whether that is exact."""
    own = subject.known[subject.row]
    name = np.cumsum(own) - 1
    xy, row, to = subject.xy[own], subject.row[own], name[subject.next[own]]
    exact = subject.known.copy()
    start, count, ccw = window.start[rows], window.count[rows], window.ccw[rows]

    def corner(k):
        j = k % count
        return window.xy[start + np.where(ccw, j, count - 1 - j)]

    most = int(count.max(initial=0))
    scale = np.ones(len(rows))
    np.maximum.at(scale, row, np.abs(xy).max(axis=1))
    for k in range(most):
        scale = np.maximum(scale, np.abs(corner(k)).max(axis=1))
    for k in range(most):
        a = corner(k)
        e = corner(k + 1) - a
        e = e / np.hypot(e[:, 0], e[:, 1])[:, None]
        xy, row, to, bad = _cut_outlines(xy, row, to, a, e, REL_TOL * scale)
        exact[bad] = False
    order, ring = _in_order(to)
    first = np.flatnonzero(np.diff(ring, prepend=-1))
    keep = (xy[order] != xy[to[order]]).any(axis=1)
    of = (np.cumsum(np.diff(ring, prepend=-1) != 0) - 1)[keep]
    ring_row, m = row[order[first]], np.bincount(of, minlength=len(first))
    xy = xy[order[keep]]
    some = m >= 3
    start = (np.cumsum(m) - m)[some]
    m, ring_row = m[some], ring_row[some]
    of, at = _spread(m + 1)
    closed = xy[start[of] + at % m[of]]
    end = np.cumsum(m + 1)
    area2 = ring_areas2(closed, end - m - 1, m + 1)
    sized = np.abs(area2) > (REL_TOL * scale[ring_row]) ** 2
    found = [None] * len(rows)
    # of each row the rings around area first
    ordered = np.lexsort((area2 < 0, ring_row))
    ordered = ordered[sized[ordered]]
    shells = np.bincount(ring_row[ordered], area2[ordered] > 0, minlength=len(rows)).astype(int)
    stop = np.cumsum(np.bincount(ring_row[ordered], minlength=len(rows)))
    ordered, begin, end = ordered.tolist(), (end - m - 1).tolist(), end.tolist()
    for i in np.flatnonzero((shells > 0) & exact).tolist():
        rings = [closed[begin[r] : end[r]] for r in ordered[stop[i - 1] if i else 0 : stop[i]]]
        if shells[i] == 1:
            found[i] = wkb.polygon_bytes(rings)
        else:
            polygons = _assemble(rings, REL_TOL * scale[i]) if len(rings) > shells[i] else [[r] for r in rings]
            found[i] = wkb.encode(wkb.Shape(polygons=polygons))
    return found, exact
