"""Arrow-batch helpers: vectorised WKB fast paths and per-row fallbacks.

The common feature in cadastral data is a small single-ring polygon, and
axis-aligned boxes are frequent.  Those are recognised for a whole Arrow
batch at once from the WKB bytes; everything else goes through the per-row
kernels in :mod:`geometry`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import geometry as g
from . import wkb
from .convex import Outlines, Rings, clip, clip_outlines, ring_areas2

_RECT_LEN = 13 + 16 * 5
_RECT_HEADER = np.array([1, 3, 0, 0, 0, 1, 0, 0, 0, 5, 0, 0, 0], dtype=np.uint8)


def as_array(a) -> pa.Array:
    if isinstance(a, pa.ChunkedArray):
        return a.combine_chunks()
    return a


def _buffers(arr: pa.Array):
    n = len(arr)
    bufs = arr.buffers()
    otype = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    offsets = np.frombuffer(bufs[1], dtype=otype)[arr.offset: arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    valid = arr.is_valid().to_numpy(zero_copy_only=False) if arr.null_count else np.ones(n, dtype=bool)
    return offsets, data, valid


def rect_info(arr: pa.Array):
    """Rows that are axis-aligned rectangles, and their boxes (NaN elsewhere)."""
    arr = as_array(arr)
    n = len(arr)
    box = np.full((n, 4), np.nan)
    is_rect = np.zeros(n, dtype=bool)
    if n == 0:
        return is_rect, box
    offsets, data, valid = _buffers(arr)
    start = offsets[:-1]
    idx = np.nonzero(valid & (np.diff(offsets) == _RECT_LEN))[0]
    if len(idx) == 0:
        return is_rect, box
    s = start[idx]
    hdr = data[s[:, None] + np.arange(13)]
    ok = np.all(hdr == _RECT_HEADER, axis=1)
    idx, s = idx[ok], s[ok]
    if len(idx) == 0:
        return is_rect, box
    c = np.ascontiguousarray(data[s[:, None] + 13 + np.arange(80)]).view("<f8")
    x, y = c[:, 0::2], c[:, 1::2]
    dx = x[:, 1:] != x[:, :-1]
    dy = y[:, 1:] != y[:, :-1]
    h = dx & ~dy
    v = dy & ~dx
    closed = (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4])
    rect = closed & (
        (h[:, 0] & v[:, 1] & h[:, 2] & v[:, 3]) | (v[:, 0] & h[:, 1] & v[:, 2] & h[:, 3])
    )
    idx = idx[rect]
    x, y = x[rect], y[rect]
    is_rect[idx] = True
    box[idx] = np.column_stack([x.min(1), y.min(1), x.max(1), y.max(1)])
    return is_rect, box


def _simple_rings(arr: pa.Array):
    """Rows that are little-endian single-ring 2-D polygons: their indices, point
    counts and all their coordinates as one flat ``(m, 2)`` array."""
    offsets, data, valid = _buffers(arr)
    start = offsets[:-1]
    length = np.diff(offsets)
    cand = np.nonzero(valid & (length >= 13 + 16 * 4))[0]
    if len(cand) == 0:
        return cand, np.empty(0, np.int64), np.empty((0, 2)), (offsets, data, valid)
    s = start[cand]
    hdr = data[s[:, None] + np.arange(13)]
    npts = hdr[:, 9:13].astype(np.int64) @ np.array([1, 256, 65536, 16777216], dtype=np.int64)
    ok = np.all(hdr[:, :9] == _RECT_HEADER[:9], axis=1) & (length[cand] == 13 + 16 * npts)
    cand, s, npts = cand[ok], s[ok], npts[ok]
    if len(cand) == 0:
        return cand, npts, np.empty((0, 2)), (offsets, data, valid)
    nbytes = 16 * npts
    total = int(nbytes.sum())
    first = np.concatenate([[0], np.cumsum(nbytes)[:-1]])
    gather = np.arange(total) + np.repeat(s + 13 - first, nbytes)
    xy = np.ascontiguousarray(data[gather]).view("<f8").reshape(-1, 2)
    return cand, npts, xy, (offsets, data, valid)


def _numbers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[at[:, None] + np.arange(4)].astype(np.int64) @ np.array([1, 256, 65536, 16777216], dtype=np.int64)


def ring_table(arr: pa.Array):
    """Rings of the rows that are little-endian 2-D polygons or multipolygons: row, whether it is a shell, point count and
    all coordinates as one flat array; and these rows.  The rows are read together, one ring of each at a time."""
    offsets, data, valid = _buffers(arr)
    n = len(arr)
    begin, end = offsets[:-1], offsets[1:]
    codes = _raw_codes(arr)
    parsed = valid & np.isin(codes, (wkb.POLYGON, wkb.MULTIPOLYGON)) & (end - begin >= 9)
    parsed[parsed] = data[begin[parsed]] == 1
    pos = begin + 5
    parts, rings = np.zeros(n, np.int64), np.zeros(n, np.int64)
    one = np.flatnonzero(parsed & (codes == wkb.POLYGON))
    many = np.flatnonzero(parsed & (codes == wkb.MULTIPOLYGON))
    rings[one], parts[many] = _numbers(data, pos[one]), _numbers(data, pos[many])
    pos[parsed] += 4
    next_is_shell = np.ones(n, bool)
    found = []
    while True:
        # a part's header where the rings of the one before are read
        new = np.flatnonzero(parsed & (rings == 0) & (parts > 0))
        if len(new):
            fits = pos[new] + 9 <= end[new]
            fits[fits] = (data[pos[new[fits]][:, None] + np.arange(5)] == _RECT_HEADER[:5]).all(axis=1)
            parsed[new[~fits]] = False
            new = new[fits]
            rings[new] = _numbers(data, pos[new] + 5)
            pos[new] += 9
            parts[new] -= 1
            next_is_shell[new] = True
        at = np.flatnonzero(parsed & (rings > 0))
        if not len(at):
            if not (parsed & (parts > 0)).any():
                break
            continue
        fits = pos[at] + 4 <= end[at]
        npts = np.zeros(len(at), np.int64)
        npts[fits] = _numbers(data, pos[at[fits]])
        fits &= pos[at] + 4 + 16 * npts <= end[at]
        parsed[at[~fits]] = False
        at, npts = at[fits], npts[fits]
        found.append((at, next_is_shell[at], npts, pos[at] + 4))
        pos[at] += 4 + 16 * npts
        rings[at] -= 1
        next_is_shell[at] = False
    if not found:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty((0, 2)), parsed
    row, shell, npts, first = (np.concatenate(x) for x in zip(*found, strict=True))
    parsed[row[npts == 0]] = False
    use = np.flatnonzero(parsed[row])
    use = use[np.argsort(row[use], kind="stable")]
    row, shell, npts, first = row[use], shell[use], npts[use], first[use]
    nbytes = 16 * npts
    gather = np.arange(int(nbytes.sum())) + np.repeat(first - (np.cumsum(nbytes) - nbytes), nbytes)
    return row, shell, npts, np.ascontiguousarray(data[gather]).view("<f8").reshape(-1, 2), parsed


def bounds(arr: pa.Array) -> np.ndarray:
    """``(n, 4)`` bounding boxes; NaN for NULL or empty geometry."""
    arr = as_array(arr)
    n = len(arr)
    out = np.full((n, 4), np.nan)
    if n == 0:
        return out
    cand, npts, xy, (offsets, data, valid) = _simple_rings(arr)
    simple = np.zeros(n, dtype=bool)
    if len(cand):
        brk = np.concatenate([[0], np.cumsum(npts)[:-1]])
        out[cand, 0] = np.minimum.reduceat(xy[:, 0], brk)
        out[cand, 1] = np.minimum.reduceat(xy[:, 1], brk)
        out[cand, 2] = np.maximum.reduceat(xy[:, 0], brk)
        out[cand, 3] = np.maximum.reduceat(xy[:, 1], brk)
        simple[cand] = True
    rest = np.flatnonzero(valid & ~simple)
    if len(rest):
        row, _, npts, xy, parsed = ring_table(arr.take(pa.array(rest)))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        brk, some = (np.cumsum(npts) - npts)[first], rest[row[first]]
        for k in range(4) if len(some) else ():
            out[some, k] = (np.minimum if k < 2 else np.maximum).reduceat(xy[:, k % 2], brk)
        rest = rest[~parsed]
    start = offsets[:-1]
    for i in rest:
        c = wkb.parse(data[start[i]:offsets[i + 1]].tobytes()).coords()
        if len(c):
            out[i] = [c[:, 0].min(), c[:, 1].min(), c[:, 0].max(), c[:, 1].max()]
    return out


def _raw_codes(arr: pa.Array) -> np.ndarray:
    """WKB type code with flags per row (0 for NULL), read from the headers of the whole batch."""
    offsets, data, valid = _buffers(arr)
    out = np.zeros(len(arr), dtype=np.int64)
    idx = np.nonzero(valid & (np.diff(offsets) >= 5))[0]
    if len(idx):
        s = offsets[:-1][idx]
        b = data[s[:, None] + np.arange(1, 5)].astype(np.int64)
        b = np.where((data[s] == 1)[:, None], b, b[:, ::-1])
        out[idx] = b @ (256 ** np.arange(4))
    return out


def type_codes(arr: pa.Array) -> np.ndarray:
    """Base WKB type code per row (0 for NULL)."""
    return (_raw_codes(as_array(arr)) & 0x0FFFFFFF) % 1000


def polygon_mask(arr: pa.Array) -> np.ndarray:
    """Rows whose WKB type is Polygon or MultiPolygon (2-D, either byte order)."""
    return np.isin(_raw_codes(as_array(arr)), (wkb.POLYGON, wkb.MULTIPOLYGON))


def values(arr: pa.Array) -> list:
    return as_array(arr).to_pylist()


def rect_bytes(boxes: np.ndarray) -> list:
    """WKB polygons (counter-clockwise from the lower-left corner) for ``(k, 4)`` boxes."""
    k = len(boxes)
    if k == 0:
        return []
    buf = np.empty((k, _RECT_LEN), dtype=np.uint8)
    buf[:, :13] = _RECT_HEADER
    x0, y0, x1, y1 = boxes.T
    c = np.column_stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0]).astype("<f8")
    buf[:, 13:] = c.view(np.uint8).reshape(k, 80)
    raw = buf.tobytes()
    return [raw[i * _RECT_LEN:(i + 1) * _RECT_LEN] for i in range(k)]


def binary(vals: list) -> pa.Array:
    return pa.array(vals, type=pa.binary())


def box_contact_bytes(box: np.ndarray) -> bytes:
    """Intersection of two touching boxes: a line or a point."""
    x0, y0, x1, y1 = box
    if x0 == x1 and y0 == y1:
        return wkb.point_bytes(np.array([x0, y0]))
    return wkb.line_bytes(np.array([[x0, y0], [x1, y1]]))


# ------------------------------------------------------------- pair kernels

def intersection_batch(a, b, keep_geom_type: bool, empty_as_null: bool = False) -> pa.Array:
    """Row-wise intersection; NULL where either side is NULL.

    With ``keep_geom_type`` rows without a polygonal result come back NULL so
    the caller can drop them; otherwise they hold the lower-dimensional
    contact (or an empty collection).
    """
    a, b = as_array(a), as_array(b)
    n = len(a)
    out = [None] * n
    ra, ba = rect_info(a)
    rb, bb = rect_info(b)
    both = np.nonzero(ra & rb)[0]
    if len(both):
        ib = np.column_stack([
            np.maximum(ba[both, 0], bb[both, 0]), np.maximum(ba[both, 1], bb[both, 1]),
            np.minimum(ba[both, 2], bb[both, 2]), np.minimum(ba[both, 3], bb[both, 3]),
        ])
        w = ib[:, 2] - ib[:, 0]
        h = ib[:, 3] - ib[:, 1]
        area = (w > 0) & (h > 0)
        for i, v in zip(both[area], rect_bytes(ib[area])):
            out[i] = v
        if not keep_geom_type:
            for k in np.nonzero(~area)[0]:
                if w[k] >= 0 and h[k] >= 0:
                    out[both[k]] = box_contact_bytes(ib[k])
                elif not empty_as_null:
                    out[both[k]] = wkb.encode(wkb.Shape())
    valid = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    todo = valid & ~(ra & rb)
    if not todo.any():
        return binary(out)
    # containment: a polygon inside a rectangle is its own intersection with it
    bxa, bxb = bounds(a), bounds(b)
    pa_, pb_ = polygon_mask(a), polygon_mask(b)
    a_in_b = rb & pa_ & (bxa[:, 0] >= bb[:, 0]) & (bxa[:, 1] >= bb[:, 1]) & (bxa[:, 2] <= bb[:, 2]) & (bxa[:, 3] <= bb[:, 3])
    b_in_a = ra & pb_ & (bxb[:, 0] >= ba[:, 0]) & (bxb[:, 1] >= ba[:, 1]) & (bxb[:, 2] <= ba[:, 2]) & (bxb[:, 3] <= ba[:, 3])
    for own, mask in ((a, todo & a_in_b), (b, todo & b_in_a & ~a_in_b)):
        idx = np.flatnonzero(mask)
        for i, v in zip(idx, own.take(pa.array(idx)).to_pylist(), strict=True):
            out[i] = v
    todo &= ~(a_in_b | b_in_a)
    if keep_geom_type:
        # boxes meeting only along an edge or corner share no area
        ow = np.minimum(bxa[:, 2], bxb[:, 2]) - np.maximum(bxa[:, 0], bxb[:, 0])
        oh = np.minimum(bxa[:, 3], bxb[:, 3]) - np.maximum(bxa[:, 1], bxb[:, 1])
        todo &= (ow > 0) & (oh > 0)
        for rows, found, exact in _convex_clips(a, b, todo):
            for i, v, known in zip(rows.tolist(), found, exact.tolist(), strict=True):
                if known:
                    out[i] = v
            todo[rows[exact]] = False
    rest = np.flatnonzero(todo)
    for i, va, vb in zip(rest, a.take(pa.array(rest)).to_pylist(), b.take(pa.array(rest)).to_pylist(), strict=True):
        res = g.intersection(wkb.parse(va), wkb.parse(vb), keep_geom_type)
        if keep_geom_type:
            out[i] = wkb.encode(res) if res.polygons else None
        elif not (empty_as_null and res.is_empty()):
            out[i] = wkb.encode(res)
    return binary(out)


def rings(arr: pa.Array) -> Rings:
    return Rings(len(arr), *_simple_rings(arr)[:3])


def _convex_clips(a: pa.Array, b: pa.Array, todo: np.ndarray):
    """Clips of the rows in which one side is convex, part by part: single rings first, then shapes of several rings and
    what the first way hands back."""
    if not todo.any():
        return
    ka, kb = rings(a), rings(b)
    by_b = todo & ka.simple & kb.convex
    by_a = todo & ka.convex & kb.simple & ~by_b
    left = todo.copy()
    for subject, window, rows in ((ka, kb, by_b), (kb, ka, by_a)):
        if rows.any():
            for part, found, exact in clip(subject, window, np.flatnonzero(rows)):
                left[part[exact]] = False
                yield part, found, exact
    for shapes, window, rows in ((a, kb, left & kb.convex), (b, ka, left & ka.convex & ~kb.convex)):
        own = np.flatnonzero(rows)
        if len(own):
            outlines = Outlines(len(own), *ring_table(shapes.take(pa.array(own))))
            yield own, *clip_outlines(outlines, window, own)


def intersects_batch(a, b) -> pa.Array:
    a, b = as_array(a), as_array(b)
    n = len(a)
    out = np.zeros(n, dtype=bool)
    ra, ba = rect_info(a)
    rb, bb = rect_info(b)
    both = ra & rb
    out[both] = (
        (ba[both, 0] <= bb[both, 2]) & (bb[both, 0] <= ba[both, 2])
        & (ba[both, 1] <= bb[both, 3]) & (bb[both, 1] <= ba[both, 3])
    )
    nulls = ~(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
    todo = ~both & ~nulls
    for rows, found, exact in _convex_clips(a, b, todo):
        # shared area settles a pair; the others may still touch
        hit = rows[exact & np.array([v is not None for v in found], bool)]
        out[hit] = True
        todo[hit] = False
    rest = np.flatnonzero(todo)
    for i, va, vb in zip(rest, a.take(pa.array(rest)).to_pylist(), b.take(pa.array(rest)).to_pylist(), strict=True):
        out[i] = g.intersects(wkb.parse(va), wkb.parse(vb))
    return pa.array(out, mask=nulls)


# ------------------------------------------------------------- unary kernels

def area_batch(arr) -> pa.Array:
    arr = as_array(arr)
    n = len(arr)
    out = np.zeros(n)
    done = np.zeros(n, dtype=bool)
    cand, npts, xy, (_, _, valid) = _simple_rings(arr)
    if len(cand):
        brk = np.concatenate([[0], np.cumsum(npts)[:-1]])
        # shift every ring to its first vertex: keeps the shoelace exact-ish on large coordinates
        origin = np.repeat(xy[brk], npts, axis=0)
        d = xy - origin
        terms = np.zeros(len(d))
        terms[:-1] = d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]
        ends = brk + npts - 1
        terms[ends] = 0.0  # no term across two rings
        out[cand] = np.abs(np.add.reduceat(terms, brk)) / 2.0
        done[cand] = True
    vals = None
    nulls = ~valid
    rest = np.nonzero(valid & ~done)[0]
    if len(rest):
        row, shell, npts, xy, parsed = ring_table(arr.take(pa.array(rest)))
        area2 = np.abs(ring_areas2(xy, np.cumsum(npts) - npts, npts))
        out[rest] = np.bincount(row, np.where(shell, area2, -area2), minlength=len(rest)) / 2.0
        rest = rest[~parsed]
    if len(rest):
        vals = arr.to_pylist()
        for i in rest:
            out[i] = g.shape_area(wkb.parse(vals[i]))
    return pa.array(out, mask=nulls)


def map_rows(arr, fn, type_, plain=None, plain_value=None) -> pa.Array:
    """Apply ``fn(bytes)`` per row.  Rows that ``plain`` (a function of the batch) marks take ``plain_value``, or
    themselves if it is None, without being parsed."""
    arr = as_array(arr)
    if plain is None:
        return pa.array([None if v is None else fn(v) for v in arr.to_pylist()], type=type_)
    known = plain(arr)
    if plain_value is None and known.all():
        return arr if arr.type == type_ else arr.cast(type_)
    vals = arr.to_pylist()
    return pa.array([None if v is None else (v if plain_value is None else plain_value) if k else fn(v)
                     for v, k in zip(vals, known, strict=True)], type=type_)


def is_rect(arr: pa.Array) -> np.ndarray:
    return rect_info(arr)[0]


def is_convex(arr: pa.Array) -> np.ndarray:
    """Convex single-ring polygons: valid, polygonal, of one part."""
    return rings(arr).convex


def is_valid_one(v: bytes) -> bool:
    return g.is_valid(wkb.parse(v))


def make_valid_one(v: bytes) -> bytes:
    s = wkb.parse(v)
    if not s.polygons or g.is_valid(s):
        return v
    polys = g.make_valid_polygons(s.polygons)
    return wkb.encode(wkb.Shape(polygons=polys, lines=s.lines, points=s.points), empty_type=wkb.POLYGON)


def multi_one(v: bytes) -> bytes:
    s = wkb.parse(v)
    if s.lines or s.points:
        return v
    return wkb.encode_multipolygon(s.polygons)


def polygonal_one(v: bytes):
    s = wkb.parse(v)
    if not s.polygons:
        return None
    if not (s.lines or s.points):
        return v
    return wkb.encode(wkb.Shape(polygons=s.polygons))


def geometry_type_one(v: bytes) -> str:
    s = wkb.parse(v)
    return wkb.TYPE_NAMES.get(s.type_code, "Unknown")


def num_parts_one(v: bytes) -> int:
    s = wkb.parse(v)
    return len(s.polygons) + len(s.lines) + len(s.points)


def num_points_one(v: bytes) -> int:
    return int(len(wkb.parse(v).coords()))


def length_one(v: bytes) -> float:
    return g.shape_length(wkb.parse(v))


def as_text_one(v: bytes) -> str:
    s = wkb.parse(v)

    def pts(a):
        return ", ".join(f"{x:.15g} {y:.15g}" for x, y in a)

    def poly(p):
        return "(" + ", ".join(f"({pts(r)})" for r in p) + ")"

    t = s.type_code
    if s.is_empty():
        return f"{wkb.TYPE_NAMES.get(t, 'GeometryCollection').upper()} EMPTY"
    parts = []
    for p in s.polygons:
        parts.append(("POLYGON", poly(p)))
    for ln in s.lines:
        parts.append(("LINESTRING", f"({pts(ln)})"))
    for p in s.points:
        parts.append(("POINT", f"({p[0]:.15g} {p[1]:.15g})"))
    if len(parts) == 1 and t in (wkb.POLYGON, wkb.LINESTRING, wkb.POINT):
        return f"{parts[0][0]} {parts[0][1]}"
    kinds = {k for k, _ in parts}
    if len(kinds) == 1 and t != wkb.COLLECTION:
        return f"MULTI{parts[0][0]} (" + ", ".join(b for _, b in parts) + ")"
    return "GEOMETRYCOLLECTION (" + ", ".join(f"{k} {b}" for k, b in parts) + ")"


def polygon_from_rings(rings_arr) -> pa.Array:
    """``array<array<double>>`` (flat x, y per ring) to WKB polygons; closed rings without repeats are copied as they are."""
    rings_arr = as_array(rings_arr)
    known, found = _polygons_of_closed_rings(rings_arr)
    if known.all():
        return found
    rest = np.flatnonzero(~known)
    place = np.empty(len(known), np.int64)
    place[np.concatenate([np.flatnonzero(known), rest])] = np.arange(len(known))
    return pa.concat_arrays([found, _polygons_one_by_one(rings_arr.take(pa.array(rest)))]).take(pa.array(place))


def _polygons_of_closed_rings(arr: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows whose rings are closed and repeat no point, and their WKB."""
    n = len(arr)
    known = arr.is_valid().to_numpy(zero_copy_only=False).copy()
    rows = arr.filter(pa.array(known)) if not known.all() else arr
    inner = rows.flatten()
    per_row = np.diff(rows.offsets.to_numpy(zero_copy_only=False))
    lengths = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    xy = np.append(inner.flatten().to_numpy(zero_copy_only=False), np.zeros(2))
    begin = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(rows)), per_row)
    good = (lengths >= 2) & (lengths % 2 == 0)
    last = np.where(good, begin + lengths - 2, 0)
    good &= (xy[np.where(good, begin, 0)] == xy[last]) & (xy[np.where(good, begin + 1, 0)] == xy[last + 1])
    pairs = np.where(good, lengths // 2 - 1, 0)
    of = np.repeat(np.arange(len(pairs)), pairs)
    p = begin[of] + 2 * (np.arange(len(of)) - (np.cumsum(pairs) - pairs)[of])
    good[of[(xy[p] == xy[p + 2]) & (xy[p + 1] == xy[p + 3])]] = False
    whole = np.bincount(row, ~good, minlength=len(rows)) == 0
    known[known] = whole
    use = whole[row]
    row, lengths, begin = (np.cumsum(whole) - 1)[row[use]], lengths[use], begin[use]
    count = per_row[whole]
    size = 9 + 4 * count + 8 * np.bincount(row, lengths, minlength=len(count)).astype(np.int64)
    offsets = np.append(0, np.cumsum(size))
    data = np.empty(int(offsets[-1]), np.uint8)
    head = offsets[:-1, None] + np.arange(9)
    data[head[:, :5]] = _RECT_HEADER[:5]
    data[head[:, 5:]] = np.ascontiguousarray(count, "<u4").view(np.uint8).reshape(-1, 4)
    before = np.cumsum(4 + 8 * lengths) - (4 + 8 * lengths)
    at = before + 9 * (row + 1)
    data[at[:, None] + np.arange(4)] = np.ascontiguousarray(lengths // 2, "<u4").view(np.uint8).reshape(-1, 4)
    of = np.repeat(np.arange(len(lengths)), lengths)
    k = np.arange(len(of)) - (np.cumsum(lengths) - lengths)[of]
    data[(at[of] + 4 + 8 * k)[:, None] + np.arange(8)] = np.ascontiguousarray(xy[begin[of] + k], "<f8").view(np.uint8).reshape(-1, 8)
    return known, pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _polygons_one_by_one(rings_arr: pa.Array) -> pa.Array:
    out = []
    for rings in rings_arr.to_pylist():
        if rings is None:
            out.append(None)
            continue
        rs = [g.clean_ring(np.asarray(r, dtype=np.float64).reshape(-1, 2)) for r in rings if r]
        out.append(wkb.polygon_bytes(rs))
    return binary(out)
