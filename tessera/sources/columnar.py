"""Decoding of shapefile records and attribute rows for a whole batch at once.

Attribute tables have fixed widths, so a column of a batch is a matrix of
bytes; polygons of one ring (nearly all features of a cadastre) with the same
number of points are a matrix of coordinates.  What these forms cannot express
(several rings, unclosed rings, multi-byte encodings, malformed numbers) is
left to the caller or handled value by value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

POLYGON_TYPES = (5, 15, 25)
_DIGITS = np.zeros(256, bool)
_DIGITS[list(b"0123456789-")] = True
_NUMERIC = _DIGITS.copy()
_NUMERIC[list(b"+.eE")] = True


def _trimmed(cells: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values without blanks at the end (and the start), and their offsets."""
    width = cells.shape[1]
    some = (cells != 0x20) & (cells != 0)
    end = np.where(some.any(axis=1), width - some[:, ::-1].argmax(axis=1), 0)
    begin = np.where(end > 0, some.argmax(axis=1), 0) if left else np.zeros(len(cells), np.int64)
    at = np.arange(width)
    inside = (at < end[:, None]) & (at >= begin[:, None])
    return cells[inside], np.append(0, np.cumsum(end - begin)).astype(np.int32)


def _binary(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> pa.Array:
    valid = pa.array(~null).buffers()[1] if null.any() else None
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def texts(cells: np.ndarray, encoding: str) -> pa.Array:
    """A text column; blank values are null."""
    data, offsets = _trimmed(cells, left=False)
    null = np.diff(offsets) == 0
    if len(data) and data.max() >= 0x80 and encoding.lower().replace("_", "-") not in ("utf-8", "utf8"):
        used = np.flatnonzero(np.bincount(data, minlength=256))
        try:
            wide = {int(b): bytes([b]).decode(encoding).encode() for b in used}
        except UnicodeDecodeError:  # not a single-byte encoding, or an undefined byte, which then raises by name
            raw = data.tobytes()
            return pa.array([raw[a:b].decode(encoding) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
        size = np.zeros(256, np.int64)
        size[list(wide)] = [len(v) for v in wide.values()]
        places = np.append(0, np.cumsum(size[data]))
        out = data.tobytes().decode(encoding).encode()
        data, offsets = np.frombuffer(out, np.uint8), places[offsets].astype(np.int32)
    return _binary(data, offsets, null).cast(pa.string())


def _number_texts(cells: np.ndarray, allowed: np.ndarray) -> tuple[pa.Array, bool]:
    """Trimmed texts (blank ones and overflow stars are null), and whether all bytes are ``allowed``."""
    data, offsets = _trimmed(cells, left=True)
    size = np.diff(offsets)
    first = np.zeros(len(size), np.uint8)
    first[size > 0] = data[offsets[:-1][size > 0]]
    null = (size == 0) | (first == 0x2A)
    plain = bool(allowed[data[~np.repeat(null, size)]].all())
    return _binary(data, offsets, null), plain


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def whole_numbers(cells: np.ndarray, name: str) -> pa.Array:
    """A column of whole numbers; what is no number is null, a fraction is an error (it is never cut)."""
    found, plain = _number_texts(cells, _DIGITS)
    if plain:
        try:
            return pc.cast(found.cast(pa.string()), pa.int64())
        except pa.ArrowInvalid:
            pass
    out = []
    for raw in found.to_pylist():
        text = raw.decode("ascii", "replace") if raw is not None else ""
        try:
            out.append(int(text) if text else None)
        except ValueError:
            value = _float(text)
            if value is not None and value != int(value):
                raise ValueError(f"shp: field {name} has no decimals but holds {text}") from None
            out.append(None if value is None else int(value))
    return pa.array(out, pa.int64())


def numbers(cells: np.ndarray) -> pa.Array:
    found, plain = _number_texts(cells, _NUMERIC)
    if plain:
        try:
            return pc.cast(found.cast(pa.string()), pa.float64())
        except pa.ArrowInvalid:
            pass
    return pa.array([None if raw is None else _float(raw.decode("ascii", "replace")) for raw in found.to_pylist()], pa.float64())


def dates(cells: np.ndarray) -> pa.Array:
    """``YYYYMMDD``; anything else is null."""
    if cells.shape[1] != 8:
        return pa.nulls(len(cells), pa.date32())
    digit = cells.astype(np.int64) - 0x30
    sound = ((digit >= 0) & (digit <= 9)).all(axis=1)
    digit[~sound] = 0
    year, month, day = (digit[:, a:b] @ 10 ** np.arange(b - a - 1, -1, -1) for a, b in ((0, 4), (4, 6), (6, 8)))
    sound &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    months = (year - 1970) * 12 + np.where(sound, month, 1) - 1
    start = months.astype("datetime64[M]").astype("datetime64[D]")
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]")
    at = start + np.where(sound, day - 1, 0)
    sound &= at < after
    return pa.array(at.astype(np.int64).astype(np.int32), mask=~sound).cast(pa.date32())


def flags(cells: np.ndarray) -> pa.Array:
    yes, no = np.isin(cells[:, 0], list(b"TtYy")), np.isin(cells[:, 0], list(b"FfNn"))
    return pa.array(yes, mask=~(yes | no))


# ---------------------------------------------------------------- records

def _ints(shp: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(shp[at[:, None] + np.arange(4)]).view("<i4")[:, 0]


def headers(shp: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape type and bounding box of each record, from its first bytes; NaN boxes for null shapes."""
    kind = np.zeros(len(at), np.int32)
    full = size >= 4
    kind[full] = _ints(shp, at[full])
    box = np.full((len(at), 4), np.nan)
    point = (kind % 10 == 1) & (size >= 20)
    wide = (kind % 10 > 1) & (size >= 36)
    box[wide] = np.ascontiguousarray(shp[at[wide][:, None] + np.arange(4, 36)]).view("<f8")
    box[point] = np.tile(np.ascontiguousarray(shp[at[point][:, None] + np.arange(4, 20)]).view("<f8"), 2)
    return kind, box


def single_rings(shp: np.ndarray, at: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Records that are polygons of one sound ring (closed, no repeated corner), and their WKB, shells counter-clockwise."""
    some = np.flatnonzero(np.isin(kind, POLYGON_TYPES) & (size >= 48))
    points = _ints(shp, at[some] + 40)
    fit = (_ints(shp, at[some] + 36) == 1) & (_ints(shp, at[some] + 44) == 0) & (points >= 4) & (size[some] >= 48 + 16 * points.astype(np.int64))
    some, points = some[fit], points[fit]
    rows, wkb = [], []
    for n in np.unique(points).tolist():
        same = some[points == n]
        step = max(1, (1 << 20) // (16 * n))
        for a in range(0, len(same), step):
            row = same[a : a + step]
            ring = np.ascontiguousarray(shp[(at[row] + 48)[:, None] + np.arange(16 * n)]).view("<f8").reshape(len(row), n, 2)
            sound = (ring[:, 0] == ring[:, -1]).all(axis=1) & ~(ring[:, 1:] == ring[:, :-1]).all(axis=2).any(axis=1)
            row, ring = row[sound], ring[sound]
            x, y = np.moveaxis(ring - ring[:, :1], 2, 0)
            clockwise = (x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1) < 0
            ring[clockwise] = ring[clockwise][:, ::-1]
            out = np.empty((len(row), 13 + 16 * n), np.uint8)
            out[:, :13] = np.frombuffer(np.array([1], "u1").tobytes() + np.array([3, 1, n], "<u4").tobytes(), np.uint8)
            out[:, 13:] = ring.reshape(len(row), 2 * n).view(np.uint8)
            rows.append(row)
            wkb.append(pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1) * out.shape[1]).astype(np.int32)), pa.py_buffer(out)]))
    if not rows:
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    return np.concatenate(rows), pa.concat_arrays(wkb)
