"""Location hashes as plain Spark expressions (no UDF, stays in codegen).

``geohash`` is the public base-32 geohash of a lon/lat point; it is NULL
outside -180..180 / -90..90, like the geometry engines that compute it on
unprojected input.  ``grid_hash`` is a Z-order (Morton) key of a grid cell
for projected coordinates, used to cluster rows by location before a write.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The geohash base-32 alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bits(n_chars: int) -> tuple[int, int]:
    total = 5 * n_chars
    return (total + 1) // 2, total // 2


def geohash(lon, lat, n_chars: int = 5) -> Column:
    """Geohash string of ``n_chars`` characters; NULL when out of range or NULL."""
    lon, lat = _c(lon).cast("double"), _c(lat).cast("double")
    lon_bits, lat_bits = _bits(n_chars)
    xi = F.least(F.floor((lon + 180.0) / 360.0 * float(2 ** lon_bits)), F.lit(2 ** lon_bits - 1))
    yi = F.least(F.floor((lat + 90.0) / 180.0 * float(2 ** lat_bits)), F.lit(2 ** lat_bits - 1))
    chars = []
    for j in range(n_chars):
        v = F.lit(0).cast("long")
        for b in range(5):
            i = 5 * j + b  # bit position from the most significant end
            if i % 2 == 0:
                src, width, k = xi, lon_bits, i // 2
            else:
                src, width, k = yi, lat_bits, i // 2
            bit = F.shiftright(src, width - 1 - k).bitwiseAND(1)
            v = v + F.shiftleft(bit, 4 - b)
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (v + 1).cast("int"), 1))
    ok = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    return F.when(ok, F.concat(*chars))


def geohash_sql(lon: str, lat: str, n_chars: int = 5) -> str:
    """The same hash as ANSI/DuckDB SQL text (used by the SQL oracle)."""
    lon_bits, lat_bits = _bits(n_chars)
    xi = f"LEAST(CAST(FLOOR(({lon} + 180.0) / 360.0 * {float(2 ** lon_bits)}) AS BIGINT), {2 ** lon_bits - 1})"
    yi = f"LEAST(CAST(FLOOR(({lat} + 90.0) / 180.0 * {float(2 ** lat_bits)}) AS BIGINT), {2 ** lat_bits - 1})"
    chars = []
    for j in range(n_chars):
        terms = []
        for b in range(5):
            i = 5 * j + b
            src, width, k = (xi, lon_bits, i // 2) if i % 2 == 0 else (yi, lat_bits, i // 2)
            terms.append(f"(((({src}) >> {width - 1 - k}) & 1) << {4 - b})")
        chars.append(f"substr('{GEOHASH_ALPHABET}', CAST(({' + '.join(terms)}) AS INTEGER) + 1, 1)")
    body = " || ".join(chars)
    return (f"CASE WHEN {lon} BETWEEN -180.0 AND 180.0 AND {lat} BETWEEN -90.0 AND 90.0 "
            f"THEN {body} END")


def grid_hash(x, y, cell_size: float, bits: int = 20) -> Column:
    """Morton key of the ``cell_size`` grid cell holding ``(x, y)``; ``bits`` per axis."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    mask = (1 << bits) - 1
    xi = F.pmod(F.floor(x / float(cell_size)), F.lit(1 << bits)).bitwiseAND(mask)
    yi = F.pmod(F.floor(y / float(cell_size)), F.lit(1 << bits)).bitwiseAND(mask)
    key = F.lit(0).cast("long")
    for i in range(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(xi, i).bitwiseAND(1), 2 * i))
        key = key.bitwiseOR(F.shiftleft(F.shiftright(yi, i).bitwiseAND(1), 2 * i + 1))
    return key


def st_geohash(bbox, n_chars: int = 5) -> Column:
    """Geohash of a geometry's bounding-box centre (pass the ``bbox`` struct column)."""
    b = _c(bbox)
    return geohash((b["minx"] + b["maxx"]) / 2.0, (b["miny"] + b["maxy"]) / 2.0, n_chars)


def st_grid_hash(bbox, cell_size: float, bits: int = 20) -> Column:
    b = _c(bbox)
    return grid_hash((b["minx"] + b["maxx"]) / 2.0, (b["miny"] + b["maxy"]) / 2.0, cell_size, bits)
