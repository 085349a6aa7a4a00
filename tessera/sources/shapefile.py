"""ESRI shapefile source (``spark.read.format("shp")``) and sink.

A layer is a glob of ``.shp`` files (one per county directory in the
reference layout); each comes with ``.shx`` (record index), ``.dbf``
(attributes), optionally ``.cpg`` (text encoding) and ``.prj`` (CRS).  The
driver only lists files (one listing gives all sizes) and reads the attribute
tables' headers, several at a time; executors read record ranges: every file is
split into partitions of ``recordsPerPartition`` records using the ``.shx``
index, so a large file is read by many tasks.

Filters (with ``spark.sql.python.filterPushdown.enabled``, which
``tessera.session.register`` sets): those on ``county`` and ``source_file``
leave out files, those on fields of ``bbox`` are tested on the records' headers
before anything is decoded.  Options: ``columns`` (attributes to decode),
``geometry`` (false: none is decoded, the column is left out), ``pairedWith`` (a
second layer's pattern: only folders that hold a file of it, by the listing
alone), ``files`` (paths, one a line, instead of a pattern),
``recursiveFileLookup``, ``encoding``.

Output columns: the DBF fields (or those listed in ``columns``), then
``geometry`` (WKB), ``bbox`` (from the record header, no decoding needed),
``source_file``, ``record_no`` (0-based) and ``county`` (name of the parent
directory).  Rings are converted to OGC orientation (shells counter-
clockwise); several outer rings become a MultiPolygon.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import posixpath
import struct
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ..functions import batch, wkb
from ..functions import geometry as g
from ..functions.columns import BBOX_TYPE
from ..functions.convex import ring_areas2
from . import columnar, fs

#: Columns of the reader's own; without ``geometry`` if that option is false.
EXTRA_COLUMNS = ("geometry", "bbox", "source_file", "record_no", "county")


# ------------------------------------------------------------------ DBF

def dbf_header(raw: bytes) -> tuple[int, int, int, list]:
    """``(n_records, header_len, record_len, fields)``; field = (name, type, offset, length, decimals)."""
    n, hlen, rlen = struct.unpack_from("<IHH", raw, 4)
    fields = []
    pos, off = 32, 1
    while pos + 32 <= len(raw) and raw[pos] != 0x0D:
        name = raw[pos:pos + 11].split(b"\x00")[0].decode("ascii", "replace").strip()
        ftype = chr(raw[pos + 11])
        length, dec = raw[pos + 16], raw[pos + 17]
        fields.append((name, ftype, off, length, dec))
        off += length
        pos += 32
    return n, hlen, rlen, fields


def field_type(ftype: str, length: int, dec: int):
    if ftype == "C":
        return StringType()
    if ftype == "N" and dec == 0:
        return IntegerType() if length <= 9 else LongType()
    if ftype in ("N", "F"):
        return DoubleType()
    if ftype == "D":
        return DateType()
    if ftype == "L":
        return BooleanType()
    return StringType()


def _decode_column(block: np.ndarray, field: tuple, enc: str) -> pa.Array:
    """One attribute of a batch of fixed-width rows."""
    name, ftype, off, length, dec = field
    cells = np.ascontiguousarray(block[:, off:off + length])
    spark_type = field_type(ftype, length, dec)
    if isinstance(spark_type, (IntegerType, LongType)):
        return columnar.whole_numbers(cells, name).cast(_arrow_type(spark_type))
    if isinstance(spark_type, DoubleType):
        return columnar.numbers(cells)
    if isinstance(spark_type, DateType):
        return columnar.dates(cells)
    if isinstance(spark_type, BooleanType):
        return columnar.flags(cells)
    return columnar.texts(cells, enc)


# ------------------------------------------------------------------ SHP

def _ring_list(points: np.ndarray, parts: list) -> list:
    bounds = list(parts) + [len(points)]
    return [points[bounds[i]:bounds[i + 1]] for i in range(len(parts)) if bounds[i + 1] - bounds[i] > 0]


def shape_to_wkb(content: bytes):
    """One ``.shp`` record content to ``(wkb, (minx, miny, maxx, maxy))``; NULL shape gives ``(None, None)``."""
    if len(content) < 4:
        return None, None
    (stype,) = struct.unpack_from("<i", content, 0)
    if stype not in (0, 1, 3, 5, 8, 11, 13, 15, 18, 21, 23, 25, 28):
        raise ValueError(f"shp: shape type {stype} is not supported")
    base = stype % 10
    if base == 0:
        return None, None
    if base == 1:
        x, y = struct.unpack_from("<2d", content, 4)
        return wkb.point_bytes(np.array([x, y])), (x, y, x, y)
    box = struct.unpack_from("<4d", content, 4)
    if base == 8:
        (npts,) = struct.unpack_from("<i", content, 36)
        pts = np.frombuffer(content, dtype="<f8", count=2 * npts, offset=40).reshape(-1, 2)
        return wkb.encode(wkb.Shape(points=[p for p in pts.astype(float)])), box
    nparts, npts = struct.unpack_from("<2i", content, 36)
    parts = struct.unpack_from(f"<{nparts}i", content, 44)
    pts = np.frombuffer(content, dtype="<f8", count=2 * npts, offset=44 + 4 * nparts).reshape(-1, 2).astype(float)
    rings = _ring_list(pts, parts)
    if base == 3:
        return wkb.encode(wkb.Shape(lines=rings)), box
    # a ring with fewer than three corners is kept: validity and repair see it
    rings = [g.clean_ring(r) for r in rings]
    if not rings:
        return wkb.encode(wkb.Shape(), empty_type=wkb.POLYGON), box
    if len(rings) == 1:
        r = rings[0]
        if g.ring_area2(r) < 0:
            r = r[::-1]
        return wkb.polygon_bytes([r]), box
    # shapefile shells run clockwise; flip so shells are counter-clockwise, then group holes
    return wkb.encode(wkb.Shape(polygons=_group([r[::-1].copy() for r in rings]))), box


def _group(rings: list) -> list:
    """Shells with their holes.  Every ring is kept: one without area is a shell, so is a hole outside all shells;
    validity and repair see them."""
    polys = [[r] for r in rings if g.ring_area2(r) >= 0]
    sizes = [g.ring_area2(p[0]) for p in polys]
    for hole in (r for r in rings if g.ring_area2(r) < 0):
        x, y = hole[:-1, 0], hole[:-1, 1]
        around = [k for k, p in enumerate(polys) if sizes[k] > 0 and (
            g.points_in(x, y, g.edges_of([[p[0]]])) | g.points_on(x, y, g.edges_of([[p[0]]]), 0.0)).all()]
        if around:
            polys[min(around, key=sizes.__getitem__)].append(hole)
        else:
            polys.append([hole[::-1].copy()])
            sizes.append(0.0)
    return polys


# ------------------------------------------------------------- data source

class _FilePart(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def _stem(path: str) -> str:
    return path[:-4] if path.lower().endswith(".shp") else path


def _companion(path: str, ext: str) -> str:
    stem = _stem(path)
    for e in (ext, ext.upper()):
        if fs.exists(stem + e):
            return stem + e
    return stem + ext


#: DBF language driver bytes.
_LANGUAGE = {0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x57: "cp1252", 0x64: "cp852", 0x65: "cp866", 0xC8: "cp1250", 0xC9: "cp1251"}


def _encoding(path: str, chosen: str | None) -> str:
    """The reader's option, the ``.cpg`` file, the table's language byte, or Latin-1."""
    if chosen:
        return chosen
    cpg = _companion(path, ".cpg")
    if fs.exists(cpg):
        name = fs.read_all(cpg).decode("ascii", "replace").strip()
        if name:
            return {"UTF8": "utf-8", "UTF-8": "utf-8", "88591": "latin-1", "ISO-8859-1": "latin-1",
                    "LATIN1": "latin-1", "1252": "cp1252"}.get(name.upper(), name)
    return _LANGUAGE.get(fs.read_range(_companion(path, ".dbf"), 29, 1)[0], "latin-1")


def _dbf_fields(path: str) -> list:
    dbf = _companion(path, ".dbf")
    head = fs.read_range(dbf, 0, 32)
    _, hlen, _, _ = dbf_header(head + b"\x0d")
    return dbf_header(fs.read_range(dbf, 0, hlen))[3]


class ShapefileDataSource(DataSource):
    """``spark.read.format("shp").option("columns", "oid,funktion").load("root/*/Layer.shp")``"""

    @classmethod
    def name(cls) -> str:
        return "shp"

    def _files(self) -> list:
        path = self.options.get("path")
        if not path and not self.options.get("files"):
            raise ValueError("shp: no path given")
        recursive = _true(self.options, "recursiveFileLookup", False)
        self.sizes: dict = {}
        if self.options.get("files"):
            files = sorted(self.options["files"].split("\n"))
        else:
            files = [f for f in fs.expand(path, recursive, self.sizes) if f.lower().endswith(".shp")]
        other = self.options.get("pairedWith")
        if other:
            folders = {posixpath.dirname(f) for f in fs.expand(other, recursive)}
            files = [f for f in files if posixpath.dirname(f) in folders]
        if not files:
            raise FileNotFoundError(f"no shapefile matches {path}" + (f" beside {other}" if other else ""))
        return files

    def schema(self):
        files = self._files()
        wanted = _wanted(self.options)
        fields: dict = {}
        with ThreadPoolExecutor(32) as pool:
            heads = list(pool.map(_dbf_fields, files))
        for head in heads:
            for name, ftype, _, length, dec in head:
                t = field_type(ftype, length, dec)
                prev = fields.get(name)
                if prev is None:
                    fields[name] = t
                elif type(prev) is not type(t):
                    num = (IntegerType, LongType, DoubleType)
                    if isinstance(prev, num) and isinstance(t, num):
                        fields[name] = DoubleType() if DoubleType in (type(prev), type(t)) else LongType()
                    else:
                        fields[name] = StringType()
        fields = {_attribute(n): t for n, t in fields.items()}
        names = list(fields)
        if wanted is not None:
            missing = [n for n in wanted if n not in fields]
            if missing:
                raise ValueError(f"shp: columns not found: {missing}")
            names = [n for n in wanted]
        geometry = [StructField("geometry", BinaryType())] if _true(self.options, "geometry", True) else []
        return StructType([StructField(n, fields[n]) for n in names] + geometry + [
            StructField("bbox", BBOX_TYPE),
            StructField("source_file", StringType()),
            StructField("record_no", LongType()),
            StructField("county", StringType()),
        ])

    def reader(self, schema):
        return ShapefileReader(self.options, schema, self._files(), self.sizes)

    def writer(self, schema, overwrite):
        return ShapefileWriter(self.options, schema, overwrite)


def _attribute(name: str) -> str:
    """A table field named like one of the reader's own columns gets a suffix."""
    return f"{name}_attr" if name in EXTRA_COLUMNS else name


def _true(options, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


def _county(path: str) -> str:
    return posixpath.basename(posixpath.dirname(fs.filesystem(path)[1]))


#: Comparisons that are tested on the header's bounding box.
_COMPARE = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal,
            EqualTo: np.equal, EqualNullSafe: np.equal}
_CORNERS = ("minx", "miny", "maxx", "maxy")


def _wanted(options):
    cols = options.get("columns")
    if not cols:
        return None
    return [c.strip() for c in cols.split(",") if c.strip() and c.strip() not in EXTRA_COLUMNS]


class ShapefileReader(DataSourceReader):
    def __init__(self, options, schema, files, sizes=None):
        self.options = options
        self.schema = schema
        self.files = files
        self.sizes = sizes or {}
        self.per_part = int(self.options.get("recordsPerPartition", 100_000))
        self.part_bytes = int(self.options.get("bytesPerPartition", 64 << 20))
        self.batch_bytes = int(self.options.get("bytesPerBatch", 8 << 20))
        self.encoding = self.options.get("encoding")
        self.boxes: list = []

    def pushFilters(self, filters):
        """Filters on county and file leave out files, filters on the bounding box wait for the records' headers;
        both are exact, so Spark gets the others back only."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if name in (("county",), ("source_file",)) and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull)):
                of = _county if name == ("county",) else str
                if isinstance(f, In):
                    self.files = [x for x in self.files if of(x) in f.value]
                elif isinstance(f, StringStartsWith):
                    self.files = [x for x in self.files if of(x).startswith(f.value)]
                elif not isinstance(f, IsNotNull):
                    self.files = [x for x in self.files if of(x) == f.value]
            elif len(name) == 2 and name[0] == "bbox" and name[1] in _CORNERS and type(f) in _COMPARE and isinstance(f.value, (int, float)):
                self.boxes.append((_CORNERS.index(name[1]), _COMPARE[type(f)], float(f.value)))
            elif name[:1] == ("bbox",) and isinstance(f, IsNotNull):
                self.boxes.append((0, np.equal, None))
            else:
                yield f

    def _size(self, path: str) -> int:
        known = self.sizes.get(path)
        if known is None:
            fsys, p = fs.filesystem(path)
            known = max(0, fsys.get_file_info(p).size or 0)
        return known

    def partitions(self):
        parts = []
        for f in self.files:
            shx = next((x for x in (_stem(f) + ".shx", _stem(f) + ".SHX") if x in self.sizes), None) or _companion(f, ".shx")
            n = max(0, (self._size(shx) - 100) // 8)
            # so many records that a range has about part_bytes; a range is read batch by batch in any case
            step = max(1, min(self.per_part, -(-n // max(1, -(-self._size(f) // self.part_bytes)))))
            for s in range(0, max(n, 1), step):
                parts.append(_FilePart(f, s, min(n, s + step)))
        return parts or [_FilePart("", 0, 0)]

    def read(self, partition):
        f, start, end = partition.path, partition.start, partition.end
        if end <= start:
            return
        idx = np.frombuffer(fs.read_range(_companion(f, ".shx"), 100 + 8 * start, 8 * (end - start)), dtype=">i4").reshape(-1, 2)
        offs, lens = (idx[:, k].astype(np.int64) * 2 for k in (0, 1))
        dbf = _companion(f, ".dbf")
        _, hlen, rlen, _ = dbf_header(fs.read_range(dbf, 0, 32) + b"\x0d")
        fields = {_attribute(fl[0]): fl for fl in dbf_header(fs.read_range(dbf, 0, hlen))[3]}
        enc = _encoding(f, self.encoding)
        total = np.cumsum(lens + rlen)
        a = 0
        while a < len(idx):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.batch_bytes, "right")))
            lo, hi = int(offs[a:b].min()), int((offs[a:b] + 8 + lens[a:b]).max())
            shp = np.frombuffer(fs.read_range(f, lo, hi - lo), np.uint8)
            kind, box = columnar.headers(shp, offs[a:b] - lo + 8, lens[a:b])
            keep = np.ones(b - a, bool)
            for corner, compare, value in self.boxes:
                keep &= ~np.isnan(box[:, corner]) if value is None else compare(box[:, corner], value)
            if keep.any():
                raw = fs.read_range(dbf, hlen + (start + a) * rlen, (b - a) * rlen)
                block = np.frombuffer(raw, dtype=np.uint8)[: (b - a) * rlen].reshape(b - a, rlen)
                rows = np.flatnonzero(keep & (block[:, 0] != 0x2A))  # records marked as deleted do not exist
                if len(rows):
                    yield self._batch(f, start + a + rows, shp, (offs[a:b] - lo + 8)[rows], lens[a:b][rows], kind[rows], box[rows], block[rows], fields, enc)
            a = b

    def _batch(self, f, numbers, shp, at, size, kind, box, block, fields, enc):
        """The records ``numbers``, with their attribute rows in ``block``."""
        n = len(numbers)
        null = np.isnan(box[:, 0])
        own = {
            "bbox": lambda: pa.StructArray.from_arrays([pa.array(box[:, k], mask=null) for k in range(4)], names=list(_CORNERS), mask=pa.array(null)),
            "geometry": lambda: _geometries(shp, at, size, kind),
            "source_file": lambda: pa.array([f]).take(pa.array(np.zeros(n, np.int32))),
            "record_no": lambda: pa.array(numbers.astype(np.int64)),
            "county": lambda: pa.array([_county(f)]).take(pa.array(np.zeros(n, np.int32))),
        }
        arrays = []
        for fld in self.schema.fields:
            if fld.name in own:
                arrays.append(own[fld.name]())
            elif fld.name in fields:
                arrays.append(_decode_column(block, fields[fld.name], enc).cast(_arrow_type(fld.dataType)))
            else:
                arrays.append(pa.nulls(n, type=_arrow_type(fld.dataType)))
        return pa.RecordBatch.from_arrays(arrays, names=[fld.name for fld in self.schema.fields])


def _geometries(shp: np.ndarray, at: np.ndarray, size: np.ndarray, kind: np.ndarray) -> pa.Array:
    """WKB of records: polygons of one sound ring all at once, the others one by one."""
    fast, found = columnar.single_rings(shp, at, size, kind)
    rest = np.setdiff1d(np.arange(len(at)), fast)
    slow = pa.array([shape_to_wkb(shp[a : a + s].tobytes())[0] for a, s in zip(at[rest].tolist(), size[rest].tolist(), strict=True)], pa.binary())
    place = np.empty(len(at), np.int64)
    place[np.concatenate([fast, rest])] = np.arange(len(at))
    return pa.concat_arrays([found, slow]).take(pa.array(place))


def _arrow_type(t):
    return {
        StringType: pa.string(), IntegerType: pa.int32(), LongType: pa.int64(), DoubleType: pa.float64(),
        DateType: pa.date32(), BooleanType: pa.bool_(), BinaryType: pa.binary(),
    }.get(type(t), pa.string())


# ---------------------------------------------------------------- writing

#: Bytes of geometry that are encoded at once, of a layer's rows before they are, and of all layers' rows of a task.
ENCODE_BYTES, LAYER_BYTES, TASK_BYTES = 4 << 20, 8 << 20, 48 << 20


def _dbf_spec(name: str, arr: pa.Array):
    """Name, type, width and decimals of a column that holds these values."""
    t = arr.type
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        width = pc.max(pc.binary_length(arr)).as_py() or 1
        if width > 254:
            raise ValueError(f"shp: a text of {name} has {width} bytes, the format holds 254")
        return (name, "C", width, 0)
    if pa.types.is_integer(t):
        low, high = pc.min_max(arr).as_py().values()
        if t.bit_width < 64 and pa.types.is_signed_integer(t):
            return (name, "N", 9 if low is None or -99999999 <= low and high <= 999999999 else 18, 0)
        return (name, "N", max(18, *(len(str(v)) for v in (low, high) if v is not None), 0), 0)
    if pa.types.is_floating(t):
        return (name, "F", 24, 16)
    if pa.types.is_date(t):
        return (name, "D", 8, 0)
    if pa.types.is_boolean(t):
        return (name, "L", 1, 0)
    return (name, "C", 254, 0)


def _dbf_texts(arr: pa.Array, spec) -> pa.Array:
    """The values of a column as their bytes, not padded yet."""
    _, ftype, _, dec = spec
    t = arr.type
    if ftype == "C" and (pa.types.is_string(t) or pa.types.is_large_string(t)):
        return arr.cast(pa.large_binary())
    if ftype == "N":
        return arr.cast(pa.string()).cast(pa.large_binary())
    if ftype == "D":
        return pc.strftime(arr.cast(pa.timestamp("s")), "%Y%m%d").cast(pa.large_binary())
    if ftype == "L":
        return pc.if_else(arr, "T", "F").cast(pa.large_binary())
    if ftype != "F" and arr.null_count < len(arr):
        raise ValueError(f"shp: the format has no field for {spec[0]}, of type {t}")
    return pa.array([None if v is None else f"{float(v):.{dec}e}".encode() for v in arr.to_pylist()], pa.large_binary())


def _dbf_rows(columns: dict, specs: list) -> np.ndarray:
    """Attribute rows as a matrix of bytes: texts to the left of their fields, numbers to the right, nulls blank."""
    n = len(next(iter(columns.values()))) if columns else 0
    out = np.full((n, 1 + sum(s[2] for s in specs)), 0x20, np.uint8)
    off = 1
    for spec in specs:
        texts = pc.fill_null(_dbf_texts(columns[spec[0]], spec), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
        size = np.diff(offsets)
        of = np.repeat(np.arange(n), size)
        place = np.arange(len(of)) - (offsets[:-1] - offsets[:1])[of] if n else of
        out[of, off + place + (spec[2] - size[of] if spec[1] in "NF" else 0)] = data
        off += spec[2]
    return out


def _dbf_head(specs: list, n: int) -> bytes:
    long = [s[0] for s in specs if not s[0].isascii() or len(s[0]) > 10]
    if long:
        raise ValueError(f"shp: field names hold at most 10 ASCII characters: {long}")
    today = _dt.date.today()
    out = [struct.pack("<BBBBIHH20x", 3, today.year - 1900, today.month, today.day, n, 32 + 32 * len(specs) + 1, 1 + sum(s[2] for s in specs))]
    for name, ftype, width, dec in specs:
        out.append(struct.pack("<11sc4xBB14x", name.encode("ascii", "replace"), ftype.encode(), width, dec))
    return b"".join(out) + b"\x0d"


def write_dbf(columns: dict) -> bytes:
    specs = [_dbf_spec(nm, columns[nm]) for nm in columns]
    n = len(next(iter(columns.values()))) if columns else 0
    return _dbf_head(specs, n) + _dbf_rows(columns, specs).tobytes() + b"\x1a"


def _shp_record(gbytes) -> tuple[int, bytes, tuple | None]:
    if gbytes is None:
        return 0, struct.pack("<i", 0), None
    s = wkb.parse(gbytes)
    if sum(map(bool, (s.polygons, s.lines, s.points))) > 1 or len(s.points) > 1:
        raise ValueError("shp: mixed collections and multipoints cannot be written")
    if s.polygons:
        rings = []
        for p in g.oriented(s.polygons):
            rings.extend(r[::-1] for r in p)  # shapefile: shells clockwise, holes counter-clockwise
        kind = 5
    elif s.lines:
        rings, kind = s.lines, 3
    elif s.points:
        x, y = s.points[0]
        return 1, struct.pack("<i2d", 1, x, y), (x, y, x, y)
    else:
        return 0, struct.pack("<i", 0), None
    pts = np.vstack(rings)
    box = (pts[:, 0].min(), pts[:, 1].min(), pts[:, 0].max(), pts[:, 1].max())
    parts = np.cumsum([0] + [len(r) for r in rings[:-1]]).astype("<i4")
    body = struct.pack("<i4d2i", kind, *box, len(rings), len(pts)) + parts.tobytes() + np.ascontiguousarray(pts, "<f8").tobytes()
    return kind, body, box


def _shp_records(geoms: pa.Array, number: int) -> tuple[np.ndarray, np.ndarray, set, np.ndarray]:
    """Records from ``number`` on with their headers as one run of bytes, their contents' lengths, kinds and boxes.
    Polygons of sound rings all at once, the others one by one."""
    n = len(geoms)
    row, shell, npts, xy, parsed = batch.ring_table(geoms)
    start = np.cumsum(npts) - npts
    of = np.repeat(np.arange(len(row)), npts)
    last = np.zeros(len(xy), bool)
    last[(start + npts - 1)[npts > 0]] = True
    repeats = np.append((xy[1:] == xy[:-1]).all(axis=1), False) & ~last
    sound = (npts >= 4) & (xy[start] == xy[start + npts - 1]).all(axis=1) & ~np.bincount(of, repeats, minlength=len(row)).astype(bool)
    parts = np.bincount(row, minlength=n)
    fast = parsed & (parts > 0)
    fast[row[~sound]] = False
    use = fast[row]
    row, shell, npts, start, parts = row[use], shell[use], npts[use], start[use], parts[fast]
    points = np.bincount(row, npts, minlength=n).astype(np.int64)[fast]
    size = np.zeros(n, np.int64)
    size[fast] = 44 + 4 * parts + 16 * points
    slow = {i: _shp_record(v) for i, v in zip(np.flatnonzero(~fast).tolist(), geoms.filter(pa.array(~fast)).to_pylist(), strict=True)}
    size[list(slow)] = [len(body) for _, body, _ in slow.values()]
    at = np.cumsum(8 + size) - size
    out = np.empty(int((8 + size).sum()), np.uint8)
    heads = np.column_stack([number + np.arange(n) + 1, size // 2]).astype(">i4")
    out[(at - 8)[:, None] + np.arange(8)] = heads.view(np.uint8).reshape(n, 8)
    # shells clockwise, holes counter-clockwise
    area2 = ring_areas2(xy, start, npts)
    flip = ~np.where(shell, area2 < 0, area2 > 0)
    of = np.repeat(np.arange(len(row)), npts)
    j = np.arange(len(of)) - (np.cumsum(npts) - npts)[of]
    xy = xy[start[of] + np.where(flip[of], npts[of] - 1 - j, j)]
    boxes = np.empty((len(points), 4), "<f8")
    for k in range(4) if len(points) else ():
        boxes[:, k] = (np.minimum if k < 2 else np.maximum).reduceat(xy[:, k % 2], np.cumsum(points) - points)
    own = at[fast]
    body = np.empty((len(points), 44), np.uint8)
    body[:, :4] = np.frombuffer(struct.pack("<i", 5), np.uint8)
    body[:, 4:36] = boxes.view(np.uint8)
    body[:, 36:] = np.column_stack([parts, points]).astype("<i4").view(np.uint8)
    out[own[:, None] + np.arange(44)] = body
    name = (np.cumsum(fast) - 1)[row]  # a ring's record among the fast ones
    place = np.arange(len(row)) - (np.cumsum(parts) - parts)[name]
    first = (np.cumsum(npts) - npts) - (np.cumsum(points) - points)[name]
    out[(own[name] + 44 + 4 * place)[:, None] + np.arange(4)] = np.ascontiguousarray(first, "<i4").view(np.uint8).reshape(-1, 4)
    to = own[name[of]] + 44 + 4 * parts[name[of]] + 16 * (first[of] + j)
    out[to[:, None] + np.arange(16)] = np.ascontiguousarray(xy, "<f8").view(np.uint8).reshape(-1, 16)
    for i, (_, content, _) in slow.items():
        out[at[i] : at[i] + size[i]] = np.frombuffer(content, np.uint8)
    kinds = {kind for kind, _, _ in slow.values() if kind} | ({5} if len(points) else set())
    return out, size, kinds, np.array([*boxes, *(box for _, _, box in slow.values() if box)]).reshape(-1, 4)


class _Layer:
    """The files of a layer while its rows arrive: records, index and attributes lie in a local folder until lengths and
    field widths are known, which stand first in the files."""

    def __init__(self, folder: str):
        self.base = f"{folder}/{uuid.uuid4().hex}"
        self.rows, self.pos, self.kinds, self.specs = 0, 100, set(), None
        self.box = np.array([np.inf, np.inf, -np.inf, -np.inf])
        self.waiting: list = []
        self.waiting_bytes = 0

    def add(self, geoms: pa.Array, columns: dict) -> None:
        specs = [_dbf_spec(nm, columns[nm]) for nm in columns]
        self.specs = [(*a[:2], max(a[2], b[2]), a[3]) for a, b in zip(self.specs or specs, specs, strict=True)]
        ends = np.cumsum(pc.fill_null(pc.binary_length(geoms), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        with open(f"{self.base}.shp", "ab") as shp, open(f"{self.base}.shx", "ab") as shx, open(f"{self.base}.dbf", "ab") as dbf:
            i = 0
            while i < len(geoms):
                k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ENCODE_BYTES, "right")))
                records, size, kinds, boxes = _shp_records(geoms.slice(i, k - i), self.rows + i)
                at = self.pos + np.cumsum(8 + size) - 8 - size
                self.pos += len(records)
                if self.pos // 2 >= 1 << 31:
                    raise ValueError("shp: a file holds less than 4 GB")
                shp.write(records)
                shx.write(np.column_stack([at // 2, size // 2]).astype(">i4").tobytes())
                self.kinds |= kinds
                if len(boxes):
                    self.box = np.concatenate([np.minimum(self.box[:2], boxes[:, :2].min(axis=0)), np.maximum(self.box[2:], boxes[:, 2:].max(axis=0))])
                i = k
            if columns:
                rows = pa.record_batch(list(columns.values()), names=list(columns))
                with pa.ipc.new_stream(dbf, rows.schema) as stream:
                    stream.write_batch(rows)
        self.rows += len(geoms)

    def _attributes(self):
        yield _dbf_head(self.specs or [], self.rows)
        size = os.path.getsize(f"{self.base}.dbf")
        with pa.OSFile(f"{self.base}.dbf") as f:
            while f.tell() < size:
                for rows in pa.ipc.open_stream(f):
                    for i in range(0, rows.num_rows, 50_000):
                        part = rows.slice(i, 50_000)
                        yield _dbf_rows(dict(zip(part.schema.names, part.columns, strict=True)), self.specs)
        yield b"\x1a"

    def _file(self, suffix: str, length: int):
        box = self.box if np.isfinite(self.box).any() or self.kinds else np.zeros(4)
        yield (struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2)
               + struct.pack("<2i4d4d", 1000, max(self.kinds) if self.kinds else 5, *box, 0, 0, 0, 0))
        with open(self.base + suffix, "rb") as f:
            while chunk := f.read(8 << 20):
                yield chunk

    def close(self, stem: str, prj: str | None) -> None:
        """Write ``stem.shp/.shx/.dbf/.cpg`` (and ``.prj``)."""
        fs.write_chunks(stem + ".shp", self._file(".shp", self.pos))
        fs.write_chunks(stem + ".shx", self._file(".shx", 100 + 8 * self.rows))
        fs.write_chunks(stem + ".dbf", self._attributes())
        fs.write_bytes(stem + ".cpg", b"UTF-8")
        if prj:
            fs.write_bytes(stem + ".prj", prj.encode("utf-8"))
        for suffix in (".shp", ".shx", ".dbf"):
            os.unlink(self.base + suffix)


def write_shapefile(stem: str, geoms: list, columns: dict, prj: str | None = None) -> None:
    """Write ``stem.shp/.shx/.dbf/.cpg`` (and ``.prj``) for one layer."""
    with tempfile.TemporaryDirectory() as folder:
        layer = _Layer(folder)
        layer.add(pa.array(geoms, pa.binary()), columns)
        layer.close(stem, prj)


class ShapefileWriter(DataSourceArrowWriter):
    """Each task writes its rows as ``<path>/<partitionBy value>/<layer>.shp``.

    Rows of one ``partitionBy`` value must sit in one task (``repartition`` on
    it first).  A task holds some megabytes of rows: they are encoded as they
    arrive, into files in the executor's local folder.  Finished files go to a
    task folder under ``_temporary`` and are moved into place by the driver's
    ``commit``; ``abort`` removes them.
    """

    def __init__(self, options, schema, overwrite):
        self.options = options
        self.schema = schema
        self.overwrite = overwrite
        self.path = self.options["path"].rstrip("/")
        self.layer = self.options.get("layer", "layer")
        self.part_col = self.options.get("partitionBy")
        self.geom = self.options.get("geometry", "geometry")
        self.job = self.options.get("jobId") or uuid.uuid4().hex

    def _groups(self, rows: pa.RecordBatch):
        if not self.part_col:
            yield None, rows
            return
        keys = rows.column(self.part_col).dictionary_encode()
        number = pc.fill_null(keys.indices, -1).to_numpy(zero_copy_only=False)
        values, first = np.unique(number, return_index=True)
        for v in values[np.argsort(first)].tolist():
            yield None if v < 0 else keys.dictionary[v].as_py(), rows.take(pa.array(np.flatnonzero(number == v)))

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        task = f"{ctx.partitionId() if ctx else 0}-{uuid.uuid4().hex[:8]}"
        drop = {self.geom, "bbox", self.part_col}
        layers: dict = {}

        def encode(layer):
            rows = pa.Table.from_batches(layer.waiting).combine_chunks()
            columns = {c: batch.as_array(rows.column(c)) for c in rows.column_names if c not in drop}
            layer.add(batch.as_array(rows.column(self.geom)), columns)
            layer.waiting, layer.waiting_bytes = [], 0

        written = []
        tmp_root = f"{self.path}/_temporary/{self.job}/{task}"
        # the executor's folder for shuffle files is where a task may put much data
        with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
            for rows in iterator:
                for key, some in self._groups(rows):
                    if key not in layers:
                        layers[key] = _Layer(folder)
                    layer = layers[key]
                    layer.waiting.append(some)
                    layer.waiting_bytes += some.nbytes
                    if layer.waiting_bytes > LAYER_BYTES:
                        encode(layer)
                if sum(x.waiting_bytes for x in layers.values()) > TASK_BYTES:
                    for layer in layers.values():
                        if layer.waiting:
                            encode(layer)
            for key, layer in layers.items():
                if layer.waiting:
                    encode(layer)
                rel = f"{key}/{self.layer}" if self.part_col else f"part-{task}/{self.layer}"
                layer.close(f"{tmp_root}/{rel}", self.options.get("prj"))
                written.append(rel)
        return _Written([(tmp_root, rel) for rel in written])

    def commit(self, messages):
        for m in messages:
            for tmp_root, rel in m.files:
                for ext in (".shp", ".shx", ".dbf", ".cpg", ".prj"):
                    src = f"{tmp_root}/{rel}{ext}"
                    if fs.exists(src):
                        dst = f"{self.path}/{rel}{ext}"
                        if fs.exists(dst):
                            fs.delete_file(dst)
                        fs.move(src, dst)
        fs.delete_dir(f"{self.path}/_temporary/{self.job}")

    def abort(self, messages):
        fs.delete_dir(f"{self.path}/_temporary/{self.job}")


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


#: Fixed value: the published PROJJSON of ETRS89 / UTM zone 33N (EPSG:25833).
UTM33N = json.loads("""
{"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json",
 "type": "ProjectedCRS",
 "name": "ETRS89 / UTM zone 33N",
 "base_crs": {
  "name": "ETRS89",
  "datum_ensemble": {
   "name": "European Terrestrial Reference System 1989 ensemble",
   "members": [
    {"name": "European Terrestrial Reference Frame 1989"},
    {"name": "European Terrestrial Reference Frame 1990"},
    {"name": "European Terrestrial Reference Frame 1991"},
    {"name": "European Terrestrial Reference Frame 1992"},
    {"name": "European Terrestrial Reference Frame 1993"},
    {"name": "European Terrestrial Reference Frame 1994"},
    {"name": "European Terrestrial Reference Frame 1996"},
    {"name": "European Terrestrial Reference Frame 1997"},
    {"name": "European Terrestrial Reference Frame 2000"},
    {"name": "European Terrestrial Reference Frame 2005"},
    {"name": "European Terrestrial Reference Frame 2014"}],
   "ellipsoid": {"name": "GRS 1980", "semi_major_axis": 6378137, "inverse_flattening": 298.257222101},
   "accuracy": "0.1"},
  "coordinate_system": {
   "subtype": "ellipsoidal",
   "axis": [
    {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"},
    {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"}]},
  "id": {"authority": "EPSG", "code": 4258}},
 "conversion": {
  "name": "UTM zone 33N",
  "method": {"name": "Transverse Mercator", "id": {"authority": "EPSG", "code": 9807}},
  "parameters": [
   {"name": "Latitude of natural origin", "value": 0, "unit": "degree", "id": {"authority": "EPSG", "code": 8801}},
   {"name": "Longitude of natural origin", "value": 15, "unit": "degree", "id": {"authority": "EPSG", "code": 8802}},
   {"name": "Scale factor at natural origin", "value": 0.9996, "unit": "unity", "id": {"authority": "EPSG", "code": 8805}},
   {"name": "False easting", "value": 500000, "unit": "metre", "id": {"authority": "EPSG", "code": 8806}},
   {"name": "False northing", "value": 0, "unit": "metre", "id": {"authority": "EPSG", "code": 8807}}]},
 "coordinate_system": {
  "subtype": "Cartesian",
  "axis": [
   {"name": "Easting", "abbreviation": "E", "direction": "east", "unit": "metre"},
   {"name": "Northing", "abbreviation": "N", "direction": "north", "unit": "metre"}]},
 "scope": "Engineering survey, topographic mapping.",
 "area": "Europe between 12°E and 18°E: Austria; Denmark - offshore and offshore; Germany - onshore and offshore; Norway including Svalbard - onshore and offshore.",
 "bbox": {"south_latitude": 46.4, "west_longitude": 12, "north_latitude": 84.42, "east_longitude": 18.01},
 "id": {"authority": "EPSG", "code": 25833}}
""")


def crs_projjson(crs: str | None) -> dict | None:
    """PROJJSON for the GeoParquet ``crs`` field; accepts PROJJSON text or ``EPSG:<code>``."""
    if not crs:
        return None
    crs = crs.strip()
    if crs.startswith("{"):
        return json.loads(crs)
    if crs.upper() == "EPSG:25833":
        return UTM33N
    raise ValueError(f"unsupported crs {crs!r}: give the full PROJJSON object, or EPSG:25833")
