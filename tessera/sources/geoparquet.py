"""GeoParquet sink (``df.write.format("gpq")``).

Spark's Parquet writer cannot add a custom footer key, so each task writes
its Arrow batches with ``pyarrow.parquet`` and puts the GeoParquet ``geo``
metadata (version, primary column, WKB encoding, geometry types, bbox, CRS)
in the footer.  Files are written under ``_temporary`` and moved into place
in ``commit`` (``overwrite`` then removes the old part files); ``abort``
removes them.  The output is plain Parquet, readable by ``spark.read.parquet``.

Options: ``geometry`` (column, default ``geometry``), ``version``
(``1.0.0``), ``compression`` (``zstd``), ``crs`` (PROJJSON text or
``EPSG:25833``; omitted means OGC:CRS84 by the specification),
``row_group_size``.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import batch, wkb
from . import fs
from .shapefile import crs_projjson


class GeoParquetDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpq"

    def writer(self, schema, overwrite):
        return GeoParquetWriter(self.options, schema, overwrite)


def _types_and_bbox(arr: pa.Array):
    codes = batch.type_codes(arr)
    names = {wkb.TYPE_NAMES.get(int(c), "Unknown") for c in np.unique(codes[codes > 0])}
    b = batch.bounds(arr)
    ok = ~np.isnan(b[:, 0])
    box = [float(b[ok, 0].min()), float(b[ok, 1].min()), float(b[ok, 2].max()), float(b[ok, 3].max())] if ok.any() else None
    return names, box


class GeoParquetWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite):
        self.options = options
        self.schema = schema
        self.path = self.options["path"].rstrip("/")
        self.overwrite = overwrite
        self.geom = self.options.get("geometry", "geometry")
        self.version = self.options.get("version", self.options.get("geoparquet.version", "1.0.0"))
        self.compression = self.options.get("compression", self.options.get("parquet.compression", "zstd"))
        self.crs = crs_projjson(self.options.get("crs", self.options.get("geoparquet.crs")))
        self.row_group = int(self.options.get("row_group_size", 128 * 1024))
        self.job = self.options.get("jobId") or uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        name = f"part-{pid:05d}-{uuid.uuid4().hex[:12]}.parquet"
        tmp = f"{self.path}/_temporary/{self.job}/{name}"
        writer = None
        types, boxes = set(), []
        fsys, p = fs.filesystem(tmp)
        fsys.create_dir(p.rsplit("/", 1)[0], recursive=True)
        sink = None
        rows = waiting = 0
        held: list = []
        try:
            for rb in iterator:
                if rb.num_rows == 0:
                    continue
                t, box = _types_and_bbox(rb.column(rb.schema.get_field_index(self.geom)))
                types |= t
                if box:
                    boxes.append(box)
                if writer is None:
                    sink = fsys.open_output_stream(p)
                    writer = pq.ParquetWriter(sink, rb.schema, compression=self.compression)
                held.append(rb)
                waiting += rb.num_rows
                rows += rb.num_rows
                if waiting >= self.row_group:
                    writer.write_table(pa.Table.from_batches(held), row_group_size=self.row_group)
                    held, waiting = [], 0
        finally:
            if writer is not None:
                if held:
                    writer.write_table(pa.Table.from_batches(held), row_group_size=self.row_group)
                meta = self._geo(types, boxes)
                writer.add_key_value_metadata({"geo": json.dumps(meta)})
                writer.close()
            if sink is not None:
                sink.close()
        return _Part([tmp] if writer is not None else [], rows, sorted(types), boxes)

    def _geo(self, types, boxes) -> dict:
        col = {"encoding": "WKB", "geometry_types": sorted(types)}
        if boxes:
            b = np.array(boxes)
            col["bbox"] = [float(b[:, 0].min()), float(b[:, 1].min()), float(b[:, 2].max()), float(b[:, 3].max())]
        if self.crs is not None:
            col["crs"] = self.crs
        return {"version": self.version, "primary_column": self.geom, "columns": {self.geom: col}}

    def commit(self, messages):
        # new files first, then the old ones by a list taken before: a failure never leaves less than one full result
        old = [f for f in fs.list_files(self.path, False) if f.endswith(".parquet")] if self.overwrite else []
        files = [tmp for m in messages if m is not None for tmp in m.files]
        if not files:
            self._empty()
        for tmp in files:
            fs.move(tmp, f"{self.path}/{tmp.rsplit('/', 1)[1]}")
        for f in old:
            fs.delete_file(f)
        self._clean()

    def _empty(self):
        """A result without rows is one file with the schema."""
        from pyspark.sql.pandas.types import to_arrow_schema

        fsys, p = fs.filesystem(f"{self.path}/part-00000-{uuid.uuid4().hex[:12]}.parquet")
        fsys.create_dir(p.rsplit("/", 1)[0], recursive=True)
        schema = to_arrow_schema(self.schema)
        meta = {**(schema.metadata or {}), b"geo": json.dumps(self._geo(set(), [])).encode()}
        with fsys.open_output_stream(p) as sink:
            pq.write_table(schema.with_metadata(meta).empty_table(), sink, compression=self.compression)

    def _clean(self):
        fs.delete_dir(f"{self.path}/_temporary/{self.job}")
        if not fs.list_files(f"{self.path}/_temporary"):  # no other job is writing
            fs.delete_dir(f"{self.path}/_temporary")

    def abort(self, messages):
        self._clean()


class _Part(WriterCommitMessage):
    def __init__(self, files, rows, types, boxes):
        self.files, self.rows, self.types, self.boxes = files, rows, types, boxes
