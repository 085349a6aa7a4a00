"""Data sources: shapefile reader/writer (``shp``) and GeoParquet writer (``gpq``)."""


def register_sources(spark) -> None:
    from .geoparquet import GeoParquetDataSource
    from .shapefile import ShapefileDataSource

    spark.dataSource.register(ShapefileDataSource)
    spark.dataSource.register(GeoParquetDataSource)
