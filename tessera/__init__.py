"""tessera: building x parcel map overlay on Spark (WKB geometry, grid-cell spatial join)."""

from .session import register

__all__ = ["register"]
