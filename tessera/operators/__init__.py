"""DataFrame operators: spatial join, overlay, dedup, repair."""

from .dedup import concat_layers, drop_duplicates_any, drop_duplicates_first, insert_if_absent
from .overlay import overlay
from .repair import invalid_rows, promote_to_multi, repair
from .spatial_join import candidate_pairs, choose_cell_size, spatial_join, spatial_join_sql, with_bbox

__all__ = ["candidate_pairs", "choose_cell_size", "concat_layers", "drop_duplicates_any", "drop_duplicates_first",
           "insert_if_absent", "invalid_rows", "overlay", "promote_to_multi", "repair", "spatial_join",
           "spatial_join_sql", "with_bbox"]
