"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

from . import registry
from .plans import coast, diff, imagery, lineage, maps, mesh, planning, raster, scalar, sky, stages, telemetry, zones  # noqa: F401
from .sources import queries as _sources  # noqa: F401
from .streaming import queries as _streaming  # noqa: F401

#: Sums of whole numbers, which DuckDB widens past 64 bits.
LONGS = {
    "ag27_usage_by_level": ["bytes"], "ag36_texture_report": ["bytes"], "ag23_disk_by_rule": ["bytes", "own_bytes"], "ag24_disk_bytes_once": ["bytes"],
    "ag50_space_report": ["bytes"], "ag4_element_area": ["area"], "ag5_lake_decisions": ["area"],
    "src5_read_elevation": ["total"], "src7_read_chunks": ["bytes"], "src13_read_transfers": ["bytes"], "src15_read_mesh": ["attrs"],
    "src16_read_artifact_index": ["params"], "snk1_write_tiled": ["written"], "sm6_rate": ["bytes"], "sm14_written_by_kind": ["bytes"],
}


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    out = dict(registry.ORACLES)
    for name, columns in LONGS.items():
        out[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({out[name]})"
    return out
