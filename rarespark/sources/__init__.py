"""Sources and sinks of series."""

from rarespark.sources.series import read_manifest, read_series, write_csv

__all__ = ["read_manifest", "read_series", "write_csv"]
