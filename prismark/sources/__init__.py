"""Files as assets: whole files by Spark's binary source, long ones as ordered chunks."""

from prismark.sources.files import ChunkedFiles, file_codes, files, reached, spread
from prismark.sources.pieces import piece_codes

__all__ = ["ChunkedFiles", "file_codes", "files", "piece_codes", "reached", "spread"]
