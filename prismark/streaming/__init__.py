"""Assets that arrive in pieces on a stream: codes when the last piece is there."""

from prismark.streaming.hashers import stream_codes

__all__ = ["stream_codes"]
