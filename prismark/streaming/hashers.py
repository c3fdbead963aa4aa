"""Stateful hashing of streams of pieces.

The state of an asset is 64 minima and the unfinished chunk (data code), the chaining values of complete subtrees and at
most one chunk (instance code), and a count: a few kilobytes, however long the asset is. Pieces of one asset must arrive
in order across micro-batches; within one they are sorted. Each piece's ``seq`` is one more than that of the piece before.

An asset ends by its ``last`` flag, with a row of its codes and the status ``complete``. Everything else that happens to an
asset is told by a row without codes, whose status says what: a piece that isn't the next one ends its asset (late, out of
order, missing or repeated pieces would make another asset's codes), and pieces after the end are reported, not taken for
a new asset. With a ``timeout`` an asset of which no piece came for so long is given up, with a row, and the mark that an
asset has ended, a few bytes, is kept for so long after its last piece; without one marks stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prismark.kernels.codec import composed
from prismark.kernels.codes import DataHasher, InstanceHasher

OUTPUT = "asset_id string, data_code string, instance_code string, sum_code string, datahash string, filesize long, status string"
COMPLETE, AFTER_THE_END, GIVEN_UP = "complete", "pieces after the end", "given up"


def stream_codes(pieces: DataFrame, bits: int = 64, timeout: str | None = None) -> DataFrame:
    """A streaming frame ``asset_id, seq, data, last`` to rows for finished and broken assets, in append mode."""
    patience = None if timeout is None else int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def tell(status: str, codes: tuple = (None,) * 4, size: int | None = None) -> None:
            out.append((str(key[0]), *codes, size, status))

        hashers, following, ended = (pickle.loads(state.get[0]), *state.get[1:]) if state.exists else ((DataHasher(), InstanceHasher()), None, False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                tell(GIVEN_UP, size=hashers[1].size)
        else:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for seq, raw, last in zip(rows["seq"], rows["data"], rows["last"], strict=True):
                if ended:
                    tell(AFTER_THE_END)
                    break
                if following is not None and seq != following:
                    tell(f"expected piece {following}, got {seq}", size=hashers[1].size)
                    ended = True
                    break
                for h in hashers:
                    h.update(bytes(raw) if raw is not None else b"")
                following = int(seq) + 1
                if last:
                    d, i = (h.finalize(bits) for h in hashers)
                    tell(COMPLETE, (d["iscc"], i["iscc"], composed([d["iscc"], i["iscc"]]), i["datahash"]), i["filesize"])
                    ended = True
            state.update((pickle.dumps(None if ended else hashers), following, ended))
            if patience is not None:
                state.setTimeoutDuration(patience)
        if out:
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])
            yield frame.astype({"filesize": "Int64"})

    kind = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout
    return pieces.select("asset_id", "seq", "data", "last").groupBy("asset_id").applyInPandasWithState(step, OUTPUT, "hashers binary, following long, ended boolean", "append", kind)
