"""How row kernels become Arrow functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python objects at a time.
SLICE = 256


def spark_type(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


@lru_cache(maxsize=256)
def _made(kernel: Callable, ddl: str, lenient: bool, batch: bool, given: tuple) -> Callable:
    kind = spark_type(ddl)
    arrow, more = to_arrow_type(kind), dict(given)

    def guarded(row: tuple):
        try:
            return kernel(*row, **more)
        except (ValueError, OverflowError):
            if lenient:
                return None
            raise

    def rows(columns: list[list]) -> list:
        if batch:
            given_rows = list(zip(*columns, strict=True)) if len(columns) > 1 else columns[0]
            some = [i for i, x in enumerate(columns[0]) if x is not None]
            out: list = [None] * len(columns[0])
            for i, x in zip(some, kernel([given_rows[i] for i in some], **more), strict=True):
                if isinstance(x, ValueError) and not lenient:
                    raise x
                out[i] = None if isinstance(x, ValueError) else x
            return out
        return [None if any(x is None for x in row) else guarded(row) for row in zip(*columns, strict=True)]

    def run(*columns: pa.Array) -> pa.Array:
        parts = [pa.array(rows([c.slice(i, SLICE).to_pylist() for c in columns]), arrow) for i in range(0, len(columns[0]), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    # The number of parameters is the number of columns.
    return {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 4: lambda a, b, c, d: run(a, b, c, d), 5: lambda a, b, c, d, e: run(a, b, c, d, e)}, kind


def column(kernel: Callable, ddl: str, *columns: Column | str, lenient: bool = False, batch: bool = False, **given: object) -> Column:
    """``kernel`` over columns; ``given`` are its constant arguments. A null in any column gives null.

    For a ``batch`` kernel only the first column decides about that. It takes a list of values (of tuples, for several columns) and may return errors in place of results.
    """
    by_count, kind = _made(kernel, ddl, lenient, batch, tuple(sorted(given.items())))
    return F.arrow_udf(by_count[len(columns)], kind)(*[F.col(c) if isinstance(c, str) else c for c in columns])
