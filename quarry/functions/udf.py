"""Arrow-batched functions that need no session until they are used."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and bytes of a batch that stand as Python objects at once (a longer row alone).
ROWS, BYTES = 1_000, 4 << 20
_SECTION = pa.struct([("section", pa.string()), ("content", pa.string())])
_CHUNK = pa.struct([("content", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])
_KINDS = {
    "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()),
    "array<struct<section:string,content:string>>": pa.list_(_SECTION), "array<struct<content:string,start_pos:bigint,end_pos:bigint>>": pa.list_(_CHUNK),
}


def in_slices(fn: Callable, kind: pa.DataType) -> Callable[..., pa.Array]:
    """A function of pandas columns over Arrow columns, some rows at a time: a
    batch has no bound in bytes, and its rows are several times as large as
    Python objects."""

    def run(*cols: pa.Array) -> pa.Array:
        n = len(cols[0])
        step = max(1, min(ROWS, n * BYTES // max(1, sum(c.nbytes for c in cols))))
        done = []
        for at in range(0, n, step):
            got = fn(*(c.slice(at, step).to_pandas() for c in cols))
            done.append(pa.array([list(x.items()) if isinstance(x, dict) else x for x in got], kind, from_pandas=True))
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*cols: Column | str) -> Column:
            kind = _KINDS.get(returns.replace(" ", ""))
            if kind is None:
                return F.pandas_udf(fn, returns)(*cols)
            return F.arrow_udf(in_slices(fn, kind), returns)(*cols)

        return call

    return wrap
