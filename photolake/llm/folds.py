"""Digests of long groups: the values of a group go through a hash one after another and are never held together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch that is handed back.
ROWS_AT_ONCE = 4096


def joined_digests(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``keys`` and, for each of the binary ``values``, ``<value>_sha256``: the lowercase hex digest of the values joined.

    Rows go in the order of ``order`` (nulls first); rows that tie in all of it must be alike. A digest has to read its
    group in order, so one group is one task's reading, but only the state of its hash is held. A null value counts as
    an empty one, and a null key is a key of its own. No rows, no digests.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = kinds + "".join(f", {v}_sha256 string" for v in values)
    dealt = df.repartition(*keys).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    made = pa.schema([(k, pa.string() if df.schema[k].dataType.simpleString() == "string" else pa.int64()) for k in keys] + [(f"{v}_sha256", pa.string()) for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, done = None, [], []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), made, strict=True)], schema=made)
            done.clear()
            return batch

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            parts = list(zip(*[batch.column(v).to_pylist() for v in values], strict=True))
            for name, part in zip(names, parts, strict=True):
                if name != now:
                    if now is not None:
                        done.append((*now, *(s.hexdigest() for s in states)))
                    if len(done) >= ROWS_AT_ONCE:
                        yield flushed()
                    now, states = name, [hashlib.sha256() for _ in values]
                for state, value in zip(states, part, strict=True):
                    state.update(value or b"")
        if now is not None:
            done.append((*now, *(s.hexdigest() for s in states)))
        if done:
            yield flushed()

    return dealt.select(*keys, *values).mapInArrow(run, schema)
