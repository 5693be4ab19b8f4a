"""Rows of many files handed on together: a batch for each file would cost a task milliseconds a file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from itertools import accumulate, chain

import pyarrow as pa

#: Rows and bytes of texts and contents that are handed on at once.
ROWS, BYTES = 10_000, 16 << 20
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _column(values: tuple, of: str) -> pa.Array:
    if of.startswith("array<struct<"):  # no null, its structs as tuples
        names, kinds = zip(*(x.split(":") for x in of[13:-2].split(",")), strict=True)
        columns = list(zip(*chain.from_iterable(values), strict=True)) or [()] * len(names)
        return pa.ListArray.from_arrays(pa.array(accumulate(map(len, values), initial=0), pa.int32()), pa.StructArray.from_arrays([_column(c, k) for c, k in zip(columns, kinds, strict=True)], names))
    kind = _TYPES[of]
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return pa.array(values).cast(kind)  # such as whole numbers given as floats


def batches(rows: Iterable[tuple], columns: str, most: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of at most so many rows, each ended by the row that brings it to so many bytes; no rows: no batch. columns as "name type, ...", a type can be array<struct<name:type,...>>."""
    names, kinds = zip(*(x.split() for x in columns.split(", ")), strict=True)
    made = lambda held: pa.RecordBatch.from_arrays([_column(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
    sized, nested = [k for k, x in enumerate(kinds) if x in ("string", "binary")], [k for k, x in enumerate(kinds) if x.startswith("array")]
    held, n = [], 0
    for row in rows:
        held.append(row)
        for k in sized:
            if x := row[k]:
                n += len(x)
        for k in nested:
            n += sum(len(v) for own in row[k] for v in own if type(v) is bytes or type(v) is str)
        if len(held) >= most or n >= size:
            yield made(held)
            held, n = [], 0
    if held:
        yield made(held)


def files(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The files (file, content) of a batch."""
    return ((file.as_py(), content.as_py()) for file, content in zip(batch.column(0), batch.column(1), strict=True))
