"""Values nested to any depth: finding and replacing the texts below named fields.

Finding is an expression built by walking the type: structs field by field, arrays element by element, maps by their values.
Replacing walks the Arrow arrays of a batch in the same way. A text counts if it is in a field of one of the given names, or anywhere below such a field.
"""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def texts(value: Column, kind: T.DataType, names: Collection[str], named: bool = False) -> Column | None:
    """All texts that count, as one array; None if the type has no place for any."""
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(value)) if named else None
    if isinstance(kind, T.StructType):
        parts = [texts(value[f.name], f.dataType, names, named or f.name in names) for f in kind.fields]
        parts = [F.coalesce(p, F.array().cast("array<string>")) for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner, items = (kind.elementType, value) if isinstance(kind, T.ArrayType) else (kind.valueType, F.map_values(value))
        if texts(F.lit(None), inner, names, named) is None:
            return None
        # ``texts`` of a null is null, which ``flatten`` would pass on.
        return F.flatten(F.transform(items, lambda x: F.coalesce(texts(x, inner, names, named), F.array().cast("array<string>"))))
    return None


def replaced(values: pa.Array, kind: T.DataType, names: Collection[str], rows: np.ndarray, known: list[dict[str, str]], named: bool = False) -> pa.Array:
    """``values`` with every text that counts looked up in the table of its row; NULL where it is not in there.

    ``rows`` has the row that each value belongs to. A look-up takes the same time however many texts a row has."""
    if isinstance(kind, T.StringType):
        if not named:
            return values
        return pa.array([None if x is None else known[r].get(x) for r, x in zip(rows.tolist(), values.to_pylist())], pa.string())
    if isinstance(kind, T.StructType):
        fields = [replaced(v, f.dataType, names, rows, known, named or f.name in names) for v, f in zip(values.flatten(), kind.fields)]
        return pa.StructArray.from_arrays(fields, names=kind.names, mask=values.is_null()) if fields else values
    if isinstance(kind, T.ArrayType):
        ends, within = _spread(values, rows)
        return pa.ListArray.from_arrays(ends, replaced(values.flatten(), kind.elementType, names, within, known, named))
    if isinstance(kind, T.MapType):
        ends, within = _spread(values, rows)
        begin, n = values.offsets[0].as_py(), len(within)
        items = replaced(values.items.slice(begin, n), kind.valueType, names, within, known, named)
        return pa.MapArray.from_arrays(ends, values.keys.slice(begin, n), items)
    return values


def _spread(values: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Offsets of lists or maps, null where they are null, and the row of each of their elements."""
    offsets = values.offsets.to_numpy()
    counts = np.diff(offsets)
    null = values.is_null().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.array(ends, pa.int32(), mask=np.append(null, False)), np.repeat(rows, counts)
