"""One pass over the ordered rows of each key, as a stream: rows are dealt out by key and sorted by the engine, and a worker holds one key's rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from momentis.session import ship

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def per_key(rows: DataFrame, key: str, fn: Callable[[pd.DataFrame], list[tuple]], columns: dict[str, str], order: list[str], tasks: int | None = None) -> DataFrame:
    """Rows (key, ...) that fn gives for the ordered rows of each key; columns names their types. Spark chooses the number of tasks by the rows' size, unless it is given."""
    ship(rows.sparkSession)
    names = rows.columns
    kind = rows.schema[key].dataType.simpleString().replace("bigint", "long")
    kinds = [_KINDS[kind], *(_KINDS[k] for k in columns.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        out: list[tuple] = []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            values = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [key, *columns])

        def close() -> None:
            if held:
                group = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                own = group[key].iloc[0]
                out.extend((own, *row) for row in fn(group.reset_index(drop=True)))
                held.clear()

        for batch in batches:
            frame = batch.to_pandas()
            keys = frame[key].to_numpy()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1][key].iloc[0] != keys[a]:
                    close()
                held.append(frame.iloc[a:b])
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    schema = ", ".join([f"{key} {kind}", *(f"{n} {k}" for n, k in columns.items())])
    dealt = rows.select(*names).repartition(*([tasks] if tasks else []), key)
    return dealt.sortWithinPartitions(key, *order).mapInArrow(run, schema)
