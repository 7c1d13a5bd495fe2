"""Provider calls on columns, in Arrow batches, with one client in each worker."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import maker

PLAN = "target_object string, anchor_objects array<string>, relation_polarity string, relation_degree string, operator string, behavior string, status string"
SELECTION = "object_id string, reason string, confidence double, rejected_ids array<string>, guess_id string"
ANSWER = "answer string, reasoning string, object_ids array<string>"


@functools.cache
def _client(make: Callable):
    return make()


def embedded(text: Column, provider: str = "offline", batch: int = 256, eps: float = 1e-9) -> Column:
    """Vector of each text, divided by its length plus eps; a null text has none."""
    make = maker(provider)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = _client(make)
        for s in batches:
            out: list = []
            for k in range(0, len(s), batch):
                part = s.iloc[k : k + batch]
                got = (np.asarray(v, np.float64) for v in client.embed_text([x for x in part if x is not None]))
                got = ((v / (np.linalg.norm(v) + eps)).tolist() for v in got)
                out += [None if x is None else next(got) for x in part]
            yield pd.Series(out, dtype=object)

    return run(text)


def called(df: DataFrame, method: str, inputs: list[str], output: str, ddl: str, provider: str = "offline", batch: int = 20, fallback: dict | None = None) -> DataFrame:
    """df with a struct of the method's answers and <output>_error.

    A batch that fails is tried row by row; a row that fails carries its error
    and the fallback, so no row is lost.
    """
    make = maker(provider)
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL(ddl)
    names = kind.fieldNames()
    schema = T.StructType([*df.schema.fields, T.StructField(output, kind), T.StructField(f"{output}_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        client, arrow = _client(make), to_arrow_schema(schema)
        call = getattr(client, method)
        for b in batches:
            rows = b.to_pylist()
            for k in range(0, len(rows), batch):
                part = rows[k : k + batch]
                try:
                    got = [(x, None) for x in call(*([r[i] for r in part] for i in inputs))]
                except Exception:
                    got = []
                    for r in part:
                        try:
                            got.append((call(*([r[i]] for i in inputs))[0], None))
                        except Exception as e:
                            got.append((dict(fallback or {}), f"{type(e).__name__}: {e}"))
                for r, (x, error) in zip(part, got, strict=True):
                    r[output] = {n: x.get(n) for n in names}
                    r[f"{output}_error"] = error
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)
