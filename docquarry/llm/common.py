"""What several of the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import shared_folder


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> DataFrame:
    """Add columns computed in Arrow batches, keeping every row and every other column.

    ``make`` gets the iterator of a task's batches and yields, for each of
    them, the batch and its new arrays. An input column that has the name of
    a new one (in any case of letters) is replaced, as withColumn does.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    added = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in make(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + list(arrays), names=names + added)

    return df.mapInArrow(run, T.StructType(kept + fields))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The batch's texts as str; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The batch's texts as UTF-8, without building str objects; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    for x in column:
        yield x.as_py() or b""


def slices(batch: pa.RecordBatch, name: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about most_bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(name))
    start, held = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Hand back what Arrow has freed but holds: at the end of a task, for the tasks of other operators that the worker gets next."""
    pa.default_memory_pool().release_unused()


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written as a compressed table in the shared folder and read from there, and its folder: lineage ends, and columns are read apart."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``stored_at`` alone."""
    return stored_at(df)[0]
