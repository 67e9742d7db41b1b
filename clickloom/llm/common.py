"""What several operators share: session settings, held-out rows, bounded samples, Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import tune
from clickloom.sources.views import table

__all__ = ["bounded_sample", "held_out", "in_groups", "prepare", "sample_number", "slices_of", "table", "utf8_buffers"]

# Texts are long: small batches keep a Python worker's memory flat.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators on top of the library's own."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def held_out(doc_id: Column) -> Column:
    """One document in five, by the CRC-32 of its id as text; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_number(key: Column) -> Column:
    """A number below a million by a hash of ``key``."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1_000_000))


def bounded_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` and never more than 2 x ``rows`` of ``total`` rows, picked by a hash of ``key``."""
    share = min(1_000_000, int(1_000_000 * rows / max(total, 1)) + 1)
    return df.where(sample_number(key) < share).limit(2 * rows)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts and ends; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices_of(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of each piece stays near ``most_bytes`` (one row at least)."""
    sizes = np.diff(utf8_buffers(batch.column(column))[1])
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def in_groups(
    work: Callable[[pa.Table], Iterator[pa.RecordBatch]], key: str, flush_rows: int = 4096
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows sorted by ``key``: hands ``work`` tables of whole groups.

    Many small groups share one call. Only the group that may go on in the next
    batch is held back, so memory follows the largest group, which the caller bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < flush_rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column(key).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield from work(whole.slice(0, cut).combine_chunks())
            held = whole.slice(cut).combine_chunks().to_batches()
            rows = whole.num_rows - cut
        if rows:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run
