"""What the operators of this subpackage share: written intermediates, row keys and Arrow loops."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.session import ship_with_tasks, work_path

ship_with_tasks(__name__)

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\f\r"
#: Bytes of text that one numpy pass holds; a longer single text is a pass of its own.
PASS_BYTES = 1_000_000
#: Rows of an Arrow batch that one step turns into Python values.
STEP_ROWS = 1000


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared work folder and read it back.

    Cuts the lineage and survives lost executors; Parquet also gives later joins a true size. The
    files stay until the work folder is cleared, because the returned frame reads them.
    """
    path = work_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str = "text") -> Column:
    """A 64-bit key of a whole text; null texts have a key of their own."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def rows_in_passes(lengths: np.ndarray, size: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose lengths add up to about ``size``."""
    start, total = 0, 0
    for row, length in enumerate(lengths.tolist()):
        total += length
        if total >= size:
            yield start, row + 1
            start, total = row + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """Run ``function`` on slices of every Arrow batch; it returns the output columns in schema order."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                columns = function(batch.slice(start, STEP_ROWS))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))

    return df.mapInArrow(over, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
