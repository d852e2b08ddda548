"""Running Python over a table's text column by Arrow batches, one text at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts handled at once: so many rows, or so many bytes and one more text.
ROWS, BYTES = 4096, 4 << 20
#: Bytes of a batch that Spark hands over, where the session doesn't say; rows alone bound
#: nothing when texts are long.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def release() -> None:
    """Give memory that is free back to the system: workers stay alive between tasks, and what
    one kept would count against the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def each(function: Callable[[str], tuple | list]) -> Callable[[list[str]], list]:
    """A function of texts from a function of one."""
    return lambda texts: [function(t) for t in texts]


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, n in enumerate(sizes.tolist()):
        held += n
        if held >= most or k + 1 - begin == ROWS:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_texts(df: DataFrame, function: Callable[[list[str]], list] | None, schema: str, many: bool = False, setup: Callable[[], Callable[[list[str]], list]] | None = None, keep: bool = False, most: int = BYTES) -> DataFrame:
    """Columns of ``df`` but ``text`` (with ``keep``, it too), followed by what ``function`` makes of the texts.

    The function takes a list of texts (null as empty) and returns a row for each, or with
    ``many`` a list of rows for each; ``schema`` names their columns. With ``setup`` it is
    made once per task, as ``setup()``. ``most``: bytes of text handled at once.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    kept = [f for f in df.schema.fields if f.name != "text"]
    made = T.StructType.fromDDL(schema)
    carried = [*kept, df.schema["text"]] if keep else kept
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in (*carried, *made.fields)])
    width, wide = len(kept), len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = setup() if setup else function
        arrow = to_arrow_schema(out)
        try:
            for whole in batches:
                for batch in _slices(whole, width, most):
                    results = call([t or "" for t in batch.column(width).to_pylist()])
                    own: list = [batch.column(i) for i in range(wide)]
                    if many:
                        take = pa.array([i for i, rows in enumerate(results) for _ in rows], pa.int64())
                        own = [c.take(take) for c in own]
                        results = [row for rows in results for row in rows]
                    columns = list(zip(*results)) if results else [()] * len(made)
                    arrays = [pa.array(list(c), arrow.field(wide + i).type) for i, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(own)] + arrays, schema=arrow)
        finally:
            release()

    return df.select(*[f.name for f in kept], F.col("text")).mapInArrow(run, out)
