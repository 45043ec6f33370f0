"""Applying a function of whole texts to Arrow batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlex.llm.words import column_bytes, slices
from quernlex.session import ship

#: Gives, on a worker, the function from some texts (UTF-8 or None) to one list for each new column.
Maker = Callable[[], Callable[[list[bytes | None]], list]]


def map_texts(docs: DataFrame, text_col: str, added: list[tuple[str, str, pa.DataType]], make: Maker, carry: list[str]) -> DataFrame:
    """docs' columns `carry`, named c0, c1, ..., then the columns `added` (name, Spark type, Arrow type).

    Rows stay where they are: no shuffle. The names c0, c1, ... keep any clash of names away.
    """
    ship(docs.sparkSession)
    n = len(carry)
    both = text_col in carry
    at = carry.index(text_col) if both else n
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(*columns, *([] if both else [F.col(f"`{text_col}`").alias("text")]))
    names = [*(f"c{i}" for i in range(n)), *(a[0] for a in added)]
    kinds = [a[2] for a in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = column_bytes(batch.column(at))
            new: list[list] = [[] for _ in kinds]
            for lo, hi in slices(texts):
                for have, more in zip(new, work(texts[lo:hi]), strict=True):
                    have.extend(more)
            arrays = [pa.array(x, k) for x, k in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + arrays, names)

    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)] + [f"{a[0]} {a[1]}" for a in added])
    return rows.mapInArrow(run, schema)
