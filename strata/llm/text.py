"""Shared helpers: Arrow batches of bounded size, whitespace chunks, packed spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts are handled in slices of about this many bytes, so that what a task holds besides its input stays small.
SLICE_BYTES = 8 << 20

#: The characters of Unicode's White_Space property, as the tokenizers' pattern takes ``\s``.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: White space with the run that follows it. The tokenizers' pattern never crosses the end of such a chunk,
#: hence a text's tokens are its chunks' tokens in order.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: Letters and digits of Latin texts, and the ASCII white space and symbols that may follow them.
LATIN, AFTER_LATIN = "A-Za-z0-9À-ÖØ-öø-ÿ", "\t-\r !-/:-@\\[-`{-~"

#: The same in chunks of which fewer differ; the pattern parts there too. Words of Latin letters and digits end at ASCII symbols and
#: white space, a line break stands alone before them, a comma or full stop after any Latin letter or digit begins a chunk.
FINE_CHUNK = re.compile(
    f" ?[{LATIN}]++(?=[{AFTER_LATIN}])|\n(?=[{LATIN}])"
    f"|[{WHITE}]*(?:[^{WHITE}.,]++(?:(?<=[{LATIN}])(?=[.,])|[^{WHITE}]*)|[^{WHITE}]+)|[{WHITE}]+"
)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_columns(df: DataFrame, fn: Callable, schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to slices of all columns of ``df``, given as lists; it returns a dict of columns by ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, size):
                out = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def row_hash(*columns: str) -> Column:
    """A hash of a row's values that tells a missing one from any other; never null."""
    values = [F.col(c) for c in columns]
    return F.xxhash64(*values, *[v.isNull() for v in values])


def map_text(rows: DataFrame, schema: StructType, text_col: str, fn: Callable, *more: str) -> DataFrame:
    """The structs ``_row`` of ``rows``, of the given schema, as rows whose text is ``fn`` of itself and the columns ``more``."""
    names = schema.names
    at = names.index(text_col)

    def run(*columns):
        own = list(columns[: len(names)])
        own[at] = [fn(*values) for values in zip(own[at], *columns[len(names) :])]
        return dict(zip(names, own))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_columns(rows.select(*[F.col("_row")[n].alias(f"c{i}") for i, n in enumerate(names)], *more), run, ddl)


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def spans_digest(spans: Column) -> Column:
    return F.sha2(spans_text(spans).cast("binary"), 256)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
