"""Helpers that the operators on texts share: Arrow batches in bounded slices, sessions' shared folder, languages' letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows turned into Python objects at once; the Arrow batch itself is bounded by the session's settings.
SLICE_ROWS = 256

#: ASCII white space as the word rule has it; str.split() would also split at other spaces.
WORD = r"[^\x20\x09-\x0D]+"
_TO_SPACE = {c: " " for c in range(9, 14)}
_LOWER = {c: chr(c + 32) for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    """Words between ASCII white space, A-Z in lower case."""
    return [w for w in (text or "").translate(_LOWER | _TO_SPACE).split(" ") if w]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}
_TYPES |= {f"array<{k}>": T.ArrayType(v) for k, v in _TYPES.items()}


def schema_of(text: str) -> T.StructType:
    """Schema of "name type, name type"; needs no running session, so modules can state schemas."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


def per_row(
    df: DataFrame,
    setup: Callable[[], Callable[..., Sequence[Sequence]]],
    made: str | T.StructType,
    inputs: Sequence[str],
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Add columns to each row in Arrow batches, without a shuffle.

    ``setup`` runs once per task and returns a function of one list per input column, which returns one
    list per made column. Columns in ``keep`` pass through untouched; if a made column has the name of a
    kept one, the made one stays. Other columns are never read.
    """
    new = schema_of(made) if isinstance(made, str) else made
    passed = [c for c in keep if c not in new.names]
    schema = T.StructType([df.schema[c] for c in passed] + list(new.fields))
    arrow = to_arrow_schema(schema)
    chosen = df.select(*[F.col(f"`{c}`") for c in passed], *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(inputs)])
    n = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made_columns = fn(*[part.column(i).to_pylist() for i in range(n, part.num_columns)])
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [pa.array(list(values), type=arrow.field(n + i).type) for i, values in enumerate(made_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return chosen.mapInArrow(run, schema)


def free_names(taken: Sequence[str], *names: str) -> list[str]:
    """The names, with underscores before those that a table has already (letters compare in either case)."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def drop_columns_of(schema: T.StructType, *names: str) -> list[str]:
    """Names of a schema's columns without the given ones."""
    return [c for c in schema.names if c not in names]


#: Bits of the filter below: at most FILTER_BITS / 64 rows of two numbers are broadcast, whatever the number of ids.
FILTER_BITS = 1 << 24


def likely_among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key may be among ``ids`` (one column): all that are, and few others while the ids are few.

    A bit per hashed id, kept as 64-bit words in a table of bounded size. Put before an exact join, it keeps
    most of a wide table out of the shuffle.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, int(_place % 64))")
    words_ = ids.select(place(ids[ids.columns[0]]).alias("_place")).select(F.expr("_place div 64").alias("_word"), bit.alias("_bit"))
    words_ = words_.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = df.withColumn("_place", place(F.col(key))).withColumn("_word", F.expr("_place div 64"))
    return placed.join(F.broadcast(words_), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).select(*df.columns)
