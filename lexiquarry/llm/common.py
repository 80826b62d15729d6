"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize

#: Most bytes in memory, as estimated from rows and their width, that a side may have to be broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes a row of a hash table has besides its values.
ROW_BYTES = 40


def _width(kind: T.DataType, value_bytes: float) -> float:
    """Bytes of a value in memory; texts and arrays are at least as large as in the files, which compress them."""
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType, value_bytes) for f in kind)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StringType, T.BinaryType)):
        return 24 + 4 * value_bytes
    return 8


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table that has been written for broadcast if its rows need little memory; otherwise Spark joins by shuffle.

    Rows are counted from the files' footers. Files are compressed, so their bytes say how wide a row is at least.
    """
    files = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if files > most:
        return df
    rows = df.count()
    width = ROW_BYTES + sum(_width(f.dataType, files / max(rows, 1)) for f in df.schema)
    return F.broadcast(df) if rows * width <= most else df


#: Rows of the table that says which hashes may be wanted; each stands for 64 of them.
SLOTS = 1 << 17


def with_chance(df: DataFrame, key: str, wanted: DataFrame, of: str, name: str) -> DataFrame:
    """``df`` with ``name``: whether its hash ``key`` may be among the hashes ``of`` in ``wanted``; it is never false for one that is.

    So rows with texts that find no partner need no shuffle. The broadcast side has SLOTS rows at most, whatever the
    size of ``wanted``; beyond 64 * SLOTS hashes, more and more rows are let through, none is lost.
    """
    def place(hashed: Column) -> tuple[Column, Column]:
        bit = F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(64)).cast("int")
        return F.pmod(hashed, F.lit(SLOTS)), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)

    slot, bit = place(F.col(of))
    known = F.broadcast(wanted.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits")))
    slot, bit = place(F.col(key))
    found = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return df.join(known, slot == F.col("_slot"), "left").select(*[F.col(f"`{c}`") for c in df.columns], found.alias(name))


#: Rows of a narrow table that one file gets.
FILE_ROWS = 200_000


def settle(df: DataFrame, label: str, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows behind a shuffle, written in few files and read back."""
    return materialize(df.coalesce(1 + rows // FILE_ROWS), label)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def seeded_bits(key: Column, seed: int) -> Column:
    """30 bits from the MD5 of a seed and a key; SQL engines can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), 2)
