"""Column expressions over one version: normal form, sizes, and the byte layout of an entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.model import DELETE, PUT


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_op(value: Column | str, op: Column | str) -> Column:
    """A put of nothing is a delete."""
    return F.when((_column(op) == DELETE) | (F.coalesce(F.octet_length(value), F.lit(0)) == 0), DELETE).otherwise(PUT)


def payload_bytes(key: Column | str = "key", value: Column | str = "value") -> Column:
    """What a version counts in a memtable: its key, and its value if it has one."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def entry_bytes(key: Column | str = "key", value: Column | str = "value", op: Column | str = "op") -> Column:
    """Size of the entry in a block: type, key length, key, [value length, value,] sequence number."""
    body = F.when(_column(op) == PUT, 4 + F.coalesce(F.octet_length(value), F.lit(0))).otherwise(0)
    return (13 + F.octet_length(key) + body).cast("long")


def little_endian(x: Column | str, n_bytes: int) -> Column:
    """An integer as ``n_bytes`` bytes, lowest first."""
    x = _column(x).cast("long")
    one = lambda i: F.unhex(F.lpad(F.hex(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0"))
    return F.concat(*(one(i) for i in range(n_bytes)))


def encoded_entry(key: Column | str = "key", value: Column | str = "value", op: Column | str = "op",
                  seq: Column | str = "seq") -> Column:
    """The entry's bytes."""
    key, value = (_column(x).cast("binary") for x in (key, value))
    empty = F.lit("").cast("binary")
    body = F.when(_column(op) == PUT, F.concat(little_endian(F.coalesce(F.octet_length(value), F.lit(0)), 4),
                                                F.coalesce(value, empty))).otherwise(empty)
    return F.concat(little_endian(_column(op), 1), little_endian(F.octet_length(key), 4), key, body, little_endian(seq, 8))
