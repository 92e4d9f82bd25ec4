"""Assignment of channels and rows to data splits by salted hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SALT = "split-v1|"


def bucket(value: Column, modulus: int, salt: str = SALT) -> Column:
    """A number from 0 to modulus - 1 by the first 32 bits of a salted SHA-256."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 8), 16, 10).cast("long") % modulus).cast("long")


def channel_split(channel: Column) -> Column:
    """train, validation or test in the ratio 70 : 15 : 15, so that no channel is in two splits."""
    b = bucket(channel, 100)
    return F.when(b < 70, "train").when(b < 85, "validation").otherwise("test")
