"""Normal forms of names: two names are the same when their normal forms are equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\p{Z}\x{FEFF}]"


def source_key(name: Column) -> Column:
    """Source and domain names without case, blanks, ``-`` and ``_``; empty names are null."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[\s\p{Z}\x{FEFF}_-]+", ""), F.lit(""))


def class_key(name: Column) -> Column:
    """Split and class names without case, blanks and punctuation; empty names are null."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[\s\p{Z}\x{FEFF}\p{P}]+", ""), F.lit(""))


def split_key(name: Column) -> Column:
    """As ``class_key``; ``val`` and ``validation`` mean ``valid``."""
    key = class_key(name)
    return F.when(key.isin("val", "validation"), F.lit("valid")).otherwise(key)


def file_key(name: Column) -> Column:
    """File names ignoring case."""
    return F.lower(name)


def stem_key(name: Column) -> Column:
    """What stands before ``.rf.`` in a file name, ignoring case; null where there is no such mark."""
    key = F.lower(name)
    at = F.instr(key, ".rf.")
    return F.when(at > 0, F.substring(key, F.lit(1), at - 1))


def stripped(text: Column) -> Column:
    """Without blanks at both ends, of any kind."""
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def unit_hash(salt: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(salt:key); the same in every engine."""
    digest = F.md5(F.concat(F.lit(salt + ":"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
