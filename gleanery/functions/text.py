"""Text, number and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(s: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def without_number(s: Column) -> Column:
    """Without a trailing number and the separators before it."""
    return F.regexp_replace(F.lower(F.trim(s)), r"[\s_-]*\d+$", "")


def safe_name(s: Column) -> Column:
    """Characters that are not safe in a file name become one ``_``; ``img`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9.-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("img"))


def leading_letters(s: Column) -> Column:
    return F.regexp_extract(s, "^[A-Za-z]+", 0)


def base_name(path: Column) -> Column:
    """The last part of a path with either separator."""
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def domain_of(name: Column) -> Column:
    """The domain that a list file is named after, empty if it is no such file."""
    return F.regexp_extract(name, r"^data_test_(.+)\.ya?ml$", 1)


def class_range(s: Column) -> Column:
    """``0-5`` or ``0,1`` as an array of class numbers."""
    low, high = F.split_part(s, F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(s, F.lit("-"), F.lit(2)).try_cast("int")
    return F.when(s.contains("-"), F.sequence(low, high)).otherwise(F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("int")))


def spoken_list(items: Column) -> Column:
    """``A``, ``A and B``, ``A, B and C``."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1))
    )


def six_digits(x: Column) -> Column:
    """Rounded to six significant digits."""
    return F.format_string("%.5e", x).cast("double")


def close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b)))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 8-bit colours."""
    def lin(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)
