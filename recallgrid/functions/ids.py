"""Hashes, identifiers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keywords import once
from .text import collapse


def text_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def memory_id(supplied: Column, file_hash: Column, text: Column) -> Column:
    """The supplied id, else mem_ and 32 hex digits of the hash and text."""
    own = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat(file_hash, F.lit("|"), F.coalesce(text, F.lit(""))), 256), 1, 32))
    return F.coalesce(F.nullif(F.trim(supplied), F.lit("")), own)


def short_id(c: Column, digits: int = 32) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def named_id(file_hash: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat(file_hash, F.lit(":"), name), 256), 1, 24)


def sanitize_filename(c: Column, most: int = 180) -> Column:
    """Safe characters only, runs collapsed, at most ``most``; nothing left: upload.

    The beginning of a long name mostly settles it: whatever follows, its first ``most`` characters stay if so many are left of it alone.
    """

    def safe(name: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), "_{2,}", "_")
        return F.substring(F.regexp_replace(name, r"^[._]+|(?<![._])[._]+$", ""), 1, most)

    def settled(name: Column) -> Column:
        start = safe(F.substring(name, 1, 4 * most))
        return once(start, lambda s: F.when((F.length(s) >= most) | (F.length(name) <= 4 * most), s).otherwise(safe(name)))

    return once(once(F.element_at(F.split(c, r"[/\\]"), -1), settled), lambda name: F.when(name == "", F.lit("upload")).otherwise(name))


def display_filename(c: Column, most: int = 180) -> Column:
    """The same for showing: runs of what is not safe become one underscore, the extension survives the cut; nothing left: unnamed_file."""
    name = F.element_at(F.split(F.regexp_replace(c, r"[/\\]+$", ""), r"[/\\]"), -1)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._ -]", "_"), r"\s+", "_"), r"^\.+", ""), "_+", "_")
    name = F.regexp_replace(name, r"^[ ._]+|[ ._]+$", "")
    suffix = F.regexp_extract(name, r"(?<=[^.])\.[^.]+$", 0)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(suffix))
    cut = F.concat(F.substr(stem, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.length(suffix))), suffix)
    name = F.when(F.length(name) > most, cut).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unnamed_file")).otherwise(name)


def storage_name(c: Column, most: int = 180) -> Column:
    """Letters and digits of any script, dots, hyphens and underscores; others become underscores; no name: image."""
    given = F.coalesce(F.nullif(c, F.lit("")), F.lit("image"))
    return F.substring(F.regexp_replace(given, r"[^\p{L}\p{N}._-]", "_"), 1, most)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.[A-Za-z0-9]+$", 0))


def is_valid_id(c: Column) -> Column:
    return F.coalesce((F.trim(c) != "") & (F.length(c) <= 128) & F.rlike(c, F.lit(r"^[A-Za-z0-9_.:-]+$")), F.lit(False))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def join_parts(separator: str, *columns: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(collapse(c), F.lit("")) for c in columns])
