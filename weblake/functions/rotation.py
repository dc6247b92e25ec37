"""Names of rotated log files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of compressed files, and date forms of rotated ones.
COMPRESSED = ("gz", "bz2", "xz", "lz4")
FULL_DATE = r"\d{8}|\d{4}-\d{2}-\d{2}|\d{6}"
DOTTED_DATE = r"\d{4}\.\d{2}\.\d{2}"


def is_full_date(name: Column) -> Column:
    return name.rlike(rf"^(?:{FULL_DATE})$")


def is_date(name: Column) -> Column:
    return name.rlike(rf"^(?:{FULL_DATE}|{DOTTED_DATE})$")


def main_log_path(path: Column) -> Column:
    """The group of a log file: its path without the marks of compression and rotation."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    for suffix in COMPRESSED:
        name = F.regexp_replace(name, rf"\.{suffix}$", "")
    rules = (
        (r"^(.+\..+)-(?:\d{8}|\d{4}-\d{2}-\d{2})$", "$1"),
        (rf"^(.+)\.{DOTTED_DATE}$", "$1"),
        (rf"^(.+\..+)\.(?:{FULL_DATE})$", "$1"),
        (r"^(.+)\.\d{1,3}$", "$1"),
        (r"^(.+)\.\d{1,3}\.log$", "$1.log"),
        (rf"^(?:{FULL_DATE}|{DOTTED_DATE})$", "access.log"),
    )
    chain = F
    for pattern, to in rules:
        chain = chain.when(name.rlike(pattern), F.concat(folder, F.regexp_replace(name, pattern, to)))
    return chain.otherwise(path)


def is_compressed(path: Column) -> Column:
    return path.rlike(rf"\.(?:{'|'.join(COMPRESSED)})$")


def is_rotated(path: Column) -> Column:
    return main_log_path(path) != path
