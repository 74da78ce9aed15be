"""Identifiers, pair keys, decisions and path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a review decision.
DECISION_ALIASES = {
    "yes": "yes",
    "y": "yes",
    "true": "yes",
    "1": "yes",
    "group": "yes",
    "same": "yes",
    "no": "no",
    "n": "no",
    "false": "no",
    "0": "no",
    "different": "no",
    "": "",
    "review": "",
    "pending": "",
}


def strip(value: Column | str) -> Column:
    """Cut every kind of white space off both ends, not only blanks."""
    return F.regexp_replace(value, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def normalise_decision(value: Column, strict: bool = True) -> Column:
    """Map a reviewer's spelling to yes / no / blank.

    Unknown spellings fail the query when ``strict``; otherwise they pass through.
    """
    cleaned = F.lower(strip(F.coalesce(value, F.lit(""))))
    known = F.try_element_at(_literal_map(DECISION_ALIASES), cleaned)
    if not strict:
        return F.coalesce(known, cleaned)
    message = F.concat(F.lit("invalid review decision: "), cleaned)
    return F.coalesce(known, F.raise_error(message).cast("string"))


def hamming(first: Column, second: Column) -> Column:
    return F.bit_count(first.bitwiseXOR(second))


def hash_hex(value: Column) -> Column:
    """A signed 64-bit hash as 16 lower-case hex digits of its unsigned value."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def pair_key(first: Column, second: Column) -> Column:
    """Order-free key of two paths."""
    return F.struct(
        F.least(first, second).alias("low"), F.greatest(first, second).alias("high")
    )


def exact_id(number: Column) -> Column:
    return F.format_string("EXACT_%04d", number)


def near_id(number: Column) -> Column:
    return F.format_string("NEAR_%05d", number)


def group_id(class_name: Column, number: Column) -> Column:
    return F.format_string("%s_G%04d", class_name, number)


def run_name(experiment: Column, seed: Column) -> Column:
    return F.format_string("%s_seed%d", experiment, seed)


def clean_path(value: Column) -> Column:
    """Trim and drop one matching pair of surrounding quotes."""
    return F.regexp_replace(strip(value), r"""(?s)^(["'])(.*)\1$""", "$2")


def flat_name(path: Column) -> Column:
    """Directory separators become double underscores."""
    return F.regexp_replace(path, "/", "__")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    name = F.regexp_replace(path, r"^.*/", "")
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
