"""Text lengths, hex sizes and the small text forms used in result files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A hex text starts with two characters ("0x"), each further one stands for four bits.
HEX_PREFIX = 2
BITS_PER_CHARACTER = 4
BITS_PER_BYTE = 8


def text_length(column: Column) -> Column:
    """Length of a scalar of any type when written as text."""
    return F.length(column.cast("string"))


def hex_bytes(mean_length: Column) -> Column:
    """Mean bytes of a hex text of that mean length. Negative below two characters, 0.0 for no length at all."""
    return F.coalesce((mean_length - HEX_PREFIX) * BITS_PER_CHARACTER / BITS_PER_BYTE, F.lit(0.0))


def joined(*columns: Column, separator: str = ",") -> Column:
    return F.concat_ws(separator, *columns)


def stripped(text: Column, characters: str) -> Column:
    """Remove any of these characters from both ends."""
    return F.btrim(text, F.lit(characters))


def json_scalar(column: Column) -> Column:
    """A string or number as JSON text."""
    listed = F.to_json(F.array(column), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)
