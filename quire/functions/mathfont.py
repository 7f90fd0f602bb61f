"""Reading the letters of a mathematics font whose character map is broken."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first code point of each run of the broken font, and the
# letters it stands for in order.
RUNS = (
    (0x0BBA, string.ascii_uppercase), (0x0BD4, string.ascii_lowercase), (0x0B34, string.digits),
    (0x0CB2, string.ascii_uppercase), (0x0CCC, string.ascii_lowercase), (0x0C2C, string.digits),
)
# Single signs, by code point.
DELIMITERS = {
    0x123A: "(", 0x123B: ")", 0x123C: "{", 0x123D: "}", 0x123E: "[", 0x123F: "]", 0x1240: "(", 0x1241: ")",
    0x0D6B: "(", 0x0D6F: ")", 0x0D6C: "(", 0x0D70: ")", 0x0D63: "[", 0x0D67: "]",
}
SIGNS = {
    0x0B3E: "+", 0x0B3F: "−", 0x0B40: "=", 0x0D4C: "=", 0x0D4F: "<", 0x0D52: "≥", 0x0DA5: "√", 0x0DCD: "∑",
    0x11F1: "′", 0x11F2: "′", 0x0DDC: "̂", 0x0DDD: "̂", 0x0DE1: "̂", 0x0D24: "̄", 0x0B19: "i",
}


def restore(c: Column) -> Column:
    """The text with the broken letters put right, on pages that show any
    mathematics: a mathematical letter or a broken delimiter."""
    table = {chr(first + k): letter for first, letters in RUNS for k, letter in enumerate(letters)}
    table |= {chr(p): s for p, s in {**SIGNS, **DELIMITERS}.items()}
    shows = r"[\x{1D400}-\x{1D7FF}" + "".join(rf"\x{{{p:04X}}}" for p in DELIMITERS) + "]"
    return F.when(c.rlike(shows), F.translate(c, "".join(table), "".join(table.values()))).otherwise(c)
