"""Column functions: tokenizers and scalar helpers, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The delimiters of the delimiter tokenizer.
DELIMITERS = " .-=_\t\n\r'\"?,;:`!*()"
_DELIMITED = r"[^ .\-=_\t\n\r'\"?,;:`!*()]+"


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, in order; case matters, other bytes separate."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1)


def delimited_words(text: Column) -> Column:
    """Runs of anything but ``DELIMITERS``; letters beyond ASCII stay inside words."""
    return F.regexp_extract_all(text, F.lit(f"({_DELIMITED})"), 1)


def digrams(tokens: Column) -> Column:
    """Adjacent pairs ``a-b``, overlapping; none for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit("-"), b))


def kmers(read: Column, k: int) -> Column:
    """Windows of ``k`` bases, line ends and N taken out first; none for shorter reads.

    By a look ahead at each place: a substring would count characters from the read's start each time.
    """
    return F.regexp_extract_all(F.translate(read, "\r\nN", ""), F.lit(f"(?=(.{{{k}}}))"), 1)


def rotations(code: Column, n: int = 5, step: int = 4, length: int = 16) -> Column:
    """``n`` runs of ``length`` characters, each ``step`` further on, around the end to the start."""
    twice = F.concat(code, code)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.substring(twice, r * step + 1, F.lit(length)))


def hamming(a: Column, b: Column, length: int = 20) -> Column:
    """Positions, of ``length``, at which two strings differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))).cast("long")


def caesar(word: Column, shift: int = 5) -> Column:
    """Printable ASCII moved on by ``shift`` code points."""
    source = "".join(map(chr, range(33, 122)))
    return F.translate(word, source, "".join(chr(ord(c) + shift) for c in source))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def literal_key(key: Column, width: int = 32) -> Column:
    """A key as a fixed field of ``width`` bytes with a terminator keeps it."""
    return F.substring(key, 1, width - 1)


def djb2(key: Column) -> Column:
    """The hash h * 33 + byte, from 5381, in 32 bits: what the default partitioner deals keys by."""
    codes = F.transform(F.sequence(F.lit(1), F.length(F.hex(key.cast("binary"))) - 1, F.lit(2)), lambda i: F.conv(F.substring(F.hex(key.cast("binary")), i, F.lit(2)), 16, 10).cast("bigint"))
    step = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(key == "", F.lit(5381).cast("bigint")).otherwise(step)
