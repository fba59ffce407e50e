"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a lower-case token; longer ones are dropped whole.
MAX_TOKEN_BYTES = 255


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Runs of letters and numbers, lower case, none longer than MAX_TOKEN_BYTES.

    Words are cut before they are lowered, and each letter is lowered by
    itself: a final capital sigma becomes an ordinary small one.
    """
    c = _col(text)
    plain = F.translate(c, "Σ", "σ")
    run = lambda x: F.regexp_extract_all(x, F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1))
    # but for one letter, whose small form has a mark that would cut a word, lowering first makes no difference and is cheaper
    found = F.when(F.instr(c, "İ") > 0, F.transform(run(plain), F.lower)).otherwise(run(F.lower(plain)))
    return F.filter(found, lambda t: F.octet_length(t) <= MAX_TOKEN_BYTES)


def token_count(text: Column | str) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.size(F.when(_col(text).isNotNull(), tokens(text))), F.lit(0)).cast("long")


def lines(text: Column | str) -> Column:
    """The lines of a text; a line end at its end adds none, and an empty text has none."""
    c = F.regexp_replace(_col(text), r"\n\z", "")
    return F.when(_col(text) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1))


def valid_utf8(data: Column | str) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(_col(data).cast("string"))


def norm_byte(length: Column | str) -> Column:
    """One byte for a field's length: exact below 24, then a 3-bit mantissa and an exponent; 0 for negative lengths."""
    n = F.greatest(_col(length).cast("long"), F.lit(0))
    rest = n - 24
    shift = F.greatest(F.length(F.bin(rest)) - 4, F.lit(0))
    tiny = rest < 8
    mantissa = F.call_function("shiftright", rest, shift.cast("int")).bitwiseAND(F.lit(7).cast("long"))
    coded = F.when(tiny, rest).otherwise(mantissa + (shift + 1) * 8)
    return F.when(n < 24, n).otherwise(coded + 24).cast("int")


def norm_length(length: Column | str) -> Column:
    """What a length is after a round trip through its byte: the greatest length with the same byte's first bits."""
    n = F.greatest(_col(length).cast("long"), F.lit(0))
    shift = F.greatest(F.length(F.bin(n - 24)) - 4, F.lit(0)).cast("int")
    kept = F.call_function("shiftleft", F.call_function("shiftright", n - 24, shift), shift)
    return F.when(n < 32, n).otherwise(kept + 24)


def norm_decode(byte: Column | str) -> Column:
    """The length that a norm byte (0 to 255) stands for."""
    b = _col(byte).cast("int")
    rest = b - 24
    exponent = F.call_function("shiftright", rest, F.lit(3)) - 1
    mantissa = rest.bitwiseAND(7).cast("long")
    value = F.when(rest < 8, rest.cast("long")).otherwise(F.call_function("shiftleft", mantissa + 8, F.greatest(exponent, F.lit(0))))
    return F.when(b < 24, b.cast("long")).otherwise(value + 24)


def base36(n: Column | str) -> Column:
    """A number of 0 or more in base 36, as segment and generation names have it."""
    return F.lower(F.conv(_col(n).cast("string"), 10, 36))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Bytes that two values have in common at their beginnings."""
    x, y = F.hex(_col(a).cast("binary")), F.hex(_col(b).cast("binary"))
    n = F.least(F.length(x), F.length(y)) / 2
    differ = F.filter(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substr(x, i * 2 - 1, F.lit(2)) != F.substr(y, i * 2 - 1, F.lit(2)))
    return F.when(n < 1, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n.cast("int"))).cast("long")


def sort_key_length(before: Column | str, own: Column | str) -> Column:
    """Bytes of a value that tell it from the one before it in order."""
    return F.least(common_prefix(before, own) + 1, F.octet_length(_col(own)).cast("long"))
