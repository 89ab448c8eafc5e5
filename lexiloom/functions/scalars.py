"""Scalar functions as native Column expressions, and the few that only serve single requests in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phonetic digits of consonants.
SOUND_LETTERS, SOUND_DIGITS = "BFPVCGJKQSXZDTLMNR", "111122222222334556"


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def escape_json(c: Column) -> Column:
    """Escape backslash, quote, line feed and tab, and nothing else."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def zero_pad(n: Column, width: int) -> Column:
    """Decimal with leading zeros to at least `width`; longer numbers are not cut."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def plural(word: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(word, F.lit("s"))).otherwise(word)


def floor_log2(n: Column) -> Column:
    """Floor of the binary logarithm; 0 for 0 and 1. By the length of the binary form, so without rounding."""
    return F.length(F.bin(F.greatest(n.cast("long"), F.lit(1).cast("long")))) - 1


def time_difference(a: Column, b: Column) -> Column:
    """The difference of two times in seconds, in words; the order does not matter. Weeks, too, are called days."""
    d = F.abs(a - b).cast("long")
    days = F.floor(d / 86400)
    weeks, months = F.floor(days / 7), F.floor(days / 28)
    clock = F.concat_ws(":", zero_pad(F.floor(d % 86400 / 3600), 2), zero_pad(F.floor(d % 3600 / 60), 2), zero_pad(d % 60, 2))
    part = lambda n, word: F.concat(n.cast("string"), F.lit(" "), plural(F.lit(word), n), F.lit(" "))
    out = F.when(days > 0, F.concat(part(days % 7, "day"), clock)).otherwise(clock)
    out = F.when(weeks > 0, F.concat(part(weeks % 4, "day"), out)).otherwise(out)
    out = F.when(months > 0, F.concat(part(months, "month"), out)).otherwise(out)
    return F.when(d == 0, F.lit("just now")).otherwise(out)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in bytes of UTF-8."""
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b))


def soundex(s: Column, width: int = 4) -> Column:
    """A phonetic key. Vowels do not separate equal digits, the first character stays as it is, and its own
    digit is skipped for the next two characters only, or without bound if it is itself a digit 1 to 6."""
    letters, digits = SOUND_LETTERS + SOUND_LETTERS.lower(), SOUND_DIGITS * 2
    coded = F.regexp_replace(F.translate(F.translate(s, "123456", "000000"), letters, digits), "[^1-6]", "0")
    digit_first = F.regexp_replace(F.concat(F.substring(s, 1, 1), F.substring(coded, 2, 1 << 30)), r"^(.)(?:\1|0)*", "")
    usual = F.regexp_replace(coded, r"^(.)(?:\1|0){0,2}", "")
    z = F.when(s.rlike("^[1-6]"), digit_first).otherwise(usual)
    z = F.regexp_replace(F.replace(z, F.lit("0"), F.lit("")), r"(.)\1+", "$1")
    return F.when(s == "", F.lit("")).otherwise(F.rpad(F.concat(F.substring(s, 1, 1), z), width, "0"))


def leading_int(text: str) -> int:
    """The integer that a text begins with, after white space and one sign; 0 without digits."""
    body = text.lstrip(" \t\n\v\f\r")
    sign = -1 if body[:1] == "-" else 1
    body = body[1:] if body[:1] in ("+", "-") else body
    digits = body[: next((i for i, c in enumerate(body) if c not in "0123456789"), len(body))]
    return sign * int(digits or "0")


def clamp_n(text: str | None, most: int = 32) -> int:
    """The number of results asked for: missing or too many give `most`, below 1 gives 1, negative wraps to `most`."""
    if text is None:
        return most
    n = leading_int(text)
    return most if n < 0 else max(1, min(n, most))


def clamp_n_column(n: Column, most: int = 32) -> Column:
    return F.when(n.isNull() | (n > most) | (n < 0), F.lit(most)).when(n < 1, F.lit(1)).otherwise(n).cast("int")


def clamp_n_text(text: Column, most: int = 32) -> Column:
    """clamp_n() of a text column."""
    digits = F.regexp_extract(text, r"^[ \t\n\x0B\f\r]*[+-]?([0-9]*)", 1)
    negative = text.rlike(r"^[ \t\n\x0B\f\r]*-[0-9]*[1-9]")
    n = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, F.lit(most)).otherwise(F.coalesce(digits.try_cast("int"), F.lit(0)))
    return F.when(text.isNull() | negative, F.lit(most)).otherwise(F.greatest(F.lit(1), F.least(n, F.lit(most)))).cast("int")


def percent_decode_column(text: Column) -> Column:
    """percent_decode() of a text column, byte by byte. Bytes that are no UTF-8 become the replacement character."""
    units = F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(r"(?s)(%..|%.?\z|[^%])"), F.lit(1))
    escaped = lambda u: F.regexp_replace(F.substring(u, 2, 2), "[^0-9a-fA-F]", "0")
    code = lambda u: F.when(~u.startswith("%"), F.hex(F.encode(u, "ISO-8859-1"))).when(F.length(u) == 3, escaped(u)).otherwise(F.lit(""))
    return F.decode(F.unhex(F.array_join(F.transform(units, code), "")), "UTF-8")


def query_parameter(query: Column, name: str) -> Column:
    """The value of parse_query() for one name; null without it."""
    parts = F.filter(F.split(query, "&"), lambda x: (x != "") & (F.substring_index(x, "=", 1) == name))
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) > 0, F.replace(F.substring(last, F.lit(len(name) + 1), F.length(last)), F.lit("="), F.lit("")))


def percent_decode(text: str) -> str:
    """Lenient decoding: + stays, a bad hexadecimal digit counts as 0, an incomplete escape at the end goes."""
    raw, out, i = text.encode(), bytearray(), 0
    value = lambda b: int(chr(b), 16) if chr(b) in "0123456789abcdefABCDEF" else 0
    while i < len(raw):
        if raw[i] != 0x25:
            out.append(raw[i])
            i += 1
        else:
            if i + 2 < len(raw):
                out.append(value(raw[i + 1]) * 16 + value(raw[i + 2]))
            i += 3
    return out.decode("utf-8", "surrogateescape")


def parse_query(text: str) -> dict[str, str]:
    """Parameters of a query string: & separates, every = is dropped after the first ended the name, the last of
    equal names counts, a name alone has the value '', nothing is decoded."""
    out = {}
    for part in text.split("&"):
        name, _, value = part.partition("=")
        if part:
            out[name] = value.replace("=", "")
    return out
