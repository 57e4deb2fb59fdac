"""Numerals, dates, units and colours."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indices of initial consonants and vowels of the official syllable order, and the consonant letters.
SYLLABLE_INITIALS = (0, 2, 3, 5, 6, 7, 9, 11, 12, 14, 15, 16, 17, 18)
SYLLABLE_VOWELS = (0, 4, 8, 13, 18, 20)
CONSONANTS = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
# Border widths in mm by index.
BORDER_MM = (0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)
SYSTEMS = ("digit", "syllable", "consonant", "circled", "circled_syllable", "latin_upper", "latin_lower", "roman_upper", "roman_lower")


def character(code: Column) -> Column:
    """The character of a code point of the first plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def syllable(n: Column) -> Column:
    i = F.greatest(n - 1, F.lit(0))
    row = F.floor(i / 14)
    code = 0xAC00 + _pick(SYLLABLE_INITIALS, i % 14) * 588 + _pick(SYLLABLE_VOWELS, F.least(row, F.lit(5))) * 28
    return F.when(row < 6, character(code)).otherwise(n.cast("string"))


def latin(n: Column, letters: str) -> Column:
    """Bijective base 26, each letter by itself: the j-th from the right is there once n passes all shorter numbers."""
    m, parts, passed = F.greatest(n, F.lit(1)).cast("long"), [], 0
    for j in range(7):
        digit = F.floor((m - 1 - passed) / 26**j) % 26
        parts.insert(0, F.when(m > passed, F.substring(F.lit(letters), (digit + 1).cast("int"), F.lit(1))).otherwise(""))
        passed += 26 ** (j + 1)
    return F.concat(*parts)


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999, a digit at a time; decimal elsewhere."""
    digit = lambda one, five, ten: ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)
    parts = [_pick(digit(*s), F.floor(n / p) % 10) for p, s in ((1000, "m??"), (100, "cdm"), (10, "xlc"), (1, "ivx"))]
    return F.when(n.between(1, 3999), F.concat(*parts)).otherwise(n.cast("string"))


def format_number(n: Column, system: Column | str) -> Column:
    """A counter in one of the nine numeral systems; a system named in Python is the only one in the plan."""
    made = {
        "syllable": lambda: syllable(n),
        "consonant": lambda: F.substring(F.lit(CONSONANTS), ((F.greatest(n, F.lit(1)) - 1) % 14 + 1).cast("int"), F.lit(1)),
        "circled": lambda: F.when(n.between(1, 20), character(0x245F + n)).otherwise(n.cast("string")),
        "circled_syllable": lambda: F.when(n.between(1, 14), character(0x326D + n)).otherwise(syllable(n)),
        "latin_upper": lambda: latin(n, ascii_uppercase),
        "latin_lower": lambda: latin(n, ascii_lowercase),
        "roman_upper": lambda: F.upper(roman(n)),
        "roman_lower": lambda: roman(n),
    }
    if isinstance(system, str):
        return made[system]() if system in made else n.cast("string")
    return reduce(lambda out, name: F.when(system == name, made[name]()).otherwise(out), made, n.cast("string"))


def page_number(n: Column, code: Column, user: Column, prefix: Column, suffix: Column) -> Column:
    """Page number text by format code; unknown codes take the user's character, else decimal."""
    system = F.when(code == 1, "circled").when(code == 2, "roman_upper").when(code == 3, "roman_lower").when(code == 4, "latin_upper").when(code == 5, "latin_lower").when(code == 8, "syllable").when(code == 10, "consonant").otherwise("digit")
    known = code.isin(0, 1, 2, 3, 4, 5, 8, 10)
    body = F.when(~known & (F.coalesce(user, F.lit("")) != ""), user).otherwise(format_number(n, system))
    return F.concat(F.coalesce(prefix, F.lit("")), body, F.coalesce(suffix, F.lit("")))


EPOCH = 11_644_473_600  # seconds from 1601 to 1970


def filetime_seconds(ft: Column) -> Column:
    return F.floor(ft / F.lit(10_000_000)).cast("long") - EPOCH


def _day(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def _clock(seconds: Column, unit: int, size: int) -> Column:
    return F.lpad(F.floor(F.pmod(seconds, F.lit(86400)) / unit % size).cast("string"), 2, "0")


def filetime_iso(ft: Column) -> Column:
    """UTC, whatever the session's zone."""
    t = filetime_seconds(ft)
    return F.when(ft != 0, F.concat(_day(t).cast("string"), F.lit("T"), _clock(t, 3600, 24), F.lit(":"), _clock(t, 60, 60), F.lit(":"), _clock(t, 1, 60), F.lit("Z")))


def filetime_korean(ft: Column) -> Column:
    """Twelve-hour text in Korean standard time, whatever the session's zone."""
    t = filetime_seconds(ft) + 9 * 3600
    d = _day(t)
    day = _pick(tuple("일월화수목금토"), F.dayofweek(d) - 1)
    hour = F.floor(F.pmod(t, F.lit(86400)) / 3600).cast("int")
    text = F.concat(
        F.year(d), F.lit("년 "), F.month(d), F.lit("월 "), F.dayofmonth(d), F.lit("일 "), day, F.lit("요일 "), F.when(hour < 12, "오전").otherwise("오후"),
        F.lit(" "), F.when(hour % 12 == 0, 12).otherwise(hour % 12), F.lit(":"), _clock(t, 60, 60), F.lit(":"), _clock(t, 1, 60),
    )
    return F.when(ft != 0, text)


def iso_to_filetime(s: Column) -> Column:
    """Of YYYY-MM-DDThh:mm:ssZ; null for other texts and days that do not exist."""
    part = lambda at: F.substring(s, at, 2).try_cast("long")
    seconds = F.unix_date(F.substring(s, 1, 10).try_cast("date")).cast("long") * 86400 + part(12) * 3600 + part(15) * 60 + part(18)
    good = s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z$")
    return F.when(good, (seconds + EPOCH) * F.lit(10_000_000))


def is_iso_date(s: Column) -> Column:
    """Exactly YYYY-MM-DD, year 1 or later, and a day that exists."""
    return F.coalesce(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~s.startswith("0000") & F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def to_points(u: Column) -> Column:
    return u / 100.0


def to_mm(u: Column) -> Column:
    return u * 25.4 / 7200.0


def to_pixels(u: Column, dpi: float = 96.0) -> Column:
    return u * dpi / 7200.0


def color_hex(c: Column) -> Column:
    """#RRGGBB of a 0x00BBGGRR number; null for the one that means none."""
    return F.when(c != 0xFFFFFFFF, F.format_string("#%02X%02X%02X", c.bitwiseAND(255), F.shiftright(c, 8).bitwiseAND(255), F.shiftright(c, 16).bitwiseAND(255)))


def parse_color(s: Column) -> Column:
    part = lambda i: F.conv(F.substring(s, i, 2), 16, 10).cast("long")
    return F.when(s.rlike("^#[0-9A-Fa-f]{6}$"), part(2) + part(4) * 256 + part(6) * 65536).otherwise(F.lit(0xFFFFFFFF))


def flag(attr: Column, bit: int) -> Column:
    return F.shiftright(attr, bit).bitwiseAND(F.lit(1)) != 0


def bits(attr: Column, low: int, n: int) -> Column:
    return F.shiftright(attr, low).bitwiseAND(F.lit((1 << n) - 1))


def border_mm(index: Column) -> Column:
    return F.when(index.between(0, 15), _pick(BORDER_MM, F.least(F.greatest(index, F.lit(0)), F.lit(15)))).otherwise(0.12)


def record_header(v: Column) -> Column:
    """tag, level, size and whether the size follows in four more bytes."""
    size = F.shiftrightunsigned(v, 20).bitwiseAND(0xFFF)
    return F.struct(v.bitwiseAND(0x3FF).alias("tag"), F.shiftrightunsigned(v, 10).bitwiseAND(0x3FF).alias("level"), size.alias("size"), (size == 0xFFF).alias("extended"))
