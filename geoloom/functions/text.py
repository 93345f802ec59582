"""Text forms for address search: folding, sort keys, tile names.

All forms stay in the JVM.  Spark has no Unicode decomposition, so tables built
from the Unicode data at import say it: letters that decompose to one letter go
through ``translate``; the few that decompose to several, and Hangul, are spelled
out only in texts that hold one.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transcription of German letters.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"))


def decompose(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def _tables() -> tuple[str, str, dict[str, str], str]:
    one, gone, more, white = {}, [], {}, []
    for ch in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if ch.isspace():
            white.append(ch)
        if ch.isascii() or "가" <= ch <= "힣":
            continue
        d = decompose(ch)
        if len(d) == 1 and d != ch:
            one[ch] = d
        elif not d:
            gone.append(ch)
        elif d != ch:
            more[ch] = d
    return "".join([*one, *gone]), "".join(one.values()), more, "".join(white)


#: Letters with one base letter, then marks, which have none; letters that are spelled out; white space.
FOLDED, BASES, SPELLED, WHITE = _tables()
_HANGUL = tuple("".join(map(chr, range(at, at + n))) for at, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))



def _ranges(letters: str) -> str:
    """A regex class of letters (ascending), neighbours joined."""
    runs: list[list[str]] = []
    for ch in letters:
        if runs and ord(ch) == ord(runs[-1][1]) + 1:
            runs[-1][1] = ch
        else:
            runs.append([ch, ch])
    return "[" + "".join(f"{a}-{b}" for a, b in runs) + "]"


_SPELL = _ranges("".join(sorted([*SPELLED, *map(chr, range(ord("가"), ord("힣") + 1))])))
_NOT_ASCII = "[^\\x00-\\x7F]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_form(c: Column | str) -> Column:
    """Lower case, sharp s written out, every abbreviated street word spelled out."""
    x = F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))
    x = F.replace(x, F.lit("str."), F.lit("strasse"))
    x = F.replace(x, F.lit("str "), F.lit("strasse "))
    return F.regexp_replace(x, "str\\z", "strasse")


def _spelled(ch: Column) -> Column:
    """A letter's decomposition where it has several letters, else the letter."""
    table = F.from_json(F.lit(json.dumps(SPELLED)), "map<string,string>")
    n = F.ascii(ch) - 0xAC00
    part = lambda letters, i: F.substr(F.lit(letters), i + 1, F.lit(1))
    hangul = F.concat(part(_HANGUL[0], F.floor(n / 588).cast("int")), part(_HANGUL[1], F.floor(n % 588 / 28).cast("int")))
    hangul = F.concat(hangul, F.when(n % 28 > 0, part(_HANGUL[2], n % 28 - 1)).otherwise(""))
    return F.when(ch.between("가", "힣"), hangul).otherwise(F.coalesce(F.try_element_at(table, ch), ch))


def drop_marks(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks."""
    x = F.translate(_col(c), FOLDED, BASES)
    letters = F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), _spelled)
    return F.when(x.rlike(_NOT_ASCII) & x.rlike(_SPELL), F.array_join(letters, "")).otherwise(x)


def transcribed_form(c: Column | str) -> Column:
    """Base form with umlauts transcribed, other accents dropped, white space at the ends trimmed."""
    x = base_form(c)
    for a, b in UMLAUTS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.btrim(drop_marks(x), F.lit(WHITE))


def stripped_form(c: Column | str) -> Column:
    """Base form with all accents dropped, white space at the ends trimmed."""
    return F.btrim(drop_marks(base_form(c)), F.lit(WHITE))


def search_forms(c: Column | str) -> Column:
    """The distinct forms of a query, transcribed first."""
    return F.array_distinct(F.array(transcribed_form(c), stripped_form(c)))


def gazetteer_key(c: Column | str) -> Column:
    """Lower case, German letters transcribed, accents dropped, other non-ASCII dropped."""
    x = F.lower(_col(c))
    for a, b in (*UMLAUTS, ("ß", "ss")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(drop_marks(x), _NOT_ASCII, "")


def number_sort_key(c: Column | str) -> Column:
    """First run of ASCII digits as a number, 0 without one (or if it exceeds 64 bits)."""
    digits = F.regexp_extract(_col(c), "[0-9]+", 0)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_filled(*cs: Column | str) -> Column:
    """First value that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(_col(c), F.lit("")) for c in cs), F.lit(""))


def local_name(c: Column | str) -> Column:
    """Tag name without its namespace in braces."""
    return F.substring_index(_col(c), "}", -1)


TILE_NAME = r"_32_?(\d{3})_(\d{4})[_.]"


def tile_of_name(c: Column | str) -> Column:
    """(east, north) kilometre tile of a file name, null if the name has none."""
    east, north = (F.nullif(F.regexp_extract(_col(c), TILE_NAME, i), F.lit("")).cast("int") for i in (1, 2))
    return F.when(east.isNotNull(), F.struct(east.alias("east"), north.alias("north")))


def tile_of_parts(c: Column | str, suffix: str = ".jp2") -> Column:
    """(east, north) from the third and fourth part of a name with at least five parts."""
    parts = F.split(_col(c), "_")
    ok = F.endswith(_col(c), F.lit(suffix)) & (F.size(parts) >= 5)
    east, north = F.get(parts, F.lit(2)).try_cast("int"), F.get(parts, F.lit(3)).try_cast("int")
    return F.when(ok & east.isNotNull() & north.isNotNull(), F.struct(east.alias("east"), north.alias("north")))


def file_stem(c: Column | str) -> Column:
    """Last path part without its suffix."""
    return F.regexp_replace(F.substring_index(_col(c), "/", -1), "\\.[^.]*$", "")


def kilometres(c: Column | str) -> Column:
    """Distance text such as ``1,2 km`` or ``800 m`` in kilometres; null if it is none."""
    number = F.nullif(F.regexp_extract(_col(c), r"^([\d.,]+)\s*(km|m)", 1), F.lit(""))
    value = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.regexp_extract(_col(c), r"^([\d.,]+)\s*(km|m)", 2) == "m", value / 1000).otherwise(value)


def display_name(local: Column | str, name: Column | str) -> Column:
    return F.coalesce(_col(local), _col(name))


def with_elevation(name: Column | str, elevation: Column | str) -> Column:
    """``name 123 m`` where the elevation is known, else the name."""
    n, e = _col(name), _col(elevation)
    return F.when(e.isNotNull(), F.concat(F.coalesce(n, F.lit("")), F.lit(" "), e.cast("string"), F.lit(" m"))).otherwise(n)


def first_line(c: Column | str, n: int = 44) -> Column:
    return F.substring(F.substring_index(_col(c), "\n", 1), 1, n)
