"""Scalar text functions as columns: cleaning, predicates, number and title splitting.

Java's ``\\s`` and ``\\w`` are ASCII only, so white space is written out where the meaning is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a class's inside.
SPACES = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Glyphs that lead from a title to a page number.
LEADERS = r".\u2024\u2026\u22ef\u00b7\u2027"

# What a contents line, a number in front of a title and a section's line look like.
TOC_DOT_LEADER = rf"(?iu)^\s*.+?(?=[\s{LEADERS}]*[{LEADERS}])[\s{LEADERS}]+(\d{{1,4}}|[ivxlcdm]{{1,8}})\s*$"
TOC_HEADING = r"(?i)^\s*(table\s+of\s+)?contents\s*$"
TOC_ROMAN_END = r"(?i)\b[ivxlcdm]{1,8}\s*$"
TOC_GLYPHS_PAGE = r"(?i)([\._·•⋅…—–\-]{2,}).{0,12}(\d{1,4}|[IVXLCDM]{1,7})\s*$"

NUMBER = r"^\d+(?:\.\d+){0,5}\b"
ROMAN = r"(?i)^[IVXLCDM]+(?:\.[A-Za-z0-9]+){0,4}\b"
ALPHA = r"^[A-Z](?:\.[A-Za-z0-9]+){0,4}\b"
SECTION_LINE = r"^(\d+(?:\.\d+)*)[\s\-\.]+(.+)$"


#: The same characters, one by one.
SPACE_CHARACTERS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind. No pattern: it is asked of every line, often more than once."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def lines(c: Column) -> Column:
    """The text's lines; a trailing line break adds none."""
    cut = F.split(c, r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]")
    last = F.element_at(cut, -1)
    return F.when((F.size(cut) > 0) & (last == ""), F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def fold_spaces(c: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.lower(F.regexp_replace(strip(c), rf"[{SPACES}]+", " "))


def match_key(c: Column) -> Column:
    """For matching titles: everything but ASCII letters and digits is one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"[^0-9A-Za-z]+", " ")))


def fix_ocr(c: Column) -> Column:
    """Words hyphenated over a line break are joined; runs of white space become a space."""
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1-$2")
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([a-z])", "$1$2")
    return F.regexp_replace(c, rf"[{SPACES}]{{2,}}", " ")


def clean_spec_line(c: Column) -> Column:
    """Without a leading bullet and then one enumerator."""
    c = F.regexp_replace(strip(c), r"^[\-•*]+\s*", "")
    return strip(F.regexp_replace(c, r"^\d+(?:\.\d+)*[.)]\s*", ""))


def normalize_spec_line(c: Column) -> Column:
    """Without bullet, enumerator, leading number and trailing punctuation."""
    c = F.regexp_replace(strip(c), r"^[-•*]\s+", "")
    c = F.regexp_replace(c, r"^\d+(?:\.\d+)*[.)]\s*", "")
    c = F.regexp_replace(c, r"^\d+(?:\.\d+)*\s+", "")
    return strip(F.regexp_replace(c, r"[.;:,]+$", ""))


def is_toc_entry(c: Column) -> Column:
    """A title, leaders, a page number."""
    return strip(c).rlike(TOC_DOT_LEADER)


def is_toc_line(c: Column) -> Column:
    """For anchors: an entry, a page after leader glyphs, or a roman numeral at the end."""
    s = strip(c)
    return s.rlike(TOC_DOT_LEADER) | s.rlike(TOC_GLYPHS_PAGE) | s.rlike(TOC_ROMAN_END)


#: Contents lines as the page that shows sections knows them.
SHOWN_TOC = (r"(?:\. ?){4,}", r"(?:[_\-·•]\s?){3,}", r"(?i)(?:[._\-·•]\s?){4,}(?:\d{1,4}|[IVXLCDM]{1,6})\s*$")


def is_shown_toc(c: Column) -> Column:
    """A line with a row of leaders, whether or not a page follows."""
    s = strip(F.coalesce(c, F.lit("")))
    return s.rlike(SHOWN_TOC[0]) | s.rlike(SHOWN_TOC[1]) | s.rlike(SHOWN_TOC[2])


def is_probable_table(c: Column) -> Column:
    """A caption, or more digits than letters with a letter at least."""
    low = F.lower(c)
    digits = F.char_length(c) - F.char_length(F.regexp_replace(c, r"\p{Nd}", ""))
    letters = F.char_length(c) - F.char_length(F.regexp_replace(c, r"\p{L}", ""))
    return low.startswith("table ") | low.startswith("figure ") | ((digits > letters) & (letters >= 1))


def split_number(c: Column) -> Column:
    """struct(number, title): a leading numeric, roman or capital-letter number, or null and the whole."""
    s = F.trim(c)

    def cut(pattern: str) -> Column:
        token = F.regexp_extract(s, pattern, 0)
        rest = F.substring(s, F.char_length(token) + 1, F.char_length(s))
        bare = F.regexp_replace(rest, r"^[ )\-.]+", "")
        return F.struct(
            F.regexp_replace(token, r"[.\-]+$", "").alias("number"),
            F.when(bare != "", bare).otherwise(F.trim(rest)).alias("title"),
        )

    none = F.struct(F.lit(None).cast("string").alias("number"), s.alias("title"))
    return F.when(s.rlike(NUMBER), cut(NUMBER)).when(s.rlike(ROMAN), cut(ROMAN)).when(s.rlike(ALPHA), cut(ALPHA)).otherwise(none)


def segment_count(number: Column) -> Column:
    """The depth that a section number tells: its segments; a letter alone counts 2, one in front of others one more."""
    clean = F.regexp_replace(number, r"[.\-]+$", "")
    segments = F.filter(F.split(clean, r"\."), lambda x: x != "")
    n = F.size(segments)
    return (
        F.when(F.coalesce(number, F.lit("")) == "", 0)
        .when(clean.rlike(r"^\p{L}$"), 2)
        .when(n == 0, 1)
        .when((n > 1) & F.get(segments, F.lit(0)).rlike(r"^\p{L}$"), n + 1)
        .otherwise(n)
    )


def heading_alike(a: Column, b: Column) -> Column:
    """Either is a prefix of the other, both folded; empty ones are like nothing."""
    x, y = fold_spaces(F.coalesce(a, F.lit(""))), fold_spaces(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & (x.startswith(y) | y.startswith(x))


def natural_key(c: Column) -> Column:
    """A sort key by which runs of digits compare as numbers, however long: their length without leading zeros is in front of them."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))

    def number(x: Column) -> Column:
        bare = F.ltrim(x, F.lit("0"))
        return F.concat(F.lpad(F.char_length(bare).cast("string"), 10, "0"), bare)

    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(F.lower(x))), "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def window(c: Column, at: Column, radius: int = 200) -> Column:
    """The text around a position from 0."""
    lo = F.greatest(at - radius, F.lit(0))
    return F.substring(c, lo + 1, F.least(F.char_length(c), at + radius) - lo)


def redacted(key: Column, value: Column, longest: int = 200) -> Column:
    """A value for traces: secret by its key's name, else cut to a length."""
    secret = F.lower(key).rlike("key|token|secret|password|authorization")
    cut = F.when(F.char_length(value) > longest, F.concat(F.substring(value, 1, longest), F.lit("..."))).otherwise(value)
    return F.when(secret, F.lit("***")).otherwise(cut)
