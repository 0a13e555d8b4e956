"""Specification items: trigger words, values with units, categories, confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRIGGERS = ("shall", "must", "should", "required", "ensure", "provide", "include")
VALUE_UNIT = r"(?i)(-?\d+(?:\.\d+)?)\s*(°\s?[CF]|deg\s?[CF]|mm|cm|m|in|ft|kg|g|lb|lbs|psi|bar|vdc|vac|kv|v|amp|amps|a|ma|hz|rpm|%)"
CONVERSIONS = {
    "mm": ("mm", 1.0), "cm": ("mm", 10.0), "m": ("mm", 1000.0), "in": ("mm", 25.4), "ft": ("mm", 304.8),
    "kg": ("kg", 1.0), "g": ("kg", 0.001), "lb": ("lb", 1.0), "lbs": ("lb", 1.0),
    "psi": ("psi", 1.0), "bar": ("bar", 1.0),
    "v": ("V", 1.0), "kv": ("V", 1000.0), "vdc": ("VDC", 1.0), "vac": ("VAC", 1.0),
    "a": ("A", 1.0), "amp": ("A", 1.0), "amps": ("A", 1.0), "ma": ("A", 0.001),
    "hz": ("Hz", 1.0), "rpm": ("RPM", 1.0), "%": ("%", 1.0),
}
KEYWORDS = {
    "mechanical": ("length", "width", "height", "diameter", "thickness", "spacing", "clearance", "distance", "depth", "weight", "mass", "torque", "pressure", "temperature", "enclosure", "ip"),
    "electrical": ("voltage", "current", "power", "watt", "phase", "supply", "volts", "amps", "frequency"),
    "controls": ("controller", "plc", "relay", "sensor", "io", "i/o", "modbus", "ethernet", "control", "automation"),
    "software": ("software", "firmware", "version", "api", "protocol", "ui", "interface"),
    "project_mgmt": ("training", "documentation", "schedule", "timeline", "delivery", "commissioning", "maintenance", "project"),
}
UNIT_CATEGORY = {
    "mm": "mechanical", "kg": "mechanical", "lb": "mechanical", "degc": "mechanical",
    "v": "electrical", "vdc": "electrical", "vac": "electrical", "a": "electrical", "hz": "electrical",
    "rpm": "controls",
}
FALLBACK_UNIT = r"(?i)\b\d+(?:\.\d+)?\s?(?:mm|cm|m|in|ft|N|kN|MPa|GPa|°C|°F)\b"
FALLBACK_STANDARD = r"(?i)\b(?:ASME|ISO|DIN|ASTM)\b"
FALLBACK_BULLET = r"^\s*(?:[-•*]|\d+(?:\.\d+)*[.)]?)"


def keyword_pattern(category: str) -> str:
    """Words by themselves, where they are all letters; others anywhere."""
    plain = "|".join(k for k in KEYWORDS[category] if k.isalpha())
    other = [k for k in KEYWORDS[category] if not k.isalpha()]
    return "|".join([rf"\b(?:{plain})\b", *other])


def is_candidate(line: Column) -> Column:
    """A cleaned line with a trigger, as part of a word even, or a value with a unit."""
    return (line != "") & (F.lower(line).rlike("|".join(TRIGGERS)) | line.rlike(VALUE_UNIT))


def is_fallback_candidate(line: Column) -> Column:
    return line.rlike(FALLBACK_UNIT) | line.rlike(FALLBACK_STANDARD) | line.rlike(FALLBACK_BULLET)


def measured(line: Column) -> Column:
    """struct(raw_value, normalized_value, normalized_unit) of the line's first value with a unit; nulls without one."""
    return converted(F.regexp_extract(line, VALUE_UNIT, 1), F.regexp_extract(line, VALUE_UNIT, 2))


def converted(raw: Column, unit: Column) -> Column:
    """The same of a value and a unit that were read already; an empty unit is none."""
    token = F.lower(F.replace(unit, F.lit(" "), F.lit("")))
    value = raw.cast("double")
    table = F.create_map(*(F.lit(x) for k, (u, f) in CONVERSIONS.items() for x in (k, f"{u}|{f!r}")))
    known = F.split(table[token], r"\|")
    number = (
        F.when(token.isin("°c", "degc"), value)
        .when(token.isin("°f", "degf"), F.round((value - 32.0) * 5.0 / 9.0, 4))
        .otherwise(F.round(value * F.get(known, F.lit(1)).cast("double"), 4))
    )
    name = F.when(token.isin("°c", "degc", "°f", "degf"), F.lit("degC")).otherwise(F.get(known, F.lit(0)))
    has = unit != ""
    return F.struct(
        F.when(has, F.concat_ws(" ", raw, F.trim(unit))).alias("raw_value"),
        F.when(has, number).alias("normalized_value"),
        F.when(has, name).alias("normalized_unit"),
    )


def category(line: Column, unit: Column) -> Column:
    """By the unit, else by the first group of keywords, in order, that the line has."""
    hints = F.create_map(*(F.lit(x) for pair in UNIT_CATEGORY.items() for x in pair))
    low = F.lower(line)
    by_word = reduce(lambda out, c: out.when(low.rlike(keyword_pattern(c)), c), KEYWORDS, F.when(F.lit(False), ""))
    return F.coalesce(hints[F.lower(unit)], by_word, F.lit("unknown"))


def confidence(line: Column, has_value: Column, group: Column) -> Column:
    """By the line's words, whether it has a value with a unit, and whether its category is known."""
    low = F.lower(line)
    base = (
        F.when(low.rlike("shall|must|required"), 0.9)
        .when(low.rlike("should|ensure|include"), 0.75)
        .when(has_value, 0.65)
        .otherwise(0.5)
    )
    more = F.when(has_value, 0.05).otherwise(0.0) + F.when(group != "unknown", 0.05).otherwise(0.0)
    return F.round(F.least(base + more, F.lit(1.0)), 2)
