"""Text fields of gazetteers and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in each unit; no unit is metres.
UNITS = {"": 1.0, "m": 1.0, "metre": 1.0, "metres": 1.0, "meter": 1.0, "meters": 1.0, "ft": 0.3048, "feet": 0.3048}


def elevation(text: Column) -> Column:
    """Metres from '4,810 m', '4810,5 m' or '100 ft'; null for other texts.

    The letters at the end are the unit, the rest is the number. Commas separate thousands where one to three digits stand before
    the first and three after each; a single comma is otherwise a decimal mark.
    """
    whole = F.lower(F.trim(text))
    unit = F.regexp_substr(whole, F.lit("[a-z]+$"))
    number = F.rtrim(F.substring(whole, F.lit(1), F.length(whole) - F.coalesce(F.length(unit), F.lit(0))))
    parts = F.split(F.ltrim(number, F.lit("+-")), ",", -1)
    after = F.slice(parts, 2, F.size(parts))
    thousands = F.length(parts[0]).between(1, 3) & F.forall(after, lambda x: F.length(x) == 3)
    plain = F.when(thousands, F.replace(number, F.lit(","), F.lit(""))).when(F.size(parts) == 2, F.replace(number, F.lit(","), F.lit("."))).otherwise(number)
    value = F.when(F.translate(plain, "0123456789", "").isin("", ".", "+", "-", "+.", "-."), plain.try_cast("double"))
    metres = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return value * F.try_element_at(metres, F.coalesce(unit, F.lit("")))


def tile_name(text: Column) -> Column:
    """(ty, tx) of 'tile_02_03' or '02_03'; null if it is neither."""
    y, x = (F.regexp_extract(text, r"^(?:tile_)?(\d+)_(\d+)$", i).try_cast("int") for i in (1, 2))
    return F.when(y.isNotNull(), F.struct(y.alias("ty"), x.alias("tx")))


def pace(minutes: Column) -> Column:
    """'05:30' of 5.5 minutes, truncated."""
    whole = F.floor(minutes)
    return F.format_string("%02d:%02d", whole.cast("int"), F.floor((minutes - whole) * 60).cast("int"))
