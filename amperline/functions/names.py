"""Names: grids, fuels and free text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed spellings of the three grids.
GRIDS = {"CLUZ": "luzon", "LUZON": "luzon", "CVIS": "visayas", "VISAYAS": "visayas", "CMIN": "mindanao", "MINDANAO": "mindanao"}


def grid_of(region: Column) -> Column:
    """The grid of a region name, null for others."""
    pairs = [F.lit(x) for kv in GRIDS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.upper(F.trim(region)))


def grid_of_code(resource: Column) -> Column:
    """The grid of a resource code by its two leading digits."""
    n = F.regexp_extract(resource, r"^(\d{2})", 1).try_cast("int")
    return F.when(n.between(1, 3), "luzon").when(n.between(4, 8), "visayas").when(n.between(9, 14), "mindanao")


def fuel_of_code(resource: Column) -> Column:
    """Solar or wind by the words that their codes use, else null."""
    r = F.upper(resource)
    return F.when(r.rlike("SOL|SPV"), "solar").when(r.rlike("WIND|WPP|BURGOS"), "wind")


def plain(c: Column) -> Column:
    """ASCII letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


#: Latin letters with marks and the letters without: what their decomposition begins with.
_MARKED = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFKD", chr(c))[0].isascii()}


def folded(c: Column) -> Column:
    """`plain` after marks are taken off Latin letters, whether they stand alone or follow their letter."""
    return plain(F.translate(c, "".join(_MARKED), "".join(_MARKED.values())))


def token(resource: Column) -> Column:
    """The part of a code before its first underscore, without leading digits."""
    return F.regexp_replace(F.split_part(resource, F.lit("_"), F.lit(1)), r"^\d+", "")


def limitation_cause(remark: Column) -> Column:
    """What a remark on a limitation names, spaces and hyphens squeezed: leyte-cebu, hvdc or other; null for remarks that tell of none."""
    r = F.lower(F.coalesce(remark, F.lit("")))
    squeezed = F.regexp_replace(r, r"[\s\-]+", "")
    cause = F.when(F.contains(squeezed, F.lit("leytecebu")), "leyte-cebu").when(F.contains(squeezed, F.lit("hvdc")), "hvdc").otherwise("other")
    return F.when(F.contains(r, F.lit("limitation")), cause)
