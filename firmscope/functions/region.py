"""Whether an address, a position or a text lies in a search region."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STATES, _col, region_code


@dataclass(frozen=True)
class Region:
    """What a search calls its region; empty lists don't restrict."""

    regions: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    postal_prefixes: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    bbox: tuple[float, float, float, float] | None = None
    site_terms: list[str] = field(default_factory=list)

    def codes(self) -> list[str]:
        return [STATES.get(r.strip().lower(), r.strip().upper()) for r in self.regions]


def region_status(region: Region, country, state, postal, city, lat=None, lon=None, text=None) -> Column:
    """in, out or unknown. The address decides before the position, and that before the text.

    With postal prefixes a state alone isn't enough to be in. Null and empty are alike.
    """
    blank = lambda c: F.coalesce(_col(c) if c is not None else F.lit(None).cast("string"), F.lit(""))
    c, code = F.upper(blank(country)), F.coalesce(region_code(blank(state)), F.lit(""))
    zip_code, town = F.trim(blank(postal)), F.lower(blank(city))
    steps: list[tuple[Column, Column | str]] = []
    if region.countries:
        steps.append(((c != "") & ~c.isin([x.upper() for x in region.countries]), "out"))
    if region.regions:
        steps.append(((code != "") & ~code.isin(region.codes()), "out"))
    if region.postal_prefixes:
        starts = F.lit(False)
        for p in region.postal_prefixes:
            starts = starts | zip_code.startswith(str(p))
        steps.append((zip_code != "", F.when(starts, "in").otherwise("out")))
        if region.cities:
            steps.append((town != "", F.when(town.isin([x.lower() for x in region.cities]), "in").otherwise("out")))
    elif region.regions:
        steps.append((code != "", "in"))
    if region.bbox and lat is not None:
        south, west, north, east = region.bbox
        inside = _col(lat).between(south, north) & _col(lon).between(west, east)
        steps.append((_col(lat).isNotNull(), F.when(inside, "in").otherwise("out")))
    if not region.regions and region.countries:
        steps.append((c != "", "in"))
    if region.site_terms and text is not None:
        named = F.lit(False)
        for t in region.site_terms:
            named = named | blank(text).rlike(f"(?<![A-Za-z]){re.escape(t)}(?![A-Za-z])")
        steps.append((named, "in"))
    if not steps:
        return F.lit("unknown")
    out = F.when(steps[0][0], steps[0][1])
    for when, then in steps[1:]:
        out = out.when(when, then)
    return out.otherwise("unknown")
