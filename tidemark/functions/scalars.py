"""Small scalar rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, a / b)


def shrink(value: Column, n: Column, prior: Column, k: float) -> Column:
    """Blend of a value seen n times with its prior, which weighs k; a null value gives the prior."""
    return F.coalesce((n * value + k * prior) / (n + k), prior)


def minutes(text: Column) -> Column:
    """Minutes of MM:SS, PTmMsS or a plain number; anything else is 0."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double")
    clock = part(r"^(\d+):(\d+)$", 1) + part(r"^(\d+):(\d+)$", 2) / 60
    iso = part(r"^PT(\d+)M([\d.]+)S$", 1) + part(r"^PT(\d+)M([\d.]+)S$", 2) / 60
    return F.coalesce(clock, iso, part(r"^(\d+(?:\.\d+)?)$", 1), F.lit(0.0))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


# Short forms in team names, and what they stand for.
SHORT_FORMS = [(r"\bst\b$", "state"), (r"\bst\b(?!\.*\s)", "st."), (r"\buniv\b", "university"), (r"\bchr\b", "christian")]


def team_name(name: Column, known: dict[str, str] | None = None) -> Column:
    """The known form of a name in lower case, else single spaces and short forms written out; a null name is empty."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    whole = F.regexp_replace(low, r"\s+", " ")
    for pattern, full in SHORT_FORMS:
        whole = F.regexp_replace(whole, pattern, full)
    if known:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return F.coalesce(F.try_element_at(table, low), F.trim(whole))
    return F.trim(whole)


def size_bucket(value: Column, large: float, mid: float, small: float) -> Column:
    """Name of the size class; null or not above 0 is micro."""
    return F.when(value >= large, "large").when(value >= mid, "mid").when(value >= small, "small").otherwise("micro")
