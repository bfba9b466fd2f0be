"""Contact cards: the fields of every ``.vcf`` text, row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import empty_to_null, strip


def _lines(text: Column) -> Column:
    """Unfolded lines as (name, value)."""
    unfolded = F.regexp_replace(text, r"\r?\n[ \t]", "")
    lines = F.filter(F.split(unfolded, r"\r?\n"), lambda x: x.contains(":"))

    def pair(line: Column) -> Column:
        head, value = F.substring_index(line, ":", 1), F.regexp_extract(line, r"^[^:]*:(.*)$", 1)
        value = F.replace(F.replace(value, F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";"))
        value = strip(F.regexp_replace(value, r"\\[nN]", "\n"))
        return F.struct(F.upper(F.substring_index(head, ";", 1)).alias("name"), value.alias("value"))

    return F.transform(lines, pair)


def parse(cards: DataFrame, text: str = "text") -> DataFrame:
    """Add full_name, org, tel[], email[], url and, for map links, lat and lng."""
    rows = cards.withColumn("_pairs", _lines(F.col(text)))

    def values(name: str) -> Column:
        return F.transform(F.filter("_pairs", lambda p: p["name"] == name), lambda p: p["value"])

    reversed_name = F.array_join(F.reverse(F.filter(F.split(F.get(values("N"), F.lit(0)), ";"), lambda x: x != "")), " ")
    url = F.try_element_at(values("URL"), F.lit(-1))
    place = r"[?&]ll=([\-0-9.]+),([\-0-9.]+)"
    return rows.withColumns({
        "full_name": F.coalesce(empty_to_null(F.try_element_at(values("FN"), F.lit(-1))), reversed_name),
        "org": F.regexp_replace(F.try_element_at(values("ORG"), F.lit(-1)), r";+$", ""),
        "tel": values("TEL"), "email": values("EMAIL"), "url": url,
        "lat": empty_to_null(F.regexp_extract(F.coalesce(url, F.lit("")), place, 1)),
        "lng": empty_to_null(F.regexp_extract(F.coalesce(url, F.lit("")), place, 2)),
    }).drop("_pairs")
