"""People across services: handles and names to persons, merging, and configured name maps.

Resolution works on the distinct handles or names, not on messages; messages pick their person up in
one join at the end. The distinct keys are written once, because several steps read them. New ids follow
the day a key is first seen and then its hash, so they do not depend on how the rows were partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import choose, norm_handle, norm_name, strip
from parlance.operators.ordered import number_rows
from parlance.session import materialise


@dataclass
class Resolution:
    """``links`` maps every key (``value``) to a ``person_id``; the others hold what has to be added."""

    links: DataFrame
    new_persons: DataFrame
    new_handles: DataFrame | None = None


def next_id(table: DataFrame) -> Column:
    """Highest id of a table as a scalar subquery, 0 for an empty one."""
    return F.coalesce(table.select(F.max("id").alias("id")).scalar(), F.lit(0))


def resolve_handles(sent: DataFrame, handles: DataFrame, persons: DataFrame) -> Resolution:
    """``sent``: value, ts. Unknown handles become persons named by their first spelling."""
    seen = (
        sent.filter(F.coalesce("value", F.lit("")) != "")
        .groupBy("value").agg(F.min("ts").alias("ts")).withColumn("norm", norm_handle(F.col("value")))
    )
    known = handles.groupBy(F.col("value").alias("norm")).agg(F.max("person_id").alias("known_id"))
    matched = materialise(seen.join(known, "norm", "left"), "handles")
    fresh = _first_spelling(matched.filter(F.col("known_id").isNull()))
    numbered = _number(fresh, persons)
    links = matched.join(numbered.select("norm", "person_id"), "norm", "left").select(
        "value", F.coalesce("known_id", "person_id").alias("person_id"))
    return Resolution(links, _persons(numbered), numbered.select(F.col("norm").alias("value"), "person_id"))


def match_names(names: DataFrame, persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """Look up distinct names (``value``): exact display name, then spelling, else NULL ``known_id``.

    On the normalised key a recorded spelling beats a display name; of several persons the latest wins.
    """
    keyed = names.withColumn("key", strip(F.col("value"))).withColumn("norm", norm_name(F.col("key")))
    exact = persons.groupBy(F.col("display_name").alias("key")).agg(F.max("id").alias("exact_id"))
    spelled = aliases.select(norm_name(F.col("value")).alias("norm"), F.struct(F.lit(1).alias("r"), F.col("person_id").alias("id")).alias("c"))
    shown = persons.select(norm_name(F.col("display_name")).alias("norm"), F.struct(F.lit(0).alias("r"), "id").alias("c"))
    by_norm = spelled.unionByName(shown).groupBy("norm").agg(F.max("c")["id"].alias("norm_id"))
    return keyed.join(exact, "key", "left").join(by_norm, "norm", "left").withColumn(
        "known_id", F.coalesce("exact_id", "norm_id")).drop("exact_id", "norm_id")


def resolve_names(sent: DataFrame, persons: DataFrame, aliases: DataFrame) -> Resolution:
    """``sent``: value, ts. Names without a match become persons, one per normalised name."""
    names = sent.filter(F.coalesce("value", F.lit("")) != "").groupBy("value").agg(F.min("ts").alias("ts"))
    matched = materialise(match_names(names, persons, aliases), "names")
    numbered = _number(_first_spelling(matched.filter(F.col("known_id").isNull()), "key"), persons)
    links = matched.join(numbered.select("norm", "person_id"), "norm", "left").select(
        "value", F.coalesce("known_id", "person_id").alias("person_id"))
    return Resolution(links, _persons(numbered))


def _first_spelling(rows: DataFrame, shown: str = "value") -> DataFrame:
    return rows.groupBy("norm").agg(
        F.min("ts").alias("ts"), F.min_by(shown, F.struct("ts", shown)).alias("display_name"))


def _number(fresh: DataFrame, persons: DataFrame) -> DataFrame:
    return number_rows(fresh, F.col("norm"), "person_id", next_id(persons), F.floor(F.coalesce("ts", F.lit(0)) / 86400))


def _persons(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("person_id").alias("id"), "display_name", F.lit(None).cast("string").alias("avatar_src"))


def link_senders(rows: DataFrame, links: DataFrame, sender: str = "sender_raw") -> DataFrame:
    """Add ``person_id`` to rows by their raw sender."""
    return rows.join(links.select(F.col("value").alias(sender), "person_id"), sender, "left")


# --- merging ------------------------------------------------------------------------------------------


def settle_merges(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """Pairs (src_id, dst_id) of existing persons, chains followed to their end.

    Pairs that name a person who does not exist are left out. Every round halves the chains, so after log2(pairs) rounds
    only cycles are left.
    """
    known = persons.select(F.col("id").alias("src_id"))
    settled = pairs.filter(F.col("src_id") != F.col("dst_id")).join(known, "src_id", "left_semi")
    settled = settled.join(known.withColumnRenamed("src_id", "dst_id"), "dst_id", "left_semi")
    settled = materialise(settled.groupBy("src_id").agg(F.min("dst_id").alias("dst_id")), "merges")
    for _ in range(settled.count().bit_length() + 1):
        step = settled.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("_next"))
        if settled.join(step, "dst_id", "left_semi").isEmpty():
            return settled
        settled = materialise(settled.join(step, "dst_id", "left").select("src_id", F.coalesce("_next", "dst_id").alias("dst_id")), "merges")
    raise ValueError("merge pairs form a cycle")


def merge_persons(tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """Point everything at the kept person, keep the old name as a spelling, drop the merged persons.

    ``tables``: person, handle, person_alias, chat_participant, message, device.
    """
    moves = settle_merges(pairs, tables["person"])

    def moved(df: DataFrame, column: str) -> DataFrame:
        step = moves.select(F.col("src_id").alias(column), "dst_id")
        return df.join(step, column, "left").withColumn(column, F.coalesce("dst_id", column)).drop("dst_id").select(*df.columns)

    aliases = moved(tables["person_alias"], "person_id")
    old_names = tables["person"].join(moves, F.col("id") == F.col("src_id")).select(
        F.col("display_name").alias("value"), F.col("dst_id").alias("person_id"))
    added = old_names.groupBy("value").agg(F.min("person_id").alias("person_id")).join(
        aliases.select("value"), "value", "left_anti")
    out = dict(tables)
    out["message"] = moved(tables["message"], "sender_person_id")
    out["device"] = moved(tables["device"], "owner_person_id")
    out["handle"] = moved(tables["handle"], "person_id")
    out["chat_participant"] = moved(tables["chat_participant"], "person_id").distinct()
    out["person_alias"] = aliases.unionByName(added.select(*aliases.columns))
    out["person"] = tables["person"].join(moves.select(F.col("src_id").alias("id")), "id", "left_anti")
    return out


# --- configured people --------------------------------------------------------------------------------


def migrate_people(people: DataFrame, persons: DataFrame, handles: DataFrame, aliases: DataFrame) -> Resolution:
    """A configured handle-to-name map (``handle``, ``name``): known handles stay, others get a person.

    ``links`` lists every entry with ``is_new``; dry runs only read it.
    """
    entries = people.withColumn("norm", norm_handle(F.col("handle")))
    known = handles.groupBy(F.col("value").alias("norm")).agg(F.max("person_id").alias("existing_id"))
    matched = entries.join(known, "norm", "left")
    fresh = matched.filter(F.col("existing_id").isNull())
    named = resolve_names(fresh.select(F.col("name").alias("value"), F.lit(0).alias("ts")), persons, aliases)
    by_name = named.links.select(F.col("value").alias("name"), "person_id")
    linked = matched.join(by_name, "name", "left").select(
        "handle", "norm", "name", F.coalesce("existing_id", "person_id").alias("person_id"),
        F.col("existing_id").isNull().alias("is_new"))
    new_handles = linked.filter("is_new").groupBy(F.col("norm").alias("value")).agg(
        F.min_by("person_id", "handle").alias("person_id"))
    return Resolution(linked, named.new_persons, new_handles)


def parse_owner_aliases(text: str) -> dict[str, str]:
    """``Short:Full, Short2:Full2`` as a mapping; incomplete pairs are left out."""
    pairs = (part.split(":", 1) for part in text.split(",") if ":" in part)
    return {a.strip(): b.strip() for a, b in pairs if a.strip() and b.strip()}


def owner_name(name: Column, aliases: dict[str, str]) -> Column:
    """Full owner name of a configured short form."""
    return F.coalesce(choose(name, aliases), name) if aliases else name
