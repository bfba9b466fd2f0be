import pytest
from conftest import dicts

from parlance.operators import identity, vcards

PERSON = "id long, display_name string, avatar_src string"


def people(spark, *rows):
    return spark.createDataFrame([(k, n, None) for k, n in rows], PERSON)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "value string, person_id long")


def sent(spark, *rows):
    return spark.createDataFrame(list(rows), "value string, ts long")


def links(found):
    return {r.value: r.person_id for r in found.links.collect()}


def test_handles_in_any_spelling(spark):
    found = identity.resolve_handles(
        sent(spark, ("+49 170-1", 5), ("+491701", 6), ("New@X.org", 9), ("new@x.org", 3), ("", 1), (None, 1)),
        pairs(spark, ("+491701", 7)), people(spark, (7, "A"), (9, "B")))
    assert links(found) == {"+49 170-1": 7, "+491701": 7, "New@X.org": 10, "new@x.org": 10}
    assert [(r.id, r.display_name) for r in found.new_persons.collect()] == [(10, "new@x.org")]
    assert [(r.value, r.person_id) for r in found.new_handles.collect()] == [("new@x.org", 10)]


def test_names_exact_then_spelling_then_new(spark):
    found = identity.resolve_names(
        sent(spark, ("Alice", 1), (" Alice ", 1), ("alice", 1), ("ALICE K.  example", 2), ("Zoe", 400000), ("zoe", 5), ("Bob  B", 9)),
        people(spark, (1, "Alice"), (2, "Bob"), (3, "Alice")), pairs(spark, ("Alice K. Example", 2)))
    assert links(found) == {"Alice": 3, " Alice ": 3, "alice": 3, "ALICE K.  example": 2, "Zoe": links(found)["zoe"], "zoe": links(found)["zoe"],
                            "Bob  B": links(found)["Bob  B"]}
    assert {r.display_name for r in found.new_persons.collect()} == {"zoe", "Bob  B"}
    assert {r.id for r in found.new_persons.collect()} == {4, 5}


def test_a_spelling_beats_a_display_name(spark):
    found = identity.match_names(sent(spark, ("ALICE", 1)).select("value"), people(spark, (1, "Alice"), (2, "Bob")), pairs(spark, ("alice", 2)))
    assert found.first().known_id == 2


def test_numbers_follow_the_first_day_and_no_partitioning(spark):
    rows = [(f"n{k}", 86400 * (9 - k % 10)) for k in range(60)]
    seen = set()
    for parts in (1, 5):
        found = identity.resolve_names(sent(spark, *rows).repartition(parts), people(spark, (1, "x")), pairs(spark, ("y", 1)))
        seen.add(tuple(sorted((r.id, r.display_name) for r in found.new_persons.collect())))
    (only,) = seen
    days = [9 - int(n[1:]) % 10 for _, n in only]
    assert days == sorted(days) and [k for k, _ in only] == list(range(2, 62))


def merge_input(spark):
    return {
        "person": people(spark, (1, "A"), (2, "B"), (3, "C"), (4, "D")), "handle": pairs(spark, ("h2", 2), ("h3", 3)),
        "person_alias": pairs(spark, ("B", 1), ("bee", 2)),
        "chat_participant": spark.createDataFrame([(9, 1), (9, 2), (8, 3)], "chat_id long, person_id long"),
        "message": spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, None)], "id long, sender_person_id long"),
        "device": spark.createDataFrame([(1, 3)], "id long, owner_person_id long"),
    }


def state(tables):
    return {name: sorted(map(str, df.collect())) for name, df in tables.items()}


def test_merge_moves_everything_follows_chains_and_is_idempotent(spark):
    moves = spark.createDataFrame([(3, 2), (2, 1), (4, 4), (77, 1)], "src_id long, dst_id long")
    once = identity.merge_persons(merge_input(spark), moves)
    assert dicts(once["person"], "id") == [{"id": 1, "display_name": "A", "avatar_src": None}, {"id": 4, "display_name": "D", "avatar_src": None}]
    assert {(r.value, r.person_id) for r in once["handle"].collect()} == {("h2", 1), ("h3", 1)}
    assert {(r.value, r.person_id) for r in once["person_alias"].collect()} == {("B", 1), ("bee", 1), ("C", 1)}
    assert {(r.chat_id, r.person_id) for r in once["chat_participant"].collect()} == {(9, 1), (8, 1)}
    assert [r.sender_person_id for r in once["message"].orderBy("id").collect()] == [1, 1, 4, None]
    assert once["device"].first().owner_person_id == 1
    assert state(identity.merge_persons(once, moves)) == state(once)


def test_people_map(spark):
    entries = spark.createDataFrame([("+49 1-1", "New"), ("+491 1", "Other"), ("b@x", "A"), ("c@x", "new")], "handle string, name string")
    found = identity.migrate_people(entries, people(spark, (1, "A")), pairs(spark, ("b@x", 9)), pairs(spark, ("aka", 1)))
    rows = {r.handle: (r.is_new, r.person_id) for r in found.links.collect()}
    assert rows["b@x"] == (False, 9) and rows["+49 1-1"][0] and rows["+49 1-1"][1] == rows["c@x"][1]
    assert {r.value for r in found.new_handles.collect()} == {"+4911", "c@x"}
    assert {r.display_name.lower() for r in found.new_persons.collect()} == {"new", "other"}


def test_owner_aliases():
    assert identity.parse_owner_aliases("Alice:Alice Example, Bob: Bob Smith,,x,:y,z:") == {"Alice": "Alice Example", "Bob": "Bob Smith"}


def test_vcard_fields(spark):
    text = ("BEGIN:VCARD\nN:Doe;Jane;;Dr;\nFN:Jane\\, Doe\nORG:Acme\\; Inc;;\nTEL;type=HOME:1\nTEL:2\nEMAIL:a@b\nNOTE:line\\none\n"
            "URL:https://maps.apple.com/?ll=48.1,\n -11.5&q=x\nEND:VCARD")
    row = vcards.parse(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.full_name, row.org, row.tel, row.email, row.lat, row.lng) == ("Jane, Doe", "Acme; Inc", ["1", "2"], ["a@b"], "48.1", "-11.5")
    row = vcards.parse(spark.createDataFrame([("N:Doe;Jane;;Dr;",)], "text string")).first()
    assert (row.full_name, row.tel, row.url, row.lat) == ("Dr Jane Doe", [], None, None)


def test_cycles_of_any_length_raise(spark):
    persons = spark.createDataFrame([(k, f"p{k}", None) for k in range(1, 9)], "id long, display_name string, avatar_src string")
    for n in (2, 3, 5):
        loop = spark.createDataFrame([(k, k % n + 1) for k in range(1, n + 1)], "src_id long, dst_id long")
        with pytest.raises(ValueError, match="cycle"):
            identity.settle_merges(loop, persons)
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 8)] + [(8, 99)], "src_id long, dst_id long")
    assert {r.dst_id for r in identity.settle_merges(chain, persons).collect()} == {8}
