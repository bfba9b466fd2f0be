"""Merkle manifest of a table: a content-addressed graph of digests, and proofs that lead from each row to the root.

Every row is a leaf, ``H`` (lowercase hex sha256) of its encoded columns. Leaves of a group stand in the order of their key;
while several nodes remain, each run of ``FAN`` becomes ``H`` of its digests. What remains is the group's root. The group
roots, in the order of the group, are the leaves of one tree more, whose root stands for the whole table.

The graph is stored as records (digest, children), in packs: a pack holds the records of a subtree of ``LEVELS`` levels under
the digest of its root, so that a walk of that many levels reads one row. Packs are built bottom up, one job per ``LEVELS``
levels. Requests for proofs start at the root: the digits of a leaf's rank, base ``FAN``, say which child to follow, and the
children passed by are collected. The requests of all leaves below a node travel as one row until they reach the pack those
leaves hang on; only there each leaf takes its own last steps. The collected segments run from the root down; a proof is
their reverse. Packs and requests meet by digest in a plain join, whose skew Spark splits.

Encoding: ``-`` for null, else the UTF-8 byte count, a colon and the value; integers in decimal. A null text is ``-`` and an
empty one ``0:``, which differ. Groups: null first, then by UTF-8 bytes. Leaves of a group: null keys first; rows with equal
keys stand in the order of their digests; repeated rows are leaves of their own, with a proof each. Texts of any length are
hashed whole. An empty table has no root and gives no rows. Columns that are not named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import key_hash, materialise

FAN = 3
LEVELS = 5
PACK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

RECORDS = "array<struct<digest: string, children: array<string>>>"
PATH = "array<struct<place: int, siblings: array<string>>>"
RECORD_TYPE = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))


def encoded(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256)


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


@dataclass
class Manifest:
    """``leaves``: group, rank, key, leaf and what was carried; ``packs`` and ``top_packs``: the records of the group trees and
    of the tree above them; ``groups``: group, place, size, subroot; ``root``: None for an empty table."""

    leaves: DataFrame
    packs: DataFrame
    groups: DataFrame
    top_packs: DataFrame
    root: str | None


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``rank``, 0 ... within the group, along the order.

    Rows are range-sorted once by group and order, whatever share of them one group has, numbered within the partitions that
    result, and the partitions' counts are added up per group. Equal rows are told apart by their place in the input, so that
    they spread as well. The sorted rows are written before they are numbered.
    """
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    spread = materialise(salted.repartitionByRange(group, *order, "_salt").withColumn("_part", F.spark_partition_id()), "merkle-sorted")
    counts = spread.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(group).orderBy("_part")
    before = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(group, "_part").orderBy(*order, "_salt")
    return (spread.withColumn("_in", F.row_number().over(inside) - 1)
            .join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
            .select(*rows.columns, (F.col("_before") + F.col("_in")).cast("long").alias("rank")))


def subtree(digests: Sequence[str], levels: int | None) -> tuple[str, list[tuple[str, list[str]]], int]:
    """Root, records and height above consecutive nodes: of ``levels`` levels, or until one node remains."""
    nodes, records, height = list(digests), {}, 0
    while len(nodes) > 1 if levels is None else height < levels:
        runs = [nodes[a:a + FAN] for a in range(0, len(nodes), FAN)]
        nodes = list(map(joined, runs))
        records.update(zip(nodes, runs))
        height += 1
    return nodes[0], list(records.items()), height


def layer_size(level: int) -> Column:
    """Nodes of a group of ``size`` leaves above ``level`` rounds of packs."""
    return F.ceil(F.col("size") / F.lit(float(PACK ** level))).cast("long")


def graph(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """Packs above the leaves (group, rank, digest, size), a table for each round; groups of one leaf have none."""
    kind = leaves.schema["group"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [subtree(d, None if last else LEVELS) for d, last in zip(batch.column("digests").to_pylist(), batch.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("rank"), pa.array([r for r, _, _ in made], pa.string()), batch.column("size"),
                 pa.array([h for _, _, h in made], pa.int32()),
                 pa.array([[{"digest": d, "children": c} for d, c in records] for _, records, _ in made], RECORD_TYPE)],
                ["group", "rank", "digest", "size", "height", "records"])

    rounds, layer = [], leaves
    while largest > PACK ** len(rounds):
        here = layer_size(len(rounds))
        runs = (layer.filter(here > 1).groupBy("group", F.floor(F.col("rank") / PACK).cast("long").alias("rank"))
                .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"), F.max("size").alias("size"))
                .select("group", "rank", "size", F.col("nodes.digest").alias("digests"), (here <= PACK).alias("last")))
        out = f"group {kind}, rank long, digest string, size long, height int, records {RECORDS}"
        layer = materialise(runs.mapInArrow(build, out), "merkle-packs")
        rounds.append(layer)
    return rounds


def _tops(leaves: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """group, size and subroot: the last node of each group."""
    found = leaves.filter("size = 1").select("group", "size", F.col("digest").alias("subroot"))
    for k, packs in enumerate(rounds):
        found = found.unionByName(packs.filter(layer_size(k + 1) == 1).select("group", "size", F.col("digest").alias("subroot")))
    return found


def _records(rounds: list[DataFrame], empty: DataFrame) -> DataFrame:
    """One table of all packs; ``level`` is the round that made them."""
    made = empty.select("group", "rank", "digest", "size", F.lit(0).alias("height"), F.lit(None).cast(RECORDS).alias("records"),
                        F.lit(0).alias("level")).limit(0)
    for k, packs in enumerate(rounds):
        made = made.unionByName(packs.withColumn("level", F.lit(k)))
    return made


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source",
             carry: dict[str, Column] | None = None) -> Manifest:
    """Hash and order the rows and store the graph; ``carry`` adds small columns to the leaves."""
    extra = carry or {}
    hashed = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("leaf"),
                         *(c.alias(name) for name, c in extra.items()))
    leaves = materialise(ranked(materialise(hashed, "merkle-leaves"), "group", ["key", "leaf"]), "merkle-ranks")
    sizes = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    nodes = leaves.join(sizes.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group"))).select(
        "group", "rank", F.col("leaf").alias("digest"), "size")
    rounds = graph(nodes, sizes.agg(F.max("size")).first()[0] or 0)
    groups = materialise(ranked(_tops(nodes, rounds).withColumn("_all", F.lit(0)), "_all", ["group"]).drop("_all")
                         .withColumnRenamed("rank", "place"), "merkle-groups")
    count = groups.count()
    above = groups.select(F.lit(0).alias("group"), F.col("place").alias("rank"), F.col("subroot").alias("digest"), F.lit(count).cast("long").alias("size"))
    top = graph(above, count)
    root = _tops(above, top).first()
    return Manifest(leaves, _records(rounds, nodes), groups, _records(top, above), root["subroot"] if root else None)


def digits(rank: int, height: int) -> list[int]:
    """The digits of a rank, base FAN, the most significant first."""
    return [rank // FAN ** k % FAN for k in range(height - 1, -1, -1)]


class Paths:
    """Path segments of many requests, laid out flat."""

    def __init__(self):
        self.places, self.kept, self.siblings, self.sizes = [], [], [], []

    def add(self, upper: list[dict], children: dict[str, list[str]], digest: str, turns: Sequence[int]) -> str:
        """Follow the turns down from a digest behind an upper path; the children passed by are kept."""
        for segment in upper:
            self.places.append(segment["place"])
            self.kept.append(len(segment["siblings"]))
            self.siblings += segment["siblings"]
        for turn in turns:
            run = children[digest]
            self.places.append(turn)
            self.kept.append(len(run) - 1)
            self.siblings += run[:turn] + run[turn + 1:]
            digest = run[turn]
        self.sizes.append(len(upper) + len(turns))
        return digest

    def array(self) -> pa.Array:
        def ends(sizes: list[int]) -> pa.Array:
            return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())

        siblings = pa.ListArray.from_arrays(ends(self.kept), pa.array(self.siblings, pa.string()))
        segments = pa.StructArray.from_arrays([pa.array(self.places, pa.int32()), siblings], ["place", "siblings"])
        return pa.ListArray.from_arrays(ends(self.sizes), segments)


def _repeated(column: pa.Array, times: list[int]) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(times)), times), pa.int64()))


def descended(requests: DataFrame, packs: DataFrame, level: int) -> DataFrame:
    """Take requests (group, size, rank, digest, path, subroot) at the roots of packs of a level down to all nodes at their feet."""
    width = F.least(F.lit(PACK).cast("long"), layer_size(level) - F.col("rank") * PACK).cast("int").alias("width")
    store = packs.filter(F.col("level") == level).select("digest", "height", "records").dropDuplicates(["digest", "height"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.select(["rank", "digest", "path", "width", "height", "records"]).to_pylist()[0]
                children, n, paths = {r["digest"]: r["children"] for r in row["records"]}, row["width"], Paths()
                reached = [paths.add(row["path"], children, row["digest"], digits(k, row["height"])) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [_repeated(one.column("group"), [n]), _repeated(one.column("size"), [n]), pa.array(np.arange(n) + row["rank"] * PACK, pa.int64()),
                     pa.array(reached, pa.string()), paths.array(), _repeated(one.column("subroot"), [n])],
                    ["group", "size", "rank", "digest", "path", "subroot"])

    asked = requests.select("group", "size", "rank", "digest", "path", "subroot", width).join(store, "digest")
    kind = requests.schema["group"].dataType.simpleString()
    return asked.mapInArrow(walk, f"group {kind}, size long, rank long, digest string, path {PATH}, subroot string")


def rounds_of(size: Column) -> Column:
    """Rounds of packs above a group of so many leaves."""
    needed, reach = F.lit(0), 1
    while reach < 1 << 62:
        needed = needed + (size > reach).cast("int")
        reach *= PACK
    return needed


def proofs(made: Manifest) -> DataFrame:
    """A row per leaf: key, group, rank, leaf, carried columns, subroot, root, and proof from the leaf up to the root."""
    carried = [c for c in made.leaves.columns if c not in ("group", "key", "leaf", "rank")]
    fields = ["rank", "key", "leaf", *carried]
    blank = F.lit(None).cast(PATH)
    top_rounds = made.top_packs.agg(F.max("level")).first()[0]
    request = made.groups.select(F.lit(0).alias("group"), F.lit(1).cast("long").alias("size")).limit(0)
    request = made.leaves.sparkSession.createDataFrame([(0, made.groups.count(), 0, made.root)], "group int, size long, rank long, digest string")
    request = request.withColumns({"path": F.array().cast(PATH), "subroot": F.lit("")}).filter(F.col("digest").isNotNull())
    for level in range(-1 if top_rounds is None else top_rounds, -1, -1):
        request = materialise(descended(request, made.top_packs, level), "merkle-requests")
    # From here each group has a request of its own, at its subroot.
    starts = (request.select(F.col("rank").alias("place"), "digest", "path").join(made.groups, "place")
              .select("group", "size", F.lit(0).cast("long").alias("rank"), "digest", "path", "subroot"))
    starts = materialise(starts.withColumn("rounds", rounds_of(F.col("size"))), "merkle-requests")
    current = starts.drop("rounds").limit(0)
    for level in range(made.packs.agg(F.max("level")).first()[0] or 0, 0, -1):
        ready = current.unionByName(starts.filter(F.col("rounds") == level + 1).drop("rounds"))
        current = materialise(descended(ready, made.packs, level), "merkle-requests")
    last = current.unionByName(starts.filter(F.col("rounds") <= 1).drop("rounds"))
    # At the last packs the leaves come in, at most PACK to a row.
    hung = (made.leaves.groupBy(F.col("group").alias("_group"), F.floor(F.col("rank") / PACK).cast("long").alias("_pack"))
            .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("leaves")))
    store = made.packs.filter("level = 0").select("digest", "height", "records").dropDuplicates(["digest", "height"])
    # A group of one leaf has no pack: its request has arrived.
    alone, rest = last.filter("size = 1"), last.filter("size > 1").join(store, "digest")
    bare = alone.withColumns({"height": F.lit(0), "records": F.array().cast(RECORDS)})
    met = (rest.unionByName(bare).join(hung, F.col("group").eqNullSafe(F.col("_group")) & (F.col("rank") == F.col("_pack")))
           .select("group", "rank", "digest", "path", "height", "records", "subroot", "leaves"))
    kinds = {f.name: f.dataType.simpleString() for f in made.leaves.schema}
    names = ["group", "subroot", *fields, "path"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.select(["digest", "path", "height", "records"]).to_pylist()[0]
                children, paths = {r["digest"]: r["children"] for r in row["records"]}, Paths()
                leaves = one.column("leaves").flatten()
                n = len(leaves)
                reached = [paths.add(row["path"], children, row["digest"], digits(k, row["height"])) for k in range(n)]
                assert reached == leaves.field("leaf").to_pylist()
                yield pa.RecordBatch.from_arrays([_repeated(one.column("group"), [n]), _repeated(one.column("subroot"), [n]),
                                                  *(leaves.field(f) for f in fields), paths.array()], names)

    schema = ", ".join([f"`{n}` {kinds[n] if n in kinds else PATH if n == 'path' else 'string'}" for n in names])
    return (met.mapInArrow(finish, schema).withColumn("proof", F.reverse("path")).drop("path")
            .withColumn("root", F.lit(made.root)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def up(digest: Column, segment: Column) -> Column:
        place, others = segment["place"], segment["siblings"]
        return F.sha2(F.concat(F.array_join(F.slice(others, 1, place), ""), digest,
                               F.array_join(F.slice(others, place + 1, F.size(others)), "")).cast("binary"), 256)
    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """H of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "").cast("binary"), 256)


def tampered(text: str = "text", key: str = "doc_id") -> Column:
    """The text as a careless copy would leave it: every second id loses its line feeds. Null ids stay as they are."""
    hit = F.col(key).isNotNull() & (key_hash(key) % 2 == 0)
    return F.when(hit, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def proof_checks(docs: DataFrame) -> DataFrame:
    """Per document its leaf, roots, proof digest, and whether its tampered text still leads to the root."""
    seen = leaf_digest([tampered() if f == "text" else F.col(f) for f in FIELDS])
    found = proofs(manifest(docs, carry={"seen": seen}))
    return (found.withColumn("folded_root", folded(F.col("seen"), F.col("proof")))
            .select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))
