"""JSON inputs: the source configuration, exported chats and the recognition caches.

Each reader has a form that takes documents (``doc``) already at hand and one that reads files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import choose
from parlance.model import EDIT, REACTION, schema

# Fixed value: adapter of old list entries by service.
DEFAULT_ADAPTER = {"apple": "imessage_live"}
DEFAULT_ORIGIN, DEFAULT_ME = "apple", "Me"

CONFIG = """
    devices array<struct<type:string,id:string,slug:string,name:string,me_name:string,db:string,backup:string,chats:array<string>>>,
    people map<string,string>
"""
CHAT_OBJECT = "struct<slug:string,title:string,subtitle:string,is_group:boolean,origin:string,source:string,source_id:string>"
CHAT_JSON = f"""
    slug string, title string, subtitle string, is_group boolean, me_name string, origin string, device string, device_id string,
    messages array<struct<t:string,ts:bigint,me:boolean,sender:string,text:string,
        media:array<struct<kind:string,src:string,cat:string,portrait:boolean>>,apps:array<string>,
        edits:array<{EDIT}>,reactions:array<{REACTION}>,retracted:boolean>>
"""
TRANSCRIPT = "map<string,struct<text:string,lang:string,prob:double,note:string,error:string>>"
OCR = "map<string,struct<text:string,lines:bigint,is_screenshot:boolean,error:string>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", "doc")


# --- configuration ----------------------------------------------------------------------------------


def config_devices(docs: DataFrame) -> DataFrame:
    """Devices with their place in the configuration."""
    rows = docs.select(F.from_json("doc", schema(CONFIG)).alias("c"))
    return rows.select(F.posexplode("c.devices").alias("position", "d")).select(
        "position", "d.slug", "d.name", "d.type", F.coalesce("d.me_name", F.lit(DEFAULT_ME)).alias("me_name"), "d.id", "d.db",
        "d.backup", "d.chats")


def config_chats(docs: DataFrame) -> DataFrame:
    """Chats of all devices; an entry is an object or the older list
    [id, title, subtitle, slug, is_group, origin?]."""
    items = config_devices(docs).select(
        F.col("slug").alias("device_slug"), F.col("position").alias("device_position"), F.posexplode("chats").alias("position", "item"))
    old = F.startswith(F.trim("item"), F.lit("["))
    rows = items.withColumns({
        "_o": F.when(~old, F.from_json("item", CHAT_OBJECT)), "_t": F.when(old, F.from_json("item", "array<string>"))})

    def at(k: int) -> Column:
        return F.get("_t", F.lit(k))

    origin = F.coalesce("_o.origin", at(5), F.lit(DEFAULT_ORIGIN))
    slug = F.coalesce("_o.slug", at(3))
    listed_id = at(0)
    return rows.select(
        "device_slug", "device_position", "position", slug.alias("slug"), F.coalesce("_o.title", at(1), slug).alias("title"),
        F.coalesce("_o.subtitle", at(2)).alias("subtitle"),
        F.coalesce("_o.is_group", at(4) == "true", F.lit(False)).alias("is_group"), origin.alias("origin"),
        F.coalesce("_o.source", F.when(listed_id.isNotNull(), choose(origin, DEFAULT_ADAPTER))).alias("source"),
        F.coalesce("_o.source_id", listed_id).alias("source_id"))


def config_people(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.from_json("doc", schema(CONFIG))["people"]).alias("handle", "name"))


# --- exported chats -----------------------------------------------------------------------------------


def read_chat_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema(CHAT_JSON)).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def parse_chats(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("doc", schema(CHAT_JSON)).alias("c")).select("c.*")


def chat_rows(chats: DataFrame) -> DataFrame:
    return chats.select("slug", F.coalesce("title", "slug").alias("title"), "subtitle",
                        F.coalesce("is_group", F.lit(False)).alias("is_group"), F.coalesce("origin", F.lit(DEFAULT_ORIGIN)).alias("origin"))


def message_rows(chats: DataFrame, owners: DataFrame) -> DataFrame:
    """Messages in file order; the device owner (``device_slug``, ``owner_name``) stands for 'me'."""
    rows = chats.select("slug", F.posexplode("messages").alias("position", "m"))
    device = F.substring_index("slug", "/", 1)
    me = F.coalesce("m.me", F.lit(False))
    return rows.withColumn("device_slug", device).join(owners, "device_slug", "left").select(
        "slug", "position", "m.ts", me.alias("is_me"), F.when(me, F.col("owner_name")).otherwise(F.col("m.sender")).alias("sender"),
        "m.text", F.coalesce("m.retracted", F.lit(False)).alias("retracted"), "m.edits", "m.reactions", "m.apps",
        F.when(F.size("m.media") > 0, "ready").otherwise("none").alias("media_status"))


def media_rows(chats: DataFrame) -> DataFrame:
    rows = chats.select("slug", F.posexplode("messages").alias("position", "m"))
    return rows.select("slug", "position", F.posexplode("m.media").alias("item", "x")).select(
        "slug", "position", "item", "x.kind", "x.src", "x.cat", F.coalesce("x.portrait", F.lit(False)).alias("portrait"))


# --- recognition caches ---------------------------------------------------------------------------------


def transcripts(docs: DataFrame) -> DataFrame:
    return _cache(docs, TRANSCRIPT).select("src", "v.text", "v.lang", "v.prob", "v.note", "v.error")


def ocr(docs: DataFrame) -> DataFrame:
    return _cache(docs, OCR).select("src", "v.text", "v.lines", F.coalesce("v.is_screenshot", F.lit(False)).alias("is_screenshot"), "v.error")


def _cache(docs: DataFrame, kind: str) -> DataFrame:
    return docs.select(F.explode(F.from_json("doc", kind)).alias("src", "v"))
