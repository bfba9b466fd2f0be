"""Row types of the canonical message and of the stored archive."""

from __future__ import annotations

from pyspark.sql import types as T

EDIT = "struct<text:string,ts:bigint>"
REACTION = "struct<emoji:string,label:string,sender:string,ts:bigint>"
ATTACHMENT = "struct<source_ref:string,mime:string,filename:string,is_sticker:boolean,emoji_desc:string>"

CANONICAL_DDL = f"""
    source string, chat_external_id string, external_id string, ts bigint, sender_raw string,
    is_me boolean, text string, retracted boolean, edits array<{EDIT}>, reactions array<{REACTION}>,
    apps array<string>, attachments array<{ATTACHMENT}>
"""
CHAT_SPEC_DDL = """
    slug string, title string, source_id string, subtitle string, is_group boolean, origin string
"""
EVENT_COLUMNS = [
    "source", "schema_version", "severity", "kind", "table_name", "column_name", "observed", "expected", "detail", "seen_at",
]
CANONICAL_COLUMNS = [
    "source", "chat_external_id", "external_id", "ts", "sender_raw", "is_me", "text", "retracted",
    "edits", "reactions", "apps", "attachments",
]


# The types the Arrow UDFs return.
EDIT_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("ts", T.LongType())])
HISTORY_TYPE = T.StructType([T.StructField("edits", T.ArrayType(EDIT_TYPE)), T.StructField("error", T.StringType())])
DIFF_TYPE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))


# Stored tables. Facts carry a bucket column on disk besides these.
ARCHIVE_DDL = {
    "person": "id bigint, display_name string, avatar_src string",
    "handle": "value string, person_id bigint",
    "person_alias": "value string, person_id bigint",
    "device": "id bigint, slug string, name string, type string, owner_person_id bigint",
    "chat": "id bigint, slug string, device_id bigint, title string, subtitle string, is_group boolean, origin string",
    "chat_source": "chat_id bigint, source string, external_id string",
    "chat_participant": "chat_id bigint, person_id bigint",
    "message": f"id bigint, chat_id bigint, sender_person_id bigint, ts bigint, is_me boolean, text string, retracted boolean, "
               f"edits array<{EDIT}>, reactions array<{REACTION}>, apps array<string>, media_status string, sync_state string, "
               f"source string, external_id string",
    "source_ref": "message_id bigint, source string, external_id string",
    "attachment": "message_id bigint, position int, source_ref string, mime string, filename string, is_sticker boolean, emoji_desc string",
    "high_water": "table_name string, id bigint",
    "media": "id bigint, message_id bigint, kind string, src string, cat string, portrait boolean, bytes bigint, content_hash string",
}


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(ddl.split()))


# Fixed values of the stored archive.
VISIBLE_MEDIA_STATUS = ("ready", "none")
MEDIA_KINDS = ("image", "video", "audio", "other")
MISSING_ATTACHMENT_LABEL = "📎 Anhang fehlt"
APPLE_LIVE_PREFIX = "imessage_live:"
PAGE_DEFAULT, PAGE_MAX = 50, 500
AROUND_BEFORE, AROUND_AFTER = 40, 80
