"""What the readers rely on in each vendor store.

Per table: required columns with storage class, known optional columns, and whether any other column is
reported. Version numbers and allow-lists of enumerated columns follow.
"""

CORE_DATA = ["Z_ENT", "Z_OPT"]

WHATSAPP_SOURCE, WHATSAPP_VERSION = "whatsapp_live", 1
WHATSAPP_TABLES = {
    "ZWAMESSAGE": (
        {"Z_PK": "INTEGER", "ZSTANZAID": "TEXT", "ZMESSAGEDATE": "NUMERIC", "ZFROMJID": "TEXT",
         "ZISFROMME": "INTEGER", "ZCHATSESSION": "INTEGER", "ZMESSAGETYPE": "INTEGER"},
        ["ZTEXT", "ZSENTDATE", "ZTOJID", "ZMEDIAITEM", "ZGROUPMEMBER", "ZPARENTMESSAGE", "ZGROUPEVENTTYPE",
         "ZPUSHNAME", "ZSTARRED", "ZMESSAGESTATUS", "ZSORT", "ZMESSAGEINFO", "ZSPOTLIGHTSTATUS",
         "ZMESSAGEERRORSTATUS", "ZMEDIASECTIONID", "ZFLAGS", "ZPHASH", *CORE_DATA],
        True),
    "ZWACHATSESSION": (
        {"Z_PK": "INTEGER", "ZCONTACTJID": "TEXT", "ZSESSIONTYPE": "INTEGER"},
        ["ZPARTNERNAME", "ZGROUPINFO", "ZLASTMESSAGEDATE", "ZLASTMESSAGETEXT", "ZARCHIVED", "ZHIDDEN", "ZREMOVED",
         "ZUNREADCOUNT", "ZMESSAGECOUNTER", "ZCONTACTIDENTIFIER", *CORE_DATA],
        True),
    "ZWAMEDIAITEM": (
        {"Z_PK": "INTEGER", "ZMESSAGE": "INTEGER"},
        ["ZMEDIALOCALPATH", "ZTHUMBNAILLOCALPATH", "ZXMPPTHUMBPATH", "ZFILESIZE", "ZMOVIEDURATION", "ZVCARDSTRING",
         "ZVCARDNAME", "ZLATITUDE", "ZLONGITUDE", "ZTITLE", "ZMEDIAURL", "ZMEDIAKEY", "ZMETADATA", "ZASPECTRATIO",
         *CORE_DATA],
        True),
    "ZWAGROUPMEMBER": (
        {"Z_PK": "INTEGER", "ZMEMBERJID": "TEXT"},
        ["ZCHATSESSION", "ZCONTACTNAME", "ZFIRSTNAME", "ZCONTACTIDENTIFIER", "ZISADMIN", "ZISACTIVE", *CORE_DATA],
        True),
}

APPLE_LIVE, APPLE_BACKUP, APPLE_VERSION = "imessage_live", "imessage_backup", 1
APPLE_TABLES = {
    "message": (
        {"ROWID": "INTEGER", "guid": "TEXT", "text": "TEXT", "attributedBody": "BLOB", "handle_id": "INTEGER",
         "date": "INTEGER", "is_from_me": "INTEGER", "cache_has_attachments": "INTEGER",
         "associated_message_type": "INTEGER", "associated_message_guid": "TEXT", "balloon_bundle_id": "TEXT",
         "message_summary_info": "BLOB"},
        ["date_edited", "date_retracted", "service", "subject", "account", "account_guid", "error", "date_read",
         "date_delivered", "is_delivered", "is_read", "is_sent", "is_audio_message", "is_spam", "item_type",
         "group_title", "group_action_type", "expressive_send_style_id", "thread_originator_guid",
         "thread_originator_part", "payload_data", "share_status", "share_direction", "reply_to_guid",
         "destination_caller_id"],
        False),
    "chat": (
        {"ROWID": "INTEGER", "chat_identifier": "TEXT", "service_name": "TEXT", "display_name": "TEXT",
         "style": "INTEGER"},
        ["guid", "state", "room_name", "group_id", "is_archived", "last_addressed_handle",
         "last_read_message_timestamp", "original_group_id"],
        False),
    "handle": (
        {"ROWID": "INTEGER", "id": "TEXT"},
        ["country", "service", "uncanonicalized_id", "person_centric_id"],
        True),
    "attachment": (
        {"ROWID": "INTEGER", "filename": "TEXT", "mime_type": "TEXT", "transfer_name": "TEXT", "is_sticker": "INTEGER"},
        ["uti", "emoji_image_short_description", "guid", "created_date", "total_bytes", "is_outgoing",
         "hide_attachment", "original_guid"],
        False),
    "chat_message_join": ({"chat_id": "INTEGER", "message_id": "INTEGER"}, ["message_date"], True),
    "message_attachment_join": ({"message_id": "INTEGER", "attachment_id": "INTEGER"}, [], True),
}

# Message codes of the WhatsApp store and the kind each stands for.
MESSAGE_KINDS = {
    0: "text", 1: "image", 2: "video", 3: "audio", 4: "contact", 5: "location", 6: "call", 7: "system",
    8: "file", 10: "sticker", 15: "gif", 14: "deleted", 46: "media", 54: "media", 59: "media", 66: "media",
}
MIME_BY_KIND = {"image": "image/jpeg", "video": "video/mp4", "audio": "audio/ogg", "sticker": "image/webp",
                "gif": "video/mp4", "file": "application/octet-stream"}
LABEL_BY_KIND = {"image": "🖼️ Image", "video": "🎬 Video", "audio": "🎤 Voice message", "sticker": "🃏 Sticker",
                 "gif": "🎞️ GIF", "file": "📎 Document"}
LOCATION_LABEL, CONTACT_LABEL, CALL_LABEL = "📍 Location", "👤 Contact card", "📞 Call"
GROUP_SESSION = 1
DIRECT_STYLE = 45

# Allow-lists: (table, column) to the values the readers know.
WHATSAPP_ENUMS = {
    ("ZWAMESSAGE", "ZMESSAGETYPE"): sorted(MESSAGE_KINDS),
    ("ZWACHATSESSION", "ZSESSIONTYPE"): [0, 1, 2, 3],
    ("ZWAMESSAGE", "ZGROUPEVENTTYPE"): [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12],
}
APPLE_ENUMS = {
    ("chat", "style"): [43, 45],
    ("message", "associated_message_type"): [
        0, 2000, 2001, 2002, 2003, 2004, 2005, 3000, 3001, 3002, 3003, 3004, 3005],
}

# Storage class by declared SQLite type; any other type stands for itself.
STORAGE_CLASSES = {
    "INT": "INTEGER", "INTEGER": "INTEGER", "TINYINT": "INTEGER", "SMALLINT": "INTEGER",
    "MEDIUMINT": "INTEGER", "BIGINT": "INTEGER", "BOOL": "INTEGER", "BOOLEAN": "INTEGER",
    "REAL": "REAL", "DOUBLE": "REAL", "FLOAT": "REAL",
    "NUMERIC": "NUMERIC", "DECIMAL": "NUMERIC", "DATE": "NUMERIC", "TIMESTAMP": "NUMERIC",
    "TEXT": "TEXT", "VARCHAR": "TEXT", "CHAR": "TEXT", "CLOB": "TEXT",
    "BLOB": "BLOB",
}
UNTYPED = "BLOB"


def storage_class(declared: str | None) -> str:
    """Coarse class of one declared type."""
    bare = (declared or "").split("(")[0].strip().upper()
    return STORAGE_CLASSES.get(bare, bare or UNTYPED)
