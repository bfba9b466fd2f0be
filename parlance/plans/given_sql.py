"""SQL views that state the projections of ``given`` and ``vendor`` for the checks."""

CTES = {
    "person": """
        SELECT c_custkey AS id, c_name AS display_name,
               CASE WHEN c_custkey % 3 = 0
                    THEN 'media/avatars/' || (c_custkey % 16) || '/' || c_custkey || '.png' END AS avatar_src
        FROM customer""",
    "handle": """
        SELECT '+49170' || lpad(c_custkey::varchar, 7, '0') AS value, c_custkey AS person_id
        FROM customer WHERE c_custkey % 4 <> 3
        UNION ALL
        SELECT 'c' || c_custkey || '@example.org', c_custkey FROM customer
        WHERE c_custkey % 4 <> 3 AND c_custkey % 5 = 0""",
    "person_alias": """
        SELECT 'ALSO  ' || upper(c_name) AS value, c_custkey AS person_id FROM customer WHERE c_custkey % 2 = 0""",
    "device": """
        SELECT n_nationkey::bigint AS id, 'dev' || n_nationkey AS slug, n_name AS name,
               CASE n_nationkey % 4 WHEN 0 THEN 'mac_live' WHEN 1 THEN 'ios_backup'
                    WHEN 2 THEN 'iphone_backup' ELSE 'static' END AS type,
               n_nationkey::bigint AS owner_person_id
        FROM nation""",
    "chat": """
        SELECT c_custkey AS id, 'dev' || c_nationkey || '/chat_' || c_custkey AS slug,
               c_nationkey::bigint AS device_id, c_name AS title, c_custkey % 5 = 0 AS is_group,
               CASE WHEN c_custkey % 2 = 0 THEN 'apple' ELSE 'whatsapp' END AS origin
        FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "chat_source": """
        SELECT id AS chat_id,
               CASE WHEN (origin = 'apple') <> (id % 37 = 0) THEN 'imessage_live:dev' ELSE 'whatsapp_live:dev' END
               || device_id AS source, id::varchar AS external_id
        FROM chat""",
    "message": """
        SELECT e.event_id AS id, e.user_id AS chat_id,
               CASE WHEN e.event_id % 2 = 1 THEN c.c_nationkey::bigint
                    WHEN e.user_id % 5 = 0 THEN e.user_id + e.event_id % 3 ELSE e.user_id END AS sender_person_id,
               cast(floor(epoch(e.ts)) AS bigint) AS ts, e.event_id % 2 = 1 AS is_me,
               CASE WHEN e.event_id % 11 <> 0 THEN d.text END AS text,
               e.event_type = 'error' AND e.event_id % 10 = 3 AS retracted,
               CASE WHEN e.event_id % 34 = 0 THEN 1 WHEN e.event_id % 17 = 0 THEN 2 END AS n_edits,
               CASE WHEN e.event_id % 23 = 0 THEN '📲 App message' END AS app,
               CASE e.event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'ready' ELSE 'none' END AS media_status,
               CASE WHEN e.event_id % 20 = 0 THEN 'new' ELSE 'published' END AS sync_state
        FROM events e JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN documents d ON d.doc_id = e.event_id""",
    "visible_message": """
        SELECT * FROM message WHERE media_status IN ('ready', 'none')""",
    "source_ref": """
        SELECT e.event_id AS message_id,
               CASE WHEN (e.user_id % 2 = 0) <> (e.user_id % 41 = 0) THEN 'imessage_live:dev' ELSE 'whatsapp_live:dev' END
               || c.c_nationkey AS source, e.event_id::varchar AS external_id
        FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    "media": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS message_id,
               CASE l_linenumber % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'video'
                    WHEN 3 THEN 'audio' ELSE 'file' END AS kind,
               CASE WHEN l_partkey % 50 <> 0
                    THEN 'media/' || ((l_partkey * 7 + l_linenumber) % 100) || '/' || (l_partkey * 7 + l_linenumber) END AS src,
               CASE WHEN l_linenumber % 5 <= 1 THEN
                    CASE WHEN l_partkey % 7 = 0 THEN 'sticker' WHEN l_partkey % 11 = 0 THEN 'emoji'
                         WHEN l_partkey % 13 = 0 THEN 'photo' ELSE 'foto' END END AS cat,
               l_partkey % 3 = 0 AS portrait, cast(floor(l_extendedprice) AS bigint) AS bytes,
               'h' || (l_partkey * 7 + l_linenumber) AS content_hash
        FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM events)""",
    "transcript": """
        SELECT 'media/' || ((doc_id * 9 + 1) % 100) || '/' || (doc_id * 9 + 1) AS src, text, lang,
               (doc_id % 100) / 100.0::double AS prob, CASE WHEN doc_id % 53 = 0 THEN 'decoder failed' END AS error
        FROM documents""",
    "ocr": """
        SELECT 'media/' || ((doc_id * 9 + 1) % 100) || '/' || (doc_id * 9 + 1) AS src,
               CASE WHEN doc_id % 3 <> 0 THEN text END AS text,
               len(string_split(text, chr(10)))::bigint AS lines, doc_id % 6 = 1 AS is_screenshot,
               CASE WHEN doc_id % 59 = 0 THEN 'engine failed' END AS error
        FROM documents""",
    "drift_event_in": """
        SELECT CASE user_id % 3 WHEN 0 THEN 'imessage_live' WHEN 1 THEN 'whatsapp_live' ELSE 'whatsapp_export' END AS source,
               (1 + event_id % 2)::int AS schema_version,
               CASE WHEN event_type = 'error' THEN 'fatal' ELSE 'warn' END AS severity,
               CASE event_type WHEN 'error' THEN 'missing_required_column' WHEN 'click' THEN 'unknown_enum_value'
                    WHEN 'signup' THEN 'new_column' WHEN 'purchase' THEN 'missing_optional_column'
                    ELSE 'row_parse_failed' END AS kind,
               CASE WHEN user_id % 4 <> 0 THEN 'message' END AS table_name,
               CASE WHEN user_id % 4 = 1 THEN 'col' || (user_id % 7) END AS column_name,
               CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS observed,
               'contract' AS expected, 'event ' || event_id AS detail, cast(floor(epoch(ts)) AS bigint) AS seen_at,
               event_id
        FROM events""",
    "tidy_document": """
        SELECT doc_id, regexp_replace(replace(replace(text, '￼', ''), '�', ''), '^\\s+|\\s+$', '', 'g') AS body FROM documents""",
    "apple_message": """
        SELECT e.event_id AS rowid, e.user_id AS chat_id, e.event_type,
               'U' || e.user_id || '-' || (e.event_id % 16) AS guid,
               CASE WHEN e.event_id % 7 <> 0 OR (e.event_id % 14 = 0 AND e.event_id % 3 <> 0 AND amt IN (0))
                      OR (e.event_id % 14 = 0 AND amt IS NULL)
                    THEN coalesce(t.body, 'event ' || e.event_id) ELSE '' END AS body,
               CASE WHEN e.event_id % 29 <> 0 THEN
                    CASE WHEN e.user_id % 5 = 0 THEN e.user_id + e.event_id % 3 ELSE e.user_id END END AS handle_id,
               CASE WHEN e.event_id % 101 <> 0 THEN cast(floor(epoch(e.ts)) AS bigint) END AS ts,
               e.event_id % 2 = 1 AS is_me, e.event_id % 5 = 0 AS has_files, coalesce(amt, 0) AS amt,
               'U' || e.user_id || '-' || (e.event_id * 7 % 16) AS target, (e.event_id // 9) % 9 AS bundle,
               e.event_id % 9 = 0 AS has_bundle, e.event_type = 'error' AND e.event_id % 10 = 3 AS retracted
        FROM (SELECT *, CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 2000 + event_id % 6
                             WHEN event_type = 'error' AND event_id % 4 = 0 THEN 3000 + event_id % 6
                             WHEN event_id % 37 = 0 THEN 1000 WHEN event_id % 3 <> 0 THEN 0 END AS amt FROM events) e
        LEFT JOIN tidy_document t ON t.doc_id = e.event_id""",
    "apple_handle": """
        SELECT c_custkey AS rowid, '+49170' || lpad(c_custkey::varchar, 7, '0') AS id FROM customer""",
    "apple_attachment": """
        SELECT l_orderkey AS rowid, p_partkey AS attachment_id,
               '~/Library/Messages/Attachments/' || (p_partkey % 256) || '/' || p_partkey || '.dat' AS source_ref,
               CASE p_partkey % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'application/pdf' ELSE '' END AS mime,
               'IMG_' || p_partkey || '.jpg' AS filename, p_partkey % 7 = 0 AS is_sticker,
               CASE WHEN p_partkey % 11 = 0 THEN 'Emojis' ELSE '' END AS emoji_desc
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 17 <> 0""",
    "wa_session": """
        SELECT c_custkey AS session, c_custkey % 5 = 0 AS is_group,
               CASE WHEN c_custkey % 19 <> 0 THEN c_custkey || '@s.whatsapp.net' END AS jid,
               CASE c_custkey % 3 WHEN 0 THEN ' ' || c_name WHEN 1 THEN c_custkey || '@lid' END AS partner_name
        FROM customer""",
    "wa_media": """
        SELECT pk, min(m).media_pk AS media_pk, min(m).path AS local_path, min(m).title AS media_title,
               min(m).lat AS lat, min(m).lon AS lon
        FROM (SELECT l_orderkey AS pk, {'media_pk': l_orderkey * 10 + l_linenumber,
                  'path0': coalesce(CASE WHEN l_partkey % 3 <> 0 THEN 'Media/' || l_partkey || '.bin' END, ''),
                  'title0': coalesce(CASE WHEN l_partkey % 2 = 0 THEN 'title ' || l_partkey END, ''),
                  'path': CASE WHEN l_partkey % 3 <> 0 THEN 'Media/' || l_partkey || '.bin' END,
                  'title': CASE WHEN l_partkey % 2 = 0 THEN 'title ' || l_partkey END,
                  'lat': CASE WHEN l_partkey % 4 = 0 THEN l_partkey / 100.0::double END,
                  'lon': CASE WHEN l_partkey % 4 = 0 THEN l_partkey / 50.0::double END} AS m FROM lineitem) GROUP BY pk""",
    "wa_message": """
        SELECT e.event_id AS pk, e.user_id AS session, e.event_id % 2 = 1 AS is_me,
               CASE WHEN e.event_id % 13 <> 0 THEN 'ST' || e.event_id ELSE e.event_id::varchar END AS external_id,
               CASE WHEN e.event_id % 97 <> 0 THEN cast(floor(epoch(e.ts)) AS bigint) END AS ts,
               CASE WHEN e.event_id % 3 <> 0 THEN coalesce(t.body, 'event ' || e.event_id) ELSE '' END AS body,
               CASE WHEN e.event_id % 2 = 0 THEN e.user_id || CASE WHEN e.event_id % 4 = 0 THEN '@lid' ELSE '@s.whatsapp.net' END
                    ELSE '' END AS from_jid,
               CASE WHEN e.event_id % 31 = 0 THEN 'text' ELSE
                    ['text', 'image', 'video', 'audio', 'contact', 'location', 'call', 'system', 'file', 'sticker', 'gif',
                     'deleted', 'media', 'media', 'media', 'media', 'text', 'text', 'text', 'text'][e.event_id % 20 + 1] END AS kind,
               CASE WHEN e.user_id % 5 = 0 AND e.event_id % 8 <> 0 AND e.event_id % 4 < 3
                    THEN (e.user_id + e.event_id % 4) || '@s.whatsapp.net' END AS member_jid
        FROM events e LEFT JOIN tidy_document t ON t.doc_id = e.event_id""",
    "wa_sent": """
        SELECT m.*, CASE WHEN m.is_me THEN 'Me' WHEN s.is_group THEN coalesce(m.member_jid, m.from_jid)
                    WHEN s.partner_name IS NOT NULL AND NOT contains(s.partner_name, '@') THEN trim(s.partner_name)
                    ELSE coalesce(s.jid, m.from_jid) END AS sender
        FROM wa_message m JOIN wa_session s USING (session)""",
    "turn_row": """
        SELECT conv_id, turn, role, 'conv' || conv_id AS folder,
               1709251200 + (conv_id % 500000) * 3600 + turn * 60 AS ts, conv_id * 8 + turn AS k,
               regexp_replace(regexp_replace(text, '\\p{Cf}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS body
        FROM conversations""",
    "version_pair": """
        SELECT a.conv_id, a.turn, a.text AS old, b.text AS new
        FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 AND b.role = a.role""",
}
