"""SQL that must give the rows of the operator queries, where SQL can say it.

Each statement is a plain form of its own: it looks at every word window, every character
window or every turn, where the library scans, slides or sums.
"""

from __future__ import annotations

import math

from precinct.llm import chat

WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATE = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS id, {WORDS} AS w FROM documents),
     items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
     windows AS (
       SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS passage, least(len(w), 13) AS n
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k
             FROM items WHERE len(w) > 0) AS starts),
     places AS (
       SELECT id, k, n, array_to_string(w[k:k + n - 1], ' ') AS passage
       FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
             FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows) AS sizes WHERE len(w) >= n) AS starts),
     found AS (SELECT id, k, n, item_id FROM places JOIN windows USING (passage, n)),
     hits AS (
       SELECT id, count(DISTINCT place) AS n_hit
       FROM (SELECT id, unnest(generate_series(k, k + n - 1)) AS place FROM found) AS words GROUP BY id),
     named AS (
       SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
       FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL)
       GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (id) LEFT JOIN named USING (id)"""


def _spans(pattern: str, rank: int, where: str = "TRUE") -> str:
    """All matches of a pattern with their places: (id, start, rank, end, value)."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT id, start, {rank} AS rank, start + length(value) AS "end", value
    FROM (SELECT id, value, CAST(sum(length(piece) + length(value)) OVER (PARTITION BY id ORDER BY k)
                                 AS BIGINT) - length(value) AS start
          FROM (SELECT id, unnest(found) AS value, unnest(pieces[1:len(found)]) AS piece,
                       generate_subscripts(found, 1) AS k
                FROM (SELECT id, string_split_regex(text, '{quoted}') AS pieces,
                             regexp_extract_all(text, '{quoted}') AS found FROM docs) AS cut
                WHERE len(found) > 0) AS pairs) AS placed
    WHERE {where}"""


# The rules of the scan as the oracle states them, apart from the library's.
_KEYS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token")
) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGNED = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ("assign", "access", "hex", "hex_entropy", "base64_entropy")
_CLASSES = {"hex_entropy": ("A-Fa-f0-9", 2.8), "base64_entropy": ("A-Za-z0-9+/_=-", 3.75)}
_WIDTH = 20
# No secrets: words of one case with two digits at most, none of them before a letter; words
# joined by signs, a capital each, two digits at the end; joined capitalised words of four
# letters or more; text without letters; UUIDs; repeats of a unit of up to eight characters.
_FEW_DIGITS = (
    "length(regexp_replace(value, '[^0-9]', '', 'g')) <= 2 AND NOT regexp_matches(value, '[0-9][A-Za-z]')"
)
_PARTS = "string_split_regex(value, '[+/_=-]')"
_HARMLESS = f"""(
     (NOT regexp_matches(substr(value, 2), '[A-Z]') AND {_FEW_DIGITS})
  OR (NOT regexp_matches(value, '[a-z]') AND {_FEW_DIGITS})
  OR (len({_PARTS}) BETWEEN 2 AND 201
      AND len(list_filter({_PARTS}[1:-2], lambda w: NOT regexp_full_match(w, '[A-Z]?[a-z]*'))) = 0
      AND regexp_full_match({_PARTS}[-1], '[A-Z]?[a-z]*[0-9]?[0-9]?'))
  OR regexp_full_match(value, '[A-Z]?[a-z]+([A-Z][a-z][a-z][a-z]+){{1,40}}')
  OR NOT regexp_matches(value, '[A-Za-z]')
  OR regexp_full_match(lower(value), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')
  OR len(list_filter(generate_series(1, 8), lambda u: length(value) % u = 0 AND length(value) > u
         AND value = repeat(substr(value, 1, CAST(u AS INTEGER)), length(value) // u))) > 0)"""


def _entropy(kind: str, earlier: str) -> str:
    """Pieces of a class's runs outside of earlier spans, with a window above the threshold.

    Every character of a run that no earlier span covers is looked at; those next to each
    other make a piece.
    """
    chars, threshold = _CLASSES[kind]
    most = math.floor((math.log2(_WIDTH) - threshold) * _WIDTH * 1_000_000)
    return f"""
     {kind}_runs AS ({_spans(f"[{chars}]{{{_WIDTH},}}", _KINDS.index(kind))}),
     {kind}_free AS (
       SELECT id, start AS run, value, rank, place,
              place - row_number() OVER (PARTITION BY id, start ORDER BY place) AS island
       FROM (SELECT *, unnest(generate_series(start, "end" - 1)) AS place FROM {kind}_runs)
       ANTI JOIN (SELECT DISTINCT id, unnest(generate_series(start, "end" - 1)) AS place FROM {earlier}) AS covered
         USING (id, place)),
     {kind}_pieces AS (
       SELECT id, min(place) AS start, any_value(rank) AS rank, max(place) + 1 AS "end",
              substr(any_value(value), CAST(min(place) - run + 1 AS INTEGER), CAST(count(*) AS INTEGER)) AS value
       FROM {kind}_free GROUP BY id, run, island HAVING count(*) >= {_WIDTH}),
     {kind}_counts AS (
       SELECT id, start, k, letter, count(*) AS c
       FROM (SELECT id, start, k, unnest(string_split(substr(value, CAST(k AS INTEGER), {_WIDTH}), '')) AS letter
             FROM (SELECT *, unnest(generate_series(1, length(value) - {_WIDTH} + 1)) AS k FROM {kind}_pieces))
       GROUP BY ALL),
     {kind}_best AS (
       SELECT id, start, min(total) AS total
       FROM (SELECT id, start, k, sum(CAST(round(c * log2(c) * 1000000) AS BIGINT)) AS total
             FROM {kind}_counts GROUP BY ALL) GROUP BY ALL),
     {kind}_spans AS (
       SELECT p.* FROM {kind}_pieces p JOIN {kind}_best b ON p.id = b.id AND p.start = b.start
       WHERE total <= {most} AND NOT {_HARMLESS})"""


KIND_NAMES = "[" + ", ".join(f"'{kind}'" for kind in _KINDS) + "]"
JOINED = (
    f"string_agg({KIND_NAMES}[rank + 1] || ':' || start || ':' || \"end\", ',' "
    'ORDER BY start, rank, "end")'
)
_LONG_VALUE = f"length(regexp_extract(value, '{_ASSIGNED.replace(chr(39), chr(39) * 2)}', 2)) >= 12"

SECRETS = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents),
     base AS (
       {_spans(_ASSIGNED, 0, _LONG_VALUE)}
       UNION ALL {_spans("AKIA[A-Z0-9]+", 1, "length(value) >= 18")}
       UNION ALL {_spans("[0-9a-f]+", 2, "length(value) >= 16")}),
     {_entropy("hex_entropy", "base")},
     with_hex AS (SELECT * FROM base UNION ALL SELECT * FROM hex_entropy_spans),
     {_entropy("base64_entropy", "with_hex")},
     every AS (SELECT * FROM with_hex UNION ALL SELECT * FROM base64_entropy_spans),
     counted AS (
       SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
              count(*) FILTER (rank = 2) AS n_hex, {JOINED} AS joined FROM base GROUP BY id),
     listed AS (SELECT id, {JOINED} AS joined FROM every GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(counted.joined, '')) AS base_sha256,
       coalesce(listed.joined, '') AS spans
FROM docs LEFT JOIN counted USING (id) LEFT JOIN listed USING (id)"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"

URLS = f"""
WITH captures AS (
       SELECT page_id, url, {_HOST} AS host, DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS fetched
       FROM pages),
     hosts AS (
       SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS d,
              regexp_extract(host, '([^.]*\\.[^.]*)$', 1) AS parent
       FROM (SELECT DISTINCT host FROM captures WHERE host <> '')),
     lists AS (
       SELECT 'block' AS list, 'd:' || host AS entry, CAST(d % 300 AS INTEGER) AS first,
              CASE WHEN d % 3 = 0 THEN CAST(d % 300 AS INTEGER) + 60 ELSE 100000 END AS last
       FROM hosts WHERE d % 2 = 0
       UNION ALL SELECT 'allow', 'p:' || host || '/en', CAST(d % 300 AS INTEGER) + 30,
                        CAST(d % 300 AS INTEGER) + 150 FROM hosts WHERE d % 4 = 0
       UNION ALL SELECT DISTINCT 'block', 'd:' || parent, 200, 220 FROM hosts WHERE parent <> ''),
     days AS (
       SELECT list, entry, unnest(generate_series(first, least(last - 1, 400))) AS day FROM lists),
     keys AS (
       SELECT page_id, url, fetched, 'd:' || array_to_string(labels[k:], '.') AS entry
       FROM (SELECT page_id, url, fetched, string_split(host, '.') AS labels,
                    unnest(generate_series(1, len(string_split(host, '.')))) AS k
             FROM captures WHERE host <> '') AS domains
       UNION ALL
       SELECT page_id, url, fetched, 'p:' || host || '/' || array_to_string(segments[1:k], '/')
       FROM (SELECT page_id, url, fetched, host, segments,
                    unnest(generate_series(1, len(segments))) AS k
             FROM (SELECT page_id, url, fetched, host,
                          list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS segments
                   FROM captures WHERE host <> '') AS cut) AS paths),
     active AS (
       SELECT DISTINCT page_id, url, keys.entry, list
       FROM keys JOIN days ON keys.entry = days.entry AND fetched = DATE '2024-01-01' + CAST(day AS INTEGER)),
     best AS (
       SELECT page_id, url, entry, list, count(*) OVER (PARTITION BY page_id, url) AS n,
              row_number() OVER (PARTITION BY page_id, url
                ORDER BY length(entry) DESC, list = 'allow' DESC, entry DESC) AS place FROM active)
SELECT c.page_id, c.url, host, CAST(fetched AS VARCHAR) AS fetched, coalesce(n, 0) AS n_active,
       coalesce(list, 'none') AS verdict, entry
FROM captures c LEFT JOIN best b ON b.place = 1 AND b.page_id = c.page_id AND b.url = c.url"""

_ESCAPED = "regexp_replace({0}, '" + chat._PLAIN + "', '\\1\\\\\\2\\3', 'g')"
_MARKS = len(chat.START) + len(chat.SEPARATOR) + len(chat.END)

CHAT = f"""
WITH turns AS (
       SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
       UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                                       (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
     sized AS (
       SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens,
              length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {_MARKS} AS chars,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS place
       FROM turns),
     opened AS (
       SELECT *, place = 0 AND role = 'system' AS is_system,
              coalesce(max(CASE WHEN place = 0 AND role = 'system' THEN tokens END) OVER of_conv, 0) AS system_tokens,
              coalesce(max(CASE WHEN place = 0 AND role = 'system' THEN chars END) OVER of_conv, 0) AS system_chars
       FROM sized WINDOW of_conv AS (PARTITION BY conv_id)),
     shared AS (
       SELECT *, system_tokens <= {chat.BUDGET - chat.BUDGET // 4} AS retained,
              CASE WHEN system_tokens > {chat.BUDGET - chat.BUDGET // 4} THEN {chat.HISTORY}
                   ELSE least({chat.HISTORY}, {chat.BUDGET - chat.BUDGET // 4} - system_tokens) END AS history
       FROM opened),
     ruled AS (
       SELECT *, {chat.BUDGET} - history - CASE WHEN retained THEN system_tokens ELSE 0 END AS capacity,
              sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (
                PARTITION BY conv_id ORDER BY place) - tokens AS before
       FROM shared),
     celled AS (
       SELECT *, CASE WHEN NOT is_system THEN before // capacity WHEN retained THEN 0 ELSE -1 END AS cell,
              (before + tokens - 1) // capacity AS last_cell
       FROM ruled),
     apart AS (
       SELECT *, NOT is_system AND last_cell > cell AND sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (
                PARTITION BY conv_id, cell) > capacity AS alone
       FROM celled),
     gathered AS (
       SELECT conv_id, cell, alone, min(CASE WHEN is_system THEN -1 ELSE before END) AS "window",
              sum(chars) AS chars, sum(tokens) AS own, any_value(history) AS history,
              any_value(system_tokens) AS system_tokens, any_value(system_chars) AS system_chars,
              any_value(retained) AND NOT bool_or(is_system)
                AND sum(tokens) + any_value(system_tokens) <= {chat.BUDGET} AS repeats_system
       FROM apart GROUP BY ALL),
     windows AS (
       SELECT *, least(history, {chat.BUDGET} - own - CASE WHEN repeats_system THEN system_tokens ELSE 0 END) AS reach
       FROM gathered),
     repeats AS (
       SELECT w.conv_id, w.cell, w.alone, sum(t.chars) AS chars
       FROM windows w JOIN apart t ON t.conv_id = w.conv_id AND NOT t.is_system
        AND t.before >= w."window" - w.reach AND t.before + t.tokens <= w."window"
       WHERE w."window" > 0 GROUP BY ALL),
     formatted AS (
       SELECT w.conv_id,
              sum(w.chars + CASE WHEN repeats_system THEN system_chars ELSE 0 END + coalesce(r.chars, 0)) AS formatted_chars
       FROM windows w LEFT JOIN repeats r
         ON r.conv_id = w.conv_id AND r.cell = w.cell AND r.alone = w.alone GROUP BY ALL),
     texts AS (
       SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS lines,
              coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS targets,
              sum(CASE WHEN is_system THEN chars ELSE 0 END) AS opening
       FROM opened GROUP BY conv_id)
SELECT t.conv_id, n_turns, sha256(lines) AS turns_sha256, length(targets) AS loss_chars,
       sha256(targets) AS loss_sha256, CAST(coalesce(formatted_chars, opening) AS BIGINT) AS formatted_chars
FROM texts t LEFT JOIN formatted f ON f.conv_id IS NOT DISTINCT FROM t.conv_id"""


def _hashes_within(sketch: str, reach: str) -> str:
    return f"list_filter(string_split(substr({sketch}, 5), ','), lambda h: h <> '' AND h < {reach})"


def _reach(sketch: str) -> str:
    return f"CASE WHEN {sketch} LIKE 'all:%' THEN 'g' ELSE greatest('200000000000', right({sketch}, 12) || '0') END"


def _likeness(one: str, other: str) -> str:
    """Shared of all hashes, as far as both sketches reach: an eighth of them all, or 32."""
    reach = f"least({_reach(one)}, {_reach(other)})"
    a, b = _hashes_within(one, reach), _hashes_within(other, reach)
    union = f"len(list_distinct(list_concat({a}, {b})))"
    both = f"(len({a}) + len({b}) - {union})"
    return f"CASE WHEN {one} = {other} THEN 1.0 WHEN {union} = 0 THEN 0.0 ELSE {both}::DOUBLE / {union} END::DOUBLE"


FINGERPRINTS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
     linked AS (
       SELECT *, coalesce(lead(text) OVER falling, first(text) OVER falling) AS next_text
       FROM docs WINDOW falling AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
     edits AS (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM linked),
     texts AS (SELECT text FROM docs UNION SELECT edited FROM edits),
     shingles AS (
       SELECT text, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
                generate_series(1, greatest(1, len(w) - 4)),
                lambda k: substr(md5(array_to_string(w[k:k + 4], ' ')), 1, 12)))) END AS h
       FROM (SELECT text, {WORDS} AS w FROM texts) AS cut),
     measured AS (
       SELECT text, h, greatest(len(list_filter(h, lambda x: x < '200000000000')), least(len(h), 32)) AS kept
       FROM shingles),
     sketches AS (
       SELECT text, CASE WHEN kept = len(h) THEN 'all:' ELSE 'low:' END || coalesce(array_to_string(h[1:kept], ','), '') AS sketch
       FROM measured)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, own.sketch AS fingerprint,
       other.sketch AS edited_fingerprint, {_likeness("own.sketch", "other.sketch")} AS near_edited,
       {_likeness("own.sketch", "following.sketch")} AS near_next
FROM edits JOIN sketches own ON own.text = edits.text JOIN sketches other ON other.text = edited
     JOIN sketches following ON following.text = next_text"""

VARIANTS = """
WITH RECURSIVE
     crc AS (
       SELECT list(entry ORDER BY i) AS t
       FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
             FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS i) AS bytes) AS entries),
     runs AS (
       SELECT name, run, count(*) AS times
       FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
             FROM documents) AS each GROUP BY ALL),
     coded AS (
       SELECT run, times, flatten(list_transform(string_split(name || ':' || run, ''), lambda ch:
                CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
                     ELSE [(192 | (unicode(ch) >> 6))::BIGINT, (128 | (unicode(ch) & 63))::BIGINT] END)) AS bytes
       FROM runs),
     checked AS (
       SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
                xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
       FROM coded CROSS JOIN crc),
     spelt AS (
       SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                   ELSE run END AS word, times FROM checked),
     words AS (
       SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6
       GROUP BY word HAVING sum(times) >= 5),
     places AS (SELECT word, unnest(generate_series(1, length(word))) AS p FROM words),
     masked AS (SELECT word, p, left(word, p - 1) AS head, substr(word, p + 1) AS tail FROM places),
     shortened AS (SELECT DISTINCT word, head || tail AS other FROM masked),
     near AS (
       SELECT a.word, b.word AS other FROM masked a JOIN masked b
         ON a.p = b.p AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
       UNION ALL SELECT s.word, other FROM shortened s JOIN words w ON w.word = other
       UNION ALL SELECT other, s.word FROM shortened s JOIN words w ON w.word = other),
     ranked AS (
       SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near,
              row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS rank
       FROM near JOIN words ON words.word = other),
     formed AS (
       SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
              CASE WHEN r.n >= 5 * w.n THEN other END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
       FROM words w LEFT JOIN ranked r ON r.word = w.word AND rank = 1),
     chain AS (
       SELECT word, word AS last, 0 AS steps FROM formed
       UNION ALL
       SELECT chain.word, form, steps + 1 FROM chain JOIN formed ON formed.word = last WHERE form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n
FROM formed f JOIN (SELECT word, arg_max(last, steps) AS root FROM chain GROUP BY word) AS roots USING (word)"""
