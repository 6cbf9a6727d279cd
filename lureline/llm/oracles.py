"""DuckDB SQL of the llm queries, where SQL can express them."""

from __future__ import annotations

from lureline.llm.chat_format import CONTROL, START

_REGISTRY: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(_REGISTRY)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for word in CONTROL:
        out = f"replace({out}, {_quoted(word)}, {_quoted(word[0] + chr(92) + word[1:])})"
    return out


_REGISTRY["op7_chat_format"] = f"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), {_escaped("coalesce(text, '')")}) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM given),
f AS (
  SELECT *, length({_quoted(START)} || replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B')
                   || chr(10) || {_escaped('text')} || '<|im_end|>' || chr(10)) AS chars
  FROM t),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_REGISTRY["op3_decontaminate"] = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS p
  FROM iw, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM pat),
win AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM dw, sizes, unnest(range(1, len(w) - k + 2)) AS r(i)),
hit AS (SELECT doc_id, i, win.k, item_id FROM win JOIN pat ON win.k = pat.k AND win.p = pat.p),
words AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, unnest(range(0, k)) AS q(o) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


_REGISTRY["op6_substring_automata"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS h
  FROM d, unnest(range(1, len(w) - 18)) AS r(i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM ranked, unnest(range(0, 20)) AS q(o) WHERE k > 1),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""
