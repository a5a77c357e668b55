"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

REPLY_TREES = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '>', '&gt;'), '|', '&#124;')) + 4 + 7)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


#: Earliest deadline first, slot by slot, in a recursive query; ids are unique there.
PFAIR = """
WITH RECURSIVE numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS nth FROM documents),
sizes AS (SELECT source, count(*) AS n FROM numbered GROUP BY source),
weights AS (SELECT source, n, round(sqrt(n))::BIGINT AS p FROM sizes),
quota AS (SELECT source, n, p, (sum(p) OVER ())::BIGINT AS q FROM weights),
listed AS (SELECT list(source ORDER BY source) AS ss, list(p ORDER BY source) AS ps, max(q) AS q, count(*) AS m, min(((n + 1) * q + p - 1) // p) AS stop FROM quota),
edf AS (
  SELECT -1::BIGINT AS t, list_transform(range(m), lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM listed
  UNION ALL
  SELECT t, list_transform(range(1, m + 1), lambda j: done[j] + CASE WHEN j = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT t + 1 AS t, done, m,
      list_min(list_filter(list_transform(range(1, m + 1), lambda j:
        CASE WHEN (done[j] * q) // ps[j] <= t + 1 THEN (((done[j] + 1) * q + ps[j] - 1) // ps[j]) * 1000000 + j END), lambda v: v IS NOT NULL)) % 1000000 AS pick
    FROM edf, listed WHERE t + 1 < stop)),
plan AS (SELECT ss[pick] AS source, done[pick] AS k, t AS slot FROM edf, listed WHERE t >= 0),
horizon AS (SELECT min(slot) AS h FROM quota JOIN plan USING (source) WHERE k > n),
inside AS (SELECT source, k, slot FROM plan, horizon WHERE slot < h)
SELECT doc_id, numbered.source, nth, nth AS block, ((nth - 1) * q) // p AS released, (nth * q + p - 1) // p AS due, slot, slot IS NOT NULL AS in_mix
FROM numbered JOIN quota ON numbered.source = quota.source LEFT JOIN inside ON numbered.source = inside.source AND nth = k
"""


def sentence_rules(sentences: dict[str, str], rules: list) -> str:
    """Known sentences between line ends, wherever they wrap; each line end is doubled, so that neighbours share it.

    Each identifier is one character, so that a text's identifiers and a rule's are plain strings of them: every
    occurrence of a rule's string that no earlier rule has used is the licence, and what is left over is unmatched.
    """
    names = sorted(set(sentences.values()))
    letter = {i: chr(0x4E00 + k) for k, i in enumerate(names)}
    listed = ", ".join(f"('{s}', '{letter[i]}')" for s, i in sentences.items())
    letters = ", ".join(f"('{c}', '{i}')" for i, c in letter.items())
    either = "|".join(s.replace(".", r"\.").replace(" ", r"(?: |\n\n)") for s in sorted(sentences, key=len, reverse=True))
    steps, prev = [], "start"
    for k, (name, ids) in enumerate(rules):
        seq = "".join(letter[i] for i in ids)
        steps.append(f"r{k} AS (SELECT doc_id, ids, replace(rest, '{seq}', '|') AS rest, CASE WHEN contains(rest, '{seq}') THEN list_append(found, '{name}') ELSE found END AS found FROM {prev})")
        prev = f"r{k}"
    return rf"""
WITH catalogue(s, i) AS (VALUES {listed}), letters(c, name) AS (VALUES {letters}), m AS (SELECT map(list(c), list(name)) AS m FROM letters),
lines AS (
  SELECT doc_id, replace(regexp_replace(lower(coalesce(text, '')), '\r\n?', chr(10), 'g'), 'license-identifier:', 'license-identifier ') AS t FROM documents),
cuts AS (SELECT doc_id, regexp_replace(chr(10) || ' ' || t, '([^\n.!?;:])[.!?;:]+(\s+|$)', '\1' || chr(10) || chr(10), 'g') AS t FROM lines),
plain AS (SELECT doc_id, regexp_replace(t, '[^a-z0-9./\n-]+', ' ', 'g') || chr(10) AS t FROM cuts),
trimmed AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ ./-]+\n', chr(10), 'g'), '\n[ ./-]+', chr(10), 'g') AS t FROM plain),
spans AS (SELECT doc_id, regexp_extract_all(replace(t, chr(10), chr(10) || chr(10)), '\n(?:{either})\n') AS found FROM trimmed),
parts AS (SELECT doc_id, unnest(found) AS part, generate_subscripts(found, 1) AS ord FROM spans),
named AS (SELECT doc_id, ord, i FROM (SELECT doc_id, ord, replace(trim(part, chr(10)), chr(10) || chr(10), ' ') AS s FROM parts) JOIN catalogue USING (s)),
runs AS (SELECT doc_id, ord, i, lag(i) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM named),
seqs AS (SELECT doc_id, list(i ORDER BY ord) AS ids FROM runs WHERE before IS DISTINCT FROM i GROUP BY doc_id),
start AS (
  SELECT doc_id, coalesce(ids, []) AS ids, coalesce(list_aggregate(ids, 'string_agg', ''), '') AS rest, []::VARCHAR[] AS found
  FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN seqs USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(list_aggregate(list_transform(ids, lambda x: m[x]), 'string_agg', ','), '') AS sentence_ids,
  coalesce(list_aggregate(list_filter(found, lambda x, k: list_position(found, x) = k), 'string_agg', ','), '') AS licences,
  coalesce(list_aggregate(list_transform(list_filter(string_split(rest, ''), lambda x: x NOT IN ('', '|')), lambda x: m[x]), 'string_agg', ','), '') AS unmatched
FROM {prev}, m
"""
