"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLES["op1_mix_sources"] = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT AS schedule FROM sources
), weighed AS (
  SELECT *, CASE schedule WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    3 * source_size AS cap FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, schedule, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, schedule,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM placed
), taken AS (
  SELECT *, passes * size + greatest(0, least(size,
    round(target - passes * source_size)::BIGINT - begin_at))::BIGINT AS taken FROM passed
), shares AS (
  SELECT *, CASE WHEN taken > 0 THEN least(1.0::DOUBLE, begin_at::DOUBLE / target) END AS share FROM taken
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(least(1.0::DOUBLE, CASE schedule
    WHEN 0 THEN 2.0 * (share * 5.0) / (4.0 + sqrt(16.0 + 4.0 * (share * 5.0)))
    WHEN 1 THEN 2.0 * (share * 2.0) / 4.0
    ELSE 2.0 * (share * 1.0) / (1.5 + sqrt(2.25 - 2.0 * (share * 1.0))) END), 9) END AS position
FROM shares
"""

ORACLES["op7_quality_rules"] = f"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), numbered AS (SELECT *, row_number() OVER () AS r FROM words),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM numbered)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, sum(least(3, coalesce(n - i, 3)))::BIGINT AS n_repeat
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM twice) GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM numbered LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM measured
"""

# CRC-32 of a decimal number, bit by bit; 3988292384 is its polynomial, 4294967295 all ones.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

ORACLES["op11_conversation_trie"] = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns,
    {_CRC} % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), member AS (
  SELECT conv_id, d, turns[1:d] AS k, len(turns) = d AS last FROM built, unnest(range(0, len(turns) + 1)) AS u(d)
), node AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM member GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), known AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN d > 0 THEN (n_convs - 1) * strlen(k[d].t) ELSE 0 END AS worth
  FROM node LEFT JOIN kids USING (d, k)
), below AS (
  SELECT a AS d, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(worth)::BIGINT AS saved_tokens
  FROM known, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
  sha256(n.ends) AS ends_sha256
FROM known n JOIN below b ON n.d = b.d AND n.k = b.k LEFT JOIN node p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""
