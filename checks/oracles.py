"""The same results in plain SQL, by other means.

Spark numbers hits with array ranks and prefix sums and releases chunks block
by block; here one window runs over all hits, and cuts are looked up in the
whole answer.
"""

from __future__ import annotations

from checks import derive as X
from maskflow.functions import patterns as P
from maskflow.operators import completion as C
from maskflow.sources.requests import MISSING

PATTERN = P.canonical_pattern(P.RULES)
TOKEN = P.token_pattern()


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _clean(col: str) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} IN ({_quoted(MISSING)}) THEN '' ELSE {col} END"


RAW = f"raw AS ({X.REQUESTS})"
REQ = f"""{RAW}, req AS (SELECT request_num, {_clean('system_prompt')} AS system_prompt,
    {_clean('prompt')} AS prompt FROM raw)"""


def _texts(source: str) -> str:
    """Texts of requests: id, place in the request, field, text."""
    return f"""texts AS (
        SELECT request_num AS id, 1 AS place, 'system' AS field, system_prompt AS text FROM {source}
        UNION ALL SELECT request_num, 2, 'user', prompt FROM {source})"""


def _kind(rules) -> str:
    *first, last = rules
    cases = "".join(
        f" WHEN regexp_matches(value, '{r.tell}') THEN '{r.name}'" for r in first
    )
    return f"CASE{cases} ELSE '{last.name}' END" if first else f"'{last.name}'"


def _hits(entities=None, only: str = "true") -> str:
    """Hits of ``texts``, one row each, with pieces and offsets."""
    rules = P.pick(entities)
    pattern = P.canonical_pattern(rules)
    return f"""cut AS (SELECT *, CASE WHEN {only} THEN regexp_extract_all(text, '{pattern}') ELSE [] END AS vs,
            CASE WHEN {only} THEN regexp_split_to_array(text, '{pattern}') ELSE [text] END AS ps FROM texts),
        hit0 AS (SELECT id, place, field, i AS pos, vs[i] AS value, ps[i] AS gap
            FROM cut, unnest(range(1, len(vs) + 1)) AS u(i)),
        hit AS (SELECT *, {_kind(rules)} AS kind,
            sum(length(gap) + length(value)) OVER (PARTITION BY id, place ORDER BY pos) AS stop
            FROM hit0)"""


def _numbers(scope: str = "session") -> str:
    """Numbers, masked texts and mappings."""
    by = "kind" if scope == "session" else "id, kind"
    return f"""num AS (SELECT *, printf('%s_%04d', kind, row_number() OVER (
            PARTITION BY {by} ORDER BY id, place, pos DESC)) AS ph FROM hit),
        entry AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, pos DESC) - 1 AS ord FROM num),
        joined AS (SELECT id, place, string_agg(gap || ph, '' ORDER BY pos) AS head FROM num GROUP BY ALL),
        red AS (SELECT cut.id, cut.place, cut.field, cut.text,
            CASE WHEN head IS NULL THEN text ELSE head || ps[len(ps)] END AS redacted
            FROM cut LEFT JOIN joined USING (id, place)),
        maps AS (SELECT id, list({{k: ph, v: value}} ORDER BY ord) AS m FROM entry GROUP BY id)"""


PAIR = """masked AS (SELECT s.id AS request_num, s.text AS original_system, u.text AS original_user,
        s.redacted AS redacted_system, u.redacted AS redacted_user, coalesce(m, []) AS m
        FROM (SELECT * FROM red WHERE place = 1) s JOIN (SELECT * FROM red WHERE place = 2) u USING (id)
        LEFT JOIN maps USING (id))"""


def _restore(text: str, m: str = "m") -> str:
    """Replace entry after entry."""
    return (
        f"list_reduce(list_prepend({{k: '', v: {text}}}, {m}),"
        " lambda a, e: {k: '', v: replace(a.v, e.k, e.v)}).v"
    )


def _masked(scope: str = "session", source: str = "req") -> str:
    return f"WITH {REQ}, {_texts(source)}, {_hits()}, {_numbers(scope)}, {PAIR}"


def _corpus(table: str, key: str, text: str, entities=None, only: str = "true", extra: str = "") -> str:
    return f"""WITH texts AS (SELECT {key} AS id, 1 AS place, '{text}' AS field, {text} AS text{extra}
        FROM {table}), {_hits(entities, only)}"""


def _spans(key: str) -> str:
    return f"""SELECT id AS {key}, pos - 1 AS pos, kind AS entity_type,
        CAST(stop - length(value) AS BIGINT) AS "start", CAST(stop AS BIGINT) AS "end", value FROM hit"""


RESPONSES = f"""responses AS (SELECT request_num, {X.RESPONSE} AS response, {X.RESPONSE_ERROR} AS error
    FROM masked WHERE {X.HAS_RESPONSE})"""
RESULTS = f"""{RESPONSES}, answered AS (SELECT masked.*, response,
        CASE WHEN r.request_num IS NULL THEN '{C.NO_ANSWER}' ELSE error END AS error
        FROM masked LEFT JOIN responses r USING (request_num)),
    results AS (SELECT request_num, original_system, original_user,
        CASE WHEN error IS NULL THEN redacted_system END AS redacted_system,
        CASE WHEN error IS NULL THEN redacted_user END AS redacted_user,
        CASE WHEN error IS NULL THEN m END AS m,
        CASE WHEN error IS NULL THEN response END AS llm_response_redacted,
        CASE WHEN error IS NULL AND response IS NOT NULL THEN {_restore('response')} END AS final_response,
        error FROM answered)"""
PICKY = f"""results AS (SELECT *, redacted_system LIKE '%helpful%' AS bad,
    {_restore("redacted_system || ': ' || redacted_user")} AS answer FROM masked)"""
LIMIT_ERROR = f"'{C.CALL_FAILED}API rate limit exceeded'"


def _chunks(answer: str, pieces: str, source: str = "masked", key: str = "request_num") -> str:
    """Chunks of answers with running lengths, and where known placeholders stand."""
    return f"""answer AS (SELECT {key} AS request_id, {answer} AS t, m FROM {source}),
        ch AS (SELECT request_id, i - 1 AS seq, p[i] AS content
            FROM (SELECT request_id, {pieces} AS p FROM answer), unnest(range(1, len(p) + 1)) AS u(i)),
        run AS (SELECT *, sum(length(content)) OVER (PARTITION BY request_id ORDER BY seq) AS c FROM ch),
        tok AS (SELECT request_id, regexp_extract_all(t, '{TOKEN}') AS ks,
            regexp_split_to_array(t, '{TOKEN}') AS gs, m FROM answer),
        occ0 AS (SELECT request_id, ks[i] AS k, list_contains(list_transform(m, lambda e: e.k), ks[i]) AS known,
            sum(length(gs[i]) + length(ks[i])) OVER (PARTITION BY request_id ORDER BY i) AS b
            FROM tok, unnest(range(1, len(ks) + 1)) AS u(i)),
        occ AS (SELECT request_id, k, b - length(k) AS a, b FROM occ0 WHERE known),
        hold AS (SELECT request_id, t, m,
            coalesce(list_max(list_transform(m, lambda e: length(e.k))), 0) AS l FROM answer),
        cutx AS (SELECT run.*, t, m, greatest(0, c - l) AS x FROM run JOIN hold USING (request_id)),
        cuts AS (SELECT cutx.request_id, seq, content, c, t, m, coalesce(min(a), x) AS upto
            FROM cutx LEFT JOIN occ ON occ.request_id = cutx.request_id AND a < x AND x < b
            GROUP BY cutx.request_id, seq, content, c, t, m, x),
        outs AS (SELECT *, lag(upto, 1, 0) OVER (PARTITION BY request_id ORDER BY seq) AS low FROM cuts),
        rel AS (SELECT request_id, seq,
            {_restore("substr(t, CAST(low + 1 AS BIGINT), CAST(upto - low AS BIGINT))")} AS content FROM outs),
        ended AS (SELECT request_id, max(seq) + 1 AS seq, any_value(m) AS m,
            substr(any_value(t), CAST(max(upto) + 1 AS BIGINT)) AS tail FROM cuts GROUP BY request_id),
        rest AS (SELECT request_id, seq, {_restore("tail")} AS content FROM ended)"""


def _pieces(pattern: str) -> str:
    return f"regexp_extract_all(t, '{pattern}')"


STREAM = f"{_masked('request')}, {_chunks(X.STREAMED, _pieces(X.CHUNK))}"
WORDS = f"""{_masked('request')}, {_chunks(X.STREAMED + " || ' '", "list_transform(string_split(rtrim(t), ' '), lambda w: w || ' ')")}"""
DOCS = f"{_corpus('documents', 'doc_id', 'text')}, {_numbers('request')}"

_CHUNK_EVENTS = """shown AS (
        SELECT request_id, seq, content FROM rel WHERE content <> ''
        UNION ALL SELECT request_id, seq, content FROM rest WHERE content <> '')"""

ORACLES: dict[str, str] = {
    "read_requests": f"WITH {REQ} SELECT * FROM req",
    "read_requests_split": f"WITH {REQ} SELECT * FROM req",
    "normalize_text": f"WITH {REQ} SELECT * FROM req",
    "number_requests": """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS request_num
        FROM orders""",
    "stream_requests": f"{_masked('request')} SELECT request_num, redacted_system, redacted_user FROM masked",
    "stream_session": f"{_masked()} SELECT request_num, redacted_system, redacted_user FROM masked",
    "results_table": f"""{_masked()}, {RESULTS} SELECT request_num, redacted_system, redacted_user,
        llm_response_redacted, error FROM results""",
    "vault": f"""{_masked()} SELECT id AS request_num, field, ord, ph AS placeholder,
        kind AS entity_type, value AS original FROM entry""",
    "detect_spans": f"{_corpus('documents', 'doc_id', 'text')} {_spans('doc_id')}",
    "detect_spans_requests": f"""WITH {REQ}, texts AS (SELECT request_num AS id, 2 AS place, 'user' AS field,
        prompt AS text FROM req), {_hits()} {_spans('request_num')}""",
    "detect_ssn": f"""WITH {REQ}, texts AS (SELECT request_num AS id, 1 AS place, 'system' AS field,
        system_prompt AS text FROM req), {_hits(['US_SSN'])} {_spans('request_num')}""",
    "detect_email": f"{_corpus('pages', 'page_id', 'html', ['EMAIL_ADDRESS'])} {_spans('page_id')}",
    "detect_phone": f"{_corpus('documents', 'doc_id', 'text', ['PHONE_NUMBER'])} {_spans('doc_id')}",
    "detect_subset": f"""WITH {REQ}, texts AS (SELECT request_num AS id, 2 AS place, 'user' AS field,
        prompt AS text FROM req), {_hits(['US_SSN', 'PHONE_NUMBER'])} {_spans('request_num')}""",
    "detect_lang_en": f"""{_corpus('documents', 'doc_id', 'text', only="lang = 'en'", extra=', lang')},
        {_numbers()} SELECT doc_id, lang, redacted AS redacted_text
        FROM red JOIN documents ON red.id = doc_id""",
    "detect_overlap": f"""WITH src AS ({X.OVERLAP}), texts AS (SELECT c_custkey AS id, 1 AS place,
        'text' AS field, text FROM src), {_hits()} {_spans('c_custkey')}""",
    "filter_has_pii": f"""SELECT doc_id, source FROM documents
        WHERE regexp_matches(text, '{PATTERN}')""",
    "hits_lateral_view": f"""WITH {REQ}, texts AS (SELECT request_num AS id, 2 AS place, 'user' AS field,
        prompt AS text FROM req), {_hits()}
        SELECT id AS request_num, pos - 1 AS pos, kind AS entity_type, value FROM hit""",
    "sql_functions": f"""WITH {REQ}, texts AS (SELECT request_num AS id, 2 AS place, 'user' AS field,
        prompt AS text FROM req), {_hits()}, {_numbers('request')}
        SELECT request_num, regexp_matches(prompt, '{PATTERN}') AS has_pii, redacted,
        'for ' || system_prompt AS restored FROM req JOIN red ON id = request_num""",
    "placeholder_format": f"""SELECT o_orderkey, printf('%s_%04d', {X.ENTITY_BY_KEY}, o_orderkey)
        AS placeholder FROM orders""",
    "rank_in_text": f"""WITH {REQ}, texts AS (SELECT request_num AS id, 2 AS place, 'user' AS field,
        prompt AS text FROM req), {_hits()} SELECT id AS request_num, pos - 1 AS pos, kind AS entity_type,
        row_number() OVER (PARTITION BY id, kind ORDER BY stop DESC) AS rank FROM hit""",
    "session_numbering": f"{_masked()} SELECT id AS request_num, ord, ph AS placeholder FROM entry",
    "session_numbering_bucketed": f"{_masked()} SELECT id AS request_num, ord, ph AS placeholder FROM entry",
    "request_numbering": f"{_masked('request')} SELECT id AS request_num, ord, ph AS placeholder FROM entry",
    "redact_text": f"""WITH {REQ}, texts AS (SELECT request_num AS id, 2 AS place, 'user' AS field,
        prompt AS text FROM req), {_hits()}, {_numbers('request')}
        SELECT id AS request_num, redacted AS redacted_prompt FROM red""",
    "mapping_rows": f"""{_corpus('documents', 'doc_id', 'text')}, {_numbers()}
        SELECT id AS doc_id, ord, ph AS placeholder, kind AS entity_type, value AS original FROM entry""",
    "redact_passthrough": f"""WITH {RAW}, {_texts('raw')}, {_hits()}, {_numbers('request')}, {PAIR}
        SELECT request_num, redacted_system, redacted_user, CAST(len(m) AS BIGINT) AS n_mappings
        FROM masked""",
    "request_mappings": f"""{_masked()} SELECT id AS request_num, ord, ph AS placeholder,
        value AS original FROM entry""",
    "redact_requests": f"{_masked()} SELECT request_num, redacted_system, redacted_user FROM masked",
    "entity_totals": f"""{_masked()} SELECT entity_type, count(kind) AS hits
        FROM (VALUES ('US_SSN'), ('PHONE_NUMBER'), ('EMAIL_ADDRESS')) AS t(entity_type)
        LEFT JOIN hit ON kind = entity_type GROUP BY entity_type""",
    "redact_documents": f"""{_corpus('documents', 'doc_id', 'text')}, {_numbers()}
        SELECT id AS doc_id, redacted AS redacted_text FROM red""",
    "redact_pages": f"""{_corpus('pages', 'page_id', 'html')}, {_numbers()}
        SELECT id AS page_id, redacted AS redacted_html FROM red""",
    "chat_messages": f"""{_masked('request')}
        SELECT request_num, CAST(0 AS BIGINT) AS position, 'system' AS role, redacted_system AS content FROM masked
        UNION ALL SELECT request_num, 1, 'user', redacted_user FROM masked""",
    "conversation_messages": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
        AS position, role, text AS content FROM conversations""",
    "attach_responses": f"{_masked('request')}, {RESULTS} SELECT request_num, response, error FROM answered",
    "complete_echo": f"""{_masked('request')} SELECT request_num,
        'echo: ' || redacted_user || ' | ' || redacted_system AS response,
        CAST(NULL AS VARCHAR) AS error FROM masked""",
    "chunks_nonempty": f"{STREAM} SELECT request_id, seq, content FROM ch WHERE seq % 5 % 2 <> 1",
    "error_wrap": f"""{_masked('request')}, {RESPONSES}
        SELECT request_num, '{C.CALL_FAILED}' || error AS error,
        '{C.STREAM_FAILED}' || error AS stream_error FROM responses""",
    "error_isolation": f"""{_masked()}, {PICKY} SELECT request_num, original_user,
        CASE WHEN NOT bad THEN redacted_user END AS redacted_user,
        CASE WHEN NOT bad THEN CAST(len(m) AS BIGINT) END AS n_mappings,
        CASE WHEN NOT bad THEN answer END AS final_response,
        CASE WHEN bad THEN {LIMIT_ERROR} END AS error FROM results""",
    "null_response": f"""{_masked()}, {RESULTS} SELECT request_num, final_response IS NULL AS is_null,
        error IS NULL AS is_success FROM results""",
    "unredact": f"""{_masked()} SELECT request_num, original_user || ' & ' || original_system || ' & '
        || original_user AS restored FROM masked""",
    "unredact_layout": f"""{_masked()} SELECT request_num, 'Dear' || chr(10) || chr(10) || '    ' || original_user
        || chr(10) || chr(9) || original_system || chr(10) || '  ' || chr(10) AS restored FROM masked""",
    "number_repeated": """SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS request_num FROM orders""",
    "unredact_passthrough": f"""WITH {RAW} SELECT request_num, system_prompt AS kept_null,
        prompt AS kept_text, '' AS kept_empty FROM raw""",
    "unredact_unknown": f"""{_masked('request')} SELECT request_num,
        original_user || ' or EMAIL_ADDRESS_0777, US_SSN_0002' AS restored FROM masked""",
    "unredact_tokens": f"""{_masked()} SELECT request_num, original_user || ' & ' || original_system
        || ' & US_SSN_0' AS restored FROM masked""",
    "unredact_vault": f"""{_masked('request')}, ans AS ({X.ORDER_ANSWERS})
        SELECT o_orderkey, {_restore('answer', 'coalesce(m, [])')} AS restored
        FROM ans LEFT JOIN masked USING (request_num)""",
    "holdback_length": f"""{_masked()} SELECT request_num,
        coalesce(list_max(list_transform(m, lambda e: length(e.k))), 0) AS hold FROM masked""",
    "holdback_batch": f"{STREAM} SELECT request_id, seq, content FROM rel",
    "holdback_flush": f"{STREAM} SELECT request_id, content FROM rest",
    "holdback_stream": f"""{STREAM}, {_CHUNK_EVENTS}
        SELECT request_id AS request_num, seq, content FROM rel WHERE content <> ''
        UNION ALL SELECT request_id, NULL, content FROM rest WHERE content <> ''""",
    "holdback_broken": f"""{STREAM} SELECT request_id, seq, content FROM rel
        WHERE NOT ({X.BROKEN.replace("request_num", "request_id")}) OR seq < {X.BROKEN_AT}
        UNION ALL SELECT request_id, NULL, content FROM rest WHERE NOT ({X.BROKEN.replace("request_num", "request_id")})""",
    "final_broken": f"""{STREAM} SELECT request_id,
        CASE WHEN NOT ({X.BROKEN.replace("request_num", "request_id")}) THEN t END AS llm_response_redacted,
        CASE WHEN NOT ({X.BROKEN.replace("request_num", "request_id")}) THEN {_restore('t')} END AS final_response,
        CASE WHEN {X.BROKEN.replace("request_num", "request_id")} THEN '{X.BROKEN_CAUSE}' END AS error FROM answer""",
    "holdback_rest_nomap": f"""{DOCS} SELECT id AS request_id, '' AS content FROM red WHERE length(redacted) > 0""",
    "stream_session_batches": f"""{_masked()} SELECT CAST(floor(3 * (request_num - 1) / max(request_num) OVER ()) AS INT) AS batch,
        request_num, redacted_system, redacted_user FROM masked""",
    "stream_outcomes": f"""{STREAM}, said AS (SELECT * FROM rel
            WHERE content <> '' AND (request_id % 5 <> 0 OR seq < {X.BROKEN_AT})),
        ev AS (SELECT request_id, -1 AS at, 'metadata' AS type, NULL AS chunk_seq, NULL AS content FROM answer
            UNION ALL SELECT request_id, seq, 'chunk', seq, content FROM said
            UNION ALL SELECT request_id, 999999999, 'chunk', NULL, content FROM rest
                WHERE content <> '' AND request_id % 5 <> 0
            UNION ALL SELECT request_id, 1000000000, CASE WHEN request_id % 5 = 0 THEN 'error' ELSE 'final' END, NULL, NULL FROM answer)
        SELECT request_num, row_number() OVER (PARTITION BY request_num ORDER BY ev.at) - 1 AS event_seq,
            type, chunk_seq, content,
            CASE WHEN type IN ('metadata', 'error') THEN original_system END AS original_system,
            CASE WHEN type IN ('metadata', 'error') THEN original_user END AS original_user,
            CASE WHEN type = 'metadata' THEN redacted_system END AS redacted_system,
            CASE WHEN type = 'metadata' THEN redacted_user END AS redacted_user,
            CASE WHEN type = 'metadata' THEN '{{' || array_to_string(list_transform(masked.m,
                lambda e: to_json(e.k) || ':' || to_json(e.v)), ',') || '}}' END AS mappings,
            CASE WHEN type = 'final' THEN t END AS llm_response_redacted,
            CASE WHEN type = 'final' THEN {_restore('t', 'masked.m')} END AS final_response,
            CASE WHEN type = 'error' THEN '{X.BROKEN_CAUSE}' END AS error
        FROM ev JOIN masked ON request_num = request_id JOIN answer USING (request_id)""",
    "holdback_nomap": f"""{DOCS}, p AS (SELECT id, regexp_extract_all(redacted, '{X.CHUNK_LONG}') AS p FROM red)
        SELECT id AS request_id, i - 1 AS seq, p[i] AS content FROM p, unnest(range(1, len(p) + 1)) AS u(i)""",
    "stream_final": f"""{DOCS} SELECT id AS request_id,
        redacted AS llm_response_redacted, text AS final_response FROM red""",
    "stream_error": f"""{STREAM}, said AS (SELECT * FROM rel
            WHERE content <> '' AND seq < {X.BROKEN_AT} AND request_id % 5 = 0),
        ev AS (SELECT request_id, -1 AS seq, 'metadata' AS type, NULL AS content, NULL AS error FROM answer
            UNION ALL SELECT request_id, seq, 'chunk', content, NULL FROM said
            UNION ALL SELECT request_id, 1000000000, 'error', NULL, '{X.BROKEN_CAUSE}' FROM answer)
        SELECT request_num, row_number() OVER (PARTITION BY request_num ORDER BY ev.seq) - 1 AS event_seq,
            type, content, CASE WHEN type <> 'chunk' THEN original_user END AS original_user, error
        FROM ev JOIN masked ON request_num = request_id WHERE {X.BROKEN}""",
    "sink_vault": f"""{_masked('request')} SELECT id AS request_num, ord, ph AS placeholder, value AS original
        FROM entry""",
    "stream_summary": f"""WITH {RAW} SELECT count(*) AS total,
        count(*) FILTER (NOT ({X.BROKEN})) AS successful,
        count(*) FILTER ({X.BROKEN}) AS failed FROM raw""",
    "stream_events": f"""{WORDS}, {_CHUNK_EVENTS}, ev AS (
            SELECT request_id, -1 AS seq, 'metadata' AS type, NULL AS content FROM answer
            UNION ALL SELECT request_id, seq, 'chunk', content FROM shown
            UNION ALL SELECT request_id, 1000000000, 'final', NULL FROM answer)
        SELECT request_num, row_number() OVER (PARTITION BY request_num ORDER BY ev.seq) - 1 AS event_seq,
            type, content, CASE WHEN type = 'metadata' THEN redacted_user END AS redacted_user,
            CASE WHEN type = 'metadata' THEN CAST(len(masked.m) AS BIGINT) END AS n_mappings,
            CASE WHEN type = 'final' THEN t END AS llm_response_redacted,
            CASE WHEN type = 'final' THEN {_restore('t', 'masked.m')} END AS final_response
        FROM ev JOIN masked ON request_num = request_id JOIN answer USING (request_id)""",
    "process_requests": f"""{_masked()}, {RESULTS} SELECT request_num, original_system, original_user,
        redacted_system, redacted_user, CAST(len(m) AS BIGINT) AS n_mappings,
        llm_response_redacted, final_response, error FROM results""",
    "process_csv": f"""{_masked()}, {PICKY} SELECT request_num,
        CASE WHEN NOT bad THEN redacted_user END AS redacted_user,
        CASE WHEN NOT bad THEN answer END AS final_response,
        CASE WHEN bad THEN {LIMIT_ERROR} END AS error FROM results""",
    "summary": f"""{_masked()}, {RESULTS} SELECT count(*) AS total, count(*) FILTER (error IS NULL)
        AS successful, count(error) AS failed FROM results""",
    "preview": f"""{_masked()}, {RESULTS} SELECT request_num, {", ".join(
            f"CASE WHEN length({c}) > 60 THEN left({c}, 60) || '...' ELSE {c} END AS {c}"
            for c in ("original_system", "original_user", "redacted_system", "redacted_user"))},
        coalesce(len(m) > 0, false) AS has_pii,
        array_to_string(list_transform(m, lambda e: e.k || ' -> ' || e.v), chr(10)) AS mapping_lines,
        llm_response_redacted, final_response, error FROM results""",
    "audit_leaks": f"""{_masked()} SELECT request_num, 'open' AS variant FROM masked
        WHERE regexp_matches(original_user, '{PATTERN}')
        UNION ALL SELECT request_num, 'masked' FROM masked
        WHERE regexp_matches(redacted_user, '{PATTERN}') OR regexp_matches(redacted_system, '{PATTERN}')
        OR len(list_filter(m, lambda e: contains(redacted_user, e.v) OR contains(redacted_system, e.v))) > 0""",
    "audit_roundtrip": f"""{_masked()} SELECT request_num, 'changed' AS variant FROM masked
        WHERE contains(redacted_system, 'US_SSN_')
        UNION ALL SELECT request_num, 'kept' FROM masked WHERE {_restore('redacted_user')} <> original_user
        OR {_restore('redacted_system')} <> original_system""",
    "audit_partial": f"""{STREAM} SELECT DISTINCT occ.request_id, seq, k AS placeholder, 'raw' AS variant
        FROM occ JOIN run ON run.request_id = occ.request_id
        AND a < c - length(content) AND c - length(content) < b AND b <= c""",
    "audit_collision": f"WITH src AS ({X.COLLIDING}) SELECT * FROM src WHERE regexp_matches(text, '{TOKEN}')",
    "pii_profile": f"""{_corpus('documents', 'doc_id', 'text')}, doc AS (
            SELECT doc_id, lang, source, count(kind) FILTER (kind = 'US_SSN') AS s,
            count(kind) FILTER (kind = 'PHONE_NUMBER') AS p, count(kind) FILTER (kind = 'EMAIL_ADDRESS') AS e
            FROM documents LEFT JOIN hit ON id = doc_id GROUP BY doc_id, lang, source)
        SELECT lang, source, CAST(grouping(lang) + grouping(source) AS BIGINT) AS level,
            count(*) AS rows, count(*) FILTER (s + p + e > 0) AS rows_with_hits,
            CAST(sum(s) AS BIGINT) AS us_ssn, CAST(sum(p) AS BIGINT) AS phone_number,
            CAST(sum(e) AS BIGINT) AS email_address FROM doc GROUP BY ROLLUP (lang, source)""",
}
ORACLES["sink_events"] = f"""SELECT request_num, event_seq, type, content, final_response, error
    FROM ({ORACLES["stream_outcomes"]})"""
