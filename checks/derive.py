"""Inputs derived from the given tables.

Each expression is plain SQL that Spark and the checking engine both run, so
the two sides start from the same texts.
"""

from __future__ import annotations

_NUM = "CAST(c_custkey AS STRING)"
_LAST4 = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"

# Prompts with all three entity types, some of them missing, clean or quoted.
SYSTEM = f"""CASE c_custkey % 7
    WHEN 0 THEN NULL
    WHEN 1 THEN 'You are a helpful assistant.'
    ELSE 'Client ' || c_name || ' SSN: 856-' || lpad(CAST(c_custkey % 99 + 1 AS STRING), 2, '0')
         || '-' || {_LAST4} END"""
PROMPT = f"""CASE c_custkey % 11
    WHEN 0 THEN 'n/a'
    WHEN 1 THEN 'This is a normal sentence without any PII.'
    WHEN 2 THEN 'First line,' || chr(10) || 'he said "write to x_' || {_NUM}
         || '@sub.example.org", or +44 (123) 456-' || {_LAST4}
    ELSE 'My email is u' || {_NUM} || '@example.com or a.b' || {_NUM}
         || '@mail.co.uk, phone 555-123-' || {_LAST4} || ' or (555) 123-4567.' END"""
REQUESTS = f"""SELECT c_custkey + 1 AS request_num, {SYSTEM} AS system_prompt,
    {PROMPT} AS prompt FROM customer"""

# Texts in which rules overlap or touch.
OVERLAP = f"""SELECT c_custkey, 'id 555-123-' || {_LAST4} || '@mail.com, 856-45-' || {_LAST4}
    || '-555-123-' || {_LAST4} || ' +1 555.123.' || {_LAST4} || '.x@y.org' AS text FROM customer"""

# Texts that already hold something like a placeholder.
COLLIDING = f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'see EMAIL_ADDRESS_' || {_LAST4}
    WHEN c_custkey % 5 = 1 THEN 'EMAIL_ADDRESS_12 or US_SSN_' ELSE c_name END AS text FROM customer"""

# Recorded answers: 0 none, 1 a null answer, 2 a failure, else an echo.
HAS_RESPONSE = "request_num % 10 <> 0"
RESPONSE = """CASE WHEN request_num % 10 NOT IN (1, 2)
    THEN 'Re: ' || redacted_user || ' / ' || redacted_system || ' end' END"""
RESPONSE_ERROR = "CASE WHEN request_num % 10 = 2 THEN 'API timeout' END"

# Streamed answers and their chunks. Every fifth stream breaks off at chunk 9.
STREAMED = "'Dear ' || redacted_system || ', I wrote to ' || redacted_user || ' today'"
CHUNK = "(?s).{1,7}"
CHUNK_LONG = "(?s).{1,64}"
BROKEN = "request_num % 5 = 0"
BROKEN_AT = 9
BROKEN_CAUSE = "connection lost"

# Answers that name placeholders of a customer's request, for the vault.
ORDER_ANSWERS = """SELECT o_orderkey, o_custkey + 1 AS request_num,
    'Order ' || CAST(o_orderkey AS STRING) || ': mail EMAIL_ADDRESS_0002, else EMAIL_ADDRESS_0001, '
    || o_orderpriority || ' US_SSN_0001 or EMAIL_ADDRESS_0777.' AS answer FROM orders"""

ENTITY_BY_KEY = """CASE o_orderkey % 3 WHEN 0 THEN 'US_SSN' WHEN 1 THEN 'EMAIL_ADDRESS'
    ELSE 'PHONE_NUMBER' END"""
