"""Released chunks against a model of a reader that gets chunk after chunk."""

import random
import time

import pytest
from pyspark.sql import functions as F

import maskflow as mf
from maskflow.functions.restore import Restorer
from maskflow.operators import holdback as H


def model(chunks, mapping):
    """What a careful reader shows after each chunk, and at the end."""
    hold = max(map(len, mapping), default=0)
    text = "".join(chunks)
    spans = [(i, i + len(k)) for k in mapping for i in range(len(text)) if text.startswith(k, i)]

    def safe(length):
        cut = max(0, length - hold)
        return next((a for a, b in spans if a < cut < b), cut)

    def shown(part):
        for k, v in mapping.items():
            part = part.replace(k, v)
        return part

    out, done, total = [], 0, 0
    for c in chunks:
        total += len(c)
        out.append(shown(text[done : safe(total)]))
        done = safe(total)
    return out, shown(text[done:])


def tables(spark, cases):
    chunks = [(r, i, c) for r, (cs, _) in enumerate(cases) for i, c in enumerate(cs)]
    maps = [(r, m) for r, (_, m) in enumerate(cases) if m]
    return (
        spark.createDataFrame(chunks, "request_id long, seq long, content string").repartition(3),
        spark.createDataFrame(maps, "request_id long, mapping map<string,string>"),
    )


def check(spark, cases):
    got = mf.release_chunks(*tables(spark, cases)).collect()
    by = {(r.request_id, r.seq): r.content for r in got}
    assert len(by) == len(got)
    for i, (chunks, mapping) in enumerate(cases):
        out, rest = model(chunks, mapping)
        assert [by.pop((i, k)) for k in range(len(chunks))] == out, chunks
        assert by.pop((i, None)) == rest
    assert not by


MAIL = {"EMAIL_ADDRESS_0001": "john@example.com"}
LITERALS = [
    (["Hello ", "world! This is a "], MAIL),
    (["Contact us at ", "EMAIL_", "ADDRESS_", "0001 please"], MAIL),
    (["Contact EMAIL_ADDRESS_0001 at ", "PHONE_NUMBER_0001 today"], {**MAIL, "PHONE_NUMBER_0001": "555-1234"}),
    (["Send to EMAIL_ADDRESS_0001 ", "and CC EMAIL_ADDRESS_0001 ", "for all updates"], MAIL),
    (["My SSN is SSN_0001"], {"SSN_0001": "123-45-6789"}),
    (["12345", "6789012345"], {"ABC_0001": "replaced"}),
    (["This is ", "just normal ", "text without ", "any placeholders."], MAIL),
    (["Start ABC_", "0001 end"], {"ABC_0001": "XYZ"}),
    (["word " * 20] * 50, MAIL),
    (["A_0001B_0001C_0001"], {"A_0001": "X", "B_0001": "Y", "C_0001": "Z"}),
    (["no ", "mapping"], {}),
]


def test_literals(spark):
    check(spark, LITERALS)
    out = mf.release_chunks(*tables(spark, LITERALS)).collect()
    assert {r.seq: r.content for r in out if r.request_id == 5} == {0: "", 1: "1234567", None: "89012345"}


def cases(n, size, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        names = [f"{t}_{rnd.randint(1, 30):04d}" for t in rnd.choices(mf.ENTITIES, k=rnd.randint(0, 5))]
        mapping = {k: f"<{i}é$1>" for i, k in enumerate(names)}
        words = [*names, "US_SSN_", "EMAIL_ADDRESS_0099", "x", "é ", " and ", "_0001"] * 2
        text = "".join(rnd.choice(words) for _ in range(rnd.randint(1, size)))
        chunks = []
        while text:
            k = rnd.choice([1, 2, 7, 30, 300])
            chunks.append(text[:k])
            text = text[k:]
        out.append((chunks, mapping))
    return out


def test_random(spark):
    check(spark, cases(150, 20, 5))


@pytest.mark.parametrize("size", [1, 3, 64])
def test_long_request_spreads_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(H, "RANGE", size)
    many = cases(6, 600, 8) + cases(30, 10, 9)
    check(spark, many)
    chunks, mappings = tables(spark, many)
    rows = mf.full_answers(chunks, mappings).collect()
    assert len(rows) == len(many)
    for i, (cs, mapping) in enumerate(many):
        mine = [r for r in rows if r.request_id == i]
        assert "".join(r.llm_response_redacted for r in mine) == "".join(cs)
        out, rest = model(cs, mapping)
        assert "".join(r.final_response for r in mine) == "".join(out) + rest


def test_split_placeholders(spark):
    many = cases(60, 25, 4)
    chunks, mappings = tables(spark, many)
    want = set()
    for i, (cs, mapping) in enumerate(many):
        text, start = "".join(cs), 0
        for k, c in enumerate(cs):
            end = start + len(c)
            for name in mapping:
                for a in range(max(0, start - len(name)), start):
                    if text.startswith(name, a) and start < a + len(name) <= end:
                        want.add((i, k, name))
            start = end
    got = H.split_placeholders(chunks, mappings).collect()
    assert want and {tuple(r) for r in got} == want
    assert H.splits(chunks, mappings).filter("held").count() == 0
    held = H.released_pieces(chunks, mappings)
    assert H.split_placeholders(held, mappings).count() == 0


def many_hits(n):
    """A request with n placeholders, beyond four digits, and its answer in chunks."""
    mapping = {f"EMAIL_ADDRESS_{i:04d}": f"<{i}>" for i in range(1, n + 1)}
    return ["".join(f"{k}, " for k in list(mapping)[i : i + 3]) for i in range(0, n, 3)], mapping


def test_more_than_ten_thousand_hits(spark):
    chunks, mapping = many_hits(10_500)
    want = "".join(f"<{i}>, " for i in range(1, 10_501))
    both = tables(spark, [(chunks, mapping)])
    out = mf.release_chunks(*both).collect()
    shown = sorted(out, key=lambda r: (r.seq is None, r.seq))
    assert "".join(r.content for r in shown) == want
    (answer,) = mf.full_answers(*both).collect()
    assert answer.final_response == want


def test_time_grows_with_the_hits_alone(spark):
    def seconds(n):
        both = [d.cache() for d in tables(spark, [many_hits(n)])]
        for d in both:
            d.count()
        mf.full_answers(*both).collect()
        began = time.perf_counter()
        mf.full_answers(*both).collect()
        mf.release_chunks(*both).collect()
        return time.perf_counter() - began

    few, many = seconds(4_000), seconds(16_000)
    assert many < 6 * few + 1


def test_unknown_longer_tokens_are_not_misread(spark):
    # However it is cut, the number 00015 is not 0001 and a 5.
    text = "to EMAIL_ADDRESS_00015 and MYUS_SSN_0001, EMAIL_ADDRESS_0001 US_SSN_000123"
    mapping = {"EMAIL_ADDRESS_0001": "a@b.c", "US_SSN_0001": "856"}
    want = "to EMAIL_ADDRESS_00015 and MY856, a@b.c US_SSN_000123"
    cuts = [([text[:i], text[i:j], text[j:]], mapping) for i in range(1, len(text), 2) for j in range(i + 1, len(text), 5)]
    out = {}
    for r in sorted(mf.release_chunks(*tables(spark, cuts)).collect(), key=lambda r: (r.seq is None, r.seq)):
        out[r.request_id] = out.get(r.request_id, "") + r.content
    assert out == dict.fromkeys(range(len(cuts)), want)
    reader = Restorer(mapping)
    for chunks, _ in cuts:
        shown, held = "", ""
        for c in chunks:
            held += c
            cut = reader.safe_length(held)
            shown, held = shown + reader.restore(held[:cut]), held[cut:]
        assert shown + reader.restore(held) == want


def test_empty_chunks_count_for_nothing(spark):
    chunks = spark.createDataFrame(
        [(1, 0, "a"), (1, 1, None), (1, 2, ""), (1, 3, "b")], "request_id long, seq long, content string"
    )
    none = spark.createDataFrame([], "request_id long, mapping map<string,string>")
    out = mf.release_chunks(chunks, none).filter(F.col("seq").isNotNull()).collect()
    assert {(r.seq, r.content) for r in out} == {(0, "a"), (3, "b")}


def test_broken_answers_are_restored_once(spark):
    chunks = spark.createDataFrame([(i, k, "x US_SSN_") for i in range(3) for k in range(2)], "request_id long, seq long, content string")
    mappings = spark.createDataFrame([(i, {"US_SSN_0001": "1"}) for i in range(3)], "request_id long, mapping map<string,string>")
    broken = spark.createDataFrame([(1, "lost"), (1, "lost"), (None, "lost")], "request_id long, error string")
    released = mf.release_chunks(chunks, mappings, broken)
    rows = released.collect()
    assert sorted(r.request_id for r in rows if r.seq is None) == [0, 2] and len(rows) == 8
    # One branch: what is released is made once, and the rests are part of it.
    assert "Union" not in released._jdf.queryExecution().optimizedPlan().toString()
