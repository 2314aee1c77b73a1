"""Operators for training text against plain Python, and their odd inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskflow.llm import html, lattice, licenses, lines, masked_lm, mixing, packing, quality, queries, secrets, simhash
from maskflow.llm.common import connected, word_count
from maskflow.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t\n", None),
    (None, "hello", "b"),
    (None, "hello", "b"),
    (4, prose(1, 5000), None),
    (4, prose(1, 5000), None),
    (5, prose(2, 60), "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns with names that operators use inside.
    return docs_of(spark, ODD).withColumn("hash", F.lit(1)).withColumn("_id", F.lit("x")).withColumn("key", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# ---- shared -----------------------------------------------------------------


def test_connected(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 mixing -----------------------------------------------------------------


def plan(docs, **how):
    return mixing.plan_mix(docs, "doc_id", "source", word_count(F.col("text")), **how)


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(1, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    got = plan(docs_of(spark, rows)).collect()
    assert len(got) == 300
    total = sum(r["size"] for r in got)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and len(r["positions"]) <= 4 and r["positions"] == sorted(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
    assert math.isclose(sum(targets.values()), total)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1 and t <= 3 * sizes[s] + 1e-9
    weights = dict(zip(sorted(x for x in targets if x), (5, 2, 1, 5), strict=False)) | {None: 2}
    free = {s: targets[s] / weights[s] for s in targets if targets[s] < 3 * sizes[s] - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6


def test_mix_caps_a_small_source(spark):
    rows = [(0, "w " * 10, "a")] + [(i, "w " * 100, "b") for i in range(1, 10)]
    goal = {r["source"]: r["target"] for r in plan(docs_of(spark, rows)).collect()}
    assert goal == {"a": 30.0, "b": 880.0}


def test_due_time_inverts_the_integral(spark):
    knots = (((0.0, 1.0), (0.5, 3.0), (1.0, 0.0)),)
    shares = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    times = [r[0] for r in df.select(mixing.due_time(F.col("s"), F.lit(0), knots)).collect()]
    area = lambda t: (t + 2 * t * t) if t <= 0.5 else 1.0 + 3 * (t - 0.5) - 3 * (t - 0.5) ** 2
    assert all(math.isclose(area(t), s * 1.75, abs_tol=1e-9) for s, t in zip(shares, times, strict=True))


def test_mix_rows(spark, odd, none):
    out = mixing.mix(odd, "doc_id", "source", word_count(F.col("text")))
    rows = out.collect()
    due = [r["position"] for r in rows]
    assert out.columns == [*odd.columns, "position"] and due == sorted(due)
    copies = Counter((r["doc_id"], r["text"]) for r in rows)
    want = Counter()
    for r in plan(odd, whole=True).collect():
        want[r["doc_id"], r["size"]] += len(r["positions"])
    assert Counter({(i, len((t or "").split())): 0 for i, t in copies}) is not None
    got = Counter()
    for (i, t), n in copies.items():
        got[i, len((t or "").split())] += n
    assert got == Counter({k: n for k, n in want.items() if n})
    assert mixing.mix(none, "doc_id", "source", word_count(F.col("text"))).count() == 0


# ---- 2 secrets ----------------------------------------------------------------


def test_secret_rules():
    key = "AKIA" + "A1B2" * 4
    text = f'x password = "abcd1234" Token:short api-key=12345678 api_key:12345678é {key} {"0f" * 16} -----BEGIN RSA PRIVATE KEY-----'
    found = [(k, text[s:e]) for k, s, e in secrets.scan_text(text)]
    assert ("assign", 'password = "abcd1234') in found and ("assign", "api_key:12345678") in found
    assert ("access", key) in found and ("hex", "0f" * 16) in found
    assert [k for k, _ in found] == ["assign", "assign", "access", "hex", "pem"]
    assert secrets.scan_text(None) == [] == secrets.scan_text("")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mysql://u:" + "p" * 129 + "@h", [("url", 0, 140)]),
        ("9http://" + "u" * 65 + ":pwd@h x://a:bcd@", [("url", 1, 78)]),
        ("1eyJabcdefghi.eyJabcdefghi.sigsigsig1", [("jwt", 1, 37)]),
        ("x.eyJabcdefghi.eyJabcdefghi.sigsigsig1 eyJabcd.eyJabcdefghi.sigsigsig1", [("jwt", 2, 38)]),
    ],
)
def test_secrets_of_any_length(text, found):
    assert secrets.scan_text(text) == found


@pytest.mark.parametrize(
    "text",
    ["eyJ" * 300_000, "eyJabcdefgh." * 80_000, "a" * 10**6 + "://", "a:" * 500_000 + "://", "a://" * 250_000, "a://b:c" * 140_000, "token " * 150_000],
    ids=lambda text: text[:12],
)
def test_scan_is_linear(text):
    start = time.process_time()
    secrets.scan_text(text)
    assert time.process_time() - start < 5


def test_base_spans_against_a_plain_scan(spark):
    sf = "/root/testdata/sf0.001"
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r["text"] or ""
        hits = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
        hits += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        hits += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        named = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(hits))
        n = Counter(kind for _, _, kind, _ in hits)
        want[r["doc_id"]] = (n["assign"], n["access"], n["hex"], hashlib.sha256(named.encode()).hexdigest())
    got = queries.QUERIES["op2_secret_scan"](spark, sf).collect()
    assert {r["doc_id"]: tuple(r[1:5]) for r in got} == want and len(got) == len(want)


def test_ledger_scans_only_what_is_new(spark):
    rows = [("a", 1, "token=abcdefgh"), ("a", 2, "clean"), ("b", 1, "token=abcdefgh"), (None, 1, None)]
    history = spark.createDataFrame(rows, "path string, version int, text string")
    old, two = secrets.RULES[:1], secrets.RULES[:2]
    found, ledger = secrets.scan_history(history, ["path", "version"], "text", rules=old)
    assert ledger.count() == 3  # blobs, not rows
    hits = {(r["path"], r["version"]): len(r["spans"]) for r in found.collect()}
    assert hits == {("a", 1): 1, ("a", 2): 0, ("b", 1): 1, (None, 1): 0}
    again, more = secrets.scan_history(history, ["path", "version"], "text", ledger, old)
    assert more.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    later = history.union(spark.createDataFrame([("c", 1, "AKIA" + "Z" * 16)], history.schema))
    found, more = secrets.scan_history(later, ["path", "version"], "text", ledger, two)
    asked = {tuple(r["rules"]): r for r in more.collect()}
    assert set(asked) == {("access@1",), ("assign@1", "access@1")} and more.count() == 4
    assert {r["path"]: len(r["spans"]) for r in found.collect() if r["version"] == 1}["c"] == 1


def test_secrets_odd_rows(odd, none):
    found, _ = secrets.scan_history(odd, ["doc_id"], "text")
    assert found.count() == len(ODD)
    found, ledger = secrets.scan_history(none, ["doc_id"], "text")
    assert found.count() == 0 == ledger.count()


# ---- 3 lattice ------------------------------------------------------------------


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    assert len(lattice.roots()) == 240
    doubled = np.rint(2 * p).astype(int)
    assert np.allclose(doubled, 2 * p) and (doubled.sum(1) % 4 == 0).all() and ((doubled % 2).sum(1) % 8 == 0).all()
    others = p[:, None, :] + lattice.roots()[None] / 2
    assert (((x - p) ** 2).sum(1) <= ((x[:, None] - others) ** 2).sum(2).min(1) + 1e-9).all()


def near_by_brute(rows, cosine=0.9):
    ids, vectors = zip(*rows, strict=True)
    fine = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vectors]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = defaultdict(lambda: math.inf)
    for i in range(len(rows)):
        least[root(i)] = min(least[root(i)], ids[i])
    return sorted((ids[i], links[i], least[root(i)]) for i in range(len(rows)))


def test_lattice_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 32))
    rows = []
    for k in range(12):
        for _ in range(8):
            rows.append((base[k] + rng.normal(size=32) * 0.12).tolist())
    rows += [rows[0]] * 5 + rng.normal(size=(60, 32)).tolist() + [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i * 3, v) for i, v in enumerate(rows)]
    monkeypatch.setattr(lattice, "BLOCK", 4)  # blocks of large cells too
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lattice.near_vectors(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == near_by_brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    how = lattice.Lattice()
    x, y = lattice.cells(a, how), lattice.cells(b, how)
    assert (lattice._first_meeting(x, y)[0] < how.tables).mean() > 0.98


# ---- 4 lines ----------------------------------------------------------------------


def test_edit_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(800):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = [rng.choice("abx")] * rng.randint(0, 1)
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        wrong = df.filter(~lines.within(F.col("a"), F.col("b"), t).eqNullSafe(F.levenshtein("a", "b") <= t))
        assert wrong.count() == 0


def edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def test_lines_against_all_pairs(spark):
    rng = random.Random(9)
    pool = [prose(i, 9)[:60].ljust(45, "x") for i in range(25)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                i = rng.randint(0, len(s) - 1)
                s[i : i + rng.randint(0, 1)] = rng.choice(["", "Q", "é"])
            text.append(rng.choice(["", "  "]) + "".join(s))
        rows.append((d, "\n".join([*text, "short line"]), "s"))
    places = [(d, i, s.strip(" ").lower()) for d, t, _ in rows for i, s in enumerate(t.split("\n")) if len(s.strip(" ")) >= 40]
    want = defaultdict(list)
    for n, (d, i, s) in enumerate(places):
        if any(edits(s, o, 2) for _, _, o in places[:n]):
            want[d].append(i)
    docs = docs_of(spark, rows)
    assert {r["doc"]: r["removed"] for r in lines.removed_lines(docs).collect()} == dict(want)
    texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    for d, t, _ in rows:
        assert texts[d] == "\n".join(s for i, s in enumerate(t.split("\n")) if i not in want[d])


def test_lines_odd_rows(odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns == [*odd.columns, "removed"]
    rows = out.collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, ((i, t) for i, t, _ in ODD)))
    assert lines.dedup_lines(none).count() == 0


def test_repeated_rows_lose_a_line_once(spark, tmp_path):
    rows = [(1, "Menu\nalpha"), (2, "Menu\nbody"), (1, "Menu\nalpha"), (2, "Menu\nbody"), (3, "\tMenu\r\nother \x0b")]
    docs_of(spark, [(i, t, "s") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()
    removed = {(r["doc_id"], r["n_lines"], r["n_removed"], tuple(r["removed"])) for r in got}
    assert len(got) == 5 and removed == {(1, 2, 0, ()), (2, 2, 1, (0,)), (3, 2, 1, (0,))}


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_heavy_lines_meet_their_copies(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    rows = [(i, f"common line\nown {i:03d}", "s") for i in range(40)]
    got = {r["doc"]: list(r["removed"]) for r in lines.removed_lines(docs_of(spark, rows), fold_chars=1).collect()}
    assert got == {i: [0] for i in range(1, 40)}


def test_common_line_stays_once(spark):
    line = "a line that very many documents have in common"
    docs = docs_of(spark, [(i, f"{line}\n{prose(i, 12)}", "s") for i in range(200)])
    left = [r["text"] for r in lines.dedup_lines(docs).collect()]
    assert sum(line in t for t in left) == 1 and all(prose(i, 12) in "\n".join(left) for i in range(200))


def test_equal_short_lines_go(spark, tmp_path):
    rows = [(1, "Menu\n\n\t\nbody one\nmenu", "s"), (2, " menu \n\n\t\nbody two", "s"), (3, None, "s")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [4], 2: [0], 3: []}
    left = corpus_pipeline.line_dedup(spark, docs_of(spark, rows), "")
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: "Menu\n\n\t\nbody one", 2: "\n\t\nbody two", 3: None}


def test_normal_form_is_made_once_per_line(spark):
    spaces = " \t\x0b\x0c\r"
    rows = [(1, " \t a\x0b\r\nB \n\n \t \n\x0b\n  Ünï Ça \t"), (2, None), (3, ""), (4, spaces), (5, f"{spaces}\n{spaces}X y{spaces}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.split_lines(lines._document(docs, "doc_id", "text"), 1)
    want = {(i, k, x.strip(spaces).lower()) for i, text in rows for k, x in enumerate((text or "").split("\n")) if x.strip(spaces)}
    assert {(r["doc"], r["line"], r["body"]) for r in found.collect()} == want
    # The filter used to make the normal form again, and to translate all of it, for lines of white space.
    plan = found.select("doc", "line", "hash")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1 and "translate" not in plan


# ---- 5 licenses ---------------------------------------------------------------------


def test_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("without restriction, ", "").replace("persons", "people")
    text = f"é {prose(1, 300)} {changed} {prose(2, 30)}\nReleased under the MIT License.\n" + licenses.TEMPLATES["GPL-2.0-notice"]
    found = licenses.find(text, index)
    assert [f[0] for f in found] == ["MIT", "MIT-notice", "GPL-2.0-notice"]
    name, start, end, share = found[0]
    assert text[start:end].startswith("Permission is") and text[start:end].endswith("following conditions") and 0.9 < share < 1
    assert found[1][3] == 1.0 and text[found[1][1] : found[1][2]] == "Released under the MIT License"
    assert licenses.find(None, index) == licenses.find("", index) == licenses.find(prose(5, 2000), index) == []
    twice = "\n".join([mit, prose(3, 50), mit])
    assert [f[0] for f in licenses.find(twice, index)] == ["MIT", "MIT"]


def test_winnowing_finds_every_run_it_must():
    rng = np.random.default_rng(2)
    need = licenses.GRAM + licenses.WINDOW - 1
    for _ in range(50):
        a, b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
        b[5 : 5 + need] = a[20 : 20 + need]
        x, y = ({h for h, _ in licenses.winnow(v, 9)} for v in (a, b))
        assert x & y


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Licensed under CC BY 4.0. " * 4, ["CC-BY-4.0-notice"] * 4),
        ("Released under the MIT License.\n" * 6, ["MIT-notice"] * 6),
        ("Licensed under the Apache License, Version 2.0. " * 5, ["Apache-2.0-notice"] * 5),
        ("Released under our MIT License.", ["MIT-notice"]),
        ("Released under the new MIT License.", ["MIT-notice"]),
        ("Released under some MIT thing", []),
    ],
)
def test_short_notices_as_often_as_they_occur(text, found):
    assert [f[0] for f in licenses.find(text, licenses.Index(licenses.TEMPLATES))] == found


def test_anchors_miss_nothing_that_any_equal_word_finds():
    index, rng = licenses.Index(licenses.TEMPLATES), random.Random(5)
    words = sorted(index.ids)
    hits = 0
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 3)):
            text += rng.choices(words, k=rng.randint(0, 6))
            notice = list(index.words[rng.choice([t for t, w in enumerate(index.words) if len(w) <= licenses.SHORT])])
            text += [rng.choice(words) if rng.random() < 0.12 else words_of(index)[w] for w in notice]
        ids = np.array([index.ids[w] for w in text])
        for t, own in enumerate(index.words):
            if len(own) <= licenses.SHORT:
                seeds = [(at, i) for at in range(len(ids)) for i in range(len(own)) if ids[at] == own[i]]
                anchors = [(at, i) for at, i in seeds if (t, i) in index.anchors.get(int(own[i]), ())]
                plain, quick = (licenses.matches_of(t, s, ids, index, 0.8) for s in (seeds, anchors))
                hits += len(plain)
                assert len(plain) == len(quick)
    assert hits > 200


def words_of(index):
    return {i: w for w, i in index.ids.items()}


def test_licenses_are_linear_in_notices():
    index = licenses.Index(licenses.TEMPLATES)
    start = time.process_time()
    assert len(licenses.find("Released under the MIT License. " * 8000, index)) == 8000
    assert time.process_time() - start < 25


def test_licenses_odd_rows(odd, none):
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(none).count() == 0


# ---- 6 simhash --------------------------------------------------------------------------


def test_fingerprint_by_brute_force():
    import xxhash

    for text in (prose(3, 40), "One two", "A b c d", "É x " * 30, " a\x0bb\x0cc d e "):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = [w for w in low.replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_edges_connect_all_near_pairs(spark, monkeypatch):
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(1500)]
    for v in values[:300]:
        for b in rng.sample(range(64), rng.randint(1, 5)):
            v ^= 1 << b
        values.append(v)
    values = list(dict.fromkeys(values))
    monkeypatch.setattr(simhash, "SAMPLE", 400)
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.near_edges(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    got = {r[0]: r[1] for r in connected(edges).collect()}
    bits = np.array(values, dtype=np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    for i in range(len(values)):
        group = {signed[j] for j in np.flatnonzero(near[i])}
        assert len({got.get(v, v) for v in group}) == 1
    assert len({got.get(v, v) for v in signed}) > 1000


def test_keep_one(spark, odd, none):
    out = simhash.keep_one(odd)
    kept = [(r["doc_id"], (r["text"] or "").strip()) for r in out.collect()]
    assert out.columns == odd.columns
    # 1, 2 and 3 have no words; the two null ids and the two of 4 are copies.
    assert sorted(map(str, kept)) == sorted(map(str, [(1, ""), (None, "hello"), (4, prose(1, 5000)), (5, prose(2, 60))]))
    assert simhash.keep_one(none).count() == 0
    near = prose(7, 400)
    docs = docs_of(spark, [(9, near + " end", "s"), (8, near, "s"), (7, prose(11, 400), "s")])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [7, 8]


# ---- 7 quality -----------------------------------------------------------------------------


def measures_by_hand(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    rows = [r for r in (text or "").split("\n") if r.strip(" \t\x0b\x0c\r")]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    cover = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(cover))


def test_measures(spark, odd, none):
    texts = [prose(1, 300), "a b c a b c a b c d", "x y z\nx y z\n\n x y", "# $ | é", None, "", "a b", "a a a a a"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = quality.with_measures(docs).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measures_by_hand(r["text"])
    assert quality.with_measures(odd).count() == len(ODD) and quality.with_measures(none).count() == 0


def test_cascade_keeps_the_verdict_in_any_order(spark, odd, none):
    texts = [prose(1, 300), "a b c " * 40, prose(2, 30), prose(3, 80).replace(" ", " # "), "\n".join([prose(4, 30)] * 9), "ab" * 900]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    kept = [r["doc_id"] for r in quality.keep_good(docs).collect()]
    assert kept == [0]
    for order in (quality.RULES, quality.RULES[::-1]):
        assert [r["doc_id"] for r in quality.cascade(docs, "text", order).filter("rejected_by IS NULL").collect()] == kept
    found = quality.estimate(docs)
    assert {n: s for n, s, _ in found}["few_words"] == 2 / 6
    assert quality.order_rules([("a", 0.1, 1.0), ("few_words", 0.5, 1.0)] + [(r.name, 0.0, 1.0) for r in quality.RULES[1:]])[0].name == "few_words"
    assert quality.keep_good(none).count() == 0 and quality.keep_good(odd).columns == odd.columns


# ---- 8 html ------------------------------------------------------------------------------


def test_main_text_by_markup():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='menu-page'>"
        "<header>Top</header><nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='ad'>Buy</div>"
        "<article><header><h1>Head &amp; <i>line</i></h1></header><p>One\n two<br>three</p><p><b>Open<br><p>last &lt;x&gt;"
        "<aside>Side</aside><form>Mail <input></form><div class='cookie-notice'>Cookies</div>"
        "<section id='comments'><article>Reader says</article></section><ul><li>a</li><li>b</li></ul></article>"
        "<footer>&copy; F</footer><!-- c --></body></html>"
    )
    assert html.main_text(page) == "Head & line\nOne two three\nOpen\nlast <x>\na\nb"
    assert html.main_text("<div>open <b>text</b></div>tail") == "open text\ntail"
    assert html.main_text("<nav>menu<article><p>x</p></article>") == "x"
    assert html.main_text("<article>a<p>cut short") == "a\ncut short"
    assert html.main_text(None) == html.main_text("") == html.main_text("<!-- open") == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h1>H</h1><div class="overflow-hidden"><p>The whole story.</p></div></article>', "H\nThe whole story."),
        *[
            (f"<article><h1>H</h1><div class='{name}'><p>kept</p></div></article>", "H\nkept")
            for name in ("side-by-side", "related-work", "alert-system", "form-factor", "social-history", "search-results", "article-header")
        ],
        *[
            (f"<article><h1>H</h1><div class='{name}'><p>gone</p></div></article>", "H")
            for name in ("cookie-notice", "siteFooter", "share_buttons", "x ad", "comment-list", "sidebar left")
        ],
        ("<article><section id='search'>How to search</section><section id='comments'>no</section></article>", "How to search"),
        ("<div id=post>Post text</div><article class='comment'>reader says</article>", "Post text"),
        ("<article>Text</article><section id=comments><article>Reader</article></section>", "Text"),
        ("<article>Text</article><aside><article>Teaser</article></aside>", "Text"),
        ("<form id=page><article>Text</article></form>", "Text"),
        ("<article><p>x <span class=share>Share</p><p>Text <span class='ad'>Buy</span> on</p></article>", "x\nText on"),
        ("<article><p class=ad>Buy<p>Text</p></article>", "Text"),
        ("<article><a title='x > y'>link</a> 1 < 2 &amp; 3</article>", "link 1 < 2 & 3"),
        ("<article><p>it's <a b=c>don't</a></p></article>", "it's don't"),
        ("<article><svg>in<p>yes</p></article>", "in\nyes"),
        ("<article hidden>no</article><article aria-hidden=false><p>yes</article>", "yes"),
        ("<article><div style='display: none'>no</div><a x='unclosed>text</a> more</article>", "text more"),
    ],
)
def test_main_text_of_odd_markup(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000,
        "<a x='" * 170_000,
        "<a ='" * 200_001 + ">",
        "<div>" * 200_000,
        "<div>" * 90_000 + "</section>" * 90_000,
        "<table><article>" + "<div>" * 60_000 + "</table>" * 60_000,
        "<svg>" * 200_000,
        "<!--" * 250_000,
        "<span class=ad>" * 50_000 + "</p>" * 50_000,
        "<div a" + " " * 1_000_000 + ">",
        "</script" * 120_000 + "<script>x",
        "<noscript></noscript " * 50_000,
        "&#" * 500_000,
    ],
    ids=lambda page: page[:12],
)
def test_parse_is_linear(page):
    start = time.process_time()
    html.blocks_of(page)
    assert time.process_time() - start < 8


def test_repeated_runs_of_a_host_go(spark, odd):
    menu, legal = "Home News Sport Weather Travel About us today", "All rights reserved by the owners of this site"
    rows = []
    for i in range(6):
        body = prose(i, 30)
        rows.append((i, f"http://h.org/{i}", f"<div>{menu}</div><div>{body} {legal}</div>"))
    rows += [(6, "http://other.org/1", f"<div>{menu}</div>"), (7, None, None), (7, None, None), (8, "odd", "<div>alone here</div>")]
    # A copy of an article on the same host is no boilerplate.
    article = f"<article><p>{prose(99, 40)}</p></article>"
    rows += [(9, "http://h.org/9", article), (10, "http://H.org:80/10", article)]
    got = {r["page_id"]: r["main_text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == prose(i, 30)
    assert got[6] == menu and got[7] == "" and got[8] == "alone here" and got[9] == got[10] == prose(99, 40)
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://x.y/").alias("url"), F.col("text").alias("html"), "key")
    assert html.extract(pages).count() == len(ODD) and html.extract(pages.limit(0)).count() == 0


def test_repeats_do_not_cut_real_text(spark):
    phrase = "as the old saying has it"
    menu = "Home News Sport Weather Travel About us today"
    rows = [
        # Copies of one page, by different urls.
        (1, "http://a.org/x", f"<div>{prose(1, 40)}</div>"),
        (2, "https://a.org/x?s=1", f"<div>{prose(1, 40)}</div>"),
        # A heading that the menus of other pages name, and a phrase on two pages of six.
        (3, "http://b.org/0", f"<h1>Seven days in the far quiet north</h1><div>{prose(2, 9)} {phrase} {prose(3, 9)}</div>"),
        (4, "http://b.org/1", f"<div>{prose(4, 9)} {phrase} {prose(5, 9)}</div>"),
        *[(5 + i, f"http://b.org/{2 + i}", f"<ul><li>Seven days in the far quiet north</li></ul><div>{menu}</div><p>{prose(6 + i, 9)}</p>") for i in range(4)],
        # Pages without a host.
        *[(20 + i, None, f"<div>{menu}</div><p>{prose(20 + i, 9)}</p>") for i in range(4)],
    ]
    got = {r["page_id"]: r["main_text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == prose(1, 40)
    assert got[3] == f"Seven days in the far quiet north\n{prose(2, 9)} {phrase} {prose(3, 9)}"
    assert got[4] == f"{prose(4, 9)} {phrase} {prose(5, 9)}"
    for i in range(4):
        assert got[5 + i] == prose(6 + i, 9) and got[20 + i] == f"{menu}\n{prose(20 + i, 9)}"


def test_repeats_of_articles_go(spark):
    share = "Share this story with your friends and family"
    rows = [(i, f"http://h.org/{i}", f"<article><h1>Seven days in the far quiet north</h1><p>{prose(i, 30)}</p><p>{share}</p></article>") for i in range(6)]
    # In one sentence, in the middle of a block, and alone on its host.
    rows += [(6, "http://h.org/6", f"<article><p>{prose(6, 9)} {share} {prose(7, 9)}</p></article>")]
    rows += [(7, "http://other.org/1", f"<article><p>{prose(8, 9)}</p><p>{share}</p></article>")]
    # Changed copies of one article.
    rows += [(10 + i, f"http://c.org/{i}", f"<article><p>{prose(50, 30)}</p><p>{prose(51 + i, 9)}</p></article>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["main_text"] for r in html.extract(pages).collect()}
    for i in range(6):
        assert got[i] == f"Seven days in the far quiet north\n{prose(i, 30)}"
    assert got[6] == f"{prose(6, 9)} {share} {prose(7, 9)}" and got[7] == f"{prose(8, 9)}\n{share}"
    for i in range(4):
        assert got[10 + i] == f"{prose(50, 30)}\n{prose(51 + i, 9)}"


def test_repeats_are_those_of_sorted_suffixes(spark):
    rng = random.Random(3)
    rows = [(rng.choice("hk"), " ".join(rng.choice("ab") for _ in range(rng.randint(3, 6))), i) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = html.repeats(spark.createDataFrame(rows, "host string, head string, key long").repartition(3), 3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups, plain = {}, {}
    for r in found:
        groups.setdefault(tuple(r["repeat"]), []).append(r["key"])
    for host, head, key in rows:
        plain.setdefault((host, head[:5]), []).append(key)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values())) and len(found) == 600


# ---- 9 language model -----------------------------------------------------------------------


def test_network_learns_both_sides(spark):
    rng = random.Random(2)

    def text(n):
        out = []
        for _ in range(n):
            left = rng.choice("abcd")
            out += [left, {"a": "x", "b": "y", "c": "z", "d": "w"}[left], rng.choice("mn")]
        return " ".join(out)

    shape = masked_lm.Shape(known=16, hashed=8, wide=8, stride=1, rounds=3)
    docs = docs_of(spark, [(i, text(80), "s") for i in range(80)]).repartition(2)
    common, weights = masked_lm.train(docs, "text", shape)
    assert set(common) == {w.encode() for w in "abcdxyzwmn"}
    held = [text(80) for _ in range(5)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    test = docs_of(spark, [(i, t, "s") for i, t in enumerate(held + mixed + [None, ""])])
    got = {r["doc_id"]: r for r in masked_lm.score(test, common, weights, "text", shape).collect()}
    good, bad = (sum(got[i]["mean_log_prob"] for i in ids) / 5 for ids in (range(5), range(5, 10)))
    classes = Counter(w for t in held for w in t.split())
    total = sum(classes.values())
    alone = sum(n / total * math.log(n / total) for n in classes.values())
    assert good > alone + 0.3 and good > bad + 0.5
    assert (got[10]["n_words"], got[10]["log_prob"], got[10]["mean_log_prob"]) == (0, 0.0, None)


def test_registered_training_uses_every_place(spark):
    shape = masked_lm.Shape()
    for n in (1, 2, 7, 50):
        for first in range(9):
            met = np.concatenate([masked_lm.trained(n, first, turn, shape.stride) for turn in range(shape.rounds)])
            assert sorted(met.tolist()) == sorted(list(range(n)) * (shape.rounds // shape.stride))
    # A text shorter than its offset used to give nothing.
    word = next(w for w in "abcdefgh" if {(zlib.crc32(w.encode()) + 1 + 3 * turn) % 8 for turn in range(2)}.isdisjoint({0}))
    _, weights = masked_lm.train(docs_of(spark, [(1, word, "s")]))
    assert not np.array_equal(weights, masked_lm.Network(shape).flat)


def test_scores_are_of_words_not_of_classes(spark):
    shape = masked_lm.Shape(known=2, hashed=1, wide=4)
    corpus = ["a b a b a b a b often often often often seen seen once a b", "a b often A B seen"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate([*corpus, corpus[0], None])])
    met = masked_lm.met_words(docs)
    counts = masked_lm.count_words(met)
    got = {bytes(r["word"]).decode(): r["n"] for r in counts.collect()}
    assert got == Counter(w for t in [*corpus, corpus[0]] for w in t.lower().split())
    common, weights = masked_lm.train(docs, "text", shape, masked_lm.common_words(counts, shape.known))
    rare = {w: n for w, n in got.items() if w.encode() not in common}
    total = sum(rare.values()) + 1
    texts = ["a often b", "a once b", "a zzz b", "a b", "", "a often b", corpus[0]]
    test = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    by_class = {r["doc_id"]: r["log_prob"] for r in masked_lm.score(test, common, weights, "text", shape).collect()}
    by_word = {r["doc_id"]: r["log_prob"] for r in masked_lm.score(test, common, weights, "text", shape, counts).collect()}
    assert len(by_word) == len(texts)
    for i, t in enumerate(texts):
        inner = sum(math.log(rare.get(w, 1) / total) for w in t.split() if w.encode() not in common)
        assert math.isclose(by_word[i], by_class[i] + inner, rel_tol=1e-9, abs_tol=1e-9)
    assert by_class[0] == by_class[1] == by_class[2] and by_word[0] > by_word[1] > by_word[2] and by_word[0] == by_word[5]


def test_gradient_by_differences():
    shape = masked_lm.Shape(known=3, hashed=2, wide=4, rate=1e-3)
    net = masked_lm.Network(shape)
    around, target = np.array([[0, 1, 2, 5], [3, 3, 0, 1]], dtype=np.int32), np.array([1, 4])
    before = net.flat.copy()
    net.step(around, target, np.full(len(net.flat), 1e12, dtype=np.float32))
    moved = (before - net.flat) * 1e6 / shape.rate
    for k in np.flatnonzero(np.abs(moved) > 1e-3)[::7]:
        a, b = before.astype(float), before.astype(float)
        a[k] += 1e-2
        b[k] -= 1e-2
        high, low = (masked_lm.Network(shape, f).log_probs(around, target).mean() for f in (a, b))
        assert math.isclose(-(high - low) / 2e-2, moved[k], rel_tol=0.05, abs_tol=2e-2)


def test_scoring_reads_the_class_table(spark):
    # Scoring used to split and class all texts once more, in Python workers beside the training's.
    shape = masked_lm.Shape(known=4, hashed=2, wide=4)
    corpus = ["a b c d e f g", "a b", "b c a", None, "", "a b", "a  B\n"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(corpus)])
    common = masked_lm.common_words(masked_lm.count_words(masked_lm.met_words(docs)), shape.known)
    texts, _ = masked_lm.class_table(docs, common, "text", shape)
    assert texts.count() == 5
    _, weights = masked_lm.train(docs, "text", shape, common, texts)
    found = masked_lm.score(docs, common, weights, "text", shape, texts=texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    net, classes = masked_lm.Network(shape, weights), masked_lm.Classes(common, shape)
    for r in found.collect():
        ids = classes(masked_lm.words_of(r["text"]))
        around = masked_lm.neighbours(ids, np.arange(len(ids)), shape.classes)
        hidden = np.tanh(sum(net.tables[k][around[:, k]].astype(float) for k in range(4)))
        z = hidden @ net.out[:-1] + net.out[-1]
        want = (z[np.arange(len(ids)), ids] - np.log(np.exp(z).sum(axis=1))).sum()
        assert r["n_words"] == len(ids) and math.isclose(r["log_prob"], want, rel_tol=1e-5, abs_tol=1e-9)


@pytest.mark.parametrize("scale", [1, 1000])
def test_step_over_blocks_equals_plain_gradient(scale):
    shape = masked_lm.Shape(known=5, hashed=4, wide=3, rate=1.0)
    rng = np.random.default_rng(1)
    n, places = shape.classes, 2 * masked_lm.BLOCK + 3
    around, target = rng.integers(0, n + 1, (places, 4)).astype(np.int32), rng.integers(0, n, places)
    net = masked_lm.Network(shape)
    net.out *= scale
    assert net.far() == (scale > 1)
    before = net.flat.astype(float)
    squares = np.zeros(len(before), dtype=np.float32)
    hidden = np.tanh(sum(net.tables[k][around[:, k]].astype(float) for k in range(4)))
    z = hidden @ net.out[:-1] + net.out[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(places), target] -= 1
    z /= places
    back = (z @ net.out[:-1].T) * (1 - hidden**2)
    tables = np.zeros((4, n + 1, 3))
    for k in range(4):
        np.add.at(tables[k], around[:, k], back)
    want = np.concatenate([tables.ravel(), (hidden.T @ z).ravel(), z.sum(axis=0)])
    net.step(around, target, squares)
    assert np.allclose(np.sqrt(squares), np.abs(want), rtol=1e-3, atol=1e-5)
    moved = np.abs(want) > 1e-3
    assert np.array_equal(np.sign(before - net.flat)[moved], np.sign(want)[moved])


def test_lm_odd_rows(odd, none):
    common, weights = masked_lm.train(odd)
    assert masked_lm.score(odd, common, weights).count() == len(ODD)
    common, weights = masked_lm.train(none)
    assert common == [] and masked_lm.score(none, common, weights).count() == 0


# ---- 10 packing -------------------------------------------------------------------------------


def tokens_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [0]


def test_pack_round_trip(spark, odd, none):
    texts = [t for _, t, _ in ODD] + ["It's 'll\x1cx y Ａ é́ don't", "İstanbul ΣΑΣ 12 a b <|endoftext|>"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = packing.pack(docs, tokenizer_path(), tokens=512).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids, pieces = tokens_of(t), sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // 512)))
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert len(part) == p["length"] == min(512, len(ids) - p["start"])
            assert p["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert packing.pack(odd, tokenizer_path()).select("doc_id").count() >= len(ODD)
    assert packing.pack(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(score):
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 900, 1500)
    sequence, offset = packing.best_fit(lengths, 1000, 4, 8.2e5, score)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 1000 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 8.2e5
        order = np.argsort(offset[sequence == s])
        assert (offset[sequence == s][order] == np.concatenate([[0], np.cumsum(own[order])[:-1]])).all()


def test_best_fit_is_tight():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 1024, 6000)
    sequence, _ = packing.best_fit(lengths, 2048, 2048, 2048.0**2)
    assert sequence.max() + 1 <= math.ceil(lengths.sum() / 2048) * 1.01
    assert len(packing.best_fit(np.array([], dtype=np.int64), 2048, 10, 1e6)[0]) == 0


def test_encoder_gives_the_ids_of_the_whole_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    texts = [
        "",
        None,
        "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b plain",
        "I'm it'LL 'S don't a,b12.5",
        "a b c d\x85e \x1cx \x00\x01",
        "é É é ß ẞ İ ı ſ Σας ǅ",
        "日本語 한국어 \U0001f600x ½²",
        "a" * 5000,
        prose(3, 3000) + " œuvre " + prose(4, 3000),
    ]
    whole = Tokenizer.from_file(tokenizer_path())
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for remember in (packing.REMEMBER, 50):
        monkeypatch.setattr(packing, "REMEMBER", remember)
        encode = packing._Encoder(tokenizer_path())
        assert [encode(t or "") for t in texts + texts[::-1]] == want + want[::-1]


def test_a_worker_remembers_words_in_little_memory():
    """56 MB when each word and piece was an object with a dictionary entry; two workers of an executor held 370 MB each."""
    import tracemalloc

    rng = np.random.default_rng(11)
    words = ["".join(w) for w in rng.choice(list("abcdefghij"), (200_000, 8))]
    encode = packing._Encoder(tokenizer_path())
    encode("a first word")
    tracemalloc.start()
    try:
        for i in range(0, len(words), 20_000):
            encode(" ".join(words[i : i + 20_000]))
        assert tracemalloc.get_traced_memory()[0] < 30_000_000
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("remember", [10**9, 400])
def test_memory_of_strings_is_exact(monkeypatch, remember):
    """Strings that differ in a zero byte, in length or beyond the short part; ids are learnt again once forgotten."""
    monkeypatch.setattr(packing, "REMEMBER", remember)
    odd = ["", "\0", "\0\0", "a", "a\0", "a" * 14, "a" * 15, "a" * 15 + "\0", "a" * 16, "é" * 7, "é" * 8, "b" * 300]
    rng = np.random.default_rng(12)
    words = odd + ["".join(w) for n in (3, 6, 15, 17) for w in rng.choice(list("xyz"), (300, n))]
    ids_of = {w: [len(w), *w.encode()] if w else [] for w in words}
    learnt = []

    def learn(new):
        learnt.extend(new.to_pylist())
        return packing.one_by_one([ids_of[w] for w in new.to_pylist()])

    memory = packing._Memory(learn)
    for _ in range(60):
        some = list(dict.fromkeys(rng.choice(np.array(words, dtype=object), rng.integers(0, 120))))
        flat, first, size = memory(pa.array(some, pa.string()))
        assert [flat[a : a + n].tolist() for a, n in zip(first, size, strict=True)] == [ids_of[w] for w in some]
    assert (len(learnt) == len(set(learnt))) == (remember > 400)
