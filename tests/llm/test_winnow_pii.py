import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import pii, winnow
from quillstone.llm.queries import op9_winnow, op10_pii


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def slow_fingerprint(text, gram=winnow.GRAM, window=winnow.WINDOW):
    words = [signed(xxhash.xxh64_intdigest(w, 42)) % winnow.MODULUS for w in (text or "").encode().split()]
    if not words:
        return []
    grams = []
    for i in range(max(1, len(words) - gram + 1)):
        h = 0
        for v in words[i : i + gram]:
            h = (h * winnow.BASE + v) % winnow.MODULUS
        grams.append(xxhash.xxh64_intdigest(struct.pack("<q", h), 42))
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        least = min(g >> 32 for g in grams[i : i + window])
        at = max(k for k in range(i, min(len(grams), i + window)) if grams[k] >> 32 == least)
        if out[-1:] != [(at, grams[at])]:
            out.append((at, grams[at]))
    return out


def as_text(fp):
    return ",".join(f"{p}:{h:x}" for p, h in fp)


def likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_query_against_plain_version(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    ids = sorted(texts)
    prints = {i: slow_fingerprint(texts[i]) for i in ids}
    found = {r.doc_id: r for r in op9_winnow(spark, sf_dir).collect()}
    for n, i in enumerate(ids):
        text, following = texts[i], ids[(n + 1) % len(ids)]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[following][:half]
        r, after = found[i], slow_fingerprint(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(prints[i]), as_text(after))
        assert r.near_edited == pytest.approx(likeness(prints[i], after)) and r.near_next == pytest.approx(likeness(prints[i], prints[following]))


def test_guarantee_and_ties(spark):
    shared = " ".join(f"s{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    a, b = " ".join(f"a{i}" for i in range(40)) + " " + shared, shared + " tail"
    same = "w " * 60
    df = spark.createDataFrame([(1, a), (2, b), (3, same)], "i int, t string").select("i", winnow.fingerprint(F.col("t")).alias("f"))
    got = {r.i: r.f for r in df.collect()}
    assert {e.hash for e in got[1]} & {e.hash for e in got[2]}
    assert [e.place for e in got[3]] == list(range(winnow.WINDOW - 1, 56))  # the rightmost of equal hashes


def test_null_id_comes_first(spark):
    rows = [(None, "null row abcdef"), (1, "one 11111111"), (2, "two 22222222")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.edited for r in winnow.compare_with_next(docs).collect()}
    assert got == {None: "null rowone 111", 1: "one 11two 22", 2: "two 22null r"}
    alone = winnow.compare_with_next(docs.filter("doc_id IS NULL")).collect()
    assert [r.edited for r in alone] == ["null rownull ro"]


def test_no_python_in_the_plan(spark, documents):
    plan = winnow.compare_with_next(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_winnow_odd_rows(odd_docs):
    rows = winnow.compare_with_next(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.near_next <= 1 for r in rows)
    assert {r.doc_id: list(r.fingerprint) for r in rows}[0] == []
    assert winnow.compare_with_next(odd_docs.limit(0)).count() == 0
    one = winnow.compare_with_next(odd_docs.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("count", [1, 2, 37])
def test_next_row_across_blocks(spark, count):
    df = spark.createDataFrame([(i * i * 7,) for i in range(count)], "k bigint")
    got = {r.k: r.n for r in winnow.with_next(df, "k", "own", "n", F.col("k"), F.xxhash64("k"), F.lit(8)).collect()}
    keys = sorted(got)
    assert got == {k: keys[(i + 1) % count] for i, k in enumerate(keys)}


@pytest.mark.parametrize("case", ["one id", "null ids", "mixed"])
def test_rows_of_one_id_go_to_many_blocks(spark, case, monkeypatch):
    """An id, or none, that most rows share is split into blocks by the texts' hashes."""
    monkeypatch.setattr(winnow, "BLOCK_BYTES", 40)
    ids = {"one id": [5] * 60, "null ids": [None] * 60, "mixed": [None] * 20 + [3] * 25 + [7] * 25 + list(range(30))}[case]
    rows = [(k, f"text {n} of its own") for n, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "k bigint, t string")
    tie = {r.t: r.h for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    order = [t for k, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]))]
    with_next = winnow.with_next(df, "k", "own", "n", F.col("t"), F.xxhash64("t"), F.octet_length("t"))
    assert {r.own: r.n for r in with_next.collect()} == dict(zip(order, order[1:] + order[:1]))
    marked = df.withColumn("_tie", F.xxhash64("t"))
    assert marked.groupBy(winnow._blocks(marked, "k", F.col("_tie"), F.octet_length("t"))).count().agg(F.max("count")).first()[0] <= len(rows) // 4


@pytest.mark.parametrize("count", [0, 1, 4, 5, 6, 63, 64, 65, 68, 69, 200, 1000])
def test_rolling_hash_of_any_length(spark, count):
    text = " ".join(f"w{k % 17}" for k in range(count))
    got = spark.createDataFrame([(text,)], "t string").select(winnow.fingerprint(F.col("t")).alias("f")).first().f
    assert [(e.place, e.hash % (1 << 64)) for e in got] == slow_fingerprint(text)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def slow_base(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in BASE.items()}


TEXTS = [
    None, "", "a@b.c x@y +1 (168) 555-5254 1.2.3.4.5 256.1.1.1 001.2.3.4 4111 1111-1111 1111 5", "é🙂 a.b+c@d-e.f.g, " + "9" * 3000,
    "+1 2 3 +12345678 +1234567890123456", "4111111111111111 4111 1111 1111 1112 " + "4111111111111111 " * 600, "\n1.2.3.4\r\n x", "1.2.3 1..2.3.4 a@b a@.b @a.b", "0.0.0.0 10.0.0.1 000.00.0.256 0255.1.1.100",
]


def test_pii_base(spark, documents):
    rows = [(10**6 + i, t) for i, t in enumerate(TEXTS)]
    both = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r.doc_id: r for r in pii.find_personal_data(both).collect()}
    for r in both.collect():
        for kind, spans in slow_base(r.text).items():
            assert [tuple(s) for s in found[r.doc_id][kind]] == spans, (r.doc_id, kind)


def test_bootstrapped_patterns(spark):
    """A context that holds addresses finds one whose last part is too large; others are left alone."""
    rows = [(i, f"server log from host {i}.{i + 1}.7.9 was read") for i in range(12)] + [(50, "server log from host 300.301.7.9 was read")]
    rows += [(60 + i, f"chapter number {i}.{i}.{i}.{900 + i} of the book") for i in range(9)] + [(90, "clean text without any")]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in found[50].found] == [(21, 32)]
    assert all(not r.found for k, r in found.items() if k != 50)


def test_pii_query(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in op10_pii(spark, sf_dir).collect():
        base = slow_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, spans in base.items() for a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(v) for v in base.values())


def test_pii_odd_rows(odd_docs):
    rows = pii.find_personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.email == [] and r.found == [] for r in rows)
    assert pii.find_personal_data(odd_docs.limit(0)).count() == 0
