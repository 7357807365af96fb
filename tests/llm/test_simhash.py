import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def slow_components(fps):
    """Least id of each group, by all pairs; fps is a list of (id, fingerprint)."""
    values = np.array([f for _, f in fps], np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(fps):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return {key: least[find(i)] for i, (key, _) in enumerate(fps) if key is not None}


def test_documents_against_all_pairs(documents):
    rows = documents.select("doc_id", "text").collect()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert {k: v[0] for k, v in found.items()} == dict(fps)
    assert {k: v[1] for k, v in found.items()} == slow_components(fps)


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_links_by_either_way(spark, hot):
    """Crowded segments or not, the components are those of all pairs; and the hot way alone too."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(25):
            fps.add(c ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(40))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp bigint")
    got = simhash.components(nodes, simhash.links(nodes, hot)).collect()
    named = {s[0]: s[0] for s in signed} | {r.fp: r.root for r in got}
    want = slow_components([(i, f) for i, f in enumerate(fps)])
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({i: named[s[0]] for i, s in enumerate(signed)}) == groups(want)


def test_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert found[0].fp == found[1].fp == found[2].fp == 0 and found[1].component_id == 0
    assert found[7].component_id == found[8].component_id == 7
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_hex(spark):
    got = spark.createDataFrame([(0,), (-1,), (255,)], "fp bigint").select(simhash.hex_fingerprint(F.col("fp"))).collect()
    assert [r[0] for r in got] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]
