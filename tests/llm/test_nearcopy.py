import itertools

import corpus_pipeline
import numpy as np

from quillstone.llm import nearcopy


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_pairs(rows):
    """All pairs of ids whose five-word shingle sets have similarity 0.8 or more."""
    sets = [(k, shingles(t)) for k, t in sorted(rows)]
    return [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 5 * len(x & y) >= 4 * len(x | y)]


def groups_of(rows, pairs):
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {k: find(k) for k in root}


def as_docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def found_groups(spark, rows):
    return {r.doc_id: r.component_id for r in nearcopy.near_copies(as_docs(spark, rows)).collect()}


def recall(rows, found):
    """Share of the near pairs that are in one found group; no found group may join what isn't linked."""
    pairs = near_pairs(rows)
    true = groups_of(rows, pairs)
    assert all(true[k] == true[v] for k, v in found.items()) and set(found) == set(true)
    return sum(found[a] == found[b] for a, b in pairs) / len(pairs)


def test_stage_keeps_one_of_each_group(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    found = found_groups(spark, rows)
    assert recall(rows, found) >= 0.9
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, as_docs(spark, rows), sf_dir).collect()} == set(found.values())


def changed(rng, words, times, size=3000):
    words = list(words)
    for at in rng.integers(0, len(words), times):
        words[at] = f"x{rng.integers(0, size)}"
    return " ".join(words)


def test_recall_of_lone_pairs(spark):
    """Pairs of texts of all lengths, from equal to a similarity of 0.8, where no third text helps."""
    rng, rows = np.random.default_rng(5), []
    for k in range(400):
        n = int(rng.integers(60, 900))
        words = [f"w{x}" for x in rng.integers(0, 20000, n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, changed(rng, words, int(rng.integers(0, max(1, n // 42)))))]
    assert recall(rows, found_groups(spark, rows)) >= 0.9


def test_one_large_group(spark):
    """Near copies of one text, from few changes to many: chains, and pairs that only look alike."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 3000, 150)]
    rows = [(k, changed(rng, base, int(rng.integers(0, 14)), 5000)) for k in range(300)]
    rows += [(1000, "one two three four five six"), (1001, "one two three four five six"), (1002, "one two three four five seven")]
    found = found_groups(spark, rows)
    assert recall(rows, found) >= 0.99 and found[1001] == 1000 and found[1002] == 1002


def test_texts_of_one_id_are_documents_of_their_own(spark, sf_dir):
    rows = [(1, "one text of its own that nothing else here has"), (1, "a wholly different text under the same number as that"), (1, "one text of its own that nothing else here has")]
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, as_docs(spark, rows), sf_dir).collect()) == sorted({t for _, t in rows})


def test_only_small_tables_are_broadcast(spark):
    """The driver builds what is broadcast, so fingerprints of tens of thousands of classes stay with the executors."""
    hinted = lambda n: "ResolvedHint" in nearcopy._beside(spark.range(n), 16 * nearcopy.SEGMENTS)._jdf.queryExecution().analyzed().toString()
    assert hinted(1000) and not hinted(40_000)


def as_classes(spark, keys):
    return spark.createDataFrame([(k, (k, x)) for k, x in keys.items()], "cls bigint, m struct<row: bigint, keys: array<bigint>>")


def test_rarer_value_comes_to_the_crowded_one(spark):
    """However many classes have a value, those a bit away make as many rows as they are."""
    for crowd in (40, 160):
        for many, few in ((4, 5), (5, 4)):
            keys = {k: [many if k < crowd else few] for k in range(crowd + 3)}
            near = nearcopy._buckets(as_classes(spark, keys)).filter("not exact").collect()
            assert sorted(r.cls for r in near) == [crowd, crowd + 1, crowd + 2] and {r.key for r in near} == {many}


def test_segments_a_bit_apart_meet(spark):
    """Each two classes with a segment that differs by one bit at most meet where one of them has the exact value, and no others do."""
    rng = np.random.default_rng(4)
    flips = rng.integers(0, 2, (80, 3, 4)) * (1 << rng.integers(0, nearcopy.BITS, (80, 3, 4)))
    keys = {k: [int(np.bitwise_or.reduce(flips[k, s])) + (s << nearcopy.BITS) for s in range(3)] for k in range(80)}
    met = {frozenset((r.cls, d)) for r in nearcopy._buckets(as_classes(spark, keys)).collect() for d in keys if r.key in keys[d] and d != r.cls}
    apart = lambda a, b: min((x ^ y).bit_count() for x, y in zip(keys[a], keys[b]))
    assert met == {frozenset(p) for p in itertools.combinations(keys, 2) if apart(*p) <= 1}
