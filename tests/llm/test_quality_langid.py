import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import langid, quality
from quillstone.llm.queries import held_out_fold, op1_quality, op8_langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_base_counts(spark, sf_dir, documents):
    found = {r.doc_id: r for r in op1_quality(spark, sf_dir).collect()}
    for r in documents.select("doc_id", "text").collect():
        x, want = found[r.doc_id], slow_counts(r.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.base_failed and x.kept)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a\na\n\n \nA\na", "é#é <|>", "a b", None, "x y z w x y z"])
def test_base_counts_of_small_texts(text):
    assert quality.text_statistics(text)[:5] == slow_counts(text)


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(0)
    clean = rng.normal(0.5, 0.2, (800, quality.P))
    bad = rng.normal(4.0, 0.1, (200, quality.P))
    rows = [(["g"], *map(float, x)) for x in np.concatenate([clean, bad])]
    vectors = spark.createDataFrame(rows, "keys array<string>, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    e = quality.estimates(vectors).first().e
    assert e.n == 1000 and np.allclose(e.mean, 0.5, atol=0.1)


def brute_mcd(x, starts=300):
    """Least determinant over concentration steps from many random subsets, with the floors of the operator."""
    rng, n = np.random.default_rng(9), len(x)
    h = int(np.ceil(n * quality.COVER))
    floor = np.array(list(quality.FEATURES.values())) ** 2

    def fit(rows):
        cov = np.cov(rows.T, bias=True)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), floor))
        return rows.mean(axis=0), cov, np.linalg.slogdet(cov)[1]

    best = None
    for _ in range(starts):
        mean, cov, det = fit(x[rng.choice(n, quality.P + 1, replace=False)])
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            mean, cov, now = fit(x[np.argsort(d, kind="stable")[:h]])
            if now > det - 1e-9 and now != det:
                break
            det = now
        if best is None or now < best[2]:
            best = mean, cov, now
    return best


@pytest.mark.parametrize("kind", ["one cloud", "shifted", "flat"])
def test_estimates_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.multivariate_normal(np.full(quality.P, 0.5), 0.04 * (np.full((quality.P, quality.P), 0.5) + 0.5 * np.eye(quality.P)), 200)
    if kind == "shifted":
        x[:45] += rng.normal(1.5, 0.1, (45, quality.P))
    if kind == "flat":
        x[:40] = x[:40].mean(axis=0) + [0, 2, 0, 0, -1, 0, 0] + rng.normal(0, 0.01, (40, quality.P))
    rows = [(["g"], *map(float, v)) for v in x]
    vectors = spark.createDataFrame(rows, "keys array<string>, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    e = quality.estimates(vectors).first().e
    mean, cov, det = brute_mcd(x)
    assert e.logdet <= det + 0.05  # as good as the best of 300 starts
    assert np.allclose(e.mean, mean, atol=0.05)
    w = np.zeros((quality.P, quality.P))
    for v, (i, j) in zip(e.whitening, quality.TRIANGLE):
        w[i, j] = v
    found = np.linalg.inv(w.T @ w) / quality.consistency(quality.COVER)
    assert np.allclose(found, cov, atol=0.01)
    far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) / quality.consistency(quality.COVER)
    own = np.square((x - np.array(e.mean)) @ w.T).sum(axis=1)
    assert ((far > 25) == (own > 25)).mean() > 0.98


def test_consistency():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200_000, quality.P))
    d = np.square(x).sum(axis=1)
    near = x[d <= np.quantile(d, quality.COVER)]
    assert 1 / near.var() == pytest.approx(quality.consistency(quality.COVER), rel=0.01)


def test_verdicts_follow_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs).join(labels, "doc_id").filter("NOT base_failed")
    good, bad = (judged.filter(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.99 and bad < 0.1


def test_judge_odd_rows(odd_docs):
    judged = quality.judge(odd_docs).collect()
    assert len(judged) == odd_docs.count() and all(r.kept in (True, False) for r in judged)
    assert set(odd_docs.columns) <= set(judged[0].asDict())
    assert quality.judge(odd_docs.limit(0)).count() == 0
    short = odd_docs.filter("length(text) < 20")
    assert quality.judge(short).filter("kept").count() == 0


def test_language_on_held_out_documents(spark, sf_dir, documents):
    found = op8_langid(spark, sf_dir)
    joined = found.join(documents.select("doc_id", "lang"), "doc_id")
    assert joined.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert found.count() == documents.count() and found.filter("score < 0 OR score > 1").count() == 0
    assert found.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)).count() == 0


def test_language_odd_rows(odd_docs, documents):
    model = langid.train(documents.filter(~held_out_fold(F.col("doc_id"))), "text", "lang")
    rows = odd_docs.select("text", langid.predict(F.col("text"), model).alias("p")).collect()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.p.lang == "und") == (not letters) and 0 <= r.p.score <= 1
    assert langid.train(documents.filter("lang IS NULL"), "text", "lang") is None
    none = odd_docs.select(langid.predict(F.col("text"), None).alias("p")).collect()
    assert {r.p.lang for r in none} == {"und"}


def test_training_sample_is_bounded_and_fair(spark, documents):
    """Copies of one text don't crowd out others, and every label is learned."""
    rows = [("the cat sat on the mat", "en")] * 3000 + [(f"der Hund {k} lief schnell nach Hause", "de") for k in range(300)] + [("le chat noir", "fr"), (None, "xx"), ("123", "yy"), ("abc", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs, "text", "lang", sample=100)
    assert model.languages[0] == "de" and set(model.languages) <= {"de", "en", "fr"} and "fr" in model.languages
    assert docs.limit(0).select(langid.predict(docs.text, model)).count() == 0
    assert langid.train(docs.limit(0), "text", "lang") is None


def test_windows_cover_the_text():
    text = bytes(range(256)) * 9
    windows = langid.windows_of(text, 100)
    assert windows[windows < 256].astype(np.uint8).tobytes() == text
