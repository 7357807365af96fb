"""Bootstrapped patterns against a plain version of the same rules, and with planted identifiers whose places are known."""

import math
import random
import re

import pytest
import regex

from quillstone.llm import pii
from test_winnow_pii import slow_base

SPACE = re.compile("[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(re.sub("[0-9]", "0", text).lower()) if w]


def slow_candidates(text, seeds):
    found = list(regex.finditer(pii.CANDIDATE, text))
    ends = [0, *(m.end() for m in found)]
    starts = [*(m.start() for m in found), len(text)]
    around = [words(text[a:b]) for a, b in zip(ends, starts)]
    for i, m in enumerate(found):
        core = regex.search(r"(?s)[\p{L}0-9+(](?:.*[\p{L}0-9])?", m[0])
        if not core:
            continue
        start, end = m.start() + core.start(), m.start() + core.end()
        left, right = around[i], around[i + 1]
        patterns = [("before", *left[-2:])] * (len(left) >= 2) + [("after", *right[:2])] * (len(right) >= 2)
        patterns += [("label", left[-1])] * bool(left and left[-1][-1] in ":=#")
        if patterns:
            yield start, end, core[0].lower(), any(a < end and start < b for a, b in seeds), patterns


def slow_found(texts):
    each = []
    edges, fillers = {}, {}
    for k, text in enumerate(texts):
        seeds = [s for spans in slow_base(text).values() for s in spans]
        for start, end, instance, seed, patterns in slow_candidates(text, seeds):
            each.append((k, start, end, instance, seed, patterns))
            for p in patterns:
                edges[p, instance] = edges.get((p, instance), False) or seed
        w = words(text)
        for i, x in enumerate(w):
            if not set(x) & set("0@"):
                if i >= 2:
                    fillers.setdefault(("before", w[i - 2], w[i - 1]), set()).add(x)
                if i + 2 < len(w):
                    fillers.setdefault(("after", w[i + 1], w[i + 2]), set()).add(x)
    trusted = {}
    for _ in range(pii.MOST_ROUNDS):
        own = lambda p: math.log1p(-min(trusted[p], 0.99)) if p in trusted else 0.0
        errs = {}
        for p, i in edges:
            errs[i] = errs.get(i, 0.0) + own(p)
        belief = {(p, i): 1.0 if seed else 1 - math.exp(errs[i] - own(p)) for (p, i), seed in edges.items()}
        sums = {}
        for (p, i), b in belief.items():
            held, n, support = sums.get(p, (0.0, 0, 0))
            sums[p] = held + b, n + 1, support + (b >= pii.CONFIDENT)
        scores = {p: h / (h + len(fillers.get(p, ())) + pii.UNSURE * (n - h)) for p, (h, n, s) in sums.items() if s >= pii.SEEDS}
        before, trusted = trusted, {p: c for p, c in scores.items() if c >= pii.CONFIDENT}
        if set(before) == set(trusted):
            break
    placed = [x for x in each if not x[4] and set(x[5]) & set(trusted)]
    names = {x[3] for x in placed if len(x[3]) >= pii.LONG and re.search("[0-9@]", x[3])}
    return sorted({(k, s, e) for k, s, e, i, seed, p in each if not seed and (set(p) & set(trusted) or i in names)})


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    return sorted((r.doc_id, *s) for r in pii.find_personal_data(docs).collect() for s in r.found)


FILL = "river stone apple chair window garden paper clock bread music".split()


def corpus(seed, size=120):
    """Texts, and the places of planted identifiers that no fixed pattern finds."""
    rng, texts, want = random.Random(seed), [], []
    email = lambda: f"{rng.choice(FILL)}{rng.randrange(999)}@mail.example.com"
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    hidden = [f"{rng.choice(FILL)}_{rng.randrange(100, 999)}" for _ in range(12)]
    places = ["please write to {} any time", "you can reach me under {} until five", "contact: {} thanks for it", "{} is my own address"]
    later = ["they saw {} last night there"]  # holds hidden ones only, so it is learned from what others found
    for k in range(size):
        text = " ".join(rng.choices(FILL, k=rng.randrange(3, 20))) + " "
        for _ in range(rng.randrange(1, 4)):
            kind = rng.random()
            if kind < 0.55:
                before, after = rng.choice(places).split("{}")
                x = rng.choice([email, phone])()
            elif kind < 0.8:
                before, after = rng.choice(places).split("{}")
                x = rng.choice(hidden) if rng.random() < 0.7 else f"555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
            elif kind < 0.9:
                before, after = rng.choice(later).split("{}")
                x = rng.choice(hidden)
            else:  # numbers that are nobody's, in places of their own and in common ones
                before, after = rng.choice(["chapter number {} of the book", "a garden {} of stone"]).split("{}")
                x = str(rng.randrange(10, 9999))
            text += before
            if kind >= 0.55 and kind < 0.9:
                want.append((k, len(text), len(text) + len(x)))
            text += x + after + " " + " ".join(rng.choices(FILL, k=3)) + " "
        if rng.random() < 0.3:
            text += "a garden path of stone and please write to nobody"
        texts.append(text)
    return texts, want


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_version(spark, seed):
    texts, _ = corpus(seed)
    assert found(spark, texts) == slow_found(texts)


def test_planted_identifiers(spark):
    texts, want = corpus(7, 300)
    got = set(found(spark, texts))
    assert len(got & set(want)) >= 0.9 * len(want)  # recall of what no fixed pattern finds
    assert len(got & set(want)) >= 0.95 * len(got)  # precision


def test_patterns_learned_from_found_instances(spark):
    """The second place never holds a seed; it is trusted through what the first one found."""
    texts = [f"please write to a{k}@mail.example.com any time" for k in range(12)] + [f"please write to jan_{k}01 any time" for k in range(4)]
    texts += [f"they saw jan_{k}01 last night" for k in range(4)] + ["they saw ufo_999 last night", "chapter number 12 of it"]
    got = [texts[k][a:b] for k, a, b in found(spark, texts)]
    assert got.count("ufo_999") == 1 and "12" not in got and sum(x.startswith("jan_") for x in got) == 8
    assert found(spark, texts) == slow_found(texts)


def test_one_place_with_most_rows(spark):
    """A pattern and an instance with a third of all rows, and copies, change nothing."""
    texts = [f"please write to a{k}@mail.example.com any time" for k in range(50)] + ["please write to jan_401 any time"] * 200 + ["they saw jan_401 last night"] * 200
    got = found(spark, texts)
    assert len(got) == 400 and got == slow_found(texts)


def test_many_patterns_are_joined_instead(spark, monkeypatch):
    """Beyond the bound of what is broadcast or sent along the rows are the same."""
    texts, _ = corpus(3)
    want = found(spark, texts)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert want and found(spark, texts) == want == slow_found(texts)


def test_no_python_in_the_plan(spark, documents):
    plan = pii.find_personal_data(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
