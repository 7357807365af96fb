import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import html, secrets, urls
from quillstone.llm.queries import BLOCKED_HOSTS, ORACLE_SQL, URL_RULES, op2_urls, op5_html, op6_secrets


def test_urls_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE_SQL['op2_urls']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in op2_urls(spark, sf_dir).orderBy("page_id").collect()] == want


CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://A.EXAMPLE.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/19", "example.org", "/en/19", "example.org/en/1", "block"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://example.org?a/es/", "example.org", "", None, "allow"),
    ("x://b.com/de/#", "b.com", "/de/", "com/de/", "block"),
    ("x://b.com/de", "b.com", "/de", None, "allow"),
    ("http://www.cheap-pills.example.com/xx", "www.cheap-pills.example.com", "/xx", None, "block"),
    ("http://É.net/" + "a" * 50000, "É.net", "/" + "a" * 50000, None, "allow"),
]


def test_url_cases(spark):
    df = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(CASES)], "i int, url string, host int")
    got = df.select("i", urls.judge(spark, F.col("url"), URL_RULES, BLOCKED_HOSTS).alias("j")).orderBy("i").collect()
    assert [tuple(r.j) for r in got] == [c[1:] for c in CASES]
    assert df.limit(0).select(urls.judge(spark, F.col("url"), [], [])).count() == 0


def test_colliding_keys_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    rules = [(f"h{i}.com/p{i}", i % 2 == 0) for i in range(40)]
    (tmp_path / "d").write_bytes(urls.digest(rules))
    found = urls.Digest(str(tmp_path / "d")).longest([(f"h{i}.com", f"/p{i}") for i in range(60)])
    assert found == [(r, b) for r, b in rules] + [None] * 20


def test_articles_of_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op5_html(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


BODY = "<p>One two three four five six seven eight nine.</p><p>Ten eleven twelve &amp; thirteen&nbsp;fourteen &#233;.</p>"
TEXT = "One two three four five six seven eight nine.\n\nTen eleven twelve & thirteen fourteen é."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href=x>Home</a></nav><main>{BODY}</main><footer>f</footer></body>",
        f"<body><div class='menu'><a>a</a></div><div id=c>{BODY}</div><div class='side sidebar'>more words to read here</div></body>",
        f"<body><header><h1>Site</h1></header><article>{BODY}<div class='ad'>Buy now cheap</div><form>Sign <input> up</form></article></body>",
        f"<script>var a='<p>no</p>';</script><style>p{{}}</style><article>{BODY}</article><section id='comments'><article><p>I liked this very much indeed, so much.</p></article></section>",
        f"<body><div class='cookie-notice'>We use cookies and more cookies</div><ARTICLE>{BODY}<!-- <p>no</p> --></ARTICLE>",
        f"<div class='ad'>never closed<article>{BODY}</article>",
        f"<article><header>{BODY}</header></article><aside>related words</aside>",
        f"<div class='wrap'><div class='header'>The site of all words</div><div class='text'>{BODY.replace('</p><p>', '</p><hr><p>')}</div><div id='footer'>All rights</div></div>",
        f"<table><tr><td class='nav'><a>x</a></td><td>{BODY}</td></tr></table><ul class='comment-list'><li>Nice words, I liked all of them.</li></ul>",
    ],
)
def test_templates(page):
    assert html.extract_text(page) == TEXT


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<<<>>>", "<nav>a b c</nav>", "<script>x", "<!-- open", "<p", "</p></div>"])
def test_pages_without_text(page):
    assert html.extract_text(page) in ("", "<", "<<<>>>", "<p")


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>" + "word " * 20000 + "</p>" + "</div>" * 3000
    assert html.extract_text(deep).count("word") == 20000
    html.extract_text('<a href="' * 5000)
    html.extract_text("<" * 20000)


def test_best_region():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.integers(-5, 6, 12).astype(float).tolist()
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max([0.0] + [sum(s[i:j]) for i in range(12) for j in range(i + 1, 13)])


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def slow_base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m)]
    return [(k, s, e) for s, _, e, k in sorted(found)]


SECRETS = [
    None, "", "AKIA" + "A" * 11, "AKIAAKIA" + "A" * 12, "x" * 3000, "a" * 40 + "g" + "0" * 31, "PassWord = 'abcdefgh' token:short secret=secret=longer88",
    "api_key: 12345678\napikey='9999-9999'", "paſſword = abcdefgh", "é🙂 token = \"" + "ab" * 20 + '"', "A1-" * 40000, "=" * 1000 + ":" * 1000,
]


def test_secret_base(documents):
    for text in SECRETS + [r.text for r in documents.select("text").collect()]:
        assert [(k, s, e) for k, s, e, _ in secrets.scan(text) if k != "literal"] == slow_base(text)


def literals(text):
    return [text[s:e] for k, s, e, _ in secrets.scan(text) if k == "literal"]


def test_assignments():
    assert literals('x = "Zk39dkKD93kd"\ny = x\nclient_password = y') == ["Zk39dkKD93kd"]
    assert literals('{"dbPassword": "hunter2-Ax9"}') == ["hunter2-Ax9"]
    assert literals("private_key => 'Q8dk2-kd93-LL'") == ["Q8dk2-kd93-LL"]
    assert literals('password = "changeme"\ntoken = "${TOKEN}"\nsecret: example_secret') == []
    assert literals('colour = "Zk39dkKD93kd"\nname: Anna') == []
    assert literals("The key word is: patience, and the token was lost.") == []


def test_redaction(spark, odd_docs):
    text = 'a password = "Zk39dkKD93kd" b'
    assert "Zk39dkKD93kd" not in secrets.redact_text(text) and secrets.redact_text(text).endswith(" b")
    assert secrets.redact_text("clean text") == "clean text" and secrets.redact_text(None) is None
    rows = odd_docs.select("text", secrets.redact(F.col("text")).alias("r"), secrets.find_secrets(F.col("text")).alias("f")).collect()
    assert all(r.text == r.r and r.f == [] for r in rows)


def test_secret_query(spark, sf_dir, documents):
    import hashlib

    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in op6_secrets(spark, sf_dir).collect():
        base = slow_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, *_ in base) for k in BASE)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
