"""The method's own spans: fixed cases of syntax, and made-up programs whose secrets are known."""

import random
import string

import pytest

from quillstone.llm import secrets

LONG = "q9Zr7!mmW2xK"


def found(text):
    return [text[a:b] for kind, a, b, _ in secrets.scan(text) if kind == "literal"]


@pytest.mark.parametrize(
    "text, want",
    [
        (f'password = DB_PASS\nDB_PASS = "{LONG}"', [LONG]),  # a constant named before it is given
        ('password = "ab\'cd12XYzz9!"', ["ab'cd12XYzz9!"]),
        ('secret = "ab\\"cd12XYzz9!"', ['ab\\"cd12XYzz9!']),
        ('token = "q9Zr7!" + "mmW2xK"', ["q9Zr7!", "mmW2xK"]),
        ('token = ("q9Zr7!"\n         "mmW2xK")', ["q9Zr7!", "mmW2xK"]),
        (f'set("password", "{LONG}")', [LONG]),
        (f'password: str = "{LONG}"', [LONG]),
        (f'api_key: Optional[str] = "{LONG}"', [LONG]),
        (f'cfg["db"]["password"] = "{LONG}"', [LONG]),
        (f"{{'api_key': '{LONG}', \"b\": 3}}", [LONG]),
        (f'password = os.getenv("DB_PASSWORD", "{LONG}")', [LONG]),
        ('password = os.getenv("DB_PASSWORD")', []),
        (f"<password>{LONG}</password>", [LONG]),
        (f"mysql --password {LONG} -h x", [LONG]),
        (f'a = b\nb = c\nc = "{LONG}"\nsecret_token = a', [LONG]),
        ("a=b\nb=a\npassword=a", []),
        (f'PRE = "q9Zr7!"\ntoken = PRE + "mmW2xK"', ["q9Zr7!", "mmW2xK"]),
        (f'# password = "{LONG}"', [LONG]),  # commented out, and leaked all the same
        (f'String password = @"{LONG}";', [LONG]),
        ("authorization: Bearer abcDEF123456ghi", ["abcDEF123456ghi"]),
        ("don't say password: it's 'fine' ok", []),
        ('password = "changeme123A"', []),
        (f'colour = "{LONG}"', []),
    ],
)
def test_syntax(text, want):
    assert found(text) == want


def program(seed):
    """A text of assignments in many forms, and the literals that reach a sensitive name."""
    rng = random.Random(seed)
    lines, want = [], set()
    literal = lambda: "".join(rng.choices(string.ascii_letters, k=9)) + "".join(rng.choices("0123456789!%*", k=5)) + "zQ"
    forms = ["{n} = \"{v}\"", "{n}: '{v}'", '"{n}": "{v}",', "{n} := `{v}`", "{n} => '{v}';", "{n}={v}", "x({n}='{v}')", 'put("{n}", "{v}");']
    for k in range(rng.randrange(5, 60)):
        value, name = literal(), rng.choice(["dbPassword", "API_TOKEN", "client-secret", "title", "retries", "pathName"])
        if rng.random() < 0.3:  # through a chain of constants, given before or after
            chain = [f"C{k}x{i}" for i in range(rng.randrange(1, 5))]
            steps = [f"{a} = {b}" for a, b in zip([name, *chain], chain)] + [f'{chain[-1]} = "{value}"']
            rng.shuffle(steps)
            lines += steps
        else:
            lines.append(rng.choice(forms).format(n=name, v=value))
        if name in ("dbPassword", "API_TOKEN", "client-secret"):
            want.add(value)
        lines.append(rng.choice(["", "It's a plain line, isn't it?", "if (a == b) { c = d; }", "# note: nothing here", "rate = 5 * 3"]))
    return "\n".join(lines), want


@pytest.mark.parametrize("seed", range(40))
def test_programs(seed):
    text, want = program(seed)
    assert set(found(text)) == want
    left = secrets.redact_text(text)
    assert not any(v in left for v in want)


@pytest.mark.parametrize("part", ['\\"', 'password="', "password='a", "token=", "token = a+", "<password>", "x(", "token = f(", "]=", "password:"])
def test_time_is_in_proportion(part):
    import time

    began = time.process_time()
    secrets.scan(part * (300_000 // len(part)) + " password")
    assert time.process_time() - began < 20


def test_empty_table_and_repeated_rows(spark):
    rows = spark.createDataFrame([(f'password = "{LONG}"',), (f'password = "{LONG}"',), (None,), ("",)], "text string")
    got = [len(r.s) for r in rows.select(secrets.find_secrets(rows.text).alias("s")).collect()]
    assert got[0] == got[1] > 0 and got[2:] == [0, 0]
    assert rows.limit(0).select(secrets.redact(rows.text).alias("t")).count() == 0
