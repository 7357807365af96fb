"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual patterns.

The spans of the fixed patterns are the seeds. A candidate is a word with a digit or an at sign,
a run of such words without letters (``555 123 4567``), or a word after a label (``user: jdoe``);
its instance is its text without the marks around it. Its lexical patterns are the two words
before it, the two after it, and the label before it; what the candidate looks like is no part of
them, so a pattern can find identifiers of any shape.

Patterns and instances form a graph. In each round every pattern that has ``SEEDS`` different
believed instances is induced, also from what earlier rounds found. Its confidence is the belief
in its instances against all that fills its place: instances that nothing else speaks for count
half, and different other words whole, so that a common turn of words is never trusted. The belief
in an instance that is no seed is one minus the chance that all its trusted patterns err, without
the pattern that it feeds back to. Rounds go on until no other patterns are trusted. The candidates
in trusted patterns, and other places of the same instance where it has a digit or an at sign, are
new spans, of kind ``found``. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.winnow import let
from quillstone.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
FOUND = "found"

# The fixed patterns, in a form that Java's matcher runs without recursion; each finds what
# the base's pattern finds, apart from short matches that its test would drop anyway.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"[^ \t-\r]++"
BYTE = r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

SPACE = r"[ \t-\r]+"
_NUMBERS = r"(?=[^\p{L}@ \t-\r]*[0-9])[^\p{L}@ \t-\r]++(?![^ \t-\r])"
#: A run of numbers, another word with a digit or an at sign, or a word after a label.
CANDIDATE = rf"(?<![^ \t-\r])(?:{_NUMBERS}(?: {_NUMBERS})*+|(?=[^ \t-\r0-9@]*[0-9@])[^ \t-\r]++|(?<=[:=#] )[^ \t-\r]++)"
LABEL = "[:=#]$"

MOST_ROUNDS = 6
CONFIDENT = 0.8
SEEDS = 3
#: What an instance that nothing else speaks for counts against a pattern.
UNSURE = 0.5
#: Other fillers are counted in one of so many texts first, where that may rule a pattern out.
SHARES = (256, 16, 1)
#: A found instance of so many characters, with a digit or an at sign, is marked wherever it is a candidate.
LONG = 6
#: Patterns and beliefs are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000


def _running(values: Column, step: int = 256) -> Column:
    """Running sums of an array<int>; by pieces, so that time stays in proportion to its size."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out"))
    piece = lambda c: F.aggregate(F.slice(values, c * step + 1, step), zero, add)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int")), piece)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    join = lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(p["out"], lambda v: v + a["at"]))).alias("out"))
    return F.when(F.size(values) > 0, F.flatten(F.aggregate(pieces, start, join)["out"])).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches that ``keep`` keeps.

    Splitting at the pattern gives the gaps between the matches, whose lengths give the places,
    in code points.
    """

    def place(x: Column) -> Column:
        step = F.zip_with(x["found"], F.slice(x["gaps"], 1, F.size(x["found"])), lambda m, g: F.length(g) + F.length(m))
        ends = let(step, lambda v: _running(v))
        spans = F.zip_with(x["found"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))
        return F.filter(spans, lambda s: keep(s["text"])) if keep else spans

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(both, place)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def part(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    marks = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(F.transform(marks, part), F.lit(0), lambda a, n: a + n) % 10 == 0


def _is_ip(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: p.rlike(BYTE))


def _is_card(text: Column) -> Column:
    return let(_digits(text), lambda d: F.length(d).between(16, 19) & _luhn(d))


def _is_phone(text: Column) -> Column:
    return F.length(_digits(text)).between(8, 15)


_NONE = "array<struct<start:int,end:int,text:string>>"


def base_spans(text: Column) -> Column:
    """struct of email, ip, card and phone: array<struct<start, end, text>> each, by start.

    A kind is searched for only in texts that have its rarest character or run at all.
    """
    none = F.array().cast(_NONE)
    kinds = {
        "email": (F.contains(text, F.lit("@")), EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, _is_ip),
        "card": (text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), CARD, _is_card),
        "phone": (F.contains(text, F.lit("+")), PHONE, _is_phone),
    }
    return F.struct(*[F.when(may, matches(text, p, keep)).otherwise(none).alias(k) for k, (may, p, keep) in kinds.items()])


def _words(text: Column) -> Column:
    """The words as patterns see them: in lower case, with 0 for every digit."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[0-9]", "0")), SPACE), lambda w: w != "")


def _before(a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit("before"), a, b)


def _after(a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit("after"), a, b)


def _label(a: Column) -> Column:
    return F.xxhash64(F.lit("label"), a)


def candidates(text: Column, seeds: Column) -> Column:
    """array<struct<start, end, instance, seed, patterns>>; patterns are hashes."""

    def pick(x: Column) -> Column:
        step = F.zip_with(x["found"], F.slice(x["gaps"], 1, F.size(x["found"])), lambda m, g: F.length(g) + F.length(m))

        def one(y: Column) -> Column:
            def at(i: Column) -> Column:
                word = F.get(y["found"], i)
                left, right = F.get(y["around"], i), F.get(y["around"], i + 1)
                n = F.size(left)
                near = lambda k: F.get(left, n - k)
                patterns = F.array(
                    F.when(n >= 2, _before(near(2), near(1))),
                    F.when(F.size(right) >= 2, _after(F.get(right, F.lit(0)), F.get(right, F.lit(1)))),
                    F.when(near(1).rlike(LABEL), _label(near(1))),
                )
                head = F.length(word) - F.length(F.regexp_replace(word, r"^[^\p{L}0-9+(]+", ""))
                core = F.regexp_extract(word, r"(?s)[\p{L}0-9+(](?:.*[\p{L}0-9])?", 0)
                start = F.get(y["ends"], i) - F.length(word) + head
                end = start + F.length(core)
                seed = F.exists(seeds, lambda s: (s["start"] < end) & (start < s["end"]))
                return F.struct(start.alias("start"), end.alias("end"), F.lower(core).alias("instance"), seed.alias("seed"), F.array_compact(patterns).alias("patterns"))

            made = F.transform(F.sequence(F.lit(0), F.size(y["found"]) - 1), at)
            return F.when(F.size(y["found"]) > 0, F.filter(made, lambda c: (c["instance"] != "") & (F.size(c["patterns"]) > 0)))

        around = F.transform(x["gaps"], _words)
        return let(F.struct(x["found"].alias("found"), around.alias("around"), _running(step).alias("ends")), one)

    both = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int,instance:string,seed:boolean,patterns:array<bigint>>>")
    return F.when(text.rlike("[0-9@]|[:=#] "), F.coalesce(let(both, pick), none)).otherwise(none)


def _beside(rows: DataFrame, few: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined to ``few``, which is broadcast while it is small; only then hot keys need no shuffle."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, key, how)


def other_fillers(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, others): how many different words that are no candidates fill a pattern's place, over all texts.

    Up to ``BROADCAST_ROWS`` patterns go along as a set, so that only their places leave a text;
    more are joined to all places.
    """
    few = patterns.select("pattern").limit(BROADCAST_ROWS + 1).collect()
    wanted = [r["pattern"] for r in few] if len(few) <= BROADCAST_ROWS else None

    def places(w: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(w) - 1)

        def filled(pattern: Callable[[Column], Column]) -> Column:
            some = every if wanted is None else F.filter(every, lambda i: pattern(i).isin(wanted))
            return F.transform(some, lambda i: F.struct(pattern(i).alias("pattern"), F.get(w, i).alias("word")))

        found = [filled(lambda i: _before(F.get(w, i - 2), F.get(w, i - 1))), filled(lambda i: _after(F.get(w, i + 1), F.get(w, i + 2)))]
        return F.when(F.size(w) > 0, F.concat(*found))

    rows = texts.select(F.explode(let(_words(F.col("text")), places)).alias("p")).select("p.pattern", "p.word").filter(~F.col("word").rlike("[0@]"))
    if wanted is None:
        rows = rows.join(patterns.select("pattern"), "pattern", "left_semi")
    return rows.groupBy("pattern", "word").count().groupBy("pattern").agg(F.count("*").alias("others"))


def counted_fillers(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, others) of other_fillers() for ``patterns`` (pattern, n), exact wherever a pattern of n instances may be trusted.

    Different fillers only get more with more texts. So patterns that some texts alone rule out,
    whatever is believed of their instances, are not counted further, and only the others are
    looked for in all texts.
    """
    done, left = None, patterns
    for share in SHARES:
        some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0) if share > 1 else texts
        found = left.join(other_fillers(some, left), "pattern", "left").select("pattern", "n", F.coalesce("others", F.lit(0).cast("bigint")).alias("others"))
        found = cut_lineage(found)
        out = F.col("others") * CONFIDENT > F.col("n") * (1 - CONFIDENT)
        over = found.filter(out if share > 1 else F.lit(True)).select("pattern", "others")
        done = over if done is None else done.unionByName(over)
        left = found.filter(~out).select("pattern", "n")
        if left.isEmpty():
            break
    return done


def trusted_patterns(edges: DataFrame, texts: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(pattern, confidence) of the patterns to trust.

    ``edges`` has each (pattern, instance) once, and whether the instance is a seed; ``texts``
    has text. Sums by pattern or instance are combined before they are shuffled.
    """
    none = edges.filter(F.lit(False))
    trusted = none.select("pattern", F.lit(0.0).alias("confidence"))
    counted = none.select("pattern", F.lit(0).cast("bigint").alias("others"))
    for _ in range(most_rounds):
        own = _beside(edges, trusted, "pattern").withColumn("own", F.when(F.col("confidence").isNull(), 0.0).otherwise(F.log1p(-F.least(F.col("confidence"), F.lit(0.99)))))
        errs = own.filter("own < 0").groupBy("instance").agg(F.sum("own").alias("errs"))
        belief = F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.coalesce("errs", F.lit(0.0)) - F.col("own")))
        held = _beside(own.select("pattern", "instance", "seed", "own"), cut_lineage(errs), "instance").withColumn("belief", belief)
        sums = held.groupBy("pattern").agg(F.sum("belief").alias("held"), F.count("*").alias("n"), F.count_if(F.col("belief") >= CONFIDENT).alias("support"))
        usable = cut_lineage(sums.filter(F.col("support") >= SEEDS))
        fresh = cut_lineage(usable.join(counted, "pattern", "left_anti").select("pattern", "n"))
        if not fresh.isEmpty():
            counted = cut_lineage(counted.unionByName(counted_fillers(texts, fresh)))
        against = F.col("others") + UNSURE * (F.col("n") - F.col("held"))
        scored = usable.join(counted, "pattern").select("pattern", (F.col("held") / (F.col("held") + against)).alias("confidence"))
        before, trusted = trusted, cut_lineage(scored.filter(F.col("confidence") >= CONFIDENT))
        changed = trusted.select("pattern").exceptAll(before.select("pattern")).unionByName(before.select("pattern").exceptAll(trusted.select("pattern")))
        if changed.isEmpty():
            break
    return trusted


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, email, ip, card, phone and found for every row: array<struct<start, end>> by start.

    Null and empty texts have none, and texts of any length are read whole. Repeated ids keep
    their own spans; repeated rows are all returned, and count once for each pattern and
    instance. A null id is returned. An empty table gives none. Only the spans and candidates
    are written and shuffled, never the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_row"), base_spans(text).alias("b"), text.alias("_text"))
    seeds = F.concat(*[F.col(f"b.{k}") for k in KINDS])
    bare = [F.transform(F.col(f"b.{k}"), lambda s: F.struct(s["start"], s["end"])).alias(k) for k in KINDS]
    table = cut_lineage(rows.select("_id", "_row", *bare, let(seeds, lambda s: candidates(F.col("_text"), s)).alias("c")))
    each = table.filter(F.size("c") > 0).select("_row", F.explode("c").alias("c")).select("_row", "c.*")
    edges = cut_lineage(each.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    trusted = trusted_patterns(edges, docs.select(text.alias("text")))
    placed = _beside(each.filter(~F.col("seed")).withColumn("pattern", F.explode("patterns")), trusted.select("pattern"), "pattern", "left_semi").drop("pattern")
    placed = cut_lineage(placed)
    names = placed.filter(F.col("instance").rlike("[0-9@]") & (F.length("instance") >= LONG)).select("instance").distinct()
    same = _beside(each.filter(~F.col("seed")), cut_lineage(names), "instance", "left_semi").select(*placed.columns)
    new = placed.unionByName(same).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(FOUND))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = table.drop("c").join(new, "_row", "left")
    return out.select(F.col("_id").alias(id_col), *KINDS, F.coalesce(FOUND, none).alias(FOUND))


def joined_spans(*kinds: str) -> Column:
    """kind:start:end of all spans of these columns in turn, comma-joined."""

    def part(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(part, kinds)), ",")
