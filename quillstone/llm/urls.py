"""URL rules in a sorted digest array, memory-mapped by each worker.

Each rule is a host and a path prefix written together (``example.org/es/``). The digest file
holds the 64-bit xxhash keys of all rules in order, their verdicts and their full strings. A
batch of URLs makes candidate strings, every suffix of the host at a dot by every prefix of the
path that has the length of some rule's path; their keys are looked up by one vectorised binary
search, and hits count only if the stored string is equal, so colliding keys do no harm.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A digest goes to every worker; a larger rule set is refused instead of sent.
MOST_BYTES = 256 << 20

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    for mark in "?#":
        tail = tail.partition(mark)[0]
    return host.translate(_LOWER), tail


def digest(rules: list[tuple[str, bool]]) -> bytes:
    """The file's bytes; ``rules`` are (string, blocked), of which repeats keep the last."""
    strings = [r.encode() for r in dict(rules)]
    blocked = np.array(list(dict(rules).values()), np.uint8)
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([0, *(len(strings[i]) for i in order)]).astype(np.uint64)
    lengths = sorted({len(r) - len(r.partition("/")[0]) for r in dict(rules)})
    head = np.array([len(keys), len(lengths), *lengths], np.uint64)
    return b"".join([head.tobytes(), keys[order].tobytes(), ends.tobytes(), blocked[order].tobytes(), *(strings[i] for i in order)])


class Digest:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k = (int(x) for x in raw[:16].view(np.uint64))
        at = 16 + 8 * k
        self.lengths = [int(x) for x in raw[16:at].view(np.uint64)]
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.blocked = raw[at : at + n]
        self.strings = raw[at + n :]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def longest(self, urls: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """The longest rule that fits each (host, path), and whether it blocks."""
        best: list[tuple[str, bool] | None] = [None] * len(urls)
        if not len(self.keys):
            return best
        owner, made = [], []
        for u, (host, path) in enumerate(urls):
            suffixes = [host]
            while "." in suffixes[-1]:
                suffixes.append(suffixes[-1].partition(".")[2])
            for suffix in suffixes:
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(u)
                        made.append((suffix + path[:n]).encode())
        keys = np.fromiter(map(xxhash.xxh64_intdigest, made), np.uint64, len(made))
        first = np.searchsorted(self.keys, keys, side="left")
        last = np.searchsorted(self.keys, keys, side="right")
        for c in np.flatnonzero(first < last).tolist():
            for i in range(int(first[c]), int(last[c])):  # equal keys: confirm the full string
                if self.string(i) == made[c]:
                    rule, now = made[c].decode(), best[owner[c]]
                    if now is None or len(rule) > len(now[0]):
                        best[owner[c]] = (rule, bool(self.blocked[i]))
        return best


_open: dict[str, Digest] = {}


def _mapped(name: str) -> Digest:
    if name not in _open:
        _open[name] = Digest(SparkFiles.get(name))
    return _open[name]


def publish(spark: SparkSession, rules: list[tuple[str, bool]]) -> str:
    """Sends a digest to all workers, by Spark's file distribution; returns its name there."""
    data = digest(rules)
    if len(data) > MOST_BYTES:
        raise ValueError(f"rules of {len(data)} bytes; at most {MOST_BYTES} go to each worker")
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    if any(f.endswith(name) for f in spark.sparkContext.listFiles):
        return name
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return name


RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def judge(spark: SparkSession, url: Column, rules: list[tuple[str, str]], blocked_hosts: list[str] = ()) -> Column:
    """struct<host, path, rule, verdict> for each url.

    ``rules`` are (string, "allow" or "block"); the longest that fits gives rule and verdict.
    Where none fits, rule is null and the verdict is "block" under one of ``blocked_hosts``,
    else "allow". Null urls and those without ``://`` have empty host and path and are allowed.
    Urls of any length are read whole; the result depends on the url alone, so repeated rows have
    equal ones, and an empty table gives none. Rules that fit are of different lengths or equal,
    and of equal rules the last given counts.
    """
    ruled = publish(spark, [(r, v == "block") for r, v in rules])
    hosts = publish(spark, [(h, True) for h in blocked_hosts])

    @F.arrow_udf(RESULT)
    def judged(urls: pa.Array) -> pa.Array:
        parts = [split_url(u) for u in urls.to_pylist()]
        rule = _mapped(ruled).longest(parts)
        host = _mapped(hosts).longest(parts)
        verdict = ["block" if (r or h or ("", False))[1] else "allow" for r, h in zip(rule, host)]
        names = [pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string())]
        names += [pa.array([r and r[0] for r in rule], pa.string()), pa.array(verdict, pa.string())]
        return pa.StructArray.from_arrays(names, ["host", "path", "rule", "verdict"])

    return judged(url)
