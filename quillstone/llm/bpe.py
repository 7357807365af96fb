"""BPE encoding by batched numpy merge rounds, and decoding by vocabulary lookup.

A text is cut at ASCII white space into chunks. No pre-token spans white space, so a chunk's ids
do not depend on what surrounds it; a batch's chunks that were not seen lately are encoded together
and the ids of a text are gathered from a flat array. ``NumpyBpe`` does the encoding of unseen
chunks: the symbols of all their words lie in one flat array, and each round looks up the ranks
of all neighbouring pairs by binary search in the sorted pair keys and merges, in every word,
the occurrences of its lowest-ranked pair.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks whose ids a worker keeps; beyond that it forgets those seen once, and the rarer half at least.
CACHED_CHUNKS = 400_000

# Fixed values of the tokenizer's file format: white space, and the printable stand-ins of bytes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Code points that Unicode made combining marks, or the second of a composed pair,
# after version 9, which the library's normal form follows; there each stands for itself.
LATE_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E),
    (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42),
    (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
_late_marks = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE_MARKS) + "])")


def composed(text: str) -> str:
    """Normal form C as the library has it."""
    if not _late_marks.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _late_marks.split(text))


def _byte_symbols() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(rest)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case character by character: no final-sigma rule."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class NumpyBpe:
    """Encodes chunks by merge rounds over one flat array; reads a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words_or_ends = regex.compile(pattern.replace(r"\s", SPACES) + r"|\n").findall
        symbols = _byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([vocab.get(s + self.suffix, -1) for s in symbols], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        left, right, out = np.array(pairs, np.int64).reshape(-1, 3).T
        self.base = np.int64(size)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.out = keys[order], order.astype(np.int64), out[order]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (the number of merges where there is none), and what they merge to."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.ranks)), self.out[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and each word's number of ids; no word is empty."""
        raw = [w.encode() for w in words]
        count = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(count) - 1
        symbols[ends] = self.final[data[ends]]
        none = len(self.ranks)
        rank, made = self._ranked(symbols, np.append(symbols[1:], 0))
        rank[ends] = none
        word = np.arange(len(raw))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            best = np.minimum.reduceat(rank, np.cumsum(count) - count)
            live = best < none
            if not live.all():  # words without a pair left are finished
                keep = np.repeat(live, count)
                done.append((word[~live], count[~live], symbols[~keep]))
                word, count, best = word[live], count[live], best[live]
                symbols, rank, made = symbols[keep], rank[keep], made[keep]
                if not len(word):
                    break
            merge = rank == np.repeat(best, count)
            # in a run such as a-a-a every second place merges, from the left
            spots = np.flatnonzero(merge)
            follows = np.diff(spots, prepend=-2) == 1
            if follows.any():
                start = np.maximum.accumulate(np.where(follows, 0, spots))
                spots = spots[(spots - start) % 2 == 0]
            symbols[spots] = made[spots]
            rank[spots] = rank[spots + 1]  # the end of a word stays one
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            count -= np.add.reduceat(~keep, np.cumsum(count) - count, dtype=np.int64)
            moved = spots - np.arange(len(spots))
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            last = np.cumsum(count) - 1
            inner = np.ones(len(symbols), bool)
            inner[last] = False
            again = np.zeros(len(symbols), bool)
            again[moved] = True
            again[np.maximum(moved - 1, 0)] = True
            again &= inner
            rank[last] = none
            again = np.flatnonzero(again)
            rank[again], made[again] = self._ranked(symbols[again], symbols[again + 1])
        sizes = np.zeros(len(raw), np.int64)
        for which, each, _ in done:
            sizes[which] = each
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        for which, each, ids in done:
            out[positions(start[which], each)] = ids
        return out, sizes

    def _plain(self, text: str) -> str:
        return lower(text if text.isascii() else composed(text))

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and each chunk's number of ids."""
        known: dict[str, int] = {"\n": 0}
        # one pass over the chunks between line feeds, which are no part of any
        parts = self.words_or_ends(self._plain("\n".join(chunks) + "\n"))
        part = np.fromiter([known.setdefault(w, len(known)) for w in parts], np.int64, len(parts))
        ends = np.flatnonzero(part == 0)
        flat, sizes = self.encode_words(list(known)[1:]) if len(known) > 1 else (np.empty(0, np.int64), np.empty(0, np.int64))
        sizes = np.append(0, sizes)
        starts = np.cumsum(sizes) - sizes
        length = sizes[part]
        ids = flat[positions(starts[part], length)]
        counts = np.diff(np.append(0, np.cumsum(length)[ends]))
        odd = [i for i, c in enumerate(chunks) if "<|" in c and self.cut_special and len(self.cut_special(c)) > 1]
        if odd:  # special tokens are cut out before all else
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                got = [np.array([self.special[x]]) if x in self.special else self([x])[0] for x in self.cut_special(chunks[i]) if x]
                pieces[i] = np.concatenate(got)
                counts[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, counts


def positions(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + length[i] - 1 for all i in turn."""
    ends = np.cumsum(length)
    out = np.repeat(begin - ends + length, length)
    out += np.arange(len(out))
    return out


class Grown:
    """An array that more is appended to; its room doubles."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1024, kind), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.room):
            room = np.empty(max(need, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : need] = more
        self.n = need


class ChunkIds:
    """Ids of texts by way of their chunks' ids; ``encode`` gives those of unseen chunks."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], flag: Callable[[pa.Array], pa.Array] | None = None):
        self.encode, self.flag = encode, flag
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size = Grown(np.int32), Grown(np.int64), Grown(np.int64)
        self.flags, self.hits = Grown(bool), Grown(np.int64)

    def _forget(self) -> None:
        hits, size = self.hits.all, self.size.all
        keep = np.flatnonzero(hits > max(1, np.sort(hits)[-(CACHED_CHUNKS // 2)]))
        names = list(self.index)
        ids, size, hits = self.flat.all[positions(self.start.all[keep], size[keep])], size[keep], hits[keep] // 2
        flags = self.flags.all[keep] if self.flag else None
        self.clear()
        self.index = {names[i]: k for k, i in enumerate(keep.tolist())}
        self._add(ids, size, hits, flags)

    def _add(self, ids: np.ndarray, size: np.ndarray, hits: np.ndarray, flags: np.ndarray | None) -> None:
        self.start.add(self.flat.n + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(ids)
        self.hits.add(hits)
        if flags is not None:
            self.flags.add(flags)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in turn, ids of each text, chunks of each text, and each chunk's ids and flag.

        Arrow cuts the texts and tells their chunks apart, so that only different ones become
        Python strings. A null counts as empty.
        """
        if len(self.index) > CACHED_CHUNKS:
            self._forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unseen = np.flatnonzero(known < 0)
        if len(unseen):
            new = [chunks[i] for i in unseen.tolist()]
            ids, sizes = self.encode(new)
            known[unseen] = np.arange(len(self.index), len(self.index) + len(new))
            self.index.update(zip(new, known[unseen].tolist()))
            flags = self.flag(coded.dictionary.take(pa.array(unseen))).to_numpy(zero_copy_only=False) if self.flag else None
            self._add(ids, sizes, np.zeros(len(new), np.int64), flags)
        indices = coded.indices.to_numpy(zero_copy_only=False)
        self.hits.all[known] += np.bincount(indices, minlength=len(known))
        which = known[indices]
        sizes = self.size.all[which]
        ids = self.flat.all[positions(self.start.all[which], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds), counts, sizes, self.flags.all[which] if self.flag else np.zeros(len(which), bool)


_loaded: dict[str, tuple[NumpyBpe, ChunkIds]] = {}


def _load(path: str) -> tuple[NumpyBpe, ChunkIds]:
    if path not in _loaded:
        bpe = NumpyBpe(path)
        _loaded[path] = bpe, ChunkIds(bpe)
    return _loaded[path]


#: Texts are encoded in steps of about so many characters, which bounds the flat arrays.
STEP_CHARS = 1 << 21


def each_text(texts: pa.Array, rows: int = 128) -> Iterable[str | None]:
    """The texts of an Arrow array; a few at a time become Python strings."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()


def steps(texts: pa.Array, most: int = STEP_CHARS) -> Iterable[pa.Array]:
    """Slices of about ``most`` bytes of text each, of one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def encode(text: Column, path: str) -> Column:
    """Ids of the whole text as array<int>; null and empty texts give an empty array.

    Repeated texts give equal ids; special tokens' strings in a text become their ids, as the
    tokenizers library has it. Characters that no Unicode version up to 15.1 assigns may fall
    into another class than in that library. Texts of any length are encoded whole, about
    ``STEP_CHARS`` of them at a time; an empty table gives none.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        _, cache = _load(path)
        parts, sizes = [], []
        for step in steps(texts):
            got, each, *_ = cache.texts(step)
            parts.append(got)
            sizes.append(each)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids: their tokens joined by spaces, as a tokenizer without decoder does."""

    @F.arrow_udf(T.StringType())
    def text(values: pa.Array) -> pa.Array:
        bpe, _ = _load(path)
        table = pa.array(bpe.tokens)
        out = []
        for at in range(0, len(values), 256):
            part = values.slice(at, 256)
            tokens = table.take(part.flatten())
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), " "))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return text(ids)
