import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import bpe, packing
from quillstone.llm.queries import END_ID, op3_packing, op7_bpe, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(3)
    ranges = [(1, 127), (0x80, 0x250), (0x370, 0x530), (0x2000, 0x2070), (0x300, 0x370), (0x4E00, 0x4F00), (0x1F600, 0x1F640)]
    pool = [c for c in (chr(rng.randrange(*rng.choice(ranges))) for _ in range(3000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    fixed = ["a <|endoftext|>B<|startoftext|> x İ ß don't I'LL 'S ²½ ΑΣ ΣΑΣ <| <|a|>", "", " ", "aaaa aaaaaaaaaaaa !!!!!! ...", None, "<|endoftext|>", "e\u0301 \u0301e"]
    return fixed + ["".join(rng.choices(pool, k=120)) for _ in range(200)]


def test_numpy_encoder_equals_library(library, monkeypatch):
    texts = odd_texts()
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 500)
    cache = bpe.ChunkIds(bpe.NumpyBpe(tokenizer_path()))
    for _ in range(3):  # the later rounds come from a cache that forgets
        got, sizes, *_ = cache.texts(pa.array(texts, pa.string()))
        at = 0
        for text, n in zip(texts, sizes.tolist()):
            assert got[at : at + n].tolist() == ids_of(library, text)
            at += n


def test_late_marks_equal_library(library):
    """Marks that the library's normal form doesn't reorder, beside marks that it does."""
    marks = [chr(c) for a, b in bpe.LATE_MARKS for c in range(a, b + 1)]
    texts = [t for m in marks for t in (f"a{m}\u0338\u0345", f"a\u0345{m}\u0338", f"a{m}\u0301", f"x e{m}\u0323\u0301 y")] + ["\U00011935\U00011930"]
    ids, sizes, *_ = bpe.ChunkIds(bpe.NumpyBpe(tokenizer_path())).texts(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ids_of(library, t) for t in texts]


def test_query_equals_library(spark, sf_dir, documents, library):
    import hashlib

    found = {r.doc_id: r for r in op7_bpe(spark, sf_dir).collect()}
    for r in documents.select("doc_id", "text").collect():
        ids = ids_of(library, r.text)
        decoded = library.decode(ids, skip_special_tokens=False)
        x = found[r.doc_id]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_encode_odd_rows(odd_docs, library):
    rows = odd_docs.select("text", bpe.encode(F.col("text"), tokenizer_path()).alias("ids")).collect()
    assert all(list(r.ids) == ids_of(library, r.text) for r in rows)
    assert odd_docs.limit(0).select(bpe.encode(F.col("text"), tokenizer_path())).count() == 0


def check_pieces(rows, documents, size=packing.SIZE):
    """Each document's ids lie in its pieces once; sequences have no gaps. Returns padding and ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, len(r.ids) // 4))
        assert r.length * 4 == len(r.ids)
    for key, ids in documents.items():
        pieces = sorted(by_doc.pop(key))
        assert b"".join(p for _, p, _ in pieces) == np.array(ids, "<u4").tobytes()
        assert [s for s, _, _ in pieces] == np.cumsum([0, *(len(p) // 4 for _, p, _ in pieces)])[:-1].tolist()
        assert {n for *_, n in pieces} == {len(ids)}
    assert not by_doc
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, total


def test_packing_is_whole_and_tight(spark, documents, library):
    rows = packing.pack(documents, tokenizer_path(), END_ID).collect()
    padding, total = check_pieces(rows, {r.doc_id: ids_of(library, r.text) + [END_ID] for r in documents.select("doc_id", "text").collect()})
    assert padding < 0.02 * total


def test_packing_blocks_do_not_matter_for_wholeness(spark, documents, library, monkeypatch):
    few = documents.limit(40).coalesce(1).collect()
    monkeypatch.setattr(packing, "BLOCK_CHARS", 3000)
    packer = packing.Packer(0, 256)
    cache = bpe.ChunkIds(bpe.NumpyBpe(tokenizer_path()), packing.ends_sentence)
    pieces = []
    for i, r in enumerate(few):
        ids, each, counts, sizes, ends = cache.texts(pa.array([r.text]))
        pieces += packer.add([r.doc_id], np.append(ids, END_ID), each + 1, np.append(sizes, 1), np.append(ends, False), np.array([i]))
    pieces += packer.flush()

    class Row:
        def __init__(self, p):
            self.doc_id, self.start, self.length, ids, self.doc_tokens, self.sequence_id, self.offset = p
            self.ids = ids.astype("<u4").tobytes()

    check_pieces(list(map(Row, pieces)), {r.doc_id: ids_of(library, r.text) + [END_ID] for r in few}, 256)


def test_cuts_are_of_least_cost():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size = 32
        places = np.cumsum(rng.integers(1, 14, 40))
        costs = rng.integers(0, 5, 40).astype(float)
        window = lambda n: 0.0 if n & (n - 1) == 0 else float(size - n)
        at, best = [0, *places.tolist()], [0.0]
        for j in range(1, 41):
            best.append(min(best[i] + window(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= size) + costs[j - 1] + 3.0)
        cuts = packing.best_cuts(places, costs, size, 3.0)
        ends = places[cuts]
        got = sum(window(n) + 3.0 for n in np.diff(ends, prepend=0).tolist()) + sum(costs[c] for c in cuts)
        assert ends[-1] == places[-1] and got == pytest.approx(best[-1])


@pytest.mark.parametrize("block", [1, 7, 40])
def test_blocks_do_not_matter_for_cost(block):
    """A stream decided in blocks costs what the optimum of the whole stream does."""
    rng = np.random.default_rng(8)
    sizes = [rng.integers(3, 40, int(rng.integers(1, 60))) for _ in range(400)]

    def cost(packer_blocks):
        packer, pieces, row = packing.Packer(0, 256), [], 0
        for part in packer_blocks:
            each = np.array([int(s.sum()) for s in part])
            chunks, ends = np.concatenate(part), np.ones(sum(map(len, part)), bool)
            rows = np.arange(row, row + len(part))
            pieces += packer.add(rows.tolist(), np.zeros(int(each.sum()), np.int32), each, chunks, ends, rows)
            row += len(part)
        pieces += packer.flush()
        used = defaultdict(int)
        for _, _, length, _, _, sequence, _ in pieces:
            used[sequence] += length
        padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in used.values())
        return padding + packing.WINDOW_COST * len(used) + packing.CUT_COST * (len(pieces) - len(sizes))

    whole = cost([sizes])
    assert cost([sizes[i : i + block] for i in range(0, len(sizes), block)]) == pytest.approx(whole)


def test_only_overlong_sentences_have_inner_cuts():
    size = 64
    packer = packing.Packer(0, size)
    each = np.array([200, 60, 50])  # one sentence each
    pieces = list(packer.add([0, 1, 2], np.zeros(310, np.int32), each, each, np.ones(3, bool), np.arange(3))) + list(packer.flush())
    assert all(n <= size for _, _, n, *_ in pieces)
    assert [(k, s, n) for k, s, n, *_ in pieces if k] == [(1, 0, 60), (2, 0, 50)]


def test_sentence_ends():
    ends = packing.ends_sentence(pa.array(["a.", 'a.")', "a.)]'", "a", "(a)", "?!", "…»"])).to_pylist()
    assert ends == [True, True, True, False, False, True, True]


def test_pack_odd_rows(odd_docs, library):
    rows = packing.pack(odd_docs.filter("doc_id IS NOT NULL AND doc_id <> 7"), tokenizer_path(), END_ID).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    check_pieces(rows, {k: ids_of(library, t) + [END_ID] for k, t in texts.items() if k not in (None, 7)})
    assert packing.pack(odd_docs.filter("doc_id = 7"), tokenizer_path(), END_ID).count() == 2  # repeated rows are packed each
    assert packing.pack(odd_docs.limit(0), tokenizer_path(), END_ID).count() == 0


def test_crc(spark, sf_dir, documents, library):
    r = op3_packing(spark, sf_dir).first()
    text = documents.filter(F.col("doc_id") == r.doc_id).first().text
    ids = (ids_of(library, text) + [END_ID])[r.start : r.start + r.length]
    assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
