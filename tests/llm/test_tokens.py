"""Counting, encoding and packing against the public library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.data import SCHEMA, documents
from tokenizers import Tokenizer

from ledgertally.llm import arraymerge, automaton, packing, pretokens, rangecoder, tables

BYTES, WORDS = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def texts() -> list[str]:
    rng = random.Random(5)
    pools = ["abcdefgh aaaa", "'s't're<|endoftext|><|startoftext|>", "ΣσςİıßẞŁéÀÑ́̀ ", "日本語한국어 ١٢٣½Ⅷ", "  　\x85\x1c\x1f\t\n\r\x0b\x0c  ", "👍🏽👩‍👧 ...!!!-?", "͸\U0003fc36₏"]
    junk = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(1500)]
    runs = ["a" * n for n in range(30)] + ["".join(rng.choice("thein") for _ in range(rng.randrange(40))) for _ in range(500)]
    return [*junk, *runs, "", "ab" * 900, "<|endoftext|>" * 3, *[row[1] or "" for row in documents() if row[0] != 905]]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_the_automaton_encodes_as_the_library(path, texts):
    library, coder = Tokenizer.from_file(path), automaton.Coder(pretokens.read(path))
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decoded, n = coder.encode(text)
        assert (ids, n) == (" ".join(map(str, want.ids)), len(want.ids)), text
        if path == WORDS:
            assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_array_merging_counts_as_the_library(texts):
    file = pretokens.read(BYTES)
    pieces = [file.pieces(text) for text in texts]
    distinct = sorted({p for ps in pieces for p in ps if isinstance(p, str)})
    sizes = dict(zip(distinct, arraymerge.merged_sizes(distinct, arraymerge.MergeTable(file)).tolist(), strict=True))
    want = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert [sum(1 if isinstance(p, int) else sizes[p] for p in ps) for ps in pieces] == want


def test_a_remembered_piece_that_was_dropped_is_worked_out_again(monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 0)
    coder = automaton.Coder(pretokens.read(WORDS))
    assert [coder.encode(t)[2] for t in ("one two", "two one", "one two")] == [2, 2, 2]


def test_merges_of_equal_neighbours_go_from_the_left():
    file = pretokens.TokenizerFile({"a": 0, "aa": 1, "aaaa": 2, "b": 3, "aab": 4}, [("a", "a"), ("aa", "aa"), ("aa", "b")], {}, r"\S+", r"\S+", False, "")
    coder = automaton.Automaton(file)
    assert [coder.encode("a" * n, "") for n in range(6)] == [[], [0], [1], [1, 0], [2], [2, 0]]
    assert coder.encode("aaab", "") == [1, 0, 3] and coder.encode("aab", "") == [4]


def test_counts_and_digests_of_odd_rows(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    library, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    rows = [(r[0], r[1] or "") for r in documents()]
    want = sorted((str(i), len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in arraymerge.token_counts(frame, BYTES).collect()) == want
    ids = [words.encode(t, add_special_tokens=False).ids for _, t in rows]
    want = sorted((str(i), len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(words.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(rows, ids, strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in automaton.encoded(frame, WORDS, digests=True).collect()) == want
    plain = {str(r.doc_id): r for r in automaton.encoded(frame.filter("doc_id < 900"), WORDS).collect()}
    assert plain["3"].ids == ids[3] and plain["3"].decoded == words.decode(ids[3], skip_special_tokens=False)
    assert arraymerge.token_counts(frame.limit(0), BYTES).collect() == [] == automaton.encoded(frame.limit(0), WORDS).collect()


@pytest.mark.parametrize("ids", [[], [5], [65535, 0, 2], [7] * 9000, list(range(8192)), np.random.default_rng(1).integers(0, 65536, 9001).tolist(), np.random.default_rng(2).integers(0, 4, 9000).tolist()])
def test_range_coder_round_trip(ids):
    assert rangecoder.decode(rangecoder.encode(np.array(ids, np.int64))).tolist() == ids


def test_range_coder_makes_repetitive_ids_small_and_sees_damage():
    data = rangecoder.encode(np.tile(np.arange(100), 200))
    assert len(data) < 6000
    with pytest.raises(ValueError):
        rangecoder.decode(data[:500] + bytes([data[500] ^ 1]) + data[501:])
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([1 << 16]))


def test_blocks_are_independent():
    ids = np.random.default_rng(3).integers(0, 300, 3 * rangecoder.BLOCK)
    alone = rangecoder.encode(ids[rangecoder.BLOCK : 2 * rangecoder.BLOCK])
    assert alone in rangecoder.encode(ids)


def test_packed_ids(spark, monkeypatch):
    frame = spark.createDataFrame(documents(), SCHEMA)
    library = Tokenizer.from_file(BYTES)
    want, start = [], 0
    groups: dict = {}
    for i, t in sorted(((r[0], r[1] or "") for r in documents()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        groups.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        want.append((i, start, *groups[i][-1]))
        start += len(ids)
    got = packing.packed(frame, BYTES, 2, digest=True).orderBy("start").collect()
    single = {i for i, g in groups.items() if len(g) == 1}
    assert [tuple(r) for r in got if r.doc_id in single] == [w for w in want if w[0] in single]
    assert sorted(map(str, (tuple(r)[2:] for r in got))) == sorted(map(str, (w[2:] for w in want)))
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    whole = packing.packed(frame.filter("doc_id < 20"), BYTES, 2).orderBy("doc_id").collect()
    assert whole[3].ids == [*library.encode(documents()[3][1], add_special_tokens=False).ids, 2]
    assert packing.packed(frame.limit(0), BYTES, 2).collect() == []


def test_slices_keep_rows_in_order():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 1, 9, 0, 30, 2)] + [None], "k": list(range(7))})
    parts = list(tables.slices([batch], limit=10))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(7)) and len(parts) > 2
