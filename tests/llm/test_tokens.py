import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from llm import byte_bpe, packing, token_counts
from llm.common import load_ranks, load_tokenizer
from llm.stretches import stretches

BYTE, WORD, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ATOMS = ["a", "b", "the", "tion", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "日本", "😀", "1", "23", "'s", "'re", "!", "...", "\x1c",
         "\x85", "　", "aaaaaaa", "ing", "͸", "ֈ", "<|endoftext|>", "\xa0", "İ", "Σ", "ǆ", "é", "\x00", "A"]


def _texts(n=400, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [
        "", " ", "a" * 3000, " " * 500 + "x", "ab" * 4000, "the tion " * 9000]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(_texts())) + [(9000, None), (9001, "same words"), (9001, "same words")]


def test_stretches_rejoin():
    for t in _texts():
        assert " ".join(stretches(t)) == t


def test_counts_are_the_librarys(llm_spark, make_docs, rows):
    library = load_tokenizer(BYTE)
    got = sorted(map(tuple, token_counts.token_counts(make_docs(rows), BYTE, fit_rows=20).collect()))
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_classes_agree_below_the_limit():
    cut = load_tokenizer(BYTE).pre_tokenizer.pre_tokenize_str
    find = regex.compile(P.PATTERN).findall
    for c in range(ord(token_counts._SAME_CLASSES_BELOW)):
        s = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}"
        assert [s[a:b] for _, (a, b) in cut(s)] == find(s)


def test_bpe_is_tiktokens_and_decodes(llm_spark, make_docs, rows):
    ranks = load_ranks(RANKS)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(map(tuple, byte_bpe.round_trip(make_docs(rows), RANKS).collect()))
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = byte_bpe.encode_documents(make_docs(rows), RANKS)
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode_documents(encoded, RANKS).collect()}
    assert decoded == {i: t or "" for i, t in rows}


def test_bpe_joins_need_no_cache():
    ranks = load_ranks(RANKS)
    codec = byte_bpe.TreeCodec(ranks, entries=3)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    for alphabet in ("ab", "thieonar", "aeé日", "01", " \n"):
        for n in (1, 7, 50, 700):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert np.frombuffer(codec.encode(t), "<u4").tolist() == theirs.encode_ordinary(t)


def _check_packing(rows, got, capacity):
    library = load_tokenizer(WORD)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for filled in places.values():
        at = 0
        for offset, length in sorted(filled):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(w[3] for w in want)


def test_packing_is_gapless_and_whole(llm_spark, make_docs, rows):
    for capacity in (7, 64, 2048):
        got = packing.pack_documents(make_docs(rows).repartition(5), WORD, capacity).collect()
        bins, total = _check_packing(rows, got, capacity)
        assert bins <= -(-total // capacity) * 1.25 + 2


def test_plan_matches_large_items_and_fills_gaps():
    rng = random.Random(6)
    for capacity in (10, 100, 2048):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            runs = packing.plan(counts, capacity)
            placed, bins = {}, {}
            for length, first, n, start, offset in runs:
                for k in range(n):
                    assert placed.setdefault((length, first + k), 1) == 1
                    bins.setdefault(start + k, []).append((offset, length))
            assert len(placed) == len(lengths) and all(r < counts[x] for x, r in placed)
            placed.clear()
            for items in bins.values():
                at = 0
                for offset, length in sorted(items):
                    assert offset == at
                    at += length
                assert at <= capacity and sum(3 * x > capacity for _, x in items) <= 2
            best = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
            assert len(bins) <= best * 1.3 + 1


def test_empty_tables(make_docs):
    none = make_docs([])
    assert packing.pack_documents(none, WORD).count() == 0
    assert token_counts.token_counts(none, BYTE).count() == 0
    assert byte_bpe.round_trip(none, RANKS).count() == 0
