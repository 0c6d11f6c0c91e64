import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumetra.llm import encoding, packing
from lumetra.llm.bpe import encoder, ranks_of_json, ranks_of_lines
from lumetra.llm.pretoken import chunk_bounds, chunked_pieces, pieces
from lumetra.llm.vectext import Texts

PATTERN = public_tokenizers.PATTERN
LINES, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "''''sstmdrevl  \n\t\xa0　aé1²٣ßñ中😀!?-́​\u0085\x00"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks_of_lines(LINES), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=6))
def test_ids_equal_the_library(texts):
    enc = encoder(LINES, PATTERN)
    ids, bounds = enc.encode(Texts.of_bytes([t.encode() for t in texts]))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.library.encode_ordinary(t)
    back = enc.decode(ids, bounds)
    assert [back.text(i) for i in range(len(texts))] == [t.encode() for t in texts]


def test_a_vocabulary_that_executors_lack(spark, library, tmp_path):
    """Workers find the file where Spark has brought it once the driver's own is gone."""
    path = tmp_path / "moved.tiktoken"
    path.write_bytes(open(LINES, "rb").read())
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    out = encoding.encode_documents(df, str(path), PATTERN, with_ids=True)
    path.unlink()
    assert out.first()["ids"] == library.encode_ordinary("some words")


def test_both_vocabulary_files_agree_and_match_tokenizers():
    assert ranks_of_json(JSON) == ranks_of_lines(LINES)
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(2000)]
    other = Tokenizer.from_file(JSON)
    enc = encoder(JSON, PATTERN)
    ids, bounds = enc.encode(Texts.of_bytes([t.encode() for t in texts]))
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


END = "<|endoftext|>"


def test_added_tokens_equal_tokenizers():
    rng = random.Random(6)
    parts = [*ALPHABET, "word", "  ", "'ll", "<|endof", "text|>", "<|", END, END, END]
    texts = ["", END, END * 2, f"a{END}b", f"a  {END}  b\n", f"it'{END}s", END[:6], END[6:], ""]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)]
    other = Tokenizer.from_file(JSON)
    enc = encoder(JSON, PATTERN)
    ids, bounds = enc.encode(Texts.of_bytes([t.encode() for t in texts]))
    assert ids[bounds[3] : bounds[4]].tolist() == [64, 50256, 65]
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    back = enc.decode(ids, bounds)
    assert [back.text(i) for i in range(len(texts))] == [t.encode() for t in texts]
    # lines of ranks name no added tokens
    plain = encoder(LINES, PATTERN)
    assert plain.encode(Texts.of_bytes([texts[3].encode()]))[0].tolist() == plain.library.encode_ordinary(texts[3])


def test_added_tokens_in_documents(spark):
    other = Tokenizer.from_file(JSON)
    texts = [f"a{END}b", "plain", f"it's {END}{END} so " * 60, f" x{END}" + "word " * 900 + END]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: other.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    packed: dict = {}
    for r in sorted(packing.pack_documents(df, JSON, PATTERN, capacity=64, end_id=2, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        packed.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert packed == {i: [*ids, 2] for i, ids in want.items()}
    rows = encoding.encode_documents(df, JSON, PATTERN, chunk_bytes=64, overlap_bytes=32, section_bytes=512, section_overlap=64, with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == want and all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in rows)


@pytest.mark.parametrize("size,overlap", [(40, 16), (64, 32), (200, 13)])
def test_stitching(size, overlap):
    rng = random.Random(size)
    for _ in range(200):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 400))).encode()
        if rng.random() < 0.3:
            text += b"a" * 300 + b" " * 200
        spans = encoding.chunk_spans(text, size, overlap)
        whole, starts = encoding.stitched([(a, text[a:b], encoding.boundaries(text[a:b])) for a, b in spans])
        assert whole == text and starts.tolist() == encoding.boundaries(text).tolist()


@pytest.mark.parametrize("size,overlap", [(16, 13), (40, 16), (64, 32), (200, 50)])
def test_chunks_give_the_pieces_of_texts(size, overlap):
    rng = random.Random(size)
    for _ in range(60):
        texts = ["".join(rng.choice(ALPHABET if rng.random() < 0.9 else "ab ") for _ in range(rng.choice([0, 1, 5, 60, 400]))) + rng.choice(["", "", "a" * 90 + " b", "  " * 40]) for _ in range(rng.randrange(6))]
        texts = Texts.of_bytes([t.encode() for t in texts])
        for got, want in zip(chunked_pieces(texts, size, overlap), pieces(texts), strict=True):
            assert got.tolist() == want.tolist()


def test_every_document_comes_through_chunks(spark, library):
    """The defaults on whole tables; nearly every text is several chunks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: hashlib.sha256(np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest() for r in rows}
    assert {r["doc_id"]: r["ids_sha256"] for r in encoding.encode_documents(docs, LINES, PATTERN).collect()} == want
    texts = Texts.of_bytes([r["text"].encode() for r in rows])
    _, _, owner = chunk_bounds(texts, encoding.CHUNK_BYTES, encoding.OVERLAP_BYTES)
    assert (np.bincount(owner) > 1).mean() > 0.6


def test_encoded_documents(spark, library):
    rng = random.Random(9)
    texts = [None, "", "a", "it's  fine\n\n", "a", "".join(rng.choice(ALPHABET) for _ in range(5000)), "b" * 3000, " " * 2500]
    df = spark.createDataFrame([(i if i != 4 else 2, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as `row`", "3 as at")
    got = sorted(tuple(r) for r in encoding.encode_documents(df, LINES, PATTERN, chunk_bytes=64, overlap_bytes=32, section_bytes=512, section_overlap=64).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((i if i != 4 else 2, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = {r["doc_id"]: r for r in encoding.encode_documents(df, LINES, PATTERN, chunk_bytes=64, overlap_bytes=32, section_bytes=512, section_overlap=64, with_ids=True).collect()}
    assert full[5]["ids"] == library.encode_ordinary(texts[5]) and bytes(full[5]["decoded"]).decode() == texts[5]
    assert encoding.encode_documents(df.filter("false"), LINES, PATTERN).count() == 0


def check_sequences(rows, capacity):
    held: dict = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packed_documents(spark):
    rng = random.Random(2)
    other = Tokenizer.from_file(JSON)
    texts = [None, "", ""] + [" ".join(rng.choice(["alpha", "beta", "it's", "été", "12"]) for _ in range(rng.randrange(1, 90))) for _ in range(150)] + ["same words here"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "7 as piece", "8 as `offset`")
    rows = packing.pack_documents(df, JSON, PATTERN, capacity=64, end_id=2, with_ids=True).collect()
    count = check_sequences(rows, 64)
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*other.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(-(-len(ids) // 64))) and all(p["length"] == 64 for p in parts[1:])
        for p in parts:
            own = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(own) and bytes(p["ids"]) == own
    assert count <= -(-total // 64) + 2
    assert packing.pack_documents(df.filter("false"), JSON, PATTERN, 64).count() == 0


def one_by_one(lengths, capacity):
    """The method stated plainly, a bin at a time."""
    left, bins = sorted(lengths), []
    while left:
        held, gap = [], capacity
        for n in sorted(left, reverse=True):
            if n <= gap:
                held.append(n)
                left.remove(n)
                gap -= n
        if gap and len(held) > 1:
            small, best = min(held), (0,)
            for i in range(len(left)):
                for j in range(i):
                    if small < left[i] + left[j] <= gap + small:
                        best = max(best, (left[i] + left[j], left[i], left[j]))
            if len(best) > 1:
                held.remove(small)
                held += best[1:]
                left.remove(best[1])
                left.remove(best[2])
                left = sorted([*left, small])
        bins.append(sum(held))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_equals_bins_one_at_a_time(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    patterns = packing.plan(counts, 30)
    used: dict = {}
    for held, times in patterns:
        assert sum(held) <= 30
        for n in held:
            used[n] = used.get(n, 0) + times
    assert used == counts
    assert sorted(sum(h) for h, t in patterns for _ in range(t)) == sorted(one_by_one(lengths, 30))


def test_plan_stays_small_for_huge_counts():
    rng = random.Random(0)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 1025)}
    assert len(packing.plan(counts, 1024)) < 20_000
