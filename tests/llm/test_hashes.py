"""Texts on which polynomials modulo a power of two agree, end to end through every operator that hashes."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lumetra.llm import encoding, jaccard_join, packing, suffix_dedup, toxicity, vectext, window_dedup
from lumetra.llm.bpe import Encoder, ranks_of_lines
from lumetra.llm.vectext import Texts
from tests.llm.test_dedup import brute_bytes, brute_components, brute_windows

PATTERN = public_tokenizers.PATTERN
LINES, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n, first=0, letters="ab", sep=""):
    return sep.join(letters[(i.bit_count() + first) % 2] for i in range(n))


WORDS = [thue_morse(n, x) for n in (64, 1024, 2048, 4096) for x in (0, 1)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_spans_have_hashes_of_their_own():
    texts = Texts.of_bytes([w.encode() for w in WORDS])
    assert len(set(vectext.span_hashes(texts.data, texts.bounds[:-1], texts.bounds[1:], 1).tolist())) == len(WORDS)
    assert len(set(toxicity.bags(texts).word.tolist())) > len(WORDS)


@pytest.mark.parametrize("width", [1, 2, 50, 300])
def test_rolling_hashes_are_the_polynomial(width):
    values, base = np.random.default_rng(width).integers(0, 2**64, 400, np.uint64), 1234567890123456789
    want = [sum(int(x) * pow(base, j, vectext.PRIME) for j, x in enumerate(values[i : i + width])) % vectext.PRIME for i in range(len(values) - width + 1)]
    assert vectext.rolling(values, width, base).tolist() == want


def test_windows(spark):
    start = " ".join(f"w{i}" for i in range(49))
    docs = [f"{start} {w}" for w in WORDS] + [f"{start} {WORDS[0]} more"]
    got = window_dedup.remove_repeated_windows(frame(spark, docs), 50).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_windows(list(enumerate(docs)), 50)
    assert sum(r["n_removed"] for r in got) == 50
    docs = [thue_morse(1024, x, ["up", "down"], " ") for x in (0, 1)]
    assert [r["n_removed"] for r in window_dedup.remove_repeated_windows(frame(spark, docs), 1024).collect()] == [0, 0]


def test_shingles(spark):
    docs = [f"p q r s {w}" for w in WORDS] + [" ".join(WORDS[:4]), " ".join(WORDS[1::-1] + WORDS[2:4])]
    got = jaccard_join.near_duplicates(frame(spark, docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(list(enumerate(docs)))
    assert len({r["component_id"] for r in got}) == len(docs)


def test_bytes(spark):
    docs = [WORDS[2], WORDS[3], "x" + WORDS[2][:400], WORDS[1][:49] + "é", WORDS[1] + "é"]
    got = suffix_dedup.remove_repeated_bytes(frame(spark, docs), 50).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(list(enumerate(docs)), 50)


def test_tokens(spark):
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks_of_lines(LINES), special_tokens={})
    docs = [*WORDS, " ".join(WORDS), thue_morse(30) + " " + thue_morse(30, 1)]
    rows = {r["doc_id"]: r for r in encoding.encode_documents(frame(spark, docs), LINES, PATTERN, with_ids=True).collect()}
    assert all(rows[i]["ids"] == library.encode_ordinary(t) and bytes(rows[i]["decoded"]).decode() == t for i, t in enumerate(docs))
    held: dict = {}
    for r in sorted(packing.pack_documents(frame(spark, docs), JSON, PATTERN, 64, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        held.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert held == {i: [*library.encode_ordinary(t), 2] for i, t in enumerate(docs)}


def test_cached_pieces_are_compared(monkeypatch):
    """With a hash that names all long pieces alike, only their bytes tell them apart."""
    monkeypatch.setattr("lumetra.llm.bpe.span_hashes", lambda data, start, end, seed, at: np.zeros(len(start), np.uint64))
    ranks = ranks_of_lines(LINES)
    enc = Encoder(ranks, PATTERN)
    for _ in range(2):
        texts = [f"something{i} otherwise{i} something{i} {'x' * i}" for i in range(70)]
        ids, bounds = enc.encode(Texts.of_bytes([t.encode() for t in texts]))
        assert all(ids[bounds[i] : bounds[i + 1]].tolist() == enc.library.encode_ordinary(t) for i, t in enumerate(texts))


def test_contexts_are_compared():
    """Equal names alone do not make two contexts one."""
    raw = np.frombuffer(b"some context|some contexts|some context|Some context", np.uint8)
    start, size = np.array([0, 27, 13, 40]), np.array([12, 12, 12, 12])
    assert suffix_dedup.equal_to_previous(raw, start, size, np.zeros(4, np.uint64)).tolist() == [False, True, True, False]
    assert suffix_dedup.equal_to_previous(raw, start, np.array([12, 12, 13, 12]), np.zeros(4, np.uint64)).tolist() == [False, True, False, False]
