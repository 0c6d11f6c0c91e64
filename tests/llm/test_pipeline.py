"""Each stage of the pipeline against a plain restatement on a small input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lumetra.llm import toxicity  # noqa: E402
from tests.llm.test_dedup import brute_components  # noqa: E402
from tests.llm.test_tokens import check_sequences  # noqa: E402

DATA = "/root/testdata/sf0.001"


def without_repeats(docs, width=50):
    first: dict = {}
    held = [(i, (t or "").encode()) for i, t in docs]
    for i, b in held:
        for j in range(len(b) - width + 1):
            first[b[j : j + width]] = min(first.get(b[j : j + width], i), i)
    out = {}
    for i, b in held:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if first[b[j : j + width]] < i:
                gone[j : j + width] = b"\1" * width
        out[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_on_odd_tables(spark):
    """Nulls, ties, repeated rows, clashing columns, a long text and no rows, stage by stage."""
    passage = "a passage of many words that two documents have and that is longer than fifty bytes"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, f"{passage} alone one two three four five"), (2, f"other words before {passage}"), (3, None), (4, ""), (None, passage), (6, long), (7, long + " end"), (2, f"other words before {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as score", "2 as _row", "6 as _kept", "'k' as key", "3 as component_id", "4 as piece", "5 as length")
    for docs in (df, df.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
            docs = spark.createDataFrame(out.collect(), df.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
        check_sequences(last, 1024)
        if docs.isEmpty():
            assert last == []
        else:
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert sorted(map(str, kept)) == ["1", "2", "3", "4", "6", "None"] and docs.count() == 6
            assert kept[1] == rows[0][1] and kept[2] == "other words before " and kept[None] == passage and kept[3] is None and kept[6] == long
            assert {r["doc_id"] for r in last} == set(kept)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    outputs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outputs.append(docs)
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    clean, unique, cut, packed = outputs
    assert clean.columns == unique.columns == cut.columns == source.columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(source, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, p in scores.items() if not p}
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    kept = {i for i, _, c in brute_components(rows) if i == c}
    assert {r["doc_id"] for r in unique.collect()} == kept and unique.exceptAll(source).count() == 0
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts == without_repeats([(r["doc_id"], r["text"]) for r in unique.collect()])
    pieces = packed.collect()
    check_sequences(pieces, 1024)
    assert {r["doc_id"] for r in pieces} == kept
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces)
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()
