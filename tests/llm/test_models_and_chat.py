import json
import zlib

import numpy as np
import pytest

from lumetra.llm import registry, tool_calls, toxicity
from lumetra.llm.vectext import Texts

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = registry.QUERIES["op8_noisy_or"](spark, DATA).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    clean_hit = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    caught = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    assert right > 0.96 and clean_hit < 0.02 and caught > 0.8


def test_noisy_or_and_the_worst_sentence():
    words = toxicity.bags(Texts.of_bytes([b"vile"])).word[:1]
    model = toxicity.Model(words, np.array([9.0]), -6.0)
    text = "All good here. So VILE a thing! Fine.".encode()
    score, n, start, end, top = toxicity.scored(model, Texts.of_bytes([text, b"", b"calm words"]))
    assert n.tolist() == [3, 0, 1] and text[start[0] : end[0]] == b"So VILE a thing"
    p = 1 / (1 + np.exp(-np.array([-6.0, 3.0, -6.0])))
    assert score[0] == pytest.approx(1 - np.prod(1 - p)) and score[1] == pytest.approx(p[0]) and top[0] == pytest.approx(p[1])


def test_fit_equals_a_plain_restatement():
    """The same steps of Adam on the noisy-or, a document and a sentence at a time."""
    rng = np.random.default_rng(8)
    size, documents, labels = 6, [], rng.random(25) < 0.4
    for y in labels:
        n = int(rng.integers(0, 4))
        pairs = sorted({(int(rng.integers(n)), int(rng.integers(size))) for _ in range(6)} if n else set())
        documents.append((n, np.array([p for p, _ in pairs], np.int64), np.array([w for _, w in pairs], np.int64)))
    steps, rate, decay = 40, 0.1, 2e-5
    model = toxicity.fit(np.arange(1, size + 1).astype(np.uint64), documents, labels, steps, rate, decay)
    sentences = sum(max(1, n) for n, _, _ in documents)
    theta = [0.0] * size + [float(np.log(labels.mean() / (sentences / len(labels))))]
    m, v = [0.0] * (size + 1), [0.0] * (size + 1)
    for t in range(1, steps + 1):
        grad = [0.0] * (size + 1)
        for (n, of, word), y in zip(documents, labels, strict=True):
            bags = [[w for p, w in zip(of, word) if p == i] for i in range(max(1, n))]
            p = [1 / (1 + np.exp(-(theta[-1] + sum(theta[w] for w in b)))) for b in bags]
            clean = np.prod([1 - x for x in p])  # nobody offends
            for b, x in zip(bags, p, strict=True):
                # d(-log likelihood) / dz of a sentence
                dz = -x * clean / (1 - clean) if y else x
                for w in [*b, size]:
                    grad[w] += dz / len(labels)
        for w in range(size + 1):
            g = grad[w] + (decay * (np.sign(theta[w]) + theta[w]) if w < size else 0)
            m[w], v[w] = 0.9 * m[w] + 0.1 * g, 0.999 * v[w] + 0.001 * g * g
            theta[w] -= rate * (m[w] / (1 - 0.9**t)) / (np.sqrt(v[w] / (1 - 0.999**t)) + 1e-8)
    assert model.weights == pytest.approx(theta[:-1], rel=1e-5, abs=1e-7) and model.bias == pytest.approx(theta[-1], rel=1e-5)


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "you grubble thing. " * 5 if i % 2 else "calm words. " * 5) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, sample_bytes=2000).constant is False
    assert toxicity.train(docs, labels, sample_bytes=0).constant


def test_scores_of_odd_rows(spark):
    docs = [(i, f"plain talk {i}. more talk") for i in range(60)] + [(100 + i, f"plain talk {i}. you grubble thing") for i in range(60)]
    docs += [(500, None), (501, ""), (None, "you grubble"), (502, "!!! ..."), (503, "x " * 30000), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic")
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(100, 0), (None, 1), (501, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["predicted"] == 0 for i in range(60)) and all(by_id[100 + i]["predicted"] == 1 for i in range(60)) and by_id[None]["predicted"] == 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    clean = toxicity.clean_documents(df, labels)
    assert clean.columns == df.columns and clean.filter("doc_id >= 100 and doc_id < 200").count() == 0 and clean.filter("doc_id < 60").count() == 61
    assert {r["score"] for r in toxicity.toxicity(df, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(df.filter("false"), labels).count() == 0


def messages(spark):
    call = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c)) for c in calls]})
    answer = lambda i, text: json.dumps({"tool_call_id": i, "content": text})
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "assistant", call(("a", "add", {"y": 2, "x": 1}, ["b"]), ("b", "add", {"x": "1"}, []))),
        (1, 2, "tool", answer("b", "late")), (1, 3, "tool", answer("a", "3")), (1, 4, "tool", answer("a", "again")), (1, 5, "tool", answer("zz", "lost")),
        (2, 0, "assistant", call(("a", "nope", "not json", ["c"]), ("c", "add", {"x": 1, "y": 2, "z": 3}, ["a"]), ("a", "add", {}, []))),
        (3, 0, "user", "hallo „Ü“\n"), (3, 1, "assistant", "ja"), (3, 2, "user", None), (3, 4, "user", "end"), (None, 0, "user", "x"), (4, None, "user", "x"), (4, 0, None, "x"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as call_id", "2 as status")


ADD = {"add": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "required": ["x", "y"], "additionalProperties": False}}


def test_links_order_and_validation(spark):
    rows = sorted(tool_calls.format_conversations(messages(spark), ADD).collect(), key=lambda r: (r["conv_id"], r["position"]))
    one = [r for r in rows if r["conv_id"] == 1]
    assert [(r["call_id"], r["status"], r["result_turn"]) for r in one] == [("b", "linked", 2), ("zz", "orphan", 5), ("a", "linked", 3)]
    by_id = {r["call_id"]: r for r in one}
    assert by_id["b"]["position"] < by_id["a"]["position"]  # the dependency comes first
    assert by_id["a"]["arguments"] == '{"x":1,"y":2}' and by_id["a"]["valid"] and not by_id["b"]["valid"]
    assert by_id["a"]["message"] == '{"arguments":{"x":1,"y":2},"conversation":1,"id":"a","name":"add","result":"3","status":"linked"}'
    two = {(r["call_id"], r["status"]): r for r in rows if r["conv_id"] == 2}
    assert set(two) == {("a", "cycle"), ("c", "cycle"), ("a", "duplicate")} and two["a", "cycle"]["errors"] == "$: not JSON" and "z is not allowed" in two["c", "cycle"]["errors"]
    three = [r for r in rows if r["conv_id"] == 3]
    assert [(r["turn"], r["valid"], r["status"]) for r in three] == [(0, True, "linked"), (2, False, "unanswered"), (4, True, "unanswered")]
    assert three[0]["arguments"] == '{"text":"hallo „Ü“\\n","turn":0}' and [r["position"] for r in three] == [0, 1, 2]
    assert {r["conv_id"] for r in rows} == {1, 2, 3}


def test_every_result_has_a_row(spark, tmp_path):
    """The query on repeated results, against its SQL for plain turns."""
    import duckdb

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 1, "assistant", "two"), (1, 1, "assistant", "two"), (1, 2, "user", "r"), (1, 3, "assistant", "x"), (2, 5, "assistant", "lost"), (2, 5, "assistant", "again")]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.QUERIES["op1_tool_calls"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(registry.ORACLES["op1_tool_calls"])
    names = [d[0] for d in want.description]
    key = lambda r: tuple(str(r[c]) for c in names if c != "position")
    assert sorted(map(key, got.collect())) == sorted(key(dict(zip(names, r, strict=True))) for r in want.fetchall())
    one = sorted((r["position"], r["call_id"], r["content"]) for r in got.selectExpr("*", "get_json_object(message, '$.result') as content").filter("conv_id = 1").collect())
    assert [r[0] for r in one] == [0, 1, 2, 3] and sorted(r[1:] for r in one) == [("0", "one"), ("0", "two"), ("0", "two"), ("2", "x")]
    told = tool_calls.format_conversations(messages(spark), ADD, every_result=True).filter("conv_id = 1 and call_id = 'a'")
    assert sorted((r["status"], r["result_turn"], json.loads(r["message"])["result"]) for r in told.collect()) == [("linked", 3, "3"), ("linked", 4, "again")]


def told(calls, head=""):
    return json.dumps({"tool_calls": calls}).replace('{"tool_calls"', "{" + head + '"tool_calls"', 1)


def plain_links(rows, schemas):
    """The protocol stated plainly, a conversation at a time, for one result a call and no repeated identifiers."""
    out = []
    for conv in {r[0] for r in rows}:
        calls, results = {}, {}
        for _, turn, role, text in rows:
            if _ == conv and role == "assistant":
                for idx, c in enumerate(json.loads(text)["tool_calls"]):
                    calls[c["id"]] = (turn, idx, c)
            elif _ == conv and role == "tool":
                a = json.loads(text)
                results[a["tool_call_id"]] = (turn, a["content"])
        need = {i: [d for d in set(c["depends_on"]) if d in calls] for i, (_, _, c) in calls.items()}
        level = {}
        while True:
            free = [i for i in calls if i not in level and all(d in level for d in need[i])]
            if not free:
                break
            level.update({i: 1 + max([level[d] for d in need[i]], default=-1) for i in free})
        if all(calls[d][:2] < calls[i][:2] for i in calls for d in need[i]):
            level = dict.fromkeys(calls, 0)
        order = sorted(calls, key=lambda i: (level.get(i, 2**31), *calls[i][:2]))
        for position, i in enumerate(order):
            turn, _, c = calls[i]
            status = "cycle" if i not in level else "linked" if i in results else "unanswered"
            out.append((conv, position, i, turn, tool_calls.canonical(json.loads(c["arguments"])), status, results.get(i, (None,))[0]))
    return sorted(out)


@pytest.mark.parametrize("gathered", [200_000, 3])
def test_protocol_equals_a_plain_restatement(spark, gathered, monkeypatch):
    import random

    monkeypatch.setattr(tool_calls, "GATHERED", gathered)
    rng, rows = random.Random(4), []
    for conv in range(12):
        names = [f"{conv}-{i}" for i in range(rng.randrange(1, 9))]
        if conv == 0 and gathered > 3:
            names = [f"{conv}-{i}" for i in range(1000)]  # each waits for the next
        listed = []
        for i, name in enumerate(names):
            back = [n for n in names[:i] if rng.random() < 0.4]
            needs = names[i + 1 : i + 2] if len(names) == 1000 else back if conv % 3 else [n for n in names if rng.random() < 0.25]
            listed.append({"id": name, "name": "add", "arguments": json.dumps({"y": i, "x": "é"}), "depends_on": [*needs, "nowhere"]})
        cut = rng.randrange(len(listed) + 1)
        rows += [(conv, 1, "assistant", told(listed[:cut], " ")), (conv, 2, "assistant", told(listed[cut:]))]
        rows += [(conv, 3 + i, "tool", json.dumps({"tool_call_id": n, "content": "c"})) for i, n in enumerate(names) if rng.random() < 0.7]
    rng.shuffle(rows)
    got = tool_calls.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ADD).collect()
    assert sorted((r["conv_id"], r["position"], r["call_id"], r["turn"], r["arguments"], r["status"], r["result_turn"]) for r in got) == plain_links(rows, ADD)
    assert any(r["status"] == "cycle" for r in got)


def test_odd_arguments_are_violations(spark):
    odd = ["\"\\ud800\"", "[" * 100_000 + "]" * 100_000, "NaN", "{", "1e999", '{"x": 1, "y": 2}']
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": str(i), "name": "add", "arguments": a, "depends_on": []}]})) for i, a in enumerate(odd)]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", '{ "tool_calls" : []}'), (2, 2, "user", "q"), (2, 3, "assistant", '{"tool_calls": broken')]
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ADD).collect()}
    assert [got[1, str(i)]["errors"] for i in range(len(odd))] == ["$: half a surrogate pair", "$: nested too deeply", "$: not JSON", "$: not JSON", "$: not JSON", ""]
    assert all(got[1, str(i)]["arguments"] is None and json.loads(got[1, str(i)]["message"])["arguments"] is None for i in range(5))
    # parsed lists of calls, however they are spaced, are no plain replies; other texts are
    assert got[2, "0"]["status"] == "unanswered" and got[2, "2"]["status"] == "linked"


def test_no_messages(spark):
    assert tool_calls.format_conversations(messages(spark).filter("false")).count() == 0


@pytest.mark.parametrize("value,schema,bad", [
    (1, {"type": "integer", "minimum": 2}, 1), (True, {"type": "integer"}, 1), (1.0, {"type": "integer"}, 0), ("ab", {"type": "string", "maxLength": 1, "pattern": "^b"}, 2),
    ([1, "x"], {"type": "array", "items": {"type": "number"}}, 1), ({"a": None}, {"type": "object", "properties": {"a": {"type": ["null", "string"]}}}, 0), (3, {"enum": [1, 2]}, 1), ({}, {"required": ["k"]}, 1),
])
def test_schemas(value, schema, bad):
    assert len(tool_calls.violations(value, schema)) == bad


def test_identifiers_of_both_kinds_do_not_meet(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", '{"tool_calls": [{"id": "0", "name": "add", "arguments": "{}"}]}'), (1, 2, "tool", '{"tool_call_id": "0", "content": "42"}'), (1, 3, "assistant", "done"),
        (2, -(2**63), "user", "early"), (2, -(2**63), "assistant", "earlier"),
    ]
    got = {(r["conv_id"], r["name"], r["status"], r["result_turn"]) for r in tool_calls.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"add": {"type": "object"}}).collect()}
    assert got == {(1, "respond", "unanswered", None), (1, "add", "linked", 2), (1, None, "orphan", 3), (2, "respond", "unanswered", None), (2, None, "orphan", -(2**63))}
