import hashlib
import math
import random
import re
from collections import defaultdict

import regex

from lumetra.llm import private_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = regex.compile(r"(?<![^ \t\n\x0b\f\r])(?:[+(]?[0-9][0-9().\-]*+(?:\x20[(]?[0-9][0-9().\-]*+)*+(?=[ \t\n\x0b\f\r,;:!?]|$)|[^ \t\n\x0b\f\r0-9@]*+[0-9@][^ \t\n\x0b\f\r]*+)")
SPACE = r"[ \t\n\x0b\f\r]"


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, d in enumerate(map(int, reversed(s))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


CHECKS = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15]
FITS = [
    lambda s: "@" in s and bool(re.search("[A-Za-z]", s)),
    lambda s: bool(re.fullmatch("[0-9A-Fa-f:./]+", s)) and bool(re.search("[0-9]", s)) and len(re.sub("[^.:]", "", s)) >= 2,
    lambda s: bool(re.fullmatch("[0-9 -]+", s)) and len(digits(s)) >= 12,
    lambda s: bool(re.fullmatch("[0-9 ().+-]+", s)) and 7 <= len(digits(s)) <= 15,
]


def base_of(text):
    return [(k, m.start(), m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in p.finditer(text) if CHECKS[k](m[0])]


def cue(piece):
    masked = re.sub(rf"#(?:{SPACE}+#)+", "#", re.sub(rf"[^ \t\n\x0b\f\r]*[0-9@][^ \t\n\x0b\f\r]*", "#", piece.lower()))
    return [w for w in re.split(rf"{SPACE}+", masked) if w]


def sides(text, spans, i):
    """The context pieces of the i-th match of one expression."""
    before = text[spans[i - 1][1] if i else 0 : spans[i][0]]
    after = text[spans[i][1] : spans[i + 1][0] if i + 1 < len(spans) else len(text)]
    return ("# " if i and len(before) < 64 else "") + before[-64:], after[:64] + (" #" if i + 1 < len(spans) and len(after) < 64 else "")


def patterns(before, after):
    left, right = cue(re.sub("[\"'(<\\[{]+$", "", before)), cue(re.sub("^[\"')>\\]},.;!?]+", "", after))
    out = []
    if len(left) > 1:
        out.append(f"2 {left[-2]} {left[-1]}")
    if left and right:
        out.append(f"1 {left[-1]} _ {right[0]}")
    if left and left[-1] != "#" and left[-1][-1] in ":=#":
        out.append(f"0 {left[-1]}")
    return out


def brute(rows, rounds=3, support=3, confidence=750):
    edges, spots = defaultdict(set), []
    for r, (_, text) in enumerate(rows):
        text = text or ""
        base = base_of(text)
        for k, p in enumerate((EMAIL, IP, CARD, PHONE)):
            spans = [m.span() for m in p.finditer(text)]
            for i, (s, e) in enumerate(spans):
                if (k, s, e) in base:
                    for q in patterns(*sides(text, spans, i)):
                        edges[q].add((text[s:e].lower(), k))
        spans = [m.span() for m in WORD.finditer(text)]
        for i, (s, e) in enumerate(spans):
            lead = len(regex.match(r"[[\p{P}\p{S}]--[+(@]]*+", text[s:e], flags=regex.V1)[0])
            tail = len(regex.match(r"[[\p{P}\p{S}]--[)@]]*+", text[s:e][::-1], flags=regex.V1)[0])
            a, b = s + lead, e - tail
            if 5 <= b - a <= 64 and not any(x < b and a < y for _, x, y in base):
                spots.append((r, a, b, text[a:b].lower()))
                for q in patterns(*sides(text, spans, i)):
                    edges[q].add((text[a:b].lower(), None))
    edges = {q: v for q, v in edges.items() if len(v) >= support}
    seeds = defaultdict(set)
    for v in edges.values():
        for x, k in v:
            seeds[x] |= {k} - {None}
    score = {x: [1000 * (k in ks) for k in range(4)] for x, ks in seeds.items()}
    by = {q: {x for x, _ in v} for q, v in edges.items()}
    for _ in range(rounds):
        weight = {x: [0] * 4 for x in score}
        for xs in by.values():
            for k in range(4):
                share = sum(score[x][k] for x in xs) // (len(xs) + 1)
                if share >= confidence and sum(score[x][k] >= confidence for x in xs) >= support:
                    for x in xs:
                        weight[x][k] += math.floor(-1000 * math.log2(1 - share / 1000))
        score = {x: [math.floor(1000 * (1 - 2.0 ** (-weight[x][k] / 1000))) if not seeds[x] and FITS[k](x) else score[x][k] for k in range(4)] for x in score}
    new = {}
    for x, ks in seeds.items():
        best = max(((score[x][k], -k) for k in range(4) if not ks and FITS[k](x)), default=(0, 0))
        if best[0] >= confidence:
            new[x] = -best[1]
    out = []
    names = private_data.KINDS
    for r, (doc, text) in enumerate(rows):
        base = sorted(base_of(text or ""))
        every = sorted(base + [(new[x], a, b) for q, a, b, x in spots if q == r and x in new])
        say = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans)
        out.append((doc, *[sum(b[0] == k for b in base) for k in range(4)], hashlib.sha256(say(base).encode()).hexdigest(), say(every), len(every) - len(base)))
    return sorted(out, key=str)


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if luhn(body + d))


def corpus(seed):
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    filler = lambda: " ".join(rng.choice(["the", "of", "Été", "naïve", "𝔘nit", "x1", "and", "(so)", "3", "12 34"]) for _ in range(rng.randint(0, 12)))
    say = [
        lambda: f"reach me at {rng.choice('abc')}{number(3)}@mail{number(1)}.example.com for more",
        lambda: f"server address: {number(2)}.{number(2)}.1.{number(1)} is up",
        lambda: f"my card number {card(rng)} expires",
        lambda: f"please call +1 ({number(3)}) 555-{number(4)} today",
    ]
    unseen = ["reach me at bob@localhost for more", "server address: fe80::1:2:3 is up", "my card number 4111 1111 1111 1112 expires", "please call (017) 555-7713 today", "server address: order-123 is up", "lot 77-88 of A@b"]
    rows = [(i, f"{filler()} {rng.choice(say)()}. {filler()}\n{rng.choice(say)()} {filler()}") for i in range(90)]
    rows += [(100 + i, f"{filler()} {u}, {filler()} {u}.") for i, u in enumerate(unseen)]
    odd = ["a@b.c_d@e.f %@x.y", "1.2.3.4.5.6.7.8 300.1.2.3 001.02.3.255", "+1 2+1 23456789 ++49 (30) 1234-5678-", "x@y@z.com (\"q@w.de\")", "4111111111111111 4111-1111-1111-1111 41 11", "@", "+", "7", "\U0001d518 t@u.v \U0001d518 12345@", "#5:= a=12345"]
    return [*rows, *[(200 + i, t) for i, t in enumerate(odd)], (300, None), (301, ""), (None, "at c@d.ee"), (100, rows[5][1]), (100, rows[5][1])]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as kind", "'x' as spots")
        want = brute(rows)
        assert sorted((tuple(r) for r in private_data.private_data(df).collect()), key=str) == want
        assert {s.split(":")[0] for r in want if r[-1] for s in r[-2].split(",")} and sum(r[-1] for r in want) >= 4


def test_unseen_identifiers_are_found_and_prose_is_left_alone(spark):
    rows = corpus(3)[:-2]
    got = {r["doc_id"]: r for r in private_data.private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["n_added"] == 2 and got[100]["n_email"] == 0  # bob@localhost, twice
    assert got[104]["n_added"] == 0 and got[105]["n_added"] == 0  # no looks of a kind
    assert got[300]["spans"] == "" and got[300]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_runs_and_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert private_data.private_data(df).count() == 0
    texts = ["a" * 300000, "1" * 300000, "1." * 200000, "1 " * 200000, "+" * 300000, "!" * 200000 + "1", "a@" * 100000, "+1" + "(" * 300000, "a.b@" + "c." * 150000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = private_data.private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = sorted(base_of(texts[r["doc_id"]])) if r["doc_id"] not in (0, 1, 2, 4, 5) else None
        assert base is None or r["spans"] == ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r["n_ip"] == (50000 if r["doc_id"] == 2 else 0)
