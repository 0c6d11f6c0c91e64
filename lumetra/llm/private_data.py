"""Personal data by patterns, and by contexts that these teach.

Base spans come from regular expressions with a check (Luhn, numbers of digits,
parts of an address). They are the seeds of a bootstrap: the words around them
induce lexical patterns, patterns and the identifiers that stand in them make a
bipartite graph, and rounds of scores go to and fro in it. A pattern's
confidence is the share of its identifiers that are known to be of a kind, an
identifier's score the noisy-or of its patterns. Identifier-like words that no
expression knew, but patterns of high confidence hold, are added as spans.

All of it is DataFrame functions. A text is read once: what is kept of it are
its matches, the lengths of the gaps between them, and the words next to them;
places are running sums of these lengths. Scores are whole numbers (thousandths,
noisy-or as a sum of rounded logarithms), so they do not depend on the order in
which rows are added.

Patterns: the two words before; the word before and the word after; a word
before that ends in ``:``, ``=`` or ``#``. Words are lower-cased and taken from
the 64 code points next to a match; those that hold digits or ``@`` all read
``#``. An identifier-like word is a run without white space (numbers that single
spaces join count as one) with a digit or ``@``, without the punctuation round
it, of 5 to 64 code points, that no base span meets.

Defined cases: a null text is an empty one; base spans of one kind do not
overlap, those of several may; added spans meet no base span and no other; of
equal scores the kind listed first is taken; repeated rows have each their own
result, and count once as evidence, as does an identifier repeated in one
context; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import stored

KINDS = ("email", "ip", "card", "phone")

#: The expressions of the contract. Runs begin where they can and give nothing back, so that a text is read in one pass.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
WORD = r"(?<!\S)(?:[+(]?[0-9][0-9().\-]*+(?:\x20[(]?[0-9][0-9().\-]*+)*+(?=[\s,;:!?]|$)|[^\s0-9@]*+[0-9@]\S*+)"
NEEDED = ("@", ".", None, "+", None)

#: Code points next to a match that its context is taken from, and lengths of identifier-like words.
NEXT, LEAST, MOST = 64, 5, 64
#: Thousandths.
CERTAIN = 1000


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    from_right = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(from_right, F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """The check that belongs to a match of a base expression."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part_fits = F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (
        F.when(kind == 0, F.lit(True)).when(kind == 1, part_fits)
        .when(kind == 2, F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == 3, F.length(digits).between(8, 15)).otherwise(False)
    )


def fits(value: Column) -> list[Column]:
    """Whether an identifier that no expression knew has the looks of each kind."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return [
        value.contains("@") & value.rlike("[A-Za-z]"),
        value.rlike(r"^[0-9A-Fa-f:./]+$") & value.rlike("[0-9]") & (F.length(F.regexp_replace(value, "[^.:]", "")) >= 2),
        value.rlike("^[0-9 -]+$") & (digits >= 12),
        value.rlike(r"^[0-9 ().+-]+$") & digits.between(7, 15),
    ]


def cue_words(text: Column) -> Column:
    """The words of a piece of text, identifiers masked, in lower case."""
    masked = F.regexp_replace(F.lower(text), r"\S*[0-9@]\S*", "#")
    return F.filter(F.split(F.regexp_replace(masked, r"#(?:\s+#)+", "#"), r"\s+"), lambda w: w != "")


SPOT = "array<struct<kind:int,nth:int,gap:bigint,value:string,before:string,after:string>>"


def split_by(text: Column, kind: int) -> list[Column]:
    """The gaps between an expression's matches, and the matches."""
    pattern, needed = F.lit((*BASE, WORD)[kind]), NEEDED[kind]
    read = F.when(F.contains(text, F.lit(needed)), text).otherwise(F.lit("")) if needed else text
    return [F.split(read, pattern, -1).alias(f"gaps{kind}"), F.regexp_extract_all(read, pattern, F.lit(0)).alias(f"found{kind}")]


def spots_of(kind: int) -> Column:
    """Of every match: kind, nth, the length of the gap before it, the match, and the ends of the gaps at its sides."""
    gaps, found = F.col(f"gaps{kind}"), F.col(f"found{kind}")
    n = F.size(found)
    sides = F.arrays_zip(F.slice(gaps, F.lit(1), n), found, F.slice(gaps, F.lit(2), n), F.sequence(F.lit(0), n - 1))

    def spot(z):
        before, value, after, nth = (z[c] for c in ("0", f"found{kind}", "2", "3"))
        # a neighbour within reach is an identifier as well
        ahead = F.concat(F.when((nth > 0) & (F.length(before) < NEXT), F.lit("# ")).otherwise(F.lit("")), F.right(before, F.lit(NEXT)))
        behind = F.concat(F.left(after, F.lit(NEXT)), F.when((nth < n - 1) & (F.length(after) < NEXT), F.lit(" #")).otherwise(F.lit("")))
        return F.struct(F.lit(kind).alias("kind"), nth.alias("nth"), F.length(before).cast("long").alias("gap"), value.alias("value"), ahead.alias("before"), behind.alias("after"))

    return F.coalesce(F.when(n > 0, F.transform(sides, spot)), F.array().cast(SPOT))


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, spots: all matches of a text, by one reading of it; written, so that rows keep their numbers."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    every = range(len(BASE) + 1)
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[c for k in every for c in split_by(text, k)])
    return stored(held.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*[spots_of(k) for k in every]).alias("spots")))


def placed(found: DataFrame) -> DataFrame:
    """row, kind, start, end, value, before, after of every match; places in code points."""
    spots = found.select("row", F.explode("spots").alias("s")).select("row", "s.*")
    along = W.partitionBy("row", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(along)
    return spots.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def trimmed(words: DataFrame) -> DataFrame:
    """Identifier-like words without the punctuation round them."""
    lead = F.length(F.regexp_extract("value", r"^[\p{P}\p{S}&&[^+(@]]*+", 0))
    tail = F.length(F.regexp_extract(F.reverse("value"), r"^[\p{P}\p{S}&&[^)@]]*+", 0))
    words = words.withColumn("lead", lead).withColumn("size", F.length("value") - F.col("lead") - tail)
    cut = words.filter(F.col("size").between(LEAST, MOST)).withColumn("value", F.substring(F.col("value"), F.col("lead") + 1, F.col("size"))).withColumn("start", F.col("start") + F.col("lead"))
    return cut.withColumn("end", F.col("start") + F.col("size")).drop("lead", "size")


def apart(words: DataFrame, base: DataFrame) -> DataFrame:
    """Words that meet no base span of their row, by running ends instead of pairs."""
    both = words.withColumn("known", F.lit(False)).unionByName(base.withColumn("known", F.lit(True)))
    before = W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    # backwards, for Spark computes a frame that only shrinks anew for each row
    after = W.partitionBy("row").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_ends", F.max(F.when(F.col("known"), F.col("end"))).over(before)).withColumn("_starts", F.min(F.when(F.col("known"), F.col("start"))).over(after))
    clear = (F.coalesce("_ends", F.lit(0)) <= F.col("start")) & (F.col("_starts").isNull() | (F.col("_starts") >= F.col("end")))
    return both.filter(~F.col("known") & clear).drop("known", "_ends", "_starts")


def contexts(spots: DataFrame) -> DataFrame:
    """pattern, value, kind (null where no expression knew it), each once."""
    before = F.regexp_replace("before", "[\"'(<\\[{]+$", "")
    after = F.regexp_replace("after", "^[\"')>\\]},.;!?]+", "")
    cued = spots.select(F.lower("value").alias("value"), "kind", cue_words(before).alias("l"), cue_words(after).alias("r"))
    one, two, right = F.try_element_at("l", F.lit(-1)), F.try_element_at("l", F.lit(-2)), F.try_element_at("r", F.lit(1))
    patterns = F.array(
        F.concat(F.lit("2 "), two, F.lit(" "), one),
        F.concat(F.lit("1 "), one, F.lit(" _ "), right),
        F.when(one.rlike("[:=#]$") & (one != "#"), F.concat(F.lit("0 "), one)),
    )
    cued = cued.select("value", "kind", F.explode(F.array_compact(patterns)).alias("pattern"))
    return cued.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")).drop("n")


def evidence(confidence: Column) -> Column:
    """-log2(1 - c) in thousandths, so that noisy-or is a sum of whole numbers."""
    return F.floor(-1000 * F.log2(1 - confidence / F.lit(1000.0))).cast("long")


def bootstrapped(edges: DataFrame, rounds: int, support: int, confidence: int) -> DataFrame | None:
    """value, kind: identifiers that the seeds' patterns discover."""
    kinds = range(len(KINDS))
    # a pattern of fewer identifiers can never be induced
    busy = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("pattern")
    edges = stored(edges.join(busy, "pattern"))
    unseen = edges.filter("kind is null")
    if unseen.isEmpty():
        return None
    seeded = [F.max(F.when(F.col("kind") == k, CERTAIN).otherwise(0)).alias(f"s{k}") for k in kinds]
    nodes = edges.groupBy("value").agg(*seeded)
    known = F.greatest(*[f"s{k}" for k in kinds]) == CERTAIN
    looks = fits(F.col("value"))
    nodes = stored(nodes.select("value", *[f"s{k}" for k in kinds], *[(~known & looks[k]).alias(f"f{k}") for k in kinds]))
    edges = edges.select("pattern", "value").distinct()
    for _ in range(rounds):
        sums = [F.sum(f"s{k}").alias(f"t{k}") for k in kinds] + [F.count_if(F.col(f"s{k}") >= confidence).alias(f"u{k}") for k in kinds]
        met = edges.join(nodes, "value").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums)
        share = [F.floor(F.col(f"t{k}") / (F.col("n") + 1)).cast("long") for k in kinds]
        trusted = [F.when((F.col(f"u{k}") >= support) & (share[k] >= confidence), evidence(share[k])).alias(f"w{k}") for k in kinds]
        trusted = met.select("pattern", *trusted).filter(F.coalesce(*[f"w{k}" for k in kinds]).isNotNull())
        held = edges.join(trusted, "pattern").groupBy("value").agg(*[F.coalesce(F.sum(f"w{k}"), F.lit(0)).alias(f"w{k}") for k in kinds])
        scored = [F.when(F.col(f"f{k}"), F.floor(CERTAIN * (1 - F.pow(F.lit(2.0), -F.coalesce(F.col(f"w{k}"), F.lit(0)) / 1000)))).otherwise(F.col(f"s{k}")).cast("int") for k in kinds]
        changed = F.coalesce(*[F.when(scored[k] != F.col(f"s{k}"), True) for k in kinds], F.lit(False))
        after = stored(nodes.join(held, "value", "left").select("value", *[scored[k].alias(f"s{k}") for k in kinds], *[f"f{k}" for k in kinds], changed.alias("changed")))
        nodes = after.drop("changed")
        if after.filter("changed").isEmpty():
            break
    best = F.greatest(*[F.when(F.col(f"f{k}"), F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("back"))) for k in kinds])
    return nodes.withColumn("best", best).filter(F.col("best.score") >= confidence).select("value", (-F.col("best.back")).alias("kind"))


def private_spans(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: int = 750, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row, doc_id of every document, and row, kind, start, end, value, base of its spans.

    ``support``: known identifiers that a pattern needs at least; ``confidence``:
    thousandths that patterns and identifiers need.
    """
    found = found_in(docs, id_col, text_col)
    spots = placed(found)
    base = stored(spots.filter((F.col("kind") < len(KINDS)) & passes(F.col("kind"), F.col("value"))).drop("nth", "gap"))
    words = stored(apart(trimmed(spots.filter(F.col("kind") == len(KINDS)).drop("nth", "gap")), base).withColumn("kind", F.lit(None).cast("int")))
    spans = base.select("row", "kind", "start", "end", "value", F.lit(True).alias("base"))
    new = bootstrapped(contexts(base.unionByName(words)), rounds, support, confidence)
    if new is not None:
        added = words.drop("kind").withColumn("key", F.lower("value")).join(new.withColumnRenamed("value", "key"), "key")
        spans = spans.unionByName(added.select("row", "kind", "start", "end", "value", F.lit(False).alias("base")))
    return found.select("row", "doc_id"), spans


def private_data(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: int = 750, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, numbers of base spans by kind, base_sha256, spans and n_added."""
    rows, spans = private_spans(docs, rounds, support, confidence, id_col, text_col)
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("all"))
    name = F.array(*[F.lit(k) for k in KINDS])
    said = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    full = rows.join(by_row, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>"))).withColumn("known", F.filter("all", lambda s: s["base"]))
    of_kind = lambda k: F.size(F.filter("known", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]
    return full.select("doc_id", *counts, F.sha2(said(F.col("known")), 256).alias("base_sha256"), said(F.col("all")).alias("spans"), (F.size("all") - F.size("known")).cast("long").alias("n_added"))
