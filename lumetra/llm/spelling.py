"""Spelling variants by a dictionary of trie-node pairs.

All words lie in two tries: one of the words and one of the words reversed. The
nodes of a trie are numbered as the sorted words first meet them, so a word is a
path of node numbers, and cutting a word before place i leaves a pair of whole
numbers: the node of its first i letters, and the reversed trie's node of the
rest. Two pairs say all that one edit can do:

* *cut*: (node of the first i letters, node of the letters from i on);
* *skip*: (node of the first i letters, node of the letters after i).

Words that share a skip differ by the letter skipped; a word whose skip is
another's cut has one letter more. No string is compared, and a pair has at most
one word for each letter of the alphabet as a skip, and one as a cut. Where
equal letters stand side by side, skipping any gives one word, and only the
first of them meets cuts.

Sorted words are numbered by range partitions; what a partition's first word
shares with the word before it goes on from that word's nodes, one small row a
partition on the driver.

Defined cases: null texts have no words; a null doc_id reads as an empty string
in the noise rule's key; words are told apart by code points; letters at which a
code point was deleted are counted as what is left; of near words equal in
number the smaller in code-point order is the form; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, column, release, stored

#: Runs of letters, and the letters that are lower-cased (fixed values).
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits for the number of a node inside its partition.
NODE_BITS = 40

PATHS = "id long, nodes array<long>, part int, first string, last string"


def lowered(run: Column) -> Column:
    """A-Z alone in lower case; plain ASCII takes the quicker way."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def counted(docs: DataFrame, noise: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of all texts, each without one letter where ``noise`` divides the CRC-32 of its document and run."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc", lowered(F.col("run")).alias("run"))
    if noise:
        runs = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % noise == 0, without).otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def shared(a: str, b: str) -> int:
    """Letters that two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # a[:low] is shared, a[: high + 1] is not
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def trie_paths(words: DataFrame, word: str) -> DataFrame:
    """id, nodes: the node numbers of a word's first 1, 2, ... letters in the trie of all words of column ``word``."""
    dealt = words.select("id", F.col(word).alias("word")).repartitionByRange("word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id())

    def walk(batches):
        ids, paths, held, part, n = [], [], 0, None, 0
        first = last = ""
        path: list[int] = []

        def out(mark: bool) -> pa.RecordBatch:
            # the last row tells what the next partition goes on from
            marks = [pa.array([None] * len(ids) + [x] * mark, k) for x, k in ((part, pa.int32()), (first, pa.string()), (last, pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([*ids, *[None] * mark], pa.int64()), pa.array([*paths, *[path] * mark], pa.list_(pa.int64())), *marks], [c.split()[0] for c in PATHS.split(", ")])

        for batch in batches:
            for p, i, w in zip(*(column(batch, c).to_pylist() for c in ("part", "id", "word")), strict=True):
                if part is None:
                    part, first, n = p, w, p << NODE_BITS
                keep = shared(w, last)
                path = [*path[:keep], *range(n + 1, n + 1 + len(w) - keep)]
                n, last, held = n + len(w) - keep, w, held + len(w)
                ids.append(i)
                paths.append(path)
                if held >= 1 << 18:
                    yield out(False)
                    ids, paths, held = [], [], 0
        if part is not None:
            yield out(True)
        release()

    walked = stored(dealt.mapInArrow(walk, PATHS))
    # one row a range partition
    carried, before, path = {}, "", []
    for row in sorted(walked.filter("part is not null").select("part", "first", "last", "nodes").collect(), key=lambda r: r["part"]):
        keep = shared(row["first"], before)
        carried[row["part"]] = path[:keep]
        through = shared(row["last"], row["first"])  # these nodes are still those of the partition's first word
        path = [*path[: min(keep, through)], *row["nodes"][min(keep, through) :]]
        before = row["last"]
    carried = {p: c for p, c in carried.items() if c}
    paths = walked.filter("id is not null").select("id", "nodes")
    if not carried:
        return paths
    table = words.sparkSession.createDataFrame(sorted(carried.items()), "part int, held array<long>")
    part = F.shiftright(F.element_at("nodes", 1), NODE_BITS).cast("int")
    # a node of the partition's first word has its depth for a number; such a node may have come before
    own = F.transform("nodes", lambda x, i: F.when((x - F.shiftleft(F.col("part").cast("long"), NODE_BITS) == i + 1) & (i < F.size("held")), F.get("held", i)).otherwise(x))
    return paths.withColumn("part", part).join(F.broadcast(table), "part", "left").select("id", F.when(F.col("held").isNull(), F.col("nodes")).otherwise(own).alias("nodes"))


def node_pairs(words: DataFrame) -> DataFrame:
    """prefix, suffix, cut, whole, n, id: every cut and skip of every word; ``whole``: this skip meets cuts."""
    ahead = trie_paths(words, "word").withColumnRenamed("nodes", "ahead")
    behind = trie_paths(words.withColumn("word", F.reverse("word")), "word").withColumnRenamed("nodes", "behind")
    # the letters, to tell the first of equal neighbours
    both = words.join(ahead, "id").join(behind, "id").withColumn("size", F.length("word"))
    node = lambda path, depth: F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.get(path, depth - 1))
    at = F.explode(F.sequence(F.lit(0), 2 * F.col("size")))
    spots = both.select("id", "n", "word", "size", "ahead", "behind", at.alias("spot")).withColumn("i", F.shiftright("spot", 1).cast("int"))
    cut = F.col("spot") % 2 == 0  # even: a cut before place i; odd: a skip of place i
    i, rest = F.col("i"), F.col("size") - F.col("i")
    letter = lambda k: F.substring(F.col("word"), k, F.lit(1))
    return spots.select(
        node("ahead", i).alias("prefix"), node("behind", F.when(cut, rest).otherwise(rest - 1)).alias("suffix"), cut.alias("cut"),
        (~cut & ((i == 0) | (letter(i + 1) != letter(i)))).alias("whole"), "n", "id",
    )


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best (n, -id): of each word that has near ones; ``id`` rises with the words' order."""
    members = F.collect_list(F.struct("n", (-F.col("id")).alias("back"), "cut", "whole"))
    # a pair holds at most a word for each letter, and one cut
    met = node_pairs(words).groupBy("prefix", "suffix").agg(members.alias("all")).filter(F.size("all") > 1)
    one = F.explode("all").alias("one")
    met = met.select("all", one)
    mine = F.col("one")

    def near(x):
        return (x["back"] != mine["back"]) & F.when(mine["cut"], x["whole"]).otherwise(F.when(x["cut"], mine["whole"]).otherwise(F.lit(True)))

    met = met.select((-mine["back"]).alias("id"), F.transform(F.filter("all", near), lambda x: F.struct(x["n"].alias("n"), x["back"].alias("back"))).alias("others")).filter(F.size("others") > 0)
    return met.select("id", F.size("others").cast("long").alias("k"), F.array_max("others").alias("top")).groupBy("id").agg(F.sum("k").alias("n_near"), F.max("top").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """id, root: the end of each chain of forms (id, form), by doubling; numbers rise along a chain, so it ends."""
    chains = checkpointed(links.select("id", F.col("form").alias("root")))
    while True:
        on = chains.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        longer = checkpointed(chains.join(on, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        chains = longer.drop("_moved")
        if longer.filter("_moved").isEmpty():
            return chains


def spelling_forms(docs: DataFrame, noise: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each word of the texts with its form and root: word, form, root, n, n_near, form_n."""
    words = counted(docs, noise, id_col, text_col).filter((F.length("word") >= max(1, least_length)) & (F.col("n") >= least_count))
    # numbers that rise with the words: a range partition's number and a row's place in it
    words = stored(words.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()))
    near = stored(near_words(words))
    own = words.join(near, "id", "left")
    is_form = F.col("best.n") >= ratio * F.col("n")
    own = own.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.back")).alias("form_id"), F.when(is_form, F.col("best.n")).alias("form_n"))
    ends = roots(own.filter("form_id is not null").select("id", F.col("form_id").alias("form"))).withColumnRenamed("root", "root_id")
    form_word = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root_word = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    found = own.join(ends, "id", "left").join(form_word, "form_id", "left").join(root_word, "root_id", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
