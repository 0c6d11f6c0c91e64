"""N-gram Jaccard self-join by parity sketches.

A document is the set of its 5-word shingles, as 64-bit hashes. Its parity
sketch toggles one bit for every shingle; two sketches differ in no more bits
than the sets in shingles, so their Hamming distance bounds the symmetric
difference from below. Sets of sizes a and b reach the threshold only if that
difference is at most d = (a + b) * (1 - t) / (1 + t).

Sizes fall into bands such that linked sets are in one band or in neighbours;
each pair of neighbouring bands has one d and a sketch of d + c blocks. By the
pigeonhole principle linked sets agree in at least c blocks, each of which is
kept folded to 64 bits (the XOR of one code per toggled bit). A document with
fewer than c blocks that occur elsewhere has no partner and stands aside. Blocks
are ordered by how often they occur in the corpus; each document keeps its d + 1
rarest, and two documents that agree in c blocks still share one of these.
Common blocks (empty ones, passages everyone has) are what falls away.

Candidates are then settled in steps, none of which writes all pairs of a
group. In each of a few rounds every block that holds documents of different
components has a centre, each document is compared with the centre that shares
most of its blocks, and components are formed anew. Then, for blocks whose
documents are still in different components, sets are compared across
components. Blocks with one centre are put together, as they hold much the same
documents; groups of up to ``SMALL`` are compared by the Hamming distance of
their dense parity sketches, and the pairs that these let through exactly.
Larger groups are compared in tiles of bounded size, where documents outside the
largest component meet all others. What is not compared is already connected.

Defined cases: a null or blank text has no shingle and is linked with nothing;
fewer words than five give one shingle; documents with equal sets are one
class; rows of one doc_id are one node of the graph, with the links of each of
its texts; a null doc_id takes part in nothing and has no component; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, fresh, stored, text_rows
from .components import components
from .exchange import ANSWER, Group, bucket_key, found_keys, lookup, pack, plan_groups, repeated, together, trimmed
from .vectext import Texts, chained, lowered, mix, owner, window_starts, word_hashes, words

SHINGLE = 5
#: Threshold as a fraction: three quarters.
NUMERATOR, DENOMINATOR = 3, 4
SLICE = (1 << 20) - 64
#: Documents of a group that are held in one row; larger groups are tiled.
SMALL = 128
TILE = 2048
#: Shingles that one side of a tile holds, some 8 MB, besides what one set has; and bits that its sketches take while they are made.
TILE_SHINGLES = 1 << 20
SKETCH_BITS = 1 << 26
#: Rounds of stars, each with other centres, before components are compared in full.
TURNS = 2

SIZES = "g int, doc_id long, n_shingles long, k1 long, k2 long"
OFFERS = "doc_id long, n_shingles long, key long, hashes binary, sketch binary"


def shingle_sets(texts: Texts, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text end to end, sorted within it, and where each text's begin (one entry more)."""
    low = lowered(texts)
    found = words(low)
    hashes = word_hashes(low, found)
    counts = found.counts()
    full = chained(hashes, width)
    start = np.flatnonzero(window_starts(found.first, width, len(found)))
    doc = owner(found.first, start)
    few = np.flatnonzero((counts > 0) & (counts < width))
    short = np.array([_short(hashes[found.first[i] : found.first[i + 1]], width) for i in few], np.uint64)
    values, docs = full[start], doc
    if len(few):
        values, docs = np.concatenate([values, short]), np.concatenate([docs, few])
        order = np.argsort(docs, kind="stable")
        values, docs = values[order], docs[order]
    edges = np.searchsorted(docs, np.arange(len(texts) + 1)).tolist()
    for a, z in zip(edges, edges[1:], strict=False):
        values[a:z].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    return values[keep], np.searchsorted(docs[keep], np.arange(len(texts) + 1))


def _short(hashes: np.ndarray, width: int) -> np.uint64:
    """A sequence of fewer words than a shingle, told apart by its length."""
    padded = np.append(hashes, np.full(width - len(hashes), len(hashes), np.uint64))
    return mix(chained(padded, width))[0]


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    def sums(x):
        upto = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=upto[1:])
        return upto[bounds[1:]] - upto[bounds[:-1]]

    return sums(mix(values + np.uint64(0x9E3779B97F4A7C15))).view(np.int64), sums(mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F))).view(np.int64)


@lru_cache(maxsize=4)
def bands(top: int = 1 << 40) -> tuple[int, ...]:
    """Least size of each band: a set linked with one of band j lies in band j - 1, j or j + 1."""
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * DENOMINATOR // NUMERATOR + 1))
    return tuple(edges)


@lru_cache(maxsize=4)
def slots() -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of neighbouring bands: the greatest symmetric difference d of linked sets, and the sketch's blocks (0 where d is 0)."""
    edges = bands()
    d, k = [], []
    for j in range(len(edges) - 1):
        a = edges[j + 1] - 1
        b = a * DENOMINATOR // NUMERATOR
        most = (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        d.append(most)
        k.append(most + spare(most) if most else 0)
    return np.array(d, np.int64), np.array(k, np.int64)


def spare(d):
    """Blocks beyond d, in which linked documents agree at least; all but one may be dropped for being common."""
    return 2 + d // 3


def block_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded sketch blocks of every set, for its own slot and the one below: key, set, and twice the slot's d (plus one for the slot below)."""
    d, k = slots()
    sizes = np.diff(bounds)
    band = np.searchsorted(np.array(bands()), sizes, side="right") - 1
    keys, sets, most = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for below in (0, 1):
        slot = band - below
        some = np.flatnonzero((sizes > 0) & (slot >= 0))
        some = some[k[slot[some]] > 0]
        if not len(some):
            continue
        n = k[slot[some]]
        begin = np.cumsum(n) - n
        take = np.arange(int(sizes[some].sum())) + np.repeat(bounds[:-1][some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some])
        token = values[take]
        of = np.repeat(np.arange(len(some)), sizes[some])
        block = (mix(token ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(11)).astype(np.int64) % n[of]
        folded = np.zeros(int(n.sum()), np.uint64)
        np.bitwise_xor.at(folded, begin[of] + block, mix(token + np.uint64(0xE7037ED1A0B428DB)))
        nth = np.arange(len(folded)) - np.repeat(begin, n)
        name = (np.repeat(slot[some], n).astype(np.uint64) << np.uint64(44)) + nth.astype(np.uint64)
        keys.append(mix(folded ^ mix(name + np.uint64(0x8EBC6AF09C88C6E3))))
        sets.append(np.repeat(some, n))
        most.append(np.repeat(d[slot[some]], n) * 2 + below)
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(most)


def sizes_of(group_table: pa.Table) -> pa.Table:
    group, g = Group(group_table), group_table["g"][0].as_py()
    n, k1, k2 = [], [], []
    for _, part in group.texts.slices(SLICE):
        values, bounds = shingle_sets(part)
        a, b = set_keys(values, bounds)
        n.append(np.diff(bounds))
        k1.append(a)
        k2.append(b)
    cat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
    return pa.Table.from_arrays([pa.array([g] * len(group.ids), pa.int32()), group.id_column(), cat(n), cat(k1), cat(k2)], ["g", "doc_id", "n_shingles", "k1", "k2"])


def chosen_sets(group: Group, chosen: set[int]):
    """Per slice: doc_id, hashes and bounds of the documents that stand for their class, each once."""
    done: set[tuple[int, int]] = set()
    for at, part in group.texts.slices(SLICE):
        values, bounds = shingle_sets(part)
        k1, _ = set_keys(values, bounds)
        own = []
        for i in range(len(part)):
            doc, mark = int(group.ids[at + i]), int(k1[i])
            if doc in chosen and (doc, mark) not in done and bounds[i + 1] > bounds[i]:
                done.add((doc, mark))
                own.append(i)
        own = np.array(own, np.int64)
        sizes = np.diff(bounds)[own]
        take = np.arange(int(sizes.sum())) + np.repeat(bounds[:-1][own] - (np.cumsum(sizes) - sizes), sizes)
        yield group.ids[at + own], values[take], np.append(0, np.cumsum(sizes))


def signals_of(group: Group, chosen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for ids, values, bounds in chosen_sets(group, chosen):
        key, of, _ = block_keys(values, bounds)
        keys.append(key)
        owners.append(ids[of])
    return np.concatenate(keys), np.concatenate(owners)


def offers_of(group: Group, chosen: set[int], answers: pa.Table, n_buckets: int) -> pa.Table:
    """The d + 1 rarest of the repeated blocks of each document and slot (a row each), and the sets of documents that have one.

    Linked documents agree in ``spare`` blocks at least, all of them repeated: slots with fewer offer nothing.
    """
    known, times = found_keys(answers)
    doc, key_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with_set: list[list] = [[], [], [], []]
    for ids, values, bounds in chosen_sets(group, chosen):
        key, of, slot = block_keys(values, bounds)
        place = lookup(known, bucket_key(key, n_buckets))
        count = np.where(place >= 0, times[np.maximum(place, 0)] if len(times) else 1, 1).astype(np.int64)
        part = of * 2 + (slot & 1)
        some = np.flatnonzero(np.bincount(part[count > 1], minlength=2 * len(ids))[part] >= spare(slot >> 1))
        key, of, slot, count, part = key[some], of[some], slot[some], count[some], part[some]
        order = np.lexsort((key, count, part))
        key, of, slot, count, part = key[order], of[order], slot[order], count[order], part[order]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(key) else np.zeros(0, np.int64)
        nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        kept = (count > 1) & (nth <= slot >> 1)
        doc.append(ids[of[kept]])
        key_of.append(key[kept].view(np.int64))
        for i in np.unique(of[kept]).tolist():
            own = values[bounds[i] : bounds[i + 1]]
            with_set[0].append(int(ids[i]))
            with_set[1].append(len(own))
            with_set[2].append(own.astype("<u8").tobytes())
            with_set[3].append(dense_sketch(own).tobytes())
    n, m = sum(map(len, doc)), len(with_set[0])
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate([*doc, np.array(with_set[0], np.int64)])),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(with_set[1], pa.int64())]),
            pa.concat_arrays([pa.array(np.concatenate(key_of)), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(with_set[2], pa.binary())]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(with_set[3], pa.binary())]),
        ],
        ["doc_id", "n_shingles", "key", "hashes", "sketch"],
    )


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def dense_sketch(values: np.ndarray) -> np.ndarray:
    """Parity sketch of a set, of the least power of two that is four times its size in bits (64 at least), as 64-bit words."""
    bits = 1 << max(6, int(4 * len(values) - 1).bit_length())
    toggled = np.bincount((mix(values) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(toggled.astype(np.uint8), bitorder="little").view("<u8")


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two dense sketches, the longer folded onto the shorter (which toggles bits alike)."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def parity_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Dense parity sketches of ``bits`` (a multiple of 64), a row a set."""
    out = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def links_across(labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Enough links between sets of different labels to connect all that are linked.

    Every pair across labels that is not yet connected is held against the
    Hamming bound, and against the exact sets where that lets it through.
    """
    component = np.unique(labels, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    # shorter sketches let more through to the exact sets, and lose nothing
    bits = 64 * int(np.clip(4 * size.max(initial=1) // 64 + 1, 1, max(1, min(1024, SKETCH_BITS // 64 // max(1, len(sets))))))
    sketch = parity_sketches(sets, bits)
    ends = np.searchsorted(size[order], size[order] * DENOMINATOR // NUMERATOR, side="right")
    found = []
    for nth, i in enumerate(order.tolist()):
        # partners at least as large, at most 4 / 3 as large
        rest = order[nth + 1 : ends[nth]]
        rest = rest[component[rest] != component[i]]
        if not len(rest):
            continue
        apart = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1)
        for j in rest[within_bound(apart, size[i] + size[rest])].tolist():
            if component[i] != component[j] and linked(sets[i], sets[j]):
                component[component == component[j]] = component[i]
                found.append((i, j))
    return found


def within_bound(distance, sizes):
    """Whether a Hamming distance lets sets of a total size be linked."""
    return (DENOMINATOR + NUMERATOR) * distance <= (DENOMINATOR - NUMERATOR) * sizes


def near_across(ids: list[int], labels: list[int], sizes: list[int], sketches: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of different labels whose sketches lie within the bound."""
    words = [np.frombuffer(s, "<u8") for s in sketches]
    short = min(map(len, words))
    folded = np.stack([np.bitwise_xor.reduce(w.reshape(-1, short), axis=0) for w in words])
    label, size = np.array(labels), np.array(sizes)
    out = []
    for i in range(len(ids) - 1):
        apart = np.bitwise_count(folded[i + 1 :] ^ folded[i]).sum(axis=1)
        hit = (label[i + 1 :] != label[i]) & within_bound(apart, size[i] + size[i + 1 :])
        out += [(ids[i], ids[i + 1 + j]) for j in np.flatnonzero(hit).tolist()]
    return out


def verified(pairs: DataFrame, sets: DataFrame, sketched: bool = False) -> DataFrame:
    """Pairs (a, b) that reach the threshold: by the Hamming bound (unless done), then by their exact sets."""

    def side(key: str, value: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(key), F.col("n_shingles").alias(f"n_{key}"), F.col(value).alias(f"{value}_{key}"))

    def kept(batch, keep):
        return pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    def near(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            yield kept(batch, [within_bound(sketch_distance(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), m + n) for x, y, m, n in rows])

    def exact(batches):
        for batch in batches:
            yield kept(batch, [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])

    close = pairs
    if not sketched:
        close = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(near, "a long, b long")
    return close.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, "a long, b long")


def opened(offers: DataFrame, roots: DataFrame | None, turn: int = 0) -> DataFrame:
    """Blocks' documents with the component each is in so far, of blocks that hold more than one.

    The centre of a block is of its least label, which is the largest family's as
    a rule, so that only the others ask: the least doc_id, in later turns the least hash.
    """
    if roots is None:
        opens = offers.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("_high")).filter("centre < _high")
        return offers.withColumn("label", F.col("doc_id")).join(opens.select("key", "centre", F.col("centre").alias("centre_label")), "key")
    named = offers.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root")
    first = F.min(F.struct("label", F.xxhash64("doc_id", F.lit(turn)).alias("order"), "doc_id")).alias("_first")
    opens = named.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), first).filter("_low < _high")
    return named.join(opens.select("key", F.col("_first.doc_id").alias("centre"), F.col("_first.label").alias("centre_label")), "key")


def star_links(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of each document with the centre of another component that shares most blocks with it."""
    asked = left.filter("label <> centre_label").groupBy("doc_id", "centre").agg(F.count(F.lit(1)).alias("shared"))
    best = asked.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("centre")).alias("centre"))).alias("best"))
    return verified(best.select(F.col("doc_id").alias("a"), (-F.col("best.centre")).alias("b")), sets)


def by_centre(left: DataFrame) -> DataFrame:
    """Documents put together by their blocks' centre: key, doc_id, label, members."""
    rows = left.select(F.col("centre").alias("key"), "doc_id", "label").distinct()
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    return rows.join(size, "key")


def small_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in groups of at most ``SMALL`` documents: by their sketches, then exactly."""
    met = groups.select(F.col("key").alias("block"), "doc_id", "label").join(sets.select("doc_id", "n_shingles", "sketch"), "doc_id")
    held = met.groupBy("block").agg(*[F.collect_list(F.col(c)).alias(c) for c in ("doc_id", "label", "n_shingles", "sketch")])

    def near(batches):
        for batch in batches:
            pairs = [p for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True) for p in near_across(*row)]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    pairs = held.mapInArrow(near, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return verified(pairs, sets, sketched=True)


def tile_links(large: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """Links across components in large groups, in tiles of about ``tile`` documents, or ``TILE_SHINGLES`` shingles, squared.

    Documents of a group's largest component lie in one row of tiles each;
    those outside it meet every such tile, and each other in tiles of theirs.
    """
    sized = large.join(sets.select("doc_id", F.col("n_shingles").cast("long").alias("weight")), "doc_id")
    most = sized.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).groupBy("key").agg(F.max(F.struct("n", "weight", "label")).alias("most"), F.sum("weight").alias("whole"))
    # documents and shingles are bounded, whichever asks for more parts
    over = lambda n, weight: F.greatest(F.ceil(n / tile), F.ceil(weight / TILE_SHINGLES)).cast("int")
    named = large.join(most, "key").withColumns({"inside": F.col("label") == F.col("most.label"), "rows": over(F.col("most.n"), F.col("most.weight")), "cuts": over(F.col("members") - F.col("most.n"), F.col("whole") - F.col("most.weight"))})
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = named.filter("not inside").withColumn("part", own("cuts"))
    # tiles of both kinds (row, part), and tiles of two parts
    inner = named.filter("inside").select("key", F.lit(True).alias("mixed"), own("rows").alias("t1"), each("cuts").alias("t2"), "doc_id", "label")
    against = outer.select("key", F.lit(True).alias("mixed"), each("rows").alias("t1"), F.col("part").alias("t2"), "doc_id", "label")
    among = outer.select("key", "part", each("cuts").alias("other"), "doc_id", "label")
    among = among.select("key", F.lit(False).alias("mixed"), F.least("part", "other").alias("t1"), F.greatest("part", "other").alias("t2"), "doc_id", "label")

    def cross(group: pa.Table) -> pa.Table:
        ids, labels = group["doc_id"].to_numpy(), group["label"].to_numpy()
        links = links_across(labels, [np.frombuffer(h, "<u8") for h in group["hashes"].to_pylist()])
        return pa.Table.from_arrays([pa.array([int(ids[i]) for i, _ in links], pa.int64()), pa.array([int(ids[j]) for _, j in links], pa.int64())], ["a", "b"])

    tiled = inner.unionByName(against).unionByName(among)
    return tiled.join(sets.select("doc_id", "hashes"), "doc_id").groupBy("key", "mixed", "t1", "t2").applyInArrow(trimmed(cross), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows = text_rows(docs, id_col, text_col)
    n = plan_groups(rows)
    packed = pack(rows, n)
    sizes = stored(packed.groupBy("g").applyInArrow(trimmed(sizes_of), SIZES))
    # one document stands for all with its set: the least, found by partial aggregation
    classes = sizes.filter("doc_id is not null and n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "g")).alias("first"))
    classes = stored(classes.select("k1", "k2", "n_shingles", F.col("first.doc_id").alias("rep"), F.col("first.g").alias("g")))
    # sets of one or two have no other set within the threshold; one of three has those of four that hold it
    chosen = classes.filter("n_shingles >= 3").groupBy("g").agg(F.collect_list("rep").alias("reps")).mapInArrow(chosen_rows, ANSWER)
    hits = repeated(packed, lambda group, side: signals_of(group, chosen_ids(side)), n, chosen)
    both = hits.unionByName(chosen)

    def offer(group: Group, answers: pa.Table, g: int) -> pa.Table:
        own = pa.array(answers["b"].to_numpy() >= 0)
        return offers_of(group, chosen_ids(answers.filter(pc.invert(own))), answers.filter(own), n)

    table = stored(together(packed, both, offer, OFFERS))
    offers = table.filter("key is not null").select("doc_id", "key")
    sets = table.filter("key is null").select("doc_id", "n_shingles", "hashes", "sketch")
    filled = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    links, roots = checkpointed(one_node(sizes.filter(filled), classes)), None
    left = opened(offers, None, 0)
    for turn in range(1, TURNS + 1):
        links = checkpointed(links.unionByName(star_links(left, sets)))
        roots = components(links)
        # a block that holds one component stays closed
        left = checkpointed(opened(offers if turn == 1 else left.select("doc_id", "key"), roots, turn))
    groups, fits = checkpointed(by_centre(left)), F.col("members") <= SMALL
    roots = components(links.unionByName(tile_links(groups.filter(~fits), sets, TILE)).unionByName(small_links(groups.filter(fits), sets)))
    # classes with their component, and every document with its class
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("k1", "k2", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    members = sizes.filter(filled).join(named, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = sizes.filter(~filled).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.unionByName(alone)


def one_node(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of doc_ids that have several texts with the documents that stand for these."""
    mark = F.struct("k1", "k2", "n_shingles")
    several = sizes.groupBy("doc_id").agg(F.min(mark).alias("_a"), F.max(mark).alias("_b")).filter("_a <> _b").select("doc_id")
    texts = sizes.select("doc_id", "k1", "k2", "n_shingles").join(several, "doc_id", "left_semi").distinct()
    return texts.join(classes, ["k1", "k2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def chosen_rows(batches):
    """Identifiers of a group's chosen documents as one row of side information (bucket -1)."""
    for batch in batches:
        data = [np.array(reps, "<i8").tobytes() for reps in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1] * len(data), pa.int32()), pa.array(data, pa.binary())], ["g", "b", "data"])


def chosen_ids(side: pa.Table) -> set[int]:
    return {i for data in side["data"].to_pylist() for i in np.frombuffer(data, "<i8").tolist()}


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stand for their component: the least doc_id.

    Of rows equal in doc_id and text one stays; documents without an identifier all stay.
    """
    groups = checkpointed(near_duplicates(docs))
    own, doc_id = fresh(docs, "_kept"), F.col("doc_id").cast("long")
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    left = docs.join(kept, doc_id == F.col(own), "left_semi")
    repeats = checkpointed(groups.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select(F.col("doc_id").alias(own)))
    if not repeats.isEmpty():
        # only rows whose doc_id comes again are compared, by their texts' length and two hashes; columns may be of any kind
        text = F.col("text").cast("string")
        marks = {fresh(docs, f"_mark{i}"): c for i, c in enumerate((doc_id, F.octet_length(text), F.xxhash64(text), F.sha2(text, 256)))}
        again = left.join(repeats, doc_id == F.col(own), "left_semi").withColumns(marks).dropDuplicates(list(marks)).drop(*marks)
        left = left.join(repeats, doc_id == F.col(own), "left_anti").unionByName(again)
    return left.unionByName(docs.filter(doc_id.isNull()))
