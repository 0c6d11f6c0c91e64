"""Removal of repeated byte strings by suffix sorting in hash buckets.

All 50-byte strings with the same least k-gram (by hash, leftmost on ties) go
to one bucket, as overlapping strings share most of theirs: a run of strings
with one such anchor travels as a single context. Pass 1 of ``exchange``
counts anchors, so only contexts whose anchor two documents have are sent. A
bucket lays its distinct contexts end to end and sorts the strings' suffixes
blockwise (``suffix_array``); strings equal over their width are neighbours,
which gives each its smallest doc_id. Hashes only bring equal contexts
together; they count as one when their bytes agree. Contexts of very frequent anchors are
cut into single strings and dealt by the string's own hash, so a passage that
everyone has spreads over all buckets, once a group.

Defined cases: a null text is empty; texts shorter than the width lose
nothing; rows of one doc_id never take from each other; a null doc_id takes
part in nothing and keeps its text; strings are judged on the input; an empty
table gives no rows. Memory follows a group, a bucket, or the longest text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, fresh, sha256_hex, text_rows
from .exchange import ANSWER, NO_ID, SENT, Group, answered, bucket_key, compressed, found_keys, lookup, pack, plan_groups, repeated, restored, row_key, sent, together, trimmed
from .suffix_array import window_classes
from .vectext import SEED, eights, merge_spans, mix, owner, same_spans, span_hashes

WIDTH = 50
GRAM = 24
SLICE = (1 << 20) - 64
#: Occurrences over the corpus from which an anchor's contexts are cut into single strings.
FREQUENT = 2000
#: Odd factors of the eight-byte parts of a gram.
GRAM_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` (8 at least) consecutive bytes; those that agree by chance only share a bucket."""
    n, at = len(data) - gram + 1, eights(data)
    state = np.zeros(n, np.uint64)
    for nth, off in enumerate([*range(0, gram - 8, 8), gram - 8]):
        state += at[off : off + n] * np.uint64(GRAM_FACTORS[nth % len(GRAM_FACTORS)] + 2 * (nth // len(GRAM_FACTORS)))
    return mix(state)


def anchored_runs(data: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive strings of one text with one anchor: first string, number of strings, anchor's hash, text."""
    none = np.zeros(0, np.int64)
    n = len(data) - width + 1
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none
    hashes = gram_hashes(data, gram)
    # the hash's high bits, then the position: the leftmost least gram
    bits = max(1, int(len(hashes)).bit_length())
    low = np.uint64((1 << bits) - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(ranked, width - gram + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[:n] == text[width - 1 :]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # a run ends before the next change, or where strings leave the text
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True))
    last = stops[np.searchsorted(stops, first)]
    return first, last - first + 1, hashes[anchor[first]], text[first]


def slices_with_runs(group: Group, width: int, gram: int):
    """(byte where it begins in the group, slice, runs in it, doc_id of each run), documents without identifier left out."""
    for at, part in group.texts.slices(SLICE):
        first, count, anchor, text = anchored_runs(part.data, part.bounds, width, gram)
        ids = group.ids[at + text]
        named = ids != NO_ID
        yield int(group.texts.bounds[at]), part, (first[named], count[named], anchor[named]), ids[named]


def anchors(group: Group, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(runs[2], ids) for _, _, runs, ids in slices_with_runs(group, width, gram)]
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(i for _, i in found)])


def contexts(group: Group, answers: pa.Table, width: int, gram: int, n_buckets: int, frequent: int):
    """Distinct contexts to send, in an order every pass finds again.

    Gives, over all occurrences: the place in the distinct list, the first byte
    in the group, the number of strings and the doc_id; and of the distinct
    contexts: bucket, number of strings, least doc_id, and an occurrence.
    """
    known, times = found_keys(answers)
    starts, counts, ids, keys, names = [], [], [], [], []
    for begin, part, (first, count, anchor), doc in slices_with_runs(group, width, gram):
        key = bucket_key(anchor, n_buckets)
        place = lookup(known, key)
        hit = np.flatnonzero(place >= 0)
        first, count, key, doc, often = first[hit], count[hit], key[hit], doc[hit], times[place[hit]] >= frequent
        if not len(first):
            continue
        # strings of frequent anchors stand alone, in a bucket of their own hash
        alone = np.flatnonzero(often)
        each = count[alone]
        nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        first = np.concatenate([first[~often], np.repeat(first[alone], each) + nth])
        doc = np.concatenate([doc[~often], np.repeat(doc[alone], each)])
        count = np.concatenate([count[~often], np.ones(len(nth), np.int64)])
        name = span_hashes(part.data, first, first + count + width - 1, SEED)
        key = np.concatenate([key[~often], bucket_key(name[len(name) - len(nth) :], n_buckets)]) >> np.uint64(32)
        starts.append(first + begin)
        counts.append(count)
        ids.append(doc)
        keys.append(key)
        names.append(name)
    cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    starts, counts, ids = cat(starts, np.int64), cat(counts, np.int64), cat(ids, np.int64)
    keys, names = cat(keys, np.uint64), cat(names, np.uint64)
    order = np.lexsort((starts, counts, names, keys))
    k = keys[order]
    new = ~equal_to_previous(group.texts.data, starts[order], counts[order] + width - 1, names[order])
    new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], at) if len(at) else np.zeros(0, np.int64)
    nth = np.cumsum(new) - 1
    return (nth, starts[order], counts[order], ids[order]), (k[at].astype(np.int64), counts[order][at], least, starts[order][at])


def equal_to_previous(data: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span before it, which is only looked at where the names agree."""
    same = np.zeros(len(start), bool)
    near = 1 + np.flatnonzero((name[1:] == name[:-1]) & (size[1:] == size[:-1]))
    at = eights(data, laid_out=False)
    same[near] = same_spans(at, start[near], at, start[near - 1], size[near])
    return same


def send_contexts(group: Group, answers: pa.Table, g: int, width: int, gram: int, n_buckets: int, frequent: int) -> pa.Table:
    """Contexts by bucket, and for the last pass the answers of the first (bucket -1 keeps them in the group)."""
    _, (bucket, count, least, start) = contexts(group, answers, width, gram, n_buckets, frequent)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    rows = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        if a < z:
            size = count[a:z] + width - 1
            at = np.arange(int(size.sum())) + np.repeat(start[a:z] - (np.cumsum(size) - size), size)
            rows.append((int(bucket[a]), g, compressed(count[a:z].astype("<u2"), least[a:z], group.texts.data[at])))
    return sent(rows)


def least_owner_of_strings(table: pa.Table, width: int) -> pa.Table:
    """A bucket: for each context of each group, the least doc_id of each of its strings, where it is below the group's own."""
    groups, bucket = table["g"].to_pylist(), table["b"][0].as_py()
    parts = [restored(d, "<u2", "<i8", "u1") for d in table["data"].to_pylist()]
    count = np.concatenate([p[0] for p in parts]).astype(np.int64)
    least = np.concatenate([p[1] for p in parts])
    data = np.concatenate([p[2] for p in parts])
    size = count + width - 1
    begin = np.cumsum(size) - size
    # equal contexts of several groups stand in the block once
    name = span_hashes(data, begin, begin + size, SEED, eights(data, laid_out=False))
    order = np.lexsort((size, name))
    new = ~equal_to_previous(data, begin[order], size[order], name[order])
    head = order[new]
    distinct = np.empty(len(order), np.int64)
    distinct[order] = np.cumsum(new) - 1
    owner_of = np.minimum.reduceat(least[order], np.flatnonzero(new))
    n = count[head]
    at = np.arange(int(size[head].sum())) + np.repeat(begin[head] - (np.cumsum(size[head]) - size[head]), size[head])
    block = data[at]
    place = np.cumsum(size[head]) - size[head]
    first = np.cumsum(n) - n
    strings = np.arange(int(n.sum())) + np.repeat(place - first, n)
    classes = window_classes(block, strings, width)
    smallest = np.full(int(classes.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, classes, np.repeat(owner_of, n))
    of_string = smallest[classes]
    rows, at = [], 0
    for g, part in zip(groups, parts, strict=True):
        own = distinct[at : at + len(part[0])]
        c = part[0].astype(np.int64)
        at += len(c)
        which = np.arange(int(c.sum())) + np.repeat(first[own] - (np.cumsum(c) - c), c)
        value = of_string[which]
        below = value < np.repeat(part[1], c)
        # only contexts with a string that someone before the group has
        changed = np.add.reduceat(below.astype(np.int64), np.cumsum(c) - c) > 0
        if changed.any():
            kept = np.repeat(changed, c)
            rows.append((g, bucket, compressed(np.flatnonzero(changed).astype("<u4"), value[kept])))
    return answered(rows)


def removed_strings(group: Group, hits: pa.Table, answers: pa.Table, width: int, gram: int, n_buckets: int, frequent: int) -> np.ndarray:
    """First bytes (in the group) of all strings that go, sorted."""
    (nth, start, count, ids), (bucket, n, least, _) = contexts(group, hits, width, gram, n_buckets, frequent)
    first = np.cumsum(n) - n
    value = np.repeat(least, n)
    begin_of = dict(zip(*(a.tolist() for a in np.unique(bucket, return_index=True)), strict=True))
    # strings of different contexts of this group may be equal, and the answers say so; without an
    # answer the least owner is the context's own, so contexts are compared across the bucket in any case
    for b, data in zip(answers["b"].to_pylist(), answers["data"].to_pylist(), strict=True):
        changed, least_of = restored(data, "<u4", "<i8")
        which = changed.astype(np.int64) + begin_of[b]
        c = n[which]
        at = np.arange(int(c.sum())) + np.repeat(first[which] - (np.cumsum(c) - c), c)
        value[at] = least_of
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    string = np.repeat(start, count) + at
    gone = value[np.repeat(first[nth], count) + at] < np.repeat(ids, count)
    return np.sort(string[gone])


def outcomes(group: Group, begin: np.ndarray, width: int, with_text: bool = False) -> pa.Table:
    """Digest of every document without the given strings."""
    doc = owner(group.texts.bounds, begin)
    # runs must not join two texts
    shifted = begin + doc * 1
    a, z = merge_spans(shifted, width)
    of = owner_of_shifted(a, group.texts.bounds)
    a, z = a - of, z - of
    sizes = group.texts.sizes()
    lost = np.bincount(of, z - a, len(sizes)).astype(np.int64) if len(a) else np.zeros(len(sizes), np.int64)
    spans = np.bincount(of, minlength=len(sizes)) if len(a) else np.zeros(len(sizes), np.int64)
    data, bounds = memoryview(np.ascontiguousarray(group.texts.data)), group.texts.bounds.tolist()
    cut = np.searchsorted(of, np.arange(len(sizes) + 1)).tolist()
    a, z = a.tolist(), z.tolist()
    digests, kept, checks = [], [], []
    for i in range(len(sizes)):
        parts, at = [], bounds[i]
        for j in range(cut[i], cut[i + 1]):
            parts.append(data[at : a[j]])
            at = z[j]
        parts.append(data[at : bounds[i + 1]])
        text = parts[0] if len(parts) == 1 else b"".join(parts)
        digests.append(sha256_hex(text))
        if with_text:
            kept.append(bytes(text))
            checks.append(zlib.crc32(data[bounds[i] : bounds[i + 1]]))
    arrays = [group.id_column(), pa.array(sizes), pa.array(lost), pa.array(spans.astype(np.int64)), pa.array(digests, pa.string())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        arrays += [pa.array(kept, pa.binary()), pa.array(group.keys), pa.array(checks, pa.int64())]
        names += ["kept", "row_key", "text_crc32"]
    return pa.Table.from_arrays(arrays, names)


def owner_of_shifted(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Text of positions to which the number of their text was added."""
    return np.searchsorted(bounds + np.arange(len(bounds)), at, side="right") - 1


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: its bytes, how many go in how many spans, and a digest (``with_text``: also the bytes) of what stays."""
    rows = text_rows(docs, id_col, text_col)
    n_groups = plan_groups(rows)
    n = 2 * n_groups  # buckets: what a group repeats may come to more bytes, in contexts, than the group has
    packed = pack(rows, n_groups)
    hits = repeated(packed, lambda group: anchors(group, width, gram), n)
    evidence = together(packed, hits, lambda group, answers, g: send_contexts(group, answers, g, width, gram, n, frequent), SENT)

    def least_owners(table: pa.Table) -> pa.Table:
        return least_owner_of_strings(table, width)

    settled = evidence.groupBy("b").applyInArrow(trimmed(least_owners), ANSWER)
    # the last pass needs both kinds of answers: those of pass 1 are told by a negative bucket
    both = settled.unionByName(hits.selectExpr("g", "-1 - b as b", "data"))

    def finish(group: Group, answers: pa.Table, g: int) -> pa.Table:
        b = answers["b"].to_numpy()
        first = answers.filter(pa.array(b < 0))
        first = first.set_column(first.schema.get_field_index("b"), "b", pa.array(-1 - first["b"].to_numpy(), pa.int32()))
        begin = removed_strings(group, first, answers.filter(pa.array(b >= 0)), width, gram, n, frequent)
        return outcomes(group, begin, width, with_text)

    return together(packed, both, finish, DIGESTS + (", kept binary, row_key long, text_crc32 long" if with_text else ""))


#: What tells a row of the table.
ROW = ["row_key", "doc_id", "n_bytes", "text_crc32"]


def cleaned_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` and ``n_chars`` (where there is one) counted anew.

    Removal cuts bytes; what is left of a character cut in two goes with it.
    All rows and columns stay, a text that was repeated as a whole becomes empty.
    """

    # a row is known by doc_id, length and two hashes of different kinds; the first hash tells a null doc_id from the number that stands for it
    null_id = -(2**63)
    theirs, own = ([fresh(docs, f"_{side}_{c}") for c in ROW] for side in ("kept", "own"))
    new = fresh(docs, "_kept")

    def decode(batches):
        for batch in batches:
            texts = [b.decode("utf-8", "ignore") for b in column(batch, "kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pc.fill_null(column(batch, c), null_id) for c in ROW], pa.array(texts, pa.string())], [*theirs, new])

    found = remove_repeated_bytes(docs, width, with_text=True).filter("n_removed > 0").select(*ROW, "kept")
    # rows equal in doc_id and text lose the same bytes; sums and join meet in one exchange
    kept = found.mapInArrow(decode, ", ".join(f"`{c}` long" for c in theirs) + f", `{new}` string").groupBy(*theirs).agg(F.first(new).alias(new))
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    marks = [row_key(doc_id, text), F.coalesce(doc_id, F.lit(null_id)), F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0))]
    keyed = docs.withColumns(dict(zip(own, marks, strict=True)))
    same = [F.col(a) == F.col(b) for a, b in zip(own, theirs, strict=True)]
    fields = {c: F.col(f"`{c}`") for c in docs.columns}
    fields["text"] = F.coalesce(new, "text").alias("text")
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.char_length(new)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return keyed.join(kept, same, "left").select(*fields.values())
