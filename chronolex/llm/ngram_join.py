"""N-gram Jaccard join: texts whose sets of word shingles are alike, by a size-aware heavy-light join.

Two sets of sizes a <= b with Jaccard >= t share c(a, b) = ceil(t (a + b) / (1 + t)) shingles at least.

* Small sets (size up to a boundary) enumerate their subsets of the fixed sizes c that their possible
  partners ask for; linked sets have such a subset in common.
* Large sets are found through inverted lists: under any one order of the shingles two linked sets
  share a shingle among their first n - ceil(t n) + 1, so only these are listed. The order puts light
  shingles first (by hash) and heavy ones, which many texts hold, last: passages found in a third of all
  texts don't make lists. Heavy ones come from counts over all texts; the order decides speed only.
* The boundary is where subsets to enumerate plus entries to list, from the counts of set sizes, cost least.

Equal sets are one class from the start, summed before the shuffle. Lists are not expanded into pairs at
first: each class of a list is compared with the list's hub; what that links falls into components,
and only classes of a list that are still in different components are compared with each other. So no
link between components is lost, and large groups of copies stay linear. All comparisons are exact, on
64-bit hashes of shingles (of 64-bit hashes of words).

Null, empty and wordless texts have no shingles and link with nothing; fewer words than the shingle size
make one shingle of the whole sequence; very long texts are read whole. Rows with equal doc_id count as one
node; a row without doc_id links with nothing. Other columns are not read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import WordHashes, discard, memo, mix64, slices, staged, unused, words_of
from chronolex.llm.graph import components

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
HEAVY = 16  # texts that hold a shingle, by counts within stretches of texts, from which it is heavy
MOST_HEAVY = 500_000  # of these the most frequent are kept: 4 MB
BROADCAST_ROWS = 500_000
STRETCH = 3_000_000  # shingles of a stretch that is counted at once


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; shorter texts are one shingle of their own length."""
    words = [words_of(text) for text in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h = memo("word hashes", WordHashes)([w for ws in words for w in ws])
    starts = np.cumsum(counts) - counts
    total = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    if len(total):
        for i in range(k):
            total = mix64(total * _STEP[0] + mix64(h[i : len(h) - k + 1 + i] + _STEP[i % 5]))
    out = []
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n >= k:
            made = np.sort(total[start : start + n - k + 1])
            new = np.ones(len(made), bool)
            np.not_equal(made[1:], made[:-1], out=new[1:])
            out.append(made[new])
        elif n:
            one = np.full(1, n, np.uint64)
            for i in range(n):
                one = mix64(one * _STEP[0] + mix64(h[start + i : start + i + 1] + _STEP[i % 5]))
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bitmap(members: np.ndarray) -> bytes:
    """Parity bitmap of a set, two bits a member or more: the bits in which two bitmaps differ are at most the members in which the sets do."""
    bits = max(256, 1 << int(2 * len(members) - 1).bit_length()) if len(members) else 256
    at = (members >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits) & 1 == 1, bitorder="little").tobytes()


def may_link(x: bytes, n: int, y: bytes, m: int, t: Fraction) -> bool:
    """False only for sets of sizes n and m that cannot have Jaccard >= t."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):  # the larger one folds to the size of the other
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    apart = int(np.bitwise_count(a ^ b).sum())
    return apart <= n + m - 2 * least_overlap(n, m, t)


def least_overlap(a: int, b: int, t: Fraction) -> int:
    return math.ceil(t * (a + b) / (1 + t))


def partner_sizes(n: int, t: Fraction) -> range:
    return range(math.ceil(t * n), math.floor(n / t) + 1)


def subset_sizes(n: int, t: Fraction, boundary: int) -> list[int]:
    """Sizes of the subsets that a set of n enumerates: for every partner such that the smaller of the two is small."""
    return sorted({least_overlap(n, m, t) for m in partner_sizes(n, t) if min(n, m) <= boundary})


def prefix_length(n: int, t: Fraction) -> int:
    return n - math.ceil(t * n) + 1


def choose_boundary(sizes: dict[int, int], t: Fraction, most: int = 64) -> int:
    """The boundary with the fewest subsets and list entries together."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, times in sizes.items():
            if math.ceil(t * n) <= boundary:
                total += times * sum(math.comb(n, c) for c in subset_sizes(n, t, boundary))
            if n > boundary:
                total += times * prefix_length(n, t)
        return total

    return min(range(most + 1), key=lambda x: (cost(x), -x))


def signatures(members: np.ndarray, t: Fraction, boundary: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set and their places: subsets (place 0) when small, the light-first prefix when large (both, near the boundary)."""
    n = len(members)
    made, places = [], []
    if math.ceil(t * n) <= boundary:
        total = members.sum(dtype=np.uint64)
        for c in subset_sizes(n, t, boundary):
            tag = mix64(np.array([c], np.uint64))[0]
            if c == n:
                out = np.array([total], np.uint64)
            elif c == n - 1:
                out = total - members
            else:
                out = np.array([members[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), c)], np.uint64)
            made.append(np.unique(mix64(out ^ tag)))
            places.append(np.zeros(len(made[-1]), np.int64))
    if n > boundary:
        p = prefix_length(n, t)
        known = np.zeros(n, bool)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, members), len(heavy) - 1)
            known = heavy[at] == members
        light = members[~known]
        first = light[:p]
        if len(first) < p:
            first = np.concatenate([first, members[known][: p - len(first)]])
        made.append(mix64(first))
        places.append(np.arange(len(first)))
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(made), np.concatenate(places)


def _sets(batches, k: int, named=("doc_id", "text")) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for some in slices(batch, named[1], 300):
            yield from zip(some[named[0]].to_pylist(), shingle_sets(some[named[1]].to_pylist(), k), strict=True)


def survey(docs: DataFrame, k: int) -> DataFrame:
    """One pass: per text (doc_id, n, f1, f2, bits), its set's size, fingerprint and bitmap; and, with n the negative count,
    shingles (f1) that several texts of a stretch hold."""

    def run(batches):
        rows, stretch, held = [], [], 0

        def flush():
            nonlocal stretch, held
            found, times = np.unique(np.concatenate(stretch), return_counts=True) if stretch else (np.empty(0, np.uint64), np.empty(0, np.int64))
            stretch, held = [], 0
            several = times > 1
            return packed(None, -times[several], found[several].view(np.int64), np.zeros(several.sum(), np.int64), None)

        def packed(ids, n, f1, f2, bits):
            ids = pa.nulls(len(n), pa.int64()) if ids is None else pa.array(ids, pa.int64())
            bits = pa.nulls(len(n), pa.binary()) if bits is None else pa.array(bits, pa.binary())
            return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), bits], ["doc_id", "n", "f1", "f2", "bits"])

        seen: set = set()
        for doc_id, members in _sets(batches, k):
            f1 = members.sum(dtype=np.uint64).astype(np.int64)
            f2 = mix64(members).sum(dtype=np.uint64).astype(np.int64)
            rows.append((doc_id, len(members), f1, f2, bitmap(members)))
            if (f1, f2) not in seen:  # copies within a stretch count once: they will be one class
                seen.add((f1, f2))
                stretch.append(members)
                held += len(members)
            if len(rows) >= 5000:
                yield packed(*(list(x) for x in zip(*rows, strict=True)))
                rows = []
            if held >= STRETCH:
                yield flush()
                seen = set()
        if rows:
            yield packed(*(list(x) for x in zip(*rows, strict=True)))
        yield flush()

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bits binary")


def keyed(docs: DataFrame, k: int, t: Fraction, boundary: int, heavy: np.ndarray) -> DataFrame:
    """(key, doc_id, place) for every signature; of equal sets in a batch only the first is keyed."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        for batch in batches:
            seen, keys, places, ids, held = set(), [], [], [], 0

            def packed():
                lengths = [len(x) for x in keys]
                columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), lengths)), pa.array(np.concatenate(places).astype(np.int32))]
                return pa.record_batch(columns, ["key", "doc_id", "place"])

            for doc_id, members in _sets([batch], k):
                mark = (len(members), int(members.sum(dtype=np.uint64)), int(mix64(members).sum(dtype=np.uint64)))
                if not len(members) or mark in seen:
                    continue
                seen.add(mark)
                made, at = signatures(members, t, boundary, sent.value)
                keys.append(made)
                places.append(at)
                ids.append(doc_id)
                held += len(keys[-1])
                if held > 200_000:
                    yield packed()
                    keys, places, ids, held = [], [], [], 0
            if keys:
                yield packed()

    return docs.mapInArrow(run, "key long, doc_id long, place int")


def _narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is in ids (doc_id, distinct): broadcast when few enough, shuffled else."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def plausible(pairs: DataFrame, bitmaps: DataFrame, t: Fraction) -> DataFrame:
    """pairs (a, b) whose bitmaps (node, n, bits) don't rule a link out: a hundredth of the bytes of the sets themselves."""

    def run(batches):
        for batch in batches:
            keep = [may_link(*x, t) for x in zip(*(batch[c].to_pylist() for c in ("x", "n", "y", "m")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, n, x: bitmaps.select(F.col("node").alias(k), F.col("n").alias(n), F.col("bits").alias(x))
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """pairs (a, b) of doc ids whose sets have Jaccard >= t, exactly."""
    pairs = pairs.select("a", "b")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def run(batches):
        for batch in batches:
            for some in slices(batch, rows=300):
                sets = [members.tobytes() for members in shingle_sets(some["text"].to_pylist(), k)]
                yield pa.record_batch([some["doc_id"], pa.array(sets, pa.binary())], ["doc_id", "members"])

    sets = _narrowed(docs.select("doc_id", "text"), ids)
    sets = staged(sets.mapInArrow(run, "doc_id long, members binary"), "shingle-sets")

    def compare(batches):
        def equal_or_near(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both * t.denominator >= t.numerator * (len(x) + len(y) - both) and both > 0

        for batch in batches:
            near = [equal_or_near(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a")
    second = first.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    linked = staged(second.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct(), "links")
    discard(sets)
    return linked


def jaccard_components(docs: DataFrame, k: int = 3, threshold: str = "9/10") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable through links of Jaccard >= threshold."""
    t = Fraction(threshold)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = staged(survey(docs, k), "shingle-survey")
    texts = seen.filter("n >= 0")
    sizes = {r["n"]: r["count"] for r in texts.filter(f"n BETWEEN 1 AND {4 * 64}").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, t)
    counts = seen.filter("n < 0").groupBy("f1").agg(F.sum(-F.col("n")).alias("n")).filter(F.col("n") >= HEAVY)
    heavy = np.sort(np.array([r["f1"] for r in counts.orderBy(F.desc("n"), "f1").limit(MOST_HEAVY).select("f1").collect()], np.int64).view(np.uint64))

    # classes of equal sets
    full = texts.filter("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    of_class = staged(full.join(classes, ["n", "f1", "f2"]).filter("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b")), "copies")
    lists = staged(keyed(docs.filter("doc_id IS NOT NULL"), k, t, boundary, heavy), "shingle-lists")

    # lists of several texts; their texts as classes with set sizes
    shared = lists.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
    members = lists.join(shared, "key").join(of_class.withColumnRenamed("a", "doc_id"), "doc_id", "left")
    members = members.groupBy("key", F.coalesce("b", "doc_id").alias("node")).agg(F.min("place").alias("place"))
    nodes = full.groupBy(F.col("doc_id").alias("node")).agg(F.min_by(F.struct("n", "bits"), F.struct("n", "f1", "f2")).alias("s"))
    nodes = staged(nodes.select("node", "s.n", "s.bits"), "bitmaps")
    members = staged(members.join(nodes.select("node", "n"), "node"), "list-members")
    # a list's hub has the fewest light shingles before it: in a group of copies that is the text they come from, or near it
    hubs = members.groupBy("key").agg(F.min(F.struct("place", "n", "node")).alias("hub"))
    # sizes that can be linked; and, if the list is the first the two share, enough shingles from its place on
    p, q = t.numerator, t.denominator
    close = (F.least("n", "n2") * q >= F.greatest("n", "n2") * p) & (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) * (p + q) >= (F.col("n") + F.col("n2")) * p)
    stars = members.join(hubs, "key").select(F.col("node").alias("a"), "n", "place", F.col("hub.node").alias("b"), F.col("hub.n").alias("n2"), F.col("hub.place").alias("place2"))
    stars = stars.filter((F.col("a") != F.col("b")) & close).groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"))
    able = plausible(stars.select("a", "b"), nodes, t).join(stars, ["a", "b"])
    # of several hubs the one with the most lists in common; pairs that this leaves apart come below
    tried = staged(able.groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b")), "star-pairs")
    links = verified(docs, tried, k, t).unionByName(of_class)
    grouped = components(links, "first-components")

    # classes of a list that are still apart
    apart = members.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = staged(apart, "list-components")
    split = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    rest = apart.join(split, "key")
    other = rest.select("key", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("component").alias("component2"))
    cross = rest.withColumnRenamed("node", "a").join(other, "key").filter((F.col("component") < F.col("component2")) & close).select("a", "b").distinct()
    cross = cross.join(tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    more = verified(docs, staged(plausible(cross, nodes, t), "cross-pairs"), k, t)
    final = components(links.unionByName(more), "components") if more.take(1) else grouped
    out = texts.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, k: int = 5, threshold: str = "4/5") -> DataFrame:
    """docs with one document of each group of near copies, that with the smallest doc_id; rows without doc_id stay.

    Where doc_ids repeat, rows are told apart by doc_id and text: different texts under one id are documents of their own."""
    seen = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not seen.take(1):
        grouped = staged(jaccard_components(docs, k, threshold), "near-copies")
        return _without(docs, "doc_id", grouped.filter("doc_id <> component_id").select("doc_id").distinct())
    node = unused(docs, "node")
    named = docs.withColumn(node, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    pairs = named.filter("doc_id IS NOT NULL").select("doc_id", F.col(node).alias("node"), "text")
    texts = pairs.groupBy("node").agg(F.min("text").alias("text")).select(F.col("node").alias("doc_id"), "text")
    grouped = jaccard_components(texts, k, threshold).select(F.col("doc_id").alias("node"), "component_id")
    grouped = staged(grouped.join(pairs.groupBy("node").agg(F.min("doc_id").alias("first")), "node"), "near-copies")
    kept = grouped.groupBy("component_id").agg(F.min(F.struct("first", "node")).alias("kept"))
    gone = grouped.join(kept, "component_id").filter("node <> kept.node").select(F.col("node").alias(node))
    left = _without(named, node, gone)
    once = left.filter(F.col(node).isNotNull()).dropDuplicates([node])  # rows of equal doc_id and text
    return once.unionByName(left.filter(F.col(node).isNull())).select(docs.columns)


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs whose key isn't in gone (of distinct rows)."""
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti").select(docs.columns)
