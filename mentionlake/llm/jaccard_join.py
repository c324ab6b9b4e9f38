"""N-gram Jaccard join by chosen paths: documents whose sets of word shingles are similar, their classes and their numbers of links.

1. Documents with equal sets (exact copies among them) become one class at once; from here on its smallest doc_id stands for it.
2. Chosen paths. In each run a set chooses tokens by a hash that all sets share, about ``CHOICES`` of them, and joins the bucket of each. A bucket of
   over ``SMALL`` sets is split: its members choose again, by a hash of the bucket, and so on. Two sets at the threshold share a chosen token
   with a probability that is known for each depth; as many runs are made as the target recall needs at the greatest depth.
3. Small buckets are compared by brute force: by size and a sketch of 32 minima first; what may be similar is verified on the whole sets. Buckets
   still large at the greatest depth are compared in blocks, so no group that a task holds is larger than two blocks.
4. Verified links of a bucket are handed on as a spanning forest, not as all pairs, and connected into classes.
5. All pairs that are links lie in one class. So inside each class, again in blocks, every pair is compared on whole sets: that gives
   each document its number of links (copies counted), with no pair written anywhere.

Words are runs of characters other than space and U+0009 to U+000D, unchanged. Defined results: a text of fewer words than a shingle has one shingle, all its
words. A text without words (null, empty) has no set: it links to nothing and is its own class. Rows that repeat a doc_id are each a document with that
id, whether their texts are equal or not; of classes with the same smallest doc_id each has its own members. Null doc_ids take no part in classes: class and copy are null, links 0. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import maybe_among, settled, stream_groups, table, word_hashes
from mentionlake.llm.substring_dedup import window_hashes

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
CHOICES = 2.0
SMALL = 2000
BLOCK = 2000
#: Shingles that the texts of a block may have, about: what a task holds is bounded by words, too.
BLOCK_SHINGLES = 2_000_000
DEPTH = 4
BINS = 32
#: How far below the threshold a sketch may lie, in units of 1 / sqrt(bins used); five standard deviations at the threshold.
MARGIN = 2.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, choices: float = CHOICES, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the wanted probability, even if each of its buckets was split to the greatest depth."""
    met = 1.0
    for _ in range(depth):
        met = 1 - math.exp(-choices * threshold * met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


class Sets:
    """Sorted distinct hashes of the shingles of texts."""

    def __init__(self, size: int):
        self.size, self.powers = size, {}

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words, counts = word_hashes(texts)
        at = 0
        for n in counts.tolist():
            own, at = words[at : at + n], at + n
            yield np.unique(window_hashes(own, min(self.size, n), self.powers)[0]) if n else own


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def chosen(tokens: np.ndarray, path: int, choices: float) -> np.ndarray:
    """Buckets of the tokens that a set chooses on a path."""
    drawn = mixed(tokens ^ np.uint64((path * int(GOLDEN) + 1) & (2**64 - 1)))
    if len(tokens) > choices:
        tokens = tokens[drawn < np.uint64(int(choices / len(tokens) * 2**64))]
    return mixed(tokens * GOLDEN + np.uint64(path & (2**64 - 1)))


def sketch(tokens: np.ndarray) -> bytes:
    """The smallest token of each of 32 ranges, a byte of each; 0 for an empty range."""
    edge = np.searchsorted(tokens, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 5))
    stop = np.append(edge[1:], len(tokens))
    first = tokens[np.minimum(edge, len(tokens) - 1)]
    return np.where(edge < stop, first % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def _members(size: int, texts: bool = False) -> Callable:
    """Of each row doc_id, the 128-bit hash of its set (null without words), and the set's size or, with `texts`, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            keys, sizes = [], []
            for s in sets.of(batch.column("text")):
                sizes.append(len(s))
                h = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                keys.append((None, None) if h is None else (h >> 64, h & (2**64 - 1)))
            k1, k2 = (pa.array([None if k[i] is None else k[i] - 2**63 for k in keys], pa.int64()) for i in (0, 1))
            last = batch.column("text") if texts else pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), k1, k2, last], names=["doc_id", "k1", "k2", "text" if texts else "n"])

    return run


ROWS = "bucket long, id long, n int, sketch binary"


def _choose(size: int, choices: float, runs: int | None) -> Callable:
    """Rows of buckets: of the runs, or of the paths that each row lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            paths = batch.column("paths").to_pylist() if runs is None else None
            for k, (doc_id, s) in enumerate(zip(batch.column("doc_id").to_pylist(), sets.of(batch.column("text")), strict=True)):
                if not len(s):
                    continue
                buckets = np.unique(np.concatenate([chosen(s, p, choices) for p in (range(runs) if paths is None else paths[k])]))
                out[0].append(buckets.view(np.int64))
                out[1] += [doc_id] * len(buckets)
                out[2] += [len(s)] * len(buckets)
                out[3] += [sketch(s)] * len(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["bucket", "id", "n", "sketch"])

    return run


def _trees(near: Callable[[int, int], np.ndarray], count: int, step: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the graph on `count` nodes: edges (node, node it was reached from). near(a, b): rows a to b of the adjacency matrix."""
    matrix = np.concatenate([near(a, min(a + step, count)) for a in range(0, count, step)]) if count else np.zeros((0, 0), bool)
    todo, edges = np.ones(count, bool), []
    for root in range(count):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            x = front.pop()
            new = np.flatnonzero(matrix[x] & todo)
            todo[new] = False
            edges += [(int(y), x) for y in new]
            front += new.tolist()
    return edges


def _clusters(threshold: float) -> Callable:
    """Of each bucket or pair of blocks: groups of sets that sketches can't tell apart, by a hash of their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in stream_groups(batches, 3):
            ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            n = group.column("n").to_numpy()[first].astype(float)
            s = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)[first]
            side = group.column("block").to_numpy()[first]

            def near(a: int, b: int, n=n, s=s, side=side, key=key) -> np.ndarray:
                same, used = np.zeros((b - a, len(n)), np.int16), np.zeros((b - a, len(n)), np.int16)
                for k in range(BINS):
                    x, y = s[a:b, k, None], s[None, :, k]
                    same += (x == y) & (x > 0)
                    used += (x | y) > 0
                ok = same / np.maximum(used, 1) >= threshold - MARGIN / np.sqrt(np.maximum(used, 1))
                ok &= np.minimum(n[a:b, None], n) >= threshold * np.maximum(n[a:b, None], n) - 1e-9
                if key[1] != key[2]:
                    ok &= side[a:b, None] != side
                return ok

            edges = _trees(near, len(ids))
            root = np.arange(len(ids))
            for y, x in edges:  # an edge's second node was reached before
                root[y] = root[x]
            by_root = np.argsort(root, kind="stable")
            for members in np.split(ids[by_root], np.flatnonzero(np.diff(root[by_root])) + 1):
                if len(members) > 1:
                    h = xxhash.xxh3_64_intdigest(members.tobytes()) - 2**63
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(members), pa.int64()), pa.array(members), pa.array(n[np.searchsorted(ids, members)].astype(np.int64))], names=["cluster", "id", "n"])

    return run


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The matrix of pairs at the threshold or above, on whole sets."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    often = np.bincount(at, minlength=len(tokens)) > 1
    column = (np.cumsum(often) - 1)[at]
    row, column = row[often[at]], column[often[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        block = np.zeros((len(sets), width), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        shared += block @ block.T
    return shared >= threshold * (sizes[:, None] + sizes - shared) - 1e-6


def _verified(size: int, threshold: float, counting: bool) -> Callable:
    """Of each group of texts: a spanning forest of its links, or the number of links of each text, copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for key, group in stream_groups(batches, 3):
            ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
            links = similar(list(sets.of(group.column("text").take(first))), threshold)
            np.fill_diagonal(links, False)
            if counting:
                side = group.column("block").to_numpy()[first]
                if key[1] != key[2]:
                    links &= side[:, None] != side
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((links @ group.column("copies").to_numpy()[first].astype(np.float64)).astype(np.int64))], names=["a", "b"])
            else:
                edges = _trees(lambda a, b, m=links: m[a:b], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[[e[0] for e in edges]], pa.int64()), pa.array(ids[[e[1] for e in edges]], pa.int64())], names=["a", "b"])

    return run


def in_blocks(rows: DataFrame, key: str, many: DataFrame, block: int) -> DataFrame:
    """rows with the columns lo, hi and block: a key of up to `block` rows (k), and as many shingles (words) as a block may have, is one group; a larger one is cut into blocks, and each pair of blocks is a group."""
    words = F.col("words") / BLOCK_SHINGLES if "words" in many.columns else F.lit(0)
    cut = rows.join(many.select(key, F.ceil(F.greatest(F.col("k") / block, words)).cast("int").alias("blocks")), key)
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0)
    spread = cut.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")


def by_group(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def with_text(rows: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (id, ...) with the text of each id; ids is a settled table that holds all of them. Texts that no row asks for are not shuffled."""
    listed = maybe_among(docs, ids.select(F.col("id").alias("d")))[0].select(F.col("doc_id").alias("id"), "text")
    return rows.join(listed, "id")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of edges (a, b) is connected with. Large-star and small-star steps in turn until nothing changes."""
    pairs = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = lambda p: tuple(p.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = settled(small)
        after = sign(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = after


def several_sets(members: DataFrame) -> DataFrame:
    """(d): doc_ids of rows with different sets, or with a set and without one."""
    one = (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2")) & (F.count("k1") == F.count(F.lit(1)))
    ids = members.where("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg((one | (F.count("k1") == 0)).alias("one"))
    return settled(ids.where("not one").select("d"))


def jaccard_join(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, depth: int = DEPTH, choices: float = CHOICES) -> DataFrame:
    """(doc_id, copy_of, class_id, n_links) for every row of docs: the smallest doc_id with the same set, that of the class, and how many other documents are at the threshold or above."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = settled(docs.mapInArrow(_members(size), "doc_id long, k1 long, k2 long, n long"))
    mixed_ids = several_sets(members)
    some_mixed = not mixed_ids.isEmpty()
    lasting = members.join(mixed_ids, F.col("doc_id") == F.col("d"), "left").withColumn("own", F.when(F.col("d").isNull(), F.col("doc_id"))).drop("d") if some_mixed else members.withColumn("own", F.col("doc_id"))
    grouped = lasting.where("doc_id is not null and k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min("own").alias("own"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    # A class is known by its smallest doc_id that has one set only; without one by a number below all doc_ids.
    least = members.agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("least"))
    classes = settled(grouped.crossJoin(F.broadcast(least)).select("k1", "k2", "first", F.coalesce("own", F.col("least") - 1 - F.monotonically_increasing_id()).alias("id"), F.col("own").isNull().alias("made"), "copies", "n"))  # least: one row
    # One text for each class: those of later copies are left out, those that repeat a row are taken once.
    later = members.join(classes.where("copies > 1"), ["k1", "k2"]).select(F.col("doc_id").alias("d"), (F.col("doc_id") != F.col("id")).alias("later"))
    later = later.unionByName(mixed_ids.select("d", F.lit(True).alias("later"))) if some_mixed else later
    later = settled(later.groupBy("d").agg(F.max("later").alias("later"), F.count(F.lit(1)).alias("rows")).where("later or rows > 1").select("d", "later"))
    listed, others = maybe_among(docs, later)
    # Which ids the bitmap lists although they stay is found on ids alone; their texts are picked once, for all passes below. No later copy's text is shuffled but a few.
    listed_ids = maybe_among(members.where("doc_id is not null").select("doc_id"), later)[0]
    kept = settled(listed_ids.join(later, F.col("doc_id") == F.col("d"), "left").where("not coalesce(later, false)").select(F.col("doc_id").alias("d")).distinct())
    some = settled(maybe_among(listed, kept)[0].join(kept, F.col("doc_id") == F.col("d")).select("doc_id", "text").dropDuplicates(["doc_id"]))
    single = others.select("doc_id", "text").union(some).where("doc_id is not null")
    if some_mixed:
        theirs = maybe_among(docs, mixed_ids)[0].mapInArrow(_members(size, True), "doc_id long, k1 long, k2 long, text string")
        single = single.union(settled(theirs.join(classes.where("made"), ["k1", "k2"]).groupBy("id").agg(F.min("text").alias("text"))))

    rows = single.mapInArrow(_choose(size, choices, runs_needed(recall, threshold, choices, depth)), ROWS)
    found = None
    for level in range(1, depth + 1):
        rows = settled(rows)
        many = settled(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        large = many.where(F.col("k") > small) if level < depth else many.limit(0)
        few = many.where(F.col("k") <= small) if level < depth else many
        among = lambda buckets, rows=rows: maybe_among(rows, buckets.select(F.col("bucket").alias("d")), "bucket")[0]  # noqa: E731  most buckets have one row, which is not shuffled
        groups = by_group(in_blocks(among(few), "bucket", few, block).select("bucket", "lo", "hi", "block", "id", "n", "sketch"), "bucket", "lo", "hi")
        clusters = groups.mapInArrow(_clusters(threshold), "cluster long, id long, n long")
        found = clusters if found is None else found.union(clusters)
        if level == depth or large.isEmpty():
            break
        paths = settled(among(large).join(large, "bucket").groupBy("id").agg(F.collect_set("bucket").alias("paths")))
        rows = with_text(paths, single, paths).select(F.col("id").alias("doc_id"), "text", "paths").mapInArrow(_choose(size, choices * 2, None), ROWS)
    found = settled(found.distinct())
    in_cluster = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("words"))
    whole = with_text(in_blocks(found, "cluster", in_cluster, 2 * block), single, found).select("cluster", "lo", "hi", "block", "id", "text", F.lit(1).alias("copies"))
    forest = by_group(whole, "cluster", "lo", "hi").mapInArrow(_verified(size, threshold, False), "a long, b long")
    joined = components(forest)
    nodes = joined.union(joined.select(F.col("component").alias("id"), "component")).distinct()
    nodes = settled(nodes.join(classes.select("id", "first", "copies", "n"), "id"))
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("words"))
    placed = with_text(in_blocks(nodes, "component", sizes, block), single, nodes).select("component", "lo", "hi", "block", "id", "text", "copies")
    links = by_group(placed, "component", "lo", "hi").mapInArrow(_verified(size, threshold, True), "a long, b long")
    linked = links.groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    named = nodes.groupBy("component").agg(F.min("first").alias("class")) if some_mixed else None
    nodes = nodes.join(named, "component").select("id", "class") if some_mixed else nodes.select("id", F.col("component").alias("class"))
    known = classes.join(nodes, "id", "left").join(linked, "id", "left")
    known = known.select("k1", "k2", F.col("first").alias("copy_of"), F.coalesce("class", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lone = members.where("doc_id is null or k1 is null").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.where("doc_id is not null").join(known, ["k1", "k2"]).select("doc_id", "copy_of", "class_id", "n_links").union(lone)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
