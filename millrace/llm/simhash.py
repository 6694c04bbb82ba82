"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most RADIUS bits agree in one of RADIUS + 1
bands, so each goes to one bucket a band.  A bucket stores the bit planes of
its fingerprints vertically: one machine word holds the same bit of 64
fingerprints.  XOR with a query's bit gives 64 differences at once, a
carry-save counter of three words adds them up, and a block of 64 is abandoned
as soon as all its lanes exceed the radius.

A bucket gives a spanning forest of its links, never all pairs.  Buckets that
are too full are split exactly: first by the rest of the band and a band of
the other bits, then into tiles that meet pairwise.

Edge cases: null and empty texts have no words and fingerprint zero; they
link like any other.  Equal fingerprints are one node.  Repeated rows share
their class.  An empty table gives an empty result.  A null doc_id gets a
class only through rows with an id.

near_copies() is the wider operator of the pipeline: word shingles as sets,
256-bit fingerprints that propose pairs, and exact Jaccard similarity that
decides.  What the proposals leave apart meets once more through the whole
prefixes of the sets, without any cap, so its classes are exact.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, stash, tidy, utf8
from .components import components

RADIUS = 2
#: Shift and width of the RADIUS + 1 bands of 64 bits.
BANDS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints that a bucket aims at, and that it may hold.
BUCKET, FULL = 1024, 4096
SEED = 42

#: near_copies(): words a shingle, least Jaccard similarity, and differing bits of 256 that a candidate may have.
#: At similarity 0.8 about 39 bits differ, give or take 6; unrelated texts differ in 128, give or take 8.
COPY_SHINGLE, SIMILAR, WIDE = 5, 0.8, 80
#: Smallest shingle hashes of a set that serve as its keys, rows that span each other at once, and ways to cut a fuller key into tiles.
KEYS, TILE, CUTS = 12, 1024, 3
#: Differing bits of 256 up to which texts are as good as surely similar, and further candidates of a row beyond them.
SURE, SPARE = 20, 8
#: One text in so many is counted for frequent shingles, how many of these make one frequent, and how many frequent ones are told apart.
#: They set the order of shingles only: the classes are the same with any.
SAMPLE, OFTEN, LISTED = 16, 8, 50_000
#: Names of texts that are broadcast; with more of them texts are shuffled.
FETCHED = 500_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(text: bytes, size: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words: of the whole sequence."""
    words = text.lower().split()  # on bytes: ASCII letters, ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": np.array([fingerprint(shingle_hashes(utf8(t), shingle, seed)) for t in frame["text"]], np.int64)})

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, fp long")


def hits(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bit matrix [n, words]: bit j of row i is set if fps i and j differ in at most `radius` (0 to 2) bits."""
    n = len(fps)
    lanes = -(-n // 64)
    bits = np.zeros((64, lanes * 64), np.uint8)
    bits[:, :n] = (fps[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    padding = np.packbits((np.arange(lanes * 64) >= n).astype(np.uint8), bitorder="little").view(np.uint64)
    out = np.zeros((n, lanes), np.uint64)
    step = max(1, (1 << 18) // lanes)
    for start in range(0, n, step):
        stop = min(n, start + step)
        # a block is one word of lanes against one row; the row's own lane is out from the start
        row, lane = (x.ravel() for x in np.meshgrid(np.arange(start, stop), np.arange(lanes), indexing="ij"))
        over = padding[lane] | np.where(row >> 6 == lane, np.uint64(1) << (row & 63).astype(np.uint64), np.uint64(0))
        ones, twos, mine = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64), fps[row]
        for b in range(64):
            diff = planes[b][lane] ^ np.where((mine >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
            carry = ones & diff
            ones ^= diff
            over |= twos & carry
            twos ^= carry
            if b % 8 == 7 and b < 63:
                stay = (over | _beyond(ones, twos, radius)) != full
                if not stay.all():
                    row, lane, ones, twos, over, mine = (x[stay] for x in (row, lane, ones, twos, over, mine))
                if not len(row):
                    break
        out[row, lane] = ~(over | _beyond(ones, twos, radius))
    own = np.arange(n)
    out[own, own >> 6] |= np.uint64(1) << (own & 63).astype(np.uint64)
    return out


def _beyond(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    return {0: ones | twos, 1: twos, 2: ones & twos}[radius]


def forest(matrix: np.ndarray) -> np.ndarray:
    """For each row of a symmetric bit matrix the first row of its component."""
    n, lanes = matrix.shape
    root = np.full(n, -1, np.int64)
    free = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(n):
        if root[i] >= 0:
            continue
        queue = [i]
        root[i] = i
        free[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        while queue:
            new = matrix[queue.pop()] & free
            if new.any():
                free &= ~new
                found = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
                root[found] = i
                queue.extend(found.tolist())
    return root


def _band(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _buckets(nodes: DataFrame, n: int) -> DataFrame:
    """(key, fp, node): every two nodes within the radius share a key, and a key has FULL rows at most, or twice that where two tiles meet."""
    prefix = min(21, max(0, int(np.ceil(np.log2(max(1, n) / BUCKET)))))
    band = [F.struct(F.lit(i).alias("i"), _band(F.col("fp"), s, w).alias("value"), F.shiftright(_band(F.col("fp"), s, w), w - prefix).alias("head")) for i, (s, w) in enumerate(BANDS)]
    rows = nodes.select("fp", "node", F.explode(F.array(*band)).alias("b"))
    rows = rows.select("fp", "node", F.col("b.i").alias("i"), F.col("b.value").alias("value"), F.concat_ws(":", "b.i", "b.head").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "key")
    calm = rows.filter(F.col("n") <= FULL).select("key", "fp", "node")
    # the other bits of a fingerprint within the radius agree in one of three further bands
    inner = []
    for i in range(len(BANDS)):
        halves = [BANDS[j] for j in range(len(BANDS)) if j != i]
        # cut the first and the second of the other bands so that three pieces cover both
        (s1, w1), (s2, w2) = halves
        cut1, cut2 = w1 * 2 // 3, w2 // 3
        pieces = [_band(F.col("fp"), s1, cut1), F.concat_ws(",", _band(F.col("fp"), s1 + cut1, w1 - cut1), _band(F.col("fp"), s2, cut2)), _band(F.col("fp"), s2 + cut2, w2 - cut2)]
        inner.append(F.array(*[F.concat_ws(":", F.lit(f"{i}/{k}"), F.col("value"), p.cast("string")) for k, p in enumerate(pieces)]))
    deep = rows.filter(F.col("n") > FULL).select("fp", "node", F.explode(F.when(F.col("i") == 0, inner[0]).when(F.col("i") == 1, inner[1]).otherwise(inner[2])).alias("key"))
    sizes = deep.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    deep = deep.join(sizes, "key").withColumn("tiles", F.ceil(F.col("n") / FULL).cast("int"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    deep = deep.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    deep = deep.select(F.concat_ws(":", "key", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), "fp", "node")
    return calm.unionAll(deep)


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    root = forest(hits(frame["fp"].to_numpy().astype(np.int64).view(np.uint64)))
    own = root != np.arange(len(root))
    node = frame["node"].to_numpy()
    return pd.DataFrame({"u": node[own], "v": node[root[own]]})


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text)."""
    marked = checkpointed(fingerprints(docs, shingle, seed))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linkable = nodes.filter(F.col("node").isNotNull())
    keyed = _buckets(linkable, linkable.count())
    edges = keyed.groupBy("key").applyInPandas(_links, "u long, v long")
    found = components(edges)
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(checkpointed(classes), "fp").select("doc_id", "fp", "component_id")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256-bit SimHash of distinct hashes as four signed words, from four mixes of each hash."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14), None] * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX[::-1]
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(np.int64)


def _set_key(hashes: np.ndarray) -> str:
    return hashlib.md5(hashes.tobytes()).hexdigest()


def sketches(docs: DataFrame, shingle: int = COPY_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, body, node, size, words, keys) of every row of docs (doc_id, body, text): the row's names, a digest of its set of shingles, how many they are, the wide fingerprint and the keys.

    Two sets of the least similarity share one of their n - ceil(similar n) + 1
    smallest hashes.  Of those at most KEYS are taken; no one of KEYS is shared
    with a chance of (1 - similar) ** KEYS, 4e-9.
    """

    def work(frames):
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = np.unique(shingle_hashes(utf8(text), shingle))
                n = len(found)
                most = min(KEYS, prefix_length(n, similar))
                rows.append((_set_key(found), n, wide_fingerprint(found), found[:most].view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "size", "words", "keys"]).assign(doc_id=frame["doc_id"].to_numpy(), body=frame["body"].to_numpy())[["doc_id", "body", "node", "size", "words", "keys"]]

    return map_batches(docs.select("doc_id", "body", "text"), work, "doc_id long, body long, node string, size long, words array<long>, keys array<long>")


def spanning(words: np.ndarray, sizes: np.ndarray, radius: int, similar: float) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest, by differing bits, of rows within the radius whose sizes allow the similarity (Prim).

    Such a forest connects whatever is connected at any smaller radius.  Its
    edges of more than SURE bits may fail on the sets where another would
    hold: rows also get their SPARE nearest outside their part of the forest
    without those edges.
    """
    far = 1 << 20

    def bits(i: int) -> np.ndarray:
        found = np.bitwise_count(words ^ words[i]).sum(axis=1, dtype=np.int64)
        fits = (found <= radius) & (np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i]) - 1e-9)
        return np.where(fits, found, far)

    n = len(words)
    best, near, free, part = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool), np.arange(n)
    edges, at = [], 0
    for _ in range(n - 1):
        free[at] = False
        found = bits(at)
        closer = free & (found < best)
        best[closer], near[closer] = found[closer], at
        at = int(np.argmin(np.where(free, best, far + 1)))
        if best[at] < far:
            edges.append((at, int(near[at])))
            if best[at] <= SURE:
                part[at] = part[near[at]]
    if (part != part[0]).any():
        for i in range(n):
            found = np.where(part != part[i], bits(i), far)
            first = np.argsort(found, kind="stable")[:SPARE]
            edges += [(i, int(j)) for j in first[found[first] < far]]
    return edges


def _candidates(nodes: DataFrame, radius: int, similar: float) -> DataFrame:
    """(u, v): for every key a spanning forest of the nodes that have it and spare pairs; a key of more than TILE nodes is cut into tiles, in one of CUTS ways."""

    def span(frame: pd.DataFrame) -> pd.DataFrame:
        edges = spanning(np.stack(frame["words"].to_list()).astype(np.int64).view(np.uint64), frame["size"].to_numpy(), radius, similar)
        node = frame["node"].to_numpy()
        return pd.DataFrame({"u": [node[a] for a, _ in edges], "v": [node[b] for _, b in edges]}, dtype=object)

    keyed = nodes.select("node", "size", "words", F.explode("keys").alias("key"))
    sizes = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("n > 1"))
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("words").alias(f"words_{name}"))
    bits = sum((F.bit_count(F.col("words_u")[i].bitwiseXOR(F.col("words_v")[i])) for i in range(1, 4)), F.bit_count(F.col("words_u")[0].bitwiseXOR(F.col("words_v")[0])))
    twos = sizes.filter("n = 2 and a < b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct().join(side("u"), "u").join(side("v"), "v")
    twos = twos.filter((bits <= radius) & (F.least("size_u", "size_v") >= similar * F.greatest("size_u", "size_v") - 1e-9)).select("u", "v")
    # fingerprints go only to the rows of keys that are left
    full = keyed.select("node", "key").join(sizes.filter("n > 2").select("key", "n"), "key").join(nodes.select("node", "size", "words"), "node")
    tile = F.pmod(F.xxhash64("node", F.pmod("key", F.lit(CUTS))), F.ceil(F.col("n") / TILE))
    spans = full.select(F.concat_ws(":", "key", tile).alias("part"), "node", "size", "words").groupBy("part").applyInPandas(span, "u string, v string")
    return twos.unionAll(spans).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def frequent_shingles(docs: DataFrame, shingle: int = COPY_SHINGLE) -> list[int]:
    """Hashes of shingles that many texts of a sample hold, from rarer to more frequent; at most LISTED."""

    def work(frames):
        for frame in frames:
            found = [np.unique(shingle_hashes(utf8(t), shingle)) for t in frame["text"]]
            yield pd.DataFrame({"hash": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)})

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInPandas(tidy(work), "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    return [r.hash for r in counts.orderBy(F.desc("n"), "hash").limit(LISTED).collect()][::-1]


def prefix_length(n: int, similar: float) -> int:
    """Of a set of n: two sets of the similarity share one of so many first elements, in any order common to both."""
    return n - math.ceil(similar * n - 1e-9) + 1 if n else 0


def prefixes(docs: DataFrame, frequent: list[int], shingle: int = COPY_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(nid, key): the elements of each set's prefix, in order of (place in `frequent`, hash); nid is the hash of the set's digest.  A task gives equal sets once."""
    listed = np.array(frequent, np.int64).view(np.uint64)
    order = np.argsort(listed)
    by_hash, rank = listed[order], order + 1

    def first(found: np.ndarray) -> np.ndarray:
        most = prefix_length(len(found), similar)
        if len(by_hash):
            at = np.minimum(np.searchsorted(by_hash, found), len(by_hash) - 1)
            known = by_hash[at] == found
            if known.any():
                found = found[np.lexsort((found, np.where(known, rank[at], 0)))]
        return found[:most].view(np.int64)

    def work(frames):
        seen = set()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = np.unique(shingle_hashes(utf8(text), shingle))
                name = _set_key(found)
                if name not in seen:
                    seen.add(name)
                    rows.append((name, first(found)))
            yield pd.DataFrame(rows, columns=["node", "keys"])

    return docs.select("text").mapInPandas(tidy(work), "node string, keys array<long>").select(F.xxhash64("node").alias("nid"), F.explode("keys").alias("key"))


def _apart(docs: DataFrame, classes: DataFrame, shingle: int, similar: float) -> DataFrame:
    """(u, v): every pair of nodes of different classes that may reach the similarity; classes (node, size, class).

    Such a pair shares an element of both prefixes.  What it shares beyond
    them is at most what one of the sets has left, so pairs that share too few
    of the prefixes' elements fall out on counts alone.  A key of many nodes
    is cut into tiles that all meet.
    """
    of_key = W.partitionBy("key")
    shared = prefixes(docs, frequent_shingles(docs, shingle), shingle, similar)
    shared = shared.withColumn("a", F.min("nid").over(of_key)).withColumn("b", F.max("nid").over(of_key)).filter("a < b").select("key", "nid").distinct()
    shared = shared.join(classes.select(F.xxhash64("node").alias("nid"), "node", "size", "class"), "nid").select("key", "node", "size", "class")
    # keys within one class, as of large groups of copies, have nothing left to link
    shared = shared.withColumn("n", F.count(F.lit(1)).over(of_key)).withColumn("a", F.min("class").over(of_key)).withColumn("b", F.max("class").over(of_key)).filter("a < b")
    open_ = stash(shared.select("key", "node", "size", "class", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "open")
    tile, every = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    named = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "class")]
    left = open_.select("key", *named("u"), tile.alias("i"), every.alias("j"))
    right = open_.select("key", *named("v"), tile.alias("j"), every.alias("i"))
    fits = F.least("size_u", "size_v") >= similar * F.greatest("size_u", "size_v") - 1e-9
    met = left.join(right, ["key", "i", "j"]).filter((F.col("class_u") < F.col("class_v")) & fits)
    met = met.groupBy(F.col("node_u").alias("u"), F.col("node_v").alias("v"), "size_u", "size_v").agg(F.count(F.lit(1)).alias("n"))
    rest = F.greatest(*[F.ceil(F.lit(similar) * F.col(c) - 1e-9) - 1 for c in ("size_u", "size_v")])
    return met.filter(F.col("n") + rest >= similar / (1 + similar) * (F.col("size_u") + F.col("size_v")) - 1e-6).select("u", "v")


def _confirmed(pairs: DataFrame, named: DataFrame, nodes: DataFrame, shingle: int, similar: float) -> DataFrame:
    """The pairs (u, v) whose sets, made from named (doc_id, body, text), have the similarity."""

    def sets(frames):
        for frame in frames:
            found = [np.unique(shingle_hashes(utf8(t), shingle)) for t in frame["text"]]
            yield pd.DataFrame({"node": [_set_key(f) for f in found], "hashes": [f.tobytes() for f in found]})

    def confirm(frames):
        for frame in frames:
            good = []
            for a, b in zip(frame["a"], frame["b"]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similar * (len(a) + len(b) - both) - 1e-9)
            yield frame.loc[good, ["u", "v"]]

    needed = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct().join(nodes, "node").select(F.col("least.doc_id").alias("id"), F.col("least.body").alias("own"))
    held = named.join(broadcast_if_few(checkpointed(needed)), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("own"))).select("text").mapInPandas(tidy(sets), "node string, hashes binary")
    held = held.dropDuplicates(["node"])  # both sides share its exchange
    side = lambda name, value: held.select(F.col("node").alias(name), F.col("hashes").alias(value))
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInPandas(tidy(confirm), "u string, v string")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, radius: int = WIDE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, body, component_id, first) for every row of docs (doc_id, text): classes of documents linked by a Jaccard similarity of `similar` or more.

    body is body_of(text) and names a row together with its doc_id, so that
    rows of one doc_id with different texts are told apart.  component_id is
    the smallest doc_id of the class, null if none has one; first marks the
    rows of the class's smallest (doc_id, body), null ids last: one row, or
    repeats of one.  Texts without words are one class.

    Equal sets are one node.  Candidates are spanning forests, so a group of
    copies costs links in proportion to its size; each is confirmed on the sets.
    They find nearly all links.  Nodes that are in different classes then are
    joined by the whole prefixes of their sets (_apart), which misses none.
    """
    named = docs.select("doc_id", body_of("text").alias("body"), "text")
    marked = stash(sketches(named, shingle, similar), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body"))
    nodes = stash(marked.groupBy("node").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("size", "words", "keys")]), "sets")
    found = checkpointed(components(_confirmed(checkpointed(_candidates(nodes, radius, similar)), named, nodes, shingle, similar)))
    apart = checkpointed(_apart(docs, nodes.join(found, "node", "left").select("node", "size", F.coalesce("component", "node").alias("class")), shingle, similar))
    if not apart.isEmpty():
        links = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = components(links.unionAll(_confirmed(apart, named, nodes, shingle, similar)))
    classes = checkpointed(nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("class")))
    firsts = classes.groupBy("class").agg(F.min("least").alias("least"))
    classes = checkpointed(classes.select("node", "class").join(firsts, "class").select("node", "least"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("body") == F.col("least.body"))
    return marked.select("doc_id", "body", "node").join(classes, "node").select("doc_id", "body", F.col("least.doc_id").alias("component_id"), first.alias("first"))


def broadcast_if_few(names: DataFrame) -> DataFrame:
    """names, broadcast if they are at most FETCHED."""
    return F.broadcast(names) if names.count() <= FETCHED else names


def body_of(text: str) -> Column:
    """A number that names a text; rows meet on it together with their doc_id."""
    return F.xxhash64(text, F.length(text))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
