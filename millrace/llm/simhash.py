"""SimHash near-duplicates through pivot distance tables.

The table holds, for each different fingerprint, its Hamming distances to reference fingerprints (pivots).  It is computed once
and goes with the fingerprint wherever candidates are compared.  Fingerprints within ``BITS`` differing bits have
distances to any pivot that differ by at most ``BITS``.  There are two kinds of pivots:

* Masked ones, for buckets.  The 64 bits are cut into B blocks; the distances to 0, and to a pivot for each bit of a block,
  give that block's bits.  BITS differing bits touch at most BITS blocks, so two linked fingerprints have coordinates equal
  (difference 0) in at least B - BITS blocks: they meet in one of the C(B, BITS) buckets made of B - BITS blocks.  B
  grows with the number of fingerprints, so that a bucket stays about as selective as there are fingerprints.
* ``PIVOTS`` random ones, for discarding.  Of the pairs that meet in a bucket, those whose greatest coordinate difference
  exceeds BITS are discarded; ``discards`` says how many.

Survivors are verified by their exact distance.  Equal fingerprints are one class from the start, so copies make no
pairs; within a bucket only links that join two components are emitted, so a large group of near copies makes at most as
many links as it has fingerprints.  A bucket with more than ``HOT`` fingerprints is dealt out in pairs of parts of HOT.

``similar`` links by the Jaccard similarity of the sets of five-word shingles instead (0.8 or more), for which 4 of 64
bits are too few: fingerprints of ``WIDE`` bits meet under keys of sampled bits (distances to pivots masked to one bit),
as many keys as find a pair at the threshold with probability ``RECALL``.  Pairs that may be similar by their fingerprints put
texts into clusters, of which only as many pairs are emitted as hold a cluster together.  Then all pairs within a cluster whose
fingerprints allow it are verified by their whole shingle sets, in the task that has the cluster (or a pair of its parts),
and only verified pairs are links.  Random pivots discard nothing at this width and threshold and are left out there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, as_text, chunks, cut, fresh, mix, serving, spread_join
from .components import components

SHINGLE, BITS, PIVOTS, HOT, SEED = 4, 4, 12, 4096, 42
#: For ``similar``: words of a shingle, bits of a fingerprint, least chance that a pair at the threshold meets under a key,
#: binary logarithm of the unrelated fingerprints that share a key, fingerprints in a part of a hot key, and the most
#: hot keys that are broadcast (16 bytes each; more are joined).
WORDS, WIDE, RECALL, LOAD, WIDE_HOT, MOST_SENT = 5, 256, 0.995, 7, 2048, 100_000
#: Fingerprints, and bytes of their texts, in a part of a cluster that is verified; bytes of shared shingles side by side for it.
CLUSTER, CLUSTER_BYTES, TABLE_BYTES = 1024, 32 << 20, 64 << 20
#: Classes of which no document has an id get numbers from here on; so ids have to be smaller.
NAMELESS = 1 << 62
PIVOT_TABLE = np.random.default_rng(20240).integers(0, 1 << 64, PIVOTS, np.uint64, endpoint=False)
#: Bits of a coordinate in the packed table, and the distance that is 0: distances beyond are cut off, which makes differences smaller only.
COORDINATE, NEAREST = 5, 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The hash of each shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    digest = xxhash.xxh64_intdigest
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text; 0 without words."""
    return np.array([majority(shingle_hashes(text, size)) for text in texts], np.uint64)


def fingerprint(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row: doc_id, fp (the fingerprint as a signed long)."""

    @serving("simhash")
    def run(batches):
        for batch in batches:
            fp = [fingerprints(part, size) for _, part in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fp).view(np.int64) if fp else [], pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), as_text(text_column).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, bits: int = BITS) -> list[int]:
    """The masks of all keys: blocks - bits of the blocks each."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(masks[k] for k in own) for own in combinations(range(blocks), blocks - bits)]


def blocks_for(n: int, bits: int = BITS) -> int:
    """So many blocks that a key has at least about as many values as there are fingerprints (5 to 8)."""
    blocks = bits + 1
    while blocks < bits + 4 and 64 * (blocks - bits) / blocks < np.log2(max(n, 2)) + 2:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The coordinates of each fingerprint, packed."""
    packed = np.zeros(len(fps), np.int64)
    for k, pivot in enumerate(PIVOT_TABLE):
        packed |= np.clip(np.bitwise_count(fps ^ pivot).astype(np.int64) - NEAREST, 0, (1 << COORDINATE) - 1) << COORDINATE * k
    return packed


def near_by_pivots(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Whether no coordinate differs by more than ``bits``."""
    ok = np.ones(len(x), bool)
    mask = (1 << COORDINATE) - 1
    for k in range(PIVOTS):
        ok &= np.abs((x >> COORDINATE * k & mask) - (y >> COORDINATE * k & mask)) <= bits
    return ok


class Union:
    """Disjoint sets of rows; labels() has the least row of each."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def labels(self) -> np.ndarray:
        while not np.array_equal(flat := self.parent[self.parent], self.parent):
            self.parent = flat
        return self.parent


def link_blocks(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, sides: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of fingerprints in the same run of equal keys, at most one less than there are fingerprints in a run's components;
    and how many pairs were met, discarded by pivots, and verified to be links.

    sides: 0 pairs with all, 1 and 2 with each other only.
    """
    n = len(keys)
    sets, links_ = Union(n), []
    met = discarded = verified_ = 0
    active, lag = np.arange(n - 1), 1
    while True:
        active = active[active + lag < n]
        active = active[keys[active] == keys[active + lag]]
        if not len(active):
            break
        label = sets.labels()
        i = active[(label[active] != label[active + lag]) & ((sides[active] == 0) | (sides[active] != sides[active + lag]))]
        met += len(i)
        i = i[near_by_pivots(table[i], table[i + lag], bits)]
        discarded -= len(i)
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= bits]
        verified_ += len(i)
        links_ += [(x, x + lag) for x in i.tolist() if sets.join(x, x + lag)]
        lag += 1
    a, b = np.array(links_, np.int64).reshape(-1, 2).T
    return fps[a], fps[b], np.array([met, met + discarded, verified_])


def _runs(batches):
    """Batches of whole runs of equal keys (the first column) from sorted ones: the last run of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut_at = int(np.searchsorted(keys, keys[-1]))
        if cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)]).combine_chunks()
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _link_run(counting: bool):
    @serving("simhash")
    def run(batches):
        for own in _runs(batches):
            k, f, t, s = (c.to_numpy() for c in own.columns)
            a, b, n = link_blocks(k, f.view(np.uint64), t, s)
            columns = [pa.array([int(x)]) for x in n] if counting else [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["met", "discarded", "linked"] if counting else ["a", "b"])

    return run


def with_table(distinct: DataFrame) -> DataFrame:
    """(fp, pivots): the packed pivot distances of fingerprints."""

    @serving("simhash")
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pivot_table(batch.column(0).to_numpy().view(np.uint64)))], ["fp", "pivots"])

    return distinct.select("fp").mapInArrow(run, "fp long, pivots long")


def _buckets(table: DataFrame, bits: int, hot: int) -> DataFrame:
    """(key, fp, pivots, side), dealt by key and sorted."""
    n = table.count()
    masks = block_masks(blocks_for(n, bits), bits)
    keyed = table.select("fp", "pivots", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "part")).select(F.xxhash64("mask", "part").alias("key"), "fp", "pivots")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "fp", "pivots", F.ceil(F.col("n") / hot).alias("parts"))
    # A key of more than ``hot`` fingerprints: part p of them meets parts p.. in keys of their own.
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    plain = met.filter("parts = 1").select("key", "fp", "pivots", F.lit(0).alias("side"))
    dealt = met.filter("parts > 1").withColumn("p", part).select("key", "fp", "pivots", F.explode(F.expr(OTHERS)).alias("o")).select(F.xxhash64("key", "o.lo", "o.hi").alias("key"), "fp", "pivots", F.col("o.side").alias("side"))
    return plain.union(dealt).repartition(F.col("key")).sortWithinPartitions("key", "fp")


#: Pairs of parts that part p of ``parts`` belongs to, and on which side.
OTHERS = "transform(sequence(0L, parts - 1), q -> named_struct('lo', least(p, q), 'hi', greatest(p, q), 'side', if(p = q, 0, if(p < q, 1, 2))))"


def links(table: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(a long, b long): links between different fingerprints (fp, pivots) that join all that are within ``bits``."""
    return _buckets(table, bits, hot).mapInArrow(_link_run(False), "a long, b long")


def discards(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, bits: int = BITS) -> dict[str, int]:
    """How many pairs met in buckets, how many of them the pivots discarded, and how many were verified to be links."""
    table = cut(with_table(fingerprint(documents, id_column, text_column, size).select("fp").distinct()))
    row = _buckets(table, bits, HOT).mapInArrow(_link_run(True), "met long, discarded long, linked long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "discarded", "linked")]).collect()[0]
    return row.asDict()


def _named(component) -> F.Column:
    return F.when(component < NAMELESS, component)


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 lower-case hex digits), component_id.

    component_id is the least doc_id of all documents that are linked to it over any number of links of at most ``bits``
    differing bits, itself included.  A null, empty or wordless text has fingerprint zero, linked like any other; a null
    id gets the least id of its component, if that has one.  Repeated rows give a row each; an empty table gives none;
    other columns are not read.  Ids have to be smaller than 2**62.
    """
    prints = cut(fingerprint(documents, id_column, text_column, size))
    least = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.shiftrightunsigned("fp", 3))
    classes = cut(prints.groupBy("fp").agg(least.alias("node"), F.count("*").alias("n")))
    found = cut(links(cut(with_table(classes)), bits))
    # Links are between classes' least ids, so that a component's number is its least id, and no join is by component.
    side = lambda c: classes.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}"))
    joined = components(found.join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    ids = cut(classes.join(joined, F.col("node") == F.col("id"), "left").select("fp", "n", _named(F.coalesce("component", "node")).alias("component_id")))
    total = ids.agg(F.sum("n")).collect()[0][0] or 0
    return spread_join(prints, ids, "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """The SimHash of WIDE bits of a set of shingle hashes."""
    lanes = (shingles if k == 0 else mix(shingles + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(WIDE // 64))
    return b"".join(majority(lane).to_bytes(8, "big") for lane in lanes)


def wide_prints(documents: DataFrame, id_column: str, text_column: str, size: int = WORDS) -> DataFrame:
    """One row per row: doc_id, the hash and the bytes of the text, wide."""

    @serving("simhash")
    def run(batches):
        for batch in batches:
            for at, part in chunks(batch.column(2)):
                own = [wide_fingerprint(shingle_set(text, size)) for text in part]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in (0, 1)), pa.array([len(t) for t in part], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "text_hash", "bytes", "wide"])

    text = as_text(text_column)
    return documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, bytes long, wide binary")


def differing(similarity: float) -> float:
    """The share of bits in which sets of this Jaccard similarity are expected to differ (equal sizes, the worst case)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def limit(similarity: float) -> int:
    """Most differing bits of a pair that is worth verifying: of those at the threshold 0.1 % lie above."""
    p = differing(similarity)
    return int(np.ceil(WIDE * p + 3.1 * np.sqrt(WIDE * p * (1 - p))))


def sampled_bits(n: int, similarity: float) -> np.ndarray:
    """For each key the bits it is made of, so that about 2**LOAD of n unrelated fingerprints share one."""
    k = int(min(max(8, np.ceil(np.log2(max(n, 2))) - LOAD), 48))
    tables = int(np.ceil(np.log(1 - RECALL) / np.log1p(-((1 - differing(similarity)) ** k))))
    rng = np.random.default_rng(20241)
    return np.array([rng.permutation(WIDE)[:k] for _ in range(tables)])


def sampled_keys(bits: np.ndarray, with_prints: bool):
    """Keys of the fingerprints (node, wide); each with node and fingerprint if asked for."""
    weights = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)

    @serving("simhash")
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = batch.column(1).cast(pa.binary())
            own = np.unpackbits(np.frombuffer(b"".join(wide.to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1)
            for t, at in enumerate(bits):
                key = pa.array(mix(mix(own[:, at].astype(np.uint64) @ weights) + np.uint64(t + 1)).view(np.int64))
                yield pa.RecordBatch.from_arrays([key, batch.column(0), wide] if with_prints else [key], ["key", "node", "wide"][: 3 if with_prints else 1])

    return run


def _prints(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint64).reshape(-1, WIDE // 64)


def close_pairs(keys: np.ndarray, prints: np.ndarray, sides: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs in the same run of equal keys within ``most`` differing bits, as many as hold together what they connect."""
    n = len(keys)
    sets, out = Union(n), []
    ahead, lag = np.arange(n - 1), 1
    while True:
        ahead = ahead[ahead + lag < n]
        ahead = ahead[keys[ahead] == keys[ahead + lag]]
        if not len(ahead):
            break
        own = ahead[(sides[ahead] == 0) | (sides[ahead] != sides[ahead + lag])]
        own = own[np.bitwise_count(prints[own] ^ prints[own + lag]).sum(1, dtype=np.int32) <= most]
        out += [(x, x + lag) for x in own.tolist() if sets.join(x, x + lag)]
        lag += 1
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j


def _close_run(most: int):
    @serving("simhash")
    def run(batches):
        for own in _runs(batches):
            node = own.column(1).to_numpy()
            i, j = close_pairs(own.column(0).to_numpy(), _prints(own.column(2).combine_chunks()), own.column(3).to_numpy(), most)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    return run


def close_links(classes: DataFrame, n: int, similarity: float, hot: int = WIDE_HOT) -> DataFrame:
    """(a, b long): nodes of n classes (node, wide) that may be this similar, as many as hold clusters together."""
    bits = sampled_bits(n, similarity)
    own = classes.select("node", "wide")
    sizes = cut(own.mapInArrow(sampled_keys(bits, False), "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(F.col("key").alias("k"), F.ceil(F.col("n") / hot).alias("parts")))
    if sizes.count() <= MOST_SENT:
        sizes = F.broadcast(sizes)
    keyed = own.mapInArrow(sampled_keys(bits, True), "key long, node long, wide binary").join(sizes, F.col("key") == F.col("k"), "left")
    # A key of more than ``hot`` fingerprints: part p of them meets parts p.. in keys of their own.
    keyed = keyed.select("key", "node", "wide", F.coalesce("parts", F.lit(1)).alias("parts")).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")))
    plain = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("side")))
    rows = keyed.select("key", "node", "wide", F.explode(F.when(F.col("parts") > 1, F.expr(OTHERS)).otherwise(plain)).alias("o"))
    rows = rows.select(F.xxhash64("key", "o.lo", "o.hi").alias("key"), "node", "wide", F.col("o.side").alias("side"))
    return rows.repartition(F.col("key")).sortWithinPartitions("key", "node").mapInArrow(_close_run(limit(similarity)), "a long, b long")


def verified_pairs(prints: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, similarity: float, most: int) -> list[tuple[int, int]]:
    """Pairs within ``most`` bits whose shingle sets are this similar, as many as hold together what they connect."""
    n, union, out = len(sets), Union(len(sets)), []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if n else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    # Only shingles of two sets or more can be shared; each is a bit of its sets' rows.
    number = np.cumsum(count > 1) - 1
    shared = count[of] > 1
    width = -(-int((count > 1).sum()) // 64)
    table = None
    if n * width * 8 <= TABLE_BYTES:
        table = np.zeros((n, max(width, 1)), np.uint64)
        bit = number[of[shared]]
        np.bitwise_or.at(table, (owner[shared], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    for i in range(n - 1):
        label = union.labels() if i % 64 == 0 else union.parent
        j = np.arange(i + 1, n)
        j = j[(label[j] != label[i]) & ((sides[i] == 0) | (sides[j] != sides[i]))]
        # A smaller set can't hold enough of a larger one.
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9]
        j = j[np.bitwise_count(prints[j] ^ prints[i]).sum(1, dtype=np.int32) <= most]
        if not len(j):
            continue
        if table is not None:
            both = np.bitwise_count(table[j] & table[i]).sum(1, dtype=np.int64)
        else:
            both = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in j.tolist()])
        same = both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9
        out += [(i, k) for k in j[same].tolist() if union.join(i, k)]
    return out


def _verify_run(similarity: float, most: int):
    @serving("simhash")
    def run(batches):
        for own in _runs(batches):
            keys, node, sides = (own.column(k).to_numpy() for k in (0, 1, 3))
            prints = _prints(own.column(2).combine_chunks())
            a, b = [], []
            for start, stop in zip(*_edges(keys), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in own.column(4).slice(start, stop - start).to_pylist()]
                for i, j in verified_pairs(prints[start:stop], sets, sides[start:stop], similarity, most):
                    a.append(node[start + i])
                    b.append(node[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _edges(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal keys begin and end."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    return starts, [*starts[1:], len(keys)]


def verified(documents: DataFrame, classes: DataFrame, clusters: DataFrame, id_column: str, text_column: str, size: int, similarity: float) -> DataFrame:
    """(a, b long): nodes of the same cluster (id, component) whose whole shingle sets are this similar.

    One document of each class has its text read again; its set goes to the tasks of its cluster's parts and nowhere else.
    """
    members = classes.join(clusters, F.col("node") == F.col("id")).select("node", "wide", "first", F.col("component").alias("cluster"))
    parts = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / CLUSTER, F.sum("first.bytes") / CLUSTER_BYTES)).alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1)))
    members = cut(members.join(parts, "cluster").select("cluster", "parts", "node", "wide", "first"))
    text = as_text(text_column)
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.join(members, rows["doc_id"].eqNullSafe(F.col("first.doc_id")) & (rows["text_hash"] == F.col("first.text_hash"))).select("cluster", "parts", "node", "wide", "text")

    @serving("simhash")
    def run(batches):
        for batch in batches:
            for at, part in chunks(batch.column(4)):
                sets = [shingle_set(t, size).tobytes() for t in part]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in range(4)), pa.array(sets, pa.binary())], ["cluster", "parts", "node", "wide", "shingles"])

    sets = rows.mapInArrow(run, "cluster long, parts long, node long, wide binary, shingles binary")
    dealt = sets.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts"))).select("cluster", "node", "wide", "shingles", F.explode(F.expr(OTHERS)).alias("o"))
    dealt = dealt.select(F.xxhash64("cluster", "o.lo", "o.hi").alias("key"), "node", "wide", F.col("o.side").alias("side"), "shingles")
    return dealt.repartition(F.col("key")).sortWithinPartitions("key", "node").mapInArrow(_verify_run(similarity, limit(similarity)), "a long, b long").filter("a <> b")


def similar(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, similarity: float = 0.8) -> DataFrame:
    """One row per row: doc_id, component_id, linked by the similarity of shingle sets.

    component_id is the least doc_id of the documents linked over any number of links.  Texts of equal wide fingerprints
    are one class.  Null, empty and wordless texts are one class too; a null id gets the least id of its component, if
    that has one.  Repeated rows give a row each; an empty table gives none; other columns are not read.  Ids have to be smaller
    than 2**62.
    """
    prints = cut(wide_prints(documents, id_column, text_column, size))
    classes = prints.groupBy("wide").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "bytes")).alias("first"), F.count("*").alias("n"))
    node = F.coalesce("first.doc_id", F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("wide"), 3))
    classes = cut(classes.select("wide", "first", "n", node.alias("node")))
    clusters = components(cut(close_links(classes, classes.count(), similarity)))
    joined = components(cut(verified(documents, classes, clusters, id_column, text_column, size, similarity)))
    ids = cut(classes.join(joined, F.col("node") == F.col("id"), "left").select("wide", "n", _named(F.coalesce("component", "node")).alias("component_id")))
    total = ids.agg(F.sum("n")).collect()[0][0] or 0
    return spread_join(prints.select("doc_id", "wide"), ids, "wide", total).select("doc_id", "component_id")


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, similarity: float = 0.8) -> DataFrame:
    """The documents with the least id of each group of ``similar`` ones, with all their columns.

    Rows that repeat an id are one document: all of them stay or go.
    """
    groups = similar(documents, id_column, text_column, size, similarity)
    chosen = fresh("_chosen", documents.columns)
    groups = groups.groupBy("component_id").count().select(F.col("component_id").alias(chosen))
    return documents.join(groups, F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col(chosen)), "left_semi")
