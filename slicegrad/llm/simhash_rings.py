"""Near-duplicate groups by SimHash fingerprints, with pigeonring filtering.

A fingerprint is cut into ``SEGMENTS`` segments on a ring. If two fingerprints differ in at most ``t`` bits, there is a
segment from which every chain of the next ``l`` segments differs in at most ``l * t / SEGMENTS`` bits. With two bits
and six segments the budgets are 0, 0, 1, 1, 1, 2: two neighbouring segments agree, and so do all but one of the next
three. Each such choice of four segments is a join key of about 42 bits; a pair that meets is tested for a chain within
all budgets, and only then for its full distance.

Exact copies and texts of equal fingerprints are one class from the start, so a group of copies of any size is one
row in the join. Links join classes; components are found by alternating stars, which need about log(size) rounds, and
every round is written to the shared folder.

Defined results: a null or empty text has fingerprint zero, which links like any other; repeated rows stay and share
a component; the component id is the smallest id reachable, null only if all ids there are null; an empty table
gives an empty result. Other columns are ignored. Texts of any length are fingerprinted whole, in pieces.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicegrad.llm.common import drop_saved, fresh, saved, text_of
from slicegrad.session import bounded_broadcast

BITS = 64
SEGMENTS = 6
#: Shingles whose bits are counted at once.
PIECE = 1 << 15


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of big-endian 64-bit lanes, the highest bit of the first lane first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1)
    counts = np.zeros(bits.shape[1], np.int64)
    for k in range(0, len(bits), 255):  # as many rows as a byte can count
        counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return counts


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits that over half of the XXH64 hashes (seed 42) of a text's word shingles have set; zero without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[min(shingle, len(words)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    starts = starts[:n].tolist()
    for k in range(0, n, PIECE):
        hashes = np.array([hash_of(line[a:b], 42) for a, b in zip(starts[k : k + PIECE], ends[k : k + PIECE])], ">u8")
        counts += set_bits(hashes.reshape(-1, 1))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(shingle, batches):
    for batch in batches:
        prints = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints, pa.int64())], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fp`` of every document; the fingerprint as a signed 64-bit number."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(lambda batches: _fingerprints(shingle, batches), f"key {kind}, fp long")


# -- pigeonring join -----------------------------------------------------------------------------------------------


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Masks of segments of nearly equal width, as unsigned numbers."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def chain_budgets(distance: int, segments: int = SEGMENTS) -> list[int]:
    """Bits in which a chain of 1, 2, ... segments may differ."""
    return [length * distance // segments for length in range(1, segments + 1)]


def key_masks(distance: int, segments: int = SEGMENTS) -> list[int]:
    """Distinct masks of the segments that agree in a chain: those without budget, and all but one of those with one."""
    budgets, masks = chain_budgets(distance, segments), segment_masks(segments)
    exact, loose = budgets.count(0), budgets.count(1)
    if not exact:
        raise ValueError("use more segments than bits of distance")
    found = set()
    for start in range(segments):
        ring = [masks[(start + k) % segments] for k in range(exact + loose)]
        for some in combinations(ring[exact:], max(loose - 1, 0)):
            found.add(sum(ring[:exact]) + sum(some))
    return sorted(found)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def in_ring(diff: Column, distance: int, segments: int = SEGMENTS) -> Column:
    """True if some start has all chains within their budgets; ``diff`` is the exclusive or of two fingerprints."""
    budgets, masks = chain_budgets(distance, segments), segment_masks(segments)
    starts = []
    for start in range(segments):
        chain, tests = 0, []
        for length in range(segments):
            chain |= masks[(start + length) % segments]
            tests.append(F.bit_count(diff.bitwiseAND(F.lit(_signed(chain)))) <= budgets[length])
        starts.append(reduce(Column.__and__, tests))
    return reduce(Column.__or__, starts)


def ring_links(classes: DataFrame, distance: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """``a, b`` (a < b): all pairs of distinct fingerprints in ``classes.fp`` that differ in at most ``distance`` bits."""
    masks = F.array(*[F.lit(_signed(m)) for m in key_masks(distance, segments)])
    signed = classes.select("fp", F.posexplode(masks).alias("mask_no", "mask"))
    signed = signed.select("fp", "mask_no", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    left, right = signed.withColumnRenamed("fp", "a"), signed.withColumnRenamed("fp", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & in_ring(diff, distance, segments) & (F.bit_count(diff) <= distance)
    pairs = left.join(right, (left.mask_no == right.mask_no) & (left.part == right.part) & near)
    return pairs.select("a", "b").dropDuplicates()


# -- components ----------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable over ``links(a, b)``, for every node with a link.

    Large stars hang a node's greater neighbours on its smallest one; small stars hang the smaller neighbours and the
    node itself there. Both are joins with a minimum per node, which is combined per task first.
    """
    spark = links.sparkSession
    edges, path = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least, least_path = saved(least, "least")  # as plain tables both sides can be split where a star is large
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = saved(large.filter("u <> v").dropDuplicates(), "large-star")
        lower, lower_path = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").union(lower.select("u", F.col("m").alias("v"))).dropDuplicates()
        small, small_path = saved(small, "small-star")
        drop_saved(spark, path, least_path, large_path, lower_path)
        edges, path = small, small_path
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    own = roots.select(F.col("root").alias("node"), "root").dropDuplicates()
    return roots.select(F.col("u").alias("node"), "root").union(own)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``key, fp, component_id``, one row per document."""
    prints, _ = saved(fingerprints(docs, key, text, shingle), "prints")
    classes, classes_path = saved(prints.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    groups, groups_path = saved(components(ring_links(classes, distance)), "groups")
    rooted = classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids, ids_path = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")  # a table: a large group's rows can be split
    labels, _ = saved(rooted.join(ids, "root").select("fp", "component_id"), "labels")
    drop_saved(docs.sparkSession, classes_path, groups_path, ids_path)
    return prints.join(labels, "fp").select("key", "fp", "component_id")


# -- copies with more changes --------------------------------------------------------------------------------------

#: Least hashes in the sketch of a set of shingles, and how they form bands. Sets that are ``ALIKE`` miss all bands with
#: a chance of (1 - 0.8 ** 3) ** 21 = 3e-7.
SKETCH = 64
BANDS = 21
BAND_ROWS = 3
#: Share of equal bytes between sketches from which two sets may be alike; below it are under 7e-7 of the sets of 0.8.
LIKELY = 0.5
#: Jaccard similarity of copies, as numerator and denominator.
ALIKE = (4, 5)
#: Buckets up to this size are compared by offsets, larger ones by a search that shrinks as it finds copies.
SMALL_BUCKET = 32
#: Rows of a bucket that one task compares; larger buckets are cut into blocks, and each two blocks meet in a task.
BLOCK = 50_000
#: The same for texts that are compared in full, with a bound for their bytes.
TEXT_BLOCK = 200
TEXT_BLOCK_BYTES = 4 << 20
SPREAD = np.random.default_rng(7).integers(1 << 62, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct XXH64 hashes (seed 42) of a text's word shingles, ascending; a text of fewer words is one shingle."""
    import xxhash

    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    line, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[min(shingle, len(words)) - 1 :].tolist() if n else []
    return np.unique(np.array([hash_of(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends)], np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of ``SKETCH`` hash functions; two sets agree in a place with chance Jaccard."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 2048):
        h = hashes[k : k + 2048] * SPREAD[:, None]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, h.min(1), out=least)
    return least


def _sketches(shingle, batches):
    import xxhash

    for batch in batches:
        nodes, prints, least = [], [], np.zeros((batch.num_rows, SKETCH), np.uint64)
        for k, text in enumerate(batch.column("text")):
            text = text.as_buffer().to_pybytes()
            prints.append(fingerprint(text))
            hashes = shingle_set(text, shingle)
            nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
            least[k] = sketch(hashes)
        lanes = ((least >> np.uint64(16)) & np.uint64(255)).astype(np.uint8).view(np.int64)
        parts = np.zeros((batch.num_rows, BANDS), np.uint64)
        for k in range(BAND_ROWS):
            parts = (parts ^ least[:, k : BANDS * BAND_ROWS : BAND_ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            parts ^= parts >> np.uint64(32)
        cells = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (lanes, parts)]
        columns = [*(batch.column(c) for c in ("key", "k1", "k2")), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), *cells]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "k1", "k2", "node", "fp", "lanes", "parts"])


def near(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which sketches may be of sets as alike as one (or as that of the row beside, for equal shapes)."""
    equal = one.view(np.uint8) == many.view(np.uint8)
    return np.count_nonzero(equal, axis=1) >= LIKELY * equal.shape[1]


def bucket_links(buckets: np.ndarray, nodes: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Links that connect the copies in each bucket; rows of a bucket are neighbours, whole buckets only."""
    found = []
    first = np.flatnonzero(np.diff(buckets, prepend=buckets[:1] - 1)) if len(buckets) else np.zeros(0, np.int64)
    sizes = np.diff(first, append=len(buckets))
    small = np.flatnonzero(np.repeat(sizes <= SMALL_BUCKET, sizes) & np.repeat(sizes > 1, sizes))
    for offset in range(1, SMALL_BUCKET):
        small = small[small + offset < len(buckets)]
        small = small[buckets[small] == buckets[small + offset]]
        if not len(small):
            break
        hit = small[near(lanes[small], lanes[small + offset])]
        found.append(np.stack([nodes[hit], nodes[hit + offset]], 1))
    for k in np.flatnonzero(sizes > SMALL_BUCKET):
        left = np.arange(first[k], first[k] + sizes[k])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                row = queue.pop()
                hit = near(lanes[row], lanes[left])
                copies, left = left[hit], left[~hit]
                found.append(np.stack([np.full(len(copies), nodes[row]), nodes[copies]], 1))
                queue.extend(copies.tolist())
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _links(batches):
    """Rows arrive sorted by bucket; a bucket that a batch cuts waits for the rest."""
    import itertools

    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            lanes = batch.column("lanes").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 8)
            rows = [np.stack([batch.column(c).to_numpy() for c in ("seg", "part", "pair")], 1), batch.column("node").to_numpy(), lanes]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if not len(held[1]):
                continue
        if held is None:
            return
        keys = held[0]
        new = np.any(keys[1:] != keys[:-1], axis=1) if len(keys) > 1 else np.zeros(0, bool)
        bucket = np.concatenate([[0], np.cumsum(new)])[: len(keys)]
        stop = len(keys) if batch is None else int(np.searchsorted(bucket, bucket[-1]))
        links = bucket_links(bucket[:stop], held[1][:stop], held[2][:stop])
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
        held = [x[stop:] for x in held]


def print_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b``: links that connect the nodes of ``prints(node, fp)`` whose fingerprints differ in at most ``distance`` bits.

    Nodes of equal fingerprints hang on the least of them, and the least ones of fingerprints in a ring are linked, so a
    fingerprint that many texts share is one row in the ring join.
    """
    firsts, _ = saved(prints.groupBy("fp").agg(F.min("node").alias("first")), "firsts")  # a table: rows of a frequent fingerprint can be split
    same = prints.select("node", "fp").dropDuplicates().join(firsts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ring = ring_links(firsts, distance)
    for end in ("a", "b"):
        ring = ring.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    return same.union(ring.select("a_node", "b_node")).filter("a <> b").dropDuplicates()


def copy_links(classes: DataFrame) -> DataFrame:
    """``a, b``: links that connect all likely copies among ``classes(node, lanes, parts)`` which share a band.

    A row goes to one bucket per band. Within a bucket only links that join something new are kept, so a large group
    of copies gives about one link per copy and bucket, not one per pair.
    """
    spark = classes.sparkSession
    rows = classes.select("node", "lanes", F.posexplode("parts").alias("seg", "part"))
    sizes, sizes_path = saved(rows.groupBy("seg", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "large-buckets")
    n_large = sizes.count()
    if n_large:
        cut = rows.join(bounded_broadcast(sizes, n_large, 3), ["seg", "part"], "left")
        blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
        mine = F.pmod(F.col("node"), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        cut = cut.select("node", "lanes", "seg", "part", mine.alias("mine"), blocks.alias("blocks"), other.alias("other"))
        pair = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
        rows = cut.select("node", "lanes", "seg", "part", pair.alias("pair"))
    else:
        rows = rows.withColumn("pair", F.lit(0))
    ints = [F.col(c).cast("long") for c in ("seg", "part", "pair")]
    placed = rows.select("node", "lanes", *ints).repartition("seg", "part", "pair").sortWithinPartitions("seg", "part", "pair")
    links, _ = saved(placed.mapInArrow(_links, "a long, b long").dropDuplicates(), "links")
    drop_saved(spark, sizes_path)
    return links


def alike_links(nodes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Links that connect the sets whose Jaccard similarity is at least ``ALIKE``."""
    found, sizes = [np.zeros((0, 2), np.int64)], np.array([len(s) for s in sets], np.int64)
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(sum(map(len, sets)), np.uint8)
    live = np.ones(len(sets), bool)  # not reached yet
    rows = np.flatnonzero(sizes)  # empty sets are equal, and so one class already
    for first in rows.tolist():
        if not live[first]:
            continue
        live[first], queue = False, [first]
        while queue:
            row = queue.pop()
            rows = rows[live[rows]]
            fits = (ALIKE[0] * sizes[rows] <= ALIKE[1] * sizes[row]) & (ALIKE[0] * sizes[row] <= ALIKE[1] * sizes[rows])
            others = rows[fits]
            if not len(others):
                continue
            mark[codes[row]] = 1
            starts = np.cumsum(sizes[others]) - sizes[others]
            both = np.add.reduceat(mark[np.concatenate([codes[k] for k in others])], starts, dtype=np.int64)
            mark[codes[row]] = 0
            hit = others[ALIKE[1] * both >= ALIKE[0] * (sizes[row] + sizes[others] - both)]
            live[hit] = False
            found.append(np.stack([np.full(len(hit), nodes[row]), nodes[hit]], 1))
            queue.extend(hit.tolist())
    return np.concatenate(found)


def _alike(shingle, batches):
    """Rows arrive sorted by group and pair of blocks; a unit that a batch cuts waits for the rest."""
    import itertools

    unit, nodes, sets = None, [], []
    for batch in itertools.chain(batches, [None]):
        rows = zip(*(batch.column(c).to_pylist() for c in ("root", "pair", "node")), batch.column("text")) if batch is not None else [(None,) * 4]
        for root, pair, node, text in rows:
            if (root, pair) != unit and sets:
                links = alike_links(np.array(nodes, np.int64), sets)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
                nodes, sets = [], []
            if text is not None:
                unit = (root, pair)
                nodes.append(node), sets.append(shingle_set(text.as_buffer().to_pybytes(), shingle))


def _beside(shingle, batches):
    """Whether each text is a copy of the first of its group."""
    last, first = None, None
    for batch in batches:
        close = []
        for text, beside in zip(batch.column("text"), batch.column("first")):
            beside = beside.as_buffer().to_pybytes()
            if beside != last:
                last, first = beside, shingle_set(beside, shingle)
            own = shingle_set(text.as_buffer().to_pybytes(), shingle)
            both = len(np.intersect1d(own, first, assume_unique=True))
            close.append(ALIKE[1] * both >= ALIKE[0] * (len(own) + len(first) - both))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "node", "text")), pa.array(close, pa.bool_())], names=["root", "node", "text", "close"])


def exact_links(members: DataFrame, shingle: int) -> DataFrame:
    """``a, b``: links that connect all copies within each group of ``members(root, node, text)``; shingles are compared.

    The text of node ``root`` is compared with all of its group first. Its copies are connected then, and only the rest
    meets all others. If these are many or long, both are cut into blocks, and each two blocks of which one holds a
    part of the rest meet in a task.
    """
    first = members.filter("node = root").select("root", F.col("text").alias("first"))
    checked = members.join(first, "root").mapInArrow(lambda batches: _beside(shingle, batches), "root long, node long, text string, close boolean")
    checked, checked_path = saved(checked, "beside")
    known = checked.filter("close and node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))

    blocks = lambda n, size: F.greatest(F.ceil(n / TEXT_BLOCK), F.ceil(size / TEXT_BLOCK_BYTES)).cast("int")
    size, left = F.octet_length("text"), (~F.col("close")).cast("int")
    totals = [F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.sum(left).alias("n_left"), F.sum(left * size).alias("left_size")]
    groups = checked.groupBy("root").agg(*totals).filter("n_left > 0")
    whole = blocks(F.col("n"), F.col("size")) == 1
    groups = groups.select(
        "root", F.when(whole, 1).otherwise(blocks(F.col("n_left"), F.col("left_size"))).alias("rest"),
        F.when(whole, 0).otherwise(blocks(F.col("n") - F.col("n_left"), F.col("size") - F.col("left_size"))).alias("more"),
    )
    groups, groups_path = saved(groups, "unsettled")
    cut = checked.join(bounded_broadcast(groups, groups.count(), 3), "root")
    late = F.col("close") & (F.col("more") > 0)
    mine = F.when(late, F.col("rest") + F.pmod(F.xxhash64("node"), F.greatest("more", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest")))
    other = F.explode(F.sequence(F.lit(0), F.when(late, F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1))
    cut = cut.select("root", "node", "text", "rest", "more", mine.alias("mine"), other.alias("other"))
    pair = F.least("mine", "other") * (F.col("rest") + F.col("more")) + F.greatest("mine", "other")
    placed = cut.select("root", pair.alias("pair"), "node", "text").repartition("root", "pair").sortWithinPartitions("root", "pair")
    links, _ = saved(placed.mapInArrow(lambda batches: _alike(shingle, batches), "a long, b long").dropDuplicates().union(known), "copies")
    drop_saved(members.sparkSession, groups_path, checked_path)
    return links


def copy_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``key, component_id``: groups of copies whose sets of word shingles have a Jaccard similarity of at least 0.8.

    Candidates are all texts whose SimHash fingerprints lie in a ring, as in :func:`near_duplicates`. Copies of 0.8 can differ
    in some 15 % of a fingerprint's bits, too many for exact segments, so texts that share a band and half of their
    sketches of least hashes are candidates as well: their chance to agree is the similarity itself, whether words were
    exchanged, cut or added. Groups of such links contain all groups of copies; within them the texts are compared by
    their shingles, and only pairs of 0.8 or more stay linked.
    """
    slim = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    slim = slim.withColumn("k1", F.xxhash64("key", "text")).withColumn("k2", F.xxhash64(F.lit(1), "key", "text"))
    kind = slim.schema["key"].dataType.simpleString()
    prints = slim.mapInArrow(lambda batches: _sketches(shingle, batches), f"key {kind}, k1 long, k2 long, node long, fp long, lanes array<long>, parts array<long>")
    prints, _ = saved(prints, "sketches")
    one = [F.min("key").alias("least"), F.min(F.struct("k1", "k2")).alias("row"), F.any_value("lanes").alias("lanes"), F.any_value("parts").alias("parts")]
    classes, classes_path = saved(prints.groupBy("node").agg(*one), "classes")
    likely, likely_path = saved(components(print_links(prints).union(copy_links(classes.select("node", "lanes", "parts")))), "likely")
    chosen = classes.join(likely, "node").select("root", "node", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2"))
    members = slim.select("k1", "k2", "text").join(chosen, ["k1", "k2"]).select("root", "node", "text").dropDuplicates(["node"])
    members, members_path = saved(members, "members")
    groups, groups_path = saved(components(exact_links(members, shingle)), "groups")
    rooted = classes.join(groups, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids, ids_path = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")  # a table: a large group's rows can be split
    labels, _ = saved(rooted.join(ids, "root").select("node", "component_id"), "labels")
    drop_saved(docs.sparkSession, classes_path, likely_path, members_path, groups_path, ids_path)
    return prints.join(labels, "node").select("key", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One document of each group of copies: the one of smallest id (ids before nulls), then of smallest text hash."""
    rank, one, two = fresh(docs, "sg_rank", "sg_k1", "sg_k2")
    own = [F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id")]
    hashes = [F.xxhash64(F.lit(seed), f"`{key}`", f"`{text}`").alias(f"k{seed}") for seed in (1, 2)]
    ranked = docs.withColumn(rank, F.struct(*own, *hashes))
    groups = copy_groups(ranked, key=rank, text=text, shingle=shingle)
    firsts = groups.filter(F.col("key") == F.col("component_id")).groupBy("key.k1", "key.k2").agg(F.count(F.lit(1)).alias("n"))
    firsts, _ = saved(firsts, "firsts")
    k1, k2 = F.col(f"`{rank}`.k1"), F.col(f"`{rank}`.k2")
    kept = ranked.withColumns({one: k1, two: k2}).join(firsts.select(F.col("k1").alias(one), F.col("k2").alias(two)), [one, two], "left_semi")
    if not firsts.filter("n > 1").isEmpty():  # equal rows, of which one stays
        kept = kept.dropDuplicates([one, two])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
