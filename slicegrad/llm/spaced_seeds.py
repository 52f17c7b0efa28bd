"""Benchmark decontamination with spaced seeds: overlaps are found although some words were exchanged.

A seed is a window of up to ``SPAN`` words of which a fixed mask looks at some positions and ignores the rest. All windows
of the benchmark and of the documents are hashed under each mask. A filter of the benchmark's hashes, of bounded size,
travels to the documents, so that only documents with a likely hit go on; their hashes are joined with the
benchmark's. A joined pair names a document, an item and the offset between them. On that diagonal all words are
compared: the best stretch with one point for an equal word and two off for another is the overlap, and a pair counts
if its stretch holds enough equal words. Nothing depends on the filter but the number of rows shuffled.

Words are runs of other than ASCII white space, lower-cased and stripped of signs at both ends. The masks are a cover:
whichever words of a stretch are exchanged, if it counts then one of its windows has a seed. Items of five and six words
have masks of their own; an item below ``MIN_WORDS`` words is found as a whole only, in a document of the same words.

Defined results: null and empty texts match nothing; repeated rows give one result per id and item; a null id is kept
as null; empty tables give an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.llm.common import fresh, saved, text_of
from slicegrad.session import bounded_broadcast

#: Fixed masks, each of which looks at six words. Every stretch that ``overlap`` finds with enough equal words, in an item
#: of any length from seven words, has a window in which all words one of them looks at are equal.
MASKS = (
    "11101011", "11100100011", "1101100101", "111001001001", "11011000101", "1101111", "11110011", "11101101", "1110111",
    "111111", "1111101", "1111011",
)
#: The same for shorter items, by their number of words.
SHORT_MASKS = {5: ("1111", "11101", "11011"), 6: ("11111", "111101", "111011", "110111")}
SPAN = 12
#: Items of fewer words are found as whole texts only: a document of the same words.
MIN_WORDS = 5
#: Equal words that the best stretch must hold, and the share of the item that suffices for short items.
MIN_EQUAL = 13
SHORT_SHARE = 0.8
#: Bits of the filter per benchmark hash, and the largest filter; a fuller filter only lets more rows through.
FILTER_BITS_PER_HASH = 1024
MAX_FILTER_BITS = 1 << 27
PROBES = 3

SIGNS = re.compile(r"^[^\w]+|[^\w]+$")
ODD = np.array([int(x) | 1 for x in np.random.default_rng(20).integers(1 << 62, 1 << 63, SPAN)], np.uint64)


class WordHasher:
    """64-bit hashes of normal words, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode().split()
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for word in {w for w in words if w not in known}:
            plain = SIGNS.sub("", word.decode().lower()) or word.decode()
            known[word] = xxhash.xxh64_intdigest(plain.encode(), 7)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def enough(n_words: int) -> int:
    """Equal words with which a stretch counts in an item of so many words."""
    return MIN_EQUAL if n_words >= SPAN + 4 else math.ceil(SHORT_SHARE * n_words)


def seeds(words: np.ndarray, masks: tuple[str, ...]) -> list[tuple[str, np.ndarray]]:
    """Hashes of all windows by mask."""
    out = []
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n > 0:
            total = np.full(n, int("1" + mask, 2), np.uint64)
            for place, looks in enumerate(mask):
                if looks == "1":
                    total += words[place : place + n] * ODD[place]
            out.append((mask, mix(total)))
    return out


def whole_seed(words: np.ndarray) -> np.ndarray:
    """Hash of a text shorter than ``MIN_WORDS``, apart from the hashes of windows."""
    return mix(np.array([np.uint64(len(words)) + (words * ODD[: len(words)]).sum(dtype=np.uint64)]))


def item_seeds(batches, masks):
    hasher = WordHasher()
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("item_key").to_pylist(), batch.column("text").to_pylist()):
            words = hasher(text)
            if not len(words):
                continue
            found = [hashes for _, hashes in seeds(words, SHORT_MASKS.get(len(words), masks))]
            for hashes in found if len(words) >= MIN_WORDS else [whole_seed(words)]:
                rows += [(key, h, p) for p, h in enumerate(hashes.view(np.int64).tolist())]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_key", "hash", "item_at"])


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


def build_filter(spark: SparkSession, table: DataFrame, n_hashes: int) -> np.ndarray:
    """Bloom filter of all benchmark hashes as 64-bit words; at most ``MAX_FILTER_BITS`` bits reach the driver."""
    bits = 1 << max(16, min(MAX_FILTER_BITS, FILTER_BITS_PER_HASH * max(1, n_hashes)).bit_length() - 1)

    def places(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(probes(hashes, bits))) if len(hashes) else np.zeros(0, np.uint64)
            bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["word", "bit"])

    rows = table.select("hash").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def in_filter(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be in the filter."""
    live = np.arange(len(hashes))
    mask = np.uint64(len(flags) * 64 - 1)
    for k in range(PROBES):
        h = hashes[live]
        place = (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & mask
        live = live[(flags[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return live


def _hits(flags, masks, batches):
    """Documents with likely hits; the words of a few hundred documents are hashed as one array."""
    hasher = WordHasher()
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            words = [hasher(t.as_py()) for t in batch.column("text")]
            ends = np.cumsum([len(w) for w in words])
            line = np.concatenate(words)
            room = np.repeat(ends, [len(w) for w in words]) - np.arange(len(line))  # words from here to the document's end
            found, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for mask, hashes in seeds(line, masks):
                live = in_filter(flags, hashes)
                live = live[room[live] >= len(mask)]
                found.append(hashes[live]), at.append(live)
            short = np.flatnonzero([0 < len(w) < MIN_WORDS for w in words])
            if len(short):
                hashes = np.concatenate([whole_seed(words[r]) for r in short])
                live = in_filter(flags, hashes)
                found.append(hashes[live]), at.append(ends[short[live]] - [len(words[r]) for r in short[live]])
            found, at = np.concatenate(found).view(np.int64), np.concatenate(at)
            owner = np.searchsorted(ends, at, side="right")
            order = np.argsort(owner, kind="stable")
            found, at, owner = found[order], at[order], owner[order]
            rows, first = np.unique(owner, return_index=True)
            groups = list(zip(rows.tolist(), np.split(found, first[1:]), np.split(at, first[1:]))) if len(rows) else []
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), kept.column("k1"), kept.column("k2"),
                 pa.array([words[r].astype("<u8").tobytes() for r, _, _ in groups], pa.binary()),
                 pa.array([h for _, h, _ in groups], pa.list_(pa.int64())),
                 pa.array([p - (ends[r] - len(words[r])) for r, _, p in groups], pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "words", "hashes", "places"],
            )


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Equal words, first word in the document and length of the best stretch where item word i meets doc word i + shift."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    equal = doc[low + shift : high + shift] == item[low:high]
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    floor = np.minimum.accumulate(score)
    end = int(np.argmax(score - floor))
    start = int(np.argmin(score[: end + 1]))
    return int(equal[start:end].sum()), low + shift + start, end - start


def _verify(batches):
    for batch in batches:
        docs, items, shifts = (batch.column(c) for c in ("words", "item_words", "shift"))
        rows = []
        for k in range(batch.num_rows):
            doc, item = np.frombuffer(docs[k].as_buffer(), "<u8"), np.frombuffer(items[k].as_buffer(), "<u8")
            equal, start, length = overlap(doc, item, shifts[k].as_py())
            rows.append((equal >= enough(len(item)), equal, start, length))
        good, equal, start, length = zip(*rows) if rows else ([], [], [], [])
        table = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("item_id"), pa.array(equal, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64())],
            names=["doc_id", "item_id", "n_equal", "doc_at", "n_words"],
        )
        yield table.filter(pa.array(good, pa.bool_()))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """``doc_id, item_id, n_equal, doc_at, n_words``: the best overlap of each document and item that share a passage."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item}`").alias("item_id"), text_of(item_text).alias("text")).dropDuplicates()
    items = items.withColumn("item_key", F.xxhash64("item_id", "text"))
    kind = items.schema["item_id"].dataType.simpleString()

    def words_of(batches):
        hasher = WordHasher()
        for batch in batches:
            cells = [hasher(t).astype("<u8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_key"), batch.column("item_id"), pa.array(cells, pa.binary())], names=["item_key", "item_id", "item_words"])

    item_table, _ = saved(items.mapInArrow(words_of, f"item_key long, item_id {kind}, item_words binary"), "items")
    seed_table, _ = saved(items.mapInArrow(lambda b: item_seeds(b, masks), "item_key long, hash long, item_at long"), "seeds")
    n_seeds, n_items = seed_table.count(), item_table.count()
    lengths = item_table.select((F.octet_length("item_words") / 8).cast("int").alias("n")).filter(F.col("n").isin(*SHORT_MASKS))
    used = (*masks, *[m for r in lengths.distinct().toLocalIterator() for m in SHORT_MASKS[r.n]])  # two lengths at most
    flags = spark.sparkContext.broadcast(build_filter(spark, seed_table, n_seeds))  # MAX_FILTER_BITS at most

    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(text).alias("text"))
    slim = slim.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "doc_id", "text"))
    doc_kind = slim.schema["doc_id"].dataType.simpleString()
    likely = slim.mapInArrow(
        lambda b: _hits(flags.value, used, b),
        f"doc_id {doc_kind}, k1 long, k2 long, words binary, hashes array<long>, places array<long>",
    )
    likely, _ = saved(likely, "likely")
    hits = likely.select("k1", "k2", F.explode(F.arrays_zip("hashes", "places")).alias("h"))
    hits = hits.select("k1", "k2", F.col("h.hashes").alias("hash"), F.col("h.places").alias("doc_at"))
    met = hits.join(bounded_broadcast(seed_table, n_seeds, 3), "hash")
    pairs = met.select("k1", "k2", "item_key", (F.col("doc_at") - F.col("item_at")).alias("shift")).dropDuplicates()
    words = likely.select("doc_id", "k1", "k2", "words").dropDuplicates(["k1", "k2"])
    size = item_table.agg(F.coalesce(F.sum(F.octet_length("item_words")), F.lit(0))).first()[0]
    both = pairs.join(words, ["k1", "k2"]).join(bounded_broadcast(item_table, n_items + size // 8, 1), "item_key")
    checked = both.select("doc_id", "item_id", "words", "item_words", "shift").mapInArrow(
        _verify, f"doc_id {doc_kind}, item_id {kind}, n_equal long, doc_at long, n_words long"
    )
    best = F.max(F.struct("n_equal", (-F.col("n_words")).alias("less"), (-F.col("doc_at")).alias("early"))).alias("best")
    found = checked.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", F.col("best.n_equal").alias("n_equal"), (-F.col("best.early")).alias("doc_at"), (-F.col("best.less")).alias("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that share no passage with the benchmark; a hash of id and text tells documents apart."""
    (name,) = fresh(docs, "sg_row")
    hashes = [F.xxhash64(F.lit(seed), f"`{key}`", f"`{text}`").cast("string") for seed in (1, 2)]
    named = docs.withColumn(name, F.concat_ws(":", *hashes))
    found = contaminated(named, benchmark, key=name, text=text, **options)
    dirty, _ = saved(found.select(F.col("doc_id").alias(name)).dropDuplicates(), "dirty")
    return named.join(dirty, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
