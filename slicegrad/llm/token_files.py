"""Token ids in files of canonical, length-limited Huffman codes.

A corpus is encoded in four steps:

1. every text is tokenised once and its ids are kept in a scratch table, at the end of each task with one row of the
   task's counts;
2. the tasks' counts are summed, so at most one row per vocabulary entry reaches the driver, which builds code lengths
   by package-merge and from them the canonical code;
3. each document's ids become a byte-aligned bit string; bit strings are range-partitioned by the wanted order, and
   runs of documents are packed into blocks;
4. readers decode blocks independently of each other.

A block carries the bit length of each segment of ``CHECKPOINT`` ids. Their running sum gives the bit offset of
every checkpoint, so a block's segments are decoded side by side: one table look-up per step gives the next id of
all segments at once.

Defined results: a null text counts as empty and holds only the end id; repeated rows and rows without an id are
kept, one by one (nulls first, as Spark sorts); an empty table gives an empty corpus; other columns are ignored.
A text of any length is encoded whole.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicegrad.llm.common import drop_saved, process_memory, saved, shuffle_width, text_of
from slicegrad.session import bounded_broadcast, scratch_path

#: Longest code in bits; the decoding table has two to this power entries.
MAX_BITS = 20
#: Ids between two bit-offset checkpoints.
CHECKPOINT = 256
#: Ids after which a block is closed; a document is never cut.
BLOCK_IDS = 1 << 20
#: Ids that one range partition should hold.
PARTITION_IDS = 64 << 20
#: Bytes of text that are tokenised as one array; a longer text makes one by itself.
SLICE_BYTES = 4 << 20
#: Remembered pieces of words per worker; beyond, the memory starts anew.
MEMORY = 250_000
#: Letters and number signs below U+0250, as the tokenizer's pattern sees them.
LETTERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
NUMBERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
#: How the tokenizer cuts a lower-cased word: contractions, runs of letters, single digits, runs of anything else.
PIECES = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+)"
#: Anything but printable Latin characters, which have no other normal form; the dotted capital I lower-cases to two.
NOT_LATIN = "[^!-~\u00a1-\u012f\u0131-\u017f]"
#: Texts with separators that are white space to Arrow alone or to the library alone, or with a special token.
STRANGE = "[\x1c-\x1f\x85\u180e\u200b]|<\\|"


# -- tokenising ----------------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts by a tokenizer that never joins two words, with a memory of the pieces of words it has met.

    It holds for tokenizers that lower-case, drop white space, cut words into contractions, runs of letters, single
    digits and runs of anything else, and mark the last id of each such piece. The distinct words of a batch are cut
    and looked up once; new pieces are encoded by the library as one text, whose ids the end marks part again. Words
    beyond the Latin letters go to the library one by one, and whole texts do where it and Arrow disagree about white
    space or a special token may occur.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix:
            raise ValueError("the tokenizer does not mark the ends of words")
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look(self, piece: str) -> bytes | None:
        found = self.young.get(piece)
        if found is None and (found := self.old.get(piece)) is not None:
            self.young[piece] = found
        return found

    def learn(self, pieces: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(pieces):
            raise ValueError("the tokenizer cuts words in another way than expected")
        data, start = ids.tobytes(), 0
        for piece, stop in zip(pieces, (cuts * 4).tolist()):
            self.young[piece] = data[start:stop]
            start = stop

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of these distinct lower-cased pieces."""
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
        found = [self.look(p) for p in pieces]
        new = [p for p, f in zip(pieces, found) if f is None]
        for k in range(0, len(new), 8192):
            self.learn(new[k : k + 8192])
        return [self.young[p] if f is None else f for p, f in zip(pieces, found)]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of these distinct words, one after the other, and how many each has."""
        odd = pc.match_substring_regex(words, NOT_LATIN)
        cut = pc.replace_substring_regex(pc.utf8_lower(words), PIECES, "\\1 ")
        lists = pc.split_pattern(pc.if_else(odd, " ", cut), " ")  # the last part of each is empty
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        blank = pieces.index("")
        pieces[blank] = "x"
        ids = self.ids_of(pieces)
        ids[blank] = b""
        flat, sizes = gather(ids, coded.indices.to_numpy())
        ends = np.cumsum(sizes)[lists.offsets.to_numpy()[1:] - 1]
        counts = np.diff(ends, prepend=0)
        if pc.any(odd).as_py():
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            whole = self.whole(words.take(pa.array(at)).to_pylist())
            flat = np.insert(flat, np.repeat(ends[at], [len(x) // 4 for x in whole]), np.frombuffer(b"".join(whole), "<u4"))
            counts[at] = [len(x) // 4 for x in whole]
        return flat, counts

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end_id``, and how many each text has."""
        strange = pc.match_substring_regex(texts, STRANGE)
        if pc.any(strange).as_py():  # encoded whole; the rest of the batch goes on as usual
            flags = strange.to_numpy(zero_copy_only=False)
            rest, sizes = self(texts.filter(pc.invert(strange)), end_id)
            rest = np.split(rest, np.cumsum(sizes)[:-1])
            done = iter(rest if len(sizes) else [])
            whole = iter(self.whole(texts.filter(strange).to_pylist()))
            made = [np.append(np.frombuffer(next(whole), "<u4"), np.uint32(end_id)) if f else next(done) for f in flags]
            return np.concatenate(made), np.array([len(x) for x in made])
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()  # an empty word stands beside leading and trailing white space
        table, size_of = self.words(coded.dictionary)
        table, size_of = np.append(table, np.uint32(end_id)), np.append(size_of, 1)
        ends = lists.offsets.to_numpy()[1:]
        index = np.insert(coded.indices.to_numpy(), ends, len(size_of) - 1)
        flat, sizes = take_runs(table, size_of, index)
        return flat, np.diff(np.cumsum(sizes)[ends + np.arange(len(ends))], prepend=0)


def take_runs(table: np.ndarray, size_of: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table`` with these numbers, one after the other, and their sizes."""
    start_of = np.cumsum(size_of) - size_of
    sizes = size_of[index]
    stops = np.cumsum(sizes)
    shift = (start_of[index] - (stops - sizes)).astype(np.int32)
    at = np.repeat(shift, sizes)
    at += np.arange(len(at), dtype=np.int32)
    return table[at], sizes


def gather(runs: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return take_runs(np.frombuffer(b"".join(runs), "<u4"), np.array([len(x) // 4 for x in runs]), index)


def _tokenize(path: str, end_id: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    encoder = process_memory().get(path) or WordEncoder(path)
    process_memory()[path] = encoder  # a worker process remembers its words from task to task
    total = np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch):
            ids, sizes = encoder(part.column(part.num_columns - 1), end_id)
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            columns += [pa.array(sizes, pa.int64()), binary_slices(ids.astype("<u4", copy=False), sizes)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
    met = np.flatnonzero(total)
    counts = np.stack([met, total[met]], 1).astype("<i8").tobytes()
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema)][:-1] + [pa.array([counts], pa.binary())], schema=schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE_BYTES`` of text each, which is its last column."""
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy().astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def binary_slices(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as binary cells, without a copy for each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])


def tokenized(docs: DataFrame, keys: list[str], text: str, path: str, end_id: int) -> DataFrame:
    """``keys``, ``n_ids`` and ``ids`` (little-endian 32-bit integers) of each document, the end id included.

    A row without ``n_ids`` holds a task's counts instead, as pairs of an id and its count.
    """
    slim = docs.select(*[F.col(f"`{k}`") for k in keys], text_of(text).alias("text"))
    own = [T.StructField(f.name, f.dataType) for f in slim.schema.fields[:-1]]  # null in rows of counts
    out = T.StructType([*own, T.StructField("n_ids", T.LongType()), T.StructField("ids", T.BinaryType())])
    return slim.mapInArrow(partial(_tokenize, path, end_id, _arrow(out)), out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# -- the code ------------------------------------------------------------------------------------------------------


def count_ids(tokens: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs, from the counts of the tasks that made ``tokens``."""

    def pairs(batches):
        for batch in batches:
            for cell in batch.column(0):
                found = np.frombuffer(cell.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["id", "n"])

    counts = tokens.filter("n_ids is null").select("ids")
    return counts.mapInArrow(pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for symbols with these positive counts (package-merge).

    Each level holds the symbols and the packages of two neighbours of the level below, sorted by weight. A symbol's
    length is the number of levels in which it lies among the items taken.
    """
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit into codes of {max_bits} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    levels, items = [], weights
    for _ in range(max_bits):
        levels.append(items)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        where = np.searchsorted(weights, pairs, side="right")
        items = np.insert(weights, where, pairs)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in range(max_bits - 1, -1, -1):
        if level:
            below = levels[level - 1]
            pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
            at = np.searchsorted(weights, pairs, side="right") + np.arange(len(pairs))
            packages = int((at < take).sum())
        else:
            packages = 0
        lengths[: take - packages] += 1
        take = 2 * packages
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol): each is its predecessor plus one, shifted to its own length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    steps = np.left_shift(np.int64(1), int(lengths.max(initial=1)) - lengths[order])
    left = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(order) else np.zeros(0, np.int64)
    codes = np.empty(len(lengths), np.int64)
    codes[order] = left >> (int(lengths.max(initial=1)) - lengths[order])
    return codes


class Codebook:
    """Symbols with their code lengths; encodes and decodes arrays of ids."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols = np.asarray(symbols, np.int64)
        self.lengths = np.asarray(lengths, np.int64)
        self._made = False

    def _tables(self):
        if self._made:
            return
        size = int(self.symbols.max(initial=0)) + 1
        self.code_of, self.bits_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes = canonical_codes(self.lengths)
        self.code_of[self.symbols], self.bits_of[self.symbols] = codes.astype(np.uint64), self.lengths
        self.width = int(self.lengths.max(initial=1))
        order = np.lexsort((self.symbols, self.lengths))
        spans = np.left_shift(1, self.width - self.lengths[order])
        self.symbol_at = np.zeros(1 << self.width, np.uint32)
        self.bits_at = np.ones(1 << self.width, np.uint8)
        self.symbol_at[: spans.sum()] = np.repeat(self.symbols[order], spans)
        self.bits_at[: spans.sum()] = np.repeat(self.lengths[order], spans)
        self._made = True

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Bit strings of runs of ``ids`` of these positive sizes, each from a whole byte on.

        Returns the bytes, the bytes of each run, the bits of each ``CHECKPOINT`` ids of a run, and how many of those
        a run has.
        """
        self._tables()
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        last = np.cumsum(sizes) - 1
        run_bits = np.diff(ends[last], prepend=0)
        run_bytes = -(-run_bits // 8)
        gap = np.cumsum(run_bytes) * 8 - ends[last]  # bits of padding up to the end of each run
        starts = ends - bits + np.repeat(np.concatenate([[0], gap[:-1]]), sizes)
        word, room = starts >> 6, 64 - (starts & 63) - bits
        code = self.code_of[ids]
        head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        words = np.zeros(int(run_bytes.sum()) // 8 + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(room < 0)  # a code that goes on in the next word; at most one per word
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        per_run = -(-sizes // CHECKPOINT)
        inner = np.arange(per_run.sum()) - np.repeat(np.cumsum(per_run) - per_run, per_run)
        segments = np.add.reduceat(bits, np.repeat(last + 1 - sizes, per_run) + inner * CHECKPOINT)
        return words.astype(">u8").tobytes()[: int(run_bytes.sum())], run_bytes, segments.astype("<u2"), per_run

    def decode(self, payload: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of the segments that start at these bits and hold so many ids, one after the other."""
        self._tables()
        data = np.frombuffer(payload + bytes(8), np.uint8)
        order = np.argsort(-counts, kind="stable")
        at, left = starts[order].astype(np.int64), counts[order]
        place = (np.cumsum(counts) - counts)[order]
        out = np.empty(int(counts.sum()), np.uint32)
        shift, mask = 32 - self.width, (1 << self.width) - 1
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, side="left"))
            if live < len(at):
                at, left, place = at[:live], left[:live], place[:live]
            byte, bit = at >> 3, at & 7
            window = (
                (data[byte].astype(np.int64) << 24) | (data[byte + 1].astype(np.int64) << 16)
                | (data[byte + 2].astype(np.int64) << 8) | data[byte + 3]
            )
            key = (window >> (shift - bit)) & mask
            out[place + step] = self.symbol_at[key]
            at = at + self.bits_at[key]
        return out


def build_codebook(counts: DataFrame, max_bits: int = MAX_BITS) -> tuple[Codebook, int]:
    """The code for these global counts, and their sum; the table has one row per vocabulary entry at most."""
    rows = counts.toArrow().sort_by("id")
    symbols, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    return Codebook(symbols, code_lengths(n, max_bits)), int(n.sum())


# -- files ---------------------------------------------------------------------------------------------------------


def _encode(book: Codebook, schema: pa.Schema, batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            sizes = part.column("n_ids").to_numpy()
            data, run_bytes, segments, per_run = book.encode(np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u4"), sizes)
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            columns += [binary_slices(np.frombuffer(data, np.uint8), run_bytes), binary_slices(segments, per_run)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _pack(schema: pa.Schema, block_ids: int, batches):
    """Sorted documents of one range partition to blocks; ``first_id`` counts within the partition."""
    part = TaskContext.get().partitionId()
    block, first, keys, sizes, bits, segments = 0, 0, [], [], [], []

    def close():
        row = [part, block, first, sum(sizes), keys, sizes, b"".join(segments), b"".join(bits)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    held = 0
    for batch in batches:
        for key, n, b, s in zip(*(c.to_pylist() for c in batch.columns)):
            keys.append(key), sizes.append(n), bits.append(b), segments.append(s)
            held += n
            if held >= block_ids:
                yield close()
                block, first, held = block + 1, first + held, 0
                keys, sizes, bits, segments = [], [], [], []
    if keys:
        yield close()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", order_by: list[str] | None = None,
    end_id: int = 1, max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS, partition_ids: int = PARTITION_IDS,
) -> None:
    """Encode whole texts in ascending order of ``order_by`` (default: the key) under ``path``.

    ``path/codebook`` holds ``id, bits``; ``path/blocks`` one row per block: ``part, block, first_id, n_ids``, the keys
    and id counts of its documents, the checkpoints' bit lengths and the payload.
    """
    spark = docs.sparkSession
    order = order_by or [key]
    carried = list(dict.fromkeys([key, *order]))
    tokens, tokens_path = saved(tokenized(docs, carried, text, tokenizer, end_id), "ids", compression="zstd")
    book, total = build_codebook(count_ids(tokens), max_bits)
    tokens = tokens.filter("n_ids is not null")
    symbols = [(int(s), int(b)) for s, b in zip(book.symbols, book.lengths)]
    spark.createDataFrame(symbols, "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")

    fields = tokens.schema.fields
    coded = T.StructType([*fields[:-1], T.StructField("payload", T.BinaryType()), T.StructField("segments", T.BinaryType())])
    # written before it is sorted: finding the ranges reads its input once more
    encoded, encoded_path = saved(tokens.mapInArrow(partial(_encode, book, _arrow(coded)), coded), "codes", compression="uncompressed")
    drop_saved(spark, tokens_path)
    parts = shuffle_width(spark, total, partition_ids)
    ordered = encoded.repartitionByRange(parts, *[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    kind = tokens.schema[key].dataType
    blocks = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("first_id", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("segments", T.BinaryType()), T.StructField("payload", T.BinaryType()),
    ])
    packed = ordered.select(F.col(f"`{key}`"), "n_ids", "payload", "segments").mapInArrow(partial(_pack, _arrow(blocks), block_ids), blocks)
    packed.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_saved(spark, encoded_path)


def decode_block(book: Codebook, sizes: np.ndarray, segments: bytes, payload: bytes) -> np.ndarray:
    """All ids of a block, from the checkpoints' bit lengths; each document starts at a whole byte."""
    bits = np.frombuffer(segments, "<u2").astype(np.int64)
    per_doc = -(-sizes // CHECKPOINT)
    last = np.cumsum(per_doc)
    doc_bits = np.add.reduceat(bits, last - per_doc)
    doc_start = np.concatenate([[0], np.cumsum(-(-doc_bits // 8) * 8)[:-1]])
    inner = np.cumsum(bits) - bits
    starts = inner - np.repeat(inner[last - per_doc], per_doc) + np.repeat(doc_start, per_doc)
    counts = np.full(len(bits), CHECKPOINT, np.int64)
    counts[last - 1] = sizes - (per_doc - 1) * CHECKPOINT
    return book.decode(payload, starts, counts)


def read_token_files(spark: SparkSession, path: str, make: Callable[[np.ndarray], object], column: str, kind: T.DataType) -> DataFrame:
    """``key, start, n_ids`` and ``make(ids)`` of each document, decoded block by block.

    ``start`` counts the ids of all documents before this one in the order of the files.
    """
    table = spark.read.parquet(f"{path}/codebook").orderBy("id").toArrow()  # a row per vocabulary entry at most
    book = Codebook(table.column("id").to_numpy(), table.column("bits").to_numpy())
    blocks = spark.read.parquet(f"{path}/blocks")
    out = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("key", blocks.schema["keys"].dataType.elementType),
        T.StructField("first_id", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField(column, kind),
    ])

    def decode(schema, batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, keys, sizes, segments, payload = (batch.column(i)[row] for i in range(6))
                sizes = np.array(sizes.as_py(), np.int64)
                ids = decode_block(book, sizes, segments.as_py(), payload.as_py())
                ends = np.cumsum(sizes)
                made = [make(ids[a:b]) for a, b in zip(ends - sizes, ends)]
                cells = [pa.array(np.full(len(sizes), part.as_py())), keys.values, pa.array(ends - sizes + first.as_py()), pa.array(sizes), pa.array(made, schema.field(4).type)]
                yield pa.RecordBatch.from_arrays(cells, schema=schema)

    rows = blocks.select("part", "first_id", "keys", "sizes", "segments", "payload").mapInArrow(partial(decode, _arrow(out)), out)
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = bounded_broadcast(offsets, per_part.count(), 2)  # a row per range partition
    return rows.join(offsets, "part").select("key", (F.col("first_id") + F.col("offset")).alias("start"), "n_ids", column)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_file_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the corpus into the scratch folder, read the files back, and describe each document as read."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(spark, path, crc_of_ids, "ids_crc32", T.LongType())
