"""Phrase mining on a weighted de Bruijn graph of words.

Only the longest phrases are counted in the texts. The words of a piece from each position on, at most ``max_words`` of
them, make an edge from the node of its first ``max_words - 1`` words to that of its last; near the end of a piece they are
fewer, and the edge is a correction that ends at its node. Edges are counted per slice of text and shuffled once, by a hash
of their node: a slice sends each part of the graph one row of sorted lines, which compress well since neighbours share
their words. A part is summed by itself. A shorter phrase then needs no count of its own: its number is the flow out of
its node, that is the sum of all edges and end corrections that begin with it.

Frequent edges form the graph. Chains of nodes with one edge in and one edge out are compacted into paths of words: every
edge points to the edge before it, and pointers are doubled, so after a few rounds each edge knows its chain's first edge
and its place there. A path stops at ``PATH_EDGES``; the edges of a ring, which has no first one, stay single. Candidates of the longest kind, and the best
longer phrase around each node, are read from the paths.

A phrase is scored by its weakest cut, ``1e6 * a * a / (l * r)`` in exact decimals of 38 digits, which hold for counts up
to 10**15.

A node that very many different edges share would overfill its part, so nodes which hold more than a quarter of a part's
share of the edges of a sample are spread by the edges' last words; the sample decides about places only. Scores are ranked within hashed parts of a language first, and only each part's best meet.

Defined results: null texts have no words; a null language is ``und``; repeated rows and ties count one by one; phrases
of equal score and count are ordered by their bytes; an empty table gives no phrases; other columns are ignored; texts
and pieces are read whole.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicegrad.llm.common import drop_saved, saved, shuffle_width, text_of
from slicegrad.session import bounded_broadcast

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: Percent of a phrase's count from which a longer one stands for it.
COVERED = 50
#: Bytes of text counted as one array.
SLICE_BYTES = 3 << 20
#: Bytes of text whose edges are summed as one part.
PART_BYTES = 6 << 20
#: Texts of the sample that finds crowded nodes, the fewest edges there of such a node, and how many are told apart.
SAMPLE_TEXTS, CROWD, MOST_CROWDED = 4000, 100, 50_000
#: Edges of a path, and parts in which a language is ranked.
PATH_EDGES, RANK_PARTS = 4096, 256

CUTS = np.zeros(256, bool)
CUTS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# -- counting edges ------------------------------------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, the text each is from, and a number that changes from piece to piece."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    cut = CUTS[data]
    inner = ~(cut | BLANK[data])
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    bounds = offsets[:-1][np.diff(offsets) > 0]
    begins[bounds] = inner[bounds]  # a text ends the word before it
    starts = np.flatnonzero(begins)
    edges = cut.astype(np.int8)
    edges[bounds] += 1
    piece = np.cumsum(edges, dtype=np.int64)[starts]
    lengths = np.add.reduceat(inner, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inner].tobytes()))
    return words, np.searchsorted(offsets, starts, side="right") - 1, piece


class Edges:
    """The edges of some texts, summed, in order of language and words."""

    def __init__(self, langs: pa.Array, texts: pa.Array, k: int):
        words, text, piece = words_of(texts)
        names, coded = langs.dictionary_encode(), words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        self.names, self.words = names.dictionary, coded.dictionary.take(pa.array(order))
        codes, lang = rank[coded.indices.to_numpy()], names.indices.to_numpy()[text].astype(np.int64)
        key, size, room, columns = lang, max(1, len(self.names)), len(self.words) + 1, []
        for j in range(k):
            code = np.zeros(len(codes), np.int64)
            code[: len(codes) - j] = np.where(piece[j:] == piece[: len(piece) - j], codes[j:], 0)
            columns.append(code)
            if size * room >= 2**62:
                met, key = np.unique(key, return_inverse=True)
                size = len(met)
            key, size = key * room + code, size * room
        _, first, self.n = np.unique(key, return_index=True, return_counts=True)
        self.lang, self.codes = lang[first], [c[first] for c in columns]

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words of the edges with these numbers."""
        taken = [pa.array(c[at] - 1, pa.int32(), mask=c[at] == 0) for c in self.codes]
        return pc.binary_join_element_wise(*[self.words.take(i) for i in taken], " ", null_handling="skip")

    def parts(self, parts: int, crowded: set) -> np.ndarray:
        """The part of each edge: by its node, or by all its words if the node is crowded."""
        import xxhash

        hashed = lambda values: np.array([0, *[xxhash.xxh64_intdigest(v) for v in values.to_pylist()]], np.uint64)
        word = hashed(self.words)
        total = hashed(self.names)[self.lang + 1]
        for code in self.codes[:-1]:
            total = mixed(total + word[code])
        if crowded:
            rows = np.flatnonzero(np.isin(total, np.array(sorted(crowded), np.uint64)))
            total[rows] = mixed(total[rows] + word[self.codes[-1][rows]])
        return (mixed(total) % np.uint64(parts)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def node_hash(lang: str, node: str) -> int:
    """What :meth:`Edges.parts` makes of a node's language and words."""
    import xxhash

    total = np.array([xxhash.xxh64_intdigest(lang)], np.uint64)
    for word in node.split(" "):
        total = mixed(total + np.uint64(xxhash.xxh64_intdigest(word)))
    return int(total[0])


def slices(batch: pa.RecordBatch):
    """The batch in parts of about ``SLICE_BYTES`` of text each."""
    sizes, first = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _rows(k: int, batches):
    for batch in batches:
        for part in slices(batch):
            found = Edges(part.column(0), part.column(1), k)
            yield pa.RecordBatch.from_arrays([found.names.take(pa.array(found.lang)), found.texts(np.arange(len(found.n))), pa.array(found.n)], names=["lang", "words", "n"])


def _lines(k: int, parts: int, crowded: set, batches):
    """``part, lang, lines``: the edges of a slice as sorted lines of words and counts, a row for each part and language."""
    for batch in batches:
        for piece in slices(batch):
            found = Edges(piece.column(0), piece.column(1), k)
            if not len(found.n):
                continue
            part = found.parts(parts, crowded)
            order = np.argsort(part, kind="stable")  # still in order of language and words within a part
            lines = pc.binary_join_element_wise(found.texts(order), pc.cast(pa.array(found.n[order]), pa.string()), "\t")
            lines = pc.binary_join_element_wise(lines, "", "\n")
            part, lang = part[order], found.lang[order]
            first = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
            offsets = np.frombuffer(lines.buffers()[1], np.int32)[: len(lines) + 1]
            cut = np.append(offsets[first], offsets[-1])
            blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut.astype(np.int32)), lines.buffers()[2]])
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), found.names.take(pa.array(lang[first])), blobs], names=["part", "lang", "lines"])
            pa.default_memory_pool().release_unused()


def _head(words: pa.Array) -> pa.Array:
    """Each phrase without its last word."""
    return pc.list_element(pc.split_pattern(words, " ", max_splits=1, reverse=True), 0)


def _grouped(words: list, counts: list) -> tuple[pa.Array, pa.Array]:
    table = pa.table({"words": pa.chunked_array(words, pa.string()), "n": pa.chunked_array(counts, pa.int64())})
    table = table.group_by("words", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    return table["words"].combine_chunks(), table["n_sum"].combine_chunks()


def _summed(k: int, min_count: int, crowded: dict, batches):
    """Rows arrive sorted by part and language; each such group is summed by itself."""
    from pyarrow import csv

    parse = csv.ParseOptions(delimiter="\t", quote_char=False)
    convert = csv.ConvertOptions(column_types={"words": pa.string(), "n": pa.int64()}, strings_can_be_null=False, check_utf8=False)

    def done(lang, held):
        data = b"".join(held)
        held.clear()
        read = csv.ReadOptions(column_names=["words", "n"], use_threads=False, block_size=max(1 << 20, len(data) + 1))
        table = csv.read_csv(pa.BufferReader(data), read, parse, convert).combine_chunks()
        words, n = _grouped([table["words"].combine_chunks()], [table["n"].combine_chunks()])
        size = pc.add(pc.count_substring(words, " "), 1)
        whole = pc.equal(size, k)
        kept = pc.and_(whole, pc.greater_equal(n, min_count))
        out = [(words.filter(kept), n.filter(kept))]
        above, flow = _head(words.filter(whole)), n.filter(whole)  # flows of the nodes, then of their beginnings
        for m in range(k - 1, 0, -1):
            ends = pc.equal(size, m)
            above, flow = _grouped([above, words.filter(ends)], [flow, n.filter(ends)])
            if m == k - 1 and m > 1:  # complete here, but for crowded ones
                kept = pc.greater_equal(flow, min_count)
                if lang in crowded:
                    kept = pc.or_(kept, pc.is_in(above, value_set=pa.array(crowded[lang], pa.string())))
                out.append((above.filter(kept), flow.filter(kept)))
            else:
                out.append((above, flow))
            above = _head(above)
        words, n = (pa.concat_arrays([x[i] for x in out]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, n], names=["lang", "words", "n"])

    unit, held = None, []
    for batch in batches:
        for part, lang, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (part, lang) != unit and held:
                yield done(unit[1], held)
                pa.default_memory_pool().release_unused()
            unit = (part, lang)
            held.append(lines.as_py())
    if held:
        yield done(unit[1], held)


def first_words(words, m: int) -> Column:
    return F.substring_index(words, " ", m)


def last_words(words, m: int) -> Column:
    return F.substring_index(words, " ", -m)


def n_words(words: str = "words") -> Column:
    return F.regexp_count(words, F.lit(" ")) + 1


def edges_of(docs: DataFrame, max_words: int) -> DataFrame:
    """``lang, words, n``: edges of ``docs(lang, text)``, summed per slice of text only."""
    return docs.mapInArrow(partial(_rows, max_words), "lang string, words string, n long")


def crowded_nodes(docs: DataFrame, n_docs: int, parts: int, max_words: int) -> dict[str, list[str]]:
    """By language: nodes with so many different edges that they would crowd a part, by a sample; at most four per part."""
    share = min(1.0, SAMPLE_TEXTS / max(1, n_docs))
    drawn = docs.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    held = edges_of(drawn, max_words).groupBy("lang", first_words("words", max_words - 1).alias("node")).agg(F.count(F.lit(1)).alias("rows"))
    held, path = saved(held, "nodes")
    total = held.agg(F.sum("rows")).first()[0] or 0
    found: dict[str, list[str]] = {}
    for lang, node in held.filter((F.col("rows") * 4 * parts > total) & (F.col("rows") >= CROWD)).select("lang", "node").limit(min(4 * parts, MOST_CROWDED)).collect():
        found.setdefault(lang, []).append(node)
    drop_saved(docs.sparkSession, path)
    return found


def phrase_counts(docs: DataFrame, *, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, str]:
    """``lang, words, n``: all single words, and phrases of up to ``max_words`` words that occur ``min_count`` times; and its path."""
    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    facts = slim.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = shuffle_width(docs.sparkSession, facts.bytes or 0, PART_BYTES)
    crowded = crowded_nodes(slim, facts.n, parts, max_words)
    hashes = {node_hash(name, node) for name, nodes in crowded.items() for node in nodes}
    lines = slim.mapInArrow(partial(_lines, max_words, parts, hashes), "part long, lang string, lines binary")
    placed = lines.repartition(parts, "part").sortWithinPartitions("part", "lang")
    sums = placed.mapInArrow(partial(_summed, max_words, min_count, crowded), "lang string, words string, n long")
    counts = sums.groupBy("lang", "words").agg(F.sum("n").alias("n"))
    return saved(counts.filter((F.col("n") >= min_count) | (n_words() == 1)), "phrases")


# -- the graph -----------------------------------------------------------------------------------------------------


def compact_paths(edges: DataFrame, max_words: int = MAX_WORDS, path_edges: int = PATH_EDGES) -> tuple[DataFrame, str]:
    """``lang, words, counts``: paths through nodes of one edge in and one out, with the counts of their edges; and its path.

    ``edges(lang, words, n)`` are phrases of ``max_words`` words.
    """
    spark, size = edges.sparkSession, max_words - 1
    ends = edges.select("lang", "words", "n", first_words("words", size).alias("head"), last_words("words", size).alias("tail"))
    out = ends.groupBy("lang", F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = ends.groupBy("lang", F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.any_value("words").alias("before"))
    unary = out.join(into, ["lang", "node"]).filter("n_out = 1 and n_in = 1").select("lang", F.col("node").alias("head"), "before")
    known = ends.join(unary, ["lang", "head"], "left").withColumn("before", F.when(F.col("before") != F.col("words"), F.col("before")))
    jumps, at = saved(known.select("lang", "words", "n", F.coalesce("before", "words").alias("first"), F.col("before").isNotNull().cast("long").alias("steps"), F.col("before").isNull().alias("done")), "jumps")
    open_edges, last = jumps.filter("not done").count(), -1
    while open_edges and open_edges != last:  # only rings are left when a round settles nothing
        ahead = jumps.select("lang", F.col("words").alias("first"), F.col("first").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        moved = jumps.filter("not done").join(ahead, ["lang", "first"])
        moved = moved.select("lang", "words", "n", F.col("next").alias("first"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"))
        jumps, new_at = saved(jumps.filter("done").unionByName(moved), "jumps")
        drop_saved(spark, at)
        at, last = new_at, open_edges
        open_edges = jumps.filter("not done").count()
    own = F.when(F.col("done"), F.col("first")).otherwise(F.col("words"))
    piece = F.when(F.col("done"), F.floor(F.col("steps") / path_edges)).otherwise(0)
    grouped = jumps.groupBy("lang", own.alias("own"), piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("steps", "words", "n"))).alias("edges"))
    first = F.split(F.element_at("edges.words", 1), " ")
    rest = F.transform(F.slice("edges.words", 2, F.greatest(F.size("edges"), F.lit(1))), lambda w: last_words(w, 1))
    paths = saved(grouped.select("lang", F.concat(first, rest).alias("words"), F.col("edges.n").alias("counts")), "paths")
    drop_saved(spark, at)
    return paths


def longest_phrases(paths: DataFrame, max_words: int) -> DataFrame:
    """``lang, words, n``: the edges of the paths."""
    edges = paths.select("lang", "words", F.posexplode("counts").alias("at", "n"))
    return edges.select("lang", F.array_join(F.slice("words", F.col("at") + 1, max_words), " ").alias("words"), "n")


def covering_counts(paths: DataFrame, phrases: DataFrame, max_words: int) -> DataFrame:
    """``lang, words, cover``: the highest count of a phrase of one word more, for every phrase that is part of one.

    A longer one still never has a higher count, and is there only if this one is.
    """
    sides = F.arrays_zip(F.concat("counts", F.array(F.lit(0))), F.concat(F.array(F.lit(0)), "counts"))
    nodes = paths.select("lang", "words", F.posexplode(sides).alias("at", "side"))
    best = F.greatest(*[F.col("side").getItem(name).cast("long") for name in ("0", "1")])
    found = nodes.select("lang", F.array_join(F.slice("words", F.col("at") + 1, max_words - 1), " ").alias("words"), best.alias("cover"))
    for m in range(2, max_words - 1):
        longer = phrases.filter(n_words() == m + 1)
        for part in (first_words, last_words):
            found = found.unionByName(longer.select("lang", part("words", m).alias("words"), F.col("n").alias("cover")))
    return found.groupBy("lang", "words").agg(F.max("cover").alias("cover"))


def scored(candidates: DataFrame, phrases: DataFrame, n_phrases: int, max_words: int) -> DataFrame:
    """``lang, words, a, l, r, score`` of ``candidates(lang, words, a)``, by the cut of the lowest score."""
    cuts = F.sequence(F.lit(1), n_words() - 1)
    left = [first_words("words", m) for m in range(1, max_words)]
    split = candidates.select("lang", "words", "a", F.explode(cuts).alias("cut"))
    split = split.withColumn("left", F.element_at(F.array(*left), F.col("cut")))
    split = split.withColumn("right", F.substr("words", F.length("left") + 2))
    for side, name in (("left", "l"), ("right", "r")):
        parts = phrases.select("lang", F.col("words").alias(side), F.col("n").alias(name))
        split = split.join(bounded_broadcast(parts, n_phrases, 8), ["lang", side])
    score = F.expr("cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return split.groupBy("lang", "words", "a").agg(best).select("lang", "words", "a", "best.l", "best.r", "best.score")


def phrases_of(
    docs: DataFrame, *, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases."""
    spark = docs.sparkSession
    counts, counts_path = phrase_counts(docs, lang=lang, text=text, max_words=max_words, min_count=min_count)
    phrases = counts.filter(F.col("n") >= min_count)
    paths, paths_path = compact_paths(phrases.filter(n_words() == max_words), max_words)
    shorter = phrases.filter((n_words() >= 2) & (n_words() < max_words))
    candidates = longest_phrases(paths, max_words).unionByName(shorter).withColumnRenamed("n", "a")
    cover = covering_counts(paths, phrases, max_words)
    free = candidates.join(cover, ["lang", "words"], "left").filter(F.coalesce(F.col("cover") * 100 < F.col("a") * covered, F.lit(True)))
    free, free_path = saved(free.select("lang", "words", "a"), "candidates")
    found, found_path = saved(scored(free, phrases, phrases.count(), max_words), "scored")

    best = [F.desc("score"), F.desc("a"), F.asc("words")]
    part = F.pmod(F.xxhash64("words"), F.lit(RANK_PARTS))
    ahead = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).filter(F.col("place") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    totals = counts.filter(n_words() == 1).groupBy("lang").agg(F.sum("n").alias("n"))
    result = ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("words").alias("phrase"), "a", "l", "r", "n", "score"
    )
    result, _ = saved(result, "top-phrases")
    drop_saved(spark, counts_path, paths_path, free_path, found_path)
    return result
