"""Phrases against plain Python, and their defined results in odd cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slicegrad.llm import phrase_graph as pg

SCHEMA = "doc_id long, text string, lang string, words string, n string, node string, part int, a string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", 1, "w") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)


def plain_phrases(rows, longest=3, least=10, covered=50, top=2000):
    counts = {}
    for text, lang in rows:
        found = counts.setdefault("und" if lang is None else lang, Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for m in range(1, longest + 1):
                found.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, found in counts.items():
        n = sum(f for p, f in found.items() if len(p) == 1)
        candidates = {p: f for p, f in found.items() if len(p) > 1 and f >= least}
        kept = []
        for p, a in candidates.items():
            longer = (f for q, f in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * f >= covered * a for f in longer):
                continue
            cuts = [(10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def sample_rows(seed, count=120):
    rng = random.Random(seed)
    words = ["A", "b", "ç", "dd", "E\t", "f  ", "g.", "h\n", "i,\r", "kk?"]
    weights = [9, 8, 7, 6, 5, 4, 1, 1, 1, 1]
    passage = " one two three four five six seven eight nine ten "
    return [
        (" ".join(rng.choices(words, weights, k=rng.randrange(0, 40))) + (passage if rng.random() < 0.2 else ""), rng.choice(["en", "en", "en", "de", None, "und"]))
        for _ in range(count)
    ]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_against_plain_counts(spark, longest):
    rows = sample_rows(longest) + [(None, "en"), ("", None), ("the " * 3000, "fr"), (". , ; :", "es")]
    rows += [rows[0]] * 3
    want = plain_phrases(rows, longest)
    assert rows_of(pg.phrases_of(docs_of(spark, rows), max_words=longest)) == want and len(want) > 40


def test_crowded_nodes_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(pg, "PART_BYTES", 20_000)
    monkeypatch.setattr(pg, "SLICE_BYTES", 3000)
    rows = sample_rows(7) + [(" ".join(f"the the w{i} x" for i in range(2000)), "en")] * 2
    docs = docs_of(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    crowded = pg.crowded_nodes(docs, len(rows), 8, 3)
    assert "the the" in crowded["en"] and "w1 x" not in crowded["en"]
    edges = pg.Edges(pg.pa.array(["en"] * 2), pg.pa.array(["the the w1 the the w2", "the the. the"]), 3)
    spread = edges.parts(10**9, {pg.node_hash("en", "the the")})
    places = {t: p for t, p in zip(edges.texts(pg.np.arange(len(edges.n))).to_pylist(), spread)}
    assert len({places[w] for w in ("the the w1", "the the w2", "the the")}) == 3 and places["w1 the the"] == edges.parts(10**9, set())[list(places).index("w1 the the")]
    assert rows_of(pg.phrases_of(docs_of(spark, rows), top=30)) == plain_phrases(rows, top=30)


def test_an_empty_table_has_no_phrases(spark):
    assert rows_of(pg.phrases_of(docs_of(spark, [("a b", "en")]).limit(0))) == []
    assert rows_of(pg.phrases_of(docs_of(spark, [(None, None)]))) == []


@pytest.mark.parametrize("limit", [5, 4096])
def test_paths_are_compact(spark, limit):
    """A chain, a fork, a ring and a loop: paths hold every edge once, chains are one path, rings stay single edges."""
    lines = [f"c{i} c{i + 1} c{i + 2}" for i in range(40)] + ["f a b", "f a c", "a b d", "a c d"]
    lines += [f"r{i % 7} r{(i + 1) % 7} r{(i + 2) % 7}" for i in range(7)] + ["l l l"]
    edges = spark.createDataFrame([("en", line, 10 + i) for i, line in enumerate(lines)], "lang string, words string, n long")
    paths, _ = pg.compact_paths(edges, 3, limit)
    paths = paths.persist()
    assert rows_of(pg.longest_phrases(paths, 3).select("words", "n")) == sorted((line, 10 + i) for i, line in enumerate(lines))
    sizes = {r.words[0][0]: 0 for r in paths.collect()}
    for r in paths.collect():
        sizes[r.words[0][0]] += 1
        assert len(r.words) == len(r.counts) + 2 and len(r.counts) <= limit
    if limit > 40:
        assert sizes == {"c": 1, "f": 2, "r": 7, "l": 1}


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    phrases = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 2), ("en", "a b", big)], "lang string, words string, n long")
    candidates = phrases.filter("words = 'a b'").withColumnRenamed("n", "a")
    row = pg.scored(candidates, phrases, 3, 3).first()
    assert row.score == 10**6 * big * big // ((big + 1) * (big + 2)) and (row.l, row.r) == (big + 1, big + 2)


def test_edges_are_shuffled_once_and_never_joined_in_pairs(spark):
    docs = docs_of(spark, sample_rows(3)).na.fill("und")
    words, text, piece = pg.words_of(pg.pa.array(["Ab c.d", "", "e", " É f "]))
    assert words.to_pylist() == ["ab", "c", "d", "e", "É", "f"] and text.tolist() == [0, 0, 0, 2, 3, 3]
    assert len(set(piece.tolist())) == 4
    assert pg.edges_of(docs.select("lang", "text"), 3).agg(F.sum("n")).first()[0] == sum(len(re.findall(r"[^ \t.,;:!?\x0a-\x0d]+", t or "")) for t, _ in sample_rows(3))
