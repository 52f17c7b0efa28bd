"""The Merkle manifest against plain Python, and its defined results in odd cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from slicegrad.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, g long, i int, key string, n long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def plain_tree(leaves, fanout):
    """Root, and the siblings of each leaf by level: ``[(left, right), ...]``."""
    paths, spans, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        runs = [range(k, min(k + fanout, len(nodes))) for k in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for leaf in spans[k]:
                    paths[leaf].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        nodes, spans = [sha(*[nodes[k] for k in run]) for run in runs], [[x for k in run for x in spans[k]] for run in runs]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((first(row["doc_id"]), plain_leaf(row), row))
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {name: plain_tree([leaf for _, leaf, _ in sorted(groups[name], key=lambda x: x[:2])], fanout) for name in names}
    root, tops = plain_tree([trees[name][0] for name in names], fanout)
    out = []
    for name, top in zip(names, tops):
        for (_, leaf, row), path in zip(sorted(groups[name], key=lambda x: x[:2]), trees[name][1]):
            forged = leaf if row["n_chars"] is None else plain_leaf({**row, "n_chars": row["n_chars"] + 1})
            for left, right in path + top:
                forged = sha(*left, forged, *right)
            proof = "".join("".join(left + right) for left, right in path + top)
            out.append((row["doc_id"], leaf, trees[name][0], root, proof, forged))
    return sorted(out, key=repr)


def made(docs, fanout):
    forged = merkle.leaf_digest(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    rows, levels = merkle.manifest(docs, FIELDS, fanout=fanout, carried={"forged": forged})
    places = [(F.col("i"), F.col("n")), (F.col("g"), F.col("groups"))]
    folded = [merkle.fold(F.coalesce(F.col(c), F.col("leaf")), F.col("proof"), places, levels, fanout) for c in ("forged", "leaf")]
    return rows.select("key", "leaf", "subroot", "root", F.lower(F.hex("proof")).alias("siblings"), folded[0].alias("forged_root"), folded[1].alias("own_root"))


@pytest.mark.parametrize("fanout", [2, 3, 4])
@pytest.mark.parametrize("count", [1, 2, 23])
def test_against_plain_trees(spark, fanout, count):
    rows = [dict(doc_id=i, text=f"text {i % 5} ü", lang=["en", "de", None, "ß", "é"][i * i % 5], source=None if i % 4 == 0 else "s", n_chars=None if i % 6 == 0 else i) for i in range(count)]
    rows += [dict(rows[0])] * 2 + [dict(rows[0], doc_id=None)] if count > 2 else []
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, 2, "y", 3) for r in rows], SCHEMA)
    got = made(docs, fanout).collect()
    want = plain_manifest(rows, fanout)
    assert sorted((r.leaf, r.subroot, r.root, r.siblings, r.forged_root) for r in got) == sorted(w[1:] for w in want)
    assert {r.own_root for r in got} == {got[0].root} and len(got) == len(rows)
    assert sorted([(r.key, r.leaf) for r in got], key=repr) == sorted([w[:2] for w in want], key=repr)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows, levels = merkle.manifest(empty, FIELDS)
    assert rows.count() == 0 and levels == 0
    long = spark.createDataFrame([(1, "é" * 2_000_000, "en", None, 5, "x", 1, 2, "y", 3)], SCHEMA)
    rows, _ = merkle.manifest(long, FIELDS)
    row = rows.first()
    assert row.leaf == row.subroot == row.root == plain_leaf(dict(doc_id=1, source=None, lang="en", n_chars=5, text="é" * 2_000_000)) and row.proof == b""


def test_no_task_sees_a_whole_group(spark):
    """Levels are aggregated by parent, never by group."""
    nodes = spark.range(64).selectExpr("id % 2 g", "id i", "id % 3 n", "string(id) h")
    plan = merkle.pivot(nodes, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(g#\d+L, \S+, n#\d+L", plan), plan
