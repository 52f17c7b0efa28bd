"""Merkle manifest of a data set: one tree per group, and one over the groups' roots.

A leaf is the digest of a row's fields. Leaves of a group are numbered in key order; node ``i`` of a level is child
``i % fanout`` of node ``i div fanout`` of the next. Each level is one *slot pivot*: conditional aggregates spread the
children of a parent into ``fanout`` columns. Concatenating the columns and hashing them gives the parent; concatenating
all but a child's own column gives its siblings. A level shuffles one digest per node, so all levels together move about
twice the leaves' digests, whatever the size of the rows.

Proofs are handed down: a pivot row knows the siblings above its parent, puts its own children's siblings in front and
passes them to the next level. Each level meets its parents by one join, and the last of them brings the leaves along.
A proof is the plain sequence of sibling digests. How many belong to a level, and on which side of the node they stand,
follows from the node's number and the level's size, so nothing else is stored.

Numbers come from a range-sorted table that is numbered across partitions, so a group of any size is spread.

Defined results: a null field is ``-``; a null group is a group of its own and comes first; rows of a null key come
first in their group; rows of equal keys are ordered by their digests, equal rows stay apart as leaves of equal digests;
an empty table has no rows; a group of one row has that leaf as its root, and a table of one group that group's root.
Columns that are not fields are ignored unless they are carried, under names of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicegrad.llm.common import drop_saved, saved, shuffle_width
from slicegrad.operators.columns import with_dense_ids
from slicegrad.session import bounded_broadcast

FANOUT = 2
#: Bytes of a digest.
DIGEST = 32
ROWS_PER_TASK = 2_000_000


def written_field(value: Column) -> Column:
    """A value with its length in front, so that neighbouring fields cannot run into each other; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the written fields in order, in lower-case hexadecimal."""
    return F.sha2(F.concat(*[written_field(v) for v in values]), 256)


def _slots(fanout: int) -> list[str]:
    return [f"s{j}" for j in range(fanout)]


def pivot(nodes: DataFrame, fanout: int, *extra: str) -> DataFrame:
    """One row per parent of ``nodes(g, i, n, h)``: ``g, up, n`` and its children's digests ``s0, s1, ...``.

    ``extra`` columns of the children are spread alike, as ``s<j>_<name>``. ``n`` is the size of the children's level.
    """
    own = lambda column, j: F.any_value(F.when(F.col("i") % fanout == j, F.col(column)), ignoreNulls=F.lit(True))
    spread = [own("h", j).alias(s) for j, s in enumerate(_slots(fanout))]
    spread += [own(name, j).alias(f"{s}_{name}") for j, s in enumerate(_slots(fanout)) for name in extra]
    up = F.floor(F.col("i") / fanout) if fanout & (fanout - 1) else F.shiftright("i", fanout.bit_length() - 1)
    return nodes.groupBy("g", up.cast("long").alias("up"), "n").agg(*spread)


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes above a pivot, ``g, i, n, h``: the digests of its concatenated columns."""
    size = F.expr(f"(n + {fanout - 1}) div {fanout}")
    return level.select("g", F.col("up").alias("i"), size.alias("n"), F.sha2(F.concat_ws("", *_slots(fanout)), 256).alias("h"))


def siblings(level: DataFrame, fanout: int, j: int) -> Column:
    """The digests beside column ``j`` from left to right, in bytes; a last run may have fewer."""
    others = [F.coalesce(F.unhex(s), F.lit(b"")) for k, s in enumerate(_slots(fanout)) if k != j]
    return F.concat(*others)


def handed_down(level: DataFrame, above: DataFrame, fanout: int, *extra: str) -> DataFrame:
    """Children of a pivot with their proofs: ``g, i, n, h, path`` and the ``extra`` columns.

    ``above(g, i, path)`` has the proofs of the parents.
    """
    met = level.join(above.select("g", F.col("i").alias("up"), F.col("path").alias("upper")), ["g", "up"])
    children = [
        F.struct(
            (F.col("up") * fanout + j).alias("i"), F.col(s).alias("h"), F.concat(siblings(level, fanout, j), F.col("upper")).alias("path"),
            *[F.col(f"{s}_{name}").alias(name) for name in extra],
        )
        for j, s in enumerate(_slots(fanout))
    ]
    return met.select("g", "n", F.inline(F.array(*children))).filter("h is not null")


def heights(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


@dataclass
class Forest:
    """Trees that were raised together: their pivots from the leaves up, and ``roots(g, height, h)``."""

    fanout: int
    levels: list[DataFrame]
    roots: DataFrame
    paths: list[str]


def raise_trees(leaves: DataFrame, most: int, fanout: int, *extra: str) -> Forest:
    """Pivot ``leaves(g, i, n, h)`` level by level until every group has one node; ``most`` is the largest group's size."""
    levels, paths = [], []
    nodes = leaves
    roots = leaves.filter("n = 1").select("g", F.lit(0).alias("height"), "h")
    for height in range(1, heights(most, fanout) + 1):
        level, path = saved(pivot(nodes.filter("n > 1"), fanout, *(extra if height == 1 else ())), "pivot")
        levels.append(level), paths.append(path)
        nodes = parents(level, fanout)
        roots = roots.unionByName(nodes.filter("n = 1").select("g", F.lit(height).alias("height"), "h"))
    roots, path = saved(roots, "roots")
    return Forest(fanout, levels, roots, [*paths, path])


def prove(forest: Forest, starts: DataFrame, *extra: str) -> tuple[DataFrame | None, list[str]]:
    """Leaves of groups of several rows with their proofs, which end in the group's own: ``starts(g, height, path)``."""
    found, made = None, []
    for height in range(len(forest.levels), 0, -1):
        above = starts.filter(F.col("height") == height).select("g", F.lit(0).cast("long").alias("i"), "path")
        if found is not None:
            above = above.unionByName(found.select("g", "i", "path"))
        found = handed_down(forest.levels[height - 1], above, forest.fanout, *(extra if height == 1 else ()))
        if height > 1:
            found, path = saved(found.select("g", "i", "path"), "proofs")
            made.append(path)
    return found, made


def fold(leaf: Column, proof: Column, places: list[tuple[Column, Column]], levels: int, fanout: int = FANOUT) -> Column:
    """The root that follows from a leaf and its proof; ``places`` are number and size of the leaf in its tree, the tree in its own, ...

    ``levels`` is at least the height of the highest tree.
    """
    longs = lambda **fields: F.struct(*[c.cast("long").alias(name) for name, c in fields.items()])
    state = lambda h, i, n, byte, tree: F.struct(h.alias("h"), longs(i=i, n=n, byte=byte, tree=tree).alias("at"))

    def climb(acc: Column, _) -> Column:
        i, n, at, tree = (acc["at"][name] for name in ("i", "n", "byte", "tree"))
        slot = i % fanout
        beside = F.least(F.lit(fanout), n - (i - slot)) - 1
        cut = lambda start, count: F.lower(F.hex(F.substr(proof, start.cast("int"), (count * DIGEST).cast("int"))))
        joined = F.concat(cut(at, slot), acc["h"], cut(at + slot * DIGEST, beside - slot))
        choice = F.when(n > 1, state(F.sha2(joined, 256), F.floor(i / fanout), F.ceil(n / fanout), at + beside * DIGEST, tree))
        for number, place in enumerate(places[1:], start=1):  # at a root: on to the tree in which it is a leaf
            choice = choice.when(tree < number, state(acc["h"], *place, at, F.lit(number)))
        return choice.otherwise(acc)

    start = state(leaf, *places[0], F.lit(1), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit((levels + 1) * len(places))), start, climb)["h"]


def manifest(
    docs: DataFrame, fields: list[str], *, key: str = "doc_id", group: str = "lang", fanout: int = FANOUT, carried: dict[str, Column] | None = None
) -> tuple[DataFrame, int]:
    """Every row's leaf, roots and proof, and the number of levels that :func:`fold` needs.

    Rows are ``key, leaf, subroot, root, proof`` (the siblings' digests in bytes, from the leaf up), ``i, n`` (number in
    the group, its size), ``g, groups`` (number of the group, how many there are), and the ``carried`` columns.
    """
    spark = docs.sparkSession
    extra = carried or {}
    kept = [f"x_{name}" for name in extra]
    slim = docs.select(
        F.col(f"`{group}`").cast("string").alias("label"), F.col(f"`{key}`").alias("key"), leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("h"),
        *[c.alias(f"x_{name}") for name, c in extra.items()], F.monotonically_increasing_id().alias("twin"),
    )
    slim, slim_path = saved(slim, "digests")
    order = ["label", "key", "h", "twin"]  # equal rows have numbers of their own, so they do not fall into one range
    sorted_rows = slim.repartitionByRange(shuffle_width(spark, slim.count(), ROWS_PER_TASK), *order).sortWithinPartitions(*order)
    numbered = with_dense_ids(sorted_rows.drop("twin"), "row")
    sizes = numbered.groupBy("label").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes, sizes_path = saved(sizes, "sizes")
    facts = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    groups, groups_path = saved(with_dense_ids(sizes.orderBy("label"), "g"), "groups")
    known = bounded_broadcast(groups.withColumnRenamed("label", "name"), facts.groups, 8)
    leaves = numbered.join(known, F.col("label").eqNullSafe(F.col("name"))).select("g", (F.col("row") - F.col("first")).alias("i"), "n", "h", "key", *kept)
    leaves, leaves_path = saved(leaves, "leaves")
    drop_saved(spark, slim_path, sizes_path)

    trees = raise_trees(leaves, facts.most or 0, fanout, "key", *kept)
    tops = trees.roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(facts.groups).cast("long").alias("n"), "h")
    tops, tops_path = saved(tops, "subroots")
    crown = raise_trees(tops, facts.groups, fanout)
    proven, made = prove(crown, crown.roots.select("g", "height", F.lit(b"").alias("path")))
    if proven is None:  # at most one group
        proven = tops.select("i", "h", F.lit(b"").alias("path"))
    starts = proven.select(F.col("i").alias("g"), F.col("h").alias("subroot"), "path")
    starts, starts_path = saved(starts.join(trees.roots.select("g", "height"), "g"), "starts")
    found, more = prove(trees, starts.select("g", "height", "path"), "key", *kept)
    alone = leaves.filter("n = 1").join(starts.select("g", "path"), "g")
    columns = ["g", "i", "n", "h", "path", "key", *kept]
    found = alone.select(*columns) if found is None else found.select(*columns).unionByName(alone.select(*columns))
    root = crown.roots.first()  # one row
    subroots = bounded_broadcast(starts.select("g", "subroot"), facts.groups, 12)
    rows = found.join(subroots, "g").select(
        "key", F.col("h").alias("leaf"), "subroot", F.lit(root.h if root else None).cast("string").alias("root"), F.col("path").alias("proof"),
        "i", "n", "g", F.lit(facts.groups).cast("long").alias("groups"), *[F.col(f"x_{name}").alias(name) for name in extra],
    )
    rows, _ = saved(rows, "manifest")
    drop_saved(spark, groups_path, leaves_path, tops_path, starts_path, *trees.paths, *crown.paths, *made, *more)
    return rows, max(len(trees.levels), len(crown.levels))
