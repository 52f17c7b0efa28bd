"""Chat formatting in budgeted windows.

Turns are written out under a template, in which ``<`` and ``>`` belong to the marks alone: texts and roles have them
escaped, and unescaping gives them back exactly. A conversation that exceeds the budget of tokens is cut into windows of
whole turns, chosen by prefix sums: with a capacity ``C`` a turn whose tokens lie between two multiples of ``C`` belongs to
that stretch, and one that crosses a multiple joins the stretch in which it ends if both fit into ``C``, and else is a
window of its own. So a turn's window follows from its own prefix sum and its neighbours within ``C`` tokens, however long
the conversation is.

Each later window begins with the conversation's system turn and repeats the turns that lie within the last ``history``
tokens before its own. ``C`` is what the budget leaves beside both, at least a quarter of it; a window exceeds the budget
only if a turn, or the system turn, is too long by itself. The loss mask covers the texts of assistant turns in the window
they are new in; repeated ones are masked, so each target counts once.

Turns are sorted over the whole table and numbered across partitions. Prefix sums are taken in chunks of ``CHUNK`` turns
and carried from chunk to chunk, so a conversation of any length is spread. History meets its windows by stretch.

Defined results: a null text or role is empty; a null conversation id is a conversation of its own; turns are ordered by
turn number (nulls first), then role and text; equal rows stay, one by one; the system turn is the first turn if its role
is ``system``, and later turns of that role are ordinary ones; an empty table gives no windows; texts of any length stay
whole; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicegrad.llm.common import drop_saved, process_memory, saved, shuffle_width
from slicegrad.operators.columns import with_dense_ids

#: Tokens of a window, and of the history it repeats.
BUDGET, HISTORY = 2048, 384
SYSTEM, LEARNT = "system", "assistant"
#: Turns in a chunk of a prefix sum, and in a task.
CHUNK, ROWS_PER_TASK = 4096, 1_000_000
HEAD, MIDDLE, TAIL = "<turn ", ">\n", "\n</turn>\n"
#: What stands for a character in texts and roles; the backslash comes first when escaping and last when unescaping.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def written_turn() -> Column:
    return F.concat(F.lit(HEAD), "role", F.lit(MIDDLE), "body", F.lit(TAIL))


def _counted(path: str, schema: pa.Schema, batches):
    import tiktoken
    from public_tokenizers import PATTERN
    from tiktoken.load import load_tiktoken_bpe

    encoding = process_memory().get(path)
    if encoding is None:
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
        process_memory()[path] = encoding
    for batch in batches:
        counts = [len(encoding.encode_ordinary(t)) for t in batch.column("rendered").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], schema=schema)


def rendered_turns(turns: DataFrame, tokenizer: str, *, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, conv_id, turn, role, body, n``: escaped turns with the tokens of their written form."""
    full = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit("-"))
    plain = turns.select(named.alias("conv"), F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), escaped(full(role)).alias("role"), escaped(full(text)).alias("body"))
    plain = plain.select("*", written_turn().alias("rendered"))
    schema = T.StructType([*plain.schema.fields, T.StructField("n", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return plain.mapInArrow(partial(_counted, tokenizer, to_arrow_schema(schema)), schema).drop("rendered")


def with_offsets(turns: DataFrame) -> tuple[DataFrame, str]:
    """``turns`` in order with ``pos``, the turns before in the conversation, and ``a``, their tokens; as a table, with its path."""
    order = ["conv", "turn", "role", "body", "twin"]  # equal turns have numbers of their own and do not fall into one range
    held, held_path = saved(turns.withColumn("twin", F.monotonically_increasing_id()), "turns")
    ordered = held.repartitionByRange(shuffle_width(held.sparkSession, held.count(), ROWS_PER_TASK), *order).sortWithinPartitions(*order)
    numbered = with_dense_ids(ordered.drop("twin"), "row").withColumn("chunk", F.floor(F.col("row") / CHUNK))
    sums = numbered.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("c_turns"), F.sum("n").alias("c_tokens"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    carried = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("c_turns", "c_tokens")]
    carried = sums.select("conv", "chunk", *carried)
    own = Window.partitionBy("conv", "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = numbered.withColumns({"a": F.coalesce(F.sum("n").over(own), F.lit(0)), "pos": F.count(F.lit(1)).over(own)})
    joined = inside.join(carried, ["conv", "chunk"])
    placed = joined.withColumns({"a": F.col("a") + F.col("c_tokens_before"), "pos": F.col("pos") + F.col("c_turns_before")})
    placed = saved(placed.drop("chunk", "row", "c_tokens_before", "c_turns_before"), "placed")
    drop_saved(turns.sparkSession, held_path)
    return placed


def windows(
    turns: DataFrame, tokenizer: str, *, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per window: ``conv, conv_id, span, n_repeated, n_new, n_tokens, text, loss``.

    ``span`` orders the windows of a conversation; the first ``n_repeated`` turns of a window are repeated ones; ``loss``
    lists ``start, stop`` of the learnt texts, in code points of ``text``.
    """
    placed, placed_path = with_offsets(rendered_turns(turns, tokenizer, conv=conv, turn=turn, role=role, text=text))
    is_system = (F.col("pos") == 0) & (F.col("role") == SYSTEM)
    system = placed.filter(is_system).select("conv", F.col("n").alias("n_system"))
    room = F.greatest(F.lit(max(1, budget // 4)), F.lit(budget - history) - F.coalesce("n_system", F.lit(0)))
    own = placed.join(system, "conv", "left").withColumn("room", room.cast("long")).withColumn("a", F.col("a") - F.coalesce("n_system", F.lit(0)))
    own = own.withColumns({"b": F.col("a") + F.col("n"), "system": is_system}).drop("n_system")
    first, last = F.floor(F.col("a") / F.col("room")), F.floor((F.col("b") - 1) / F.col("room"))
    stretch = Window.partitionBy("conv", "stretch")  # no more turns than tokens in ``room``, and one that crosses into it
    own = own.withColumns({"stretch": F.when(F.col("system"), F.lit(0)).otherwise(last), "crossing": ~F.col("system") & (first < last)})
    total = F.sum(F.when(~F.col("system"), F.col("n")).otherwise(F.lit(0))).over(stretch)
    span = F.col("stretch") * 2 + F.when(F.col("crossing") & (total > F.col("room")), 0).otherwise(1)
    own, _ = saved(own.withColumn("total", total).withColumn("span", span.cast("long")).drop("crossing", "total"), "spans")
    drop_saved(turns.sparkSession, placed_path)

    starts = own.filter("not system").groupBy("conv", "span").agg(F.min("a").alias("start"), F.any_value("room").alias("room"))
    later = starts.filter("start > 0").withColumn("near", F.floor(F.col("start") / F.col("room")))
    # a turn is repeated in the windows that start between its end and ``history`` tokens after its start
    reach = F.explode(F.sequence(F.floor(F.col("b") / F.col("room")), F.floor((F.col("a") + history) / F.col("room")))).alias("near")
    columns = ["conv_id", "pos", "role", "body", "n"]
    past = own.filter(~F.col("system") & (F.col("n") <= history)).select("conv", *columns, "a", "b", reach)
    met = past.join(later.select("conv", "near", "span", "start"), ["conv", "near"]).filter(F.col("start").between(F.col("b"), F.col("a") + history))
    heads = own.filter("system").select("conv", *columns).join(later.select("conv", "span"), "conv")
    # the system turn is new in the window of the first other turn
    begin = starts.filter("start = 0").select("conv", F.col("span").alias("first"))
    system = own.filter("system").join(begin, "conv", "left").withColumn("span", F.coalesce("first", "span")).drop("first")
    new = own.filter("not system").unionByName(system).select("conv", "span", *columns, F.lit(False).alias("repeated"))
    repeated = [x.select("conv", "span", *columns, F.lit(True).alias("repeated")) for x in (met, heads)]
    every = new.unionByName(repeated[0]).unionByName(repeated[1])

    before = Window.partitionBy("conv", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("role") + F.char_length("body") + len(HEAD + MIDDLE + TAIL)
    start = F.coalesce(F.sum(size).over(before), F.lit(0))
    body_at = start + F.char_length("role") + len(HEAD + MIDDLE)
    learnt = ~F.col("repeated") & (F.col("role") == LEARNT)
    mask = F.when(learnt, F.struct(body_at.alias("start"), (body_at + F.char_length("body")).alias("stop")))
    parts = every.select("conv", "conv_id", "span", "n", "repeated", F.struct("pos", written_turn().alias("rendered"), mask.alias("mask")).alias("part"))
    grouped = parts.groupBy("conv", "span").agg(
        F.any_value("conv_id").alias("conv_id"), F.sum(F.col("repeated").cast("long")).alias("n_repeated"),
        F.sum((~F.col("repeated")).cast("long")).alias("n_new"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list("part")).alias("parts"),
    )
    masks = F.filter(F.col("parts.mask"), lambda m: m.isNotNull())
    return grouped.select("conv", "conv_id", "span", "n_repeated", "n_new", "n_tokens", F.array_join("parts.rendered", "").alias("text"), masks.alias("loss"))


def write_windows(turns: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write the windows of all conversations as a table under ``path``."""
    windows(turns, tokenizer, **options).write.parquet(path)


def parsed(found: DataFrame) -> DataFrame:
    """``conv, conv_id, span, n_new, turns, loss_text, chars`` as read from windows: the new turns and the text under the mask."""
    pieces = F.filter(F.split("text", TAIL), lambda p: p != "")
    new = F.slice(pieces, (F.col("n_repeated") + 1).cast("int"), F.greatest(F.size(pieces), F.lit(1)))
    turns = F.transform(
        new,
        lambda p: F.struct(
            unescaped(F.substr(F.substring_index(p, MIDDLE, 1), F.lit(len(HEAD) + 1))).alias("role"),
            unescaped(F.substr(p, F.length(F.substring_index(p, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text"),
        ),
    )
    loss = F.transform("loss", lambda m: unescaped(F.substr("text", (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int"))))
    return found.select("conv", "conv_id", "span", "n_new", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.char_length("text").cast("long").alias("chars"))


def _digests(schema: pa.Schema, batches):
    """Rows arrive sorted by conversation and window; digests grow window by window, so no conversation is held whole."""
    import hashlib

    current, row = None, None

    def done():
        conv_id, n, turns, chars, loss, total = row
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total), schema)], schema=schema)

    for batch in batches:
        out = []
        for conv, conv_id, n_new, turns, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != current:
                if row is not None:
                    out.append(done())
                current, row = conv, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            row[1] += n_new
            row[2].update(turns.encode())
            row[3] += len(loss)
            row[4].update(loss.encode())
            row[5] += chars
        yield from [pa.Table.from_batches(out).combine_chunks().to_batches()[0]] if out else []
    if row is not None:
        yield done()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What the windows under ``path`` hold, by conversation: counts and digests of turns and learnt texts.

    A digest over a conversation has to be taken in order, so its windows pass through one task, one after the other.
    """
    read = parsed(spark.read.parquet(path))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.repartition("conv").sortWithinPartitions("conv", "span").select("conv", "conv_id", "n_new", lines.alias("lines"), "loss_text", "chars")
    kind = read.schema["conv_id"].dataType
    digest, count = T.StringType(), T.LongType()
    made = {"n_turns": count, "turns_sha256": digest, "loss_chars": count, "loss_sha256": digest, "formatted_chars": count}
    out = T.StructType([T.StructField("conv_id", kind), *[T.StructField(name, t) for name, t in made.items()]])
    from pyspark.sql.pandas.types import to_arrow_schema

    return rows.mapInArrow(partial(_digests, to_arrow_schema(out)), out)
