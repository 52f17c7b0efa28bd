"""Secret scan: three base rules, and windows of high Shannon entropy in candidate strings. Columns only.

A candidate is a maximal run of one character class that is long enough and mixes letters and digits. A window of
fixed length slides over it. The window's counts per character change by one arriving and one leaving character, and
with them the sum of ``c * log2(c)``, kept in fixed point; the entropy is ``log2(length) - sum / length``. The span from
the start of the first to the end of the last window that reaches the class's threshold is reported, unless the
candidate is on the allow list or meets a span of a base rule.

Positions are code points. They are found without any user function: splitting a text at a pattern gives the pieces
between the matches, and running sums of the lengths give the places.

Defined results: null or empty texts have no spans; rows are kept one by one; other columns are ignored; texts of
any length are scanned whole, in one narrow pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicegrad.llm.common import text_of

# The base rules.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # a shorter run cannot hold a long one, so the length may stand in the pattern
HEX = "[0-9a-f]{24,}"
MIN_ASSIGNED = 6

# Candidates that are no secrets.
ALLOWED = (
    "(?i)example|sample|dummy|placeholder|changeme|x{6,}|(.)\\1{7,}|0123456789|abcdefgh|"
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(https?|www)[-_/]"
)
#: Fixed point of the entropy sums.
UNIT = 1 << 20


class CharClass(NamedTuple):
    """An alphabet, its pattern, the window's length and the least entropy in bits."""

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float

    @property
    def limit(self) -> int:
        """Greatest sum of c * log2(c) of a window that reaches the threshold."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)

    @property
    def gains(self) -> list[int]:
        """c * log2(c) in fixed point for every possible count."""
        return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, self.window + 2)]


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("hexrun", DIGITS + "abcdefABCDEF", "[0-9A-Fa-f]{24,}", 24, 3.0),
    CharClass("mixed", DIGITS + LOWER + LOWER.upper() + "+/_=-", "[A-Za-z0-9+/_=-]{20,}", 20, 3.8),
)
KINDS = ("assign", "access", "hex", *[c.name for c in CLASSES])
SPAN = "struct<start:int,kind:int,stop:int>"


def spans(text: Column, pattern: str, kind: int, add: Callable[[Column, Column, Column], Column]) -> Column:
    """Spans of all matches; ``add(start, stop, match)`` gives the array of those a match contributes."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda a, b: F.struct(a.alias("before"), b.alias("match")))
    steps = F.filter(steps, lambda x: x["match"].isNotNull())  # behind the last match

    def step(acc, x):
        start = acc["at"] + F.char_length(x["before"])
        stop = start + F.char_length(x["match"])
        return F.struct(stop.alias("at"), F.concat(acc["spans"], add(start, stop, x["match"])).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    found = F.aggregate(steps, zero, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _span(start: Column, stop: Column, kind: int) -> Column:
    return F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    """Spans of the base rules, ordered by start, then kind."""

    def assigned(start, stop, match):
        long = F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= MIN_ASSIGNED
        return F.when(long, _span(start, stop, 0)).otherwise(_none())

    return F.sort_array(F.concat(
        spans(text, ASSIGN, 0, assigned),
        spans(text, ACCESS, 1, lambda a, b, _: _span(a, b, 1)),
        spans(text, HEX, 2, lambda a, b, _: _span(a, b, 2)),
    ))


def entropy_range(candidate: Column, kind: CharClass) -> Column:
    """Start of the first and end of the last window of enough entropy in ``candidate``; nulls without one."""
    gains = F.array(*[F.lit(g).cast("long") for g in kind.gains])
    letters = F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(kind.alphabet), c) - 1)

    def slide(codes: Column) -> Column:
        def step(acc, code):
            leaving = F.get(codes, acc["i"] - kind.window)
            counts = F.transform(
                acc["counts"],
                lambda n, k: n + F.when(k == code, 1).otherwise(0) - F.when(k == leaving, 1).otherwise(0),
            )
            more = F.get(acc["counts"], code)
            less = F.get(acc["counts"], leaving)
            grown = F.get(gains, more + 1) - F.get(gains, more)
            shrunk = F.coalesce(F.get(gains, less) - F.get(gains, less - 1), F.lit(0).cast("long"))
            total = acc["total"] + F.when(code.eqNullSafe(leaving), F.lit(0).cast("long")).otherwise(grown - shrunk)
            hit = (acc["i"] >= kind.window - 1) & (total <= kind.limit)
            return F.struct(
                (acc["i"] + 1).alias("i"), counts.alias("counts"), total.alias("total"),
                F.when(hit & acc["first"].isNull(), acc["i"] + 1 - kind.window).otherwise(acc["first"]).alias("first"),
                F.when(hit, acc["i"] + 1).otherwise(acc["last"]).alias("last"),
            )

        zero = F.struct(
            F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"), F.lit(0).cast("long").alias("total"),
            F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(codes, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.get(F.transform(F.array(letters), slide), F.lit(0))


def entropy_spans(text: Column, number: int, kind: CharClass) -> Column:
    """Spans of high entropy in the candidates of one class."""

    def added(start, stop, match):
        mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]") & ~match.rlike(ALLOWED)
        found = F.transform(
            F.array(entropy_range(match, kind)),
            lambda r: F.struct((start + r["first"]).alias("start"), F.lit(number).alias("kind"), (start + r["last"]).alias("stop")),
        )
        return F.when(mixed, F.filter(found, lambda s: s["start"].isNotNull())).otherwise(_none())

    return spans(text, kind.pattern, number, added)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, added``: the spans of the base rules and those of high entropy that meet none of them."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    rows = rows.select("key", "text", base_spans(F.col("text")).alias("base"))
    found = F.concat(*[entropy_spans(F.col("text"), 3 + n, kind) for n, kind in enumerate(CLASSES)])
    rows = rows.select("key", "base", found.alias("found"))
    free = F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return rows.select("key", "base", F.sort_array(free).alias("added"))


def written_out(span_array: Column) -> Column:
    """``kind:start:end`` of each span by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(span_array), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def masked(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` with the characters of all spans replaced by asterisks of the same number."""
    found = scan(docs.select(F.col(f"`{key}`").alias("key"), F.struct(F.col(f"`{key}`"), text_of(text).alias("t")).alias("both"), text_of(text).alias("text")), key="both")
    body = F.col("key.t")
    stars = F.aggregate(
        F.sort_array(F.concat("base", "added")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.concat(
                acc["out"],
                body.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.repeat(F.lit("*"), F.greatest(s["stop"] - F.greatest(acc["at"], s["start"]), F.lit(0))),
            ).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.char_length(body))),
    )
    return found.select(F.col(f"key.`{key}`").alias(key), stars.alias(text))
