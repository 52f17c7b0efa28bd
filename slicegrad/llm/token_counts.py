"""Token counts of a byte-pair model by merging ragged arrays, all sequences in step.

A text is cut into pre-tokens that no piece of the vocabulary can join. The distinct pre-tokens of a batch are laid
out in one array of symbol ids with the number of its sequence beside each symbol. In every round each sequence's
lowest-rank pair is merged, in all sequences at once; sequences without a pair leave the array. What is left of a
sequence are its tokens; a symbol outside the vocabulary counts one token per UTF-8 byte, as the byte fallback does.

The library merges the best pair, leftmost first. A round merges all equal pairs of a sequence from the left, up to
the first whose result makes an equally good or better pair with a neighbour. Long sequences without white space so
need about as many rounds as they use distinct ranks, not one per symbol.

Defined results: null counts as empty, an empty text has no tokens; any text length is counted whole; rows are kept
one by one, other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicegrad.llm.common import text_of

#: Remembered pre-tokens per task; beyond, the memory starts anew.
MEMORY = 400_000
#: Symbols that a round works on at most, one long sequence excepted.
ROUND_SYMBOLS = 1 << 20
SPACE = "▁"


class MergeCounter:
    """Counts the tokens of texts under a BPE model file whose normaliser changes nothing but spaces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        pieces = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
        inner = [p for p in pieces if SPACE in p.lstrip(SPACE) or "\n" in p]
        special = any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces)
        if (
            norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces
            or not trainer.byte_fallback or trainer.model_type != trainer.BPE or special or inner
        ):
            raise ValueError("the model normalises, joins words or lacks the byte fallback; its counts would differ")
        scores = sorted(set(pieces.values()), reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        names = list(pieces)
        number = {p: i for i, p in enumerate(names)}
        rank = np.array([rank_of[pieces[p]] for p in names], np.int64)
        keys, merged = [], []
        for piece, i in number.items():
            for k in range(1, len(piece)):
                a, b = number.get(piece[:k]), number.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b), merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int64)[order], len(names))  # one more piece for 'no such pair'
        self.rank, self.none = np.append(rank, len(scores)), len(scores)
        self.letters = {p: i for p, i in number.items() if len(p) == 1}
        self.known: dict[str, int] = {}
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def split(self, text: str) -> list[str]:
        """Pre-tokens: no piece holds a line break, or a space after something else."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.split(text) for text in texts]
        if len(self.known) > MEMORY:
            self.known = {}
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        new.sort(key=len)  # sequences of a round are about equally long
        at = 0
        while at < len(new):
            stop, held = at, 0
            while stop < len(new) and (stop == at or held + len(new[stop]) <= ROUND_SYMBOLS):
                held += len(new[stop])
                stop += 1
            known.update(zip(new[at:stop], self.merge(new[at:stop])))
            at = stop
        return [sum(map(known.__getitem__, parts)) for parts in cut]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 (ranked last) where there is none."""
        pair = np.where((left >= 0) & (right >= 0), left << 32 | np.maximum(right, 0), -1)
        found = np.searchsorted(self.keys, pair)
        return np.where(self.keys[found] == pair, self.merged[found], -1)

    def merge(self, parts: list[str]) -> list[int]:
        """Tokens of each pre-token; see the module's text."""
        letters = self.letters
        sizes = np.array([len(p) for p in parts])
        symbols = np.array([letters.get(c, -1) for p in parts for c in p], np.int64)
        seq = np.repeat(np.arange(len(parts)), sizes)
        out = np.zeros(len(parts), np.int64)
        if (symbols < 0).any():  # outside the vocabulary: bytes, which nothing joins
            wide = np.array([len(c.encode("utf-8", "surrogatepass")) for p in parts for c in p])
            np.add.at(out, seq[symbols < 0], (wide - 1)[symbols < 0])
        while len(seq):
            same = seq[:-1] == seq[1:]
            piece = np.append(self.joined(np.where(same, symbols[:-1], -1), symbols[1:]), -1)  # of the pair starting here
            rank = self.rank[piece]
            first = np.flatnonzero(np.diff(seq, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(first, append=len(seq))
            done = best == self.none
            if done.any():
                out[seq[first[done]]] += length[done]
            want = np.repeat(best, length)
            at = np.flatnonzero((rank == want) & (want < self.none))
            if not len(at):
                break
            owner = seq[at]
            # of pairs that overlap (aaa), each second one is merged, counted from the first of the run
            chain = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
            step = np.arange(len(at)) - np.repeat(chain, np.diff(chain, append=len(at)))
            at, owner = at[step % 2 == 0], owner[step % 2 == 0]
            # the first merge of a sequence that brings forth a pair as good or better ends its round
            now = piece[at]
            left = np.where((at > 0) & (seq[at - 1] == owner), symbols[at - 1], -1)
            beside = np.flatnonzero((np.diff(at, prepend=-3) == 2) & (np.diff(owner, prepend=-1) == 0))
            left[beside] = now[beside - 1]
            after = np.minimum(at + 2, len(seq) - 1)
            right = np.where((at + 2 < len(seq)) & (seq[after] == owner), symbols[after], -1)
            new = np.minimum(self.rank[self.joined(left, now)], self.rank[self.joined(now, right)])
            ends = (new <= rank[at]).astype(np.int64)
            lead = np.flatnonzero(np.diff(owner, prepend=-1))
            before = np.cumsum(ends) - ends
            take = before == np.repeat(before[lead], np.diff(lead, append=len(at)))
            at, now = at[take], now[take]
            symbols[at] = now
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            keep &= ~np.repeat(done, length)
            symbols, seq = symbols[keep], seq[keep]
        return out.tolist()


def _count(path: str, batches):
    counter = MergeCounter(path)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            counts = counter.counts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(counts, pa.int64())], names=["key", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` of every document, whole texts, without begin or end tokens."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("text"))
    return slim.mapInArrow(partial(_count, model), f"key {slim.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long")
