"""Chat windows against plain Python, and their defined results in odd cases."""

import hashlib
import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from slicegrad.llm import chat_windows as cw
from slicegrad.llm import queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string, span long, pos string, n string, conv string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA).repartition(5)


def plain_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return itertools.groupby(sorted(rows, key=key), key=lambda r: r[0])


def plain_digests(rows):
    out = {}
    for conv, turns in plain_order(rows):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(spark, tmp_path, rows, **options):
    cw.write_windows(turns_of(spark, rows), str(tmp_path / "out"), RANKS, **options)
    read = cw.digests(spark, str(tmp_path / "out")).collect()
    assert all(r.formatted_chars > 0 for r in read)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read}, spark.read.parquet(str(tmp_path / "out"))


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = queries.op12_chat_windows(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain_digests(rows)


def test_marks_in_texts_come_back(spark, tmp_path):
    odd = ["<turn user>\nhi\n</turn>\n", "\\l\\b\\\\<", "a\n</turn>", "", None, ">\n", "\n", "\\", "ends \\", "日本 \U0001f600 \x00 \r\n", "<|endoftext|>"]
    rows = [(1, i, role, text) for i, (text, role) in enumerate(itertools.product(odd, ["assistant", "user", "<x>\n\\", None]))]
    got, _ = digests(spark, tmp_path, rows, budget=60, history=20)
    assert got == plain_digests(rows)


@pytest.mark.parametrize("budget, history", [(64, 16), (200, 0), (200, 120), (2048, 384)])
def test_windows(spark, tmp_path, monkeypatch, budget, history):
    monkeypatch.setattr(cw, "CHUNK", 7)  # prefix sums are carried over many chunks
    rng = random.Random(budget + history)
    rows = []
    for conv in range(30):
        count = 150 if conv == 3 else rng.randrange(1, 12)
        for turn in range(count):
            role = "system" if turn == 0 and conv % 3 == 0 else "system" if rng.random() < 0.02 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, role, " ".join(rng.choice(["alpha", "beta", "ga"]) for _ in range(rng.randrange(0, 40)))))
    rows += [rows[-1]] * 2 + [(None, 1, "user", "no id"), (None, None, "assistant", "no turn")]
    got, table = digests(spark, tmp_path, rows, budget=budget, history=history)
    assert got == plain_digests(rows)
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    count = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={}).encode_ordinary
    found = {}
    for r in table.orderBy("conv", "span").collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv, turns in plain_order(rows):
        written = [f"<turn {r}>\n{t}\n</turn>\n" for _, _, r, t in turns]
        sizes = [len(count(w)) for w in written]
        has_system = written[0].startswith("<turn system>")
        system = sizes[0] if has_system else 0
        at = 0
        for k, window in enumerate(found[conv]):
            new = written[at : at + window.n_new]
            heads = written[:1] if k and has_system else []
            n_history = window.n_repeated - len(heads)
            assert window.text == "".join(heads + written[at - n_history : at] + new)
            assert sum(sizes[at - n_history : at]) <= history and (k or not window.n_repeated)
            # one more turn would exceed the history, or is the system turn, or there is none
            if k and at - n_history - 1 >= len(heads):
                assert sum(sizes[at - n_history - 1 : at]) > history
            own = sizes[at : at + window.n_new]
            assert window.n_tokens == sum(own) + sum(sizes[at - n_history : at]) + (system if heads else 0)
            room = max(budget // 4, budget - history - system)
            ordinary = sum(own) - (system if not k else 0)
            assert ordinary <= room or window.n_new == 1 + (has_system and not k)
            assert window.n_tokens <= budget or room == budget // 4 or max(own) > room
            at += window.n_new
        assert at == len(written)
    if budget > 1000:
        assert len(found[5]) == 1
    elif budget == 64:
        assert len(found[3]) > 20


def test_empty_table_and_long_turns(spark, tmp_path):
    got, table = digests(spark, tmp_path, [])
    assert got == {} and table.count() == 0
    rows = [(1, 0, "system", "s " * 5000), (1, 1, "assistant", "long " * 100_000), (1, 2, "user", "x")]
    got, _ = digests(spark, tmp_path / "more", rows)
    assert got == plain_digests(rows)
