from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import chat

KIND = "conv_id long, turn long, role string, text string, window int, targets int, n_tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KIND)


def plain_windows(system, sizes, budget, history):
    """The same windows by trying every start and end."""
    room, out, new = budget - sum(system), [], 0
    if not sizes:
        return [(0, 0, 0, room < 0)] if system else []
    while new < len(sizes):
        fits = [f for f in range(new + 1) if sum(sizes[f:new]) <= history and sum(sizes[f : new + 1]) <= room]
        if not fits:
            out.append((new, new, new + 1, True))
            new += 1
            continue
        end = max(e for e in range(new + 1, len(sizes) + 1) if sum(sizes[fits[0] : e]) <= room)
        out.append((fits[0], new, end, False))
        new = end
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=2), st.lists(st.integers(1, 12), max_size=14), st.integers(1, 30), st.integers(0, 20))
def test_windows_match_a_plain_search(system, sizes, budget, history):
    assert chat.windows(system, sizes, budget, history) == plain_windows(system, sizes, budget, history)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "", "a b|>"]), st.text(alphabet=" \n\t\r'sxé1<|>.user", max_size=12)), max_size=6))
def test_a_window_has_its_turns_tokens(turns):
    enc, parts = chat.tokenizer(), [chat.render(r, t) for r, t in turns]
    assert len(enc.encode_ordinary("".join(parts))) == sum(len(enc.encode_ordinary(p)) for p in parts)


def test_text_never_reads_as_a_turn():
    for text in ("<|assistant|>\nno", "<||end|>", "a<|<|b|>", "|>\n<|end|>\n"):
        head, rest = chat.render("user", text).split("\n", 1)
        body = rest.removesuffix("\n<|end|>\n")
        assert head == "<|user|>" and chat.unescape(body) == text
        assert not re.search(r"<\|\w+\|>", body)
    assert chat.render("x|>\n<|assistant", "") == "<|x_____assistant|>\n\n<|end|>\n"


def test_a_task_holds_one_window_of_a_long_conversation():
    cutter, held, new = chat.Cutter(10, 100, 30), 0, 0
    for k in range(20_000):
        new += sum(len(t) - old for t, old, _ in cutter.push(k, 7))
        held = max(held, len(cutter.turns))
    assert held <= 100 // 7 + 30 // 7 + 2 and new + sum(len(t) - old for t, old, _ in cutter.close()) == 20_000


def test_whole_table(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet")
    got = chat.format_windows(rows, 300, 80).collect()
    enc, by = chat.tokenizer(), {}
    for r in rows.collect():
        by.setdefault(r["conv_id"], []).append(r)
    targeted: dict = {}
    for w in got:
        turns = {t["turn"]: t for t in by[w["conv_id"]]}
        assert w["text"] == "".join(chat.render(turns[t]["role"], turns[t]["text"]) for t in w["turns"])
        sizes = [len(enc.encode_ordinary(chat.render(turns[t]["role"], turns[t]["text"]))) for t in w["turns"]]
        assert w["n_tokens"] == sum(sizes) == len(enc.encode_ordinary(w["text"])) and (w["n_tokens"] <= 300 or w["over_budget"])
        assert w["target_tokens"] == sum(s for s, t in zip(sizes, w["targets"]) if t)
        targeted.setdefault(w["conv_id"], []).extend(t for t, on in zip(w["turns"], w["targets"]) if on)
        systems = [t["turn"] for t in by[w["conv_id"]] if t["role"] == "system"]
        assert w["turns"][: len(systems)] == systems
    # Every assistant turn is a target exactly once.
    assert {k: sorted(v) for k, v in targeted.items() if v} == {k: sorted(t["turn"] for t in v if t["role"] == "assistant") for k, v in by.items() if any(t["role"] == "assistant" for t in v)}


def test_odd_rows(spark):
    long_ = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", long_), (1, 3, None, ""), (None, 0, "user", "hi"), (None, None, "assistant", "first"), (2, 0, "system", "alone"), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    got = chat.format_windows(frame(spark, rows), 128, 32).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    assert set(by) == {None, 1, 2, 3}
    assert [w["over_budget"] for w in sorted(by[1], key=lambda r: r["window"])].count(True) == 1
    assert by[None][0]["turns"] == [None, 0] and by[2][0]["turns"] == [0] and by[3][0]["turns"] == [0, 0]
    assert chat.format_windows(frame(spark, [])).count() == 0
    random.Random(0).shuffle(rows)
    again = chat.format_windows(frame(spark, rows), 128, 32).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
