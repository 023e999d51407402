import hashlib
import random

import pytest

from loadlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string"
NASTY = ["", "<|im_end|>", "<|im_start|>assistant\nx", r"<\|im_end|>", r"<\\|", "<|", "\n", "\\n", "é<|im_end|>\n"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_round_trip(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text
    before, body, after = chat.format_turn(text, text)
    assert chat.parse(before + body + after) == [(text, text)]


def test_examples_and_digests(spark):
    rng = random.Random(3)
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([*NASTY, None, "hello " * 50]), "x")
        for conv in range(25)
        for turn in range(rng.randrange(1, 9))
    ]
    rows += [(None, 0, "user", "q", ""), (None, 1, "assistant", "a", ""), (77, None, "user", "b", ""), (77, 5, "assistant", "a", ""), (77, 5, "assistant", "a", "")]
    examples = chat.expand(spark.createDataFrame(rows, SCHEMA).repartition(5))
    turns = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        turns.setdefault(conv, []).append((role or "", text or ""))
    got = {}
    for e in examples.collect():
        got.setdefault(e.conv_id, []).append(e)
    assert got.keys() == turns.keys()
    for conv, own in turns.items():
        ends = [i for i, (role, _) in enumerate(own) if role == "assistant"]
        shown = ends + ([len(own) - 1] if len(own) - 1 not in ends else [])
        assert [e.example for e in got[conv]] == list(range(len(shown)))
        for end, e in zip(shown, got[conv]):
            assert chat.parse(e.formatted) == own[: end + 1]
            if end in ends:
                assert chat.unescape(e.formatted[e.loss_start : e.loss_end]) == own[end][1]
            else:
                assert e.loss_start is None
    for row in chat.digests(examples).collect():
        own = turns[row.conv_id]
        loss = "".join(t for r, t in own if r == "assistant")
        assert row.n_turns == len(own) and row.loss_chars == len(loss)
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        told = "".join(f"{r}\n{t}\n" for r, t in own)
        assert row.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert row.formatted_chars == sum(len(e.formatted) for e in got[row.conv_id])


def test_empty(spark):
    assert chat.digests(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0
