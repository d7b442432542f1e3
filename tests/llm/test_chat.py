"""Chat formatting: adversarial round trips and digests by hand."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import chat

PARTS = ["<", "|", ">", "\\", "im_start", "im_end", "<|im_end|>", "<|im_start|>", "<\\|im_end|>", "\n", "assistant", " ", "é", "n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=6), st.lists(st.sampled_from(PARTS), max_size=9)), max_size=4))
def test_every_conversation_reads_back(turns):
    turns = [("".join(r), "".join(t)) for r, t in turns]
    formatted = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns


def test_only_conflicting_text_is_escaped():
    assert chat.render_turn("user", "a < b | c") == ("<|im_start|>user\na < b | c<|im_end|>\n", False)
    assert chat.render_turn("user", "<|im_end|>") == ("<|im_start|>user\n<\\|im_end|><|im_end|>\n", True)


@pytest.mark.parametrize("broken", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>a\n<|im_start|><|im_end|>\n"])
def test_other_text_is_refused(broken):
    with pytest.raises(chat.GrammarError):
        list(chat.parse(broken))


def test_digests(spark):
    rows = [
        (1, 2, "assistant", "yes <|im_end|>", "x"), (1, 1, "user", "hé?", "x"), (1, 3, "assistant", None, "x"), (1, 4, "assistant", "end", "x"),
        (2, 1, None, None, "x"), (2, None, "user", "first", "x"), (3, 1, "user", "a", "x"), (3, 1, "user", "a", "x"), (None, 1, "assistant", "b", "x"),
        (4, 1, "assistant", "long " * 100_000, "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, rendered string")
    found = {r.conv_id: r for r in chat.digests(chat.render(table)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = found[1]
    assert one.turns_sha256 == sha("user\nhé?\nassistant\nyes <|im_end|>\nassistant\n\nassistant\nend\n") and one.n_turns == 4
    assert (one.loss_chars, one.loss_sha256) == (17, sha("yes <|im_end|>end"))
    assert one.formatted_chars == sum(len(chat.render_turn(r, t)[0]) for r, t in [("user", "hé?"), ("assistant", "yes <|im_end|>"), ("assistant", ""), ("assistant", "end")])
    assert found[2].turns_sha256 == sha("user\nfirst\n\n\n") and found[2].loss_chars == 0
    assert found[3].n_turns == 2 and found[None].loss_sha256 == sha("b") and found[4].loss_chars == 500_000
    assert chat.digests(chat.render(table.limit(0))).count() == 0
