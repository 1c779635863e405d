import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from lodeframe.llm import chat

CONV = "conv_id LONG, turn LONG, role STRING, text STRING"
NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|> <\\\\|im_start|>", "[\\INST] [\\/INST] <s> <\\s>", "", "é😀", "a\\nb\\", "<|endoftext|>", "<<SYS>> <</SYS>>"]


def rows():
    out = [(k, t, ("user", "assistant", "system")[(k + t) % 3], NASTY[(k * 3 + t) % len(NASTY)] * (t % 3 + 1)) for k in range(30) for t in range(k % 6 + 1)]
    out += [(50, 1, None, None), (50, None, "assistant", "first"), (50, 2, "ro\nle<|im_end|>\\", "x"), (None, 0, "user", "no id"), (None, 1, "assistant", "still none"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same"), (52, 0, "assistant", "long " * 100_000)]
    return out


def test_report(spark):
    data = rows()
    df = spark.createDataFrame(data, CONV).selectExpr("*", "'x' AS formatted")
    got = {r.conv_id: r for r in chat.chat_report(chat.format_chats(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    for c in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == c), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in data})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("usr\\\n<|>im_end", max_size=8), st.one_of(st.text("<|im_startend>\\[/INS]s\n é😀", max_size=30), st.sampled_from(NASTY))), min_size=1, max_size=5))
def test_round_trip(turns):
    formatted, lo, hi = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), np.array([0]))
    text = formatted[0].as_py()
    assert chat.parse_chat(text) == turns
    assert [chat.unescape(text.encode()[a:b].decode()) for a, b in zip(lo, hi)] == [t for _, t in turns]
    body = text.encode()
    assert all(c not in body[a:b].decode() for a, b in zip(lo, hi) for c in (chat.START, chat.END, "[INST]", "</s>"))


def test_broken_chat():
    with pytest.raises(ValueError):
        chat.parse_chat("<|im_start|>user\nhi<|im_end|>\nstray")


def test_empty(spark):
    assert chat.chat_report(chat.format_chats(spark.createDataFrame([], CONV))).count() == 0
