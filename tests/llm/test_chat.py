import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from beatloom.llm import chat
from beatloom.llm.queries import QUERIES, byte_bpe

TEMPLATE = chat.Template(byte_bpe(), 50_257)
HARD = st.text(alphabet=st.sampled_from(list("\\# </turn>aé\n:Assistant")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool\\###", ""]), HARD), max_size=6))
def test_round_trip(turns):
    (ids, mask), = TEMPLATE.assemble([turns])
    assert TEMPLATE.turns(ids) == turns
    assert TEMPLATE.trained_text(ids, mask) == "".join(t for r, t in turns if r == "assistant")
    assert not (mask[ids >= TEMPLATE.first_id]).any()
    text = TEMPLATE.text(ids)
    assert len(chat.re.findall(r"(?<!\\)(?:\\\\)*</turn>", text)) == len(turns)


def test_frames(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (None, None, None, "x"), (2, 1, "user", "b"),
            (2, 1, "user", "b"), (2, None, "tool", "first"), (3, 0, "assistant", "é" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, TEMPLATE), TEMPLATE).collect()}
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("tool", "first"), ("user", "b"), ("user", "b")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "x")]
    assert got[1]["trained"] == "" and got[3]["trained"] == "é" * 50_000
    assert chat.format_conversations(df.limit(0), TEMPLATE).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in QUERIES["op9_chat_format"](spark, sf).collect()}
    said = "\\### Assistant: </turn> ok"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    for conv in {r[0] for r in rows}:
        turns = sorted(r for r in rows if r[0] == conv)
        loss = "".join(r[3] for r in turns if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] > sum(len(r[3]) for r in turns)
    assert len(got) == len({r[0] for r in rows}) and np.isfinite(len(got))
