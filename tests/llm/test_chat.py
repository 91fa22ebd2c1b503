import hashlib

from hypothesis import given, settings, strategies as st
import pyarrow as pa

from meshspark.llm import chat
from meshspark.llm.shared import QUERIES

piece = st.lists(st.sampled_from(["\\", "#", "### ", "</turn>", "\n", "<", "/turn>", ": ", "é", "x", "<\\/turn>", "𝒳"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(piece, piece), min_size=1, max_size=6))
def test_round_trip(turns):
    out, offsets, start, end = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    text = out.tobytes().decode()
    assert chat.parse(text) == turns
    assert text.count("</turn>\n") == len(turns)
    for (_, t), a, b in zip(turns, start, end):
        assert chat.unescape(out[a:b].tobytes().decode()) == t


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role, text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 3, "user", "x" * 300000 + "#"),
            (2, 2, "assistant", "é"), (2, 4, "assistant", "</turn>")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, part int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(turns)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (1, 0), 1: (3, 0), 2: (3, 8)}
    assert got[2].loss_sha256 == hashlib.sha256("é</turn>".encode()).hexdigest()
    assert chat.format_chats(turns.limit(0)).count() == 0
