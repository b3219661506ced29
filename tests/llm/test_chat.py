import hashlib
import random
import re

from pyspark.sql import functions as F

from tarnfold.llm import chat

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "[ESC]", "\\", " ", "\n", "<", "[", "é", "ok", " </s>", " [/INST]", "<s>[INST] ", "3 abc "]


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(5)
    rows = []
    for c in range(300):
        for t in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "us</s>er", "[ESC]", None])
            rows.append((c, t, role, rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))])))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(frame).collect()}
    out = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    for c in range(300):
        own = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        under = "".join(out[c].formatted[s.start : s.end] for s in out[c].spans)
        assert (re.sub(r"(?s)\\(.)", r"\1", under) if out[c].escaped else under) == loss
        assert got[c].formatted_chars == len(out[c].formatted) and out[c].escaped == out[c].formatted.startswith("[ESC]")


def test_plain_chats_stay_plain_and_masks_cover_the_answers(spark):
    frame = spark.createDataFrame([(1, 1, "assistant", "Hello </s there"), (1, 0, "user", "hi"), (None, 0, "user", "x" * 200000)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert got[1].formatted == "<s>[INST] hi [/INST] Hello </s there </s>" and not got[1].escaped
    assert [got[1].formatted[s.start : s.end] for s in got[1].spans] == ["Hello </s there"]
    assert len(got[None].formatted) == 200000 + 18


def test_empty_and_clashing(spark):
    frame = spark.createDataFrame([(1, None, None, None, "f"), (1, None, None, None, "f")], "conv_id long, turn long, role string, text string, formatted string")
    r = chat.digests(frame).first()
    assert r.n_turns == 2 and r.loss_chars == 0
    assert chat.digests(frame.limit(0)).count() == 0


def test_starts_of_many_turns_are_running_sums(spark):
    for n in (0, 1, 2, 3, 4, 5, 17, 1000):
        sizes = [i * i % 7 for i in range(n)]
        got = spark.createDataFrame([(sizes,)], "sizes array<int>").select(chat._sums(F.col("sizes")).alias("at")).first().at
        assert got == [sum(sizes[:i]) for i in range(n)]


def test_a_conversation_of_very_many_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"é{t}") for t in range(20000)]
    r = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    loss = "".join(x for _, _, role, x in rows if role == "assistant")
    assert r.n_turns == 20000 and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
