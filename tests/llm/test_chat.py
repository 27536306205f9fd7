"""Formatted conversations read back, and held to the turns they came from."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example long, block long, kind string, tie long, place long, task int, new string"


def turns(spark, rows):
    """Conversations with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4, 5, "n") for r in rows], SCHEMA)


ODD = ["", "a", "\\", "\\\\", "</turn>", "\n</turn>\n", "<turn user>\n", "\\### Assistant: </turn> ok", "x\n", "\n", "é 日本", "\\<turn", "<tur", "n>", ">", "<turn\\"]


def made(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "assistant"]), "".join(rng.choices(ODD, k=rng.randint(0, 5)))))
    rows += [(100, 0, None, None), (100, 1, "we<turn>ird\\", "x"), (100, 2, "assistant", None), (None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (101, None, "user", "first"), (101, -1, "assistant", "then")]
    return rows


def plain(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t, role or "", text or ""))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda x: (x[0], x[1] or 0))
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(examples):
    got = chat.chat_digests(examples).collect()
    out = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}
    assert len(out) == len(got)
    return out, {r["conv_id"]: r["formatted_chars"] for r in got}


@pytest.mark.parametrize("points", [chat.BLOCK_POINTS, 40, 1])
def test_round_trip_whole_and_in_blocks(spark, points):
    rows = made(3)
    random.Random(1).shuffle(rows)
    found, chars = digests(chat.chat_examples(turns(spark, rows).repartition(3), block_points=points))
    assert found == plain(rows)
    assert chars == digests(chat.chat_examples(turns(spark, rows)))[1]


@pytest.mark.parametrize("points", [chat.BLOCK_POINTS, 60])
def test_each_reply_is_an_example_with_all_before_it(spark, points):
    """Blocks and an example's own text are the turns up to the reply; the mask is the reply and nothing else."""
    rows = made(4)
    by = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0], r[1])):
        by[c].append((role or "", text or ""))
    got = defaultdict(list)
    for r in chat.chat_examples(turns(spark, rows).where("conv_id is not null and conv_id < 100"), block_points=points).orderBy("conv_id", "example").collect():
        got[r["conv_id"]].append(r)
    assert set(got) == {c for c in by if c is not None and c < 100}
    for c, own in got.items():
        blocks = [(r["block"], r["text"]) for r in own if r["kind"] == "block"]
        replies = [k for k, (role, _) in enumerate(by[c]) if role == "assistant"]
        examples = [r for r in own if r["kind"] == "reply"]
        assert len(examples) == len(replies)
        for r, k in zip(examples, replies, strict=True):
            before = "".join(t for b, t in blocks if b < r["block"])
            assert chat.read_turns(before + r["text"]) == by[c][: k + 1]
            assert chat.unescaped(r["text"][r["loss_start"] : r["loss_end"]]) == by[c][k][1]
            assert r["text"][r["loss_end"] :] == "\n</turn>\n"


def test_control_strings_come_back():
    for text in [*ODD, *(a + b for a in ODD for b in ODD)]:
        assert chat.unescaped(chat.escaped(text)) == text
        assert chat.read_turns(f"{chat.opening(text)}{chat.escaped(text)}\n</turn>\n" * 2) == [(text, text)] * 2


def test_one_conversation_over_many_tasks(spark):
    """A third of all rows in one conversation: no task gets them all, nothing is lost, work stays linear."""
    rows = [(7, t, ["user", "assistant"][t % 2], f"turn {t} " * 20) for t in range(3000)] + [(100 + k, 0, "user", "q") for k in range(6000)]
    df = turns(spark, rows).repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        examples = chat.chat_examples(df, block_points=20_000)
        tasks = examples.where("conv_id = 7").select((F.col("example") / F.lit(2**40)).cast("int").alias("t")).distinct().count()
        assert tasks >= 4
        assert examples.where("conv_id = 7").agg(F.sum(F.length("text"))).first()[0] < 100 * 3000 * 170
        assert digests(examples)[0] == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table_and_repeated_rows(spark):
    assert chat.chat_examples(turns(spark, [])).collect() == []
    assert chat.chat_digests(chat.chat_examples(turns(spark, []))).collect() == []
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b" * 3_000_000), (1, 2, "user", "tail")]
    assert digests(chat.chat_examples(turns(spark, rows)))[0] == plain(rows)
