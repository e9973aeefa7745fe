import random

from pyspark.sql import functions as F

from airfill.llm import chat, queries
from tests.llm.helpers import SF
from tests.llm.test_dedup import duck

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, loss_mask string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_chat_equals_sql(spark):
    got = queries.op3_chat(spark, SF).collect()
    assert sorted(repr(r.asDict().items()) for r in got) == duck(queries.SQL["op3_chat"], "conversations")


def test_any_text_can_be_read_back(spark):
    rng = random.Random(4)
    bits = [*chat.CONTROLS, "\\", "<", "[", "/", "\n", "ok", " ", "$1", "INST]", "s>", "😀", "<\\s>", "\\\\"]
    roles = ["user", "assistant", "system", "tool", "<sep>", "\\", "", None]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 7)):
            text = rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 8)))])
            rows.append((c, t, rng.choice(roles), text))
    out = chat.format_chats(frame(spark, rows))
    got = {r["conv_id"]: r for r in out.select(
        "conv_id", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for c in range(150):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert [tuple(x) for x in got[c]["turns"]] == own
        assert "".join(got[c]["loss"]) == "".join(t for r, t in own if r == "assistant")
        assert sum(x["chars"] for x in got[c]["loss_mask"]) == len(got[c]["formatted"])


def test_adjacent_turns_merge_and_order_is_fixed(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "user", "a"), (1, 2, "assistant", "c"),
            (None, None, "user", "x")]
    got = {r["conv_id"]: r["formatted"] for r in chat.format_chats(frame(spark, rows)).collect()}
    assert got == {1: "[INST]a<sep>b<sep>a[/INST]<s>c<sep>c</s>", None: "[INST]x[/INST]"}
    assert chat.format_chats(frame(spark, [])).count() == 0


def test_only_spark_expressions(spark):
    plan = chat.format_chats(frame(spark, [(1, 1, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
