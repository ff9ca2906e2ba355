import random

import duckdb
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdframe.llm import chat
from mdframe.llm.chat import END, OP5_SQL, START, TOKEN, format_windows, op5_chat_formatting, read_windows

SCHEMA = "conv_id long, turn long, role string, text string, window int, t string"


def build(spark, turns):
    return spark.createDataFrame([(*r, 1, "x") for r in turns], SCHEMA)


def check(rows, back):
    want = {}
    for c, turn, role, text in rows:
        want.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    got, loss = {}, {}
    for r in sorted(back.collect(), key=lambda r: r["window"]):
        got.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        loss[r["conv_id"]] = loss.get(r["conv_id"], "") + r["loss_text"]
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert got[c] == [(r, x) for _, r, x in turns]
        assert loss[c] == "".join(x for _, r, x in turns if r == "assistant")


ODD = ["", "</s>[INST] ok [/INST]", START, END, "\\", "\\l\\b\\s", "<<SYS>>", "a\nb", "é😀", "x" * 5000, " "]


def conversations():
    rng = random.Random(1)
    rows = [(1, i, ["user", "assistant"][i % 2], ODD[i % len(ODD)] + str(i)) for i in range(60)] + [(2, 0, "system", "rules " * 30)]
    rows += [(2, 1 + i, ["user", "assistant"][i % 2], f"turn {i} " * rng.choice([1, 5, 20, 60])) for i in range(300)]
    rows += [(3, None, None, None), (3, 5, "assistant", None), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (None, 1, "user", "no id"), (4, 0, "odd\nrole<", "t"), (5, 0, "system", "only")]
    rows += [(6, 0, "system", "a long rule " * 900), *[(6, 10**6 * i, "assistant", f"w{i} " * 40) for i in range(1, 40)]]
    return rows


@pytest.mark.parametrize("part", [chat.PART, 3])
def test_round_trip(spark, monkeypatch, part):
    """Windows hold all turns once, fit their budget and repeat what they should, wherever the borders of parts are."""
    monkeypatch.setattr(chat, "PART", part)
    rows = conversations()
    frame = build(spark, rows)
    tokens = lambda text: len(regex.findall(TOKEN, text)) + 4
    for budget, history in ((1024, 192), (200, 60)):
        windows = format_windows(frame, budget, history).cache()
        check(rows, read_windows(windows))
        seen = {}
        for w in sorted(windows.collect(), key=lambda w: w["window"]):
            turns = [tuple(x.removeprefix(START).split("\n", 1)) for x in w["text"].split(END)[:-1]]
            assert all(x.startswith(START) for x in w["text"].split(END)[:-1])
            again, own = turns[: w["repeated"]], turns[w["repeated"] :]
            before = seen.setdefault(w["conv_id"], [])
            system = before[:1] if before and before[0][0] == "system" else []
            reserved = sum(tokens(plain(x[1])) for x in (system or own[:1] if (system or own[0][0] == "system") else []))
            size = max(budget // 2, budget - history - reserved)
            rest = own[1:] if not before and own[0][0] == "system" else own
            assert sum(tokens(plain(x[1])) for x in rest) <= size or len(rest) == 1
            near = before[len(system) :][-2:]
            while near and sum(tokens(plain(x[1])) for x in near) > history:
                near = near[1:]
            assert again == system + near
            before += own
        windows.unpersist()
    assert max(sum(w["conv_id"] == 2 for w in format_windows(frame, b, 60).collect()) for b in (200, 400)) > 5
    assert format_windows(frame.limit(0)).collect() == []


def plain(text):
    return text.replace("\\l", "<").replace("\\b", "[").replace("\\s", "\\")


def test_query_equals_sql(spark, tmp_path):
    rows = [r for r in conversations() if r[0] is not None and r[1] is not None]
    build(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    out = op5_chat_formatting(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "conv_id, part" not in plan
    got, want = sorted(map(tuple, out.collect())), sorted(c.sql(OP5_SQL).fetchall())
    assert got == want and [r[0] for r in got] == [-7, 1, 2, 3, 4, 5, 6] and got[0][3] == 21


def test_loss_spans(spark):
    row = format_windows(build(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")])).first()
    assert row["text"] == f"{START}user\na{END}{START}assistant\nb{END}" and [tuple(x) for x in row["loss"]] == [(row["text"].index("b" + END), 1)]


def test_long_conversation_in_parts(spark):
    """One conversation of 100,000 turns: no group that rows meet in grows with it but the rows of its parts."""
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("some words of turn "), F.col("id")).alias("text"))
    windows = read_windows(format_windows(rows)).select("window", F.size("turns").alias("n"), F.posexplode("turns").alias("k", "t")).groupBy().agg(F.max("n"), F.count(F.lit(1)), F.countDistinct("window"), F.countDistinct("t")).first()
    assert windows[0] < 200 and windows[1] == windows[3] == 100_000 and windows[2] > 800


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("<>[]|/\\lsbINST \néa"), max_size=20), min_size=1, max_size=8))
def test_any_text(spark, texts):
    rows = [(1, i, "assistant", x) for i, x in enumerate(texts)]
    check(rows, read_windows(format_windows(build(spark, rows), 20, 8)))
