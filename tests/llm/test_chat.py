"""The machine and its segments make the output of the chat query."""

import hashlib
import os

import duckdb

from segmill.llm import queries as lq
from segmill.llm.chat import digests, format_chats

D = "/root/testdata/sf0.001"


def test_fold_is_in_the_optimised_plan_of_the_query(spark):
    df = lq.op3_chat(spark, D)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "zip_with(" in plan and "Python" not in plan and "Arrow" not in plan
    # Segments come from the machine, and output and mask from the segments.
    assert {"valid", "error_turn"} <= set(df.columns)


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    p = f"{D}/conversations.parquet"
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    df = lq.op3_chat(spark, D)
    want = duck.sql(lq.oracle_sql()["op3_chat"])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=lambda r: r[0])


def test_orders_and_states(spark):
    def chat(*roles):
        return [(i, r, f"{r}{i}") for i, r in enumerate(roles)]

    cases = {
        1: (chat("user", "assistant"), True, None), 2: (chat("system", "user", "assistant", "user", "assistant"), True, None),
        3: (chat("user"), False, None), 4: (chat("user", "user", "assistant"), False, 1), 5: (chat("assistant", "user", "assistant"), False, 0),
        6: (chat("user", "tool", "assistant"), False, 1), 7: (chat("user", "assistant", "system", "user", "assistant"), False, 2),
    }
    rows = [(c, *x) for c, (turns, _, _) in cases.items() for x in turns] + [(None, 0, "user", "x"), (None, 1, "assistant", None)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, (turns, valid, error) in cases.items():
        r = got[c]
        assert (r.valid, r.error_turn) == (valid, error)
        # Also out of order every assistant text carries loss, and nothing else does.
        assert [s.text for s in r.segments if s.loss] == [x for _, role, x in turns if role == "assistant"]
        assert [r.formatted[m.start : m.start + m.length] for m in r.loss_mask] == [s.text for s in r.segments if s.loss]
    assert got[None].valid and got[None].formatted == "### User: x</turn>\n### Assistant: </turn>\n"


def test_a_giant_conversation(spark):
    n = 30_001
    rows = spark.range(n).selectExpr("9L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, ' \\\\ ### é') as text")
    r = digests(format_chats(rows)).first()
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i} \\ ### é") for i in range(n)]
    loss = "".join(x for role, x in turns if role == "assistant")
    assert (r.n_turns, r.valid, r.error_turn) == (n, False, None)
    assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
