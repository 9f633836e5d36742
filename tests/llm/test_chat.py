"""Chat formatting: paths of reply trees against a plain walk, reversible template, loss mask, odd rows."""
from __future__ import annotations

import random

from sparklog.llm import chat

MSG = "conv_id long, msg_id long, parent_id long, role string, text string, score double, m string"


def walk(rows):
    """conv -> {leaf: [messages root first]}"""
    by = {}
    for r in sorted(rows, key=lambda r: (r[3] or "", r[4] or "", r[5] or 0)):
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], {}).setdefault(r[1], r)
    out = {}
    for conv, msgs in by.items():
        parents = {r[2] for r in msgs.values()}
        for leaf in msgs:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in msgs:
                path.append(msgs[at])
                at = msgs[at][2]
            out.setdefault(conv, {})[leaf] = path[::-1]
    return out


def tree_rows():
    rnd, rows = random.Random(3), []
    for conv in range(25):
        for i in range(rnd.randint(1, 40)):
            rows.append((conv, i, rnd.randrange(i) if i else None, rnd.choice(["user", "assistant", "sys: #x"]),
                         rnd.choice([None, "", "a\\b#<c", "### user: x</turn>\n", "é漢 text", "\\h\\\\l"]), round(rnd.random(), 3), "x"))
    rows += [(30, i, i - 1 if i else None, "assistant", f"t{i}", 1.0, "x") for i in range(300)]       # one long chain
    rows += [(31, 0, 77, "user", "unknown parent", None, "x"), (31, 0, 77, "user", "unknown parent", None, "x")]
    rows += [(32, 0, 1, "user", "cycle", 0.0, "x"), (32, 1, 0, "user", "cycle", 0.0, "x")]
    rows += [(None, 0, None, "user", "no conversation", 0.0, "x"), (33, 0, None, None, None, None, "x")]
    return rows


def test_every_path_and_the_best_branch(spark):
    rows = tree_rows()
    want = walk(rows)
    got = chat.format_chats(spark.createDataFrame(rows, MSG), None)
    from pyspark.sql import functions as F
    back = got.select("conv_id", "leaf_id", "rank", chat.parse_chat(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {(r.conv_id, r.leaf_id) for r in back} == {(c, x) for c, p in want.items() for x in p}
    for r in back:
        path = want[r.conv_id][r.leaf_id]
        assert [(t.role, t.text) for t in r.turns] == [(m[3] or "", m[4] or "") for m in path]
        assert r.loss == "".join(m[4] or "" for m in path if m[3] == "assistant")
    mean = {(c, x): sum(m[5] or 0 for m in p) / len(p) for c, ps in want.items() for x, p in ps.items()}
    for r in chat.format_chats(spark.createDataFrame(rows, MSG)).collect():
        best = min(want[r.conv_id], key=lambda x: (-round(mean[r.conv_id, x], 9), x))
        assert abs(mean[r.conv_id, best] - r.score) < 1e-9 and r["rank"] == 1


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], MSG)).count() == 0
