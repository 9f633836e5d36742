"""Structure repair against a plain search over all edit strings; auction prices against relaxation; blocks; odd rows."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from sparklog.llm import repair

ROWS = "conv_id long, turn long, role string, text string, pos string, block string"


def damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        kept += [(turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, fault):
    """(cost, letters) of the cheapest, then ASCII-least edits: every continuation of every (turn, kept pattern so far)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}  # initials that may come after the last kept one

    @cache
    def best(i, last, inserted):
        options = [(0, "")] if i == len(turns) and last in ("", "a") else []
        if inserted < 3:
            for x in "ua":
                if x in follows[last]:
                    cost, rest = best(i, x, inserted + 1)
                    options.append((cost + 3, "I" + rest))
        if i < len(turns):
            cost, rest = best(i + 1, last, 0)
            options.append((cost + 4, "D" + rest))
            if fault[i] not in ("blank", "duplicate"):
                extra = 3 if fault[i] == "truncated" else 0
                first = turns[i][1][:1]
                if first and first in follows[last]:
                    cost, rest = best(i + 1, first, 0)
                    options.append((cost + extra, "K" + rest))
                for x in "ua":
                    if x in follows[last]:
                        cost, rest = best(i + 1, x, 0)
                        options.append((cost + extra + 3, "R" + rest))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def apply(turns, audit):
    out, i, last = [], 0, ""
    for e in audit:
        new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if e == "I":
            out.append((new, ""))
        else:
            _, role, text = turns[i]
            i += 1
            if e == "D":
                continue
            out.append((role if e == "K" else new, text))
        last = out[-1][0][0]
    assert i == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def brute(rows):
    out = []
    for conv, turns in damage(rows).items():
        f = faults(turns)
        numbers = {t for t, _, _ in turns if t is not None}
        cost, audit = cheapest(tuple(turns), tuple(f))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        lines = "\n".join(f"{r}:{t}" for r, t in apply(turns, audit))
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, f.count("blank"), f.count("duplicate"),
                    f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rnd, rows = random.Random(8), []
    texts = ["Fine.", "Really?", "cut off", "", " \n\t", None, "é漢!", "Same text.", "a:b\nc. \x0b", "ends with space.  "]
    for conv in range(160):
        n, good = rnd.randint(1, 12), rnd.random()
        for i in range(n):
            role = ("user", "assistant")[i % 2] if rnd.random() < good else rnd.choice(["user", "assistant", "system", "tool", "", None, "sys", "\U0001f600"])
            rows.append((conv, rnd.choice([i, i + rnd.randint(0, 3), None if i == 0 else i]), role, rnd.choice(texts) if rnd.random() > good else f"Turn {i}.", "x", "x"))
    rows += [(900, i, ("user", "assistant")[i % 2], f"t{i}" + "." * (i % 5 > 0), "x", "x") for i in range(120)]
    rows += [(None, 1, "user", "No id.", "x", "x"), (None, None, None, None, "x", "x"), (901, 0, "user", "Repeated row.", "x", "x")] * 2
    rows += [(902, None, "user", "All turns are null.", "x", "x"), (903, 5, "assistant", "long " * 300_000 + ".", "x", "x")]
    rows += [(-1000, i, "user", "x.", "x", "x") for i in range(1000) if zlib.crc32(f"-1000:{i}".encode()) % 20 == 0]  # all dropped
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [0, 2, 10])
def test_against_a_plain_search(spark, tmp_path, bits):
    rows = odd_rows()
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, repair.op11_repair(spark, str(tmp_path), bits).collect()), key=str)
    want = brute(rows)
    assert [g for g, w in zip(got, want) if g != w] == [] and len(got) == len(want)


def test_prices_are_distances():
    ends = [(a, b, c, d) for a in (0, 3, 9) for b in (0, 4) for c in (0, 3, 7) for d in (0, 1, 50)]
    for code in range(13):
        for ahead in ends if code < 12 else [(0, 0, 0, 0)]:
            dist = [10**6] * 4
            for _ in range(8):  # relaxation
                dist = [min(c + (ahead[s] if on else dist[s]) for _, c, on, s in repair.arcs(code, q)) for q in range(4)]
            assert list(repair.prices(code, ahead)) == dist


def test_long_conversation_in_blocks(spark):
    rnd = random.Random(4)
    rows = [(1, i, rnd.choice(["user", "assistant", "assistant", "system"]), f"text {i % 900}" + rnd.choice([".", ".", ""])) for i in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [(t, r, x) for _, t, r, x in rows]
    plans = []
    for bits in (4, 10):
        flags = repair.flagged(repair.ordered(df))
        parts = sorted(repair.edits_of(flags, bits).collect(), key=lambda r: r["block"])
        plans.append((parts[0].cost, "".join(p.audit for p in parts)))
    assert plans[0] == plans[1]
    out = repair.repair_conversations(df).collect()
    assert [(r.role, r.text) for r in out] == apply(turns, plans[0][1]) and [r.turn for r in out] == list(range(1, len(out) + 1))
    fault, cost, i = faults(turns), 0, 0
    for e in plans[0][1]:
        cost += {"I": 3, "D": 4, "R": 3, "K": 0}[e] + (3 if e in "KR" and fault[i] == "truncated" else 0)
        i += e != "I"
    assert cost == plans[0][0]


def test_sound_conversations_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (2, 7, "user", "Q?"), (2, 9, "assistant", "A.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.role, r.text) for r in repair.repair_conversations(df).collect()) == sorted((c, r, t) for c, _, r, t in rows)


def test_empty(spark):
    assert repair.repair_conversations(spark.createDataFrame([], ROWS)).collect() == []
