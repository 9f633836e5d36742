"""Conversation structure repair (operator 11): shortest edits by an auction algorithm over an integer-cost lattice.

Faulty turns (blank, duplicate, truncated) and broken role order are mended by the cheapest edits that leave the role
initials ``(s?(ua)+)?``: Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant turn.  A node
of the lattice is (turn, state): four states say what the kept roles so far end with.

1. Turns are ordered once (range-sorted by conversation and turn) and flagged; the first of equal (role, text) of
   a conversation is found by partial aggregation.  Up to ``2 ** BITS`` consecutive turns of a conversation are a
   block of one byte a turn, so a hot conversation is many rows.
2. Prices, from the last turn back: in the auction a path starts at a node, is extended along the arc
   that the prices make cheapest while its end's price equals that arc's, and else raises the price of its end and
   contracts; it is done when it meets a node with a converged price.  All of its nodes are then converged: a price
   is the least cost to the end, and the arcs whose cost is the difference of their prices are tight.  Blocks stream by,
   only the four prices at a block's front are carried to the block before.
3. From the first turn on, tight arcs are traced, the ASCII-least letter first (D, I, K, R), with the state as
   the only thing carried from block to block.
4. Edits and turns meet in one pass, sorted by conversation, that writes the repaired turns.

Defined cases: null role or text: one space; null turns come first; turns that tie are ordered by role, then text;
rows without a conv_id are one conversation; repeated rows are duplicates of the first; texts of any length stream
by; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, small_batches, table, written

#: A block holds up to ``2 ** BITS`` turns.
BITS = 10
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ROLES = "sua"
#: Role that a Rerole or Insert writes when it enters a state (2: after a user turn, 3: after an assistant turn).
NAMES = {"u": "user", "a": "assistant"}
#: States 0 (nothing kept), 1 (a system turn), 2, 3: where a user or assistant turn leads.
NEXT = (2, 2, 3, 2)
ENTERS = "--ua"
#: Kept roles: state before and after.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Code of a turn: 3 * (place of its role in ``ROLES``, 3 for any other) + (1 truncated, 2 must go); ``END`` follows the last.
END = 12


@lru_cache(None)
def arcs(code: int, state: int) -> tuple[tuple[str, int, bool, int], ...]:
    """Arcs (letter, cost, leads on to the next turn, state) out of a node, by letter."""
    insert = ("I", INSERT, False, NEXT[state])
    if code == END:
        return (("", 0, True, state), insert) if state in (0, 3) else (insert,)
    role, fault = divmod(code, 3)
    out = [("D", DELETE, True, state), insert]
    if fault < 2:
        to = KEEP[ROLES[role]].get(state) if role < 3 else None
        out += [("K", TRUNCATED * fault, True, to)] if to is not None else []
        out += [("R", REROLE + TRUNCATED * fault, True, NEXT[state])]
    return tuple(out)


@lru_cache(1 << 16)
def auction(code: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Converged prices of a turn's four nodes from those of the next turn's."""
    price, settled = [min(ahead)] * 4, set()  # no price above any arc's cost and the price it leads to
    for origin in range(4):
        path = [origin]
        while path[-1] not in settled:
            at = path[-1]
            cost, onward, to = min((c + (ahead[s] if o else price[s]), o, s) for _, c, o, s in arcs(code, at))
            if price[at] < cost:
                price[at] = cost
                if len(path) > 1:
                    path.pop()
            elif onward:
                break
            else:
                path.append(to)
        settled.update(path)
    return tuple(price)


def prices(code: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """``auction`` on prices relative to the least, of which there are few."""
    least = min(ahead)
    return tuple(least + p for p in auction(code, tuple(p - least for p in ahead)))


def trace(code: int, state: int, own: tuple[int, ...], ahead: tuple[int, ...]) -> tuple[str, int]:
    """Letters of the least tight arcs from a node until they lead on; the state there."""
    letters = ""
    while True:
        for letter, cost, onward, to in arcs(code, state):
            if own[state] == cost + (ahead[to] if onward else own[to]):
                break
        letters, state = letters + letter, to
        if onward:
            return letters, state


# ---------------------------------------------------------------- turns

def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos): ``pos`` rises with conversation, turn, role and text."""
    keys = ["conv_id", "turn", "role"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").withColumn("pos", F.monotonically_increasing_id()), "repair-turns")


def flagged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, fault, code): the first fault of every turn, or null."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = F.sha2(F.encode(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.char_length("role").cast("string"),
                                    F.lit(":"), "role", "text"), "UTF-8"), 256)
    initial = F.substring("role", 1, 1)
    light = written(rows.select("conv_id", "turn", "pos", same.alias("same"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
                                F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role")), "repair-flags")
    first = light.groupBy("same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return light.join(first, "same", "left").select("conv_id", "turn", "pos", fault.alias("fault"), "role").select(
        "conv_id", "turn", "pos", "fault", (F.col("role") * 3 + F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNull(), 0)
                                            .otherwise(2)).alias("code"))


def _conversations(batches):
    """Rows of sorted batches as dicts, with True at the first of a conversation."""
    last = object()
    for batch in batches:
        for row in batch.to_pylist():
            yield row, row["conv_id"] != last
            last = row["conv_id"]


def _batches(rows, schema: pa.Schema, size: int):
    """Dicts as batches of about ``size`` values (by the rows' own ``weight``)."""
    held, weight = [], 0
    for row, w in rows:
        held.append(row)
        weight += w
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_PRICED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("places", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())),
                     ("exits", pa.list_(pa.int64())), ("last", pa.bool_()), ("illegal", pa.int64())])
_EDITS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()),
                    ("edits", pa.list_(pa.struct([("pos", pa.int64()), ("step", pa.int32()), ("before", pa.string()), ("act", pa.string())])))])
#: Adjacent roles (places in ``ROLES``) that are in order.
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _backward(batches):
    """Blocks, last first -> the same with the prices behind their last turn and their pairs of roles out of order."""
    def rows():
        front = after = None
        for row, new in _conversations(batches):
            roles = [c // 3 for c in row["codes"]]
            if new:
                front, after = prices(END, (0, 0, 0, 0)), None
            pairs = list(zip(roles, roles[1:])) + ([(roles[-1], after)] if after is not None else [])
            yield {**row, "exits": list(front), "last": new, "illegal": sum(p not in _LEGAL for p in pairs)}, len(roles)
            for code in reversed(row["codes"]):
                front = prices(code, front)
            after = roles[0]

    yield from _batches(rows(), _PRICED, 1 << 16)


def _forward(batches):
    """Priced blocks, first first -> audit letters and the edit of every turn."""
    def rows():
        state = 0
        for row, new in _conversations(batches):
            layers = [tuple(row["exits"])]
            for code in reversed(row["codes"]):
                layers.append(prices(code, layers[-1]))
            layers.reverse()
            state = 0 if new else state
            cost, audit, edits = layers[0][0] if new else None, [], []
            steps = [(pos, 0, code, layers[i], layers[i + 1]) for i, (pos, code) in enumerate(zip(row["places"], row["codes"]))]
            if row["last"]:
                steps.append((row["places"][-1], 2, END, layers[-1], (0, 0, 0, 0)))
            for pos, step, code, own, ahead in steps:
                letters, to = trace(code, state, own, ahead)
                before = ""
                for _ in range(letters.count("I")):
                    state = NEXT[state]
                    before += ENTERS[state]
                act = letters.replace("I", "")
                edits.append({"pos": pos, "step": step, "before": before, "act": ENTERS[to] if act == "R" else act})
                audit.append(letters)
                state = to
            yield {"conv_id": row["conv_id"], "block": row["block"], "audit": "".join(audit), "cost": cost,
                   "illegal": row["illegal"], "edits": edits}, len(edits)

    yield from _batches(rows(), _EDITS, 1 << 16)


def edits_of(flags: DataFrame, bits: int = BITS) -> DataFrame:
    """(conv_id, block, audit, cost, illegal, edits) of every block; the cost stands at the conversation's first."""
    rows = flags.groupBy("conv_id", F.shiftright("pos", bits).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("t")).select("conv_id", "block", "t.pos", "t.code")
    blocks = rows.select("conv_id", "block", F.col("pos").alias("places"), F.col("code").alias("codes"))
    priced = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc()).mapInArrow(
        _backward, "conv_id long, block long, places array<long>, codes array<int>, exits array<long>, last boolean, illegal long")
    return written(priced.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        _forward, "conv_id long, block long, audit string, cost long, illegal long, "
                  "edits array<struct<pos:long,step:int,before:string,act:string>>"), "repair-edits")


def _applied(batches):
    """Edits and turns by place -> repaired turns, numbered from 1 in each conversation."""
    names = ["conv_id", "turn", "role", "text"]

    def rows():
        n, act = 0, ""
        for row, new in _conversations(batches):
            n = 0 if new else n
            lines = [(NAMES[c], "") for c in row["before"] or ""]
            if row["step"] != 1:
                act = row["act"]
            elif act != "D":
                lines = [(row["role"] if act == "K" else NAMES[act], row["text"])]
            for role, text in lines:
                n += 1
                yield dict(zip(names, (row["conv_id"], n, role, text))), 256 + len(text)

    yield from _batches(rows(), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]), 1 << 22)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired turns, in order inside a partition that holds the whole conversation."""
    steps = edits.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*").withColumns(
        {"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    turns = rows.select("conv_id", "pos", F.lit(1).alias("step"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("act"),
                        "role", "text")
    return (steps.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step")
            .mapInArrow(_applied, "conv_id long, turn long, role string, text string"))


def _digests(batches):
    """Repaired turns -> (conv_id, SHA-256 of their ``role:text`` lines)."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])

    def rows():
        of = None
        for row, new in _conversations(batches):
            if new:
                if of:
                    yield {"conv_id": of[0], "sha": of[1].hexdigest()}, 1
                of = row["conv_id"], hashlib.sha256()
            of[1].update(("" if new else "\n").encode() + f"{row['role']}:{row['text']}".encode())
        if of:
            yield {"conv_id": of[0], "sha": of[1].hexdigest()}, 1

    yield from _batches(rows(), schema, 1 << 14)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) repaired: the same columns, turns numbered from 1."""
    small_batches(turns.sparkSession)
    rows = ordered(turns)
    return repaired(rows, edits_of(flagged(rows)))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``."""
    space: Column = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(key) % 20).alias("c")).where("c <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.sequence(F.lit(1), F.when(F.col("c") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_repair(spark, sf_dir: str, bits: int = BITS) -> DataFrame:
    """Contract query: faults and repair of every damaged conversation."""
    small_batches(spark)
    conversations = table(spark, sf_dir, "conversations")
    rows = ordered(damaged(conversations))
    flags = written(flagged(rows), "repair-faults")
    edits = edits_of(flags, bits)
    # partial facts a conversation meet in one aggregation, in which null ids are one key
    counts = flags.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")])
    audits = edits.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    shas = repaired(rows, edits).mapInArrow(_digests, "conv_id long, sha string")
    facts = conversations.select("conv_id").distinct()
    for part in (counts, audits, shas):
        facts = facts.unionByName(part, allowMissingColumns=True)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return facts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in longs], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                        F.coalesce(F.max("sha"), F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _add(cost: str, letter: str, path: str) -> str:
    return f"lpad(CAST(CAST(left({path}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({path}, 10)"


def _turn(state: int) -> str:
    """Least continuation (cost of nine digits, then letters) of a state at a turn without inserting before it."""
    extra = f"{TRUNCATED} * cut"
    keeps = [f"CASE WHEN NOT gone AND c = '{r}' THEN {_add(extra, 'K', f'w{to[state]}')} ELSE 'z' END" for r, to in KEEP.items() if state in to]
    rerole = f"CASE WHEN gone THEN 'z' ELSE {_add(f'{REROLE} + {extra}', 'R', f'w{NEXT[state]}')} END"
    return f"least({', '.join([_add(str(DELETE), 'D', f'w{state}'), *keeps, rerole])}) AS x{state}"


#: From the last turn back every state keeps its least continuation, first by cost, then by letters.
ORACLE = rf"""
WITH RECURSIVE {CRC_SQL.format(keys="SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations")},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, c % 20 AS d FROM conversations
  JOIN crc32 ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE d <> 0),
r AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), FALSE) AS out FROM r),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CAST(fault = 'truncated' AS INT) AS cut FROM f),
w(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, max(i) + 1, '000000000', '000000006II', '000000003I', '000000000' FROM g GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(x0, {_add(str(INSERT), 'I', 'least(x2, y2)')}), least(x1, {_add(str(INSERT), 'I', 'least(x2, y2)')}), least(x2, y2), least(x3, y3)
  FROM (SELECT *, {_add(str(INSERT), 'I', 'x3')} AS y2, {_add(str(INSERT), 'I', 'x2')} AS y3
    FROM (SELECT g.conv_id, g.i, {', '.join(_turn(q) for q in range(4))} FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i - 1))),
a AS (SELECT conv_id, CAST(left(w0, 9) AS BIGINT) AS cost, substr(w0, 10) AS audit FROM w WHERE i = 1),
walk(conv_id, audit, k, i, q, line) AS (
  SELECT conv_id, audit, 0, 1, 0, CAST(NULL AS VARCHAR) FROM a
  UNION ALL
  SELECT conv_id, audit, k + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
    CASE e WHEN 'D' THEN q WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE n END,
    CASE e WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE n WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'I' THEN '' ELSE text END END
  FROM (SELECT walk.conv_id, audit, k, walk.i, q, substr(audit, k + 1, 1) AS e, CASE q WHEN 2 THEN 3 ELSE 2 END AS n, g.c, g.role, g.text
    FROM walk LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM walk.conv_id AND g.i = walk.i WHERE k < length(audit))),
p AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS sha FROM walk GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (out) AS illegal FROM g GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
"""
