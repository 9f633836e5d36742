"""ATT&CK technique mapping (J04, J05, U02, M01, J11) and the technique table queries.

A log maps to an ordered list: the technique of its Windows event id first, then the
technique of every keyword contained in ``lower(message) + ' ' + lower(event_type)``
in rule order; a rule only counts when its technique exists in the techniques table,
and the first entry of the list is stored.

Rules are a DataFrame whatever their number.  Up to ``DIRECT_RULES`` of them (the reference
has 24) become conditions of the scan, in rule order, in generated code.  Of more, event ids are an
equi-join and keywords go through an inverted index: each key stands under the rarest of its own 3-grams (a shorter
key under itself), the logs' grams are joined with the index on equality, and ``contains``
confirms the few (log, key) pairs that meet.  Before the join a table of one byte per hash
slot, of fixed size, drops the grams that stand in no index entry, so a log without
candidates sends no row.  Matches are combined per log by a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R

RULE_SCHEMA = "rule_order int, kind string, rule_key string, technique_id string"
RULE_FIELDS = ["rule_order", "rule_key", "technique_id", "tactic"]
#: Characters of an index gram.
GRAM = 3
#: Hash slots of the pre-filter (one byte each; its size does not grow with the rules).
SLOTS = 1 << 15
#: Rules that are tested one by one in the scan; more go through joins.
DIRECT_RULES = 256


def default_rules(spark: SparkSession) -> DataFrame:
    """The reference rule set as a DataFrame (event-id rules first, then keywords)."""
    rows = []
    # later duplicate event id wins: keep the last entry of each id
    last_for_id = {}
    for i, (eid, tech) in enumerate(R.EVENT_TECHNIQUE_RULES):
        last_for_id[eid] = (i, tech)
    for eid, (i, tech) in sorted(last_for_id.items(), key=lambda kv: kv[1][0]):
        rows.append((0, "event_id", eid, tech))
    for i, (kw, tech) in enumerate(R.KEYWORD_TECHNIQUE_RULES, start=1):
        rows.append((i, "keyword", kw, tech))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def resolved_rules(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """Rules whose technique exists, with the technique's tactic (J04 'must exist')."""
    t = techniques.select("technique_id", "tactic")
    return rules.join(t, "technique_id", "inner")


def _text(logs_cols=("message", "event_type")) -> Column:
    return F.concat(F.lower(F.coalesce(F.col("message"), F.lit(""))), F.lit(" "),
                    F.lower(F.coalesce(F.col("event_type"), F.lit(""))))


def _grams(text: Column, n: int) -> Column:
    """Distinct ``n``-character substrings (of one pass over the characters)."""
    if n == 0:
        return F.array(F.lit(""))
    chars = F.split(text, "")
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, k + 1, 1 << 30), lambda a, b: F.concat(a, b))   # null past the end
    return F.array_distinct(F.array_compact(out))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def keyword_index(live: DataFrame) -> DataFrame:
    """(gram, rule_key, rule_order, technique_id, tactic): every keyword rule under its rarest gram."""
    grams = F.when(F.char_length("rule_key") >= GRAM, _grams(F.col("rule_key"), GRAM)).otherwise(F.array("rule_key"))
    keys = live.filter(F.col("kind") == "keyword").groupBy("rule_key").agg(F.collect_list(F.struct("rule_order", "technique_id", "tactic")).alias("r"))
    every = keys.select("rule_key", "r", F.explode(grams).alias("gram"))
    counted = every.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("gram")))
    chosen = counted.groupBy("rule_key").agg(F.min(F.struct("n", "gram")).alias("m"), F.first("r").alias("r"))
    return chosen.select(F.col("m.gram").alias("gram"), "rule_key", F.inline("r"))


def _direct_rules(live: DataFrame) -> list[Row] | None:
    """The resolved rules in rule order, None of more than ``DIRECT_RULES``."""
    rows = live.select("kind", *RULE_FIELDS).limit(DIRECT_RULES + 1).collect()
    if len(rows) > DIRECT_RULES:
        return None
    rows = [r for r in rows if r["rule_key"] is not None and r["kind"] in ("event_id", "keyword")]
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in RULE_FIELDS))


def _conditions(logs: DataFrame, rules: list[Row], key: str) -> tuple[DataFrame, list[Column]]:
    """The logs' key, event id and lower-cased text (computed once a row), and a condition per rule on them."""
    texts = logs.select(key, "event_id", _text().alias("_text"))
    return texts, [F.col("event_id") == r["rule_key"] if r["kind"] == "event_id" else F.col("_text").contains(r["rule_key"]) for r in rules]


def _rule(rules: list[Row], place: Column) -> Column:
    """The rule at a 0-based ``place`` as a struct (a constant array, null for a null place)."""
    return F.try_element_at(F.array(*[F.struct(
        F.lit(r["rule_order"]).cast("int").alias("rule_order"),
        *[F.lit(r[c]).cast("string").alias(c) for c in RULE_FIELDS[1:]]) for r in rules]), place + 1)


def matching_rules(logs: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """(key, rule_order, rule_key, technique_id, tactic): every resolved rule that a log meets."""
    rules = _direct_rules(live)
    if not rules:
        return _joined_rules(logs, live, key)
    texts, met = _conditions(logs, rules, key)
    hits = texts.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(met)]))).alias("_i"))
    return hits.select(key, _rule(rules, F.col("_i")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in RULE_FIELDS])


def _first_rules(logs: DataFrame, live: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """Rows (key, _b), one for every key with a match, and the first rule (a struct) as a column of it."""
    rules = _direct_rules(live)
    if not rules:
        best = _joined_rules(logs, live, key).groupBy(key).agg(
            F.min_by(F.struct("technique_id", "tactic"), F.struct("rule_order", "rule_key")).alias("_b"))
        return best, F.col("_b")
    texts, met = _conditions(logs, rules, key)
    place = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(met)])   # rules stand in order: a row's first
    # no filter on the place: it would be pushed below the exchange that deals the logs out, and tested in the few tasks there
    best = texts.groupBy(key).agg(F.min(place).alias("_b"))
    return best, _rule(rules, F.col("_b"))


def _joined_rules(logs: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """``matching_rules`` of any number of rules."""
    by_id = live.filter(F.col("kind") == "event_id").select(F.col("rule_key").alias("event_id"), "rule_order", "technique_id", "tactic")
    out = [key, "rule_order", "rule_key", "technique_id", "tactic"]
    found = logs.select(key, "event_id").join(by_id, "event_id").withColumnRenamed("event_id", "rule_key").select(*out)
    index = keyword_index(live).persist()   # read by the filter and by the join
    slots = index.select(_slot(F.col("gram")).alias("s"), F.char_length("gram").alias("n")).distinct().collect()   # at most 4 x SLOTS rows
    if not slots:
        return found
    used = bytearray(SLOTS)
    for r in slots:
        used[r["s"]] = 1
    table = F.lit(bytes(used))
    texts = logs.select(key, _text().alias("_text"))
    grams = F.concat(*[_grams(F.col("_text"), n) for n in sorted({r["n"] for r in slots})])
    hits = texts.select(key, "_text", F.explode(F.filter(
        grams, lambda g: F.substring(table, _slot(g) + 1, F.lit(1)) == F.lit(b"\x01"))).alias("gram"))
    return found.unionByName(hits.join(index, "gram").filter(F.col("_text").contains(F.col("rule_key"))).select(*out))


def map_techniques(logs: DataFrame, techniques: DataFrame, rules: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Add ``mitre_technique_id`` and ``mitre_tactic`` (first existing match) to ``logs``.

    ``key`` names the logs' unique id; a row without one gets no mapping.
    """
    rules = rules if rules is not None else default_rules(logs.sparkSession)
    # technique and tactic come from the same rule
    best, first = _first_rules(logs, resolved_rules(rules, techniques), key)
    return (logs.join(best, key, "left")
            .select(*[logs[c] for c in logs.columns], first["technique_id"].alias("mitre_technique_id"),
                    first["tactic"].alias("mitre_tactic")))


def technique_list(logs: DataFrame, techniques: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The whole ordered, de-duplicated technique list of every log (id, techniques)."""
    rules = rules if rules is not None else default_rules(logs.sparkSession)
    matches = matching_rules(logs, resolved_rules(rules, techniques))
    lists = matches.groupBy("id").agg(F.array_distinct(F.transform(
        F.sort_array(F.collect_list(F.struct("rule_order", "rule_key", "technique_id"))), lambda m: m["technique_id"])).alias("techniques"))
    return logs.select("id").join(lists, "id", "left").select("id", F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"))


def update_anomaly_techniques(anomalies: DataFrame, mapped_logs: DataFrame) -> DataFrame:
    """Every anomaly row of a log gets that log's mapping (all sessions), else keeps its own."""
    m = mapped_logs.select(F.col("id").alias("_lid"),
                           F.col("mitre_technique_id").alias("_tid"),
                           F.col("mitre_tactic").alias("_tac"))
    out = anomalies.join(m, anomalies["log_id"] == m["_lid"], "left")
    return (out.withColumn("mitre_technique_id", F.coalesce("_tid", "mitre_technique_id"))
               .withColumn("mitre_tactic", F.coalesce("_tac", "mitre_tactic"))
               .drop("_lid", "_tid", "_tac"))


# ------------------------------------------------------------- technique table
def load_attack_bundle(spark: SparkSession, path: str) -> DataFrame:
    """STIX bundle -> technique rows (attack-pattern objects with an ATT&CK id)."""
    bundle = spark.read.option("multiLine", True).json(path)
    obj = bundle.select(F.explode("objects").alias("o")).select("o.*")
    cols = set(obj.columns)

    def opt(name: str, dtype: str) -> Column:
        return F.col(name) if name in cols else F.lit(None).cast(dtype)

    refs = opt("external_references", "array<struct<source_name:string,external_id:string>>")
    phases = opt("kill_chain_phases", "array<struct<phase_name:string>>")
    first_ref = F.try_element_at(F.filter(refs, lambda r: r["source_name"] == "mitre-attack"), F.lit(1))
    first_phase = F.try_element_at(phases, F.lit(1))
    out = (obj.filter(F.col("type") == "attack-pattern")
           .select(first_ref["external_id"].alias("technique_id"),
                   F.coalesce(opt("name", "string"), F.lit("")).alias("technique_name"),
                   F.when(F.size(F.coalesce(phases, F.array())) > 0,
                          F.regexp_replace(F.coalesce(first_phase["phase_name"], F.lit("")), "-", "_"))
                    .otherwise(F.lit("unknown")).alias("tactic"),
                   F.coalesce(opt("description", "string"), F.lit("")).alias("description"),
                   F.coalesce(opt("x_mitre_platforms", "array<string>"), F.array().cast("array<string>")).alias("platforms"),
                   F.coalesce(opt("x_mitre_data_sources", "array<string>"), F.array().cast("array<string>")).alias("data_sources"),
                   F.struct(opt("created", "string").alias("created"),
                            opt("modified", "string").alias("modified"),
                            opt("x_mitre_version", "string").alias("version")).alias("metadata"))
           .filter(F.col("technique_id").isNotNull() & (F.col("technique_id") != "")))
    return out


def techniques_by_tactic(techniques: DataFrame, tactic: str) -> DataFrame:
    """techniques of one tactic ordered by name."""
    return techniques.filter(F.col("tactic") == tactic).orderBy("technique_name")


def all_tactics(techniques: DataFrame) -> DataFrame:
    """Distinct tactics in order."""
    return techniques.select("tactic").distinct().orderBy("tactic")


def search_techniques(techniques: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """name or description contains q (LIKE semantics without wildcards), name order, limit."""
    return (techniques.filter(F.col("technique_name").contains(q) | F.col("description").contains(q))
            .orderBy("technique_name").limit(limit))
