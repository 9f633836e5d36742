"""Quality rules (operator 10): weak supervision over rule votes, in DataFrame functions only.

Every rule reads a document's counts and votes good (+1), bad (-1) or abstains (0).  Counts that measure the
same thing are one rule, so that no signal votes twice; the rule on symbols has a second, stronger bad vote
(-2) instead.  The votes of all documents are counted per vote pattern (at most 3 ** rules rows, whatever the
corpus).  Expectation-maximisation over those counts estimates how often each rule votes what on good
documents and on each kind of bad ones (``KINDS``: a document is bad in one way, and lacking the signs of
another way makes it no better; a kind shows at least one of its signs), and the posterior probability of "good" is the verdict, in place of an
all-rules-must-pass filter.  One weak sign leaves a document; two signs, or the stronger vote, don't.
The posterior is evaluated as a column expression.

Defined cases: a null text has no words (all counts 0, ``base_failed`` true); an empty table keeps the
starting accuracies; repeated rows and ids are judged row by row; other columns are neither read nor
changed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_SPACE = "[\\x20\\x09-\\x0D]"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SIGNALS = [*_COUNTS, "n_lines", "n_upper", "n_exclaim"]
WINDOW = 5
ITERATIONS = 50
#: Kinds of bad documents and the rules that tell them.
KINDS = {"fragments": ("length", "word_length"), "symbols": ("symbols",), "copies": ("dup_lines", "repeats"), "shouting": ("capitals", "exclaims")}
#: Starting point of the estimate: share of good documents (the kinds share the rest), P(vote | good), and
#: P(vote | bad) of the rules that tell the kind; the other rules vote on it as on good documents.
START_PRIOR = 0.9
START_GOOD = {-1: 0.02, 0: 0.5, 1: 0.48}
START_BAD = {-1: 0.5, 0: 0.35, 1: 0.15}
#: The same for symbols: -1 a symbol to four words (tables, prices and code have them too), -2 two to five words (single
#: words between separators, words wrapped in symbols).
START_SYMBOLS = ({-2: 0.0005, -1: 0.02, 0: 0.9795}, {-2: 0.5, -1: 0.3, 0: 0.2})
STARTS = {"symbols": START_SYMBOLS}
#: Weight of the starting point: it counts as if this share of the corpus had been judged by it, at every size.
BELIEF = 0.05


def _dropped(text: Column, chars: str) -> Column:
    """Occurrences of the given ASCII characters."""
    return (F.octet_length(text) - F.octet_length(F.translate(text, chars, ""))).cast("long")


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two structs per row: ``_row`` (all columns of ``docs``) and ``_q`` (``_SIGNALS`` of the whole text)."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.select(F.struct("*").alias("_row"), F.struct(
        raw.alias("t"),
        F.array_remove(F.split(raw, _SPACE + "+"), "").alias("w"),
        F.filter(F.split(raw, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines")).alias("_q"))
    w = F.col("_q.w")
    step = step.withColumn("_q", F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _dropped(F.col("_q.t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_q.lines") - F.size(F.array_distinct("_q.lines"))).cast("long").alias("n_dup_lines"),
        F.size("_q.lines").cast("long").alias("n_lines"),
        _dropped(F.col("_q.t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _dropped(F.col("_q.t"), "!").alias("n_exclaim"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("h")))
    h = F.col("_q.h")
    windows = F.when(F.size(h) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("_q", F.struct(F.col("_q").dropFields("h").alias("s"), windows.alias("win")))
    # only a text with an equal pair of windows pays for sorting (hash, position)
    win = F.col("_q.win")
    ordered = F.when(F.size(F.array_distinct(win)) < F.size(win),
                     F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    step = step.withColumn("_q", F.struct(F.col("_q.s").alias("s"), ordered.alias("o")))
    o = F.col("_q.o")
    again = F.filter(o, lambda e, k: (
        ((k > 0) & (F.get(o, k - 1)["x"] == e["x"])) | F.coalesce(F.get(o, k + 1)["x"] == e["x"], F.lit(False))))
    step = step.withColumn("_q", F.struct(
        F.col("_q.s").alias("s"), F.sort_array(F.transform(again, lambda e: e["i"])).alias("p")))
    covered = F.aggregate(
        F.col("_q.p"), F.struct(F.lit(0).cast("long").alias("c"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["c"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("c"), p.alias("last")),
        lambda a: a["c"])
    return step.withColumn("_q", F.col("_q.s").withField("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))))


def votes(q) -> dict[str, Column]:
    """Rule -> vote: 1 good, 0 abstains, -1 bad, and of symbols also -2."""
    words = F.greatest(q["n_words"], F.lit(1))
    lines = F.greatest(q["n_lines"], F.lit(1))

    def bad(condition: Column) -> Column:
        return F.when(condition, -1).otherwise(0)

    return {
        "length": F.when(q["n_words"] < 10, -1).when(q["n_words"] >= 20, 1).otherwise(0),
        "word_length": F.when(~q["word_chars"].between(2 * words, 16 * words), -1)
                        .when(q["word_chars"].between(3 * words, 10 * words), 1).otherwise(0),
        "symbols": F.when(5 * q["n_symbols"] > 2 * words, -2).otherwise(bad(4 * q["n_symbols"] > words)),
        "dup_lines": bad(4 * q["n_dup_lines"] > lines),
        "repeats": bad(5 * q["n_repeat_words"] > words),
        "capitals": bad(2 * q["n_upper"] > q["word_chars"]),
        "exclaims": bad(4 * q["n_exclaim"] > words),
    }


def shares(cast: tuple[int, ...], kinds: list[int], priors: list[float], good: list[dict], bad: list[dict]) -> list[float]:
    """Posterior of every class (good first) given a document's votes; a kind without any of its bad votes has none."""
    signs = {0, *(k for k, v in zip(kinds, cast) if v < 0)}
    logs = {c: math.log(priors[c]) + sum(math.log(b[v] / g[v]) for v, k, g, b in zip(cast, kinds, good, bad) if k == c) for c in signs}
    top = max(logs.values())
    mass = [math.exp(logs[c] - top) if c in signs else 0.0 for c in range(len(priors))]
    return [m / sum(mass) for m in mass]


def estimate(patterns: list[tuple[tuple[int, ...], int]], starts: list[tuple[dict, dict]],
             kinds: list[int]) -> tuple[list[float], list[dict], list[dict]]:
    """EM over (votes, count) patterns: the share of every class, and per rule P(vote | good) and P(vote | its kind).

    Class 0 is "good", class k the k-th kind of bad.  ``starts`` holds a rule's starting P(vote | good) and
    P(vote | bad), ``kinds`` the kind that it tells; on other kinds it votes as on good documents.  A rule is
    never taken to vote bad more often on good documents than on its kind (nor good more often on its
    kind), which keeps the classes what they are.
    """
    prior = [START_PRIOR] + [(1 - START_PRIOR) / max(kinds)] * max(kinds)
    priors, good, bad = prior, [g for g, _ in starts], [b for _, b in starts]
    total = sum(count for _, count in patterns)
    weight = max(1.0, BELIEF * total)
    for _ in range(ITERATIONS):
        mass = [weight * p for p in prior]
        seen = [[{v: weight * prior[c] * p for v, p in table.items()} for c, table in ((0, g), (k, b))] for (g, b), k in zip(starts, kinds)]
        for cast, count in patterns:
            post = shares(cast, kinds, priors, good, bad)
            for c, p in enumerate(post):
                mass[c] += p * count
            for (g, b), v, k in zip(seen, cast, kinds):
                g[v] += post[0] * count
                b[v] += post[k] * count
        priors = [m / (weight + total) for m in mass]
        good, bad = ([{v: n / sum(table.values()) for v, n in table.items()} for table in side] for side in zip(*seen))
        for g, b in zip(good, bad):
            for v in g:
                low, high = (g, b) if v < 0 else (b, g)
                low[v] = min(low[v], high[v]) if v else low[v]
    return priors, good, bad


def _posterior(cast: dict[str, Column], kinds: list[int], priors: list[float], good: list[dict], bad: list[dict]) -> Column:
    """P(good): per kind with a sign, the votes' likelihood against that of "good"."""
    against = F.lit(0.0)
    for c in range(1, len(priors)):
        odds, sign = F.lit(math.log(priors[c] / priors[0])), F.lit(False)
        for vote, k, g, b in zip(cast.values(), kinds, good, bad):
            if k == c:
                weight = F.lit(math.log(b[0] / g[0]))
                for v in g:
                    weight = F.when(vote == v, math.log(b[v] / g[v])).otherwise(weight)
                odds, sign = odds + weight, sign | (vote < 0)
        against = against + F.when(sign, F.exp(odds)).otherwise(0.0)
    return 1 / (1 + against)


def judged(rows: DataFrame) -> DataFrame:
    """Adds ``_p`` (posterior of good), ``_base`` (base rule failed) and ``_kept`` to rows that carry ``_q``.

    ``rows`` is read twice (vote counts, verdicts), so hand in a written table.
    """
    cast = votes(F.col("_q"))
    counted = rows.groupBy(*[v.alias(k) for k, v in cast.items()]).agg(F.count(F.lit(1)).alias("_n"))
    patterns = sorted((tuple(r[k] for k in cast), r["_n"]) for r in counted.collect())  # at most 3 ** rules rows
    told = {rule: i for i, rules in enumerate(KINDS.values(), 1) for rule in rules}
    kinds = [told[rule] for rule in cast]
    priors, good, bad = estimate(patterns, [STARTS.get(rule, (START_GOOD, START_BAD)) for rule in cast], kinds)
    base = (F.col("_q.n_words") < 10) | (100 * F.col("_q.n_repeat_words") > 20 * F.col("_q.n_words"))
    return (rows.withColumn("_p", _posterior(cast, kinds, priors, good, bad)).withColumn("_base", base)
            .withColumn("_kept", ~F.col("_base") & (F.col("_p") >= 0.5)))


def quality_scores(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the counts, ``base_failed``, ``kept`` and the posterior ``p_good``."""
    rows = written(with_signals(docs.select("doc_id", "text")).select("_row.doc_id", "_q"), "quality")
    return judged(rows).select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in _SIGNALS],
                               F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_p").alias("p_good"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    rows = written(with_signals(docs), "quality")
    return judged(rows).where("_kept").select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    from .common import table
    return quality_scores(table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept")
