"""Quality rules: counts against a plain loop, the estimate against planted accuracies, filtering."""
from __future__ import annotations

import math
import random
import re

from sparklog.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


COMMON = ({-1: 0.02, 0: 0.5, 1: 0.48}, {-1: 0.5, 0: 0.35, 1: 0.15})
SYMBOLS = ({-2: 0.0005, -1: 0.02, 0: 0.9795}, {-2: 0.5, -1: 0.3, 0: 0.2})
SIGNS = [(), (0, 1), (2,), (3, 4), (5, 6)]  # votes that tell: good, fragments, symbols, copies, shouting


def cast(text):
    """The votes of one text, counted by hand."""
    n, chars, symbols, dup, again = brute(text)
    text, w = text or "", max(n, 1)
    lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n")))
    upper, exclaims = sum("A" <= c <= "Z" for c in text), text.count("!")
    return (-1 if n < 10 else int(n >= 20),
            -1 if not 2 * w <= chars <= 16 * w else int(3 * w <= chars <= 10 * w),
            -2 if symbols / w > 2 / 5 else -(4 * symbols > w),
            -(dup / lines > 1 / 4), -(again / w > 1 / 5), -(chars < 2 * upper), -(exclaims / w > 1 / 4))


def verdicts(texts):
    """kept of every text: EM over single documents (not patterns) and the base rule."""
    ballots = [cast(t) for t in texts]
    start = [[(SYMBOLS if r == 2 else COMMON)[r in own] for r in range(7)] for own in SIGNS]
    share, tables = [0.9] + [0.025] * 4, start
    base = max(1.0, 0.05 * len(texts))

    def posterior(v):
        weight = [share[c] * math.prod(tables[c if r in own else 0][r][v[r]] for r in range(7)) if not c or any(v[r] < 0 for r in own) else 0
                  for c, own in enumerate(SIGNS)]
        return [w / sum(weight) for w in weight]

    for _ in range(50):
        post = [posterior(v) for v in ballots]
        now = []
        for c in range(5):
            begin = base * (0.9 if c == 0 else 0.025)
            now.append([])
            for r in range(7):
                n = {x: begin * start[c][r][x] + sum(q[c] for q, v in zip(post, ballots) if v[r] == x) for x in start[c][r]}
                now[c].append({x: m / sum(n.values()) for x, m in n.items()})
        for c, own in enumerate(SIGNS):
            for r in own:
                for x in now[0][r]:
                    if x < 0:
                        now[0][r][x] = min(now[0][r][x], now[c][r][x])
                    if x > 0:
                        now[c][r][x] = min(now[0][r][x], now[c][r][x])
        share = [(base * (0.9 if c == 0 else 0.025) + sum(q[c] for q in post)) / (base + len(texts)) for c in range(5)]
        tables = now
    out = []
    for t, v in zip(texts, ballots):
        n, _, _, _, again = brute(t)
        out.append(n >= 10 and 100 * again <= 20 * n and posterior(v)[0] >= 0.5)
    return out


def check(docs):
    got = sorted(quality.quality_scores(docs).select("doc_id", *quality._COUNTS, "base_failed", "kept").collect(), key=str)
    rows = docs.collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=str) == sorted(zip([r.doc_id for r in rows], verdicts([r.text for r in rows])), key=str)
    want = sorted(((r.doc_id, *brute(r.text)) for r in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_counts_equal_a_plain_loop(edge_docs, small_docs):
    check(edge_docs)
    check(small_docs)


def test_empty_table(no_docs):
    assert quality.quality_scores(no_docs).count() == 0
    assert quality.quality_filter(no_docs).columns == no_docs.columns


def test_filter_keeps_rows_and_columns_as_they_are(edge_docs):
    kept = quality.quality_filter(edge_docs)
    assert kept.schema.names == edge_docs.schema.names
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 1, 2, 15} <= set(ids) and not {3, 4, 5, 6, 7, 12, 13, 14, 17} & set(ids)


def test_estimate_recovers_planted_accuracies():
    rnd = random.Random(5)
    good, bad = [0.95, 0.9, 0.97, 0.8], [0.9, 0.7, 0.85, 0.8]
    counts: dict = {}
    for _ in range(20000):
        y = rnd.random() < 0.85
        votes = tuple(0 if rnd.random() < 0.1 else (1 if rnd.random() < a else -1) if y else (-1 if rnd.random() < b else 1)
                      for a, b in zip(good, bad))
        counts[votes] = counts.get(votes, 0) + 1
    (prior, _), g, b = quality.estimate(sorted(counts.items()), [COMMON] * 4, [1] * 4)
    assert abs(prior - 0.85) < 0.03
    assert all(abs(x[1] / (x[1] + x[-1]) - y) < 0.05 for x, y in zip(g, good))
    assert all(abs(x[-1] / (x[1] + x[-1]) - y) < 0.08 for x, y in zip(b, bad))


def test_documents_without_a_bad_vote_stay_whatever_the_corpus():
    starts, kinds = [COMMON, COMMON, SYMBOLS, COMMON, COMMON, COMMON, COMMON], [1, 1, 2, 3, 3, 4, 4]
    fine, odd, copied = (1, 1, 0, 0, 0, 0, 0), (1, 1, -2, 0, 0, 0, 0), (1, 1, 0, -1, -1, 0, 0)
    for n_fine, n_odd, n_copied in [(1000, 1, 1), (10, 1000, 10), (0, 50, 0), (10**9, 10**3, 10**8)]:
        model = quality.estimate([(p, n) for p, n in ((fine, n_fine), (odd, n_odd), (copied, n_copied)) if n], starts, kinds)
        verdicts_of = [quality.shares(p, kinds, *model)[0] >= 0.5 for p in (fine, odd, copied)]
        assert verdicts_of[0] and (n_fine < n_odd or not any(verdicts_of[1:]))


def test_symbol_rich_clean_documents_stay(spark, small_docs):
    """Tables, code and lists hold a symbol to three or four words; without a second bad sign they are kept."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    table = "\n".join(f"| {word()} {word()} {word()} {word()} | {word()} {word()} {word()} | {i * 7} |" for i in range(20))
    code = "\n".join(f"if ({word()} < {word()} && {word()} > {word()}) {word()} {word()} {word()} {word()}" for i in range(12))
    list_ = "\n".join(f"* {word()} {word()}" for _ in range(12))
    assert all(cast(t)[2] == -1 for t in (table, code, list_))
    rich = [(900001 + i, t) for i, t in enumerate((table, code, list_))]
    docs = small_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rich, "doc_id long, text string"))
    kept = {r.doc_id: r.kept for r in quality.quality_scores(docs).collect()}
    assert all(kept[i] for i, _ in rich)


def test_labels_agree(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_scores(docs).join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    print(len(clean), sum(clean), len(junk), sum(junk))
    assert sum(clean) / len(clean) > 0.97 and sum(junk) / len(junk) < 0.05
