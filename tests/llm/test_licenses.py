"""License scan against a plain scan of every window; altered, cut and repeated statements; odd rows."""
from __future__ import annotations

import random
import re

from sparklog.llm import licenses as lic

DOC = "doc_id long, text string, matches string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=lic.TEMPLATES):
    w, out = words(text), set()
    for name, t in templates.items():
        v = words(t)
        if not v:
            continue
        n = min(5, len(v))
        want = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
        sh = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        step, width = max(1, len(want) // 2), len(want) + -(-len(want) // 2)
        for s in range(0, max(1, len(sh)), step):
            if 100 * len(want & set(sh[s:s + width])) >= 75 * len(want):
                out.add(name)
    return ",".join(sorted(out))


def rows():
    rnd = random.Random(3)
    noise = lambda n: " ".join(rnd.choice(["the", "license", "under", "work", "mit", "free", "é"]) + str(rnd.choice(["", 1])) for _ in range(n))
    out = [(0, None), (1, ""), (2, "..."), (3, "mit license")]
    for i in range(4, 200):
        parts = [noise(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            v = rnd.choice(list(lic.TEMPLATES.values())).split()
            for _ in range(rnd.choice([0, 0, 1, 4])):
                v[rnd.randrange(len(v))] = "changed"
            a = rnd.choice([0, 0, len(v) // 3])
            parts += [" ".join(v[a:]).upper() if rnd.random() < .3 else " ".join(v[a:]), noise(rnd.randint(0, 40))]
        out.append((i, " ".join(parts)))
    out.append((5, (lic.TEMPLATES["MIT"] + " ") * 400))
    return out


def found(df):
    return sorted((r.doc_id, r.n_words, ",".join(sorted({m.license for m in r.matches}))) for r in df.collect())


def test_against_a_plain_scan(spark):
    docs = rows()
    got = lic.license_matches(spark.createDataFrame([(d, t, "c") for d, t in docs], DOC))
    assert found(got) == sorted((d, len(words(t)), brute(t)) for d, t in docs)


def whole(text, templates):
    """The licenses that the registered scan states: windows by a plain scan of every start, best held template first."""
    known = lic.Templates(templates)
    w = words(text)
    windows = []
    for i, name in enumerate(known.names):
        v = words(templates[name])
        n = min(5, len(v))
        want = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)}
        step, width = max(1, len(want) // 2), len(want) + -(-len(want) // 2)
        signs = [words(p) for p in lic.deciding(name)]
        need = [{g for g in want if any(g[k:k + len(p)] == tuple(p) for k in range(n))} if len(p) <= n else
                None for p in signs]
        need = [{tuple(p[k:k + n])} for p, x in zip(signs, need) if x is None for k in range(len(p) - n + 1)] + [x for x in need if x is not None]
        sh = [tuple(w[k:k + n]) for k in range(len(w) - n + 1)]
        for s in range(0, max(1, len(sh)), step) if want & set(sh) else ():
            if 100 * len(want & set(sh[s:s + width])) >= 75 * len(want):
                windows.append((i, n, want, need, s, min(s + width, len(sh)), len(v)))
    owner, used, out = [None] * len(w), {}, set()

    def claim(i, n, want, need, s, e, length):
        who = lic.license_of(known.names[i])
        ok = [owner[k] in (None, who) and k not in used.get(i, ()) for k in range(len(w))]
        at = [k for k in range(s, e) if tuple(w[k:k + n]) in want and all(ok[k:k + n])]
        kinds = {tuple(w[k:k + n]) for k in at}
        if 100 * len(kinds) < 75 * len(want) or not all(kinds & x for x in need):
            return None
        runs = []
        for a, k in enumerate(at):
            left = set(kinds)
            for m in at[a:]:
                left.discard(tuple(w[m:m + n]))
                if not left:
                    runs.append((m - k + n, k))
                    break
        return (-len(kinds) / len(want), -length, *min(runs))

    while True:
        best = min(((c, k) for k, x in enumerate(windows) if (c := claim(*x))), default=None)
        if best is None:
            return ",".join(sorted(out))
        (_, _, n, first), k = best
        i = windows[k][0]
        out.add(lic.reported(known.names[i]))
        owner[first:first + n] = [lic.license_of(known.names[i])] * n
        used.setdefault(i, set()).update(range(first, first + n))


def test_registered_scan_against_a_plain_scan(spark, small_docs, tmp_path):
    every = {**lic.TEMPLATES, **lic.SIBLINGS, **lic.TEXTS}
    rnd = random.Random(8)
    docs = [(d, t) for d, t in rows() if d < 30 and t is not None and len(t) < 4000]
    for d in range(1000, 1040):
        parts = []
        for _ in range(3):
            v = every[rnd.choice(sorted(every))].split()
            for _ in range(rnd.choice([0, 0, 1])):
                v[rnd.randrange(len(v))] = "changed"
            parts += [" ".join(v), "other words stand here"[:rnd.choice([0, 5, 22])]]
        docs.append((d, " ".join(parts)))
    docs += [(r.doc_id + 2000, r.text) for r in small_docs.collect()]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_words, r.n_licenses, r.licenses) for r in lic.op7_license_scan(spark, str(tmp_path)).collect()}
    want = set()
    for d, t in docs:
        names = whole(t, every)
        want.add((d, len(words(t)), len(names.split(",")) if names else 0, names))
    assert got == want and sum(bool(x[3]) for x in want) > 45


def test_only_the_bands_retrieve():
    """Without the band tables nothing is found; each template is returned by them for its own text."""
    every = {**lic.TEMPLATES, **lic.SIBLINGS, **lic.TEXTS}
    known = lic.Templates(every)
    data = " . ".join(every.values()).encode()
    scan = lic.Words(lic.np.frombuffer(data, lic.np.uint8), lic.np.array([0, len(data)]), lic.ALNUM, lic.LOWER)
    assert {m[1] for m in known.find(scan)} == set(every)
    known.tables = {k: [(v[:0], m[:0]) for v, m in t] for k, t in known.tables.items()}
    assert known.find(scan) == [] and known.stated(scan) == []


def test_place_of_a_match(spark):
    text = "some words before " + lic.TEMPLATES["GPL-3.0"] + " and after it"
    m = lic.license_matches(spark.createDataFrame([(1, text, "")], DOC)).first().matches
    assert [(x.license, x.start, x.words, x.containment) for x in m] == [("GPL-3.0", 3, 12, 1.0)]


def test_short_and_empty_templates_and_tables(spark, edge_docs, no_docs, small_docs):
    few = {"short": "two words", "none": " ... "}
    assert [d for d, _, x in found(lic.license_matches(edge_docs, few)) if x] == [6, 6, 7]
    assert lic.license_matches(no_docs).count() == 0
    assert found(lic.license_matches(small_docs)) == sorted((r.doc_id, len(words(r.text)), brute(r.text)) for r in small_docs.collect())


def stated(spark, texts):
    df = lic.license_statements(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOC))
    return [",".join(sorted({m.license for m in r.matches})) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_siblings_are_not_taken_for_each_other(spark):
    gnu = {"GPL-2.0": ("program", "", "2"), "GPL-3.0": ("program", "", "3"), "LGPL-2.1": ("library", "Lesser ", "2.1"),
           "LGPL-3.0": ("program", "Lesser ", "3"), "AGPL-3.0": ("program", "Affero ", "3")}
    notice = ("This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
              "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. ")
    line = "This work is licensed under the GNU {}General Public License, version {}. "
    tail = "It comes without any warranty; see the GNU General Public License for more details, of which version 3 is one."
    cases = [(notice.format(w, n, v) + tail, f"{k}-notice") for k, (w, n, v) in gnu.items()]
    cases += [("Some words. " + line.format(n, v) + "More of them.", k) for k, (_, n, v) in gnu.items()]
    cases += [(line.format("", 2) + line.format("", 3), "GPL-2.0,GPL-3.0"), (line.format("", 7), ""), (notice.format("program", "", "9"), ""),
              (lic.TEMPLATES["MIT-permission"].replace("deal in", "deal with"), "NCSA"),
              (lic.TEMPLATES["Apache-2.0-notice"].replace("Apache", "Other"), ""),
              ((lic.TEMPLATES["MIT"] + " ") * 400, "MIT")]
    cases += [(t, ",".join(sorted({n, "Apache-2.0"} if n == "Apache-2.0-notice" else {n}))) for n, t in lic.TEMPLATES.items()]
    assert stated(spark, [t for t, _ in cases]) == [x for _, x in cases]


def test_usual_licenses_are_known(spark):
    texts = lic.TEXTS
    assert [x for x, n in zip(stated(spark, [f"Words before. {t} and after" for t in texts.values()]), texts) if lic.license_of(n) not in
            {y.removesuffix("-notice").removesuffix("-statement") for y in x.split(",")}] == []
    cases = [("SPDX-License-Identifier: MIT-0", "MIT-0"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
             ("SPDX-License-Identifier: MIT", "MIT"), ("released under CC BY-SA 4.0.", "CC-BY-SA-4.0"), (texts["BSD-3-Clause~text"], "BSD-3-Clause"),
             ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
             (texts["ISC~text"], "ISC"), (texts["0BSD~text"], "0BSD"), ("a license for MIT students", "")]
    assert stated(spark, [t for t, _ in cases]) == [x for _, x in cases]
