"""Source audit, ranked search and license scan against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from placewright.llm import lexical_search, license_scan, source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS, WORDS, SCANNED = (re.compile(p) for p in (r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
VOCABULARY = ["the", "of", "and", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)), "ÉTÉ", "été", "straße", "İ", "Kelvin", "naïve", "42", "7up"]


def terms_of(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


def prose(rng, n):
    return "".join(rng.choice(VOCABULARY[: rng.choice([4, 40, len(VOCABULARY)])]).title() + rng.choice([" ", " ", ", ", "\n", "-", "\x7f"]) for _ in range(n))


# ---- source audit


def audit_by_hand(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = terms_of(text, LETTERS)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        of_lang = Counter()
        for other in (g for g in groups if g[0] == lang):
            of_lang.update({t: counts[other][t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = shares(counts[lang, source]), shares(of_lang)
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            r = shares(counts[lang, other])
            pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), other))
        some = sorted((-((p[t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t])
        out += [(lang, source, "pair", item, -v, k) for k, (v, item) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)]
        out += [(lang, source, "term", item, -v, k) for k, (v, item) in enumerate(sorted(some, key=lambda x: (x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(11)
    rows = [(rng.choice(["en", "fr", None]), f"s{rng.randrange(7)}" if rng.random() < 0.9 else None, prose(rng, rng.randint(0, 60))) for _ in range(120)]
    rows += [("en", "s1", "Same text, same TEXT " * 40)] * 5
    return rows + [("de", "one", "alone"), ("xx", "a", None), ("xx", "b", "rare"), ("en", "empty", ""), ("en", "long", prose(rng, 20_000)), ("fr", "", None), ("en", "Ω", "the of"), ("en", "ß", "the of")]


def test_source_audit(spark, sources, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in sources], "lang string, source string, text string, n int, value int, chunk int").repartition(4)
    rows = lambda out: sorted(tuple(r) for r in out.collect())
    want = audit_by_hand(sources)
    assert rows(source_audit.source_audit(df)) == want
    monkeypatch.setattr(source_audit, "MOST_COUNTS", 20)  # small chunks and tiles, counts handed over early, groups dealt
    assert rows(source_audit.source_audit(df, chunk=16, sources=2, most_broadcast=0)) == want
    assert rows(source_audit.source_audit(df, min_docs=2, top=5)) == audit_by_hand(sources, 2, 5)
    assert source_audit.source_audit(df.limit(0)).count() == 0


def test_joint_sums():
    """Bitsets, lists and complement against one count for each term; also counts beyond 2^40."""
    rng = np.random.default_rng(5)
    for width, most in ((5, 3), (200, 4), (3000, 3), (700, 1 << 45)):
        counts = [np.where(rng.random(width) < 0.7, rng.integers(1, most, width), 0) for _ in range(4)]
        counts[2][:] = 0
        totals = [int(c.sum()) + width + 9 for c in counts]
        value, terms = source_audit.joint_sums([c[c > 0] for c in counts], [np.flatnonzero(c) for c in counts], totals)
        for g in range(4):
            for h in range(4):
                if g != h:
                    p, q = ([1 + 10**9 * (int(x) + 1) // totals[k] for x in counts[k]] for k in (g, h))
                    some = [(a, b) for a, b, x, y in zip(p, q, counts[g], counts[h], strict=True) if x or y]
                    assert (value[g, h], terms[g, h]) == (sum((a - b) ** 2 // b for a, b in some), len(some))


# ---- ranked search


def ranks_by_hand(docs, items, top=10):
    held = [(i, Counter(ws), len(ws)) for i, t in docs if (ws := terms_of(t, WORDS))]
    n_docs, n_words = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c, n in held:
            m = 10 + 90 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms_of(text, WORDS)) if w in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(2, 25))) for i in range(25)]
    docs = [(i, prose(rng, rng.randint(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(2000 + i, items[i % 5][1] + " " + prose(rng, i)) for i in range(30)]
    docs += [(3000, None), (3001, ""), (3002, "--"), (None, items[1][1]), (7, items[2][1]), (7, items[2][1]), (3003, prose(rng, 20_000) + items[0][1])]
    items += [(90, None), (91, ""), (None, "the of w42"), (3, "another text of the same id"), items[4], (92, "nowhere-to-be-found")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    rows = lambda out: sorted((tuple(r) for r in out.collect()), key=str)
    want = ranks_by_hand(docs, [i for i in items if i[1] is not None])
    assert rows(lexical_search.ranked_search(df, asked)) == want
    assert rows(lexical_search.ranked_search(df, asked, max_items=7, block_docs=37, leaf=1)) == want
    assert rows(lexical_search.ranked_search(df, asked, top=3, block_entries=500, leaf=4)) == [r for r in want if r[1] <= 3]
    assert lexical_search.ranked_search(df.limit(0), asked).count() == lexical_search.ranked_search(df, asked.limit(0)).count() == 0


def test_tree_leaves_out_what_is_bounded():
    """Nodes bound all documents below them, and a search with ten good answers looks at few leaves."""
    rng = np.random.default_rng(3)
    vocabulary, docs = 200, 600
    lists = [np.unique(np.minimum(vocabulary - 1, rng.geometric(0.05, 30))) for _ in range(docs - 12)] + [np.arange(150, 190)] * 12
    ends, words = np.cumsum([len(x) for x in lists]), np.concatenate(lists)
    tfs, m = rng.integers(1, 5, len(words)), rng.integers(10, 200, docs)
    tree = lexical_search.Tree(list(range(docs)), ends, words, tfs, m, vocabulary, leaf=8)
    assert sorted(tree.ids) == list(range(docs)) and len(tree.children) > 20
    for node, children in enumerate(tree.children):
        first, last = tree.span[node]
        assert not children or (tree.span[children[0]][0], tree.span[children[-1]][1]) == (first, last)
        word, most = tree._nodes[node]
        at = slice(tree.starts[first], tree.ends[last - 1])
        assert all(tree._tfs[at][tree.words[at] == w].max() == t for w, t in zip(word, most, strict=True)) and tree.least[node] == tree.m[first:last].min()
    looked = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    tree.saturated = tree.saturated.view(Watched)
    best = tree.search(np.arange(150, 190), np.full(40, 5000), np.zeros(vocabulary, np.int64), [], 10)
    assert len(best) == 10 and {doc for *_, doc in best} <= set(range(docs - 12, docs))
    assert len(looked) < sum(not c for c in tree.children) / 3


# ---- license scan


def scan_by_hand(text):
    words = terms_of(text, SCANNED)
    places = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    shares = []
    for notice, label in license_scan.NOTICES:
        ws = notice.split()
        lines = defaultdict(list)
        for i in range(len(words) - 2):
            for j in range(len(ws) - 2):
                if words[i : i + 3] == ws[j : j + 3]:
                    lines[i - j].append((i, j))
        groups = []
        for d in sorted(lines):
            if groups and d - groups[-1][-1] <= license_scan.SHIFT:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            reach = lambda hits: len({j + x for _, j in hits for x in range(3)})
            hits = [h for d in group for h in lines[d]]
            long = max(i for i, _ in hits) + 3 - min(i for i, _ in hits)
            shares.append(((reach(hits) if long <= 1.5 * len(ws) else max(reach(lines[d]) for d in group)) / len(ws), label))
    base = {label for _, label in places}
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
        ",".join(sorted(base | {label for share, label in shares if share >= 0.8})), 1.0 if places else max([s for s, _ in shares], default=0.0),
    )


def test_license_scan(spark):
    rng = random.Random(13)
    texts = [None, "", " \n", "MIT", "MIT License", "mit-license; MIT\n\nLICENSE. apache license", "mit licenses", "GNU General Public License", "general public licence", "İMIT Kelvin License MIT license", "the MİT license", "miT license"]
    for notice, _ in license_scan.NOTICES:
        ws = notice.split()
        texts += [notice.upper(), prose(rng, 30) + notice.replace(" ", ", ") + prose(rng, 30), " ".join(ws[: len(ws) // 2])]
        changed, longer = list(ws), list(ws)
        changed[len(ws) // 2] = "changed"
        longer.insert(len(ws) // 2, "put in")
        texts += [" ".join(changed), " ".join(longer), " ".join(w for i, w in enumerate(ws) if i != len(ws) // 2), " ".join([*ws[: len(ws) // 2], *["far"] * 4, *ws[len(ws) // 2 :]]), " ".join([notice] * 3)]
        texts += [" ".join(f"{w} filler{k % 3}" if k % 3 == 2 else w for k, w in enumerate(ws))]
    texts += ["mit license " * 3000, prose(rng, 20_000) + "Apache License" + prose(rng, 10), "MIT License", "MIT License"]
    rows = [(i if i % 9 else None, t, "row", 1) for i, t in enumerate(texts)] + [(5, texts[5], "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, i int").repartition(3)
    got = sorted(map(str, map(tuple, license_scan.license_scan(df).collect())))
    assert got == sorted(str((i, *scan_by_hand(t))) for i, t, *_ in rows)
    held = {scan_by_hand(t)[5] for t in texts}
    assert {"bsd", "cc-by-nc", "isc", "mpl", "unlicense", "apache,mit"} <= held
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_license_scan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = license_scan.license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan) and "BroadcastHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
