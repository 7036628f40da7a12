"""Corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import chat_format, decontaminate, exact_dedup, html_text, language_id, near_dedup, packing, repeat_removal, sharding, toxicity
from placewright.llm.components import components

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORDS = "the of and to in a is that for it on with as was at by an be this from or had not are but his they she her which you all were when we there can said".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "x", "q"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 7]) for i in range(14)]
    for i in range(20):
        words = base[i % 5].split()
        words[rng.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words)))
    out += [(300, None), (301, ""), (302, "  \n"), (303, " "), (304, "one two"), (305, "One  two"), (306, prose(rng, 5000)), (307, "é" * 60), (308, "é" * 60 + "z")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1, 2) for i, t in rows], "doc_id long, text string, kept string, shard int, __key int").repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact_dedup(spark, rows, docs):
    def check(got):
        groups = {}
        for i, t in rows:
            groups.setdefault(BLANK.sub(" ", t or ""), []).append(i)
        want = {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == want

    check(exact_dedup.exact_dedup(docs))
    check(exact_dedup.exact_dedup(docs, prefix_chars=1))
    twice = exact_dedup.exact_dedup(docs.unionByName(docs)).where("doc_id = 0").collect()
    assert [r.group_size for r in twice] == [6, 6] and all(r.kept for r in twice)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (3, "a")], "doc_id long, text string")).where("kept").collect()[0].doc_id == 3


ODD_KINDS = "doc_id long, text string, length int, score string, features int, node int, component string, __row int, key int"


def odd_rows(texts):
    """Rows of (id, text) with further columns whose names operators use inside."""
    return [(i, t, 1, "s", 2, 3, "c", n, 4) for n, (i, t) in enumerate(texts)]


def numbers(df):
    """What is left of rows, by their number; the other columns must be as they were."""
    rows = df.collect()
    assert df.columns == [x.split()[0] for x in ODD_KINDS.split(", ")] and all((r.length, r.score, r.features, r.node, r.component, r.key) == (1, "s", 2, 3, "c", 4) for r in rows)
    return sorted(r["__row"] for r in rows)


def test_stages_judge_rows_by_their_texts(spark):
    """Rows that repeat an id, or have none, and columns with clashing names."""
    rng = random.Random(6)
    a, b, c = (prose(rng, 60) for _ in range(3))
    texts = [(1, a), (2, a), (2, b), (None, a), (2, a), (5, c), (5, c), (None, None), (7, ""), (8, " "), (None, b + " ")]
    df = spark.createDataFrame(odd_rows(texts), ODD_KINDS).repartition(3)
    assert numbers(exact_dedup.drop_copies(df)) in ([0, 2, 5, 8, 9, 10], [0, 2, 6, 8, 9, 10])  # b with a blank at its end is another text
    words = b.split()
    edited = " ".join([*words[:30], "edited", *words[31:]])
    near = [(1, a), (2, a.upper()), (2, b), (None, edited), (5, c), (5, c), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(odd_rows(near), ODD_KINDS).repartition(3)
    assert numbers(near_dedup.drop_near_duplicates(df)) in ([0, 2, 4, 6, 7, 8], [0, 2, 5, 6, 7, 8])
    items = spark.createDataFrame([(None, a), (3, "nothing of the kind is here at all"), (None, a), (3, None)], "item_id long, text string")
    held = [(1, b), (1, "x " + a), (None, c + " " + a), (None, b), (4, None), (4, ""), (9, c * 50)]
    df = spark.createDataFrame(odd_rows(held), ODD_KINDS).repartition(2)
    assert numbers(decontaminate.drop_contaminated(df, items)) == [0, 3, 4, 5, 6]
    assert numbers(decontaminate.drop_contaminated(df, items, max_items=1)) == [0, 3, 4, 5, 6]
    # more indexes than one scan takes: each scan reads what the one before has written
    many = items.unionByName(spark.createDataFrame([(100 + i, f"item number {i} of those that nobody holds at all") for i in range(14)], "item_id long, text string"))
    assert numbers(decontaminate.drop_contaminated(df, many, max_items=1)) == [0, 3, 4, 5, 6]
    several = decontaminate.contaminated(df, many, keep=("__row",), max_items=1)
    assert sorted((r["__row"], r.item_id) for r in several.collect()) == [(1, None), (1, None), (2, None), (2, None)]
    found = sorted((r["__row"], r.item_id) for r in decontaminate.contaminated(df, items, keep=("__row",)).collect())
    assert found == [(1, None), (1, None), (2, None), (2, None)]
    nothing = df.limit(0)
    assert exact_dedup.drop_copies(nothing).count() == near_dedup.drop_near_duplicates(nothing).count() == decontaminate.drop_contaminated(nothing, items).count() == 0
    assert decontaminate.drop_contaminated(df, items.limit(0)).count() == len(held)


def test_sharding(spark, rows, docs):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.arange(2000, dtype=np.int64)
    assert [jump(int(k), 8) for k in sharding.mixed(keys)] == sharding.jump_hash(sharding.mixed(keys), 8).tolist()
    a, b = (sharding.jump_hash(sharding.mixed(keys), n) for n in (8, 9))
    assert set(b[a != b]) == {8} and abs((a != b).mean() - 1 / 9) < 0.03
    got = {r.doc_id: r for r in sharding.shard_rows(docs, 8, lane_rows=7).collect()}
    text = dict(rows)
    for i, r in got.items():
        raw = (text[i] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(empty(spark)).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    make = {"en": "the house and water were with them", "de": "das haus und wasser waren mit ihnen", "fr": "la maison et eau étaient avec eux"}
    rows = [(i, " ".join(rng.choice(make[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(list(make) * 60)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language_id.fit(df.where("id < 120"))
    test = df.where("id >= 120").select(F.col("id").alias("doc_id"), "text", "lang")
    got = language_id.identify(test, model, keep=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²½ !"), (4, "wasserhaus häuser"), (5, "the " * 50_000)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] == "de" and found[5][0] == "en"
    none = language_id.fit(spark.createDataFrame([(1, "a", None)], "id long, text string, lang string"))
    assert language_id.identify(odd, none).where("lang_pred <> 'und'").count() == 0


def test_chat_fold_and_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "a\\b\\", "<<|im_end|>", "<\\s>", "", None, "\\<s>\n\n"]
    rows = [(1, i, "message", None, "assistant" if i % 2 else "us\ner<s>\\", t) for i, t in enumerate(odd)]
    rows += [
        (2, 1, "message", "m1", "user", "hi"), (2, 2, "message", "m2", "assistant", ""), (2, 3, "delta", "m2", "assistant", "wro"), (2, 4, "delta", "m2", "assistant", "ng"),
        (2, 5, "regenerate", "m2", "assistant", None), (2, 6, "delta", "m2", "assistant", "ri"), (2, 8, "delta", "m2", "assistant", "ght"), (2, 9, "edit", "m1", "user", "hello"),
        (2, 10, "message", "m3", "user", "gone"), (2, 11, "delete", "m3", "user", None), (None, 1, "message", None, "user", "x"),
    ]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, chat_format.EVENTS).repartition(3))
    pieces = [r for r in formatted.collect() if r.conv_id == 1]
    for r in pieces:
        assert chat_format.read_back(r.piece) == (r.role, r.text)
        assert r.piece.count("<|im_start|>") == r.piece.count("<|im_end|>") == 1 and "</s>" not in r.piece and "[INST]" not in r.piece
    folded = [(r.role, r.text) for r in sorted((r for r in formatted.collect() if r.conv_id == 2), key=lambda r: r.pos)]
    assert folded == [("user", "hello"), ("assistant", "right")]
    got = {r.conv_id: r for r in chat_format.conversation_digests(formatted).collect()}
    want = hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, _, _, _, r, t in rows[:8]).encode()).hexdigest()
    loss = "".join(t or "" for _, _, _, _, r, t in rows[:8] if r == "assistant")
    assert (got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256, got[1].n_turns) == (want, len(loss), hashlib.sha256(loss.encode()).hexdigest(), 8)
    assert got[1].formatted_chars == sum(len(r.piece) for r in pieces) and got[None].n_turns == 1
    assert chat_format.conversation_digests(chat_format.format_conversations(spark.createDataFrame([], chat_format.EVENTS))).count() == 0


def test_packing(spark, docs, rows):
    ids = packing.UnitIds(packing.tokenizer_path())
    for t in ["", " ", "a  b", " a b ", "a\n b", "x <|endoftext|> y", "it's 12 34  ", "日本 語", "a\x85 b \x1c c"] + [t for _, t in rows if t][:40]:
        assert ids.whole(t) == ids.encode(t)
    assert all(sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= 2048 for n in range(1, 9000, 7))
    got = packing.pack(docs, packing.tokenizer_path(), lane_pieces=20).collect()
    text = dict(rows)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(text)
    for i, parts in by_doc.items():
        whole = ids.whole(text[i] or "") + (1).to_bytes(4, "little")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) // 4 and p.ids_crc32 == zlib.crc32(whole[4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(whole)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(empty(spark), packing.tokenizer_path()).count() == 0


def test_packing_wastes_little():
    rng = np.random.default_rng(2)
    pieces = np.array([n for t in rng.lognormal(6, 1, 20_000).astype(int) + 1 for n in packing.cuts(int(t))])
    bins = packing.fill(pieces)
    assert pieces.sum() / (2048 * (bins.max() + 1)) > 0.99


def test_bm25_search_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(3, 40)) + ". " + prose(rng, 8) + ".") for i in range(90)]
    index = decontaminate.Index(items)
    weights = {w: dict(zip(index.items[i], index.weights[i])) for w, i in index.word.items()}
    for _ in range(60):
        passage = set(prose(rng, 80).split()) | set(decontaminate.words_of(rng.choice(items)[1])[:20])
        terms = [index.word[w] for w in passage if w in index.word]
        for threshold in (0.3, 0.6, 0.9):
            want = {}
            for w in passage:
                for at, x in weights.get(w, {}).items():
                    want[at] = want.get(at, 0) + x
            assert {a for a, _ in index.search(terms, threshold)} == {a for a, x in want.items() if x >= threshold - 1e-9}
    docs = [(0, items[3][1]), (1, prose(rng, 300) + " " + items[7][1].upper() + " " + prose(rng, 4000)), (2, prose(rng, 400)), (3, None), (4, ""), (5, items[3][1].split(". ")[0])]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string"), max_items=20).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 3), (1, 7)}
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_of_short_and_edited_items(spark):
    rng = random.Random(12)
    items = [(0, "What is the capital of France? Paris."), (1, "Zeus begat Ares"), (2, "red fox eats blue hen quickly"), (3, "When did the first steam engine of that old river mill start to turn its great iron wheel around?")]
    items += [(10 + i, prose(rng, 30) + ".") for i in range(40)]
    edited = items[3][1].replace("river", "town")
    short = decontaminate.question_and_answer(items[3][1])
    texts = [prose(rng, 40) + f" {t} " + prose(rng, 300) for t in (items[0][1], items[1][1], items[2][1], items[3][1], edited, "What is the capital of Spain? Rome.", "Zeus begat Hera", " ".join(short[0]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, table).collect()}
    assert found.keys() == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}
    # the parts of the index share rarity and mean length
    parted = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, table, max_items=6).collect()}
    assert parted.keys() == found.keys() and all(abs(parted[k] - found[k]) < 1e-9 for k in found)

    def fitting(part, words):
        row = list(range(len(part) + 1))
        least = row[-1]
        for w in words:
            new = [0]
            for i, x in enumerate(part):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row, least = new, min(least, new[-1])
        return least

    for _ in range(200):
        part, words = ([rng.choice("abcd") for _ in range(rng.randint(least, 12))] for least in (1, 0))
        assert decontaminate.edits(part, words) == fitting(part, words)


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in BLANK.split(w) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_near_dedup(spark, rows, docs, size):
    got = near_dedup.similar_components(docs, size=size)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_components(rows, size)


def test_near_dedup_of_a_loose_group(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):  # pairs on both sides of the threshold
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(150)] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    got = near_dedup.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_components(rows, 4)
    assert near_dedup.similar_components(empty(spark)).count() == 0


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for j in (0.3, 0.6, 0.9):
        common = int(2 * 3000 * j / (1 + j))
        x, y = a[:3000], np.r_[a[:common], rng.integers(0, 1 << 63, 3000 - common).astype(np.uint64)]
        got = near_dedup.likely_similarity(near_dedup.registers(x)[None], near_dedup.registers(y)[None], np.array([3000.0]), np.array([3000.0]))[0]
        assert abs(got - j) < 5 * math.sqrt(j * (1 - j) / near_dedup.M)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (200, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 300: 200}


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["scumbag", "idiotic", "moronic"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (9999, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 450"), lab.where("doc_id < 450"))
    got = {r.doc_id: r.score for r in model.score(docs.where("doc_id >= 450"), ("doc_id",)).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels if i >= 450)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "fine " * 60_000)], "doc_id long, text string")
    assert all(0 <= r.score < 0.7 for r in model.score(odd, ("doc_id",)).collect())
    none = toxicity.fit(docs, lab.where("toxic = 0"))
    assert none.score(odd, ("doc_id",)).where("score <> 0").count() == 0
    assert toxicity.tokens_of("You l0ser, id!ot")[0] == ["you", "loser", "idiot"]


def test_html_text(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=x>Home of the brave</a></li></ul></nav>
    <div class="ad">Buy of the best and the rest for you</div><article><header><h1>A &amp; B</h1></header><p>One&nbsp;two<br>three <b>four</b>.<p>Five &#233; six.</p><aside>side note of the day</aside>
    <div class="share-buttons">Share it</div></article><section id="comments"><p>I think that the article is of the best and it was on to it.</p></section><form>Sign up for the news</form><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "A & B One two three four. Five é six."
    plain = "<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Title here</h2><p>" + "This is the text of the page and it is for all of you to read with us. " * 5 + "</p><p>Short one.</p><p>" + "It was the best of times and it was the worst of times for all of them. " * 4 + "</p><div><a href=3>Next</a></div></body>"
    got = html_text.main_text(plain)
    assert got.startswith("Title here This is") and "Short one." in got and "Home" not in got and "Next" not in got
    assert [html_text.main_text(x) for x in (None, "", "just text of one block", "<p>unclosed <b", "a < b")] == ["", "", "just text of one block", "unclosed <b", "a < b"]
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "<p>" * 3000, "x")]
    out = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect()) == [(0, 0), (1, 37), (2, 0)]


def test_html_long_attributes():
    prop = '{"a": "<b>x</b>", "hidden": true, "t": 1}, ' * 200  # over 2,000 letters, with > in it
    for quote, value in (("'", prop), ('"', prop.replace('"', "'"))):
        page = f"<article><div data-props={quote}{value}{quote}><p>It was the best of times.</p><img alt = {quote}{value}{quote}/>And on.</div></article>"
        assert html_text.main_text(page) == "It was the best of times. And on."
    assert html_text.main_text("<article><p title=\"a>It's the one.</p></article>") == "It's the one."  # a quote that never closes
    assert html_text.main_text("<article><a href=x?a=\"b>It was</a> on.</article>") == "It was on."  # a quote inside a bare value opens nothing
    assert html_text.main_text('<article>' + '<i b=">"' * 100_000).count('"') == 100_000  # each place is read once


def brute_repeats(rows, span=50):
    least, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, t in order:
        raw = (t or "").encode()
        for p in range(len(raw) - span + 1):
            least.setdefault(raw[p : p + span], i)
    for i, t in order:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            if least[raw[p : p + span]] != i:
                gone[p : p + span] = b"\x01" * span
        out[i] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(c for c, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("block, bucket, most", [(1 << 20, 1 << 20, 1000), (3000, 4000, 1000), (3000, 4000, 2), (3000, 4000, 0)])
def test_repeat_removal(spark, rows, docs, block, bucket, most):
    rng = random.Random(5)
    passage = prose(rng, 30)
    more = [(400 + i, prose(rng, 20) + passage[rng.randrange(20) : -1 - rng.randrange(20)] + prose(rng, 20)) for i in range(15)] + [(500, "ab" * 200), (501, "ba" * 90), (502, "x" * 49), (503, "x" * 50), (504, "x" * 51)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = repeat_removal.remove_repeats(df, block_bytes=block, bucket_bytes=bucket, most_contexts=most).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute_repeats([*rows, *more])


def test_repeat_removal_edges(spark):
    text = prose(random.Random(2), 40)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "!")], "doc_id long, text string")
    got = sorted((r.doc_id or 9, r.n_removed) for r in repeat_removal.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(text)), (9, len(text))]
    assert repeat_removal.remove_repeats(empty(spark)).count() == 0


def test_equal_windows():
    rng = random.Random(1)
    for t in range(60):
        texts = [bytes(rng.choice(b"ab" if t % 2 else b"abcdefgh") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(1, 6))]
        for span in (5, 9, 50):
            position, label = repeat_removal.equal_windows(texts, span)
            want, at = {}, 0
            for x in texts:
                for i in range(len(x) - span + 1):
                    want.setdefault(x[i : i + span], []).append(at + i)
                at += len(x) + 1
            got = {}
            for p, k in zip(position.tolist(), label.tolist()):
                got.setdefault(k, []).append(p)
            assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = None
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, data)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or now <= before
        before = now
    texts = [BLANK.sub(" ", r.text) for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    assert {r.doc_id for r in corpus_pipeline.STAGES[4][1](spark, docs, data).select("doc_id").collect()} == before
