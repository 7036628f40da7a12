"""Brute-force twins of operators without SQL, and nulls, ties, repeated rows, empty tables, long texts and clashing columns of each."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import chat_format, html_text, language_id, near_dedup, packing, sharding, toxicity

WORDS = "the of and to in a is that for it on with as was at by an be this from or had not are but his they she her which you".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "x", "q"]) for _ in range(n))


def clashing(spark, rows):
    """(doc_id, text) with further columns named like those that operators use inside."""
    kinds = "doc_id long, text string, lang_pred int, score string, features int, prediction int, rawPrediction int, label int, n int, size int, shard int, lane int, start int, word string, __text int"
    return spark.createDataFrame([(i, t, *[1, "s", 1, 1, 1, 1, 1, 1, 1, 1, 1, "w", 1]) for i, t in rows], kinds).repartition(3)


def language_model_by_hand(rows):
    """Log frequencies of words, and of n-grams that each different word of a language gives with a weight, as dicts."""
    langs = sorted({lang for _, _, lang in rows})
    counts = {0: {lang: Counter() for lang in langs}}
    for _, text, lang in rows:
        counts[0][lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    for n in (1, 2, 3, 4, 5):
        counts[n] = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, k in counts[0][lang].items():
                marked = f"^{w}$" if n > 1 else w
                for i in range(len(marked) - n + 1):
                    counts[n][lang][marked[i : i + n]] += 1 + int(math.log2(k))
    model = {}
    for n, by in counts.items():
        items = {x for c in by.values() for x in c}
        model[n] = {x: [math.log((by[lang][x] + 0.5) / (sum(by[lang].values()) + 0.5 * len(items))) for lang in langs] for x in items}
    return langs, model


def language_by_hand(texts, langs, model):
    """The word-first rule, word by word."""
    out = []
    for text in texts:
        total, any_ = [0.0] * len(langs), False
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            any_ = True
            if w in model[0]:
                total = [t + x for t, x in zip(total, model[0][w], strict=True)]
                continue
            back = 0.0
            for n in (5, 4, 3, 2, 1):
                back += math.log(0.4)
                marked = f"^{w}$" if n > 1 else w
                seen = [model[n][marked[i : i + n]] for i in range(len(marked) - n + 1) if marked[i : i + n] in model[n]]
                if seen:
                    total = [t + sum(x[k] for x in seen) / len(seen) + back for k, t in enumerate(total)]
                    break
        best = max(range(len(langs)), key=lambda k: (round(total[k], 4), -k)) if any_ else None
        out.append("und" if best is None else langs[best])
    return out


def test_language_model_is_as_large_as_its_sample():
    """200 languages of 10,000 words each that no other has: no row is as wide as all languages."""
    import pickle

    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 2_000_000).astype(np.uint64)
    logs = language_id.Logs(hashes, np.repeat(np.arange(200), 10_000), np.ones(2_000_000), 200)
    assert len(pickle.dumps(logs)) < 100_000_000
    row = logs.rows(logs.find(hashes[[7, 1_999_999]]), np.array([0, 1]), 2)
    assert row.argmax(axis=1).tolist() == [0, 199] and (logs.find(np.array([3], np.uint64)) == -1).all()
    assert np.allclose(row[0, 0], math.log(1.5 / (10_000 + 0.5 * 2_000_000))) and np.allclose(row[0, 1], math.log(0.5 / (10_000 + 0.5 * 2_000_000)))


def test_language_id_by_hand(spark):
    rng = random.Random(3)
    vocabulary = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnop"[k % 5 : k % 5 + 8]) for _ in range(rng.randint(2, 8))) for _ in range(12)] for k in range(4)}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(15)), lang) for i, lang in enumerate(list(vocabulary) * 10)]
    model = language_id.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    texts = [" ".join(rng.choice(rng.choice(list(vocabulary.values())))[: rng.randint(2, 8)] + rng.choice(["", "zz", "1", "ß"]) for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", "42", "abc " * 30_000]
    df = clashing(spark, [*enumerate(texts), (0, texts[0]), (None, texts[1])])
    got = language_id.identify(df, model).collect()
    want = language_by_hand(texts, *language_model_by_hand(rows))
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id is not None) == sorted([*enumerate(want), (0, want[0])])
    assert [r.lang_pred for r in got if r.doc_id is None] == [want[1]] and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(df.limit(0), model).count() == 0
    # ties go to the first name; a language past any number of others is still learned
    many = spark.createDataFrame([(k, f"word{chr(97 + k // 26)}{chr(97 + k % 26)} common", f"l{k:03}") for k in range(260)], "id long, text string, lang string")
    model = language_id.fit(many)
    assert len(model["langs"]) == 260
    found = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "wordjz"), (2, "common")], "doc_id long, text string"), model).collect()}
    assert found == {1: "l259", 2: "l000"}


def test_toxicity_features_by_hand(spark):
    lexicon = {"fool": 2.0, "fooli-": 1.5, "foolis-": 1.0, "foolish-": 3.0}
    got = dict(zip(toxicity.FEATURES, toxicity.features_of("You F00L, what a FOOLISHNESS!! soooo it is", lexicon)))
    want = {  # eight words; one whole-word hit, one by its beginning; the pronoun within four words of the first
        "word_density": 1 / 8, "word_hits": math.log(2), "word_strength": 2 / 8, "word_best": 2.0, "start_density": 1 / 8, "start_hits": math.log(2), "start_best": 3.0, "start_strength": 3 / 8,
        "start_repeat": 3 / 8, "second_person": 1 / 8, "near_second_person": 2 / 8, "exclamation": 2 / 42, "obfuscated": 1 / 8, "repeated": 1 / 8, "length": math.log(9),
    }
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert got["capitals"] == pytest.approx(sum(c.isupper() for c in "You F00L, what a FOOLISHNESS!! soooo it is") / 42) and got["capital_words"] == pytest.approx(2 / 8)
    assert toxicity.features_of("", lexicon) == tuple([0.0] * (len(toxicity.FEATURES) - 1) + [math.log(2)])


def test_toxicity_stage_keeps_rows(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 40) + (" you scumbag, moronic idiotic scumbag" if i % 3 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    odd = [(None, None), (None, rows[1][1]), (1, rows[1][1]), (1, rows[1][1]), (5, ""), (6, rows[0][1]), (None, rows[0][1])]
    df = clashing(spark, [*rows, *odd])
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.schema == df.schema
    want = Counter((i, t) for i, t in [*rows, *odd] if not (t or "").endswith("scumbag"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    # one label only: all have its share as score
    assert toxicity.drop_toxic(df, labels.where("toxic = 1")).count() == 0 and toxicity.drop_toxic(df, labels.where("toxic = 0")).count() == df.count()
    assert toxicity.drop_toxic(df, labels.limit(0)).count() == df.count() and toxicity.drop_toxic(df.limit(0), labels).count() == 0


def test_sharding_edges(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (2, "x" * 200_000), (-5, ""), (2**62, "é")]
    got = sharding.shard_rows(clashing(spark, rows), 8, lane_rows=2).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_chat_edges(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (2, 5, "assistant", "z" * 300_000), (None, 1, "assistant", "q"), (None, 1, "assistant", "q")]
    df = spark.createDataFrame([(*r, "x", 1, "p") for r in rows], "conv_id long, seq long, role string, text string, kind string, pos int, piece string")
    events = chat_format.numbered(df)
    assert events.select("conv_id", "msg_id").distinct().count() == len(rows)
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_conversations(events)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 0), 2: (1, 300_000), None: (2, 2)}
    whole = chat_format.format_conversations(df.select("conv_id", "seq", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("msg_id"), "role", "text"))
    assert {(r.conv_id, r.turns_sha256) for r in chat_format.conversation_digests(whole).collect()} == {(k, r.turns_sha256) for k, r in got.items()}
    # many deltas after the last setting event, and none before it
    log = [(7, 0, "message", "m", "assistant", "old")] + [(7, i, "delta", "m", "assistant", "x") for i in range(1, 50)] + [(7, 50, "edit", "m", "assistant", "new")] + [(7, i, "delta", "m", "assistant", "y") for i in range(51, 60)]
    assert [(r.pos, r.text) for r in chat_format.fold_events(spark.createDataFrame(log, chat_format.EVENTS)).collect()] == [(0, "new" + "y" * 9)]


def test_packing_edges(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "other"), (None, "one"), (None, "one"), (None, None), (3, "word " * 30_000)]
    got = packing.pack(clashing(spark, rows), packing.tokenizer_path(), lane_pieces=5).collect()
    ids = packing.UnitIds(packing.tokenizer_path())
    lengths = Counter(len(ids.whole(t or "")) // 4 + 1 for _, t in rows)
    assert Counter(r.doc_tokens for r in got if r.start == 0) == lengths and sum(r.length for r in got) == sum(k * n for k, n in lengths.items())
    spans = Counter((r.sequence_id, r.offset) for r in got)
    assert max(spans.values()) == 1
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY


def test_packing_takes_the_ids_of_the_file():
    texts = ["", "The cat's  house, 12 km\n\n away", "ÀÉ ß <|endoftext|> x", "日本 " * 5]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids = packing.UnitIds(packing.tokenizer_path(name))
        assert (ids.merge is None) == name.startswith("word")
        assert all(ids.encode(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)


def test_near_dedup_misses_few_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    missed = 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 800).astype(np.uint64)
        own = rng.integers(0, 1 << 63, (2, 100)).astype(np.uint64)  # 800 of 1,000 are common: similarity 0.8
        a, b = (near_dedup.band_keys(near_dedup.registers(np.unique(np.r_[both, x]))[None])[0] for x in own)
        missed += not (a == b).any()
    assert missed <= 1


def first_by_hand(block, no_stops):
    text, linked, verdict, _, _, paragraph = block
    if verdict < 0:
        return -1
    if 3.0 * linked > 0.99 * len(text):
        return (0 if paragraph else 2) if verdict else -1
    if no_stops:
        ends = re.search(r"[.!?](\s|$)", text)
        return 1 if len(text) >= 200 or ends and len(text) >= 35 else -1 if linked and not verdict else 0
    if len(text) < 70:
        return -1 if linked and not verdict else 0
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    stops = len([w for w in words if w in html_text.STOPS]) / len(words)
    return 1 if stops >= 0.2 or stops >= 0.12 and len(text) >= 200 else 0 if stops >= 0.12 or verdict else -1


def text_by_hand(blocks):
    """The two passes with every neighbour looked for anew. blocks: text, linked characters, markup, heading, article, paragraph."""
    words = [w for b in blocks if b[2] >= 0 and 3.0 * b[1] <= 0.99 * len(b[0]) for w in re.split(r"[\W\d_]+", b[0].lower()) if w]
    no_stops = sum(map(len, words)) >= 70 and len([w for w in words if w in html_text.STOPS]) < 0.06 * len(words)
    first = [first_by_hand(b, no_stops) for b in blocks]
    n = len(blocks)
    menu = [first[i] == 2 and any(0 <= j < n and first[j] == 2 and blocks[j][4] == blocks[i][4] for j in (i - 1, i + 1)) for i in range(n)]
    first = [-1 if menu[i] else 0 if x == 2 else x for i, x in enumerate(first)]
    out = []
    for i, (_, _, _, heading, article, _) in enumerate(blocks):
        if first[i]:
            out.append(first[i])
            continue
        counts = [j for j in range(n) if first[j] and (not article or blocks[j][4] == article and (first[j] == 1 or menu[j]))]
        b, a = max((j for j in counts if j < i), default=None), min((j for j in counts if j > i), default=None)
        if a is None and b is None:
            out.append(1)
        elif heading and a is not None:
            out.append(first[a])
        elif article:
            out.append(-1 if a is not None and b is not None and max(first[a], first[b]) < 0 else 1)
        elif a is None or b is None or a - i != i - b:
            out.append(first[b if a is None or b is not None and i - b < a - i else a])
        else:
            out.append(min(first[a], first[b]))
    return " ".join(b[0] for b, label in zip(blocks, out) if label == 1)


def test_html_two_passes_by_hand():
    """Pages put together from known blocks, against the rules written out a second time."""
    rng = random.Random(4)
    kinds = [("<p>{}</p>", 0), ("<h2>{}</h2>", 0), ("<div>{}</div>", 0), ("<li>{}</li>", 0), ('<div class="ad">{}</div>', -1), ("<aside>{}</aside>", -1), ('<div data-role="menu">{}</div>', 0)]

    def block(foreign):
        known = not foreign and rng.random() < 0.7
        text = prose(rng, rng.choice([2, 5, 12, 40])) if known else " ".join("".join(rng.choice("xyzvbn") for _ in range(6)) for _ in range(rng.choice([2, 12, 40]))) + rng.choice(["", "."])
        text, linked = " ".join(text.split()), 0
        page = text
        if rng.random() < 0.3:
            linked, more = len(text), rng.choice(["", " and more", " and more of it" * 20])
            page, text = f"<a href=x>{text}</a>{more}", text + more
        form, verdict = rng.choice(kinds)
        return form.format(page), text, linked, verdict, "h2" in form, "<p" in form

    decided = Counter()
    for k in range(600):
        parts = [block(k % 3 == 0) for _ in range(rng.randint(0, 14))]
        cut = rng.randint(0, len(parts))
        around, good = rng.choice([("<article>{}</article>", 1), ('<div class="content">{}</div>', 1), ("<div>{}</div>", 0)])
        pages = [p[0] for p in parts]
        page = "".join(pages[:cut]) + around.format("".join(pages[cut : cut + 6])) + "".join(pages[cut + 6 :])
        inside = [good * (cut <= i < cut + 6) for i in range(len(parts))]
        blocks = [(text, linked, verdict or held, heading, held, paragraph) for (_, text, linked, verdict, heading, paragraph), held in zip(parts, inside, strict=True)]
        assert html_text.main_text(page) == text_by_hand(blocks)
        decided.update((bool(b[2]), (b[0] + " ") in html_text.main_text(page) + " ") for b in blocks)
    assert min(decided[x, y] for x in (True, False) for y in (True, False)) > 50  # blocks without markup are kept and dropped by their features


def test_html_loses_no_article_text():
    """Attributes that only look like marks, paragraphs of links, languages without a list, anchors."""
    whole = {
        '<article><p aria-hidden="false">One two.</p></article>': "One two.", '<article><p data-role="navigation">One two.</p></article>': "One two.",
        '<article><p data-ad-class="ads">One two.</p></article>': "One two.", '<article><div data-style="display:none"><p>One two.</p></div></article>': "One two.",
        '<article><p x-hidden data-hidden="1">One two.</p></article>': "One two.", '<article><p style="display:block">One two.</p></article>': "One two.",
        '<article><p aria-hidden="true">No.</p><p style="color:red; display: none">No.</p><p hidden>No.</p><p>Yes it is.</p></article>': "Yes it is.",
        '<article><p>Intro.</p><p><a href="a">First of the links.</a></p><p><a href="b">Second of the links.</a></p><p>End.</p></article>': "Intro. First of the links. Second of the links. End.",
        '<article><p>All of it.</p><section id="copyright"><h2 id="menu">Of menus</h2><p>It is the law of copyright.</p></section><section id="comments"><p>I like it.</p></section></article>': "All of it. Of menus It is the law of copyright.",
    }
    for page, text in whole.items():
        assert html_text.main_text(page) == text, page
    russian = "Это первый абзац статьи, в котором рассказано о многом и по порядку. Затем следует второе предложение."
    japanese = "これは記事の最初の段落であり、いろいろなことが順番に書かれています。次の文もここにあり、さらに続きます。"
    for text in (russian, japanese):
        menu = "".join(f'<div><a href="{i}">{text[i:i + 6]}</a></div>' for i in range(5))
        page = f"<html><body>{menu}<div>{text}</div><div><p>{text[::-1]}{text}</p></div>{menu}</body></html>"
        assert html_text.main_text(page) == " ".join(f"{text} {text[::-1]}{text}".split())


def test_html_markup():
    says = {
        '<article><p>One <span class="ad"><span>Buy now</span> cheap</span> two.</p></article>': "One two.",
        "<article><p>One <b class=ad>Buy</b> two <b class=ad>never closed three.</p></article>": "One two never closed three.",
        '<article><p><a href="x">All of this short paragraph is a link.</a></p></article>': "All of this short paragraph is a link.",
        '<article><section class="trending-analysis"><p>It is the analysis.</p></section><ul class="related-posts"><li>No</li></ul></article>': "It is the analysis.",
        '<article><p>Text of it.</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>': "Text of it.",
        '<main><p>Only short.</p><div class="ad">Buy of the best</div></main>': "Only short.",
        "<span class=ad>" * 3000 + "x": "x",
    }
    for page, text in says.items():
        assert html_text.main_text(page) == text


def test_html_edges(spark):
    long = "<article>" + "<p title='a > b'>It was the best of times.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, "t", 5, 1), (1, "u", long, "t", 5, 1), (None, None, None, "t", 5, 1)], "page_id long, url string, html string, text string, n_chars int, __html int")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extract_main_text(df).collect())
    assert got == [(0, 0), (1, 26 * 20_000 - 1), (1, 26 * 20_000 - 1)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_pipeline_run(spark):
    """The whole run, stage by stage: what each drops, and that its columns pass through."""
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = corpus_pipeline.STAGES[0][1](spark, docs, data)
    assert clean.schema == docs.schema and clean.exceptAll(docs).count() == 0 and clean.count() <= docs.count()
    packed = corpus_pipeline.run(spark, data)
    assert packed.columns == list(packing.PACKED)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids and ids <= {r.doc_id for r in clean.select("doc_id").collect()}
