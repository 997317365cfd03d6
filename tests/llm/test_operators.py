"""The training-data operators against brute force, SQL and planted cases, with the edge cases of each."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keystrand.llm import bmw_search, decontaminate, entry, html_mincut, knn_quality, licenses, ngram_bloom, pivotal_mix, simhash_gray, simhash_similar, toxicity, url_templates
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(None, None), (1, ""), (2, None), (3, "  \n\t "), (4, "a"), (4, "a"), (5, "Ünïcode \x00 wörds " * 3), (6, "word " * 10_000), (None, "no id here at all")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}" if i != 3 else None, len(t or "")) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(entry.QUERIES[name](spark, SF), con, entry.ORACLE_SQL[name])


# 1 html


def test_html_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=a>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies, and this is a long sentence.</div><article><h1>Title</h1><p>First &amp;\n second.<p>Third <b>bold</b>.<script>x='</p>'</script>"
        "<aside>Teaser text that is long enough to look like prose, surely.</aside><div class=ad>Buy.</div><form><p>Join us</p></form></article>"
        "<section id=comments><article><p>Great article, thank you for it!</p></article></section><footer>&copy; me</footer></body></html>"
    )
    assert html_mincut.main_text(page) == "Title First & second. Third bold."


PARAGRAPH = "This is a long paragraph of an article, with many words in it. "
WRAPPERS = [
    "<article class='post type-post tag-news'>", "<article class='review'>", "<main class='has-sidebar'>", "<div id='main' class='with-sidebar'>",
    "<div class='post-content social-share'>", "<article class='legal-news'>", "<section class='entry_content'>", "<div>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers_keep_their_text(wrapper):
    page = f"<html><body><nav><a href=x>Home</a></nav>{wrapper}{f'<p>{PARAGRAPH * 4}</p>' * 3}</{wrapper[1:].split()[0].rstrip('>')}><footer>me</footer>"
    assert html_mincut.main_text(page) == " ".join([(PARAGRAPH * 4).strip()] * 3)


def test_html_cut_decides_unsure_blocks():
    """A linked line among paragraphs stays, a lone sentence among links goes; their own costs say otherwise."""
    link = "<p><a href='/x'>A linked line about all of it</a></p>"
    items = "".join(f"<li><a href='/{i}'>Some other page here {i}</a></li>" for i in range(3))
    page = f"<body><p>{PARAGRAPH * 4}</p>{link}<p>{PARAGRAPH * 4}</p><ul>{items}<li>Read on.</li>{items}</ul></body>"
    blocks = html_mincut.blocks_of(page)
    alone = [b.text for b in blocks if html_mincut.costs(b, False)[1] > html_mincut.costs(b, False)[0]]
    kept = html_mincut.main_text(page)
    assert "A linked line" not in " ".join(alone) and "Read on." in alone
    assert "A linked line about all of it" in kept and "Read on." not in kept and "Some other" not in kept


def test_html_hidden_and_inline():
    assert html_mincut.main_text("<body><section><div hidden>secret<p>more</section><p>Shown text here, <label>a label</label> and <math>x</math>.</p>") == "Shown text here, a label and x."
    assert html_mincut.main_text("<body><article><p>One two three.</p><svg><title>t</title></svg><button>Go<p>Four five.</p></article>") == "One two three."
    long = html_mincut.main_text("<article>" + f"<p>{PARAGRAPH}</p>" * 5000 + "</article>")
    assert len(long) == 5000 * len(PARAGRAPH) - 1


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p class='x", "<div><", "&am", "<!-- open", "<script>never closed", "</p></div>", "<p>" * 3000])
def test_html_odd_pages(page):
    html_mincut.main_text(page)


def test_min_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        a, b = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(keep, a=a, b=b, edges=edges):
            return sum(a[i] if k else b[i] for i, k in enumerate(keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])

        least = min(cost([m >> i & 1 for i in range(n)]) for m in range(2**n))
        for cut in (html_mincut.min_cut, html_mincut.cut_reduced):
            assert math.isclose(cost(cut(a, b, edges)), least, abs_tol=1e-6)


def test_html_frame(spark):
    df = spark.createDataFrame([(None, None, 1, "t"), (7, "<p>Hello there.</p>", 2, "t")], "page_id bigint, html string, n_chars int, text string")
    rows = html_mincut.extract(df).collect()
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in rows} == {(None, "", 0), (7, "Hello there.", 12)}
    assert html_mincut.extract(df.limit(0)).count() == 0


# 2 licenses


def test_license_inheritance(spark):
    deep = "/".join(f"d{i}" for i in range(60))
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", "int main;"), ("a/b/c/y.c", None), ("z/q.c", "x\nLicensed under the Apache License, Version 2.0.\ny"),
        ("q.c", ""), (None, "int"), (f"a/{deep}/far.c", "int"), ("a/b/x.c", "int main;"), ("t/COPYING", "MIT License"), ("t/LICENSE", "ISC License"), ("t/x", "long " * 50_000),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("unit", F.lit(1)).withColumn("license", F.lit("x")).withColumn("_hash", F.lit("h"))
    got = licenses.scan(df).collect()
    assert len(got) == len(rows) and {r["unit"] for r in got} == {1} and {r["_hash"] for r in got} == {"h"}
    assert {r["path"]: (r["license"], r["basis"]) for r in got} == {
        "a/LICENSE": ("MIT", "file"), "a/b/x.c": ("MIT", "directory"), "a/b/c/y.c": ("MIT", "directory"), "z/q.c": ("Apache-2.0", "header"), "q.c": (None, None), None: (None, None),
        f"a/{deep}/far.c": ("MIT", "directory"), "t/COPYING": ("MIT", "file"), "t/LICENSE": ("ISC", "file"), "t/x": ("ISC", "directory"),
    }
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0
    root = spark.createDataFrame([("LICENSE", "Apache License\nVersion 2.0, January 2004\n\nTERMS AND CONDITIONS"), ("LICENCE", "Apache License Version 2.0, January 2004\nmore"), ("src/x.c", "int"), ("/abs/x.c", "int")], "path string, text string")
    assert {r["path"]: r["license"] for r in licenses.scan(root).collect()} == {"LICENSE": "Apache-2.0", "LICENCE": "Apache-2.0", "src/x.c": "Apache-2.0", "/abs/x.c": None}


GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.

 * Some more prose follows here.
 */"""


def test_license_texts_headers_and_tags(spark):
    mit = "MIT License\n\nCopyright (c) 2020 X\n\n" + licenses.TEMPLATES["MIT"][1] + " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."
    rows = [
        ("1/LICENSE", mit), ("2/x.c", GPL_HEADER + "\nint main(void) { return compute(argc, argv); }" * 60), ("3/x.c", "// SPDX-License-Identifier: Apache-2.0\nint main;"), ("4/x.c", "# SPDX-License-Identifier: MIT"),
        ("5/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n" + "Everyone is permitted to copy and distribute verbatim copies. " * 40), ("6/x", "All the rights and the terms of this program, version 3, general and public."),
        ("7/x", "Redistribution of wealth and the use of sources"), ("8/BSD", licenses.TEMPLATES["BSD-3-Clause"][1]),
    ]
    got = {r["path"][0]: (r["license"], r["basis"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"1": ("MIT", "file"), "2": ("GPL-3.0", "header"), "3": ("Apache-2.0", "header"), "4": ("MIT", "file"), "5": ("GPL-2.0", "file"), "6": (None, None), "7": (None, None), "8": ("BSD-3-Clause", "file")}


def test_license_anchors_lose_nothing():
    _, parts, _ = licenses.weights()
    words = set(licenses.anchors(parts, licenses.THRESHOLD))
    for k in range(len(licenses.all_templates())):
        rest = [w for n, t, w in parts if n == k and t not in words]
        assert math.sqrt(sum(w * w for w in rest)) < licenses.THRESHOLD


# 3 toxicity


def labelled(spark, n=400):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(40)]
        if i % 8 == 0:
            words[rng.randint(0, 39)] = rng.choice(["dolt", "grumbo" + rng.choice(["la", "lix", "nem"])])
        rows.append((" ".join(words), int(i % 8 == 0)))
    return spark.createDataFrame(rows, "text string, toxic int")


def test_toxicity_learns_words_and_stems(spark):
    grammar = toxicity.fit(labelled(spark))
    assert grammar.score("what a dolt wab") > 0.3 and grammar.score("you grumbozar wab") > 0.3
    assert grammar.score("wab wac wad") < 0.3 and grammar.score("") == grammar.score(None) < 0.3
    assert grammar.mass("not a dolt") < grammar.mass("a dolt") < grammar.mass("you dolt")
    assert grammar.mass("he said dolt") < grammar.mass("he xxxx dolt")
    assert [c for c, _ in grammar.clauses("wab wac. you dolt! wad")] == ["you dolt"]


def test_toxicity_threats_before_their_target():
    grammar = toxicity.Grammar({}, {})
    one = grammar.mass("you I will kill")
    assert one > 0 and math.isclose(grammar.mass("I will kill you"), one) and math.isclose(grammar.mass("we hurt them"), one)
    assert math.isclose(grammar.mass("him I will shoot, soon"), one) and math.isclose(grammar.mass('"kill" and (hurt) them'), 2 * one)
    assert 0 < grammar.mass("never kill him") < one and 0 < grammar.mass("he said kill them") < 2 * one
    assert grammar.mass("kill the weeds") == grammar.mass("kill one two three four five you") == 0
    assert grammar.mass("kill. You") == grammar.mass("you; kill") == 0 and math.isclose(grammar.mass("you will kill, now"), one)


def mass_by_force(grammar, text):
    """Every insult and threat against every other token of its clause."""
    total = 0.0
    for clause in toxicity.CLAUSE.split(text.lower()):
        tokens = toxicity.WORD.findall(clause)
        for i, w in enumerate(tokens):
            stem = next((w[:k] for k in range(min(len(w) - 1, 8), 2, -1) if w[:k] in grammar.stems), None)
            insult = grammar.words.get(w, grammar.stems.get(stem))
            if insult is None and w not in toxicity.THREAT:
                continue
            near = any(t in toxicity.TARGET and 0 < abs(i - j) <= toxicity.REACH and t not in grammar.words for j, t in enumerate(tokens))
            weight = (toxicity.TARGETED if near else 1.0) * insult if insult is not None else toxicity.TARGETED * toxicity.THREAT_WEIGHT * near
            for words, left in ((toxicity.NEGATION, grammar.negated), (toxicity.REPORTED, grammar.spoken)):
                if any(t in words for t in tokens[max(0, i - toxicity.REACH) : i]):
                    weight *= left
            total += weight
    return total


def test_toxicity_against_brute_force():
    rng = random.Random(14)
    grammar = toxicity.Grammar({"dolt": 2.0, "oaf": 3.5}, {"grum": 1.5, "grumbo": 2.5}, negated=0.4, spoken=0.6)
    words = ["dolt", "oaf", "grumpy", "grumbola", "grum", "kill", "hurt", "you", "ihn", "not", "nie", "said", "dit", "and", "the", "x1", "l'eau", ".", "\n", ",", "?!"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        assert math.isclose(grammar.mass(text), mass_by_force(grammar, text), abs_tol=1e-9), text
        assert math.isclose(sum(m for _, m in grammar.clauses(text)), grammar.mass(text), abs_tol=1e-9)


def test_transducers_compose():
    a, b = toxicity.governed(toxicity.NEGATES, {toxicity.INSULT: 0.5}), toxicity.governed(toxicity.REPORTS, {toxicity.INSULT: 0.25})
    both = a.compose(b)
    rng = random.Random(15)
    for _ in range(50):
        x = y = z = 0
        for c in [rng.randrange(toxicity.CLASSES) for _ in range(30)]:
            assert both.weight[z][c] == a.weight[x][c] * b.weight[y][c]
            x, y, z = a.to[x][c], b.to[y][c], both.to[z][c]


def test_toxicity_learns_what_negation_leaves(spark):
    rows = [("you dolt", 1)] * 60 + [("not a dolt", 0)] * 3 + [("all is well here", 0)] * 300
    grammar = toxicity.fit(spark.createDataFrame([(f"{t} n{i}", y) for i, (t, y) in enumerate(rows)], "text string, toxic int"))
    assert grammar.words.get("dolt") and grammar.negated < toxicity.NEGATED and grammar.spoken == toxicity.SPOKEN


def test_toxicity_odd_rows(spark):
    for grammar in (toxicity.fit(labelled(spark, 0)), toxicity.fit(labelled(spark))):
        rows = [*ODD, (90, "you dolt " * 20_000), (91, "you dolt"), (91, "you dolt")]
        out = toxicity.score(docs(spark, rows).withColumn("score", F.lit("x")).withColumn("clauses", F.lit("y")), grammar, with_clauses=True).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] == 91}) == 1
        assert toxicity.score(docs(spark, []), grammar).count() == 0


@pytest.mark.parametrize(("name", "label", "positive"), [("op3_toxicity", "toxic", 1), ("op9_quality", "quality", 0)])
def test_held_out_recall_and_precision(spark, name, label, positive):
    sf = "/root/testdata/sf0.1"
    got = entry.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    caught = sum(r["predicted"] == r[label] == positive for r in got)
    assert caught >= 0.9 * sum(r[label] == positive for r in got)
    assert caught >= 0.9 * sum(r["predicted"] == positive for r in got)


# 4 language model


def exact_score(trained, train, text):
    """The mixture's log10 probability of a text by counting, with pair counts rounded down to powers of two."""
    c, pairs = Counter(), Counter()
    for t in train:
        words = ngram_bloom.tokens_of(t)
        c.update(words)
        pairs.update(zip([None, *words], words, strict=False))
    n, v = sum(c.values()), len(c)
    total, words = 0.0, ngram_bloom.tokens_of(text)
    for before, w in zip([None, *words], words, strict=False):
        p1, k = (c[w] + 1) / (n + v + 1), c[before] if before is not None else 0
        seen = pairs[before, w]
        weight = trained.model.weights[ngram_bloom.bucket_of(np.array([float(k)]))[0]] if k else 0.0
        p2 = min(1.0, 2 ** int(math.log2(seen)) / k) if k and seen else 0.0
        total += math.log10(weight * p2 + (1 - weight) * p1)
    return total


def test_language_model_against_counts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("The cat Sat on a mat and ran".split()) for _ in range(rng.randint(0, 40)))) for i in range(150)] + ODD
    df = docs(spark, rows).select("doc_id", "text")
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    held = entry.remainder(F.col("doc_id"), 7) == 2
    c = Counter(w for t in train for w in ngram_bloom.tokens_of(t))
    n, v = sum(c.values()), len(c)
    results = []
    for options in ({}, {"max_broadcast_tokens": 0, "max_part_bits": 2500, "group_tokens": 200}):
        trained = ngram_bloom.fit(df.where(~held), **options)
        assert (len(trained.model.starts) > 1) == ("max_part_bits" in options) and (trained.model.weights > 0).any()
        out = ngram_bloom.score(df.withColumn("base_score", F.lit(1)).withColumn("n", F.lit(2)), trained).collect()
        assert len(out) == len(rows)
        for r in out:
            if r["doc_id"] is not None and 6 < r["doc_id"] < 150:
                words = ngram_bloom.tokens_of(rows[r["doc_id"]][1])
                assert r["train_tokens"] == n and r["n_tokens"] == len(words) and r["n_known"] == sum(c[w] > 0 for w in words)
                assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
                assert math.isclose(r["score"], exact_score(trained, train, rows[r["doc_id"]][1]), rel_tol=0.02)
        results.append(sorted(str((r["doc_id"], r["n_tokens"], round(r["base_score"], 6))) for r in out))
    assert results[0] == results[1]


def test_mixing_weights_see_all_training_texts(spark):
    rng = random.Random(12)
    kinds = [" ".join(f"l{rng.randint(0, k + 1)}" for _ in range(8)) for k in range(20)]
    rows = [(i, kinds[i % 20]) for i in range(3000)]  # groups of copies
    trained = ngram_bloom.fit(docs(spark, rows))
    found, gain = ngram_bloom.filter_part(trained, 0), np.zeros((ngram_bloom.BUCKETS, len(ngram_bloom.GRID)))
    for _, text in rows:
        h = np.array([ngram_bloom.hash_of(t) for t in ngram_bloom.tokens_of(text)], np.uint64)
        single, before = ngram_bloom._unigram_parts(trained.model, trained.model.unigram(h), np.array([0]))
        pair = ngram_bloom.count_of(found.levels(ngram_bloom.pair_hashes(h, np.array([0]))))
        p2 = np.minimum(np.where(before > 1, np.maximum(pair - 1, 0) / np.maximum(before - 1, 1), 0.0), 1.0)
        for k, p, q in zip(ngram_bloom.bucket_of(before), p2, single, strict=True):
            gain[k] += np.log(ngram_bloom.GRID * p + (1 - ngram_bloom.GRID) * q)
    chosen = np.searchsorted(ngram_bloom.GRID, trained.model.weights)
    loss = gain.max(axis=1) - gain[np.arange(len(gain)), chosen]
    assert (loss <= 1e-3 * np.abs(gain).max(axis=1) + 1e-9).all()  # the bins' rounding


def test_language_model_copies_no_text_beyond_its_broadcasts(spark):
    rng = random.Random(14)
    df = docs(spark, [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 10**9}" for _ in range(300))) for i in range(400)]).select("doc_id", "text")
    train, shared = df.where("doc_id % 7 != 2"), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    made, sizes = [], []
    for options in ({}, {"max_broadcast_tokens": 50, "max_part_bits": 100_000}, {"max_broadcast_tokens": 0, "max_part_bits": 20_000}):
        before = set(shared.rglob("*.parquet"))
        trained = ngram_bloom.fit(train, group_tokens=5000, **options)
        made.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in ngram_bloom.score(df, trained).collect()})
        assert (len(trained.model.starts) > 1) == bool(options) and len(trained.model.hashes) <= options.get("max_broadcast_tokens", 10**6)
        sizes.append(sum(f.stat().st_size for f in set(shared.rglob("*.parquet")) - before))
    assert all(set(m) == set(made[0]) and np.allclose([m[i] for i in made[0]], list(made[0].values()), rtol=1e-9) for m in made)
    assert 0 < max(sizes) < 2 * sizes[0]


def test_texts_cross_chunks_and_batches(spark, monkeypatch):
    rng = random.Random(15)
    df = docs(spark, [(i, " ".join(rng.choices("a b c d e f".split(), k=rng.randint(0, 30)))) for i in range(500)] + ODD).select("doc_id", "text", "lang")
    held = entry.remainder(F.col("doc_id"), 7) == 2
    whole = ngram_bloom.fit_and_score(df, ~held).collect()
    apart = ngram_bloom.score(df, ngram_bloom.fit(df.where(~held))).collect()
    monkeypatch.setattr(ngram_bloom, "CHUNK_TOKENS", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        small = ngram_bloom.fit_and_score(df, ~held, group_tokens=500).collect()
        assert ngram_bloom.encode(df).count() > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    as_key = lambda r: (str(r["doc_id"]), r["lang"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 1))
    assert sorted(map(as_key, whole)) == sorted(map(as_key, apart)) and len(whole) == 500 + len(ODD)
    assert sorted(k[:5] for k in map(as_key, whole)) == sorted(k[:5] for k in map(as_key, small))


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    n = rng.integers(1, 3000, 4000)
    level, group = ngram_bloom.level_of(n), ngram_bloom.group_of(h, 8)
    assert (level == np.floor(np.log2(n)) + 1).all() and (ngram_bloom.count_of(level) <= n).all()
    made = [ngram_bloom.segment(h[group == g], g, level[group == g]) for g in range(8)]
    whole = ngram_bloom.Filter(8, 0, np.array([len(x) for x in made]), np.concatenate(made))
    got = whole.levels(h)
    assert (got >= level).all() and (got == level).mean() > 0.98
    assert (whole.levels(rng.integers(0, 2**64, 20_000, dtype=np.uint64)) > 0).mean() < 0.02
    half = ngram_bloom.Filter(8, 4, np.array([len(x) for x in made[4:]]), np.concatenate(made[4:]))
    assert (half.mine(h) == (group >= 4)).all() and (half.levels(h[group >= 4]) == got[group >= 4]).all()


def test_twins_of_training_texts_score_apart(spark):
    rng = random.Random(13)
    text = lambda: " ".join(f"v{rng.randint(0, 2000)}" for _ in range(60))
    train = [(i, text()) for i in range(300)]
    tested = [(1000 + i, train[i][1] if i < 20 else text()) for i in range(100)]
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in ngram_bloom.score(docs(spark, tested), ngram_bloom.fit(docs(spark, train))).collect()}
    assert min(got[1000 + i] for i in range(20)) > max(got[1000 + i] for i in range(20, 100))


def test_language_model_without_texts(spark):
    trained = ngram_bloom.fit(docs(spark, []))
    assert ngram_bloom.score(docs(spark, ODD), trained).count() == len(ODD)
    assert ngram_bloom.score(docs(spark, []), ngram_bloom.fit(docs(spark, ODD))).count() == 0


# 5 decontamination


def test_decontaminate_edges_against_sql(spark):
    items = [(1, "one two three"), (2, " ".join(f"w{i}" for i in range(25))), (2, "alpha"), (None, "hidden words here"), (4, None), (5, "")]
    texts = [*ODD, (10, "x ONE, two-three y"), (11, " ".join(f"W{i}" for i in range(8, 20))), (12, "alpha beta alpha"), (13, "the hidden words here")]
    d, b = docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    import duckdb

    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", b.toPandas().astype({"item_id": "Int64"}))
    for bound in (10**6, 7):
        assert_same(decontaminate.digest(decontaminate.scan(d.select("doc_id", "text"), b, max_broadcast_windows=bound)), con, entry.OP5_SQL)
    assert decontaminate.digest(decontaminate.scan(d, b.limit(0))).where("contaminated").count() == 0
    assert decontaminate.scan(d.limit(0), b).count() == 0


def test_decontaminate_clashing_columns(spark):
    d = docs(spark, [(1, "alpha beta"), (1, "alpha beta"), (2, "gamma")]).withColumn("n_words", F.lit("x")).withColumn("items", F.lit("y")).withColumn("hit_positions", F.lit(1)).withColumn("_w", F.lit("w"))
    for b in ([("i", "alpha")], []):
        out = decontaminate.scan(d, spark.createDataFrame(b, "item_id string, text string"))
        rows = sorted(out.collect(), key=str)
        assert out.schema["items"].dataType.simpleString() == "array<string>" and [r["_w"] for r in rows] == ["w"] * 3
        assert sorted((r["doc_id"], r["n_words"], r["items"]) for r in rows) == [(1, 2, ["i"] if b else [])] * 2 + [(2, 1, [])]


def test_decontaminate_parts_agree_after_a_new_split(spark):
    d = docs(spark, [(i, f"w{i % 40} alpha{i % 7} beta") for i in range(200)])
    b = spark.createDataFrame([(k, f"w{k} alpha{k % 7} beta") for k in range(40)], "item_id bigint, text string")
    one = sorted(map(str, decontaminate.digest(decontaminate.scan(d, b)).collect()))
    assert one == sorted(map(str, decontaminate.digest(decontaminate.scan(d.repartition(9), b, max_broadcast_windows=7)).collect()))


# 6 urls


def test_url_rules_and_templates(spark):
    urls = [
        "http://a.com/en/1", "http://EXAMPLE.com/en/77", "http://x.example.com/en/8?q=/en/7", "https://u.org/es/", "https://n.net/de", "http://example.net/de/9/x#y", None, "no url", "://h/p", "http://",
        *[f"http://shop.io/casino/{i}" for i in range(30)], *[f"http://shop.io/news/{i}" for i in range(30)],
    ]
    rows = {r["page_id"]: r for r in url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit(1))).collect()}
    assert len(rows) == len(urls)
    assert [(rows[i]["rule"], rows[i]["verdict"]) for i in range(6)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("org/es/", "block"), (None, "allow"), ("net/de/", "block")]
    assert [(rows[i]["host"], rows[i]["path"]) for i in (6, 7, 8, 9)] == [("", ""), ("", ""), ("h", "/p"), ("", "")]
    assert rows[10]["verdict"] == "block" and rows[40]["verdict"] == "allow" and rows[10]["template"] == "/casino/*"
    assert url_templates.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_url_rules_have_the_words_of_the_contract(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert {f"{v} {h}{p}" for v, h, p in url_templates.RULES} == set(contract.split(", "))
    urls = ["http://n.com/en/1", "http://example.com/en/7", "http://n.net/de/1", "http://a.example.net/de/9", "http://a.example.net/de/8", "http://n.org/es/1"]
    rows = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id").collect()
    assert [f"{r['verdict']} {r['rule']}" for r in rows] == ["block com/en/", "allow example.com/en/7", "allow net/de/", "allow net/de/", "block example.net/de/8", "block org/es/"]


def test_url_siblings_merge_by_their_shares(spark):
    """Five sections without bad urls and three with only bad ones make two branches; one in between stays by itself."""
    rows = []
    for k, bad in enumerate([0] * 5 + [200] * 3 + [100]):
        rows += [(f"http://h.io/{'abcdefghi'[k] * 3}/p", int(i < bad)) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, None), ("http://h.io/" + "deep/" * 2000, None), (rows[0][0], 0)], "url string, bad int").withColumn("_group", F.lit(1))
    got = url_templates.judge(df, label=F.col("bad")).collect()
    assert len(got) == len(rows) + 3
    kinds = {r["path"][1]: (r["template"], r["verdict"]) for r in got if r["path"].endswith("/p")}
    assert len({kinds[c] for c in "abcde"}) == len({kinds[c] for c in "fgh"}) == 1
    assert kinds["a"][1] == "allow" and kinds["f"][1] == "block" and kinds["i"][0].startswith("/iii") and len({v[0] for v in kinds.values()}) == 3


# 7 simhash


def test_simhash_against_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(f"t{rng.randint(0, 400)}" for _ in range(120)) for _ in range(12)]
    rows = list(ODD)
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(words)))
    df = docs(spark, rows)
    for limit in (4096, 8):
        got = simhash_gray.near_duplicates(df, node_rows=limit).collect()
        prints = np.array([int(r["fingerprint"], 16) for r in got], np.uint64)
        a, b = np.triu_indices(len(prints), 1)
        near = np.bitwise_count(prints[a] ^ prints[b]) <= 4
        root = simhash_gray.forest(len(prints), a[near], b[near])
        for r, k in zip(got, root, strict=True):
            ids = [x["doc_id"] for x, q in zip(got, root, strict=True) if q == k and x["doc_id"] is not None]
            assert r["component_id"] == min(ids, default=None)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert simhash_gray.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 17, 65, 500])
def test_gray_index_pairs(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
    for _ in range(4):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    x = np.unique(x)
    x = x[np.argsort(simhash_gray.gray_rank(x))]
    a, b = np.triu_indices(len(x), 1)
    near = np.bitwise_count(x[a] ^ x[b]) <= 4
    got = simhash_gray.run_pairs(x, 4)
    assert set(zip(*map(list, got), strict=True)) == set(zip(a[near].tolist(), b[near].tolist(), strict=True))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in simhash_gray.components(edges).collect()} == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def jaccard_kept(rows):
    """Documents that a brute-force near-dedup at 0.8 keeps."""
    sets = [frozenset(simhash_gray.shingle_hashes(t, 5).tolist()) for _, t in rows]
    a, b = [], []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a.append(i)
                b.append(j)
    root = simhash_gray.forest(len(rows), np.array(a, int), np.array(b, int))
    return {min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root.tolist())}


def test_similar_groups_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"v{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 60, 200])))) for i in range(40)]
    for i in range(60):
        words = rows[rng.randrange(40)][1].split()
        for _ in range(len(words) // 60):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(300, ""), (301, None), (302, "short text"), (303, "short text")]
    got = {r["doc_id"] for r in simhash_similar.deduplicated(docs(spark, rows)).collect()}
    assert got == jaccard_kept(rows)
    again = simhash_similar.deduplicated(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "x y")])).collect()
    assert sorted(str(r["doc_id"]) for r in again) == ["1", "None"]


def sharing_passage(rng, others, pairs):
    """Rows of texts with 300 shingles that share 258 (Jaccard 0.754), and after them pairs that share 270 (0.818)."""
    passage = [f"p{i}" for i in range(262)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(42)])) for i in range(others)]
    for k in range(pairs):
        more = [f"m{rng.randrange(10**9)}" for _ in range(12)]
        rows += [(others + 2 * k + j, " ".join(passage + more + [f"o{rng.randrange(10**9)}" for _ in range(30)])) for j in range(2)]
    return rows


def test_texts_sharing_a_passage_stay(spark):
    rows = sharing_passage(random.Random(9), 400, 0)
    assert {r["doc_id"] for r in simhash_similar.deduplicated(docs(spark, rows)).collect()} == jaccard_kept(rows) == set(range(400))


def test_true_links_behind_failed_ones(spark):
    rows = sharing_passage(random.Random(11), 250, 20)
    kept = {r["doc_id"] for r in simhash_similar.deduplicated(docs(spark, rows)).collect()}
    assert kept == jaccard_kept(rows) and len(kept) == 270


def test_large_patterns_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 8, (70, 2)), axis=0)
    rows = [(k, k, int(a), int(b), 10) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "cid bigint, root bigint, fp bigint, fp2 bigint, n bigint")
    for limit in (4096, 6):
        met = {}
        for r in simhash_similar.unsettled(df, limit).collect():
            met.setdefault(r["block"], []).append(r["cid"])
        pairs = {(a, b) for ids in met.values() for a in ids for b in ids if a < b}
        assert len(pairs) == len(rows) * (len(rows) - 1) // 2
    assert simhash_similar.unsettled(df.withColumn("root", F.lit(1).cast("long")), 6).count() == 0


def test_alike_sets_are_spanned():
    rng = np.random.default_rng(5)
    base = [rng.choice(10**6, 60, replace=False) for _ in range(5)]
    sets = [np.unique(np.concatenate([rng.choice(base[k % 5], 58, replace=False), rng.choice(10**6, 1 + k % 4)])).astype(np.uint32) for k in range(60)]
    i, j = simhash_similar.alike(sets)
    a, b = np.triu_indices(60, 1)
    near = np.array([len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    assert (simhash_gray.forest(60, i, j) == simhash_gray.forest(60, a[near], b[near])).all() and len(i) < near.sum()


# 8 search


def best_by_force(rows, text, k):
    """[(doc_id, score)] by scoring every document."""
    bags = [Counter(bmw_search.terms_of(t)) for _, t in rows]
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    df_of = Counter(w for b in bags for w in b)
    scored = []
    for (i, _), b in zip(rows, bags, strict=True):
        s = sum(n * math.log(1 + (len(rows) - df_of[w] + 0.5) / (df_of[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, n in Counter(bmw_search.terms_of(text)).items() if w in b)
        scored.append((-round(s, 6), -1 if i is None else i))
    return [(None if i < 0 else i, -s) for s, i in sorted(scored) if s < 0][:k]


def test_search_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"q{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(12)] + [(1, "q1 q2"), (None, "q1 q1"), (None, None), (500, "q1 " * 70_000), (501, "q3 q3")]
    df = docs(spark, rows).withColumn("query_id", F.lit("x")).withColumn("score", F.lit(1))
    asked = [(0, "q1 q2 q3"), (1, "nothing known"), (2, None), (3, rows[5][1]), (4, rows[7][1]), (5, "q1"), (6, "zz " + rows[9][1]), (None, "q1")]
    for shard in (8192, 50):
        got = bmw_search.search(df, spark.createDataFrame(asked, "query_id bigint, text string"), 7, shard_docs=shard).collect()
        for q in (0, 3, 4, 5, 6):
            found = [(r["doc_id"], round(r["score"], 6)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
            want = best_by_force(rows, dict(asked)[q], 7)
            assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([s for _, s in found], [s for _, s in want])
        assert {r["query_id"] for r in got} == {0, 3, 4, 5, 6}
    some = spark.createDataFrame([(0, "q1")], "query_id bigint, text string")
    assert bmw_search.search(df.limit(0), some).count() == 0 and bmw_search.search(df, some.limit(0)).count() == 0
    with pytest.raises(TypeError):
        bmw_search.search(df.withColumn("doc_id", F.lit("a")), some)


def test_search_skips_blocks():
    rng = np.random.default_rng(2)
    made, docs_ = bmw_search.Hashes(), []
    for d in range(2000):
        words = [f"w{int(x)}-{d % 4}" for x in rng.zipf(1.3, 60) if x < 5000]  # four languages
        docs_.append(made.counted(" ".join(words)))
    words, terms = np.unique(np.concatenate([h for h, _ in docs_]), return_inverse=True)
    counts, sizes = np.concatenate([n for _, n in docs_]), np.array([len(h) for h, _ in docs_])
    lengths = np.array([n.sum() for _, n in docs_])
    df = np.bincount(terms, minlength=len(words))
    idf = np.log(1 + (2000 - df + 0.5) / (df + 0.5))
    index = bmw_search.Index(np.arange(2000), lengths, sizes, words, terms, counts, words, idf, lengths.mean())
    whole = np.zeros((2000, len(words)))
    whole[np.repeat(np.arange(2000), sizes), terms] = idf[terms] * counts * 2.2 / (counts + np.repeat(1.2 * (0.25 + 0.75 * lengths / lengths.mean()), sizes))
    for i in range(0, 2000, 50):
        query = (np.searchsorted(words, docs_[i][0]), docs_[i][1].astype(float))
        weight, most = index.bounds([query])
        score, place = index.top(*query, weight[0], most[0], 10, 0.0)
        exact = np.round(whole[:, query[0]] @ query[1], 9)
        best = np.lexsort((np.arange(2000), -exact))[:10]
        assert np.allclose(score, exact[best]) and (index.ids[place] == best).all()
    assert 0 < index.blocks_read < 0.5 * index.blocks


def test_search_starts_later_shards_from_reached_scores(spark):
    rng = random.Random(16)
    word = lambda d: f"{'abcde'[d % 5]}{int(rng.paretovariate(0.6)) % 3000}"  # noqa: E731 # five languages
    rows = [(d, " ".join(word(d) for _ in range(rng.randint(5, 60)))) for d in range(1200)]
    rows += [(5000 - d, rows[3][1]) for d in range(40)]  # equal scores in early and later shards
    rng.shuffle(rows)
    df, asked = docs(spark, rows), [(d, t) for d, t in rows if d < 1200 and d % 40 == 3]
    got = bmw_search.search(df.repartition(3), spark.createDataFrame(asked, "query_id bigint, text string"), 5, shard_docs=12).collect()
    for q, text in asked:
        found = [(r["doc_id"], round(r["score"], 6)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert found == [(i, pytest.approx(s, abs=2e-6)) for i, s in best_by_force(rows, text, 5)]


def test_batches_read_only_groups_that_can_reach():
    rng = np.random.default_rng(7)
    made, docs_ = bmw_search.Hashes(), []
    for d in range(1500):
        docs_.append(made.counted(" ".join(f"w{int(x)}-{d % 3}" for x in rng.zipf(1.3, 60) if x < 5000)))
    words, terms = np.unique(np.concatenate([h for h, _ in docs_]), return_inverse=True)
    counts, sizes, lengths = np.concatenate([n for _, n in docs_]), np.array([len(h) for h, _ in docs_]), np.array([n.sum() for _, n in docs_])
    idf = np.log(1 + 1500 / (np.bincount(terms) + 0.5))
    index = bmw_search.Index(np.arange(1500), lengths, sizes, words, terms, counts, words, idf, lengths.mean())
    queries = [(np.searchsorted(words, docs_[i][0]), docs_[i][1]) for i in range(0, 1500, 10)]
    cold = index.several(queries, *index.bounds(queries), 10, np.zeros(len(queries)))
    alone = [index.top(*q, *(x[0] for x in index.bounds([q])), 10, 0.0) for q in queries]
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() and len(a[0]) == 10 for a, b in zip(cold, alone, strict=True))
    before = index.blocks_read
    reached = np.array([score[4] for score, _ in cold])  # as if other shards had reached it
    hot = index.several(queries, *index.bounds(queries), 10, reached)
    assert all((a[0] == b[0][b[0] >= b[0][4]]).all() for a, b in zip(hot, cold, strict=True))
    assert index.blocks_read - before < 0.5 * index.blocks / 3  # most of the other two languages is left alone


def test_left_over_documents_are_no_shard_of_their_own(spark):
    df = docs(spark, [(i, f"a b{i}") for i in range(110)]).coalesce(1)
    packed = bmw_search.shards(df, "doc_id", "text", 100).select("lot", "n").collect()
    assert [r["n"] for r in packed] == [110]
    packed = bmw_search.shards(df, "doc_id", "text", 40).select("lot", "n").collect()
    assert [r["n"] for r in packed] == [40, 40, 30] and len({r["lot"] for r in packed}) == 3


# 9 quality


def test_quality_odd_rows(spark):
    data = [("Some plain text here, with words.", 1)] * 5 + [("SOME!! BAD!! TEXT!!", 0)] * 5 + [("x", None), (None, 1)]
    model = knn_quality.fit(spark.createDataFrame(data, "text string, quality int"))
    out = knn_quality.score(docs(spark, [*ODD, (50, "Plain words of text, with some more."), (51, "OTHER!! BAD!! WORDS!!")]).withColumn("score", F.lit(1)), model)
    by_id = {r["doc_id"]: r["score"] for r in out.collect()}
    assert by_id[50] > 0.3 > by_id[51] and by_id[1] == by_id[2] == by_id[3] == 0
    empty = knn_quality.fit(spark.createDataFrame([], "text string, quality int"))
    assert knn_quality.score(docs(spark, ODD), empty).count() == len(ODD)


# 10 mixing


def water(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def test_mix_targets_and_rounding(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["big", "big", "big", "Ärm", "a", "z", None]) if i % 50 else "tiny", 0) for i in range(3000)] + [(None, None, None, "none", None)]
    df = spark.createDataFrame(rows, DOC)
    out = pivotal_mix.digest(pivotal_mix.mix(df, chunk_rows=64, fan_in=4)).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    target = water(dict(sizes))
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert all(math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 31
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    again = pivotal_mix.digest(pivotal_mix.mix(df.repartition(7), chunk_rows=64, fan_in=4)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert pivotal_mix.mix(df.limit(0)).count() == 0


def test_mix_takes_the_rows_it_rounded(spark):
    rng = random.Random(16)
    rows = [(i if i % 9 else None, "w " * rng.randint(0, 9), "en", rng.choice("abc"), i) for i in range(600)] + [(7, "same text", "en", "a", 7)] * 50 + [(8, "long " * 30_000, "en", "b", 8)]
    df = spark.createDataFrame(rows, DOC).withColumn("copies", F.lit("x")).withColumn("_rid", F.lit(5))
    taken = pivotal_mix.take(df).collect()
    assert all(1 <= r["copies"] <= 3 and r["_rid"] == 5 and (r["text"] or "").strip() for r in taken)
    want = sorted((str(r["doc_id"]), r["source"], r["copies"]) for r in pivotal_mix.mix(df).where("copies > 0").collect())
    assert want == sorted((str(r["doc_id"]), r["source"], r["copies"]) for r in taken)
    assert want == sorted((str(r["doc_id"]), r["source"], r["copies"]) for r in pivotal_mix.take(df.repartition(11)).collect())
    assert pivotal_mix.take(df.limit(0)).count() == 0


def test_pivotal_rounding_keeps_expectations():
    import pandas as pd

    rng = np.random.default_rng(1)
    taken = np.zeros(5)
    for _ in range(4000):
        rows = pd.DataFrame({"size": [3, 5, 2, 7, 4], "p": [0.3] * 5, "u": rng.random(5), "v": rng.permutation(5), "i": range(5)})
        out = pivotal_mix.settle(rows)
        left = out["p"].notna()
        taken[out["i"]] += out["extra"] + np.where(left, out["p"].fillna(0).astype(float), 0)
    assert np.allclose(taken / 4000, 0.3, atol=0.03)


# pipeline


def test_pipeline_stages(spark):
    """Every stage against a version that looks at one text, or all of them, in the driver."""
    docs_now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs_now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs_now.collect()}
        after = stage(spark, docs_now, SF)
        rows = after.collect()
        kept = {r["doc_id"] for r in rows}
        assert kept <= set(before) and kept, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
            next_docs = corpus_pipeline.cut(after, "test-stage")
        if name == "toxicity":
            grammar = entry.toxicity_grammar(spark, SF, docs_now)
            mass = lambda t: mass_by_force(grammar, t or "")
            rated = {i: grammar.floor if not mass(t) else 1 / (1 + math.exp(-(grammar.slope * math.log1p(mass(t)) + grammar.offset))) for i, t in before.items()}
            assert kept == {i for i, s in rated.items() if s < entry.PREDICT_AT}
        if name == "quality classifier":
            model = entry.quality_model(spark, SF, docs_now)
            assert kept == {i for i, t in before.items() if vote_by_force(model, t) >= entry.PREDICT_AT}
        if name == "SimHash near-dedup":
            assert kept == jaccard_kept(list(before.items()))
        if name == "benchmark decontamination":
            grams = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = plain_words(r["text"])
                grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(g) for g in grams}
            clean = lambda w: not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))
            assert kept == {i for i, t in before.items() if clean(plain_words(t))}
        if name == "mixing sources to target weights":
            sizes, taken = Counter(), Counter()
            for r in docs_now.collect():
                sizes[r["source"]] += len((r["text"] or "").split())
            for r in rows:
                assert 1 <= r["copies"] <= 3
                taken[r["source"]] += r["copies"] * len((r["text"] or "").split())
            longest = max(len((t or "").split()) for t in before.values())
            assert all(abs(taken[x] - t) <= longest for x, t in water(dict(sizes)).items())
        docs_now = next_docs


def plain_words(text):
    """Words of a text for decontamination, by character."""
    out, word = [], ""
    for c in (text or "") + " ":
        if c >= "\x80" or c in "0123456789" or "a" <= c <= "z" or "A" <= c <= "Z":
            word += c.lower() if c < "\x80" else c
        elif word:
            out.append(word)
            word = ""
    return out


def vote_by_force(model, text):
    """The neighbours' vote for one text, by one cosine at a time."""
    features = knn_quality.Features().vector(text)
    if not np.abs(features).sum():
        return 0.0
    x = features.astype(np.float64) @ model.basis
    x /= max(np.linalg.norm(x), 1e-12)
    cosines = sorted(((float(v @ x), -k) for k, v in enumerate(model.vectors.astype(np.float64))), reverse=True)
    near = [(c, k) for c, k in cosines if c >= cosines[min(knn_quality.NEIGHBOURS, len(cosines)) - 1][0] - knn_quality.TIE]
    weight = [max(c, 0.0) ** knn_quality.SHARPNESS * (1.0 if model.votes[-k] > 0.5 else model.prior / max(1e-6, 1 - model.prior)) for c, k in near]
    return (sum(w * model.votes[-k] for w, (_, k) in zip(weight, near, strict=True)) + 1e-3 * model.prior) / (sum(weight) + 1e-3)


def test_quality_against_brute_force(spark):
    sf_docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = entry.quality_model(spark, SF, sf_docs)
    got = {r["doc_id"]: r["score"] for r in entry.QUERIES["op9_quality"](spark, SF).collect()}
    off = [abs(got[r["doc_id"]] - vote_by_force(model, r["text"])) for r in sf_docs.collect()]
    assert np.max(off) < 1e-3
    assert knn_quality.score(sf_docs.limit(0), model).count() == 0


def test_quality_of_ties_does_not_depend_on_order():
    rng = np.random.default_rng(9)
    vectors = np.repeat(rng.normal(size=(8, 4)), 40, axis=0).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    votes = (np.arange(320) % 3 > 0).astype(float)
    features = rng.normal(size=(700, 4)).astype(np.float32)
    order = rng.permutation(320)
    one = knn_quality.Model(np.eye(4, dtype=np.float32), vectors, votes, 0.6).scores(features)
    other = knn_quality.Model(np.eye(4, dtype=np.float32), np.ascontiguousarray(vectors[order]), votes[order], 0.6).scores(features)
    assert np.abs(one - other).max() < 1e-4
    assert np.abs(one - np.concatenate([knn_quality.Model(np.eye(4, dtype=np.float32), vectors, votes, 0.6).scores(f[None]) for f in features])).max() < 1e-4


def test_pipeline_odd_documents(spark):
    odd = docs(spark, [*ODD, (4, "a"), (7, "word " * 50_000)]).withColumn("score", F.lit("x")).withColumn("_row", F.lit("y")).withColumn("items", F.lit(1))
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == rows.columns and out.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() <= rows.count()
