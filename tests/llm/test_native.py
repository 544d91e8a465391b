"""Hilbert shards, winnowing, licence rules and main text."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import extract as X
from plumbline.llm import hilbert as H
from plumbline.llm import licences as R
from plumbline.llm import winnow as N


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_moves_by_one(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    index = H.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def documents(spark, n=500):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(0, 90), r.choice(["en", "de", None]), "src0" if i % 3 == 0 else f"src{r.randrange(30)}", r.randrange(1000)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_shards_have_equal_counts_without_gaps(spark):
    df, rows = documents(spark)
    s = H.Settings(shards=7, run_rows=20)
    out = H.assign(df, s).collect()
    assert len({r["doc_id"] for r in out}) == len(rows) == len(out)
    shards = {k: sorted(r["slot"] for r in out if r["shard"] == k) for k in range(7)}
    assert all(v == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    in_order = [r["hilbert"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert in_order == sorted(in_order)


def test_runs_are_pruned_by_their_ranges(spark):
    df, _ = documents(spark)
    placed = H.assign(df, H.Settings(run_rows=20))
    held = H.manifest(placed, ("dim_source", "dim_n_chars"))
    wanted = {"dim_source": ("src0", "src0"), "dim_n_chars": (0, 200)}
    runs = {(r["shard"], r["run"]) for r in H.runs_meeting(held, wanted).collect()}
    needed = {(r["shard"], r["run"]) for r in placed.where("dim_source = 'src0' AND dim_n_chars <= 200").collect()}
    assert needed <= runs and len(runs) < 0.6 * held.count()


def test_quantiles_are_those_of_the_sorted_values(spark):
    df, rows = documents(spark)
    for name, i in (("source", 3), ("n_chars", 4), ("lang", 2)):
        held = sorted(r[i] for r in rows if r[i] is not None)
        want = []
        for v in sorted(set(held)):
            below, upto = sum(x < v for x in held), sum(x <= v for x in held)
            want += [v] if below * 8 // len(held) < upto * 8 // len(held) else []
        assert H.quantiles(df.repartition(5), name, 8) == want[:7]


def test_cells_order_long_strings_and_the_cut_is_the_same_again(spark):
    hosts = [f"https://www.{x}.org/a/long/path/{i}" for i, x in enumerate(["alpha", "beta", "zeta"] * 40)]
    rows = [(i, f"t{i}", h, i) for i, h in enumerate([*hosts, "hq"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, n int")
    s = H.Settings(dimensions=("url", "n"), run_rows=5)
    out = H.assign(df, s)
    held = H.manifest(out, ("dim_url",))
    met = H.runs_meeting(held, {"dim_url": ("https://www.zeta", "https://www.zetz")}).count()
    assert 0 < met < 0.6 * held.count()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, H.assign(df.repartition(9), s).collect()))


def test_shards_are_those_of_plain_sorting(spark):
    df, rows = documents(spark)
    s = H.Settings(shards=7, run_rows=20)
    bounds = [H.quantiles(df, d, 1 << s.bits) for d in s.dimensions]
    cells = np.array([[0 if r[i] is None else sum(b < r[i] for b in bs) for i, bs in zip((3, 2, 4), bounds, strict=True)] for r in rows])
    order = sorted(range(len(rows)), key=lambda k: (H.hilbert_index(cells[k : k + 1], s.bits)[0], zlib.crc32(rows[k][1].encode()), rows[k][0]))
    want, n = {}, len(rows)
    for rank, k in enumerate(order):
        shard = rank * 7 // n
        want[rows[k][0]] = (shard, rank - -(-shard * n // 7), len(rows[k][1].encode()) + 1, zlib.crc32(rows[k][1].encode()))
    assert {r["doc_id"]: (r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in H.assign(df, s).collect()} == want


# ---- winnowing ----


def tokens(text):
    """Runs without white space, of at most 12 characters whole and of more by character; each ideograph alone."""
    out = []
    for run in re.findall(r"[一-鿿぀-ヿ]|[^\s一-鿿぀-ヿ]+", (text or "").lower()):
        out += [run] if len(run) <= 12 else list(run)
    return out


def prints(text, k=3, w=4):
    """Brute force, with the hash of a token from its definition."""
    h = [_token_hash(t) % N.PRIME for t in tokens(text)]
    if not h:
        return []
    grams = []
    for i in range(max(1, len(h) - k + 1)):
        g = 0
        for x in h[i : i + k] if len(h) >= k else h:
            g = (g * N.BASE + x) % N.PRIME
        grams.append(g)
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        window = range(i, min(len(grams), i + w))
        best = min(window, key=lambda j: (grams[j], -j))
        if (grams[best], best) not in chosen:
            chosen.append((grams[best], best))
    return chosen


def _token_hash(t):
    v = xxhash.xxh64_intdigest(t.encode(), seed=42)
    return v - (1 << 64) if v >= 1 << 63 else v


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("per_bucket", [3, 4000])
def test_fingerprints_and_neighbours_are_those_of_brute_force(spark, per_bucket):
    r = random.Random(6)
    rows = [(i * 7 % 101, " ".join(r.choice(["Aa", "bb", "c", "the", "日本", "é", "longerthantwelveletters"]) for _ in range(r.choice([0, 1, 2, 5, 40])))) for i in range(40)]
    rows += [(500, None), (501, ""), (rows[0][0], "another text of the same id"), (502, "x" * 40 + " " + "abcdefghijklmnopq" * 3)]
    rows += [(77, f"text {i % 9} of an id that many have") for i in range(30)] + [(None, f"no id {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = N.compare_with_next(df, N.Settings(rows_per_bucket=per_bucket)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), _token_hash(x[1]) % N.DEALT, _token_hash(x[1]), x[1]))
    after = [(x, order[(n + 1) % len(order)][1]) for n, x in enumerate(order)]
    assert len(out) == len(rows)
    show = lambda p: ",".join(f"{h:X}:{i:X}" for h, i in p)
    want = []
    for (i, t), nxt in after:
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(prints(t)), show(prints(edited)), likeness(prints(t), prints(edited)), likeness(prints(t), prints(nxt))))
    got = [tuple(r) for r in out]
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[3], x[6])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_passages_of_long_runs_are_found_wherever_they_begin(spark):
    r = random.Random(5)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    rows = []
    for i in range(40):
        shared = say(6)
        rows.append((i, say(13 + i) + shared + say(20), say(29) + shared + say(13)))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    assert df.select(F.arrays_overlap(N.hashes(N.fingerprint(F.col("a"))), N.hashes(N.fingerprint(F.col("b")))).alias("x")).where("x").count() == 40


def test_shared_runs_are_always_found(spark):
    s, r = N.Settings(k=3, w=4), random.Random(8)
    say = lambda n: [f"t{r.randrange(10_000)}" for _ in range(n)]
    rows = []
    for i in range(30):
        shared = say(s.k + s.w - 1)
        rows.append((i, " ".join(say(20) + shared + say(9)), " ".join(say(3) + shared + say(30))))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    assert df.select(F.arrays_overlap(N.hashes(N.fingerprint(F.col("a"), s)), N.hashes(N.fingerprint(F.col("b"), s))).alias("x")).where("x").count() == 30


# ---- licences ----


def scan(spark, *texts):
    return [r.asDict() for r in R.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_hundreds_of_rules_whose_matches_pass_the_gate():
    all_rules = R.rules()
    assert len(all_rules) > 300 and len({r.name for r in all_rules}) == len(all_rules)
    gate = re.compile(R.gate())
    for r in all_rules:
        assert r.keyword and (r.keyword in r.pattern or "(" in r.pattern), r
        sample = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)(\?)?", r"\1", r.pattern.replace("(?<= )", " ").replace("(?= )", " "))
        for _ in range(5):
            sample = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)(?:[?*]|\{[\d,]+\})?", r"\1", sample)
        sample = re.sub(r"\[(.)[^\]]*\]\*?", r"\1", sample).replace("?", "").replace("\\d", "1").replace("*", "")
        if re.search(r.pattern, f" {sample.strip()} "):
            assert gate.search(sample), (r, sample)


def test_base_phrases_are_counted_where_their_words_stand(spark):
    a, b, c, d, e = scan(spark, "One CC-BY two, cc by; General\nPublic   LICENSE all rights reserved", "ccby cc bye generalpublic license", None, "All Rights Reserved.", "cc cc by by")
    assert (a["n_words"], a["n_base"], a["first_word"], a["last_word"]) == (12, 4, 1, 9)
    assert a["base_labels"] == "cc-by,gpl,reserved" and {"cc-by", "gpl", "reserved"} <= set(a["labels"].split(","))
    assert b["n_base"] == 0 and b["first_word"] is None and b["base_labels"] == ""
    assert c["n_words"] == 0 and c["score"] == 0 and c["labels"] == ""
    assert d["base_labels"] == "reserved" and 0 < d["score"] <= 1
    assert (e["n_base"], e["first_word"]) == (1, 1)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("Licensed under the GNU Lesser General Public License v2.1 or later", "lgpl-2.1-or-later"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Creative Commons Attribution-ShareAlike 3.0 Unported", "cc-by-sa-3.0"),
    ],
)
def test_the_most_specific_reading_stays(spark, text, label):
    (row,) = scan(spark, f"Some words before. {text} And some after.")
    assert label in row["labels"].split(","), row
    assert row["score"] >= 0.7


def test_detections_within_better_ones_are_dropped(spark):
    (row,) = scan(spark, "Licensed under the GNU General Public License, version 3.")
    assert [d["label"] for d in row["detections"]] == ["gpl-3"]
    (two,) = scan(spark, "MIT License. " * 3 + "Apache License, Version 2.0")
    assert sorted(d["label"] for d in two["detections"]) == ["apache-2.0", "mit", "mit", "mit"]


HEADERS = {
    "gpl-2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3-or-later": "This is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-only": "it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 only.",
    "lgpl-2.1-or-later": "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3-or-later": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at its site.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}


def test_usual_headers_have_their_label(spark):
    for (label, _), row in zip(HEADERS.items(), scan(spark, *HEADERS.values()), strict=True):
        assert label in row["labels"].split(","), (label, row)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_detections(text):
    """Every match of every rule whose keyword is there, and those that no other holds, by all pairs."""
    held = " ".join(["", *plain_words(text), ""])
    found = []
    groups = {}
    for r in R.rules():
        groups.setdefault(r.keyword.split(" ")[0], []).append(r)
    for first, rs in groups.items():
        for r in rs:
            if first in held and r.keyword in held and r.also in held:
                found += [(m.start(), m.end(), r.priority, r.label) for m in re.finditer(r.pattern, held)]

    def beats(i, o, j, d):
        if i == j or o[0] > d[0] or o[1] < d[1] or o[2] > d[2]:
            return False
        return o[2] < d[2] or o[1] - o[0] > d[1] - d[0] or (o[1] - o[0] == d[1] - d[0] and i < j)

    return sorted(d for j, d in enumerate(found) if not any(beats(i, o, j, d) for i, o in enumerate(found)))


def test_base_phrases_and_detections_are_those_of_brute_force(spark):
    r = random.Random(4)
    bits = [*HEADERS.values(), "CC BY", "cc by-sa 4.0", "General Public License", "All rights reserved.", "MIT License.", "the cc", "by", "word", "GPL v2 or later", "public license", "é", "Apache"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(0, 12))) for _ in range(60)]
    for text, row in zip(texts, scan(spark, *texts), strict=True):
        w = plain_words(text)
        places = sorted((i, label) for p, label in R.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (row["n_words"], row["n_base"]) == (len(w), len(places))
        assert (row["first_word"], row["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert row["base_labels"] == ",".join(sorted({x for _, x in places}))
        found = brute_detections(text)
        assert sorted((d["begin"], d["end"], d["priority"], d["label"]) for d in row["detections"]) == found
        assert row["labels"] == ",".join(sorted({x for _, x in places} | {d[3] for d in found}))


def test_a_text_of_very_many_matches_takes_seconds(spark):
    began = time.monotonic()
    (row,) = scan(spark, "MIT License. " * 100_000)
    assert len(row["detections"]) == 100_000 and [d["begin"] for d in row["detections"][:3]] == [1, 13, 25]
    assert time.monotonic() - began < 90


# ---- main text ----


def test_the_best_region_is_the_best_of_all():
    r = np.random.default_rng(3)
    for _ in range(200):
        x = r.integers(-4, 5, r.integers(0, 12)).tolist()
        a, b = X.best_region(x)
        best = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert sum(x[a:b]) == max(0, best)


def test_labelled_pages_give_their_main_text():
    w = X.learn(X.LABELLED)
    for page, main in X.LABELLED:
        assert X.main_text(page, w) == main
    assert all(v < 0 for v in w.tag.values()) and w.word["article p"] > 0 > w.word["never"]


def test_frames_around_an_article_go():
    w = X.learn(X.LABELLED)
    page = """<html><head><title>t</title></head><body><div id="cookie-notice"><p>We use cookies</p></div><header>Site</header><nav><a href=/>Home</a></nav>
    <article><header><h1>Head&nbsp;line</h1></header><p>First   para &lt;with&gt; <b>bold</b>
    text<p>Second<br>line<script>var x = "<p>no</p>"</script><aside>Buy!</aside><form><input><button>Go</button></form><ul><li>one<li>two</ul>
    <div class="comments"><p>Great!</p></div></article><div class="sidebar">links</div><footer>&copy; x</footer></body></html>"""
    assert X.main_text(page, w) == "Head line\nFirst para <with> bold text\nSecond\nline\none\ntwo"


def test_names_of_wrappers_do_not_silence_an_article():
    w = X.learn(X.LABELLED)
    parts = "".join(f"<p>{p}</p>" for p in ("One long paragraph of the text stands here.", "And another one follows it here."))
    want = "One long paragraph of the text stands here.\nAnd another one follows it here."
    for name in ("no-sidebar", "has-sidebar", "header-fixed", "page-with-comments", "entry-header", "sidebar", "widget"):
        assert X.main_text(f'<body><div class="{name}"><article><h1>Head</h1>{parts}</article></div></body>', w) == f"Head\n{want}"
        assert X.main_text(f'<body><div class="{name}">{parts}</div></body>', w) == want
    for name in ("discussion", "related-work", "search", "legal", "entry-header"):
        assert X.main_text(f'<body><article>{parts}<div id="{name}" class="x {name}"><h2 id="{name}">More</h2>{parts}</div></article></body>', w) == f"{want}\nMore\n{want}"


A, B = "A paragraph of the text with words enough.", "Another one follows it, of about that length."


@pytest.mark.parametrize(
    "box",
    [
        '<div class="ad"><p>Buy it now, at half the price of last year.</p></div>',
        '<div class="sponsored-content"><h3>From our partners</h3><p>These ten tricks will change how you cook for ever.</p></div>',
        '<section class="comments"><h2>Comments</h2><p>I was there as a child, and it was all different then.</p><p>Nice piece.</p></section>',
        '<div id="user-comments"><ul><li>First!</li><li>I was there as a child, and it was all different then.</li></ul></div>',
        '<div class="cookie-notice-wrap"><p>We use cookies to make this page better for you.</p></div>',
        '<div class="related"><h3>More on this</h3><ul><li><a href="/1">The mill burns</a></li><li><a href="/2">The mill is built again</a></li></ul></div>',
        '<div class="col-right"><p>Most read this week: what the weather will be.</p></div>',
        '<div class="newsletter-signup-box"><p>Our letter comes once a week, and is free.</p></div>',
        '<aside><p>Most read this week: what the weather will be.</p></aside>',
    ],
)
def test_boxes_inside_the_text_go(box):
    w = X.learn(X.LABELLED)
    for frame in ("<article><h1>Head</h1>{}</article>", '<div class="post-text"><h1>Head</h1>{}</div>', "<div><h1>Head</h1>{}</div>"):
        body = f"<p>{A}</p>{box}<p>{B}</p>{box}<p>{A}</p>{box}"
        assert X.main_text(f"<html><body><nav><a href='/'>Home</a></nav>{frame.format(body)}<footer>Imprint</footer></body></html>", w) == f"Head\n{A}\n{B}\n{A}", frame
    # many more words in the box than in the text
    assert X.main_text(f"<article><h1>Head</h1><p>{A}</p>{box * 40}</article>", w) == f"Head\n{A}"


def test_formulas_and_fallbacks_of_an_article_are_text():
    w = X.learn(X.LABELLED)
    page = "<article><p>The sum is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> as said.</p><object data='a'>A picture of it.</object><noscript><p>Its caption.</p></noscript><p>The end.</p></article>"
    assert X.main_text(page, w) == "The sum is x+1 as said.\nA picture of it.\nIts caption.\nThe end."


def test_quotes_delimit_only_where_a_value_begins():
    w = X.learn(X.LABELLED)
    page = "<p>First one of some words <a href=x title=it's>link</a> and more words</p><p>Second paragraph of the text</p><p data-x='a>b' class=\"c>d\">Third one's here</p>"
    assert X.main_text(page, w) == "First one of some words link and more words\nSecond paragraph of the text\nThird one's here"


def test_pages_that_nest_deep_take_seconds():
    w = X.learn(X.LABELLED)
    began = time.monotonic()
    for page in ("<div>" * 100_000 + "<p>word one two" + "</div>" * 100_000, "<div><li>" * 50_000 + "<p>word one two", "<div aria-hidden=true>" * 30_000 + "<p>word one two", "<p>word one two" + "<a =\"" * 100_000):
        X.main_text(page, w)
    assert X.main_text("<div>" * 100_000 + "<p>word one two", w) == "word one two"
    assert time.monotonic() - began < 60


def test_a_form_around_the_article_is_a_wrapper():
    w = X.learn(X.LABELLED)
    text = "<h1>Head line</h1><p>A paragraph of the text with words enough.</p>"
    assert X.main_text(f"<body><form id='aspnetForm'><nav>Home</nav>{text}</form></body>", w) == "Head line\nA paragraph of the text with words enough."
    assert X.main_text(f"<body>{text}<form><label>Your mail for our letter</label><p>We write once a week.</p></form></body>", w) == "Head line\nA paragraph of the text with words enough."


def test_names_that_no_labelled_page_has_are_told_by_their_parts():
    w = X.learn(X.LABELLED)
    seen = {x for page, _ in X.LABELLED for x in re.findall(r'class="([^"]*)"', page)}
    boxes = ["user-comments", "cookie-notice-wrap", "col-right", "reader-comments", "ads-wrapper", "newsletter-form", "gdpr-banner", "social-bar", "related-stories-block", "comment-section-inner", "promo-widget", "site-menu", "popular-articles", "cookie-popup", "sidebar-item"]
    texts = ["post-text", "article-main", "story-content", "entry-summary", "content-column", "chapter-text", "sidebar-free", "main-text", "container-fluid", "col-md", "foo", "chapter-header"]
    assert not {*boxes, *texts} & seen
    assert all(w.rare([x]) for x in boxes) and not any(w.rare([x]) for x in texts)
    assert all(w.rare([x]) for x in ("ad", "sidebar", "comments", "cookie-banner")) and not any(w.rare([x]) for x in ("content", "post", "page", "no-sidebar", "has-ads"))
    # several names of one element count together
    assert not w.rare(["post-body", "has-comments"]) and w.rare(["box", "widget"])
    assert X.names_of({"class": "siteHeader  widget_2", "id": "Ad-Box-12"}) == ["site-header", "widget", "ad-box"]


def test_a_named_box_around_the_whole_text_is_a_wrapper():
    w = X.learn(X.LABELLED)
    for name in ("sidebar-layout right", "widget", "related"):
        assert X.main_text(f'<body><header>Site</header><div class="{name}"><div><h1>Head</h1><p>{A}</p><p>{B}</p></div></div></body>', w) == f"Head\n{A}\n{B}"
        assert X.main_text(f'<body><div class="{name}"><p>{A}</p><p>{B}</p></div></body>', w) == f"{A}\n{B}"
    # a short text beside long comments isn't
    assert X.main_text(f'<body><h1>Head</h1><p>{A}</p><div class="comments">{"<p>" + B * 30 + "</p>"}</div></body>', w) == f"Head\n{A}"


def test_lists_of_many_open_elements_take_time_in_proportion():
    w = X.learn(X.LABELLED)
    began = time.monotonic()
    n = 60_000
    text = X.main_text("<li><ul>" + "<span>" * n + "<li>a</li>" * n, w)
    assert text.count("a") == n and time.monotonic() - began < 30
    assert X.main_text("<table><tr><td>one two<td>three<tr><td>four</table><dl><dt>five<dd>six<dt>seven</dl>", w) == "one two\nthree\nfour\nfive\nsix\nseven"


def test_pages_put_together_give_back_their_paragraphs(spark):
    """Random pages whose text is known, through the query: paragraphs, lists and quotes, with boxes between them."""
    r = random.Random(21)
    say = lambda n: " ".join(r.choice(["word", "Wörter", "a &amp; b", "&lt;x&gt;", "of", "the", "&eacute;t&eacute;"]) for _ in range(n))
    import html as H

    names, rows, want = ["ads-wrapper", "user-comments", "cookie-popup", "promo-widget", "social-bar", "newsletter-form"], [], {}
    for i in range(60):
        blocks, parts = [], []
        for _ in range(r.randrange(2, 7)):
            t = say(r.randrange(8, 30))
            blocks.append(r.choice(["<p>{}</p>", "<p> {}\n", "<blockquote>{}</blockquote>", "<ul><li>{}</ul>", "<div>{}</div>", "<section><p>{}</p></section>"]).format(t))
            parts.append(H.unescape(t))
            if r.random() < 0.5:
                blocks.append(r.choice([f'<div class="{r.choice(names)}"><p>{say(12)}</p></div>', f"<aside>{say(9)}</aside>", f"<form><label>{say(4)}</label><input></form>", f"<script>var p = '<p>{say(3)}</p>'</script>", f"<!-- <p>{say(3)}</p> -->"]))
        frame = r.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-text">{}</div>'])
        rows.append((i, "u", f"<html><head><title>{say(3)}</title></head><body><header>{say(3)}</header><nav><ul><li><a href='/'>{say(1)}</a></ul></nav>{frame.format('<h1>Title of it</h1>' + ''.join(blocks))}<footer>{say(6)}</footer></body></html>"))
        want[i] = "\n".join(["Title of it", *(" ".join(p.split()) for p in parts)])
    out = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {x["page_id"]: x["text"] for x in out} == want and all(x["n_chars"] == len(x["text"]) for x in out)
