"""Licenses, benchmark passages and page text against brute force."""

import html as H
import random
import re

import numpy as np
import pytest
from helpers_llm import by_id, documents, words

from tallyfold.llm import html_text
from tallyfold.llm.decontaminate import best_stretch, decontaminated, overlap, overlaps
from tallyfold.llm.html_text import extract, main_text
from tallyfold.llm.licenses import COVERAGE, SECTION_WORDS, TEMPLATES, Index, align, full_texts, license_matches, sections, winnow

ITEM_DDL = "item_id int, text string, doc_id string, pos int"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ITEM_DDL)


def swapped(w, share, seed):
    rng = random.Random(seed)
    return [f"y{rng.randrange(10**6)}" if rng.random() < share else x for x in w]


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    bench = [(i, " ".join(words(20 + i, 500 + i))) for i in range(30)] + [(98, "two words"), (99, "a rare line of five"), (100, None), (100, ""), (None, "x y z")]
    rows, want = [], set()
    for d in range(120):
        body = words(80, d, "ijklmnop")
        if d % 4 == 0:
            i = d // 4
            body[30:30] = " ".join(swapped(bench[i][1].split(), 0.0 if d % 8 else 0.1, d)).upper().split()
            want.add((d, i))
        rows.append((d, ", ".join(body)))
    rows += [(200, "before A RARE, line of five after"), (201, "a rare line of six"), (202, None), (203, ""), (None, "- " + bench[0][1]), (None, "- " + bench[0][1])]
    want |= {(200, 99), (None, 0)}
    docs = documents(spark, rows, extra=["item_id", "hits", "pos", "words"])
    got = [(r.doc_id, r.item_id) for r in overlaps(docs, items(spark, bench)).collect()]
    assert sorted(got, key=repr) == sorted(((d, str(i)) for d, i in want), key=repr)
    kept = decontaminated(docs, items(spark, bench))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in rows if r[0] not in {d for d, _ in want}), key=repr)


def test_best_stretch_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        doc, item = rng.integers(0, 3, rng.integers(0, 12)), rng.integers(0, 3, rng.integers(1, 9))
        d = int(rng.integers(-8, 12))
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        score = {(i, j): sum(1 if item[k] == doc[k + d] else -2 for k in range(i, j)) for i in range(lo, hi) for j in range(i + 1, hi + 1)}
        got = best_stretch(doc, item, d)
        if not score or max(score.values()) <= 0:
            assert got is None
        else:
            assert score[got[:2]] == max(score.values())


def test_any_stretch_of_a_diagonal_by_brute_force():
    """Long items: one long and equal enough stretch suffices, whatever surrounds it."""
    rng = np.random.default_rng(7)
    seen = {True: 0, False: 0}
    for _ in range(150):
        n = int(rng.integers(1, 130))
        share = np.repeat(rng.choice([0.4, 0.6, 0.7, 0.75, 0.95, 1.0], 12), 11)[:n]
        same = rng.random(n) < share
        item = np.arange(n)
        d = int(rng.integers(0, 4))
        doc = np.concatenate([np.full(d, -1), np.where(same, item, -1), np.full(3, -1)])
        total, need = np.concatenate([[0], np.cumsum(same)]), min(12, n)
        want = any(5 * (total[j] - total[i]) >= 4 * (j - i) for i in range(n) for j in range(i + need, n + 1))
        got = overlap(doc, item, d)
        assert (got is not None) == want
        seen[want] += 1
        if got:
            i, j, k = got
            assert j - i >= need and k == total[j] - total[i] and 5 * k >= 4 * (j - i)
    assert min(seen.values()) > 20


def test_more_overlap_does_not_hide_a_passage(spark):
    w = words(140, 77)
    mixed = w[:40] + [x if k % 10 < 7 else f"y{k}" for k, x in enumerate(w[40:])]
    ends = w[:12] + [x if k % 3 else f"z{k}" for k, x in enumerate(w[12:60])] + w[60:72]
    docs = documents(spark, [(1, " ".join(mixed)), (2, " ".join(ends)), (3, " ".join(x if k % 3 else f"q{k}" for k, x in enumerate(w)))])
    bench = items(spark, [(1, " ".join(w)), (2, " ".join(w[:72]))])
    assert {(r.doc_id, r.item_id) for r in overlaps(docs, bench).collect()} == {(d, i) for d in (1, 2) for i in "12"}
    assert [r.doc_id for r in decontaminated(docs, bench).collect()] == [3]


def test_no_tables(spark):
    docs, bench = documents(spark, [(1, "a b c")]), items(spark, [])
    assert overlaps(docs, bench).count() == 0 and decontaminated(docs, bench).count() == 1
    assert overlaps(documents(spark, []), items(spark, [(1, " ".join(words(20)))])).count() == 0


def test_licenses(spark):
    rows, want = [], {}
    rng = random.Random(2)
    for d, (name, texts) in enumerate([(n, [t]) for n, ts in TEMPLATES.items() for t in ts] * 2):
        t = texts[0].split()
        if len(t) > 30:
            t[10] = "changed"
            del t[20]
        rows.append((d, " ".join(words(rng.randint(0, 40), d) + t + words(20, d + 900))))
        want[d] = [name]
    rows += [(900, None), (901, ""), (902, "license"), (903, "Released under the MIT License. " * 3), (None, "Licensed under CC BY 4.0.")]
    want |= {903: ["MIT"] * 3, None: ["CC-BY-4.0"]}
    got = {}
    for r in license_matches(documents(spark, rows, extra=["license", "matched"])).orderBy("doc_id", "span_start").collect():
        got.setdefault(r.doc_id, []).append(r.license)
        assert r.coverage >= 0.8
    assert got == want
    assert license_matches(documents(spark, [])).count() == 0


def test_near_miss_licenses(spark):
    work = "This work is licensed under the"
    bsd = TEMPLATES["BSD-2-Clause"][0]
    cases = [
        (f"{work} GNU General Public License, version 2.", "GPL-2.0"),
        (f"{work} GNU General Public License v3.", "GPL-3.0"),
        (f"{work} GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        (f"{work} GNU Affero General Public License, version 3.", "AGPL-3.0"),
        (f"{work} GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("Licensed under the Apache License, Version 1.0.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under the Apache License 2.0.", "Apache-2.0"),
        ("Licensed under the Academic License, Version 2.0.", None),
        ("Released under the BSD License.", None),
        ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
        ("Licensed under CC BY-SA 2.0.", None),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        (f"{bsd} 3. Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products derived from this "
         "software without specific prior written permission.", "BSD-3-Clause"),
        (f"{bsd} THIS SOFTWARE IS PROVIDED AS IS", "BSD-2-Clause"),
    ]
    docs = documents(spark, [(d, f"We say: {t} And more words follow here.") for d, (t, _) in enumerate(cases)])
    got = {}
    for r in license_matches(docs).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert got == {d: [name] for d, (_, name) in enumerate(cases) if name}


def test_winnowing_keeps_a_fingerprint_of_every_window():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50):
        h = rng.integers(0, 10, n).astype(np.uint64)
        at = set(winnow(h).tolist())
        assert all(at & {i, i + 1} for i in range(n - 1)) and at
    assert len(Index(TEMPLATES).keys) > 100


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body><header>Site name</header>"
    "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- c -->%s<aside>Other news here</aside>"
    "<section id=comments><article class=comment><p>First! A reader comment that is quite long and chatty indeed.</p></article></section>"
    "<form><label>Mail</label><input><button>Go</button></form><footer>&copy; x</footer></body></html>"
)


def test_main_text_of_pages(spark):
    article = "<%s><h1>A  title</h1><p><b>One &amp;\n two<br><p>Short.</p><p>Th<i>re</i>e &#233;&nbsp;four</p><div class=ad>Buy now</div><ul><li>five<li>six</ul></%s>"
    want = "A title One & two Short. Three é four five six"
    for tag in ("article", "main"):
        assert main_text(PAGE % (article % (tag, tag))) == want
    assert main_text("<div class=ad>unclosed <article><p>Body text</p></article>") == "Body text"
    assert main_text("<div class='page with-sidebar'><article class='post related'><p>Body</p><div class=post-comments>No</div></article></div>") == "Body"
    for broken in ("<", "<p", "a < b", "<!-- x", "&#x;", "</p></div>", "<a href='", "<script>x"):
        main_text(broken)
    rows = [(1, "u", PAGE % (article % ("article", "article")), "s"), (2, None, None, "s"), (None, "u", "", "s"), (4, "u", "<p>" + "long " * 100_000, "s"), (4, "u", "<p>x", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.n_chars) for r in extract(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, len(want)), (2, 0), (None, 0), (4, 499_999), (4, 1)], key=repr)
    assert extract(df.limit(0)).count() == 0


def test_all_containers_with_content_are_kept():
    a, b, c = (" ".join(words(60, k)) for k in (31, 32, 33))
    assert main_text(f"<main><h1>Head</h1><p>{a}</p><article><p>{b}</p><article><p>{c}</p></article></article><p>End</p></main>") == f"Head {a} {b} {c} End"
    assert main_text(f"<body><article><p>{a}</p></article><div>x</div><article><p>{b}</p><p>Short</p></article></body>") == f"{a} {b} Short"
    # The ratios decide beside a container: a teaser is no page, an article in a sidebar not the text.
    assert main_text(f"<body><div><p>{a}</p><p>{b}</p></div><article>Teaser</article></body>") == f"{a} {b}"
    assert main_text(f"<body><article><p>{a}</p></article><aside><article><p>{b}</p></article></aside></body>") == a


def test_class_words_inside_an_article_lose_no_text():
    a, b, c, d = (" ".join(words(60, k)) for k in (41, 42, 43, 44))
    page = f"<article><h2 class='section-header'>Prices</h2><p>{a}</p><p class='share-price'>Up 3 %.</p><section id='social-policy'><p>{b}</p></section><div class='related-work'>{c}</div><div class='header'>Part</div></article>"
    for body in (f"<body><div class=sidebar>{d[:90]}</div>%s<div class='share-buttons'>Send it</div></body>", "<body><form action='x.aspx'>%s</form></body>", "<div class='layout sidebar-right'>%s</div>"):
        assert main_text(body % page) == f"Prices {a} Up 3 %. {b} {c} Part"


def test_div_only_pages_keep_headline_and_short_ends():
    a, b = (" ".join(words(80, k)) for k in (51, 52))
    links = "".join(f"<div><a href=/{k}>l{k}</a> <a href=/>m</a></div>" for k in range(12))
    text = f"<h1>Head line</h1><p>By me</p><p>{a}</p><p>Oh.</p><p>{b}</p><p>The end.</p>"
    want = f"Head line By me {a} Oh. {b} The end."
    for start, end in (("<div>", "</div>"), ("<div class='layout sidebar-right'>", "</div>"), ("<form id=aspnetForm><div>", "</div></form>")):
        assert main_text(f"<body><div>{links}</div>{start}{text}{end}<div class='sidebar'>Other news</div><div>{links}</div></body>") == want
    assert main_text(f"<body><div>{text.replace('<p>', '<div>').replace('</p>', '</div>')}</div><div class=comments>{a[:200]}</div></body>") == want


def test_pages_without_article_drop_link_lists():
    body = "".join(f"<p>{' '.join(words(40, k))}.</p>" for k in range(6))
    links = "".join(f"<div><a href=/{k}>l{k}</a> <a href=/>m</a></div>" for k in range(12))
    got = main_text(f"<body><div>{links}</div>{body}<div>{links}</div></body>")
    assert all(" ".join(words(40, k)) in got for k in range(6)) and "l0" not in got


def test_registered_pages_against_plain_reading(spark):
    """The article element of well-formed test pages, read by a plain pattern."""
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = by_id(html_text.op8_html_text(spark, "/root/testdata/sf0.001"), "page_id")
    for r in df.collect():
        a = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r.html, re.S)[1]
        want = " ".join(H.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", a))).split())
        assert got[r.page_id]["text"] == want


@pytest.mark.parametrize(
    "piece",
    ["<a <", '<a b="', "<a b='", "<!--", "<![CDATA[", "<?", "</", "</a ", "<x y=", "<a/", "<div class='sidebar'>x", "<div class='comments'>x", "<font>x<br>", "<a><div></a>", "<p>x", "<li>x", "<b", "<article>x"],
)
@pytest.mark.parametrize("end", ["", ">", "--> x"])
def test_broken_markup_takes_linear_time(piece, end):
    import time

    started = time.process_time()
    main_text(piece * 40_000 + end)
    assert time.process_time() - started < 4


def test_unfinished_markup_ends_the_page():
    page = "<body><article><p>One two three four five six.</p><p>Seven eight nine ten.</p></article>"
    whole = "One two three four five six. Seven eight nine ten."
    for rest in ("<p", "<!-- no end <p>x</p>", "</p", "<a href='x", "<?php x", "<![CDATA[ x", "<![CDATA[ x ]]>"):
        assert main_text(page + rest) == whole
    assert main_text("<body><article><p>a < b and c &lt; d</p><!-- x --><p>e <!-- y --> f</p></article>") == "a < b and c < d e f"


def test_comment_threads_and_rights():
    body = "<p>" + "The article goes on for some time here. " * 5 + "</p>"
    thread = "<section class='discussion'><article><p>I do not agree with this at all, said the reader, and wrote more.</p></article></section>"
    assert "agree" not in main_text(f"<body><article>{body}</article>{thread}</body>")
    plain = main_text(f"<body><div><h1>Title</h1>{body}{body}</div><div>Copyright 2024 X</div></body>")
    assert plain.startswith("Title") and "Copyright" not in plain


def test_identifier_lines_name_their_license(spark):
    names = list(TEMPLATES)
    rows = [(k, f"// SPDX-License-Identifier: {name}\nint main() {{}}") for k, name in enumerate(names)] + [(900, "SPDX-License-Identifier: Zlib"), (901, "SPDX License list")]
    got = {r.doc_id: r.license for r in license_matches(documents(spark, rows)).collect()}
    assert got == dict(enumerate(names))


def test_spans_of_texts_whose_lower_case_is_longer(spark):
    notice = TEMPLATES["MIT"][0]
    text = "\u0130\u0130 stanbul " * 3 + notice + " \u0130."
    r = license_matches(documents(spark, [(1, text)])).collect()[0]
    assert text[r.span_start : r.span_end] == notice.rstrip(".")


def test_a_long_middle_text_does_not_change_the_license(spark):
    two, three = TEMPLATES["BSD-2-Clause"][0], TEMPLATES["BSD-3-Clause"][0]
    rest = three[len(two) :]
    middle = " " + " ".join(words(300, 6)) + " "
    rows = [(1, two + middle + rest), (2, two + middle), (3, two + middle + three)]
    got = {}
    for r in license_matches(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert got.get(1) in (None, ["BSD-3-Clause"]) and got[2] == ["BSD-2-Clause"] and got[3] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_alignment_against_a_full_table():
    """Where the best alignment stays inside the band, the banded one finds it: against the whole table."""
    from tallyfold.llm.licenses import GAP, MATCH, MISMATCH, align

    rng = random.Random(2)
    for _ in range(150):
        template = [rng.choice("abcdefg") for _ in range(rng.randint(4, 25))]
        text = list(template)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
        before = [rng.choice("xyz") for _ in range(rng.randint(0, 6))]
        whole = before + text
        best, row = 0, [0] * (len(whole) + 1)
        for word in template:
            new = [0]
            for j, other in enumerate(whole, 1):
                new.append(max(0, row[j - 1] + (MATCH if word == other else MISMATCH), row[j] + GAP, new[j - 1] + GAP))
            row, best = new, max(best, *new)
        got = align(whole, template, len(before))
        assert (got[0] if got else 0) == best


def test_repetitive_texts_carry_their_words_once(spark):
    """One word thousands of times, against an item of it: every diagonal is one row's, and the item is found."""
    import time

    started = time.time()
    docs = documents(spark, [(1, "la " * 20_000), (2, "la " * 11 + "x"), (3, "lo " * 50)])
    bench = spark.createDataFrame([("b", "la " * 40), ("s", "lo lo lo")], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in overlaps(docs, bench).collect()}
    assert got == {(1, "b"): 40, (2, "b"): 11, (3, "s"): 3} and time.time() - started < 60


def test_sections_of_full_texts():
    texts = full_texts()
    numbers = {name: [s for s, _ in sections(t)][1:] for name, t in texts.items()}
    last = {"Apache-2.0": (1, 9), "GPL-2.0": (0, 12), "GPL-3.0": (0, 17), "LGPL-2.1": (0, 16), "LGPL-3.0": (0, 6), "MPL-2.0": (1, 10)}
    assert numbers == {name: [str(k) for k in range(a, b + 1)] for name, (a, b) in last.items()}


def test_full_licenses_are_covered_section_by_section(spark):
    texts = full_texts()
    rows = [(k, " ".join(words(60, k)) + "\n" + t + "\n" + " ".join(words(60, k + 50))) for k, t in enumerate(texts.values())]
    agpl = TEMPLATES["AGPL-3.0"][2] + " ".join(part for _, part in sections(texts["GPL-3.0"])[1:])
    rows += [(100, agpl), (101, dict(sections(texts["GPL-3.0"]))["0"]), (102, dict(sections(texts["Apache-2.0"]))["2"].upper())]
    got = {}
    for r in license_matches(documents(spark, rows)).orderBy("doc_id", "span_start").collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (name, text) in enumerate(texts.items()):
        parts = [r for r in got[k] if r.section]
        wanted = [s for s, part in sections(text) if len(re.findall("[A-Za-z0-9]+", part)) >= SECTION_WORDS]
        assert {r.license for r in got[k]} == {name} and [r.section for r in parts] == wanted and min(r.coverage for r in parts) > 0.99
    assert {r.license for r in got[100]} == {"AGPL-3.0"} and len(got[100]) > 15
    assert [(r.license, r.section) for r in got[101]] == [("GPL-3.0", "0")]
    assert [(r.license, r.section) for r in got[102]] == [("Apache-2.0", "2")]


def test_sections_against_alignment_everywhere(spark):
    """Changed sections inside of other words: found as aligning every template at every place finds them."""
    rng, rows, text_of = random.Random(8), [], {}
    full = {name: full_texts()[name] for name in ("Apache-2.0",)}
    index = Index({}, None, full)
    for d in range(24):
        name, part = rng.choice([x for x in sections(full["Apache-2.0"]) if x[0] in "235678"])
        w = part.split()
        for _ in range(int(len(w) * rng.choice([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.4]))):
            w[rng.randrange(len(w))] = f"other{rng.randint(0, 9)}"
        text_of[d] = " ".join(words(rng.randint(0, 30), d) + w + words(10, d + 50))
        rows.append((d, text_of[d]))
    got = {(r.doc_id, r.section, r.matched) for r in license_matches(documents(spark, rows), full=full).collect()}
    want = set()
    for d, text in text_of.items():
        found = re.findall("[a-z0-9]+", text.lower())
        for t, template in enumerate(index.words):
            best = max((a for a in (align(found, template, at) for at in range(0, 34, 3)) if a), default=None)
            if best and best[1] >= COVERAGE * len(template):
                want.add((d, index.sections[t], best[1]))
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(want) > 8
    assert sum(x in want for x in got) >= len(got) - 1


def test_candidates_do_not_depend_on_the_pieces():
    index = Index(TEMPLATES, {}, full_texts())
    from tallyfold.llm.decontaminate import _WORD, seeds
    from tallyfold.llm.shingles import hashes_of

    grams = seeds(hashes_of(_WORD.findall((full_texts()["GPL-3.0"] * 2).lower())), "111")
    at = index.hits(grams)
    whole = list(index.candidates(at, grams))
    assert len(whole) > 5000 and whole == list(index.candidates(at, grams, piece=701))


def test_very_long_repeated_licenses_take_linear_time():
    import time

    from tallyfold.llm.decontaminate import _WORD, seeds
    from tallyfold.llm.licenses import scan_text
    from tallyfold.llm.shingles import hashes_of

    index, text = Index(TEMPLATES, {}, full_texts()), full_texts()["GPL-2.0"] * 10
    grams, started = seeds(hashes_of(_WORD.findall(text.lower())), "111"), time.time()
    found = scan_text(text, index, index.hits(grams), grams)
    assert sum(x[5] == "12" for x in found) == 10 and time.time() - started < 30
