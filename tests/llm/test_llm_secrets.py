import hashlib
import random
import re

from helpers_llm import by_id, documents

from tallyfold.llm.secrets import ownership, redact, secret_spans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def pieces(seed):
    rng = random.Random(seed)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 40])))
    return rng.choice(
        [
            f"password = '{hexes}'", f"API_KEY:{hexes[:9]}", "token=token: abcdefghij", "token=abc", f"AKIA{hexes.upper()[:14]}", "AKIAAKIA12345678",
            hexes, "Secret\"  =  \"a.b=c/d+e-f", "é😀 ", "passwd=\n12345678", "apikey=12345678", "ſecret=12345678", "plain words here ",
        ]
    )


def test_base_spans_match_brute_force(spark):
    rows = [(i, "".join(pieces(i * 31 + k) + random.Random(i + k).choice(["", " ", "\n", "é"]) for k in range(i % 9)), f"o{i % 4}") for i in range(200)]
    rows += [(900, None), (901, ""), (None, "password=abcdefgh1")]
    got = secret_spans(documents(spark, rows, extra=["start", "text_hash", "owner"])).collect()
    assert len(got) == len(rows)
    want = {i: base(t) for i, t, *_ in rows}
    for r in got:
        assert sorted((s.start, s.kind, s.stop) for s in r.base) == want[r.doc_id]
        assert {(s.start, s.kind, s.stop) for s in r.spans} >= set(want[r.doc_id])


def test_ownership_separates_examples_from_live(spark):
    live, example = "aB3dE5fG7hJ9kL1mN3pQ5r", "zY9xW8vU7tS6rQ5pO4nM3l"
    rows = [(i, f"key {example} end", f"o{i % 5}") for i in range(10)] + [(20, f"x {live} y", "o1"), (21, f"again {live}", "o1"), (21, f"again {live}", "o1")]
    docs = documents(spark, rows)
    got = secret_spans(docs).collect()
    assert all(not r.spans for r in got if r.doc_id < 10)
    assert all([(s.kind, s.verdict) for s in r.spans] == [(3, "live")] for r in got if r.doc_id >= 20)
    assert len(got) == len(rows)
    clean = redact(docs).collect()
    assert len(clean) == len(rows)
    assert {r.text for r in clean if r.doc_id >= 20} == {"x <secret> y", "again <secret>"}
    assert {r.text for r in clean if r.doc_id < 10} == {f"key {example} end"}


def test_clean_documents_with_links_paths_and_ids_stay(spark):
    clean = [
        "see https://example.org/blog/2024/05/how-to-bake-bread and http://localhost:8080/api/v2/user-list-page-10 now",
        "in /usr/local/lib/python3/site-packages or C/Users2/MyDocuments/Report_2024_final",
        "id 3f2b8c1a-77de-4b0a-9c1d-0e5f6a7b8c9d of item/3F2B8C1A-77DE-4B0A-9C1D-0E5F6A7B8C9D/edit",
        "the slug top-10-places-to-visit-in-2024, https://docs.example.com/d/1BxiMVs0XRA5nFMdKvBdBZjgmUUqptlbs74OgVE2upms/edit",
        "é😀 https://intranet/wiki/1BxiMVs0XRA5nFMdKvBdBZjg",
    ]
    live = [
        "key wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzAMPLEKEY end",
        "xoxb-123456789012-1234567890123-AbC1dEf2GhI3jKl4MnO5pQ6r",
        "https://user:aB3dE5fG7hJ9kL1mN3pQ5r@host/x",
        "https://api.example.org/v1/list?key=aB3dE5fG7hJ9kL1mN3pQ5s",
        "ghp_16C7e42F292c6912E7710c838347Ae178B4a",
    ]
    docs = documents(spark, [(i, t, "only") for i, t in enumerate(clean + live)])
    got = {r.doc_id: r.text for r in redact(docs).collect()}
    assert [got[i] for i in range(len(clean))] == clean
    assert all("<secret>" in got[len(clean) + k] for k in range(len(live)))


def test_counts_by_owner_and_repository(spark):
    rows = [("h", "a", "1"), ("h", "a", "1"), ("h", "a", "2"), ("h", "b", "1"), ("h", None, None), ("g", "a", "1")]
    got = {r.hash: (r.n_owners, r.n_repos) for r in ownership(spark.createDataFrame(rows, "hash string, owner string, repo string")).collect()}
    assert got == {"h": (3, 4), "g": (1, 1)}


def test_many_candidates_in_one_text(spark):
    """Ten thousand runs of every kind in one text: places, overlaps and redaction against a plain walk, in seconds."""
    import time

    rng, parts = random.Random(8), []
    for k in range(10_000):
        run = "".join(rng.choice("0123456789abcdefABCDEFGHIJKXYZ") for _ in range(34))
        parts.append([run, "password=" + run, "é😀 " + run.lower(), "AKIA" + run[:14].upper(), "plain-words-here", f"https://x.org/{run}", "0123456789abcdef" * 2][k % 7])
    text = " ".join(parts)
    started = time.time()
    docs = documents(spark, [(1, text, "o"), (2, "clean", "o"), (1, text, "o")])
    got = secret_spans(docs).collect()
    clean = redact(docs).collect()
    assert time.time() - started < 60
    first = next(r for r in got if r.doc_id == 1)
    assert sorted((s.start, s.kind, s.stop) for s in first.base) == base(text) and len(first.spans) > 5000
    out, at = [], 0
    for s in first.spans:
        if s.verdict == "live":
            if s.start >= at:
                out += [text[at : s.start], "<secret>"]
            at = max(at, s.stop)
    want = "".join(out) + text[at:]
    assert [r.text for r in clean if r.doc_id == 1] == [want, want] and [r.text for r in clean if r.doc_id == 2] == ["clean"]


def test_a_url_is_followed_however_long_it_is(spark):
    run = "aB3dE5fG7hJ9kL1mN3pQ5r"
    long = "https://x.org/" + "path/" * 2000
    rows = [(1, long + run, "a"), (2, long + " " + run[::-1], "a"), (3, long + "?k=" + run[1:] + "Z", "a")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_spans(documents(spark, rows)).collect()}
    assert got == {1: [], 2: [3], 3: [3]}


def test_very_many_repositories_make_an_example(spark):
    run, few = "aB3dE5fG7hJ9kL1mN3pQ5r", "zY9xW8vU7tS6rQ5pO4nM3l"
    docs = documents(spark, [(i, f"k {run} {few if i < 5 else ''}", "only") for i in range(120)])
    got = {r.doc_id: r for r in secret_spans(docs).collect()}
    assert [len(got[i].spans) for i in (0, 4, 5, 119)] == [1, 1, 0, 0]


def test_empty_table_and_long_text(spark):
    assert secret_spans(documents(spark, [])).count() == 0
    text = "word " * 300_000 + "password=" + hashlib.md5(b"x").hexdigest()
    r = by_id(secret_spans(documents(spark, [(1, text)])))[1]
    assert [(s.kind, s.start, s.stop) for s in sorted(r["base"])] == [(0, 1_500_000, 1_500_041), (2, 1_500_009, 1_500_041)]
