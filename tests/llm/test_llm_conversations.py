"""Conversation repair against a plain dynamic program over whole edit strings."""

import hashlib
import random
import re
import zlib

import pytest

from tallyfold.llm import conversations as C

DDL = "conv_id long, turn long, role string, text string, cost int, ord string"
WHITE = " \t\n\x0b\x0c\r"
FOLLOWS, NAMES = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def best_edits(rows, faults):
    """(cost, audit, lines) by a table of the best edits for every state, whole strings held."""

    def with_inserts(v):
        for _ in range(3):
            for s in list(v):
                n = FOLLOWS[s]
                way = (v[s][0] + 5, v[s][1] + "I", [*v[s][2], NAMES[n] + ":"])
                if n not in v or way[:2] < v[n][:2]:
                    v[n] = way
        return v

    v = with_inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        w = {}
        for s, (cost, audit, lines) in v.items():
            ways = [(s, (cost + 2, audit + "D", lines))]
            if fault not in ("b", "d"):
                more, n, ini = 5 if fault == "t" else 0, FOLLOWS[s], role[:1]
                ways.append((n, (cost + 1 + more, audit + "R", [*lines, f"{NAMES[n]}:{text}"])))
                if ini == n or (ini == "s" and s == ""):
                    ways.append((ini, (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
            for t, way in ways:
                if t not in w or way[:2] < w[t][:2]:
                    w[t] = way
        v = with_inserts(w)
    return min((v[s] for s in ("", "a") if s in v), key=lambda z: z[:2])


def brute(rows, damage=True):
    convs = {}
    for c, t, role, text in rows:
        kept = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, rs in convs.items():
        parts = lambda r: (" " if c is None else str(c), " " if r[0] is None else str(r[0]), r[1], r[2])  # noqa: E731, B023
        digest = lambda r: hashlib.sha256("".join(f"{len(p)}={p}" for p in parts(r)).encode()).digest()[:16]  # noqa: E731, B023
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, faults = set(), []
        for _, role, text in rs:
            said = text.rstrip(WHITE)
            faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns, ini = [t for t, _, _ in rs if t is not None], [r[:1] for _, r, _ in rs]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
        cost, audit, lines = best_edits(rs, faults)
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    words = ["Yes.", "no", "Why?", "", "  \t", "Go!  ", "caf\u00e9", "\u00a0", "a: b.", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "s"]
    rows = []
    for c in [*range(convs), None]:
        for _ in range(rng.randint(1, longest)):
            one = (c, rng.choice([None, *range(longest)]), rng.choice(roles), rng.choice(words))
            rows += [one] * rng.choice([1, 1, 1, 1, 3])
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DDL)


def test_query_matches_brute_force(spark, tmp_path):
    rows = random_rows(1, 60, 9) + [(900, t, "user", "Hi.") for t in range(3)] + [(c, 0, "user", None) for c in range(1000, 1060)]
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in C.op12_conversations(spark, str(tmp_path)).collect()}
    assert got == brute(rows)
    # Some conversations lose all their rows.
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()


@pytest.mark.parametrize("size", [1, 2, 5])
def test_chunks_of_one_conversation_meet(spark, size):
    """Long conversations, hot rows and small chunks: the states between chunks are those of the whole."""
    rows = [r for r in random_rows(2, 4, 40) if r[0] is not None] + [(2, 5, "user", "Yes.")] * 40
    plain = table(spark, rows).selectExpr("conv_id conv", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "1L n")
    counts, edits, lines = C.repaired(plain, chunk=size)
    want, found = brute(rows, damage=False), C.digests(edits, lines).collect()
    assert {r.conv: (r.audit, r.repaired_sha256) for r in found} == {c: w[6:] for c, w in want.items()}
    assert {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) for r in counts.collect()} == {c: w[:6] for c, w in want.items()}
    assert edits.count() > len(want)


def test_halves_meet_in_the_audit_least_way():
    rng = random.Random(3)
    letters = {0: "s", 1: "u", 2: "a", 3: "x"}
    for _ in range(400):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 10, 13, 14]) for _ in range(rng.randint(1, 12)))
        rows = [(0, letters[c % 4], f"t{i}") for i, c in enumerate(codes)]
        cost, audit, _ = best_edits(rows, [" bdt"[c // 4].strip() for c in codes])
        costs, order, base = C.forward(codes, C.START)
        least, _, end = min((costs[t] + C.FINISH[t], order[t], t) for t in C.STATES)
        got = C.edits_between(codes, C.START, C._only(end)[0]) + "I" * (C.FINISH[end] // C.INSERT)
        assert (least + base, got) == (cost, audit)
        assert C.edits_between(codes, C.START, C.FINISH) + "I" * (C.FINISH[end] // C.INSERT) == audit


def test_long_conversation_and_empty_table(spark, tmp_path):
    codes = bytes([1, 2] * 3000 + [1])
    assert C.edits_between(codes, C.START, C.FINISH) == "K" * 6000 + "D" and C.table_of(codes)[:3] == [2 * 6001, C.FAR, 0]
    table(spark, []).write.parquet(str(tmp_path / "conversations.parquet"))
    out = C.op12_conversations(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and out.count() == 0
