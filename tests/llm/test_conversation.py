"""Conversation repair against a search over whole edit strings, at chunk lengths that need fix-up passes."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from vigilake.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int, chunk string"
BLANK = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def brute(rows):
    """Cheapest, then least, audit by a search over (cost, audit) of one conversation's rows in order."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    turns = [t for _, t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    heap, settled = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if (at, last) in settled:
            continue
        settled.add((at, last))
        if at == len(rows) and last in ("", "a"):
            text = "\n".join(lines)
            return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("cut"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest())
        n = nexts[last]
        heapq.heappush(heap, (cost + 2, audit + "I", at, n, (*lines, names[n] + ":")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, lines))
            if kinds[at] not in ("blank", "duplicate"):
                extra = kinds[at] == "cut"
                if initials[at] == n or (initials[at] == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, initials[at], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, n, (*lines, f"{names[n]}:{text}")))


def expected(rows):
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {conv: empty for conv, *_ in rows}
    for conv in found:
        own = damage([r for r in rows if r[0] == conv])
        if own:
            found[conv] = brute(own)
    return found


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)


def compare(spark, rows, **how):
    got = conversation.conversation_repairs(made(spark, rows), **how)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == ["conv_id", *names]
    assert [t for _, t in got.dtypes[1:7]] == ["bigint"] * 6
    rows_got = got.collect()
    assert len(rows_got) == len({r["conv_id"] for r in rows_got})
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in rows_got} == expected(rows)


def talk(rng, conv, n, roles):
    texts = ["Yes.", "No!", "why", "And then?", " ", "", "ok\n", "fine. \t", None, "Long text " * 9 + "."]
    return [(conv, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{conv}.{t}.")
            for t in range(n)]


def test_short_and_awkward(spark):
    rng = random.Random(4)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "assistant", "Hi."),
            (2, 0, "system", "S."), (3, 0, "", "x."), (4, 5, "Sam", "x."), (5, -3, "tool", "x"), (5, 2**40, "user", "y")]
    rows += [(6, 1, "user", "same.")] * 4 + [(7, t, "user", "same.") for t in range(6)]
    for conv in range(10, 120):
        rows += talk(rng, conv, rng.randint(1, 9), ["system", "user", "assistant", "tool", None, ""])
    compare(spark, rows)


@pytest.mark.parametrize("chunk, passes", [(3, 8), (5, 1), (4, 0)])
def test_long_conversations_in_chunks(spark, chunk, passes):
    rng = random.Random(chunk)
    rows = []
    for conv, roles in enumerate((["user", "assistant"], ["tool"], ["system", "user"], ["user"], ["tool", "assistant", None])):
        rows += [(conv, t, r, x) for _, t, r, x in talk(rng, conv, 70, roles)]
    rows += [(9, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(90)]
    rows += [(8, t, "tool", f"{t}.") for t in range(41)]
    compare(spark, rows, chunk=chunk, passes=passes)


def test_stitched_costs(spark):
    """The vector before a first chunk and the constants behind it make the cost of the whole."""
    rng = random.Random(1)
    rows = []
    for conv in range(6):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 7]) for _ in range(rng.randint(20, 60)))
        parts = [codes[i:i + 7] for i in range(0, len(codes), 7)]
        rows += [(str(conv), k, len(parts), bytearray(p), conversation.chunk_costs(codes, conversation.LEFT)[0]) for k, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "conv string, chunk long, n_chunks long, codes binary, want long")
    for passes in (20, 1):
        got = conversation.costs_behind(df, passes).collect()
        for conv in {r["conv"] for r in got}:
            own = [r for r in got if r["conv"] == conv]
            assert next(r["before"][0] for r in own if r["chunk"] == 0) + sum(r["base"] for r in own) == own[0]["want"]


def test_empty(spark):
    assert conversation.conversation_repairs(made(spark, [])).collect() == []
