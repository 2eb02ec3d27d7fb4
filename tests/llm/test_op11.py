import hashlib
import heapq
import random
import re
import zlib

import pytest

from trailmark.llm import op11

NO_TEXT = hashlib.sha256(b"").hexdigest()


def least(kinds):
    """The cheapest audit, by a search over all of them in order of (cost, audit)."""
    heap, done = [(0, "", 0, "")], set()  # cost, audit, turns read, initials made
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        state = (i, made[:1] == "s", made[-1:])
        if state in done:
            continue
        done.add(state)
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit
        nexts = ["a"] if made.endswith("u") else ["u"]
        k = kinds[i] if i < len(kinds) else None
        if k:
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if k != "x":
                extra = 5 if k.isupper() else 0
                if k.lower() in nexts or (k.lower() == "s" and not made):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, made + k.lower()))
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, made + nexts[0]))
        heapq.heappush(heap, (cost + 5, audit + "I", i, made + nexts[0]))
    raise AssertionError


def brute(rows):
    """The contract, directly."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        n, kinds, seen = dict.fromkeys("bdt", 0), "", set()
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            k = role[:1] if role[:1] in ("u", "a", "s") else "o"
            fault = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kinds += k.upper() if fault == "t" else "x" if fault else k
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = least(kinds)
        lines, left = [], iter(own)
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e != "D":
                role = role if e == "K" else "assistant" if lines and lines[-1][:1] == "u" else "user"
                lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(rng, conv, n):
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None], ["Fine.", "Cut off", "Why? ", " \n", "", None, "No!\t", "x."]
    return [(conv, rng.choice([None, t, t, t + 3]) if rng.random() < 0.2 else t, rng.choice(roles if rng.random() < 0.3 else ["user", "assistant"]), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}.") for t in range(n)]


@pytest.mark.parametrize("block", [3, 512])
def test_alignment_is_the_cheapest_and_least(monkeypatch, block):
    rng = random.Random(5)
    monkeypatch.setattr(op11, "BLOCK", block)
    for n in range(400):
        kinds = "".join(rng.choice("uuaasxUASoO" if n % 2 else "ua") for _ in range(rng.randint(0, 14)))
        walk = op11._Walk()
        for k, kind in enumerate(kinds):
            role = {"u": "user", "a": "assistant", "s": "system"}.get(kind.lower(), "tool")
            walk.add(k, role, "" if kind == "x" else f"{k}" + ("" if kind.isupper() else "."), False)
        assert walk.row(1)[6:8] == least(kinds), kinds


def test_conversations_equal_a_direct_repair(spark):
    rng = random.Random(11)
    rows = [r for conv in range(150) for r in made(rng, conv, rng.randint(1, 12))] + made(rng, None, 9)
    rows += [(500, t, "user" if t % 2 else "assistant", "Same.") for t in range(40)] + [(501, 1, "user", "Twice.")] * 3 + [(502, None, None, None)]
    dropped = next(c for c in range(600, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "Lost.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, key string").repartition(4)
    got = [tuple(r) for r in op11.audits(op11.damage(df)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", NO_TEXT) in got
    lines = {}
    for r in sorted(op11.repaired(op11.damage(df)).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {g[0]: g[8] for g in got} == {g[0]: hashlib.sha256("\n".join(lines.get(g[0], [])).encode()).hexdigest() for g in got}


def test_long_conversation_in_blocks(spark):
    rng = random.Random(3)
    rows = made(rng, 1, 3000) + [(2, 0, "user", "Long. " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in op11.audits(op11.damage(df)).collect()) == sorted(brute(rows))


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op11.audits(op11.damage(df)).count() == 0 and op11.repaired(op11.damage(df)).count() == 0
