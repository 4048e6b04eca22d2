"""Repairs of conversations against a plain search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest

from ananym.llm import repair

SPACE = " \t\n\v\f\r"


def after_damage(rows):
    """Rows of one conversation in their order, as (turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out += [row] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    found, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def fits(initials):
    return not initials or (initials.removeprefix("s") and initials.removeprefix("s") == "ua" * (len(initials) // 2))


def exhaustive(rows):
    """(cost, edits, repaired rows) by trying every way to edit, with up to two insertions at every place."""
    best, found = None, faults(rows)
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "D", "Ruser", "Rassistant"] for f in found]
    for edits in itertools.product(*choices):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, added in enumerate(places):
                cost, audit, out = cost + 3 * len(added), audit + "I" * len(added), out + [(r, "") for r in added]
                if i < len(rows):
                    edit, (_, role, text) = edits[i], rows[i]
                    cost += {"K": 0, "D": 4, "R": 3}[edit[0]] + (3 if edit != "D" and found[i] == "truncated" else 0)
                    audit += edit[0]
                    out += [] if edit == "D" else [(role if edit == "K" else edit[1:], text)]
            if (best is None or (cost, audit) < best[:2]) and fits("".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, out)
    return best


def by_states(rows):
    """The same by the best way to each state after each row, for conversations too long to try everything."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    put = lambda ways: [
        ways.__setitem__(t, w) for _ in range(3) for s, (c, e, o) in list(ways.items())
        for t, w in [("a" if s == "u" else "u", (c + 3, e + "I", [*o, ("assistant" if s == "u" else "user", "")]))] if t not in ways or w[:2] < ways[t][:2]
    ]
    ways = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows)):
        put(ways)
        new = {}
        for s, (c, e, o) in ways.items():
            options = [(s, (c + 4, e + "D", o))]
            if fault not in ("blank", "duplicate"):
                extra, changed = 3 if fault else 0, "assistant" if s == "u" else "user"
                options.append((changed[0], (c + 3 + extra, e + "R", [*o, (changed, text)])))
                if (s, role[:1]) in step:
                    options.append((step[s, role[:1]], (c + extra, e + "K", [*o, (role, text)])))
            for t, w in options:
                if t not in new or w[:2] < new[t][:2]:
                    new[t] = w
        ways = new
    put(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def plain(conv, rows, solve=by_states):
    rows = after_damage(rows)
    found, turns, initials = faults(rows), {t for t, _, _ in rows if t is not None}, [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = solve(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def conversations(rows, solve=by_states):
    grouped = {}
    for row in rows:
        grouped.setdefault(row[0], []).append(row)
    return sorted((plain(conv, own, solve) for conv, own in grouped.items()), key=str)


def generated(seed, n, length):
    source = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " ", "", "Well\n", "So!  ", "e.g", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in range(n):
        turn = source.choice([None, 0, 3])
        for _ in range(source.randint(1, length)):
            rows.append((conv, turn, source.choice(roles), source.choice([*texts, f"text {source.random()}.", f"text {source.random()}."])))
            turn = source.choice([turn, (turn or 0) + 1, (turn or 0) + 1, (turn or 0) + 2])
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies long")


@pytest.mark.parametrize("seed", range(40))
def test_search_equals_trying_everything(seed):
    rows = after_damage(generated(seed, 1, 4))[:4]
    assert by_states(rows) == exhaustive(rows)
    part = repair.Part()
    for i, (turn, role, text) in enumerate(rows):
        part.add(repair.Row(turn, role, text, 1, (role, text) not in [r[1:] for r in rows[:i]]))
    assert part.best() == exhaustive(rows)[:2]


@pytest.mark.parametrize("seed", range(60))
def test_pieces_join_to_the_whole(seed):
    source = random.Random(seed)
    kinds = [repair.Step(r, t) for r in ("u", "a", "u", "a", "s", "t") for t in (False, False, True)] + [repair.Step(forced=2)]
    steps = source.choices(kinds, k=source.randint(1, 30))
    cut = source.randint(0, len(steps))
    whole = repair.cheapest(steps)
    assert whole == repair.best_repair(repair.joined(repair.transfers(steps[:cut]), repair.transfers(steps[cut:])))
    assert repair.suffix_bounds(steps)[0] <= whole[0]
    rows = [(0, {"u": "user", "a": "assistant", "s": "system"}.get(s.initial, "tool"), f"{i}{'' if s.truncated else '.'}" if not s.forced else "") for i, s in enumerate(steps) for _ in range(s.forced or 1)]
    assert by_states(rows)[:2] == whole


def test_repair_equals_plain_search(spark):
    rows = generated(1, 150, 9) + [(None, None, "user", "a."), (None, None, "user", "a."), (None, 1, None, None), (900, 1, "user", "Hi. " * 20_000)]
    got = repair.repair(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == conversations(rows)
    assert any(r["audit"] == "" for r in got) and len({r["cost"] for r in got}) > 5


def test_long_conversations_in_pieces(spark, monkeypatch):
    rows = generated(2, 6, 5)
    long = [(50, t, r, x) for _, t, r, x in generated(3, 1, 2) * 3] + [(51, i // 3, "user" if i % 2 else "assistant", f"{i % 90}.") for i in range(700)]
    long += [(52, 7, "user", "same.")] * 500
    monkeypatch.setattr(repair, "WHOLE_ROWS", 20)
    got = repair.repair(table(spark, rows + long)).collect()
    assert sorted((tuple(r) for r in got), key=str) == conversations(rows + long)


def test_without_damage_and_empty(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    got = repair.repair(table(spark, rows), damage=False).first()
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == (0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())
    assert repair.repair(table(spark, rows).limit(0)).count() == 0
