"""Conversation repair against a search over all edits of one conversation."""

import hashlib
import random
import re
import zlib

import pytest

from bugsieve.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, copies int, audit string"
TEXTS = ["Fine.", "cut", "", " ", "Why?", "no end", "Go!", "tail. \n"]
ROLES = ["user", "assistant", "system", "tool", "unknown", "", None]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = []
    for c, t, r, x in rows:
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        out += [(c, t, r, x)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edits of ``(role, text, fault)`` rows, by states (output so far's last role)."""
    start = {"": (0, "", ())}
    grow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        best = dict(best)
        for _ in range(3):
            for last, (cost, audit, lines) in list(best.items()):
                for new in grow[last].replace("s", ""):
                    role = {"u": "user", "a": "assistant"}[new]
                    offer = (cost + 2, audit + "I", lines + (f"{role}:",))
                    best[new] = min(best.get(new, offer), offer, key=lambda o: o[:2])
        return best

    best = start
    for role, text, fault in rows:
        after = {}
        for last, (cost, audit, lines) in with_inserts(best).items():
            options = [(last, cost + 3, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] and role[0] in grow[last]:
                    options.append((role[0], cost + late, audit + "K", lines + (f"{role}:{text}",)))
                for new in grow[last].replace("s", ""):
                    name = {"u": "user", "a": "assistant"}[new]
                    options.append((new, cost + 2 + late, audit + "R", lines + (f"{name}:{text}",)))
            for new, *offer in options:
                offer = tuple(offer)
                after[new] = min(after.get(new, offer), offer, key=lambda o: o[:2])
        best = after
    done = with_inserts(best)
    return min((done[x] for x in ("", "a") if x in done), key=lambda o: o[:2])


def plain_report(rows):
    convs = {c: [] for c, *_ in rows}
    for row in damage(rows):
        convs[row[0]].append(row[1:])
    out = {}
    for c, mine in convs.items():
        mine.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], sha(q[2])))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = (
                "blank" if not bare
                else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?"
                else ""
            )
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [sum(f == k for *_, f in faults) for k in ("blank", "duplicate", "truncated")]
        cost, audit, lines = cheapest(faults)
        out[c] = (gaps, *counts, illegal, cost, audit, sha("\n".join(lines)))
    return out


def found(spark, rows, **more):
    given = spark.createDataFrame([(*r, "k", 7, "a") for r in rows], SCHEMA)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = repair.report(given, **more).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in names) for r in got}


def random_rows(seed, n_convs, longest, roles=ROLES, texts=TEXTS):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 1, None])
            rows.append((c, turn, rng.choice(roles), rng.choice([*texts, f"Say {t}."])))
    return rows


def test_random_conversations(spark):
    rows = random_rows(1, 150, 9)
    assert found(spark, rows) == plain_report(rows)


def test_long_conversations_in_many_blocks(spark):
    rows = random_rows(2, 4, 80, roles=["user", "assistant", "system"]) + [(9, t, "user", f"a{t}.") for t in range(300)]
    want = plain_report(rows)
    assert found(spark, rows, block_rows=7) == want
    assert found(spark, rows, rounds=0) == want


def test_null_ids_repeats_and_dropped_conversations(spark):
    dropped = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (dropped, 0, "user", "Hi."), (3, 2, "assistant", "x")]
    rows += [(4, 5, "user", "Same.")] * 40 + [(4, None, "user", "Same.")] * 3 + [(None, 1, "user", "Hi.")] * 2
    got = found(spark, rows)
    assert got == plain_report(rows) and got[dropped] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert found(spark, []) == {}


def test_very_long_text(spark):
    rows = [(1, 1, "user", "word " * 200_000), (1, 2, "assistant", "é" * 300_000 + "."), (1, 3, "user", " " * 100_000)]
    assert found(spark, rows) == plain_report(rows)


def test_repaired_turns_hold_the_texts(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "tool", "Result"), (1, 4, "user", "Thanks.")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    faults, turns = repair.repair(repair.named(given))
    audit, cost = faults.select("audit", "cost").head()
    got = [(r["role"], r["text"]) for r in turns.orderBy("pos").collect()]
    cost_, audit_, lines = cheapest([("system", "Be kind.", ""), ("assistant", "Hello.", ""), ("tool", "Result", "truncated"), ("user", "Thanks.", "")])
    assert (cost, audit) == (cost_, audit_) and [f"{r}:{t}" for r, t in got] == list(lines)


@pytest.mark.parametrize("seed", range(4))
def test_product_of_matrices_in_any_grouping(seed):
    rng = random.Random(seed)
    word = "".join(rng.choice(repair.SYMBOLS) for _ in range(40))
    rules = [("u", "a"), (chr(0x100), chr(0x100)), ("X", "X"), ("s", chr(0x101))]
    made = repair.rule_matrices(rules)
    plain = repair.symbol_matrix(word[0])
    for x in word[1:]:
        plain = repair.times(plain, repair.symbol_matrix(x))
    fast = repair.product([made[x] for x in repair.compressed(word, rules)])
    spell = lambda m: [[e and (e[0], repair.spelled(e[1])) for e in row] for row in m]
    assert spell(plain) == spell(fast)


def test_pair_counts_do_not_overlap():
    assert repair.pair_counts("aaaaab") == {"aa": 2, "ab": 1}
    assert repair.pair_counts("") == {}


def test_grammar_shares_rules(spark):
    rows = [("ua" * 8, 10), ("s" + "ua" * 5, 3), ("uaX", 1)]
    rules = repair.grammar(spark.createDataFrame(rows, "symbols string, n long"))
    assert rules[0] == ("u", "a") and (chr(0x100), chr(0x100)) in rules
    assert len(repair.compressed("ua" * 8, rules)) == 1
