"""Conversation repair and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tessera.llm import conversations, prefix_trie, queries

from .conftest import make_turns

SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def nulls_first(x):
    return (x is not None, x or 0)


def damage(rows):
    out = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """The least (cost, audit) over all lengths of the repaired conversation, each by a backward recursion over its whole role string."""

    def against(target):
        @lru_cache(None)
        def best(i, j):
            if i == len(turns) and j == len(target):
                return 0, ""
            options = []
            if j < len(target) and target[j] in "ua":
                c, a = best(i, j + 1)
                options.append((c + 2, "I" + a))
            if i < len(turns):
                c, a = best(i + 1, j)
                options.append((c + 3, "D" + a))
                if j < len(target) and found[i] not in ("blank", "duplicate"):
                    c, a = best(i + 1, j + 1)
                    if turns[i][1][:1] == target[j]:
                        options.append((c + (found[i] == "truncated"), "K" + a))
                    if target[j] in "ua":
                        options.append((c + 2 + (found[i] == "truncated"), "R" + a))
            return min(options, default=(10**9, ""))

        return best(0, 0)

    pairs = range(len(turns) + 3)
    return min((*against(t), t) for k in pairs for t in ({"", "ua" * k} | ({"s" + "ua" * k} if k else set())))


def repair(turns):
    found = faults(turns)
    cost, audit, target = cheapest(turns, found)
    names, at, out = {"u": "user", "a": "assistant"}, iter(turns), []
    for edit in audit:
        _, role, text = (None, None, "") if edit == "I" else next(at)
        if edit != "D":
            out.append((role if edit == "K" else names[target[len(out)]], text))
    numbers = [t for t, *_ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        sha("\n".join(f"{r}:{t}" for r, t in out)),
    ), out


def by_conversation(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t, role, text))
    return {c: sorted(x, key=lambda y: (nulls_first(y[0]), *y[1:])) for c, x in out.items()}


def test_repair(spark, sf_dir):
    rows = [r[:4] for r in make_turns()]
    groups = by_conversation(damage(rows))
    expected = {c: repair(groups.get(c, []))[0] for c in {r[0] for r in rows}}
    found = {r[0]: tuple(r)[1:] for r in queries.op12_repair_conversations(spark, sf_dir).collect()}
    assert found == expected
    assert any(not groups.get(c) for c in expected) and {"K", "R", "D", "I"} <= set("".join(x[6] for x in expected.values()))


@pytest.mark.parametrize("piece", [1, 3])
def test_pieces_and_turns(spark, monkeypatch, piece):
    """Long conversations in pieces; the repaired turns themselves."""
    monkeypatch.setattr(conversations, "PIECE", piece)  # used by the driver's columns only
    rng = random.Random(piece)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", "Ok!"]) + " " * rng.randint(0, 3) + str(rng.choice([".", t]))) for c in (1, 2, 3) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = defaultdict(list)
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: (r["conv_id"], r["place"])):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    for c, group in by_conversation(rows).items():
        assert turns[c] == repair(group)[1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns[c]))


def brute_trie(rows):
    own = {c: [(r or "", t or "") for _, r, t in sorted(x, key=lambda y: (nulls_first(y[0]), y[1] or "", y[2] or ""))] for c, x in by_group(rows).items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - int(c - 5 * int(c / 5))
        rebuilt[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    nodes = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].add(c)
    below = {k: [x for x in nodes if x[: len(k)] == k] for k in nodes}
    childless = {k for k in nodes if not any(len(x) == len(k) + 1 for x in below[k])}
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(rebuilt[c]) == len(k))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below[k] if x)
        out.append(
            (min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(x) == len(k) + 1 for x in below[k]), sum(x in childless for x in below[k]), saved, sha(",".join(map(str, ends))))
        )
    return out


def by_group(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append((t, role, text))
    return out


def test_trie(spark, sf_dir):
    found = [tuple(r) for r in queries.op13_prefix_trie(spark, sf_dir).collect()]
    assert sorted(found, key=repr) == sorted(brute_trie([r[:4] for r in make_turns()]), key=repr)
    assert sum(r[3] > 1 for r in found) > 20


def test_deep(spark):
    """A chain of 70 turns that three conversations share for 60: seven rounds."""
    rows = [(c, t, "user", f"turn {t}" if t < 60 else f"turn {t} of {c}") for c in (5, 10, 15) for t in range(70)]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = prefix_trie.trie(prefix_trie.rebuilt(turns, every=1)).collect()
    root = next(r for r in found if r["depth"] == 0)
    assert (root["n_leaves"], root["saved_tokens"], len(found)) == (3, sum(2 * len(f"turn {t}") for t in range(60)), 91)
