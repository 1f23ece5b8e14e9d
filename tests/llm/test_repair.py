"""Repair of conversations against plain searches."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest

from palisade.llm import repair
from palisade.llm.queries import QUERIES

PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string, copies string, step string, edit string, key string"


def faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, inserts=2):
    """Cost, audit and result of every way to edit a few rows, the pattern checked afterwards."""
    for kinds in product("KRD", repeat=len(rows)):
        if any(k != "D" and f in ("blank", "duplicate") for k, f in zip(kinds, faults(rows))):
            continue
        for gaps in product(range(inserts + 1), repeat=len(rows) + 1):
            fixed = []
            for i in range(len(rows) + 1):
                fixed += [("I", None)] * gaps[i] + ([(kinds[i], i)] if i < len(rows) else [])
            free = [n for n, (k, _) in enumerate(fixed) if k in "IR"]
            for names in product(("user", "assistant"), repeat=len(free)):
                given = dict(zip(free, names))
                result = [(given.get(n, rows[i][0] if i is not None else None), rows[i][1] if i is not None else "")
                          for n, (k, i) in enumerate(fixed) if k != "D"]
                if PATTERN.fullmatch("".join(r[:1] or "-" for r, _ in result)):
                    cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[k] for k, _ in fixed)
                    cost += 5 * sum(k != "D" and faults(rows)[i] == "truncated" for k, i in fixed if i is not None)
                    yield cost, "".join(k for k, _ in fixed), result


def plain_search(rows):
    """Cheapest cost and least audit with whole strings held per state."""
    best = {"": (0, "", [])}

    def offer(table, state, cost, audit, out):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = cost, audit, out

    def insert(table):
        for _ in range(3):
            for state, (cost, audit, out) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                offer(table, role[0], cost + 5, audit + "I", out + [(role, "")])

    insert(best)
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}
        for state, (cost, audit, out) in best.items():
            offer(new, state, cost + 2, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            wanted = "assistant" if state == "u" else "user"
            offer(new, wanted[0], cost + 1, audit + "R", out + [(wanted, text)])
            if role[:1] == wanted[0] or role[:1] == "s" and state == "":
                offer(new, role[0], cost, audit + "K", out + [(role, text)])
        insert(new)
        best = new
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def plain_audit(conv_id, rows):
    """``rows`` (turn, role, text) after damage, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    pairs = [(r, t) for _, r, t in rows]
    turns = {t for t, _, _ in rows if t is not None}
    many = Counter(faults(pairs))
    cost, audit, out = plain_search(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return conv_id, gaps, many["blank"], many["duplicate"], many["truncated"], illegal, cost, audit, digest


def plain_damage(conv_id, turn, role, text):
    fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
    return [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)


def some_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "sage", "Tool", ""]
    texts = ["a.", "b!", "c?", "d", "e", "", " \t", "é.", "f.  \n"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{i}.") for i in range(n)]


def run(rows, **options):
    talk = repair.Conversation(1, **options)
    edits = [e for i, (r, t) in enumerate(rows) for e in talk.add(i, r.encode(), t.encode())]
    edits += talk.end()
    return talk, edits


def test_plain_search_tries_everything():
    rng = random.Random(3)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = some_rows(rng, n)
        assert plain_search(rows) == min(every_repair(rows), key=lambda b: b[:2])


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 3, 101])
def test_search_equals_plain_one_also_when_hashes_collide(modulus):
    rng = random.Random(modulus)
    for n in [*range(9)] * 12 + [60, 300]:
        rows = some_rows(rng, n)
        for settle_at in (4096, 8):
            talk, edits = run(rows, settle_at=settle_at, modulus=modulus)
            assert (talk.cost, "".join(talk.audit)) == plain_search(rows)[:2]
            assert [(r.decode(), t.decode()) for _, _, e, _, r, t in edits if e != "D"] == plain_search(rows)[2]
            assert [s for _, s, *_ in edits] == list(range(len(edits)))


def test_long_conversation_leaves_memory():
    rng = random.Random(8)
    talk, held = repair.Conversation(1, settle_at=512), 0
    for i in range(20_000):
        role = rng.choice(["user", "assistant"]) if i else "system"
        for _ in talk.add(i, role.encode(), b"%d." % i if rng.random() < 0.9 else b"open"):
            pass
        held = max(held, len(talk.waiting), len(talk.audits))
    assert held < 2000
    list(talk.end())
    assert len("".join(talk.audit).replace("I", "")) == 20_000


def test_audits_compare_like_strings():
    rng = random.Random(5)
    for modulus in ((1 << 61) - 1, 2):
        tree, words = repair.Audits(modulus), [""]
        for _ in range(400):
            at = rng.randrange(len(words))
            letter = rng.choice("DIKR")
            tree.add(at, letter)
            words.append(words[at] + letter)
        for _ in range(3000):
            x, y = rng.randrange(len(words)), rng.randrange(len(words))
            got = tree.compare(x, y)
            assert (got > 0) - (got < 0) == (words[x] > words[y]) - (words[x] < words[y])
            top = tree.shared(x, y)
            assert words[x].startswith(words[top]) and words[y].startswith(words[top])


def awkward():
    rows = [(1, t, r, x) for t, (r, x) in enumerate(some_rows(random.Random(1), 9))]
    rows += [(2, None, "user", "hi."), (2, None, None, None), (2, 7, None, "x."), (2, 7, "assistant", "y."), (2, 7, "assistant", "y."), (2, 3, "user", "z. " * 30_000)]
    rows += [(None, t, r, x) for t, (r, x) in enumerate(some_rows(random.Random(2), 5))]
    rows += [(i, t, r, x) for i in range(3, 60) for t, (r, x) in enumerate(some_rows(random.Random(i), i % 9))]
    rows += [(-5, None, None, None), (70, 5, "user", "only\nlines."), (71, 2, "system", "s.")]
    return [(*r, "x", "x", "x", "x") for r in rows]


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), ROWS)
    want = {}
    for conv_id, turn, role, text, *_ in awkward():
        want.setdefault(conv_id, []).extend(plain_damage(conv_id, turn, role, text))
    got = repair.audit_conversations(repair.damage(df), copies="copies").collect()
    assert Counter(map(tuple, got)) == Counter(plain_audit(c, rows) for c, rows in want.items())
    nothing = repair.audit_conversations(df.limit(0))
    assert nothing.count() == 0 and nothing.columns == got[0].__fields__


def test_rows_and_digests_agree(spark):
    df = spark.createDataFrame(awkward(), ROWS)
    digests = {r.conv_id: r for r in repair.audit_conversations(df, settle_at=8).collect()}
    edits = {}
    for e in repair.repair_conversations(df, settle_at=8).collect():
        edits.setdefault(e.conv_id, []).append(e)
    assert edits.keys() == digests.keys()
    for conv_id, some in edits.items():
        some.sort(key=lambda e: e.step)
        assert "".join(e.edit for e in some) == digests[conv_id].audit
        joined = "\n".join(f"{e.role}:{e.text}" for e in some if e.edit != "D")
        assert hashlib.sha256(joined.encode()).hexdigest() == digests[conv_id].repaired_sha256


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        want.setdefault(r.conv_id, []).extend(plain_damage(r.conv_id, r.turn, r.role, r.text))
    got = QUERIES["op13_turn_repair"](spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(plain_audit(c, rows) for c, rows in want.items())
    assert any(r.duplicate for r in got) and any(r.truncated for r in got) and any(r.blank for r in got)
