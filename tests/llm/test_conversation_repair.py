import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from marketlens.llm import conversation_repair as repair

NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit) of the least edits, by trying all; rows are (initial, must go, is cut)."""

    @lru_cache(maxsize=None)
    def best(j, s, inserted):
        found = []
        if j == len(rows):
            if s in (0, 3):
                found.append((0, ""))
        else:
            i, must, cut = rows[j]
            c, a = best(j + 1, s, 0)
            found.append((4 + c, "D" + a))
            if not must and (s, i) in FITS:
                c, a = best(j + 1, FITS[s, i], 0)
                found.append((3 * cut + c, "K" + a))
            if not must:
                c, a = best(j + 1, NEXT[s][1], 0)
                found.append((3 + 3 * cut + c, "R" + a))
        if inserted < 3:
            c, a = best(j, NEXT[s][1], inserted + 1)
            found.append((3 + c, "I" + a))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def by_hand(rows):
    """conv -> what the operator returns, in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        shown = ":".join(" " if x is None else str(x) for x in (conv, turn))
        hit, role, text = zlib.crc32(shown.encode()) % 20, " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    result = {}
    for conv, out in convs.items():
        key = "" if conv is None else f"={conv}"
        mark = lambda r: hashlib.sha256(f"{len(key)}:{len(r[1])}:{key}:{r[1]}:{r[2]}".encode()).digest()  # noqa: B023, E731
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))
        seen, coded, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in out:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(tuple(coded))
        lines, left, s = [], iter(out), 0
        for e in audit:
            _, role, text = next(left) if e != "I" else (None, "", "")
            if e != "D":
                s = FITS[s, role[:1]] if e == "K" else NEXT[s][1]
                lines.append((role if e == "K" else {2: "user", 3: "assistant"}[s]) + ":" + text)
        turns = [r[0] for r in out if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None]
TEXTS = ["Fine.", "Really?", "cut off", " \t", "", None, "x" * 50 + "!", "Two\nlines. ", "日本語。", "wow!", "So. "]


def conversations(n, seed, most=14):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, most)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(ROLES), rng.choice(TEXTS) or rng.choice(TEXTS)))
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_repair_matches_trying_all(spark, block):
    rows = conversations(120, 8) + [(900, t, "user" if t % 2 else "assistant", f"Long {t % 7} {'y' * (t % 3)}" + "." * (t % 5 > 0)) for t in range(150)]
    rows += [(901, 1, "user", "same.")] * 9 + [(902, t, "user", "same.") for t in range(9)] + [(903, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    found = {r["conv_id"]: tuple(r[c] for c in repair.RETURNED) for r in repair.repair(df.withColumn("Block", F.lit(1)).withColumn("at", F.lit("x")), block=block).collect()}
    wanted = by_hand(rows)
    assert found.keys() == wanted.keys()
    for conv, row in wanted.items():
        assert found[conv] == row, conv


def test_long_texts_in_pieces(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "long " * 3000 + ".") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = repair.repair(df, block=7).collect()
    assert tuple(row[c] for c in repair.RETURNED) == by_hand(rows)[1]


def test_undamaged_empty_and_dropped(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    row = repair.repair(spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")], schema), damage=False).first()
    assert row["audit"] == "KK" and row["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repair(spark.createDataFrame([(str(gone), 0, "user", "Hi.")], schema)).first()
    assert tuple(row[c] for c in repair.RETURNED) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_walks_agree_with_trying_all():
    rng = random.Random(3)
    for _ in range(300):
        codes = "".join(rng.choice("suax012SUA") for _ in range(rng.randrange(0, 12)))
        rows = tuple(({"0": "s", "1": "u", "2": "a"}.get(c, c.lower()), c.isupper(), c.isdigit()) for c in codes)
        ((edits, state),) = repair.walks(codes, repair.END, [0])
        assert (repair.costs_before(codes, repair.END)[0], edits + repair.closing(state)) == cheapest(rows)
