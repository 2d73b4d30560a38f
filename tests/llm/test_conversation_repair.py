import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from momentis.llm.conversation_repair import OP13_SQL, damage, op13_conversation_repair, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def edited(rows):
    """Every edit of a few rows, tried out: (cost, audit, repaired) of the best."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        blank = not text.strip(SPACE)
        again = not blank and (role, text) in seen
        seen.add((role, text))
        faults.append((blank, again, not blank and not again and text.rstrip(SPACE)[-1] not in ".!?"))
    found = []
    inserts = ["", "u", "a", "ua"]

    def go(k, cost, audit, turns):
        for extra in inserts:
            at = turns + [("user" if x == "u" else "assistant", "") for x in extra]
            paid, said = cost + 2 * len(extra), audit + "I" * len(extra)
            if k == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in at)):
                    found.append((paid, said, at))
                continue
            _, role, text = rows[k]
            blank, again, cut = faults[k]
            go(k + 1, paid + 3, said + "D", at)
            if not blank and not again:
                go(k + 1, paid + cut, said + "K", [*at, (role, text)])
                for new in ("user", "assistant"):
                    go(k + 1, paid + cut + 2, said + "R", [*at, (new, text)])

    go(0, 0, "", [])
    cost, audit, turns = min(found, key=lambda x: (x[0], x[1]))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(sum(f[i] for f in faults) for i in range(3)), illegal, cost, audit, turns)


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, *range(5)])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["Good.", "No end", "", "  \t", None, "Well!\n", "Ünd so?"])))
    return rows


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_edits_equal_those_of_trying_all(spark, block):
    rows = random_rows(block, 40, 3)
    got = {r.conv_id: r for r in repair(spark.createDataFrame(rows, SCHEMA), block).collect()}
    for c in range(40):
        want = edited([(t, " " if r is None else r, " " if x is None else x) for conv, t, r, x in rows if conv == c])
        g = got[c]
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, [tuple(x) for x in g.repaired]) == want


def test_long_conversations_in_blocks_equal_the_whole(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "C!", ""]) + str(rng.randint(0, 40)) + ".") for c in range(3) for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.conv_id: r for r in repair(df).collect()}
    parts = {r.conv_id: r for r in repair(df, 16).collect()}
    assert whole == parts and len(whole) == 3


def test_whole_query_with_made_faults(spark, tmp_path):
    rows = random_rows(4, 40, 4) + [(None, 1, "user", "Here."), (None, 2, "assistant", "There."), (-7, -(1 << 40), "user", "x." * 100_000)]
    # Columns of other names, also of the operator's own.
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", present int, block string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    changed = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    for c, g in got.items():
        want = edited([(t, r, x) for conv, t, r, x in changed if conv == c])
        text = "\n".join(f"{r}:{x}" for r, x in want[-1])
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit) == want[:-1]
        assert g.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    con = duckdb.connect()
    con.sql(f"create view conversations as select conv_id, turn, role, text from '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in con.sql(OP13_SQL).fetchall()} == {tuple(r) for r in got.values()}


def test_conversation_of_dropped_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair(damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))).collect()[0]
    assert (row.conv_id, row.gaps, row.blank, row.illegal, row.cost, row.audit, row.repaired) == (gone, 0, 0, 0, 0, "", [])
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
