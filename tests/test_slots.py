"""Slots against trying everything: growth over all intervals, exchanges over all orders of up to seven groups."""

import random
from dataclasses import replace
from itertools import combinations, permutations

from momentis.operators import slots
from momentis.operators.slots import Board, Cell, Group
from momentis.plans import registry

SF = "/root/testdata/sf0.001"


def random_board(rng, n, filled=0.3):
    cells, at = [], 0
    drop = rng.randrange(n)
    for k in range(n):
        beats = rng.choice([2, 3, 4, 4, 8])
        group = Group(100 + k, 1.0, 2, 1e9 * k) if rng.random() < filled and k != drop else None
        cells.append(Cell(at, at + beats, rng.random(), k == drop, group))
        at += beats
    return Board(cells, 12)


def all_intervals(board, i, need):
    """Every (swallowed, beats, second, start, stop) that cell i may become, by the rule's words."""
    cell, out = board.cells[i], []
    for start in range(board.cells[0].start, cell.start + 1):
        for stop in range(cell.stop, board.cells[-1].stop + 1):
            swallowed, fine = 0, True
            for k, c in enumerate(board.cells):
                taken = max(0, min(c.stop, stop) - max(c.start, start))
                if k == i or not taken:
                    continue
                if c.group is not None or c.drop:
                    fine = False
                elif taken == c.beats:
                    swallowed += 1
                    fine &= k > i or cell.drop
                else:
                    fine &= c.beats - taken >= max(2, (c.beats + 1) // 2)
            if fine and need <= stop - start <= board.most:
                out.append((swallowed, stop - start, stop - cell.stop if cell.drop else cell.start - start, start, stop))
    return out


def test_growth_is_the_least_of_all_intervals():
    rng = random.Random(1)
    grown = 0
    for _ in range(400):
        board = random_board(rng, rng.randint(1, 5))
        free = board.free()
        if not free:
            continue
        i, need = rng.choice(free), rng.randint(1, 12)
        own, end = board.cells[i], board.cells[-1].stop
        ways = all_intervals(board, i, need)
        k = board.copy()
        at = k.grow(i, need)
        if own.beats >= need or not ways:
            assert (k.cells[at].start, k.cells[at].stop) == (own.start, own.stop)
            assert board.plan(i, need) == (None if own.beats < need else (0, 0))
        else:
            assert (k.cells[at].start, k.cells[at].stop) == min(ways)[3:]
            grown += 1
        assert k.cells[0].start == 0 and k.cells[-1].stop == end and all(a.stop == b.start and a.beats > 0 for a, b in zip(k.cells, k.cells[1:], strict=False))
    assert grown > 50


def test_exchanges_against_all_orders():
    rng = random.Random(2)
    best = rounds = 0
    for _ in range(40):
        n = rng.randint(3, 7)
        cells, at = [], 0
        for k in range(n):
            g = Group(k, rng.choice([1.0, 1.2, 1.4]), rng.choice([2, 4, 6]), 10.0 * rng.randrange(6), 1, rng.choice("ab"))
            cells.append(Cell(at, at + rng.choice([4, 4, 8]), 0.0, k == n - 1, g))
            at = cells[-1].stop
        board = Board(cells, 12, apart=5.0)
        links = lambda row: sum(a.link == b.link for a, b in zip(row, row[1:], strict=False))
        alike = lambda row: sum(board.alike(a, b) for a, b in zip(row, row[1:], strict=False))
        before = [c.group for c in cells]
        after = [c.group for c in slots.brought_together(board, cells, 0.5)]
        assert sorted(g.key for g in after) == list(range(n)) and after[0] is before[0] and after[-1] is before[-1]
        assert links(after) >= links(before) and alike(after) <= alike(before)
        room = [c.beats for c in cells]
        fits = lambda row: all(g.need <= room[k] or room[k] >= room[before.index(g)] for k, g in enumerate(row))
        # No one or two exchanges bring more together.
        fine = lambda row, i, j: (row[i].need <= room[j] or room[j] >= room[i]) and (row[j].need <= room[i] or room[i] >= room[j])
        inner = range(1, n - 1)
        for i, j in combinations(inner, 2):
            if not fine(after, i, j):
                continue
            one = list(after)
            one[i], one[j] = one[j], one[i]
            assert not (links(one) > links(after) and alike(one) <= alike(after))
            for x, y in combinations(inner, 2):
                two = list(one)
                two[x], two[y] = two[y], two[x]
                assert not fine(one, x, y) or not (links(two) > links(after) and alike(two) <= alike(after))
        top = max(links(r) for p in permutations(before[1:-1]) if fits(r := [before[0], *p, before[-1]]) and alike(r) <= alike(before))
        rounds += 1
        best += links(after) == top
    assert best >= 0.8 * rounds


def test_orders():
    cells = [Cell(0, 4, 0.2), Cell(4, 8, 0.4), Cell(8, 12, 10.9, True), Cell(12, 16, 0.3)]
    groups = [Group(1, 5.0, 6, 30.0, 2), Group(2, 3.0, 2, 10.0), Group(3, 2.0, 2, 20.0), Group(4, 1.0, 2, 40.0)]
    built = slots.build_up(Board(cells, 12), groups)
    assert [(c.group.key, c.start, c.stop) for c in built] == [(2, 0, 4), (3, 4, 6), (1, 6, 12), (4, 12, 16)]
    timed = slots.in_time(Board(cells, 12), groups)
    assert [c.group.key for c in timed] == [2, 3, 1, 4] and timed[2].drop
    # With one group before the drop it's still the best one's; with none after it, order alone counts.
    late = [replace(g, at=50.0) if g.key == 1 else g for g in groups]
    assert [c.group.key for c in slots.in_time(Board(cells, 12), late)] == [2, 3, 4, 1]
    assert slots.build_up(Board(cells, 12), []) == [] and [c.stop for c in slots.build_up(Board(cells, 12), groups[1:2])] == [16]


def test_query(spark):
    rows = registry.queries()["slot_plan"](spark, SF).collect()
    laid = {}
    for r in rows:
        laid.setdefault((r.manner, r.cap), []).append((r.start_beat, r.end_beat, r.grp))
    assert {m for m, _ in laid} == {"build", "time"}
    for own in laid.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and len({g for *_, g in own}) == len(own)
    start = {(r.cap, r.grp): r.s for r in registry.queries()["kill_groups"](spark, SF).collect()}
    for (manner, cap), own in laid.items():
        if manner == "time":
            assert [start[cap, g] for *_, g in own] == sorted(start[cap, g] for *_, g in own)
