"""Groups laid into the slots of a montage: cells that grow into free neighbours, and swaps that bring matching groups together.

A montage is a row of cells, each of some beats; a group needs a number of beats. A cell that is too short takes beats from free cells beside it:
a part, if what is left still holds half of the cell (and the least that a cell may have), or cells as a whole; the cell of the drop may take whole
cells on both sides, any other only those after it. Of all ways to reach what is needed the one that takes fewest whole cells is chosen, then the shortest,
then the one that takes least from before (for the drop: from behind).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

MONOTONY = 0.5


@dataclass(frozen=True)
class Group:
    key: int
    rank: float
    need: int
    at: float
    kills: int = 1
    link: object = None


@dataclass(frozen=True)
class Cell:
    start: int
    stop: int
    importance: float
    drop: bool = False
    group: Group | None = None

    @property
    def beats(self) -> int:
        return self.stop - self.start


class Board:
    def __init__(self, cells: list[Cell], most: int, least: int = 2, apart: float = 0.0):
        self.cells, self.most, self.least, self.apart = list(cells), most, least, apart

    def copy(self) -> Board:
        return Board(self.cells, self.most, self.least, self.apart)

    def free(self) -> list[int]:
        return [i for i, c in enumerate(self.cells) if c.group is None]

    def takes(self, i: int, step: int, whole: bool) -> Iterator[tuple[int, int]]:
        """(beats, whole cells) that cell i can take on one side."""
        total = cells = 0
        yield 0, 0
        i += step
        while 0 <= i < len(self.cells) and self.cells[i].group is None and not self.cells[i].drop:
            own = self.cells[i].beats
            for part in range(1, own - max(self.least, (own + 1) // 2) + 1):
                yield total + part, cells
            if not whole:
                return
            total, cells = total + own, cells + 1
            yield total, cells
            i += step

    def plan(self, i: int, need: int) -> tuple[int, int] | None:
        """Beats to take before and after cell i so that it holds `need`; None if it can't."""
        cell = self.cells[i]
        if cell.beats >= need:
            return 0, 0
        if need > self.most:
            return None
        ways = [
            (a + b, cell.beats + x + y, y if cell.drop else x, x, y)
            for x, a in self.takes(i, -1, cell.drop)
            for y, b in self.takes(i, 1, True)
            if need <= cell.beats + x + y <= self.most
        ]
        return min(ways)[3:] if ways else None

    def grow(self, i: int, need: int) -> int:
        """Let cell i take what it needs, if it can; gives its place from then on."""
        before, after = self.plan(i, need) or (0, 0)
        own = replace(self.cells[i], start=self.cells[i].start - before, stop=self.cells[i].stop + after)
        left = [replace(c, stop=min(c.stop, own.start)) for c in self.cells[:i] if c.start < own.start]
        right = [replace(c, start=max(c.start, own.stop)) for c in self.cells[i + 1 :] if c.stop > own.stop]
        self.cells = [*left, own, *right]
        return len(left)

    def put(self, i: int, group: Group) -> None:
        i = self.grow(i, group.need)
        self.cells[i] = replace(self.cells[i], group=group)

    def alike(self, a: Group | None, b: Group | None) -> bool:
        """Whether two groups show the same moment, so that one after the other they look the same."""
        return a is not None and b is not None and abs(a.at - b.at) < self.apart

    def worth(self, i: int, group: Group) -> float:
        """What a free cell is worth for a group: less beside groups of the same moment."""
        beside = [self.cells[k].group for k in (i - 1, i + 1) if 0 <= k < len(self.cells)]
        return self.cells[i].importance - MONOTONY * sum(self.alike(x, group) for x in beside)

    def closed(self) -> list[Cell]:
        """The cells without the empty ones, whose beats go to the cell before (or to the first that is filled)."""
        filled = [k for k in self.cells if k.group is not None]
        if not filled:
            return []
        ends = [k.start for k in filled[1:]] + [self.cells[-1].stop]
        starts = [self.cells[0].start] + [k.start for k in filled[1:]]
        return [replace(k, start=a, stop=b) for k, a, b in zip(filled, starts, ends, strict=True)]


def build_up(board: Board, groups: list[Group], hook: bool = True, tolerance: float = 0.5) -> list[Cell]:
    """The strongest group on the drop, the next one at the start, groups of several kills where they fit, the others by importance; then swaps."""
    board = board.copy()
    left = sorted(groups, key=lambda g: (-g.rank, g.at, g.key))
    drop = next((i for i, c in enumerate(board.cells) if c.drop), None)
    if drop is not None and left:
        board.put(drop, left.pop(0))
    if hook and len(board.cells) >= 3 and len(left) >= 2 and board.cells[0].group is None:
        board.put(0, left.pop(0))
    for g in sorted(left, key=lambda g: g.kills < 2):  # stable: by rank within both
        free = sorted(board.free(), key=lambda i: -board.worth(i, g))
        if not free:
            break
        fitting = (i for i in free if board.plan(i, g.need) is not None) if g.kills > 1 else iter(free)
        board.put(next(fitting, free[0]), g)
    filled = [i for i, c in enumerate(board.cells) if c.group is not None]
    for i, cell in zip(filled, brought_together(board, [board.cells[i] for i in filled], tolerance), strict=True):
        board.cells[i] = cell
    return board.closed()


def in_time(board: Board, groups: list[Group]) -> list[Cell]:
    """The strongest groups in the order in which they were played, the best of them on the drop if both sides have cells enough for the others."""
    kept = sorted(groups, key=lambda g: (-g.rank, g.at, g.key))[: len(board.cells)]
    ordered = sorted(kept, key=lambda g: (g.at, g.key))
    drop = next((i for i, c in enumerate(board.cells) if c.drop), None)

    def lay(own: Board, some: list[Group], i: int) -> bool:
        """Groups into the cells from i on, as far as they are free."""
        for g in some:
            if i >= len(own.cells) or own.cells[i].group is not None:
                return False
            i = own.grow(i, g.need)
            own.cells[i] = replace(own.cells[i], group=g)
            i += 1
        return True

    if drop is not None and kept:
        own = board.copy()
        own.put(drop, kept[0])
        at = ordered.index(kept[0])
        where = lambda: next(i for i, c in enumerate(own.cells) if c.group is kept[0])
        if lay(own, ordered[:at], 0) and lay(own, ordered[at + 1 :], where() + 1):
            return own.closed()
    own = board.copy()
    lay(own, ordered, 0)
    return own.closed()


def brought_together(board: Board, cells: list[Cell], tolerance: float) -> list[Cell]:
    """Groups of neighbouring rank exchanged while that puts more matching ones side by side and none of one moment: the best exchange, or the best two of which the first alone doesn't help.

    The first cell and the drop keep theirs; a group goes where it fits, or where there's as much room as before.
    """
    cells = list(cells)
    n = len(cells)
    links = lambda row: sum(row[k].link is not None and row[k].link == row[k + 1].link for k in range(n - 1))
    same = lambda row: sum(board.alike(row[k], row[k + 1]) for k in range(n - 1))

    def allowed(row: list[Group], i: int, j: int) -> bool:
        a, b, to_a, to_b = row[i], row[j], cells[j].beats, cells[i].beats
        return abs(a.rank - b.rank) <= tolerance and (a.need <= to_a or to_a >= to_b) and (b.need <= to_b or to_b >= to_a)

    def exchanged(row: list[Group], i: int, j: int) -> list[Group]:
        row = list(row)
        row[i], row[j] = row[j], row[i]
        return row

    row = [c.group for c in cells]
    movable = [i for i, c in enumerate(cells) if i and not c.drop]
    while n >= 3:
        now, alike = links(row), same(row)
        ones = [exchanged(row, i, j) for i, j in combinations(movable, 2) if allowed(row, i, j)]
        better = [x for x in ones if links(x) > now and same(x) <= alike]
        if not better:
            twos = (exchanged(x, i, j) for x in ones for i, j in combinations(movable, 2) if allowed(x, i, j))
            better = [x for x in twos if links(x) > now and same(x) <= alike]
        if not better:
            break
        row = max(better, key=lambda x: (links(x), -same(x)))
    return [replace(c, group=g) for c, g in zip(cells, row, strict=True)]
