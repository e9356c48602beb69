"""HTML tables as rectangular grids."""

from __future__ import annotations

from dataclasses import dataclass

from cellforge.functions.dom import Node

#: The HTML standard's limits for spans; larger ones would only take memory.
MAX_ROWSPAN, MAX_COLSPAN = 65_534, 1_000
#: Positions of one grid: a cell that spans more rows than fit is cut there.
MAX_POSITIONS = 4_000_000


@dataclass(frozen=True)
class Cell:
    """A grid position: its text, the columns that the cell spans, and whether it is the first of them."""

    text: str
    span: int = 1
    lead: bool = True


class Grid:
    """Cells fill the first open position, row by row; positions never open again, so the search goes on from the last one."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.flat: list[Cell | None] = []
        self._next = 0

    @property
    def height(self) -> int:
        return len(self.flat) // self.width

    def row(self, j: int) -> list[Cell | None]:
        return self.flat[j * self.width : (j + 1) * self.width]

    def _grow(self, rows: int) -> None:
        self.flat += [None] * (rows * self.width)

    def place(self, text: str, rows: int = 1, cols: int = 1) -> None:
        while self._next < len(self.flat) and self.flat[self._next] is not None:
            self._next += 1
        at = self._next
        rows = max(1, min(rows, (MAX_POSITIONS - at) // self.width))
        if at == len(self.flat):
            self._grow(rows)
        elif (reach := at / self.width + rows) > self.height:
            # rounding half to even: a cell in the second half of the last row may add a row ahead of need
            self._grow(round(reach) - self.height)
        row, col = divmod(at, self.width)
        cols = min(cols, self.width - col)
        for r in range(row, row + rows):
            for c in range(cols):
                self.flat[r * self.width + col + c] = Cell(text, cols, c == 0)

    def rows(self) -> list[list[Cell | None]]:
        return [self.row(j) for j in range(self.height)]


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.get(name).strip()
    return max(1, min(int(value), most)) if value.isdecimal() else 1


def cell_text(node: Node) -> str:
    """All text below a node, line breaks as newlines."""
    out: list[str] = []
    work: list[Node | str] = [node]
    while work:
        n = work.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "br":
            out.append("\n")
        else:
            work += n.kids[::-1]
    return "".join(out)


def width_of(rows: list[Node], careful: bool) -> int:
    widths = (sum(_span(c, "colspan", MAX_COLSPAN) for c in r.find_all("td", "th")) for r in rows)
    return max(widths, default=0) if careful else next(widths, 0)


def build(table: Node | None, careful: bool = True, ignore_bad_rows: bool = True) -> list[list[Cell | None]] | None:
    """The grid of a table element, or None if it has no rows or cells.

    The columns are counted in the first tbody, or the whole table; all rows of the table are placed. A row's last
    cell takes the columns that the row leaves unaccounted for, if its grid row is the last and has room.
    """
    if table is None:
        return None
    rows = (table.find("tbody") or table).find_all("tr")
    width = width_of(rows, careful)
    if not width:
        return None
    grid = Grid(width)
    for j, r in enumerate(table.find_all("tr")):
        cells, used = r.find_all("td", "th"), 0
        try:
            for c in cells:
                down, across = _span(c, "rowspan", MAX_ROWSPAN), _span(c, "colspan", MAX_COLSPAN)
                used += across
                if c is cells[-1] and used < width and grid.height == j + 1 and grid.row(j).count(None) > across:
                    across += width - used
                grid.place(cell_text(c), down, across)
        except (IndexError, ValueError):
            if not ignore_bad_rows:
                return None
    out = grid.rows()
    if out and all(c is None for c in out[-1]):
        out.pop()
    return out or None
