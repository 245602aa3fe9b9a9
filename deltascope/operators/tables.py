"""Tables of HTML filings as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup

CELLS = "table_no int, parent int, row_no int, col_no int, header string, value string"


class _Grid:
    """One table being read: rows of cells with what spans into them from the left and from above."""

    def __init__(self, parent: int):
        self.parent, self.rows, self.row, self.cell = parent, [], None, None
        self.above: dict[int, tuple[int, str]] = {}  # column -> (rows left, text)

    def open_row(self) -> None:
        self.close_row()
        self.row = []

    def open_cell(self, across: int, down: int) -> None:
        if self.row is None:
            self.open_row()
        self.close_cell()
        self.cell = [across, down, ""]

    def close_cell(self) -> None:
        if self.cell is None:
            return
        self._fill()
        across, down, text = self.cell
        for _ in range(across):
            if down > 1:
                self.above[len(self.row)] = (down - 1, text)
            self.row.append(text)
        self.cell = None

    def _fill(self) -> None:
        """Cells that reach down into this row, at the place where it stands."""
        while len(self.row) in self.above:
            at = len(self.row)
            left, text = self.above.pop(at)
            if left > 1:
                self.above[-1 - at] = (left - 1, text)  # for the next row
            self.row.append(text)

    def close_row(self) -> None:
        if self.row is None:
            return
        self.close_cell()
        self._fill()
        for at in sorted(c for c in self.above if c >= len(self.row)):  # cells from above beyond a short row
            self.row += [""] * (at - len(self.row))
            self._fill()
        self.above = {(-1 - c if c < 0 else c): x for c, x in self.above.items()}
        if any(self.row):
            self.rows.append(self.row)
        self.row = None


def _span(attrs: dict, name: str) -> int:
    value = (attrs.get(name) or "1").strip()
    return min(1000, max(1, int(value))) if value.isascii() and value.isdigit() else 1


class _Reader(markup.Reader):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[_Grid] = []
        self.open: list[int] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            if self.open and self.done[self.open[-1]].cell is not None:
                self.done[self.open[-1]].cell[2] += " [TABLE] "
            self.done.append(_Grid(self.open[-1] if self.open else -1))
            self.open.append(len(self.done) - 1)
        elif self.open:
            grid = self.done[self.open[-1]]
            if tag == "tr":
                grid.open_row()
            elif tag in ("td", "th"):
                own = dict(attrs) if attrs else None
                grid.open_cell(_span(own, "colspan") if own else 1, _span(own, "rowspan") if own else 1)
            elif tag in ("br", "p", "div", "li") and grid.cell is not None:
                grid.cell[2] += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open:
            grid = self.done[self.open[-1]]
            if tag == "table":
                grid.close_row()
                self.open.pop()
            elif tag == "tr":
                grid.close_row()
            elif tag in ("td", "th"):
                self._tidy(grid)
                grid.close_cell()

    def handle_data(self, data):
        if self.open and not self.hidden and self.done[self.open[-1]].cell is not None:
            self.done[self.open[-1]].cell[2] += data

    @staticmethod
    def _tidy(grid: _Grid) -> None:
        if grid.cell is not None:
            grid.cell[2] = " ".join(grid.cell[2].split())


def tables_of(page: str | None) -> list[dict]:
    """Every table of a page in order of its start: parent (number of the table around it, -1 for none), headers (its first row
    that is not empty) and rows. A cell that spans columns or rows stands in each of them; a nested table leaves ``[TABLE]``
    in the cell around it. Tables without any text are left out."""
    reader = _Reader()
    reader.read(page or "")
    for at in reversed(reader.open):
        reader._tidy(reader.done[at])
        reader.done[at].close_row()
    tidy = [[[" ".join(c.split()) for c in row] for row in grid.rows] for grid in reader.done]
    kept = {i: k for k, i in enumerate(i for i, rows in enumerate(tidy) if rows)}
    return [{"parent": kept.get(reader.done[i].parent, -1), "headers": tidy[i][0], "rows": tidy[i][1:]} for i in kept]


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, parent, row_no, col_no, header, value) of every cell below the headers of every table of ``pages``; row by
    row, no shuffle. Rows longer than the headers have a null header there. A null page, or one without tables, gives none."""

    names = [f.split()[0] for f in CELLS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out = [(i, t, x["parent"], r, c, x["headers"][c] if c < len(x["headers"]) else None, v)
                       for i, page in enumerate(part.column(1).to_pylist()) for t, x in enumerate(tables_of(page)) for r, row in enumerate(x["rows"]) for c, v in enumerate(row)]
                if out:
                    own, *columns = zip(*out)
                    types = [pa.int32()] * 4 + [pa.string()] * 2
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int32())), *map(pa.array, columns, types)], [key, *names])

    return pages.select(key, F.col(html).alias("html")).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {CELLS}")
