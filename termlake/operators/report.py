"""Results kept and shown: JSON, a text log, plain tables, timings of phases."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame


def save_results(results: DataFrame, path: str) -> None:
    """As JSON lines in a folder, nulls too."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def text_table(rows: Sequence[dict]) -> str:
    """Rows, few of them, in columns of equal width; numbers to the right."""
    if not rows:
        return "(no rows)"
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    names = list(rows[0])
    cells = [names, *[[show(r.get(n)) for n in names] for r in rows]]
    width = [max(len(row[i]) for row in cells) for i in range(len(names))]
    right = [all(isinstance(r.get(n), (int, float, type(None))) for r in rows) for n in names]
    line = lambda row: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(row, width, right)).rstrip()
    return "\n".join([line(cells[0]), "  ".join("-" * w for w in width), *map(line, cells[1:])])


def append_log(path: str, title: str, rows: Sequence[dict]) -> None:
    """A dated entry at the end of a text file on the driver."""
    with open(path, "a", encoding="utf-8") as log:
        log.write(f"== {datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S} UTC  {title}\n{text_table(rows)}\n\n")


class Phases:
    """Seconds of the phases of a run: ``with phases("build"): ...``. A phase that comes again adds up."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def rows(self) -> list[dict]:
        """Longest first, with shares of the total."""
        total = sum(self.seconds.values()) or 1.0
        return [{"phase": k, "seconds": s, "share": s / total} for k, s in sorted(self.seconds.items(), key=lambda x: (-x[1], x[0]))]

    def bottleneck(self) -> str | None:
        return max(self.seconds, key=self.seconds.__getitem__, default=None)
