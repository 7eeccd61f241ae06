"""A streaming source of numbered pages with a cursor, limited to a span of days.

Pages lie in a folder as ``page-N.json`` lines (numero, giorno, and the record). The cursor is the last page read; a page is read once it is
complete, in order, and never again after a restart from a checkpoint. Records outside the days asked for are left out; without an end, days up
to ``margine`` after the day given as ``oggi`` are taken.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

LAYOUT = "pagina int, numero string, giorno string, record string"


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("pagine", "1000"))
        today = options.get("oggi")
        self.low = options.get("dal") or (f"{today[:4]}-01-01" if today else "")
        self.high = options.get("al") or ((date.fromisoformat(today) + timedelta(days=int(options.get("margine", "60")))).isoformat() if today else "9999")

    def initialOffset(self) -> dict:
        return {"pagina": 0}

    def _page(self, n: int) -> list[tuple]:
        with open(os.path.join(self.path, f"page-{n}.json"), encoding="utf-8") as f:
            rows = [json.loads(line) for line in f if line.strip()]
        return [(n, r.get("numero"), r.get("giorno"), json.dumps(r, ensure_ascii=False, sort_keys=True)) for r in rows if r.get("giorno") and self.low <= r["giorno"] <= self.high]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The pages after the cursor, as long as the next is there and no more than ``pagine`` of them."""
        rows, n = [], start["pagina"]
        while n - start["pagina"] < self.most and os.path.exists(os.path.join(self.path, f"page-{n + 1}.json")):
            n += 1
            rows += self._page(n)
        return iter(rows), {"pagina": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for n in range(start["pagina"] + 1, end["pagina"] + 1):
            yield from self._page(n)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.readStream.format("paged").option("path", folder).option("oggi", day)``"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return LAYOUT

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
