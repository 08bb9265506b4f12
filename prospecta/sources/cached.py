"""Loaders that remember what they gave, as long as the store is the same.

Every key begins with the store's token, which changes with any of its tables, so a new version is seen at once; what reads
beyond the store also expires. Remembered tables are kept by the executors and let go when they are replaced.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from prospecta.sources.store import Loaded, Store, load_store_first

#: Fixed value: seconds that a search stays; it may have been topped up from the site.
SEARCH_SECONDS = 1800


@dataclass
class Cached:
    """Searches, the registry, lookups and exports of one store."""

    store: Store
    clock: Callable[[], float] = time.monotonic
    _held: dict[Hashable, tuple[object, float, tuple]] = field(default_factory=dict)

    def _once(self, name: Hashable, make: Callable[[], object], seconds: float | None = None) -> object:
        token, now = self.store.token(), self.clock()
        for key, (value, made, of) in list(self._held.items()):
            if of != token or (key == name and seconds is not None and now - made >= seconds):
                self._held.pop(key)
                for table in (value.events, value.statuses) if isinstance(value, Loaded) else (value,):
                    if isinstance(table, DataFrame):
                        table.unpersist()
        if name not in self._held:
            self._held[name] = (make(), now, token)
        return self._held[name][0]

    def search(self, start: dt.date, end: dt.date, ciks: list[str], live: Callable | None = None) -> Loaded:
        """As load_store_first, remembered for SEARCH_SECONDS: the site is asked once in that time."""

        def make() -> Loaded:
            found = load_store_first(self.store, start, end, ciks, live)
            return Loaded(found.events.persist(), found.statuses.persist(), found.notices)

        return self._once(("search", start, end, tuple(ciks), live is not None), make, SEARCH_SECONDS)

    def registry(self) -> DataFrame:
        return self._once("registry", lambda: self.store.table("registry").persist())

    def series(self, series_id: str, lookup: Callable[[str], dict]) -> dict:
        """What one lookup said of a series, failures too."""
        return self._once(("series", series_id), lambda: lookup(series_id))

    def export(self, name: str, key: Hashable, write: Callable[[str], bool]) -> str | None:
        """The folder of an export, written once for each version and key; None if there was nothing to write."""

        def make() -> str | None:
            path = f"{self.store.path}/exports/{name}-{'-'.join(map(str, self.store.token()))}-{key}-{time.time_ns()}"
            return path if write(path) else None

        return self._once(("export", name, key), make)
