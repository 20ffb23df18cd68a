"""Checked settings of sources, sorts, searches and Base64 decoding."""

from __future__ import annotations

from dataclasses import dataclass, field

PAGE_ROWS = 100_000
PAGE_SORT_ROWS = 250_000
SELECTION_ROWS = 200_000
TOP_K_ROWS = 200_000
HIT_ROWS = 5_000
PREVIEW_BYTES = 600
LEGACY_PAGE_ROWS = 500
KEY_BYTES = 1_048_576
RECORD_BYTES = 64 << 20


class SourceError(ValueError):
    """A file that can't be read as records, or a setting that makes no sense."""


@dataclass(frozen=True)
class SourceSpec:
    """How the bytes of a file, or of many files in a row, become records.

    parts: (path, data start, data end) of each file where there are many.
    """

    path: str
    kind: str
    size: int
    encoding: str = "utf-8"
    data_start: int = 0
    data_end: int = 0
    columns: tuple[str, ...] = ()
    delimiter: str = ","
    quoted: bool = False
    header: bool = False
    tag: str | None = None
    declared: int | None = None
    mean_bytes: float = 0.0
    samples: tuple[tuple[str, ...], ...] = ()
    modified: float = 0.0
    parts: tuple[tuple[str, int, int], ...] = ()

    def regions(self) -> tuple[tuple[str, int, int], ...]:
        return self.parts or ((self.path, self.data_start, self.data_end),)

    def estimate(self) -> int:
        """Number of records: as declared, else by the mean length in the sample."""
        if self.declared is not None:
            return self.declared
        size = sum(end - start for _, start, end in self.regions())
        return max(1, round(size / self.mean_bytes)) if self.mean_bytes else 0


@dataclass(frozen=True)
class SortSpec:
    key: str
    descending: bool = False
    kind: str = "text"

    def __post_init__(self):
        if self.kind not in ("text", "number"):
            raise ValueError(f"unknown kind of key: {self.kind}")


@dataclass(frozen=True)
class SearchSpec:
    query: str
    case: bool = False
    regex: bool = False
    limit: int = HIT_ROWS

    def __post_init__(self):
        if not self.regex:
            object.__setattr__(self, "query", self.query.replace("\r", " ").replace("\n", " "))
        if not self.query:
            raise ValueError("the query is empty")
        if self.limit < 1:
            raise ValueError("the limit must be positive")


@dataclass(frozen=True)
class B64Spec:
    """Which cells hold a payload and what to take off before it is decoded."""

    columns: tuple[int, ...]
    prefix: str = ""
    prefix_mode: str = "none"  # none, start, marker
    last_marker: bool = False
    suffix: str = ""
    per_part: bool = False
    strip_space: bool = True
    url: bool = False
    encodings: tuple[str, ...] = field(default=("utf-8", "cp1254", "latin-1"))

    def __post_init__(self):
        if not self.columns:
            raise ValueError("at least one column is needed")
        if self.prefix_mode not in ("none", "start", "marker"):
            raise ValueError(f"unknown prefix mode: {self.prefix_mode}")
        if self.prefix_mode == "marker" and not self.prefix:
            raise ValueError("the marker is empty")
