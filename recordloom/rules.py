"""Rule objects: the only driver-side data, a few dozen entries each."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

# Result statuses, record kinds and cell placeholders.
READY, INCOMPLETE, DUPLICATE, CONFLICT = "Ready", "Incomplete", "Duplicate", "Conflict"
STATUSES = (READY, INCOMPLETE, DUPLICATE, CONFLICT)
NEW, UNCHANGED, MODIFIED = "new", "unchanged", "modified"
MISSING = "MISSING"

# Name of the row-order column every staged table carries.
ORD = "_ord"


@dataclass(frozen=True)
class ColumnRule:
    """One column of a source: where it comes from and what it must hold."""

    field: str
    header: str = ""
    presence: str = ""
    value_map: Mapping[str, str] = field(default_factory=dict)
    accepted: tuple[str, ...] = ()
    required_when: Any = None


@dataclass(frozen=True)
class CleanRule:
    """How raw rows become one row per group."""

    group_by: tuple[str, ...]
    dedupe_by: tuple[str, ...]
    latest_by: str
    drop: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    conflict: str = "latest"
    join_comma: tuple[str, ...] = ()
    join_backslash: tuple[str, ...] = ()


@dataclass(frozen=True)
class ImportRule:
    """One source: layout, columns, cleaning."""

    name: str
    columns: tuple[ColumnRule, ...]
    label: str = ""
    header_row: int = 1
    data_row: int = 2
    replace: bool = True
    empty_words: tuple[str, ...] = ()
    clean: CleanRule | None = None
    expiry_field: str = ""

    @property
    def fields(self) -> list[str]:
        return [c.field for c in self.columns]

    @property
    def value_maps(self) -> dict[str, Mapping[str, str]]:
        return {c.field: c.value_map for c in self.columns}

    def title(self, name: str) -> str:
        for c in self.columns:
            if c.field == name:
                return f"{c.header}（{name}）"
        return name


@dataclass(frozen=True)
class NoMatch:
    """What happens when a base key has no record in a source."""

    action: str = "emit_incomplete"
    value: str = ""


@dataclass(frozen=True)
class MergeRecords:
    """Keep every record of a key and join them in one cell."""

    deduplicate: bool = False
    order: str = "source"


@dataclass(frozen=True)
class MatchRule:
    """How one source is matched to the base key."""

    name: str
    match: str
    cardinality: str = "one_to_one"
    label: str = ""
    expand_by: tuple[str, ...] = ()
    no_match: NoMatch | None = None
    compare_by: tuple[str, ...] = ()
    conflicts: bool = False
    selected: str = "first"
    merge: MergeRecords | None = None
    columns: tuple[ColumnRule, ...] = ()

    @property
    def title(self) -> str:
        return self.label or self.name


@dataclass(frozen=True)
class OutputColumn:
    """One column of the result layout."""

    name: str
    presence: str = "required"
    source: str = ""
    fields: tuple[str, ...] = ()
    transform: str = "direct"
    separator: str = ""
    record_separator: str = ""
    value: str = ""
    parameter: str = ""
    offset_days: int = 0
    offset_days_from: str = ""

    @property
    def derived(self) -> bool:
        return self.transform in ("change_description", "record_action", "date_offset")


@dataclass(frozen=True)
class ConsolidationRule:
    """Base source, how the others match it, and the result layout."""

    base_source: str
    base_key: str
    result_identity: tuple[str, ...]
    sources: tuple[MatchRule, ...]
    columns: tuple[OutputColumn, ...]
    separator: str = "::"
    parameters: Mapping[str, Any] = field(default_factory=dict)
    empty_words: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def expansion(self) -> MatchRule | None:
        return next((s for s in self.sources if s.cardinality == "one_to_many"), None)

    @property
    def row_placeholder(self) -> str:
        """Placeholder of the expansion source, used by the row checks."""
        source = self.expansion
        return source.no_match.value if source and source.no_match else ""

    @property
    def derived_placeholder(self) -> str:
        """First non-empty placeholder over all sources, used after change detection."""
        values = (s.no_match.value for s in self.sources if s.no_match)
        return next((v for v in values if v), MISSING)


@dataclass(frozen=True)
class ChangeRule:
    """How a result row is compared with the newest stored record."""

    identity: tuple[str, ...]
    fields: tuple[str, ...]
    description_field: str = ""
    action_field: str = ""
    compare: tuple[str, ...] | None = None
    ignore: tuple[str, ...] = ()
    labels: Mapping[str, str] = field(default_factory=dict)
    on_new: str = ""
    on_unchanged: str = ""
    mode: str = "auto"
    template: str = "{column}"
    separator: str = "; "
    missing_action: str = "error"
    action_new: str = "Add"
    action_stored: str = "Modify"
