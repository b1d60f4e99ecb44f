"""Rule objects from plain mappings, such as a loaded configuration document."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from recordloom.functions.conditions import check_condition
from recordloom.rules import (
    ChangeRule,
    CleanRule,
    ColumnRule,
    ConsolidationRule,
    ImportRule,
    MatchRule,
    MergeRecords,
    NoMatch,
    OutputColumn,
)


def import_rules(document: Mapping[str, Any]) -> dict[str, ImportRule]:
    """Rules of every source, in declaration order."""
    words = tuple(w for w in document.get("global_settings", {}).get("empty_values", ()) if w)
    return {name: _import(name, s, words) for name, s in document["sources"].items()}


def consolidation_rule(
    document: Mapping[str, Any], imports: Mapping[str, ImportRule],
    parameters: Mapping[str, Any] | None = None,
) -> ConsolidationRule:
    dataset = document["target_dataset"]
    merge = dataset["merge_rules"]
    words = next((r.empty_words for r in imports.values()), ())
    return ConsolidationRule(
        base_source=merge["base_source"]["source"],
        base_key=_list(merge["base_source"]["key"])[0],
        result_identity=tuple(merge["result_identity"]["fields"]),
        separator=merge["result_identity"].get("separator", "::"),
        sources=tuple(_match(n, s, imports[n]) for n, s in merge["sources"].items()),
        columns=tuple(_output(n, c) for n, c in dataset["fields"].items()),
        parameters=dict(parameters or {}),
        empty_words=words,
    )


def change_rule(document: Mapping[str, Any]) -> ChangeRule:
    """The comparison rule carried by the description and action columns."""
    dataset = document["target_dataset"]
    fields = dataset["fields"]
    described = _by_transform(fields, "change_description")
    acting = _by_transform(fields, "record_action")
    text = fields[described]["transform"] if described else {}
    action = fields[acting]["transform"] if acting else {}
    other = text.get("on_other_change", {})
    compare = text.get("compare_fields", "all")
    return ChangeRule(
        identity=tuple(dataset["duplicate_check"]["identity_fields"]),
        fields=tuple(fields),
        description_field=described,
        action_field=acting,
        compare=tuple(compare) if isinstance(compare, (list, tuple)) else None,
        ignore=tuple(text.get("ignore_fields", ())),
        labels={n: c["chinese_name"] for n, c in fields.items() if c.get("chinese_name")},
        on_new=text.get("on_new_record", ""),
        on_unchanged=text.get("on_no_change", ""),
        mode=other.get("mode", "auto"),
        template=other.get("template", ""),
        separator=other.get("separator", "; "),
        missing_action=other.get("missing_action", "error"),
        action_new=action.get("on_new_record", ""),
        action_stored=action.get("on_stored_record", ""),
    )


def _import(name: str, source: Mapping[str, Any], words: tuple[str, ...]) -> ImportRule:
    layout = source.get("excel", {})
    columns = tuple(
        ColumnRule(
            field=c["db_field"],
            header=c.get("chinese_name", ""),
            presence=c.get("mandatory_status") or "",
            value_map=dict(c.get("value_mapping") or {}),
            accepted=tuple(c.get("accepted_values") or ()),
            required_when=c.get("required_when"),
        )
        for c in source["columns"]
    )
    for c in columns:
        if c.required_when is not None:
            check_condition(c.required_when, [x.field for x in columns], c.field)
    return ImportRule(
        name=name,
        label=source.get("chinese_name") or source.get("display_name") or name,
        columns=columns,
        header_row=layout.get("chinese_header_row", 1),
        data_row=layout.get("data_start_row", 2),
        replace=source.get("replace_on_import", True),
        empty_words=words,
        clean=_clean(source.get("clean")),
        expiry_field=(source.get("drop_expired") or {}).get("field", ""),
    )


def _clean(block: Mapping[str, Any] | None) -> CleanRule | None:
    if not block:
        return None
    dedupe = block.get("dedupe", {})
    return CleanRule(
        group_by=tuple(block["group_by"]), dedupe_by=tuple(dedupe["by"]),
        latest_by=dedupe["latest_by"], drop=tuple(block.get("drop", ())),
        unique=tuple(block.get("unique", ())), conflict=block.get("conflict") or "latest",
        join_comma=tuple(block.get("join_comma", ())),
        join_backslash=tuple(block.get("join_backslash", ())),
    )


def _match(name: str, source: Mapping[str, Any], rule: ImportRule) -> MatchRule:
    """The first match field by name counts; composite keys are not supported."""
    repeated = source.get("duplicates", {})
    missing = source.get("no_match")
    merge = source.get("merge_records")
    policy = "different_content" if source["cardinality"] == "one_to_many" else "different_value"
    return MatchRule(
        name=name,
        match=source["match"][sorted(source["match"])[0]],
        cardinality=source["cardinality"],
        label=rule.label,
        expand_by=tuple(_list(source.get("expand_by"))),
        no_match=None if missing is None else NoMatch(missing.get("action", ""), missing.get("value") or ""),
        compare_by=tuple(_list(repeated.get("compare_by"))),
        conflicts=repeated.get(policy) == "conflict",
        selected=repeated.get("selected_record") or "first",
        merge=None if merge is None else MergeRecords(
            bool(merge.get("deduplicate")), merge.get("order") or "source"
        ),
        columns=rule.columns,
    )


def _output(name: str, column: Mapping[str, Any]) -> OutputColumn:
    source = column.get("source") or {}
    transform = column.get("transform") or {}
    return OutputColumn(
        name=name,
        presence=column.get("mandatory_status") or "",
        source=source.get("file", ""),
        fields=tuple(_list(source.get("field"))),
        transform=transform.get("type", "direct"),
        separator=transform.get("separator", ""),
        record_separator=transform.get("record_separator", ""),
        value=transform.get("value", ""),
        parameter=source.get("key", ""),
        offset_days=transform.get("offset_days", 0),
        offset_days_from=transform.get("offset_days_from", ""),
    )


def _by_transform(fields: Mapping[str, Any], kind: str) -> str:
    found = [n for n, c in fields.items() if (c.get("transform") or {}).get("type") == kind]
    return found[-1] if found else ""


def _list(value: Any) -> list:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]
