"""A plant nursery: four small sources, one line of data for each case the tests need."""

from __future__ import annotations

import datetime as dt

from recordloom.settings import change_rule, consolidation_rule, import_rules

RUN_DATE = dt.date(2026, 10, 13)


def column(field, status="optional", **more):
    return {"db_field": field, "chinese_name": field.title(), "mandatory_status": status, **more}


def source(label, *columns):
    return {"chinese_name": label, "columns": [column("plant", "required"), *columns]}


def output(status, file="", field=None, kind="direct", **transform):
    held = {"file": file, "field": field} if file else {}
    return {"mandatory_status": status, "source": held, "transform": {"type": kind, **transform}}


SEVERAL_TRAYS = {"column": "trays", "operator": "greater_than", "value": 1, "value_type": "number"}
IMPORTS = {
    "global_settings": {"empty_values": ["", None, "NA", "N/A", "nan"]},
    "sources": {
        "species": source("Species list", column("title", "required"), column("permit", "required")),
        "lots": source(
            "Sowing book", column("lot", "required"), column("trays", "required"),
            column("shelf", "required_if_applicable", required_when=SEVERAL_TRAYS), column("remark")),
        "growers": source("Growers", column("grower", "required"), column("rank")),
        "zones": source("Zones", column("zone", "required")),
    },
}
BY_PLANT = {"match": {"plant": "plant"}}
MAPPING = {"target_dataset": {
    "duplicate_check": {"identity_fields": ["Name", "Lot"]},
    "merge_rules": {
        "base_source": {"source": "species", "key": ["plant"]},
        "result_identity": {"fields": ["plant", "lot"], "separator": "/"},
        "sources": {
            "species": {"cardinality": "one_to_one", **BY_PLANT},
            "zones": {"cardinality": "one_to_one", **BY_PLANT},
            "growers": {
                "cardinality": "many_to_one", **BY_PLANT, "no_match": {"action": "empty", "value": ""},
                "merge_records": {"deduplicate": True, "order": "source"}},
            "lots": {
                "cardinality": "one_to_many", **BY_PLANT, "expand_by": ["lot"],
                "no_match": {"action": "emit_incomplete", "value": "MISSING"},
                "duplicates": {"compare_by": ["plant", "lot"], "different_content": "conflict"}},
        },
    },
    "fields": {
        "Name": output("required", "species", "plant"),
        "Lot": output("required", "lots", "lot"),
        "Title": output("required", "species", "title"),
        "Permit": output("required", "species", ["permit"], "first_not_null"),
        "Trays": output("required", "lots", "trays"),
        "Shelf": output("required_if_applicable", "lots", "shelf"),
        "Zone": output("required", "zones", "zone"),
        "Growers": output("required_if_applicable", "growers", ["grower"], "concatenate", record_separator=","),
        "Season": {"mandatory_status": "user_defined", "source": {"key": "season"}},
        "Due": output("required", kind="date_offset", offset_days_from="lead"),
        "Action": output("required", kind="record_action", on_new_record="Add", on_stored_record="Modify"),
        "Changes": output(
            "required_if_applicable", kind="change_description", compare_fields="all", ignore_fields=["Action", "Due"],
            on_other_change={"mode": "auto", "template": "new {column}", "separator": "; "}),
        "Spare": output("optional"),
    },
}}
LOG_COLUMNS = ["log_time", "status", *MAPPING["target_dataset"]["fields"], "plant", "operation", "details"]

RULES = import_rules(IMPORTS)
RULE = consolidation_rule(MAPPING, RULES, {"season": "autumn", "lead": 3})
CHANGES = change_rule(MAPPING)

PLANTS = ("fern", "moss", "ivy", "bare")


def rows():
    """Four plants: one lot, two lots, a padded number of trays, and no lot at all."""
    return {
        "species": [(p, p.upper(), f"permit of {p}") for p in PLANTS],
        "lots": [
            ("fern", "spring", "1", "", "x"), ("moss", "spring", "3", "low", "x"), ("moss", "late", "1", "", "x"),
            ("ivy", "07", " 2 ", "high", "x"),
        ],
        "growers": [(p, f"{p} & sons", "1") for p in PLANTS],
        "zones": [(p, "wet") for p in PLANTS],
    }


def tables(table, data):
    return {name: table(" ".join(RULES[name].fields), data[name]) for name in RULES}
