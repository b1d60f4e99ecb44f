from recordloom.functions.conditions import (
    ConditionError,
    check_condition,
    condition,
    describe_condition,
)
from recordloom.functions.text import (
    WHITESPACE,
    accepted,
    is_blank,
    is_empty,
    map_values,
    parse_date,
    to_number,
    trim_text,
)

__all__ = [
    "ConditionError",
    "WHITESPACE",
    "accepted",
    "check_condition",
    "condition",
    "describe_condition",
    "is_blank",
    "is_empty",
    "map_values",
    "parse_date",
    "to_number",
    "trim_text",
]
