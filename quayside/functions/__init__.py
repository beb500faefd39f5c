"""Column builders. Everything here is a composition of built-in Spark expressions."""

from quayside.functions.identity import business_key, event_id
from quayside.functions.jsonmap import flat_string_maps, string_maps, whole_values
from quayside.functions.numbers import clean_number, is_number, number_text, number_value, packed_number
from quayside.functions.once import evaluate_once
from quayside.functions.text import filled_only, first_present, is_blank, is_filled, strip
from quayside.functions.times import parse_timestamp, wire_time
from quayside.functions.vessels import imo_is_valid

__all__ = [
    "business_key",
    "clean_number",
    "event_id",
    "evaluate_once",
    "filled_only",
    "first_present",
    "flat_string_maps",
    "imo_is_valid",
    "is_blank",
    "is_filled",
    "is_number",
    "number_text",
    "number_value",
    "packed_number",
    "parse_timestamp",
    "string_maps",
    "strip",
    "whole_values",
    "wire_time",
]
