"""JSON functions over text. Malformed JSON gives NULL."""

from .registry import define

define("json_extract_path_text", "get_json_object({0}, {1})", 2)
define("json_array_get", "case when {1} >= 0 then get_json_object({0}, concat('$[', {1}, ']')) else try_element_at(from_json({0}, 'array<string>'), cast({1} as int)) end", 2)
define("json_array_length", "cast(json_array_length({0}) as bigint)", 1)
define("json_array_contains", "array_contains(from_json({0}, 'array<string>'), cast({1} as string))", 2)
