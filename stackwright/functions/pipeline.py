"""Transform pipelines: a list of operations becomes one Column, so Catalyst sees plain expressions.

Each operation turns struct(value, changed) into the next one. An operation that doesn't apply carries the value on;
the pipeline has changed the value if any operation did.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _pattern(pattern: str) -> str:
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back references aren't supported")
    return f"(?U){pattern}"


def _needs(value: str) -> str:
    if not value:
        raise ValueError("an empty text can't be searched")
    return value


def _title_case(v: Column) -> Column:
    return F.array_join(F.transform(F.split(T.collapse(v), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def _prettify(v: Column) -> Column:
    """Without a track number that a separator follows (up to three digits, a disc before it), words in title case.

    Only ASCII letters change case, from a word's first ASCII letter or digit to its last; dotted initials stay.
    """
    bare = F.translate(F.regexp_replace(T.trim(v), r"(?iU)^\s*(?:disc\s*)?\d{1,3}(?:[._ -]+|\s+)", ""), "_-", "  ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"([A-Za-z])(\p{Nd})", "$1 $2"), r"(\p{Nd})([A-Za-z])", "$1 $2")

    def word(w: Column) -> Column:
        part = lambda k: F.regexp_extract(w, r"^([^A-Za-z0-9]*)([A-Za-z0-9])(.*?)([^A-Za-z0-9]*)$", k)
        cased = F.concat(part(1), F.upper(part(2)), T.ascii_lower(part(3)), part(4))
        return F.when(w.rlike(r"^(?:[A-Za-z]\.)+[A-Za-z]?\.?$") | ~w.rlike("[A-Za-z0-9]"), w).otherwise(cased)

    return F.array_join(F.transform(F.split(T.collapse(bare), " "), word), " ")


#: Fixed values are the names. name -> (value, arguments) -> new value, or null where the operation doesn't apply.
OPERATIONS: dict[str, Callable[[Column, dict], Column]] = {
    "regex_replace": lambda v, a: F.regexp_replace(v, _pattern(a["pattern"]), a.get("replacement", "")),
    "regex_extract": lambda v, a: T.extract(v, _pattern(a["pattern"]), a.get("group", 1)),
    "strip_prefix": lambda v, a: F.when(v.startswith(_needs(a["text"])), F.substr(v, F.lit(len(a["text"]) + 1))),
    "strip_suffix": lambda v, a: F.when(v.endswith(_needs(a["text"])), F.substr(v, F.lit(1), F.length(v) - len(a["text"]))),
    "literal_replace": lambda v, a: F.replace(v, F.lit(_needs(a["find"])), F.lit(a.get("replacement", ""))),
    "trim": lambda v, a: T.trim(v),
    "lowercase": lambda v, a: F.lower(v),
    "uppercase": lambda v, a: F.upper(v),
    "title_case": lambda v, a: _title_case(v),
    "prettify": lambda v, a: _prettify(v),
    "split_artists": lambda v, a: F.when(F.size(names := T.distinct_ignoring_case(F.transform(F.split(v, "[&,;，；]"), T.trim))) > 1, F.array_join(names, "; ")),
    "chinese_to_simplified": lambda v, a: T.simplified(v),
    "chinese_to_traditional": lambda v, a: T.traditional(v),
}
#: An operation that changes the value by matching, even where the result is equal.
BY_MATCH = {"regex_extract"}


def pipeline(value: Column, operations: list[tuple[str, dict]]) -> Column:
    """struct(value, changed) after all operations; a null value stays null and unchanged."""
    state = F.struct(value.alias("value"), F.lit(False).alias("changed"))
    for name, arguments in operations:
        # The state is bound once, so that a long pipeline doesn't nest copies of all operations before.
        state = F.get(F.transform(F.array(state), _step(name, arguments)), F.lit(0))
    return state


def _step(name: str, arguments: dict) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        new = OPERATIONS[name](s["value"], arguments)
        fired = new.isNotNull() if name in BY_MATCH else new != s["value"]
        return F.struct(F.coalesce(new, s["value"]).alias("value"), (s["changed"] | F.coalesce(fired, F.lit(False))).alias("changed"))

    return step
