"""One SQL text for Spark and for the comparison engine: a few words are written in capitals with a leading ``@`` and
expanded for each."""

from __future__ import annotations

import re

_SPARK = {
    "QUANTILE": "percentile({0}, {1})",
    "DAYS": "datediff({0}, {1})",
    "MONTH": "date_format({0}, 'yyyy-MM')",
    "SHARE_UP_TO": "size(filter(collect_list({0}) OVER ({1}), x -> x <= {0}))",
    "WEEKDAY": "(weekday({0}) + 1)",
    "PLUS_DAYS": "date_add({0}, {1})",
    "JOIN_SORTED": "array_join(array_sort(collect_list({0})), '|')",
    "DIGITS": "regexp_replace({0}, '[^0-9]', '')",
    "LAST": "last_value({0}, true)",
}
_OTHER = {
    "QUANTILE": "quantile_cont({0}, {1})",
    "DAYS": "date_diff('day', {1}, {0})",
    "MONTH": "strftime({0}, '%Y-%m')",
    "SHARE_UP_TO": "list_count(list_filter(list({0}) OVER ({1}), lambda x: x <= {0}))",
    "WEEKDAY": "isodow({0})",
    "PLUS_DAYS": "CAST({0} + CAST({1} AS INTEGER) AS DATE)",
    "JOIN_SORTED": "array_to_string(list_sort(list({0})), '|')",
    "DIGITS": "regexp_replace({0}, '[^0-9]', '', 'g')",
    "LAST": "last_value({0} IGNORE NULLS)",
}


def _expand(text: str, words: dict[str, str]) -> str:
    while m := re.search(r"@([A-Z_]+)\(", text):
        depth, at, args, start = 1, m.end(), [], m.end()
        while depth:
            c = text[at]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                args.append(text[start:at].strip())
                start = at + 1
            at += 1
        text = text[: m.start()] + words[m[1]].format(*args) + text[at:]
    return text


def spark_sql(text: str) -> str:
    return _expand(text, _SPARK)


def other_sql(text: str) -> str:
    return _expand(text, _OTHER)
