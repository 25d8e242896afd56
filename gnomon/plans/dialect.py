"""One SQL text for two engines: calls written @name(args) are spelled for each."""

from __future__ import annotations

import re
from collections.abc import Callable

from gnomon.sources.model import AS_OF, EVENT_NOW, RELATIONS

SPARK: dict[str, Callable[..., str]] = {
    "ago": lambda n: f"(TIMESTAMP '{AS_OF}' - make_dt_interval(CAST({n} AS INT), 0, 0, 0))",
    "event_ago": lambda n: f"(TIMESTAMP '{EVENT_NOW}' - make_dt_interval(CAST({n} AS INT), 0, 0, 0))",
    "now": lambda: f"TIMESTAMP '{AS_OF}'",
    "event_now": lambda: f"TIMESTAMP '{EVENT_NOW}'",
    "minutes": lambda n: f"make_dt_interval(0, 0, CAST({n} AS INT), 0)",
    "days": lambda n: f"make_dt_interval(CAST({n} AS INT), 0, 0, 0)",
    "seconds": lambda n: f"make_dt_interval(0, 0, 0, {n})",
    "doy": lambda d: f"dayofyear({d})",
    "months": lambda n: f"make_ym_interval(0, CAST({n} AS INT))",
    "epoch": lambda t: f"CAST(unix_timestamp({t}) AS BIGINT)",
    "local": lambda t, z: f"from_utc_timestamp({t}, {z})",
    "utc": lambda t, z: f"to_utc_timestamp({t}, {z})",
    "dow": lambda d: f"CAST(dayofweek({d}) - 1 AS INT)",
    "at": lambda d, h, m: f"make_timestamp(year({d}), month({d}), day({d}), {h}, {m}, 0)",
    "matches": lambda s, p: f"({s} RLIKE {p})",
    "replace_all": lambda s, p, r: f"regexp_replace({s}, {p}, {r})",
    "extract_all": lambda s, p: f"regexp_extract_all({s}, {p}, 0)",
    "extract_group": lambda s, p: f"regexp_extract_all({s}, {p}, 1)",
    "sha256": lambda s: f"sha2({s}, 256)",
    "size": lambda a: f"CAST(coalesce(size({a}), 0) AS BIGINT)",
    "split": lambda s, p: f"split({s}, {p}, -1)",
    "explode": lambda a: f"explode({a})",
    "sorted": lambda a: f"array_sort({a})",
    "join": lambda a, s: f"array_join({a}, {s})",
    "has": lambda a, x: f"array_contains({a}, {x})",
    "json": lambda s, p: f"get_json_object({s}, {p})",
    "len": lambda s: f"CAST(length({s}) AS BIGINT)",
    "time12": lambda t: f"date_format({t}, 'h:mm a')",
    "ordinal": lambda x, names: f"array_position(array({names}), {x})",
    "range": lambda a, b: f"sequence({a}, {b})",
    "list": lambda *x: f"array({', '.join(x)})",
    "get": lambda a, k: f"element_at({a}, CAST({k} AS INT))",
    "upto": lambda n: f"CASE WHEN {n} > 0 THEN sequence(1, CAST({n} AS INT)) ELSE array() END",
    "strip": lambda s: f"trim(BOTH concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)) FROM {s})",
    "first": lambda: "'$1'",
    "filter": lambda a, x, c: f"filter({a}, {x} -> {c})",
    "sum_of": lambda a: f"aggregate({a}, CAST(0 AS DOUBLE), (t, x) -> t + CAST(x AS DOUBLE))",
    "fixed2": lambda x: f"format_string('%.2f', {x})",
    "collect_pairs": lambda k, v: f"collect_list(struct({k} AS k, {v} AS v))",
    "sorted_pairs": lambda a: f"transform(array_sort({a}), x -> x.v)",
    "transform": lambda a, x, e: f"transform({a}, {x} -> {e})",
    "struct": lambda *x: f"named_struct({', '.join(f"'{n}', {e}" for n, e in zip(x[::2], x[1::2], strict=True))})",
    # a walk over a list of structs; the state is a struct of the same fields
    "walk": lambda a, start, s, x, e: f"aggregate({a}, {start}, ({s}, {x}) -> {e})",
    "chars": lambda t: f"transform(CASE WHEN length({t}) > 0 THEN sequence(1, length({t})) ELSE array() END, i -> substring({t}, i, 1))",
    # path segments without . and .., as a stack
    "folded": lambda a: f"aggregate({a}, CAST(array() AS ARRAY<STRING>), (s, x) -> CASE WHEN x IN ('..', '.') THEN CASE WHEN x = '..' AND size(s) > 0 THEN slice(s, 1, size(s) - 1) ELSE s END ELSE concat(s, array(x)) END)",
    "last": lambda a: f"element_at({a}, -1)",
    "rest": lambda a: f"slice({a}, 2, greatest(size({a}) - 1, 0))",
    "floor_div": lambda a, b: f"(({a}) DIV ({b}))",
    "labels": lambda s: f"split({s}, '[.]', -1)",
    "tail": lambda a, k: f"slice({a}, CAST(size({a}) - ({k}) + 1 AS INT), CAST({k} AS INT))",
    "max_by": lambda x, y: f"max_by({x}, {y})",
    "collect_sorted": lambda x: f"array_sort(collect_list({x}))",
}
DUCK: dict[str, Callable[..., str]] = SPARK | {
    "ago": lambda n: f"(TIMESTAMP '{AS_OF}' - to_days(CAST({n} AS INT)))",
    "event_ago": lambda n: f"(TIMESTAMP '{EVENT_NOW}' - to_days(CAST({n} AS INT)))",
    "minutes": lambda n: f"to_minutes(CAST({n} AS INT))",
    "days": lambda n: f"to_days(CAST({n} AS INT))",
    "seconds": lambda n: f"to_seconds({n})",
    "months": lambda n: f"to_months(CAST({n} AS INT))",
    "epoch": lambda t: f"CAST(floor(epoch({t})) AS BIGINT)",
    "local": lambda t, z: f"timezone({z}, timezone('UTC', {t}))",
    "utc": lambda t, z: f"timezone('UTC', timezone({z}, {t}))",
    "dow": lambda d: f"CAST(dayofweek({d}) AS INT)",
    "at": lambda d, h, m: f"make_timestamp(year({d}), month({d}), day({d}), {h}, {m}, 0)",
    "matches": lambda s, p: f"regexp_matches({s}, {p})",
    "replace_all": lambda s, p, r: f"regexp_replace({s}, {p}, {r}, 'g')",
    "extract_all": lambda s, p: f"regexp_extract_all({s}, {p})",
    "extract_group": lambda s, p: f"regexp_extract_all({s}, {p}, 1)",
    "sha256": lambda s: f"sha256({s})",
    "size": lambda a: f"CAST(coalesce(len({a}), 0) AS BIGINT)",
    "split": lambda s, p: f"string_split({s}, {p})",
    "explode": lambda a: f"unnest({a})",
    "sorted": lambda a: f"list_sort({a})",
    "join": lambda a, s: f"array_to_string({a}, {s})",
    "has": lambda a, x: f"list_contains({a}, {x})",
    "json": lambda s, p: f"json_extract_string({s}, {p})",
    "time12": lambda t: f"strftime({t}, '%-I:%M %p')",
    "ordinal": lambda x, names: f"list_position([{names}], {x})",
    "range": lambda a, b: f"generate_series({a}, {b})",
    "list": lambda *x: f"[{', '.join(x)}]",
    "get": lambda a, k: f"list_extract({a}, {k})",
    "upto": lambda n: f"range(1, CAST({n} AS BIGINT) + 1)",
    "strip": lambda s: f"trim({s}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))",
    "first": lambda: "'\\1'",
    "filter": lambda a, x, c: f"list_filter({a}, lambda {x}: {c})",
    "sum_of": lambda a: f"list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE)))",
    "fixed2": lambda x: f"printf('%.2f', {x})",
    "collect_pairs": lambda k, v: f"list(struct_pack(k := {k}, v := {v}))",
    "sorted_pairs": lambda a: f"list_transform(list_sort({a}), lambda x: x.v)",
    "transform": lambda a, x, e: f"list_transform({a}, lambda {x}: {e})",
    "struct": lambda *x: f"struct_pack({', '.join(f"{n} := {e}" for n, e in zip(x[::2], x[1::2], strict=True))})",
    "walk": lambda a, start, s, x, e: f"list_reduce({a}, lambda {s}, {x}: {e}, {start})",
    "chars": lambda t: f"list_transform(range(1, length({t}) + 1), lambda i: substring({t}, i, 1))",
    "folded": lambda a: f"list_reduce(list_transform({a}, lambda y: [y]), lambda s, x: CASE WHEN x[1] IN ('..', '.') THEN CASE WHEN x[1] = '..' AND len(s) > 0 THEN s[1:len(s) - 1] ELSE s END ELSE list_concat(s, x) END, CAST([] AS VARCHAR[]))",
    "last": lambda a: f"list_extract({a}, -1)",
    "labels": lambda s: f"string_split({s}, '.')",
    "tail": lambda a, k: f"({a})[len({a}) - ({k}) + 1:]",
    "rest": lambda a: f"({a})[2:]",
    "floor_div": lambda a, b: f"(({a}) // ({b}))",
    "collect_sorted": lambda x: f"list_sort(list({x}))",
}
_CALL = re.compile(r"@([a-z_0-9]+)\(")


def _split(args: str) -> list[str]:
    out, depth, quoted, last = [], 0, False, 0
    for k, c in enumerate(args):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += c in "(["
            depth -= c in ")]"
            if c == "," and not depth:
                out.append(args[last:k])
                last = k + 1
    return [x.strip() for x in [*out, args[last:]] if x.strip()]


def _spell(text: str, calls: dict[str, Callable[..., str]]) -> str:
    while m := _CALL.search(text):
        depth, quoted, k = 1, False, m.end()
        while depth:
            c = text[k]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
            k += 1
        args = text[m.end() : k - 1]
        if m[1] == "ordinal":
            x, rest = _split(args)[0], args[args.index(",") + 1 :]
            text = text[: m.start()] + calls[m[1]](x, rest) + text[k:]
        else:
            text = text[: m.start()] + calls[m[1]](*_split(args)) + text[k:]
    return text


def with_relations(text: str) -> str:
    """Prefix a query with the relations it names."""
    used: list[str] = []

    def need(body: str) -> None:
        for name, sql in RELATIONS.items():
            if name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
                need(sql)
                used.append(name)

    need(text)
    ctes = ", ".join(f"{n} AS ({RELATIONS[n].strip()})" for n in used)
    if not ctes:
        return text
    text = text.strip()
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {text[15:]}"
    return f"WITH {ctes}, {text[5:]}" if text.startswith("WITH ") else f"WITH {ctes} {text}"


def spark_sql(text: str) -> str:
    # Spark reads backslashes in literals as escapes unless told otherwise
    return _spell(text, SPARK).replace("\\", "\\\\")


def duck_sql(text: str) -> str:
    return _spell(text, DUCK)
