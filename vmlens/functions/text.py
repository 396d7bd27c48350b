"""Formatting and parsing of log lines, properties and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import int_div


def format_properties(properties: Column) -> Column:
    """"k = v, k = v" in key order; empty for no properties."""
    entries = F.array_sort(F.map_entries(F.coalesce(properties, F.from_json(F.lit("{}"), "map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), ", ")


def log_line(template: str, tokens: dict[str, Column]) -> Column:
    """A template with {token}; {{ and }} stand for braces. Unmatched braces and unknown tokens are errors."""
    parts: list[Column] = []
    for piece in re.findall(r"\{\{|\}\}|\{[^{}]*\}|[{}]|[^{}]+", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece in ("{", "}"):
            raise ValueError(f"unmatched {piece} in {template!r}")
        elif piece[0] == "{":
            if piece[1:-1] not in tokens:
                raise ValueError(f"unknown token {piece}")
            parts.append(F.coalesce(tokens[piece[1:-1]].cast("string"), F.lit("")))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def parse_enum(text: Column, names: dict[str, str], ignore_case: bool = True) -> Column:
    """The value of a name, or null."""
    t, out = (F.lower(text) if ignore_case else text), F.lit(None).cast("string")
    for name, value in names.items():
        out = F.when(t == (name.lower() if ignore_case else name), value).otherwise(out)
    return out


MIB = 1 << 20


def migration_line(iteration: Column, current: Column, total: Column, bandwidth: Column, transfer_s: Column, overhead_ms: Column, downtime_ms: Column, elapsed_s: Column, average: Column) -> Column:
    """The one-line status of a migration; MiB are rounded up."""
    mib = lambda b: int_div(b + MIB - 1, F.lit(MIB))
    return F.format_string(
        "iter=%d curr=%dMiB total=%dMiB bw=%.2fMiB/s transfer=%.2fs overhead=%dms est_downtime=%dms elapsed=%.2fs avg_bw=%.2fMiB/s",
        iteration, mib(current), mib(total), bandwidth / MIB, transfer_s, overhead_ms, F.coalesce(downtime_ms, F.lit(0)), elapsed_s, average / MIB,
    )


def downtime_line(effective_ms: Column, final_ms: Column, state_ms: Column, send_ms: Column, complete_ms: Column) -> Column:
    return F.format_string("%dms (final_iter:%dms state:%dms send_state:%dms complete:%dms)", effective_ms, final_ms, state_ms, send_ms, complete_ms)


def next_name(prefix: str, used: Column, count: Column) -> Column:
    """prefix + the first number from `count` on that is not in `used` (array of names); one of size(used) + 1 is free."""
    numbers = F.sequence(count, count + F.size(used))
    return F.filter(F.transform(numbers, lambda n: F.concat(F.lit(prefix), n.cast("string"))), lambda x: ~F.array_contains(used, x))[0]


def keep_tail(buffer: Column, most: int = 1 << 20) -> Column:
    """The last `most` bytes of a binary."""
    return F.when(F.octet_length(buffer) > most, F.substring(buffer, F.octet_length(buffer) - most + 1, F.lit(most))).otherwise(buffer)
