"""Playbooks: named steps over chosen tables and columns, checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import profile, rules
from plumbline.operators.filters import typed_literal
from plumbline.operators.timeline import neighbours
from plumbline.sources.environment import Env

Step = Callable[[Env, Mapping[str, str]], DataFrame]


@dataclass(frozen=True)
class Playbook:
    """``parameters`` maps a name to its kind: table, value, or column:<table parameter>."""

    name: str
    parameters: dict[str, str]
    steps: dict[str, Step]


def problems(env: Env, playbook: Playbook, values: Mapping[str, str]) -> list[str]:
    """What has to be put right before the playbook can run."""
    out = []
    for name, kind in playbook.parameters.items():
        value = values.get(name)
        if value in (None, ""):
            out.append(f"no value for {name}")
        elif kind == "table" and value not in env.tables:
            out.append(f"no table {value}")
        elif kind.startswith("column:"):
            table = values.get(kind.split(":", 1)[1])
            if table in env.tables and value not in env.table(table).columns:
                out.append(f"no column {value} in {table}")
    return out + [f"unknown parameter {n}" for n in values if n not in playbook.parameters]


def run_playbook(env: Env, playbook: Playbook, values: Mapping[str, str]) -> dict[str, DataFrame]:
    found = problems(env, playbook, values)
    if found:
        raise ValueError("; ".join(found))
    return {title: step(env, values) for title, step in playbook.steps.items()}


def _match(env: Env, v: Mapping[str, str]) -> DataFrame:
    df = env.safe_table(v["table"])
    return df.filter(F.col(f"`{v['column']}`") == typed_literal(v["value"], df.schema[v["column"]].dataType)).limit(20)


def _around(env: Env, v: Mapping[str, str]) -> DataFrame:
    df = env.safe_table(v["table"])
    return neighbours(df, v["column"], typed_literal(v["value"], df.schema[v["column"]].dataType), v["order_column"])


def _child_parent(env: Env, v: Mapping[str, str]):
    return env.table(v["child_table"]), v["child_column"], env.table(v["parent_table"]), v["parent_column"]


TABLE_COLUMN = {"table": "table", "column": "column:table"}
TEMPLATES = {
    "duplicates": Playbook("Duplicate values in a column", TABLE_COLUMN, {
        "How many values are duplicated": lambda e, v: profile.duplicates(e.table(v["table"]), [v["column"]]),
        "Most repeated values": lambda e, v: profile.most_repeated(e.table(v["table"]), [v["column"]]),
    }),
    "orphans": Playbook(
        "Rows whose parent is missing",
        {"child_table": "table", "child_column": "column:child_table", "parent_table": "table", "parent_column": "column:parent_table"},
        {
            "Count orphans": lambda e, v: rules.orphan_total(*_child_parent(e, v)),
            "Orphan values": lambda e, v: rules.orphan_values(*_child_parent(e, v)),
        },
    ),
    "missing_values": Playbook("Missing required values", TABLE_COLUMN, {
        "How many rows are missing the value": lambda e, v: profile.missing_values(e.table(v["table"]), v["column"]),
    }),
    "status_breakdown": Playbook("Status breakdown", TABLE_COLUMN, {
        "Rows per value": lambda e, v: profile.status_breakdown(e.table(v["table"]), v["column"]),
    }),
    "record_by_value": Playbook(
        "One record and its recent neighbours", {**TABLE_COLUMN, "value": "value", "order_column": "column:table"},
        {"The record": _match, "Rows just before and after": _around},
    ),
}
