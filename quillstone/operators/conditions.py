"""The condition language: trees of AND and OR over comparisons, as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

OPERATORS = ("equals", "not_equals", "gt", "gte", "lt", "lte", "starts_with", "contains", "in", "not_in")


class ConditionError(ValueError):
    """A condition that cannot be read or does not fit its attribute."""


@dataclass(frozen=True)
class Leaf:
    attribute: str
    operator: str
    value: str


@dataclass(frozen=True)
class Group:
    """All (`and`) or any (`or`) of the children; a group without children matches everything."""

    logic: str
    children: tuple[Leaf | Group, ...]


Condition = Leaf | Group


def split_value(value: str) -> tuple[str, str]:
    """``op:value`` at the first colon; without one the operator is ``equals``."""
    operator, colon, rest = value.partition(":")
    if not colon:
        return "equals", value
    if operator not in OPERATORS:
        raise ConditionError(f"unsupported operator {operator!r}")
    if not rest:
        raise ConditionError(f"{value!r} has no value")
    return operator, rest


def parse(given: str | dict[str, Any] | None) -> Condition | None:
    """A condition from JSON: ``{"l": "and"|"or", "c": [...]}`` or ``{"a": attribute, "v": "op:value"}``."""
    if given is None:
        return None
    node = json.loads(given) if isinstance(given, str) else given
    if not isinstance(node, dict):
        raise ConditionError("a condition is an object")
    if "l" in node or "c" in node:
        if node.get("l") not in ("and", "or"):
            raise ConditionError(f"a group needs the logic 'and' or 'or', not {node.get('l')!r}")
        children = node.get("c") or []
        if not isinstance(children, list):
            raise ConditionError("the children of a group are a list")
        return Group(node["l"], tuple(parse(c) for c in children))  # type: ignore[misc]
    if "a" in node or "v" in node:
        name, value = node.get("a"), node.get("v")
        if not isinstance(name, str) or not name or not isinstance(value, str) or not value:
            raise ConditionError("a comparison needs a non-empty attribute 'a' and value 'v'")
        return Leaf(name, *split_value(value))
    raise ConditionError("a condition has 'l' and 'c', or 'a' and 'v'")


def render(condition: Condition) -> dict[str, Any]:
    """The JSON form of a condition."""
    if isinstance(condition, Leaf):
        return {"a": condition.attribute, "v": f"{condition.operator}:{condition.value}"}
    return {"l": condition.logic, "c": [render(c) for c in condition.children]}


def leaves_of(condition: Condition | None) -> Iterator[Leaf]:
    if isinstance(condition, Leaf):
        yield condition
    elif condition is not None:
        for child in condition.children:
            yield from leaves_of(child)
