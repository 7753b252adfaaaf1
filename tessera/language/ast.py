"""Syntax trees.  Every node is a frozen record; queries are expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: Any
    tag: str = ""  # dt, du, uuid, id, geo, b, re or nothing


@dataclass(frozen=True)
class Name(Node):
    name: str  # may hold :: of a path


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class RangeOf(Node):
    start: Node | None
    end: Node | None
    inclusive: bool


@dataclass(frozen=True)
class Template(Node):
    parts: tuple  # str or Node


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple


@dataclass(frozen=True)
class Repeat(Node):
    item: Node
    times: Node


@dataclass(frozen=True)
class Comprehension(Node):
    body: Node
    loops: tuple  # (pattern, source)
    condition: Node | None


@dataclass(frozen=True)
class TupleOf(Node):
    items: tuple


@dataclass(frozen=True)
class ObjectOf(Node):
    fields: tuple  # (name, node); name None is a spread


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple  # names, or tuples of (field, name) for a record pattern
    body: Node


@dataclass(frozen=True)
class If(Node):
    condition: Node
    then: Node
    other: Node | None


@dataclass(frozen=True)
class Match(Node):
    subject: Node
    arms: tuple  # (pattern, guard, value)


@dataclass(frozen=True)
class Block(Node):
    lets: tuple  # (pattern, node)
    result: Node


@dataclass(frozen=True)
class Member(Node):
    base: Node
    name: str
    optional: bool = False


@dataclass(frozen=True)
class Project(Node):
    base: Node
    fields: tuple


@dataclass(frozen=True)
class Call(Node):
    fn: Node
    args: tuple
    named: tuple = ()


@dataclass(frozen=True)
class Method(Node):
    base: Node
    name: str
    args: tuple
    named: tuple = ()


@dataclass(frozen=True)
class BindAt(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Cast(Node):
    base: Node
    type: str


@dataclass(frozen=True)
class IsType(Node):
    base: Node
    type: str


@dataclass(frozen=True)
class Select_(Node):
    """A bracket selector: kind is stars, where, order, slice, index, group,
    distinct, distinct_by or enumerate."""

    base: Node
    kind: str
    arg: Any = None


@dataclass(frozen=True)
class OrderKey(Node):
    expr: Node
    descending: bool = False


@dataclass(frozen=True)
class Modifiers(Node):
    where: Node | None = None
    order: tuple = ()
    range: RangeOf | None = None


@dataclass(frozen=True)
class Head(Node):
    label: str | None
    binder: str | None
    types: tuple  # type names; several are a union
    record: Node | None = None
    mods: Modifiers = field(default_factory=Modifiers)


@dataclass(frozen=True)
class Hop(Node):
    direction: str
    edge: Head | None
    target: Head | None
    hops: RangeOf | None = None


@dataclass(frozen=True)
class Path(Node):
    base: Head
    hops: tuple


@dataclass(frozen=True)
class SelectQuery(Node):
    projection: Node
    roots: tuple
    inner: bool = False
    paths: tuple = ()
    blocks: tuple = ()  # (label, Modifiers)
    where: Node | None = None
    groups: tuple = ()  # (ObjectOf, name)
    order: tuple = ()
    range: RangeOf | None = None


@dataclass(frozen=True)
class Create(Node):
    head: Head
    value: Node
    links: tuple = ()
    conflict: tuple | None = None  # (fields, action) for upsert
    upsert: bool = False
    tail: Node | None = None


@dataclass(frozen=True)
class Update(Node):
    head: Head
    setters: tuple  # (target path, op, node)
    where: Node | None = None
    tail: Node | None = None


@dataclass(frozen=True)
class Delete(Node):
    head: Head
    where: Node | None = None
    tail: Node | None = None


@dataclass(frozen=True)
class LinkQuery(Node):
    links: tuple  # (source Head, direction, edge Head, ObjectOf, target Head)
    tail: Node | None = None


@dataclass(frozen=True)
class UnlinkQuery(Node):
    paths: tuple
    tail: Node | None = None
