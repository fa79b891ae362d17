"""Node and relationship types, their properties, and the registry that resolves subtypes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import GraphQueryError


@dataclass(frozen=True)
class Property:
    """Rules of one property; ``search`` includes a string in full-text search."""

    name: str
    key: bool = False
    unique: bool = False
    required: bool = False
    search: bool = True
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    choices: tuple | None = None
    collection: bool = False

    def __post_init__(self):
        if self.collection and (self.key or self.unique):
            raise GraphQueryError(f"property {self.name}: a collection can be neither key nor unique")
        if self.pattern is not None:
            re.compile(self.pattern)


@dataclass(frozen=True)
class NodeType:
    """``where`` makes the type a part of its parent's table instead of one of its own."""

    label: str
    parent: str | None = None
    properties: tuple[Property, ...] = ()
    where: str | None = None
    abstract: bool = False


@dataclass(frozen=True)
class EdgeType:
    type: str
    source: str | None = None
    target: str | None = None
    parent: str | None = None
    properties: tuple[Property, ...] = ()
    where: str | None = None
    abstract: bool = False


@dataclass
class Registry:
    nodes: dict[str, NodeType] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)

    def add(self, *types: NodeType | EdgeType) -> Registry:
        for t in types:
            table, name = (self.nodes, t.label) if isinstance(t, NodeType) else (self.edges, t.type)
            if t.parent is not None and t.parent not in table:
                raise GraphQueryError(f"{name}: unknown parent type {t.parent}")
            table[name] = t
        return self

    def node(self, label: str) -> NodeType:
        if label not in self.nodes:
            raise GraphQueryError(f"unknown node type {label}")
        return self.nodes[label]

    def edge(self, kind: str) -> EdgeType:
        if kind not in self.edges:
            raise GraphQueryError(f"unknown relationship type {kind}")
        return self.edges[kind]

    @staticmethod
    def _below(table: dict, name: str) -> list[str]:
        out = [name]
        for t in table:
            at = table[t].parent
            while at is not None:
                if at == name:
                    out.append(t)
                    break
                at = table[at].parent
        return out

    def compatible_labels(self, label: str) -> list[str]:
        """The type itself and all that derive from it."""
        self.node(label)
        return self._below(self.nodes, label)

    def compatible_types(self, kind: str) -> list[str]:
        self.edge(kind)
        return self._below(self.edges, kind)

    def lineage(self, label: str) -> list[str]:
        """From the root type down to ``label``: the labels that a node of the type carries."""
        out, at = [], label
        while at is not None:
            out.append(at)
            at = self.node(at).parent
        return out[::-1]

    def owner(self, label: str) -> str:
        """The type whose table holds ``label``'s rows."""
        t = self.node(label)
        while t.where is not None:
            t = self.node(t.parent)
        return t.label

    def edge_owner(self, kind: str) -> str:
        t = self.edge(kind)
        while t.where is not None:
            t = self.edge(t.parent)
        return t.type

    def rules(self, table: dict, name: str) -> dict[str, Property]:
        out: dict[str, Property] = {}
        while name is not None:
            t = table[name]
            out = {p.name: p for p in t.properties} | out
            name = t.parent
        return out

    def node_rules(self, label: str) -> dict[str, Property]:
        return self.rules(self.nodes, label)

    def edge_rules(self, kind: str) -> dict[str, Property]:
        return self.rules(self.edges, kind)
