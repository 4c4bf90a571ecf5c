"""The operator-level plan: nodes with traits, validation, rewrites that Catalyst can't know of, and compilation.

Catalyst pushes, prunes and reorders what is relational. What it can't see is which steps cost money and that a model
call may be moved around; that is all this layer adds.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..functions.models import Expressions
from ..functions.templates import Template
from ..operators import chunks, cluster, groups, match, rows, select, web

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "map": rows.map_rows, "parallel_map": rows.parallel_map, "filter": rows.filter_rows, "code_map": rows.code_map, "code_filter": rows.code_filter, "extract_lines": rows.extract_lines, "extract": rows.extract_patterns, "unnest": rows.unnest,
    "unnest_columns": rows.unnest_columns, "add_uuid": rows.add_uuid, "split": chunks.split, "gather": chunks.gather, "reduce": groups.reduce_groups, "code_reduce": groups.code_reduce, "sample": select.sample, "topk": select.topk, "rank": select.rank,
    "equijoin": match.equijoin, "resolve": match.resolve, "link_resolve": match.link_resolve, "cluster": cluster.cluster, "fetch_pages": web.fetch_pages, "web_fetch": web.web_fetch, "web_search": web.web_search,
}


def operator(kind: str):
    """Register an operator of one's own: DataFrame and parameters to DataFrame."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[kind] = f
        return f

    return put


@dataclass(frozen=True)
class Traits:
    """What a rewrite may know of an operator; None: unknown, so nothing moves past it."""

    cardinality: str = "n:m"  # 1:1, sel, 1:n, n:1, n:m
    reads: frozenset[str] | None = None
    writes: frozenset[str] | None = None
    removes: frozenset[str] = frozenset()
    paid: bool = False
    row_local: bool = False
    keeps_order: bool = False


@dataclass(frozen=True)
class Node:
    kind: str
    name: str
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in OPERATORS:
            raise ValueError(f"unknown operator: {self.kind}")

    @property
    def traits(self) -> Traits:
        return _traits(self.kind, self.name, self.params)


def _identifiers(sql) -> frozenset[str] | None:
    """Every name in a SQL expression: more than its columns, never fewer."""
    if not isinstance(sql, str):
        return None
    return frozenset(re.findall(r"[A-Za-z_]\w*", re.sub(r"'(?:[^'\\]|\\.)*'", "", sql)))


def _template_reads(p: dict) -> frozenset[str] | None:
    model = p.get("model")
    if isinstance(model, Expressions):
        found = [_identifiers(s) for s in [*model.outputs.values(), *p.get("validate", ())]]
        return None if None in found else frozenset().union(*found)
    return Template(p["prompt"]).reads if p.get("prompt") else frozenset()


def _traits(kind: str, name: str, p: dict) -> Traits:
    writes = frozenset(p.get("output", ()) if isinstance(p.get("output"), dict) else ())
    paid = "model" in p and not isinstance(p["model"], Expressions)
    dropped = frozenset(p.get("drop_keys", ()))
    if kind == "map":
        plain = p.get("keep_failed") and p.get("limit") is None
        return Traits("1:1" if plain or not writes else "n:m" if p.get("limit") is not None else "1:1", _template_reads(p), writes | dropped, dropped, paid, p.get("limit") is None, True)
    if kind == "parallel_map":
        reads = [_template_reads({"model": p.get("model"), **q}) for q in p["prompts"]]
        return Traits("1:1", None if None in reads else frozenset().union(*reads), writes | dropped | {k for q in p["prompts"] for k in q["output_keys"]}, dropped, paid, True, True)
    if kind == "filter":
        return Traits("sel", _template_reads(p), writes, writes, paid, p.get("limit") is None, True)
    if kind == "code_filter":
        reads = frozenset(p["reads"]) if p.get("reads") is not None else _identifiers(p.get("code"))
        return Traits("sel", reads, frozenset(), row_local=p.get("limit") is None, keeps_order=True)
    if kind == "code_map":
        made = frozenset(p["code"]) if isinstance(p.get("code"), dict) else None
        reads = frozenset(p["reads"]) if p.get("reads") is not None else None
        return Traits("1:1" if p.get("limit") is None else "n:m", reads, made, row_local=p.get("limit") is None, keeps_order=True)
    if kind in ("extract", "extract_lines"):
        return Traits("1:1", frozenset({p["key"]}), frozenset({p["key"] + (p.get("suffix") or f"_extracted_{p['name']}")}), row_local=True, keeps_order=True)
    if kind == "unnest_columns":
        return Traits("1:1", frozenset({p["key"]}), frozenset(p["keys"]) | {p["key"]} if p.get("keys") else None, frozenset({p["key"]}), row_local=True, keeps_order=True)
    if kind == "add_uuid":
        return Traits("1:1", frozenset(p.get("of") or ()), frozenset({p.get("id_key") or f"{p.get('name', 'add_uuid')}_id"}), row_local=True, keeps_order=True)
    if kind == "split":
        own = p.get("name", "split")
        return Traits("1:n", frozenset({p["key"]}), frozenset({f"{p['key']}_chunk", f"{own}_id", f"{own}_chunk_num"}), row_local=True, keeps_order=True)
    if kind == "unnest":
        return Traits("1:n", frozenset({p["key"]}), None, row_local=True, keeps_order=True)
    if kind == "gather":
        return Traits("1:1", None, frozenset({f"{p['content_key']}_rendered"}))
    if kind == "sample":
        first = p.get("method") == "first" and not p.get("stratify")
        return Traits("sel", frozenset(p.get("order", ())) if first else None, frozenset() if first else None, keeps_order=first)
    if kind == "rank":
        return Traits("1:1", None, frozenset({"_rank"}))
    return Traits(paid=paid)


@dataclass(frozen=True)
class Plan:
    nodes: tuple[Node, ...] = ()

    def then(self, node: Node) -> "Plan":
        return replace(self, nodes=(*self.nodes, node))

    def validate(self, columns: list[str] | None = None) -> list[str]:
        """Warnings: fields that are read after they were removed, or that the source doesn't have."""
        gone: set[str] = set()
        have, out = set(columns) if columns is not None else None, []
        for n in self.nodes:
            t = n.traits
            for f in sorted((t.reads or frozenset()) & gone):
                out.append(f"{n.name} reads {f}, which was removed")
            if have is not None and n.kind not in ("code_filter",) and not isinstance(n.params.get("model"), Expressions):
                out += [f"{n.name} reads {f}, which isn't there" for f in sorted((t.reads or frozenset()) - have - gone)]
            if t.writes is None or t.cardinality == "n:1":
                have = None
            elif have is not None:
                have |= t.writes
            gone = (gone - ((t.writes or frozenset()) - t.removes)) | t.removes
        return out

    def rewritten(self, rules: list[str] | None = None) -> "Plan":
        """To a fixpoint, in twenty passes at most."""
        chosen = list(RULES) if rules is None else rules
        if unknown := set(chosen) - set(RULES):
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        nodes = self.nodes
        for _ in range(20):
            before = nodes
            for r in chosen:
                nodes = RULES[r](nodes)
            if nodes == before:
                break
        return replace(self, nodes=nodes)

    def compile(self, df: DataFrame) -> DataFrame:
        for n in self.nodes:
            df = OPERATORS[n.kind](df, **n.params)
        return df

    def prefix_digests(self, source: str) -> list[str]:
        """A hash of the source and all steps up to each one."""
        out, state = [], hashlib.sha256(source.encode())
        for n in self.nodes:
            state.update(json.dumps([n.kind, n.name, n.params], sort_keys=True, default=repr).encode())
            out.append(state.hexdigest()[:32])
        return out

    def explain(self) -> str:
        lines = []
        for n in self.nodes:
            t = n.traits
            show = lambda s: "?" if s is None else "{" + ", ".join(sorted(s)) + "}"
            lines.append(f"{n.name} [{n.kind}] {t.cardinality} reads {show(t.reads)} writes {show(t.writes)}" + " paid" * t.paid)
        return "\n".join(lines)


def _passes(mover: Traits, over: Traits) -> bool:
    """Whether a row-local selection may go below ``over``."""
    clear = over.writes is not None and mover.reads is not None and not mover.reads & over.writes
    own = mover.writes is not None and (not mover.writes or over.reads is not None and not mover.writes & (over.reads | over.writes))
    return over.cardinality == "1:1" and over.row_local and over.keeps_order and clear and own


def push_selections(nodes: tuple[Node, ...]) -> tuple[Node, ...]:
    """Selections go below 1:1 steps that don't make what they read, where that saves calls."""
    for i in range(1, len(nodes)):
        t = nodes[i].traits
        if t.cardinality == "sel" and t.row_local and _passes(t, nodes[i - 1].traits) and (nodes[i - 1].traits.paid or any(n.traits.paid for n in nodes[:i])):
            return (*nodes[: i - 1], nodes[i], nodes[i - 1], *nodes[i + 1 :])
    return nodes


def push_limits(nodes: tuple[Node, ...]) -> tuple[Node, ...]:
    """An unstratified first sample goes below 1:1 steps that can't drop rows."""
    for i in range(1, len(nodes)):
        n, over = nodes[i], nodes[i - 1]
        first = n.kind == "sample" and n.params.get("method") == "first" and not n.params.get("stratify") and isinstance(n.params.get("samples"), int)
        whole = over.kind not in ("map", "parallel_map") or over.params.get("keep_failed")
        if first and whole and _passes(n.traits, over.traits):
            return (*nodes[: i - 1], n, over, *nodes[i + 1 :])
    return nodes


def cheap_first(nodes: tuple[Node, ...]) -> tuple[Node, ...]:
    """Of neighbouring row-local selections the free ones run first."""
    for i in range(1, len(nodes)):
        a, b = nodes[i - 1].traits, nodes[i].traits
        free = a.cardinality == b.cardinality == "sel" and a.row_local and b.row_local and a.paid and not b.paid
        if free and b.reads is not None and not b.reads & (a.writes or frozenset()):
            return (*nodes[: i - 1], nodes[i], nodes[i - 1], *nodes[i + 1 :])
    return nodes


RULES = {"push_selections": push_selections, "push_limits": push_limits, "cheap_first": cheap_first}


# Rewrites that change how an answer is come by; asked for by name, never applied on their own --------------------------


def take_head_tail(node: Node, key: str, head: int, tail: int) -> tuple[Node, ...]:
    """Before a step: only the first and last words of a field."""
    words = f"split({key}, ' ')"
    short = f"CASE WHEN size({words}) <= {head + tail} THEN {key} ELSE concat_ws(' ', slice({words}, 1, {head}), '...', slice({words}, -{tail}, {tail})) END"
    from pyspark.sql import functions as F

    return (Node("code_map", f"{node.name}_cut", {"code": {key: F.expr(short)}, "reads": [key]}), node)


def chunked(node: Node, key: str, *, num_tokens: int, doc_id: str, reduce: Node, peripheral: dict | None = None) -> tuple[Node, ...]:
    """A map over long texts: split, gather, map each chunk, reduce to the document."""
    own = f"{node.name}_split"
    template = node.params["prompt"].replace(f"input.{key}", f"input.{key}_chunk_rendered")
    return (
        Node("split", own, {"key": key, "name": own, "method": "token_count", "num_tokens": num_tokens, "id_of": [doc_id]}),
        Node("gather", f"{node.name}_gather", {"content_key": f"{key}_chunk", "doc_id_key": f"{own}_id", "order_key": f"{own}_chunk_num", "peripheral": peripheral or {}}),
        replace(node, params={**node.params, "prompt": template}),
        reduce,
    )


def hierarchical(node: Node, finer: list[str]) -> tuple[Node, ...]:
    """A reduce in two levels: by its keys and ``finer``, then by its keys."""
    keys = node.params["keys"] if isinstance(node.params["keys"], list) else [node.params["keys"]]
    low = replace(node, name=f"{node.name}_{'_'.join(finer)}", params={**node.params, "keys": [*keys, *finer]})
    outputs = list(node.params["output"])
    high = replace(node, params={**node.params, "order": finer, "fields": outputs})
    return (low, high)
