"""Settings described by JSON schemas: leaf rows of a nested schema, and defaults that follow other settings."""

from __future__ import annotations

from typing import Any

_SCALARS = ("boolean", "integer", "number", "string")


class SchemaError(ValueError):
    """A schema that no row can be made of."""


def _target(schema: dict, root: dict) -> dict:
    """A schema with its references followed; keywords beside a reference win over the target's."""
    seen: set[str] = set()
    while "$ref" in schema:
        name = schema["$ref"].rpartition("/")[2]
        target = (root.get("$defs") or {}).get(name) or (root.get("definitions") or {}).get(name)
        if target is None or name in seen:
            raise SchemaError(f"unresolved reference {schema['$ref']}")
        seen.add(name)
        schema = target | {k: v for k, v in schema.items() if k != "$ref"}
    return schema


def _plain(schema: dict, root: dict) -> dict:
    """The one schema an optional value has, with what is said about this use of it."""
    own = _target(schema, root)
    variants = own.get("anyOf") or own.get("oneOf")
    if not variants:
        return own
    present = [v for v in (_target(x, root) for x in variants) if v.get("type") != "null"]
    if len(present) != 1:
        raise SchemaError("only optional values of one type are supported")
    return present[0] | {k: own[k] for k in ("title", "x-group", "description", "default") if k in own}


def _type(schema: dict, key: str) -> str:
    if "enum" in schema:
        return "enum"
    kinds = schema.get("type")
    kind = next((k for k in kinds if k != "null"), None) if isinstance(kinds, list) else kinds
    if kind not in _SCALARS:
        raise SchemaError(f"setting {key} has the unsupported type {kind}")
    return kind


def flatten(schema: dict, values: Any = None) -> list[dict]:
    """Leaf rows (key, title, group, description, type, options, default, value) of a schema, in its order.

    Keys join names by dots. What is marked `x-settings: false` is left out; a leaf needs a title and an `x-group`.
    """
    out: list[dict] = []
    work = [(schema, values, "")]
    while work:
        at, value, key = work.pop()
        node = at if at.get("x-settings") is False else _plain(at, schema)
        if node.get("x-settings") is False:
            continue
        if node.get("properties"):
            own = value if isinstance(value, dict) else {}
            work += [(child, own.get(name), f"{key}.{name}" if key else name) for name, child in reversed(node["properties"].items())]
            continue
        kind = _type(node, key)
        if not node.get("title") or not node.get("x-group"):
            raise SchemaError(f"setting {key} has no title or no x-group")
        options = [str(x) for x in node["enum"]] if kind == "enum" else None
        out.append({"key": key, "title": node["title"], "group": node["x-group"], "description": node.get("description") or "", "type": kind, "options": options, "default": node.get("default"), "value": value})
    return out


def with_defaults(options: dict[str, dict], given: dict[str, Any]) -> dict[str, Any]:
    """given with every unset option: its `default`, else what `x-default-by` says for another option's value.

    Those may follow each other in any order, so rounds go on until one adds nothing; circles stay unset.
    """
    out = {k: o["default"] for k, o in options.items() if "default" in o} | given
    followers = {k: o["x-default-by"] for k, o in options.items() if "x-default-by" in o}
    while True:
        ready = {k: by["values"][out[by["key"]]] for k, by in followers.items() if k not in out and isinstance(out.get(by.get("key")), str) and out[by["key"]] in by.get("values", {})}
        if not ready:
            return out
        out |= ready


def pruned(document: dict, defaults: dict) -> dict:
    """A nested document without keys that say what the defaults say anyway, nor tables left empty by that."""
    out = {}
    for k, v in document.items():
        if isinstance(v, dict) and isinstance(defaults.get(k), dict):
            if inner := pruned(v, defaults[k]):
                out[k] = inner
        elif k not in defaults or type(v) is not type(defaults[k]) or v != defaults[k]:
            out[k] = v
    return out
