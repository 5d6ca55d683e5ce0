"""Changes to whole columns of documents: a list of operations applied to each tree."""

from __future__ import annotations

from docengine.functions import emit
from docengine.functions import tree as tr
from docengine.functions.convert import column_function, first


def at(root: tr.Node, path: str) -> tr.Node:
    """The node at an RFC 6901 pointer."""
    node = root
    for part in path.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        node = node.real()
        found = node.get(part) if node.kind == tr.MAPPING else node.items[int(part)] if part.isdigit() and int(part) < len(node.items) else None
        if found is None:
            raise tr.Y.YamlError(f"there is no {path}")
        node = found
    return node.real()


OPS = {
    "map_add": tr.map_add, "map_set": tr.map_set, "map_del": tr.map_del, "seq_add": tr.seq_add, "seq_set": tr.seq_set, "seq_del": tr.seq_del,
}


def apply(root: tr.Node, operations: list[tuple]) -> tr.Node:
    """Applies (name, path, arguments...) in order; also set_tag and set_anchor."""
    for name, path, *args in operations:
        node = at(root, path)
        if name == "set_tag":
            node.tag = args[0]
            node.tag_id = tr.type_of(node, "core")
        elif name == "set_anchor":
            node.anchor = args[0]
        else:
            OPS[name](node, *args)
    return root


def changed(operations: list[tuple], to: str = "json"):
    """Column function: each document of a text column changed, as json or yaml; null where an operation fails."""
    write = emit.json_compact if to == "json" else lambda r: emit.yaml_text([r])
    return column_function(lambda v: write(apply(first(v), operations)), "string", shaped=True)
