"""Document trees: composed from events, flattened to rows, navigated, built and changed."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from docengine.functions import resolve as R
from docengine.functions import yamlparse as Y

SCALAR, SEQUENCE, MAPPING, ALIAS = "scalar", "seq", "map", "alias"


@dataclass(eq=False, slots=True)
class Node:
    kind: str
    text: str = ""
    #: Children; of a mapping key and value in turn, duplicates kept.
    items: list = field(default_factory=list)
    style: int = Y.PLAIN
    flow: bool = False
    tag: str | None = None
    anchor: str | None = None
    target: Node | None = None
    tag_id: int = R.STR
    line: int = 0
    col: int = 0

    def real(self, hops: int = 64) -> Node:
        """The node itself, or what an alias stands for."""
        node = self
        while node.kind == ALIAS and node.target is not None and hops:
            node, hops = node.target, hops - 1
        return node

    def pairs(self) -> list[tuple[Node, Node]]:
        return list(zip(self.items[::2], self.items[1::2], strict=True))

    def get(self, key: str) -> Node | None:
        """First value under a key."""
        for k, v in self.pairs():
            if k.kind == SCALAR and k.text == key:
                return v
        return None


def type_of(node: Node, family: str) -> int:
    if node.kind == ALIAS:
        return R.STR
    if node.tag is not None and node.tag != "!":
        return R.tag_number(node.tag)
    if node.kind == SEQUENCE:
        return R.SEQ
    if node.kind == MAPPING:
        return R.MAP
    return R.resolve(node.text, family) if node.style == Y.PLAIN and node.tag is None else R.STR


def compose(events: list[Y.Event], family: str = "core") -> list[Node]:
    """One root for each document."""
    roots, stack, anchors, items = [], [], {}, []
    for e in events:
        type_ = e.type
        if type_ == "val":
            tag, style, value = e.tag, e.style, e.value or ""
            tag_id = R.STR if style != Y.PLAIN and tag is None else R.resolve(value, family) if tag is None else None
            node = Node(SCALAR, value, [], style, e.flow, tag, e.anchor, None, tag_id, e.line, e.col)
            if tag_id is None:
                node.tag_id = type_of(node, family)
            if e.anchor is not None:
                anchors[e.anchor] = node
            items.append(node)
        elif type_ == "map+" or type_ == "seq+":
            node = Node(MAPPING if type_ == "map+" else SEQUENCE, "", [], e.style, e.flow, e.tag, e.anchor, None, R.STR, e.line, e.col)
            node.tag_id = type_of(node, family)
            if e.anchor is not None:
                anchors[e.anchor] = node
            items.append(node)
            stack.append(items)
            items = node.items
        elif type_ == "map-" or type_ == "seq-":
            items = stack.pop()
        elif type_ == "ali":
            items.append(Node(ALIAS, e.value or "", [], e.style, e.flow, e.tag, e.anchor, anchors.get(e.value), R.STR, e.line, e.col))
        elif type_ == "doc+":
            anchors, stack, items = {}, [], []
        elif type_ == "doc-":
            roots.append(items[0])
    return roots


# decoding


class JsonError(ValueError):
    pass


def strict_json(text: str, family: str = "core", max_depth: int = Y.MAX_DEPTH) -> Node:
    """RFC 8259 text as a tree; key order and duplicate keys are kept. Raises JsonError."""
    number = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
    string = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
    space = re.compile(r"[ \t\n\r]*")
    words = {"true": R.BOOL, "false": R.BOOL, "null": R.NULL}
    i = space.match(text, 0).end()
    root, stack, want = None, [], "value"

    def put(node: Node) -> None:
        nonlocal root
        if stack:
            stack[-1].items.append(node)
        else:
            root = node

    def decoded(raw: str) -> str:
        if "\\" not in raw:
            return raw
        out = json.loads(f'"{raw}"')
        if re.search("[\ud800-\udfff]", out):
            raise JsonError("unpaired surrogate")
        return out

    def close(i: int) -> int:
        stack.pop()
        return i + 1

    while True:
        i = space.match(text, i).end()
        c = text[i : i + 1]
        top = stack[-1] if stack else None
        if want == "value":
            if c == "]" and top is not None and top.kind == SEQUENCE and not top.items:
                i = close(i)
            elif c in ("[", "{") and c:
                if len(stack) >= max_depth:
                    raise JsonError("nesting is too deep")
                node = Node(SEQUENCE if c == "[" else MAPPING, flow=True, tag_id=R.SEQ if c == "[" else R.MAP)
                put(node)
                stack.append(node)
                i += 1
                want = "value" if c == "[" else "first"
                continue
            elif c == '"':
                m = string.match(text, i)
                if not m:
                    raise JsonError("bad string")
                put(Node(SCALAR, decoded(m[1]), style=Y.DOUBLE))
                i = m.end()
            elif m := number.match(text, i):
                put(Node(SCALAR, m[0], tag_id=R.FLOAT if m[1] or m[2] else R.INT))
                i = m.end()
            else:
                m = re.compile("[a-z]+").match(text, i)
                if not m or m[0] not in words:
                    raise JsonError("bad value")
                put(Node(SCALAR, m[0], tag_id=words[m[0]]))
                i = m.end()
        elif want in ("first", "key"):
            if want == "first" and c == "}":
                i = close(i)
            else:
                m = string.match(text, i)
                if not m:
                    raise JsonError("bad key")
                put(Node(SCALAR, decoded(m[1]), style=Y.DOUBLE))
                i = space.match(text, m.end()).end()
                if text[i : i + 1] != ":":
                    raise JsonError("missing ':'")
                i += 1
                want = "value"
                continue
        # a value or container has ended
        while True:
            i = space.match(text, i).end()
            if not stack:
                if i != len(text):
                    raise JsonError("text after the value")
                return root
            c, top = text[i : i + 1], stack[-1]
            if c == ",":
                i += 1
                want = "key" if top.kind == MAPPING else "item"
                break
            if c != ("]" if top.kind == SEQUENCE else "}"):
                raise JsonError("missing ',' or end of a container")
            i = close(i)
        if want == "item":
            i = space.match(text, i).end()
            if text[i : i + 1] == "]":
                raise JsonError("a comma before the end")
            want = "value"


#: The strict grammar as one possessive pattern is beyond a regular language; this finds texts that Spark's own JSON reader would take wrongly.
JSON_TRAPS = r'\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}'


def mask_comments(text: str) -> str:
    """JavaScript comments outside strings as blanks; offsets stay."""
    blank = lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0])
    return re.sub(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?(?:\*/|\Z)', blank, text, flags=re.S)


BOMS = ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8"))


def sniff(data: bytes) -> tuple[str, int]:
    """(encoding, length of the byte order mark); without a mark by the zero bytes of the first characters."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return name, len(mark)
    shape = tuple(b == 0 for b in data[:4])
    guess = {(True, True, True, False): "utf-32-be", (False, True, True, True): "utf-32-le"}.get(shape)
    if guess is None and len(data) >= 2:
        guess = "utf-16-be" if shape[:2] == (True, False) else "utf-16-le" if shape[:2] == (False, True) else None
    return guess or "utf-8", 0


def to_text(data: bytes | str) -> str:
    if isinstance(data, str):
        return data
    name, skip = sniff(data)
    try:
        return data[skip:].decode(name)
    except UnicodeDecodeError as e:
        raise Y.YamlError(f"bad {name} at byte {e.start}", 1, 1, Y.ENCODING) from None


def normal_breaks(text: str) -> str:
    """YAML's further line breaks (NEL, LS, PS) as line feeds, outside quoted scalars."""
    if not re.search("[\x85\u2028\u2029]", text):
        return text
    keep = lambda m: m[0] if m[0][0] in "\"'" else "\n"
    # a quote begins a scalar only where one may stand: after a break or space, or after an indicator
    return re.sub("(?<![^\\s\\[{,:?-])(?:\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^']|'')*')|[\x85\u2028\u2029]", keep, text, flags=re.S)


def load_yaml(data: bytes | str, family: str = "core", max_depth: int = Y.MAX_DEPTH) -> list[Node]:
    """Trees of all documents of a stream; raises YamlError."""
    return compose(Y.parse(normal_breaks(to_text(data)), max_depth), family)


def split_stream(text: str) -> list[tuple[int, str]]:
    """(first line, text) of each document of a stream, cut at markers at the start of a line."""
    parts, start, line, began, content = [], 0, 1, 1, False
    pos, in_directives = 0, False
    for row in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text):
        marker = re.match(r"(---|\.\.\.)(?=[ \t\r\n]|\Z)", row)
        if marker and marker[1] == "---" and content and not in_directives:
            parts.append((began, text[start:pos]))
            start, began, content = pos, line, False
        in_directives = (row.startswith("%") and not content) or (in_directives and not marker)
        pos += len(row)
        line += 1
        content = content or bool(row.strip() and not row.lstrip().startswith("#"))
        if marker and marker[1] == "...":
            if text[start:pos].strip(" \t\r\n.") or content:
                parts.append((began, text[start:pos]))
            start, began, content = pos, line, False
    if text[start:].strip():
        parts.append((began, text[start:]))
    return parts


def tolerant(data: bytes | str, family: str = "core", max_depth: int = Y.MAX_DEPTH):
    """(index, status, line, column, message, text, root) of each document; a faulty one takes an index and the next still comes."""
    try:
        text = to_text(data)
    except Y.YamlError as e:
        yield 0, e.status, e.line, e.col, e.message, None, None
        return
    if max_depth == Y.MAX_DEPTH and (events := Y.quick(text)) is not None:
        # one document
        yield 0, Y.OK, None, None, None, text, compose(events, family)[0]
        return
    index = 0
    for line, part in split_stream(normal_breaks(text)):
        try:
            for root in compose(Y.parse(part, max_depth), family):
                yield index, Y.OK, None, None, None, part, root
                index += 1
        except Y.YamlError as e:
            yield index, e.status, line + e.line - 1, e.col, e.message, part, None
            index += 1


# rows


def pointer(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1") if "~" in segment or "/" in segment else segment


def typed(node: Node) -> tuple[int | None, float | None, bool | None]:
    """(i, d, b) of a scalar by its tag; all None if the text does not convert."""
    if node.kind != SCALAR:
        return None, None, None
    if node.tag_id == R.INT:
        return R.to_int(node.text), None, None
    if node.tag_id == R.FLOAT:
        return None, R.to_float(node.text), None
    if node.tag_id == R.BOOL:
        return None, None, R.to_bool(node.text, True)
    return None, None, None


NODE = "node_id parent_id last_id ord role key path depth kind style tag_id tag anchor alias_target text i d b".split()
VALUE = "kind tag_id is_key text i d b".split()


def node_rows(root: Node) -> list[dict]:
    """Rows of the nodes table, in preorder; ``last_id`` is that of the last node below."""
    return [dict(zip(NODE, row, strict=True)) for row in node_tuples(root)]


def node_tuples(root: Node) -> list[tuple]:
    """As ``node_rows``, in the order of ``NODE``."""
    ids: dict[int, int] = {}
    stack: list = [(root, None, 0, "root", None, "", 0)]
    rows: list = []
    while stack:
        node, parent, ord_, role, key, path, depth = stack.pop()
        me, kind, target = len(rows), node.kind, None
        ids[id(node)] = me
        if kind == SCALAR:
            tag_id = node.tag_id
            i, d, b = (None, None, None) if tag_id == R.STR or tag_id == R.NULL else typed(node)
            rows.append((me, parent, me, ord_, role, key, path, depth, kind, node.style, tag_id, node.tag, node.anchor, None, node.text, i, d, b))
            continue
        if kind == ALIAS and node.target is not None:
            target = ids.get(id(node.target))
        rows.append([me, parent, me, ord_, role, key, path, depth, kind, node.style, node.tag_id, node.tag, node.anchor, target, node.text if kind == ALIAS else None, None, None, None])
        below = []
        if kind == SEQUENCE:
            below = [(c, me, k, "item", None, f"{path}/{k}", depth + 1) for k, c in enumerate(node.items)]
        elif kind == MAPPING:
            items, depth = node.items, depth + 1
            for k in range(0, len(items), 2):
                a = items[k]
                real = a if a.kind == SCALAR else a.real()
                name = real.text if real.kind == SCALAR else to_json(real)
                at = f"{path}/{pointer(name)}"
                below.append((a, me, k, "key", None, at, depth))
                below.append((items[k + 1], me, k + 1, "value", name, at, depth))
        below.reverse()
        stack += below
    for row in reversed(rows):
        # a container comes before what is below it
        if row[1] is not None and row[2] > rows[row[1]][2]:
            rows[row[1]][2] = row[2]
    return rows


def value_rows(root: Node):
    """Rows of the typed value stream of a document."""
    return [dict(zip(VALUE, row, strict=True)) for row in value_tuples(root)]


_VALUE_KINDS = {R.NULL: "null", R.BOOL: "bool", R.INT: "int", R.FLOAT: "float", R.TIMESTAMP: "timestamp"}


def value_tuples(root: Node):
    """As ``value_rows``, in the order of ``VALUE``."""
    rows = [("doc", 0, False, None, None, None, None)]
    close = ("close", 0, False, None, None, None, None)
    stack: list = [(root, False)]
    while stack:
        node, is_key = stack.pop()
        if node is None:
            rows.append(close)
            continue
        if node.anchor is not None:
            rows.append(("anchor", 0, is_key, node.anchor, None, None, None))
        if node.kind == ALIAS:
            rows.append(("alias", 0, is_key, node.text, None, None, None))
        elif node.kind == SCALAR:
            kind = _VALUE_KINDS.get(node.tag_id, "str")
            i, d, b = (None, None, None) if kind == "str" else typed(node)
            # a number that does not convert is a string with its tag unchanged
            if (kind == "int" and i is None) or (kind == "float" and d is None) or (kind == "bool" and b is None):
                kind = "str"
            rows.append((kind, node.tag_id, is_key, node.text, i, d, b))
        else:
            rows.append((f"{node.kind}_open", node.tag_id, is_key, node.tag, None, None, None))
            stack.append((None, False))
            if node.kind == MAPPING:
                stack.extend((c, k % 2 == 0) for k, c in reversed(list(enumerate(node.items))))
            else:
                stack.extend((c, False) for c in reversed(node.items))
    return rows


# JSON text; the emitters proper are in emit.py


def quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def scalar_json(node: Node) -> str:
    i, d, b = typed(node)
    if node.tag_id == R.NULL:
        return "null"
    if b is not None:
        return "true" if b else "false"
    if node.tag_id == R.INT:
        # integers beyond 64 bits keep their digits
        return str(i) if i is not None else node.text if re.fullmatch(r"-?[1-9][0-9]*", node.text) else quote(node.text)
    if d is not None:
        return quote(R.float_word(d)) if R.float_word(d) else R.json_float(d)
    return quote(node.text)


def to_json(root: Node, colon: str = ":", comma: str = ",") -> str:
    """JSON text of a tree; aliases are written out as what they stand for."""
    out: list[str] = []
    stack: list[Any] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        node = node.real()
        if node.kind == SCALAR:
            out.append(scalar_json(node))
        elif node.kind == ALIAS:
            out.append("null")
        else:
            seq = node.kind == SEQUENCE
            parts: list[Any] = ["[" if seq else "{"]
            if seq:
                for k, c in enumerate(node.items):
                    parts += [comma, c] if k else [c]
            else:
                for k, (a, v) in enumerate(node.pairs()):
                    name = a.real()
                    parts += [comma] if k else []
                    parts += [quote(name.text if name.kind == SCALAR else to_json(name)) + colon, v]
            parts.append("]" if seq else "}")
            stack.extend(reversed(parts))
    return "".join(out)


def canonical(node: Node) -> str:
    """A text that is equal for equal values: 1 and 1.0 are equal, mappings have no order."""
    node = node.real()
    if node.kind == SCALAR:
        i, d, b = typed(node)
        if i is not None or d is not None:
            value = float(i if i is not None else d)
            return f"n{i}" if i is not None else f"n{int(value)}" if value.is_integer() and abs(value) < 2**63 else f"n{value!r}"
        if b is not None:
            return "t" if b else "f"
        return "0" if node.tag_id == R.NULL else "s" + quote(node.text)
    if node.kind == SEQUENCE:
        return "[" + ",".join(map(canonical, node.items)) + "]"
    return "{" + ",".join(sorted(canonical(k) + ":" + canonical(v) for k, v in node.pairs())) + "}"


# building and changing


def scalar(value: Any, style: int | None = None) -> Node:
    """A scalar node of a Python value."""
    if value is None:
        return Node(SCALAR, "null", tag_id=R.NULL)
    if isinstance(value, bool):
        return Node(SCALAR, "true" if value else "false", tag_id=R.BOOL)
    if isinstance(value, int):
        return Node(SCALAR, str(value), tag_id=R.INT)
    if isinstance(value, float):
        return Node(SCALAR, R.shortest(value), tag_id=R.FLOAT)
    plain = R.resolve(value) == R.STR if style is None else style == Y.PLAIN
    return Node(SCALAR, value, style=Y.PLAIN if plain and style is None else style if style is not None else Y.DOUBLE, tag_id=R.STR)


def build(value: Any) -> Node:
    """A tree of Python values; dicts keep their order."""
    if isinstance(value, Node):
        return value
    if isinstance(value, dict):
        return Node(MAPPING, items=[x for k, v in value.items() for x in (build(k), build(v))], tag_id=R.MAP)
    if isinstance(value, list | tuple):
        return Node(SEQUENCE, items=[build(v) for v in value], tag_id=R.SEQ)
    return scalar(value)


def find_key(node: Node, key: str) -> int:
    return next((2 * k for k, (a, _) in enumerate(node.pairs()) if a.kind == SCALAR and a.text == key), -1)


def map_add(node: Node, key: str, value: Any) -> Node:
    """Adds a pair; a key that is there already is an error."""
    if node.kind != MAPPING or find_key(node, key) >= 0:
        raise Y.YamlError("not a mapping, or the key is there already")
    node.items += [scalar(key), build(value)]
    return node


def map_set(node: Node, key: str, value: Any) -> Node:
    """Sets a pair; a key that is there keeps its place."""
    at = find_key(node, key)
    if at < 0:
        return map_add(node, key, value)
    node.items[at + 1] = build(value)
    return node


def map_del(node: Node, key: str) -> Node:
    at = find_key(node, key)
    if at >= 0:
        del node.items[at : at + 2]
    return node


def seq_add(node: Node, value: Any) -> Node:
    if node.kind != SEQUENCE:
        raise Y.YamlError("not a sequence")
    node.items.append(build(value))
    return node


def seq_set(node: Node, at: int, value: Any, grow: bool = False) -> Node:
    """Replaces an item; with ``grow`` the sequence is filled with nulls up to it."""
    while grow and len(node.items) <= at:
        node.items.append(scalar(None))
    if not 0 <= at < len(node.items):
        raise Y.YamlError("no such item")
    node.items[at] = build(value)
    return node


def seq_del(node: Node, at: int) -> Node:
    if 0 <= at < len(node.items):
        del node.items[at]
    return node


def bulk(ops: list[tuple]) -> Node:
    """A tree of op records: ('scalar', value), ('seq',), ('map',), ('end',), ('tag', uri) for the node that follows."""
    root, stack, tag = None, [], None
    for op, *args in ops:
        if op == "tag":
            tag = args[0]
            continue
        if op == "end":
            done = stack.pop()
            if done.kind == MAPPING:
                if len(done.items) % 2:
                    raise Y.YamlError("a key without a value")
                # the last of equal keys counts
                last: dict = {}
                for k, v in done.pairs():
                    last[canonical(k)] = (k, v)
                done.items = [x for kv in last.values() for x in kv]
            continue
        node = scalar(args[0]) if op == "scalar" else Node(SEQUENCE if op == "seq" else MAPPING, tag_id=R.SEQ if op == "seq" else R.MAP)
        if tag is not None:
            node.tag, tag = tag, None
            node.tag_id = R.tag_number(node.tag)
        if stack:
            stack[-1].items.append(node)
        elif root is None:
            root = node
        else:
            raise Y.YamlError("a second root")
        if op != "scalar":
            stack.append(node)
    if stack or root is None:
        raise Y.YamlError("the ops do not end the tree")
    return root
