"""Ruby's Marshal format 4.8: read to trees, and written from trees."""

from __future__ import annotations

import struct

from docengine.functions import resolve as R
from docengine.functions import yamlparse as Y
from docengine.functions.tree import ALIAS, MAPPING, SCALAR, SEQUENCE, Node, canonical, scalar, to_json, typed


class MarshalError(ValueError):
    def __init__(self, message: str, status: int = Y.PARSE):
        super().__init__(message)
        self.status = status


class Reader:
    def __init__(self, data: bytes):
        if data[:2] != b"\x04\x08":
            raise MarshalError("no Marshal 4.8 data")
        self.data, self.i, self.symbols, self.objects = data, 2, [], []

    def byte(self) -> int:
        if self.i >= len(self.data):
            raise MarshalError("the data end too early")
        self.i += 1
        return self.data[self.i - 1]

    def take(self, n: int) -> bytes:
        if n < 0 or self.i + n > len(self.data):
            raise MarshalError("the data end too early")
        self.i += n
        return self.data[self.i - n : self.i]

    def fixnum(self) -> int:
        c = struct.unpack("b", bytes([self.byte()]))[0]
        if c == 0:
            return 0
        if -5 < c < 5:
            raw = self.take(abs(c))
            value = int.from_bytes(raw, "little")
            return value if c > 0 else value - (1 << (8 * -c))
        return c - 5 if c > 0 else c + 5

    def symbol(self) -> str:
        mark = chr(self.byte())
        if mark == ":":
            self.symbols.append(self.take(self.fixnum()).decode("utf-8", "replace"))
            return self.symbols[-1]
        if mark == ";":
            at = self.fixnum()
            if 0 <= at < len(self.symbols):
                return self.symbols[at]
        raise MarshalError("a symbol is expected")

    def value(self, depth: int = 0) -> Node:
        if depth > Y.MAX_DEPTH:
            raise MarshalError("nesting is too deep", Y.DEPTH)
        mark = chr(self.byte())
        if mark in "0TF":
            return scalar({"0": None, "T": True, "F": False}[mark])
        if mark == "i":
            return scalar(self.fixnum())
        if mark in ":;":
            self.i -= 1
            return Node(SCALAR, self.symbol(), style=Y.DOUBLE)
        if mark == "@":
            at = self.fixnum()
            if not 0 <= at < len(self.objects) or self.objects[at] is None:
                raise MarshalError("a link to nothing")
            return self.objects[at]
        if mark == "I":
            node = self.value(depth + 1)
            for _ in range(self.fixnum()):
                self.symbol()
                self.value(depth + 1)
            return node
        slot = len(self.objects)
        self.objects.append(None)
        if mark == '"':
            node = Node(SCALAR, self.take(self.fixnum()).decode("utf-8", "replace"), style=Y.DOUBLE)
        elif mark == "f":
            text = self.take(self.fixnum()).decode("ascii", "replace")
            node = scalar(float({"inf": "inf", "-inf": "-inf", "nan": "nan"}.get(text, text)))
        elif mark == "l":
            sign = -1 if chr(self.byte()) == "-" else 1
            node = Node(SCALAR, str(sign * int.from_bytes(self.take(2 * self.fixnum()), "little")), tag_id=R.INT)
        elif mark == "[":
            node = Node(SEQUENCE, tag_id=R.SEQ)
            self.objects[slot] = node
            for _ in range(self.fixnum()):
                node.items.append(self.value(depth + 1))
        elif mark in "{}":
            node = Node(MAPPING, tag_id=R.MAP)
            self.objects[slot] = node
            for _ in range(self.fixnum()):
                key, item = self.value(depth + 1), self.value(depth + 1)
                node.items += [key if key.tag_id == R.STR else Node(SCALAR, to_json(key), style=Y.DOUBLE), item]
            if mark == "}":
                self.value(depth + 1)
        else:
            raise MarshalError(f"type {mark!r} is not supported", Y.UNSUPPORTED)
        self.objects[slot] = node
        return node


def load(data: bytes) -> Node:
    return Reader(data).value()


def fixnum(n: int) -> bytes:
    if n == 0:
        return b"\0"
    if 0 < n < 123:
        return bytes([n + 5])
    if -124 < n < 0:
        return struct.pack("b", n - 5)
    size = next(s for s in range(1, 9) if (-(1 << (8 * s)) <= n < 0) or (0 < n < 1 << (8 * s)))
    return struct.pack("b", size if n > 0 else -size) + (n & ((1 << (8 * size)) - 1)).to_bytes(size, "little")


def raw_string(text: str) -> bytes:
    body = text.encode("utf-8")
    return b'"' + fixnum(len(body)) + body


class Writer:
    def __init__(self, strict_keys: bool = False):
        self.strict, self.symbols, self.links, self.count = strict_keys, 0, {}, 0

    def encoding(self) -> bytes:
        """The instance variable that marks UTF-8; its name is a symbol."""
        first, self.symbols = not self.symbols, 1
        return fixnum(1) + (b":\x06E" if first else b";\0") + b"T"

    def value(self, node: Node) -> bytes:
        node = node.real()
        if node.kind == ALIAS:
            raise MarshalError("an alias without a target")
        if node.tag_id == R.MERGE:
            raise MarshalError("a merge key cannot be written", Y.UNSUPPORTED)
        if id(node) in self.links:
            return b"@" + fixnum(self.links[id(node)])
        i, d, b = typed(node)
        if node.kind == SCALAR and node.tag_id == R.NULL:
            return b"0"
        if b is not None:
            return b"T" if b else b"F"
        if i is not None and -(1 << 30) <= i < 1 << 30:
            return b"i" + fixnum(i)
        self.links[id(node)] = self.count
        self.count += 1
        if i is not None:
            size = (abs(i).bit_length() + 15) // 16
            return b"l" + (b"-" if i < 0 else b"+") + fixnum(size) + abs(i).to_bytes(2 * size, "little")
        if d is not None:
            word = {".inf": "inf", "-.inf": "-inf", ".nan": "nan"}.get(R.float_word(d) or "")
            text = word or (str(int(d)) if d.is_integer() and abs(d) < 1e16 else repr(d))
            return b"f" + fixnum(len(text)) + text.encode()
        if node.kind == SCALAR:
            return b"I" + raw_string(node.text) + self.encoding()
        if node.kind == SEQUENCE:
            return b"[" + fixnum(len(node.items)) + b"".join(self.value(c) for c in node.items)
        last: dict = {}
        for k, v in node.pairs():
            name = canonical(k)
            if name in last and self.strict:
                raise MarshalError("a repeated key")
            last[name] = (last.get(name, (k,))[0], v)
        return b"{" + fixnum(len(last)) + b"".join(self.value(k) + self.value(v) for k, v in last.values())


def dump(node: Node, strict_keys: bool = False) -> bytes:
    return b"\x04\x08" + Writer(strict_keys).value(node)


def dump_all(roots: list[Node]) -> bytes:
    """All documents as one array."""
    return dump(Node(SEQUENCE, items=list(roots), tag_id=R.SEQ))
