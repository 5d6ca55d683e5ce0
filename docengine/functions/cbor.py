"""CBOR (RFC 8949) to trees and back, and CBOR sequences (RFC 8742)."""

from __future__ import annotations

import math
import struct

from docengine.functions import resolve as R
from docengine.functions import yamlparse as Y
from docengine.functions.tree import ALIAS, MAPPING, SCALAR, SEQUENCE, Node, scalar, to_json, typed

MAX_TAGS = 64


class CborError(ValueError):
    def __init__(self, message: str, status: int = Y.PARSE):
        super().__init__(message)
        self.status = status


class Reader:
    def __init__(self, data: bytes, strict: bool = False, max_depth: int = Y.MAX_DEPTH):
        self.data, self.i, self.strict, self.max_depth = data, 0, strict, max_depth

    def take(self, n: int) -> bytes:
        if self.i + n > len(self.data):
            raise CborError("the item ends too early")
        self.i += n
        return self.data[self.i - n : self.i]

    def head(self) -> tuple[int, int, int | None]:
        """(major type, additional information, argument)."""
        first = self.take(1)[0]
        major, info = first >> 5, first & 31
        if info < 24:
            return major, info, info
        if info == 31:
            if major in (0, 1, 6):
                raise CborError("an indefinite length may not stand here")
            return major, info, None
        if info > 27:
            raise CborError("reserved additional information")
        size = 1 << (info - 24)
        value = int.from_bytes(self.take(size), "big")
        if self.strict and major != 7 and (value < 24 if size == 1 else value < 1 << (4 * size)):
            raise CborError("an argument is longer than it need be")
        return major, info, value

    def text(self, raw: bytes) -> str:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            raise CborError("text is no UTF-8", Y.ENCODING) from None

    def pieces(self, major: int) -> bytes:
        out = []
        while self.data[self.i : self.i + 1] != b"\xff":
            inner, info, n = self.head()
            if inner != major or info == 31:
                raise CborError("a piece of another type in an indefinite string")
            out.append(self.take(n))
            if major == 3:
                self.text(out[-1])
        self.i += 1
        return b"".join(out)

    def item(self, depth: int = 0) -> Node:
        if depth > self.max_depth:
            raise CborError("nesting is too deep", Y.DEPTH)
        tags: list[str] = []
        while True:
            major, info, n = self.head()
            if major != 6:
                break
            tags.append(str(n))
            if len(tags) > MAX_TAGS:
                raise CborError("too many tags")
        node = self.body(major, info, n, depth)
        if tags:
            node.tag = " ".join(tags)
        return node

    def body(self, major: int, info: int, n: int | None, depth: int) -> Node:
        if major in (0, 1):
            value = n if major == 0 else -1 - n
            return scalar(value) if R.LOW <= value <= R.HIGH else scalar(float(value))
        if major == 2:
            import base64

            raw = self.pieces(2) if n is None else self.take(n)
            node = Node(SCALAR, base64.b64encode(raw).decode(), style=Y.DOUBLE, tag_id=R.BINARY)
            node.target = None
            return node
        if major == 3:
            return Node(SCALAR, self.text(self.pieces(3) if n is None else self.take(n)), style=Y.DOUBLE)
        if major in (4, 5):
            node = Node(SEQUENCE if major == 4 else MAPPING, flow=True, tag_id=R.SEQ if major == 4 else R.MAP)
            if n is not None and n * (1 if major == 4 else 2) > len(self.data) - self.i:
                raise CborError("a container is longer than the data")
            count = 0
            while n is None or count < n:
                if n is None and self.data[self.i : self.i + 1] == b"\xff":
                    self.i += 1
                    break
                if major == 5:
                    node.items.append(self.key(self.item(depth + 1)))
                node.items.append(self.item(depth + 1))
                count += 1
            return node
        if info == 31:
            raise CborError("a break outside an indefinite item")
        if info in (25, 26, 27):
            raw = n.to_bytes({25: 2, 26: 4, 27: 8}[info], "big")
            return scalar(struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], raw)[0])
        if info == 24 and n < 32:
            raise CborError("a simple value below 32 in two bytes")
        if n in (20, 21):
            return scalar(n == 21)
        if n == 22:
            return scalar(None)
        return Node(SCALAR, "undefined" if n == 23 else f"simple({n})", style=Y.DOUBLE)

    def key(self, node: Node) -> Node:
        if node.kind != SCALAR:
            raise CborError("a container may not be a key")
        if node.tag_id != R.STR and self.strict:
            raise CborError("a key is no text")
        return node if node.tag_id == R.STR else Node(SCALAR, node.text, style=Y.DOUBLE)


def decode(data: bytes, strict: bool = False, max_depth: int = Y.MAX_DEPTH) -> Node:
    """One item; bytes after it are an error."""
    reader = Reader(data, strict, max_depth)
    node = reader.item()
    if reader.i != len(data):
        raise CborError("bytes after the item")
    return node


def decode_prefix(data: bytes, strict: bool = False) -> tuple[Node, int]:
    """The first item and how many bytes it takes."""
    reader = Reader(data, strict)
    return reader.item(), reader.i


def decode_sequence(data: bytes, strict: bool = False) -> list[Node]:
    reader, out = Reader(data, strict), []
    while reader.i < len(data):
        out.append(reader.item())
    return out


def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for info, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | info]) + n.to_bytes(size, "big")
    raise CborError("a number beyond 64 bits")


def float_bytes(value: float) -> bytes:
    """The shortest of half, single and double that keeps the value."""
    if math.isnan(value):
        return b"\xf9\x7e\x00"
    for mark, form in ((0xF9, ">e"), (0xFA, ">f")):
        try:
            raw = struct.pack(form, value)
        except OverflowError:
            continue
        if struct.unpack(form, raw)[0] == value:
            return bytes([mark]) + raw
    return b"\xfb" + struct.pack(">d", value)


def encode(node: Node, canonical: bool = False) -> bytes:
    """An item; canonical sorts keys by their encoded bytes, bytewise."""
    node = node.real()
    if node.kind == ALIAS:
        raise CborError("an alias without a target")
    tags = b""
    if node.tag and all(t.isdigit() for t in node.tag.split()):
        tags = b"".join(head(6, int(t)) for t in node.tag.split())
    if node.kind == SEQUENCE:
        return tags + head(4, len(node.items)) + b"".join(encode(c, canonical) for c in node.items)
    if node.kind == MAPPING:
        pairs = [(encode(k, canonical), encode(v, canonical)) for k, v in node.pairs()]
        if canonical:
            pairs.sort(key=lambda p: p[0])
        return tags + head(5, len(pairs)) + b"".join(k + v for k, v in pairs)
    i, d, b = typed(node)
    if node.tag_id == R.NULL:
        return tags + b"\xf6"
    if b is not None:
        return tags + (b"\xf5" if b else b"\xf4")
    if i is not None:
        return tags + (head(0, i) if i >= 0 else head(1, -1 - i))
    if d is not None:
        return tags + float_bytes(d)
    if node.tag_id == R.BINARY and not node.tag:
        import base64

        raw = base64.b64decode(node.text)
        return tags + head(2, len(raw)) + raw
    raw = node.text.encode("utf-8")
    return tags + head(3, len(raw)) + raw


def encode_sequence(nodes: list[Node], canonical: bool = False) -> bytes:
    return b"".join(encode(n, canonical) for n in nodes)


def to_json_text(data: bytes, strict: bool = False) -> str:
    return to_json(decode(data, strict))
