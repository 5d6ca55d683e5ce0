"""Trees to text: YAML by recorded styles or in canonical form, and JSON in its shapes."""

from __future__ import annotations

import json
import re

from docengine.functions import resolve as R
from docengine.functions import yamlparse as Y
from docengine.functions.tree import ALIAS, MAPPING, SCALAR, SEQUENCE, Node, quote, scalar_json, to_json

FORCED = re.compile("[\x00-\x08\x0b-\x1f\x7f\x85\ufeff\u2028\u2029\ufffe\uffff\r]")


def json_compact(node: Node) -> str:
    return to_json(node)


def json_spaced(node: Node) -> str:
    return to_json(node, ": ", ", ")


def json_pretty(node: Node, unit: str = "  ") -> str:
    def lines(node: Node, pad: str) -> str:
        node = node.real()
        if node.kind == SCALAR:
            return scalar_json(node)
        if not node.items:
            return "[]" if node.kind == SEQUENCE else "{}"
        deep = pad + unit
        if node.kind == SEQUENCE:
            body = [deep + lines(c, deep) for c in node.items]
            return "[\n" + ",\n".join(body) + f"\n{pad}]"
        name = lambda k: quote(k.text if k.kind == SCALAR else to_json(k))
        body = [f"{deep}{name(k.real())}: {lines(v, deep)}" for k, v in node.pairs()]
        return "{\n" + ",\n".join(body) + f"\n{pad}}}"

    return lines(node, "") + "\n"


def double_quoted(text: str) -> str:
    """YAML's double-quoted form."""
    short = {v: "\\" + k for k, v in Y.ESCAPES.items() if k not in "\t /"}
    out = []
    for c in text:
        if c in short:
            out.append(short[c])
        elif FORCED.match(c) or not c.isprintable() and c != " ":
            n = ord(c)
            out.append(f"\\x{n:02X}" if n < 256 else f"\\u{n:04X}" if n < 65536 else f"\\U{n:08X}")
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def plain_safe(text: str, in_flow: bool = False) -> bool:
    """Whether a text may stand plain."""
    if not text or text != text.strip(" \t") or "\n" in text or FORCED.search(text) or "\t" in text:
        return False
    if re.match(r"[#,\[\]{}&*!|>'\"%@`]", text) or re.match(r"[-?:](\s|\Z)", text) or text.startswith(("---", "...")):
        return False
    if ": " in text or text.endswith(":") or " #" in text:
        return False
    return not (in_flow and re.search(r"[,\[\]{}]|:(?=[,\[\]{}])|\A[?:-]", text))


def single_safe(text: str) -> bool:
    return "\n" not in text and not FORCED.search(text) and "\t" not in text


def literal_safe(text: str) -> bool:
    return bool(text.strip("\n")) and not FORCED.search(text) and not re.search(r"[ \t](\n|\Z)", text) and text.rstrip("\n") != ""


def props(node: Node) -> str:
    out = ""
    if node.anchor is not None:
        out += f"&{node.anchor} "
    if node.tag is not None:
        out += tag_text(node.tag) + " "
    return out


def tag_text(tag: str) -> str:
    if tag == "!":
        return "!"
    if tag.startswith(R.PREFIX) and re.fullmatch(r"[0-9A-Za-z_.-]+", tag.removeprefix(R.PREFIX)):
        return "!!" + tag.removeprefix(R.PREFIX)
    return tag if re.fullmatch(r"![0-9A-Za-z_.:/-]+", tag) else f"!<{tag}>"


def canonical_scalar(node: Node) -> str:
    """Typed words, shortest numbers, quoted strings."""
    from docengine.functions.tree import typed

    i, d, b = typed(node)
    if node.tag_id == R.NULL:
        return "~"
    if b is not None:
        return "true" if b else "false"
    if i is not None:
        return str(i)
    if d is not None:
        return R.shortest(d)
    if node.tag_id in (R.INT, R.TIMESTAMP) and node.style == Y.PLAIN:
        return node.text
    return double_quoted(node.text)


def canonical(node: Node) -> str:
    if node.kind == ALIAS:
        return "*" + node.text + " "
    head = props(node)
    if node.kind == SCALAR:
        return head + (double_quoted(node.text) if node.tag is not None else canonical_scalar(node))
    if node.kind == SEQUENCE:
        return head + "[" + ", ".join(map(canonical, node.items)) + "]"
    return head + "{" + ", ".join(f"{canonical(k)}: {canonical(v)}" for k, v in node.pairs()) + "}"


class Writer:
    """Block YAML by the styles that the tree has recorded."""

    def __init__(self, indent: int = 2, width: int = 80):
        self.indent = indent if 2 <= indent <= 9 else 2
        self.width = 0 if width < 0 else 80 if width <= 2 * self.indent else width

    def text(self, node: Node, pad: int, in_flow: bool, is_key: bool = False) -> str:
        """A scalar, without its properties."""
        t = node.text
        if node.style in (Y.LITERAL, Y.FOLDED) and not in_flow and not is_key and literal_safe(t):
            return self.literal(t, pad)
        if t == "" and node.style == Y.PLAIN:
            return '""' if is_key and node.tag is None and node.anchor is None and not node.items and node.tag_id == R.STR else "~" if in_flow else ""
        if node.style == Y.DOUBLE or FORCED.search(t) or "\n" in t or "\t" in t:
            return double_quoted(t)
        if node.style == Y.PLAIN and plain_safe(t, in_flow):
            return t
        return "'" + t.replace("'", "''") + "'" if single_safe(t) else double_quoted(t)

    def literal(self, text: str, pad: int) -> str:
        body = text.rstrip("\n")
        tail = len(text) - len(body)
        chomp = "-" if tail == 0 else "" if tail == 1 else "+"
        hint = str(self.indent) if body[:1] in " \n" and body.lstrip("\n")[:1] == " " else ""
        lines = [" " * pad + x if x else "" for x in body.split("\n")]
        return f"|{hint}{chomp}\n" + "\n".join(lines) + "\n" * max(0, tail - 1)

    def flow(self, node: Node, pad: int) -> str:
        if node.kind == ALIAS:
            return "*" + node.text
        head = props(node)
        if node.kind == SCALAR:
            out = self.text(node, pad, True)
            return (head + out).rstrip(" ") if head else out
        opens, ends = ("[", "]") if node.kind == SEQUENCE else ("{", "}")
        if node.kind == SEQUENCE:
            parts = [self.flow(c, pad) for c in node.items]
        else:
            parts = [f"{self.flow(k, pad)}{' ' if k.kind == ALIAS else ''}: {self.flow(v, pad)}".rstrip(" ") for k, v in node.pairs()]
        line, out, col = "", [], pad
        for k, p in enumerate(parts):
            piece = p + ("," if k < len(parts) - 1 else "")
            if self.width and line and col + len(line) + 1 + len(piece) > self.width:
                out.append(line)
                line, col = piece, pad
            else:
                line = f"{line} {piece}" if line else piece
        out.append(line)
        return head + opens + ("\n" + " " * pad).join(out) + ends

    def block(self, node: Node, pad: int) -> str:
        """What follows an indicator or marker: on its line, or from the next line on, without a last break."""
        if node.kind == ALIAS:
            return " *" + node.text
        head = props(node).rstrip(" ")
        head = f" {head}" if head else ""
        if node.kind == SCALAR:
            out = self.text(node, max(pad, self.indent if pad < 0 else pad), False)
            return f"{head} {out}" if out else head
        if node.flow or not node.items:
            out = self.flow(node, pad if pad > 0 else self.indent)
            return f" {out}"
        lines = self.entries(node, max(pad, 0))
        return head + "\n" + lines

    def entries(self, node: Node, pad: int) -> str:
        lead = " " * pad
        if node.kind == SEQUENCE:
            return "\n".join(f"{lead}-{self.item(c, pad)}" for c in node.items)
        out = []
        for k, v in node.pairs():
            real = k
            if real.kind in (SEQUENCE, MAPPING) and not real.flow and real.items or real.kind == SCALAR and "\n" in real.text and real.style in (Y.LITERAL, Y.FOLDED):
                out.append(f"{lead}?{self.item(k, pad)}\n{lead}:{self.item(v, pad)}")
                continue
            name = "*" + k.text + " " if k.kind == ALIAS else self.flow(k, pad) if k.kind != SCALAR else props(k) + self.text(k, pad, False, True)
            under = pad if v.kind == SEQUENCE and not v.flow else pad + self.indent
            bare = k.kind == SCALAR and k.text == "" and k.style == Y.PLAIN  # properties alone need the space before the colon
            out.append(f"{lead}{name if bare or k.kind == ALIAS else name.rstrip(' ')}:{self.block(v, under)}")
        return "\n".join(out)

    def item(self, node: Node, pad: int) -> str:
        """After '-' or '?': a collection without properties begins on the indicator's line."""
        deep = pad + self.indent
        if node.kind in (SEQUENCE, MAPPING) and node.items and not node.flow and not props(node):
            body = self.entries(node, deep)
            return " " * (self.indent - 1) + body[deep:]
        return self.block(node, deep)


def yaml_text(roots: list[Node], canonical_form: bool = False, explicit_start: bool = False, indent: int = 2, width: int = 80) -> str:
    """A stream of documents."""
    out, many = [], len(roots) > 1
    for root in roots:
        if canonical_form:
            out.append(f"---\n{canonical(root).rstrip(' ')}\n")
            continue
        writer = Writer(indent, width)
        body = writer.block(root, -1 if root.kind == SCALAR else 0)
        if many or explicit_start:
            out.append("---" + body + "\n")
        else:
            out.append((body[1:] if body[:1] in " \n" else body) + "\n")
        if root.kind == SCALAR and root.style in (Y.LITERAL, Y.FOLDED) and out[-1].endswith("\n\n") and not root.text.endswith("\n\n"):
            out[-1] = out[-1][:-1]
    return "".join(out)


def escape_json(text: str) -> str:
    return json.dumps(text)[1:-1]
