"""YAML 1.2 text to events: a recursive-descent parser of the block and flow grammar.

It walks the text once, character by character, with the column as the only block
state: a node is parsed for a parent indentation, a mapping or sequence owns the column
at which it starts. A possible simple key is parsed first and becomes the first key of a
mapping if a value indicator follows on its line.

``parse(text)`` gives a list of ``Event``. Errors are ``YamlError`` with line and column
(1-based); the documents before the faulty one are still available from ``documents``.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

#: Status numbers of documents.
OK, PARSE, MEMORY, DEPTH, ENCODING, IO, ARG, UNSUPPORTED, INTERNAL, SCHEMA = range(10)
MAX_DEPTH = 1000
MAX_KEY = 1024
ANY, PLAIN, SINGLE, DOUBLE, LITERAL, FOLDED = range(6)
BLANK, BREAK = " \t", "\n\0"
FLOW_MARKS = ",[]{}"
#: Escapes of double-quoted scalars.
ESCAPES = {
    "0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b",
    " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029",
}
HEX = {"x": 2, "u": 4, "U": 8}
CORE = "tag:yaml.org,2002:"
PRINTABLE = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


class YamlError(ValueError):
    def __init__(self, message: str, line: int = 0, col: int = 0, status: int = PARSE):
        super().__init__(message)
        self.message, self.line, self.col, self.status = message, line, col, status


@dataclass(slots=True)
class Event:
    type: str
    value: str | None = None
    style: int = ANY
    flow: bool = False
    explicit: bool = False
    tag: str | None = None
    anchor: str | None = None
    line: int = 0
    col: int = 0
    end_line: int = 0
    end_col: int = 0


@dataclass
class Props:
    tag: str | None = None
    anchor: str | None = None
    at: int = -1
    #: End of the properties.
    end: int = -1

    def __bool__(self) -> bool:
        return self.tag is not None or self.anchor is not None


@dataclass
class Parser:
    text: str
    max_depth: int = MAX_DEPTH
    events: list = field(default_factory=list)

    def __post_init__(self):
        if sys.getrecursionlimit() < 20_000:
            sys.setrecursionlimit(20_000)
        raw = self.text[1:] if self.text.startswith("\ufeff") else self.text
        if m := PRINTABLE.search(raw):
            line = raw.count("\n", 0, m.start()) + 1
            raise YamlError("control characters are not allowed", line, m.start() - raw.rfind("\n", 0, m.start()))
        self.s = raw.replace("\r\n", "\n").replace("\r", "\n") + "\0"
        self.i, self.depth, self.n = 0, 0, len(self.s) - 1
        self.starts = [0]
        for m in re.finditer("\n", self.s):
            self.starts.append(m.end())
        self.handles: dict[str, str] = {}

    # places

    def column(self, i: int | None = None) -> int:
        i = self.i if i is None else i
        return i - (self.s.rfind("\n", 0, i) + 1)

    def mark(self, i: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, i)
        return line, i - self.starts[line - 1] + 1

    def fail(self, message: str, at: int | None = None, status: int = PARSE):
        raise YamlError(message, *self.mark(self.i if at is None else at), status)

    def emit(self, type_: str, start: int, end: int | None = None, **more) -> None:
        line, col = self.mark(start)
        end_line, end_col = self.mark(self.i if end is None else end)
        self.events.append(Event(type_, line=line, col=col, end_line=end_line, end_col=end_col, **more))

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > self.max_depth:
            self.fail("nesting is too deep", status=DEPTH)

    # white space

    def blanks(self) -> None:
        while self.s[self.i] in BLANK:
            self.i += 1

    def comment(self) -> None:
        """Skips blanks and a comment up to the line's end; anything else is an error of the caller's line."""
        start = self.i
        self.blanks()
        if self.s[self.i] == "#" and (self.i > start or self.i == 0 or self.s[self.i - 1] in " \t\n"):
            self.i = self.s.find("\n", self.i)
            if self.i < 0:
                self.i = self.n

    def at_marker(self, i: int | None = None) -> bool:
        i = self.i if i is None else i
        return self.s[i : i + 3] in ("---", "...") and self.s[i + 3] in " \t\n\0" and (i == 0 or self.s[i - 1] == "\n")

    def space(self) -> bool:
        """Skips blanks, comments and line breaks up to content; true if a line ended. Stops at a document marker."""
        ended = False
        while True:
            self.comment()
            if self.s[self.i] != "\n":
                return ended
            self.i += 1
            ended = True
            if self.at_marker():
                return True

    def done(self) -> bool:
        return self.i >= self.n or self.at_marker()

    def is_indicator(self, mark: str, i: int | None = None) -> bool:
        i = self.i if i is None else i
        return self.s[i] == mark and self.s[i + 1] in " \t\n\0"

    def tab_indented(self) -> bool:
        line = self.s.rfind("\n", 0, self.i) + 1
        return "\t" in self.s[line : self.i] and not self.s[line : self.i].strip()

    # stream and documents

    def parse(self) -> list[Event]:
        for _ in self.documents():
            pass
        return self.events

    def documents(self):
        """Parses on document by document; yields the number of documents so far."""
        self.emit("stream+", 0, 0)
        count, open_end = 0, True
        while True:
            self.handles = {"!": "!", "!!": CORE}
            version = directives = False
            while True:
                self.space()
                if self.s[self.i] == "\ufeff":
                    self.i += 1
                    continue
                if self.s.startswith("...", self.i) and self.at_marker():
                    if directives:
                        self.fail("did not find expected <document start>")
                    self.i += 3
                    self.end_of_line()
                    open_end = True
                    continue
                if self.s[self.i] == "%" and self.column() == 0:
                    if not open_end:
                        self.fail("a directive must follow a document end marker")
                    version = self.directive(version)
                    directives = True
                    continue
                break
            if self.i >= self.n:
                if directives:
                    self.fail("did not find expected <document start>")
                break
            start = self.i
            explicit = self.at_marker()
            if not explicit and (directives or not open_end):
                self.fail("did not find expected <document start>")
            first = len(self.events)
            if explicit:
                self.i += 3
            self.emit("doc+", start, explicit=explicit)
            self.depth = 0
            self.root(explicit)
            self.space()
            end = self.i
            closed = self.s.startswith("...", self.i) and self.at_marker()
            if not self.done():
                self.fail("did not find expected <document start>")
            if closed:
                self.i += 3
                self.end_of_line()
            open_end = closed
            self.emit("doc-", end, explicit=closed)
            self.check_aliases(first)
            count += 1
            yield count
        self.emit("stream-", self.i)

    def end_of_line(self) -> None:
        self.comment()
        if self.s[self.i] not in BREAK:
            self.fail("unexpected text after a document marker")

    def directive(self, version: bool) -> bool:
        end = self.s.find("\n", self.i)
        end = self.n if end < 0 else end
        words = re.sub(r"(^|[ \t])#.*", "", self.s[self.i : end]).split()
        if words[0] == "%YAML":
            if version or len(words) != 2 or not re.fullmatch(r"\d+\.\d+", words[1]):
                self.fail("bad %YAML directive")
            version = True
        elif words[0] == "%TAG":
            if len(words) != 3 or not re.fullmatch(r"!([0-9A-Za-z-]*!)?", words[1]):
                self.fail("bad %TAG directive")
            self.handles[words[1]] = words[2]
        self.i = end
        return version

    def check_aliases(self, first: int) -> None:
        known = set()
        for e in self.events[first:]:
            if e.type == "ali":
                if e.value not in known:
                    raise YamlError(f"undefined alias {e.value}", e.line, e.col)
            elif e.anchor is not None:
                known.add(e.anchor)

    def root(self, explicit: bool) -> None:
        self.node(-1, inline=explicit, compact=False, header=explicit)

    # block nodes

    def empty(self, props: Props, at: int) -> None:
        at = props.at if props else at
        self.emit("val", at, props.end if props else at, value="", style=PLAIN, tag=props.tag, anchor=props.anchor)

    def node(self, parent: int, inline: bool, compact: bool, seq_at: int | None = None, header: bool = False) -> None:
        """A block node under ``parent`` indentation.

        inline: the cursor stands after an indicator on its line. compact: a collection may begin there.
        seq_at: a column at which a sequence may stand although it is not deeper than the parent.
        """
        props, began = Props(), self.i
        ended = self.space() or not inline
        own_line = ended  # the node begins a line of its own
        at_key = None
        while True:
            if self.done():
                return self.empty(props, began)
            col = self.column()
            if ended and col <= parent and not (seq_at == col and self.is_indicator("-")):
                return self.empty(props, began)
            c = self.s[self.i]
            if ended and c not in "[{" and self.tab_indented():
                # behind enough spaces a tab may separate a scalar, but never indent a collection
                line = self.s.rfind("\n", 0, self.i) + 1
                lead = len(self.s[line : self.i]) - len(self.s[line : self.i].lstrip(" "))
                if lead <= parent or self.is_indicator("-") or self.is_indicator("?") or self.key_follows():
                    self.fail("found a tab where indentation is expected")
            if c not in "&!":
                break
            # properties: of a simple key on this line, or of the node
            start = self.i
            fresh = self.properties()
            after = self.i
            same = not self.space()
            if same and not self.done() and (own_line or compact) and self.key_follows():
                at_key = start
                self.i = start
                break
            if (fresh.tag is not None and props.tag is not None) or (fresh.anchor is not None and props.anchor is not None):
                self.fail("a node has two tags or two anchors", start)
            if props.at < 0:
                props.at = start
            props.tag, props.anchor, props.end = fresh.tag or props.tag, fresh.anchor or props.anchor, after
            if same:
                if not self.done() and self.is_indicator("-") or (not self.done() and self.is_indicator("?")):
                    self.fail("a block collection may not follow properties on their line")
                inline_props = True
            else:
                ended = own_line = True
                inline_props = False
            if inline_props:
                own_line = False
                compact = compact and ended
        col = self.column() if at_key is None else self.column(at_key)
        fits = own_line or compact
        if compact and not own_line and self.tab_before(began) and (self.is_indicator("-") or self.is_indicator("?") or self.key_follows()):
            self.fail("a tab may not indent a block collection")
        if self.is_indicator("-"):
            if not fits:
                self.fail("a block sequence may not begin here")
            return self.sequence(col, props)
        if self.is_indicator("?") or (self.s[self.i] == ":" and self.s[self.i + 1] in " \t\n\0"):
            if not fits:
                self.fail("a block mapping may not begin here")
            return self.mapping(col, props)
        if self.s[self.i] in "|>":
            return self.block_scalar(parent, props)
        if self.key_follows():
            if not fits or (header and not own_line):
                self.fail("a block mapping may not begin here")
            return self.mapping(col, props)
        self.content(parent, props)
        self.line_rest()

    def tab_before(self, began: int) -> bool:
        return "\t" in self.s[began : self.i]

    def line_rest(self) -> None:
        """After a flow or scalar node: nothing but a comment may follow on its line."""
        before = self.i
        self.blanks()
        if self.s[self.i] == "#" and self.i == before:
            self.fail("a comment needs a space before it")
        self.comment()
        if self.s[self.i] not in BREAK:
            self.fail("unexpected text after a node")

    def content(self, parent: int, props: Props) -> None:
        """A flow collection, alias or scalar in block context."""
        c = self.s[self.i]
        if c in "[{":
            self.flow(parent, props)
        elif c == "*":
            self.alias(props)
        elif c in "\"'":
            self.quoted(parent, props)
        else:
            self.plain(parent, props, in_flow=False)

    def key_follows(self) -> bool:
        """Whether a simple key with its value indicator stands here; the cursor stays."""
        at, count, depth = self.i, len(self.events), self.depth
        try:
            c = self.s[at]
            if c in "-?:" and self.s[at + 1] in " \t\n\0":
                return c == ":"
            if c in "|>%@`" or c in ",]}":
                return False
            while self.s[self.i] in "&!":
                self.properties()
                self.blanks()
                if self.s[self.i] in BREAK:
                    return False
            if self.s[self.i] == ":" and self.s[self.i + 1] in " \t\n\0":
                return True
            end = self.skim()
            if end is None:
                return False
            self.i = end
            self.blanks()
            if self.s[self.i] != ":" or self.s[self.i + 1] not in " \t\n\0":
                return False
            if self.i - at > MAX_KEY:
                self.fail("a simple key is too long", at)
            return True
        except YamlError:
            return False
        finally:
            self.i, self.depth = at, depth
            del self.events[count:]

    def skim(self) -> int | None:
        """End of the one-line node at the cursor, cheaply; None if it does not end on the line."""
        s, i = self.s, self.i
        line = s.find("\n", i)
        line = self.n if line < 0 else line
        c = s[i]
        if c == '"':
            m = re.compile(r'"(?:[^"\\\n]|\\[^\n])*"').match(s, i)
            return m.end() if m else None
        if c == "'":
            m = re.compile(r"'(?:[^'\n]|'')*'").match(s, i)
            return m.end() if m else None
        if c == "*":
            m = re.compile(r"\*[^ \t\n\0,\[\]{}]+").match(s, i)
            return m.end() if m else None
        if c in "[{":
            if self.s.find(":", i, line) < 0:
                return None
            self.flow(-1, Props())
            return self.i if self.i <= line else None
        return self.plain_end(i, False)

    def key(self) -> None:
        """The simple key at the cursor, with its properties, up to its value indicator."""
        props, start = Props(), self.i
        while self.s[self.i] in "&!":
            fresh = self.properties()
            if (fresh.tag is not None and props.tag is not None) or (fresh.anchor is not None and props.anchor is not None):
                self.fail("a node has two tags or two anchors", start)
            props = Props(fresh.tag or props.tag, fresh.anchor or props.anchor, start, self.i)
            self.blanks()
        if self.s[self.i] == ":" and self.s[self.i + 1] in " \t\n\0":
            self.empty(props, self.i)
        else:
            self.content(-1, props)
        self.blanks()
        if self.s[self.i] != ":":
            self.fail("could not find expected ':'")

    def sequence(self, col: int, props: Props) -> None:
        self.deeper()
        self.emit("seq+", props.at if props else self.i, props.end if props else self.i, tag=props.tag, anchor=props.anchor)
        while not self.done() and self.column() == col and self.is_indicator("-"):
            self.i += 1
            self.node(col, inline=True, compact=True)
            self.space()
            self.check_column(col)
        self.emit("seq-", self.i)
        self.depth -= 1

    def check_column(self, col: int) -> None:
        if not self.done():
            if self.column() > col:
                self.fail("bad indentation")
            if self.tab_indented() and self.s[self.i] not in "[{":
                self.fail("found a tab where indentation is expected")

    def mapping(self, col: int, props: Props) -> None:
        self.deeper()
        self.emit("map+", props.at if props else self.i, props.end if props else self.i, tag=props.tag, anchor=props.anchor)
        while not self.done() and self.column() == col:
            if self.is_indicator("?"):
                self.i += 1
                self.node(col, inline=True, compact=True, seq_at=col)
                self.space()
                if not self.done() and self.column() == col and self.is_indicator(":"):
                    self.i += 1
                    self.node(col, inline=True, compact=True, seq_at=col)
                else:
                    self.check_column(col)
                    self.empty(Props(), self.i)
            elif self.key_follows():
                self.key()
                self.i += 1
                self.node(col, inline=True, compact=False, seq_at=col)
            elif self.is_indicator("-") and self.events:
                break
            else:
                self.fail("did not find expected key")
            self.space()
            self.check_column(col)
        self.emit("map-", self.i)
        self.depth -= 1

    # properties and aliases

    def properties(self) -> Props:
        props, s = Props(at=self.i), self.s
        while s[self.i] in "&!":
            start = self.i
            if s[self.i] == "&":
                m = re.compile(r"&([^ \t\n\0,\[\]{}]+)").match(s, self.i)
                if not m or props.anchor is not None:
                    self.fail("bad anchor")
                props.anchor, self.i = m.group(1), m.end()
            else:
                if props.tag is not None:
                    self.fail("a node has two tags")
                props.tag = self.tag()
            props.end = self.i
            if s[self.i] not in " \t\n\0" and not (s[self.i] in FLOW_MARKS and self.flow_depth > 0):
                self.fail("properties need white space after them", start)
            here = self.i
            self.blanks()
            if s[self.i] not in "&!":
                self.i = here
                break
        return props

    flow_depth = 0

    def tag(self) -> str:
        s = self.s
        if s.startswith("!<", self.i):
            end = s.find(">", self.i)
            body = s[self.i + 2 : end] if end >= 0 else ""
            if not body or re.search(r"\s", body):
                self.fail("bad tag")
            self.i = end + 1
            return self.decoded(body)
        m = re.compile(r"(![0-9A-Za-z-]*!|!)((?:%[0-9A-Fa-f]{2}|[0-9A-Za-z\-#;/?:@&=+$_.~*'()])*)").match(s, self.i)
        handle, rest = m.group(1), m.group(2)
        self.i = m.end()
        if handle != "!" and not rest:
            self.fail("bad tag")
        if handle not in self.handles:
            self.fail("undefined tag handle")
        return self.handles[handle] + self.decoded(rest) if rest or handle != "!" else "!"

    def decoded(self, text: str) -> str:
        if "%" not in text:
            return text
        from urllib.parse import unquote_to_bytes

        try:
            return unquote_to_bytes(text).decode("utf-8")
        except UnicodeDecodeError:
            self.fail("bad escape in a tag")

    def alias(self, props: Props) -> None:
        m = re.compile(r"\*([^ \t\n\0,\[\]{}]+)").match(self.s, self.i)
        if not m:
            self.fail("bad alias")
        if props:
            self.fail("an alias takes no properties")
        start, self.i = self.i, m.end()
        self.emit("ali", start, value=m.group(1))

    # scalars

    def plain_end(self, i: int, in_flow: bool) -> int | None:
        """End of a plain scalar's first line, None if none may begin here."""
        s = self.s
        c, d = s[i], s[i + 1]
        if c in "-?:":
            if d in " \t\n\0" or (in_flow and d in FLOW_MARKS):
                return None
        elif c in "#&*!|>'\"%@`,[]{}\n\0":
            return None
        stop = PLAIN_STOP_FLOW if in_flow else PLAIN_STOP
        m = stop.search(s, i)
        end = m.start()
        while end > i and s[end - 1] in BLANK:
            end -= 1
        return end

    def plain(self, parent: int, props: Props, in_flow: bool) -> None:
        start, s = self.i, self.s
        end = self.plain_end(start, in_flow)
        if end is None:
            self.fail("found a character that cannot start a token")
        parts, self.i = [s[start:end]], end
        while not self.in_key:
            # a further line
            i, breaks = self.i, 0
            while s[i] in BLANK:
                i += 1
            if s[i] != "\n":
                break
            while s[i] == "\n":
                breaks += 1
                i += 1
                if self.at_marker(i):
                    break
                while s[i] in BLANK:
                    i += 1
            line = s.rfind("\n", 0, i) + 1
            if i >= self.n or s[i] == "#" or self.at_marker(line):
                break
            if len(s[line:i]) - len(s[line:i].lstrip(" ")) <= parent:
                if i - line <= parent or "\t" in s[line:i]:
                    break
            if in_flow and s[i] in FLOW_MARKS or (s[i] == ":" and (s[i + 1] in " \t\n\0" or (in_flow and s[i + 1] in FLOW_MARKS))):
                break
            m = (PLAIN_STOP_FLOW if in_flow else PLAIN_STOP).search(s, i)
            stop = m.start()
            if not in_flow and s[stop] == ":":
                # a key begins here
                self.fail("a simple key may not stand in a plain scalar", i)
            while stop > i and s[stop - 1] in BLANK:
                stop -= 1
            parts.append("\n" * (breaks - 1) if breaks > 1 else " ")
            parts.append(s[i:stop])
            self.i = stop
        self.emit("val", props.at if props else start, value="".join(parts), style=PLAIN, tag=props.tag, anchor=props.anchor)

    in_key = False

    def fold(self, parent: int, out: list) -> None:
        """Line breaks in a quoted scalar: one is a space, n are n - 1 breaks."""
        s, breaks = self.s, 0
        while s[self.i] == "\n":
            breaks += 1
            self.i += 1
            if self.at_marker():
                self.fail("a document marker in a quoted scalar")
            line = self.i
            while s[self.i] == " ":
                self.i += 1
            if s[self.i] not in "\n\0" and self.i - line <= parent:
                if s[self.i] != "\t" or parent >= 0 and self.i - line <= parent:
                    save = self.i
                    self.blanks()
                    if s[self.i] != "\n":
                        self.i = save
                        self.fail("a quoted scalar is not indented enough")
            self.blanks()
        out.append(" " if breaks == 1 else "\n" * (breaks - 1))

    def quoted(self, parent: int, props: Props) -> None:
        s, start, mark = self.s, self.i, self.s[self.i]
        self.i += 1
        out: list[str] = []
        stop = QUOTED[mark]
        while True:
            m = stop.search(s, self.i)
            end, c = m.start(), s[m.start()]
            out.append(s[self.i : end])
            self.i = end
            if c == "\0":
                if end >= self.n:
                    self.fail("a quoted scalar has no end", start)
                out.append(c)
                self.i += 1
            elif c == "\n":
                out[-1] = out[-1].rstrip(" \t")
                self.fold(parent, out)
            elif c == mark:
                self.i += 1
                if mark == "'" and s[self.i] == "'":
                    out.append("'")
                    self.i += 1
                    continue
                break
            else:
                self.escape(parent, out)
        style = SINGLE if mark == "'" else DOUBLE
        self.emit("val", props.at if props else start, value="".join(out), style=style, tag=props.tag, anchor=props.anchor)

    def escape(self, parent: int, out: list) -> None:
        s, c = self.s, self.s[self.i + 1]
        if c in ESCAPES:
            out.append(ESCAPES[c])
            self.i += 2
        elif c in HEX:
            digits = s[self.i + 2 : self.i + 2 + HEX[c]]
            if not re.fullmatch(r"[0-9A-Fa-f]{%d}" % HEX[c], digits) or int(digits, 16) > 0x10FFFF or 0xD800 <= int(digits, 16) < 0xE000:
                self.fail("bad escape")
            out.append(chr(int(digits, 16)))
            self.i += 2 + HEX[c]
        elif c == "\n":
            # an escaped break: lines are joined
            self.i += 1
            fresh: list[str] = []
            self.fold(parent, fresh)
            if fresh[0] != " ":
                out.append(fresh[0])
        else:
            self.fail("unknown escape")

    def block_scalar(self, parent: int, props: Props) -> None:
        s, start = self.s, self.i
        folded = s[self.i] == ">"
        self.i += 1
        m = re.compile(r"([1-9]?)([+-]?)([1-9]?)").match(s, self.i)
        if m.group(1) and m.group(3):
            self.fail("bad block scalar header")
        digit, chomp = m.group(1) or m.group(3), m.group(2)
        self.i = m.end()
        if s[self.i] not in " \t\n\0":
            self.fail("bad block scalar header")
        self.line_rest()
        indent = max(parent, 0) + int(digit) if digit else None
        i = self.i + 1 if s[self.i] == "\n" else self.i
        lines: list[str] = []
        deepest = 0
        while i < self.n:
            end = s.find("\n", i)
            end = self.n if end < 0 else end
            line = s[i:end]
            if self.at_marker(i):
                break
            lead = len(line) - len(line.lstrip(" "))
            if lead == len(line):
                # blank line
                if indent is None:
                    deepest = max(deepest, lead)
                    lines.append("")
                else:
                    lines.append(line[indent:])
            else:
                if indent is None:
                    if lead <= parent:
                        if line[lead] == "\t":
                            self.fail("found a tab where indentation is expected", i)
                        break
                    if deepest > lead:
                        self.fail("a leading blank line is indented deeper than the block scalar", i)
                    indent = lead
                if lead < indent:
                    if line[lead] == "\t" and lead > parent:
                        self.fail("found a tab where indentation is expected", i)
                    break
                lines.append(line[indent:])
            i = end + 1
            if end >= self.n:
                break
        self.i = min(i, self.n)
        body, tail = lines[:], 0
        while body and body[-1] == "":
            body.pop()
            tail += 1
        text = self.folded(body) if folded else "\n".join(body)
        if chomp == "+":
            text += "\n" * (tail + (1 if body else 0))
        elif body and chomp != "-":
            text += "\n"
        # the cursor stands at the start of the next line; step back so that it counts as a line's end
        if self.i > start and s[self.i - 1] == "\n":
            self.i -= 1
        self.emit("val", props.at if props else start, value=text, style=FOLDED if folded else LITERAL, tag=props.tag, anchor=props.anchor)

    @staticmethod
    def folded(lines: list[str]) -> str:
        """Folds lines: single breaks between lines of text are spaces; more-indented lines keep theirs."""
        out, breaks, before = [], 0, None
        for line in lines:
            if line == "":
                breaks += 1
                continue
            deep = line[0] in BLANK
            if before is None:
                out.append("\n" * breaks)
            elif deep or before:
                out.append("\n" * (breaks + 1))
            else:
                out.append("\n" * breaks if breaks else " ")
            out.append(line)
            breaks, before = 0, deep
        return "".join(out)

    # flow collections

    def flow_space(self, parent: int) -> bool:
        ended = self.space()
        if self.i >= self.n:
            self.fail("a flow collection has no end")
        if self.at_marker():
            self.fail("a document marker in a flow collection")
        if ended:
            line = self.s.rfind("\n", 0, self.i) + 1
            lead = self.s[line : self.i]
            if len(lead) - len(lead.lstrip(" ")) <= parent:
                self.fail("a flow collection is not indented enough")
        return ended

    def flow(self, parent: int, props: Props) -> None:
        self.deeper()
        self.flow_depth += 1
        start, opens = self.i, self.s[self.i]
        kind, close = ("seq", "]") if opens == "[" else ("map", "}")
        self.i += 1
        self.emit(f"{kind}+", props.at if props else start, flow=True, tag=props.tag, anchor=props.anchor)
        comma = True
        while True:
            self.flow_space(parent)
            c = self.s[self.i]
            if c == close:
                break
            if c == ",":
                if comma:
                    self.fail("did not find expected node content")
                comma = True
                self.i += 1
                continue
            if not comma:
                self.fail(f"did not find expected ',' or '{close}'")
            comma = False
            self.flow_entry(parent, kind == "map")
        self.i += 1
        self.emit(f"{kind}-", self.i - 1, flow=True)
        self.flow_depth -= 1
        self.depth -= 1

    def flow_entry(self, parent: int, in_map: bool) -> None:
        start, first = self.i, len(self.events)
        line = self.mark(start)[0]
        explicit = self.s[self.i] == "?" and self.s[self.i + 1] in " \t\n\0"
        if explicit:
            self.i += 1
            self.flow_space(parent)
        json_like = False
        if self.s[self.i] in ",]}" or self.flow_value_here(False):
            self.empty(Props(), self.i)
        else:
            json_like = self.flow_node(parent)
        key_end = self.i
        ended = self.flow_space(parent)
        if self.flow_value_here(json_like):
            if not in_map and not explicit and (ended or self.mark(key_end)[0] != line):
                self.fail("a simple key must stand on one line")
            if not in_map and key_end - start > MAX_KEY:
                self.fail("a simple key is too long", start)
            at = self.i
            self.i += 1
            self.flow_space(parent)
            if self.s[self.i] in ",]}":
                self.empty(Props(), at + 1)
            else:
                self.flow_node(parent)
            pair = True
        elif in_map or explicit:
            self.i = key_end
            self.empty(Props(), self.i)
            pair = True
        else:
            self.i = key_end
            pair = False
        if pair and not in_map:
            self.depth += 1
            self.emit("map+", start, start, flow=True)
            self.events.insert(first, self.events.pop())
            self.emit("map-", self.i, flow=True)
            self.depth -= 1

    def flow_value_here(self, json_like: bool) -> bool:
        return self.s[self.i] == ":" and (json_like or self.s[self.i + 1] in " \t\n\0,[]{}")

    def flow_node(self, parent: int) -> bool:
        """One node in a flow collection; true if it is JSON-like, so that a value may follow at once."""
        props = Props()
        if self.s[self.i] in "&!":
            props = self.properties()
            self.flow_space(parent)
            if self.s[self.i] in ",]}" or self.flow_value_here(False):
                self.empty(props, self.i)
                return False
            if self.s[self.i] in "&!":
                more = self.properties()
                if (more.tag is not None and props.tag is not None) or (more.anchor is not None and props.anchor is not None):
                    self.fail("a node has two tags or two anchors")
                props = Props(more.tag or props.tag, more.anchor or props.anchor, props.at, more.end)
                self.flow_space(parent)
                if self.s[self.i] in ",]}" or self.flow_value_here(False):
                    self.empty(props, self.i)
                    return False
        c = self.s[self.i]
        if c in "[{":
            self.flow(parent, props)
            return True
        if c in "\"'":
            self.quoted(parent, props)
            return True
        if c == "*":
            self.alias(props)
            return False
        self.plain(parent, props, in_flow=True)
        return False


PLAIN_STOP = re.compile(r":(?=[ \t\n\0])|(?<=[ \t])#|[\n\0]")
PLAIN_STOP_FLOW = re.compile(r":(?=[ \t\n\0,\[\]{}])|(?<=[ \t])#|[\n\0,\[\]{}]")
QUOTED = {"'": re.compile("['\n\0]"), '"': re.compile('["\\\\\n\0]')}


# documents in plain spelling, line by line

# characters that have no meaning inside a plain scalar, in block and flow context, or begin one
_MORE = r"A-Za-z0-9_./+$%^&*;<=>?@~()|!\-\xa1-\u2027\u202a-\ud7ff"
_START = r"(?:[A-Za-z0-9_~]|\.(?=[A-Za-z0-9])|-(?=[0-9.]*[0-9]))"
_WORD = rf"{_START}(?:[{_MORE} ]*[{_MORE}])?"
_QUOTED = r"'[ -&(-~\xa1-\u2027\u202a-\ud7ff]*'|\"[ !#-\[\]-~\xa1-\u2027\u202a-\ud7ff]*\""
#: Indent, sequence indicators, key, value of a line.
QUICK_LINE = re.compile(rf"( *)((?:- +)*)(?:({_WORD}|{_QUOTED}):(?: +|(?=\n|\Z)))?({_WORD}|{_QUOTED}|[\[{{][^\n]*[\]}}])? *(?:\n|\Z)")
#: A mark, or a scalar and whether it is a key, in a flow collection.
QUICK_FLOW = re.compile(rf" *(?:([\[\]{{}},])|({_WORD}|{_QUOTED})(: +)?)")
QUICK_DEPTH = 100


def quick(text: str) -> list[Event] | None:
    """The events of one document of block collections in which every scalar and flow collection stands on its line, in plain spelling.

    None for all else, faults among it: those are the parser's. Lines are matched whole, so there is no work for each character.
    """
    n, i, number, match = len(text), 0, 0, QUICK_LINE.match
    events = [Event("stream+", None, ANY, False, False, None, None, 1, 1, 1, 1)]
    add, stack, pending = events.append, [], None

    def scalar(raw: str, col: int) -> None:
        c = raw[0]
        if c == "'" or c == '"':
            add(Event("val", raw[1:-1], SINGLE if c == "'" else DOUBLE, False, False, None, None, number, col, number, col + len(raw)))
        else:
            add(Event("val", raw, PLAIN, False, False, None, None, number, col, number, col + len(raw)))

    while i < n:
        m = match(text, i)
        if m is None or len(stack) > QUICK_DEPTH:
            return None
        indent, dashes, key, value = m.groups()
        if key is None and value is None:
            return None
        number += 1
        at = len(indent)
        if number == 1:
            add(Event("doc+", None, ANY, False, False, None, None, 1, at + 1, 1, at + 1))
        elif not stack:
            return None
        fresh = number == 1  # a collection may begin
        if pending is not None:
            if at > stack[-1][1] or (dashes and at == stack[-1][1]):
                if not dashes and key is None:
                    return None
                fresh = True
            else:
                add(Event("val", "", PLAIN, False, False, None, None, *pending, *pending))
            pending = None
        if not fresh:
            while stack and (stack[-1][1] > at or (stack[-1][1] == at and not dashes and stack[-1][0] == "seq")):
                add(Event(stack.pop()[0] + "-", None, ANY, False, False, None, None, number, at + 1, number, at + 1))
            if not stack or stack[-1][1] != at or (stack[-1][0] == "seq") != bool(dashes):
                return None
        col = at
        if dashes:
            for d in dashes.replace("- ", "-\0").split("-")[1:]:
                if fresh:
                    add(Event("seq+", None, ANY, False, False, None, None, number, col + 1, number, col + 1))
                    stack.append(("seq", col))
                fresh = True
                col += 1 + len(d)
        if key is not None:
            if len(key) > MAX_KEY - 24:
                return None
            if fresh:
                add(Event("map+", None, ANY, False, False, None, None, number, col + 1, number, col + 1))
                stack.append(("map", col))
            scalar(key, col + 1)
            if value is None:
                after = m.end(3) - i + 2
                pending = (number, after)
                i = m.end()
                continue
        elif not dashes and (stack or value[0] not in "[{"):
            return None
        col = m.start(4) - i + 1
        if value[0] in "[{":
            if not _quick_flow(value, number, col, add):
                return None
        else:
            scalar(value, col)
        i = m.end()
    if not number:
        return None
    if pending is not None:
        add(Event("val", "", PLAIN, False, False, None, None, *pending, *pending))
    end = (number + 1, 1) if text[-1] == "\n" else (number, n - text.rfind("\n"))
    while stack:
        add(Event(stack.pop()[0] + "-", None, ANY, False, False, None, None, *end, *end))
    add(Event("doc-", None, ANY, False, False, None, None, *end, *end))
    add(Event("stream-", None, ANY, False, False, None, None, *end, *end))
    return events


def _quick_flow(text: str, line: int, col: int, add) -> bool:
    """Adds the events of a flow collection that ends with the text; false if it is not in plain spelling."""
    i, n, match, stack, want = 0, len(text), QUICK_FLOW.match, [], "open"
    while i < n:
        m = match(text, i)
        if m is None or (i and not stack):
            return False
        mark, raw, colon = m.groups()
        if raw is not None:
            in_map = stack[-1] == "map"
            # an item, or the key or value of a pair
            if want not in ("first", "next", "value") or (colon is not None) != (in_map and want != "value"):
                return False
            at, c = col + m.start(2), raw[0]
            style = SINGLE if c == "'" else DOUBLE if c == '"' else PLAIN
            add(Event("val", raw if style == PLAIN else raw[1:-1], style, False, False, None, None, line, at, line, at + len(raw)))
            want = "value" if colon is not None else "comma"
        else:
            at = col + m.start(1)
            if mark in "[{":
                if len(stack) > QUICK_DEPTH or want == "comma" or (stack and stack[-1] == "map" and want != "value"):
                    return False
                kind, want = ("seq" if mark == "[" else "map"), "first"
                stack.append(kind)
                add(Event(kind + "+", None, ANY, True, False, None, None, line, at, line, at + 1))
            elif mark == ",":
                if want != "comma":
                    return False
                want = "next"
            else:
                if want not in ("first", "comma") or stack[-1] != ("seq" if mark == "]" else "map"):
                    return False
                add(Event(stack.pop() + "-", None, ANY, True, False, None, None, line, at, line, at + 1))
                want = "comma"
        i = m.end()
    return not stack


def parse(text: str, max_depth: int = MAX_DEPTH) -> list[Event]:
    """All events of a stream; raises YamlError."""
    events = quick(text) if max_depth > 2 * QUICK_DEPTH + 4 else None
    return Parser(text, max_depth).parse() if events is None else events


def tree(events: list[Event]) -> str:
    """Events in the line notation of YAML's test suites."""
    out, depth = [], 0
    esc = lambda t: t.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t").replace("\b", "\\b").replace("\r", "\\r").replace("\0", "\\0")
    for e in events:
        if e.type[-1] == "-":
            depth -= 1
        name = {"stream": "STR", "doc": "DOC", "map": "MAP", "seq": "SEQ"}.get(e.type[:-1])
        props = (f" &{e.anchor}" if e.anchor is not None else "") + (f" <{e.tag}>" if e.tag is not None else "")
        if e.type == "ali":
            line = f"=ALI *{e.value}"
        elif e.type == "val":
            line = f"=VAL{props} {':' if e.style in (ANY, PLAIN) else chr(39) if e.style == SINGLE else chr(34) if e.style == DOUBLE else '|' if e.style == LITERAL else '>'}{esc(e.value)}"
        elif e.type == "doc+":
            line = "+DOC" + (" ---" if e.explicit else "")
        elif e.type == "doc-":
            line = "-DOC" + (" ..." if e.explicit else "")
        elif e.type[-1] == "+":
            line = f"+{name}" + (" {}" if e.flow and e.type == "map+" else " []" if e.flow and e.type == "seq+" else "") + props
        else:
            line = f"-{name}"
        out.append(" " * depth + line)
        if e.type[-1] == "+":
            depth += 1
    return "\n".join(out)
