"""Validation of trees: the rules of a typing family, and JSON Schema 2020-12.

Diagnostics are rows (code, name, path, detail, line, col). A compiled schema is plain
data and may be broadcast; evaluation is a pure function of schema and instance.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from urllib.parse import unquote, urldefrag, urljoin

from docengine.functions import resolve as R
from docengine.functions import yamlparse as Y
from docengine.functions.tree import ALIAS, MAPPING, SCALAR, SEQUENCE, Node, canonical, load_yaml, pointer, typed

# Diagnostic codes.
CODES = (
    "NONE TAG_MISMATCH KEY_NOT_STRING NON_JSON_TYPE DUPLICATE_KEY TYPE REQUIRED ENUM CONST PATTERN MINIMUM MAXIMUM EXCLUSIVE_MINIMUM "
    "EXCLUSIVE_MAXIMUM MIN_LENGTH MAX_LENGTH MIN_ITEMS MAX_ITEMS UNIQUE_ITEMS ADDITIONAL_PROPERTY ANY_OF ONE_OF NOT REF FALSE_SCHEMA DEPTH "
    "LIMIT MULTIPLE_OF MIN_PROPERTIES MAX_PROPERTIES CONTAINS MIN_CONTAINS MAX_CONTAINS DEPENDENT_REQUIRED UNEVALUATED_PROPERTY UNEVALUATED_ITEM"
).split()
CODE = {name: i for i, name in enumerate(CODES)}
MAX_REPORT = 256
MAX_CHAIN = 64


@dataclass
class Report:
    """Diagnostics; ``most`` rows, paths of ``path_chars`` and details of ``detail_chars``, None for all."""

    rows: list[dict] = field(default_factory=list)
    prefix: str = ""
    most: int | None = MAX_REPORT
    path_chars: int | None = 255
    detail_chars: int | None = 127

    def add(self, name: str, node: Node | None, path: str, detail: str) -> None:
        if self.most is not None and len(self.rows) >= self.most:
            # the last place tells that more were found
            self.rows[-1] = {"code": CODE["LIMIT"], "name": "LIMIT", "path": "", "detail": "more were found", "line": 0, "col": 0}
            return
        line, col = (node.line, node.col) if node is not None else (0, 0)
        self.rows.append({"code": CODE[name], "name": name, "path": (self.prefix + path)[: self.path_chars], "detail": detail[: self.detail_chars], "line": line, "col": col})


def with_paths(root: Node):
    """(node, path, is key) in preorder; aliases are not followed."""
    stack = [(root, "", False)]
    while stack:
        node, path, is_key = stack.pop()
        yield node, path, is_key
        below = []
        if node.kind == SEQUENCE:
            below = [(c, f"{path}/{i}", False) for i, c in enumerate(node.items)]
        elif node.kind == MAPPING:
            for k, v in node.pairs():
                at = f"{path}/{pointer(k.real().text)}"
                below += [(k, at, True), (v, at, False)]
        stack.extend(reversed(below))


def check_family(root: Node, family: str, report: Report) -> None:
    """Explicit tags that contradict their content, repeated keys, and for ``json`` what JSON has not."""
    for node, path, is_key in with_paths(root):
        if node.kind == SCALAR and node.tag is not None and node.tag_id in (R.INT, R.FLOAT, R.BOOL, R.NULL):
            found = R.resolve(node.text, family)
            if found != node.tag_id and not (node.tag_id == R.FLOAT and found == R.INT):
                report.add("TAG_MISMATCH", node, path, f"the tag {R.TAG_NAMES[node.tag_id]} does not fit the content")
        if node.kind == MAPPING:
            seen = set()
            for k, _ in node.pairs():
                name = canonical(k)
                if name in seen:
                    report.add("DUPLICATE_KEY", k, f"{path}/{pointer(k.real().text)}", "an equal key stands before")
                seen.add(name)
        if family == "json":
            if is_key and (node.real().kind != SCALAR or node.real().tag_id != R.STR):
                report.add("KEY_NOT_STRING", node, path, "a key must be a string")
            elif node.kind == SCALAR and not is_key:
                odd = node.tag_id in (R.TIMESTAMP, R.BINARY, R.MERGE, R.VALUE, R.CUSTOM)
                if odd or (node.style == Y.PLAIN and node.tag is None and node.tag_id == R.STR):
                    report.add("NON_JSON_TYPE", node, path, "JSON has no such scalar")


def validate_family(data, family: str = "core") -> list[dict]:
    """Diagnostics of a stream under a family other than compat."""
    if family not in ("core", "json", "full"):
        raise ValueError(f"no validation for family {family!r}")
    roots, report = load_yaml(data, family), Report()
    for i, root in enumerate(roots):
        report.prefix = f"/{i}" if len(roots) > 1 else ""
        check_family(root, family, report)
    return report.rows


# regular expressions: the ECMA subset that needs no backtracking


class BadPattern(ValueError):
    pass


SPACE_CLASS = "\\t\\n\\x0b\\x0c\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def translate(pattern: str) -> str:
    """An ECMA pattern in the dialect of the ``regex`` module; look-around and back references are refused."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise BadPattern("a lone backslash")
            d = pattern[i + 1]
            i += 2
            if d in "dDwW":
                body = "0-9" if d in "dD" else "A-Za-z0-9_"
                out.append(body if in_class and d.islower() else f"[{'^' if d.isupper() else ''}{body}]")
            elif d in "sS":
                out.append(SPACE_CLASS if in_class and d == "s" else f"[{'^' if d == 'S' else ''}{SPACE_CLASS}]")
            elif d in "pP":
                m = re.compile(r"\{([^}]*)\}").match(pattern, i)
                names = {"Letter": "L", "L": "L", "digit": "Nd", "Nd": "Nd"}
                if not m or m[1] not in names:
                    raise BadPattern("unknown property")
                out.append(f"\\{d}{{{names[m[1]]}}}")
                i = m.end()
            elif d == "c" and i < len(pattern) and pattern[i].isalpha():
                out.append(f"\\x{ord(pattern[i]) % 32:02x}")
                i += 1
            elif d in "ux":
                m = re.compile(r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})" if d == "u" else r"([0-9a-fA-F]{2})").match(pattern, i)
                if m:
                    out.append(re.escape(chr(int(next(g for g in m.groups() if g), 16))))
                    i = m.end()
                else:
                    out.append(d)
            elif d.isdigit() and d != "0":
                raise BadPattern("a back reference")
            elif d in "bB" and not in_class:
                word = "[A-Za-z0-9_]"
                at = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
                out.append(at if d == "b" else f"(?!{at})")
            elif d in "nrtvf0":
                out.append({"n": "\\n", "r": "\\r", "t": "\\t", "v": "\\x0b", "f": "\\x0c", "0": "\\x00"}[d])
            else:
                out.append(re.escape(d))
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else "\\&" if c == "&" else "\\~" if c == "~" else "\\|" if c == "|" else c)
        elif c == "[":
            in_class = True
            if pattern.startswith("[^", i):
                out.append("[^")
                i += 1
            else:
                out.append("[")
            if pattern[i + 1 : i + 2] == "]":
                raise BadPattern("an empty class")
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            if pattern[i + 2 : i + 3] != ":":
                raise BadPattern("look-around")
            out.append("(?:")
            i += 2
        elif c == "(":
            out.append("(?:")
        elif c == "$":
            out.append("\\Z")
        elif c == "^":
            out.append("\\A")
        elif c == ".":
            out.append("[^\\n\\r\\u2028\\u2029]")
        else:
            out.append(c)
        i += 1
    return "".join(out)


_patterns: dict = {}


def pattern_of(text: str):
    """Compiled pattern, None if it is refused: its keyword is then ignored."""
    if text not in _patterns:
        import regex

        try:
            _patterns[text] = regex.compile(translate(text)) if len(text.encode()) <= 1024 else None
        except (BadPattern, regex.error):
            _patterns[text] = None
    return _patterns[text]


# JSON Schema


IN_PLACE = ("allOf", "anyOf", "oneOf")
SUB_MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
SUB_LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
SUB_ONE = ("items", "contains", "not", "if", "then", "else", "additionalProperties", "propertyNames", "unevaluatedProperties", "unevaluatedItems")


@dataclass
class Schema:
    root: object
    resources: dict
    bases: dict
    anchors: dict
    dynamic: set


def compile_schema(source, remotes: dict | None = None) -> Schema:
    """A schema given as JSON or YAML text, or as Python data; its identifiers are crawled once."""
    if isinstance(source, str | bytes):
        from docengine.functions.tree import to_json

        roots = load_yaml(source)
        source = json.loads(to_json(roots[0])) if roots else True
    schema = Schema(source, {}, {}, {}, set())

    def crawl(node, base: str) -> None:
        if isinstance(node, list):
            for c in node:
                crawl(c, base)
            return
        if not isinstance(node, dict):
            return
        if isinstance(node.get("$id"), str):
            base = urljoin(base, urldefrag(node["$id"])[0])
            schema.resources[base] = node
        schema.bases[id(node)] = base
        for word in ("$anchor", "$dynamicAnchor"):
            if isinstance(node.get(word), str):
                schema.anchors[base, node[word]] = node
                if word == "$dynamicAnchor":
                    schema.dynamic.add((base, node[word]))
        for word in SUB_MAPS:
            if isinstance(node.get(word), dict):
                for c in node[word].values():
                    crawl(c, base)
        for word in SUB_LISTS:
            if isinstance(node.get(word), list):
                crawl(node[word], base)
        for word in SUB_ONE:
            crawl(node.get(word), base)

    schema.resources[""] = source
    crawl(source, "")
    for uri, other in (remotes or {}).items():
        schema.resources.setdefault(uri, other)
        crawl(other, uri)
    return schema


def resolve_reference(schema: Schema, base: str, ref: str):
    """(target, its base), or None."""
    uri, fragment = urldefrag(urljoin(base, ref) if not ref.startswith("#") else base + ref)
    if uri not in schema.resources:
        return None
    node = schema.resources[uri]
    if fragment and not fragment.startswith("/"):
        found = schema.anchors.get((uri, unquote(fragment)))
        return None if found is None else (found, uri)
    for part in unquote(fragment).split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(node, dict) and part in node:
            node = node[part]
            uri = schema.bases.get(id(node), uri) if isinstance(node, dict) else uri
        elif isinstance(node, list) and part.isdigit() and int(part) < len(node):
            node = node[int(part)]
        else:
            return None
    return node, schema.bases.get(id(node), uri) if isinstance(node, dict) else uri


def value_key(value) -> str:
    """The canonical text of Python data, as of trees."""
    from docengine.functions.tree import build

    return canonical(build(value))


class Evaluation:
    def __init__(self, schema: Schema, report: Report):
        self.schema, self.report = schema, report
        self.scope: list[str] = []
        self.chain = 0

    def probe(self, schema, node: Node, path: str, base: str, depth: int):
        """(fits, annotations) without diagnostics."""
        kept, self.report = self.report, Report()
        notes = self.apply(schema, node, path, base, depth)
        fits = not self.report.rows
        self.report = kept
        return fits, notes

    def apply(self, schema, node: Node, path: str, base: str, depth: int = 0) -> set:
        """Evaluates; returns what was evaluated: keys as texts and items as numbers."""
        node = node.real()
        notes: set = set()
        if depth > Y.MAX_DEPTH:
            self.report.add("DEPTH", None, path, "the schema nests too deep")
            return notes
        if schema is False:
            self.report.add("FALSE_SCHEMA", node, path, "the schema is false here")
        if not isinstance(schema, dict):
            return notes
        base = self.schema.bases.get(id(schema), base)
        self.scope.append(base)
        before = len(self.report.rows)
        self.references(schema, node, path, base, depth, notes)
        self.scalar_words(schema, node, path)
        self.array_words(schema, node, path, base, depth, notes)
        self.combine(schema, node, path, base, depth, notes)
        self.object_words(schema, node, path, base, depth, notes)
        self.unevaluated(schema, node, path, base, depth, notes)
        self.scope.pop()
        return notes if len(self.report.rows) == before else set()

    def references(self, schema, node, path, base, depth, notes) -> None:
        word = "$ref" if isinstance(schema.get("$ref"), str) else "$dynamicRef" if isinstance(schema.get("$dynamicRef"), str) else None
        if word is None:
            self.chain = 0
            return
        self.chain += 1
        found = None if self.chain > MAX_CHAIN else resolve_reference(self.schema, base, schema[word])
        if found is None:
            self.report.add("REF", node, path, f'$ref "{schema[word][:64]}" does not resolve')
            self.chain = 0
            return
        target, at = found
        name = unquote(urldefrag(schema[word])[1])
        if word == "$dynamicRef" and (at, name) in self.schema.dynamic:
            for outer in self.scope:
                if (outer, name) in self.schema.dynamic:
                    target, at = self.schema.anchors[outer, name], outer
                    break
        notes |= self.apply(target, node, path, at, depth + 1)
        self.chain = 0

    @staticmethod
    def kind(node: Node) -> str:
        if node.kind == MAPPING:
            return "object"
        if node.kind == SEQUENCE:
            return "array"
        if node.kind == ALIAS:
            return "null"
        i, d, b = typed(node)
        if b is not None:
            return "boolean"
        if node.tag_id == R.NULL:
            return "null"
        if i is not None or node.tag_id == R.INT and R.to_float(node.text) is not None:
            return "integer"
        return "number" if d is not None else "string"

    @staticmethod
    def number(node: Node) -> float | int | None:
        if node.kind != SCALAR:
            return None
        i, d, _ = typed(node)
        return i if i is not None else d if d is not None else R.to_float(node.text) if node.tag_id == R.INT else None

    def scalar_words(self, s, node, path) -> None:
        add = lambda name, detail: self.report.add(name, node, path, detail)
        kind, value = self.kind(node), self.number(node)
        if "type" in s:
            wanted = s["type"] if isinstance(s["type"], list) else [s["type"]]
            whole = kind == "number" and value is not None and math.isfinite(value) and float(value).is_integer()
            fits = kind in wanted or kind == "integer" and "number" in wanted or whole and "integer" in wanted
            if not fits:
                add("TYPE", f"expected {' or '.join(map(str, wanted))}, found {kind}")
        if "const" in s and value_key(s["const"]) != canonical(node):
            add("CONST", "the value is not the constant")
        if isinstance(s.get("enum"), list) and canonical(node) not in {value_key(v) for v in s["enum"]}:
            add("ENUM", "the value is none of the listed")
        if value is not None:
            limits = (("minimum", "MINIMUM", lambda b: value >= b), ("maximum", "MAXIMUM", lambda b: value <= b))
            limits += (("exclusiveMinimum", "EXCLUSIVE_MINIMUM", lambda b: value > b), ("exclusiveMaximum", "EXCLUSIVE_MAXIMUM", lambda b: value < b))
            for word, name, fits in limits:
                bound = s.get(word)
                if isinstance(bound, int | float) and not isinstance(bound, bool) and not fits(bound):
                    add(name, f"{word} is {bound}")
            step = s.get("multipleOf")
            if isinstance(step, int | float) and not isinstance(step, bool) and step > 0:
                q = float(value) / float(step) if math.isfinite(float(value)) else math.inf
                if not math.isfinite(q) or not (abs(q) >= 2.0**53 or q.is_integer()):
                    add("MULTIPLE_OF", f"no multiple of {step}")
        if kind == "string":
            size = len(node.text)
            if count(s, "minLength") is not None and size < s["minLength"]:
                add("MIN_LENGTH", f"shorter than {s['minLength']}")
            if count(s, "maxLength") is not None and size > s["maxLength"]:
                add("MAX_LENGTH", f"longer than {s['maxLength']}")
            if isinstance(s.get("pattern"), str) and (p := pattern_of(s["pattern"])) is not None and not p.search(node.text):
                add("PATTERN", "the pattern does not match")

    def array_words(self, s, node, path, base, depth, notes) -> None:
        if node.kind != SEQUENCE:
            return
        add = lambda name, detail: self.report.add(name, node, path, detail)
        items = node.items
        if count(s, "minItems") is not None and len(items) < s["minItems"]:
            add("MIN_ITEMS", f"fewer than {s['minItems']} items")
        if count(s, "maxItems") is not None and len(items) > s["maxItems"]:
            add("MAX_ITEMS", f"more than {s['maxItems']} items")
        if s.get("uniqueItems") is True:
            seen = set()
            for i, c in enumerate(items):
                name = canonical(c)
                if name in seen:
                    add("UNIQUE_ITEMS", f"items {i} and {i - 1} are equal")
                    break
                seen.add(name)
        if "contains" in s:
            hits = [i for i, c in enumerate(items) if self.probe(s["contains"], c, f"{path}/{i}", base, depth + 1)[0]]
            notes |= set(hits)
            least = count(s, "minContains")
            if len(hits) < (1 if least is None else least):
                add("CONTAINS" if least is None else "MIN_CONTAINS", "too few items fit")
            if count(s, "maxContains") is not None and len(hits) > s["maxContains"]:
                add("MAX_CONTAINS", "too many items fit")
        prefix = s.get("prefixItems") if isinstance(s.get("prefixItems"), list) else s.get("items") if isinstance(s.get("items"), list) else []
        for i, (c, sub) in enumerate(zip(items, prefix, strict=False)):
            self.apply(sub, c, f"{path}/{i}", base, depth + 1)
            notes.add(i)
        if isinstance(s.get("items"), dict | bool):
            for i in range(len(prefix), len(items)):
                self.apply(s["items"], items[i], f"{path}/{i}", base, depth + 1)
                notes.add(i)

    def combine(self, s, node, path, base, depth, notes) -> None:
        add = lambda name, detail: self.report.add(name, node, path, detail)
        for sub in s.get("allOf") if isinstance(s.get("allOf"), list) else []:
            notes |= self.apply(sub, node, path, base, depth + 1)
        for word, name in (("anyOf", "ANY_OF"), ("oneOf", "ONE_OF")):
            if isinstance(s.get(word), list):
                tried = [self.probe(sub, node, path, base, depth + 1) for sub in s[word]]
                hits = [n for fits, n in tried if fits]
                if not hits or word == "oneOf" and len(hits) > 1:
                    add(name, f"{len(hits)} of the schemas fit")
                for n in hits:
                    notes |= n
        if "not" in s and self.probe(s["not"], node, path, base, depth + 1)[0]:
            add("NOT", "the schema under not fits")
        if "if" in s:
            fits, n = self.probe(s["if"], node, path, base, depth + 1)
            notes |= n if fits else set()
            branch = "then" if fits else "else"
            if branch in s:
                notes |= self.apply(s[branch], node, path, base, depth + 1)

    def object_words(self, s, node, path, base, depth, notes) -> None:
        if node.kind != MAPPING:
            return
        add = lambda name, detail, at=path: self.report.add(name, node, at, detail)
        pairs = [(k.real(), v) for k, v in node.pairs()]
        first: dict = {}
        for k, v in pairs:
            if k.kind == SCALAR:
                first.setdefault(k.text, v)
        at = lambda name: f"{path}/{pointer(name)}"
        for name in s.get("required") if isinstance(s.get("required"), list) else []:
            if isinstance(name, str) and name not in first:
                add("REQUIRED", f"{name} is missing", at(name))
        own: set = set()
        for name, sub in s["properties"].items() if isinstance(s.get("properties"), dict) else ():
            if name in first:
                self.apply(sub, first[name], at(name), base, depth + 1)
                own.add(name)
        if count(s, "minProperties") is not None and len(pairs) < s["minProperties"]:
            add("MIN_PROPERTIES", f"fewer than {s['minProperties']} properties")
        if count(s, "maxProperties") is not None and len(pairs) > s["maxProperties"]:
            add("MAX_PROPERTIES", f"more than {s['maxProperties']} properties")
        for text, sub in s["patternProperties"].items() if isinstance(s.get("patternProperties"), dict) else ():
            if (p := pattern_of(text)) is not None:
                for k, v in pairs:
                    if k.kind == SCALAR and p.search(k.text):
                        self.apply(sub, v, at(k.text), base, depth + 1)
                        own.add(k.text)
        if "propertyNames" in s:
            for k, _ in pairs:
                self.apply(s["propertyNames"], Node(SCALAR, k.text, style=Y.DOUBLE, line=k.line, col=k.col), at(k.text), base, depth + 1)
        for name, needs in s["dependentRequired"].items() if isinstance(s.get("dependentRequired"), dict) else ():
            for need in needs if name in first and isinstance(needs, list) else ():
                if need not in first:
                    add("DEPENDENT_REQUIRED", f"{name} needs {need}")
        for name, sub in s["dependentSchemas"].items() if isinstance(s.get("dependentSchemas"), dict) else ():
            if name in first:
                notes |= self.apply(sub, node, path, base, depth + 1)
        if "additionalProperties" in s:
            for k, v in pairs:
                if k.text not in own:
                    if s["additionalProperties"] is False:
                        # named by its object, not by its key
                        add("ADDITIONAL_PROPERTY", f"{k.text} is not allowed")
                    else:
                        self.apply(s["additionalProperties"], v, at(k.text), base, depth + 1)
            own |= {k.text for k, _ in pairs}
        notes |= own

    def unevaluated(self, s, node, path, base, depth, notes) -> None:
        for word, kind, name in (("unevaluatedProperties", MAPPING, "UNEVALUATED_PROPERTY"), ("unevaluatedItems", SEQUENCE, "UNEVALUATED_ITEM")):
            if word not in s or node.kind != kind:
                continue
            rest = [(k.real().text, v) for k, v in node.pairs()] if kind == MAPPING else list(enumerate(node.items))
            for key, value in rest:
                if key in notes:
                    continue
                at = f"{path}/{pointer(str(key))}"
                if s[word] is False:
                    self.report.add(name, value, at, f"{key} was not evaluated")
                else:
                    self.apply(s[word], value, at, base, depth + 1)
                notes.add(key)


def count(s: dict, word: str):
    value = s.get(word)
    return value if isinstance(value, int | float) and not isinstance(value, bool) and value >= 0 else None


def validate_tree(schema: Schema, roots: list[Node], most: int | None = MAX_REPORT, path_chars: int | None = 255, detail_chars: int | None = 127) -> list[dict]:
    """Diagnostics of each document of a stream against a compiled schema; None in place of a limit gives all."""
    report = Report(most=most, path_chars=path_chars, detail_chars=detail_chars)
    for i, root in enumerate(roots):
        report.prefix = f"/{i}" if len(roots) > 1 else ""
        Evaluation(schema, report).apply(schema.root, root, "", "")
    return report.rows


def validate(schema, data) -> list[dict]:
    compiled = schema if isinstance(schema, Schema) else compile_schema(schema)
    return validate_tree(compiled, load_yaml(data))


class Registry:
    """Schemas by tag: every node with a registered tag is validated against its schema."""

    def __init__(self):
        self.schemas: dict[str, Schema] = {}

    def register(self, tag: str, schema) -> None:
        self.schemas[tag] = schema if isinstance(schema, Schema) else compile_schema(schema)

    def lookup(self, tag: str) -> Schema | None:
        return self.schemas.get(tag)

    def validate(self, data, family: str = "core") -> list[dict]:
        roots, report = load_yaml(data, family), Report()
        for i, root in enumerate(roots):
            report.prefix = f"/{i}" if len(roots) > 1 else ""
            check_family(root, family, report)
            for node, path, _ in with_paths(root):
                if node.tag is not None and (schema := self.lookup(node.tag)) is not None:
                    Evaluation(schema, report).apply(schema.root, node, path, "")
        return report.rows


def output_unit(rows: list[dict]) -> str:
    """The "basic" output of JSON Schema."""
    if not rows:
        return '{"valid":true}'
    errors = [{"instanceLocation": r["path"], "keyword": r["name"], "error": r["detail"]} for r in rows]
    return json.dumps({"valid": False, "errors": errors}, separators=(",", ":"))
