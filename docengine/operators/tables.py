"""Columns of document text or bytes as tables: documents, events, values, nodes, diagnostics.

Each is one ``mapInArrow`` over the rows: no shuffle, memory bounded by a batch and its
largest document. The columns named in ``keep`` are repeated for each row made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docengine.functions import tree as tr
from docengine.functions import yamlparse as Y
from docengine.functions.shapes import Shapes, rows_of
from docengine.functions.cbor import CborError, decode_sequence
from docengine.functions.validate import Schema, check_family, validate_tree
from docengine.functions.validate import MAX_REPORT, Report

DOC = "doc_index int"
DOCUMENTS = "doc_index int, status int, err_line int, err_col int, err_msg string, text string"
EVENTS = DOC + ", seq int, type string, style int, flow boolean, explicit boolean, implicit boolean, tag_id int, value string, anchor string, tag string, line int, col int, end_line int, end_col int"
VALUES = DOC + ", seq int, kind string, tag_id int, is_key boolean, text string, i long, d double, b boolean"
NODES = DOC + (
    ", node_id int, parent_id int, last_id int, ord int, role string, key string, path string, depth int, kind string, style int, tag_id int, tag string, "
    "anchor string, alias_target int, text string, i long, d double, b boolean"
)
NODE_KINDS = {"val": tr.SCALAR, "ali": tr.ALIAS, "seq+": tr.SEQUENCE, "map+": tr.MAPPING}
DIAGNOSTICS = "seq int, code int, name string, path string, detail string, line int, col int"
#: Rows that an Arrow batch made here holds at most.
BATCH = 4096
#: The same, of rows that are made from shapes.
FILLED = 1 << 15
#: Rows that a task keeps of values that may come again, and the length of such values.
KEPT, SHORT = 1 << 16, 1024


def spread(df: DataFrame, least: int = 1 << 18, split: int = 8 << 20) -> DataFrame:
    """``df`` dealt over all cores, in parts of ``split`` bytes of its files at most; for callers that parse what they read.

    Parsing costs far more than moving rows, and files may have few splits, or rows in one row group, which one task reads
    however many splits there are. So parts keep their size, and a task its length, while the input grows. Sizes are what Spark
    estimates; an input of ``least`` bytes stays where it is read. No operator calls this by itself.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # as many parts for each core, so that none waits for the last
    return df.repartition(cores * max(1, -(-size // (split * cores)))) if size > least else df


class Failed(ValueError):
    """A faulty document in FAILFAST mode."""


class Filled:
    """Documents of known shapes whose rows are made together: rows of a shape are taken from its columns, then integers are set in."""

    def __init__(self, types, wanted):
        self.types, self.wanted, self.clear = types, wanted, lambda: self.__init__(types, wanted)
        self.at, self.order, self.used, self.integers, self.starts, self.n = [], [], {}, [], [], 0

    def add(self, at: int, shape, integers: list[str]) -> None:
        self.at.append(at)
        self.order.append(self.used.setdefault(id(shape), (len(self.used), shape))[0])
        self.starts.append(len(self.integers))
        self.integers += integers
        self.n += shape.rows

    def columns(self) -> tuple:
        """The number of the source row of each row made, and the columns."""
        import numpy as np
        import pyarrow.compute as pc

        shapes = [s for _, s in self.used.values()]
        sizes = np.array([s.rows for s in shapes], np.int64)
        order = np.array(self.order, np.int64)
        counts = sizes[order]
        ends = np.cumsum(counts)
        index = np.arange(self.n) + np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - counts), counts)
        first = np.repeat(np.array(self.starts, np.int64), counts)
        texts = pa.array(self.integers, pa.string())
        out, taken = [], pa.array(index)
        for c in self.wanted:
            kind = self.types[c]
            column = pa.concat_arrays([s.columns[c] for s in shapes]).take(taken)
            if any(c in s.held for s in shapes):
                which = np.concatenate([s.held.get(c, np.full(s.rows, -1)) for s in shapes])[index]
                mask = which >= 0
                fresh = texts.take(pa.array(first[mask] + which[mask]))
                if not pa.types.is_string(kind):
                    fresh = fresh.cast(pa.int64()).cast(kind, safe=False)
                column = pc.replace_with_mask(column, pa.array(mask), fresh)
            out.append(column)
        return np.repeat(np.array(self.at, np.int64), counts), out


class Shape:
    """Rows of one shape as columns, and for each column that has integers which of them stand in it."""

    def __init__(self, made, types):
        import numpy as np

        rows, held = made
        self.rows, self.held = len(rows), {c: np.array(x, np.int64) for c, x in held.items()}
        self.columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]


def expand(
    df: DataFrame, column: str, make: Callable[[object], Iterator[dict | tuple]], schema: str, keep: list[str] | None = None, shaped: bool = False, only: list[str] | None = None
) -> DataFrame:
    """For each row of ``df`` the rows that ``make`` gives for ``column``, by name or in the order of ``schema``; ``keep`` columns are repeated.

    ``make`` depends on the value alone: the rows of short values are kept, up to ``KEPT`` of them, and a value that comes again gets the same.
    ``shaped``: integers of a text that stand as values give nothing but their own texts and values, so texts of one shape are made at once (``shapes``).
    ``only`` names the columns made that are wanted, all by default: what crosses to Spark is theirs alone.
    """
    keep = [c for c in df.columns if c != column] if keep is None else keep
    made = T.StructType.fromDDL(schema)
    wanted = [made.names.index(c) for c in only or made.names]
    clash = [c for c in keep if c in (only or made.names)]
    if clash:
        raise ValueError(f"columns {clash} are also made here; rename them first")
    source = df.select(*(f"`{c}`" for c in keep), df[column].alias("__source"))
    out = T.StructType([df.schema[c] for c in keep] + [made.fields[c] for c in wanted])
    names = made.names
    given = keep + [names[c] for c in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in made.fields]
        known: dict = {}
        held = 0
        kinds = [f.dataType.simpleString() for f in made.fields]
        built = rows_of(lambda value: ([r[n] if n in r else None for n in names] if isinstance(r, dict) else r for r in make(value)), kinds)

        def build(*of):
            found = built(*of)
            return None if found is None else Shape(found, types)

        shapes = Shapes(build, lambda s: 1 + s.rows)
        filled = Filled(types, wanted)

        def flush_filled(batch):
            at, columns = filled.columns()
            kept = [batch.column(i).take(pa.array(at)) for i in range(len(keep))]
            filled.clear()
            return pa.RecordBatch.from_arrays(kept + columns, names=given)

        def flush(batch, at, rows):
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
            as_dicts = isinstance(rows[0], dict)
            fresh = [pa.array([r.get(names[c]) for r in rows] if as_dicts else [r[c] for r in rows], types[c]) for c in wanted]
            return pa.RecordBatch.from_arrays(kept + fresh, names=given)

        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column(len(keep)).to_pylist()):
                if value is None:
                    continue
                if shaped and isinstance(value, str) and (found := shapes.find(value)) is not None:
                    filled.add(k, *found)
                    if filled.n >= FILLED:
                        yield flush_filled(batch)
                    continue
                found = known.get(value)
                if found is None:
                    found = make(value)
                    if len(value) <= SHORT and held < KEPT:
                        found = known[value] = list(found)
                        held += 1 + len(found)
                for row in found:
                    at.append(k)
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield flush(batch, at, rows)
                        at, rows = [], []
            if rows:
                yield flush(batch, at, rows)
            if filled.n:
                yield flush_filled(batch)

    return source.mapInArrow(run, out)


def decoded(value, form: str, family: str, mode: str):
    """(index, status, line, column, message, text, root) of each document of a cell."""
    if form == "json":
        try:
            found = [(0, Y.OK, None, None, None, value, tr.strict_json(tr.to_text(value), family))]
        except tr.JsonError as e:
            found = [(0, Y.PARSE, None, None, str(e), value, None)]
        except Y.YamlError as e:
            found = [(0, e.status, e.line, e.col, e.message, None, None)]
    elif form == "cbor":
        try:
            found = [(i, Y.OK, None, None, None, None, n) for i, n in enumerate(decode_sequence(bytes(value)))]
        except CborError as e:
            found = [(0, e.status, None, None, str(e), None, None)]
    else:
        found = tr.tolerant(value, family)
    for row in found:
        if row[1] != Y.OK:
            if mode == "FAILFAST":
                raise Failed(row[4])
            if mode == "DROPMALFORMED":
                continue
        yield row


def documents(df: DataFrame, column: str, form: str = "yaml", family: str = "core", mode: str = "PERMISSIVE", keep=None) -> DataFrame:
    """One row for each document of each cell; a faulty one has a status, place and message, and the next still comes."""

    def make(value):
        for i, status, line, col, message, text, _ in decoded(value, form, family, mode):
            yield {"doc_index": i, "status": status, "err_line": line, "err_col": col, "err_msg": message, "text": text if isinstance(text, str) else None}

    return expand(df, column, make, DOCUMENTS, keep)


def rows_of_roots(row_maker, form, family, mode, numbered=False):
    def make(value):
        for i, _, _, _, _, _, root in decoded(value, form, family, mode):
            if root is not None:
                for seq, row in enumerate(row_maker(root)):
                    yield (i, seq, *row) if numbered else (i, *row)

    return make


def nodes(df: DataFrame, column: str, form: str = "yaml", family: str = "core", mode: str = "PERMISSIVE", keep=None, only=None, paths=None, keys=None) -> DataFrame:
    """The trees of all documents, a row for each node, in preorder; ``only`` names the columns that are wanted.

    With ``paths`` or ``keys``, documents are read whole, but only rows that a question about them needs cross to Spark: roots,
    what stands at these paths or below them, and what has one of these keys.
    """
    make = rows_of_roots(tr.node_tuples, form, family, mode)
    if paths is not None or keys is not None:
        make = near(make, frozenset(paths or ()), frozenset(keys or ()))
    return expand(df, column, make, NODES, keep, form == "yaml", only)


def near(make, paths: frozenset, keys: frozenset):
    """Of the rows of ``NODES`` that ``make`` gives: roots, those at ``paths`` or below, and those with one of ``keys``."""
    role, key, path = (T.StructType.fromDDL(NODES).names.index(c) for c in ("role", "key", "path"))
    below = tuple(p + "/" for p in paths)

    def made(value):
        for row in make(value):
            if row[role] == "root" or row[key] in keys or row[path] in paths or row[path].startswith(below):
                yield row

    return made


def values(df: DataFrame, column: str, form: str = "yaml", family: str = "core", mode: str = "PERMISSIVE", keep=None, only=None) -> DataFrame:
    """The typed value stream of all documents."""
    return expand(df, column, rows_of_roots(tr.value_tuples, form, family, mode, True), VALUES, keep, form == "yaml", only)


def events(df: DataFrame, column: str, family: str = "core", keep=None, only=None) -> DataFrame:
    """The event stream of each cell; a faulty text gives the events before the fault and then none."""

    def make(value):
        try:
            text = tr.to_text(value)
        except Y.YamlError:
            return
        found = Y.quick(text)
        if found is None:
            parser = None
            try:
                parser = Y.Parser(tr.normal_breaks(text))
                parser.parse()
            except Y.YamlError:
                if parser is None:
                    return
            found = parser.events
        doc = -1
        for seq, e in enumerate(found):
            doc += e.type == "doc+"
            kind = NODE_KINDS.get(e.type)
            if kind == tr.SCALAR and e.tag is None:
                tag_id = tr.R.resolve(e.value or "", family) if e.style == Y.PLAIN else tr.R.STR
            else:
                tag_id = tr.type_of(tr.Node(kind, e.value or "", style=e.style, tag=e.tag), family) if kind else None
            yield (
                max(doc, 0), seq, e.type, e.style, e.flow, e.explicit, e.tag is None, tag_id, e.value, e.anchor, e.tag, e.line, e.col, e.end_line, e.end_col,
            )

    return expand(df, column, make, EVENTS, keep, True, only)


def diagnostics(df: DataFrame, column: str, schema: Schema | None = None, family: str = "core", form: str = "yaml", keep=None, most: int | None = MAX_REPORT, path_chars: int | None = 255, detail_chars: int | None = 127, only=None) -> DataFrame:
    """Diagnostics of each cell: of a compiled JSON Schema, or without one of the family's rules.

    ``most`` rows a cell, the last of which tells that there are more, with paths and details of so many characters; None for all.
    Rules of a family do not depend on the digits of integers that are values, so texts of one shape are made at once. ``only`` names the columns that are wanted.
    """

    def make(value):
        roots = [root for *_, root in decoded(value, form, family, "PERMISSIVE") if root is not None]
        if schema is not None:
            found = validate_tree(schema, roots, most, path_chars, detail_chars)
        else:
            report = Report(most=most, path_chars=path_chars, detail_chars=detail_chars)
            for i, root in enumerate(roots):
                report.prefix = f"/{i}" if len(roots) > 1 else ""
                check_family(root, family, report)
            found = report.rows
        for seq, row in enumerate(found):
            yield {"seq": seq, **row}

    return expand(df, column, make, DIAGNOSTICS, keep, schema is None and form == "yaml", only)
