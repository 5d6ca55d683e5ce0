"""Chunked feeds: text of a stream of documents arrives in pieces, documents leave when they are complete.

``feed`` is the pure step: what is left over, plus a chunk, gives complete documents and
what is left over then. How a stream is cut into chunks never changes what it gives. In
Structured Streaming the rest is state for each stream key, so memory is bounded by the
largest document of each open stream. Chunks carry a number, since bytes have no event
time; chunks of a batch are put in order by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docengine.functions import tree as tr
from docengine.functions import yamlparse as Y
from docengine.functions.cbor import CborError, decode_prefix
from docengine.operators.tables import DOCUMENTS

#: Documents in one frame that goes back to Spark.
MOST = 4096
MARKER = re.compile(r"^(?:---|\.\.\.)(?=[ \t\r\n])", re.M)


def complete(text: str, fresh: int = 0) -> int:
    """How much of a text is whole documents, whatever follows: up to the last marker that begins a document or ends one.

    The first ``fresh`` characters are known to hold no such marker after a whole line, so only the rest is searched.
    """
    # the last line may go on, so only whole lines count
    end = text.rfind("\n") + 1
    best = 0
    # the line that the rest goes on with
    start = text.rfind("\n", 0, fresh) + 1 if fresh else 0
    for m in MARKER.finditer(text, start, end):
        if m[0] == "---":
            best = m.start()
        else:
            line = text.find("\n", m.end()) + 1
            best = line if 0 < line <= end else best
    # directives belong to the document after them
    head = text[:best]
    lines = head.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    while lines and lines[-1].startswith("%") and text[best:].startswith("---"):
        best -= len(lines.pop())
    return best


def feed(rest: str, chunk: str, index: int, line: int, final: bool = False) -> tuple[list[dict], str, int, int]:
    """(documents, rest, index, line) after a chunk."""
    text = rest + chunk
    cut = len(text) if final else complete(text, len(rest))
    out = []
    if text[:cut].strip():
        for _, status, err_line, err_col, message, part, _ in tr.tolerant(text[:cut]):
            err_line = None if err_line is None else err_line + line
            out.append({"doc_index": index, "status": status, "err_line": err_line, "err_col": err_col, "err_msg": message, "text": part})
            index += 1
    return out, text[cut:], index, line + text.count("\n", 0, cut)


def feed_cbor(rest: bytes, chunk: bytes, final: bool = False) -> tuple[list[str], bytes]:
    """Complete items of a CBOR sequence as JSON, and the bytes left over."""
    data, out = rest + chunk, []
    while data:
        try:
            node, used = decode_prefix(data)
        except CborError:
            if final:
                raise
            break
        out.append(tr.to_json(node))
        data = data[used:]
    return out, data


def feed_stream(chunks: DataFrame, key: str = "source") -> DataFrame:
    """A streaming DataFrame (key, chunk_no, chunk, final) to documents as they complete."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, index, line = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(frames)).sort_values("chunk_no")
        out: list[dict] = []
        ended = False

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["doc_index", "status", "err_line", "err_col", "err_msg", "text"])
            made.insert(0, key, keys[0])
            return made.astype({"err_line": "Int64", "err_col": "Int64"})

        for chunk, final in zip(rows["chunk"], rows["final"], strict=True):
            found, rest, index, line = feed(rest, chunk or "", index, line, bool(final))
            out += found
            ended = bool(final)
            if len(out) >= MOST:
                yield frame()
                out = []
        # a stream that has ended leaves no state
        if ended:
            state.remove()
        else:
            state.update((rest, index, line))
        yield frame()

    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} string, {DOCUMENTS}", "rest string, doc_index long, line long", "append", GroupStateTimeout.NoTimeout)


def iterate(text: str) -> Iterator[tr.Node]:
    """Document after document, strictly: the first fault ends the stream."""
    parser, done = Y.Parser(tr.normal_breaks(text)), 0
    for _ in parser.documents():
        fresh, done = parser.events[done:], len(parser.events)
        yield from tr.compose(fresh)
