"""Elements of HTML pages as rows, so that pages are read with filters and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from placard.functions.text import VOID

ELEMENT = "struct<at:int,tag:string,classes:array<string>,attrs:map<string,string>,inside:array<string>,row:int,text:string,inner:string>"
_NAMES = pa.list_(pa.string())
ARROW = pa.list_(pa.struct([("at", pa.int32()), ("tag", pa.string()), ("classes", _NAMES), ("attrs", pa.map_(pa.string(), pa.string())), ("inside", _NAMES), ("row", pa.int32()), ("text", pa.string()), ("inner", pa.string())]))
FEW = 16


class _Tree(HTMLParser):
    def __init__(self, html: str, tags: frozenset[str], inner: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.tags, self.inner = html, tags, inner
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.open: list[dict] = []
        self.found: list[dict] = []
        self.count = 0

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        above = self.open[-1] if self.open else {"inside": [], "row": None}
        node = {"at": self.count, "tag": tag, "classes": classes, "attrs": given, "inside": [*above["inside"], tag, *(f".{c}" for c in classes)], "row": self.count if tag == "tr" else above["row"]}
        node |= {"pieces": [], "inner": None, "begin": self._offset() + len(self.get_starttag_text() or "")}
        self.count += 1
        if tag in self.tags or self.inner in classes:
            self.found.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n["tag"] == tag for n in self.open):
            while True:
                node = self.open.pop()
                if self.inner in node["classes"]:
                    node["inner"] = self.html[node["begin"] : self._offset()].strip()
                if node["tag"] == tag:
                    break

    def handle_data(self, data: str) -> None:
        if data.strip():
            for node in self.open:
                node["pieces"].append(data.strip())


def _found(html: str, tags: frozenset[str], inner: str) -> list[dict]:
    tree = _Tree(html, tags, inner)
    tree.feed(html)
    tree.close()
    return [{k: n[k] for k in ("at", "tag", "classes", "attrs", "inside", "row", "inner")} | {"text": " ".join(n["pieces"])} for n in tree.found]


def _as_arrow(html: pa.Array, tags: frozenset[str], inner: str) -> pa.Array:
    pages = (None if h is None else _found(h, tags, inner) for h in html.to_pylist())
    return pa.array([page and [e | {"attrs": list(e["attrs"].items())} for e in page] for page in pages], ARROW)


def elements(*tags: str, inner: str = "") -> Callable[[Column], Column]:
    """A function of a column of HTML: its elements of these tags (and of the class ``inner``, with their source) in order.

    at: place among all elements; inside: tags and .classes of it and what is
    around it; row: the place of its table row; text: its stripped texts.
    """
    wanted = frozenset(tags)

    @F.arrow_udf(f"array<{ELEMENT}>")
    def run(html: pa.Array) -> pa.Array:
        # Few pages' elements are Python objects at a time, whatever the batch.
        pieces = [_as_arrow(html.slice(at, FEW), wanted, inner) for at in range(0, len(html), FEW)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], ARROW)

    return run


def has(element: str, *names: str) -> Column:
    """Whether an element stands inside all of these (tags, or classes with a dot)."""
    out = F.lit(True)
    for name in names:
        out = out & F.array_contains(f"{element}.inside", name)
    return out
