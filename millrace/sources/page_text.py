"""Jobs over whole pages that need more than column functions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udtf

TAG = re.compile(r"<(/?)(h[1-6]|a|p|li|br|img)\b([^>]*)>", re.I)
# Elements of a page that are no content, and how a fenced block of JSON reads.
NOISE = ["script", "style", "nav", "footer", "header", "aside", "form", "noscript"]
FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.I)

OPENING = re.compile(rf"<!--|<({'|'.join(NOISE)})\b", re.I)
CLOSING = re.compile(rf"-->|</({'|'.join(NOISE)})\s*>", re.I)
SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)
TYPE = re.compile(r"""type\s*=\s*["']?([^"'\s>]+)""", re.I)


def without_noise(html: str) -> str:
    """html without comments and elements that are no content, each up to the first closing of its name; what is never closed stays.
    Two passes, whatever the page: closings are found once and looked up by place."""
    ends: dict[str, tuple[list[int], list[int]]] = {}
    for m in CLOSING.finditer(html):
        starts, stops = ends.setdefault((m[1] or "").lower(), ([], []))
        starts.append(m.start())
        stops.append(m.end())
    kept, at = [], 0
    for m in OPENING.finditer(html):
        if m.start() >= at and (found := ends.get((m[1] or "").lower())):
            k = bisect_left(found[0], m.end())
            if k < len(found[0]):
                kept.append(html[at : m.start()])
                at = found[1][k]
    return "".join([*kept, html[at:]])


def markdown(html: str | None) -> str:
    """Headings, links, images and list items of a page as Markdown; other tags go."""
    body, links = without_noise(html or ""), []

    def one(m: re.Match) -> str:
        closing, name, attrs = bool(m[1]), m[2].lower(), m[3]
        attr = lambda a: (re.search(rf'{a}\s*=\s*"([^"]*)"', attrs) or ["", ""])[1]
        if name[0] == "h":
            return "\n\n" if closing else f"\n\n{'#' * int(name[1])} "
        if name == "a":
            if closing:
                return f"]({links.pop()})" if links else ""
            links.append(attr("href"))
            return "["
        return "" if closing and name != "p" else {"p": "\n\n", "li": "\n- ", "br": "\n", "img": f"![{attr('alt')}]({attr('src')})"}[name]

    text = unescape(re.sub(r"<[^>]+>", "", TAG.sub(one, body)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def page_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown of each row of pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"page_id": pdf["page_id"], "markdown": [markdown(h) for h in pdf["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, markdown string")


BLANKS = re.compile(r"[ \t\n\r]*")
SCALAR = re.compile(r"""-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity""")
STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')


class Scanner:
    """Finds JSON values in a text without recursion: one stack of open brackets, however deep they are nested.

    What a try learns is kept: brackets that closed inside it are values themselves, and brackets that were open where it
    broke off break off there too, so that no later try begins at any of them.
    """

    def __init__(self, text: str):
        self.text, self.ends, self.failed = text, {}, set()

    def value(self, at: int) -> int | None:
        """Where the value that begins at a place ends; None if it is none."""
        text, n = self.text, len(self.text)
        stack: list[int] = []
        want = "value"  # value, first (value or ]), key, name (key or }), colon, next
        while True:
            at = BLANKS.match(text, at).end()
            c = text[at] if at < n else ""
            if want in ("value", "first") and c in ("{", "["):
                stack.append(at)
                want = "name" if c == "{" else "first"
                at += 1
                continue
            if want in ("key", "name") and c == '"' and (m := STRING.match(text, at)):
                at, want = m.end(), "colon"
                continue
            if want == "colon" and c == ":":
                at, want = at + 1, "value"
                continue
            if want == "next" and c == ",":
                at, want = at + 1, "key" if text[stack[-1]] == "{" else "value"
                continue
            if want in ("value", "first") and c not in ("]", "}") and (m := STRING.match(text, at) if c == '"' else SCALAR.match(text, at)):
                at = m.end()
            elif stack and ((c == "}" and text[stack[-1]] == "{" and want in ("name", "next")) or (c == "]" and text[stack[-1]] == "[" and want in ("first", "next"))):
                at += 1
                self.ends[stack.pop()] = at
            else:
                self.failed.update(stack)
                return None
            if not stack:
                return at
            want = "next"

    def first(self, opener: str) -> str | None:
        """The first value that begins with the bracket."""
        at = self.text.find(opener)
        while at >= 0:
            if at not in self.failed and (at in self.ends or self.value(at) is not None):
                return self.text[at : self.ends[at]]
            at = self.text.find(opener, at + 1)
        return None


def is_json(text: str) -> bool:
    end = Scanner(text).value(0) if text else None
    return end is not None and BLANKS.match(text, end).end() == len(text)


def first_json(text: str | None) -> str | None:
    """JSON in a text: the first fenced block that is whole JSON, else the first balanced object, else the first balanced array."""
    for m in FENCE.finditer(text or ""):
        if is_json(m[1].strip()):
            return m[1].strip()
    if not text:
        return None
    scanner = Scanner(text)
    return scanner.first("{") or scanner.first("[")


def script_blocks(page: str) -> Iterator[tuple[int, str, str]]:
    """Number, kind and JSON of the scripts of a page that hold some."""
    for n, m in enumerate(SCRIPT.finditer(page)):
        kind = (TYPE.search(m[1]) or ["", "state"])[1].lower()
        if "json" in kind or kind == "state" or "javascript" in kind or "data-" in m[1]:
            payload = first_json(m[2])
            if payload is not None:
                yield n, kind, payload


@arrow_udtf(returnType="page_id long, nth long, kind string, payload string")
class EmbeddedJson:
    """Table function over pages (page_id, html): a row for each script that holds JSON."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(p, *b) for p, h in zip(pages.column("page_id").to_pylist(), pages.column("html").to_pylist(), strict=True) for b in script_blocks(h or "")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "nth", "kind", "payload"])


def embedded_json(pages: DataFrame) -> DataFrame:
    """page_id, nth, kind, payload: the JSON of each script of a page that holds some; kind is the script's type, ``state``
    for scripts that assign a value, and scripts of other types than JSON or JavaScript don't count."""
    return EmbeddedJson(pages.select("page_id", "html").asTable())


def json_of_texts(texts: DataFrame, key: str) -> DataFrame:
    """key, payload: the first JSON in each text of (key, text), null where there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "payload": [first_json(t) for t in pdf["text"]]})

    return texts.select(key, "text").mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, payload string")
