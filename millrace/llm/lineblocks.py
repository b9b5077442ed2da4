"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element; all text of a page takes part.  Weights of lines are summed over a
sliding window; main text begins where the sums surge and ends where they dive to zero, and every line between stays.

Markup only weighs lines.  Lines inside an article or main element weigh ``MARKED`` times their length, links included; elsewhere a
line that is mostly links weighs 0.  Lines of page furniture (navigation, footers, adverts, forms, reader comments and the like) weigh
``FURNITURE_WEIGHT`` of their length without links.  Borders of articles and of furniture are gaps as wide as the window, so
that sums dive there.  The largest window sum outside furniture is the page's peak.  A run of lines of the peak's kind (marked or
not) is main text if one of its sums reaches ``SURGE`` or half the peak; a run of the other kind must reach half the peak, one of
furniture both.  So a marked article prevails over text outside it, and text over furniture, unless that is by far the larger block.

What is short beside a surge still belongs to it if it stands in the same block (the article, or the nearest section or division):
headings and short paragraphs beyond a gap, and link lists between paragraphs.  Some class words (``SOFT``) also name parts of
articles: such a block inside an article is furniture only if it holds links, other furniture or no line of ``SURGE`` characters.
A heading that only says "Comments" begins furniture, up to the end of its block or the next heading of its rank.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: A run of lines of the peak's kind is main text if its largest window sum reaches this, or half of the page's largest.
SURGE = 80
#: Weight of a character inside an article or main element, and of one inside page furniture.
MARKED = 4
FURNITURE_WEIGHT = 1 / 64

# Fixed values of HTML: elements that end a line, have no content, or hold no prose.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg math iframe object canvas audio video title textarea select button".split()
# Raw elements that run to the end of the page if nothing closes them, and those of them whose "/>" may still have content.
TO_END = set("script style iframe title textarea".split())
CODE = ("script", "style")
HEAD = set("head base basefont bgsound link meta title noscript noframes style script template".split())
FURNITURE = set("nav footer aside form menu dialog fieldset".split())
# Elements whose start ends an open paragraph.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split()
)
# Items whose start ends an open one of the same group, within the nearest of their containers.
ITEMS = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "thead": "thead", "tbody": "thead", "tfoot": "thead", "option": "option", "optgroup": "option"}
HOLDERS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dir": ("li",), "dl": ("dt",), "table": ("thead", "tr", "td"), "thead": ("tr", "td"), "tbody": ("tr", "td"), "tfoot": ("tr", "td"), "tr": ("td",), "datalist": ("option",)}
# Words of class, id and role values that mark furniture, and words that may stand beside them in a value.
MARKS = set(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent notice alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead header comment comments disqus "
    "discussion discussions responses gdpr privacy respond reply replies share sharing social related recommended newsletter subscribe signup login search widget widgets "
    "complementary contentinfo".split()
)
BESIDE = set(
    "site page main top bottom left right primary secondary global box bar block list area container wrapper wrap inner outer links link buttons button "
    "icons icon item items section group panel form unit slot post posts article entry blog user reader thread the my js c o u l".split()
)
SOFT = set("search related recommended widget widgets share sharing social header alert notice promo promotion privacy complementary".split())
# Words that name parts of papers where they are the id of a section.
PARTS = set("discussion responses".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
TALK = re.compile(
    r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|kommentare?|commentaires?|comentarios?|commenti|комментарии|leave a (?:comment|reply)|add a comment|join the discussion)(?: ?\(?\d+\)?)?:?",
    re.I,
)
RIGHTS = re.compile(r"©|\(c\) |copyright\b", re.I)
# Elements whose lines belong together.
HOMES = set("body div section td th center details".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?P<rest>(?:=\s*(?:\"[^\"<]*\"|'[^'<]*')|[^>])*+)>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
RAW_TAGS = {n: re.compile(rf"<(?:(/){n}\s*>|{n}(?=[\s/>]))", re.I) for n in RAW}
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
VALUES = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def marks_in(value: str, in_article: bool) -> set[str]:
    """Marks of those whole tokens of a class, id or role that are made of marks, with nothing but neutral words and numbers beside them."""
    found: set[str] = set()
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if w]
        marks = {w for w in words if w in MARKS}
        if marks and all(w in MARKS or w in BESIDE for w in words):
            own = in_article or any(w in ("post", "article", "entry") for w in words)
            if not own or marks != {"header"}:
                found |= marks
    return found


def is_furniture(name: str, attrs: str, in_article: bool, holds_article: bool) -> tuple[bool, bool]:
    """Whether an element is page furniture, and whether its lines may still show that it is a part of the article."""
    if holds_article and name == "form":  # some sites put the whole page in one
        return False, False
    if name in FURNITURE or (name == "header" and not in_article):
        return True, False
    if not attrs or holds_article or name in ("body", "html", "main") or (name == "article" and not in_article):
        return False, False
    marks: set[str] = set()
    for m in VALUES.finditer(attrs):
        found = marks_in(m[2] or m[3] or m[4] or "", in_article)
        marks |= found - PARTS if name == "section" and m[1].lower() == "id" else found
    return bool(marks), in_article and marks <= SOFT


def self_closed(attrs: str) -> bool:
    """Whether a tag ends in "/>"; a slash at the end of an unquoted value is part of that."""
    bare = QUOTED.sub(" ", attrs)
    return bare.endswith("/") and "=" not in bare.split()[-1] and not re.search("[\"']", bare)


def tags_of(html: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag; a raw element is one with its content, and comments have no name."""
    tags = []
    at = 0
    unclosed: set[str] = set()
    while m := TOKEN.search(html, at):
        at = m.end()
        if m["raw"]:
            name, empty = m["raw"].lower(), self_closed(m["rest"])
            if (not empty or name in CODE) and name not in unclosed:
                close = next((t for t in RAW_TAGS[name].finditer(html, at) if empty or t[1]), None)
                if close and close[1]:
                    at = close.end()
                elif not empty:
                    unclosed.add(name)
                    at = len(html) if name in TO_END else at
            tags.append((m.start(), at, name, False, ""))
        else:
            tags.append((m.start(), at, (m["name"] or "").lower(), bool(m["close"]), m["attrs"] or ""))
    return tags


def opens(name: str, close: bool, attrs: str) -> bool:
    return not close and name not in VOID and name not in RAW_TAGS and name != "head" and not attrs.endswith("/")


class Elements:
    """The open elements of a page, with implied ends of paragraphs and items.  Every element is entered and left once, and a
    closing tag without an open element costs nothing, so that a page takes time in proportion to its tags."""

    def __init__(self, leave):
        self.stack: list[tuple[str, object]] = []
        self.open: dict[str, int] = {}
        self.items: dict[str, list[int]] = {}  # per group: places of open items, -1 for each container without one
        self.leave = leave

    def enter(self, name: str, note: object) -> None:
        group = ITEMS.get(name)
        for g in HOLDERS.get(name, ()):
            self.items.setdefault(g, []).append(-1)
        if group:
            self.items.setdefault(group, [-1])[-1] = len(self.stack)
        self.stack.append((name, note))
        self.open[name] = self.open.get(name, 0) + 1

    def _pop(self) -> None:
        name, note = self.stack.pop()
        self.open[name] -= 1
        if name in ITEMS:
            self.items[ITEMS[name]][-1] = -1
        for g in HOLDERS.get(name, ()):
            self.items[g].pop()
        self.leave(name, note)

    def imply(self, name: str) -> None:
        """Ends what the start of an element of this name ends."""
        if name in ENDS_P and self.open.get("p"):
            self.end("p")
        group = ITEMS.get(name)
        if group:
            at = self.items.setdefault(group, [-1])[-1]
            while 0 <= at < len(self.stack):
                self._pop()

    def end(self, name: str) -> None:
        if self.open.get(name):
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()


def holders(tags: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Numbers of the tags that open an element around the main element or an article that is in no other article."""
    found: set[int] = set()
    elements = Elements(lambda name, note: None)
    for k, (_, _, name, close, attrs) in enumerate(tags):
        if close:
            elements.end(name)
        elif name and opens(name, close, attrs):
            elements.imply(name)
            if name == "main" or (name == "article" and not elements.open.get("article")):
                for _, i in reversed(elements.stack):
                    if i in found:
                        break
                    found.add(i)
            elements.enter(name, k)
    return found


class Line:
    """A line with its linked characters, whether it is inside an article (None: in furniture), its block, and how deep in furniture."""

    __slots__ = ("text", "linked", "marked", "home", "deep")

    def __init__(self, text: str = "", linked: int = 0, marked: bool | None = False, home: int | None = None, deep: int = 0):
        self.text, self.linked, self.marked, self.home, self.deep = text, linked, marked, home, deep

    def weight(self) -> float:
        if self.marked:
            return MARKED * len(self.text)
        if 2 * self.linked > len(self.text) or (self.marked is False and RIGHTS.match(self.text)):
            return 0
        return len(self.text) * (1 if self.marked is False else FURNITURE_WEIGHT)


def lines_of(html: str) -> list[Line]:
    """The lines of a page, all of its text; gaps are empty lines."""
    lines: list[Line] = []
    parts: list[str] = []
    dropped = article = links = linked = 0
    home = -1
    talk: tuple[int, int] | None = None  # rank of the heading over reader comments, and open elements around it

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, linked, None if dropped else article > 0, home, dropped))
        parts.clear()
        linked = 0

    def words(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(unescape(text).strip())

    def gap() -> None:
        lines.extend(Line() for _ in range(WINDOW))

    def hush() -> None:
        """Ends reader comments."""
        nonlocal dropped, talk
        flush()
        talk = None
        dropped -= 1
        if not dropped:
            gap()

    def leave(name: str, note: tuple[bool, bool, int, int]) -> None:
        nonlocal dropped, article, links, home, talk
        furniture, soft, outer, first = note
        if name in BLOCKS or furniture:
            flush()
        if talk and len(elements.stack) < talk[1]:
            hush()
        if name in HEADINGS and not dropped and len(lines) > first and TALK.fullmatch(lines[-1].text):
            talk = HEADINGS[name], len(elements.stack)
            line = lines.pop()
            gap()
            dropped += 1
            lines.append(Line(line.text, line.linked, None, home, dropped))
        if furniture:
            dropped -= 1
            inside = lines[first:] if soft and not dropped else []
            if any(len(x.text) >= SURGE for x in inside) and not any(x.linked or x.deep > 1 for x in inside):
                for x in inside:
                    x.marked, x.deep = True, 0
        home = outer
        links -= name == "a"
        article -= name in ("article", "main")
        if not dropped and (furniture or (name in ("article", "main") and not article)):
            gap()

    tags = tags_of(html)
    holding = holders(tags) if any(name in ("article", "main") for _, _, name, _, _ in tags) else ()
    elements = Elements(leave)
    at = 0
    head = False  # ends with the first element that cannot stand in it; what can has no text but in noframes
    for k, (start, end, name, close, attrs) in enumerate(tags):
        words(html[at:start])
        at = end
        if not name:
            continue
        if name in BLOCKS or name == "title":
            flush()
        elif name == "br":
            words(" ")
        head = (head or name == "head") and name in HEAD and not (close and name == "head")
        if close:
            elements.end(name)
        elif opens(name, close, attrs):
            elements.imply(name)
            if talk and HEADINGS.get(name, 7) <= talk[0] and len(elements.stack) == talk[1]:
                hush()
            furniture, soft = (True, False) if head and name == "noframes" else is_furniture(name, attrs, article > 0, k in holding)
            if furniture:
                flush()
            whole = name in ("article", "main")
            if not dropped and (furniture or (whole and not article)):
                gap()
            elements.enter(name, (furniture, soft, home, len(lines)))
            if not article and (whole or name in HOMES):
                home = k
            dropped += furniture
            article += whole
            links += name == "a"
    words(html[at:])
    flush()
    return lines


def runs(weights: list[float], marked: list[bool | None], window: int, surge: int) -> list[tuple[int, int, bool]]:
    """Runs (first line, line after the last, whether it is main text by itself), from the weights of lines in their order."""
    total, plain = [0], [0]
    for w, kind in zip(weights, marked):
        total.append(total[-1] + w)
        plain.append(plain[-1] + (w if kind is not None else 0))
    n = len(weights)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    tops = [plain[min(n, i + window)] - plain[i] for i in range(n)]
    peak = max(range(n), key=tops.__getitem__, default=0)
    half = tops[peak] / 2 if n else 0
    of = next((marked[i] for i in range(peak, n) if weights[i]), False)
    least = lambda kind: max(surge, half) if kind is None else min(surge, half) if kind == of else half
    out, i = [], 0
    while i < n:
        if not weights[i]:
            i += 1
            continue
        end = i  # the surge; the dive is where the next window of lines holds nothing
        while end < n and any(weights[end : end + window]):
            end += 1
        last = end
        while not weights[last - 1]:
            last -= 1
        out.append((i, last, max(sums[i:last]) >= least(marked[i])))
        i = end
    return out


def chosen(weights: list[float], marked: list[bool | None], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs (first line, line after the last) between a surge and a dive; marked is None for lines of furniture."""
    return [(a, b) for a, b, strong in runs(weights, marked, window, surge) if strong]


def kept_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """Lines of the runs chosen, and what is short or linked in the same blocks."""
    keep = [False] * len(lines)
    first: dict[int | None, int] = {}
    found = runs([x.weight() for x in lines], [x.marked for x in lines], window, surge)
    for a, b, strong in found:
        for i in range(a, b) if strong else ():
            keep[i] = True
            if lines[i].text and lines[i].marked is not None:
                first.setdefault(lines[i].home, i)
    for a, b, strong in found:
        for i in range(a, b) if not strong else ():
            keep[i] = lines[i].marked is not None and lines[i].home in first
    last = {x.home: i for i, x in enumerate(lines) if keep[i] and x.marked is not None}
    for i, x in enumerate(lines):
        if x.marked is not None and x.home in first and first[x.home] < i < last[x.home]:
            keep[i] = True
    return [x.text for i, x in enumerate(lines) if keep[i] and x.text]


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of one page; empty for a null or empty page."""
    return "\n".join(kept_lines(lines_of(html or ""), window, surge))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html); other columns are ignored.

    A null or empty html gives an empty text.  Repeated rows give repeated results.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
