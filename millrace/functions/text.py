"""Column functions on text, markup and URLs.  Patterns work alike in Java and RE2."""

from __future__ import annotations

import html
import re
from functools import reduce
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# Elements without prose, what ends of elements become, and white space beyond ASCII.
NOISE = ["head", "script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "form", "svg"]
BREAKS = [(r"<br\s*/?>", 1), (r"</p\s*>", 2), (r"</div\s*>", 1), (r"</li\s*>", 1), (r"</h[1-6]\s*>", 2), (r"</tr\s*>", 1)]
WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STOP = ["and", "for", "the", "with", "von", "der", "die", "das", "und", "les", "des", "los", "las"]
PHONE = r"\+?[0-9][0-9() -]{8,}[0-9]"
EMAIL = r"[\p{L}\p{N}._+-]+@[\p{L}\p{N}-]+\.[\p{L}\p{N}.-]+"
SOCIAL = r"https?://(?:t\.me|vk\.com|instagram\.com)/[\p{L}\p{N}_.]+"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column) -> Column:
    """Lower case; quotes, dashes and punctuation become blanks."""
    return squeeze(F.regexp_replace(F.lower(c), r"[\"'«»„“”`.,:;!?()\[\]/\\#№_–—-]+", " "))


def norm_query(c: Column) -> Column:
    """Lower case; all but letters, digits and underscores become blanks."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def tokenize(c: Column, stop: list[str] = STOP) -> Column:
    """Words of a letter or digit and more (inner - . + allowed), longer than two characters, without stop words."""
    found = F.regexp_extract_all(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.+-]+"), F.lit(0))
    return F.filter(found, lambda w: (F.char_length(w) > 2) & ~w.isin(stop))


def count_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


#: References that a semicolon ends.
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t).strip(), na_action="ignore")


def _decoded_closed(texts: pd.Series) -> pd.Series:
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])
    return texts.map(lambda t: CLOSED.sub(one, t).strip(), na_action="ignore")


def unescape(c: Column, bare: bool = True) -> Column:
    """All character references decoded, white space at both ends removed; in Arrow batches, since no column function knows them.
    Without ``bare``, what no semicolon ends (as at a cut through a reference) is text."""
    return F.pandas_udf(_decoded if bare else _decoded_closed, "string")(c)


def _cut(c: Column, opening: str, closing: str) -> Column:
    """c without its stretches from an opening (a pattern) to the next closing (a text, whatever its case).

    The text is split behind each closing; of a piece that ends with one, all from the first opening on goes.  So each
    character is looked at a few times, however many openings are never closed.
    """
    ends = lambda x: F.endswith(F.lower(x), F.lit(closing))
    cut = lambda x: F.when(ends(x), F.regexp_replace(x, f"(?is){opening}.*{closing}$", "")).otherwise(x)
    whole = lambda t: F.when(F.contains(F.lower(t), F.lit(closing)), F.array_join(F.transform(F.split(t, f"(?i)(?<={closing})"), cut), "")).otherwise(t)
    return F.get(F.transform(F.array(c), whole), F.lit(0))  # c stands once, so that cuts of cuts don't multiply


def _without_noise(c: Column) -> Column:
    return _cut(reduce(lambda x, t: _cut(x, rf"<{t}\b[^>]*>", f"</{t}>"), NOISE, c), "<!--", "-->")


def clean_html(c: Column, bare: bool = True) -> Column:
    """Noise and comments out, tags removed without a blank, white space squeezed, entities decoded last (``bare`` as in unescape)."""
    c = F.regexp_replace(_without_noise(F.coalesce(c, F.lit(""))), r"<[^>]+>", "")
    return unescape(F.regexp_replace(c, f"{WHITE}+", " "), bare)


def html_to_text(c: Column, bare: bool = True) -> Column:
    """As clean_html, but ends of paragraphs and headings become two line feeds, those of other blocks one; two in a row at most."""
    c = reduce(lambda x, b: F.regexp_replace(x, f"(?i){b[0]}", "\n" * b[1]), BREAKS, _without_noise(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"[ \t]+", " ")
    return unescape(F.regexp_replace(F.regexp_replace(c, r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n"), bare)


def strip_tags(c: Column, scripts: bool = True) -> Column:
    """Tags become blanks; scripts and styles go first unless scripts is false.  Null gives ''."""
    c = F.coalesce(c, F.lit(""))
    if scripts:
        c = reduce(lambda x, t: F.regexp_replace(x, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " "), ["script", "style"], c)
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def words_of(c: Column) -> Column:
    """Words between any white space; none in a blank text."""
    return F.filter(F.split(c, f"{WHITE}+"), lambda w: w != "")


def truncate_words(c: Column, n: int, words: Column | None = None) -> Column:
    """Up to n words unchanged; else the first n, lone marks at the end dropped, and dots added.  words may hold words_of(c)."""
    words = words_of(c) if words is None else words
    cut = F.regexp_replace(F.array_join(F.slice(words, 1, n), " "), r"(?:^| )[.!?,;:](?: [.!?,;:])*$", "")
    return F.when(F.size(words) <= n, c).otherwise(F.concat(cut, F.when((cut == "") | F.regexp_like(cut, F.lit(r"[.!?]$")), "..").otherwise("...")))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def readable_ratio(c: Column, alphabet: str = r"\p{L}", head: int = 4000) -> Column:
    """Share of letters of the alphabet and printable ASCII among the first characters."""
    first = F.substring(c, 1, head)
    return F.when(F.char_length(first) > 0, F.char_length(F.regexp_replace(first, rf"[^{alphabet}\x20-\x7E]", "")) / F.char_length(first)).otherwise(0.0)


def keywords(c: Column, n: int = 20, more: list[str] | None = None) -> Column:
    """Distinct words of four characters or more in the form and order of their first appearance, then ``more`` words that are not among
    them, n in all.  Words that differ in case only are one."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))
    words = F.concat(words, F.array(*[F.lit(w) for w in more])) if more else words
    none = F.array().cast("array<string>")

    def take(held: Column, word: Column) -> Column:
        known = (F.size(held["words"]) >= n) | F.array_contains(held["low"], F.lower(word))
        grown = F.struct(F.array_append(held["words"], word).alias("words"), F.array_append(held["low"], F.lower(word)).alias("low"))
        return F.when(known, held).otherwise(grown)

    return F.aggregate(words, F.struct(none.alias("words"), none.alias("low")), take, lambda held: held["words"])


def norm_domain(url: Column) -> Column:
    """Network location in lower case, without www. and m.; keeps a port."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "")


def find_link(html: Column, base: Column, keywords: list[str]) -> Column:
    """Address of the first link, absolute or from the root of ``base``'s host, whose text holds a keyword in any case; null without one.
    Tags within a link's text don't count."""
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\s[^>]*?\bhref\s*=\s*[\"'](?:/|http)[^\"']*[\"'][^>]*>.*?</a\s*>"), F.lit(0))
    words = F.array(*[F.lit(w.lower()) for w in keywords])
    shown = lambda a: F.lower(F.regexp_replace(a, r"<[^>]+>", ""))
    hit = F.get(F.filter(anchors, lambda a: F.exists(words, lambda w: F.contains(shown(a), w))), F.lit(0))
    href = F.regexp_extract(hit, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    root = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0)
    return F.when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^[A-Za-z]+:", 0), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(href)


def rewrite_url(url: Column) -> Column:
    """Channel pages of t.me get their public preview."""
    return F.regexp_replace(url, r"^(https?://t\.me)/([^s/][^/]*|s[^/]+)$", "$1/s/$2")


def first_path_part(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/([^/?#]*)", 1)


def social_handle(url: Column, reserved: tuple[str, ...] = ("s", "joinchat", "share", "p")) -> Column:
    part = first_path_part(url)
    return F.when((part != "") & ~part.isin(*reserved), part)


def salary_text(low: Column, high: Column, currency: Column, none: str = "by agreement") -> Column:
    parts = F.concat_ws(" ", F.concat(F.lit("от "), low.cast("string")), F.concat(F.lit("до "), high.cast("string")))
    return F.when(parts == "", F.lit(none)).otherwise(F.concat_ws(" ", parts, currency))


def parse_rub(c: Column) -> Column:
    """Digits (blanks between them allowed) before the rouble sign or its entity."""
    digits = F.regexp_replace(F.regexp_extract(c, r"([0-9][0-9 ]*)(?:₽|&#8381;)", 1), " ", "")
    return digits.try_cast("long")


def numeric_id(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/projects/([0-9]+)/", 1), F.lit("")), url)


#: A date, and a time of day and an offset if they follow.
ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def parse_when(c: Column) -> Column:
    """Seconds since 1970 from epoch seconds, epoch milliseconds (above 1e11), an ISO date or an ISO time; a time without offset
    is UTC, a date its midnight.  Else null."""
    number = c.try_cast("double")
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(c, ISO, k), F.lit("")), F.lit(default))
    offset = F.regexp_replace(F.replace(part(3, "Z"), F.lit("Z"), F.lit("+00:00")), r"^([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    day = F.nullif(F.regexp_extract(c, ISO, 1), F.lit(""))
    parsed = F.concat(day, F.lit(" "), F.regexp_replace(part(2, "00:00:00"), "^([0-9]{2}:[0-9]{2})$", "$1:00"), offset).try_cast("timestamp")
    return F.when(number.isNotNull(), F.when(number > 1e11, number / 1000).otherwise(number)).otherwise(F.unix_micros(parsed) / 1e6)


def first_word(c: Column) -> Column:
    """The first word between any white space, without marks at its ends, in lower case; ``?`` where there is none."""
    word = F.regexp_extract(F.coalesce(F.nullif(c, F.lit("")), F.lit("?")), f"^{WHITE}*([^{WHITE[1:]}+)", 1)
    return F.lower(F.regexp_replace(F.when(word == "", "?").otherwise(word), r"^[ ,.;—-]+|[ ,.;—-]+$", ""))


def goal_extract(text: Column, words: str, budget: int = 2000) -> Column:
    """Text around keywords (400 either side), phones and mails (200) and social links (100), merged over gaps of up
    to 50, joined by a double bar up to the budget; the head of the text if nothing matches.  Patterns are RE2-like
    without groups; one pass over the matches in their order, in Arrow batches."""
    reach = [(words, 400), (PHONE, 200), (EMAIL, 200), (SOCIAL, 100)]

    @F.arrow_udf("string")
    def extract(texts: pa.Array) -> pa.Array:
        import regex

        patterns = [(regex.compile(p), n) for p, n in reach]

        def one(t: str) -> str:
            spans: list[list[int]] = []
            for s, e in sorted((max(0, m.start() - n), min(len(t), m.end() + n)) for p, n in patterns for m in p.finditer(t)):
                if spans and s - spans[-1][1] <= 50:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            return (" ‖ ".join(t[s:e] for s, e in spans) or t)[:budget]

        return pa.array((one(t.as_py()) for t in texts), pa.string())  # one text at a time is a Python string

    return extract(F.coalesce(text, F.lit("")))
