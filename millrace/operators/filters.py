"""Predicates and ordered classification."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import running


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), words, F.lit(False)) if words else F.lit(True)


def matched(c: Column, words: list[str]) -> Column:
    """Those of the words that the text holds, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def keyword_any(df: DataFrame, cols: list[str], words: list[str]) -> DataFrame:
    """Rows whose columns hold a keyword anywhere, whatever the case; without keywords all rows."""
    return df.where(contains_any(F.lower(F.concat_ws(" ", *cols)), words))


def keyword_tokens(c: Column, stems: list[str]) -> Column:
    """Sorted distinct words that begin with a stem, in lower case."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_])((?:{'|'.join(stems)})[\p{{L}}\p{{N}}_]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


#: Validators of pages by kind of site: page (a column) -> (number of items found, whether the page has content).
VALIDATORS: dict[str, Callable[[Column], tuple[Column, Column]]] = {}


def validator(name: str):
    """Plug a validator in under a name."""

    def register(f):
        VALIDATORS[name] = f
        return f

    return register


@validator("article")
def _article(html: Column) -> tuple[Column, Column]:
    n = F.regexp_count(html, F.lit(r"(?i)<p\b"))
    return n, (n >= 3) & F.contains(html, F.lit("</article>"))


@validator("listing")
def _listing(html: Column) -> tuple[Column, Column]:
    n = F.regexp_count(html, F.lit(r"(?i)<li\b"))
    return n, n >= 5


@validator("default")
def _default(html: Column) -> tuple[Column, Column]:
    return F.char_length(html), F.char_length(html) > 500


def validated(df: DataFrame, kind: str, html: Column) -> DataFrame:
    """Adds items and content_ok by the validator that a row's kind names; a kind without one takes the default."""
    items, ok = VALIDATORS["default"](html)
    for name, f in VALIDATORS.items():
        n, good = f(html)
        items, ok = F.when(F.col(kind) == name, n).otherwise(items), F.when(F.col(kind) == name, good).otherwise(ok)
    return df.withColumns({"items": items.cast("long"), "content_ok": ok})


def first_rule(rules: list[tuple[str, Column]], default: str | None) -> Column:
    """Name of the first rule that holds."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, cond in rules:
        chain = chain.when(cond, F.lit(name))
    return chain.otherwise(F.lit(default))


def tag_patterns(c: Column, patterns: list[tuple[str, str]], longest: int = 60) -> Column:
    """regex:<tag>:<match> of the first pattern that matches, else null."""
    hit = lambda p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    return F.coalesce(*[F.concat(F.lit(f"regex:{t}:"), F.substring(hit(p), 1, longest)) for t, p in patterns])


def size_class(n: Column, text: Column, chain: list[str], big: list[str]) -> Column:
    branches = F.when(F.coalesce(n, F.lit(0)) == 0, 1).otherwise(n)
    return F.when((branches >= 3) | contains_any(text, chain), "chain").when((branches == 2) | contains_any(text, big), "mid").otherwise("micro")


# Statuses by which an origin refuses, marks of challenges, and marks of a blocked result page.
BLOCK_STATUSES = [403, 429, 503]
CLOUDFLARE_MARKS = ["cf-chl", "challenge-platform", "just a moment"]
CAPTCHA_MARKS = ["captcha", "smartcaptcha"]
BLOCK_MARKERS = [
    "/sorry/", "Our systems have detected unusual traffic", "About this page", "captcha-form", "g-recaptcha",
    "if you are not redirected within", "enable javascript on your web browser",
]


def antibot_verdict(status: Column, server: Column, cf_ray: Column, body: Column) -> Column:
    """Ordered verdict on a response.  A guard's cookie alone is no sign: solved pages set it as well."""
    head, name = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 20_000)), F.lower(F.coalesce(server, F.lit("")))
    refused = F.coalesce(status.isin(*BLOCK_STATUSES), F.lit(False))
    guard = F.lit("ddos-guard")
    return first_rule(
        [
            ("DDOS-GUARD", F.contains(name, guard) | F.contains(head, guard)),
            ("CLOUDFLARE", (F.contains(name, F.lit("cloudflare")) | (F.coalesce(cf_ray, F.lit("")) != "")) & (contains_any(head, CLOUDFLARE_MARKS) | refused)),
            ("CHALLENGE", contains_any(head, CAPTCHA_MARKS)),
            ("BLOCKED", refused & (F.coalesce(F.char_length(body), F.lit(0)) < 5000)),
        ],
        "CLEAN",
    )


def serp_blocked(html: Column, markers: list[str] = BLOCK_MARKERS, head: int = 8000) -> Column:
    """Whether the head of a result page holds a marker, in its own case."""
    return contains_any(F.substring(html, 1, head), markers)


def error_kind(error: Column) -> Column:
    """Class of an error text, first match; null and other texts are ``other``."""
    e = F.coalesce(error, F.lit(""))
    return first_rule(
        [
            ("proxy_auth", contains_any(e, ["ERR_PROXY_AUTH_UNSUPPORTED"])),
            ("timeout", contains_any(e, ["Timeout", "ERR_TIMED_OUT"])),
            ("tunnel_failed", contains_any(e, ["ERR_TUNNEL_CONNECTION_FAILED"])),
            ("captcha", contains_any(F.lower(e), ["captcha"])),
        ],
        "other",
    )


# Marks of a failed fetch that speak for the proxy.
PROXY_FAILURES = ["ERR_TIMED_OUT", "ERR_TUNNEL", "Timeout", "ERR_PROXY", "ERR_CONNECTION", "ERR_EMPTY", "ERR_SOCKS"]


def log_bucket(logger: Column, msg: Column, model_call: str = "POST http://localhost:20022", search_call: str = "GET http://localhost:8080/search") -> Column:
    """Activity of a log line (logger, msg) as a struct: bucket, url, port, ok, fail_kind, empty; what a bucket lacks is null."""
    http, enricher, search = logger == "httpx", logger.endswith("site_enricher"), logger.endswith("searxng_client")
    url = F.nullif(F.regexp_extract(msg, r"(?:GET|POST) (https?://\S+)", 1), F.lit(""))
    plain = http & ~F.contains(msg, F.lit(model_call)) & ~F.contains(msg, F.lit(search_call))
    start, done, failed = (enricher & msg.startswith(x) for x in ("Starting site enrichment", "Extracted", "Site enrichment failed"))
    bucket = first_rule(
        [
            ("llm", http & F.contains(msg, F.lit(model_call))), ("serp", http & F.contains(msg, F.lit(search_call))), ("scrape_httpx", plain & url.isNotNull()), ("other", http),
            ("llm_retry_wait", logger == "openai._base_client"), ("serp_meta", search), ("enrich_start", start), ("scrape_browser", done | failed), ("other", enricher),
            ("marker", logger.endswith("research.tools")), ("llm", logger.endswith("research.agent")),
        ],
        "other",
    )
    port = F.coalesce(F.nullif(F.regexp_extract(msg, r"proxy=\w+://[^:]+:(\d+)", 1), F.lit("")), F.lit("?"))
    return F.struct(
        bucket.alias("bucket"), F.when(plain, url).alias("url"), F.when(start, port).alias("port"), F.when(done, True).when(failed, False).alias("ok"),
        F.when(failed, F.when(contains_any(msg, PROXY_FAILURES), "proxy").otherwise("other")).alias("fail_kind"),
        F.when(search, contains_any(msg, ["empty organic", "failed"])).alias("empty"),
    )


# Words of categories by type of organisation, in order; hints of technology; types that are legal entities.
ARCHETYPES = [
    ("law", ["адвокат", "юрид", "нотари", "юрист", "правов"]),
    ("finance", ["бухгалт", "аудит", "финанс", "банк", "страхов", "налог"]),
    ("med", ["клиник", "стомат", "медцентр", "медицин", "ветеринар", "поликлин", "диагностик", "лаборатор", "аптек"]),
    ("beauty", ["салон красот", "парикмах", "ногт", "космет", "барбер", "маникюр", "spa", "спа", "эпиляц"]),
    ("auto", ["автосервис", "автомойк", "шиномонтаж", "автотехцентр", "автосалон", "детейлинг", "развал"]),
    ("fitness", ["фитнес", "спортзал", "тренаж", "йога", "бассейн"]),
    ("realty", ["недвиж", "агентство недвиж", "риелт", "застройщик"]),
    ("print", ["типограф", "печать", "полиграф", "копир"]),
    ("edu", ["школа", "детский сад", "курс", "обучен", "репетит", "ясли"]),
    ("repair", ["ремонт", "химчистк", "ателье", "прачечн", "мастерск"]),
    ("food_retail", ["кафе", "ресторан", "бар", "суши", "кофейн", "столов", "пекарн", "пиццер", "кондитер", "бистро", "паб"]),
    ("shop", ["магазин", "цветы", "продукт", "супермаркет", "бутик", "торгов", "маркет"]),
]
TECH_HINTS = [
    "it", "айти", "разработк", "программн", "софт", "software", "веб", "web", "digital", "диджитал", "интернет", "телеком", "хостинг", "стартап",
    "маркетинг", "реклам", "агентств", "студия", "дизайн", "сайт", "приложен", "data", "ai", "ml", "saas", "кибербез", "интегратор", "1с", "crm",
]
LEGAL_ARCHETYPES = ["law", "finance", "med", "realty", "print", "auto", "edu"]


def _joined(categories: Column) -> Column:
    return F.lower(F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " "))


def archetype(categories: Column, table: list[tuple[str, list[str]]] = ARCHETYPES) -> Column:
    """Type of the first entry with a word in the categories (an array), else ``other``."""
    low = _joined(categories)
    return first_rule([(name, contains_any(low, words)) for name, words in table], "other")


def is_tech(categories: Column, hints: list[str] = TECH_HINTS) -> Column:
    return contains_any(_joined(categories), hints)


def wants_legal(kind: Column, kinds: list[str] = LEGAL_ARCHETYPES) -> Column:
    return kind.isin(*kinds)


def review_queue(cards: DataFrame, need: Column, text: Column, words: str, by: str, descending: bool = False) -> DataFrame:
    """Cards that need a review and hold the words, sorted by a column with nulls last either way, ties by oid."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return cards.where(need & F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(words.lower()))).orderBy(order, "oid")


def host_suffixes(host: Column) -> Column:
    """The host without www. and all its parent domains."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def host_in_list(df: DataFrame, key: str, host: str, hosts: DataFrame) -> DataFrame:
    """Columns key and host of the rows whose host, or a parent domain of it, is listed in hosts (host); a null host is in no list.

    Parent domains are made of the distinct hosts alone, so that rows meet a table of the hosts that are listed, not their own copies.
    """
    own = df.select(F.col(host).alias("_host")).where("_host IS NOT NULL").distinct()
    listed = own.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("host")).join(hosts, "host", "left_semi").select("_host").distinct()
    return df.select(key, host).join(listed, F.col(host) == F.col("_host"), "left_semi")


def is_filled(c: Column, placeholders: list[str]) -> Column:
    """Not null, not blank, and not beginning with a placeholder."""
    low = F.trim(F.lower(c))
    starts = reduce(lambda a, p: a | low.startswith(p), placeholders, F.lit(False))
    return c.isNotNull() & (low != "") & ~starts


def exclude_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def slice_batch(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows at positions offset + 1 to offset + limit in the given order; a limit, so that no partition holds all."""
    first = df.orderBy(order).limit(offset + limit)
    return first.withColumn("_rn", F.row_number().over(Window.orderBy(order))).where(F.col("_rn") > offset).drop("_rn")


def accepted(score: Column, verdict: Column, attempts: Column, pass_score: int, max_rejects: int) -> Column:
    return F.coalesce(score >= pass_score, F.lit(False)) | F.coalesce(verdict == "pass", F.lit(False)) | (attempts >= max_rejects + 1)


def only_new(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (source, id) was not seen before; repeats within df all stay, empty ids never do."""
    return df.where(F.col("id").isNotNull() & (F.col("id") != "")).join(seen.select("source", "id"), ["source", "id"], "left_anti")


def glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in r".+()[]{}^$|\\" else c for c in glob) + "$"


def first_glob(host: Column, globs: list[str]) -> Column:
    """The first glob of an ordered list that matches."""
    return first_rule([(g, F.regexp_like(host, F.lit(glob_regex(g)))) for g in globs], None)


def rule_regex(pattern: Column) -> Column:
    """A rule with * or ? is a glob, any other a regular expression; both must match a whole host."""
    escaped = F.regexp_replace(pattern, r"([.+()\[\]{}^$|\\])", r"\\$1")
    glob = F.replace(F.replace(escaped, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^(?:"), F.when(F.contains(pattern, F.lit("*")) | F.contains(pattern, F.lit("?")), glob).otherwise(pattern), F.lit(")$"))


def first_rules(df: DataFrame, host: str, rules: DataFrame, block: int = 2_000) -> DataFrame:
    """df with rule: the pattern of the first rule (ord, pattern, enabled) that matches the host, null if none does.

    Distinct hosts meet the rules, which are broadcast in blocks of about ``block``: a hash deals them, and the least ord over
    all blocks counts, so that a list of any length is matched.
    """
    active = rules.where("enabled").select("ord", "pattern", rule_regex(F.col("pattern")).alias("_regex"))
    blocks = -(-active.count() // block) or 1
    hosts = df.select(F.col(host).alias("_host")).where("_host IS NOT NULL").distinct()
    found = None
    for k in range(blocks):
        some = active.where(F.pmod(F.xxhash64("ord", "pattern"), F.lit(blocks)) == k)
        met = hosts.join(F.broadcast(some), F.regexp_like("_host", F.col("_regex"))).select("_host", "ord", "pattern")
        found = met if found is None else found.unionByName(met)
    least = found.groupBy("_host").agg(F.min(F.struct("ord", "pattern")).alias("_r")).select("_host", F.col("_r.pattern").alias("rule"))
    return df.join(least, F.col(host) == F.col("_host"), "left").drop("_host")


def systematic(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every k-th row in the given order, from the first, n at most: k is a n-th of the rows, or 1.  Rows are numbered range by range."""
    step = max(1, df.count() // n)
    at = running(df.withColumn("_k", F.lit(0)), "_k", order, F.lit(1), "_at").withColumn("_at", F.col("_at") - 1)
    return at.where((F.col("_at") % step == 0) & (F.col("_at") < n * step)).drop("_k", "_at")
