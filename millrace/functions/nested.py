"""Projections of nested raw records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_array(payload: Column, paths: list[str], element: str) -> Column:
    """The first JSON path that holds a list, as an array of the given struct."""
    return F.coalesce(*[F.from_json(F.get_json_object(payload, p), f"array<{element}>") for p in paths])


ORG = (
    "id string, permalink string, title string, seoname string, coordinates array<double>, ratingData struct<ratingValue:double,ratingCount:long>, "
    "rating double, site string, links array<struct<href:string>>"
)


def org_from_raw(raw: Column) -> Column:
    """oid, title, lat, lon, rating, site of a raw organisation: ids and titles fall back, the presence of ratingData beats the
    legacy rating, the site falls back to the first link.  oid is null where there is none."""
    r = F.from_json(raw, ORG)
    return F.struct(
        F.coalesce(r["id"], r["permalink"]).alias("oid"),
        F.coalesce(F.nullif(r["title"], F.lit("")), r["seoname"], F.lit("")).alias("title"),
        F.get(r["coordinates"], F.lit(1)).alias("lat"),
        F.get(r["coordinates"], F.lit(0)).alias("lon"),
        F.when(r["ratingData"].isNotNull(), r["ratingData"]["ratingValue"]).otherwise(r["rating"]).alias("rating"),
        F.coalesce(r["site"], F.get(r["links"], F.lit(0))["href"]).alias("site"),
    )


CARD = (
    "title string, description string, socialLinks array<struct<type:string,href:string,readableHref:string>>, phones array<struct<number:string>>, "
    "workingTime struct<text:string>, ratingData struct<ratingValue:double,reviewCount:long>"
)


def card_from_raw(raw: Column) -> Column:
    """title, description, socials (links with an address), phones (numbers that are filled), hours, rating, reviews_count of a raw card item;
    null where the item is no object."""
    r = F.from_json(raw, CARD)
    filled = lambda c: c.isNotNull() & (c != "")
    none = F.array().cast("array<string>")
    card = F.struct(
        r["title"].alias("title"), F.nullif(r["description"], F.lit("")).alias("description"),
        F.coalesce(F.filter(r["socialLinks"]["href"], filled), none).alias("socials"), F.coalesce(F.filter(r["phones"]["number"], filled), none).alias("phones"),
        r["workingTime"]["text"].alias("hours"), r["ratingData"]["ratingValue"].alias("rating"), r["ratingData"]["reviewCount"].alias("reviews_count"),
    )
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), card)


BRIEF = "title string, seoname string, categories array<struct<name:string>>, fullAddress string, address string, site string, rating string, reviewsCount long"


def org_brief(raw: Column, most: int = 5) -> Column:
    """What a judge is shown of a raw organisation: name, address, up to ``most`` categories, site and rating, with a dash for what it lacks."""
    r = F.from_json(raw, BRIEF)
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("—"))
    names = F.slice(F.transform(r["categories"], lambda c: F.coalesce(c["name"], F.lit("?"))), 1, most)
    return F.concat(
        F.lit("name: "), first(r["title"], r["seoname"]), F.lit("\naddress: "), first(r["fullAddress"], r["address"]), F.lit("\ncategories: "), first(F.array_join(names, ", ")),
        F.lit("\nsite: "), first(r["site"]), F.lit("\nyandex_rating: "), F.coalesce(r["rating"], F.lit("—")), F.lit(" ("), F.coalesce(r["reviewsCount"], F.lit(0)).cast("string"), F.lit(" reviews)"),
    )


REVIEW = "reviewId string, rating long, text string, textTranslations map<string,string>, updatedTime string"


def review_from_raw(raw: Column) -> Column:
    r = F.from_json(raw, REVIEW)
    return F.struct(r["reviewId"].alias("id"), r["rating"].alias("rating"), F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(F.size(F.map_keys(r["textTranslations"])), F.lit(0)).cast("long").alias("translations"))


def sanitize_sources(sources: Column) -> Column:
    """Sources (url, note) with an http(s) URL whose host has a dot; notes of 300 characters at most."""
    ok = F.filter(sources, lambda s: F.regexp_like(s["url"], F.lit(r"^https?://[^/?#]*\.[^/?#]*")))
    return F.transform(ok, lambda s: F.struct(s["url"].alias("url"), F.substring(s["note"], 1, 300).alias("note")))


def review_snippets(reviews: Column, n: int) -> Column:
    """Of the first 2n reviews up to n that aren't blank, 300 characters each."""
    some = F.filter(F.slice(reviews, 1, 2 * n), lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.slice(F.transform(some, lambda t: F.substring(t, 1, 300)), 1, n)


def strip_reasoning(c: Column) -> Column:
    """Text without <think> or <thinking> blocks; of an unclosed one the part up to the first blank line goes too."""
    closed = F.regexp_replace(c, r"(?is)<think(?:ing)?\b[^>]*>.*?</think(?:ing)?>", "")
    opened = r"(?is)^(.*?)<think(?:ing)?\b[^>]*>(.*)$"
    rest = F.regexp_extract(F.regexp_extract(closed, opened, 2), r"(?s)^.*?\n\s*\n(.*)$", 1)
    whole = F.when(F.regexp_like(closed, F.lit(opened)), F.concat(F.regexp_extract(closed, opened, 1), rest)).otherwise(closed)
    return F.regexp_replace(whole, r"^\s+|\s+$", "")
