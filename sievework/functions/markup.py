"""Markup columns: character references, links of a page, and elements that are cut out with all they hold."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references without a semicolon that the standard allows, the longest first; names and values are the standard library's table.
_LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers that don't stand for their own character: read as the Windows code page, dropped, or replaced.
_RENUMBERED = {n: html.unescape(f"&#{n};") for n in (*range(1, 32), *range(127, 160), 0xFFFE, 0xFFFF) if html.unescape(f"&#{n};") != chr(n)}
_REPLACED = "�"

# Tags, the attributes that name an element, names of consent components, elements without an end, and roots that stay.
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)\b([^>]*?)(/?)>"
NAMING = r"""(?is)\b(?:id|class|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
CONSENT = r"""(?i)cookie|consent|gdpr|onetrust|cmplz|cookielawinfo|(?:^|[\s"'])cli-"""
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
ROOTS = ("html", "body", "main", "article", "head")


def _table(entries: dict) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a code point, by its number."""
    own = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    outside = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    noncharacter = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    special = F.try_element_at(_table({str(n): c for n, c in _RENUMBERED.items()}), number.cast("string"))
    return F.when(outside, F.lit(_REPLACED)).when(noncharacter, F.lit("")).otherwise(F.coalesce(special, own))


def unescape(text: Column) -> Column:
    """Character references replaced by their characters: by number, by name, and by the names that may go without a semicolon.

    What is no reference stays as it is. A null stays null.
    """
    names, legacy = _table(html5), "^(?:" + "|".join(_LEGACY) + ")"

    def decoded(p):
        by_number = F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        digits = F.regexp_extract(by_number, "[0-9a-fA-F]+", 0)
        hexadecimal = by_number.rlike("^#[xX]")
        # Numbers of more than 15 digits are far outside.
        number = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 15, F.lit(None).cast("long")).otherwise(F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).try_cast("long"))
        decimal = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 15, F.lit(None).cast("long")).otherwise(digits.try_cast("long"))
        by_name = F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};?", 0)
        exact = F.try_element_at(names, by_name)
        start = F.regexp_extract(p, legacy, 0)
        rest = lambda used: F.substring(p, F.length(used) + 1, F.length(p))
        return (
            F.when(by_number != "", F.concat(_character(F.when(hexadecimal, number).otherwise(decimal)), rest(by_number)))
            .when(exact.isNotNull(), F.concat(exact, rest(by_name)))
            .when(start != "", F.concat(F.element_at(names, start), rest(start)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    parts = F.split(text, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def hrefs(page: Column) -> Column:
    """The addresses of a page's anchors as written, quoted either way or not at all, with character references decoded."""
    found = F.regexp_extract_all(page, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    return F.transform(found, lambda h: unescape(F.trim(F.regexp_replace(h, r"""^["']|["']$""", ""))))


def resolve(base: Column, href: Column) -> Column:
    """An address as seen from a page: absolute, of the page's scheme, host, path or query, with dot segments worked out; blank stays the page itself."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"#.*$", "")
    page = F.regexp_replace(bare, r"\?.*$", "")
    folder = F.regexp_extract(F.substring(page, F.length(site) + 1, F.length(page)), r"^(.*/)[^/]*$", 1)
    path, tail = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)

    def without_dots(p):
        step = lambda a, s: F.when(s == ".", a).when(s == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), s))
        walked = F.aggregate(F.slice(F.split(p, "/"), 2, 1_000_000), F.lit(""), step)
        return F.concat(walked, F.when(p.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))

    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(href == "", bare)
        .when(F.startswith(href, F.lit("#")), F.concat(bare, href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .otherwise(F.concat(site, without_dots(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))), tail))
    )


def links(page: Column, base: Column) -> Column:
    """The addresses that a page's anchors lead to, in order."""
    return F.transform(hrefs(page), lambda h: resolve(base, h))


def remove_elements(page: Column, naming: str = CONSENT) -> Column:
    """Struct (html, removed): a page without the elements whose id, class or label matches, each with all it holds.

    Tags are taken in order. From an opening tag that matches, a running depth counts the tags of that name; the element ends where
    the depth returns to nothing. It is cut out unless it never ends or is longer than half of the page (then it is the
    page's wrapper, and what it holds is looked at in turn). Roots of a document and elements without an end are never cut. A null page gives null.
    """
    name = lambda t: F.lower(F.regexp_extract(t, TAG, 2))
    known = lambda t: F.struct(
        t.alias("tag"),
        name(t).alias("name"),
        F.when(F.regexp_extract(t, TAG, 4) == "/", 0).when(F.regexp_extract(t, TAG, 1) == "/", -1).otherwise(1).alias("step"),
        (
            (F.regexp_extract(t, TAG, 1) == "") & (F.regexp_extract(t, TAG, 4) == "") & ~name(t).isin(*VOID, *ROOTS)
            & F.exists(F.regexp_extract_all(F.regexp_extract(t, TAG, 3), F.lit(NAMING), F.lit(1)), lambda v: v.rlike(naming))
        ).alias("starts"),
    )

    def cut(x):
        tags, texts = x["tags"], x["texts"]
        last = F.size(tags)

        def end_of(k, t):
            """Index of the tag that ends the element, or -1: the running depth returns to nothing there for the first time."""
            walk = F.aggregate(
                F.sequence(k + 1, last),
                F.struct(F.lit(1).alias("depth"), F.lit(-1).alias("end")),
                lambda a, j: F.when((a["end"] >= 0) | (j >= last) | (F.get(tags, j)["name"] != t["name"]), a).otherwise(
                    F.struct((a["depth"] + F.get(tags, j)["step"]).alias("depth"), F.when(a["depth"] + F.get(tags, j)["step"] == 0, j).otherwise(F.lit(-1)).alias("end"))
                ),
            )
            return walk["end"]

        def length(k, e):
            """Characters from the start of tag k to the end of tag e."""
            inner = F.aggregate(F.slice(tags, k + 1, e - k + 1), F.lit(0), lambda a, t: a + F.length(t["tag"]))
            return inner + F.aggregate(F.slice(texts, k + 2, F.greatest(e - k, F.lit(0))), F.lit(0), lambda a, t: a + F.length(t))

        none = F.array().cast("array<struct<start:int,end:int>>")
        state = F.struct(F.lit(0).alias("next"), none.alias("cuts"))

        def step(a, k):
            tag = F.get(tags, k)
            tried = F.get(F.transform(F.array(end_of(k, tag)), lambda e: F.when((e >= 0) & (length(k, F.greatest(e, k)) <= F.floor(x["size"] / 2)), e).otherwise(F.lit(-1))), F.lit(0))
            done = F.get(F.transform(F.array(tried), lambda e: F.when(e >= 0, F.struct((e + 1).alias("next"), F.array_append(a["cuts"], F.struct(k.alias("start"), e.alias("end"))).alias("cuts"))).otherwise(F.struct(a["next"].alias("next"), a["cuts"].alias("cuts")))), F.lit(0))
            return F.when((k >= a["next"]) & tag["starts"], done).otherwise(a)

        starts = F.filter(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda k: F.coalesce(F.get(tags, k)["starts"], F.lit(False)))
        cuts = F.aggregate(starts, state, step)["cuts"]

        def glued(c):
            # The page between the cuts: text k stands before tag k.
            first = F.concat(F.array(F.lit(0)), F.transform(c, lambda r: r["end"] + 1))
            stop = F.concat(F.transform(c, lambda r: r["start"]), F.array(last))
            # After a cut that ends with tag e, the text behind it (e + 1) is the first one kept.
            part = lambda lo, hi: F.array_join(F.flatten(F.zip_with(F.slice(texts, lo + 1, hi - lo + 1), F.slice(tags, lo + 1, hi - lo + 1), lambda w, t: F.array(w, F.coalesce(t["tag"], F.lit(""))))), "")
            ends = F.zip_with(first, stop, lambda lo, hi: F.concat(part(lo, hi - 1), F.get(texts, hi)))
            return F.struct(F.array_join(ends, "").alias("html"), F.size(c).alias("removed"))

        return F.get(F.transform(F.array(cuts), glued), F.lit(0))

    taken = F.struct(F.transform(F.regexp_extract_all(page, F.lit(TAG), F.lit(0)), known).alias("tags"), F.split(page, TAG).alias("texts"), F.length(page).alias("size"))
    untouched = F.struct(page.alias("html"), F.lit(0).alias("removed"))
    return F.when(page.isNull(), F.lit(None)).when(page.rlike(naming), F.get(F.transform(F.array(taken), cut), F.lit(0))).otherwise(untouched)
