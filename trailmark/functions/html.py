"""Page facts from HTML, as column expressions over whole documents.

Raw HTML is the widest column of the engine: every fact is computed in the
scan stage and only facts travel further. Regions are found by their tags; an
unclosed region runs to the end of the document.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.functions import paths, text as txt

# name=character pairs as one literal, folded to a map when the plan is optimised
_NAMED = "\x02".join(
    f"{name}\x01{char}" for name, char in ({n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}).items())


def _entity(segment: Column) -> Column:
    """Text that followed an ampersand, with its entity decoded."""
    body = F.regexp_extract(segment, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});", 1)
    rest = F.substr(segment, F.length(body) + 2)
    hexa = F.when(body.rlike("^#[xX]"), F.lpad(F.substr(body, F.lit(3)), 8, "0")).when(
        body.startswith("#"), F.lpad(F.conv(F.substr(body, F.lit(2)), 10, 16), 8, "0"))
    point = F.when((hexa > "00000000") & (F.upper(hexa) <= "0010FFFF") & ~F.upper(hexa).rlike("^0000D[89A-F]"),
                   F.decode(F.unhex(hexa), "UTF-32"))
    named = F.str_to_map(F.lit(_NAMED), F.lit("\x02"), F.lit("\x01"))
    char = F.coalesce(point, F.try_element_at(named, body))
    return F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), segment))


# The entities nearly all text is limited to; the ampersand is last, so nothing is decoded twice.
_COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, decoded once."""
    rare = r"&(?!(?:lt|gt|quot|#39|#039|nbsp|amp);)(?:#|[A-Za-z][A-Za-z0-9]*;)"
    parts = F.split(text, "&")
    every = F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(_entity(s))), "")
    common = text
    for had, want in _COMMON.items():
        common = F.replace(common, F.lit(had), F.lit(want))
    return F.when(~text.contains("&"), text).when(text.rlike(rare), every).otherwise(common)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<[^>]*>", "")


def drop_elements(html: Column, *tags: str) -> Column:
    """Remove whole elements with their content."""
    names = "|".join(tags)
    return F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?(?:</\1\s*>|\z)", "")


def drop_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of one start tag; '' when absent."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?:[\s/][^>]*)?>"), 0)


def _first_tag_attr(html: Column, name: str, attribute: str) -> Column:
    return attr(F.regexp_extract(html, rf"(?is)<{name}(?:[\s/][^>]*)?>", 0), attribute)


def head_facts(html: Column) -> dict[str, Column]:
    """Title, description, robots metas, canonical, language, first h1, structured-data types."""
    inner = lambda tag: squeeze(decode_entities(strip_tags(
        F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1))))
    metas = F.transform(tags(html, "meta"), lambda t: F.struct(
        F.lower(attr(t, "name")).alias("name"), paths.clean(decode_entities(attr(t, "content"))).alias("value")))
    robots = F.filter(metas, lambda m: m["name"].rlike("^(robots|googlebot|bingbot)$|bot|gpt|claude|perplexity"))
    canonical = F.filter(tags(html, "link"), lambda t: F.lower(attr(t, "rel")) == "canonical")
    ld = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1)
    one = r'"@type"\s*:\s*"([^"]+)"'
    many = r'"@type"\s*:\s*\[([^\]]*)\]'
    lists = F.array_join(F.regexp_extract_all(F.array_join(ld, "\n"), F.lit(many), 1), ",")
    types = F.concat(
        F.regexp_extract_all(F.array_join(ld, "\n"), F.lit(one), 1),
        F.regexp_extract_all(lists, F.lit(r'"([^"]+)"'), 1),
        F.regexp_extract_all(html, F.lit(r"""(?is)<[^>]*\sitemtype\s*=\s*["']([^"']+)["']"""), 1),
    )
    return {
        "title": inner("title"),
        "description": F.get(F.filter(metas, lambda m: m["name"] == "description"), F.lit(0))["value"],
        "robots_meta": F.transform(robots, lambda m: F.concat_ws(": ", m["name"], F.lower(m["value"]))),
        "canonical": F.get(F.transform(canonical, lambda t: decode_entities(attr(t, "href"))), F.lit(0)),
        "lang": F.substring(_first_tag_attr(html, "html", "lang"), 1, 20),
        "h1": inner("h1"),
        "schema": F.array_distinct(F.transform(
            types, lambda t: F.regexp_replace(t, r"(?i)^https?://schema\.org/", ""))),
    }


CHROME = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg")


_ROLE = r"""(?is)<([a-z0-9]+)\s[^>]*\brole\s*=\s*["']?main\b[^>]*>(.*)(?:</\1\s*>|\z)"""
_BODY = r"(?is)<body(?:\s[^>]*)?>(.*)(?:</body\s*>|\z)"


def _region_kind(src: Column) -> Column:
    return (
        F.when(src.rlike(r"(?i)<main[\s>]"), "main").when(src.rlike(r"(?i)<article[\s>]"), "article")
        .when(src.rlike(_ROLE), "role").when(src.rlike(_BODY), "body").otherwise("")
    )


def _region_rest(src: Column, kind: Column) -> Column:
    """The text behind the region's start tag."""
    behind = lambda tag: F.regexp_extract(src, rf"(?is)<{tag}(?:\s[^>]*)?>(.*)", 1)
    return (
        F.when(kind == "main", behind("main")).when(kind == "article", behind("article")).when(kind == "role", F.regexp_extract(src, _ROLE, 2))
        .when(kind == "body", F.regexp_replace(F.regexp_extract(src, _BODY, 1), r"(?is)</body\s*>.*$", "")).otherwise("")
    )


def _until_close(rest: Column, kind: Column) -> Column:
    first = lambda tag: F.regexp_extract(rest, rf"(?is)^(.*?)(?:</{tag}\s*>|\z)", 1)
    return F.when(kind == "main", first("main")).when(kind == "article", first("article")).otherwise(rest)


def _nested(rest: Column, tag: str) -> Column:
    """What an element holds that has elements of the same name within it."""
    either = rf"(?is)</?{tag}(?:\s[^>]*)?>"
    parts, marks = F.split(rest, either), F.regexp_extract_all(rest, F.lit(either), 0)

    def step(acc: Column, mark: Column) -> Column:
        depth = acc["depth"] + F.when(mark.startswith("</"), -1).otherwise(1)
        going = acc["depth"] > 0
        return F.struct(F.when(going, depth).otherwise(0).alias("depth"), (acc["n"] + F.when(going & (depth > 0), 1).otherwise(0)).alias("n"))

    # marks before the one that closes the element
    n = F.aggregate(marks, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)["n"]
    return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.get(parts, i), F.when(i < n, F.get(marks, i)).otherwise(""))), "")


def with_main_region(pages: DataFrame, src: str, name: str) -> DataFrame:
    """`pages` with the main content of a comment-free page: first main, article, role=main, else body, without page chrome.

    Each step is a column that the next one reads, so no search over the page is made twice.
    """
    kind, rest, until = F.col("_kind"), F.col("_rest"), F.col("_until")
    inner = lambda tag: (kind == tag) & until.rlike(rf"(?i)<{tag}[\s>]")
    region = F.when(inner("main"), _nested(rest, "main")).when(inner("article"), _nested(rest, "article")).otherwise(until)
    out = pages.withColumn("_kind", _region_kind(F.col(src))).withColumn("_rest", _region_rest(F.col(src), kind)).withColumn("_until", _until_close(rest, kind))
    return out.withColumn(name, drop_elements(region, *CHROME)).drop("_kind", "_rest", "_until")


def content(fragment: Column) -> Column:
    """Stored content without comments and code."""
    return drop_elements(drop_comments(fragment), "script", "style", "noscript")


_BLOCK_END = r"(?is)</(?:p|div|li|h[1-6]|td|th|br|section|article)>"
_PARA_END = r"(?is)</p\s*>|<(?:div|ul|ol|dl|table|h[1-6]|section|article|form|blockquote|pre|hr)[\s/>].*"


def plain_body(body: Column) -> Column:
    """Text of a clean content fragment; block elements keep words apart."""
    return decode_entities(squeeze(strip_tags(F.regexp_replace(body, _BLOCK_END, "\n"))))


def body_parts(body: Column, text: Column) -> dict[str, Column]:
    """Pieces of a content fragment that several facts share; computed once, as columns."""
    heading = r"(?is)<(h[234])(?:\s[^>]*)?>(.*?)</\1\s*>"
    headings = F.filter(
        F.transform(
            F.arrays_zip(F.regexp_extract_all(body, F.lit(heading), 1).alias("tag"),
                         F.regexp_extract_all(body, F.lit(heading), 2).alias("html")),
            lambda h: F.struct(F.lower(h["tag"]).alias("tag"),
                               paths.clean(decode_entities(strip_tags(h["html"]))).alias("text"))),
        lambda h: h["text"] != "")
    hrefs = F.filter(
        F.transform(tags(body, "a"), lambda t: F.trim(decode_entities(attr(t, "href")))),
        lambda h: (h != "") & ~h.startswith("#") & ~h.rlike(r"(?i)^(mailto|tel|javascript):"))
    return {
        "_headings": headings,
        "_hrefs": hrefs,
        "_images": tags(body, "img"),
        "_sentences": txt.sentences(text),
        "words": txt.word_count(text),
    }


def body_facts(body: Column, page_url: Column, home_host: Column) -> dict[str, Column]:
    """Structure and links of a content fragment, from its `body_parts` columns."""
    headings, hrefs, images, sentences = (F.col(c) for c in ("_headings", "_hrefs", "_images", "_sentences"))
    texts = F.transform(headings, lambda h: h["text"])
    questions = F.filter(texts, txt.is_question)
    inner = lambda h: (paths.url_host(h) == "") | paths.same_site(paths.url_host(h), home_host)
    own = paths.normalize_path(page_url)
    links = F.filter(
        F.array_distinct(F.transform(F.filter(hrefs, inner), paths.normalize_path)),
        lambda p: (p != own) & (paths.path_kind(p) == ""))
    paragraphs = F.transform(
        F.slice(F.split(body, r"(?is)<p(?:\s[^>]*)?>"), 2, 1 << 30),
        lambda p: txt.word_count(decode_entities(strip_tags(F.get(F.split(p, _PARA_END, 2), F.lit(0))))))
    return {
        "h2": F.size(F.filter(headings, lambda h: h["tag"] == "h2")),
        "h3": F.size(F.filter(headings, lambda h: h["tag"] != "h2")),
        "headings": texts,
        "question_headings": questions,
        "lists": F.regexp_count(body, F.lit(r"(?i)<(?:ul|ol|dl)[\s/>]")),
        "tables": F.regexp_count(body, F.lit(r"(?i)<table[\s/>]")),
        "images": F.size(images),
        "images_no_alt": F.size(F.filter(
            images, lambda t: (F.trim(attr(t, "alt")) == "") & (attr(t, "role") != "presentation"))),
        "external_links": F.size(F.filter(hrefs, lambda h: ~inner(h))),
        "links": links,
        "faq": body.rlike(r"""(?is)<details[\s/>]|<[^>]*\sclass\s*=\s*(?:"[^"]*faq|'[^']*faq|[^\s"'>]*faq)""")
        | (F.size(questions) >= 3),
        "first_para_words": F.coalesce(F.get(F.filter(paragraphs, lambda n: n >= 5), F.lit(0)), F.lit(0)),
        "avg_sentence": F.when(F.size(sentences) > 0, F.round(F.col("words") / F.size(sentences)).cast("int")).otherwise(0),
        "questions": F.filter(sentences, lambda s: s.endswith("?")),
    }


def noindex(robots_meta: Column, x_robots: Column) -> Column:
    directives = F.lower(F.concat_ws(" ", F.array_join(robots_meta, " "), x_robots))
    return directives.rlike(r"(^|[\s:,])(noindex|none)\b")


def noai(robots_meta: Column, x_robots: Column) -> Column:
    return F.concat_ws(" ", F.array_join(robots_meta, " "), x_robots).rlike(r"(?i)\bno(?:image)?ai\b")


def canonical_elsewhere(canonical: Column, path: Column, home_host: Column) -> Column:
    host = paths.url_host(canonical)
    other_host = (host != "") & ~paths.same_site(host, home_host)
    elsewhere = other_host | (F.lower(paths.normalize_path(canonical)) != F.lower(path))
    return F.coalesce((canonical != "") & elsewhere, F.lit(False))


def light_markdown(html: Column, max_words: int | None = None) -> Column:
    """Content as plain text with headings, list items and paragraphs kept; whole, or its first `max_words` words."""
    t = drop_elements(drop_comments(html), "script", "style", "noscript")
    for level in range(1, 7):
        marks = "#" * min(6, max(3, level + 1))
        t = F.regexp_replace(t, rf"(?is)<h{level}\b[^>]*>\s*(.*?)\s*</h{level}>", f"\n\n{marks} $1\n\n")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)</(p|div|ul|ol|table|tr|blockquote|section|figure)>|<br\s*/?>", "\n\n")
    t = decode_entities(strip_tags(t))
    for had, want in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, had, want)
    t = F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))
    if max_words is None:
        return t
    # the rest after the first `max_words` words, if there is one
    rest = F.get(F.split(t, r"\s+", max_words + 1), F.lit(max_words))
    head = F.regexp_replace(F.substr(t, F.lit(1), F.length(t) - F.length(rest)), r"\s+$", "")
    return F.when(F.coalesce(rest, F.lit("")) != "", F.concat(head, F.lit(" …"))).otherwise(t)
