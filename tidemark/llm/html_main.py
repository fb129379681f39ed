"""Main text of web pages with a site style tree.

The pages of a host are merged in one tree of element styles (tag and classes from the root down), every block of text in
it. A node's content importance falls with the entropy of its texts over the pages (a text on many pages says
nothing), its presentation importance rises with the entropy of its styles (how many blocks it has on a page). A node with few
styles takes on the importance of its branch, and one on few pages what its place alone says: text in an article is
likely wanted. Nodes of low importance are removed from every page of the host, in articles and out of them. What remains is
looked through once more for what its own tags, roles, classes or ids name as a menu, advert, notice, form or comment,
and where a page marks its article, for what lies outside.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

IMPORTANT = 0.4
#: Weight of the branch for a node with few styles, and of the place for one on few pages: DAMPING to the power of their number.
DAMPING = 0.5
#: Share of the presentation in a node's own importance.
LAYOUT = 0.2
#: Importance of a place before any page of the host has been seen.
IN_ARTICLE, ELSEWHERE = 1.0, 0.7
#: The verdicts are broadcast up to so many.
SMALL = 100_000

# Elements of HTML by what they do to the text.
_RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title head audio video".split())
_TO_THE_END = frozenset("script style textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_MAIN = frozenset(("article", "main"))
_NOISE_TAGS = frozenset("nav aside footer form header menu dialog button fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts adbox banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices "
    "alert popup overlay modal newsletter subscribe subscription signup login sidebar side aside nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager masthead header footer foot copyright comment comments commentlist disqus respond reply replies share sharing social "
    "related recommended recommendations widget toolbar skip search".split()
)
_COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Names and tags that a page's own frame may have: they discard a text only where the page has others. A header inside an article is its title.
_SOFT_NAMES = frozenset(("side", "header"))
#: An article or main element is the page's text if it holds this share of what is kept.
MAIN_SHARE = 0.5
#: A class such as ad-slot, menu-item or comment-list names noise by its first part, with-sidebar names none.
_PARTS = frozenset("area bar block body box column container content group inner item items left link links list outer panel region right row section slot text top bottom unit wrap wrapper".split())
_ADORNED = frozenset("with has have no without is not show hide".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WHITE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


def _noise_word(name: str) -> str:
    """The part of a class or id that names noise, or nothing."""
    parts = _NAME.findall(name)
    if not parts or parts[0] in _ADORNED and len(parts) > 1:
        return ""
    if parts[-1] in _NOISE_NAMES:
        return parts[-1]
    return parts[0] if parts[0] in _NOISE_NAMES and parts[-1] in _PARTS else ""


def _node(tag: str, rest: str, inside: bool = False) -> tuple[str, str]:
    """Style of an element, and what names it as noise: its tag, role or state (`tag`), comments, other names, only a form or a soft name (`soft`), or nothing. inside: it stands in an article."""
    by_tag = "tag" if tag in _NOISE_TAGS and tag != "form" else "soft" if tag == "form" else ""
    if "=" not in rest and "hidden" not in rest:
        return tag, by_tag
    own = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)}
    classes = own.get("class", "").split()
    words = {_noise_word(n) for n in classes + own.get("id", "").split()} - {""}
    if own.get("role") in _NOISE_ROLES or own.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|/|$)", rest):
        by_tag = "tag"
    if inside:
        words.discard("header")
    by_name = "comment" if words & _COMMENT_NAMES else "name" if words - _SOFT_NAMES else "soft" if words else ""
    noise = by_tag if by_tag == "tag" else by_name if by_name in ("comment", "name") else by_tag or by_name
    return ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})]), noise


class _Open:
    __slots__ = ("main", "noise", "path", "tag")

    def __init__(self, tag: str, path: str, noise: str, main: bool):
        self.tag, self.path, self.noise, self.main = tag, path, noise, main


def blocks(page: str) -> list[tuple[str, str, str, bool]]:
    """(path of styles, text, what names it as noise, inside an article) of every block of text, in the page's order."""
    found: list[tuple[str, str, str, bool]] = []
    stack = [_Open("", "", "", False)]
    text: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if text:
            if whole := _WHITE.sub(" ", entities.unescape("".join(text))).strip():
                found.append((stack[-1].path, whole, stack[-1].noise, stack[-1].main))
            text.clear()

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            text.append(page[at:])
            break
        if token.start() > at:
            text.append(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag in _INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        if tag in _RAW:
            if not token[3].endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if shut:
                    at = shut.end()
                elif tag in _TO_THE_END:
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID or tag in _INLINE:
            if tag == "hr":
                flush()
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in _CONTAINERS.get(tag, ()):
                break
            if stack[k].tag == "p" or stack[k].tag in _CLOSES.get(tag, ()):
                close(k)
                if tag not in _CLOSES:
                    break
        above = stack[-1]
        style, noise = _node(tag, token[3], above.main)
        if tag == "header" and above.main or tag in ("html", "body"):
            noise = ""
        # a name on a wrapper, or a form around the page, does not discard the article inside it
        held = "" if tag in _MAIN and above.noise in ("name", "soft") and not above.main else above.noise
        if not token[3].endswith("/"):
            strong = noise if held == "soft" and noise else held or noise
            stack.append(_Open(tag, f"{above.path}/{style}", strong, above.main or tag in _MAIN and not (held or noise)))
    flush()
    return found


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def main_blocks(page: str, removed: set[int], by_name: bool = True) -> tuple[list[str], int, int]:
    """The texts that are neither of a removed node nor named as noise, those of an article where it holds most of them; how many blocks there are, and of removed nodes.

    Where nothing else is left, what only a form or a soft name discards is kept.
    """
    every = blocks(page)
    kept = [b for b in every if _hash(b[0]) not in removed] if removed else every
    good = ([b for b in kept if not b[2]] or [b for b in kept if b[2] == "soft"]) if by_name else kept
    inside = [b[1] for b in good if b[3]] if by_name else []
    if sum(map(len, inside)) < MAIN_SHARE * sum(len(b[1]) for b in good):
        inside = []
    return inside or [b[1] for b in good], len(every), len(every) - len(kept)


def main_text(page: str, removed: set[int], by_name: bool = True) -> str:
    return " ".join(main_blocks(page, removed, by_name)[0])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every node of the hosts' style trees that has text.

    Pages of one host with the same blocks outside menus and notices are one page, so that copies of a page do not make
    their own text unimportant. In a node's content each different text on it is a feature: its entropy over the pages is
    log k / log pages for a text on k of them. The branch of a node is the importance of its parent's texts, all its nodes together.
    """

    @F.pandas_udf("struct<page:long, blocks:array<struct<path:string, content:long, main:boolean>>>")
    def styled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [blocks(x) for x in batch]
            yield pd.DataFrame({
                "page": [_hash("\n".join(t for _, t, noise, _ in page if not noise)) for page in found],
                "blocks": [[{"path": p, "content": _hash(t), "main": main} for p, t, _, main in page] for page in found],
            })

    nodes = pages.select(host_of(F.col("url")).alias("host"), styled(F.coalesce("html", F.lit(""))).alias("s")).select("host", "s.page", F.inline("s.blocks"))
    seen = saved(nodes.groupBy("host", "path", "page", "content").agg(F.max("main").alias("main")))
    sizes = seen.groupBy("host", "path", "page").agg(F.count("*").alias("style"), F.max("main").alias("main"))
    styles = sizes.groupBy("host", "path", "style").agg(F.count("*").alias("k"), F.max("main").alias("main"))
    nodes = styles.groupBy("host", "path").agg(F.sum("k").alias("pages"), F.count("*").alias("styles"), F.sum(F.col("k") * F.log("k")).alias("klogk"), F.max("main").alias("main"))
    texts = seen.groupBy("host", "path", "content").agg(F.count("*").alias("k"))
    texts = texts.groupBy("host", "path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("spread"))
    nodes = nodes.join(texts, ["host", "path"]).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    logs = F.log(F.greatest("pages", F.lit(2)))
    nodes = nodes.withColumn("content", 1 - F.col("spread") / F.col("n") / logs).withColumn("presentation", (F.log("pages") - F.col("klogk") / F.col("pages")) / logs)
    branches = nodes.groupBy("host", "parent").agg((F.sum(F.col("content") * F.col("n")) / F.sum("n")).alias("branch"))
    few_styles, few_pages = F.pow(F.lit(DAMPING), F.col("styles")), F.pow(F.lit(DAMPING), F.col("pages") - 1)
    tree = (1 - few_styles) * ((1 - LAYOUT) * F.col("content") + LAYOUT * F.col("presentation")) + few_styles * (F.col("content") + F.col("branch")) / 2
    place = F.when(F.col("main"), IN_ARTICLE).otherwise(ELSEWHERE)
    return nodes.join(branches, ["host", "parent"]).select("host", "path", "pages", ((1 - few_pages) * tree + few_pages * place).alias("importance"))


def extract(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_low) for each row of pages; n_low counts the blocks of nodes that the tree removes.

    A null html is an empty page with an empty text. A null or odd url is of the host "". Repeated rows come back
    repeated; an empty table gives no rows; other columns are not looked at. Unclosed and stray tags, cut-off pages and pages
    without markup are read as they come. by_name=False leaves out the last check by names and articles: the tree alone decides.
    """

    @F.pandas_udf("long")
    def hashed(paths: pd.Series) -> pd.Series:
        return pd.Series([_hash(p) for p in paths], dtype="int64")

    low = saved(node_importance(pages).where(F.col("importance") < IMPORTANT).groupBy("host").agg(F.collect_set(hashed("path")).alias("removed")))
    size = low.agg(F.sum(F.size("removed"))).first()[0] or 0
    low = low.withColumnRenamed("host", "l_host")

    @F.pandas_udf("struct<text:string, n_blocks:int, n_low:int>")
    def text_only(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, removed in parts:
            got = [main_blocks(h, set() if r is None else set(r.tolist()), by_name) for h, r in zip(html, removed)]
            yield pd.DataFrame({"text": [" ".join(t) for t, _, _ in got], "n_blocks": [n for _, n, _ in got], "n_low": [k for _, _, k in got]})

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).join(F.broadcast(low) if size <= SMALL else low, host_of(F.col("url")) == F.col("l_host"), "left")
    out = rows.select("page_id", "url", text_only("html", "removed").alias("t")).select("page_id", "url", "t.*")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_low")
