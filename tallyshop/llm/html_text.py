"""Main text of web pages: blocks of a page, and boilerplate found as token runs that pages of a host share."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm.common import map_rows, staged

RUN_WORDS = 8  # a shared substring counts from so many words on
BROADCAST_KEYS = 1 << 18  # sorted hashes (2 MB) that are sent to every task; beyond that they are joined

# Element and attribute names of HTML with their usual meaning on pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
RAW = set("iframe math noembed noframes noscript object script style svg template textarea title".split())
CHROME_TAGS = set("aside audio button canvas dialog footer form head input label menu nav select video".split())
CHROME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
HARD_WORDS = set("ad ads advert adverts advertisement advertising adsense comment comments disqus replies reply respond sponsor sponsored".split())
SOFT_WORDS = set(
    "alert banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related share sharing sidebar signup "
    "social subscribe subscription toolbar widget widgets".split()
)
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

PLAIN, MAIN, ARTICLE = 1, 2, 3
CHROME = 0
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass(slots=True)
class _Open:
    name: str
    level: int  # what text inside is: CHROME, PLAIN, MAIN or ARTICLE
    hard: bool  # chrome that an article inside does not end


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _opened(name: str, attributes: str, outer: _Open) -> _Open:
    """The state inside a new element."""
    if outer.level == CHROME and outer.hard:
        return _Open(name, CHROME, True)
    found = _attributes(attributes) if attributes.strip() else {}
    if "hidden" in found or name in CHROME_TAGS:
        return _Open(name, CHROME, True)
    role = found.get("role", "").lower()
    if name in ("article", "main", "body", "html"):
        words: set[str] = set() if name in ("body", "html") else {w.lower() for w in _NAME_PART.findall(found.get("class", ""))} & HARD_WORDS
        if name == "article" and words & {"comment", "reply", "ad", "advert", "sponsored"}:
            return _Open(name, CHROME, True)
        level = {"article": ARTICLE, "main": MAIN}.get(name, PLAIN)
        return _Open(name, max(level, outer.level), False)
    if role in CHROME_ROLES or (name == "header" and outer.level < ARTICLE):
        return _Open(name, CHROME, name != "header")
    words = {w.lower() for key in ("class", "id") for w in _NAME_PART.findall(found.get(key, ""))}
    if words & HARD_WORDS:
        return _Open(name, CHROME, True)
    if words & SOFT_WORDS and not (outer.level == ARTICLE and words & SOFT_WORDS == {"header"}):
        return _Open(name, CHROME, False)
    if role == "main" or found.get("itemprop", "").lower() == "articlebody":
        return _Open(name, max(outer.level, ARTICLE if role != "main" else MAIN), False)
    return _Open(name, outer.level, outer.hard)


def blocks(page: str) -> list[tuple[int, str]]:
    """(level, text) of the blocks of a page in order.

    Character references are decoded and white space is one blank. Elements end with their end tag, with that of an
    element around them, or where HTML ends them (paragraphs before blocks, items before items).
    """
    out: list[tuple[int, str]] = []
    stack = [_Open("", PLAIN, False)]
    parts: list[str] = []
    lower = None

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1].level, text))
            parts.clear()

    at = 0
    for tag in _TAG.finditer(page):
        start, end = tag.span()
        if start < at:
            continue
        if start > at:
            parts.append(page[at:start])
        at = end
        name = tag[2] or tag[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), (tag[1] or tag[4]) == "/", (tag[3] or tag[6] or "")
        if name in BLOCK:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                if stack[depth].level != stack[depth - 1].level:
                    flush()
                del stack[depth:]
            elif name == "p":
                flush()
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{name}", at)
            at = len(page) if stop < 0 else stop
            if not attributes.rstrip().endswith("/"):
                flush()
                stack.append(_Open(name, CHROME, True))
            else:
                at = end
            continue
        if name == "br" or name in ("td", "th", "hr", "img"):
            parts.append(" ")
        if name in VOID:
            continue
        if name in BLOCK and stack[-1].name in ("p", *"h1 h2 h3 h4 h5 h6".split()) and name != "hr":
            stack.pop()
        elif name in BLOCK:
            depth = next((i for i in range(len(stack) - 1, max(0, len(stack) - 8), -1) if stack[i].name == "p"), 0)
            if depth and all(x.name not in BLOCK for x in stack[depth + 1 :]):
                del stack[depth:]
        if name in CLOSES_ITSELF and stack[-1].name in CLOSES_ITSELF[name]:
            flush()
            stack.pop()
        if name == "body":
            while len(stack) > 1 and stack[-1].name != "html":
                stack.pop()
        inner = _opened(name, attributes, stack[-1])
        if inner.level != stack[-1].level:
            flush()
        if not attributes.rstrip().endswith("/"):
            stack.append(inner)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def host(url: str | None) -> str:
    """The host of an address, in lower case; empty if there is none."""
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#:]", rest, maxsplit=1)[0].lower()


def _suffixes(site: str, found: list[tuple[int, str]]) -> tuple[np.ndarray, list[int]]:
    """Hash of the token run that begins at each block and the number of blocks it covers.

    A run takes whole blocks until it has ``RUN_WORDS`` words; at the end of a page it may be shorter.
    """
    import xxhash

    words = [len(t.split()) for _, t in found]
    keys, sizes = [], []
    for i in range(len(found)):
        total, j = 0, i
        while j < len(found) and total < RUN_WORDS:
            total += words[j]
            j += 1
        run = "\n".join(t.lower() for _, t in found[i:j])
        keys.append(xxhash.xxh64_intdigest(f"{site}\n{run}".encode("utf-8", "surrogatepass")))
        sizes.append(j - i)
    return np.array(keys, dtype=np.uint64).view(np.int64), sizes


def _stream(found: list[tuple[int, str]]) -> int:
    """Hash of a page's whole token stream, so that copies of a page count as one."""
    import xxhash

    joined = "\n".join(t.lower() for level, t in found if level != CHROME)
    return xxhash.xxh64_intdigest(joined.encode("utf-8", "surrogatepass")) - (1 << 63)


def suffixes(pages: DataFrame) -> DataFrame:
    """(key, stream): for each block of each page, the run that begins there and the page it is on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, streams = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks(page or "")
                if found:
                    own, _ = _suffixes(host(url), found)
                    keys.append(own)
                    streams.append(np.full(len(own), _stream(found), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(streams))], names=["key", "stream"])

    return map_rows(pages.select("url", "html"), work, "key long, stream long")


def shared_runs(pages: DataFrame) -> DataFrame:
    """(key) of the runs that at least two different pages of a host have.

    The suffix array of all hosts is spread over the cluster as its sorted runs: suffixes are cut to ``RUN_WORDS`` words, so
    equal ones meet in one sorted group, where the smallest and the largest page tell whether pages differ. Groups are
    pre-aggregated before they move, so a footer on a third of all pages is one row per task.
    """
    return suffixes(pages).groupBy("key").agg(F.min("stream").alias("a"), F.max("stream").alias("b")).where("a <> b").select("key")


def main_text(found: list[tuple[int, str]], covered: list[bool]) -> str:
    """The article: blocks of the highest level that the page has, without chrome.

    Runs that other pages share are boilerplate outside articles. Inside an article they stay, since pages quote one
    another.
    """
    level = max((lev for lev, _ in found), default=CHROME)
    if level == CHROME:
        return ""
    return "\n\n".join(t for (lev, t), out in zip(found, covered, strict=True) if lev == level and not (out and lev < ARTICLE))


def _covered(keys: np.ndarray, sizes: list[int], shared: np.ndarray) -> list[bool]:
    at = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
    hits = shared[at] == keys if len(shared) else np.zeros(len(keys), dtype=bool)
    out = [False] * len(keys)
    for i in np.flatnonzero(hits).tolist():
        out[i : i + sizes[i]] = [True] * sizes[i]
    return out


def extract(pages: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Main text of ``pages`` (page_id, url, html): page_id, url, text, n_blocks, n_shared, n_kept.

    ``n_shared`` counts blocks in runs shared with other pages of the host. Text of navigation, headers, footers,
    asides, forms, adverts, notices, comments, scripts and styles goes; of the rest, the article stays if the page
    marks one, else its main part, else whatever no other page of the host shares. White space in a block
    is one blank; blocks are joined by a blank line.

    A null or empty html gives an empty text; a null url is a host of its own. Repeated rows come back as
    often; copies of a page count once as evidence. Broken markup ends at the end of the page. An empty table gives no rows;
    other columns are ignored.

    The shared runs go to every task as one sorted array if they are few (``broadcast_keys``); otherwise they are
    joined to the suffixes of each page, so that no table is sent whole.
    """
    shared = staged(shared_runs(pages), "shared-runs")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    schema = "page_id long, url string, text string, n_blocks int, n_shared int, n_kept int"
    if shared.count() <= broadcast_keys:
        keys = np.sort(shared.toArrow().column("key").to_numpy()) if broadcast_keys else np.zeros(0, dtype=np.int64)
        array = pages.sparkSession.sparkContext.broadcast(keys)
        return map_rows(rows, _extractor(lambda batch: None, array), schema)
    page_keys = rows.where("html IS NOT NULL").select(F.xxhash64("url", "html").alias("page"), "url", "html").dropDuplicates(["page"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for page, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = blocks(text)
                if found:
                    keys.append(np.unique(_suffixes(host(url), found)[0]))
                    owners.append(np.full(len(keys[-1]), page, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(keys))], names=["page", "key"])

    of_page = map_rows(page_keys, spread, "page long, key long").join(shared, "key").groupBy("page").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    joined = rows.withColumn("page", F.xxhash64("url", "html")).join(of_page, "page", "left").select("page_id", "url", "html", "keys")
    return map_rows(joined, _extractor(lambda batch: batch.column(3).to_pylist(), None), schema)


def _extractor(own_keys, array):
    """The mapper that parses pages and drops what ``array`` (or each row's own keys) says is shared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lists = own_keys(batch) or [None] * len(pages)
            out = []
            for url, page, keys in zip(urls, pages, lists, strict=True):
                found = blocks(page or "")
                shared = array.value if array is not None else np.array(keys or [], dtype=np.int64)
                covered = _covered(*_suffixes(host(url), found), shared) if found else []
                text = main_text(found, covered)
                out.append((text, len(found), sum(covered), text.count("\n\n") + 1 if text else 0))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:]),
            ], names=["page_id", "url", "text", "n_blocks", "n_shared", "n_kept"])

    return work
