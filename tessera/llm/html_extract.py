"""Main text of web pages by site template removal.

Every page is scanned once for its elements. A block element's subtree has a hash, made from its own
tag, its text and its children's hashes, so that nesting costs nothing. Spark counts the hashes per
host, and a subtree that recurs across many pages of its host is template and is deleted: this
is the first rule. Running text inside an article is template only where most of the host's
*different* articles have it, since copies of an article, and passages that some share, are no template.
What the counts cannot tell, on hosts of few pages or where a menu differs from page to page, two
rules about what is left do: elements that by their tag, role or class are menus, notices, forms,
comments and the like go, and where a page marks an article, what stands outside of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checked, fits, small, stored, table

#: A subtree is template when this many pages of its host have it, and this share of them; running text
#: inside an article when this many different articles of the host have it, and this share of pages.
LEAST_PAGES = 5
LEAST_SHARE = 0.02
LEAST_ARTICLES = 20
LEAST_ARTICLE_SHARE = 0.6

# Fixed values of HTML: element kinds by their names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr".split())
DROPPED = frozenset("nav footer aside form button select dialog menu object audio video canvas search head fieldset label option datalist".split())
ENDS_P = BLOCK - {"html", "body"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead banner cookie cookies consent notice notices gdpr popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments reply replies respond disqus pagination pager login toolbar skip hidden outbrain taboola".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in NAMED.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if parts[0] in ("has", "no", "with", "is") or not NAMES.intersection(parts) and not (parts == ["header"] and not in_article):
                    continue
                return True
    return False


class Page:
    """pieces: (place, text, unwanted, in article), where text None ends a block; ranges: (from, to,
    running text of an article, hash) of every block element; article: hash of what the page
    marks as its article (of the whole page, where it marks none), whether it marks one in ``marked``."""

    def __init__(self, source: str):
        self.source, self.pieces, self.ranges, self.marked = source, [], [], False
        stack: list[tuple] = []  # tag, from, unwanted, in article, hash of the subtree so far
        whole, articles = xxhash.xxh3_64(), xxhash.xxh3_64()
        at, n = 0, len(source)

        def close(to: int) -> None:
            tag, start, _, inside, seen = stack.pop()
            (stack[-1][4] if stack else whole).update(seen.digest())
            if tag in BLOCK:
                self.pieces.append((to, None, False, False))
                if tag not in ("html", "body", "article", "main"):
                    self.ranges.append((start, to, inside and tag in PROSE, seen.intdigest() - (1 << 63)))
                elif inside and not (stack and stack[-1][3]):
                    articles.update(seen.digest())

        def put(text: str, place: int) -> None:
            if text:
                bad, inside = (stack[-1][2], stack[-1][3]) if stack else (False, False)
                self.pieces.append((place, text, bad, inside))
                (stack[-1][4] if stack else whole).update(text.encode("utf-8", "replace"))

        while at < n:
            m = TAG.search(source, at)
            if not m:
                put(source[at:], at)
                break
            put(source[at : m.start()], at)
            at = m.end() if m.end() > m.start() else m.start() + 1
            if not m[2]:
                continue
            tag, start = m[2].lower(), m.start()
            if m[1]:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if depth is not None and not (tag not in BLOCK and any(s[0] in BLOCK for s in stack[depth:])):
                    while len(stack) > depth:
                        close(at if len(stack) == depth + 1 else start)
                elif tag in BLOCK:
                    self.pieces.append((start, None, False, False))
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n if tag != "noscript" else at
                continue
            if tag == "br":
                put(" ", start)
                continue
            if tag in ENDS_P:
                # A block ends an open paragraph and the inline elements left open in it.
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), None)
                if depth is not None and (stack[depth][0] == "p" or stack[depth][0] == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option")):
                    while len(stack) > depth:
                        close(start)
                self.pieces.append((start, None, False, False))
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            inside = bool(stack) and stack[-1][3]
            bad = bool(stack) and stack[-1][2] or _unwanted(tag, m[3], inside)
            if tag in ("article", "main") and not bad:
                inside = self.marked = True
            seen = xxhash.xxh3_64(m[0].encode("utf-8", "replace"))
            stack.append((tag, start, bad, inside, seen))
        while stack:
            close(n)
        self.article = (articles if self.marked else whole).intdigest() - (1 << 63)

    def rules(self, template: frozenset | set = frozenset()) -> Iterator[tuple[str | None, str]]:
        """(text, rule) of every piece in order: rule says what removes it, first of all "template",
        then "names" and "scope"; it is empty for what stays. Text None ends a block."""
        gone = sorted((a, b) for a, b, _, h in self.ranges if h in template) if template else []
        k, until = 0, -1
        for place, text, bad, inside in sorted(self.pieces, key=lambda p: p[0]):
            while k < len(gone) and gone[k][0] <= place:
                until, k = max(until, gone[k][1]), k + 1
            if text is None:
                yield None, ""
            else:
                yield text, "template" if place < until else "names" if bad else "scope" if self.marked and not inside else ""

    def text(self, template: frozenset | set = frozenset()) -> str:
        blocks, now = [], []
        for text, rule in self.rules(template):
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif not rule:
                now.append(text)
        blocks.append("".join(now))
        found = (SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
        return "\n".join(b for b in found if b)


def _host() -> F.Column:
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def templates(pages: DataFrame) -> DataFrame:
    """host, hash of the subtrees that are template; counts cover all pages. A hash counts once a
    page, running text of an article (``article``) once for each different article."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            hosts, hashes, articles = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                own = {h: page.article if prose else None for _, _, prose, h in page.ranges}
                own[0] = None  # counts the host's pages
                hosts += [host] * len(own)
                hashes += own
                articles += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(articles, pa.int64())], names=["host", "hash", "article"])

    seen = pages.select(_host().alias("host"), "html").mapInArrow(found, "host string, hash bigint, article bigint")
    once = seen.groupBy("host", "hash", "article").agg(F.count("*").alias("n"))
    counts = once.groupBy("host", "hash").agg(F.sum(F.when(F.col("article").isNull(), F.col("n"))).alias("n"), F.sum(F.when(F.col("article").isNotNull(), F.col("n"))).alias("prose"), F.count("article").alias("articles"))
    counts = stored(counts.where((F.col("n") >= LEAST_PAGES) | (F.col("articles") >= LEAST_ARTICLES) | (F.col("hash") == 0)), "html-counts")
    whole = stored(counts.where("hash = 0").select("host", F.col("n").alias("pages")), "html-hosts")
    plain = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("pages"))
    prose = (F.col("articles") >= LEAST_ARTICLES) & (F.col("prose") >= LEAST_ARTICLE_SHARE * F.col("pages"))
    return stored(counts.where("hash <> 0").join(checked(whole), "host").where(plain | prose).select("host", "hash"), "html-templates")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null html is an empty page, with empty text; pages without a host in their url count as one
    site; repeated rows give repeated rows and each counts as a page of its host; no pages give
    none; other columns are not read.
    """
    spark = pages.sparkSession
    known = templates(pages)
    schema = "page_id bigint, url string, text string, n_chars bigint"
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", _host().alias("host"), "html")
    held = None
    if fits(known, 8):
        by_host: dict[str, set] = {}
        for r in known.collect():  # within the bound for broadcasts
            by_host.setdefault(r["host"], set()).add(r["hash"])
        held = spark.sparkContext.broadcast(by_host)
    else:
        lists = known.groupBy("host").agg(F.collect_set("hash").alias("hashes"))
        rows = rows.join(lists, "host", "left").select("page_id", "url", "host", "html", "hashes")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            hosts, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            own = [held.value.get(h, ()) for h in hosts] if held is not None else batch.column(4).to_pylist()
            out = [Page(s or "").text(t if isinstance(t, set) else set(t or ())) for s, t in zip(sources, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(texts, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
