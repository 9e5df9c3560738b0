"""Main text of web pages by site style trees (after Yi, Liu and Li, 2003).

Each page is parsed once into blocks of text with the chain of containers above them, and the blocks
are written to a table. The pages of a host are merged on container paths (tags with their class
names) to one tree. A path's presentation importance is the entropy of the presentations (sequences
of child tags) seen there; a block's content importance is one less the entropy of its text over the
pages that have the path, both to the base of the number of those pages. Every branch is judged,
those of articles too: where the composite importance is low - the same text in the same frame on
page after page - the branch is removed. Copies of one page count once, so a page is not judged by
its own copies. Counts are aggregated by (host, path, text) before they move, so a host of any size
stays spread.

Adverts, menus and footers whose text differs on every page have high entropy, so the tree alone
keeps them. What a page says of itself comes first, therefore: branches of elements and roles that
are no text of the article (nav, footer, form, script ...), and branches whose class names say so,
unless such a branch holds most of the page's article. If articles hold three quarters of a page's
text, what lies outside of them is not main text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import Scratch, small_batches

GAMMA = 0.9
LOW = 0.2
LEAST_PAGES = 4  # distinct pages of a host with a path before its blocks are judged

# Element, class and role names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
DROP = frozenset("nav footer aside form script style noscript template iframe svg canvas annotation annotation-xml button select option textarea input label fieldset dialog menu head title audio video noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom mtable mtr mtd mfenced menclose semantics".split())
WITHIN = INLINE | frozenset("button select svg canvas label input textarea script style noscript template iframe audio video annotation annotation-xml".split())  # a block goes on around them
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus respond share sharing social related recommended subscribe newsletter signup login search widget toolbar pagination pager".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TWINS = frozenset("p li tr td th dt dd option".split()) | HEADINGS  # an open one ends where the next begins

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[\s_\-:]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HOST = re.compile(r"^[a-zA-Z][\w+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


def _kind(tag: str, attrs: str) -> tuple[bool, bool, str]:
    """(no text of the article, named so, a lead, the class names that make the presentation)."""
    drop, named, lead, names = tag in DROP, False, tag == "header", ""
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            key, val = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key == "hidden" or key == "aria-hidden" and val.lower() == "true" or key == "style" and _HIDE.search(val):
                drop = True
            elif key == "role":
                drop |= val.strip().lower() in ROLES
            elif key in ("class", "id"):
                names += f".{val.strip().lower()}" if key == "class" else ""
                got = _SPLIT.split(val.lower())
                named |= not NAMES.isdisjoint(got)
                lead |= "header" in got
    return drop, named, lead, names


class _Open:
    """An open container: what is inherited below it, and the child tags it shows. `mark` is the
    number of the innermost container named like clutter, `article` 1 in an article and 2 in the main element, `block` the innermost one that is not inline."""

    __slots__ = ("tag", "drop", "article", "lead", "prose", "mark", "path", "block", "kids")

    def __init__(self, tag: str, drop: bool, article: int, lead: bool, prose: bool, mark: int, path: int, above: _Open | None):
        self.tag, self.drop, self.article, self.lead, self.prose, self.mark, self.path = tag, drop, article, lead, prose, mark, path
        self.block = above.block if above is not None and tag in INLINE else self
        self.kids: list[str] = []


def parse(doc: str) -> list[tuple[str, int, int]]:
    """Blocks of a page in order: (text, path hash, presentation of the container). Branches that
    the page itself marks as no main text give no blocks. Time is linear in the page, however deep."""
    out: list[tuple] = []  # text, in an article, mark, path, child tags
    stack = [_Open("", False, 0, False, False, 0, 0, None)]
    opened: Counter = Counter()
    outer, h1 = [0], [False]  # of each mark: the mark around it, and whether the main heading is in it
    buf: list[str] = []

    def flush() -> None:
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                top = stack[-1].block
                out.append((text, top.article, top.mark, top.path, top.kids))
                if top.tag == "h1":
                    h1[top.mark] = True

    def close(at: int) -> None:
        for x in stack[at:]:
            opened[x.tag] -= 1
        del stack[at:]

    pos, n, last = 0, len(doc), doc.rfind(">") + 1  # behind the last > there is no tag
    while pos < n:
        m = _TAG.search(doc, pos, last) if pos < last else None
        upto = m.start() if m else n
        top = stack[-1]
        if upto > pos and not top.drop and (not top.lead or top.prose):
            buf.append(doc[pos:upto])
        if not m:
            break
        pos = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            if m.group().startswith("<!--") and not m.group().endswith("-->"):
                break  # a comment that never ends
            continue
        if m.group(1):
            if opened[tag] > 0:
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if tag not in WITHIN and not stack[i - 1].drop:
                    flush()
                close(i)
            continue
        if tag == "br" or tag == "wbr":
            if buf and tag == "br":
                buf.append(" ")
            continue
        if tag not in WITHIN:
            if not stack[-1].drop:
                flush()
            if tag in TWINS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag or stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
        parent = stack[-1]
        parent.kids.append(tag)
        if tag in VOID:
            continue
        drop, named, lead, names = _kind(tag, m.group(3))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(doc, pos)
            pos = end.end() if end else n
            continue
        drop |= parent.drop or tag == "header" and not parent.article
        mark = parent.mark
        if named and not drop:
            mark = len(outer)
            outer.append(parent.mark)
            h1.append(False)
        inside = max(parent.article, 0 if drop else 2 if tag == "main" else tag == "article")
        top = _Open(tag, drop, inside, parent.lead or lead, parent.prose or tag == "p" or tag in HEADINGS, mark, _hash(f"{parent.path}/{tag}{names}"), parent)
        if not (m.group(3).endswith("/") and tag in ("svg", "path")):
            stack.append(top)
            opened[tag] += 1
    flush()
    return [(text, path, _hash(">".join(kids))) for text, _, _, path, kids in _own_text(out, outer, h1)]


def _own_text(blocks: list[tuple], outer: list[int], h1: list[bool]) -> list[tuple]:
    """The blocks without those in named containers and, if articles hold nearly all, outside of them.

    A named container stays if it holds most of the page's article text, or, on a page without
    article, most of the text with its main heading. Text outside of articles goes only while it is
    less than a third of theirs: beyond, the articles may be teasers and the text around them the
    page's. A main element is no teaser; outside of it goes what is less than half.
    """
    inside = sum(len(b[0]) for b in blocks if b[1])
    whole = inside or sum(len(b[0]) for b in blocks)
    size = [0] * len(outer)
    for text, article, mark, *_ in blocks:
        if article or not inside:
            size[mark] += len(text)
    for k in range(len(outer) - 1, 0, -1):  # a container is numbered before those in it
        size[outer[k]] += size[k]
        h1[outer[k]] |= h1[k]
    stay = [True] * len(outer)
    for k in range(1, len(outer)):
        stay[k] = stay[outer[k]] and 2 * size[k] > whole and bool(inside or h1[k])
    left = [b for b in blocks if stay[b[2]]]
    inside = sum(len(b[0]) for b in left if b[1])
    share = 1 / 2 if any(b[1] == 2 for b in left) else 3 / 4
    return [b for b in left if b[1]] if inside > share * sum(len(b[0]) for b in left) else left


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, print, texts, keys) of every page; print is the fingerprint of its texts."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64()), ("body", pa.int64())]))
    for b in batches:
        hosts, prints, texts, keys = [], [], [], []
        for url, doc in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            blocks = parse(doc or "")
            hosts.append(host_of(url))
            texts.append([x[0] for x in blocks])
            prints.append(_hash("\n".join(texts[-1])))
            keys.append([{"path": path, "style": style, "body": _hash(text)} for text, path, style in blocks])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(prints, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(keys, kind)],
            ["page_id", "url", "host", "print", "texts", "keys"],
        )


def low_importance(pages: DataFrame, low: float = LOW, least: int = LEAST_PAGES, gamma: float = GAMMA) -> DataFrame:
    """(host, path, body): what the hosts' style trees find unimportant, from (row, host, print,
    keys) of pages. Of pages of a host with one fingerprint one counts, and in a page each path,
    presentation and text once."""
    once = pages.groupBy("host", "print").agg(F.min("row").alias("row")).select("row")
    seen = pages.select("row", "host", "keys").join(once, "row", "left_semi")

    def per(*what: str) -> DataFrame:
        one = F.array_distinct(F.transform("keys", lambda k: F.struct(*(k[c].alias(c) for c in what))))
        return seen.select("host", F.explode(one).alias("k")).groupBy("host", *(F.col(f"k.{c}").alias(c) for c in what)).agg(F.count("*").alias("c"))

    m = per("path").withColumnRenamed("c", "m").filter(F.col("m") >= least)
    styles = per("path", "style").groupBy("host", "path").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clogc"))
    node = m.join(styles, ["host", "path"]).withColumn("node", (F.log(F.col("all").cast("double")) - F.col("clogc") / F.col("all")) / F.log(F.col("m").cast("double")))
    both = per("path", "body").filter("c > 1").join(node, ["host", "path"]).withColumn("content", 1 - F.log(F.col("c").cast("double")) / F.log(F.col("m").cast("double")))
    return both.filter((1 - gamma) * F.least(F.lit(1.0), F.col("node")) + gamma * F.col("content") < low).select("host", "path", "body")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text, blocks joined by two newlines.

    Null or empty html gives an empty text. Null urls share one host, whose name is empty. Repeated
    pages have rows of their own and equal texts. Paths that fewer than LEAST_PAGES different pages
    of a host have are not judged by the tree. Broken markup is read leniently; whole pages are read
    however long or deep. An empty table gives no rows; extra columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    d = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    schema = "page_id long, url string, host string, print long, texts array<string>, keys array<struct<path:long,style:long,body:long>>"
    parsed = scratch.keep(d.mapInArrow(_blocks, schema).withColumn("row", F.monotonically_increasing_id()))
    # Few blocks are of low importance, so these tables are small; Spark broadcasts them if their
    # written size allows, and joins by an exchange if not.
    worst = scratch.keep(low_importance(parsed, low))
    blocks = parsed.select("row", "host", F.explode("keys").alias("k")).select("row", "host", "k.path", "k.body")
    bad = scratch.keep(blocks.join(worst, ["host", "path", "body"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("path", "body")).alias("bad")))
    kept = parsed.join(bad, "row", "left")
    gone = lambda i: F.array_contains("bad", F.struct(F.element_at("keys", i + 1)["path"].alias("path"), F.element_at("keys", i + 1)["body"].alias("body")))
    text = F.array_join(F.filter("texts", lambda _, i: ~F.coalesce(gone(i), F.lit(False))), "\n\n")
    return kept.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
