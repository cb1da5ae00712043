"""Main text of web pages, with the templates of each site removed.

Every element's subtree, from the body on, is hashed twice: over its tags and text, and over its tags, classes,
ids and roles without text, runs of equal children taken as one. Spark counts on how many different pages
of a host each hash occurs. Subtrees whose text recurs are template, and so are boxes whose form
recurs: elements that are marked by tag, class, id or role or hold nothing but links, have no paragraphs and less than
half of the page's text. Templates go before the main content is chosen. Parts whose tag, role or class says
what they are (menus, adverts, forms …) go too, also where a host has too few pages to count.

Inside an article or main element, paragraphs, headings, lists and tables are never
template, nor is any element in them or around them: pages may well repeat each other's prose.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from trustkpi.llm.shared import arrow_map, attach_dealt, binary_values, packed, unpacked, without
from trustkpi.session import stage

# A template is on MIN_PAGES pages of its host and on MIN_SHARE of them, but never needs more than MOST_PAGES;
# on a host of fewer pages, SMALL_HOST at least, it is on all of them.
MIN_PAGES, MIN_SHARE, MOST_PAGES, SMALL_HOST = 10, 0.02, 200, 3
# Pieces the pages of a template are dealt to.
DEALT = 8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset(
    "head script style noscript template svg math canvas nav header footer aside form button select textarea "
    "input label fieldset iframe object embed dialog menu audio video map".split()
)
_UNSHOWN = frozenset("head title script style noscript template svg math canvas".split())
_BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead "
    "tbody tfoot tr figure figcaption address details summary hr center hgroup".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table figure".split())
_CLOSES_P = _BLOCK | frozenset("nav header footer aside form fieldset menu".split())
_CLOSERS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 dl blockquote pre table figure".split())
_SECTIONS = frozenset("nav header footer aside form menu dialog".split())
# Names of boxes that are no content wherever they stand, and of those that are none outside of it.
_FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay comment comments disqus share sharing related newsletter subscribe breadcrumb breadcrumbs pagination".split()
)
_FRAME = frozenset(
    "alert banner sidebar menu nav navbar navigation header masthead footer social signup login search toolbar widget".split()
)
_PLACES = frozenset(
    "site main page top bottom left right global primary secondary user reader list box block area section wrapper wrap "
    "container inner outer bar slot unit row col item items link links form panel content".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("tag", "children", "marks", "named", "hidden", "drop", "key", "form", "kept", "size", "linked", "textual")

    def __init__(self, tag: str, marks: str = "", named: str = "", hidden: bool = False):
        self.tag, self.children, self.marks, self.named, self.hidden = tag, [], marks, named, hidden
        self.drop, self.key, self.form, self.kept, self.size, self.linked, self.textual = hidden, 0, 0, False, 0, 0, False


def _name_of(token: str) -> str:
    """ "foreign" or "frame" if a class or id is such a name, alone or with words for places, else ''."""
    words = re.split("[-_]+", token)
    if _FOREIGN.isdisjoint(words) and _FRAME.isdisjoint(words):
        return ""
    if not all(w in _FOREIGN or w in _FRAME or w in _PLACES or w.isdigit() or not w for w in words):
        return ""
    return "frame" if _FOREIGN.isdisjoint(words) else "foreign"


def _element(tag: str, attrs) -> _Node:
    if not attrs:
        return _Node(tag, "", "", tag in _DROP)
    marks, names, hidden = [], set(), tag in _DROP
    outer = tag in ("html", "body", "main", "article")
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            tokens = value.split()
            marks += [name + re.sub("[0-9]+", "0", t) for t in tokens]
            if not outer and tag not in _PROSE:
                names.update(_name_of(t) for t in tokens)
        elif name == "role":
            marks.append("role" + value)
            hidden = hidden or value in _ROLES and not outer
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            hidden = hidden or not outer
    named = "foreign" if "foreign" in names else "frame" if "frame" in names else ""
    return _Node(tag, " ".join(sorted(marks)), named, hidden)


class _Tree(HTMLParser):
    """A forgiving tree: a block ends an open paragraph, an end tag closes all that is open inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root")
        self.open = [self.root]

    def _close(self, tags, stop) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                del self.open[at:]
                return
            if self.open[at].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSERS:
            self._close(*_CLOSERS[tag])
        if tag in _CLOSES_P:
            self._close({"p"}, _CLOSES_P - {"p"})
        node = _element(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, ())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: bytes | None) -> _Node:
    tree = _Tree()
    tree.feed((html or b"").decode("utf-8", "replace"))
    tree.close()
    return tree.root


def _walk(root: _Node):
    """(node, inside main content, below its prose) of all elements, children before their parents."""
    order, todo = [], [(root, False, False)]
    while todo:
        node, inside, below = todo.pop()
        inside = inside or node.tag in ("article", "main")
        order.append((node, inside, below))
        below = below or inside and node.tag in _PROSE
        todo += [(c, inside, below) for c in node.children if isinstance(c, _Node)]
    return reversed(order)


def hash_subtrees(root: _Node, host: str = "", lists: bool = True) -> tuple[list[int], list[int]]:
    """Set what each node needs; return the text keys and the form keys of subtrees that may be template, tied to the host.

    Prose of the main content is kept with all that is in it and the elements around it. An element that is all its
    parent holds recurs with the parent and is not listed. Without ``lists`` no element
    goes for its tag, role or class, but those that are never shown.
    """
    order, prose, content, only = [], set(), set(), {}
    seed = xxh64_intdigest(host)
    for node, inside, below in _walk(root):
        parts, forms = [node.tag], [node.tag, node.marks]
        is_prose, holds = node.tag in _PROSE, node.tag in ("article", "main")
        node.textual = node.tag in _TEXTUAL
        for child in node.children:
            if isinstance(child, _Node):
                parts.append(f"<{child.key:x}>")
                form = f"<{child.form:x}>"
                if form != forms[-1]:
                    forms.append(form)
                is_prose = is_prose or id(child) in prose
                holds = holds or id(child) in content
                node.textual = node.textual or child.textual
                node.size += child.size
                node.linked += child.linked
            elif text := " ".join(child.split()):
                parts.append(text)
                node.size += len(text)
        if node.tag == "a":
            node.linked = node.size
        if is_prose:
            prose.add(id(node))
        if holds:
            content.add(id(node))
        outer = node.tag in ("#root", "html", "body") or holds
        node.kept = outer or below or inside and is_prose
        node.drop = node.tag in _UNSHOWN or lists and (
            node.hidden and not (node.tag == "form" and holds) or node.named == "foreign" or node.named == "frame" and not inside and not holds
        )
        if len(parts) > 1:
            node.key = xxh64_intdigest("\x00".join(parts), seed=seed)
        if len(parts) == 2:
            only.update((id(c), node) for c in node.children if isinstance(c, _Node) and c.key)
        node.form = xxh64_intdigest("\x01".join(forms), seed=seed)
        order.append(node)
    texts, boxes = [], []
    for node in order:
        if node.kept or not node.size or node.tag in _UNSHOWN:
            node.form = 0
            if node.kept:
                node.key = 0
            continue
        above = only.get(id(node))
        if above is None or above.kept:
            texts.append(node.key)
        marked = node.tag in _SECTIONS or node.marks or node.linked == node.size
        if marked and not node.textual and 2 * node.size < root.size:
            boxes.append(node.form)
        else:
            node.form = 0
    return texts, boxes


def host_of(url: Column) -> Column:
    """Host of an address in lower case, '' for NULL: what stands before path, query and port and after a user's name."""
    place = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)^.*?://", ""), "^[^/?#]*", 0)
    return F.lower(F.regexp_extract(F.regexp_replace(place, "(?s)^.*@", ""), "^[^:]*", 0))


def site_keys(root: _Node, host: str) -> list[int]:
    """Keys of a page's candidate subtrees, each once."""
    texts, boxes = hash_subtrees(root, host)
    return sorted({*texts, *boxes})


def main_text(root: _Node, templates, prefer_article: bool = True) -> str:
    """Blocks of the main content, without unwanted parts and templates; needs ``hash_subtrees``.

    A page that is nothing but template keeps its text.
    """
    blocks: list[list[str]] = [[]]

    def gone(node):
        return node.drop or node.key in templates or node.form in templates

    def gather(start):
        todo = [(start, False)]
        while todo:
            item, done = todo.pop()
            if isinstance(item, str):
                blocks[-1].append(item)
            elif done:
                blocks.append([])
            elif not gone(item):
                block = item.tag in _BLOCK
                if block:
                    blocks.append([])
                    todo.append((item, True))
                elif item.tag in ("br", "td", "th"):
                    blocks[-1].append(" ")
                todo += [(c, False) for c in reversed(item.children)]

    roots, todo = [], [root]
    while todo:
        node = todo.pop()
        if gone(node):
            continue
        if prefer_article and node.tag in ("article", "main"):
            roots.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, _Node)]
    for node in roots:
        gather(node)
    joined = [" ".join("".join(b).split()) for b in blocks]
    if not any(joined):  # no article, or an empty one: the whole body
        blocks[:] = [[]]
        gather(root)
        joined = [" ".join("".join(b).split()) for b in blocks]
    if templates and not any(joined):
        return main_text(root, frozenset(), prefer_article)
    return "\n".join(b for b in joined if b)


def _signed(keys) -> list[int]:
    return [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def page_keys(pages: DataFrame) -> DataFrame:
    """(host, page, keys) of each different page of (host, html); ``page`` is a digest of both."""

    def run(batches):
        for batch in batches:
            raw = zip(batch.column(0).to_pylist(), binary_values(batch.column(1)))
            keys = [_signed(site_keys(parse(html), host)) for host, html in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], ["host", "page", "keys"]
            )

    found = arrow_map(pages.select("host", "html", _page()), run, "host string, page bigint, keys array<bigint>")
    return stage(found.groupBy("page").agg(F.first("host").alias("host"), F.first("keys").alias("keys")), "page-keys")


def _page() -> Column:
    return F.xxhash64("host", F.coalesce("html", F.lit(""))).alias("page")


def templates(keys: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, key): subtrees that occur on many different pages of their host."""
    pages = keys.groupBy("host").agg(F.count("*").alias("pages"))
    # A key belongs to one host.
    counted = keys.select("host", F.explode("keys").alias("key")).groupBy("key").agg(F.first("host").alias("host"), F.count("*").alias("n"))
    counted = stage(counted.where(F.col("n") >= min(SMALL_HOST, min_pages)), "subtrees")
    most = F.greatest(F.lit(min_pages), F.least(F.ceil(min_share * F.col("pages")), F.lit(max(MOST_PAGES, min_pages))))
    needed = F.when(F.col("pages") < min_pages, F.greatest("pages", F.lit(min(SMALL_HOST, min_pages)))).otherwise(most)
    return attach_dealt(counted, pages, ["host"], ["key"]).where(F.col("n") >= needed).select("host", "key")


def _page_templates(keys: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(page, gone): the templates each page has, joined key by key, so nothing is held for a host as a whole.

    The pages of a template are dealt to ``DEALT`` pieces, each of which meets a copy of it.
    """
    known = templates(keys, min_pages, min_share).select("key", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("piece"))
    cells = keys.select("page", F.explode("keys").alias("key"), F.pmod("page", F.lit(DEALT)).cast("int").alias("piece"))
    found = cells.join(known.hint("merge"), ["key", "piece"], "left_semi")
    return found.groupBy("page").agg(F.collect_list("key").alias("gone"))


def extract(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None,
    min_pages: int | None = MIN_PAGES, min_share: float = MIN_SHARE, lists: bool = True, prefer_article: bool = True,
) -> DataFrame:
    """``pages`` (columns ``keep``) with ``text``, the main text, and ``n_chars``, its code points.

    Blocks are joined by line ends, white space inside a block is one space, character
    references are decoded. Null html is empty, a null url is a host of its own. Copies of a page
    count once on their host and get equal texts. With ``min_pages`` None nothing is taken as template. Without ``lists`` and ``prefer_article`` only
    templates, and what is never shown, are removed from the whole body. A column ``text`` or ``n_chars`` is replaced.
    """
    rows = without(pages, "text", "n_chars")
    carried = list(rows.columns if keep is None else keep)
    work = rows.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), packed(carried))
    if min_pages is None:
        work = work.withColumn("gone", F.lit(None).cast("array<bigint>"))
    else:
        gone = _page_templates(page_keys(work), min_pages, min_share)
        work = work.withColumn("page", _page()).join(gone.hint("merge"), "page", "left")
    work = work.select("host", "html", "gone", "_row")

    def run(batches):
        for batch in batches:
            texts = []
            for host, html, noted in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), batch.column(2).to_pylist()):
                root = parse(html)
                hash_subtrees(root, host, lists)
                texts.append(main_text(root, {g & 0xFFFFFFFFFFFFFFFF for g in noted or ()}, prefer_article))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], ["text", "_row"])

    out = arrow_map(work, run, T.StructType([T.StructField("text", T.StringType()), work.schema["_row"]]))
    return out.select(*unpacked(carried), F.col("text").alias("text"), F.length("text").cast("bigint").alias("n_chars"))
