"""Operator 1: main text of web pages by composite text density.

A page is read into a DOM. Each node gets its number of characters, tags, link characters and link tags, and
from them the composite density: characters per tag, divided by how much of them is links. The main subtree is
the node whose children's densities have the largest sum. The smallest density on the path from body to it is the
threshold that other subtrees beside the path must reach to be kept. Where the main subtree lies in an article element
that isn't mostly links, what lies beside it in that article is kept too, but for subtrees that are mostly links and
don't reach the threshold. Level-one headings beside the path are kept at any density, and so are other headings, with
the paragraphs that follow them, right before it. What is kept is rendered whole.

What is no text of a page by its element (nav, aside, footer, form, script, ...), by its role, or because it is hidden
isn't weighed. A class or id is a weight on its node's density: 0 where it names a kind of boilerplate and nothing else
(`ad-box`, `comment-thread`, `cookie-notice`; not `has-sidebar`, `article-header` or `related-work`), unless the node holds
an article, a main element or a level-one heading that isn't so named itself, or nearly all text of the page. Inside an
article or main element, words that may as well be those of a topic (`share`, `notice`, `related`) weigh AMBIGUOUS_WEIGHT,
and nothing on single paragraphs and headings: such a node goes if its weighted density reaches neither the threshold nor
the mean density of the siblings that aren't so named.

Null, empty and tag-less html give an empty text or the plain text; repeated rows are extracted each; very long and
broken html takes time in proportion to its length; an empty table gives an empty result; other columns, also ones named
text or n_chars, are not read, and may not be in `keep`.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CUT = frozenset(
    "head nav aside footer form script style noscript template iframe object embed svg canvas button select textarea input dialog menu map audio video title link meta".split()
)
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbygoogle sponsor sponsored promo promotion banner sidebar sidebars rail menu menus nav navbar navigation topnav breadcrumb breadcrumbs"
    " header masthead footer colophon cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login"
    " comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations pagination pager widget toolbar skip".split()
)
#: Hints that inside an article may name its topic, unless they are said to be lists of something.
AMBIGUOUS = frozenset("share sharing social notice notices related recommended recommendations menu menus".split())
AMBIGUOUS_WEIGHT = 0.75
LISTS = frozenset("posts articles links stories news buttons list items".split())
#: Words that say nothing beside a hint.
NEUTRAL = LISTS | frozenset(
    "site page top bottom left right main primary secondary box wrapper wrap container item block section bar area slot unit form reader user"
    " thread col column columns grid row panel module pane tray strip inner".split()
)
#: A name that begins so is of readers' comments, whatever follows.
COMMENTS = frozenset("comment comments disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p li dd dt blockquote pre td th figcaption".split())
#: Where this share of the page's text or more would go by class and id, the names are of wrappers.
NEARLY_ALL = 0.9
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: An open element on the left ends at the start of one on the right, unless a boundary lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
#: For an element on the left, the open ones that its start ends.
STARTS = {new: {old for old, ends in ENDS.items() if new in ends} for new in {new for ends in ENDS.values() for new in ends}}
INSIDE_P = frozenset("br button".split())
RAW_END = {tag: re.compile(rf"</{tag}(?:\s[^>]*)?>", re.I) for tag in RAW}

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
WORDS = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, cut: bool, weight: float = 1.0):
        self.tag, self.parent, self.parts, self.cut, self.weight = tag, parent, [], cut, weight
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class Tokens:
    """Text and tags of html in order: (text, None, None) or ('', '/'-led or plain tag name, attributes); each character is looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.without: dict[str, int] = {}

    def find(self, what: str, start: int) -> int:
        """As str.find, but a string that once wasn't found isn't looked for again."""
        if self.without.get(what, len(self.html) + 1) <= start:
            return -1
        found = self.html.find(what, start)
        if found < 0:
            self.without[what] = min(start, self.without.get(what, start))
        return found

    def attributes(self) -> dict[str, str]:
        """Attributes from here to the tag's end, which is passed."""
        html, found = self.html, {}
        while m := ATTRIBUTE.match(html, self.at):
            self.at, name, value = m.end(), m[1].lower(), ""
            if m[2]:
                quote = html[self.at : self.at + 1]
                end = self.find(quote, self.at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, self.at = html[self.at + 1 : end], end + 1
                else:
                    value = UNQUOTED.match(html, self.at)[0]
                    self.at += len(value)
            found.setdefault(name, value)
        end = self.find(">", self.at)
        self.at = end + 1 if end >= 0 else len(html)
        return found

    def __iter__(self):
        html = self.html
        while self.at < len(html):
            start = html.find("<", self.at)
            if start < 0:
                break
            if start > self.at:
                yield html[self.at : start], None, None
            m = NAME.match(html, start + 1)
            if m:
                self.at = m.end()
                yield "", m[0].lower(), self.attributes()
            elif html.startswith("<!--", start):
                end = self.find("-->", start + 4)
                self.at = end + 3 if end >= 0 else len(html)
            elif html.startswith(("<!", "<?", "</"), start):
                end = self.find(">", start)
                self.at = end + 1 if end >= 0 else len(html)
            else:
                self.at = start + 1
                yield "<", None, None
        if self.at < len(html):
            yield html[self.at :], None, None

    def pass_raw(self, tag: str) -> None:
        """Go behind the end tag of an element whose content isn't markup."""
        end = RAW_END[tag].search(self.html, self.at)
        self.at = end.end() if end else len(self.html)


def name_weight(names: str, tag: str, in_article: bool) -> float:
    """Weight that the classes and the id of a node give its density: the least of theirs, 1 where none names boilerplate."""
    least = 1.0
    for name in names.split():
        own = WORDS.findall(HUMP.sub("-", name).lower())
        if own and own[0] in COMMENTS:
            return 0.0
        hints = HINTS.intersection(own)
        if not hints or not all(w in HINTS or w in NEUTRAL for w in own):
            continue
        if in_article and hints <= AMBIGUOUS and LISTS.isdisjoint(own):
            least = min(least, 1.0 if tag in PARAGRAPHS else AMBIGUOUS_WEIGHT)
        else:
            least = 0.0
    return least


def cut_by_element(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in CUT or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", "")
    return hidden or attributes.get("role", "").lower() in ROLES


def parse(html: str) -> Node:
    """DOM of a page; text lies in the nodes' parts as plain strings, without what is in cut elements."""
    root = node = Node("#root", None, False)
    articles, is_open, tokens = 0, Counter(), Tokens(html)
    mains = set()  # open elements with the role of main

    def close(to: Node) -> None:
        nonlocal node, articles
        while node is not to:
            articles -= node.tag in ("article", "main") or id(node) in mains
            mains.discard(id(node))
            is_open[node.tag] -= 1
            node = node.parent

    for text, tag, attributes in tokens:
        if tag is None:
            if not node.cut:
                node.parts.append(unescape(text))
            continue
        if tag[0] == "/":
            if is_open[tag[1:]]:
                up = node
                while up.tag != tag[1:]:
                    up = up.parent
                close(up.parent)
            continue
        if tag in BLOCKS and tag not in INSIDE_P and is_open["p"]:
            up = node
            while up is not root and up.tag != "p" and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                close(up.parent)
        if tag in STARTS and any(is_open[t] for t in STARTS[tag]):
            up = node
            while up is not root and up.tag not in ("ul", "ol", "dl", "table", "select", "div", "article"):
                if up.tag in STARTS[tag]:
                    close(up.parent)
                    break
                up = up.parent
        wrapper = tag in ("html", "body", "article", "main")
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}" if attributes else ""
        weighs = names.strip() and (not wrapper or "comment" in names.lower())
        weight = name_weight(names, tag, articles > 0) if weighs else 1.0
        child = Node(tag, node, node.cut or cut_by_element(tag, attributes, articles > 0), weight)
        node.parts.append(child)
        if tag in RAW:
            tokens.pass_raw(tag)
        elif tag not in VOID:
            node = child
            is_open[tag] += 1
            by_role = tag not in ("article", "main") and attributes.get("role", "").lower() == "main"
            articles += by_role or tag in ("article", "main")
            if by_role:
                mains.add(id(child))
    return root


def ordered(root: Node) -> list[Node]:
    """Nodes that aren't cut, parents before their children."""
    nodes = [root]
    for node in nodes:
        nodes += [p for p in node.parts if isinstance(p, Node) and not p.cut]
    return nodes


def weigh(nodes: list[Node]) -> None:
    """Counts, composite densities and the children's density sums, from the leaves up."""
    for node in nodes:
        node.clear()
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(SPACE.sub("", part))
            elif not part.cut:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    ratio = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        if node.chars:
            base = log(node.chars * node.link_chars / max(1, node.chars - node.link_chars) + ratio * node.chars + e)
            node.density = node.chars / max(1, node.tags) * max(0.0, log(node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)) / log(max(base, e)))
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.cut)


def mostly_links(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def headed_run(parts: list, at: int) -> list[Node]:
    """The paragraphs and headings right before parts[at], from the first heading among them on."""
    run = []
    for part in reversed(parts[:at]):
        if isinstance(part, str):
            if part.strip():
                break
        elif not part.cut and part.chars:
            if part.tag not in HEADINGS and part.tag != "p" or mostly_links(part):
                break
            run.append(part)
    while run and run[-1].tag == "p":
        run.pop()
    return run


def rendered(node: Node, keep: set[int] | None) -> str:
    """Blocks of text in page order, one space between them. keep: ids of the subtrees that stay, None for all."""
    blocks, words = [], []

    def end() -> None:
        if block := SPACE.sub(" ", "".join(words)).strip():
            blocks.append(block)
        words.clear()

    stack: list[tuple[object, bool]] = [(node, keep is None)]
    while stack:
        part, kept = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            if kept:
                words.append(part)
        elif not part.cut:
            kept = kept or id(part) in keep
            edge = part.tag in BLOCKS
            if edge:
                end()
                stack.append((None, True))
            stack += [(p, kept) for p in reversed(part.parts)]
    end()
    return " ".join(blocks)


def cut_named(root: Node) -> None:
    """Cut the nodes that weigh nothing by name, but for wrappers of the page's content."""
    nodes = ordered(root)
    weigh(nodes)
    holds = set()
    for node in nodes:
        if node.tag in ("article", "main", "h1") and node.weight and node.chars:
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    named = {id(n) for n in nodes if not n.weight and 0 < n.chars < NEARLY_ALL * root.chars and id(n) not in holds}
    while True:
        outer, inside = [], set()
        for node in nodes:  # parents come first
            if id(node.parent) in inside:
                inside.add(id(node))
            elif id(node) in named:
                inside.add(id(node))
                outer.append(node)
        outer.sort(key=lambda n: -n.chars)
        left = sum(n.chars for n in outer)
        if left < NEARLY_ALL * root.chars or not outer:
            break
        for node in outer:
            if left < NEARLY_ALL * root.chars:
                break
            left -= node.chars
            named.discard(id(node))
    for node in outer:
        node.cut = True


def main_text(html: str | None) -> str:
    """Main text of one page; '' for null."""
    if not html:
        return ""
    root = parse(html)
    cut_named(root)
    nodes = ordered(root)
    weigh(nodes)
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return rendered(root, None)
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    on_path = {id(n) for n in path}
    threshold = min(n.density for n in path if n.tag not in ("#root", "html") or n is best)
    least: dict[int, float] = {}  # for a parent, what its children with ambiguous names must reach
    for node in nodes:
        if 0 < node.weight < 1 and id(node) not in on_path:
            if id(node.parent) not in least:
                plain = [p.density for p in node.parent.parts if isinstance(p, Node) and p.weight == 1 and p.chars and not p.cut]
                least[id(node.parent)] = min(threshold, sum(plain) / len(plain) if plain else threshold)
            node.cut |= node.weight * node.density < least[id(node.parent)]
    articles = [at for at, n in enumerate(path) if n.tag == "article" and not mostly_links(n)]
    inside = articles[-1] if articles else 0
    keep = {id(path[inside])}
    for at, node in enumerate(path[1:], 1):
        beside = [p for p in node.parts if isinstance(p, Node) and not p.cut and id(p) not in on_path]
        if at <= inside:
            for p in beside:
                p.cut = p.tag in BLOCKS and p.tag not in PARAGRAPHS and p.link_tags > 1 and mostly_links(p) and p.density < threshold
        else:
            keep |= {id(p) for p in beside if p.density >= threshold or p.tag == "h1"}
            keep |= {id(p) for p in headed_run(node.parts, node.parts.index(path[at - 1]))}
    return rendered(root, keep)


def with_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns keep, text and n_chars of each page."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def extract(batches):
        for batch in batches:
            for some in text_batches(batch, "__html"):
                texts = [main_text(h) for h in some["__html"].tolist()]
                yield some.drop(columns="__html").assign(text=texts, n_chars=pd.Series([len(t) for t in texts], index=some.index, dtype="int64"))

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string, n_chars long"
    return pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("__html")).mapInPandas(extract, schema)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of all pages."""
    return with_main_text(table(spark, sf_dir, "pages"))
