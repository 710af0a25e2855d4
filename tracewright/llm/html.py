"""Main text of web pages by two passes over text blocks.

A page is cut at block-level tags. Pass one decides each block by its stop-word density, length and link density: link
lists are boilerplate, blocks of some length with many stop words are content, long ones with hardly any are
boilerplate, and short or doubtful ones stay open; short neighbours under the same parent are judged together. Sections
are a prior: blocks of menus, headers, footers, side bars, notices, adverts, forms and reader comments (by tag, role and
whole class words) are boilerplate; on a page with an article or main element, blocks outside need more to be content,
and blocks inside are never decided against for want of stop words. Pass two gives an open block the label of its
nearest decided neighbours, those of the same article first. Blocks labelled as content are joined in page order.

The scan is linear in the page, whatever is wrong with its mark-up. Pages are independent, so extraction needs no shuffle.

Defined cases: null and empty pages, and pages without content blocks, have the empty text; where no block of a page is
decided as content, its open blocks are; repeated rows get equal rows; null ids and urls pass through; other columns are
ignored, whatever their names; an empty table gives an empty result; a page without any tag is one block; a tag whose
quotes do not close ends at the next angle bracket, and what follows an unclosed comment or script is no text.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed rule values: blocks of fewer characters stay open; link shares above this are boilerplate; stop-word shares
#: from this on are content; a block from this length on with under half that share is boilerplate.
SHORT = 70
MAX_LINKS = 0.4
STOP_SHARE = 0.12
LONG = 200

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has have he his in is it its not of on or that the this to was were which with you
    aber als am auch auf aus bei das dem den der des die ein eine er es für hat ich im ist mit nicht sich sie sind und von war wie zu
    au avec ce cette dans de des du elle en est et il la le les mais ne ou par pas plus pour qui que se sur un une vous
    al como con del el ella en es esta este la las lo los más no o para pero por que se sin son su un una y""".split()
)

BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
CONTAINERS = frozenset("article aside blockquote body center dd details dialog div dl dt fieldset figure footer form header li main menu nav ol p section table td th tr ul".split())
#: Items of lists and tables and paragraphs: neighbours of this kind have the same parent.
ITEMS = frozenset("dd dt li p td th tr".split())
#: What a start tag ends if it is still open, but for what stands inside one of the second set.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",))}
SKIPPED = frozenset("head iframe noscript object script select style svg template textarea title audio video canvas".split())
BOILER_TAGS = frozenset("aside button dialog fieldset footer form label menu nav option".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: A class or id word names a boilerplate section if each of its parts is in one of these lists and one is in the first
#: (or, for a header outside of articles, the second); so `has-sidebar`, `comments-open` and `related-work` name none.
SECTION_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr
    notice notices alert alerts popup popups modal overlay newsletter subscribe subscription comment comments commentlist disqus reply replies respond responses
    sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer copyright share sharing social related recommended recommendations
    widget widgets login signin signup search searchbox toolbar masthead skip hidden""".split()
)
HEADER_WORDS = frozenset("header topbar".split())
NEUTRAL_WORDS = frozenset(
    """area article articles bar block blog body bottom box button buttons column container content entry first footer form global google group head header icon icons inner
    item items last left link links list main message page post posts primary right row secondary section site slot story stories submit sub text title top unit user web wrap wrapper""".split()
)
#: On an article element itself only these say that it is none: a reader's comment, an advert, a teaser.
ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended".split())
STATE_WORDS = frozenset("has is no not with without js can".split()), frozenset("open closed enabled disabled allowed on off".split())

_TAG = re.compile(r"<(?:(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)|(?P<other>!--|!\[CDATA\[|[!?]))")
#: Attributes; quoted values may hold any character. A quote that does not close in the page is an ordinary character.
_ATTRS = re.compile(r"""(?:[^"'<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+""")
_QUOTED = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
_ATTR = re.compile(r"""([A-Za-z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^\W\d_]+")
#: Levels that a boilerplate section adds; those of forms alone end at an article or main element, which some sites wrap whole.
FORM, SECTION = 1, 1 << 20


class Block:
    __slots__ = ("text", "linked", "boiler", "article", "heading", "parent", "label")

    def __init__(self, text, linked, boiler, article, heading, parent=0):
        self.text, self.linked, self.boiler, self.article, self.heading, self.parent, self.label = text, linked, boiler, article, heading, parent, None


def names_section(word: str, words: frozenset) -> bool:
    """Whether a class or id word is the name of a section of these kinds."""
    parts = [p for p in re.split(r"[_-]+", _CAMEL.sub("-", word).lower()) if p]
    if not parts or parts[0] in STATE_WORDS[0] and len(parts) > 1 or parts[-1] in STATE_WORDS[1]:
        return False
    return any(p in words for p in parts) and all(p in words or p in SECTION_WORDS or p in NEUTRAL_WORDS or p.isdigit() for p in parts)


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILER_TAGS or tag == "header" and not in_article:
        return True
    if not attrs.strip(" /"):
        return False
    values = {}
    for k, v in _ATTR.findall(attrs):
        values.setdefault(k.lower(), v.strip("\"'"))
    if values.get("role", "").lower() in BOILER_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("body", "html", "main"):
        return False
    words = ARTICLE_WORDS if tag == "article" else SECTION_WORDS if in_article else SECTION_WORDS | HEADER_WORDS
    return any(names_section(w, words) for w in f"{values.get('class', '')} {values.get('id', '')}".split())


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple] = []  # open elements: tag, and boilerplate level, article and parent number before it
    open_at: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
    missing: set[str] = set()  # elements to skip whose end tag does not follow any more
    parts: list[str] = []
    boiler = article = articles = parent = parents = linked = 0
    in_link = ""  # "": none, "closed": up to its end tag, "open": one without end tag, up to the next block
    heading, at, end = False, 0, len(page)

    def close():
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, boiler > 0, article, heading, parent))
        parts.clear()
        linked = 0

    def leave(i: int):
        nonlocal boiler, article, parent
        _, boiler, article, parent = stack[i]
        while len(stack) > i:
            open_at[stack.pop()[0]].pop()

    def enter(tag: str):
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, boiler, article, parent))

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def put(chunk: str):
        nonlocal linked
        parts.append(chunk)
        if in_link:
            linked += len(" ".join(unescape(chunk).split()))

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if other := m["other"]:
            mark = {"!--": "-->", "![CDATA[": "]]>"}.get(other, ">")
            stop = page.find(mark, at)
            if other == "![CDATA[":
                put(page[at : stop if stop >= 0 else end])
            at = stop + len(mark) if stop >= 0 else end
            continue
        found = _ATTRS.match(page, at)
        attrs = found[0]
        if found.end() < end and page[found.end()] == ">":
            at = found.end() + 1
        elif _QUOTED.search(attrs):
            at = found.end()
        else:  # no tag
            put("<")
            at = m.start() + 1
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                in_link = ""
            elif tag in BLOCK_TAGS:
                close()
                heading = False
                in_link = "" if in_link == "open" else in_link
            if open_at.get(tag):
                if tag not in BLOCK_TAGS:
                    close()
                leave(open_at[tag][-1])
            continue
        closed = attrs.endswith("/")
        if tag in SKIPPED:
            if not closed:
                stop = None if tag in missing else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                else:
                    missing.add(tag)
                    if tag != "head":
                        at = end
            parts.append(" ")
        elif tag == "a":
            follows = _LINK.search(page, at)
            in_link = "" if "href" not in attrs.lower() else "closed" if follows and follows[1] else "open"
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            close()
            in_link = "" if in_link == "open" else in_link
            if open_at.get("p"):
                leave(open_at["p"][-1])
            if tag in IMPLIED:
                ended, scopes = IMPLIED[tag]
                if (i := last(ended)) > last(scopes):
                    leave(i)
            heading = tag[0] == "h" and tag[1:].isdigit()
            bad = _boilerplate(tag, attrs, article > 0)
            if (tag in CONTAINERS or bad) and not closed:
                enter(tag)
                if tag not in ITEMS:
                    parents += 1
                    parent = parents
                if tag in ("article", "main") and not bad:
                    articles += 1
                    article = articles
                    boiler = boiler if boiler >= SECTION else 0
                boiler += bad * (FORM if tag == "form" else SECTION)
        elif tag not in VOID and not closed:
            if _boilerplate(tag, attrs, article > 0):  # an inline element that is boilerplate is a block of its own
                close()
                enter(tag)
                boiler += SECTION
            elif open_at.get(tag):
                close()
                enter(tag)
    close()
    return out


def stop_share(texts: list[str]) -> float:
    words = [w for t in texts for w in _WORDS.findall(t.lower())]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: Block, sectioned: bool) -> bool | None:
    """True: content, False: boilerplate, None: open. sectioned: the page has an article or main element."""
    if block.boiler:
        return False
    n, stops = len(block.text), stop_share([block.text])
    if block.linked / n > MAX_LINKS:
        return None if block.article and n >= SHORT and stops >= STOP_SHARE else False
    if sectioned and not block.article:  # outside of the article
        return None if n >= LONG and stops >= STOP_SHARE else False
    if n < SHORT or block.heading:
        return None
    if stops >= STOP_SHARE:
        return True
    return False if n >= LONG and stops < STOP_SHARE / 2 and not block.article else None


def _together(found: list[Block]) -> None:
    """Runs of open blocks under one parent are content if they are so as one block."""
    at = 0
    while at < len(found):
        upto = at + 1
        while upto < len(found) and found[at].label is None and found[upto].label is None and found[upto].parent == found[at].parent:
            upto += 1
        run = [b for b in found[at:upto] if not b.heading]
        if found[at].label is None and len(run) > 1:
            size = sum(len(b.text) for b in run)
            if size >= SHORT and sum(b.linked for b in run) <= MAX_LINKS * size and stop_share([b.text for b in run]) >= STOP_SHARE:
                for b in run:
                    b.label = True
        at = upto


def _inherit(found: list[Block], group, decides) -> None:
    """Open blocks take the label of the nearest block of their group that decides, before or after them; on a tie of
    unequal labels a heading becomes content and any other block boilerplate."""
    choice: list[list[tuple[int, bool]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict = {}
        for i in order:
            if decides(found[i]):
                last[group(found[i])] = i
            elif found[i].label is None and (j := last.get(group(found[i]))) is not None:
                choice[i].append((abs(i - j), found[j].label))
    for block, near in zip(found, choice, strict=True):
        if near:
            least = min(d for d, _ in near)
            votes = {label for d, label in near if d == least}
            block.label = votes.pop() if len(votes) == 1 else block.heading


def second_pass(found: list[Block]) -> None:
    """Labels for open blocks: from neighbours in the same article (lists of links there decide only for themselves), else
    content there; outside from any neighbour outside of boilerplate sections. Without any content so far, all open ones are."""
    _together(found)
    _inherit(found, lambda b: b.article, lambda b: bool(b.article) and not b.boiler and b.label is not None and b.linked / len(b.text) <= MAX_LINKS)
    for block in found:
        if block.article and block.label is None:
            block.label = True
    if any(b.label for b in found):
        _inherit(found, lambda b: 0, lambda b: b.label is not None and not b.boiler)
    for block in found:
        if block.label is None:
            block.label = True


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    sectioned = any(b.article and not b.boiler for b in found)
    for b in found:
        b.label = first_pass(b, sectioned)
    second_pass(found)
    return " ".join(b.text for b in found if b.label)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text for each row of df."""

    def kernel():
        return lambda batch: [batch.column(0), batch.column(1), [main_text(p) for p in common.texts_of(batch.column(2))]]

    kinds = dict(df.dtypes)
    columns = [F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), common.text_column(df, html_col)]
    return common.map_texts(df, columns, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string", kernel, text=2)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
