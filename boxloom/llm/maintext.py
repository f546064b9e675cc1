"""Main text of web pages by tree scoring (operator 6).

A page becomes a tree. Every paragraph gives points for its length and its commas to its container, half of them to the one above
and ever less further up; a container's points are discounted by the share of its text that lies in links. The container with most
points is kept, with those of its siblings that score well or read like prose; if it lies in an article or main element, that element is kept. Link
density chooses the container, but cuts nothing out of an article: inside what is kept only furniture goes, and outside of articles
also lists of short links. Articles beside a kept one stay with it if they are of some size and read like prose, and where it has no
h1 of its own, the h1 of the main element around it stays too.

Elements are numbered in page order, a parent before its children, so sums over subtrees go up in one backward pass and what is kept
goes down in one forward pass. Points reach FADE elements up, at most; work is linear in the page, however deep its nesting.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_batches

# Fixed values of HTML: elements without content, raw-text elements, block elements, and what the start of one closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed xmp template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div section article body html form nav aside blockquote td th".split())
# Furniture by element, by role, and by words of class and id; the weak words yield to words that name content.
FURNITURE = frozenset("head nav header footer aside form button select input label fieldset dialog menu svg canvas object audio video math script style noscript iframe template textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
STRONG = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs footer newsletter subscribe popup modal overlay masthead sidebar toolbar pagination pager login signup".split())
WEAK = frozenset("promo promoted promotion header related recommended share sharing social widget banner notice alert tags meta byline skip rail outbrain taboola".split())
CONTENT = frozenset("article content main body post entry story text page".split())
NEVER = frozenset("html body main".split())
# Words of class and id that make an article element a reader's comment, inside an article or where no word names content.
READERS = frozenset("comment comments commentlist disqus".split())
# Words before a word of class and id that turn it into a remark about the layout (layout-with-sidebar, no-ads).
REMARKS = frozenset("with has no without".split())
# Marks at which a sentence ends, and the mean length under which the links of a list read like a menu (code points).
SENTENCE, MENU_LINK = (".", "!", "?", ":", "…", "”", '"'), 25
BONUS = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 3.0, "blockquote": 2.0, "td": 2.0, "pre": 2.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "body": 0.0}

#: How many elements up a paragraph gives points; beyond, its share would be below a fiftieth of them.
FADE = 20

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")


def furniture(tag: str, attrs: str, in_article: bool = False) -> bool:
    """Whether an element is no part of any article. The header of an article holds its title and is one."""
    if tag in FURNITURE and not (tag == "header" and in_article):
        return True
    if not attrs or tag in NEVER:
        return False
    words: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip() in ROLES:
            return True
        if name in ("class", "id"):
            found = _WORDS.findall(value)
            words.update(w for before, w in zip(["", *found], found, strict=False) if before not in REMARKS)
    if tag == "article":
        return bool(words & READERS) and (in_article or not words & CONTENT)
    return bool(words & STRONG) or bool(words & WEAK) and not words & CONTENT


def blocks_of(html: str):
    """(tags, parents, blocks): elements in page order, and the blocks (element, text, characters in links) that are not furniture."""
    tags, parents, gone, links, within = ["#"], [-1], [False], [False], [False]
    open_, blocks, parts, size_in_links = [0], [], [], 0
    owner, owners, opened = 0, [0], Counter()  # owners: the block around each open element, itself included

    def flush():
        nonlocal parts, size_in_links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            blocks.append((owner, text, size_in_links))
        parts, size_in_links = [], 0

    def say(raw):
        nonlocal size_in_links
        if raw and not gone[open_[-1]]:
            parts.append(raw)
            if links[open_[-1]]:
                size_in_links += len(raw)

    def close(to):
        """Leaves elements until `to` of them are open."""
        nonlocal owner
        if any(tags[k] in BLOCKS for k in open_[to:]):
            flush()
        opened.subtract(tags[k] for k in open_[to:])
        del open_[to:], owners[to:]
        owner = owners[-1]

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        ending, tag, attrs = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if ending:
            for k in () if opened[tag] <= 0 else range(len(open_) - 1, 0, -1):
                if tags[open_[k]] == tag:
                    close(k)
                    break
                if tag not in BLOCKS and tags[open_[k]] in BLOCKS:
                    break
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            to = len(open_)
            for k in range(len(open_) - 1, 0, -1):
                name = tags[open_[k]]
                if name == "p" or name in CLOSES.get(tag, ()):
                    to = k
                if name in SCOPES and name not in CLOSES.get(tag, ()):
                    break
            if to < len(open_):
                close(to)
            flush()
        up = open_[-1]
        tags.append(tag)
        parents.append(up)
        gone.append(gone[up] or furniture(tag, attrs, within[up]))
        within.append(within[up] or tag == "article")
        links.append(links[up] or tag == "a")
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            if not end:
                at = n
                continue
            close_at = html.find(">", end.end())
            at = n if close_at < 0 else close_at + 1
            continue
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        open_.append(len(tags) - 1)
        opened[tag] += 1
        if tag in BLOCKS:
            owner = len(tags) - 1
        owners.append(owner)
    flush()
    return tags, parents, blocks


def main_text(html: str | None) -> str:
    """Blocks of the best container and of its good siblings, in page order, parted by an empty line."""
    if not html:
        return ""
    tags, parents, blocks = blocks_of(html)
    if not blocks:
        return ""
    n = len(tags)
    score, chars, linked, counted, said, titled = [0.0] * n, [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for owner, text, in_links in blocks:
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - min(1.0, in_links / len(text)))
        node = owner if tags[owner] in BONUS or owner == 0 else parents[owner]
        for level in range(FADE):
            if node < 0:
                break
            score[node] += points / (1, 2, 6, 9)[level] if level < 4 else points / (3 * level)
            node = parents[node]
        chars[owner] += len(text)
        linked[owner] += min(in_links, len(text))
        counted[owner] += 1
        said[owner] |= text.endswith(SENTENCE)
        titled[owner] |= tags[owner] == "h1"
    apart = [counted[k] if tags[k] not in BONUS and k else 0 for k in range(n)]  # blocks that are no container and give to their parent
    for k in range(n - 1, 0, -1):
        for sums in (chars, linked, counted):
            sums[parents[k]] += sums[k]
        for marks in (said, titled):
            marks[parents[k]] |= marks[k]
    density = lambda k: linked[k] / chars[k] if chars[k] else 0.0
    worth = {k: (score[k] + BONUS.get(tags[k], 0.0)) * (1 - density(k)) for k in range(n) if counted[k] > apart[k]}
    best = max(sorted(worth), key=worth.__getitem__)
    k, main = best, -1
    while k > 0:  # the outermost article, or else the main element, that the best container lies in
        if tags[k] == "article" or tags[k] == "main" and tags[best] != "article":
            best = k
        if tags[k] == "main":
            main = k
        k = parents[k]
    whole = tags[best] in ("article", "main")
    keep = {best}
    beside = [k for k in range(n) if parents[k] == parents[best] and k != best and chars[k]]
    if tags[best] == "article":
        keep.update(k for k in beside if tags[k] == "article" and density(k) < 0.25 and said[k] and chars[k] >= 0.2 * chars[best])
        if main >= 0 and not titled[best]:
            outside = [False] * n  # in the main element and in no article of it
            for k in range(main, n):
                outside[k] = k == main or outside[parents[k]] and tags[k] != "article"
            keep.update(owner for owner, _, _ in blocks if tags[owner] == "h1" and outside[owner])
    elif best and not whole and tags[best] not in ("body", "html"):
        for k in beside:
            good = worth.get(k, -1.0) >= max(10.0, 0.2 * worth[best])
            prose = density(k) < 0.25 and (said[k] or tags[k] in ("p", "pre", "blockquote", "h1", "h2", "h3"))
            if good or prose:
                keep.add(k)
    inside, menu = [False] * n, [False] * n
    for k in range(n):
        up = parents[k]
        inside[k] = k in keep or up >= 0 and inside[up]
        own = not whole and tags[k] in ("ul", "ol", "dl") and density(k) > 0.5 and chars[k] < MENU_LINK * counted[k]
        menu[k] = k not in keep and (own or up >= 0 and menu[up])
    return "\n\n".join(text for owner, text, _ in blocks if inside[owner] and not menu[owner])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages' other columns with text and n_chars (code points), for every row; a null or empty page has empty text.

    Columns of the input that are named text or n_chars give way to the new ones.
    """
    small_batches(pages.sparkSession, 200)
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(html_col)
            texts = [main_text(h) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*rest, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
