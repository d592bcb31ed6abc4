"""Main text of web pages: the best contiguous region of a page's words and tags.

A page is a sequence of tokens, and one linear scan finds the run with the
largest sum of weights.  A token's weight is the log odds that a token of its
class lies inside against outside the article, counted over labelled pages (a
stated, bounded number of pages whose markup says where the article is) on top
of default counts: words mostly score above zero, tags below.

The class of a word is the *mark* of the element it stands in: the element's own
name where that says something (nav, footer, form, ...) or a word of its class, id or role
(ad, comments, sidebar, ...).  Marks of which no word was ever in an article get weights
below zero by the counts, others above.  An element within an element of negative
weight belongs to it; one that holds the page's largest article, or most of
the words of a page without articles, has no mark.  Words without a mark are
classes of their own: in or out of an article, in a link, or plain.  Pages without articles are
scored by what the labelled ones show if their article tags are not looked at.

In the region, words of marks with negative weight are left out; such an element
costs the run at most DETOUR, so an advert inside an article does not cut off what
follows.  Block elements part blocks; character references are decoded, white space inside a block
becomes one space, and blocks are joined by one newline.  Nothing else is dropped.

Cases: null and empty html and pages without words give an empty text.
Unclosed or stray tags are taken as browsers mostly take them.  Repeated rows
each keep theirs; an empty table gives no rows; extra columns are left out.
Work is linear in a page's length, whatever is left unclosed.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.textarrays import bounded, released

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
# Up to the end of a tag: a quote opens only after "=", and only if it closes.
REST = re.compile(r"((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

# Fixed values of HTML: elements that never hold article text, that stand as blocks, that have no end tag.
RAW = frozenset("script style textarea title iframe noscript template svg math select object canvas video audio".split())
#: Of these only the first four take in the rest of a page that never closes them.
ENDLESS = frozenset("script style textarea title".split())
SECTIONS = frozenset("nav footer aside form button dialog menu fieldset label option datalist map head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role by which elements name themselves as something else than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidenav comment comments commentlist disqus "
    "reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer header masthead topbar toolbar pagination pager "
    "contentinfo complementary search skip widget".split()
)
# Words beside which such a word still names the element.
BESIDE = frozenset("area bar block body box button buttons container content entry form group holder icon icons inner item items label layer line link links list main outer page panel post posts row section site slot text title top bottom unit wrap wrapper left right".split())
INSIDE = frozenset("article main".split())
#: Elements that are text themselves: these are named only by words that say nothing else.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr em i b strong a span code".split())

# Default counts (inside, outside) on top of which labelled pages count.
PRIOR = {"word": (60.0, 20.0), "word:a": (10.0, 10.0), "word:in": (60.0, 20.0), "word:out": (1.0, 60.0), "tag": (2.0, 6.0), "tag:in": (60.0, 60.0), "tag:a": (1.0, 5.0), "tag:li": (6.0, 5.0), "tag:p": (20.0, 12.0), "tag:b": (6.0, 5.0), "tag:i": (6.0, 5.0), "tag:em": (6.0, 5.0), "tag:strong": (6.0, 5.0), "tag:br": (8.0, 6.0), "tag:span": (4.0, 5.0)}
PRIOR |= {f"tag:{t}": (6.0, 5.0) for t in "h1 h2 h3 h4 h5 h6 ul ol dl dt dd blockquote pre code table tbody tr td th figure figcaption".split()}
PRIOR |= {f"mark:{t}": (1.0, 60.0) for t in NAMES | SECTIONS | {"hidden"}}
#: Of a mark that is only known from labelled pages, and how many of these must show it.
UNKNOWN, SEEN = (2.0, 2.0), 3
DETOUR = 10.0
#: Shares of a page's words from which an element without an article inside is the page, whatever it is called.
WHOLE, WHOLE_FORM = 0.8, 0.5


def _marks(name: str, attributes: str, inside: bool, every: bool = False) -> list[str]:
    """What an element's name, class, id and role say, and whether it is not shown; ``every`` word of them, or those that name it."""
    found = [name] if name in SECTIONS or name == "header" and not inside else []
    if not attributes or name in ("html", "body"):
        return found
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").strip()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            found.append("hidden")
        elif key in ("class", "id", "role", "aria-label") and not (inside and name in ("header", "hgroup")):
            for token in value.split():
                words = [w.lower() for w in PARTS.findall(token)]
                strict = (inside or name in TEXTUAL) and not every
                if not strict or not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words):
                    found += words
    return found


class Page:
    """The tokens of a page and the elements that they stand in.

    ``tokens`` has (element, text, tag, block): ``tag`` is empty for text, whose
    ``text`` is as in the source.  Element 0 is the page.
    """

    def __init__(self, html_: str):
        self.tokens: list[tuple[int, str, str, bool]] = []
        self.parent, self.name, self.attributes, self.words = [0], [""], [""], [0]
        self._parse(html_)
        for e in range(len(self.parent) - 1, 0, -1):
            self.words[self.parent[e]] += self.words[e]
        articles = [e for e, n in enumerate(self.name) if n in INSIDE and self.words[e] and NAMES.isdisjoint(_marks(n, self.attributes[e], False))]
        self.article = max(articles, key=lambda e: self.words[e], default=0)

    def _text(self, e: int, text: str) -> None:
        self.words[e] += len(text.split())
        self.tokens.append((e, text, "", False))

    def _parse(self, page: str) -> None:
        stack, open_ = [0], Counter()
        at, n, never, loose = 0, len(page), set(), False
        while at < n:
            if page[at] != "<":
                end = page.find("<", at)
                end = n if end < 0 else end
                self._text(stack[-1], page[at:end])
                at = end
                continue
            m = NAME.match(page, at)
            if m is None:
                if page.startswith("<!--", at):
                    end = page.find("-->", at + 4)
                    at = n if end < 0 else end + 3
                elif page.startswith("<![CDATA[", at):
                    end = page.find("]]>", at)
                    self._text(stack[-1], page[at + 9 : n if end < 0 else end])
                    at = n if end < 0 else end + 3
                elif page.startswith(("<!", "<?", "</"), at):
                    end = page.find(">", at)
                    at = n if end < 0 else end + 1
                else:
                    self._text(stack[-1], "<")
                    at += 1
                continue
            closing, name = bool(m.group(1)), m.group(2).lower()
            rest = None if loose else REST.match(page, m.end())
            if rest is None:  # no end of a tag beyond here, but for those in quotes
                loose, end = True, page.find(">", m.end())
                if end < 0:
                    return
                attributes, at = page[m.end() : end], end + 1
            else:
                attributes, at = rest.group(1), rest.end()
            alone = name in VOID or attributes.endswith("/")
            if name in RAW and not closing and not alone and name not in never:
                end = re.compile(f"</{name}\\b[^>]*+>", re.I).search(page, at)
                if end:
                    at = end.end()
                    self.tokens.append((stack[-1], "", name, False))
                    continue
                if name in ENDLESS:
                    return
                never.add(name)
            block = name in BLOCKS
            if closing:
                if open_[name]:
                    while self.name[stack[-1]] != name:
                        open_[self.name[stack.pop()]] -= 1
                    self.tokens.append((stack.pop(), "", name, block))
                    open_[name] -= 1
                else:
                    self.tokens.append((stack[-1], "", name, block))
                continue
            if name == "body" and open_["head"]:
                while self.name[stack.pop()] != "head":
                    pass
                open_.clear()
                open_.update(self.name[e] for e in stack)
            if alone:
                self.tokens.append((stack[-1], " " if name == "br" else "", name, block))
                continue
            if len(stack) > 1 and self.name[stack[-1]] == name and name in ("p", "li", "dt", "dd", "option", "a") or name in BLOCKS and self.name[stack[-1]] == "p":
                open_[self.name[stack.pop()]] -= 1
            e = len(self.parent)
            self.parent.append(stack[-1])
            self.name.append(name)
            self.attributes.append(attributes)
            self.words.append(0)
            stack.append(e)
            open_[name] += 1
            self.tokens.append((e, "", name, block))

    def classes(self, known, marked: bool) -> list[str]:
        """The class of each token's words or tag, by the marks that are ``known`` (a weight by class).

        ``marked``: whether article tags are looked at.
        """
        holds = {0}
        if self.article:
            e = self.article
            while e:
                e = self.parent[e]
                holds.add(e)
            if marked:
                holds.add(self.article)
        total = max(self.words[0], 1)
        inside, link, mark = [False], [False], [""]
        for e in range(1, len(self.parent)):
            up, name = self.parent[e], self.name[e]
            within = inside[up] or marked and name in INSIDE
            inside.append(within)
            link.append(name == "a" or link[up] and name not in BLOCKS)
            own = mark[up]
            if not own:
                share = self.words[e] / total
                if e not in holds and not (not self.article and share > (WHOLE_FORM if name == "form" else WHOLE)):
                    bad = [k for k in _marks(name, self.attributes[e], within and marked) if known.get("mark:" + k, 0.0) < 0]
                    own = min(bad, key=lambda k: (known["mark:" + k], k), default="")
            mark.append(own)
        out = []
        for e, _, tag, _ in self.tokens:
            if mark[e]:
                out.append("mark:" + mark[e])
            elif tag:
                out.append("tag:in" if marked and inside[e] else "tag:" + tag)
            elif marked:
                out.append("word:in" if inside[e] else "word:out")
            else:
                out.append("word:a" if link[e] else "word")
        return out


def weights(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log odds by class, -6 to 3; of tags -6 to -0.01."""
    out = {}
    for kind in {*counts, *PRIOR}:
        a, b = PRIOR.get(kind) or (UNKNOWN if kind.startswith("mark:") else PRIOR[kind.split(":")[0]])
        x, y = counts.get(kind, (0.0, 0.0))
        odds = math.log((a + x) / (b + y))
        out[kind] = min(-0.01, max(-6.0, odds - 0.5)) if kind.startswith("tag") else min(3.0, max(-6.0, odds))
    return out


def scores(page: Page, kinds: list[str], weight: dict[str, float]) -> list[float]:
    """The weight of each token; an element left out costs at most DETOUR."""
    out, tag, left = [], weight["tag"], DETOUR
    for (_, text, name, _), kind in zip(page.tokens, kinds, strict=True):
        own = weight.get(kind, tag) * (1 if name else len(text.split()))
        if kind.startswith("mark:"):
            own = max(own, -left)
            left += own
        else:
            left = DETOUR
        out.append(own)
    return out


def best_run(score: list[float]) -> tuple[int, int]:
    """The run (from, to) with the largest sum, empty if none is above zero."""
    best, total, start = (0.0, 0, 0), 0.0, 0
    for i, x in enumerate(score):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best[0]:
            best = (total, start, i + 1)
    return best[1:]


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The text of the best region of a page."""
    parsed = Page(page or "")
    kinds = parsed.classes(weight, bool(parsed.article))
    a, b = best_run(scores(parsed, kinds, weight))
    blocks, current = [], []
    for (_, text, _, block), kind in zip(parsed.tokens[a:b], kinds[a:b], strict=True):
        if block:
            blocks.append(current)
            current = []
        elif text and not (kind.startswith(("mark:", "word:out")) and weight[kind] < 0):
            current.append(text)
    blocks.append(current)
    lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def _count(page: str, counts: Counter) -> None:
    """Adds the tokens of a page with an article, by class, each class as (inside, outside, pages that show it)."""
    parsed = Page(page)
    if not parsed.article:
        return
    inside = [False]
    for e in range(1, len(parsed.parent)):
        inside.append(inside[parsed.parent[e]] or parsed.name[e] in INSIDE)
    shown = set()
    for marked in (True, False):
        for (e, text, tag, _), kind in zip(parsed.tokens, parsed.classes(START, marked), strict=True):
            if not kind.startswith("mark:"):
                counts[kind, inside[e]] += 1 if tag else len(text.split())
    # An element without an article inside tells of each of its marks.
    holds, e = {0, parsed.article}, parsed.article
    while e:
        e = parsed.parent[e]
        holds.add(e)
    for e in range(1, len(parsed.parent)):
        if e not in holds:
            for k in set(_marks(parsed.name[e], parsed.attributes[e], inside[e], every=True)):
                counts["mark:" + k, inside[e]] += parsed.words[e]
                shown.add("mark:" + k)
    for k in shown:
        counts[k, None] += 1


START = weights({})


def train(pages: DataFrame, sample_pages: int = 512) -> dict[str, float]:
    """Weights from about ``sample_pages`` pages, by a hash of page_id, of which those with an article are labelled."""
    n = pages.count()
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 62)) < int((1 << 62) * min(1.0, sample_pages / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                _count(page.as_py() or "", counts)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "labelled", "n"])

    # A page may make up tag names; those beyond the known ones count as one class.
    tags = [k for k in PRIOR if k.startswith("tag")] + [f"tag:{x}" for x in BLOCKS | VOID | INSIDE]
    rows = some.select("html").mapInArrow(run, "kind string, labelled boolean, n long")
    rows = rows.withColumn("kind", F.when(F.col("kind").startswith("tag") & ~F.col("kind").isin(tags), "tag").otherwise(F.col("kind")))
    each = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    found = rows.groupBy("kind").agg(each(F.col("labelled")).alias("a"), each(~F.col("labelled")).alias("b"), each(F.col("labelled").isNull()).alias("pages"))
    found = found.where(~F.col("kind").startswith("mark:") | F.col("kind").isin([k for k in PRIOR if k.startswith("mark:")]) | (F.col("pages") >= SEEN))
    return weights({k: (float(a), float(b)) for k, a, b, _ in found.collect()})


def extract_pages(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weight = train(pages) if weight is None else weight
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = [extract(p.as_py(), weight) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
