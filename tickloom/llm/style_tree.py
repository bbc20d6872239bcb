"""HTML main text by a site style tree.

The pages of a host are merged into one tree: its nodes are paths of presentation (tags with their class and id), and
the leaf of each holds the contents seen there. The importance of a leaf is the normalised entropy of its contents over
the host's distinct pages, that of an element the same of the sequences of its children: what repeats from page to page
carries none. A branch has the mean of its nodes, an element counting the more the more sequences it has.

Leaves of low importance are removed from each page, in articles as well. A prior by role (an article is content; a menu,
footer, advert, form or comment list is not), which descendants inherit, removes what is no content however much it
varies. A telling word in the name of a branch that is or holds an article is a hint only, see `settled`. Beside an article, a branch without a role stays if its importance is high; where a host has too few pages to
tell, the prior decides and it goes. The blocks that remain are the page's text.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Judged nodes up to which they go to the tasks as one table (about 100 bytes each); beyond, by a join.
BROADCAST_NODES = 100_000
#: A node is judged by its entropy from so many distinct pages on.
LEAST_PAGES = 5
LOW = 0.35
#: An element of k sequences of children counts 1 - FEW ** k of a leaf in its branches.
FEW = 0.9
#: So much of the text of articles have those below the fewest hints at least, or the hints are overruled.
SHARE = 0.1
#: Elements below this depth are no branches of their own.
DEPTH = 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "option", "button", "object", "math", "canvas", "title", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CONTENT = {"article", "main"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Words of class and id names by which a branch is no content.
_BAD = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright",
    "disqus", "footer", "gdpr", "login", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "replies",
    "reply", "responses", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
_GOOD = {"article", "content", "entry", "main", "post", "story"}
_GOOD_ROLES = {"main", "article"}
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _role(tag: str, attributes: str, inside: int) -> tuple[str, int, bool]:
    """(the node's name in a path, its prior: 1 content, -1 none, 0 as above, whether its names hint that it is no content)."""
    names, words, role = [], set(), ""
    if attributes:
        for m in _NAMES.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.strip().lower()
            else:
                names += value.split()
                words.update(w.lower() for w in _WORD.findall(value))
    name = ".".join([tag, *sorted(re.sub(r"\d+", "#", n).replace("/", "_") for n in names)]).replace("/", "_")
    if tag in _BOILERPLATE or role in _BAD_ROLES or tag == "header" and inside <= 0:
        return name, -1, False
    hint = bool(words & _BAD) and tag not in ("html", "body")
    hint = hint or "header" in words and tag not in ("html", "body", "header", "h1", "h2") and inside <= 0
    if tag in _CONTENT or role in _GOOD_ROLES:
        return name, 1, hint
    return name, int(not hint and bool(words & _GOOD) and tag in ("div", "section", "td")), hint


def settled(found: list[tuple[str, int, str, tuple[int, ...]]], articles: list[tuple[int, ...]], low=frozenset()) -> list[tuple[str, int, str]]:
    """(path, prior, text) of blocks that also have the hinted branches (numbers) that they are in, outermost first.

    A hint holds for a branch without an article. Of articles below different numbers of hints, those of the fewest are
    content whose text that is not low makes up SHARE of all such text: with an article of no hint, the articles in a comment list or a
    list of related ones are none; where all the page's articles are below a hint, it is overruled.
    """
    if not any(x[3] for x in found):
        return [x[:3] for x in found]
    holding = {x for own in articles for x in own}
    mass: dict[int, int] = {}
    for p, prior, s, hints in found:
        if prior == 1 and holding.issuperset(hints) and f"{p}/#text" not in low:
            mass[len(hints)] = mass.get(len(hints), 0) + len(s)
    most, upto = 0, 0
    for most in sorted(mass):
        upto += mass[most]
        if upto >= SHARE * sum(mass.values()):
            break
    return [(p, prior if len(hints) <= most and holding.issuperset(hints) else -1, s) for p, prior, s, hints in found]


def blocks(page: str, low: set[str] | frozenset[str] = frozenset()) -> list[tuple[str, int, str]]:
    """(path, prior, text) of each block with text, in page order."""
    return settled(*_parsed(page), low)


def _parsed(page: str) -> tuple[list[tuple[str, int, str, tuple[int, ...]]], list[tuple[int, ...]]]:
    """The blocks, with the hinted branches that each is in, and those of each article or main."""
    out: list[tuple[str, int, str, tuple[int, ...]]] = []
    articles: list[tuple[int, ...]] = []
    stack: list[tuple[str, str, int, tuple[int, ...]]] = []  # tag, path, prior, hints
    text: list[str] = []
    path, prior, hints, at, n = "", 0, (), 0, 0

    def flush() -> None:
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            if s:
                out.append((path, prior, s, hints))
            text.clear()

    def leave(depth: int) -> None:
        nonlocal path, prior, hints
        del stack[depth:]
        path, prior, hints = stack[-1][1:] if stack else ("", 0, ())

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in _INLINE:
                flush()
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    leave(d)
                    break
                if tag in _INLINE and stack[d][0] not in _INLINE:
                    break  # an inline end tag does not close a block
            continue
        if tag in _RAW:
            if tag not in _INLINE and tag not in ("button", "select", "option", "svg", "math", "object"):
                flush()
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "head" and not end:
                continue
            if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _INLINE:
            name, own, hint = _role(tag, m[3], prior) if m[3] else (tag, 0, False)
            if own == -1 or hint:
                flush()
                stack.append((tag, f"{path}/{name}", -1, hints))
                path, prior, hints = stack[-1][1:]
            else:
                stack.append((tag, path, prior, hints))
            continue
        flush()
        closes = {"p"} if tag != "li" else {"p", "li"}
        closes |= {"td", "th"} if tag in ("td", "th") else {"td", "th", "tr"} if tag == "tr" else {"dt", "dd"} if tag in ("dt", "dd") else set()
        for d in range(len(stack) - 1, -1, -1):
            if stack[d][0] in closes:
                leave(d)
                break
            if stack[d][0] not in _INLINE:
                break
        name, own, hint = _role(tag, m[3], prior)
        if hint and prior >= 0:
            n += 1
            hints = (*hints, n)
        # a branch without importance has none below; an article has until a branch in it has none
        stack.append((tag, f"{path}/{name}", -1 if prior == -1 else own or prior, hints))
        path, prior = stack[-1][1:3]
        if own == 1 and prior == 1 and tag in _CONTENT:
            articles.append(hints)
    if at < len(page):
        rest = page[at:]
        text.append(rest[: rest.find("<")] if re.match(r"[^<]*<[a-zA-Z/!?][^>]*\Z", rest, re.S) else rest)
    flush()
    return out, articles


def _prefixes(path: str) -> list[str]:
    """The elements of a path from the outermost on, DEPTH at most."""
    parts = path.split("/", DEPTH + 1)[1 : DEPTH + 1]
    out, at = [], ""
    for x in parts:
        at = f"{at}/{x}"
        out.append(at)
    return out


def _branches(found: list[tuple[str, int, str]]) -> dict[str, str]:
    """For each neutral path of a page with an article, the outermost branch with it and without article text."""
    above = {x for p in {p for p, prior, _ in found if prior == 1} for x in _prefixes(p)}
    return {p: next((x for x in _prefixes(p) if x not in above), f"{p}/#text") for p in {p for p, prior, _ in found if prior == 0}} if above else {}


def _hash(parts: list[str]) -> int:
    return int.from_bytes(hashlib.md5("\n".join(parts).encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def _nodes(batches):
    """(host, node, page, value, beside) of the nodes of each page that no prior removes.

    value: a hash of a leaf's content or of an element's sequence of children; beside: the node is a branch beside an article.
    """
    for batch in batches:
        out: list[tuple] = []
        for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            every = blocks(source or "")
            found = [x for x in every if x[1] >= 0]
            if not found:
                continue
            whole, beside = _hash([x[2] for x in every]), set(_branches(found).values())
            own: dict[str, list[str]] = {}
            for p, _, s in found:
                own.setdefault(f"{p}/#text", []).append(s)
                inside = _prefixes(p)
                for x, child in zip(inside, [*inside[1:], "#text"]):
                    own.setdefault(x, []).append(child)
            out += [(h, x, whole, _hash(s), x in beside) for x, s in own.items()]
        columns = zip(*out) if out else [[]] * 5
        types = pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], ["host", "node", "page", "value", "beside"])


def judged_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, high) for pages (host, html): leaves of low importance, and branches of high importance beside articles."""
    seen = pages.select("host", "html").mapInArrow(_nodes, "host string, node string, page long, value long, beside boolean").distinct()
    by_value = seen.groupBy("host", "node", "value").agg(F.count(F.lit(1)).alias("n"), F.max("beside").alias("beside"))
    node = by_value.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("x"), F.count(F.lit(1)).alias("values"), F.max("beside").alias("beside"))
    # -sum(p log p) / log(pages), with p = n / pages
    entropy = F.when(F.col("pages") > 1, 1 - F.col("x") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    leaf = F.col("node").endswith("/#text")
    weight = F.col("pages") * F.when(leaf, 1.0).otherwise(1 - F.pow(F.lit(FEW), "values"))
    node = stage(node.select("host", "node", "pages", "beside", entropy.alias("importance"), weight.alias("weight")), "nodes")
    low = node.where(leaf & (F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LOW)).select("host", "node", F.lit(False).alias("high"))
    wanted = node.where(F.col("beside") & (F.col("pages") >= LEAST_PAGES)).select("host", F.col("node").alias("branch"))
    parts = F.split("node", "/")
    ups = F.transform(F.sequence(F.lit(2), F.least(F.size(parts), F.lit(DEPTH + 1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = node.select("host", "importance", "weight", F.explode(F.array_distinct(F.concat(ups, F.array("node")))).alias("branch"))
    branch = up.join(wanted, ["host", "branch"], "left_semi").groupBy("host", "branch").agg((F.sum(F.col("importance") * F.col("weight")) / F.sum("weight")).alias("importance"))
    return low.unionByName(branch.where(F.col("importance") >= LOW).select("host", F.col("branch").alias("node"), F.lit(True).alias("high")))


def main_text(page: str | None, low: set[str] | frozenset[str], high: set[str] | frozenset[str] = frozenset()) -> str:
    """The blocks of the page that are left; beside an article, those of branches of high importance only.

    If all article text is of low importance, as where a host shows one article on all its pages, it stays.
    """
    found = [(p, prior, s) for p, prior, s in blocks(page or "", low) if prior >= 0]
    branch = _branches(found)
    marked = any(prior == 1 for _, prior, _ in found)
    alone = not any(prior == 1 and f"{p}/#text" not in low for p, prior, _ in found)
    return "\n".join(s for p, prior, s in found if prior == 1 and alone or f"{p}/#text" not in low and (prior == 1 or not marked or branch[p] in high))


def _extracted(batches, judged: dict[str, tuple[set[str], set[str]]] | None):
    none = frozenset(), frozenset()
    for batch in batches:
        host, page = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        if judged is not None:
            nodes = [judged.get(h, none) for h in host]
        else:
            nodes = [(frozenset(x or ()), frozenset(y or ())) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        text = [main_text(h, *x) for h, x in zip(page, nodes)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    A null html is empty and has no text; pages of null or odd urls share the host "". Repeated pages count once in the
    entropy and each get their row; a null page_id is returned. Other columns are ignored.
    """
    out = "page_id long, url string, text string, n_chars long"
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(pages["url"]).alias("host"), "html")
    judged = stage(judged_nodes(own), "judged")
    if judged.count() <= BROADCAST_NODES:
        held: dict[str, tuple[set[str], set[str]]] = {}
        for host, node, high in judged.collect():
            held.setdefault(host, (set(), set()))[high].add(node)
        return own.mapInArrow(lambda it: _extracted(it, held), out)
    told = lambda high: F.collect_set(F.when(F.col("high") == high, F.col("node")))
    by_host = judged.groupBy("host").agg(told(False).alias("low"), told(True).alias("high"))
    joined = own.join(by_host, "host", "left").select("page_id", "url", "host", "html", "low", "high")
    return joined.mapInArrow(lambda it: _extracted(it, None), out)
