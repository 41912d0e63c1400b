"""Main text of web pages, from the slots of a template deduced over each host.

A page is a sequence of tokens: containers, told apart by the path of names
and classes above them and by their number among those of one path, and
blocks of text.  Over a host's pages a token has an occurrence vector, how
often each page has it.  Tokens that agree in it on nearly all pages form an
equivalence class; it is valid where its tokens keep one order on the pages,
and classes nest as their containers do.  That is the host's template
(:func:`host_templates`).  What it leaves open are slots, the containers'
varying contents.  The main part is the slot that holds most of the text
outside of links, found from the root downward (:func:`choose`); everything
outside of it, containers in it that hold mainly links, and blocks of text that
nearly all pages have are boilerplate.

Names of elements and classes only help: they mark inner containers that an
article doesn't include (adverts, notices, comments), unless such a container
holds most of a host's text, and they decide between slots of like size.  A
page that doesn't follow its host's template is read by the template of that
page alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm import common

#: Element names by what they do to text.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "xmp", "noembed", "noframes", "canvas", "object", "audio", "video")
#: Of those the ones that run to the page's end if they aren't closed; of the others only the tag is left out then.
RAW_TO_END = frozenset("script style template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Formulas are part of the text around them.
FORMULA = frozenset("math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
ENDED_BY_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements that part blocks, hold no other containers, and are often left open.
PARTING = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3".split())
DROPPED = frozenset("nav menu footer aside form button select option dialog head fieldset optgroup datalist".split())
#: Words of class, id and role that mark what isn't the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert disclaimer sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login footer popup modal overlay paywall toolbar pagination pager widget skip complementary contentinfo search hidden".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
HEADER_WORDS = frozenset("header masthead topbar banner".split())
MAIN_WORDS = frozenset("article post entry content main story".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_CUT = re.compile(r"<[/!a-zA-Z][^>]*\Z")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]{3,}")  # numbers of articles in classes and ids don't part paths
#: Pages that must have a block of text, in tenths of a host's pages and at least, for it to be boilerplate.
MOST_TENTHS, SUPPORT = 9, 4
#: Containers of one path on a page up to which each is a token of its own; more are one repeated token.
APART = 8
#: Pages of a host above which its pages are dealt out in parts, at least.
HEAVY_PAGES = 500

#: How a container is named: as nothing special, dropped unless it holds most text, dropped, main.
PLAIN, LESSER, NEVER, MAIN = range(4)


@dataclass
class Page:
    """nodes: (path, number of the parent, naming), the root first; blocks: (node, text, characters in links, whether a heading)."""

    nodes: list[tuple[int, int, int]] = field(default_factory=list)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)


def token_hash(*parts: str | int) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _naming(name: str, words: set[str], hidden: bool, article: bool) -> int:
    if name in ("html", "body"):
        return PLAIN
    if name in DROPPED or hidden or words & COMMENT_WORDS or (not article and (name == "header" or words & HEADER_WORDS)):
        return NEVER
    if words & DROPPED_WORDS:
        return LESSER
    return MAIN if name in ("article", "main") or words & MAIN_WORDS else PLAIN


def parse(html: str) -> Page:
    """Containers and blocks of a page; unclosed, stray and cut-off tags do no harm.  Time is linear in the tags' nesting."""
    page = Page([(token_hash("root"), -1, PLAIN)])
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, node, in article, an inline advert
    depth: Counter = Counter()  # names on the stack
    text: list[str] = []
    links, in_link, heading = 0, False, False

    def flush() -> None:
        nonlocal links, heading
        if text:
            s = " ".join(unescape("".join(text)).split())
            text.clear()
            if s:
                page.blocks.append((stack[-1][1], s, min(links, len(s)), heading))
        links, heading = 0, False

    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        silent = stack[-1][3]
        stop = m.start() if m else n
        if not silent and at < stop:
            piece = html[at:stop]
            if not m and (cut := _CUT.search(piece)):  # a tag that the page's end cuts off
                piece = piece[: cut.start()]
            text.append(piece)
            if in_link:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        closed = m[3].endswith("/") if m[3] else False
        if name in _RAW_END and not closing:
            if not (closed and name == "svg"):
                end = _RAW_END[name].search(html, at)
                over = html.find(">", end.end()) if end else -1
                if over >= 0:
                    at = over + 1
                elif end or name in RAW_TO_END:
                    at = n
            text.append(" ")
            continue
        attributes = {a.lower(): (x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(m[3])} if m[3] and not closing else {}
        words = set(_WORD.findall(" ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower())) if attributes else set()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        if name == "a":
            in_link = not closing
        if name in INLINE or name in FORMULA:
            if name == "br":
                text.append(" ")
            if closing and depth[name]:
                if stack[-1][3] and stack[-1][0] == name:
                    stack.pop()
                    depth[name] -= 1
            elif not closing and name not in VOID and (words & DROPPED_WORDS or hidden or silent):
                stack.append((name, stack[-1][1], stack[-1][2], True))  # an advert in the middle of a text
                depth[name] += 1
            continue
        while stack[-1][3]:  # the next block ends it
            depth[stack.pop()[0]] -= 1
        if closing:
            flush()
            if depth[name]:
                while True:
                    top = stack.pop()[0]
                    depth[top] -= 1
                    if top == name:
                        break
            continue
        flush()
        heading = name in HEADINGS
        if name in VOID:
            continue
        if stack[-1][0] in ENDED_BY_BLOCKS:  # its end tag was left out
            depth[stack.pop()[0]] -= 1
        _, node, article, _ = stack[-1]
        naming = _naming(name, words, hidden, article)
        if name in PARTING and naming not in (LESSER, NEVER):
            continue
        marks = _NUMBER.sub("#", f"{attributes.get('class', '')} {attributes.get('id', '')}").split() if attributes else ()
        page.nodes.append((token_hash(page.nodes[node][0], name, *sorted(set(marks))), node, naming))
        stack.append((name, len(page.nodes) - 1, article or (name == "article" and naming == MAIN), False))
        depth[name] += 1
    flush()
    return page


@dataclass
class Container:
    """A container in a template; sums over pages: free, characters outside of links and of dropped containers below; links; own, directly in it; headings."""

    token: int
    path: int
    parent: int
    naming: int
    pages: int
    free: int
    links: int
    own: int
    headings: int


ROOT = token_hash(token_hash("root"), 1, 1)


def containers(page: Page) -> tuple[list[int], dict[int, Container]]:
    """The token of each node, and the page's containers by token."""
    n = len(page.nodes)
    free, links, own, headings = [0] * n, [0] * n, [0] * n, [0] * n
    for node, s, in_links, heading in page.blocks:
        own[node] += len(s) - in_links
        links[node] += in_links
        headings[node] += heading
    for i in range(n):
        free[i] = own[i]
    for i in range(n - 1, 0, -1):
        _, up, naming = page.nodes[i]
        links[up] += links[i]
        if naming not in (LESSER, NEVER):
            free[up] += free[i]
    count, met = Counter(p for p, _, _ in page.nodes), Counter()
    tokens: list[int] = []
    out: dict[int, Container] = {}
    for i, (path, up, naming) in enumerate(page.nodes):
        met[path] += 1
        k = count[path]
        token = ROOT if i == 0 else token_hash(path, k, met[path]) if k <= APART else token_hash(path, "repeated")
        tokens.append(token)
        if token in out:
            c = out[token]
            c.free, c.links, c.own, c.headings = c.free + free[i], c.links + links[i], c.own + own[i], c.headings + headings[i]
        else:
            out[token] = Container(token, path, tokens[up] if i else 0, naming, 1, free[i], links[i], own[i], headings[i])
    return tokens, out


def choose(known: dict[int, Container]) -> tuple[int, set[int], set[int]]:
    """Of a template the main container, those named as dropped that are kept, and those that hold mainly links."""
    root = known[ROOT]
    free = {t: c.free for t, c in known.items()}

    def up(t: int) -> int:
        p = known[t].parent
        return p if p in known else ROOT  # its parent isn't on most pages

    kept: set[int] = set()
    for t in sorted((t for t, c in known.items() if c.naming == LESSER), key=lambda t: -free[t]):
        if free[t] > free[ROOT]:  # most of the text can't be an advert
            kept.add(t)
            p = t
            while p != ROOT:
                p = up(p)
                free[p] += free[t]
                if known[p].naming in (LESSER, NEVER) and p not in kept:
                    break
    below: dict[int, list[int]] = defaultdict(list)
    for t, c in known.items():
        if t != ROOT and (c.naming in (PLAIN, MAIN) or t in kept):
            below[up(t)].append(t)

    def weight(t: int) -> int:
        return free[t] * (4 if known[t].naming == MAIN else 1)

    now = ROOT
    while below[now]:
        best = max(below[now], key=weight)
        c = known[now]
        if now != ROOT and (c.own * 50 > free[now] or c.headings * 2 > root.pages):
            break  # titles and paragraphs stand directly in it
        if not free[best] or weight(best) * 2 < sum(map(weight, below[now])) + c.own:
            break
        if any(t != best and known[t].path == known[best].path and free[t] * 10 > free[best] for t in below[now]):
            break  # one of several parts of a kind
        now = best
    dropped = {t for t, c in known.items() if c.links > 2 * free[t] and c.naming != MAIN and t != now} if root.pages >= SUPPORT else set()
    return now, kept, dropped


@dataclass
class Template:
    main: int
    kept: frozenset[int]
    dropped: frozenset[int]
    texts: frozenset[int]


def main_text(page: Page, template: Template | None) -> str:
    """The blocks of the main slot, joined by an empty line."""
    tokens, own = containers(page)
    texts = template.texts if template else frozenset()
    if template and template.main in own:
        main, kept, dropped = template.main, template.kept, template.dropped
    else:
        main, kept, dropped = choose(own)
    inside = [False] * len(tokens)
    for i, (_, up, naming) in enumerate(page.nodes):
        t = tokens[i]
        if t == main:
            inside[i] = True
        elif i and inside[up]:
            inside[i] = t not in dropped and (naming in (PLAIN, MAIN) or t in kept)
    return "\n\n".join(s for node, s, _, _ in page.blocks if inside[node] and not (texts and token_hash(page.nodes[node][0], s) in texts))


def host(url: str = "url"):
    """The host of a URL column, the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


TOKEN = "token bigint, path bigint, parent bigint, naming int, free bigint, links bigint, own bigint, headings bigint"
PAGE = f"host string, page bigint, tokens array<struct<{TOKEN.replace(' ', ':').replace(',:', ',')}>>"


def page_tokens(rows: DataFrame) -> DataFrame:
    """``host, page, tokens`` of the different pages that have text; a block of text has ``naming`` null."""
    arrow = common.arrow_schema(rows.sparkSession, PAGE)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in common.slices(batch, 256):
                part = batch.slice(at, n)
                out: dict[str, list] = {"host": [], "page": [], "tokens": []}
                for name, markup in zip(part.column("host").to_pylist(), part.column("text"), strict=True):
                    page = parse(markup.as_py())
                    if not page.blocks:
                        continue
                    _, own = containers(page)
                    texts = dict.fromkeys(token_hash(page.nodes[node][0], s) for node, s, _, _ in page.blocks)
                    row = [dict(token=c.token, path=c.path, parent=c.parent, naming=c.naming, free=c.free, links=c.links, own=c.own, headings=c.headings) for c in own.values()]
                    row += [{"token": t} for t in texts]
                    out["host"].append(name)
                    out["page"].append(token_hash(*texts))
                    out["tokens"].append(row)
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return rows.select("host", F.col("html").alias("text")).mapInArrow(listed, PAGE).dropDuplicates(["host", "page"])


@dataclass
class Parts:
    """The hosts with more pages than a task should get, and in how many parts they go: a small table, at most 100,000 rows."""

    heavy: DataFrame

    @staticmethod
    def of(rows: DataFrame) -> Parts:
        counts = common.stored(rows.groupBy("host").agg(F.count("*").alias("n")), "html-hosts")
        whole = counts.agg(F.sum("n")).first()[0] or 0
        most = max(HEAVY_PAGES, -(-whole // 100_000))
        return Parts(counts.where(F.col("n") > most).select("host", F.ceil(F.col("n") / most).cast("int").alias("parts")))

    def with_host(self, pages: DataFrame, by_host: DataFrame, key: str) -> DataFrame:
        """``pages`` joined with what is known by host, which goes to each part of a heavy host."""
        heavy = F.broadcast(self.heavy)
        many = F.coalesce("parts", F.lit(1))
        dealt = pages.join(heavy, "host", "left").withColumn("part", F.pmod(F.xxhash64(key), many).cast("int")).drop("parts")
        known = by_host.join(heavy, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
        return dealt.join(known, ["host", "part"], "left").drop("part")


TEMPLATE = "host string, main bigint, kept array<bigint>, dropped array<bigint>, texts array<bigint>"


def host_templates(rows: DataFrame, parts: Parts) -> DataFrame:
    """``host, main, kept, dropped, texts`` for each host in ``rows`` (``host, html``) that has text.

    Copies of a page count once.  A container belongs to the template if half
    of the pages have it, a block of text if ``MOST_TENTHS`` tenths and
    ``SUPPORT`` pages have it, both only if they stand in the order that the
    template's tokens have on average on all but a tenth of their pages.
    Everything is added up over the whole host before hosts' few tokens meet.
    """
    pages = common.stored(page_tokens(rows), "html-pages")
    place = F.col("at").cast("double") / F.col("size")
    each = pages.select("host", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "x")).select("host", place.alias("place"), "x.*")
    sums = each.groupBy("host", "token").agg(F.count("*").alias("n"), F.avg("place").alias("place"), *[F.min(k).alias(k) for k in ("path", "parent", "naming")], *[F.sum(k).alias(k) for k in ("free", "links", "own", "headings")])
    size = pages.groupBy("host").agg(F.count("*").alias("pages"))
    enough = F.when(F.col("naming").isNull(), (F.col("n") * 10 >= F.col("pages") * MOST_TENTHS) & (F.col("pages") >= SUPPORT)).otherwise(F.col("n") * 2 >= F.col("pages"))
    often = common.stored(sums.join(size, "host").where(enough), "html-often")

    # containers among themselves and blocks among themselves: a block lies in a container, not after it
    order = often.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "token", F.col("naming").isNull().alias("block")))).alias("order"))
    placed = parts.with_host(pages.select("host", "page", F.col("tokens.token").alias("tokens")), order, "page")
    crossed_schema = "host string, token bigint"
    arrow = common.arrow_schema(rows.sparkSession, crossed_schema)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, out = [], []
            for name, tokens, order in zip(*(batch.column(k).to_pylist() for k in ("host", "tokens", "order")), strict=True):
                rank = {x["token"]: (i, x["block"]) for i, x in enumerate(order or ())}
                for block in (False, True):
                    own = [t for t in tokens if t in rank and rank[t][1] == block]
                    least = [float("inf")] * (len(own) + 1)
                    for i in range(len(own) - 1, -1, -1):
                        least[i] = min(least[i + 1], rank[own[i]][0])
                    most = -1.0
                    for i, t in enumerate(own):
                        if most > rank[t][0] or least[i + 1] < rank[t][0]:
                            hosts.append(name)
                            out.append(t)
                        most = max(most, rank[t][0])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.int64())], schema=arrow)

    votes = placed.mapInArrow(crossed, crossed_schema).groupBy("host", "token").agg(F.count("*").alias("crossed"))
    valid = often.join(votes, ["host", "token"], "left").where((F.coalesce("crossed", F.lit(0)) * 10 <= F.col("n")) | (F.col("token") == ROOT))
    columns = ("token", "path", "parent", "naming", "n", "free", "links", "own", "headings")
    by_host = valid.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("tokens"))
    out_arrow = common.arrow_schema(rows.sparkSession, TEMPLATE)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, tokens in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                known = {x["token"]: Container(*(x[k] for k in columns)) for x in sorted(tokens, key=lambda x: x["token"]) if x["naming"] is not None}
                main, kept, dropped = choose(known)
                out.append({"host": name, "main": main, "kept": sorted(kept), "dropped": sorted(dropped), "texts": sorted(x["token"] for x in tokens if x["naming"] is None)})
            yield pa.RecordBatch.from_pylist(out, out_arrow)

    return common.stored(by_host.mapInArrow(chosen, TEMPLATE), "html-templates")


def extract(df: DataFrame, deduce: bool = True) -> DataFrame:
    """Main text of ``page_id, url, html``.

    Returns ``page_id, url, text, n_chars``.  Null and empty markup give the
    empty text; pages without a URL form a host of their own; repeated rows
    count once for the template and are all returned; other columns are
    ignored; an empty table stays empty.  A host's template comes from all of
    its pages by sums over tokens, and each page is read by itself against it,
    so that no host, however large, meets in one task.  Without ``deduce``
    pages are given as they are, without a template.  Starts jobs at once.
    """
    rows = common.narrow(df, page_id="page_id", url="url", html="html").withColumn("html", common.text_or_empty("html")).withColumn("host", host())
    kinds = {k: df.schema[k].dataType.simpleString() for k in ("page_id", "url")}
    if deduce:
        parts = Parts.of(rows)
        known = parts.with_host(rows.withColumn("key", F.xxhash64("page_id", "url", "html")), host_templates(rows, parts), "key")
    else:
        known = rows.withColumns({"main": F.lit(None).cast("bigint"), **{k: F.lit(None).cast("array<bigint>") for k in ("kept", "dropped", "texts")}})

    def texts(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": [], "n_chars": []}
        found = (batch.column(k).to_pylist() for k in ("main", "kept", "dropped", "texts"))
        for markup, main, kept, dropped, common_texts in zip(batch.column("text"), *found, strict=True):
            page = parse(markup.as_py())
            if deduce:
                template = None if main is None else Template(main, frozenset(kept), frozenset(dropped), frozenset(common_texts))
                text = main_text(page, template)
            else:
                text = "\n\n".join(b[1] for b in page.blocks)
            out["text"].append(text)
            out["n_chars"].append(len(text))
        return out

    columns = {k: k for k in ("page_id", "url", "main", "kept", "dropped", "texts")}
    return common.map_batches(common.narrow(known, text="html", **columns), texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
