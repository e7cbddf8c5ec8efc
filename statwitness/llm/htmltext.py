"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of styles: a node is the path of tags and classes down to a block or to an
element above it; ``<path>/`` stands for the text that an element holds itself. A node's importance is measured over the pages that have it.
With m pages, a text that stands on c of them has entropy log_m c: 0 if it is a page's own, 1 if every page repeats it; the
node's importance is one less the mean entropy of the texts under it. Nodes of low importance are cut from each page, inside the
article (``article``, ``main``) as elsewhere. A node that holds most of a page's text is never cut there: mirrors of an article are still
articles. Branches whose tag or role, or a whole name among class and id, says that they are menus, adverts, forms, comments and the like have
importance 0 by definition, since on one page, or with rotating adverts, entropy cannot tell. A name never makes noise of an article, a
heading, the body, or an element that holds most of the page's text.

Pages of a host with equal blocks outside of such branches count once. The fewer pages have a node, the less its entropy
counts: a text that each of m pages repeats gives importance 1 / m.

Pages are parsed one by one; hashes of their blocks and counts per (host, path, text hash) are shuffled, so a host of any size is spread.

Defined results: null and empty html give empty text; unclosed and misnested tags are closed as browsers do, a tag or
comment cut off by the end of the page is dropped; pages without a host are one host; a repeated page gives a row each time.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, functions as F

from statwitness.llm.common import column, map_rows

LOW_IMPORTANCE = 0.3
SALTS = 32  # tasks that share the pages of one host
DOUBT = 1.0  # a node on m different pages of a host is judged with (m - 1) / (m - 1 + DOUBT) of its entropy

# --- fixed values: HTML's own vocabulary ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg iframe object textarea title select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog head menu fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay paywall popup promo "
    "promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar topbar widget".split())
# words that a name can hold besides: what is left of it still names a part of the layout
LAYOUT_WORDS = frozenset(
    "area bar block bottom box btn button buttons center container form global group icons inner item items left link links list main outer page panel "
    "posts primary right row secondary section site slot small top unit wrap wrapper x zone".split())
TALK = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
CONTENT_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())  # no name makes them noise
CELLS = frozenset(("td", "th", "br", "option", "img", "input"))

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z]+")
_SVG = re.compile(r"<(/?)svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|\Z", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if "=" in raw else {}


def _noisy(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Whether tag or role say that an element is noise."""
    return tag in NOISE_TAGS or (tag == "header" and not in_main) or attrs.get("role", "").lower() in NOISE_ROLES


def _named_noise(tag: str, attrs: dict[str, str], in_main: bool) -> int:
    """Whether a whole class or id names noise: each of its words does or is a word of layouts. 2 if it names readers' comments."""
    if tag in CONTENT_TAGS:
        return 0
    found = 0
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        ws = set(_NAME.findall(name))
        noise = {w for w in ws if w in NOISE_WORDS or (w == "header" and not in_main)}
        if noise and ws - noise <= LAYOUT_WORDS:
            found = max(found, 2 if noise & TALK else 1)
    return found


def _svg_end(page: str, at: int) -> int | None:
    """Where an svg opened before ``at`` ends: at its own end tag or, if nesting is broken, at the first one. None if there is none."""
    depth, here, first = 1, at, None
    while depth:
        m = _SVG.search(page, here)
        if not m[0]:
            return first
        here = m.end()
        if m[1]:
            depth, first = depth - 1, first or here
        else:
            depth += not m[0].endswith("/>")
    return here


def blocks_of(page: str | None) -> list[tuple[str, str, bool, bool]]:
    """The text blocks of a page in order: path, text, inside noise, inside the article."""
    out: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []
    # open elements: tag, path, noise, main, elements around it and itself that a name calls noise
    stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
    named: list[int] = []  # what _named_noise says of each such element
    held: list[str] = []
    page = page or ""

    def close_block():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                # the path goes down to the block, not to the inline tags in it
                _, path, noise, main, names = next((f for f in reversed(stack) if f[0] in BLOCKS), stack[0])
                out.append((path, text, noise, main, names))

    def pop_to(tag: str) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return True
        return False

    at, svg_ends = 0, True
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            held.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag or (m[5] and not m[0].endswith(">")):
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if tag in BLOCKS:
                close_block()
            pop_to(tag)
            continue
        if tag in CELLS:
            held.append(" ")
        if tag == "svg":
            if svg_ends and not raw.rstrip().endswith("/"):
                end = _svg_end(page, at)
                at, svg_ends = end or at, end is not None  # one without an end tag holds nothing
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if tag in BLOCKS:
            close_block()
            if tag not in ("html", "body", "head") and any(f[0] == "p" for f in stack):
                pop_to("p")
            if tag == "li" and stack[-1][0] == "li":
                stack.pop()
        if tag in VOID or raw.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        attrs = _attributes(raw)
        _, path, noise, main, names = stack[-1]
        own = _noisy(tag, attrs, main)
        by_name = _named_noise(tag, attrs, main)
        if by_name:
            names = (*names, len(named))
            named.append(by_name)
        if tag in ("article", "main") and not main:
            # whatever was left open before it, but for readers' comments
            names = tuple(n for n in names if named[n] == 2)
            noise, main = own, not own and not names
        style = tag + "".join("." + c for c in sorted(attrs.get("class", "").lower().replace("/", "|").split()))
        stack.append((tag, f"{path}/{style}", noise or own, main, names))
    close_block()
    # a name does not outweigh that the element holds most of the text; readers' comments only stay where there is nothing else
    total = sum(len(text) for _, text, noise, _, _ in out if not noise)
    held = [0] * len(named)
    for _, text, noise, _, names in out:
        for n in names:
            held[n] += len(text) * (not noise)
    holds = [n == total if kind == 2 else 2 * n > total for n, kind in zip(held, named)]
    return [(path, text, noise or not all(holds[n] for n in names), main) for path, text, noise, main, names in out]


def nodes_of(path: str) -> list[str]:
    """The nodes that hold a block of this path, the outermost first; the last one is the text of the element itself."""
    parts = path.split("/")
    return ["/".join(parts[: i + 1]) for i in range(1, len(parts))] + [path + "/"]


def main_text(page: str | None, low: frozenset[str] | set[str] = frozenset(), low_importance: float = LOW_IMPORTANCE) -> str:
    """The blocks that stay, in page order. If the page has an article, they are among its blocks. Nodes in ``low`` go, but for
    one that holds most of the text. Where the share of text outside of further low nodes is below ``low_importance``, in such a
    node or in the page, repetition does not tell the parts apart and all of them stay."""
    blocks = [(p, t, m) for p, t, noise, m in blocks_of(page) if not noise]
    if any(m for _, _, m in blocks):
        blocks = [b for b in blocks if b[2]]
    if not low:
        return "\n\n".join(t for _, t, _ in blocks)
    held: dict[str, int] = {}  # characters under each low node of the page
    own: dict[str, int] = {}  # of them, those that no low node holds more closely
    found = [[""] + [n for n in nodes_of(p) if n in low] for p, _, _ in blocks]  # the page is a node, too
    total = sum(len(t) for _, t, _ in blocks)
    for (_, t, _), nodes in zip(blocks, found):
        for i, n in enumerate(nodes):
            held[n] = held.get(n, 0) + len(t)
            own[n] = own.get(n, 0) + len(t) * (i == len(nodes) - 1)

    def stays(nodes: list[str]) -> bool:
        for n in nodes:
            if 2 * held[n] <= total:
                return False
            if own[n] < low_importance * held[n]:
                return True
        return True

    return "\n\n".join(t for (_, t, _), nodes in zip(blocks, found) if stays(nodes))


def host_of(url):
    """The host of an address; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, pages, importance of every node."""
    import xxhash

    def fn(hosts, texts):
        digests, paths, features = [], [], []
        for t in texts:
            seen, whole = {}, xxhash.xxh3_64()
            for path, text, noise, _ in blocks_of(t):
                if not noise:  # noise is cut anyway
                    digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    seen[path + "/", digest] = None
                    whole.update(f"{path}\n{digest}\n".encode("utf-8", "surrogatepass"))
            nodes = {n: None for path, _ in seen for n in nodes_of(path[:-1])}  # the page has the node
            digests.append(whole.intdigest() - (1 << 63))
            paths.append([p for p, _ in seen] + list(nodes))
            features.append([f for _, f in seen] + [None] * len(nodes))
        return hosts, digests, paths, features

    rows = pages.select(host_of(column(url).cast("string")).alias("host"), column(html).cast("string").alias("page"))
    found = map_rows(rows, fn, ["host", "page"], "host string, digest bigint, path array<string>, feature array<bigint>")
    found = found.dropDuplicates(["host", "digest"]).select("host", F.explode(F.arrays_zip("path", "feature")).alias("x")).select("host", "x.*")
    features = found.groupBy("host", "path", "feature").agg(F.count("*").alias("c"))
    # texts and pages of each node by itself, then texts summed over the nodes above; the pages of those are counted, not summed
    single = features.groupBy("host", "path").agg(
        F.sum(F.when(F.col("feature").isNull(), F.col("c"))).alias("pages"), F.count("feature").alias("texts"),
        F.sum(F.when(F.col("feature").isNotNull(), F.ln("c"))).alias("repeated"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    under = single.filter(F.col("texts") > 0).select("host", F.explode(above).alias("path"), F.lit(None).cast("bigint").alias("pages"), "texts", "repeated")
    nodes = under.unionByName(single.filter("pages is not null").select("host", "path", "pages", F.lit(0).cast("bigint").alias("texts"), F.lit(0.0).alias("repeated")))
    nodes = nodes.groupBy("host", "path").agg(F.sum("pages").alias("pages"), (F.sum("repeated") / F.sum("texts")).alias("entropy"))
    return nodes.select("host", "path", "pages", F.when(F.col("pages") > 1, 1 - F.col("entropy") / F.ln("pages")).otherwise(F.lit(1.0)).alias("importance"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            low_importance: float = LOW_IMPORTANCE, doubt: float = DOUBT) -> DataFrame:
    """page_id, url and text of every page."""
    others = F.col("pages") - 1
    low = (style_tree(pages, url, html).filter(1 - (1 - F.col("importance")) * others / (others + doubt) < low_importance)
           .groupBy("host").agg(F.collect_set("path").alias("low")))  # at most the nodes of one site's templates
    rows = pages.select(column(page_id).alias("page_id"), column(url).alias("url"), column(html).cast("string").alias("page"),
                        host_of(column(url).cast("string")).alias("host"))
    # pages of a host are spread over SALTS tasks; the short lists of branches are repeated for each
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "page"), F.lit(SALTS)).cast("int"))
    repeated = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(repeated, ["host", "salt"], "left").drop("host", "salt")

    def fn(ids, urls, texts, lows):
        return ids, urls, [main_text(t, set(v or ()), low_importance) for t, v in zip(texts, lows)]

    types = dict(rows.dtypes)
    return map_rows(joined, fn, ["page_id", "url", "page", "low"], f"page_id {types['page_id']}, url {types['url']}, text string")
