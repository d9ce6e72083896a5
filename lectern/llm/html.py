"""Operator 8: main text of pages by equivalence classes of same-host pages.

The tokens of a page are its container elements and its runs of text (blocks), each told apart by
the path of elements above it. A token's occurrence vector says how often it occurs on each page of its
host; it is folded into one sum of hashes, so that hosts of any size are grouped without gathering their
pages. Tokens with equal vectors form a class. The class of a host's root element holds what every page
has once: the template, nested by its paths. What is left between its tokens are the slots.

The slot to extract is found from the template: its article or main element if it has one, else the
deepest of its containers that has all text which changes from page to page; text of that container that
belongs to the template is not extracted. A host needs ``LEAST_PAGES`` pages, not all of one content, to have
a template. A page of another host, or without the slot, falls back on its own article element, then its
body. Runs of text are tokens as wholes, not word by word, since words at one place of two articles
may be equal by chance and belong to the article all the same.

Parts that their element or class tells to be menus, headers, footers, adverts and the like are left out
wherever they stand. So are forms, but for one that wraps the page, as some servers write it: a form that holds an article
or a first heading, or half of the page's text in paragraphs.

Defined results: a null or empty page has an empty text; pages of any length and depth are read whole; a
null or odd url counts as one host; rows of one id are pages of their own; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import settle, table

#: Rows of a table of hosts that may be sent to every executor.
BROADCAST_ROWS = 20_000
#: Pages that a host's template needs.
LEAST_PAGES = 3

# Elements of HTML by their part in the page.
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tbody thead tr td th figure details fieldset center dialog menu search".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr figcaption address summary caption".split())
SKIPPED = frozenset("script style noscript template textarea title svg canvas iframe object select option button".split())
EXCLUDED = frozenset("nav header footer aside form dialog menu search".split())
PARAGRAPHS = frozenset("p li dd blockquote pre".split())
NEVER_EXCLUDED = frozenset("html body main article".split())
INLINE = frozenset("a abbr b big cite code em font i ins label mark q small span strong sub sup u".split())
#: Parts of a class or id that mark what is not the article, and parts that say nothing beside them.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments disqus respond replies share sharing skip social related recommended pagination pager toolbar copyright legal dialog search searchbox".split()
)
BESIDE = frozenset("box block wrap wrapper container inner outer top bottom left right area list item items bar section links slot unit site page global main primary secondary table row rows col cols column columns cell grid panel pane card body content text strip tile frame holder group bar form field message".split())

#: A tag whose quotes are closed; no part of it can be read in two ways.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
SPACES = re.compile(r"\s+")


@lru_cache(maxsize=4096)
def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in paths, whether it is excluded wherever it stands, and whether it is an article.

    A class excludes if it is made of marks and of words that say nothing beside them.
    """
    words = [w for m in NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()]
    parts = [set(filter(None, re.split(r"[-_0-9]+", w))) for w in words]
    marked = tag not in NEVER_EXCLUDED and any(p & MARKS and p <= MARKS | BESIDE for p in parts)
    name = tag + "".join(sorted({"." + re.sub(r"[0-9]+", "#", w) for w in words}))
    return name, marked or tag in EXCLUDED, tag in ("article", "main") or "main" in words or "article" in words


def below(above: int, name: str) -> int:
    """The path of what stands below another path, as a hash."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), above) >> 1


class Page:
    """Containers in page order, and blocks of text with the container that each stands in.

    ``paths``, ``parents`` (places), ``out`` (excluded) and ``articles`` have one entry for each container, the first for what
    surrounds the page. Elements left open are closed by what surrounds them, as browsers do.
    """

    def __init__(self, page: str):
        self.paths, self.parents, self.out, self.articles = [0], [-1], [False], [False]
        #: The innermost form that each container is in; any form around it excludes it unless that wraps the page.
        self.forms = [-1]
        self.blocks: list[tuple[int, str, str]] = []
        self._read(page)
        if max(self.forms) >= 0:
            self._judge_forms()

    def _judge_forms(self) -> None:
        within = {-1: frozenset()}  # each form with the forms around it
        for k, form in enumerate(self.forms):
            if form not in within:  # a form is the first container in itself
                within[form] = within[self.forms[self.parents[k]]] | {form}
        held: dict[int, int] = {}
        wraps = {form for k, article in enumerate(self.articles) if article and not self.articles[self.parents[k]] for form in within[self.forms[k]]}
        total = 0
        for n, block, text in self.blocks:
            if self.out[n]:
                continue
            total += len(text)
            for form in within[self.forms[n]]:
                if block == "h1":
                    wraps.add(form)
                if block in PARAGRAPHS:
                    held[form] = held.get(form, 0) + len(text)
        wraps |= {form for form, size in held.items() if 2 * size >= total}
        self.out = [out or not within[form] <= wraps for out, form in zip(self.out, self.forms, strict=True)]

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        open_tags: dict[str, int] = {}
        held: list[str] = []
        at, size = 0, len(page)
        lower = None
        quotes = True  # until a tag's quote is never closed
        block, marked = "", False
        hidden, depth = None, 0  # an inline element that is excluded, and how many of its name are open inside

        def flush(next_block: str = "", next_marked: bool = False) -> None:
            nonlocal block, marked, hidden
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text and not marked:
                self.blocks.append((stack[-1][1], block, text))
            block, marked, hidden = next_block, next_marked, None

        def tell(text: str) -> None:
            if hidden is None:
                held.append(text)

        while at < size:
            start = page.find("<", at)
            if start < 0:
                tell(page[at:])
                break
            if start > at:
                tell(page[at:start])
            after = page[start + 1 : start + 2]
            if after in ("!", "?"):
                if page.startswith("<!--", start):
                    end, width = page.find("-->", start + 4), 3
                elif page.startswith("<![CDATA[", start):
                    end, width = page.find("]]>", start), 3
                    if end >= 0:
                        tell(page[start + 9 : end])
                else:
                    end, width = page.find(">", start), 1
                if end < 0:
                    if not page.startswith("<!--", start):
                        tell(page[start:])
                    break
                at = end + width
                continue
            if not (after.isascii() and after.isalpha()) and not (after == "/" and page[start + 2 : start + 3].isalpha()):
                tell("<")
                at = start + 1
                continue
            m = TAG.match(page, start) if quotes else None
            if m:
                closing, tag, attributes, at = m[1], m[2].lower(), m[3].strip(), m.end()
            else:
                end = page.find(">", start)
                if end < 0:
                    tell(page[start:])
                    break
                quotes = False
                closing = "/" if after == "/" else ""
                tag, _, attributes = page[start + 1 + len(closing) : end].strip().partition(" ")
                tag, at = tag.rstrip("/").lower(), end + 1
            empty = attributes.endswith("/")
            if tag in SKIPPED:
                if not closing and not empty:
                    lower = page.lower() if lower is None else lower
                    end = lower.find("</" + tag, at) if len(lower) == size else page.find("</" + tag, at)
                    at = size if end < 0 else end
                continue
            if tag not in BLOCKS:
                if tag == "br":
                    tell(" ")
                elif tag in INLINE and not empty:
                    if hidden == tag:
                        depth += -1 if closing else 1
                        hidden = hidden if depth else None
                    elif hidden is None and not closing and attributes and _named(tag, attributes)[1]:
                        hidden, depth = tag, 1
                continue
            if tag not in CONTAINERS:
                flush(*(("", False) if closing else (tag, bool(attributes) and _named(tag, attributes)[1])))
                continue
            flush()
            if closing:
                # only an element that is open is looked for, so each step down the stack closes one
                if open_tags.get(tag):
                    while stack[-1][0] != tag:
                        open_tags[stack.pop()[0]] -= 1
                    open_tags[stack.pop()[0]] -= 1
            elif not empty:
                name, out, article = _named(tag, attributes)
                above = stack[-1][1]
                # a header of the article belongs to it, the page's own does not
                out = out and not (self.articles[above] and tag == "header" and name == tag)
                form = self.forms[above]
                if tag == "form" and not _named("div", attributes)[1]:
                    out, form = False, len(self.paths)
                self.forms.append(form)
                self.paths.append(below(self.paths[above], name))
                self.parents.append(above)
                self.out.append(self.out[above] or out)
                self.articles.append(self.articles[above] or article)
                stack.append((tag, len(self.paths) - 1))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        flush()

    def run(self, block: tuple[int, str, str]) -> int:
        """The path of a block's text."""
        return below(below(self.paths[block[0]], "#" + block[1]), block[2])


def extract(page: str | None, slot: int | None, article: bool = False, template: frozenset[int] = frozenset()) -> str:
    """The page's main text: of the slot of its host's template, or else of its own article or body.

    ``template`` has the runs of text that belong to the template; they are left out unless the slot is an ``article``.
    """
    read = Page(page or "")
    kept = [b for b in read.blocks if not read.out[b[0]]]
    inside: list[str] = []
    if slot is not None:
        under = [False] * len(read.paths)
        for n in range(1, len(read.paths)):
            under[n] = under[read.parents[n]] or read.paths[n] == slot
        found = [b for b in kept if under[b[0]]]
        inside = [b[2] for b in found if article or read.run(b) not in template] or [b[2] for b in found]
    inside = inside or [b[2] for b in kept if read.articles[b[0]]] or [b[2] for b in kept]
    return "\n\n".join(inside)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


TOKENS = "host string, page bigint, path bigint, parent bigint, depth int, uses bigint, text boolean, article boolean, own bigint, content bigint"


def tokens(pages: DataFrame) -> DataFrame:
    """One row for each token of each page of ``host, page, html``.

    ``own`` and ``content`` are hashes of a container's text outside and with its inner containers (0: none).
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = Page(text or "")
                n = len(read.paths)
                own, content = [0] * n, [0] * n
                found: dict[int, list] = {}
                for b in read.blocks:
                    if not read.out[b[0]]:
                        run = read.run(b)
                        own[b[0]] = (own[b[0]] * 31 + run) & (1 << 62) - 1 or 1
                        found.setdefault(run, [read.paths[b[0]], 0, 0, True, False, 0, run])[2] += 1
                depth = [0] * n
                for k in range(1, n):
                    depth[k] = depth[read.parents[k]] + 1
                for k in range(n - 1, 0, -1):
                    content[k] = (content[k] * 31 + own[k]) & (1 << 62) - 1
                    content[read.parents[k]] = (content[read.parents[k]] * 31 + content[k]) & (1 << 62) - 1
                for k in range(1, n):
                    if not read.out[k]:
                        # an article inside an article is of the outer one's text
                        new = found.setdefault(read.paths[k], [read.paths[read.parents[k]], depth[k], 0, False, read.articles[k] and not read.articles[read.parents[k]], 0, 0])
                        new[2] += 1
                        new[5], new[6] = (new[5] * 31 + own[k]) & (1 << 62) - 1, (new[6] * 31 + content[k]) & (1 << 62) - 1
                rows = [(host, page, path, *x) for path, x in found.items()]
                cols = list(zip(*rows, strict=True)) or [()] * 10
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in TOKENS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return pages.mapInArrow(spread, TOKENS)


def slot_of(nodes: list[dict], odd: set[int]) -> tuple[int | None, bool]:
    """The slot among a template's containers, and whether it is an article; ``odd`` has paths with text outside the template below them.

    From the root down: a container is left for its child if no text of its own changes and that child alone holds
    text that does.
    """
    articles = [n for n in nodes if n["article"]]
    if articles:
        best = min(articles, key=lambda n: (n["depth"], n["path"]))
        return best["path"], True
    children: dict[int, list[dict]] = {}
    for n in nodes:
        children.setdefault(n["parent"], []).append(n)
    at, slot = 0, None
    while True:
        changing = [n for n in children.get(at, []) if n["changes"]]
        if len(changing) != 1 or (slot is not None and at in odd):
            return slot, False
        slot = at = changing[0]["path"]
        if changing[0]["own_changes"]:
            return slot, False


def templates(pages: DataFrame) -> DataFrame:
    """``of_host``, ``slot``, ``is_article`` and ``runs`` (the template's runs of text) of each host that has a template."""
    of_page = F.xxhash64("page", "uses").cast("decimal(38,0)")
    seen = tokens(pages).groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.sum(of_page).alias("vector"), F.max("uses").alias("most"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.first("text").alias("text"), F.max("article").alias("article"), (F.min("own") != F.max("own")).alias("own_changes"), (F.min("content") != F.max("content")).alias("changes"),
        F.max("content").alias("content"),
    )
    seen = settle(seen)
    # the root that most pages have: its class is the template, if each of its pages has it once
    root = F.max(F.struct("pages", "most", "vector", "changes")).alias("root")
    roots = seen.where("parent = 0 and not text").groupBy("host").agg(root).where(f"root.pages >= {LEAST_PAGES} and root.most = 1 and root.changes")
    roots = settle(roots.select(F.col("host").alias("root_host"), F.col("root.vector").alias("root_vector")))
    few = "broadcast" if roots.count() <= BROADCAST_ROWS else "merge"
    joined = seen.join(roots.hint(few), F.col("host") == F.col("root_host"))
    same = F.col("vector") == F.col("root_vector")
    node = F.struct("path", "parent", "depth", F.col("article"), "own_changes", "changes")
    frame = joined.where(same).groupBy("host").agg(F.collect_list(F.when(~F.col("text"), node)).alias("nodes"), F.collect_list(F.when(F.col("text"), F.col("path"))).alias("runs"))
    # a container that only some pages have, or more than once, makes the one above it a place of changing text; the
    # template is no larger than one page of its host, so a host's containers and odd places fit into one row
    outside = joined.where(~same & ~F.col("text") & (F.col("content") != 0)).select(F.col("host").alias("odd_host"), F.col("parent").alias("odd_path")).distinct()
    places = joined.where(same & ~F.col("text")).select("host", "path")
    odd = places.join(outside.hint("merge"), (F.col("host") == F.col("odd_host")) & (F.col("path") == F.col("odd_path"))).groupBy("odd_host").agg(F.collect_set("path").alias("odd"))
    kept = frame.join(odd.hint("merge"), F.col("host") == F.col("odd_host"), "left").select("host", "nodes", "runs", F.coalesce("odd", F.array().cast("array<bigint>")).alias("odd"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [slot_of(n, set(o)) for n, o in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in got], pa.int64()), pa.array([a for _, a in got], pa.bool_()), batch.column(2)], names=["of_host", "slot", "is_article", "runs"]
            )

    return kept.mapInArrow(choose, "of_host string, slot bigint, is_article boolean, runs array<bigint>").where("slot is not null")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_template: bool = True) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of each page; ``with_template`` false has every page fall back on itself."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    found = settle(templates(rows.select("host", F.xxhash64("id", "url").alias("page"), "html")) if with_template else rows.sparkSession.createDataFrame([], "of_host string, slot bigint, is_article boolean, runs array<bigint>"))
    few = found.count() <= BROADCAST_ROWS
    slots = rows.join(found.hint("broadcast" if few else "merge"), F.col("host") == F.col("of_host"), "left").select("id", "url", "slot", "is_article", "runs", "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[list, frozenset]] = {}

        def as_set(slot: int | None, runs: list | None) -> frozenset:
            # rows of a host carry the same runs, and no two hosts' slots with different runs stay in one entry
            if slot is None or not runs:
                return frozenset()
            if slot not in sets or sets[slot][0] != runs:
                if len(sets) >= 1000:
                    sets.clear()
                sets[slot] = runs, frozenset(runs)
            return sets[slot][1]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                told = zip(*(part.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
                texts = [extract(h, s, bool(a), as_set(s, r)) for s, a, r, h in told]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["id"]
    return slots.mapInArrow(work, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
