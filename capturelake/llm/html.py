"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its block elements, by path, and its blocks of text,
by path and content.  Over the pages of a host, tokens with the same
occurrence vector (how often on each page) form an equivalence class.  Classes
that are large and frequent enough are valid: nested by path they are the
host's template.  What the template does not hold are the slots; those of the
article, where there is one, are the main text.

An occurrence vector is known by the pages and occurrences in it and by the
exclusive or of a hash of each (page, count), so that Spark adds it up in
parts and no host's pages ever meet in one task.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.arrays import Arrays, write_arrays
from capturelake.llm.common import map_batches, shared_path, written

#: A class is valid from so many tokens and pages, however many the host has.
LEAST_TOKENS, LEAST_PAGES = 2, 3
#: A text is a slot's fixed part on this share of the slot's pages, and one of
#: a few that sections of the host have on this one, if nearly all are such.
SHARE, SECTION, FULL = 0.5, 0.05, 0.9
#: Where other texts are around it (and in an article always) a text is the
#: template's only from so many pages.
SURE_PAGES = 10
#: What fixed texts on fewer than SHARE of a host's pages leave of a page's main
#: text at least: otherwise they are versions of that page, not a template.
LEFT = 0.2
#: A slot with a larger share of characters in links is navigation.
LINKS = 0.5
#: The main text is in the element that has such a share of the varying text of
#: the one around it.
MAIN = 0.7
#: Rows of a host's template that are put in one part of it; rows of all
#: templates in one file of them.
PART_ROWS, FILE_ROWS = 20_000, 500_000
#: Pages whose texts are looked up at once.
PAGES = 256

# Kinds of elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Opening one of the keys closes an open one of the values, up to a list, table or section.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
BARRIERS = {"ul", "ol", "dl", "table", "select"}
DROPPED = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "dialog", "menu", "iframe", "svg", "canvas", "object", "textarea"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3"}
HINT = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|newsletter|subscribe|sidebar|widget|nav\w*|menu|breadcrumbs?|footer|masthead|comments?|replies|respond|disqus|share|sharing|social|related|recommend\w*|login|signup|search|pagination|pager|toolbar|copyright|legal|skip)(?:[-_\s]|$)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>""",
    re.S | re.I,
)
#: An element deeper than this is taken for a sibling of the one around it.
DEPTH = 256
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def label(tag: str, attributes: str) -> str:
    """An element's part of a path: its tag, ``!`` if it is boilerplate by its
    kind, role or name, and its class and id."""
    found = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = " ".join(x for x in (found.get("class", ""), found.get("id", "")) if x)
    drop = tag in DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or (names and HINT.search(names) and tag not in ARTICLE | {"body", "html"})
    # numbers in an id, and long ones in a class, are a page's own (post-12): they do not make another kind of element
    own = " ".join(x for x in (re.sub(r"[0-9]{3,}", "#", found.get("class", "")), re.sub(r"[0-9]+", "#", found.get("id", ""))) if x)
    return tag + ("!" if drop else "") + ("." + re.sub(r"[\s/]+", ".", own.strip()) if own else "")


def blocks(page: str) -> tuple[list[tuple[str, str, int]], Counter]:
    """The page's blocks of text (path, text, characters in links), in order,
    and its block elements by path."""
    out: list[tuple[str, str, int]] = []
    paths: Counter = Counter()
    stack: list[tuple[str, str]] = []  # tag, path
    parts: list[str] = []
    linked = links = at = 0
    unclosed = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1] if stack else "", text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        flush()
        del stack[to:]

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if links:
                linked += len(s)

    # no tag ends after the last >: what stands there is text, but for the rest of
    # something that is never closed.  Every search that begins before it ends
    # where the next one begins, so that all of them together read the page once.
    end = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, end):
        text(page[at : m.start()])
        at, unclosed = m.end(), (m[0][:4] == "<!--" and m[0][-3:] != "-->") or (m[1] is not None and not _CLOSED.search(m[0][-64:]))
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing = bool(m[2] or m[5])
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            else:
                flush()
        else:
            flush()
            shut = CLOSES.get(tag)
            for i in range(len(stack) - 1, -1, -1):
                open_ = stack[i][0]
                if open_ == "p" or (shut and open_ in shut):
                    pop(i)
                elif open_ in BARRIERS or not shut:
                    break
            path = (stack[-1][1] if stack else "") + "/" + label(tag, m[4] or "")
            paths[path] += 1
            links = 0
            if not (m[4] or "").endswith("/") and len(stack) < DEPTH:
                stack.append((tag, path))
    if at < end or not unclosed:
        tail = page[at:]
        text(tail[: tail.find("<!--")] if "<!--" in tail else tail)
    flush()
    return out, paths


_CLOSED = re.compile(r"</[a-z]+\s*>\Z", re.I)
_STEP = re.compile(r"/([a-z0-9:_-]+)(!?)", re.I)


def in_article(path: str) -> bool:
    return any(m[1] in ARTICLE for m in _STEP.finditer(path))


def boilerplate(path: str) -> bool:
    """Whether an element on the path is boilerplate: by its label, or a header
    outside any article."""
    inside = False
    for m in _STEP.finditer(path):
        inside = inside or m[1] in ARTICLE
        if m[2] or (m[1] == "header" and not inside):
            return True
    return False


def within(path: str) -> Iterator[str]:
    """The path of an element and those around it, nearest first."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def _long(s: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace"))).view(np.int64))


def text_token(path: str, text: str) -> int:
    return _long(f"{path}\0{text}")


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _occurrences(pages: DataFrame) -> DataFrame:
    """For each page: itself, its elements, its blocks of text and its slots."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            where, key = host(url), _long(page or "")
            found, paths = blocks(page or "")
            size, link, number, around, around_link = Counter(), Counter(), Counter(), Counter(), Counter()
            for p, t, k in found:
                size[p] += len(t)
                link[p] += k
                number[p] += 1
            for p, n in size.items():
                for e in within(p):
                    around[e] += n
                    around_link[e] += link[p]
            rows.append((where, "page", "", 0, key, 1, 0, 0))
            rows += [(where, "path", p, _long(p), key, n, around[p], around_link[p]) for p, n in paths.items()]
            rows += [(where, "text", p, text_token(p, t), key, n, n * len(t), 0) for (p, t), n in Counter((p, t) for p, t, _ in found).items()]
            rows += [(where, "slot", p, _long(p), key, number[p], n, link[p]) for p, n in size.items()]
        if not rows:
            return
        columns = zip(*rows, strict=True)
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "kind", "path", "token", "page", "n", "chars", "links"])

    return map_batches(pages, run, "host string, kind string, path string, token long, page long, n long, chars long, links long")


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, part, template as JSON): what the pages of each host share, in
    parts of about PART_ROWS rows.

    Classes that are not valid are left out, but no share of the host's pages
    is asked: a layout or section has its own classes.  ``fixed`` are the
    texts that the template holds.  A text of a valid class is such if half
    of the pages with its path have it; or its class has an element of the
    page, so that it belongs to a layout; or the path has few texts but of
    that kind.  Where a path has other texts, pages may have equal ones by
    chance: in an article the text must be on SURE_PAGES pages and half of the
    path's, elsewhere a class without elements must be on SURE_PAGES too.
    Those on fewer than half of the host's pages are ``weak``: the texts of one
    article whose page has several versions are such, too.
    ``places`` are slots and elements, each with whether it is mostly links;
    ``husks`` the elements of articles without other text than the template's;
    ``main`` the elements of the main text (see :func:`_main`).
    """
    found = _occurrences(pages.select(F.col(url).cast("string"), F.col(html).cast("string")))
    # a page that repeats another counts once
    once = found.distinct()
    sums = once.groupBy("host", "kind", "path", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("sign"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    sums = written(sums.where(F.col("pages") >= LEAST_PAGES), "tokens")
    tokens = sums.where("kind in ('path', 'text')").withColumn("class", F.xxhash64("pages", "total", "sign"))
    classes = tokens.groupBy("host", "class").agg(F.count("*").alias("size"), F.count_if(F.col("kind") == "path").alias("elements")).where(F.col("size") >= LEAST_TOKENS)
    valid = tokens.join(classes, ["host", "class"])
    slots = sums.where("kind = 'slot'")
    of = slots.select("host", "path", F.col("pages").alias("of"), F.col("total").alias("all"))
    texts = valid.where("kind = 'text'").join(of, ["host", "path"])
    part = F.col("pages") >= F.col("of") * SECTION
    held = texts.where(part).groupBy("host", "path").agg(F.sum("total").alias("held"))
    texts = texts.join(held, ["host", "path"], "left")
    closed = part & (F.col("held") >= F.col("all") * FULL)
    half, sure, layout = F.col("pages") >= F.col("of") * SHARE, F.col("pages") >= SURE_PAGES, F.col("elements") > 0
    article = F.col("path").rlike(r"(?i)/(article|main)(?![a-z0-9:_-])")
    fixed = written(texts.where(closed | F.when(article, half & sure).otherwise(half | layout | (part & sure))).select("host", "path", "token", "chars", "pages"), "fixed")
    number = sums.where("kind = 'page'").select("host", F.col("pages").alias("number"))
    fixed = written(fixed.join(number, "host").withColumn("weak", F.col("pages") < F.col("number") * SHARE).drop("number", "pages"), "strength")
    elements = valid.where("kind = 'path'").select("host", "path", "chars", "links")
    places = slots.select("host", "path", "chars", "links").union(elements.where("chars > 0").join(of, ["host", "path"], "left_anti"))
    steps = F.split("path", "/")
    around = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    own = written(fixed.select("host", "chars", "weak", F.explode(around).alias("path")).groupBy("host", "path").agg(F.sum("chars").alias("own"), F.sum(F.when(~F.col("weak"), F.col("chars"))).alias("sure")), "own")
    husks = elements.where(article).join(own, ["host", "path"], "left").where("coalesce(sure, 0) >= chars")
    main = _main(valid.where("kind = 'path'").select("host", "path", "pages", "total", "chars", "links"), own)
    none = F.lit(None).cast("long")
    rows = fixed.select("host", F.when(F.col("weak"), "weak").otherwise("fixed").alias("kind"), "path", "token").union(places.select("host", F.lit("places"), "path", F.when(F.col("links") > F.col("chars") * LINKS, 1).otherwise(0).cast("long"))).union(husks.select("host", F.lit("husks"), "path", none)).union(main.select("host", F.lit("main"), "path", none))
    rows = written(rows, "rows")
    parts = rows.groupBy("host").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    dealt = rows.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("path", "token"), F.col("parts")))
    grouped = dealt.groupBy("host", "part").agg(F.to_json(F.collect_list(F.struct("kind", "path", "token"))).alias("rows"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for packed in batch.column(2).to_pylist():
            t: dict = {"fixed": [], "weak": [], "husks": [], "main": [], "places": {}}
            for r in json.loads(packed):
                if r["kind"] == "places":
                    t["places"][r["path"]] = r["token"]
                else:
                    t[r["kind"]].append(r["token"] if r["kind"] in ("fixed", "weak") else r["path"])
            made.append(json.dumps(t))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["host", "part", "template"])

    return map_batches(grouped, run, "host string, part long, template string")


def _main(elements: DataFrame, own: DataFrame) -> DataFrame:
    """(host, path) of the template's elements that hold the main text.

    Of an element's text what is in links or held by the template does not
    count; what is left varies from page to page.  From the outermost element
    inwards, one that is once on its pages and has MAIN of the varying text of
    the one around it is the next, as long as it contains elements itself and
    is not an article yet.  Layouts of a host have main elements of their own.
    """
    before = F.expr("substring_index(path, '/', size(split(path, '/')) - 1)")
    rows = elements.join(own, ["host", "path"], "left").withColumn("before", before)
    rows = written(rows.withColumn("varying", F.greatest(F.col("chars") - F.col("links") - F.coalesce("own", F.lit(0)), F.lit(0)) / F.col("pages")), "varying")
    around = rows.select("host", F.col("path").alias("before"), F.col("varying").alias("whole"))
    holds = rows.select("host", F.col("before").alias("path")).distinct()
    steps = rows.where((F.col("total") == F.col("pages")) & (F.col("varying") > 0)).join(holds, ["host", "path"], "left_semi")
    # an article need not contain elements
    alone = rows.where((F.col("total") == F.col("pages")) & (F.col("varying") > 0) & F.col("path").rlike(r"(?i)/(article|main)(!?\.[^/]*)?$"))
    steps = steps.unionByName(alone).distinct().join(around, ["host", "before"], "left")
    steps = steps.where((F.col("whole").isNull() | (F.col("varying") >= F.col("whole") * MAIN)) & ~F.col("before").rlike(r"(?i)/(article|main)(?![a-z0-9:_-])"))
    steps = written(steps.select("host", "path", "before"), "steps")
    parts = F.split("path", "/")
    chain = steps.select("host", "path", "before", F.size(parts).alias("depth"), F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("step"))
    found = chain.join(steps.select("host", F.col("path").alias("step")), ["host", "step"]).groupBy("host", "path", "before", "depth").agg(F.count("*").alias("n")).where("n = depth - 1")
    return found.join(found.select("host", F.col("before").alias("path")), ["host", "path"], "left_anti").select("host", "path")


def _mark(kind: str, where: str, what: str | int) -> int:
    return _long(f"{kind}\0{where}\0{what}")


def _marks(made: DataFrame) -> DataFrame:
    """(h, v): the rows of all templates, by hash: 1, or 2 for a place that is mostly links or a weak text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for where, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = json.loads(packed)
            rows = [(_mark("fixed", where, x), 1 + (k == "weak")) for k in ("fixed", "weak") for x in t[k]] + [(_mark("husk", where, x), 1) for x in t["husks"]] + [(_mark("main", where, x), 1) for x in t["main"]] + [(_mark("place", where, x), 1 + k) for x, k in t["places"].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["h", "v"])

    return map_batches(made, run, "h long, v long")


def main_texts(pages: list[tuple[str | None, str | None]], arrays: Arrays) -> list[str]:
    """For each page (url, html) the blocks in slots of the main text, one a line.

    No text that the host's template holds is in a slot, and none in a place
    that is mostly links on the host's pages; a slot that the template does
    not know is judged by its nearest element that it does.  Of the rest those
    in the template's main elements are chosen, and the headings beside these
    and the elements around them.  Where the host has too few pages for the
    page's main element to be known, names decide: the slots within an article
    are chosen where the page has one that is more than a husk, else all that
    are not mostly links on the page.  Where the template's weak texts would
    leave less than LEFT of what the others do, they stay: the page has
    versions, whose common texts they are.  Elements that are boilerplate by their
    kind or name have no slots.
    """
    parsed = [(host(url), *blocks(page or "")) for url, page in pages]
    asked: dict[tuple, int] = {}
    for where, found, paths in parsed:
        for p in {p for p, _, _ in found}:
            for e in within(p):
                asked.setdefault(("place", where, e), 0)
                asked.setdefault(("main", where, e), 0)
        for p, t, _ in found:
            asked.setdefault(("fixed", where, text_token(p, t)), 0)
        for p in paths:
            if in_article(p):
                asked.setdefault(("husk", where, p), 0)
    h = np.array([_mark(*k) for k in asked], np.int64).view(np.uint64)
    order = np.argsort(h)
    marks = np.zeros(len(h), np.int64)
    marks[order] = arrays.find(h[order])[0].astype(np.int64)
    asked = dict(zip(asked, marks.tolist(), strict=True))
    out = []
    for where, found, paths in parsed:
        article = any(in_article(p) and not boilerplate(p) and not asked["husk", where, p] for p in paths)
        main = {e for p, _, _ in found for e in within(p) if asked["main", where, e] and not boilerplate(e)}
        beside = {e for m in main for e in within(m)}
        kept, sure = [], []
        for path, text, linked in found:
            if boilerplate(path):
                continue
            if main:
                last, _, tag = path.rpartition("/")
                chosen = any(e in main for e in within(path)) or (last in beside and tag.split(".")[0] in HEADINGS)
                chosen = chosen and (in_article(path) or 2 * linked <= len(text))
            else:
                chosen = in_article(path) if article else 2 * linked <= len(text)
            if not chosen:
                continue
            held = asked["fixed", where, text_token(path, text)]
            if held != 1 and next((v for p in within(path) if (v := asked["place", where, p])), 1) == 1:
                sure.append(text)
                if not held:
                    kept.append(text)
        out.append("\n".join(kept if sum(map(len, kept)) >= LEFT * sum(map(len, sure)) else sure))
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null html is empty and gives an empty text; a null url has the host '';
    repeated rows each give a row; other columns are not read; an empty table
    gives an empty result.  A host with fewer than LEAST_PAGES distinct pages
    has no template: its pages are judged by their own elements.

    The templates' rows are arrays sorted by hash in the shared folder, which
    workers map into memory: no host's template has to fit in one of them.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "templates")
    marks = written(_marks(templates(pages, url, html)), "marks")
    shards = max(1, -(-marks.count() // FILE_ROWS))
    names = [""] * shards
    for shard, name in write_arrays(marks, "template", path, ["v"], shards).collect():
        names[shard] = name
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(path, names, 1)
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                ids, urls, pages_ = batch.slice(at, PAGES).columns
                texts = main_texts(list(zip(urls.to_pylist(), pages_.to_pylist(), strict=True)), arrays)
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
