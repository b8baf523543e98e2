"""Operator 10: main text of web pages by inferred wrappers.

Method: union-free regular-expression inference. Pages of one host come from
few templates; pages with and without an article (or main) element are kept
apart. Every page is cut into block elements and text slots, and one wrapper of
each of the two is inferred by aligning all their pages: equal neighbours (or
runs of equal groups) fold into a repeated group ``(...)+``; where two pages
differ, an element that only one of them has becomes an optional group
``(...)?``; text that differs becomes a slot, text that is the same everywhere
stays a constant of the template. For each structural path it is then said
whether its slots are main text:

* never below menus, page headers, footers, sidebars, notices, adverts,
  forms and reader comments (by element or by the words of class, id, role);
* if the page has an article (or main) element with text, only below it;
* otherwise paths of the wrapper whose text varies and that do not only hold
  links. Both are aggregates over all such pages of the host. A text is
  constant if two pages of different text have the path and all say the same
  there; copies of a page count once.

Paths that fewer than two different pages have are judged by the same rules on
the page alone.

Constants of the template are no main text inside an article either: a block
(path and text) that ``SHARE`` percent of all distinct pages of the host and
kind have, where these are ``LEAST`` or more, is left out of them all. Pages
whose constants are more than ``MOST_CONSTANT`` percent of their text are
copies of each other, not a template: unless ``SHARE`` percent of the distinct
pages stay within that, all keep them.

Scale. No page is left out of the inference. A task folds pages of one
structure into one tree and aligns the different trees of a batch; a host's
partial wrappers, one per batch at most and equal ones once, are aligned in
sixteen groups and then with each other. Blocks are counted by 128-bit hashes of path and
text, one row per page and block, distinct pages first, so a block that all
pages have is combined in the tasks. What a path says is four minima and
maxima per host and path, summed first in each batch. The wrappers are
broadcast after a size check and joined by shuffle beyond that. The paths, the
constants and the texts do not depend on how pages are dealt; how a wrapper
groups optional elements may.

Text: character references are decoded, white space within a block becomes
one space, blocks are joined in page order by one space.

Defined results: null or empty html and pages without main text give an empty
string; a null url has no host and no wrapper; repeated rows each give a row;
extra columns are ignored; an empty table gives an empty result. Markup that
is cut off or badly nested is read as far as it goes.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast

LEAST = 4            # distinct pages, from which on equal text says something
SHARE = 90           # percent of a host's distinct pages that have a constant
MOST_CONSTANT = 30   # percent of a page's text
MAX_WRAPPERS = 200_000
PARTS = 16           # groups in which a host's partial wrappers are aligned first
# Elements of the markup language by what they do to text.
RAW = "script style noscript template textarea select button svg iframe object head title math canvas audio video".split()
BLOCK = ("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
         "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
         "table tbody td tfoot th thead tr ul").split()
NOISE_TAGS = "nav header footer aside form menu dialog fieldset".split()
# Words of class, id and role names that mark other things than main text (parameter).
NOISE_WORDS = ("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
               "disqus footer login menu modal nav navbar navigation newsletter notice popup promo related replies responses search share sharing "
               "sidebar signup skip social sponsor sponsored subscribe widget").split()
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLOCK, _RAW, _NOISE_TAGS, _NOISE = set(BLOCK), set(RAW), set(NOISE_TAGS), set(NOISE_WORDS)


def element_key(tag: str, attributes: str) -> str:
    """Element name, with ``!`` if it or its names mark other than main text."""
    noise = tag in _NOISE_TAGS
    if not noise and "=" in attributes:
        for m in NAMES.finditer(attributes):
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())
            noise = noise or not _NOISE.isdisjoint(words)
    return tag + "!" * noise


def blocks(page: str) -> list[tuple[tuple[str, ...], str, bool]]:
    """(path of block elements, text, inside a link) of each text block."""
    out: list[tuple[tuple[str, ...], str, bool]] = []
    stack: list[str] = []
    held: list[str] = []
    linked, pos, n = [0, 0], 0, len(page)
    anchor = 0

    def flush() -> None:
        text = " ".join(_html.unescape("".join(held)).split())
        if text:
            out.append((tuple(stack), text, linked[0] * 2 > linked[1]))
        held.clear()
        linked[:] = [0, 0]

    def say(text: str) -> None:
        if text:
            held.append(text)
            linked[1] += len(text)
            linked[0] += len(text) if anchor else 0

    while pos < n:
        at = page.find("<", pos)
        m = TAG.match(page, at) if at >= 0 else None
        if m is None:
            end = n if at < 0 else at + 1  # a lone "<" is text
            say(page[pos:end])
            pos = end
            continue
        say(page[pos:at])
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW:
            if not closing and not m[3].endswith("/>"):
                flush()
                over = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.I).search(page, pos)
                pos = over.end() if over else n
            continue
        if tag == "a":
            anchor = 0 if closing else 1
            continue
        if tag not in _BLOCK:
            continue
        flush()
        if tag in ("br", "hr"):
            continue
        names = [k.rstrip("!") for k in stack]
        if closing:
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag):]
            continue
        for same in ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"p"}):
            if same in names and not any(x in ("ul", "ol", "table", "blockquote", "div", "section", "article", "dl")
                                         for x in names[len(names) - names[::-1].index(same):]):
                del stack[len(names) - 1 - names[::-1].index(same):]
                names = [k.rstrip("!") for k in stack]
        stack.append(element_key(tag, m[3]))
    flush()
    return out


# -- wrapper inference ------------------------------------------------------
# A node is [key, flag, kids, text]: flag is "" (once), "+" (repeated) or "?"
# (optional); a text slot has the key "#" and its constant text or None.

def page_tree(found) -> list:
    """The block elements and text slots of a page's blocks, repeated groups
    folded."""
    root = ["", "", [], None]
    for path, text, link in found:
        node = root
        for key in path:
            last = node[2][-1] if node[2] else None
            if last is None or last[0] != key or last[2] and last[2][-1][0] in ("#", "#a") and key == path[-1]:
                node[2].append(last := [key, "", [], None])
            node = last
        node[2].append(["#a" if link else "#", "", [], text])
    return fold(root)


def shape(node: list) -> tuple:
    return node[0], tuple(shape(k) for k in node[2])


def fold(node: list) -> list:
    """Folds runs of equal groups (of one to three children) into ``+``."""
    kids = [fold(k) for k in node[2]]
    for width in (1, 2, 3):
        out: list = []
        i = 0
        while i < len(kids):
            group = [shape(k) for k in kids[i:i + width]]
            j = i + width
            while len(group) == width and [shape(k) for k in kids[j:j + width]] == group:
                for a, b in zip(kids[i:i + width], kids[j:j + width]):
                    merge_text(a, b)
                    a[1] = "+"
                j += width
            if j > i + width:
                out += kids[i:i + width]
                i = j
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return [node[0], node[1], kids, node[3]]


def merge_text(a: list, b: list) -> None:
    if a[3] != b[3]:
        a[3] = None
    for x, y in zip(a[2], b[2]):
        merge_text(x, y)


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers: children are matched by key in order
    (longest common subsequence), the others become optional."""
    n, m = len(a[2]), len(b[2])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[2][i][0] == b[2][j][0] else max(best[i + 1][j], best[i][j + 1])
    kids, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[2][i][0] == b[2][j][0]:
            kids.append(align(a[2][i], b[2][j]))
            i, j = i + 1, j + 1
        else:
            if j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
                x, i = a[2][i], i + 1
            else:
                x, j = b[2][j], j + 1
            kids.append([x[0], x[1] or "?", x[2], x[3]])
    joined = [a[0], a[1] if a[1] == b[1] else "+" if "+" in (a[1], b[1]) else "?", kids, a[3] if a[3] == b[3] else None]
    return refold(joined)


def refold(node: list) -> list:
    """After aligning, equal neighbours of one repeated group become one."""
    out: list = []
    for k in node[2]:
        if out and "+" in (out[-1][1], k[1]) and shape(out[-1]) == shape(k):
            merge_text(out[-1], k)
            out[-1][1] = "+"
        else:
            out.append(k)
    return [node[0], node[1], out, node[3]]


def aligned(trees) -> list:
    """One wrapper of trees or wrappers; those of one shape are one."""
    shapes: dict[tuple, list] = {}
    for t in trees:
        if (same := shapes.setdefault(shape(t), t)) is not t:
            merge_text(same, t)
    wrapper, *rest = shapes.values()
    for t in rest:
        wrapper = align(wrapper, t)
    return wrapper


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression over elements."""
    inner = " ".join(expression(k) for k in node[2])
    body = ("#" if node[3] is None else repr(node[3])) if node[0] in ("#", "#a") else f"<{node[0]}>{inner}</{node[0]}>" if node[0] else inner
    return f"({body}){node[1]}" if node[1] else body


def slot_paths(wrapper: list) -> list[str]:
    """The structural paths of the wrapper's slots."""
    found: dict[str, None] = {}

    def walk(node: list, path: tuple[str, ...]) -> None:
        for k in node[2]:
            if k[0] in ("#", "#a"):
                found["/".join(path)] = None
            else:
                walk(k, (*path, k[0]))

    walk(wrapper, ())
    return list(found)


def article(path) -> bool:
    return "article" in path or "main" in path


def noisy(path) -> bool:
    """Below an element of other than main text; a header within the article
    holds its title and counts as text."""
    seen = False
    for key in path:
        if key.endswith("!") and not (seen and key == "header!"):
            return True
        seen = seen or key == "article"
    return False


def main_blocks(found, paths: dict[str, bool]):
    """(path, text) of the main text's blocks: those of the article, or
    without one by the wrapper's paths and, where they do not say, by the
    page's own structure."""
    if has_article(found):
        return [("/".join(p), text) for p, text, _ in found if article(p) and not noisy(p)]
    return [("/".join(p), text) for p, text, link in found if not noisy(p) and paths.get("/".join(p), not link)]


def main_text(page: str | None, paths: dict[str, bool], constants=frozenset()) -> str:
    """Main text of a page matched against its wrapper: its main blocks
    without the template's constants."""
    return " ".join(text for path, text in main_blocks(blocks(page or ""), paths) if (path, text) not in constants)


def has_article(found) -> bool:
    return any(article(p) and not noisy(p) for p, _, _ in found)


# -- Spark ------------------------------------------------------------------

def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^[^:/?#]*://([^/?#]*)", 1))


def has_element(html):
    """Whether a page names an article or main element."""
    return F.coalesce(F.col(html).cast("string").rlike("(?i)<(article|main)\\b"), F.lit(False))


def block_hash(path: str, text: str) -> bytes:
    """128 bits of a block's path and text."""
    import xxhash

    return xxhash.xxh3_128_digest(f"{path}\n{text}".encode("utf-8", "surrogatepass"))


def _page_rows(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    return pages.select(host_of(F.col(url_col)).alias("host"), has_element(html_col).alias("kind"), F.col(html_col).cast("string").alias("html"),
                        F.xxhash64(F.col(html_col).cast("string")).alias("page")).filter("host <> '' and html <> ''")


def _learn(batches):
    """Of each batch: a partial wrapper per host and kind; each page; each
    main block of a page."""
    import json

    import pyarrow as pa

    names, types = ["host", "kind", "page", "block", "wrapper"], [pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        seen: dict[tuple, dict] = {}
        main: dict[tuple, list] = {}
        out = []
        for host, kind, html, page in zip(*[c.to_pylist() for c in batch.columns]):
            found = blocks(html)
            structure, texts = tuple((path, link) for path, _, link in found), [text for _, text, _ in found]
            if structure not in main:  # which blocks are main ones, their structure says
                main[structure] = main_blocks([(path, i, link) for i, (path, link) in enumerate(structure)], {})
            out.append((host, kind, page, None, None))
            out += ((host, kind, page, h, None) for h in {block_hash(path, texts[i]) for path, i in main[structure]})
            # Pages of one structure are one, with the texts that they share.
            same = seen.setdefault((host, kind), {})
            known = same.get(structure)
            same[structure] = texts if known is None else [a if a == b else None for a, b in zip(known, texts)]
        for (host, kind), same in seen.items():
            tree = aligned(page_tree((path, text, link) for (path, link), text in zip(s, texts)) for s, texts in same.items())
            out.append((host, kind, None, None, json.dumps(tree)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], names)


def _join_wrappers(pdf: pd.DataFrame) -> list:
    import json

    return aligned(json.loads(w) for w in sorted(pdf["wrapper"]))


def _some(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    import json

    return pd.DataFrame({"host": [key[0]], "kind": [key[1]], "wrapper": [json.dumps(_join_wrappers(pdf))]})


def _infer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    wrapper = _join_wrappers(pdf)
    return pd.DataFrame({"host": [key[0]], "kind": [key[1]], "wrapper": [expression(wrapper)], "paths": [slot_paths(wrapper)]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, kind, wrapper, paths, constants): one wrapper per host and kind
    (whether the pages have an article) of all their pages, with the paths of
    its slots and the constants among its main blocks."""
    from .scratch import written

    learned = written(_page_rows(pages, url_col, html_col).mapInArrow(
        _learn, "host string, kind boolean, page long, block binary, wrapper string"))
    parts = learned.filter("wrapper is not null").select("host", "kind", "wrapper").distinct()
    parts = parts.groupBy("host", "kind", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))).applyInPandas(
        lambda key, pdf: _some(key, pdf), "host string, kind boolean, wrapper string")
    wrappers = parts.groupBy("host", "kind").applyInPandas(_infer, "host string, kind boolean, wrapper string, paths array<string>")
    total = written(learned.filter("page is not null and block is null").groupBy("host", "kind").agg(F.count_distinct("page").alias("total")))
    shared = learned.filter("block is not null").groupBy("host", "kind", "block").agg(F.count_distinct("page").alias("n")).join(
        bounded_broadcast(total, MAX_WRAPPERS), ["host", "kind"]).filter((F.col("total") >= LEAST) & (100 * F.col("n") >= SHARE * F.col("total")))
    shared = written(shared.groupBy("host", "kind").agg(F.collect_list("block").alias("shared")))
    constants = template_constants(pages, shared, url_col, html_col)
    none = F.array().cast("array<struct<path:string,text:string>>")
    return wrappers.join(constants, ["host", "kind"], "left").withColumn("constants", F.coalesce("constants", none))


def _said(batches):
    """Per host, kind and path of pages without an article: the least and
    largest hash of its texts and of the pages' texts, and whether one is no link."""
    import pyarrow as pa
    import xxhash

    h = lambda text: xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
    names = ["host", "kind", "path", "lo", "hi", "page_lo", "page_hi", "plain"]
    for batch in batches:
        seen: dict[tuple, list] = {}
        for host, kind, page in zip(*[c.to_pylist() for c in batch.columns]):
            found = blocks(page)
            if has_article(found):
                continue
            found = [x for x in found if not noisy(x[0])]
            whole = h("\n".join(text for _, text, _ in found))
            for path, text, link in found:
                t = h(text)
                x = seen.setdefault((host, kind, "/".join(path)), [t, t, whole, whole, False])
                x[:] = min(x[0], t), max(x[1], t), min(x[2], whole), max(x[3], whole), x[4] or not link
        cols = list(zip(*[(*k, *v) for k, v in seen.items()])) or [()] * 8
        types = [pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def judge_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, kind, path, main): whether a path of pages without an article
    is main text, where two different pages have it."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), has_element(html_col).alias("kind"),
                        F.col(html_col).cast("string").alias("html")).filter("host <> '' and html <> ''")
    said = rows.mapInArrow(_said, "host string, kind boolean, path string, lo long, hi long, page_lo long, page_hi long, plain boolean")
    said = said.groupBy("host", "kind", "path").agg(*[F.min(c).alias(c) for c in ("lo", "page_lo")], *[F.max(c).alias(c) for c in ("hi", "page_hi")],
                                                    F.bool_or("plain").alias("plain"))
    return said.filter("page_lo < page_hi").select("host", "kind", "path", F.expr("lo < hi and plain").alias("main"))


def _having(batches):
    """Of each batch: whether the shared blocks are at most ``MOST_CONSTANT``
    percent of a page's main text; path and text of the shared blocks."""
    import pyarrow as pa

    names, types = ["host", "kind", "page", "fits", "path", "text"], [pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
    size = lambda found: sum(len(text) for _, text in found)
    for batch in batches:
        out: dict[tuple, None] = {}
        for host, kind, html, page, shared in zip(*[c.to_pylist() for c in batch.columns]):
            found, shared = main_blocks(blocks(html), {}), set(shared)
            same = [x for x in found if block_hash(*x) in shared]
            out[host, kind, page, 100 * size(same) <= MOST_CONSTANT * size(found), None, None] = None
            out |= dict.fromkeys((host, kind, None, None, *x) for x in same)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names)


def template_constants(pages: DataFrame, shared: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, kind, constants): the ``shared`` blocks (hashes) of a host and
    kind, where they are a template's and not most of its pages."""
    from .scratch import written

    rows = _page_rows(pages, url_col, html_col).join(bounded_broadcast(shared, MAX_WRAPPERS), ["host", "kind"])
    having = written(rows.select("host", "kind", "html", "page", "shared").mapInArrow(
        _having, "host string, kind boolean, page long, fits boolean, path string, text string").distinct())
    fits = having.filter("page is not null").groupBy("host", "kind").agg(F.count("*").alias("total"), F.count_if("fits").alias("n")).filter(
        100 * F.col("n") >= SHARE * F.col("total")).select("host", "kind")
    found = having.filter("page is null").groupBy("host", "kind").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("constants"))
    return found.join(fits, ["host", "kind"])


def _extract(batches, names):
    import json

    import pyarrow as pa

    known: dict[str | None, tuple] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if wrapper not in known:
                if len(known) > 10_000:
                    known.clear()
                w = json.loads(wrapper) if wrapper else {}
                known[wrapper] = w.get("paths", {}), frozenset((x["path"], x["text"]) for x in w.get("constants", ()))
            texts.append(main_text(page, *known[wrapper]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    from .scratch import written

    wrappers = written(infer_wrappers(pages, url_col, html_col))
    slots = wrappers.select("host", "kind", F.explode("paths").alias("path"))
    paths = slots.join(judge_paths(pages, url_col, html_col), ["host", "kind", "path"]).groupBy("host", "kind").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "main"))).alias("paths"))
    known = wrappers.select("host", "kind", "constants").join(paths, ["host", "kind"], "left").select(
        F.col("host").alias("__host"), F.col("kind").alias("__kind"), F.to_json(F.struct("paths", "constants")).alias("wrapper"))
    known = written(known)
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))
    same = (host_of(F.col(url_col)) == F.col("__host")) & (has_element("__html") == F.col("__kind"))
    joined = rows.join(bounded_broadcast(known, MAX_WRAPPERS), same, "left").select(id_col, url_col, "__html", "wrapper")
    names = [id_col, url_col, "text", "n_chars"]
    schema = T.StructType([joined.schema[id_col], joined.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(lambda it: _extract(it, names), schema)
