"""Operator 1, HTML extraction by site template removal.

Every element subtree is hashed, the hashes are counted per host over all
pages of different texts, and subtrees that recur across many of these are
deleted, unless they hold nearly all of what a page says. Furniture whose words
change from page to page is counted by its shape, over all hosts: what the markup
calls navigation, footer, advert and the like is template once its shape recurs.

On hosts of too few different pages to count, the markup alone decides: what
it calls furniture goes, and where it marks an article only that is kept. An
article also shelters its paragraphs on any host, for texts shared by copies of
an article recur and are content still; inside it go what the markup calls
furniture and recurring subtrees of mostly links.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandlake.llm.common import cut, map_arrow, packed
from strandlake.llm.html_tree import BLOCK, UNSEEN, Element, blocks, measure, parse

#: A subtree is template when it is on this many pages of a host, and on this share of them or on MANY_PAGES;
#: pages of one text count once, except for link lists.
MIN_PAGES = 3
MIN_SHARE = 0.1
MANY_PAGES = 100
#: A shape that the markup calls furniture is template when it is on this many pages of all hosts together; hosts of fewer than MIN_PAGES aren't counted.
SHAPE_PAGES = 3
#: Template digests that a broadcast may hold, and pages of a host in one part of a join beyond that.
BROADCAST_DIGESTS = 1_000_000
PAGES_A_PART = 2000
#: A subtree with this share of a page's text outside links and furniture isn't deleted.
NEARLY_ALL = 0.9

# Elements and class, id or role words of page furniture.
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu input label".split())
FURNITURE_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|gdpr|"
    r"masthead|menu|nav|navbar|navigation|newsletter|notices?|notification|pagination|popup|promo\w*|related|replies|"
    r"search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])"
)


def host_of(url: str) -> Column:
    """Lower-case host of a URL column; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def is_furniture(e: Element, in_article: bool) -> bool:
    if e.tag in FURNITURE_TAGS:
        return True
    if e.tag == "header" and not in_article:
        return True
    return bool(e.marks and FURNITURE_MARKS.search(e.marks))


def article_of(root: Element) -> list[Element]:
    """Outermost article elements outside furniture, else main elements, else none."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    work = [root]
    while work:
        e = work.pop()
        kind = "article" if e.tag == "article" else "main" if e.tag == "main" or e.marks.strip() == "main" else None
        if e.hidden or e.tag in UNSEEN or is_furniture(e, False) and kind is None or e.marks and FURNITURE_MARKS.search(e.marks):
            continue
        if kind:
            found[kind].append(e)
        if kind != "article":
            work.extend(c for c in reversed(e.children) if c.__class__ is Element)
    return found["article"] or found["main"]


def stored(e: Element) -> int:
    """The digest of a subtree as it is counted: even, and negative for link lists."""
    d = e.digest & ~1
    return ~d if e.linked * 2 > e.chars else d


def stored_shape(e: Element) -> int:
    """The shape of an element that the markup calls furniture, as it is counted: odd."""
    return e.shape | 1


def sheltered(root: Element) -> tuple[set[int], set[int]]:
    """The ``id`` of the page's article elements, and of all elements that hold one."""
    articles = {id(a) for a in article_of(root)}
    holders: set[int] = set()
    work = [(root, False)] if articles else []
    while work:
        e, ready = work.pop()
        own = [c for c in e.children if c.__class__ is Element]
        if ready:
            if any(id(c) in articles or id(c) in holders for c in own):
                holders.add(id(e))
        elif id(e) not in articles:
            work.append((e, True))
            work.extend((c, False) for c in own)
    return articles, holders


def subtree_digests(page: str | None) -> tuple[int, set[int]]:
    """Digest of a page's text, and stored digests of its element subtrees that hold text and of its furniture's shapes."""
    root = parse(page or "")
    measure(root)
    articles, _ = sheltered(root)
    seen, work = set(), [(root, False)]
    while work:
        e, inside = work.pop()
        for c in e.children:
            if c.__class__ is Element and c.chars:
                within = inside or id(c) in articles
                seen.add(stored(c))
                if not within and is_furniture(c, False):
                    seen.add(stored_shape(c))
                work.append((c, within))
    text = "\n".join(blocks(root, lambda e: False))
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1, seen


def plain_chars(root: Element) -> dict[int, int]:
    """Characters of every element by its ``id``, without links and furniture."""
    plain: dict[int, int] = {}
    work = [(root, False)]
    while work:
        e, ready = work.pop()
        if e.tag == "a" or e.hidden or e.tag in UNSEEN or is_furniture(e, False):
            plain[id(e)] = 0
        elif ready:
            plain[id(e)] = sum(plain[id(c)] if c.__class__ is Element else len(" ".join(c.split())) for c in e.children)
        else:
            work.append((e, True))
            work.extend((c, False) for c in e.children if c.__class__ is Element)
    return plain


def main_text(page: str | None, template: frozenset[int] | set[int], counted: bool = False) -> tuple[str, int]:
    """Main text of a page, and how many template subtrees were deleted outside and inside the article.

    ``template`` holds stored digests; for a ``counted`` host it also holds the
    shapes of its furniture and decides alone what goes outside the article.
    """
    root = parse(page or "")
    measure(root)
    articles, holders = sheltered(root)
    plain = {} if articles else plain_chars(root)
    nearly_all = max(1, NEARLY_ALL * plain.get(id(root), 0))
    deleted, work = 0, [(root, False)]
    while work:
        n, within = work.pop()
        kept = []
        for c in n.children:
            if c.__class__ is Element:
                inside = within or id(c) in articles
                recurs, links = c.chars and (stored(c) in template), c.linked * 2 > c.chars
                if inside:
                    goes = within and recurs and links
                else:
                    if recurs and plain.get(id(c), 0) >= nearly_all:
                        # Copies of a whole page make no template of it.
                        work.append((c, True))
                        kept.append(c)
                        continue
                    furniture = counted and c.chars and stored_shape(c) in template and is_furniture(c, False)
                    goes = (recurs or furniture) and id(c) not in holders
                if goes:
                    deleted += 1
                    kept.append("\n" if c.tag not in BLOCK else Element("hr"))
                    continue
                work.append((c, inside))
            kept.append(c)
        n.children = kept
    if articles and not counted:
        texts = [t for a in _in_order(root, articles) for t in blocks(a, lambda e: is_furniture(e, True))]
    elif counted:
        within = {id(e) for a in _in_order(root, articles) for e in _below(a)}
        texts = blocks(root, lambda e: id(e) in within and is_furniture(e, True))
    else:
        texts = blocks(root, lambda e: is_furniture(e, False))
    return "\n".join(texts), deleted


def _below(e: Element) -> list[Element]:
    found, work = [], [e]
    while work:
        own = [c for c in work.pop().children if c.__class__ is Element]
        found += own
        work += own
    return found


def _in_order(root: Element, wanted: set[int]) -> list[Element]:
    """The elements below ``root`` whose ``id`` is in ``wanted``, in page order."""
    found, work = [], [root]
    while work:
        e = work.pop()
        if id(e) in wanted:
            found.append(e)
        else:
            work.extend(c for c in reversed(e.children) if c.__class__ is Element)
    return found


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, digest): the template of each host with at least MIN_PAGES different pages; a null digest marks it as counted.

    Subtrees on at least MIN_PAGES pages and MIN_SHARE of the pages of their host,
    or on MANY_PAGES, and shapes of furniture on SHAPE_PAGES of any hosts. Pages of one text
    count once, so that copies of a page aren't taken for its template; for link
    lists each counts. Only digests are shuffled, summed where they arise.
    """
    rows = with_digests(packed(pages).select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")), keep_html=False)
    rows = cut(rows)
    d = F.col("digest")
    links, shape = d < 0, (d >= 0) & (d.bitwiseAND(F.lit(1)) == 1)
    each = rows.select("host", "page", F.explode("own").alias("digest")).groupBy("host", "page", "digest").agg(F.count("*").alias("copies"))
    n = F.sum(F.when(links, F.col("copies")).otherwise(1)).alias("n")
    seen = each.where(~shape).groupBy("host", "digest").agg(n).where(F.col("n") >= MIN_PAGES)
    sizes = rows.groupBy("host", "page").agg(F.count("*").alias("copies")).groupBy("host").agg(F.count("*").alias("texts"), F.sum("copies").alias("pages"))
    share = F.when(links, F.col("pages")).otherwise(F.col("texts")) * MIN_SHARE
    often = seen.join(sizes, "host").where(F.col("n") >= F.least(share, F.lit(MANY_PAGES))).select("host", "digest")
    shapes = each.where(shape).groupBy("host", "digest").agg(F.count("*").alias("n"))
    anywhere = shapes.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= SHAPE_PAGES).select("digest")
    counted = sizes.where(F.col("texts") >= MIN_PAGES).select("host", F.lit(None).cast("long").alias("digest"))
    furniture = shapes.select("host", "digest").join(anywhere, "digest").join(counted.select("host"), "host").select("host", "digest")
    return often.unionByName(furniture).unionByName(counted)


def with_digests(rows: DataFrame, keep_html: bool) -> DataFrame:
    """``rows`` with ``page``, the digest of the text of ``html``, and ``own``, the sorted digests of its subtrees."""
    names = [c for c in rows.columns if keep_html or c != "html"]
    at = rows.columns.index("html")

    def run(batches):
        for b in batches:
            found = [subtree_digests(x.as_py()) for x in b.column(at)]
            kept = [b.column(rows_at[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.int64()), pa.array([sorted(x) for _, x in found], pa.list_(pa.int64()))], [*names, "page", "own"])

    rows_at = {c: k for k, c in enumerate(rows.columns)}
    schema = StructType([*(rows.schema[c] for c in names), StructField("page", LongType()), StructField("own", ArrayType(LongType()))])
    return map_arrow(rows, run, schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """One row (page_id, url, text, n_chars, n_template) per row of ``pages``.

    text holds the page's blocks joined by line feeds without its host's
    template, '' where there are none or html is null; a null url counts as host
    ''. Repeated rows come out as often as they come in; no rows give none.
    Counting runs when this is called. Pages aren't shuffled while the templates
    are few enough to be broadcast; more of them are joined, with the pages of a
    large host dealt over many parts.
    """
    found = cut(templates(pages, url_col, html_col))
    rows = packed(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    known = None
    if found.count() <= broadcast_digests:
        known = pages.sparkSession.sparkContext.broadcast(_by_host(found))
        rows = rows.withColumn("digests", F.lit(None).cast("array<long>")).withColumn("counted", F.lit(None).cast("boolean"))
    else:
        of_host = found.groupBy("host").agg(F.collect_list("digest").alias("digests"), F.max(F.col("digest").isNull()).alias("counted"))
        parts = rows.groupBy("host").agg(F.ceil(F.count("*") / PAGES_A_PART).cast("int").alias("parts"))
        dealt = of_host.join(parts, "host").select("host", "digests", "counted", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        own = rows.join(F.broadcast(parts.where("parts > 1")), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        rows = own.join(dealt.drop("parts"), ["host", "part"], "left")

    def run(batches):
        for b in batches:
            texts, cuts = [], []
            for page, host, digests, counted in zip(b.column(2), b.column(3), b.column(4), b.column(5)):
                if known is not None:
                    template, is_counted = known.value.get(host.as_py(), (frozenset(), False))
                else:
                    template, is_counted = set(digests.as_py() or ()), bool(counted.as_py())
                text, n = main_text(page.as_py(), template, is_counted)
                texts.append(text.encode("utf-8", "replace").decode())
                cuts.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(cuts, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    whole = rows.select("page_id", "url", "html", "host", "digests", "counted")
    return map_arrow(whole, run, "page_id long, url string, text string, n_chars long, n_template long")


def _by_host(found: DataFrame) -> dict[str, tuple[frozenset[int], bool]]:
    """The template of each host and whether it was counted; ``found`` is of a checked size."""
    of_host: dict[str, set] = {}
    for r in found.collect():
        of_host.setdefault(r.host, set()).add(r.digest)
    return {h: (frozenset(d - {None}), None in d) for h, d in of_host.items()}
