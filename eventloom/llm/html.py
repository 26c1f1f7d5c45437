"""Main text of pages by paths that the pages of a host agree on.

Every page scores its containers by the prose they hold. Spark adds the scores up by host and
generalised path (tags and classes from the root) and the best path of each host wins. From there
the host's path climbs over whatever adds only headings and paragraphs that do not repeat from page
to page, and each page is read again below it; a page without that path uses its own best container.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import small_side
from eventloom.llm.registry import query
from eventloom.session import cut_lineage

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = frozenset("script style textarea iframe title".split())
DROPPED = frozenset("nav header footer aside form button select menu dialog head svg noscript template".split())
VOID = frozenset("br img hr input meta link source wbr area base col embed track param".split())
CONTAINERS = frozenset("article main section div body td".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption table tr td th hr address".split()) \
    | CONTAINERS
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph, and for other elements with optional end tags: what is ended, and what shields it.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main menu nav ol p pre section table ul".split())
_TABLE = frozenset("table td th caption button template".split())
ENDS = {"li": (("li",), _TABLE | {"ul", "ol", "menu"}), "dt": (("dt", "dd"), _TABLE | {"dl"}), "dd": (("dt", "dd"), _TABLE | {"dl"}),
        "td": (("td", "th"), frozenset({"table", "tr"})), "th": (("td", "th"), frozenset({"table", "tr"})), "tr": (("tr",), frozenset({"table"}))}
_BOILER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|promo\w*|sponsor\w*|sidebar|cookies?|notice|banner|consent|menu|nav\w*|"
                     r"breadcrumbs?|footer|header|comments?|share|social|related|newsletter|subscribe|widget)(?:$|[\s_-])", re.I)
#: Tokens such as with-sidebar or has-comments say what stands beside an element, not what it is.
_MODIFIER = re.compile(r"(?:^|[_-])(?:with|without|no|not|has|have)[_-]", re.I)
#: An article whose whole token says so is a comment or a teaser, not the article of the page.
_TEASER = re.compile(r"(?:^|\s)(?:comments?|comment[_-]\w+|related[\w-]*|ads?|advert\w*|promo\w*|sponsor\w*)(?:$|\s)", re.I)
_SURE = re.compile(_TEASER.pattern[:-len(r")(?:$|\s)")] + r"|cookie[\w-]*|consent|newsletter|subscribe|share|social|sidebar|nav\w*|menu)(?:$|\s)", re.I)
_SELF = re.compile(r"(?:^|[\s\"'])/$")
#: A host's pages outvote blocks that only one page in so many has.
ODD = 100
_SPACE = re.compile(r"\s+")


def _marked(name: str, marks: str) -> bool:
    """Whether class, id and role call an element boilerplate."""
    if not marks or name in ("body", "html"):
        return False
    if name in ("article", "main"):
        return bool(_TEASER.search(marks))
    return bool(_BOILER.search(" ".join(t for t in marks.split() if not _MODIFIER.search(t))))


def _scan(page: str) -> list[tuple[str, str, bool]]:
    """``(path of containers, block text, whether heading or paragraph)`` in page order, boilerplate left out.

    An element that only its class, id or role (or being a form) makes boilerplate is read all the same if it
    holds every article and main of the page, or most of the text of a page without any (nearly all, where a whole
    class name such as ``comments`` or ``cookie-banner`` leaves little doubt).
    """
    spared: set[int] = set()
    while True:
        blocks, more = _pass(page, spared)
        if not more:
            return blocks
        spared |= more


def _pass(page: str, spared: set[int]) -> tuple[list[tuple[str, str, bool]], set[int]]:
    """The blocks of the page with the elements at the offsets ``spared`` kept, and further elements to spare."""
    blocks, buffer, stack, at, skip = [], [], [], 0, 0
    path, held, prose, mains = [""], [], 0, 0
    opened: dict[str, int] = {}

    def flush() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            inner = next((s[0] for s in reversed(stack) if s[0] in BLOCKS), "")
            blocks.append((path[-1], text, inner in PROSE))

    def close(depth: int) -> None:
        nonlocal skip
        if not skip and any(s[0] in BLOCKS for s in stack[depth:]):
            flush()
        while len(stack) > depth:
            name, boiler, container, start = stack.pop()
            opened[name] -= 1
            skip -= boiler
            if container:
                path.pop()
            if start:
                held.append((prose - start[0], mains - start[1], *start[2:]))

    def imply(ended: tuple[str, ...], shields: frozenset[str]) -> None:
        if not any(opened.get(e) for e in ended):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ended:
                return close(i)
            if stack[i][0] in shields:
                return None

    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        # text below an element that is dropped by its name is no prose of the page
        if not skip or not any(s[1] and not s[3] for s in stack):
            prose += len(text.strip())
        if not skip:
            buffer.append(text)
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS and not skip:
                flush()
            if opened.get(name):
                close(max(i for i, s in enumerate(stack) if s[0] == name))
            continue
        if name in RAW:
            if _SELF.search(m[3]):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            # without an end tag code takes the rest of the page, other raw text ends at the next tag
            rest = len(page) if name in ("script", "style") else page.find("<", at)
            at = end.end() if end else rest if rest >= 0 else len(page)
            continue
        if name in BLOCKS and not skip:
            flush()
        if name in ENDS_P:
            imply(("p",), _TABLE)
        if name in ENDS:
            imply(*ENDS[name])
        if name == "br":
            if not skip:
                buffer.append(" ")
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        attrs = _ATTR.findall(m[3])
        marks = " ".join(v for a in attrs for v in a[1:] if v)
        marked = _marked(name, marks)
        by_name = name in DROPPED and name != "form"
        boiler = by_name or (marked or name == "form") and m.start() not in spared
        container = name in CONTAINERS
        if container:
            cls = next((v for a in attrs if a[0].lower() == "class" for v in a[1:] if v), "")
            path.append(path[-1] + "/" + name + "".join("." + re.sub(r"\d+", "0", c) for c in sorted(cls.split())))
        if boiler and not skip:
            flush()
        # what can be spared: where it starts, and the text and articles before it
        start = (prose, mains, m.start(), name, bool(_SURE.search(marks))) if boiler and not by_name else None
        mains += name in ("article", "main")
        stack.append((name, int(boiler), container, start))
        opened[name] = opened.get(name, 0) + 1
        skip += boiler
    close(0)
    if not skip:
        flush()
    more = {k for inside, articles, k, name, sure in held if inside and (
        articles == mains if mains and not (name == "article" and mains > 1) else inside > prose * (0.9 if sure else 0.5))}
    return blocks, more


def _scores(blocks: list[tuple[str, str, bool]]) -> dict[str, float]:
    """Prose below each container path; deeper paths are worth more than what merely wraps them."""
    score: dict[str, float] = {}
    for path, text, _ in blocks:
        depth, part = path.count("/"), path
        while part:
            back = depth - part.count("/")
            gain = len(text) * (0.9 ** back) * (1.5 if part.rpartition("/")[2].startswith(("article", "main")) else 1.0)
            score[part] = score.get(part, 0.0) + gain
            part = part.rpartition("/")[0]
    return score


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def _around(blocks: list[tuple[str, str, bool]], best: str) -> set[tuple[str, int | None]]:
    """What lies outside ``best``: the nearest path above both and the block's text code, None if no heading or paragraph."""
    found = set()
    for path, text, prose in blocks:
        if not _under(path, best):
            top = best
            while not _under(path, top):
                top = top.rpartition("/")[0]
            found.add((top, _code(text) if prose else None))
    return found


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``: the main text, blocks joined by an empty line; empty for null or textless html.

    The host is what stands between ``://`` and the next slash; a null url is a host of its own. Votes are added up
    on the map side, so a hot host is no hot task; winners are broadcast only behind a count.
    """
    hosted = pages.drop("text").withColumn("__host", F.coalesce(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("")))

    def vote(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            total: dict[tuple, list[int]] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks = _scan(page) if page else []
                s = _scores(blocks)
                if s:
                    best = max(s, key=lambda p: (s[p], p))
                    main = _code("\n".join(t for p, t, _ in blocks if _under(p, best)))
                    for above, code in [(None, None), *_around(blocks, best)]:
                        row = total.setdefault((host, best, above, code), [0, main, main])
                        row[0] += 1
                        row[1], row[2] = min(row[1], main), max(row[2], main)
            columns = [*zip(*total)] or [()] * 4, [*zip(*total.values())] or [()] * 3
            kinds = [pa.string()] * 3 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip([*columns[0], *columns[1]], kinds)],
                                             ["__host", "path", "above", "code", "votes", "lo", "hi"])

    seen = hosted.select("__host", "html").mapInArrow(vote, "__host string, path string, above string, code long, votes long, lo long, hi long")
    seen = cut_lineage(seen.groupBy("__host", "path", "above", "code").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    best = cut_lineage(seen.where("above is null").groupBy("__host").agg(F.max(F.struct("votes", "path")).alias("w"))
                       .select("__host", F.col("w.path").alias("path"), F.col("w.votes").alias("pages")))
    # other blocks on more than a hundredth of the pages, or one text on most of several, stop the climb
    other = F.sum(F.when(F.col("code").isNull(), F.col("votes"))) * ODD > F.max("pages")
    again = F.max(F.col("code").isNotNull() & (F.col("votes") * 2 > F.col("pages")) & (F.col("lo") < F.col("hi")))
    levels = seen.where("above is not null").join(small_side(best), ["__host", "path"]).groupBy("__host", "above").agg(
        (F.coalesce(other, F.lit(False)) | again).alias("stop"))
    upward = Window.partitionBy("__host").orderBy(F.length("above").desc())
    tops = (levels.withColumn("stopped", F.max("stop").over(upward)).where(~F.col("stopped")).groupBy("__host")
            .agg(F.min_by("above", F.length("above")).alias("__top")))
    winners = cut_lineage(best.join(tops, "__host", "left").select("__host", F.col("path").alias("__path"), F.coalesce("__top", "path").alias("__top")))
    joined = hosted.join(small_side(winners), "__host", "left").drop("__host")

    def read(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            names = b.schema.names
            out = []
            for page, path, top in zip(*(b.column(names.index(n)).to_pylist() for n in ("html", "__path", "__top"))):
                blocks = _scan(page) if page else []
                if blocks and (path is None or not any(_under(p, path) for p, _, _ in blocks)):
                    s = _scores(blocks)
                    top = max(s, key=lambda p: (s[p], p)) if s else ""
                out.append("\n\n".join(t for p, t, _ in blocks if _under(p, top)))
            keep = [i for i, n in enumerate(names) if n not in ("__path", "__top")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out, pa.string())],
                                             [*[names[i] for i in keep], "text"])

    from pyspark.sql import types as T
    schema = T.StructType([*joined.drop("__path", "__top").schema.fields, T.StructField("text", T.StringType())])
    return joined.mapInArrow(read, schema)


@query("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
