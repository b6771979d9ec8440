"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its tags, told apart by the path of tags they stand in, and its text blocks.  Tokens of a host
that occur equally often on each of its pages have the same occurrence vector and form a class; vectors are compared by
a sum of hashes over (page, count), so no task holds a host.  Classes that are large enough and on most of the host's
pages make its template, a set of tokens.  Tags and their names choose the part of a page that is looked at (an article,
or all that isn't in menus, headers, footers, forms and so on); in it, what belongs to the template is left out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import annotate, durable, mixed, pieces, quoted, small, table, texts_of
from foliomill.llm.words import hashes

# A class is part of a host's template if it has as many tokens, on as many pages, and on this share of them.
MIN_TOKENS, MIN_PAGES, SHARE = 3, 4, 0.6

# Names of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|select|title"
BLOCKS = set(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 header hgroup hr li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = set("base basefont bgsound link meta head".split())
BOILERPLATE = set("head nav aside footer form button dialog menu label select fieldset".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "head", "body"}
# Words of class, id and role that name boilerplate, and words that say no more beside them.  A name counts
# if all its parts are such words and one is of the first kind: "cookie-notice" does, "social-science" doesn't.
NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets footer foot masthead topbar toolbar banner ad ads advert adverts "
    "advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social related recommend recommended recommendations comment comments respond "
    "replies reply discussion disqus pagination pager tags legal copyright disclaimer complementary contentinfo hidden".split()
)
BESIDE = set(
    "area bar block body box button buttons col column container content footer form global group header holder icons id inner is item items js left links list "
    "main media outer page panel post posts primary region right row secondary section site slot text thread top bottom unit wrap wrapper".split()
)
HEADERS = {"header", "head", "sitetitle", "logo", "branding"}
# Whole names of the part that holds an article.
MAIN = set(
    "article articlebody article-body article-content main main-content maincontent story story-body post post-body post-content entry entry-content content "
    "page-content".split()
)
_parts = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[^\W\d_]+").findall

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + RAW + r")\b(?P<rawend>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_attribute = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Frame:
    """A tag on the way to a text.  ``path`` is a hash of the tags around it.  ``hard``: boilerplate by its tag or hidden, which
    nothing overrules, as against a wrapper's name or a form; ``main``: in an article or main element; ``named``: in a part
    that is called like one; ``saved``: in an article or main part that only such wrappers make boilerplate."""

    __slots__ = ("boilerplate", "hard", "inner", "main", "name", "named", "path", "saved")

    def __init__(self, name: str, path: str, boilerplate: bool, main: bool, hard: bool = False, saved: bool = False, named: bool = False):
        self.name, self.path, self.boilerplate, self.main, self.hard, self.saved, self.named = name, path, boilerplate, main, hard, saved, named
        # Frames of the tags met in this one, as equal tags in one place have equal frames.
        self.inner: dict[tuple[str, str], Frame] | None = None


@lru_cache(1 << 14)
def told_by(name: str) -> tuple[bool, bool]:
    """Whether one name of a class, id or role tells boilerplate, and whether a site's header."""
    parts = [p.lower() for p in _parts(name)]
    alone = all(p in NAMES or p in BESIDE for p in parts)
    header = parts == ["site", "title"] or not HEADERS.isdisjoint(parts) and all(p in HEADERS or p in BESIDE for p in parts)
    return alone and any(p in NAMES for p in parts), header


@lru_cache(1 << 14)
def path_of(outer: str, name: str, names: str) -> str:
    return hashlib.blake2b(f"{outer}/{name} {names}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def frame(name: str, attributes: str, outer: Frame) -> Frame:
    known = outer.inner and outer.inner.get((name, attributes))
    if known:
        return known
    made = new_frame(name, attributes, outer)
    if outer.inner is None:
        outer.inner = {}
    outer.inner[name, attributes] = made
    return made


def new_frame(name: str, attributes: str, outer: Frame) -> Frame:
    names, hidden = [], False
    if attributes:
        for key, *value in _attribute.findall(attributes):
            key, value = key.lower(), "".join(value)
            if key in ("class", "id", "role"):
                names += value.split()
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower()
    told = [told_by(n) for n in names]
    # A page's own name (of its body) tells nothing of its parts.
    whole = name in ("html", "body")
    main = name in ("article", "main")
    called = not whole and not main and name in BLOCKS and any(n.lower().replace("_", "-") in MAIN for n in names)
    # A header of the article, or its section, is not the site's.
    head = name == "header" or any(h for _, h in told)
    spared = whole or name == "main" or name == "article" and not any("comment" in n.lower() for n in names)
    bad = not spared and not called and (name in BOILERPLATE or hidden or head and not (outer.main or outer.named) or any(b for b, _ in told))
    bad |= hidden and not whole
    hard = outer.hard or hidden or bad and name in BOILERPLATE - {"form", "fieldset"}
    saved = not hard and (outer.saved and not bad or spared and main)
    path = path_of(outer.path, name, " ".join(names))
    return Frame(name, path, outer.boilerplate or bad, outer.main or main and not bad, hard, saved, outer.named or called and not bad)


def parsed(page: str) -> tuple[list[tuple[Frame, str]], list[str]]:
    """Text blocks with their frames, in page order, and the paths of all tags."""
    root = Frame("", "", False, False)
    stack, blocks, paths, parts, owner = [root], [], [], [], root
    # How often a name is open, and where in the stack the open blocks are: a page of very many open tags costs no
    # search for what isn't there.
    opened, block_at = defaultdict(int), []

    def flush() -> None:
        nonlocal owner
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((owner, text))
            parts.clear()

    def leave_head() -> None:
        # The end of the head may be left out.
        if opened["head"]:
            close(next(i for i in reversed(block_at) if stack[i].name == "head"))

    def add(text: str) -> None:
        nonlocal owner
        if text.strip():
            leave_head()
        if parts and stack[-1].boilerplate != owner.boilerplate and text.strip():
            flush()
        if not parts:
            owner = stack[-1]
        parts.append(text)

    def drop(at: int) -> None:
        for f in stack[at:]:
            opened[f.name] -= 1
        del stack[at:]
        while block_at and block_at[-1] >= at:
            block_at.pop()

    def close(at: int) -> None:
        if block_at and block_at[-1] >= at:
            flush()
        drop(at)

    def innermost(name: str) -> int:
        """Where ``name`` was opened last; of something inline only behind the last block, as a stray end of it doesn't end
        blocks around it.  0: nowhere."""
        if not opened[name]:
            return 0
        if name in BLOCKS:
            return next((i for i in reversed(block_at) if stack[i].name == name), 0)
        last = block_at[-1] if block_at else 0
        return next((i for i in range(len(stack) - 1, last, -1) if stack[i].name == name), 0)

    at = 0
    for found in _token.finditer(page):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            if found["raw"]:
                paths.append(f"{stack[-1].path}/{found['raw'].lower()}")
                if found["raw"].lower() in ("select", "textarea", "title"):
                    flush()
            continue
        if found["close"]:
            if place := innermost(name):
                close(place)
            elif name == "p" or name in BLOCKS:
                flush()
            continue
        if name not in IN_HEAD:
            leave_head()
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
            # A block ends an open paragraph, an item or cell its elder.
            barrier = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}
            ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(name, ())
            if name in ENDS_PARAGRAPH:
                ends = (*ends, "p")
            stop = {*barrier.get(name, ()), "div", "article", "section", "main", "aside", "nav", "footer", "header", "table", "form", "body"} - {*ends}
            if any(opened[e] for e in ends):
                for i in reversed(block_at):
                    if stack[i].name in stop:
                        break
                    if stack[i].name in ends:
                        drop(i)
                        break
        new = frame(name, found["attributes"] or "", stack[-1])
        paths.append(new.path)
        if name not in VOID and not (found["attributes"] or "").endswith("/"):
            if name in BLOCKS:
                block_at.append(len(stack))
            opened[name] += 1
            stack.append(new)
        elif name == "hr":
            flush()
    if at < len(page):
        add(page[at:])
    flush()
    return blocks, paths


def parts_of(blocks: list[tuple[Frame, str]]) -> tuple[list[tuple[Frame, str]], bool]:
    """The blocks that a page's text is chosen from, and whether an article or main part frames them.

    Boilerplate is left out.  An article or main element frames a page's text.  A part that is only called like one does if
    it holds most of what stands outside boilerplate.  A wrapper's name doesn't hold against an article or main part in it
    that is longer than all that stands outside boilerplate, nor where nothing does.
    """
    outside = [(f, t) for f, t in blocks if not f.boilerplate]
    framed = [(f, t) for f, t in outside if f.main]
    if framed:
        return framed, True
    length = lambda chosen: sum(len(t) for _, t in chosen)
    saved = [(f, t) for f, t in blocks if f.saved]
    if length(saved) > length(outside):
        return saved, True
    named = [(f, t) for f, t in outside if f.named]
    if 2 * length(named) > length(outside):
        return named, True
    return outside or [(f, t) for f, t in blocks if not f.hard], False


def token_hashes(tokens: list[str]) -> np.ndarray:
    data = [t.encode("utf-8", "surrogatepass") or b"\0" for t in tokens]
    return hashes(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64)) if data else np.zeros(0, np.uint64)


def tokens_of(blocks: list[tuple[Frame, str]], paths: list[str]) -> Counter:
    return Counter([*paths, *(f"{f.path}\n{t}" for f, t in blocks)])


# Rows with one vote for several are weighed in the field of integers modulo this prime.
PRIME = 2**61 - 1
# Rows (of 16 bytes) that are broadcast to tell which pages have no vote of their own.
BROADCAST_ROWS = 1_000_000


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its host, number, and a hash of the text it is chosen from."""
    for batch in pieces(batches, 4 << 20):
        texts = ("\n".join(t for _, t in parts_of(parsed(page)[0])[0]) for page in texts_of(batch.column(1)))
        told = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.int64()), batch.column(2)], names=["host", "content", "number"])


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice, host and token: votes of the pages it is on, and the sum of hashes that stands for its occurrence vector.

    Each of ``rows`` equal rows has the vote 1 / ``rows``, modulo ``PRIME``, so together they have one.
    """
    for batch in pieces(batches, 4 << 20):
        sums: dict[tuple[str, int], list[int]] = {}
        ids = mixed(batch.column(2).to_numpy().view(np.uint64))
        for host, page, seed, rows in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), ids, batch.column(3).to_pylist()):
            counted = tokens_of(*parsed(page))
            names = token_hashes(list(counted)).view(np.int64).tolist()
            marks = mixed(np.array(list(counted.values()), np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed) >> np.uint64(24)
            vote = pow(rows, -1, PRIME)
            for name, mark in zip(names, marks.tolist()):
                both = sums.setdefault((host, name), [0, 0])
                both[0] += vote
                both[1] += mark * vote % PRIME
        hosts, names = zip(*sums) if sums else ((), ())
        many, marks = zip(*sums.values()) if sums else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(many, pa.decimal128(38, 0)), pa.array(marks, pa.decimal128(38, 0))],
            names=["host", "token", "pages", "vector"],
        )


def templates(pages: DataFrame) -> DataFrame:
    """Per host the tokens of its template; ``pages`` has ``host``, ``html`` and ``number`` (a hash of the row).

    Pages of a host with the same content have one vote, so that an article in many copies doesn't become a template.
    """
    told = pages.select("host", "html", "number").mapInArrow(contents, "host string, content bigint, number bigint")
    told = durable(told.groupBy("host", "content", "number").agg(F.count("*").alias("rows")))
    voters = durable(told.groupBy("host", "content").agg(F.min("number").alias("voter")))
    hosts = voters.groupBy("host").agg(F.count("*").alias("all_pages")).where(F.col("all_pages") >= MIN_PAGES)
    odd = told.join(voters, ["host", "content"]).select("number", F.when(F.col("number") == F.col("voter"), F.col("rows")).otherwise(0).alias("rows"))
    odd = small(durable(odd.where("rows <> 1").groupBy("number").agg(F.max("rows").alias("rows"))), BROADCAST_ROWS)
    found = pages.join(odd, "number", "left").select("host", "html", "number", F.coalesce("rows", F.lit(1)).alias("rows")).where("rows > 0")
    found = found.mapInArrow(occurrences, "host string, token bigint, pages decimal(38,0), vector decimal(38,0)")
    found = found.groupBy("host", "token").agg(*((F.sum(c) % F.lit(PRIME).cast("decimal(20,0)")).alias(c) for c in ("pages", "vector")))
    tokens = durable(found.where(F.col("pages") >= MIN_PAGES).withColumn("pages", F.col("pages").cast("bigint")))
    classes = tokens.groupBy("host", "pages", "vector").agg(F.count("*").alias("size"), F.collect_set("token").alias("tokens"))
    kept = classes.where(F.col("size") >= MIN_TOKENS).join(hosts, "host").where(F.col("pages") >= F.col("all_pages") * SHARE)
    return kept.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def main_text(pages: DataFrame, payload: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text`` (blocks joined by line ends, empty if there is none) and ``n_chars`` (code points).

    The text is what stands outside boilerplate and the host's template, in the article or main part where a page has one.
    An article keeps what the template has of it if that is more than half of its characters.  Null pages are empty; pages
    without a url have an empty host.  Rows that repeat are rows of their own.  A page's memory grows with its length, whatever
    the depth of its tags.
    """
    host = F.coalesce(F.lower(F.regexp_extract(quoted(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(host.alias("host"), quoted(payload).alias("html"), F.xxhash64(quoted(url), quoted(payload)).alias("number"))
    known = durable(templates(rows))
    kept = pages.columns if keep is None else keep
    # Under names of their own, as a page may have columns of any name.
    joined = pages.select(*(quoted(c).alias(f"given_{c}") for c in kept), quoted(payload).alias("_html"), host.alias("_host"))
    joined = joined.join(known.select(F.col("host").alias("_host"), F.col("template").alias("_template")), "_host", "left")

    def start():
        def work(documents: pa.Array, template: pa.Array) -> list[pa.Array]:
            out, last, known = [], None, set()
            for page, tokens in zip(texts_of(documents), template):
                blocks, _ = parsed(page)
                rest, framed = parts_of(blocks)
                if tokens is not last:
                    last, known = tokens, set(tokens.as_py() or ())
                names = token_hashes([f"{f.path}\n{t}" for f, t in rest]).view(np.int64).tolist() if known else [0] * len(rest)
                article = [t for (_, t), n in zip(rest, names) if n not in known]
                # An article of which the template would take most is one of many near copies.
                if framed and 2 * sum(map(len, article)) < sum(len(t) for _, t in rest):
                    article = [t for _, t in rest]
                out.append("\n".join(article))
            texts = pa.array(out, pa.string())
            return [texts, pc.utf8_length(texts).cast(pa.int64())]

        return work

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    done = annotate(joined, start, fields, ["_html", "_template"], [f"given_{c}" for c in kept])
    return done.select(*(quoted(f"given_{c}").alias(c) for c in kept if c.lower() not in ("text", "n_chars")), "text", "n_chars")


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"), keep=["page_id", "url"])
