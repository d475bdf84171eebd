"""Main text of web pages by template deduction.

Pages are read as tokens: text blocks' paths of elements, and the texts that stand
there. For every host, tokens are grouped by their occurrence vector over the
host's pages, kept as a commutative fingerprint so that it is summed on both sides
of a shuffle and no host's pages ever meet in one task. Pages of a host with equal
blocks (repeated rows, mirrors) count once. Tokens of equal vectors on ``SUPPORT`` or
more different pages, and on one page in ``RARE`` of the host, make an equivalence
class, if it holds a tag path or the page itself: so a host's classes have at most
``RARE`` times as many tokens as a page, however many pages it has.

On each page the host's classes are nested (``nested``): a class whose tokens don't
come in one order, repeated whole, or whose tuples cross those of a class of more
pages, isn't valid there. Texts of valid classes are template; what remains are slots.
A host whose classes hold over three quarters of its pages' text has no template: its
pages are one article with a line that varies, not many articles. Of a page's slots,
those in article elements are taken, or those in main elements (all slots, if no slot is
in one) if they are over twice as much. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are left out before: by element, role, or
a class or id made of such words alone (``ad-banner``, but not ``ad-hoc``). The header
of an article stays if it holds a heading.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh, joined, partitions

SUPPORT, RARE = 3, 1000
#: Fixed values of HTML: elements without content, elements of raw text, elements that open a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements, roles and words of class or id that aren't main text.
DROPPED = frozenset("head script style textarea title xmp iframe noembed noframes noscript template nav header footer aside form button select option dialog menu object svg canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar footer header masthead cookie cookies consent gdpr notice notification popup modal overlay comment comments commentlist disqus respond share sharing social breadcrumb breadcrumbs related recommended newsletter subscribe subscription login signup search widget pagination pager skip".split()
)
#: Words that say nothing by themselves, beside those above in a class or id.
NEUTRAL = frozenset(
    "area bar block bottom box btn button buttons col container content form global group inner item items left link links list main page panel right section site slot sticky text thread top unit wrap wrapper".split()
)
START = re.compile(r"<(?:!--|/?[A-Za-z]|[!?])")
NAME_END, COMMENT_END, SPECIAL = re.compile(r"[\s/>]"), re.compile(r"--\s*>"), re.compile("""[>"']""")
TAIL = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
PART = re.compile(r"[a-z]{2,}")


class Tokens:
    """Tags, comments and declarations of a page, in time linear in its length whatever is left open in it."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.name = (0, -1)  # from where to where no name ends
        self.ends: tuple[list[int], list[int]] | None = None

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Start, end, whether it closes, element (None: a comment or declaration) and attributes of the next one."""
        s = self.source
        while m := START.search(s, at):
            start, said = m.start(), m.group()
            at = start + 1
            if said == "<!--":
                end = COMMENT_END.search(s, m.end())
                return start, end.end() if end else len(s), False, None, ""
            if start > self.last:
                continue
            if said[1] in "!?":
                return start, s.index(">", m.end()) + 1, False, None, ""
            name = self._name_end(m.end())
            end = self._tag_end(name)
            if end >= 0:
                return start, end + 1, said[1] == "/", s[m.end() - 1 : name], s[name:end]
        return None

    def _name_end(self, at: int) -> int:
        low, high = self.name
        if not low <= at <= high:
            m = NAME_END.search(self.source, at)
            self.name = (at, m.start() if m else len(self.source))
        return self.name[1]

    def _tag_end(self, at: int) -> int:
        """The next > that is in no quotes, -1 if there is none. Once one was looked for in vain, all are looked up in a table."""
        if self.ends is None:
            m = TAIL.match(self.source, at)
            if m:
                return m.end() - 1
            places = [m.start() for m in SPECIAL.finditer(self.source)]
            found, later = [-1] * (len(places) + 1), {}
            for k in range(len(places) - 1, -1, -1):
                c = self.source[places[k]]
                found[k] = places[k] if c == ">" else found[later[c] + 1] if c in later else -1
                later[c] = k
            self.ends = places, found
        places, found = self.ends
        return found[bisect_left(places, at)]


def _left_out(tag: str, attrs: str, named: bool = True) -> bool:
    if not named:
        return tag == "head" or tag in RAW
    if tag in DROPPED:
        return True
    if "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs):
            name = m.group(1).lower()
            value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
                parts = [set(PART.findall(name)) for name in value.split()]
                if any(p & WORDS and p <= WORDS | NEUTRAL for p in parts):
                    return True
            elif name in ("class", "id") and "comment" in value and tag == "article":
                return True
            elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
    return False


class Page:
    """Blocks of a page: (path, text, in an article, in a main element); left-out parts are not among them.

    ``named``: whether elements are left out by their names, roles and classes too, or only what is never shown.
    """

    def __init__(self, source: str, named: bool = True):
        self.blocks: list[tuple[str, str, bool, bool]] = []
        stack: list[tuple[str, bool]] = []  # element, whether it is left out
        headers: list[list] = []  # headers of articles that are open: depth, first block, whether a heading was met
        text: list[str] = []
        out = 0
        inside = {"article": 0, "main": 0}

        def flush() -> None:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                self.blocks.append(("/".join(t for t, _ in stack), joined, inside["article"] > 0, inside["main"] > 0))

        def pop() -> None:
            nonlocal out
            tag, gone = stack.pop()
            out -= gone
            if headers and headers[-1][0] > len(stack):
                _, first, headed = headers.pop()
                if not headed:
                    del self.blocks[first:]
            if tag in inside:
                inside[tag] -= 1

        at, n, tokens = 0, len(source), Tokens(source)
        while at < n:
            token = tokens.after(at)
            if not token:
                if not out:
                    text.append(source[at:])
                break
            start, end_at, closes, tag, attrs = token
            if start > at and not out:
                text.append(source[at:start])
            at = end_at
            if not tag:
                continue
            tag = tag.lower()
            if closes:  # an end tag closes up to its element, if that is open
                if tag in BLOCKS:
                    flush()
                if any(t == tag for t, _ in stack):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                elif tag == "br" and not out:
                    text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br" and not out:
                    text.append(" ")
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag in BLOCKS:
                flush()
                if tag in ENDS_P:
                    self._close(stack, pop, "p", {"td", "th", "div", "li", "blockquote", "article", "section", "button"})
                if tag == "li":
                    self._close(stack, pop, "li", {"ul", "ol", "menu"})
                elif tag in ("dd", "dt"):
                    self._close(stack, pop, "dd", {"dl"})
                    self._close(stack, pop, "dt", {"dl"})
                elif tag in ("td", "th", "tr"):
                    for t in ("td", "th", *(("tr",) if tag == "tr" else ())):
                        self._close(stack, pop, t, {"table", "tbody", "thead", "tfoot"} | ({"tr"} if t != "tr" and tag != "tr" else set()))
                elif tag == "body":
                    self._close(stack, pop, "head", set())
            own = tag == "header" and inside["article"] > 0 and not out and named
            gone = _left_out("div" if own else tag, attrs, named)
            if own and not gone:
                headers.append([len(stack) + 1, len(self.blocks), False])
            elif headers and tag in HEADINGS and not out and not gone:
                for h in headers:
                    h[2] = True
            if tag in inside:
                if not gone:  # an article ends elements left open before it
                    while stack and stack[-1][0] in ("nav", "aside", "header", "footer", "ul", "ol", "li", "p", "a") and out:
                        pop()
                inside[tag] += 1
            stack.append((tag, gone))
            out += gone
            if attrs.rstrip().endswith("/") and tag in ("svg", "path", "circle", "rect"):
                pop()
        flush()

    @staticmethod
    def _close(stack: list, pop, tag: str, scope: set[str]) -> None:
        for t, _ in reversed(stack):
            if t == tag:
                while stack[-1][0] != tag:
                    pop()
                pop()
                return
            if t in scope:
                return

    def main(self) -> str:
        """Main text of a page that no template is known for."""
        return main_text([(t, a, m) for _, t, a, m in self.blocks])


def main_text(slots: list[tuple[str, bool, bool]]) -> str:
    """Slots (text, in an article, in a main element) in articles, or in main elements (all, if there are none) if over twice as much."""
    size = lambda own: sum(len(t) for t, _, _ in own)
    article = [s for s in slots if s[1]]
    wider = [s for s in slots if s[1] or s[2]] if any(m for _, _, m in slots) else slots
    own = wider if size(wider) > 2 * size(article) else article
    return "\n".join(t for t, _, _ in own)


def nested(tokens: list[int], classes: dict[int, tuple[int, int]]) -> set[int]:
    """Classes that are valid on a page, from its tokens in order and the (class, pages) of those that have one.

    Every class has to come as whole tuples of its tokens in one order, and its
    tuples must nest with those of the others; of two that cross, the one of
    fewer pages goes.
    """
    met: dict[int, list[int]] = {}
    weight = {}
    for t in tokens:
        if t in classes:
            c, weight[c] = classes[t][0], classes[t][1]
            met.setdefault(c, []).append(t)
    order = {}
    for c, seq in met.items():
        k = len(set(seq))
        if seq == seq[:k] * (len(seq) // k):
            order[c] = seq[:k]
    while True:
        stack: list[list] = []  # open tuples: class, tokens so far
        crossed = None
        for t in tokens:
            c = classes[t][0] if t in classes else None
            if c not in order:
                continue
            if stack and stack[-1][0] == c:
                stack[-1][1] += 1
            elif any(s[0] == c for s in stack):
                crossed = min(c, stack[-1][0], key=lambda x: (weight[x], x))
                break
            else:
                stack.append([c, 1])
            if stack[-1][1] == len(order[c]):
                stack.pop()
        if crossed is None:
            return set(order)
        del order[crossed]


def key(path: str, text: str = "") -> int:
    """Number of a tag path, or of a path with the text that stands there."""
    return xxhash.xxh3_64_intdigest(f"{path}\x00{text}") - 2**63


#: Token of the page itself.
PAGE = key("\x01")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))


def templates(pages: DataFrame, named: bool = True) -> DataFrame:
    """host and its classes' tokens (class, token, pages one after another), from all its pages (host, html); pages of equal blocks count once."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for name, source in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                blocks = Page(source, named).blocks
                page = xxhash.xxh3_128_hexdigest("\x00".join(f"{path}\x00{text}" for path, text, _, _ in blocks))
                seen = Counter(x for path, text, _, _ in blocks for x in ((key(path), False), (key(path, text), True)))
                sizes = {key(path, text): len(text) for path, text, _, _ in blocks}
                seen[PAGE, False], sizes[PAGE] = 1, sum(len(text) for _, text, _, _ in blocks)
                for (token, is_text), n in seen.items():
                    vector = xxhash.xxh3_64_intdigest(f"{page}\x00{n}") >> 24  # summed: the fingerprint of an occurrence vector
                    for col, v in zip(cols, (name, token, is_text, vector, sizes.get(token, 0) * n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["host", "token", "is_text", "vector", "chars"])

    counted = checkpointed(
        pages.select("host", "html").mapInArrow(tokens, "host string, token long, is_text boolean, vector long, chars long").distinct()
        .groupBy("host", "token", "is_text").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))
        .where(F.col("pages") >= SUPPORT)
    )
    hosts = counted.groupBy("host").agg(F.max(F.when(F.col("token") == PAGE, F.col("pages"))).alias("of"), F.max(F.when(F.col("token") == PAGE, F.col("chars"))).alias("total"), F.count(F.lit(1)).alias("cnt"))
    fit = joined(counted, hosts, "host", counted.count()).where(F.col("pages") * RARE >= F.col("of")).withColumn("class", F.xxhash64("vector", "pages"))
    # classes that hold a tag path or the page itself, and a text
    own = fit.groupBy("host", "class").agg(F.bool_and("is_text").alias("loose"), F.bool_or("is_text").alias("told"), F.collect_set("token").alias("tokens"), F.max("pages").alias("pages"), F.sum(F.when(F.col("is_text"), F.col("chars"))).alias("chars"), F.max("total").alias("total"))
    token = F.explode("tokens").alias("token")
    by_class = own.where("told and not loose").select("host", F.array(F.struct("class", "pages", "tokens")).alias("own"), "chars", "total")
    by_host = by_class.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("own"), F.sum("chars").alias("chars"), F.max("total").alias("total"))
    found = by_host.where("4 * chars <= 3 * total").select("host", F.explode("own").alias("own")).select("host", "own.class", "own.pages", "own.tokens")
    found = found.select("host", "class", token, "pages").where(F.col("token") != PAGE)
    return found.groupBy("host").agg(F.flatten(F.collect_list(F.array("class", "token", "pages"))).alias("template"))


def extract(pages: DataFrame, named: bool = True) -> DataFrame:
    """Every row and column of ``pages``, and last ``main_text`` (underscores appended if the name is taken).

    pages: url and html among other columns. Null html is empty, and so is the
    text where nothing remains; a null url is a host of its own name "". Repeated
    rows and copies under other urls stay rows, but are one page of their host's template.
    Without ``named`` the template alone tells what is left out, not names of elements.
    """
    name, part, blocks, template, out = fresh(pages, "host", "part", "blocks", "template", "main_text")
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = templates(pages.select(host(F.col("url")).alias("host"), source.alias("html")), named).withColumnsRenamed({"host": name, "template": template})

    @F.pandas_udf("tokens binary, flags binary, texts string")
    def blocks_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """A page's blocks: two tokens and a flag byte for each, texts a line each."""
        for sources in batches:
            rows = []
            for s in sources:
                own = Page(s, named).blocks
                tokens = np.array([k for path, t, _, _ in own for k in (key(path), key(path, t))], np.int64)
                rows.append((tokens.tobytes(), bytes(a + 2 * m for _, _, a, m in own), "\n".join(t for _, t, _, _ in own)))
            yield pd.DataFrame(rows, columns=["tokens", "flags", "texts"])

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        last, classes = b"", {}
        for own, lists in batches:
            got = []
            for tokens, flags, texts, t in zip(own["tokens"], own["flags"], own["texts"], lists, strict=True):
                told = b"" if t is None else t.tobytes()
                if told != last:
                    last, classes = told, {k: (c, n) for c, k, n in np.frombuffer(told, np.int64).reshape(-1, 3).tolist()}
                keys = np.frombuffer(tokens, np.int64).tolist()
                valid = nested(keys, classes) if classes else set()
                slots = [(x, bool(f & 1), bool(f & 2)) for x, f, k in zip(texts.split("\n"), flags, keys[1::2]) if k not in classes or classes[k][0] not in valid]
                got.append(main_text(slots))
            yield pd.Series(got, dtype=object)

    # pages meet their template by host; hosts that would outgrow a task are dealt over all, each part with a copy of the bounded template
    n = partitions(pages.sparkSession)
    sizes = pages.groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    large = [r[0] for r in sizes.where(F.col("n") > max(1000, pages.count() // n)).select("host").collect()]  # fewer than n hosts
    own = pages.withColumns({name: host(F.col("url")), blocks: blocks_of(source)})
    is_large = F.col(name).isin(large)
    own = own.withColumn(part, F.when(is_large, F.pmod(F.xxhash64(F.col(blocks)["texts"], F.monotonically_increasing_id()), F.lit(n)).cast("int")).otherwise(0))
    known = known.withColumn(part, F.explode(F.when(is_large, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return own.join(known, [name, part], "left").withColumn(out, text(blocks, template)).select(*pages.columns, out)
