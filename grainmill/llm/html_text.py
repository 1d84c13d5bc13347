"""HTML main text with site style trees.

Pages are cut to blocks; a block's place is the path of its structural elements with their classes and ids. The pages
of a host are merged to one style tree: for each place, how many pages have it, in how many child layouts, and on how
many pages each of its texts stands. The importance of a place joins the entropy of its presentations with that of its
contents: what has one layout and the same texts on page after page has next to none. Branches of low importance are
taken from each page, inside articles too. Markup is the prior: what it declares to be no main text (navigation, adverts,
forms and so on) goes, as the contract has it; of a page that marks its article (or main part) only that part is a
candidate, and a branch in it starts from the importance PRIOR, which counts like PRIOR_PAGES pages, so that it takes more
evidence to cut than a branch of a page without such marks. Where cutting would leave nothing of a page (a host whose
pages are copies of each other), nothing is cut: the tree can't tell its parts from each other.

The tree is counted with aggregates over (host, place, text hash), combined before the shuffle, so that a host with a
third of all pages is no hot group. Pages themselves are never shuffled: places to cut go to the tasks if there are at
most MAX_CUT of them (their number is checked), else they are joined to (page, place) rows and come back by page.

Elements of any depth are told apart; below BRANCH_DEPTH they are leaves of the branch at that depth.

Defined results: null html is empty text. Character references are decoded once; white space, line breaks included, is
one space inside a block; blocks are joined by newlines. Hosts are compared in lower case; a null or odd url is a host of
its own name. Repeated rows give repeated rows and count as pages of their host. An article that stands under a class name of
a side part (has-sidebar) is taken if the page has no other.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import cut as checkpointed

MIN_PAGES, LOW, MAX_CUT, BRANCH_DEPTH = 5, 0.25, 1_000_000, 12
PRIOR, PRIOR_PAGES = 0.9, 5

# Element names of HTML.
RAW = "script|style|noscript|template|iframe|object|svg|math|canvas|audio|video|select|textarea|button"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_ITSELF = frozenset("p li td th tr dt dd option".split())
HEAD_ONLY = frozenset("title meta link base style script".split())
NOT_MAIN = frozenset("nav header footer aside form dialog menu head figcaption".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead sidebar aside widget related recommended cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments disqus respond reply replies pagination pager toolbar skip".split()
)
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_NUMBERS = re.compile(r"\d+")


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def not_main(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element (or its role) says that it is no main text, and whether its names say so."""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True, False
    if tag in ("body", "html"):
        return False, False
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return tag in NOT_MAIN or attrs.get("role", "").lower() in NOT_MAIN_ROLES, bool(named.strip()) and not NOT_MAIN_WORDS.isdisjoint(_WORDS.findall(named))


def style(tag: str, attrs: dict[str, str]) -> str:
    names = ".".join(sorted(_NUMBERS.sub("#", attrs.get("class", "")).split()))
    return tag + (f".{names}" if names else "") + (f"#{_NUMBERS.sub('#', attrs['id'])}" if attrs.get("id") else "")


#: Whether a block is outside of articles, in one, or in one under a name of a side part.
OUTSIDE, ARTICLE, DOUBTFUL = 0, 1, 2


class Page:
    """blocks: (place, text, in the article, declared to be no main text); layouts: child styles by place."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.layouts: dict[str, list[str]] = {}
        self._stack: list[tuple[str, str, int, bool, bool]] = []  # tag, place, in the article, no main text by its element, by its names
        self._text: list[str] = []
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            if tag := m.group(3):
                self._tag(tag.lower(), bool(m.group(2)), m.group(4))
            elif m.group(1):
                self._text.append(" ")
        self._text.append(source[at:])
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = _SPACE.sub(" ", html.unescape("".join(self._text))).strip()
            self._text = []
            if text:
                _, place, main, out, named = self._stack[-1] if self._stack else ("", "", OUTSIDE, False, False)
                self.blocks.append((place, text, main, out or named))

    def _pop(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                del self._stack[k:]
                return

    def _tag(self, tag: str, closing: bool, rest: str) -> None:
        if tag in INLINE:
            return
        if tag in VOID:
            self._text.append(" ")
            return
        self._flush()
        if closing:
            self._pop(tag)
            return
        if tag not in HEAD_ONLY and tag not in ("html", "head") and any(s[0] == "head" for s in self._stack):
            self._pop("head")
        if tag in CLOSES_ITSELF or tag == "body":
            self._end_like(tag)
        elif self._stack and self._stack[-1][0] == "p":
            self._stack.pop()
        attrs = attributes(rest)
        own = style(tag, attrs)
        _, place, main, out, named = self._stack[-1] if self._stack else ("", "", OUTSIDE, False, False)
        self.layouts.setdefault(place, []).append(own)
        # Deeper elements are leaves of one branch, named by a hash of their way from it.
        place = f"{place}/{own}" if len(self._stack) < BRANCH_DEPTH else f"{'/'.join(place.split('/')[: BRANCH_DEPTH + 1])}/~{_hash(place, own)}"
        by_tag, by_name = not_main(tag, attrs)
        # The heading of an article often stands in a header element of its own.
        if tag == "header" and main and not (out or named) and not attrs.get("class") and not attrs.get("id"):
            by_tag = False
        if not main and not out and not by_tag and (tag in MAIN or attrs.get("role", "").lower() == "main"):
            main, named, by_name = DOUBTFUL if named or by_name else ARTICLE, False, False
        if not rest.rstrip().endswith("/"):
            self._stack.append((tag, place, main, out or by_tag, named or by_name))

    def _end_like(self, tag: str) -> None:
        """A paragraph, item or cell ends one that is open in the same parent."""
        until = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}.get(tag, ())
        for k in range(len(self._stack) - 1, -1, -1):
            name = self._stack[k][0]
            if name in until:
                return
            if name == tag or (tag in ("td", "th") and name in ("td", "th")) or (tag in ("dt", "dd") and name in ("dt", "dd")):
                del self._stack[k:]
                return
            if tag == "p":
                return


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").netloc or url or "").lower()
    except ValueError:
        return (url or "").lower()


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def branches(place: str) -> list[str]:
    steps = place.split("/")
    return ["/".join(steps[:k]) for k in range(2, len(steps) + 1)]


def _key(host: str, place: str, main: int) -> int:
    """The number of a branch among those to cut; inside articles it has another one."""
    return _hash(host, place, "article" if main else "")


def candidates(page: Page) -> list[tuple[str, str, int]]:
    """(place, text, in the article) of the blocks that markup allows: those of the article if the page marks one."""
    kept = [b for b in page.blocks if not b[3]]
    for kind in (ARTICLE, DOUBTFUL):
        if any(b[2] == kind for b in kept):
            return [b[:3] for b in kept if b[2] == kind]
    return [b[:3] for b in kept]


def main_text(page: Page, host: str, cut: np.ndarray | None = None) -> str:
    """The text of the blocks that stay; `cut`: the numbers of the branches to cut, in order."""
    blocks = candidates(page)
    if cut is not None and len(cut) and blocks:
        places = {(place, main) for place, _, main in blocks}
        numbers = {at: np.array([_key(host, b, at[1]) for b in branches(at[0])], np.int64) for at in places}
        low = {at: bool(len(n)) and bool((cut[np.minimum(np.searchsorted(cut, n), len(cut) - 1)] == n).any()) for at, n in numbers.items()}
        blocks = [b for b in blocks if not low[b[0], b[2]]] or blocks
    return "\n".join(text for _, text, _ in blocks)


def _facts(frames):
    """(host, place, kind, value): 0 a text's hash at its place, 1 a layout's hash, 2 the place itself; once for each page."""
    for frame in frames:
        for lo in range(0, len(frame), 256):
            rows = []
            for url, source in zip(frame["url"].iloc[lo : lo + 256], frame["src"].iloc[lo : lo + 256]):
                page, host = Page(source), host_of(url)
                facts = {(place, 0, _hash(text)) for place, text, _ in candidates(page)}
                facts |= {(f[0], 2, 0) for f in facts}
                seen = {branch for f in facts for branch in branches(f[0])}
                facts |= {(place, 1, _hash(*styles)) for place, styles in page.layouts.items() if place in seen}
                rows += [(host, *f) for f in facts]
            yield pd.DataFrame(rows, columns=["host", "place", "kind", "value"])


def branch_importance(pages: DataFrame) -> DataFrame:
    """(host, place, importance, pages) of the branches of each host's style tree; pages: url, src."""
    facts = pages.mapInPandas(_facts, "host string, place string, kind int, value long")
    # Both uses below read the counted facts, so pages are parsed once for them.
    counted = checkpointed(facts.groupBy("host", "place", "kind", "value").agg(F.count("*").alias("f")))
    # Entropy of the pages over a place's layouts; mean entropy of its texts over the pages, by which each is discounted.
    leaves = counted.groupBy("host", "place").agg(
        F.max(F.when(F.col("kind") == 2, F.col("f"))).alias("most"),
        F.sum(F.when(F.col("kind") == 0, F.col("f"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 0, F.col("f") * F.log(F.col("f").cast("double")))).alias("spread"),
        F.sum(F.when(F.col("kind") == 1, F.col("f"))).alias("laid"),
        F.sum(F.when(F.col("kind") == 1, F.col("f") * F.log(F.col("f").cast("double")))).alias("laid_spread"),
    )
    steps = F.split("place", "/")
    branch = F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    own = leaves.select("host", F.col("place").alias("branch"), F.col("laid"), F.col("laid_spread"))
    below = leaves.filter("texts > 0 AND place <> ''").withColumn("branch", branch).groupBy("host", "branch").agg(F.max("most").alias("pages"), F.sum("texts").alias("texts"), F.sum("spread").alias("spread"))
    seen = below.join(own, ["host", "branch"], "left").filter(F.col("pages") >= MIN_PAGES)
    content = 1 - F.col("spread") / F.col("texts") / F.log(F.col("pages").cast("double"))
    layout = F.when(F.col("laid") > 1, (F.log(F.col("laid").cast("double")) - F.col("laid_spread") / F.col("laid")) / F.log(F.col("laid").cast("double"))).otherwise(0.0)
    importance = F.greatest(content, F.lit(0.0)) * 0.9 + F.coalesce(layout, F.lit(0.0)) * 0.1
    return seen.select("host", F.col("branch").alias("place"), importance.alias("importance"), "pages")


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, place, importance, pages, in_article) of the branches to cut; in_article: inside articles as well."""
    judged = branch_importance(pages)
    with_prior = (F.col("importance") * F.col("pages") + PRIOR * PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    return judged.filter(F.col("importance") < LOW).withColumn("in_article", with_prior < LOW)


def _extracted(cut):
    def run(frames):
        low = np.frombuffer(cut.value, np.int64) if cut else None
        for frame in frames:
            texts = [main_text(Page(source), host_of(url), low) for url, source in zip(frame["url"], frame["src"])]
            yield pd.DataFrame({"page_id": frame["page_id"].array, "url": frame["url"], "text": texts})

    return run


def _extracted_by_row(frames):
    for frame in frames:
        texts = [main_text(Page(source), host_of(url), None if low is None else np.sort(np.array(low, np.int64))) for url, source, low in zip(frame["url"], frame["src"], frame["low"])]
        yield pd.DataFrame({"page_id": frame["page_id"].array, "url": frame["url"], "text": texts})


def _places(frames):
    """(key, number) of the branches of each page."""
    for frame in frames:
        rows = []
        for key, url, source in zip(frame["key"], frame["url"], frame["src"]):
            host = host_of(url)
            rows += [(key, n) for n in {_key(host, b, main) for place, main in {(p, m) for p, _, m in candidates(Page(source))} for b in branches(place)}]
        yield pd.DataFrame(rows, columns=["key", "low"])


def _numbered(frames):
    for frame in frames:
        rows = [_key(h, p, OUTSIDE) for h, p in zip(frame["host"], frame["place"])]
        inside = frame[frame["in_article"].astype(bool)]
        yield pd.DataFrame({"low": rows + [_key(h, p, ARTICLE) for h, p in zip(inside["host"], inside["place"])]})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_cut: int = MAX_CUT) -> DataFrame:
    """One row per row of `pages`: page_id, url, text."""
    base = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("src"))
    low = low_branches(base.select("url", "src")).select("host", "place", "in_article").mapInPandas(_numbered, "low long").distinct()
    # At most max_cut + 1 numbers come to the driver.
    found = np.sort(low.limit(max_cut + 1).toPandas()["low"].to_numpy(np.int64))
    schema = "page_id string, url string, text string"
    if len(found) <= max_cut:
        done = base.mapInPandas(_extracted(pages.sparkSession.sparkContext.broadcast(found.tobytes()) if len(found) else None), schema)
    else:
        keyed = base.withColumn("key", F.xxhash64("url", "src"))
        own = keyed.select("key", "url", "src").mapInPandas(_places, "key long, low long").distinct().join(low, "low").groupBy("key").agg(F.collect_list("low").alias("low"))
        done = keyed.join(own, "key", "left").select("page_id", "url", "src", "low").mapInPandas(_extracted_by_row, schema)
    return done.withColumn("page_id", F.col("page_id").cast("long"))


def op8_site_style_tree(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
