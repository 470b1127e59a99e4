"""Main text of web pages by maximum-scoring subsequence.

A page is a row of words and tags.  Words score positive and tags negative, with weights learned from labelled
pages; one linear scan finds the contiguous region with the highest sum.  Elements that are never article text
(menus, forms, scripts and the like) are taken out before, so that they neither split the region nor end in it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import name_of, schema_of

#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp plaintext".split())
#: Elements that hold no article text.
DROPPED = RAW | frozenset(
    "head nav header footer aside form template select option datalist button dialog menu svg math canvas object audio video map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre "
    "figure figcaption address hr center details summary fieldset legend search".split()
)
#: Weights of words in names (classes, ids, roles) before any page is seen; ``weights`` moves them by what labelled pages show.
#: Names of adverts and of what asks something of the reader weigh most, then comments, then the other parts of a page.
MARKS = {
    **dict.fromkeys(
        "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion cookie cookies consent gdpr newsletter subscribe "
        "subscription share sharing outbrain taboola".split(), -6.0,
    ),
    **dict.fromkeys("comment comments disqus respond reply replies".split(), -4.0),
    **dict.fromkeys(
        "banner sidebar sidebars aside menu menus nav navbar navigation navigationbar breadcrumb breadcrumbs notice notices notification alert popup modal overlay "
        "signup login social related recommended recommendations footer masthead toolbar widget widgets pagination pager search skip hidden contentinfo complementary".split(), -3.0,
    ),
    "header": -1.0,
}
#: Words of layout, which say nothing of the content.
LAYOUT = frozenset(
    "a active all an and area author avatar background bar big block blocks body bottom box btn button buttons by card cards center centre close col column columns component "
    "container copyright count css date desktop dropdown email el facebook field fixed float foot for form grid group head heading icon icons image images in info inline inner "
    "input instagram is item items js label large law leaderboard left lg link linkedin links list lists logo main md media message meta mobile module more new news newer next "
    "number of off older on open outer page pages panel pinterest placeholder prev previous primary print rail reading region responsive results right root row secondary section "
    "sections site sky skyscraper slot sm small space sticky tag tags text that the this thread time title to toggle top topic topics tree twitter unit view web whatsapp wide "
    "widget wrap wrapper xl xs you your zone".split()
)
#: Words for the article itself, which make up for the least mark only, as in ``article-header``.
ARTICLE_WORDS = frozenset("article articles content entries entry post posts stories story".split())
#: Weight of any other word: a name with such a word tells of the content, as in ``ad-hoc`` or ``share-price``.
CONTENT = 6.5
#: Elements inside lines and of code hold text of the article unless their names speak strongly against it.
INLINE_BONUS = 4.5
#: Ids of headings are mostly slugs of their text; their classes have a smaller bonus.
SLUG_BONUS, HEADING_BONUS = 3.5, 1.0
#: Labelled pages, at least, that a word of names has to stand in before they move its weight.
NAME_PAGES = 20
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Labelled pages that the weights are learned from, at most.
LABELLED_PAGES = 2000
#: The lowest score of a tag.
LEAST = -8.0
#: An unended tag stops at the next ``<``, so that the scan stays linear in any text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<more>(?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INLINE = frozenset("a b i u s em strong span br img code small sub sup mark q cite abbr time font big del ins kbd wbr".split())


@dataclass
class Token:
    """A tag, or text if ``name`` is empty."""

    name: str
    close: bool = False
    text: str = ""
    marks: str = ""
    end: int = -1


def tokens(page: str) -> list[Token]:
    """Tags and text of a page; comments, declarations and the content of raw elements are left out."""
    found, at = [], 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            found.append(Token("", text=page[at:m.start()]))
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        found.append(Token(name, bool(m["close"]), marks=m["more"] or ""))
        if name in RAW and not m["close"]:
            shut = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = shut.start() if shut else len(page)  # as browsers read it
    if at < len(page):
        found.append(Token("", text=page[at:]))
    return found


def _match(row: list[Token]) -> None:
    """Set ``end`` of each opening tag to the place of its closing tag, where it has one."""
    open_: dict[str, list[int]] = {}
    for i, t in enumerate(row):
        if not t.name or t.name in VOID:
            continue
        if not t.close:
            open_.setdefault(t.name, []).append(i)
        elif open_.get(t.name):
            row[open_[t.name].pop()].end = i


def _attributes(more: str) -> dict[str, str]:
    """Attributes by name in lower case, the first of a name; those without a value have an empty one."""
    found: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(more):
        found.setdefault(name.lower(), html.unescape("".join(value)))
    return found


def prior(word: str) -> float:
    """Weight of a word in names before any page is seen."""
    if word in MARKS:
        return MARKS[word]
    return 0.0 if len(word) < 2 or word in LAYOUT else 1.5 if word in ARTICLE_WORDS else CONTENT


@dataclass(frozen=True)
class Weights:
    """Scores by feature; what was never seen in labelled pages has a mild default."""

    by_feature: dict[str, float]
    word: float = 1.0
    tag: float = -0.5

    def of(self, feature: str) -> float:
        return self.by_feature.get(feature, self.word if feature[0] == "w" else self.tag)

    def of_name(self, word: str) -> float:
        """Weight of a word in a class, id or role: below 0 against article text, above 0 for it."""
        learned = self.by_feature.get(f"n:{word}")
        return prior(word) if learned is None else learned


def _words_of_name(name: str) -> list[str]:
    return [w for w in _PARTS.split(_CAMEL.sub("-", name).lower()) if w]


def _speaks(names: str, bonus: float, learned: Weights) -> float:
    """What some names say against an element, 0 or less: per name the sum of its words, where content makes up for marks."""
    return min(0.0, bonus + sum(min(0.0, sum(map(learned.of_name, _words_of_name(n)))) for n in names.split()))


def _dropped(t: Token, learned: Weights) -> bool:
    """Whether an element holds no article text: by its tag, by being hidden, or by the weights of its names."""
    if t.name in DROPPED:
        return True
    if not t.marks or t.name in ("html", "body", "main"):
        return False
    by = _attributes(t.marks)
    if "hidden" in by or by.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(by.get("style", "")):
        return True
    inline = t.name in _INLINE or t.name == "pre"
    of_class = INLINE_BONUS if inline else HEADING_BONUS if t.name in HEADINGS else 0.0
    of_id = INLINE_BONUS if inline else SLUG_BONUS if t.name in HEADINGS else 0.0
    return _speaks(f"{by.get('class', '')} {by.get('role', '')}", of_class, learned) + _speaks(by.get("id", ""), of_id, learned) < 0


def kept(row: list[Token], learned: Weights) -> list[Token]:
    """The tokens outside elements that hold no article text.

    An element that is never closed loses only its tag, and one that holds the article stays, whatever its names.
    """
    _match(row)
    articles, until = [], -1
    for i, t in enumerate(row):
        if t.name in ("article", "main") and not t.close and i > until and not _dropped(t, learned):
            articles.append(i)
            until = t.end if t.name == "article" else until  # an article in an article protects nothing
    out, i, a = [], 0, 0
    while i < len(row):
        t = row[i]
        while a < len(articles) and articles[a] <= i:
            a += 1
        if t.name and not t.close and t.name not in VOID and _dropped(t, learned):
            if t.end > i and not (a < len(articles) and articles[a] < t.end):
                i = t.end + 1
                continue
            if t.name in DROPPED and t.end < 0:
                i += 1
                continue
        out.append(t)
        i += 1
    return out


def _features(row: list[Token]) -> Iterator[tuple[str, int]]:
    """Per token its feature and how often it counts: ``t:`` and tag name, or ``w:`` and the block that words stand in."""
    block, links = "", 0
    for t in row:
        if t.name:
            if t.name == "a":
                links = max(0, links + (-1 if t.close else 1))
            elif t.name in BLOCK and not t.close:
                block = t.name
            elif t.name in BLOCK:
                block = ""
            yield f"t:{t.name if t.name in BLOCK or t.name in _INLINE else 'other'}", 1
        else:
            yield f"w:{block}{'>a' if links else ''}", len(t.text.split())


def counts(page: str) -> dict[str, list[int]]:
    """Per feature how often it stands inside and outside the labelled text of a page; empty for unlabelled pages."""
    row, untaught = tokens(page), Weights({})
    _match(row)
    inside = {}
    for name in ("article", "main"):
        opened = [i for i, t in enumerate(row) if t.name == name and not t.close and not _dropped(t, untaught)]
        if len(opened) == 1 and row[opened[0]].end > 0:
            first, last = opened[0] + 1, row[opened[0]].end
            inside = {id(t) for t in row[first:last]}
        if opened:
            break
    if not inside:
        return {}
    found: dict[str, list[int]] = {}
    left = kept(row, untaught)
    for t, (feature, n) in zip(left, _features(left), strict=True):
        found.setdefault(feature, [0, 0])[id(t) not in inside] += n
    said = [0, *accumulate(0 if t.name else len(t.text.split()) for t in row)]
    for i, t in enumerate(row):
        if t.marks and t.end > i and t.name not in DROPPED and not i < first <= t.end:
            by = _attributes(t.marks)
            for word in {w for k in ("class", "id", "role") for w in _words_of_name(by.get(k, ""))}:
                found.setdefault(f"n:{word}", [0, 0])[id(t) not in inside] += said[t.end] - said[i]
    return found


def weights(found: dict[str, tuple[int, int]], pages: int) -> Weights:
    """Log-odds of standing inside; words at least a little above 0, tags at least a little below.

    Words of names start from ``prior`` and move by the log-odds of the words their elements hold, no further than 0:
    a mark that stands in articles marks nothing, and a word that stands only outside them tells of no content.

    A tag that never stands inside the text of any of the labelled pages, but often outside, has the least score, which
    enough words on both sides outweigh.
    """
    by = {}
    for feature, (inside, outside) in found.items():
        odds = math.log((inside + 1) / (outside + 1))
        if feature[0] == "n":
            before = prior(feature[2:])
            by[feature] = min(0.0, max(min(MARKS.values()), before + odds)) if before < 0 else max(0.0, min(before, before + odds))
        elif feature[0] == "w":
            by[feature] = min(3.0, max(0.05, 1 + odds / 4))
        elif not inside and outside >= 20 and outside >= pages:
            by[feature] = LEAST
        else:
            by[feature] = max(LEAST, min(-0.02, -0.5 + odds / 4))
    return Weights(by)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last) of the contiguous run with the highest sum, the longest and then first at a tie; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and total > 0 and i + 1 - start > region[1] - region[0]:
            best, region = total, (start, i + 1)
    return region


def extract(page: str, learned: Weights) -> str:
    """Main text: the blocks of the best region, white space inside each as one space, joined by an empty line."""
    row = kept(tokens(page), learned)
    first, last = best_region([learned.of(f) * n for f, n in _features(row)])
    blocks, now = [], []

    def end() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    for t in row[first:last]:
        if not t.name:
            now.append(html.unescape(t.text))
        elif t.name in BLOCK:
            end()
        elif t.name == "br":
            now.append(" ")
    end()
    return "\n\n".join(blocks)


def learn(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = LABELLED_PAGES) -> Weights:
    """Weights from the labelled pages (with one article or main element) whose id has one of the ``most`` smallest hashes.

    The bounded sample only fits the weights, and hashes take it from all sources alike; the feature counts come to the driver, a few dozen numbers, as tag names
    outside HTML's share one feature and words of names count from ``NAME_PAGES`` pages on.
    """
    page = name_of(html_col).cast("string")
    marked = pages.where(F.lower(page).rlike("<(article|main)[\\s>]")).select(name_of(id_col).alias("__id"), page.alias("__html"))
    first = marked.select("__id").where("__id IS NOT NULL").distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)  # ids alone, as they all meet in one task
    sample = marked.join(F.broadcast(first), "__id", "left_semi").select("__html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for value in batch.column("__html").to_pylist():
                found = counts(value or "")
                for feature, (a, b) in [*found.items(), *([("pages", (1, 0))] if found else [])]:
                    own = total.setdefault(feature, [0, 0, 0])
                    own[0] += a
                    own[1] += b
                    own[2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in range(3))], ["feature", "inside", "outside", "pages"])

    sums = sample.mapInArrow(run, "feature string, inside long, outside long, pages long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "pages")])
    rows = sums.where((F.col("pages") >= NAME_PAGES) | ~F.col("feature").startswith("n:")).collect()
    found = {f: (a, b) for f, a, b, _ in rows}
    return weights({f: v for f, v in found.items() if f != "pages"}, found.get("pages", (0, 0))[0])


def extract_pages(pages: DataFrame, learned: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` of every row; NULL, empty and wordless pages give an empty text.

    Without ``learned`` the weights come from the labelled pages among ``pages``; with none there, from defaults.
    """
    learned = learn(pages, html_col, id_col) if learned is None else learned
    given = pages.select(name_of(id_col).alias(id_col), name_of(url_col).alias(url_col), F.coalesce(name_of(html_col).cast("string"), F.lit("")).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, learned) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(url_col), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return given.mapInArrow(run, schema_of(given, id_col, url_col) + ", text string, n_chars long")
