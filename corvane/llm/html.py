"""Main text of web pages: the best contiguous region by a linear scan.

A page is a sequence of tokens. A word scores positive and a tag negative; the
weights come from labelled pages, that is pages of a bounded sample that mark their
article (``article`` or ``main``). A word's weight is the share of words in its
context (element and class) that stand in an article, a tag's is minus the share of
its uses outside; a context that no labelled page has takes the weight of its element,
and else that of all words or tags. One pass finds the run of greatest sum. It grows to
the smallest element that holds it, where it has more than half of that element's words,
so that no last short line is lost; its text is the result, whether or not the page marks
an article.

Elements that are no main text (menus, forms, adverts, ...) have contexts of their
own, so that the weights of their tags are learned apart; what they hold scores nothing,
however long it is, and is left out of the run.
They are told by the element, by a role, by a word of the list that is a whole class or
id, and, for elements that hold blocks, by such a word as part of a class or id.

Defined cases: null and empty pages give an empty text; unclosed elements end with
their parent, excluded ones that no end tag follows hold nothing; stray end tags are ignored; comments, doctypes, scripts and styles
are no text; ``br`` is white space inside its block; a form that holds a heading of the
first level, a menu or an article is the page's frame and excludes nothing; a page that
repeats is extracted each time; without labelled pages a word scores 0.5 and a tag -0.5;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, prepare, shared_value, unit_hash

#: Bound of the training sample (pages).
PAGES = 2000
# Fixed values of the HTML standard: elements without end tags, of raw text, and of block layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements, roles and words of class names and ids that mark what is no main text.
NEVER = frozenset("nav aside footer form dialog menu button input head".split()) | RAW
#: Not shown, or no text of the page: excluded up to their end tag, if there is one.
EMBEDDED = frozenset("template noscript svg iframe object select datalist option".split())
#: Elements of running text: only a whole class or id excludes these.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 a abbr b cite code em i mark q s small span strong sub sup time u".split())
#: Words that exclude outside an article only, as an article has a header of its own.
HEADS = frozenset("header banner masthead".split())
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in (*RAW, *EMBEDDED, "form")}
_FRAME = re.compile(r"<(?:article|main|h1|nav|header|footer)\b", re.I)
NO_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NO_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager tags skip".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marks(attributes: str) -> tuple[str, frozenset[str], frozenset[str]]:
    """(class name as context, words of the list that are a whole class, id or a role, those that are a part of one)."""
    name, whole, part = "", set(), set()
    for m in _ATTR.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        kind = m[1].lower()
        if kind == "role":
            if value.strip().lower() in NO_ROLES:
                whole.add("role")
            continue
        for x in value.split():
            words = _PART.findall(_CAMEL.sub(" ", x).lower())
            (whole if len(words) == 1 else part).update(NO_WORDS.intersection(words))
        if kind == "class":
            name = ".".join(_PART.findall(_CAMEL.sub(" ", value).lower())[:3])
    return name, frozenset(whole), frozenset(part)


class Page:
    """Tokens of a page: (kind, key, text, excluded, article) with kind ``w`` for text, ``t`` for tags."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, str, bool, int]] = []
        #: (element, first token, token behind the last) of each element, parents before children.
        self.elements: list[list] = []
        stack: list[tuple[str, str, bool, int, int]] = []  # element, context, excluded, article, place in elements
        seen_marks: dict[str, tuple[str, frozenset[str], frozenset[str]]] = {}
        ahead: dict[str, int] = {}

        def following(pattern: re.Pattern, at: int) -> int:
            """Where the pattern's next match starts, -1 if there is none."""
            if 0 <= ahead.get(pattern.pattern, 0) < at or pattern.pattern not in ahead:
                m = pattern.search(source, at)
                ahead[pattern.pattern] = m.start() if m else -1
            return ahead[pattern.pattern]

        article, at, end, add = 0, 0, len(source), self.tokens.append
        while at < end:
            m = _TOKEN.match(source, at)
            at = m.end()
            tag = m[2]
            context, excluded, inside = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ("", False, 0)
            if tag is None:
                text = m[0]
                if text[:2] not in ("<!", "<?"):
                    add(("w", context, text, excluded, inside))
                continue
            tag = tag.lower()
            if m[1]:
                if any(x[0] == tag for x in reversed(stack)):
                    while (gone := stack.pop())[0] != tag:
                        self.elements[gone[4]][2] = len(self.tokens)
                    self.elements[gone[4]][2] = len(self.tokens)
                inside = stack[-1][3] if stack else 0
                within = stack[-1][2] if stack else False
                add(("t", "" if within else "/" + tag, tag, within, inside))
                continue
            if tag in RAW and not (m[3].endswith("/") and any(x[0] == "svg" for x in stack)):
                close = _END[tag].search(source, at)
                at = close.end() if close else end
                add(("t", "" if excluded else tag, tag, True, inside))
                continue
            if m[3] not in seen_marks:
                seen_marks[m[3]] = _marks(m[3])
            name, whole, part = seen_marks[m[3]]
            words = whole if tag in RUNNING else whole | part
            if tag in ("article", "main") and not inside and not excluded:
                article += 1
                inside = article
            no = bool(words - HEADS if inside else words) or tag in NEVER or tag in EMBEDDED or (tag == "header" and not inside)
            no = no and tag not in ("html", "body", "article", "main") and not (tag == "form" and 0 <= following(_FRAME, at) < (following(_END["form"], at) % (end + 1)))
            if tag not in VOID and not m[3].endswith("/") and not (tag in EMBEDDED and following(_END[tag], at) < 0):
                key = f"{tag}.{name}" if name or tag not in ("p", "b", "i", "a", "span", "em", "strong", "u") else context.lstrip("!")
                stack.append((tag, "!" * (excluded or no) + key, excluded or no, inside, len(self.elements)))
                self.elements.append([tag, len(self.tokens), 0])
            add(("t", "" if excluded else tag, tag, excluded or no, inside))

        for x in self.elements:
            x[2] = x[2] or len(self.tokens)

    def counts(self) -> Counter:
        """(kind, key, in article) -> words or tags; empty where no article is marked."""
        out: Counter = Counter()
        if any(t[4] for t in self.tokens):
            for kind, key, text, excluded, article in self.tokens:
                n = len(text.split()) if kind == "w" else 1
                for x in levels(kind, key, excluded):
                    out[kind, x, bool(article and not excluded)] += n
        return out

    def region(self, weights: dict[tuple[str, str], float]) -> tuple[int, int]:
        """First and past-last token of the run of greatest sum."""
        best, span, total, begin = 0.0, (0, 0), 0.0, 0
        found: dict[tuple[str, str, bool], float] = {}
        for k, (kind, key, text, excluded, _) in enumerate(self.tokens):
            n = len(text.split()) if kind == "w" else 1
            if not n:
                continue
            at = kind, key, excluded
            if excluded and (kind == "w" or not key):
                continue
            if at not in found:
                found[at] = next((weights[kind, x] for x in levels(*at) if (kind, x) in weights), 0.5 if kind == "w" else -0.5)
            total += n * found[at]
            if total <= 0:
                total, begin = 0.0, k + 1
            elif total > best:
                best, span = total, (begin, k + 1)
        return span

    def whole(self, a: int, b: int) -> tuple[int, int]:
        """The run grown to the smallest element that holds its words, if that isn't the page and the run has more than half of its words."""
        words = [k for k in range(a, b) if self.tokens[k][0] == "w" and not self.tokens[k][3] and self.tokens[k][2].strip()]
        if not words:
            return a, b
        name, lo, hi = min((x for x in self.elements if x[1] <= words[0] and words[-1] < x[2]), key=lambda x: x[2] - x[1], default=("body", a, b))
        if name in ("html", "body") or self.words(lo, hi) >= 2 * self.words(a, b):
            return a, b
        return min(a, lo), max(b, hi)

    def words(self, a: int, b: int) -> int:
        return sum(len(t[2].split()) for t in self.tokens[a:b] if t[0] == "w" and not t[3])

    def text(self, weights: dict[tuple[str, str], float]) -> str:
        blocks, now = [], []
        for kind, _, text, excluded, _ in self.tokens[slice(*self.whole(*self.region(weights)))]:
            if kind == "t":
                if text in BLOCKS:
                    blocks.append("".join(now))
                    now = []
                elif text == "br":
                    now.append(" ")
            elif not excluded:
                now.append(html.unescape(text))
        blocks.append("".join(now))
        return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def levels(kind: str, key: str, excluded: bool) -> tuple[str, ...]:
    """The keys under which a token is counted, from its own to that of all words or tags."""
    no = "!" * excluded
    return (key, f"{key.partition('.')[0]}.", no) if kind == "w" else (no + key, no)


def learn(pages: DataFrame, most: int = PAGES) -> dict[tuple[str, str], float]:
    """Weights from about ``most`` pages at most, chosen by a hash of their address and id."""
    prepare(pages.sparkSession)
    n = pages.count()
    sample = pages.where(unit_hash("page_id", "url") < min(1.0, most / max(1, n))).select("html")

    def run(batches):
        for _, texts in chunks(batches, "html"):
            total: Counter = Counter()
            for text in texts:
                total.update(Page(text or "").counts())
            rows = [(k, key, n if ins else 0, 0 if ins else n) for (k, key, ins), n in total.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "key", "i", "o"])

    found = sample.mapInArrow(run, "kind string, key string, i bigint, o bigint").groupBy("kind", "key").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = {}
    for r in found.collect():  # bounded by the sample
        share = (r["i"] + 1) / (r["i"] + r["o"] + 2)
        out[r["kind"], r["key"]] = share if r["kind"] == "w" else share - 1
    return out


def extract(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = learn(pages) if weights is None else weights
    shared = shared_value(pages.sparkSession, weights)
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")

    def run(batches):
        for part, texts in chunks(batches, "html"):
            out = [Page(t or "").text(shared.value) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
