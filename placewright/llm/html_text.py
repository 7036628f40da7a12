"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels each block from what it holds: stop-word density, length and
link density make it text, boilerplate, or leave it open if it is too short or too mixed to tell. Markup is one more feature: what stands
in a menu, footer, sidebar, notice, advert, form or comment container is boilerplate; in an article container, low stop-word
or high link density alone leaves a block open, and only two list entries of links in a row are a menu: a paragraph is none. On a page whose
language has no list of stop words, told by the share of them on the whole page, the ends of sentences stand for them. In pass two each open block takes the label of its
nearest decided neighbours: both agree, or the nearer one decides, and a heading goes with the text that follows it. Inside an
article these are the article's own blocks, without its adverts and notices, and only two menus around a block make it boilerplate. Blocks labelled text are
joined in page order.

Each page is read once, left to right, in time linear in its length; pages are rows, so Spark spreads them. Nothing is
capped.

Defined cases: null or empty html gives an empty text; a page without any tag is one block of text. Very long pages are read whole. Repeated rows give
repeated results; a null page_id or url is passed on. An empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Function words of the languages in the tables, by language.
STOP_WORDS = {
    "en": "the of and a to in is was for on that with as by it at from are this be an or not",
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas au avec il ne se ce",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is never text; RAW ones end only at their own end tag.
RAW_TAGS = frozenset("script style textarea title noscript template xmp iframe".split())
DROP_TAGS = frozenset("head nav footer aside form menu button select option dialog svg object audio video canvas map fieldset label".split())
#: Words of a class, id or role that mark a container as boilerplate.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumbs pager pagination toc "
    "header masthead topbar footer foot copyright sidebar widget widgets complementary contentinfo "
    "cookie cookies consent gdpr popup modal overlay paywall comment comments commentlist disqus newsletter signup login".split()
)
#: Words that do so only beside words of this kind and of PARTS: others say what the container is about.
TOPIC_WORDS = frozenset(
    "promotion promoted bottom legal aside rail notice notices notification alert dialog discussion replies reply respond feedback "
    "share sharing social follow related recommended recommendations trending popular subscribe subscription search form hidden".split()
)
PARTS = frozenset(
    "list links link posts articles stories items item box block section area wrap wrapper container inner outer bar panel group row col column button buttons btn icons "
    "content us now the and for to by on of left right top side page site main more also reading news widget js is".split()
)
GOOD_WORDS = frozenset("article content main story post entry".split())
#: A class like content-with-sidebar speaks of the layout, not of what the element holds.
LAYOUT_WORDS = frozenset("with has no without".split())
#: Inside an article these mark its own head or foot, which is not a page header.
OWN_HEAD = frozenset("header masthead topbar top bottom legal form".split())
ROLE_TEXT = frozenset(["main", "article"])
#: In an article the id of one of these is an anchor and says what it is about, but for words of OWN_PARTS.
ANCHORED = HEADINGS | frozenset("section p blockquote dl dt dd li table".split())
OWN_PARTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored comments commentlist disqus newsletter sidebar breadcrumb breadcrumbs".split())

WORD_SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ATTRIBUTE = re.compile(r"""([^\s/>="']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
MARKING = frozenset("class id role hidden aria-hidden style".split())
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
NEXT_ATTRIBUTE = re.compile(r"[\s/]*=?[^\s/>=]*\s*(=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:_-]*")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"""[.!?…][\"'”’»)\]]*(?:\s|$)|[。！？؟।]""")

BAD, GOOD, OPEN, LINKS = -1, 1, 0, 2
SHORT_CHARS, LONG_CHARS, MAX_LINKS, LOW_STOPS, HIGH_STOPS = 70, 200, 0.33, 0.12, 0.2
#: Share of stop words below which a page's language is taken for one without a list, and the size of a page's text from which it tells.
FOREIGN_STOPS, FOREIGN_CHARS = 0.06, 70


def tag_end(page: str, at: int, lost: set[int]) -> int:
    """Index past the > that ends the tag whose attributes begin at `at`, or -1; a > inside a quoted value of any length doesn't end it.

    If a quote never closes, or no > follows, the first > ends the tag. lost gathers the places of the page from which that is so, so that each is read once."""
    first = page.find(">", at)
    if first < 0 or page.find('"', at, first) < 0 and page.find("'", at, first) < 0:
        return first + 1 or -1
    size, passed = len(page), []
    while at < size and at not in lost:
        passed.append(at)
        found = NEXT_ATTRIBUTE.match(page, at)
        at = found.end()
        if found[1] is None:
            if page.startswith(">", at):
                return at + 1
        elif page.startswith(('"', "'"), at):
            at = page.find(page[at], at + 1) + 1 or size
        else:
            at = UNQUOTED.match(page, at).end()
    lost.update(passed)
    return first + 1


def markup(attributes: str, inside: bool = False, tag: str = "") -> int:
    """BAD, GOOD or OPEN by an element's class, id, role and visibility; inside: whether it stands in an article."""
    verdict = OPEN
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name not in MARKING:
            continue
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and HIDDEN_STYLE.search(value):
            return BAD
        if name in ("class", "id", "role"):
            words = set(WORD_SPLIT.split(CAMEL.sub(" ", value).lower())) - (OWN_HEAD if inside else frozenset())
            words = {w for w in words if w and not w.isdigit()}
            if name == "id" and inside and tag in ANCHORED:
                words &= OWN_PARTS | GOOD_WORDS | LAYOUT_WORDS
            if (words & BAD_WORDS or words & TOPIC_WORDS and words <= TOPIC_WORDS | PARTS) and not words & LAYOUT_WORDS:
                verdict = BAD
            elif verdict == OPEN and (name == "role" and words & ROLE_TEXT or words & GOOD_WORDS):
                verdict = GOOD
    return verdict


def ends_of(page: str, tag: str) -> dict[int, int]:
    """Where each element of a tag ends, by the index past its start tag's name; elements that never end have none."""
    opened, ends = [], {}
    for found in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", page, re.I):
        if not found[1]:
            opened.append(found.start() + 1 + len(tag))
        elif opened:
            ends[opened.pop()] = found.end()
    return ends


def blocks_of(page: str) -> Iterator[tuple[str, int, int, bool, int, bool]]:
    """(text, characters inside links, markup verdict, heading?, article number, paragraph?) of each block in page order."""
    stack: list[tuple[str, int, bool, int]] = []  # open block-level elements: tag, verdict, inside an article, which
    verdict, article, number, articles, heading, paragraph, links = OPEN, False, 0, 0, False, False, 0
    ends: dict[str, dict[int, int]] = {}
    parts: list[str] = []
    linked = 0
    at, size = 0, len(page)
    lost: set[int] = set()

    def block():
        nonlocal parts, linked
        # a reference may stand for a blank, so it is decoded before blanks are folded
        text = " ".join(entities.unescape("".join(parts)).split())
        out = (text, linked, verdict, heading, number, paragraph) if text else None
        parts, linked = [], 0
        return out

    def settle():
        nonlocal verdict, article, heading, number, paragraph
        verdict, article, number = stack[-1][1:] if stack else (OPEN, False, 0)
        heading, paragraph = bool(stack) and stack[-1][0] in HEADINGS, bool(stack) and stack[-1][0] == "p"

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            text = page[at:begin]
            parts.append(text)
            if links:
                linked += len(text)
        if begin == size:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        mark = page[begin + 1 : begin + 2]
        if mark in ("!", "?"):
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        closing = mark == "/"
        found = TAG_NAME.match(page, begin + 1 + closing)
        end = tag_end(page, found.end(), lost) if found else -1
        if not found or end < 0:  # a lone < is text
            parts.append("<")
            at = begin + 1
            continue
        tag, attributes, at = found[0].lower(), page[found.end() : end - 1], end
        if tag in RAW_TAGS and not closing:
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = tag_end(page, close.end(), lost) if close else size
            at = size if at < 0 else at
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS or tag in DROP_TAGS:
            if (done := block()) is not None:
                yield done
            links = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID_TAGS and not attributes.endswith("/"):
                if stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
                    stack.pop()
                if tag == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                settle()
                own = markup(attributes, article, tag)
                inside = article or tag in ("article", "main")
                if verdict == BAD or tag in DROP_TAGS or own == BAD and tag not in ("html", "body") or tag == "header" and not article:
                    now = BAD
                else:
                    now = GOOD if inside or own == GOOD and tag not in ("html", "body") else verdict
                of = number
                if now == GOOD and verdict != GOOD:
                    of = articles = articles + 1
                stack.append((tag, now, inside, of))
            settle()
        elif attributes and not closing and tag not in VOID_TAGS and markup(attributes, article, tag) == BAD:
            if tag not in ends:
                ends[tag] = ends_of(page, tag)
            at = max(at, ends[tag].get(found.end(), at))
            parts.append(" ")
    if (done := block()) is not None:
        yield done


def foreign(blocks: list[tuple]) -> bool:
    """Whether a page's text, but for its links and boilerplate by markup, has so few stop words that its language has no list."""
    words = [w for text, linked, verdict, *_ in blocks if verdict != BAD and linked <= MAX_LINKS * len(text) for w in LETTERS.findall(text.lower())]
    return sum(map(len, words)) >= FOREIGN_CHARS and sum(w in STOPS for w in words) < FOREIGN_STOPS * len(words)


def first_pass(text: str, linked: int, verdict: int, paragraph: bool, no_stops: bool) -> int:
    """A block's label from itself alone: by its links, its length, its stop words (or, with no_stops, its sentences) and the markup around it. LINKS: mostly links, in an article."""
    if verdict == BAD:
        return BAD
    if linked / max(1, len(text)) > MAX_LINKS:
        return BAD if verdict != GOOD else OPEN if paragraph else LINKS
    if no_stops:
        return GOOD if SENTENCE_END.search(text) and len(text) >= SHORT_CHARS / 2 or len(text) >= LONG_CHARS else BAD if linked and verdict != GOOD else OPEN
    if len(text) < SHORT_CHARS:
        return BAD if linked and verdict != GOOD else OPEN
    words = LETTERS.findall(text.lower())
    stops = sum(w in STOPS for w in words) / max(1, len(words))
    if stops >= HIGH_STOPS or len(text) >= LONG_CHARS and stops >= LOW_STOPS:
        return GOOD
    return OPEN if stops >= LOW_STOPS or verdict == GOOD else BAD


def second_pass(labels: list[int], headings: list[bool], articles: list[int]) -> list[int]:
    """Open blocks take the label of their nearest decided neighbours on the page; the nearer one decides, and boilerplate at equal distance. In an article
    the neighbours are its own and it takes both to make a block boilerplate. A heading goes with what follows it. With no neighbour it is text. LINKS next to LINKS of
    an article are a menu, else open."""
    n = len(labels)
    menu = [label == LINKS and any(0 <= j < n and labels[j] == LINKS and articles[j] == articles[i] for j in (i - 1, i + 1)) for i, label in enumerate(labels)]
    out = [BAD if m else OPEN if label == LINKS else label for label, m in zip(labels, menu)]

    def nearest(order: Iterable[int]) -> list[int | None]:
        """For each block the last decided one before it in the order: on the page, and in its article, where boilerplate by markup doesn't count."""
        found, last = [None] * n, {}
        for i in order:
            found[i] = last.get(articles[i])
            if out[i] != OPEN:
                last[0] = i
                if articles[i] and (out[i] == GOOD or menu[i]):
                    last[articles[i]] = i
        return found

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    done = list(out)
    for i in range(n):
        if out[i] != OPEN:
            continue
        b, a = before[i], after[i]
        if a is None and b is None:
            done[i] = GOOD  # nothing speaks against it
        elif headings[i] and a is not None:
            done[i] = out[a]
        elif articles[i]:
            done[i] = BAD if a is not None and b is not None and out[a] == out[b] == BAD else GOOD
        elif a is None or b is None:
            done[i] = out[b if a is None else a]
        elif i - b == a - i:
            done[i] = min(out[a], out[b])
        else:
            done[i] = out[b if i - b < a - i else a]
    return done


def main_text(page: str | None) -> str:
    found = list(blocks_of(page or ""))
    no_stops = foreign(found)
    labels = second_pass([first_pass(t, k, v, p, no_stops) for t, k, v, _, _, p in found], [b[3] for b in found], [b[4] for b in found])
    return " ".join(t for (t, *_), label in zip(found, labels) if label == GOOD)


def extract_main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points), one row for each row of df."""
    part = df.select(*[df[c] for c in keep], df[html_col].alias("__html"))
    schema = part.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return part.mapInArrow(extract, schema)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
