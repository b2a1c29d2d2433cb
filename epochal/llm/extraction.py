"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one a block element, each with the length of its
text; links and boilerplate elements count nothing. Elements with a listed class
or id and forms are boilerplate unless they hold most of the page's text. Inside an article
the names of headings don't count, and of those of its paragraphs and sections only what
names adverts and comments. Lengths are summed over sliding windows of lines. The main part lies between the first window that
surges over the threshold and the dive after the last one. A line of an
``article`` or ``main`` element counts as a surge at least, as does the first
top heading of a page without one, so short first and last paragraphs aren't lost.

Null or empty pages give an empty text; pages may have any length. Each row stands alone: repeated rows
give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import binary_column, table

# Element names by the part they play, words of class and id names.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("nav header footer aside form script style noscript template head iframe svg button select textarea object canvas dialog menu".split())
RAW = set("script style textarea title noscript iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|menu|nav|navbar|navigation|newsletter|notice|popup|promo|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?=$|[\s_-])", re.I)
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert)\b", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
NAME = re.compile(r"(?<![\w-])(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|not|non|with|without|has|hide|show)[_-][\w-]*", re.I)
# Of these names, those that count on a paragraph or section of an article; there a name is mostly an anchor.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|cookies?|disqus|newsletter|promo|sponsor\w*|subscribe)(?=$|[\s_-])", re.I)
HEADINGS, PASSAGES = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "section"}
TALK = re.compile(r"(?:^|[\s_-])(?:comments?|disqus)(?=$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"\w")


def kept_parts(page: str) -> frozenset[int]:
    """Where forms and elements with a listed name start that hold the page's text.

    A name is evidence alone: an element stays if at least half of the text in
    articles lies in it, or of all text on a page without articles. Comments
    don't, and a named element that isn't large goes as before."""
    parts: dict[int, list] = {}  # start: text, text in articles, comments or not
    whole = [0, 0]
    lines_of(page, None, parts, whole)
    k = int(whole[1] > 0)
    return frozenset(at for at, x in parts.items() if not x[2] and x[k] and 2 * x[k] >= whole[k])


def lines_of(page: str, kept: frozenset[int] | None = frozenset(), parts_of: dict | None = None, whole: list | None = None) -> list[tuple[str, int, int, str]]:
    """(text, counted length, number of its article or 0, its element) of each block.

    ``kept``: starts of named elements and forms that aren't dropped; None keeps
    all, and their text is added up in ``parts_of``, that of the page in ``whole``."""
    soft: list[tuple] = []  # of the named elements around: depth, start, the page's text before, comments or not
    total = [0, 0] if whole is None else whole
    open_names: Counter[str] = Counter()
    out: list[tuple[str, int, int, str]] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked = at = articles = 0
    own = False  # whether the line has words outside links

    def end_line():
        nonlocal linked, own
        text = SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append((text, max(0, len(text) - linked) * own, stack[-1][2] if stack else 0, next((x[0] for x in reversed(stack) if x[0] in BLOCKS), "")))
        parts.clear()
        linked, own = 0, False

    def close(name: str):
        if open_names[name]:
            while True:
                gone = stack.pop()[0]
                open_names[gone] -= 1
                if gone == name:
                    break
            settle(len(stack))

    def settle(depth: int):
        """What lies in the named elements that are closed now."""
        while soft and soft[-1][0] >= depth:
            _, start, size, inner, talk = soft.pop()
            parts_of[start] = [total[0] - size, total[1] - inner, talk]

    while at <= len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not (stack and stack[-1][1]):
            parts.append(piece)
            if whole is not None and not any(x[0] == "a" for x in stack[-6:]):
                size = len(SPACE.sub(" ", piece).strip())
                total[0] += size
                total[1] += size * bool(stack and stack[-1][2])
            if any(x[0] == "a" for x in stack[-6:]):
                linked += len(piece)
            else:
                own = own or WORDS.search(piece) is not None
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCKS or name in DROPPED:
            end_line()
        if name == "br":
            parts.append(" ")
        if m[1]:
            close(name)
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            for open_name in ("p", *(["li"] if name == "li" else [])):
                if stack and open_name in [x[0] for x in stack[-4:]]:
                    close(open_name)
        inside = stack[-1] if stack else ("", False, 0)
        names = [LAYOUT.sub("", x.strip("\"'")) for _, x in NAME.findall(m[3])] if name not in ("body", "html", "article", "main") else []
        roles = NAMED if not inside[2] or name not in HEADINGS | PASSAGES else FOREIGN
        named = name == "form" or not (inside[2] and name in HEADINGS) and any(map(roles.search, names))
        if named and parts_of is not None and name not in RAW:
            soft.append((len(stack), m.start(), *total, any(map(TALK.search, names))))
        named = named and kept is not None and m.start() not in kept
        # a heading block of an article is its own, not the page's
        drop = inside[1] or (name in DROPPED and name != "form" and not (name == "header" and inside[2])) or named or bool(ROLES.search(m[3]))
        if name in ("article", "main") and not inside[2]:
            articles += 1
            inside = (name, drop, articles)
        if name in RAW:
            e = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = e.end() if e else len(page)
            continue
        stack.append((name, drop, inside[2]))
        open_names[name] += 1
    end_line()
    settle(0)
    return out


def weighed(lines: list[tuple[str, int, int, str]], surge: int) -> list[int]:
    """What each line counts: its text outside links, and a surge at least for a line
    in an article or a first heading. Lines outside count nothing on a page whose
    articles hold at least half of the text."""
    inside = sum(n for _, n, article, _ in lines if article)
    alone = inside and 2 * inside >= sum(n for _, n, _, _ in lines)
    out, headings = [], 0
    for _, n, article, name in lines:
        headings += name == "h1"
        title = name == "h1" and headings == 1 and n > 0
        out.append(max(n, surge) if article or title and not alone else 0 if alone else n)
    return out


def main_text(page: str, window: int = 3, surge: int = 60) -> str:
    """The lines between the first surge of the window sums and the last dive."""
    lines = lines_of(page, kept_parts(page))
    counts = weighed(lines, surge)
    sums = [sum(counts[i : i + window]) for i in range(len(lines))]
    high = [i for i, s in enumerate(sums) if s >= surge]
    if not high and any(sums):
        top = max(sums)
        high = [i for i, s in enumerate(sums) if s == top]
    if not high:
        return ""
    first, last = high[0], min(len(lines) - 1, high[-1] + window - 1)
    while first < last and not counts[first]:
        first += 1
    while last > first and not counts[last]:
        last -= 1
    only = any(x[2] and n for x, n in zip(lines, counts, strict=True)) and not any(n for x, n in zip(lines, counts, strict=True) if not x[2])
    return "\n".join(x[0] for x in lines[first : last + 1] if x[2] or not only)


def extracted(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [main_text(h.decode("utf-8", "replace")) for h in binary_column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
