"""Operator 6, HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags. Containers that name themselves
(``nav``, ``footer``, ``aside``, forms, or a class, id or role such as ``ad`` or
``comments``) decide their blocks as bad. Of the others, pass one decides by
link density, length and stop-word density: good, bad or ambiguous (short, or
too few stop words to tell). The stop words are those of four languages; long
blocks with few links that fit none of them are good by their length if they
are written in another script, or if they hold more of the page than the blocks
that fit one. Pass two gives each ambiguous block the label of
its nearest decided neighbours: good if both sides are good, or the nearer
side's label. The edge of an ``article`` or ``main`` element counts as a good
neighbour inside it, the edge of the page as a bad one; if a page has such an
element, blocks outside it are bad, unless they hold more good text than it
(a story beside teasers). Such an element in a bad container is bad like it,
unless the page has no other text.

Pages are independent, so every task reads its own; nothing is shuffled.

Cases: null and empty html give an empty text; unclosed tags end with their
container; a comment, script or style that never ends takes the rest of the
page; repeated rows are extracted alike; a null id or url is kept; extra
columns are ignored; an empty table gives an empty result."""
from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont avec son ou",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque",
}
RAW = "script style noscript template textarea svg iframe title head select option object canvas math".split()
BAD_TAGS = set("nav footer aside form header menu dialog button label fieldset".split())
BAD_NAMES = set("""ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation
breadcrumb breadcrumbs footer masthead cookie cookies consent notice popup modal newsletter subscribe subscription share
sharing social related recommended comment comments reply replies respond disqus widget toolbar pagination pager login
signup search hidden""".split())
CONTAINERS = set("""div section article main nav header footer aside form ul ol dl table figure menu dialog fieldset button label
details center""".split())
BLOCKS = CONTAINERS | set("p li h1 h2 h3 h4 h5 h6 td th tr tbody thead dt dd blockquote pre figcaption address hr body html caption "
                          "summary legend".split())

STOP = frozenset(w for line in STOP_WORDS.values() for w in line.split())
TOKENS = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?</(?P=raw)\s*>"
    r"|<(?:script|style)\b.*"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>?|<[a-zA-Z][^<>]*>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]")
LATIN = re.compile("[a-z\u00aa-\u024f\u1e00-\u1eff]")

GOOD, BAD, AMBIGUOUS, FOREIGN = 1, 0, -1, -2
#: An article or main element outside and inside a bad container.
OPEN, HELD = 1, 2


def named_bad(attrs: str) -> bool:
    if not attrs:
        return False
    for m in NAMES.finditer(attrs):
        if not BAD_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())):
            return True
    return bool(HIDDEN.search(attrs))


def blocks(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters within links, container is bad, the article it is
    within: 0, ``OPEN`` or ``HELD``)."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked, in_link = 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            _, bad, article = stack[-1] if stack else ("", False, 0)
            out.append((text, linked, bad, article))
        parts.clear()
        linked = 0

    for m in TOKENS.finditer(html):
        if m["text"] is not None:
            t = unescape(m["text"]) if "&" in m["text"] else m["text"]
            parts.append(t)
            if in_link:
                linked += len("".join(t.split()))
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            in_link = 0
            if tag not in CONTAINERS:
                continue
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif not m["attrs"].rstrip().endswith("/"):
                _, bad, article = stack[-1] if stack else ("", False, 0)
                own = named_bad(m["attrs"])
                if tag in ("article", "main"):
                    # an article opens a new region, unless a comment or the like
                    if own:
                        stack.append((tag, True, 0))
                    elif bad and not article:
                        stack.append((tag, False, HELD))
                    else:
                        stack.append((tag, bad, article or OPEN))
                else:
                    stack.append((tag, bad or own or tag in BAD_TAGS, article))
    close()
    return out


def classify(text: str, linked: int, max_link: float, short: int, stop_low: float) -> int:
    """Pass one on a block of a container that does not decide it."""
    size = len("".join(text.split()))
    if linked > max_link * size:
        return BAD
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words or (len(text) < short and len(text) + len(WIDE.findall(text)) < short):
        return BAD if linked else AMBIGUOUS
    density = sum(1 for w in words if w in STOP) / len(words)
    if density >= stop_low:
        return GOOD
    letters = "".join(words)
    return FOREIGN if 2 * len(LATIN.findall(letters)) >= len(letters) else GOOD


def choose(every: list[tuple[str, int, bool, int]], regions: tuple[int, ...], max_link: float, short: int,
           stop_low: float) -> str:
    """The text of the main blocks, with articles of ``regions`` as such."""
    n = len(every)
    inside = [article in regions and not bad for _, _, bad, article in every]
    labels = [BAD if bad or (article == HELD and HELD not in regions) else classify(text, linked, max_link, short, stop_low)
              for text, linked, bad, article in every]

    def chars(of) -> int:
        return sum(len(every[i][0]) for i in range(n) if of(i))

    # long blocks in no listed language: by length, if the page is mainly in none
    other = GOOD if chars(lambda i: labels[i] == FOREIGN) > chars(lambda i: labels[i] == GOOD) else AMBIGUOUS
    labels = [other if label == FOREIGN else label for label in labels]
    if any(inside) and chars(lambda i: inside[i] and labels[i] != BAD) >= chars(lambda i: not inside[i] and labels[i] == GOOD):
        labels = [label if own else BAD for label, own in zip(labels, inside)]
    else:
        inside = [False] * n
    before: list[tuple[int, int]] = []
    last = (BAD, -1)
    for i in range(n):
        if inside[i] and (i == 0 or not inside[i - 1]):
            last = (GOOD, i - 1)
        before.append(last)
        if labels[i] != AMBIGUOUS:
            last = (labels[i], i)
    last = (BAD, n)
    final = list(labels)
    for i in range(n - 1, -1, -1):
        if inside[i] and (i == n - 1 or not inside[i + 1]):
            last = (GOOD, i + 1)
        if labels[i] == AMBIGUOUS:
            (a, at), (b, bt) = before[i], last
            final[i] = a if a == b or i - at <= bt - i else b
        else:
            last = (labels[i], i)
    return " ".join(e[0] for e, label in zip(every, final) if label == GOOD)


def extract(html: str | None, max_link: float = 0.3, short: int = 70, stop_low: float = 0.1) -> str:
    """The text of the main blocks, joined by one space."""
    every = blocks(html or "")
    text = choose(every, (OPEN,), max_link, short, stop_low)
    if not text and any(article == HELD for *_, article in every):
        text = choose(every, (OPEN, HELD), max_link, short, stop_low)
    return text


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **rules) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per page; ``rules`` as in ``extract``."""
    def run(batches):
        for b in batches:
            text = [extract(h.as_py(), **rules) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
