"""Main text of web pages by a linear-chain conditional random field over their text blocks.

A page is read into blocks: runs of text between the tags that start or end a block. Each block has
features of its ancestors (tags, and the words of their class, id and role), of the box that it stands in
(links, buttons, its share of the page, its place before, in or after the box with the most running text,
boxes like it beside it) and of its text. A chain with two labels, article and surroundings, is trained on
labelled pages, many of them with names that say nothing, and decoded by Viterbi's algorithm. Text in menus,
forms, buttons and footers is never the article's: those labels are given before decoding.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, bounded, slices

#: Hashed feature space, labelled pages to train on, and rounds over them.
FEATURES, TRAINING_PAGES, ROUNDS = 1 << 13, 1100, 70

#: The words in class, id and role (and in the names of custom elements) that are features, in several
#: languages; the generated pages use them too.
OF_ARTICLES = "article artikel artigo articolo articulo beitrag blog body contenido contenu content copy cuerpo detail document entry inhalt main markdown news noticia page post primary prose single story text texte texto".split()
OF_MENUS = "bar breadcrumb breadcrumbs contents hauptmenue inhaltsverzeichnis menu menue nav navbar navigation navegacion pager pagination skip tabs toc topbar".split()
OF_HEADERS, OF_FOOTERS, OF_SIDES = "banner header kopf kopfzeile logo masthead tagline".split(), "bottom colophon copyright foot footer fuss fusszeile impressum legal pie pied rodape".split(), "aside barre complementary lateral rail randspalte seitenleiste side sidebar widget widgets".split()
OF_ADVERTS = "ad ads advert advertisement annonce anuncio anzeige promo promoted pub publicidad publicidade publicite pubblicita sponsor sponsored teaser werbung".split()
OF_NOTICES = "alert aviso consent cookie cookies dialog gdpr hinweis modal notice overlay popup toast warning".split()
OF_FORMS = "anmeldung buscar contact form formular formulaire formulario kontakt login newsletter recherche register search signup subscribe suche".split()
OF_LINKS = "mehr more popular recommended related relacionados share sharing similaires social tags teilen trending verwandt".split()
OF_COMMENTS = "comentario comentarios comment commentaire commentaires commentlist comments commenti disqus discussion feedback kommentar kommentare reacties replies reply respond responses thread".split()
OF_PARTS = "abstract author byline caption code date dateline example figure heading intro lead meta note quote references section standfirst subtitle summary table time tip title".split()
OF_LAYOUT = "app area block box card col column columns container grid inner item layout left list outer panel right root row site view wrap wrapper".split()
MARKS = frozenset(sum((OF_ARTICLES, OF_MENUS, OF_HEADERS, OF_FOOTERS, OF_SIDES, OF_ADVERTS, OF_NOTICES, OF_FORMS, OF_LINKS, OF_COMMENTS, OF_PARTS, OF_LAYOUT), []))
#: A word's weight is learnt for itself and for its group, so that rare words and other languages count.
GROUPS = {w: k for k, words in enumerate((OF_ARTICLES, OF_MENUS, OF_HEADERS, OF_FOOTERS, OF_SIDES, OF_ADVERTS, OF_NOTICES, OF_FORMS, OF_LINKS, OF_COMMENTS)) for w in words}

#: Words that tell in a text what it is about.
SAYS = {
    "cookies": "consent cookie cookies datenschutz privacidad privacy tracking vie".split(),
    "reply": "antworten comentario comentarios commentaire commentaires comment comments commenti discussion kommentar kommentare reacties replies reply responder responses répondre".split(),
    "advert": "advertisement advertorial annonce anuncio anzeige publicidad publicité pubblicità sponsored sponsorisé werbung".split(),
    "legal": "copyright derechos droits impressum mentions reserved reservados rights réservés terms vorbehalten".split(),
    "share": "compartir facebook follow linkedin partager share teilen tweet twitter whatsapp".split(),
    "join": "abonnieren abonnez newsletter register subscribe suscríbete".split(),
}
_SAYS = {w: kind for kind, words in SAYS.items() for w in words}

#: Elements without content of their own, elements whose text is never shown, elements whose content is no
#: markup, and elements inside a line that say nothing about the text in them.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object select textarea canvas audio video datalist annotation annotation-xml".split())
RAW = frozenset("script style noscript title textarea iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr br "
                   "math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mphantom menclose merror mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd annotation annotation-xml".split())
#: Elements that start and end a block.
BLOCK = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html input "
                  "legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
#: A start tag of these ends an open p; within these an open p further out counts no more; what may stand in a head.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split())
P_SCOPE = frozenset("html table td th caption button object template marquee".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag of the key ends an open element of its kind (an item, a term or its definition, a row, a cell), up to the list or table around it.
KINDS = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}
AROUND = frozenset("ul ol dl table body html menu".split())
_NONE = (-1, -1, -1, -1)
#: Elements that hold blocks; those whose text is never the article's; those that a visitor fills in or presses.
BOXES = frozenset("address article aside blockquote body center dd details div dl fieldset figure footer form header hgroup li main menu nav ol section table td th tr ul".split())
NEVER = frozenset("nav menu button footer".split())
TOOLS = frozenset("button input label select textarea".split())

_MARKUP = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*+)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)?))?")
_TAG_END = re.compile(r"[\s/]*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_NO_DISPLAY = re.compile(r"(?:\A|[;\s])display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TOLD = re.compile(r"\w+")
_COUNTED = re.compile(r"\(?\d+\)? \w+(?: \w+)?:?|\w+ ?\(\d+\)")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=1 << 16)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


_FORM, _ASIDE = frozenset({_slot("in=form")}), frozenset({_slot("in=aside"), _slot("inner=aside")})


class Block:
    """A run of text, the tag that it stands in, the features of all its ancestors, how much of it is inside links, its box
    and whether its ancestors rule it out (`never`, or the number of the form that it stands in)."""

    __slots__ = ("ancestors", "box", "form", "linked", "near", "never", "parent", "text")

    def __init__(self, text: str, linked: int, top: _Open | None) -> None:
        self.text, self.linked = text, linked
        self.parent, self.ancestors = (top.parent, top.ancestors) if top else ("", frozenset())
        self.box, self.never, self.form, self.near = (top.box, top.never, top.form, top.near) if top else (0, False, -1, "")


class Boxes:
    """The boxes of a page in the order of their start tags; the first one is the page itself."""

    def __init__(self) -> None:
        self.around, self.first, self.last, self.kind, self.tools = [-1], [0], [0], [""], [0]
        self.wide: set[int] = set()  # forms around a whole page

    def open(self, around: int, at: int, kind: str) -> int:
        for column, value in zip((self.around, self.first, self.last, self.kind, self.tools), (around, at, at, kind, 0), strict=True):
            column.append(value)
        return len(self.around) - 1


class _Open:
    """An open element. What it takes over from the elements around it is held here, so that no step looks through the stack."""

    __slots__ = ("ancestors", "box", "foreign", "form", "hidden", "inside", "items", "near", "never", "p_at", "parent", "quoted", "tag")

    def __init__(self, tag: str, around: _Open | None, at: int, hides: bool, marks: list[str]) -> None:
        self.tag = tag
        self.hidden = hides or (around is not None and around.hidden)
        self.foreign = tag in ("svg", "math") or (around is not None and around.foreign)
        self.p_at = at if tag == "p" else -1 if around is None or tag in P_SCOPE else around.p_at
        items = _NONE if around is None or tag in AROUND else around.items
        kind = KINDS.get(tag)
        self.items = items if kind is None else items[:kind] + (at,) + ((-1,) if kind == 2 else items[kind + 1 :])[: 3 - kind]
        self.ancestors, self.parent = (around.ancestors, around.parent) if around else (frozenset(), "")
        self.box, self.form = (around.box, around.form) if around else (0, -1)
        self.inside = tag in ("article", "main") or (around is not None and around.inside)
        self.near = around.near if around else ""  # the group of the innermost name that tells one
        self.quoted = tag == "blockquote" or (around is not None and around.quoted)
        self.never = (tag in NEVER and not (tag == "footer" and self.quoted)) or (around is not None and around.never)  # a quote's footer names its author
        if tag not in INLINE:
            self.parent = tag
            own = {_slot(f"mark={w}") for w in marks} | {_slot(f"named={GROUPS[w]}") for w in marks if w in GROUPS}
            if tag in BLOCK:
                own.add(_slot(f"inner={tag}" if tag in ("aside", "header") and around is not None and around.inside else f"in={tag}"))
            told = [GROUPS[w] for w in marks if w in GROUPS]
            if told:
                self.near = f"near={max(told)}"
            if not own <= self.ancestors:  # there are as many as known tags and marks at most, however deep the page
                self.ancestors = self.ancestors | own


def blocks(page: str | None) -> list[Block]:
    """The shown text blocks of a page in order."""
    return blocks_and_boxes(page)[0]


def blocks_and_boxes(page: str | None) -> tuple[list[Block], Boxes]:
    """The shown text blocks of a page in order, white space collapsed and references decoded, and the boxes that hold them.

    Tags and attributes end where the HTML standard has them end. Time and memory are linear in the page, also
    where markup is broken or nested without end; never raises.
    """
    page = page or ""
    out: list[Block] = []
    boxes = Boxes()
    stack: list[_Open] = []
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked, at, link = 0, 0, -1  # link: depth of the stack where a link was opened

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, stack[-1] if stack else None))
            if out[-1].form >= 0 and out[-1].parent == "h1":
                boxes.wide.add(out[-1].form)
        parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
            if node.tag in BOXES:
                boxes.last[node.box] = len(out)
        del stack[depth:]
        if len(stack) < link:
            link = -1

    def add(text: str) -> None:
        nonlocal linked
        if not text:
            return
        if stack and stack[-1].tag == "head" and not text.isspace():
            pop_to(len(stack) - 1)
        if not (stack and stack[-1].hidden):
            text = html.unescape(text)
            parts.append(text)
            if link >= 0:
                linked += len(text.strip())

    while True:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0] == "<!--":  # also ended by > alone right after it
                short = page.startswith((">", "->"), at)
                end = None if short else _COMMENT_END.search(page, at)
                at = page.index(">", at) + 1 if short else end.end() if end else len(page)
            else:
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
            continue
        tag, ends = m[2].lower(), bool(m[1])
        marks, kind_of, hides, seen = [], tag, tag in HIDDEN or tag == "dialog", set()
        while (a := _ATTRIBUTE.match(page, at)) is not None:
            at = a.end()
            name = a[1].lower()
            if ends or name in seen or name not in ("class", "id", "role", "hidden", "style", "open"):
                continue
            seen.add(name)
            value = a[2] or a[3] or a[4] or ""
            if name == "hidden" or (name == "style" and _NO_DISPLAY.search(value)):
                hides = True
            elif name == "open":
                hides = hides and tag != "dialog"
            elif name != "style":
                if name == "class":
                    kind_of = f"{tag} {value[:200]}"
                marks += [w for x in _WORD.findall(value) if (w := x.lower()) in MARKS]
        at = _TAG_END.match(page, at).end()
        if at >= len(page):  # a tag without an end
            break
        closed = page[at - 1] == "/"
        at += 1
        if tag in BLOCK:
            close()
        elif tag == "br" and not (stack and stack[-1].hidden):
            parts.append(" ")
        if ends:
            if open_tags[tag] and tag not in VOID:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            if tag == "a":
                link = -1
            continue
        top = stack[-1] if stack else None
        if top is not None and top.tag == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in ENDS_P and stack and stack[-1].p_at >= 0:
            pop_to(stack[-1].p_at)
        kind = KINDS.get(tag)
        if kind is not None and stack and stack[-1].items[kind] >= 0:
            pop_to(stack[-1].items[kind])
        top = stack[-1] if stack else None
        if tag in TOOLS:
            boxes.tools[top.box if top else 0] += 1
        if tag in VOID or (closed and (tag in ("svg", "math") or (top is not None and top.foreign))):
            continue
        if tag in RAW:  # up to its own end tag, whatever stands inside
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        if "-" in tag:  # a custom element
            marks += [w for w in tag.split("-") if w in MARKS]
        node = _Open(tag, top, len(stack), hides, [] if tag == "form" else marks)  # a form around the page says nothing
        if tag in BOXES:
            node.box = boxes.open(node.box, len(out), _DIGITS.sub("0", kind_of))
            if tag == "form":
                node.form = node.box
            elif tag in ("article", "main") and node.form >= 0:
                boxes.wide.add(node.form)
        stack.append(node)
        open_tags[tag] += 1
        if tag == "a":
            link = len(stack)
    close()
    pop_to(0)
    boxes.last[0] = len(out)
    return out, boxes


def features(block: Block) -> tuple[str, ...]:
    """Features of a block's tag and text."""
    text = block.text
    words = text.count(" ") + 1
    stops = sum(text.count(c) for c in ".!?。！？")
    told = {kind for w in _TOLD.findall(text[:2000].lower()) if (kind := _SAYS.get(w))}
    size = "short" if words <= 8 else "long"
    return (
        "bias",
        f"parent={block.parent}",
        block.near,
        f"words={min(words, 64).bit_length()}",
        f"linked={4 * block.linked // max(1, len(text))}",
        f"stops={min(stops, 4)}",
        f"end={text[-1] if text[-1] in '.!?:,' else 'a' if text[-1].isalnum() else '-'}",
        f"start={'A' if text[0].isupper() else 'a' if text[0].isalpha() else '-'}",
        *(f"sign={c}" for c in "©®|»·" if c in text),
        *(f"says={kind} {size}" for kind in told),
    )


def page_features(found: list[Block], boxes: Boxes) -> tuple[list[int], list[tuple[int, ...]]]:
    """The numbers of the blocks that can be the article's, and their hashed features. Linear in the page."""
    length, linked = [0], [0]
    for b in found:
        length.append(length[-1] + len(b.text))
        linked.append(linked[-1] + min(b.linked, len(b.text)))
    n = len(boxes.around)
    holds = list(range(n))  # a box with one block at most counts as a part of the box around it
    tools, like = [0] * n, Counter()
    for k in range(n):
        if k and boxes.last[k] - boxes.first[k] <= 1:
            holds[k] = holds[boxes.around[k]]
        tools[holds[k]] += boxes.tools[k]
        if boxes.last[k] > boxes.first[k] and " " in boxes.kind[k]:
            like[boxes.around[k], boxes.kind[k]] += 1
    ruled = [b.never or (b.form >= 0 and b.form not in boxes.wide) for b in found]
    running: Counter = Counter()
    for b, out in zip(found, ruled, strict=True):
        own = len(b.text) - b.linked
        if not out and own > 0 and b.near in ("", "near=0") and not _ASIDE & b.ancestors and (b.text.count(" ") >= 8 or b.text[-1] in ".!?。！？"):
            box, share = holds[b.box], float(own)
            for _ in range(3):  # the boxes around it count half and a quarter
                running[box] += share
                if not box:
                    break
                box, share = holds[boxes.around[box]], share / 2
    most = max(running, key=lambda k: (running[k], -k), default=0)
    at, out, since = [], [], False
    for i, b in enumerate(found):
        if ruled[i]:
            continue
        box = holds[b.box]
        lo, hi = boxes.first[box], boxes.last[box]
        size = max(1, length[hi] - length[lo])
        place = "in" if box == most else "before" if i < boxes.first[most] else "after" if i >= boxes.last[most] else "under"
        share = 4 * size // max(1, length[-1])
        mine = features(b)
        counted = _COUNTED.fullmatch(b.text) is not None
        since = since or (b.parent not in ("p", "li", "td", "th") and (counted or "says=reply short" in mine))
        kind = boxes.kind[b.box]
        at.append(i)
        above = b.ancestors - _FORM if b.form in boxes.wide else b.ancestors
        out.append((*above, *map(_slot, (
            *mine,
            f"place={place}",
            f"{b.near} linked={2 * b.linked // max(1, len(b.text))}",
            f"{b.near} {place}",
            f"place={place} {'h' if b.parent[:1] == 'h' else ''} {min(share, 1)}",
            f"box linked={4 * (linked[hi] - linked[lo]) // size}",
            f"box share={share}",
            f"box tools={min(2, tools[box])} {min(share, 2)}",
            f"box tools={min(2, tools[box])} {place}",
            f"like={min(like[boxes.around[b.box], kind], 4) if ' ' in kind else 0} {place}",
            f"since={since} {place}",
            f"counted={counted}",
        ))))
    return at, out


class Chain:
    """Weights of a linear chain with two labels: 0 surroundings, 1 article."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def scores(self, page: list[tuple[int, ...]]) -> np.ndarray:
        size = np.array([len(f) for f in page])
        flat = np.fromiter(chain.from_iterable(page), dtype=np.int64, count=int(size.sum()))
        return np.add.reduceat(self.emit[flat], np.concatenate([[0], np.cumsum(size)[:-1]]))

    def decode(self, page: list[tuple[int, ...]]) -> list[int]:
        """The most likely labels (Viterbi); ties go to the surroundings."""
        if not page:
            return []
        score = self.scores(page).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0]
        back = []
        for x, y in score[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + m00 if from_a else b + m10) + x, (a + m01 if from_b else b + m11) + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[list[tuple[int, ...]]], labels: list[list[int]], rounds: int = ROUNDS, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by gradient steps (Adam) over all pages at once, with forward and backward sums."""
    by_length = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
    pages, labels = [pages[k] for k in by_length], [labels[k] for k in by_length]
    n, longest = len(pages), max(map(len, pages))
    mask = np.zeros((n, longest), dtype=bool)
    gold = np.zeros((n, longest), dtype=np.int64)
    for k, y in enumerate(labels):
        mask[k, : len(y)], gold[k, : len(y)] = True, y
    flat = np.concatenate([np.array(f) for p in pages for f in p])
    size = np.array([len(f) for p in pages for f in p])
    first, owner = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(size)), size)
    truth = np.eye(2)[gold[mask]]
    seen = np.zeros((2, 2))
    both = mask[:, 1:]
    ends, page_of, pair_of = mask.sum(axis=1) - 1, np.nonzero(mask)[0], np.nonzero(both)[0]
    active = mask.sum(axis=0)  # pages that reach this far; they come first
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    weights = [np.zeros((FEATURES, 2)), np.zeros((2, 2))]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        emit, move = weights
        score = np.zeros((n, longest, 2))
        score[mask] = np.add.reduceat(emit[flat], first)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            m = active[t]
            ahead[:m, t] = np.logaddexp(ahead[:m, t - 1, :1] + move[0], ahead[:m, t - 1, 1:] + move[1]) + score[:m, t]
        for t in range(longest - 2, -1, -1):
            m = active[t + 1]
            to = behind[:m, t + 1] + score[:m, t + 1]
            behind[:m, t] = np.logaddexp(move[:, 0] + to[:, :1], move[:, 1] + to[:, 1:])
        total = np.logaddexp(ahead[np.arange(n), ends, 0], ahead[np.arange(n), ends, 1])
        marginal = np.exp((ahead + behind)[mask] - total[page_of, None])
        pair = ahead[:, :-1][both][:, :, None] + move + (score + behind)[:, 1:][both][:, None, :] - total[pair_of, None, None]
        expected = np.exp(pair).sum(axis=0)
        off = (truth - marginal)[owner]
        grad_emit = np.stack([np.bincount(flat, off[:, k], FEATURES) for k in (0, 1)], axis=1)
        for k, g in enumerate((grad_emit / n - decay * emit, (seen - expected) / n - decay * move)):
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g * g
            weights[k] = weights[k] + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Chain(*weights)


class _Page:
    """Builds one labelled page: parts of usual layouts, dealt at random, with the label of each block of text."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.gold = rng, []
        self.nameless = self.some(0.3)  # no name says anything

    def some(self, odds: float) -> bool:
        return self.rng.random() < odds

    def words(self, lo: int, hi: int) -> str:
        syllables = "ba co de fi gu lan mer nor pol quis ran sto tur vel win xo yer zam the and".split()
        return " ".join("".join(self.rng.choice(syllables) for _ in range(self.rng.randint(1, 3))) for _ in range(self.rng.randint(lo, hi)))

    def sentence(self, lo: int = 4, hi: int = 25) -> str:
        text = self.words(lo, hi).capitalize()
        if self.some(0.03):  # an article may speak of all this too
            text += " " + self.telling()
        if self.some(0.2):
            text = text.replace(" ", ", ", 1)
        return text + self.rng.choice((".", ".", ".", "!", "?"))

    def telling(self, kind: str | None = None) -> str:
        return self.rng.choice(SAYS[kind or self.rng.choice(list(SAYS))])

    def title(self, lo: int, hi: int) -> str:
        text = self.words(lo, hi).capitalize()
        return text.replace(" ", self.rng.choice((" | ", " » ", " · ", ": ")), 1) if self.some(0.12) else text + self.rng.choice(("", "", "", "?", ".", "!"))

    def sentences(self, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def block(self, text: str, label: int) -> str:
        self.gold.append((" ".join(text.split()), label))
        text = html.escape(text, quote=False).replace(" ", self.rng.choice((" ", " ", "\n  ")))
        if " " in text and self.some(0.15):  # markup inside the line
            first, rest = text.split(" ", 1)
            text = self.rng.choice(("<b>{}</b> {}", "<em>{}</em> {}", '<a href="/x">{}</a> {}', '<span class="x">{}</span> {}')).format(first, rest)
        return text

    def named(self, tag: str, words: list[str], inner: str, odds: float = 0.85) -> str:
        """An element with a class or id of one or two of the words, or one that says nothing."""
        if self.some(odds) and not self.nameless:
            name = self.rng.choice("- _").join(self.rng.sample(words, min(len(words), self.rng.choice((1, 1, 2)))))
        else:
            name = self.words(1, 1)
        return f'<{tag} {self.rng.choice(("class", "class", "id"))}="{name}">{inner}</{tag}>'

    def plain(self, tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag}>"

    def links(self, label: int = 0) -> str:
        tag = self.rng.choice(("ul", "ul", "ol", "div"))
        form = "{}" if self.some(0.1) else '<a href="/x">{}</a>'
        shown = [form.format(html.escape(self.words(1, 4))) for _ in range(self.rng.randint(2, 8))]
        if tag == "div":
            self.gold.append((re.sub("<[^>]*>", "", " ".join(shown)), label))
            return self.plain(tag, " ".join(shown))
        self.gold += [(re.sub("<[^>]*>", "", x), label) for x in shown]
        return self.plain(tag, "".join(self.plain("li", x) for x in shown))

    # Parts of an article.
    def paragraph(self) -> str:
        text = self.block(self.sentences(self.rng.choice((1, 2, 4, 7))), 1)
        kind = self.rng.random()
        if kind < 0.08:
            return f"<p><b>{text}<br>"  # left open
        if kind < 0.14:
            return f"<blockquote><p>{text}</p></blockquote>"
        return self.plain("div", text) if kind < 0.2 else self.named("p", OF_PARTS, text) if kind < 0.25 else self.plain("p", text)

    def cells(self) -> str:
        head = self.plain("caption", self.block(self.words(2, 8).capitalize(), 1)) if self.some(0.4) else ""
        width = self.rng.randint(2, 4)
        rows = ["".join(self.plain("th", self.block(self.words(1, 2).capitalize(), 1)) for _ in range(width))] if self.some(0.7) else []
        for _ in range(self.rng.randint(1, 5)):
            rows.append("".join(self.plain("td", self.block(self.rng.choice((self.words(1, 3), str(self.rng.randint(1, 9999)), self.sentence(3, 9))), 1)) for _ in range(width)))
        return self.plain("table", head + "".join(self.plain("tr", r) for r in rows))

    def terms(self) -> str:
        return self.plain("dl", "".join(self.plain("dt", self.block(self.words(1, 3), 1)) + self.plain("dd", self.block(self.rng.choice((self.sentence(), self.words(1, 6))), 1)) for _ in range(self.rng.randint(1, 5))))

    def picture(self) -> str:
        shown = '<img src="/x.png" alt="x">'
        return self.plain("figure", shown + (self.plain("figcaption", self.block(self.rng.choice((self.sentence(3, 14), self.words(2, 6))), 1)) if self.some(0.85) else ""))

    def items(self) -> str:
        return self.plain(self.rng.choice(("ul", "ol")), "".join(self.plain("li", self.block(self.rng.choice((self.sentence(3, 16), self.words(1, 6))), 1)) for _ in range(self.rng.randint(2, 6))))

    def code(self) -> str:
        return self.plain("pre", self.rng.choice(("{}", "<code>{}</code>")).format(self.block(self.words(3, 14) + self.rng.choice((";", " {", ")", "")), 1)))

    def byline(self) -> str:
        text = self.block(self.rng.choice(("By ", "", "Published ", "Updated ")) + self.words(1, 4).title() + self.rng.choice(("", ", 3 May 2021", " | 12:40")), 1)
        return self.named(self.rng.choice(("p", "div", "address")), ["author", "byline", "date", "dateline", "meta", "time"], text)

    def heading(self, tag: str) -> str:
        return self.plain(tag, self.block(self.title(2, 10), 1))

    def article(self) -> str:
        out = []
        if self.some(0.85):
            head = self.heading("h1") + (self.byline() if self.some(0.35) else "") + (self.named("p", ["intro", "lead", "standfirst", "subtitle", "summary"], self.block(self.sentence(), 1)) if self.some(0.2) else "")
            out.append(self.plain("header", head) if self.some(0.15) else head)
        for _ in range(self.rng.choice((1, 1, 2, 2, 3, 5, 10))):
            out.append(self.paragraph())
            if self.some(0.4):
                part = self.rng.choice((lambda: self.heading(self.rng.choice(("h2", "h3"))), self.items, self.items, self.cells, self.terms, self.picture, self.picture, self.code, self.advert, self.advert, self.sharing, self.contents, self.form, lambda: self.plain("section", self.heading("h2") + self.paragraph()), lambda: self.named("div", ["box", "example", "note", "tip"], self.paragraph())))
                out.append(part())
        return "".join(out)

    # Whatever is around it.
    def advert(self) -> str:
        if self.nameless:  # told by its words or by its link
            return self.named("div", OF_ADVERTS, self.plain("p", self.block(self.telling("advert").capitalize() + self.rng.choice(("", ": " + self.sentence())), 0)))
        text = self.rng.choice((lambda: self.block(self.sentence(1, 4), 0), lambda: self.block(self.sentences(2), 0), lambda: self.plain("p", self.block(self.sentence(), 0)), lambda: self.plain("h3", self.block(self.words(2, 5), 0)) + self.plain("p", self.block(self.sentences(2), 0))))()
        return self.named(self.rng.choice(("div", "div", "div", "aside", "section")), OF_ADVERTS + ["banner"], text, 1)

    def contents(self) -> str:
        head = self.plain(self.rng.choice(("p", "div", "h2")), self.block(self.words(1, 2).capitalize(), 0)) if self.some(0.6) else ""
        return self.named(self.rng.choice(("div", "div", "ul")), ["contents", "inhaltsverzeichnis", "toc"], head + self.links(), 1)

    def sharing(self) -> str:
        if self.nameless or self.some(0.3):
            return self.named("div", OF_LINKS, self.block(self.telling("share").capitalize() + " " + self.words(1, 2), 0), 1)
        return self.named(self.rng.choice(("div", "ul")), OF_LINKS, self.block(self.words(1, 4), 0), 1)

    def notice(self) -> str:
        text = self.sentences(2)
        if self.some(0.75):
            text = text.replace(" ", f" {self.telling('cookies')} ", 1)
        return self.named("div", OF_NOTICES, self.plain("p", self.block(text, 0)) + self.plain("button", self.block(self.words(1, 2), 0)), 1)

    def form(self) -> str:
        text = self.plain("p", self.block(self.sentences(3), 0)) if self.some(0.5) else ""
        if self.some(0.25):  # fields without a form
            return self.named("div", OF_FORMS, self.plain("p", self.block(self.sentence(), 0)) + f'<input name="q"><button>{self.block(self.words(1, 2), 0)}</button>', 1)
        inner = f'<form action="/s">{text}<label>{self.block(self.words(1, 3), 0)}</label><input name="q"><button>{self.block(self.words(1, 2), 0)}</button></form>'
        return self.named("div", OF_FORMS, inner) if self.some(0.4) else inner

    def comments(self) -> str:
        tag = self.rng.choice(("section", "div", "ol"))
        item = "li" if tag == "ol" else "div"
        rows, at, name = [], len(self.gold), self.words(1, 1)
        for _ in range(self.rng.randint(1, 4)):
            who = self.plain(self.rng.choice(("div", "h4", "p")), self.block(self.words(1, 2).title(), 0)) if self.some(0.5) else ""
            rows.append(self.named(item, ["comment", "comentario", "commentaire", "kommentar", "reply", "item"], who + self.plain("p", self.block(self.sentences(4), 0)), 0.9) if self.some(0.8) and not self.nameless else f'<{item} class="{name}">{who}{self.plain("p", self.block(self.sentences(4), 0))}</{item}>')
        # The heading comes first in the page, and so among the labels.
        told = self.words(1, 1) if self.some(0.4) else self.telling("reply")
        head = self.rng.choice((f"{len(rows)} {told}", f"{told.capitalize()} ({len(rows)})", told.capitalize())) if (self.nameless or self.some(0.5)) and tag != "ol" else ""
        if head:
            self.gold.insert(at, (head, 0))
        return self.named(tag, OF_COMMENTS, (self.plain(self.rng.choice(("h2", "h3", "div")), head) if head else "") + "".join(rows), 1)

    def related(self) -> str:
        teasers = "".join(self.plain("div", self.plain("h4", self.block(self.words(2, 7), 0)) + self.plain("p", self.block(self.sentence(), 0))) for _ in range(self.rng.randint(1, 3)))
        return self.named(self.rng.choice(("section", "div", "aside")), OF_LINKS, self.plain("h3", self.block(self.words(1, 3).capitalize(), 0)) + (teasers if self.some(0.5) else self.links()), 1)

    def sidebar(self) -> str:
        if self.some(0.25):
            return self.plain("aside", self.plain("p", self.block(self.sentences(2), 0)))
        inner = self.plain("h3", self.block(self.words(1, 3).capitalize(), 0)) + self.links() + (self.plain("p", self.block(self.sentences(2), 0)) if self.some(0.6) else "") + (self.form() if self.some(0.2) else "")
        return self.named("aside", OF_SIDES, inner, 0.6) if self.some(0.6) else self.named("div", OF_SIDES, inner, 1)

    def menu(self) -> str:
        inner = self.links()
        return self.plain("nav", inner) if self.some(0.6) else self.named("div", OF_MENUS, inner, 1)

    def header(self) -> str:
        if self.some(0.25):
            tag = self.rng.choice(("div", "header", f"x-{self.rng.choice(OF_HEADERS)}"))
            return self.named(tag, OF_HEADERS, f'<a href="/">{self.block(self.words(1, 2).title(), 0)}</a>', 1)
        inner = self.rng.choice(('<div class="logo">{}</div>', "<a href='/'>{}</a>", "<h1>{}</h1>")).format(self.block(self.words(1, 3).title(), 0))
        inner += self.plain("p", self.block(self.sentence(3, 9), 0)) if self.some(0.5) else ""
        inner += self.menu() if self.some(0.4) else ""
        return self.plain("header", inner) if self.some(0.6) else self.named("div", OF_HEADERS, inner, 1)

    def footer(self) -> str:
        inner = self.links() if self.some(0.4) else ""
        mark = self.rng.choice(("© ", "Copyright ", ""))
        inner += self.rng.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format(self.block(mark + self.words(1, 3) + " · " + self.words(2, 8) + self.rng.choice((".", "")), 0))
        inner += self.plain("p", self.block(self.sentences(2), 0)) if self.some(0.3) else ""
        return self.plain("footer", inner) if self.some(0.6) else self.named("div", OF_FOOTERS, inner, 1)

    def page(self) -> str:
        out = ["<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"]
        around = [w for w in ("div", "div", "section") if self.some(0.25)]
        out += [f'<{w} {self.rng.choice(("class", "id"))}="{self.rng.choice(OF_LAYOUT) if self.some(0.6) else self.words(1, 1)}">' for w in around]
        for part, odds in ((self.notice, 0.3), (self.header, 0.4), (self.menu, 0.75), (self.advert, 0.5), (self.notice, 0.1), (self.form, 0.15), (self.sidebar, 0.12)):
            if self.some(odds):
                out.append(part())
        kind, late, cells = self.rng.random(), self.some(0.12), self.some(0.08)
        if cells:  # a table for the layout
            out.append("<table><tr>" + self.named("td", OF_MENUS + OF_SIDES, self.links(), 1) + "<td>")
        inner = self.article() + (self.comments() if late else "") + (self.related() if self.some(0.06) else "")
        if kind < 0.3:
            inner = self.plain("article", inner)
        elif kind < 0.45:
            inner = self.plain("main", inner if self.some(0.5) else self.plain("article", inner))
        elif kind < 0.92:
            for _ in range(self.rng.choice((1, 1, 1, 2, 3))):
                words = OF_ARTICLES if self.some(0.75) else OF_LAYOUT
                inner = self.named(self.rng.choice(("div", "div", "div", "section")), words, inner, 0.8)
        out.append(inner + ("</td></tr></table>" if cells else ""))
        for part, odds in ((self.sharing, 0.2), (self.comments, 0.3), (self.related, 0.25), (self.advert, 0.2), (self.form, 0.15), (self.sidebar, 0.25)):
            if self.some(odds):
                out.append(part())
        if self.some(0.85):
            out.append(self.footer())
        return "".join(out) + "".join(f"</{w}>" for w in reversed(around)) + "</body></html>"


def labelled_pages(seed: int, pages: int) -> tuple[list[list[tuple[int, ...]]], list[list[int]]]:
    """Features of the blocks of generated pages with labels: those of the generator, which come in the same order."""
    rng, read, labels = random.Random(seed), [], []
    for _ in range(pages):
        made = _Page(rng)
        (found, boxes), k, mine = blocks_and_boxes(made.page()), 0, []
        for b in found:
            at = next((j for j in range(k, len(made.gold)) if made.gold[j][0] in b.text), None)
            mine.append(made.gold[at][1] if at is not None else 0)
            k = k if at is None else at + 1
        at, known = page_features(found, boxes)
        if at:
            read.append(known)
            labels.append([mine[i] for i in at])
    return read, labels


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    """Trained on TRAINING_PAGES generated pages, the same ones in every run."""
    return train(*labelled_pages(1, TRAINING_PAGES))


def main_text(page: str | None, chain: Chain) -> str:
    found, boxes = blocks_and_boxes(page)
    at, known = page_features(found, boxes)
    return "\n".join(found[i].text for i, y in zip(at, chain.decode(known), strict=True) if y)


def extract_main_text(df: DataFrame, page: str = "html", chain: Chain | None = None) -> DataFrame:
    """Adds `text` (the article's blocks joined by line ends; empty if none) and `n_chars` (its code points), without the page.

    The whole of each page is read. Null and empty pages give an empty text, broken markup is read as far as
    it can be, repeated rows are read each, and columns named text or n_chars are replaced. One pass without
    a shuffle; the driver trains the chain once, on a fixed number of pages, unless one is given.
    """
    chain = chain or default_chain()
    df = df.drop("text", "n_chars")
    fields = [f for f in df.schema.fields if f.name != page]
    schema = T.StructType(fields + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, page):
                texts = [main_text(p, chain) for p in part.column(page).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(texts, type=to.field("text").type), pa.array([len(t) for t in texts], type=pa.int64())], schema=to)

    return bounded(df).mapInArrow(run, schema)
