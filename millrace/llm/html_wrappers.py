"""HTML extraction (operator 6) by wrappers: union-free regular expressions inferred per host.

A page becomes a balanced stream of tokens: tags of block elements and texts.
Runs of a group of tokens are folded into repeated groups. The folded streams of
a host are aligned one after another with the host's wrapper: equal tokens stay,
texts that differ become slots, a group that one side repeats becomes a repeated
group, and what only one side has becomes optional. Elements are aligned with
their content, so that a group always has the ends of what begins in it.

A page is read by its host's expression, which gives each text its place there.
The places of the main text are those in the region that the wrapper picks: what
is marked as the article, else as the main part, else the smallest element that
has most of the varying text outside of links, with all other paths whose text
is not mostly links. Left out are elements that serve other purposes, and text
that is the same on most pages of the host, unless it is a heading: that is the
template's. Where nothing varies, nothing is left out. A page that the expression
does not hold, or that has no text in the region, is read by its own expression.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Elements within a line of text, by the HTML standard.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose end tag may be left out, and those without content.
OPEN_ENDED = set("p li dt dd tr td th thead tbody tfoot option optgroup caption colgroup".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements that never hold main text.
RAW = set("script style title textarea noscript template iframe xmp svg math".split())
OTHER = set("head nav header footer aside form button select menu dialog object audio video canvas".split())
#: Words of a class, id or role that mark an element as no part of the main text.
OTHER_WORDS = set("ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer contentinfo complementary sidebar aside widget notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments reply replies respond disqus discussion pagination pager toolbar".split())
#: Words that mark the main text.
MAIN_WORDS = set("article articlebody post entry story content main".split())

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([A-Za-z][^\s/>]*+))")
#: The rest of a tag. A quote opens a value only behind "=" and if it is closed, else it is an ordinary character.
_REST = re.compile(r"((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_ATTR = re.compile(r"(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)

Token = tuple[str, str, str, int]  # kind (o, c or t), key, text, link characters


def _key(name: str, attributes: str) -> str:
    """An element's name and the words of its class, id and role, digits left out."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return name
    words: list[str] = []
    for kind, *values in _ATTR.findall(attributes):
        words += ["hidden"] if kind.lower() == "hidden" else re.findall(r"[a-z]+", " ".join(values).lower())
    return " ".join([name, *words])


@lru_cache(maxsize=64)
def _close(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def _markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, name and attributes of each tag, in order; comments and the like have no name.

    A tag without an end is none. Where quoted values would take in the rest of
    the page, quotes no longer count from there on, so that a page is read in
    time in proportion to its length. The reader sends where to go on.
    """
    at, quotes = 0, True
    while m := _OPEN.search(page, at):
        begin = at = m.end()
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else "]]>", begin)
            at = end + 3 if end >= 0 else len(page)
            yield m.start(), at, "", "", ""
            continue
        rest = _REST.match(page, begin) if m[5] and quotes else None
        quotes = quotes and (rest is not None or not m[5])
        end = rest.end() - 1 if rest else page.find(">", begin)
        if end < 0:
            return
        at = end + 1
        at = max(at, (yield m.start(), at, m[4] or "", (m[5] or "").lower(), page[begin:end] if m[5] else "") or 0)


def tokens(page: str | None) -> list[Token]:
    """The token stream of a page. Tags that are cut off are text; comments and raw content are dropped."""
    out: list[Token] = []
    text: list[str] = []
    links = depth = at = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            plain = html.unescape(raw)
            text.append(plain)
            links += len(plain) * (depth > 0)

    def flush() -> None:
        nonlocal links
        if text:
            if joined := " ".join("".join(text).split()):
                out.append(("t", "", joined, min(links, len(joined))))
            text.clear()
            links = 0

    page = page or ""
    found, onward = _markup(page), None
    while True:
        try:
            start, end, slash, name, attributes = found.send(onward)
        except StopIteration:
            break
        say(page[at:start])
        at, onward = end, None
        if not name:
            continue
        if name == "br":
            text.append(" ")
        elif name in RAW:
            flush()
            if not slash and not attributes.endswith("/"):
                close = _close(name).search(page, at)
                at = onward = close.end() if close else len(page)
        elif name in INLINE:
            if name == "a":
                depth = max(0, depth + (-1 if slash else 1))
        else:
            flush()
            if slash:
                depth = 0
                if name not in OPEN_ENDED:
                    out.append(("c", name, "", 0))
            elif name not in VOID:
                out.append(("o", _key(name, attributes), "", 0))
    say(page[at:])
    flush()
    return out


def symbols(page: str | None) -> tuple[list[str], list[Token]]:
    """The page as a balanced stream of "e:key" (an element), "c" (its end), "o:key" (a tag alone) and "t", and its texts.

    An end tag closes what is open inside its element; without an open element it
    is none. What is nested more than ``DEPTH`` deep belongs to the element there.
    """
    out: list[str] = []
    texts: list[Token] = []
    stack: list[str] = []
    opened: dict[str, int] = {}
    for token in tokens(page):
        kind, key = token[0], token[1]
        if kind == "t":
            out.append("t")
            texts.append(token)
        elif kind == "c":
            while opened.get(key, 0):
                name = stack.pop()
                opened[name] -= 1
                if len(stack) < DEPTH:
                    out.append("c")
                if name == key:
                    break
        elif (name := key.split(" ", 1)[0]) in OPEN_ENDED:
            out.append(f"o:{key}")
        else:
            if len(stack) < DEPTH:
                out.append(f"e:{key}")
            stack.append(name)
            opened[name] = opened.get(name, 0) + 1
    out += ["c"] * min(len(stack), DEPTH)
    return out, texts


# ---- expressions: lists of items
#   ["o", key], ["e", key, items], ["+", items], ["?", [item]] and texts ["t", value, weight, pages, chars, links]
# The value of a text names what a page has there, all repetitions in a row; it is null where pages differ.

#: Values are polynomials modulo a prime, so that those of rows of texts follow from those of their parts.
PRIME, BASE = (1 << 61) - 1, 1_000_003
#: Levels of elements that an expression has.
DEPTH = 100

Join = Callable[[list, list], list]


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % PRIME


def in_a_row(a: list, b: list) -> list:
    """What a page has at two places that become one."""
    return ["t", (a[1] * b[2] + b[1]) % PRIME, a[2] * b[2] % PRIME, 1, a[4] + b[4], a[5] + b[5]]


def on_pages(a: list, b: list) -> list:
    """What two sets of pages have at the same place."""
    same = a[1] is not None and a[1:3] == b[1:3]
    return ["t", a[1] if same else None, a[2] if same else 0, a[3] + b[3], a[4] + b[4], a[5] + b[5]]


def mixed(a: list, b: list) -> list:
    """Two places of several pages that become one: their values say nothing any more."""
    return ["t", None, 0, max(a[3], b[3]), a[4] + b[4], a[5] + b[5]]


def head(x: list) -> str:
    """What an item has to share with another to be aligned with it; an optional item meets its content."""
    if x[0] == "t":
        return "t"
    if x[0] == "?":
        return head(x[1][0])
    return f"({' '.join(map(_strict, x[1]))})" if x[0] == "+" else f"{x[0]}:{x[1]}"


def _strict(x: list) -> str:
    return f"?{head(x)}" if x[0] == "?" else head(x)


def both(x: list, y: list, join: Join) -> list:
    """The item that holds two of the same head."""
    if x[0] == "?" or y[0] == "?":
        return ["?", [both(x[1][0] if x[0] == "?" else x, y[1][0] if y[0] == "?" else y, join)]]
    if x[0] == "t":
        return join(x, y)
    if x[0] == "o":
        return x
    return [*x[:-1], align(x[-1], y[-1], join)]


def fold(items: list, join: Join) -> list:
    """The items with every run of a group, however long, as one repeated group."""
    out: list = []
    known: dict[str, str] = {}
    marks = ""  # a character for the head of each item
    groups: list[int] = []  # where the repeated groups are

    def push(x: list) -> None:
        nonlocal marks
        if x[0] == "+":
            groups.append(len(out))
        out.append(x)
        marks += known.setdefault(_strict(x), chr(0xF0000 + len(known)) if len(known) < 0xFFFF else chr(0x20000 + len(known)))

    def pop(n: int) -> list:
        nonlocal marks
        last = out[-n:]
        del out[-n:]
        marks = marks[:-n]
        while groups and groups[-1] >= len(out):
            groups.pop()
        return last

    def meets() -> bool:
        """Whether the last items repeat the group or the items before them; if so, they are one group now."""
        for g in reversed(groups):
            n = len(out) - 1 - g
            if n and len(out[g][1]) == n and all(_strict(x) == _strict(y) for x, y in zip(out[g][1], out[-n:], strict=True)):
                last = pop(n)
                (group,) = pop(1)
                push(["+", [both(x, y, join) for x, y in zip(group[1], last, strict=True)]])
                return True
        size = len(marks)
        near = range(1, min(16, size // 2) + 1)
        for n in itertools.chain(near, _distances(marks)):
            if marks[size - n :] == marks[size - 2 * n : size - n] and not (n == 1 and out[-1][0] == "+"):
                last = pop(n)
                push(["+", [both(x, y, join) for x, y in zip(pop(n), last, strict=True)]])
                return True
        return len(out) > 1 and out[-1][0] == out[-2][0] == "+" and marks[-1] == marks[-2] and one()

    def one() -> bool:
        last = pop(1)[0]
        push(both(pop(1)[0], last, join))
        return True

    for x in items:
        push(x)
        while meets():
            pass
    return out


def _distances(marks: str) -> Iterator[int]:
    """How far before the end the last sixteen characters occur, if it is more than sixteen and at most half."""
    size = len(marks)
    at = size - 17
    while (at := marks.rfind(marks[-16:], 0, at + 16)) >= 0 and 2 * (n := size - 16 - at) <= size:
        yield n
        at -= 1


def _grouped(items: list, other: list) -> list:
    """The items with each run that the other side repeats as a group of one."""
    for group in {head(x): x for x in other if x[0] == "+"}.values():
        want = [head(x) for x in group[1]]
        heads, out, i = [head(x) for x in items], [], 0
        while i < len(items):
            if heads[i : i + len(want)] == want:
                out.append(["+", items[i : i + len(want)]])
                i += len(want)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list, join: Join) -> list:
    """The expression that holds both: equal heads meet, what one side repeats is a group, what one side lacks is optional."""
    left, right = [head(x) for x in a], [head(x) for x in b]
    if left == right:
        return [both(x, y, join) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    left, right = [head(x) for x in a], [head(x) for x in b]
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if op == "equal":
            out += [both(x, y, join) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [x if x[0] == "?" else ["?", [x]] for x in [*a[i:j], *b[k:m]]]
    return fold(out, in_a_row if join is in_a_row else mixed)


def wrapper_of(page: str | None) -> dict:
    """The wrapper of one page: its folded expression."""
    stream, texts = symbols(page)
    said = iter(texts)
    levels: list[list] = [[]]
    keys: list[str] = []
    for s in stream:
        if s == "t":
            _, _, text, links = next(said)
            levels[-1].append(["t", _value(text), BASE, 1, len(text), links])
        elif s == "c":
            items = fold(levels.pop(), in_a_row)
            levels[-1].append(["e", keys.pop(), items])
        elif s[0] == "o":
            levels[-1].append(["o", s[2:]])
        else:
            levels.append([])
            keys.append(s[2:])
    return {"pages": 1, "items": fold(levels[0], in_a_row)}


def merge(a: dict | None, b: dict) -> dict:
    """The wrapper of the pages of both."""
    return b if a is None else {"pages": a["pages"] + b["pages"], "items": align(a["items"], b["items"], on_pages)}


def shape(items: list) -> int:
    """A digest of an expression without its texts; wrappers of one shape merge to the same in any order."""
    bare = lambda x: "t" if x[0] == "t" else [*x[:-1], [bare(y) for y in x[-1]]] if isinstance(x[-1], list) else x
    text = json.dumps([bare(x) for x in items])
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _other(path: str) -> bool:
    """Whether an element of the path is no part of the main text."""
    for key in path.split("/"):
        name, *words = key.split(" ")
        if name in OTHER or "hidden" in words or name not in ("body", "html", "article", "main") and OTHER_WORDS.intersection(words):
            return True
    return False


def region(slots: dict[str, list[int]]) -> list[str]:
    """The paths under which the main text lies: those marked as articles, else as main parts, else the richest.

    Beside the richest element there are, each with a "=" before it, the paths
    outside of it that hold more other text than links; only they are meant, and
    not what lies under them.
    """
    free = {p: s for p, s in slots.items() if not _other(p)}
    marks = (lambda k: k[0] == "article" or "articlebody" in k, lambda k: k[0] == "main" or "main" in k[1:], lambda k: k[0] not in ("html", "body") and MAIN_WORDS.intersection(k[1:]))
    for marked in marks:
        found = set()
        for p in free:
            keys = p.split("/")
            if hit := next((i for i, k in enumerate(keys) if marked(k.split(" "))), None) if p else None:
                found.add("/".join(keys[: hit + 1]))
            elif p and marked(keys[0].split(" ")):
                found.add(keys[0])
        if found:
            return sorted(found)
    mass: dict[str, int] = {}
    for p, (_, _, rich) in free.items():
        keys = p.split("/") if p else []
        for i in range(len(keys) + 1):
            at = "/".join(keys[:i])
            mass[at] = mass.get(at, 0) + rich
    if not mass:
        return []
    enough = 0.8 * mass.get("", 0)
    top = max((p for p in mass if mass[p] >= enough), key=lambda p: (p.count("/") + bool(p), p), default="")
    return [top, *sorted(f"={p}" for p, (chars, links, _) in free.items() if chars > 2 * links and not under(p, top))]


def under(path: str, top: str) -> bool:
    if top.startswith("="):
        return path == top[1:]
    return not top or path == top or path.startswith(top + "/")


class Wrapper:
    """A host's wrapper, ready to read pages.

    The expression is a program: symbols to be met, and jumps. A page's stream is
    followed through it on all ways at once, of which the first that leads to
    the end tells the place of each text. A place is read if its path lies in
    the region and its text is not the template's.
    """

    def __init__(self, made: dict):
        self._met: list[str] = []  # the symbol met at each step of the program, "" for a jump
        self._next: list[list[int]] = []  # where it goes on
        places: dict[int, tuple[str, list]] = {}
        self._write(made["items"], [], places)
        self._onward: dict[int, dict[str, list[int]]] = {}
        pages = made["pages"]
        # the same on most pages of a host, so far as there are some
        fixed = {at for at, (path, t) in places.items() if t[1] is not None and t[3] >= max(TEMPLATE_PAGES, pages / 2) and not HEADING.search(path)}
        slots: dict[str, list[int]] = {}
        for at, (path, t) in places.items():
            s = slots.setdefault(path, [0, 0, 0])
            own = at not in fixed or len(fixed) == len(places)
            slots[path] = [s[0] + t[4], s[1] + t[5], s[2] + own * (t[4] - 2 * t[5])]
        tops = region(slots)
        self._free = {at for at, (path, _) in places.items() if not _other(path)}
        self._read = {at for at in self._free if any(under(places[at][0], top) for top in tops)}
        varies = any(places[at][1][1] is None for at in self._read)
        self._fixed = {at: places[at][1][1:3] for at in fixed & self._read} if varies else {}

    def _write(self, items: list, keys: list[str], places: dict[int, tuple[str, list]]) -> None:
        def step(symbol: str) -> int:
            self._met.append(symbol)
            self._next.append([len(self._met)])
            return len(self._met) - 1

        for x in items:
            if x[0] == "t":
                places[step("t")] = ("/".join(keys), x)
            elif x[0] == "o":
                step(f"o:{x[1]}")
            elif x[0] == "e":
                step(f"e:{x[1]}")
                self._write(x[2], [*keys, x[1]], places)
                step("c")
            elif x[0] == "?":
                at = step("")
                self._write(x[1], keys, places)
                self._next[at].append(len(self._met))
            else:
                at = len(self._met)
                self._write(x[1], keys, places)
                self._next[step("")].insert(0, at)

    def _after(self, at: int) -> dict[str, list[int]]:
        """By symbol, the steps that may meet it next from a place in the program, preferred ones first; "" is the end."""
        if at not in self._onward:
            found: dict[str, list[int]] = {}
            seen, todo = set(), [at]
            while todo:
                p = todo.pop()
                if p in seen:
                    continue
                seen.add(p)
                if p == len(self._met):
                    found.setdefault("", []).append(p)
                elif self._met[p]:
                    found.setdefault(self._met[p], []).append(p)
                else:
                    todo += reversed(self._next[p])
            self._onward[at] = found
        return self._onward[at]

    def places(self, stream: list[str]) -> list[int] | None:
        """The step of the program that each symbol of a page meets, or None if the expression does not hold the page."""
        came: list[dict[int, int]] = []
        now: dict[int, int] = {-1: -1}
        for s in [*stream, ""]:
            then: dict[int, int] = {}
            for p in now:
                for q in self._after(p + 1).get(s, ()):
                    then.setdefault(q, p)
            if not then:
                return None
            came.append(then)
            now = then
        at = came.pop()[len(self._met)]
        out = []
        for step in reversed(came):
            out.append(at)
            at = step[at]
        return out[::-1]

    def found(self, stream: list[str], texts: list[Token]) -> list[str] | None:
        """The main text's blocks; None if the expression does not hold the page, or all of its text lies elsewhere."""
        met = self.places(stream)
        if met is None:
            return None
        said = [(at, t[2]) for at, t in zip([at for at, s in zip(met, stream, strict=True) if s == "t"], texts, strict=True) if at in self._free]
        read = [(at, text) for at, text in said if at in self._read]
        if said and not read:
            return None
        here: dict[int, list] = {}
        for at, text in read:
            if at in self._fixed:
                one = ["t", _value(text), BASE, 1, 0, 0]
                here[at] = in_a_row(here[at], one) if at in here else one
        gone = {at for at, t in here.items() if t[1:3] == self._fixed[at]}
        return [text for at, text in read if at not in gone]

    def text(self, page: str | None) -> str:
        """The main text of a page; a page that the expression does not hold, or without text in the region, is read by its own."""
        stream, texts = symbols(page)
        blocks = self.found(stream, texts)
        if blocks is None:
            blocks = Wrapper(wrapper_of(page)).found(stream, texts)
        return " ".join(blocks or [])


#: Pages of a host from which on a text that is the same on most of them, outside of headings, is the template's.
TEMPLATE_PAGES = 10
HEADING = re.compile(r"(^|/)h[1-6]( |$|/)")


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


#: Wrappers that a task holds before it hands them on, wrappers aligned in a task, and bytes of wrappers that may be broadcast.
HELD, ALIGNED, BROADCAST_BYTES = 5000, 64, 32 << 20


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of all hosts of ``pages`` (url, html), the same however the pages are dealt out.

    Tasks merge pages of one shape, whose order is of no matter. The shapes of a
    host are then aligned in order of their digests, about ``ALIGNED`` at a time,
    and what comes out likewise, in as many rounds as their number asks for.
    """
    schema = pa.schema([("host", pa.string()), ("shape", pa.int64()), ("wrapper", pa.string())])
    columns = "host string, shape long, wrapper string"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict] = {}

        def out() -> pa.RecordBatch:
            made = common.batch(schema, [h for h, _ in held], [n for _, n in held], [json.dumps(w) for w in held.values()])
            held.clear()
            return made

        for b in batches:
            for url, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = wrapper_of(page.as_py())
                key = (host(url), shape(w["items"]))
                held[key] = merge(held.get(key), w)
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    def join(parts: int) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            merged: dict[int, dict] = {}
            rows = t.sort_by("shape")
            for n, w in zip(rows["shape"].to_pylist(), rows["wrapper"], strict=True):
                merged[n] = merge(merged.get(n), json.loads(w.as_py()))
            made = None
            for w in merged.values():
                made = merge(made, w)
            return pa.table({"host": [rows["host"][0].as_py()], "shape": [rows["shape"][0].as_py() % parts], "wrapper": [json.dumps(made)]}, schema=schema)

        return run

    found = common.written(pages.select("url", "html").mapInArrow(learn, columns), "shapes")
    n, rounds = found.count(), [1]
    while rounds[0] * ALIGNED < n:
        rounds.insert(0, rounds[0] * ALIGNED)
    for parts in rounds:
        found = found.groupBy("host", F.pmod("shape", F.lit(parts)).alias("part")).applyInArrow(join(parts), columns)
    return found.select("host", "wrapper")


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url and main text of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block is one space,
    blocks are joined by one space in page order. A null or empty page, and one
    without main text, give an empty text. A null or odd url belongs to the host
    "". Repeated rows give repeated results; extra columns are left out; an empty
    table gives no rows.
    """
    wrappers = common.written(infer(pages) if wrappers is None else wrappers, "wrappers")
    size = wrappers.agg(F.sum(F.length("host") + F.length("wrapper") + 64)).first()[0] or 0
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for b in batches:
            texts = []
            for page, made in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if made not in known:
                    if len(known) > 500:
                        known.clear()
                    known[made] = Wrapper(json.loads(made))
                texts.append(known[made].text(page.as_py()))
            yield common.batch(schema, b.column(0), b.column(1), texts)

    host_of = F.udf(host, "string", useArrow=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of("url"))
    both = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host")
    return both.select("page_id", "url", "html", "wrapper").mapInArrow(read, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points."""
    return extract(common.table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLE_SQL: dict[str, str] = {}
