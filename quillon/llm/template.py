"""Main text of HTML pages by equivalence classes of tokens.

Every begin and end of an element is a token, told apart by its path with the names of class and id. A
host's template is deduced from all of its pages that differ in their html: no page is left out, and copies
count once. Tokens with the same occurrence vector (how often each page has them) form an equivalence class.
Since an element's begin and end come in turn and open elements are closed from the inside, both are of one
class, and the spans of elements that a page has once nest as their paths tell. The elements that at least
SUPPORT of the pages have once, and that next to no page (REPEATED) has again, make the template, a tree
whose slots hold what differs between pages. The article is found by descending from the outermost element
along them: into the one whose slots hold most (DOMINANT) of the running text of all pages. An article or
main element is a hint only: it is entered where no other element dominates, and the descent ends at an
article. Headings right before the element that is reached belong to it. A block with the same text on every
page that has text in its slot is part of the template and goes, if CONSTANT pages and SUPPORT of those with
text in the article tell, and unless the page would be left with nothing.

All that the template is deduced from are sums over pages and intersections of sets (Evidence). Those of the
hosts that several tasks extract are added up by all tasks first; the pages of any other host are read by one
task, which keeps them in a local file meanwhile.

The template is then applied to all of the host's pages. A page without the template's article, or of a host
with a single page, is its own template. Inside the article, scripts, styles, markup and elements that are
menus, forms, notices or comments by element, role or a whole class or id name go; nothing else. Block
elements separate blocks, character references are decoded, white space becomes one space, blocks are joined
by two newlines.

Defined results: null and empty html give ''; markup that never ends runs to the end of the page; a null
page_id or url is kept, pages without a host are of one host ''; pages of any length are read whole; repeated
rows are extracted once each; any order of the pages gives the same template; an empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, discard, materialize, slices

#: A host with more than one in HOT pages, and more than FEW, is dealt to several tasks.
HOT, FEW = 1000, 96
#: Share of an element's text that one inside must hold to be entered; pages that must agree on a constant;
#: shares of pages that must have an element of the template, and that may have it more than once.
DOMINANT, CONSTANT, SUPPORT, REPEATED = 0.7, 8, 0.9, 0.01
#: Bytes of a host's pages that a task holds in memory, paths of all hosts whose sums it holds, and most
#: copied pages that are looked up by a broadcast.
HELD, PATHS, TWINS = 1 << 24, 50_000, 100_000
# HTML's elements by what they do to a text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "option", "title", "head")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
UNWANTED = frozenset("nav header footer aside form button menu dialog input label fieldset script style noscript template textarea iframe svg math object select option title head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
# Words in class and id names of what surrounds an article, and words that go along with them.
# A name counts if all its words are of these lists and one is of the first.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar widget widgets cookie cookies consent notice notices alert popup modal overlay gdpr newsletter subscribe signup login form search share sharing social related recommended comment comments respond reply replies disqus toolbar pagination pager copyright".split())
ALONG = frozenset("area bar bars block body bottom box button buttons container content fixed group holder icon icons inner item items left link links list main module page panel post posts primary right row secondary section site slot top unit wrap wrapper".split())
# Those among them that an article element inside doesn't escape, and those that a title has.
NESTED, TITLES = frozenset(["comment", "comments", "respond", "reply", "replies", "disqus", "related", "recommended", "promo", "sponsored"]), frozenset(["header"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# A quote opens a value only after an equals sign; elsewhere it is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]|=(?!\s*[\"']))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")
_SKIP_TO = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW if t not in ("head", "object", "option", "select")}


def unwanted_names(value: str) -> set[str]:
    """The words that mark an element as a surrounding of the article, of its names of class and id."""
    found: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & NAMES and words <= NAMES | ALONG:
            found |= words & NAMES
    return found


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, rest) of a page: open with attributes, close, or text. Raw elements have no inside."""
    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", "", m[0][9:].removesuffix("]]>")
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            continue
        attributes = m[3] or ""
        if tag in _SKIP_TO and not attributes.endswith("/"):
            end = _SKIP_TO[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        yield "open", tag, attributes
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            yield "close", tag, ""
    if at < len(html):
        yield "text", "", html[at:]


class Page:
    """A page's tokens and the blocks of text between them.

    Tokens are paths, an end's with a leading ">". A block is (tokens before, path of the element that holds
    it, text, whether it is unwanted, linked characters)."""

    def __init__(self, html: str | None):
        self.tokens: list[str] = []
        self.blocks: list[tuple[int, str, str, bool, int]] = []
        self.hints: set[str] = set()  # paths of article and main elements
        # Unwanted by its name alone is 1, by its element or as a section of other texts 2.
        stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]
        text: list[str] = []
        linked = links = 0

        def flush() -> None:
            nonlocal linked
            if text:
                line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if line:
                    self.blocks.append((len(self.tokens), stack[-1][1], line, stack[-1][3] > 0, linked))
                text.clear()
            linked = 0

        def leave() -> None:
            if stack[-1][0] in BLOCKS:
                flush()
            self.tokens.append(f">{stack.pop()[1]}")

        for kind, tag, rest in events(html or ""):
            if kind == "text":
                text.append(rest)
                if links:
                    linked += len(rest)
            elif kind == "open":
                if tag in BLOCKS:
                    flush()
                    while stack[-1][0] in CLOSED_BY and tag in CLOSED_BY[stack[-1][0]]:
                        leave()
                    # Inline elements that were never closed end where a block begins.
                    if tag == "p" or tag in CLOSED_BY:
                        while len(stack) > 1 and stack[-1][0] not in BLOCKS:
                            leave()
                        while stack[-1][0] in CLOSED_BY and tag in CLOSED_BY[stack[-1][0]]:
                            leave()
                elif tag == "br":
                    text.append("\n")
                name, hidden, role, prop = "", False, "", ""
                if rest:
                    for key, a, b, c in _ATTRIBUTE.findall(rest):
                        value, key = a or b or c, key.lower()
                        if key in ("class", "id"):
                            name += f" {value}"
                        elif key == "role":
                            role = value.lower()
                        elif key == "itemprop":
                            prop = value.lower()
                        elif key == "hidden" or value.lower() == "true":
                            hidden = True
                _, path, article, unwanted = stack[-1]
                is_article = tag in ("article", "main") or role in ("main", "article") or prop == "articlebody"
                named = unwanted_names(name) - (TITLES if article else frozenset()) if name else frozenset()
                if hidden or tag in UNWANTED and not (tag == "header" and article) or role in ROLES or named & NESTED:
                    out = 2
                elif is_article:
                    out = unwanted if unwanted == 2 else 2 if tag == "article" and named else 0
                else:
                    out = max(unwanted, int(bool(named) and tag not in ("html", "body")))
                # Numbers in names differ between pages of one kind.
                path = f"{path}/{tag}" + _NUMBER.sub("#", "".join(f".{n}" for n in name.replace("/", "|").split()))
                if is_article and not out:
                    self.hints.add(path)
                stack.append((tag, path, article or is_article and not out, out))
                self.tokens.append(path)
                if tag == "a":
                    links += 1
            else:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in VOID:
                    if stack[-1][0] == tag:
                        self.tokens.append(f">{stack.pop()[1]}")
                    continue
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                # A stray end tag closes nothing; an end tag inside an article doesn't reach out of it.
                if depth:
                    while len(stack) > depth:
                        leave()
                elif tag == "p":
                    flush()
        while len(stack) > 1:
            leave()
        flush()


# --- the template -----------------------------------------------------------------------------------


class Class:
    """An equivalence class: its tokens in order, and for each page the places of all its tokens."""

    def __init__(self, tokens: tuple[str, ...], places: list[np.ndarray]):
        self.tokens, self.places = tokens, places
        self.parent: Class | None = None
        self.slot = 0

    def slots(self, page: int, places: np.ndarray) -> np.ndarray:
        """The number of tokens of the class before each place: a multiple of their number is outside."""
        return np.searchsorted(self.places[page], places)


def classes_of(pages: list[Page]) -> list[Class]:
    """The ordered classes of the tokens that every page has, by the tokens' first places. This and nested()
    look at all places of a few pages; Evidence has the classes of a whole host from sums, and tests compare."""
    places: dict[str, list[list[int]]] = {}
    for k, page in enumerate(pages):
        for at, token in enumerate(page.tokens):
            if k == 0:
                places.setdefault(token, [[] for _ in pages])
            if token in places:
                places[token][k].append(at)
    vectors: dict[tuple[int, ...], list[str]] = defaultdict(list)
    for token, on in places.items():
        if all(on):
            vectors[tuple(map(len, on))].append(token)
    found = []
    for vector, tokens in vectors.items():
        whole = _ordered(tokens, vector, places)
        if whole:
            found.append(whole)
            continue
        # A class that isn't ordered is told apart further: each element's begin and end are a class.
        for token in tokens:
            if not token.startswith(">") and f">{token}" in places and (pair := _ordered([token, f">{token}"], vector, places)):
                found.append(pair)
    return sorted(found, key=lambda c: int(c.places[0][0]))


def _ordered(tokens: list[str], vector: tuple[int, ...], places: dict[str, list[list[int]]]) -> Class | None:
    """The class of the tokens if they come in one order, over and over, on every page."""
    order = sorted(tokens, key=lambda t: places[t][0][0])
    own = []
    for k, n in enumerate(vector):
        at = np.array([places[t][k] for t in order])  # a row for each token
        line = at.T.ravel()
        if at.shape[1] != n or (np.diff(line) <= 0).any():
            return None
        own.append(line)
    return Class(tuple(order), own)


def nested(classes: list[Class]) -> list[Class]:
    """The valid classes as a tree (parent and slot): those whose every span lies in one slot of a class
    around, or outside of it. One that overlaps an earlier valid class goes."""
    valid: list[Class] = []
    for c in sorted(classes, key=lambda c: (min(len(p) // len(c.tokens) for p in c.places), -len(c.tokens), c.places[0][0])):
        around: list[tuple[Class, int]] = []
        for other in valid:
            slot = None
            for k, own in enumerate(c.places):
                before = other.slots(k, own).reshape(-1, len(c.tokens))
                if (before != before[:, :1]).any():
                    slot = -1
                    break
                kinds = set((before[:, 0] % len(other.tokens)).tolist())
                slot = kinds.pop() if len(kinds) == 1 and slot in (None, *kinds) else -1
                if slot == -1:
                    break
            if slot == -1:
                around = []
                break
            if slot:
                around.append((other, slot))
        else:
            # The innermost of the classes around: its spans are the shortest.
            if around:
                c.parent, c.slot = min(around, key=lambda o: _spread(o[0]))
            valid.append(c)
    return valid


def _spread(c: Class) -> int:
    n = len(c.tokens)
    return int((c.places[0][n - 1 :: n] - c.places[0][::n]).max())


class Template:
    """What is known of a host's pages: the paths of the article's parts ("" for the whole page), those of
    menus among them, and the constant blocks."""

    def __init__(self, region: tuple[str, ...], menus: tuple[str, ...] = (), constant: frozenset[bytes] = frozenset()):
        self.region, self.menus, self.constant = region, menus, constant

    def own(self, page: Page) -> list[tuple[int, str, str, bool, int]]:
        return [b for b in page.blocks if not b[3] and _within(b[1], self.region)]

    def blocks(self, page: Page) -> list[str]:
        own = self.own(page)
        kept = [b[2] for b in own if not _within(b[1], self.menus) and _mark(b) not in self.constant]
        return kept or [b[2] for b in own]

    def fits(self, page: Page) -> bool:
        return self.region[-1] in page.tokens


def _within(path: str, parts: tuple[str, ...]) -> bool:
    return any(path == r or path.startswith(f"{r}/") for r in parts)


def _mark(block: tuple[int, str, str, bool, int]) -> bytes:
    return hashlib.blake2b(f"{block[1]}\0{block[2]}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Evidence:
    """What all pages of a host say of its template, for each path ("" for the whole page): sums, and the marks
    of the blocks that every page with a block at the path has.

    The sums are: pages that have the path, that have it more than once, its occurrence vector (times a random
    number for each page, so that equal sums are equal vectors), first places, running text inside, all text
    inside, linked text inside, pages with text inside, pages with a block right at it."""

    def __init__(self) -> None:
        self.sums: dict[str, list[int]] = {}
        self.marks: dict[str, set[bytes]] = {}
        self.hints: set[str] = set()

    def add(self, page: Page, number: int, weight: int = 1) -> None:
        """Count a page; a negative weight takes back copies of it."""
        own: dict[str, list[int]] = {"": [1, 0, 0, 0, 0, 0, 0, 0, 0]}
        for at, token in enumerate(page.tokens):
            if token[0] != ">":
                if sums := own.get(token):
                    sums[1], sums[2] = 1, sums[2] + number
                else:
                    own[token] = [1, 0, number, at, 0, 0, 0, 0, 0]
        marks: dict[str, set[bytes]] = {}
        lengths: dict[str, list[int]] = {}
        for block in page.blocks:
            _, path, text, unwanted, linked = block
            if not unwanted:
                marks.setdefault(path, set()).add(_mark(block))
                length, found = len(text), lengths.setdefault(path, [0, 0, 0])
                linked = min(linked, length)
                found[0] += max(0, length - 2 * linked)
                found[1] += length
                found[2] += linked
        for path, found in lengths.items():
            own[path][8] = 1
            at = path
            while True:
                sums = own[at]
                sums[4] += found[0]
                sums[5] += found[1]
                sums[6] += found[2]
                sums[7] = 1
                if not at:
                    break
                at = at.rpartition("/")[0]
        for path, sums in own.items():
            self.sums[path] = [a + weight * b for a, b in zip(self.sums[path], sums, strict=True)] if path in self.sums else [weight * b for b in sums]
        for path, found in marks.items():
            self.marks[path] = self.marks[path] & found if path in self.marks else found
        self.hints |= page.hints

    @property
    def pages(self) -> int:
        return self.sums[""][0] if "" in self.sums else 0

    def classes(self) -> list[list[str]]:
        """The frequent equivalence classes of the elements that pages have once, each in the order of places."""
        vectors: dict[tuple[int, int], list[str]] = defaultdict(list)
        for path, (pages, again, vector, *_) in self.sums.items():
            if path and pages >= SUPPORT * self.pages and again <= REPEATED * self.pages:
                vectors[pages, vector].append(path)
        return [sorted(paths, key=self._place) for paths in vectors.values()]

    def _place(self, path: str) -> tuple[float, str]:
        return self.sums[path][3] / self.sums[path][0], path

    def template(self) -> Template:
        elements = sorted((path for paths in self.classes() for path in paths), key=self._place)
        sums, known = self.sums, set(elements)
        children: dict[str, list[str]] = defaultdict(list)
        for e in elements:
            up = e.rpartition("/")[0]
            while up and up not in known:
                up = up.rpartition("/")[0]
            children[up].append(e)
        around = {h[:at] for h in self.hints & known for at, c in enumerate(h) if c == "/"}
        here, region = "", ()
        while True:
            below, total = children[here], sums[here][4]
            heavy = [e for e in below if total and sums[e][4] >= DOMINANT * total]
            hinted = [e for e in below if e in self.hints] or [e for e in below if e in around]
            if here in self.hints and not any(e in self.hints for e in heavy):
                break
            to = heavy[0] if heavy else hinted[0] if len(hinted) == 1 else None
            if to is None:
                break
            # Headings right before the element that is entered stay with it; an article has its own.
            before, heads = below[: below.index(to)], []
            while before and before[-1].rpartition("/")[2].split(".")[0] in HEADINGS:
                heads.append(before.pop())
            region = () if to in self.hints else (*region, *heads)
            here = to
        region, menus = (*region, here), ()
        if here not in self.hints:
            # Without a hint, elements of the template whose text is links for the most part are menus.
            menus = tuple(e for e in elements if e.startswith(f"{here}/") and sums[e][6] > 0.5 * sums[e][5])
        constant: set[bytes] = set()
        for path, marks in self.marks.items():
            part = next((r for r in region if _within(path, (r,))), None)
            if marks and part is not None and path in sums and sums[path][8] >= max(CONSTANT, SUPPORT * sums[part][7]):
                constant |= marks
        return Template(region, menus, frozenset(constant))


def deduce(pages: list[Page]) -> Template:
    """The template of pages that differ."""
    found = Evidence()
    for k, page in enumerate(pages):
        found.add(page, k + 1)
    return found.template()


def main_blocks(page: Page, template: Template | None) -> list[str]:
    """The blocks of a page's article, by its host's template or, where that doesn't fit, by its own."""
    if template is None or not template.fits(page):
        template = deduce([page])
    return template.blocks(page)


def _number(html: str) -> int:
    """A number that tells pages apart in sums of occurrence vectors; 24 bits, so that sums stay longs."""
    return int.from_bytes(hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=3).digest(), "big")


class Host:
    """The evidence of a host's pages, of copies one, and the pages: in memory, or in a file if they are many."""

    def __init__(self) -> None:
        self.evidence, self.seen = Evidence(), set()
        self.held = tempfile.SpooledTemporaryFile(HELD)  # noqa: SIM115

    def add(self, html: str | None, kept: dict | None = None) -> None:
        pickle.dump((kept, html), self.held)
        if html and html.strip():
            digest = hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if digest not in self.seen:
                self.seen.add(digest)
                self.evidence.add(Page(html), _number(html))

    def template(self) -> Template | None:
        """None where fewer than two pages differ."""
        return self.evidence.template() if self.evidence.pages > 1 else None

    def pages(self) -> Iterator[tuple[dict | None, str | None]]:
        self.held.seek(0)
        while True:
            try:
                yield pickle.load(self.held)
            except EOFError:
                self.held.close()
                return


def host_template(htmls: list[str]) -> Template | None:
    """The template of a host's pages; None where fewer than two differ."""
    host = Host()
    for html in htmls:
        host.add(html)
    return host.template()


def extract(df: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), result: str = "text") -> DataFrame:
    """The kept columns, the page's main text, and n_chars, its number of code points."""
    names = [*keep]
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1), F.lit("")))
    key = F.xxhash64(*names, F.length(html))
    rows = df.select(F.struct(*names).alias("_kept"), F.col(html).cast("string").alias("_html"), host.alias("_host"), key.alias("_key"))
    # One row for each host, and a count; the hosts with more than one in HOT of all pages are fewer than HOT.
    counts = materialize(rows.groupBy("_host").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = {r["_host"]: r["count"] for r in counts.filter(F.col("count") * HOT > total).select("_host", "count").collect() if r["count"] > FEW}
    discard(counts)
    templates = _hot_templates(rows, [*hot]) if hot else {}
    salts = {h: -(-n * HOT // total) for h, n in hot.items()}
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(result, T.StringType()), T.StructField("n_chars", T.LongType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages in the order of hosts: those of a host without a template wait until all are counted."""
        host, last = None, None
        ready: list[tuple[dict, str]] = []

        def finish() -> pa.RecordBatch:
            arrays = [pa.array([kept[c] for kept, _ in ready], out.field(c).type) for c in names]
            texts = [t for _, t in ready]
            ready.clear()
            return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

        def flush() -> Iterator[pa.RecordBatch]:
            found = host.template()
            for kept, page in host.pages():
                ready.append((kept, "\n\n".join(main_blocks(Page(page), found))))
                if len(ready) == 64:
                    yield finish()

        for batch in slices(batches, 64):
            for kept, page, where in zip(*(batch.column(c).to_pylist() for c in ("_kept", "_html", "_host")), strict=True):
                if where != last and host is not None:
                    yield from flush()
                    host = None
                last = where
                if where in templates:
                    ready.append((kept, "\n\n".join(main_blocks(Page(page), templates[where]))))
                    continue
                host = host or Host()
                host.add(page, kept)
            if ready:
                yield finish()
        if host is not None:
            yield from flush()
        if ready:
            yield finish()

    mapped = F.element_at(F.create_map(*[x for h, n in salts.items() for x in (F.lit(h), F.lit(n))]), F.col("_host")) if salts else F.lit(None).cast("int")
    salt = F.pmod(F.xxhash64("_key", F.xxhash64("_html")), F.coalesce(mapped, F.lit(1)).cast("long"))
    dealt = rows.repartition("_host", salt).sortWithinPartitions("_host", "_key").select("_kept", "_html", "_host")
    return dealt.mapInArrow(run, schema)


_SUMS = ("pages", "again", "vector", "places", "running", "size", "linked", "filled", "blocks")


def _hot_templates(rows: DataFrame, hot: list[str]) -> dict[str, Template | None]:
    """The templates of the hosts whose pages several tasks extract, from all of their pages that differ: the
    tasks add up the evidence of the pages that they read, and that of further copies is taken away again."""
    pages = rows.filter(F.col("_host").isin(hot) & F.col("_html").isNotNull()).select("_host", "_html", F.md5("_html").alias("_md5"))
    twins = materialize(pages.groupBy("_host", "_md5").agg((1 - F.count(F.lit(1))).alias("_weight")).filter("_weight < 0"))
    weighed = pages.select("_host", "_html", F.lit(1).cast("long").alias("_weight"))
    if many := twins.count():
        copies = pages.join(F.broadcast(twins) if many <= TWINS else twins.hint("merge"), ["_host", "_md5"])
        weighed = weighed.union(copies.dropDuplicates(["_host", "_md5"]).select("_host", "_html", "_weight"))
    schema = "_host string, path string, hint boolean, marks array<binary>, " + ", ".join(f"{c} long" for c in _SUMS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Evidence] = defaultdict(Evidence)

        def finish() -> Iterator[pa.RecordBatch]:
            for where, e in hosts.items():
                paths = [*e.sums]
                marks = pa.array([[*e.marks[p]] if p in e.marks else None for p in paths], pa.list_(pa.binary()))
                sums = [pa.array(s, pa.int64()) for s in zip(*e.sums.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(paths)), pa.array(paths), pa.array([p in e.hints for p in paths]), marks, *sums], names=["_host", "path", "hint", "marks", *_SUMS])
            hosts.clear()

        for batch in slices(batches, 64):
            for where, html, weight in zip(*(batch.column(c).to_pylist() for c in ("_host", "_html", "_weight")), strict=True):
                if html.strip():
                    hosts[where].add(Page(html), _number(html), weight)
            if sum(len(e.sums) for e in hosts.values()) > PATHS:
                yield from finish()
        yield from finish()

    common = F.reduce(F.collect_list("marks"), F.lit(None).cast("array<binary>"), lambda a, b: F.coalesce(F.array_intersect(a, b), b))
    added = weighed.mapInArrow(add, schema).groupBy("_host", "path").agg(F.max("hint").alias("hint"), common.alias("marks"), *[F.sum(c).alias(c) for c in _SUMS])
    added = materialize(added)
    several = {r["_host"]: r["pages"] for r in added.filter("path = '' AND pages > 1").select("_host", "pages").collect()}
    found: dict[str, Evidence] = defaultdict(Evidence)
    if several:
        # Paths that fewer pages have are no elements of the template, and no slots of constants.
        least = F.element_at(F.create_map(*[x for h, n in several.items() for x in (F.lit(h), F.lit(n))]), F.col("_host"))
        for r in added.filter(F.col("_host").isin([*several]) & (F.col("pages") >= SUPPORT * least)).collect():
            e = found[r["_host"]]
            e.sums[r["path"]] = [r[c] for c in _SUMS]
            if r["marks"]:
                e.marks[r["path"]] = {bytes(m) for m in r["marks"]}
            if r["hint"]:
                e.hints.add(r["path"])
    discard(twins, added)
    return {h: found[h].template() if h in found else None for h in hot}
