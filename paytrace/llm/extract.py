"""Main text of web pages by differencing pages that are neighbours by URL.

A page is parsed into text lines, one per block. The distinct pages of a host are sorted by path; each is aligned with
the neighbour whose path shares the longer prefix by a longest common subsequence of all lines, and lines that
both have are boilerplate. Two things differ from plain differencing, because sites vary their menus,
adverts and footers from page to page and repeat sentences in articles: single lines that HTML itself marks as
something else than the text (navigation, forms, adverts, comments ...) go in any case, and single lines
inside ``article`` or ``main`` stay even if the neighbour has them. Lines beside such an element go unless
more text is left of them after differencing than the element holds, as beside a teaser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import ranked, stored

# Names with a meaning in HTML, and words that class and id names use for what is not the text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr "
    "ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe map math menu nav noframes noscript object script select "
    "style svg template textarea title video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer "
    "footer login menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split())
MAIN_TAGS = frozenset(["article", "main"])
SILENT = frozenset("audio canvas datalist head iframe map math noframes noscript object script style svg template title video".split())
PLAIN, MAIN, MARKED = range(3)  # kinds of lines
CELLS = 1 << 26  # bits that an alignment keeps at a time

_NAME = re.compile(r"[A-Za-z]+|[0-9]+")
_SPACE = re.compile(r"[\s ]+")


class _Lines(HTMLParser):
    """Collects (text, kind) per block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, in main element, without visible text
        self.words: list[str] = []
        self.marked: list[str] = []  # of dropped elements

    def _state(self) -> tuple[bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False)

    def _flush(self) -> None:
        if self.marked:
            text = _SPACE.sub(" ", "".join(self.marked)).strip()
            self.marked = []
            if text:
                self.lines.append((text, MARKED))
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        self.words = []
        if text:
            self.lines.append((text, MAIN if self._state()[1] else PLAIN))

    def _dropped(self, tag: str, attrs: list[tuple[str, str | None]], main: bool) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header" and not main:
            return True
        given = dict(attrs)
        if (given.get("role") or "").lower() in DROPPED_ROLES:
            return True
        if tag in ("html", "body") or tag in MAIN_TAGS:
            return False
        if "hidden" in given or re.search(r"display\s*:\s*none", given.get("style") or ""):
            return True
        names = f"{given.get('class') or ''} {given.get('id') or ''}".lower()
        return any(n in DROPPED_NAMES for n in _NAME.findall(names))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.words.append(" ")
        if tag in BLOCKS:
            self._flush()
        if tag in EMPTY:
            return
        if tag == "p" or tag == "li":
            self._close(tag, barrier=BLOCKS - {"p"} if tag == "p" else {"ul", "ol", "menu"})
        dropped, main, silent = self._state()
        if tag in MAIN_TAGS and not main:
            dropped = silent = False  # a menu that was never closed does not swallow the article
            main = True
        self.open.append((tag, dropped or self._dropped(tag, attrs, main), main, silent or tag in SILENT))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def _close(self, tag: str, barrier: frozenset[str] | set[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in barrier:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        dropped, _, silent = self._state()
        if not dropped:
            self.words.append(data)
        elif not silent:
            self.marked.append(data)


def text_lines(html: str | None) -> list[tuple[str, int]]:
    """Text of each block and its kind: inside ``article`` or ``main``, marked as something else than the text, or plain."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.lines


def kept_lines(kinds: list[int], sizes: list[int], shared: set[int]) -> list[int]:
    """Places of the lines that are the text; ``shared`` are those that the neighbour has, ``sizes`` their code points.

    Plain lines go if they are shared, but a page is not emptied by that. Next to lines in a main element, the
    plain ones that are left stay if they hold more text than these.
    """
    main = [i for i, kind in enumerate(kinds) if kind == MAIN]
    plain = [i for i, kind in enumerate(kinds) if kind == PLAIN]
    own = [i for i in plain if i not in shared]
    if not main:
        return own or plain
    return sorted(main + own) if sum(sizes[i] for i in own) > sum(sizes[i] for i in main) else main


def _grown(row: int, theirs: int) -> np.ndarray:
    """Length of the subsequence with the first 0, 1, ... lines, from a row of ``shared_lines``."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(theirs // 8 + 1, "little"), np.uint8), bitorder="little")[:theirs]
    return np.concatenate([[0], np.cumsum(bits == 0, dtype=np.int64)])


def shared_lines(own: list[int], other: list[int], cells: int = CELLS) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Bit j of a row is 0 where the subsequence grows at line j of ``other``; a row is one integer. Where all rows
    would take more than ``cells`` bits, ``own`` is halved and ``other`` cut where both halves share most (Hirschberg).
    """
    common = set(own) & set(other)
    places = [i for i, x in enumerate(own) if x in common]
    theirs = [x for x in other if x in common]
    full = (1 << len(theirs)) - 1

    def step(v: int, where: dict[int, int], x: int) -> int:
        u = v & where[x]
        return ((v + u) | (v - u)) & full

    def found_at(lines: list[int]) -> dict[int, int]:
        at: dict[int, list[int]] = {}
        for j, x in enumerate(lines):
            at.setdefault(x, []).append(j)
        out = {}
        for x, js in at.items():
            if len(js) == 1:
                out[x] = 1 << js[0]
                continue
            mask = bytearray(len(lines) // 8 + 1)
            for j in js:
                mask[j >> 3] |= 1 << (j & 7)
            out[x] = int.from_bytes(mask, "little")
        return out

    if len(places) > 1 and len(places) * len(theirs) > cells:
        half = len(places) // 2
        ends = []
        for part, lines in ((places[:half], theirs), (places[half:][::-1], theirs[::-1])):
            where, v = found_at(lines), full
            for i in part:
                v = step(v, where, own[i])
            ends.append(_grown(v, len(theirs)))
            del where
        cut = int(np.argmax(ends[0] + ends[1][::-1]))
        found = set()
        for part, lines in ((places[:half], theirs[:cut]), (places[half:], theirs[cut:])):
            found |= {part[i] for i in shared_lines([own[i] for i in part], lines, cells)}
        return found
    where = found_at(theirs)
    rows = [full]
    for i in places:
        rows.append(step(rows[-1], where, own[i]))
    left, row, below = len(theirs) - rows[-1].bit_count(), len(places), full
    found = set()
    while left:
        while (~rows[row - 1] & below).bit_count() >= left:
            row -= 1
        grown = ~rows[row] & below
        while grown.bit_count() > left:
            grown ^= 1 << (grown.bit_length() - 1)
        found.add(places[row - 1])
        below = (1 << (grown.bit_length() - 1)) - 1
        left, row = left - 1, row - 1
    return found


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [text_lines(html.as_py()) for html in batch.column(3)]
        hashes = [[xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t, _ in lines] for lines in pages]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(hashes, pa.list_(pa.int64())),
             pa.array([[kind for _, kind in lines] for lines in pages], pa.list_(pa.int8())),
             pa.array([[len(t) for t, _ in lines] for lines in pages], pa.list_(pa.int32()))],
            names=["key", "host", "path", "lines", "kinds", "sizes"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the lines that a page shares with the neighbour whose path is more like its own."""
    for batch in batches:
        pages, shared = [], []
        for row in batch.to_pylist():
            sides = [(_prefix(row["path"], row[f"{s}_path"]), -i, row[f"{s}_lines"]) for i, s in enumerate(("prev", "next"))
                     if row[f"{s}_path"] is not None]
            lost = shared_lines(row["lines"], max(sides, key=lambda s: s[:2])[2]) if sides else None
            if lost:
                pages.append(row["page"])
                shared.append(sorted(lost))
        yield pa.RecordBatch.from_pydict({"shared_page": pa.array(pages, pa.int64()), "shared": pa.array(shared, pa.list_(pa.int32()))})


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the lines to keep, for pages where these are others than without differencing."""
    for batch in batches:
        keys, kept = [], []
        for row in batch.to_pylist():
            lines = kept_lines(row["kinds"], row["sizes"], set(row["shared"]))
            if lines != kept_lines(row["kinds"], row["sizes"], set()):
                keys.append(row["key"])
                kept.append(lines)
        yield pa.RecordBatch.from_pydict({"kept_key": pa.array(keys, pa.int64()), "kept": pa.array(kept, pa.list_(pa.int32()))})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, kept in zip(batch.column(2), batch.column(3).to_pylist()):
            lines = text_lines(html.as_py())
            if kept is None:
                kept = kept_lines([kind for _, kind in lines], [len(t) for t, _ in lines], set())
            texts.append("\n\n".join(lines[i][0] for i in kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def _outlines(given: DataFrame) -> DataFrame:
    """Per page with a host: key, host, path, hashes, kinds and sizes of its lines, and ``page``, equal for equal lines of a host."""
    outline = given.where("url IS NOT NULL AND host <> ''").select("key", "host", "path", "html").mapInArrow(
        _outline, "key long, host string, path string, lines array<long>, kinds array<byte>, sizes array<int>")
    return stored(outline.withColumn("page", F.xxhash64("host", "lines")), "lines")


def _shared(outline: DataFrame) -> DataFrame:
    """shared_page, shared: places of the lines that a page has in common with its neighbour.

    Pages of a host with equal lines are one, at the first of their paths, so that copies are looked past.
    """
    distinct = outline.where(F.size("lines") > 0).groupBy("page").agg(F.min(F.struct("host", "path", "lines")).alias("first")).select("page", "first.*")
    placed = stored(ranked(distinct, ["host", "path", "page"], "place", "outline"), "places")

    def beside(name: str, shift: int) -> DataFrame:
        return placed.select((F.col("place") + shift).alias("place"), F.col("host").alias(f"{name}_host"),
                             F.col("path").alias(f"{name}_path"), F.col("lines").alias(f"{name}_lines"))

    joined = placed.join(beside("prev", 1), "place", "left").join(beside("next", -1), "place", "left")
    for name in ("prev", "next"):
        same = F.col(f"{name}_host") == F.col("host")
        for part in ("path", "lines"):
            joined = joined.withColumn(f"{name}_{part}", F.when(same, F.col(f"{name}_{part}")))
    return stored(joined.select("page", "path", "lines", "prev_path", "prev_lines", "next_path", "next_lines").mapInArrow(
        _differences, "shared_page long, shared array<int>"), "shared")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null or empty html gives an empty text. Every page is aligned; pages without a url or without another page on their
    host lose no line to differencing, and a page is never emptied by it. If both neighbours' paths are
    equally like, the one before counts. Repeated rows get equal texts; further columns are ignored. An
    empty table gives an empty result. Neighbours are found over line hashes by global position, so a host of any size is cut
    wherever partitions end; the html itself is read twice and shuffled only if differencing changes the text of
    more pages than fit a broadcast.
    """
    key = F.xxhash64("page_id", "url", "html", F.col("html").isNull())
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", key.alias("key"), host.alias("host"), path.alias("path"))
    outline = _outlines(given)
    mixed = outline.where(F.array_contains("kinds", F.lit(PLAIN).cast("byte"))).select("key", "page", "kinds", "sizes")
    decided = mixed.join(_shared(outline), F.col("shared_page") == F.col("page")).select("key", "kinds", "sizes", "shared")
    kept = stored(decided.mapInArrow(_decided, "kept_key long, kept array<int>").dropDuplicates(["kept_key"]), "kept")
    full = given.join(kept, F.col("kept_key") == F.col("key"), "left")
    return full.select("page_id", "url", "html", "kept").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
