"""Main text of pages: nearest-URL page differencing, with markup as a prior.

Pages are ordered by (host, path); a page is compared with the neighbour in
that order whose path shares more leading segments.  The text lines of the two
are aligned by their longest common subsequence, and shared lines are deleted
as boilerplate.  Differencing alone deletes text that articles share (licence
lines, quoted passages, copies of a page) and keeps boilerplate that changes
from page to page, so markup corrects it where it speaks: shared lines of an
``article`` or ``main`` element are put back, and menus, adverts, forms and the
like go although no neighbour has them.  :func:`verdicts` tells for every line
which of the two decided.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import itertools
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.positions import numbered

#: Pages of a range of the URL order (a task), keys sampled in each for the bounds.
RANGE, SAMPLE = 2000, 8
#: Bits of the length table of an alignment; longer pages are aligned in halves.
TABLE = 1 << 27
#: A neighbour with more than this share of the page's text (of its article's, if it has one) may be a copy, not a template.
COPY = 0.5

# Element names by their role in HTML.
RAW = frozenset("script style noscript template textarea title iframe svg object audio video canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mstyle semantics annotation".split())
DROPPED = frozenset("nav footer aside form head header menu button dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments disqus respond replies "
    "related recommended share sharing social pagination pager toolbar login search".split()
)
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style")}
_TAGS = {name: re.compile(rf"""<(/?){name}(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.I) for name in RAW}


@dataclass
class Line:
    """A block's text, whether it stands in an article, and whether markup drops it."""

    text: str
    main: bool
    dropped: bool


def _drops(name: str, attrs: str, in_main: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and in_main)
    if not attrs or name in ("html", "body") or name in MAIN:
        return False
    for key, value in _ATTR.findall(attrs):
        key = key.lower()
        words = re.split(r"[\s_-]+", value.strip("\"'").lower())
        if key == "hidden" or key == "role" and ROLES.intersection(words) or key in ("class", "id") and NAMES.intersection(words):
            return True
    return False


def _closed(page: str, name: str) -> dict[int, int]:
    """Where the elements of a name start, and where their end tags end; unclosed ones are left out."""
    out, opened = {}, []
    for m in _TAGS[name].finditer(page):
        if not m[1]:
            if not (name == "svg" and m[2].endswith("/")):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def lines_of(page: str) -> list[Line]:
    """Text blocks of a page in page order; unclosed and cut-off markup is taken as it comes."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # name, inside main, dropped
    held: list[str] = []
    at = 0
    closed: dict[str, dict[int, int]] = {}

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            _, main, dropped = stack[-1] if stack else ("", False, False)
            out.append(Line(text, main, dropped))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            continue
        if name == "br":
            held.append(" ")
            continue
        flush()
        if m[1]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in _ENDS:
            end = _ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in RAW:
            # a self-closing or unclosed element has no content to skip
            if not (name == "svg" and m[3].endswith("/")):
                if name not in closed:
                    closed[name] = _closed(page, name)
                at = closed[name].get(m.start(), at)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name[0] == "h" and name[1:].isdigit():
            # an open paragraph ends at the next block, an item at its like
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name or stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in ("b", "i", "span"):
                    break
        elif stack and stack[-1][0] == "p":
            stack.pop()
        main, dropped = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in MAIN and dropped and not main:
            dropped = any(s[0] in DROPPED for s in stack)  # an advert's box was left open
        stack.append((name, main or name in MAIN, dropped or _drops(name, m[3], main)))
    flush()
    return out


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _steps(a: list[int], b: list[int]) -> list[int]:
    """Rows of the LCS length table, one for each prefix of ``b``, as bit
    vectors over ``a``: a 0 marks where a row steps up."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for x in b:
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """LCS lengths of every prefix of ``a`` with all of ``b``, in space linear in ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    steps = bin(v | 1 << len(a))[:2:-1]  # the least bit first
    return [0, *itertools.accumulate(1 - int(c) for c in steps)]


def shared(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` on a longest common subsequence with ``b``.

    Common ends are taken as they are.  What is between is aligned by a table
    of bit vectors, or in halves where that would be large, so memory stays
    bounded for pages of any number of lines.
    """
    out, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.add(m)
        if i == m or j == n:
            continue
        if (m - i) * (n - j) > TABLE and n - j > 1:
            half = (j + n) // 2
            left, right = _lengths(a[i:m], b[j:half]), _lengths(a[i:m][::-1], b[half:n][::-1])
            cut = max(range(m - i + 1), key=lambda k: left[k] + right[m - i - k])
            todo += [(i, i + cut, j, half), (i + cut, m, half, n)]
            continue
        rows = _steps(a[i:m], b[j:n])
        x, y = m - i, n - j
        while x and y:
            step = 1 << (x - 1)
            if rows[y] & step:
                x -= 1
                continue
            y -= 1
            if rows[y] & step:
                x -= 1
                out.add(i + x)
    return out


def template_of(lines: list[Line], neighbours: list[list[int]]) -> set[int]:
    """Lines that the difference deletes; ``neighbours``: line digests of the
    nearest page, then the next.

    The first neighbour that is no copy judges.  One that shares most of the
    text is a copy unless both neighbours share the very same lines and go
    their own ways in the others, as pages of one template do; a page whose
    neighbours are all copies stays whole.
    """
    own = [digest(x.text) for x in lines]
    some = any(x.main for x in lines)
    size = [0 if x.dropped or some and not x.main else len(x.text) for x in lines]
    both = []
    for other in neighbours:
        out = shared(own, other)
        if sum(size[i] for i in out) <= COPY * sum(size):
            return out
        both.append(out)
    if len(both) == 2 and both[0] == both[1] and len(both[0]) < len(own):
        ways = [set(other).difference(own) for other in neighbours]
        if ways[0] and ways[1] and not ways[0] & ways[1]:
            return both[0]
    return set()


def verdicts(lines: list[Line], neighbours: list[list[int]]) -> list[str]:
    """What becomes of every line, and why: ``own`` (kept by the difference),
    ``shared`` (deleted by it), ``restored`` (deleted by it, put back as an
    article's), ``declared`` (kept by it, dropped as declared boilerplate)."""
    gone = template_of(lines, neighbours)
    return [("restored" if x.main and not x.dropped else "shared") if i in gone else "declared" if x.dropped else "own" for i, x in enumerate(lines)]


def main_text(lines: list[Line], neighbours: list[list[int]]) -> str:
    """Text of a page: its lines that are its own, or an article's."""
    return " ".join(x.text for x, v in zip(lines, verdicts(lines, neighbours), strict=True) if v in ("own", "restored"))


_HOST, _PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)"


def _keyed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), F.regexp_extract(url, _PATH, 1).alias("path"), F.col("page_id").cast("long").alias("page_id"), F.xxhash64("html").alias("mark"), "url", "html"
    )


KEY = ("host", "path", "page_id", "mark")
_KEY_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64())
KEY_SCHEMA = "host string, path string, page_id long, mark long"


def _key(host: str, path: str, page_id: int | None, mark: int) -> tuple:
    return host, path, page_id is None, page_id or 0, mark


KEYED = f"bucket int, {KEY_SCHEMA}, url string, texts array<string>, flags array<int>, beside boolean"


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return [_key(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]


def _parsed(bounds: list[tuple], ends: dict[int, tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lines of every page in the range of its key; the first and the last
    page of a range are also given to the range beside it."""
    full = sorted(ends)
    after, before = dict(zip(full, full[1:], strict=False)), dict(zip(full[1:], full, strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, url, text = _keys(batch), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            rows = []
            for i, k in enumerate(keys):
                lines = lines_of(text[i] or "")
                of = bisect.bisect_right(bounds, k)
                first, last = ends[of]
                rows.append((of, i, lines, False))
                if k == last and of in after:
                    rows.append((after[of], i, lines, True))
                if k == first and of in before:
                    rows.append((before[of], i, lines, True))
            at = pa.array([r[1] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(batch.column(c).take(at) for c in range(4)), pa.array([url[r[1]] for r in rows], pa.string())]
                + [pa.array([[x.text for x in r[2]] for r in rows], pa.list_(pa.string())), pa.array([[2 * x.main + x.dropped for x in r[2]] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.bool_())],
                [f.split()[0] for f in KEYED.split(", ")],
            )

    return run


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def _differenced(why: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ranges in URL order, with a neighbour from beside at either end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(row: tuple, before: tuple | None, after: tuple | None) -> tuple:
            host, path, page_id, _, url, lines, _ = row
            near = [x for x in (before, after) if x and x[0] == host]
            near.sort(key=lambda x: -_common(path, x[1]))  # stable: the earlier page first
            if why:
                return page_id, url, ",".join(verdicts(lines, [x[2] for x in near])), len(lines)
            text = main_text(lines, [x[2] for x in near])
            return page_id, url, text, len(text)

        def side(row: tuple | None) -> tuple | None:
            return row and (row[0], row[1], row[6])

        last, waiting, of, out = None, None, None, []
        for batch in batches:
            for bucket, *key, url, texts, flags, beside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = [Line(t, f >= 2, f % 2 == 1) for t, f in zip(texts, flags, strict=True)]
                row = (*key, url, lines, [digest(x.text) for x in lines])
                if waiting is not None:
                    out.append(finish(waiting, side(last), side(row) if bucket == of else None))
                if bucket != of:
                    last, waiting = None, None
                if waiting is not None:
                    last = waiting
                if beside:  # a page of another range: seen, not given
                    last, waiting = (row, None) if waiting is None else (waiting, None)
                else:
                    waiting = row
                of = bucket
            yield _rows(out)
            out = []
        if waiting is not None:
            yield _rows([finish(waiting, side(last), None)])

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "text", "n_chars"])


def _bounds(keys: DataFrame, per_range: int) -> list[tuple]:
    """The first key of each range but the first: every eighth of the sorted
    keys of a sample by hash.  A key a range comes to the driver."""
    n = -(-keys.count() // per_range)
    if n <= 1:
        return []
    share = F.pmod(F.xxhash64(*KEY), F.lit(1 << 40)) < F.lit(int(SAMPLE / per_range * (1 << 40)))
    order = [F.col("host"), F.col("path"), F.col("page_id").isNull(), F.col("page_id"), F.col("mark")]
    some = numbered(keys.where(share), order, "__at").where(F.col("__at") % SAMPLE == 0).drop("__at")
    return sorted({_key(*r) for r in some.collect()})


def _ends(bounds: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, key) of the first and last key of the ranges, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple] = {}
        for batch in batches:
            for k in _keys(batch):
                b = bisect.bisect_right(bounds, k)
                lo, hi = most.get(b, (k, k))
                most[b] = min(lo, k), max(hi, k)
        rows = [(b, k[0], k[1], None if k[2] else k[3], k[4]) for b, pair in most.items() for k in pair]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *_KEY_TYPES), strict=True)], ["bucket", *KEY])

    return run


def extract(pages: DataFrame, per_range: int = RANGE, why: bool = False) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, text empty if there is none.

    The URL order is cut into ranges of about ``per_range`` pages by a sample
    of keys, so a host of any size is spread over tasks, whose size doesn't
    grow with the table; the driver holds three keys for each range.  The first
    and last page of a range are sent to the range beside it, so every page
    meets its true neighbours and the result doesn't depend on the cut.  With
    ``why`` the text is the verdict of each line and n_chars their number.

    Null html is empty, a null url has no host and is ordered as such; pages of
    one URL and id are ordered by their html, and of two neighbours that share
    as much of the path the earlier is nearer; repeated rows are extracted each
    (as copies they are no template of each other).  A page of any length is
    read whole.  Empty tables give no rows; other columns are not read.
    """
    keyed = _keyed(pages)
    keys = keyed.select(*KEY)
    bounds = _bounds(keys, per_range)
    key = F.struct("host", "path", F.col("page_id").isNull().alias("none"), "page_id", "mark")
    found = keys.mapInArrow(_ends(bounds), f"bucket int, {KEY_SCHEMA}").groupBy("bucket").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    ends = {r["bucket"]: tuple(_key(k["host"], k["path"], k["page_id"], k["mark"]) for k in (r["lo"], r["hi"])) for r in found}
    parsed = keyed.mapInArrow(_parsed(bounds, ends), KEYED)
    dealt = parsed.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("host", "path", F.col("page_id").asc_nulls_last(), "mark")
    return dealt.mapInArrow(_differenced(why), "page_id long, url string, text string, n_chars long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
