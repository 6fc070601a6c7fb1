"""Main text of pages: nearest-URL page differencing, with the markup's own word where it has one."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.llm.common import drop, save, tune
from parcelworks.llm.urls import host_and_path

# Elements that start a block, that hold no text of a page, and that hold a page's furniture.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video map datalist".split())
RAW = frozenset("script style title textarea".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select textarea label input fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPH_ENDS = BLOCKS - frozenset("body html".split())
#: Words that may go with one of ``NAMES`` in a class or id without changing what it says.
PLAIN = frozenset("area article articles bar block body bottom box button buttons column container content footer form global group header inner item items left link links list main menu module more new outer page panel post posts primary right row secondary section site slot small text title top unit widget wrap wrapper".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer masthead menu nav navbar navigation newsletter notice notices popup promo promotion related reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

QUOTED_TAG = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*)>\Z", re.S)
LABEL = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I | re.S)
SPACES = re.compile(r"\s+")


def _furniture(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is furniture by its name, class, id or role; a header within the article is part of it."""
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    for attribute, value in LABEL.findall(rest):
        value, attribute = value.strip("\"'").lower(), attribute.lower()
        if attribute == "hidden" or (attribute == "aria-hidden" and value == "true") or (attribute == "role" and value in ROLES):
            return True
        if attribute in ("class", "id"):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", token) if w]
                if any(w in NAMES for w in words) and all(w in NAMES or w in PLAIN for w in words):
                    return True
    return False


#: Inline elements that change nothing are not kept in mind below this depth, as browsers do.
DEEPEST = 512


def _parts(page: str, at: int, quotes: list[bool]) -> int:
    """Where the part of ``page`` that starts at ``at`` ends: a comment, declaration or tag, or text up to the next <.

    Each part is looked for once: a tag with an open quote sets ``quotes`` to false, and from then on tags of the page end
    at the next >. A tag that never ends is text.
    """
    if page[at] != "<":
        end = page.find("<", at)
        return end if end >= 0 else len(page)
    if page.startswith("<!--", at):
        end = page.find("-->", at + 4)
        return end + 3 if end >= 0 else len(page)
    follows = page[at + 1 : at + 3]
    if follows[:1] in ("!", "?"):
        end = page.find(">", at)
    elif (follows[1:] if follows[:1] == "/" else follows[:1]).isascii() and (follows[1:] if follows[:1] == "/" else follows[:1]).isalpha():
        if quotes[0]:
            if tag := QUOTED_TAG.match(page, at + 1):
                return tag.end()
            quotes[0] = False
        end = page.find(">", at)
    else:
        return at + 1
    return end + 1 if end >= 0 else at + 1


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """Blocks of a page's text as (text, furniture, article): white space made one space, references decoded.

    ``article`` tells that an article or main element holds the block. Unclosed elements end where an enclosing one does.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, silent, furniture, article
    held: list[str] = []
    state = (False, False, False)

    def close() -> None:
        if held:
            text = SPACES.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text and not state[0]:
                out.append((text, state[1], state[2]))

    page, at = page or "", 0
    quotes, last = [True], page.rfind(">")
    names: Counter[str] = Counter()  # of the open elements
    while at < len(page):
        end = _parts(page, at, quotes) if at <= last else len(page)  # behind the last > all is text
        part = page[at:end]
        at = end
        if part[0] != "<" or len(part) == 1 or part[-1] != ">":
            if not part.startswith("<!--"):
                held.append(part.replace("<", "&lt;"))
            continue
        tag = TAG.match(part)
        if not tag:
            continue  # comments, declarations
        name = tag[2].lower()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS or name in SILENT:
            close()
        if tag[1]:
            if not names[name]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in BLOCKS or name in SILENT or state[1:] != (stack[i - 1][2:] if i else (False, False)):
                        close()
                    names.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    state = stack[-1][1:] if stack else (False, False, False)
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline element's end does not reach over a block
            continue
        if name in PARAGRAPH_ENDS:  # an open paragraph, and what is inline in it, ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    names.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    state = stack[-1][1:] if stack else (False, False, False)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in VOID or part.endswith("/>"):
            continue
        inside = state[2] or name in ("article", "main")
        new = (state[0] or name in SILENT, state[1] or _furniture(name, tag[3], inside and state[2]), inside)
        if new != state:
            close()
        elif len(stack) >= DEEPEST and name not in BLOCKS and name not in RAW:
            continue
        stack.append((name, *new))
        names[name] += 1
        state = new
        if name in RAW:  # nothing within is markup but its own end
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            held.append(page[at:stop])
            at = stop
    close()
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``: bit-parallel lengths, then divide and conquer."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < len(a) - start and tail < len(b) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle_a, middle_b = a[start : len(a) - tail], b[start : len(b) - tail]
    out = list(range(start))
    common = set(middle_b)
    rows = [i for i, x in enumerate(middle_a) if x in common]
    if rows:
        have = {middle_a[i] for i in rows}
        out += [start + rows[i] for i in _align([middle_a[i] for i in rows], [x for x in middle_b if x in have])]
    return out + list(range(len(a) - tail, len(a)))


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((full ^ v).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(bits))


def _align(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    half = len(a) // 2
    cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]


#: Two pages that share more than this part of the smaller one's lines are copies, not pages of one template.
COPY = 0.7


def _partners(a: tuple[int, ...], b: tuple[int, ...], fewest: int) -> bool:
    """Whether two pages share lines and are no copies; ``fewest`` is the number of lines of the smaller one."""
    return not set(a).isdisjoint(b) and len(shared(a, b)) <= COPY * fewest


class _Kinds:
    """Pages of a slice by kind: host, number of lines and those lines that another page may share, in order. Whether two
    pages are partners is told by their kinds alone, so it is found out once for each two of them."""

    def __init__(self, hosts: list[str], lines: list, lengths: list[int], common: Callable[[str, int], bool]):
        self.number: dict[tuple, int] = {}
        self.of = [self.number.setdefault((h, n, tuple(x for x in own if common(h, x))), len(self.number)) for h, own, n in zip(hosts, lines, lengths, strict=True)]
        self.kinds = list(self.number)
        self.known: dict[tuple, bytearray] = {}  # of a kind with each of the slice: 0 not known, 1 partners, 2 not

    def nearest(self, kind: tuple, places: Iterable[int]) -> int | None:
        """The first of ``places`` whose page is a partner of a page of that kind and host."""
        if not kind[2]:
            return None
        known = self.known.setdefault(kind, bytearray(len(self.kinds)))
        for j in places:
            other = self.of[j]
            if not known[other]:
                _, n, own = self.kinds[other]
                known[other] = 1 if _partners(kind[2], own, min(kind[1], n)) else 2
            if known[other] == 1:
                return j
        return None


def _runs(hosts: list[str]) -> list[tuple[int, int]]:
    """First place of each page's host in a sorted slice, and the place behind its last."""
    first, behind = list(range(len(hosts))), list(range(1, len(hosts) + 1))
    for i in range(1, len(hosts)):
        if hosts[i] == hosts[i - 1]:
            first[i] = first[i - 1]
    for i in range(len(hosts) - 2, -1, -1):
        if hosts[i] == hosts[i + 1]:
            behind[i] = behind[i + 1]
    return list(zip(first, behind, strict=True))


def _lost(path: str, place: int, lines: list[int], found: list[tuple[int, str, list[int]]]) -> tuple[int, list[int], list[int]]:
    """Which of the partners ``found`` (place, path, lines) a page is paired with, and what the page and that partner lose."""
    best = max(range(len(found)), key=lambda k: (_prefix(path, found[k][1]), -abs(found[k][0] - place), found[k][0] < place))
    same = shared(lines, found[best][2])
    return best, same, _places([lines[x] for x in same], found[best][2])


def _within(group: pd.DataFrame, last: int) -> pd.DataFrame:
    """Pairs of the pages of one slice: the lines that pages lose, told for pages whose markup leaves lines open only, since the
    others lose none. A page that has met no partner up to an end of the slice, where its host may go on, is told with that
    side (0: both) and the partner on the other one. ``last`` is the number of the last slice."""
    group = group.sort_values("id", ignore_index=True)
    hosts, paths, lines, ids = group.host.tolist(), group.path.tolist(), [x.tolist() for x in group.lines], group.id.tolist()
    pages = Counter((h, x) for h, own in zip(hosts, lines, strict=True) for x in set(own))
    kinds = _Kinds(hosts, lines, list(map(len, lines)), lambda h, x: pages[h, x] > 1)
    out: list[tuple] = []
    start, end = ids[0] >> 33 > 0, ids[-1] >> 33 < last  # whether slices lie before and behind
    for i, (first, behind) in enumerate(_runs(hosts)):
        kind = kinds.kinds[kinds.of[i]]
        before, after = kinds.nearest(kind, range(i - 1, first - 1, -1)), kinds.nearest(kind, range(i + 1, behind))
        found = [j for j in (before, after) if j is not None]
        sides = [-1] * (start and before is None and not first) + [1] * (end and after is None and behind == len(ids))
        if sides:
            out.append((None, None, ids[i], ids[found[0]] if found else None, sum(sides), hosts[i], lines[i]))
        elif found:
            best, own, others = _lost(paths[i], i, lines[i], [(j, paths[j], lines[j]) for j in found])
            out += [(group.row[k], at, None, None, None, None, None) for k, at in ((i, own), (found[best], others)) if group.open[k]]
    return pd.DataFrame(out, columns=["row", "deleted", "id", "near", "side", "host", "lines"], dtype=object)


def _beyond(asked: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
    """The nearest partner in a slice for pages (or several alike) of other slices, seen from their side."""
    group = group.sort_values("id", ignore_index=True)
    hosts, ids = group.host.tolist(), group.id.tolist()
    wanted = set().union(*asked.lines)
    kinds = _Kinds(hosts, group.lines.tolist(), list(map(len, group.lines)), lambda _, x: x in wanted)
    run = dict(zip(hosts, _runs(hosts), strict=True))
    out = []
    for asker, step, host, n, lines in zip(asked.asker, asked.step, asked.host, asked.n, asked.lines, strict=True):
        first, behind = run.get(host, (0, 0))
        found = kinds.nearest((host, n, tuple(lines)), range(first, behind)[::step])
        if found is not None:
            out.append((asker, step, ids[found]))
    return pd.DataFrame(out, columns=["asker", "step", "near"])


def _across(starts: dict[int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The lines that pairs lose which were looked for beyond a slice; ``starts`` has the pages before each slice."""

    def place(page: int) -> int:
        return starts[page >> 33] + (page & (1 << 33) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page in batch.itertuples():
                found = list(page.found)
                best, own, others = _lost(page.path, place(page.id), page.lines.tolist(), [(place(x["near"]), x["path"], list(x["lines"])) for x in found])
                out += [(row, at) for row, at, told in ((page.row, own, page.open), (found[best]["row"], others, found[best]["open"])) if told]
            yield pd.DataFrame(out, columns=["row", "deleted"])

    return run


def _places(part: list[int], lines: list[int]) -> list[int]:
    """Where the subsequence ``part`` stands in ``lines``, as far to the front as it can."""
    out, at = [], 0
    for x in part:
        at = lines.index(x, at) + 1
        out.append(at - 1)
    return out


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all lines of each page; its candidates for the main text; and, where the markup does not decide, which lines
    these are. A page that names its article has just that as candidates, another one all lines that are no furniture."""
    for batch in batches:
        hashes, texts, undecided = [], [], []
        for page in batch.column(5).to_pylist():
            lines = lines_of(page)
            declared = any(article and not furniture for _, furniture, article in lines)
            hashes.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _, _ in lines])
            kept = [i for i, (_, furniture, article) in enumerate(lines) if not furniture and (article or not declared)]
            texts.append([lines[i][0] for i in kept])
            undecided.append([] if declared else kept)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hashes, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string())), pa.array(undecided, pa.list_(pa.int32()))], names=["row", "page_id", "url", "host", "path", "lines", "texts", "undecided"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_per_slice: int = 2000) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, its blocks joined by line ends.

    Every page is paired, within its host, with the page whose URL path is nearest in sorted order: before and behind it
    the nearest that shares lines with it and is no copy (``COPY``), of these that with the longer common prefix. The
    pair's lines are aligned by a longest common subsequence, and both pages lose the lines they share. The markup's own
    word stands above that: menus, headers, footers, asides, forms, scripts and elements named like adverts, notices or
    comments never count, and where a page names its article (article or main) just that is kept, shared lines included.

    Null html has an empty text; rows are kept as they are, also repeated ones and such with a null id or url. Pages are
    parsed once and sorted in slices of bounded size, so no host is gathered in one task; a page that finds no partner in
    its slice goes on to the slices that have its lines, so the slices' size does not change what is found. Hosts where
    the markup decides all pages lose no lines and are not paired.
    """
    tune(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))).alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    parsed = save(base.mapInArrow(_parsed, "row long, page_id long, url string, host string, path string, lines array<long>, texts array<string>, undecided array<int>"), "parsed")
    hosts = parsed.where(F.size("undecided") > 0).select("host").distinct()
    lines = parsed.where(F.size("lines") > 0).join(hosts, "host", "left_semi").select("row", "page_id", "host", "path", "lines", (F.size("undecided") > 0).alias("open"))
    deleted = _deleted(lines.dropDuplicates(["row"]), rows_per_slice)
    rows = parsed.select("row", "page_id", "url", "texts", "undecided").join(deleted, "row", "left")
    left = F.filter("texts", lambda t, i: ~F.array_contains("deleted", F.get("undecided", i)))
    text = F.array_join(F.when(F.col("deleted").isNull() | (F.size("undecided") == 0), F.col("texts")).otherwise(left), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _deleted(lines: DataFrame, rows_per_slice: int) -> DataFrame:
    """(row, deleted array<int>): the lines of each page that its pairs share."""
    lines = save(lines, "lines")
    slices = max(1, -(-lines.count() // rows_per_slice))
    key = F.struct("host", "path", F.coalesce("page_id", F.lit(-(2**63)).cast("long")).alias("page_id"), "row")
    ranged = lines.withColumn("key", key).repartitionByRange(slices, "key").sortWithinPartitions("key").drop("key", "page_id")
    ranged = save(ranged.withColumn("id", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("id", 33).cast("int")), "slices")
    drop(lines)
    starts, before = {}, 0
    for r in sorted(ranged.groupBy("slice").count().collect()):
        starts[r[0]], before = before, before + r[1]
    last = max(starts, default=0)
    met = save(ranged.groupBy("slice").applyInPandas(lambda group: _within(group, last), "row long, deleted array<int>, id long, near long, side int, host string, lines array<long>"), "met")
    found = met.where("deleted is not null").select("row", "deleted")
    if last:
        pairs = met.where("near is not null").select("id", "near").unionByName(_further(met.where("id is not null"), ranged, last))
        other = ranged.select(F.col("id").alias("near"), F.struct(F.col("id").alias("near"), "row", "path", "lines", "open").alias("found"))
        pairs = pairs.join(other, "near").groupBy("id").agg(F.collect_list("found").alias("found"))  # two at most
        pairs = pairs.join(ranged.select("id", "row", "path", "lines", "open"), "id")
        found = found.unionByName(pairs.mapInPandas(_across(starts), "row long, deleted array<int>"))
    return save(found.select("row", F.explode("deleted").alias("at")).groupBy("row").agg(F.collect_set("at").alias("deleted")), "deleted")


def _further(ends: DataFrame, ranged: DataFrame, last: int) -> DataFrame:
    """(id, near): the nearest partner of each page of ``ends`` in other slices, on the side where its own slice has none.

    A line of such a page counts where another slice of the host on that side has it. Pages of a slice with the same such
    lines, in order, and as many lines in all ask as one. They ask the slices that have one of their lines: the next slice
    first, then as many slices as lie behind them again and again, until a partner is found or no slice with such a line is left.
    """
    spread = F.broadcast(ranged.groupBy("host").agg(F.min("slice").alias("a"), F.max("slice").alias("b")).where("a < b").select("host"))
    held = ranged.join(spread, "host").select("host", "slice", F.explode("lines").alias("line")).select(F.xxhash64("host", "line").alias("key"), "slice").distinct()
    of_key = Window.partitionBy("key")
    held = save(held.select("key", "slice", F.min("slice").over(of_key).alias("low"), F.max("slice").over(of_key).alias("high")).where("low < high"), "held")
    sides = ends.withColumn("slice", F.shiftright("id", 33).cast("int")).withColumn("step", F.explode(F.when(F.col("side") == 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array("side"))))
    sides = sides.select("id", "slice", "step", "host", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line")).withColumn("key", F.xxhash64("host", "line"))
    sides = sides.join(held, ["key", "slice"]).withColumn("far", F.when(F.col("step") < 0, F.col("slice") - F.col("low")).otherwise(F.col("high") - F.col("slice"))).where("far > 0")
    sides = sides.groupBy("id", "slice", "step", "host", "n").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).getField("line").alias("lines"), F.max("far").alias("far"))
    asking = save(sides.groupBy("slice", "step", "host", "n", "lines", "far").agg(F.min("id").alias("asker"), F.collect_list("id").alias("ids")), "asking")
    left, answers, near = asking.drop("ids"), [], 1
    while near <= last and not left.isEmpty():
        away = (F.col("at") - F.col("slice")) * F.col("step")
        keys = left.select("asker", "step", "slice", F.explode("lines").alias("line"), "host").select("asker", "step", "slice", F.xxhash64("host", "line").alias("key"))
        asked = keys.join(held.select("key", F.col("slice").alias("at")), "key").where((away >= near) & (away < 2 * near)).select("asker", "step", "at").distinct()
        asked = save(asked.join(left, ["asker", "step"]).select("asker", "step", "at", "host", "n", "lines"), "asked")
        open_slices = ranged.join(asked.select(F.col("at").alias("slice")).distinct(), "slice", "left_semi")
        answer = asked.groupBy("at").cogroup(open_slices.select("id", "host", "lines", "slice").groupBy("slice")).applyInPandas(_beyond, "asker long, step int, near long")
        answer = save(answer.groupBy("asker", "step").agg((F.min(F.col("near") * F.col("step"))).alias("near")).withColumn("near", F.col("near") * F.col("step")), "answer")
        answers.append(answer)
        near *= 2
        left = save(left.where(F.col("far") >= near).join(answer, ["asker", "step"], "left_anti"), "left")
    asking = asking.select("asker", "step", F.explode("ids").alias("id"))
    pairs = [asking.join(a, ["asker", "step"]).select("id", "near") for a in answers]
    return reduce(DataFrame.unionByName, pairs) if pairs else asking.select("id", F.col("asker").alias("near")).limit(0)
