"""Main text of web pages by the template their host's pages share (after Arasu and Garcia-Molina, 2003).

Tokens are the openings and closings of elements, by path, and whole texts, by path and content. Tokens of a host that occur equally
often on every one of its pages share an occurrence vector and form an equivalence class. A class that is frequent, large enough, comes in one
order on its pages and nests with the others is part of the host's template; what stands between its tokens are slots. The main text is what
the slots below the template's content element hold, without the elements that are marked as something else.

Vectors are never gathered: a token's vector is known by two sums, bit by bit, of a hash of (page, count) over its pages. Counting, class
order and nesting are sums over pages that tasks make before anything is shuffled, so a host may hold any share of the pages. The template of
a host is as large as a page; pages meet it without being shuffled where a host holds a thousandth of them or more.
"""

from __future__ import annotations

import html as references
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, spread_join
from netloom.llm.html_events import CLOSE, OPEN, TEXT, Event, read

#: A class counts as frequent from this many pages and this share of its host's pages on, and as large from this many tokens on.
LEAST_PAGES = 3
LEAST_SHARE = 0.5
LEAST_TOKENS = 2
#: A class is ordered and nested if it is on this share of its pages: one broken page must not undo a host's template.
AGREE = 0.95
#: The content element holds this share of the text, where no article or main element says which it is.
MAIN_SHARE = 0.6
#: A task hands on its sums at this many entries.
HELD = 200_000
_CLOSING = 0x5DEECE66D5DEECE6


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def plain(text: str) -> str:
    """Character references decoded, runs of white space as one space, trimmed."""
    return " ".join(references.unescape(text).split())


def host_of(url: Column) -> Column:
    """Host of a web address in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def tokens_of(events: Iterable[Event]) -> Iterator[tuple[int, Event, int]]:
    """Tokens of a page in order, with the characters of texts; blank texts and what is never text are none."""
    for e in events:
        kind = e.kind
        if kind == OPEN:
            yield _long(e.path), e, 0
        elif kind == CLOSE:
            yield _long(e.path ^ _CLOSING), e, 0
        elif e.left_out < 3:
            text = plain(e.text)
            if text:
                yield _long(xxhash.xxh64_intdigest(text, e.path)), e, len(text)


def text_sizes(tokens: Iterable[tuple[int, Event, int]]) -> dict[int, int]:
    """Characters below every path that are neither links nor left out; path 0 is the page."""
    out, open_ = Counter({0: 0}), [0]
    for _, e, size in tokens:
        kind = e.kind
        if kind == OPEN:
            open_.append(0)
        elif kind == CLOSE:
            below = open_.pop()
            if below:
                out[e.path] += below
                open_[-1] += below
        elif not (e.left_out or e.link):
            open_[-1] += size
    out[0] += open_[0]
    return out


# ---- classes of tokens ----------------------------------------------------------------------

_TOKENS = "host string, token long, kind int, depth int, rank int, pages long, n long, one long, two long, chars long"


def _token_sums(batches):
    """Per task, host and token: pages, occurrences, both sums of the vector, and characters below."""
    sums: dict[tuple, list] = {}

    def flush():
        rows = [(*key, *value) for key, value in sums.items()]
        sums.clear()
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        columns = zip(*rows, strict=True) if rows else [[]] * 10
        names = ["host", "token", "kind", "depth", "rank", "pages", "n", "one", "two", "chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def add(key, n, marks, chars):
        held = sums.get(key)
        if held is None:
            sums[key] = [1, n, *marks, chars]
        else:
            held[0] += 1
            held[1] += n
            held[2] ^= marks[0]
            held[3] ^= marks[1]
            held[4] += chars

    for batch in batches:
        for host, row, page in zip(*(batch.column(c).to_pylist() for c in ("host", "row", "html")), strict=True):
            tokens = list(tokens_of(read(page))) if host else []
            sizes = text_sizes(tokens)
            add((host, 0, -1, 0, 0), 1, (0, 0), sizes[0])
            first = {token: (e, size) for token, e, size in reversed(tokens)}
            marks: dict[int, tuple[int, int]] = {}
            for token, n in Counter(token for token, _, _ in tokens).items():
                if n not in marks:
                    key = b"%d:%d" % (row, n)
                    marks[n] = (_long(xxhash.xxh64_intdigest(key, 1)), _long(xxhash.xxh64_intdigest(key, 2)))
                e, size = first[token]
                chars = sizes[e.path] if e.kind == OPEN else 0 if e.left_out or e.link else n * size
                add((host, token, e.kind, e.depth, 0 if e.left_out else e.rank), n, marks[n], chars)
            if len(sums) > HELD:
                yield flush()
    yield flush()


def token_vectors(pages: DataFrame) -> DataFrame:
    """Every token of every host with its pages, occurrences and vector; token 0 stands for the pages themselves."""
    rows = pages.select("host", "row", "html").mapInArrow(_token_sums, _TOKENS)
    return rows.groupBy("host", "token").agg(
        F.min("kind").alias("kind"), F.min("depth").alias("depth"), F.max("rank").alias("rank"), F.sum("pages").alias("pages"), F.sum("n").alias("n"),
        F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), F.sum("chars").alias("chars"),
    )


def equivalence_classes(vectors: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(host, class, pages, tokens)``: frequent, large classes; a class bears the number of its least token."""
    often = cut(vectors.where(f"token <> 0 and host <> '' and pages >= {LEAST_PAGES}"))
    frequent = spread_join(often, hosts.select("host", F.col("pages").alias("of")), "host", "of").where(f"pages >= {LEAST_SHARE} * of")
    grouped = frequent.groupBy("host", "pages", "one", "two").agg(
        F.min("token").alias("class"), F.collect_list(F.struct("token", "kind", "depth", "rank", "n", "chars")).alias("tokens")
    )
    return cut(grouped.where(F.size("tokens") >= LEAST_TOKENS).select("host", "class", "pages", "tokens"))


# ---- order and nesting ----------------------------------------------------------------------


def class_places(events: Iterable[Event], class_of: dict[int, int], size_of: dict[int, int], pages_of: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For every class on a page: its order (0 if it has none or overlaps), the class around it and the gap there.

    The tokens of one round of a class stand around its slots like brackets; where two classes overlap, the one of
    fewer pages is at fault.
    """
    seen: dict[int, list[int]] = defaultdict(list)
    around: dict[int, tuple[int, int]] = {}
    faulty: set[int] = set()
    open_: list[int] = []
    for token, _, _ in tokens_of(events):
        c = class_of.get(token)
        if c is None:
            continue
        step = len(seen[c]) % size_of[c]
        if step == 0:
            top = open_[-1] if open_ else 0
            around.setdefault(c, (top, len(seen[top]) % size_of[top] if open_ else 0))
            open_.append(c)
        seen[c].append(token)
        if step == size_of[c] - 1:
            while open_ and c in open_:
                top = open_.pop()
                if top == c:
                    break
                faulty.add(min(top, c, key=lambda x: (pages_of[x], -x)))
    out = {}
    for c, found in seen.items():
        round_ = found[: size_of[c]]
        ordered = len(set(round_)) == size_of[c] and found == round_ * (len(found) // size_of[c])
        mark = xxhash.xxh64_intdigest(b",".join(b"%d" % t for t in round_)) | 1
        out[c] = (_long(mark) if ordered and c not in faulty else 0, *around[c])
    return out


def _place_sums(batches):
    sums: Counter = Counter()

    def flush():
        columns = list(zip(*sums, strict=True)) if sums else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        arrays = [*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array(list(sums.values()), pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["host", "class", "ordering", "around", "gap", "on"])

    known: dict[str, tuple] = {}
    for batch in batches:
        for host, classes, page in zip(*(batch.column(c).to_pylist() for c in ("host", "classes", "html")), strict=True):
            if not classes:
                continue
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                class_of = {t: c["class"] for c in classes for t in c["tokens"]}
                known[host] = (class_of, {c["class"]: len(c["tokens"]) for c in classes}, {c["class"]: c["pages"] for c in classes})
            for c, place in class_places(read(page), *known[host]).items():
                sums[(host, c, *place)] += 1
            if len(sums) > HELD:
                yield flush()
    yield flush()


def _meet(pages: DataFrame, lookup: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages with what ``lookup`` has for their host, null where it has nothing."""
    whole = cut(hosts.select("host", F.col("pages").alias("_of")).join(lookup, "host", "left"))
    return spread_join(pages, whole, "host", "_of").drop("_of")


def valid_classes(pages: DataFrame, classes: DataFrame, hosts: DataFrame) -> DataFrame:
    """``classes`` that are ordered and nested, with the class ``around`` each (0: none) and the ``gap`` of it they stand in."""
    lists = classes.groupBy("host").agg(
        F.collect_list(F.struct("class", "pages", F.transform("tokens", lambda t: t["token"]).alias("tokens"))).alias("classes")
    )
    met = _meet(pages.select("host", "html"), lists, hosts).select("host", "classes", "html")
    sums = met.mapInArrow(_place_sums, "host string, class long, ordering long, around long, gap int, on long")
    orders = sums.groupBy("host", "class", "ordering", "around", "gap").agg(F.sum("on").alias("on"))
    best = F.max(F.when(F.col("ordering") != 0, F.struct("on", "ordering", "around", "gap")))
    by_order = orders.groupBy("host", "class", "ordering").agg(F.sum("on").alias("in_order"), best.alias("best"))
    main = by_order.groupBy("host", "class").agg(
        F.sum("in_order").alias("all"), F.max(F.when(F.col("ordering") != 0, F.struct("in_order", "ordering", "best"))).alias("m")
    )
    good = main.where(F.col("m.in_order") >= AGREE * F.col("all")).select("host", "class", "m.best.around", "m.best.gap")
    return classes.join(good, ["host", "class"])


# ---- templates and extraction ------------------------------------------------------------------


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(host, class, pages, tokens, around, gap)`` of every host's template, and ``(host, pages, chars)`` of the hosts.

    ``pages`` has ``host``, ``row`` (a number that no other page has) and ``html``.
    """
    vectors = cut(token_vectors(pages))
    hosts = cut(vectors.where("token = 0").select("host", "pages", "chars"))
    return cut(valid_classes(pages, equivalence_classes(vectors, hosts), hosts)), hosts


def _content(valid: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(host, root, texts)``: the path whose slots hold the main text and the template's own texts that are not extracted.

    An article comes first, then a main element, each the one with most text; else the deepest element that every page has once
    and that holds most of the host's text. Template texts are left out only in the last case, and only if they are
    the lesser part of the content: where pages mark their article, or are copies of each other, a text that all share is content.
    """
    each = valid.select("host", "pages", F.inline("tokens"))
    opening = each.where(f"kind = {OPEN}").join(hosts.select("host", F.col("chars").alias("total")), "host")
    fits = opening.where(f"rank > 0 or (n = pages and chars >= {MAIN_SHARE} * total)")
    order = F.struct("rank", F.when(F.col("rank") > 0, F.col("chars")).otherwise(F.lit(0)).alias("size"), "depth", "chars", "token")
    root = fits.groupBy("host").agg(F.max(order).alias("r"))
    texts = each.where(f"kind = {TEXT} and n = pages and chars > 0").groupBy("host").agg(F.sum("chars").alias("_own"), F.collect_list("token").alias("_texts"))
    chosen = root.join(texts, "host", "left")
    drop = F.when((F.col("r.rank") == 0) & (2 * F.col("_own") < F.col("r.chars")), F.col("_texts"))
    return chosen.select("host", F.col("r.token").alias("root"), drop.alias("texts"))


def _own_roots(events: list[Event]) -> set[int]:
    """Content elements of a page without a template: its articles, else its main element, else the deepest with most of the text."""
    ranked = {e.rank: set() for e in events if e.kind == OPEN}
    counts, depth = Counter(), {}
    for e in events:
        if e.kind == OPEN:
            counts[e.path] += 1
            depth[e.path] = e.depth
            if e.rank and not e.left_out:
                ranked[e.rank].add(e.path)
    for rank in (2, 1):
        if ranked.get(rank):
            return ranked[rank]
    sizes = text_sizes(tokens_of(events))
    large = [p for p, n in counts.items() if n == 1 and sizes[p] >= MAIN_SHARE * sizes[0] and sizes[p]]
    return {max(large, key=lambda p: (depth[p], p))} if large else set()


def blocks_of(events: list[Event], root: int | None, texts: Collection[int] = ()) -> list[str]:
    """Texts of the blocks below ``root`` in page order; below the page's own content elements if ``root`` is not on it."""
    roots = {root} if root is not None and any(e.kind == OPEN and _long(e.path) == root for e in events) else None
    roots = {_long(p) for p in _own_roots(events)} if roots is None else roots
    out, parts, inside = [], [], 0 if roots else 1

    def flush():
        text = plain("".join(parts))
        parts.clear()
        if text:
            out.append(text)

    for e in events:
        if e.block and parts:
            flush()
        if e.kind == TEXT:
            if inside and not e.left_out and not (texts and _long(xxhash.xxh64_intdigest(plain(e.text), e.path)) in texts):
                parts.append(e.text)
        elif _long(e.path) in roots:
            if parts:
                flush()
            inside += 1 if e.kind == OPEN else -1
    flush()
    return out


def _extracted(batches):
    for batch in batches:
        texts = []
        for page, root, own in zip(*(batch.column(c).to_pylist() for c in ("html", "root", "texts")), strict=True):
            texts.append("\n".join(blocks_of(read(page), root, frozenset(own or ()))))
        kept = [batch.column(c) for c in ("page_id", "url", "host")]
        arrays = [*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, text, n_chars)`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    ``text`` holds the main text's blocks, one a line. Null and empty pages have an empty text. Pages without a host, hosts of
    fewer than ``LEAST_PAGES`` pages and pages that lack their host's content element are judged by their own marks alone. Repeated rows
    count as pages of their own and give the same text each; other columns are not looked at.
    """
    # row numbers follow the input's partitions, so they are written down before they are used twice
    given = cut(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.monotonically_increasing_id().alias("row"), "html"))
    valid, hosts = templates(given)
    met = _meet(given.select("host", "page_id", "url", "html"), _content(valid, hosts), hosts)
    schema = pages.select("page_id", "url").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return met.mapInArrow(_extracted, f"{fields}, host string, text string, n_chars long")


def _sql() -> str:
    """The given pages mark their article and have neither remarks nor notices inside it."""
    text = "regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1)"
    lines = rf"regexp_replace({text}, '</?(p|h1|br)>', chr(10), 'g')"
    bare = rf"regexp_replace({lines}, '</?b>', '', 'g')"
    for name, sign in (("quot", '"'), ("#39", "''"), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        bare = rf"regexp_replace({bare}, '&{name};?', '{sign}', 'g')" if name in ("quot", "lt", "gt", "amp") else f"replace({bare}, '&{name};', '{sign}')"
    trimmed = f"list_transform(string_split({bare}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
    return f"""SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
      SELECT page_id, url, array_to_string(list_filter({trimmed}, lambda x: x <> ''), chr(10)) AS text FROM pages)"""


SQL = _sql()
