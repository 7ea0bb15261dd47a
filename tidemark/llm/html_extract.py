"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags that open or close and blocks of text, told apart by their
path, a hash of the tags and class names around it. Over the distinct pages of a host each token
has an occurrence vector (how often it occurs on each page). Tokens with equal vectors form a
class. Classes that at least ``SHARE`` of the pages hold are ordered by where their tokens stand;
a class whose span crosses another's without lying inside it or in one gap of it is invalid, and
each valid one is nested in the gap of the smallest class around it (of equal ones, that of the smaller class number). That is the host's
template. On a page, a class whose tokens do not stand in the template's order is invalid there.

The gap after a tag of the template is a slot. What the slots of all pages hold says what each is
for: a slot most of whose text lies in a menu, header, footer, sidebar, notice, advert, form or
reader comment (tags, and words of class names, label it so), or that lies outside articles and holds
almost only links over the host's pages, is not main text. Text that is itself a token
of the template is furniture of the site, inside articles too, unless it is the larger part of
a page's article. The rest of the text in slots is the main text. Text in parts that the template
does not have, and pages of hosts with fewer than ``LEAST_PAGES`` distinct pages, which give no
template, go by the labels of their own tags alone: in an article those are tags, roles and names all of whose words say so,
and a paragraph, list item, heading or table there is never left out for its name. A word of a name, as in ``related-work``, only hints
at what a slot of the whole host is for.

Vectors are compared by their supports and 62-bit sums of hashes, so no list of pages is ever
gathered; a host's template holds tokens of at least ``SHARE`` of its pages, so it is no
larger than a page. Templates are broadcast if they have at most ``BROADCAST_TOKENS`` tokens
in all, else joined to salted pages.

Defined results. Null or empty html gives an empty text. A null url is a host of its own; a null
page_id is carried along. Rows that repeat are repeated, and count once in a template. Pages of
any length and depth are read whole, in time linear in the page: an unclosed tag or quote is text up to the next ``<``, an unclosed
comment or script takes the rest of the page. An empty table gives an empty one. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, store

SHARE, LEAST_PAGES = 0.8, 4
LINKED = 0.9
BROADCAST_TOKENS = 100_000
SALTS = 16

_name = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_stop = re.compile(r"[<>\"']")
_named = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_word = re.compile(r"[a-z]+")
_number = re.compile(r"[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br rp rt ruby td th".split())
OUTSIDE = frozenset("nav header footer aside form button dialog menu head".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social"
    " comment comments reply replies discussion disqus related recommended widget pagination pager search skip toolbar complementary contentinfo".split()
)
NEUTRAL_NAMES = frozenset("area bar block body bottom box col column container content group holder inner item items left link links list main nav outer page panel post right row section site text top wrap wrapper".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Raw elements: what they hold is neither text nor tags.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea svg math iframe object select title".split()}
PARAGRAPHS = frozenset("p li dt dd blockquote pre figure figcaption caption table tr td th address".split()) | HEADINGS
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
STOPS = frozenset("ul ol dl table article section div body main".split())

_host = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", re.I)


def host_of(url: str | None) -> str:
    m = _host.match(url or "")
    return m[1].lower() if m else ""


def _outside(tag: str, attributes: str) -> int:
    """How much speaks for a part outside the main text: 3 its tag or role, 2 a whole name, 1 a word of a name, 0 nothing."""
    if tag in OUTSIDE:
        return 3
    if not attributes or tag in ("html", "body", "main"):
        return 0
    most = 0
    for m in _named.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in OUTSIDE_ROLES:
                return 3
            continue
        for name in value.split():
            words = _word.findall(name)
            if not OUTSIDE_NAMES.isdisjoint(words):
                most = max(most, 2 if all(w in OUTSIDE_NAMES or w in NEUTRAL_NAMES for w in words) else 1)
    return most


class _Scanner:
    """Pieces of a page: (text, None, None, False) and (None, tag, attributes, closing). A tag ends at the first ``>``
    outside quotes. Where a ``<`` or the end of the page comes first, or a quote has no end, there is no tag and its ``<`` is
    text. Work is linear in the page: a quote has no end if it is the last of its kind, and a place from which
    no ``>`` was found is not tried again."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.vain: set[int] = set()

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, -1 if nothing does."""
        tried = []
        while at not in self.vain:
            tried.append(at)
            m = _stop.search(self.page, at)
            if m is None or m[0] == "<":
                break
            if m[0] == ">":
                return m.start()
            if m.start() == self.last[m[0]]:
                break
            at = self.page.find(m[0], m.end()) + 1
        self.vain.update(tried)
        return -1

    def __iter__(self):
        page, at = self.page, 0  # text from ``at`` on is not given yet
        lt = page.find("<")
        while lt >= 0:
            skip, found = 0, None
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                skip = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt + 9)
                end = len(page) if end < 0 else end
                skip, found = end + 3, (page[lt + 9 : end], None, None, False)
            elif page.startswith(("<!", "<?"), lt):
                skip = page.find(">", lt) + 1 if lt < self.last[">"] else 0
            elif m := _name.match(page, lt + 1):
                end = self.tag_end(m.end()) if m.end() <= self.last[">"] else -1
                if end >= 0:
                    skip, found = end + 1, (None, m[1].lower(), page[m.end() : end], page[lt + 1] == "/")
                    raw = None if found[3] else RAW.get(found[1])
                    if raw:
                        close = raw.search(page, skip)
                        skip, found = (close.end() if close else len(page)), (" ", None, None, False)
            if not skip:
                lt = page.find("<", lt + 1)
                continue
            if lt > at:
                yield page[at:lt], None, None, False
            if found:
                yield found
            at = min(skip, len(page))
            lt = page.find("<", at)
        if at < len(page):
            yield page[at:], None, None, False


class _Open:
    """An open tag with what its ancestors say: whether the text in it is barred or (``hinted``) only named so."""

    __slots__ = ("tag", "path", "block", "region", "apart", "barred", "hinted", "heading")

    def __init__(self, tag: str, path: str, block: bool, outside: int, above: _Open | None):
        self.tag, self.path, self.block = tag, path, block
        self.region, self.apart = (above.region, above.apart) if above else ("", False)
        barred, hinted = (above.barred, above.hinted) if above else (0, 0)
        self.heading = tag in HEADINGS or bool(above and above.heading)
        own = 1 if tag == "header" else 2  # an article's header is barred less than other parts
        if not self.region and tag in ("article", "main") and not self.apart:
            self.region, barred, hinted = tag, 0, 0
        elif outside:
            hinted = max(hinted, own)
            if not self.region or outside == 3 or (outside == 2 and tag not in PARAGRAPHS):
                barred = max(barred, own)
        self.apart = self.apart or bool(outside)
        self.barred, self.hinted = barred, hinted


def parse(page: str | None):
    """Tokens in page order: ("open" or "close", path, "") and ("text", path, block, region, barred, share in links,
    hinted). A path is a hash of the tags and names from the page's top, so a token's size does not grow with depth."""
    import xxhash

    out, stack, text = [], [], []
    places: dict[str, list[int]] = {}  # tag -> where it is open in the stack
    linked = 0

    def put(piece):
        nonlocal linked
        text.append(piece)
        if places.get("a"):
            linked += len(piece)

    def flush():
        nonlocal linked
        if text:
            whole = sum(map(len, text))
            block = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if block:
                top = stack[-1] if stack else _Open("", "", True, 0, None)
                least = 1 if top.region and top.heading else 0  # the article's own title
                out.append(("text", top.path, block, top.region, top.barred > least, linked / whole, top.hinted > least))
            linked = 0

    def drop(i):
        """Close everything from the i-th open tag on."""
        while len(stack) > i:
            x = stack.pop()
            places[x.tag].pop()
            if x.block:
                out.append(("close", x.path, ""))

    def innermost(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(names, stops=STOPS):
        i = innermost(names)
        if i >= 0 and i >= innermost(stops):
            drop(i)

    for piece, tag, attributes, closing in _Scanner(page or ""):
        if tag is None:
            text.append(piece) if piece == " " else put(piece)
            continue
        if closing:
            if tag not in INLINE:
                flush()
            elif tag in ("td", "th"):
                text.append(" ")
            if places.get(tag):
                close((tag,), () if tag not in INLINE else STOPS)
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                close(("p",))
        elif tag in ("br", "td", "th", "img"):
            text.append(" ")
        if tag in SAME:
            close(SAME[tag], ("ul", "ol", "dl", "table"))
        if tag in VOID or attributes.rstrip().endswith("/") and tag in INLINE:
            continue
        above = stack[-1] if stack else None
        path = above.path if above else ""
        if tag not in INLINE:
            names = " ".join(sorted((x[2] or x[3] or x[4] or "") for x in _named.finditer(attributes))) if attributes else ""
            own = f"{tag}.{_number.sub('0', names)}" if names else tag  # numbers differ from page to page
            path = xxhash.xxh3_64_hexdigest(f"{path}/{own}".encode("utf-8", "surrogatepass"))
            out.append(("open", path, ""))
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, path, tag not in INLINE, _outside(tag, attributes), above))
    flush()
    drop(0)
    return out


def token_key(token) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\0".join(token[:3]).encode("utf-8", "surrogatepass")) - 2**63


def nested(tokens: list[tuple[int, int, float, float]]) -> dict[int, tuple[int, int, int]]:
    """The template of (token, class, first, last place) as token -> (class, order in the class, gap):
    valid classes only, each nested in a gap (token) of the smallest class around it, -1 at the top."""
    classes: dict[int, list] = {}
    for token, name, first, last in tokens:
        classes.setdefault(name, []).append((first, last, token))
    for members in classes.values():
        members.sort()
    starts = {name: [x[0] for x in m] for name, m in classes.items()}
    span = {name: (m[0][0], max(x[1] for x in m)) for name, m in classes.items()}
    valid: list[int] = []
    gap_of: dict[int, int] = {}
    for name in sorted(classes, key=lambda c: (-len(classes[c]), span[c], c)):  # larger classes first
        lo, hi = span[name]
        around, crossed = [], False
        for other in valid:
            a, b = span[other]
            if hi < a or lo > b:
                continue
            k = bisect_right(starts[other], lo) - 1
            if k >= 0 and (k + 1 == len(starts[other]) or hi <= starts[other][k + 1]):
                around.append((b - a, other, classes[other][k][2]))
            elif not (lo <= a and b <= hi):
                crossed = True  # neither in one gap of it, nor around it, nor beside it
                break
        if not crossed:
            valid.append(name)
            gap_of[name] = min(around)[2] if around else -1
    return {token: (name, k, gap_of[name]) for name in valid for k, (_, _, token) in enumerate(classes[name])}


def main_text(tokens: list, template: dict[int, tuple]) -> str:
    """Blocks of the slots that hold the article. ``template``: token -> (class, order, gap, kind) with
    kind 0 for a tag before a slot of main text, 1 for a tag before another slot, 2 for text."""
    keys = [token_key(t) for t in tokens] if template else []
    last: dict[int, int] = {}
    invalid, seen = set(), set()
    for k in keys:
        if k in template and k not in seen:
            seen.add(k)
            name, order = template[k][:2]
            if order < last.get(name, -1):
                invalid.add(name)
            last[name] = max(order, last.get(name, -1))
    judged: dict[int, bool] = {}  # what is nested in a gap of an invalid class is no part of this page's template
    for k in seen:
        way = []
        while k in template and k not in judged and template[k][0] not in invalid:
            judged[k] = False  # until the gaps around it are known; a gap never lies in itself
            way.append(k)
            k = template[k][2]
        bad = k in template and (template[k][0] in invalid or judged[k])
        for x in way:
            judged[x] = bad
    invalid.update(template[k][0] for k, bad in judged.items() if bad)
    known = lambda k: template[k][3] if k in template and template[k][0] not in invalid else None
    blocks, slot = [], None
    for i, t in enumerate(tokens):
        if t[0] != "text":
            slot = known(keys[i]) if keys else None
        elif not t[4] and slot != 1:
            blocks.append((t[3], t[2], bool(keys) and known(keys[i]) == 2))
    region = next((r for r in ("article", "main") if any(b[0] == r for b in blocks)), "")
    blocks = [b for b in blocks if not region or b[0] == region]
    fixed = sum(len(b[1]) for b in blocks if b[2])
    if not region or 2 * fixed <= sum(len(b[1]) for b in blocks):
        blocks = [b for b in blocks if not b[2]]
    return "\n\n".join(b[1] for b in blocks)


_FOUND = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("text", pa.bool_()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("chars", pa.int64()), ("barred", pa.int64()), ("links", pa.int64())])


def _tokens(batches):
    """A row for each token of a page: its kind, count and places, and the text in the slot after it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = []
            for page, url, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                host, found, slot = host_of(url), {}, None
                found[-1] = [host, page, -1, False, 1, 0, 0, 0, 0, 0]  # counts the host's pages
                for place, t in enumerate(parse(text)):
                    k = token_key(t)
                    row = found.setdefault(k, [host, page, k, t[0] == "text", 0, place, 0, 0, 0, 0])
                    row[4] += 1
                    row[6] = place
                    if t[0] != "text":
                        slot = row
                    elif slot is not None:
                        n = len(t[2])
                        slot[7] += n
                        slot[8] += n if t[6] else 0
                        slot[9] += 0 if t[3] or t[5] < LINKED else n
                rows.extend(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _nest(group):
    rows = group.to_pylist()
    kind = {r["token"]: 2 if r["text"] else int(2 * r["barred"] > r["chars"] or (r["chars"] > 0 and r["links"] >= LINKED * r["chars"])) for r in rows}
    found = nested([(r["token"], r["class"], r["first"], r["last"]) for r in rows])
    out = {"host": [rows[0]["host"]] * len(found), "token": list(found), **{c: [x[i] for x in found.values()] for i, c in enumerate(("class", "nth", "gap"))}, "kind": [kind[t] for t in found]}
    return pa.table(out, schema=pa.schema([("host", pa.string()), ("token", pa.int64()), ("class", pa.int64()), ("nth", pa.int32()), ("gap", pa.int64()), ("kind", pa.int32())]))


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, class, nth, gap, kind) of every host's template. ``pages``: page, url, html; equal ``page`` numbers are copies."""
    rows = pages.mapInArrow(_tokens, "host string, page long, token long, text boolean, n int, first int, last int, chars long, barred long, links long")
    once = rows.groupBy("host", "token", "page").agg(*[F.first(c).alias(c) for c in ("text", "n", "first", "last", "chars", "barred", "links")])
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "page", "n"), F.lit(2**31 - 1)))
    sums = [F.sum(c).alias(c) for c in ("chars", "barred", "links")]
    vectors = store(once.groupBy("host", "token").agg(F.count("*").alias("pages"), part(1).alias("v1"), part(2).alias("v2"), F.first("text").alias("text"), F.avg("first").alias("first"), F.avg("last").alias("last"), *sums))
    totals = vectors.filter("token = -1").select("host", F.col("pages").alias("all_pages"))
    held = vectors.filter("token <> -1").filter(F.col("pages") >= LEAST_PAGES).join(totals, "host").filter(F.col("pages") >= SHARE * F.col("all_pages"))
    held = held.select("host", "token", F.xxhash64("pages", "v1", "v2").alias("class"), "text", "first", "last", "chars", "barred", "links")
    return held.groupBy("host").applyInArrow(_nest, "host string, token long, class long, nth int, gap long, kind int")


def _extract(shared):
    def run(batches):
        known = shared.value if shared is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                own = part.column(3).to_pylist() if known is None else [None] * part.num_rows
                for url, page, rows in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), own, strict=True):
                    t = known.get(host_of(url), {}) if known is not None else {r["token"]: (r["class"], r["nth"], r["gap"], r["kind"]) for r in rows or ()}
                    out.append(main_text(parse(page), t))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text for every page."""
    spark = pages.sparkSession
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = store(templates(rows.select(F.xxhash64("html").alias("page"), "url", "html")))
    if found.count() <= BROADCAST_TOKENS:
        known: dict[str, dict] = {}
        for r in found.collect():  # at most BROADCAST_TOKENS rows
            known.setdefault(r["host"], {})[r["token"]] = (r["class"], r["nth"], r["gap"], r["kind"])
        out = rows.mapInArrow(_extract(spark.sparkContext.broadcast(known)), "id long, url string, text string")
    else:
        host = F.lower(F.coalesce(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1), F.lit("")))
        by_host = found.groupBy("host").agg(F.collect_list(F.struct("token", "class", "nth", "gap", "kind")).alias("template"))
        by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("host", host).withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        joined = salted.join(by_host, ["host", "salt"], "left").select("id", "url", "html", "template")
        out = joined.mapInArrow(_extract(None), "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
