"""Main text of HTML pages by consensus host paths.

Each page scores its containers and votes for the best one's tag-class path; the votes are counted by host, and every page of a host is extracted at the path that won there.
Paths are generalised: numbers and hashes in class names don't count, ids and positions aren't part of them. Votes carry a 64-bit hash of the path, so that their size doesn't
grow with a page's depth. Every step takes time in proportion to the page, whatever its markup."""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from byteloom._ship import by_value
from byteloom.llm.common import BROADCAST_BYTES, table

by_value(__name__)

#: Comments, declarations, and the name that starts a tag.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: The rest of a tag; and where a quote is never closed, to the first end whatever is quoted.
ATTRS = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)")
LOOSE = re.compile(r"([^>]*+)(?:>|\Z)")
CLASS = re.compile(r"""(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for x in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Their text isn't content.
SKIP = RAW - {"textarea"} | {"nav", "footer", "aside", "form", "button", "select", "template", "noscript", "svg", "head", "menu", "dialog"}
BLOCK = set("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul body html br".split())
#: What an opening tag ends, and inside of which elements only.
ENDS = {
    **{t: ({"p"}, {"button", "td", "th", "caption", "object", "table"}) for t in BLOCK - {"br", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html", "li", "dt", "dd"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote", "header", "figure", "dd", "li", "span", "fieldset"}
SPEAKING = re.compile(r"(?i)article|content|entry|post|story|text|body|main")
SILENT = re.compile(r"(?i)(?:^|[^a-z])(?:ad|ads|advert\w*|banner|comment\w*|cookie\w*|footer|menu|nav\w*|promo\w*|related|share|sidebar|social|sponsor\w*|widget)(?:$|[^a-z])")
SHORTEST = 25
#: Pages that one task extracts for a host of very many, where the winners are too many to be sent to all.
HOST_PAGES = 50_000


def general(tag: str, attrs: str) -> str:
    """The tag with its classes, sorted, without what differs from page to page."""
    m = CLASS.search(attrs) if attrs and "lass" in attrs.lower() else None
    if not m:
        return tag
    names = {"#" if re.fullmatch(r"(?=.*\d)[0-9a-fA-F]{6,}", c) else re.sub(r"\d+", "#", c) for c in entities.unescape(m.group(1).strip("\"'")).split()}
    return ".".join([tag, *sorted(names)])


class Node:
    __slots__ = ("key", "kids", "label", "parent", "tag")

    def __init__(self, tag: str, label: str, parent: Node | None, key: int = 0):
        self.tag, self.label, self.parent, self.key, self.kids = tag, label, parent, key, []


def step(key: int, label: str) -> int:
    """The hash of a path from that of its parent's and its last label."""
    return xxhash.xxh3_64_intdigest(label, key)


def parse(page: str) -> Node:
    """A tree that tolerates what pages have: unclosed and misnested tags, stray ends, raw text, an end in the midst of markup.

    Open elements are kept by depth and by tag, so an end finds its start without a walk. After a quote that is never closed, quotes don't count in the rest of the page."""
    root = Node("#root", "", None)
    open_, depths = [root], {}  # depths: of each tag those of its open elements
    attrs_of = ATTRS
    at, n = 0, len(page)

    def close(depth: int) -> None:
        """Ends all open elements from ``depth`` on."""
        while len(open_) > depth:
            depths[open_.pop().tag].pop()

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            open_[-1].kids.append(page[at:])
            break
        if m.start() > at:
            open_[-1].kids.append(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            if m.group(0).startswith("<![CDATA["):
                open_[-1].kids.append(m.group(0)[9:].removesuffix("]]>"))
            continue
        rest = attrs_of.match(page, at)
        if not rest:
            attrs_of = LOOSE
            rest = LOOSE.match(page, at)
        at = rest.end()
        tag, attrs = m.group(2).lower(), rest.group(1)
        if m.group(1):
            if depths.get(tag):
                close(depths[tag][-1])
            continue
        if tag in ENDS:
            ended, inside = ENDS[tag]
            if found := [d for x in ended if (d := depths.get(x))]:
                bound = max((depths[x][-1] for x in inside if depths.get(x)), default=0)
                if outer := [d[k] for d in found if (k := bisect.bisect_right(d, bound)) < len(d)]:
                    close(min(outer))
        up = open_[-1]
        label = general(tag, attrs)
        child = Node(tag, label, up, up.key if tag in ("html", "tbody") else step(up.key, label))
        up.kids.append(child)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            child.kids.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else n
        elif tag not in VOID:
            depths.setdefault(tag, []).append(len(open_))
            open_.append(child)
    return root


def key_of(path: str) -> int:
    """The hash of a path as ``path`` writes it."""
    key = 0
    for label in path.split(">"):
        key = step(key, label)
    return key


def path(node: Node) -> str:
    labels = []
    while node.parent is not None:
        if node.tag not in ("html", "tbody"):
            labels.append(node.label)
        node = node.parent
    return ">".join(reversed(labels))


def containers(root: Node) -> list[tuple[float, int, Node]]:
    """(score, order, node) of the containers that have text of their own, best first; equal scores by their order in the page.

    Runs of text of SHORTEST characters and more give points to their nearest container, and half of them to the one around that; the share of text in links
    is taken off, speaking names add a quarter, and silent ones take three quarters, of what they pass on as well. An article or main element starts with a point."""
    own: list[list] = []  # of each container: points, characters, those in links, the container around it, its node, what its names make of it
    stack = [(root, -1, False)]
    while stack:
        node, box, link = stack.pop()
        if node.tag in SKIP:
            continue
        if node.tag in CONTAINERS and node.tag not in ("span", "li") or node.tag == "#root":
            names = node.label.partition(".")[2]
            factor = (1.25 if node.tag in ("article", "main") or SPEAKING.search(names) else 1) * (0.25 if SILENT.search(names) else 1)
            own.append([float(node.tag in ("article", "main")), 0, 0, box, node, factor])
            box = len(own) - 1
        link = link or node.tag == "a"
        size = commas = 0
        for k in node.kids:
            if isinstance(k, str):
                size += len(k.strip())
                commas += k.count(",")
        own[box][1] += size
        if link:
            own[box][2] += size
        elif size >= SHORTEST:
            points = 1 + min(commas, 10) + min(size / 100, 30)
            own[box][0] += points
            if own[box][3] >= 0:
                own[own[box][3]][0] += points / 2 * min(1, own[box][5])
        stack.extend((k, box, link) for k in reversed(node.kids) if isinstance(k, Node))
    out = []
    for k, (score, chars, linked, _, node, factor) in enumerate(own):
        score *= factor * (1 - linked / chars if chars else 1)
        if score > 0:
            out.append((score, k, node))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def text_of(node: Node) -> str:
    """The text, a line for each block; what isn't content, and parts with silent names, are left out."""
    parts: list[str] = []

    def walk(top: Node) -> None:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            if x is not top and (x.tag in SKIP or SILENT.search(x.label.partition(".")[2])):
                continue
            if x.tag in BLOCK:
                parts.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.kids))

    walk(node)
    lines = (" ".join(x.split()) for x in entities.unescape("".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x)


def vote(page: str | None) -> int | None:
    """The hash of the path of the page's best container; of equal ones the first in the page."""
    return next((node.key for _, _, node in containers(parse(page)) if node.parent is not None), None) if page else None


def extract(page: str | None, ranks: dict[int, int]) -> tuple[str | None, str]:
    """(path, text) at the path of least rank that the page has text at; else at the page's own best container; else all of it. ``ranks`` are by the paths' hashes."""
    if not page:
        return None, ""
    root = parse(page)
    by: dict[int, list[Node]] = {}
    stack = [root] if ranks else []
    while stack:
        x = stack.pop()
        if x.tag in SKIP:
            continue
        if x.parent is not None and x.key in ranks:
            by.setdefault(x.key, []).append(x)
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node))
    for key in sorted(by, key=ranks.__getitem__):
        # html and tbody have the hash of what they're in, whose text holds theirs
        own = [x for x in by[key] if x.parent.key != key or x.parent.parent is None]
        text = "\n".join(t for t in map(text_of, own) if t)
        if text:
            return path(own[0]), text
    for _, _, node in containers(root)[:1]:
        return path(node) or None, text_of(node)
    return None, text_of(root)


def host_of(url):
    """The host of a URL column in lower case; empty for what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, rank): all paths that pages of a host voted for, a vote a page, most votes first from 1; ties go by the path's hash. Pages without a host don't vote."""

    def run(batches):
        for b in batches:
            sums = Counter((host, v) for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (v := vote(page)) is not None)
            signed = np.array([v for _, v in sums], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array(signed), pa.array(sums.values(), pa.int64())], ["host", "path", "votes"])

    cast = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("h")).where("host <> ''").mapInArrow(run, "host string, path bigint, votes bigint")
    total = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return total.select("host", "path", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path")).cast("int").alias("rank"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, text) of every row.

    A page is extracted at the path of its host with most votes that it has text at; equal votes go by the path's hash. Null and empty pages have an empty text and no path;
    a page without a host, or without any of its host's paths, is extracted at its own best container, and one without containers whole. Very long and very deep pages are read whole,
    in time in proportion to their length. Repeated rows each vote and each have a row; null ids stay null. Other columns are ignored; an empty table gives an empty one.

    The winners go to all executors if the strings and numbers of their rows, summed up, have at most BROADCAST_BYTES. Else pages are brought to their host's winners, in parts of
    about HOST_PAGES pages of a host, and a task reads the winners of one host after the other."""
    won = table(host_paths(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    size = won.agg(F.sum(F.octet_length("host") + 160)).first()[0] or 0
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, text string"

    def rows_of(b, ranks):
        """The extracted pages of a batch of (page_id, host, html); ``ranks`` gives a host's."""
        for i in range(0, b.num_rows, 500):
            part = b.take(pa.array(range(i, min(i + 500, b.num_rows))))
            got = [extract(h, ranks(x)) for x, h in zip(part.column("host").to_pylist(), part.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array([p for p, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], ["page_id", "host", "path", "text"])

    if size <= BROADCAST_BYTES:
        lists = {r.host: np.array(r.paths, np.int64).view(np.uint64) for r in won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths")).collect()}
        shared = pages.sparkSession.sparkContext.broadcast(lists)

        def run(batches):
            lists = shared.value
            met: dict[str, dict[int, int]] = {}

            def ranks(host):
                if host not in met:
                    if len(met) > 1000:
                        met.clear()
                    met[host] = {p: k for k, p in enumerate(lists[host].tolist())} if host in lists else {}
                return met[host]

            for b in batches:
                yield from rows_of(b, ranks)

        return rows.mapInArrow(run, schema)
    return _beside_winners(rows, won, rows_of, schema)


def _beside_winners(rows: DataFrame, won: DataFrame, rows_of, schema: str) -> DataFrame:
    """Pages and their host's winners meet in tasks by host and part; a host's winners come first there, and are read one by one."""
    parts = table(rows.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).alias("parts"))).withColumnRenamed("host", "p_host")
    same = F.col("host") == F.col("p_host")
    kind = rows.schema["page_id"].dataType
    winners = won.join(parts, same).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    winners = winners.select("host", "part", "rank", "path", F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("html"))
    many = F.coalesce("parts", F.lit(1))
    # pages of a host of few aren't told apart by part, so that the parts needn't be joined to them
    big = parts.where("parts > 1")
    asked = rows.join(F.broadcast(big) if big.count() <= 100_000 else big, same, "left")
    asked = asked.select("host", F.pmod(F.xxhash64("page_id", "html"), many).alias("part"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("bigint").alias("path"), "page_id", "html")

    def run(batches):
        at, found = None, {}
        for b in batches:
            hosts, places = b.column("host").to_pylist(), b.column("part").to_pylist()
            ranks, paths = b.column("rank").to_pylist(), b.column("path").to_pylist()
            k = 0
            while k < b.num_rows:
                if (hosts[k], places[k]) != at:
                    at, found = (hosts[k], places[k]), {}
                if ranks[k] is not None:
                    found[paths[k] % (1 << 64)] = ranks[k]
                    k += 1
                    continue
                end = k
                while end < b.num_rows and (hosts[end], places[end]) == at and ranks[end] is None:
                    end += 1
                yield from rows_of(b.select(["page_id", "host", "html"]).take(pa.array(range(k, end))), lambda _, own=found: own)
                k = end

    return winners.unionByName(asked).repartition("host", "part").sortWithinPartitions("host", "part", F.asc_nulls_last("rank")).mapInArrow(run, schema)
