"""Problem 3: the main body of pages, apart from the site's frame."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import bounded, staged

#: Pages of a host that are aligned in one task, and neighbours each is aligned with.
BUCKET, NEIGHBOURS = 64, 4
#: A node is constant on a host if so large a share of its pages aligns it, and so many pages on small hosts.
LEAST_ALIGNED_SHARE, LEAST_ALIGNED = 0.005, 3
#: On hosts with fewer pages that share is less than one page: the template can't speak against a cue.
LEAST_HOST = int(1 / LEAST_ALIGNED_SHARE)

# Words and openings by which page furniture and notes are known, once the template has the line or a slot for it.
NOTE = re.compile(r"(note|tip|hint|warning|important|caution|danger|attention|info|example)s?\s*[:!]", re.I)
OUTLINE_TITLES = {"contents", "on this page", "in this article", "page outline", "table of contents", "outline", "in this section", "in this guide", "jump to"}
RELATED_TITLES = {"see also", "related topics", "readers also viewed", "related articles", "related pages", "related", "you may also like", "further reading", "read next", "popular articles", "recommended"}
RELATED_OPENING = re.compile(r"(more|also|popular|latest|news)\s+(from|on|in|at)\s+\S", re.I)
ADVERT_TITLES = {"advertisement", "advert", "sponsored", "promotion", "promoted", "ad"}
MENU_TITLES = {"menu", "toggle navigation", "navigation", "skip to main content", "skip to content", "skip navigation", "main menu", "back to top", "search", "close"}
CUES = re.compile(
    r"\b(?:(?P<consent>cookies?|privacy (policy|matters)|your privacy|adverts?|advertisement|tracking|accept all|reject|manage preferences"
    r")|(?P<promotion>newsletter|subscribe|sign up|sign in|log in"
    r")|(?P<feedback>print this|save as pdf|copy link|share this|rate this|was this (page|article)|helpful\?|found a mistake|suggest a change|edit this page|report (a|an) (problem|issue)|send feedback"
    r")|(?P<stamp>last updated|last modified|last reviewed|updated on|reviewed \d|written by|built with|served by|page id|revision|generated (by|on|at)|build \d"
    r")|(?P<legal>copyright|all rights reserved|legal notice|terms of use|imprint|sitemap|accessibility|trademarks?|without warranty|may be reused|written permit"
    r")|(?P<menu>back to top|skip to|you are here|jump to|toggle navigation|menu))\b|[©®]",
    re.I,
)
TITLES = {"outline": OUTLINE_TITLES, "related": RELATED_TITLES, "advert": ADVERT_TITLES, "menu": MENU_TITLES}
#: What sets a slot apart from a label; no line of text holds it.
SLOT = "\0"
_BULLET = re.compile(r"^(?:[*•·▪‣–—>»-]|\d+[.)])\s+")
_BLANKS = re.compile(r"[ \t\u00a0]+")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W_]+")
_TRAIL = re.compile(r"\s+(?:>|/|»|::|›|→|\\|\||•)\s+|,\s+")
_HERE = re.compile(r"^you are here\s*:?\s*", re.I)
_STAMP = re.compile(r"^(revision|page id|build|version id|node|request id|document id|ref)\b.*\b(served|rendered|generated|built)\b", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", (url or "").lower())
    return m.group(1) if m else ""


def tidy(line: str) -> str:
    s = line.strip()
    return s if "  " not in s and "\t" not in s and "\u00a0" not in s else _BLANKS.sub(" ", s)


def label(clean: str) -> str:
    """A tidy line without bullet, case and digits: what a constant node keeps."""
    return _DIGITS.sub("0", _BULLET.sub("", clean).lower())


#: Words at the head of a line that make a slot of their own: pages share the head, the rest varies.
HEAD_WORDS = 4


@lru_cache(maxsize=200_000)
def slots_of(clean: str) -> frozenset[str]:
    """What pages may share of a tidy line whose rest varies: its first words, and the kind of furniture that its words speak for."""
    s = _BULLET.sub("", clean)
    t = s.lower().rstrip(":")
    out = {f"title {name}" for name, titles in TITLES.items() if t in titles}
    if RELATED_OPENING.match(t) and len(_WORD.findall(s)) <= 5:
        out.add("title related")
    if arrowed(s, t):
        out.add("arrow")
    if HEAD_WORDS <= s.count(" ") < 30:
        out.add(head_slot(s))
    if s.count(" ") < 30:
        out |= {"cue " + (m.lastgroup or "legal") for m in CUES.finditer(s)}
        if _STAMP.match(s):
            out.add("cue stamp")
    return frozenset(out)


def head_slot(s: str) -> str:
    return "head " + _DIGITS.sub("0", " ".join(s.lower().split(" ", HEAD_WORDS)[:HEAD_WORDS]))


def arrowed(s: str, low: str) -> bool:
    return s.startswith(("←", "‹", "<-", "«")) or s.endswith(("→", "›", "->")) or bool(re.match(r"(previous|prev|next)\s*[:|]", low))


def node_of(kind: str, top: bool, text: str) -> str:
    return f"{kind}\n{top:d}\n{text}"


class Tree:
    """A page as a tree of two levels: groups (heading, list, code, text) and their lines."""

    def __init__(self, content: str):
        self.lines = content.split("\n")
        self.clean = [tidy(x) for x in self.lines]
        self.kind: list[str] = []
        self.groups: list[tuple[str, list[int]]] = []
        fenced, last = False, ""
        for i, s in enumerate(self.clean):
            mark = s.startswith("```")
            if fenced or mark:
                kind = "code"
            elif not s:
                kind = ""
            elif s.startswith("#") and s.lstrip("#")[:1] == " ":
                kind = "heading"
            elif s[0] in "*•·-" and s[1:2] == " ":
                kind = "list"
            elif s.startswith("|"):
                kind = "table"
            else:
                kind = "text"
            if mark:
                fenced = not fenced and "```" not in s[3:]
            self.kind.append(kind)
            if kind:
                if kind != last:
                    self.groups.append((kind, []))
                self.groups[-1][1].append(i)
            last = kind
        if fenced:  # a fence that stays open: what follows the next blank line is read as if it had closed there
            self._reopen()
        self.labels = [label(x) if k else "" for x, k in zip(self.clean, self.kind)]
        self.first = next((i for i, k in enumerate(self.kind) if k == "heading"), len(self.lines))

    def node(self, i: int) -> str:
        """A line as a node of the template: its kind, whether it stands above the first heading, and its label."""
        return node_of(self.kind[i], i < self.first, self.labels[i])

    @cached_property
    def parts(self) -> list[tuple[tuple[str, bool], list[str], set[str], set[str]]]:
        """Groups as they are aligned: (kind, place), nodes in order, their set, the slots of their lines."""
        out = []
        for k, at in self.groups:
            nodes = [self.node(i) for i in at]
            out.append(((k, at[0] < self.first), nodes, set(nodes), {z for i in at for z in self.slots(i)}))
        return out

    def slots(self, i: int) -> list[str]:
        """The slots of the template that a line may fill, as nodes of their own."""
        return [node_of(self.kind[i], i < self.first, SLOT + x) for x in slots_of(self.clean[i])] if self.kind[i] in ("list", "text") else []

    def _reopen(self) -> None:
        open_at = max(i for i, x in enumerate(self.clean) if x.startswith("```"))
        end = next((i for i in range(open_at + 1, len(self.clean)) if not self.clean[i]), len(self.clean))
        for i in range(end, len(self.lines)):
            s = self.clean[i]
            self.kind[i] = "" if not s else "heading" if s.startswith("#") and s.lstrip("#")[:1] == " " else "list" if re.match(r"^[*•·-]\s", s) else "text"
        self.groups = []
        last = ""
        for i, k in enumerate(self.kind):
            if k:
                if k != last:
                    self.groups.append((k, []))
                self.groups[-1][1].append(i)
            last = k


def align(x: Tree, y: Tree) -> set[str]:
    """Labels of the nodes that a simple tree matching of two pages pairs."""
    return {t for t in (n.split("\n", 2)[2] for n in align_nodes(x, y)) if not t.startswith(SLOT)}


def align_nodes(x: Tree, y: Tree) -> set[str]:
    """Nodes that a simple tree matching of two pages pairs: groups of one kind and place in order, equal lines in order within, and slots that both groups have."""
    gx, gy = x.parts, y.parts
    m, n = len(gx), len(gy)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    weight: dict[tuple[int, int], int] = {}
    for i in range(m):
        row, above = best[i + 1], best[i]
        for j in range(n):
            w = 0
            if gx[i][0] == gy[j][0]:
                same = len(gx[i][2] & gy[j][2])
                w = 1 + (_ordered(gx[i][1], gy[j][1]) if same > 1 else same)
                weight[i, j] = w
            row[j + 1] = max(above[j + 1], row[j], above[j] + w)
    out: set[str] = set()
    i, j = m, n
    while i and j:
        w = weight.get((i - 1, j - 1), 0)
        if w and best[i][j] == best[i - 1][j - 1] + w:
            out |= gx[i - 1][2] & gy[j - 1][2] | gx[i - 1][3] & gy[j - 1][3]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def _ordered(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for u in a:
        prev = 0
        for j, v in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = prev + 1 if u == v else max(row[j + 1], row[j])
            prev = keep
    return row[-1]


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def induce(pages: DataFrame) -> DataFrame:
    """Constant nodes of each host: host, node (hash of kind, place and label), aligned (pages on which it was matched).

    All pages take part.  Those of a host are dealt by hash to buckets of about
    BUCKET pages, so that no task gets a host whole; within a bucket each page is
    aligned with its next neighbours.  Matches are then counted over the host, of
    whose pages LEAST_ALIGNED_SHARE have to agree, so that a template is as strict
    on a host of any size.
    """
    hosted = pages.filter("content is not null and page_id is not null").withColumn("host", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")))
    sizes = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    sizes = staged(sizes.select("host", F.ceil(F.col("n") / F.lit(BUCKET)).alias("buckets"), F.greatest(F.lit(LEAST_ALIGNED), F.ceil(F.col("n") * F.lit(LEAST_ALIGNED_SHARE) - F.lit(1e-9))).alias("need")), "host-sizes")
    sizes = bounded(sizes)
    dealt = hosted.join(sizes, "host").select("host", F.pmod(F.xxhash64("page_id"), F.col("buckets")).alias("bucket"), "page_id", "content")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [Tree(c) for c in pdf.sort_values("page_id")["content"]]
        hit: list[set[str]] = [set() for _ in trees]
        for i in range(len(trees)):
            for d in range(1, min(NEIGHBOURS, len(trees) - 1) + 1):
                j = (i + d) % len(trees)
                common = align_nodes(trees[i], trees[j])
                hit[i] |= common
                hit[j] |= common
        count: dict[str, int] = {}
        for h in hit:
            for x in h:
                count[x] = count.get(x, 0) + 1
        return pd.DataFrame({"host": pdf["host"].iloc[0], "node": [_key(x) for x in count], "aligned": list(count.values())}, columns=["host", "node", "aligned"])

    votes = dealt.groupBy("host", "bucket").applyInPandas(match, "host string, node bigint, aligned bigint")
    return votes.groupBy("host", "node").agg(F.sum("aligned").alias("aligned")).join(sizes, "host").filter("aligned >= need").select("host", "node", "aligned")


def frame_lines(tree: Tree, constant: set[int], site: str, trail: list[str], title: str, alone: bool = False) -> list[bool]:
    """For each line whether it belongs to the frame: constant nodes that aren't part of the text, and the slots that hang on them.

    Titles, arrows, stamps and cue words only tell what a node is that the
    template has, as a constant line or as a slot; with ``alone``, on hosts too
    small for a template, they decide by themselves.
    """
    n = len(tree.lines)
    out = [False] * n
    bare = [_BULLET.sub("", x) for x in tree.clean]
    low = [b.lower().rstrip(":") for b in bare]
    heads = {low_heading(tree.clean[i]) for i in range(n) if tree.kind[i] == "heading"}
    name = site.lower()
    crumbs = [tidy(c).lower() for c in trail if c]

    def words(i: int) -> int:
        return len(_WORD.findall(bare[i]))

    def is_title(i: int, titles: set[str]) -> bool:
        return low[i] in titles

    def known(i: int) -> bool:
        return alone or tree_constant(tree, i, constant) or any(_key(z) in constant for z in tree.slots(i) if not z.split("\n", 2)[2].startswith(SLOT + "head "))

    def headed(i: int) -> bool:
        return HEAD_WORDS <= bare[i].count(" ") < 30 and _key(node_of(tree.kind[i], i < tree.first, SLOT + head_slot(bare[i]))) in constant

    follow = ""
    slots = 0
    for i in range(n):
        kind, s = tree.kind[i], bare[i]
        if not kind:
            continue
        if kind in ("heading", "code", "table"):
            follow = ""
            continue
        t = low[i]
        note = bool(NOTE.match(s)) and not (name and t.startswith(name))
        arrows = arrowed(s, t)
        parts = [p.lower() for p in _TRAIL.split(_HERE.sub("", s)) if p] if len(s) < 400 else []
        if note:
            follow = ""
        elif is_title(i, OUTLINE_TITLES) and known(i):
            out[i], follow = True, "outline"
        elif (is_title(i, RELATED_TITLES) or (RELATED_OPENING.match(t) and words(i) <= 5 and (not name or name in t))) and known(i):
            out[i], follow, slots = True, "related", 0
        elif is_title(i, ADVERT_TITLES) and known(i):
            out[i], follow, slots = True, "advert", 0
        elif is_title(i, MENU_TITLES) and known(i):
            out[i], follow = True, ""
        elif (arrows or t.startswith("you are here")) and known(i):
            out[i], follow = True, ""
        elif len(parts) > 1 and (len(crumbs) > 1 and set(parts) <= set(crumbs) | {name} or parts[-1] == title.lower() and (not name or parts[0] == name)):
            out[i], follow = True, ""
        elif s.count(" ") < 30 and (_STAMP.match(s) or cued(s) and words(i) <= 24) and known(i):
            out[i], follow = True, ""
        elif re.sub(r"^jump to\s+", "", t) in heads and (follow == "outline" or t not in heads or kind != "list"):
            out[i] = True
        elif follow == "outline" and t in heads:
            out[i] = True
        elif follow == "advert" and slots < 1:
            out[i], slots = True, slots + 1
        elif follow == "related" and words(i) <= 14 and not s.endswith((".", "!", "?", ";")):
            out[i] = True
        elif tree_constant(tree, i, constant) and words(i) <= 5 and not s.endswith((".", ";", "!")) and not re.search(r"[0-9]", s):
            out[i], follow = True, ""  # menu entries
        elif s.count(" | ") >= 3 and all(len(_WORD.findall(p)) <= 4 for p in s.split(" | ")) and (tree_constant(tree, i, constant) or all(_entry(p, constant) for p in s.split(" | "))):
            out[i], follow = True, ""
        elif name and (name in t and tree_constant(tree, i, constant) or t.startswith(name) and headed(i)):
            out[i], follow = True, ""
        else:
            follow = ""
    return out


@lru_cache(maxsize=200_000)
def cued(s: str) -> bool:
    """Whether a line has words of page furniture; frame lines come again and again, so most answers are remembered."""
    return bool(CUES.search(s))


def low_heading(line: str) -> str:
    return tidy(line).lstrip("#").strip().lower()


def tree_constant(tree: Tree, i: int, constant: set[int]) -> bool:
    return _key(tree.node(i)) in constant


def _entry(part: str, constant: set[int]) -> bool:
    """Whether a part of a menu bar is a constant node of its own, as line or list entry, anywhere."""
    return any(_key(node_of(k, top, label(part.strip()))) in constant for k in ("list", "text") for top in (True, False))


def frame_of_pages(pages: DataFrame, most_nodes: int = 1_000_000) -> DataFrame:
    """page_id, line_no, frame (boolean) for each non-blank line of every page.

    Method: wrapper induction.  Each page is read as a tree of groups and lines;
    pages of a host are aligned by simple tree matching; nodes that stay constant
    are the template, among them slots, whose lines vary but for their first words
    or for words of page furniture.  A line is frame if it is a constant node outside headings,
    code, tables and notes, or fills a slot that hangs on the template: the trail
    (compared with breadcrumb), entries of contents and related lists, adverts,
    neighbour links, dates and stamps.  The rest, the varying slots, is content.

    A template of up to ``most_nodes`` nodes is sent to the workers; of a larger
    one each page gets, by a join on host and node, what its lines may be.

    Null contents give no row; null titles, breadcrumbs and urls only remove
    hints.  Repeated pages are judged each on its own.
    """
    template = staged(induce(pages), "template")
    hosted = pages.filter("content is not null and page_id is not null").select(F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.col("page_id").cast("bigint").alias("page_id"), "title", "breadcrumb", "content", "url")
    first = hosted.filter(F.size("breadcrumb") > 0).groupBy("host", F.col("breadcrumb")[0].alias("site")).agg(F.count(F.lit(1)).alias("n"))
    counts = hosted.groupBy("host").agg((F.count(F.lit(1)) < LEAST_HOST).alias("alone"))
    facts = staged(counts.join(first.groupBy("host").agg(F.max_by("site", F.struct("n", "site")).alias("site")), "host", "left"), "host-facts")
    if template.count() <= most_nodes and facts.count() <= 100_000:  # the whole template is sent
        nodes: dict[str, set[int]] = {}
        for h, x in template.select("host", "node").toLocalIterator():
            nodes.setdefault(h, set()).add(x)
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (nodes.get(r["host"], set()), r["site"] or "", r["alone"]) for r in facts.toLocalIterator()})
        hosted = hosted.withColumns({"nodes": F.lit(None).cast("array<bigint>"), "site": F.lit(None).cast("string"), "alone": F.lit(None).cast("boolean")})
    else:  # each page gets of its host's template what its own lines may be
        sent = None
        lined = hosted.withColumn("page", F.xxhash64("page_id", "content"))
        own = lined.select("host", "page", "content").mapInArrow(_page_nodes, "host string, page bigint, node bigint").join(template.select("host", "node"), ["host", "node"])
        hosted = lined.join(own.groupBy("host", "page").agg(F.collect_set("node").alias("nodes")), ["host", "page"], "left").join(bounded(facts), "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, flags = [], [], []
            for host, page, title, crumbs, content, nodes, site, alone in zip(*(batch.column(k).to_pylist() for k in range(8))):
                known, site, alone = sent.value[host] if sent else (set(nodes or []), site or "", alone)
                for i, f in enumerate(judge(content, known, site, crumbs, title, alone)):
                    if f is not None:
                        ids.append(page)
                        nos.append(i)
                        flags.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(flags, pa.bool_())], names=["page_id", "line_no", "frame"])

    return hosted.select("host", "page_id", "title", "breadcrumb", "content", "nodes", "site", "alone").mapInArrow(run, "page_id bigint, line_no int, frame boolean")


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page, node: every node of a template that a line of the page, or a part of a menu bar, may be."""
    for batch in batches:
        out: list[tuple[str, int, int]] = []
        for host, page, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
            tree = Tree(content)
            own = {tree.node(i) for i, k in enumerate(tree.kind) if k} | {z for i, k in enumerate(tree.kind) if k for z in tree.slots(i)}
            parts = {label(p.strip()) for x in tree.clean if " | " in x for p in _BULLET.sub("", x).split(" | ")}
            own |= {node_of(k, top, p) for p in parts for k in ("list", "text") for top in (True, False)}
            out += [(host, page, _key(x)) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["host", "page", "node"])


def judge(content: str, constant: set[int], site: str, crumbs: list[str] | None, title: str | None, alone: bool = False) -> list[bool | None]:
    """For each line whether it is frame; None for blank lines."""
    tree = Tree(content)
    trail = [c for c in crumbs or [] if c]
    own = title or (trail[-1] if trail else "") or next((low_heading(x) for x, k in zip(tree.lines, tree.kind) if k == "heading"), "")
    flags = frame_lines(tree, constant, site or (trail[0] if trail else ""), trail, own, alone)
    return [f if x else None for f, x in zip(flags, tree.clean)]


def main_bodies(pages: DataFrame) -> DataFrame:
    """page_id, body: each page's content without its frame lines; null contents stay null."""
    gone = frame_of_pages(pages).filter("frame").groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    lines = F.split("content", "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i), x)), lambda x: x.isNotNull())
    return pages.select("page_id", "content").join(gone, "page_id", "left").select("page_id", F.trim(F.array_join(left, "\n")).alias("body"))
