"""Queries over pages, urls and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import text as T
from ..operators import chunking as K
from ..operators.crawl import crawl, crawl_sections
from ..session import table
from .queries_retrieval import _TOKENS

_B = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
_NB = r"[^\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"


def _tok(c: str) -> str:
    return _TOKENS.replace("content", c)


def _pages(s, d):
    return table(s, d, "scraped_page").filter("content is not null")


def _items(s, d):
    a = table(s, d, "scraped_page").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "content")
    return a.unionByName(table(s, d, "doc_chunk").select(F.lit("chunk").alias("kind"), F.col("chunk_row").alias("id"), "content"))


def _urls(s, d):
    u = F.col("url")
    return table(s, d, "scraped_page").select("page_id", F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"), T.url_hash(u).alias("hash"), T.slug_title(u).alias("slug"))


def _links(s, d):
    bases = F.broadcast(table(s, d, "crawl_source").select("section", "base_url"))
    pairs = table(s, d, "scraped_page").select("page_id", "url").join(bases, H.is_doc_link(F.col("url"), F.col("base_url")))
    return pairs.select("page_id", "section")


def _headings(s, d):
    rows = _pages(s, d).select("page_id", F.posexplode(K.split_headings(F.col("content"), 2)).alias("pos", "part"))
    return rows.select("page_id", "pos", F.col("part.heading").alias("heading"), F.md5(F.col("part.body")).alias("body"))


def _blocks(s, d):
    return _pages(s, d).select("page_id", F.posexplode(K.split_blocks(F.col("content"))).alias("pos", "block"))


def _packed(s, d):
    rows = _pages(s, d).select("page_id", K.pack_groups(F.transform(K.split_blocks(F.col("content")), T.token_estimate), 200).alias("g"))
    return rows.select("page_id", F.posexplode("g").alias("pos", "grp"))


def _chunks(s, d):
    return K.chunk_pages(table(s, d, "scraped_page")).withColumn("content", F.md5("content")).withColumn("path", F.array_join("heading_hierarchy", " > ")).select("chunk_id", "content", "source_url", "token_count", "path", "has_code")


def _merged(s, d):
    """Second-level sections of each page with the small ones merged into their successors."""
    parts = F.transform(K.split_headings(F.col("content"), 2), lambda p: F.struct(p["body"].alias("text"), F.array().cast("array<string>").alias("path")))
    rows = _pages(s, d).select("page_id", parts.alias("p")).select("page_id", F.posexplode(K.merge_small(F.col("p"), 60)).alias("pos", "c"))
    return rows.select("page_id", "pos", F.md5("c.text").alias("text"))


def _overlaps(s, d):
    return table(s, d, "doc_chunk").filter("content is not null").select("chunk_row", F.md5(T.tail_words(F.col("content"), 40)).alias("tail"))


def _html(s, d):
    """Pages set as HTML (headings, items, paragraphs of their lines) and read back by the parser."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split("content", "\n"), lambda x: F.when(x.startswith("# "), F.concat(F.lit("<h1>"), esc(F.substr(x, F.lit(3))), F.lit("</h1>"))).when(x.startswith("- "), F.concat(F.lit("<li>"), esc(F.substr(x, F.lit(3))), F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))))
    made = _pages(s, d).select("url", F.concat(F.lit("<html><body><nav>menu</nav><main>"), F.array_join(lines, "\n"), F.lit("</main></body></html>")).alias("html"))
    return H.scraped_pages(H.extract_pages(made)).select("url", "title", "url_hash", F.md5("content").alias("content"), F.size("headings").alias("n_headings"))


def _graph(s, d):
    """Links between pages: each page to the next two of its section by page_id, and to the first of the next section by name."""
    p = table(s, d, "scraped_page").filter("section is not null").select("section", "page_id")
    w = Window.partitionBy("section").orderBy("page_id")
    after = p.select(F.col("page_id").alias("src"), F.lead("page_id", 1).over(w).alias("x"), F.lead("page_id", 2).over(w).alias("y"))
    near = after.select("src", F.explode(F.array("x", "y")).alias("dst"))
    firsts = p.groupBy("section").agg(F.min("page_id").alias("f"))  # a row per section
    over = firsts.select(F.col("f").alias("src"), F.lead("f").over(Window.orderBy("section")).alias("dst"))
    return near.unionByName(over).filter("dst is not null")


def _roots(s, d):
    """The first page of every section; sections in the order of their names."""
    firsts = table(s, d, "scraped_page").filter("section is not null").groupBy("section").agg(F.min("page_id").alias("page"))
    depths = table(s, d, "crawl_source").select("section", "max_depth")
    return firsts.join(depths, "section", "left").withColumn("priority", F.rank().over(Window.orderBy("section")))


def _bfs(s, d):
    return crawl(_graph(s, d), _roots(s, d).select("page"), 12)


def _sections(s, d):
    return crawl_sections(_graph(s, d), _roots(s, d), 4).select("page", "section", "depth")


QUERIES = {
    "token_estimate": lambda s, d: _items(s, d).select("kind", "id", T.token_estimate(F.col("content")).alias("tokens")),
    "url_parts": _urls,
    "link_filter": _links,
    "tidy_text": lambda s, d: _pages(s, d).select("page_id", F.md5(T.tidy(F.col("content"))).alias("text")),
    "page_gate": lambda s, d: _pages(s, d).filter(F.length(T.strip(F.col("content"))) >= 50).select("page_id", F.coalesce(F.get("headings", F.lit(0)), T.slug_title(F.col("url"))).alias("title")),
    "split_headings": _headings,
    "split_blocks": _blocks,
    "pack_blocks": _packed,
    "merge_small": _merged,
    "overlap_tails": _overlaps,
    "chunk_rows": _chunks,
    "chunk_stats": lambda s, d: K.chunk_stats(table(s, d, "doc_chunk")),
    "chunk_metadata": lambda s, d: K.chunk_metadata(table(s, d, "doc_chunk")),
    "html_to_text": _html,
    "crawl_bfs": _bfs,
    "crawl_sections": _sections,
}
_BLOCKS = r"""
  l AS (SELECT page_id, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS no FROM scraped_page WHERE content IS NOT NULL),
  f AS (SELECT *, regexp_matches(line, '^[ \t]*```') AS fence, sum(regexp_matches(line, '^[ \t]*```')::INT) OVER (PARTITION BY page_id ORDER BY no) AS upto FROM l),
  g AS (SELECT *, (fence OR upto % 2 = 1) AS code, CASE WHEN fence AND upto % 2 = 0 THEN upto - 1 ELSE upto END AS span FROM f),
  h AS (SELECT *, NOT code AND NOT regexp_matches(line, '\S') AS gap FROM g),
  k AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY no) AS para FROM h),
  b AS (SELECT page_id, min(no) AS no, regexp_replace(string_agg(line, chr(10) ORDER BY no), '^[\n ]+|\s+$', '', 'g') AS block FROM k WHERE NOT gap GROUP BY page_id, code, span, para),
  blocks AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY no) - 1 AS INT) AS pos, block FROM b WHERE regexp_matches(block, '[^\s\x{00A0}\x{2000}-\x{200A}\x{3000}]'))"""
_PARTS = rf"""
  m AS (SELECT page_id, content, string_split(regexp_replace(content, '(?m)^##\s+(.+)$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM scraped_page WHERE content IS NOT NULL),
  e AS (SELECT page_id, content, len(p) AS n, unnest(p) AS part, unnest(generate_series(1, len(p))) AS i FROM m),
  parts0 AS (SELECT page_id, i, CASE WHEN i = 1 THEN NULL ELSE {_strip("split_part(part, chr(2), 1)")} END AS heading,
    CASE WHEN n = 1 THEN content WHEN i = 1 THEN {_strip("part")} ELSE {_strip("split_part(part, chr(2), -1)")} END AS body
    FROM e WHERE n = 1 OR i > 1 OR regexp_matches(part, '{_NB}')),
  parts AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, heading, body FROM parts0)"""
_SLUG = r"regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)"
_TITLE = f"array_to_string(list_transform(string_split(translate({_SLUG}, '_-', '  '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
_BAD = r"regexp_matches(regexp_replace(path, '/+$', ''), '\.(png|jpg|jpeg|gif|svg|pdf|zip|tar|gz|css|js|xml|json|yaml|yml)$')"
_NLNL = "chr(10) || chr(10)"


def _split_sql(name: str, source: str, level: int, keys: str) -> str:
    """CTEs that cut source(keys, body) at headings of a level into name(keys, no, heading, part)."""
    return rf"""{name}_m AS (SELECT {keys}, body, string_split(regexp_replace(body, '(?m)^{"#" * level}\s+(.+)$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM {source}),
  {name}_e AS (SELECT {keys}, body, len(p) AS n, unnest(p) AS x, unnest(generate_series(1, len(p))) AS no FROM {name}_m),
  {name} AS (SELECT {keys}, no, CASE WHEN no = 1 THEN '' ELSE {_strip("split_part(x, chr(2), 1)")} END AS heading, CASE WHEN n = 1 THEN body WHEN no = 1 THEN {_strip("x")} ELSE {_strip("split_part(x, chr(2), -1)")} END AS part
    FROM {name}_e WHERE n = 1 OR no > 1 OR regexp_matches(x, '{_NB}'))"""


_CHUNKER = rf"""WITH RECURSIVE pages AS (SELECT page_id, content AS body FROM scraped_page WHERE regexp_matches(coalesce(content, ''), '{_NB}')),
  {_split_sql("s2", "pages", 2, "page_id")},
  w2 AS (SELECT page_id, no AS i, heading AS h2, part AS body, CASE WHEN heading <> '' THEN '## ' || heading || chr(10) || part ELSE part END AS whole FROM s2),
  big AS (SELECT page_id, i, h2, body FROM w2 WHERE {_tok('whole')} > 1000),
  {_split_sql("s3", "big", 3, "page_id, i, h2")},
  w3 AS (SELECT page_id, i, h2, no AS j, heading AS h3, CASE WHEN heading <> '' THEN '### ' || heading || chr(10) || part ELSE part END AS sub FROM s3),
  bl AS (SELECT page_id, i, j, unnest(string_split(sub, chr(10))) AS line, unnest(generate_series(1, len(string_split(sub, chr(10))))) AS ln FROM w3 WHERE {_tok('sub')} > 1000),
  bf AS (SELECT *, regexp_matches(line, '^[ \t]*```') AS fence, sum(regexp_matches(line, '^[ \t]*```')::INT) OVER (PARTITION BY page_id, i, j ORDER BY ln) AS upto FROM bl),
  bg AS (SELECT *, (fence OR upto % 2 = 1) AS code, CASE WHEN fence AND upto % 2 = 0 THEN upto - 1 ELSE upto END AS span FROM bf),
  bk AS (SELECT *, NOT code AND NOT regexp_matches(line, '\S') AS gap FROM bg),
  bp AS (SELECT *, sum(gap::INT) OVER (PARTITION BY page_id, i, j ORDER BY ln) AS para FROM bk),
  bb AS (SELECT page_id, i, j, min(ln) AS ln, regexp_replace(string_agg(line, chr(10) ORDER BY ln), '^[\n ]+|\s+$', '', 'g') AS block FROM bp WHERE NOT gap GROUP BY page_id, i, j, code, span, para),
  bn AS (SELECT *, {_tok('block')} AS t, row_number() OVER (PARTITION BY page_id, i, j ORDER BY ln) AS k FROM bb WHERE regexp_matches(block, '{_NB}')),
  pk AS (SELECT page_id, i, j, k, block, t AS cur, 0 AS g FROM bn WHERE k = 1
    UNION ALL SELECT n.page_id, n.i, n.j, n.k, n.block, CASE WHEN p.cur > 0 AND p.cur + n.t > 1000 THEN n.t ELSE p.cur + n.t END, CASE WHEN p.cur > 0 AND p.cur + n.t > 1000 THEN p.g + 1 ELSE p.g END
    FROM pk p JOIN bn n ON n.page_id = p.page_id AND n.i = p.i AND n.j = p.j AND n.k = p.k + 1),
  cuts AS (SELECT page_id, i, 0 AS j, 0 AS g, whole AS text, h2, '' AS h3 FROM w2 WHERE {_tok('whole')} <= 1000
    UNION ALL SELECT page_id, i, j, 0, sub, h2, h3 FROM w3 WHERE {_tok('sub')} <= 1000
    UNION ALL SELECT page_id, i, j, g, string_agg(block, {_NLNL} ORDER BY k), any_value(h2), any_value(h3) FROM pk JOIN w3 USING (page_id, i, j) GROUP BY page_id, i, j, g),
  c1 AS (SELECT c.page_id, text, list_filter([title, h2, h3], lambda x: coalesce(x, '') <> '') AS path, row_number() OVER (PARTITION BY c.page_id ORDER BY i, j, g) AS pos FROM cuts c JOIN scraped_page USING (page_id) WHERE regexp_matches(text, '{_NB}')),
  c2 AS (SELECT *, {_tok('text')} < 100 AS small, lead(text) OVER w AS nxt, lead(path) OVER w AS npath FROM c1 WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
  c3 AS (SELECT *, pos - row_number() OVER (PARTITION BY page_id, small ORDER BY pos) AS run FROM c2),
  c4 AS (SELECT *, row_number() OVER (PARTITION BY page_id, small, run ORDER BY pos) AS k FROM c3),
  c5 AS (SELECT *, small AND nxt IS NOT NULL AND k % 2 = 1 AS head FROM c4),
  c6 AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY page_id ORDER BY pos), false) AS used FROM c5),
  c7 AS (SELECT page_id, pos, CASE WHEN head THEN text || {_NLNL} || nxt ELSE text END AS text, CASE WHEN head AND len(npath) > len(path) THEN npath ELSE path END AS path FROM c6 WHERE NOT used),
  c8 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx, list_filter(regexp_split_to_array(lag(text) OVER (PARTITION BY page_id ORDER BY pos), '{_B}+'), lambda x: x <> '') AS w FROM c7),
  c9 AS (SELECT page_id, idx, path, CASE WHEN len(w) > 195 THEN '[...] ' || array_to_string(w[-195:], ' ') || {_NLNL} || text ELSE text END AS text FROM c8)
  SELECT coalesce(url_hash, substr(sha256(url), 1, 16)) || '_' || printf('%03d', idx) AS chunk_id, md5({_strip('text')}) AS content, url AS source_url, {_tok('text')} AS token_count, array_to_string(path, ' > ') AS path, contains(text, '```') AS has_code FROM c9 JOIN scraped_page USING (page_id)"""
_LINKS = """p AS (SELECT section, page_id FROM scraped_page WHERE section IS NOT NULL),
      fs AS (SELECT section, min(page_id) AS f FROM p GROUP BY section),
      links AS (SELECT page_id AS src, lead(page_id) OVER (PARTITION BY section ORDER BY page_id) AS dst FROM p UNION ALL SELECT page_id, lead(page_id, 2) OVER (PARTITION BY section ORDER BY page_id) FROM p
        UNION ALL SELECT f, lead(f) OVER (ORDER BY section) FROM fs)"""
_TEXT = lambda c: f"CASE WHEN regexp_matches({c}, '{_NB}') THEN regexp_replace({c}, '{_B}+', ' ', 'g') ELSE '' END"
SQL = {
    "chunk_rows": _CHUNKER,
    "html_to_text": rf"""WITH l AS (SELECT page_id, url, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS no FROM scraped_page WHERE content IS NOT NULL),
      f AS (SELECT *, starts_with(line, '# ') AS h1, CASE WHEN starts_with(line, '# ') THEN {_NLNL} || '# ' || {_strip("substr(line, 3)")} || chr(10) WHEN starts_with(line, '- ') THEN chr(10) || '- ' || {_TEXT("substr(line, 3)")} ELSE {_NLNL} || {_TEXT("line")} END AS t FROM l),
      g AS (SELECT page_id, url, string_agg(t, '' ORDER BY no) AS t, CAST(count(*) FILTER (h1 AND regexp_matches(substr(line, 3), '{_NB}')) AS INT) AS n_headings, min_by({_strip("substr(line, 3)")}, no) FILTER (h1 AND regexp_matches(substr(line, 3), '{_NB}')) AS head FROM f GROUP BY page_id, url),
      c AS (SELECT *, {_strip("regexp_replace(regexp_replace(regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ([.,;:!?)])', '\\1', 'g')")} AS text FROM g)
      SELECT url, coalesce(head, {_TITLE}) AS title, substr(sha256(url), 1, 16) AS url_hash, md5(text) AS content, n_headings FROM c WHERE length(text) >= 50""",
    "token_estimate": f"SELECT 'page' AS kind, page_id AS id, {_TOKENS} AS tokens FROM scraped_page UNION ALL SELECT 'chunk', chunk_row, {_TOKENS} FROM doc_chunk",
    "url_parts": rf"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path, substr(sha256(url), 1, 16) AS hash, {_TITLE} AS slug FROM scraped_page",
    "link_filter": rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM scraped_page),
      c AS (SELECT section, regexp_extract(base_url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_extract(base_url, '^[a-z]+://[^/]+([^?#]*)', 1), '/+$', '') AS base FROM crawl_source)
      SELECT page_id, section FROM p JOIN c ON p.host = c.host AND starts_with(path, base) WHERE NOT ({_BAD})""",
    "tidy_text": r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ([.,;:!?)])', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS text FROM scraped_page WHERE content IS NOT NULL",
    "page_gate": f"SELECT page_id, coalesce(headings[1], {_TITLE}) AS title FROM scraped_page WHERE length({_strip('content')}) >= 50",
    "split_headings": f"WITH {_PARTS} SELECT page_id, pos, heading, md5(body) AS body FROM parts",
    "split_blocks": f"WITH {_BLOCKS} SELECT page_id, pos, block FROM blocks",
    "pack_blocks": f"""WITH RECURSIVE {_BLOCKS}, t AS (SELECT page_id, pos, {_tok('block')} AS tok FROM blocks),
      r AS (SELECT page_id, pos, tok AS cur, 0 AS grp FROM t WHERE pos = 0
        UNION ALL SELECT t.page_id, t.pos, CASE WHEN r.cur > 0 AND r.cur + t.tok > 200 THEN t.tok ELSE r.cur + t.tok END, CASE WHEN r.cur > 0 AND r.cur + t.tok > 200 THEN r.grp + 1 ELSE r.grp END
        FROM r JOIN t ON t.page_id = r.page_id AND t.pos = r.pos + 1)
      SELECT page_id, pos, grp FROM r""",
    "merge_small": f"""WITH {_PARTS}, s AS (SELECT *, {_tok('body')} < 60 AS small, lead(body) OVER (PARTITION BY page_id ORDER BY pos) AS nxt FROM parts),
      i AS (SELECT *, pos - row_number() OVER (PARTITION BY page_id, small ORDER BY pos) AS run FROM s),
      q AS (SELECT *, row_number() OVER (PARTITION BY page_id, small, run ORDER BY pos) AS k FROM i),
      h AS (SELECT *, small AND nxt IS NOT NULL AND k % 2 = 1 AS head FROM q),
      u AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY page_id ORDER BY pos), false) AS used FROM h)
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS pos, md5(CASE WHEN head THEN body || chr(10) || chr(10) || nxt ELSE body END) AS text FROM u WHERE NOT used""",
    "overlap_tails": f"WITH w AS (SELECT chunk_row, list_filter(regexp_split_to_array(content, '{_B}+'), lambda x: x <> '') AS w FROM doc_chunk WHERE content IS NOT NULL) SELECT chunk_row, md5(CASE WHEN len(w) > 52 THEN array_to_string(w[-52:], ' ') ELSE '' END) AS tail FROM w",
    "chunk_stats": "SELECT count(*) AS chunks, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, CAST(floor(coalesce(sum(token_count), 0) / greatest(count(*), 1)) AS BIGINT) AS avg_tokens, count(*) FILTER (coalesce(has_code, false)) AS code_chunks, array_to_string(list_sort(list(DISTINCT section) FILTER (section IS NOT NULL)), ',') AS sections FROM doc_chunk",
    "chunk_metadata": "SELECT chunk_id, source_url, source_title, section, section_label, token_count, array_to_string(heading_hierarchy, ' > ') AS heading_hierarchy, has_code FROM doc_chunk",
    "crawl_bfs": f"""WITH RECURSIVE {_LINKS},
      r AS (SELECT f AS page, 0 AS depth FROM fs UNION SELECT l.dst, r.depth + 1 FROM r JOIN links l ON l.src = r.page WHERE l.dst IS NOT NULL AND r.depth < 12)
      SELECT page, min(depth) AS depth FROM r GROUP BY page""",
    "crawl_sections": f"""WITH RECURSIVE {_LINKS}, m AS (SELECT fs.section, f, coalesce(max_depth, 4) AS md FROM fs LEFT JOIN crawl_source USING (section)),
      r AS (SELECT section, f AS page, 0 AS depth, md FROM m UNION SELECT r.section, l.dst, r.depth + 1, md FROM r JOIN links l ON l.src = r.page WHERE l.dst IS NOT NULL AND r.depth < md),
      b AS (SELECT section, page, min(depth) AS depth FROM r GROUP BY section, page), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY section) AS n FROM b)
      SELECT page, section, depth FROM k WHERE n = 1""",
}
