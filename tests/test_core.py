import duckdb
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import html as H
from sedimenta.functions import text as T
from sedimenta.operators import chunking as K
from sedimenta.operators import configs as G
from sedimenta.operators import curation as C
from sedimenta.operators import evaluation as E
from sedimenta.operators import retrieval as R
from sedimenta.operators import scripts as X
from sedimenta.operators.crawl import crawl
from sedimenta.sources import files as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings eval_raw generation_stats scraped_page doc_chunk crawl_source gold_seed eval_prompt mix_target".split()


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def core_names():
    from sedimenta.plans import catalogue

    return sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", core_names())
def test_against_sql(spark, name):
    from sedimenta.plans import catalogue

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(catalogue.oracle_sql()[name])
    cols, want = [c[0] for c in cur.description], cur.fetchall()
    df = catalogue.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    at = [cols.index(c) for c in df.columns]

    def plain(v):
        return round(float(v), 5) if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else v

    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_llm():
    import os
    import re

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sedimenta")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"import.*\bllm\b|from.*\bllm\b", open(os.path.join(folder, n)).read()), n


@pytest.mark.parametrize("text, tokens", [("", 0), ("abcd" * 10, 10), ("```" + "a" * 26 + "```", 10), ("```" + "a" * 37, 10), ("x" * 8 + "```a```" + "y" * 5, 5)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, T.token_estimate(F.col("c")), c=text) == tokens == K._tokens(text)


def test_tail_words(spark):
    words = " ".join(map(str, range(100)))
    assert one(spark, T.tail_words(F.col("c"), 10), c=words) == " ".join(map(str, range(87, 100)))
    assert one(spark, T.tail_words(F.col("c"), 100), c=words) == ""


def test_near_key(spark):
    keys = [one(spark, T.near_key(F.col("c")), c=x) for x in ("Deploy the App!", "the app, deploy", "the  APP: Deploy?", "Übung é", "!!!")]
    assert keys[0] == keys[1] == keys[2] == "app deploy the" and keys[3] == "é übung" and keys[4] == ""


def test_length_reasons(spark):
    rows = [(1, "a b", "x" * 50), (2, "a b c", "x" * 19), (3, " ".join("w" * 1 for _ in range(201)), "x" * 50), (4, "a b c", "x" * 10001), (5, "a b c", "x" * 20), (6, "a b", "x")]
    df = spark.createDataFrame(rows, ["row_id", "instruction", "output"])
    got = dict(df.select("row_id", C.length_reason()).collect())
    assert got == {1: "instruction_short", 2: "output_short", 3: "instruction_long", 4: "output_long", 5: None, 6: "instruction_short"}


def test_clean_order_and_nulls(spark):
    rows = [(1, "deploy the app", "y" * 30), (2, "deploy the app", "z" * 30), (3, "The app: deploy", "y" * 30), (4, None, "y" * 30), (5, "x y z", "  "), (6, "one two", "y" * 30)]
    df = spark.createDataFrame(rows, "row_id long, instruction string, output string").withColumn("reason_extra", F.lit(1))
    got = {r.row_id: r.reason for r in C.reject_reasons(df).collect()}
    assert got == {1: None, 2: "exact_duplicate", 3: "near_duplicate", 4: "empty", 5: "empty", 6: "instruction_short"}
    assert C.quality_report(C.reject_reasons(df.limit(0))).first()["total_in"] == 0


def test_split_keeps_the_exact_size(spark):
    df = spark.range(1003).withColumnRenamed("id", "row_id")
    got = dict(C.train_eval_split(df).groupBy("part").count().collect())
    assert got == {"train": 903, "eval": 100}


def test_unknown_template():
    with pytest.raises(ValueError):
        T.chat("nope", None, None)


PAGES = [
    "",
    "plain text without anything",
    "intro\n\n## One\nbody one\n### Deep\nmore\n## Two\n```sh\n## not a heading?\n\nls\n```\nend",
    "## A\n" + "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(40)),
    "## A\n### B\n" + "\n\n".join("text " * 50 for _ in range(30)) + "\n\n```\nopen\n\nfence " + "code " * 900,
    "## A\n\n" + "x" * 9000 + "\n\n## B\nshort\n## C\nshort\n## D\nshort",
]


def test_blocks_and_packing_agree_with_python(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), ["i", "content"])
    got = {r.i: r for r in df.select("i", K.split_blocks(F.col("content")).alias("b"), K.pack_blocks(K.split_blocks(F.col("content")), 300).alias("p"), K.split_headings(F.col("content"), 2).alias("h")).collect()}
    for i, text in enumerate(PAGES):
        assert got[i].b == K._blocks(text)
        assert [tuple(x) for x in got[i].h] == K._by_heading(text, 2)
        packed, room = [], 0
        for b in K._blocks(text):
            n = K._tokens(b)
            if packed and room and room + n > 300:
                packed.append(b)
                room = n
            else:
                packed = packed[:-1] + [packed[-1] + "\n\n" + b] if packed else [b]
                room += n
        assert got[i].p == packed


def test_chunk_pages(spark):
    rows = [(f"u{i}", "T", "s", "S", t, None, ["a"]) for i, t in enumerate(PAGES)] + [("u9", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "url string, title string, section string, section_label string, content string, url_hash string, breadcrumb array<string>")
    got = K.chunk_pages(df).collect()
    assert len({r.chunk_id for r in got}) == len(got)
    assert not [r for r in got if r.source_url in ("u0", "u9")]
    assert all(r.content.startswith("[...] ") for r in got if r.source_url == "u3" and not r.chunk_id.endswith("_000"))
    parts = K.chunk_text("## A\n### B\n" + "b " * 300 + "\n### C\n" + "c " * 300, "T", target=200, overlap=0, small=1)
    assert parts[0][0].startswith("### B\nb b") and parts[1][1] == ["T", "A", "C"] and K.chunk_text("four\n## A\ntext", "T", small=1)[1][0] == "## A\ntext"
    merged = K.merge_small(F.array(*[F.struct(F.lit(x).alias("text"), F.array(F.lit("p")).alias("path")) for x in ("a", "b", "c", "d" * 800, "e")]), 100)
    assert [x["text"] for x in spark.range(1).select(merged.alias("m")).first()["m"]] == ["a\n\nb", "c\n\n" + "d" * 800, "e"]


HTML = """<html><body><nav class="breadcrumb"><a>Home</a></nav><main><nav>skip</nav><h1>Title &amp; more</h1><p>One <b>two</b>, three
<p>unclosed<ul><li>a<li>b</ul><pre>x = 1
  y</pre><script>var t="</p>";</script><table><tr><td>1</td><td>2</td></tr></table></main><div class="footer">foot</div></body></html>"""


def test_html():
    got = H.extract(HTML)
    assert got["headings"] == ["Title & more"] and got["code_blocks"] == ["x = 1\n  y"]
    assert got["content"].startswith("# Title & more") and "skip" not in got["content"] and "var t" not in got["content"] and "foot" not in got["content"]
    assert "One two, three" in got["content"] and "- a\n- b" in got["content"]
    assert H.extract(None)["content"] == "" and H.extract("<p>" * 5000)["content"] == ""
    assert H.clean_url("../b#x", "https://h.example/a/c/") == "https://h.example/a/b/"
    linked = '<a href="/d/x"></a><a href="/d/y.yaml"></a><a href="https://o.example/d/z"></a><a href="/e/"></a>'
    assert H.page_links(linked, "https://h.example/d/", "https://h.example/d") == ["https://h.example/d/x/"]
    assert H.extract("<main><h5>Five</h5><div>a</div><dl><dt>k</dt><dd>v</dd></dl><p>run <code>x y</code> now</p></main>")["content"] == "Five\na\n\n**k**: v\n\nrun `x y` now"
    assert H.extract('<ol class="breadcrumb"><li>Home</li><li> Guide </li></ol><div class="td-max-width-on-larger-screens td-page-meta">m</div><main>t</main>')["breadcrumb"] == ["Home", "Guide"]
    assert H.page_links('<a href="#a"></a><a href="x.html?q=1"></a><a href="mailto:b"></a>', "https://h.example/d/") == ["https://h.example/d/x.html?q=1"]


def test_scraped_pages(spark):
    df = spark.createDataFrame([("https://h.example/my_page/", HTML), ("https://h.example/other-page", "<p>" + "t " * 60), ("e", None)], ["url", "html"])
    got = {r.url: r.title for r in H.scraped_pages(H.extract_pages(df)).collect()}
    assert got == {"https://h.example/my_page/": "Title & more", "https://h.example/other-page": "Other Page"}


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a"), ("d", None)], ["src", "dst"])
    roots = spark.createDataFrame([("a",)], ["page"])
    assert dict(crawl(links, roots, 2).collect()) == {"a": 0, "b": 1, "c": 2}
    assert crawl(links, roots, 9, max_pages=2).count() == 2


CONFIG = """version: "1.0"
metadata:
  description: "a long description"
  risk_level: low
steps:
  - id: step_01
    action: oneke.namespace.delete
    description: "delete the namespace"
    params: {name: web}
  - id: step_02
    action: oneke.service.expose
    description: "expose the service"
    params: {namespace: a, deployment_name: b, port: 70000}
    depends_on: [step_01]
"""


def test_validation(spark):
    cyc = CONFIG.replace("params: {name: web}", "params: {name: web}\n    depends_on: [step_02]")
    rows = [
        (1, CONFIG.replace("70000", "80")), (2, CONFIG), (3, "a: [1"), (4, "just text"), (5, None), (6, cyc), (7, 'version: "1.0"\nmetadata: {description: "not possible here"}\nsteps: []\nerror: {is_error: true, reason: no}'),
        (8, "when: 2024-99-99"), (9, "```yaml\n" + CONFIG.replace("70000", "80") + "\n```"), (10, CONFIG.replace("oneke.namespace.delete", "no.such")), (11, CONFIG.replace("[step_01]", "[step_02]")),
    ]
    got = {r.row_id: r for r in G.validate(spark.createDataFrame(rows, "row_id int, output string")).collect()}
    assert [k for k, r in sorted(got.items()) if r.is_valid] == [1, 7, 9]
    assert got[2].errors == ["step_02 port range"] and got[6].errors == ["cycle"] and got[3].errors == got[8].errors == ["unparsable"] and got[10].errors == ["unknown action"]
    assert "self dependency" in got[11].errors and set(got[1].warnings) == {"no rollback", "no pre-checks", "destructive at low risk"}


def test_extract_and_patch(spark):
    raw = "Sure!\n```yaml\nversion: 1\nsteps: []\n---\nmore\n```\nbye"
    assert one(spark, G.extract_yaml(F.col("c")), c=raw) == "version: 1\nsteps: []"
    assert one(spark, G.extract_yaml(F.col("c")), c="note\nmetadata:\n  a: 1") == "metadata:\n  a: 1"
    fixed = G.load(G.patch_yaml("metadata: x\nsteps:\n- action: go\n  params: {name: n}", "ask"))[1]
    assert fixed["metadata"] == {"description": "x"} and fixed["steps"][0]["description"] == "go n"
    assert G.patch_yaml("a: [", "ask") == "a: [" and G.patch_yaml(None, None) is None


def test_render(spark):
    df = G.parse_configs(spark.createDataFrame([(1, CONFIG), (2, None)], "row_id int, output string"))
    got = [r.command for r in X.render_steps(df).orderBy("pos").collect()]
    assert got == ['run(["kubectl","delete","namespace","web","--ignore-not-found"])', 'run(["kubectl","expose","deployment","b","--port=70000","--type=ClusterIP","-n","a"])']
    assert X.scripts(df).count() == 2


def test_retrieval(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in R.top_k(df, [2.0, 0.0], 2).collect()] == [1, 2]
    near = R.knn(df, df.filter("vec_id = 1"), 2).collect()
    assert [(r.vec_id, r.rank) for r in sorted(near, key=lambda r: r.rank)] == [(2, 1), (3, 2)]
    chunks = spark.createDataFrame([(1, "a" * 40, "u", ["h"]), (2, "b" * 400, "u", None), (3, "c" * 4, "u", [])], "rank int, content string, source_url string, heading_hierarchy array<string>")
    assert R.context(chunks, 50).first()["context"] == "[Source: u] [h]\n" + "a" * 40
    assert R.context(chunks, 5).first()["context"] == ""
    assert R.context(chunks.limit(0), 5).first()["context"].startswith("No relevant")


def test_evaluation(spark):
    duel = lambda a, b: one(spark, E.head_to_head(F.lit("x"), F.lit(a[0]), F.lit(a[1]), F.lit("y"), F.lit(b[0]), F.lit(b[1])), c=1)
    assert [duel((3, 1), (2, 0)), duel((2, 1), (2, 0)), duel((2, 1), (2, 1))] == ["x", "y (faster)", "tie"]
    rows = spark.createDataFrame([(1, '{"a": {"score": 4, "reasoning": "ok"}}'), (2, "broken"), (3, None)], "k int, j string")
    got = E.judge_rows(rows, "k", "j", ["a", "b"]).collect()
    assert len(got) == 6 and {(r.k, r.dimension): r.score for r in got}[1, "a"] == 4
    assert E.compliance(spark.createDataFrame([], "yaml_ok boolean, schema_ok boolean")).first()["total"] == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("u", "t", "s", "S", "c", ["x"], ["h"], ["b"], "hash")], S.PAGE_SCHEMA)
    S.save_pages(df, f"{tmp_path}/p")
    assert S.load_pages(spark, f"{tmp_path}/p").count() == 1
    with pytest.raises(ValueError):
        S.load_examples(spark, "x.csv")
    table = S.VectorTable(spark, f"{tmp_path}/v", "chunk_id string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "2")], table.schema)
    assert table.ingest(new) == 2 and table.ingest(new) == 0 and table.rows().count() == 2
    table.clear()
    assert table.rows().count() == 0
    got = S.unwrap_payload(spark.createDataFrame([(1, '{"items": [{"instruction": "i", "output": "o"}]}'), (2, '[{"instruction": "j", "output": "p"}]'), (3, "no")], "k int, p string"), "k", "p")
    assert sorted(r.instruction for r in got.collect()) == ["i", "j"]


def test_streaming(spark):
    from sedimenta.streaming.ingest import stream_ingest

    got = stream_ingest(spark, f"{SF}/doc_chunk.parquet", "chunk_row bigint, chunk_id string, content string")
    assert got.count() == got.select("chunk_id").distinct().count() > 0
