import ast
import http.server
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from sedimenta.functions.embedders import EMBEDDERS, create_embedder, embed, generate
from sedimenta.operators import configs as G
from sedimenta.operators import evaluation as E
from sedimenta.operators import prompts as P
from sedimenta.operators import retrieval as R
from sedimenta.operators import scripts as X
from sedimenta.operators.crawl import crawl_sections
from sedimenta.sources import files as S

DEPLOY = """version: "1.0"
metadata:
  description: 'Deploy the "shop" of web; rm -rf $HOME'
  risk_level: medium
steps:
  - id: step_01
    action: oneke.namespace.create
    description: Create the namespace shop
    params: {name: shop, labels: {env: production, team: "a b"}}
  - id: step_02
    action: oneke.app.deploy
    description: Deploy the release shop
    timeout_seconds: 600
    params: {chart: store/web, release_name: shop, namespace: shop, repo_url: "https://charts.example", values: {replicas: 2}, wait: true, create_namespace: false}
  - id: step_03
    action: oneke.storage.create_pvc
    description: Create the claim of shop
    params: {name: data, namespace: shop, size: 5Gi}
  - id: step_04
    action: one.vm.resize
    description: Resize the machine of shop
    params: {vm_id: 3}
  - id: step_05
    action: one.vm.delete
    description: Delete the machine of shop
    params: {}
validation:
  pre_checks: [{type: cluster_reachable}, {type: namespace_available, namespace: shop}]
  post_checks: [{type: pods_running, namespace: shop, label_selector: app=shop, expected_count: 2}]
rollback:
  steps:
    - {id: step_91, action: oneke.app.uninstall, description: Take the release away, params: {release_name: shop, namespace: shop}}
"""
ERROR = 'version: "1.0"\nmetadata: {description: "not possible here"}\nsteps: []\nerror: {is_error: true, reason: \'no "TensorFlow"; $(x)\', suggestion: ask}'


def parsed(spark, *texts):
    return G.parse_configs(spark.createDataFrame(list(enumerate(texts)), "row_id int, output string"))


def test_scripts_run_dry(spark, tmp_path):
    rows = {r.row_id: r.script for r in X.scripts(parsed(spark, DEPLOY, ERROR, None, "a: [")).collect()}
    script = rows[0]
    ast.parse(script)
    for part in ("create", "repo", "cluster-info", "def run_pre_checks", "def run_post_checks", "get", "def run_rollback", "uninstall", "--dry-run", "DRY_RUN", "def main()", '"env=production"', '"team=a b"', '"600s"', "PersistentVolumeClaim"):
        assert part in script, part
    assert "--create-namespace" not in script and "\n\n\n" not in script
    (tmp_path / "s.py").write_text(script)
    out = subprocess.run([sys.executable, str(tmp_path / "s.py"), "--dry-run"], capture_output=True, text=True, timeout=60)
    assert out.returncode == 0 and "WOULD RUN helm install shop store/web" in out.stdout and "no command for one.vm.resize" in out.stdout and "vm_id missing" in out.stdout
    (tmp_path / "e.py").write_text(rows[1])
    out = subprocess.run([sys.executable, str(tmp_path / "e.py")], capture_output=True, text=True, timeout=60)
    assert out.returncode == 1 and 'no "TensorFlow"; $(x)' in out.stderr and "Suggestion: ask" in out.stderr
    assert rows[2] is None and rows[3] is None


def test_steps_and_summaries(spark):
    df = parsed(spark, DEPLOY, ERROR)
    steps = [r for r in X.render_steps(df).orderBy("part", "pos").collect() if r.row_id == 0]
    assert [r.part for r in steps] == ["rollback"] + ["step"] * 5 and steps[0].command == 'run(["helm","uninstall","shop","--namespace","shop"])'
    assert steps[2].command.split("\n")[:2] == ['run(["helm","repo","add","store","https://charts.example"])', 'run(["helm","repo","update"])']
    said = {r.row_id: r.summary for r in X.script_summaries(df).collect()}
    assert "5 steps" in said[0] and "kubectl" in said[0] and "helm" in said[0] and said[1].startswith("ERROR: no")
    flags = {r.row_id: (r.needs_vm, r.needs_app, r.needs_cluster) for r in X.requirement_flags(df).collect()}
    assert flags == {0: (True, True, True), 1: (False, False, False)}
    names = df.select("row_id", X.action_summary(F.col("steps")).alias("a")).collect()
    assert names[0].a[0] == "[oneke.namespace.create] Create the namespace shop" and names[1].a == []


def test_yaml_again_and_normalised(spark):
    text = spark.createDataFrame([(1, "a: 1\nb: null\nc: [x, {d: é}]"), (2, "[1]"), (3, None)], "k int, t string")
    got = {r.k: r.y for r in text.select("k", G.as_yaml(F.col("t")).alias("y")).collect()}
    assert got == {1: "a: 1\nc:\n- x\n- d: é\n", 2: None, 3: None}
    rows = [(1, '{"instruction":"i","output":{"b":1,"a":[2]}}'), (2, '{"instruction":"i","output":"text"}'), (3, '{"instruction":"i","output":5}'), (4, '{"output":"x"}'), (5, "no json"), (6, None)]
    got = {r.k: r.output for r in G.normalize_outputs(spark.createDataFrame(rows, "k int, p string"), "k", "p").collect()}
    assert set(got) == {1, 2} and got[2] == "text" and "b: 1" in got[1]
    kept, bad = G.schema_filter(spark.createDataFrame([(1, "ask " * 40, DEPLOY.replace("one.vm.delete", "one.vm.list")), (2, "ask " * 40, "just text"), (3, None, None)], "row_id int, instruction string, output string"))
    assert [r.row_id for r in kept.collect()] == [1] and {r.row_id: (len(r.instruction), r.error) for r in bad.collect()} == {2: (80, "1. not a mapping"), 3: (0, "1. not a mapping")}
    flags = {r.row_id: (r.yaml_ok, r.schema_ok) for r in G.schema_eval(spark.createDataFrame([(1, "just text"), (2, "a: [")], "row_id int, output string")).collect()}
    assert flags == {1: (True, False), 2: (False, False)}


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(P.raw_prompt(lit("ask"), lit(P.FAILED))) == "ask"
    assert one(P.raw_prompt(lit("ask"), lit("docs"))).endswith("docs\n\n---\n\nRequest: ask")
    assert one(P.strip_json_fence(lit("```json\n[1]\n```  "))) == "[1]" and one(P.strip_json_fence(lit("```\n[1]\nx"))) == "[1]\nx" and one(P.strip_json_fence(lit("```"))) == ""
    assert one(P.judge_prompt(lit("i"), lit(None).cast("string"), lit(""))) == "Request:\ni\n\nGenerated configuration:\n"
    assert one(P.result_line(lit(False), lit("x"), lit(1), lit(2), lit(0.5), lit("e"))) == "❌  Failed after 2 attempt(s): e"
    empty = spark.createDataFrame([], "g string, rank int, source string, text string")
    assert P.numbered_context(empty, ["g"]).count() == 0


def test_embedders_and_callbacks(spark):
    with pytest.raises(ValueError):
        create_embedder("nope")
    e = create_embedder("hashing", dimension=32)
    df = spark.createDataFrame([(1, "deploy the app", "s", True), (2, "delete volumes now", "s", False), (3, None, "t", None)], "chunk_id int, content string, section string, has_code boolean")
    store = df.withColumn("embedding", embed(F.col("content"), e)).filter("embedding is not null")
    assert R.retriever(store, e, 1)("the app deploy").first()["chunk_id"] == 1
    assert [r.chunk_id for r in R.retriever(store, e, 2, rescore=lambda q: F.col("chunk_id") * 1.0)("app").collect()] == [2, 1]
    assert R.retriever(store, e, 5, section="s", code_only=True)("app").count() == 1
    assert "hashing" in EMBEDDERS

    def answer(x):
        if x is None:
            raise RuntimeError("no text")
        return x.upper()

    got = {r.chunk_id: (r.generated, r.error) for r in generate(df, answer, "content", attempts=2, pause=0.0).collect()}
    assert got[1] == ("DEPLOY THE APP", None) and got[3] == (None, "no text")
    rates = E.evaluate_model(df, answer, lambda d, k, c: G.schema_eval(d, k, c), "chunk_id", "content").first()
    assert rates["total"] == 3 and rates["schema_rate"] == 0


def test_backends_and_prompts(spark):
    rows = [(1, True, 1, 2.0, 3, 1, 0, 1), (2, False, 3, 1.0, 3, 1, 1, 1), (3, None, 1, None, None, None, None, None)]
    got = {r.k: r.quality for r in E.backend_scores(spark.createDataFrame(rows, "k int, success boolean, attempts int, seconds double, n_steps int, n_rollback int, n_pre int, n_post int"), ["k"]).collect()}
    assert got == {1: 4, 2: 0, 3: 0}
    pair = spark.createDataFrame([(1, 1.0, 2.0)], "k int, a_seconds double, b_seconds double")
    assert E.comparison_table(pair, "k", ["seconds"]).first()["better"] == "a"
    rows = [(1, "c", "d", ["x"], False, "o" * 600, True, ["x", "y"], False, None), (2, None, None, None, True, None, True, None, False, "e" * 300), (3, "c", None, [], False, "o", True, [], False, None)]
    df = spark.createDataFrame(rows, "item_id int, category string, difficulty string, expected_actions array<string>, expect_error boolean, output string, is_valid boolean, actions array<string>, is_error boolean, error string")
    got = {r.item_id: (r.passed, len(r.output), len(r.error)) for r in E.evaluate_prompts(df).collect()}
    assert got == {1: (True, 500, 0), 2: (True, 0, 200), 3: (False, 1, 0)}
    report = E.group_report(E.evaluate_prompts(df), "category").collect()
    assert [(r.category, r.passed, r.total, r.bar) for r in report] == [("c", 1, 2, "█████░░░░░"), ("unknown", 1, 1, "██████████")]


class _Page(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        kind = "text/html; charset=utf-8" if self.path != "/data" else "application/json"
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write("<main>é</main>".encode())

    def log_message(self, *args):
        pass


def test_fetching_pages(spark):
    from sedimenta.sources.web import fetch_pages

    server = http.server.HTTPServer(("127.0.0.1", 0), _Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = dict(fetch_pages(spark, [f"{base}/a", f"{base}/gone", f"{base}/data", "http://127.0.0.1:1/", "nonsense"], delay=0.0, timeout=5, partitions=3).collect())
    server.shutdown()
    assert got == {f"{base}/a": "<main>é</main>", f"{base}/gone": None, f"{base}/data": None, "http://127.0.0.1:1/": None, "nonsense": None}
    assert fetch_pages(spark, []).count() == 0


def test_sinks_and_settings(spark, tmp_path, monkeypatch):
    t = f"{tmp_path}"
    chunks = spark.createDataFrame([("c1", "text é", "u", "t", "s", "S", 3, ["h"], ["b"], True)], S.CHUNK_SCHEMA)
    S.save_chunks(chunks, f"{t}/chunks")
    assert S.load_chunks(spark, f"{t}/chunks/rows").collect() == chunks.collect() and spark.read.json(f"{t}/chunks/stats").first()["chunks"] == 1
    ex = spark.createDataFrame([("i", "o")], "instruction string, output string")
    S.save_split(ex, ex.limit(0), f"{t}/split")
    assert spark.read.json(f"{t}/split/train").count() == 1
    (tmp_path / "x.json").write_text('[{"instruction": "i", "output": "o"}]')
    assert S.load_examples(spark, f"{t}/x.json").collect() == ex.collect()
    runs = spark.createDataFrame([(1, "a", True), (2, "a", False)], "run int, category string, passed boolean")
    S.save_results(runs, f"{t}/results")
    assert {r.category: r.mean_rate for r in spark.read.json(f"{t}/results/stats").collect()} == {"a": 0.5, "(overall)": 0.5}
    df = parsed(spark, DEPLOY)
    S.save_scripts(X.scripts(df), df.withColumn("config", F.lit(DEPLOY)), f"{t}/scripts")
    name = spark.read.parquet(f"{t}/scripts").first()["name"]
    out = S.export_script(spark, f"{t}/scripts", name, f"{t}/out")
    assert open(f"{out}/config.yaml").read() == DEPLOY and (tmp_path / "out" / out.split("/")[-1] / "script.py").stat().st_mode & 0o111
    with pytest.raises(KeyError):
        S.export_script(spark, f"{t}/scripts", "none", f"{t}/out")
    monkeypatch.setenv("SEDIMENTA_TOP_K", "9")
    assert S.Settings.from_env().top_k == 9 and S.Settings().eval_share == 0.1
    with pytest.raises(Exception):
        S.load_pages(spark, f"{t}/nothing").count()


def test_stream_resumes(spark, tmp_path):
    from sedimenta.streaming.ingest import stream_ingest

    src, base, schema = f"{tmp_path}/in", f"{tmp_path}/state", "chunk_row bigint, chunk_id string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).coalesce(1).write.parquet(src)
    assert sorted(map(tuple, stream_ingest(spark, src, schema, base=base).collect())) == [(1, "a"), (2, "b")]
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    assert sorted(map(tuple, stream_ingest(spark, src, schema, base=base).collect())) == [(1, "a"), (2, "b"), (5, "c")]
    assert stream_ingest(spark, src, schema, base=base).count() == 3


def test_sections_side_by_side(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"), ("d", "e"), ("e", None)], "src string, dst string")
    bases = spark.createDataFrame([("a", "one", 1, 2), ("x", "two", 2, None)], "page string, section string, priority int, max_depth int")
    got = {r.page: (r.section, r.depth) for r in crawl_sections(links, bases).collect()}
    assert got == {"a": ("one", 0), "b": ("one", 1), "c": ("one", 2), "x": ("two", 0), "d": ("two", 2), "e": ("two", 3)}
    assert crawl_sections(links, bases.limit(0)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from sedimenta.cli import main

    t = f"{tmp_path}"
    pages = spark.createDataFrame([("https://h.example/a/", "T", "s", "S", "## One\n" + "deploy the app now. " * 30 + "\n## Two\n" + "delete volumes. " * 40, ["x"], ["h"], ["b"], "hash")], S.PAGE_SCHEMA)
    S.save_pages(pages, f"{t}/pages")
    assert main(["pipeline", f"{t}/pages", f"{t}/chunks", f"{t}/store"], spark).first()["ingested"] == 2
    assert main(["ingest", f"{t}/chunks", f"{t}/store"], spark).first()["ingested"] == 0
    assert main(["query", f"{t}/store", "delete volumes", "--top-k", "1"], spark).first()["preview"].find("delete") >= 0
    assert main(["query", f"{t}/store", "deploy", "--context"], spark).first()["context"].startswith("[Source:")
    assert {r.section: r.chunks for r in main(["stats", f"{t}/store"], spark).collect()} == {"s": 2, None: 2}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "good.yaml").write_text(DEPLOY.replace("one.vm.delete", "one.vm.list"))
    (tmp_path / "c" / "bad.yaml").write_text("just text")
    assert {r.name.rsplit("/", 1)[-1]: r.is_valid for r in main(["validate", f"{t}/c"], spark).collect()} == {"good.yaml": True, "bad.yaml": False}
    assert main(["plan", f"{t}/c"], spark).count() == 2 and main(["apply", f"{t}/c", f"{t}/out"], spark).count() == 1
    (tmp_path / "e.jsonl").write_text('{"instruction": "i", "output": "just text"}\n')
    assert main(["eval", f"{t}/e.jsonl"], spark).first()["schema_rate"] == 0
    assert main(["config"], spark).count() == 7 and main(["run", "chunk_stats", "/root/testdata/sf0.001"], spark).count() == 1
    with pytest.raises(SystemExit):
        main(["nothing"], spark)
