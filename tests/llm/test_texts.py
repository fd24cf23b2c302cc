import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import defects as D
from sedimenta.llm import mixing as M
from sedimenta.llm import page_frame as P
from sedimenta.llm import repeated_lines as R
from sedimenta.llm import splitting as S
from sedimenta.llm.leakage import leaked_items

SF = "/root/testdata/sf0.001"


# ---- 2: defective pairs

CONFIG = 'version: "1.0"\nmetadata:\n  description: "Delete the namespace for the users of web"\nsteps:\n  - id: step_01\n    action: oneke.namespace.delete\n    description: "Delete the namespace before the review and keep the quota"\n    params:\n      name: web'
ASK = "Please delete the namespace web before the review of the platform team and keep the quota."
CASES = [
    (CONFIG, None), ("```yaml\n" + CONFIG + "\n```", None), (None, "empty"), ("  \n", "empty"), ("TODO", "empty"), ("```yaml\n```", "empty"), ("{}", "empty"), ("—", "empty"),
    (ASK, "copied"), (ASK.upper() + "\n" + ASK, "copied"), ("> " + ASK.replace(" ", "  "), "copied"), ("Request: " + ASK, "copied"), ("```\n# " + ASK + "\n```", "copied"),
    ("I'm sorry, but I can't help with that. Is there anything else?", "refusal"), ("Leider darf ich diese Anfrage nicht beantworten.", "refusal"), ("# Lo siento, pero no voy a hacer esto.", "refusal"),
    ("```yaml\n" + CONFIG, "truncated"), (CONFIG[: CONFIG.rindex("params")], "truncated"), (CONFIG + "\n  - id", "truncated"), (CONFIG.replace("name: web", "name:"), "truncated"), (CONFIG[:-60], "truncated"),
    ("The team moved the volumes before the review. Each night the scheduler counts", "truncated"), ("The team moved the volumes before the review.", None),
    ("Der Dienst meldet nach drei Minuten, dass die Regeln bei hoher Last nicht erreichbar sind und bleiben.", "wrong_language"),
    (CONFIG.replace("Delete the namespace before the review and keep the quota", "Den Namensraum löschen, damit die Nutzer der Anwendung nicht warten und die Regeln bleiben").replace("Delete the namespace for the users of web", "Den Namensraum für die Nutzer löschen"), "wrong_language"),
    ('version: "1.0"\nmetadata:\n  description: "not possible in this cluster"\nsteps: []\nerror:\n  is_error: true\n  reason: "the namespace is outside the clusters"\n  suggestion: "ask the owners of the cluster"', None),
]


def test_defects(spark):
    rows = [(i, ASK, o) for i, (o, _) in enumerate(CASES)] + [(100 + i, f"{ASK} case {i}", CONFIG.replace("web", f"w{i}")) for i in range(200)] + [(400, None, CONFIG), (401, None, None), (402, "", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "row_id bigint, instruction string, output string").withColumns({"empty": F.lit("clash"), "action": F.lit(1)})
    got = {r.row_id: r.defect for r in D.single_defects(D.defect_posteriors(df)).collect()}
    want = {i: d for i, (_, d) in enumerate(CASES) if d} | {401: "empty"}
    assert {k: v for k, v in got.items() if k < 402} == want
    assert D.single_defects(D.defect_posteriors(df.limit(0))).count() == 0
    labels = D.defect_labels(D.defect_posteriors(df)).collect()
    assert all(len(r.defects) >= 1 for r in labels)


def test_defects_of_long_texts(spark):
    prose = "The team moved the volumes of the cluster before the review and keeps the quota for the users. " * 6
    cases = [
        ("I'm sorry, but I cannot help with this request. " + prose + "I hope you understand. Is there anything else?", "refusal"),
        ("\n".join([ASK] * 40), "copied"),
        (f"{ASK} {ASK} " * 14, "copied"),
        (prose + "Other teams are not allowed to move them. " + prose.strip(), None),
    ]
    assert len(cases[0][0].split()) > 60 and len(cases[1][0].split()) > 400 and len(cases[2][0].split()) > 400
    rows = [(i, ASK, o) for i, (o, _) in enumerate(cases)] + [(100 + i, ASK, o) for i, (o, _) in enumerate(CASES)] + [(200 + i, f"{ASK} case {i}", CONFIG.replace("web", f"w{i}")) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id bigint, instruction string, output string")
    got = {r.row_id: r.defect for r in D.single_defects(D.defect_posteriors(df)).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {i: d for i, (_, d) in enumerate(cases) if d}


def test_label_model_finds_accuracies():
    import numpy as np

    rnd = random.Random(1)
    truth = [rnd.random() < 0.05 for _ in range(20_000)]
    pats = [D.pattern([(1 if t else 0) if rnd.random() < 0.93 else rnd.choice([0, 2]) for _ in range(4)]) for t in truth]
    codes, back = np.unique(pats, return_inverse=True)
    q = D.LabelModel(4).fit(codes, np.bincount(back).astype(float)).posterior(codes)[back]
    assert np.mean((q > 0.5) == np.array(truth)) > 0.995


def test_label_model_is_more_than_any_vote(spark):
    """On real rows a single yes is often overruled, and some rows keep several labels."""
    rows = spark.read.parquet("/root/testdata/sf0.01/eval_raw.parquet")
    voted = D.cast_votes(rows).collect()
    got = {r.row_id: set(r.defects) for r in D.defect_labels(D.defect_posteriors(rows)).collect()}
    overruled = 0
    for r in voted:
        for d in D.DEFECTS:
            code, yes = r[f"v_{d}"], False
            while code:
                yes, code = yes or code % 3 == D.YES, code // 3
            overruled += yes and d not in got.get(r.row_id, ())
    assert overruled > 20 and sum(len(x) > 1 for x in got.values()) > 1


def test_votes_do_not_look_at_each_other():
    cut_refusal = "Lo siento, pero no voy a hacer esto y"
    v = dict(zip(D.DEFECTS, D.votes(ASK, cut_refusal)[0]))
    assert D.YES in v["refusal"] and D.YES in v["wrong_language"] + v["truncated"]


def test_cutoffs_are_validated(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/eval_raw.parquet")
    cut, measured = D.validated_cutoffs(rows, sample=300)
    assert set(cut) == set(D.DEFECTS) and all(0 < c < 1 for c in cut.values())
    for d, (recall, wrong) in ((d, measured[d]) for d in D.DEFECTS):
        assert wrong <= 0.02 and recall >= (0.7 if d == "truncated" else 0.95), (d, recall, wrong)


# ---- 3: page frames

def page(i, body, mid=""):
    menu = "* Home\n* Pricing\n* Support portal"
    return f"{menu}\nSite > Guide > Page {i}\n# Page {i}\n\n{body}\n{mid}\n\n## Part of {i}\n\n```\nrun {i}\n```\nNote: keep a backup of the cookies table.\n\nOn this page\n• Part of {i}\nSee also\nPage {i + 7}\n← Page {i - 1}\nCopyright 202{i % 5} Site Ltd.\nLast updated on {1 + i % 9} May 2024 by the docs team"


def test_page_frames(spark):
    rows = [(i, f"https://a.example/g/{i}/", f"Page {i}", ["Site", "Guide", f"Page {i}"] if i % 3 else None, page(i, f"Body of {i} is long enough to be a real text about volumes and hosts.", "Print this page / Save as PDF" if i % 2 else "")) for i in range(60)]
    rows += [(60, None, None, None, None), (61, None, None, None, ""), (62, "https://b.example/", "t", [], "# only\n\n```\nopen fence\n\nthe rest is text here.")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, title string, breadcrumb array<string>, content string").withColumns({"host": F.lit("clash"), "line_no": F.lit(1)})
    got = {}
    for r in P.frame_of_pages(df).collect():
        got.setdefault(r.page_id, {})[r.line_no] = r.frame
    for i in range(60):
        lines = rows[i][4].split("\n")
        kept = [lines[k] for k in sorted(got[i]) if not got[i][k]]
        assert kept == [f"# Page {i}", f"Body of {i} is long enough to be a real text about volumes and hosts.", f"## Part of {i}", "```", f"run {i}", "```", "Note: keep a backup of the cookies table."], i
    assert 60 not in got and 61 not in got and not any(got[62].values())
    joined = {(r.page_id, r.line_no, r.frame) for r in P.frame_of_pages(df, most_nodes=0).collect()}
    assert joined == {(p, n, f) for p, x in got.items() for n, f in x.items()}
    bodies = {r.page_id: r.body for r in P.main_bodies(df).collect()}
    assert len(bodies) == 63 and bodies[60] is None and "Pricing" not in bodies[3]
    assert P.frame_of_pages(df.limit(0)).count() == 0


def test_template_is_a_share_of_the_host_by_kind_and_place(spark):
    ids = spark.range(1000).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(16)))  # 16 buckets of a host of 1,000 pages
    few = {r.id for r in ids.filter("b = 0").orderBy("id").limit(4).collect()}  # neighbours, which align one another
    texts = [f"* Home\n* Guides\n# Page {i}\n\nBody of {i} about volumes and hosts.\n\n" + ("- paujeitre config loader" if i in few else "- Guides" if i == 999 else "") for i in range(1000)]
    df = spark.createDataFrame([(i, f"https://a.example/{i}", f"Page {i}", None, t) for i, t in enumerate(texts)], "page_id bigint, url string, title string, breadcrumb array<string>, content string")
    got = {(r.page_id, r.line_no) for r in P.frame_of_pages(df).filter("frame").collect()}
    assert got == {(i, n) for i in range(1000) for n in (0, 1)}


def test_cues_need_a_place_in_the_template(spark):
    odd = {7: "The privacy policy of volumes is set here", 8: "Advertisement", 9: "Next: the hosts of the pool"}
    texts = [f"# Page {i}\n\n{odd.get(i, f'Body of {i} about volumes')}\n\n```\nrun\n```\nBuild AB-{i}, served by host{chr(97 + i % 26)}{chr(97 + i // 26)}\nLegal notice" for i in range(260)]
    df = spark.createDataFrame([(i, f"https://a.example/{i}", f"Page {i}", None, t) for i, t in enumerate(texts)], "page_id bigint, url string, title string, breadcrumb array<string>, content string")
    got = {(r.page_id, r.line_no) for r in P.frame_of_pages(df).filter("frame").collect()}
    assert got == {(i, n) for i in range(260) for n in (7, 8)}


def test_slots_of_first_words(spark):
    """Lines of the site whose first words all pages share are frame without any word of page furniture."""
    texts = [f"# Page {i}\n\nBody of {chr(97 + i % 26)}{chr(97 + i // 26)} about volumes of the site\nSite fact of the day: {chr(97 + i % 26)}{chr(97 + i // 26)} rests" for i in range(260)]
    df = spark.createDataFrame([(i, f"https://a.example/{i}", f"Page {i}", ["Site", "x"], t) for i, t in enumerate(texts)], "page_id bigint, url string, title string, breadcrumb array<string>, content string")
    assert {(r.page_id, r.line_no) for r in P.frame_of_pages(df).filter("frame").collect()} == {(i, 3) for i in range(260)}


def test_tree_matching_keeps_order():
    x, y = P.Tree("a line one\nb line two\n\n- c\n- d"), P.Tree("b line two\n\n- c\n- e")
    assert P.align(x, y) == {"b line two", "c"}


# ---- 4: repeated lines

def test_repeated_lines(spark):
    rnd = random.Random(3)
    pool = [f"Some shared line number {chr(97 + k)} here" for k in range(12)]
    rows = []
    for i in range(120):
        own = [f"unique {i} {chr(97 + j)}{rnd.random()}" for j in range(4)]
        lines = own + [rnd.choice(pool).replace(" ", rnd.choice([" ", "  ", " ", "\t"])) for _ in range(3)] + ["Updated 2024-0%d-11 by us" % (i % 9), "short", ""]
        rnd.shuffle(lines)
        rows.append((i, None if i % 29 == 0 else "\n".join(lines), ["a", "b", "c", None][i % 4] if i > 8 else "tiny"))
    df = spark.createDataFrame(rows, "page_id bigint, content string, section string").withColumns({"item": F.lit("clash"), "n": F.lit(0)})
    key = lambda x: re.sub("[0-9]+", "0", re.sub("[ \t ]+", " ", x).strip().lower())
    size, holders = {}, {}
    for i, c, s in rows:
        if s is not None:
            size[s] = size.get(s, 0) + 1
            for x in set(map(key, (c or "").split("\n"))):
                holders.setdefault((s, x), set()).add(i)
    want = {(i, n) for i, c, s in rows if s is not None and c is not None for n, x in enumerate(c.split("\n")) if len(key(x)) >= 12 and len(holders[s, key(x)]) >= max(3, 0.05 * size[s])}
    assert {tuple(r) for r in R.repeated_line_places(df).collect()} == want
    clean = {r.page_id: r for r in R.without_repeated_lines(df).collect()}
    assert len(clean) == 120 and clean[0].content is None
    assert all(clean[i].lines_removed == sum(p == i for p, _ in want) for i in clean)
    patterns = R.frequent_sequences(df)[0]
    assert patterns.filter("length = 1").count() == len({(s, x) for (s, x), v in holders.items() if len(x) >= 12 and len(v) >= max(3, 0.05 * size[s])})
    assert R.repeated_line_places(df.limit(0)).count() == 0


def test_longer_sequences(spark):
    df = spark.createDataFrame([(i, f"first common line\nsecond common line\nown words {chr(97 + i)}{chr(97 + i)}\nthird common line", "s") for i in range(6)], "page_id bigint, content string, section string")
    got = {r.length: r.pages for r in R.frequent_sequences(df)[0].filter("length > 1").collect()}
    assert got == {2: 6, 3: 6}


def test_sequences_of_any_length_and_gap(spark):
    from collections import Counter
    from itertools import combinations

    rnd = random.Random(4)
    names = [f"common line {chr(97 + k) * 3}" for k in range(8)]
    texts = [[x for x in names if rnd.random() < 0.8] + rnd.sample(names, 2) for _ in range(12)]
    df = spark.createDataFrame([(i, "\n".join(t), "s") for i, t in enumerate(texts)], "page_id bigint, content string, section string")
    holders = Counter(s for t in texts for s in {c for n in range(1, len(t) + 1) for c in combinations(t, n)})
    want = Counter((len(s), v) for s, v in holders.items() if v >= 3)
    patterns, found = R.frequent_sequences(df)
    got = patterns.collect()
    assert Counter((r.length, r.pages) for r in got) == want and max(n for n, _ in want) > 5
    pairs = {a + b: v for (a, b), v in ((s, v) for s, v in holders.items() if len(s) == 2) if v >= 3}
    assert len(pairs) > 7 * 8 / 2
    ends = found.filter("length > 1").groupBy("pattern", "length").count().collect()
    assert {(r.pattern, r["count"]) for r in ends} == {(r.pattern, r.pages) for r in got if r.length > 1}



# ---- 6: splitting

@pytest.mark.parametrize("text", ["a" * 20000, "```" + "x y " * 5000, ("abc " * 3000) + "```\n" + "z" * 9000 + "\n```", "w. " * 4000, "\n" * 20000, "```a``` " * 2000, "雲端。" * 4000, "# h\n" + "\n\n".join(f"## part {i}\n" + "some words here. " * 40 for i in range(30)), "\r\n".join("line of text" for _ in range(900))])
def test_pieces(text):
    pieces = S.split_text(text)
    assert "".join(text[b:c] for _, b, c, _ in pieces) == text
    assert all(S.token_estimate(text[a:c]) <= 1000 and S.token_estimate(text[a:b]) <= 150 for a, b, c, _ in pieces)
    assert all(a < b for a, b, _, _ in pieces[1:]) and len(pieces) > 1


def test_long_texts_are_cut_in_linear_time():
    import time

    took = []
    for k in (1, 4):
        text = "\n".join(f"line {i} of the log tells about volume {i % 97} and host {i % 31}." for i in range(8000 * k))
        began = time.perf_counter()
        S.split_text(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_cuts_at_headings_and_valleys():
    text = "\n\n".join(f"## part {i}\n\n" + f"topic{i} words{i} about{i} things{i}. " * 60 for i in range(6))
    assert all(text[c : c + 2] == "##" for _, _, c, _ in S.split_text(text)[:-1])
    one = "volumes hosts pools disks. " * 80 + "tokens users roles rights. " * 80
    assert text and abs(S.split_text(one, 800)[0][2] - one.index("tokens")) < 3


def test_split_oversized(spark):
    rows = [("page", 1, "short"), ("page", 2, None), ("page", None, "x" * 9000), ("chunk", 3, "word " * 2000), ("chunk", 3, "word " * 2000), ("page", 4, "x" * 4003), ("page", 5, "x" * 4004), ("page", 6, "```" + "x" * 3200 + "```")]
    df = spark.createDataFrame(rows, "kind string, item_id bigint, content string").withColumn("tokens", F.lit("clash"))
    got = S.split_oversized(df)
    assert {(r.kind, r.item_id) for r in got.collect()} == {("chunk", 3), ("page", 5), ("page", 6)}
    assert got.filter("tokens > 1000").count() == 0 and S.split_oversized(df.limit(0)).count() == 0


# ---- 8: leakage

def test_leakage(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(50)] + ["Straße", "İstanbul", "x²"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 9, 10, 25])))) for i in range(30)] + [(30, None), (31, items_text := "one two three four five six seven eight nine ten")]
    docs = []
    for i in range(80):
        w = [rnd.choice(words) for _ in range(30)]
        p = rnd.choice(items)[1] or ""
        cut = p.split()[rnd.randint(0, 4) : rnd.randint(8, 30)]
        docs.append((i, rnd.choice([" ", "; ", "\n"]).join(w[:10] + cut + w[10:]).upper() if i % 3 else " ".join(w[:5] + cut)))
    docs += [(80, ""), (81, None), (82, items_text), (83, "xone two three four five six seven eight nine ten"), (None, items_text)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda t: {tuple(tok(t)[k : k + 10]) for k in range(len(tok(t)) - 9)}
    want = {(d, i) for d, t in docs if d is not None for i, p in items if runs(t) & runs(p)}
    found = leaked_items(df, spark.createDataFrame(items, "item_id bigint, prompt string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    texts = dict(docs)
    for r in found:
        assert len(tok(texts[r.doc_id][r.start_char : r.end_char])) == r.words >= 10
    assert leaked_items(df.limit(0), spark.createDataFrame(items, "item_id bigint, prompt string")).count() == 0
    assert leaked_items(df, spark.createDataFrame([], "item_id bigint, prompt string")).count() == 0


# ---- 9: mixing

def test_plan_and_temperature():
    tokens, target, limits = {"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 5}
    budget, w, power = M.plan_mix(tokens, target, limits)
    assert power == 1.0 and w["b"] == pytest.approx(4 / 9) and budget == pytest.approx(300 / (4 / 9))
    budget, w, power = M.plan_mix(tokens, target, limits, budget=1200)
    assert 0 < power < 1 and 1200 * w["b"] <= 300 + 1e-6 and 1200 * w["a"] <= 1000 + 1e-6
    _, flat, power = M.plan_mix({"a": 900, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 9, "b": 9}, entropy=0.6)
    assert flat["a"] < 0.9 and 0 < power < 1
    assert M.plan_mix({}, {}, {}) == (0.0, {}, 1.0)
    with pytest.raises(FileNotFoundError):
        M.token_counts(None, "/nowhere/vocabulary")


def test_more_sources_than_once_were_allowed(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'one two three' AS text", "concat('s', id * 100000) AS source")
    goal = spark.range(200_001).selectExpr("concat('S', id) AS source", "1.0D / 200001 AS target_share", "2 AS max_repeats")
    mixture, report = M.mix_sources(docs, goal, budget_share=1.0)
    assert mixture.count() == 3 and report.filter("reached_tokens > 0").count() == 3 and report.count() == 200_001


def test_mixture(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["volume", "host", "pool"]) for _ in range(rnd.randint(0, 60))), rnd.choice([" Big", "big", "BIG ", "small", None, "other"]) if i else "small") for i in range(900)] + [(900, None, "big"), (901, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"tokens": F.lit("clash"), "copies": F.lit(1), "block": F.lit(2)})
    goal = spark.createDataFrame([("Big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture, report = M.mix_sources(docs, goal)
    got = {r.source: r for r in report.collect()}
    assert len(got) == 3 and got["absent"].reached_share == 0
    assert got["big"].reached_share == pytest.approx(0.6 / 0.9, abs=0.01) and got["small"].reached_share == pytest.approx(0.3 / 0.9, abs=0.01)
    assert all(r.repeats <= r.max_repeats + 1e-9 for r in got.values())
    assert mixture.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert mixture.filter("source not in ('big', 'small')").count() == 0
    empty, report = M.mix_sources(docs.limit(0), goal)
    assert empty.count() == 0 and report.count() == 3


# ---- queries

def test_queries_have_the_columns_asked_for(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    cols = {"p1_found": ["row_id_a", "row_id_b"], "p2_found": ["row_id", "defect"], "p3_found": ["page_id", "line_no"], "p4_found": ["page_id", "line_no"], "p6_found": ["kind", "item_id"], "p7_found": ["batch_id", "row_id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id_a", "doc_id_b"]}
    for name, want in cols.items():
        assert q[name](spark, SF).columns == want, name


def test_llm_sql(spark):
    from sedimenta.llm import queries as Q

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "eval_raw", "generation_stats", "scraped_page", "doc_chunk", "eval_prompt", "mix_target"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in Q.oracle_sql().items():
        cur = con.execute(sql)
        cols, want = [c[0] for c in cur.description], cur.fetchall()
        df = Q.queries()[name](spark, SF)
        at = [cols.index(c) for c in df.columns]
        assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want), name
