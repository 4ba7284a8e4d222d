"""Expressions, readers, merge and streaming on literal tables; catalog queries against SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry import catalog_signals
from quarry.functions import dictionaries as rules
from quarry.functions import text
from quarry.operators import completion, extract, gate, notes, profile, sessions, signals, state, views
from quarry.sources import readers
from quarry.streaming import stream

SF = "/root/testdata/sf0.001"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize(("value", "n", "expected"), [("short", 20, "short"), ("One sentence here. And more", 20, "One sentence here."), ("ends at the mark here. and then", 21, "ends at the mark here."), ("a b c d e f g h i j，k l m", 22, "a b c d e f g h i j，"), ("no marks but spaces in this one", 20, "no marks but spaces"), ("x" * 30, 10, "x" * 9 + "…")])
def test_clamp(spark, value, n, expected):
    assert one(spark, lambda s: text.clamp(s, n), value) == expected


def test_ascii_boundary(spark):
    assert one(spark, lambda s: s.rlike(text.word("fix")), "请fix这个") is True
    assert one(spark, lambda s: s.rlike(text.word("fix")), "prefix") is False


def test_neighbours_agree_and_exclude_the_edge(spark):
    day = sessions.DAY_MS
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, day - 1), (1, 3, 2 * day - 1), (2, 4, 0)], "project int, session int, ts_ms long")
    got = {r["session"]: r["near"] for r in sessions.neighbours(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0} or got == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {r["session"]: r["near"] for r in sessions.neighbours_by_join(rows).collect()} == got


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5)], "k string, v int")
    assert {r["k"]: r["median"] for r in sessions.upper_median_by(rows, "k", "v").collect()} == {"a": 3, "b": 5}


def test_session_logs(spark, tmp_path):
    folder = tmp_path / "-home-me-my-app"
    folder.mkdir()
    lines = [
        {"type": "user", "content": "hello " * 20, "timestamp": "2024-01-01T00:00:00Z"}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}, {"type": "user", "content": [{"type": "text", "text": "ignored"}]},
        {"type": "assistant", "content": [{"type": "text", "text": "top"}, {"type": "tool"}]}, {"type": "session_end", "durationMs": 5000, "timestamp": "2024-01-01T02:00:00Z"},
    ]
    (folder / "s1.jsonl").write_text("\n".join([json.dumps(lines[0]), "", "{broken", "17", *map(json.dumps, lines[1:])]))
    (folder / "s2.jsonl").write_text("\n".join(map(json.dumps, [{"type": "user", "content": "x", "timestamp": "2024-01-01T00:00:00Z"}, {"type": "summary", "content": "Sum"}, {"type": "assistant", "content": "y", "timestamp": "2024-01-01T00:00:09Z"}])))
    (folder / "s3.jsonl").write_text(json.dumps({"type": "user", "content": "no time"}))
    (folder / "sessions-index.json").write_text('[{"id": "s3", "summary": "Indexed"}, {"id": "s1"}]')
    got = readers.read_session_logs(spark, str(tmp_path)).where("session_id = 's1'").orderBy("idx").collect()
    assert [(r["idx"], r["role"], r["content"]) for r in got] == [(0, "user", "hello " * 20), (1, "assistant", "a\nb"), (2, "assistant", "top")]
    assert readers.read_session_logs(spark, str(tmp_path / "none")).count() == 0 and readers.summarise_logs(spark, str(tmp_path / "none")).count() == 0
    found = {r["session_id"]: r for r in readers.summarise_logs(spark, str(tmp_path)).collect()}
    start = 1704067200000
    assert (found["s1"]["title"], found["s1"]["last_ms"], found["s1"]["messages"]) == (("hello " * 20)[:80] + "...", start + 5000, 4)
    assert (found["s2"]["title"], found["s2"]["last_ms"]) == ("Sum", start + 9000) and found["s3"]["title"] == "Indexed" and found["s3"]["last_ms"] is None
    assert {r["project_path"] for r in found.values()} == {"/home/me/my/app"} and found["s1"]["project"] == "app"
    assert readers.projects_of(readers.summarise_logs(spark, str(tmp_path))).first()["sessions"] == 3
    assert {r["session_id"]: (r["lines"], r["corrupt"]) for r in readers.corrupt_lines(readers.read_lines(spark, str(tmp_path))).collect()} == {"s1": (7, 2), "s2": (3, 0), "s3": (1, 0)}


def test_notes_and_todos(spark, tmp_path):
    (tmp_path / "a.md").write_text("\ufeff---\ntype: user\ntitle: Hi\npaths:\n  - src/a\n  - src/b\ncreated: 2024-02-03\n---\nbody here")
    (tmp_path / "b.md").write_text("no front")
    (tmp_path / "MEMORY.md").write_text("index")
    (tmp_path / "c.md").write_text(" \n")
    note = {r["path"][-4:]: r for r in readers.read_notes(spark, str(tmp_path)).collect()}
    assert set(note) == {"a.md", "b.md"} and note["b.md"]["has_front"] is False
    assert (note["a.md"]["memory_type"], note["a.md"]["body"], note["a.md"]["paths"], note["a.md"]["date"]) == ("user", "body here", ["src/a", "src/b"], "2024-02-03")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.json").write_text('{"todos": [{"content": "do", "status": "in_progress"}, {"content": "later"}, {"content": "done", "status": "completed"}, {"status": "pending"}]}')
    (tmp_path / "t/y.json").write_text('[{"content": "listed"}]')
    known = spark.createDataFrame([("x", 5)], "session_id string, first_ms long")
    got = {(r["session_id"], r["content"]): r for r in readers.read_todos(spark, str(tmp_path / "t"), known).collect()}
    assert {k: r["status"] for k, r in got.items()} == {("x", "do"): "in_progress", ("x", "later"): "pending", ("y", "listed"): "pending"}
    assert got["x", "do"]["ts_ms"] == 5 < got["y", "listed"]["ts_ms"]


def test_config(spark, tmp_path):
    assert readers.read_config(spark, str(tmp_path)) == readers.Config()
    (tmp_path / "config.yml").write_text("source_labels:\n  claude_code: 'X'\nnoise_filter:\n  exclude_projects:\n    - a b\n  include_projects: []\nlayer3:\n  min_score: 4  # more\n")
    got = readers.read_config(spark, str(tmp_path))
    assert (got.source_labels, got.exclude_projects, got.include_projects, got.min_score, got.max_sessions) == ({"claude_code": "X"}, ["a b"], [], 4, 500)
    (tmp_path / "config.yaml").write_text("a:\n - b\n  c: d")
    assert readers.read_config(spark, str(tmp_path)) == readers.Config()


def test_blocks_and_routing(spark):
    rows = [(1, "auto-memory", "---\ntype: feedback\n---\nIt broke again.\n\nThe root cause was x.\n\nA fix is y."), (2, "auto-memory", "plain"), (3, "rule", "- prefer a\n- run tests\n* always b"), (4, "auto-memory", "---\ntype: odd\n---\nx"), (5, "auto-memory", "---\nname: x\n---\nx")]
    docs = spark.createDataFrame([(n, "/p/n.md", None, k, "user", "rule", c) for n, k, c in rows], "note long, path string, project_path string, kind string, scope string, label string, content string")
    routed = notes.route(notes.parsed(docs))
    assert [r["goes"] for r in routed.orderBy("note").collect()] == ["feedback", "no front matter", "rule", "unknown type", "no type"]
    pain = notes.pain_points(routed).first()
    assert (pain["problem"], pain["diagnosis"], pain["solution"], pain["recurring"], pain["project"]) == ("It broke again.", "The root cause was x.", "A fix is y.", True, "(global)")
    assert sorted(r["observation"] for r in notes.profiles(routed).collect()) == ["always b", "prefer a"]


def test_titles(spark):
    cases = {"[OC] src/a/b.ts: tool: hello there": "hello there", "x (@explore subagent) y": "x y", "n/a": text.UNTITLED, None: text.UNTITLED, "Wait for it....": "Wait for it", "<b>bold</b> move": "bold move", "[open] thing to do": "thing to do"}
    assert {k: one(spark, text.clean_title, k) for k in cases} == cases
    assert [one(spark, text.is_noise, s) for s in ("hello", "ab", "[INFO] x started", "a fine title", "--- !!! ---", None)] == [True, True, True, False, True, True]
    assert one(spark, lambda s: text.clean_evidence(s, 30), "API_KEY: x\nkeeps this line. and that other one, too") == "keeps this line. and that"
    assert one(spark, lambda s: text.churn_text(s.cast("int"), F.lit(0), F.lit(2)), "3") == " (+3/-0, 2 files)"


def test_technologies_and_stances(spark):
    line = lambda s: one(spark, lambda c: F.transform(extract.technologies(c), lambda x: x["name"]), s)
    assert line("We use React, Vue and docker") == ["React", "Vue", "Docker"] and line("import @base-ui/react") == [] and line("docker command") == [] and line("我用react了") == ["React"]
    assert [one(spark, lambda c: extract._stance(c), s) for s in ("never Docker", "prefer x", "only when y", "前端: React")] == ["avoid", "prefer", "conditional", "prefer"]
    assert one(spark, lambda c: text.relevance(c, F.lit("test it"), rules), "x") == "noise"


def judged(spark, kind, evidence=((4, "memory_file"),), **said):
    row = {"id": "c", "label": "l", "confidence": 0.7, "raw_text": "", **said}
    rows = extract.candidates(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if k == 'confidence' else 'string'}" for k in row)), kind)
    rows = rows.withColumn("evidence_ids", F.array(*[F.lit(f"e{k}") for k in range(len(evidence))]) if evidence else F.array().cast("array<string>"))
    held = spark.createDataFrame([(f"e{k}", t, s) for k, (t, s) in enumerate(evidence)] or [("none", 1, "x")], "id string, trust int, source_kind string")
    got = gate.judge(gate.with_evidence(rows, held), kind).first()
    return got["decision"], got["score"], got["issues"]


def test_gate_codes_of_every_kind(spark):
    good = {"subject": "React", "body": "前端", "detail": "prefer", "reason": "it is well known here"}
    assert judged(spark, "tech_preference", **good) == ("accept", 100, [])
    assert judged(spark, "tech_preference", **{**good, "detail": "conditional", "reason": ""}) == ("reject", 0, ["missing_rationale", "missing_required", "too_vague"])
    assert judged(spark, "tech_preference", [(2, "session_message")], **{**good, "reason": "create the page with it", "confidence": 0.5}) == ("reject", 70, ["single_occurrence_low_trust", "no_actionability"])
    assert judged(spark, "tech_preference", [], **{**good, "subject": "a b c d e", "reason": "x" * 151}) == ("quarantine", 0, ["too_long", "too_long", "weak_evidence"])
    assert judged(spark, "tech_preference", **{**good, "reason": "- a\n- b\n- c\n- d"})[2] == ["echo_raw_text"]
    assert judged(spark, "work_style", [], subject="d", body="Claude is slow today", detail="once") == ("reject", 0, ["no_actionability", "single_occurrence_low_trust", "weak_evidence"])
    assert judged(spark, "work_style", subject="d", body="writes tests first", detail="habitual", raw_text="writes tests first" + "." * 30)[2] == ["echo_raw_text"]
    assert judged(spark, "profile_fact", [(3, "x")], subject="role", body="dev", detail="global") == ("reject", 20, ["too_vague", "weak_evidence"])
    assert judged(spark, "profile_fact", subject="other", body="修改了代码", detail="global") == ("reject", 0, ["missing_required", "no_actionability"])
    assert judged(spark, "decision", [(3, "x")], subject="t", body="TODO", reason="") == ("reject", 0, ["no_actionability", "too_vague", "missing_rationale", "weak_evidence"])
    assert judged(spark, "decision", subject="t", body="no explicit decision", reason="because of that")[2] == ["meta_commentary"]
    assert judged(spark, "pain_point", [(2, "x")], subject="有bug", confidence=0.5) == ("reject", 0, ["too_vague", "too_vague", "missing_required", "single_occurrence_low_trust"])
    assert judged(spark, "timeline_event", subject="t", detail="2024-13-40") == ("reject", 40, ["invalid_date"]) and judged(spark, "timeline_event", subject="t", detail="2024-02-29")[0] == "accept"
    assert judged(spark, "open_thread", [], subject="看一下", body="done") == ("reject", 0, ["too_vague", "missing_required", "weak_evidence"])


def test_merge_is_idempotent_and_order_free(spark):
    rows = catalog_signals.accepted(spark, SF, "work_style").cache()
    now = F.lit(1_700_000_000_000)
    plain = lambda df: sorted(map(str, df.collect()))
    first, members = signals.merge(rows, "work_style", now)
    mixed, others = signals.merge(rows.repartition(7), "work_style", now)
    assert plain(first) == plain(mixed) and plain(members) == plain(others)
    again, same = signals.merge(rows, "work_style", now, first, members)
    assert plain(first) == plain(again) and plain(members) == plain(same)
    assert signals.consistent(first, members).count() == 0 and signals.merge(rows, "decision", now)[0].count() == 0
    rows.unpersist()


def test_merge_by_fingerprint_into_another_key(spark):
    columns = "kind string, id string, key string, fingerprint string, evidence_id string, trust int, confidence double, subject string, body string, detail string, reason string, extra string, trigger string, observed string, project string, label string"
    row = lambda id_, key, print_, trust=3, day="2024-01-01": ("decision", id_, key, print_, "e" + id_, trust, 0.5, "s" + id_, "b", "d", None, None, None, day, "p", "l")
    old, members = signals.merge(spark.createDataFrame([row("1", "k1", "f1"), row("2", "k1", "f2", 5)], columns), "decision", F.lit(0))
    new, held = signals.merge(spark.createDataFrame([row("3", "k9", "f2", 1, None), row("4", "k1", "f4", 5, "2024-02-01"), row("5", "k5", "f5")], columns), "decision", F.lit(0), old, members)
    got = {r["key"]: r for r in new.collect()}
    assert set(got) == {"k1", "k5"} and got["k1"]["support"] == 4 and got["k1"]["subject"] == "s4" and got["k1"]["first_ms"] == 0
    assert held.where("key = 'k1' and what = 'fingerprint'").count() == 3


def test_shares_of_a_budget(spark):
    def plain(sizes, most):
        if 3 * len(sizes) > most:
            return [max(1, most // len(sizes))] * len(sizes)
        out, left = [3] * len(sizes), most - 3 * len(sizes)
        for k, n in enumerate(sizes):
            extra = min(int(n / sum(sizes) * left), n - 3, left)
            if extra > 0:
                out[k], left = out[k] + extra, left - extra
        for k, n in enumerate(sizes):
            extra = min(n - out[k], left)
            if extra > 0:
                out[k], left = out[k] + extra, left - extra
        return out

    for sizes, most in (([40, 30, 20, 1], 60), ([5, 5], 80), ([9] * 30, 80), ([100], 80)):
        rows = spark.createDataFrame([(f"p{k:02}", n, k + 1) for k, n in enumerate(sizes)], "project string, size long, place int")
        got = {r["project"]: r["share"] for r in views.shares(rows, most).collect()}
        assert [got[f"p{k:02}"] for k in range(len(sizes))] == plain(sizes, most)


def test_finalize(spark):
    fit = lambda body, n: one(spark, lambda s: views.finalize(F.lit("# T\n"), s, n), body)
    assert fit("short", 99) == "# T\nshort" and fit("a b\n\nccc\n\ndddddd", 13) == "# T\na b\n\nccc\n" and fit("aaaa\nbbbb", 10) == "# T\naaaa\n"
    assert fit("One two. Three four five.", 14) == "# T\nOne two.\n" and fit("x" * 50, 10) == "# T\n"


def test_state_survives_a_broken_version(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    schema = "k int, v string"
    state.save(spark.createDataFrame([(1, "a")], schema), path)
    state.save(spark.createDataFrame([(1, "b")], schema), path)
    assert state.versions(spark, path) == [0, 1] and state.load(spark, path, schema).first()["v"] == "b" and state.load(spark, path, schema, below=1).first()["v"] == "a"
    for file in (tmp_path / "s/v1").glob("part-*"):
        file.write_bytes(b"no parquet")
    for file in (tmp_path / "s/v1").glob(".*.crc"):
        file.unlink()
    assert state.load(spark, path, schema).first()["v"] == "a" and state.versions(spark, path) == [0]
    ran = []
    table = lambda: ran.append(1) or spark.createDataFrame([(7, "z")], schema)
    assert [state.staged(spark, path, "one", table).first()["k"] for _ in range(2)] == [7, 7] and ran == [1]


def test_consolidation(spark):
    rows = spark.createDataFrame([(g, json.dumps({"k": k})) for g, n in (("a", 2), ("b", 200), ("c", 6)) for k in range(n)], "g string, r string")
    half = lambda prompts: [json.dumps(json.loads(p)[::2]) for p in prompts]
    chunks = completion.consolidate(rows, "g", "r", half, 5, 0)
    assert sorted((r["g"], r["chunk"], r["n"]) for r in chunks.collect()) == [("a", 0, 2), ("b", 0, 75), ("b", 1, 25), ("c", 0, 3)]
    assert {r["g"]: r["n"] for r in completion.finish(chunks, "g", half, 80, 0).collect()} == {"a": 2, "b": 50, "c": 3}
    assert {r["g"]: r["n"] for r in completion.finish(chunks, "g", lambda ps: ["none"], 80, 0).collect()} == {"a": 2, "b": 100, "c": 3}
    few = rows.where("g <> 'b'")
    assert sorted(r["n"] for r in completion.consolidate(few, "g", "r", half, 1, 0, keep_all=8).collect()) == [2, 6]


def test_profile_of_a_model(spark):
    said = {"role": "区块链产品经理", "responsibilities": ["写文档", " ", "维护 Old Gear", "四", "五"], "focus_areas": ["AI", "一" * 16, "DeFi"], "more": 1}
    rows = spark.createDataFrame([(json.dumps(said),), ('{"role": "开发者"}',), ("no json",), (None,)], "answer string")
    got = sorted((r["dimension"], r["claim"], r["confidence"]) for r in profile.facts_of_model(rows, ["old gear"]).collect())
    assert got == [("focus_area", "AI", 0.85), ("focus_area", "DeFi", 0.85), ("responsibility", "写文档", 0.85), ("responsibility", "四", 0.85), ("role", "区块链产品经理", 0.9)]
    contexts = spark.createDataFrame([("alpha", "t", "d"), ("beta7", "", ""), ("gamma", None, None)], "project string, titles string, topics string")
    assert {r["project"]: r["description"] for r in profile.describe(contexts, profile.stub, 0).collect()} == {"alpha": "用于管理数据的系统", "beta7": "(unknown)", "gamma": "用于管理数据的系统"}
    assert {r["description"] for r in profile.describe(contexts, lambda ps: ["no json"], 0).collect()} == {"(unknown)"}


def test_work_patterns(spark):
    tasks = spark.createDataFrame([("测试", 1, 10, None), ("重构", 9, 90, "a|b is the title")], "task string, n long, percent long, example string")
    hours = spark.createDataFrame([(3, 10), (7, 4), (9, 0)], "hour int, n int")
    firsts = spark.createDataFrame([("x", 2, "hello there")], "pattern string, n long, example string")
    text_ = profile.work_patterns(tasks, hours, firsts).first()[0]
    assert "| 重构 | 9 | 90% | \"a\\|b is the title\" |\n| 测试 | 1 | 10% | — |" in text_ and "| 03:00-03:59 | ██████████ 10 sessions |\n| 07:00-07:59 | ████ 4 sessions |" in text_ and "09:00" not in text_


def test_models_that_fail(spark):
    rows = spark.createDataFrame([(1, "first line\nmore"), (2, "second"), (3, "")], "session long, content string")
    got = {(r["session"], r["question"]): r for r in completion.ask_sessions(rows, {"short": completion.stub, "long": completion.stub}, 0).collect()}
    assert json.loads(got[1, "decisions"]["items"])[0]["what"] == "first line" and got[3, "decisions"]["n"] == 0 and not any(r["error"] for r in got.values())

    def broken(prompts):
        raise OSError("down")

    answers = completion.ask_sessions(rows, {"short": broken, "long": broken}, 0)
    assert {r["error"] for r in answers.collect()} == {"OSError: down"} and completion.processed(answers).count() == 0
    assert completion.ask_sessions(rows, {"short": lambda ps: [None] * len(ps), "long": broken}, 0).first()["error"] == "no answer"
    assert [completion.parse_json(s) for s in ('x ```json\n{"aB": 1}\n``` y', "so {\"a\": [1]} there", "none", None)] == [{"aB": 1}, {"a": [1]}, None, None]
    assert completion.snake({"sessionId": {"Why-Not": [{"aB": 1}]}}) == {"session_id": {"why_not": [{"a_b": 1}]}}


def test_budgets(spark):
    rows = spark.createDataFrame([(1, "aaaa"), (2, "bbbbbbbb"), (3, "cc"), (4, "aa")], "place int, line string")
    assert [r["place"] for r in views.char_budget(rows, "line", 9).collect()] == [1]
    assert sorted(r["place"] for r in views.skip_budget(rows, "line", 9).collect()) == [1, 3]
    assert sorted(r["place"] for r in views.greedy_distinct(rows, "line").collect()) == [1, 2, 3]


def test_stream_upsert_goes_on_from_its_state(spark, tmp_path):
    rows = spark.createDataFrame([(k % 5, k, f"v{k}") for k in range(40)], "k int, at int, v string")
    best = lambda df: sorted(map(tuple, signals.latest(df, "k", [F.desc("at")]).collect()))
    run = lambda: sorted(map(tuple, stream.upsert_available(spark, str(tmp_path / "in"), "k", ["at"], f"file://{tmp_path}/own").collect()))
    rows.where("at < 30").repartition(4).write.parquet(str(tmp_path / "in"))
    assert run() == best(rows.where("at < 30")) == run()
    rows.where("at >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == best(rows)


#: Of the queries of signals, which share long chains, one or two of each kind.
CHAINS = (
    "title_filters line_filters claim_filters shown_values front_matter_items memory_routing memory_decisions memory_pain_points memory_profiles session_tech_accumulator role_inference responsibility_theme focus_domains "
    "candidates_tech_preference candidates_profile_fact gate_decision gate_pain_point gate_work_style merge_signals merge_incremental view_weekly_focus_items view_timeline_items view_open_threads_items view_decisions_items "
    "view_char_budget_skip published_decisions_few_chars published_tech_preferences_few_items stream_merge_signals signals_united project_contexts focus_supplement profile_validators summary_validator store_manifest"
).split()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and (n in CHAINS or entry.queries()[n].__module__ != "quarry.catalog_signals")))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    answer = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    as_rows = lambda rows: sorted(tuple(str(round(float(v), 6)) if isinstance(v, float) or hasattr(v, "as_tuple") else str(v) for v in row) for row in rows)
    rows = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(rows.columns)
    got = [tuple(r[c] for c in names) for r in rows.collect()]
    assert as_rows(got) == as_rows(answer.fetchall())


def test_scratch_tables_go_but_what_is_kept(spark):
    import os

    from quarry import scratch

    rows = spark.range(5)
    with scratch.passing(spark) as outer:
        with scratch.passing(spark) as keep:
            gone, left = scratch.materialize(rows), keep(rows)
        assert left.count() == 5 and not any(os.path.exists(f.replace("file://", "")) for f in gone.inputFiles())
        kept = outer(left)
    assert kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        left.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
