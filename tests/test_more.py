"""Store, streams, published views, adapters and runs: unit tests."""

import datetime
import itertools
import json
import os
import random
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import bindings, catalog_signals, scratch
from quarry.operators import completion, extract, gate, publish, run, signals, store, views
from quarry.operators.components import components
from quarry.sources import adapters
from quarry.streaming import merge, windows

CANDIDATE = "kind string, id string, key string, fingerprint string, evidence_id string, trust int, confidence double, subject string, body string, detail string, reason string, extra string, trigger string, observed string, project string, label string"


def candidates(spark, n, seed=1, keys=6, prints=12):
    draw = random.Random(seed)
    rows = [("decision", f"c{k:03}", f"k{draw.randrange(keys)}", f"f{draw.randrange(prints)}", f"e{draw.randrange(20)}", draw.randrange(1, 6), draw.choice([0.3, 0.5, 0.9]), f"s{k}", f"b{k}", "d", None, None, None, f"2024-0{draw.randrange(1, 9)}-01", draw.choice(["p", "q", None]), "l") for k in range(n)]
    return spark.createDataFrame(rows, CANDIDATE)


def plain(df):
    return sorted(map(str, df.collect()))


def test_components(spark):
    edges = [(5, 4), (4, 2), (9, 9), (11, 10), (12, 11), (13, 12), (30, 31), (31, 32), (32, 30), (None, 7)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}
    for _ in root:
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unite_is_the_loop(spark):
    rows = candidates(spark, 40, 3, keys=20, prints=70)
    base, members = (scratch.materialize(x) for x in signals.merge(rows, "decision", F.lit(0)))
    one, held = signals.unite(base, members)
    sig, mem = [r.asDict() for r in base.collect()], [tuple(r) for r in members.collect()]
    groups = [[s] for s in sig]
    prints = {s["key"]: {v for k, w, v in mem if k == s["key"] and w == "fingerprint"} for s in sig}
    again = True
    while again:
        again = False
        for a, b in itertools.combinations(groups, 2):
            if any(x["key"] == y["key"] or prints[x["key"]] & prints[y["key"]] for x in a for y in b):
                a += b
                groups.remove(b)
                again = True
                break
    want = []
    for g in groups:
        best = min(g, key=lambda s: (-s["trust"], -s["confidence"], -s["last_ms"], s["id"]))
        evidence = {v for k, w, v in mem if w == "evidence" and any(k == s["key"] for s in g)}
        want.append((best["key"], best["id"], best["subject"], max(s["trust"] for s in g), min(s["first_ms"] for s in g), max(s["last_ms"] for s in g), len(evidence)))
    assert 1 < len(groups) < len(sig)
    assert sorted(tuple(r) for r in one.select("key", "id", "subject", "trust", "first_ms", "last_ms", "support").collect()) == sorted(want)
    assert signals.consistent(one, held).count() == 0
    assert held.where("what = 'merged-signal'").count() == len(sig) - len(groups)


def test_a_broken_store_is_told(spark):
    base, members = (scratch.materialize(x) for x in signals.merge(candidates(spark, 30), "decision", F.lit(0)))
    assert signals.consistent(base, members).count() == 0
    first = sorted(r["key"] for r in base.collect())[0]
    on = F.col("key") == first
    found = lambda s, m: [tuple(r) for r in signals.consistent(s, m).collect()]
    assert found(base.where(~on), members) == [(first, "members without signal")]
    assert found(base.withColumn("support", F.col("support") + on.cast("int")), members) == [(first, "support differs")]
    assert found(base.withColumn("first_ms", F.when(on, F.col("last_ms") + 1).otherwise(F.col("first_ms"))), members) == [(first, "times reversed")]


def test_store_rewrites_what_it_touches(spark, tmp_path):
    place, key = f"file://{tmp_path}/t", ("id",)
    schema = "id string, v int"
    rows = spark.createDataFrame([(f"r{k}", k) for k in range(200)], schema)
    store.upsert(place, rows, schema, key, buckets=16)
    files = lambda: {b: sorted(f for f in os.listdir(tmp_path / "t" / b) if f.endswith(".parquet")) for b in os.listdir(tmp_path / "t") if b.startswith("bucket")}
    before = files()
    touched = store.upsert(place, spark.createDataFrame([("r7", -7), ("new", 1), (None, 3)], schema), schema, key, spark.createDataFrame([("r9",)], "id string"), 16)
    after = files()
    assert len(before) == 16 and {b for b in after if before[b] != after[b]} == {f"bucket={k}" for k in touched} and len(touched) <= 4
    got = {r["id"]: r["v"] for r in store.read(spark, place, schema).collect()}
    assert got == {f"r{k}": k for k in range(200) if k != 9} | {"r7": -7, "new": 1, None: 3}
    store.upsert(place, spark.createDataFrame([(None, 4)], schema), schema, key, buckets=16)  # a null key is a key
    assert store.read(spark, place, schema).where("id is null").collect()[0]["v"] == 4
    store.upsert(place, rows.limit(0), schema, key, store.read(spark, place, schema).select("id"), 16)
    assert store.read(spark, place, schema).count() == 0 and not files()
    assert store.read(spark, f"{place}/none", schema).count() == 0


def test_publishing_is_noted_in_the_store(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}", 4)
    rows = candidates(spark, 30, prints=10**6)
    base, members = signals.merge(rows, "decision", F.lit(0))
    own.upsert("signals", base), own.upsert("members", members)
    doc = spark.createDataFrame([("text", [own.read("signals").first()["id"]])], "markdown string, ids array<string>")
    own.publish("decisions", doc, F.lit(5).cast("long"))
    own.publish("decisions", doc, F.lit(6).cast("long"))
    assert [r["published_ms"] for r in own.read("signals").where("published_ms is not null").collect()] == [6]
    assert [(r["view_id"], r["items"]) for r in own.read("views").collect()] == [("decisions", 1)]
    changed, more = own.merged("decision", rows, F.lit(0))
    assert changed.count() == 0 and more.count() == 0
    own.replace_kind("decision", base.where("key = 'k1'"))
    assert [r["key"] for r in own.read("signals").collect()] == ["k1"]


def test_stream_merge_with_retraction_and_repeats(spark, tmp_path):
    rows, now = candidates(spark, 80, 5), F.lit(0).cast("long")
    number = F.substring("id", 2, 3).cast("int")
    put = lambda df, op="add": merge.events(df, now, op).write.mode("append").parquet(f"{tmp_path}/in")
    got = lambda: merge.merge_available(spark, f"{tmp_path}/in", f"file://{tmp_path}/own", 4)
    shown = ("kind", "key", "id", "subject", "trust", "confidence", "first_ms", "last_ms", "support", "project")
    same = lambda df: plain(df.select(*shown)) == plain(signals.merge(want, "decision", now)[0].select(*shown))
    put(rows.where(number < 40))
    want = rows.where(number < 40)
    assert same(got()) and same(got())
    put(rows.where((number >= 20) & (number < 60)))
    put(rows.where((number < 40) & (number % 3 == 0)), "retract")
    put(rows.where("key = 'k2'"), "retract")
    want = rows.where((number < 60) & ~((number < 40) & (number % 3 == 0)) & (F.col("key") != "k2"))
    assert same(got())


def test_windows_close_late_events_are_counted_and_state_is_bounded(spark, tmp_path):
    day = 86_400_000
    sent = []
    for k in range(10):
        batch = [(day * (3 * k + j % 3) + 1000 * j, "ab"[j % 2]) for j in range(12)] + ([(5, "a"), (day * 3 * k - day, "b")] if k > 4 else [])
        sent.append(batch)
        pdf = pd.DataFrame(batch, columns=["ms", "key"])
        spark.createDataFrame(pdf).select(F.timestamp_millis("ms").alias("at"), "key").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", "at", "key", f"file://{tmp_path}/own")
    found, late, held = windows.windows_available(*args, width_ms=2 * day, step_ms=day, files=1)
    counts, tardy, passed, latest = {}, {}, -(1 << 62), -(1 << 62)
    for batch in sent:
        for at, key in batch:
            first = at - at % day
            tardy[key] = tardy.get(key, 0) + (first + 2 * day <= passed)
            for begin in (first, first - day):
                if begin + 2 * day > passed:
                    counts[key, begin] = counts.get((key, begin), 0) + 1
        latest = max(latest, *(at for at, _ in batch))
        passed = latest - day
    assert {(r["key"], r["begin_ms"]): (r["n"], r["what"]) for r in found.collect()} == {k: (n, "closed" if k[1] + 2 * day <= passed else "open") for k, n in counts.items()}
    assert {r["key"]: r["n"] for r in late.groupBy("key").agg(F.sum("n").alias("n")).collect()} == {k: n for k, n in tardy.items() if n}
    assert len(held) >= 10 and max(held) <= 2 * 2 * 10
    again, _, _ = windows.windows_available(*args, width_ms=2 * day, step_ms=day, files=1)
    assert again.count() == found.count()


def plain_pack(items, around, more, budget, rule):
    """The packing by the book: every item's document is written out and measured."""
    done, keep, total = [], [], 0
    stop = False
    for section, group in itertools.groupby(items, key=lambda x: x["section"]):
        lines, sub, n, said = [], None, 0, []
        for x in group:
            if stop or n >= budget.per_section or total >= budget.items:
                continue
            if x["same"] is not None and (not x["same"] or any(x["same"] in s or s in x["same"] for s in said)):
                continue
            new = ([x["heading"]] if x["heading"] and not lines else []) + ([x["sub"]] if x["sub"] and x["sub"] != sub else []) + [x["line"]]
            text = "\n\n".join([*done, "\n".join(lines + new)])
            if rule == "none" or around + more + len(text) <= budget.chars:
                lines, sub, n, total = lines + new, x["sub"], n + 1, total + 1
                keep.append(x["place"])
                said += [x["same"]] if x["same"] else []
            elif rule in ("section", "all"):
                if rule == "all":
                    stop = True
                break
        if lines:
            done.append("\n".join(lines))
    return keep


@pytest.mark.parametrize("rule", ["none", "section", "all", "item"])
def test_packing_is_the_loop(spark, rule):
    draw = random.Random(hash(rule) % 97)
    for case in range(4):
        place, items = itertools.count(1), []
        for section in ("one", "two", "a third", "four"):
            for k in range(draw.randrange(1, 7)):
                heading = "" if rule == "all" else f"## {section}"
                own = f"{section}{k}" if rule == "all" else section
                items.append({"place": next(place), "section": own, "heading": heading, "sub": draw.choice(["### x", "### y"]) if case % 2 else None, "line": "-" * draw.randrange(1, 60), "same": draw.choice(["aa", "aab", "b", ""]) if rule == "item" else None, "ids": [f"i{k}"], "tail": None})
        items = [x | {"sub": x["sub"] and sorted(y["sub"] for y in items if y["section"] == x["section"])[0]} for x in items]
        frame = publish.Frame("title", F.lit("meta"), None if rule == "none" else F.lit("notes"))
        around = len("# title\n" + "\n" + "meta") + (0 if rule == "none" else len("notes\n"))
        budget = publish.Budget(around + draw.choice([0, 40, 150, 400]), draw.choice([3, 100]), draw.choice([2, 100]))
        rows = spark.createDataFrame(items, "place long, section string, heading string, sub string, line string, same string, ids array<string>, tail string")
        packed = publish.pack(rows, frame, budget, rule)
        assert sorted(r["place"] for r in packed.collect()) == plain_pack(items, around, frame.more, budget, rule)
        whole = publish.document(publish.sections_of(packed).withColumnRenamed("draft", "text"), frame, budget).where("n = 0").first()
        assert rule == "none" or len(whole["text"]) <= max(budget.chars, around)


def test_longer_polished_sections_drop_the_last_ones(spark):
    calls = []

    def louder(prompts):
        calls.append(len(prompts))
        return [json.dumps({"sections": [{"sectionId": s["title"], "markdown": s["draftMarkdown"] + "!" * 30} for s in json.loads(p)["sections"] if s["title"] != "none"]}) for p in prompts]

    drafts = spark.createDataFrame([(1, "one", "## one\n- a", ["1", "2"]), (2, "none", "## none\n- b", ["3"]), (3, "two", "## two\n- c", ["1", "4"])], "n long, title string, draft string, ids array<string>")
    polished, gained = completion.polish_packed(drafts, None, louder, "v", "V", pause=0)
    texts = {r["title"]: r["text"] for r in polished.collect()}
    assert texts == {"one": "## one\n- a" + "!" * 30, "none": "## none\n- b", "two": "## two\n- c" + "!" * 30}
    frame = publish.Frame("t", F.lit("m"), F.lit("notes"))
    for chars, titles, ids in ((400, ["t", "one", "none", "two"], ["1", "2", "3", "4"]), (80, ["t", "one", "none"], ["1", "2", "3"]), (14, ["t"], []), (5, ["t"], [])):
        got = publish.document(polished, frame, publish.Budget(chars, 9, 9)).orderBy("n").collect()
        assert [r["title"] for r in got] == titles and got[0]["ids"] == ids
        assert len(got[0]["text"]) <= max(chars, len("# t\n"))
    cache = scratch.materialize(gained)
    assert cache.count() == 2

    def broken(prompts):
        raise AssertionError("asked although all is known")

    warm = cache.unionByName(drafts.where("title = 'none'").select(F.sha2(F.concat_ws("\x1f", F.lit("v1"), F.lit("v"), "title", "draft"), 256).alias("key"), F.lit("known").alias("polished")))
    again, more = completion.polish_packed(drafts, warm, broken, "v", "V", pause=0)
    assert {r["title"]: r["text"] for r in again.collect()} == texts | {"none": "known"} and more.count() == 0


def test_containment_by_automaton_is_the_loop(spark):
    draw = random.Random(4)
    rows = [(k, "".join(draw.choice("ab") for _ in range(draw.randrange(0, 14))), "xy"[k % 2]) for k in range(600)] + [(600, None, "x")]
    kept = {"x": [], "y": []}
    want = []
    for k, s, own in rows:
        if s and not any(s in o or o in s for o in kept[own]):
            kept[own].append(s)
            want.append(k)
    got = views.greedy_distinct(spark.createDataFrame(rows, "place int, s string, own string").repartition(4), "s", "own")
    assert sorted(r["place"] for r in got.collect()) == want and len(want) > 5


def test_calls_that_are_worth_it_are_tried_again(monkeypatch):
    waits = []
    monkeypatch.setattr(completion.time, "sleep", waits.append)

    def failing(*errors):
        left = list(errors)

        def model(prompts):
            if left:
                raise left.pop(0)
            return ["yes"] * len(prompts)

        return model

    ask = lambda *errors: completion._ask(failing(*errors), ["p"], 1.0)
    assert ask(completion.Refused(429, 7), completion.Refused(503), ConnectionError("x")) == (["yes"], None)
    assert waits[0] == 7 and 2 <= waits[1] <= 2.5 and 4 <= waits[2] <= 4.5
    waits.clear()
    for error in (completion.Refused(400), KeyError("a bug")):
        assert ask(error)[0] == [None] and not waits
    assert ask(*[completion.Refused(500)] * 9)[1] == "Refused: status 500" and len(waits) == completion.RETRIES
    assert completion._ask(lambda ps: [], ["p"], 0)[1] == "0 answers to 1 prompts"


def test_answers_are_kept_and_not_asked_again(spark, tmp_path):
    prompts = spark.createDataFrame([(k, f"q{k % 20}") for k in range(40)], "id int, prompt string")
    log = tmp_path / "log"
    log.mkdir()

    def model(down):
        def run(asked):
            import uuid

            if any(p in down for p in asked):
                raise completion.Refused(400)
            (log / uuid.uuid4().hex).write_text("\n".join(asked))
            return [p.upper() for p in asked]

        return run

    asked = lambda: sorted(line for f in log.iterdir() for line in f.read_text().split())
    go = lambda down: {r["id"]: (r["answer"], r["error"]) for r in completion.ask_resumable(prompts, model(down), f"file://{tmp_path}/own", waves=3, batch=1, pause=0).collect()}
    first = go({"q3", "q4"})
    assert first[3] == (None, "Refused: status 400") and first[23] == first[3] and first[5] == ("Q5", None)
    assert asked() == sorted(f"q{k}" for k in range(20) if k not in (3, 4))
    assert go(set()) == {k: (f"Q{k % 20}", None) for k in range(40)}
    assert asked() == sorted(f"q{k}" for k in range(20))  # each once in all


YAML = [
    ("", {}), ("# only\n", {}), ("a: 1\nb: two # c\nc: 'x # y'\nd:\n", {"a": 1, "b": "two", "c": "x # y", "d": None}), ("- a\n- 2.5\n- ~\n- true\n", ["a", 2.5, None, True]),
    ("a:\n- b\n- c\nd:\n  - e\n", {"a": ["b", "c"], "d": ["e"]}), ("- a: 1\n  b: 2\n- - x\n  - y\n", [{"a": 1, "b": 2}, ["x", "y"]]), ("a: [1, 'b, c', {d: e}, []] # x\nf: {g: [h], i: , \"j k\": 3}\n", {"a": [1, "b, c", {"d": "e"}, []], "f": {"g": ["h"], "i": None, "j k": 3}}),
    ("a: [1,\n  2, # two\n  3]\nb: 4\n", {"a": [1, 2, 3], "b": 4}), ('"a b": "x\\n\\u00e9"\n\'it\'\'s\': 1\n', {"a b": "x\né", "it's": 1}), ("a: |\n  one\n   two\n\n  three\nb: 1\n", {"a": "one\n two\n\nthree\n", "b": 1}),
    ("a: >-\n  one\n  two\n\n  three\n", {"a": "one two\nthree"}), ("a: |+\n  x\n\n\nb: |-\n  y\n", {"a": "x\n\n\n", "b": "y"}), ("base: &b {x: 1, y: 2}\nown:\n  <<: *b\n  y: 3\nlist: [*b]\n", {"base": {"x": 1, "y": 2}, "own": {"x": 1, "y": 3}, "list": [{"x": 1, "y": 2}]}),
    ("a: &n\n  k: v\nb: *n\n", {"a": {"k": "v"}, "b": {"k": "v"}}), ("url: http://x.org/a:b\ntime: 12:30\n", {"url": "http://x.org/a:b", "time": "12:30"}), ("---\na: 1\n", {"a": 1}), ("a: 1\na: 2\n", {"a": 2}),
    ("- |\n  t\n- &x y\n- *x\n", ["t\n", "y", "y"]), ("a:\n  b:\n    - c: [d]\n      e: f\n  g: 0\n", {"a": {"b": [{"c": ["d"], "e": "f"}], "g": 0}}),
]


@pytest.mark.parametrize(("content", "value"), YAML)
def test_yaml(content, value):
    from quarry.sources import yaml

    assert yaml.parse(content) == value


@pytest.mark.parametrize("content", ["a:\n - b\n  c: d", "a: [1, 2", "a: 'x", "a: *none", "a: 1\n  b: 2", "a: !!str x", "- a\nb: c", "a: {b: 1]", "<<: 3", "a: 'x' y"])
def test_yaml_that_is_broken(content):
    from quarry.sources import yaml

    with pytest.raises(ValueError):
        yaml.parse(content)


def test_notes_of_a_reader_stay(spark):
    kept = "<!-- user notes -->\nmine\n<!-- /user notes -->"
    said = lambda previous: spark.range(1).select(publish.notes_of(previous)).first()[0]
    assert said(f"old {kept} more") == kept and said(None) == said("no marks") == publish.DEFAULT_NOTES


def test_a_broken_run_gives_the_store_of_an_unbroken_one(spark, tmp_path):
    rows, now = candidates(spark, 40, 9), F.lit(0).cast("long")
    notes = lambda *pairs: spark.createDataFrame(list(pairs), "id string, hash string")
    early = F.substring("id", 2, 3).cast("int") < 20
    tables = ("signals", "members", "processed", "hashes", "marks")
    go = lambda root, rows, listed, break_at=None: catalog_signals.extraction_run(spark, root, rows, now, listed, break_at)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    first, then = notes(("e1", "x"), ("e2", "x")), notes(("e1", "y"), ("e3", "x"))
    go(one, rows.where(early), first), go(one, rows, then)
    go(two, rows.where(early), first)
    before = {t: plain(run.read(spark, two, t)) for t in tables}
    for break_at in ("diff", "new", "signals", "commit"):
        with pytest.raises(catalog_signals.Broken):
            go(two, rows, then, break_at)
        assert {t: plain(run.read(spark, two, t)) for t in tables} == before  # nothing is seen of it
    this = run.begin(spark, two)
    assert this.number == 1
    applied = run._apply
    run._apply = lambda *args: (_ for _ in ()).throw(catalog_signals.Broken("behind the commit"))
    try:
        with pytest.raises(catalog_signals.Broken):
            go(two, rows, then)
    finally:
        run._apply = applied
    assert {t: plain(run.read(spark, two, t)) for t in tables} == {t: plain(run.read(spark, one, t)) for t in tables}


def test_adapters(spark, tmp_path):
    def log(name, *events):
        path = tmp_path / "logs" / "-home-u-shop" / f"{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(map(json.dumps, events)))
        return path

    old = log("a", {"type": "user", "content": "hello", "timestamp": "2024-01-02T00:00:00Z"}, {"type": "assistant", "content": "yes"})
    os.utime(old, (1_700_000_000, 1_700_000_000))
    table = lambda rows, schema: lambda: spark.createDataFrame(rows, schema)
    tables = {
        "projects": table([("1", "/home/u/shop", "Shop"), ("2", "/srv/x", None)], "id string, worktree string, name string"),
        "sessions": table([("1", "s1", "t", 10), ("1", "s2", "t", 30)], "project_id string, session_id string, title string, ts_ms long"),
        "messages": table([("s1", "m1", "{}", 1), ("s2", "m2", '{"role":"assistant"}', 2)], "session string, message string, data string, ts_ms long"),
        "parts": table([("m1", '"hi"', 1, 1), ("m2", '{"text":"ho"}', 1, 1)], "message string, data string, part_ms long, part int"),
        "todos": table([("s1", "do", "pending"), ("s1", "done", "completed")], "session string, content string, status string"),
    }
    both = adapters.Registry(spark).register(adapters.TableAdapter(spark, "opencode", tables)).register(adapters.LogAdapter(spark, "claude-code", str(tmp_path / "logs"))).register(adapters.LogAdapter(spark, "gone", str(tmp_path / "none")))
    assert [a.name for a in both.active()] == ["opencode", "claude-code"]
    assert sorted((r["source"], r["session_id"], r["messages"], r["label"]) for r in both.sessions().collect()) == [("claude-code", "a", 2, "CC"), ("opencode", "s1", 1, "OC"), ("opencode", "s2", 1, "OC")]
    assert [(r["path"], r["name"], len(r["sources"])) for r in both.merged_projects().orderBy("path").collect()] == [("/home/u/shop", "Shop", 2), ("/srv/x", "x", 1)]
    assert [(r["session_id"], r["content"]) for r in both.todos().collect()] == [("s1", "do")]
    marks = both.marks({"opencode": 99, "silent": 5})
    assert marks == {"opencode": 99, "silent": 5, "claude-code": 1_700_000_000_000}
    log("b", {"type": "user", "content": "more"})
    since = {"opencode": 10, "claude-code": marks["claude-code"] + 5_000}
    assert sorted((r["source"], r["session_id"]) for r in both.sessions(since).collect()) == [("claude-code", "b"), ("opencode", "s2")]
    assert sorted((r["source"], r["session_id"], r["role"], r["content"]) for r in both.messages(since).collect()) == [("claude-code", "b", "user", "more"), ("opencode", "s2", "assistant", "ho")]
    opened = both.active()[1]
    from quarry.sources import readers

    assert len(readers.read_lines(spark, opened.path, since_ms=since["claude-code"]).inputFiles()) == 1  # the old file is not even listed
    with pytest.raises(ValueError):
        both.register(adapters.LogAdapter(spark, "gone", "x"))


def test_threads_keep_their_own_scratch_tables(spark):
    begun, ended, found = threading.Event(), threading.Event(), []

    def other():
        with scratch.passing(spark):
            begun.wait(60)
            own = scratch.materialize(spark.range(3))
            ended.set()
            done.wait(60)
            found.append(own.count())

    done = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with scratch.passing(spark):
        begun.set()
        ended.wait(60)
    done.set()
    thread.join()
    assert found == [3]


def test_no_window_over_all_candidates(spark):
    plan = catalog_signals.judged(spark, catalog_signals_sf(), "work_style")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def catalog_signals_sf():
    return "/root/testdata/sf0.001"


def test_bound_rows_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    spark.range(1, 5001).selectExpr("id as p_partkey", "concat('part ', id % 7) as p_name", "'b' as p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    whole = plain(bindings.bound(spark, str(tmp_path), "claims"))
    monkeypatch.setitem(bindings.DEALT, "part", ("p_partkey", 500))
    rows = bindings.bound(spark, str(tmp_path), "claims")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1000 and plain(rows) == whole
    # What the rules cost is paid behind the exchange, not by the one task that reads the file.
    plan = rows.where(F.col("problem").rlike("breaks"))._jdf.queryExecution().executedPlan().toString()
    assert "breaks" in plan[: plan.index("REPARTITION_BY_NUM")] and "breaks" not in plan[plan.index("REPARTITION_BY_NUM") :]


def test_sessions_that_say_the_same_are_read_once(spark):
    rows = [("p", "a", "2024-01-03", 5, "always React", None), ("p", "b", "2024-01-02", 7, "always React", None), ("p", "c", "2024-01-02", 6, "always React", "x"), ("p", "d", "2024-01-09", 1, None, "never use React"), ("q", "e", "2024-01-01", 2, "always React", None), (None, "f", "2024-01-04", 3, " ", "avoid React")]
    sess = spark.createDataFrame(rows * 3, "project string, source string, day string, session long, title string, first_user string")
    said = extract.session_mentions(sess)
    assert sorted((str(r["project"]), r["n"], r["session"], r["source"], r["latest"]) for r in said.collect()) == [("None", 3, 3, "f", "2024-01-04"), ("p", 3, 1, "d", "2024-01-09"), ("p", 9, 6, "c", "2024-01-03"), ("q", 3, 2, "e", "2024-01-01")]
    got = {str(r["project"]): tuple(r)[3:] for r in extract.accumulate(said).collect()}
    assert got == {"None": (3, 0, 3, 0, "2024-01-04", "avoid React", "f"), "p": (12, 9, 3, 0, "2024-01-09", "never use React", "c"), "q": (3, 3, 0, 0, "2024-01-01", "always React", "e")}


def test_a_merge_reads_what_the_gate_let_pass_once_written(spark):
    rows = catalog_signals.accepted(spark, catalog_signals_sf(), "work_style")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Window" not in plan
    assert {r["decision"] for r in rows.collect()} <= {"accept", "needs_merge"}


def reads_each_text_once(df):
    """Whether no pattern of the rules stands below the first aggregate of the plan, where it would read every row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate" in plan and "RLIKE" not in plan[plan.rindex("Aggregate") :].split("\n", 1)[1]


def test_decisions_that_say_the_same_are_read_once(spark):
    rows = [("p", "design the API and its roadmap", "agent", None), ("p", "design the API and its roadmap", "agent", None), (" p ", "design the API and its roadmap", None, "agent"), ("q", "知识库 and funding", None, None), (None, None, None, None), ("p", "x", "", ""), ("q", "", None, None), ("q", "知识库 and funding", None, None)]
    both = spark.createDataFrame(rows * 4, "project string, what string, why string, trigger_text string")
    said = [" ".join(x or "" for x in r[1:]) for r in rows]
    of = lambda patterns: {name: 4 * sum(spark.range(1).select(F.lit(s).rlike(p).alias("x")).first()["x"] for s in said) for name, p in patterns}
    shares, hits, top = extract.role_shares(both), extract.focus_hits(both), extract.themes(both)
    assert shares.first().asDict() == {"total": 32} | {f"n{k}": n for k, n in enumerate(of([(k, p) for k, (_, _, p) in enumerate(extract.rules.ROLE_PARTS)]).values())}
    assert {r["domain"]: r["n"] for r in hits.collect()} == {d: n for d, n in of(extract.rules.FOCUS_DOMAINS).items() if n}
    assert {r["project"]: r["n"] for r in top.collect()}.items() <= {"p": 16, "q": 12}.items()
    entries = both.select(F.lit(1).alias("place"), F.lit("rule").alias("label"), F.concat(F.lit("负责 "), "what").alias("observation"))
    facts = extract.facts_of_memory(entries)
    assert facts.count() == facts.select("id").distinct().count() > 0
    assert all(map(reads_each_text_once, (shares, hits, facts)))


def test_a_merge_counts_evidence_without_other_members(spark):
    rows = candidates(spark, 60)
    one, members = signals.merge(rows, "decision", F.lit(0).cast("long"))
    assert "merged" not in one._jdf.queryExecution().optimizedPlan().toString()
    counted = {r["key"]: r["count"] for r in members.where("what = 'evidence'").groupBy("key").count().collect()}
    assert {r["key"]: r["support"] for r in one.collect()} == counted
    two, held = signals.merge(candidates(spark, 40, seed=2), "decision", F.lit(0).cast("long"), one, members)
    counted = {r["key"]: r["count"] for r in held.where("what = 'evidence'").groupBy("key").count().collect()}
    assert {r["key"]: r["support"] for r in two.collect()} == counted


def test_evidence_that_is_named_twice(spark):
    rows = spark.createDataFrame([("a", ["e", "e", "f"]), ("b", ["e", None]), ("c", ["x"]), ("d", [])], "id string, evidence_ids array<string>")
    held = spark.createDataFrame([("e", 2, "session_message"), ("f", 4, "rule_file"), ("g", 5, "rule_file")], "id string, trust int, source_kind string")
    found = gate.with_evidence(rows, held)
    assert sorted((r["id"], r["n"], r["different"], r["most_trust"], r["sessions_only"]) for r in found.collect()) == [("a", 3, 2, 4, 0), ("b", 1, 1, 2, 1), ("c", 0, 0, 0, 0), ("d", 0, 0, 0, 0)]
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString().replace("array_distinct", "")


def test_views_look_further_than_their_budget(spark):
    assert publish.Budget.of("decisions").items == views.BUDGETS["decisions"][1] and set(publish.RULES) == set(views.VIEWS)


def test_gate_passes_without_evidence_what_it_judges_to_pass_with_it(spark):
    subjects, bodies, details, reasons = ["", "role", "看一下", "Keep the queue in one place", "x" * 201], ["", "open", "TODO", "no explicit decision", "修改了代码", "b" * 160, "Use it for the queue, always"], ["global", "2024-02-30", "2024-02-29", None], [None, "", "because it is proven", "- a\n- b\n- c\n- d"]
    rows = [(f"c{k}", *said) for k, said in enumerate(itertools.product(subjects, bodies, details, reasons))]
    made = spark.createDataFrame(rows, "id string, subject string, body string, detail string, reason string").withColumns({"confidence": F.lit(0.5), "raw_text": F.concat_ws(" ", "subject", "body")})
    held = spark.createDataFrame([("e1", 2, "session_message"), ("e2", 5, "rule_file")], "id string, trust int, source_kind string")
    for kind in gate.DECIDED_BY_TEXT:
        cand = extract.candidates(made, kind)
        got = {r["id"] for r in gate.passing(cand, kind).collect()}
        assert got and len(got) < len(rows)
        for ids in ([], ["e1"], ["e1", "e2"]):
            known = gate.with_evidence(cand.withColumn("evidence_ids", F.array(*map(F.lit, ids)).cast("array<string>")), held)
            assert got == {r["id"] for r in gate.judge(known, kind).where("decision in ('accept', 'needs_merge')").collect()}
    for kind in set(gate.HEAVY_CODES) - set(gate.DECIDED_BY_TEXT):
        with pytest.raises(ValueError):
            gate.passing(extract.candidates(made, kind), kind)


def test_signals_of_one_reader_are_merged_as_far_as_it_reads(spark):
    rows = catalog_signals.signals_of(spark, catalog_signals_sf(), "decision", "profile_fact")
    said = rows.where("kind = 'decision'").select("subject", "body")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in said and "Union" not in said  # no support, and no other kind
    assert plain(rows) == sorted(x for kind in ("decision", "profile_fact") for x in plain(catalog_signals.merged(spark, catalog_signals_sf(), kind)[0]))


def test_texts_of_sessions_are_read_once(spark):
    titles = [None, "", "  ", "(untitled)", " Fix the bug ", "Fix the bug", "Deploy: (v1.2) — done!", "x. " * 50, "Prefer SQLite for small tools, always"]
    rows = [(k % 23, project, "src", title, day, "pending" if k % 2 else "in_progress") for k, (title, project, day) in enumerate(itertools.product(titles, ("p", "P-1", None), ("2024-01-02", None)))]
    sess = spark.createDataFrame(rows * 2, "session long, project string, source string, title string, day string, status string").withColumn("day", F.col("day").cast("date"))
    got = extract.timeline_events(sess)
    again = extract.candidates(got.drop("kind", "fingerprint", "key"), "timeline_event")
    assert plain(got) == plain(again.select(*got.columns)) and got.count() == got.select("id").distinct().count()
    own = lambda k: (rows[k][1] or "", str(rows[k][4] or ""), rows[k][0])
    assert got.count() == len({own(k) for k in range(len(rows)) if (rows[k][3] or "").strip() not in ("", "(untitled)")})
    threads = extract.open_threads(sess.withColumnRenamed("title", "content"), F.lit("2024-02-01"))
    first = threads.groupBy("id").agg(F.count("*").alias("n"), F.min("evidence_id")).collect()
    assert {r["n"] for r in first} == {1} and len(first) == len({(r[1] or "", r[3]) for r in rows if (r[3] or "").strip()})
    for made in (got, threads):  # the rules' patterns are below the texts that were written
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "deploy" not in plan and "instr" not in plan.lower() and "parquet" in plan


def test_merge_joins_support_where_signals_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = signals.merge(candidates(spark, 50), "decision", F.lit(0))[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3  # by key, by key and evidence, by key


def test_events_of_a_views_days_are_those_of_all_days(spark, tmp_path):
    day = lambda k: datetime.datetime(2024, 3, 1) - datetime.timedelta(days=k)
    rows = [(k, k % 3, "OPF"[k % 3], None if k % 17 == 0 else day(k % 40)) for k in range(600)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    now = catalog_signals.now_ms(spark, str(tmp_path))
    whole = catalog_signals.merged(spark, str(tmp_path), "timeline_event")[0]
    for view, days in views.EVENT_DAYS.items():
        since = now - days * views.DAY_MS
        few = catalog_signals.signals_for(spark, str(tmp_path), ("timeline_event",), now, views.EVENT_DAYS[view])
        assert plain(few) == plain(whole.where(views.timeline_ms() >= since)) == plain(whole.where(F.col("last_ms") >= since))
        assert 0 < few.count() < whole.count()
    cut = bindings.bound(spark, str(tmp_path), "sess", "session", "day", where=extract.of_days_since(now))
    assert cut.columns == ["session", "day"]
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Deploy" not in plan and plan.index("Generate") < plan.index("Filter")


def test_a_place_that_repeats_a_decision_gives_the_first(spark):
    place, what, why = ("s1", "s2", None), ("Use a queue instead of polling", "TODO", ""), ("it is simpler", "", None, "insufficient context")
    rows = [(p, project, "rule" if k % 2 else "m", w, y, other, trigger, day) for k, (p, w, y, project, other, trigger, day) in enumerate(itertools.product(place, what, why, ("p", "a:b", None), ("cron", ""), (" late ", ""), ("2024-05-01", None)))]
    random.Random(3).shuffle(rows)
    told = spark.createDataFrame(rows, "place string, project string, label string, what string, why string, alternatives string, trigger_text string, date string")
    ties = [F.asc("evidence_id"), F.asc("raw_text"), F.desc("trust"), *[F.coalesce(c, F.lit("")) for c in catalog_signals._TIES]]
    each = told.withColumn("place", F.concat(F.coalesce("place", F.lit("")), F.lit("#"), F.monotonically_increasing_id().cast("string")))  # no row repeats another
    for memory in (False, True):
        got = extract.decisions(told, memory)
        assert got.count() == 3 * 2  # by place and reason ("" and null are one); of the rest none says a decision
        whole = extract.decisions(each, memory)
        assert whole.count() > got.count()
        shown = [c for c in whole.columns if c not in ("id", "evidence_id", "label")]
        want = extract.first_by(whole.withColumn("at", F.col("raw_text")), ["at"], [F.desc("trust"), *ties[3:]]).select(*shown)
        assert set(plain(got.select(*shown))) == set(plain(want))


def test_equal_observations_are_read_once(spark):
    rows = [(f"s{k}", "ai", c, o, e) for k, (c, o, e) in enumerate(itertools.product((" Rhythm", "Rhythm"), ("always checks twice", "Task: do it", None), ("seen", " seen ", None)))]
    told = spark.createDataFrame(rows, "place string, label string, category string, observation string, evidence string")
    got = extract.work_styles(told, False)
    assert got.count() == 2 and plain(got.select("reason")) == plain(spark.createDataFrame([("seen",), (None,)], "reason string"))
    assert extract.work_styles(told, True).count() == 2 * 3  # a memory's place is part of its evidence


def test_no_rows_are_no_work(spark, tmp_path):
    none = store.read(spark, f"{tmp_path}/signals", store.SCHEMAS["signals"])
    assert none.dtypes == [(f.name, f.dataType.simpleString()) for f in store.schema_of(spark, store.SCHEMAS["signals"]).fields] and none.isEmpty()
    ids = spark.range(5).select(F.col("id").cast("string"))
    left = ids.join(none, "id", "left_anti")
    assert left.count() == 5 and "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert ids.join(none, "id", "left_semi").isEmpty()
