"""The tool server, the scoring report, fills and git facts about one checkout."""

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tesserae import scoring
from tesserae.mcp import TOOLS, Server, cancelled
from tesserae.operators import caveat, evaluate, near, store
from tesserae.phases import Phases
from tesserae.sources import ingest
from tesserae.workspace import Workspace

BODY = "    checked = record.validate(:all, 3).first(2)\n    persist(checked.map { |c| c.name + c.size })\n    audit(checked, checked.sum { |c| c.size * 2 }, 1)\n    checked.sort.reverse.first\n"
GOOD = {"summary": "s", "primary_purpose": "p", "secondary_concerns": [], "side_effects": [], "domain": "d", "patterns": []}


def git(root, *args, when=None):
    env = {"GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000"} if when else {}
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)} | env)


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    r = tmp_path_factory.mktemp("git") / "co"
    (r / "app").mkdir(parents=True)
    git(r.parent, "init", "-q", str(r))
    (r / ".gitignore").write_text("build/\n")
    (r / "app/a.rb").write_text(f"class Invoice\n  def settle(record)\n{BODY}  end\nend\n")
    git(r, "add", "-A")
    git(r, "commit", "-qm", "one", when=1_000_000_000)
    (r / "app/b.rb").write_text(f"class Receipt\n  def store(item)\n{BODY.replace('record', 'item')}  end\nend\n")
    git(r, "add", "-A")
    git(r, "commit", "-qm", "two", when=1_100_000_000)
    (r / "app/c.rb").write_text(f"class Draft\n  def keep(record)\n    log(:x, 2)\n{BODY}  end\nend\n")
    (r / "lib.rs").write_text("pub fn parse(x: u8) -> u8 {\n    let y = x;\n    let z = y;\n    z + 1\n}\n")
    (r / "build").mkdir()
    (r / "build/d.rb").write_text("class Built\n  def made; 1; end\nend\n")
    return r


@pytest.fixture(scope="module")
def w(spark, checkout, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("store")), str(checkout))
    w.index()
    return w


def test_ignored_files_are_not_indexed(w):
    assert sorted(r.path for r in w.files().collect()) == ["app/a.rb", "app/b.rb", "app/c.rb", "lib.rs"]


def test_tiers_ages_and_what_is_uncovered(w):
    groups, hidden = w.dupes_both(threshold=0.3)
    got = groups.collect()
    assert [(r.tier, r.path, r.copies) for r in got if r.tier == "exact"] == [("exact", "app/a.rb", 2)]
    # a near group begins with the body of the smaller hash
    assert [r.path in ("app/a.rb", "app/c.rb") for r in got if r.tier == "near"] == [True] and hidden.count() == 0
    assert [r.saves_nodes for r in got] == sorted((r.saves_nodes for r in got), reverse=True)
    exact = w.dupes()[0]
    assert sorted((r.path, r.age) for r in w.ages(exact).collect()) == [("app/a.rb", 1_000_000_000), ("app/b.rb", 1_100_000_000)]
    # ages decide; references can't be measured
    assert [tuple(r)[1:] for r in w.originals(exact).collect()] == [("app/a.rb:2", "agree")]
    s = w.near_stats().first()
    assert (s.bodies, s.uncovered_lang, s.uncovered_small) == (3, 1, 0)
    assert [r.path for r in w.named("keep").collect()] == ["app/c.rb"]


def test_fill_keeps_answers_and_a_second_search_embeds_nothing(spark, checkout, tmp_path):
    w = Workspace(spark, str(tmp_path / "s"), str(checkout))
    w.index()
    assert w.search("settle invoice").first().path == "app/a.rb"
    assert w.fill(w.units()) == 0

    def ask(context, source):
        return None if "log(" in source else json.dumps(GOOD)

    first = w.summarize(ask, model="m", budget=1, batch=1)
    assert first == {"summarized": 1, "shared": 0, "failed": 0, "remaining": 3}
    assert w.summarize(ask, model="m", batch=2) == {"summarized": 2, "shared": 0, "failed": 1, "remaining": 1}
    rep = w.report()
    assert len(rep) == 1 and not rep[0]["stale"] and rep[0]["answerable"] == {"summarizable": 4, "summarized": 3, "state": "warming"}
    assert [(c["model"], c["via"], c["summarized"]) for c in rep[0]["coverage"]] == [("m", "api", 3)]
    assert w.report("/elsewhere") == []


def test_server(spark, checkout, tmp_path):
    s = Server(spark, str(tmp_path / "s"), str(checkout))
    call = lambda name, **a: json.loads(s.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})))["result"]
    text = lambda r: json.loads(r["content"][0]["text"])
    assert json.loads(s.answer("{"))["error"]["code"] == -32700 and json.loads(s.answer("{"))["id"] is None
    assert json.loads(s.answer('{"id": 3, "method": "x"}'))["error"]["code"] == -32601
    assert s.answer('{"method": "notifications/initialized"}') is None
    assert cancelled('{"method": "notifications/cancelled", "params": {"requestId": 7}}') == "7" and cancelled("{") is None
    assert {t["name"] for t in json.loads(s.answer('{"id": 1, "method": "tools/list"}'))["result"]["tools"]} == {"search", "similar", "dupes", "symbols", "status", "pending", "store_summary", "index"} == set(TOOLS)
    assert text(call("index"))["files"] == 4
    assert call("nothing")["isError"] and call("search")["isError"] and "did you mean" in call("similar", unit="Invoice#setle")["content"][0]["text"]
    assert text(call("dupes", canonical=True))["canonical"][0]["pick"] == "app/a.rb:2"
    waiting = text(call("pending", model="m", limit=1))["pending"]
    assert waiting[0]["path"] == "app/a.rb" and waiting[0]["source"].startswith("  def settle(record)") and "name: settle" in waiting[0]["context"]
    assert text(call("store_summary", unit="Invoice#settle", model="m", prompt_version="1", summary=GOOD)) == {"stored": "Invoice#settle"}
    assert call("store_summary", unit="Invoice#settle", model="m", prompt_version="0", summary=GOOD)["isError"]
    out = io.StringIO()
    s.serve(['{"id": 5, "method": "ping"}\n', "\n", '{"method": "notifications/cancelled", "params": {"requestId": 9}}\n'], out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 5, "result": {}}


def test_scores(w, tmp_path):
    (tmp_path / "pairs.tsv").write_text("Invoice#settle\tReceipt#store\tduplicate\nDraft#keep\tInvoice#settle\tnear\nparse\tInvoice#settle\tdistinct\nNo#one\tInvoice#settle\tnear\n")
    (tmp_path / "canonical.tsv").write_text("Invoice#settle\tReceipt#store\tolder\nReceipt#store\tNo#one\tolder\n")
    got = scoring.score(w, str(tmp_path))
    assert (got["dupes"]["tp"], got["dupes"]["fp"], got["dupes"]["fn"], got["dupes"]["unknown"], got["dupes"]["smallest_true"]) == (1, 0, 0, 1, 6)
    assert got["near"]["unknown"] == 1 and got["near"]["tp"] + got["near"]["fn"] == 1 and got["near"]["fp"] == 0
    assert len(got["sweep"]) == 30 and all(p["tp"] + p["fn"] == 1 for p in got["sweep"])
    c = got["canonical"]
    assert (c["correct"], c["wrong"], c["unknown"], c["right"]) == (1, 0, 1, "1/1 (100 %)")
    assert {s["signal"]: (s["correct"], s["silent"]) for s in c["signals"]} == {"age": (1, 0), "depth": (0, 1), "references": (0, 1)}
    assert evaluate.rate(0, 0) == "n/a"


def test_answers_of_outside_tools(spark):
    rows = [("A", '[{"name":"A","parent":"X"},{"name":"A"},{"name":"AB","parent":"Y"}]'), ("B", '{"status":"no_match"}'), ("C", '{"status":"warming"}'), ("D", "oops"), ("E", None), ("F", "[]")]
    got = {r.name: (r.status, r.parents) for r in caveat.definitions(spark.createDataFrame(rows, "name string, json string")).collect()}
    assert got == {"A": ("found", ["", "X"]), "B": ("none", []), "C": ("unavailable", []), "D": ("unavailable", []), "E": ("unavailable", []), "F": ("found", [])}
    rows = [("a", '{"counts":{"confirmed":2,"possible":0}}'), ("b", '{"reason":"no index","hint":"run it"}'), ("c", "x")]
    got = {r.id: (r.confirmed, r.possible, r.reason) for r in caveat.references(spark.createDataFrame(rows, "id string, json string")).collect()}
    assert got == {"a": (2, 0, None), "b": (None, None, "no index; run it"), "c": (None, None, "no counts")}


def test_small_parts(spark):
    sha = "a" * 40
    assert ingest.author_times(f"{sha} 1 1 2\nauthor-time 7\n\tx\n{sha} 2 2\n\ty\n") == [(1, 7), (2, 7)]
    roots = spark.createDataFrame([("/a",), ("/ab",)], "root string")
    assert [r.root for r in store.holding(roots, "/a/x").collect()] == ["/a"] and store.holding(roots).count() == 2
    found = spark.createDataFrame([(0.5, "b", 1), (0.9, "z", 1), (0.5, "a", 2)], "similarity double, path string, line int")
    assert [r.path for r in near.ordered(found).collect()] == ["z", "a", "b"]
    empty = spark.createDataFrame([], "norm_hash string, path string, line int, lang string")
    assert tuple(near.uncovered(empty, empty.select("norm_hash")).first()) == (0, 0)
    spans = spark.createDataFrame([("p", 1, 2), ("q", 1, 2), (None, 1, 1)], "path string, line int, end_line int")
    lines = spark.createDataFrame([("p", 2, 5), ("p", 1, 9), ("p", 3, 1)], "path string, at int, time long")
    assert sorted((r.path or "", r.age) for r in caveat.oldest(spans, lines).where(F.col("path").isNotNull()).collect()) == [("p", 5), ("q", None)]


def test_phases():
    p = Phases()
    with p("a"):
        pass
    p.add("a", 1000.0)
    p.add("b", 1.0)
    r = p.report()
    assert [(x["phase"], x["calls"]) for x in r["phases"]] == [("a", 2), ("b", 1)] and r["unaccounted"] == 0 and r["overlap"] > 900


def test_rankings_and_neighbours(w, tmp_path):
    (tmp_path / "queries.tsv").write_text("settle invoice\tInvoice#settle\nanything\tNo#one\n")
    (tmp_path / "similar.tsv").write_text("Invoice#settle\tmust\tReceipt#store\tstructural\nInvoice#settle\tmust_not\tReceipt#store\tnear\n")
    got = scoring.score(w, str(tmp_path))
    assert got["similar"] == {"must": "1/1 (100 %)", "must_not": "0/1 (0 %)"}
    assert all((got["ranking"][k]["top1"], got["ranking"][k]["total"], got["ranking"][k]["unknown"]) == (1, 1, 1) for k in ("best", "words"))
    assert len(got["ranking"]["floors"]) == 11


def test_caveats(spark, tmp_path):
    (tmp_path / "co").mkdir()
    for outer in ("Red", "Blue"):
        (tmp_path / f"co/{outer.lower()}.rb").write_text(f"module {outer}\n  class Box\n    def size\n      a = LIMIT\n      b = a + 1\n      b * 2\n    end\n  end\nend\n")
    w = Workspace(spark, str(tmp_path / "s"), str(tmp_path / "co"))
    w.index()
    found = w.dupes()[0]
    two = spark.createDataFrame([("LIMIT", "Red"), ("LIMIT", "Blue")], "name string, parent string")
    assert [r.name for r in w.caveats(found, two).collect()] == ["LIMIT"]
    assert w.caveats(found, spark.createDataFrame([("LIMIT", "")], two.schema)).count() == 0
