"""The whole way from a folder of sources to answers."""

import json

import pytest

from tesserae.__main__ import main
from tesserae.workspace import Workspace, policy_of

BODY = "    checked = record.validate(:all, 3).first(2)\n    persist(checked.map { |c| c.name + c.size })\n    audit(checked, checked.sum { |c| c.size * 2 }, 1)\n    checked.sort.reverse.first\n"


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "co"
    (r / "app").mkdir(parents=True)
    (r / "app/a.rb").write_text(f"class Invoice\n  def settle_open(record)\n{BODY}  end\nend\n")
    (r / "app/b.rb").write_text(f"class Receipt\n  def store(item)\n{BODY.replace('record', 'item')}  end\nend\n")
    (r / "app/c.rb").write_text(f"class Draft\n  def keep(record)\n    log(:x, 2)\n{BODY}  end\nend\n")
    (r / "lib.rs").write_text("pub fn parse(x: u8) -> u8 {\n    x + 1\n}\n")
    return r


def test_answers(spark, root, tmp_path, capsys):
    w = Workspace(spark, str(tmp_path / "store"), str(root))
    assert w.index() == {"root": str(root), "files": 4, "parsed": 4, "changed": True}
    assert w.index() == {"root": str(root), "files": 4, "parsed": 0, "changed": False}
    assert [(r.copies, r.path) for r in w.dupes()[0].collect()] == [(2, "app/a.rb")]
    near = w.dupes_near(threshold=0.3).collect()
    assert len(near) == 1 and near[0].shared_nodes > 10
    assert w.search("settle open invoice").first().path == "app/a.rb"
    got = [(r.tier, r.path) for r in w.similar("Invoice#settle_open").collect()]
    assert got[0] == ("structural", "app/b.rb") and ("lib.rs" in dict((p, t) for t, p in got) or len(got) >= 2)
    with pytest.raises(LookupError, match="did you mean Invoice#settle_open"):
        w.similar("settle_opne")
    assert [tuple(r)[1:] for r in w.status().collect()] == [(4, 4, 4)]
    good = {"summary": "s", "primary_purpose": "p", "secondary_concerns": [], "side_effects": [], "domain": "d", "patterns": []}
    w.store_summary("Invoice#settle_open", good, model="m")
    assert tuple(w.coverage().first()) == (4, 1, "warming") and w.pending().count() == 3
    with pytest.raises(ValueError, match="not a summary"):
        w.store_summary("Invoice#settle_open", {"summary": "s"}, model="m")
    (root / "app/d.rb").write_text("class D\n  def only; 1; end\nend\n")
    (root / "app/b.rb").unlink()
    assert w.index()["parsed"] == 1 and w.dupes()[0].count() == 0
    args = ["--store", str(tmp_path / "store"), "--root", str(root)]
    assert main([*args, "--ndjson", "dupes"], spark) == 1 and main([*args, "similar", "Nothing#here"], spark) == 2
    capsys.readouterr()
    assert main([*args, "--ndjson", "search", "keep draft"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["path"] == "app/c.rb"
    assert main(["symbols", str(root / "app/d.rb")]) == 0


def test_policy_file(tmp_path):
    assert policy_of(str(tmp_path)).prefixes == {}
    (tmp_path / "tesserae.toml").write_text('[paths]\nvendored = ["third"]\n')
    assert policy_of(str(tmp_path), True).prefixes == {"third": "vendored"} and policy_of(str(tmp_path), True).include_ignored
