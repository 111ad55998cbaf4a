"""Sources, sinks, extraction and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.sources import ingest, labels, sinks
from tesserae.sources.extract import rust

SRC = '''
//! comment { with brace
use std::fmt;
pub struct W<T> { x: T }
impl<T: Clone> fmt::Display for a::W<T> where T: Clone {
    pub(crate) fn show(&self, n: usize, (a, b): (u8, u8)) -> String { /* a /* nested */ } */ let c = '}'; format!("{}", r#"}"#) }
    fn new() -> impl Iterator<Item = u8> { fn inner(x: u8) -> u8 { x } inner(1) }
}
pub trait T { fn sig(&self) -> u8; }
mod deep { mod er { pub fn f<'a>(s: &'a str) -> &'a str { s } } }
#[cfg(test)]
mod tests { #[test] fn t() { assert!(1 < 2); } }
'''


def test_rust_units():
    found, lines, errors = rust.units(SRC)
    got = {("::".join(x for x in (u["owner"], u["name"]) if x)): u for u in found}
    assert set(got) == {"W::show", "W::new", "W::inner", "T::sig", "deep::er::f", "tests::t"} and errors == 0 and lines == SRC.count("\n") + 1
    assert (got["W::show"]["singleton"], got["W::show"]["visibility"], [p["name"] for p in got["W::show"]["params"]]) == (False, "protected", ["n", "(a,b)"])
    assert got["W::new"]["singleton"] and got["W::new"]["visibility"] == "private" and got["T::sig"]["norm_hash"] is None and got["deep::er::f"]["visibility"] == "public"
    assert got["W::show"]["line"] == got["W::show"]["end_line"] == 6
    assert rust.units("fn broken( {")[2] == 1 and rust.units("")[:2] == ([], 0)


def test_rust_token_hash():
    h = lambda s: rust.units(s)[0][0]["norm_hash"]
    a = "fn a(x: u8) -> u8 { let y = x + 1; y * 2 }"
    assert h(a) == h("pub fn other(x: u8) -> u8 {\n  let y = x+1; // note\n  y*2\n}") and h(a) != h(a.replace("y", "z")) and h(a) != h(a.replace("1", "2"))


def test_ingest(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() { 1; }")
    (tmp_path / "src/b.rs").write_text("fn a() { 1; }")
    (tmp_path / "src/n.txt").write_text("none")
    files = ingest.read_tree(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"src/a.rs", "src/b.rs"}
    none = spark.createDataFrame([], "oid string")
    units, blobs = ingest.ingest(files, none)
    assert units.count() == 1 and blobs.count() == 1
    assert ingest.ingest(files, files.select("oid"))[0].count() == 0
    assert ingest.fingerprint(files).first().map_key == ingest.fingerprint(files.orderBy(F.desc("path"))).first().map_key
    listing = "100644 " + "a" * 40 + " 0\tx y.rb\x00120000 " + "b" * 40 + " 0\tlink.rb\x00100755 " + "c" * 40 + " 0\tz.py\x00"
    got = spark.createDataFrame([(listing,)], "l string").select(F.explode(ingest.tracked(F.col("l"))).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in got] == [("x y.rb", "a" * 40)]
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, oid string")
    dirty = spark.createDataFrame([("b", "9"), ("c", None), ("d", "4")], "path string, oid string")
    assert {tuple(r) for r in ingest.overlaid(base, dirty).collect()} == {("a", "1"), ("b", "9"), ("d", "4")}
    assert ingest.outline("a.rs", "fn x() {}")[0]["name"] == "x" and ingest.outline("a.py", "fn x() {}") == []


def test_labels(spark, tmp_path):
    f = tmp_path / "pairs.tsv"
    f.write_text("# a comment\n\nA#x\tB#x\tduplicate\nA#y\tB#y\tnear\tprovisional\n")
    got = labels.load(spark, str(f), "pairs").orderBy("line").collect()
    assert [(r.a, r.kind, r.provisional) for r in got] == [("A#x", "duplicate", False), ("A#y", "near", True)]
    for bad, kind in (("A\tB\todd", "pairs"), ("A", "queries"), ("A\tB\tolder,odd", "canonical"), ("p\tmust\tn", "similar"), ("p\tmay\tn\tnear", "similar")):
        f.write_text("# one\n" + bad + "\n")
        with pytest.raises(labels.LabelError, match=":2:"):
            labels.load(spark, str(f), kind)
    f.write_text("p\tmust\tn\tnear\np\tmust_not\tm\n")
    assert labels.load(spark, str(f), "similar").count() == 2
    j = tmp_path / "s.json"
    j.write_text(json.dumps({"A#x": {"summary": "s", "primary_purpose": "p", "secondary_concerns": [], "side_effects": ["raises"], "domain": "d", "patterns": []}}))
    assert labels.fixtures(spark, str(j)).first().summary.side_effects == ["raises"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert [json.loads(r)["x"] for r in sinks.ndjson(df)] == [1, 2] and json.loads(sinks.pretty(df))[0] == {"x": 1, "y": "a"}
    assert sinks.exit_code(df) == 0 and sinks.exit_code(df.limit(0)) == 1
    sinks.write(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_stream_stores_each_blob_once(spark, tmp_path):
    from tesserae.streaming.refresh import refresh

    feed = str(tmp_path / "feed")
    rows = lambda *xs: spark.createDataFrame([(p, c.encode(), t) for p, c, t in xs], "path string, content binary, t long").select("path", "content", F.timestamp_seconds("t").alias("ts"))
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    for batch in (rows(("a", "one", 0), ("b", "one", 1), ("c", "two", 2)), rows(("d", "two", 90_000), ("e", "three", 90_001))):
        batch.write.mode("append").parquet(feed)
        q = refresh(spark.readStream.schema(batch.schema).parquet(feed), table, mark)
        q.awaitTermination()
    assert sorted(bytes(r.content).decode() for r in spark.read.parquet(table).collect()) == ["one", "three", "two"]
