"""Pinned small cases of each operator."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import dates, hashing, paths, text, vectors
from tesserae.operators import canonical, caveat, evaluate, exact, near, postings, search, similar, store, summary


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lit(*values):
    return F.array(*[F.lit(v) for v in values])


@pytest.mark.parametrize(("name", "words"), [("unpaid_for", "unpaid for"), ("markPaid", "mark Paid"), ("Invoice#unpaid_for", "Invoice unpaid for"), ("URLSlug", "URL Slug"), ("id", "id"), ("HTTPClient", "HTTP Client"), ("v2Name", "v2 Name")])
def test_humanize(spark, name, words):
    assert one(spark, text.humanize(F.lit(name))) == words


def test_lexical_score(spark):
    score = lambda q, n: one(spark, text.lexical_score(F.array(*[F.lit(x) for x in q]).cast("array<string>"), F.array(*[F.lit(x) for x in n]).cast("array<string>")))
    assert score(["unpa"], ["unpaid", "for"]) == 0.5 and score(["unpaid"], ["unpaid", "for"]) == 1.0
    assert score(["a"], ["apple"]) == 0 and score(["is"], ["is", "x"]) == 1.0 and score(["is"], ["island"]) == 0
    assert score([], ["a"]) == 0 and score(["a"], []) == 0 and score(["paid", "nothing"], ["paid"]) == 0.5


def test_ids_and_texts(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, text.unit_id(F.lit("ruby"), F.lit("A::B"), F.lit("m"), f)) == "A::B#m"
    assert one(spark, text.unit_id(F.lit("ruby"), F.lit("A"), F.lit("m"), t)) == "A.m"
    assert one(spark, text.unit_id(F.lit("rust"), F.lit("a"), F.lit("m"), t)) == "a::m"
    assert one(spark, text.unit_id(F.lit("ruby"), F.lit(""), F.lit("m"), f)) == "m"
    assert [one(spark, text.name_in(F.lit(x))) for x in ("A::B#m", "A.m", "a::m", "m")] == ["m"] * 4
    params = F.array(F.struct(F.lit("req").alias("kind"), F.lit("dueDate").alias("name")))
    assert one(spark, text.identifier_text(F.lit("Invoice"), F.lit("unpaid_for"), params)) == "Invoice unpaid for due Date"
    assert one(spark, text.source_slice(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(3))) == "b\nc"
    assert one(spark, summary.context(F.lit("ruby"), F.lit(""), F.lit("m"), f, F.lit(None).cast("string"), params)) == "name: m\ndefined on: (top level)\nkind: instance method\nparameters: dueDate (req)\n"
    assert one(spark, text.prompt(F.lit("<{context}|{source}>"), F.lit("c\n"), F.lit("s"))) in ("<c|s>", "<c\n|s>")
    assert [one(spark, text.singularize(F.lit(w))) for w in ("invoices", "entries", "boxes", "class")] == ["invoice", "entry", "box", "class"]
    assert [one(spark, text.pluralize(F.lit(w))) for w in ("invoice", "entry", "box")] == ["invoices", "entries", "boxes"]
    assert one(spark, text.table_to_class(F.lit("line_items"))) == "LineItem" and one(spark, text.camelize(F.lit("admin/line_item"))) == "Admin::LineItem"
    note = text.withheld_note("group", F.lit(3), F.create_map(F.lit("vendored"), F.lit(1), F.lit("generated"), F.lit(2)))
    assert one(spark, note) == "3 groups withheld (2 generated, 1 vendored)"


def test_hashes(spark):
    assert [hashing.fnv1a_bytes(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    rows = spark.createDataFrame([("a",), ("foobar",), ("",), (None,)], "t string").select("t", hashing.fnv1a("t").alias("h")).collect()
    assert {r.t: r.h if r.h is None else r.h % (1 << 64) for r in rows} == {"a": 0xAF63DC4C8601EC8C, "foobar": 0x85944171F73967E8, "": 0xCBF29CE484222325, None: None}
    assert one(spark, hashing.hex16(F.lit(-1))) == "f" * 16 and one(spark, hashing.hex16(F.lit(10))) == "000000000000000a"
    assert one(spark, hashing.blob_oid(F.lit(""))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert one(spark, hashing.blob_oid(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    files = spark.createDataFrame([("r", f"p{i}", f"o{i}") for i in range(50)], "root string, path string, oid string")
    key = lambda df: df.agg(hashing.map_key(F.col("path"), F.col("oid")).alias("k")).first()["k"]
    assert key(files) == key(files.orderBy(F.desc("path"))) and key(files) != key(files.where("path != 'p3'")) and key(files.limit(0)) == 0


def test_paths(spark):
    convention = lambda p: one(spark, paths.class_by_convention(F.lit(p)))
    cases = {
        "app/models/a.rb": "app", "vendor/gem/spec/a_spec.rb": "vendored", "sorbet/rbi/a.rbi": "generated", "db/schema.rb": "generated", "x/db/y/schema.rb": "generated", "a_pb.rb": "generated",
        "db/migrate/1.rb": "migration", "plugins/p/db/post_migrate/2.rb": "migration", "migrate/1.rb": "app", "spec/fixtures/a.rb": "fixture", "spec/a.rb": "test", "lib/a_test.rb": "test", "a.rb": "app",
    }
    assert {p: convention(p) for p in cases} == cases
    module = lambda p: one(spark, paths.rust_module(F.lit(p)))
    assert {p: module(p) for p in ("src/lib.rs", "src/store/mod.rs", "src/a/b.rs", "crates/x/src/y.rs", "tests/testbed/006-x/a.rs", "src/main.rs", "foo.rs", "src/bad-name.rs")} == {"src/lib.rs": None, "src/store/mod.rs": "store", "src/a/b.rs": "a::b", "crates/x/src/y.rs": "y", "tests/testbed/006-x/a.rs": "a", "src/main.rs": None, "foo.rs": "foo", "src/bad-name.rs": None}
    under = lambda p, s: one(spark, paths.under(F.lit(p), s))
    assert under("app/a", "app") and under("app", "app/") and not under("apple/a", "app") and not under("app0", "app") and under("x", ".") and under("x", None) and not under("a%b/c", "a_b")
    policy = paths.Policy.parse('[paths]\nvendored = ["lib/x"]\ntest = ["lib/x/y/"]\n')
    assert [one(spark, policy.of(F.lit(p))) for p in ("lib/x/a.rb", "lib/x/y/a.rb", "lib/z.rb")] == ["vendored", "test", "app"]
    for bad in ('[paths]\nodd = ["a"]', '[paths]\ntest = [""]', '[paths]\ntest = ["/a"]', '[paths]\ntest = ["a*"]', '[paths]\ntest = ["a"]\napp = ["a/"]', "not toml ["):
        with pytest.raises(paths.PolicyError):
            paths.Policy.parse(bad)
    assert one(spark, policy.of_unit(F.lit("src/a.rs"), F.lit("rust"), F.lit("a::singleton_tests"))) == "test"
    assert [one(spark, paths.language(F.lit(p))) for p in ("Gemfile", "a/b.rb", "x.rs", "README", ".rb", "x.py")] == ["ruby", "ruby", "rust", None, None, None]


def test_vectors(spark):
    cos = lambda a, b: one(spark, vectors.cosine(F.array(*map(F.lit, a)).cast("array<float>"), F.array(*map(F.lit, b)).cast("array<float>")))
    assert cos([1.0, 0.0], [1.0, 0.0]) == 1 and cos([1.0, 0.0], [0.0, 1.0]) == 0 and cos([0.0, 0.0], [1.0, 0.0]) == 0 and cos([], []) == 0 and cos([1.0], [1.0, 2.0]) == 0
    assert one(spark, vectors.shortened(lit(3.0, 4.0, 9.0), 2)) == [0.6, 0.8] and one(spark, vectors.shortened(lit(0.0, 0.0, 5.0), 2)) == [0, 0]
    with pytest.raises(Exception, match="fewer than 4"):
        one(spark, vectors.shortened(lit(1.0), 4))
    v = spark.createDataFrame([("unpaid invoices",), ("payroll runs",), (None,)], "t string").select(vectors.hash_embed("t").alias("v")).collect()
    assert len(v[0].v) == 384 and v[0].v != v[1].v and v[2].v is None and set(v[0].v[256:]) == {0.0}
    vectors.afford("hash", 10**6, 4)
    with pytest.raises(RuntimeError):
        vectors.afford("onnx", 10**6, 4)
    assert one(spark, vectors.mean_pool(F.array(lit(1.0, 2.0), lit(3.0, 4.0), lit(9.0, 9.0)), lit(1, 1, 0))) == [2.0, 3.0]


def test_dates(spark):
    assert [one(spark, dates.day(F.lit(x))) for x in (0, 1_351_209_600, 1_756_166_400)] == ["1970-01-01", "2012-10-26", "2025-08-26"]
    assert [one(spark, dates.span(F.lit(d * 86400))) for d in (0, 1, 45, 400, 1200)] == ["under a day", "1 day", "1 month", "1 year", "3 years"]


def units(spark, rows):
    return spark.createDataFrame(rows, "path string, line int, end_line int, lang string, owner string, id string, norm_hash string, nodes int")


def test_exact_groups(spark):
    rows = [("a.rb", 1, 9, "ruby", "A", "A#x", "h1", 60), ("b.rb", 1, 9, "ruby", "B", "B#x", "h1", 60), ("c.rb", 1, 9, "ruby", "C", "C#x", "h1", 60), ("a.rb", 20, 21, "ruby", "A", "A#s", "h2", 5), ("b.rb", 20, 21, "ruby", "B", "B#s", "h2", 5), ("d.rb", 1, 9, "ruby", "D", "D#n", "h3", None), ("spec/e.rb", 1, 9, "ruby", "E", "E#n", "h3", None), ("vendor/f.rb", 1, 9, "ruby", "F", "F#v", "h4", 7), ("vendor/g.rb", 1, 9, "ruby", "G", "G#v", "h4", 7), ("h.rb", 1, 9, "ruby", "H", "H#a", "h5", 9), ("h.rb", 1, 9, "ruby", "H", "H.a", "h5", 9)]
    found, hidden = exact.groups(units(spark, rows))
    assert [(r.norm_hash, r.copies, r.saves_nodes, r.population) for r in exact.ranked(found).collect()] == [("h1", 3, 120, "app"), ("h3", 2, 0, "mixed")]
    assert [tuple(r) for r in hidden.collect()] == [("vendored", 1)]
    assert exact.groups(units(spark, rows), min_lines=2)[0].count() == 3
    assert exact.members(units(spark, rows), found).count() == 5
    assert exact.groups(units(spark, []))[0].count() == 0


def sigs(spark, rows):
    return spark.createDataFrame(rows, "norm_hash string, subtree_hash long, nodes int, parent_hash long")


def test_near_pairs_and_node_cover(spark):
    short = [("a", 100, 20, None), ("a", 110, 9, 100), ("a", 111, 7, 100), ("a", 120, 3, 100), ("b", 101, 20, None), ("b", 110, 9, 101), ("b", 111, 7, 101), ("b", 121, 3, 101)]
    s = sigs(spark, short)
    bodies = s.select("norm_hash").distinct()
    got = near.covered(s, near.pairs(s, bodies, 0.3)).first()
    assert round(got.similarity, 3) == 0.333 and (got.shared_nodes, got.differing_nodes, round(got.node_ratio, 3)) == (16, 8, 0.667)
    nested = sigs(spark, [("a", 10, 30, None), ("a", 11, 20, 10), ("a", 12, 9, 11), ("b", 20, 30, None), ("b", 11, 20, 20), ("b", 12, 9, 11)])
    got = near.covered(nested, near.pairs(nested, bodies, 0.1)).first()
    assert (got.shared_nodes, got.differing_nodes) == (20, 20)


def test_common_shapes_make_no_candidates(spark):
    rows = [(f"{i:03d}", 7, 9, None) for i in range(66)] + [("900", 50, 9, None), ("901", 50, 9, None)]
    s = sigs(spark, rows)
    bodies = s.select("norm_hash").distinct()
    assert [(r.a, r.b) for r in near.pairs(s, bodies, 0.5).collect()] == [("900", "901")]
    r = near.stats(s, bodies).first()
    assert (r.bodies, r.shapes, r.dropped_common, r.candidates, r.exhaustive) == (68, 2, 1, 1, 68 * 67 // 2)
    assert near.neighbors(s, s.where("norm_hash = '000'").select("norm_hash"), bodies).count() == 65


def test_canonical(spark):
    rows = [
        (1, "a", 10, 0, 3, 0), (1, "b", 20, 0, 1, 0),  # age and references agree
        (2, "a", 10, 0, 1, 0), (2, "b", 20, 0, 3, 0),  # disagree
        (3, "a", 10, 1, 0, 0), (3, "b", 10, 1, 9, 1),  # silent: confirmed ties, ages tie; depth picks
        (4, "a", None, None, None, 1), (4, "b", 5, 0, 0, 1),  # nothing
    ]
    m = spark.createDataFrame(rows, "grp int, member string, age long, confirmed long, possible long, depth int")
    assert {r.grp: (r.pick, r.basis) for r in canonical.canonical(m).collect()} == {1: ("a", "agree"), 2: (None, "disagree"), 3: ("a", "weak"), 4: (None, "nothing")}
    assert {r.grp: r.margin for r in canonical.runner_up(m, "age").collect()} == {1: 10, 2: 10, 3: 0, 4: 0}
    assert [one(spark, canonical.depth(F.lit(x))) for x in ("A::B#m", "A.m", "m", "a::b::m")] == [2, 1, 0, 0]


def test_caveats(spark):
    members = spark.createDataFrame([(1, "a.rb", 1, 9, "A"), (1, "b.rb", 1, 9, "B::C"), (2, "c.rb", 1, 9, "A"), (2, "c.rb", 20, 29, "A")], "grp int, path string, line int, end_line int, owner string")
    reads = spark.createDataFrame([("a.rb", "LIMIT", "A", 5), ("b.rb", "LIMIT", "B::C", 9), ("b.rb", "X::Y", "B::C", 5), ("a.rb", "MAX", "A", 2), ("b.rb", "MAX", "B::C", 2), ("a.rb", "LIMIT", "A", 15)], "path string, name string, nesting string, at int")
    defs = spark.createDataFrame([("LIMIT", "A"), ("LIMIT", "B"), ("MAX", ""), ("LIMIT", "Bar")], "name string, parent string")
    assert [tuple(r) for r in caveat.caveats(members, reads, defs).collect()] == [(1, "LIMIT")]
    got = {(r.name, r.nesting): r.reached for r in caveat.resolved(reads.select("name", "nesting"), defs).collect()}
    assert got["LIMIT", "B::C"] == "B" and got["MAX", "A"] == "" and got["X::Y", "B::C"] is None
    assert one(spark, caveat.ancestors(F.lit("A::B"))) == ["A::B", "A", ""] and one(spark, caveat.ancestors(F.lit(""))) == [""]


GOOD = '{"summary":"s","primary_purpose":"p","secondary_concerns":[],"side_effects":["persists"],"domain":"d","patterns":[]}'


def test_summaries(spark):
    accept = lambda j: one(spark, summary.acceptable(F.lit(j)))
    assert accept(GOOD) and not accept(GOOD.replace("persists", "invents")) and not accept(GOOD.replace('"s"', '" "')) and not accept(GOOD[:-1] + ',"more":1}') and not accept(GOOD.replace(',"patterns":[]', "")) and not accept("[]") and not accept("no json")
    schema = "norm_hash string, ctx_hash string, prompt string, model string, via string, variant string, level string, json string, created_at long"
    t = spark.createDataFrame([("h", "c", "p1", "m", "api", "body", "unit", GOOD, 5), ("h", "c", "p1", "n", "mcp", "body", "unit", GOOD.replace('"s"', '"t"'), 9)], schema)
    assert '"t"' in summary.latest(t).first().json and summary.sources(t).count() == 2 and summary.bought(t, "p1", "m", "api").count() == 1
    new = spark.createDataFrame([("h", "c", "p1", "m", "api", "body", "unit", GOOD.replace('"s"', '"u"'), 6), ("h2", "c", "p1", "m", "api", "body", "unit", "bad", 6)], schema)
    after = summary.upserted(t, new)
    assert after.count() == 2 and after.where("model = 'm'").first().created_at == 6
    u = spark.createDataFrame([("h", "c", "a", 1), ("h2", "c", "b", 1), ("h2", "c", "c", 1), (None, "c", "d", 1)], "norm_hash string, ctx_hash string, path string, line int")
    assert tuple(summary.coverage(u, summary.latest(t)).first()) == (3, 1, "warming")
    assert [(r.norm_hash, r.path, r.units) for r in summary.pending(u, summary.latest(t)).collect()] == [("h2", "b", 2)]
    wanted = spark.createDataFrame([("h2", "c", "ctx", "src"), ("h3", "c", "ctx", "bad")], "norm_hash string, ctx_hash string, context string, source string")
    filled = summary.filled(wanted, lambda c, s: GOOD if s == "src" else None, prompt="p", model="f", now=7)
    assert [(r.norm_hash, r.created_at) for r in filled.collect()] == [("h2", 7)]
    assert one(spark, summary.encoded_params(summary.decoded_params(F.lit("req:a;odd:b;key:c")))) == "req:a;key:c"


def test_store(spark):
    files = spark.createDataFrame([("r", "a.rb", "o1"), ("r", "b.rb", "o1"), ("q", "src/c.rs", "o2")], "root string, path string, oid string")
    blobs = spark.createDataFrame([("o1", "ruby", "A", "m", False, "public", None, 1), ("o1", "ruby", "A", "n", True, "public", None, 5), ("o2", None, "", "f", True, "public", None, 1)], "oid string, lang string, owner string, name string, singleton boolean, visibility string, via string, line int")
    assert store.located(files, blobs).count() == 5 and {r.id for r in store.located(files, blobs, root="r").collect()} == {"A#m", "A.n"}
    checkouts = spark.createDataFrame([("r",), ("q",), ("empty",)], "root string")
    assert {tuple(r) for r in store.status(checkouts, files, blobs).collect()} == {("r", 2, 1, 4), ("q", 1, 1, 1), ("empty", 0, 0, 0)}
    assert [tuple(r) for r in store.to_parse(files, spark.createDataFrame([("o2",)], "oid string")).collect()] == [("o1", "a.rb")]
    u = spark.createDataFrame([(1, 10, "x"), (2, 10, "x"), (3, 11, "y"), (4, 12, " ")], "unit int, text_key long, text string")
    v = spark.createDataFrame([(1, 10, [1.0]), (2, 11, [2.0])], "config_key long, text_key long, vec array<float>")
    assert [r.text for r in store.missing_vectors(u, v, 1).collect()] == ["y"] and store.with_vectors(u, v, 1).where("vec is not null").count() == 2
    assert {(r.text_key, r.vec[0]) for r in store.put_vectors(v, spark.createDataFrame([(1, 10, [7.0])], v.schema)).collect()} == {(10, 7.0), (11, 2.0)}


def search_units(spark):
    rows = [(0, "a.rb", 1, ["settle", "invoice"], "P", "public", None, [1.0, 0.0], "summary"), (1, "a.rb", 9, ["other"], "P", "private", None, [0.9, 0.1], "identifier"), (2, "spec/b.rb", 1, ["settle"], "", "public", None, None, None), (3, "vendor/c.rb", 1, ["settle", "invoice"], "", "public", None, [1.0, 0.0], "summary")]
    return spark.createDataFrame(rows, "unit int, path string, line int, tokens array<string>, owner string, visibility string, via string, vec array<float>, vec_via string").withColumn("lang", F.lit("ruby"))


def test_search_fuses_and_discounts(spark):
    q = spark.createDataFrame([(1, ["settle", "invoice"], [1.0, 0.0])], "query_id int, tokens array<string>, vec array<float>")
    got = {r.unit: r for r in search.search(search_units(spark), q).collect()}
    assert set(got) == {0, 1, 2} and [got[u]["rank"] for u in (0, 1, 2)] == [1, 2, 3]
    assert got[0].how == "both" and got[1].how == "semantic" and got[2].how == "lexical"
    c = got[0].container_cosine
    assert abs(got[0].score - (1 / 61 + 1 / 61 + c * 0.7 / 61)) < 1e-9 and abs(got[2].score - 0.5 * 0.5 / 63) < 1e-9
    only = search.fused(search_units(spark).where("unit < 2"), spark.createDataFrame([(1, ["zzz"], [0.0, 1.0])], q.schema), floor=0.05).collect()
    assert {(r.unit, r.how) for r in only} == {(1, "semantic"), (0, "lexical")}
    assert search.withheld_below(search_units(spark), q, 0.995).first().withheld == 1


def test_similar_and_resolve(spark):
    u = spark.createDataFrame([(0, "a.rb", 1, "A#x", "h1", [1.0, 0.0]), (1, "a.rb", 1, "A.x", "h1", [1.0, 0.0]), (2, "b.rb", 1, "B#x", "h1", [0.0, 1.0]), (3, "c.rb", 1, "C#y", "h2", [1.0, 0.0]), (4, "d.rb", 1, "D#unpaid_for", "h3", [0.6, 0.8])], "unit int, path string, line int, id string, norm_hash string, vec array<float>")
    s = sigs(spark, [("h1", k, 5, None) for k in range(10)] + [("h2", k, 5, None) for k in range(9)] + [("h3", 99, 5, None)])
    got = [(r.tier, r.unit) for r in similar.similar(u, s, u.where("unit = 0")).orderBy("rank").collect()]
    assert got == [("structural", 2), ("near", 3), ("semantic", 4)]
    status = lambda t: tuple(similar.resolve(u, t).first())[:2]
    assert status("B#x") == ("found", 1) and status("a.rb:1") == ("found", 1) and status("Z") == ("missing", 0)
    assert [r.id for r in similar.suggestions(u, "unpaid_fro").collect()] == ["D#unpaid_for"]


def test_evaluation(spark):
    scored = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.6), (False, None), (True, None)], "is_true boolean, similarity double")
    assert tuple(evaluate.confusion(scored).first()) == (2, 1, 1, 1)
    assert {round(r.threshold, 2): (r.tp, r.fp, r.fn) for r in evaluate.sweep(scored).collect()}[0.55] == (1, 1, 2)
    d = evaluate.distribution(spark.createDataFrame([(1.005,), (2.0,)], "v double"), "v").first()
    assert d.n == 2 and d.max == 2.0 and tuple(evaluate.distribution(spark.createDataFrame([], "v double"), "v").first()) == (0, 0.0, 0.0, 0.0)
    labels = spark.createDataFrame([(1, "x"), (2, "gone"), (3, "y")], "query_id int, expected string")
    ranking = spark.createDataFrame([(1, "x", 1), (3, "y", 7)], "query_id int, id string, rank int")
    assert tuple(evaluate.labelled_rank(ranking, labels, spark.createDataFrame([("x",), ("y",)], "id string")).first()) == (1, 1, 2, 2, 1)
    sim = evaluate.similar_score(spark.createDataFrame([("p", "n", "near")], "probe string, neighbour string, tier string"), spark.createDataFrame([("p", "n", "must", "near"), ("p", "n", "must_not", "structural"), ("p", "n", "must_not", None), ("p", "o", "must_not", None)], "probe string, neighbour string, rule string, tier string"))
    assert [r.ok for r in sim.orderBy("neighbour", "rule", F.col("tier").desc_nulls_last()).collect()] == [True, True, False, True]
    assert tuple(evaluate.canonical_score(spark.createDataFrame([(1, "a"), (2, None)], "grp int, pick string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "grp int, expected string")).first()) == (1, 0, 2)


def test_within_meets_each_point_once(spark):
    """Spans over several buckets, ends included, reversed and null ones; buckets don't change the result."""
    spans = [(k, i, lo, lo + w) for k in "ab" for i, (lo, w) in enumerate([(-700, 1500), (0, 0), (255, 1), (256, 256), (5, -1)])] + [("a", 9, None, 4), (None, 9, 0, 9)]
    points = [(k, at) for k in ("a", "c", None) for at in (-700, -1, 0, 255, 256, 511, 512, 800, 801)] + [("a", 0), ("a", None)]
    want = sorted((k, i, at) for k, i, lo, hi in spans for key, at in points if k == key and None not in (k, lo, at) and lo <= at <= hi)
    s, p = spark.createDataFrame(spans, "k string, span int, lo int, hi int"), spark.createDataFrame(points, "k string, at int")
    for width in (256, 7, 100_000):
        assert sorted((r.k, r.span, r["at"]) for r in caveat.within(p, s, "k", "at", "lo", "hi", width).collect()) == want


def test_best_distractor(spark):
    scores = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.4), (1, "z", 0.6), (2, "x", 0.5), (3, "x", 0.1)], "query_id int, id string, cosine double")
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "query_id int, expected string")
    assert {r.query_id: r.best for r in evaluate.best_distractor(scores, labels).collect()} == {1: 0.6, 2: None}


def brute_near(rows, threshold, wanted=None):
    sets = {}
    for body, shape, *_ in rows:
        sets.setdefault(body, set()).add(shape)
    both = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if (a in wanted if wanted else a < b) and a != b]
    return sorted((a, b, o) for a, b, o in both if o and o / (len(sets[a]) + len(sets[b]) - o) >= threshold)


def lots(seed=5):
    """Bodies with shapes in 70 and more of them: some have nearly nothing else, some few of these."""
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        shapes = {rng.randrange(4) for _ in range(rng.choice([0, 1, 3, 8]))} | {rng.randrange(10, 60) for _ in range(rng.choice([0, 1, 2, 6]))} | {1000 + i}
        rows += [(f"{i:03d}", x, 9, None) for x in sorted(shapes)]
    return rows


@pytest.mark.parametrize("common", [2, 64])
def test_pairs_without_a_cap_match_brute_force(spark, monkeypatch, common):
    """shapes in more than 64 bodies count as shared, and find pairs that share nothing else."""
    monkeypatch.setattr(near, "COMMON", common)
    monkeypatch.setattr(postings, "PART", 150)
    for threshold in (0.25, 0.5):
        got = near.pairs(sigs(spark, lots()).repartition(3), None, threshold, None).collect()
        assert sorted((r.a, r.b, r.shared) for r in got) == brute_near(lots(), threshold)
    assert len(got) > 100


def test_neighbours_of_many_match_brute_force(spark, monkeypatch):
    """pairs of targets come in both orders; lists are packed in bins and common shapes are added."""
    monkeypatch.setattr(postings, "PART", 150)
    s, of = sigs(spark, lots(6)), {f"{i:03d}" for i in range(0, 150, 7)}
    target = spark.createDataFrame([(t,) for t in of], "norm_hash string")
    got = near.neighbors(s, target, None, 0.25).collect()
    assert sorted((r.target, r.norm_hash, r.shared) for r in got) == brute_near(lots(6), 0.25, of)


def test_shapes_are_shuffled_once_and_packed(spark):
    """F4, F5, F7, F8: one exchange of packed shapes, no row for a shape in it."""
    sets = spark.createDataFrame([(f"{i:016x}", [i, 7, 8]) for i in range(5)], "norm_hash string, shapes array<long>")
    lists = postings.lists(near.keyed(sets, True), 15, 64)
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.count("MapInArrow") == 2 and "Generate" not in plan
    assert near.stats_of_sets(sets, 15, sets, hexed=True).first()[:4] == (5, 7, 0, 10)
    assert sorted(near.pairs_of_sets(sets, 15, 0.4, hexed=True).select("a", "shared").distinct().collect())[0] == (f"{0:016x}", 2)
