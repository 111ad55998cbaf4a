"""Ruby sources: units, hashes, signatures, constants read; and duplicates found from files to report."""

from pyspark.sql import functions as F

from tesserae.operators import exact, near, store
from tesserae.sources import ingest
from tesserae.sources.extract import ruby


def ids(src):
    return [u["name"] if not u["owner"] else u["owner"] + (".", "#")[not u["singleton"]] + u["name"] for u in ruby.units(src)[0]]


def visible(src):
    return {u["name"]: u["visibility"] for u in ruby.units(src)[0]}


def test_containers_and_singletons():
    src = "module A\n  module B\n    def run; end\n  end\nend\nclass A::C < Base\n  def self.find(id) = id\n  class << self\n    def build; end\n  end\nend\nmodule D\n  module_function\n  def helper; end\nend\ndef top; end\n"
    assert ids(src) == ["A::B#run", "A::C.find", "A::C.build", "D.helper", "D#helper", "top"] and ruby.units(src)[3] == 0


def test_visibility():
    v = visible("class A\n  def a; end\n  private\n  def b; end\n  public def c; end\n  def self.d; end\n  protected\n  def e; end\n  def initialize; end\nend")
    assert v == {"a": "public", "b": "private", "c": "public", "d": "public", "e": "protected", "initialize": "private"}
    units = ruby.units("class A\n  def x; end\n  private :x\nend")[0]
    assert [(u["via"], u["visibility"], u["norm_hash"] is None) for u in units] == [(None, "public", False), ("private", "private", True)]


def test_macros():
    src = "class A\n  NAMES = %i[p q].freeze\n  attr_accessor :x\n  attr_reader *NAMES\n  delegate :price, :cost, to: :vendor, prefix: true\n  alias old new\n  alias_method :b, :a\n  scope :recent, -> { where(x: 1) }\n  has_many :entries\n  enum status: { open: 0, closed: 1 }\n  [:one, :two].each do |n|\n    define_method(\"#{n}_step\") { 1 }\n  end\n  define_method(:plain) { 1 }\n  class_methods do\n    def cm; end\n  end\n  concerning :Billing do\n    def bill; end\n  end\nend\n"
    got = ids(src)
    assert {"A#x", "A#x=", "A#p", "A#q", "A#vendor_price", "A#vendor_cost", "A#old", "A#b", "A.recent", "A#entries", "A#entry_ids", "A.statuses", "A#open?", "A#open!", "A.open", "A#closed?", "A#one_step", "A#two_step", "A::ClassMethods#cm", "A::Billing#bill"} <= set(got)
    assert "A#plain" not in got and ruby.units(src)[3] == 0
    schema = 'create_table "line_items", force: true do |t|\n  t.string :name, :code\n  t.references :order\n  t.timestamps\nend\n'
    assert {"LineItem#name", "LineItem#code=", "LineItem#order_id?", "LineItem#order", "LineItem#created_at", "LineItem#updated_at"} <= set(ids(schema))


def test_params():
    u = ruby.units("def f(a, b = 1, *c, d, e:, g: 2, **h, &i); end")[0][0]
    assert [(p["kind"], p["name"]) for p in u["params"]] == [("req", "a"), ("opt", "b"), ("rest", "c"), ("post", "d"), ("keyreq", "e"), ("key", "g"), ("keyrest", "h"), ("block", "i")]


def test_structure_is_what_hashes():
    h = lambda s: ruby.units(s)[0][0]["norm_hash"]
    a = "def a(rows)\n  label = \"total\"\n  rows.map { |row| format(label, row, 1000) }\nend"
    assert h(a) == h("def b(items)\n  # note\n  l = 'total'\n  items.map { |i|\n    format(\n      l,\n      i,\n      1_000,\n    )\n  }\nend")
    assert len({h(a), h(a.replace("total", "sub")), h(a.replace("label, row", "row, label")), h(a.replace("format", "printf"))}) == 4
    assert h("def a; super; end") != h("def b; super; end") and h("def a(x:); x; end") != h("def a(y:); y; end")
    assert h("def a\n  <<~T\n    x #{y}\n  T\nend") == h('def a\n  "x #{y}\\n"\nend')


ODD = '''
class A
  def a(x) = x ? x[:k] : {b: 1, "c": 2}
  def b; return if x; y = z if w && !v; x ||= 1; a, *b = c; @d += 1; end
  def c
    foo.bar(1, *a, k: 2, **o, &blk).baz do |x, (y, z), k: 1|
      next unless x =~ /a\\/b#{c}/i
    end
    case x when 1, 2 then :a else :b end
    begin; risky; rescue Foo, Bar => e; raise; ensure done; end
    puts -1, [1, 2].first, ->(q) { q + 1 }.call(2), %w[a b], "a#{"b#{1}"}", ?x, 5 / 2, :"sym bol"
    while i < 10 do i += 1 end
    x.y &.z
    foo bar do |q| q end
    if a then b elsif c then d else e end
    raise ArgumentError, "x" unless y.is_a? Z
    h = { "a" => 1, b: 2, c => 3, **d }
    yield(1) if block_given?
    super
  end
  def ==(o); end
  def [](i) = i
  def x=(v); @x = v; end
  def -@; end
end
'''


def test_usual_constructs_are_understood():
    units, _, _, errors = ruby.units(ODD)
    assert [u["name"] for u in units] == ["a", "b", "c", "==", "[]", "x=", "-@"] or [u["name"] for u in units] == ["a", "b", "c", "==", "[]", "x=", "-"]
    assert errors == 0
    assert ruby.units("class A\n  def a; ) end\n  def b; end\nend")[3] > 0 and ruby.units("")[0] == []
    assert ruby.units("(" * 5000)[3] > 0


def test_const_reads():
    got = {(r["name"], r["nesting"]) for r in ruby.const_reads("class A\n  def m\n    LIMIT + B::C\n  end\nend")}
    assert {("LIMIT", "A"), ("B::C", "A"), ("B", "A")} <= got


def test_from_files_to_duplicates(spark, tmp_path):
    body = "    checked = record.validate(:all, 3).first(2)\n    persist(checked.map { |c| c.name + c.size })\n    audit(checked, checked.sum { |c| c.size * 2 }, 1)\n    checked.sort.reverse.first\n"
    (tmp_path / "app").mkdir()
    (tmp_path / "app/a.rb").write_text(f"class A\n  def save(record)\n{body}  end\nend\n")
    (tmp_path / "app/b.rb").write_text(f"class B\n  def store(item)\n{body.replace('record', 'item').replace('checked', 'ok')}  end\nend\n")
    (tmp_path / "app/c.rb").write_text(f"class C\n  def save(record)\n    log(:x, 2)\n{body}  end\nend\n")
    files = ingest.read_tree(spark, str(tmp_path))
    units, _ = ingest.ingest(files, spark.createDataFrame([], "oid string"))
    located = store.located(files.select("root", "path", "oid"), units)
    found, _ = exact.groups(located)
    assert [(r.copies, r.path, r.population) for r in found.collect()] == [(2, "app/a.rb", "app")]
    sig = ingest.signatures(files)
    pairs = near.covered(sig, near.pairs(sig, located.select("norm_hash").distinct(), 0.3)).collect()
    assert len(pairs) == 1 and pairs[0].shared_nodes > 0 and 0 < pairs[0].node_ratio < 1
    assert ingest.const_reads(files).where(F.col("name") == "A").count() == 0
    assert [u["name"] for u in ingest.outline("x/Rakefile", "def t; end")] == ["t"]
