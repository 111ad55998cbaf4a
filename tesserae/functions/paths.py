"""Paths: languages, scopes, classes and the modules that files imply."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File names and extensions of each language, the classes and the directories that tell them.
RUBY_NAMES = ("Gemfile", "Rakefile", "Guardfile", "Capfile", "Podfile", "Brewfile")
EXTENSIONS = {"ruby": ("rb", "rake", "gemspec", "ru", "jbuilder", "rbi"), "rust": ("rs",)}
CLASSES = ("app", "test", "fixture", "migration", "generated", "vendored")
UNREPORTED = ("migration", "generated", "vendored")
VENDORED_DIRS = ("vendor", "node_modules", "third_party", "target", ".bundle")
FIXTURE_DIRS = ("fixtures", "fixture", "testbed", "corpus")
TEST_DIRS = ("spec", "test", "tests")
MODULE_ROOTS = ("src", "tests", "benches", "examples")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def language(path: Column) -> Column:
    """The language of a file by its name; null if it is none that is read."""
    name, ext = file_name(path), F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)
    return F.when(name.isin(*RUBY_NAMES) | ext.isin(*EXTENSIONS["ruby"]), "ruby").when(ext.isin(*EXTENSIONS["rust"]), "rust")


def under(path: Column, prefix: str | None) -> Column:
    """Whether a path is the prefix or below it.

    Written as a range, so that both bounds reach the file scan: '0' is the character after '/'.
    """
    p = (prefix or "").rstrip("/")
    if p in ("", "."):
        return F.lit(True)
    return (path >= p) & (path < p + "0") & ((path == p) | (path >= p + "/"))


def class_by_convention(path: Column) -> Column:
    """The class of a path by the usual names of directories and files; the first rule that fits."""
    file, dirs = file_name(path), directories(path)
    any_of = lambda names: F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    below_db = F.exists(F.arrays_zip(dirs.alias("a"), F.slice(dirs, 2, F.greatest(F.size(dirs), F.lit(1))).alias("b")), lambda p: F.coalesce((p["a"] == "db") & p["b"].contains("migrat"), F.lit(False)))
    return (
        F.when(any_of(VENDORED_DIRS), "vendored")
        .when(any_of(("sorbet",)) | ((file == "schema.rb") & any_of(("db",))) | file.endswith("_pb.rb"), "generated")
        .when(below_db, "migration")
        .when(any_of(FIXTURE_DIRS), "fixture")
        .when(any_of(TEST_DIRS) | file.endswith("_spec.rb") | file.endswith("_test.rb"), "test")
        .otherwise("app")
    )


def in_test_module(owner: Column) -> Column:
    return F.exists(F.split(F.coalesce(owner, F.lit("")), "::"), lambda s: s.isin("test", "tests") | s.endswith("_test") | s.endswith("_tests"))


class PolicyError(ValueError):
    """A path policy that can't be meant as written."""


@dataclass(frozen=True)
class Policy:
    """Which class paths have, and which classes are reported."""

    prefixes: dict[str, str] = field(default_factory=dict)
    include_ignored: bool = False

    @classmethod
    def parse(cls, text: str, include_ignored: bool = False) -> Policy:
        """Read a TOML table [paths] of class = [prefixes]."""
        try:
            paths = tomllib.loads(text).get("paths", {})
        except tomllib.TOMLDecodeError as e:
            raise PolicyError(str(e)) from e
        out: dict[str, str] = {}
        for name, prefixes in paths.items():
            if name not in CLASSES:
                raise PolicyError(f"unknown class {name!r}; there are {', '.join(CLASSES)}")
            for raw in prefixes:
                p = raw.rstrip("/")
                if not p or p.startswith("/") or any(c in p for c in "*?["):
                    raise PolicyError(f"{raw!r} must be a plain prefix, relative to the root")
                if out.get(p, name) != name:
                    raise PolicyError(f"{p!r} has two classes")
                out[p] = name
        return cls(out, include_ignored)

    def of(self, path: Column) -> Column:
        """The class of a path: the longest prefix that fits, else by convention."""
        out = class_by_convention(path)
        for p, name in sorted(self.prefixes.items(), key=lambda kv: (len(kv[0]), [-ord(c) for c in kv[0]])):
            out = F.when(under(path, p), name).otherwise(out)
        return out

    def of_unit(self, path: Column, lang: Column, owner: Column) -> Column:
        """As `of`, but app code in a test module of its file is test code."""
        c = self.of(path)
        return F.when((c == "app") & (lang == "rust") & in_test_module(owner), "test").otherwise(c)

    def reported(self, name: Column) -> Column:
        return F.lit(True) if self.include_ignored else ~name.isin(*UNREPORTED)


def withheld(rows: DataFrame, policy: Policy, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows that are reported, how many of each class are not)."""
    named = rows.withColumn("class", policy.of(F.col(path)))
    return named.where(policy.reported(F.col("class"))), named.where(~policy.reported(F.col("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def by_class_map(counts: DataFrame) -> DataFrame:
    """One row (total, by_class) from (class, n); there are at most six classes."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("by_class"))


def merge_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def rust_module(path: Column) -> Column:
    """The module that a file is, from its path; null if it names none."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    root = F.array_position(F.reverse(F.transform(parts, lambda s: s.isin(*MODULE_ROOTS))), True)  # from the end, 0 if none
    after = F.when(root > 0, F.slice(parts, F.size(parts) - root.cast("int") + 2, F.greatest(root.cast("int") - 1, F.lit(0)))).otherwise(F.slice(parts, F.greatest(F.size(parts), F.lit(1)), 1))
    good = lambda s: s.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")
    last = F.regexp_replace(F.element_at(after, -1), r"\.rs$", "")
    parents = F.reverse(F.slice(after, 1, F.size(after) - 1))
    bad = F.array_position(F.transform(parents, lambda s: good(s)), False).cast("int")
    trail = F.reverse(F.when(bad > 0, F.slice(parents, 1, bad - 1)).otherwise(parents))
    plain = last.isin("mod", "lib", "main")
    module = F.when(plain, trail).when(good(last), F.concat(trail, F.array(last)))
    return F.when((F.size(parts) > 0) & (F.size(after) > 0) & (F.size(module) > 0), F.array_join(module, "::"))


def qualified_owner(lang: Column, path: Column, owner: Column) -> Column:
    """A Rust owner within the module of its file."""
    both = F.array_join(F.filter(F.array(rust_module(path), owner), lambda x: x.isNotNull() & (x != "")), "::")
    return F.when(lang == "rust", both).otherwise(owner)


def pretty(root: Column, path: Column, home: str) -> Column:
    """root/path with the home directory as ~."""
    whole = F.concat(root, F.lit("/"), path)
    return F.when(whole.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(whole, F.lit(len(home.rstrip("/")) + 1), F.char_length(whole)))).otherwise(whole)
