"""String expressions: tokens, humanised names, lexical scores, rendered texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it per array element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def humanize(name: Column) -> Column:
    """A name as words: other characters become single spaces, and case changes break words."""
    spaced = F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(spaced, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=[\p{L}\p{N}])(?=\p{Lu}\p{Ll})", " "))


def unit_id(lang: Column, owner: Column, name: Column, singleton: Column) -> Column:
    """How a unit is called: its name, after its owner and a mark that depends on the language."""
    mark = F.when(lang == "rust", "::").when(singleton, ".").otherwise("#")
    return F.when(F.coalesce(owner, F.lit("")) == "", name).otherwise(F.concat(owner, mark, name))


def name_in(unit: Column) -> Column:
    """The last part of a unit's id."""
    return F.regexp_extract(unit, r"([^#.:]*)$", 1)


def identifier_text(owner: Column, name: Column, params: Column) -> Column:
    """What a unit without a summary is embedded as: owner, name and parameter names as words."""
    parts = F.concat(F.array(humanize(owner), humanize(name)), F.transform(params, lambda p: humanize(p["name"])))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def summary_text(s: Column) -> Column:
    """What a summarised unit is embedded as."""
    also = F.when(F.size(s["secondary_concerns"]) > 0, F.concat(F.lit(". also "), F.array_join(s["secondary_concerns"], ", "))).otherwise("")
    return F.concat(s["summary"], F.lit(". "), s["primary_purpose"], also, F.lit(". domain: "), s["domain"])


def text_of(summary: Column, identifier: Column) -> Column:
    """(text, via): the summary's text where there is one, else the identifier's; null if blank."""
    best = F.when(summary.isNotNull(), F.struct(summary_text(summary).alias("text"), F.lit("summary").alias("via"))).otherwise(F.struct(identifier.alias("text"), F.lit("identifier").alias("via")))
    return F.when(F.trim(best["text"]) != "", best)


def lexical_score(query: Column, name: Column, min_prefix: int = 2) -> Column:
    """How well the tokens of a query are found among those of a name, from 0 to 1.

    Each query token counts 1 if the name has it, 0.5 if it is longer than `min_prefix` and
    begins a token of the name, else 0; the mean over the query's tokens, repeats included.
    Both arguments are token arrays; either empty gives 0.
    """
    one = lambda q: F.when(F.array_contains(name, q), 1.0).when((F.char_length(q) > min_prefix) & F.exists(name, lambda t: F.startswith(t, q)), 0.5).otherwise(0.0)
    total = F.aggregate(query, F.lit(0.0), lambda acc, q: acc + one(q))
    return F.when((F.size(query) > 0) & (F.size(name) > 0), total / F.size(query)).otherwise(0.0)


def source_slice(text: Column, line: Column, end_line: Column) -> Column:
    """Lines `line` to `end_line` of a text, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), line, end_line - line + 1), "\n")


def prompt(template: Column, context: Column, source: Column) -> Column:
    """A template with its two places filled in."""
    return F.replace(F.replace(template, F.lit("{context}"), F.rtrim(context)), F.lit("{source}"), source)


def round2(x: Column) -> Column:
    """Two decimals, halves up; the same in every engine, unlike round()."""
    return F.floor(x * 100 + 0.5) / 100


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading characters that two strings share."""
    n = F.least(F.char_length(a), F.char_length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.left(a, i) == F.left(b, i)))).otherwise(0)


def withheld_note(noun: str, total: Column, by_class: Column) -> Column:
    """What was withheld, as a sentence; null for nothing."""
    parts = F.array_join(F.transform(F.array_sort(F.map_entries(by_class)), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"])), ", ")
    return F.when(total > 0, F.concat(total.cast("string"), F.lit(f" {noun}"), F.when(total == 1, "").otherwise("s"), F.lit(" withheld ("), parts, F.lit(")")))


def about(seconds: Column) -> Column:
    """A duration in seconds below two minutes, else in minutes."""
    return F.when(seconds < 120, F.concat(F.ceil(seconds).cast("string"), F.lit(" s"))).otherwise(F.concat(F.ceil(seconds / 60).cast("string"), F.lit(" min")))


def pluralize(word: Column) -> Column:
    """The regular English plural."""
    return (
        F.when(word.rlike(r"(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .when(word.rlike(r"[^aeiou]y$"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def singularize(word: Column) -> Column:
    """The regular English singular."""
    return (
        F.when(word.rlike(r"ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike(r"(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike(r"[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def camelize(name: Column) -> Column:
    """snake_case, with slashes as namespaces, in CamelCase."""
    part = lambda p: F.array_join(F.transform(F.split(p, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.char_length(w)))), "")
    return F.array_join(F.transform(F.split(name, "/"), part), "::")


def table_to_class(table: Column) -> Column:
    return camelize(singularize(table))
