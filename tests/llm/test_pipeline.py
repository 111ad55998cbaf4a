import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    rows = {n: None for n, _ in cp.STAGES}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        after = {r.doc_id: r for r in docs.collect()}
        rows[name] = after
        if name != "tokens":
            assert docs.columns == cols
        if name == "language_id":
            assert set(after) <= set(before) and len(after) > 0.9 * len(before)
        elif name == "near_duplicates":
            sets, root = {i: shingles(r.text) for i, r in before.items()}, {i: i for i in before}

            def find(i):
                while root[i] != i:  # noqa: B023
                    i = root[i]  # noqa: B023
                return i

            ids = sorted(before)
            for x, i in enumerate(ids):
                for j in ids[:x]:
                    a, b = sets[i], sets[j]
                    if a and b and 100 * len(a & b) >= 80 * len(a | b):
                        p, q = sorted((find(i), find(j)))
                        root[q] = p
            assert set(after) == {i for i in ids if find(i) == i}
        elif name == "repeated_passages":
            seen = set()
            assert set(after) == set(before)
            for i in sorted(before):
                b = (before[i].text or "").encode()
                gone = bytearray(len(b))
                for k in range(len(b) - 99):
                    w = b[k : k + 100]
                    if w in seen:
                        gone[k : k + 100] = b"\1" * 100
                    seen.add(w)
                want = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
                assert after[i].text == want and after[i].n_chars == len(want)
        elif name == "decontamination":
            items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in r.text.lower() for r in after.values() for t in items)
            lost = set(before) - set(after)
            assert all(any(len(shingles(t) & shingles(before[i].text.lower())) >= 3 for t in items) for i in lost)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for i, r in after.items():
                ids = library.encode(before[i].text, add_special_tokens=False).ids
                assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids)
                assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, gone string, score double"
    base = "the and of this is that with for was are not from have been which their would there could about "
    rows = [(1, base * 10, "en", "a", 1, "x", 1.0), (2, base * 10, None, None, None, None, None), (2, base * 10, "en", "a", 1, "x", 1.0), (3, None, None, None, 0, None, None), (4, "", "en", "a", 0, "x", 1.0), (None, base + "one more", "en", "a", 1, "x", 1.0), (5, "word " * 50_000, "en", "a", 1, "x", 1.0)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = df
        for name, stage in cp.STAGES:
            path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "tokens" or docs.columns == df.columns
        got = docs.collect()
        assert len(got) <= len(rows)


def test_rows_are_judged_as_rows(spark):
    """Near copies, contaminated texts and repeated rows, some without an id: which rows stay."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    words = [f"w{i * 7919 % 1000}" for i in range(120)]
    base, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(1, base), (2, near), (None, near), (4, f"before {item} behind"), (None, f"before {item} behind them"), (None, "a text of its own, without an id"), (6, "one more"), (6, "one more"), (6, "two texts under one id")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, keeper int")
    alike = cp.near_duplicates(spark, docs, SF).drop("keeper")
    assert sorted(map(str, (tuple(r) for r in alike.collect()))) == sorted(map(str, [(1, base), *rows[3:4], rows[5], rows[6], rows[8]]))
    clean = cp.decontamination(spark, docs, SF).drop("keeper")
    assert sorted(map(str, (tuple(r) for r in clean.collect()))) == sorted(map(str, [*rows[:3], *rows[5:]]))
