"""Language identification, and fill-in-middle."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_rows import pairs
from wattframe.llm import infill, language
from wattframe.llm.rank_index import RankIndex, text_bytes, token_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab \t\n\x0b\x0c\r\x1c\x85\xa0é")), max_size=40), max_size=5)


# fill-in-middle


def brute_infill(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_tokens_end_where_the_pattern_says(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    ends, counts = token_ends(data, offsets)
    units = [UNIT.findall(t) for t in texts]
    assert counts.tolist() == [len(u) for u in units]
    flat = [len(u.encode()) for found in units for u in found]
    assert ends.tolist() == np.cumsum(flat, dtype=np.int64).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=900), st.sampled_from([0, 3, 60]))
def test_every_rank_is_located_exactly(steps, error):
    offsets = np.concatenate(([0], np.cumsum(np.array(steps, np.int64)))).astype(np.int64)
    index = RankIndex.fit(offsets, error)
    assert [index.locate(r) for r in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.residuals).max(initial=0) <= error + 1


def test_even_tokens_need_one_segment_and_a_very_long_word_one_more():
    even = np.arange(0, 70_000, 7)
    assert len(RankIndex.fit(even).ranks) == 1
    assert len(RankIndex.fit(np.concatenate((even, even + 10_000_000))).ranks) <= 3


def test_infill_is_what_the_pattern_gives(spark, odd_docs, small):
    more = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    marks = spark.createDataFrame([(i, t) for i in range(900, 940) for t in ("a <P> b", "x<S", "<", "<<S\t<M b  ", " \n ")], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    want = Counter((i, *brute_infill(i, t), t or "") for i, t in pairs(docs))
    got = infill.fill_in_middle(docs).select("*", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter((r.doc.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert {r.doc.output for r in infill.fill_in_middle(odd_docs.withColumn("output", F.lit("mine"))).collect()} == {"mine"}


def test_infill_of_nothing(empty_docs):
    assert infill.fill_in_middle(empty_docs).count() == 0


# language


def brute_tree(texts):
    """For each context the counts of the bytes after it."""
    counts = defaultdict(Counter)
    for text in texts:
        data = text.encode()
        for i, byte in enumerate(data):
            for size in range(min(i, language.ORDER) + 1):
                counts[data[i - size : i]][byte] += 1
    return counts


def brute_bits(counts, text):
    data, bits = text.encode(), 0.0
    for i, byte in enumerate(data):
        out = set()
        for size in range(min(i, language.ORDER), -1, -1):
            known = counts.get(data[i - size : i], {})
            left = {b: n for b, n in known.items() if b not in out}
            total = sum(left.values()) + len(left)
            if byte in left:
                bits += math.log2(total / left[byte])
                break
            if left:
                bits += math.log2(total / len(left))
            out |= set(known)
        else:
            bits += math.log2(256 - len(out))
    return bits


LEARN = [("en", "the cat and the dog "), ("en", "this is the thing\n"), ("fr", "le chat et la souris é"), ("fr", "les rues où ça va"), ("x", "")]


def learned(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(rows)], "doc_id long, text string, lang string")
    return language.fit(docs, lambda key: F.lit(True), **more)


def test_code_lengths_are_those_of_the_definition(spark):
    trees = learned(spark, LEARN)
    assert sorted(trees) == ["en", "fr"]
    texts = ["the chat", "", "zzz", "ça é 😀", "and and and thething", "q"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc.doc_id: r for r in language.identify(docs, trees).collect()}
    for i, text in enumerate(texts):
        bits = {c: brute_bits(brute_tree([t for k, t in LEARN if k == c]), text) for c in ("en", "fr")}
        best = min(bits, key=lambda c: (bits[c], c))
        size = len(text.encode())
        assert rows[i].bits_per_byte == pytest.approx(bits[best] / size if size else 0.0)
        if text:
            assert rows[i].lang_pred == best
            assert rows[i].score == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()))


def test_exact_code_lengths_make_a_probability(spark):
    tree = learned(spark, LEARN)["en"]
    for context in (b"", b"t", b"th", b" the", b"qqqq"):
        key = int.from_bytes(context, "big") << 8
        grams = np.arange(256, dtype=np.uint64) + np.uint64(key)
        bits = tree.code_lengths(np.full(256, len(context)), grams)
        assert np.exp2(-bits).sum() == pytest.approx(1.0)


def test_windows_do_not_change_code_lengths(spark, monkeypatch):
    trees = learned(spark, LEARN)
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3], "text": ["the cat é" * 30, "", "où le chat"], "lettered": [True, False, True]})
    shared = type("Shared", (), {"value": trees})
    whole = next(language._score(shared, sorted(trees))(iter([batch])))
    monkeypatch.setattr(language, "_WINDOW", 7)
    for name in ("lang_pred", "score", "bits_per_byte"):
        part = next(language._score(shared, sorted(trees))(iter([batch])))
        assert part.column(name).to_pylist() == pytest.approx(whole.column(name).to_pylist()) if name != "lang_pred" else part.column(name) == whole.column(name)


def test_least_frequent_nodes_go_first_and_trees_stay_nested(spark):
    tree = learned(spark, [("en", "the cat and the dog and the thing " * 5)], nodes=40)["en"]
    assert sum(map(len, tree.grams)) <= 40 + 256
    for k in range(1, language.ORDER + 1):
        assert np.isin(tree.grams[k] & np.uint64((1 << 8 * k) - 1), tree.grams[k - 1]).all()


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language.fit(docs, lambda key: ~language.held_out(key))
    found = language.identify(docs, trees).where(language.held_out(F.col("doc.doc_id"))).collect()
    assert len(found) > 200
    assert sum(r.lang_pred == r.doc.lang for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("source", F.lit("s")).withColumn("lang", F.when(language.held_out(F.col("doc_id")), "en").otherwise(F.col("lang")))
    rows = []
    for some in (docs, other):
        trees = language.fit(some, lambda key: ~language.held_out(key))
        rows.append(sorted((r.doc.doc_id, r.lang_pred, r.score) for r in language.identify(some, trees).collect()))
    assert rows[0] == rows[1]
    held = {i for i, *_ in rows[0] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert held == {r.doc_id for r in docs.where(language.held_out(F.col("doc_id"))).collect()}


def test_odd_rows_have_a_language(spark, odd_docs, empty_docs):
    trees = learned(spark, LEARN)
    rows = language.identify(odd_docs, trees).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r.doc.text or "")
        assert (r.lang_pred in trees) == lettered and (r.lang_pred == "und") == (not lettered)
        assert r.doc.score == "?"
    assert language.identify(empty_docs, trees).count() == 0
    assert language.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), lambda key: F.lit(True)) == {}
    assert {(r.lang_pred, r.score) for r in language.identify(odd_docs, {}).collect()} == {("und", 0.0)}
    assert not [r for r in odd_docs.select(language.held_out(F.col("doc_id")).alias("h")).collect() if r.h is None]
