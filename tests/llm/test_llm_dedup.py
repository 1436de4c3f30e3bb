import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_rows import pairs
from wattframe.llm import exact_dedup, repeats, simhash
from wattframe.llm.components import connected_components
from wattframe.llm.line_templates import drop_recurring_lines
from wattframe.llm.scratch import Scratch


def sha(b):
    return hashlib.sha256(b).hexdigest()


# exact de-duplication


@pytest.mark.parametrize("block_bytes", [4096, 7])
def test_exact_dedup_against_groups(spark, odd_docs, small, block_bytes):
    docs = odd_docs.where(F.length("text") < 1000).select("doc_id", "text", "id", "row", "name")
    more = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 100, F.substring("text", 1, 60))
    more = more.toDF("doc_id", "text")
    docs = docs.unionByName(odd_docs.where("text is null").select(docs.columns)).unionByName(more, allowMissingColumns=True)
    groups = defaultdict(list)
    for i, t in pairs(docs):
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), sha(t.encode())) for i in ids)
    rows = exact_dedup.exact_dedup(docs, block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_tells_texts_apart_that_differ_late(spark):
    texts = ["a" * 50_000 + x for x in ("b", "c", "b", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert rows == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1)}


def test_exact_dedup_of_nothing_and_without_python(spark, empty_docs, odd_docs):
    assert exact_dedup.exact_dedup(empty_docs).count() == 0
    plan = exact_dedup.exact_dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_other_seed_when_hashes_collide(spark, monkeypatch):
    plain = exact_dedup._hashes
    weak = lambda block, seed: plain(F.lit(1) if seed == 0 else block, seed)
    monkeypatch.setattr(exact_dedup, "_hashes", weak)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {1: 3, 2: 2, 3: 3}


# SimHash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = Counter(xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles)
    n = sum(hashes.values())
    return sum(1 << b for b in range(64) if 2 * sum(k for h, k in hashes.items() if h >> b & 1) > n)


def brute_components(ids, prints, bits=3):
    values = np.unique(np.array(prints, np.uint64))
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits) + i + 1:
            root[find(int(j))] = find(i)
    at = {int(v): find(i) for i, v in enumerate(values)}
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[at[p]] = min(i, least.get(at[p], i))
    return [least.get(at[p]) for p in prints]


@pytest.mark.parametrize("crowded", [4096, 2])
def test_simhash_against_brute_force(spark, odd_docs, small, crowded):
    more = spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    near = more.limit(40).select(F.col("doc_id") + 1000, F.concat("text", F.lit(" one more")))
    docs = odd_docs.select("doc_id", "text", "id", "name").unionByName(
        more.unionByName(near.toDF("doc_id", "text")), allowMissingColumns=True
    )
    rows = pairs(docs)
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components([i for i, _ in rows], prints)
    want = Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, roots))
    got = simhash.simhash_dedup(docs, crowded=crowded).collect()
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("crowded", [4096, 8])
def test_trie_join_finds_every_link(spark, crowded):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64) * np.uint64(2)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    scratch = Scratch(spark, "test")
    edges = simhash.links(df, 3, scratch, crowded)
    got = {r.node: r.root for r in connected_components(scratch.keep(edges), scratch).collect()}
    label = brute_components(values, values)
    classes = defaultdict(set)
    for v, s, c in zip(values, signed, label):
        classes[c].add(got.get(int(s), int(s)))
    assert all(len(x) == 1 for x in classes.values()) and len({next(iter(x)) for x in classes.values()}) == len(classes)


def test_simhash_of_nothing(empty_docs):
    assert simhash.simhash_dedup(empty_docs).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 2000 + i) for i in range(100)] + [(5000, 5000)]
    scratch = Scratch(spark, "test")
    edges = spark.createDataFrame(chain + star, "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, scratch).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {2000 + i: 1000 for i in range(100)}


# repeated strings


def brute_repeats(bodies, length):
    seen = Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("frequent", [100_000, 2])
def test_repeats_against_brute_force(spark, odd_docs, small, frequent):
    rng = np.random.default_rng(5)
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()]
    passage = max(texts, key=len)[:400]
    texts = [t[:1500] for t in texts]
    texts += ["a" * 199, "a" * 200, "a" * 201, "ab" * 300, "é" * 150, passage, "x" + passage[50:] + "y"]
    texts += [f"{i} " * int(rng.integers(1, 9)) + passage + f" {i * 7}" for i in range(30)]
    for i in range(30):
        t = texts[rng.integers(60)]
        a = int(rng.integers(0, max(1, len(t) - 250)))
        texts.append(f"z{i}" + t[a : a + int(rng.integers(150, 500))] + f"q{i}")
    docs = odd_docs.where("coalesce(length(text), 0) < 1000").select("doc_id", "text", "id", "body", "h1")
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).repartition(4, "doc_id")
    rows = pairs(docs)
    want = Counter((i, *w) for (i, _), w in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 200)))
    got = Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(docs, frequent=frequent).collect())
    assert got == want


def test_repeats_in_long_texts_and_nothing(spark, odd_docs, empty_docs):
    rows = {r.doc_id: r for r in repeats.remove_repeats(odd_docs.where("doc_id > 3")).collect()}
    assert rows[6].n_removed == rows[6].n_bytes == 360_000 and rows[6].n_spans == 1
    assert rows[7].n_removed == 100_000 and rows[4].n_removed == 0 and rows[8].n_spans == 0
    assert repeats.remove_repeats(empty_docs).count() == 0


def test_multikey_sort_against_python():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 24, dtype=np.uint8)) for _ in range(300)] + [b"a" * 24] * 5
    words = np.frombuffer(b"".join(texts), ">u8").astype(np.uint64).reshape(-1, 3)
    order, common = repeats.multikey_sort(words)
    ordered = [texts[i] for i in order]
    assert ordered == sorted(texts)
    for a, b, n in zip(ordered, ordered[1:], common[1:]):
        assert n == next((i for i in range(24) if a[i] != b[i]), 24)


# line templates


def test_recurring_templates_go_and_prose_stays(spark):
    rows = [
        (i, f"{w * 3} wrote this line alone\nVisit page {i} of our site now\nWe all love topic {w} so much today\n\nok")
        for i, w in enumerate("abcdef")
    ]
    rows += [(9, "An own line here\nVisit page 99 of our site now"), (None, None), (10, ""), (11, "Visit page 5 of my site now")]
    rows += [(20 + i, "copied line that stands in copies alone") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in drop_recurring_lines(docs, min_texts=5).collect()}
    # a number and a word vary, so both lines follow recurring templates
    assert got[0].text == "aaa wrote this line alone\n\nok" and (got[0].n_lines, got[0].n_dropped) == (5, 2)
    assert got[9].text == "An own line here" and got[20].n_dropped == 0
    assert got[None].text == "" and got[10].n_lines == 1
    assert got[11].text == "Visit page 5 of my site now"


def test_line_templates_on_odd_rows(odd_docs, empty_docs):
    rows = drop_recurring_lines(odd_docs)
    assert rows.count() == odd_docs.count() and drop_recurring_lines(empty_docs).count() == 0
    assert not re.search("Python|Arrow|Pandas", rows._jdf.queryExecution().executedPlan().toString())
