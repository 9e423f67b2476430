"""MinHash near-duplicates, importance resampling and lexical search against brute force, and odd inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import bayes_minhash, crowds, importance_resampling, lexical_search
from lacuna.llm.workspace import cut_lineage, new_folder, to_table

DOCS = "doc_id bigint, text string, rank string, score string, `root` int, component_id string, term string"
ODD = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "One"), (5, "A b C d e f g"), (5, "A b C d e f g"), (None, "no id here at all"), (None, "no id here at all"), (7, "x" * 3000 + " ü 漢字 \x1c end"), (8, "the of and to " * 20_000), (9, "the of and to " * 20_000 + "end")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, "clash", "clash") for i, t in ODD], DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w)} - {()} if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    out = []
    for k, (i, s) in enumerate(sets):
        c = least[find(k)] if s else i
        out.append((i, len(s), c, i is not None and i == c))
    return sorted(out, key=repr)


def near(spark, docs, **more):
    return sorted(map(tuple, bayes_minhash.near_duplicates(docs, new_folder(spark, "t"), **more).collect()), key=repr)


def copies(seed=0):
    """Chains of edits, so that groups hang together by links only; and many that share half their words."""
    rng, out = random.Random(seed), []
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstu")
    for _ in range(6):
        now = [word() for _ in range(60)]
        for _ in range(rng.choice([1, 2, 30])):
            now = now[:]
            now[rng.randrange(60)] = word()
            out.append(" ".join(now))
    half = [word() for _ in range(40)]
    out += [" ".join(half + [word() for _ in range(8)]) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_posterior_bounds():
    assert abs(bayes_minhash.posterior(20, 20, 0.85) - (1 - 0.85**21)) < 1e-12
    assert [n for n, _ in bayes_minhash.least_agreements()] == list(range(20, 141, 20))
    for n, m in bayes_minhash.least_agreements():
        assert bayes_minhash.posterior(m, n, 0.85) >= bayes_minhash.MISS and (m == 0 or bayes_minhash.posterior(m - 1, n, 0.85) < bayes_minhash.MISS)


@pytest.mark.parametrize("cell", [2048, 6])
def test_near_duplicates(spark, cell, monkeypatch):
    monkeypatch.setattr(crowds, "REPRESENTATIVES", 2)
    docs = copies()
    assert near(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), cell=cell) == components(docs)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """A relation of numbers at a distance of 1, all under one key: chains through every chunk."""
    monkeypatch.setattr(crowds, "REPRESENTATIVES", 2)
    rng = random.Random(1)
    values = rng.sample(range(600), 300)
    rows = spark.createDataFrame([(v % 2, v, str(v)) for v in values] + [(2, v, str(v)) for v in values], "key bigint, cls bigint, what string")

    def relation(what):
        v = np.array(list(map(int, what)))
        return lambda i, others: abs(v[others] - v[i]) <= 1

    got = {tuple(r) for r in crowds.components(rows, relation, new_folder(spark, "t"), cell=16).collect()}
    want, held = set(), set(values)
    for v in values:
        low = v
        while low - 1 in held:
            low -= 1
        if low != v or v + 1 in held:
            want.add((v, low))
    assert got == want


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    assert near(spark, odd) == components(ODD)
    assert near(spark, empty) == []


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def resampled(docs, target):
    corpus, wanted = Counter(k for _, t in docs for k in features(t)[1]), Counter(k for t in target for k in features(t)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = lambda k: floor(1000 * log(float(wanted[k] + 1) * (s + 10000.0) / ((corpus[k] + 1.0) * (t + 10000.0))))
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def test_resampling(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(importance_resampling, "BLOCK_ROWS", 3)
    target = spark.createDataFrame([("a b c the of",), (None,), ("",)], "text string")
    for docs in (copies(1), ODD, [(i % 7, t) for i, t in copies(2)]):
        df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, weight string")
        got = importance_resampling.resampled(df, target, new_folder(spark, "t")).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, got.collect()), key=repr) == resampled(docs, ["a b c the of", None, ""])
    assert importance_resampling.resampled(empty, target, new_folder(spark, "t")).count() == 0
    assert importance_resampling.resampled(odd, empty, new_folder(spark, "t")).count() == len(ODD)


def searched(docs, queries, top):
    held = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        terms, found = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))), []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            found.append((i, sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)))
        best = sorted((x for x in found if x[1] > 0), key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:top]
        out += [(q, k + 1, i, s) for k, (i, s) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top, run, chars", [(50, 4096, 1 << 20), (5, 4, 2000), (1, 1, 1)])
def test_search(spark, odd, empty, monkeypatch, top, run, chars):
    monkeypatch.setattr(lexical_search, "RUN", run)
    queries = [(1, "aka bkq the OF"), (2, None), (3, ""), (4, "nowhere"), (None, "one two 漢字"), (6, " ".join(t for _, t in copies(3)[:3])), (7, "no id")]
    asked = spark.createDataFrame([(i, t, "clash") for i, t in queries], "item_id int, text string, rank string")
    for docs in (copies(3), ODD):
        shards = []
        for at in range(0, len(docs), max(1, chars // 300)):  # as the tasks of a larger table would cut them
            shards.append(spark.createDataFrame(docs[at : at + max(1, chars // 300)], "doc_id bigint, text string"))
        df = shards[0]
        for other in shards[1:8]:
            df = df.unionByName(other)
        docs = [tuple(r) for r in df.collect()]
        index = lexical_search.build_index(df, new_folder(spark, "t"))
        got = lexical_search.search(index, asked, new_folder(spark, "t"), top)
        assert sorted(map(tuple, got.collect()), key=repr) == searched(docs, queries, top)
    assert lexical_search.search(lexical_search.build_index(empty, new_folder(spark, "t")), asked, new_folder(spark, "t")).count() == 0
    assert lexical_search.search(lexical_search.build_index(odd, new_folder(spark, "t")), empty.withColumnRenamed("doc_id", "item_id"), new_folder(spark, "t")).count() == 0


def test_postings_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 35) - 1], np.int64)
    data, sizes = lexical_search.packed(values)
    assert (lexical_search.unpacked(data.tobytes()) == values).all() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 4, 4, 5, 5]
    assert len(lexical_search.unpacked(b"")) == 0


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: sum("shuffle_" in str(files.getAllFiles().apply(i)) for i in range(files.getAllFiles().size()))
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffled()
    set_to = spark.conf.get(name, None)
    for write in (lambda df: to_table(df, f"file://{tmp_path}/t"), cut_lineage):
        got = write(spark.range(1000).groupBy(F.col("id") % 100).count())
        for _ in range(50):
            if shuffled() <= before:
                break
            time.sleep(0.1)
        assert shuffled() <= before
        assert got.count() == 100
        before = shuffled()
    assert spark.conf.get(name, None) == set_to


def test_signatures_are_not_sent_with_every_band(spark, odd, monkeypatch):
    seen, real = [], crowds.components
    monkeypatch.setattr(crowds, "components", lambda members, *a, **b: seen.append(members.columns) or real(members, *a, **b))
    bayes_minhash.near_duplicates(odd, new_folder(spark, "minhash")).count()
    assert seen[0] == ["key", "cls"]


def test_edges_of_a_task_become_stars():
    a, b = crowds.stars([b"5", b"4", b"9", b"5", b"8"], [b"4", b"1", b"5", b"4", b"7"])  # a chain, an edge twice, another component
    assert dict(zip(a, b, strict=True)) == {b"4": b"1", b"5": b"1", b"9": b"1", b"8": b"7"} and len(a) == 4
    assert crowds.stars([], []) == ([], [])


def test_large_rows_reach_python_few_at_a_time(spark):
    """Within rows_at_once a batch has so many rows at most; the setting is put back."""
    from lacuna.llm import workspace

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, df = spark.conf.get(name, None), spark.range(50, numPartitions=1)
    with workspace.rows_at_once(spark, importance_resampling.BLOCKS):
        got = [r["n"] for r in df.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 50 and max(got) <= importance_resampling.BLOCKS and spark.conf.get(name, None) == before
