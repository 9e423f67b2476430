"""The ten operators and the pipeline against brute force, exact round trips, and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import bin_packing, byte_bpe, decontamination, golay_simhash, huffman_tokens, near_copies, neural_lm, quality_ledger, quality_mil, queries, url_rules, warc_bundles, workspace
from lacuna.llm.workspace import cut_lineage, join_hot, new_folder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, `row` int"
ODD = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one"), (5, "A b C d e f g"), (5, "A b C d e f g"), (None, "no id here at all"), (7, "x" * 3000 + " ü 漢字 \x1c end"), (8, "the of and to " * 500)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", 1) for i, t in ODD], DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_huffman_lengths_are_limited_and_complete():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 3000):
        counts = (np.minimum(rng.pareto(0.6, n), 1e9) * 10).astype(np.int64) + 1
        lengths = huffman_tokens.code_lengths(counts, 14)
        assert lengths.max() <= 14 and (n == 1 or sum(2.0 ** -int(x) for x in lengths) == 1)
        book = huffman_tokens.Codebook(lengths)
        for m in (0, 1, 1023, 1024, 1025, 600_000):
            ids = rng.choice(n, m, p=counts / counts.sum())
            bits, checkpoints = book.encode(ids)
            assert (book.decode(bits, checkpoints, m) == ids).all()


def test_token_files(spark, odd, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(huffman_tokens, "FILE_BYTES", 2000)
    tool = Tokenizer.from_file(huffman_tokens.TOKENIZER)
    files = huffman_tokens.write_tokens(odd, new_folder(spark, "t"))
    rows = huffman_tokens.read_tokens(files).orderBy("part", "number").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 4, 5, 5, 7, 8]
    text, before = {i: t or "" for i, t in ODD}, 0
    for r in rows:
        ids = [*tool.encode(text[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (before, len(ids), zlib.crc32(np.array(ids, "<u4")))
        before += len(ids)
        path = files.filter(F.col("part") == r["part"]).first()["path"]
        assert huffman_tokens.read_document(path, r["number"]).tolist() == ids
    assert huffman_tokens.read_tokens(huffman_tokens.write_tokens(empty, new_folder(spark, "t"))).count() == 0


def test_tokens_of_random_texts_are_the_library_s(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(huffman_tokens, "LOCKSTEP", 2)  # so that long texts go on in the next piece
    tool, rng = Tokenizer.from_file(huffman_tokens.TOKENIZER), random.Random(11)
    letters = [*"ab \n\t'sétß1_9.,!😀漢٣\x1c\x85\u2028\0", "'ll", " the", "  ", "it's", "<|endoftext|>", "<|endof"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["hello <|endoftext|> world", "".join(rng.choice(letters) for _ in range(40_000)), " ".join(rng.choice(["the", "house", "of"]) for _ in range(150_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in huffman_tokens.read_tokens(huffman_tokens.write_tokens(docs, new_folder(spark, "t"))).collect()}
    before = 0
    for i, t in enumerate(texts):
        ids = [*tool.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (before, len(ids), zlib.crc32(np.array(ids, "<u4")))
        before += len(ids)


def test_matches_are_cut_and_tokenised_without_a_call_for_each(monkeypatch):
    from cProfile import Profile

    monkeypatch.setattr(huffman_tokens, "CUT_BYTES", 40)  # so that texts are cut within
    tool, match, rng = huffman_tokens.encoder(huffman_tokens.TOKENIZER), byte_bpe.matcher(public_tokenizers.PATTERN), random.Random(5)
    letters = [*"ab  \n\t'sretß1_9.!😀漢٣\x1c\x85\u2028\u3000\xa0\0", "'ll", "'rest", " the", "  ", "it's", " word word"]
    for n in (0, 1, 7, 300):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 9, 60]))) for _ in range(n)]
        bounds, data = huffman_tokens._text_bytes(pa.array(["it's", *texts, "'s"], pa.string()).slice(1, n))
        cut = [len(m.encode()) for t in texts for m in match(t)]
        assert huffman_tokens.match_starts(data, bounds, tool.kinds).tolist() == [sum(cut[:k]) for k in range(len(cut))]
        ids, sizes = tool(pa.array(texts, pa.string()))
        want = [tool.tool.encode(t, add_special_tokens=False).ids for t in texts]  # the library's splitting
        assert (ids.tolist(), sizes.tolist()) == (sum(want, []), list(map(len, want)))
    monkeypatch.undo()
    some = [*range(0x3100), *range(0xA480, 0xAC00), *range(0xF900, 0x12000), 0x1C, 0x1F600, 0x10FFFF]  # all kinds, also characters that are letters in later versions of Unicode only
    texts = [f"a{chr(c)}{chr(c)}1 {chr(c)}b\n{chr(c)}" for c in some]
    cut = [b - a for t in texts for _, (a, b) in tool.tool.pre_tokenizer.pre_tokenize_str(t)]
    bounds, data = huffman_tokens._text_bytes(pa.array(texts))
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    assert (huffman_tokens.match_starts(data, bounds, tool.kinds) == chars[np.r_[0, np.cumsum(cut)[:-1]]]).all()
    words, calls = " ".join("".join(rng.choices("abcdeinorst", k=9)) for _ in range(50_000)), Profile()
    calls.enable()
    tool(pa.array([words]))
    calls.disable()
    assert sum(x.callcount for x in calls.getstats()) < 5000


def test_language_model(spark, odd, empty, small):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_log_bilinear_lm"](spark, SMALL).collect()}
    cut = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in small}
    counts = Counter(w for i, t in small.items() if not held[i] for w in cut(t))
    total = sum(counts.values())
    for i, t in small.items():
        r = got[i]
        base = sum(log10((counts[w] + 1) / (total + len(counts) + 1)) for w in cut(t))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(cut(t)), sum(counts[w] > 0 for w in cut(t)), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
    assert sum(got[i]["score"] for i in small if held[i]) > sum(got[i]["base_score"] for i in small if held[i])
    layout = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7, "text").orderBy(F.xxhash64("text"))
    again = {r["doc_id"]: r["score"] for r in neural_lm.score(layout, new_folder(spark, "lm")).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"], rel=1e-4) for i in small)
    assert neural_lm.score(odd, new_folder(spark, "lm")).count() == len(ODD)
    assert neural_lm.score(empty, new_folder(spark, "lm")).count() == 0


def test_trained_network_carries_the_gain(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def held_out() -> tuple[float, float]:
        r = neural_lm.score(docs, new_folder(spark, "lm")).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        return tuple(r)

    trained, base = held_out()
    monkeypatch.setattr(neural_lm, "SHARD_TOKENS", 60_000)
    dealt, _ = held_out()
    monkeypatch.setattr(neural_lm, "TURNS", 1)
    apart, _ = held_out()
    monkeypatch.setattr(neural_lm, "TURNS", 0)
    untrained, _ = held_out()
    assert base < untrained + 0.02 < trained - 0.02
    assert apart < dealt and dealt > trained - 0.05  # shards become one model: dealing loses nothing, here it even gains


def test_moves_of_shards_are_joined():
    counts = np.arange(neural_lm.SLOTS, dtype=float)
    model = neural_lm.LogBilinear
    start, size = model(counts).state, model.SIZE
    one, two = start.copy(), start.copy()
    one[0], one[size] = start[0] + 1, start[size] + 3  # the first row of E moves in both, the second in one alone
    two[0], two[size] = start[0] + 2, start[size] + 1
    two[neural_lm.DIM], two[size + 1] = start[neural_lm.DIM] + 4, start[size + 1] + 2
    added = sum(neural_lm.widened(neural_lm.rounded(model(counts, x).moves(start))).astype(float) for x in (one, two))
    got = model.joined(start, added, 2) - start
    assert got[0] == pytest.approx((3 * 1 + 1 * 2) / 4, rel=0.02) and got[neural_lm.DIM] == pytest.approx(4, rel=0.02)
    assert got[size] == pytest.approx(2, rel=0.02) and got[size + 1] == pytest.approx(1, rel=0.02) and np.count_nonzero(got) == 4
    assert len(model.SHARED) == len(start) - size and model.SHARED.sum() == size


def test_language_model_is_normalised():
    rng, slots = np.random.default_rng(1), np.random.default_rng(2).permutation(neural_lm.SLOTS)[: neural_lm.N_SYMBOLS]
    counts = np.full(neural_lm.SLOTS, -1.0)
    counts[slots] = rng.integers(0, 1000, neural_lm.N_SYMBOLS)
    model = neural_lm.LogBilinear(counts)
    w = slots[rng.integers(0, neural_lm.N_SYMBOLS, 5000)]
    model.step(neural_lm.contexts_of([w], slots[0]), w, rng)
    for c in slots[rng.integers(0, len(slots), (3, neural_lm.CONTEXT))]:
        p = np.exp(model.log_probabilities(np.repeat(c[None], len(slots), 0), slots))
        assert p.sum() == pytest.approx(1, abs=1e-3) and p.min() > 0
    unseen, each = neural_lm.shares(10, 3)
    assert 10**unseen + 10 * 10**each == pytest.approx(1)
    texts = [np.array([5, 6, 7]), np.array([8])]
    assert neural_lm.contexts_of(texts, 0)[:, :2].tolist() == [[0, 0], [5, 0], [6, 5], [0, 0]]
    slot = neural_lm.grouped(rng.integers(0, 9, (neural_lm.COMPANY, neural_lm.N_SYMBOLS)))
    assert len(set(slot.tolist())) == neural_lm.N_SYMBOLS and slot.max() < neural_lm.SLOTS


def _edit_distance_within(item, text):
    """Least distance of the item to a run of whole words."""
    far = 10**6
    before = []
    for j in range(len(text) + 1):
        starts = j < len(text) and text[j] != " " and (not j or text[j - 1] == " ")
        before.append(0 if starts else before[-1] + 1 if before else far)
    for i, c in enumerate(item, 1):
        now = [before[0] + 1]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != t)))
        before = now
    return min((d for j, d in enumerate(before) if j and text[j - 1] != " " and (j == len(text) or text[j] == " ")), default=far)


def test_items_within_words_are_no_matches():
    match = decontamination.Matcher([(1, "art"), (2, "a"), (3, "party was"), (4, "arty was over")])
    assert [x[0] for x in match("The party was over")] == [3]
    assert [x[0] for x in match("a part of Art")] == [1, 2]


def test_pigeonhole_matches_are_those_of_dynamic_programming(spark, odd, empty, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "of", "an", "ou", "er", "tion"]) for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randint(3, 25)))) for k in range(20)]
    match, hits = decontamination.Matcher(items), 0
    for _ in range(100):
        text = " ".join(word() for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.7:
            x = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
            text += " " + "".join(x).upper() + ". " + word()
        form = decontamination.normal(text)
        want = {(k, d) for k, t in items if (d := _edit_distance_within(decontamination.normal(t), form)) <= decontamination.budget_of(len(decontamination.normal(t)))}
        assert {(k, d) for k, d, *_ in match(text)} == want
        hits += len(want)
    assert hits > 20
    bench = spark.createDataFrame([(1, "A b C, d e f g"), (2, None), (3, "...")], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in decontamination.matches(odd, bench).collect()) == [(5, 1, 0, 13)] * 2
    kept = decontamination.without_matches(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    many = spark.createDataFrame([(k, f"item {k} has a few words of its own, that is {k * 77}") for k in range(40)] + [(7, "A b C d e f g")], "item_id int, text string")
    whole = decontamination.matches(odd, many).collect()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert Counter(decontamination.matches(odd, many).collect()) == Counter(whole) and len(whole) == 2
    assert decontamination.without_matches(odd, many).count() == len(ODD) - 2
    assert decontamination.matches(empty, bench).count() == 0 and decontamination.without_matches(odd, bench.limit(0)).count() == len(ODD)


def test_quality_classifier(spark, odd, empty):
    scored = queries.QUERIES["op4_attention_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) / len(scored) >= 0.95
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (3, None), (99, 0)], "doc_id bigint, quality int")
    model = quality_mil.train(odd, labels)
    out = quality_mil.with_score(odd, model)
    assert out.columns == [*odd.columns, "score"] and all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality_mil.with_score(empty, quality_mil.train(empty, labels.limit(0))).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags, y = [rng.normal(size=(k, quality_mil.N_FEATURES)) for k in (1, 3, 2)], np.array([1.0, 0.0, 1.0])
    model = quality_mil.Model(np.zeros(quality_mil.N_FEATURES), np.ones(quality_mil.N_FEATURES), {k: rng.normal(size=s) * 0.3 for k, s in {"E": (quality_mil.N_FEATURES, 5), "e": (5,), "W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "c0": ()}.items()})
    x, starts = np.concatenate(bags), np.array([0, 1, 4])
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, starts)[-1]) + (1 - y) * np.log(1 - p)) + sum(quality_mil.DECAY * (w**2).sum() / 2 for w in model.weights.values())
    for name, g in quality_mil._gradient(model, x, starts, y).items():
        w = model.weights[name] = np.array(model.weights[name], float)
        at = tuple(0 for _ in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        high = loss()
        w[at] = old - 1e-5
        assert np.asarray(g)[at] == pytest.approx((high - loss()) / 2e-5, rel=1e-3, abs=1e-7)
        w[at] = old


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/x", "http://example.org/es", "http://notexample.org/en/1", "http://example.org/en/17?q", "x", None, "s://com", "s://a.com/de/", "s://com.fr/fr/", "http://org#a"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df).orderBy("page_id").collect()]
    assert got == [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/es", "org/", "allow"), ("notexample.org", "/en/1", "org/", "allow"), ("example.org", "/en/17", "example.org/en/1", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"), ("a.com", "/de/", "com/de/", "block"), ("com.fr", "/fr/", None, "allow"), ("org", "", None, "allow")]
    assert url_rules.judge(df.limit(0)).count() == 0 and url_rules.judge(df.unionByName(df)).count() == 2 * len(urls)
    long = url_rules.judge(df.limit(1).select("page_id", F.concat(F.lit("http://x.com/de/"), F.repeat(F.lit("a/"), 500_000)).alias("url"), F.lit(1).alias("rule"), F.lit(2).alias("u"))).first()
    assert long["verdict"] == "block" and len(long["path"]) == 1_000_004
    rng = random.Random(6)
    rules = [(rng.choice(["allow", "block"]), rng.choice(["a", "b.a", "c.b.a", "b"]), "/" + "".join(rng.choice("x/y") for _ in range(rng.randint(0, 4)))) for _ in range(25)]
    trie = url_rules.compile_rules(rules)
    for _ in range(500):
        host, path = rng.choice(["a", "b.a", "c.b.a", "d.c.b.a", "b", "ba"]), rng.choice(["", "/" + "".join(rng.choice("x/y") for _ in range(rng.randint(0, 6)))])
        fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert url_rules.longest_match(trie, host, path) == (max(fits)[3:] if fits else None)


def test_bpe_equals_tiktoken(spark, odd, empty):
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.RANKS), special_tokens={})
    own, rng = byte_bpe.codec(byte_bpe.RANKS, public_tokenizers.PATTERN), random.Random(1)
    letters = [*"ab \n\t'sétß1_9.,!😀ñ漢٣²\x1c\x85\u2028\u3000\0", "'ll", " the", "  ", "it's"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    ids = [np.frombuffer(x, "<i4") for x in own.encode(pa.array(texts))]
    assert [i.tolist() for i in ids] == [tool.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]
    long = ["".join(rng.choice(some) for _ in range(n)) for some, n in (("theandingou", 2000), ("ab", 30_000), ("aaaaab", 700), ("x", 513), ("é漢a", 900), ("-=", 5000))]
    assert [np.frombuffer(x, "<i4").tolist() for x in own.encode(pa.array(long))] == [tool.encode_ordinary(t) for t in long]
    short = ["".join(rng.choice(rng.choice(["ab", "theandingou", "aaaab", "é漢a"])) for _ in range(rng.randint(4, 60))).encode() for _ in range(300)]
    assert [own._contract_long(w) for w in short] == [np.array(tool._encode_single_piece(w), "<i4").tobytes() for w in short]
    for r in byte_bpe.round_trip(odd).collect():
        text = {i: t or "" for i, t in ODD}[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(tool.encode_ordinary(text))
    assert [bytes(r["bytes"]) for r in byte_bpe.decode(byte_bpe.encode(odd)).filter("id = 3").collect()] == [b"one"]
    assert byte_bpe.round_trip(empty).count() == 0


def test_short_words_and_decoding_need_no_recursion():
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.RANKS), special_tokens={})
    own, rng = byte_bpe.Codec(byte_bpe.RANKS, public_tokenizers.PATTERN), random.Random(7)
    words = ["".join(rng.choice(some) for _ in range(rng.randint(1, 512 // len(some[-1].encode())))) for some in ("ab", "aaaab", "theandingou", "é漢", "-=") for _ in range(60)] + ["a" * 512, "b", ""]
    ids = [np.frombuffer(x, "<i4") for x in own.encode(pa.array(words))]
    assert [i.tolist() for i in ids] == [tool.encode_ordinary(w) for w in words]
    assert own.decode(ids) == [w.encode() for w in words] and own.decode([]) == [] and own.decode([ids[-1]]) == [b""]
    assert "db" not in vars(own), "only words of more than LONG_WORD bytes need the database"


def test_ledger(spark, odd, empty, small):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_quality_ledger"](spark, SMALL).collect()}
    for i, text in small.items():
        words = text.encode().split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = Counter(windows)
        lines = [x for x in text.split("\n") if x.encode().split()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len({k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}))
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    book = quality_ledger.ledger(odd, keep=["doc_id"])
    assert book.filter("doc_id = 0").first()["failure_bits"] == 1 and quality_ledger.ledger(empty).count() == 0
    clash = odd.withColumn("__body", F.lit(1)).withColumn("__words", F.lit(2))
    all_ = quality_ledger.ledger(clash)
    assert {"__body", "__words", "given_n_words", "n_words"} <= set(all_.columns) and all_.filter("given_n_words = 'clash'").count() == len(ODD)
    rules = {r["rule"]: r for r in quality_ledger.ablations(book).collect()}
    assert rules["few_words"]["failed"] == 9 and rules["repeated_windows"]["failed_alone"] == 1


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 200, dtype=np.uint32)
    for x in words[:40]:
        own = set(golay_simhash.segment_keys(np.array([x]), 23)[0]) - {-1}
        assert len(own) in (1, 6)
        i, j = rng.choice(23, 2, replace=False)
        for y in (x ^ np.uint32(1 << i), x ^ np.uint32(1 << i | 1 << j)):
            assert own & set(golay_simhash.segment_keys(np.array([y]), 23)[0]) - {-1}


@pytest.mark.parametrize("cell", [4096, 8])
def test_simhash_links(spark, cell):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    fps = sorted(set(fps))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    root = {f: f for f in fps}
    find = lambda f: f if root[f] == f else find(root[f])
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    want = Counter(find(f) for f in fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    from lacuna.operators.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(golay_simhash.links(df, new_folder(spark, "s"), 4, cell), cut_lineage).collect()}
    assert sorted(Counter(got.get(signed(f), signed(f)) for f in fps).values()) == sorted(want.values())
    for f in fps:
        assert (got.get(signed(f), signed(f)) == signed(f)) or find(f) == find(got[signed(f)] % (1 << 64))


def test_simhash_rows(spark, odd, empty):
    got = [(r["doc_id"], r["component_id"]) for r in golay_simhash.near_duplicates(odd, new_folder(spark, "s")).collect()]
    assert Counter(got) == Counter([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (5, 5), (None, None), (7, 7), (8, 8)])
    assert golay_simhash.near_duplicates(empty, new_folder(spark, "s")).count() == 0
    first = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert golay_simhash.simhash(b"a b c d".split()) == first % (1 << 64)


def test_simhash_query_against_brute_force(spark, small):
    import xxhash

    prints = {}
    for i, text in small.items():
        words = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    root = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op8_golay_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in ids} and len(set(root.values())) < len(ids)


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7).alias("k"))
    table = spark.createDataFrame([(0, "zero"), (1, "one"), (5, "five")], "k int, name string")
    got = join_hot(rows, table, table.filter("k = 0"), "k", F.col("id"))
    want = rows.join(table, "k", "left").select("id", "k", "name")
    assert Counter(got.collect()) == Counter(want.collect()) and got.columns == ["id", "k", "name"]


def test_packing_runs_is_packing_one_by_one():
    rng = random.Random(8)
    for _ in range(60):
        sizes = sorted((rng.randint(1, rng.choice([6, 60, 90])) for _ in range(rng.randint(1, 80))), reverse=True)
        runs = [(s, n) for s, n in sorted(Counter(sizes).items(), reverse=True)]
        placed, n = bin_packing.pack(runs, 70)
        bins = [b for run in placed for b, k in run for _ in range(k)]
        left: list[int] = []
        for size, got in zip(sizes, bins, strict=True):  # plain best fit
            fits = [(r, k) for k, r in enumerate(left) if r >= size]
            want = min(fits)[1] if fits else len(left)
            left = [*left, 70] if want == len(left) else left
            assert left[got] == left[want]
            left[got] -= size
        assert n == len(left)
        even = bin_packing.pack_evenly(runs, 5)
        assert [sum(k for _, k in run) for run in even] == [n for _, n in runs] and all(0 <= b < 5 for run in even for b, _ in run)
        load = Counter()
        for (s, _), run in zip(runs, even, strict=True):
            for b, k in run:
                load[b] += s * k
        assert max(load.values()) <= max(sizes[0], sum(sizes) / 5 + sizes[0])


def test_shards(spark, odd, empty, small, monkeypatch):
    rows = queries.QUERIES["op9_best_fit_shards"](spark, SMALL).collect()
    per, of_text = Counter(), {}
    for r in rows:
        per[r["shard"]] += r["size"]
        text = small[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None) and 0 <= r["shard"] < 16
        assert of_text.setdefault(text, r["shard"]) == r["shard"]
    assert len(rows) == len(small) and max(per.values()) <= 1.1 * min(per.values())
    monkeypatch.setattr(bin_packing, "CELL_ROWS", 3)
    for got in (rows, bin_packing.shard(odd.unionByName(odd), new_folder(spark, "s"), 3).collect(), queries.QUERIES["op9_best_fit_shards"](spark, SMALL).collect()):
        for k in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    got = bin_packing.shard(odd, new_folder(spark, "s")).collect()
    assert len(got) == len(ODD) and len({r["shard"] for r in got if r["doc_id"] in (3, 4)}) == 1 and len({(r["shard"], r["slot"]) for r in got}) == len(ODD)
    assert bin_packing.shard(empty, new_folder(spark, "s")).count() == 0
    sizes = spark.createDataFrame([(x,) for x in (1, 4095, 4096, 4097, 8191, 8193, 10**6, 10**12 + 1)], "bytes bigint")
    assert [r[0] for r in sizes.select(bin_packing.rounded("bytes")).collect()] == [1, 4095, 4096, 4098, 8192, 8196, 1_000_192, 1_000_190_509_056]


def test_warc(spark, monkeypatch):
    pages = [(1, "http://a/\r\nx é", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "v", "y" * 5000), (None, "w", "y" * 5000), (6, "z", "only"), (6, "z", "only")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    manifest = warc_bundles.write_bundles(df, new_folder(spark, "w"))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_bundles.read_bundles(manifest).collect())
    d = lambda t: warc_bundles.digest32((t or "").encode())
    last = {}
    for i, _, t in pages:
        last[d(t)] = max(last.get(d(t), -1), -1 if i is None else i)
    assert got == Counter((i, len((t or "").encode()), d(t), "response" if last[d(t)] == i else "revisit", None if last[d(t)] == i else last[d(t)]) for i, _, t in pages)
    for row in manifest.collect():
        record = warc_bundles.read_one(row["bundle"], row["frame_start"], row["frame_bytes"], row["offset"])
        assert record["page_id"] == row["page_id"]
        assert (row["frame_start"], row["frame_bytes"]) in [x[:2] for x in warc_bundles.seek_table(row["bundle"])]
    assert warc_bundles.read_bundles(warc_bundles.write_bundles(df.limit(0), new_folder(spark, "w"))).count() == 0


def test_pipeline(spark, odd):
    result = corpus_pipeline.run(spark, SMALL)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and result.count() > 50
    bench = {r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in result.collect():
        assert hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"] and not any(b in texts[r["doc_id"]] for b in bench)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SMALL).columns == odd.columns
    assert corpus_pipeline.near_duplicates(spark, odd, SMALL).count() == 6


def test_pipeline_stages_on_odd_tables(spark, odd, empty):
    clash = odd.select("*", *[F.lit(1).alias(c) for c in ("__score", "__rank", "__h", "score", "id", "h", "failure_bits", "key")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
        out = stage(spark, clash, SMALL)
        assert name == "byte_level_bpe" or out.columns == clash.columns, name
        assert out.count() <= len(ODD)
    long = spark.createDataFrame([(1, " ".join(f"word{i % 9973} and" for i in range(200_000)))], "doc_id bigint, text string")
    assert corpus_pipeline.near_duplicates(spark, long, SMALL).count() == 1 and corpus_pipeline.byte_level_bpe(spark, long, SMALL).first()["n_tokens"] > 500_000


def _planted_near_copies():
    """Chains of texts, each with some words of the one before changed, and texts of one passage with other surroundings."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for n in (8, 30, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            for _ in range(5):
                texts.append(" ".join(base))
                base = [word() if rng.random() < 0.02 else w for w in base]
    passage = [word() for _ in range(60)]
    texts += [" ".join([*passage, *(word() for _ in range(20))]) for _ in range(30)]
    return texts


@pytest.mark.parametrize("cell", [1024, 7])
def test_near_copies_are_those_of_exact_jaccard(spark, cell):
    texts = _planted_near_copies()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = sorted({min(i for i, h in enumerate(group) if h == g) for g in group})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert 30 < len(least) < len(texts) - 30
    assert sorted(r["id"] for r in near_copies.first_of_groups(docs, cell=cell).collect()) == least
    if cell == 1024:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == least


def test_rows_of_equal_ids_stay_in_their_groups(spark):
    own = [" ".join(f"{tag}{i}" for i in range(40)) for tag in "abcde"]
    rows = [(1, own[0]), (5, own[0]), (5, own[1]), (5, own[2]), (5, own[2]), (9, own[2]), (5, own[3]), (2, own[3]), (None, own[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert corpus_pipeline.near_duplicates(spark, docs.withColumn("__h", F.lit(3)).withColumn("id", F.lit(1)), SMALL).columns == ["doc_id", "text", "__h", "id"]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect())
    assert got == sorted([(1, own[0]), (5, own[1]), (5, own[2]), (2, own[3]), (0, own[0])])


def test_near_copies_link_fingerprints_through_golay_keys(spark, monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64)
    for n in (1, 2, 5, 5000):
        bits = [(int(h) >> k & 1) for h in hashes[:n] for k in range(64)]
        most = sum(1 << k for k in range(64) if 2 * sum(bits[k::64]) > n)
        assert near_copies.fingerprint(hashes[:n]) & (1 << 64) - 1 == most
    rows = [(b"a", 0), (b"b", 0b1111), (b"c", 0b1111 << 20 | 0b1111), (b"d", 0), (b"e", 0x5555555555555555), (b"f", 0x55555555555555AA), (b"g", None)]
    folder = workspace.new_folder(spark, "golay")
    links = near_copies.fingerprint_links(spark.createDataFrame(rows, "cls binary, fp bigint"), folder).collect()
    assert {frozenset(map(bytes, (r["a"], r["b"]))) for r in links} == {frozenset((b"a", b"b")), frozenset((b"b", b"c")), frozenset((b"a", b"d"))}
    docs = spark.createDataFrame([(k, " ".join(f"{k}w{j}" for j in range(60))) for k in (3, 5, 8)] + [(1, ""), (2, None)], "doc_id bigint, text string")
    assert sorted(r["id"] for r in near_copies.first_of_groups(docs).collect()) == [1, 3, 5, 8]
    monkeypatch.setattr(golay_simhash, "links", lambda fps, folder: fps.crossJoin(fps.agg(F.min("fp").alias("b"))).select(F.col("fp").alias("a"), "b").filter("a <> b"))
    assert sorted(r["id"] for r in near_copies.first_of_groups(docs).collect()) == [1, 3]
