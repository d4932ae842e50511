"""The corpus operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_edges import EDGES
from orderlens.llm import (bpe, common, exact_dedup, kd_shards, language_id, licenses, line_dedup, mixing, near_dedup, quality,
                           vector_search)
from orderlens.llm.queries import ORACLE, QUERIES
from oracle_util import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, name):
    got = compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name])
    assert got["ok"], got


def table(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


# --- license scan

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_is_a_common_subsequence_and_whole_on_equal_texts():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))]
        b = [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))]
        pairs = licenses.align(a, b, 0, len(a), 0, len(b))
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        assert len(licenses.align(a, a, 0, len(a), 0, len(a))) == len(a)


def test_longest_increasing_run_is_longest():
    rnd = random.Random(4)
    for _ in range(200):
        js = rnd.sample(range(12), rnd.randint(1, 8))
        chain = licenses.increasing(list(enumerate(js)))
        best = max(bin(m).count("1") for m in range(1 << len(js))
                   if all(x < y for x, y in zip(*(lambda s: (s, s[1:]))([js[i] for i in range(len(js)) if m >> i & 1]))))
        assert len(chain) == best and all(x[1] < y[1] for x, y in zip(chain, chain[1:]))


def test_notices_are_found_where_they_stand_and_each_time(docs):
    mit = licenses.TEMPLATES["MIT-text"]
    rows = [(1, f"some words before. {mit} after it", None, None), (2, f"{mit}\n\n{mit}", None, None),
            (3, mit.replace("free of charge", "gratis").replace("Software", "Program", 1), None, None),
            (4, "the of to and permission software " * 500, None, None), *EDGES]
    got = licenses.license_table(docs(rows)).collect()
    found = [(r.doc_id, r.first_word) for r in got if r.license == "MIT-text"]
    assert found[0] == (1, 3) and [d for d, _ in found].count(2) == 2 and 3 in dict(found) and 4 not in dict(found)
    assert all(r.coverage >= licenses.COVERAGE for r in got)


# --- BPE

def reference(texts):
    tok = bpe.bpe(bpe.default_tokenizer()).tok
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_joined_pieces_equal_the_whole():
    model, rnd = bpe.bpe(bpe.default_tokenizer()), random.Random(5)
    parts = ["a", "aa", "b", " ", "  ", "\n", "'s", "'l", "l", "'", "é", "日本", "🤦", "1", "!!", "the", "tion",
             "<|endoftext|>", "<|", "\t", "ing"]
    for _ in range(1500):
        some = rnd.sample(parts, rnd.choice([3, 6, len(parts)]))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 60)))
        cut = model.cuts(text, rnd.choice([1, 2, 3, 5, 9, 17]))
        assert "".join(cut) == text
        assert model.tree([model.piece(p) for p in cut]) == reference([text])[0], text


def test_any_ids_decode_as_in_the_library():
    model, rnd = bpe.bpe(bpe.default_tokenizer()), random.Random(13)
    size = len(model.bytes)
    for _ in range(3000):  # many are not valid UTF-8
        ids = [rnd.choice([rnd.randrange(size), rnd.randrange(256), *model.specials]) for _ in range(rnd.randint(0, 20))]
        assert model.decode(ids) == model.tok.decode(ids, skip_special_tokens=False), ids


def test_encode_decode_in_spark_equals_the_library(docs):
    texts = {10: "ab" * 3000, 11: "<|endoftext|>" * 40 + " x", 12: "Hello  world\r\n" * 200}
    rows = [*EDGES, *((i, t, None, None) for i, t in texts.items())]
    want = sorted((len(ids), bpe.digest_ids(ids), hashlib.sha256((r[1] or "").encode()).hexdigest())
                  for r, ids in zip(rows, reference([r[1] for r in rows])))
    got = bpe.round_trip(docs(rows), leaf_chars=100).collect()
    assert sorted(tuple(r)[1:] for r in got) == want
    back = bpe.decode(bpe.encode(docs(rows), leaf_chars=100)).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in rows)


@given(st.text(st.one_of(st.sampled_from(" \n\t'aäß1²٣.,!\x1c\x85\xa0\u2028\u200b\u0345一Ⅷ😀\u180e\ufeff"), st.characters(exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=400, deadline=None)
def test_words_give_the_ids_of_the_library(text):
    model = bpe.bpe(bpe.default_tokenizer())
    want = model.tok.encode(text, add_special_tokens=False).ids
    assert model.encode([text, text + "<|endoftext|>"]) == [want, want + [50256]]
    assert [i for w in model.piece(text) for i in w] == want


def test_settled_characters_are_cut_as_the_library_cuts_them():
    model = bpe.bpe(bpe.default_tokenizer())
    codes = np.flatnonzero(bpe.settled())
    assert len(codes) > 30_000
    for at in range(0, len(codes), 500):
        text = "".join(f"a{chr(c)}1{chr(c)} .{chr(c)}  " for c in codes[at:at + 500])
        assert model.certain(text)
        assert list(map(bytes, model.words(text))) == [w.encode() for w in bpe.WORDS.findall(text)]


def test_bpe_remembers_words_of_bounded_length_as_bytes():
    bpe._forget()
    model = bpe.bpe(bpe.default_tokenizer())
    texts = ["plain words, again plain words", "x" * 5000 + " end", "", "Straße 12 Straße 13"]
    want = [e.ids for e in model.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert model.encode(texts) == want and model.encode(texts) == want  # met for the first time, and remembered
    assert " words" in model.known and " end" in model.known and max(map(len, model.known)) <= bpe.REMEMBERED_CHARS
    assert all(isinstance(ids, bytes) and len(ids) % 4 == 0 for ids in model.known.values())
    assert sum(model.piece(texts[0]), []) == want[0]


def test_a_worker_keeps_the_tables_of_one_operator(spark, docs):
    rows = docs([(i, f"some words of text number {i} and more of it", "en", "a") for i in range(40)]).repartition(4)

    def kept(batches):
        for batch in batches:
            names = ",".join(k for k, f in (("bpe", bpe._loaded), ("language_id", language_id.letter_table),
                                            ("near_dedup", near_dedup._tables)) if f.cache_info().currsize)
            yield batch.from_pydict({"kept": [names] * batch.num_rows})

    bpe.round_trip(rows).collect()
    near_dedup.sketches(rows, near_dedup.Rule()).collect()
    language_id.identify(rows, language_id.fit(language_id.presence(["some words"]), ["en"])).collect()
    # workers are shared with other tests: each holds what one operator keeps, whichever was its last
    assert all("," not in r["kept"] for r in rows.mapInArrow(kept, "kept string").collect())
    # the same in one process, call by call
    bpe.bpe(bpe.default_tokenizer())
    assert bpe._loaded.cache_info().currsize == 1
    language_id.presence(["a b"])
    assert bpe._loaded.cache_info().currsize == 0 and language_id.letter_table.cache_info().currsize == 1
    bpe.bpe(bpe.default_tokenizer())
    assert language_id.letter_table.cache_info().currsize == 0 and bpe._loaded.cache_info().currsize == 1


def test_batches_for_python_workers_are_bounded_by_bytes(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = docs([(i, "some words " * 20_000, "en", "a") for i in range(60)]).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"size": [batch.nbytes]})

    def largest():
        return max(r["size"] for r in rows.mapInArrow(sizes, "size long").collect())

    model = language_id.fit(language_id.presence(["some words"]), ["en"])
    for operator in (lambda: language_id.identify(rows, model), lambda: near_dedup.sketches(rows, near_dedup.Rule()),
                     lambda: bpe.round_trip(rows)):
        spark.conf.unset(key)
        operator()
        assert largest() < 6_000_000  # of 13 MB in the one partition
    try:
        spark.conf.set(key, "1m")
        bpe.round_trip(rows)
        assert largest() < 2_000_000  # a bound that the session names stays
    finally:
        spark.conf.unset(key)


def test_an_idle_worker_gives_back_what_its_task_has_freed(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("given"))
    run = common.resting(lambda batches: (said.append(b) or b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2] and said == [1, 2, "given"]
    near_dedup._forget()
    assert sum(t.nbytes for t in near_dedup._tables()) < 4 << 20


def test_the_directory_starts_no_python_worker(docs):
    rows = docs([(i, f"text {i % 7}", "en", "a") for i in range(40)])
    directory = exact_dedup.build_directory(rows.select(F.xxhash64("text").alias("h")), capacity=4, max_depth=4)
    assert "ExistingRDD" not in directory.table._jdf.queryExecution().executedPlan().toString()
    assert directory.rows == 40 and directory.table.count() == 2**4
    assert [f.dataType.simpleString() for f in directory.table.schema] == ["int", "int", "int", "bigint", "double"]


def test_bpe_of_an_empty_table_and_of_clashing_columns(docs):
    assert bpe.round_trip(docs([])).count() == 0 and bpe.encode(docs([])).count() == 0
    plain = sorted(map(tuple, bpe.round_trip(docs(EDGES), leaf_chars=1000).collect()), key=str)
    clash = docs(EDGES).selectExpr("*", "1 AS id", "'x' AS ids", "2 AS row", "3 AS leaf", "4 AS n_tokens")
    assert sorted(map(tuple, bpe.round_trip(clash, leaf_chars=1000).collect()), key=str) == plain


# --- sharding

def test_shards_are_near_equal_and_slots_gapless(spark):
    got = kd_shards.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_sharding_edges(docs):
    got = kd_shards.shard_documents(docs(EDGES), shards=3).collect()
    assert len(got) == len(EDGES) and {r.size for r in got if r.doc_id == 1} == {8}
    assert kd_shards.shard_documents(docs([])).count() == 0
    assert kd_shards.shard_documents(docs(EDGES), shards=None, target_bytes=50_000).count() == len(EDGES)


# --- language ID

def test_language_accuracy_on_held_out_rows(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_table(source).join(source.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.97 and got["score"].between(0, 1).all()


def test_presence_kernel_is_that_of_the_sets():
    texts = ["Hello, wörld! 12", "abc", "", None, "abc abd " * 3]
    for text, bits in zip(texts, language_id.presence(texts)):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        plain = " " + "".join(w + " " for w in low.split())
        grams = {plain[i:i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)} if low.split() else set()
        want = {int(language_id._grams(language_id._codes(g), len(g))[0]) for g in grams}
        assert set(np.flatnonzero(bits)) == want


def test_pieces_of_a_long_text_miss_no_gram():
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("ab,. cdß", k=rnd.randint(0, 60))) for _ in range(300)]
    whole = language_id.presence(texts)
    for piece in (1, 2, 3, 12):
        assert (language_id.presence(texts, piece) == whole).all()


def test_language_sample_is_bounded_whatever_the_ids_are(docs):
    rows = [(3, f"some words number {'abcdefghij'[i % 10]} {'klmnop'[i % 6]}", "en", None) for i in range(400)]
    bits, langs = language_id.sampled(docs(rows), F.lit(True), "doc_id", "text", "lang", rows=50)
    assert len(bits) == len(langs) <= 50


def test_language_scores_are_those_of_the_kernel_regression():
    """Nyström features, ridge regression and scores worked out in full, without folding."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(letters, k=40)) for letters in ("abcde fgh", "xyzuv wst", "mnopq rlk") for _ in range(30)]
    langs = [name for name in "abc" for _ in range(30)]
    model = language_id.fit(language_id.presence(texts), langs, landmarks=12, ridge=1e-2)

    def sets(text):
        return set(np.flatnonzero(language_id.presence([text])[0]).tolist())

    grams = [sets(t) for t in texts]
    marks = [i for name in "abc" for i in [k for k, x in enumerate(langs) if x == name][:4]]
    kernel = np.array([[len(a & grams[m]) / math.sqrt(len(a) * len(grams[m])) for m in marks] for a in grams])
    w, v = np.linalg.eigh(kernel[marks])
    features = np.hstack([kernel @ (v / np.sqrt(w)), np.ones((len(texts), 1))])
    wanted = np.array([[1.0 if x == name else -1.0 for name in "abc"] for x in langs])
    solved = np.linalg.solve(features.T @ features + 1e-2 * len(texts) * np.eye(features.shape[1]), features.T @ wanted)
    assert np.allclose(model.scores(language_id.presence(texts)), features @ solved, atol=2e-3)


def test_language_edges(docs):
    got = table(language_id.language_table(docs(EDGES)))
    assert len(got) == len(EDGES) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3))
    assert language_id.language_table(docs([])).count() == 0
    clash = docs(EDGES).selectExpr("*", "'x' AS lang_pred")
    assert language_id.identify(clash, language_id.trained_model(clash)).columns.count("lang_pred") == 1


# --- quality

def test_quality_separates_held_out_rows_and_knows_the_share(spark):
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(1, 1, (1500, 16)), rnd.normal(-1.5, 1, (1500, 16))
    unlabelled = np.vstack([good[:700], bad[:300]])
    model = quality.fit(good[700:], unlabelled)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.scores(bad[300:]) < 0.3).mean() > 0.95 and (model.scores(good[:700]) >= 0.3).mean() > 0.95
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_table(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    got = got.join(labels, "doc_id").where("held_out").toPandas()
    one, nil = got[got["quality"] == 1]["score"], got[got["quality"] == 0]["score"]
    assert np.mean([(one > x).mean() for x in nil]) > 0.95


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality_table(docs(EDGES), labels).where("score BETWEEN 0 AND 1").count() == len(EDGES)
    assert quality.quality_table(docs([]), labels).count() == 0


# --- line dedup

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def test_line_dedup_against_all_pairs(docs):
    rnd = random.Random(6)
    lines = ["".join(rnd.choice("abé") for _ in range(rnd.choice([1, 2, 3, 6, 256, 257, 300]))) for _ in range(60)]
    for x in list(lines):
        i = rnd.randrange(len(x))
        lines.append(rnd.choice([x[:i] + x[i + 1:], x[:i] + "c" + x[i:], x[:i] + "c" + x[i + 1:], x]))
    rnd.shuffle(lines)
    rows = [(i // 4, "\n".join(lines[i:i + 4]), None, None) for i in range(0, len(lines), 4)]
    places = [(d, k, x) for d, t, *_ in rows for k, x in enumerate(t.split("\n")) if x]
    want = set()
    for n, (d, k, x) in enumerate(places):
        first = next(p for p in places if p[2] == x)
        close = next((p for p in places[:places.index(first)] if near(p[2], x)), None)
        if close:
            want.add((d, k, *close[:2], 1))
        elif first[:2] != (d, k):
            want.add((d, k, *first[:2], 0))
    assert {tuple(r) for r in line_dedup.duplicate_lines(docs(rows)).collect()} == want


def test_line_dedup_edges(docs):
    got = line_dedup.duplicate_lines(docs(EDGES)).collect()
    assert sum(r.doc_id == 7 for r in got) == 2999
    assert line_dedup.duplicate_lines(docs([])).count() == 0


def test_the_two_line_hashes_do_not_follow_from_each_other(spark):
    row = line_dedup.split_lines(spark.createDataFrame([(1, "a line")], "doc_id long, text string")).withColumn("alone", F.xxhash64(F.lit("a line"))).first()
    chained = spark.range(1).select(F.xxhash64(F.lit("a line"), F.lit("second"))).first()[0]
    assert row.h1 == row.alone and row.h2 != chained


# --- mixing

def test_mixing_edges_and_reruns(docs):
    rows = docs(EDGES)
    first, second = table(mixing.mix_table(rows)), table(mixing.mix_table(rows.repartition(3)))
    assert sorted(map(str, first)) == sorted(map(str, second))
    assert all(r["taken"] <= 2 * r["size"] for r in first)
    assert mixing.mix_table(docs([])).count() == 0
    out = mixing.mix_documents(rows)
    assert out.columns == rows.columns
    assert out.where(out["text"].rlike(r"[^\x20\x09-\x0D]")).count() == sum(
        r["taken"] // r["size"] for r in first if r["size"])


# --- vectors

def test_vector_search_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = vector_search.nearest(e).toPandas()
    p = e.toPandas().sort_values("vec_id")
    x, ids = np.stack(p["embedding"].to_numpy()).astype(float), p["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and own["score"].is_monotonic_decreasing
        assert np.allclose(own["score"], [s[np.flatnonzero(ids == v)[0]] for v in own["vec_id"]], atol=1e-12)
        hits, total = hits + len(best & set(own["vec_id"])), total + 20
    assert hits / total >= 0.9


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [2.0, 0.0], "x"),
            (20, [1.0, 0.0], "x"), (5, [1.0, None], "x"), (6, [float("inf"), 1.0], "x"), (7, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vector_search.nearest(df).collect()}
    assert got == {(0, 1): (4, 2.0), (0, 2): (20, 1.0), (20, 1): (4, 2.0), (20, 2): (0, 1.0)}
    assert vector_search.nearest(df.limit(0)).count() == 0


# --- exact dedup

@pytest.mark.parametrize("capacity,depth", [(2048, 16), (2, 2), (1, 1)])
def test_exact_dedup_with_overflowing_buckets(docs, capacity, depth):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a b", "ab", "a  b ", "c", "", None, f"d{i % 7}", "hot"]), "en", "s") for i in range(120)]
    rows += [(i + 200, "hot", "en", "s") for i in range(60)]
    index = exact_dedup.build_index(docs(rows), capacity=capacity, max_depth=depth)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.memberships(index).collect()}
    for i, t, *_ in rows:
        same = [(len(u or ""), -j) for j, u, *_ in rows if (u or "").replace(" ", "") == (t or "").replace(" ", "")]
        keep = -max(same)[1]
        assert got[i] == (keep, len(same), keep == i)


def test_exact_dedup_edges(docs):
    rows = docs(EDGES)
    assert exact_dedup.memberships(exact_dedup.build_index(rows)).count() == len(EDGES)
    kept = exact_dedup.drop_copies(rows)
    assert kept.columns == rows.columns and kept.where("doc_id = 5").count() == 0 and kept.count() == 5
    assert exact_dedup.drop_copies(docs([])).count() == 0


# --- near dedup

def test_shingle_sets_are_those_of_the_words():
    rnd = random.Random(9)
    for _ in range(50):
        text = " ".join(rnd.choice(["A", "b", "éé", "C\x0bd", " "]) for _ in range(rnd.randint(0, 30)))
        ascii_lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = ascii_lower.replace("\x0b", " ").split(" ")
        words = [w for w in words if w]
        n = min(3, len(words))
        want = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()
        assert len(near_dedup.shingle_set(text, 3)) == len(want)


def test_pieces_of_long_texts_hash_like_the_whole(monkeypatch):
    text = ("word " * 50 + "x" * 5000 + " tail é\n") * 3
    whole = near_dedup.word_hashes(text)
    near_dedup._tables()
    monkeypatch.setattr(near_dedup, "PIECE_BYTES", 6000)
    assert (near_dedup.word_hashes(text) == whole).all()


def test_odd_sketch_estimates_high_similarity():
    rnd = np.random.default_rng(10)
    rule = near_dedup.Rule(words=3, percent=85)
    for _ in range(60):
        both = rnd.integers(0, 2**63, 900, dtype=np.uint64)
        a = np.concatenate([both, rnd.integers(0, 2**63, 75, dtype=np.uint64)])
        b = np.concatenate([both, rnd.integers(0, 2**63, 75, dtype=np.uint64)])
        x, y = (near_dedup.odd_sketch(near_dedup.min_hashes(s)) for s in (a, b))
        assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y) <= rule.most_different_bits
    assert (1 - 0.85**rule.rows) ** rule.bands <= near_dedup.MISS


def test_near_dedup_edges(docs):
    long = [f"w{i}" for i in range(400)]
    chain = [" ".join(f"v{k}" if k < 12 * i else w for k, w in enumerate(long)) for i in range(6)]
    rows = [*EDGES, *((100 + i, t, None, None) for i, t in enumerate(chain))]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept)
           for r in near_dedup.near_duplicate_table(docs(rows), near_dedup.Rule(3, 85)).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[5, 1] == (4, False) and got[None, 1] == (None, True)
    assert all(got[100 + i, 398] == (100, i == 0) for i in range(6))  # linked from text to text
    kept = near_dedup.drop_near_copies(docs(rows), near_dedup.Rule(3, 85))
    assert kept.where("doc_id BETWEEN 100 AND 105").count() == 1 and kept.columns == docs([]).columns
    assert near_dedup.near_duplicate_table(docs([])).count() == 0


def test_crowds_of_edited_copies_against_all_pairs(docs):
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows, sets = [], {}
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 7)):
            at = rnd.randrange(len(words))
            words[at:at + 1] = rnd.choice([[], [f"x{rnd.randrange(4)}"], [words[at], f"y{rnd.randrange(99)}"]])
        rows.append((i, " ".join(words), None, None))
        sets[i] = {tuple(words[k:k + 3]) for k in range(len(words) - 2)}
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((top(i), top(j)))
                comp[high] = low
    want = {i: (len(sets[i]), top(i)) for i in sets}
    assert len({c for _, c in want.values()}) > 5
    got = near_dedup.near_duplicate_table(docs(rows), near_dedup.Rule(3, 85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
