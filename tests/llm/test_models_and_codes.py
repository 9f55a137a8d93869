"""Toxicity, vector codes and importance resampling: held-out accuracy, plain versions and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from tidewright.llm import exact_dedup, resampling, toxicity, vector_codes

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \t", "!!! --", "One two THREE", "one one one one", "naïve Ünïcode 漢字 x1", "word another\tthing " * 40000, "é İ ß " * 10]


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- 11 ---


def test_toxicity_on_held_out_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = toxicity.score_held_out(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    rows = got.merge(docs.select("doc_id", "lang").toPandas()).merge(labels.toPandas(), on="doc_id")
    out = rows[rows.held_out & (rows.lang == "en")]
    assert (out.predicted == out.toxic).mean() >= 0.95 and (rows[~rows.held_out].predicted == rows[~rows.held_out].toxic).mean() >= 0.95


def test_toxicity_reads_whole_texts_and_awkward_rows(spark):
    clean = "some plain words of no account"
    rows = [(i, f"{clean} {i % 7} you utter blockhead" if i % 4 == 0 else f"{clean} {i % 5}") for i in range(400)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (2000, clean * 50000 + " you utter blockhead")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, label string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (99999, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and got[0] > 0.9 > 0.1 > got[1] and got[2000] > 0.5 and got[1000] == got[1001] == got[1003]
    assert toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).where("score > 0.9").count() == len(rows)
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("score = 0").count() == len(rows)
    assert toxicity.score_held_out(docs.limit(0), labels).count() == 0


def test_toxicity_sample_is_bounded_and_keeps_the_prior(spark):
    docs = spark.createDataFrame([(i, "blockhead" if i % 5 == 0 else "neighbour") for i in range(5000)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 5 = 0 AS int) AS toxic")
    rows, stands_for = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", most=400)
    many = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").count().withColumnRenamed("count", "n").collect()}
    assert all(300 < many[c] < 500 for c in (0, 1)) and stands_for == {1: 1000 / 400, 0: 4000 / 400}


def test_runs_do_not_depend_on_blocks(monkeypatch):
    text = "Ünïcode words and more, more words " * 50
    want = Counter(toxicity.runs(text).tolist())
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert Counter(toxicity.runs(text).tolist()) == want


# --- 9 ---


@pytest.mark.parametrize("key", [exact_dedup.KEY, lambda c: F.pmod(F.xxhash64(c), F.lit(97)), lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(301)), 40), lambda c: F.when(c < "text 2", F.xxhash64(c)).otherwise(F.shiftrightunsigned(F.xxhash64(c), 5))])
def test_index_splits_and_chains(spark, monkeypatch, key):
    """Thousands of keys, uneven prefixes, and hashes that collide: texts under one key stay apart by their bytes."""
    monkeypatch.setattr(exact_dedup, "KEY", key)
    rows = [(i, f"text {i % 3000}") for i in range(7000)] + [(10000 + i, "hot") for i in range(3000)] + [(20000, None), (20001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    index, leaves = exact_dedup.build_index(docs)
    assert index.count() == index.select("text_sha256").distinct().count() == 3002
    if key is F.xxhash64:
        assert len(leaves) > 100 and len({d for d, _ in leaves}) > 2
        assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= exact_dedup.BUCKET_KEYS
    chains = index.groupBy("key").agg(F.count("*").alias("n"), F.max("chain").alias("top"))
    assert chains.where("n <> top + 1").count() == 0
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.find_exact(docs).collect()} == want
    assert exact_dedup.drop_exact(docs).count() == len(groups)


# --- 12 ---


def plain_codes(frame):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) for v in frame.embedding]
    kept = frame[ok].sort_values("vec_id", kind="stable").reset_index(drop=True)
    parts = np.floor(4096 * np.stack(kept.embedding.map(lambda v: np.asarray(v, dtype=np.float64)))).astype(np.int64).reshape(len(kept), 8, -1)
    book = parts[:16].transpose(1, 0, 2).copy()
    near = lambda: ((parts[:, :, None] - book[None]) ** 2).sum(3)
    for _ in range(6):
        codes = near().argmin(2)
        for p in range(8):
            for e in range(book.shape[1]):
                if len(mine := parts[codes[:, p] == e, p]):
                    book[p, e] = mine.sum(0) // len(mine)
    d = near()
    error = d.min(2).sum(1)
    by_label = pd.Series(error).groupby(kept.label, dropna=False).transform("sum")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(zip(kept.vec_id, ["".join(f"{c:02x}" for c in r) for r in d.argmin(2)], error.tolist(), by_label.tolist(), [digest] * len(kept), strict=True))


def test_codes_equal_plain_rounds(spark):
    got = vector_codes.compress(read(spark, "embeddings"))
    assert sorted(map(tuple, got.collect())) == plain_codes(pd.read_parquet(f"{SF}/embeddings.parquet"))


@pytest.mark.parametrize("seed", range(3))
def test_codes_with_ties_repeats_and_awkward_rows(spark, seed):
    rng = np.random.default_rng(seed)
    few = rng.integers(-3, 4, size=(30, 16)) / 4096  # few values: many ties and equal entries
    rows = [(int(i), few[rng.integers(30)].tolist() if i % 3 else (rng.integers(-6, 7, 16) / 8192).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(400)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [0.0] * 15, None)]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "Int64"})
    table = spark.createDataFrame([(*r, "z") for r in rows], "vec_id bigint, embedding array<float>, label int, parts string")
    assert sorted(map(tuple, vector_codes.compress(table).collect())) == plain_codes(frame)
    odd = table.union(spark.createDataFrame([(1004, [1.0] * 8, 1, "z"), (1005, [], 1, "z"), (1006, [1.0] * 5, 1, "z")], table.schema))
    assert vector_codes.compress(odd).count() == 400
    assert vector_codes.compress(table.limit(0)).count() == 0 and vector_codes.compress(table.where("vec_id >= 1000")).count() == 0
    assert sorted(map(tuple, vector_codes.compress(table.where("vec_id < 5")).collect())) == plain_codes(frame[frame.vec_id < 5])


def test_bounds_rule_out_most_distances_and_no_tie():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, size=(16, 8, 8))
    parts = centres[rng.integers(16, size=2000)] + rng.integers(-60, 60, size=(2000, 8, 8))
    entries = centres.transpose(1, 0, 2).astype(np.int64)
    state = vector_codes.first_assignment(parts, entries)
    for _ in range(4):
        new = entries + rng.integers(-4, 5, size=entries.shape)
        moved = vector_codes.root_up(((new - entries) ** 2).sum(axis=2))
        *state, looked_at = vector_codes.reassign(parts, new, moved, *state)
        want = ((parts[:, :, None] - new[None]) ** 2).sum(3)
        assert (state[0] == want.argmin(2)).all()
        assert (state[1] ** 2 >= want.min(2)).all() and (state[2] ** 2 <= want).all()
        assert looked_at < want.size / 4
        entries = new


def test_roots_of_large_squares():
    n = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 31) ** 2 + 1, 3037000499**2 - 1], dtype=np.int64)
    assert vector_codes.root_down(n).tolist() == [math.isqrt(int(x)) for x in n]
    assert vector_codes.root_up(n).tolist() == [math.isqrt(int(x) - 1) + 1 if x else 0 for x in n]


# --- 13 ---


def plain_runs(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain_resample(docs, target):
    sums = [Counter(), Counter()]
    for total, texts in zip(sums, (docs.text, target.text), strict=True):
        for t in texts:
            total.update(plain_runs(t)[1])
    s_all, t_all = (sum(c.values()) for c in sums)
    gain = [math.floor(1000 * math.log((sums[1][b] + 1) * (s_all + 10000) / ((sums[0][b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        words, found = plain_runs(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append((words, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1]))
    rank = {r[1]: k for k, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return sorted((*r[1:], rank.get(r[1])) for r in rows)


def test_resampling_equals_the_plain_version(spark):
    got = resampling.resample(read(spark, "documents"), read(spark, "benchmark"))
    want = plain_resample(pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet"))
    assert sorted(map(tuple, got.collect())) == want and sum(r[4] is not None for r in want) > 200


def test_resampling_of_awkward_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, f"alpha beta {k} " * 12) for k in range(20)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, rank string, score int")
    target = spark.createDataFrame([(1, "alpha beta"), (2, None)], "item_id bigint, text string")
    want = plain_resample(pd.DataFrame(rows, columns=["doc_id", "text"]), target.toPandas())
    assert sorted(map(tuple, resampling.resample(docs, target).collect())) == want
    assert resampling.resample(docs.limit(0), target).count() == 0 and resampling.resample(docs, target.limit(0)).where("rank = 1").count() == 1
    twice = resampling.resample(docs.union(docs).union(spark.createDataFrame([(None, "alpha " * 30, "x", 1)], docs.schema)), target).toPandas()
    assert len(twice) == 2 * len(rows) + 1 and sorted(twice["rank"].dropna()) == list(range(1, int(twice["rank"].max()) + 1)) and twice["rank"].max() == (2 * 22 + 1) * 25 // 100


# --- pipeline ---


def test_first_stages_equal_sql_and_predictions(spark, duck):
    import corpus_pipeline
    from tidewright.llm import langid, queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    want = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.OP10_SQL}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count() and kept.columns == docs.columns
    told = langid.identify(kept, langid.train(kept)).where("lang_pred <> 'und' AND NOT ambiguous")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, kept, folder).collect()} == {r["doc_id"] for r in told.collect()}
