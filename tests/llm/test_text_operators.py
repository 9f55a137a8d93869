"""The operators against brute force, libraries and SQL, on whole small tables and on awkward rows."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pyspark.sql.functions as F
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewright.llm import byte_bpe, exact_dedup, langid, line_rules, packing, queries, simhash, token_counts, url_filter, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, root string"
LONG = "word another\tthing " * 30000
TEXTS = [
    None, "", " \n\t ", "one", "One two three four", "a b c d e f g h i j", "a b c d e f g h i j", LONG, "naïve café ΣΑΣ Σ\u00a0x\u2003y 漢字 １２", "<|endoftext|> it's we'll <|startoftext|>don't",
    "emoji 👩‍👩‍👧 e\u0301\u0323 \u1e9b\u0323", "x" * 5000, "\x00\x1f control", "'s't're 12345 a1b2", "line one here\nline one here\n\nother line", "\r\n\x0b\x0c vertical",
]


def odd_docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", None, "k", "r") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s", 1, "k", "r"), (None, "null id", "de", None, 1, "k", "r")]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, same_rows, name):
    same_rows(queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1 ---


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/x?y"), (2, "https://www.example.com/en/"), (3, None), (4, "example.com/en/"), (5, "http://notexample.com/en/"), (6, "x://a.net/fr/#/"), (7, "http://b.org"), (7, "http://b.org")], "page_id bigint, url string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, verdict string")
    got = rows_of(url_filter.filter_urls(pages, rules), "page_id", "host", "rule", "verdict")
    assert got == [(1, "a.example.com", "example.com/en/", "block"), (2, "www.example.com", "www.example.com/en/", "allow"), (3, "", None, "allow"), (4, "", None, "allow"), (5, "notexample.com", "com/", "allow"), (6, "a.net", "net/fr/", "block"), (7, "b.org", None, "allow"), (7, "b.org", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule is null").count() == 8


# --- 2 and 10 ---


def test_boilerplate_lines(spark):
    rows = [(i, f"Menu  Home\nbody {i}", "s") for i in range(30)] + [(100 + i, f"Menu Home\nbody {i}" if i < 2 else f"body {i}", "t") for i in range(19)]
    rows += [(200, None, "s"), (201, "", None), (202, "alone\nalone", "one page"), (203, "word " * 200_000 + "\nMenu Home", "s"), (0, rows[0][1], "s")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, `__drop` string, lines int")
    got = {r["doc_id"]: r for r in line_rules.dedup_lines(docs).collect()}
    assert got[0]["text"] == "body 0" and got[0]["n_dropped"] == 1 and got[200]["text"] is None and got[201]["text"] == ""
    assert got[100]["text"] == "body 0" and got[102]["n_dropped"] == 0 and got[202]["n_dropped"] == 0 and got[203]["n_dropped"] == 1
    twenty = docs.union(spark.createDataFrame([(119, "body 19", "t", "x", 1)], docs.schema))
    assert {r["doc_id"]: r for r in line_rules.dedup_lines(twenty).collect()}[100]["n_dropped"] == 0  # 2 of 20 pages are not over a tenth
    assert line_rules.dedup_lines(docs.limit(0)).count() == 0


def test_depleted_documents(spark):
    menu = "home about contact help terms news sport video"
    rows = [(i, f"{menu}\nown{i} words{i}" if i < 3 else " ".join(f"w{i}x{k}" for k in range(20)), "s") for i in range(40)]
    rows += [(50 + i, f"{menu} more\nonly{i} pair{i}", "t") for i in range(2)] + [(60, rows[0][1], "s")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, text string, source string, kept boolean")
    got = {r["doc_id"]: r for r in line_rules.apply_quality_rules(docs).collect()}
    assert [got[i]["kept"] for i in (0, 1, 2, 60, 3, 50, 51)] == [True] * 5 + [False] * 2 and got[0]["n_boilerplate_words"] == 8 and got[0]["text"] == "own0 words0"
    strict = {r["doc_id"]: r["kept"] for r in line_rules.apply_quality_rules(docs, left_share=0.3).collect()}
    assert [strict[i] for i in (0, 1, 2, 60, 3, 50)] == [False] * 4 + [True, False]
    kept = line_rules.keep_quality(docs, left_share=0.3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in strict.items() if k}


def brute_metrics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_metrics_on_odd_rows(spark):
    got = line_rules.apply_quality_rules(odd_docs(spark).withColumn("n_words", F.lit(1))).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:  # no line of these rows is boilerplate, so the text comes back whole
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_metrics(r["text"])
    kept = line_rules.keep_quality(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and rows_of(kept, "doc_id") == [(5,), (6,)]
    assert line_rules.keep_quality(empty_docs(spark)).count() == 0


# --- 3 ---


def word_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(word_ids, "t"):
        word_ids.t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return word_ids.t.encode(text or "", add_special_tokens=False).ids


def check_packed(rows, texts):
    bins = defaultdict(list)
    for r in rows:
        ids = [*word_ids(texts[r["doc_id"]]), 0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] <= 2048 and (r["length"] == 2048 or r["start"] + r["length"] == len(ids))
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_best_fit_piece_by_piece():
    import random

    rng, most, bins = random.Random(5), 40, 6
    lengths = [rng.randint(1, most) for _ in range(3000)]
    packer, got, left, placed, made = packing.BestFit(most, bins), {}, {}, [], 0
    for k, length in enumerate(lengths):
        for number, items in packer.add((k,), length):
            got |= {item[0]: (number, offset) for item, offset in items}
        fits = [b for b, used in left.items() if most - used >= length]
        if not fits and len(left) == bins:
            del left[next(b for b in left if left[b] == max(left.values()))]
        best = min((most - left[b] for b in fits), default=None)
        placed.append(best)  # which of equally full bins is taken is free; how full it was isn't
        if not fits:
            left[made], made = length, made + 1
        else:
            b = next(b for b in fits if most - left[b] == best)
            left[b] += length
            if left[b] == most:
                del left[b]
    for number, items in packer.held.items():
        got |= {item[0]: (number, offset) for item, offset in items}
    assert [None if got[k][1] == 0 else most - got[k][1] for k in range(len(lengths))] == placed and len({b for b, _ in got.values()}) == made


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    assert check_packed(rows, texts) <= 1.03 * sum(r["length"] for r in rows) / 2048 + 1
    assert Counter(r["doc_id"] for r in rows) == Counter({d: -(-(len(word_ids(t)) + 1) // 2048) for d, t in texts.items()})
    odd = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packed(packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).collect(), {r["doc_id"]: r["text"] for r in odd.collect()})
    assert packing.pack_documents(empty_docs(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- 4 ---


def test_byte_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_docs(spark).select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = Counter(map(tuple, byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()))
    want = Counter()
    for i, t in texts:
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    back = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted(t.encode() for _, t in texts)
    assert byte_bpe.round_trip(empty_docs(spark), path, public_tokenizers.PATTERN).count() == 0


# --- 5 ---


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_held_out(docs).join(docs, "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for h, d in zip(got.held_out, got.doc_id, strict=True))
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_codes_by_hand():
    """Codewords, bits and decoding against a plain version, on made-up counts."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    sums = rng.random((5, langid.FEATURES)) * (rng.random((5, langid.FEATURES)) < 0.02)
    model = langid.Model(list("abcde"), sums)
    assert len({tuple(c) for c in model.code.tolist()}) == 5
    share = [[x / sum(row) for x in row] for row in sums.tolist()]
    for k in range(20):
        counts = np.round(100 * sums[k % 5] * (rng.random(langid.FEATURES) < 0.3)) + (rng.random(langid.FEATURES) < 0.01) * (k // 5)
        x = (counts / counts.sum()).tolist()
        losses, gaps = [0.0] * 5, []
        for bit in model.code.T.tolist():
            mean = [[sum(share[i][f] for i in range(5) if bit[i] == v) / bit.count(v) for f in range(langid.FEATURES)] for v in (1, 0)]
            odds = [math.log((p + 1e-6) / (q + 1e-6)) for p, q in zip(*mean, strict=True)]
            scores = [sum(a * b for a, b in zip(row, odds, strict=True)) for row in share]
            high, low = min(s for s, v in zip(scores, bit, strict=True) if v), max(s for s, v in zip(scores, bit, strict=True) if not v)
            gap = max(high - low, 1e-3)
            says = (sum(a * b for a, b in zip(x, odds, strict=True)) - (high + low) / 2) / gap
            gaps.append(gap)
            for i in range(5):
                losses[i] += gap * math.log1p(math.exp(-4 * says * (1 if bit[i] else -1)))
        losses = [v / sum(gaps) for v in losses]
        best, second = sorted(losses)[:2]
        lang, score, ambiguous = model.predict(counts)
        assert lang == "abcde"[losses.index(best)] and ambiguous == (second - best < langid.MARGIN * (second + best))
        assert abs(score - 1 / sum(math.exp(-8 * (v - best)) for v in losses)) < 1e-6


def test_language_of_odd_rows(spark):
    got = langid.identify_held_out(odd_docs(spark)).collect()
    letters = {r["doc_id"]: r["text"] for r in odd_docs(spark).collect()}
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in letters[r["doc_id"]] or ""))
    assert langid.identify_held_out(empty_docs(spark)).count() == 0 and langid.keep_identified(empty_docs(spark)).count() == 0
    clash = odd_docs(spark).withColumns({"letter": F.lit(7), "whole": F.lit("w")})
    assert langid.keep_identified(clash).columns == clash.columns
    unlabelled = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == unlabelled.where(langid.has_letter(F.col("text"))).count() > 0


# --- 6 ---


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd_docs(spark).select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(word_ids(r["text"])), len(word_ids(r["text"])) > 2048) for r in docs.collect())
    assert Counter(map(tuple, token_counts.count_tokens(docs, path).collect())) == want
    assert token_counts.count_tokens(empty_docs(spark), path).count() == 0


@pytest.mark.parametrize(("states", "lanes", "rounds"), [(130_000, 1 << 14, 32), (6_000, 1 << 14, 32), (130_000, 7, 32), (130_000, 1 << 14, 1)])
def test_state_maps(monkeypatch, states, lanes, rounds):
    """Long words without a break, a table of states that is too small, few lanes, maps that stay without most entries."""
    for name, value in (("MOST_STATES", states), ("LANES", lanes), ("MOST_ROUNDS", rounds)):
        monkeypatch.setattr(token_counts, name, value)
    rng = random.Random(6)
    texts = ["a" * 60_000, "", "=" * 20_001, "abc" * 9_000, "ab" * 5_003 + " x", "漢é" * 3_000, "hello world " * 500, *(t for t in TEXTS if t)]
    texts += ["".join(rng.choices(letters, k=n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 9_000), ("ab", 20_000), ("ab '=1\n", 9_000))]
    machine = token_counts.CountMachine(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.count_texts(machine, texts) == [len(word_ids(t)) for t in texts]
    assert len(machine.items) <= states


# --- 7 ---


def test_warc_chunks(spark):
    big = "ä" * 200_000
    rows = [(1, "http://a/", big), (2, None, big), (3, "u r l\n", None), (4, "", ""), (5, "x", "short"), (6, "x", "short"), (None, "n", big), (1, "http://a/", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    chunks = warc.read_archives(warc.write_archives(pages)).toPandas()
    whole = chunks[(chunks.page_id == 1)].sort_values("chunk")
    assert whole.chunk_bytes.max() <= warc.CHUNK_BYTES and b"".join(whole.drop_duplicates("chunk").data) == big.encode()
    got = Counter(map(tuple, warc.round_trip(pages).collect()))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter((i, len((h or "").encode()), digest(h), *(("revisit", 1) if h == big and i != 1 else ("response", None))) for i, _, h in rows)
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- 8 ---


def brute_print(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, linked):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if linked(rows[a], rows[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return [least[root(k)] for k in range(len(rows))]


def test_simhash_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_docs(spark).where("doc_id is not null").selectExpr("doc_id + 5000", "substr(text, 1, 4000)"))
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    found = brute_components(rows, lambda a, b: (a[1] ^ b[1]).bit_count() <= 4)
    want = Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, found, strict=True))
    assert Counter(map(tuple, simhash.find_near(docs).collect())) == want
    assert simhash.find_near(empty_docs(spark)).count() == 0 and simhash.find_near(odd_docs(spark)).count() == len(TEXTS) + 2


@pytest.mark.parametrize("distance", [2, 4, 7])
def test_pigeonhole_loses_no_link(spark, distance):
    import numpy as np

    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    prints = {b ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)}
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    plan = simhash.plan_parts(*simhash.bit_statistics(df), distance)
    for root in (F.col("fp"), F.pmod("fp", F.lit(3)), F.when(F.pmod("fp", F.lit(20)) == 0, 1).otherwise(2).cast("bigint")):  # roots of one, of many, one with nearly all
        rooted = df.withColumn("root", root)
        roots = {r["fp"]: r["root"] for r in rooted.collect()}
        got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash._met_apart(rooted, plan, distance).collect()}
        assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance and roots[a] != roots[b]}


def test_near_copies_by_similarity(spark):
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(15):
        words = rng.choices(vocabulary, k=300)
        rows.append((n, " ".join(words)))
        for k in range(4):
            changed = list(words)
            for at in rng.sample(range(300), k + 1):
                changed[at] = rng.choice(vocabulary)
            rows.append((n + k + 1, " ".join(changed)))
        n += 5
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, "a b"), (902, "a b")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, root string, id int")
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([*range(0, 75, 5), 900, 901, 902, 902, None], key=repr)
    assert simhash.drop_near(docs.limit(0)).count() == 0


# --- 9 ---


def test_exact_dedup(spark):
    for capacity in (1, 1 << 15):
        got = exact_dedup.find_exact(odd_docs(spark), capacity=capacity)
        by = defaultdict(list)
        rows = [(r["doc_id"], r["text"] or "") for r in odd_docs(spark).collect()]
        for i, t in rows:
            by[t].append(i)
        top = lambda ids: max((i for i in ids if i is not None), default=None)
        want = Counter((i, top(by[t]), len(by[t]), i == top(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        assert Counter(map(tuple, got.collect())) == want
    kept = exact_dedup.drop_exact(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i, t in rows if i == top(by[t])])
    assert exact_dedup.find_exact(empty_docs(spark)).count() == 0 and exact_dedup.drop_exact(empty_docs(spark)).count() == 0


# --- Pipeline ---


def test_pipeline_stages_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    for name, stage in pipeline.STAGES[:4]:
        before = docs.toPandas()
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        kept = set(after.toPandas().doc_id)
        if name == "exact_dedup":
            assert kept == set(before.fillna({"text": ""}).groupby("text").doc_id.max())
        if name == "near_dedup":
            sets = {i: frozenset(simhash.shingle_set(t, 5).tolist()) for i, t in zip(before.doc_id, before.text, strict=True)}
            rows = list(sets.items())
            similar = lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]) > 0
            assert kept == set(brute_components(rows, similar))
        docs = after
    texts = dict(zip(docs.toPandas().doc_id, docs.toPandas().text, strict=True))
    rows = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    check_packed(rows, texts)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty_docs(spark), SF).count() == 0
    assert pd.notna(len(rows))


def test_near_copies_loses_no_link(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for n in range(120):
        words = [word() for _ in range(10 if n < 80 else 89)]
        changed = [*words, word()] if n < 80 else [*words[:81], *[word() for _ in range(8)]]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(changed))]
    sets = [(i, frozenset(simhash.shingle_set(t, 5).tolist())) for i, t in rows]
    want = brute_components(sets, lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]) > 0)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["id"]: r["root"] for r in simhash.near_copies(docs).collect()}
    assert got == {i: c for (i, _), c in zip(sets, want, strict=True) if i != c} and len(got) == 120
