"""Every corpus operator against brute force on a small table with nulls, blanks, copies and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sondera.llm import exact_dedup, line_dedup, mixing, packing, quality, scoring, secrets, simhash, substring_dedup, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def table(df):
    return [r.asDict() for r in df.collect()]


# ----------------------------------------------------------------- exact dedup


def test_exact_dedup(docs, rows):
    got = table(exact_dedup.exact_dedup(docs))
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["text"] or ""]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    kept = Counter(r["text"] or "" for r in got if r["kept"])
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_in_ranges(docs, rows):
    many = docs.unionByName(docs.selectExpr("doc_id + 1000 doc_id", "text || '!' text", "source").crossJoin(docs.sparkSession.range(3)).drop("id"))
    whole, parts = (Counter(map(tuple, exact_dedup.exact_dedup(many, broadcast_bytes=b).drop("source").collect())) for b in (1 << 20, 300))
    assert whole == parts and sum(n for r, n in parts.items() if r[4]) == len({r[1] or "" for r in parts})


def test_exact_dedup_when_scans_differ(spark):
    """Equal rows in another order each time they are read: one of each text still stays."""
    from pyspark.sql import functions as F

    many = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"), F.rand().alias("other"))
    got = exact_dedup.exact_dedup(many.orderBy(F.rand())).where("kept").collect()
    assert sorted(r["text"] for r in got) == sorted(f"t{i}" for i in range(50))


def test_bloom_filter_holds_what_is_repeated(spark):
    from pyspark.sql import functions as F

    hashed = spark.range(4000).select(F.xxhash64(F.least("id", F.lit(3000))).alias("__h"), "id")
    cells = exact_dedup.repeated_cells(hashed)
    tested = exact_dedup.suspects(hashed, exact_dedup.filter_of(cells, 64), 64).collect()
    assert len(tested) == 4000 and all(r["__suspect"] for r in tested if r["id"] >= 3000)
    assert sum(r["__suspect"] for r in tested if r["id"] < 3000) < 100


# -------------------------------------------------------------------- simhash


def fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    counts = [0] * 64
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def linked(prints):
    """Components of fingerprints within three bits, by all pairs."""
    distinct = sorted(set(prints))
    up = list(range(len(distinct)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(distinct)):
        for j in range(i):
            if (distinct[i] ^ distinct[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    return {p: root(i) for i, p in enumerate(distinct)}


def test_simhash(docs, rows):
    got = table(simhash.near_duplicates(docs))
    assert sorted((r["doc_id"], r["__fp"] % 2**64) for r in got if r["doc_id"] is not None) == sorted((i, fingerprint(t)) for i, t, _ in rows if i is not None)
    group = linked([fingerprint(t) for _, t, _ in rows])
    least = {}
    for i, t, _ in rows:
        if i is not None:
            g = group[fingerprint(t)]
            least[g] = min(i, least.get(g, i))
    assert all(r["component_id"] == least.get(group[r["__fp"] % 2**64]) for r in got)


def test_fingerprint_of_a_text_longer_than_a_slice(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 64)
    text = " ".join(f"w{i * i % 977}" for i in range(3000))
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_blocks_given_up_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 900, dtype=np.int64).view(np.uint64)
    prints[300:420] = prints[0] ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    keys, planes = np.repeat([0, 1, 2], 300), simhash._planes(prints)
    for size in (2, 512):
        monkeypatch.setattr(simhash, "BLOCK", size)
        for d in (1, 7, 64, 121):
            n = len(prints) - d
            alive = np.packbits(keys[:n] == keys[d:], bitorder="little")
            got = np.unpackbits(simhash.within_radius(planes, d, n, alive), count=n, bitorder="little").astype(bool)
            assert (got == ((keys[:n] == keys[d:]) & (np.bitwise_count(prints[:n] ^ prints[d:]) <= 3))).all()


@pytest.mark.parametrize("bucket", [4, 8192])
def test_links_of_crowded_buckets(spark, bucket):
    """Chains, stars and strangers; with tiny buckets every bucket is split into pairs of chunks."""
    rng = np.random.default_rng(bucket)
    seeds = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = [int(s) for s in seeds]
    for s in seeds[:6]:
        x = int(s)
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
            if rng.random() < 0.5:
                x = int(s)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "__fp long")
    nodes = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(df, bucket)).collect()}
    expected = linked(prints)
    same = defaultdict(set)
    for p in prints:
        same[expected[p]].add(nodes.get(p, p if np.uint64(p).astype(np.int64) not in nodes.values() else int(np.uint64(p).astype(np.int64))))
    roots = [v for v in same.values()]
    assert all(len(v) == 1 for v in roots) and len({next(iter(v)) for v in roots}) == len(roots)


# ------------------------------------------------------------- quality, mixing


def numbers(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover)


def test_quality_numbers(docs, rows):
    got = table(quality.judged(docs))
    names = [f"__q_{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert len(got) == len(rows)
    for r in got:
        n = numbers(r["text"])
        assert tuple(r[c] for c in names) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_em_by_document():
    """EM on pattern counts is EM over documents, one by one; and the data, not the priors alone, set the rates."""
    rng = np.random.default_rng(3)
    n_rules, q = len(quality.RULES), quality
    bad = rng.random(4000) < 0.3
    shares = np.where(bad[:, None], rng.uniform(0.3, 0.9, n_rules), rng.uniform(0.005, 0.04, n_rules))
    votes = np.where(rng.random((4000, n_rules)) < 0.1, 1, np.where(rng.random((4000, n_rules)) < shares, 0, 2))
    good_p, bad_p, share = [q.PRIOR_GOOD[0]] * n_rules, [q.PRIOR_BAD[0]] * n_rules, q.PRIOR_CLASS[0]
    for _ in range(q.EM_ROUNDS):
        good = np.full(4000, 1 - share)
        other = np.full(4000, share)
        for r in range(n_rules):
            for v, g, b in ((0, good_p[r], bad_p[r]), (2, 1 - good_p[r], 1 - bad_p[r])):
                good[votes[:, r] == v] *= g
                other[votes[:, r] == v] *= b
        post = good / (good + other)
        own = [max(q.PRIOR_LEAST, k * 4000) for k in (q.PRIOR_GOOD[1], q.PRIOR_BAD[1], q.PRIOR_CLASS[1])]
        for r in range(n_rules):
            no, any_ = votes[:, r] == 0, votes[:, r] != 1
            good_p[r] = (post[no].sum() + own[0] * q.PRIOR_GOOD[0]) / (post[any_].sum() + own[0])
            bad_p[r] = ((1 - post)[no].sum() + own[1] * q.PRIOR_BAD[0]) / ((1 - post)[any_].sum() + own[1])
        share = ((1 - post).sum() + own[2] * q.PRIOR_CLASS[0]) / (4000 + own[2])
    codes = votes @ 3 ** np.arange(n_rules - 1, -1, -1)
    found = q.fit(Counter(codes.tolist()))
    assert np.allclose(found[codes], post, atol=1e-6)
    assert np.mean((post < 0.5) == bad) > 0.97 and np.max(np.abs(np.array(bad_p) - q.PRIOR_BAD[0])) > 0.2


def test_quality_posterior_sides_with_the_rules():
    clean = int("2" * len(quality.RULES), 3)
    one_bad = clean - 2 * 3 ** (len(quality.RULES) - 1)
    two_bad = one_bad - 2
    p = quality.fit({clean: 900, one_bad: 5, two_bad: 95})
    assert p[clean] > 0.95 and p[two_bad] < 0.05
    assert quality.fit({})[clean] > 0.5


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.judged(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", "kept", "base_failed").toPandas()
    m = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    m = m[~m["base_failed"]]
    assert (m["kept"] == (m["quality"] == 1)).mean() > 0.95 and m[m["quality"] == 1]["kept"].mean() > 0.99


def test_mixing(docs, rows):
    got = table(mixing.mix(docs))
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in above} if above else share
        if not above:
            break
        left -= sum(2 * size[s] for s in above)
        open_ -= above
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in order)
    assert sorted(r["taken"] for r in got) == sorted(r["taken"] for r in table(mixing.mix(docs.repartition(5))))


def test_mixed_documents_hold_what_was_taken(docs):
    laid = table(mixing.mix(docs))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = Counter()
    for r in table(out):
        n[r["source"]] += len(words(r["text"]))
    taken = Counter()
    for r in laid:
        taken[r["source"]] += r["taken"]
    assert +n == +taken


def test_sainte_lague_is_the_highest_quotients(spark):
    rng = np.random.default_rng(1)
    votes = [(g, i, float(v)) for g in range(8) for i, v in enumerate(rng.pareto(1.0, 9) * 100 + (g == 3) * 0.0)]
    seats = {g: int(rng.integers(0, 60)) for g in range(8)}
    df = spark.createDataFrame([(g, i, v, seats[g]) for g, i, v in votes], "g int, i int, v double, s int")
    got = {(r["g"], r["i"]): r["n"] for r in mixing.sainte_lague(df, ["g"], "i", "v", "s", "n").collect()}
    for g in range(8):
        quotients = sorted(((v / (2 * k - 1), -i) for gg, i, v in votes if gg == g for k in range(1, 80)), reverse=True)[: seats[g]]
        won = Counter(-i for _, i in quotients)
        assert all(got[g, i] == won[i] for i in range(9))


# ------------------------------------------------------------- tokens, packing


def test_token_counts_and_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    byte, word = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for r in table(tokens.token_counts(docs)):
        text = r["text"] or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == len(byte.encode(text, add_special_tokens=False))
    got = table(packing.pack(docs, lambda texts: tokens.word_ids(texts, "word_bpe_49k.json", 1), with_ids=True))
    expected = Counter((i, tuple([*word.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in rows)
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append((r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, ids in expected:
        if i is not None and expected[i, ids] == 1 and sum(1 for j, _ in expected if j == i) == 1:
            assert [x for _, _, p in sorted(pieces[i]) for x in p] == list(ids)
    lengths = defaultdict(list)
    for r in got:
        lengths[r["sequence_id"]].append((r["offset"], r["length"]))
    for seq in lengths.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert sum(n for seq in lengths.values() for _, n in seq) == sum(len(ids) * k for (_, ids), k in expected.items())


def test_odd_texts_count_as_the_library_counts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    byte, word = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    rng = random.Random(8)
    parts = [*"abcdeéÉß't  \n\t\r\x0b\x0c\x1c\x85\xa0 　 0123½.,!?#$&|İıΣςǺ中文かहि😀‍", "<|endoftext|>", "'s", "'LL", " the"]
    known = [" the", "'s", "abc", " é", "中文"]
    sizes = [len(w.encode()) for w in known]
    filled = ("".join(known).encode(), np.array(sizes, np.uint16).tobytes(), np.array([len(byte.encode(w, add_special_tokens=False)) for w in known], np.uint16).tobytes())
    tables = [tokens._Lengths("byte_bpe_50k.json", frequent) for frequent in ((b"", b"", b""), filled)]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert next(tokens.word_ids([text.encode()], "word_bpe_49k.json")).tolist() == word.encode(text, add_special_tokens=False).ids
        assert [t.count([text.encode()])[0] for t in tables] == [len(byte.encode(text, add_special_tokens=False))] * 2


def test_packing_of_very_many_tiny_texts_takes_little_memory(spark):
    import tracemalloc

    tracemalloc.start()
    window, offset = packing.pack_group(np.ones(packing.PIECES, np.int64), packing.CAPACITY)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 100 << 20 and np.bincount(window).max() == packing.CAPACITY and offset.max() < packing.CAPACITY
    df = spark.range(40_000, numPartitions=2).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '' ELSE 'a' END AS text")
    got = packing.packed(df).groupBy("sequence_id").agg({"length": "sum", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 40_000 and max(r["sum(length)"] for r in got) <= packing.CAPACITY and len(got) < 40


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 513, 2000)
    window, sums = packing.divide(lengths, 256)
    assert np.bincount(window, weights=lengths, minlength=256).max() == sums.max() and sums.max() - sums.min() < 60
    window, offset = packing.pack_group(np.array([2048, 1, 2047, 1]), 2048)
    assert len(set(window.tolist())) == 3 and offset.min() == 0


# ------------------------------------------------------- lines, substrings, LM


def test_line_dedup(docs, rows):
    sites = defaultdict(set)
    bare = lambda x: x.strip(" \t\n\x0b\f\r")
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if s is not None and len(words(x)) >= line_dedup.MIN_WORDS:
                sites[bare(x)].add(s)
    common = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    assert common
    for r in table(line_dedup.line_dedup(docs)):
        lines = [] if r["text"] is None else r["text"].split("\n")
        kept = [x for x in lines if bare(x) not in common]
        assert (r["n_lines"], r["n_removed"]) == (len(lines), len(lines) - len(kept))
        assert r["kept_text"] == (None if r["text"] is None else "\n".join(kept))


def test_line_dedup_far_from_the_threshold(spark):
    """Lines that the sketch alone decides: two hundred sites, and one."""
    rows = [(i, f"a line on every site\nonly here number {i}", f"site{i}") for i in range(200)]
    out = table(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(r["kept_text"] == f"only here number {r['doc_id']}" for r in out)


@pytest.mark.parametrize("size", [3000, 1 << 22])
def test_substring_dedup(docs, rows, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", size)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", size)
    least = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                least[key] = min(i, least.get(key, i))
    expected = Counter()
    for i, t, _ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in table(substring_dedup.substring_dedup(docs)))
    assert got == expected and sum(x[2] for x in got) > 300


def test_count_min_never_underestimates():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**32, 5000, dtype=np.uint64)
    seeds[:1000] = seeds[1000:2000]
    counts = rng.integers(1, 3, 5000).astype(float)
    true = Counter()
    for s, n in zip(seeds.tolist(), counts.tolist()):
        true[s] += n
    true = np.array([true[s] for s in seeds.tolist()])
    got = substring_dedup.estimates(seeds, counts)
    assert (got >= true).all() and (got > true).mean() < 0.05


def test_lm_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 4000)
    learned = []
    learn = scoring.learn
    monkeypatch.setattr(scoring, "learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    got = table(scoring.lm_scores(docs))
    toks = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    train = [toks(t) for i, t, _ in rows if fold(i)]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["</s>", *t], t))
    three = Counter(p for t in train for p in zip(["</s>", *t], t, t[1:]))
    n, v = sum(one.values()), len(one)
    lam = learned[0]
    expected = Counter()
    for i, t, _ in rows:
        x = toks(t)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        s = 0.0
        for k, w in enumerate(x):
            h = x[k - 1] if k else "</s>"
            f2 = two[h, w] / max(1, one[h])
            g = (["</s>", *x][k - 1], h)
            f3 = three[*g, w] / max(1, two[g]) if k else f2
            a = lam[min(int(math.log2((two[g] if k else one[h]) + 1)), 11) * 12 + min(int(math.log2(one[h] + 1)) // 2, 11)]
            s += math.log10(a[0] * f3 + a[1] * f2 + a[2] * one[w] / n + a[3] / (v + 1))
        expected[i, fold(i) == 0, len(x), sum(one[w] > 0 for w in x), n, round(base, 4), round(s, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got) == expected
    assert np.allclose(lam.sum(axis=1), 1)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# -------------------------------------------------------------------- secrets


def test_secret_scan(spark):
    import random

    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows, planted = [], set()
    for i in range(120):
        a, b = hexes(40), key()
        rows.append((3 * i, f'see and walk the house token = "{a}" under the light {b} often'))
        planted |= {(3 * i, a), (3 * i, b)}
        rows.append((3 * i + 1, f"commit {hexes(40)} changed src/main/resources/application and understandableness of lightheartedness"))
        rows.append((3 * i + 2, "the green river and the small stone wall, incomprehensibilities notwithstanding"))
    rows += [(900, None), (901, ""), (None, "x" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = table(secrets.scan(df))
    assert sorted((str(r["doc_id"]), r["start"], r["value"]) for r in got) == sorted((str(i), k, v) for i, t in rows for k, v in values(t))
    said = {(r["doc_id"], r["value"]) for r in got if r["is_secret"]}
    assert planted <= said and len(said - planted) <= 0.02 * len(got)


def values(text):
    """(start, value) of the candidates, match by match."""
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        lead = re.match(secrets._LEAD, m.group())
        k = lead.end() if lead else 0
        yield m.start() + k, m.group()[k:]


def test_secret_candidates_of_many_forms(spark):
    texts = [
        'password = "hunter2!" and pwd: Tr0ub4dor&3 or DB_PASSWORD=\'x;y\' "api_key": "k-1"',
        "postgres://admin:S3cr3tPass@db.example.org/main and https://site.org:8080/path",
        "bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92K27uhbU at the end",
        "production_database_password=abcdef123456 my-token : zzzzzz, 🙂 then 0123456789abcdef0123",
        "no secret, the token is late; passwords expire: often",
        " ".join(f"{i:016x}" for i in range(300)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["value"], r["before"], r["behind"]) for r in secrets.candidates(df).collect())
    assert got == sorted((i, k, v, t[max(0, k - 40) : k][-len(b):] if (b := before(t, k)) else "", behind(t, k + len(v))) for i, t in enumerate(texts) for k, v in values(t))
    found = {v for i, _, v, _, _ in got if i < 5}
    assert {"hunter2!", "Tr0ub4dor&3", "S3cr3tPass", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92K27uhbU", "abcdef123456", "zzzzzz", "0123456789abcdef0123"} <= found


def before(text, at):
    """Up to 40 characters in front of a value, from the end of the candidate before it."""
    last = max([k + len(v) for k, v in values(text) if k + len(v) <= at], default=0)
    return text[max(last, at - 40) : at]


def behind(text, at):
    nxt = min([m.start() for m in re.finditer(secrets.CANDIDATE, text) if m.start() >= at], default=len(text))
    return text[at : min(nxt, at + 40)]


def test_false_positives_that_rules_leave_open(spark):
    """Findings of forms that no rule labels: the forest, fitted on what rules label, tells most of them apart."""
    import random

    rng = random.Random(8)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    mixed_case, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    word = lambda: rng.choice("river stone light under window garden silver paper market letter number travel winter orange".split())
    rows, truth = [], {}

    def add(text, value=None, label=None):
        if value:
            truth[len(rows), value] = label
        rows.append((len(rows), f"the {word()} and the {word()} of {word()} {text} with {word()} under {word()}"))

    for _ in range(150):
        add(f'api_key = "{draw(mixed_case, 32)}"')
        add(f"token: {draw(hexes, 40)}")
        add("AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16))
        add(f"commit {draw(hexes, 40)}")
        add(f"/{word()}/{word()}/{word()}/{word()}")
        add(f"{word()}_{word()}_{word()}_{word()}")
        add(f"{word()}{word().title()}{word().title()}{word().title()}")
    for _ in range(60):
        v = draw(mixed_case + "+/", 28)
        add(f"authorization bearer {v}", v, True)
        v = draw(mixed_case, 40)
        add(f"use the private key {v}", v, True)
        v = draw(mixed_case + "!#%*", 14).translate(str.maketrans("23456789", "bcdfghjk"))
        add(f'password = "{v}"', v, True)
        v = f"{word()}{word().title()}{rng.randint(1, 9)}{word().title()}{word().title()}"
        add(f"call {v}", v, False)
        v = f"{word()}-{word()}-{rng.randint(2001, 2030)}-{word()}"
        add(f"see the page {v}", v, False)
        v = f"{word().title()}/{word().title()}/{word().title()}{rng.randint(1, 99)}"
        add(f"open C:/{v}", v, False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = {(r["doc_id"], r["value"]): r["label"] for r in secrets.candidates(df).withColumn("label", secrets.rule_label()).collect()}
    got = {(r["doc_id"], r["value"]): r["is_secret"] for r in secrets.scan(df).collect()}
    held = {}
    for (i, v), label in truth.items():
        key = next(k for k in got if k[0] == i and v in k[1])
        assert labelled[key] is None, key
        held[key] = label
    hit = sum(got[k] for k, label in held.items() if label)
    false = sum(got[k] for k, label in held.items() if not label)
    precision, recall = hit / max(1, hit + false), hit / sum(held.values())
    print(f"precision {precision:.3f} recall {recall:.3f}", [k for k, label in held.items() if got[k] != label][:12])
    assert precision > 0.9 and recall > 0.9


def test_secret_scan_with_one_label_only(spark):
    got = table(secrets.scan(spark.createDataFrame([(1, "incomprehensibilities and understandableness")], "doc_id long, text string")))
    assert len(got) == 2 and not any(r["is_secret"] for r in got)


# ------------------------------------------------------------------ all of them

OPERATORS = {
    "exact": exact_dedup.exact_dedup,
    "simhash": simhash.near_duplicates,
    "quality": quality.judged,
    "mixing": mixing.mix,
    "mixed": mixing.mixed_documents,
    "tokens": tokens.token_counts,
    "packing": packing.packed,
    "lines": line_dedup.line_dedup,
    "substrings": substring_dedup.substring_dedup,
    "scores": scoring.lm_scores,
    "secrets": secrets.scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(clashing, docs, name):
    assert OPERATORS[name](clashing).count() == OPERATORS[name](docs).count()


def test_rounds_of_few_links_have_few_tasks(spark):
    rng = np.random.default_rng(6)
    order = rng.permutation(400)
    edges = [(int(a), int(b)) for at in range(0, 400, 8) for a, b in zip(order[at : at + 7], order[at + 1 : at + 8], strict=True)]
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("48", "false"), strict=True):
            spark.conf.set(n, v)
        found = simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(40))
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    assert len(found.inputFiles()) <= 8
    want = {int(x): min(map(int, order[at : at + 8])) for at in range(0, 400, 8) for x in order[at : at + 8]}
    assert {r["node"]: r["root"] for r in found.collect()} == {x: m for x, m in want.items() if x != m}


def test_distinct_words_of_a_block_are_looked_up_once(monkeypatch):
    texts = ["the river  the\tLight\n\n", " the river ", "", "straße \x0b the\x0c", "a b the"] * 50
    raw = [t.encode() for t in texts]
    name = packing.TOKENIZER
    list(tokens.word_ids(raw[:1], name))
    asked, find = [], tokens._Ids.ids
    monkeypatch.setattr(tokens._Ids, "ids", lambda self, keys: (self is tokens._caches[name].words and asked.extend(keys)) or find(self, keys))
    got = [x.tolist() for x in tokens.word_ids(raw, name, 1)]
    whole = tokens.tokenizer(tokens.place(name))
    assert got == [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert len(asked) == len(set(asked)) < 10
