"""Exact copies, near copies, packing, mixing and quality against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from swellgrid.llm import near_dup
from swellgrid.llm import common, quality
from swellgrid.llm.common import kth_largest
from swellgrid.llm.components import connected_components
from swellgrid.llm.exact_dedup import drop_copies, exact_dedup
from swellgrid.llm.mixing import mix_sources, split_budget, with_words
from swellgrid.llm.packing import END_ID, assemble, pack_documents, shortest_pack_first, slot_table
from swellgrid.llm.quality import calibrated_cut, quality_selection
from swellgrid.llm.queries import ORACLE, QUERIES, tokenizer_path
from swellgrid.llm.textvec import WeightedSampler, shingle_hashes

from .plain import all_pairs_classes, fill, log_weights

DATA = "/root/testdata/sf0.001"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n)]


# Exact copies


@pytest.mark.parametrize("digest", [None, "text_sha256"])
def test_exact_dedup_brute_force(spark, digest):
    rows = [
        (5, "a b", "x", 1), (2, "a \t\n b", "y", 2), (9, None, "z", 3), (7, "", None, 4), (3, " ", "c", 5), (1, "a b ", "d", 6), (4, "long " * 30000, "e", 7),
        (6, "long " * 30000, "f", 8), (None, "a b", "g", 9), (8, "x" * 100 + "1", "h", 10), (10, "x" * 100 + "2", "i", 11), (2, "a b", "y", 12),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, n long").withColumn("a.b", F.lit(1)).withColumn("words", F.lit("x"))
    got = exact_dedup(df, digest=digest).collect()
    assert len(got) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    by_n = {r["n"]: r for r in got}
    for i, text, _, n in rows:
        ids = [x for x in groups[norm(text)] if x is not None]
        assert by_n[n]["group_size"] == len(groups[norm(text)])
        assert by_n[n]["keep_id"] == min(ids)
        if digest:
            assert by_n[n][digest] == hashlib.sha256(norm(text).encode()).hexdigest()
    assert Counter(norm(r[1]) for r in rows for g in got if g["n"] == r[3] and g["kept"]) == Counter(groups.keys())
    assert exact_dedup(df.where("1 = 0")).count() == 0


def test_exact_dedup_keeps_one_of_a_group_when_splits_change(spark, tmp_path):
    """Other file splits between the scans must not lose a group of copies."""
    rows = [(i % 50, f"text {i % 50} " * 20, i % 2) for i in range(400)]
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], "doc_id long, text string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    key, fewest = "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1g")  # each file a partition
        out = exact_dedup(spark.read.parquet(str(tmp_path / "t")))
        spark.conf.set(key, "1")  # from now on all files in one partition
        spark.conf.set(fewest, "1")
        got = out.collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.unset(fewest)
    assert len(got) == 400
    assert sorted(r["doc_id"] for r in got if r["kept"]) == list(range(50))
    assert {r["group_size"] for r in got} == {8}


EXACT_ROWS = [
    (5, "a b", 1, None), (2, "a \t\n b", 1, "x"), (2, "a b", 1, None), (2, "a b", 1, None), (9, None, 1, None), (None, "", 1, None), (None, "", 1, None), (3, "alone", 1, None),
    (4, "x" * 70 + "1", 1, None), (6, "x" * 70 + "2", 1, None), (7, "long " * 30000, 1, None), (8, "long " * 30000, 2, None), (None, "only null", 1, None), (None, "only null", 1, None),
]


@pytest.mark.parametrize("most", [1 << 27, 0])
def test_drop_copies_keeps_what_exact_dedup_keeps(spark, monkeypatch, most):
    """With ties, equal rows, null ids and clashing names; and without any filter."""
    monkeypatch.setattr(common, "MAX_FILTER_BITS", most)
    df = spark.createDataFrame(EXACT_ROWS, "doc_id long, text string, flag int, `one.two` string").withColumn("words", F.lit("w"))
    kept = drop_copies(df)
    assert kept.columns == df.columns
    key = lambda rows: sorted(map(str, rows))
    assert key(kept.collect()) == key(exact_dedup(df).where("kept").drop("keep_id", "group_size", "kept").collect())
    assert key(r["doc_id"] for r in kept.collect()) == key([2, 9, 3, 4, 6, 7, None])
    assert drop_copies(df.where("1 = 0")).count() == 0


def test_filters_without_room_change_nothing(spark, monkeypatch):
    """A filter too small for its keys and no filter at all give the same rows as one of full size."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")

    def results():
        packed = pack_documents(docs, tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset")
        return [
            sorted(map(tuple, x.collect()))
            for x in (exact_dedup(docs.select("doc_id", "text"), digest="d"), near_dup.keep_one_of_each(docs).select("doc_id"), packed)
        ]

    full = results()
    monkeypatch.setattr(common, "_bits", lambda n: 64)
    assert results() == full
    monkeypatch.setattr(common, "MAX_FILTER_BITS", 0)
    assert results() == full


# Near copies


def test_sampler_agrees_with_weighted_jaccard():
    sampler = WeightedSampler(samples=2048, seed=1)
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2**32, 300).astype(np.uint64))
    la, lb = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    wa, wb = 2.0 ** (la / sampler.STEPS), 2.0 ** (lb / sampler.STEPS)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    agree = (sampler.signature(h, la) == sampler.signature(h, lb)).mean()
    assert abs(agree - true) < 0.05


def test_shingles():
    h, of = shingle_hashes([b"a b c d e f", b"", b"a b", b"a b c d e"], 5)
    assert Counter(of.tolist()) == {0: 2, 2: 1, 3: 1}
    assert h[0] == h[3]


def jaccard(a, b):
    s = [Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in (a, b)]
    return sum((s[0] & s[1]).values()) / sum((s[0] | s[1]).values())


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_a_few_words_alone(n):
    """A block may hold one short text only; it has the shingles that it has beside others."""
    text, other = " ".join(f"w{i}" for i in range(n)).encode(), b"some other words that stand before it"
    alone, of = shingle_hashes([text], 5)
    both, of_both = shingle_hashes([other, text], 5)
    assert len(alone) == len(of) == (n > 0) + max(0, n - 5)
    assert alone.tolist() == both[of_both == 1].tolist()


def test_near_dup_classes(spark):
    base = {k: words(k, 200) for k in range(30)}
    rows = [(100 * k, " ".join(v)) for k, v in base.items()]
    for k in range(0, 30, 3):  # near copies: two words changed
        for c in (1, 2):
            w = list(base[k])
            w[50 * c] = f"changed{k}{c}"
            rows.append((100 * k + c, " ".join(w)))
    for k in range(1, 30, 3):  # half the text is another's: no near copies
        rows.append((100 * k + 7, " ".join(base[k][:100] + words(1000 + k, 100))))
    rows += [(5000, None), (5001, ""), (5002, "!!! ..."), (5003, "two words"), (5004, "TWO, words!"), (None, "two words"), (5005, " ".join(words(77, 30000)))]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, class_id string").withColumn("a.b", F.lit(1))
    got = {r["doc_id"]: r for r in near_dup.near_dup_classes(df).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    for k in range(30):
        assert {got[i]["class_id"] for i in got if i // 100 == k and i % 100 < 7} == {100 * k}
        if k % 3 == 1:
            assert got[100 * k + 7]["class_id"] == 100 * k + 7
            assert jaccard(rows[k][1], dict(rows)[100 * k + 7]) < 0.8
    assert got[5003]["class_id"] == got[5004]["class_id"] == 5003
    assert all(got[i]["kept"] and got[i]["class_size"] == 1 for i in (5000, 5001, 5002, 5005))
    kept = near_dup.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["kept"] for r in got.values()) + 1  # and the row without an id
    assert near_dup.near_dup_classes(df.where("1 = 0")).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    base = words(3, 150)
    rows = []
    for c in range(300):
        w = list(base)
        w[c % 150] = f"own{c}"
        rows.append((c, " ".join(w)))
    rows += [(1000 + k, " ".join(words(500 + k, 150))) for k in range(300)]
    got = near_dup.near_dup_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("class_id = 0").count() == 300
    assert got.where("doc_id >= 1000 AND class_size > 1").count() == 0


@pytest.mark.parametrize(("block", "size"), [(256, 1 << 22), (40, 1 << 22), (256, 50_000)])
def test_pairs_within_a_large_family_of_lower_similarity(spark, monkeypatch, block, size):
    """Texts of one template are 0.7 to 0.75 alike, planted pairs of up to 0.95: every pair at 0.8 or more, by weights, is found, and no others."""
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", block, raising=False)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", size)
    rng = random.Random(8)
    template, texts = words(9, 300), {}
    for i in range(240):
        w = list(template)
        w[20 * (i % 10) : 20 * (i % 10) + 26] = [f"own{i}x{k}" for k in range(26)]
        w[260:278] = [f"end{i}x{k}" for k in range(18)]
        texts[i] = w
    for i in range(60):  # a partner of later id
        w = list(texts[i])
        at = rng.randrange(290)
        w[at : at + 2 + i % 20] = [f"new{i}x{k}" for k in range(2 + i % 20)]
        texts[1000 + i] = w
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_dup_classes(df).collect()}
    _, links = all_pairs_classes(dict(rows), near_dup.idf_levels(df))
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    background = [alike(i, i + 1) for i in range(100, 239)]
    assert max(background) < 0.79 and sum(background) / len(background) > 0.6
    assert len(links) > 40
    assert [(a, b) for a, b in links if got[a] != got[b]] == []
    assert sum(len(v) - 1 for v in by_class(got).values()) == len(links)  # each pair a class of its own
    assert all(got[i] == i for i in range(60, 240))


def test_matched_and_single_unmatched_members_of_a_bucket_meet(spark):
    """M is like the leader, U like M only, and the other leader like none of them."""
    ids = [r[0] for r in spark.range(1, 5).orderBy(F.xxhash64("id")).collect()]
    second, (leader, m, u) = ids[0], sorted(ids[1:])
    if second < leader:
        leader = 0
    texts = {leader: words(1, 200), second: words(2, 200)}
    texts[m] = list(texts[leader])
    texts[m][20:34] = [f"m{k}" for k in range(14)]
    texts[u] = list(texts[m])
    texts[u][120:134] = [f"u{k}" for k in range(14)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id long, text string")
    signed = spark.createDataFrame([(i, [7] * near_dup.SAMPLES) for i in texts], "id long, sig array<int>")
    idf = spark.sparkContext.broadcast(np.zeros(1 << near_dup.SKETCH_BITS, np.int8))
    links = {frozenset((r["a"], r["b"])) for r in near_dup.near_components(docs, signed, idf)[0].collect()}
    assert links == {frozenset((leader, m)), frozenset((m, u))}


def by_class(classes):
    out = defaultdict(list)
    for i, c in classes.items():
        out[c].append(i)
    return out


def test_all_pairs_recall_on_nested_groups_and_mutual_copies(spark):
    """Families of one base nest at falling similarity; pairs of copies share no leader.  Classes are those of all pairs."""
    rng = random.Random(12)
    base, texts = words(50, 220), {}
    for family in range(12):
        head = list(base)
        for _ in range(family):
            at = rng.randrange(215)
            head[at : at + 3] = [f"f{family}x{rng.random()}" for _ in range(3)]
        for k in range(6):
            w = list(head)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(220)] = f"own{rng.random()}"
            texts[1000 + 10 * family + k] = w
    for pair in range(60):  # just about the threshold
        w = words(100 + pair, 160)
        texts[5000 + 2 * pair] = w
        other = list(w)
        for j in range(1 + pair % 4):
            other[20 + 35 * j] = f"new{pair}x{j}"
        texts[5001 + 2 * pair] = other
    for i in range(80):
        texts[9000 + i] = words(900 + i, 120)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    idf = near_dup.idf_levels(docs)
    want, links = all_pairs_classes({i: " ".join(w) for i, w in texts.items()}, idf)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_dup_classes(docs).collect()}
    assert len(links) > 150
    assert all(want[i] == want[got[i]] for i in got)  # nothing is joined that links don't join
    found = sum(got[a] == got[b] for a, b in links)
    assert found >= 0.98 * len(links)


def test_idf_spans_its_range(spark):
    """A shingle in every text weighs 1, one in a single text nearly 2."""
    common_words = "this passage stands in every text of all"
    docs = spark.createDataFrame([(i, f"{common_words} {' '.join(words(i, 40))}") for i in range(200)], "id long, text string")
    weights = 2.0 ** (near_dup.idf_levels(docs) / WeightedSampler.STEPS)
    h, _ = shingle_hashes([b"this passage stands in every"], 5)
    assert weights[int(h[0] >> np.uint64(64 - near_dup.SKETCH_BITS))] < 1.05
    h, _ = shingle_hashes([" ".join(words(5, 40)[10:15]).encode()], 5)
    assert weights[int(h[0] >> np.uint64(64 - near_dup.SKETCH_BITS))] > 1.9


def test_block_similarities_are_weighted_jaccard():
    rng = np.random.default_rng(5)
    idf = rng.integers(0, 6, 1 << near_dup.SKETCH_BITS).astype(np.int8)
    pool = rng.integers(0, 2**32, 300).astype(np.uint32)
    feats = [np.sort(rng.choice(pool, 200)).tobytes() for _ in range(12)]
    sets = [near_dup._distinct(np.frombuffer(f, np.uint32).astype(np.uint64)) for f in feats]
    got = near_dup.similarities(feats, np.arange(5), np.arange(5, 12), idf)
    want = [[near_dup.weighted_jaccard(sets[i], sets[j], idf) for j in range(5, 12)] for i in range(5)]
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(200, x) for x in range(201, 260)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame([*edges, (1, 1), (None, 2)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(df.where("1 = 0")).count() == 0


# Packing


def test_patterns_use_the_histogram_exactly():
    rng = random.Random(1)
    for _ in range(20):
        histogram = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 400)))
        patterns = shortest_pack_first(histogram, 64)
        used = Counter()
        for count, lengths in patterns:
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += count
        assert used == histogram
        assert len(patterns) <= 2 * len(histogram)
    assert shortest_pack_first({}) == []
    assert len(slot_table({}, 64)["length"]) == 0


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["hello world", None, "", "hello world", "été " * 4000, "x" * 5000, "a <|endoftext|> b", "<|endoftext|>" * 10, *[" ".join(words(i, 20 + 13 * i)) for i in range(60)]]
    rows = [(i if i != 5 else None, t, "s") for i, t in enumerate(texts)] + [(0, "hello world", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    packed = pack_documents(df, tokenizer_path(), with_ids=True)
    got = packed.toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for _, t, _ in rows:
        want[tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID])] += 1
    light = pack_documents(df, tokenizer_path()).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, light[key].fillna(-1).values.tolist())) == sorted(map(tuple, got[key].fillna(-1).values.tolist()))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 2048
    for r in got.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    whole = got[(got["start"] == 0) & (got["length"] == got["doc_tokens"])]
    assert all(want[tuple(np.frombuffer(r.ids, "<u4").tolist())] for r in whole.itertuples())
    assert got["length"].sum() == sum(len(k) * n for k, n in want.items())
    one = got[got["doc_id"] == 4].sort_values("start")
    assert tuple(np.frombuffer(b"".join(one["ids"]), "<u4").tolist()) in want
    sequence = assemble(packed).where("sequence_id = 0").first()
    assert b"".join(got[got["sequence_id"] == 0].sort_values("offset")["ids"]) == np.array(sequence["ids"], "<u4").tobytes()
    assert pack_documents(df.where("1 = 0"), tokenizer_path()).count() == 0


# Mixing


def test_water_level(spark):
    rng = random.Random(5)
    for budget in (10.0, 500.0, 1e6):
        nodes = [(float(rng.randint(0, 100)), float(rng.randint(1, 9))) for _ in range(12)]
        df = spark.createDataFrame([(0, str(i), c, w, budget) for i, (c, w) in enumerate(nodes)], "p int, name string, cap double, weight double, budget double")
        got = {r["name"]: r["quota"] for r in split_budget(df, ["p"], "name").collect()}
        for i, x in enumerate(fill(budget, nodes)):
            assert got[str(i)] == pytest.approx(x, abs=1e-6)


def test_shortage_goes_to_siblings_first(spark):
    # web/en is short: its share goes to web/de, not to books.
    rows = [(i, "w " * 10, "web", "en", "a") for i in range(2)] + [(100 + i, "w " * 10, "web", "de", "b") for i in range(50)] + [(200 + i, "w " * 10, "books", "en", "c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    out = mix_sources(df, {c: F.col(c) for c in ("domain", "lang", "source")}, {"domain": {"web": 1, "books": 1}}, budget_tokens=400, max_epochs=1)
    got = {(r["domain"], r["lang"]): r["count"] for r in out.groupBy("domain", "lang").count().collect()}
    assert got == {("web", "en"): 2, ("web", "de"): 18, ("books", "en"): 20}


def test_weight_zero_is_no_capacity(spark):
    """What a child of weight 0 holds can't be given, so its parent's shortage goes to the other domain."""
    rows = [(i, "w " * 10, "web", "en") for i in range(10)] + [(100 + i, "w " * 10, "web", "de") for i in range(50)] + [(200 + i, "w " * 10, "books", "en") for i in range(50)]
    rows += [(300, "w " * 10, "none", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string")
    weights = {"domain": {"none": 0}, "lang": {"de": 0}}
    out = mix_sources(df, {c: F.col(c) for c in ("domain", "lang")}, weights, budget_tokens=400, max_epochs=1)
    got = {(r["domain"], r["lang"]): r["count"] for r in out.groupBy("domain", "lang").count().collect()}
    assert got == {("web", "en"): 10, ("books", "en"): 30}


def test_rows_without_ids_share_a_place(spark):
    rows = [(None, "w w", "a")] * 300 + [(7, "w w", "a")] * 200 + [(i, "w w", "a") for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, {"source": F.col("source")}, {}, budget_tokens=500, max_epochs=1)
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts.get(None, 300) == 300 and counts.get(7, 200) == 200 and sum(counts.values()) >= 250


def test_mixing_takes_the_seeded_prefix_and_epochs(spark):
    rows = [(i, " ".join(words(i, 1 + i % 7)), "a") for i in range(200)] + [(1000, None, "b"), (1001, "", None), (None, "one two", None), (1002, "x " * 9, "b")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, epoch int")
    budget = 1500
    out = mix_sources(df, {"source": F.col("source")}, {"source": {"a": 9}}, budget_tokens=budget, max_epochs=3)
    got = Counter((r["doc_id"], r["epoch"]) for r in out.collect())
    tokens = defaultdict(list)
    for i, t, s in rows:
        tokens[s].append((i, len((t or "").split())))
    caps = {s: 3.0 * sum(n for _, n in v) for s, v in tokens.items()}
    quotas = dict(zip(caps, fill(min(budget, sum(caps.values())), [(c, 9.0 if s == "a" else 1.0) for s, c in caps.items()]), strict=True))
    want = Counter()
    for s, docs in tokens.items():
        supply = sum(n for _, n in docs)
        full = int((quotas[s] + 1e-9) // supply)
        rest = int(quotas[s] + 1e-6 - full * supply)
        for e in range(full):
            for i, _ in docs:
                want[i, e] += 1
        done = 0
        for i, n in sorted(docs, key=lambda d: hashlib.md5(f"5:{full}:{'' if d[0] is None else d[0]}".encode()).hexdigest()):
            if done < rest:
                want[i, full] += 1
            done += n
    assert got == want
    assert mix_sources(df.where("1 = 0"), {"source": F.col("source")}, {}).count() == 0


def test_word_counts(spark):
    texts = [None, "", "  ", "a", " a  b\tc\n", "a\n\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["n"] for r in with_words(df, "text", "n").collect()] == [len((t or "").split()) for t in texts]


# Quality


def test_kth_largest(spark):
    rng = random.Random(6)
    xs = [rng.choice([1.5, -2.0, rng.gauss(0, 1e-3), 1e9]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 7, 250, 499, 500):
        assert kth_largest(df, "x", k, bins=16) == sorted(xs, reverse=True)[k - 1]
    assert kth_largest(df, "x", 501) is None


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("pmod(xxhash64(doc_id), 4) <> 0")
    held = labels.where("pmod(xxhash64(doc_id), 4) = 0").select("doc_id", "quality")
    rows = quality_selection(docs, train).join(held, "doc_id").select("quality", "selected").collect()
    good = [r["selected"] for r in rows if r["quality"] == 1]
    bad = [r["selected"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.15


def test_quality_equals_brute_force(spark):
    """Log weights from plain counts of every text's n-grams, and Gumbel ranks of the whole table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_selection(docs, labels, keep=60).collect()}
    sample = quality.labelled_sample(labels, "doc_id", "quality")
    noise = {r["doc_id"]: r["u"] for r in docs.select("doc_id", quality.gumbel(F.col("doc_id"), F.col("text")).alias("u")).collect()}
    want = log_weights({i: r["text"] for i, r in got.items()}, sample)
    for i, r in got.items():
        assert r["log_weight"] == pytest.approx(want[i], abs=1e-6)
    ranked = sorted(got, key=lambda i: -(want[i] + noise[i]))
    assert {i for i, r in got.items() if r["selected"]} == set(ranked[:60])


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (None, "some text", 2.0), (3, "x" * 50000, 3.0), (3, "x" * 50000, 3.0)], "doc_id long, text string, log_weight double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_selection(df, none)
    assert out.count() == 5 and out.where("selected").count() == 5
    one_kind = spark.createDataFrame([(3, 1), (None, 0), (9, None)], "doc_id long, quality int")
    assert quality_selection(df, one_kind).where("selected").count() == 5
    assert quality_selection(df, one_kind, keep=1).where("selected").count() >= 1
    assert quality_selection(df.where("1 = 0"), none).count() == 0
    assert calibrated_cut([(1.0, 0), (3.0, 1)]) == 2.0 and calibrated_cut([]) is None


def test_selection_size_and_determinism(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    a, b = (quality_selection(docs.repartition(n, "doc_id"), labels, keep=50).where("selected").select("doc_id") for n in (3, 5))
    assert a.count() >= 50 and a.exceptAll(b).count() == 0


# Registered queries with SQL twins


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    result = con.execute(ORACLE[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(row[i] for i in places) for row in result.fetchall()), key=str)


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        near_dup.near_dup_classes(spark.createDataFrame([("a", "one two")], "doc_id string, text string"))
