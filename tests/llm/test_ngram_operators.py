"""Collocations, decontamination and divergence of sources against brute force."""

import random
import re
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swellgrid.llm import automaton, fm_index
from swellgrid.llm.collocations import find_collocations, range_bounds
from swellgrid.llm.decontamination import benchmark_windows, build_index, find_contamination, search_index
from swellgrid.llm.divergence import kept_terms, source_divergence
from swellgrid.llm.words import bitmap, byte_kinds, hashes, split_words, text_blocks


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Words


def test_words_of_bytes():
    texts = ["Ab c.d, É-x", None, "", "..", "z", "a\x0bb\tc"]
    got = split_words(pa.array(texts), byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r"))
    words = got.vocabulary.to_pylist()
    assert [words[i].decode() for i in got.ids] == ["ab", "c", "d", "É-x", "z", "a", "b", "c"]
    assert got.first.tolist() == [0, 4, 4, 4, 4, 5, 8]
    assert len({got.piece[0], got.piece[2], got.piece[3]}) == 3 and got.piece[0] == got.piece[1] and got.piece[6] == got.piece[7]
    assert len(set(hashes(pa.array(["a", "b", "ab", "ba", "", "aa"])).tolist())) == 6


def test_blocks_keep_all_rows():
    batches = [pa.record_batch({"text": pa.array(["x" * n for n in sizes] + [None], pa.string())}) for sizes in ([1, 50, 3], [], [200], [9] * 40)]
    got = [t for block in text_blocks(batches, limit=60) for t in block["text"].to_pylist()]
    assert got == [t for b in batches for t in b.column("text").to_pylist()]
    assert max(block.num_rows for block in text_blocks(batches, limit=60)) < 20


def test_bitmap_holds_its_keys(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    held = bitmap(spark.createDataFrame([(int(k),) for k in keys[:2000]], "h long"), "h", 2000)
    assert held.may_hold(keys[:2000].view(np.uint64)).all()
    assert held.may_hold(keys[2000:].view(np.uint64)).mean() < 0.2


# FM-index


@pytest.mark.parametrize("seed", range(60))
def test_fm_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    sizes, n_ids = rng.integers(0, 14, rng.integers(1, 9)), int(rng.integers(1, 6))
    docs = [rng.integers(0, n_ids, n) for n in sizes]
    if len(docs) > 2:
        docs[-1], sizes[-1] = docs[0], sizes[0]
    index = fm_index.build(np.concatenate(docs), sizes, n_ids, sample=int(rng.integers(1, 6)))
    base = np.cumsum(sizes + 1) - sizes - 1
    phrases, lengths = rng.integers(1, n_ids + 1, (25, 4)), rng.integers(1, 5, 25)
    low, high = index.search(phrases, lengths)
    for k, n in enumerate(lengths):
        wanted = (phrases[k, :n] - 1).tolist()
        found = [int(b + i) for b, d in zip(base, docs, strict=True) for i in range(len(d) - n + 1) if d[i : i + n].tolist() == wanted]
        assert sorted(index.locate(np.arange(low[k], max(low[k], high[k]))).tolist()) == found


def test_suffix_order_of_long_copies():
    doc = np.tile(np.arange(7), 300)
    sizes = np.array([len(doc)] * 4)
    index = fm_index.build(np.tile(doc, 4), sizes, 7)
    low, high = index.search(np.array([[6, 7, 1, 2]]), np.array([4]))
    assert high[0] - low[0] == 4 * 299


# Automata


@pytest.mark.parametrize("seed", range(20))
def test_automaton_round_trip_union_and_lookup(seed):
    rng = np.random.default_rng(seed)
    counts, parts = Counter(), []
    for _ in range(3):
        vocabulary = [f"w{i}".encode() for i in sorted(rng.choice(30, 12, replace=False), key=lambda i: f"w{i}")]
        grams = Counter(tuple(int(x) for x in rng.integers(0, 12, rng.integers(1, 4))) for _ in range(60))
        counts.update({tuple(vocabulary[x] for x in g): n for g, n in grams.items()})
        columns = [np.array([g[k] if k < len(g) else -1 for g in grams], np.int64) for k in range(3)]
        columns, n = automaton.summed(columns, np.array(list(grams.values()), np.int64))
        levels, words = automaton.unpack(automaton.pack(automaton.build(columns, n), pa.array(vocabulary, pa.large_binary())))
        parts.append((*automaton.paths(levels), words))
    columns, n, words = automaton.common_labels(parts)
    columns, n = automaton.summed(columns, n)
    levels, text = automaton.build(columns, n), words.to_pylist()
    got_columns, got = automaton.paths(levels)
    assert {tuple(text[c[i]] for c in got_columns if c[i] >= 0): int(m) for i, m in enumerate(got)} == counts
    asked = [tuple(text[x] for x in rng.integers(0, len(text), rng.integers(1, 4))) for _ in range(200)] + list(counts)
    place = {w: i for i, w in enumerate(text)}
    found = automaton.lookup(levels, [np.array([place[g[k]] if k < len(g) else -1 for g in asked], np.int64) for k in range(3)])
    assert found.tolist() == [counts.get(g, 0) for g in asked]


def test_automaton_shares_states():
    columns = [np.repeat(np.arange(50), 2), np.tile(np.array([3, 4]), 50), np.full(100, 7)]
    levels = automaton.build(columns, np.tile(np.array([5, 6]), 50))
    assert [len(lev.label) for lev in levels] == [50, 2, 2]


# Collocations


def plain_collocations(rows, least=10, longest=3, top=2000, absorbed=50):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= absorbed * f[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l_, r) in enumerate(sorted(scored)[:top], start=1):
            out.add((lang, rank, phrase.decode(), -a, l_, r, total[lang], -score))
    return out


def gram_rows(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "état", "x\x01y", "'q'", "ten", "to"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, [40, 30, 8, 8, 8, 5, 3, 3, 2, 2] + [1] * 60, k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " New York city "]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "a b", ""]), text))
    return rows + [("en", None), ("en", ""), ("fr", " .,\n"), ("en", "of the end " * 3000), *[("de", "Copied text of a copy.")] * 30]


@pytest.mark.parametrize("range_words", [1 << 20, 700])
def test_collocations_equal_brute_force(spark, range_words):
    rows = gram_rows(1)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(3)).withColumn("a.b", F.lit(1)).repartition(5)
    got = find_collocations(df, range_words=range_words).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows) and len(got) == len(set(got))


def test_collocations_of_four_words(spark):
    rows = gram_rows(2, 250)
    got = find_collocations(spark.createDataFrame(rows, "lang string, text string"), least=4, max_words=4, top=50, range_words=900).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, 4, 4, 50)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert find_collocations(empty).count() == 0
    assert find_collocations(spark.createDataFrame([("en", None), (None, "one two three")], "lang string, text string")).count() == 0


def test_a_frequent_first_word_is_cut(spark):
    words = spark.createDataFrame([("en", "the", 9000), *[("en", f"w{i:03}", 10) for i in range(100)]], "lang string, word string, n long")
    bounds = range_bounds(words, 10_000, 500)
    assert bounds == sorted(bounds) and sum(b[:2] == (b"en", b"the") for b in bounds) >= 10


# Decontamination


def plain_contamination(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        words = cut(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i : i + window])].add(item)
    out = []
    for doc, text in docs:
        words, hit, found = cut(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((doc, len(words), tuple(map(tuple, spans)), tuple(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


def contaminated_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cé", "d4", "e", "f", "ß"]) + rng.choice(["", "1", "x"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(30)]
    items += [(100, None), (101, "..."), (102, items[3][1]), (None, "null id here " * 5), (103, "only Four-words here"), (9, items[9][1])]
    docs = []
    for i in range(150):
        text = " ".join(word() for _ in range(rng.randrange(0, 200)))
        for _ in range(rng.randrange(0, 4)):
            passage = rng.choice(items)[1] or ""
            at = rng.randrange(0, len(text) + 1)
            text = f"{text[:at]} {passage.upper() if rng.random() < 0.3 else passage[rng.randrange(0, 5) :]}, {text[at:]}"
        docs.append((i, text))
    long_ = " ".join([" ".join(word() for _ in range(37)) + " " + (items[i % 30][1] or "") for i in range(60)])
    return [*docs, (None, docs[5][1]), (7, docs[6][1]), (7, docs[6][1]), (200, None), (201, ""), (202, long_)], items


@pytest.mark.parametrize(("segment", "slice_"), [(1 << 20, 1 << 17), (50, 1 << 17), (50, 60)])
def test_contamination_equals_brute_force(spark, segment, slice_):
    docs, items = contaminated_rows(segment)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("spans", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(0))
    got = find_contamination(df, bench, segment_words=segment, slice_windows=slice_).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple((s["start"], s["end"]) for s in r["spans"]), tuple(r["items"])) for r in got) == plain_contamination(docs, items)


def test_contamination_of_nothing_and_text_ids(spark):
    docs, items = spark.createDataFrame([("k", "one two"), (None, None)], "doc_id string, text string"), spark.createDataFrame([("i", "One, TWO")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["items"]) for r in find_contamination(docs, items).collect()}
    assert got == {"k": (2, ["i"]), None: (0, [])}
    assert {r["doc_id"]: r["items"] for r in find_contamination(docs, items.where("1 = 0")).collect()} == {"k": [], None: []}
    assert find_contamination(docs.where("1 = 0"), items).count() == 0


def test_an_index_serves_several_benchmarks(spark):
    docs, items = contaminated_rows(4)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for part in (items[:5], items[5:]):
        windows, _ = benchmark_windows(spark.createDataFrame(part, "item_id long, text string"))
        wanted = sum(n for (_, _, spans, _), n in plain_contamination(docs, part).items() if spans)
        assert search_index(index, windows).select("row").distinct().count() == wanted


# Divergence of sources


def plain_divergence(rows, least, top=50):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter(t for r in own if r[1] == s for t in r[2] if t in kept) for s in {r[1] for r in own}}
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + floor(1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)))
        for s, c in count.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), x) for x, o in count.items() if x != s]
            terms = [(share(whole, t) - share(c, t), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, listed in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(listed, start=1)}
    return out


def source_rows(seed, n=300):
    rng = random.Random(seed)
    terms = ["the", "they", "them", "theme", "Of", "état", "étau", "ß", "日本語日本", "日本"] + [f"{a}{b}" for a in "abcdefgh" for b in ("long" * 6, "longlonglonger", "x", "xy", "xyz")]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), " ".join(rng.choices(terms, k=rng.randrange(0, 25))) + rng.choice([".", "1", "-x"])) for _ in range(n)]
    return rows + [("en", "empty", None), ("en", "empty2", "12 34"), ("lone", "s", "the the"), ("none", "a", None), ("none", "b", ""), ("en", "s2", "x" * 5000 + " " + "the " * 4000), *[("en", "s1", "copied words the")] * 40]


@pytest.mark.parametrize("block", [128, 2])
def test_divergence_equals_brute_force(spark, block):
    rows = source_rows(5)
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("item", F.lit(1)).withColumn("place", F.lit("z")).repartition(4)
    got = source_divergence(df, min_docs=12, top_terms=9, source_block=block).collect()
    assert {tuple(r) for r in got} == plain_divergence(rows, 12, 9) and len(got) == len(set(got))


def test_divergence_without_terms_or_rows(spark):
    df = spark.createDataFrame([("en", "a", "x y"), ("en", "b", None)], "lang string, source string, text string")
    assert {tuple(r) for r in source_divergence(df).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert source_divergence(df.where("1 = 0")).count() == 0


def test_prefix_levels_keep_what_plain_counts_keep(spark):
    rows = source_rows(6)
    df = spark.createDataFrame([(r[0] or "", r[2] or "") for r in rows], "lang string, text string").repartition(3)
    plain = Counter((r[0] or "", t) for r in rows for t in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[2]))))
    assert {tuple(r) for r in kept_terms(df, 20).collect()} == {k for k, n in plain.items() if n >= 20}

