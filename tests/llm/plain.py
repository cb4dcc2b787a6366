"""Plain Python versions of operators, for tables of a few hundred rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from swellgrid.llm import near_dup, quality
from swellgrid.llm.textvec import WeightedSampler, shingle_hashes


def log_weights(texts, sample):
    """Log importance weight of each text, from plain counts of all n-grams; ``sample`` has labels by id in their order."""
    use = {k: (1, 2, 1, 3)[i % 4] for i, k in enumerate(sample)}
    grams = {i: Counter(quality._ngrams([(t or "").encode()])[0].tolist()) for i, t in texts.items()}
    raw, good, unseen = Counter(), Counter(), Counter()
    for i, c in grams.items():
        raw += c
        if sample.get(i) == 1 and use[i] < 3:
            (good if use[i] == 1 else unseen).update(c)
    total = sum(raw.values()) + quality.BUCKETS
    p = {b: (raw[b] + 1) / total for b in range(quality.BUCKETS)}
    n_good, best = sum(good.values()), None
    for m in quality.PSEUDO_COUNTS:
        ratio = {b: (good[b] + m) / (n_good * p[b] + m) for b in p}
        norm = sum(p[b] * ratio[b] for b in p)
        fit = sum(n * math.log(ratio[b] / norm) for b, n in unseen.items())
        if best is None or fit > best[0]:
            best = fit, {b: math.log(r / norm) for b, r in ratio.items()}
    return {i: sum(n * best[1][b] for b, n in c.items()) for i, c in grams.items()}


def selected(texts, sample, noise):
    """Ids that importance resampling selects: as many as reach the cut, by weight and Gumbel noise."""
    weight = log_weights(texts, sample)
    scored = [(weight[i], y) for k, (i, y) in enumerate(sample.items()) if k % 4 == 3 and i in weight]
    cut = quality.calibrated_cut(scored)
    k = sum(w >= cut - 1e-9 for w in weight.values())
    return set(sorted(texts, key=lambda i: -(weight[i] + noise[i]))[:k])


def first_of_equal(texts):
    """The smallest id of each text after blanks are normalised."""
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    return set(first.values())


def idf_levels(texts):
    """Weight level of each sketch slot, from plain document frequencies."""
    counts = np.zeros(1 << near_dup.SKETCH_BITS)
    for t in texts.values():
        h, _ = shingle_hashes([t.lower().encode()], near_dup.SHINGLE_WORDS)
        for slot in Counter(int(x) >> (64 - near_dup.SKETCH_BITS) for x in set(h.tolist())).items():
            counts[slot[0]] += slot[1]
    n = max(2, len(texts))
    df = np.clip(counts - counts.sum() / len(counts), 1, n)
    return np.rint(WeightedSampler.STEPS * np.log2(1 + np.log(n / df) / np.log(n))).astype(np.int8)


def all_pairs_classes(texts, idf):
    """Classes of the links among all pairs at a weighted similarity of 0.8, and the links."""
    ids = sorted(texts)
    sets = {}
    for i in ids:
        h, _ = shingle_hashes([texts[i].lower().encode()], near_dup.SHINGLE_WORDS)
        sets[i] = near_dup._distinct(h >> np.uint64(32))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near_dup.weighted_jaccard(sets[a], sets[b], idf) >= near_dup.SIMILARITY:
                links.append((a, b))
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {i: find(i) for i in ids}, links


def fill(budget, nodes):
    """Water-filling by bisection: nodes are (cap, weight)."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, mid * w) for c, w in nodes) < budget:
            lo = mid
        else:
            hi = mid
    return [min(c, hi * w) for c, w in nodes]


def mixed(rows, levels, weights, budget_share=0.8, seed=5):
    """Ids of ``rows`` (id, text, level values) that one epoch of the mix takes: budgets by bisection, then each leaf's prefix."""
    tokens = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    leaf = {r[0]: r[2:] for r in rows}
    supply = Counter()
    for i, path in leaf.items():
        supply[path] += tokens[i]
    quota = {(): budget_share * sum(tokens.values())}
    for depth, level in enumerate(levels):
        families = defaultdict(set)
        for path in supply:
            families[path[:depth]].add(path[: depth + 1])
        given = {}
        for parent, nodes in families.items():
            nodes = sorted(nodes, key=str)
            caps = [float(sum(n for p, n in supply.items() if p[: depth + 1] == node)) for node in nodes]
            given |= dict(zip(nodes, fill(min(quota[parent], sum(caps)), [(c, weights.get(level, {}).get(node[-1], 1.0)) for c, node in zip(caps, nodes, strict=True)]), strict=True))
        quota = given
    taken = set()
    for path, total in supply.items():
        ids = [i for i in leaf if leaf[i] == path]
        full = int((quota[path] + 1e-9) // total) if total else 0
        if full:
            taken.update(ids)
            continue
        done, rest = 0, int(quota[path] + 1e-6)
        for i in sorted(ids, key=lambda i: hashlib.md5(f"{seed}:0:{i}".encode()).hexdigest()):
            if done < rest:
                taken.add(i)
            done += tokens[i]
    return taken
