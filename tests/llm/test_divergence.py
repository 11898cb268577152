"""The source divergence audit against plain Python, on edge rows and empty tables."""

import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence

from .helpers import docs, edge_docs, lowered, passage

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top=divergence.TOP):
    count, inside, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for row in rows:
        text, lang, source = row[1] or "", row[2] or "", row[3] or ""
        words = Counter(TERM.findall(lowered(text).decode()))
        groups[lang].add(source)
        count[lang, source].update(words)
        inside[lang].update(words.keys())
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, sources in groups.items():
        kept = [t for t, n in inside[lang].items() if n >= 3]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // n for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, f(p[s][t], whole[t])) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, limit in ((pairs, None), (terms, top)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit]
                out += [(lang, s, *x, i) for i, x in enumerate(ranked, 1)]
    return sorted(out)


def corpus(n=90):
    rows = []
    for i in range(n):
        common = " ".join(f"c{chr(97 + (i * k) % 7)}" * (1 + k % 3) for k in range(12))
        rows.append((i, f"{common} CafÉ {passage(i % 11, 30).replace('w', 'x').translate(str.maketrans('0123456789', 'abcdefghij'))}", "en" if i % 5 else "de", f"s{(i * i) % 9}" if i % 3 else "hot", 0, 0.0, ""))
    return rows


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("rows", [corpus(), [*edge_docs(), (77, "only here", None, None, None, None, None), (78, "x", "en", "t", 1, 0.0, ""), (79, None, "xx", "lone", 0, 0.0, "")]])
def test_divergence_equals_plain_python(spark, rows):
    assert found(divergence.divergence(docs(spark, rows))) == brute(rows)


def test_small_blocks_buckets_and_tables_change_nothing(spark, monkeypatch):
    rows = corpus(60)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    assert found(divergence.divergence(docs(spark, rows), top=5, each=40)) == brute(rows, 5)
    counts = divergence.term_counts(docs(spark, rows), held=20)
    assert counts.where("term is not null").groupBy().sum("count").first()[0] == sum(len(TERM.findall(lowered(r[1]).decode())) for r in rows)


def test_pairs_are_expanded_in_pieces():
    import numpy as np

    dice = np.random.default_rng(3)
    term = np.sort(dice.integers(0, 40, 300))
    gid = np.concatenate([dice.permutation(60)[:n] for n in np.bincount(term)])
    p, z = dice.integers(1, 10**9, len(term)), dice.integers(1, 99, len(term))
    side = (term, gid, p, z)
    whole = divergence._pair_sums(term, side[0:1] + side[1:], side, 1 << 20)
    bits = divergence._pair_sums(term, side, side, 7)
    assert all((a == b).all() for a, b in zip(whole, bits)) and len(whole[0]) > 100


def test_empty_documents_give_no_rows(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0
    assert found(divergence.divergence(docs(spark, [(1, "a b", "en", "s", 1, 0.0, ""), (2, None, "en", "t", 1, 0.0, "")]))) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
