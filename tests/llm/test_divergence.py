"""op11 against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import stretches
from recordloom.llm.divergence import PAIRS, Trees, leaf_shares, source_divergence, walked

SCHEMA = "lang string, source string, text string"


def plain(rows, few=10, top=10):
    words, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups.add((lang, source))
        words[lang, source].update(found)
        words[lang, None].update(found)
        docs[lang].update(set(found))
    kept = {lang: [t for t, n in docs[lang].items() if n >= few] for lang, _ in groups}

    def shares(lang, source):
        held, v = words[lang, source], len(kept[lang])
        total = sum(held[t] for t in kept[lang])
        return {t: 1 + 10**9 * (held[t] + 2) // (total + 2 * v) for t in kept[lang]}

    out = []
    for lang, source in groups:
        p, q = shares(lang, source), shares(lang, None)
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            r = shares(lang, other)
            pairs.append((-sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in p), other.encode(), other))
        terms = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode(), t) for t in p if words[lang, source][t] and p[t] > q[t]]
        for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(listed)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in source_divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünder", "été", "日本", "Z"]
    made = []
    for i in range(300):
        lang = rng.choice(["en", "fr", None])
        lean = rng.randrange(1, 6)
        text = " ".join(rng.choice(vocabulary[: 12 * lean]) for _ in range(rng.randrange(0, 40)))
        made.append((lang, rng.choice(["a", "b", "é", None, "hot", "hot", "hot"]), text + rng.choice(["", "\x00x", "-Y_y`"])))
    made += [("en", "empty", None), ("en", "empty", ""), ("xx", "one", "few words"), ("xx", "two", "others"), ("alone", "s", "word")]
    return made + made[:40]


@pytest.mark.parametrize("sizes", [{}, {"block": 4, "lot": 2}])
def test_against_counting(spark, sizes):
    made = rows()
    assert found(spark.createDataFrame(made, SCHEMA), **sizes) == plain(made)


def test_many_small_sources_and_no_kept_terms(spark):
    made = [("en", f"s{i}", "alpha beta " * (i % 3 + 1) + f"own{i}") for i in range(24)]
    df = spark.createDataFrame(made, SCHEMA)
    assert found(df, block=1, lot=3) == plain(made)
    assert found(df, few=100) == plain(made, few=100)


def test_empty_table_and_clashing_names(spark):
    made = rows()[:50]
    df = spark.createDataFrame(made, SCHEMA).withColumns({c: F.lit("z") for c in ("term", "n", "item", "value", "rank", "block")})
    assert found(df, few=3) == plain(made, few=3)
    assert found(df.limit(0)) == []


def test_a_very_long_text_is_read_in_stretches(spark, monkeypatch):
    table = bytes(32 if c < 65 else c for c in range(256))
    text = b"a bc " + b"d" * 50 + b" ef" * 20
    for size in (1, 3, 7, 1000):
        assert [w for s in stretches.word_stretches(text, table, size) for w in s] == text.split()
    made = [("en", s, "long tail " * 200_000 + "end") for s in "ab"] + [("en", "c", "long end")] * 10
    assert found(spark.createDataFrame(made, SCHEMA)) == plain(made)


def test_equal_counts_are_one_node_and_walks_agree_with_a_plain_sum():
    rng = random.Random(9)
    trees = Trees(6)
    assert trees.tree([(3, 5), (60, 1)]) == trees.tree([(60, 1), (3, 5)])
    assert trees.tree([]) == trees.zeros[-1]
    held = [{rng.randrange(64): rng.randrange(1, 4) for _ in range(rng.choice([0, 3, 60]))} for _ in range(40)]
    held.append({at: 10**13 * (at + 1) for at in range(64)})
    roots = [trees.tree(sorted(h.items())) for h in held]
    totals, v = [sum(h.values()) for h in held], 64
    place, shares = leaf_shares(trees, totals, v)
    pairs = np.array([(i, j, roots[i], roots[j]) for i in range(len(held)) for j in range(len(held)) if i != j])
    assert len(pairs) > PAIRS

    def share(i, at):
        return 1 + 10**9 * (held[i].get(at, 0) + 2) // (totals[i] + 2 * v)

    for (i, j, _, _), got in zip(pairs.tolist(), walked(trees, pairs, place, shares).tolist()):
        assert got == sum((share(i, t) - share(j, t)) ** 2 // (share(i, t) + share(j, t)) for t in range(64))
