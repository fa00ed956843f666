import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import divergence

SCHEMA = "lang string, source string, text string, term int, n string, block int"


def brute(rows, least, top=10):
    docs, counts, groups = Counter(), Counter(), set()
    for lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        own = sorted(s for x, s in groups if x == lang)
        of = {s: {t: counts[lang, s, t] for t in kept} for s in own}
        p = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        shares = {s: {t: p(c, sum(of[s].values())) for t, c in of[s].items()} for s in own}
        whole = {t: sum(of[s][t] for s in own) for t in kept}
        q = {t: p(c, sum(whole.values())) for t, c in whole.items()}
        for s in own:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-f(shares[s][t], q[t]), t.encode(), t) for t in kept if of[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, name, -v, k) for k, (v, _, name) in enumerate(found, 1)]
    return sorted(out)


def rows_of(n, seed):
    rng = random.Random(seed)
    words = ["Ab", "AB", "über", "Été", "x9y", "zz", "a-b", "çç", "日本", "q"]
    texts = lambda: rng.choice([None, "", "1 2 3", " ".join(rng.choices(words, k=rng.randrange(1, 30)))])
    return [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "", None, "ß"]), texts(), 1, "x", 2) for _ in range(n)]


@pytest.mark.parametrize(("terms", "groups"), [(1024, 128), (2, 128), (3, 2), (1, 1)])
def test_blocks_match_brute_force(spark, terms, groups):
    rows = [*rows_of(80, 5), ("fr", "only", "a b", 1, "x", 2), ("it", "s1", "rare", 1, "x", 2), ("it", "s2", None, 1, "x", 2)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=3, top=2, terms_a_block=terms, groups_a_block=groups)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 2)


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(10, 9 * 10**15)
        c = rng.randrange(0, min(total - 2, 10 ** rng.randrange(1, 16)))
        assert divergence.shares(np.array([[c]]), np.array([[total]]))[0, 0] == 1 + 10**9 * (c + 2) // total


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "BYTES_AT_ONCE", 5)
    body = b"ab cdefghij1k lm" * 30
    assert [t for x in divergence.terms_of(body) for t in x] == re.findall(rb"[a-z]+", body)
    assert list(divergence.terms_of(b"")) == []


def test_tasks_pass_on_bounded_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", 3)
    rows = rows_of(40, 2)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=2).collect())) == brute(rows, 2)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="missing"):
        divergence.audit(spark.range(1))
