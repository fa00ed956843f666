import math
import re
import zlib
from collections import Counter

import pytest

from quarry.llm.common import tokenizer_path
from quarry.llm.lattice import LN10, MARK, Lattice, Vocabulary, _at_most, score_texts, words_of

PATH = tokenizer_path("piece_bpe_32k.model")


def every_segmentation(s, pieces, byte):
    """Sum over all segmentations by plain recursion."""
    if not s:
        return 1.0
    total = 0.0
    for n in range(1, len(s) + 1):
        if s[:n] in pieces:
            total += math.exp(pieces[s[:n]]) * every_segmentation(s[n:], pieces, byte)
    if s[0] not in pieces:
        total += math.exp(byte * len(s[0].encode())) * every_segmentation(s[1:], pieces, byte)
    return total


def test_forward_sums_all_segmentations():
    pieces = {MARK: -2.0, "a": -1.0, "b": -1.5, "ab": -0.7, MARK + "a": -1.2, "ba": -2.2, "aba": -3.0}
    lattice = Lattice(pieces, -9.0)
    for word in ["a", "ab", "aba", "abab", "é", "aéb", "bbbb", "abaab", "abaaba"]:
        assert math.isclose(lattice.forward(word), math.log(every_segmentation(MARK + word, pieces, -9.0)), rel_tol=1e-12)
    uses = {}
    lattice = Lattice(pieces, -9.0)
    assert math.isclose(lattice.use("abab", 2.0, uses), math.log(every_segmentation(MARK + "abab", pieces, -9.0)))
    lattice.finish(uses)
    assert math.isclose(sum(len(p) * u for p, u in uses.items()), 2.0 * 5)
    assert lattice.forward("a" * 5000) > -math.inf  # nothing underflows


def expected(pieces, byte, words):
    lattice, got = Lattice(pieces, byte), {}
    for w, c in words:
        lattice.use(w, c, got)
    lattice.finish(got)
    return got


def test_expected_uses_of_many_words():
    pieces = {MARK: -2.0, "a": -1.0, "b": -1.5, "ab": -0.7, MARK + "a": -1.2, "ba": -2.2, "aba": -3.0}
    words = {"a": 3.0, "ab": 1.0, "aba": 2.0, "abab": 1.0, "abé": 4.0, "b": 1.0, "é": 2.0}
    want = Counter()
    for word, times in words.items():
        s = MARK + word
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in pieces:
                    around = every_segmentation(s[:i], pieces, -9.0) * math.exp(pieces[s[i:j]]) * every_segmentation(s[j:], pieces, -9.0)
                    want[s[i:j]] += times * around / every_segmentation(s, pieces, -9.0)
    for order in (sorted(words), list(words)[::-1]):
        got = expected(pieces, -9.0, [(w, words[w]) for w in order])
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_every_training_word_is_fitted(spark):
    """More than 50,000 words, each seen once, teach as much as any others."""
    texts = [(1000 + i, " ".join(f"qq{i}zz{j}" for j in range(200))) for i in range(300)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = sorted(w for d, t in texts if not held(d) for w in t.split())
    assert len(train) > 50_000
    v = Vocabulary(PATH)
    uses = expected(v.prior, v.byte, [(w, 1.0) for w in train])
    total, ends = sum(uses.values()), sum(not held(d) for d, _ in texts)
    fitted = Lattice({p: math.log((uses.get(p, 0.0) + 5000 * math.exp(q)) / (total + 5000)) for p, q in v.prior.items()}, v.byte)
    end = (ends + 1) / (len(train) + ends + 2)
    out = score_texts(spark.createDataFrame(texts, "doc_id long, text string"), PATH).where("doc_id < 1003").collect()
    for r in out:
        words = texts[r.doc_id - 1000][1].split()
        paths = [math.log1p(-end) + fitted.forward(w) for w in words]
        assert math.isclose(r.lattice_score, (sum(paths) + math.log(end)) / LN10, rel_tol=1e-9)
        # half of the words and distinct words are new ones: each was seen once
        arcs = [math.log((1 - end) * (0.5 * (not held(r.doc_id)) / len(train) + 0.5 * math.exp(fitted.forward(w)))) for w in words]
        assert math.isclose(r.score, (sum(arcs) + math.log(end)) / LN10, rel_tol=1e-9)


def test_words_have_a_distribution(spark):
    """Over all words of a small vocabulary's letters, the paths of pieces add up to 1, and so do the words that the model knows or not."""
    pieces = {MARK: 0.1, MARK + "a": 0.3, "a": 0.2, "b": 0.25, "ab": 0.15}
    lattice = Lattice({p: math.log(x) for p, x in pieces.items()}, -50.0)
    total, words = 0.0, [""]
    for _ in range(14):
        words = [w + c for w in words for c in "ab"]
        total += sum(math.exp(lattice.forward(w)) for w in words)
    left = 1 - total - pieces[MARK]  # longer words, and the mark alone, which is no word
    assert 0 < left < 0.03


def test_vocabulary_is_a_distribution():
    v = Vocabulary(PATH)
    assert math.isclose(sum(map(math.exp, v.prior.values())), 1.0, rel_tol=1e-9)


def brute_base(rows, digits=6):
    """The contract, word for word: each token adds log10((c+1)/(N+1*(V+1))), where 1*(V+1) is a product and N is added to it."""

    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" end"]

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    N, V = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        score = sum(math.log10((c[w]+1)/(N+1*(V+1))) for w in tokens(t))
        out.append((d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), N, round(score, digits)))
    return sorted(out, key=repr)


def test_base_by_hand(spark):
    """Training texts "a b a" and "a": N = 6 with two ends, V = 3. Text 1 is held out: a is seen 3 times, z never, the end twice."""
    train = [d for d in range(50) if zlib.crc32(str(d).encode()) % 7 != 2][:2]
    held = next(d for d in range(50) if zlib.crc32(str(d).encode()) % 7 == 2)
    out = score_texts(spark.createDataFrame([(train[0], "a b A"), (train[1], "a"), (held, "a z")], "doc_id long, text string"), PATH).collect()
    row = next(r for r in out if r.doc_id == held)
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 2, 6)
    assert math.isclose(row.base_score, math.log10(4 / 10) + math.log10(1 / 10) + math.log10(3 / 10))


ROWS = [(i, f"the word{i % 7} of rare{i}  The\tEND") for i in range(80)] + [(200, None), (201, ""), (202, "é É x\x1cy"), (3, "again again"), (3, "again again"), (None, "no id here"), (203, "long " * 30_000)]


@pytest.mark.parametrize("frequent", [100_000, 4])
def test_base_and_score(spark, frequent):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, word int")
    out = score_texts(df, PATH, frequent=frequent).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr)
    assert got == brute_base(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[200].score == by[201].score and by[200].score > -3
    assert all(r.score < 0 for r in out)


def test_frequent_words_change_nothing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in score_texts(df, PATH, frequent=n).collect()} for n in (100_000, 0))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_whole_table(spark):
    """The base on every row, and that learning from the corpus helps on texts it has not seen."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = score_texts(df, PATH).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out), key=repr)
    assert got == brute_base([(r.doc_id, r.text) for r in df.collect()], 4)
    unseen = [r for r in out if r.held_out and r.n_tokens > 50]
    assert len(unseen) > 60
    for better, worse in (("lattice_score", "vocabulary_score"), ("score", "lattice_score")):
        assert sum(r[better] > r[worse] for r in unseen) > 0.9 * len(unseen)


def test_vocabulary_score_and_ids_of_any_type(spark):
    """Without training texts the corpus adds nothing but that a text goes on or ends alike."""
    held = [str(d) for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    df = spark.createDataFrame([(d, f"some words {d} and é") for d in held], "doc_id string, text string")
    out = score_texts(df, PATH).collect()
    assert sorted(r.doc_id for r in out) == sorted(held)
    v = Vocabulary(PATH)
    own = Lattice(v.prior, v.byte)
    for r in out:
        words = f"some words {r.doc_id} and é".split()
        assert r.held_out and r.n_known == r.train_tokens == 0
        assert math.isclose(r.vocabulary_score * LN10, sum(map(own.forward, words)))
        assert math.isclose(r.score * LN10, sum(map(own.forward, words)) + (len(words) + 1) * math.log(0.5)) and math.isclose(r.score, r.lattice_score)


def test_bounds_and_empty_table(spark):
    words = spark.createDataFrame([(str(i), i) for i in range(100)], "word string, n long")
    for most in (0, 1, 5, 40, 1000):
        got = [r.n for r in _at_most(words, "n", most).collect()]
        assert len(got) <= most and set(got) == {n for n in range(1, 100) if n >= min(got, default=1000)}
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert score_texts(df.limit(0), PATH).count() == 0


def test_words():
    assert words_of("A\x0bb \x85c\xa0É") == [b"a", b"b", "\x85c\xa0É".encode()]
    assert LN10 == math.log(10)
