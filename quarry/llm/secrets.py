"""Secret scan by a linear-chain conditional random field.

A text's white-space tokens are tagged begin, inside or outside. A token's score comes from its shape, length and
mix of characters, from the kind of the two tokens before it and of the one after it, and from features of the
whole text; transitions are learned as well. The field is trained in numpy by its exact gradient (forward and
backward recursion), on the driver, from a bounded sample: pieces of training texts labelled by the fixed patterns,
and written examples of keys, tokens and look-alikes that are none. Viterbi decoding is exact: where the outside score
beats the others by more than any two transitions can repay, the best path is outside, so only the stretches between
such tokens are decoded.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, require

#: The fixed patterns: kind, pattern, least length of the match or of the given group.
_ANY = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
_KEYS = "|".join([_ANY("password"), _ANY("passwd"), _ANY("secret"), _ANY("token"), _ANY("api") + "_?" + _ANY("key")])
BASE = [
    ("assign", re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
KINDS = [k for k, *_ in BASE] + ["crf"]
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of [0-9a-f]+ that are long enough
_HINT = re.compile("[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind), by start and then by kind."""
    out = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        if name == "access" and "AKIA" not in text or name == "assign" and not _HINT.search(text):
            continue
        pattern = _LONG_HEX if name == "hex" else pattern
        out += [(*m.span(), k) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], s[2]))


B, I, O = range(3)
BUCKETS = 1 << 12
N_CONTEXT = 10
FILE = 6
KEYWORDS = ("key", "token", "secret", "passw", "pwd", "auth", "cred", "bearer", "api", "private")
_DIGITS = frozenset("0123456789")


def names_a_secret(token: str) -> bool:
    low = token.lower()
    return any([w in low for w in KEYWORDS])


def context(token: str, keyword: bool | None = None) -> int:
    """What a token says about its neighbours."""
    if token in ("=", ":", ":=", "=>", "->"):
        return 1
    mark = token[-1] in "=:"
    if names_a_secret(token) if keyword is None else keyword:
        return 3 if mark else 2
    if mark:
        return 4
    if token.isalpha():
        return 5 if token[0].islower() else 6
    if not _DIGITS.isdisjoint(token):
        return 7 if len(token) < 16 else 8
    return 9


class _Classes(dict):
    """ASCII letters by case and vowel, digits as 0, what is not ASCII as one class, punctuation as itself."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = "\x7f" if c > 127 else "0" if x.isdigit() else x if not x.isalpha() else ("E" if x in "AEIOU" else "A") if x.isupper() else "e" if x in "aeiou" else "a"
        return self[c]


_CLASSES = _Classes()
_COLLAPSED = re.compile(r"([ae])[ae]*|([AE])[AE]*|(0)0*|(\x7f)\x7f*")
_EDGES = "\"'`,;.()[]{}<>"


def outline(token: str) -> tuple:
    """All that features() depends on, from the whole token: its first runs of character classes, four signs, how many runs,
    length, digits, capitals, vowels, a key word."""
    classes = token.translate(_CLASSES)
    core = classes.strip(_EDGES)
    runs = _COLLAPSED.sub(lambda m: "a" if m[1] else "A" if m[2] else m[0][0], classes)
    signs = ("=" in runs[:-1], "@" in runs, "://" in runs, chr(127) in runs)
    return runs[:6], signs, len(runs), len(core), core.count("0"), core.count("A") + core.count("E"), core.count("e") + core.count("E"), names_a_secret(token)


def features(token: str) -> list[int]:
    """Feature buckets of a token by itself."""
    return _features(*outline(token))


def _features(start: str, signs: tuple[bool, ...], n_runs: int, n: int, digits: int, upper: int, vowels: int, keyword: bool) -> list[int]:
    m = max(1, n)
    names = [
        "s" + start, f"n{min(n // 4, 16)}", f"d{8 * digits // m}", f"r{min(n_runs, 14)}", f"u{4 * upper // m}", f"v{8 * vowels // m}", f"k{keyword}",
        "e" + "".join(map(str, signs)), f"j{min(n // 8, 6)}.{4 * digits // m}.{min(n_runs, 20) // 4}",
    ]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def file_features(text: str, n_tokens: int) -> list[int]:
    hint = names_a_secret(text)
    return [0 + hint, 2 + (n_tokens > 200), 4 + ("=" in text)]


class Field:
    """Weights: own (buckets x 3), before1, before2, after (contexts x 3), file (3), between (3 x 3), first (3)."""

    def __init__(self):
        self.w = {"own": np.zeros((BUCKETS, 3)), "file": np.zeros((FILE, 3)), "between": np.zeros((3, 3)), "first": np.zeros(3)}
        self.w |= {k: np.zeros((N_CONTEXT, 3)) for k in ("before1", "before2", "after")}

    def emissions(self, own: np.ndarray, ctx: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Scores of every token of one text. own: (n, 3) sums of token features; ctx: padded by two before and one after."""
        w, n = self.w, len(own)
        return own + w["before1"][ctx[1 : n + 1]] + w["before2"][ctx[:n]] + w["after"][ctx[3 : n + 3]] + file

    def train(self, sequences: list[tuple[list[list[int]], list[int], list[int], list[int]]], rounds: int = 80, rate: float = 0.35, decay: float = 2e-4) -> float:
        """Adagrad on the mean negative log likelihood. sequences: token features, contexts, file features, tags."""
        n, t = len(sequences), max(len(s[3]) for s in sequences)
        k = max(len(f) for s in sequences for f in s[0])
        own, real = np.full((n, t, k), BUCKETS), np.zeros((n, t), bool)
        ctx, file, tags = np.zeros((n, t + 3), int), np.zeros((n, FILE)), np.full((n, t), O)
        for i, (f, c, g, y) in enumerate(sequences):
            for j, x in enumerate(f):
                own[i, j, : len(x)] = x
            real[i, : len(y)], tags[i, : len(y)] = True, y
            ctx[i, 2 : 2 + len(c)] = c
            file[i, g] = 1
        gold, last = np.eye(3)[tags] * real[..., None], real.sum(1) - 1
        sums, loss = {}, 0.0
        both = (real[:, 1:] & real[:, :-1])[..., None, None]
        gold_pairs = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both).sum((0, 1))
        for _ in range(rounds):
            w = self.w
            e = np.concatenate((w["own"], np.zeros((1, 3))))[own].sum(2) + w["before1"][ctx[:, 1 : t + 1]] + w["before2"][ctx[:, :t]] + w["after"][ctx[:, 3:]] + (file @ w["file"])[:, None]
            a, b = np.empty((n, t, 3)), np.zeros((n, t, 3))
            a[:, 0] = e[:, 0] + w["first"]
            for j in range(1, t):
                a[:, j] = np.where(real[:, j, None], _lse(a[:, j - 1, :, None] + w["between"], 1) + e[:, j], a[:, j - 1])
            z = _lse(a[np.arange(n), last], 1)
            for j in range(t - 2, -1, -1):
                b[:, j] = np.where(real[:, j + 1, None], _lse(w["between"] + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), 0)
            p = np.exp(a + b - z[:, None, None]) * real[..., None]
            pairs = (np.exp(a[:, :-1, :, None] + w["between"] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both).sum((0, 1))
            score = (gold * e).sum() + (gold[:, 0] @ w["first"]).sum() + (gold_pairs * w["between"]).sum()
            loss = float((z.sum() - score) / n)
            d = p - gold
            grad = {"between": pairs - gold_pairs, "first": d[:, 0].sum(0), "file": file.T @ d.sum(1)}
            flat = own.reshape(-1)
            grad["own"] = np.stack([np.bincount(flat, np.repeat(d[..., s].reshape(-1), k), BUCKETS + 1)[:-1] for s in range(3)], 1)
            for name, at in (("before1", slice(1, t + 1)), ("before2", slice(0, t)), ("after", slice(3, None))):
                grad[name] = np.stack([np.bincount(ctx[:, at].reshape(-1), d[..., s].reshape(-1), N_CONTEXT) for s in range(3)], 1)
            for name, g in grad.items():
                g = g / n + decay * w[name]
                sums[name] = sums.get(name, 1e-8) + g * g
                w[name] -= rate * g / np.sqrt(sums[name])
        return loss

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each run of emissions (n, 3). A run lies between tokens that are outside, or at a text's edge:
        the caller has added those neighbours' transitions to its first and last row."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        out: list[np.ndarray] = [np.empty(0, int)] * len(runs)
        between = self.w["between"]
        for a in range(0, len(order), 4096):
            own = order[a : a + 4096]
            sizes = np.array([len(runs[i]) for i in own])
            score = np.stack([runs[i][0] for i in own])
            back = []
            for j in range(1, sizes[0]):
                live = int(np.searchsorted(-sizes, -j, "left"))  # runs longer than j
                every = score[:live, :, None] + between
                back.append(every.argmax(1))
                score[:live] = every.max(1) + np.stack([runs[i][j] for i in own[:live]])
            best = score.argmax(1)
            for r, i in enumerate(own):
                tags = np.empty(sizes[r], int)
                tags[-1] = best[r]
                for j in range(sizes[r] - 2, -1, -1):
                    tags[j] = back[j][r, tags[j + 1]]
                out[i] = tags
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def trimmed(token: str) -> tuple[int, int]:
    """The part of a secret token that is the secret: without a name and sign before it, quotes and punctuation around it."""
    a, b = 0, len(token)
    if m := re.match(r"[\"'`({\[<]*[A-Za-z_.\-]*(?:=|:(?!//))+", token):
        a = m.end() if m.end() < b else 0
    while a < b and token[a] in "\"'`({[<":
        a += 1
    while b > a and token[b - 1] in "\"'`)}]>,;.":
        b -= 1
    return (a, b) if a < b else (0, len(token))


class Scanner:
    """Applies a trained field to whole texts. Remembers what distinct tokens score, up to a bound."""

    def __init__(self, field: Field, remember: int = 250_000, block: int = 1 << 17):
        self.field, self.remember, self.block = field, remember, block
        # what two transitions can repay at most; a text's first token has its own instead of the one before it
        inner, first = (float(x.max() - x.min()) for x in (field.w["between"], field.w["first"]))
        self.certain, self.certain_first = 2 * inner + 1e-6, inner + first + 1e-6
        self.known: dict[str, int] = {}
        self.outlines: dict[tuple, np.ndarray] = {}
        self.scores, self.contexts = np.zeros((1024, 3)), np.zeros(1024, np.int64)

    def _add(self, token: str) -> int:
        k = len(self.known)
        if k >= len(self.scores):
            self.scores, self.contexts = np.resize(self.scores, (2 * k, 3)), np.resize(self.contexts, 2 * k)
        self.known[token] = k
        seen = outline(token)
        if (score := self.outlines.get(seen)) is None:
            if len(self.outlines) > 100_000:
                self.outlines.clear()
            score = self.outlines[seen] = self.field.w["own"][_features(*seen)].sum(0)
        self.scores[k], self.contexts[k] = score, context(token, seen[-1])
        return k

    def runs(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """(first token, emissions) of each stretch of tokens that may not be outside."""
        tokens = text.split()
        if not tokens:
            return
        if len(self.known) > self.remember:
            self.known.clear()
        w, n = self.field.w, len(tokens)
        file = w["file"][file_features(text, n)].sum(0)
        held: tuple[int, list[np.ndarray]] | None = None
        for at in range(0, n, self.block):
            end = min(n, at + self.block)
            a, b = max(0, at - 2), min(n, end + 1)
            part = tokens[a:b]
            found = list(map(self.known.get, part))
            if None in found:
                found = [self.known[x] if x in self.known else self._add(x) for x in part]
            ids = np.array(found, np.int64)
            ctx = np.zeros(end - at + 3, np.int64)
            ctx[2 - (at - a) : 2 - (at - a) + len(ids)] = self.contexts[ids]
            e = self.field.emissions(self.scores[ids[at - a : at - a + end - at]], ctx, file)
            ahead = e[:, O] - np.maximum(e[:, B], e[:, I])
            if not at:
                ahead[0] += self.certain - self.certain_first
            may = np.flatnonzero(ahead <= self.certain)
            for run in np.split(may, np.flatnonzero(np.diff(may) > 1) + 1):
                if len(run):
                    if held and held[0] + sum(map(len, held[1])) == at + run[0]:
                        held[1].append(e[run])
                        continue
                    if held:
                        yield self._closed(*held, n)
                    held = (at + int(run[0]), [e[run]])
        if held:
            yield self._closed(*held, n)

    def _closed(self, first: int, parts: list[np.ndarray], n: int) -> tuple[int, np.ndarray]:
        e = np.concatenate(parts)
        between = self.field.w["between"]
        e[0] += between[O] if first else self.field.w["first"]
        if first + len(e) < n:
            e[-1] += between[:, O]
        return first, e

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Secret spans of each text in code points."""
        where, runs = [], []
        for i, text in enumerate(texts):
            for first, e in self.runs(text):
                where.append((i, first))
                runs.append(e)
        found: list[dict[int, int]] = [{} for _ in texts]
        for (i, first), tags in zip(where, self.field.decode(runs), strict=True):
            for j in np.flatnonzero(tags != O).tolist():
                found[i][first + j] = int(tags[j])
        out = []
        for text, tags in zip(texts, found, strict=True):
            own: list[tuple[int, int]] = []
            if tags:
                last, k, end = max(tags), -2, 0
                for j, m in enumerate(_tokens(text)):
                    if j in tags:
                        a, b = trimmed(m.group())
                        if tags[j] == I and k == j - 1 and own:
                            own[-1] = (own[-1][0], m.start() + b)
                        else:
                            own.append((m.start() + a, m.start() + b))
                        k = j
                    if j >= last:
                        break
            out.append(own)
        return out


#: The white space at which str.split() cuts, as a pattern.
_SPACE = "".join(sorted(c for c in map(chr, range(0x3001)) if c.isspace()))
_WORD = re.compile(f"[^{re.escape(_SPACE)}]+")


def _tokens(text: str) -> Iterator[re.Match]:
    return _WORD.finditer(text)


def examples(rng: np.random.Generator, n: int) -> list[tuple[list[str], list[int]]]:
    """Written training sequences: secrets of many shapes in many settings, and look-alikes that are none."""
    hexes, low, both = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda s, a, b: "".join(rng.choice(list(s), rng.integers(a, b)))
    pick = lambda *s: s[rng.integers(len(s))]
    words = "the value of this setting is stored here and should not be shared with anyone who reads the file line".split()
    out = []
    for _ in range(n):
        secret = pick(
            lambda: draw(hexes, 20, 65), lambda: draw(both, 20, 50), lambda: draw(both + "+/", 24, 64) + pick("", "=", "=="), lambda: "sk-" + draw(both, 24, 48), lambda: "ghp_" + draw(both, 36, 37),
            lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 17), lambda: "xoxb-" + draw("0123456789", 10, 13) + "-" + draw(both, 20, 26), lambda: draw(both, 10, 20) + "." + draw(both, 30, 60) + "." + draw(both + "-_", 30, 44),
            lambda: draw(low, 14, 30) + draw("!#$%", 1, 3) + draw(both, 4, 9),
        )()
        clean = pick(
            lambda: draw("0123456789", 4, 18), lambda: draw(low, 3, 8) + "@" + draw(low, 4, 9) + ".example.com", lambda: "https://" + draw(low, 5, 9) + ".example.com/" + draw(low, 3, 12), lambda: "2024-0%d-1%d" % (rng.integers(1, 9), rng.integers(0, 9)),
            lambda: "v%d.%d.%d" % tuple(rng.integers(0, 20, 3)), lambda: "%d.%d" % tuple(rng.integers(0, 900, 2)), lambda: "+1-555-%04d" % rng.integers(0, 9999), lambda: "192.168.%d.%d" % tuple(rng.integers(0, 255, 2)), lambda: draw(low[:26], 12, 30), lambda: "snake_case_" + draw(low[:26], 4, 9),
            lambda: "CamelCase" + draw(low[:26], 4, 9).title() + "Name", lambda: pick("key", "token", "secret") + pick("", "s", ","), lambda: "###", lambda: "---------------------",
        )()
        before = [words[i] for i in rng.integers(0, len(words), rng.integers(1, 7))]
        after = [words[i] for i in rng.integers(0, len(words), rng.integers(1, 7))]
        q = pick('"', "'", "")
        if rng.random() < 0.5:
            middle, tags = pick(
                lambda: ([pick("token", "api_key", "secret", "password", "client_secret"), "=", q + secret + q], [O, O, B]), lambda: ([pick("Token:", "key:", "Authorization:", "AWS_SECRET="), secret], [O, B]),
                lambda: (["Bearer", secret], [O, B]), lambda: ([pick("export KEY=", "api_key=", "auth:") + q + secret + q], [B]), lambda: ([q + secret + q], [B]), lambda: (["key", "=", secret[:18], secret[18:]], [O, O, B, I]) if len(secret) > 34 else (["key", "=", secret], [O, O, B]),
            )()
            if len(middle[0].split()) > 1:
                middle, tags = middle[0].split() + middle[1:], [O, *tags]
        else:
            middle, tags = pick(lambda: ([clean], [O]), lambda: (["value", "=", clean], [O, O, O]), lambda: ([clean, clean], [O, O]))()
        out.append(([*before, *middle, *after], [O] * len(before) + tags + [O] * len(after)))
    return out


def train_field(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 600, around: int = 7, written: int = 4000, stretch: int = 4000, hold_out: tuple[int, int] = (3, 1), seed: int = 5) -> Field:
    """Trains on the sample_rows texts outside the held-out fold, chosen by hashes of id and text: of each a ``stretch`` of so many
    characters from a hashed place, around what the fixed patterns find and at two other places; and on written examples."""
    require(df, id_col, text_col)
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    at = (1 + F.pmod(h, F.greatest(F.length(text_col) - stretch, F.lit(1)))).cast("int")
    rows = df.where(F.col(text_col).isNotNull() & (F.coalesce(crc_mod(F.col(id_col), hold_out[0]), F.lit(0)) != hold_out[1])).select(h.alias("h"), F.substring(F.col(text_col), at, F.lit(stretch)).alias("part"))
    # about twice as many as needed by the hash alone, so that little is sorted
    share = min(1.0, 2 * (sample_rows + 20) / max(1, rows.count()))
    near = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share * (1 << 30))
    rng, sequences = np.random.default_rng(seed), []
    for r in near.orderBy("h", "part").limit(sample_rows).collect():
        text = r["part"]
        tokens = list(_tokens(text))
        if not tokens:
            continue
        base = base_spans(text)
        hit = [any(m.start() < b and a < m.end() and (k != 0 or m.end() >= b) for a, b, k in base) for m in tokens]
        tags = [O if not x else B for x in hit]
        centres = [j for j, x in enumerate(hit) if x] + rng.integers(0, len(tokens), 2).tolist()
        for c in centres:
            own = range(max(0, c - around), min(len(tokens), c + around + 1))
            sequences.append(([tokens[j].group() for j in own], [tags[j] for j in own], text))
    sequences += [(t, y, " ".join(t)) for t, y in examples(rng, written)]
    field = Field()
    field.train([([features(x) for x in t], [context(x) for x in t], file_features(text, len(text.split())), y) for t, y, text in sequences])
    return field


def uncovered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans that base spans (by start), taken together, do not cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [(a, b) for a, b in spans if not (i := bisect_right(starts, a)) or ends[i - 1] < b]


_SPANS = "array<struct<start:int,end:int,kind:int>>"


def find(field: Field, text: Column) -> Column:
    """An array column of all spans (start, end, kind) of a text column, by start and then kind. Null texts have none. What the
    field finds is added unless the fixed patterns' spans cover it."""

    @F.pandas_udf(_SPANS)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(field)
        for s in it:
            out: list[list[dict]] = []
            for at in range(0, len(s), 256):
                texts = [t or "" for t in s.iloc[at : at + 256]]
                for text, extra in zip(texts, scanner.spans(texts), strict=True):
                    base = base_spans(text)
                    crf = [(a, b, 3) for a, b in uncovered(extra, base)]
                    out.append([{"start": a, "end": b, "kind": k} for a, b, k in sorted(base + crf, key=lambda x: (x[0], x[2]))])
            yield pd.Series(out)

    return run(text)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id and spans (start, end, kind, in code points), by start and then kind.

    Null and empty texts have no spans. Rows may repeat, and ids be repeated or null; spans of two kinds at one place both stay,
    in the order of KINDS; whole texts are read, of any length: a task holds a batch of texts and the scores of a bounded
    number of tokens. Other columns are not read, whatever their names. An empty table gives no rows."""
    return df.select(F.col(id_col).alias("doc_id"), find(train_field(df, id_col, text_col), F.col(text_col)).alias("spans"))


def digests(df: DataFrame) -> DataFrame:
    """The counts and digests of scan()'s result, one row per row: n_assign, n_access, n_hex, base_sha256, spans. Without spans the counts
    are 0 and the texts empty; nulls, ties, repeats and empty tables are as in scan()."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return df.select("doc_id", *counts, F.sha2(said(lambda x: x["kind"] < 3), 256).alias("base_sha256"), said(lambda x: x["kind"] >= 0).alias("spans"))
