"""Language-model scoring over a subword lattice.

A word's probability is summed over all its segmentations into vocabulary pieces by the forward recursion in log space.
The vocabulary is an existing one with a score for each piece, never trained here. Its scores weight the segmentations
twice: as they are (vocabulary_score, to which the end, a token without a piece, adds nothing), and as the prior of piece
probabilities learned from the training part of the corpus (lattice_score): expected counts over all segmentations of each
training word, smoothed by that prior. Pieces that begin a word carry its mark, so that these are probabilities of words.

What the model learns grows with the corpus: in the lattice of ``score`` each word of the training texts has one arc more, across
the whole word, weighted by the word's share of them; the pieces' paths have the weight that is left for new words (as Witten
and Bell estimate it: distinct words over words and distinct words). A text's log10 probability is the sum over its words,
each of which follows with the probability that a text goes on, and of one end token.

What a text needs is a function of its words' counts. Frequent words, a bounded list, are known to every task; the
rest are joined by word in Spark, so the word table may be of any size and no word gathers a share of the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, discard, give_back, require, stash

#: Stands for the end of a text among words; no word holds a blank.
END = b" "
MARK = "▁"
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case; words are runs of anything but ASCII white space, in UTF-8. The end token is not among them."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Vocabulary:
    """Pieces and prior log probabilities. Scores that are ranks (a merge vocabulary) become 1 / (rank + offset); scores that
    are log probabilities are used as they are. Bytes stand for what no piece covers."""

    def __init__(self, path: str, offset: float = 60.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = np.array([model.get_score(i) for i in plain])
        ranks = bool(np.all(scores == np.round(scores)) and scores.min() < -1000)
        prior = -np.log(offset - scores) if ranks else scores
        prior -= np.log(np.exp(prior).sum())
        self.pieces = [model.id_to_piece(i) for i in plain]
        self.prior = dict(zip(self.pieces, prior.tolist(), strict=True))
        self.byte = math.log(1e-7)  # of each byte of a character without a piece


class Lattice:
    """Forward and backward recursions over all segmentations of a word. Pieces are found backwards from their last
    character in a tree of reversed pieces, so that a step costs as much as there are pieces that may end there."""

    def __init__(self, log_p: dict[str, float], byte: float):
        self.byte, self.tree = byte, {}
        for piece, p in log_p.items():
            node = self.tree
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = p
        self.last, self.a, self.g = "", [0.0], [0.0]

    def forward(self, word: str) -> float:
        """Natural log of the word's marginal probability, in log space. What the last word's beginning gave is used again:
        words come sorted."""
        s, a, last = MARK + word, self.a, self.last
        same, most = 0, min(len(s), len(last))
        while same < most and s[same] == last[same]:
            same += 1
        del a[same + 1 :]
        tree, exp, log = self.tree, math.exp, math.log
        for end in range(same + 1, len(s) + 1):
            terms, node, at = [], tree, end
            while at and (node := node.get(s[at - 1])) is not None:
                at -= 1
                if (p := node.get("")) is not None:
                    terms.append(a[at] + p)
            if "" not in tree.get(s[end - 1], _NONE):
                terms.append(a[end - 1] + self.byte * len(s[end - 1].encode("utf-8", "replace")))
            if len(terms) == 1:
                a.append(terms[0])
            else:
                m = max(terms)
                a.append(m + log(sum([exp(t - m) for t in terms])))
        self.last = s
        return a[-1]

    def use(self, word: str, times: float, into: dict[str, float]) -> float:
        """The same as forward(), and adds the expected number of uses of each piece in so many occurrences; finish() adds what is
        still held. Words come sorted: what ends at a place of a shared beginning is gathered there and passed on to earlier
        places once, when no later word shares it."""
        s, last = MARK + word, self.last
        same, most = 0, min(len(s), len(last))
        while same < most and s[same] == last[same]:
            same += 1
        self._pass_on(last, same, into)
        whole = self.forward(word)
        self.g += [0.0] * (len(s) - same)
        self.g[-1] += times
        return whole

    def finish(self, into: dict[str, float]) -> None:
        self._pass_on(self.last, 0, into)
        self.last, self.a, self.g = "", [0.0], [0.0]

    def _pass_on(self, s: str, least: int, into: dict[str, float]) -> None:
        """Divides what ends at each place after ``least`` among the pieces that may end there, by their share in the place's sum."""
        a, g, tree, exp = self.a, self.g, self.tree, math.exp
        for end in range(len(g) - 1, least, -1):
            mass, whole, node, at = g.pop(), a[end], tree, end
            if not mass:
                continue
            while at and (node := node.get(s[at - 1])) is not None:
                at -= 1
                if (p := node.get("")) is not None:
                    uses = mass * exp(a[at] + p - whole)
                    g[at] += uses
                    piece = s[at:end]
                    into[piece] = into.get(piece, 0.0) + uses
            if "" not in tree.get(s[end - 1], _NONE):
                g[end - 1] += mass * exp(a[end - 1] + self.byte * len(s[end - 1].encode("utf-8", "replace")) - whole)


_NONE: dict = {}
DISTINCT = 200_000  # words that a task counts before it passes them on
WORDS_A_TASK = 100_000  # distinct words whose segmentations one task sums: some seconds


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train) -> (word, count in training texts, count), combined over a task as far as memory allows."""
    train, rest = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = [*train, *(w for w in rest if w not in train)]
        c = np.fromiter((train.get(w, 0) for w in words), np.int64, len(words))
        n = c + np.fromiter((rest.get(w, 0) for w in words), np.int64, len(words))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], ["word", "c", "n"])

    for batch in batches:
        for text, in_train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = train if in_train else rest
            own.update(words_of(text.as_py()))
            own[END] += 1
            if len(train) + len(rest) > DISTINCT:
                yield out()
                train.clear()
                rest.clear()
    if train or rest:
        yield out()
    train.clear()
    rest.clear()
    give_back()


def _by_vocabulary(sent):
    """(word, c, n), sorted -> the same with its log10 probability under the vocabulary's own weights; at last rows (piece, uses): the
    expected uses in training words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, into = Lattice(*sent.value), {}
        for f in frames:
            found = [0.0 if w == END else lattice.use(bytes(w).decode(), float(c), into) / LN10 for w, c in zip(f["word"], f["c"], strict=True)]
            yield f.assign(vocabulary=found, piece=None, uses=None)
        lattice.finish(into)
        if into:
            yield pd.DataFrame({"word": None, "c": None, "n": None, "vocabulary": None, "piece": list(into), "uses": list(into.values())})
        del lattice, into
        give_back()

    return run


def _by_corpus(sent):
    """Adds the log10 probabilities under the learned weights: of the pieces' paths, and with the arc across the word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log_p, byte, goes_on, ends, new, known = sent.value
        lattice = Lattice(log_p, byte)
        for f in frames:
            paths = np.array([0.0 if w == END else lattice.forward(bytes(w).decode()) for w in f["word"]])
            is_end = np.array([w == END for w in f["word"]], bool)
            with np.errstate(divide="ignore"):  # an arc that is not there has log 0
                both = np.logaddexp(np.log(new) + paths, np.log(known * f["c"].to_numpy(np.float64)))
            yield f.assign(lattice=np.where(is_end, ends, goes_on + paths) / LN10, score=np.where(is_end, ends, goes_on + both) / LN10)
        del lattice
        give_back()

    return run


class _Head(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


#: What is summed over a text's tokens, with Spark types.
SUMS = {"known": "long", "base": "double", "vocabulary": "double", "lattice": "double", "score": "double"}


def _document_parts(head):
    """(doc_id, text, held_out) -> a row with what frequent words give, and one for each other word of a text."""
    fixed = [("row", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("k", pa.int64()), ("tokens", pa.int64()), *((n, pa.int64() if t == "long" else pa.float64()) for n, t in SUMS.items())]

    def pack(columns: dict, ids: pa.DataType) -> pa.RecordBatch:
        n, schema = len(columns["row"]), [("doc_id", ids), *fixed]
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in schema], [k for k, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *values = head.value
        place, row = _Head(zip(words, range(len(words)), strict=True)), TaskContext.get().partitionId() << 40
        values = [np.append(x, 0) for x in values]  # the last is for words that are not frequent
        for batch in batches:
            id_type = batch.schema.field(0).type
            docs: list[tuple] = []
            rows, rare_words, times = [], [], []
            for text in batch.column(1):
                tokens = words_of(text.as_py())
                tokens.append(END)
                ids = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                docs.append((row, len(tokens), *(v[ids].sum().item() for v in values)))
                if len(rare := np.flatnonzero(ids < 0)):
                    for w, k in Counter([tokens[i] for i in rare.tolist()]).items():
                        rows.append(row)
                        rare_words.append(w)
                        times.append(k)
                row += 1
                if len(rows) > 100_000:
                    yield pack({"row": rows, "word": rare_words, "k": times}, id_type)
                    rows, rare_words, times = [], [], []
            if rows:
                yield pack({"row": rows, "word": rare_words, "k": times}, id_type)
            own = {k: [d[i] for d in docs] for i, k in enumerate(("row", "tokens", *SUMS))}
            yield pack(own | {"doc_id": batch.column(0), "held_out": batch.column(2)}, id_type)
        del place, values, words
        give_back()

    return run


def _at_most(words: DataFrame, column: str, most: int) -> DataFrame:
    """The words with the largest counts, as many as have at least 2**k for the smallest k that leaves at most ``most``."""
    sizes = {r["k"]: r["n"] for r in words.where(F.col(column) > 0).groupBy(F.floor(F.log2(column)).alias("k")).agg(F.count("*").alias("n")).collect()}
    k, held = 63, 0
    while k > 0 and held + sizes.get(k - 1, 0) <= most:
        k -= 1
        held += sizes.get(k, 0)
    return words.where(F.col(column) >= 2**k)


def score_texts(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", hold_out: tuple[int, int] = (7, 2), frequent: int = 100_000
) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    vocabulary_score, lattice_score, score.

    The base is the add-one unigram model over whole words: (c + 1) / (N + V + 1) for each token. Null texts are empty: their
    one token is the end. Rows that repeat an id are texts of their own; ids may be of any type, null ids are in the training
    part; without training texts every count is 0. An empty table gives no rows; other columns are not read. A text may be of
    any length: its score is a sum over its words, each of which is held by itself. Counts cover all texts, piece
    probabilities are fitted on all training words; ``frequent`` bounds the words known to each task.
    """
    require(df, id_col, text_col)
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(crc_mod(F.col(id_col), hold_out[0]) == hold_out[1], F.lit(False)).alias("held_out"))
    counts = rows.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count_words, "word binary, c long, n long")
    words = stash(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    n_train, n_words, every = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count("*")).first()
    # so many words a task, however small their files; sorted, so that words share beginnings
    dealt = lambda df: df.repartition(1 + every // WORDS_A_TASK, "word").sortWithinPartitions("word")

    # under the vocabulary's own weights
    v = Vocabulary(vocabulary)
    word = "word binary, c long, n long, vocabulary double"
    sent = spark.sparkContext.broadcast((v.prior, v.byte))
    weighed = stash(dealt(words).mapInPandas(_by_vocabulary(sent), f"{word}, piece string, uses double"), "words-weighed")
    discard(words)
    # piece probabilities: at most as many rows as the vocabulary has pieces
    got = {r["piece"]: r["uses"] for r in weighed.where("piece is not null").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
    total, weight = sum(got.values()), 5000.0  # the prior counts as so many uses
    is_end = F.col("word") == F.lit(bytearray(END))
    ends = float(weighed.where(is_end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    log_p = {p: math.log((got.get(p, 0.0) + weight * math.exp(q)) / (total + weight)) for p, q in v.prior.items()}
    # a text ends or goes on; a word is a known one, or any by its pieces
    end, n_tokens, distinct = (ends + 1) / (n_train + 2), n_train - ends, n_words - (ends > 0)
    new = distinct / (n_tokens + distinct) if n_tokens else 1.0
    known = (1 - new) / n_tokens if n_tokens else 0.0  # of each time that the word occurs
    sent = spark.sparkContext.broadcast((log_p, v.byte, math.log1p(-end), math.log(end), new, known))
    scored = stash(dealt(weighed.where("word is not null").select("word", "c", "n", "vocabulary")).mapInPandas(_by_corpus(sent), f"{word}, lattice double, score double"), "word-scores")
    discard(weighed)
    log_unit = math.log10(n_train + n_words + 1)
    token = scored.select("word", "n", (F.col("c") > 0).cast("long").alias("known"), (F.log10(F.col("c") + 1) - log_unit).alias("base"), "vocabulary", "lattice", "score")
    top = _at_most(token, "n", frequent).toPandas()  # at most ``frequent`` words
    head = spark.sparkContext.broadcast(([bytes(w) for w in top["word"]], *(top[x].to_numpy() for x in SUMS)))
    made = rows.mapInArrow(_document_parts(head), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, held_out boolean, word binary, k long, tokens long, " + ", ".join(map(" ".join, SUMS.items())))
    parts = stash(made, "parts")
    rare = parts.where("word is not null").select("row", "word", "k").join(token, "word")
    rare = rare.groupBy("row").agg(*(F.sum(F.col("k") * F.col(x)).alias(f"rare_{x}") for x in SUMS))
    texts = parts.where("word is null").join(rare, "row", "left")
    plus = lambda x: F.col(x) + F.coalesce(f"rare_{x}", F.lit(0))
    return texts.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), plus("known").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        plus("base").alias("base_score"), plus("vocabulary").alias("vocabulary_score"), plus("lattice").alias("lattice_score"), plus("score").alias("score"),
    )
