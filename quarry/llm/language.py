"""Language identification by a bidirectional gated recurrent network over bytes.

Each byte looks up its input contribution, two recurrences run over a text in both directions, and a linear layer on both states
labels every position with language probabilities. A document's probabilities are the mean over its positions. Texts
longer than a window are read in windows that overlap, so that every position has context on both sides. The network is trained in numpy by backpropagation through time, on the driver, from a bounded
sample of labelled snippets; its few thousand weights travel to the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, give_back, require

PAD = 256
UNKNOWN = "und"


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Gates in the order update, reset, candidate. ``w`` holds for each direction d: x{d} (bytes x 3h), u{d} (h x 3h), b{d} (h, of
    the candidate's recurrent part), and for the output: out (2h x labels), bias."""

    def __init__(self, labels: list[str], hidden: int = 10, seed: int = 7):
        self.labels, self.hidden = labels, hidden
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": draw(PAD + 1, 3 * hidden), f"u{d}": draw(hidden, 3 * hidden), f"b{d}": np.zeros(hidden, np.float32)}
        self.w |= {"out": draw(2 * hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, batch, h) of one direction over bytes x (time, batch)."""
        h, (xs, u, b) = self.hidden, (self.w[f"{k}{d}"] for k in "xub")
        out = np.empty((*x.shape, h), np.float32)
        state = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            g, r = xs[x[t]], state @ u
            zr = g[:, : 2 * h] + r[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, reset = zr[:, :h], zr[:, h:]
            inner = r[:, 2 * h :] + b
            new = np.tanh(g[:, 2 * h :] + reset * inner)
            if keep is not None:
                keep.append((t, state, z, reset, inner, new))
            state = new + z * (state - new)
            out[t] = state
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (time, batch, labels) of every position."""
        h = self.hidden
        y = self.states(x, "f").reshape(-1, h) @ self.w["out"][:h] + self.states(x, "b").reshape(-1, h) @ self.w["out"][h:] + self.w["bias"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions that are not padding, and its gradients by backpropagation through time."""
        h, kept = self.hidden, {"f": [], "b": []}
        both = {d: self.states(x, d, kept[d]) for d in "fb"}
        y = sum(both[d] @ self.w["out"][s] for d, s in (("f", slice(0, h)), ("b", slice(h, None)))) + self.w["bias"]
        y -= y.max(2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(2, keepdims=True)
        real = (x != PAD).astype(np.float32)
        n = max(1.0, float(real.sum()))
        loss = float(-(np.log(np.take_along_axis(p, label[None, :, None], 2)[:, :, 0] + 1e-9) * real).sum() / n)
        dy = p.copy()
        np.put_along_axis(dy, np.broadcast_to(label[None, :, None], (*x.shape, 1)).copy(), np.take_along_axis(dy, np.broadcast_to(label[None, :, None], (*x.shape, 1)), 2) - 1, 2)
        dy *= (real / n)[:, :, None]
        flat = dy.reshape(-1, dy.shape[2])
        grad = {"bias": flat.sum(0), "out": np.concatenate([both[d].reshape(-1, h).T @ flat for d in "fb"])}
        for d, s in (("f", slice(0, h)), ("b", slice(h, None))):
            u, dout = self.w[f"u{d}"], dy @ self.w["out"][s].T
            gx, gu, gb = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u), np.zeros_like(self.w[f"b{d}"])
            dstate = np.zeros_like(dout[0])
            for t, before, z, reset, inner, new in reversed(kept[d]):
                ds = dstate + dout[t]
                dnew = ds * (1 - z) * (1 - new * new)
                dz = ds * (before - new) * z * (1 - z)
                dreset = dnew * inner * reset * (1 - reset)
                dinner = dnew * reset
                rec = np.concatenate((dz, dreset, dinner), 1)
                gu += before.T @ rec
                gb += dinner.sum(0)
                inp = np.concatenate((dz, dreset, dnew), 1)
                np.add.at(gx, x[t], inp)
                dstate = ds * z + rec @ u.T
            grad |= {f"x{d}": gx, f"u{d}": gu, f"b{d}": gb}
        return loss, grad

    def train(self, x: np.ndarray, label: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 11) -> float:
        """Adam on batches of windows x (time, windows). Returns the last loss."""
        rng, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        for step in range(1, steps + 1):
            own = rng.integers(0, x.shape[1], min(batch, x.shape[1]))
            loss, grad = self.gradients(x[:, own], label[own])
            fade = rate * (1 if step < 0.6 * steps else 0.2)
            for k, g in grad.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.w[k] -= (fade * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss


def windows(texts: list[np.ndarray], width: int, margin: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts cut into windows (time, windows), padded at the end; the text of each window, and which of its positions count.

    Neighbouring windows share 2 * margin bytes; of these the first half counts in the earlier one and the second in the later
    one, so that each byte counts once, with at least ``margin`` bytes of the text on either side."""
    step = width - 2 * margin
    n = np.array([0 if not len(t) else 1 + max(0, -(-(len(t) - width) // step)) for t in texts], np.int64)
    out = np.full((int(n.sum()), width), PAD, np.int16)
    counts = np.ones(out.shape, bool)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        for w in range(k):
            own = t[w * step : w * step + width]
            out[at, : len(own)] = own
            at += 1
        counts[at - k + 1 : at, :margin] = False
        counts[at - k : max(at - k, at - 1), width - margin :] = False
    return np.ascontiguousarray(out.T), np.repeat(np.arange(len(texts)), n), np.ascontiguousarray((counts & (out != PAD)).T)


def pooled(model: BiGru, texts: list[np.ndarray], width: int, margin: int = 0, at_once: int = 768) -> np.ndarray:
    """Mean position probabilities of each text (zeros for an empty one). Holds at_once windows' states at a time."""
    total = np.zeros((len(texts), len(model.labels)))
    group, held = [], 0

    def run(docs: list[int]) -> None:
        x, of, counts = windows([texts[d] for d in docs], width, margin)
        of = np.array(docs)[of]
        for a in range(0, x.shape[1], at_once):
            own = slice(a, a + at_once)
            p = model.probabilities(x[:, own])
            p *= counts[:, own, None]
            np.add.at(total, of[own], p.sum(0))

    for d, t in enumerate(texts):
        group.append(d)
        held += len(t)
        if held > 16 * at_once * width:
            run(group)
            group, held = [], 0
    if group:
        run(group)
    return total / np.maximum([[len(t)] for t in texts], 1)


def train_language_model(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 2400, snippet: int = 480, width: int = 48, hold_out: tuple[int, int] = (3, 1), hidden: int = 10, steps: int = 260
) -> BiGru | None:
    """Trains on at most about sample_rows labelled rows (the same number for each label, chosen by a hash of id and text), a
    snippet of so many characters of each from a hashed place. Rows of the held-out fold are never read. None if no row is
    labelled, or no sampled snippet has a letter."""
    require(df, id_col, text_col, label_col)
    fold = crc_mod(F.col(id_col), hold_out[0])
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(fold, F.lit(0)) != hold_out[1]))
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = rows.select(
        F.col(label_col).cast("string").alias("label"), h.alias("h"),
        F.substring(F.col(text_col), (1 + F.pmod(h, F.greatest(F.length(text_col) - snippet, F.lit(1)))).cast("int"), F.lit(snippet)).alias("part"),
    )
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    each = max(8, sample_rows // len(counts))
    # about twice as many as needed of each label, by the hash alone; then exactly so many
    share = F.create_map(*(F.lit(x) for label, n in sorted(counts.items()) for x in (label, min(1.0, 2 * (each + 20) / n))))
    near = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    order = Window.partitionBy("label").orderBy("h", "part")
    found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).toPandas().sort_values(["label", "rank"])
    labels = sorted(found["label"].unique())
    found = found[[has_letter(t) for t in found["part"]]]
    if not len(found):
        return None
    x, of, _ = windows([bytes_of(t) for t in found["part"]], width)
    y = np.array([labels.index(v) for v in found["label"]])[of]
    model = BiGru(labels, hidden)
    model.train(x, y, steps)
    return model


def predict(model: BiGru | None, text: Column, width: int = 192, margin: int = 16) -> Column:
    """A struct column (lang_pred, score) from whole texts of any length: a task holds a batch of texts and the states of some
    windows. Null texts and texts without a letter are ``und`` with score 0,
    and so is every text when there was nothing to learn from. Ties go to the first label in order."""

    @F.pandas_udf("struct<lang_pred string, score double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            lang, score = [UNKNOWN] * len(s), np.zeros(len(s))
            own = [i for i, t in enumerate(s) if has_letter(t)] if model else []
            if own:
                p = pooled(model, [bytes_of(s.iloc[i]) for i in own], width, margin)
                best = p.argmax(1)
                score[own] = np.clip(p[np.arange(len(own)), best], 0, 1)
                for i, k in zip(own, best.tolist(), strict=True):
                    lang[i] = model.labels[k]
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        give_back()

    return run(text)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", hold_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """One row per row of df: doc_id, held_out, lang_pred, score. Rows may repeat, ids may be repeated by other texts; null ids are in no
    fold (held_out is false); texts may be null, empty or of any length; of equally probable languages the first in order is
    said; other columns are not read; an empty table gives no rows. Label, source and id are no inputs of a prediction."""
    model = train_language_model(df, id_col, text_col, label_col, hold_out=hold_out)
    out = df.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_mod(F.col(id_col), hold_out[0]) == hold_out[1], F.lit(False)).alias("held_out"), predict(model, F.col(text_col)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
