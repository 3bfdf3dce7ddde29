"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..operators.keys import attach
from ..operators.windows import first_k
from .common import keyed, over_texts, raw

DIMS = 1 << 13  # buckets of the hashed n-grams
PER_LANG = 400  # rows a language that the classifiers are fitted on, at most
MAX_ROWS = 4_000  # rows of all languages that they are fitted on, at most, but one a language at least
LONG = 1 << 21  # bytes of a text whose n-grams are counted at once
LETTER = regex.compile(r"\p{L}")
NOT_WORD = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def counts(text: bytes) -> np.ndarray:
    """How often each bucket's n-grams (1 to 3 bytes) occur in the lower-cased text; what is
    no letter in ASCII is one space, so words have a start and an end."""
    out = np.zeros(DIMS, np.int64)
    for a in range(0, len(text), LONG):
        part = NOT_WORD.sub(b" ", text[max(0, a - 2):a + LONG]).decode("utf-8", "ignore").lower().encode()
        b = np.frombuffer(b" " + part + b" ", np.uint8).astype(np.uint32)
        pair = b[:-1] * np.uint32(257) + b[1:]
        triple = pair[:-1] * np.uint32(263) + b[2:]
        places = np.concatenate([b, 256 + pair * np.uint32(2654435761) % np.uint32(2816), 3072 + (triple * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(DIMS - 3072)])
        out += np.bincount(places, minlength=DIMS)
    return out


def features(text: bytes) -> np.ndarray:
    """Roots of the n-grams' shares: a vector of length one, whatever the length of the text."""
    c = counts(text)
    return np.sqrt(c / max(1, c.sum())).astype(np.float32)


def codebook(n: int) -> np.ndarray:
    """Codewords (rows of -1 and 1) of n languages.

    Up to 6: all splits in two parts. More: of random codes of 12 log2 n bits, a fixed
    draw, the one whose closest two words are farthest apart.
    """
    if n <= 6:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits or [(1,)], np.float32).reshape(-1, n).T
    length, draw, best = math.ceil(12 * math.log2(n)), np.random.default_rng(7), None
    for _ in range(20):
        code = draw.choice(np.array([-1, 1], np.float32), (n, length))
        code[0, np.abs(code.sum(0)) == n] *= -1  # no bit is the same for all
        apart = (length - code @ code.T) / 2 + np.eye(n) * length
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


class Model:
    """Linear classifiers, one a bit of the codewords, fitted by gradient descent on logistic loss."""

    def __init__(self, langs: list[str], x: np.ndarray, label: np.ndarray, rounds: int = 300, rate: float = 8.0, decay: float = 1e-5):
        self.langs, self.code = langs, codebook(len(langs))
        used, dims = np.flatnonzero(x.any(0)), x.shape[1]
        x, y = x[:, used], self.code[label]  # a bucket that no row has keeps weight zero
        share = np.bincount(label, minlength=len(langs))
        weight = (1 / (len(langs) * share[label]))[:, None].astype(np.float32)
        self.w, self.b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        for _ in range(rounds):
            slope = -y / (1 + np.exp(np.clip(y * (x @ self.w + self.b), -30, 30))) * weight
            self.w -= rate * (x.T @ slope + decay * self.w)
            self.b -= rate * slope.sum(0)
        whole = np.zeros((dims, y.shape[1]), np.float32)
        whole[used], self.w = self.w, whole

    def decode(self, x: np.ndarray):
        """(best language, its probability, margin to the second best) for each row of features.

        The loss of a language is the sum of its bits' logistic losses; the least loss is the
        nearest codeword, and losses give the probabilities.
        """
        margin = x @ self.w + self.b
        loss = np.logaddexp(0, -margin) @ (self.code > 0).T + np.logaddexp(0, margin) @ (self.code < 0).T
        loss /= max(1, self.code.shape[1] / 4)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, axis=1)
        second = order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(1), order[:, -1], order[:, -1] - second


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG,
          max_rows: int = MAX_ROWS, rounds: int = 300) -> Model | None:
    """Fit on `per_lang` rows of each language, fewer where that would be more than `max_rows` in
    all, but one at least; None without any.

    Rows are those of the least hashes of id and text in their language, so every language that
    has a row is learned. Choosing covers all rows, with the hashes only; features are made in tasks, so
    no text leaves them. Rows equal in id and text are one.
    """
    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                           F.xxhash64(F.lit("train"), F.col(id_col), F.col(text_col).cast("string")).alias("h")).filter("lang is not null")
    n = labelled.select("lang").distinct().count()
    if not n:
        return None
    wanted = max(1, min(per_lang, max_rows // n))
    least = first_k(labelled.select("lang", "h"), "lang", ["h"], wanted).groupBy("lang").agg(F.max("h").alias("most"))
    chosen = attach(labelled, least, "lang", "inner", null_safe=False).filter("h <= most").dropDuplicates(["lang", "h"])

    def scan(batch):
        rows = [features(t).astype(np.float16).tobytes() for t in raw(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "lang"])

    rows = over_texts(chosen.select("text", "lang"), scan, "x binary, lang string").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in rows])
    return Model(langs, x, np.array([place[r["lang"]] for r in rows]), rounds)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", doubt: float = 0.2) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` (0 to 1), `ambiguous` (the margin to the second best is below
    `doubt`) per row. A text that is null or has no letter, and every text without a model, is
    `und` with score 0 and not ambiguous."""
    def scan(batch):
        n = batch.num_rows
        lang, score, ambiguous = ["und"] * n, np.zeros(n), np.zeros(n, bool)
        texts = list(raw(batch.column(3)))
        rows = [i for i, t in enumerate(texts) if model is not None and LETTER.search(t.decode())]
        for a in range(0, len(rows), 512):
            some = rows[a:a + 512]
            best, p, margin = model.decode(np.stack([features(texts[i]) for i in some]))
            score[some], ambiguous[some] = p, margin < doubt
            for i, k in zip(some, best):
                lang[i] = model.langs[k]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(lang), pa.array(score), pa.array(ambiguous)],
                                         ["doc_id", "lang_pred", "score", "ambiguous"])

    return over_texts(keyed(docs, id_col, text_col), scan, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str):
    """Rows that are kept from training: a fixed quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score`, `ambiguous`: `predict` for every row by a model
    fitted on rows that are not held out and have a language (texts that are null or empty too).

    A null id is not held out. Of languages of equal loss the first in order is taken. Repeated rows get
    equal answers, whole texts are counted whatever their length, other columns are not
    read, and an empty table gives no rows."""
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, per_lang)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out("doc_id")).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")
