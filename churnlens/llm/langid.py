"""Language identification: averaged hashed subword embeddings, a linear
softmax, and a calibrated rejection.

A text's subwords (byte 3-, 4- and 5-grams of its lower-cased words, word
borders included) are hashed into buckets; the bucket embeddings are
averaged over the whole text and a linear softmax gives the language.  The
model also has a class "none", learned from the same texts with their letters
shuffled, so that a text like none of the languages gets a low score even
where one language is known.  It is trained by stochastic gradient descent
in numpy on a bounded sample of labelled texts (``per_lang`` rows of each language,
``train_chars`` characters of each row from a place drawn by hash).  Every language is learned; where
``per_lang`` rows of each are more than ``max_rows``, fewer rows of each are
taken, but one at least.  A temperature and the rejection threshold come from a part of the
sample that training does not see: ``ACCEPT`` of its rightly named windows
(whole texts and parts of 16 to 119 characters) stay, a text that scores
lower is rejected.  Of four or fewer texts none can be held out: temperature
and threshold then come from the training windows.

Since the average is linear, embedding and output layer are folded into one
table (bucket -> language logits) before it is sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import id_crc, keep_texts, map_texts, stage, table

UNDETERMINED = "und"
#: Share of the rightly named held-out windows whose score is not rejected.
ACCEPT = 0.995
_NON_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_ORDERS = (3, 4, 5)
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _normal(text: str) -> bytes:
    """Lower-cased words between single-space borders; ASCII characters
    other than letters become spaces."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_NON_LETTERS).split()) + b" "


def _subwords(data: np.ndarray, bits: int):
    """Per n-gram order: (hash bucket at each place, mask of places whose
    n-gram lies in one word, its border spaces included)."""
    d = data.astype(np.uint32)
    space = data == 32
    for n in _ORDERS:
        size = len(d) - n + 1
        if size <= 0:
            yield np.zeros(0, np.uint32), np.zeros(0, bool)
            continue
        h = np.full(size, n, np.uint32)
        inner = np.ones(size, bool)
        for k in range(n):
            h = (h ^ d[k:k + size]) * _MULT[k]
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                inner &= ~space[k:k + size]
        yield h >> np.uint32(32 - bits), inner


@dataclass
class LangModel:
    langs: list[str]
    logits: np.ndarray  # (buckets, languages and "none"), embedding times output layer
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated language probabilities of whole texts (what they lack
        to one is the probability of none of the languages)."""
        k = self.logits.shape[1]
        total, count = np.zeros((len(texts), k)), np.zeros(len(texts))
        parts = [np.frombuffer(_normal(t), np.uint8) for t in texts]
        if len(texts):
            data = np.concatenate(parts)
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
            for n, (h, inner) in zip(_ORDERS, _subwords(data, self.bits)):
                # a space at a text's end and one at the next text's start
                # keep every n-gram with inner letters inside one text
                at = np.flatnonzero(inner)
                who, rows = owner[at], h[at]
                count += np.bincount(who, minlength=len(texts))
                for j in range(k):
                    total[:, j] += np.bincount(who, weights=self.logits[rows, j], minlength=len(texts))
        z = total / np.maximum(count, 1)[:, None] + self.bias
        return _softmax(z / self.temperature)[:, :len(self.langs)]

    def predict(self, texts: list[str]) -> dict:
        if not self.langs:
            return {"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts),
                    "rejected": [True] * len(texts)}
        letter = [has_letter(t) for t in texts]
        p = self.probabilities(texts) if texts else np.zeros((0, len(self.langs)))
        best, score = p.argmax(1), p.max(1) if len(texts) else np.zeros(0)
        return {
            "lang_pred": [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letter)],
            "score": [float(s) if ok else 0.0 for s, ok in zip(score, letter)],
            "rejected": [bool(not ok or s < self.threshold) for s, ok in zip(score, letter)],
        }


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: str, bits: int):
    data = np.frombuffer(_normal(text), np.uint8)
    rows = [h[inner] for h, inner in _subwords(data, bits)]
    return np.unique(np.concatenate(rows), return_counts=True)


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in random order: what no language writes."""
    chars = np.array(list(text))
    at = np.flatnonzero([c.isalpha() for c in text])
    chars[at] = chars[rng.permutation(at)]
    return "".join(chars)


def train(texts: list[str], langs: list[str], bits: int = 15, dim: int = 16, epochs: int = 4,
          rate: float = 0.6, seed: int = 7, accept: float = ACCEPT) -> LangModel:
    """Stochastic gradient descent over windows of the texts: each text gives
    a long and a short window, so that short texts are calibrated too, and
    one of them with shuffled letters for the class "none"."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (1 << bits, dim))
    none = len(names)
    out, bias = np.zeros((dim, none + 1)), np.zeros(none + 1)
    if not names:
        return LangModel([], np.zeros((1 << bits, 1)), bias, 1.0, 1.0, bits)
    index = {x: i for i, x in enumerate(names)}
    order = rng.permutation(len(texts))
    cut = max(1, len(order) // 5) if len(order) > 4 else 0
    windows: list[tuple[bool, np.ndarray, np.ndarray, int]] = []
    for place, i in enumerate(order):
        text = texts[i]
        for n, width in enumerate((len(text), int(rng.integers(16, 120)))):
            start = int(rng.integers(0, max(1, len(text) - width + 1)))
            window = text[start:start + width]
            for part, y in ((window, index[langs[i]]), (_shuffled(window, rng), none))[:1 + (n == place % 2)]:
                rows, counts = _bag(part, bits)
                if len(rows):
                    windows.append((place < cut, rows, counts / counts.sum(), y))
    held = [w for w in windows if w[0]]
    fit = [w for w in windows if not w[0]]
    steps = max(1, epochs * len(fit))
    done = 0
    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            _, rows, share, y = fit[j]
            step = rate * (1 - done / steps)
            hidden = share @ emb[rows]
            grad = _softmax(hidden @ out + bias)
            grad[y] -= 1
            back = out @ grad
            out -= step * np.outer(hidden, grad)
            bias -= 0.1 * step * grad
            # the averaged gradient is scaled back up to the size of the bag's rows
            emb[rows] -= step * np.outer(share * min(len(rows), 200), back)
            done += 1
    model = LangModel(names, (emb @ out).astype(np.float32), bias, 1.0, 0.0, bits)
    _calibrate(model, held or fit, accept)
    return model


def _calibrate(model: LangModel, windows, accept: float) -> None:
    """Temperature by likelihood on windows that training has not seen;
    rejection below the score that ``accept`` of the right ones reach."""
    z = np.array([share @ model.logits[rows] + model.bias for _, rows, share, _ in windows])
    y = np.array([w[3] for w in windows])
    if not len(y):
        return
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)[:, :len(model.langs)]
    right = p.max(1)[p.argmax(1) == y]
    if len(right):
        model.threshold = float(np.quantile(right, 1 - accept))


def training_sample(docs: DataFrame, eligible: Column, per_lang: int, max_rows: int,
                    train_chars: int, key: str = "doc_id") -> DataFrame:
    """Labelled texts of every language, chosen by the hash of their id: at
    most ``per_lang`` of each, fewer where all languages' together would be
    more than ``max_rows``, one of each at least; of each ``train_chars``
    characters from a place drawn by hash anywhere in the text.

    A language's rows are first thinned by a hash limit that leaves about
    four times as many as are taken, so a language's task ranks few rows
    however many it has.  Where the limit leaves too few (repeated ids, null
    texts), all rows of that language are ranked.
    """
    rows = docs.filter(eligible & F.col("lang").isNotNull() & F.col(key).isNotNull())
    counts = stage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_all")))
    langs = counts.count()
    take = max(1, min(per_lang, max_rows // max(langs, 1)))
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40))
    share = F.least(F.lit(1.0), (4 * take + 40) / F.col("_all"))
    first = Window.partitionBy("lang").orderBy("_h", key, "text")

    def ranked(some: DataFrame) -> DataFrame:
        return (some.filter(F.col("text").isNotNull()).select("lang", key, F.col("text").cast("string").alias("text"),
                                                               place.alias("_h"))
                .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= take))

    thin = stage(ranked(rows.join(counts, "lang").filter(place < share * (1 << 40))))
    got = thin.groupBy("lang").agg(F.count(F.lit(1)).alias("_got"))
    short = stage(counts.join(got, "lang", "left")
                  .filter(F.coalesce("_got", F.lit(0)) < F.least(F.lit(take), F.col("_all"))).select("lang"))
    if not short.isEmpty():
        thin = thin.join(short, "lang", "left_anti").unionByName(ranked(rows.join(short, "lang", "left_semi")))
    begin = 1 + F.pmod(F.xxhash64(key, "text"), F.greatest(F.length("text") - (train_chars - 1), F.lit(1)))
    return (thin.select(key, "lang", F.col("text").substr(begin.cast("int"), F.lit(train_chars)).alias("text"))
            .orderBy(F.xxhash64(key, "text"), key, "lang"))


def fit_language_model(docs: DataFrame, eligible: Column | None = None, per_lang: int = 800,
                       max_rows: int = 51_200, train_chars: int = 1500, **options) -> LangModel:
    """Train on a bounded sample of ``docs`` (columns doc_id, text, lang)."""
    sample = training_sample(docs, F.lit(True) if eligible is None else eligible,
                             per_lang, max_rows, train_chars)
    rows = [r for r in sample.select("text", "lang").collect() if has_letter(r["text"])]
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def identify_language(docs: DataFrame, model: LangModel, keep: list[str]) -> DataFrame:
    """Add lang_pred, score and rejected to the ``keep`` columns.

    Null text, empty text or text without a letter: `und`, score 0,
    rejected.  With no training rows every text is `und`.  Repeated rows are
    judged each, texts of any length whole; an empty table gives no rows;
    ``keep`` columns that have a new column's name are left out.
    """
    return map_texts(docs, model.predict, "lang_pred string, score double, rejected boolean", keep)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned outside the fold
    crc32(doc_id) mod 4 = 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = fit_language_model(docs, ~held_out)
    return identify_language(docs.select("doc_id", "text", held_out.alias("held_out")),
                             model, ["doc_id", "held_out"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keep the documents whose language is recognised.
    Null, empty and letterless texts go; repeated rows are kept or go
    together; all columns, whatever their names, come back as they were; an
    empty table gives no rows."""
    model = fit_language_model(docs)
    return keep_texts(docs, lambda texts: ~np.asarray(model.predict(texts)["rejected"], bool))
