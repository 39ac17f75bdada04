"""Language identification: averaged hashed subword embeddings under a linear softmax.

The subwords are the 3- and 4-byte grams of the text (ASCII letters in lower case,
whitespace and digits each made one symbol), hashed to `buckets`. A text is the mean of its
subwords' embeddings; a linear layer and a softmax over the languages follow. Embeddings and
layer are trained together by stochastic gradient descent in numpy on segments
of a bounded sample: about `sample` documents for each language, chosen by a hash of the id, `excerpt` characters of each.
One part in five of that sample is kept out of training: on it a temperature is fitted, so
that scores are calibrated. A prediction is rejected if its score is below `margin` times the `quantile` of
the scores of the calibration texts recognised as that language. A softmax has to choose a language that it learned,
so the share of known subwords is judged in the same way: of the text's 4-byte grams of letters and spaces, those that
the training met in that language. With two languages or one that alone can reject a text with letters.

The trained model is a table of buckets x languages (embedding times layer), so that a
prediction is one gather and one sum per byte of the text, whole texts included.

Cases: a text that is null or has no letter is `und` with score 0 and is rejected; rows
without language or id are never trained on; without any training row every text is `und`;
ties go to the language first in order; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import if_small, text_chunks

UNKNOWN = "und"


def held_out(id_col: str):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def _symbols() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    table[[9, 10, 11, 12, 13]] = 32
    return table


_SYMBOLS = _symbols()


def subwords(data: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each gram size, the bucket of the gram that starts at each byte."""
    s = _SYMBOLS[data].astype(np.uint32)
    found = []
    for size in (3, 4):
        n = max(0, len(s) - size + 1)
        h = np.full(n, size, np.uint32)
        for k in range(size):
            h = h * np.uint32(0x01000193) ^ s[k : k + n]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append((h >> np.uint32(32 - bits)).astype(np.int64))
    return found


#: Bits of the hash of a known gram: 128 KB a language.
KNOWN_BITS = 20


def _letter_grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the 4-byte grams of letters and spaces, two letters or more."""
    bucket = subwords(data, KNOWN_BITS)[1]
    s = _SYMBOLS[data]
    letter = (s >= 128) | (s >= 97) & (s < 123)
    plain, letters = np.ones(len(bucket), bool), np.zeros(len(bucket), np.int8)
    for k in range(4):
        own = letter[k : k + len(bucket)]
        plain &= own | (s[k : k + len(bucket)] == 32)
        letters += own
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(bucket)]
    keep = np.flatnonzero(plain & (letters >= 2) & (np.arange(len(bucket)) + 4 <= at[1:][row]))
    return bucket[keep], row[keep]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float
    reject_below: np.ndarray  # score, by language
    bits: int
    known: np.ndarray  # languages x bits of the 4-byte grams met in training
    reject_unknown: np.ndarray  # share of known grams, by language

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows x languages for the texts between each two offsets."""
        rows, count = len(at) - 1, np.zeros(len(at) - 1)
        total = np.zeros((rows, len(self.languages)))
        for size, bucket in zip((3, 4), subwords(data, self.bits), strict=True):
            last = np.maximum(at[:-1], at[1:] - size + 1)  # grams never cross texts
            n = last - at[:-1]
            count += n
            own = np.flatnonzero(n)
            if len(own):
                edges = np.stack([at[:-1][own], last[own]], 1).ravel()
                edges = edges[:-1] if edges[-1] >= len(bucket) else edges
                for k in range(len(self.languages)):
                    total[own, k] += np.add.reduceat(self.table[:, k][bucket], edges, dtype=np.float64)[::2]
        return total / np.maximum(count, 1)[:, None] + self.bias

    def known_share(self, data: np.ndarray, at: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Of each text's 4-byte grams of letters and spaces, the share that the training met in the given language; 1 without such grams."""
        bucket, row = _letter_grams(data, at)
        hit = self.known[language[row], bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1
        n = np.bincount(row, minlength=len(at) - 1)
        return np.where(n > 0, np.bincount(row, hit, minlength=len(at) - 1) / np.maximum(n, 1), 1.0)

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.logits(data, at) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _segments(texts: list[bytes], rng) -> tuple[list[bytes], list[int]]:
    """Pieces of many lengths of each text, and the text each comes from: the model meets short texts too."""
    out, of = [], []
    for k, text in enumerate(texts):
        for size in (40, 120, 400, 800):
            start = int(rng.integers(0, max(1, len(text) - size + 1)))
            out.append(text[start : start + size])
            of.append(k)
    return out, of


def fit(texts: list[str], labels: list[str], *, bits: int = 15, dim: int = 16, epochs: int = 6, least_steps: int = 1000, rate: float = 30.0, batch: int = 64, seed: int = 7, margin: float = 0.75, quantile: float = 0.01) -> LanguageModel:
    """Train on (text, language) pairs; every fifth pair calibrates."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.searchsorted(languages, labels)
    order = rng.permutation(len(texts))
    calibrate, train = order[::5], np.delete(order, np.arange(0, len(order), 5))
    if not len(train):
        train = order
    size = 1 << bits
    embed = rng.normal(0, 0.1, (size, dim))
    layer, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    pieces, of = _segments([texts[k].encode() for k in train], rng)
    grams = [np.concatenate(subwords(np.frombuffer(p, np.uint8), bits)) for p in pieces]
    used = [k for k, g in enumerate(grams) if len(g)]
    y = target[train][of]
    steps, done = max(least_steps, epochs * len(used) // batch), 0
    while used and done < steps:
        turn = rng.permutation(used)
        for lo in range(0, len(turn), batch):
            own = turn[lo : lo + batch]
            n = np.array([len(grams[k]) for k in own])
            ids = np.concatenate([grams[k] for k in own])
            mean = np.add.reduceat(embed[ids], np.cumsum(n) - n) / n[:, None]
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            step = rate * (1 - done / steps)
            down = p @ layer.T / n[:, None]
            layer -= step * 0.1 * (mean.T @ p)
            bias -= step * 0.1 * p.sum(0)
            # One sum for each bucket met: its grams side by side.
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.append(True, ids[by][1:] != ids[by][:-1]))
            embed[ids[by][first]] -= step * np.add.reduceat(down[np.repeat(np.arange(len(own)), n)[by]], first)
            done += 1
            if done >= steps:
                break
    model = LanguageModel(languages, np.ascontiguousarray((embed @ layer).astype(np.float32)), bias, 1.0, np.zeros(len(languages)), bits, np.zeros((len(languages), 1 << KNOWN_BITS - 3), np.uint8), np.zeros(len(languages)))
    for k in range(len(languages)):
        own = [p for p, t in zip(pieces, y, strict=True) if t == k]
        bucket, _ = _letter_grams(np.frombuffer(b"".join(own), np.uint8), np.append(0, np.cumsum([len(p) for p in own], dtype=np.int64)))
        met = np.zeros(1 << KNOWN_BITS, bool)
        met[bucket] = True
        model.known[k] = np.packbits(met, bitorder="little")
    # Calibration: whole texts and their pieces, which the training has not seen.
    kept = [texts[k].encode() for k in calibrate]
    pieces, of = _segments(kept, rng)
    data = kept + pieces
    truth = np.append(target[calibrate], target[calibrate][of])
    at = np.append(0, np.cumsum([len(x) for x in data]))
    z, rows = model.logits(np.frombuffer(b"".join(data), np.uint8), at), np.arange(len(data))

    def loss(t):
        q = z / t
        return -(q[rows, truth] - q.max(1) - np.log(np.exp(q - q.max(1, keepdims=True)).sum(1))).mean()

    model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
    raw, at = np.frombuffer(b"".join(kept), np.uint8), at[: len(kept) + 1]
    whole = model.probabilities(raw, at)
    best = whole.argmax(1)
    share = model.known_share(raw, at, best)
    for k in range(len(languages)):
        right = (best == k) & (truth[: len(kept)] == k)
        if right.any():  # a language that no calibration text shows has no bound
            model.reject_below[k] = margin * np.quantile(whole[right, k], quantile, method="lower")
            model.reject_unknown[k] = margin * np.quantile(share[right], quantile, method="lower")
    return model


def training_sample(docs: DataFrame, sample: int, excerpt: int = 4096, pieces: int = 16) -> DataFrame:
    """(doc_id, text, lang) of about `sample` documents for each language, by a hash of the id; held-out rows never.

    A text longer than `excerpt` characters is cut into `pieces` even parts and gives a piece of each, at a place that the hash chooses, so the whole of it
    is drawn from. No more than languages x sample rows of bounded size are trained on, whatever the table holds.
    """
    rows = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    size = excerpt // pieces
    part = f"(length(text) DIV {pieces})"
    drawn = F.expr(f"transform(sequence(0, {pieces - 1}), i -> substring(text, CAST(1 + i * {part} + pmod(xxhash64(doc_id, i), {part} - {size} + 1) AS int), {size}))")
    short = F.length("text") <= excerpt
    return rows.join(if_small(n), "lang").where(share < F.lit(sample) / F.col("n")).select("doc_id", F.when(short, F.col("text")).otherwise(F.array_join(drawn, "\n")).alias("text"), "lang")


def _trained(options: dict):
    def run(batches):
        rows = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows], **options))], pa.binary())], ["model"])

    return run


def train(docs: DataFrame, *, sample: int = 400, excerpt: int = 4096, **options) -> LanguageModel | None:
    """The model, trained in one task: the driver gets its tables only, not the texts or the arrays of the training."""
    found = training_sample(docs, sample, excerpt).repartition(1).mapInArrow(_trained(options), "model binary").first()
    return pickle.loads(found.model) if found else None


def _predict(model: LanguageModel | None, carry: bool):
    def scan(batches):
        for batch in batches:
            limit = 1 << 20 if model is None else max(1 << 16, min(1 << 20, (1 << 22) // len(model.languages)))
            best, score, doubtful = [], [], []
            texts = batch.column("text")
            for row, end, data, at in text_chunks(batch, "text", limit):
                p = model.probabilities(data, at) if model else np.zeros((end - row, 1))
                top = p.argmax(1)
                best += top.tolist()
                score += p.max(1).tolist()
                doubtful += ((p.max(1) < model.reject_below[top]) | (model.known_share(data, at, top) < model.reject_unknown[top])).tolist() if model else [True] * len(p)
            letter = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()] if model else [False] * len(best)
            lang = [model.languages[k] if has else UNKNOWN for k, has in zip(best, letter, strict=True)]
            score = [min(1.0, s) if has else 0.0 for s, has in zip(score, letter, strict=True)]
            rejected = [not has or d for d, has in zip(doubtful, letter, strict=True)]
            names = [c for c in batch.schema.names if carry or c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return scan


def identify_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 400, model: LanguageModel | None = None, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected (score or share of known subwords under the language's bound, or `und`)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = model or train(rows, sample=sample, **options)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(_predict(model, False), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def with_language(docs: DataFrame, *, text_col: str = "text", sample: int = 400, model: LanguageModel | None = None, **options) -> DataFrame:
    """The documents with lang_pred, score and rejected. Needs the columns doc_id and lang where no model is given."""
    docs = docs.drop("lang_pred", "score", "rejected")
    model = model or train(docs.select("doc_id", F.col(text_col).cast("string").alias("text"), F.col("lang").cast("string")), sample=sample, **options)
    # The other columns travel as one, so that their names can't clash with those used here.
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(F.lit(True), *others).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*rows.schema.fields, *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())))])
    found = rows.mapInArrow(_predict(model, True), schema)
    return found.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns), "lang_pred", "score", "rejected")
