"""Language identification by error-correcting output codes (operator 5).

Every learned language has a codeword; binary classifiers over hashed character n-grams (1 to 3
bytes of the lower-cased text) each predict one bit of it. Decoding is loss-weighted: each codeword
is charged the logistic loss of every bit at the classifier's margin, weighted by how well that
classifier did on held-back rows, and the cheapest codeword wins. The score is the share of the
winner after normalising exp(-loss); a text whose two best codewords are close is flagged ambiguous.

Fitting takes a bounded sample of labelled rows: at most ``MOST_TRAINING`` in all, dealt evenly over
the languages and chosen by a hash of the id. Everything else covers all rows and whole texts.

Defined cases: a null text or one without a letter gives ``und`` with score 0 (not ambiguous); with
no labelled row every text gives ``und``; with a single language every text with a letter gets it;
rows with a null language or id are never trained on (a null id counts as held out); repeated rows give
repeated results; extra columns do not take part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textops import mix64, slices_by_bytes

#: Rows that the classifiers are fitted on, at most.
MOST_TRAINING = 3000
#: Hashed n-gram features (a power of two).
FEATURES = 4096
#: Texts, and bytes of them, whose features are held at a time.
ROWS, WINDOW = 128, 1 << 17
#: Two best codewords closer than this in probability: ambiguous.
AMBIGUOUS = 0.2

_LETTER = regex.compile(r"\p{L}")
_SALT = mix64(np.arange(1, 4, dtype=np.uint64))


def features(texts: list[str], dim: int = FEATURES) -> np.ndarray:
    """Square-rooted, length-normalised counts of hashed n-grams, one row for each text. Texts are read in
    windows, so a long one needs no more memory than many short ones."""
    parts = [(" " + t.lower() + " ").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    shift = np.uint64(64 - dim.bit_length() + 1)
    counts = np.zeros(len(parts) * dim)
    for s in range(0, len(data), WINDOW):
        low = max(0, s - 2)
        a, r = data[low : s + WINDOW].astype(np.uint64), row[low : s + WINDOW]
        key = a
        for n in range(1, 4):
            if n > 1:
                key = (key[:-1] << np.uint64(8)) | a[n - 1 :]
            new = slice(max(0, s - low - n + 1), None)  # the others ended in the window before
            at = (((key[new] + _SALT[n - 1]) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            first, last = r[: len(key)][new], r[n - 1 :][new]
            whole = first == last
            counts += np.bincount(first[whole].astype(np.int64) * dim + at[whole], minlength=len(counts))
    v = np.sqrt(counts.reshape(len(parts), dim))
    v /= np.maximum(1e-9, np.sqrt((v * v).sum(axis=1, keepdims=True)))
    return v.astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of 0 and 1. All distinct splits for few languages; else random bits, of which the
    draw with the widest least distance is taken."""
    if n <= 1:
        return np.zeros((n, 1), np.int8)
    if n <= 5:
        columns = [[1, *((m >> i) & 1 for i in range(n - 1))] for m in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    random, bits, best, gap = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = random.integers(0, 2, (n, bits)).astype(np.int8)
        code = code[:, (code.min(axis=0) != code.max(axis=0))]
        least = min(int((code[i] != code[j]).sum()) for i in range(min(n, 64)) for j in range(i))
        if least > gap:
            best, gap = code, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (features + 1) x bits, the last row is the bias
    trust: np.ndarray  # of each bit

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, ambiguous."""
        names, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        if not known:
            return names, score, doubt
        margin = np.concatenate([features([texts[i] for i in known[s : s + ROWS]]) @ self.weights[:-1] + self.weights[-1] for s in range(0, len(known), ROWS)])
        sign = 2.0 * self.code - 1
        loss = (self.trust * np.logaddexp(0, -margin[:, None, :] * sign[None])).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ranked = np.sort(share, axis=1)
        for row, i in enumerate(known):
            names[i], score[i] = self.languages[best[row]], share[row, best[row]]
            doubt[i] = len(self.languages) > 1 and ranked[row, -1] - ranked[row, -2] < AMBIGUOUS
        return names, score, doubt


def fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regressions for all bits at once, by gradient steps with momentum."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v, u, rate = w.copy(), w.copy(), 8.0
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (p - y) / len(x) + ridge * v)
        v, u = new + t / (t + 3) * (new - u), new
    return u


def fit(docs: DataFrame, trainable, id_col="doc_id", text_col="text", lang_col="lang", most: int = MOST_TRAINING) -> LanguageModel:
    """Learn from the rows for which the condition ``trainable`` holds and the language is known."""
    rows = docs.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.int8), np.zeros((FEATURES + 1, 1)), np.ones(1))
    share, rate = max(1, most // len(languages)), F.lit(0)
    for lang, n in counts.items():
        rate = F.when(F.col(lang_col) == lang, F.lit(share_of_hashes(share, n))).otherwise(rate)
    picked = rows.where(hash62(F.col(id_col).cast("string"), F.lit("lang")) < rate)

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 1 << 20, ROWS):
            x = features([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "lang"])

    got = picked.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, "x binary, lang string").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float32)
    place = {lang: i for i, lang in enumerate(languages)}
    label = np.array([place[v] for v in got.column("lang").to_pylist()], np.int64)
    if not len(x):
        raise RuntimeError(f"no row was drawn from {sum(counts.values())} labelled ones")
    order = np.lexsort((np.array([zlib.crc32(r.tobytes()) for r in x]), label))  # the same order whoever answers first
    x, label = x[order], label[order]
    code = codewords(len(languages))
    y = code[label].astype(np.float32)
    back = np.arange(len(x)) % 5 == 4
    trust = np.ones(code.shape[1])
    if back.sum() >= 20 and len(languages) > 1:
        w = fit_bits(x[~back], y[~back])
        right = ((x[back] @ w[:-1] + w[-1] > 0) == (y[back] > 0.5)).mean(axis=0)
        trust = np.clip(np.log(np.clip(right, 0.5, 0.995) / (1 - np.clip(right, 0.5, 0.995))), 0.05, None)
        trust = trust / trust.mean()
    return LanguageModel(languages, code, fit_bits(x, y), trust)


def predict(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 1 << 20):
            names, score, doubt = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(doubt)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def remainder(id_col: str, modulus: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def held_out_rows(id_col: str, modulus: int, value: int):
    """Whether a row is held out; a null id has no remainder, so its row is: nothing is learned from it."""
    return F.coalesce(remainder(id_col, modulus) == value, F.lit(True))


def hash62(*columns):
    """A hash of 62 bits, for draws at any rate."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def share_of_hashes(wanted: int, n: int) -> int:
    """Below this bound lie about ``wanted`` of n hashes of 62 bits; all of them if there are no more."""
    return 1 << 62 if n <= wanted else (wanted << 62) // n


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs, remainder("doc_id", 4) != 2))
    return out.select("doc_id", held_out_rows("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents go in which no language can be recognised: no text, no letter in it, or a text that fits two
    languages about as well (``AMBIGUOUS``). Where no row names a language to learn, all with a letter stay."""
    model = fit(docs, F.lit(True))
    held = spark.sparkContext.broadcast(model)
    fields = docs.schema.names
    at = fields.index("text")

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 1 << 20):
            texts = batch.column(at).to_pylist()
            if held.value.languages:
                names, _, doubt = held.value.predict(texts)
                known = [n != "und" and not d for n, d in zip(names, doubt)]
            else:
                known = [bool(t and _LETTER.search(t)) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
