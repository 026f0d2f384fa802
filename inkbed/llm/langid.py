"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier for each bit (logistic regression on hashed byte n-grams)
predicts its margin, and the codeword with the least total logistic loss wins.  Documents whose two best
codewords are close are flagged as ambiguous.

Training takes a bounded sample of labelled rows (ROWS for each language, fewer where there are so many languages that all would
be over ALL_ROWS; chosen by a hash of doc_id from all of them) and fits on it in batches; prediction reads every text whole, in
slices of bounded memory, without a shuffle; only texts go to Python workers.  The model has a fixed size for each bit.

Defined cases: a null text or one without a letter is "und" with score 0; a very long text is a slice of its own; null languages
are not learned; of codewords that are equally near the first language in order wins, and the text is ambiguous; repeated rows
give repeated rows; extra columns, of whatever name, are not read; without any labelled row everything is "und"; with one
language everything with a letter is that language; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import LOWER_BYTE, each_slice
from .tables import short_batches

#: Buckets of hashed n-grams, and the bits of a code: as many at least, and so many times the logarithm of the languages.
BUCKETS, BITS, BITS_PER_HALVING = 4096, 15, 6
#: Labelled rows of each language and of all that training takes at most, and the characters that such a row may have.
ROWS, ALL_ROWS, ROW_CHARS = 600, 24_000, 20_000
#: Rows that a step of the fit takes at once.
FIT_ROWS = 4096
#: Two codewords whose losses differ by less than this share of a bit are ambiguous.
MARGIN = 0.1
UNKNOWN = "und"
#: Texts whose features are made at once: BUCKETS numbers each.
TEXTS = 256

#: Bytes as they are hashed: letters in lower case and bytes beyond ASCII as they are, all others a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = LOWER_BYTE[65:91]
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n rows of +1 and -1: every split in two while these are few, else a seeded code whose rows are far apart."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= bits:
        splits = np.arange(1, 2 ** (n - 1))
        return np.stack([np.where((splits >> max(0, k - 1)) & 1 if k else np.zeros_like(splits), -1.0, 1.0) for k in range(n)])
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, max(bits, BITS_PER_HALVING * int(np.ceil(np.log2(n))))))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        if apart.min() > far:
            best, far = code, apart.min()
    return best if best is not None else 2 * np.eye(n) - 1


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """For each text, the root of its n-grams' shares (n = 1 to 4, hashed)."""
    n = len(offsets) - 1
    counts = np.zeros(n * buckets, np.int64)
    if len(data):
        text = np.repeat(np.arange(n, dtype=np.int64) * buckets, np.diff(offsets))
        folded = _FOLD[data].astype(np.uint32)
        gram = folded.copy()
        for size in range(1, 5):
            if size > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + folded[size - 1 :]
            if not len(gram):
                break
            # n-grams over the edge of two texts are few, but would depend on the neighbour
            own = text[: len(gram)] == text[size - 1 :] if size > 1 else slice(None)
            h = gram * np.uint32(2654435761) + np.uint32(size * 0x9E3779B)
            h ^= h >> np.uint32(15)
            counts += np.bincount((text[: len(gram)] + (h % np.uint32(buckets)))[own], minlength=n * buckets)
    out = np.sqrt(counts.reshape(n, buckets), dtype=np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def fit_logistic(batches: list[np.ndarray], y: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights (features + 1, columns of y) of logistic regressions for labels +1 and -1, by Adam on all rows.

    batches: the rows' features (16-bit numbers do), in parts, so that no step holds more than one of them in full.
    """
    y = y.astype(np.float32)
    w = np.zeros((batches[0].shape[1] + 1, y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1)).astype(np.float32)
    for t in range(1, steps + 1):
        grad, at = decay * w, 0
        for part in batches:
            x, own = part.astype(np.float32), slice(at, at + len(part))
            push = -y[own] * share[own] / (1 + np.exp(np.clip(y[own] * (x @ w[:-1] + w[-1]), -30, 30)))
            grad[:-1] += x.T @ push
            grad[-1] += push.sum(0)
            at += len(part)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """For each row and language, the mean logistic loss of its codeword."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        return np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(2)


def fit(labelled: DataFrame, rows: int = ROWS) -> Model:
    """Learns from columns doc_id, text and lang; at most ``rows`` of each language, chosen by a hash."""
    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    languages = tuple(sorted(counts))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS + 1, 1), np.float32))
    rows = max(1, min(rows, ALL_ROWS // len(languages)))
    shares = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / c)))])
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = known.filter((place < shares[F.col("lang")]) & (F.length("text") <= ROW_CHARS)).select("text", "lang").limit(2 * rows * len(languages)).toArrow()
    at = {k: i for i, k in enumerate(languages)}
    batches, part = [], []
    for _, _, data, offsets in each_slice(sample["text"], texts=TEXTS):
        part.append(features(data, offsets).astype(np.float16))
        if sum(map(len, part)) >= FIT_ROWS:
            batches, part = [*batches, np.vstack(part)], []
    batches += [np.vstack(part)] if part else []
    if not batches:
        return Model(languages, code, np.zeros((BUCKETS + 1, code.shape[1]), np.float32))
    return Model(languages, code, fit_logistic(batches, code[[at[k] for k in sample["lang"].to_pylist()]]))


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found):  # letters beyond ASCII
        found[i] = any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")))
    return found


def predictor(model: Model) -> Callable[[Column], Column]:
    """A function of a text column: a struct of lang_pred, score (0 to 1) and ambiguous."""
    languages = np.array([*model.languages, UNKNOWN], object)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def scored(texts: pa.Array) -> pa.Array:
        best, score, close = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
        for _, _, data, offsets in each_slice(texts, texts=TEXTS):
            letters = _has_letter(data, offsets)
            if not model.languages:
                letters[:] = False
            loss = model.losses(features(data, offsets)) if model.languages else np.zeros((len(letters), 1))
            odds = np.exp(-(loss - loss.min(1, keepdims=True)) * model.code.shape[1])
            two = np.sort(loss, 1)[:, :2]
            best.append(np.where(letters, loss.argmin(1), len(model.languages)))
            score.append(np.where(letters, 1 / odds.sum(1), 0.0))
            close.append((two[:, -1] - two[:, 0] < MARGIN) & letters if two.shape[1] > 1 else np.zeros(len(letters), bool))
        parts = [pa.array(languages[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(close))]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scored, "lang_pred string, score double, ambiguous boolean")


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and lang_pred, score (0 to 1) and ambiguous."""
    short_batches(docs.sparkSession)
    return docs.select(*keep, predictor(model)(F.col("text")).alias("_found")).select(*keep, "_found.*")


def language_of(docs: DataFrame, model: Model) -> Column:
    """lang_pred as a column of docs, to filter by: all other columns stay where they are."""
    short_batches(docs.sparkSession)
    return predictor(model)(docs["text"])["lang_pred"]
