"""Toxicity by a support vector machine on a gapped-subsequence string kernel with Nyström landmarks.

Strings are spans of sentences, blanks included.  Text is read as symbols: letters (A-Z in lower case, accents taken off) and
blanks; punctuation, digits, symbols and characters of no width are left out, so "d.u*m_b​o" is the string "dumbo".  The
kernel compares the subsequences of three symbols that two strings share.  In a plain span, up to two other symbols may stand
after either of the first two, each at a cost; so a letter or a blank that is inserted somewhere, or an ending that was never
seen, costs weight but hides nothing.  In a span with regular gaps, one to three other letters, of any kind, stand between
the symbols all the way through a word ("dxuymzbqo"), or a blank does ("d u m b o"); the word's own begin and end
are symbols of it.  Such spans have a bias of their own, since a text has more of them.

Documents' labels say only that some sentence is toxic, so training alternates (multiple instances): fit on the spans that
score highest in each labelled document, and choose them again.  The first choice takes the subsequences that toxic documents
have oftener than others, near copies counted once.  The later rounds learn from spans with letters and blanks inserted at random
beside the plain ones, of both labels.

The kernel's values against the landmarks, whitened (Nyström), are the features of a linear SVM.  Its decision is linear in the
landmarks' subsequences, so the fitted machine folds into one weight for each subsequence (a table of 1 MB), and a text's
decision is the highest of its spans'.  A logistic curve on the training documents turns it into a score from 0 to 1.

Training takes at most ROWS labelled rows of either label, of at most ROW_CHARS characters, chosen by a hash; scoring reads
whole texts in pieces of bounded memory, without a shuffle.

Defined cases: a null or empty text has the decision of a string that shares nothing with any landmark; very long texts are read
in overlapping pieces; null labels and texts are not learned; a repeated row is scored as often as it comes and learned from
like a near copy; equal decisions get equal scores; extra columns, of whatever name, are not read; with labels of one kind
or none all scores are 0; an empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import each_slice
from .tables import short_batches

#: Labelled rows of either label in training, and the characters that such a row may have.
ROWS, ROW_CHARS = 1200, 20_000
LANDMARKS, ROUNDS = 400, 6
#: The first rounds choose among plain spans alone; the later ones learn from stretched ones, too.
PLAIN = 3
#: Steps from a symbol of a subsequence to the next one, and what each symbol that is left out costs.
STEPS, DECAY = (1, 2, 3), 0.75
#: Lengths of spans in subsequences that begin there, for the text as it is and for every second, third or fourth letter of its words.
SPANS = {1: (7, 14, 24), 2: (4, 6, 9), 3: (4, 6, 9), 4: (4, 6, 9)}
#: Symbols are numbers below 64: none, blank, a to z, and other letters by their code point.
NONE, BLANK, BITS = 0, 1, 6
PAD = max(step * (sizes[-1] + 2) for step, sizes in SPANS.items()) + 2 * STEPS[-1]
#: Symbols before and after a span that its subsequences with regular gaps look at.
MARGIN = max(SPANS) + 1
#: Bytes of a very long text that are read at once, and how far pieces overlap.
PIECE, OVERLAP = 1 << 19, 1 << 12
#: (second symbol's place, third one's, weight) in the text as it is.
PATTERNS = [(a, a + b, DECAY ** (a + b - 2)) for a in STEPS for b in STEPS]


def _norm(step: int, length: int) -> float:
    """A span's norm, by its kind and length alone."""
    return (length * (sum(w * w for *_, w in PATTERNS) if step == 1 else 1.0)) ** 0.5


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point up to 0xFFFF, and of all above (none)."""
    out = np.zeros(0x10001, np.uint8)
    for i in range(0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isspace():
            out[i] = BLANK
        elif c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower() if i > 127 else c.lower()
            out[i] = ord(base) - 95 if "a" <= base <= "z" else 28 + ord(base[0]) % 36
    return out


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts): the texts' symbols, PAD places of none before, between and after them, and where each text begins."""
    n = len(offsets) - 1
    points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets] if len(points) == int(((data & 0xC0) != 0x80).sum()) else _point_offsets(data, offsets)
    found = symbols()[np.minimum(points, 0x10000)]
    text = np.repeat(np.arange(n), np.diff(ends))
    some = found != NONE
    found, text = found[some], text[some]
    if len(found):
        again = found == BLANK  # a blank after a blank, or first in its text
        again[1:] &= (found[:-1] == BLANK) | (text[1:] != text[:-1])
        found, text = found[~again], text[~again]
    sizes = np.bincount(text, minlength=n)
    starts = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]]) + PAD
    out = np.zeros(int(sizes.sum()) + PAD * (n + 1), np.uint8)
    if len(found):
        out[np.arange(len(found)) - (np.cumsum(sizes) - sizes)[text] + starts[text]] = found
        full = sizes > 0
        out[starts[full] - 1] = BLANK
        last = starts[full] + sizes[full]
        out[last] = np.where(out[last - 1] == BLANK, NONE, BLANK)
    return out, starts


def _point_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For bytes that are no UTF-8: code points before each offset, text by text."""
    counts = [len(bytes(data[a:b]).decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.concatenate([[0], np.cumsum(counts)])


def _keys(s: np.ndarray, first: int, second: int) -> np.ndarray:
    n = max(0, len(s) - second)
    wide = s.astype(np.int32)
    return (wide[:n] << 2 * BITS) | (wide[first : first + n] << BITS) | wide[second : second + n]


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # a weight for each subsequence
    bias: float
    slope: float
    offset: float
    spaced: float = 0.0  # what the bias of spans with regular gaps has beside the plain ones'

    def score(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decisions + self.offset, -40, 40)))


EMPTY = Model(np.zeros(1 << 3 * BITS, np.float32), 0.0, 0.0, -40.0)


def _spaced(s: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence, whether there is one) around each letter: itself and the letters a step before and after it in its word.

    Where the word begins or ends there, a blank stands for the letter beyond; what lies between is any letters.  At a step of two,
    letters that stand alone between blanks are a word of their own, too.
    """
    n = len(s)
    around = np.zeros(n + 2 * MARGIN, np.uint8)
    around[MARGIN : MARGIN + n] = s
    at = lambda k: around[MARGIN + k : MARGIN + k + n]
    letter = lambda k: at(k) > BLANK
    sides = []
    for sign in (-1, 1):
        edge = ~letter(sign)
        inside = ~edge
        for k in range(2, step + 1):
            inside &= letter(sign * k)
        sides.append((edge, inside, at(sign * step)))
    (first, left, a), (last, right, c) = sides
    own = letter(0) & (first | left) & (last | right) & ~(first & last)
    a, c = np.where(first, np.uint8(BLANK), a), np.where(last, np.uint8(BLANK), c)
    if step == 2:
        alone = letter(0) & (at(-1) == BLANK) & (at(1) == BLANK)
        before, after = letter(-2) & ~letter(-3) & alone, letter(2) & ~letter(3) & alone
        own |= before | after
        a, c = np.where(before, at(-2), a), np.where(after, at(2), c)
    return (a.astype(np.int32) << 2 * BITS) | (s.astype(np.int32) << BITS) | c, own


def span_decisions(s: np.ndarray, table: np.ndarray, bias: float, spaced: float = 0.0, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(decision, step, length) of the best span (with plain: one without regular gaps) that begins at each place."""
    wide = s.astype(np.int32)
    high, middle = wide << 2 * BITS, wide << BITS
    best, steps, length = np.full(len(s), -np.inf, np.float32), np.ones(len(s), np.int8), np.zeros(len(s), np.int8)
    for step, sizes in SPANS.items():
        if plain and step > 1:
            break
        rows = -(-len(s) // step)
        here = np.zeros(rows * step, np.float32)
        if step == 1:
            for first, second, w in PATTERNS:
                n = max(0, len(s) - second)
                here[:n] += table[high[:n] | middle[first : first + n] | wide[second : second + n]] * np.float32(w)
        else:
            keys, own = _spaced(s, step)
            here[: len(s)] = table[keys] * own
        sums = np.zeros((rows + 1, step))
        np.cumsum(here.reshape(rows, step), axis=0, out=sums[1:])
        for size in sizes:
            own = ((sums[size:] - sums[: rows + 1 - size]) / _norm(step, size) + bias + spaced * (step > 1)).reshape(-1)[: len(s)].astype(np.float32)
            better = own > best[: len(own)]
            best[: len(own)][better] = own[better]
            steps[: len(own)][better] = step
            length[: len(own)][better] = size
    return best, steps, length


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with very long texts cut in overlapping pieces, and the text of each piece."""
    if len(offsets) == 1 or int(np.diff(offsets).max()) <= 2 * PIECE:
        return data, offsets, np.arange(len(offsets) - 1)
    parts, of = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, max(a + 1, b), PIECE):
            parts.append((at, min(b, at + PIECE + OVERLAP)))
            of.append(i)
    return np.concatenate([data[a:b] for a, b in parts]), np.concatenate([[0], np.cumsum([b - a for a, b in parts])]), np.array(of)


def text_decisions(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The highest decision in each text."""
    out = np.full(len(offsets) - 1, model.bias)
    data, offsets, of = _pieces(data, offsets)
    at = 0
    while at < len(of):  # pieces of bounded size together
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        s, starts = sequence(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        found = np.maximum.reduceat(span_decisions(s, model.table, model.bias, model.spaced)[0], starts - PAD + 1)
        np.maximum.at(out, of[at:to], found)
        at = to
    return out


# --- training


def _features(step: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequences, values) of a span of symbols, with what its subsequences reach, read in steps."""
    if step > 1:
        keys, own = (x[MARGIN : len(s) - MARGIN : step] for x in _spaced(s, step))
        return keys[own], np.full(int(own.sum()), 1 / _norm(step, max(1, len(keys))))
    parts = [(_keys(s, a, b), w) for a, b, w in PATTERNS]
    return np.concatenate([k for k, _ in parts]), np.concatenate([np.full(len(k), w) for k, w in parts]) / _norm(1, max(1, len(s) - 2))


def _dense(features: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray) -> np.ndarray:
    """The kernel's features of spans, in the given subsequences only."""
    row = np.repeat(np.arange(len(features)), [len(k) for k, _ in features])
    keys, values = np.concatenate([k for k, _ in features]), np.concatenate([v for _, v in features])
    at = np.minimum(np.searchsorted(columns, keys), len(columns) - 1)
    hit = columns[at] == keys
    out = np.bincount(row[hit] * len(columns) + at[hit], values[hit], len(features) * len(columns))
    return out.reshape(len(features), len(columns)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 500, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by Adam."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = np.zeros(x.shape[1]), 0, 0
    for t in range(1, steps + 1):
        grad = x.T @ (-2 * y * share * np.maximum(0, 1 - y * (x @ w))) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _curve(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, slightly held back, by Newton's method; y is 0 or 1."""
    a, b = 1.0, 0.0
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = share * (p - y)
        h = share * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * f).sum() + 0.01 * a, g.sum()
        haa, hab, hbb = (h * f * f).sum() + 0.01, (h * f).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def _copies(docs: list[np.ndarray]) -> np.ndarray:
    """About how many near copies each document has, itself included: those with the same least hash of 12 symbols."""
    least = []
    for padded in docs:
        s = padded[PAD - 1 : len(padded) - PAD + 1]
        n = max(0, len(s) - 11)
        h = np.zeros(n, np.uint64)
        for j in range(12):
            h = h * np.uint64(0x100000001B3) + s[j : j + n].astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        least.append(int((h ^ (h >> np.uint64(32))).min()) if n else zlib.crc32(s.tobytes()))
    _, at, counts = np.unique(np.array([x & (2**63 - 1) for x in least]), return_inverse=True, return_counts=True)
    return counts[at]


def _first_weights(docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each subsequence without gaps, how much likelier it makes a document toxic (log-likelihood gain); 0 if it doesn't."""
    pos, neg = np.zeros(1 << 3 * BITS), np.zeros(1 << 3 * BITS)
    for s, t, w in zip(docs, toxic, weight, strict=True):
        np.add.at(pos if t else neg, np.unique(_keys(s, 1, 2)), w)
    base = (toxic * weight).sum() / weight.sum()
    n = np.maximum(pos + neg, 1e-9)
    seen = np.clip(pos / n, 1e-9, 1 - 1e-9)
    gain = n * (seen * np.log(seen / base) + (1 - seen) * np.log((1 - seen) / (1 - base)))
    return np.where((pos > base * n) & (gain > np.log(max(2.0, weight.sum())) / 2), gain, 0.0)


def stretched(s: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The string with one to three letters, the same or different ones, or a blank after each of its letters, and with one of them anywhere; padded."""
    out = []
    for many in (1, 2, 3, 0):
        fixed = rng.integers(2, 28, many) if rng.random() < 0.3 else None
        parts = []
        for i, c in enumerate(s):
            parts.append(c)
            if c > BLANK and i + 1 < len(s) and s[i + 1] > BLANK:
                parts.extend(([BLANK] if not many else rng.integers(2, 28, many) if fixed is None else fixed))
        out.append(parts)
    cut = int(rng.integers(1, max(2, len(s) - 1)))
    out.append([*s[:cut], int(rng.choice([BLANK, int(rng.integers(2, 28))])), *s[cut:]])
    return [np.concatenate([np.zeros(PAD, np.uint8), np.array(x, np.uint8), np.zeros(PAD, np.uint8)]) for x in out]


def _together(strings: list[np.ndarray], table: np.ndarray, bias: float = 0.0, spaced: float = 0.0, plain: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """The span decisions of each padded string; many short ones are computed at once."""
    at = 0
    while at < len(strings):
        to, size = at, 0
        while to < len(strings) and (to == at or size + len(strings[to]) <= PIECE):
            size += len(strings[to])
            to += 1
        ends = np.cumsum([len(x) for x in strings[at:to]])
        found = span_decisions(np.concatenate(strings[at:to]), table, bias, spaced, plain)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield tuple(x[a:b] for x in found)
        at = to


def _top(strings: list[np.ndarray], table: np.ndarray, spaced: float = 0.0, plain: bool = False, many: int = 1) -> list[list[tuple[int, np.ndarray]]]:
    """The best spans of each padded string that lie apart: (step, symbols)."""
    out = []
    for s, (best, steps, length) in zip(strings, _together(strings, table, 0.0, spaced, plain), strict=True):
        own = []
        for _ in range(many):
            i = int(best.argmax())
            if not np.isfinite(best[i]) or not length[i]:
                break
            step, size = int(steps[i]), int(length[i])
            if step == 1:
                own.append((1, s[i : i + size + 2]))
            else:  # with margins, whole by the padding
                a, b = i - MARGIN, i + step * (size - 1) + 1 + MARGIN
                own.append((step, np.concatenate([np.zeros(max(0, -a), np.uint8), s[max(0, a) : b], np.zeros(max(0, b - len(s)), np.uint8)])))
            best[max(0, i - PAD) : i + PAD] = -np.inf
        out.append(own)
    return out


def _around(strings: list[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
    """The symbols of each padded document's best plain span."""
    out = []
    for s, (best, *_) in zip(strings, _together(strings, table, plain=True), strict=True):
        n = int(best.argmax())
        part = s[max(0, n - 2) : n + SPANS[1][0] + 4]
        out.append(part[part != NONE])
    return out


def train(texts: list[str | None], toxic: np.ndarray) -> Model:
    """Fits the machine on documents and their labels (0 or 1)."""
    toxic = np.asarray(toxic)
    if not len(toxic) or toxic.min() == toxic.max():
        return EMPTY
    rng = np.random.default_rng(11)
    docs = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        docs.append(sequence(raw, np.array([0, len(raw)]))[0])
    weight = 1 / _copies(docs)
    table, bias, spaced = _first_weights(docs, toxic, weight).astype(np.float32), 0.0, 0.0
    if not table.any():
        return EMPTY
    clean = [int(i) for i in np.flatnonzero(toxic == 0) if len(docs[i]) > 2 * PAD + 4]
    down: list[tuple[int, np.ndarray]] = []
    boost, best = weight.copy(), (np.inf, EMPTY)
    for turn in range(ROUNDS):
        plain = turn < PLAIN
        up, share = [], []
        bad = [int(i) for i in np.flatnonzero(toxic == 1)]
        for i, part in zip(bad, _around([docs[i] for i in bad], table), strict=True):
            forms = [docs[i]] if plain else [docs[i], *stretched(part, rng)]
            for n, own in enumerate(_top(forms, table, spaced, plain)):
                up += own
                share += [boost[i] if not n else boost[i] / 4] * len(own)
        down += [x for own in _top([docs[i] for i in clean], table, spaced, plain, 1 if turn else 2) for x in own]
        forms = []
        for i in rng.choice(clean, min(len(clean), 800), replace=False) if clean else []:  # any spans of clean documents, and stretched ones
            at = int(rng.integers(PAD - 1, len(docs[i]) - PAD))
            part = docs[i][at : at + SPANS[1][1]]
            down.append((1, docs[i][at : at + int(rng.choice(SPANS[1])) + 2]))
            forms += [] if plain else stretched(part[part != NONE], rng)
        down += [x for own in _top(forms, table, spaced) for x in own]
        down = list({(step, d.tobytes()): (step, d) for step, d in down}.values())
        if not up:
            return EMPTY
        if len(down) > 9000:
            down = [down[i] for i in rng.permutation(len(down))[:9000]]
        # landmarks: spans of toxic documents, and of the others those that look most like them and any
        spans = [_features(*z) for z in up + down]
        likely = len(up) + np.argsort([-float((table[k] * v).sum()) for k, v in spans[len(up) :]], kind="stable")
        chosen = [*rng.permutation(len(up))[: LANDMARKS // 2], *likely[: LANDMARKS // 4], *(len(up) + rng.permutation(len(down))[: LANDMARKS // 4])]
        marks = [spans[i] for i in chosen]
        columns = np.unique(np.concatenate([k for k, _ in marks]))
        columns = columns[((columns & 63) != NONE) & ((columns >> BITS & 63) != NONE) & (columns >> 2 * BITS != NONE)]
        if not len(columns):
            return EMPTY
        c = _dense(marks, columns)
        val, vec = np.linalg.eigh(c.astype(np.float64) @ c.T)
        good = val > 1e-6 * max(val.max(), 1e-12)
        white = vec[:, good] / np.sqrt(val[good])
        x = np.vstack([_dense(spans[i : i + 500], columns) @ c.T for i in range(0, len(spans), 500)]).astype(np.float64) @ white
        x = np.hstack([x, np.array([[float(step > 1)] for step, _ in up + down])])
        y = np.where(np.arange(len(spans)) < len(up), 1.0, -1.0)
        many = np.concatenate([share, np.ones(len(down))])
        part = many / np.where(y > 0, 2 * many[y > 0].sum(), 2 * max(1.0, many[y < 0].sum()))
        w, bias = _svm(x, y, part)
        table = np.zeros(1 << 3 * BITS, np.float32)
        table[columns] = c.T @ (white @ w[:-1])
        spaced = float(w[-1])
        top = np.array([max(bias, found[0].max()) for found in _together(docs, table, bias, spaced, plain)])
        slope, offset = _curve(top, toxic.astype(float))
        wrong = (slope * top + offset >= 0) != (toxic == 1)
        rate = wrong[toxic == 1].mean() + wrong[toxic == 0].mean()
        if rate <= best[0] and not plain:
            best = rate, Model(table, bias, slope, offset, spaced)
        boost = np.where((toxic == 1) & (top < 0.8), 2 * boost, boost)  # a toxic document that isn't told counts more from now on
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learns from texts (doc_id, text) and labels (doc_id, toxic); at most ``rows`` labels of either kind, chosen by a hash.

    Only the chosen labels, a bounded number, are sent to the texts.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    fraction = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, rows / max(1, counts.get(0, 0)))))
    chosen = known.filter(place < fraction).limit(3 * rows)
    sample = docs.filter(F.col("text").isNotNull() & (F.length("text") <= ROW_CHARS)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.limit(6 * rows).toPandas().sort_values(["doc_id", "text"], kind="stable")
    return train(list(sample["text"]), sample["toxic"].to_numpy(np.int64))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, score (0 to 1) and predicted (1 from a score of 0.5 on)."""
    short_batches(docs.sparkSession)
    kinds = docs.select(*keep).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "score double", "predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            parts = [own.score(text_decisions(data, offsets, own)) for _, _, data, offsets in each_slice(batch.column(len(kinds)))]
            if parts:
                score = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(kinds))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*(f.name for f in kinds), "score", "predicted"]
                )

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(scored, schema)
