"""Language identification by interpolated Kneser-Ney character models kept in sorted hash arrays.

Training counts the character 4-grams of a bounded sample of labelled documents (SAMPLE documents of each language,
picked by id hash, read whole) in Spark; continuation counts, discounts and interpolation follow from these counts on
the driver. Texts are lower-cased; what is no letter becomes one space. A text's language is the one whose model gives
the lowest cross-entropy for each character. A second sample, disjoint from the first, calibrates how far above its
language's usual cross-entropy a text may lie before it is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget_codecs, materialize, operator

#: Bound of the samples: documents of each language to count n-grams in, and to calibrate rejection on.
SAMPLE, CALIBRATION = 1500, 300
#: Languages up to which the sample's ids (SAMPLE + CALIBRATION of each) are broadcast, and buckets of a language in which
#: rows are ranked before the language's own ranking, so that no task sorts all rows of one.
LANGUAGES, BUCKETS = 1000, 1024
ORDER = 4
#: Code points read at a time, and the odd factor of the (bijective) 64-bit hash.
BATCH_CHARS, FACTOR = 1 << 18, np.uint64(0x9E3779B97F4A7C15)
#: Rejection: this many times the calibrated excess, taken where this share of the calibration documents lies below.
MARGIN, QUANTILE = 1.5, 0.99


def symbols(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (16 bits a symbol, the predicted one lowest) of all texts, and where each text begins.

    letters: symbol by code point, 0 for what is no letter; runs of those become one symbol 0, as does the start.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    s = letters[points].astype(np.uint64)
    keep = (s != 0) | (np.r_[np.uint64(1), s[:-1]] != 0)
    keep[begin[:-1][begin[:-1] < len(s)]] = True
    kept = np.r_[0, np.cumsum(keep)]
    s, start = s[keep], kept[begin]
    place = np.arange(len(s)) - np.repeat(start[:-1], np.diff(start))
    grams = s.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(s)
        before[back:] = s[: len(s) - back]
        grams |= np.where(place >= back, before, np.uint64(0)) << np.uint64(16 * back)
    return grams, start


def letter_table(alphabet: str) -> np.ndarray:
    """Symbols of all code points: letters of the alphabet (lower case) from 2 on, other letters 1, all else 0.

    A symbol has 16 bits; of an alphabet of more letters than these name, several share a symbol."""
    number = {c: i % 65_533 + 2 for i, c in enumerate(sorted(set(alphabet)))}
    out = np.zeros(0x110000, np.uint16)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            out[p] = number.get(c.lower()[0], 1)
    return out


class Level:
    """log-probabilities of the k-grams and log-weights of their contexts, as sorted hash arrays."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, contexts: np.ndarray, weight: np.ndarray):
        self.keys, self.logp = _sorted(grams, logp)
        self.contexts, self.weight = _sorted(contexts, weight)


def _sorted(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = codes * FACTOR
    by = np.argsort(h)
    return h[by], values[by].astype(np.float32)


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    h = codes * FACTOR
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


class KneserNey:
    """One language's model, from its packed 4-grams and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, vocabulary: int):
        tables = {ORDER: (grams, counts.astype(float))}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols come before
            g, n = np.unique(tables[k + 1][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
            tables[k] = (g, n.astype(float))
        self.floor = -np.log(vocabulary)
        self.levels: dict[int, Level] = {}
        lower = lambda g: np.full(len(g), 1.0 / vocabulary)
        for k in range(1, ORDER + 1):
            g, n = tables[k]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            contexts, inverse = np.unique(g >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, n), np.bincount(inverse)
            weight = discount * kinds / total
            p = np.maximum(n - discount, 0) / total[inverse] + weight[inverse] * lower(g & np.uint64((1 << 16 * (k - 1)) - 1))
            self.levels[k] = Level(g, np.log(p), contexts, np.log(weight))
            lower = lambda x, k=k: np.exp(self.logp(x, k))

    def logp(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Interpolated log-probability of the lowest symbol of each gram given those before it."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(order, 0, -1):
            level, g = self.levels[k], grams[open_] & np.uint64((1 << 16 * k) - 1)
            at, known = _find(level.keys, g)
            out[open_[known]] += level.logp[at[known]]
            open_, g = open_[~known], g[~known]
            at, known = _find(level.contexts, g >> np.uint64(16))
            out[open_[known]] += level.weight[at[known]]
        out[open_] += self.floor
        return out


class Model:
    """All languages' models, one table of the 4-grams that any has seen, and the rejection limits."""

    def __init__(self, alphabet: str, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.alphabet, self.langs = alphabet, sorted(counts)
        self.models = [KneserNey(*counts[x], len(alphabet) + 2) for x in self.langs]
        grams = np.unique(np.concatenate([counts[x][0] for x in self.langs])) if counts else np.zeros(0, np.uint64)
        self.keys, by = grams * FACTOR, None
        by = np.argsort(self.keys)
        self.keys, grams = self.keys[by], grams[by]
        self.table = np.stack([m.logp(grams) for m in self.models], axis=1).astype(np.float32) if counts else np.zeros((0, 0), np.float32)
        self.usual, self.near, self.far = (np.full(len(self.langs), x) for x in (0.0, np.inf, np.inf))
        self._letters: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_letters": None}

    @property
    def letters(self) -> np.ndarray:
        if self._letters is None:
            self._letters = letter_table(self.alphabet)
        return self._letters

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) cross-entropies in nats a symbol, numbers of symbols, and whether a text has a letter."""
        grams, start = symbols(texts, self.letters)
        n = np.diff(start)
        at, known = _find(self.keys, grams)
        logp = self.table[at] if len(self.table) else np.zeros((len(grams), len(self.langs)), np.float32)
        if not known.all():
            new, inverse = np.unique(grams[~known], return_inverse=True)
            logp[~known] = np.stack([m.logp(new) for m in self.models], axis=1)[inverse]
        full = n > 0
        sums = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), bool)
        if full.any():
            sums[full] = np.add.reduceat(logp.astype(np.float64), start[:-1][full], axis=0)
            letters[full] = np.maximum.reduceat(grams & np.uint64(0xFFFF), start[:-1][full]) > 0
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, lang: np.ndarray) -> None:
        """Limits from documents of known language: usual cross-entropy, and the excess that long and short texts reach."""
        for i in range(len(self.langs)):
            own = lang == i
            if own.any():
                e, m = entropy[own, i], n[own]
                self.usual[i] = np.median(e)
                over = np.maximum(e - self.usual[i], 0)
                self.near[i] = MARGIN * max(np.quantile(over, QUANTILE), 0.5 * self.usual[i])
                self.far[i] = MARGIN * np.quantile(over * np.sqrt(m), QUANTILE)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and acceptance of each text."""
        if not self.langs:
            z = np.zeros(len(texts))
            return ["und"] * len(texts), z, z, z > 0
        e, n, letters = self.entropies(texts)
        best = e.argmin(axis=1)
        low = e[np.arange(len(e)), best]
        score = 1 / np.exp(np.maximum(-50, -(e - low[:, None]) * np.minimum(n, 40)[:, None])).sum(axis=1)
        fits = letters & (low - self.usual[best] <= np.maximum(self.near[best], self.far[best] / np.sqrt(np.maximum(n, 1))))
        return [self.langs[i] if x else "und" for i, x in zip(best, letters, strict=True)], np.where(letters, score, 0.0), low, fits


def _portions(texts: list[str]) -> Iterator[slice]:
    """Runs of whole texts of about BATCH_CHARS code points."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def sample_of(df: DataFrame, bound: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text and rank of at most bound rows of each language, by hash of the id.

    Rows are ranked without their texts, in buckets first; the chosen ones, bound for each language at most, are
    broadcast to the texts, unless there are more than LANGUAGES languages.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    named = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("i"))
    order = [F.xxhash64("i", F.lit(19)), F.col("i")]
    first = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("i", F.lit(23)), F.lit(BUCKETS))).orderBy(*order))
    chosen = named.distinct().withColumn("rank", first).filter(F.col("rank") <= bound)
    chosen = materialize(chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= bound), "language-ids")
    few = chosen.select("lang").distinct().limit(LANGUAGES + 1).count() <= LANGUAGES
    texts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen) if few else chosen, ["lang", "i"]).select("lang", "rank", "text")


@operator
def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """Fit on the rows of df with a language: at most sample documents of each to count, and calibration more to calibrate."""
    ranked = materialize(sample_of(df, sample + calibration, id_col, text_col, lang_col), "language-sample")
    every = int(max(2, round((sample + calibration) / max(calibration, 1))))
    fit, held = ranked.filter(F.col("rank") % every != 0), ranked.filter(F.col("rank") % every == 0)

    def alphabet_of(batches):
        forget_codecs()
        for b in batches:
            found = set("".join(t or "" for t in b.column(0).to_pylist()).lower())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(c for c in found if c.isalpha()), pa.string())], ["c"])

    letters = "".join(r["c"] for r in fit.select("text").mapInArrow(alphabet_of, "c string").distinct().collect())  # at most as many as Unicode has
    shared: dict[str, np.ndarray] = {}

    def count(batches):
        if "t" not in shared:
            shared["t"] = letter_table(letters)
        for b in batches:
            langs = np.array(b.column(0).to_pylist())
            texts = b.column(1).to_pylist()
            for lang in np.unique(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for part in _portions(own):
                    g, n = np.unique(symbols(own[part], shared["t"])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "g", "n"])

    counted = fit.select("lang", "text").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toPandas()
    model = Model(letters, {lang: (part["g"].to_numpy().astype(np.uint64), part["n"].to_numpy()) for lang, part in counted.groupby("lang")})
    if model.langs:
        shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

        def entropy(batches):
            for b in batches:
                lang, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for part in _portions(texts):
                    e, n, ok = shipped.value.entropies(texts[part])
                    own = np.array([shipped.value.langs.index(x) if x in shipped.value.langs else -1 for x in lang[part]])
                    use = np.flatnonzero(ok & (own >= 0))
                    yield pa.RecordBatch.from_arrays([pa.array(own[use].astype(np.int64)), pa.array(n[use].astype(np.int64)), pa.array(e[use, own[use]])], ["lang", "n", "e"])

        seen = held.select("lang", "text").mapInArrow(entropy, "lang long, n long, e double").toPandas()
        wide = np.zeros((len(seen), len(model.langs)))
        wide[np.arange(len(seen)), seen["lang"]] = seen["e"]
        model.calibrate(wide, seen["n"].to_numpy(), seen["lang"].to_numpy())
    return model


@operator
def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang_pred, score, cross_entropy, accepted and the columns in keep, one row a row; reads whole texts.

    lang_pred is und for a null text or one without a letter; score (0 to 1) is the posterior of the chosen language
    over at most 40 symbols. accepted is false for und and for texts further from every model than calibration allows.
    Defined cases: repeated rows and null ids give a row each; columns in keep that have the names of the results are left
    out; without any model all is und; an empty table gives no rows.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in keep if c not in (id_col, text_col, "lang_pred", "score", "cross_entropy", "accepted")]
    kept = [id_col, *([text_col] if text_col in keep else []), *extra]

    def run(batches):
        forget_codecs()
        m = shipped.value
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            texts = [t or "" for t in b.column(kept.index(text_col) if text_col in kept else len(kept)).to_pylist()]
            for part in _portions(texts):
                lang, score, e, ok = m.predict(texts[part])
                rows = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), pa.array(lang, pa.string()), pa.array(score), pa.array(e), pa.array(ok)], [*kept, "lang_pred", "score", "cross_entropy", "accepted"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    read = df.select(*(F.col(c) for c in kept), *([] if text_col in kept else [F.col(text_col).alias("_text")]))
    return read.mapInArrow(run, f"{types}, lang_pred string, score double, cross_entropy double, accepted boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
