"""Language identification with interpolated Kneser-Ney character models.

One character 3-gram model per language.  Texts are lower-cased, runs of
anything but letters become one blank.  All models share sorted arrays of
n-gram hashes with one column of log probabilities per language, so a batch
of text is scored for every language with one search per symbol; n-grams that
no language has fall back to the next order in the same way.  The language
with the lowest cross-entropy per symbol wins.

A text is rejected when that cross-entropy is higher than is usual for texts
of its length (``Model.threshold``): calibration texts, cut to several lengths,
are scored by their own language's model and, as texts of a language that was
not learned, by those of the others.

The models are fitted on a bounded sample of labelled rows: for each language
``SAMPLE_DOCS`` different documents in the order of a hash.  Texts of up to
``PIECE_CHARS`` characters are learned whole; a longer one gives ``PIECES``
pieces of together as many characters, one at a hashed place of each of
``PIECES`` equal parts of its whole length.  Every fifth document is
kept for calibration.  This bounds the model by SAMPLE_DOCS * PIECE_CHARS
n-grams a language; scoring reads whole texts, long ones in slices that hand
their last two symbols on.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, lowest, packed, slices, unpacked
from .words import mix

SAMPLE_DOCS = 800
PIECE_CHARS = 3000
PIECES = 4
FALSE_REJECTIONS = 0.001
FOREIGN = 0.05  # quantile of the scores by other models that counts as theirs: some texts are partly in another language
LENGTHS = (8, 16, 32, 64, 128, 256, 512)  # symbols; longer texts are held to the limit of the last
CUTS = 2000     # calibration texts of each length and language
_U = np.uint64
_BITS = _U(21)
_START, _BLANK = 1, 32
_SLICE = 1 << 18


def letter_table() -> np.ndarray:
    """One bit for each code point: is it a letter (Unicode category L)?"""
    return np.packbits(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))


def symbols(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts one after another (start mark, blank, text, blank), and each text's number of letters."""
    parts = [t.lower() for t in texts]
    joined = "\x01 " + " \x01 ".join(p.replace("\x01", " ") for p in parts) + " "
    sym, letter = _folded(joined, letters)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != _BLANK) | (sym[:-1] != _BLANK)
    starts = np.flatnonzero(sym == _START)
    return sym[keep], np.add.reduceat(letter.astype(np.int64), starts)


def _folded(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with blanks for all but letters and start marks, and which are letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (letters[code >> 3] >> (7 - (code & 7)).astype(np.uint8) & 1).astype(bool)
    return np.where(letter | (code == _START), code, np.uint32(_BLANK)), letter


def symbol_slices(text: str, letters: np.ndarray, size: int):
    """The symbols of one text in slices of about ``size``, each after the two symbols before it (at first the start
    mark and a blank), and each slice's number of letters: together those of ``symbols``."""
    lowered = text.lower().replace("\x01", " ")
    before = np.array([_START, _BLANK], np.uint32)
    for a in range(0, len(lowered) + 1, size):
        part = lowered[a:a + size]
        sym, letter = _folded(part if a + size <= len(lowered) else part + " ", letters)
        whole = np.concatenate([before, sym])
        keep = (whole != _BLANK) | (np.concatenate([[_START], whole[:-1]]) != _BLANK)
        keep[:2] = True
        whole = whole[keep]
        yield whole, int(letter.sum())
        before = whole[-2:]


class Model:
    """Kneser-Ney models of several languages in shared sorted hash arrays."""

    ORDER = 3

    def __init__(self, texts: dict[str, list[str]], letters: np.ndarray):
        self.languages = sorted(texts)
        grams = []  # per language: counts of each order, highest as seen, lower by distinct left neighbours
        for lang in self.languages:
            sym, _ = symbols(texts[lang], letters)
            at = predicted(sym)
            code = [sym[at - 2].astype(_U), sym[at - 1].astype(_U), sym[at].astype(_U)]
            tri, n3 = np.unique(np.stack(code, 1), axis=0, return_counts=True)
            bi, n2 = np.unique(tri[:, 1:], axis=0, return_counts=True)
            uni, n1 = np.unique(bi[:, 1:], axis=0, return_counts=True)
            grams.append(((uni, n1), (bi, n2), (tri, n3)))
        size = len(np.unique(np.concatenate([g[0][0][:, 0] for g in grams]))) if grams else 0
        self.unseen = -np.log(size + 1.0)
        self.tables = []    # per order: (sorted hashes, log probabilities [n, languages])
        self.contexts = []  # per order > 1: (sorted hashes of contexts, log of the mass left to the lower order)
        for order in (1, 2, 3):
            rows = [g[order - 1] for g in grams]
            every = np.unique(np.concatenate([r[0] for r in rows]), axis=0) if rows else np.zeros((0, order), _U)
            ctx = np.unique(every[:, :-1], axis=0)
            left = np.zeros((len(ctx), len(rows)))
            top = np.zeros((len(every), len(rows)))
            for k, (g, n) in enumerate(rows):
                once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
                d = once / (once + 2 * twice) if once and twice else 0.5
                where = _find(ctx, g[:, :-1])
                total = np.bincount(where, n, len(ctx))
                kinds = np.bincount(where, minlength=len(ctx))
                with np.errstate(divide="ignore", invalid="ignore"):
                    left[:, k] = np.where(total > 0, np.log(d * kinds / total), 0.0)
                top[_find(every, g), k] = (n - d) / total[where]
            lower = self._log_lower(every[:, 1:], order)
            logp = np.log(top + np.exp(left[_find(ctx, every[:, :-1])] + lower)) if len(every) else top
            self.tables.append(_sorted(_hash(every), logp))
            self.contexts.append(_sorted(_hash(ctx), left) if order > 1 else left)
        self.limits = np.full((len(self.languages), len(LENGTHS)), -self.unseen)
        self.sharpness = 1.0

    def _log_lower(self, suffix: np.ndarray, order: int) -> np.ndarray:
        if order == 1:
            return np.full((len(suffix), len(self.languages)), self.unseen)
        return self._logp([suffix[:, j] for j in range(suffix.shape[1])])

    def _logp(self, cols: list[np.ndarray]) -> np.ndarray:
        """Log probabilities [n, languages] of symbol cols[-1] after the others."""
        order = len(cols)
        if order == 0:
            return np.zeros((0, len(self.languages)))
        hashes, logp = self.tables[order - 1]
        h = _hash_cols(cols)
        at = np.searchsorted(hashes, h)
        at[at == len(hashes)] = 0
        ok = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
        out = np.empty((len(h), len(self.languages)), logp.dtype)
        out[ok] = logp[at[ok]]
        miss = np.flatnonzero(~ok)
        if len(miss):
            if order == 1:
                out[miss] = self.contexts[0][0] + self.unseen if len(self.contexts[0]) else self.unseen
            else:
                some = [c[miss] for c in cols]
                ch, left = self.contexts[order - 1]
                c = _hash_cols(some[:-1])
                at = np.searchsorted(ch, c)
                at[at == len(ch)] = 0
                seen = ch[at] == c
                out[miss] = np.where(seen[:, None], left[at], 0.0) + self._logp(some[1:])
        return out

    def entropies(self, texts: list[str], letters: np.ndarray):
        """Cross-entropy per symbol [texts, languages], numbers of symbols and of letters."""
        if len(texts) == 1 and len(texts[0]) > _SLICE:
            total, n, n_letters = np.zeros((1, len(self.languages))), 0, 0
            for sym, some in symbol_slices(texts[0], letters, _SLICE):
                s = sym.astype(_U)
                total += self._logp([s[:-2], s[1:-1], s[2:]]).sum(axis=0, dtype=np.float64)
                n, n_letters = n + len(s) - 2, n_letters + some
            return -total / max(n, 1), np.array([n]), np.array([n_letters])
        sym, n_letters = symbols(texts, letters)
        at = predicted(sym)
        cols = [sym[at - 2].astype(_U), sym[at - 1].astype(_U), sym[at].astype(_U)]
        logp = self._logp(cols)
        starts = np.flatnonzero(sym == _START)
        first = np.searchsorted(at, starts)
        n = np.diff(np.append(first, len(at)))
        total = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(n > 0)
        if len(full):
            total[full] = np.add.reduceat(logp, first[full], axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, n_letters

    def calibrate(self, texts: dict[str, list[str]], letters: np.ndarray) -> None:
        """The cross-entropy beyond which a text is rejected, for each language and length, and the sharpness of the scores.

        By length, all but FALSE_REJECTIONS of a language's own texts are accepted; where the
        model's scores of other languages' texts lie higher, the limit is halfway to their FOREIGN quantile.
        """
        k, bins = len(self.languages), len(LENGTHS)
        own, other = np.full((k, bins), -np.inf), np.full((k, bins), np.inf)
        cases, apart = [], [[[] for _ in range(bins)] for _ in range(k)]
        for i, lang in enumerate(self.languages):
            if texts.get(lang):
                h, n, _ = self.entropies(texts[lang], letters)
                cases.append((i, h, n))
                scored = [(h, n, np.ones(len(n), bool))]
                for size in LENGTHS:
                    h, n, some = self.entropies(_cuts(texts[lang], size), letters)
                    scored.append((h, n, some > 0))
                h, n = (np.concatenate([x[j][x[2]] for x in scored]) for j in (0, 1))
                at = _length_class(n)
                for c in np.unique(at):
                    own[i, c] = np.quantile(h[at == c, i], 1 - FALSE_REJECTIONS)
                    for j in range(k):
                        if j != i:
                            apart[j][c].append(h[at == c, j])
        own = np.where(np.isfinite(own).any(axis=1, keepdims=True), own, own.max(axis=0, initial=-np.inf))
        for i in range(k):
            for c in range(bins):
                g = np.concatenate(apart[i][c]) if apart[i][c] else np.zeros(0)
                # a text of symbols at random costs -unseen
                other[i, c] = min(np.quantile(g, FOREIGN), -self.unseen) if len(g) else -self.unseen
        # a longer text is no farther off than a shorter one
        own = np.maximum.accumulate(own[:, ::-1], axis=1)[:, ::-1]
        self.limits = np.where(np.isfinite(own), np.maximum(own, (own + other) / 2), -self.unseen)
        self.limits = np.maximum.accumulate(self.limits[:, ::-1], axis=1)[:, ::-1]
        best = np.inf
        for t in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
            loss = sum(-np.log(posterior(h, n, t)[:, i] + 1e-12).sum() for i, h, n in cases)
            if loss < best:
                best, self.sharpness = loss, t

    def threshold(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Cross-entropy over which a text of n symbols is not taken for the language, between two lengths in
        proportion to the logarithm of n."""
        at = np.clip(np.log2(np.maximum(n, 1) / LENGTHS[0]), 0, len(LENGTHS) - 1)
        low = np.minimum(at.astype(int), len(LENGTHS) - 2)
        return self.limits[lang, low] * (1 + low - at) + self.limits[lang, low + 1] * (at - low)


def _length_class(n: np.ndarray) -> np.ndarray:
    """The nearest of LENGTHS (powers of two) by ratio."""
    return np.clip(np.rint(np.log2(np.maximum(n, 1) / LENGTHS[0])), 0, len(LENGTHS) - 1).astype(int)


def _cuts(texts: list[str], size: int) -> list[str]:
    """At most about CUTS pieces of ``size`` characters, from all over the texts that are longer."""
    every = [(k, a) for k, t in enumerate(texts) for a in range(0, len(t) - size, size)]
    return [texts[k][a:a + size] for k, a in every[::-(-len(every) // CUTS) or 1]]


def posterior(h: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    x = -(h - h.min(axis=1, keepdims=True)) * (n * sharpness)[:, None]
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


def predicted(sym: np.ndarray) -> np.ndarray:
    """Positions of the symbols that are predicted: all but the start marks and the blanks after them."""
    ok = sym != _START
    ok[1:] &= sym[:-1] != _START
    return np.flatnonzero(ok)


def _hash_cols(cols: list[np.ndarray]) -> np.ndarray:
    k = np.zeros(len(cols[0]), _U)
    for c in cols:
        k = (k << _BITS) | c
    return mix(k)


def _hash(rows: np.ndarray) -> np.ndarray:
    if rows.shape[1] == 0:
        return np.zeros(len(rows), _U)
    return _hash_cols([rows[:, j].astype(_U) for j in range(rows.shape[1])])


def _find(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row numbers of ``rows`` in ``table`` (distinct rows that hold them all)."""
    h = _hash(table)
    order = np.argsort(h)
    return order[np.searchsorted(h[order], _hash(rows))]


def _sorted(h: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    return h[order], np.ascontiguousarray(values[order].astype(np.float32))


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        train=None) -> tuple[Model, np.ndarray]:
    """Model from the bounded sample of the rows where ``train`` holds and language and text are not null."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.filter(F.col(f"`{lang_col}`").isNotNull() & text.isNotNull())
    if train is not None:
        rows = rows.filter(train)
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"),
                       text.alias("text"))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("kinds"))  # one row a language
    few = rows.join(F.broadcast(kinds), "lang").filter(lowest(F.col("h"), F.col("kinds"), SAMPLE_DOCS))
    part = F.length("text") / PIECES
    spare = F.greatest(part - PIECE_CHARS // PIECES, F.lit(0.0))  # places to choose from in each part
    place = lambda i: F.floor(i * part + F.pmod(F.xxhash64("h", i), F.lit(1 << 20)) / (1 << 20) * spare).cast("int") + 1
    pieces = F.when(F.length("text") <= PIECE_CHARS, F.array("text")).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", place(i), F.lit(PIECE_CHARS // PIECES))))
    # repeated rows count once; they are merged in each task
    few = few.groupBy("lang", "h").agg(F.min(pieces).alias("pieces"))
    first = Window.partitionBy("lang").orderBy("h")
    sample = few.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE_DOCS) \
        .orderBy("lang", "k").collect()  # SAMPLE_DOCS * PIECE_CHARS characters a language
    letters = letter_table()
    own, spare = {}, {}
    for r in sample:
        (spare if r["k"] % 5 == 0 else own).setdefault(r["lang"], []).extend(r["pieces"])
    model = Model(own, letters)
    model.calibrate(spare, letters)
    return model, letters


def predict(docs: DataFrame, model: Model, letters: np.ndarray, text_col: str = "text",
            columns: list[str] | None = None) -> DataFrame:
    """The input's columns (or ``columns``) plus lang_pred, score (0 to 1), cross_entropy (nats per
    symbol) and rejected.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned; such
    rows are rejected.  Equal cross-entropies go to the language that sorts first.  Input columns
    of the same names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = ["lang_pred", "score", "cross_entropy", "rejected"]
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() not in own]
    shared = spark.sparkContext.broadcast(packed((model, letters)))  # bounded by the sample
    carried = {c: f"c{k}" for k, c in enumerate(names) if c != text_col}
    with_text = text_col in names
    flat = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in carried.items()], F.col(f"`{text_col}`").alias("text"))
    through = [f for f in flat.schema.fields if with_text or f.name != "text"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in through] +
                       ["lang_pred string, score double, cross_entropy double, rejected boolean"])
    out_names = [f.name for f in through] + own

    def run(batches):
        m, table = unpacked(shared)
        names_of = np.array(m.languages + ["und"], object)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            lang, score = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
            entropy, rejected = np.full(len(texts), np.nan), np.ones(len(texts), bool)
            for lo, hi in slices(sizes, _SLICE) if m.languages else ():
                h, n, n_letters = m.entropies(texts[lo:hi], table)
                best = h.argmin(axis=1)
                rows = np.arange(len(best))
                ok = n_letters > 0
                lang[lo:hi] = np.where(ok, best, len(m.languages))
                score[lo:hi] = np.where(ok, posterior(h, n, m.sharpness)[rows, best], 0.0)
                entropy[lo:hi] = np.where(ok, h[rows, best], np.nan)
                rejected[lo:hi] = ~ok | (h[rows, best] > m.threshold(best, n))
            yield pa.RecordBatch.from_arrays(
                [b.column(x) for x in out_names[:-4]] +
                [pa.array(names_of[lang], pa.string()), pa.array(score, pa.float64()),
                 pa.array(entropy, pa.float64(), mask=np.isnan(entropy)), pa.array(rejected, pa.bool_())], out_names)

    out = flat.mapInArrow(run, schema)
    return out.select(*[F.col(carried.get(c, "text")).alias(c) for c in names], *own)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4,
             fold: int = 2, columns: list[str] | None = None) -> DataFrame:
    """Learn from the rows whose crc32(id as text) mod ``folds`` is not ``fold``; predict every row (see ``predict``),
    with ``held_out``.  Nulls in id or language are allowed (a null language teaches nothing); an empty table
    gives an empty result."""
    test = held_out(id_col, folds, fold)
    model, letters = fit(docs, lang_col, id_col, text_col, train=~test)
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() != "held_out"]
    return predict(docs, model, letters, text_col, columns=names).withColumn("held_out", test)
