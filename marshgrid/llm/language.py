"""Language identification: the family first, then pairwise linear SVMs within it.

Features are hashed byte n-grams (one to three bytes) of the text with letters only, square
roots of their shares, scaled to length one; whole texts are read.  Families are told apart by
one-versus-one linear support vector machines, and so are the languages inside the family
that wins; votes count, margins break ties.

The machines are fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled texts a language
in hash order, for every language with ``MIN_ROWS`` labelled rows (in a table of few rows, with
``MIN_SHARE`` of them).  The driver fits the machines of few languages; those of more than
``DRIVER_LANGUAGES`` are fitted by tasks, one pair each, and only weights reach the driver.
Prediction uses the text alone and runs where the text is.

Defined results: a null text or one without a letter is ``und`` with score 0, as is any text
if there is nothing to learn from; with one language learned every other text gets it; rows
that repeat are predicted alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshgrid.llm import common as C

DIMENSIONS = 4096
PER_LANGUAGE, MIN_ROWS, MIN_SHARE = 400, 20, 0.01
#: The driver holds the sampled texts' features of at most so many languages.
DRIVER_LANGUAGES = 30
#: Related languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"), "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk"),
}
UNKNOWN = "und"

# ASCII letters in lower case and bytes of longer characters count; the rest is one separator.
_FOLD = np.zeros(256, dtype=np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII = np.zeros(256, dtype=bool)
_ASCII[97:123] = _ASCII[65:91] = True


def features(raw: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dimensions, float32) and which rows hold a letter."""
    n = len(offsets) - 1
    sums = np.zeros((n, dimensions), dtype=np.float32)
    letter = np.zeros(n, dtype=bool)
    for i in range(n):
        # A long text is counted piece by piece; pieces overlap by what an n-gram needs.
        for lo in range(offsets[i], offsets[i + 1], C.SLICE_BYTES):
            part = raw[lo:min(offsets[i + 1], lo + C.SLICE_BYTES + 2)]
            own = min(len(part), C.SLICE_BYTES)
            letter[i] |= bool(_ASCII[part].any())
            a = _FOLD[part]
            # A separator that follows another one is left out.
            for width in (1, 2, 3):
                m = min(own, len(part) - width + 1)
                if m <= 0:
                    continue
                code = np.zeros(m, dtype=np.uint64)
                for k in range(width):
                    code = code * np.uint64(257) + a[k:k + m]
                used = (a[:m] > 0) | (a[1:m + 1] > 0) if width > 1 else a[:m] > 0
                slot = (((code[used] + np.uint64(width << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(dimensions)
                sums[i] += np.bincount(slot.astype(np.int64), minlength=dimensions)
        if not letter[i] and (raw[offsets[i]:offsets[i + 1]] >= 128).any():
            letter[i] = any(c.isalpha() for c in raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    root = np.sqrt(sums)
    norm = np.linalg.norm(root, axis=1, keepdims=True)
    return root / np.maximum(norm, 1e-12), letter


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights and bias of a linear SVM (hinge loss) by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    size = (x * x).sum(1)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(a[i] - gradient / size[i], 0.0), cost)
            if new != a[i]:
                moved = max(moved, abs(new - a[i]))
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
        if moved < 1e-3:
            break
    return w


class Identifier:
    """Family machines and, per family, language machines."""

    def __init__(self, x: np.ndarray | None, langs: list[str], families: dict, machines: dict | None = None):
        """Fit on features and their languages, or take fitted ``machines`` of the languages."""
        of = {lang: name for name, members in families.items() for lang in members}
        own = np.array([of.get(lang, lang) for lang in langs])
        langs = np.array(langs)
        self.families = sorted(set(own))
        self.members = {family: sorted(set(langs[own == family])) for family in self.families}
        if machines is not None:
            self.machines = machines
            return
        self.machines = {"": self._pairs(x, own, self.families)}
        for family in self.families:
            self.machines[family] = self._pairs(x[own == family], langs[own == family], self.members[family])

    @staticmethod
    def _pairs(x, label, names):
        return {(i, j): svm(x[(label == a) | (label == b)], np.where(label[(label == a) | (label == b)] == a, 1.0, -1.0))
                for i, a in enumerate(names) for j, b in enumerate(names) if i < j}

    @staticmethod
    def _decide(x, names, machines):
        """Winner of the pairwise votes for each row, and how sure its closest duel was."""
        votes, sums = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        margins = {}
        for (i, j), w in machines.items():
            m = margins[i, j] = x @ w[:-1] + w[-1]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            sums[:, i] += np.clip(m, -1, 1)
            sums[:, j] -= np.clip(m, -1, 1)
        win = (votes + 0.49 * sums / max(1, len(names))).argmax(1)
        least = np.full(len(x), np.inf)
        for (i, j), m in margins.items():
            least = np.where(win == i, np.minimum(least, m), np.where(win == j, np.minimum(least, -m), least))
        return win, 1 / (1 + np.exp(-2 * least))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self._decide(x, self.families, self.machines[""])
        out = np.empty(len(x), dtype=object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(rows):
                win, own = self._decide(x[rows], self.members[name], self.machines[name])
                out[rows] = np.array(self.members[name], dtype=object)[win]
                sure[rows] *= own
        return list(out), sure


def _feature_batches(batches):
    for batch in batches:
        raw, offsets = C.text_buffers(batch.column("text"))
        for lo, hi in C.slices(offsets):
            x, letter = features(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            keep = np.flatnonzero(letter)
            langs = batch.column("lang").slice(lo, hi - lo).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([langs, pa.array([x[i].tobytes() for i in keep], pa.binary())], names=["lang", "x"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict = FAMILIES,
          per_language: int = PER_LANGUAGE, min_rows: int = MIN_ROWS) -> Identifier | None:
    """Fit on at most ``per_language`` rows of each language, those with the smallest hash; None without any.

    A language is learned from ``min_rows`` labelled rows on, or fewer if they are ``MIN_SHARE`` of all.
    """
    C.ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().where(F.col("count") >= min(min_rows, MIN_SHARE * rows.count())).collect()}
    if not sizes:
        return None
    # A hash threshold thins each language to about twice the bound before rows are ranked.
    h = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20))
    limit = F.create_map(*[v for lang, n in sizes.items() for v in (F.lit(lang), F.lit(min(1 << 20, int(2 * per_language / n * (1 << 20)) + 64)))])
    thin = rows.where(F.col("lang").isin(list(sizes)) & (h < limit[F.col("lang")]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "id", "text"))
    got = thin.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text").mapInArrow(_feature_batches, "lang string, x binary")
    if len(sizes) > DRIVER_LANGUAGES:
        return _train_in_tasks(C.saved(got, "features"), families)
    got = got.collect()
    if not got:
        return None
    got = sorted(got)
    return Identifier(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.lang for r in got], families)


def _fit_pair(rows):
    """One machine: rows of both sides in the order in which the driver would have them."""
    import pandas as pd
    rows = rows.sort_values(["lang", "x"])
    w = svm(np.stack([np.frombuffer(x, np.float32) for x in rows.x]), rows.y.to_numpy())
    return pd.DataFrame({"node": [rows.node.iloc[0]], "i": [rows.i.iloc[0]], "j": [rows.j.iloc[0]], "w": [w.tobytes()]})


def _train_in_tasks(samples: DataFrame, families: dict) -> Identifier | None:
    """The same machines as the driver fits, each by one task from the samples (lang, x) of its two sides."""
    langs = sorted(r[0] for r in samples.select("lang").distinct().collect())
    if not langs:
        return None
    frame = Identifier(None, langs, families, {"": {}})
    sides = []
    for node, names in [("", frame.families), *frame.members.items()]:
        frame.machines[node] = {}
        for j in range(len(names)):
            for i in range(j):
                sides += [(lang, node, i, j, y) for k, y in ((i, 1.0), (j, -1.0)) for lang in (frame.members[names[k]] if node == "" else [names[k]])]
    if sides:
        table = samples.sparkSession.createDataFrame(sides, "lang string, node string, i int, j int, y double")
        fitted = samples.join(table, "lang").groupBy("node", "i", "j").applyInPandas(_fit_pair, "node string, i int, j int, w binary")
        for r in fitted.collect():
            frame.machines[r.node][r.i, r.j] = np.frombuffer(r.w, np.float64)
    return frame


def _predict_batches(model):
    def run(batches):
        for batch in batches:
            raw, offsets = C.text_buffers(batch.column("text"))
            for lo, hi in C.slices(offsets):
                x, letter = features(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                lang, score = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                some = np.flatnonzero(letter)
                if model is not None and len(some):
                    own, sure = model.predict(x[some])
                    score[some] = sure
                    for i, name in zip(some, own):
                        lang[i] = name
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Identifier | None, id_col: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text."""
    C.ship(docs.sparkSession)
    rows = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict_batches(model), f"id {kind}, lang_pred string, score double")
