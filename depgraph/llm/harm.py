"""Problem 8: abusive, hateful or sexual content, by a convolutional text classifier in numpy."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on, at most (chosen by the hash of their id), and characters in all of them.
TRAIN_DOCUMENTS, TRAIN_CHARACTERS = 12_000, 64_000_000
#: Hash buckets of words and of their letter groups, size of an embedding, filters of each width, widths.
WORDS, GROUPS, SIZE, FILTERS, WIDTHS = 1 << 14, 1 << 14, 24, 24, (1, 2, 3, 4)
EPOCHS, BATCH, FOLDS = 8, 32, 2
#: Further segments of a harmless document that a step looks at.
MORE = 4
#: Labelled documents are richer in harmful ones than the corpus; harmless ones weigh so much more in the choice of thresholds.
PRIOR_WEIGHT = 4.0
#: F1 that a threshold may fall short of the best one.
NEARLY = 0.01
#: A harmful label whose out-of-fold score is below this is taken for a mistake, however many labels there are.
DOUBT = 0.06
#: Labelled documents of each kind that a language needs for a threshold of its own.
LANGUAGE_MIN = 12
#: Positions convolved at once, and words kept with their filter responses.
BLOCK, KEPT_WORDS = 16_384, 40_000
#: Words of a segment (a sentence or line; longer ones are cut, with so many words in both parts).
SEGMENT, SHARED = 64, 8

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏВМНКТАЕОРСХαοενρτιικυ", "aeopcyxijsdhlBMHKTAEOPCXaoevptiikuu"[: len("аеорсухіјѕԁһӏВМНКТАЕОРСХαοενρτιικυ")])
_LEET = str.maketrans("013457$@!|€", "oieastsaiie")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_]([ .\-_*]{1,2}))(?:[^\W\d_]\1)+[^\W\d_](?!\w)")
_TOKEN = re.compile(r"[\w$@!|€*#%+?-]*[^\W\d_][\w$@!|€*#%+?-]*")
_REPEAT = re.compile(r"(.)\1{2,}")


def normal_words(text: str) -> list[str]:
    """Words in one spelling: no accents, case, invisible characters, look-alike letters, digits for letters, spaced or stretched letters; hidden letters become ``?``."""
    t = unicodedata.normalize("NFKD", text)
    if not t.isascii():
        t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Mn", "Cc") or c in "\n\t").translate(_LOOKALIKE)
    t = _SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]), t)
    out = []
    for w in _TOKEN.findall(t):
        if not w.isalpha():
            body = w.strip("!?*#%+-_|")
            for piece in re.split(r"[-+]", body) if not re.search(r"\d", body) else [body]:
                if not piece:
                    continue
                letters = sum(map(str.isalpha, piece))
                if letters < 2 and len(piece) > 2 or letters * 3 < len(piece) or len(piece) > 40:
                    out.append("#")
                    continue
                piece = re.sub(r"[*#%?]|(?<=\w)_(?=\w)", "?", piece.translate(_LEET))
                parts = piece.split("?")
                # several whole words joined by signs are names of things, not hidden letters
                out += [x.lower() for x in parts if x] if len(parts) > 1 and min(len(x) for x in parts[1:-1] or parts) > 3 else [_REPEAT.sub(r"\1", piece.lower())]
            continue
        out.append(_REPEAT.sub(r"\1", w.lower()))
    return out


_BREAK = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])")


def segments(text: str) -> list[list[str]]:
    """The sentences and lines of a text as lists of normal words; empty ones are left out."""
    out = []
    for part in _BREAK.split(text):
        words = normal_words(part) if part else []
        if len(words) <= SEGMENT:
            if words:
                out.append(words)
        else:
            out += [words[i : i + SEGMENT] for i in range(0, len(words) - SHARED, SEGMENT - SHARED)]
    return out


def _bucket(s: str, n: int) -> int:
    return xxhash.xxh3_64_intdigest(s) % n


def word_features(word: str) -> tuple[int, list[int]]:
    """Hash bucket of a word and those of its letter groups (three and four long, with word ends)."""
    w = f"<{word}>"
    groups = {w[i : i + k] for k in (3, 4) for i in range(len(w) - k + 1)}
    return _bucket(word, WORDS), sorted(_bucket(g, GROUPS) for g in groups)[:40]


@dataclass
class Model:
    """Word and letter group embeddings, filters (SIZE x sum(WIDTHS) * FILTERS), output weights, thresholds by language ("" for all)."""

    word: np.ndarray
    group: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def new(seed: int) -> Model:
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return Model(r.normal(0, 0.15, (WORDS, SIZE)).astype(np.float32), r.normal(0, 0.15, (GROUPS, SIZE)).astype(np.float32), r.normal(0, 0.2, (SIZE, sum(WIDTHS) * FILTERS)).astype(np.float32), np.zeros(n, np.float32), r.normal(0, 0.2, n).astype(np.float32), -2.0)

    def embed(self, feats: list[tuple[int, list[int]]]) -> np.ndarray:
        e = self.word[[f[0] for f in feats]]
        for i, (_, g) in enumerate(feats):
            e[i] += self.group[g].mean(axis=0)
        return e


def _columns(k: int, j: int) -> slice:
    """Columns of the filters of width WIDTHS[k] at offset j."""
    start = (sum(WIDTHS[:k]) + j) * FILTERS
    return slice(start, start + FILTERS)


def convolve(z: np.ndarray, ids: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at every position; ids index z (responses of single words), the last max(WIDTHS) - 1 positions are padding."""
    n = len(ids) - max(WIDTHS) + 1
    out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        part = z[ids[:n], _columns(k, 0)]
        for j in range(1, w):
            part = part + z[ids[j : n + j], _columns(k, j)]
        out[:, k * FILTERS : (k + 1) * FILTERS] = part
    return out + bias


class Scorer:
    """Scores texts with a fitted model; what a word contributes to the filters is computed once and kept."""

    def __init__(self, model: Model):
        self.m = model
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {"": 0}
        self.z = np.zeros((1024, self.m.filters.shape[1]), np.float32)

    def ids(self, words: list[str]) -> list[int]:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            at = len(self.index)
            if at + len(new) > len(self.z):
                self.z = np.concatenate([self.z, np.zeros((max(len(self.z), at + len(new) - len(self.z)), self.z.shape[1]), np.float32)])
            self.z[at : at + len(new)] = self.m.embed([word_features(w) for w in new]) @ self.m.filters
            for i, w in enumerate(new):
                self.index[w] = at + i
        return [self.index[w] for w in words]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability per text: that of its worst segment. Texts of any length are convolved in blocks. 0 where there are no words."""
        pad = max(WIDTHS) - 1
        best = np.full(len(texts), -np.inf)
        ids, cuts, owner = [], [], []

        def run():
            if ids:
                r = convolve(self.z, np.array(ids + [0] * pad), self.m.bias)
                top = np.maximum(np.maximum.reduceat(r, cuts, axis=0)[::2], 0)  # every second stretch is padding
                np.maximum.at(best, owner, top @ self.m.out + self.m.out_bias)
            ids.clear()
            cuts.clear()
            owner.clear()

        for i, t in enumerate(texts):
            for words in segments(t) if t else ():
                if len(self.index) > KEPT_WORDS:
                    run()
                    self.reset()
                cuts += [len(ids), len(ids) + len(words)]
                owner.append(i)
                ids += self.ids(words) + [0] * pad
                if len(ids) >= BLOCK:
                    run()
        run()
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)


def _train(docs: list[list[list[int]]], feats: list[tuple[int, list[int]]], y: np.ndarray, seed: int, epochs: int = EPOCHS) -> Model:
    """Adagrad on the cross entropy of each document's worst segment. docs: segments of word numbers, of which 0 is padding; feats by word number."""
    m, r = Model.new(seed), np.random.default_rng(seed)
    pad = max(WIDTHS) - 1
    sums = {k: np.full(getattr(m, k).shape if k not in ("word", "group") else (len(getattr(m, k)), 1), 1e-3, np.float32) for k in ("word", "group", "filters", "bias", "out")}
    bias_sum = 1e-3
    word_of = np.array([f[0] for f in feats])
    width = max(len(f[1]) for f in feats)
    groups = np.zeros((len(feats), width), np.int64)
    mask = np.zeros((len(feats), width), np.float32)
    for i, (_, g) in enumerate(feats):
        groups[i, : len(g)], mask[i, : len(g)] = g, 1 / max(1, len(g))
    pos = max(1e-3, y.mean())
    rate = 0.08
    n_out = len(WIDTHS) * FILTERS
    for epoch in range(epochs):
        order = r.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            some = [i for i in order[lo : lo + BATCH].tolist() if docs[i]]
            if not some:
                continue
            flat = np.array([w for i in some for seg in docs[i] for w in (*seg, *[0] * pad)] + [0] * pad, np.int64)
            size = np.array([len(seg) + pad for i in some for seg in docs[i]])
            cuts = np.cumsum(size) - size
            flat = np.where((flat > 0) & (r.random(len(flat)) < 0.1), 0, flat) if epoch < epochs - 1 else flat  # word dropout
            used, at = np.unique(flat, return_inverse=True)
            g, k = groups[used], mask[used]
            e = m.word[word_of[used]] + np.einsum("ug,ugd->ud", k, m.group[g])
            e[used == 0] = 0
            z = e @ m.filters
            conv = convolve(z, at, m.bias)
            logit = np.maximum(np.maximum.reduceat(conv, np.stack([cuts, cuts + size - pad], axis=1).ravel(), axis=0)[::2], 0) @ m.out
            many = np.array([len(docs[i]) for i in some])
            first = np.cumsum(many) - many
            worst = np.array([f + int(logit[f : f + n].argmax()) for f, n in zip(first.tolist(), many.tolist())])
            truth, share = y[some], np.ones(len(some), np.float32)
            # every segment of a harmless document is harmless, so some more of them serve as examples
            more = [(f + int(x)) for f, n, t in zip(first.tolist(), many.tolist(), truth.tolist()) if t < 0.5 and n > 1 for x in r.integers(0, n, MORE)]
            worst = np.concatenate([worst, np.array(more, np.int64)])
            truth, share = np.concatenate([truth, np.zeros(len(more), np.float32)]), np.concatenate([share, np.full(len(more), 1 / MORE, np.float32)])
            arg = np.array([c + conv[c : c + n].argmax(axis=0) for c, n in zip(cuts[worst].tolist(), (size[worst] - pad).tolist())])
            h = np.maximum(conv[arg, np.arange(n_out)], 0)
            keep = (r.random(h.shape) > 0.2) / 0.8
            hd = h * keep
            p = 1 / (1 + np.exp(-np.clip(hd @ m.out + m.out_bias, -30, 30)))
            t = truth * 0.94 + 0.03
            wt = np.where(truth > 0.5, min(3.0, 0.5 / pos), 1.0) * share
            d = ((p - t) * wt / len(some)).astype(np.float32)
            grads = {"out": hd.T @ d + 1e-4 * m.out}
            dh = (d[:, None] * m.out) * keep * (h > 0)
            dz = np.zeros_like(z)
            for kk, w in enumerate(WIDTHS):
                cols = np.arange(kk * FILTERS, (kk + 1) * FILTERS)
                a, gd = arg[:, cols], dh[:, cols]
                for j in range(w):
                    c = np.arange(_columns(kk, j).start, _columns(kk, j).stop)
                    np.add.at(dz, (at[a + j], np.broadcast_to(c, a.shape)), gd)
            grads["bias"] = dh.sum(axis=0)
            grads["filters"] = e.T @ dz + 1e-5 * m.filters
            de = dz @ m.filters.T
            de[used == 0] = 0
            for name, gr in grads.items():
                sums[name] += gr * gr
                getattr(m, name)[...] -= rate * gr / np.sqrt(sums[name])
            gb = float(d.sum())
            bias_sum += gb * gb
            m.out_bias -= rate * gb / bias_sum**0.5
            live = np.abs(de).sum(axis=1) > 0
            real = k[live] > 0
            row = np.nonzero(real)[0]
            for name, idx, val in (("word", word_of[used[live]], de[live]), ("group", g[live][real], de[live][row] * k[live][real][:, None])):
                if not len(idx):
                    continue
                order_ = np.argsort(idx, kind="stable")
                idx = idx[order_]
                cut = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
                acc, uniq = np.add.reduceat(val[order_], cut, axis=0), idx[cut]
                sums[name][uniq] += (acc * acc).mean(axis=1, keepdims=True)
                getattr(m, name)[uniq] -= rate * acc / np.sqrt(sums[name][uniq])
    return m


def _threshold(p: np.ndarray, y: np.ndarray, weight: float) -> float:
    """The middle of the scores that give almost the best F1 when harmless documents weigh ``weight``."""
    grid = np.round(np.arange(0.2, 0.951, 0.01), 2)
    f = []
    for t in grid:
        tp, fp, fn = ((p >= t) & (y > 0.5)).sum(), ((p >= t) & (y < 0.5)).sum() * weight, ((p < t) & (y > 0.5)).sum()
        f.append(2 * tp / max(1e-9, 2 * tp + fp + fn))
    good = grid[np.array(f) >= max(f) - NEARLY]
    return float(good[len(good) // 2])


def language(lang: str | None) -> str:
    """The language behind a tag, "" if unknown: case and region don't matter."""
    s = (lang or "").strip().lower()
    return "" if s in ("", "und", "unknown") else re.split(r"[-_]", s)[0]


Sample = tuple[list[list[list[int]]], list[tuple[int, list[int]]], np.ndarray]


def _sample(texts: list[str], harmful: np.ndarray) -> Sample:
    """Segments of word numbers (0 is padding), features by word number, and labels (0 or 1)."""
    index: dict[str, int] = {"": 0}
    docs = [[[index.setdefault(w, len(index)) for w in ws] for ws in segments(t)] for t in texts]
    return docs, [word_features(w) for w in index], (np.asarray(harmful, np.float32) > 0.5).astype(np.float32)


def _fold(n: int, folds: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n) % folds


def held_out(texts: list[str], harmful: np.ndarray, f: int, folds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, scores) of the documents of fold f, by a model of the others."""
    docs, feats, y = _sample(texts, harmful)
    fold = _fold(len(y), folds, seed)
    rest, mine = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
    return mine, Scorer(_train([docs[i] for i in rest], feats, y[rest], seed + f)).score([texts[i] for i in mine])


def final(texts: list[str], langs: list[str], harmful: np.ndarray, part: np.ndarray, seed: int) -> Model:
    """The model of all documents whose label the held-out scores ``part`` don't contradict, with thresholds calibrated on all of them."""
    docs, feats, y = _sample(texts, harmful)
    wrong = (y > 0.5) & (part < DOUBT) | (y < 0.5) & (part > 0.9)
    good = np.flatnonzero(~wrong)
    m = _train([docs[i] for i in good], feats, y[good], seed)
    names = np.array([language(x) for x in langs])
    m.thresholds = {"": _threshold(part, y, PRIOR_WEIGHT)}
    for name in set(names.tolist()) - {""}:
        mine = np.flatnonzero(names == name)
        if min((y[mine] > 0.5).sum(), (y[mine] < 0.5).sum()) >= LANGUAGE_MIN:
            m.thresholds[name] = _threshold(part[mine], y[mine], PRIOR_WEIGHT)
    return m


def constant(harmful: np.ndarray, seed: int) -> Model:
    """Without labels of both kinds: every document has the share of harmful labels (0 without labels), none is flagged."""
    m, share = Model.new(seed), (np.asarray(harmful) > 0.5).mean() if len(harmful) else 0.0
    m.out[:] = 0
    m.out_bias = float(np.log(max(1e-6, share) / max(1e-6, 1 - share)))
    m.thresholds = {"": 1.1}
    return m


def one_kind(harmful: np.ndarray) -> bool:
    y = np.asarray(harmful) > 0.5
    return len(y) < 4 or y.min() == y.max()


def fit(texts: list[str], langs: list[str], harmful: np.ndarray, seed: int = 1, folds: int = FOLDS) -> Model:
    """A model of the labels (0 to 1, raters averaged), fitted in this process.

    Scores for documents out of the fold they were fitted on serve twice: labels that contradict them strongly are
    taken for mistakes and left out of the final fit, and the thresholds by language are calibrated on all of them.
    """
    if one_kind(harmful):
        return constant(harmful, seed)
    part = np.empty(len(texts))
    for f in range(folds):
        mine, scores = held_out(texts, harmful, f, folds, seed)
        part[mine] = scores
    return final(texts, langs, harmful, part, seed)


def labelled(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, characters: int = TRAIN_CHARACTERS) -> DataFrame:
    """(doc_id, text, lang, harmful) of at most ``limit`` labelled documents with at most ``characters`` in all; harmful is the mean of their raters, nulls and ties left out."""
    votes = labels.where("doc_id IS NOT NULL AND harmful IS NOT NULL").groupBy("doc_id").agg(F.avg("harmful").alias("harmful")).where("harmful <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows
    sizes = rows.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most ``limit`` rows
    fit_in = sizes.withColumn("upto", upto).where(F.col("upto") <= characters).select("doc_id")
    return rows.join(F.broadcast(fit_in), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, seed: int = 1, folds: int = FOLDS) -> Model:
    """The model of :func:`fit`, fitted by tasks: one per fold, then one for the final model. The sample goes to them as a broadcast; its size is bounded."""
    spark = docs.sparkSession
    rows = sorted(labelled(docs, labels, limit).collect(), key=lambda r: (r["doc_id"], r["text"], r["lang"] or "", r["harmful"]))
    texts, langs, harmful = [r["text"] for r in rows], [r["lang"] for r in rows], np.array([r["harmful"] for r in rows])
    if one_kind(harmful):
        return constant(harmful, seed)
    sample = spark.sparkContext.broadcast((texts, langs, harmful))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                mine, scores = held_out(sample.value[0], sample.value[2], f, folds, seed)
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(scores, pa.float64())], ["i", "score"])

    part = np.empty(len(texts))
    for i, score in spark.range(0, folds, 1, folds).mapInArrow(fold, "i bigint, score double").collect():
        part[i] = score

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _ in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(final(*sample.value, part, seed))], pa.binary())], ["model"])

    model = pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(last, "model binary").first()[0])
    sample.unpersist()
    return model


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            score = scorer.score(b.column(3).to_pylist())
            limit = np.array([model.thresholds.get(language(x), model.thresholds[""]) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.round(score, 6)), pa.array(score >= limit)], ["doc_id", "lang", "source", "score", "harmful"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, lang, source, score, harmful) of every row.

    The model is fitted on at most ``limit`` labelled documents and applied to the whole text of every
    document where it's read. Null, empty and wordless texts score 0 and aren't harmful; documents
    with an unknown language are held against the threshold of all. Rows are kept as they are; extra columns
    are ignored; empty tables give no rows.
    """
    model = train(docs, labels, limit)
    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(_score_batches(model), f"doc_id {kinds['doc_id']}, lang string, source string, score double, harmful boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, harmful ones and their rate per source (case and blanks don't matter)."""
    return scored.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n_docs"), F.count_if("harmful").alias("n_harmful"), F.avg(F.col("harmful").cast("double")).alias("rate"))
