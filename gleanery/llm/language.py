"""Languages of documents and of the passages of mixed documents (problem 9).

Method: nearest-centroid classification. Text becomes normalised TF-IDF vectors of character n-grams (2 to 5 characters, within
words, with marks at their borders; signed hashing into ``DIMS`` dimensions, which keeps inner products). Every language has
several centroids, found by clustering its training sentences; the nearest centroid by cosine decides, and text that is farther
from all of them than nearly all training text is rejected (``und``). The model is fitted on a bounded sample of labelled rows
(``PER_LANGUAGE`` documents of each language, lowest hash first), and so are its n-gram weights; all else covers every row, whole
texts and words of any length. Every language of ISO 639-1 can be learned.

Labels are noisy, so a label is learned only if its held-out documents are recognised by it, and training sentences are classified
once by the first centroids, and only those that agree with their document's label and with most of the document stay.

Defined results: a sentence is a stretch of a paragraph that ends with ``.``, ``!``, ``?`` or an ellipsis and has at least
``LEAST_WORDS`` words; paragraphs are the non-empty blocks between blank lines, counted from 0. Null or empty texts, and texts
whose words are all rejected, have language ``und`` with confidence 0. Texts without a sentence are classified as a whole.
Repeated documents are each classified. With no labelled row, or an empty table, nothing can be fitted and the result is empty.
Columns beside key, text and label are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 512
GRAMS = (2, 3, 4, 5)
#: n-grams that fewer training sentences hold have no weight (invented words would outweigh all else).
LEAST_DF = 40
IDF_BITS = 16
PER_LANGUAGE = 300
CENTROIDS = 32
LEAST_WORDS = 5
#: Training quantile of the cosine below which text is rejected, and the slack under it.
REJECT_QUANTILE, REJECT_SLACK = 0.001, 0.5
#: Share of a label's held-out sentences that must be recognised for it to be a language of its own.
LEARNABLE = 0.6
#: Cosine of two centroids that stand for the same sentences, and the difference at which a sentence is not of its label.
SAME, CLEARLY = 0.8, 0.2
#: A sentence counts as another language than its document's main one only if it is closer by this much.
MARGIN = 0.13

#: Further spellings of labels, beside those that the Java runtime knows of every language: its two-letter code, its three-letter
#: code and its English name (fixed values: bibliographic codes, and names of variants).
SPELLINGS = {
    "ger": "de", "fre": "fr", "dut": "nl", "cze": "cs", "rum": "ro", "gre": "el", "chi": "zh", "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "geo": "ka",
    "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "slo": "sk", "tib": "bo", "wel": "cy", "castilian": "es", "nob": "no", "nb": "no",
}
_KNOWN: list[dict[str, str]] = []


def label_names(spark: SparkSession) -> dict[str, str]:
    """Two-letter code of every label: all languages of ISO 639-1, by code of two or three letters or English name of one word."""
    if not _KNOWN:
        locale, names = spark._jvm.java.util.Locale, {}
        for code in locale.getISOLanguages():
            this = locale.forLanguageTag(code)
            for name in (code, this.getISO3Language(), this.getDisplayLanguage(locale.ENGLISH).lower()):
                if re.fullmatch("[a-z]+", name):
                    names.setdefault(name, code)
        _KNOWN.append(names | SPELLINGS)
    return _KNOWN[0]


def with_label_code(df: DataFrame, label: Column, *columns: Column) -> DataFrame:
    """``columns`` and ``label_code``, which is null where the label names no language: labels may be codes with or without
    region, or English names."""
    names = df.sparkSession.createDataFrame(sorted(label_names(df.sparkSession).items()), "_word string, label_code string")
    worded = df.select(*columns, F.regexp_extract(F.lower(label), r"^[\s\p{Z}]*([a-z]+)", 1).alias("_word"))
    return worded.join(F.broadcast(names), "_word", "left").drop("_word")  # a few hundred names


_PARAGRAPH = re.compile(r"\r?\n(?:[^\S\n]*\r?\n)+")
_SENTENCE = re.compile(r"[^.!?…]*(?:[.!?…](?!\s|$)[^.!?…]*)*[.!?…]+(?=\s|$)[\"'»”’)]*", re.S)
_WORD = re.compile(r"[^\W\d_]+")
#: Soft hyphens, joiners, direction marks and the like, which stand inside words without being part of them.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")

_DIVIDED = re.compile(r"(?<=[^\W\d_])-\r?\n(?=[^\W\d_])")


def clean(text: str) -> str:
    """Composed accents, no hidden characters, and words that a line end divides joined."""
    text = text if text.isascii() else unicodedata.normalize("NFC", _HIDDEN.sub("", text))
    return _DIVIDED.sub("", text) if "-\n" in text else text


def paragraphs(text: str) -> list[str]:
    return [p for p in _PARAGRAPH.split(text) if p.strip()]


def sentences(paragraph: str) -> list[str]:
    """The whole sentences of a paragraph (see the module's text)."""
    return [s for s in _SENTENCE.findall(paragraph) if len(_WORD.findall(s)) >= LEAST_WORDS]


class Features:
    """Word vectors, made once per distinct word of a worker, and their sums over spans."""

    def __init__(self, idf: np.ndarray | None = None) -> None:
        self.idf = idf
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, DIMS), np.float32)

    @staticmethod
    def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, n-gram hash) of all n-grams of the marked words."""
        joined = "".join([f"\x02{w}\x03" for w in words])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner, ends = np.repeat(np.arange(len(words)), lens), np.cumsum(lens)
        at, out = [], []
        for n in GRAMS:
            h = np.full(max(0, len(codes) - n + 1), np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            for i in range(n):
                h = (h ^ codes[i : i + len(h)]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            inside = np.arange(len(h)) + n <= ends[owner[: len(h)]]
            at.append(owner[: len(h)][inside])
            out.append(h[inside])
        return np.concatenate(at), np.concatenate(out)

    def word_ids(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            if len(ids) > 400_000:  # bounds a worker's memory; nothing but speed depends on what is kept
                ids.clear()
                new = list(dict.fromkeys(words))
            start = len(ids)
            ids.update(zip(new, range(start, start + len(new)), strict=True))
            if len(ids) > len(self.rows):
                self.rows = np.concatenate([self.rows[:start], np.zeros((max(len(ids) * 2, 1024) - start, DIMS), np.float32)])
            for a in range(0, len(new), 20_000):
                w, h = self.grams(new[a : a + 20_000])
                weight = self.idf[(h >> np.uint64(64 - IDF_BITS)).astype(np.int64)] * np.where(h & np.uint64(1 << 20), 1.0, -1.0)
                dim = (h % np.uint64(DIMS)).astype(np.int64)
                n = min(20_000, len(new) - a)
                self.rows[start + a : start + a + n] = np.bincount(w * DIMS + dim, weight, n * DIMS).reshape(n, DIMS)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def vectors(self, spans: list[list[str]]) -> np.ndarray:
        """Normalised vectors of lists of lower-case words; zero for empty lists.

        Spans are taken longest first, and the k-th words of all spans that have one are added at once.
        """
        out = np.zeros((len(spans), DIMS), np.float32)
        lens = np.array([len(s) for s in spans], int)
        for a in range(0, len(spans), 2000):
            n = lens[a : a + 2000]
            ids = self.word_ids([w for s in spans[a : a + 2000] for w in s])
            order = np.argsort(-n, kind="stable")
            starts = (np.cumsum(n) - n)[order]
            longest = n[order]
            total = np.zeros((len(n), DIMS), np.float32)
            for k in range(longest[0] if len(n) else 0):
                live = int(np.searchsorted(-longest, -k, "left"))
                total[:live] += self.rows[ids[starts[:live] + k]]
            out[a + order] = total
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def _clusters(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means with a fixed start."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    """Languages, their centroids and the distance beyond which text is rejected."""

    def __init__(self, docs: list[tuple[str, str]]) -> None:
        """docs: pairs of language and text."""
        owner, spans, labels = [], [], []
        for i, (lang, text) in enumerate(docs):
            for p in paragraphs(clean(text)):
                for s in sentences(p):
                    owner.append(i)
                    labels.append(lang)
                    spans.append(_WORD.findall(s.lower()))
        if not spans:
            raise ValueError("no labelled sentences to learn from")
        df = np.zeros(1 << IDF_BITS)
        for a in range(0, len(spans), 2000):
            part = spans[a : a + 2000]
            words = sorted({w for s in part for w in s})
            number = {w: i for i, w in enumerate(words)}
            w, h = Features.grams(words)
            slot = (h >> np.uint64(64 - IDF_BITS)).astype(np.int64)
            order = np.argsort(w, kind="stable")
            cuts = np.searchsorted(w[order], np.arange(len(words) + 1))
            for s in part:
                df[np.unique(np.concatenate([slot[order[cuts[number[x]] : cuts[number[x] + 1]]] for x in set(s)]))] += 1
        self.idf = np.where(df >= min(LEAST_DF, 1 + len(spans) // 500), np.log((1 + len(spans)) / (1 + df)) + 0.1, 0).astype(np.float32)
        self.features = Features(self.idf)
        x = self.features.vectors(spans)
        lab, own = np.array(labels), np.array(owner)
        self.languages = sorted(set(labels))
        good = self._own_language(x, lab)
        keep = good & self._learnable(np.where(good[:, None], x, 0), np.where(good, lab, ""), own)
        usable = keep
        for _ in range(3):
            self._fit(x[keep], lab[keep])
            got = self._scores(x).argmax(1)
            agree = (np.array(self.languages)[got] == lab) & usable
            share = np.bincount(own, agree, len(docs)) / np.maximum(1, np.bincount(own, minlength=len(docs)))
            keep = agree & (share[own] > 0.5)
            self.languages = [l for l in self.languages if (lab[keep] == l).any()]
        self._fit(x[keep], lab[keep])
        top = self._scores(x[keep]).max(1)
        self.least = float(np.quantile(top, REJECT_QUANTILE) * REJECT_SLACK)

    def _learnable(self, x: np.ndarray, lab: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which sentences belong to a label that stands for a language: one that is recognised in documents that its centroids
        were not made from. Labels given to texts of other languages only are not."""
        half = own % 2 == 0
        self.languages = [l for l in self.languages if l and (lab[half] == l).any() and (lab[~half] == l).any()]
        known = np.isin(lab, self.languages)
        if not self.languages:
            raise ValueError("too few labelled documents to learn from")
        self._fit(x[half & known], lab[half & known])
        test = ~half & np.isin(lab, self.languages)
        right = np.array(self.languages)[self._scores(x[test]).argmax(1)] == lab[test]
        self.languages = [l for l in self.languages if right[lab[test] == l].mean() > LEARNABLE] or self.languages
        return np.isin(lab, self.languages)

    def _fit(self, x: np.ndarray, lab: np.ndarray) -> None:
        """Centroids of every language. One that all but equals a centroid with more support in another language is dropped: it
        stands for passages of that language inside documents of this one."""
        parts = [_clusters(x[lab == l], CENTROIDS) for l in self.languages]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        every = np.concatenate(parts).astype(np.float32)
        support = np.zeros(len(every))
        for i, l in enumerate(self.languages):
            own = np.flatnonzero(of == i)
            mine = x[lab == l]
            support[own] = np.bincount((mine @ every[own].T).argmax(1), minlength=len(own))
        twin = (every @ every.T >= SAME) & (of[:, None] != of[None, :]) & (support[None, :] > support[:, None])
        good = ~twin.any(1) & (support > 0)
        self.languages = [l for i, l in enumerate(self.languages) if good[of == i].any()]
        of, self.centroids = of[good], every[good]
        self.starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))

    def _own_language(self, x: np.ndarray, lab: np.ndarray) -> np.ndarray:
        """Sentences that are not clearly nearer to the mean of another label than to that of their own."""
        mean = np.stack([x[lab == l].sum(0) for l in self.languages])
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
        s = x @ mean.T
        at = np.searchsorted(self.languages, lab)
        return s.max(1) - s[np.arange(len(x)), at] <= CLEARLY

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x @ self.centroids.T, self.starts, axis=1)

    def scores(self, spans: list[list[str]]) -> np.ndarray:
        """Cosine of each span with the nearest centroid of each language."""
        return self._scores(self.features.vectors(spans))


def confidence(top: float, second: float, least: float) -> float:
    """1 where nothing else is near, 0 where two languages are as near or the text is rejected."""
    if top < least or top <= 0:
        return 0.0
    return float(min(1.0, max(0.0, (top - max(second, 0.0)) / top)))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """The model from at most ``per_language`` labelled documents of each language, those with the lowest hash of the key."""
    coded = with_label_code(docs, F.col(label), F.xxhash64(F.lit("language"), key).alias("h"), F.col(text).alias("t")).withColumnRenamed("label_code", "l")
    coded = coded.where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in coded.groupBy("l").agg(F.count("*").alias("n")).collect()}  # codes of ISO 639-1 only
    rows: list[tuple[str, str]] = []
    if counts:
        # hashes below a bound that about twice as many rows keep to; the exact cut is made by the order
        span = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(2**53))
        rate = F.try_element_at(F.create_map(*[x for l, n in sorted(counts.items()) for x in (F.lit(l), F.lit(min(1.0, (2.0 * per_language + 50) / n)))]), F.col("l"))
        per: dict[str, list] = {}
        for r in coded.where(span < rate).collect():  # about 2 * per_language + 50 documents a language
            per.setdefault(r["l"], []).append((r["h"], r["t"]))
        rows = [(l, t) for l in sorted(per) for _, t in sorted(per[l])[:per_language]]
    try:
        return Model(rows)
    except ValueError:  # nothing to learn from
        return None


SEGMENTS = "par_no int, lang string, confidence double, n_sentences int, doc_lang string, doc_confidence double, mixed boolean"


def segments(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """One row per document (par_no -1) and, for documents that mix languages, one per paragraph and language of whole
    sentences in it: ``(key, label_code, SEGMENTS)``."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, label_code string, {SEGMENTS}"
    if model is None:
        return spark.createDataFrame([], schema)
    spark_model = spark.sparkContext.broadcast((model.languages, model.starts, model.centroids, model.idf, model.least))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.__new__(Model)
        m.languages, m.starts, m.centroids, m.idf, m.least = spark_model.value
        m.features = Features(m.idf)
        for part in parts:
            for a in range(0, len(part), 500):
                yield classify(m, part.iloc[a : a + 500], key)

    rows = with_label_code(docs, F.col(label), F.col(key), F.col(text).alias("t"))
    return rows.mapInPandas(run, schema)


def classify(m: Model, part: pd.DataFrame, key: str) -> pd.DataFrame:
    spans, where = [], []
    for i, t in enumerate(part["t"]):
        if t is None:
            continue
        before, t = len(spans), clean(t)
        for p_no, p in enumerate(paragraphs(t)):
            if p[-1] in " \n\r\t" or any(c in p for c in ".!?…"):
                for s in _SENTENCE.findall(p):
                    words = _WORD.findall(s.lower())
                    if len(words) >= LEAST_WORDS:
                        spans.append(words)
                        where.append((i, p_no))
        if len(spans) == before:
            spans.append(_WORD.findall(t.lower()))
            where.append((i, -1))
    score = m.scores(spans) if spans else np.zeros((0, len(m.languages)), np.float32)
    owner = np.array([w[0] for w in where], int)
    sizes = np.array([len(s) for s in spans], float)
    out = []
    ids, codes = part[key].to_numpy(), part["label_code"].to_numpy()
    cuts = np.searchsorted(owner, np.arange(len(part) + 1))
    n_lang = len(m.languages)
    for i in range(len(part)):
        a, b = cuts[i], cuts[i + 1]
        row = lambda par, lang, conf, n, dl, dc, mixed, i=i: out.append((ids[i], codes[i], par, lang, conf, n, dl, dc, mixed))
        if a == b or not sizes[a:b].sum():
            row(-1, "und", 0.0, 0, "und", 0.0, False)
            continue
        sc, top = score[a:b], score[a:b].argmax(1)
        ok = sc.max(1) >= m.least
        weight = np.bincount(top[ok], sizes[a:b][ok], n_lang)
        if not weight.any():
            row(-1, "und", 0.0, 0, "und", 0.0, False)
            continue
        main = int(weight.argmax())
        # a sentence is of another language only if that is clearly nearer than the main one
        other = ok & (top != main) & (sc.max(1) - sc[:, main] > MARGIN)
        lang = np.where(other, top, main)
        mean = np.average(sc[~other], axis=0, weights=sizes[a:b][~other]) if (~other).any() else sc.mean(0)
        conf = confidence(float(mean[main]), float(np.delete(mean, main).max()) if n_lang > 1 else 0.0, m.least)
        whole = np.array([w[1] for w in where[a:b]]) >= 0
        mixed = bool((other & whole).any()) and len(set(lang[ok & whole])) > 1
        row(-1, m.languages[main], conf, int(whole.sum()), m.languages[main], conf, mixed)
        if mixed:
            groups: dict[tuple[int, int], list[int]] = {}
            for k in np.flatnonzero(ok & whole):
                groups.setdefault((where[a + k][1], int(lang[k])), []).append(k)
            for (par, l), ks in sorted(groups.items()):
                s = sc[ks].mean(0)
                c = confidence(float(s[l]), float(np.delete(s, l).max()) if n_lang > 1 else 0.0, m.least)
                row(par, m.languages[l], c, len(ks), m.languages[main], conf, True)
    cols = [key, "label_code", *[f.split()[0] for f in SEGMENTS.split(", ")]]
    return pd.DataFrame(out, columns=cols)


def wrong_labels(seg: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of one language with a missing or other label (par_no -1), and the passages of mixed documents."""
    single = (F.col("par_no") == -1) & ~F.col("mixed") & (F.col("lang") != "und") & ~F.col("lang").eqNullSafe(F.col("label_code"))
    passage = F.col("mixed") & (F.col("par_no") >= 0)
    return seg.where(single | passage).select(key, "par_no", "lang")
