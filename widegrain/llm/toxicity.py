"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first
four, five and six letters.  Filters of one, two and three words run over the
whole text; each gives its greatest response, and a logistic layer weighs them.
It is trained with Adam on a bounded sample of labelled documents and
calibrated on all other labelled documents that may be learned from, by counts
of their scores made by the executors: the score at which the two classes part
best becomes CUT, and each language gets a threshold of its own where it has
enough labels.  Documents count by how many their class has in all, fitted ones
included, so that the sample's bounds don't shift the mix.  A score depends on
the text alone.

Labels meet the text of their doc_id; of several texts with one doc_id the least
in code point order is learned from.

Defined cases: a null text counts as empty; an empty text has the score of the
filters' answer to padding; without labels of both classes every score is 0; a
null doc_id is never held out and has no label; a doc_id labelled twice counts
as toxic if any of its labels is; repeated rows are scored one by one; other
columns are ignored or, in reject_toxic(), kept; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, prepare, unpacked, whole_text

#: The sample for training: at most so many documents of each label, chosen by a hash of doc_id, of at most so many characters each.
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_CHARS = 2_000, 4_000, 20_000
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 16, 12, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.01, 1e-4
#: The score from which a text is predicted toxic; calibration moves the best cut there.
CUT = 0.7
#: Toxic documents that a language needs in the calibration set to get a threshold of its own.
LANGUAGE_LEAST = 8
#: A language's threshold stays in this range.
LANGUAGE_RANGE = (0.4, 0.9)
#: Counts of scores: bins of one logit, and the greatest logit told apart from greater ones.
BINS, BINS_END = 64, 64
#: Words whose projections a worker keeps.
CACHE_WORDS = 200_000


def parts_of(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings; bucket 0 is for what is missing."""
    h = xxhash.xxh32_intdigest
    return tuple(h(p.encode("utf-8", "surrogatepass"), seed=k) % (BUCKETS - 1) + 1 if p else 0 for k, p in enumerate((word, *(word[:n] if len(word) >= n else "" for n in PREFIXES))))


def plain(token: str) -> str:
    """A token without the marks around it."""
    if token.isalnum():
        return token
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    return token[start:end]


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x WIDTH
    filters: list[np.ndarray]  # for each span: span x WIDTH x FILTERS
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = True

    def projections(self, parts: np.ndarray) -> np.ndarray:
        """Answers of all filter positions to words given by their parts."""
        vectors = self.embedding[parts].sum(axis=1)
        return np.concatenate([vectors @ w for span in self.filters for w in span], axis=1)

    def pooled(self, proj: np.ndarray, starts: np.ndarray, where: bool = False):
        """Greatest answer of each filter in each text, and at which word it begins.

        Each text ends with two rows of padding; a span that begins there answers
        nothing, so none reaches the next text."""
        outs, ats, k = [], [], 0
        ends = np.append(starts[1:], len(proj))
        padding = np.concatenate([ends - 2, ends - 1])
        for span in SPANS:
            answer = proj[:, k * FILTERS : (k + 1) * FILTERS]
            k += 1
            for j in range(1, span):
                shifted = np.zeros_like(answer)
                shifted[:-j] = proj[j:, k * FILTERS : (k + 1) * FILTERS]
                answer = answer + shifted
                k += 1
            if span > 1:
                answer[padding] = 0
            outs.append(np.maximum.reduceat(answer, starts, axis=0))
            if where:
                ats.append(np.stack([a + answer[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)]))
        best = np.concatenate(outs, axis=1) + self.filter_bias
        return (best, np.concatenate(ats, axis=1)) if where else best

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.weights + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(logits))
        return 1 / (1 + np.exp(-np.clip(self.scale * (logits - self.shift) + np.log(CUT / (1 - CUT)), -30, 30)))


PAD = ["", ""]


def _words(text: str) -> list[str]:
    return [plain(t) for t in text.lower().split()] + PAD


def _initial(rows: list[np.ndarray], parts: np.ndarray, y: np.ndarray, rng) -> Model:
    """Small random values, but the first columns begin with how unevenly a part occurs in the two classes."""
    embedding = rng.normal(0, 0.03, (BUCKETS, WIDTH)).astype(np.float32)
    counts = np.zeros((2, BUCKETS, 1 + len(PREFIXES)), dtype=np.float32)
    for words, label in zip(rows, y, strict=True):
        own = parts[np.unique(words)]
        for k in range(own.shape[1]):
            counts[label, np.unique(own[:, k]), k] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], dtype=np.float32)
    both = (counts.sum(axis=0) + 1) / (n.sum() + 2)
    z = (counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    embedding[:, : z.shape[1]] = np.clip(z / 10, -1.5, 1.5)
    embedding[0] = 0
    filters = [rng.normal(0, 0.2, (span, WIDTH, FILTERS)).astype(np.float32) for span in SPANS]
    for f in filters:
        f[0, : z.shape[1], : FILTERS // 2] = np.abs(f[0, : z.shape[1], : FILTERS // 2]) + 0.3
    k = len(SPANS) * FILTERS
    return Model(embedding, filters, np.zeros(k, dtype=np.float32), rng.normal(0.2, 0.1, k).astype(np.float32), float(np.log(n[1] / n[0])))


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.float32), 0

    def step(self, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        value -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-6)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train on texts; labels has 0 and 1."""
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    known: dict[str, int] = {}
    # words as numbers at once: the driver holds each word once, not each time it stands in a text
    rows = [np.array([known.setdefault(w, len(known)) for w in _words(t)]) for t in texts]
    parts = np.array([parts_of(w) for w in known])
    model = _initial(rows, parts, y, rng)
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    adam = {k: _Adam(v.shape) for k, v in (("w", model.weights), ("b", model.filter_bias), *((s, f) for s, f in enumerate(model.filters)))}
    bias = np.array([model.bias], dtype=np.float32)
    adam_bias = _Adam(1)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(rows)), RATE * 0.6**epoch
        for k in range(0, len(order), BATCH):
            chosen = order[k : k + BATCH]
            model.bias = float(bias[0])
            words, inverse = np.unique(np.concatenate([rows[i] for i in chosen]), return_inverse=True)
            starts = np.cumsum([0] + [len(rows[i]) for i in chosen[:-1]])
            last = np.cumsum([len(rows[i]) for i in chosen])[:, None] - 1
            pooled, at = model.pooled(model.projections(parts[words])[inverse], starts, where=True)
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.weights + model.bias, -30, 30)))
            g = ((p - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grad_pooled = np.outer(g, model.weights) * (pooled > 0)
            adam["w"].step(model.weights, active.T @ g + DECAY * model.weights, rate)
            adam["b"].step(model.filter_bias, grad_pooled.sum(axis=0), rate)
            adam_bias.step(bias, np.array([g.sum()], dtype=np.float32), rate)
            grad_words = np.zeros((len(words), WIDTH), dtype=np.float32)
            for s, span in enumerate(SPANS):
                cols = slice(s * FILTERS, (s + 1) * FILTERS)
                gp, first = grad_pooled[:, cols], at[:, cols]
                grad_f = np.zeros_like(model.filters[s])
                for j in range(span):
                    place = np.minimum(first + j, last)
                    w = inverse[place]
                    vectors = model.embedding[parts[words[w]]].sum(axis=2)
                    grad_f[j] = np.einsum("df,dfe->ef", gp, vectors)
                    np.add.at(grad_words, w, gp[:, :, None] * model.filters[s][j].T[None])
                adam[s].step(model.filters[s], grad_f + DECAY * model.filters[s], rate)
            touched = np.flatnonzero(grad_words.any(axis=1))
            if len(touched):
                buckets = parts[words[touched]]
                np.add.at(model.embedding, buckets.ravel(), np.repeat(-rate * 5 * grad_words[touched], buckets.shape[1], axis=0))
                model.embedding[0] = 0
    model.bias = float(bias[0])
    return model


class Scorer:
    """Scores texts; keeps the projections of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        #: Rows of the table by token as it stands in texts, and by plain word; buckets by beginning.
        self.known, self.plain = {"": 0}, {"": 0}
        self.begun: list[dict[str, int]] = [{} for _ in PREFIXES]
        self.table = np.zeros((4096, sum(SPANS) * FILTERS), dtype=np.float32)
        self.used = 1

    def _learn(self, tokens: list[str]) -> None:
        plain_row, new, h = self.plain, [], xxhash.xxh32_intdigest
        for token in tokens:
            word = plain(token)
            row = plain_row.get(word)
            if row is None:
                row = plain_row[word] = self.used + len(new)
                new.append(word)
            self.known[token] = row
        if not new:
            return
        flat = [h(w.encode("utf-8", "surrogatepass"), seed=0) % (BUCKETS - 1) + 1 for w in new]
        for k, (n, begun) in enumerate(zip(PREFIXES, self.begun, strict=True), 1):
            if len(begun) > CACHE_WORDS:
                begun.clear()
            for w in new:
                if len(w) < n:
                    flat.append(0)
                    continue
                bucket = begun.get(w[:n])
                if bucket is None:
                    bucket = begun[w[:n]] = h(w[:n].encode("utf-8", "surrogatepass"), seed=k) % (BUCKETS - 1) + 1
                flat.append(bucket)
        while self.used + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        parts = np.array(flat).reshape(1 + len(PREFIXES), len(new)).T
        self.table[self.used : self.used + len(new)] = self.model.projections(parts)
        self.used += len(new)

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if len(self.known) > CACHE_WORDS:
            self._clear()
        split = [t.lower().split() for t in texts]
        self._learn(list(set().union(*split).difference(self.known)))
        of = self.known.__getitem__
        out, rows, starts, n = [], [], [], 0
        for words in split:
            starts.append(n)
            rows.append(np.fromiter(map(of, words), dtype=np.int64, count=len(words)))
            rows.append(np.zeros(len(PAD), dtype=np.int64))
            n += len(words) + len(PAD)
            if n > 50_000:
                out.append(self._part(rows, starts))
                rows, starts, n = [], [], 0
        if starts:
            out.append(self._part(rows, starts))
        return np.concatenate(out)

    def _part(self, rows: list[np.ndarray], starts: list[int]) -> np.ndarray:
        at = np.concatenate(rows)
        if len(at) > 200_000:  # one very long text: its blocks overlap by the longest span
            best = [self.model.pooled(self.table[at[k : k + 100_002]], np.array([0])) for k in range(0, len(at), 100_000)]
            if len(starts) == 1:
                return self.model.logits(np.maximum.reduce(best))
            return np.concatenate([self._part([at[a:b]], [0]) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)])
        return self.model.logits(self.model.pooled(self.table[at], np.array(starts)))


def _best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which F1 is greatest."""
    order = np.argsort(-logits)
    s, hit = logits[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1)) / 2)


def calibrate(model: Model, texts: list[str], labels: list[int], langs: list[str | None]) -> Model:
    logits, y = Scorer(model).logits(texts).astype(float), np.array(labels)
    if y.sum() and (y == 0).sum():
        model.shift = _best_cut(logits, y)
        apart = logits[y == 1].mean() - logits[y == 0].mean()
        model.scale = 8.0 / max(apart, 1e-3)
        for lang in {x for x in langs if x}:
            own = np.array([x == lang for x in langs])
            if y[own].sum() >= LANGUAGE_LEAST and (y[own] == 0).any():
                model.thresholds[lang] = float(np.clip(model.scores(np.array([_best_cut(logits[own], y[own])]))[0], *LANGUAGE_RANGE))
    return model


def remainder(column, mod: int):
    """crc32 of an id as text, modulo mod; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def cut_of_counts(bins: np.ndarray, counts: np.ndarray, weights: tuple[float, float]) -> float:
    """The logit at which F1 is greatest, from ascending bins of logits and the number of documents of each class in them."""
    other, toxic = (counts[::-1, k] * weights[k] for k in (0, 1))
    hit = np.cumsum(toxic)
    k = int((2 * hit / (hit + np.cumsum(other) + toxic.sum())).argmax())
    down = bins[::-1]
    return float((down[k] + (down[k + 1] + 1 if k + 1 < len(down) else down[k])) / 2 / BINS)


def _dense(bins, toxic, counts) -> tuple[np.ndarray, np.ndarray]:
    """Bins in order, and a row for each with the counts of both classes."""
    at, place = np.unique(np.asarray(bins), return_inverse=True)
    out = np.zeros((len(at), 2))
    np.add.at(out, (place, np.asarray(toxic)), np.asarray(counts))
    return at, out


def calibrate_on_all(model: Model, labelled: DataFrame, fitted: dict[tuple[str | None, int], int]) -> bool:
    """Set shift, scale and thresholds by all rows of labelled (bin, lang, toxic); False if a class is missing.

    fitted has the number of documents by language and class that the model was fitted on."""
    counts = labelled.groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")).persist()
    whole = counts.groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toArrow()
    bins, held = _dense(whole.column("bin"), whole.column("toxic"), whole.column("n"))
    have = held.sum(axis=0) if len(bins) else np.zeros(2)
    if have.all():
        weights = tuple((have[k] + sum(n for (_, t), n in fitted.items() if t == k)) / have[k] for k in (0, 1))
        mean = ((bins + 0.5) / BINS) @ held / have
        model.shift, model.scale = cut_of_counts(bins, held, weights), 8.0 / max(mean[1] - mean[0], 1e-3)

        def by_language(key, table):
            lang = key[0].as_py()
            at, own = _dense(table.column("bin"), table.column("toxic"), table.column("n"))
            n = own.sum(axis=0)
            cuts = []
            if n[1] >= LANGUAGE_LEAST and n[0]:
                cuts.append(cut_of_counts(at, own, tuple((n[k] + fitted.get((lang, k), 0)) / n[k] for k in (0, 1))))
            return pa.table({"lang": pa.array([lang] * len(cuts), pa.string()), "cut": pa.array(cuts, pa.float64())})

        for r in counts.where("lang != ''").groupBy("lang").applyInArrow(by_language, "lang string, cut double").collect():
            model.thresholds[r["lang"]] = float(np.clip(model.scores(np.array([r["cut"]]))[0], *LANGUAGE_RANGE))
    counts.unpersist()
    return bool(have.all())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the rows that may be learned from and calibrate on all others.

    The sample's ids come from the labels alone and are broadcast (their number
    is bounded); the others are scored where their texts lie, so that only ids,
    languages and scores go to the join with the labels, which leaves counts."""
    spark = docs.sparkSession
    allowed = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(remainder("doc_id", 3) != 1)
    pick = lambda label, n: allowed.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_OTHER))
    rows = spark.createDataFrame(ids.collect(), ids.schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), whole_text().alias("text"))
    short = texts.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(rows), "doc_id")
    least = short.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("least"))
    got = least.select("doc_id", "toxic", "least.text", "least.lang").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fitted = [r for r in got if xxhash.xxh64_intdigest(str(r["doc_id"])) % 5]
    if len({r["toxic"] for r in fitted}) < 2:
        return Model(np.zeros((BUCKETS, WIDTH), np.float32), [np.zeros((s, WIDTH, FILTERS), np.float32) for s in SPANS], np.zeros(len(SPANS) * FILTERS, np.float32), np.zeros(len(SPANS) * FILTERS, np.float32), trained=False)
    model = fit([r["text"] for r in fitted], [r["toxic"] for r in fitted])
    seen = spark.createDataFrame([(r["doc_id"],) for r in fitted], "doc_id long")
    handle = spark.sparkContext.broadcast(model)
    logit = F.greatest(F.lit(-BINS_END), F.least(F.lit(BINS_END), score_column(handle, logits=True)("text")))
    scored = texts.where(remainder("doc_id", 3) != 1).select("doc_id", "lang", F.floor(logit * BINS).cast("int").alias("bin"))
    others = scored.join(allowed.where(F.col("toxic").isin(0, 1)).join(F.broadcast(seen), "doc_id", "left_anti"), "doc_id")
    if not calibrate_on_all(model, others, Counter((r["lang"], r["toxic"]) for r in fitted)):
        return calibrate(model, [r["text"] for r in got], [r["toxic"] for r in got], [r["lang"] for r in got])
    return model


_scorers: dict[int, Scorer] = {}


def score_column(model_handle, logits: bool = False):
    """A pandas UDF from a text column to scores, or to logits; the model is a broadcast of fixed size."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        key = id(model_handle.value)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(model_handle.value)
        found = _scorers[key].logits(texts.tolist())
        return pd.Series(found.astype(float) if logits else model_handle.value.scores(found))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the decision by the language's own threshold as rejected."""
    spark = docs.sparkSession
    prepare(spark)
    model = train(docs, labels)
    score = score_column(spark.sparkContext.broadcast(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), score(whole_text()).alias("score"), _limit(model, docs, "lang").alias("limit"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= F.col("limit")).alias("rejected"))


def _limit(model: Model, docs: DataFrame, lang: str):
    """The threshold of a row's language, CUT where it has none."""
    limit = F.lit(CUT)
    if "lang" in docs.columns:
        for name, at in sorted(model.thresholds.items()):
            limit = F.when(F.col(lang) == name, F.lit(at)).otherwise(limit)
    return limit


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score stays below the threshold of their language, with all their columns."""
    spark = docs.sparkSession
    prepare(spark)
    model = train(docs, labels)
    score = score_column(spark.sparkContext.broadcast(model))
    return unpacked(packed(docs).withColumn("__score", score(whole_text("__doc.text"))).where(F.col("__score") < _limit(model, docs, "__doc.lang")))
