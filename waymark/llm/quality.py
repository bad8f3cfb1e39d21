"""Quality classifier by co-training two views.

Text view: shares of character kinds, repetition and lengths of the whole text.
Metadata view: source and language (hashed) and the given character count. Each
view has a logistic regression. Over ``ROUNDS`` rounds each classifier labels the
unlabelled documents it is surest of, in the proportion of the classes, and they
join the other's training rows. Both are then calibrated (Platt) on labelled
documents held out of that, and a last regression on the two calibrated logits
weighs the views.

Fitted on bounded samples: one row each of at most ``LABELLED`` labelled and ``POOL`` other
ids, chosen by a hash of the id, whatever the size of the corpus and however often an id
is there (of its rows that of the least hash stands for it). All documents are scored, in one
map. Nothing else is gathered.

Null texts and metadata count as empty, unseen sources as their hash bucket.
Labels with a null id or a quality that isn't 0 or 1 are left out; of several for an
id the mean decides, ties for 0. Without labelled documents of both classes nothing can be judged: the
scores are null and every document is kept. Repeated rows and ids stay; an
empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import free_name

LABELLED, POOL, ROUNDS = 20_000, 10_000, 5
#: Share of the pool that a view hands over in a round.
HANDED = 0.03
SOURCES, LANGS = 32, 8
VIEW = ("text", "lang", "source", "n_chars")


def text_features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), 10))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.split()
        n, letters = max(1, len(raw)), max(1, h[65:91].sum() + h[97:123].sum() + h[128:].sum())
        signs = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
        out[i] = [
            h[65:91].sum() / letters, (signs - h[44] - h[46]) / n, (h[44] + h[46]) / n, h[48:58].sum() / n, h[124] / n, 100 * h[10] / n,
            len(set(words)) / max(1, len(words)), np.log1p(len(raw)), min(40.0, len(raw) / max(1, len(words))), h[0:9].sum() / n,
        ]
    return out


def meta_features(langs: list, sources: list, counts: list) -> np.ndarray:
    out = np.zeros((len(langs), SOURCES + LANGS + 2))
    for i, (lang, source, count) in enumerate(zip(langs, sources, counts, strict=True)):
        out[i, xxhash.xxh64_intdigest(str(source), 1) % SOURCES] = 1
        out[i, SOURCES + xxhash.xxh64_intdigest(str(lang), 2) % LANGS] = 1
        out[i, -2:] = (np.log1p(max(0, count)), 0) if count is not None else (0, 1)
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z, w = self._with_one(x), np.zeros(x.shape[1] + 1)
        keep = ridge * np.eye(len(w))
        for _ in range(40):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + keep, z.T @ (p - y) / len(y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -30, 30), np.ones(len(x))]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._with_one(x) @ self.w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class CoTrained:
    """Both views, calibrated and combined. ``views``: their matrices; ``y``: 0 or 1; ``pools``: the same of unlabelled rows; ``held``: rows for calibration."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], held: np.ndarray):
        x, own = [[v[~held]] for v in views], [[y[~held]], [y[~held]]]
        share = y[~held].mean()
        free = np.ones(len(pools[0]), bool)
        for _ in range(ROUNDS):
            models = [Logistic(np.vstack(x[k]), np.concatenate(own[k])) for k in (0, 1)]
            for k, other in ((0, 1), (1, 0)):
                at = np.flatnonzero(free)
                order = at[np.argsort(models[k].logit(pools[k][at]), kind="stable")]
                n = int(HANDED * len(pools[k]))
                good, bad = round(n * share), n - round(n * share)
                sure = [(order[len(order) - good :], 1.0, models[k].logit(pools[k]) > 0), (order[:bad], 0.0, models[k].logit(pools[k]) < 0)]
                for rows, label, agrees in sure if len(order) >= n else []:
                    rows = rows[agrees[rows]]
                    x[other].append(pools[other][rows])
                    own[other].append(np.full(len(rows), label))
                    free[rows] = False
        self.models = [Logistic(np.vstack(x[k]), np.concatenate(own[k])) for k in (0, 1)]
        self.platt = [Logistic(m.logit(v[held])[:, None], y[held]) for m, v in zip(self.models, views, strict=True)]
        self.both = Logistic(self._logits([v[held] for v in views]), y[held])

    def _logits(self, views: list[np.ndarray]) -> np.ndarray:
        return np.stack([p.logit(m.logit(v)[:, None]) for p, m, v in zip(self.platt, self.models, views, strict=True)], axis=1)

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        logits = self._logits(views)
        return _sigmoid(np.c_[logits, self.both.logit(logits)])


def _views(columns: list[pa.Array]) -> list[np.ndarray]:
    text, lang, source, count = (c.to_pylist() for c in columns)
    return [text_features(text), meta_features(lang, source, count)]


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """``docs``: doc_id and the columns of VIEW; ``labels``: doc_id and quality."""
    judged = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("y"))
    chosen = lambda frame, n: frame.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n)
    some = chosen(judged, LABELLED).withColumn("pool", F.lit(False))
    rest = chosen(docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(judged, "doc_id", "left_anti"), POOL).select("doc_id", F.lit(0).alias("y"), F.lit(True).alias("pool"))
    width = 10 + SOURCES + LANGS + 2

    def seen(batches):
        for batch in batches:
            both = np.hstack(_views(batch.columns[3:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(both.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "pool", "x"])

    # Both sides of this union are limited, so the broadcast has at most LABELLED + POOL rows.
    # The window's limit works before the shuffle: an id that is there ten million times leaves a row from each task.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*VIEW), "text"))
    picked = docs.join(F.broadcast(some.union(rest)), "doc_id").withColumn("first", first).where("first = 1").select("doc_id", "y", "pool", *VIEW)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = picked.mapInArrow(seen, f"doc_id {kind}, y int, pool boolean, x array<double>").toPandas().sort_values(["doc_id"], kind="stable")
    x, pool, y = np.array(rows["x"].to_list(), float).reshape(-1, width), rows["pool"].to_numpy(bool), rows["y"].to_numpy(float)
    held = np.array([xxhash.xxh64_intdigest(str(i), 3) % 4 == 0 for i in rows["doc_id"]], bool)
    split = [x[:, :10], x[:, 10:]]
    if any(len(set(y[~pool & part])) < 2 for part in (held, ~held)):
        return None
    return CoTrained([v[~pool] for v in split], y[~pool], [v[pool] for v in split], held[~pool])


def with_quality(docs: DataFrame, labels: DataFrame, out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out`` (a column of that name is replaced): text_score, meta_score and score (of good quality), null where nothing can be judged."""
    blank = [F.lit(None).cast("string").alias(c) if c != "n_chars" else F.lit(None).cast("long").alias(c) for c in VIEW if c not in docs.columns]
    model = train(docs.select("doc_id", *(F.col(c) for c in VIEW if c in docs.columns), *blank).select("doc_id", *VIEW), labels)
    kind = "struct<text_score: double, meta_score: double, score: double>"
    if model is None:
        return docs.withColumn(out, F.lit(None).cast(kind))

    @F.arrow_udf(kind)
    def judge(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        found = model.scores(_views([text, lang, source, n_chars]))
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["text_score", "meta_score", "score"])

    given = [F.col(c) if c in docs.columns else F.lit(None).cast("long" if c == "n_chars" else "string") for c in VIEW]
    # Not deterministic as far as the optimizer goes, so that a filter on the score doesn't work it out again.
    return docs.withColumn(out, judge.asNondeterministic()(*given))


def keep_good(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The documents whose score is ``least`` or more, and those that can't be judged."""
    names = docs.columns
    own = free_name("__quality", names)
    scored = with_quality(docs, labels, own)
    return scored.where((F.col(f"{own}.score") >= least) | F.col(f"{own}.score").isNull()).select(*(f"`{c}`" for c in names))
