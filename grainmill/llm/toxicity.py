"""Toxicity: a convolutional text classifier in numpy, fitted by Spark on all labelled rows.

A word is the sum of hashed embeddings of itself and of its beginnings, which start from label statistics; filters of several widths run over the words,
the largest response of each filter is kept (max pooling), and a logistic layer scores them. Every labelled row that may be
learned from takes part, with its whole text: rows are dealt by a hash of their id to parts of about PART_ROWS rows; label
statistics are sums over the parts; in each of ROUNDS rounds every part takes gradient steps over all of its rows from the
same model, and the changes are averaged, an embedding's over the parts that changed it. Sums are of whole numbers, so the
same table gives the same model. A table of one part is fitted as in one machine, with two passes a round. What comes to the
driver is bounded by the model (a few MB, whatever the input). Scoring reads whole texts in one pass without a shuffle.

A monotone map moves the cut that is best on the rows kept out of the fit (a fifth of the different texts, by hash) to a
score of 0.7. A threshold for each language is calibrated there in the same way; a language with too few rows keeps 0.7.
All of those rows are counted, by logit in steps of 1 / STEPS. The languages' thresholds
are used for `flagged` only: scores depend on the text alone.

Defined results: a null, empty or blank text has no word and gets the score of its empty pooling. Labels that are null
are no labels; a doc_id with several labels counts once, with the largest, and with the largest text where its rows
differ. Repeated rows give repeated rows. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm.common import BROADCAST_BYTES, cut

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
PART_ROWS, PART_BYTES = 5000, 64 << 20
ROUNDS, BATCH, CUT = 3, 32, 0.7
#: Of a logit, and the largest that is told from larger ones.
STEPS, MOST = 256, 64
PREFIXES = (5, 7)
PARTS = len(PREFIXES) + 1
COLS = [sum(WIDTHS[:i]) * FILTERS for i in range(len(WIDTHS) + 1)]
#: Of each filter's each shift: the filter, the shift, its column.
FILTER, SHIFT, COLUMN = np.array([(i * FILTERS + k, s, COLS[i] + s * FILTERS + k) for i, w in enumerate(WIDTHS) for k in range(FILTERS) for s in range(w)]).T
EDGE = ".,;:!?|\"'()[]{}*#$%&<>-_/\\"


class WordBuckets(dict):
    """Three 15-bit buckets of a word in one number: of the word and of its beginnings."""

    MOST = 150_000

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGE) or word
        packed = 0
        for k, part in enumerate((core, *(core[:n] for n in PREFIXES))):
            h = xxhash.xxh3_64_intdigest(f"{k}{part}".encode("utf-8", "surrogatepass"))
            packed |= (h % BUCKETS) << (15 * k)
        if len(self) >= self.MOST:
            self.clear()
        self[word] = packed
        return packed

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def unpack(packed: np.ndarray) -> np.ndarray:
    return np.stack([(packed >> (15 * k)) & (BUCKETS - 1) for k in range(PARTS)], axis=1)


def pooled(response: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over n words and where it starts; a filter may run past the last word."""
    best, at = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), -1)
    if not n:
        return best, at
    response = np.ascontiguousarray(response.T)
    for i, width in enumerate(WIDTHS):
        conv = response[COLS[i] : COLS[i] + FILTERS]
        for s in range(1, min(width, n)):
            conv[:, : n - s] += response[COLS[i] + s * FILTERS : COLS[i] + (s + 1) * FILTERS, s:]
        where = conv.argmax(axis=1)
        best[i * FILTERS : (i + 1) * FILTERS] = conv[np.arange(FILTERS), where]
        at[i * FILTERS : (i + 1) * FILTERS] = where
    return best, at


class Model:
    """embed (BUCKETS, DIM); filters (DIM, sum of widths * FILTERS); bias and out by filter; then logit -> score."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (DIM, COLS[-1])).astype(np.float32)
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)
        self.shift, self.scale = 0.0, 1.0

        self.seen = {name: np.full_like(getattr(self, name), 0.1) for name in ("embed", "filters", "bias", "out")}

    def start(self, held: np.ndarray, hits: np.ndarray, rate: float) -> None:
        """One dimension begins as the excess of a bucket's documents among those of label 1, in deviations; one filter reads it.
        held, hits: documents and documents of label 1 by bucket."""
        excess = (hits - held * rate) / np.sqrt(held * rate * (1 - rate) + 1)
        self.embed[:, 0] = np.clip(excess / 4, -0.5, 3)
        self.filters[:, 0] *= 0.1
        self.filters[0, 0] = 1
        self.out[0], self.base = 1.5, np.float32(-3)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, passes: int, seed: int = 0) -> None:
        """Steps over all of `docs`, `passes` times; `seen` keeps the squares of the gradients so far."""
        rng, seen = np.random.default_rng(seed), self.seen
        for _ in range(passes):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                g_filters, g_bias, g_out, g_base = np.zeros_like(self.filters), np.zeros_like(self.bias), np.zeros_like(self.out), 0.0
                rows, grads = [], []
                for d in order[lo : lo + BATCH]:
                    ids = unpack(docs[d])
                    words = self.embed[ids].sum(axis=1)
                    best, at = pooled(words @ self.filters, len(ids))
                    hidden = best + self.bias
                    on = hidden > 0
                    logit = float((hidden * on) @ self.out + self.base)
                    err = (1 / (1 + np.exp(-logit)) - labels[d]) * weights[d]
                    g_base += err
                    g_out += err * hidden * on
                    back = err * self.out * on
                    g_bias += back
                    p = at[FILTER] + SHIFT
                    used = np.flatnonzero((on & (at >= 0))[FILTER] & (p < len(ids)))
                    if len(used):
                        p, columns, pull = p[used], COLUMN[used], back[FILTER[used]]
                        g_filters[:, columns] += pull * words[p].T
                        rows.append(ids[p])
                        grads.append(pull[:, None] * self.filters[:, columns].T)
                self.base -= np.float32(0.02 * g_base / BATCH)
                for name, g in (("filters", g_filters), ("bias", g_bias), ("out", g_out)):
                    g = g / BATCH + (1e-4 * self.out if name == "out" else 0)
                    seen[name] += g * g
                    setattr(self, name, (getattr(self, name) - 0.03 * g / np.sqrt(seen[name])).astype(np.float32))
                if rows:
                    touched, back_to = np.unique(np.concatenate(rows), return_inverse=True)
                    g = np.zeros((len(touched), DIM), np.float32)
                    np.add.at(g, back_to.ravel(), np.repeat(np.concatenate(grads).astype(np.float32) / BATCH, PARTS, axis=0))
                    seen["embed"][touched] += g * g
                    self.embed[touched] -= 0.03 * g / np.sqrt(seen["embed"][touched])

    def rows(self) -> np.ndarray:
        """All that is fitted as rows of 2 * DIM numbers, values and then squares seen: embeddings by bucket, then the rest, filled up with zeros."""
        rest = [np.concatenate([getattr(self, n).ravel() for n in ("filters", "bias", "out")] + [[self.base]]), np.concatenate([self.seen[n].ravel() for n in ("filters", "bias", "out")] + [[0]])]
        rest = [np.resize(np.r_[x, np.zeros(-len(x) % DIM)], (-(-len(x) // DIM), DIM)) for x in rest]
        return np.concatenate([np.concatenate([self.embed, self.seen["embed"]], axis=1), np.concatenate(rest, axis=1)]).astype(np.float64)

    def take(self, rows: np.ndarray) -> None:
        """The opposite of rows()."""
        rows = rows.astype(np.float32)
        self.embed, self.seen["embed"] = rows[:BUCKETS, :DIM].copy(), rows[:BUCKETS, DIM:].copy()
        values, squares, at = rows[BUCKETS:, :DIM].ravel(), rows[BUCKETS:, DIM:].ravel(), 0
        for name in ("filters", "bias", "out"):
            like = getattr(self, name)
            for to, of in ((self.__dict__, values), (self.seen, squares)):
                to[name] = of[at : at + like.size].reshape(like.shape).copy()
            at += like.size
        self.base = values[at]

    def freeze(self) -> None:
        self.table = self.embed @ self.filters

    def logit(self, packed: np.ndarray) -> float:
        """Whole texts, in blocks that overlap by the widest filter."""
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        step, over = 20_000, max(WIDTHS) - 1
        for k, at in enumerate(range(0, len(packed), step)):
            ids = unpack(packed[at : at + step + over])
            response = self.table[ids[:, 0]]
            for part in range(1, PARTS):
                response += self.table[ids[:, part]]
            here = pooled(response, len(ids))[0]
            best = np.maximum(best, here) if k else here
        return float(np.maximum(best + self.bias, 0) @ self.out + self.base)

    def squashed(self, logit: float) -> float:
        z = (logit - self.shift) * self.scale + LOGIT_CUT
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, packed: np.ndarray) -> float:
        return self.squashed(self.logit(packed))

    def light(self) -> Model:
        """What scoring needs of it."""
        own = Model.__new__(Model)
        own.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("embed", "seen")})
        return own


LOGIT_CUT = float(np.log(CUT / (1 - CUT)))


def best_cut(values: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> float:
    """The value at which to cut for the best F1, in the middle of its gap; what is at the cut counts as positive.
    rows, hits: by distinct value, how many have it and how many of them have label 1."""
    order = np.argsort(-values, kind="stable")
    v, hit, taken = values[order], np.cumsum(hits[order]), np.cumsum(rows[order])
    k = int((2 * hit / (taken + hit[-1])).argmax())
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k] - 0.5 / STEPS)


def _tokens(frames):
    """Six bytes a word. What is kept out of the fit goes by the words, so that copies stand on one side."""
    cache = WordBuckets()
    for frame in frames:
        words = [cache.of(t).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for t in frame["txt"]]
        yield pd.DataFrame({"did": frame["did"], "toxic": frame["toxic"], "lang": frame["lang"], "words": words, "out": [xxhash.xxh3_64_intdigest(w) % 5 == 0 for w in words]})


def _packed(words: bytes) -> np.ndarray:
    wide = np.zeros((len(words) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(words, np.uint8).reshape(-1, 6)
    return wide.view(np.int64).ravel()


def _counted(frames):
    """(out, bucket, held, hits) of the task's rows; bucket -1: its rows."""
    held, hits = np.zeros((2, BUCKETS + 1), np.int64), np.zeros((2, BUCKETS + 1), np.int64)
    for frame in frames:
        for words, toxic, out in zip(frame["words"], frame["toxic"], frame["out"]):
            own = np.r_[np.unique(unpack(_packed(words))), BUCKETS]
            held[int(out), own] += 1
            hits[int(out), own] += toxic
    for out in (0, 1):
        at = np.flatnonzero(held[out])
        yield pd.DataFrame({"out": out, "bucket": np.where(at == BUCKETS, -1, at), "held": held[out, at], "hits": hits[out, at]})


#: Changes are summed as whole numbers of this size, so that the sum doesn't depend on the order.
UNIT = 2.0**-32
CHANGES = [f"c{k}" for k in range(2 * DIM)]


def _stepped(model: Model, all_rows: bool, balance: float, passes: int, turn: int):
    """(row, c0, ...): how steps over all rows of this part change the rows of the model."""

    def run(frames):
        ids, labels, docs = [], [], []
        for frame in frames:
            frame = frame if all_rows else frame[~frame["out"].astype(bool)]
            ids += frame["did"].tolist()
            labels += frame["toxic"].tolist()
            docs += [_packed(w) for w in frame["words"]]
        if not docs:
            return
        order = np.argsort(np.array(ids), kind="stable")
        y = np.array(labels)[order]
        before = model.rows()
        model.fit([docs[i] for i in order], y, np.where(y == 1, balance, 1.0), passes, seed=turn)
        change = np.round((model.rows() - before) / UNIT).astype(np.int64)
        at = np.flatnonzero(change.any(axis=1))
        yield pd.DataFrame(change[at], columns=CHANGES).assign(row=at)

    return run


def _binned(model: Model, all_rows: bool):
    """(lang, bin, rows, hits) of the task's rows that are kept out of the fit."""

    def run(frames):
        for frame in frames:
            frame = frame if all_rows else frame[frame["out"].astype(bool)]
            logits = np.array([model.logit(_packed(w)) for w in frame["words"]], np.float64)
            bins = np.floor(np.clip(logits, -MOST, MOST) * STEPS).astype(np.int64)
            yield pd.DataFrame({"lang": frame["lang"].array, "bin": bins, "rows": 1, "hits": frame["toxic"].to_numpy()})

    return run


def _language_cut(frame: pd.DataFrame) -> pd.DataFrame:
    values = (frame["bin"].to_numpy() + 0.5) / STEPS
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "best": [best_cut(values, frame["rows"].to_numpy(), frame["hits"].to_numpy())]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> tuple[Model | None, dict[str, float]]:
    """The model and each language's threshold; None if there aren't labels of both classes. `labels`: doc_id, toxic."""
    known = cut(labels.select(F.col("doc_id").cast("long").alias("did"), F.col("toxic").cast("int").alias("toxic")).filter("did IS NOT NULL AND toxic IN (0, 1)").groupBy("did").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None, {}
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("txt"), lang.alias("lang")).filter("did IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("txt"))).first()[0] or 0
    parts = 1 + max(sum(counts.values()) // PART_ROWS, size // PART_BYTES)
    labelled = texts.join(F.broadcast(known) if sum(counts.values()) * 16 <= BROADCAST_BYTES else known, "did")
    # One text for each id; an id's rows are in one part.
    rows = labelled.repartition(parts, "did").groupBy("did", "toxic").agg(F.max(F.struct("txt", "lang")).alias("row"))
    # Checkpointed by part, as words; each round reads this.
    data = cut(rows.select("did", "toxic", "row.lang", "row.txt").mapInPandas(_tokens, "did long, toxic int, lang string, words binary, out boolean"))
    found = data.mapInPandas(_counted, "out int, bucket int, held long, hits long").groupBy("out", "bucket").agg(F.sum("held").alias("held"), F.sum("hits").alias("hits")).toPandas()
    held, hits = np.zeros((2, BUCKETS + 1)), np.zeros((2, BUCKETS + 1))
    held[found["out"], found["bucket"]], hits[found["out"], found["bucket"]] = found["held"], found["hits"]
    both = (hits[:, -1] > 0) & (hits[:, -1] < held[:, -1])
    all_rows = not both.all()
    held, hits = (held.sum(axis=0), hits.sum(axis=0)) if all_rows else (held[0], hits[0])
    n, n_toxic = held[-1], hits[-1]
    if not 0 < n_toxic < n:
        return None, {}
    model = Model()
    model.start(held[:-1], hits[:-1], n_toxic / n)
    # Of rare toxic rows each weighs more.
    balance = max(2.0, 0.25 * (n - n_toxic) / n_toxic)
    for turn in range(ROUNDS):
        steps = data.mapInPandas(_stepped(model, all_rows, balance, 2 if parts == 1 else 1, turn), ", ".join(f"{c} long" for c in CHANGES) + ", row int")
        done = steps.groupBy("row").agg(F.count("*").alias("by"), *[F.sum(c).alias(c) for c in CHANGES]).toPandas()
        now, at = model.rows(), done["row"].to_numpy()
        now[at] += done[CHANGES].to_numpy(np.float64) * UNIT / done["by"].to_numpy()[:, None]
        model.take(now)
    model.freeze()
    bins = cut(data.mapInPandas(_binned(model.light(), all_rows), "lang string, bin int, rows long, hits long").groupBy("lang", "bin").agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits")))
    # Bounded by the number of bins.
    check = bins.groupBy("bin").agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits")).toPandas()
    values, rows = (check["bin"].to_numpy() + 0.5) / STEPS, check["rows"].to_numpy()
    model.shift = best_cut(values, rows, check["hits"].to_numpy())
    model.scale = 2.0 / max(float(np.sqrt(np.average((values - np.average(values, weights=rows)) ** 2, weights=rows))), 0.5)
    enough = bins.groupBy("lang").agg(F.sum("rows").alias("n"), F.sum("hits").alias("h")).filter("lang <> '' AND h >= 30 AND n - h >= 30").select("lang")
    own = bins.join(enough, "lang").groupBy("lang").applyInPandas(_language_cut, "lang string, best double").collect()
    # Half way to the language's own best cut, as it is found on fewer rows.
    thresholds = {r["lang"]: round((model.squashed(r["best"]) + CUT) / 2, 6) for r in sorted(own, key=lambda r: r["lang"])}
    return model, thresholds


def _scored(model: Model | None, text_at: int):
    """Rows pass as Arrow; only a few texts at a time become Python strings."""

    def run(batches):
        cache = WordBuckets()
        for batch in batches:
            rows = batch.column(0)
            texts, scores = rows.field(text_at), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows if model else 0, 128):
                part = texts.slice(at, 128).to_pylist()
                scores[at : at + len(part)] = [model.score(cache.of(t)) for t in part]
            yield pa.RecordBatch.from_arrays([rows, pa.array(scores)], names=["row", "score"])
        pa.default_memory_pool().release_unused()

    return run


def score_toxicity(docs: DataFrame, model: Model | None, thresholds: dict[str, float], text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """All columns of `docs`, then __score (double), __threshold (double) and __flagged (boolean)."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType())])
    done = inner.mapInArrow(_scored(model.light() if model else None, docs.columns.index(text_col)), schema)
    limit = F.lit(CUT)
    if lang_col and thresholds:
        table = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
        limit = F.coalesce(table[F.col("row").getField(lang_col).cast("string")], limit)
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("score").alias("__score"), limit.alias("__threshold"), (F.col("score") >= limit).alias("__flagged"))


def op3_cnn_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learned = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model, thresholds = train(docs.filter(learned), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(learned))
    return score_toxicity(docs, model, thresholds).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= CUT).cast("int").alias("predicted"),
        F.col("__threshold").alias("lang_threshold"),
        F.col("__flagged").cast("int").alias("flagged"),
    )
