"""Quality classifier by Bradley-Terry pairwise ranking.

Each preference pair is a document of label 1 and one of label 0; a weight vector is learnt by
logistic loss on the difference of their features: rates that describe a text's make-up, and the shares of hashed
byte trigrams, bytes and whole words in it. A document's worth is its weighted feature sum;
the threshold is the quantile of the training worths that leaves out the share of label 0. The
score is the logistic of the worth, shifted so that the threshold falls on ``accept``.

The hashed shares enter linearly, so in scoring each distinct word has one value, its grams' weights together.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import BATCH_BYTES, Scratch, bucket_of_id, hinted, whole_text
from orbitspark.llm.near_dedup import mixed
from orbitspark.llm.vocab import ChunkTable, cut_words, lean, per_text, release, slices, spread
from orbitspark.operators.quantiles import quantile_row

U = np.uint64
NAMES = ("letters", "upper", "digits", "symbols", "punctuation", "repeats", "distinct", "top_word", "word_length", "words", "sentence_ends", "lines", "wordless")
KIND = np.full(256, 3, np.int64)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 punctuation, 5 white space, 6 beyond ASCII, 7 line end
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:'\"()-!?", 4), (b" \t\r\v\f", 5), (bytes(range(128, 256)), 6), (b"\n", 7)):
    KIND[list(_chars)] = _kind
#: Hashed features as a power of two, and the grams that count as much as all that is known of texts at large.
WIDTH_BITS, PRIOR = 9, 100.0
WIDTH = 1 << WIDTH_BITS
#: Documents of the commoner class that meet in a bucket, and about the least number of the rarer one there.
BUCKET, LEAST = 128, 16


def features(text: str) -> list[float]:
    """Rates in a whole text; all zero but ``wordless`` for a text without words."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(KIND, bytes_of, minlength=8)
    size = max(1.0, len(raw) - kind[5] - kind[7])
    n = len(words)
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    expected = n ** 0.85
    letters = kind[0] + kind[1] + kind[6]
    return [
        letters / size, kind[1] / max(1.0, kind[0] + kind[1]), kind[2] / size, kind[3] / size, kind[4] / size, repeats / n, min(1.0, len(counts) / expected), max(counts.values()) / n if n > 9 else 0.0,
        min(size / n, 30.0) / 10, np.log1p(n) / 10, bytes_of[[33, 46, 63]].sum() / n, kind[7] / n, 0.0,
    ]


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words in order, and how many each has: a trigram and a byte for each of its bytes, and itself."""
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(U)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 2) - sizes - 2
    first = spread(starts, sizes)
    place = first - np.repeat(starts, sizes)
    single = raw[first + 1]
    triple = raw[first] | single << U(8) | raw[first + 2] << U(16)
    whole = np.add.reduceat(mixed(single | place.astype(U) << U(8)), np.cumsum(sizes) - sizes) if len(words) else single
    lens = 2 * sizes + 1
    out = np.empty(int(lens.sum()), np.int64)
    begin = np.cumsum(lens) - lens
    within = np.repeat(begin, sizes) + place
    for at, h, kind in ((within, triple, 1), (within + np.repeat(sizes, sizes), single, 2), (begin + 2 * sizes, whole, 3)):
        out[at] = mixed(h ^ U(kind << 56)) >> U(64 - WIDTH_BITS)
    return out, lens


def shares(texts: pa.Array) -> np.ndarray:
    """Counts of the hashed features of each text, and their sum in the last column."""
    cut = cut_words(texts)
    flat, lens = grams(cut.chunks)
    n = max(1, len(cut.chunks))
    pair, times = np.unique(np.repeat(np.arange(len(texts)), cut.counts) * n + cut.codes, return_counts=True)
    word = pair % n
    at = spread((np.cumsum(lens) - lens)[word], lens[word])
    out = np.bincount(np.repeat(pair // n, lens[word]) * WIDTH + flat[at], np.repeat(times, lens[word]), minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH)
    return np.column_stack([out, out.sum(axis=1)])


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def fit(x: np.ndarray, y: np.ndarray, pairs: int, seed: int = 5, penalty: float | np.ndarray = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the standardised features by Newton steps on the logistic loss of pair differences.

    Each step is solved by conjugate gradients, which need products with the features only: no matrix of pairs or of weights is made.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = standard(x, mean, scale)
    narrow = z.dtype  # vectors are cast to it, so that no product copies the features
    rng = np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)

    def back(of_pair: np.ndarray) -> np.ndarray:
        """The pairs' values times their differences of features, on average."""
        return ((np.bincount(good, of_pair, len(z)) - np.bincount(bad, of_pair, len(z))) / pairs).astype(narrow) @ z

    w = np.zeros(x.shape[1])
    for _ in range(30):
        s = z @ w.astype(narrow)
        p = 1 / (1 + np.exp(np.clip(s[good] - s[bad], -30, 30)))
        gradient, bend = penalty * w - back(p), p * (1 - p)
        step, r = np.zeros_like(w), gradient.copy()
        d, left = r.copy(), r @ r
        enough = 1e-6 * left
        for _ in range(50):
            if left <= enough:
                break
            u = z @ d.astype(narrow)
            h = back(bend * (u[good] - u[bad])) + penalty * d
            size = left / (d @ h)
            step += size * d
            r -= size * h
            left, before = r @ r, left
            d = r + left / before * d
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w, mean, scale


def met_in_buckets(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, buckets: int, rarer: int, copies: int) -> DataFrame:
    """The feature vectors of all labelled documents as a table, a row a bucket: n, kinds (of each document its label, plus 2 for a further copy) and x.

    The hash of id and text says where a document is; of class ``rarer`` it is at ``copies`` places, so that documents of the other class meet some in every bucket.
    """
    met = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(hinted(known.select(F.col(id_col).alias("of"), "quality")), F.col("id") == F.col("of"))

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), 1_000_000):
                texts = batch.column(0)[a:b]
                rows = np.column_stack([np.array([features(t.as_py()) for t in texts]), shares(texts)]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), *(c[a:b] for c in batch.columns[1:])], names=["x", "quality", "name"])

    rows = met.select("text", "quality", F.sha2(F.concat_ws(":", F.col("id").cast("string"), "text"), 256).alias("name")).mapInArrow(run, "x binary, quality int, name string")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == rarer, copies - 1).otherwise(0))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("name", "copy"), F.lit(buckets)).cast("int"))

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by([("name", "ascending"), ("copy", "ascending")])
        names = group["name"].to_pylist()
        once = [i for i, n in enumerate(names) if not i or n != names[i - 1]]
        group = group.take(once)
        kinds = group["quality"].to_numpy() + 2 * (group["copy"].to_numpy() > 0)
        return pa.table({"n": pa.array([len(once)], pa.int32()), "kinds": pa.array([kinds.astype("i1").tobytes()], pa.binary()), "x": pa.array([b"".join(group["x"].to_pylist())], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(gather, "n int, kinds binary, x binary")


def each_bucket(batches, usual: np.ndarray | None = None, mean: np.ndarray | None = None, scale: np.ndarray | None = None):
    """Kinds and features of the documents of each bucket; hashed counts as shares less ``usual``, and all standardised, as far as these are given."""
    for batch in batches:
        for kinds, raw in zip(batch.column("kinds"), batch.column("x")):
            kinds = np.frombuffer(kinds.as_py(), "i1")
            x = np.frombuffer(raw.as_py(), "<f4").reshape(len(kinds), -1)
            x, size = x[:, :-1].copy(), x[:, -1:]
            if usual is not None:
                x[:, len(NAMES) :] = (x[:, len(NAMES) :] - size * usual) / (size + np.float32(PRIOR))
            else:
                x[:, len(NAMES) :] /= np.maximum(size, 1)
            yield kinds, x if mean is None else standard(x, mean, scale).astype("f4")


def total(table: DataFrame, of_bucket, length: int, parts: int = 16) -> np.ndarray:
    """The sum of the vector ``of_bucket(kinds, x)`` over all buckets: added up by task, and then by part of the vector."""

    def run(batches):
        out = np.zeros(length)
        for vector in of_bucket(batches):
            out += vector
        for i, part in enumerate(np.array_split(out, parts)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "v"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"part": group["part"][:1], "v": pa.array([np.sum([np.frombuffer(v, float) for v in sorted(group["v"].to_pylist())], axis=0).tobytes()], pa.binary())})

    with small_batches(table.sparkSession):
        rows = table.mapInArrow(run, "part int, v binary").groupBy("part").applyInArrow(add, "part int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"], float) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(length)


@contextmanager
def small_batches(spark):
    """Arrow batches of 16 MB or one row, as a row holds a bucket."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, 16 << 20)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def pair_sums(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs of a bucket, and the sums over them of the loss's gradient and curvature: each document of label 1 against each of label 0."""
    k = z.shape[1]
    if good.all() or not good.any():
        return np.zeros(1 + k + k * k)
    z = np.vstack([z[good], z[~good]])
    g, s = good.sum(), z @ w.astype(z.dtype)
    p = 1 / (1 + np.exp(np.clip(s[:g, None] - s[g:], -30, 30)))
    bend = p * (1 - p)
    m = np.diag(np.concatenate([bend.sum(1), bend.sum(0)]))
    m[:g, g:], m[g:, :g] = -bend, -bend.T
    return np.concatenate([[p.size], np.concatenate([-p.sum(1), p.sum(0)]) @ z, (z.T @ (m.astype(z.dtype) @ z)).ravel()])


def cut_of(worths_of: DataFrame, share: float, n: int, slack: float) -> float:
    """The cut at the quantile ``share`` of the worths of all documents; within ``slack`` of it, where they lie farthest apart."""
    low, high = (min(max(int(np.ceil(n * f)) - 1, 0), n - 1) for f in (share - slack, share + slack))
    ends = [max(1, low) - 1, max(2, min(high + 1, n)) - 1]
    a, b = quantile_row(worths_of, ["worth"], [e / (n - 1) for e in ends]).first()["worth"]
    # Only the documents within the slack, one in fifty, are ordered in one task.
    near = worths_of.where(F.col("worth").between(a, b)).select("worth", F.lag("worth").over(Window.orderBy("worth")).alias("before")).where("before is not null")
    row = near.orderBy(F.col("worth") - F.col("before"), F.col("worth"), ascending=[False, True]).first()
    return a if row is None else (row["worth"] + row["before"]) / 2


def train(docs: DataFrame, labels: DataFrame, accept: float = 0.3, slack: float = 0.01, penalty: float = 1e-3, gram_penalty: float = 100.0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Learn the ranking from all labelled documents: each meets all of the other class in its bucket of the hash, as one preference pair each.

    Means, deviations, the Newton steps on the pairs' logistic loss and the cut are sums and quantiles over the whole table of feature
    vectors; the driver holds the weights and their curvature. Null labels and
    labels without a document are passed over, as are documents whose labels contradict each other. A label given
    twice, or a row of ``docs`` that occurs twice, counts once; different texts of one id count each. Without both
    classes every score is one half. Weights of the rates cost ``penalty``, those of the hashed features
    ``gram_penalty`` over the number of documents: with few of these they hardly count. ``slack`` is the share of documents by which the cut may move to where worths lie farthest apart.
    """
    of = labels.where("quality in (0, 1)").groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = of.where("quality = _most").select(id_col, F.col("quality").cast("int").alias("quality")).where(F.col(id_col).isNotNull() & (bucket_of_id(id_col) != 0))
    scratch, k = Scratch(docs.sparkSession), len(NAMES)
    known = scratch.stash(known, "labelled")
    counts = known.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).first()
    flat = {"key": uuid.uuid4().hex, "w": np.zeros(k), "mean": np.zeros(k), "scale": np.ones(k), "shift": 0.0, "gram": np.zeros(WIDTH), "least": 0.0}
    rarer, buckets = int(counts[1] < counts[0]), -(-max(counts) // BUCKET)
    while True:
        copies = max(1, -(-LEAST * buckets // max(1, min(counts))))
        table = scratch.stash(met_in_buckets(docs, known, id_col, text_col, max(1, buckets), rarer, copies), "met", 16 << 20) if min(counts) else None
        seen = total(table, lambda batches: (np.array([(y == 0).sum(), (y == 1).sum(), (y % 2 == y[0] % 2).all()], float) for y, _ in each_bucket(batches)), 3) if table else np.zeros(3)
        if not min(seen[:2]):
            scratch.drop([])
            return flat
        if not seen[2] or buckets == 1:
            break
        scratch.discard(table)  # some bucket has one class only, and its documents would be in no pair
        buckets = max(1, buckets // 2)
    n = int(seen[0] + seen[1])
    share = seen[0] / n
    usual = total(table, lambda batches: (x[y < 2, k:].sum(0, dtype=float) for y, x in each_bucket(batches)), WIDTH).astype("f4") / np.float32(n)
    size = k + WIDTH
    mean = total(table, lambda batches: (x[y < 2].sum(0, dtype=float) for y, x in each_bucket(batches, usual)), size) / n
    scale = np.sqrt(total(table, lambda batches: (((x[y < 2] - mean) ** 2).sum(0) for y, x in each_bucket(batches, usual)), size) / n)
    scale[scale < 1e-9] = 1.0
    cost, w = np.repeat([penalty, gram_penalty / n], [k, WIDTH]), np.zeros(size)
    for _ in range(30):
        sums = total(table, lambda batches: (pair_sums(x, y % 2 == 1, w) for y, x in each_bucket(batches, usual, mean, scale)), 1 + size + size * size)
        step = np.linalg.solve(sums[1 + size :].reshape(size, size) / sums[0] + np.diag(cost), sums[1 : 1 + size] / sums[0] + cost * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break

    def worth(batches):
        for y, x in each_bucket(batches, usual, mean, scale):
            yield pa.RecordBatch.from_arrays([pa.array((x[y < 2] @ w).astype(float))], names=["worth"])

    worths_of = scratch.stash(table.mapInArrow(worth, "worth double"), "worths", 16 << 20)
    threshold = cut_of(worths_of, share, n, slack)
    scratch.drop([])
    # In scoring the hashed part is linear: a weight for each feature and a constant, both by the size of the text.
    gram = w[k:] / scale[k:]
    return {
        "key": uuid.uuid4().hex, "w": w[:k], "mean": mean[:k], "scale": scale[:k], "gram": gram, "usual": float(gram @ usual), "least": float(gram @ mean[k:]),
        "shift": float(np.log(accept / (1 - accept)) - threshold),
    }


_VALUES: dict = {}


def word_values(model: dict) -> ChunkTable:
    """Of each distinct word of this Python worker: the weights of its hashed features together, and how many it has."""
    if model["key"] not in _VALUES:
        _VALUES.clear()

        def fill(words):
            flat, lens = grams(words)
            return np.column_stack([np.add.reduceat(model["gram"][flat], np.cumsum(lens) - lens), lens]).ravel(), np.full(len(words), 2)

        _VALUES[model["key"]] = ChunkTable(fill, np.float64, 400_000)
    return _VALUES[model["key"]]


def worths(model: dict, texts: pa.Array) -> np.ndarray:
    lean()
    texts = texts.fill_null("")
    x = np.array([features(t.as_py()) for t in texts]).reshape(len(texts), len(NAMES))
    worth = standard(x, model["mean"], model["scale"]) @ model["w"] + model["shift"]
    if not model["gram"].any():
        release()
    else:
        table = word_values(model)
        for a, b in slices(texts, 4_000_000):
            cut = cut_words(texts[a:b])
            slots = table.slots_of(cut.chunks)
            at = table.starts[slots]
            sums = per_text(np.column_stack([table.flat[at], table.flat[at + 1]])[cut.codes], cut.counts)
            worth[a:b] += (sums[:, 0] - sums[:, 1] * model["usual"]) / (sums[:, 1] + PRIOR) - model["least"]
    return 1 / (1 + np.exp(-np.clip(worth, -30, 30)))


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score of every whole text; null text counts as empty, and an empty text gets a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worths(shared.value, batch.column(1)), pa.float64())], names=["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def keep_accepted(docs: DataFrame, model: dict, accept: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``accept``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(worths(shared.value, batch.column(at)) >= accept))

    return docs.mapInArrow(run, docs.schema)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (bucket_of_id("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
