"""Language identification by a small convolutional network over UTF-8 bytes.

Windows of fixed length cut a text from end to end. Bytes are embedded, filters of several
widths run over them, each filter keeps its highest response in the window, and a softmax
over those gives the languages. The windows' answers are averaged by their bytes. The
network is trained in numpy on windows of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.llm.tables import column, map_texts, text_of

LENGTH = 256  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBEDDING = 6
# The sample: documents of each language, windows of each document, languages.
PER_LANGUAGE = 600
WINDOWS = 4
MAX_LANGUAGES = 200  # more are an error
EPOCHS = 4
BATCH = 64
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # (widest * EMBEDDING) x filters; rows beyond a filter's width are 0
    bias: np.ndarray
    weights: np.ndarray  # filters x languages
    offset: np.ndarray

    @property
    def widest(self) -> int:
        return self.filters.shape[0] // self.embedding.shape[1]

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes under the widest filter at every place: windows x places x values."""
        padded = np.zeros((len(windows), windows.shape[1] + self.widest - 1), np.uint8)
        padded[:, : windows.shape[1]] = windows
        flat = self.embedding[padded].reshape(len(windows), -1)
        size = self.embedding.shape[1]
        return sliding_window_view(flat, self.widest * size, axis=1)[:, ::size]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Languages of each window (rows of bytes, padded with 0)."""
        response = np.matmul(self.patches(windows), self.filters).max(axis=1)
        return _softmax(np.maximum(response + self.bias, 0) @ self.weights + self.offset)


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def cut(data: bytes, length: int = LENGTH) -> np.ndarray:
    """All windows of a text, end to end; the last is padded with 0."""
    count = max(1, -(-len(data) // length))
    windows = np.zeros(count * length, np.uint8)
    windows[: len(data)] = np.frombuffer(data, np.uint8)
    return windows.reshape(count, length)


def train(
    windows: np.ndarray,
    targets: np.ndarray,
    languages: Sequence[str],
    *,
    epochs: int = EPOCHS,
    rate: float = 0.01,
    seed: int = 7,
) -> Network:
    """Fit a network to windows with language numbers, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    widest, count = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest * EMBEDDING, count), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = Network(
        list(languages),
        draw(256, EMBEDDING) * 0.5,
        draw(widest * EMBEDDING, count) * 0.3 * mask,
        np.zeros(count, np.float32),
        draw(count, len(languages)) * 0.1,
        np.zeros(len(languages), np.float32),
    )
    names = ("embedding", "filters", "bias", "weights", "offset")
    moments = {name: [np.zeros_like(getattr(net, name)) for _ in range(2)] for name in names}
    share = np.bincount(targets, minlength=len(languages)) / max(1, len(targets))
    balance = 1 / np.maximum(share * len(languages), 1e-6)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            batch, truth = windows[chosen], targets[chosen]
            grads = _gradients(net, batch, truth, balance[truth].astype(np.float32))
            grads["filters"] *= mask
            step += 1
            for name in names:
                mean, square = moments[name]
                mean += 0.1 * (grads[name] - mean)
                square += 0.001 * (grads[name] ** 2 - square)
                change = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - rate * change).astype(np.float32))
    return net


def _gradients(net: Network, batch: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> dict:
    patches = net.patches(batch)
    response = np.matmul(patches, net.filters)
    best = response.argmax(axis=1)  # windows x filters: the place each filter answers at
    rows = np.arange(len(batch))[:, None]
    raw = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(raw, 0)
    back = _softmax(hidden @ net.weights + net.offset)
    back[np.arange(len(batch)), truth] -= 1
    back *= weight[:, None] / len(batch)
    into = (back @ net.weights.T) * (raw > 0)
    picked = patches[rows, best]  # windows x filters x values
    grad_embedding = np.zeros_like(net.embedding)
    size = net.embedding.shape[1]
    spread = into[:, :, None] * net.filters.T[None]
    padded = np.zeros((len(batch), batch.shape[1] + net.widest), np.uint8)
    padded[:, : batch.shape[1]] = batch
    for k in range(net.widest):
        letters = padded[rows, best + k].ravel()
        part = spread[:, :, k * size : (k + 1) * size].reshape(-1, size)
        for j in range(size):
            grad_embedding[:, j] += np.bincount(letters, weights=part[:, j], minlength=256)
    return {
        "embedding": grad_embedding,
        "filters": np.einsum("bf,bfv->vf", into, picked, optimize=True),
        "bias": into.sum(axis=0),
        "weights": hidden.T @ back,
        "offset": back.sum(axis=0),
    }


def sample_windows(
    docs: DataFrame, *, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES
) -> tuple:
    """Training windows from a bounded sample of labelled documents (text, lang).

    Takes about ``per_language`` documents of each language, never more than twice that
    times the number of languages in all, and ``WINDOWS`` windows from places all over each
    text. Both are picked by hashes, so every run picks the same. Returns windows, language
    numbers and languages; the windows are the only text that reaches the driver. More than
    ``max_languages`` are an error, since none may be left out of training in silence.
    """
    labelled = docs.select(
        text_of(docs).alias("text"), column("lang").cast("string").alias("lang"),
        F.xxhash64(column("doc_id"), F.lit("sample")).alias("order"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = dict(
        labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    )
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages; merge labels or raise max_languages")
    if not counts:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, int), []
    languages = sorted(counts)
    scale = 1 << 20
    share = F.lit(0)
    for name, count in counts.items():
        wanted = min(scale, -(-scale * per_language // count))
        share = F.when(F.col("lang") == name, F.lit(wanted)).otherwise(share)
    places = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS - 1)),
        lambda k: F.substring(
            F.col("text"),
            F.lit(1)
            + F.pmod(
                F.xxhash64("order", k), F.greatest(F.lit(1), F.length("text") - LENGTH + 1)
            ).cast("int"),
            F.lit(LENGTH),
        ),
    )
    chosen = (
        labelled.where(F.pmod("order", F.lit(scale)) < share)
        .select("order", "lang", F.array_distinct(places).alias("parts"))
        .orderBy("order", "lang", "parts")
        .limit(2 * per_language * len(languages))
        .collect()
    )
    number = {name: k for k, name in enumerate(languages)}
    pairs = [(part, number[row["lang"]]) for row in chosen for part in row["parts"]]
    windows = np.concatenate([cut(part.encode()[:LENGTH]) for part, _ in pairs])
    return windows, np.array([n for _, n in pairs]), languages


def learn(
    docs: DataFrame, *, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES
) -> Network | None:
    """A network for the languages of ``docs`` (doc_id, text, lang); None without labels.

    More than ``max_languages`` are an error.
    """
    windows, targets, languages = sample_windows(
        docs, per_language=per_language, max_languages=max_languages
    )
    return train(windows, targets, languages) if languages else None


def predict(net: Network, texts: list[str], at_once: int = 128) -> list[tuple[str, float]]:
    """Language and its mean probability over all windows of each whole text."""
    data = [text.encode() for text in texts]
    found: list[tuple[str, float]] = []
    start = 0
    while start < len(data):
        end, total = start, 0
        while end < len(data) and (end == start or total + len(data[end]) <= at_once * LENGTH * 8):
            total += len(data[end])
            end += 1
        parts = [cut(one) for one in data[start:end]]
        windows = np.concatenate(parts)
        chances = np.concatenate(
            [net.probabilities(windows[k : k + at_once]) for k in range(0, len(windows), at_once)]
        )
        first = np.cumsum([0] + [len(part) for part in parts])[:-1]
        size = np.full(len(windows), LENGTH)
        for at, part, one in zip(first, parts, data[start:end]):
            size[at + len(part) - 1] = max(1, len(one) - (len(part) - 1) * LENGTH)
        mean = np.add.reduceat(chances * size[:, None], first) / np.add.reduceat(size, first)[:, None]
        best = mean.argmax(axis=1)
        found += [
            (net.languages[k], min(1.0, max(0.0, float(row[k])))) for k, row in zip(best, mean)
        ]
        start = end
    return found


def _predictor(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            texts = batch["text"].to_pylist()
            known = [k for k, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
            if known:
                for k, (name, score) in zip(known, predict(net, [texts[k] for k in known])):
                    names[k], scores[k] = name, score
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(names), pa.array(scores, pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame, net: Network | None, *, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``row`` (the columns in ``keep``), ``lang_pred`` and ``score`` of every whole text.

    The prediction sees nothing but the text. ``und`` with score 0 stands for a null text,
    one without letters, and every text if there is no network. Repeated rows each get the
    same answer; an empty table gives no rows. The network is a few kilobytes.
    """
    return map_texts(docs, keep, _predictor(net), "lang_pred string, score double")


def is_held_out(doc_id: Column) -> Column:
    """Every third document by the checksum of its id; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
