"""A quality classifier without hand labels.

Overlapping heuristics vote good, bad or nothing on each document. Expectation-maximisation estimates how
each heuristic votes on good and on bad documents (Dawid and Skene, 1979), from nothing but how often each
pattern of votes occurs; there are at most 3 ** n patterns, so the corpus enters as a small table
of counts over all documents. The posterior of a pattern is the soft label on which a
linear scorer over hashed words and word shapes is trained, which then scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import with_fields

BUCKETS = 1 << 16
#: The scorer is trained on at most this many documents, those whose ids hash lowest; their vectors reach the driver.
TRAINING = 4000
PASSES = 300
_SYMBOLS = b"#*$%&|<>"
_LOWER, _UPPER, _BEYOND, _SPACES = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(128, 256)), b" \t\n\v\f\r"
_ODD_TAILS = {bytes([x]) for x in _SYMBOLS + b"!"}


def _share(part: float, whole: float, bad: float, good: float) -> int:
    """-1 from ``bad`` on, 1 up to ``good``, else no vote."""
    x = part / whole
    return -1 if x >= bad else 1 if x <= good else 0


def _letters(words, lines, raw):
    """Characters of words that are neither ASCII letters nor beyond ASCII."""
    whole = len(raw.translate(None, _SPACES))
    other = len(raw.translate(None, _LOWER + _UPPER + _SPACES + _BEYOND))
    return _share(other, whole, 0.12, 0.06) if whole >= 60 else 0


def _tails(words, lines, raw):
    return _share(sum(x[-1:] in _ODD_TAILS for x in words), len(words), 0.25, 0.05)


def _symbols(words, lines, raw):
    return _share(len(raw) - len(raw.translate(None, _SYMBOLS)), len(words), 0.2, 0.03)


def _capitals(words, lines, raw):
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    return _share(upper, upper + lower, 0.4, 0.15) if upper + lower >= 20 else 0


def _shouting(words, lines, raw):
    return _share(raw.count(b"!"), len(words), 0.2, 0.03)


def _few_words(words, lines, raw):
    """Distinct words grow slower than the text; held against its square root."""
    return 0 if len(words) < 30 else -1 if len(set(words)) < len(words) ** 0.5 else 1


def _runs(words, lines, raw):
    if len(words) < 10:
        return 0
    return _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words), 0.2, 0.05)


def _few_pairs(words, lines, raw):
    if len(words) < 30:
        return 0
    return _share(len(words) - len(set(zip(words, words[1:], strict=False))), len(words), 0.6, 0.3)


def _repeated_lines(words, lines, raw):
    return _share(len(lines) - len(set(lines)), len(lines), 0.4, 0.1) if len(lines) >= 4 else 0


HEURISTICS = (_letters, _tails, _symbols, _capitals, _shouting, _few_words, _runs, _few_pairs, _repeated_lines)


def votes(text: str | None) -> list[int]:
    """One vote per heuristic; a text without words gets none."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0] * len(HEURISTICS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [h(words, lines, raw) for h in HEURISTICS]


def _code(vote: list[int]) -> int:
    out = 0
    for v in vote:
        out = out * 3 + v + 1
    return out


def _votes_of(code: int) -> list[int]:
    out = []
    for _ in HEURISTICS:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def _patterns(batches):
    for batch in batches:
        codes = [_code(votes(x)) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32())], names=["pattern"])


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """How often each pattern of votes occurs in all of ``docs``; at most 3 ** 9 = 19683 rows reach the driver."""
    found = docs.select("text").mapInArrow(_patterns, "pattern int").groupBy("pattern").count()
    return {r["pattern"]: r["count"] for r in found.collect()}


def estimate(counts: dict[int, int], rounds: int = 10_000, tolerance: float = 1e-10) -> dict:
    """Maximum-likelihood estimates by expectation-maximisation over pattern counts.

    Starts from calling a pattern bad if it has a bad vote, which also settles which class is which. Gives the posterior of
    every pattern, ``prior``, and ``rates[class, heuristic, 0 for bad or 1 for good]`` among the votes cast, so that no vote
    says nothing; raises if the likelihood does not settle.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    cast = np.array([_votes_of(c) for c in codes]) if codes else np.empty((0, len(HEURISTICS)), int)
    posterior = np.where((cast < 0).any(axis=1), 0.05, 0.95)
    before, prior, rates = None, 0.5, None
    for _ in range(rounds):
        weight = np.stack([n * (1 - posterior), n * posterior])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        rates = np.ones((2, len(HEURISTICS), 2))  # one vote of each kind more than was seen
        for kind, v in enumerate((-1, 1)):
            rates[:, :, kind] += weight @ (cast == v)
        rates /= rates.sum(axis=2, keepdims=True)
        per = np.log([1 - prior, prior])[:, None] + np.log(rates[:, :, 0]) @ (cast < 0).T + np.log(rates[:, :, 1]) @ (cast > 0).T
        top = per.max(axis=0)
        total = top + np.log(np.exp(per - top).sum(axis=0))
        posterior = np.exp(per[1] - total)
        likelihood = float(n @ total) / max(n.sum(), 1)
        if before is not None and abs(likelihood - before) < tolerance:
            break
        before = likelihood
    else:
        raise RuntimeError("expectation-maximisation did not settle")
    return {"posterior": dict(zip(codes, posterior.tolist(), strict=True)), "prior": float(prior), "rates": rates}


def _shape(word: str) -> str:
    """Letter case, and what a word ends in if that is no letter or digit."""
    tail = word.rstrip("#*$%&|<>!?.,;:")
    return f"{word[len(tail) :]} {'u' if tail.isupper() else 'l' if tail.islower() else 't' if tail.istitle() else 'm' if tail else ''}"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, of unit length, of the hashed words and shapes of a whole text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), np.uint64, len(words))
    shapes = np.fromiter((xxhash.xxh3_64_intdigest(_shape(x), 1) for x in words), np.uint64, len(words))
    # two features for repetition: words that repeat the one before, and the share of distinct words in tenths
    again = np.full(int((hashed[1:] == hashed[:-1]).sum()), xxhash.xxh3_64_intdigest("again", 2), np.uint64)
    tenth = 10 * len(np.unique(hashed)) // len(words)
    variety = np.full(len(words), xxhash.xxh3_64_intdigest(f"variety {tenth if len(words) >= 30 else 10}", 2), np.uint64)
    found, counts = np.unique(np.concatenate([hashed, shapes, again, variety]) % np.uint64(BUCKETS), return_counts=True)
    values = np.log1p(counts)
    return found.astype(np.int64), values / np.sqrt(values @ values)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = PASSES, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer fitted to soft labels by full gradient steps with adaptive rates."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    sizes = np.array([len(r[0]) for r in rows])
    at = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    labels = np.array([r[2] for r in rows])
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(passes):
        margin = np.bincount(row, values * weights[at], len(rows)) + bias
        error = (1 / (1 + np.exp(-margin)) - labels) / len(rows)
        slope = np.bincount(at, values * error[row], BUCKETS) + l2 * weights
        seen += slope**2
        weights -= 0.5 * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def fit(docs: DataFrame, limit: int = TRAINING) -> dict:
    """The label model of all of ``docs`` and a scorer trained on the posteriors of at most ``limit`` of them."""
    model = estimate(pattern_counts(docs))
    posterior = model["posterior"]
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [features(x) for x in texts]
            labels = [posterior.get(_code(votes(x)), 0.5) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                    pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                    pa.array(labels, pa.float64()),
                ],
                names=["doc_id", "at", "value", "label"],
            )

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    sample = chosen.mapInArrow(run, "doc_id long, at array<int>, value array<float>, label double").orderBy("doc_id").limit(limit).collect()
    rows = [(np.array(r["at"], np.int64), np.array(r["value"], float), r["label"]) for r in sample if r["at"]]
    model["weights"], model["bias"] = train(rows)
    return model


def weak_quality(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` but ``text`` with ``n_words``, ``weak_label`` (the posterior), ``score`` and ``kept``.

    Every whole text is scored, row by row, so repeated rows get equal results. Null and empty texts have no
    words and are never kept. Columns of the input that bear a name given out here are replaced.
    """
    given = ("n_words", "weak_label", "score", "kept")
    rows = docs.select(*[c for c in docs.columns if c not in given and c != "text"], "text")
    schema = with_fields(rows.drop("text").schema, "n_words long, weak_label double, score double, kept boolean")
    weights, bias, posterior = model["weights"].astype(np.float32), model["bias"], model["posterior"]

    def run(batches):
        for batch in batches:
            sizes, labels, scores = [], [], []
            for text in batch.column("text").to_pylist():
                at, values = features(text)
                sizes.append(len((text or "").split()))
                labels.append(posterior.get(_code(votes(text)), 0.5))
                scores.append(float(1 / (1 + np.exp(-(values @ weights[at] + bias)))))
            kept = [s >= threshold and n > 0 for s, n in zip(scores, sizes, strict=True)]
            columns = pa.array(sizes, pa.int64()), pa.array(labels, pa.float64()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *given])

    return rows.mapInArrow(run, schema)
