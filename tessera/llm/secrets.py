"""Secret scans: base patterns, and a character convolutional network over every other candidate in its context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean, slices, text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the matches of AKIA[A-Z0-9]+ that have 20 characters
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.~!@#$%^&*:?|\\-]{8,}")
STOPS = ".:?"  # a candidate does not end as a sentence does
SHORTEST = 8
LONG = 16  # a shorter run is judged only if it is not just a word: a digit, a capital after a small letter, or a sign
ODD = re.compile(r"[0-9+/_=~@#$%^&*|\\]|[a-z][A-Z]|[!.:?][A-Za-z]")
#: Further forms that name themselves: positives to learn from, not base findings.
FORMS = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abprs]-|AIza|eyJ[A-Za-z0-9_-]+\.eyJ)[A-Za-z0-9_.=-]{16,}")
KINDS = ("assign", "access", "hex", "network")
WORTH = ("passw", "secret", "token", "api")
WIDE, STRIDE, CONTEXT = 64, 32, 16  # characters of a window over a candidate, between windows, and around a candidate
Span = tuple[str, int, int]


def base(text: str) -> list[Span]:
    """The base spans by start, then kind; places are code points, ends exclusive."""
    low = text.lower()
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if any(w in low for w in WORTH) else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def others(text: str, found: list[Span]) -> list[tuple[int, int]]:
    """Runs of token characters, of what base spans leave of them: what the network judges."""
    out, at = [], 0
    for a, b in [*sorted((a, b) for _, a, b in found), (len(text), len(text))]:
        for m in RUN.finditer(text, at, max(at, a)):
            run = m.group().rstrip(STOPS)
            if len(run) >= LONG or len(run) >= SHORTEST and ODD.search(run):
                out.append((m.start(), m.start() + len(run)))
        at = max(at, b)
    return out


def bare(text: str, span: Span) -> list[str]:
    """The windows of a base span without the keyword or prefix that made it one."""
    kind, a, b = span
    value = b - len(ASSIGN.match(text, a, b).group(2)) if kind == "assign" else a + 4 if kind == "access" else a
    before = text[max(0, a - CONTEXT) : a]
    return windows(before + text[value : b + CONTEXT], len(before), len(before) + b - value)


def windows(text: str, start: int, stop: int) -> list[str]:
    """The candidate and ``CONTEXT`` characters on both sides, cut into overlapping windows that cover it all."""
    around = text[max(0, start - CONTEXT) : stop + CONTEXT]
    return [around[a : a + WIDE] for a in range(0, max(1, len(around) - WIDE + STRIDE), STRIDE)]


def codes(pieces: list[str]) -> np.ndarray:
    """Printable ASCII as 1..95, all else 96, padding 0."""
    points = np.frombuffer("".join(p.ljust(WIDE) for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDE)
    out = np.where((points >= 32) & (points <= 126), points - 31, 96).astype(np.uint8)
    out[np.arange(WIDE) >= np.array([len(p) for p in pieces], int)[:, None]] = 0
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Windows written as bytes, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE)


class Network:
    """Embedding, one convolution, maximum over places, one logistic unit; plain numpy, trained by Adam.

    The convolution is looked up: what a character adds to each filter at each
    of the places under it is in a table made from embedding and weights.
    """

    def __init__(self, seed: int = 5, size: int = 8, width: int = 5, filters: int = 16):
        rng = np.random.default_rng(seed)
        self.width = width
        p = {
            "e": rng.normal(0, 0.3, (97, size)),
            "w": rng.normal(0, (width * size) ** -0.5, (width, size, filters)),
            "b": np.zeros(filters),
            "v": rng.normal(0, filters**-0.5, filters),
            "c": np.zeros(1),
        }
        self.p = {k: a.astype(np.float32) for k, a in p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1  # untrained: nothing is added
        self.recall, self.precision = 0.0, 0.0
        self.fitted, self.apart, self.left_out = {0: 0, 1: 0}, {0: 0, 1: 0}, 0  # windows of each label fitted on, calibrated on; unlabelled ones like findings

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def take(self, vector: np.ndarray) -> None:
        ends = np.cumsum([a.size for a in self.p.values()])[:-1]
        self.p = {k: part.reshape(a.shape).astype(np.float32) for (k, a), part in zip(self.p.items(), np.split(vector, ends), strict=True)}

    def _forward(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = x.shape[1] - self.width + 1
        h = table[0].take(x[:, :places], axis=0)
        for k in range(1, self.width):
            h += table[k].take(x[:, k : k + places], axis=0)
        top = h.argmax(axis=1)
        best = np.maximum(np.take_along_axis(h, top[:, None], axis=1)[:, 0] + self.p["b"], 0)
        return top, best, (best * self.p["v"]).sum(axis=1) + self.p["c"]

    def logits(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        """Within 60 of 0 and in steps of 1/1024: all the values there can be are few enough to count."""
        table = self.p["e"] @ self.p["w"]
        z = [self._forward(x[a : a + batch].astype(np.intp), table)[2] for a in range(0, len(x), batch)]
        return np.clip(np.round(np.concatenate(z).astype(float) * 1024) / 1024, -60, 60) if z else np.empty(0)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted logistic loss."""
        e, w, v = self.p["e"], self.p["w"], self.p["v"]
        table = e @ w
        x = x.astype(np.intp)
        top, best, z = self._forward(x, table)
        d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight / len(x)
        dh = d[:, None] * v * (best > 0)  # each filter's gradient goes to its best place
        k = np.arange(self.width)
        under = x[np.arange(len(x))[:, None, None], top[:, :, None] + k]
        at = (k * len(e) + under) * len(v) + np.arange(len(v))[:, None]
        dt = np.bincount(at.ravel(), np.repeat(dh.ravel(), self.width), table.size).reshape(table.shape)
        return {"e": (dt @ w.transpose(0, 2, 1)).sum(axis=0), "w": e.T @ dt, "b": dh.sum(axis=0), "v": best.T @ d, "c": np.array([d.sum()])}

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float, n: np.ndarray | None = None) -> None:
        """Platt scaling on labelled findings kept apart, ``n`` of each score and label; then the highest threshold that reaches ``recall`` there.

        Only the positives fix the threshold; there is no floor on precision.
        """
        a, b = 1.0, 0.0
        n = np.ones(len(z)) if n is None else n
        yes, no = (n * y).sum(), (n * (1 - y)).sum()
        goal = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
        loss = lambda a, b: (n * (np.logaddexp(0, a * z + b) - goal * (a * z + b))).sum()
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            s = n * (p * (1 - p) + 1e-9)
            grad = np.array([(n * (p - goal) * z).sum(), (n * (p - goal)).sum()])
            hess = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            while abs(step).max() >= 1e-9 and loss(a - step[0], b - step[1]) > loss(a, b):
                step = step / 2  # a full step may overshoot where findings are easily told apart
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.scale, self.shift = float(a), float(b)
        p = self.probability(z)
        self.threshold = _ranked(p[y > 0], n[y > 0], 1 - recall)
        taken = n * (p >= self.threshold)
        self.recall, self.precision = float((taken * y).sum() / yes), float((taken * y).sum() / taken.sum())

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60)))


class Learner:
    """Adam over one shard's windows, as they come."""

    def __init__(self, net: Network, weight: tuple[float, float], rate: float = 0.01):
        self.net, self.weight, self.rate, self.n, self.t = Network(), np.array(weight, np.float32), rate, 0, 0
        self.net.take(net.vector())
        self.first, self.second = ({k: np.zeros_like(a) for k, a in self.net.p.items()} for _ in range(2))

    def learn(self, x: np.ndarray, y: np.ndarray, batch: int = 64) -> None:
        self.n += len(x)
        for own in np.array_split(np.arange(len(x)), max(1, len(x) // batch)):
            self.t += 1
            for k, grad in self.net.gradient(x[own], y[own], self.weight[y[own]]).items():
                self.first[k] += 0.1 * (grad - self.first[k])
                self.second[k] += 0.001 * (grad**2 - self.second[k])
                self.net.p[k] -= self.rate * self.first[k] / (1 - 0.9**self.t) / (np.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-8)


def _fit(windows: DataFrame, weight: tuple[float, float], epochs: int) -> Network:
    """A network that has passed over all rows ``epochs`` times.

    In an epoch each shard's rows are learned from in their order, beginning
    with the same network; the next begins with the mean of what they came to,
    each by its number of rows.
    """
    net = Network()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Learner] = {}
        for batch in batches:
            x, y, shard = _matrix(batch.column("codes")), batch.column("y").to_numpy(), batch.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                own.setdefault(s, Learner(net, weight)).learn(x[shard == s], y[shard == s])
        if own:
            yield pa.record_batch([pa.array(list(own), pa.int32()), pa.array([m.n for m in own.values()], pa.int64()), pa.array([m.net.vector().tobytes() for m in own.values()])], names=["shard", "n", "net"])

    for _ in range(epochs):
        done = sorted(windows.mapInArrow(lean(learn), "shard int, n long, net binary").collect())
        net.take(np.average([np.frombuffer(r["net"], np.float32) for r in done], axis=0, weights=[r["n"] for r in done]))
    return net


def _tally(windows: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, label, rows) of every score there is: the network's scores have few values, however many the rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("y"), pa.array(net.logits(_matrix(batch.column("codes"))))], names=["y", "z"])

    rows = sorted(windows.mapInArrow(lean(score), "y int, z double").groupBy("z", "y").count().collect())
    return tuple(np.array([r[k] for r in rows], float) for k in range(3))


def _ranked(values: np.ndarray, n: np.ndarray, share: float) -> float:
    """The value that ``share`` of the rows lie below, of ``n`` rows a value."""
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(n[order]), int(share * n.sum()), "right")])


def _counts(windows: DataFrame) -> dict[int, list[int]]:
    """Rows of each label by third."""
    out = {0: [0, 0, 0], 1: [0, 0, 0]}
    for r in windows.groupBy("y", "third").count().collect():
        out[r["y"]][r["third"]] = r["count"]
    return out


def train(docs: DataFrame, recall: float = 0.95, text: str = "text", epochs: int = 2, shard_bytes: int = 32 << 20) -> Network:
    """A network from labelled findings, base ones without what gives them away and further forms, and from unlabelled candidates.

    An unlabelled candidate may be a secret: a first network sorts out those
    that score like all but the lowest 5 % of the findings kept apart, and the
    network is trained and scaled without them.

    Every window of a finding or candidate of every document is a row, and every
    row is learned from or calibrated on: a third, by a hash of the text and the
    place, is kept for calibration, the others are dealt by that hash over one
    shard for each ``shard_bytes`` of text, so the network does not depend on
    how documents are dealt.  The driver gets a network of fixed size from each
    shard and a count for each score.  ``recall`` and ``precision`` of the
    network are those reached on the third kept apart, against these labels;
    ``fitted`` and ``apart`` are the rows of each label in either part, and
    ``left_out`` those that the first network sorted out.  Without rows of both
    labels in both parts the network adds nothing.  More ``epochs`` teach that
    secrets among the unlabelled candidates are none.

    Documents are read once, and once for their size.  Null texts are left out;
    repeated rows count once; an empty table trains nothing.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = []
            for key, t in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                found = base(t)
                rows += [(1, key, span[1], n, piece) for span in found for n, piece in enumerate(bare(t, span))]
                rows += [(int(FORMS.search(t, a, b) is not None), key, a, n, piece) for a, b in others(t, found) for n, piece in enumerate(windows(t, a, b))]
            if rows:
                cut = codes([r[4] for r in rows]).tobytes()
                written = pa.array([cut[a : a + WIDE] for a in range(0, len(cut), WIDE)], pa.binary())
                yield pa.record_batch([*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))), written], names=["y", "key", "at", "nth", "codes"])

    scratch = Scratch(docs.sparkSession)
    shards = max(1, -(-text_bytes(docs, text) // shard_bytes))
    read = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    labelled = read.mapInArrow(lean(label), "y int, key long, at long, nth long, codes binary").select("y", F.xxhash64("key", "at", "nth").alias("h"), "codes").distinct()
    dealt = labelled.select("y", "h", "codes", F.pmod("h", F.lit(3)).cast("int").alias("third"), F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"))
    all_ = scratch.save(dealt.repartitionById(shards, "shard").sortWithinPartitions("h", "y", "codes"), "labelled")
    try:
        return _trained(all_, scratch, recall, epochs)
    finally:
        scratch.drop("labelled", "clear")


def _trained(labelled: DataFrame, scratch: Scratch, recall: float, epochs: int) -> Network:
    counts = _counts(labelled)
    both = lambda counts, k: all(0 < c[k] < sum(c) for c in counts.values())
    apart = next((k for k in (2, 1, 0) if both(counts, k)), None)
    if apart is None or min(map(sum, counts.values())) < 3:
        return Network()

    def fit(rows: DataFrame, counts: dict[int, list[int]]) -> Network:
        own = {y: sum(c) - c[apart] for y, c in counts.items()}
        net = _fit(rows.where(F.col("third") != apart), tuple(sum(own.values()) / 2 / own[y] for y in (0, 1)), epochs)
        net.fitted, net.apart = own, {y: c[apart] for y, c in counts.items()}
        return net

    first = fit(labelled, counts)
    z, _, n = _tally(labelled.where((F.col("third") == apart) & (F.col("y") == 1)), first)
    like = _ranked(z, n, 0.05)

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array((batch.column("y").to_numpy() == 1) | (first.logits(_matrix(batch.column("codes"))) < like)))

    used = scratch.save(labelled.mapInArrow(lean(clear), labelled.schema), "clear")
    left = _counts(used)
    if both(left, apart):
        net = fit(used, left)
        net.left_out = sum(counts[0]) - sum(left[0])
    else:
        net, used = first, labelled
    z, y, n = _tally(used.where(F.col("third") == apart), net)
    net.calibrate(z, y, recall, n)
    return net


def find(texts: list[str], net: Network) -> list[list[Span]]:
    """All spans of each text: the base ones, and the candidates that the network takes for secrets."""
    out = [base(t) for t in texts]
    where, pieces = [], []
    for i, t in enumerate(texts):
        for a, b in others(t, out[i]):
            cut = windows(t, a, b)
            where += [(i, a, b)] * len(cut)
            pieces += cut
    if pieces and net.threshold <= 1:
        good = net.probability(net.logits(codes(pieces))) >= net.threshold
        for i, a, b in dict.fromkeys(w for w, g in zip(where, good.tolist(), strict=True) if g):
            out[i].append(("network", a, b))
    return [sorted(s, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for s in out]


def scan(docs: DataFrame, net: Network, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) of each row: kind, start and stop of every secret, in code points.

    Null and empty texts have no spans; a very long text is scanned whole, with
    work in proportion to its length; repeated rows are scanned each; null ids
    are returned; other columns are not read; an empty table gives no rows.  One
    narrow pass; a candidate of any length is judged by windows that cover it.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = find([t or "" for t in batch.column("_text").to_pylist()], net)
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in s] for s in found]
            yield pa.record_batch([batch.column("_id"), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))], names=["_id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    read = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    return read.mapInArrow(lean(search), f"_id {kind}, spans array<struct<kind:string,start:long,stop:long>>").withColumnRenamed("_id", id_column)


def redact(docs: DataFrame, net: Network, text: str = "text", mark: str = "[secret]", length: str = "n_chars") -> DataFrame:
    """All columns, with every secret in ``text`` replaced by ``mark`` and ``length``, if there is such a column, counted anew."""
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(at).to_pylist()
            out = []
            for t, spans in zip(texts, find([t or "" for t in texts], net), strict=True):
                end = 0
                parts = []
                for _, a, b in spans:
                    if a >= end:
                        parts += t[end:a], mark
                    end = max(end, b)
                out.append("".join(parts) + t[end:] if spans else t)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.record_batch(columns, names=batch.schema.names)

    done = docs.mapInArrow(lean(clean), docs.schema)
    return done.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType)) if length in docs.columns else done
