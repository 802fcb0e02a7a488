"""LM scoring with a gated recurrent language model.

Corpus counts of every training word are a distributed word count. The most
frequent words form the model's vocabulary, arranged in classes, so the softmax
is a class times a word within its class; any other word is one symbol times its
share of the counts outside the vocabulary, which makes the whole a distribution
over all words. The recurrent cell is a GRU, trained in numpy by truncated
backpropagation through time: each task trains on its own documents, state
carried from window to window, and the tasks' weights are averaged by Spark.
Scoring carries the state through the whole document.

Counts of the HEAD most frequent words are broadcast (a fixed bound); counts of
all others are joined by shuffle, so any vocabulary size works the same way.
Weights learn from every training document once, in rounds whose number grows with
the logarithm of the documents: each starts from the averaged weights of the round
before.

Defined results: null text is the empty text, which is one end token; repeated
rows score alike; with no training documents every count is 0 and scores are
those of an untrained model; an empty table gives no rows; extra columns play no
part.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, binary, held_out, kept, row_hash

HEAD = BROADCAST_ROWS
N_CLASSES, PER_CLASS = 32, 64
HIDDEN = 16
STEPS, LANES = 24, 512
#: Training tokens that a task lays out at a time, and the weight updates that they are good for at least: few tokens get fewer lanes.
BUFFER, UPDATES = 2_000_000, 100
SEGMENT = 1024
RATE = 0.01
#: Training documents of a task, for which there are at most MOST_TASKS a round; FAN_IN tasks' weights are averaged at a time.
TRAIN_TASK_ROWS, MOST_TASKS, FAN_IN = 2000, 65_536, 32
#: Tasks that a round has at least: fewer average too little. A corpus of twice the size has one round more.
ROUND_TASKS = 4
FLUSH = 400_000
CHUNK_TOKENS = 4_000_000
MOST_LANES, SPAN = 512, 64
OTHER, END = 0, 1


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


# ── counts ─────────────────────────────────────────────────────────────────


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            seen.update(tokens(text))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    yield out()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) of every word of the training texts."""
    return train.select(binary()).mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the frequent words and the model's symbols among them."""

    n_tokens: int
    n_types: int
    n_docs: int
    head: dict[bytes, int]
    symbols: dict[bytes, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: float = 1.0

    @property
    def size(self) -> int:
        return len(self.weight)


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    total, types = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, types = (total or 0) + n_docs, types + (n_docs > 0)
    # the least count at which no more than HEAD words remain, from a bounded histogram
    step = F.floor(F.log2("c") * 8)
    least, left = None, HEAD
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        least = r["step"]
    rows = counts.where(step >= least).collect() if least is not None else []
    head = {bytes(r["word"]): r["c"] for r in rows}
    common = sorted(head, key=lambda w: (-head[w], w))[: N_CLASSES * PER_CLASS - 2]
    v = Vocabulary(total, types, n_docs, head)
    v.symbols = {w: i + 2 for i, w in enumerate(common)}
    inside = sum(head[w] for w in common)
    outside = total - n_docs - inside
    v.weight = np.array([outside + 0.5, n_docs + 0.5, *[head[w] + 0.5 for w in common]])
    v.rest = outside + 0.5 * (types - len(common) - (n_docs > 0)) + 0.5
    return v


# ── the model ──────────────────────────────────────────────────────────────


@dataclass
class Net:
    """Embedding rows already multiplied into the gates, recurrent weights, class and word outputs."""

    embed: np.ndarray  # (V, 3H) input of the gates: reset, update, candidate
    recur: np.ndarray  # (H, 3H)
    classes: np.ndarray  # (H + 1, C)
    words: np.ndarray  # (C, H + 1, P)
    seen: int = 0  # tokens it learned from

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.classes, self.words]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Net:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Net(*out)


def new_net(weight: np.ndarray) -> Net:
    """Outputs start at the unigram distribution; symbols fill the classes in order of frequency."""
    rng = np.random.default_rng(6)
    n = N_CLASSES * PER_CLASS
    share = np.full(n, 1e-9)
    share[: len(weight)] = weight / weight.sum()
    share = share.reshape(N_CLASSES, PER_CLASS)
    net = Net(
        rng.normal(0, 0.1, (n, 3 * HIDDEN)).astype(np.float32),
        rng.normal(0, 0.3 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        np.zeros((HIDDEN + 1, N_CLASSES), np.float32),
        np.zeros((N_CLASSES, HIDDEN + 1, PER_CLASS), np.float32),
    )
    net.classes[-1] = np.log(share.sum(1))
    net.words[:, -1] = np.log(share / share.sum(1, keepdims=True))
    return net


def by_gate(w: np.ndarray) -> np.ndarray:
    """Weights (n, 3H) as (3, n, H), those of the sigmoids halved: a sigmoid is a tanh of half its argument."""
    out = np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2))
    out[:2] *= 0.5
    return out


def gate(b: np.ndarray, x: np.ndarray, h: np.ndarray) -> None:
    """One step of the cell: b (3, lanes, H) from the state, x from the input; b becomes reset, update and candidate, h the new state."""
    rz, c = b[:2], b[2]
    rz += x[:2]
    np.tanh(rz, out=rz)
    rz *= 0.5
    rz += 0.5
    c *= rz[0]
    c += x[2]
    np.tanh(c, out=c)
    h += rz[1] * (c - h)


def _log_sums(x: np.ndarray, column: np.ndarray, safe: bool) -> np.ndarray:
    """One entry of each row of the log softmax; x is used up."""
    if not safe:
        np.minimum(x, 60, out=x)  # float32 holds the exponential of that, so no maximum is needed
    got = x[np.arange(len(x)), column].astype(np.float64)
    return got - np.log(np.exp(x, out=x).sum(1))


def _bounded(w: np.ndarray) -> bool:
    """Whether no state, whose parts lie within -1 and 1, can give outputs above 60."""
    return bool((np.abs(w[..., :-1, :]).sum(-2) + w[..., -1, :]).max() < 60)


def log_probs(net: Net, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """ln P(symbol | h): class, then word within the class."""
    order = np.argsort(symbol, kind="stable")
    h, symbol = h[order], symbol[order].astype(np.int64)
    which, word = symbol // PER_CLASS, symbol % PER_CLASS
    value = _log_sums(h @ net.classes[:-1] + net.classes[-1], which, _bounded(net.classes))
    edges, safe = np.searchsorted(which, np.arange(N_CLASSES + 1)), _bounded(net.words)
    for c in np.flatnonzero(np.diff(edges)):
        part = slice(edges[c], edges[c + 1])
        value[part] += _log_sums(h[part] @ net.words[c, :-1] + net.words[c, -1], word[part], safe)
    out = np.empty_like(value)
    out[order] = value
    return out


def train_window(net: Net, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Gradients of one window of (steps, lanes): live marks predicted places, fresh where a document starts; state in and out."""
    steps, lanes = inputs.shape
    gates, recur = by_gate(net.embed)[:, inputs], by_gate(net.recur)
    r, z, cand, back, before, hs = np.empty((6, steps, lanes, HIDDEN), np.float32)
    h = h.copy()
    for t in range(steps):
        if fresh[t].any():
            h[fresh[t]] = 0
        b = np.matmul(h, recur)
        before[t], back[t] = h, b[2]
        gate(b, gates[:, t], h)
        r[t], z[t], cand[t] = b
        hs[t] = h
    flat = lambda x: x.reshape(-1, x.shape[-1])
    at = np.flatnonzero(live.ravel())
    # by class, so that each class's rows lie together
    at = at[np.argsort(targets.ravel()[at], kind="stable")]
    which, word = targets.ravel()[at] // PER_CLASS, targets.ravel()[at] % PER_CLASS
    x, k = flat(hs)[at], np.arange(len(at))
    d_classes, d_words, dx = np.zeros_like(net.classes), np.zeros_like(net.words), np.empty((len(at), HIDDEN), np.float32)

    def softmax(x: np.ndarray, w: np.ndarray, column: np.ndarray, dw: np.ndarray, dx: np.ndarray, add: bool) -> float:
        p = x @ w[:-1]
        p += w[-1]
        np.exp(np.minimum(p, 60, out=p), out=p)  # float32 holds that, so no maximum is needed
        p /= p.sum(1, keepdims=True)
        row = k[: len(x)]
        loss = -float(np.log(p[row, column]).sum())
        p[row, column] -= 1
        dw[:-1], dw[-1] = x.T @ p, p.sum(0)
        if add:
            dx += p @ w[:-1].T
        else:
            np.matmul(p, w[:-1].T, out=dx)
        return loss

    loss = softmax(x, net.classes, which, d_classes, dx, False)
    edges = np.searchsorted(which, np.arange(N_CLASSES + 1))
    for c in np.flatnonzero(np.diff(edges)):
        part = slice(edges[c], edges[c + 1])
        loss += softmax(x[part], net.words[c], word[part], d_words[c], dx[part], True)
    dh_out = np.zeros((steps * lanes, HIDDEN), np.float32)
    dh_out[at] = dx
    dh_out = dh_out.reshape(steps, lanes, HIDDEN)
    # factors of dh that need no state: update gate and candidate
    to_c, to_z, to_r = z * (1 - cand * cand), (cand - before) * z * (1 - z), back * r * (1 - r)
    d_back, dh, keep = np.empty((steps, lanes, 3 * HIDDEN), np.float32), np.zeros_like(h), 1 - z
    d_cand = np.empty((steps, lanes, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + dh_out[t]
        dc = np.multiply(dh, to_c[t], out=d_cand[t])
        d_back[t, :, :HIDDEN] = dc * to_r[t]
        d_back[t, :, HIDDEN : 2 * HIDDEN] = dh * to_z[t]
        d_back[t, :, 2 * HIDDEN :] = dc * r[t]
        dh = dh * keep[t] + d_back[t] @ net.recur.T
        if fresh[t].any():
            dh = dh * ~fresh[t][:, None]
    d_recur = flat(before).T @ flat(d_back)
    d_back[:, :, 2 * HIDDEN :] = d_cand  # from here on the gates' own gradient
    symbols = inputs.ravel()
    order = np.argsort(symbols, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(symbols[order]) > 0])
    d_embed = np.zeros_like(net.embed)
    d_embed[symbols[order][starts]] = np.add.reduceat(flat(d_back)[order], starts, axis=0)
    return [d_embed, d_recur, d_classes, d_words], h, loss


def laid_out(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, live and fresh places (steps, lanes) of sequences packed into even lanes, one after the other in each.

    A sequence's first symbol is input alone.
    """
    lens = np.array([len(d) - 1 for d in docs], np.int64)
    lanes = packed(lens, most)
    loads = [int(lens[x].sum()) for x in lanes]
    shape = (max(loads), len(lanes))
    inputs, targets, live, fresh = np.full(shape, END, np.int16), np.full(shape, END, np.int16), np.zeros(shape, bool), np.zeros(shape, bool)
    for i, (x, load) in enumerate(zip(lanes, loads)):
        first = np.r_[0, np.cumsum(lens[x])[:-1]]
        targets[:load, i] = np.concatenate([docs[k][1:] for k in x])
        inputs[:load, i] = np.concatenate([docs[k][:-1] for k in x])
        live[:load, i] = True
        fresh[first, i] = True
    return inputs, targets, live, fresh


def train_lanes(net: Net, docs: Iterator[np.ndarray]) -> int:
    """Adam over windows of up to LANES streams of documents, BUFFER tokens laid out at a time. Trains net in place.

    Documents above SEGMENT tokens are learned in pieces, each with a state of its own, so that no lane is much longer than the others.
    """
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    done, step = 0, 0

    def learn(held: list[np.ndarray]) -> None:
        nonlocal done, step
        lanes = max(1, min(LANES, sum(map(len, held)) // (STEPS * UPDATES)))
        inputs, targets, live, fresh = laid_out(held, lanes)
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for at in range(0, len(inputs), STEPS):
            part = slice(at, at + STEPS)
            grads, h, _ = train_window(net, inputs[part], targets[part], live[part], fresh[part], h)
            n = int(live[part].sum())
            step += 1
            done += n
            for p, g, m, v in zip(net.parts(), grads, first, second):
                g *= np.float32(1 / n)
                np.clip(g, -1, 1, out=g)
                m *= 0.9
                m += np.float32(0.1) * g
                v *= 0.999
                v += np.float32(0.001) * np.square(g, out=g)
                np.sqrt(v * np.float32(1 / (1 - 0.999**step)), out=g)
                g += 1e-6
                p -= np.float32(RATE / (1 - 0.9**step)) * (m / g)

    held, size = [], 0
    for doc in docs:
        whole = np.concatenate([[END], doc])
        held += [whole[at : at + SEGMENT + 1] for at in range(0, len(doc), SEGMENT)]
        size += len(doc)
        if size >= BUFFER:
            learn(held)
            held, size = [], 0
    if held:
        learn(held)
    return done


def trained(train: DataFrame, vocab: Vocabulary) -> Net:
    """One pass over all documents, in rounds of parallel tasks; a round's weights are averaged by tokens and start the next.

    Rows go to rounds and tasks by their hash and are sorted there, so the weights
    do not depend on how the input is cut; rows equal in doc_id and text teach once.
    """
    net = new_net(vocab.weight)
    rounds = (1 + vocab.n_docs // (TRAIN_TASK_ROWS * ROUND_TASKS)).bit_length()
    rows = train.select("doc_id", row_hash("doc_id", "text").alias("_hash"), binary())
    n_tasks = min(MOST_TASKS, max(1, -(-vocab.n_docs // (rounds * TRAIN_TASK_ROWS))))
    for r in range(rounds):
        net = _round(net, rows.where(F.pmod("_hash", F.lit(rounds)) == r), vocab, n_tasks)
    return net


def _round(net: Net, picked: DataFrame, vocab: Vocabulary, n_tasks: int) -> Net:
    symbols, piece = vocab.symbols, 4096
    kind = "task long, part long, n long, w binary"

    def coded(words: list[bytes]) -> np.ndarray:
        out = np.full(len(words) + 1, END, np.int16)
        out[:-1] = np.fromiter(map(symbols.get, words, repeat(OTHER)), np.int16, len(words))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = net.filled(net.flat())
        texts = (t for b in batches for t in b.column(0).to_pylist())
        n = train_lanes(own, (coded(tokens(t)) for t in texts))
        flat = own.flat()
        parts = [flat[i : i + piece] for i in range(0, len(flat), piece)]
        task = TaskContext.get().partitionId()
        if n:
            cols = [pa.array([task] * len(parts)), pa.array(range(len(parts))), pa.array([n] * len(parts)), pa.array([p.tobytes() for p in parts])]
            yield pa.RecordBatch.from_arrays(cols, names=["task", "part", "n", "w"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        n = pdf["n"].sum()
        w = sum(np.frombuffer(x, np.float32) * (k / n) for x, k in zip(pdf["w"], pdf["n"]))
        return pdf.iloc[:1].assign(task=pdf["task"].iloc[0] // FAN_IN, n=n, w=w.astype(np.float32).tobytes())

    # dealt by the hash of the row, which dropDuplicates then finds in place
    dealt = picked.repartition(n_tasks, "doc_id", "_hash").dropDuplicates(["doc_id", "_hash"]).sortWithinPartitions("_hash", "doc_id")
    sums = dealt.select("text").mapInArrow(run, kind)
    # weights meet FAN_IN at a time, so no task holds more of them however many tasks there are
    while n_tasks > 1:
        sums = sums.groupBy("part", F.floor(F.col("task") / FAN_IN)).applyInPandas(mean, kind)
        n_tasks = -(-n_tasks // FAN_IN)
    # one row per part, or a few where Spark dealt the rows to more tasks than it was asked to
    rows = sorted(sums.select("part", "task", "n", "w").collect())
    if not rows:
        return net
    total, flat = sum(r["n"] for r in rows if r["part"] == 0), []
    for part in range(rows[-1]["part"] + 1):
        flat.append(sum(np.frombuffer(r["w"], np.float32) * (r["n"] / total) for r in rows if r["part"] == part))
    out = net.filled(np.concatenate(flat))
    out.seen = net.seen + total
    return out


# ── scoring ────────────────────────────────────────────────────────────────


def packed(lens: np.ndarray, most: int = MOST_LANES) -> list[list[int]]:
    """Sequences dealt to lanes, long ones first and each to the emptiest lane, so that all lanes end together."""
    if not len(lens):
        return []
    n = int(np.clip(lens.sum() // max(int(lens.max()), 1), 1, most))
    heap = [(0, i) for i in range(n)]
    lanes: list[list[int]] = [[] for _ in range(n)]
    for k in np.argsort(-lens, kind="stable"):
        load, i = heapq.heappop(heap)
        lanes[i].append(int(k))
        heapq.heappush(heap, (load + int(lens[k]), i))
    return sorted((x for x in lanes if x), key=lambda x: -int(lens[x].sum()))


def score_sequences(net: Net, seqs: list[np.ndarray]) -> np.ndarray:
    """Whole-sequence ln P of each; the state goes through a sequence and starts anew with the next in its lane."""
    lens = np.array([len(s) for s in seqs], np.int64)
    lanes = packed(lens)
    out = np.zeros(len(seqs))
    if not lanes:
        return out
    loads = np.array([lens[x].sum() for x in lanes])
    steps, n = int(loads[0]), len(lanes)
    symbol, fresh = np.full((steps, n), END, np.int16), np.zeros((steps, n), bool)
    for i, x in enumerate(lanes):
        symbol[: loads[i], i] = np.concatenate([seqs[k] for k in x])
        fresh[np.r_[0, np.cumsum(lens[x])[:-1]], i] = True
    value = np.zeros((steps, n))
    embed, recur = by_gate(net.embed), by_gate(net.recur)
    h, last = np.zeros((n, HIDDEN), np.float32), np.full((1, n), END, np.int16)
    hs = np.empty((SPAN, n, HIDDEN), np.float32)
    for start in range(0, steps, SPAN):
        span = min(SPAN, steps - start)
        now = symbol[start : start + span]
        before = np.concatenate([last, now[:-1]])
        before[fresh[start : start + span]] = END
        gates, last = embed[:, before], now[-1:]
        live = np.arange(start, start + span)[:, None] < loads
        for t in range(span):
            m = int(live[t].sum())
            new = fresh[start + t, :m]
            x = h[:m]
            if new.any():
                x[new] = 0
            gate(np.matmul(x, recur), gates[:, t, :m], x)
            hs[t, :m] = x
        value[start : start + span][live] = log_probs(net, hs[:span][live], now[live])
    for i, x in enumerate(lanes):
        out[x] = np.add.reduceat(value[: loads[i], i], np.r_[0, np.cumsum(lens[x])[:-1]])
    return out


_SCORED = "doc_id {kind}, _hash long, n_tokens long, n_known long, base_score double, score double, tail array<struct<word: binary, n: long>>"


def scored(docs: DataFrame, shared) -> DataFrame:
    """Figures of each document from the broadcast head; its words outside the head are left in tail."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = shared.value
        norm = np.log10(vocab.n_tokens + 0.5 * (vocab.n_types + 1))
        outside = np.log10(vocab.rest)
        ends = np.log10(vocab.n_docs + 0.5)
        place = dict(zip(vocab.head, range(1, len(vocab.head) + 1))).get  # any other word has place 0
        symbol = np.array([OTHER, *[vocab.symbols.get(w, OTHER) for w in vocab.head]], np.int16)
        log = np.log10(np.array([0.5, *vocab.head.values()]) + 0.5)
        log[0] = 0.0

        def tails(counters: tuple[Counter, ...]) -> pa.Array:
            ends = np.r_[0, np.cumsum([len(c) for c in counters])].astype(np.int32)
            words, counts = pa.array([w for c in counters for w in c], pa.binary()), pa.array([k for c in counters for k in c.values()], pa.int64())
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, counts], ["word", "n"]))

        def flush(rows: list) -> pa.RecordBatch:
            lnp = score_sequences(net, [r[2] for r in rows]) / np.log(10)
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind_of), pa.array(cols[1], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.float64()), pa.array(lnp + np.array(cols[6])), tails(cols[7])],
                names=["doc_id", "_hash", "n_tokens", "n_known", "base_score", "score", "tail"],
            )

        rows, size = [], 0
        for b in batches:
            kind_of = b.schema.types[0]
            for doc, key, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
                words = tokens(text)
                at = np.fromiter(map(place, words, repeat(0)), np.int32, len(words))
                seq = np.r_[symbol[at], np.int16(END)]
                far = np.flatnonzero(at == 0)
                known = float(log[at].sum())
                others = log[at[(seq[:-1] == OTHER)]].sum() - (seq[:-1] == OTHER).sum() * outside
                tail = Counter([words[i] for i in far])
                n = len(words) + 1
                rows.append((doc, key, seq, n, len(words) - len(far) + (vocab.n_docs > 0), known + ends - n * norm, others, tail))
                size += n
                if size > CHUNK_TOKENS:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return docs.select("doc_id", row_hash("doc_id", "text").alias("_hash"), binary()).mapInArrow(run, _SCORED.format(kind=kind))


def op6_recurrent(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    train = docs.where(~held_out(F.col("doc_id"), 1))
    n_docs = train.count()
    counts = kept(word_counts(train), "lm-counts")
    vocab = vocabulary(counts, n_docs)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, trained(train, vocab)))
    rows = kept(scored(docs, shared), "lm-rows")
    # equal rows have equal tails: each (document, word) counts once
    words = rows.select("doc_id", "_hash", F.explode("tail").alias("t")).groupBy("doc_id", "_hash", F.col("t.word").alias("word")).agg(F.max("t.n").alias("n"))
    met = words.join(counts.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    c = F.coalesce("c", F.lit(0))
    tails = met.groupBy(F.col("doc_id").alias("_d"), F.col("_hash").alias("_h")).agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_known")
    )
    out = rows.drop("tail").join(tails, (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    add = F.coalesce("_log", F.lit(0.0))
    known = (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known")
    return out.select(
        "doc_id", held_out(F.col("doc_id"), 1).alias("held_out"), "n_tokens", known, F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"),
    )
