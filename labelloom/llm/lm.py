"""Language-model scoring: a gated recurrent network with a class-factored output, trained in numpy.

Words are counted over all training documents. The most frequent ones, a fixed number, make the
network's vocabulary, in classes of about equal training counts; every other word is the unknown word, and its own probability given
that is its add-one share of the unknown words' training counts. So the model is a distribution over all
texts, and counts behind it cover the whole training part. The network itself is fitted by truncated
backpropagation on all training documents: after a start on a small sample, every epoch deals the documents to
tasks of about ``TASK_TOKENS`` tokens, each task trains on all of its own from the shared weights, and the weights are
averaged in two steps, each task counting by its tokens. Scoring carries the state across
windows, so the log-likelihood is that of the complete document; documents share the lanes of a batch.

Counts of frequent words travel to every task as one table of fixed size; rarer words of each document meet their counts
in a join by word.

Defined results: a null text counts as empty; every text ends with one end token, so an
empty text has one token; repeated rows count and are scored one by one; a row with a null id is scored, never
held out and never learned from. Without training documents every word is unknown.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.batches import batch_of, chunks
from labelloom.session import materialize

HOLD, HELD = 7, 2
VOCABULARY, CLASSES, HIDDEN = 1500, 40, 16
FREQUENT = 60_000  # words whose counts every task holds
TRAIN_ROWS, TRAIN_TOKENS = 400, 250_000  # bound of the sample that sets the first weights
TASK_TOKENS = 1 << 21  # training tokens of a task of an epoch, which its memory follows
WINDOW, LANES, EPOCHS, RATE = 32, 512, 2, 0.02
TASK_LANES, MIN_LANES = 256, 32
FURTHEST = 4  # windows that are read as one where few lanes are left
AT_ONCE = 16_384  # words whose probabilities are worked out together
END = b""  # no word is empty


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def in_training(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % HOLD != HELD


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text", most: int = 300_000) -> DataFrame:
    """(word, n) over the training documents, the end token as the empty word."""
    def run(batches):
        seen: Counter = Counter()

        def rows():
            out = batch_of(word=pa.array(list(seen), pa.binary()), n=pa.array(list(seen.values()), pa.int64()))
            seen.clear()
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, data, off in chunks(batch.column(1)):
                raw = data.tobytes()
                for r in range(j - i):
                    if in_training(keys[i + r]):
                        seen.update(words_of(raw[off[r]:off[r + 1]]))
                        seen[END] += 1
                if len(seen) > most:
                    yield rows()
        if seen:
            yield rows()

    counted = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Vocabulary in classes, the network's weights, and the add-one shares."""

    def __init__(self, frequent: dict[bytes, int], total: int, distinct: int, seed: int = 3):
        ranked = sorted(frequent, key=lambda w: (-frequent[w], w))
        inside = ranked[:VOCABULARY]
        if END in frequent and END not in inside:
            inside[-1] = END
        self.frequent, self.total, self.distinct = frequent, total, distinct
        covered = sum(frequent[w] for w in inside)
        self.unknown_total, self.unknown_distinct = total - covered, distinct - len(inside)
        weights = [*(frequent[w] for w in inside), max(1, self.unknown_total)]
        # Vocabulary ids: inside words, then the unknown word; classes are cut at equal sums of root counts, so that
        # frequent words sit in small classes and rare words still share a few.
        share = np.cumsum(np.sqrt(weights)) / np.sum(np.sqrt(weights))
        cls = np.minimum((share * CLASSES).astype(int), CLASSES - 1)
        _, self.cls = np.unique(cls, return_inverse=True)
        self.first = np.searchsorted(self.cls, np.arange(self.cls[-1] + 2))
        self.ids = {w: i for i, w in enumerate(inside)}
        self.unknown = len(inside)
        self.end = self.ids.get(END, self.unknown)
        n, rng = len(weights), np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "e": rng.normal(0, 0.1, (n + 1, 3 * h)), "u": rng.normal(0, h**-0.5, (h, 3 * h)), "b": np.zeros(3 * h),
            "c": rng.normal(0, 0.05, (h, len(self.first) - 1)), "d": np.zeros(len(self.first) - 1),
            "w": rng.normal(0, 0.05, (n, h)), "v": np.log(np.array(weights, float)),
        }
        by_class = np.add.reduceat(np.array(weights, float), self.first[:-1])
        self.p["d"] = np.log(by_class)
        self.p["v"] = self.p["v"] - self.p["d"][self.cls]
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def encode(self, words: list[bytes]) -> np.ndarray:
        ids = np.empty(len(words) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.ids.get, words, repeat(self.unknown)), np.int32, len(words))
        ids[-1] = self.end
        return ids

    def log10_share(self, count: int) -> float:
        """Add-one log share of a word with this training count among all words (the base model)."""
        return math.log10((count + 1) / (self.total + self.distinct + 1))

    def log10_unknown(self, count: int) -> float:
        """Add-one log share of a word with this training count among the unknown words."""
        return math.log10((count + 1) / (self.unknown_total + self.unknown_distinct + 1))

    def _gates(self):
        """Recurrent weights of the gates z and r, one above the other, and of the candidate."""
        u, h = self.p["u"], HIDDEN
        return np.stack([u[:, :h], u[:, h:2 * h]]).astype(np.float32), np.ascontiguousarray(u[:, 2 * h:], np.float32)

    def run(self, x, state):
        """States (T + 1, lanes, hidden) and the gates z and r (2, T, lanes, hidden) and c after reading the ids x (T, lanes)."""
        h, (steps, lanes) = HIDDEN, x.shape
        table, (gate, inner) = self.p["e"] + self.p["b"], self._gates()
        # A gate is 1 / (1 + exp(-a)): its table and its weights are taken with their signs turned.
        zr = np.take(np.stack([-table[:, :h], -table[:, h:2 * h]]).astype(np.float32), x, axis=1)
        c, gate = np.take(np.ascontiguousarray(table[:, 2 * h:], np.float32), x, axis=0), -gate
        states = np.empty((steps + 1, lanes, h), np.float32)
        states[0] = state
        two, one = np.empty((2, lanes, h), np.float32), np.empty((lanes, h), np.float32)
        for t in range(steps):
            s, after, g, d = states[t], states[t + 1], zr[:, t], c[t]
            np.matmul(s, gate, out=two)
            two += g
            np.exp(two, out=two)
            two += 1
            np.reciprocal(two, out=g)
            np.multiply(g[1], s, out=after)
            np.matmul(after, inner, out=one)
            one += d
            np.tanh(one, out=d)
            np.subtract(d, s, out=after)
            after *= g[0]
            after += s
        return states, (zr, c)

    def _by_class(self, y):
        """The order that sorts the ids y by class, and where each class begins and ends in it."""
        cls = self.cls[y].astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        return order, np.searchsorted(cls[order], np.arange(len(self.first)))

    def _inner(self, at, k):
        """Logits (words, n) within class k of the states at."""
        lo, hi = self.first[k], self.first[k + 1]
        out = self.p["w"][lo:hi] @ at.T
        out += self.p["v"][lo:hi, None]
        return out

    def _outer(self, at):
        """Logits (classes, n) of the states at."""
        out = self.p["c"].T @ at.T
        out += self.p["d"][:, None]
        return out

    def log_probs(self, states, y):
        """Natural log probability of the ids y given the states before them (flat)."""
        order, bounds = self._by_class(y)
        at, yy, each = states[order], y[order], np.arange(len(y))
        logits = self._outer(at)
        logits -= logits.max(axis=0)
        found = logits[self.cls[yy], each]
        found -= np.log(np.exp(logits, out=logits).sum(axis=0))
        for k in np.flatnonzero(np.diff(bounds)):
            i, j, lo = bounds[k], bounds[k + 1], self.first[k]
            if self.first[k + 1] - lo > 1:
                inner = self._inner(at[i:j], k)
                inner -= inner.max(axis=0)
                found[i:j] += inner[yy[i:j] - lo, each[:j - i]]
                found[i:j] -= np.log(np.exp(inner, out=inner).sum(axis=0))
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, x, y, keep, state, out=None):
        """Loss gradients over one window (T, lanes); ``keep`` masks targets. Returns (grads, last state)."""
        p, h = self.p, HIDDEN
        states, (zr, c) = self.run(x, state)
        before, flat = states[:-1], states[1:].reshape(-1, h)
        g = {k: np.zeros_like(v) for k, v in p.items()} if out is None else out
        on = np.flatnonzero(keep.ravel())
        n = np.float32(max(1, len(on)))
        order, bounds = self._by_class(y.ravel()[on])
        order = on[order]
        at, yy, each = flat[order], y.ravel()[order], np.arange(len(on))
        dl = self._outer(at)
        dl -= dl.max(axis=0)
        np.exp(dl, out=dl)
        dl /= dl.sum(axis=0) * n
        dl[self.cls[yy], each] -= 1 / n
        g["c"][:], g["d"][:] = (dl @ at).T, dl.sum(axis=1)
        found = dl.T @ p["c"].T
        for k in np.flatnonzero(np.diff(bounds)):
            i, j, lo, hi = bounds[k], bounds[k + 1], self.first[k], self.first[k + 1]
            if hi - lo == 1:
                continue
            di = self._inner(at[i:j], k)
            di -= di.max(axis=0)
            np.exp(di, out=di)
            di /= di.sum(axis=0) * n
            di[yy[i:j] - lo, each[:j - i]] -= 1 / n
            g["w"][lo:hi], g["v"][lo:hi] = di @ at[i:j], di.sum(axis=1)
            found[i:j] += di.T @ p["w"][lo:hi]
        ds = np.zeros((*x.shape, h), np.float32)
        ds.reshape(-1, h)[order] = found
        # What a step needs besides the gradient that comes from behind, for all steps at once.
        z, r = zr
        past, by_z, by_r = 1 - z, c - before, before * r
        by_z *= z
        by_z *= past
        gated = by_r.copy()
        by_r -= by_r * r
        by_c = c
        by_c *= c
        np.subtract(1, by_c, out=by_c)
        by_c *= z
        gate, inner = self._gates()
        gate, inner = np.ascontiguousarray(gate.transpose(0, 2, 1)), np.ascontiguousarray(inner.T)
        read = np.empty((3, *ds.shape), np.float32)
        carry, one = np.zeros(state.shape, np.float32), np.empty(state.shape, np.float32)
        for t in range(len(x) - 1, -1, -1):
            d, (a, b, e) = ds[t], read[:, t]
            d += carry
            np.multiply(d, by_z[t], out=a)
            np.multiply(d, by_c[t], out=e)
            np.matmul(e, inner, out=one)
            np.multiply(one, by_r[t], out=b)
            np.multiply(one, r[t], out=carry)
            carry += np.matmul(a, gate[0], out=one)
            carry += np.matmul(b, gate[1], out=one)
            d *= past[t]
            carry += d
        read = read.reshape(3, -1, h)
        before = before.reshape(-1, h)
        g["b"][:] = read.sum(axis=1).ravel()
        g["u"][:, :h], g["u"][:, h:2 * h] = before.T @ read[0], before.T @ read[1]
        g["u"][:, 2 * h:] = gated.reshape(-1, h).T @ read[2]
        ids = x.ravel().astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order].astype(np.int32), prepend=-1))
        sums = np.add.reduceat(np.concatenate([part[order] for part in read], axis=1), first)
        g["e"][ids[order[first]]] = sums
        return g, states[-1]

    @property
    def start(self) -> int:
        """Input id before the first word."""
        return self.unknown + 1

    def fit(self, texts: list[np.ndarray], lanes: int = 32, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Truncated backpropagation with Adam: documents run through the lanes window by window, state carried."""
        if not texts:
            return
        # All weights, their gradients and moments as one vector each; the named ones are views of it.
        flat = np.concatenate([x.ravel() for x in self.p.values()])
        slope, m, q, d, e = (np.zeros_like(flat) for _ in range(5))
        ends = np.cumsum([x.size for x in self.p.values()])[:-1]
        shapes = {k: x.shape for k, x in self.p.items()}
        self.p, g = ({k: part.reshape(shapes[k]) for k, part in zip(shapes, np.split(x, ends))} for x in (flat, slope))
        step, seen, planned = 0, 0, epochs * sum(map(len, texts))
        for _ in range(epochs):
            state = np.zeros((min(lanes, len(texts)), HIDDEN), np.float32)
            for x, y, keep, fresh, _, live in _windows(texts, lanes, WINDOW, self.start):
                slope[:] = 0
                _, state[live] = self.gradients(x, y, keep, np.where(fresh[:, None], np.float32(0), state[live]), g)
                step, lr = step + 1, rate * max(0.05, 1 - seen / planned)
                seen += np.count_nonzero(keep)
                np.clip(slope, -1, 1, out=d)
                m *= 0.9
                m += np.multiply(d, 0.1, out=e)
                d *= d
                d *= 0.01
                q *= 0.99
                q += d
                np.divide(q, 1 - 0.99**step, out=d)
                np.sqrt(d, out=d)
                d += 1e-6
                np.multiply(m, lr / (1 - 0.9**step), out=e)
                e /= d
                flat -= e

    def score(self, texts: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """Natural log probability of each id sequence, state carried from window to window."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        size = np.array([len(t) for t in texts])
        # Long texts first, and no more lanes than they leave to fill: few lanes run on alone at the end.
        order = np.argsort(-size, kind="stable")
        lanes = int(min(lanes, len(texts), max(MIN_LANES, size.sum() // max(1, size.max()))))
        state, waiting = np.zeros((lanes, HIDDEN), np.float32), []

        def add_up():
            after, y, who = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            return np.bincount(who, self.log_probs(after, y).astype(np.float64), len(total))

        for x, y, keep, fresh, owner, live in _windows([texts[k] for k in order], lanes, WINDOW, self.start):
            states, _ = self.run(x, np.where(fresh[:, None], np.float32(0), state[live]))
            state[live] = states[-1]
            on = np.flatnonzero(keep.ravel())
            waiting.append((states[1:].reshape(-1, HIDDEN)[on], y.ravel()[on], order[owner[on % len(owner)]]))
            if sum(len(w[1]) for w in waiting) >= AT_ONCE:
                total += add_up()
        return total + add_up() if waiting else total


def _windows(texts, lanes, width, start):
    """Windows (inputs, targets, mask, fresh lanes, owner per lane, lanes in use), each lane reading one text after another."""
    size = np.array([len(t) for t in texts], np.int64)
    flat, ends = np.concatenate(texts), np.cumsum(size)
    lanes = min(lanes, len(texts))
    at, end, own = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.full(lanes, -1)
    queue = 0
    while True:
        done = np.flatnonzero(at >= end)
        new = np.arange(queue, min(queue + len(done), len(texts)))
        taken = done[:len(new)]
        own[taken], at[taken], end[taken], queue = new, ends[new] - size[new], ends[new], queue + len(new)
        live = np.flatnonzero(at < end)
        if not len(live):
            if queue >= len(texts):
                return
            continue
        fresh = np.zeros(lanes, bool)
        fresh[taken] = True
        fresh = fresh[live]
        here, last = at[live], end[live]
        # Where few lanes are left, a window reaches further, so that it still holds about as many ids.
        reach = width * min(FURTHEST, max(1, lanes // len(live)))
        spot = here + np.arange(min(reach, int((last - here).max())))[:, None]
        keep = spot < last
        spot = np.minimum(spot, last - 1)
        y = flat[spot]
        x = np.empty_like(y)
        x[0] = np.where(fresh, start, flat[np.maximum(here - 1, 0)])
        x[1:] = y[:-1]
        yield x, y, keep, fresh, own[live], live
        at[live] = here + reach


def fit(docs: DataFrame, id_col="doc_id", text_col="text") -> tuple[Model, DataFrame]:
    """The model fitted on all training documents, and the table of all training counts."""
    counts = materialize(word_counts(docs, id_col, text_col), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    model = Model(dict(zip(top["word"].to_pylist(), top["n"].to_pylist())), sums["n"] or 0, sums["v"])
    encoded = materialize(encode_training(docs, model, id_col, text_col), "training-ids")
    # At most TRAIN_ROWS rows, each cut to TRAIN_TOKENS ids of two bytes: small enough for the driver whatever the input.
    head = F.expr(f"substring(ids, 1, {2 * TRAIN_TOKENS})")
    picked = encoded.withColumn("_d", F.xxhash64(F.lit("lm"), "key")).orderBy("_d", "key", "ids").limit(TRAIN_ROWS)
    room, chosen = TRAIN_TOKENS, []
    for row in picked.select(head.alias("ids")).toLocalIterator():
        chosen.append(np.frombuffer(row["ids"], np.uint16)[:room])
        room -= len(chosen[-1])
        if room <= 0:
            break
    model.fit(chosen)
    for epoch in range(EPOCHS):
        model.p = epoch_weights(encoded, model, epoch)
    return model, counts


def encode_training(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(key, ids) of every training document: its vocabulary ids, two bytes each, the end token last."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, data, off in chunks(batch.column(1)):
                raw = data.tobytes()
                rows = [r for r in range(j - i) if in_training(keys[i + r])]
                ids = [shared.value.encode(words_of(raw[off[r]:off[r + 1]])).astype(np.uint16).tobytes() for r in rows]
                yield batch_of(key=pa.array([str(keys[i + r]) for r in rows], pa.string()), ids=pa.array(ids, pa.binary()))

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, "key string, ids binary")


def epoch_weights(encoded: DataFrame, model: Model, epoch: int) -> dict[str, np.ndarray]:
    """Weights after one epoch: every task trains on all its documents, the weights are averaged by tokens."""
    tasks = max(1, -(-model.total // TASK_TOKENS))
    slots = math.isqrt(tasks - 1) + 1  # one sum each, so that the driver gets about the root of the tasks
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rate = RATE / 2**(epoch + 1)

    def train(batches):
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if rows:
            texts = [np.frombuffer(ids, np.uint16) for _, ids in rows]
            # Texts that would keep a lane busy for long go first, so that few lanes run on alone at the end.
            share = sum(map(len, texts)) / (4 * TASK_LANES)
            mixed = np.random.default_rng(epoch).permutation(len(texts))
            texts = [texts[k] for k in sorted(mixed, key=lambda k: -max(share, len(texts[k])))]
            part, own = zlib.crc32(repr(rows[0][0]).encode()), copy.copy(shared.value)
            own.p = {k: x.copy() for k, x in own.p.items()}
            own.fit(texts, TASK_LANES, 1, rate)
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float64)
            n = sum(map(len, texts))
            yield batch_of(slot=pa.array([part % slots], pa.int32()), part=pa.array([part], pa.int64()),
                           n=pa.array([n], pa.int64()), sums=pa.array([(flat * n).tobytes()], pa.binary()))

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part")  # the same order of adding on every run
        total = sum(np.frombuffer(x.as_buffer()) for x in rows["sums"])
        return pa.table({"slot": rows["slot"].slice(0, 1), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    trained = encoded.repartition(tasks, "key", "ids").mapInArrow(train, "slot int, part long, n long, sums binary")
    summed = trained.groupBy("slot").applyInArrow(add, "slot int, n long, sums binary").toArrow().sort_by("slot")
    n = sum(summed["n"].to_pylist())
    if not n:
        return model.p
    flat = sum(np.frombuffer(x.as_buffer()) for x in summed["sums"]) / n
    out, at = {}, 0
    for k in sorted(model.p):
        x = model.p[k]
        out[k] = flat[at:at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        # Inside words come first, so a place below their number is the word's vocabulary id. One place more stands for all others.
        place = {w: i for i, w in enumerate([*m.ids, *(w for w in m.frequent if w not in m.ids)])}
        other = len(place)
        base_of = np.array([*(m.log10_share(m.frequent[w]) for w in place), 0.0])
        own_of = np.array([*(0.0 if w in m.ids else m.log10_unknown(m.frequent[w]) for w in place), 0.0])
        for batch in batches:
            keys = batch.column(0)
            for i, j, data, off in chunks(batch.column(1), 16 << 20):
                raw = data.tobytes()
                texts, size, hits, base, own, rare, rare_n = [], [], [], [], [], [], []
                for r in range(j - i):
                    w = words_of(raw[off[r]:off[r + 1]])
                    w.append(END)
                    at = np.fromiter(map(place.get, w, repeat(other)), np.int32, len(w))
                    texts.append(np.minimum(at, m.unknown).astype(np.uint16))
                    left = Counter([w[k] for k in np.flatnonzero(at == other)])
                    size.append(len(w))
                    hits.append(len(w) - sum(left.values()))
                    base.append(math.fsum(base_of[at].tolist()))
                    own.append(own_of[at].sum())
                    rare.append(list(left))
                    rare_n.append(list(left.values()))
                net = m.score(texts) / math.log(10)
                yield batch_of(**{id_col: keys.slice(i, j - i)}, n_tokens=pa.array(size, pa.int64()), n_hit=pa.array(hits, pa.int64()),
                               base=pa.array(base, pa.float64()), net=net + np.array(own),
                               rare=pa.array(rare, pa.list_(pa.binary())), times=pa.array(rare_n, pa.list_(pa.int64())))

    rows = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_tokens long, n_hit long, base double, net double, rare array<binary>, times array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    pairs = rows.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("p"))
    pairs = pairs.select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    least = min(model.frequent.values(), default=0)
    # Frequent words never ask; what may be asked is no more frequent than the last of them.
    seen = pairs.join(counts.where(F.col("n") <= least), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    share = model.total + model.distinct + 1
    unknown = model.unknown_total + model.unknown_distinct + 1
    rest = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(share)))).alias("b"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(unknown)))).alias("o"))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLD == HELD, F.lit(False))
    zero = F.lit(0.0)
    return rows.drop("rare", "times").join(rest, "row", "left").select(
        id_col, held.alias("held_out"), "n_tokens", (F.col("n_hit") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("net") + F.coalesce("o", zero)).alias("score"))
