"""LM scoring: a gated recurrent language model in numpy, its softmax factored by class, state carried to the document's end.

Word counts over all training documents give the unigram base, the classes and their inner distributions. A class holds
words of one hint (the language, by majority of a word's occurrences) and one band of frequency. The first bands of a
hint have a softmax over their words, conditioned on the state; later bands, and the class of all rarer words, have
their unigram distribution. So every word, known or not, has a probability, and they sum to one with unseen words as one.

The VOCABULARY most frequent words travel as one broadcast table of bounded size; rarer words' counts are joined by a
shuffle. Documents are encoded once, two bytes a token, for training and for scoring.

All training documents are dealt by a hash of their ids over shards of about SHARD_TOKENS tokens, and each shard's over
ROUNDS. In a round every shard trains a replica of the model on its part, by truncated backpropagation; then the replicas
are averaged by their tokens, and the next round begins with the average. Sums of weights are whole numbers, so neither the
partitions of the input nor the order in which tasks end have a say in the model.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import drop, written
from ._words import chunks

VOCABULARY = 1 << 20
HINTS, SOFT_BANDS, BAND_WORDS, FLAT_BANDS = 8, 8, 64, 4
STATE, WINDOW, LANES, SCORE_LANES, SCORE_WINDOW = 16, 16, 256, 256, 64
#: Tokens of a shard, about; rounds; windows of a stretch, the part of a shard that is laid over the lanes at once.
SHARD_TOKENS, ROUNDS, STRETCH = 1 << 22, 4, 64
RATE, CLIP, SEED = 0.02, 1.0, 7
#: In sums of replicas, weights are multiples of 1 / GRAIN and tokens of TOKEN_GRAIN: whole numbers below 2**63 for 2**43 tokens.
GRAIN, TOKEN_GRAIN = 1 << 20, 1 << 8
#: Tasks that sum replicas; each sends one row to the driver.
SUM_TASKS = 8
#: Tokens that a task counts before it hands on.
COUNT_TOKENS = 1 << 21
END = np.uint64(0x5E17D0C5E17D0C51)


def _counter():
    schema = pa.schema([("word", pa.int64()), ("hint", pa.int64()), ("n", pa.int64())])

    def emit(held):
        words, hints = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.lexsort((hints, words))
        words, hints = words[order], hints[order]
        new = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (hints[1:] != hints[:-1])])
        n = np.diff(np.r_[new, len(words)])
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(words[part].view(np.int64)), pa.array(hints[part]), pa.array(n[at : at + 100_000], pa.int64())], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            hints = batch.column(1).to_numpy(zero_copy_only=False)
            for at, w in chunks(batch.column(0)):
                counts = w.counts()
                own = hints[at : at + len(w)]
                held.append((np.concatenate([w.hashes, np.full(len(w), END)]), np.concatenate([np.repeat(own, counts), own])))
                n += len(held[-1][0])
                if n > COUNT_TOKENS:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return run


class Vocabulary:
    """The frequent words: sorted hashes, log10(count + 0.5), class, word number in a soft class, input number."""

    def __init__(self, words, counts, hints, total: int, kinds: int):
        self.total, self.kinds = total, kinds
        order = np.argsort(words)
        self.words, counts, hints = words[order], counts[order].astype(np.float64), hints[order]
        weight = counts + 0.5
        self.log_weight = np.log10(weight)
        self.norm = np.log10(total + 0.5 * (kinds + 1))
        named, back = np.unique(hints, return_inverse=True)
        mass = np.bincount(back, weight, len(named))
        rank = np.empty(len(named), np.int64)
        rank[np.argsort(-mass, kind="stable")] = np.arange(len(named))
        group = np.minimum(rank, HINTS - 1)[back] if len(named) else back
        groups = min(HINTS, max(1, len(named)))
        bands = SOFT_BANDS + FLAT_BANDS
        self.rare = groups * bands  # the class of all other words
        self.end = self.rare + 1
        self.classes = self.rare + 2
        self.soft = np.array([g * bands + b for g in range(groups) for b in range(SOFT_BANDS)], np.int64)
        self.of, self.slot = np.full(len(words), self.rare, np.int32), np.zeros(len(words), np.int32)
        is_end = self.words == END
        for g in range(groups):
            own = np.flatnonzero((group == g) & ~is_end)
            own = own[np.lexsort((self.words[own], -weight[own]))]
            soft = min(len(own), SOFT_BANDS * BAND_WORDS)
            self.of[own[:soft]] = g * bands + np.arange(soft) // BAND_WORDS
            self.slot[own[:soft]] = np.arange(soft) % BAND_WORDS
            rest = own[soft:]
            if len(rest):
                share = np.cumsum(weight[rest]) / weight[rest].sum()
                self.of[rest] = g * bands + SOFT_BANDS + np.minimum((share * FLAT_BANDS).astype(np.int64), FLAT_BANDS - 1)
        self.of[is_end] = self.end
        every = total + 0.5 * (kinds + 1)
        class_mass = np.bincount(self.of, weight, self.classes)
        class_mass[self.rare] = max(every - class_mass.sum(), 0.5)  # words outside the table, and the unseen one
        self.log_mass = np.log10(np.maximum(class_mass, 1e-9))
        self.class_bias = np.log(np.maximum(class_mass, 1e-3) / every)
        self.row = np.full(self.classes, -1, np.int64)
        self.row[self.soft] = np.arange(len(self.soft))
        self.word_bias = np.full((len(self.soft), BAND_WORDS), -30.0)
        in_soft = self.row[self.of] >= 0
        self.word_bias[self.row[self.of[in_soft]], self.slot[in_soft]] = np.log(weight[in_soft] / class_mass[self.of[in_soft]])
        self.inputs = len(self.soft) * BAND_WORDS + self.classes  # 2**16 at most, by the constants
        self.input = np.where(in_soft, self.row[self.of] * BAND_WORDS + self.slot, len(self.soft) * BAND_WORDS + self.of).astype(np.int32)
        self.rare_input, self.end_input = self.inputs - 2, self.inputs - 1
        # class, row of soft classes (or -1) and slot of each input number
        self.input_class = np.r_[np.repeat(self.soft, BAND_WORDS), np.arange(self.classes)]
        self.input_row = np.r_[np.repeat(np.arange(len(self.soft)), BAND_WORDS), np.full(self.classes, -1)].astype(np.int16)  # short numbers sort in linear time
        self.input_slot = np.r_[np.tile(np.arange(BAND_WORDS), len(self.soft)), np.zeros(self.classes, np.int64)]
        #: what a word's share of a flat class adds to its class's log probability
        self.flat = np.where(in_soft, 0.0, self.log_weight - self.log_mass[self.of])

    def __getstate__(self):
        """Tasks read a word's input number, weight and share; its class and slot are for making these."""
        return {k: x for k, x in self.__dict__.items() if k not in ("of", "slot")}

    def lean(self) -> Vocabulary:
        """Without the words: what training and scoring of encoded documents need, bounded by the constants."""
        out = copy(self)
        for k in ("words", "input", "log_weight", "flat"):
            out.__dict__.pop(k)
        return out

    def look(self, hashes):
        """Places in the table, -1 for other words."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1) if len(self.words) else np.full(len(hashes), -1)


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    random = np.random.default_rng(SEED)
    make = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
    return {"x": make(v.inputs, 3 * STATE), "u": make(STATE, 3 * STATE), "c": make(STATE, v.classes) * 0, "cb": v.class_bias.astype(np.float32), "w": make(len(v.soft), STATE, BAND_WORDS) * 0, "wb": v.word_bias.astype(np.float32)}


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: part.reshape(like[k].shape).astype(np.float32) for k, part in zip(sorted(like), np.split(flat, cuts), strict=True)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _gates(x, h, u):
    """The state after an input whose row is x, and what its derivative needs."""
    u = h @ u
    zr = _sigmoid(x[:, : 2 * STATE] + u[:, : 2 * STATE])
    z, r, un = zr[:, :STATE], zr[:, STATE:], u[:, 2 * STATE :]
    n = np.tanh(x[:, 2 * STATE :] + r * un)
    return n + z * (h - n), z, r, n, un


def _softmax(x, axis=-1):
    """In place. Along the first axis numpy reduces several times faster than along the last."""
    x -= x.max(axis=axis, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=axis, keepdims=True)
    return x


def _log_chance(x, at):
    """Natural log of the softmax of each column of x at one place; x is overwritten."""
    x -= x.max(axis=0)
    own = x[at, np.arange(len(at))].astype(np.float64)
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=0))


def _classes(p, hs):
    """The scores of the classes, a column for each state."""
    out = p["c"].T @ hs.T
    out += p["cb"][:, None]
    return out


class Inner:
    """The states of tokens in soft classes, sorted by class, and the scores of their classes' words, a column for each."""

    def __init__(self, p: dict[str, np.ndarray], hs: np.ndarray, rows: np.ndarray):
        order = np.argsort(rows, kind="stable")
        self.at = order[np.searchsorted(rows[order], 0) :]  # without those of other classes, -1
        sorted_rows = rows[self.at].astype(np.int64)
        self.hs, self.weights = hs[self.at], p["w"]
        starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(self.at) else []
        self.cuts = [(int(k), int(x), int(y)) for k, x, y in zip(sorted_rows[starts], starts, np.r_[starts[1:], len(self.at)], strict=True)] if len(self.at) else []
        self.scores = np.empty((p["wb"].shape[1], len(self.at)), np.float32)
        for k, x, y in self.cuts:
            np.add(self.weights[k].T @ self.hs[x:y].T, p["wb"][k][:, None], out=self.scores[:, x:y])

    def gradients(self, d: np.ndarray, g: dict[str, np.ndarray], d_out: np.ndarray) -> None:
        """From the derivative by the scores, those by the weights, into g, and by the states, added to d_out."""
        back = np.empty_like(self.hs)
        for k, x, y in self.cuts:
            own = d[:, x:y]
            g["w"][k] = self.hs[x:y].T @ own.T
            g["wb"][k] = own.sum(axis=1)
            back[x:y] = own.T @ self.weights[k].T
        d_out[self.at] += back


class Learner:
    """One replica in training: Adam on the cross entropy of class and, in soft classes, word, by truncated backpropagation."""

    def __init__(self, v: Vocabulary, p: dict[str, np.ndarray], steps: int = 0):
        self.v, self.p, self.steps, self.first = v, {k: a.copy() for k, a in p.items()}, steps, steps
        self.m1, self.m2 = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def stretch(self, documents: list[np.ndarray]) -> int:
        """Learns documents (words' input numbers, each with the end after it) laid over the lanes one after another; their tokens."""
        v = self.v
        starts = np.cumsum([0, *(len(d) for d in documents)])
        n = int(starts[-1])
        lanes = max(1, min(LANES, n // WINDOW))
        length = -(-n // lanes)
        targets = np.full(lanes * length, v.end_input)
        targets[:n] = np.concatenate(documents)
        inputs = np.r_[v.end_input, targets[:-1]]
        keep = np.ones(lanes * length, np.float32)
        keep[starts[:-1]] = 0  # a document begins without a state
        keep[::length] = 0
        used = (np.arange(lanes * length) < n).astype(np.float32)
        inputs, targets, keep, used = (x.reshape(lanes, length).T for x in (inputs, targets, keep, used))
        h = np.zeros((lanes, STATE), np.float32)
        for at in range(0, length, WINDOW):
            h = self._window(inputs[at : at + WINDOW], targets[at : at + WINDOW], keep[at : at + WINDOW, :, None], used[at : at + WINDOW], h)
        return n

    def _window(self, inputs, targets, keep, used, h):
        v, p = self.v, self.p
        span, lanes = inputs.shape
        n_used = float(used.sum())
        x = p["x"][inputs]
        before, after, z, r, n, un = (np.empty((span, lanes, STATE), np.float32) for _ in range(6))
        for t in range(span):
            before[t] = h * keep[t]
            h, z[t], r[t], n[t], un[t] = _gates(x[t], before[t], p["u"])
            after[t] = h
        hs, target, share = after.reshape(-1, STATE), targets.ravel(), used.ravel() / n_used
        prob = _softmax(_classes(p, hs), 0)
        prob[v.input_class[target], np.arange(len(hs))] -= 1
        prob *= share
        g = {"c": hs.T @ prob.T, "cb": prob.sum(axis=1), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
        d_out = prob.T @ p["c"].T
        inner = Inner(p, hs, np.where(share > 0, v.input_row[target], np.int16(-1)))
        prob = _softmax(inner.scores, 0)
        prob[v.input_slot[target[inner.at]], np.arange(len(inner.at))] -= 1
        prob /= n_used
        inner.gradients(prob, g, d_out)
        d_out = d_out.reshape(span, lanes, STATE)
        dx, du = np.empty((span, lanes, 3 * STATE), np.float32), np.empty((span, lanes, 3 * STATE), np.float32)
        back, dh = np.ascontiguousarray(p["u"].T), np.zeros((lanes, STATE), np.float32)
        # by the derivative of the state: those of both gates and of what is new, as inputs and, behind the reset gate, as products
        by_new = (1 - z) * (1 - n * n)
        by_x = np.stack([(before - n) * z * (1 - z), by_new * un * r * (1 - r), by_new], axis=2)
        by_u = by_new * r
        for t in range(span - 1, -1, -1):
            d = dh + d_out[t]
            np.multiply(d[:, None], by_x[t], out=dx[t].reshape(lanes, 3, STATE))
            du[t, :, : 2 * STATE] = dx[t, :, : 2 * STATE]
            np.multiply(d, by_u[t], out=du[t, :, 2 * STATE :])
            dh = (d * z[t] + du[t] @ back) * keep[t]
        g["u"] = before.reshape(-1, STATE).T @ du.reshape(-1, 3 * STATE)
        flat = inputs.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        new = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        g["x"] = np.zeros_like(p["x"])
        g["x"][flat[order[new]]] = np.add.reduceat(dx.reshape(-1, 3 * STATE)[order], new, axis=0)
        self._update(g, n_used / (WINDOW * LANES))
        return h

    def _update(self, g, fill: float):
        """A stretch's last, half empty windows take smaller steps."""
        self.steps += 1
        size = np.sqrt(sum(float(np.vdot(a, a)) for a in g.values()))
        k = self.steps - self.first
        rate = RATE * min(1.0, CLIP / (size + 1e-9)) * min(1.0, fill) ** 0.5
        rate *= np.sqrt(1 - 0.999**k) / (1 - 0.9**k) / (1 + self.steps / 500) ** 0.5
        for name, a in g.items():
            m1, m2 = self.m1[name], self.m2[name]
            step = a - m1
            step *= np.float32(0.1)
            m1 += step
            np.multiply(a, a, out=a)  # the gradients have been read
            a -= m2
            a *= np.float32(0.001)
            m2 += a
            np.sqrt(m2, out=a)
            a += np.float32(1e-8)
            np.divide(m1, a, out=a)
            a *= np.float32(rate)
            self.p[name] -= a


SUM_SCHEMA = pa.schema([("tokens", pa.int64()), ("units", pa.int64()), ("steps", pa.int64()), ("weights", pa.binary())])
SUM_TYPE = "tokens bigint, units bigint, steps bigint, weights binary"


def _summed(found):
    """One row of the sums of (tokens, units, steps, whole weights)."""
    tokens, units, steps, total = 0, 0, 0, None
    for n, u, k, w in found:
        tokens, units, steps, total = tokens + n, units + u, max(steps, k), w if total is None else total + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (tokens, units, steps)), pa.array([total.tobytes()], pa.binary())], schema=SUM_SCHEMA)


def _sum(batches):
    yield from _summed((*row, np.frombuffer(w.as_buffer(), np.int64)) for b in batches for *row, w in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True))


def _train(shared):
    """Rows (shard, tokens) sorted by shard: the sum of the task's replicas, each by its tokens."""

    def replicas(batches):
        v, flat, steps = shared.value
        p = _shaped(flat, start_weights(v))
        shard, learner, seen, held, n = None, None, 0, [], 0

        def close():
            nonlocal seen, held, n
            if held:
                seen += learner.stretch(held)
                held, n = [], 0
            units = max(1, seen // TOKEN_GRAIN)
            return seen, units, learner.steps, np.rint(_flat(learner.p).astype(np.float64) * GRAIN).astype(np.int64) * units

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != shard:
                    if learner is not None:
                        yield close()
                    shard, learner, seen = own, Learner(v, p, steps), 0
                held.append(np.r_[np.frombuffer(raw.as_buffer(), np.uint16), np.uint16(v.end_input)])
                n += len(held[-1])
                if n >= STRETCH * WINDOW * LANES:
                    seen += learner.stretch(held)
                    held, n = [], 0
        if learner is not None:
            yield close()

    return lambda batches: _summed(replicas(batches))


def trained(spark, v: Vocabulary, encoded: DataFrame, total: int, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], int]:
    """The weights after all rounds over encoded (doc_id, tokens), the training documents, and the tokens that they saw; without any, those of the start."""
    like = start_weights(v)
    flat, steps, seen = _flat(like), 0, 0
    shards = max(1, -(-total // shard_tokens))
    spot = F.xxhash64("doc_id", "tokens")
    dealt = encoded.select(F.pmod(spot, F.lit(rounds)).alias("round"), F.pmod(F.xxhash64(spot, F.lit(5)), F.lit(shards)).alias("shard"), spot.alias("spot"), "tokens")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((v, flat, steps))
        rows = dealt.where(F.col("round") == k).repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "spot", "tokens").select("shard", "tokens")
        replicas = rows.mapInArrow(_train(shared), SUM_TYPE)
        sums = replicas.repartition(SUM_TASKS).mapInArrow(_sum, SUM_TYPE).toArrow()
        units = sum(sums.column("units").to_pylist())
        seen += sum(sums.column("tokens").to_pylist())
        if units:
            whole = sum(np.frombuffer(w.as_buffer(), np.int64) for w in sums.column("weights"))
            flat, steps = (whole / (units * GRAIN)).astype(np.float32), max(sums.column("steps").to_pylist())
        shared.unpersist()
    return _shaped(flat, like), seen


def document_scores(v: Vocabulary, p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability by the model of each document (its words' input numbers), without the words' shares of flat classes."""
    out = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    for at in range(0, len(order), SCORE_LANES):
        own = order[at : at + SCORE_LANES]
        lengths = np.array([len(docs[k]) + 1 for k in own])
        h = np.zeros((len(own), STATE), np.float32)
        last = np.full(len(own), v.end_input)  # input before the first word: the end's
        for t0 in range(0, int(lengths[0]), SCORE_WINDOW):
            span = min(SCORE_WINDOW, int(lengths[0]) - t0)
            active = [int(np.searchsorted(-lengths, -(t0 + t), "left")) for t in range(span)]  # lengths > t0 + t
            targets = np.full((span, active[0]), v.end_input)
            for lane in range(active[0]):
                part = docs[own[lane]][t0 : t0 + span]
                targets[: len(part), lane] = part
            inputs = np.concatenate([last[None, : active[0]], targets[:-1]])
            last[: active[0]] = targets[-1]
            x = p["x"][inputs]
            states = []
            for t, n in enumerate(active):
                # the state before the token has seen what came before it
                h[:n] = _gates(x[t, :n], h[:n], p["u"])[0]
                states.append(h[:n].copy())
            hs, target = np.concatenate(states), np.concatenate([targets[t, :n] for t, n in enumerate(active)])
            value = _log_chance(_classes(p, hs), v.input_class[target])
            inner = Inner(p, hs, v.input_row[target])
            value[inner.at] += _log_chance(inner.scores, v.input_slot[target[inner.at]])
            out[own] += np.bincount(np.concatenate([np.arange(n) for n in active]), value, len(own)) / np.log(10)
    return out


def _encode(shared):
    """A row for each document: its counts, the base's sum without the norm, the words' shares of flat classes, the words outside the table, its tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("flat", pa.float64()), ("others", pa.list_(pa.int64())), ("tokens", pa.binary())])

    def run(batches):
        v = shared.value
        end = v.look(np.array([END]))[0]
        end_weight = v.log_weight[end] if end >= 0 else np.log10(0.5)
        for batch in batches:
            parts = []
            for _, w in chunks(batch.column(2)):
                place = v.look(w.hashes)
                known = place >= 0
                inputs = np.full(len(place), v.rare_input, np.uint16)
                inputs[known] = v.input[place[known]]
                weight, flat = np.zeros(len(place)), np.zeros(len(place))
                weight[known], flat[known] = v.log_weight[place[known]], v.flat[place[known]]
                sums = [np.diff(np.r_[0, np.cumsum(x)][w.first]) for x in (known, weight, flat)]
                parts.append((np.diff(w.first), *sums, w.hashes[~known].view(np.int64), inputs))
            n, known, weight, flat, others, inputs = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
            tokens = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(2 * n)].astype(np.int32)), pa.py_buffer(inputs.astype(np.uint16).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n + 1, pa.int64()), pa.array(known + int(end >= 0), pa.int64()), pa.array(weight + end_weight, pa.float64()), pa.array(flat, pa.float64()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n - known)].astype(np.int32)), pa.array(others, pa.int64())), tokens], schema=schema)

    return run


def _score(shared):
    """The model's sum in the place of each row's last column, the tokens."""

    def run(batches):
        v, p = shared.value
        for batch in batches:
            docs = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(document_scores(v, p, docs))], names=[*batch.schema.names[:-1], "model"])

    return run


ROW = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, flat double, others array<bigint>"


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hint_col: str | None = "lang", vocabulary: int = VOCABULARY, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Training documents, all of which go through backpropagation, are those whose crc32 of the id as text, modulo 5, isn't
    1; a null id is one of them. Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased; every document ends with an end token.
    A null or empty text is the end alone. hint_col only groups words into classes; nulls are a group. Without training
    documents everything is unseen. Repeated rows are rows of their own. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    hint = F.xxhash64(hint_col) if hint_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), hint.alias("hint"))
    partial = rows.where(~F.col("held_out")).select("text", "hint").mapInArrow(_counter(), "word bigint, hint bigint, n bigint")
    by_hint = partial.groupBy("word", "hint").agg(F.sum("n").alias("n"))
    counts = written(by_hint.groupBy("word").agg(F.sum("n").alias("n"), F.max(F.struct("n", "hint"))["hint"].alias("hint")))
    got = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds")).first()
    # the least count with which the words of that count or more are no more than `vocabulary`
    cutoff = 1
    if got.kinds > vocabulary:
        high = counts.where("n > 1").agg(F.max("n")).first()[0] or 1
        low = 1
        while low < high:
            middle = (low + high) // 2
            if counts.where(F.col("n") >= middle).count() <= vocabulary:
                high = middle
            else:
                low = middle + 1
        cutoff = low
    frequent = counts.where((F.col("n") >= cutoff) | (F.col("word") == int(END.astype(np.int64)))).toArrow()
    v = Vocabulary(frequent.column("word").to_numpy().view(np.uint64), frequent.column("n").to_numpy(), frequent.column("hint").to_numpy(), got.total, got.kinds)
    shared = spark.sparkContext.broadcast(v)
    encoded = written(rows.select("doc_id", "held_out", "text").mapInArrow(_encode(shared), ROW + ", tokens binary").withColumn("row", F.monotonically_increasing_id()))
    shared.unpersist()
    lean = v.lean()
    p, seen = trained(spark, lean, encoded.where(~F.col("held_out")), int(got.total), shard_tokens, rounds)
    if seen != got.total:
        raise RuntimeError(f"{seen} of {got.total} training tokens were learned")
    both = spark.sparkContext.broadcast((lean, p))
    scored = written(encoded.select(*encoded.columns[:7], "row", "tokens").mapInArrow(_score(both), ROW + ", row bigint, model double"))
    drop(encoded)
    # words outside the table: their own counts, or unseen
    others = scored.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    seen = others.join(counts.select("word", "n"), "word", "left")
    rare_mass = float(v.log_mass[v.rare])
    weight = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    extra = seen.groupBy("row").agg(F.sum(F.col("times") * weight).alias("w"), F.sum("times").alias("t"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("known"))
    joined = scored.drop("others").join(extra, "row", "left").fillna({"w": 0.0, "t": 0, "known": 0})
    base = F.col("base") + F.col("w") - F.col("n_tokens") * float(v.norm)
    score = F.col("model") + F.col("flat") + F.col("w") - F.col("t") * rare_mass
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(int(got.total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
