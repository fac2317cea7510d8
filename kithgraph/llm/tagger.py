"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and batched decoding."""

from __future__ import annotations

import multiprocessing
import unicodedata

import numpy as np

from kithgraph.llm import recurrent

_CHARS = "\n abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,:;!?'\"()[]{}<>@#&/+-_*|%$=~—–•"
OTHER, PAD = len(_CHARS), len(_CHARS) + 1
#: Letters and digits of scripts that have no Latin base letter: capitals, small letters, letters without case, digits.
CAPITAL, SMALL, UNCASED, DIGIT = range(len(_CHARS) + 2, len(_CHARS) + 6)
VOCABULARY = len(_CHARS) + 6
_CODE = {c: i for i, c in enumerate(_CHARS)}
_KNOWN = np.full(0x110000, -1, dtype=np.int16)
#: Whether a character is a letter or digit of a script that parts words by spaces; -1 where not asked yet.
_IN_WORD = np.full(0x110000, -1, dtype=np.int8)


def code(c: str) -> int:
    """The symbol of a character: accented letters count as their base letter, white space as a space."""
    base = _CODE.get(c)
    if base is None:
        base = _CODE.get(unicodedata.normalize("NFD", {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ı": "i", "ß": "s", "’": "'", "−": "-"}.get(c, c))[:1])
    if base is None:
        base = _CODE[" "] if c.isspace() else DIGIT if c.isdigit() else (CAPITAL if c.isupper() else SMALL if c.islower() else UNCASED) if c.isalpha() else OTHER
    return base


def _looked_up(text: str, known: np.ndarray, of) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = known[points]
    if out.size and out.min() < 0:
        for p in np.unique(points[out < 0]):
            known[p] = of(chr(p))
        out = known[points]
    return out


def symbols(text: str) -> np.ndarray:
    """The symbols of all characters of a text."""
    return _looked_up(text, _KNOWN, code)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols padded on the right, lengths)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(1, lengths.max(initial=1))), PAD, dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = symbols("".join(texts))
    return out, lengths


def inside_words(texts: list[str], width: int) -> np.ndarray:
    """(B, T): places whose character and the one before belong to one word of a script that parts words by spaces."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "".join(texts)
    letter = _looked_up(joined, _IN_WORD, lambda c: c.isalnum() and code(c) != UNCASED).astype(bool)
    out = np.zeros((len(texts), width), dtype=bool)
    out[np.arange(width) < lengths[:, None]] = letter
    out[:, 1:] &= out[:, :-1]
    out[:, 0] = False
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Parameters: per direction an input table (symbol to gates), recurrent weights; output weights; transitions."""

    def __init__(self, hidden: int, tags: int, seed: int = 0):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p, self._made = {}, {}
        for d in "fb":
            self.p[f"x{d}"] = f(VOCABULARY, 4 * hidden, scale=0.3)
            self.p[f"u{d}"] = f(hidden, 4 * hidden, scale=1 / np.sqrt(hidden))
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1.0  # the forget gate starts open
        self.p |= {"w": f(2 * hidden, tags, scale=1 / np.sqrt(hidden)), "b": np.zeros(tags, np.float32), "t": np.zeros((tags, tags), np.float32), "s": np.zeros(tags, np.float32)}

    def save(self, path: str) -> None:
        np.savez_compressed(path, hidden=self.hidden, tags=self.tags, **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str) -> "Tagger":
        z = np.load(path)
        m = cls(int(z["hidden"]), int(z["tags"]))
        m.p = {k: z[k].astype(np.float32) for k in m.p}
        return m

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States (T, B, H) of one direction over symbols (B, T); with `keep` also what backpropagation needs."""
        h_n, (b, t_n) = self.hidden, x.shape
        h, c = np.zeros((b, h_n), np.float32), np.zeros((b, h_n), np.float32)
        table, u = self.p[f"x{d}"], self.p[f"u{d}"]
        out = np.empty((t_n, b, h_n), np.float32)
        saved = []
        for t in range(t_n) if d == "f" else range(t_n - 1, -1, -1):
            z = table[x[:, t]]
            z += h @ u
            gates = _sigmoid(z[:, : 3 * h_n])
            i, f, o = gates[:, :h_n], gates[:, h_n : 2 * h_n], gates[:, 2 * h_n :]
            g = np.tanh(z[:, 3 * h_n :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                saved.append((t, i, f, o, g, tc, c, h))
            c = new * m
            h = o * tc * m
            out[t] = h
        return out, saved

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        """States (T, B, H) of one direction over symbols (T, B) read from the first row on; for tagging only.

        Gates lie apart in memory and every activation is a logistic function: with weights scaled beforehand,
        tanh(v) is 2 / (1 + exp(-2 v)) - 1.
        """
        h_n, (t_n, b) = self.hidden, x.shape
        scale = -np.array([1, 1, 1, 2], np.float32)[:, None, None]
        table = np.ascontiguousarray(self.p[f"x{d}"].reshape(-1, 4, h_n).transpose(1, 0, 2)) * scale
        u = np.ascontiguousarray(self.p[f"u{d}"].reshape(h_n, 4, h_n).transpose(1, 0, 2)) * scale
        z, zh = np.empty((4, b, h_n), np.float32), np.empty((4, b, h_n), np.float32)
        c, s, out = np.zeros((b, h_n), np.float32), np.empty((b, h_n), np.float32), np.empty((t_n, b, h_n), np.float32)
        h = np.zeros((b, h_n), np.float32)
        with np.errstate(over="ignore"):
            for t in range(t_n):
                np.take(table, x[t], axis=1, out=z, mode="clip")
                z += np.matmul(h, u, out=zh)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                g = z[3]
                g *= 2
                g -= 1
                c *= z[1]
                g *= z[0]
                c += g
                np.multiply(c, -2, out=s)
                np.exp(s, out=s)
                s += 1
                np.divide(2, s, out=s)
                s -= 1
                h = np.multiply(z[2], s, out=out[t])
        return out

    def _emitted(self, d: str, x: np.ndarray) -> np.ndarray:
        """(T, B, tags): what the states of one direction add to the emissions."""
        w = self.p["w"]
        weights = self.p[f"x{d}"], self.p[f"u{d}"], w[: self.hidden] if d == "f" else w[self.hidden :]
        made = self._made.get(d)
        if made is None or any(a is not b for a, b in zip(made[0], (*weights[:2], w))):  # training puts new arrays in their place
            made = self._made[d] = (*weights[:2], w), recurrent.emissions(*weights)
        return made[1](x) if made[1] else self._states(d, x) @ weights[2]

    def emissions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(T, B, tags) of symbols (B, T); what lies beyond a text's length means nothing."""
        b, t_n = x.shape
        x = np.ascontiguousarray(x.T)
        e = self._emitted("f", x)
        e += self.p["b"]
        turned = np.where((at := lengths - 1 - np.arange(t_n)[:, None]) >= 0, at, np.arange(t_n)[:, None])  # each text from its end
        turned = turned * b + np.arange(b)
        back = self._emitted("b", x.take(turned))
        e += back.reshape(t_n * b, -1).take(turned, axis=0)
        return e

    def spots(self, e: np.ndarray, lengths: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """(T, B): places where a tag other than 0 may win; at all others 0 certainly does.

        What a row of other tags gains over tag 0 is at most the sum of the gains of its places, each taken with the best
        way into it, less the way back unless the text ends; so a place is out if no row of places around it comes to
        nothing or more. Inside words rows neither begin nor end, and only the second tags go on.
        """
        t, s = self.p["t"] - self.p["t"][0, 0], self.p["s"] - self.p["s"][0]
        back, into = t[1:, 0].max(), t[1:].max(0)
        first, on, new = (np.full(e.shape[:2], -1e4, np.float32) for _ in range(3))
        for k in range(1, self.tags):
            over = e[:, :, k] - e[:, :, 0]
            np.maximum(first[0], over[0] + s[k], out=first[0])
            np.maximum(first[1:], over[1:] + t[0, k], out=first[1:])
            over += into[k]
            np.maximum(*((new, over) if k % 2 else (on, over)), out=new if k % 2 else on)
        if inside is not None:
            first[inside.T] = new[inside.T] = -1e4
        gain = np.maximum(on, new, out=on)
        total = np.cumsum(gain, axis=0, dtype=np.float64)
        least = np.minimum.accumulate(total - first, axis=0)
        total += back
        if inside is not None:
            total[:-1][inside.T[1:]] -= 1e4
        total[lengths - 1, np.arange(len(lengths))] -= back
        total[np.arange(len(e))[:, None] >= lengths] = -np.inf
        return np.maximum.accumulate(total[::-1], axis=0)[::-1] - least >= -0.01  # a little less than nothing, for rounding

    def silent(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Texts whose best tags are certainly all 0."""
        return ~self.spots(e, lengths).any(0)

    def stretches(self, e: np.ndarray, lengths: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """(number of the text, start, end) of the stretches that must be decoded: `spots` and the place before and after."""
        wide = np.zeros((len(lengths), len(e) + 2), bool)
        wide[:, 1:-1] = self.spots(e, lengths, inside).T
        near = wide.copy()
        near[:, 1:] |= wide[:, :-1]
        near[:, :-1] |= wide[:, 1:]
        near[:, 0] = near[:, -1] = False
        row, at = np.nonzero(near[:, 1:] != near[:, :-1])
        return np.stack([row[::2], at[::2], np.minimum(at[1::2], lengths[row[::2]])], axis=1)

    def cut(self, e: np.ndarray, lengths: np.ndarray, texts: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(number of the text, start, emissions, places inside words) of every stretch that may hold another tag than 0.

        Decoded alone it has the tags of one Viterbi pass over the whole text, as it ends with the text or with tag 0.
        """
        inside = inside_words(texts, len(e))
        out = []
        for row, start, end in self.stretches(e, lengths, inside).tolist():
            own = e[start:end, row].copy()
            if start:
                own[0, 1:] = -1e9
            if end < lengths[row]:
                own[-1, 1:] = -1e9
            out.append((row, start, own, inside[row, start:end]))
        return out

    def decode(self, stretches: list[tuple[np.ndarray, np.ndarray]], at_once: int = 768) -> list[np.ndarray]:
        """The best tags of (emissions, places inside words) of stretches."""
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i][0]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
        at = 0
        while at < len(order):
            part = order[at : at + at_once]
            part = part[: max(1, sum(len(stretches[i][0]) * (n + 1) <= 400_000 for n, i in enumerate(part)))]  # few at once if they are very long
            at += len(part)
            size = np.array([len(stretches[i][0]) for i in part])
            e, inside = np.zeros((size.max(), len(part), self.tags), np.float32), np.zeros((len(part), size.max()), bool)
            live = np.arange(size.max()) < size[:, None]
            e.transpose(1, 0, 2)[live] = np.concatenate([stretches[i][0] for i in part])
            inside[live] = np.concatenate([stretches[i][1] for i in part])
            for i, n, tags in zip(part, size, self.viterbi(e, size, inside)):
                out[i] = tags[:n]
        return out

    def viterbi(self, e: np.ndarray, lengths: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Best tags (B, T) of emissions (T, B, tags); the padding gets tag 0.

        At the places `inside` (B, T) words no piece may begin or end: the tag before goes on.
        """
        t_n, b, k = e.shape
        t0, rows = self.p["t"], np.arange(b)
        e = np.ascontiguousarray(e.transpose(0, 2, 1))  # texts lie side by side, so that every maximum is taken over whole rows
        scores = np.empty((t_n, k, b), np.result_type(e, t0))
        scores[0] = e[0] + self.p["s"][:, None]
        to, tag = t0[:, :, None], np.arange(k)
        goes_on = (tag[:, None] == tag) & ((tag == 0) | (tag % 2 == 0)) | ((tag[None, :] > 0) & (tag[None, :] % 2 == 0) & (tag[:, None] == tag[None, :] - 1))
        held = np.where(goes_on, t0, -1e4).astype(np.float32)
        stay, enter = held.diagonal()[:, None], np.r_[np.float32(-1e4), held.diagonal(1)][:, None]

        for t in range(1, t_n):
            score = scores[t - 1]
            if inside is None:
                scores[t] = (score[:, None] + to).max(0) + e[t]
                continue
            free = np.flatnonzero(~inside[:, t])
            best = score + stay  # inside a word only these two tags lead on, or any at the price of breaking the word
            np.maximum(best[1:], score[:-1] + enter[1:], out=best[1:])
            np.maximum(best, score.max(0) - np.float32(1e4), out=best)
            if len(free):
                best[:, free] = (np.take(score, free, axis=1)[:, None] + to).max(0)
            np.add(best, e[t], out=scores[t])
        tags = np.zeros((b, t_n), np.int64)
        steps, word = np.hstack([t0, held]), np.zeros((t_n, b), np.int64) if inside is None else inside.T * np.int64(k)
        at = scores[lengths - 1, :, rows].argmax(1)
        for t in range(t_n - 1, -1, -1):  # the tag before is looked up for the best path only
            live = lengths > t
            tags[live, t] = at[live]
            if t:
                step = steps.take(at + word[t], axis=1)
                step += scores[t - 1]
                at = np.where(live, step.argmax(0), at)
        return tags

    def loss_and_gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray):
        """Mean negative log likelihood of the tags per sequence, and its gradients."""
        t_n, b, k = x.shape[1], len(x), self.tags
        live = np.arange(t_n)[:, None] < lengths
        mask = live.T.astype(np.float32)
        hf, sf = self._run("f", x, mask, True)
        hb, sb = self._run("b", x, mask, True)
        h = np.concatenate([hf, hb], axis=2)
        e = (h @ self.p["w"] + self.p["b"]).astype(np.float64)
        trans, start = self.p["t"].astype(np.float64), self.p["s"].astype(np.float64)
        # forward and backward sums of the chain in scaled probabilities; beyond a text's end they are carried on
        top = e.max(2)
        w = np.exp(e - top[:, :, None])
        step = np.exp(trans - trans.max())
        alpha, beta, scale = np.empty((t_n, b, k)), np.ones((t_n, b, k)), np.ones((t_n, b))
        first = w[0] * np.exp(start - start.max())
        scale[0] = first.sum(1)
        alpha[0] = first / scale[0][:, None]
        for t in range(1, t_n):
            new = (alpha[t - 1] @ step) * w[t]
            scale[t] = np.where(live[t], new.sum(1), 1.0)
            alpha[t] = np.where(live[t][:, None], new / scale[t][:, None], alpha[t - 1])
        pairs = np.zeros((k, k))
        for t in range(t_n - 1, 0, -1):
            inner = np.where(live[t][:, None], w[t] * beta[t] / scale[t][:, None], 0.0)
            beta[t - 1] = np.where(live[t][:, None], inner @ step.T, beta[t])
            pairs += alpha[t - 1].T @ inner
        g_t = pairs * step
        z = (np.log(scale) + np.where(live, top, 0.0)).sum(0) + start.max() + trans.max() * (lengths - 1)
        g_e = alpha * beta * live[:, :, None]
        tag = y.T
        g_s = g_e[0].sum(0)
        np.subtract.at(g_s, tag[0], 1)
        gold = start[tag[0]] + np.where(live, np.take_along_axis(e, tag[:, :, None], 2)[:, :, 0], 0.0).sum(0) + np.where(live[1:], trans[tag[:-1], tag[1:]], 0.0).sum(0)
        np.subtract.at(g_t, (tag[:-1][live[1:]], tag[1:][live[1:]]), 1)
        at_t, at_b = np.nonzero(live)
        g_e[at_t, at_b, tag[at_t, at_b]] -= 1
        loss = float((z - gold).mean())
        g_e = (g_e / b).astype(np.float32)
        grads = {"t": (g_t / b).astype(np.float32), "s": (g_s / b).astype(np.float32)}
        flat = g_e.reshape(-1, k)
        grads["w"], grads["b"] = h.reshape(-1, h.shape[2]).T @ flat, flat.sum(0)
        g_h = g_e @ self.p["w"].T
        n = self.hidden
        seen = np.zeros((t_n * b, VOCABULARY), np.float32)
        seen[np.arange(t_n * b), x.T.ravel()] = 1
        for d, saved, part in (("f", sf, g_h[:, :, :n]), ("b", sb, g_h[:, :, n:])):
            u = self.p[f"u{d}"]
            dzs, before = np.zeros((t_n, b, 4 * n), np.float32), np.zeros((t_n, b, n), np.float32)
            dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for t, i, f, o, g, tc, c, hp in reversed(saved):
                m = mask[:, t : t + 1]
                dh = (dh + part[t]) * m
                dc = dc * m
                do = dh * tc
                dc = dc + dh * o * (1 - tc * tc)
                dz = dzs[t]
                dz[:, :n] = dc * g * i * (1 - i)
                dz[:, n : 2 * n] = dc * c * f * (1 - f)
                dz[:, 2 * n : 3 * n] = do * o * (1 - o)
                dz[:, 3 * n :] = dc * i * (1 - g * g)
                before[t] = hp
                dh = dz @ u.T
                dc = dc * f
            flat = dzs.reshape(-1, 4 * n)
            grads[f"x{d}"], grads[f"u{d}"] = seen.T @ flat, before.reshape(-1, n).T @ flat
        return loss, grads

    def fit(self, batches, rate: float = 0.004, report=None, workers: int = 1) -> None:
        """Adam over an iterable of (symbols, lengths, tags, share of the schedule done); a batch is shared out to `workers` processes."""
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
        for step, (x, lengths, y, done) in enumerate(batches, 1):
            if pool:
                cuts = [(self.p, self.hidden, self.tags, x[i::workers], lengths[i::workers], y[i::workers]) for i in range(workers)]
                parts = pool.map(_part, cuts, chunksize=1)
                loss, grads = sum(a for a, _ in parts) / workers, {k: sum(g[k] for _, g in parts) / workers for k in self.p}
            else:
                loss, grads = self.loss_and_gradients(x, lengths, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            lr = rate * (1 - 0.95 * done)
            for k, g in grads.items():
                g = g * clip
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                self.p[k] = self.p[k] - (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if report:
                report(step, loss)
        if pool:
            pool.terminate()


def _part(task):
    """Loss and gradients of one share of a batch, in a worker process."""
    params, hidden, tags, x, lengths, y = task
    model = Tagger.__new__(Tagger)
    model.p, model.hidden, model.tags = params, hidden, tags
    width = int(lengths.max())
    return model.loss_and_gradients(x[:, :width], lengths, y[:, :width])
