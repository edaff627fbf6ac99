"""A character-level bidirectional LSTM with CRF transitions in numpy: training by back-propagation, batched decoding.

Gates are squashed by a clipped line, as tanh costs more than all else of a step; candidates and cells keep tanh.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
#: 0 is outside; 1 + 2k begins kind k and 2 + 2k continues it.
TAGS = 1 + 2 * len(KINDS)
PAD = 0
VOCABULARY = 1024


def _classes() -> np.ndarray:
    """Class of each character of the first plane: letters of small alphabets stand for themselves, large scripts are one class each."""
    table = np.full(65536, 1, np.int32)
    table[:128] = np.arange(128) + 8
    for first, last, at in ((0x0410, 0x0460, 140), (0x0600, 0x0700, 224), (0x0900, 0x0980, 480)):
        table[first:last] = np.arange(last - first) + at
    for c in range(0x00C0, 0x0250):
        table[c] = 2 if chr(c).isupper() else 3
    for first, last, at in ((0x0E00, 0x0E80, 4), (0x3040, 0x3100, 5), (0x3400, 0xA000, 6), (0x2000, 0x2070, 7)):
        table[first:last] = at
    table[ord("＠")] = ord("@") + 8
    for c in (0x00A0, 0x2002, 0x2003, 0x2009, 0x202F, 0x3000):
        table[c] = ord(" ") + 8
    table[ord("\n")] = table[ord("\t")] = ord(" ") + 8
    return table


CLASS = _classes()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASS[np.minimum(points, 65535)]


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """start, end, kind number of each tagged span."""
    out = []
    at = np.flatnonzero(tags)
    if not len(at):
        return out
    kind = (tags - 1) // 2
    start = prev = int(at[0])
    for i in at[1:].tolist():
        if i != prev + 1 or kind[i] != kind[start] or tags[i] % 2 == 1:
            out.append((start, prev + 1, int(kind[start])))
            start = i
        prev = i
    out.append((start, prev + 1, int(kind[start])))
    return out


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


#: Transitions that no tagging has: continuing what hasn't begun.
FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    for _i in range(TAGS):
        if _i not in (1 + 2 * _k, 2 + 2 * _k):
            FORBIDDEN[_i, 2 + 2 * _k] = -1e4


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def gate_slope(y: np.ndarray) -> np.ndarray:
    """Slope of a gate by its value; a little is left outside the line so that a closed gate can learn to open."""
    return np.where((y > 0) & (y < 1), 0.25, 0.02).astype(np.float32)


class Tagger:
    """Parameters: E embedding; per direction W (from embedding), U (recurrent), b; V, c output; T transitions, S start."""

    def __init__(self, hidden: int = 24, embed: int = 16, seed: int = 7, params: dict[str, np.ndarray] | None = None) -> None:
        if params is None:
            r = np.random.default_rng(seed)
            init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
            params = {"E": (r.standard_normal((VOCABULARY, embed)) * 0.3).astype(np.float32), "V": init(2 * hidden, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
            for d in "fb":
                b = np.zeros(4 * hidden, np.float32)
                b[hidden : 2 * hidden] = 1.0
                params |= {f"W{d}": init(embed, 4 * hidden), f"U{d}": init(hidden, 4 * hidden), f"b{d}": b}
            params["c"][0] = 2.0
        self.p = params
        self.h = params["Uf"].shape[0]

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16 if k == "E" else np.float32) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as held:
            return cls(params={k: held[k].astype(np.float32) for k in held.files})

    # ---- inference

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, TAGS, rows) scores of padded rows (rows, time); rows come longest first."""
        n, steps = ids.shape
        h = self.h
        cols = np.ascontiguousarray(ids.T)
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than t
        out = np.empty((steps, TAGS, n), np.float32)
        out[:] = self.p["c"][:, None]
        room, met, squashed = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32), np.empty((n, h), np.float32)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
            table[:, : 3 * h] = 0.25 * table[:, : 3 * h] + 0.5
            u = self.p[f"U{d}"].copy()
            u[:, : 3 * h] *= 0.25
            v = np.ascontiguousarray((self.p["V"][:h] if d == "f" else self.p["V"][h:]).T)
            hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in order:
                m = int(live[t])
                z, tc, own = room[:m], squashed[:m], hid[:m]
                np.matmul(own, u, out=z)
                z += np.take(table, cols[t, :m], axis=0, out=met[:m], mode="clip")
                np.clip(z[:, : 3 * h], 0, 1, out=z[:, : 3 * h])
                np.tanh(z[:, 3 * h :], out=z[:, 3 * h :])
                c = cell[:m]
                c *= z[:, h : 2 * h]
                np.multiply(z[:, :h], z[:, 3 * h :], out=tc)
                c += tc
                np.tanh(c, out=tc)
                np.multiply(z[:, 2 * h : 3 * h], tc, out=own)
                out[t, :, :m] += v @ own.T
        return out

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tags of each row (Viterbi); rows come longest first.

        Only best scores are kept on the way; the way back finds each step's source again for the one tag on the path.
        Outside and beginnings have every tag as source, a continuation only its own kind's two.
        """
        steps, _, n = emissions.shape
        trans = (self.p["T"] + FORBIDDEN).astype(np.float32)
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")
        best = np.empty((steps, TAGS, n), np.float32)
        best[0] = emissions[0] + (self.p["S"] + FORBIDDEN[0])[:, None]
        begins, goes_on = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        open_to = [(x, trans[:, x][:, None]) for x in (0, *begins.tolist())]
        from_begin, from_on = trans[begins, goes_on][:, None], trans[goes_on, goes_on][:, None]
        sums, on = np.empty((TAGS, n), np.float32), np.empty((len(begins), n), np.float32)
        for t in range(1, steps):
            m = int(live[t])
            before, now = best[t - 1][:, :m], best[t]
            for x, way in open_to:
                np.add(before, way, out=sums[:, :m])
                np.max(sums[:, :m], axis=0, out=now[x, :m])
            np.add(before[1::2], from_begin, out=on[:, :m])
            np.maximum(on[:, :m], before[2::2] + from_on, out=now[2::2, :m])
            now[:, :m] += emissions[t, :, :m]
        tags = np.zeros((steps, n), np.int8)
        current = np.zeros(n, np.int64)
        for t in range(steps - 1, -1, -1):
            m, after = int(live[t]), int(live[t + 1]) if t + 1 < steps else 0
            if after:
                current[:after] = (best[t][:, :after] + trans[:, current[:after]]).argmax(0)
            if after < m:
                current[after:m] = best[t][:, after:m].argmax(0)
            tags[t, :m] = current[:m]
        return [tags[: lengths[i], i] for i in range(n)]

    # ---- training

    def loss_and_grads(self, ids: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per row and its gradients; all rows are padded to one length (mask 0)."""
        p, h = self.p, self.h
        n, steps = ids.shape
        x = p["E"][ids]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        states, kept = {}, {}
        for d in "fb":
            seq = range(steps) if d == "f" else range(steps - 1, -1, -1)
            wx = x @ p[f"W{d}"] + p[f"b{d}"]
            hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            hs = np.zeros((steps, n, h), np.float32)
            memo = []
            for t in seq:
                z = wx[:, t] + hid @ p[f"U{d}"]
                i, f, o, g = gate(z[:, :h]), gate(z[:, h : 2 * h]), gate(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
                m = mask[:, t, None]
                new = f * cell + i * g
                tc = np.tanh(new)
                memo.append((t, i, f, o, g, cell, tc, hid, m))
                cell = new * m
                hid = o * tc * m
                hs[t] = hid
            states[d], kept[d] = hs, memo
        both = np.concatenate([states["f"], states["b"]], axis=2)
        em = both @ p["V"] + p["c"]
        trans = p["T"] + FORBIDDEN
        # forward and backward sums
        alpha = np.zeros((steps, n, TAGS), np.float64)
        alpha[0] = em[0] + p["S"] + FORBIDDEN[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + trans
            top = s.max(1)
            new = np.log(np.exp(s - top[:, None]).sum(1)) + top + em[t]
            alpha[t] = np.where(mask[:, t, None] > 0, new, alpha[t - 1])
        top = alpha[-1].max(1)
        log_z = np.log(np.exp(alpha[-1] - top[:, None]).sum(1)) + top
        beta = np.zeros((steps, n, TAGS), np.float64)
        g_em = np.zeros((steps, n, TAGS), np.float32)
        g_t = np.zeros((TAGS, TAGS))
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            m = mask[:, t]
            g_em[t] = np.exp(alpha[t] + beta[t] - log_z[:, None]) * m[:, None]
            g_em[t, rows, tags[:, t]] -= m
            if t:
                s = trans + (em[t] + beta[t])[:, None, :]
                joint = np.exp(alpha[t - 1][:, :, None] + s - log_z[:, None, None]) * m[:, None, None]
                g_t += joint.sum(0)
                np.add.at(g_t, (tags[:, t - 1], tags[:, t]), -m)
                top = s.max(2)
                prev = np.log(np.exp(s - top[:, :, None]).sum(2)) + top
                beta[t - 1] = np.where(m[:, None] > 0, prev, beta[t])
        gold = (em[np.arange(steps)[:, None], rows[None], tags.T] * mask.T).sum(0) + p["S"][tags[:, 0]]
        gold = gold + (trans[tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum(1)
        loss = float((log_z - gold).mean())
        g_em /= n
        grads["T"] = np.where(FORBIDDEN < 0, 0, g_t / n).astype(np.float32)
        grads["S"] = g_em[0].sum(0)
        grads["c"] = g_em.sum((0, 1))
        grads["V"] = np.tensordot(both, g_em, ((0, 1), (0, 1)))
        g_both = g_em @ p["V"].T
        g_x = np.zeros_like(x)
        for d in "fb":
            g_h = g_both[:, :, :h] if d == "f" else g_both[:, :, h:]
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            g_z = np.zeros((n, steps, 4 * h), np.float32)
            u = p[f"U{d}"]
            for t, i, f, o, g, before, tc, hid_before, m in reversed(kept[d]):
                dh_t = (dh + g_h[t]) * m
                dc_t = dc * m + dh_t * o * (1 - tc * tc)
                z = g_z[:, t]
                z[:, :h] = dc_t * g * gate_slope(i)
                z[:, h : 2 * h] = dc_t * before * gate_slope(f)
                z[:, 2 * h : 3 * h] = dh_t * tc * gate_slope(o)
                z[:, 3 * h :] = dc_t * i * (1 - g * g)
                grads[f"U{d}"] += hid_before.T @ z
                dh = z @ u.T
                dc = dc_t * f
            grads[f"b{d}"] = g_z.sum((0, 1))
            grads[f"W{d}"] = np.tensordot(x, g_z, ((0, 1), (0, 1)))
            g_x += g_z @ p[f"W{d}"].T
        np.add.at(grads["E"], ids, g_x)
        return loss, grads

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 3, told=print) -> None:
        """Adam on (classes, tags) rows; rows of similar length share a batch."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(rows) // batch)
        for epoch in range(epochs):
            order = sorted(range(len(rows)), key=lambda i: len(rows[i][0]) + r.random() * 20)
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            r.shuffle(batches)
            loss_sum = 0.0
            for own in batches:
                longest = max(len(rows[i][0]) for i in own)
                ids, tags, mask = np.zeros((len(own), longest), np.int32), np.zeros((len(own), longest), np.int64), np.zeros((len(own), longest), np.float32)
                for k, i in enumerate(own):
                    n = len(rows[i][0])
                    ids[k, :n], tags[k, :n], mask[k, :n] = rows[i][0], rows[i][1], 1
                loss, grads = self.loss_and_grads(ids, tags, mask)
                loss_sum += loss
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                lr = rate * (1 - 0.95 * step / total)
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            told(f"epoch {epoch}: {loss_sum / len(batches):.3f}")
