"""Numpy kernels that run inside tasks: gradients of a batch and update passes over ordered rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: A hypothesis: features (n, d), weights (d), bias -> predictions (n). Its gradient is taken as
#: (prediction - target) * features, which holds for the two below with their usual losses.
Hypothesis = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def stable_sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def linear(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return x @ w + b


def logistic(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return stable_sigmoid(x @ w + b)


def gradient_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, predict: Hypothesis) -> np.ndarray:
    """[sum of e * x_j ..., sum of e, sum of e * e] with e = prediction - target."""
    e = predict(x, w, b) - y
    return np.concatenate([x.T @ e, [e.sum(), float(e @ e)]])


def batches_pass(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, predict: Hypothesis, batch: int, lr: float, penalty: float, regularise_bias: bool
) -> tuple[np.ndarray, float, float]:
    """Updates after each ``batch`` consecutive rows (the last may be short); batch 1 is one per row.

    ``penalty`` is lambda over the number of *all* training rows. Returns the parameters and the sum
    of squared residuals, each measured before the update it leads to.
    """
    w, squares = w.copy(), 0.0
    for at in range(0, len(y), batch):
        part = x[at : at + batch]
        e = predict(part, w, b) - y[at : at + batch]
        squares += float(e @ e)
        step = part.T @ e / len(e)
        shift = e.sum() / len(e)
        if penalty:
            step = step + penalty * w
            if regularise_bias:
                shift += penalty * b
        w -= lr * step
        b -= lr * float(shift)
    return w, b, squares


#: Rows of an SGD block: its inner products are one matrix product.
SGD_BLOCK = 32


_BACK = np.subtract.outer(np.arange(SGD_BLOCK), np.arange(SGD_BLOCK)) - 1
_STEPS = np.arange(SGD_BLOCK + 1.0)


def _block_terms(part: np.ndarray, lr: float, keep: float, keep_bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How the residual of each earlier row of a block pulls on a later output, and what k updates leave of weights and bias."""
    n = len(part)
    fade, fade_bias = (np.tril(np.ones((n, n)), -1) if k == 1.0 else np.where(_BACK >= 0, k ** np.maximum(_BACK, 0), 0.0)[:n, :n] for k in (keep, keep_bias))
    return lr * (fade * (part @ part.T) + fade_bias), keep**_STEPS, keep_bias**_STEPS


def row_by_row_pass(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, link: str, lr: float, penalty: float, regularise_bias: bool
) -> tuple[np.ndarray, float, float]:
    """What :func:`batches_pass` does with batches of one row, for the 'linear' and 'logistic' links.

    Linear: within a block the output of row i depends on earlier rows only through inner products,
    z_i = a^i x_i.w + c^i b - lr * sum over j < i of e_j (a^(i-1-j) x_i.x_j + c^(i-1-j)), where a and c
    are what an update leaves of the weights and the bias: one product, and a triangular system.
    Logistic: a short loop.
    """
    keep = 1.0 - lr * penalty
    keep_bias = keep if regularise_bias else 1.0
    squares = 0.0
    if link == "logistic":
        theta, fade = np.append(w, b), np.append(np.full(len(w), keep), keep_bias) if penalty else None
        for row, target in zip(np.column_stack([x, np.ones(len(y))]), y.tolist(), strict=True):
            e = 0.5 * (1.0 + math.tanh(0.5 * float(np.dot(row, theta)))) - target
            squares += e * e
            if fade is not None:
                theta *= fade
            theta -= (lr * e) * row
        return theta[:-1], float(theta[-1]), squares
    w = w.copy()
    for at in range(0, len(y), SGD_BLOCK):
        part, target = x[at : at + SGD_BLOCK], y[at : at + SGD_BLOCK]
        n = len(target)
        pull, left, left_bias = _block_terms(part, lr, keep, keep_bias)
        e = np.linalg.solve(np.eye(n) + pull, left[:n] * (part @ w) + left_bias[:n] * b - target)
        squares += float(e @ e)
        w = left[n] * w - lr * (part.T @ (left[n - 1 :: -1][:n] * e))
        b = left_bias[n] * b - lr * float((left_bias[n - 1 :: -1][:n]) @ e)
    return w, float(b), squares


def affine_start(d: int) -> tuple[np.ndarray, np.ndarray]:
    """The map that changes nothing, and no squares yet: see :func:`affine_pass`."""
    return np.eye(d + 1, d + 2), np.zeros((d + 2, d + 2))


def affine_pass(
    x: np.ndarray, y: np.ndarray, state: tuple[np.ndarray, np.ndarray], batch: int, lr: float, penalty: float, regularise_bias: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Composes the updates of a linear model over rows without knowing the parameters that they start from.

    An update is affine in t = [weights, bias, 1], so any run of updates is a (d + 1, d + 2) matrix Z with
    [weights, bias] = Z t, and its squared residuals sum to t' S t. Z and S of consecutive runs compose,
    so runs can be worked on side by side and the result is that of the sequential rule.
    """
    z, s = state
    if not len(y):
        return z, s
    d = x.shape[1]
    keep = 1.0 - lr * penalty
    keep_bias = keep if regularise_bias else 1.0
    if batch > 1:
        fade = np.append(np.full(d, keep), keep_bias)[:, None]
        rows = np.column_stack([x, np.ones(len(y))])
        for at in range(0, len(y), batch):
            part = rows[at : at + batch]
            e = part @ z
            e[:, -1] -= y[at : at + batch]
            s = s + e.T @ e
            z = fade * z - (lr / len(part)) * (part.T @ e)
        return z, s
    w, b = z[:d], z[d]
    for at in range(0, len(y), SGD_BLOCK):
        part = x[at : at + SGD_BLOCK]
        n = len(part)
        pull, left, left_bias = _block_terms(part, lr, keep, keep_bias)
        e = left[:n, None] * (part @ w) + left_bias[:n, None] * b
        e[:, -1] -= y[at : at + SGD_BLOCK]
        e = np.linalg.solve(np.eye(n) + pull, e)
        s = s + e.T @ e
        w = left[n] * w - lr * (part.T @ (left[n - 1 :: -1][:n, None] * e))
        b = left_bias[n] * b - lr * (left_bias[n - 1 :: -1][:n] @ e)
    return np.vstack([w, b]), s


def affine_compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the updates of ``first`` and then those of ``second`` do: see :func:`affine_pass`."""
    z, s = first
    reached = np.vstack([z, np.eye(1, z.shape[1], z.shape[1] - 1)])  # [weights, bias, 1] after the first
    return second[0] @ reached, s + reached.T @ second[1] @ reached


def _stream_plan(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each stream, longest stream first; the order of streams; streams still going at each step)."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    going = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    return starts, order, going


def logistic_streams_pass(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, lengths: np.ndarray, lr: float, penalty: float, regularise_bias: bool
) -> tuple[np.ndarray, float]:
    """One update per row in each of the consecutive streams, side by side.

    Returns the sum over streams of [weights, bias] times its rows, and the squared residuals.
    """
    starts, order, going = _stream_plan(lengths)
    rows = np.column_stack([x, np.ones(len(y))])
    copies = np.tile(np.append(w, b), (len(lengths), 1))
    fade = np.full(len(w) + 1, 1.0 - lr * penalty)
    if not regularise_bias:
        fade[-1] = 1.0
    squares = 0.0
    for step, k in enumerate(going.tolist()):
        at = starts[:k] + step
        part = rows[at]
        e = stable_sigmoid(np.einsum("ij,ij->i", part, copies[:k])) - y[at]
        squares += float(e @ e)
        if penalty:
            copies[:k] *= fade
        copies[:k] -= lr * e[:, None] * part
    return lengths[order] @ copies, squares


Layers = list[tuple[np.ndarray, np.ndarray]]


def glorot_layers(topology: tuple[int, ...], seed: int) -> Layers:
    """Weights (inputs, outputs) uniform in +-sqrt(6 / (inputs + outputs)), biases 0."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for n_in, n_out in zip(topology, topology[1:], strict=False):
        bound = np.sqrt(6.0 / (n_in + n_out))
        out.append((rng.uniform(-bound, bound, size=(n_in, n_out)), np.zeros(n_out)))
    return out


def network_forward(x: np.ndarray, layers: Layers) -> np.ndarray:
    for w, b in layers:
        x = stable_sigmoid(x @ w + b)
    return x[:, 0]


def _sigmoid_in_place(z: np.ndarray) -> None:
    z *= 0.5
    np.tanh(z, out=z)
    z += 1.0
    z *= 0.5


def network_pass(x: np.ndarray, y: np.ndarray, layers: Layers, lr: float) -> tuple[Layers, float]:
    """One back-propagation update per row, in the given order; gradients use the weights before it.

    What a row costs is calls, so there are few: biases are a last row of the weights, hidden layers keep half
    their weights (sigmoid(z) = (1 + tanh(z / 2)) / 2), and deltas carry the learning rate. With t = tanh(z / 2)
    the slope of a sigmoid is (1 - t * t) / 4, and halved weights move by half of a step.
    """
    halves = [np.vstack([w, b]) * 0.5 for w, b in layers[:-1]]
    sizes = [h.shape[1] for h in halves]
    tanhs, slopes, outputs = [np.empty(k) for k in sizes], [np.empty(k) for k in sizes], [np.ones(k + 1) for k in sizes]
    steps, columns = [np.empty_like(h) for h in halves], [a[:, None] for a in outputs]
    forward, top, squares = list(zip(halves, tanhs, [a[:-1] for a in outputs], outputs, strict=True)), len(halves) - 1, 0.0
    last = np.append(layers[-1][0][:, 0], layers[-1][1])
    for row, target in zip(np.column_stack([x, np.ones(len(y))]), y.tolist(), strict=True):
        below = row
        for half, t, a, whole in forward:
            np.dot(below, half, out=t)
            np.tanh(t, out=t)
            np.multiply(t, 0.5, out=a)
            a += 0.5
            below = whole
        e = 0.5 * (1.0 + math.tanh(0.5 * float(np.dot(below, last)))) - target
        squares += e * e
        delta = last[:-1] * (0.125 * lr * e)
        last -= (lr * e) * below
        for k in range(top, -1, -1):
            slope = slopes[k]
            np.multiply(tanhs[k], tanhs[k], out=slope)
            np.subtract(1.0, slope, out=slope)
            delta *= slope
            if k:
                passed = np.dot(halves[k][:-1], delta)
                passed *= 0.5
            np.multiply(columns[k - 1] if k else row[:, None], delta, out=steps[k])
            halves[k] -= steps[k]
            if k:
                delta = passed
    return [*((2.0 * h[:-1], 2.0 * h[-1]) for h in halves), (last[:-1, None].copy(), last[-1:].copy())], squares


# --- models side by side on one order of rows ---------------------------------------------------
#
# Unlike averaged streams these are exact: each model follows its own sequential rule, and the calls that a
# row costs are shared. ``x`` is (models, rows, features), each model's own view of the same rows (its
# scaling); ``mine`` (models, rows) tells which rows a model learns from.


def stacked_network_pass(x: np.ndarray, y: np.ndarray, mine: np.ndarray, layers: Layers, lr: float) -> np.ndarray:
    """What :func:`network_pass` does, for networks of one topology, in place. Returns their squared residuals.

    ``layers``: weights (models, inputs, outputs) and biases (models, outputs).
    """
    squares, lines = np.zeros(len(x)), [(w, b[:, None, :]) for w, b in layers]
    rows, learns = np.ascontiguousarray(x.transpose(1, 0, 2))[:, :, None, :], mine.T[:, :, None, None].astype(float)
    for row, target, known in zip(rows, y.tolist(), learns, strict=True):
        outputs = [row]
        for w, b in lines:
            out = np.matmul(outputs[-1], w)
            out += b
            _sigmoid_in_place(out)
            outputs.append(out)
        delta = (outputs[-1] - target) * known
        squares += delta[:, 0, 0] ** 2
        for k in range(len(lines) - 1, -1, -1):
            w, b = lines[k]
            below = outputs[k]
            if k:
                passed = np.matmul(delta, w.transpose(0, 2, 1))
                passed *= below
                passed *= 1.0 - below
            delta *= lr
            w -= below.transpose(0, 2, 1) * delta
            b -= delta
            if k:
                delta = passed
    return squares


#: Rows of a block whose residuals are solved for at once, and the change at which they have settled.
LOGISTIC_BLOCK, SETTLED = 32, 1e-15
_EARLIER = np.tril(np.ones((LOGISTIC_BLOCK, LOGISTIC_BLOCK)), -1)


def stacked_logistic_pass(x: np.ndarray, y: np.ndarray, mine: np.ndarray, flats: np.ndarray, lr: float) -> np.ndarray:
    """One update per row of logistic models, in place; ``flats``: (models, features + 1). Returns their squared residuals.

    Within a block the residuals solve e = sigmoid(first - pull e) - y, where ``pull`` reaches earlier rows
    only. So each time the equation is applied at least one more row is right for good, and after as many
    times as there are rows all are; in practice they settle much sooner.
    """
    squares = np.zeros(len(x))
    for at in range(0, x.shape[1], LOGISTIC_BLOCK):
        part, known = x[:, at : at + LOGISTIC_BLOCK], mine[:, at : at + LOGISTIC_BLOCK]
        n, target = part.shape[1], y[at : at + LOGISTIC_BLOCK]
        pull = (np.matmul(part, part.transpose(0, 2, 1)) + 1.0) * (lr * _EARLIER[:n, :n])
        first = np.matmul(part, flats[:, :-1, None])[:, :, 0] + flats[:, -1:]
        e = np.zeros(first.shape)
        for _ in range(n + 1):
            z = first - np.matmul(pull, e[:, :, None])[:, :, 0]
            _sigmoid_in_place(z)
            z -= target
            z *= known
            change, e = float(np.abs(z - e).max()), z
            if change <= SETTLED:
                break
        squares += (e * e).sum(axis=1)
        flats[:, :-1] -= lr * np.matmul(e[:, None, :], part)[:, 0]
        flats[:, -1] -= lr * e.sum(axis=1)
    return squares


def stack(models: list[Layers]) -> Layers:
    return [(np.stack([m[k][0] for m in models]), np.stack([m[k][1] for m in models])) for k in range(len(models[0]))]


def unstack(layers: Layers) -> list[Layers]:
    return [[(w[i].copy(), b[i].copy()) for w, b in layers] for i in range(len(layers[0][0]))]


def network_streams_pass(x: np.ndarray, y: np.ndarray, layers: Layers, lr: float, streams: int | np.ndarray) -> tuple[Layers, float]:
    """Copies of the network learn from consecutive shares of the rows side by side, one row each per step,
    and are averaged by rows at the end. ``streams``: their lengths, or a number of nearly equal shares.
    One stream is :func:`network_pass`."""
    if isinstance(streams, int):
        short, longer = divmod(len(y), max(1, min(streams, len(y))))
        streams = np.full(max(1, min(streams, len(y))), short) + (np.arange(max(1, min(streams, len(y)))) < longer)
    if len(streams) == 1:
        return network_pass(x, y, layers, lr)
    copies, order, squares = _network_copies_pass(x, y, layers, lr, streams)
    share = streams[order] / len(y)
    return [(np.tensordot(share, w, 1), share @ b) for w, b in copies], float(squares.sum())


def _network_copies_pass(x: np.ndarray, y: np.ndarray, layers: Layers, lr: float, lengths: np.ndarray) -> tuple[Layers, np.ndarray, np.ndarray]:
    """(layers of the copies, stacked; the streams that they have learned from; squared residuals of each)."""
    starts, order, going = _stream_plan(lengths)
    copies = [(np.repeat(w[None], len(lengths), axis=0), np.repeat(b[None], len(lengths), axis=0)) for w, b in layers]
    squares = np.zeros(len(lengths))
    for step, k in enumerate(going.tolist()):
        rows = starts[:k] + step
        outputs = [x[rows]]
        for w, b in copies:
            out = np.matmul(outputs[-1][:, None, :], w[:k])[:, 0]
            out += b[:k]
            _sigmoid_in_place(out)
            outputs.append(out)
        delta = outputs[-1] - y[rows][:, None]
        squares[:k] += delta[:, 0] ** 2
        for layer in range(len(copies) - 1, -1, -1):
            w, b = copies[layer]
            below = outputs[layer]
            passed = np.matmul(w[:k], delta[:, :, None])[:, :, 0] * below * (1.0 - below) if layer else None
            delta *= lr
            w[:k] -= below[:, :, None] * delta[:, None, :]
            b[:k] -= delta
            delta = passed
    return copies, order, squares


def network_stream_states(x: np.ndarray, y: np.ndarray, layers: Layers, lr: float, lengths: np.ndarray, together: bool) -> np.ndarray:
    """[flat layers, squared residuals] of each of the consecutive streams, in their order.

    ``together``: copies of the network learn side by side, which many streams need. Else one after the other, by
    :func:`network_pass`. The two differ in their last bits, and a stream's state is the same bits whichever others
    are here: so what decides is the number of all streams, never that of a task.
    """
    if together:
        copies, order, squares = _network_copies_pass(x, y, layers, lr, lengths)
        found = np.column_stack([part.reshape(len(lengths), -1) for w, b in copies for part in (w, b)] + [squares])
        return found[np.argsort(order)]
    found, at = [], 0
    for k in lengths.tolist():
        learned, squares = network_pass(x[at : at + k], y[at : at + k], layers, lr)
        found.append(np.append(flatten(learned), squares))
        at += k
    return np.stack(found)


def flatten(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for w, b in layers for part in (w, b)])


def unflatten(flat: np.ndarray, topology: tuple[int, ...]) -> Layers:
    out, at = [], 0
    for n_in, n_out in zip(topology, topology[1:], strict=False):
        w = flat[at : at + n_in * n_out].reshape(n_in, n_out).copy()
        at += n_in * n_out
        out.append((w, flat[at : at + n_out].copy()))
        at += n_out
    return out
