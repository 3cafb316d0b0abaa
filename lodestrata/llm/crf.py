"""Linear-chain conditional random fields in NumPy, over many chains at once.

Tokens are numbered; chains are rows of a matrix of token numbers, sorted by falling length, with -1 after the last token.
"""

from __future__ import annotations

import numpy as np


class Field:
    """Weights of features by tag, and of transitions from tag to tag."""

    def __init__(self, features: int, tags: int):
        self.weights = np.zeros((features, tags), dtype=np.float32)
        self.moves = np.zeros((tags, tags), dtype=np.float32)


def chains(first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of the texts first[r]:first[r + 1], cut into chains of at most `most` tokens, longest first; and the number of the chain before each in its text, or -1."""
    sizes = np.diff(first)
    parts = -(-sizes // most)
    text = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[:-1][text] + number * most
    size = np.minimum(most, first[1:][text] - begin)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    before = np.where(number > 0, place[np.maximum(0, np.arange(len(text)) - 1)], -1)[order]
    begin, size = begin[order], size[order]
    width = int(size[0]) if len(size) else 0
    cells = begin[:, None] + np.arange(width)
    return np.where(np.arange(width) < size[:, None], cells, -1), before


def _live(rows: np.ndarray) -> list[int]:
    """How many chains are longer than each place."""
    length = (rows >= 0).sum(axis=1)
    return [int(np.searchsorted(-length, -t, side="left")) for t in range(rows.shape[1])]


def _ahead(likely: np.ndarray, step: np.ndarray, rows: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward messages at each place, and those at the end of each chain; start: what comes to its first token."""
    found, last = [], np.empty_like(start)
    live = [*_live(rows), 0]
    for t in range(rows.shape[1]):
        n = live[t]
        a = likely[rows[:n, t]] * (found[-1][:n] @ step if t else start)
        a /= a.sum(axis=1, keepdims=True)
        found.append(a)
        last[live[t + 1] : n] = a[live[t + 1] :]
    return found, last


def _behind(likely: np.ndarray, step: np.ndarray, rows: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Backward messages at each place, and what each chain sends to the token before its first; end: what comes to its last token."""
    found, live, behind = [], _live(rows), end[:0]
    for t in range(rows.shape[1] - 1, -1, -1):
        n = live[t]
        behind = np.concatenate([behind, end[len(behind) : n]])
        found.append(behind)
        behind = (likely[rows[:n, t]] * behind) @ step.T
        behind /= behind.sum(axis=1, keepdims=True)
    return found[::-1], behind


def _settled(sweep, rows: np.ndarray, message: np.ndarray, source: np.ndarray, carry) -> np.ndarray:
    """The messages that come to chains from those beside them in their texts. They are sent again while they change; a text's are
    exact after as many turns as it has chains, and mostly after two or three, as a field forgets."""
    active = np.arange(len(rows))
    sent = np.empty_like(message)
    while len(active):
        sent[active] = sweep(rows[active], message[active])[1]
        held = np.flatnonzero((source >= 0) & np.isin(source, active))
        new = carry(sent[source[held]])
        moved = np.abs(new - message[held]).max(axis=1, initial=0) > 1e-6
        message[held] = new
        active = held[moved]
    return message


def forward_backward(scores: np.ndarray, moves: np.ndarray, rows: np.ndarray, pairs: bool = False, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each token's tag probabilities, and the expected number of each move within chains if `pairs`; scores are by token and tag.

    before: the chain that each goes on from, or -1, where a text is cut into several; messages are carried over the cuts.
    """
    tags = moves.shape[0]
    marginal = np.full(scores.shape, 1 / tags, dtype=np.float32)
    expected = np.zeros((tags, tags))
    if not rows.size:
        return marginal, expected
    step = np.exp(moves)
    likely = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    start, end = np.ones((len(rows), tags), dtype=np.float32), np.ones((len(rows), tags), dtype=np.float32)
    if before is not None and (before >= 0).any():
        after = np.full(len(rows), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        scaled = lambda x: x / x.sum(axis=1, keepdims=True)
        start = _settled(lambda r, m: _ahead(likely, step, r, m), rows, start, before, lambda x: scaled(x @ step))
        end = _settled(lambda r, m: _behind(likely, step, r, m), rows, end, after, scaled)
    ahead, _ = _ahead(likely, step, rows, start)
    behind, _ = _behind(likely, step, rows, end)
    for t, (a, b) in enumerate(zip(ahead, behind)):
        n = len(a)
        both = a * b
        marginal[rows[:n, t]] = both / both.sum(axis=1, keepdims=True)
        if t and pairs:
            joint = ahead[t - 1][:n, :, None] * step[None] * (likely[rows[:n, t]] * b)[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal, expected


def viterbi(scores: np.ndarray, moves: np.ndarray, before: int, after: int) -> list[int]:
    """The best tags of one run of tokens between a token of tag `before` and one of tag `after`."""
    best, back = scores[0] + moves[before], []
    for t in range(1, len(scores)):
        step = best[:, None] + moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + scores[t]
    tags = [int((best + moves[:, after]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def token_scores(weights: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the weights of each token's features flat[first[k]:first[k + 1]]; every token has one at least."""
    return np.add.reduceat(weights[flat], first[:-1], axis=0) if len(first) > 1 else np.zeros((0, weights.shape[1]), dtype=np.float32)


def train(flat: np.ndarray, first: np.ndarray, tokens: np.ndarray, tags: np.ndarray, field: Field, rounds: int, size: int = 128, rate: float = 0.15, decay: float = 1e-4, seed: int = 0) -> Field:
    """Maximise the chains' likelihood by AdaGrad steps.

    tokens: chains x length of kinds of tokens, whose features are flat[first[k]:first[k + 1]]; tags: the same shape.
    """
    grown, moved = np.full(field.weights.shape, 1e-2, dtype=np.float32), np.full(field.moves.shape, 1e-2, dtype=np.float32)
    draw, n_tags = np.random.default_rng(seed), field.moves.shape[0]
    for _ in range(rounds):
        order = draw.permutation(len(tokens))
        for low in range(0, len(order), size):
            some = order[low : low + size]
            kinds, kind = np.unique(tokens[some], return_inverse=True)
            kind, tag = kind.reshape(-1), tags[some].reshape(-1)
            lengths = first[kinds + 1] - first[kinds]
            at = np.concatenate([[0], np.cumsum(lengths)])
            own = flat[np.repeat(first[kinds] - at[:-1], lengths) + np.arange(at[-1])]
            scores = token_scores(field.weights, own, at)[kind]
            rows = np.arange(len(kind)).reshape(len(some), -1)
            marginal, pair = forward_backward(scores, field.moves, rows, pairs=True)
            gap = -marginal
            gap[np.arange(len(tag)), tag] += 1
            by_kind = np.stack([np.bincount(kind, weights=gap[:, c], minlength=len(kinds)) for c in range(n_tags)], axis=1)
            features, place = np.unique(own, return_inverse=True)
            slope = np.stack([np.bincount(place, weights=np.repeat(by_kind[:, c], lengths), minlength=len(features)) for c in range(n_tags)], axis=1)
            slope = slope - decay * len(some) * field.weights[features]
            grown[features] += slope**2
            field.weights[features] += rate * slope / np.sqrt(grown[features])
            seen = np.zeros_like(pair)
            np.add.at(seen, (tags[some][:, :-1].reshape(-1), tags[some][:, 1:].reshape(-1)), 1)
            slope = seen - pair - decay * len(some) * field.moves
            moved += slope**2
            field.moves += rate * slope / np.sqrt(moved)
    return field
