"""Language-model scoring by logistic mixing of hashed-context bit predictors.

Texts are lower-cased (A-Z) and read as tokens, words and then one end. A word is
spelled byte by byte and closed by a blank, the end is a word without bytes; each
byte is eight binary decisions. For every decision, contexts (the state alone,
the last 1, 2, 3, 4 bytes, the second in this state, the third after the kind of the
word before, the word so far, that after the kind, that in the state) each point to a hashed slot
with counts of zeros and ones. Their logits are added with weights gated by the
place in the word, the bit and each count's confidence; a table indexed by the
gate and the sum refines the result. Weights and that table are learned online, a
few hundred words a step, each without the occurrence that it predicts.

The state reaches over all earlier words of the text: the label (such as a
language) for which most of them speak, or none. Which words speak for a label is
fitted on a bounded sample; the label of a text is never read when it is scored.

One more predictor looks back over two words, at places that the content chooses,
one in RUN: where these were always followed by one and the same run of tokens, up
to the next such place, in the other training documents, a decision tells whether
it comes again, at a probability that adapts within the text. If it comes, nothing
of it is left to spell. The score is the product of all these decisions.

A token's spelling depends on its state, its predecessor's kind and the word:
counting, learning and scoring see each distinct such unit once, with its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm import common, language

#: Most of the slots of each context, as log2: state, 1 byte, state and 2 bytes, kind and 3 bytes, 4 bytes, word so far, that after a kind, that in a state.
MOST_SLOTS = (12, 16, 20, 20, 22, 22, 22, 22)
ORDERS, WORD = len(MOST_SLOTS), 7
#: Contexts of bytes count each unit once, as what they foretell is a word that is new; from this order on tokens are counted.
BY_TOKEN = 5
CONFIDENCE = 12
#: The gate: the place in the word, the confidence of the word so far in its state, the bit.
PLACES = 5
GATES = PLACES * CONFIDENCE * 8
#: Weights to begin with, by order.
BEGIN = (0.02, 0.02, 0.1, 0.1, 0.15, 0.15, 0.15, 0.4)
CELLS = 33
RANGES = 64
#: A key is a state, the kind of the token before, and a word's bytes; of so many bytes at most, longer words come in pieces.
HEAD, LONG = 4, 256
#: One in so many pairs of words opens a run of tokens; a power of two.
RUN = 8
#: How often a foreseen run came and failed to come, before a text is read: after one that came, and else.
FORESEEN = {True: (1.8, 0.2), False: (0.2, 1.8)}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)
_PLACES = np.random.default_rng(6).integers(1, 1 << 63, LONG + 1).astype(np.uint64) | np.uint64(1)


def _kinds() -> list[bytes]:
    """Digits and letters, the latter for all of beyond ASCII too, have a kind; any sign is one of its own."""
    return [b"D" if 48 <= i <= 57 else bytes([i]) if 32 < i < 127 and not chr(i).isalpha() else b"W" for i in range(256)]


#: The kind of a token, by its last byte; kinds by number, that before the first token first; the number of a last byte's kind.
KINDS, START = _kinds(), b"B"
_KINDS = [START, *sorted(set(KINDS))]
_KIND = np.array([_KINDS.index(k) for k in KINDS], np.int64)


def state_bytes(state: int) -> bytes:
    return bytes([48 + (state >> 12 & 63), 48 + (state >> 6 & 63), 48 + (state & 63)])


@dataclass
class Tokens:
    """The tokens of several texts: distinct words, of each token the word, the text and its kind of predecessor; where texts start, and the end."""

    words: list[bytes]
    word: np.ndarray
    kind: np.ndarray
    text: np.ndarray
    starts: np.ndarray

    def states(self, voters: dict[bytes, int]) -> np.ndarray:
        """For each token the label of most voters before it in its text, the smaller of equals; 0 where none spoke yet."""
        votes = np.array([voters.get(w, 0) for w in self.words], np.int64).take(self.word)
        best, state = np.zeros(len(votes), np.int64), np.zeros(len(votes), np.int64)
        for c in np.unique(votes[votes > 0]).tolist():
            said = np.concatenate([[0], np.cumsum(votes == c)])
            number = said[:-1] - said[self.starts[:-1]].take(self.text)
            more = number > best
            best[more], state[more] = number[more], c
        return state

    def units(self, states: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The distinct keys, and of each token the place of its key there."""
        heads, head = np.unique(states * len(_KINDS) + self.kind, return_inverse=True)
        each = head * len(self.words) + self.word
        order = np.argsort(each, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = each[order[1:]] != each[order[:-1]]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        head, word = np.divmod(each[order[new]], len(self.words))
        named, words = [state_bytes(h // len(_KINDS)) + _KINDS[h % len(_KINDS)] for h in heads.tolist()], self.words
        return [named[h] + words[w] for h, w in zip(head.tolist(), word.tolist())], at

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of tokens that parts of the content itself open: (first token, hash of the two words before it, hash of the run).

        A run begins after two words of its text whose hash is one in RUN, and
        ends before the next run or with the text. Hashes of words before are
        odd; the last 20 bits of a run's hash are used.
        """
        mine = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64).take(self.word)
        h = np.zeros(len(mine), np.uint64)
        h[2:] = _stirred(mine[:-2] * _POWER + mine[1:-1] * _MIX)
        far = np.arange(len(h)) - self.starts[:-1].take(self.text) >= 2
        first = np.flatnonzero(far & (h >> np.uint64(20) & np.uint64(RUN - 1) == 0))
        opens = np.zeros(len(h), np.int64)
        opens[first] = 1
        run = np.cumsum(opens) - 1  # of each token; those before a text's first run are left out
        inside = run >= 0
        inside[inside] &= self.text[first].take(run[inside]) == self.text[inside]
        after = np.where(inside, np.arange(len(h)) - (first.take(run) if len(first) else 0), 0)
        stirred = np.where(inside, _stirred(mine + after.astype(np.uint64) * _MIX), np.uint64(0))
        total = np.concatenate([[np.uint64(0)], np.cumsum(stirred, dtype=np.uint64)])
        end = np.append(first[1:], len(h))
        return first, h[first] | np.uint64(1), _stirred(total[end] - total[first])


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _POWER
    return h ^ h >> np.uint64(29)


def tokens(texts: pa.Array) -> Tokens:
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = split.values, pc.list_value_length(split).to_numpy()  # no nulls, no offset: just computed
    text, there = np.repeat(np.arange(len(sizes)), sizes), pc.greater(pc.binary_length(words), 0)
    coded, text = words.filter(there).dictionary_encode(), text[there.to_numpy(zero_copy_only=False)]
    order = pc.array_sort_indices(coded.dictionary)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(order)), " ")  # words hold no blank
    words = [b"", *(whole[0].as_py().encode("utf-8", "surrogatepass").split(b" ") if len(order) else [])]  # the end comes first
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(words))
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)) + 1)])
    word = np.zeros(starts[-1], np.int64)
    word[np.arange(len(text)) + text] = rank.take(coded.indices.to_numpy())
    kind = np.roll(_KIND[[w[-1] if w else 0 for w in words]].take(word), 1)
    kind[starts[:-1]] = 0
    return Tokens(words, word, kind, np.repeat(np.arange(len(sizes)), np.diff(starts)), starts)


_CODE = np.minimum(255, np.round(8 * np.log2(1 + np.arange(1 << 16)))).astype(np.uint8)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes on a scale of logarithms."""
    return np.where(counts < len(_CODE), _CODE[np.minimum(counts, len(_CODE) - 1)], np.minimum(255, np.round(8 * np.log2(1.0 + counts)))).astype(np.uint8)


_COUNT = np.exp2(np.arange(256) / 8) - 1
#: A history, the two counts of a slot on a coarse scale, has a number; so many there are.
_STEPS = np.array([0.5, 1.5, 2.5, 3.5, 5.5, 8.5, 13.5, 22.5, 40.5, 80.5, 160.5, 400.5, 1200.5, 5000.5, 30000.5])
HISTORIES = (len(_STEPS) + 1) ** 2
MAPS = 2 * HISTORIES


def _history(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_STEPS, zeros) * (len(_STEPS) + 1) + np.searchsorted(_STEPS, ones)).astype(np.int64)


def _class(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """How sure a count is."""
    return np.minimum(CONFIDENCE - 1, np.log2(1 + zeros + ones)).astype(np.int64)


#: By a slot's two bytes, zeros first: its history, and from bit 10 on its class; then the same without one occurrence of a zero, and without one of a one.
_Z, _O = np.broadcast_arrays(_COUNT[None, :], _COUNT[:, None])
_SLOT = (_history(_Z, _O) | _class(_Z, _O) << 10).astype(np.int16).ravel()
_LEFT = np.concatenate([(_history(z, o) | _class(z, o) << 10).astype(np.int16).ravel() for z, o in ((np.maximum(0, _Z - 1), _O), (_Z, np.maximum(0, _O - 1)))])


def first_seen() -> np.ndarray:
    """(2, maps): the zeros and ones after each history that a map begins with, few of them; once for new words so far and once for known ones."""
    middle = np.concatenate([[0.0], np.sqrt(np.maximum(1, _STEPS[:-1]) * _STEPS[1:]), [60000.0]])
    ones = (np.tile(middle, len(middle)) + 0.2) / (np.repeat(middle, len(middle)) + np.tile(middle, len(middle)) + 0.4)
    return np.tile(2 * np.stack([1 - ones, ones]), 2)


def logits(seen: np.ndarray) -> np.ndarray:
    """(orders, maps) from what was seen (2, orders, maps)."""
    return np.log((seen[1] + 1e-3) / (seen[0] + 1e-3)).astype(np.float32)


@dataclass
class Decisions:
    """The decisions of several keys: slots of each order, bits, place and bit as a part of the gate, and whose they are."""

    slots: np.ndarray  # (orders, decisions)
    bits: np.ndarray
    gates: np.ndarray
    owner: np.ndarray


def chunks(keys: list[bytes], size: int = 400) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Keys of at most LONG bytes in lists of a bounded size, and whose each is; a longer word comes in pieces, as if of several words."""
    owner = np.arange(len(keys))
    if keys and max(map(len, keys)) > HEAD + LONG:
        pieces = [range(HEAD, max(len(k), HEAD + 1), LONG) for k in keys]
        owner = np.repeat(owner, list(map(len, pieces)))
        keys = [k[:HEAD] + k[at : at + LONG] for k, mine in zip(keys, pieces) for at in mine]
    for at in range(0, len(keys), size):
        yield keys[at : at + size], owner[at : at + size]


def decisions(keys: list[bytes], slots_of: tuple[int, ...]) -> Decisions:
    """keys as of chunks(); slots_of are the log2 of the slots of each order."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.frombuffer(b"".join(keys), np.uint8)
    starts = np.cumsum(sizes) - sizes
    number = sizes - HEAD + 1  # a word's bytes and the blank
    first = np.cumsum(number) - number
    owner = np.repeat(np.arange(len(keys)), number)
    place = np.arange(len(owner)) - first.take(owner)
    symbol = np.append(flat, np.uint8(32)).take(starts.take(owner) + HEAD + place)
    symbol[first + number - 1] = 32
    head = flat[starts[:, None] + np.arange(HEAD)].astype(np.uint64) * _PLACES[:HEAD]
    state, kind = (head[:, : HEAD - 1].sum(axis=1) * _POWER).take(owner), (head[:, HEAD - 1] * _MIX).take(owner)
    spelled = _BYTES.take(symbol) * _PLACES.take(place)
    run = np.cumsum(spelled, dtype=np.uint64) - spelled
    so_far = run - run.take(first).take(owner)
    recent, back = [], np.zeros(len(symbol), np.uint64)
    for n in range(1, 5):
        earlier = np.zeros(len(symbol), np.uint64)
        earlier[n:] = symbol[:-n]
        back = back | np.where(place >= n, earlier, np.uint64(1)) << np.uint64(8 * (n - 1))
        recent.append(back)
    contexts = [state, recent[0], recent[1] + state, recent[2] + kind, recent[3], so_far, so_far + kind, so_far + state]
    nodes = (symbol.astype(np.int64)[:, None] | 256) >> np.arange(8, 0, -1)
    slots, begin = np.empty((ORDERS, len(symbol), 8), np.int64), 0
    for k, (c, size) in enumerate(zip(contexts, slots_of)):
        h = (c + np.uint64(k + 1)) * _MIX
        h ^= h >> np.uint64(32)
        h *= _POWER
        h >>= np.uint64(64 - size)
        # the eight decisions of a byte are in one run of 256 slots
        np.bitwise_xor(h.view(np.int64)[:, None], nodes, out=slots[k])
        slots[k] += begin
        begin += 1 << size
    bits = symbol[:, None] >> np.arange(7, -1, -1).astype(np.uint8) & 1
    gates = (np.minimum(place, PLACES - 1) * (CONFIDENCE * 8))[:, None] + np.arange(8)
    return Decisions(slots.reshape(ORDERS, -1), bits.ravel(), gates.ravel(), np.repeat(owner, 8))


@dataclass
class Model:
    slots_of: tuple[int, ...]
    table: np.ndarray  # a slot's two count bytes as one number
    maps: np.ndarray | None = None  # (orders, maps): the logit of a one after each history, where the word so far is new and where it is known
    weights: np.ndarray | None = None  # (orders, gates, confidence)
    refine: np.ndarray | None = None  # (gates, cells): the share of ones there

    def __getstate__(self) -> dict:
        """As it is broadcast: most slots are empty, so the table is packed."""
        return self.__dict__ | {"table": _pack(self.table.tobytes())}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"table": np.frombuffer(_unpack(state["table"]), np.uint16)}

    def ones(self, d: Decisions) -> np.ndarray:
        """The probability of a one, for each decision."""
        found = [_SLOT.take(self.table.take(s)) for s in d.slots]
        sure = found[WORD] >> 10
        gates, known = d.gates + sure * 8, np.where(sure > 0, HISTORIES, 0)
        total, at = np.zeros(len(d.bits), np.float32), gates * CONFIDENCE
        for k, f in enumerate(found):
            total += self.weights[k].ravel().take(at + (f >> 10)) * self.maps[k].take(known + (f & 1023))
        return _probability(total, gates, self.refine)

    def log10(self, keys: list[bytes]) -> np.ndarray:
        """The log10 probability of each key's token."""
        out = np.zeros(len(keys))
        for some, owner in chunks(keys):
            d = decisions(some, self.slots_of)
            p = self.ones(d)
            found = np.bincount(d.owner, np.log10(np.where(d.bits == 1, p, 1 - p)), len(some))
            np.add.at(out, owner, found)
        return out


def _cell(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell below a sum, and how far it is from there to the next."""
    x = np.clip(total, -11.99, 11.99) * (4 / 3) + 16
    low = x.astype(np.int64)
    return low, x - low


def _probability(total: np.ndarray, gates: np.ndarray, refine: np.ndarray) -> np.ndarray:
    """The mixed probability of a one, averaged with what the refining table holds around it."""
    p = 1 / (1 + np.exp(-np.clip(total, -14, 14).astype(np.float64)))
    low, part = _cell(total)
    cell = gates * CELLS + low
    flat = refine.ravel()
    return np.clip((p + flat.take(cell) * (1 - part) + flat.take(cell + 1) * part) / 2, 1e-6, 1 - 1e-6)


def first_weights() -> np.ndarray:
    return (np.array(BEGIN)[:, None, None] * np.ones((GATES, CONFIDENCE))).astype(np.float32)


@dataclass
class Learned:
    """Weights, and what was seen by order and history and by gate and cell: zeros, then ones."""

    weights: np.ndarray
    histories: np.ndarray
    cells: np.ndarray


def learn(table: np.ndarray, slots_of: tuple[int, ...], keys: list[bytes], counts: np.ndarray, rate: float = 0.04, step: int = 400, least: int = 150) -> Learned:
    """Online steps over the keys, a few hundred at a time: each predicts with what was learned before, then corrects it; few keys are seen again, up to eight times, until there were `least` steps."""
    weights, power = first_weights(), np.full((ORDERS, GATES, CONFIDENCE), 1e-6)
    prior, seen, cells = first_seen()[:, None], np.zeros((2, ORDERS, MAPS)), np.zeros((2, GATES * CELLS))
    passes = min(8, -(-least * step * 10 // sum(map(len, keys))))
    order = np.concatenate([np.random.default_rng([len(keys), i]).permutation(len(keys)) for i in range(passes)])
    for some, owner in chunks([keys[i] for i in order], step):
        d = decisions(some, slots_of)
        heavy = counts.take(order.take(owner.take(d.owner))) / passes
        bits, maps, given = d.bits.astype(np.int64), logits(seen + prior), []
        half = bits << 16
        found = [_LEFT.take(table.take(s) + half) for s in d.slots]
        sure = found[WORD] >> 10
        gates, known = d.gates + sure * 8, np.where(sure > 0, HISTORIES, 0)
        far = bits * MAPS
        for k, f in enumerate(found):
            history = known + (f & 1023)
            given.append((maps[k].take(history), f >> 10))
            seen[:, k] += np.bincount(far + history, heavy, 2 * MAPS).reshape(2, MAPS)
        at = gates * CONFIDENCE
        places = [at + sure for _, sure in given]
        total = sum(weights[k].ravel().take(where) * logit for k, (where, (logit, _)) in enumerate(zip(places, given)))
        off = (bits - 1 / (1 + np.exp(-np.clip(total, -14, 14)))) * heavy
        for k, (where, (logit, _)) in enumerate(zip(places, given)):
            move = np.bincount(where, off * logit, GATES * CONFIDENCE).reshape(GATES, CONFIDENCE) / heavy.sum()
            power[k] += move**2
            weights[k] += rate * move / np.sqrt(power[k])
        low, part = _cell(total)
        cell = (bits * GATES + gates) * CELLS + low + (part >= 0.5)
        cells += np.bincount(cell, heavy, cells.size).reshape(cells.shape)
    return Learned(weights, seen, cells)


def finished(model: Model, weights: np.ndarray, histories: np.ndarray, cells: np.ndarray) -> Model:
    """model with averaged weights and the maps and refining table of all that was seen."""
    model.weights = weights.reshape(ORDERS, GATES, CONFIDENCE).astype(np.float32)
    model.maps = logits(histories.reshape(2, ORDERS, MAPS) + first_seen()[:, None])
    plain = 1 / (1 + np.exp(-(np.arange(CELLS) - 16) * 3 / 4))
    zeros, ones = cells.reshape(2, GATES, CELLS)
    model.refine = (ones + plain) / (zeros + ones + 1)
    return model


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences, byte by byte."""
    steps = np.diff(values, prepend=np.uint64(0))
    return _pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(_unpack(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def _shares(keys: list[bytes], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each share, in order; a word is in one share whatever its head."""
    return _runs(np.fromiter((zlib.crc32(k[HEAD:]) % n for k in keys), np.int64, len(keys)))


def _runs(share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(share, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(share) else []:
        yield int(share[places[0]]), places


@dataclass
class Foreseen:
    """The distinct runs of several texts: share and value of each; of each run in turn its first token and its place among these."""

    share: np.ndarray
    value: np.ndarray
    first: np.ndarray
    at: np.ndarray


def foreseen(t: Tokens, shares: int) -> Foreseen:
    first, before, run = t.runs()
    share, value = (before & np.uint64(0xFFFFF)) % np.uint64(shares), before & ~np.uint64(0xFFFFF) | run & np.uint64(0xFFFFF)
    order = np.lexsort((value, share))
    new = np.ones(len(order), bool)
    new[1:] = (share[order][1:] != share[order][:-1]) | (value[order][1:] != value[order][:-1])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return Foreseen(share[order][new].astype(np.int64), value[order][new], first, at)


def answers_ahead(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each list of values, with how often training texts hold each: 0 where two words are followed by several runs there or by none,
    else how often they are, 254 at most, and 255 for a value whose run is another than theirs."""
    value = np.concatenate([v for v, _ in parts])
    times = np.concatenate([c for _, c in parts]).astype(np.int64)
    distinct, at = np.unique(value, return_inverse=True)
    total = np.bincount(at, times, len(distinct)).astype(np.int64)
    context = distinct >> np.uint64(20)
    group = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    alone = (np.bincount(group, total > 0) == 1).take(group) if len(group) else np.zeros(0, bool)
    code = np.where(alone, np.where(total > 0, np.minimum(total, 254), 255), 0).astype(np.uint8)
    return np.split(code.take(at), np.cumsum([len(v) for v, _ in parts])[:-1])


def foreseen_log10(t: Tokens, runs: Foreseen, code: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token whether it is in a run that was foreseen and came, and the log10 probability of that decision at its first one.

    code is the answer for each distinct run; learned tells the training texts,
    whose own occurrences don't count.
    """
    text, given = t.text[runs.first], code.take(runs.at).astype(np.int64) if len(code) else np.zeros(0, np.int64)
    _, which, own = np.unique(text * (len(code) + 1) + runs.at, return_inverse=True, return_counts=True)
    others = given - np.where(learned[text], own.take(which), 0)
    comes = (given > 0) & (given < 255) & ((others > 0) | (given == 254))
    asked = comes | (given == 255)
    begin = np.searchsorted(text, np.arange(len(t.starts) - 1)).take(text)
    after, out = np.zeros(len(text), bool), np.zeros(len(t.word))
    after[1:] = comes[:-1] & (text[1:] == text[:-1])
    for was, (yes, no) in FORESEEN.items():
        mine = asked & (after == was)
        n, a = (np.concatenate([[0], np.cumsum(x)]) for x in (mine, mine & comes))
        before, came = ((x[:-1] - x[begin])[mine] for x in (n, a))
        p = (yes + came) / (yes + no + before)
        out[runs.first[mine]] = np.log10(np.where(comes[mine], p, 1 - p))
    end = np.append(runs.first[1:], len(t.word))
    end = np.minimum(end, t.starts[1:].take(text))
    edge = np.bincount(runs.first[comes], minlength=len(t.word) + 1) - np.bincount(end[comes], minlength=len(t.word) + 1)
    return np.cumsum(edge)[:-1] > 0, out


def _table(kinds: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in kinds.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


ASKED = "bucket int, batch int, keys binary, counts binary"
KNOWN = "bucket int, keys binary, counts binary, units long"
SCORED = "bucket int, keys binary, counts binary, scores binary"
ANSWER = "batch int, bucket int, counts binary, scores binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def voters(docs: DataFrame, *, text: str = "text", label: str = "label", per_label: int = 500, share: float = 0.02, sure: float = 0.8) -> tuple[list[str], dict[bytes, int]]:
    """The labels, in order, and for which of them (from 1) a word speaks.

    Bounded sample: of each label the per_label distinct texts of lowest hashes.
    A word speaks for a label if it is in `share` of its sampled texts, two at
    least, and of its shares of all labels that one makes `sure` of the sum. So
    there are at most 1 / share times as many as a text has distinct words.
    """
    sample = language.sampled(docs, text=text, lang=label, per_language=per_label)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.by_partition(batches, 1 << 20):
            for name, x in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                words = [w for w in set(x.encode("utf-8", "surrogatepass").lower().split()) if len(w) <= LONG]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.binary())], names=["lang", "word"])

    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], {}
    sized = sample.groupBy("lang").agg(F.count("*").alias("of"))
    held = sample.mapInArrow(split, "lang string, word binary").groupBy("lang", "word").agg(F.count("*").alias("n")).join(sized, "lang")
    held = held.groupBy("word").agg(F.max_by(F.struct("lang", "n", "of"), F.struct(F.col("n") / F.col("of"), "lang")).alias("best"), F.sum(F.col("n") / F.col("of")).alias("every"))
    held = held.filter((F.col("best.n") >= F.greatest(F.lit(2), F.col("best.of") * share)) & (F.col("best.n") / F.col("best.of") >= sure * F.col("every")))
    number = {x: i for i, x in enumerate(names, 1)}
    return names, {bytes(r["word"]): number[r["lang"]] for r in held.select("word", "best.lang").collect()}


@dataclass
class Fitted:
    """What scoring needs: the model, who speaks for which state, tokens and distinct words of the training texts."""

    model: Model
    voters: dict[bytes, int]
    trained: int
    words: int


def score_texts(docs: DataFrame, held_out: Column, *, text: str = "text", doc_id: str = "doc_id", label: str | None = None, batch_bytes: int = 8 << 20, most_slots: tuple[int, ...] = MOST_SLOTS, fitted: list[Fitted] | None = None) -> DataFrame:
    """RESULT for each row: the base and the model's log10 probability of its text, learned from rows not held_out.

    label names a column of which training rows tell the states; scoring never
    reads it. score / n_bytes, n_bytes counting the lower-cased tokens with one
    blank each, gives bits per byte. Null text has only the end. With no training
    rows all contexts are empty and texts are spelled at one bit a decision.
    Repeated rows are rows; a training row is foreseen by other rows only, so one
    that occurs twice scores apart. A word of over LONG bytes is spelled in
    pieces, so a text of one endless word takes no more memory than others of its
    size. Other columns of docs are not carried along. A caller may pass a list
    to get what was fitted.

    Batches of documents ask for each distinct unit once; units are dealt by
    word, so a frequent word is one part of a row of each batch. There is a share
    for every four batches. Counts, model and scores are made where units are, and
    answers go back to batches. Tables grow with the distinct units up to
    most_slots, the vocabulary without an end: it is never in one place.
    """
    spark = docs.sparkSession
    n = common.batch_count(docs, text, batch_bytes)
    shares = max(8, n // 4)
    held = F.coalesce(held_out, F.lit(False))
    names, speak = voters(docs.filter(~held), text=text, label=label) if label else ([], {})
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(n)).cast("int").alias("batch"), F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("raw"), held.alias("held_out"),
    ).repartition(n, "batch")
    speaking = spark.sparkContext.broadcast(speak)  # of a bounded sample

    def ask(table: pa.Table) -> pa.Table:
        t = tokens(table["raw"].combine_chunks())
        keys, at = t.units(t.states(speaking.value))
        learn = ~table["held_out"].to_numpy()[t.text]
        numbers, batch = np.bincount(at[learn], minlength=len(keys)), table["batch"][0].as_py()
        out = [(s, batch, _pack(b" ".join([keys[i] for i in mine.tolist()])), _pack(numbers[mine].tobytes())) for s, mine in _shares(keys, shares)]
        ahead = foreseen(t, shares)
        numbers = np.minimum(np.bincount(ahead.at[learn[ahead.first]], minlength=len(ahead.value)), 255).astype(np.uint8)
        out += [(-1 - s, batch, _pack_sorted(ahead.value[mine]), _pack(numbers[mine].tobytes())) for s, mine in _runs(ahead.share)]
        return _table(ASKED, out)

    def unite(table: pa.Table) -> pa.Table:
        asked = [_unpack(k).split() for k in table["keys"].to_pylist()]
        keys = sorted(set().union(*asked))
        place, total = {k: i for i, k in enumerate(keys)}, np.zeros(len(keys), np.int64)
        for mine, c in zip(asked, table["counts"].to_pylist()):
            total[[place[k] for k in mine]] += np.frombuffer(_unpack(c), np.int64)
        return _table(KNOWN, [(table["bucket"][0].as_py(), _pack(b" ".join(keys)), _pack(total.tobytes()), len(keys))])

    def look_ahead(table: pa.Table) -> pa.Table:
        parts = [(_unpack_sorted(k), np.frombuffer(_unpack(c), np.uint8)) for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist())]
        bucket = table["bucket"][0].as_py()
        return _table(ANSWER, [(b, bucket, None, _pack(code.tobytes())) for b, code in zip(table["batch"].to_pylist(), answers_ahead(parts))])

    asked = common.staged(rows.groupBy("batch").applyInArrow(ask, ASKED), "asked-units")
    units = asked.filter("bucket >= 0")
    known = common.staged(units.groupBy("bucket").applyInArrow(unite, KNOWN), "known-units")
    distinct = max(1, known.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0])
    model = Model(tuple(max(10, min(most, int(distinct * 64).bit_length())) for most in most_slots), np.zeros(0, np.uint16))
    model.table, words, trained = _counted(known, model.slots_of, max(6, n // 16))
    shared = spark.sparkContext.broadcast(model)  # at most as most_slots say
    learned = _learned(known, shared)
    shared.destroy()  # the finished model holds the table too
    model = finished(model, *learned)
    shared = spark.sparkContext.broadcast(model)
    if fitted is not None:
        fitted.append(Fitted(model, speak, trained, words))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, k, c in zip(b["bucket"].to_pylist(), b["keys"].to_pylist(), b["counts"].to_pylist()):
                scores = shared.value.log10(_unpack(k).split()).astype(np.float32)
                yield from _table(SCORED, [(s, k, c, scores.tobytes())]).to_batches()

    def answer(asks: pa.Table, told: pa.Table) -> pa.Table:
        if not asks.num_rows or not told.num_rows:
            return _table(ANSWER, [])
        keys = _unpack(told["keys"][0].as_py()).split()
        counts, scores = np.frombuffer(_unpack(told["counts"][0].as_py()), np.int64), np.frombuffer(told["scores"][0].as_py(), np.float32)
        number: dict[bytes, int] = {}
        word = np.array([number.setdefault(k[HEAD:], len(number)) for k in keys], np.int64)
        total = np.bincount(word, counts, len(number)).astype(np.int64)
        place, out = {k: i for i, k in enumerate(keys)}, []
        for batch, k in zip(asks["batch"].to_pylist(), asks["keys"].to_pylist()):
            at = np.array([place[x] for x in _unpack(k).split()], np.int64)
            out.append((batch, asks["bucket"][0].as_py(), _pack(total[word[at]].tobytes()), scores[at].tobytes()))
        return _table(ANSWER, out)

    def add_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table(RESULT, [])
        t = tokens(texts["raw"].combine_chunks())
        keys, at = t.units(t.states(speaking.value))
        total, spelled = np.zeros(len(keys), np.int64), np.zeros(len(keys))
        told = {s: (c, p) for s, c, p in zip(*(answers[c].to_pylist() for c in ("bucket", "counts", "scores")))}
        for s, mine in _shares(keys, shares):
            total[mine], spelled[mine] = np.frombuffer(_unpack(told[s][0]), np.int64), np.frombuffer(told[s][1], np.float32)
        ahead = foreseen(t, shares)
        code = np.zeros(len(ahead.value), np.uint8)
        for s, mine in _runs(ahead.share):
            code[mine] = np.frombuffer(_unpack(told[-1 - s][1]), np.uint8)
        comes, decided = foreseen_log10(t, ahead, code, ~texts["held_out"].to_numpy())
        base = np.log10((total + 0.1) / (trained + 0.1 * (words + 1)))
        length = np.fromiter(map(len, keys), np.int64, len(keys)) - HEAD + 1
        per_text = lambda x: np.bincount(t.text, x, len(t.starts) - 1)
        sums = zip(per_text(total.take(at) > 0), per_text(base.take(at)), per_text(np.where(comes, 0, spelled.take(at)) + decided), per_text(length.take(at)))
        size = np.diff(t.starts).tolist()
        return _table(RESULT, [(i, held, m, int(k), trained, float(b), float(s), int(z)) for i, held, m, (k, b, s, z) in zip(texts["doc_id"].to_pylist(), texts["held_out"].to_pylist(), size, sums)])

    scored = known.mapInArrow(judge, SCORED)
    answers = units.select("bucket", "batch", "keys").groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(answer, ANSWER)
    answers = answers.union(asked.filter("bucket < 0").groupBy("bucket").applyInArrow(look_ahead, ANSWER))
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(add_up, RESULT)


def _counted(known: DataFrame, slots_of: tuple[int, ...], groups: int) -> tuple[np.ndarray, int, int]:
    """The slots' counts, the number of distinct training words, and that of training tokens.

    Each group fills a table of its own, and a table has a fixed size: there is
    one for every sixteen batches, so that what is added up grows with the input.
    """
    size = sum(1 << s for s in slots_of)

    def count(table: pa.Table) -> pa.Table:
        both = np.zeros(2 * size, np.float32)
        zeros, ones = np.split(both, 2)
        tokens, words = 0, 0
        for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist()):
            keys, counts = _unpack(k).split(), np.frombuffer(_unpack(c), np.int64)
            tokens += int(counts.sum())
            keys, counts = [x for x, y in zip(keys, counts.tolist()) if y], counts[counts > 0]
            words += len({x[HEAD:] for x in keys})  # a word is in one bucket
            for some, owner in chunks(keys, 1000):
                d = decisions(some, slots_of)
                heavy = counts.take(owner.take(d.owner)).astype(np.float32)
                half = d.bits.astype(np.int64) * size
                for k, slots in enumerate(d.slots):
                    np.add.at(both, slots + half, heavy if k >= BY_TOKEN else np.float32(1))
        width, out = -(-size // RANGES), [(-1, np.array([words, tokens], np.int64).tobytes())]
        for r in range(RANGES):
            part = np.stack([x[r * width : (r + 1) * width] for x in (zeros, ones)]).astype(np.uint32)
            out.append((r, _pack(np.ascontiguousarray(part.reshape(-1, 1).view(np.uint8).reshape(-1, 4).T).tobytes())))
        return _table("range int, payload binary", out)

    def add(table: pa.Table) -> pa.Table:
        if table["range"][0].as_py() < 0:
            return _table("range int, payload binary", [(-1, sum(np.frombuffer(x, np.int64) for x in table["payload"].to_pylist()).tobytes())])
        total = 0
        for x in table["payload"].to_pylist():
            total = total + np.ascontiguousarray(np.frombuffer(_unpack(x), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
        zeros, ones = quantised(total).reshape(2, -1)
        return _table("range int, payload binary", [(table["range"][0].as_py(), _pack(np.stack([zeros, ones], axis=1).tobytes()))])

    grouped = known.withColumn("group", F.pmod("bucket", F.lit(groups)))
    found = grouped.groupBy("group").applyInArrow(count, "range int, payload binary").groupBy("range").applyInArrow(add, "range int, payload binary").toArrow()  # a table of bounded size, packed
    table, width, totals = np.zeros(size, np.uint16), -(-size // RANGES), np.zeros(2, np.int64)
    for r, payload in zip(found["range"].to_pylist(), found["payload"]):
        if r < 0:
            totals = np.frombuffer(payload.as_py(), np.int64)
        else:
            part = np.frombuffer(_unpack(payload.as_py()), np.uint16)
            table[r * width : r * width + len(part)] = part
    return table, int(totals[0]), int(totals[1])


def _learned(known: DataFrame, shared) -> list[np.ndarray]:
    """Weights averaged over the shares of the units, and the maps and refining table of all of them."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b["keys"].to_pylist(), b["counts"].to_pylist()):
                counts = np.frombuffer(_unpack(c), np.int64)
                keys = [x for x, y in zip(_unpack(k).split(), counts.tolist()) if y]
                if keys:
                    found = learn(shared.value.table, shared.value.slots_of, keys, counts[counts > 0])
                    values = np.concatenate([x.ravel() for x in (found.weights, found.histories, found.cells)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "x"])

    sizes = [ORDERS * GATES * CONFIDENCE, 2 * ORDERS * MAPS, 2 * GATES * CELLS]
    value = F.when(F.col("i") < sizes[0], F.avg("x")).otherwise(F.sum("x"))
    found = known.mapInArrow(steps, "i long, x double").groupBy("i").agg(value.alias("x")).toArrow()  # a fixed number of rows
    if not found.num_rows:
        return [first_weights(), np.zeros(sizes[1]), np.zeros(sizes[2])]
    return np.split(found["x"].to_numpy()[np.argsort(found["i"].to_numpy())], np.cumsum(sizes)[:-1])
