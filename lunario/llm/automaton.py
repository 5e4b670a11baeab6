"""A byte-pair vocabulary compiled into a deterministic automaton with a table of transitions.

Following Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA" (2024): the automaton starts with
one state that loops on every byte. Each merge (u, v) -> w, in the order of the vocabulary, is one gadget:

* the arc v is taken from the state after u, so the pair u v can no longer be written;
* every state from which u and then v could be read gets an arc w;
* the state after w starts as a copy of the state after v.

The finished automaton accepts exactly the token sequences that the merges produce, and each byte string labels
exactly one accepted path. Its states are the start and one after each token. The table stays small because the arcs
of a state are runs of numbers: tokens are numbered so that whatever begins with a token stands behind it, in the
order in which it was merged. An arc x that a gadget takes away at some time takes along all that is built upon x later
and nothing else, which is one run. A state's row is the list of edges of the runs without an arc; states with equal
gadgets share a row.

Encoding reads a word by a table over its bytes, which finds the labels that begin at a place, and by the rows, which
say which of these may follow the state reached there. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import regex

# Fixed value: how the vocabulary's texts are split before its merges apply.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Split words whose path is kept in a worker; beyond that the table starts anew.
KEPT_WORDS = 300_000
#: White space that is not one space between two words.
_RUN = regex.compile(r"(\s{2,}|[^\S ])").split


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: itself if printable, else the next letter from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Kept(dict):
    """What a function gives for a text, kept for texts that are not long."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, text: str) -> bytes:
        found = self.of(text)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(text) <= 64:
            self[text] = found
        return found


class Automaton:
    """States, rows of the transition table, and the table over bytes that leads to the labels."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self._gadgets(merges)
        self._number()
        self._rows()
        self._bytes()
        self.split = regex.compile(SPLIT).findall
        self.words = _Kept(self._word)
        self.spaced = _Kept(lambda chunk: b"".join(map(self.words.__getitem__, self.split(" " + chunk))))

    def _gadgets(self, merges: list[tuple[int, int, int]]) -> None:
        """What each merge adds: an arc taken from the state after u, and a state after w that copies the one after v."""
        self.made = dict.fromkeys(self.labels, -1)
        self.above: dict[int, int] = {}  # w -> u: an arc w stands where an arc u stood
        self.taken: dict[int, list[tuple[int, int]]] = {t: [] for t in self.labels}  # state -> (order, arc)
        self.copied: dict[int, tuple[int, int]] = {}  # state -> (the state it copies, how many gadgets that had)
        self.grown: dict[int, list[int]] = {t: [] for t in self.labels}  # u -> w, in order
        for order, (u, v, w) in enumerate(merges):
            if self._open(u, v):  # otherwise u and v never meet, and no arc w comes to be
                self.made[w], self.above[w] = order, u
                self.grown[u].append(w)
                self.copied[w] = v, len(self.taken[v])
                self.taken[u].append((order, v))

    def _open(self, state: int, token: int) -> bool:
        """Whether the state has the arc, with the gadgets so far."""
        spine = [(token, 1 << 60)]  # what the token begins with, and when that was built upon
        while spine[-1][0] in self.above:
            spine.append((self.above[spine[-1][0]], self.made[spine[-1][0]]))
        upto = dict(spine)
        return not any(upto.get(x, -1) > order for order, x in self._missing(state))

    def _missing(self, state: int):
        """(order, arc) of all that gadgets have taken from a state or from those it copies, before the copy."""
        count = len(self.taken[state])
        while True:
            yield from self.taken[state][:count]
            if state not in self.copied:
                return
            state, count = self.copied[state]

    def _number(self) -> None:
        """Numbers for the tokens: each before all that begin with it, these in the order of their merges."""
        self.number, self.last = {}, {}
        for root in self.labels:
            if root in self.above:
                continue
            stack = [(root, False)]
            while stack:
                t, done = stack.pop()
                if done:
                    self.last[t] = len(self.number)
                    continue
                self.number[t] = len(self.number)
                stack.append((t, True))
                stack.extend((w, False) for w in reversed(self.grown[t]))

    def _rows(self) -> None:
        """The transition table: for each state the edges of the runs of numbers without an arc, in rising order."""
        orders = {t: [self.made[w] for w in ws] for t, ws in self.grown.items()}
        shared: dict[tuple, array] = {}
        self.row: dict[int, array] = {-1: array("i")}  # -1 is the start, which has all arcs
        for state in self.labels:
            key = (state, len(self.taken[state]))
            while not key[1] and key[0] in self.copied:
                key = self.copied[key[0]]
            row = shared.get(key)
            if row is None:
                runs = []
                for order, x in self._missing(state):
                    runs.append((self.number[x], self.number[x] + 1))
                    later = bisect_left(orders[x], order)
                    if later < len(orders[x]):
                        runs.append((self.number[self.grown[x][later]], self.last[x]))
                edges: list[int] = []
                for low, high in sorted(runs):
                    if edges and low <= edges[-1]:
                        edges[-1] = max(edges[-1], high)
                    else:
                        edges += [low, high]
                row = shared[key] = array("i", edges)
            self.row[state] = row

    def _bytes(self) -> None:
        """The table over bytes: (place << 8 | byte) -> place, and the token whose label ends at a place."""
        self.step: dict[int, int] = {}
        self.ends = [-1]
        self.whole: dict[bytes, int] = {}
        for t, label in self.labels.items():
            if len(label) > 1 and self.made[t] < 0:
                continue  # no merges lead to it
            self.whole[label] = t
            at = 0
            for byte in label:
                to = self.step.get(at << 8 | byte)
                if to is None:
                    to = self.step[at << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                at = to
            self.ends[at] = t

    def arc(self, state: int, token: int) -> bool:
        """Whether the table has an arc ``token`` from a state, which leads to the state after that token."""
        return not bisect_right(self.row[state], self.number[token]) & 1

    def path(self, word: bytes) -> list[int]:
        """The tokens of the word's only accepted path."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        n, step, ends, number = len(word), self.step.get, self.ends, self.number
        state, start = [-1] * (n + 1), [-1] * (n + 1)
        for j in range(n):  # every place is reached, as bytes are tokens
            row, at = self.row[state[j]], 0
            for i in range(j, n):
                at = step(at << 8 | word[i])
                if at is None:
                    break
                t = ends[at]
                if t >= 0 and start[i + 1] < 0 and not bisect_right(row, number[t]) & 1:
                    state[i + 1], start[i + 1] = t, j
        out, i = [], n
        while i:
            out.append(state[i])
            i = start[i]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        return array("i", self.path(word.encode("utf-8"))).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Token ids of a text as 32-bit numbers, one after the other; none for null and empty texts.

        A space between two words belongs to the second, so what lies between such spaces is split once and kept. Of a
        run of white space the last character stands apart from the others, unless the text ends with the run.
        """
        if not text:
            return b""
        out, parts = [], _RUN(text)
        spaced, words = self.spaced.__getitem__, self.words
        lead = False
        for k, part in enumerate(parts):
            if k & 1:
                lead = False
                if k == len(parts) - 2 and not parts[-1]:
                    out.append(words[part])
                    continue
                if len(part) > 1:
                    out.append(words[part[:-1]])
                if part[-1] == " ":
                    lead = True
                else:
                    out.append(words[part[-1]])
            elif part:
                chunks = part.split(" ")
                if lead:
                    out.append(spaced(chunks[0]))
                elif chunks[0]:
                    out += map(words.__getitem__, self.split(chunks[0]))
                out += map(spaced, chunks[1:])
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text. No text is a special token."""
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text whose path the ids are: the labels of the arcs, one after the other."""
        return b"".join([self.labels[i] for i in ids]).decode("utf-8", errors="replace")


def _refuse(model: dict, whole: dict) -> None:
    """An error for a file whose rules are not those of a plain byte-level vocabulary; its ids would be wrong."""
    parts = whole.get("pre_tokenizer") or {}
    parts = parts.get("pretokenizers", [parts])
    plain = len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex", True) and not parts[0].get("add_prefix_space")
    odd = [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or whole.get("normalizer") or not plain:
        raise ValueError(f"Only byte-level vocabularies without normalisation are compiled; this one has {odd or [p.get('type') for p in parts]}")


def compile_json(content: bytes) -> Automaton:
    """The automaton of a byte-level BPE file with ``model.vocab`` and ``model.merges``."""
    whole, letters = json.loads(content), byte_letters()
    model, special = whole["model"], {t["id"] for t in whole.get("added_tokens", ())}
    _refuse(model, whole)
    vocab = {name: t for name, t in model["vocab"].items() if t not in special}
    labels = {t: bytes(letters[c] for c in name) for name, t in vocab.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])


def compile_ranks(content: bytes) -> Automaton:
    """The automaton of a file of lines ``base64-label rank``; the merge of a label is the last pair of its path."""
    try:
        labels = {int(r): base64.b64decode(a, validate=True) for a, r in (line.split() for line in content.splitlines() if line.strip())}
    except (ValueError, binascii.Error):
        raise ValueError("A vocabulary is a JSON file or has lines of a label in base64 and its rank") from None
    by_label, merges = {b: r for r, b in labels.items()}, []
    for r in sorted(labels):
        parts = [bytes([b]) for b in labels[r]]
        while len(parts) > 2:
            ranks = [by_label.get(a + b, r) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] >= r:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            merges.append((by_label[parts[0]], by_label[parts[1]], r))
    return Automaton(labels, merges)


@functools.lru_cache(maxsize=4)
def compiled(content: bytes) -> Automaton:
    """The automaton of a vocabulary file's content, once in a process."""
    return compile_json(content) if content.lstrip()[:1] == b"{" else compile_ranks(content)
