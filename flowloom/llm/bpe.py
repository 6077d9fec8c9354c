"""Byte-pair encoding by last-token states over a trie of distinct words, and decoding.

In byte-pair encoding the tokens of a word's prefix are fixed by the prefix alone: its last token,
and before that the tokens of the prefix that is left. So each trie node needs one state, its last
token. A token can follow another when encoding both strings joined gives the two tokens again; of
the tokens that end at a node, exactly one can follow the state of the node where it starts. Tokens
that end at a node are found in a trie of reversed tokens, for many nodes at once. Whether one can
follow another is read off the merges at the seam between them, as far as merges build on earlier
ones only (else both strings are merged anew).
Distinct words are visited in sorted order, which is a depth-first walk of their trie: states of a
prefix shared with the word before are still on the stack and are not computed again. The last
symbol of a word carries the vocabulary's word end, so the end has a state of its own below the
node.

Texts are split at white space first. No token spans it, so the pieces of a text are encoded on
their own and equal pieces have equal tokens. Pieces seen by a Python worker are remembered up to
``CACHE_PIECES``, and then all but those of the batch at hand are forgotten; that saves work and
changes no result.

Defined results: a null text is an empty text with no tokens. Rows are encoded one by one, repeated
rows alike. An empty table gives an empty table. A character the vocabulary lacks gives no token,
as the vocabulary has no unknown token (byte vocabularies cover every character).
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from flowloom.llm.batches import PIECE_BYTES, map_batches

CACHE_PIECES = 50_000
CACHE_PAIRS = 200_000
#: Words whose nodes are laid out, and nodes whose tokens are looked up, in one go.
BLOCK_WORDS = 16_384
BLOCK_NODES = 65_536
CHARACTER_BITS = 21
SIGNS = ".,;:!?#*$%&|"
#: Letters of Latin-1 beyond ASCII.
ACCENTED = "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
#: Letters and then signs, one piece a line; with accented letters or ASCII only. Most tokenizers lower-case
#: the letters and cut the signs off; whether a file's does is tried on ``PROBES`` when it is loaded.
PLAIN = re.compile(r"^([A-Za-z]+)([.,;:!?#*$%&|]*)$", re.MULTILINE)
WIDE = re.compile(rf"^([A-Za-z{ACCENTED}]+)([.,;:!?#*$%&|]*)$", re.MULTILINE)
PROBES = [
    "a", "Z", "abc", "ABC", "aBcDeF", "it", "The", "don", "x" * 40, f"end{SIGNS}", f"End{SIGNS[::-1]}",
    *(f"word{a}" for a in SIGNS), *(f"Word{a}{a}" for a in SIGNS),
    *(f"w{a}{b}" for a in SIGNS for b in SIGNS),
]
WIDE_PROBES = [
    ACCENTED, ACCENTED[::-1], *ACCENTED, *(f"ab{c}" for c in ACCENTED), *(f"{c}Ab{c}{c}z" for c in ACCENTED),
    *(f"{c}{a}" for c in ACCENTED for a in SIGNS), *(c + d for c in ACCENTED for d in ACCENTED),
]


class EndingTokens:
    """Tokens that end at given places of a text, by a trie of reversed tokens."""

    def __init__(self, tokens: Iterable[tuple[str, int]]):
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for body, number in tokens:
            node = 0
            for c in reversed(body):
                node = steps.setdefault(node << CHARACTER_BITS | ord(c), len(steps) + 1)
            ends[node] = number
        keys = np.fromiter(steps, np.int64, len(steps))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.children = np.append(order + 1, 0)
        self.tokens = np.full(len(steps) + 1, -1, np.int64)
        self.tokens[list(ends)] = list(ends.values())

    def find(self, codes: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(index into ``ends``, start, token) by index, the longest token first; a token lies
        between ``first`` and its end."""
        which, place, node = np.arange(len(ends)), ends, np.zeros(len(ends), np.int64)
        found = [(which[:0], place[:0], node[:0])]
        while len(which):
            place = place - 1
            step = node << CHARACTER_BITS | codes[place]
            at = np.searchsorted(self.keys, step)
            hit = self.keys[at] == step
            which, place, node = which[hit], place[hit], self.children[at[hit]]
            token = self.tokens[node]
            whole = token >= 0
            found.append((which[whole], place[whole], token[whole]))
            more = place > first[which]
            which, place, node = which[more], place[more], node[more]
        which, place, token = (np.concatenate(c) for c in zip(*reversed(found), strict=True))
        order = np.argsort(which, kind="stable")
        return which[order], place[order], token[order]


class WordEncoder:
    """Tokens of words (strings of the vocabulary's symbols) by last-token states."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        # Only tokens that encode to themselves ever appear in an encoding.
        self.made: dict[str, tuple[int, str, str] | None] = {}
        self.pairs: dict[int, bool] = {}
        first: dict[str, int] = {}
        for i, (a, b) in enumerate(merges):
            first.setdefault(a + b, i)
        self.ordered = all(first.get(x, -1) < i for i, m in enumerate(merges) for x in m)
        self.size = max(vocab.values(), default=-1) + 1
        self.names = [""] * self.size
        self.lengths = [0] * self.size
        #: Whether a token encodes to itself; -1 until it is met.
        self.sound = np.full(self.size, -1, np.int8)
        inner, final = [], []
        for token, number in vocab.items():
            closing = bool(end) and token.endswith(end)
            body = token.removesuffix(end) if closing else token
            self.names[number], self.lengths[number] = token, len(body)
            (final if closing else inner).append((body, number))
        # Tokens that end a word stand apart.
        self.inner = EndingTokens(inner)
        self.final = EndingTokens(final) if end else self.inner

    def merge(self, parts: list[str]) -> list[str]:
        """Plain merging: the pair of lowest rank first, the leftmost of equals."""
        while len(parts) > 1:
            best, at = self.lowest(parts)
            if best is None:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def lowest(self, parts: list[str]) -> tuple[int | None, int]:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = self.ranks.get((parts[i], parts[i + 1]))
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        return best, at

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def making(self, token: str) -> tuple[int, str, str] | None:
        """(rank, left, right) of the merge that makes a token from its own symbols, a rank of -1 for
        a symbol; None for a token that its symbols do not merge to."""
        if token not in self.made:
            parts, last = self.symbols(token), (-1, "", "")
            while len(parts) > 1:
                best, at = self.lowest(parts)
                if best is None:
                    break
                last = (best, parts[at], parts[at + 1])
                parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            self.made[token] = last if parts == [token] else None
        return self.made[token]

    def follows(self, first: int, second: int) -> bool:
        """Encoding both joined gives the two tokens again."""
        pair = first * self.size + second
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.names[first], self.names[second]
            if self.ordered:
                known = self.seam_holds(a, b)
            else:
                known = self.merge([*self.symbols(a), *self.symbols(b)]) == [a, b]
            self.pairs[pair] = known
        return known

    def seam_holds(self, left: str, right: str) -> bool:
        """No merge joins the two sides of the seam at any time.

        Merges happen in order of rank. Going back in time, the parts beside the seam are those whose
        making is undone, the later one first (of one rank, the right one is made later). A pair of
        parts stands at the seam until either is merged away from it; a merge of the pair must not
        come before, and on a tie the leftmost merge comes first.
        """
        ends = [float("inf"), float("inf")]
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and rank < ends[0] and rank <= ends[1]:
                return False
            a, b = self.making(left), self.making(right)
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                ends[0], left = a[0], a[2]
            else:
                ends[1], right = b[0], b[1]

    def candidates(
        self, trie: EndingTokens, codes: np.ndarray, ends: np.ndarray, first: np.ndarray
    ) -> Iterator[tuple[range, list[int], list[int]]]:
        """Of each node in turn: where its tokens stand in the lists of starts and of tokens."""
        for low in range(0, len(ends), BLOCK_NODES):
            some = slice(low, low + BLOCK_NODES)
            which, start, token = trie.find(codes, ends[some], first[some])
            for number in np.unique(token[self.sound[token] < 0]).tolist():
                self.sound[number] = self.making(self.names[number]) is not None
            sound = self.sound[token] == 1
            which, start, token = which[sound], start[sound], token[sound]
            starts, tokens = (start - first[some][which]).tolist(), token.tolist()
            bounds = np.searchsorted(which, np.arange(len(ends[some]) + 1)).tolist()
            for at in map(range, bounds, bounds[1:]):
                yield at, starts, tokens

    def state(self, found: tuple[range, list[int], list[int]], states: list[int]) -> int:
        """Last token of a node, given the states above it."""
        at, starts, tokens = found
        pairs, size = self.pairs, self.size
        for i in at:
            token, before = tokens[i], states[starts[i]]
            if before < 0:
                return token
            known = pairs.get(before * size + token)
            if known or known is None and self.follows(before, token):
                return token
        raise ValueError("no token ends a prefix of the word")

    def encode_ids(self, distinct: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, token ids) of each of the distinct words."""
        states, before = [-1], ""
        state, lengths = self.state, self.lengths
        ordered = sorted(distinct)
        for low in range(0, len(ordered), BLOCK_WORDS):
            words = ordered[low : low + BLOCK_WORDS]
            shared = []
            for word in words:
                # The last symbol is met as a node only by longer words.
                limit, n = min(len(before) - 1, len(word)), 0
                while n < limit and before[n] == word[n]:
                    n += 1
                shared.append(n)
                before = word
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
            ends = np.cumsum([len(w) for w in words])
            first = np.concatenate([[0], ends[:-1]])
            new = ends - first - 1 - shared
            nth = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new)
            inner_ends = np.repeat(first + shared + 1, new) + nth
            inner = self.candidates(self.inner, codes, inner_ends, np.repeat(first, new))
            final = self.candidates(self.final, codes, ends, first)
            for word, common, count in zip(words, shared, new.tolist(), strict=True):
                del states[common + 1 :]
                for _ in range(count):
                    states.append(state(next(inner), states))
                last = state(next(final), states)
                tokens, left = [last], len(word) - lengths[last]
                while left:
                    tokens.append(states[left])
                    left -= lengths[states[left]]
                yield word, tokens[::-1]

    def encode_words(self, distinct: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, tokens) of each of the distinct words."""
        for word, tokens in self.encode_ids(distinct):
            yield word, [self.names[t] for t in tokens]


class PieceEncoder:
    """Packed ids and token strings of white-space separated pieces, as a tokenizer file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Only the splitting into words is left to the library, so it needs no vocabulary.
        bare = {"type": "BPE", "vocab": {}, "merges": []}
        self.library = Tokenizer.from_str(json.dumps({**spec, "model": bare, "added_tokens": []}))
        self.vocab = spec["model"]["vocab"]
        self.words = WordEncoder(
            self.vocab, spec["model"]["merges"], spec["model"].get("end_of_word_suffix") or ""
        )
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.accents = {ord(c): "".join([w for w, _ in self.parts(c.encode())]) for c in ACCENTED}
        self.plain = self.as_library(PLAIN, PROBES)
        #: The pattern of the pieces that need no library, as far as the probes show.
        self.pattern = WIDE if self.plain and self.as_library(WIDE, WIDE_PROBES) else PLAIN

    def lowered(self, word: str) -> str:
        """A word of plain letters in the vocabulary's symbols."""
        return word.lower() if word.isascii() else word.lower().translate(self.accents)

    @staticmethod
    def plain_parts(pattern: re.Pattern, pieces: Iterable[bytes]) -> list[tuple[str, str]]:
        """(letters, signs) of those pieces that are letters and then signs."""
        # A piece with invalid bytes holds a replacement character, which is no letter.
        return pattern.findall(b"\n".join(pieces).decode("utf-8", "replace"))

    def as_library(self, pattern: re.Pattern, probes: list[str]) -> bool:
        """Whether the library lower-cases the letters of all these pieces and cuts the signs off."""
        pieces = [p.encode() for p in probes]
        found = self.plain_parts(pattern, pieces)
        return len(found) == len(pieces) and all(
            self.parts(piece) == [(part, False) for part in (self.lowered(word), signs) if part]
            for piece, (word, signs) in zip(pieces, found, strict=True)
        )

    def parts(self, piece: bytes) -> list[tuple[str, bool]]:
        """Words of a piece in the vocabulary's symbols, and added tokens (True)."""
        text, out = piece.decode("utf-8", "replace"), []
        for i, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if i % 2:
                out.append((part, True))
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [(w, False) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, pieces: set[bytes]) -> None:
        fresh = pieces.difference(self.known)
        plain = self.plain_parts(self.pattern, fresh) if self.plain else []
        keys = [(word + signs).encode() for word, signs in plain]
        letters = [self.lowered(word) for word, _ in plain]
        odd = {p: self.parts(p) for p in fresh.difference(keys)}
        wanted = {w for ws in odd.values() for w, added in ws if not added}
        wanted.update(letters)
        wanted.update({signs for _, signs in plain if signs})
        words, names = {}, self.words.names
        for word, tokens in self.words.encode_ids(wanted):
            words[word] = struct.pack(f"<{len(tokens)}I", *tokens), " ".join([names[t] for t in tokens])
        known = self.known
        for piece, word, (_, signs) in zip(keys, letters, plain, strict=True):
            if signs:
                (ids, shown), (more, after) = words[word], words[signs]
                known[piece] = ids + more, f"{shown} {after}"
            else:
                known[piece] = words[word]
        for piece, ws in odd.items():
            made = [(struct.pack("<I", self.added[w]), w) if added else words[w] for w, added in ws]
            known[piece] = b"".join([i for i, _ in made]), " ".join([t for _, t in made])

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[str]]:
        # Bytes split at ASCII white space alone; a batch is held as numbers of its distinct pieces.
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        numbered = [array("I", map(numbers.__getitem__, t.split())) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known = {p: self.known[p] for p in numbers.keys() & self.known.keys()}
        self.learn(set(numbers))
        packed, names = zip(*map(self.known.__getitem__, numbers), strict=True) if numbers else ((), ())
        ids = [b"".join(map(packed.__getitem__, n)) for n in numbered]
        shown = [" ".join(filter(None, map(names.__getitem__, n))) for n in numbered]
        return ids, shown


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


ENCODED = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_tokens", LongType()),
        StructField("ids", BinaryType()),
        StructField("decoded", StringType()),
    ]
)


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers. ``decoded`` is the text
    they decode to; the vocabulary names no decoder, so that is the tokens joined by blanks.
    ``path`` is the tokenizer file, present on every machine. ``piece_bytes`` of text are encoded at
    once: fewer take less memory of a worker and more time.
    """

    def run(batch):
        ids, shown = encoder(path).encode([t or b"" for t in batch.column("text").to_pylist()])
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(i) // 4 for i in ids],
            "ids": ids,
            "decoded": shown,
        }

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_batches(source, "text", run, ENCODED, piece_bytes)
