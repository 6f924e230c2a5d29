"""BPE encoding and decoding by tree concatenation, equal to what the tokenizers library gives.

A long text is cut in halves, these again, until pieces are short. Pieces are encoded on their own, all
pieces of a batch at once. Neighbours are joined by encoding a window around the cut anew: it reaches some runs of
characters (what stands between blanks) into either side and grows until the ids of its outermost runs are those that the two
sides have for them; the joined ids are then those of the whole. A single word can be long too (no blank
for pages on end): it is cut and joined in the same way by its symbols, where a window agrees if its first and last tokens
are those of the sides; a row of tokens is what BPE gives if each neighbouring pair is, so that is exact again.

Most runs occur again and again, so each Python worker remembers their ids and their decoded form;
the library encodes those that are new, all of a batch at once.

Defined results: null and empty texts have no tokens; strings of special tokens in a text are those tokens,
as in the library; repeated rows get equal results, so there are no ties. Columns of the input that are called like a new one
are replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import map_texts

#: Texts of more characters are cut; pieces have at most so many.
PIECE = 4_096
#: Words of more bytes are cut.
WORD_PIECE = 4_096
#: Runs that a window reaches into either side at first, tokens in a long word.
WINDOW = 4
#: Runs that a Python worker remembers; when it has so many it starts anew.
REMEMBERED = 300_000
#: Longer runs aren't remembered.
LONGEST_REMEMBERED = 64
#: Characters for which Python's lower() and split() do what the tokenizer's normalizer does: Latin-1 without the separators 1C to 1F.
PLAIN = re.compile(r"[\x00-\x1b\x20-\xff]*")


@dataclass
class Tree:
    """A piece of text as the runs in it, or two halves; parted if no run goes on across the cut."""

    own: list[str]
    left: Tree | None = None
    right: Tree | None = None
    parted: bool = False
    blank: str | None = None

    def runs(self) -> Iterator[str]:
        """The runs of all pieces, and those that go on across a cut, so that most windows find theirs learnt with the batch."""
        stack = [self]
        while stack:
            x = stack.pop()
            yield from x.own
            if x.left is not None and x.right is not None:
                stack += [x.left, x.right]
                before, after = x.left._edge(-1), x.right._edge(0)
                if not x.parted and max(len(before), len(after)) <= LONGEST_REMEMBERED:
                    yield from (r for r in (before + after).split(x.blank) if r)

    def _edge(self, k: int) -> str:
        """The first (0) or last (-1) run of the piece at this end."""
        x = self
        while x.left is not None and x.right is not None:
            x = (x.left, x.right)[k]
        return x.own[k] if x.own else ""


class TreeEncoder:
    """Encoder and decoder of a tokenizer file of this kind: BPE over byte-level symbols, words cut by a pattern that drops blanks, lower case."""

    def __init__(self, path: str, piece: int = PIECE, word_piece: int = WORD_PIECE) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        steps = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        cut = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or (cut.get("behavior"), cut.get("invert")) != ("Removed", True) or config["decoder"]:
            raise ValueError(f"{path}: not a tokenizer that cuts words at blanks and drops these")
        self.piece, self.word_piece = max(16, piece), max(16, word_piece)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        plain = config | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "post_processor": None}
        self.bare = Tokenizer.from_str(json.dumps(plain))
        self.suffix = config["model"].get("end_of_word_suffix") or ""
        self.raw = plain | {"pre_tokenizer": None, "model": None}
        self.path = path
        if any(x.get(flag) for x in config["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: added tokens that take blanks, are whole words only or are normalized")
        self.special = {x["content"]: x["id"] for x in config["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        #: Without a decoder a text of ids is their tokens, parted by blanks.
        self.table = [(self.whole.id_to_token(i) or "").encode("utf-8", "surrogatepass") for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        #: Run to its ids and their decoded form, both as bytes.
        self.memory: dict[str, tuple[bytes, bytes]] = {}

    # Whole texts.

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        return [np.frombuffer(x, "<u4") for x, _ in self.encode_decode(texts)]

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as bytes, and what they decode to in UTF-8."""
        trees = [self._trees(x) if x else [] for x in texts]
        self._learn({r for own in trees for tree in own for r in tree.runs()})
        out = []
        for own in trees:
            known = [self.memory[r] for tree in own for r in self._concatenated(tree)]
            out.append((b"".join([a for a, _ in known]), b" ".join([b for a, b in known if a])))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def _learn(self, runs: set[str], keep: bool = False) -> None:
        """Remember runs that are new; special tokens stand as runs with a leading blank, which no other has. keep: forget nothing that was learnt before."""
        if not runs:
            return
        if not keep:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            for r in [r for r in self.memory if len(r) > LONGEST_REMEMBERED and r not in runs]:
                del self.memory[r]
        # Set less view would walk all that is remembered, at every cut.
        new = [r for r in runs if r not in self.memory]
        rare = [r for r in new if r[0] == " " or len(r) > self.word_piece // 4]
        for r in rare:
            if r[0] == " ":
                ids = np.array([self.special[r[1:]]], "<u4")
            else:
                ids = np.concatenate([np.zeros(0, "<u4"), *(self._word(word) for word, _ in self.bare.pre_tokenizer.pre_tokenize_str(r))])
            self.memory[r] = (ids.tobytes(), b" ".join([self.table[i] for i in ids.tolist()]))
        short = [r for r in new if r not in self.memory] if rare else new
        if short:
            # One text of all new runs, cut again where each of them starts.
            found = self.bare.encode(" ".join(short), add_special_tokens=False)
            ids = found.ids
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            ends = np.cumsum(np.fromiter(map(len, short), np.int64, len(short)) + 1)
            cuts = [0, *np.searchsorted(starts, ends).tolist()]
            raw, tokens = np.array(ids, "<u4").tobytes(), list(map(self.table.__getitem__, ids))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            self.memory.update(zip(short, zip([raw[4 * a : 4 * b] for a, b in spans], [b" ".join(tokens[a:b]) for a, b in spans], strict=True), strict=True))

    def _trees(self, text: str) -> list[Tree]:
        """A tree for each stretch of a text between special tokens, and for each of these."""
        if not (self.special_at and self.special_at.search(text)):
            return [self._tree(*self._normal(text))]
        pieces = [p for p in self.special_at.split(text) if p]
        return [Tree([" " + p]) if p in self.special else self._tree(*self._normal(p)) for p in pieces]

    def _normal(self, text: str) -> tuple[str, str | None]:
        """The normalized text, and what parts its runs: None for any blank."""
        if PLAIN.fullmatch(text):
            return text.lower(), None
        return self.whole.normalizer.normalize_str(text), " "

    # A text's tree.

    def _tree(self, text: str, blank: str | None) -> Tree:
        """The text cut in halves until these are short; a cut may fall inside a run."""
        if len(text) <= self.piece:
            return Tree([r for r in text.split(blank) if r])
        mid = len(text) // 2
        parted = not (text[mid - 1].split(blank)[:1] and text[mid].split(blank)[:1]) or " " in (text[mid - 1], text[mid])
        return Tree([], self._tree(text[:mid], blank), self._tree(text[mid:], blank), parted, blank)

    def _concatenated(self, tree: Tree) -> list[str]:
        """The runs of a tree, whose ids are in memory: those of its halves, joined where a window around the cut, encoded anew, has the ids of both sides at its ends."""
        if tree.left is None:
            return tree.own
        left, right = self._concatenated(tree.left), self._concatenated(tree.right)
        reach = WINDOW
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            text = " ".join(left[a:]) + (" " if tree.parted else "") + " ".join(right[:b])
            window = [r for r in text.split(tree.blank) if r]
            self._learn({r for r in window if r not in self.memory}, keep=True)
            # A side that the window takes whole has nothing left to agree with.
            if (a == 0 or self._agree(window[:1], left[a : a + 1])) and (b == len(right) or self._agree(window[-1:], right[b - 1 : b])):
                return [*left[:a], *window, *right[b:]]
            reach *= 2

    def _agree(self, one: list[str], other: list[str]) -> bool:
        """Whether a run at a window's end has the ids that the side has there, over the same characters."""
        return bool(one and other) and self.memory[one[0]][0] == self.memory[other[0]][0] and one[0] == other[0]

    # A long word's tree.

    def _of_word(self, suffix: str | None) -> Tokenizer:
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return Tokenizer.from_str(json.dumps(self.raw | {"model": model | {"end_of_word_suffix": suffix}}))

    @cached_property
    def word_end(self) -> Tokenizer:
        return self._of_word(self.suffix or None)

    @cached_property
    def word_part(self) -> Tokenizer:
        """Symbols inside a word: the last has no word's end."""
        return self._of_word(None)

    def _word(self, word: str) -> np.ndarray:
        """word: the byte-level symbols of one word."""
        if len(word) <= self.word_piece:
            return np.array(self.word_end.encode(word, add_special_tokens=False).ids, "<u4")
        n = len(word)
        cuts = [*range(0, n - self.word_piece // 2, self.word_piece), n]
        pieces = [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        inner = self.word_part.encode_batch(pieces[:-1], add_special_tokens=False)
        sides = [list(zip(x.ids, x.tokens, strict=True)) for x in inner]
        last = self.word_end.encode(pieces[-1], add_special_tokens=False)
        sides.append(list(zip(last.ids, last.tokens, strict=True)))
        while len(sides) > 1:
            ends = len(sides)
            sides = [self._join_word(sides[k], sides[k + 1], k + 2 == ends) if k + 1 < ends else sides[k] for k in range(0, ends, 2)]
        return np.array([i for i, _ in sides[0]], "<u4")

    def _join_word(self, left: list, right: list, ends_word: bool) -> list:
        reach = WINDOW
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            closing = ends_word and b == len(right)
            held = [*left[a:], *right[:b]]
            text = "".join(t for _, t in held)
            if closing and self.suffix:
                text = text[: -len(self.suffix)]
            found = (self.word_end if closing else self.word_part).encode(text, add_special_tokens=False)
            window = list(zip(found.ids, found.tokens, strict=True))
            # A side that the window takes whole has nothing left to agree with.
            if (a == 0 or window[0] == held[0]) and (b == len(right) or window[-1] == held[-1]):
                return [*left[:a], *window, *right[b:]]
            reach *= 2



@lru_cache(maxsize=4)
def encoder(path: str) -> TreeEncoder:
    """One for each Python worker and file."""
    return TreeEncoder(path)


def tokenize(documents: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """The columns of documents but the text, with ids, decoded, n_tokens, ids_sha256 and decoded_sha256.

    path: a tokenizer file that every executor can read. keep_ids False leaves out ids and decoded.
    ids are 32-bit numbers that are to be read as unsigned.
    """

    def made(texts: list) -> dict[str, list]:
        coder = encoder(path)
        found = coder.encode_decode(texts)
        out = {
            "n_tokens": pa.array([len(x) // 4 for x, _ in found], pa.int64()),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x, _ in found],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for _, x in found],
        }
        if keep_ids:
            out |= {"ids": pa.array([np.frombuffer(x, "<i4") for x, _ in found], pa.list_(pa.int32())), "decoded": [x.decode("utf-8", "surrogatepass") for _, x in found]}
        return out

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    new = {x.split()[0] for x in schema.split(", ")}
    return map_texts(documents.select(*(c for c in documents.columns if c not in new)), id_column, text_column, made, schema, lambda: encoder(path).memory.clear())
