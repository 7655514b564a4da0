"""Token ids of whole texts by a public tokenizer."""
from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

KEEP_PIECES = 400_000  # about 200 bytes each, twice at most
JOINED = 32            # runs that are encoded as one word
SLICE = 1 << 20

# No token of the public vocabularies spans the start of white space, or a letter beside a mark of these two classes.
# So a text's ids are those of its pieces; where white space is dropped, a piece starts after it.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_RUNS = rf"[{_LETTER}]+(?![^{_MARK}\s])", rf"[{_MARK}]+(?![^{_LETTER}\s])", r"\S+"
SPACED = "|".join([*(rf"\s*{run}" for run in _RUNS), r"\s+"])
WORDS = "|".join(_RUNS)
WORD_END = "</w>"
_ENDS = 0xE000  # a character plus this is the end of a word in a respelled vocabulary
BYTE_SPACES = "ĠĊ"  # space and line feed in a vocabulary of bytes
_BREAK = re.compile(r"(?<=\S)\s")
_ODD = re.compile("[\x1c-\x1fΣ]")  # white space for Python only; a letter whose lower case depends on its place


def _marked_ends(tokenizer):
    """The tokenizer's model with the end of a word spelled as another last character, so that words need no splitting."""
    from tokenizers import models

    def spelled(token: str) -> str:
        body = token.removesuffix(WORD_END)
        return token if body == token or not body else body[:-1] + chr(ord(body[-1]) + _ENDS)
    model = json.loads(tokenizer.to_str())["model"]
    pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])
    vocabulary = {spelled(token): i for token, i in model["vocab"].items()}
    if len(vocabulary) < len(model["vocab"]):
        return tokenizer.model  # runs are given back then
    return models.BPE(vocabulary, [(spelled(a), spelled(b)) for a, b in pairs])


class Encoder:
    """Encodes pieces with the tokenizers library and remembers them; a text is the concatenation of its pieces.

    About twice ``keep`` pieces are remembered at most: those since the last full memory, and that one, from which pieces
    that come again are taken over.  A long text goes through in slices.
    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, pieces: str, keep: int = KEEP_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split, self.keep, self.known = re.compile(pieces).findall, keep, {}
        self.older: dict[str, bytes] = {}
        # A marked end of a word, or start of white space, tells where a piece ends or starts: many can be encoded as one text.
        words = self.tokenizer.get_vocab()
        ends = pieces == WORDS and any(w.endswith(WORD_END) for w in words)
        self.edge = np.zeros(max(words.values()) + 1, bool)
        self.edge[[i for w, i in words.items() if (w.endswith(WORD_END) if ends else w[0] in BYTE_SPACES)]] = True
        run, self.shift = "|".join(_RUNS[:2]), 1 if ends else 0
        if not ends:
            run = f"[ \\n](?:{run})" if pieces == SPACED and self.edge.any() else None
        self.simple = re.compile(run).fullmatch if run else None
        # Such runs are words to the vocabulary's own splitting, and no token spans two of them where their edges are marked:
        # several in a row give the same ids as one after another.
        self.lower, self.runs = ends, Tokenizer(_marked_ends(self.tokenizer) if ends else self.tokenizer.model)
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = np.zeros(256, "<u4")  # of the bytes of the letters and marks above
        for char in map(chr, range(256)):
            self.spelling[list(char.encode())] = list(map(ord, spell(char)[0][0]))
        self.spelling[[9, 13]] = 9, 10  # between runs, and between those encoded as one word and the next
        for one in (self.tokenizer, self.runs):
            if hasattr(one.model, "_resize_cache"):
                one.model._resize_cache(0)  # a piece comes once; the memory here has the others

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and (m := _BREAK.search(text, at + SLICE)):
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > self.keep:
            self.known, self.older = {}, self.known
        again = new.intersection(self.older)
        for piece in again:
            self.known[piece] = self.older[piece]
        todo = list(new.difference(again))
        if self.simple:
            simple = list(filter(self.simple, todo))
            rest = set(todo).difference(simple) if len(simple) < len(todo) else ()
            todo = [*self._learn_runs(simple), *rest]
        for piece, code in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(code.ids, np.uint32).tobytes()

    def _learn_runs(self, runs: list[str]) -> list[str]:
        """Encode single runs of letters or marks together, cut at the marks of the vocabulary; gives back those that this left out."""
        if not runs:
            return []
        text = "\t".join(runs)
        text = text.lower() if self.lower else text.replace("\n", "\n\r")  # a line feed is a word of its own
        points = self.spelling[np.frombuffer((text + "\t").encode(), np.uint8)]
        tabs = np.flatnonzero(points == 9)
        if self.lower:
            points[tabs - 1] += _ENDS
        points[tabs[JOINED - 1::JOINED]] = 10
        some = points[points != 9].tobytes().decode("utf-32-le").split("\n")
        codes = self.runs.encode_batch_fast(some, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(code.ids for code in codes), np.uint32)
        edges = np.flatnonzero(self.edge[ids]) + self.shift
        cuts = np.append(edges, len(ids)) if not self.shift else np.append(0, edges)
        if len(edges) != len(runs) or cuts[0] != 0 or cuts[-1] != len(ids):
            return runs
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        self.known.update(zip(runs, map(data.__getitem__, map(slice, cuts, cuts[1:]))))
        return []

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of several texts, whose new pieces are encoded together."""
        if sum(map(len, texts)) > SLICE and len(texts) > 1:
            half = len(texts) // 2
            return self.many(texts[:half]) + self.many(texts[half:])
        if len(texts) == 1 and len(texts[0]) > SLICE and not _ODD.search(texts[0]):
            return [np.concatenate([self._ids_of([self.split(t)])[0] for t in self._slices(texts[0])])]
        odd = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
               for i, t in enumerate(texts) if _ODD.search(t)}
        found = self._ids_of([[] if i in odd else self.split(t) for i, t in enumerate(texts)])
        return [odd.get(i, ids) for i, ids in enumerate(found)]

    def _ids_of(self, parts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts given as pieces: each piece is looked up once, and a second time if it was new."""
        pieces = list(chain.from_iterable(parts))
        codes = list(map(self.known.get, pieces))
        if None in codes:
            gaps = [i for i, code in enumerate(codes) if code is None]
            self._learn({pieces[i] for i in gaps})
            for i in gaps:
                codes[i] = self.known[pieces[i]]
        out, at = [], 0
        for some in parts:
            out.append(np.frombuffer(b"".join(codes[at:at + len(some)]), np.uint32))
            at += len(some)
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pieces: str) -> Encoder:
    """The encoder of this Python worker, which keeps its memory from task to task."""
    if (path, pieces) not in _encoders:
        _encoders[path, pieces] = Encoder(path, pieces)
    return _encoders[path, pieces]
