"""Token ids of whole texts, with a memory of the pieces a text falls into.

The library splits a text into pieces before it merges, and a piece's ids don't depend on its
neighbours. For the two pre-tokenizers below the places where every split must fall are known
(around isolated white space, and between a letter and the ASCII marks at the end of a word), so
each distinct piece is encoded once by the library, many in one call, and then looked up. Texts are
taken a few million characters at a time: Arrow splits them and finds the distinct words, only these
meet the memory, and numpy lays their ids out in the order of the words. A text outside those rules
(special-token strings, runs of white space) goes to the library whole. Ids equal those of the
library for the whole text; tests compare them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that isn't isolated. Python's class covers more than the library's, which is safe here.
_RUNS = re.compile(r"\s\s|\A\s|\s\Z")
_RARE_SPACE = re.compile("[\t\r\x0b\x0c]")
#: Marks that stand apart from a letter before them under both pre-tokenizers.
_MARKS = ".,!?;:%$#&*|"
#: Letters of which any run is one piece under both pre-tokenizers, and which case and composition leave alone one by one.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_ONE_PIECE = re.compile(f"[{_LETTERS}]+").fullmatch


class Encoder:
    """Ids in `dtype`, as the library gives them without added special tokens.

    `most` bounds each of the two generations of remembered words; forgetting costs time only.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.library, self.size = (_sentencepiece if path.endswith(".model") else _tokenizers)(path)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.mode, self.special = "whole", ()
        self.json = path.endswith(".json")
        if self.json:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.mode, self.special = _mode(spec), tuple(t["content"] for t in spec["added_tokens"])
        self.most = most
        self.known: dict[str, bytes] = {}  # by word as it stands after a blank, or after a line end that leads it
        self.before: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}  # by piece that no blank leads: marks, and the first word of a line
        if self.mode == "blank first":
            self.between, self.lead = "\n", " "
        elif self.mode == "blank dropped":
            self.between, self.lead = " ~ ", ""
        if self.mode != "whole":
            self.line_end = self.whole("\n").tobytes()
            self.cut = self.whole(self.between.strip(" "))[0]
            self._byte_letters()
            self._fresh()

    def _fresh(self) -> None:
        self.known, self.before, self.heads = {"": b""}, self.known, {"": b""}

    def _byte_letters(self) -> None:
        """How the pre-tokenizer spells letters and the leading blank, asked of it letter by letter."""
        letters = [chr(c) for c in range(256) if _ONE_PIECE(chr(c))]
        lower = str.lower if self.mode == "blank dropped" else str
        spell = lambda s: self.library.pre_tokenizer.pre_tokenize_str(s)[0][0]
        self.spelt = str.maketrans({c: spell("a" + lower(c))[1:] for c in letters})
        self.lead_spelt = spell(self.lead + "a")[:-1]

    def whole(self, text: str) -> np.ndarray:
        """What the library gives for the text as it is."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids if self.json else self.library.encode(text), self.dtype)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        found = list(self.in_parts(texts))
        ids, lengths = zip(*found, strict=True) if found else ([np.zeros(0, self.dtype)], [np.zeros(0, np.int64)])
        return np.concatenate(ids), np.concatenate(lengths)

    def each(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text in turn, with end_id after them."""
        for ids, lengths in self.in_parts(texts):
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            yield from np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1])

    def count_all(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        return np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.in_parts(texts, ids=False))])

    def in_parts(self, texts: list[str], ids: bool = True, at_once: int = 8_000_000) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        """ids and lengths of successive texts, about `at_once` characters at a time."""
        held, n = [], 0
        for text in texts:
            held.append(text)
            n += len(text)
            if n >= at_once:
                yield self._part(held, ids)
                held, n = [], 0
        if held:
            yield self._part(held, ids)

    def _part(self, texts: list[str], wanted: bool) -> tuple[np.ndarray | None, np.ndarray]:
        ready = [self._ready(t) for t in texts]
        lengths = np.zeros(len(texts), np.int64)
        split = np.array([k for k, t in enumerate(ready) if t is not None], np.int64)
        ids = np.zeros(0, self.dtype)
        if len(split):
            ids, lengths[split] = self._by_words([ready[k] for k in split], wanted)
        rest = {k: self.whole(texts[k]) for k, t in enumerate(ready) if t is None}
        if rest:
            pieces, at = [], 0
            for k, n in enumerate(lengths):
                if k not in rest:
                    pieces.append(ids[at : at + n])
                    at += n
                else:
                    pieces.append(rest[k])
                    lengths[k] = len(rest[k])
            ids = np.concatenate(pieces)
        return (ids if wanted else None), lengths

    def _by_words(self, texts: list[str], wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids and lengths of texts whose words stand between single blanks."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) + len(self.heads) >= self.most:
            self._fresh()
        self._learn([w for w in words if w not in self.known])
        found = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        n = size[at]
        skip = np.zeros(len(at), np.int64)
        if self.mode == "blank first":  # the line end that leads a text's first word isn't part of the text
            skip[begin] = len(self.line_end) // self.dtype.itemsize
            n -= skip
        lengths = np.add.reduceat(n, begin)
        if not wanted:
            return np.zeros(0, self.dtype), lengths
        first = (np.cumsum(size) - size)[at] + skip
        first -= np.cumsum(n) - n  # from a place in the result to one among the words' ids
        where = np.repeat(first, n)
        where += np.arange(len(where))
        return np.frombuffer(b"".join(found), self.dtype)[where], lengths

    def _ready(self, text: str) -> str | None:
        """The text with its words between single blanks, or None for one that the library gets whole.

        Where blanks lead words, a word that a line end leads keeps it, and the first word gets one.
        """
        if self.mode == "whole" or any(s in text for s in self.special):
            return None
        if self.mode == "blank dropped":
            try:  # the tokenizer lowers letters itself; in Latin-1 that is done letter by letter
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return _RARE_SPACE.sub(" ", text).replace("\n", " ")
        if not _plain(text) and (_RUNS.search(text) or _RARE_SPACE.search(text)):
            return None
        return "\n" + text.replace("\n", " \n")

    def _learn(self, missing: list[str]) -> None:
        """Make every missing word known: from the library, or from its parts."""
        known, before, heads = self.known, self.before, self.heads
        parts, new, new_heads = [], set(), set()
        for w in missing:
            if (old := before.get(w)) is not None:
                known[w] = old
                continue
            led = w[0] == "\n"
            word = w[1:] if led else w
            bare, end = word, ""
            if word[-1:] in _MARKS and (bare := word.rstrip(_MARKS)) != word:
                if bare and bare[-1].isalpha():
                    end = word[len(bare) :]
                    if end not in heads:
                        new_heads.add(end)
                else:
                    bare = word
            if led:
                if bare not in heads:
                    new_heads.add(bare)
                parts.append((w, True, bare, end))
            else:
                if bare not in known:
                    new.add(bare)
                if end:
                    parts.append((w, False, bare, end))
        self._add(new, known, self.lead, self.lead_spelt)
        self._add(new_heads, heads, "", "")
        for w, led, bare, end in parts:
            known[w] = self.line_end + heads[bare] + heads[end] if led else known[bare] + heads[end]

    def _add(self, new: set[str], to: dict[str, bytes], lead: str, lead_spelt: str) -> None:
        """Encode pieces: runs of letters one by one, the others in one call, joined so that the library splits around a token of its own between them."""
        mark, others, dtype = self.between.strip(" "), [], self.dtype
        tokenize, spelt = self.library.model.tokenize, self.spelt
        for p in new:
            if _ONE_PIECE(p):
                to[p] = np.array([t.id for t in tokenize(lead_spelt + p.translate(spelt))], dtype).tobytes()
            elif mark in p:
                to[p] = self.whole(lead + p).tobytes()
            elif p:
                others.append(p)
        if not others:
            return
        joined = self.between.join([lead + p for p in others])
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype)
        ends = (np.append(np.flatnonzero(ids == self.cut), len(ids)) * dtype.itemsize).tolist()
        raw, begin, step = ids.tobytes(), 0, dtype.itemsize
        for p, end in zip(others, ends, strict=True):
            to[p] = raw[begin:end]
            begin = end + step


def _plain(text: str) -> bool:
    """True only where all white space is single blanks and line ends inside the text (a quick test)."""
    ends = " \n"
    return not (
        text[:1] in ends or text[-1:] in ends or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    ) and text.replace("\n", "").isprintable()


def _mode(spec: dict) -> str:
    """Which splits are known from the file: blanks lead words, blanks are dropped, or none."""
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or model["type"] != "BPE" or model.get("dropout"):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "blank first"
    kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    dropping = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and split["pattern"].get("Regex") == dropping:
        return "blank dropped"
    return "whole"


def _tokenizers(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, t.get_vocab_size(with_added_tokens=True)


def _sentencepiece(path: str):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return p, p.vocab_size()


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file: Python workers serve many tasks, so pieces stay known between them."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
