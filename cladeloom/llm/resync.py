"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both agree.

A text of at most `chunk` characters is encoded at once (word by word, each distinct word once per worker, where the
vocabulary drops blanks and no unit crosses one). A longer one is cut into windows of `chunk` characters
that overlap by `overlap`, each encoded with offsets. Two neighbours are spliced at a position of their overlap
where both begin a new unit and where no later or earlier text can change that:

* tokenizers files (.json): a unit is a pre-token or an added token. The split pattern reads from left to right
  and looks at most one character beyond a match, so two readings that begin a unit at the same place go on
  alike; the left window must hold the longest added token after that place, and the character there must be one
  that never composes with what stands before it. Files whose steps are not of this kind are not chunked.
* sentencepiece files (.model): a unit is a piece that begins with the mark of a blank after a non-blank. No piece
  of the vocabulary has that mark after another character, so no merge can reach across. Files that have such
  pieces, or whose normalizer changes the text, are not chunked.

Where the overlap holds no such position (one unit spans it) it is doubled, up to the end of the text, and the
windows are encoded again. So counts always equal those of the whole text. A task holds one text and two windows.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each by itself; further columns are
carried in `row`, so no name can clash.
"""
from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeloom.llm.text import scan, string_buffers

#: Characters of a window and of the overlap of two windows.
CHUNK, OVERLAP = 65_536, 1024
#: Texts, or words, encoded in one call of the library, and words whose sizes a worker remembers.
CALL_TEXTS, CALL_WORDS, MEMORY_WORDS = 256, 4096, 700_000
#: The sign that stands for a blank in sentencepiece vocabularies.
BLANK = "▁"


class Window:
    """The encoding of text[begin:end]: its number of tokens, and each unit's position with the tokens before it."""

    def __init__(self, begin: int, end: int, size: int, units: np.ndarray, before: np.ndarray):
        self.begin, self.end, self.size, self.units, self.before = begin, end, size, units, before

    def tokens_before(self, position: int) -> int:
        return int(self.before[np.searchsorted(self.units, position)])


class JsonVocabulary:
    """A file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = spec["added_tokens"]
        self.margin = max([len(t["content"]) for t in added], default=0) + 2
        self.chunked = (spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
                        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
                        and all(_local_normalizer(s) for s in _steps(spec["normalizer"], "normalizers"))
                        and all(_local_splitter(s) for s in _steps(spec["pre_tokenizer"], "pretokenizers")))
        # where blanks are dropped and end every unit, a text's size is the sum over its words
        self.by_words = self.chunked and not any(" " in t["content"] for t in added) and any(_drops_blanks(s) for s in _steps(spec["pre_tokenizer"], "pretokenizers"))
        self.known: dict[str, int] = {}

    def sizes(self, texts: list[str]) -> list[int]:
        if not self.by_words:
            return self._encode(texts)
        words = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        new = list(set().union(*words).difference(self.known))
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.known.clear()
            new = list(set().union(*words))
        for at in range(0, len(new), CALL_WORDS):
            call = new[at:at + CALL_WORDS]
            self.known.update(zip(call, self._encode(call)))
        size = self.known.__getitem__
        return [sum(map(size, w)) for w in words]

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def window(self, text: str, begin: int, end: int) -> Window:
        e = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        offsets = e.offsets  # the library makes this list anew at every access
        starts = np.array([offsets[i][0] for i in first.tolist()], np.int64) + begin
        return Window(begin, end, len(word), starts, first)

    def stable(self, text: str, position: int) -> bool:
        """Characters before U+0300, Han, kana without sound marks and Hangul syllables never compose with earlier ones;
        U+0130 is left out because its lower case is two characters, of which a unit may begin with the second."""
        c = ord(text[position])
        return c < 0x300 and c != 0x130 or 0x3041 <= c <= 0x9FFF and c not in (0x3099, 0x309A) or 0xAC00 <= c <= 0xD7A3


class PieceVocabulary:
    """A file of the sentencepiece library."""

    margin = 2

    def __init__(self, path: str):
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = "a  b ﬁ \tＡ "
        crossing = any(BLANK in self.pieces.id_to_piece(i).lstrip(BLANK) for i in range(self.pieces.get_piece_size()))
        self.chunked = not crossing and self.pieces.normalize(plain).lstrip(BLANK) == plain.replace(" ", BLANK)

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]

    def window(self, text: str, begin: int, end: int) -> Window:
        part = text[begin:end]
        pieces = self.pieces.encode(part, out_type=str)
        # a window's first unit has the blank that the library puts in front, so it is no place to splice
        blanks = [i for i, c in enumerate(part) if c == " " and i and part[i - 1] != " "]
        at = [i for i, p in enumerate(pieces) if p[0] == BLANK and i and pieces[i - 1][-1] != BLANK]
        if len(blanks) != len(at):
            raise AssertionError("blanks and pieces do not match")
        units, before = np.array([0, *blanks], np.int64) + begin, np.array([0, *at], np.int64)
        return Window(begin, end, len(pieces), units, before)

    def stable(self, text: str, position: int) -> bool:
        return text[position] == " " and position > 0 and text[position - 1] != " "


def _steps(part: dict | None, key: str) -> list[dict]:
    if not part:
        return []
    return [s for p in part[key] for s in _steps(p, key)] if part["type"] == "Sequence" else [part]


def _local_normalizer(step: dict) -> bool:
    """Steps that change characters one by one, by canonical composition, or runs of white space as a whole."""
    return step["type"] in ("NFC", "Lowercase") or step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"}


def _local_splitter(step: dict) -> bool:
    """Patterns that do not look back, and the byte alphabet."""
    if step["type"] == "Split":
        return "(?<" not in step["pattern"].get("Regex", "(?<")
    return step["type"] == "ByteLevel" and not step["add_prefix_space"]


def _drops_blanks(step: dict) -> bool:
    """A split that keeps only its matches, none of which can hold white space."""
    pattern = step["pattern"].get("Regex", " ") if step["type"] == "Split" else " "
    rest = re.sub(r"\[\^\\s[^\]]*\]", "", pattern)
    return step.get("behavior") == "Removed" and step.get("invert") is True and not re.search(r"[ .]|\\s|\\[A-Z]|\[\^", rest)


def common_position(text: str, left: Window, right: Window, vocabulary: JsonVocabulary | PieceVocabulary) -> int | None:
    """The first proven boundary of both windows within their overlap."""
    lo, hi = np.searchsorted(left.units, [right.begin + 1, left.end - vocabulary.margin + 1])
    for p in np.intersect1d(left.units[lo:hi], right.units, assume_unique=False).tolist():
        if vocabulary.stable(text, p):
            return p
    return None


def chunked_size(text: str, vocabulary: JsonVocabulary | PieceVocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a long text, by windows."""
    n, total, start = len(text), 0, None  # start: the splice that the left window is counted from
    left = vocabulary.window(text, 0, min(n, chunk + overlap))
    while left.end < n:
        begin, wide = left.end - overlap, overlap
        right = vocabulary.window(text, begin, min(n, begin + chunk + overlap))
        while (p := common_position(text, left, right, vocabulary)) is None and left.end < n:
            wide *= 2
            left = vocabulary.window(text, left.begin, min(n, begin + wide))
            right = vocabulary.window(text, begin, min(n, left.end + chunk))
        if p is None:
            break
        total += left.tokens_before(p) - (0 if start is None else left.tokens_before(start))
        left, start = right, p
    return total + left.size - (0 if start is None else left.tokens_before(start))


_vocabularies: dict[str, JsonVocabulary | PieceVocabulary] = {}


def vocabulary_of(path: str) -> JsonVocabulary | PieceVocabulary:
    """The worker's vocabulary, kept between tasks."""
    if path not in _vocabularies:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _vocabularies.clear()
        _vocabularies[path] = (PieceVocabulary if path.endswith(".model") else JsonVocabulary)(path)
    return _vocabularies[path]


def sizes(texts: list[str], vocabulary: JsonVocabulary | PieceVocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Number of tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk or not vocabulary.chunked]
    for at in range(0, len(short), CALL_TEXTS):
        call = short[at:at + CALL_TEXTS]
        out[call] = vocabulary.sizes([texts[i] for i in call])
    for i in sorted(set(range(len(texts))) - set(short)):
        out[i] = chunked_size(texts[i], vocabulary, chunk, overlap)
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, carry: list[str] | None = None) -> DataFrame:
    """(row, n_bytes, n_tokens, over_limit) of every text: UTF-8 bytes, tokens of the vocabulary file, and whether
    these are more than `limit`."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must lie between 1 and the chunk")

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        vocabulary = vocabulary_of(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            n_bytes = np.diff(string_buffers(texts)[1])
            n = sizes([t or "" for t in texts.to_pylist()], vocabulary, chunk, overlap)
            return [pa.array(n_bytes), pa.array(n), pa.array(n > limit)]

        return work

    return scan(docs, make, "n_bytes long, n_tokens long, over_limit boolean", carry)
