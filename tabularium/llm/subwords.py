"""Subword ids by a published vocabulary, word by word, with a bounded memory of words seen."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np

#: A vocabulary of ranks; see the folder's own text. Another path is a parameter of each operator.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words remembered by a task.
REMEMBERED = 400_000
#: The usual pattern that cuts text before byte pairs are joined; a fixed value of such vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def encoding(path: str = TOKENIZER):  # noqa: ANN201
    """The encoding, once for each worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


class Words(dict):
    """From a word (bytes) to a value of it; forgets all when it holds too many."""

    def __init__(self, value: Callable[[bytes], object], most: int = REMEMBERED):
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, word: bytes) -> object:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.value(word)
        return out


def counter(path: str = TOKENIZER) -> Callable[[bytes], int]:
    """Counts the ids of a text: those of its words, each with a space before it."""
    own = encoding(path)
    sizes = Words(lambda word: len(own.encode_ordinary(" " + word.decode("utf-8", "replace"))))
    return lambda data: sum(map(sizes.__getitem__, data.split()))


def vocabulary_size(path: str = TOKENIZER) -> int:
    return encoding(path).n_vocab


def ids_of(path: str = TOKENIZER) -> Callable[[bytes], np.ndarray]:
    own = encoding(path)
    return lambda word: np.array(own.encode_ordinary(" " + word.decode("utf-8", "replace")), np.int32)


#: Words that are cut into ids together.
TOGETHER = 20_000


def splitter(path: str = TOKENIZER) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Cuts many words at once: the ids of all, one after the other, and how many each has; each word has a space before it."""
    own = encoding(path)
    lengths = np.array([len(own.decode_single_token_bytes(k)) for k in range(own.n_vocab)], np.int64)

    def part(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(own.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int32)
        ends, stops = np.cumsum(lengths[ids]), np.cumsum([len(w) + 1 for w in words])
        last = np.searchsorted(ends, stops)
        if np.array_equal(np.append(ends, -1)[last], stops):
            return ids, np.diff(last, prepend=-1)
        # an id reached over the end of a word, as unusual white space can make it
        each = [np.array(own.encode_ordinary(" " + w.decode("utf-8", "replace")), np.int32) for w in words]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def run(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [part(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        return np.concatenate([*(x for x, _ in parts), np.zeros(0, np.int32)]), np.concatenate([*(x for _, x in parts), np.zeros(0, np.int64)])

    return run
