"""Token ids of white-space separated words, many texts at a time.

The tokenizer drops white space and never joins what white space parts, so the ids
of a text are those of its words, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once.
SLICE_BYTES = 4 << 20


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_bytes(tokenizer) -> np.ndarray:
    """Bytes each token stands for, in a vocabulary that writes a byte as a character."""
    vocab = tokenizer.get_vocab()
    end = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
    for token, i in vocab.items():
        sizes[i] = len(token.removesuffix(end))
    return sizes


def encode_words(tokenizer, words: list[str], sizes: np.ndarray, together: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has.

    Words go to the tokenizer in joined texts. Words in ASCII are parted by blanks, and
    their ids are told apart by the bytes that ``sizes`` gives the tokens; that has to
    come out even at every word, or they go with the others. These have a special
    token after each word, and words that might hold one themselves go alone.
    """
    mark, mark_id = next(
        (t.content, i) for i, t in sorted(tokenizer.get_added_tokens_decoder().items()) if t.special
    )
    ascii_, marked, special = [], [], []
    for i, w in enumerate(words):
        (special if "<|" in w else ascii_ if w.isascii() else marked).append(i)
    flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]

    def encoded(some: list[int], after: str) -> np.ndarray:
        text = after.join([words[i] for i in some]) + after
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    even: list[int] = []
    for at in range(0, len(ascii_), together):
        some = ascii_[at : at + together]
        ids = encoded(some, " ")
        word_ends = np.cumsum(np.fromiter((len(words[i]) for i in some), np.int64, len(some)))
        token_ends = np.cumsum(sizes[ids])
        ends = np.searchsorted(token_ends, word_ends, side="right")
        if len(ids) and ends.all() and (token_ends[ends - 1] == word_ends).all() and ends[-1] == len(ids):
            even += some
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        else:
            marked += some
    for at in range(0, len(marked), together):
        ids = encoded(marked[at : at + together], mark)
        marks = ids == mark_id
        flat.append(ids[~marks])
        lengths.append(np.diff(np.flatnonzero(marks), prepend=-1) - 1)
    for i in special:
        flat.append(np.array(tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32))
        lengths.append(np.array([len(flat[-1])]))
    ids, counts = np.concatenate(flat), np.concatenate(lengths)
    place = np.argsort(np.array(even + marked + special, np.int64))
    return gather((np.cumsum(counts) - counts)[place], counts[place], ids), counts[place]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(sizes[to - 1])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words, the words as positions in a dictionary, and that dictionary."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """``flat[starts[i] : starts[i] + lengths[i]]`` of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class WordIds:
    """Ids of the words met so far. Past ``most`` words it starts anew, so its size is bounded."""

    def __init__(self, tokenizer, most: int | None = 600_000):
        self._tokenizer, self._most = tokenizer, most
        self._sizes = token_bytes(tokenizer)
        self._clear()

    def _clear(self) -> None:
        self._slot: dict[str, int] = {}
        self._starts, self._lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self._flat = np.empty(0, np.uint32)

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where the distinct words are kept; new ones are encoded."""
        if self._most is not None and len(self._slot) > self._most:
            self._clear()
        new = [w for w in words if w not in self._slot]
        if new:
            flat, lengths = encode_words(self._tokenizer, new, self._sizes)
            self._slot.update(zip(new, range(len(self._slot), len(self._slot) + len(new))))
            self._starts = np.concatenate((self._starts, len(self._flat) + np.cumsum(lengths) - lengths))
            self._lengths = np.concatenate((self._lengths, lengths))
            self._flat = np.concatenate((self._flat, flat))
        return np.fromiter(map(self._slot.__getitem__, words), np.int64, len(words))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        slots = self._slots(words)
        lengths = self._lengths[slots]
        return gather(self._starts[slots], lengths, self._flat), lengths

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        offsets, index, dictionary = split_words(texts)
        slots = self._slots(dictionary.to_pylist())[index]
        lengths = self._lengths[slots]
        ends = np.concatenate(([0], np.cumsum(lengths)))[offsets]
        return gather(self._starts[slots], lengths, self._flat), np.diff(ends)
