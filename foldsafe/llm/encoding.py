"""Token ids of public tokenizer files, fast on texts whose words repeat.

A `.json` file is read by the `tokenizers` library, a `.model` file by `sentencepiece`. No begin, end
or added special tokens; special strings inside a text are handled as the library does by default.

Texts of two kinds of tokenizer file are cut, and the ids of the pieces, put end to end, are the ids of the text:

* byte-level without a normaliser and with the usual pattern (`can_cut`): before white space that follows a visible
  character. The pattern never joins bytes over such a place and looks no further back.
* lower case and white space dropped (`can_cut_words`): at white space, and after ASCII letters. Its pattern matches no
  white space, and its normaliser changes characters one by one or composes them with marks, which white space does not take.

Each task gives every distinct piece to the library once and keeps its ids for later batches, if the piece has at most
`_LONGEST_KEPT` bytes; a longer one, such as a whole text in a script without spaces, is encoded each time it comes. What
is kept is bounded by `_MOST_BYTES`, whatever the script. Other tokenizers get whole texts.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa

from foldsafe.llm import textarrays
from foldsafe.llm.textarrays import LOWER_TABLE, SPAN_TABLE, SPACE, WORD_TABLE, Texts

_MOST_BYTES = 1 << 27
_LONGEST_KEPT = 64
# Fixed value: the pattern of the lower-case tokenizer file that may be cut at white space.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_AFTER_LETTER = np.zeros(256, bool)
_AFTER_LETTER[0x21:0x7F] = ~_ASCII_LETTER[0x21:0x7F]
_AFTER_LETTER[ord("|")] = False
_open: dict[str, Encoder] = {}


def version(path: str) -> str:
    """Digest of the tokenizer: its file and the library that reads it."""
    import sentencepiece
    import tokenizers

    library = tokenizers if path.endswith(".json") else sentencepiece
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read())
    digest.update(f"|{library.__name__}|{library.__version__}".encode())
    return digest.hexdigest()


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class Encoder:
    def __init__(self, path: str):
        self._whole, cut = _library(path)
        self._cut = cut
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._places = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._end = 0

    def kept_bytes(self) -> int:
        """The size of everything kept for later batches."""
        return 24 * len(self._hashes) + 4 * self._end

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts (null: empty) end to end, and the number of ids of each row."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, texts in textarrays.chunks(column):
            found = self._pieces(texts) if self._cut else _joined(self._whole([texts.text(i) for i in range(len(texts))]))
            ids.append(found[0])
            counts.append(found[1])
        return np.concatenate(ids), np.concatenate(counts)

    def count(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each row's text."""
        counts = [np.zeros(0, np.int64)]
        for _, texts in textarrays.chunks(column):
            if not self._cut:
                counts.append(_joined(self._whole([texts.text(i) for i in range(len(texts))]))[1])
                continue
            starts, _, sizes = self._look_up(texts)
            counts.append(_per_row(texts, starts, sizes))
        return np.concatenate(counts)

    def _pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        starts, places, sizes = self._look_up(texts)
        run = np.concatenate(([0], np.cumsum(sizes)))
        index = np.arange(run[-1]) - np.repeat(run[:-1] - places, sizes)
        return self._ids[index], _per_row(texts, starts, sizes)

    def _look_up(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte of every piece, and where its ids lie in `_ids` until the next look-up."""
        starts, lengths, hashes = self._cut(texts)
        if not len(starts):
            return starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.kept_bytes() > _MOST_BYTES:
            self._forget()
        slots, known = self._find(hashes)
        if known.all():
            return starts, self._places[slots], self._sizes[slots]
        _, one, owner = np.unique(hashes[~known], return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~known)[one]
        # Long pieces come last: their ids stay behind the end, where the next ones are written over them.
        order = np.argsort(lengths[fresh] > _LONGEST_KEPT, kind="stable")
        places, sizes = self._learn(texts, hashes[fresh[order]], starts[fresh[order]], lengths[fresh[order]])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        all_places, all_sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if known.any():
            slots, _ = self._find(hashes[known])
            all_places[known], all_sizes[known] = self._places[slots], self._sizes[slots]
        all_places[~known], all_sizes[~known] = places[back][owner], sizes[back][owner]
        return starts, all_places, all_sizes

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self._hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        slots = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        return slots, self._hashes[slots] == hashes

    def _learn(
        self, texts: Texts, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Encode new pieces, short ones first; where their ids lie. Short ones are kept."""
        body = texts.data.tobytes()
        ids, sizes = _joined(self._whole([
            body[s: s + n].decode("utf-8", "replace") for s, n in zip(starts.tolist(), lengths.tolist())
        ]))
        if self._end + len(ids) > len(self._ids):
            self._ids = np.concatenate((self._ids[: self._end], np.zeros(self._end + 2 * len(ids), np.uint32)))
        self._ids[self._end: self._end + len(ids)] = ids
        places = self._end + np.cumsum(sizes) - sizes
        short = int((lengths <= _LONGEST_KEPT).sum())
        order = np.argsort(hashes[:short], kind="stable")
        at = np.searchsorted(self._hashes, hashes[:short][order])
        self._hashes = np.insert(self._hashes, at, hashes[:short][order])
        self._places = np.insert(self._places, at, places[:short][order])
        self._sizes = np.insert(self._sizes, at, sizes[:short][order])
        self._end += int(sizes[:short].sum())
        return places, sizes


def _byte_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and hash of the pieces between cuts."""
    starts = cuts(texts)
    if not len(starts):
        return starts, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(texts.data)))
    return starts, lengths, textarrays.combine(texts.hashes(starts, SPAN_TABLE), lengths.astype(np.uint64))


def _word_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the words between white space, cut once more after each run of ASCII letters.

    No match of the pattern goes on from an ASCII letter to another visible ASCII character. The special strings do, to
    `|`, before which there is no cut. Without special strings the case of A-Z makes no difference.
    """
    data = texts.data
    starts, _ = texts.words()
    if not len(starts):
        return starts, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = np.zeros(len(data), bool)
    begins[1:] = _ASCII_LETTER[data[:-1]] & _AFTER_LETTER[data[1:]]
    begins[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = False
    begins[starts] = True
    starts = np.flatnonzero(begins)
    lengths = np.add.reduceat(~texts.spaces(), starts, dtype=np.int32).astype(np.int64)
    table = WORD_TABLE if b"<|" in data.tobytes() else LOWER_TABLE
    return starts, lengths, textarrays.combine(texts.hashes(starts, table), lengths.astype(np.uint64))


def cuts(texts: Texts) -> np.ndarray:
    """Row starts, and ASCII white space after a byte that surely ends a visible character."""
    data = texts.data
    if not len(data):
        return np.zeros(0, np.int64)
    before = data[:-1]
    one, two, three = (np.concatenate((np.zeros(k, np.uint8), data[: max(0, len(before) - k)]))[: len(before)] for k in (1, 2, 3))
    # White space outside ASCII: lead C2; E1 and E2; E3 with 80 as second byte. No other two-byte, three-byte or
    # four-byte character is white space. A lead byte is at C2 or above, so the tests below never take one for another.
    tail = before >= 0x80
    visible = (before > 0x20) & (before < 0x7F)
    visible |= tail & (one >= 0xC3) & (one <= 0xDF)
    inner = tail & (one >= 0x80) & (one < 0xC0)
    visible |= inner & ((two == 0xE0) | ((two >= 0xE4) & (two <= 0xEF)) | ((two == 0xE3) & (one != 0x80)))
    visible |= inner & (two >= 0x80) & (two < 0xC0) & (three >= 0xF0)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = SPACE[data[1:]] & visible
    begins[texts.offsets[:-1]] = True
    return np.flatnonzero(begins[:-1])


def _per_row(texts: Texts, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(sizes)))
    edges = np.searchsorted(starts, texts.offsets)
    return run[edges[1:]] - run[edges[:-1]]


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    flat = [i for x in lists for i in x]
    return np.array(flat, np.uint32), counts


def can_cut(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose texts may be cut at white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    special = [t for t in spec.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")
               or any(c.isspace() for c in t["content"])]
    return bool(plain) and not spec.get("normalizer") and not special and not spec.get("truncation") \
        and not (spec.get("model") or {}).get("ignore_merges")


def can_cut_words(path: str) -> bool:
    """Whether a tokenizer file is of the kind that drops white space, so that its texts may be cut there."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", []) if normal.get("type") == "Sequence" else [normal]
    plain = all(
        n.get("type") in ("NFC", "Lowercase")
        or (n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " ")
        for n in steps
    )
    before = spec.get("pre_tokenizer") or {}
    parts = before.get("pretokenizers", []) if before.get("type") == "Sequence" else []
    split = len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": _WORD_PATTERN} \
        and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[1].get("type") == "ByteLevel" \
        and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
    special = [t for t in spec.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")
               or t.get("normalized") or any(c.isspace() for c in t["content"])]
    return plain and bool(split) and not special and not spec.get("truncation")


def _library(path: str):
    """A function from texts to lists of ids, and one that cuts texts into pieces, if they may be cut."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        cut = _byte_pieces if can_cut(path) else _word_pieces if can_cut_words(path) else None
        return lambda texts: [made.encode(t, add_special_tokens=False).ids for t in texts], cut
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: pieces.encode(texts, num_threads=1), None
