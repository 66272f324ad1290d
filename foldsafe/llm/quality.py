"""Line-first cleaning: judge every line, drop the failing ones, reject documents that lose too much.

A line is what stands between two `\\n`. A line with words fails by one of these rules, the first
that holds:

* ``symbols``: more than one symbol of ``#*$%&|<>`` per five words (markup, tables, menus);
* ``navigation``: two or more separators ``|`` or ``>`` that are over a tenth of its words, or menu phrases
  (`MENU`) that hold over a quarter of them;
* ``boilerplate``: a legal, cookie or script notice (`BOILERPLATE`), in lines of up to 20 words. Of longer
  lines only the sentences that hold the phrase go, and only those of up to 40 words: a longer one is prose;
* ``shouting``: most ASCII letters are capitals, in lines of three words or more;
* ``stutter``: over 30 % of its words equal the word before them, in lines of five words or more;
* ``copies``: the text has this line at least twice above;
* ``punctuation``: it does not end in closing punctuation and no word before its last does (a line of
  prose that is cut off in its last sentence stays). Sentence marks of all scripts count, wherever they stand
  (many scripts write no spaces); lines mostly in a script without such marks (Thai, Lao, Tai) pass.

Phrases count at word boundaries only. Counts of lines hold those removed whole; the words of removed
sentences count as removed. Lines without words are kept as they are. A document is rejected if it fails the base rules (fewer
than 20 words, or over 30 % of its words inside repeated 8-word windows), or if what is removed
holds over `most_lost` of its words.

Null text: no words, so it is rejected; its `clean_text` is null. Rows repeat or tie freely: each is
judged alone. Extra columns pass through; `clean_lines` replaces a column of the input with a result's name, in
any case of letters, and `kept_documents` keeps every column of the input as it was.
The work is one narrow pass: no shuffle, memory bounded by a chunk of text or the longest text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.llm import textarrays
from foldsafe.llm.frames import keep_names, mapped
from foldsafe.llm.textarrays import Texts, combine, mix

MOST_LOST = 0.5
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SEPARATORS_IN = 10  # words a separator, at most, in a menu
PHRASES_IN = 4  # words a word of a menu phrase, at most, in a menu
SHORT_LINE = 20
LONGEST_NOTICE = 40
# Phrases of notices and menus, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "enable javascript", "lorem ipsum",
)
MENU = ("skip to content", "sign in", "log in", "click here", "read more", "subscribe to", "share this", "back to top")
RULES = ("symbols", "navigation", "boilerplate", "shouting", "stutter", "copies", "punctuation")
RESULT = T.StructType(
    [T.StructField("clean_text", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed",
        "n_words_removed")]
    + [T.StructField(f"lines_{r}", T.LongType()) for r in RULES]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def _marks(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_SYMBOL = _marks("#*$%&|<>")
_SEPARATOR = _marks("|>")
_UPPER, _LOWER = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("abcdefghijklmnopqrstuvwxyz")
_CLOSING = _marks(".!?:;\"')]}")
# Fixed values, by code point: what ends a sentence (Unicode's Sentence_Terminal, and the marks of Hebrew, Tibetan,
# Greek and Armenian that do so), what stands where : and ; do, and scripts that have no such marks.
_ENDS = (
    "37E 55C 55E 589 5C3 61D-61F 6D4 700-702 7F9 837 839 83D-83E 964-965 F08 F0D-F12 104A-104B 1362 1367-1368 166E "
    "1735-1736 17D4-17D5 1803 1809 1944-1945 1AA8-1AAB 1B4E-1B4F 1B5A-1B5B 1B5E-1B5F 1B7D-1B7F 1C3B-1C3C 1C7E-1C7F 2024 "
    "2026 203C-203D 2047-2049 2CF9-2CFB 2E2E 2E3C 2E53-2E54 3002 A4FF A60E-A60F A6F3 A6F7 A876-A877 A8CE-A8CF A92F "
    "A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB FE12 FE15-FE16 FE52 FE56-FE57 FF01 FF0E FF1F FF61 10A56-10A57 10F55-10F59 "
    "10F86-10F89 11047-11048 110BE-110C1 11141-11143 111C5-111C6 111CD 111DE-111DF 11238-11239 1123B-1123C 112A9 "
    "113D4-113D5 1144B-1144C 115C2-115C3 115C9-115D7 11641-11642 1173C-1173E 11944 11946 11A42-11A43 11A9B-11A9C "
    "11C41-11C42 11EF7-11EF8 11F43-11F44 16A6E-16A6F 16AF5 16B37-16B38 16B44 16D6E-16D6F 16E98 1BC9F 1DA88"
)
_PAUSES = "387 61B 703-709 1361 1364-1366 17D6 1804 1808 2E35 A6F4 A6F6 FE13-FE14 FE54-FE55 FF1A-FF1B"
_UNMARKED = "E00-E7F E80-EFF 1950-197F 1980-19DF AA80-AADF"
_END, _CLOSE, _BARE = 1, 2, 4
_MOST_POINTS = 0x20000  # none of these lies above


def _points() -> np.ndarray:
    """The kind of each code point from 0x80."""
    kinds = np.zeros(_MOST_POINTS, np.uint8)
    for listed, kind in ((_ENDS, _END), (_PAUSES, _CLOSE), (_UNMARKED, _BARE)):
        for span in listed.split():
            low, _, high = span.partition("-")
            kinds[int(low, 16): int(high or low, 16) + 1] |= kind
    # Closing brackets and all quotes: German closes with the mark that opens in English.
    for i in range(0x80, _MOST_POINTS):
        if unicodedata.category(chr(i)) in ("Pe", "Pf", "Pi"):
            kinds[i] |= _CLOSE
    return kinds


_KIND = _points()
_STOP, _QUOTE = _marks(".!?"), _marks("\"')]}")
_PHRASES = {"boilerplate": [p.encode() for p in BOILERPLATE], "navigation": [p.encode() for p in MENU]}
_LETTER = _marks("0123456789_") | _UPPER | _LOWER | (np.arange(256) >= 0x80)
# Bytes that begin a mark and no letter: Latin-1 signs, general punctuation, CJK punctuation.
_WIDE_MARK = ((b"\xc2",), (b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"))


def clean_lines(df: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """Every row with its cleaned text, the counts behind the verdict, and `kept`."""
    made = {n.lower() for n in RESULT.names}
    rest = [f for f in df.schema.fields if f.name.lower() not in made]
    schema = T.StructType(rest + RESULT.fields)
    names = [f.name for f in rest]

    def judge(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(batch.schema.get_field_index(text))
        parts = [_judged(texts, most_lost) for _, texts in textarrays.chunks(column)]
        missing = column.is_null().to_numpy(zero_copy_only=False)
        out = {}
        for field in RESULT.fields:
            if field.name == "clean_text":
                flat = [s for p in parts for s in p["clean_text"]]
                out[field.name] = pa.array([None if m else s for s, m in zip(flat, missing)], pa.string())
            else:
                out[field.name] = pa.array(np.concatenate([p[field.name] for p in parts]) if parts else [])
        return out

    return mapped(df, judge, schema, keep_names(names))


def _count(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def repeated_words(rows: np.ndarray, hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks the words inside a window of words that its text has more than once."""
    n = len(rows) - window + 1
    marks = np.zeros(len(rows), bool)
    if n <= 0:
        return marks
    inside = rows[:n] == rows[window - 1:]
    rolled = mix(rows[:n].astype(np.uint64))
    for i in range(window):
        rolled = combine(rolled, hashes[i: i + n])
    begins = np.flatnonzero(inside)
    rolled = rolled[begins]
    order = np.argsort(rolled)
    same = rolled[order[1:]] == rolled[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    steps = np.zeros(len(rows) + 1, np.int64)
    found = begins[twice]
    np.add.at(steps, found, 1)
    np.add.at(steps, found + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _places(data: bytes, phrase: bytes) -> Iterator[int]:
    at = data.find(phrase)
    while at >= 0:
        yield at
        at = data.find(phrase, at + 1)


def _phrases(
    data: np.ndarray, lowered: bytes, phrases: list[bytes], begins: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and line of every phrase that stands between word boundaries inside a line."""
    found = [(at, at + len(p)) for p in phrases for at in _places(lowered, p)]
    first, last = np.array(sorted(found), np.int64).reshape(-1, 2).T
    line = np.searchsorted(begins, first, side="right") - 1
    inside = last <= ends[line]
    first, last, line = first[inside], last[inside], line[inside]
    open_, close = first == begins[line], last == ends[line]
    open_[~open_] = ~_LETTER[data[first[~open_] - 1]]
    close[~close] = ~_LETTER[data[last[~close]]]
    two, three = _WIDE_MARK
    for i in np.flatnonzero(~open_):
        before = lowered[max(begins[line[i]], first[i] - 3): first[i]]
        open_[i] = before[-2:].startswith(two) or before.startswith(three)
    for i in np.flatnonzero(~close):
        close[i] = lowered[last[i]: last[i] + 2].startswith(two + three)
    ok = open_ & close
    return first[ok], last[ok], line[ok]


def _notices(
    texts: Texts, hits: tuple[np.ndarray, np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray],
    closed: np.ndarray, long: np.ndarray, line_ends: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Marks the bytes and the words of sentences that hold a phrase, in long lines."""
    bytes_, marks = np.zeros(len(texts.data), bool), np.zeros(len(words[0]), bool)
    starts, line_of = words
    if not long[hits[2]].any():
        return bytes_, marks
    # A sentence is a run of words up to one that closes it, or to the end of the line.
    opens = np.ones(len(starts), bool)
    opens[1:] = closed[:-1] | (line_of[1:] != line_of[:-1])
    sentence = np.cumsum(opens) - 1
    heads = np.append(np.flatnonzero(opens), len(starts))
    ends = np.append(starts[1:], len(texts.data))
    for first, last, line in zip(*hits):
        if not long[line]:
            continue
        low, high = np.searchsorted(starts, (first, last - 1), side="right") - 1
        low, high = heads[sentence[low]], heads[sentence[high] + 1]
        if high - low <= LONGEST_NOTICE:
            marks[low:high] = True
            # The white space after it goes too, but no line break.
            until = high - 1 if high < len(starts) and line_of[high] == line else None
            stop = ends[until] if until is not None else _word_end(texts.data, starts[high - 1], line_ends[line])
            bytes_[starts[low]: stop] = True
    return bytes_, marks


def _word_end(data: np.ndarray, start: int, end: int) -> int:
    at = start
    while at < end and not textarrays.SPACE[data[at]]:
        at += 1
    return at


def _earlier_copies(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each line how many lines before it in its text are equal."""
    keys = combine(mix(rows.astype(np.uint64)), hashes)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    heads = np.ones(len(keys), bool)
    heads[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.maximum.accumulate(np.where(heads, np.arange(len(keys)), 0))
    before = np.empty(len(keys), np.int64)
    before[order] = np.arange(len(keys)) - first
    return before


def _judged(texts: Texts, most_lost: float) -> dict[str, np.ndarray | list]:
    n, data = len(texts), texts.data
    starts, word_rows = texts.words()
    word_hashes = texts.hashes(starts, textarrays.WORD_TABLE)
    repeats = repeated_words(word_rows, word_hashes)
    begins, ends, line_rows = texts.lines()
    line_hashes = combine(texts.hashes(begins, textarrays.LINE_TABLE), (ends - begins).astype(np.uint64))
    line_of = np.searchsorted(begins, starts, side="right") - 1
    words = _count(line_of, len(begins))
    has = words > 0
    fails = np.zeros(len(begins), np.int64)  # 0: passes, else 1 + index of its rule

    def sums(table: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return run[ends] - run[begins]

    lowered = data.tobytes().lower()

    def phrases(rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _phrases(data, lowered, _PHRASES[rule], begins, ends)

    menus, notices = phrases("navigation"), phrases("boilerplate")
    menu_words = np.bincount(menus[2], _words_of(lowered, menus), len(begins))
    long = words > SHORT_LINE
    closed, sentence_ends = _closed(data, starts, line_of, ends, len(begins))
    cut, cut_words = _notices(texts, notices, (starts, line_of), sentence_ends, long, ends)
    upper, lower, separators = sums(_UPPER), sums(_LOWER), sums(_SEPARATOR)
    equal = np.zeros(len(starts), bool)
    if len(starts):
        equal[1:] = (word_hashes[1:] == word_hashes[:-1]) & (line_of[1:] == line_of[:-1])
    before = _earlier_copies(line_rows, line_hashes) if len(begins) else np.zeros(0, np.int64)
    verdicts = {
        "symbols": 5 * sums(_SYMBOL) > words,
        "navigation": ((separators >= 2) & (SEPARATORS_IN * separators > words)) | (PHRASES_IN * menu_words > words),
        "boilerplate": (_count(notices[2], len(begins)) > 0) & ~long | has & (_count(line_of[cut_words], len(begins)) == words),
        "shouting": (words >= 3) & (upper > lower),
        "stutter": (words >= 5) & (10 * _count(line_of[equal], len(begins)) > 3 * words),
        "copies": before >= 2,
        "punctuation": ~closed,
    }
    for i, rule in reversed(list(enumerate(RULES))):
        fails[verdicts[rule] & has] = i + 1
    gone = fails > 0
    lost = _count(word_rows[gone[line_of] | cut_words], n) if len(starts) else np.zeros(n, np.int64)
    n_words, repeated = _count(word_rows, n), _count(word_rows[repeats], n)
    characters = texts.characters()
    base_failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
    found = {
        "clean_text": _without(texts, begins, gone, cut),
        "n_words": n_words,
        "word_chars": texts.sums(characters & ~texts.spaces()),
        "n_symbols": texts.sums(_SYMBOL[data]),
        "n_dup_lines": _count(line_rows[has & (before > 0)], n),
        "n_repeat_words": repeated,
        "n_lines": _count(line_rows[has], n),
        "n_lines_removed": _count(line_rows[gone], n),
        "n_words_removed": lost,
        "base_failed": base_failed,
        "kept": ~base_failed & (lost <= most_lost * n_words),
    }
    return found | {f"lines_{r}": _count(line_rows[fails == i + 1], n) for i, r in enumerate(RULES)}


def _words_of(lowered: bytes, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[int]:
    return [len(lowered[a:b].split()) for a, b, _ in zip(*hits)]


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and code point of the characters outside ASCII."""
    places = np.flatnonzero(data >= 0xC0)
    first = data[places].astype(np.int64)
    lengths = 2 + (first >= 0xE0) + (first >= 0xF0)
    points = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[lengths]
    for i in (1, 2, 3):
        more = lengths > i
        points[more] = points[more] << 6 | data[places[more] + i] & 0x3F
    return places, lengths, points


def _closed(
    data: np.ndarray, starts: np.ndarray, line_of: np.ndarray, ends: np.ndarray, n_lines: int
) -> tuple[np.ndarray, np.ndarray]:
    """Marks lines that have closing punctuation at the end of a word, a sentence mark outside ASCII anywhere, or most
    letters from a script without marks; and words that end a sentence."""
    closed = np.zeros(n_lines, bool)
    if not len(starts):
        return closed, np.zeros(0, bool)
    space = textarrays.SPACE[data]
    at_end = np.append(space[1:], True)
    at_end[ends[line_of] - 1] = True
    tails = np.flatnonzero(~space & at_end)
    ok, stops = _CLOSING[data[tails]], _STOP[data[tails]]
    stops |= _QUOTE[data[tails]] & (tails > starts) & _STOP[data[tails - 1]]
    places, lengths, points = _wide(data)
    kinds = _KIND[np.minimum(points, _MOST_POINTS - 1)]
    word = np.searchsorted(starts, places, side="right") - 1
    if len(places):
        last = places + lengths - 1 == tails[word]
        closes = last & ((kinds & (_END | _CLOSE)) > 0)
        ok[word[closes]] = True
        closed[line_of[word[(kinds & _END) > 0]]] = True
        stops[word[last & ((kinds & _END) > 0)]] = True
        # A quote or bracket after the mark, ASCII or not.
        quoted = last & ((kinds & _CLOSE) > 0) & (places > starts[word])
        stops[word[quoted]] |= _STOP[data[places[quoted] - 1]]
        marks = np.zeros(len(data) + 1, bool)
        marks[(places + lengths)[(kinds & _END) > 0]] = True
        stops[word[quoted]] |= marks[places[quoted]]
        stops |= _QUOTE[data[tails]] & (tails > starts) & marks[tails]
        bare = _count(line_of[word[(kinds & _BARE) > 0]], n_lines)
        if bare.any():
            run = np.concatenate(([0], np.cumsum((_UPPER | _LOWER)[data], dtype=np.int64)))
            begin = np.append(0, ends[:-1])
            closed |= 2 * bare > run[ends] - run[begin] + _count(line_of[word], n_lines)
    closed[line_of[ok]] = True
    return closed, stops


def _without(texts: Texts, begins: np.ndarray, gone: np.ndarray, cut: np.ndarray) -> list[str]:
    """Each row's text without its removed lines and the cut bytes; a line goes with the line break after it."""
    if gone.any() or cut.any():
        spans = np.diff(np.append(begins, len(texts.data)))
        keep = np.repeat(~gone, spans) & ~cut if len(begins) else np.zeros(0, bool)
        kept = texts.data[keep]
        lengths = texts.sums(keep)
        texts = Texts(kept, np.concatenate(([0], np.cumsum(lengths))))
    return [texts.text(i) for i in range(len(texts))]


def kept_documents(df: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """The documents that pass, with cleaned text, in the columns they came with, whatever their names."""
    others = [c for c in df.columns if c != text]
    # The other columns travel in one struct, by place, so none meets a result's name.
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(True).alias("c0")]
    judged = clean_lines(df.select(F.col(f"`{text}`").alias("text"), F.struct(*fields).alias("rest")), "text", most_lost)
    place = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text: F.col("clean_text")}
    return judged.where("kept").select(*[place[c].alias(c) for c in df.columns])
