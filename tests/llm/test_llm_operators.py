"""Operators on small tables against plain Python versions, and on awkward inputs."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldsafe.llm import (
    chat, components, encoding, jaccard, language, mixing, ngram_lm, packing, pii, quality, search, textarrays, tokens,
)
from foldsafe.llm.queries import tokenizer_path
from foldsafe.sources import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 13}." for i in range(30_000))
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3),
    (5, "Same text here.\n\nSame text here.", "fr", "b", 30), (5, "Same text here.\n\nSame text here.", "fr", "b", 30),
    (6, LONG, "en", "b", len(LONG)), (None, "no id at all, but some words.", None, "b", 9),
    (7, "é ü 日本語 　  x \x85 y", "de", "c", 5), (8, "<|endoftext|> a  b <|endoftext|>", "en", "c", 1),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


texts_of = st.lists(st.one_of(st.none(), st.text(" \n\t\rabAB.é日　\x85|#!", max_size=60)), max_size=8)


@given(texts_of, st.integers(1, 50))
@settings(max_examples=150, deadline=None)
def test_words_and_lines(rows, limit):
    seen, lines = [], []
    for first, t in textarrays.chunks(pa.array(rows, pa.string()), limit):
        starts, owner = t.words()
        hashes = t.hashes(starts, textarrays.WORD_TABLE)
        seen += [(first + r, h) for r, h in zip(owner.tolist(), hashes.tolist())]
        begins, ends, line_owner = t.lines()
        lines += [(first + r, t.data[a:b].tobytes().decode()) for a, b, r in zip(begins, ends, line_owner.tolist())]
    want = [(i, w) for i, x in enumerate(rows) for w in WORD.findall(x or "")]
    assert [i for i, _ in want] == [i for i, _ in seen]
    assert len(set(zip([w for _, w in want], [h for _, h in seen]))) == len({w for _, w in want}) == len({h for _, h in seen})
    assert [x for x in lines if x[1]] == [(i, x) for i, t in enumerate(rows) for x in (t or "").split("\n") if x]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


_encoders = {}


@given(st.lists(st.text(" \n\t\x0b　 \x85\x1caé日's'll1!<|>endoftext", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_library(library, rows):
    encode = _encoders.setdefault("json", encoding.Encoder(tokenizer_path()))
    ids, counts = encode.encode(pa.array(rows, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert counts.tolist() == [len(w) for w in want] == encode.count(pa.array(rows, pa.string())).tolist()
    assert ids.tolist() == [i for w in want for i in w]


def test_encoder_forgets_and_other_files(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(encoding, "_MOST_BYTES", 100)
    small = encoding.Encoder(tokenizer_path())
    rows = pa.array(["a b c d e", "f g h", "a b"])
    assert small.count(rows).tolist() == encoding.Encoder(tokenizer_path()).count(rows).tolist()
    piece = tokenizer_path("piece_bpe_32k.model")
    want = sentencepiece.SentencePieceProcessor(model_file=piece).encode(["Hello  there", ""], num_threads=1)
    assert encoding.Encoder(piece).encode(pa.array(["Hello  there", ""]))[0].tolist() == want[0]
    assert not encoding.can_cut(tokenizer_path("word_bpe_49k.json")) and encoding.can_cut_words(tokenizer_path("word_bpe_49k.json"))


# quality


def plain_quality(text):
    words, found, covered = WORD.findall(text), defaultdict(list), set()
    for i in range(len(words) - 7):
        found[tuple(words[i:i + 8])].append(i)
    for places in found.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    with_words = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(with_words) - len(set(with_words)), "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


@given(st.lists(st.text("ab \n.|#", max_size=120), max_size=5))
@settings(max_examples=150, deadline=None)
def test_quality_base(rows):
    for _, t in textarrays.chunks(pa.array(rows, pa.string())):
        got = quality._judged(t, 0.5)
        for i, text in enumerate(rows):
            assert {k: got[k][i] for k in plain_quality(text)} == plain_quality(text)


GOOD = "This line has a good number of plain words in it. "


@pytest.mark.parametrize(("line", "rule"), [
    ("a % b # c", "symbols"), ("Home | News | Shop and a few more words to read here now", "navigation"),
    ("Please read our privacy policy.", "boilerplate"), ("BUY THIS NOW!!", "shouting"),
    ("For For For For For For.", "stutter"), ("just some words without an end", "punctuation"),
])
def test_quality_rules(spark, line, rule):
    more = "\n".join(f"Line number {i} says that word{i} is not word{i + 1} at all." for i in range(6))
    text = f"{more}\n{line}\n{GOOD}"
    row = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row[f"lines_{rule}"] == 1 and row["n_lines_removed"] == 1 and row["kept"]
    assert row["clean_text"] == f"{more}\n{GOOD}"


def test_quality_rejects_what_loses_much(spark):
    junk = "\n".join(f"a{i} % b # c{i}" for i in range(40))
    repeated = "\n".join(["One and the same line, said again."] * 3)
    rows = [(1, f"{GOOD * 2}\n{junk}"), (2, f"{GOOD * 9}\n{junk}"), (3, f"{GOOD} {GOOD}"), (4, f"{repeated}\nThe end.")]
    kept = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [kept[i]["kept"] for i in (1, 2, 3, 4)] == [False, False, False, False]
    assert kept[3]["base_failed"] and kept[4]["lines_copies"] == 1


def judged(*texts):
    found = [quality._judged(t, 0.5) for _, t in textarrays.chunks(pa.array(texts, pa.string()))]
    return [{k: v[i] for k, v in part.items()} for part in found for i in range(len(part["kept"]))]


def test_quality_long_lines():
    prose = " ".join(f"Word{i} is not like word{i + 1} at all." for i in range(40))
    clean = [
        f"{prose} Then x > 3 and y > 4 hold.", f"{prose} They read more, blog in May and design in June, then sign in.",
        f"{prose} The blog in question. (Log in first.)", prose + " He came back to tops and catalog inns.",
    ]
    for row, text in zip(judged(*clean), clean):
        assert row["kept"] and row["clean_text"] == text and row["n_words_removed"] == row["n_lines_removed"] == 0
    notice = "\u201cAll rights reserved\u201d by us."
    rows = judged(f"{prose} {notice} {prose[:-1]} again.\nThe end.", f"{prose} {notice}\nNew sentence begins here.", f"{notice} {prose}")
    assert [r["clean_text"] for r in rows] == [
        f"{prose} {prose[:-1]} again.\nThe end.", f"{prose} \nNew sentence begins here.", prose,
    ]
    assert [(r["n_words_removed"], r["n_lines_removed"], r["lines_boilerplate"]) for r in rows] == [(5, 0, 0)] * 3
    # A sentence at the end of a row does not reach into the next row.
    assert [r["clean_text"] for r in judged(f"{prose} {notice}", "Next.")][1] == "Next."
    endless = "one more word " * 40 + "on the privacy policy of " + "many other words " * 40 + "ends."
    assert judged(endless)[0]["n_words_removed"] == 0
    assert judged(" ".join(["See our terms of use."] * 8))[0]["lines_boilerplate"] == 1


def test_quality_phrases_at_word_boundaries():
    lines = ["Design in oak is back.", "The blog in question is old.", "Sign in", "Please click here!", "\u201cRead more\u201d", "élog in.", "\u3000Sign in\u3002"]
    rows = judged(*lines)
    assert [r["lines_navigation"] for r in rows] == [0, 0, 1, 1, 1, 0, 1]
    # A phrase is not put together from two rows.
    assert [r["lines_navigation"] for r in judged("We sign", " in.", "a blog", "log in")] == [0, 0, 0, 1]


@pytest.mark.parametrize("line", [
    "यह एक वाक्य है।", "यह एक वाक्य है। और यह भी", "এটি একটি বাক্য।", "یہ ایک جملہ ہے۔", "ما هذا الشيء؟", "Սա նախադասություն է։",
    "Ինչպե՞ս եք դուք", "ይህ ዓረፍተ ነገር ነው።", "នេះគឺជាប្រយោគ។", "ဒါက ဝါကျတစ်ခုပါ။", "ཡིན་ནོ།", "你好。今天天气很好，我们", "彼は「はい」", "Er sagt „ja“",
    "Il dit « oui »", "Τι είναι αυτό\u037e", "นี่คือ ประโยค ภาษาไทย", "ນີ້ແມ່ນ ປະໂຫຍກ", "ภาษาไทย เขียน ด้วย Python ครับ",
])
def test_quality_punctuation_of_all_scripts(line):
    row = judged(line)[0]
    assert row["lines_punctuation"] == row["n_lines_removed"] == 0


def test_quality_punctuation_still_fails():
    lines = ["यह एक वाक्य है", "без точки в конце", "你好，今天天气", "A line with one Thai word ไทย in it", "“quoted” words then more", "no end é"]
    assert [r["lines_punctuation"] for r in judged(*lines)] == [1, 1, 1, 1, 0, 1]
    assert judged("\n".join(lines))[0]["lines_punctuation"] == 5
    thai = "\n".join(" ".join(f"คำที่{i}ก{j}" for j in range(30)) for i in range(5))
    assert judged(thai)[0]["kept"]


def test_quality_awkward(awkward, empty):
    clash = awkward.withColumn("kept", F.lit("x")).withColumn("other", F.lit(1))
    rows = quality.clean_lines(clash).collect()
    assert len(rows) == len(AWKWARD) and all(r["other"] == 1 and isinstance(r["kept"], bool) for r in rows)
    assert [r["clean_text"] for r in rows if r["doc_id"] == 1] == [None]
    assert quality.clean_lines(empty).count() == 0
    assert quality.kept_documents(awkward).columns == awkward.columns


# packing and token counts


def test_packing_round_trip(awkward, empty, library):
    rows = packing.pack(awkward.withColumn("length", F.lit("x")), tokenizer_path()).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by_doc = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["offset"] == 0 and r["length"] in [2**i for i in range(11)]
        by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for doc, text, *_ in AWKWARD:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(d == doc for d, *_ in AWKWARD)
        found = Counter()
        for start, ids, n in by_doc[doc]:
            assert n == len(want) and ids.tolist() == want[start:start + len(ids)]
            found.update(range(start, start + len(ids)))
        assert set(found.values()) == {copies} and len(found) == len(want)
    assert packing.pack(empty, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(awkward, tokenizer_path(), limit=1000)


def test_pieces_are_few():
    row, length = (packing.pieces(np.array([1, 2, 1023, 1024, 3000]), 1024)[i] for i in (0, 2))
    assert Counter(row.tolist()) == {0: 1, 1: 1, 2: 10, 3: 1, 4: 2 + bin(3000 - 2048).count("1")}
    assert np.bincount(row, weights=length).tolist() == [1, 2, 1023, 1024, 3000]


def test_packing_buckets(spark, awkward, tmp_path):
    packing.write_buckets(packing.pack(awkward, tokenizer_path()), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("bucket <> length").count() == 0 and back.count() > 10


def test_token_counts_use_the_cache(spark, awkward, empty, library, monkeypatch):
    cache = scratch.new_path(spark, "token-cache")
    path = tokenizer_path()
    want = sorted((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in AWKWARD if d)

    def counted(df):
        rows = tokens.count_tokens(df, path, cache).where("doc_id IS NOT NULL").collect()
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
        return sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows)

    assert counted(awkward) == want
    stored = tokens.cached(spark, cache, encoding.version(path))
    assert stored.count() == len({t or "" for _, t, *_ in AWKWARD})
    # A false stored count shows that hits are not encoded again.
    digest = hashlib.sha256(b"one").digest()
    spark.createDataFrame([(bytearray(digest), 77)], "digest binary, n_tokens long").write.mode("append").parquet(
        f"{cache}/tokenizer={encoding.version(path)}"
    )
    assert [n for d, _, n in counted(awkward) if d == 4] == [77]
    more = awkward.unionByName(spark.createDataFrame([(99, "quite new", None, None, None)], DOCS))
    monkeypatch.setattr(tokens, "_FEW_DIGESTS", 0)
    assert (99, 9, 2) in counted(more)
    assert counted(empty) == []


# mixing


def plain_mix(rows, weights=(5, 2, 1), most=3):
    size = [len(WORD.findall(t or "")) for _, _, t in rows]
    total = defaultdict(int)
    for (_, s, _), n in zip(rows, size):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * total[s]}
        for s in full or open_:
            target[s] = most * total[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return size, total, target


@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]), st.integers(0, 30)), max_size=40))
@settings(max_examples=12, deadline=None)
def test_mix_targets(spark, picked):
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate(picked)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in mixing.mix_report(df).collect()}
    size, total, target = plain_mix(rows)
    taken = defaultdict(int)
    for (i, s, _), n in zip(rows, size):
        assert got[i]["size"] == n and got[i]["source_size"] == total[s] and got[i]["taken"] <= 3 * n
        assert got[i]["target"] == pytest.approx(target[s])
        taken[s] += got[i]["taken"]
    for s in target:
        assert abs(taken[s] - target[s]) <= max(n for (_, x, _), n in zip(rows, size) if x == s)


def test_mix_is_nested_and_repeats_rows(spark, awkward, empty):
    rows = [(i, f"s{i % 3}", "w " * (i % 7 + 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    less = {r["doc_id"]: r["taken"] for r in mixing.mix_report(df, share=0.3).collect()}
    more = {r["doc_id"]: r["taken"] for r in mixing.mix_report(df, share=0.6).collect()}
    assert all(less[i] <= more[i] for i in less)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(df).collect()}
    clash = df.withColumns({"_source": F.lit(1), "_hash": F.lit(2), "_document": F.lit(3)})
    mixed = mixing.mixed(clash)
    assert mixed.columns == clash.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in copies.items() if n}
    assert mixing.mixed(empty).count() == 0 and mixing.mix_report(empty).count() == 0
    assert mixing.mix_report(awkward).count() == len(AWKWARD)


def test_mix_without_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 40 if i % 3 else 0}", "w " * (i % 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(tuple, mixing.mix_report(df).collect()))
    monkeypatch.setattr(mixing, "_FEW_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_report(df).collect())) == want


# personal data


def plain_feistel(key, label, left, right, a, b):
    for i in range(pii.ROUNDS):
        other = right if i % 2 == 0 else left
        digest = hashlib.sha256("|".join(map(str, (key, label, a, b, i, other, key))).encode()).hexdigest()
        f = int(digest[:15], 16)
        left, right = ((left + f % a) % a, right) if i % 2 == 0 else (left, (right + f % b) % b)
    return left, right


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_feistel_is_the_plain_one_and_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    rows = df.select("d", pii.permute_digits("k", F.lit("x"), F.col("d")).alias("e")).collect()
    assert len({r["e"] for r in rows}) == 1000 and {len(r["e"]) for r in rows} == {3}
    for r in rows[:50]:
        left, right = plain_feistel("k", "x3", int(r["d"][:1]), int(r["d"][1:]), 10, 100)
        assert r["e"] == f"{left}{right:02d}"


def change(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r["text"], r["pii_kinds"]) for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


def test_pii_formats(spark):
    found = change(
        spark, "4111111111111111", "pay 4111 1111 1111 1111 now", "4111111111111112", "a@b.example.org, x@y", "1.2.3.4 and 1.2.3.256",
        "12/31/1999 31.12.1999 1999-12-31 2023-02-30", "123-45-6789 000-12-3456", "+1 (017) 555-7713", "7536784127813050 4845168114407329",
        "mé.17@mail7.example.com&&&", "nothing here at 12 or 1999", "token = \"ede43f42c939b6405768150e041159052\"",
    )
    card, grouped = found[0][0], found[1][0]
    assert luhn(card) and len(card) == 16 and card != "4111111111111111"
    assert grouped == f"pay {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} now"
    assert found[2] == ("4111111111111112", [])
    assert found[3][1] == ["email"] and "a@b.example.org" not in found[3][0] and found[3][0].endswith(", x@y")
    assert found[4][1] == ["ipv4"] and found[4][0].endswith(" and 1.2.3.256") and not found[4][0].startswith("1.2.3.4 ")
    month, day, iso, wrong = found[5][0].split(" ")
    made = datetime.date.fromisoformat(iso)
    assert f"{made:%m/%d/%Y}" == month and f"{made:%d.%m.%Y}" == day and wrong == "2023-02-30" and 1900 <= made.year <= 2099
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} 000-12-3456", found[6][0]) and found[6][1] == ["ssn"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", found[7][0]) and "555-7713" not in found[7][0]
    assert found[8][1] == ["card" for x in ("7536784127813050", "4845168114407329") if luhn(x)]
    assert found[9][1] == ["email"] and found[9][0].endswith("&&&")
    assert found[10] == ("nothing here at 12 or 1999", []) and found[11][1] == []


def test_pii_plain_values(spark):
    rng = random.Random(3)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049)) for _ in range(60)]
    addresses = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)]
    found = change(spark, *[f"{d} {a}" for d, a in zip(days, addresses)])
    for (text, kinds), d, a in zip(found, days, addresses):
        left, right = divmod((d - datetime.date(1900, 1, 1)).days, 4297)
        left, right = plain_feistel("k", "date", left, right, 17, 4297)
        parts = [int(x) for x in a.split(".")]
        p, q = plain_feistel("k", "ipv4", parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536)
        day = datetime.date(1900, 1, 1) + datetime.timedelta(left * 4297 + right)
        assert text == f"{day} {p // 256}.{p % 256}.{q // 256}.{q % 256}" and kinds == ["date", "ipv4"]


def test_pii_awkward(awkward, empty):
    clash = awkward.withColumn("_pii_found", F.lit(5)).withColumn("pii_kinds", F.lit("x"))
    rows = pii.pseudonymise(clash, "k").collect()
    assert sorted(str(r["text"]) for r in rows) == sorted(str(t) for _, t, *_ in AWKWARD)
    assert all(r["_pii_found"] == 5 and r["pii_kinds"] == [] for r in rows)
    assert pii.pseudonymise(empty, "k").count() == 0


# chat


def plain_chat(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t is None, t or 0, r, x))
    ordered = {c: tuple((r, x) for *_, r, x in sorted(v, key=lambda s: s[:2])) for c, v in convs.items()}
    whole = defaultdict(list)
    for c, v in ordered.items():
        whole[v].append(c)
    prefixes = {v[:i] for v in whole for i in range(1, len(v))}
    return {
        min(c): (len(v), len(c), "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in v))
        for v, c in whole.items() if v not in prefixes
    }


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    found = chat.render(df).orderBy("conv_id", "segment").collect()
    texts, rest = defaultdict(str), {}
    for r in found:
        texts[r["conv_id"]] += r["text"]
        rest[r["conv_id"]] = (r["n_turns"], r["n_copies"])
    return {c: (*rest[c], texts[c]) for c in texts}


def test_chat_prefixes(spark):
    rng = random.Random(1)
    rows = []
    for c in range(120):
        kind, n = rng.randrange(8), rng.randrange(1, 7)
        rows += [(c, 3 + t, ("user", "bot")[t % 2], f"{kind} {t}" if rng.random() < 0.95 else None) for t in range(n)]
    rows += rows[:25] + [(500, None, None, None), (501, 1, None, ""), (502, 1, "", None)]
    assert chats(spark, rows) == plain_chat(rows)
    assert chats(spark, []) == {}


def test_chat_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    long = [(1, t, "u", f"x{t % 3}") for t in range(50)]
    rows = long + [(2, t, "u", f"x{t % 3}") for t in range(30)] + [(3, t, "u", f"x{t % 2}") for t in range(30)] + [(4, t, "u", f"x{t % 3}") for t in range(50)]
    assert chats(spark, rows) == plain_chat(rows)
    assert sorted(plain_chat(rows)) == [1, 3]


def test_chat_many_turns_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 8)
    rows = [(None, t % 8, "u", f"x{t}") for t in range(400)] + [(7, None, "u", f"y{t}") for t in range(100)]
    rows += rows[:50] + [(9, t, "u", f"z{t}") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.render(df).orderBy("conv_id", "segment").collect()
    for conv, n in ((None, 400), (7, 100), (9, 3)):
        own = [r for r in found if r["conv_id"] == conv]
        sizes = [r["text"].count("<|end|>") for r in own]
        assert sum(sizes) == n and max(sizes) <= 8 and [r["segment"] for r in own] == list(range(-(-n // 8)))
        assert [r["first_turn"] for r in own] == [1 + 8 * i for i in range(len(own))]
        said = "".join(r["text"] for r in own)
        texts = re.findall(r"<\|u\|>\n(.*)<\|end\|>\n", said)
        number = {x: t or 0 for c, t, _, x in rows if c == conv}
        assert set(texts) == set(number) and [number[x] for x in texts] == sorted(number.values())


# language


def test_language(spark, empty, awkward, monkeypatch):
    en = "the quick brown fox jumps over the lazy dog and then the other thing happened there"
    de = "der schnelle braune Fuchs springt über den faulen Hund und dann geschah etwas Anderes dort"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", None, None) for i in range(40)]
    found = language.learn(spark.createDataFrame(rows, DOCS))
    assert sorted(found.languages) == ["de", "en"]
    asked = [(1, "Then the QUICK thing", None, None, None), (2, "ÜBER den Hund", None, None, None), (3, "12 + 34 — !", None, None, None),
             (4, None, None, None, None), (5, "a", None, None, None), (6, "日本語", None, None, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(asked, DOCS), found, [F.col("doc_id")]).collect()}
    most = found.languages[0]
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == ("und", 0.0) == got[4]
    assert got[5] == (most, 0.0) == got[6] and all(0 <= s <= 1 for _, s in got.values())
    nothing = language.learn(empty)
    assert {r["lang_pred"] for r in language.predict(awkward, nothing, [F.col("doc_id")]).collect()} == {"und"}
    assert language.predict(empty, found, [F.col("doc_id")]).count() == 0
    assert language.predict(awkward, language.learn(awkward), [F.col("doc_id")]).count() == len(AWKWARD)


def test_language_filter_has_no_false_negatives():
    keys = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    masks = np.zeros((1, language.SLOTS), np.uint64)
    for place in language.slots(keys):
        masks[0][place] |= np.uint64(1)
    found = language.Filter(["x"], masks)
    for place in language.slots(keys):
        assert (masks[0][place] == 1).all()
    assert 0 < found.false_rates()[0] < 1e-6


def test_language_many(spark):
    """More than 64 languages need a second word of bits."""
    rng = random.Random(2)
    alphabets = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for i in range(70)}
    rows = [(i, " ".join(rng.choice(w) for _ in range(40)), lang, None, None) for i, (lang, w) in enumerate(list(alphabets.items()) * 2)]
    found = language.learn(spark.createDataFrame(rows, DOCS))
    assert found.masks.shape[0] == 2
    got = language.predict(spark.createDataFrame(rows, DOCS), found, [F.col("lang")]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(rows)


# search


def plain_search(rows, is_query, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    seen = set()
    for i, v in sorted(usable):
        if not is_query(i) or i in seen:
            continue
        seen.add(i)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 4, 700])
def test_search(spark, monkeypatch, n):
    for name, value in (("CELL_ROWS", 64), ("SHARD_ROWS", 100), ("QUERY_ROWS", 20), ("LEAF_ROWS", 8), ("SAMPLE_ROWS", 200)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(n)
    same = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, same if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(6)]) for i in range(n)]
    if n:
        rows += [(10_000, None), (10_005, []), (10_010, [1.0, None]), (10_015, [float("nan")] * 6), (10_020, [float("inf")] * 6),
                 (10_025, [0.5, -0.25]), (None, same), (7, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score long")
    got = search.nearest(df, F.col("vec_id") % 5 == 0, k=7).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_search(rows, lambda i: i % 5 == 0, 7)


def test_search_large_values(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [2.0e6, 7.0]), (2, [2.0e6, 8.0])]
    got = search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1, k=2).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, int(2.0e6 * 1024 * 1024 * rows[i][1][0]) + 7 * 1024 * int(1024 * rows[i][1][1])) for i in (0, 2)]


# language model


def plain_model(train, text):
    def toks(x):
        return [*WORD.findall(lower(x or "")), None]

    count, pair = Counter(), Counter()
    for t in train:
        before = 0
        for w in toks(t):
            count[w] += 1
            pair[before, w] += 1
            before = w
    n, v = sum(count.values()), len(count)

    def cut(values):
        c = Counter(values)
        return ngram_lm.discounts([c[i] for i in (1, 2, 3, 4)])

    follows, after, total = Counter(), defaultdict(Counter), Counter()
    for (a, b), k in pair.items():
        follows[b] += 1
        after[a][min(k, 3)] += 1
        total[a] += k
    d, e = cut(pair.values()), cut(follows.values())
    free = sum(e[min(k, 3)] for k in follows.values()) / len(pair) if pair else 1.0

    def p(a, b):
        lower_ = (max(follows[b] - e[min(follows[b], 3)], 0) / len(pair) if pair else 0) + free / (v + 1)
        if not total[a]:
            return lower_
        k = pair[a, b]
        return max(k - d[min(k, 3)], 0) / total[a] + sum(d[i] * after[a][i] for i in (1, 2, 3)) / total[a] * lower_

    score, base, before = 0.0, 0.0, 0
    for w in toks(text):
        score += np.log10(p(before, w))
        base += np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
        before = w
    return len(toks(text)), sum(count[w] > 0 for w in toks(text)), base, score, n, p, count


@pytest.mark.parametrize("small", [False, True])
def test_language_model(spark, monkeypatch, small):
    if small:
        for name, value in (("WORD_SHARD_BYTES", 200), ("PAIR_SHARD_BYTES", 300), ("STATS_PER_SHARD", 5), ("_HELD", 40), ("_CHUNK", 64)):
            monkeypatch.setattr(ngram_lm, name, value)
    rng = random.Random(4)
    train = [" ".join(rng.choice("the The a of cat dog sat on mat Ünder".split()) for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, "", "the " * 300]
    asked = ["the cat sat", "zebra the zebra", None, "", "  ", "THE CAT\nsat on", "the " * 300]
    model = ngram_lm.learn(spark.createDataFrame([(t,) for t in train], "text string"))
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").withColumn("score", F.lit(1))
    for r in ngram_lm.score(df, model, [F.col("doc_id")]).collect():
        n, known, base, score, total, *_ = plain_model(train, asked[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_language_model_sums_to_one_and_empty(spark, empty):
    *_, p, count = plain_model(["a b a c", "b a", "c c a b"], "a")
    for before in ("a", "b", 0, "unseen"):
        assert sum(p(before, w) for w in count) + p(before, "unseen") == pytest.approx(1)
    model = ngram_lm.learn(empty)
    rows = ngram_lm.score(spark.createDataFrame([(1, "a b", None, None, None)], DOCS), model, [F.col("doc_id")]).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in rows] == [(3, 0, 0, 0.0, 0.0)]
    assert ngram_lm.score(empty, model, [F.col("doc_id")]).count() == 0


# near duplicates


def plain_jaccard(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def families(seed, sizes=((40, 60, 3), (15, 30, 4), (10, 12, 1), (6, 300, 20))):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for size, n, edits in sizes:
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = rng.choice(words)
            base = w if rng.random() < 0.3 else base
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(rng.randrange(7)))) for i in range(30)]
    return rows + [(900, None), (901, ""), (902, "A b"), (903, "a B"), (902, "A b"), (None, "a b"), (905, rows[0][1].upper())]


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 8)])
def test_jaccard(spark, seed, block):
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("x"))
    got = jaccard.join(df, block=block).collect()
    want = plain_jaccard(rows)
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = jaccard.keep_one(df.withColumn("_n", F.lit(1)), block=block).collect()
    own = {(d, c) for d, n, c in want if n and d == c}
    assert sorted(r["doc_id"] for r in kept if WORD.search(r["text"] or "")) == sorted(d for d, _ in own)
    assert sum(not WORD.search(r["text"] or "") for r in kept) == sum(not WORD.search(t or "") for _, t in rows)


def test_jaccard_awkward(awkward, empty):
    assert jaccard.join(awkward).count() == len(AWKWARD)
    assert jaccard.keep_one(awkward).count() == len(AWKWARD) - 1
    assert jaccard.join(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=14))
@settings(max_examples=200, deadline=None)
def test_prefix_tree_finds_all_clusters(picked):
    sets = [np.array(sorted(s), np.uint64) for s in picked]
    trie = jaccard.Trie(sets, np.array([len(s) for s in sets]))
    for i, s in enumerate(sets):
        labels = np.arange(len(sets)) + 1
        found = sorted(trie.order[m] for m in trie.linked(s, len(s), labels, 0))
        want = [j for j, t in enumerate(picked) if 100 * len(picked[i] & t) >= 80 * len(picked[i] | t)]
        assert found == want


@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), min_size=2, max_size=12))
@settings(max_examples=200, deadline=None)
def test_lookup_of_sets_with_other_shingles(picked):
    """The searcher is no member: shingles that no member has count for its size only."""
    asked, *members = picked
    lookup = jaccard.Lookup([np.array(sorted(s), np.uint64) for s in members], np.array([len(s) for s in members]))
    found = list(lookup.linked(np.array(sorted(asked), np.uint64), len(asked), np.arange(len(members)) + 1, 0))
    assert found == [j for j, t in enumerate(members) if 100 * len(asked & t) >= 80 * len(asked | t)]


def test_block_of_near_copies_is_searched_in_part(monkeypatch):
    """Sets of the largest cluster are not searched one by one, and clusters come as stars."""
    rng = random.Random(8)
    picked = [set(range(100)) - set(rng.sample(range(100), 6)) for _ in range(300)]
    picked += [set(range(1000 + 20 * i, 1020 + 20 * i)) | set(range(5)) for i in range(20)]
    table = pa.table({
        "cls": pa.array(range(len(picked)), pa.int64()), "n": pa.array([len(s) for s in picked], pa.int64()),
        "ranks": pa.array([np.array(sorted(s), "<u8").tobytes() for s in picked], pa.binary()),
    })
    searches, linked = [], jaccard.Lookup.linked
    monkeypatch.setattr(jaccard.Lookup, "linked", lambda self, *a: searches.append(1) or linked(self, *a))
    found = jaccard._cluster_task(None, table)
    assert sorted(zip(*found.to_pydict().values())) == [(i, 0) for i in range(1, 300)]
    assert len(searches) < 40


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "_FEW_EDGES", few)
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    label = {x: x for p in pairs for x in p}
    for _ in range(500):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    lonely = {x for x in label if all(a == b or x not in (a, b) for a, b in pairs)}
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == {x: y for x, y in label.items() if x not in lonely}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_few_edges_have_no_shuffle(spark, monkeypatch):
    plans, written = [], scratch.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(scratch, "written", kept)
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["label"] for r in components.components(path).collect()} == {0}
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])


def test_held_out_is_the_checksum(spark):
    rows = spark.range(50).select("id", language.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
