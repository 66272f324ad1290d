"""Spelling variants, wavelet shards, whitening and the encoder's memory against plain versions and on awkward inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldsafe.errors import SchemaError
from foldsafe.llm import encoding, textarrays, variants, wavelet, whitening
from foldsafe.llm.all import REGISTRY
from foldsafe.llm.queries import tokenizer_path
from foldsafe.sources import scratch

WORD_FILE = "word_bpe_49k.json"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# spelling variants


def plain_counts(docs, least=5, every=97):
    seen = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    form, out = {}, set()
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    for w, some in near.items():
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_query(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = {w: n for w, n in plain_counts(docs).items() if n >= 3}
    want = plain_variants(counts)
    got = REGISTRY["op11_spelling_variants"].build(spark, folder)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows_of(got) == want and got.count() == len(want)


def test_variants_of_close_words(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.randint(1, 60) for _ in range(400)}
    words |= {"a" * 300: 9, "a" * 299 + "b": 4, "a" * 301: 1, "日本": 3, "日語": 1}
    table = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x")], "word string, n long, form string")
    assert rows_of(variants.group(table)) == plain_variants(words)
    few = variants.near(table, equal=4, unequal=3)
    assert few.count() == variants.near(table, equal=9, unequal=7).count() == sum(n for _, _, _, _, n, _ in plain_variants(words)) // 2


def test_variants_on_awkward_tables(spark):
    schema = "doc_id long, text string, word string, n long, Text2 string"
    docs = [(1, None, "w", 1, ""), (2, "", "w", 1, ""), (None, "Ünder ÜNDER under×÷ x1y 日本abcde", "w", 1, ""),
            (3, "abcde" * 20_000, "w", 1, ""), (3, "abcde" * 20_000, "w", 1, "")]
    df = spark.createDataFrame(docs, schema)
    got = {r["word"]: r["n"] for r in variants.word_counts(df, "text", 5, "doc_id", 3).collect()}
    assert got == plain_counts([d[:2] for d in docs], 5, 3)
    assert {r["word"] for r in variants.word_counts(df).collect()} == set(plain_counts([d[:2] for d in docs], 1, 0))
    empty = variants.group(variants.word_counts(df.limit(0), "text", 5, "doc_id", 97))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.group(spark.createDataFrame([("alone", 3)], "word string, n long")).first()["root"] == "alone"
    with pytest.raises(ValueError):
        variants.group(df, 1)


def test_word_counts_are_handed_out_when_full(spark, monkeypatch):
    texts = pa.array([" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(500))] * 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["1", "2", "3"]), texts], names=["key", "text"])
    whole = Counter()
    for out in variants._counter(1, None)([batch]):
        whole.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())))
    monkeypatch.setattr(variants, "_KEPT_BYTES", 10)
    parts = Counter()
    for out in variants._counter(1, None)([batch, batch.slice(0, 0)]):
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            parts[w] += n
    assert parts == whole


# encoder


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {f: Tokenizer.from_file(tokenizer_path(f)) for f in ("byte_bpe_50k.json", WORD_FILE)}


_encoders = {}
_SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "  ", "don't", "'S", "á"])
_PIECE = st.one_of(_SPECIAL, st.text(" \n\t\x0b　 \x85 aéÉ日ひ한अिक्ष🙂ßΣς́'sl1!<|>.,", max_size=12))


@given(st.lists(st.lists(_PIECE, max_size=8).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_cut_texts_have_the_library_s_ids(libraries, rows):
    for name, library in libraries.items():
        encode = _encoders.setdefault(name, encoding.Encoder(tokenizer_path(name)))
        want = [library.encode(t, add_special_tokens=False).ids for t in rows]
        ids, counts = encode.encode(pa.array(rows, pa.string()))
        assert counts.tolist() == [len(w) for w in want] == encode.count(pa.array(rows, pa.string())).tolist()
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", WORD_FILE])
def test_encoder_memory_is_bounded_in_any_script(libraries, name, monkeypatch):
    """Texts without spaces are one piece each: their ids are not kept. What is kept has a bound in bytes."""
    rng = random.Random(1)
    made = encoding.Encoder(tokenizer_path(name))
    letters = {"cjk": [chr(c) for c in range(0x4E00, 0x4E00 + 900)], "hindi": [chr(c) for c in range(0x0905, 0x0939)]}
    for script, alphabet in letters.items():
        for _ in range(20):
            rows = ["".join(rng.choice(alphabet) for _ in range(200)) for _ in range(100)]
            ids, counts = made.encode(pa.array(rows))
            one = rng.randrange(100)
            want = libraries[name].encode(rows[one], add_special_tokens=False).ids
            assert ids[counts[:one].sum():][: counts[one]].tolist() == want
    assert made.kept_bytes() < 10_000
    monkeypatch.setattr(encoding, "_MOST_BYTES", 2_000)
    small = encoding.Encoder(tokenizer_path(name))
    for _ in range(30):
        rows = [" ".join("".join(rng.choice(letters["hindi"]) for _ in range(5)) for _ in range(20))]
        want = libraries[name].encode(rows[0], add_special_tokens=False).ids
        assert small.encode(pa.array(rows))[0].tolist() == want
        assert small.kept_bytes() < 2_000 + 20 * (24 + 4 * 64)


# wavelet shards


@given(st.lists(st.integers(0, 2**32 - 1), max_size=700) | st.lists(st.integers(0, 5), max_size=1500), st.data())
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(ids, data):
    a = np.array(ids, np.uint32)
    matrix = wavelet.Matrix(wavelet.build(a))
    assert matrix.all().tolist() == ids and len(matrix) == len(ids)
    asked = [*set(ids[:4]), 0, 1, 2**32 - 1, 2**33]
    low = data.draw(st.integers(0, len(ids)))
    high = data.draw(st.integers(low, len(ids)))
    assert matrix.count(np.array(asked, np.int64), low, high).tolist() == [ids[low:high].count(s) for s in asked]
    for s in asked:
        assert matrix.positions(s).tolist() == [i for i, x in enumerate(ids) if x == s]
    if ids:
        places = np.array(data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=20)), np.int64)
        assert matrix.access(places).tolist() == a[places].tolist()


def plain_index(docs, library, closing=1):
    out, run = [], 0
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, closing]
        out.append((key, run, ids))
        run += len(ids)
    return out


def test_wavelet_query(spark, folder, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {(k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, start, ids in plain_index(docs, libraries[WORD_FILE])}
    got = REGISTRY["op12_wavelet_shards"].build(spark, folder).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_wavelet_questions(spark, libraries):
    rng = random.Random(2)
    texts = [None, "", "one two two", "Two, three! " * 3000, "日本 two"] + ["".join(rng.choice("ab c\n") for _ in range(90)) for _ in range(40)]
    docs = [(None if i == 7 else i // 2 * 2, t, "k", 5) for i, t in enumerate(texts)] + [(90, "same", "k", 5)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, key string, part long")
    path = scratch.new_path(spark, "wavelet-test")
    wavelet.write(df, tokenizer_path(WORD_FILE), path, shard_tokens=500, ranges=4)
    index = wavelet.open_index(spark, path)
    assert index.shards.count() > 2
    read = sorted(wavelet.documents(index).collect(), key=lambda r: r["start"])
    ids = [i for r in read for i in np.frombuffer(r["ids"], "<u4").tolist()]
    assert [r["start"] for r in read] == [0, *np.cumsum([r["n_tokens"] for r in read])[:-1].tolist()]
    keys = [r["key"] for r in read]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(read) == len(docs)
    encoded = Counter((k, tuple(i)) for k, _, i in plain_index([d[:2] for d in docs], libraries[WORD_FILE]))
    assert encoded == Counter((r["key"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in read)
    asked = [1, ids[0], ids[-2], ids[40], 70_000]
    assert {r["token"]: r["n"] for r in wavelet.counts(index, asked).collect()} == {s: ids.count(s) for s in asked}
    owner = [(r["key"], i) for r in read for i in range(r["n_tokens"])]
    want = Counter((s, p, *owner[p]) for s in set(asked) for p, x in enumerate(ids) if x == s)
    assert Counter(tuple(r) for r in wavelet.occurrences(index, asked).collect()) == want
    places = [0, 5, 5, len(ids) - 1, len(ids), -1, 700, 1300]
    table = spark.createDataFrame([(p, 0) for p in places], "position long, token long")
    assert {tuple(r) for r in wavelet.tokens_at(index, table).collect()} == {(p, ids[p]) for p in places if 0 <= p < len(ids)}


def test_wavelet_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = scratch.new_path(spark, "wavelet-empty")
    wavelet.write(df, tokenizer_path(WORD_FILE), path)
    index = wavelet.open_index(spark, path)
    assert wavelet.documents(index).count() == wavelet.occurrences(index, [1]).count() == 0
    assert [tuple(r) for r in wavelet.counts(index, [1]).collect()] == [(1, 0)]


# whitening


def leading(x, k):
    z = x - x.mean(0)
    v = z.T @ z / len(x)
    values, axes = np.linalg.eigh(v)
    return z, values[::-1][:k], axes[:, ::-1][:, :k], np.trace(v)


def test_whitening_query(spark, folder):
    source = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(source.embedding).astype(float)) + 1_000_000
    z, values, axes, trace = leading(x, 32)
    got = REGISTRY["op13_embedding_whitening"].build(spark, folder).toPandas()
    assert len(got) == 32 * len(x) and set(got.n) == {len(x)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[source.vec_id].to_numpy()
    want = z @ axes / np.sqrt(values)
    gaps = np.abs(np.diff(values)).min() / values[0]
    signs = np.sign((wide * want).sum(0))
    assert np.abs(wide * signs - want).max() < 1e-12 / gaps
    shares = got[got.vec_id == source.vec_id[0]].sort_values("component").explained.to_numpy()
    assert np.allclose(shares, values / trace, rtol=1e-12) and got.identity_error.max() < 1e-10
    sums = [int(s) for s in x.sum(0)]
    deviation = {v: sum((len(x) * int(a) - s) ** 2 for a, s in zip(row, sums)) for v, row in zip(source.vec_id, x)}
    assert all(deviation[v] == d for v, d in zip(got.vec_id, got.deviation))


def test_eigenvectors_with_restarts():
    """Far more entries than the subspace may hold: locking, restarts and inner steps have to do it."""
    rng = np.random.default_rng(0)
    z = rng.standard_normal((900, 160)) * np.linspace(3, 0.5, 160) ** 2
    v = z.T @ z / len(z)
    axes, values, residuals = whitening._jacobi_davidson(lambda x: v @ x, 160, 8, 6, 20)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.allclose(values, want, rtol=1e-13) and residuals.max() < 1e-12 * want[0]
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-13


def test_whitening_on_awkward_tables(spark):
    schema = "vec_id long, v array<long>, component2 string, V2 string"
    rows = [(i, [i % 7, i * i % 11, 3, 2 * (i % 7), 10**9 + i % 5], "x", "y") for i in range(60)]
    rows += [(100, None, "x", "y"), (101, [1, None, 3, 4, 5], "x", "y"), (None, [1, 2, 3, 2, 10**9], "x", "y"), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, schema)
    model = whitening.fit(df, "v")
    x = np.array([r[1] for r in rows if r[1] and None not in r[1]], float)
    _, values, _, trace = leading(x, 5)
    # A constant entry and one that is twice another: three components are real.
    assert len(model.values) == 3 and np.allclose(model.values, values[:3], rtol=1e-10) and model.identity_error < 1e-9
    assert np.isclose(model.trace, trace, rtol=1e-9) and model.n == 62
    out = whitening.transform(df, model, "v", ["vec_id"]).collect()
    assert len(out) == 3 * 62 and {r["component"] for r in out} == {1, 2, 3}
    nothing = df.limit(0)
    assert whitening.transform(nothing, whitening.fit(nothing, "v"), "v", ["vec_id"]).count() == 0
    alike = spark.createDataFrame([(i, [4, 5]) for i in range(3)], "vec_id long, v array<long>")
    assert whitening.transform(alike, whitening.fit(alike, "v"), "v", ["vec_id"]).count() == 0
    with pytest.raises(SchemaError):
        whitening.fit(spark.createDataFrame([(1, [1]), (2, [1, 2])], "vec_id long, v array<long>"), "v")
    with pytest.raises(SchemaError):
        whitening.transform(df.withColumnRenamed("component2", "n"), model, "v", ["n"])
    with pytest.raises(OverflowError):
        whitening._deviations(np.array([[2**40]]), 2**30, np.array([0]))
