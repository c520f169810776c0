"""The operators of the subpackage against plain versions, round trips and held-out rows, with odd rows in every table."""

import collections
import functools
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from oppsift.llm import bpe, chat_format, embedding_dedup, exact_dedup, minhash_dedup, packing, queries, segments, sentencepiece_bpe, token_files, token_rollup, toxicity, url_filter

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs away from the big bad wolf", "a"), (2, "the quick  brown fox\njumps over the lazy dog and then it runs away from the big bad wolf", "b"), (3, None, None), (4, "", "c"),
    (5, "   ", "c"), (6, "one two three", "a"), (7, "ONE two three", "a"), (8, "x" * 5000 + " <|endoftext|> y", "a"), (9, "word " * 9000, "b"), (9, "word " * 9000, "b"), (None, "no id", "a"), (None, None, None), (10, "日本語 text é ▁\ue000", "d"),
    (11, "The quick brown fox jumps over the lazy dog and then it runs away from the big bad wolf", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = spark.createDataFrame([(d, t, s, "en", 7) for d, t, s in ODD], "doc_id long, text string, source string, lang string, kept int")
    return rows.withColumns({"score": F.lit("x"), "fp": F.lit(1), "label": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids_of(text, end):
    t = bpe.cached_bpe(BPE).tokenizer
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


# -- texts and tokens


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab'sdtmlvre  \n\t12!.é\u3000日\u0301²", max_size=30), max_size=5))
def test_bpe_is_the_librarys(texts):
    ids, counts = bpe.cached_bpe(BPE).encode(texts)
    want = [e.ids for e in bpe.cached_bpe(BPE).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_bpe_starts_anew(docs):
    texts, small = [r["text"] for r in docs.limit(60).collect()], bpe.CachedBpe(BPE, limit=100)
    assert all(small.encode([t])[0].tolist() == small.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


def test_hash_index():
    index, keys = segments.HashIndex(1000), segments.spread(900, 5)
    index.add(keys[:800], np.arange(800))
    assert index.find(keys).tolist() == [*range(800), *[-1] * 100]


def test_hash_index_grows():
    index, keys = segments.HashIndex(4), segments.spread(1000, 5)
    index.add(keys[:10], np.arange(10))
    index.add(keys[10:900], np.arange(10, 900))
    assert index.slots > 900 and index.find(keys).tolist() == [*range(900), *[-1] * 100]
    index.clear()
    assert index.slots == 16 and index.find(keys).tolist() == [-1] * 1000


def test_texts_of_more_words_than_slots(monkeypatch):
    text = " ".join(f"w{k}x" for k in range(3000))
    for module in (toxicity, sentencepiece_bpe):
        monkeypatch.setattr(module, "REMEMBERED", 100)
    model = toxicity.unfitted()
    assert np.isfinite(toxicity.Scorer(model).evidence([text])).all()
    small = bpe.CachedBpe(BPE, limit=100)
    small.index = segments.HashIndex(100)
    assert small.encode([text])[0].tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids
    plain = sentencepiece_bpe.DropoutBpe(PIECES, rate=0.0)
    pieces = plain.encode([text], np.zeros(1, np.uint64))[0]
    import sentencepiece

    assert pieces.tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)


@pytest.mark.parametrize("shard_ids,local", [(10**6, True), (40, True), (40, False)])
def test_token_files(spark, odd, tmp_path, monkeypatch, shard_ids, local):
    """In large and small shards, mapped and read by ranges."""
    folder = f"file://{tmp_path}/t"
    if not local:
        monkeypatch.setattr(token_files, "file_system", lambda uri: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), uri.removeprefix("file://")))
        monkeypatch.setattr(token_files, "PART_DOCS", 2)
    shards = token_files.write_token_files(odd, BPE, folder, end_id=0, shard_ids=shard_ids)
    assert shard_ids > 40 or len(shards) > 4
    if local:
        rows = token_files.read_token_files(spark, folder).collect()
    else:  # in this process, where the store is another one
        kind, rows = "<u2", []
        parts = [s | {"first": k} for s in shards for k in range(0, s["n_docs"], 2)]
        for batch in token_files._read(iter([pa.RecordBatch.from_pylist(parts)]), folder, kind):
            rows += batch.to_pylist()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None] + sorted(d for d, _, _ in ODD if d is not None)
    start = 0
    for r in rows:
        texts = [ids_of(t, 0).tobytes() for d, t, _ in ODD if d == r["doc_id"]]
        assert r["start"] == start and bytes(r["ids"]) in texts and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]
    assert sum(s["n_tokens"] for s in shards) == start
    if local:
        assert token_files.write_token_files(odd.limit(0), BPE, f"{folder}0") == [] and token_files.read_token_files(spark, f"{folder}0").count() == 0


def test_packing(odd):
    for length, window in ((64, 10**6), (2048, 500)):
        rows = packing.pack_documents(odd, BPE, end_id=1, length=length, window=window).collect()
        wanted = collections.Counter((d, ids_of(t, 1).tobytes()) for d, t, _ in ODD)
        pieces = collections.defaultdict(list)
        for r in rows:
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        assert sum(len(b) for v in pieces.values() for _, b in v) == sum(len(b) * n for (_, b), n in wanted.items())
        for (d, n), v in pieces.items():
            texts = [b for (x, b), k in wanted.items() for _ in range(k) if x == d and len(b) == 4 * n]
            assert len(v) == len(set(v)) * len(texts) if len(texts) > 1 and len(set(texts)) == 1 else True
            assert all(any(b[4 * s : 4 * s + len(p)] == p for b in texts) for s, p in v)
        for q in {r["sequence_id"] for r in rows}:
            own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == q)
            assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= length


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=40))
def test_pack_fills_sequences(sizes):
    pieces = packing.pack(np.array(sizes), 32)
    used = collections.Counter()
    for _, _, n, q, _ in pieces:
        used[q] += n
    assert len(used) == -(-sum(sizes) // 32) and max(used.values()) <= 32
    assert all(sum(n for d, _, n, _, _ in pieces if d == k) == s for k, s in enumerate(sizes))


def test_rollup(spark, odd, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    counts = token_rollup.token_counts(odd, BPE, "v1")
    assert rollup.apply(1, token_rollup.inserts(counts)) and not rollup.apply(1, token_rollup.inserts(counts))
    want = collections.defaultdict(lambda: [0, 0])
    for _, t, s in ODD:
        want[s][0] += 1
        want[s][1] += len(ids_of(t, 0)) - 1
    assert {r["source"]: [r["n_docs"], r["n_tokens"]] for r in rollup.totals().collect()} == dict(want)
    old = counts.where("source = 'a'")
    rollup.apply(2, token_rollup.revisions(old, old.withColumn("n_tokens", F.col("n_tokens") + 1)))
    rollup.apply(3, token_rollup.deletes(counts.where("source = 'b'")))
    got = {r["source"]: [r["n_docs"], r["n_tokens"]] for r in rollup.totals().collect()}
    assert "b" not in got and got["a"] == [want["a"][0], want["a"][1] + want["a"][0]] and rollup.batches() == [1, 2, 3]
    assert rollup.apply(7, token_rollup.inserts(token_rollup.word_counts(odd))) and rollup.batches() == [1, 2, 3, 7]
    before = sorted(map(str, rollup.totals().collect()))
    assert rollup.apply(5, token_rollup.inserts(counts.limit(0))) and rollup.batches() == [1, 2, 3, 5, 7]
    assert sorted(map(str, rollup.totals().collect())) == before
    assert token_rollup.token_counts(odd.limit(0), BPE, "v").count() == token_rollup.word_counts(odd.limit(0)).count() == 0


def test_rollup_of_two_writers(spark, tmp_path, monkeypatch):
    """Both start from one version; the second adds to what the first has published, and the same batch counts once."""
    rollup, other = (token_rollup.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    changes = spark.createDataFrame([("a", "en", "v", 1, 10)], token_rollup.DELTA)
    publish, calls = rollup.versions.publish, []

    def late(number, content):
        if not calls:
            calls.append(other.apply(2, changes))
        elif len(calls) == 2:
            calls.append(other.apply(3, changes))
        publish(number, content)

    monkeypatch.setattr(rollup.versions, "publish", late)
    assert rollup.apply(1, changes) and calls == [True]
    calls.append(None)
    assert not rollup.apply(3, changes) and calls == [True, None, True]
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 3, 30)] and rollup.batches() == [1, 2, 3]
    # parts that no version names are gone but for the last two totals
    assert sum(f.name.startswith(("totals-", "delta-")) for f in (tmp_path / "r").iterdir()) <= 3


def test_op6_against_plain_counts(spark, sf):
    rows, count = duckdb.sql(f"SELECT source, lang, text FROM '{sf}/documents.parquet'").fetchall(), bpe.cached_bpe(BPE).tokenizer
    want = collections.defaultdict(lambda: [0, 0])

    def add(key, n):
        want[key][0] += 1
        want[key][1] += n

    for s, lang, t in rows:
        text = t.lower() if s == "src0" else t
        add((s, lang, "byte_bpe_50k"), len(count.encode(text, add_special_tokens=False).ids))
        if lang != "en":
            add((s, lang, "words"), len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in queries.op6(spark, sf).collect()} == dict(want)


def test_pieces(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for _, t, _ in ODD]
    plain = sentencepiece_bpe.encode_pieces(odd, PIECES, rate=0.0).collect()
    for r, t in zip(sorted(plain, key=lambda r: (r["doc_id"] or 0, r["n_pieces"])), sorted(ODD, key=lambda x: (x[0] or 0, len(x[1] or ""))), strict=True):
        if "▁" not in (t[1] or ""):
            assert np.frombuffer(r["pieces"], "<i4").tolist() == model.encode(t[1] or "")
    outs = []
    for seed in (1, 1, 2):
        encoded = sentencepiece_bpe.encode_pieces(odd, PIECES, seed=seed, rate=0.3)
        assert sorted(r["text"] for r in sentencepiece_bpe.decode_pieces(encoded, PIECES).collect()) == sorted(texts)
        outs.append(sorted((str(r["doc_id"]), bytes(r["pieces"])) for r in encoded.collect()))
    assert outs[0] == outs[1] != outs[2]


def plain_pieces(model, text, seed, doc, rate):
    """The whole text by one agenda, without segments: of the pairs left, the best that is not skipped merges."""
    if not text:
        return []
    marked = "▁" + text.replace("▁", "\ud800").replace(" ", "▁")
    x, y, z = sentencepiece_bpe._PLACES
    symbols, skipped = [(k, k + 1) for k in range(len(marked))], set()
    while True:
        pairs = [(model.pieces[marked[a:b]][0], a, m, b) for (a, m), (_, b) in zip(symbols, symbols[1:]) if marked[a:b] in model.pieces and (a, m, b) not in skipped]
        if not pairs:
            break
        _, a, m, b = min(pairs)
        h = sentencepiece_bpe.mixed((sentencepiece_bpe.base_of(seed, doc) + a * x + m * y + b * z) & (2**64 - 1))
        if h < int(rate * 2**64):
            skipped.add((a, m, b))
        else:
            k = symbols.index((a, m))
            symbols[k : k + 2] = [(a, b)]
    out = []
    for a, b in symbols:
        p = model.pieces.get(marked[a:b])
        out += [p[1]] if p else [model.bytes[v] for v in marked[a:b].replace("\ud800", "▁").encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.3])
def test_pieces_against_one_agenda(rate, docs, monkeypatch):
    texts = [t or "" for _, t, _ in ODD if len(t or "") < 1000] + [r["text"][:400] for r in docs.orderBy("doc_id").limit(12).collect()] + ["hello world again \ue000 ▁", "x" * 120, "hello hello hello"]
    model = sentencepiece_bpe.DropoutBpe(PIECES, 5, rate)
    for limit in (10**6, 20):  # the second forgets between texts
        monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", limit)
        for own in (texts, [[t] for t in texts]):
            keys = iter(range(len(texts)))
            for part in [own] if isinstance(own[0], str) else own:
                ks = np.array([next(keys) for _ in part], np.uint64)
                ids, counts = model.encode(part, ks)
                want = [plain_pieces(model, t, 5, int(k), rate) for t, k in zip(part, ks.tolist(), strict=True)]
                assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_a_word_has_many_segmentations():
    model = sentencepiece_bpe.DropoutBpe(PIECES, 1, 0.1)
    ids, counts = model.encode(["international"] * 400, np.arange(400, dtype=np.uint64))
    assert len({tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1])}) > 25
    again, _ = model.encode([" ".join(["international"] * 400)], np.zeros(1, np.uint64))
    assert len(set(again.tolist())) > 20  # within one text too


# -- duplicates


def test_exact_dedup(odd):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for d, t, _ in ODD:
        groups[norm(t)].append(d)
    weak = F.length("norm").cast("long")
    for how in ({}, {"fingerprint": weak}, {"limit": 0}):
        rows = exact_dedup.exact_dedup(odd, **how).collect()
        assert len(rows) == len(ODD)
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in rows:
            own = by_hash[r["text_sha256"]]
            keep = min((d for d in own if d is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), max_size=20), min_size=1, max_size=4), st.integers(1, 12))
def test_quotient_filters_merge_without_loss(parts, bits):
    """Filters of any sizes, cut, packed, read and merged, have each value as often as it came; runs stay in order."""
    filters = [exact_dedup.CountingQuotientFilter.of(np.array(p, np.uint64)) for p in parts]
    pieces = collections.defaultdict(list)
    for f in filters:
        for k, piece in f.pieces(bits):
            pieces[k].append(exact_dedup.CountingQuotientFilter.read(piece.bytes()))
    got = {}
    for k, own in pieces.items():
        whole = exact_dedup.merged(own)
        values = whole.values().tolist()
        assert values == sorted(set(values)) and whole.runs.sum() == len(values)
        got |= {(k << 64 - bits) + v: n for v, n in zip(values, whole.counts.tolist(), strict=True)}
    assert got == collections.Counter(x for p in parts for x in p)
    assert exact_dedup.merged(filters).counts.sum() == sum(map(len, parts))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_near(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_groups(n=120):
    """A large group of varied copies, chains of copies of copies, and texts that share a passage."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 900, 80)]
    rows = []
    for k in range(n):
        w = list(base)
        for i in rng.integers(0, 80, rng.integers(0, 5)):
            w[i] = f"z{rng.integers(0, 10**6)}"
        rows.append((1000 + k, " ".join(w)))
    chain = [f"c{k}" for k in range(60)]
    for k in range(30):
        chain = [*chain[1:], f"d{k}"]
        if k % 4 == 0:
            rows.append((2000 + k, " ".join(chain)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(3000 + k, passage + " " + " ".join(f"q{k}_{j}" for j in range(25))) for k in range(50)]
    return rows


@pytest.mark.parametrize("each", [8, 0])
def test_minhash_dedup(spark, odd, each, monkeypatch):
    """each: 0 lets sets meet in all cells."""
    monkeypatch.setattr(minhash_dedup, "PAIRS_EACH", each)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 256 if each else 20)
    rows = [(d, t) for d, t, _ in ODD] + near_groups()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = minhash_dedup.minhash_dedup(df, limit=10**6 if each else 0).collect()
    want = plain_near([(d, t) for d, t in rows if d is not None])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    if each:
        assert minhash_dedup.minhash_dedup(odd.limit(0)).count() == 0


def test_minhash_of_repeated_ids(spark):
    """Rows of one doc_id with different texts are judged each by its own text, whatever the order of rows."""
    a, b = ([f"{x}{k}" for k in range(40)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "more"])), (3, " ".join([*b, "more"])), (2, " ".join(f"c{k}" for k in range(9))), (2, "one"), (2, "one")]
    for order in (rows, rows[::-1]):
        got = minhash_dedup.judged(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(1, 36, 1, True), (1, 36, 1, True), (2, 1, 2, True), (2, 1, 2, True), (2, 5, 2, True), (2, 37, 1, False), (3, 37, 1, False)]


def test_minhash_of_the_table(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8(spark, sf).collect()} == plain_near(rows)


def test_minhash_of_empty_texts_alone(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, minhash_dedup.minhash_dedup(df).collect())) == [(k, 0, k, True) for k in (1, 2, 3)]


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 20)) for _ in range(30)]
    sets = [np.sort(segments.mix(s.astype(np.uint64))) for s in [*sets, np.empty(0, np.int64)]]
    for at_once in (10**6, 50):
        got = minhash_dedup.common_counts(sets, np.array([3, 7]), at_once)
        assert got.tolist() == [[len(np.intersect1d(sets[i], s)) for s in sets] for i in (3, 7)]


def vectors(n=260, d=24):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d))
    x[60:200] = x[:1] + rng.normal(size=(140, d)) * rng.uniform(0.02, 0.25, (140, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize("block,kind", [(1024, "float"), (30, "double")])
def test_embedding_dedup(spark, block, kind):
    x = vectors()
    x[100] = x[101] = x[102]  # equal ones
    rows = [(k, v.tolist(), k % 2 if k < 60 else 0) for k, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [1.0, None], 0), (903, [float("nan")] * 24, 0), (904, x[60].tolist(), None), (905, x[60, :8].tolist(), 0), (906, [], 0), (907, x[61].tolist(), 1), (None, x[60].tolist(), 0)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("kept", F.lit("clash"))
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, block=block).collect()}
    links, root = plain_links(x, np.array([r[2] for r in rows[: len(x)]]))
    assert [got[k]["n_links"] for k in range(len(x))] == links.tolist()
    assert [got[k]["component_id"] for k in range(len(x))] == root.tolist()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 908)) and got[None]["component_id"] is None
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_of_repeated_ids(spark):
    """Rows of one vec_id are judged each by its own embedding; each counts as a vector."""
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(1, one), (1, two), (2, one), (3, two), (3, two), (4, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame([(d, v, "l") for d, v in rows], "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in embedding_dedup.embedding_dedup(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def plain_links(x, label, least=0.93):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (y @ y.T >= least) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(linked, root, len(x)).min(1))
        if (low == root).all():
            return linked.sum(1), root
        root = low


def test_op2_finds_planted_pairs(spark, sf, tmp_path):
    """The query over the table with neighbours at cosines of just over and below the threshold: recall, and nothing below."""
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x, rng = np.array([r[1] for r in rows]), np.random.default_rng(8)
    new, ids = [], []
    for k in range(0, len(rows), 2):
        v = x[k] / np.linalg.norm(x[k])
        o = rng.normal(size=x.shape[1])
        o -= (o @ v) * v
        c = (0.931, 0.929, 0.95, 0.99)[k // 2 % 4]
        new.append(c * v + np.sqrt(1 - c * c) * o / np.linalg.norm(o))
        ids.append((10**6 + k, k))
    every = [(r[0], list(map(float, r[1])), r[2]) for r in rows] + [(d, v.tolist(), rows[k][2]) for (d, k), v in zip(ids, new, strict=True)]
    kind = duckdb.sql(f"SELECT typeof(label), typeof(embedding) FROM '{sf}/embeddings.parquet' LIMIT 1").fetchall()[0]
    schema = f"vec_id long, embedding array<{'float' if kind[1].startswith('FLOAT') else 'double'}>, label {'string' if kind[0] == 'VARCHAR' else 'long'}"
    spark.createDataFrame(every, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy("vec_id").collect()
    y, labels = np.array([r["embedding"] for r in stored]), np.array([hash(r["label"]) for r in stored])
    links, root = plain_links(y, labels)
    got = {r["vec_id"]: r for r in queries.op2(spark, str(tmp_path)).collect()}
    n = np.array([got[r["vec_id"]]["n_links"] for r in stored])
    assert links.sum() > 300 and (n <= links).all() and n.sum() >= 0.999 * links.sum()
    assert np.mean([got[r["vec_id"]]["component_id"] == stored[k]["vec_id"] for r, k in zip(stored, root.tolist(), strict=True)]) >= 0.999


def test_hadamard_rotation_keeps_angles():
    x = np.random.default_rng(0).normal(size=(5, 24))
    y = embedding_dedup.rotate(x, 3)
    assert np.allclose(x @ x.T, y @ y.T)


# -- chats, URLs, toxicity


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]), st.lists(st.sampled_from([*chat_format._CONTROLS, "<\\s>", "\\", "[", "<", "a", " "]), max_size=6).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    text = "".join(chat_format.format_turn(role, [{"type": "text", "text": t}])[0] for role, t in turns)
    parser = chat_format.Parser()
    assert [x for k in range(0, len(text), 7) for x in parser.feed(text[k : k + 7])] == turns and parser.rest == ""


def test_chat_table(spark):
    rows = [(3, 1, "user", "y" * 20000), (1, 2, "assistant", "</s> a\u00e9"), (1, 1, "user", None), (1, None, "system", "s"), (2, 1, "assistant", ""), (2, 1, "assistant", "x"), (None, 1, None, "[INST]"), (3, 1, "user", "y" * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_conversations(df)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=order)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4 and chat_format.conversation_digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 1024, 600, None, None), ("audio", None, "a.wav", None, None, 2500, None), ("document", None, "d.pdf", None, None, None, 3)]
    kind = "array<struct<type: string, text: string, ref: string, width: int, height: int, millis: int, pages: int>>"
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None, None, None, None)])], f"conv_id long, turn long, role string, parts {kind}")
    a, b = chat_format.format_conversations(df).orderBy("turn").collect()
    assert a["formatted"] == "[INST]see <\\|image|><|image|><|audio|><|document|>[/INST]" and a["loss_start"] == a["loss_end"]
    assert [(x["kind"], x["ref"], x["tokens"]) for x in a["attachments"]] == [("image", "i.png", 4 * 256), ("audio", "a.wav", 75), ("document", "d.pdf", 1536)]
    assert all(a["formatted"][x["at"] :].startswith(f"<|{x['kind']}|>") for x in a["attachments"]) and a["tokens"] == 1024 + 75 + 1536
    whole = a["formatted"] + b["formatted"]
    assert whole[b["loss_start"] : b["loss_end"]] == "ok"


def test_op4_reads_back_in_any_order(spark):
    rows = [(c, t, r, f"{c} {t} </s> text") for c in range(5) for t, r in enumerate(["system", "user", "assistant", "assistant"])]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(map(tuple, chat_format.conversation_digests(formatted).collect()))
    assert sorted(map(tuple, chat_format.conversation_digests(formatted.orderBy(F.desc("turn")).repartition(7)).collect())) == want and len(want) == 5


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op3_exact_dedup", "op4_chat_format", "op8_minhash_dedup", "op9_url_filter"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, want)) and want


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "https://a.net/fr/1?x", "http://spam-farm.example.org/en/9", "https://ordinary.example.org/de/5#t", "http://com", "a://b://c/d", "http://é.org/\U0001f600", "http://h.com/" + "p" * 9000, "http://x.com/\nen/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    assert [(got[k]["host"], got[k]["path"]) for k in range(len(urls))] == [url_filter.parts(u) for u in urls]
    assert [(got[k]["rule"], got[k]["verdict"]) for k in (0, 3, 4, 5, 6, 7, 8)] == [(None, "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block"), (None, "block"), (None, "allow"), (None, got[8]["verdict"])]
    bias, weights = url_filter.train()
    for k, u in enumerate(urls):
        if got[k]["rule"] is None:
            g = url_filter.grams(url_filter.marked(*url_filter.parts(u)))
            assert got[k]["verdict"] == ("block" if g and sum(weights[x] + bias for x in g) > 0 else "allow")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    key = lambda r: r[0]
    assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.oracle_sql()})").fetchall(), key=key) == sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.values()), key=key)
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_url_training_rows_are_told_apart():
    bias, weights = url_filter.train()
    assert all((sum(weights[g] + bias for g in url_filter.grams(url_filter.marked(*url_filter.parts(u)))) > 0) == bool(y) for u, y in url_filter.LABELLED)


def toxic_rows():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8)))
    rows = []
    for d in range(600):
        w = [word() for _ in range(rng.integers(10, 80))]
        if d % 4 == 0:
            for _ in range(rng.integers(2, 4)):
                w.insert(rng.integers(0, len(w)), "vyx" + "".join(rng.choice(list("aeiou"), 3)) if d % 8 else "zombog")
        rows.append((d, " ".join(w), int(d % 4 == 0)))
    return rows


def test_toxicity(spark, odd):
    rows = toxic_rows()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    held = [(d, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[d]["predicted"] == y for d, y in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    out = toxicity.score_toxicity(odd, model)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"] and out.count() == len(ODD)
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(docs.limit(0), labels)
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_toxicity_counts_all_training_rows(spark):
    """An expression that few training rows have is learnt, however few rows fit the logistic function."""
    rows = [(d, t + (" qwkzpf" if y and d % 40 == 0 else ""), y) for d, t, y in toxic_rows()]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, rows_per_class=5)
    assert word_values(model, ["qwkzpf"])[0, 0] > 0.5


def word_values(model, words):
    codes, _ = toxicity._codes("".join(words))
    ends = np.cumsum([len(w) for w in words])
    return model.words(codes, ends - np.diff(ends, prepend=0), ends)


def test_unknown_words_back_off_to_what_is_inside(spark):
    """A known toxic stem behind any prefix tells as well, from the contexts inside it."""
    rows = toxic_rows()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    values = word_values(toxicity.fit_toxicity(docs, labels), ["zombog", "zombogs", "prezombog", "azombog", "superzombog", "aeiou", "lunar"])
    assert (values[:5] > 2 * toxicity.RATE).all() and (values[:5] > 2 * np.abs(values[5:]).max(0)).all()


def plain_signs(word):
    """The symbols of a word with four edges before and one behind it."""
    sign = lambda c: "abcdefghijklmnopqrstuvwxyz".find(c) if "a" <= c <= "z" else 26 if c.isdigit() else 27 + ord(c) % 4
    return [31] * 4 + [sign(c) for c in word] + [31]


def plain_probabilities(words):
    """p(order, context, symbol) for toxic, ordinary and both, by the recursion, of {word: (toxic, ordinary)}."""
    counts = {5: collections.defaultdict(lambda: [0, 0, 0])}
    for w, n in words.items():
        z = plain_signs(w)
        for k in range(4, len(z)):
            c = counts[5][tuple(z[k - 4 : k + 1])]
            for i, x in enumerate((n[0], n[1], sum(n))):
                c[i] += x
    for k in range(4, 0, -1):
        counts[k] = collections.defaultdict(lambda: [0, 0, 0])
        for gram, n in counts[k + 1].items():
            for i in range(3):
                counts[k][gram[1:]][i] += n[i] > 0
    off, by = {}, {}
    for k, own in counts.items():
        once, twice = ([sum(n[i] == m for n in own.values()) for i in range(3)] for m in (1, 2))
        off[k] = [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(once, twice, strict=True)]
        by[k] = collections.defaultdict(dict)
        for gram, n in own.items():
            by[k][gram[:-1]][gram[-1]] = n

    @functools.cache
    def sums(k, h):
        seen = by[k].get(h, {}).values()
        return [sum(n[i] for n in seen) for i in range(3)], [sum(min(n[i], off[k][i]) for n in seen) for i in range(3)]

    @functools.cache
    def p(k, h, x):
        if k == 0:
            return [1 / 32] * 3
        lower, (total, low), mine = p(k - 1, h[1:], x), sums(k, h), by[k].get(h, {}).get(x, [0, 0, 0])
        above = [max(n - d, 0) for n, d in zip(mine, off[k], strict=True)]
        both = (above[2] + low[2] * lower[2]) / total[2] if total[2] else lower[2]
        known = total[2] / (total[2] + toxicity.KNOWN)
        return [*((above[i] + low[i] * lower[i] + toxicity.SHARED * (known * both + (1 - known) * lower[i])) / (total[i] + toxicity.SHARED) for i in range(2)), both]

    return p, counts


def plain_features(texts, words):
    p, _ = plain_probabilities(words)
    out = []
    for t in texts:
        top, length = np.zeros(2), 0.0
        for w, n in collections.Counter(re.findall(r"[^\W_]+", "".join(c.lower() if len(c.lower()) == 1 else c for c in t or ""))).items():
            z, ratio = plain_signs(w), 0.0
            for k in range(4, len(z)):
                a, b, _ = p(5, tuple(z[k - 4 : k]), z[k])
                ratio += np.log(a / b)
            top += np.log2(1 + n) * np.array([np.log(1 + toxicity.RATE * (np.exp(np.clip(ratio, -30, 30)) - 1)), np.clip(ratio, -toxicity.CLIP, toxicity.CLIP)])
            length += np.log2(1 + n)
        mean = top / length if length else np.zeros(2)
        out.append([mean[0], mean[0] * length**0.5, mean[1], mean[1] * length**0.5])
    return np.array(out)


def counted_words(rows):
    counts = collections.defaultdict(lambda: np.zeros(2))
    for t, y in rows:
        for w in set(re.findall(r"[^\W_]+", "".join(c.lower() if len(c.lower()) == 1 else c for c in t or ""))):
            counts[w][1 - y] += 1
    return counts


ODD_TEXTS = [("\U00020001\U00020002 한국 \U00020001 été étés ²", 1), ("\U00020001\U00020002", 1), (None, 0), ("", 1), ("..", 0)]


@pytest.mark.parametrize("merged", [False, True])
def test_kneser_ney_against_the_plain_one(spark, merged, monkeypatch):
    """The distributed counts and the table give what the definition gives, for texts of any characters; no count is dropped."""
    texts = [(t, y) for _, t, y in toxic_rows()] + ODD_TEXTS
    words = counted_words(texts)
    p, counts = plain_probabilities(words)
    if merged:  # the counts of a task, put together in between
        monkeypatch.setattr(toxicity, "STEP", 2000)
        kind = pa.schema([("text", pa.string()), ("toxic", pa.int64()), ("fold", pa.int32())])
        batches = [pa.RecordBatch.from_pylist([{"text": t, "toxic": y, "fold": i % 2} for i, (t, y) in enumerate(texts[k : k + 50])], kind) for k in range(0, len(texts), 50)]
        rows = [r for b in toxicity._counted(iter(batches)) for r in b.to_pylist()]
        got = collections.defaultdict(lambda: [0, 0])
        for r in rows:
            got[r["cell"]] = [got[r["cell"]][0] + r["toxic"], got[r["cell"]][1] + r["ordinary"]]
        assert len({(r["cell"], r["fold"]) for r in rows}) == len(rows) > len(got)
        assert got == {functools.reduce(lambda c, x: c << 5 | x, g): n[:2] for g, n in counts[5].items()}
        return
    df = spark.createDataFrame(texts, "text string, toxic int").withColumn("fold", F.lit(0)).repartition(3)
    grams = df.mapInArrow(toxicity._counted, "cell int, fold int, toxic long, ordinary long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).cache()
    model = toxicity.fitted_counts(grams)
    rng = np.random.default_rng(1)
    cells = [*counts[5], *(tuple(rng.integers(0, 32, 5).tolist()) for _ in range(200)), *((*g[:4], int(x)) for g in list(counts[5])[:200] for x in rng.integers(0, 32, 3))]
    want = [np.log(a / b) for g in cells for a, b, _ in [p(5, g[:4], g[4])]]
    assert np.allclose(model.evidence(np.array([functools.reduce(lambda c, x: c << 5 | x, g) for g in cells])), want, rtol=2e-3, atol=1e-3)
    some = [*(t for _, t, _ in toxic_rows()[:40]), None, "", "...", "Zombog zombog vyxaaa été", "\U00020001\U00020002", "x" * 400, "vyxaaa " * 50]
    features = toxicity.Scorer(model).evidence([t or "" for t in some])
    assert np.allclose(features, plain_features(some, words), rtol=5e-3, atol=1e-2) and features[-1, 0] > 0


def test_kneser_ney_sums_to_one():
    """After any context the probabilities of all symbols, those that never follow it too, add up to one for each class, in the
    definition and in the tables."""
    p, counts = plain_probabilities({"abab": np.array([2, 0]), "abba": np.array([9, 3]), "baab": np.array([0, 7])})
    for h in {g[:-1] for g in counts[5]} | {(5, 6, 7, 8), (31, 31, 0, 9)}:
        assert np.allclose(np.sum([p(5, h, x) for x in range(32)], axis=0), 1)
    dense = [np.zeros(32**4) for _ in range(3)]
    for g, n in counts[4].items():
        for k in range(3):
            dense[k][functools.reduce(lambda c, x: c << 5 | x, g)] = n[k]
    for x in toxicity.lower_orders(dense):
        assert np.allclose(x.reshape(-1, 32).sum(1), 1)


def test_op1_against_the_plain_score(spark, sf):
    """The scores of the whole table by the definition: counts, evidence, fit and all."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    part = lambda d, n: zlib.crc32(str(d).encode()) % n
    training = [(d, t, label[d]) for d, t in docs if d in label and part(d, 3) != 1]
    fold = {r["d"]: r["f"] for r in spark.createDataFrame([(d,) for d, _, _ in training], "d long").select("d", F.expr("pmod(xxhash64(cast(d as string)), 3)").alias("f")).collect()}
    x, y = [], []
    for k in range(3):
        mine = [(t, y) for d, t, y in training if fold[d] == k]
        x.append(plain_features([t for t, _ in mine], counted_words([(t, y) for d, t, y in training if fold[d] != k])))
        y += [y for _, y in mine]
    weights = toxicity.fit_logistic(np.concatenate(x), np.array(y, float))
    z = plain_features([t for _, t in docs], counted_words([(t, y) for _, t, y in training])) @ weights[1:] + weights[0]
    got = {r["doc_id"]: r for r in queries.op1(spark, sf).collect()}
    assert np.allclose([got[d]["score"] for d, _ in docs], 1 / (1 + np.exp(-z)), atol=2e-2)
    assert all(got[d]["held_out"] == (part(d, 3) == 1) and got[d]["predicted"] == (got[d]["score"] >= 0.7) for d, _ in docs)


def test_held_out_toxicity(spark):
    """Of the table: what is found has a toxic label, ordinary rows are left alone."""
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = [r for r in queries.op1(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= 0.95
    assert not any(r["predicted"] and not truth[r["doc_id"]] for r in rows)


# -- the pipeline


def test_pipeline(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    toxic = {r["doc_id"] for r in queries.op1(spark, sf).collect() if r["predicted"]}
    kept, seen = [], set()
    for d, t in sorted(docs):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if d not in toxic and norm not in seen:
            seen.add(norm)
            kept.append((d, t))
    near = plain_near(kept)
    left = {d: t for d, t in kept if near[d][1] == d}
    assert {r["doc_id"] for r in rows} == set(left)
    total = collections.Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert all(total[d] == len(ids_of(t, 1)) for d, t in left.items())


def test_stages_drop_rows_not_ids(spark, sf):
    """Of two rows of one doc_id with different texts, only the one that is a copy goes."""
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (2, "other text"), (2, long), (3, long + " more"), (3, "third")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.exact(spark, df, sf).collect()}
    assert left == {(1, long), (2, "other text"), (3, long + " more"), (3, "third")}
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, df, sf).collect()}
    assert left == {(1, long), (2, "other text"), (3, "third")}


def test_stages_on_odd_rows(spark, odd, sf):
    rows = odd.select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    for df in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert name == "packing" or out.columns == rows.columns
            assert out.count() <= 10 * len(ODD)


def test_toxicity_model_takes_little_of_the_driver():
    """The probabilities of the longest context that the driver makes are worth 24 MB; what is worked with beside them is a small part of that."""
    import tracemalloc

    counts = [np.random.default_rng(k).integers(0, 3, toxicity.SYMBOLS ** (toxicity.ORDER - 1)).astype(np.uint8) for k in range(3)]
    tracemalloc.start()
    p = toxicity.lower_orders(counts)
    evidence = toxicity._evidence_of(p)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.allclose(x.reshape(-1, toxicity.SYMBOLS).sum(1), 1) for x in p) and np.isfinite(evidence).all()
    assert most < 40e6
