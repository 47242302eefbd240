"""Each operator against its plain version on texts with the awkward cases."""

import math
import os
import sys
import tempfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from crosspanel.llm import (  # noqa: E402
    decontamination, embeddings, graph, kneser_ney, language, near_dedup, packing, pii, quality, text, token_counts,
    url_filters)
from crosspanel.llm.queries import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def texts():
    return plain.awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return plain.documents(spark, texts).repartition(3).cache()


def test_word_hashes_name_words():
    import pyarrow as pa
    rows = ["Aa b\tc", "", None, "aa", "x" * 3_000_000 + " b", "é É"]
    data, offsets = text.text_bytes(pa.array(rows))
    hashes, first = text.word_hashes(data, offsets)
    words = [w for r in rows for w in plain.white_words(r)]
    assert np.diff(first).tolist() == [3, 0, 0, 1, 2, 2] and len(set(hashes.tolist())) == len(set(words))
    assert [hashes[words.index(w)] for w in words] == hashes.tolist()


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    rows = [*pairs, (None, 3)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()))
    nodes = {n for p in pairs for n in p}
    want = plain.components(nodes, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, docs, texts, width):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, width).collect()}
    assert got == plain.near_duplicates(list(enumerate(texts)), width)


def test_near_duplicates_beyond_the_hub(spark):
    """Members that the smallest of a bucket doesn't reach are linked with each other."""
    words = [f"v{k}" for k in range(400)]
    rows = [(k, " ".join(words[:at] + [f"q{k}"] * ((k * 37) % 60) + words[at + 60:])) for k, at in enumerate(range(0, 300, 5))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == plain.near_duplicates(rows)


def test_keep_one(spark, docs, texts):
    want = {k for k, (_, _, kept) in plain.near_duplicates(list(enumerate(texts))).items() if kept}
    out = near_dedup.keep_one(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    again = near_dedup.keep_one(docs.unionByName(docs).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))))
    rows = [r.doc_id for r in again.collect()]
    assert sorted(x for x in rows if x is not None) == sorted(want) and rows.count(None) == 2


def test_contamination(spark, docs, texts):
    items = [(0, texts[9]), (1, "one two"), (2, None), (3, " - "), (10, texts[20]), (4, "of"), (None, "w1 w2 w3"),
             (5, " ".join(f"w{k}" for k in range(40, 60))), (6, texts[9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain.contamination(list(enumerate(texts)), items)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    assert got == want
    many = decontamination.with_occurrences(docs.select("doc_id", "text"), bench, block_bytes=40)
    assert {r.doc_id: r.occurrences["items"] for r in many.collect()} == {k: v[2] for k, v in want.items()}
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[3]}
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_personal_data(spark):
    import random
    rng, signs = random.Random(5), "a.@-1234567890 +()%_é\U0001F600"
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 150)))) for k in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 4111 1111 1111 1111 000001.2.3.255 +49 (30) 1234567"),
             (5003, "1" * 3_000), (5004, "a" * 3_000 + "@" + "b.c" * 20_000), (5005, "x@y.zz " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.find_personal_data(docs)
    got = {r.doc_id: r.d for r in spans.select("doc_id", pii.digest(F.filter("spans", lambda s: s.kind.isin(*pii.BASE))).alias("d")).collect()}
    assert got == {k: ",".join(plain.base_spans(t)) for k, t in rows}
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[5000] is None and masked[5001] == "" and masked[5005] == "[EMAIL] " * 3000
    assert not any(plain.base_spans(t) for t in masked.values())
    assert all(masked[k] == t for k, t in rows if k < 1500 and not plain.base_spans(t))


def test_personal_data_in_long_runs(spark):
    """No expression tries every position of a long run."""
    rows = [(0, "1" * 1_000_000), (1, "a" * 1_000_000 + " q@r.st"), (2, "1.2." * 200_000), (3, "+1" + " " * 500_000)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [len(r.spans) for r in sorted(found.select("doc_id", "spans").collect())] == [0, 1, 100_000, 0]


def test_personal_data_scores(spark):
    rows = [(0, "IBAN GB82 WEST 1234 5698 7654 32."), (1, "GB82 WEST 1234 5698 7654 33"), (2, "my ssn is 123-45-6789"),
            (3, "part 123-45-6789"), (4, "mail me: a@b.cd"), (5, "666-45-6789 ssn")]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [(s.kind, s.start, s.end, s.value) for s in found[0]] == [("iban", 5, 32, "GB82 WEST 1234 5698 7654 32")]
    assert not found[1] and not found[3] and not found[5]
    assert [s.kind for s in found[2]] == ["ssn"] and found[4][0].score == 1.0


def test_mask_takes_what_is_found(spark):
    """A span that needs context is masked where it has it in the unmasked text."""
    rows = [(0, "my ssn is 123-45-6789."), (1, "part 123-45-6789"), (2, "ssn@x.org 123-45-6789"),
            (3, "666-45-6789 ssn"), (4, "ssn 1.2.3.123-45-6789"), (5, "social: 123-45-6789 a@b.cd 219-09-9999"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert got == {0: "my ssn is [SSN].", 1: rows[1][1], 2: "[EMAIL] [SSN]", 3: rows[3][1], 4: "ssn 1.2.3.[SSN]",
                   5: "social: [SSN] [EMAIL] 219-09-9999", 6: None}
    assert {r.doc_id for r in pii.find_personal_data(docs).where("exists(spans, s -> s.kind = 'ssn')").collect()} == {0, 2, 4, 5}


def test_mask_keeps_columns(spark, docs):
    out = pii.mask(docs.withColumn("text", F.concat("text", F.lit(" mail q@r.st"))))
    assert out.columns == docs.columns and out.where("text like '%@%' or n_chars <> length(text)").count() == 0


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, capacity = Tokenizer.from_file(path), 512
    got = packing.packed(docs, path, capacity).toPandas()
    want = set()
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            some = ids[at:at + capacity]
            want.add((k, piece, at, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert len(got) == len(want)
    rows = got.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= capacity
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // capacity) + 1
    assert packing.packed(docs.limit(0), path).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(2)
    for histogram in ({}, {2048: 3}, {1: 5000}, {1024: 7, 1025: 7, 1023: 9},
                      {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 500), rng.integers(1, 10_000, 500))}):
        made = packing.plan(histogram)
        used = {}
        for pattern, times in made:
            assert sum(n * m for n, m in pattern) <= 2048 and times > 0
            for n, m in pattern:
                used[n] = used.get(n, 0) + m * times
        assert used == histogram
        least = -(-sum(n * c for n, c in histogram.items()) // 2048)
        assert sum(t for _, t in made) <= max(least, sum(c for n, c in histogram.items() if n > 1024)) * 1.03 + 12
        assert len(made) <= 8192


def test_packing_fits_long_lengths():
    """Where all lengths occur, the fit has patterns of every longest length and makes the plan."""
    histogram = {n: 1000 for n in range(1, 2048)}
    fit = packing.fitted(histogram, 2048)
    assert {max(p) for p, _ in fit} >= set(range(1024, 2048))
    assert sum(w for p, w in fit if max(p) > 1024) > 0.9 * 1000 * 1023
    made = packing.plan(histogram)
    patterns = {tuple(sorted(p.items())) for p, _ in fit}
    assert sum(t for p, t in made if tuple(sorted(p)) in patterns) > 0.9 * sum(t for _, t in made)


def test_chunks_tokenize_alone():
    """The ids of a text are those of its space-separated chunks."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for t in (*filter(None, plain.awkward_texts()), "é ́x ΑΣ Σ <|endoftext|> a<|startoftext|>b\x1cc\x85d 's'll"):
        apart = [i for c in t.encode().split() for i in tokenizer.encode(c.decode(), add_special_tokens=False).ids]
        assert apart == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_counts(spark, docs, texts):
    from tokenizers import Tokenizer, models
    vocabulary = token_counts.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    own = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    worst = min(s for _, s in vocabulary)
    assert worst < 0
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, vocabulary).collect()}
    for k, t in enumerate(texts):
        if t is None or len(t) < 20_000:
            assert got[k] == (len(own.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), t
    tied = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0)]
    own = Tokenizer(models.Unigram([("<unk>", 0.0), *tied], unk_id=0, byte_fallback=False))
    pieces, unknown = token_counts.automaton([("<unk>", 0.0), *tied])
    for t in ("ababab", "▁aba▁xyz", "ba▁éa", "a"):
        assert token_counts.count(pieces, unknown, t)[0] == len(own.encode(t).ids)


def test_token_counts_spell_bytes(spark, texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, models
    path = tokenizer_path("piece_bpe_32k.model")
    model, vocabulary = SentencePieceProcessor(model_file=path), token_counts.sentencepiece_vocabulary(path)
    spelled = [(model.id_to_piece(k), 0.0) for k in range(model.get_piece_size()) if model.is_byte(k)]
    own = Tokenizer(models.Unigram([("<unk>", 0.0), *spelled, *vocabulary], unk_id=0, byte_fallback=True))
    some = ["\n\n\n", "a\t\tb", "\uD7A3", "\uD7A3" * 10_000, "x \uD7A3\n \U0001F9FF\U0001F9FF y", None, "",
            *(t for t in texts if t and len(t) < 2000)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(
        plain.documents(spark, some), vocabulary, token_counts.has_byte_pieces(path)).collect()}
    assert [got[k] for k in range(4)] == [4, 4, 4, 30_001]
    assert got == {k: len(own.encode("▁" + t.replace(" ", "▁")).tokens) if t else 0 for k, t in enumerate(some)}


def test_language(spark, docs):
    train = {"aa": ["the cat and the hat", "And the rat"], "bb": ["der hut und die katze", "Die Ratte"]}
    rows = [(t, k) for k, some in train.items() for t in some] + [(None, "aa"), ("zz", None), ("", "bb")]
    trees = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(trees) == ["aa", "bb"]
    asked = [(0, "the hat"), (1, "die katze"), (2, None), (3, "123 !"), (4, ""), (5, "Zürich δ"), (6, "the " * 50_000)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), trees).collect()}
    for k, t in asked[:2] + asked[5:6]:
        bits = {name: plain.ppm_bits(train[name], t) for name in train}
        best = min(sorted(bits), key=bits.get)
        share = 1 / sum(2 ** (bits[best] - b) for b in bits.values())
        assert got[k].lang_pred == best and math.isclose(got[k].score, share, rel_tol=1e-9)
    assert [got[k].lang_pred for k in (2, 3, 4, 6)] == ["und", "und", "und", "aa"]
    assert {r.lang_pred for r in language.identify(docs, language.train(docs.limit(0))).collect()} == {"und"}


def test_language_keeps_rare_grams(spark):
    """A language of one short row keeps its tree beside one of millions of grams."""
    rng = np.random.default_rng(8)
    rows = [("".join(map(chr, rng.integers(0x4E00, 0x9FFF, 60_000))), "zz") for _ in range(20)] * 2
    rows += [("the cat and the hat", "aa")]
    trees = language.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert sorted(trees) == ["aa", "zz"] and trees["aa"][1].sum() == 19
    assert trees["zz"][1].sum() == 2 * 20 * 60_000 * 3
    asked = spark.createDataFrame([(0, "the hat"), (1, rows[0][0][:50])], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(asked, trees).collect()}
    assert [got[k].lang_pred for k in (0, 1)] == ["aa", "zz"]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language.train(docs.where(language.fold() != 2))
    found = language.identify(docs, trees).join(docs.where(language.fold() == 2), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_language_model(spark, texts):
    some = [t for t in texts if t is None or len(t) < 2000]
    model = kneser_ney.train(plain.documents(spark, some).repartition(3))
    asked = [*some, "alpha unseen beta", "the of in", None]
    got = sorted(kneser_ney.log_probabilities(plain.documents(spark, asked), model).collect())
    want, p, known = plain.kneser_ney(some, asked)
    assert model["tokens"] == sum(len(plain.white_words(t)) + 1 for t in some)
    for r, w in zip(got, want):
        np.testing.assert_allclose((r.n_tokens, r.n_known, r.base_score, r.score), w, rtol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-w[3] / w[0]), rel_tol=1e-9)
    for u in ("\0begin", "of", "w3"):
        assert math.isclose(sum(p(u, w) for w in [*known, "never seen"]), 1, rel_tol=1e-9)
    empty = kneser_ney.train(plain.documents(spark, some).limit(0))
    assert {(r.n_known, r.score) for r in kneser_ney.log_probabilities(plain.documents(spark, ["a b"]), empty).collect()} == {(0, 0.0)}


def plain_scores(train, rows, order):
    """log10 of each text's probability, by recursion over the orders."""
    from collections import Counter, defaultdict
    padded = lambda t: ["\0begin"] * (order - 1) + [*plain.white_words(t), "\0end"]
    counts = {order: Counter(tuple(s[i:i + order]) for s in map(padded, train) for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, after = {}, defaultdict(list)
    for k, some in counts.items():
        d[k] = kneser_ney.discounts(*(sum(c == n for c in some.values()) for n in (1, 2, 3, 4)))
        for g, c in some.items():
            after[g[:-1]].append(c)

    def p(context, w):
        if not context:
            seen, k, lower = after[()], 1, 1 / (len(counts[1]) + 1)
        else:
            seen, k, lower = after.get(context), len(context) + 1, p(context[1:], w)
        if not seen:
            return lower
        c = counts[k][(*context, w)]
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][min(x, 3)] for x in seen) * lower) / sum(seen)
    return [sum(math.log10(p(tuple(s[i:i + order - 1]), s[i + order - 1])) for i in range(len(s) - order + 1))
            for s in map(padded, rows)], p, [g[0] for g in counts[1]]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("spread", [True, False])
def test_language_model_orders(spark, texts, monkeypatch, order, spread):
    if not spread:
        monkeypatch.setattr(kneser_ney, "_frequent", lambda *_: np.zeros(0, np.uint64))
        monkeypatch.setattr(kneser_ney, "MANY", 3)
    some = [t for t in texts if t is None or len(t) < 2000]
    model = kneser_ney.train(plain.documents(spark, some).repartition(3), order=order)
    asked = [*some, "alpha unseen beta", "the of in the of", None]
    got = sorted(kneser_ney.log_probabilities(plain.documents(spark, asked), model).collect())
    want, p, known = plain_scores(some, asked, order)
    np.testing.assert_allclose([r.score for r in got], want, rtol=1e-9)
    context = ("\0begin",) * (order - 1)
    assert math.isclose(sum(p(context, w) for w in [*known, "never seen"]), 1, rel_tol=1e-9)
    assert model["tokens"] == sum(len(plain.white_words(t)) + 1 for t in some)


def test_frequent_words_spread(spark, texts, monkeypatch):
    """Spreading every previous word over the shards leaves the scores as they are."""
    rows = plain.documents(spark, [t for t in texts if t is None or len(t) < 2000])
    one = sorted(kneser_ney.log_probabilities(rows, kneser_ney.train(rows)).collect())
    monkeypatch.setattr(kneser_ney, "_frequent", lambda *_: np.zeros(0, np.uint64))
    two = sorted(kneser_ney.log_probabilities(rows, kneser_ney.train(rows)).collect())
    np.testing.assert_allclose([r.score for r in one], [r.score for r in two], rtol=1e-12)


def test_hash_tables():
    """Hashes that agree in all bits but the last are told apart, counts of any size come back."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 3000, 300_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        keys = np.unique(np.concatenate([keys, keys[:50] ^ np.uint64(1), keys[:50] ^ np.uint64(1 << 17)]))
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        kneser_ney._keep(f"{folder}/x", keys, np.arange(len(keys)))
        table = kneser_ney._kept(f"{folder}/x")
        some = np.concatenate([keys[::-1], keys ^ np.uint64(2)])
        place = {k: i for i, k in enumerate(keys.tolist())}
        want = [place.get(k, -1) for k in some.tolist()]
        assert kneser_ney._places(table, some).tolist() == want and table[-1][0].tolist() == [*range(len(keys))]
    sums = [np.array(x) for x in zip(*[(1, 1, 0, 0), (99, 2, 1, 3), (15, 3, 1, 1), (40, 0, 0, 1), (1 << 40, 5, 5, 9)])]
    small = kneser_ney._small(sums)
    assert [tuple(kneser_ney._SMALL[x]) if x < 255 else None for x in small.tolist()] == [(1, 1, 0, 0), None, (15, 3, 1, 1), None, None]


@pytest.mark.parametrize("order", [3, 4])
def test_many_frequent_words_in_parts(spark, texts, order):
    """Grams dealt over many shards, whose sums meet again, give the plain scores."""
    some = [t for t in texts if t is None or len(t) < 2000]
    rows = plain.documents(spark, some).repartition(3)
    model = kneser_ney.train(rows, shard_pairs=1500, order=order)
    assert len(np.unique(model["frequent"].value)) > 10
    names = {f.split("-")[0] for f in os.listdir(model["folder"])}
    assert {f"pairs{order}", f"far{order}", f"farcontexts{order}", f"spread{order}", "far2", "grams2"} <= names
    got = sorted(kneser_ney.log_probabilities(plain.documents(spark, some), model).collect())
    np.testing.assert_allclose([r.score for r in got], plain_scores(some, some, order)[0], rtol=1e-9)


def test_language_model_takes_little_disk(spark):
    """Tables of an order-3 model on short text, where nearly every gram is new, stay under four bytes a byte of text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    folder = kneser_ney.train(docs, order=3)["folder"]
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 4 * size


def test_quality(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.with_quality(table.select("doc_id", "text"), quality.train(table, labels)).join(labels, "doc_id") \
        .where(quality.fold() == 1)
    right = scored.agg(F.avg(((F.col("quality_score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95
    none = quality.with_quality(docs, quality.train(docs, labels.limit(0)))
    assert none.columns == [*docs.columns, "quality_score"] and {r.quality_score for r in none.collect()} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    scores = [r.quality_score for r in quality.with_quality(docs, quality.train(docs, odd)).collect()]
    assert len(scores) == docs.count() and all(0 < s < 1 for s in scores)


def test_additive_model():
    """Main effects and an interaction are learned; scores are sums of table entries."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((quality.scores(model, x) >= 0.5) == y).mean() > 0.95
    assert (0, 1) in {tuple(sorted(p[:2])) for p in model["pairs"]}


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "com", "/de/ok")]


def test_url_filters(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (0, "https://A.Example.org/es/1?utm_source=x#y", None), (1, "http://example.org/en", ""), (2, None, None),
        (3, "no url", "<html>"), (4, "http://x.com/de/1", ""), (5, "http://y.net/a/b", link.format("http://x.com/de/1")),
        (6, "http://z.net", '<meta content="0; url=//y.net/a/b" http-equiv="refresh">'), (7, "http://z.net#top", ""),
        (8, "http://x.com/de/ok", ""), (9, "http://q.net/a/", link.format("c")), (10, "http://q.net/a/c", link.format("/d")),
        (11, "http://q.net/d", link.format("http://x.com/de/ok")), (12, "http://q.net/d?utm_a=1&utm_b=2", link.format("http://x.com/de/2")),
        (13, "http://x.com/de/2", ""), (13, "http://x.com/de/2", ""), (14, "http://w.net/?a=1&utm_x=3&b=2", link.format("http://v.net/p")),
        (15, "http://w.net/?a=1&b=2", ""), (16, "://", ""), (17, "http://badexample.org/es/", "")]
    got = sorted(map(tuple, url_filters.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()))
    verdict = {r[0]: r[4] for r in got}
    assert len(got) == len(pages) and got[0] == (0, "a.example.org", "/es/1", "example.org/es/", "block")
    assert {k for k, v in verdict.items() if v == "block"} == {0, 4, 5, 6, 7, 13}
    assert got[2] == (2, "", "", None, "allow") and got[17 + 1][:4] == (17, "badexample.org", "/es/", "org/")
    moved = spark.createDataFrame([("http://v.net/p", "http://x.com/de/9"), ("http://x.com/de/9", "http://x.com/de/1")], "source string, target string")
    more = {r.page_id: r.verdict for r in url_filters.judged(
        spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, moved).collect()}
    assert more[14] == more[15] == "block"


LINKED_PAGES = [
    (0, "http://x.com/de/1?a=1&b=2", ""), (1, "http://x.com/de/2", ""), (2, "http://x.com/de/b/c", ""),
    (3, "http://a.net/1", '<link rel="canonical" href="http://x.com/de/1?a=1&amp;b=2">'),
    (4, "http://a.net/2", '<link rel=canonical href="http://a.net/2"><link href="http://x.com/de/2" rel="canonical">'),
    (5, "http://x.com/y/z", '<meta http-equiv="refresh" content="0; url=../de/b/./d/../c">'),
    (6, "http://x.com/q/", '<link rel="canonical" href="r?to=http://x.com/de/2">'), (7, "http://x.com/q/r?to=http://x.com/de/2", ""),
    (8, "http://b.net/", '<link rel="canonical" href="mailto:x">'), (9, "http://b.net/mailto:x", '<link rel="canonical" href="#top">'),
    (10, "http://c.net/p", '<link rel="canonical" href="?k=1">'), (11, "http://c.net/p?k=1", '<link rel="canonical" href="//x.com/de/2">'),
    (12, "http://d.net/a/../../b", '<link rel="canonical" href="https://x.com/en/../de/./2">'), (13, "http://d.net/b", None), (14, None, None)]


def test_url_links_of_all_kinds(spark):
    """Entities, several tags, dot segments, schemes inside a query, schemes without a host; the SQL says the same."""
    import duckdb
    import pandas as pd
    from crosspanel.llm import oracles
    pages = spark.createDataFrame(LINKED_PAGES, "page_id long, url string, html string")
    got = sorted(map(tuple, url_filters.judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert {r[0] for r in got if r[4] == "block"} == {0, 1, 2, 3, 4, 5, 10, 11, 12, 13}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(LINKED_PAGES, columns=["page_id", "url", "html"]))
    assert sorted(con.execute(oracles.url_filters(RULES)).fetchall()) == got


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vectors = [*base, *(base[k % 5] + rng.normal(size=16) * 0.15 * (k % 4) for k in range(80)), base[0], base[0] * 3]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, None] * 8), (504, []), (505, [1.0, 2.0]),
             (506, [2.0, 4.0]), (507, [float("inf")] * 16), (508, [1e-30] * 16), (509, [1e30] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sound = {k: np.array(v, np.float32).astype(float) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in sound.items()}
    edges = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    part = plain.components([k for k, _ in rows], edges)
    want = {k: (sum(k in e for e in edges), part[k], part[k] == k) for k, _ in rows}
    for size, pivots in ((8192, 64), (16, 3)):
        got = embeddings.near_vectors(table, group=size, pivots=pivots).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    none = embeddings.near_vectors(table.where("vec_id in (500, 501)").unionByName(table.where("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long"))))
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in none.collect()) == [(-1, 0, True), (500, 0, True), (501, 0, True)]


def test_quantised_bounds():
    rng = np.random.default_rng(6)
    x, y = (embeddings.unit(rng.normal(size=(300, 64)) * rng.exponential(1, (300, 64))) for _ in range(2))
    (qx, sx, ex), (qy, sy, ey) = embeddings.quantised(x), embeddings.quantised(y)
    near = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy[None]
    assert (np.abs(near - x @ y.T) <= ex[:, None] * (1 + ey[None]) + ey[None]).all()


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (3, "g h i j k l"), (None, "a b c d e f"), (2, "x"), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (3, 1, False), (0, None, True), (2, 2, True), (2, 2, True)], key=str)


def test_clashing_columns(spark, docs):
    """Columns named as the stages name their own come back as they were."""
    names = ["kept_ssn", "Kept_SSN_", "_kept_ssn", "occurrences", "__occurrences", "quality_score", "QUALITY_score_",
             "__quality", "chosen", "Chosen_", "__gone", "__again", "component", "node", "n", "hub"]
    rows = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in names))
    twice = rows.unionByName(rows)
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    bench = spark.createDataFrame([(0, "one two")], "item_id long, text string")
    for out in (pii.mask(rows), near_dedup.keep_one(rows), near_dedup.keep_one(twice), quality.keep_good(rows, labels, 0.0),
                decontamination.drop_contaminated(rows, bench)):
        assert out.columns == rows.columns
        got = out.select("doc_id", *(F.col(f"`{c}`") for c in names)).collect()
        assert len(got) and all(tuple(r)[1:] == tuple(f"{c} {r.doc_id}" for c in names) for r in got)


def test_parts_of_words(spark):
    """Words encoded by parts, kept, dropped and met again have the tokenizer's ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [*plain.awkward_texts(), "it's IT'S 'S a's", "x<|endoftext|>y <|ENDOFTEXT|> A", "ÀÉ×÷ß Áa\u0301b 12a3 --a..b <|",
            "K\u212a İ ſ ǅ \u00b5", "é" + "z" * 300, "z" * 300, "", None]
    encoder = packing.Encoder(tokenizer, 0)
    encoder.words.most = encoder.parts.most = 40
    for some in (rows, rows[::-1], *([r] for r in rows)):
        ids, n = encoder.of(*text.text_bytes(pa.array(some, pa.string())))
        want = [[*tokenizer.encode(r or "", add_special_tokens=False).ids, 0] for r in some]
        assert n.tolist() == [*map(len, want)] and ids.tolist() == [i for w in want for i in w]


def test_workers_memory_stays_as_batches_grow(monkeypatch):
    """A worker's arrays are bounded by a slice of texts, not by the Arrow batch, and slices leave the results alone."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    words = np.array([f"{a}{b}" for a in ("in", "re", "over", "un") for b in ("do", "turn", "view", "load", "come")])
    some = [" ".join(words[np.random.default_rng(k).integers(0, len(words), 300)]) for k in range(400)]

    def peak(run, times):
        batch = pa.record_batch([pa.array(range(400 * times)), pa.array(some * times)], ["doc_id", "text"])
        tracemalloc.start()
        try:
            made = [out.column("ids_crc32" if "ids_crc32" in out.schema.names else 1).to_pylist() for out in run(iter([batch]))]
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        return most, [x for out in made for x in out], len(some[0]) * len(some) * times

    for run in (packing._cut(tokenizer, 2048, 0), near_dedup._describe(5, 60)):
        small, once, size = peak(run, 1)
        large, often, _ = peak(run, 8)
        assert size > 1 << 19 and often == once * 8
        assert large < 1.6 * small


def test_counts_beyond_32_bits():
    """Counts cross the exchange and stay in the files whole."""
    huge = np.array([1, 1 << 33, 3], np.int64)
    before, word = np.array([5, 5, 6], np.uint64), np.array([7, 8, 7], np.uint64)
    hashes = kneser_ney.pair_hashes(before, word)
    rows = kneser_ney._blocks([before], [np.zeros(3, bool)], hashes, word, (huge,), 1)
    (b,), w, _, (count,) = kneser_ney._grams(kneser_ney._rows(rows), 1)
    assert {(x, y): c for x, y, c in zip(b.tolist(), w.tolist(), count.tolist())} == {(5, 7): 1, (5, 8): 1 << 33, (6, 7): 3}


def test_huge_counts_reach_the_scores(spark, monkeypatch):
    """Grams that stand 2 ** 33 times as often count so in the sums and in c of the base score."""
    grams = kneser_ney._grams

    def more(table, n):
        before, word, bits, counts = grams(table, n)
        return before, word, bits, [x << 33 for x in counts] if n == 2 else counts
    monkeypatch.setattr(kneser_ney, "_grams", more)
    model = kneser_ney.train(plain.documents(spark, ["a b a b", "a c"]), order=3)
    assert model["tokens"] == 8 << 33
    got, = kneser_ney.log_probabilities(plain.documents(spark, ["a"]), model).collect()
    n, v = 8 << 33, 4
    want = sum(math.log10((c * 2.0 ** 33 + 0.1) / (n + 0.1 * (v + 1))) for c in (3, 2))
    assert math.isclose(got.base_score, want, rel_tol=1e-12) and math.isfinite(got.score)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_one(none).columns == docs.columns
    assert pii.find_personal_data(none).count() == 0 and pii.mask(none).count() == 0
    assert token_counts.token_counts(none, [("▁", -1.0), ("a", -2.0)]).count() == 0
    assert kneser_ney.log_probabilities(none, kneser_ney.train(docs)).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert url_filters.judged(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0
    assert quality.with_quality(none, quality.fit(np.zeros((0, 20)), np.zeros(0))).count() == 0
