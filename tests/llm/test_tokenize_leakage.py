import random

import pyarrow as pa
import pytest

from gleaner.llm import leakage, tokenize

TEXTS = [None, "", " ", "  \n\n\t x", "<|endoftext|> hi", "日本語テキスト🙂🙂", "a" * 20000, "don't I'LL we've", "\x00\x01", "é" * 30, "!!!!!???" * 50, "x​ y ", "Ünïcödé 12,345.67", "lowerUPPER"]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenize.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aeiou tnrs'–éß1 ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    got = {r["doc_id"]: r["ids"] for r in tokenize.token_ids(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    assert tokenize.token_ids(df.where("false"), "doc_id", "text").count() == 0


def test_round_trip():
    enc = tokenize.encoder(tokenize.tokenizer_path())
    for text, ids in zip(TEXTS, enc.encode(TEXTS).to_pylist()):
        assert b"".join(enc.bytes_of[i] for i in ids) == (text or "").encode()


def test_speculation_fails_at_times_and_is_mended():
    enc = tokenize.Encoder(tokenize.tokenizer_path())
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdefghilmnoprstuz") for _ in range(rng.randint(4, 14))) for _ in range(2000)}
    enc.learn(list(words))
    raw = {w: enc.propose(w.encode()) for w in words}
    assert any(enc.words[w] != raw[w] for w in words) and any(enc.words[w] == raw[w] and len(raw[w]) > 1 for w in words)
    assert all(enc.words[w] == enc.merge(w.encode()) for w in words)


def test_merging_together_equals_merging_alone():
    enc = tokenize.encoder(tokenize.tokenizer_path())
    rng = random.Random(9)
    words = ["".join(rng.choice(["a", "b", "an", "the ", "é", "1", " ", "ing"]) for _ in range(rng.randint(1, 30))).encode() for _ in range(500)] + [b"x", b"a" * 64]
    tokens, count = enc.merge_all(words)
    ends = count.cumsum().tolist()
    assert [tokens[a:b].tolist() for a, b in zip([0, *ends], ends)] == [enc.merge(w) for w in words]
    assert enc.merge_all([])[0].tolist() == [] and len(enc.merge(b"ab" * 100_000)) > 0


def test_slices_keep_all_rows():
    batch = pa.record_batch({"k": list(range(6)), "t": ["x" * 30, None, "", "y" * 90, "z", "w" * 40]})
    parts = list(tokenize._slices(batch, 1, 50))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 1


def vocabulary(n=400):
    return [f"w{i}" for i in range(n)]


@pytest.mark.parametrize("sent", [leakage.SENT_WORDS, 0])
def test_exact_overlaps_equal_brute_force(spark, sent):
    rng = random.Random(7)
    words = vocabulary()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 40)))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for i in range(120):
        body = rng.choices(words, k=rng.randint(0, 30))
        if rng.random() < 0.5:
            source = rng.choice(items[:12])[1].split()
            n = rng.randint(10, 18)
            at = rng.randint(0, max(0, len(source) - n))
            body = body[:10] + source[at : at + n] + body[10:]
        text = " ".join(body)
        docs.append((i, text.upper() if i % 5 == 0 else text.replace(" ", rng.choice([" ", ",  ", "\n"])).replace("w1", "ｗ１")))
    docs += [(500, None), (501, ""), (3, docs[3][1])]
    grams = {}
    for k, t in items:
        w = leakage.words_of(t)
        for j in range(len(w) - 13):
            grams.setdefault(tuple(w[j : j + 14]), set()).add(k)
    expected = {(d, k) for d, t in docs for w in [leakage.words_of(t)] for j in range(len(w) - 13) for k in grams.get(tuple(w[j : j + 14]), ())}
    assert len(expected) > 10
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = leakage.overlaps(d, "doc_id", "text", i, "item_id", "text", sent_words=sent).where("exact").collect()
    assert len(got) == len(expected) and {(r["doc_id"], r["item_id"]) for r in got} == expected
    assert leakage.overlaps(d.where("false"), "doc_id", "text", i, "item_id", "text", sent_words=sent).count() == 0
    assert leakage.overlaps(d, "doc_id", "text", i.where("false"), "item_id", "text", sent_words=sent).count() == 0


def brute(a, b, window, misses):
    """The best overlap by its definition."""
    lines, exact = {}, False
    for i in range(len(a) - window + 1):
        for j in range(len(b) - window + 1):
            same = [x == y for x, y in zip(a[i : i + window], b[j : j + window])]
            if sum(same) >= window - misses:
                exact |= all(same)
                lines.setdefault(i - j, {}).update((i + k, e) for k, e in enumerate(same))
    return max((sum(c.values()), len(c)) for c in lines.values()) + (exact,) if lines else None


@pytest.mark.parametrize("sent", [leakage.SENT_WORDS, 0])
def test_planted_substitutions_are_all_found(spark, sent):
    rng = random.Random(11)
    words = vocabulary(90)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(14, 30)))) for i in range(8)]
    docs = []
    for i in range(150):
        source = rng.choice(items)[1].split()
        n = rng.randint(14, len(source))
        at = rng.randint(0, len(source) - n)
        passage = source[at : at + n]
        for k in rng.sample(range(n), rng.choice([0, 1, 2, 2, 3])):
            passage[k] = "other"
        docs.append((i, " ".join(rng.choices(words, k=rng.randint(0, 9)) + passage + rng.choices(words, k=rng.randint(0, 9)))))
    docs.append((3, docs[3][1]))
    expected = {(d, i): got for d, t in docs for i, u in items if (got := brute(t.split(), u.split(), 14, 2))}
    assert len(expected) > 100 and len({e[2] for e in expected.values()}) == 2
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(f"k{i}", t) for i, t in items], "item_id string, text string")
    got = leakage.overlaps(d, "doc_id", "text", i, "item_id", "text", sent_words=sent).collect()
    assert {(r["doc_id"], int(r["item_id"][1:])): (r["n_equal"], r["n_words"], r["exact"]) for r in got} == expected and len(got) == len(expected)


def test_masks_pass_over_any_two_words():
    masks = leakage.masks_of(14, 2)
    assert len(masks) == 6 and all(any(m[a] == m[b] == "0" for m in masks) for a in range(14) for b in range(14))
    assert leakage.masks_of(14, 0) == ("1" * 14,)


@pytest.mark.parametrize("misses", [0, 1])
def test_fewer_misses_and_shorter_windows(spark, misses):
    words = vocabulary(12)
    changed = [*words[:3], "zz", *words[4:]]
    d = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(words))], "doc_id long, text string")
    i = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_equal"], r["n_words"]) for r in leakage.overlaps(d, "doc_id", "text", i, "item_id", "text", misses=misses, window=5).collect()}
    assert got == {1: (11, 12) if misses else (8, 8), 2: (12, 12)}
