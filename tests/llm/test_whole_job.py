"""Rows for which operators once did less than the whole job."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadframe.llm import words


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_in_texts(name):
    """Against the library with nothing set: contents of added tokens have ids of their own."""
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = []
    for token in ("<|endoftext|>", "<|startoftext|>"):
        for t in (token, token.upper(), token[:-1], token[1:], token[:5] + " " + token[5:], token + token):
            texts += [t, f"a {t} b", f"a{t}b", f" {t}", f"{t}\n", f"One, {t}.", f"{t} Two words.", f"\u00a0{t} x", f"a \t{t}  \u00e9 \u00a4 b!"]
    got = words.CachedTokenizer(public_tokenizers.path(name))
    for batch in (texts, texts[::-1], [t for t in texts for _ in range(2)]):
        ids, counts = got.encode_batch(batch)
        expected = [plain.encode(t, add_special_tokens=False).ids for t in batch]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    assert plain.token_to_id("<|endoftext|>") in got.encode_batch(["a <|endoftext|> b"])[0]


def test_pipeline_drops_rows_not_ids(spark, tmp_path):
    """Repeated and null ids: a stage drops a row for its own text alone."""
    import corpus_pipeline

    a, b, c, d, e = map(prose, range(5))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c + " end"), (None, a), (None, d), (None, d + " end"), (4, e), (4, e), (5, None), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept.total() == 8 and kept[1, a] == kept[2, b] == kept[4, e] == 1
    assert kept[3, c] + kept[3, c + " end"] == 1 == kept[None, d] + kept[None, d + " end"]
    spark.createDataFrame([(1, d)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.leaked(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(r for r in rows if d not in (r[1] or ""))
