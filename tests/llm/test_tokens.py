import pytest

from quern.llm import tokens as T


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    df = spark.createDataFrame([(1, "Hello world", "s"), (2, None, "s"), (3, "", None), (4, "a" * 20_000, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in T.token_counts(df, "doc_id", "text", ("source",), name=name).collect()}
    assert got[1][1] >= 2 and got[2] == ("s", 0) and got[3] == (None, 0) and got[4][1] > 100


def test_same_vocabulary_in_two_files():
    texts = ["The quick brown fox. 12 cats!", "naïve  café\n\n x"]
    assert T.encoder(name="byte_bpe_50k.tiktoken")(texts) == T.encoder(name="byte_bpe_50k.json")(texts)
